"""N-gram Jaccard self-join of documents with PartEnum signatures.

Documents are sets of word shingles. Two sets of at most r elements with a Jaccard similarity of at least g differ in at most
k = 2 r (1 - g) / (1 + g) elements. The domain of shingle hashes is cut into n1 parts, each of them into n2 smaller ones; if two sets
differ in at most k elements, in at least one of the n1 parts they differ in at most k2 of the n2 smaller parts, as n1 (k2 + 1) > k. So a
signature for each part and each way to leave out k2 of its smaller parts makes sure that two such sets share one. Bands of sizes keep r
close to the sizes of the sets.

A signature over smaller parts in which a set has no elements says nothing, and every set of a band may share it. Such signatures are never
used: there are some more parts than needed, so that similar sets agree in more parts than the spare ones, and a set that has empty
signatures in no more parts than that agrees in another one too. A set that has them in more parts gives its other signatures and is signed
once more over a domain cut in another way, until it has few enough; two similar sets share a signature in the first of these rounds in
which one of them has.

Signatures are exchanged once, packed: for each partition of the signature space a task sends one row for some million signatures, with 32
bits of each and the sets they belong to. Sets of a task that share a signature are replaced by the least of them there, so a signature that
a third of all documents share reaches its partition as one entry for each block.

Sets that share a signature are compared first by sketches: the parities of how many elements fall in each bucket. Every element
that only one of two sets has changes one parity, so sets whose sketches differ in more than k places are certainly too far apart.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.common import discard, partitions, store
from convlake.llm.components import components

WORDS, PERCENT = 5, 80
#: The largest size of a band over its smallest, the smaller parts of a part, and how many of those a signature leaves out.
BAND, SMALLER, LEFT_OUT = 1.5, 3, 1
#: Sets that differ in at most so few elements have one part only, cut in FEW_PARTS.
FEW, FEW_PARTS = 3, 6
#: Parts beyond those needed, as shares of them: the least that covers the empty ones to be expected. Two more are always there.
SPARE = (0.0, 0.02, 0.05, 0.08, 0.12, 0.16, 0.2)
#: Ways of cutting the domain that a set is signed over at most; in the last one it gives its empty signatures too.
ROUNDS = 8
#: Signatures that a task of the exchange gets, about, and those that are packed at a time.
PARTITION_SIGNATURES, BLOCK_SIGNATURES = 2_500_000, 1_000_000
#: Ids up to this number (8 MB) are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Least numbers of 64 bits of a sketch, and its least bits for each element. FIRST numbers are compared first.
SKETCH, SKETCH_BITS, FIRST = 8, 4, 16
#: Orders of sets, one of which gives a signature's lead.
LEADS = 4
#: Sets of a group that are compared at a time with as many others.
GROUP_BLOCK = 1_024
#: Nearest pairs of a component in a group that are compared by texts in the first round, and how many times more in each further one.
NEAREST, MORE = 2, 8

_M = (1 << 64) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_KEPT: dict = {}  # what a task has worked out already


def _mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & _M)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    if len(_KEPT.get("powers", ())) < n:
        _KEPT["powers"] = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE))])
    return _KEPT["powers"]


def shingles(text: str | None, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; words are split at ASCII white space, A-Z count as a-z.

    A text of fewer words than a shingle has gives one shingle of all its words, a text without words none.
    """
    raw = np.frombuffer((text or "").encode(), np.uint8)
    solid = ~_SPACE[raw]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, np.uint64)
    base = np.zeros(len(raw), np.int64)
    base[starts] = starts
    at = np.arange(len(raw)) - np.maximum.accumulate(base)
    longest = 1 << int(at.max() + 1).bit_length()
    parts = _BYTE[raw] * _powers(max(longest, 1 << 12))[at] * solid
    word = _mix(np.add.reduceat(parts, starts) + (ends - starts).astype(np.uint64))
    n = min(words, len(word))
    gram = np.full(len(word) - n + 1, np.uint64(n))
    for i in range(n):
        gram = _mix(gram * _BASE + word[i : len(word) - n + 1 + i])
    return np.unique(gram)


def _spare(n1: int, n2: int, k2: int, least: float) -> int:
    """Parts to add to n1, so that sets with at least so many elements have an empty signature in no more parts than that, as a rule."""
    if n1 < 3:
        return 0
    for share in SPARE:
        q = math.exp(-least / (n1 * (1 + share) * n2))
        empty = sum(math.comb(n2, i) * q**i * (1 - q) ** (n2 - i) for i in range(n2 - k2, n2 + 1))
        if empty * (1 + share) <= 0.9 * share:
            break
    return 2 + int(share * n1)


def _bands(percent: int, band: float, smaller: int, left_out: int, largest: int) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """The first sizes of the bands, and for each (n1, n2, k2, parts beyond those needed)."""
    key = (percent, band, smaller, left_out, largest)
    if key in _KEPT:
        return _KEPT[key]
    firsts, plans, low = [], [], 1
    while low <= largest:
        high = max(low, int(low * band))
        k = 2 * high * (100 - percent) // (100 + percent)
        n1 = -(-(k + 1) // (left_out + 1))
        spare = _spare(n1, smaller, left_out, low * percent / 100)
        plans.append((1, 1, 0, 0) if not k else (1, FEW_PARTS, k, 0) if k <= FEW else (n1 + spare, smaller, left_out, spare))
        firsts.append(low)
        low = high + 1
    _KEPT[key] = np.array(firsts), plans
    return _KEPT[key]


def signatures(grams: np.ndarray, percent: int, band: float = BAND, smaller: int = SMALLER, left_out: int = LEFT_OUT) -> np.ndarray:
    """PartEnum signatures of a set for its own band, and for the next one where a set of that band can be similar enough."""
    size = len(grams)
    if not size:
        return np.empty(0, np.uint64)
    firsts, plans = _bands(percent, band, smaller, left_out, 1 << (2 * size).bit_length())
    own = int(np.searchsorted(firsts, size, "right")) - 1
    bands = [own, own + 1] if size * 100 // percent >= firsts[own + 1] else [own]
    out, cut = [], grams
    for turn in range(ROUNDS):
        if turn:
            cut = np.sort(_mix(grams, 40 + turn))
        running = np.concatenate([[np.uint64(0)], np.cumsum(_mix(cut, 5))])
        high, again = cut >> np.uint64(32), []
        for j in bands:
            n1, n2, k2, spare = plans[j]
            edges = np.searchsorted(high, (np.arange(n1 * n2 + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n1 * n2))
            sums = (running[edges[1:]] - running[edges[:-1]]).reshape(n1, n2)
            filled = (np.diff(edges) > 0).reshape(n1, n2)
            part, empty = np.arange(n1, dtype=np.uint64) * _BASE, np.zeros(n1, bool)
            for way, kept in enumerate(itertools.combinations(range(n2), n2 - k2)):
                some = filled[:, kept].any(1)
                empty |= ~some
                if turn == ROUNDS - 1:
                    some[:] = True
                total = sums[:, kept].sum(1, dtype=np.uint64)
                out.append(_mix(_mix(total, 11 + way) + part, j + 64 * turn)[some])
            if empty.sum() > spare:
                again.append(j)
        bands = again
        if not bands:
            break
    return np.unique(np.concatenate(out))


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parities of the numbers of elements in buckets, whose number is a power of two."""
    bits = 1 << max(64 * SKETCH - 1, SKETCH_BITS * len(grams) - 1).bit_length()
    odd = np.bincount((_mix(grams, 9) >> np.uint64(24)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.uint64)


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set with fewer buckets."""
    return np.bitwise_xor.reduce(x.reshape(-1, size), 0) if len(x) > size else x


def _too_far(differ, n, m, percent: int):
    """Whether sets of n and m elements that differ in at least so many cannot be similar enough."""
    return differ * (100 + percent) > (n + m) * (100 - percent)


def _sets(words: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            rows = []
            for text in batch.column(1):
                grams = shingles(text.as_py(), words)
                odd = sketch(grams)
                rows.append((len(grams), int(_mix(grams, 1).sum(dtype=np.uint64)), int(_mix(grams, 2).sum(dtype=np.uint64)), _folded(odd, min(FIRST, len(odd))).tobytes(), odd.tobytes()))
            size, one, two, few, odd = zip(*rows) if rows else ((), (), (), (), ())
            hashes = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, two)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), *hashes, pa.array(few, pa.binary()), pa.array(odd, pa.binary())], names=["doc_id", "n", "s1", "s2", "few", "odd"])

    return run


def _signer(words: int, percent: int, band: float, smaller: int, left_out: int, parts: int):
    """Packed rows (part, sigs, counts, sets, shared): for each part of the signature space the low 32 bits of signatures, how many each set
    has there, and the first hashes of the sets. shared holds (signature, least set, set) for sets of the same block, to pass on."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        at = TaskContext.get().partitionId()
        held, keys, met, n = [], [], set(), 0

        def packed() -> pa.RecordBatch:
            nonlocal at, held, keys, met, n
            of, name = np.repeat(np.arange(len(keys)), [len(x) for x in held]), np.array(keys, np.int64)
            sigs = np.concatenate(held)
            order = np.argsort(sigs, kind="stable")
            ordered, first = sigs[order], np.ones(len(order), bool)
            first[1:] = ordered[1:] != ordered[:-1]
            lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
            more = ~first
            shared = np.stack([ordered[more].view(np.int64), name[of[lead[more]]], name[of[order[more]]]], 1)
            alone = np.ones(len(sigs), bool)
            alone[order[more]] = False
            sigs, of = sigs[alone], of[alone]
            part = (sigs >> np.uint64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part, low, of = part[order], sigs[order].astype(np.uint32), of[order]
            rows, edges = [], np.flatnonzero(np.diff(part, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:]):
                starts = np.flatnonzero(np.diff(of[a:b], prepend=-1))
                rows.append((int(part[a]), low[a:b].tobytes(), np.diff(starts, append=b - a).astype(np.uint32).tobytes(), name[of[a:b][starts]].tobytes(), b""))
            for some in np.array_split(shared, -(-len(shared) // 100_000)) if len(shared) else ():
                rows.append((at % parts, b"", b"", b"", some.tobytes()))
                at += 1
            held, keys, met, n = [], [], set(), 0
            types = (pa.int32(), *[pa.binary()] * 4)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["part", "sigs", "counts", "sets", "shared"])

        for batch in batches:
            for text in batch.column(0):
                grams = shingles(text.as_py(), words)
                key = int(_mix(grams, 1).sum(dtype=np.uint64).view(np.int64)), int(_mix(grams, 2).sum(dtype=np.uint64))
                if not len(grams) or key in met:
                    continue
                met.add(key)
                sigs = signatures(grams, percent, band, smaller, left_out)
                high = ((sigs >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
                held.append(np.unique(high << np.uint64(32) | (sigs & np.uint64(0xFFFFFFFF))))
                keys.append(key[0])
                n += len(sigs)
                if n >= BLOCK_SIGNATURES:
                    yield packed()
        if n:
            yield packed()

    return run


def _meetings(batches: Iterator) -> Iterator:
    """(sig, lead, member) for each set that shares a signature with others, from all packed rows of one part. The lead of a signature is the
    first of its sets in one of LEADS orders, so sets with many signatures in common are compared with several of them."""
    import pyarrow as pa

    part, sigs, sets = 0, [np.empty(0, np.uint32)], [np.empty(0, np.int64)]

    def rows(x: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in x.T], names=["sig", "lead", "member"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["shared"]:
                yield rows(np.frombuffer(row["shared"], np.int64).reshape(-1, 3))
            else:
                part = row["part"]
                sigs.append(np.frombuffer(row["sigs"], np.uint32))
                sets.append(np.repeat(np.frombuffer(row["sets"], np.int64), np.frombuffer(row["counts"], np.uint32)))
    sig, member = np.concatenate(sigs), np.concatenate(sets)
    order = np.argsort(sig, kind="stable")
    sig, member = sig[order], member[order]
    twice = np.zeros(len(sig) + 1, bool)
    twice[1:-1] = sig[1:] == sig[:-1]
    kept = twice[1:] | twice[:-1]
    sig, member = sig[kept], member[kept]
    rank = member.copy()
    for turn in range(LEADS):
        these = sig % LEADS == turn
        rank[these] = _mix(member[these].view(np.uint64), turn).view(np.int64)
    order = np.lexsort((rank, sig))
    sig, member = sig[order], member[order]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    lead = member[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(sig) else member
    other = lead != member
    for i in range(0, int(other.sum()), 100_000):
        some = np.flatnonzero(other)[i : i + 100_000]
        yield rows(np.stack([sig[some].astype(np.int64) | part << 32, lead[some], member[some]], 1))


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """rows whose doc_id is among ids (left_semi) or is not (left_anti); a small number of ids spares the shuffle of the texts."""
    few = ids.count() <= BROADCAST_IDS
    return rows.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _sketched(percent: int):
    """Of rows (a, b, n_a, n_b, odd_a, odd_b) the pairs (a, b) whose sketches leave it open that the sets are similar enough."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n, m, kept = batch.column(2).to_pylist(), batch.column(3).to_pylist(), []
            for i, (x, y) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                size = min(len(x), len(y))
                if not _too_far(int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum()), n[i], m[i], percent):
                    kept.append(i)
            yield pa.RecordBatch.from_arrays([c.take(pa.array(kept, pa.int64())) for c in batch.columns[:2]], names=["a", "b"])

    return run


def _grouped(percent: int, nearest: int):
    """For rows (sig, cell, side, doc_id, component, n, few), sorted by sig and cell: pairs (a, b) of sets of one cell that are in different
    components, on different sides where a cell has two, and near enough by the first numbers of their sketches, but for each component
    of a cell only its so many nearest. A row (sig, cell) for each cell that has more."""

    def edges(x) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        group = ((x["sig"] != x["sig"].shift()) | (x["cell"] != x["cell"].shift())).cumsum().to_numpy()
        sizes = np.bincount(group)[group]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        component, n, side = (x[c].to_numpy() for c in ("component", "n", "side"))
        length = x["few"].str.len().to_numpy() // 8
        few = np.frombuffer(b"".join(o.ljust(8 * FIRST, b"\0") for o in x["few"]), np.uint64).reshape(-1, FIRST)
        alive, step, found = np.flatnonzero(place + 1 < sizes), 1, [np.empty((3, 0), np.int64)]
        while len(alive):
            i, j = alive, alive + step
            low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
            some = (component[i] != component[j]) & ((side[i] != side[j]) | (side[i] == 0)) & (low * 100 >= percent * high)
            i, j = i[some], j[some]
            short, differ = np.minimum(length[i], length[j]), np.zeros(len(i), np.int64)
            for size in np.unique(short):
                these = short == size
                odd = few[i[these]] ^ few[j[these]]
                differ[these] = np.bitwise_count(np.bitwise_xor.reduce(odd.reshape(len(odd), -1, size), 1)).sum(1)
            near = ~_too_far(differ, n[i], n[j], percent)
            found.append(np.stack([i[near], j[near], differ[near]]))
            step += 1
            alive = alive[place[alive] + step < sizes[alive]]
        return group, *np.concatenate(found, 1)

    def rows(x):
        import pandas as pd

        group, i, j, differ = edges(x)
        ends, component = np.concatenate([i, j]), x["component"].to_numpy()
        order = np.lexsort((np.tile(differ, 2), component[ends], group[ends]))
        g, c = group[ends[order]], component[ends[order]]
        first = np.ones(len(g), bool)
        first[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        place = np.arange(len(g)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(g) else g
        kept = np.zeros(len(g), bool)
        kept[order[place < nearest]] = True
        kept = kept[: len(i)] | kept[len(i) :]
        ids = x["doc_id"].to_numpy()
        a, b = ids[i[kept]], ids[j[kept]]
        pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()
        more = x.iloc[np.searchsorted(group, np.unique(group[i[~kept]]))][["sig", "cell"]]
        return pd.concat([pairs.assign(sig=None, cell=None), more.assign(a=None, b=None)])[["sig", "cell", "a", "b"]].astype("Int64")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        held = None
        for batch in batches:
            held = batch if held is None or not len(held) else pd.concat([held, batch], ignore_index=True)
            if len(held) >= 4 * GROUP_BLOCK:
                last = ((held["sig"] == held["sig"].iloc[-1]) & (held["cell"] == held["cell"].iloc[-1])).to_numpy()
                if not last.all():
                    yield rows(held[~last].reset_index(drop=True))
                    held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield rows(held)

    return run


def _verifier(words: int, percent: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        last, lead = None, None
        for batch in batches:
            a, b, similar = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if last is None or text != last:
                    last, lead = text, shingles(text, words)
                other = shingles(batch.column(3)[i].as_py(), words)
                both = len(np.intersect1d(lead, other, assume_unique=True))
                similar.append(100 * both >= percent * (len(lead) + len(other) - both))
            kept = np.flatnonzero(similar)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for i in kept], pa.int64()) for x in (a, b)], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Of pairs (a, b) those that are similar enough, by their whole texts, as a stored table. The pairs' table is used up."""
    ends = store(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct(), "candidate-ids")
    texts = store(_among(rows, ends, "left_semi"), "candidate-texts")
    a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    full = pairs.join(b, "b").join(a, "a").select("a", "b", "a_text", "b_text")
    links = store(full.mapInArrow(_verifier(words, percent), "a long, b long").distinct(), "verified-links")
    for used in (pairs, ends, texts):
        discard(used)
    return links


def _candidates(pairs: DataFrame, classes: DataFrame, by: str, percent: int) -> DataFrame:
    """Different pairs (a, b) of class ids, whose sketches are near enough, of pairs of values of the classes' column `by`, as a stored table."""
    side = lambda s: classes.select(F.col(by).alias(s), F.col("class_id").alias(f"id_{s}"), F.col("n").alias(f"n_{s}"), F.col("odd").alias(f"odd_{s}"))
    sizes = F.least("n_a", "n_b") * 100 >= percent * F.greatest("n_a", "n_b")
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes & (F.col("id_a") != F.col("id_b")))
    both = both.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b", "odd_a", "odd_b")
    near = both.mapInArrow(_sketched(percent), "a long, b long")
    return store(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidate-pairs")


def _known(classes: DataFrame, found: DataFrame) -> DataFrame:
    """The classes (s1, class_id, component, n, few), with the components found so far, as a stored table."""
    known = classes.join(found.select(F.col("id").alias("class_id"), "component"), "class_id", "left")
    return store(known.select("s1", "class_id", F.coalesce("component", "class_id").alias("component"), "n", "few"), "class-components")


def _torn_groups(met: DataFrame, known: DataFrame, group_block: int) -> DataFrame:
    """Rows (sig, cell, side, a) of all sets of groups of three or more that are in different components.

    A group of more than group_block sets is cut in blocks, and each pair of blocks is a cell, so no group is held or compared whole.
    """
    side = lambda s: known.select(F.col("s1").alias(s), F.col("component").alias(f"component_{s}"))
    torn = met.join(side("lead"), "lead").join(side("member"), "member")
    torn = torn.groupBy("sig").agg(F.count("*").alias("links"), F.max(F.col("component_lead") != F.col("component_member")).alias("torn"))
    torn = torn.where("torn AND links > 1").select("sig", F.ceil(F.col("links") / group_block).cast("int").alias("blocks"))
    members = met.join(torn, "sig").select("sig", "blocks", F.explode(F.array("lead", "member")).alias("s1")).distinct().join(known.select("s1", "class_id"), "s1")
    members = members.select("*", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2)
    return store(members.select("sig", (low.cast("long") * F.col("blocks") + high).alias("cell"), side.cast("long").alias("side"), F.col("class_id").alias("a")), "torn-groups")


def _open_pairs(cells: DataFrame, known: DataFrame, percent: int, nearest: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to compare next of sets of torn groups, and (sig, cell) of the cells that have more of them."""
    cells = cells.join(known.select(F.col("class_id").alias("a"), "component", "n", "few"), "a").select("sig", "cell", "side", F.col("a").alias("doc_id"), "component", "n", "few")
    out = cells.repartition("sig", "cell").sortWithinPartitions("sig", "cell").mapInPandas(_grouped(percent, nearest), "sig long, cell long, a long, b long")
    out = store(out, "open-pairs")
    return out.where("b IS NOT NULL").select("a", "b").distinct(), out.where("b IS NULL").select("sig", "cell")


def ngram_jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, band: float = BAND, smaller: int = SMALLER, left_out: int = LEFT_OUT, group_block: int = GROUP_BLOCK
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (the smallest id with the same set of shingles), component_id.

    Two documents link when 100 x (shared shingles) >= percent x (all shingles of both). component_id is the smallest id that links reach.

    Equal sets are one class. In each group of sets that share a signature, every set is compared with the group's lead first; the
    links found make components, and only sets of a group that are in different components still are compared with each other, by
    sketches inside blocks of the group. Of pairs near enough by their sketches each component's nearest are compared by whole texts, shingle
    by shingle as 64-bit hashes; that is repeated with more of them for groups still in different components, until none is left out. So a
    group of thousands of near copies costs a few comparisons a copy, and yet no two texts that should be linked are left apart.

    Null, empty or blank text: no shingles, linked with nothing. A row with a null id keeps a null component. Rows that share an id are one
    document, linked by any of their texts. Only the two named columns are read. An empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = store(rows.mapInArrow(_sets(words), "doc_id long, n long, s1 long, s2 long, few binary, odd binary"), "shingle-sets")
    known = sets.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("class_id"), *(F.first(c).alias(c) for c in ("n", "few", "odd")))
    classes = store(known, "shingle-classes")

    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = max(partitions(docs.sparkSession), total * 7 * (100 - percent) // (100 + percent) // PARTITION_SIGNATURES)
    packed = rows.where(F.col("doc_id").isNotNull()).select("text").mapInArrow(_signer(words, percent, band, smaller, left_out, parts), "part int, sigs binary, counts binary, sets binary, shared binary")
    met = store(packed.repartitionById(parts, F.col("part")).mapInArrow(_meetings, "sig long, lead long, member long"), "signature-groups")

    starred = _candidates(met.select(F.col("lead").alias("a"), F.col("member").alias("b")).distinct(), classes, "s1", percent)
    links = _verified(starred, rows, words, percent)
    found = store(components(links), "components")
    known = _known(classes, found)
    torn, nearest = _torn_groups(met, known, group_block), NEAREST
    discard(met)
    cells = torn
    while True:
        near, more = _open_pairs(cells, known, percent, nearest)
        pairs = _candidates(near, classes, "class_id", percent)
        if not pairs.isEmpty():
            new = _verified(pairs, rows, words, percent)
            if not new.isEmpty():
                both = store(links.unionByName(new), "verified-links")
                for used in (links, new, found, known):
                    discard(used)
                links, found = both, store(components(both), "components")
                known = _known(classes, found)
        if more.isEmpty():
            break
        cells, nearest = torn.join(more, ["sig", "cell"], "left_semi"), nearest * MORE

    classed = sets.select("doc_id", "n", "s1", "s2").join(classes.select("s1", "s2", "class_id"), ["s1", "s2"], "left")
    final = classed.join(found.withColumnRenamed("id", "class_id"), "class_id", "left")
    return final.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("doc_id").isNull(), None).when(F.col("n") > 0, F.coalesce("component", "class_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
