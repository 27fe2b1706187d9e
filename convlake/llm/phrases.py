"""Phrase collocation mining on a weighted de Bruijn graph of words.

Texts are cut into pieces. Nodes are three words in a row, an edge is four in a row and leads from its first three to its last three; its
weight is how often it occurs. Only edges and the ends of pieces are counted: what goes through a node is what leaves it along its edges
plus the pieces that end in it, so the counts of three words follow from those of four, of two from three, of one from two.

Tasks count block by block and send a block's edges, sorted and packed, to the bucket of the node they leave, where edges are summed
and flows are known; what occurs less often than a candidate must is dropped there. Flows of two words and one are derived in the
block, as they add up over blocks. Of what is left, nodes whose whole flow comes in along one edge and goes out along one are compacted
into paths: all edges of a path have one weight, and no phrase inside it is a candidate, as a longer one is as frequent. Paths end, since
a piece that went round a cycle would have to stop at one of its nodes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convlake.llm.common import discard, store

LONGEST = 4
MIN_COUNT = 30
#: A candidate goes if a longer one that holds it is at least this often of its own count, in percent.
HELD_PERCENT = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN_LANG = "und"
#: Words (and ends of pieces) that a task counts together, a text being counted whole; bytes of text for each bucket, bytes of a text that are
#: cut into words at a time, edges of a path row.
BLOCK_WORDS, BUCKET_BYTES, READ_BYTES, PATH_EDGES = 1_500_000, 8 << 20, 4 << 20, 1024
#: Grams of a bucket that are summed up together at least, and about those of a block that are text at a time.
MERGED_GRAMS, JOINED_GRAMS = 1 << 20, 1 << 17
#: A byte that no text has, for the end of a piece.
_END = b"\xff"
_TO_END = bytes.maketrans(b".,;:!?\n\x0b\x0c\r", _END * 10)
_MIX = np.uint64(0x9E3779B97F4A7C15)
PACKED = "lang string, bucket int, size int, once binary, often binary, counts array<long>"
COUNTED = "lang string, size int, gram string, n long, flow long"


class Block:
    """Texts of one language as a stream of word numbers, 0 between pieces."""

    def __init__(self):
        self.words = defaultdict(count().__next__)
        self.words[_END]
        self.ids: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        raw, at = text.encode().lower().translate(_TO_END), 0
        while at < len(raw):
            to = at + READ_BYTES
            to = len(raw) if to >= len(raw) else 1 + max(raw.rfind(c, at, to) for c in (b" ", b"\t", _END))
            if to <= at:  # one word longer than what is read at once
                to = min((x for x in (raw.find(c, at + READ_BYTES) for c in (b" ", b"\t", _END)) if x >= 0), default=len(raw) - 1) + 1
            words = raw[at:to].replace(_END, b" " + _END + b" ").split()
            self._append(np.fromiter(map(self.words.__getitem__, words), np.int32, len(words)))
            at = to
        self._append(np.zeros(1, np.int32))

    def _append(self, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.size += len(ids)

    def counted(self) -> tuple[list[bytes], dict[int, tuple[list[np.ndarray], np.ndarray]]]:
        """The words in order, and for 4, 2 and 1 words different grams as numbers of their words, with counts. An edge's last word is -1
        where a piece ends in the node. Only edges and ends are counted; what two words and one occur is what flows on from them."""
        names = sorted(self.words)  # the end of a piece is the last: no text has its byte
        rank = np.empty(len(names), np.int32)
        rank[[self.words[w] for w in names]] = np.arange(len(names))
        stream, base = rank[np.concatenate(self.ids)], len(names)
        self.ids.clear()
        places = np.arange(len(stream), dtype=np.int32)
        end = stream == base - 1
        run = places - np.maximum.accumulate(np.where(end, places, np.int32(-1)))  # the word's place in its piece, from 1
        del places
        last = np.flatnonzero(end[1:] & ~end[:-1])
        second = np.flatnonzero(run >= 2)
        pairs, number = np.unique(stream[second - 1].astype(np.int64) * base + stream[second], return_inverse=True)
        pair = np.zeros(len(stream), np.int64)  # the two words that end here
        pair[second] = number
        del second, number
        fourth, third = np.flatnonzero(run >= 4), last[run[last] >= 3]
        edges, n_edges = np.unique(pair[fourth - 2] * len(pairs) + pair[fourth], return_counts=True)
        ends, n_ends = np.unique(pair[third - 1] * base + stream[third], return_counts=True)
        ended = pair[last[run[last] >= 2]]
        del fourth, third, pair
        out, to = np.divmod(edges, max(1, len(pairs)))
        node, word = np.divmod(ends, base)
        flow = np.bincount(np.concatenate([out, node, ended]), np.concatenate([n_edges, n_ends, np.ones(len(ended))]), len(pairs)).astype(np.int64)
        first, other = (x.astype(np.int32) for x in np.divmod(pairs, base))
        words = np.bincount(np.concatenate([first, stream[last]]), np.concatenate([flow, np.ones(len(last))]), base).astype(np.int64)[:-1]
        grams = [np.concatenate([first[out], first[node]]), np.concatenate([other[out], other[node]]), np.concatenate([first[to], word.astype(np.int32)]), np.concatenate([other[to], np.full(len(ends), -1, np.int32)])]
        return names[:-1], {4: (grams, np.concatenate([n_edges, n_ends])), 2: ([first, other], flow), 1: ([np.arange(base - 1)], words)}

    def packed(self, lang: str, buckets: int) -> Iterator[tuple]:
        """Rows of PACKED: by bucket of the node (or of the two words, or the word) the grams that occur once, and others with their counts."""
        import pyarrow.compute as pc

        names, counted = self.counted()
        hashes = np.fromiter(map(zlib.crc32, names), np.uint64, len(names))
        text = pa.array([*names, b""], pa.binary())
        for size in list(counted):
            grams, n = counted.pop(size)
            mixed = np.zeros(len(n), np.uint64)
            for column in grams[:3]:
                mixed = (mixed ^ hashes[column]) * _MIX
                mixed ^= mixed >> np.uint64(29)
            place = 2 * (mixed % np.uint64(buckets)).astype(np.int64) + (n > 1)
            del mixed
            order = np.argsort(place, kind="stable")
            place, n = place[order], n[order]
            keys = np.flatnonzero(np.diff(place >> 1, prepend=-1))
            often = np.searchsorted(place, place[keys] | 1)
            bounds = np.append(np.stack([keys, often], 1).ravel(), len(n)).astype(np.int64)
            i = 0
            while i < len(keys):  # whole buckets of about JOINED_GRAMS at a time become text
                to = max(i + 1, int(np.searchsorted(keys, keys[i] + JOINED_GRAMS)))
                held = order[bounds[2 * i] : bounds[2 * to]]
                columns = [text.take(pa.array(np.where(c[held] < 0, len(names), c[held]))) for c in grams]
                lines = pc.binary_join_element_wise(*columns, b" ") if len(columns) > 1 else columns[0]
                blobs = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(bounds[2 * i : 2 * to + 1] - bounds[2 * i]), lines), b"\n").to_pylist()
                for j in range(i, to):
                    yield lang, int(place[keys[j]] >> 1), size, blobs[2 * (j - i)], blobs[2 * (j - i) + 1], n[bounds[2 * j + 1] : bounds[2 * j + 2]].tolist()
                i = to


def _pack(buckets: int, block_words: int):
    def run(batches: Iterator) -> Iterator:
        types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        names = [f.split()[0] for f in PACKED.split(", ")]
        blocks: dict[str, Block] = {}

        def flush() -> Iterator:
            for lang, block in blocks.items():
                rows = block.packed(lang, buckets)
                while some := list(islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=names)
            blocks.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                blocks.setdefault(lang, Block()).add(text.as_py())
                if sum(b.size for b in blocks.values()) >= block_words:
                    yield from flush()
        yield from flush()

    return run


def _grams(joined: bytes) -> list[bytes]:
    return joined.split(b"\n") if joined else []


def _unpacked(rows: pa.RecordBatch) -> pa.Table:
    """(gram, n) of rows of PACKED, as copies: nothing of the rows is kept."""
    import pyarrow.compute as pc

    once, often = (pc.split_pattern(c.filter(pc.greater(pc.binary_length(c), 0)), b"\n").flatten() for c in (rows.column("once"), rows.column("often")))
    counts = rows.column("counts").flatten()
    return pa.table({"gram": pa.chunked_array([once, often], pa.binary()), "n": pa.chunked_array([np.ones(len(once), np.int64), counts], pa.int64())})


def _summed(parts: list[pa.Table]) -> pa.Table:
    total = pa.concat_tables(parts).group_by("gram", use_threads=False).aggregate([("n", "sum")])
    return pa.table({"gram": total["gram"], "n": total["n_sum"]}).combine_chunks()


def _count(min_count: int):
    """Of one language and bucket, the rows of COUNTED. Grams stay in Arrow's arrays, as objects they would take many times their bytes; those
    of further batches are summed up whenever they have become as many as are in the sum."""
    import pyarrow.compute as pc

    def often(grams: pa.Table) -> pa.Table:
        return grams.filter(pc.greater_equal(grams["n"], min_count))

    def through(edges: pa.Table) -> tuple[pa.Table, pa.Table]:
        """Edges without ends of pieces, with the flow of the node that each leaves; nodes. Both that occur often enough."""
        cut = pc.split_pattern(edges["gram"].combine_chunks(), b" ", max_splits=1, reverse=True).flatten()  # node, next word, node, ...
        nodes = cut.take(pa.array(np.arange(0, 2 * len(edges), 2))).dictionary_encode()
        n, at = edges["n"].to_numpy(), nodes.indices.to_numpy()
        flow = np.zeros(len(nodes.dictionary), np.int64)
        np.add.at(flow, at, n)
        edges = often(edges.append_column("flow", [flow[at]]))
        return edges.filter(pc.invert(pc.ends_with(edges["gram"], b" "))), often(pa.table({"gram": nodes.dictionary, "n": flow}))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[pa.Table]] = {4: [], 2: [], 1: []}
        for batch in batches:
            for size in set(batch.column("size").to_pylist()):
                held = parts[size]
                held.append(_unpacked(batch.filter(pc.equal(batch.column("size"), size))))
                if sum(map(len, held[1:])) > max(MERGED_GRAMS, len(held[0])):
                    parts[size] = [_summed(held)]
        totals = {size: _summed(held) for size, held in parts.items() if held}
        parts.clear()
        found = {}
        if 4 in totals:
            found[4], found[3] = through(totals.pop(4))
        found |= {size: often(total) for size, total in totals.items()}
        if 1 in totals:
            found[0] = pa.table({"gram": pa.array([b""], pa.binary()), "n": [pc.sum(totals[1]["n"])]})
        lang = key[0].as_py()
        for size, grams in found.items():
            flow = grams["flow"] if size == 4 else pa.nulls(len(grams), pa.int64())
            columns = [pa.array([lang] * len(grams), pa.string()), pa.array(np.full(len(grams), size, np.int32)), grams["gram"].cast(pa.string()), grams["n"], flow]
            yield from pa.table(columns, names=[f.split()[0] for f in COUNTED.split(", ")]).to_batches(max_chunksize=10_000)

    return run


def frequent_grams(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, block_words: int = BLOCK_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(lang, size, gram, n, flow): phrases of size 1 to 4 words that occur min_count times or more, flow being the count of an edge's first
    three words; and for size 0 parts of the number of all words."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    packed = rows.mapInArrow(_pack(1 + size // bucket_bytes, block_words), PACKED)
    return packed.groupBy("lang", "bucket").applyInArrow(_count(min_count), COUNTED)


def first_words(gram: str | Column, n: int) -> Column:
    return F.substring_index(gram, " ", n)


def last_words(gram: str | Column, n: int) -> Column:
    return F.substring_index(gram, " ", -n)


def compact_paths(edges: DataFrame) -> DataFrame:
    """Edges (lang, gram, n, flow, next_flow) with the path that each lies on, as its first edge, and its place there.

    Two edges are of one path if the node between them takes its whole flow from the one and gives it to the other. Each edge points to the
    one before it; pointers are doubled until all point to first edges: log2 of the longest path joins of the edges still under way.
    """
    into = edges.where("n = next_flow").select("lang", last_words("gram", 3).alias("node"), F.col("gram").alias("head"))
    out = edges.where("n = flow").select("lang", first_words("gram", 3).alias("node"), "gram")
    moving = store(out.join(into, ["lang", "node"]).select("lang", "gram", "head", F.lit(1).cast("long").alias("place")), "path-pointers")
    under_way = not moving.isEmpty()
    while under_way:
        before = moving.select("lang", F.col("gram").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        both = moving.join(before, ["lang", "head"], "left")
        further = store(both.select("lang", "gram", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("further").isNotNull().alias("moved")), "path-pointers")
        under_way = not further.where("moved").isEmpty()
        discard(moving)
        moving = further.drop("moved")
    return edges.join(moving, ["lang", "gram"], "left").select(
        "lang", "gram", "n", "flow", "next_flow", F.coalesce("head", "gram").alias("path"), F.coalesce("place", F.lit(0)).cast("long").alias("place")
    )


def _cut(k: int, a: Column, left: Column, right: Column) -> Column:
    """Score first, so the smallest struct is the lowest-scoring cut, ties to the smallest k; an integer division of decimals, so it is exact."""
    whole = lambda c, digits: c.cast(f"decimal({digits},0)")
    score = F.call_function("div", whole(F.lit(SCALE), 7) * whole(a, 19), whole(left, 19) + whole(right, 19)).cast("long")
    return F.struct(score.alias("score"), F.lit(k).alias("k"), left.alias("l"), right.alias("r"))


def path_scores(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, phrase, a, best) of four words: counts of words and pairs are looked up once for each place of a path.

    edges are those of compact_paths, pairs are (lang, gram, n, f_first, f_second).
    """
    key = ["lang", "path", "part"]
    row = F.struct("place", "gram", "n", "flow", "next_flow")
    paths = edges.groupBy("lang", "path", F.expr(f"place div {PATH_EDGES}").alias("part")).agg(F.array_sort(F.collect_list(row)).alias("edges"))  # PATH_EDGES at most
    words = F.concat(F.split(first_words(F.col("edges")[0]["gram"], 3), " "), F.transform("edges", lambda e: last_words(e["gram"], 1)))
    nodes = F.concat(F.transform("edges", lambda e: e["flow"]), F.array(F.element_at("edges", -1)["next_flow"]))
    paths = paths.withColumn("words", words).withColumn("f3", nodes)
    places = paths.select(*key, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))).alias("at", "pair"))
    known = places.join(pairs.select("lang", F.col("gram").alias("pair"), F.col("n").alias("f2"), "f_first", "f_second"), ["lang", "pair"])
    known = known.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("at", "f2", "f_first", "f_second"))).alias("known"))
    joined = paths.join(known, key).select("lang", "known", "f3", F.posexplode("edges").alias("at", "edge"))
    f2 = lambda i: F.col("known")[F.col("at") + i]["f2"]
    a, f3 = F.col("edge.n"), F.col("f3")
    best = F.array_min(F.array(
        _cut(1, a, F.col("known")[F.col("at")]["f_first"], f3[F.col("at") + 1]), _cut(2, a, f2(0), f2(2)), _cut(3, a, f3[F.col("at")], F.col("known")[F.col("at") + 2]["f_second"])
    ))
    return joined.select("lang", F.col("edge.gram").alias("phrase"), a.alias("a"), best.alias("best"))


def _with_pair(rows: DataFrame, pairs: DataFrame, pair: Column, name: str) -> DataFrame:
    """rows with a struct of the counts of two of a gram's words."""
    looked_up = pairs.select("lang", F.col("gram").alias("pair"), F.struct(F.col("n").alias("f2"), "f_first", "f_second").alias(name))
    return rows.withColumn("pair", pair).join(looked_up, ["lang", "pair"]).drop("pair")


def _not_held(grams: DataFrame, longer: DataFrame, size: int) -> DataFrame:
    """grams without those that a longer phrase holds often enough; longer ones have one word more, before or after."""
    held = longer.select("lang", "n", F.explode(F.array(first_words("gram", size), last_words("gram", size))).alias("gram"))
    most = held.groupBy("lang", "gram").agg(F.max("n").alias("most"))
    return grams.join(most, ["lang", "gram"], "left").where(f"most IS NULL OR 100 * most < {HELD_PERCENT} * n").drop("most")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP, block_words: int = BLOCK_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of 2 to 4 words of each language.

    Null text counts as empty, null language as `und`, which a row may also name. Repeated rows count each. A language without candidates has
    no rows, nor has an empty table. Columns other than the two are not read, and no others are kept. A phrase that a longer one holds is
    dropped by the longest phrases' rule for every length between, as a four-word phrase holds its three-word ones.
    """
    grams = store(frequent_grams(docs, text_col, lang_col, min_count, block_words, bucket_bytes), "phrase-grams")
    of = {size: grams.where(f"size = {size}").select("lang", "gram", "n") for size in (1, 2, 3)}
    words = of[1].withColumnRenamed("n", "f")
    pairs = of[2].withColumn("first", first_words("gram", 1)).withColumn("second", last_words("gram", 1))
    for side in ("first", "second"):
        pairs = pairs.join(words.select("lang", F.col("gram").alias(side), F.col("f").alias(f"f_{side}")), ["lang", side])
    pairs = store(pairs.select("lang", "gram", "n", "f_first", "f_second"), "phrase-pairs")
    nodes = of[3]
    edges = grams.where("size = 4").withColumn("next", last_words("gram", 3))
    edges = store(edges.join(nodes.select("lang", F.col("gram").alias("next"), F.col("n").alias("next_flow")), ["lang", "next"]).select("lang", "gram", "n", "flow", "next_flow"), "phrase-edges")
    fours = path_scores(store(compact_paths(edges), "phrase-paths"), pairs)
    threes = _with_pair(_with_pair(_not_held(nodes, edges, 3), pairs, first_words("gram", 2), "left"), pairs, last_words("gram", 2), "right")
    n = F.col("n")
    threes = threes.select("lang", F.col("gram").alias("phrase"), n.alias("a"), F.array_min(F.array(_cut(1, n, F.col("left.f_first"), F.col("right.f2")), _cut(2, n, F.col("left.f2"), F.col("right.f_second")))).alias("best"))
    twos = _not_held(pairs, nodes, 2).select("lang", F.col("gram").alias("phrase"), n.alias("a"), _cut(1, n, F.col("f_first"), F.col("f_second")).alias("best"))
    found = fours.unionByName(threes).unionByName(twos).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))  # cut to `top` rows a task before the exchange
    total = grams.where("size = 0").groupBy("lang").agg(F.sum("n").alias("n"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= top).join(total, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def duckdb_sql() -> str:
    """The same rows from counts of all phrases of 1 to 4 words."""
    joined = {k: " || ' ' || ".join(f"w[i + {j}]" for j in range(k)) for k in range(1, 5)}
    grams = " UNION ALL ".join(f"SELECT lang, {k} AS size, {joined[k]} AS gram FROM p, LATERAL (SELECT unnest(range(1, len(w) - {k - 2})) AS i) WHERE len(w) >= {k}" for k in range(1, 5))
    cut = lambda k: f"array_to_string(string_split(gram, ' ')[:{k}], ' ')"
    rest = lambda k: f"array_to_string(string_split(gram, ' ')[{k + 1}:], ' ')"
    cuts = " UNION ALL ".join(f"SELECT lang, gram, a, {k} AS k, {cut(k)} AS x, {rest(k)} AS y FROM c WHERE size > {k}" for k in (1, 2, 3))
    return rf"""
WITH p AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, '{UNKNOWN_LANG}') AS lang,
               unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), f AS MATERIALIZED (
  SELECT lang, size, gram, count(*) AS a FROM ({grams}) GROUP BY ALL HAVING count(*) >= {MIN_COUNT}
), n AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang
), c AS (
  SELECT * FROM f WHERE size > 1
), held AS (
  SELECT lang, part AS gram, max(a) AS most FROM (
    SELECT lang, a, unnest([array_to_string(string_split(gram, ' ')[:size - 1], ' '), array_to_string(string_split(gram, ' ')[2:], ' ')]
           || CASE WHEN size = 4 THEN [array_to_string(string_split(gram, ' ')[:2], ' '), array_to_string(string_split(gram, ' ')[2:3], ' '), array_to_string(string_split(gram, ' ')[3:], ' ')] ELSE [] END) AS part
    FROM c WHERE size > 2) GROUP BY ALL
), scored AS (
  SELECT u.lang, u.gram, u.a, u.k, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * u.a) // (l.a::HUGEINT + r.a) AS score
  FROM ({cuts}) u JOIN f l ON l.lang = u.lang AND l.gram = u.x JOIN f r ON r.lang = u.lang AND r.gram = u.y
), best AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, gram ORDER BY score, k) = 1
), ranked AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.gram)) AS rank
  FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.gram = b.gram WHERE h.most IS NULL OR 100 * h.most < {HELD_PERCENT} * b.a
)
SELECT lang, rank, gram AS phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= {TOP}
"""
