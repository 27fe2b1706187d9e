"""Cost-balanced packing of token ids into sequences of fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convlake.llm.tokens import BpeEncoder, vocabulary

SEQUENCE = 2048
END_ID = 1
#: A token's own cost, and that of one attention score in its piece.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that one task packs together; at two bytes an id this bounds its memory.
BLOCK_TOKENS = 4_000_000
RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Sequences that hold exactly total tokens: as many full ones as fit, then powers of two, which need no padding."""
    full, rest = divmod(total, sequence)
    return [sequence] * full + [1 << bit for bit in range(rest.bit_length() - 1, -1, -1) if rest >> bit & 1]


def pack_block(lengths: list[int], sequence: int = SEQUENCE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) for each piece of documents with the given numbers of tokens.

    A piece of n tokens costs linear x n + quadratic x n^2. Documents are taken in descending order of cost; each goes whole to the
    sequence of lowest cost that has room for it. Documents longer than a sequence give up full sequences first. Where no sequence has
    room for the whole, the one with the most room is filled and the rest of the document goes on as a smaller one.
    """
    room = np.array(capacities(sum(lengths), sequence), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    pieces, rest, opened = [], [], 0
    for doc, n in enumerate(lengths):
        start = 0
        while n - start >= sequence:
            pieces.append((doc, start, sequence, opened, 0))
            room[opened], used[opened], cost[opened] = 0, sequence, linear * sequence + quadratic * sequence**2
            start, opened = start + sequence, opened + 1
        if n > start:
            rest.append((start - n, doc, start))
    rest.sort()
    by_cost = cost.copy()
    by_cost[room == 0] = np.inf
    at = 0
    while at < len(rest):
        minus, doc, start = rest[at]
        n, at = -minus, at + 1
        best = int(np.argmin(by_cost))
        if room[best] < n:
            fits = np.where(room >= n, by_cost, np.inf)
            best = int(np.argmin(fits))
            if room[best] < n:
                best = int(np.argmax(room))
        take = min(n, int(room[best]))
        pieces.append((doc, start, take, best, int(used[best])))
        room[best] -= take
        used[best] += take
        cost[best] += linear * take + quadratic * take**2
        by_cost[best] = cost[best] if room[best] else np.inf
        if take < n:  # the rest keeps its place in the descending order
            item, lo, hi = (take - n, doc, start + take), at, len(rest)
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if rest[mid] < item else (lo, mid)
            rest.insert(lo, item)
    return pieces


def _packer(ranks_file: str, sequence: int, end_id: int, block_tokens: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bpe, names = BpeEncoder(ranks_file), [f.split()[0] for f in RESULT.split(", ")]
        next_id = TaskContext.get().partitionId() << 40
        ids: list[np.ndarray] = []
        keys: list[int | None] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_id, ids, keys, held
            rows = [
                (keys[doc], start, n, zlib.crc32(ids[doc][start : start + n].astype("<u4").tobytes()), len(ids[doc]), next_id + at, offset)
                for doc, start, n, at, offset in pack_block([len(x) for x in ids], sequence)
            ]
            next_id += 1 + max((r[5] - next_id for r in rows), default=-1)
            ids, keys, held = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(np.append(bpe.encode(text.as_py() or ""), np.uint16(end_id)))
                keys.append(key)
                held += len(ids[-1])
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_file: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document becomes its ids and end_id; every id lies in exactly one piece. Each input partition packs blocks of at most about
    block_tokens tokens on its own (a longer document is a block by itself), so nothing is shuffled, no task holds more than a block, and
    a task that is run again gives the same sequences. Sequences of a block are full, but for a few that hold a power of two tokens.

    Null or empty text: end_id alone. A null id is kept and returned as null; repeated rows are packed once each. Other columns are not
    read. An empty table gives no rows. sequence_id is unique, not consecutive.
    """
    ranks_file = ranks_file or vocabulary("byte_bpe_50k.tiktoken")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_packer(ranks_file, sequence, end_id, block_tokens), RESULT)
