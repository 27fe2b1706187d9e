"""SentencePiece encoding and decoding by shared-prefix Viterbi over a trie of distinct marked words.

A marked word is a run of word marks with the characters up to the next mark; no piece reaches beyond one. The distinct new words of a
block of texts are sorted, which is the depth-first order of their trie, and each word's lattice goes on from the forward states of the
prefix that it shares with the word before.

A forward state is the last piece of the best segmentation of a prefix. The public model at hand is of the merging kind: its scores rank
merges and do not add up along a path, so a plain sum-of-scores Viterbi would not give the model's ids. But a segmentation is the one that
merging gives exactly if merging each two neighbours' characters gives these two pieces again. So a step of the lattice is open if it
passes that test, one path is open to each position, and the forward state is as shareable as a score. The tests hold the ids against the
library.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Characters of text that are encoded together, words kept from earlier blocks, and pairs of pieces whose test is kept.
BLOCK_CHARS, MEMO_WORDS, MEMO_PAIRS = 4_000_000, 250_000, 1_000_000
RESULT = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean"


class PieceCodec:
    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = model.get_piece_size()
        plain = [i for i in range(size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.spelling = [b""] * size
        for piece, i in self.ids.items():
            self.spelling[i] = piece.replace(MARK, " ").encode()
        for b, i in enumerate(self.byte_ids):
            self.spelling[i] = bytes([b])
        self._is_byte = np.zeros(size, bool)
        self._is_byte[self.byte_ids] = True
        endings: dict[str, set[int]] = {}
        for piece in self.ids:
            if len(piece) > 1:
                endings.setdefault(piece[-2:], set()).add(len(piece))
        self._lengths = {two: tuple(sorted(n)) for two, n in endings.items()}
        self._open: dict[tuple[str, str], bool] = {}
        self._edges: dict[tuple[str, bool], list | None] = {}
        self._words: dict[str, bytes] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces by merging: the neighbours whose union has the best score are joined, the leftmost first, as long as there are any."""
        parts = list(text)
        while len(parts) > 1:
            scores = [self.scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -np.inf:
                break
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _edge(self, piece: str, right: bool) -> list[tuple[str, float]] | None:
        """The outermost part of piece on one side after each merge that changes it, with that merge's score; None if merging does not give piece."""
        key = (piece, right)
        if key not in self._edges:
            parts, out = list(piece), [(piece[-1 if right else 0], np.inf)]
            while len(parts) > 1:
                scores = [self.scores.get(a + b, -np.inf) for a, b in zip(parts, parts[1:])]
                best = max(scores)
                if best == -np.inf:
                    break
                at = scores.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if out[-1][0] != parts[-1 if right else 0]:
                    out.append((parts[-1 if right else 0], best))
            self._edges[key] = out if len(parts) == 1 else None
        return self._edges[key]

    def _step_open(self, a: str, b: str) -> bool:
        """Whether merging a + b gives a and b: no merge across their border comes before the merges that build them."""
        left, right = self._edge(a, True), self._edge(b, False)
        if left is None or right is None:
            return False
        i = j = 0
        while True:
            across = self.scores.get(left[i][0] + right[j][0], -np.inf)
            next_left = left[i + 1][1] if i + 1 < len(left) else -np.inf
            next_right = right[j + 1][1] if j + 1 < len(right) else -np.inf
            following = max(next_left, next_right)
            if across == following != -np.inf:
                return self.merge(a + b) == [a, b]  # which of two equal scores comes first depends on their places
            if across > following:
                return False
            if following == -np.inf:
                return True
            if next_left >= next_right:
                i += 1
            else:
                j += 1

    def _ids_of(self, pieces: list[str]) -> bytes:
        out = array("H")
        for p in pieces:
            i = self.ids.get(p)
            if i is None:
                out.extend(self.byte_ids[b] for b in p.encode())
            else:
                out.append(i)
        return out.tobytes()

    def learn(self, words: list[str]) -> None:
        """Encodes distinct words in sorted order, with the forward states of shared prefixes."""
        ids, lengths, opened = self.ids, self._lengths, self._open
        if len(opened) > MEMO_PAIRS:
            opened.clear()
        last: list[str] = [""]  # last[i]: the last piece of the first i characters
        before = ""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                found = word[end - 1]
                for n in lengths.get(word[end - 2 : end], ()) if end > 1 else ():
                    if n > end:
                        break
                    piece = word[end - n : end]
                    if piece in ids:
                        pair = (last[end - n], piece)
                        is_open = opened.get(pair)
                        if is_open is None:
                            is_open = opened[pair] = self._step_open(*pair) if n < end else self._edge(piece, True) is not None
                        if is_open:
                            found = piece
                            break
                last.append(found)
            before, pieces, end = word, [], len(word)
            while end:
                pieces.append(last[end])
                end -= len(last[end])
            self._words[word] = self._ids_of(pieces[::-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as unsigned 16-bit numbers."""
        if len(self._words) > MEMO_WORDS:
            self._words.clear()
        cut = [self.words(t) for t in texts]
        new = set().union(*cut).difference(self._words)
        self.learn(list(new))
        known = self._words
        return [np.frombuffer(b"".join([known[w] for w in words]), np.uint16) for words in cut]

    @staticmethod
    def words(text: str) -> list[str]:
        """The marked words of a text."""
        if not text:
            return []
        cut = (MARK + text.replace(" ", MARK)).split(MARK)[1:]
        words, marks = [], MARK
        for w in cut[:-1]:
            if w:
                words.append(marks + w)
                marks = MARK
            else:
                marks += MARK
        words.append(marks + cut[-1])
        return words

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the mark that encoding puts in front."""
        spelling = self.spelling
        text = b"".join([spelling[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text

    def byte_tokens(self, ids: np.ndarray) -> int:
        return int(self._is_byte[ids].sum())


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """One row per document: doc_id and ids (array of int)."""
    return _over_blocks(docs, id_col, text_col, model_file, "doc_id long, ids array<int>", lambda codec, text, ids: (ids.tolist(),))


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_byte_tokens, ids_crc32 (unsigned little-endian 32-bit ids), decoded_sha256, exact.

    exact: decoding the ids gives the text again. Only texts that hold the word mark U+2581 itself, which decodes to a space, differ.
    Null or empty text: no ids, decoded as empty. Ids may be null and repeat; texts of any length are encoded whole. Other columns are not
    read. Nothing is shuffled; a task holds about BLOCK_CHARS characters (or one longer text) and bounded memos. An empty table gives an
    empty result.
    """
    import hashlib

    def digest(codec: PieceCodec, text: str, ids: np.ndarray) -> tuple:
        back = codec.decode(ids)
        return len(ids), codec.byte_tokens(ids), zlib.crc32(ids.astype("<u4").tobytes()), hashlib.sha256(back.encode()).hexdigest(), back == text

    return _over_blocks(docs, id_col, text_col, model_file, RESULT, digest)


def _over_blocks(docs: DataFrame, id_col: str, text_col: str, model_file: str | None, schema: str, row) -> DataFrame:
    from convlake.llm.tokens import vocabulary

    model_file = model_file or vocabulary("piece_bpe_32k.model")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        codec, names = PieceCodec(model_file), [f.split()[0] for f in schema.split(", ")]
        keys, texts, held = [], [], 0

        def flush() -> pd.DataFrame:
            rows = [(key, *row(codec, text, ids)) for key, text, ids in zip(keys, texts, codec.encode(texts))]
            return pd.DataFrame({n: pd.array(c, "Int64") if n == "doc_id" else c for n, c in zip(names, map(list, zip(*rows)))})

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"]):
                keys.append(None if key is None or key != key else int(key))
                texts.append(text or "")
                held += len(texts[-1])
                if held >= BLOCK_CHARS:
                    yield flush()
                    keys, texts, held = [], [], 0
        if texts:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(run, schema)
