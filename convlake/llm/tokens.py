"""Token ids of whole texts by a public byte-level BPE vocabulary, for use inside tasks.

The vocabulary's pattern needs a look-ahead only where two white-space characters meet. Texts without such a place, nearly all, are cut by
the same pattern without the look-ahead, which runs twice as fast; others by the full pattern. Texts that hold an added token of the
vocabulary, and those with a run of white space so long that the look-ahead would overflow its stack, are encoded by `tokenizers`, from the
same vocabulary. The tests hold the ids against `tokenizers` on whole texts.
"""

from __future__ import annotations

import base64
import json
import re

import numpy as np

_SPACES = re.compile(r"\s\s")
_LONG_RUN = re.compile(r"\s{4096}")
_LOOK_AHEAD = r"|\s+(?!\S)"


class BpeEncoder:
    """ranks_file: the vocabulary as ranks; long_file: the same for `tokenizers`, with the added tokens."""

    def __init__(self, ranks_file: str, long_file: str | None = None):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        pattern = public_tokenizers.PATTERN
        self._full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._plain = tiktoken.Encoding("plain", pat_str=pattern.replace(_LOOK_AHEAD, ""), mergeable_ranks=ranks, special_tokens={})
        self._long_file, self._long = long_file or f"{ranks_file.removesuffix('.tiktoken')}.json", None
        with open(self._long_file, encoding="utf-8") as f:
            self._added = tuple(token["content"] for token in json.load(f)["added_tokens"])

    def _encode_long(self, text: str) -> list[int]:
        from tokenizers import Tokenizer

        if self._long is None:
            self._long = Tokenizer.from_file(self._long_file)
        return self._long.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of text as unsigned 16-bit numbers; an added token's string in a text is that token."""
        if any(token in text for token in self._added):
            return np.array(self._encode_long(text), np.uint16)
        if not _SPACES.search(text):
            return np.array(self._plain.encode_ordinary(text), np.uint16)
        if _LONG_RUN.search(text):
            return np.array(self._encode_long(text), np.uint16)
        return np.array(self._full.encode_ordinary(text), np.uint16)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
