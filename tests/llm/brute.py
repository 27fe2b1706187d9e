"""Plain Python statements of what the operators return, for small tables."""

from __future__ import annotations

import hashlib
import re

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def lower_ascii(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def smallest_reachable(ids, links) -> dict:
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def shingle_set(text: str | None, words: int) -> set:
    w = [x for x in SPACES.split(lower_ascii(text or "")) if x]
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def jaccard_components(rows: list[tuple[int, str | None]], words: int, percent: int) -> dict:
    sets = {i: shingle_set(t, words) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and min(len(sets[a]), len(sets[b])) * 100 >= percent * max(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = smallest_reachable(ids, links)
    return {i: (len(sets[i]), found[i]) for i in ids}


def line_dedup(rows: list[tuple[int, str | None]], min_chars: int = 40, min_docs: int = 5) -> dict:
    key = lambda line: lower_ascii(line).strip(" \t\n\x0b\x0c\r")
    held: dict = {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held.setdefault(k, set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and i < max(held[key(x)]))]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def exact_groups(rows: list[tuple[int, str | None]]) -> dict:
    norm = {i: SPACES.sub(" ", t or "") for i, t in rows}
    groups: dict = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), min(groups[t]) == i, hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}
