"""Main text of web pages by tag-path ratios.

A page becomes blocks of text, each with the path of tags from the root to it. Text length and punctuation are summed for each path and
divided by its blocks, smoothed along the page and multiplied; blocks whose score reaches a threshold are content. What else belongs to the
article (headings, short items) is found by the element that holds most of the content, and by others of the same tag path.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_END_OR_QUOTE = re.compile("[>\"']")
_NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_MAY_HIDE = re.compile(r"hidden|none", re.I)
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
_PUNCTUATION = re.compile(r"[.,;:!?…。、，；：！？«»“”„\"()-]")

# Kinds of elements, and the words in class, id and role that mark what is not the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = frozenset("nav header footer aside button select option fieldset dialog menu object audio video canvas head".split()) | RAW
NOT_ARTICLE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar "
    "footer bottombar copyright colophon sidebar aside complementary widget widgets rail cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login "
    "form search comment comments reply replies respond disqus discussion share sharing social related recommended pagination pager toolbar tags contentinfo".split()
)
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
MODIFIERS = frozenset("no not non without with has have is hide show".split())
OF_ARTICLE = frozenset("article post entry story content".split())
ARTICLE = frozenset("article main articlebody article-body post-content entry-content story-body".split())
CLOSED_BY = {t: frozenset(s.split()) for t, s in {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option", "thead": "tr td th", "tbody": "thead tr td th", "body": "head"}.items()}
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul tr td th".split())
SCOPE = frozenset("html body article main section div table ul ol dl td th blockquote form nav aside header footer".split())
LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead caption figcaption figure address".split())
#: Elements that can be a list of links, those inside one, and those whose lists are kept.
LISTS, OF_LISTS, KEPT = frozenset("ul ol dl menu div".split()), frozenset("ul ol dl menu div li dt dd".split()), frozenset("td th caption figcaption blockquote".split())
#: Standard deviation of the smoothing, in blocks; the part of the content's scores that the article's element holds; and how many times
#: more a score counts inside an element that is named as an article.
SMOOTH, HOLDS, PRIOR = 1.0, 0.75, 4.0


def _marks(attributes: str) -> set[str]:
    """The words of class, id and role, and the parts of each; what follows a word like `no` or `with` says what a page has beside the element."""
    words = set()
    for m in _NAMES.finditer(attributes):
        for value in (m[1] or m[2] or m[3] or "").lower().split():
            words.add(value)
            for w in re.split(r"[_-]+", value):
                if w in MODIFIERS:
                    break
                words.add(w)
    return words - {""}


def _hidden(attributes: str) -> bool:
    for m in _ATTRIBUTE.finditer(attributes) if _MAY_HIDE.search(attributes) else ():
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.strip().lower() == "true") or (name == "style" and _NO_DISPLAY.search(value)):
            return True
    return False


def _left_out(name: str, attributes: str, above: int, in_article: bool) -> bool:
    """Whether an element is left out by its kind."""
    return bool(above) or (name in LEFT_OUT and not (name == "header" and in_article)) or _hidden(attributes)


def _doubt(name: str, marks: set[str], in_article: bool) -> int:
    """2: an element's words are those of readers' comments, 1: of something else beside an article, 0: of neither."""
    if marks & COMMENTS:
        return 2
    words = marks & NOT_ARTICLE
    if in_article or marks & OF_ARTICLE:
        words -= {"header"}
    return int(bool(words) and name not in ("html", "body", "article", "main"))


class _Tree:
    """Elements in page order, so that a parent comes before its children. Element 0 is the page."""

    def __init__(self):
        self.parent, self.name, self.path, self.named, self.article, self.form, self.out, self.doubt = [0], [""], [0], [False], [False], [0], [False], [0]
        self._paths: dict[tuple[int, str], int] = {}

    def add(self, parent: int, name: str, named: bool, out: bool, doubt: int) -> int:
        at = len(self.parent)
        self.parent.append(parent)
        self.name.append(name)
        self.path.append(self._paths.setdefault((self.path[parent], name), len(self._paths) + 1))
        self.named.append(named and not out)
        self.article.append(named or self.article[parent])
        self.form.append(self.form[parent] or (at if name == "form" else 0))
        self.out.append(out)
        self.doubt.append(doubt)
        return at

    def sums(self, blocks: list[_Block], values: np.ndarray) -> np.ndarray:
        """For each element the sum of the values of the blocks in it."""
        total = np.zeros(len(self.parent))
        np.add.at(total, [x.element for x in blocks], values)
        total = total.tolist()
        for e in range(len(total) - 1, 0, -1):
            total[self.parent[e]] += total[e]
        return np.array(total)

    def inside(self, roots: set[int]) -> list[bool]:
        """For each element whether it is one of the roots or below one."""
        held = [0 in roots]
        for e in range(1, len(self.parent)):
            held.append(e in roots or held[self.parent[e]])
        return held


class _Block:
    """Text without an element of block level in it: its pieces, characters outside and inside of links, links, punctuation outside links."""

    def __init__(self, element: int):
        self.element, self.pieces, self.plain, self.linked, self.links, self.marks = element, [], 0, 0, 0, 0

    def add(self, raw: str, link: bool) -> None:
        text = html.unescape(raw)
        self.pieces.append(text)
        if n := len(text.strip()):
            self.linked += n * link
            self.links += link
            self.plain += n * (not link)
            self.marks += 0 if link else len(_PUNCTUATION.findall(text))

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


def _tag_end(page: str, at: int, absent: set[str]) -> int:
    """Where the tag ends whose attributes begin at `at`: behind the next > outside of quotes. A quote without end is a plain character."""
    while m := _END_OR_QUOTE.search(page, at):
        if m[0] == ">":
            return m.end()
        close = -1 if m[0] in absent else page.find(m[0], m.end())
        if close < 0:
            absent.add(m[0])
        at = m.end() if close < 0 else close + 1
    return len(page)


def text_blocks(page: str) -> tuple[list[_Block], _Tree]:
    """The blocks of text outside elements that by their kind cannot be the article, and the page's elements.

    Elements of text level belong to no path. A block ends at every tag of another kind; <br> is white space. Each character is passed once,
    whatever the tags' depth is and whether they are closed.
    """
    tree, blocks, absent = _Tree(), [], set()
    stack, opened = [0], {}  # open elements, and how many there are of a name
    block, at, link = _Block(0), 0, False

    def pop(depth: int) -> None:
        for e in stack[depth:]:
            opened[tree.name[e]] -= 1
        del stack[depth:]

    def begin() -> None:
        nonlocal block
        if block.pieces:
            blocks.append(block)
        block = _Block(stack[-1])

    def text(raw: str) -> None:
        if raw and not tree.out[stack[-1]]:
            block.add(raw, link)

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        m = _TAG.match(page, start)
        if not m:
            special = page.startswith(("<!", "<?"), start)
            text(page[at : start + (not special)])
            if special:
                close = "-->" if page.startswith("<!--", start) else ">"
                end = page.find(close, start + 2)
                at = len(page) if end < 0 else end + len(close)
            else:
                at = start + 1
            continue
        text(page[at:start])
        at = _tag_end(page, m.end(), absent)
        name, attributes = m[2].lower(), page[m.end() : at].removesuffix(">")
        if name == "br":
            text("\n")
        elif name == "a":
            link = not m[1]
        if name in INLINE:
            continue
        if m[1]:
            if opened.get(name):
                depth = len(stack) - 1
                while tree.name[stack[depth]] != name and not (name == "p" and tree.name[stack[depth]] in SCOPE):
                    depth -= 1
                if tree.name[stack[depth]] == name:
                    pop(depth)
                    link = False
        elif name not in VOID:
            closed = CLOSED_BY.get(name, frozenset()) | ({"p"} if name in CLOSES_P else set())
            depth = len(stack) - 1
            while depth and any(opened.get(c) for c in closed):
                here = tree.name[stack[depth]]
                if here in closed:
                    pop(depth)
                elif here in SCOPE:
                    break
                depth -= 1
            marks = _marks(attributes) if attributes else set()
            named, above = name in ("article", "main") or bool(marks & ARTICLE), stack[-1]
            element = tree.add(above, name, named, _left_out(name, attributes, tree.out[above], tree.article[above]), _doubt(name, marks, tree.article[above]))
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}[\\s/>]", re.I).search(page, at)
                at = end.start() if end else len(page)
            if not attributes.endswith("/") or name in RAW:
                stack.append(element)
                opened[name] = opened.get(name, 0) + 1
        begin()
    begin()
    return [x for x in blocks if x.plain or x.linked], tree


def path_scores(blocks: list[_Block], tree: _Tree) -> np.ndarray:
    """For each block the score of its tag path: characters and punctuation marks outside of links for each block of the path, smoothed along
    the page, fused, and averaged over the path's blocks, so that a block beside the article does not pass for one of it."""
    path = np.unique([tree.path[x.element] for x in blocks], return_inverse=True)[1]
    count = np.bincount(path)
    length = (np.bincount(path, [x.plain for x in blocks]) / count)[path]
    marks = (np.bincount(path, [x.marks for x in blocks]) / count)[path]
    reach = np.arange(-3, 4)
    kernel = np.exp(-(reach**2) / (2 * SMOOTH**2))
    smooth = lambda x: np.convolve(np.pad(x, 3, mode="edge"), kernel / kernel.sum(), "valid")
    fused = smooth(length) * np.log1p(smooth(marks) + 1)
    return (np.bincount(path, fused) / count)[path]


def threshold(blocks: list[_Block], scores: np.ndarray) -> float:
    """Half of the score that the page's middle character has when all characters outside of links are ordered by their paths' scores."""
    order = np.argsort(scores, kind="stable")
    plain = np.cumsum([blocks[i].plain for i in order])
    return float(scores[order[np.searchsorted(plain, plain[-1] / 2)]]) / 2


def dropped_by_words(blocks: list[_Block], tree: _Tree) -> list[bool]:
    """For each element whether its words, or those of one above it, leave it out: words that mark something else do so if the element holds
    less than half of the page's scores, or if outside of it an element is named as an article that has at least a quarter of its text.
    Readers' comments are left out beside any such element, and in one that has at least a quarter of their text besides. An article inside
    an element that is no comment stays."""
    scores = path_scores(blocks, tree)
    mass = tree.sums(blocks, scores if scores.any() else np.array([len(x.text) for x in blocks]))
    size = tree.sums(blocks, np.array([x.plain + x.linked for x in blocks]))
    n = len(tree.parent)
    holder, comments = [0] * n, [False] * n  # the outermost element named as an article outside of comments
    for e in range(1, n):
        comments[e] = comments[tree.parent[e]] or tree.doubt[e] == 2
        holder[e] = holder[tree.parent[e]] or (e if tree.named[e] and not comments[e] else 0)
    told = [size[e] if e and holder[e] == e else 0.0 for e in range(n)]
    for e in range(n - 1, 0, -1):
        told[tree.parent[e]] += told[e]
    state = [0] * n
    for e in range(1, n):
        above, doubt = state[tree.parent[e]], tree.doubt[e]
        if above == 2 or (above and tree.name[e] not in ("article", "main")):
            state[e] = above
        elif doubt:
            beside = size[holder[e]] - size[e] if holder[e] else told[0] - told[e]
            enough = 4 * beside >= size[e] if holder[e] or doubt == 1 else beside > 0
            if 2 * mass[e] < mass[0] or (beside and enough and (doubt == 2 or not holder[e])):
                state[e] = doubt
    return [bool(s) for s in state]


def _roots(blocks: list[_Block], chosen: np.ndarray, scores: np.ndarray, tree: _Tree) -> set[int]:
    """The deepest element that holds most of the content's scores, or the element named as an article round it, and other elements of the
    same tag path or named as articles of whose text at least half is content."""
    size = np.array([len(x.text) for x in blocks])
    mass = tree.sums(blocks, np.where(chosen, scores if scores.any() else size, 0))
    whole, picked = tree.sums(blocks, size), tree.sums(blocks, size * chosen)
    root = int(np.flatnonzero(mass >= HOLDS * mass[0]).max(initial=0))  # a later element is never above an earlier one
    holder = root
    while holder and not tree.named[holder]:
        holder = tree.parent[holder]
    while not holder and tree.name[root] in LEAVES:
        root = tree.parent[root]
    root = holder or root
    above, e = {root, 0}, root
    while e:
        e = tree.parent[e]
        above.add(e)
    roots = {root}
    for e in range(1, len(tree.parent)):
        if e not in above and (tree.named[e] or tree.path[e] == tree.path[root]) and picked[e] and 2 * picked[e] >= whole[e]:
            roots.add(e)
    return roots


def _linked_lists(blocks: list[_Block], first: int, last: int, root: int, tree: _Tree) -> list[bool]:
    """For each element whether it is in one below the root that is nothing but lists of several links before the first content or after
    the last."""
    sums = [tree.sums(blocks, np.array(v)).tolist() for v in ([x.plain for x in blocks], [x.linked for x in blocks], [x.links for x in blocks], [first <= i <= last for i in range(len(blocks))])]
    inside, kept, mixed = tree.inside({root}), [False], [False] * len(tree.parent)
    for e in range(1, len(tree.parent)):
        kept.append(inside[e] and e != root and (kept[tree.parent[e]] or tree.name[e] in KEPT))
    for e in range(len(tree.parent) - 1, 0, -1):
        if sums[0][e] + sums[1][e] and (mixed[e] or tree.name[e] not in OF_LISTS):
            mixed[tree.parent[e]] = True
    lists = {
        e for e in range(1, len(tree.parent))
        if inside[e] and e != root and tree.name[e] in LISTS and not (mixed[e] or kept[e] or sums[3][e]) and sums[2][e] > 1 and sums[1][e] > 4 * sums[0][e]
    }
    return tree.inside(lists)


def main_text(page: str | None) -> str:
    """The blocks of the article, white space inside each made one space, joined by an empty line."""
    blocks, tree = text_blocks(page or "")
    if any(tree.doubt) and blocks:
        gone = dropped_by_words(blocks, tree)
        blocks = [x for x in blocks if not gone[x.element]] or blocks
    if any(tree.form):  # a form is left out unless it is wrapped round most of the page
        size = np.array([x.plain + x.linked for x in blocks])
        held, total = tree.sums(blocks, size), size.sum()
        blocks = [x for x in blocks if 2 * held[tree.form[x.element]] >= total or not tree.form[x.element]]
    if not blocks:
        return ""
    scores = path_scores(blocks, tree) * np.where([tree.article[x.element] for x in blocks], PRIOR, 1.0)
    chosen = scores >= threshold(blocks, scores)
    roots = _roots(blocks, chosen, scores, tree)
    inside, root = tree.inside(roots), min(roots)
    content = [i for i, x in enumerate(blocks) if chosen[i] and x.plain and inside[x.element]]
    named, told = tree.inside({e for e in roots if tree.article[e]}), any(tree.named[e] for e in roots)
    dropped = _linked_lists(blocks, content[0], content[-1], root, tree) if content else [False] * len(tree.parent)
    kept = [x for i, x in enumerate(blocks) if (inside[x.element] and (named[x.element] or not dropped[x.element])) or (chosen[i] and x.plain and not told)]
    return "\n\n".join(x.text for x in kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text (empty if there is none), n_chars (its code points).

    Left out are elements that are no article by their kind (navigation, headers outside the article, footers, sidebars, scripts, styles,
    controls, forms that hold less than half of the text), and elements with a word in their class, id or role that says so, if they hold less
    than half of the page's scores, too (readers' comments also beyond that, where an article is named outside of them). Of what is left, text
    length and punctuation are summed for each root-to-leaf tag path, divided by the path's blocks, smoothed along the page, multiplied, averaged,
    counted more inside elements named as articles (a prior, no rule), and cut at half of what the page's middle character has. Returned are the
    blocks chosen so, and all others, however short and linked, of the deepest element that holds most of their scores (of that named as an
    article round it, if there is one; then no block outside is returned) and of elements of the same tag path or named as articles that are mostly
    chosen. In an element not named as an article, lists of nothing but links before the first or after the last chosen block are left out.

    Null or empty pages give an empty text, ids and urls may be null and repeat, and pages of any length are read whole. Other columns are
    not read. Each page is worked on by itself, so nothing is shuffled.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
