"""Main text of web pages by tag-path ratios.

Each text node belongs to the path of tags from the root to it.  Per path the text lengths and the punctuation marks are added up and divided by
the number of its nodes; both ratios are smoothed along the page, fused by multiplication, averaged back per path, and paths from the threshold
on (the standard deviation of the fused ratios, at most their mean) are *content*.  The smallest container that holds all of the content
text, widened to its article, is the root of the main text; a quote, list, table or ``details`` is never the root; all of its blocks are given out but those of menus, headers, footers, sidebars,
notices, adverts, forms, comments and what is not text.  A name, role or form marks an element as boilerplate only if it does not wrap the page:
an element that holds most of the text of all articles, or, on a page without article, ``WRAPS`` of the content text, is none.

A page is worked on by itself, in one pass and in memory linear in its length; pages are streamed through Arrow in small batches.

Defined results: a null, empty or tag-less page gives its text, if any, as one block; broken markup never fails: unclosed elements end with
their container, stray end tags are ignored; repeated rows are answered twice; a null id or url stays null; other columns are not looked at.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape
from math import exp

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The functions of this module travel with the task, so workers need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROWS = 64
SMOOTH = 2
WRAPS = 0.8
MARK = re.compile(r"<!--|<[!?]|<(/?)([a-zA-Z][^\s/>]*+)", re.S)
#: What may end a tag, or hide its end.
EDGE = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([a-zA-Z_:@][\w:.@-]*)\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++)|(hidden)(?=[\s/>])", re.S)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？·]")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
NAME = re.compile(r"[A-Za-z0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no markup; none of it is text of the page.
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes svg math object canvas audio video".split())
RAW_END = {tag: re.compile(f"</{tag}", re.I) for tag in RAW}
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption colgroup option select legend".split()
)
#: An opening tag ends these elements where they are open in the same container.
CLOSES = {t: {"p"} for t in BLOCK} | {
    "li": {"p", "li"}, "dt": {"p", "dt", "dd"}, "dd": {"p", "dt", "dd"}, "tr": {"p", "tr", "td", "th"}, "td": {"p", "td", "th"}, "th": {"p", "td", "th"},
    "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"},
}
CONTAINER = frozenset("html body article main section div center".split())
NOISE_TAGS = frozenset("head nav header footer aside form button select fieldset menu dialog search label input datalist output meter progress".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner banners sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar "
    "navigation breadcrumb breadcrumbs header masthead footer comment comments disqus respond reply replies notice notices alert cookie cookies consent gdpr "
    "newsletter subscribe subscription signup login share sharing social related recommended popup modal overlay toolbar pagination pager widget widgets "
    "copyright skip".split()
)
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar toolbar form".split())
#: Tags that also wrap whole pages; ``hidden`` and the other noise tags are always boilerplate.
WRAPPERS = frozenset("form fieldset".split())
KEPT = frozenset("html body article main".split())


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        if m[3]:
            out.setdefault("hidden", "")
        else:
            out.setdefault(m[1].lower(), m[2].strip("\"'"))
    return out


def _always_noise(tag: str, attrs: dict[str, str]) -> bool:
    if tag in NOISE_TAGS and tag not in WRAPPERS:
        return True
    if not attrs or tag in KEPT:
        return False
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def _is_marked(tag: str, attrs: dict[str, str]) -> bool:
    """Boilerplate unless it wraps the page."""
    if tag in WRAPPERS:
        return True
    if not attrs or tag in KEPT:
        return False
    if attrs.get("role", "").lower() in NOISE_ROLES:
        return True
    named = f"{attrs.get('class', '')} {attrs.get('id', '')}"
    return named != " " and any(w.lower() in NOISE_WORDS for w in NAME.findall(named) + WORD.findall(named))


def _tag_end(html: str, at: int) -> int:
    """Where a tag ends whose name ends at ``at``: behind the first ">" outside quotes of any length, or the first at all if a quote stays open."""
    i = at
    while (edge := EDGE.search(html, i)) is not None:
        if edge[0] == ">":
            return edge.end()
        close = html.find(edge[0], edge.end())
        if close < 0:
            break
        i = close + 1
    stop = html.find(">", at)
    return len(html) if stop < 0 else stop + 1


class _Page:
    """Elements (tag, parent, noise, mark) and text nodes (element, path, block, raw text) of a page."""

    def __init__(self, html: str):
        self.tags, self.parents, self.noise, self.marked, self.paths = ["#root"], [-1], [False], [False], [0]
        self.path_ids: dict[tuple[int, str], int] = {}
        self.nodes: list[tuple[int, int, str]] = []  # element, block, raw text
        self.block = 0
        self._stack, self._open = [0], {}
        self._read(html)

    def _text(self, raw: str) -> None:
        if raw and not self.noise[self._stack[-1]]:
            self.nodes.append((self._stack[-1], self.block, raw))

    def _push(self, tag: str, noise: bool, marked: bool) -> None:
        top = self._stack[-1]
        self.tags.append(tag)
        self.parents.append(top)
        self.noise.append(noise or self.noise[top])
        self.marked.append(marked)
        self.paths.append(self.path_ids.setdefault((self.paths[top], tag), len(self.path_ids) + 1))
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _pop_to(self, depth: int) -> None:
        while len(self._stack) > depth:
            self._open[self.tags[self._stack.pop()]] -= 1

    def _close_for(self, tag: str) -> None:
        ends = CLOSES.get(tag)
        while ends and any(self._open.get(t) for t in ends):
            for depth in range(len(self._stack) - 1, 0, -1):
                name = self.tags[self._stack[depth]]
                if name in ends:
                    self._pop_to(depth)
                    break
                if name in BLOCK:
                    return
            else:
                return

    def _close(self, tag: str) -> None:
        if not self._open.get(tag):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            name = self.tags[self._stack[depth]]
            if name == tag:
                self._pop_to(depth)
                return
            if tag not in BLOCK and name in BLOCK:
                return

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = MARK.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            self._text(html[at:m.start()])
            at = m.end()
            if m[2] is None:
                end = "-->" if m[0] == "<!--" else ">"
                stop = html.find(end, at)
                at = n if stop < 0 else stop + len(end)
                continue
            tag = m[2].lower()
            at = _tag_end(html, m.end())
            rest = html[m.end():at]
            if tag in BLOCK:
                self.block += 1
            if m[1]:
                self._close(tag)
            elif tag in RAW:
                if not rest.endswith("/>") or tag not in ("svg", "math"):
                    stop = RAW_END[tag].search(html, at)
                    at = n if stop is None else stop.start()
            elif tag in VOID:
                self._text(" ")
            else:
                self._close_for(tag)
                attrs = _attributes(rest) if len(rest) > 2 else {}
                self._push(tag, _always_noise(tag, attrs), _is_marked(tag, attrs))


def path_scores(paths: list[int], lengths: list[int], marks: list[int]) -> dict[int, float]:
    """Fused ratio of each path: aggregated, smoothed along the page, multiplied, averaged back."""
    count: dict[int, int] = {}
    chars: dict[int, int] = {}
    points: dict[int, int] = {}
    for p, c, m in zip(paths, lengths, marks):
        count[p] = count.get(p, 0) + 1
        chars[p] = chars.get(p, 0) + c
        points[p] = points.get(p, 0) + m
    weights = [exp(-(k * k) / 2) for k in range(SMOOTH + 1)]

    def smoothed(values: list[float]) -> list[float]:
        out = []
        for i in range(len(values)):
            total = norm = 0.0
            for k in range(max(0, i - SMOOTH), min(len(values), i + SMOOTH + 1)):
                w = weights[abs(k - i)]
                total += w * values[k]
                norm += w
            out.append(total / norm)
        return out

    length = smoothed([chars[p] / count[p] for p in paths])
    point = smoothed([points[p] / count[p] for p in paths])
    score = dict.fromkeys(count, 0.0)
    for p, a, b in zip(paths, length, point):
        score[p] += a * (1 + b)
    return {p: s / count[p] for p, s in score.items()}


def content_paths(scores: dict[int, float]) -> set[int]:
    values = list(scores.values())
    mean = sum(values) / len(values)
    spread = (sum((v - mean) ** 2 for v in values) / len(values)) ** 0.5
    return {p for p, s in scores.items() if s >= min(mean, spread)}


def _content_weight(page: _Page, seen: list[tuple[int, str, int]]) -> list[int]:
    """Length of the content text in each element, by the paths of the text nodes ``seen``."""
    paths = [page.paths[e] for e, _, _ in seen]
    content = content_paths(path_scores(paths, [s for *_, s in seen], [len(PUNCTUATION.findall(raw)) for _, raw, _ in seen]))
    weight = [0] * len(page.tags)
    for (e, _, size), p in zip(seen, paths):
        if p in content:
            weight[e] += size
    return _with_children(page, weight)


def _with_children(page: _Page, weight: list[int]) -> list[int]:
    for e in range(len(weight) - 1, 0, -1):  # children come after their parents
        weight[page.parents[e]] += weight[e]
    return weight


def _boilerplate(page: _Page, seen: list[tuple[int, str, int]]) -> list[bool]:
    """Per element whether it is in a marked one that does not wrap the page."""
    out = [False] * len(page.tags)
    if not any(page.marked):
        return out
    within = [False] * len(page.tags)  # in an article or main
    for e in range(1, len(page.tags)):
        within[e] = page.tags[e] in ("article", "main") or within[page.parents[e]]
    weight = [0] * len(page.tags)
    for e, _, size in seen:
        if within[e]:
            weight[e] += size
    weight = _with_children(page, weight)
    share = 0.5
    if not weight[0]:
        weight, share = _content_weight(page, seen), WRAPS
    for e in range(1, len(page.tags)):
        wraps = not within[e] and weight[e] > 0 and weight[e] >= share * weight[0]
        out[e] = out[page.parents[e]] or (page.marked[e] and not wraps)
    return out


def main_blocks(html: str | None) -> list[str]:
    """Blocks of the main text, in page order."""
    page = _Page(html or "")
    nodes = [(e, b, raw, len(raw.strip())) for e, b, raw in page.nodes]
    out_of_it = _boilerplate(page, [(e, raw, size) for e, _, raw, size in nodes if size])
    nodes = [n for n in nodes if not out_of_it[n[0]]]
    seen = [(e, raw, size) for e, _, raw, size in nodes if size]
    if not seen:
        return []
    weight = _content_weight(page, seen)
    root = max((e for e in range(len(weight)) if weight[e] == weight[0] and (e == 0 or page.tags[e] in CONTAINER)))
    up = root
    while up > 0:
        if page.tags[up] in ("article", "main"):
            root = up
            break
        up = page.parents[up]
    inside = [False] * len(page.tags)
    for e in range(root, len(page.tags)):
        inside[e] = e == root or (page.parents[e] >= root and inside[page.parents[e]])
    out: list[str] = []
    last, parts = -1, []
    for e, block, raw, _ in [*((n for n in nodes if inside[n[0]])), (0, -2, "", 0)]:
        if block != last:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(text)
            last, parts = block, []
        parts.append(raw)
    return out


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id, its url and ``text``, the blocks of its main text joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = ["\n".join(main_blocks(html.as_py())) for html in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = rows.mapInArrow(run, f"id {kinds[id_col]}, url {kinds[url_col]}, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})


def report(pages: DataFrame) -> DataFrame:
    return extract(pages).withColumn("n_chars", F.length("text").cast("long"))
