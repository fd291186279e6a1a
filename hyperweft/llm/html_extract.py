"""Operator 5: main text of pages by wrappers: union-free regular expressions, inferred for each host from its pages."""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import written

#: Elements whose content is no text, that hold no article text, that make blocks, that may hold a whole article,
#: that are a page's layout and no part of a text, and that end with a sibling.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "math", "object", "textarea", "title", "select", "canvas", "audio", "video"}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "fieldset", "label", "head"}
BLOCKS = {
    *("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option".split()),
    *("p pre section summary table tbody td tfoot th thead tr ul".split()),
}
BOXES = {"div", "section", "ul", "ol", "li", "table", "td", "center", "details", "dl"}
LAYOUT = {"div", "section", "center", "details"}
VOID = {"hr"}
CLOSED_BY_BLOCK = {"p"}
CLOSED_BY_SAME = {"li", "dd", "dt", "td", "th", "tr", "option"}
#: Whole values of class, id and role, or their last parts, that hint at what is not the article.
HINTS = {
    *("ad ads advert adverts advertisement adsense sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead comment comments commentlist replies disqus".split()),
    *("cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe signup login share sharing related recommended widget widgets toolbar search searchform copyright".split()),
    *("legal disclaimer pagination pager complementary contentinfo dialog".split()),
}
#: First parts that say that something is about an aside, or lacks it, and is none.
NO_HINT = {"no", "has", "with", "without", "hide", "hidden", "is"}
#: Elements that no hint makes an aside.
NEVER_ASIDE = {"html", "body", "main", "article"}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Hosts whose wrappers, and lines whose counts, a task holds; groups of tasks whose wrappers are merged first.
HELD_HOSTS, HELD_LINES = 2000, 200_000
SALTS = 64
#: A line is constant if it is on this share of its host's pages, and the host has so many.
CONSTANT, LEAST_PAGES = 0.5, 4
#: Share of all text that the article's block holds where a host has one page and there is nothing to compare.
MOST_TEXT = 2 / 3


class Element(NamedTuple):
    """An open element: its path's hash, that of its parent's path, its key among siblings, tag, whether its attributes hint at an aside; whether it is inside the regions looked for, an aside, in an article."""

    path: int
    up: int
    key: str
    tag: str
    hint: bool
    inside: bool
    aside: bool
    article: bool


def hinted(values: list[str]) -> bool:
    return any(v in HINTS or len(p := re.split("[-_]+", v)) > 1 and p[-1] in HINTS and p[0] not in NO_HINT for v in values)


def tokens(page: str) -> Iterator[tuple[str, str, str, bool]]:
    """(kind, tag or text, key, hint) of a page: kind '<' or '>' for blocks, 'a' and '/a', '#' with decoded text, ' ' for a break."""
    at = 0
    while m := TOKEN.match(page, at):
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            if not m[0].startswith(("<!", "<?")):
                yield "#", html.unescape(m[0]), "", False
        elif name in RAW and not m[1]:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(name)}\s*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
        elif name in BLOCKS:
            if m[1]:
                yield ">", name, "", False
            else:
                values = [w.lower() for x in ATTRIBUTE.finditer(m[3]) if x[1].lower() in ("class", "id", "role") for w in (x[2] or x[3] or x[4] or "").split()] if m[3] else []
                words = sorted({re.sub(r"\d+", "0", w) for w in values})
                yield "<", name, ".".join([name, *words]), name not in NEVER_ASIDE and hinted(values)
        elif name == "a":
            yield ("/a" if m[1] else "a"), "", "", False
        elif name in ("br", "wbr", "img", "input"):
            yield " ", "", "", False


class Line(NamedTuple):
    """A block's text: white space is one space. at: the element that holds it; link: characters in links."""

    text: str
    at: Element
    link: int


def events(page: str, tops: frozenset = frozenset(), exempt: frozenset = frozenset()) -> Iterator[Element | Line]:
    """Elements as they open and lines as they end, in page order. tops: paths of the regions looked for; exempt: hinted paths that are no asides."""
    stack = [Element(0, 0, "", "", False, 0 in tops, False, False)]
    opened: Counter = Counter()
    parts: list[str] = []
    link, linked = False, 0

    def line() -> Iterator[Line]:
        nonlocal linked
        if parts and (text := " ".join("".join(parts).split())):
            yield Line(text, stack[-1], min(linked, len(text)))
        parts.clear()
        linked = 0

    for kind, value, key, hint in tokens(page):
        if kind == "<":
            yield from line()
            last = stack[-1].tag
            if last in CLOSED_BY_BLOCK or last == value and value in CLOSED_BY_SAME:
                opened[stack.pop().tag] -= 1
            link = False
            up = stack[-1]
            path = xxh3_64_intdigest(f"{up.path} {key}") >> 1
            # An article's own header has its title.
            aside = up.aside or value in ASIDE and not (value == "header" and up.article) or hint and path not in exempt
            e = Element(path, up.path, key, value, hint, up.inside or path in tops, aside, up.article or value == "article")
            yield e
            if value not in VOID:
                stack.append(e)
                opened[value] += 1
        elif kind == ">":
            if opened[value]:
                yield from line()
                while (e := stack.pop()).tag != value:
                    opened[e.tag] -= 1
                opened[value] -= 1
                link = False
        elif kind in ("a", "/a"):
            link = kind == "a"
        else:
            parts.append(" " if kind == " " else value)
            linked += len(value.strip()) if link else 0
    yield from line()


# A wrapper has a row per element path: [up, key, tag, hint, pages, instances, characters, characters in links, text, then].
# text is the hash of the path's own lines if all pages have the same, else None: a slot. then has, per child key, the keys
# that follow it: what stands in a cycle of them is a repeated group, what some instances lack is optional. So each key is
# once in its parent's expression, and a wrapper is no larger than the number of different paths of its host's pages.

Wrapper = dict[int, list]
UP, KEY, TAG, HINT, PAGES, INSTANCES, CHARS, LINK, TEXT, THEN = range(10)


def wrapper(page: str, lines: dict[int, tuple[int, int]] | None = None) -> Wrapper:
    """A page's own wrapper; lines, if given, gets (path, characters) of the page's lines."""
    out: Wrapper = {0: [0, "", "", False, 1, 1, 0, 0, 0, {}]}
    last: dict[int, str] = {}  # the child before, of each open element
    own: dict[int, list[str]] = {}
    for e in events(page):
        if isinstance(e, Element):
            row = out.setdefault(e.path, [e.up, e.key, e.tag, e.hint, 1, 0, 0, 0, 0, {}])
            row[INSTANCES] += 1
            then = out[e.up][THEN]
            then.setdefault(e.key, set())
            if e.up in last:
                then[last[e.up]].add(e.key)
            last[e.up] = e.key
            last.pop(e.path, None)
        else:
            path = e.at.path
            out[path][CHARS] += len(e.text)
            out[path][LINK] += e.link
            own.setdefault(path, []).append(e.text)
            if lines is not None:
                lines[_line(path, e.text)] = path, len(e.text)
    for path, lines in own.items():
        out[path][TEXT] = xxh3_64_intdigest("\n".join(lines)) >> 1
    return out


def align(a: Wrapper, b: Wrapper) -> Wrapper:
    """a, aligned with b and generalized: element by element, missing children become optional, recurring ones repeated, texts that differ slots. a is changed. Order and grouping of pages don't matter."""
    for path, y in b.items():
        x = a.get(path)
        if x is None:
            a[path] = [*y[:THEN], {k: set(v) for k, v in y[THEN].items()}]
            continue
        x[HINT] = x[HINT] or y[HINT]
        for i in (PAGES, INSTANCES, CHARS, LINK):
            x[i] += y[i]
        x[TEXT] = x[TEXT] if x[TEXT] == y[TEXT] else None
        for k, v in y[THEN].items():
            x[THEN].setdefault(k, set()).update(v)
    return a


def dumps(w: Wrapper) -> str:
    return json.dumps([[path, *row[:THEN], {k: sorted(v) for k, v in row[THEN].items()}] for path, row in w.items()])


def loads(x: str) -> Wrapper:
    return {path: [*row[:THEN], {k: set(v) for k, v in row[THEN].items()}] for path, *row in json.loads(x)}


def children(w: Wrapper, path: int) -> list[list[str]]:
    """Groups of child keys in order: more than one, or one that follows itself, is a repeated group."""
    then = w[path][THEN]
    reach: dict[str, set[str]] = {}
    for k in then:
        seen, todo = set(), [k]
        while todo:
            for j in then.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        reach[k] = seen
    groups: dict[frozenset, list[str]] = {}
    for k in sorted(then):
        groups.setdefault(frozenset(j for j in then if j == k or j in reach[k] and k in reach[j]), []).append(k)
    # Whatever reaches more stands before; groups that no page has in order go by their keys.
    return sorted(groups.values(), key=lambda g: (-len(reach[g[0]] | set(g)), g))


def expression(w: Wrapper, path: int = 0) -> str:
    """The wrapper as a union-free regular expression: #: a slot, =: constant text, ()+ and ()? repeated and optional groups."""
    row = w[path]
    out = {0: "", None: "#"}.get(row[TEXT], "=")
    for g in children(w, path):
        inner = ""
        for k in g:
            child = next(p for p, r in w.items() if p and r[UP] == path and r[KEY] == k)
            lacking = w[child][PAGES] < row[PAGES] or w[child][INSTANCES] < row[INSTANCES]
            inner += f"({expression(w, child)})?" if lacking else expression(w, child)
        out += f"({inner})+" if len(g) > 1 or g[0] in row[THEN][g[0]] else inner
    return f"<{row[KEY]}>{out}</{row[TAG]}>" if path else out


def regions(w: Wrapper, constant: dict[int, int]) -> dict:
    """What the wrapper says of a host's pages: the paths that hold the article, whether by their names, and hinted paths that are no asides.

    constant: characters of constant lines by path; the rest is in slots. A hint counts unless its element holds half of
    all slots. The article is in the article elements, or else the main ones; or else in the smallest block that holds all
    slots which are not links and not in asides, or, where all pages are one, MOST_TEXT of the text.
    """
    below: dict[int, list[int]] = {}
    for path, row in w.items():
        if path:
            below.setdefault(row[UP], []).append(path)
    slots = {p: max(0, r[CHARS] - r[LINK] - constant.get(p, 0)) for p, r in w.items()}
    order, todo = [], [0]
    while todo:  # parents before children
        order.append(p := todo.pop())
        todo += below.get(p, [])

    def sums(of: dict[int, int], out: set[int]) -> dict[int, int]:
        held = {}
        for p in reversed(order):
            held[p] = 0 if p in out else of[p] + sum(held[c] for c in below.get(p, ()))
        return held

    def asides(hints: set[int]) -> set[int]:
        out, in_article = set(), set()
        for p in order:
            row = w[p]
            own_header = row[TAG] == "header" and row[UP] in in_article  # an article's own header has its title
            if p and (row[UP] in out or row[TAG] in ASIDE and not own_header or p in hints):
                out.add(p)
            elif row[TAG] == "article" or row[UP] in in_article:
                in_article.add(p)
        return out

    hints = {p for p, r in w.items() if r[HINT]}
    held = sums(slots, asides(set()))
    exempt = {p for p in hints if held[p] and 2 * held[p] >= held[0]}
    out = asides(hints - exempt)
    chars = {p: r[CHARS] for p, r in w.items()}
    text = sums(chars, out)
    for tags in ("article", "main"):
        named = {p for p in order if p not in out and text[p] and (w[p][TAG] == tags or tags == "main" and "main" in w[p][KEY].split(".")[1:])}
        inside = set()
        for p in order:
            if w[p][UP] in named | inside and p:
                inside.add(p)
        if named:
            return {"tops": sorted(named - inside), "named": True, "exempt": sorted(exempt)}
    # Links beside text are text; blocks of links are none.
    story = {p: (0 if w[p][CHARS] and 2 * w[p][LINK] > w[p][CHARS] else slots[p]) for p in w}
    held = sums(story, out)
    if not held[0]:
        held = sums({p: (0 if 2 * w[p][LINK] > w[p][CHARS] else w[p][CHARS]) for p in w}, out)
    need = held[0] if w[0][PAGES] >= LEAST_PAGES else MOST_TEXT * held[0]
    top = 0
    while step := [c for c in below.get(top, ()) if held[c] >= need and (w[c][TAG] in BOXES or w[c][TAG] in ("html", "body"))]:
        top = step[0]
    return {"tops": [top] if held[0] else [], "named": False, "exempt": sorted(exempt)}


def extract(page: str, found: dict, constant: set[int]) -> str:
    """The lines of a page in the regions found, out of asides and without constant lines: of layout boxes, or, where the region has no name of its own, all. If nothing is left, constant ones stay."""
    tops = frozenset(found["tops"])
    lines = []
    for e in events(page, tops, frozenset(found["exempt"])):
        if isinstance(e, Line) and e.at.inside and not e.at.aside:
            open_to_it = not found["named"] or e.at.tag in LAYOUT and e.at.path not in tops
            lines.append((e.text, open_to_it and _line(e.at.path, e.text) in constant))
    kept = [text for text, fixed in lines if not fixed]
    return "\n".join(kept or [text for text, _ in lines])


def _line(path: int, text: str) -> int:
    return xxh3_64_intdigest(f"{path} {text}") >> 1


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def read_hosts(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(host, wrapper) and (host, path, line, chars) of all pages (host, html): each host's wrapper, and its constant lines.

    Each task aligns its pages by host; a host's wrappers are aligned, first within SALTS groups of tasks. Lines are
    counted by host, path and text, so that a host of any size is dealt over all tasks; those on a CONSTANT share of its
    pages are no more than 1 / CONSTANT times a page's lines.
    """
    names = ["host", "salt", "wrapper", "pages", "line", "path", "chars"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Wrapper] = {}
        lines: dict[tuple[str, int], list[int]] = {}
        salt = TaskContext.get().partitionId() % SALTS

        def out() -> pa.RecordBatch:
            rows = [(h, salt, dumps(w), w[0][PAGES], None, None, None) for h, w in held.items()] + [(h, None, None, n, x, path, chars) for (h, x), (n, path, chars) in lines.items()]
            held.clear()
            lines.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[int, tuple[int, int]] = {}
                w = wrapper(page.as_py() or "", own)
                held[h] = align(held[h], w) if h in held else w
                for x, (path, chars) in own.items():
                    lines.setdefault((h, x), [0, path, chars])[0] += 1
                if len(held) >= HELD_HOSTS or len(lines) >= HELD_LINES:
                    yield out()
        if held:
            yield out()

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        ws = iter(pdf["wrapper"])
        w = loads(next(ws))
        for x in ws:
            align(w, loads(x))
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [dumps(w)]})

    parts = written(pages.mapInArrow(partial, "host string, salt int, wrapper string, pages long, line long, path long, chars long"))
    wrappers = parts.filter("line is null").groupBy("host", "salt").applyInPandas(together, "host string, wrapper string")
    wrappers = wrappers.groupBy("host").applyInPandas(together, "host string, wrapper string")
    hosts = parts.filter("line is null").groupBy("host").agg(F.sum("pages").alias("all")).filter(F.col("all") >= LEAST_PAGES)
    lines = parts.filter("line is not null").groupBy("host", "line").agg(F.sum("pages").alias("pages"), F.first("path").alias("path"), F.first("chars").alias("chars")).filter("pages > 1")
    lines = lines.join(hosts, "host").filter(F.col("pages") >= CONSTANT * F.col("all"))
    return wrappers, lines.select("host", "path", "line", (F.col("chars") * F.col("pages")).alias("chars"))


def extract_text(pages: DataFrame) -> DataFrame:
    """Per row of pages (page_id, url, html): page_id, url, text (empty if none), n_chars (its code points).

    Null html and pages without text give the empty text; a null url belongs to the host ''; whole pages are read,
    whatever their length; repeated rows give the same text; an empty table gives no rows. Other columns of pages are not
    read. A page in which its host's regions hold no text goes by its own wrapper.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers, lines = read_hosts(rows.select("host", "html"))
    lines = lines.groupBy("host").agg(F.collect_list(F.struct("path", "line", "chars")).alias("constant"))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, constant in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                chars: dict[int, int] = {}
                for x in constant or ():
                    chars[x["path"]] = chars.get(x["path"], 0) + x["chars"]
                out.append(json.dumps([regions(loads(w), chars), [x["line"] for x in constant or ()]]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["host", "found"])

    found = written(wrappers.join(lines, "host", "left").select("host", "wrapper", "constant").mapInArrow(chosen, "host string, found string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, x in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                text, page = "", page.as_py()
                if page:
                    where, constant = json.loads(x)
                    text = extract(page, where, set(constant)) or extract(page, regions(wrapper(page), {}), set())
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([*map(len, out)], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    joined = rows.join(found, "host", "left").select("page_id", "url", "html", "found")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
