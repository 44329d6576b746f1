"""Main text of web pages by page differencing with the nearest URL of the host.

The lines of a page that a longest common subsequence shares with its neighbour are no text of its own. Elements that
are never main text (menus, forms, adverts ...) go first. Of the elements that a page marks as article or main, the one
that holds most of its own lines is the article, if it holds half of them: it stays whole, with lines that another
article repeats, such as licence lines, which deletion alone would lose. Else what stays is the page's own lines.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_order
from .urls import host_and_path

_NAME, _STOP = re.compile("[a-zA-Z][a-zA-Z0-9:-]*"), re.compile(r">|=\s*([\"'])")
#: Elements whose content is no text of the page.
_OPAQUE = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style noscript template textarea title svg iframe select button".split()}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Elements that are never main text, and words in class, id or role that say so.
JUNK = frozenset("nav aside footer form menu head dialog".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies disqus footer "
    "masthead menu modal nav navbar navigation newsletter notice notices pager popup promo promoted related reply respond search share sharing "
    "sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul dialog".split()
)
#: Words that say what an element is made of, not what it is about: beside a junk word they make a junk name.
PLAIN = frozenset("area bar block bottom box button buttons container form icon icons inline inner item items left link links list panel post posts right row section slot top unit wrap wrapper".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


def _names(rest: str) -> Iterator[str]:
    """Class names, ids and roles of a tag, in lower case."""
    for m in _NAMES.finditer(rest):
        yield from (m[1] or m[2] or m[3] or "").lower().split()


def _junk_name(name: str) -> bool:
    """Whether a whole name says junk: ``share-buttons`` does, ``share-price`` and ``related-work`` don't."""
    words = _WORDS.findall(name)
    return any(w in JUNK_WORDS for w in words) and all(w in JUNK_WORDS or w in PLAIN for w in words)


def _junk(name: str, rest: str, inside: bool) -> bool:
    """Outside the marked article one junk word in a name is enough, inside it takes a whole name."""
    if name in JUNK or name == "header" and not inside:
        return True
    if not rest:
        return False
    if name in ("article", "main"):
        return name == "article" and any(w in ("comment", "comments", "ad", "advert", "reply") for n in _names(rest) for w in _WORDS.findall(n))
    if name in ("html", "body"):
        return False
    return any(_junk_name(n) if inside else any(w in JUNK_WORDS for w in _WORDS.findall(n)) for n in _names(rest))


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, rest of the tag), one of the first two empty; a tag begins with / if it closes. Linear in the page, whatever is
    left open: a quoted value without end is none, and a tag that then has no end ends at the next ``>``."""
    at, last = 0, page.rfind(">")
    failed: set[int] = set()  # quoted values behind which no tag that is open there ends
    gone: set[str] = set()  # quotes of which there is none left

    def end_of(begin: int) -> int:
        i, seen = begin, []
        while (m := _STOP.search(page, i)) and m.start() not in failed:
            if m[0] == ">":
                return m.start()
            seen.append(m.start())
            j = -1 if m[1] in gone else page.find(m[1], m.end())
            if j < 0:
                gone.add(m[1])
            i = j + 1 or m.end()
        failed.update(seen)
        return page.find(">", begin)

    while at < len(page):
        if page[at] != "<":
            end = page.find("<", at)
            end = len(page) if end < 0 else end
            yield page[at:end], "", ""
            at = end
            continue
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            at = len(page) if end < 0 else end + 3
            continue
        closing = page.startswith("/", at + 1)
        name = _NAME.match(page, at + 1 + closing)
        if at > last or not name and not page.startswith(("!", "?", "/"), at + 1):
            yield "<", "", ""
            at += 1
            continue
        if not name:
            at = page.find(">", at) + 1
            continue
        end, tag = end_of(name.end()), name[0].lower()
        if not closing and tag in _OPAQUE and not (tag == "svg" and page[end - 1] == "/"):
            closed = _OPAQUE[tag].search(page, end + 1)
            at = closed.end() if closed else len(page)
            continue
        yield "", "/" * closing + tag, page[name.end() : end]
        at = end + 1


def blocks(page: str) -> list[tuple[str, int, list[int]]]:
    """Text of each block in page order, whether it stands in main text's place (2 in an article or main element, 1
    elsewhere, 0 in junk) and the numbers of the article and main elements it is in, the outermost first."""
    out: list[tuple[str, int, list[int]]] = []
    stack: list[tuple[str, int, int]] = []  # open elements, what stands in them and the number of marked ones
    now: list[str] = []
    level, marked = 1, 0

    def close() -> None:
        if now:
            text = " ".join("".join(now).split())
            now.clear()
            if text:
                out.append((text, level, [s[2] for s in stack if s[2]]))

    for text, tag, rest in _tokens(page):
        if text:
            now.append(entities.unescape(text) if "&" in text else text)
            continue
        name = tag.removeprefix("/")
        if name == "br":
            now.append(" ")
            continue
        if name not in BLOCKS and name not in ("span", "section"):
            continue
        if name in BLOCKS:
            close()
        if name in VOID or rest.endswith("/") and name == "hr":
            continue
        if name != tag:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name == "span" and stack[i][1] != level:
                        close()
                    del stack[i:]
                    level = stack[-1][1] if stack else 1
                    break
            continue
        inside, number = level, 0
        if name in ("article", "main"):
            shut = any(s[1] == 0 and s[0] in JUNK for s in stack) or _junk(name, rest, True)
            inside = 0 if shut else 2
            marked += 1
            number = 0 if shut else marked
        elif level and _junk(name, rest, level == 2):
            inside = 0
        if name == "p":
            continue  # its end is often left out; it holds text alone
        if name == "span" and inside != level:
            close()
        stack.append((name, inside, number))
        level = inside
    close()
    return out


#: Bits that a longest common subsequence keeps to walk back; longer lists are cut in two first.
_KEPT = 1 << 24


def _rows(a: list[str], b: list[str]) -> Iterator[int]:
    """For each prefix of ``a`` the places of ``b`` where its longest common subsequence with b's prefixes grows, as zeros
    (bit-parallel)."""
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _lengths(a: list[str], b: list[str]) -> list[int]:
    """Of a longest common subsequence of ``a`` with each prefix of ``b``."""
    row = (1 << len(b)) - 1
    for row in _rows(a, b):
        pass
    out = [0]
    for bit in reversed(f"{row:0{len(b)}b}") if b else "":
        out.append(out[-1] + (bit == "0"))
    return out


def common(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence of lines with ``b``, in memory that grows with their sum: equal ends go
    first, and what is long is halved where both halves' subsequences are longest together."""
    in_b, in_a = set(b), set(a)
    own = [i for i, x in enumerate(a) if x in in_b]
    out: set[int] = set()
    todo = [(own, [x for x in b if x in in_a])]
    while todo:
        own, b = todo.pop()
        head = 0
        while head < min(len(own), len(b)) and a[own[head]] == b[head]:
            head += 1
        tail = 0
        while tail < min(len(own), len(b)) - head and a[own[-1 - tail]] == b[-1 - tail]:
            tail += 1
        out.update(own[:head], own[len(own) - tail :])
        own, b = own[head : len(own) - tail], b[head : len(b) - tail]
        if not own or not b:
            continue
        lines = [a[i] for i in own]
        if len(own) > 1 and len(own) * len(b) > _KEPT:
            half = len(own) // 2
            left, right = _lengths(lines[:half], b), _lengths(lines[half:][::-1], b[::-1])
            cut = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
            todo += [(own[:half], b[:cut]), (own[half:], b[cut:])]
            continue
        rows, j = [*_rows(lines, b)], len(b) - 1
        for k in range(len(own) - 1, -1, -1):
            before = rows[k - 1] if k else -1
            while j >= 0 and rows[k] >> j & 1:
                j -= 1
            if j < 0:
                break
            if before >> j & 1:  # the step at j comes with this line
                out.add(own[k])
                j -= 1
    return out


def main_text(own: list[tuple[str, int, list[int]]], neighbour: list[str] | None) -> str:
    """The article by its own lines, ``neighbour`` being the lines of the nearest page. A page all of whose lines recur
    there is a copy of it, so they don't count against it."""
    shared = common([b[0] for b in own], neighbour) if neighbour else set()
    live = [i for i, b in enumerate(own) if b[1]]
    left = [i for i in live if i not in shared] or live
    weight: dict[int, int] = {}
    for i in left:
        for k in own[i][2]:
            weight[k] = weight.get(k, 0) + len(own[i][0])
    outer = {own[i][2][0] for i in left if own[i][2]}
    best = max(outer, key=lambda k: (weight[k], -k), default=0)
    if not best or 2 * weight[best] < sum(len(own[i][0]) for i in left):
        return "\n".join(own[i][0] for i in left)
    for k in sorted({k for i in left if best in own[i][2] for k in own[i][2]}):
        if weight[k] >= 0.9 * weight[best] and k > best:
            best = k  # an article in main that holds nearly all of it
    return "\n".join(own[i][0] for i in live if best in own[i][2])


def _parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [blocks(h) for h in f["html"]]
        f = f.drop(columns="html")
        for k, name in enumerate(("lines", "levels", "marked")):
            f[name] = [[x[k] for x in b] for b in found]
        yield f


def _alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _differenced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order; each waits for the row after it, then the nearer of both neighbours on its host is taken."""
    before = here = None

    def done(after):
        near = [x for x in (before, after) if x and x["bucket"] == here["bucket"] and x["host"] == here["host"]]
        near = max(near, key=lambda x: _alike(x["path"], here["path"]), default=None)
        text = main_text(here["blocks"], near and [b[0] for b in near["blocks"]])
        return here["page_id"], here["url"], text, len(text)

    for f in frames:
        out = []
        for r in f.to_dict("records"):
            r["blocks"] = [(t, n, list(m)) for t, n, m in zip(r["lines"], r["levels"], r["marked"], strict=True)]
            if here is not None and here["side"] == 0:
                out.append(done(r))
            before, here = here, r
        yield pd.DataFrame(out, columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})
    if here is not None and here["side"] == 0:
        yield pd.DataFrame([done(None)], columns=["page_id", "url", "text", "n_chars"]).astype({"page_id": "Int64"})


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages`` (page_id, url, html).

    Pages are paired with the one before or after them in order of path on the same host (the longer common path;
    the one before in a tie; none if the host has no other). Null html and pages without main text give an empty text.
    Repeated rows are each other's neighbours, all of whose lines recur, and get equal results. Other columns are ignored.
    """
    host, path = host_and_path()
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("order_key", F.concat_ws("\n", "host", "path", F.lpad(F.coalesce("page_id", F.lit(0)).cast("string"), 20, "0"))).withColumn("h", F.xxhash64("url"))
    parsed = "page_id long, url string, host string, path string, order_key string, h long, bucket int, side int, lines array<string>, levels array<int>, marked array<array<int>>"
    return in_order(rows, "order_key", "h", "html", prepare=lambda df: df.mapInPandas(_parsed, parsed)).mapInPandas(_differenced, "page_id long, url string, text string, n_chars long")
