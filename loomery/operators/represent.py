"""Derived text: label attributes, Markdown sections, references, attribution, chunks, snippets."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, IntegerType, LongType, StringType, StructField, StructType



def _rows(**kinds: DataType) -> ArrayType:
    """Types as objects: parsing their names would need a session where workers import this module."""
    return ArrayType(StructType([StructField(k, v) for k, v in kinds.items()]))


#: Label prefixes that name another role.
ROLE_ALIASES = {"comp": "component", "eff": "effort", "imp": "importance", "importance": "importance", "priority": "importance"}


@dataclass(frozen=True)
class LabelRule:
    """Role of an exact ``label`` or of all with a ``prefix``; without a value the rest of the label is it."""

    role: str
    label: str = ""
    prefix: str = ""
    value: str = ""
    aliases: tuple[str, ...] = ()
    description: str = ""


def validate_rules(rules: dict[str, list[LabelRule]]) -> None:
    for repo, own in rules.items():
        chosen = [(r.label, r.prefix) for r in own]
        if any(bool(r.label) == bool(r.prefix) or not r.role.strip() for r in own):
            raise ValueError(f"a label rule of {repo} needs a role and either a label or a prefix")
        if len(set(chosen)) < len(chosen):
            raise ValueError(f"{repo} has two rules for one label or prefix")


_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def attributes(labels: Column, rules: list[LabelRule] = ()) -> Column:
    """Every label as (label, role, value, aliases, description): ``prefix:value`` gives role and value, others are a
    ``label`` of their own. A rule for the exact label goes before prefixes, the longest of which counts."""
    alias = F.create_map(*(F.lit(x) for kv in ROLE_ALIASES.items() for x in kv))
    text = lambda x: F.regexp_replace(x, _EDGES, "")
    none = F.array().cast("array<string>")

    def rule(i: int, r: LabelRule, x: Column) -> Column:
        weight = len(r.label.encode()) + 1 if r.label else len(r.prefix.encode())
        value = F.lit(r.value) if r.value else text(x if r.label else F.substr(x, F.lit(len(r.prefix) + 1)))
        fits = x == r.label if r.label else x.startswith(r.prefix)
        got = F.struct(
            F.lit(weight).alias("weight"), F.lit(-i).alias("order"), F.lit(r.role).alias("role"), value.alias("value"),
            F.array(*(F.lit(a) for a in r.aliases)).cast("array<string>").alias("aliases"), F.lit(r.description).alias("description"),
        )
        return F.when(fits, got)

    def one(x: Column) -> Column:
        prefix, value = F.lower(F.substring_index(x, ":", 1)), text(F.substr(x, F.instr(x, ":") + 1))
        named = (F.instr(x, ":") > 0) & (value != "")
        role = F.when(named, F.coalesce(F.element_at(alias, prefix), prefix)).otherwise("label")
        out = F.struct(role.alias("role"), F.when(named, value).otherwise(x).alias("value"), none.alias("aliases"), F.lit("").alias("description"))
        if rules:
            best = F.array_max(F.array(*(rule(i, r, x) for i, r in enumerate(rules))))
            out = F.when(best.isNull(), out).otherwise(F.struct(*(best[c].alias(c) for c in ("role", "value", "aliases", "description"))))
        return F.struct(x.alias("label"), *(out[c].alias(c) for c in ("role", "value", "aliases", "description")))

    return F.transform(labels, one)


def project_name(url: Column) -> Column:
    """owner/number of an organisation's or user's project URL."""
    owner, number = (F.regexp_extract(url, r"^https?://[^/]+/(?:orgs|users)/([^/]+)/projects/(\d+)$", i) for i in (1, 2))
    return F.when(owner != "", F.concat_ws("/", owner, number))


class Fence:
    """Whether a line is part of a fenced code block. A backtick fence's info string can't hold a backtick."""

    def __init__(self):
        self.open: str | None = None

    def line(self, text: str) -> bool:
        m = re.match(r" {0,3}(`{3,}|~{3,})(.*)$", text)
        if self.open is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                self.open = m[1]
                return True
            return False
        if m and m[1][0] == self.open[0] and len(m[1]) >= len(self.open) and not m[2].strip():
            self.open = None
        return True


#: What a heading holds and the kind of its section, the first that fits.
KINDS = [
    (("before requesting", "pr is ready", "checklist"), "checklist"),
    (("reported via",), "template"),
    (("acceptance",), "acceptance"),
    (("expected",), "expected"),
    (("actual", "observed"), "actual"),
    (("repro", "steps"), "reproduction"),
    (("environment", "browser", "os details"), "environment"),
    (("description",), "description"),
]
#: Texts that say nothing, and kinds that templates fill in.
EMPTY, BOILERPLATE = {"", "_no response_", "no response"}, {"checklist", "template"}
_HEADING = re.compile(r" {0,3}#{1,6}[ \t\f]+(.+?)[ \t\f]*#*[ \t\f]*$")


def _lines(body: str):
    """(line, first byte, end byte); lines end after a line feed and nowhere else."""
    at = 0
    for line in re.findall(r"[^\n]*\n|[^\n]+", body):
        size = len(line.encode("utf-8", "surrogatepass"))
        yield line, at, at + size
        at += size


def split_sections(body: str) -> list[dict]:
    """Sections by headings outside fences: kind, heading, byte range of the text below, empty, boilerplate. What
    stands before the first heading is a description."""
    found, fence, end = [("description", "", 0)], Fence(), 0
    stops = []
    for line, start, end in _lines(body):
        if not fence.line(line.rstrip("\r\n")) and (m := _HEADING.match(line.rstrip("\r\n"))):
            stops.append(start)
            low = m[1].lower().strip()
            found.append((next((kind for words, kind in KINDS if any(w in low for w in words)), "other"), m[1], end))
    raw, out = body.encode("utf-8", "surrogatepass"), []
    for (kind, heading, start), stop in zip(found, [*stops, end], strict=True):
        if heading or stop > start:
            text = raw[start:stop].decode("utf-8", "surrogatepass").strip().lower()
            out.append({"kind": kind, "heading": heading, "start": start, "end": stop, "empty": text in EMPTY, "boilerplate": kind in BOILERPLATE})
    return out


@F.pandas_udf(_rows(kind=StringType(), heading=StringType(), start=IntegerType(), end=IntegerType(), empty=BooleanType(), boilerplate=BooleanType()))
def sections(bodies: pd.Series) -> pd.Series:
    """No sections for null and empty bodies."""
    return bodies.map(lambda b: [tuple(s.values()) for s in split_sections(b or "")])


def retrieval_spans(found: Column) -> Column:
    """Of ``sections`` those worth indexing."""
    return F.filter(found, lambda s: ~s["empty"] & ~s["boilerplate"])


#: The grammar of owners, repositories and references.
_OWNER, _NAME = rb"[A-Za-z0-9](?:[A-Za-z0-9-]{0,37}[A-Za-z0-9])?", rb"[A-Za-z0-9_.-]{1,100}"
_MENTION = re.compile(rb"(?P<url>https?://[^\t\n\f\r <>\[\]()]+)|(?P<repo>" + _OWNER + rb"/" + _NAME + rb")?#(?P<n>[0-9]+)")
_LINK = re.compile(rb"(https?://([^/\t\n\f\r ]+)/(" + _OWNER + rb"/" + _NAME + rb")/(?:issues|pull)/([0-9]+))(?![A-Za-z0-9_])")
_BEFORE = [
    ("duplicate_reference", re.compile(rb"(?:duplicate[\t\n\f\r ]+(?:of[\t\n\f\r ]+)?|duplicates[\t\n\f\r ]+)\Z", re.I)),
    ("fix_reference", re.compile(rb"(?:fix(?:es|ed)?|resolv(?:es|ed)|clos(?:es|ed))[\t\n\f\r ]+\Z", re.I)),
]
LOOK_BEHIND, HOST, MOST_NUMBER = 64, "github.com", 2**63 - 1
_JOINED = frozenset(b"/:._-0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def find_references(repo: str, body: str, source: str = "") -> list[tuple[str, int, str, int, int]]:
    """(repo, number, kind, first byte, end byte) of each mention outside fences. Links count on HOST and on the host of
    ``source``; a short form doesn't follow a letter, digit or any of / : . _ -"""
    raw, fence, fenced = body.encode("utf-8", "surrogatepass"), Fence(), []
    for line, start, end in _lines(body):
        if fence.line(line.rstrip("\r\n")):
            fenced.append((start, end))
    hosts = {HOST, source.split("://", 1)[1].split("/")[0] if "://" in source else HOST}
    out, at = [], 0
    for m in _MENTION.finditer(raw):
        while at < len(fenced) and fenced[at][1] <= m.start():
            at += 1
        if at < len(fenced) and fenced[at][0] <= m.start():
            continue
        target, number, end = (m["repo"] or repo.encode()).decode(), m["n"], m.end()
        if m["url"]:
            if not (link := _LINK.match(m["url"])) or link[2].decode("utf-8", "replace") not in hosts:
                continue
            target, number, end = link[3].decode(), link[4], m.start() + link.end(1)
        elif m.start() and raw[m.start() - 1] in _JOINED:
            continue
        if 1 <= int(number) <= MOST_NUMBER:
            before = raw[max(0, m.start() - LOOK_BEHIND) : m.start()]
            out.append((target, int(number), next((k for k, p in _BEFORE if p.search(before)), "mention"), m.start(), end))
    return out


@F.pandas_udf(_rows(repo=StringType(), number=LongType(), kind=StringType(), start=IntegerType(), end=IntegerType()))
def references(repos: pd.Series, bodies: pd.Series, sources: pd.Series) -> pd.Series:
    """None for null bodies."""
    return pd.Series([find_references(r, b or "", s or "") for r, b, s in zip(repos, bodies, sources, strict=True)])


#: How a closing line declares its author, the names it gives and the provider they stand for.
DECLARES = ["addressed by ", "generated with ", "generated by ", "reviewed by ", "reviewed with ", "implemented by ", "fixed by "]
DECLARED = {"claude code": "claude", "[claude code](https://claude.ai/code)": "claude", "[claude code](https://claude.com/claude-code)": "claude"}
_MARKER = re.compile(r"<!-- [\w.-]+:ai-generated:(\w+) -->")


def _is_code(lines: list[str]) -> bool:
    """Whether the last of ``lines`` is indented or within a fence that they open."""
    fence = Fence()
    fenced = [fence.line(x.rstrip("\r")) for x in lines if x.strip()]
    return fenced[-1] or lines[-1].startswith(("    ", "\t"))


def declared_ai(body: str) -> str | None:
    """The provider that the last line with text declares; none if that line is fenced or indented code."""
    lines = [line.rstrip("\n") for line, _, _ in _lines(body)]
    while lines and not lines[-1].strip():
        lines.pop()
    if not lines or _is_code(lines):
        return None
    last = lines[-1].strip()
    if m := _MARKER.fullmatch(last):
        return m[1] if m[1] in DECLARED.values() else None
    last = last.strip("*_").strip().removeprefix("\N{ROBOT FACE}").strip().lower()
    return next((DECLARED[last[len(p) :]] for p in DECLARES if last.startswith(p) and last[len(p) :] in DECLARED), None)


@F.pandas_udf(StringType())
def declared_by(bodies: pd.Series) -> pd.Series:
    return bodies.map(lambda b: declared_ai(b or ""))


def detected_ai(body: Column) -> Column:
    """Null where nothing is declared. Only texts that hold a declaration reach Python."""
    low = F.lower(F.coalesce(body, F.lit("")))
    return F.when(F.contains(low, F.lit("claude code")) | F.contains(low, F.lit(":ai-generated:")), declared_by(body))


CHUNK_RUNES, CHUNK_TOKENS, OVERLAP = 2048, 256, 32


def split_chunks(text: str) -> list[tuple[int, int, str]]:
    """(first byte, end byte, text) of overlapping pieces; a cut goes to the last white space of the final quarter.
    Blank pieces are dropped. Bytes are counted from piece to piece."""
    out, start, n, at, counted = [], 0, len(text), 0, 0
    size = lambda t: len(t.encode("utf-8", "surrogatepass"))
    while start < n:
        end = min(n, start + CHUNK_RUNES)
        marks = list(re.finditer(r"\w+|[^\w\s]", text[start:end]))
        if len(marks) > CHUNK_TOKENS:
            end = start + marks[CHUNK_TOKENS - 1].end()
        if end < n:
            spaces = [m.start() for m in re.finditer(r"\s", text[start:end])]
            if spaces and spaces[-1] >= (end - start) * 3 // 4:
                end = start + spaces[-1]
        piece = text[start:end]
        at, counted = at + size(text[counted:start]), start
        if piece.strip():
            out.append((at, at + size(piece), piece))
        if end >= n:
            break
        start = max(end - OVERLAP, start + 1)
    return out


@F.pandas_udf(_rows(start=IntegerType(), end=IntegerType(), text=StringType()))
def chunks(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: split_chunks(t or ""))


def snippet(text: Column, words: list[str], runes: int = 160) -> Column:
    """A piece around the first match with matches in brackets; only for the rows of a page."""
    any_ = r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(map(re.escape, words)) + r")(?![\p{L}\p{N}])"
    at = F.greatest(F.lit(1), F.regexp_instr(text, F.lit(any_)) - runes // 4)
    return F.regexp_replace(F.substring(text, at, F.lit(runes)), any_, "[$1]")


def page_references(documents: DataFrame) -> DataFrame:
    """References of each unit; ``url`` is where its ticket lives. Bodies without a # or a link don't reach Python."""
    could = F.col("body").contains("#") | F.col("body").contains("://")
    rows = documents.where(could).select("id", F.explode_outer(references("repo", "body", "url")).alias("r"))
    return rows.where("r is not null").select("id", "r.repo", "r.number", "r.kind", "r.start", "r.end")
