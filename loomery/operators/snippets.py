"""Snippets: the window of a text's tokens that shows most of a query's words, with the words in brackets.

A window scores 1000 for each phrase it holds and 1 for every further place of one. Windows are tried around each hit, so that hits
stand in the middle, and from the begin of the sentence that a hit stands in, which scores 100 more (120 at the text's begin). Of
equal windows the first tried counts.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TOKENS, GAP = 32, " … "
_TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")


def fold(token: str) -> str:
    """Lower case, without accents of letters."""
    return "".join(c for c in unicodedata.normalize("NFD", token.lower()) if not unicodedata.combining(c))


def hits(tokens: list[str], phrases: list[list[str]], prefix: bool = False) -> list[tuple[int, int, int]]:
    """(place, phrase, its length) of every phrase in ``tokens``, by place, then phrase."""
    out = []
    for p, words in enumerate(phrases):
        for i in range(len(tokens) - len(words) + 1):
            last = len(words) - 1
            if all(tokens[i + k] == w or (prefix and k == last and tokens[i + k].startswith(w)) for k, w in enumerate(words)):
                out.append((i, p, len(words)))
    return sorted(out)


def best_window(found: list[tuple[int, int, int]], sentences: list[int], size: int, tokens: int = TOKENS) -> int:
    """The first token of the best window of a text of ``size`` tokens."""

    def score(start: int) -> tuple[int, int]:
        seen, total, first, last = set(), 0, -1, 0
        for at, p, n in found:
            if start <= at < start + tokens:
                total += 1 if p in seen else 1000
                seen.add(p)
                first = at if first < 0 else first
                last = at + n
        return total, max(0, min(first - int((tokens - (last - first)) / 2), size - tokens))

    best, at = 0, 0
    for place, _, _ in found:
        total, middle = score(place)
        if total > best:
            best, at = total, middle
        before = [s for s in sentences if s <= place]
        if size > tokens and before and before[-1] < place:
            total = score(before[-1])[0] + (100 if before[-1] else 120)
            if total > best:
                best, at = total, before[-1]
    return at


def snippet_of(text: str, phrases: list[list[str]], tokens: int = TOKENS, prefix: bool = False) -> str:
    """The best window of ``text``; of one without a hit its begin."""
    spans = [(m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not spans:
        return text
    found = hits([fold(text[a:b]) for a, b in spans], phrases, prefix)
    sentences = [0]
    for i, (a, _) in enumerate(spans[1:], 1):
        gap = text[spans[i - 1][1] : a]
        bare = gap.rstrip(" \t\n\r")
        if bare != gap and bare.endswith((".", ":")):
            sentences.append(i)
    start = best_window(found, sentences, len(spans), tokens)
    end = min(start + tokens, len(spans))
    marked = []
    for at, _, n in found:  # phrases that overlap share their brackets
        if marked and at < marked[-1][1]:
            marked[-1][1] = max(marked[-1][1], at + n)
        else:
            marked.append([at, at + n])
    out, place = [], spans[start][0] if start else 0
    for a, b in marked:
        a, b = max(a, start), min(b, end)
        if a < b:
            out += [text[place : spans[a][0]], "[", text[spans[a][0] : spans[b - 1][1]], "]"]
            place = spans[b - 1][1]
    out.append(text[place : spans[end - 1][1]] if end < len(spans) else text[place:])
    return (GAP if start else "") + "".join(out) + (GAP if end < len(spans) else "")


def snippets(text: Column, phrases: list[list[str]], tokens: int = TOKENS, prefix: bool = False) -> Column:
    """For the rows of a page."""
    folded = [[fold(w) for w in p] for p in phrases]
    return F.pandas_udf(lambda s: s.map(lambda t: None if t is None else snippet_of(t, folded, tokens, prefix)), StringType())(text)


def window_starts(occurrences: DataFrame, tokens: int = TOKENS) -> DataFrame:
    """(id, col, start, score): where the best window around a hit begins, for every unit, from postings (id, col, p, pos) alone and
    without the text: no sentences, and no shift to the middle. Hits of a text are compared along its own order."""
    ahead = Window.partitionBy("id", "col").orderBy("pos").rangeBetween(0, tokens - 1)
    rows = occurrences.select("id", "col", "p", "pos").distinct()
    score = F.count("*").over(ahead) + 999 * F.size(F.collect_set("p").over(ahead))
    best = Window.partitionBy("id", "col").orderBy(F.desc("score"), "pos")
    rows = rows.withColumn("score", score.cast("long")).withColumn("i", F.row_number().over(best)).where("i = 1")
    return rows.select("id", "col", F.col("pos").alias("start"), "score")
