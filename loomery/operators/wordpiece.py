"""Passages that fit an encoder: the longest pieces of a text whose WordPiece tokens stay under a limit, overlapping."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from .represent import _rows

#: Tokens of a passage with the two that stand around it, its runes, runes that passages share, runes of a word that is looked up.
TOKENS, RUNES, OVERLAP, WORD = 256, 2048, 32, 100
_AROUND = 2


def _is_cjk(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0x20000 <= n <= 0x2CEAF or 0xF900 <= n <= 0xFAFF or 0x2F800 <= n <= 0x2FA1F


def _normal(c: str) -> tuple[str, bool]:
    """What a character becomes, and whether it is a word of its own; white space becomes a blank."""
    if c in "\t\n\r" or unicodedata.category(c) == "Zs" or c.isspace() and unicodedata.category(c)[0] != "C":
        return " ", False
    if c in "\0�" or unicodedata.category(c)[0] == "C":
        return "", False
    plain = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn").lower()
    alone = _is_cjk(c) or bool(plain) and all(unicodedata.category(x)[0] == "P" or x in "$+<=>^`|~" for x in plain)
    return plain, alone


class WordPiece:
    """Greedy longest matches over a trie of a vocabulary, whose pieces within a word begin with ##."""

    def __init__(self, vocabulary: Iterable[str]):
        self.first, self.rest = {}, {}
        for piece in vocabulary:
            node = self.rest if piece.startswith("##") else self.first
            for c in piece.removeprefix("##"):
                node = node.setdefault(c, {})
            node[""] = True
        self.known: dict[str, int] = {}
        self.normal: dict[str, tuple[str, bool]] = {}

    def size(self, word: str) -> int:
        """Tokens of a normalised word: 1 for one that is too long or that no pieces make up."""
        if (found := self.known.get(word)) is not None:
            return found
        at, count = 0, 0
        while at < len(word) <= WORD:
            node, end = self.rest if at else self.first, 0
            for k in range(at, len(word)):
                node = node.get(word[k])
                if node is None:
                    break
                if "" in node:
                    end = k + 1
            if not end:
                count = 0
                break
            at, count = end, count + 1
        if len(self.known) > 500_000:
            self.known.clear()
        self.known[word] = max(1, count)
        return self.known[word]

    def sizes(self, text: str) -> list[int]:
        """Tokens of each prefix of ``text``, from the empty one on."""
        out, done, word = [0], 0, ""
        for c in text:
            plain, alone = self.normal.get(c) or self.normal.setdefault(c, _normal(c))
            if alone:
                done += (self.size(word) if word else 0) + (1 if len(plain) == 1 else len(plain))
                word = ""
            elif plain == " ":
                done += self.size(word) if word else 0
                word = ""
            else:
                word += plain
            out.append(done + (self.size(word) if word else 0))
        return out

    def chunks(self, text: str) -> list[tuple[int, int, str]]:
        """(first byte, end byte, text) of passages of at most TOKENS tokens and RUNES runes. A cut goes behind the last white space of
        the final quarter; the next passage begins OVERLAP runes before it. Blank ones are dropped."""
        out, start, n, at, counted = [], 0, len(text), 0, 0
        while start < n:
            window = text[start : start + RUNES]
            sizes = self.sizes(window)
            low, high = 1, len(window)
            while low < high:  # prefixes of words can have more tokens than the words, so this looks where a search looks
                middle = (low + high + 1) // 2
                if sizes[middle] + _AROUND <= TOKENS:
                    low = middle
                else:
                    high = middle - 1
            end = start + low
            if end < n:
                end = next((k for k in range(end, start + (end - start) * 3 // 4, -1) if text[k - 1].isspace()), end)
            piece = text[start:end]
            at, counted = at + len(text[counted:start].encode("utf-8", "surrogatepass")), start
            if piece.strip():
                out.append((at, at + len(piece.encode("utf-8", "surrogatepass")), piece))
            if end == n:
                break
            start = end - OVERLAP if end - OVERLAP > start else end
        return out


def read_vocabulary(lines: str) -> list[str]:
    """A piece a line."""
    return [x for x in re.split(r"\r?\n", lines) if x]


def chunks(texts: Column, vocabulary: list[str]) -> Column:
    """Arrays of start, end and text; the trie is made once a worker process."""
    made: list[WordPiece] = []

    def run(batch: pd.Series) -> pd.Series:
        if not made:
            made.append(WordPiece(vocabulary))
        return batch.map(lambda t: made[0].chunks(t or ""))

    return F.pandas_udf(run, _rows(start=IntegerType(), end=IntegerType(), text=StringType()))(texts)
