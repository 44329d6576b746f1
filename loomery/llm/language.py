"""Language identification by rank-order profiles of character n-grams (out-of-place distance)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: n-grams in a profile.
TOP = 300
#: Documents of a language that its profile is learned from, about.
SAMPLE = 1500
_SPACE = 32
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _letters


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of 1 to 3 characters of a whole text, 21 bits each, and their counts. Letters are lower-cased,
    a run of others is one space, and so are the ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    c = np.where(_is_letter()[c], c, _SPACE)
    c = np.concatenate(([_SPACE], c, [_SPACE])).astype(np.int64)
    c = c[np.concatenate(([True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)))]
    two = (c[:-1] << 21) | c[1:]
    return np.unique(np.concatenate((c[c != _SPACE], two, (two[:-1] << 21) | c[2:])), return_counts=True)


def profile(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The most frequent first; of equally frequent ones the smaller code."""
    return codes[np.argsort(-counts, kind="stable")[:TOP]]


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for lang, texts in f.groupby("lang")["text"]:
            parts = [grams(t) for t in texts]
            codes, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
            yield pd.DataFrame({"lang": lang, "gram": codes, "n": n})


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """Profiles by language, from the rows with a lang and text: about ``sample`` a language, by a hash of doc_id."""
    rows = docs.select("doc_id", F.col("text").alias("text"), F.col("lang").alias("lang")).where("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row a language
    if not sizes:
        return {}
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, sample / n) * (1 << 30)))))
    rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")))
    counts = rows.select("lang", "text").mapInPandas(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= TOP).orderBy("lang", "rank").collect()  # TOP a language
    out: dict[str, list[int]] = {}
    for r in top:
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64) for k, v in out.items()}


def nearest(text: str | None, profiles: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[str, float]:
    """profiles: language, its n-grams sorted by code, the rank of each. Ties go to the first language by name."""
    if text is None or not any(ch.isalpha() for ch in text):
        return "und", 0.0
    own = profile(*grams(text))
    place, best = np.arange(len(own)), ("und", float("inf"))
    for lang, codes, ranks in profiles:
        at = np.minimum(np.searchsorted(codes, own), len(codes) - 1)
        far = np.where(codes[at] == own, np.abs(ranks[at] - place), TOP).sum()
        if far < best[1]:
            best = (lang, float(far))
    return best[0], max(0.0, 1.0 - best[1] / (TOP * len(own))) if profiles else 0.0


def identified(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (1: same ranks, 0: nothing in common) to the columns of ``docs``.

    ``und`` with score 0 for null texts, texts without a letter, and when nothing was learned. Repeated rows get
    equal results; columns of the added names are replaced, others pass untouched.
    """
    order = []
    for lang in sorted(profiles):
        by = np.argsort(profiles[lang])
        order.append((lang, profiles[lang][by], by))
    shared = docs.sparkSession.sparkContext.broadcast(order)  # TOP numbers a language

    @F.pandas_udf("lang string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([nearest(t, shared.value) for t in texts], columns=["lang", "score"])

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.withColumn("predicted_language", predict("text"))
    return out.select(*kept, F.col("predicted_language.lang").alias("lang_pred"), F.col("predicted_language.score").alias("score"))
