"""Document fingerprints by content-defined chunking with normalised gear-hash boundaries."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import in_order

#: Bytes of a chunk; up to NORMAL a boundary needs STRICT zero bits of the rolling hash, beyond it LOOSE ones.
LEAST, NORMAL, MOST, STRICT, LOOSE = 16, 64, 256, 8, 4
_GEAR = np.random.default_rng(9).integers(0, 2**32, 256, dtype=np.uint32)


def boundaries(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``. The hash covers the last 32 bytes, so boundaries find their place again after an edit."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    step = 1
    while step < 32:
        more = h.copy()
        more[step:] += h[:-step] << np.uint32(step)
        h, step = more, step * 2
    loose = np.flatnonzero((h >> np.uint32(32 - LOOSE)) == 0) + 1
    strict = (loose[(h[loose - 1] >> np.uint32(32 - STRICT)) == 0]).tolist()
    loose = loose.tolist()
    ends, start, n = [], 0, len(data)
    while n - start > LEAST:
        i = bisect_left(strict, start + LEAST)
        if i < len(strict) and strict[i] <= start + NORMAL:
            start = strict[i]
        else:
            i = bisect_left(loose, start + NORMAL + 1)
            start = min(loose[i] if i < len(loose) else n, start + MOST, n)
        ends.append(start)
    if start < n:
        ends.append(n)
    return ends


def fingerprint(text: str) -> dict[int, int]:
    """Digest of each distinct chunk and its length in bytes, in order of appearance. An empty text has none."""
    data = text.encode("utf-8", "surrogatepass")
    out, start = {}, 0
    for end in boundaries(data) if data else []:
        out[xxhash.xxh64_intdigest(data[start:end])] = end - start
        start = end
    return out


def containment(a: dict[int, int], b: dict[int, int]) -> float:
    """Share of the bytes in ``a``'s chunks that are in chunks of ``b``; of an empty one 1 in an empty one, else 0."""
    if not a:
        return float(not b)
    return sum(n for d, n in a.items() if d in b) / sum(a.values())


def shown(print_: dict[int, int]) -> str:
    return ",".join(f"{d:016x}:{n}" for d, n in print_.items())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


COLUMNS = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting = None  # (bucket, doc_id, text, fingerprint) of the row before
    for f in frames:
        out = []
        for doc_id, text, bucket, side in zip(f["doc_id"], f["text"], f["bucket"], f["side"], strict=True):
            if side < 0 or (side > 0 and (waiting is None or waiting[0] != bucket)):
                continue
            own = fingerprint(text)
            if waiting is not None and waiting[0] == bucket:
                _, before, t, p = waiting
                e = edited(t, text)
                q = fingerprint(e)
                out.append((before, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), shown(p), shown(q), containment(p, q), containment(p, own)))
            waiting = None if side > 0 else (bucket, doc_id, text, own)
        yield pd.DataFrame(out, columns=COLUMNS).astype({"doc_id": "Int64"})


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, a row for each row of ``docs``.

    The order is that of doc_id (rows without one first), among equal ones that of a hash of the text; the last is
    followed by the first, a single one by itself. Null texts are as empty ones. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("order_key", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    # Rows alike in both are numbered by nothing but their place, which doesn't show in the result.
    return in_order(rows, "order_key", "h", "text", wrap=True).select("doc_id", "text", "bucket", "side").mapInPandas(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
