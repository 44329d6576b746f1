"""Results for people and programs."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from datetime import date, datetime

from pyspark.sql import DataFrame


def _plain(x):
    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (bytes, bytearray)):
        return x.hex()
    raise TypeError(type(x).__name__)


def as_json(rows: DataFrame, **envelope) -> str:
    """One object: the rows of a page under ``rows``, and what goes with them."""
    return json.dumps({"rows": [r.asDict(recursive=True) for r in rows.collect()], **envelope}, default=_plain, ensure_ascii=False)


def as_text(rows: DataFrame, width: int = 100) -> Iterator[str]:
    """A line a row: its columns by tabs, line breaks as spaces, cut to ``width``."""
    yield "\t".join(rows.columns)
    for r in rows.toLocalIterator():
        yield "\t".join(" ".join(str("" if x is None else x).split())[:width] for x in r)


def written(rows: DataFrame, how: str = "auto", out=sys.stdout, **envelope) -> None:
    """``auto``: text on a terminal, else JSON."""
    if how not in ("auto", "json", "text"):
        raise ValueError("output is auto, json or text")
    if how == "json" or how == "auto" and not out.isatty():
        out.write(as_json(rows, **envelope) + "\n")
    else:
        out.writelines(line + "\n" for line in as_text(rows))
