"""Postings of units, made and dealt a batch of units at a time.

All postings of a unit come from its own row, so none is shuffled to be made. They are dealt by ranges of (term, unit): each task packs
what it has for a range into one compressed piece, and the range's task puts its pieces in order. A shuffled row is a piece, not a posting.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ``other``: how often the term stands in the unit's other column.
POSTING = "id string, repo string, number long, family string, length int, col string, term string, positions array<int>, other int"
_POSTING = pa.schema([
    ("id", pa.string()), ("repo", pa.string()), ("number", pa.int64()), ("family", pa.string()), ("length", pa.int32()), ("col", pa.string()),
    ("term", pa.string()), ("positions", pa.list_(pa.field("element", pa.int32()))), ("other", pa.int32()),
])
_UNIT = ["id", "repo", "number", "family", "length"]
_PIECE = "part int, unit_size long, units binary, term_size long, terms binary, sizes array<int>, numbers binary"
#: Words that a task turns into postings at a time, and rows that it gives back at a time.
WORDS, ROWS = 2_000_000, 20_000
#: Words of units, and keys a range, that are looked at to choose the ranges.
LOOKED, KEYS = 2_000_000, 100
#: Units that are looked at at least.
UNITS = 1000

Key = tuple[bytes, bytes]


@dataclass
class _Postings:
    """Postings by number: of a unit (row of ``units``), of a term (place in ``terms``), whether of the body, how often the term stands in
    the other column and in this one, and its places there, of all postings one after another."""

    units: pa.Table
    terms: pa.Array
    unit: np.ndarray
    term: np.ndarray
    body: np.ndarray
    other: np.ndarray
    times: np.ndarray
    places: np.ndarray

    def rows(self, order: np.ndarray) -> Iterator[pa.RecordBatch]:
        """As rows, ROWS at a time."""
        ends = np.cumsum(self.times, dtype=np.int64)
        for first in range(0, len(order), ROWS):
            at = order[first : first + ROWS]
            own = self.units.take(pa.array(self.unit[at]))
            places, offsets = _gathered(self.places, ends, self.times, at)
            parts = {c: own.column(c) for c in _UNIT} | {
                "col": pa.array(["title", "body"]).take(pa.array(self.body[at])), "term": self.terms.take(pa.array(self.term[at])),
                "positions": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(places, pa.int32())), "other": pa.array(self.other[at], pa.int32()),
            }
            yield from pa.table([parts[c].cast(_POSTING.field(c).type) for c in _POSTING.names], schema=_POSTING).combine_chunks().to_batches()


def _gathered(places: np.ndarray, ends: np.ndarray, times: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the postings ``at``, and where each one's begin."""
    n = times[at].astype(np.int64)
    offsets = np.r_[0, np.cumsum(n)]
    return places[np.repeat(ends[at] - n - offsets[:-1], n) + np.arange(offsets[-1])], offsets


def _sizes(units: pa.RecordBatch) -> list[np.ndarray]:
    return [pc.fill_null(pc.list_value_length(units.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("title", "body")]


def _of_units(units: pa.RecordBatch) -> _Postings:
    """Postings of units (id, repo, number, family, title, body; these two as words), by unit, column and term."""
    sizes = _sizes(units)
    words = pa.concat_arrays([units.column(c).flatten() for c in ("title", "body")]).dictionary_encode()
    code, n = words.indices.to_numpy().astype(np.int64), max(1, len(words.dictionary))
    unit = np.concatenate([np.repeat(np.arange(len(s)), s) for s in sizes])
    body = np.repeat([0, 1], [s.sum() for s in sizes])
    place = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) for s in sizes]).astype(np.int32)
    key = (unit * 2 + body) * n + code
    order = np.argsort(key, kind="stable")
    key, place = key[order], place[order]
    starts = np.flatnonzero(np.r_[len(key) > 0, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    times, first = np.diff(np.r_[starts, len(key)]).astype(np.int32), order[starts]
    unit, body, code = unit[first], body[first], code[first]
    other, pair = np.zeros(len(first), np.int32), unit * n + code
    a, b = np.flatnonzero(body == 0), np.flatnonzero(body == 1)
    _, at_a, at_b = np.intersect1d(pair[a], pair[b], assume_unique=True, return_indices=True)
    other[a[at_a]], other[b[at_b]] = times[b[at_b]], times[a[at_a]]
    table = pa.table({c: units.column(c) for c in _UNIT[:-1]} | {"length": pa.array(sum(sizes), pa.int32())})
    return _Postings(table, words.dictionary, unit.astype(np.int32), code.astype(np.int32), body.astype(np.int8), other, times, place)


def _of_rows(rows: pa.RecordBatch) -> _Postings:
    ids, terms = rows.column("id").dictionary_encode(), rows.column("term").dictionary_encode()
    unit = ids.indices.to_numpy() if not rows.column("id").null_count else np.arange(len(rows), dtype=np.int32)  # units without an id may differ
    _, first = np.unique(unit, return_index=True)
    table = pa.table({c: rows.column(c) for c in _UNIT}).take(pa.array(first))
    times = pc.list_value_length(rows.column("positions")).to_numpy()
    body = pc.equal(rows.column("col"), "body").to_numpy(zero_copy_only=False).astype(np.int8)
    return _Postings(table, terms.dictionary, unit, terms.indices.to_numpy(), body, rows.column("other").to_numpy(), times, rows.column("positions").flatten().to_numpy())


def _some(batches: Iterable[pa.RecordBatch], size: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of about WORDS words at a time, ``size`` a row."""
    held, words = [], 0
    for batch in batches:
        turn = (words + np.cumsum(size(batch))) // WORDS
        starts = [0, *(np.flatnonzero(np.diff(turn)) + 1)]
        for first, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if held and words + (first > 0) * WORDS >= WORDS:
                yield pa.concat_batches(held)
                held, words = [], 0
            held.append(batch.slice(first, end - first))
            words += int(size(held[-1]).sum())
    if held:
        yield pa.concat_batches(held)


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[_Postings]:
    return map(_of_units, _some(batches, lambda b: sum(_sizes(b))))


def _blocks_of_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[_Postings]:
    return map(_of_rows, _some(batches, lambda b: pc.list_value_length(b.column("positions")).to_numpy()))


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in _blocks(batches):
        yield from block.rows(np.arange(len(block.unit)))


def _words(units: DataFrame, tokens: Callable) -> DataFrame:
    return units.select("id", "repo", "number", "family", *(tokens(F.col(c)).alias(c) for c in ("title", "body")))


def of_units(units: DataFrame, tokens: Callable) -> DataFrame:
    """The postings of ``units`` (id, repo, number, family, title, body; each id once); ``tokens`` gives a text's words."""
    return _words(units, tokens).mapInArrow(_rows, POSTING)


def _rank(values: pa.Array) -> np.ndarray:
    """The rank of each of distinct values by bytes."""
    rank = np.empty(len(values), np.int64)
    rank[pc.sort_indices(values).to_numpy()] = np.arange(len(values))
    return rank


def _bytes(table: pa.Table) -> tuple[int, bytes]:
    raw = pa.concat_batches(table.combine_chunks().to_batches()).serialize()
    return raw.size, pa.compress(raw, "zstd", asbytes=True)


def _pieces(block: _Postings, bounds: list[Key]) -> Iterator[pa.RecordBatch]:
    """A piece for each range that ``block`` has postings in: those from one of ``bounds`` up to the next."""
    cuts, named = [b[0] for b in bounds], [t.encode() for t in block.terms.to_pylist()]
    low, high = (np.fromiter((f(cuts, t) for t in named), np.int64, len(named)) for f in (bisect_left, bisect_right))
    part, rank = low[block.term], _rank(block.terms)[block.term]
    split = np.flatnonzero(part < high[block.term])  # of terms that are cut by unit
    ids = [(x or "").encode() for x in block.units.column("id").to_pylist()] if len(split) else []
    for at, t, u in zip(split.tolist(), block.term[split].tolist(), block.unit[split].tolist(), strict=True):
        part[at] = bisect_right(bounds, (named[t], ids[u]), low[t], high[t])
    order, ends = np.argsort(part * max(1, len(named)) + rank, kind="stable"), np.cumsum(block.times, dtype=np.int64)
    starts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for first, end in zip(starts, [*starts[1:], len(order)], strict=True):
        at = order[first:end]
        units, unit = np.unique(block.unit[at], return_inverse=True)
        runs = np.flatnonzero(np.diff(block.term[at], prepend=-1))  # a term's postings stand together
        places, offsets = _gathered(block.places, ends, block.times, at)
        places = np.diff(places, prepend=0)
        numbers = [unit, np.diff(np.r_[runs, len(at)]), block.body[at], block.other[at], block.times[at], places]
        unit_size, packed = _bytes(block.units.take(pa.array(units)))
        term_size, terms = _bytes(pa.table({"term": block.terms.take(pa.array(block.term[at[runs]]))}))
        whole = pa.compress(b"".join(x.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in numbers), "zstd", asbytes=True)  # bytes of a kind together
        row = {"part": [part[at[0]]], "unit_size": [unit_size], "units": [packed], "term_size": [term_size], "terms": [terms], "sizes": [[len(x) for x in numbers]], "numbers": [whole]}
        yield pa.record_batch([pa.array(row[f.name], f.type) for f in _PIECE_ARROW], schema=_PIECE_ARROW)


_PIECE_ARROW = pa.schema([
    ("part", pa.int32()), ("unit_size", pa.int64()), ("units", pa.binary()), ("term_size", pa.int64()), ("terms", pa.binary()),
    ("sizes", pa.list_(pa.field("element", pa.int32()))), ("numbers", pa.binary()),
])
_UNITS_ARROW = pa.schema([_POSTING.field(c) for c in _UNIT])
_TERMS_ARROW = pa.schema([_POSTING.field("term")])


def _unpacked(piece: dict) -> _Postings:
    read = lambda raw, size, schema: pa.Table.from_batches([pa.ipc.read_record_batch(pa.decompress(raw, size, "zstd"), schema)])
    raw, at, numbers = np.frombuffer(pa.decompress(piece["numbers"], 4 * sum(piece["sizes"]), "zstd", asbytes=True), np.uint8), 0, []
    for n in piece["sizes"]:
        numbers.append(np.ascontiguousarray(raw[at : at + 4 * n].reshape(4, n).T).view("<i4").ravel())
        at += 4 * n
    unit, runs, body, other, times, places = numbers
    terms = read(piece["terms"], piece["term_size"], _TERMS_ARROW).column("term").combine_chunks()
    return _Postings(read(piece["units"], piece["unit_size"], _UNITS_ARROW), terms, unit, np.repeat(np.arange(len(runs), dtype=np.int32), runs), body.astype(np.int8), other, times, np.cumsum(places, dtype=np.int32))


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The postings of one range."""
    pieces = [_unpacked(row) for batch in batches for row in batch.to_pylist()]
    if not pieces:
        return
    joined = lambda c: np.concatenate([getattr(p, c) for p in pieces])
    shifted = lambda c, size: np.concatenate([getattr(p, c) + np.int32(s) for p, s in zip(pieces, np.cumsum([0, *(size(p) for p in pieces[:-1])]), strict=True)])
    terms = pa.concat_arrays([p.terms for p in pieces]).dictionary_encode()
    units = pa.concat_tables([p.units for p in pieces]).combine_chunks()
    term, unit = terms.indices.to_numpy()[shifted("term", lambda p: len(p.terms))], shifted("unit", lambda p: len(p.units))
    whole = _Postings(units, terms.dictionary, unit, term, joined("body"), joined("other"), joined("times"), joined("places"))
    del pieces
    key = (_rank(whole.terms)[term] * max(1, len(units)) + _rank(pc.fill_null(units.column("id"), ""))[unit]) * 2 + whole.body
    yield from whole.rows(np.argsort(key, kind="stable"))


def _chosen(keys: DataFrame, words: int, files: int) -> list[Key]:
    """Bounds of ``files`` ranges, from the keys (term, id) of ``words`` words."""
    every = max(1, words // (KEYS * files))
    found = keys.where(F.pmod(F.xxhash64("term", "id"), F.lit(every)) == 0).distinct().collect()  # about KEYS a file
    found = sorted((r["term"].encode(), (r["id"] or "").encode()) for r in found)
    return sorted({found[len(found) * i // files] for i in range(1, files)}) if found else []


def _dealt(rows: DataFrame, blocks: Callable[[Iterable[pa.RecordBatch]], Iterator[_Postings]], bounds: list[Key]) -> DataFrame:
    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            yield from _pieces(block, bounds)

    parts = len(bounds) + 1
    return rows.mapInArrow(packed, _PIECE).repartitionById(parts, F.col("part")).mapInArrow(_in_order, POSTING)


def _ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        file = batch.column("file").dictionary_encode().indices.to_numpy()
        firsts = np.flatnonzero(np.diff(file, prepend=-1))
        lasts = np.r_[firsts[1:], len(file)][: len(firsts)] - 1
        parts = {"file": batch.column("file").take(pa.array(firsts)), "low": batch.column("term").take(pa.array(firsts)), "high": batch.column("term").take(pa.array(lasts))}
        yield pa.RecordBatch.from_pydict(parts)


def ends(postings: DataFrame) -> DataFrame:
    """(file, low, high): the lowest and highest term of each file of ``postings`` (file, term), which are in order within it. Batches
    are narrowed first, since Spark finds the least string by sorting."""
    return postings.mapInArrow(_ends, "file string, low string, high string").groupBy("file").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def dealt_of_units(units: DataFrame, tokens: Callable, files: int, size: int, words: int) -> DataFrame:
    """The postings of ``size`` units of ``words`` words in about ``files`` partitions, ranges of (term, id), in order within each."""
    bounds: list[Key] = []
    if files > 1:
        every = max(1, min(words // LOOKED, size // UNITS))
        some = units.where(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(every)) == 0)
        bounds = _chosen(of_units(some, tokens).select("term", "id"), words // every, files)
    return _dealt(_words(units, tokens), _blocks, bounds)


def dealt(postings: DataFrame, files: int, words: int) -> DataFrame:
    """``postings`` in about ``files`` partitions, ranges of (term, id), in order within each."""
    bounds = _chosen(postings.select("term", "id"), words, files) if files > 1 else []
    return _dealt(postings.select(*_POSTING.names), _blocks_of_rows, bounds)
