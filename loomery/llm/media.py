"""Baseline JPEG in columns: files written and read without loss of a payload, dimensions, thumbnails and their hashes.

``stored`` writes a payload as the quantised coefficients of an image: a byte less 128 a coefficient, 64 of them a block in
zigzag order, a luminance and two chroma blocks a minimum coded unit (192 bytes), with a restart marker after each unit.

``media_columns`` reads any baseline file (sequential, Huffman coded, 8 bits): markers, tables, several scans, subsampled
components, restart intervals. The stretches between restart markers don't hang on each other, so those of all files of a
batch are decoded side by side: a step decodes the next code of each in numpy. A file without restart markers is one such
stretch, and so takes as many steps as it has codes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, UNIT = 64, 192
#: Bytes of payload, or of files, that are worked on at a time (a larger one alone).
BATCH = 2 << 20
#: Quantisation steps of what is written: the mean of a block, so that a sample of the thumbnail is a byte of the payload, and the rest.
STEP_DC, STEP_AC = 8, 1


class BadMedia(ValueError):
    """Bytes that aren't a whole baseline JPEG."""


# ---- codes


def _own_codes() -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    """Symbols by length of code. Sizes of means have 4 bits; so have coefficients after no zero, and the rest 8."""
    short = list(range(1, 9))
    rest = [0x00, 0xF0] + [run << 4 | size for run in range(1, 16) for size in range(1, 9)]
    return {4: list(range(12))}, {4: short, 8: rest}


def _canonical(symbols: dict[int, list[int]]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length): codes count up within a length, and double from one to the next."""
    out, code = {}, 0
    for length in range(1, 17):
        for s in symbols.get(length, ()):
            if code >> length:
                raise BadMedia("more codes than fit their length")
            out[s] = code, length
            code += 1
        code <<= 1
    return out


#: Parts of an entry of a lookup table: bits taken, coefficients stepped over, kind; above them the value.
_TAKEN, _SKIP, _KIND, _VALUE = 0, 5, 12, 14
#: A coefficient; nothing to write (end of block, 16 zeros); a value that reaches beyond 16 bits; no such code.
_COEFFICIENT, _NOTHING, _LONG, _BAD = range(4)


def _lookup(symbols: dict[int, list[int]], means: bool) -> np.ndarray:
    """For the next 16 bits what the code that they begin with says, with its value where it lies within them. Of long ones
    the value is the size, and the bits are those of the code."""
    out = np.full(1 << 16, _BAD << _KIND, np.int32)
    for s, (code, length) in _canonical(symbols).items():
        run, size, most = s >> 4, s & 15, 11 if means else 10
        if size > most or means and run or not size and not means and run not in (0, 15):
            continue
        here = slice(code << 16 - length, code + 1 << 16 - length)
        if not size and not means:
            out[here] = length | (64 if not run else 16) << _SKIP | _NOTHING << _KIND
        elif length + size > 16:
            out[here] = length | run << _SKIP | _LONG << _KIND | size << _VALUE
        else:
            raw = np.repeat(np.arange(1 << size), 1 << 16 - length - size)
            out[here] = length + size | run << _SKIP | _COEFFICIENT << _KIND | _value(raw, size) << _VALUE
    return out


def _value(raw: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """The number that ``size`` bits stand for: those that begin with 0 are negative."""
    return np.where(raw < 1 << np.maximum(size - 1, 0), raw - (1 << size) + (np.asarray(size) >= 0), raw) * (np.asarray(size) > 0)


_DC, _AC = _own_codes()


def _tokens(symbols: dict[int, list[int]], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Code and bits of each value from -128 to 127 after ``run`` zeros, from the left of 16 bits; and their number."""
    codes, tokens, lengths = _canonical(symbols), np.zeros(256, np.uint16), np.zeros(256, np.uint8)
    for v in range(-128, 128):
        size = abs(v).bit_length()
        code, length = codes.get(run << 4 | size, (0, 0))
        lengths[v + 128] = length + size if length else 0
        tokens[v + 128] = (code << size | (v if v >= 0 else v + (1 << size) - 1)) << 16 - length - size if length else 0
    return tokens, lengths


_MEAN, _REST = _tokens(_DC, 0), [np.stack(x) for x in zip(*(_tokens(_AC, run) for run in range(16)), strict=True)]
_ZEROS, _END = (_canonical(_AC)[s] for s in (0xF0, 0x00))
_FITS = np.arange(16) < np.arange(17)[:, None]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _table(kind: int, symbols: dict[int, list[int]]) -> bytes:
    counts = bytes(len(symbols.get(n, ())) for n in range(1, 17))
    return bytes([kind << 4]) + counts + bytes(s for n in range(1, 17) for s in symbols.get(n, ()))


_HEAD = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\2\0\0\1\0\1\0\0") + _segment(0xDB, bytes([0, STEP_DC] + [STEP_AC] * 63))
_TABLES = _segment(0xC4, _table(0, _DC) + _table(1, _AC)) + _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))


# ---- writing


def padded(payload: bytes) -> bytes:
    """Blanks up to a positive multiple of UNIT."""
    return payload + b" " * (-len(payload) % UNIT if payload else UNIT)


def _grid(units: int) -> tuple[int, int]:
    """Columns and rows of a near square that holds ``units``."""
    columns = int(np.ceil(np.sqrt(units)))
    if columns > 65535 // 8:
        raise BadMedia("a payload has more units than an image may have")
    return columns, -(-units // columns)


def _entropy(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coded bytes of (units, 192) coefficients of -128 to 127, each plus 128, a restart marker after each unit; and where units end."""
    units, flat = len(values), values.reshape(-1)
    there = values != 128
    there[:, ::BLOCK] = True
    at = np.flatnonzero(there)
    v, is_mean = flat[at], at % BLOCK == 0
    token, length = _REST[0][0][v], _REST[1][0][v]
    token[is_mean], length[is_mean] = _MEAN[0][v[is_mean]], _MEAN[1][v[is_mean]]
    after = np.flatnonzero(np.diff(at) > 1) + 1
    after = after[~is_mean[after]]
    run = at[after] - at[after - 1] - 1
    token[after], length[after] = _REST[0][run % 16, v[after]], _REST[1][run % 16, v[after]]
    # Sixteen zeros each before a coefficient that follows more of them; the end of a block whose last coefficient is 0.
    zeros = np.repeat(after, run // 16)
    last = np.flatnonzero(np.append(is_mean[1:], True) & (at % BLOCK != BLOCK - 1)) + 1
    ends = np.searchsorted(at, np.arange(1, units + 1) * UNIT)
    bits = np.diff(np.concatenate(([0], np.cumsum(length, dtype=np.int64)[ends - 1])))
    bits += np.bincount(at[zeros] // UNIT, minlength=units) * _ZEROS[1] + np.bincount(at[last - 1] // UNIT, minlength=units) * _END[1]
    fill = -bits % 8
    where = np.concatenate((zeros, last, ends))
    more = [(np.full(len(zeros), c << 16 - n), np.full(len(zeros), n)) for c, n in [_ZEROS]] + [(np.full(len(last), c << 16 - n), np.full(len(last), n)) for c, n in [_END]]
    more.append(((1 << fill) - 1 << 16 - fill, fill))
    token, length = (np.insert(x, where, np.concatenate(y).astype(x.dtype)) for x, y in zip((token, length), zip(*more, strict=True), strict=True))
    wide = np.unpackbits(token.astype(">u2").view(np.uint8)).reshape(-1, 16)
    coded = np.packbits(wide[_FITS[length]])
    # 0 after each 255, then the marker that ends a unit.
    end = np.cumsum((bits + fill) // 8)
    stuffed = np.flatnonzero(coded == 255)
    out = np.insert(coded, np.concatenate((stuffed + 1, np.repeat(end, 2))), np.concatenate((np.zeros(len(stuffed), np.uint8), np.tile(np.uint8([255, 0]), units))))
    return out, end + np.searchsorted(stuffed, end) + 2 * np.arange(1, units + 1)


def encoded(payloads: list[bytes]) -> list[bytes]:
    """A file for each payload, whose lengths are multiples of UNIT."""
    grids = [_grid(len(p) // UNIT) for p in payloads]
    cells = [c * r for c, r in grids]
    values = np.full((sum(cells), UNIT), 128, np.uint8)
    begin = np.cumsum([0, *cells])
    for p, b in zip(payloads, begin, strict=False):
        values[b : b + len(p) // UNIT] = np.frombuffer(p, np.uint8).reshape(-1, UNIT)
    coded, ends = _entropy(values)
    out = []
    for i, (p, (columns, rows)) in enumerate(zip(payloads, grids, strict=True)):
        own = ends[begin[i] : begin[i + 1]]
        start = ends[begin[i] - 1] if begin[i] else 0
        coded[own - 1] = 0xD0 + np.arange(len(own)) % 8
        frame = _segment(0xC0, struct.pack(">BHHB", 8, rows * 8, columns * 8, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0]))
        length = _segment(0xFE, b"payload " + str(len(p)).encode())
        out.append(_HEAD + length + frame + _TABLES + coded[start : own[-1] - 2].tobytes() + b"\xff\xd9")
    return out


# ---- reading


@dataclass
class Scan:
    """components: (place in the frame, table of means, table of the rest); blocks a unit, units, and coded bytes."""

    components: list[tuple[int, np.ndarray, np.ndarray]]
    blocks: list[int]  # component of each block of a unit
    units: int
    interval: int
    data: np.ndarray  # without stuffing and markers
    starts: np.ndarray


@dataclass
class Image:
    width: int = 0
    height: int = 0
    frame: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, across, down, table of steps
    steps: dict[int, np.ndarray] = field(default_factory=dict)
    scans: list[Scan] = field(default_factory=list)
    payload: int | None = None

    def grid(self, i: int, whole: bool) -> tuple[int, int]:
        """Blocks across and down of a component; ``whole``: with those that fill up units."""
        across, down = (max(c[k] for c in self.frame) for k in (1, 2))
        _, h, v, _ = self.frame[i]
        if whole:
            return -(-self.width // (8 * across)) * h, -(-self.height // (8 * down)) * v
        return -(-(-(-self.width * h // across)) // 8), -(-(-(-self.height * v // down)) // 8)


def parsed(data: bytes) -> Image:
    """Markers, tables and the coded bytes of each scan."""
    try:
        return _parsed(data)
    except (IndexError, KeyError, struct.error, ZeroDivisionError) as e:
        raise BadMedia("a marker's segment is cut short or names a table that isn't there") from e


def _parsed(data: bytes) -> Image:
    if data[:2] != b"\xff\xd8":
        raise BadMedia("no start of an image")
    image, at, interval = Image(), 2, 0
    tables: dict[int, np.ndarray] = {}
    raw = np.frombuffer(data, np.uint8)
    high = np.flatnonzero(raw[:-1] == 255)
    after = raw[high + 1]
    marks = high[(after != 0) & (after != 255) & ((after < 0xD0) | (after > 0xD7))]
    while True:
        if at + 2 > len(data) or data[at] != 255:
            raise BadMedia("no marker where one must be")
        while data[at + 1] == 255:  # fill bytes
            at += 1
        marker = data[at + 1]
        at += 2
        if marker == 0xD9:
            break
        (size,) = struct.unpack_from(">H", data, at)
        body = data[at + 2 : at + size]
        if size < 2 or len(body) < size - 2:
            raise BadMedia("a segment is cut short")
        at += size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                found = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                if len(found) < 64:
                    raise BadMedia("a table of steps is cut short")
                image.steps[body[0] & 15] = found.astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = 17 + sum(body[1:17])
                if len(body) < n:
                    raise BadMedia("a table of codes is cut short")
                tables[body[0]] = _read_table(body[1:n], body[0] < 16)
                body = body[n:]
        elif marker == 0xC0 or marker == 0xC1:
            depth, image.height, image.width, n = struct.unpack_from(">BHHB", body)
            image.frame = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if depth != 8 or not image.width or not image.height or not n or any(not 1 <= x <= 4 for c in image.frame for x in c[1:3]):
                raise BadMedia("not 8 bits, no size, or odd components")
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise BadMedia("not baseline")
        elif marker == 0xDD:
            (interval,) = struct.unpack_from(">H", body)
        elif marker == 0xFE and body.startswith(b"payload ") and body[8:].isdigit():
            image.payload = int(body[8:])
        elif marker == 0xDA:
            ids = [c[0] for c in image.frame]
            named = [(ids.index(body[1 + 2 * i]) if body[1 + 2 * i] in ids else -1, body[2 + 2 * i]) for i in range(body[0])]
            if not named or any(i < 0 for i, _ in named):
                raise BadMedia("a scan of components that no frame has")
            k = np.searchsorted(marks, at)
            if k == len(marks):
                raise BadMedia("a scan without end")
            end = int(marks[k])
            image.scans.append(_scan(image, [(i, tables[t >> 4], tables[16 | t & 15]) for i, t in named], interval, raw[at:end]))
            at = end
    if not image.frame or {c[0] for s in image.scans for c in s.components} != set(range(len(image.frame))):
        raise BadMedia("not every component has a scan")
    return image


@lru_cache(64)
def _read_table(counts_and_symbols: bytes, means: bool) -> np.ndarray:
    counts, symbols, k = counts_and_symbols[:16], {}, 16
    for length, many in enumerate(counts, 1):
        symbols[length] = list(counts_and_symbols[k : k + many])
        k += many
    return _lookup(symbols, means)


def _scan(image: Image, components: list, interval: int, raw: np.ndarray) -> Scan:
    if len(components) == 1:
        across, down = image.grid(components[0][0], False)
        blocks, units = [0], across * down
    else:
        blocks = [k for k, (i, _, _) in enumerate(components) for _ in range(image.frame[i][1] * image.frame[i][2])]
        across, down = image.grid(components[0][0], True)
        _, h, v, _ = image.frame[components[0][0]]
        units = across * down // (h * v)
    high = np.flatnonzero(raw[:-1] == 255)
    mark = high[(raw[high + 1] >= 0xD0) & (raw[high + 1] <= 0xD7)]
    drop = np.concatenate((high[raw[high + 1] == 0] + 1, mark, mark + 1))
    keep = np.ones(len(raw), bool)
    keep[drop] = False
    starts = np.concatenate(([0], mark - np.searchsorted(np.sort(drop), mark)))
    need = -(-units // interval) if interval else 1
    if len(starts) != need:
        raise BadMedia("restart markers don't fit the interval")
    return Scan(components, blocks, units, interval or units, raw[keep], starts)


def _decoded(scans: list[Scan]) -> tuple[list[np.ndarray], np.ndarray]:
    """Coefficients (blocks, 64; zigzag order) of each scan, and whether its codes were whole."""
    tables = {id(t): t for s in scans for _, *own in s.components for t in own}
    row = {x: i for i, x in enumerate(tables)}
    most = max(len(s.blocks) for s in scans)
    plan = np.zeros((2, len(scans), most), np.int64)  # tables of means and of the rest, by block of a unit
    for i, s in enumerate(scans):
        each = [(row[id(dc)], row[id(ac)]) for _, dc, ac in s.components]
        for b, c in enumerate(s.blocks):
            plan[:, i, b] = each[c]
    lookup = np.concatenate([*tables.values()])
    per, bytes_before = np.array([len(s.blocks) for s in scans]), np.cumsum([0, *(len(s.data) for s in scans)])
    blocks_before = np.cumsum([0, *(s.units * len(s.blocks) for s in scans)])
    owner = np.repeat(np.arange(len(scans)), [len(s.starts) for s in scans])
    start = np.concatenate([s.starts + b for s, b in zip(scans, bytes_before, strict=False)])
    first = np.concatenate([np.arange(len(s.starts)) * s.interval for s in scans])
    interval, units = (np.array([getattr(s, x) for s in scans])[owner] for x in ("interval", "units"))
    left = np.minimum(interval, units - first) * per[owner]
    stop = np.append(start[1:], bytes_before[-1]) * 8
    data = np.concatenate([*(s.data for s in scans), np.zeros(32, np.uint8)]).astype(np.uint32)
    window = data[:-3] << 24 | data[1:-2] << 16 | data[2:-1] << 8 | data[3:]
    values = np.zeros(blocks_before[-1] * BLOCK, np.int16)
    whole = np.ones(len(scans), bool)
    small = np.int32 if max(len(values), 8 * len(data)) < 2**31 else np.int64
    out = ((blocks_before[owner] + first * per[owner]) * BLOCK).astype(small)
    place, stop, left = (start * 8).astype(small), stop.astype(small), left.astype(small)
    k, b = np.zeros(len(start), small), np.zeros(len(start), small)
    dc, ac = ((plan[x, owner, 0] << 16).astype(small) for x in (0, 1))
    while len(place):
        bits = window[place >> 3] << (place & 7).astype(np.uint32) >> 16
        code = lookup[np.where(k == 0, dc, ac) + bits.astype(small)]
        kind = code >> _KIND & 3
        value, step = code >> _VALUE, code >> _SKIP & 127
        place += code & 31
        if (odd := np.flatnonzero(kind == _LONG)).size:
            size = value[odd]
            far = (window[place[odd] >> 3].astype(np.uint64) << 32 | window[(place[odd] >> 3) + 4]) << (place[odd] & 7).astype(np.uint64)
            value[odd] = _value((far >> (64 - size).astype(np.uint64)).astype(np.int64), size)
            place[odd] += size
        at = k + step
        # Where nothing is written a 0 is, on a place that stays 0.
        values[out + np.minimum(at, BLOCK - 1) * (kind != _NOTHING)] += np.where(kind == _NOTHING, 0, value).astype(np.int16)
        k = at + (kind != _NOTHING)
        bad = (kind == _BAD) | (place > stop) | (k > BLOCK) & (kind != _NOTHING)
        over = np.flatnonzero(k >= BLOCK)
        if over.size:
            k[over] = 0
            out[over] += BLOCK
            left[over] -= 1
            own = owner[over]
            b[over] = (b[over] + 1) % per[own]
            dc[over], ac[over] = plan[:, own, b[over]] << 16
        if over.size and not left[over].all() or bad.any():
            whole[owner[bad]] = False
            stay = ~bad & (left > 0)
            place, k, b, left, out, owner, dc, ac, stop = (x[stay] for x in (place, k, b, left, out, owner, dc, ac, stop))
    values = values.reshape(-1, BLOCK)
    each = [values[i:j] for i, j in zip(blocks_before, blocks_before[1:], strict=False)]
    for s, v in zip(scans, each, strict=True):
        _summed(s, v)
    return each, whole


def _summed(scan: Scan, values: np.ndarray) -> None:
    """A mean is stored as its difference to the one before of its component since the last restart."""
    means = values[:, 0].astype(np.int64).reshape(scan.units, len(scan.blocks))
    for c in range(len(scan.components)):
        own = [b for b, x in enumerate(scan.blocks) if x == c]
        if scan.interval == len(own) == 1:
            continue
        total = means[:, own].reshape(-1).cumsum()
        begin = np.arange(scan.units) // scan.interval * scan.interval * len(own)
        total -= np.repeat(np.where(begin > 0, total[begin - 1], 0), len(own))
        means[:, own] = total.reshape(-1, len(own))
    values[:, 0] = means.reshape(-1)


def _thumbnail(image: Image, coefficients: list[np.ndarray]) -> np.ndarray:
    """The luminance of each block from its mean alone, 0 to 255."""
    k = next(k for k, s in enumerate(image.scans) if any(c[0] == 0 for c in s.components))
    scan, means = image.scans[k], coefficients[k][:, 0].astype(np.int64)
    across, down = image.grid(0, False)
    _, h, v, table = image.frame[0]
    if len(scan.components) > 1:
        place = next(j for j, c in enumerate(scan.components) if c[0] == 0)
        own = [b for b, c in enumerate(scan.blocks) if c == place]
        wide, high = image.grid(0, True)
        means = means.reshape(high // v, wide // h, len(scan.blocks))[:, :, own].reshape(high // v, wide // h, v, h)
        means = means.transpose(0, 2, 1, 3).reshape(high, wide)
    else:
        means = means.reshape(down, across)
    if table not in image.steps:
        raise BadMedia("a table of steps is missing")
    return np.clip((means[:down, :across] * int(image.steps[table][0]) + 4 >> 3) + 128, 0, 255).astype(np.uint8)


def difference_hash(thumbnail: np.ndarray) -> str:
    """64 bits: whether each of 8 by 8 fields is darker than that to its right (9 by 8 means of equal shares of the area)."""
    high, wide = thumbnail.shape
    sums = np.zeros((high + 1, wide + 1))
    sums[1:, 1:] = thumbnail.cumsum(0, dtype=np.int64).cumsum(1)
    down, across = np.linspace(0, high, 9), np.linspace(0, wide, 10)
    along = lambda a, at: a[np.floor(at).astype(int)] + (at % 1)[:, None] * (a[np.minimum(np.floor(at).astype(int) + 1, len(a) - 1)] - a[np.floor(at).astype(int)])
    fields = np.diff(np.diff(along(along(sums, down).T, across).T, axis=0), axis=1)
    return np.packbits(fields[:, :-1] < fields[:, 1:]).tobytes().hex()


def decoded(files: list[bytes]) -> list[dict]:
    """What each file holds; error says why one can't be read."""
    out: list[dict] = [{} for _ in files]
    images: dict[int, Image] = {}
    for i, data in enumerate(files):
        try:
            images[i] = parsed(data)
        except BadMedia as e:
            out[i] = {"error": str(e)}
    scans = [(i, s) for i, m in images.items() for s in m.scans]
    values, whole = _decoded([s for _, s in scans]) if scans else ([], [])
    for i, image in images.items():
        own = [k for k, (j, _) in enumerate(scans) if j == i]
        try:
            if not all(whole[k] for k in own):
                raise BadMedia("codes are cut short or aren't in their table")
            small = _thumbnail(image, [values[k] for k in own])
        except BadMedia as e:
            out[i] = {"error": str(e)}
            continue
        payload = None
        if image.payload is not None and len(own) == 1:
            payload = (values[own[0]].reshape(-1)[: image.payload] + 128).astype(np.uint8).tobytes()
        out[i] = {
            "width": image.width, "height": image.height, "components": len(image.frame), "thumbnail_width": small.shape[1], "thumbnail_height": small.shape[0],
            "thumbnail": small.tobytes(), "thumbnail_hash": difference_hash(small), "payload": payload,
        }
    return out


# ---- columns


def _bounded(values: list[bytes]) -> Iterator[tuple[int, int]]:
    begin = total = 0
    for i, v in enumerate(values):
        if total and total + len(v) > BATCH:
            yield begin, i
            begin, total = i, 0
        total += len(v)
    if values:
        yield begin, len(values)


def stored(rows: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """``rows`` with the file of each payload (binary; null: empty), which is filled up with blanks to a positive multiple of UNIT
    bytes. A payload of more than about 12 GB doesn't fit an image and fails; Spark holds at most 2 GB a value. Every row stays,
    repeated ones alike; the column ``media`` takes the place of one of that name."""
    rows = rows.drop(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [padded(x.as_py() or b"") for x in batch.column(payload)]
            for i, j in _bounded(found):
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(encoded(found[i:j]), pa.binary())], [*part.schema.names, media])

    return rows.mapInArrow(run, rows.withColumn(media, F.lit(b"")).schema)


_COLUMNS = "width int, height int, components int, thumbnail_width int, thumbnail_height int, thumbnail binary, thumbnail_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, error string"


def media_columns(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with what their files hold, in place of the column ``media`` and of columns of these names: width, height,
    components, the luminance thumbnail of a sample a block (thumbnail, its sizes and its hash), and of the payload, where
    ``stored`` has written it, its size, SHA-256 and the CRC-32 of its last 16 bytes. A file that isn't whole baseline JPEG, a null
    or an empty one has an error and nulls."""
    kinds = [c.split() for c in _COLUMNS.split(", ")]
    kept = [c for c in rows.columns if c != media and c not in {n for n, _ in kinds}]
    schema = rows.select(*kept, *(F.lit(None).cast(t).alias(n) for n, t in kinds)).schema
    arrow = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [x.as_py() or b"" for x in batch.column(media)]
            for i, j in _bounded(files):
                found = decoded(files[i:j])
                for f in found:
                    if (payload := f.get("payload")) is not None:
                        f |= {"payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-16:])}
                part = batch.slice(i, j - i)
                columns = [part.column(part.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array([f.get(n) for f in found], arrow[t]) for n, t in kinds)], [*kept, *(n for n, _ in kinds)])

    return rows.select(*kept, media).mapInArrow(run, schema)
