"""Kernels over Arrow arrays of tagged geometries.

Bounding boxes of points, lines and simple polygons are read for all rows of the
same layout at once; only what a box cannot decide is decoded row by row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geolith.geo import build, codec, relate, text
from geolith.geo.model import COLLECTION, LINESTRING, MULTIPOINT, NAMES, POINT, POLYGON, Dialect, Geometry, GeometryError

MAX = float(np.finfo(np.float64).max)
BOX = pa.struct([pa.field(n, pa.float64(), False) for n in ("xmin", "ymin", "xmax", "ymax")])

decode = lru_cache(4096)(codec.decode)


def _binary(values: pa.Array) -> pa.Array:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.cast(pa.binary()) if values.type != pa.binary() else values


def _layout(values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Data bytes, where each row begins, and its length (-1: null)."""
    values = _binary(values)
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    size = np.diff(at)
    if values.null_count:
        size[values.is_null().to_numpy(zero_copy_only=False)] = -1
    return np.frombuffer(data or b"", np.uint8), at[:-1], size


def _alike(values: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Rows, their bytes as a matrix, where their coordinates begin and their SRID if they have one (0: none).

    Points, lines and polygons of one ring, little-endian, in the first two dialects,
    whose counts fit their length; rows of the same length and type at once.
    """
    data, at, size = _layout(values)
    for n in np.unique(size):
        if n < 10:
            continue
        rows = np.flatnonzero(size == n)
        for lo in range(0, len(rows), 1 << 16):
            part = rows[lo : lo + (1 << 16)]
            raw = data[at[part][:, None] + np.arange(n)]
            same = (raw[:, 0] <= 2) & (raw[:, 0] >= 1) & (raw[:, 1] == 1) & (raw[:, 3] == 0) & (raw[:, 4] == 0)
            for kind in (1, 2, 3):
                for flag in (0, 0x20):
                    on = np.flatnonzero(same & (raw[:, 2] == kind) & (raw[:, 5] == flag))
                    skip = 6 + 4 * (flag == 0x20)
                    start = skip + (0, 0, 4, 8)[kind]
                    points = (n - start) // 16
                    if not len(on) or n <= start or (n - start) % 16 or (kind == 1 and points != 1):
                        continue
                    if kind > 1:
                        good = raw[on, start - 4 : start].copy().view("<u4")[:, 0] == points
                        if kind == 3:
                            good &= raw[on, skip : skip + 4].copy().view("<u4")[:, 0] == 1
                        on = on[good]
                    if len(on):
                        yield part[on], raw[on], start, 6 if flag else 0


def _xy(raw: np.ndarray, start: int) -> np.ndarray:
    """The coordinates: rows, points, two."""
    return raw[:, start:].copy().view("<f8").reshape(len(raw), -1, 2)


def boxes(values: pa.Array) -> np.ndarray:
    """Rows of xmin, ymin, xmax, ymax; NaN where the geometry is null or empty."""
    values = _binary(values)
    out = np.full((len(values), 4), np.nan)
    rest = values.is_valid().to_numpy(zero_copy_only=False).copy()
    for rows, raw, start, _ in _alike(values):
        xy = _xy(raw, start)
        with np.errstate(invalid="ignore"):
            out[rows] = np.concatenate([xy.min(axis=1), xy.max(axis=1)], axis=1)
        rest[rows] = False
    for k in np.flatnonzero(rest):
        box = decode(values[int(k)].as_py()).bounds()
        if box is not None:
            out[k] = box
    return out


def _rest(values: pa.Array, done: np.ndarray, out: list, f: Callable[[int, Geometry], object]) -> list:
    """``out`` with ``f`` of the rows that aren't done and not null."""
    for k in np.flatnonzero(~done & values.is_valid().to_numpy(zero_copy_only=False)).tolist():
        out[k] = f(k, decode(values[k].as_py()))
    return out


def _moved(values: pa.Array, move: Callable[[np.ndarray, np.ndarray], np.ndarray], one: Callable[[int, Geometry], Geometry]) -> pa.Array:
    """Geometries with their coordinates changed, without SRID: of rows alike at once by ``move(rows, xy)``, of others by ``one``."""
    values = _binary(values)
    out, done = [None] * len(values), np.zeros(len(values), bool)
    for rows, raw, start, at in _alike(values):
        xy = _xy(raw, start)
        full = ~np.isnan(xy).any(axis=(1, 2))  # empty points are written in one way
        rows, raw, xy = rows[full], raw[full], xy[full]
        if not len(rows):
            continue
        new = np.ascontiguousarray(move(rows, xy), "<f8").reshape(len(rows), -1).view(np.uint8)
        head = np.array([Dialect.EWKB, 1, raw[0, 2], 0, 0, 0], np.uint8)
        counts = raw[:, at + 4 if at else 6 : start]
        for k, r in zip(rows.tolist(), np.concatenate([np.broadcast_to(head, (len(rows), 6)), counts, new], axis=1)):
            out[k] = r.tobytes()
        done[rows] = True
    return pa.array(_rest(values, done, out, lambda k, g: codec.encode(one(k, g))), pa.binary())


def _head(kind: int, raw: np.ndarray, at: int, *counts: int) -> np.ndarray:
    """The bytes before the coordinates of geometries that keep their rows' SRIDs, in the second dialect."""
    head = np.frombuffer(struct.pack("<BBI", Dialect.EWKB, 1, kind | (0x20000000 if at else 0)), np.uint8)
    counts = np.frombuffer(struct.pack(f"<{len(counts)}I", *counts), np.uint8)
    wide = lambda b: np.broadcast_to(b, (len(raw), len(b)))
    return np.concatenate([wide(head), raw[:, at : at + 4 if at else 0], wide(counts)], axis=1)


def _fill(out: list, rows: np.ndarray, head: np.ndarray, xy: np.ndarray) -> None:
    """Values of heads and coordinates, put into their rows."""
    xy = np.ascontiguousarray(xy, "<f8").reshape(len(rows), -1).view(np.uint8) if xy.size else np.empty((len(rows), 0), np.uint8)
    n, data = head.shape[1] + xy.shape[1], np.concatenate([head, xy], axis=1).tobytes()
    for k, lo in zip(rows.tolist(), range(0, len(data), n)):
        out[k] = data[lo : lo + n]


def box_array(found: np.ndarray) -> pa.Array:
    none = np.isnan(found).any(axis=1)
    return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(4)], fields=list(BOX), mask=pa.array(none))


def _once(f: Callable) -> Callable:
    """``f`` that works once for the arguments that rows of a batch share; what it holds is no more than the batch and its results."""
    return lru_cache(None)(f)


#: Between, before and after the coordinates of a pair, and around the pairs of a point, line, ring or multiple point.
_WKT = " ", "", "", {POINT: ("POINT(", ")"), LINESTRING: ("LINESTRING(", ")"), POLYGON: ("POLYGON((", "))"), MULTIPOINT: ("MULTIPOINT(", ")")}
_JSON = ",", "[", "]", {k: (f'{{"type": "{NAMES[k]}", "coordinates": ' + "[" * n, "]" * n + "}") for k, n in ((POINT, 0), (LINESTRING, 1), (POLYGON, 2), (MULTIPOINT, 1))}


def _points_of(values: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray | None]]:
    """Kind, rows, coordinates and SRIDs of rows alike, multiple points too; empty points are left out."""
    for rows, raw, start, at in _alike(values):
        xy = _xy(raw, start)
        full = ~np.isnan(xy).any(axis=(1, 2))
        yield int(raw[0, 2]), rows[full], xy[full], raw[full][:, at : at + 4].copy().view("<i4")[:, 0] if at else None
    data, first, size = _layout(values)
    for n in np.unique(size[size > 30]):
        for at in (0, 6):
            start = 10 + 4 * (at > 0)
            if (n - start) % 21:
                continue
            rows = np.flatnonzero(size == n)
            head = data[first[rows][:, None] + np.arange(start)]
            rows = rows[((head[:, 0] == 1) | (head[:, 0] == 2)) & (head[:, 1:6] == [1, MULTIPOINT, 0, 0, 0x20 if at else 0]).all(axis=1)]
            for lo in range(0, len(rows), 1 << 16):
                on = rows[lo : lo + (1 << 16)]
                raw = data[first[on][:, None] + np.arange(n)]
                parts = raw[:, start:].reshape(len(on), -1, 21)
                xy = parts[:, :, 5:].copy().view("<f8")
                good = (parts[:, :, :5] == [1, POINT, 0, 0, 0]).all(axis=(1, 2)) & ~np.isnan(xy).any(axis=(1, 2))
                good &= raw[:, start - 4 : start].copy().view("<u4")[:, 0] == parts.shape[1]
                yield MULTIPOINT, on[good], xy[good], raw[good][:, 6:10].copy().view("<i4")[:, 0] if at else None


def _digits(x: np.ndarray) -> pa.Array:
    """The texts of numbers; whole ones of up to 15 digits at once."""
    with np.errstate(invalid="ignore"):
        whole = (np.abs(x) < 1e15) & (x == np.rint(x)) & ~((x == 0) & np.signbit(x))
    found = pa.array(np.where(whole, x, 0).astype(np.int64)).cast(pa.string())
    return found if whole.all() else pc.replace_with_mask(found, pa.array(~whole), pa.array([text.number(v) for v in x[~whole].tolist()], pa.string()))


def _texts(values: pa.Array, form: tuple, one: Callable[[Geometry], str], with_srid: bool = False) -> pa.Array:
    values = _binary(values)
    between, opened, closed, around = form
    out, done = np.full(len(values), None, object), np.zeros(len(values), bool)
    for kind, rows, xy, srids in _points_of(values):
        n = xy.shape[1]
        if not len(rows) or n > 64:  # a list of columns for each point
            continue
        digits = _digits(xy.transpose(1, 2, 0).ravel())
        column = lambda k: digits.slice(k * len(rows), len(rows))
        pieces = [pa.array(srids).cast(pa.string())] if with_srid and srids is not None else []
        pieces = ["SRID=", *pieces, ";"] if pieces else []
        pieces.append(around[kind][0])
        for k in range(n):
            pieces += [opened if k == 0 else "," + opened, column(2 * k), between, column(2 * k + 1), closed]
        out[rows] = pc.binary_join_element_wise(*pieces, around[kind][1], "").to_numpy(zero_copy_only=False)
        done[rows] = True
    return pa.array(_rest(values, done, out, lambda k, g: one(g)), pa.string())


def as_text(values: pa.Array) -> pa.Array:
    return _texts(values, _WKT, text.to_wkt)


def as_ewkt(values: pa.Array) -> pa.Array:
    return _texts(values, _WKT, text.to_ewkt, True)


def as_geojson(values: pa.Array) -> pa.Array:
    return _texts(values, _JSON, text.to_geojson)


def geometry_type(values: pa.Array) -> pa.Array:
    values = _binary(values)
    out, done = np.full(len(values), None, object), np.zeros(len(values), bool)
    for rows, raw, _, _ in _alike(values):
        out[rows], done[rows] = "ST_" + NAMES[int(raw[0, 2])], True
    return pa.array(_rest(values, done, out, lambda k, g: "ST_" + NAMES[g.kind]), pa.string())


def srid(values: pa.Array) -> pa.Array:
    values = _binary(values)
    out, done = np.full(len(values), None, object), np.zeros(len(values), bool)
    for rows, raw, _, at in _alike(values):
        if at:
            out[rows] = raw[:, at : at + 4].copy().view("<i4")[:, 0]
        done[rows] = True
    return pa.array(_rest(values, done, out, lambda k, g: g.srid), pa.int32())


def box2d(values: pa.Array) -> pa.Array:
    return box_array(boxes(values))


def _srids(values: list[int | None] | None, n: int) -> list[int | None]:
    if values is None:
        return [None] * n
    for s in values:
        if s is None or not -(1 << 31) <= int(s) < 1 << 31:
            raise GeometryError(f"an SRID has to be a 32-bit integer, not {s}")
    return [int(s) for s in values]


#: Texts of one list of plain numbers, which are read at once; all others go to the parser.
_PAIR = r" ?-?[0-9]{1,17}(?:\.[0-9]{1,17})? -?[0-9]{1,17}(?:\.[0-9]{1,17})? ?"
_PLAIN = ((POINT, rf"^POINT ?\({_PAIR}\)$"), (LINESTRING, rf"^LINESTRING ?\({_PAIR}(?:,{_PAIR})+\)$"))


def _plain(values: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of texts of points and lines in plain numbers: kind, rows, and coordinates of rows of the same length."""
    for kind, form in _PLAIN:
        rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(values, form), False).to_numpy(zero_copy_only=False))
        if not len(rows):
            continue
        body = pc.replace_substring_regex(values.take(pa.array(rows)), r"^[A-Z]+ ?\( ?| ?\)$", "")
        words = pc.split_pattern(pc.replace_substring_regex(body, " ?, ?", " "), " ")
        flat, size = words.flatten().cast(pa.float64()).to_numpy(), pc.list_value_length(words).to_numpy()
        first = np.cumsum(size) - size
        for n in np.unique(size):
            on = np.flatnonzero(size == n)
            yield kind, rows[on], flat[first[on][:, None] + np.arange(n)]


def from_text(values: pa.Array, *with_srid: pa.Array) -> pa.Array:
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    srids = _srids(with_srid[0].to_pylist() if with_srid else None, len(values))
    tails = np.array(srids, "<i4").view(np.uint8).reshape(-1, 4) if with_srid else np.empty((len(values), 0), np.uint8)
    out, done = [None] * len(values), np.zeros(len(values), bool)
    for kind, rows, xy in _plain(values):
        head = np.concatenate([np.zeros((len(rows), 6), np.uint8), tails[rows]], axis=1)
        _fill(out, rows, _head(kind, head, 6 if with_srid else 0, *([] if kind == POINT else [xy.shape[1] // 2])), xy)
        done[rows] = True
    one = _once(lambda v, s: codec.encode(text.from_wkt(v).with_srid(s)))
    for k in np.flatnonzero(~done & values.is_valid().to_numpy(zero_copy_only=False)).tolist():
        out[k] = one(values[k].as_py(), srids[k])
    return pa.array(out, pa.binary())


def from_wkb(values: pa.Array, *with_srid: pa.Array) -> pa.Array:
    srids = _srids(with_srid[0].to_pylist() if with_srid else None, len(values))
    payloads = values.to_pylist()
    tagged = pa.array([None if v is None else b"\x02" + v for v in payloads], pa.binary())
    out, done = [None] * len(values), np.zeros(len(values), bool)
    for rows, raw, start, at in _alike(tagged):
        full = ~np.isnan(_xy(raw, start)).any(axis=(1, 2))
        for k, r in zip(rows[full].tolist(), raw[full]):
            s = srids[k]
            out[k] = r.tobytes() if s is None else b"\x02\x01" + struct.pack("<Ii", int(r[2]) | 0x20000000, s) + r[at + 4 if at else 6 :].tobytes()
        done[rows[full]] = True
    return pa.array(_rest(tagged, done, out, lambda k, g: codec.encode(g if srids[k] is None else g.with_srid(srids[k]))), pa.binary())


def make_envelope(*args: pa.Array) -> pa.Array:
    """Rectangles from the lower left corner up and around; all rows at once."""
    if any(a.null_count for a in args[:4]):
        raise GeometryError("a corner of an envelope has to be a number, not null")
    x0, y0, x1, y1 = (a.cast(pa.float64()).to_numpy(zero_copy_only=False) for a in args[:4])
    xy = np.stack([x0, y0, x0, y1, x1, y1, x1, y0, x0, y0], axis=1).astype("<f8").view(np.uint8).reshape(len(x0), 80)
    srids = args[4].to_pylist() if len(args) > 4 else [None] * len(x0)
    heads = {s: (bytes([1, 1]) + struct.pack("<I", 3) if s is None else bytes([2, 1]) + struct.pack("<Ii", 3 | 0x20000000, _srids([s], 1)[0])) + struct.pack("<II", 1, 5) for s in set(srids)}
    return pa.array([heads[s] + r.tobytes() for s, r in zip(srids, xy)], pa.binary())


def _decide(a: pa.Array, b: pa.Array, possible: Callable, exact: Callable[[Geometry, Geometry], bool]) -> pa.Array:
    p, q = boxes(a), boxes(b)
    with np.errstate(invalid="ignore"):
        todo = np.flatnonzero(possible(p, q))
    out, one = np.zeros(len(p), bool), _once(lambda v, w: exact(decode(v), decode(w)))
    out[todo] = [one(v, w) for v, w in zip(a.take(pa.array(todo)).to_pylist(), b.take(pa.array(todo)).to_pylist())]
    null = a.is_null().to_numpy(zero_copy_only=False) | b.is_null().to_numpy(zero_copy_only=False)
    return pa.array(out, mask=null)


def _overlap(p, q):
    return (p[:, 0] <= q[:, 2]) & (q[:, 0] <= p[:, 2]) & (p[:, 1] <= q[:, 3]) & (q[:, 1] <= p[:, 3])


def _within(p, q):
    return (p[:, 0] <= q[:, 0]) & (p[:, 1] <= q[:, 1]) & (p[:, 2] >= q[:, 2]) & (p[:, 3] >= q[:, 3])


def intersects(a: pa.Array, b: pa.Array) -> pa.Array:
    return _decide(a, b, _overlap, relate.intersects)


def covers(a: pa.Array, b: pa.Array) -> pa.Array:
    return _decide(a, b, _within, relate.covers)


def covered_by(a: pa.Array, b: pa.Array) -> pa.Array:
    return covers(b, a)


def equals(a: pa.Array, b: pa.Array) -> pa.Array:
    return _decide(a, b, lambda p, q: (p == q).all(axis=1), relate.equals)


def boundary(values: pa.Array) -> pa.Array:
    """Of rows alike at once: the ends of lines, the rings of areas, nothing of points."""
    values = _binary(values)
    out, done = [None] * len(values), np.zeros(len(values), bool)
    for rows, raw, start, at in _alike(values):
        xy, kind = _xy(raw, start), int(raw[0, 2])
        if kind == POINT:
            _fill(out, rows, _head(COLLECTION, raw, at, 0), xy[:, :0])
        elif kind == POLYGON:
            _fill(out, rows, _head(LINESTRING, raw, at, xy.shape[1]), xy)
        else:
            ring = (xy[:, 0] == xy[:, -1]).all(axis=1)
            _fill(out, rows[ring], _head(MULTIPOINT, raw[ring], at, 0), xy[ring, :0])
            point = np.broadcast_to(np.frombuffer(struct.pack("<BI", 1, POINT), np.uint8), (np.count_nonzero(~ring), 5))
            first, last = (np.ascontiguousarray(xy[~ring, k]).view(np.uint8) for k in (0, -1))
            _fill(out, rows[~ring], np.concatenate([_head(MULTIPOINT, raw[~ring], at, 2), point, first, point, last], axis=1), xy[~ring, :0])
        done[rows] = True
    return pa.array(_rest(values, done, out, lambda k, g: codec.encode(build.boundary(g))), pa.binary())


def _numbers(*args: pa.Array):
    for row in zip(*(a.to_pylist() for a in args)):
        if None in row:
            raise GeometryError("a number is null")
        yield row


def buffer(values: pa.Array, width: pa.Array, quadsegs: pa.Array) -> pa.Array:
    values, by = _binary(values), list(_numbers(width, quadsegs))
    out, done = [None] * len(values), np.zeros(len(values), bool)
    for rows, raw, start, at in _alike(values):
        xy = _xy(raw, start)
        if raw[0, 2] != POINT:
            continue
        for w, q in {by[k] for k in rows.tolist()}:
            on = np.array([by[k] == (w, q) for k in rows.tolist()]) & ~np.isnan(xy[:, 0]).any(axis=1)
            if w > 0 and on.any():
                ring = np.array(build.circle_of(max(1, int(q))))
                _fill(out, rows[on], _head(POLYGON, raw[on], at, 1, len(ring) + 1), np.concatenate([r := xy[on] + float(w) * ring, r[:, :1]], axis=1))
                done[rows[on]] = True
    one = _once(lambda v, w, q: codec.encode(build.buffer(decode(v), float(w), q)))
    return pa.array(_rest(values, done, out, lambda k, g: one(values[k].as_py(), *by[k])), pa.binary())


def translate(values: pa.Array, dx: pa.Array, dy: pa.Array) -> pa.Array:
    by = np.array(list(_numbers(dx, dy)), float).reshape(-1, 2)
    return _moved(values, lambda rows, xy: xy + by[rows][:, None, :], lambda k, g: build.translate(g, *by[k].tolist()))


def split(a: pa.Array, b: pa.Array) -> pa.Array:
    one = _once(lambda v, w: codec.encode(build.split(decode(v), decode(w))))
    return pa.array([None if v is None or w is None else one(v, w) for v, w in zip(a.to_pylist(), b.to_pylist())], pa.binary())


def as_mvt_geom(values: pa.Array, box: pa.Array) -> pa.Array:
    corners = [None if b is None else tuple(b.values()) for b in box.to_pylist()]
    has = np.array([b is not None for b in corners], bool)
    values = pa.array([v if on else None for v, on in zip(_binary(values).to_pylist(), has)], pa.binary()) if not has.all() else values
    x0, y0, x1, y1 = np.array([b if b is not None else (0.0, 0.0, 1.0, 1.0) for b in corners], float).reshape(-1, 4).T
    with np.errstate(all="ignore"):
        fx, fy = 4096.0 / (x1 - x0), -4096.0 / (y1 - y0)
        scale, shift = np.stack([fx, fy], axis=1), np.stack([x0 * fx, y1 * fy], axis=1)
        return _moved(values, lambda rows, xy: xy * scale[rows][:, None, :] - shift[rows][:, None, :], lambda k, g: build.to_tile(g, corners[k]))


def extent(values: pa.Array) -> dict:
    """The box around all; the sentinel box if there is nothing."""
    found = boxes(values)
    found = found[~np.isnan(found).any(axis=1)]
    if not len(found):
        return {"xmin": MAX, "ymin": MAX, "xmax": -MAX, "ymax": -MAX}
    low, high = found.min(axis=0), found.max(axis=0)
    return {"xmin": float(low[0]), "ymin": float(low[1]), "xmax": float(high[2]), "ymax": float(high[3])}
