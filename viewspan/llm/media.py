"""Local image descriptors over a media column: cropped and edited copies.

Multiscale corners, binary intensity tests turned to each corner's orientation,
Hamming tables joined by hash, and a geometric consensus of the matches. Equal
images are one node; copies link through matches that agree on one scale,
rotation and shift.

Two corners match if they share a key of a table and differ in few bits, two
images link if enough matches agree. First each corner is compared with two
neighbours of a bucket, which joins most copies to classes at the cost of a few
pairs a row. Then all pairs of a bucket that lie in different classes are
compared, so that no link between classes is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, read, shuffle_partitions, stored

#: Pyramid scales, border that a descriptor needs, corners kept for each image (strongest first; a feature of the descriptor).
SCALES, BORDER, CORNERS = (1.0, 1.5, 2.25), 11, 24
#: Bits of a descriptor, bits that a match may differ in, Hamming tables and bits of a table's key.
BITS, MATCH_BITS, TABLES, KEY_BITS = 256, 40, 6, 24
#: Matches that must agree, and how far they may be off: octaves, radians, pixels.
INLIERS, OCTAVE, TURN, SHIFT = 5, 0.35, 0.35, 3.5
#: Tables read for the first classes (the exact pass reads all), rows of a block of a large bucket, rows and pairs handled at once.
FIRST_TABLES, BLOCK, ROWS, PAIRS = 2, 4096, 1 << 17, 1 << 20
#: Rows and columns of a tile of corners compared at once, and rows of a bucket from which tiles are used.
TILE, TILE_WIDTH, TILED = 64, 1024, 32
#: A bucket is counted towards the large ones where as many of its rows meet among the corners of that many images.
CROWD, CROWD_IMAGES = 16, 20_000
SEED = 7


def _pattern() -> np.ndarray:
    """(BITS, 4) offsets of the two points of each test, drawn once by rule from a disc."""
    rng = np.random.default_rng(SEED)
    return np.clip(rng.normal(0, BORDER / 2.4, (BITS, 4)), -7, 7)


PATTERN = _pattern()
TABLE_BITS = np.stack([np.random.default_rng(SEED + 1 + t).permutation(BITS)[:KEY_BITS] for t in range(TABLES)])


# --- pixels -------------------------------------------------------------------------------------


def encode(pixels: np.ndarray) -> bytes:
    """A binary grey map (PGM) of an array of bytes."""
    h, w = pixels.shape
    return b"P5\n%d %d\n255\n" % (w, h) + pixels.astype(np.uint8).tobytes()


def decode(image: bytes | None) -> np.ndarray | None:
    """Grey values of a binary PGM or PPM of 8 bits; None for null, empty, cut or other data."""
    try:
        kind, at, numbers = image[:2], 2, []
        while len(numbers) < 3:
            while image[at : at + 1].isspace():
                at += 1
            if image[at : at + 1] == b"#":
                at = image.index(b"\n", at) + 1
                continue
            end = at
            while image[end : end + 1].isdigit():
                end += 1
            numbers.append(int(image[at:end]))
            at = end
        w, h, top = numbers
        depth = {b"P5": 1, b"P6": 3}[kind]
        if top > 255 or not w or not h:
            return None
        x = np.frombuffer(image, np.uint8, w * h * depth, at + 1).reshape(h, w, depth).astype(np.float32)
        return x[..., 0] if depth == 1 else x @ np.array([0.299, 0.587, 0.114], np.float32)
    except (TypeError, ValueError, KeyError, IndexError):
        return None


def _resized(x: np.ndarray, scale: float) -> np.ndarray:
    """``x`` made ``scale`` times smaller, by linear interpolation of a blurred image."""
    if scale == 1.0:
        return x
    x = _blurred(x, 1)
    h, w = max(1, int(x.shape[0] / scale)), max(1, int(x.shape[1] / scale))
    r, c = (np.arange(h) + 0.5) * scale - 0.5, (np.arange(w) + 0.5) * scale - 0.5
    return _at(x, r[:, None], c[None, :])


def _at(x, r, c):
    r, c = np.clip(r, 0, x.shape[0] - 1.001), np.clip(c, 0, x.shape[1] - 1.001)
    i, j = r.astype(np.int64), c.astype(np.int64)
    a, b = (r - i).astype(np.float32), (c - j).astype(np.float32)
    return x[i, j] * (1 - a) * (1 - b) + x[i + 1, j] * a * (1 - b) + x[i, j + 1] * (1 - a) * b + x[i + 1, j + 1] * a * b


def _blurred(x: np.ndarray, r: int) -> np.ndarray:
    """Box blur of radius ``r`` over the last two axes, twice."""
    for _ in range(2):
        for axis in (-2, -1):
            n = x.shape[axis]
            of = lambda z, a, b: z[..., a:b, :] if axis == -2 else z[..., a:b]  # noqa: B023, E731
            p = np.empty((*x.shape[:-2], x.shape[-2] + 2 * r * (axis == -2), x.shape[-1] + 2 * r * (axis == -1)))
            of(p, 0, r)[:], of(p, r, n + r)[:], of(p, n + r, n + 2 * r)[:] = of(x, 0, 1), x, of(x, n - 1, n)
            total = of(p, 0, n) + of(p, 1, n + 1)
            for k in range(2, 2 * r + 1):
                total += of(p, k, n + k)
            total /= 2 * r + 1
            x = total.astype(np.float32)
    return x


def _corners(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, strength) of local maxima of the Harris measure."""
    gr, gc = np.gradient(x)
    a, b, c = _blurred(np.stack([gr * gr, gc * gc, gr * gc]), 1)
    s = a * b - c * c - 0.05 * (a + b) ** 2
    h, w = s.shape
    p = np.pad(s, 2, constant_values=-np.inf)
    # the largest of the four others of a column of five, then of the four columns beside it
    own = np.maximum(np.maximum(p[:h], p[1 : h + 1]), np.maximum(p[3 : h + 3], p[4 : h + 4]))
    column = np.maximum(own, p[2 : h + 2])
    best = own[:, 2 : w + 2]
    for j in (0, 1, 3, 4):
        best = np.maximum(best, column[:, j : j + w])
    ok = (s > best) & (s > 1.0)
    ok[:BORDER], ok[-BORDER:], ok[:, :BORDER], ok[:, -BORDER:] = False, False, False, False
    r, c = np.nonzero(ok)
    return r, c, s[r, c]


DISC_R, DISC_C = (d[np.hypot(*np.mgrid[-8:9, -8:9]) <= 8] for d in np.mgrid[-8:9, -8:9])


def _described_at(y: np.ndarray, r: np.ndarray, c: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Places and bits of the corners at (r, c) of an image made ``scale`` times smaller."""
    smooth = _blurred(y, 1)
    patch = smooth[r[:, None] + DISC_R, c[:, None] + DISC_C]
    angle = np.arctan2((patch * DISC_R).sum(1), (patch * DISC_C).sum(1))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    turned = lambda dr, dc: _at(smooth, r[:, None] + dr * cos + dc * sin, c[:, None] + dc * cos - dr * sin)
    bits = np.packbits(turned(PATTERN[:, 0], PATTERN[:, 1]) < turned(PATTERN[:, 2], PATTERN[:, 3]), axis=1)
    return np.stack([(r + 0.5) * scale, (c + 0.5) * scale, np.full(len(r), np.log2(scale)), angle], 1), bits


def descriptors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, bits): for each corner (row, column, log2 scale, angle) in the image's own pixels, and BITS/8 bytes."""
    found = []
    for scale in SCALES:
        y = _resized(x, scale)
        if min(y.shape) > 2 * BORDER:
            found.append((scale, y, *_corners(y)))
    strength = np.concatenate([f[4] for f in found]) if found else np.zeros(0)
    if not len(strength):
        return np.zeros((0, 4)), np.zeros((0, BITS // 8), np.uint8)
    # only the corners that stay are described
    top = np.argsort(-strength, kind="stable")[:CORNERS]
    places, bits, at = np.empty((len(top), 4)), np.empty((len(top), BITS // 8), np.uint8), 0
    for scale, y, r, c, s in found:
        own = np.flatnonzero((top >= at) & (top < at + len(s)))
        if len(own):
            places[own], bits[own] = _described_at(y, r[top[own] - at], c[top[own] - at], scale)
        at += len(s)
    return places, bits


# --- matching -----------------------------------------------------------------------------------


def _column(batch, name):
    return batch.column(batch.schema.get_field_index(name))


def _batch(names, *columns):
    return pa.RecordBatch.from_arrays(list(columns), names=list(names))


def _binaries(x: np.ndarray) -> pa.Array:
    """A binary array of the rows of ``x``, which are bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x))])


def _described(batches):
    """The image's corners, each of BITS/8 bytes and its place in four floats; null where there are none."""
    known = {}
    for batch in batches:
        corners = []
        for node, image in zip(_column(batch, "node").to_pylist(), _column(batch, "image"), strict=True):
            if node not in known:
                if len(known) >= 4096:
                    known.clear()
                x = decode(image.as_py())
                places, bits = descriptors(x) if x is not None else ((), ())
                known[node] = np.hstack([bits, places.astype(np.float32).view(np.uint8)]).tobytes() if len(places) else None
            corners.append(known[node])
        yield _batch(("id", "node", "corners"), _column(batch, "id"), _column(batch, "node"), pa.array(corners, pa.binary()))


def _unpacked(corners: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(corners as rows of bytes, keys of all tables, places)."""
    rows = np.frombuffer(corners, np.uint8).reshape(-1, BITS // 8 + 16)
    flat = np.unpackbits(rows[:, : BITS // 8], axis=1)
    keys = np.stack([flat[:, TABLE_BITS[t]].astype(np.int64) @ (1 << np.arange(KEY_BITS, dtype=np.int64)) + (t << KEY_BITS) for t in range(TABLES)], 1)
    return rows, keys, np.ascontiguousarray(rows[:, BITS // 8 :]).view(np.float32)


def _corner_rows(batches):
    """A row for each corner and table of the first pass: bucket, node, and the descriptor with the place."""
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        images = [_unpacked(c) for c in _column(batch, "corners").to_pylist()]
        buckets = np.concatenate([keys[:, :FIRST_TABLES].ravel() for _, keys, _ in images])
        nodes = np.repeat(_column(batch, "node").to_numpy(), [len(rows) * FIRST_TABLES for rows, _, _ in images])
        yield _batch(("bucket", "node", "corner"), pa.array(buckets), pa.array(nodes), _binaries(np.concatenate([rows.repeat(FIRST_TABLES, 0) for rows, _, _ in images])))


def _whole_groups(batches, names, binary, by):
    """``({name: numbers}, rows of bytes)`` of about ``ROWS`` rows that end where a group of equal ``by`` ends; rows come sorted by ``by``."""
    held, n = [], 0

    def joined():
        return {c: np.concatenate([h[0][c] for h in held]) for c in names}, np.concatenate([h[1] for h in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.frombuffer(b"".join(_column(batch, binary).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        held.append(({c: _column(batch, c).to_numpy() for c in names}, rows))
        n += len(rows)
        if n < ROWS:
            continue
        x, rows = joined()
        last = np.flatnonzero(np.any([x[c] != x[c][-1] for c in by], axis=0))
        cut = last[-1] + 1 if len(last) else 0
        if cut:
            yield {c: v[:cut] for c, v in x.items()}, rows[:cut]
        held, n = [({c: v[cut:].copy() for c, v in x.items()}, rows[cut:].copy())], len(rows) - cut
    if n:
        yield joined()


def _words(rows: np.ndarray) -> np.ndarray:
    """The descriptors in ``rows`` of bytes as words of 64 bits."""
    return np.ascontiguousarray(rows[:, : BITS // 8]).view(np.uint64)


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits each column of ``x`` differs from each of ``y`` (words by column), 255 where in all of them."""
    d = np.bitwise_count(x[0][:, None] ^ y[0])
    for k in range(1, len(x) - 1):
        d += np.bitwise_count(x[k][:, None] ^ y[k])
    return d + np.minimum(np.bitwise_count(x[-1][:, None] ^ y[-1]), 255 - d)


def _runs(bits: np.ndarray) -> np.ndarray:
    """For each row of a bucket the first row, in order, of those that stand for a run and match it: itself where there is none."""
    n, of = len(bits), np.arange(len(bits))
    if n < TILED:
        numbers, firsts = [int.from_bytes(b.tobytes(), "little") for b in bits], []
        for i, b in enumerate(numbers):
            k = next((k for k in firsts if (numbers[k] ^ b).bit_count() <= MATCH_BITS), None)
            if k is None:
                firsts.append(i)
            else:
                of[i] = k
        return of
    words = np.ascontiguousarray(bits.T)
    firsts, m = np.empty(n, np.int64), 0
    stand = np.empty_like(words)
    for at in range(0, n, TILE):
        rows = np.arange(at, min(n, at + TILE))
        open_ = np.ones(len(rows), bool)
        for k in range(0, m, TILE_WIDTH):
            own = np.flatnonzero(open_)
            near = _differing(words[:, rows[own]], stand[:, k : min(m, k + TILE_WIDTH)]) <= MATCH_BITS
            hit = near.any(axis=1)
            of[rows[own[hit]]] = firsts[k + near[hit].argmax(axis=1)]
            open_[own[hit]] = False
        rows = rows[open_]
        near = _differing(words[:, rows], words[:, rows]) <= MATCH_BITS
        new = []
        for i, row in enumerate(near):
            k = next((k for k in new if row[k]), None)
            if k is None:
                new.append(i)
            else:
                of[rows[i]] = rows[k]
        firsts[m : m + len(new)], stand[:, m : m + len(new)] = rows[new], words[:, rows[new]]
        m += len(new)
    return of


def _bucket_matches(batches):
    """Matches (a, b, places of both) of neighbours in each bucket.

    The rows of a bucket, ordered by node, are compared with the nearest row
    before that matches and with the first of each run of matching rows, so
    that copies of one image meet on the same pairs in all their buckets and a
    bucket of any size gives at most two matches a row. What this leaves out
    is compared in ``class_links``.
    """
    for x, rows in _whole_groups(batches, ("bucket", "node"), "corner", ("bucket",)):
        bits, node = _words(rows), x["node"]
        first = np.arange(len(bits))
        cuts = np.flatnonzero(np.r_[True, x["bucket"][1:] != x["bucket"][:-1], True])
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if end - start > 1:
                first[start:end] = start + _runs(bits[start:end])
        # of each run its rows in order: each meets the first and, if that is another, the one before
        order = np.argsort(first, kind="stable")
        own, before = order[1:], order[:-1]
        within = first[own] == first[before]
        own, before = own[within], before[within]
        more = before != first[own]
        i, j = np.concatenate([first[own], before[more]]), np.concatenate([own, own[more]])
        met = (node[i] != node[j]) & (np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= MATCH_BITS)
        i, j = i[met], j[met]
        a, b = np.where(node[i] < node[j], (i, j), (j, i))
        places = rows[:, BITS // 8 :]
        yield _batch(("a", "b", "places"), pa.array(node[a]), pa.array(node[b]), _binaries(np.hstack([places[a], places[b]])))


def consensus(places: np.ndarray) -> int:
    """Most matches (rows: row, column, log2 scale, angle of both) that agree on one similarity transform, one for each corner."""
    places = np.unique(np.round(places, 3), axis=0)
    if len(places) < INLIERS:
        return 0
    p, q = places[:, :4], places[:, 4:]
    octave = q[:, 2] - p[:, 2]
    turn = q[:, 3] - p[:, 3]
    best = 0
    for k in range(len(places)):
        near = (np.abs(octave - octave[k]) <= OCTAVE) & (np.abs((turn - turn[k] + np.pi) % (2 * np.pi) - np.pi) <= TURN)
        if near.sum() <= best:
            continue
        s, c, z = 2.0 ** octave[k], np.cos(turn[k]), np.sin(turn[k])
        dr, dc = p[:, 0] - p[k, 0], p[:, 1] - p[k, 1]
        off = np.hypot(q[k, 0] + s * (c * dr + z * dc) - q[:, 0], q[k, 1] + s * (c * dc - z * dr) - q[:, 1])
        own = near & (off <= SHIFT * max(1.0, s))
        places_in = np.round(p[own, :2] / 3).astype(np.int64)
        best = max(best, len(np.unique(places_in, axis=0)))
    return best


def _agreed(batches):
    key, held = None, []

    def done():
        places = set(held)  # most pairs have too few matches to be looked at
        return key, consensus(np.frombuffer(b"".join(places), np.float32).reshape(-1, 8).astype(np.float64)) if len(places) >= INLIERS else 0

    for batch in batches:
        out = []
        for a, b, p in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("a", "b", "places")), strict=True):
            if (a, b) != key:
                if held:
                    out.append(done())
                key, held = (a, b), []
            held.append(p)
        yield _links(out)
    if held:
        yield _links([done()])


def _links(found):
    found = [(*k, n) for k, n in found if n >= INLIERS]
    return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], names=["a", "b", "inliers"])


# --- all matches between classes ------------------------------------------------------------------


def _crowded(batches):
    """Buckets in which many corners of some images meet, with their number."""

    def counted(keys):
        bucket, n = np.unique(np.concatenate(keys), return_counts=True)
        return _batch(("bucket", "n"), pa.array(bucket[n >= CROWD]), pa.array(n[n >= CROWD]))

    keys = []
    for batch in batches:
        for corners in _column(batch, "corners").to_pylist():
            keys.append(_unpacked(corners)[1].ravel())
            if len(keys) == CROWD_IMAGES:
                yield counted(keys)
                keys = []
    if keys:
        yield counted(keys)


def _class_rows(batches):
    """A row for each corner and table: bucket, node, its class, number of the corner and descriptor."""
    for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
        images = [_unpacked(c)[:2] for c in _column(batch, "corners").to_pylist()]
        times = [len(rows) * TABLES for rows, _ in images]
        yield _batch(
            ("bucket", "node", "class", "at", "bits"),
            pa.array(np.concatenate([keys.ravel() for _, keys in images])),
            pa.array(np.repeat(_column(batch, "node").to_numpy(), times)),
            pa.array(np.repeat(_column(batch, "class").to_numpy(), times)),
            pa.array(np.concatenate([np.arange(len(rows), dtype=np.int32).repeat(TABLES) for rows, _ in images])),
            _binaries(np.concatenate([rows[:, : BITS // 8].repeat(TABLES, 0) for rows, _ in images])),
        )


def _class_matches(batches):
    """For each corner ``(a, at)`` the matching nodes of other classes above ``a``, by their lower 32 bits.

    Rows come sorted by bucket and pair of blocks. Large groups are compared in
    tiles, all rows of the others at a distance of 1, 2, 3, ... of each other
    at once. A task holds ``ROWS`` rows (or a group) and ``PAIRS`` matches.
    """
    by = ("bucket", "low", "high")

    def near(x, bits):
        """Pairs of rows that match, from all pairs of a group (of blocks: all across them)."""
        cuts = np.flatnonzero(np.r_[True, np.any([x[c][1:] != x[c][:-1] for c in by], axis=0), True])
        sizes = np.diff(cuts)
        for start, end in zip(cuts[:-1][sizes >= TILED].tolist(), cuts[1:][sizes >= TILED].tolist()):
            i = j = np.arange(start, end)
            across = x["low"][start] != x["high"][start]
            if across:
                of = x["block"][start:end] == x["low"][start]
                i, j = i[of], i[~of]
            u, v = np.ascontiguousarray(bits[i].T), np.ascontiguousarray(bits[j].T)
            for k in range(0, len(i), TILE):
                for l in range(0 if across else k, len(j), TILE_WIDTH):
                    d = _differing(u[:, k : k + TILE], v[:, l : l + TILE_WIDTH])
                    p, q = np.divmod(np.flatnonzero(d <= MATCH_BITS), d.shape[1])
                    p, q = i[k + p], j[l + q]
                    yield (p, q) if across else (p[p < q], q[p < q])
        end = np.repeat(cuts[1:], sizes)
        i, d = np.flatnonzero((np.repeat(sizes, sizes) < TILED) & (np.arange(len(end)) + 1 < end)), 1
        while len(i):
            for k in range(0, len(i), PAIRS):
                p = i[k : k + PAIRS]
                p = p[(x["low"][p] == x["high"][p]) | (x["block"][p] != x["block"][p + d])]
                p = p[np.bitwise_count(bits[p] ^ bits[p + d]).sum(1, dtype=np.int64) <= MATCH_BITS]
                yield p, p + d
            d += 1
            i = i[i + d < end[i]]

    def listed(p, q, x):
        order = np.argsort(p, kind="stable")
        p, b = p[order], x["node"][q[order]].astype(np.int32)
        start = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        offsets = pa.array(np.r_[start, len(p)] * 4, pa.int32())
        lists = pa.Array.from_buffers(pa.binary(), len(start), [None, offsets.buffers()[1], pa.py_buffer(b)])
        return _batch(("a", "at", "others"), pa.array(x["node"][p[start]]), pa.array(x["at"][p[start]]), lists)

    for x, rows in _whole_groups(batches, (*by, "block", "node", "class", "at"), "bits", by):
        held, n = [], 0
        for p, q in near(x, _words(rows)):
            apart = x["class"][p] != x["class"][q]
            p, q = p[apart], q[apart]
            held.append(np.where(x["node"][p] < x["node"][q], (p, q), (q, p)))
            n += len(p)
            if n >= PAIRS:
                yield listed(*np.concatenate(held, axis=1), x)
                held, n = [], 0
        if n:
            yield listed(*np.concatenate(held, axis=1), x)


def _candidates(batches):
    """Pairs of which enough corners of ``a`` match; ``b`` by its lower 32 bits. Rows come sorted by ``a``; about ``PAIRS`` matches (or those of a node) are counted at a time."""

    def counted(parts):
        a, at, sizes, b = (np.concatenate(c) for c in zip(*parts, strict=True))
        own = np.cumsum(np.r_[False, a[1:] != a[:-1]])
        key = np.sort((np.repeat(own, sizes) << 40) | (b.astype(np.int64) & 0xFFFFFFFF) << 8 | np.repeat(at, sizes).astype(np.int64))
        key = key[np.r_[True, key[1:] != key[:-1]]] >> 8
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[start, len(key)])
        key, n = key[start[n >= INLIERS]], n[n >= INLIERS]
        first = a[np.flatnonzero(np.r_[True, a[1:] != a[:-1]])]
        return _batch(("a", "b32", "n"), pa.array(first[key >> 32]), pa.array((key & 0xFFFFFFFF).astype(np.uint32).view(np.int32)), pa.array(n.astype(np.int64)))

    held, n = [], 0
    for batch in batches:
        a, at, others = (_column(batch, c) for c in ("a", "at", "others"))
        if not batch.num_rows:
            continue
        others = others.to_pylist()
        a, sizes = a.to_numpy(), np.array([len(o) // 4 for o in others])
        held.append((a, at.to_numpy(), sizes, np.frombuffer(b"".join(others), np.int32)))
        n += int(sizes.sum())
        if n < PAIRS:
            continue
        a, at, sizes, b = (np.concatenate(c) for c in zip(*held, strict=True))
        last = np.flatnonzero(a != a[-1])
        cut = last[-1] + 1 if len(last) else 0
        upto = int(sizes[:cut].sum())
        if cut:
            yield counted([(a[:cut], at[:cut], sizes[:cut], b[:upto])])
        held, n = [(a[cut:].copy(), at[cut:].copy(), sizes[cut:].copy(), b[upto:].copy())], len(b) - upto
    if held:
        yield counted(held)


def matching_places(a: bytes, b: bytes) -> np.ndarray:
    """Places (rows of eight numbers) of the matching corners of two images."""
    (x, i, p), (y, j, q) = _unpacked(a), _unpacked(b)
    bits = [np.ascontiguousarray(z[:, : BITS // 8]).view(np.uint64) for z in (x, y)]
    near = np.bitwise_count(bits[0][:, None] ^ bits[1][None]).sum(2, dtype=np.int64) <= MATCH_BITS
    m, n = np.nonzero(near & (i[:, None] == j[None]).any(2))
    return np.hstack([p[m], q[n]]).astype(np.float64)


def _verified(batches):
    for batch in batches:
        a, b, x, y = (_column(batch, c).to_pylist() for c in ("a", "b", "of_a", "of_b"))
        yield _links([((i, j), consensus(matching_places(p, q))) for i, j, p, q in zip(a, b, x, y, strict=True)])


def class_links(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    """All links ``(a, b, inliers)`` between nodes ``(node, corners)`` of different classes ``comp``, or enough of them.

    Every pair of corners of a bucket is compared unless its nodes are of one
    class; large buckets are compared block by block in several tasks. Of two
    classes with many candidates the best is tried first, the others only
    where the classes are not joined by then.
    """
    size = nodes.mapInArrow(_crowded, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK)
    size = size.select("bucket", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    named = nodes.join(comp, "node", "left").select("node", F.coalesce("component", "node").alias("class"), "corners")
    rows = named.mapInArrow(_class_rows, "bucket long, node long, class long, at int, bits binary").join(F.broadcast(size), "bucket", "left")
    rows = rows.withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("node", "at"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("bucket", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "class", "at", "bits")
    rows = rows.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    lists = rows.mapInArrow(_class_matches, "a long, at int, others binary").repartition("a").sortWithinPartitions("a")
    pairs = lists.mapInArrow(_candidates, "a long, b32 int, n long")
    # lower halves may be shared: such pairs are candidates too many, and fall by their corners
    pairs = stored(pairs.join(nodes.select(F.col("node").alias("b"), F.shiftright(F.shiftleft("node", 32), 32).cast("int").alias("b32")), "b32").where("a < b").select("a", "b", "n"))
    links = None
    for best in (True, False):
        of = comp.select("node", "component")
        open_ = pairs.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").select("a", "b", "n", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
        if best:
            open_ = open_.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.max(F.struct("n", "a", "b")).alias("x")).select("x.a", "x.b")
        both = open_.select("a", "b").join(nodes.select(F.col("node").alias("a"), F.col("corners").alias("of_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("corners").alias("of_b")), "b")
        found = stored(both.mapInArrow(_verified, "a long, b long, inliers long"))
        links = found if links is None else links.union(found)
        if best and not found.isEmpty():
            edges = found.select("a", "b").union(comp.select("node", "component"))
            comp = connected_components(edges)
    return links.distinct()


def image_links(nodes: DataFrame) -> DataFrame:
    """Links ``(a, b, inliers)`` between distinct images ``(node, corners)``, ``a < b``, that hold all classes together."""
    rows = nodes.mapInArrow(_corner_rows, "bucket long, node long, corner binary")
    matches = rows.repartition("bucket").sortWithinPartitions("bucket", "node", "corner").mapInArrow(_bucket_matches, "a long, b long, places binary")
    # the same two corners match in many tables and count once
    first = stored(matches.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(_agreed, "a long, b long, inliers long"))
    return first.union(class_links(nodes, connected_components(first)))


def image_copies(media: DataFrame, id_col: str = "media_id", image: str = "image") -> DataFrame:
    """One row for each row of ``media``: ``id_col``, ``class_id`` (least id of its class), ``n_links`` and ``exact_copies``.

    ``n_links``: links of its image to different images that hold its class
    together (copies are not expanded to all pairs, but all that link directly or
    through others are of one class); ``exact_copies``: rows with just the same
    bytes, itself included.
    Null, broken and corner-free images link only to equal bytes; null is equal to null.
    Repeated rows are equal images; a null id is never a class id unless all
    ids of a class are null. An empty table gives no rows.
    """
    own = media.select(F.col(id_col).alias("id"), F.col(image).alias("image"), F.xxhash64(F.coalesce(F.col(image), F.lit(b""))).alias("node"))
    # decoding and describing cost far more than moving the images, so they are spread first
    spread = own.repartition(max(shuffle_partitions(own.sparkSession), 24), "id", "node")
    described = spread.mapInArrow(_described, T.StructType([own.schema["id"], T.StructField("node", T.LongType()), T.StructField("corners", T.BinaryType())]))
    nodes = stored(described.groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("n"), F.first("corners", ignorenulls=True).alias("corners")))
    links = stored(image_links(nodes.where("corners is not null").select("node", "corners")))
    nodes = nodes.select("node", "least", "n")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    comp = connected_components(links)
    least = nodes.join(comp, "node").groupBy("component").agg(F.min("least").alias("class_id"))
    named = nodes.join(comp.join(least, "component").select("node", "class_id"), "node", "left").join(degree, "node", "left")
    named = named.select("node", F.coalesce("class_id", "least").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n").alias("exact_copies"))
    return own.select("id", "node").join(named, "node").select(F.col("id").alias(id_col), "class_id", "n_links", "exact_copies")


# --- a media column for the given tables -----------------------------------------------------------

SIDE, CELLS = 96, 24


def rendered(vector: list[float] | None, edit: int) -> bytes | None:
    """A picture of a vector, edited: 1 crops it, 2 lifts contrast and brightness, 3 turns it a quarter; else it stays.

    Cells of a grid are grey by sums of three of the vector's numbers, so that
    equal vectors give equal pictures and others give others.
    """
    if not vector:
        return None
    v = np.array([0.0 if x is None else x for x in vector], np.float64)
    i = np.arange(CELLS * CELLS)
    r, c = i // CELLS, i % CELLS
    cells = v[(i * i + r) % len(v)] + v[(r * r * 5 + c * 3) % len(v)] - v[(c * c * 7 + r * 11 + i) % len(v)]
    cells = (cells - cells.mean()) / (cells.std() + 1e-9)
    x = np.clip(128 + 52 * cells, 4, 250).reshape(CELLS, CELLS).repeat(SIDE // CELLS, 0).repeat(SIDE // CELLS, 1)
    if edit == 1:
        x = x[10:90, 6:88]
    elif edit == 2:
        x = np.clip((x - 128) * 0.8 + 140, 0, 255)
    elif edit == 3:
        x = np.rot90(x)
    return encode(x)


def media_table(embeddings: DataFrame) -> DataFrame:
    """``(media_id, image)``, an image for each row of ``embeddings``.

    The given tables hold no pictures, so one is drawn of each vector. Rows
    whose id ends in 7, 8 or 9 get a crop, a lighter or a turned copy of the
    picture of the row whose id ends in 0 (their own where there is none).
    """
    edit = F.when(F.pmod("vec_id", F.lit(10)) >= 7, F.pmod("vec_id", F.lit(10)) - 6).otherwise(0).cast("int")
    own = embeddings.select(F.col("vec_id").alias("media_id"), "embedding", edit.alias("edit"), (F.col("vec_id") - F.pmod("vec_id", F.lit(10))).alias("base"))
    bases = embeddings.where(F.pmod("vec_id", F.lit(10)) == 0).groupBy(F.col("vec_id").alias("base")).agg(F.first("embedding").alias("from"))
    both = own.where("edit = 0 or edit is null").select("media_id", "embedding", F.lit(0).alias("edit")).union(own.where("edit > 0").join(bases, "base", "left").select("media_id", F.coalesce("from", "embedding"), "edit"))

    def draw(batches):
        for batch in batches:
            images = [rendered(v, e) for v, e in zip(batch.column(batch.schema.get_field_index("embedding")).to_pylist(), batch.column(batch.schema.get_field_index("edit")).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("media_id")), pa.array(images, pa.binary())], names=["media_id", "image"])

    return both.mapInArrow(draw, "media_id long, image binary")


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return image_copies(media_table(read(spark, sf_dir, "embeddings")))
