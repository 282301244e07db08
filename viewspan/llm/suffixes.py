"""Removal of repeated byte strings by suffix arrays, built without recursion from groups of Lyndon prefixes.

A corpus has no single suffix array here. Every ``width``-byte window of a text
belongs to the bucket of its least k-gram hash, and a run of windows of one
bucket is a *piece*. Equal windows fall into the same bucket, so that each
bucket can be judged alone:

1. pieces are hashed; equal pieces are counted with partial sums, and each
   window of a piece that comes twice is repeated;
2. a bucket with several different pieces (one copy of each is enough) is
   searched with a suffix array over its pieces;
3. a bucket too large for one task's suffix array, such as that of a passage
   with thousands of different surroundings, has its windows hashed and counted
   relationally instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import add_columns, quoted, read, spare, stored

#: Bytes of a string that counts as repeated, and of the k-grams whose least hash names a bucket.
WIDTH, KGRAM = 400, 32
#: Windows of a piece at most, bytes hashed at once, bytes of pieces for one suffix array.
RUN, CHUNK, BLOCK = 2048, 1 << 21, 1 << 19
#: A bucket with more bytes of different pieces is counted relationally.
HOT_BYTES = 1 << 20


# --- the suffix array ---------------------------------------------------------------------------


def suffix_array(s: list[int]) -> list[int]:
    """Suffix array of ``s``, whose last symbol must be its unique least.

    Linear grouping: suffixes start in groups by first symbol. Groups are
    taken in descending order; each member points to the nearest place before
    it that is still in a lower group (its previous smaller suffix), and the
    places pointed to move to a new group just above their own, those with more
    pointers higher. In the end a group holds the suffixes of one Lyndon prefix.
    Then the order inside the groups is emitted from the least suffix on: what
    stands before a suffix already placed, and that place's chain of previous
    smaller ones, is next in its group. Nothing is renamed or recursed.
    """
    n = len(s)
    members: list[list[int]] = []
    group = [0] * n
    by_symbol: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        by_symbol.setdefault(c, []).append(i)
    for g, c in enumerate(sorted(by_symbol)):
        members.append(by_symbol[c])
        for i in by_symbol[c]:
            group[i] = g
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    jump = list(range(n))  # nearest place up to here that is in a group not yet taken
    prev = [-1] * n
    first = [0] * len(members)
    at, free = len(members) - 1, n
    while at >= 0:
        own = [i for i in members[at] if group[i] == at]
        members[at] = []
        for i in own:
            jump[i] = i - 1
        pointers: dict[int, int] = {}
        for i in own:
            j = i - 1
            while j >= 0 and jump[j] != j:
                j = jump[j]
            k = i - 1
            while k >= 0 and jump[k] != k:  # shorten the path
                jump[k], k = j, jump[k]
            prev[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        free -= len(own)
        first[at] = free
        if pointers:
            levels: dict[tuple[int, int], list[int]] = {}
            for j, k in pointers.items():
                levels.setdefault((k, group[j]), []).append(j)
            for _, old in sorted(levels, key=lambda x: -x[0]) if len(levels) > 1 else levels:
                new = len(members)
                moved = levels[(_, old)]
                members.append(moved)
                first.append(0)
                up = above[old]
                below.append(old)
                above.append(up)
                above[old] = new
                below[up] = new
                for j in moved:
                    group[j] = new
        at = below[at]
    sa = [-1] * n
    placed = [False] * n
    sa[0], placed[n - 1] = n - 1, True
    for i in range(n):
        j = sa[i] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            sa[first[g]] = j
            first[g] += 1
            placed[j] = True
            j = prev[j]
    return sa


def _phrases(data: np.ndarray, own: np.ndarray, begins: np.ndarray, keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of phrases and the end of the data; for each byte how many bytes before a start decide it, and a hash of so many from there).

    A phrase starts after white space where a hash of the eight bytes before
    says so, every third time on average. Texts of a key that has gaps too long
    for a window that way are cut after all white space, and else at every byte.
    """
    n, most = len(data), max(1, min(192, width // 2 - 8))
    edge = np.zeros(n + 1, bool)
    edge[begins] = edge[n] = True
    white = np.concatenate([[False], (data == 32) | ((data >= 9) & (data <= 13))])
    eight = np.zeros(n + 1, np.uint64)
    chosen = edge.copy()
    if n >= 8:
        eight[: n - 7] = _kgram_hashes(data, 8)
        chosen[8:] |= white[8:] & (eight[: n - 7] % np.uint64(3) == 0)
    _, key = np.unique(keys, return_inverse=True)

    def too_long(start):
        places = np.flatnonzero(start)
        gap = np.zeros(key.max() + 1, np.int64)
        np.maximum.at(gap, key[own[places[:-1]]], np.diff(places))
        return gap > most

    level = np.where(too_long(edge | white), 2, np.where(too_long(chosen) | (most <= 8), 1, 0))[key[own]]
    start = np.append(np.where(level == 0, chosen[:n], np.where(level == 1, (edge | white)[:n], True)), True)
    head = np.append(np.where(level == 0, eight[:n], data.astype(np.uint64) + np.uint64(1)), np.uint64(0))
    return np.flatnonzero(start), np.where(level == 0, 8, 1), head


def repeated_windows(texts: list[bytes], width: int = WIDTH, keys: list | None = None) -> list[list[tuple[int, int]]]:
    """For each text the ranges of starts of ``width``-byte strings that start anywhere else too, in any text of the same key.

    The suffix array is over short phrases that end where the text itself says
    so; a window is placed by its bytes up to the first such end and the rank of
    the phrases that follow. Equal windows stand next to each other in that
    order and are compared byte by byte. ``keys``: texts of different keys have
    no such string in common; without it all are compared.
    """
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    data = np.frombuffer(b"".join(texts), np.uint8)
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    if not len(data):
        return out
    own = np.repeat(np.arange(len(texts)), lengths)
    places, context, head = _phrases(data, own, begins[lengths > 0], np.asarray(keys) if keys is not None else np.zeros(len(texts), np.int64), width)
    raw = data.tobytes()
    cuts = places.tolist()
    tokens = [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    ranks = {t: k for k, t in enumerate(sorted(set(tokens)), len(texts))}
    seq: list[int] = []
    where = np.full(len(data) + 1, -1, np.int64)  # place in the text -> place in seq
    token_ends = np.searchsorted(places, ends)
    a = 0
    for k, b in enumerate(token_ends.tolist()):
        where[places[a:b]] = np.arange(len(seq), len(seq) + b - a)
        seq += [ranks[t] for t in tokens[a:b]]
        seq.append(len(texts) - 1 - k)  # ends the text; the last is the least
        a = b
    rank = np.empty(len(seq), np.int64)
    rank[suffix_array(seq)] = np.arange(len(seq))

    at = np.arange(len(data))
    following = places[np.minimum(np.searchsorted(places, at + context, side="left"), len(places) - 1)]
    rest = following - at
    order = np.argsort(rest, kind="stable")
    sorted_rest = rest[order]
    with np.errstate(over="ignore"):
        for d in range(2, int(rest.max()) + 1):  # hash of the bytes up to the next phrase, from its end backwards
            i = order[np.searchsorted(sorted_rest, d, "left") : np.searchsorted(sorted_rest, d, "right")]
            i = i[context[i] < d]
            h = (data[i].astype(np.uint64) + np.uint64(1) + head[i + 1]) * np.uint64(0x9E3779B97F4A7C15)
            head[i] = h ^ (h >> np.uint64(29))
    window = np.flatnonzero(np.arange(len(data)) + width <= ends[own])
    if not len(window):
        return out
    by = np.lexsort((rank[where[following[window]]], head[window]))
    window = window[by]
    near = np.flatnonzero(head[window[1:]] == head[window[:-1]])
    views = np.lib.stride_tricks.sliding_window_view(data, width)
    same = np.zeros(len(window) + 1, bool)
    for k in range(0, len(near), 20_000):
        i = near[k : k + 20_000]
        same[i + 1] = (views[window[i]] == views[window[i + 1]]).all(axis=1)
    found = np.zeros(len(data) + 1, bool)
    found[window[same[:-1] | same[1:]]] = True
    for k in range(len(texts)):
        mark = np.concatenate([[False], found[begins[k] : ends[k]], [False]])
        edge = np.flatnonzero(mark[1:] != mark[:-1])
        out[k] = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
    return out


# --- pieces -------------------------------------------------------------------------------------


def _kgram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram (a polynomial, by doubling, then mixed)."""
    h, m, base, out, done = data.astype(np.uint64) + np.uint64(1), 1, 0x9E3779B97F4A7C15 | 1, None, 0
    power = base
    with np.errstate(over="ignore"):
        while m <= k:
            if k & m:
                out, done = (h, m) if out is None else (out[: len(h) - done] * np.uint64(power) + h[done:] if len(h) > done else out[:0], done + m)
            if 2 * m <= k:
                h = h[:-m] * np.uint64(power) + h[m:] if len(h) > m else h[:0]
            m, power = 2 * m, power * power & (1 << 64) - 1
        n = len(data) - k + 1
        z = out[: max(n, 0)].copy()
        z ^= z >> np.uint64(31)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(29)
    return z


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n = len(h) - w + 1
    pad = -len(h) % w
    x = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def pieces(data: bytes, ends: np.ndarray, width: int = WIDTH, kgram: int = KGRAM):
    """(bucket, start, windows, tied) of each piece of texts that end at ``ends`` in ``data``.

    ``tied``: the piece may hold its bucket's k-gram twice and so a string that repeats in the piece itself.
    """
    w = width - kgram + 1
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none.view(np.uint64), none, none, none.astype(bool)
    h = _kgram_hashes(np.frombuffer(data, np.uint8), kgram)
    least = _sliding_min(h, w)
    n = len(least)
    at = np.arange(n)
    text = np.searchsorted(ends, at, side="right")
    ok = at + width <= ends[text]
    new = np.ones(n, bool)
    new[1:] = (least[1:] != least[:-1]) | (text[1:] != text[:-1])
    new &= ok
    starts = np.flatnonzero(new)
    stop = np.flatnonzero(np.concatenate([~ok, [True]]))
    if not len(starts):
        return none.view(np.uint64), none, none, none.astype(bool)
    to = np.minimum(np.append(starts[1:], n), stop[np.searchsorted(stop, starts)])
    many = -(-(to - starts) // RUN)  # long runs are cut
    if (many > 1).any():
        which = np.repeat(np.arange(len(starts)), many)
        part = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        to = np.minimum(to[which], starts[which] + (part + 1) * RUN)
        starts = starts[which] + part * RUN
    value = least[starts]
    limit = np.uint64(min((1 << 64) - 1, (1 << 64) * 12 // w))
    cand = np.flatnonzero(h <= limit)
    cand = cand[np.argsort(h[cand], kind="stable")]
    sorted_h = h[cand]
    lo, hi = np.searchsorted(sorted_h, value, side="left"), np.searchsorted(sorted_h, value, side="right")
    tied = (value > limit) | (hi - lo > 1)
    for k in np.flatnonzero((hi - lo > 1) & (value <= limit)):
        own = cand[lo[k] : hi[k]]
        tied[k] = np.searchsorted(own, to[k] - 1 + w) - np.searchsorted(own, starts[k]) > 1
    return value, starts, to - starts, tied


def _piece_rows(width, kgram):
    names = ["bucket", "piece", "k1", "k2", "start", "windows", "tied"]

    def flush(texts, keys, offsets):
        data = b"".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        bucket, start, n, tied = pieces(data, ends, width, kgram)
        text = np.searchsorted(ends, start, side="right")
        digest, more = xxhash.xxh3_64_intdigest, width - 1
        piece = np.array([digest(data[a:b]) for a, b in zip(start.tolist(), (start + n + more).tolist(), strict=True)], dtype=np.uint64)
        k1, k2 = (np.array([k[i] for k in keys], dtype=np.int64)[text] for i in (0, 1))
        begin = ends - np.array([len(t) for t in texts])
        own = start - begin[text] + np.array(offsets, dtype=np.int64)[text]
        return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(own.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(tied)], names=names)

    def run(batches):
        for batch in batches:
            texts, keys, offsets, size = [], [], [], 0
            column = lambda c: batch.column(batch.schema.get_field_index(c))
            for t, k1, k2 in zip(column("t"), column("k1").to_pylist(), column("k2").to_pylist(), strict=True):
                b = (t.as_py() or "").encode("utf-8", "surrogatepass")
                if len(b) < width:
                    continue
                for a in range(0, len(b) - width + 1, CHUNK):  # a huge text goes in parts that share width - 1 bytes
                    part = b[a : a + CHUNK + width - 1]
                    texts.append(part)
                    keys.append((k1, k2))
                    offsets.append(a)
                    size += len(part)
                    if size >= CHUNK:
                        yield flush(texts, keys, offsets)
                        texts, keys, offsets, size = [], [], [], 0
            if texts:
                yield flush(texts, keys, offsets)

    return run


def _blocks(batches, most: int):
    """Whole buckets of sorted batches, put together up to ``most`` bytes: lists of rows."""
    rows, bucket, size, own = [], None, 0, []
    for batch in batches:
        for r in batch.to_pylist():
            if r["bucket"] != bucket:
                if size >= most:
                    yield rows + own
                    rows, size = [], 0
                else:
                    rows += own
                bucket, own = r["bucket"], []
            own.append(r)
            size += len(r["bytes"])
    if rows or own:
        yield rows + own


def _search_rows(width):
    def run(batches):
        for rows in _blocks(batches, BLOCK):
            rows = list({(r["bucket"], r["piece"]): r for r in rows}.values())
            out = [(r["k1"], r["k2"], r["start"] + a, r["start"] + b) for r, found in zip(rows, repeated_windows([r["bytes"] for r in rows], width, [r["bucket"] for r in rows]), strict=True) if r["n"] == 1 for a, b in found]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], names=["k1", "k2", "a", "b"])

    return run


def _window_rows(width):
    def run(batches):
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            for r in batch.to_pylist():
                b = r["bytes"]
                hs = [digest(b[i : i + width]) for i in range(len(b) - width + 1)]
                n = len(hs)
                signed = lambda x: x - (1 << 64) if x >> 63 else x
                yield pa.RecordBatch.from_arrays(
                    [pa.array([signed(h >> 64) for h in hs], pa.int64()), pa.array([signed(h & (1 << 64) - 1) for h in hs], pa.int64()), pa.array([r["k1"]] * n, pa.int64()), pa.array([r["k2"]] * n, pa.int64()), pa.array(range(r["start"], r["start"] + n), pa.int64())],
                    names=["w1", "w2", "k1", "k2", "a"],
                )

    return run


def repeated_ranges(keyed: DataFrame, width: int = WIDTH, kgram: int = KGRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Ranges ``(k1, k2, a, b)`` of starts of repeated strings in the texts ``t`` of ``(k1, k2, t)``; ``b`` is exclusive, ranges may overlap."""
    schema = "bucket long, piece long, k1 long, k2 long, start int, windows int, tied boolean"
    rows = stored(keyed.where(F.octet_length("t") >= width).mapInArrow(_piece_rows(width, kgram), schema))
    several = rows.groupBy("bucket").agg(F.min("piece").alias("lo"), F.max("piece").alias("hi"), F.max("tied").alias("tied")).where("lo <> hi or tied").select("bucket")
    grouped = rows.groupBy("bucket", "piece").agg(F.count("*").alias("n"), F.min(F.struct("k1", "k2", "start", "windows")).alias("r"))
    copies = grouped.where("n > 1").select("bucket", "piece")
    whole = rows.join(copies, ["bucket", "piece"]).select("k1", "k2", F.col("start").cast("long").alias("a"), (F.col("start") + F.col("windows")).cast("long").alias("b"))

    singles = grouped.join(several, "bucket").select("bucket", "piece", "n", "r.*")
    sizes = singles.groupBy("bucket").agg(F.sum(F.col("windows") + width - 1).alias("size"))
    singles = stored(singles.join(sizes, "bucket").select("*", (F.col("size") > hot_bytes).alias("hot")).drop("size"))
    part = F.substring(F.encode("t", "UTF-8"), F.col("start") + 1, F.col("windows") + F.lit(width - 1)).alias("bytes")
    texts = stored(singles.join(keyed, ["k1", "k2"]).select("bucket", "piece", "n", "k1", "k2", "start", "hot", part))
    searched = texts.where("not hot").drop("hot").repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_search_rows(width), "k1 long, k2 long, a long, b long")
    # a repeated row brings its pieces twice; they count once here
    hot = texts.where("hot").dropDuplicates(["bucket", "piece"]).mapInArrow(_window_rows(width), "w1 long, w2 long, k1 long, k2 long, a long")
    # a table of its own, so that the join deals the windows anew and one that comes very often can be split
    twice = stored(hot.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"))
    counted = hot.join(twice, ["w1", "w2"]).select("k1", "k2", "a", (F.col("a") + 1).alias("b"))
    return whole.unionByName(searched).unionByName(counted)


def with_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, kgram: int = KGRAM, hot_bytes: int = HOT_BYTES, name: str = "repeats") -> DataFrame:
    """``docs`` with ``name``: array of <start, end> in bytes, the maximal runs covered by strings of ``width`` bytes that also start anywhere else.

    Texts are whole UTF-8 byte strings; strings never cross texts, may overlap
    and are judged on the input. Null and shorter texts have no runs. Repeated
    rows repeat each other's strings. Other columns pass through, whatever
    their names.
    """
    k1, k2, r = (spare(docs, f"_vs_{x}") for x in ("k1", "k2", "r"))
    key = docs.withColumns({k1: F.xxhash64(F.col(quoted(id_col)).cast("string")), k2: F.xxhash64(quoted(text))})
    keyed = key.select(F.col(k1).alias("k1"), F.col(k2).alias("k2"), F.col(quoted(text)).alias("t"))
    again = stored(keyed.where("t is not null").groupBy("k1", "k2").agg(F.count("*").alias("c")).where("c > 1").select("k1", "k2"))
    if again.isEmpty():
        found = repeated_ranges(keyed, width, kgram, hot_bytes)
    else:  # equal rows are searched once, and all that they hold is repeated
        once = keyed.join(again, ["k1", "k2"]).dropDuplicates(["k1", "k2"])
        found = repeated_ranges(stored(keyed.join(again, ["k1", "k2"], "left_anti").unionByName(once)), width, kgram, hot_bytes)
        found = found.unionByName(once.select("k1", "k2", F.lit(0).cast("long").alias("a"), (F.octet_length("t") - F.lit(width - 1)).cast("long").alias("b")).where("b > 0"))
    ranges = found.groupBy(F.col("k1").alias(k1), F.col("k2").alias(k2)).agg(F.collect_set(F.struct("a", "b")).alias(r))
    joined = key.join(ranges, [k1, k2], "left").drop(k1, k2)

    def make(batch):
        return [[_runs(x, width) for x in batch.column(batch.schema.get_field_index(r)).to_pylist()]]

    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return add_columns(joined, [(name, span, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], make).drop(r)


def _runs(ranges, width) -> list[dict]:
    out: list[dict] = []
    for a, b in sorted((r["a"], r["b"] + width - 1) for r in ranges or ()):
        if out and a <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], b)
        else:
            out.append({"start": a, "end": b})
    return out


def kept_bytes(text: str | None, runs: list[dict]) -> bytes:
    b, at, kept = (text or "").encode("utf-8", "surrogatepass"), 0, []
    for r in runs:
        kept.append(b[at : r["start"]])
        at = r["end"]
    return b"".join([*kept, b[at:]])


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = WIDTH, kgram: int = KGRAM, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """The digest of op2 for each row of ``docs``; null texts are empty, an empty table gives no rows."""
    marked = with_repeats(docs.select(F.col(id_col), F.col(text).alias("text")), id_col, "text", width, kgram, hot_bytes, "repeats")

    def make(batch):
        column = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        return [[hashlib.sha256(kept_bytes(t, r)).hexdigest() for t, r in zip(column("text"), column("repeats"), strict=True)]]

    removed = F.aggregate("repeats", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    done = add_columns(marked, [("kept_sha256", T.StringType(), pa.string())], make)
    return done.select(id_col, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), removed.alias("n_removed"), F.size("repeats").cast("long").alias("n_spans"), "kept_sha256")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(read(spark, sf_dir, "documents"))
