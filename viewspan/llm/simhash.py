"""SimHash fingerprints and a binary-trie self-join under a Hamming error budget.

Fingerprints are made distinct first, so a group of copies is one trie leaf
however large it is. Two fingerprints within ``budget`` bits agree on at least
one of ``budget + 1`` bit blocks; each fingerprint is sent once for each block
to the bucket of that block's value, and in a bucket two tries are walked
together: a pair of nodes carries the bits that differ so far and is pruned
when they exceed the budget.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, Groups, add_columns, connected_components, cut, read

#: Seed of the shingle hash, fixed by the contract of op6.
SEED = 42
#: Node pairs held at once while two tries are walked; more wait on a stack.
FRONTIER = 1 << 19
#: Node pairs with at most so many leaf pairs are compared leaf by leaf.
SMALL = 64
#: Rows of whole buckets that are joined in one go.
BATCH_ROWS = 400_000


def shingle_hashes(text: str | None, size: int) -> list[int]:
    """XXH64 of each word shingle, repeats included; fewer words than ``size`` make one shingle, none make none."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if not words:
        return []
    if len(words) <= size:
        return [digest(join(words), SEED)]
    return [digest(join(s), SEED) for s in zip(*(words[i:] for i in range(size)), strict=False)]


def majority_bits(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each document (``lengths`` of its hashes, in order) a uint64 with the bits set in over half of them; 0 for none."""
    out = np.zeros(len(lengths), np.uint64)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    i = 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 100_000, side="right")))
        ones = np.zeros((j - i, 64), np.int64)
        if j == i + 1:  # perhaps a very long document: in slices
            for s in range(int(starts[i]), int(ends[i]), 100_000):
                ones[0] += _bits(hashes[s : min(s + 100_000, int(ends[i]))]).sum(axis=0, dtype=np.int64)
        else:
            full = np.flatnonzero(lengths[i:j])
            if len(full):
                ones[full] = np.add.reduceat(_bits(hashes[int(starts[i]) : int(ends[j - 1])]), starts[i:j][full] - starts[i], axis=0, dtype=np.int64)
        bits = ones * 2 > lengths[i:j, None]
        out[i:j] = np.packbits(bits, axis=1).view(">u8")[:, 0]
        i = j
    return out


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th independent hash of each hash (splitmix64 finaliser); the 0th is the hash itself."""
    if not k:
        return hashes
    with np.errstate(over="ignore"):
        z = hashes + np.uint64(0x9E3779B97F4A7C15) * np.uint64(k)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = 3, lanes: int = 1, prefix: str = "fp", distinct: bool = False) -> DataFrame:
    """``docs`` with ``lanes`` 64-bit SimHash columns ``<prefix>0..`` (signed longs; the bits count).

    A shingle counts as often as it comes, with ``distinct`` once. Null and
    blank texts have fingerprint zero in every lane.
    """

    def make(batch):
        each = [np.array(shingle_hashes(t.as_py(), size), dtype=np.uint64) for t in batch.column(batch.schema.get_field_index(text))]
        if distinct:
            each = [np.unique(x) for x in each]
        lengths = np.array([len(x) for x in each], dtype=np.int64)
        hashes = np.concatenate(each) if each else np.zeros(0, np.uint64)
        return [pa.array(majority_bits(mixed(hashes, k), lengths).view(np.int64)) for k in range(lanes)]

    return add_columns(docs, [(f"{prefix}{k}", T.LongType(), pa.int64()) for k in range(lanes)], make)


# --- the trie self-join -------------------------------------------------------------------------


def trie_pairs(keys: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs ``i < j`` in one of the ranges ``[start, end)`` whose keys differ in at most ``budget`` bits.

    ``keys`` (uint64, the low ``bits`` count) are ascending and distinct in each
    range, so that a trie node is a range and its children are found by
    counting ones. Yields (i, j, differing bits) in bounded pieces; a pair comes once.
    """
    many = ends - starts > 1
    a0, a1 = starts[many].astype(np.int64), ends[many].astype(np.int64)
    stack = [(0, a0[k : k + FRONTIER], a1[k : k + FRONTIER], a0[k : k + FRONTIER], a1[k : k + FRONTIER], np.zeros(len(a0[k : k + FRONTIER]), np.int64)) for k in range(0, len(a0), FRONTIER)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            h = len(a0) // 2
            stack += [(depth, a0[:h], a1[:h], b0[:h], b1[:h], err[:h]), (depth, a0[h:], a1[h:], b0[h:], b1[h:], err[h:])]
            continue
        small = (a1 - a0) * (b1 - b0) <= SMALL
        if small.any():
            yield from _leaves(keys, a0[small], a1[small], b0[small], b1[small], budget)
            rest = ~small
            a0, a1, b0, b1, err = a0[rest], a1[rest], b0[rest], b1[rest], err[rest]
        if not len(a0):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((keys >> np.uint64(bits - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        parts = [
            (a0, am, b0, bm, err, None),
            (am, a1, bm, b1, err, None),
            (a0, am, bm, b1, err + 1, None),
            (am, a1, b0, bm, err + 1, ~same),  # of a node with itself, the mirror image of the one before
        ]
        out = [[], [], [], [], []]
        for x0, x1, y0, y1, e, also in parts:
            keep = (x1 > x0) & (y1 > y0) & (e <= budget)
            if also is not None:
                keep &= also
            for o, v in zip(out, (x0, x1, y0, y1, e), strict=True):
                o.append(v[keep])
        a0, a1, b0, b1, err = (np.concatenate(o) for o in out)
        alone = (a0 == b0) & (a1 - a0 == 1)
        if alone.any():
            a0, a1, b0, b1, err = a0[~alone], a1[~alone], b0[~alone], b1[~alone], err[~alone]
        if len(a0):
            stack.append((depth + 1, a0, a1, b0, b1, err))


def _leaves(keys, a0, a1, b0, b1, budget):
    for k in range(0, len(a0), FRONTIER // 8):
        s = slice(k, k + FRONTIER // 8)
        na, nb = a1[s] - a0[s], b1[s] - b0[s]
        size = na * nb
        which = np.repeat(np.arange(len(size)), size)
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        i, j = a0[s][which] + at // nb[which], b0[s][which] + at % nb[which]
        up = (i < j) | (a0[s] != b0[s])[which]
        i, j = i[up], j[up]
        d = np.bitwise_count(keys[i] ^ keys[j]).astype(np.int64)
        ok = d <= budget
        if ok.any():
            yield np.minimum(i[ok], j[ok]), np.maximum(i[ok], j[ok]), d[ok]


def block_bits(bits: int, budget: int) -> list[tuple[int, int]]:
    """(shift, width) of ``budget + 1`` blocks that cover ``bits`` bits."""
    cuts = [round(bits * k / (budget + 1)) for k in range(budget + 2)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def _whole_buckets(batches, columns: list[str]):
    """Regroups sorted batches into dicts of numpy columns that never split a bucket."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in columns]
        if not len(cols[0]):
            continue
        held.append(cols)
        rows += len(cols[0])
        if rows >= BATCH_ROWS:
            full = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(full[0], full[0][-1], side="left")) if (np.diff(full[0]) >= 0).all() else 0
            if last:
                yield [x[:last] for x in full]
            held = [[x[last:] for x in full]]
            rows = len(full[0]) - last
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def linked(nodes: DataFrame, key: str, bits: int, budget: int) -> DataFrame:
    """Links ``(a, b)`` that span every group of distinct ``key`` values (the low ``bits`` bits) within ``budget`` bits.

    The pairs found in a run of buckets are reduced to links with the least key
    of each group, so a dense cluster gives as many links as it has members, not
    its square, and mostly the same ones in every bucket; the components are
    those of all pairs.
    """
    blocks = block_bits(bits, budget)
    mask = (1 << bits) - 1
    as_long = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    routed = nodes.select(F.col(key).alias("k")).where("k is not null").distinct().select(
        "k",
        F.posexplode(F.array(*[F.shiftrightunsigned(F.col("k").bitwiseAND(F.lit(as_long(((1 << w) - 1) << s & mask))), s) for s, w in blocks])).alias("n", "v"),
    ).select("k", (F.col("v") * len(blocks) + F.col("n")).alias("bucket"))
    routed = routed.repartition("bucket").sortWithinPartitions("bucket")

    def run(batches):
        for bucket, k in _whole_buckets(batches, ["bucket", "k"]):
            k = k.view(np.uint64) & np.uint64(mask)
            order = np.lexsort((k, bucket))
            bucket, k = bucket[order], k[order]
            edge = np.flatnonzero(np.diff(bucket)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(bucket)]])
            groups = Groups(k.view(np.int64))
            for i, j, _ in trie_pairs(k, starts, ends, bits, budget):
                groups.join(i, j)
            low, other = groups.stars()
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(other)], names=["a", "b"])

    return routed.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = 3, budget: int = 2) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``fingerprint``, ``component_id``.

    Fingerprints of 64 bits link at ``budget`` or fewer differing bits and
    ``component_id`` is the least id that can be reached. Null and blank texts
    have fingerprint zero and link like any other; repeated rows are returned as
    often as they come; a null id is kept and never becomes a component's id
    unless all ids of the component are null. An empty table gives no rows.
    Other columns are not read.
    """
    fps = cut(with_fingerprints(docs.select(F.col(id_col).alias("id"), F.col(text).alias("t")), "t", size).select("id", "fp0"))
    nodes = fps.groupBy("fp0").agg(F.min("id").alias("least"))
    comp = connected_components(linked(nodes, "fp0", 64, budget))
    least = nodes.join(comp, nodes["fp0"] == comp["node"]).groupBy("component").agg(F.min("least").alias("lowest"))
    # cut, so that the last join deals both sides anew and a very common fingerprint can be split
    named = cut(nodes.join(comp.join(least, "component").select(F.col("node").alias("fp0"), "lowest"), "fp0", "left").select("fp0", F.coalesce("lowest", "least").alias("component_id")))
    return fps.join(named, "fp0").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
