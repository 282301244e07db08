"""Near-duplicates by MinHash with tensored banding.

1. A document's set is that of its distinct word shingles. Equal sets are one node.
2. Two collections of ``KEYS`` keys of ``ROWS`` minhashes each (a byte of each) are
   computed; a table's key is a pair of one key of either collection. So 160
   minhashes make 400 tables of 8 minhashes, which would take 3,200 on their own.
   A node is sent once for each key of the first collection, with the second one
   alongside, and the tables' keys are formed where it arrives.
3. Nodes that share a table's key are candidates if the second collection allows
   the similarity. They are reduced to links with the least node of each group,
   and what these connect is a cluster, in which sets are compared exactly
   (``neardups.exact_groups``).

Hot keys: where over ``HOT`` nodes share a key of the first collection, they are
dealt by the whole table key instead. Where that many share even a table's key, all
of them are candidates and go to the exact comparison, which works in blocks.

Two sets of similarity s share no table with probability 1 - (1 - (1 - s^4)^20)^2:
5e-5 at 0.8, 4e-9 at 0.9.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Groups, connected_components, quoted, read, stored
from .neardups import _product, _sets, exact_groups, placed_in_blocks
from .simhash import _whole_buckets, mixed

#: Words of a shingle and percentage of the union from which two sets are linked.
SIZE, SIMILARITY = 2, 0.8
#: Keys of a collection and minhashes (bytes) of a key; 4 of them are a 32-bit number.
KEYS, ROWS = 20, 4
#: Of the 80 minhashes of the second collection so many must agree: at a similarity of 0.8 64 do on average (standard deviation 3.6).
AGREE = 40
#: Nodes under one key from which it is split.
HOT = 8192
#: Members of clusters (56 bytes each) that are broadcast to find their texts; more are joined with all texts by a shuffle.
SENT = 200_000
#: Hashes worked on at once, pairs compared at once, members of a run that is compared in one go (with so many others), and members of a block of a larger one.
WORK, PAIRS, SMALL, BLOCK = 1 << 15, 1 << 16, 64, 1024

_RNG = np.random.default_rng(0x5EED)
_MULTIPLY = _RNG.integers(1, 1 << 63, 2 * KEYS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, 2 * KEYS * ROWS, dtype=np.uint64)


def minhash_bytes(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A byte of each minhash of each set (``lengths`` of its hashes, in order, none empty), as sets by minhashes."""
    out = np.zeros((len(lengths), len(_MULTIPLY)), np.uint8)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    i = 0
    with np.errstate(over="ignore"):
        while i < len(lengths):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + WORK, side="right")))
            x, at = hashes[starts[i] : ends[j - 1]], starts[i:j] - starts[i]
            least = np.stack([np.minimum.reduceat(x * a + b, at) for a, b in zip(_MULTIPLY, _ADD, strict=True)], axis=1)
            out[i:j] = (mixed(least, 1) & np.uint64(255)).astype(np.uint8)
            i = j
    return out


def set_digests(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of each set: mixed sums of its mixed hashes."""
    with np.errstate(over="ignore"):
        return tuple(mixed(np.array([mixed(x, k).sum(dtype=np.uint64) for x in sets], np.uint64), k + 2).view(np.int64) for k in (1, 2))


def _wanted_sets(batches, size):
    """The sets of the rows whose set has the digest and size that a node has."""
    for batch in batches:
        node, component, blocks, n, d0, d1 = (batch.column(batch.schema.get_field_index(c)) for c in ("node", "component", "blocks", "n", "d0", "d1"))
        each = _sets(batch, "t", size)
        own = set_digests(each)
        right = (n.to_numpy() == [len(x) for x in each]) & (d0.to_numpy() == own[0]) & (d1.to_numpy() == own[1])
        s = pa.array([x.tobytes() for x in each], pa.binary())
        yield pa.RecordBatch.from_arrays([node, component, blocks, s], names=["node", "component", "blocks", "s"]).filter(pa.array(right))


def with_sets(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """``(id, n, d0, d1, first, second)`` of ``docs(id, t)``: size of the set, its 128-bit digest and the two collections of keys."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            each = _sets(batch, "t", size)
            n = np.array([len(x) for x in each], np.int64)
            sign = np.zeros((len(n), 2 * KEYS * ROWS), np.uint8)
            sign[n > 0] = minhash_bytes(np.concatenate([np.zeros(0, np.uint64), *each]), n[n > 0])
            half = KEYS * ROWS
            as_bytes = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
            columns = [batch.column(batch.schema.get_field_index("id")), pa.array(n), *(pa.array(d) for d in set_digests(each)), as_bytes(sign[:, :half]), as_bytes(sign[:, half:])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "d0", "d1", "first", "second"])

    return docs.mapInArrow(run, f"id {kind}, n long, d0 long, d1 long, first binary, second binary")


# --- candidates -----------------------------------------------------------------------------------


class _Rows:
    """Nodes of a batch of whole buckets and the groups found among them."""

    def __init__(self, node, n, second, similarity):
        self.n, self.second, self.similarity = n, second, similarity
        self.groups = Groups(node)

    def compare(self, i, j) -> None:
        for k in range(0, len(i), PAIRS):
            a, b = i[k : k + PAIRS], j[k : k + PAIRS]
            apart = self.groups.apart(a, b)
            a, b = a[apart], b[apart]
            fits = np.minimum(self.n[a], self.n[b]) >= self.similarity * np.maximum(self.n[a], self.n[b]) - 1e-9
            a, b = a[fits], b[fits]
            near = (self.second[a] == self.second[b]).sum(axis=1) >= AGREE
            self.groups.join(a[near], b[near])

    def open(self, order, starts) -> np.ndarray:
        """Which of the runs (from each start to the next) aren't one group yet."""
        of = self.groups.of[self.groups.row[order]]
        return np.minimum.reduceat(of, starts) != np.maximum.reduceat(of, starts)

    def runs(self, order, starts) -> None:
        """Compares all members of each run of ``order`` (from each start to the next) that aren't in one group yet."""
        sizes = np.diff(np.append(starts, len(order)))
        beside = np.ones(len(order), bool)
        beside[starts + sizes - 1] = False
        at = np.flatnonzero(beside)
        self.compare(order[at], order[at + 1])
        left = np.flatnonzero((sizes > 2) & self.open(order, starts))
        small = left[sizes[left] <= SMALL]
        for k in range(0, len(small), SMALL):
            s, c = starts[small[k : k + SMALL]], sizes[small[k : k + SMALL]]
            i, j = _product(s, c, s, c)
            self.compare(order[i[i < j]], order[j[i < j]])
        for r in left[sizes[left] > SMALL].tolist():
            own = order[starts[r] : starts[r] + sizes[r]]
            of = self.groups.of[self.groups.row[own]]
            name, count = np.unique(of, return_counts=True)
            rest = own[of != name[np.argmax(count)]]
            for u in range(0, len(rest), BLOCK):
                for v in range(0, len(own), BLOCK):
                    x, y = rest[u : u + BLOCK], own[v : v + BLOCK]
                    i, j = np.repeat(x, len(y)), np.tile(y, len(x))
                    self.compare(i[i != j], j[i != j])


def _tables(bucket, second):
    """For each key of the second collection: the order of rows by table key and where each key's run starts."""
    keys = np.ascontiguousarray(second).view(np.uint32)
    for k in range(KEYS):
        order = np.lexsort((keys[:, k], bucket))
        b, v = bucket[order], keys[order, k]
        yield order, np.concatenate([[0], np.flatnonzero((b[1:] != b[:-1]) | (v[1:] != v[:-1])) + 1])


def _bucket_links(batches, similarity):
    for bucket, node, n, second in _whole_buckets(batches, ["bucket", "node", "n", "second"]):
        again = np.concatenate([[False], bucket[1:] == bucket[:-1]])
        shared = again | np.concatenate([again[1:], [False]])  # a node alone in its bucket has no partner
        bucket, node, n, second = bucket[shared], node[shared], n[shared], second[shared]
        if not len(node):
            continue
        second = np.frombuffer(b"".join(second.tolist()), np.uint8).reshape(len(node), -1)
        rows = _Rows(node, n, second, similarity)
        for order, starts in _tables(bucket, second):
            rows.runs(order, starts)
        low, other = rows.groups.stars()
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(other)], names=["a", "b"])


def _in_buckets(routed: DataFrame, similarity: float) -> DataFrame:
    dealt = routed.select("bucket", "node", "n", "second").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(lambda batches: _bucket_links(batches, similarity), "a long, b long")


def _key(collection: str, k: int) -> Column:
    """The k-th key (from 0) of a collection as a hexadecimal string."""
    return F.hex(F.substring(collection, k * ROWS + 1, ROWS))


def candidate_links(nodes: DataFrame, similarity: float, hot: int = HOT) -> DataFrame:
    """Links ``(a, b)`` that span the candidates among ``nodes(node, n, first, second)``."""
    number = lambda c: F.conv(c, 16, 10).cast("long")
    tables = F.array(*[number(_key("first", k)) + F.lit(k << 32) for k in range(KEYS)])
    routed = nodes.select(F.explode(tables).alias("bucket"), "node", "n", "second")
    crowded = stored(routed.groupBy("bucket").agg(F.count("*").alias("c")).where(F.col("c") > hot).select("bucket"))
    if crowded.isEmpty():
        return stored(_in_buckets(routed, similarity))
    links = stored(_in_buckets(routed.join(crowded, "bucket", "left_anti"), similarity))
    pairs = F.array(*[F.xxhash64("bucket", F.lit(k), _key("second", k)) for k in range(KEYS)])
    split = stored(routed.join(crowded, "bucket").select(F.explode(pairs).alias("bucket"), "node", "n", "second"))
    sizes = split.groupBy("bucket").agg(F.count("*").alias("c"), F.min("node").alias("least"))
    links = links.union(stored(_in_buckets(split.join(sizes.where(F.col("c") <= hot).select("bucket"), "bucket"), similarity)))
    large = split.join(sizes.where(F.col("c") > hot), "bucket").where("node <> least")
    return links.union(stored(large.select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()))


# --- the operator ---------------------------------------------------------------------------------


def minhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = SIZE, similarity: float = SIMILARITY, hot: int = HOT) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n_shingles, component_id, kept``.

    Documents whose sets of distinct ``size``-word shingles have a Jaccard
    similarity of ``similarity`` or more are linked; every link was confirmed on
    whole sets. ``component_id`` is the least id that can be reached and ``kept``
    says whether it is the row's own. Fewer words than ``size`` are one shingle;
    null, empty and blank texts have an empty set, are linked with nothing and
    keep their own id. Repeated rows come back as often; null ids are never a
    component's id unless all of it are null, and a row with a null id is kept
    only then. Other columns aren't read; an empty table gives no rows.
    """
    own = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text)).alias("t"))
    sets = stored(with_sets(own, size))
    full = sets.where("n > 0")
    nodes = full.groupBy("d0", "d1", "n").agg(F.min("id").alias("least"), F.first("first").alias("first"), F.first("second").alias("second"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()))
    clusters = connected_components(candidate_links(nodes, similarity, hot))
    members = stored(nodes.select("node", "n", "d0", "d1", "least").join(clusters, "node"))

    # a set for each member: of a row with its least id that has the member's set
    wanted = placed_in_blocks(members).withColumnRenamed("least", "id")
    if members.count() <= SENT:  # so few that texts need not be shuffled to find them
        wanted = F.broadcast(wanted)
    texts = own.join(wanted, own["id"].eqNullSafe(wanted["id"])).select("node", "component", "blocks", "n", "d0", "d1", "t")
    shingled = texts.mapInArrow(lambda batches: _wanted_sets(batches, size), "node long, component long, blocks int, s binary").dropDuplicates(["node"])
    groups = exact_groups(shingled, similarity)
    least = nodes.select("node", "least").join(groups, "node").groupBy("component").agg(F.min("least").alias("lowest"))
    named = groups.join(least, "component").select("node", "lowest")
    of_node = stored(nodes.select("node", "d0", "d1", "n", "least").join(named, "node", "left").select("d0", "d1", "n", F.coalesce("lowest", "least").alias("component_id")))
    out = sets.select("id", "n", "d0", "d1").join(of_node, ["d0", "d1", "n"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op13_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of ``documents`` by 2-word shingles at a similarity of 0.8."""
    return minhash_groups(read(spark, sf_dir, "documents"))
