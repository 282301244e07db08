"""Near-duplicates of a stated shingle similarity, found by trie joins of wide SimHash fingerprints.

1. Equal texts are one node (128-bit digest), however many rows have them.
2. A node has a 256-bit SimHash of its distinct shingles. Twelve 32-bit parts of
   it are joined by binary tries under an error budget; pairs that meet and are
   alike over the whole width are candidates. A task reduces its candidates to
   links with the least node of each group it sees, so a dense group gives a few
   rows a member and not its square. What the candidates connect is a cluster.
3. Within a cluster shingle sets are compared exactly, in blocks of bounded
   size. A cluster of one block is one group of rows. In a larger one each block
   is compared with itself and with the first block; members that are not in the
   cluster's largest group after that are compared with all the others, again
   block by block. Every pair of a cluster is thereby either in one group or compared.

The groups are the components of all similar pairs within a cluster, so they
depend neither on partitions nor on the order of rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Groups, connected_components, quoted, spare, stored
from .simhash import _whole_buckets, block_bits, majority_bits, mixed, shingle_hashes, trie_pairs

#: Words of a shingle and Jaccard similarity of shingle sets from which two texts are near-duplicates.
NEAR_SIZE, SIMILARITY = 5, 0.8
#: Wide fingerprints: lanes of 64 bits; of the whole width so many bits may differ before a pair isn't looked at
#: (pairs at a similarity of 0.8 differ in 39 of 256 on average, standard deviation 6; unrelated ones in 128).
LANES, WIDE_BUDGET = 4, 64
#: Tables of 32 bits, each joined with this budget: 12 of them miss about 2 % of pairs at a similarity of just 0.8, 0.1 % at 0.85.
TABLES, TABLE_BITS, TABLE_BUDGET = 12, 32, 3
#: Nodes with one 32-bit key: a pair of such leaves with more member pairs is compared in blocks of so many members.
LEAF_PAIRS, LEAF_BLOCK = 4096, 1024
#: Shingles and texts of a block of a cluster, about, and shingles looked at together in a comparison.
BLOCK_SHINGLES, BLOCK_TEXTS, COLUMNS = 100_000, 512, 2048
_EVEN = 0x55555555


def table_keys(lanes: list[str]) -> list:
    """Columns of ``TABLES`` 32-bit keys: the halves of the lanes, then halves of two lanes interleaved."""
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda c: F.shiftrightunsigned(F.col(c), 32)
    halves = [f(c) for c in lanes for f in (low, high)]
    n = len(halves)
    mixed_halves = [halves[i].bitwiseAND(F.lit(_EVEN)).bitwiseOR(halves[(i + n // 2) % n].bitwiseAND(F.lit(_EVEN << 1))) for i in range(n)]
    return (halves + mixed_halves)[:TABLES]


def _sets(batch, text: str, size: int) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t.as_py(), size), dtype=np.uint64)) for t in batch.column(batch.schema.get_field_index(text))]


def wide_fingerprints(texts: DataFrame, size: int) -> DataFrame:
    """``(node, n, fp0..)`` of ``texts(node, t)``: distinct shingles and fingerprint; texts without words are left out."""

    def run(batches):
        for batch in batches:
            each = _sets(batch, "t", size)
            n = np.array([len(x) for x in each], np.int64)
            hashes = np.concatenate([np.zeros(0, np.uint64), *each])
            lanes = [pa.array(majority_bits(mixed(hashes, k), n).view(np.int64)) for k in range(LANES)]
            out = pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("node")), pa.array(n), *lanes], names=["node", "n", *(f"fp{k}" for k in range(LANES))])
            yield out.filter(pa.array(n > 0))

    return texts.mapInArrow(run, "node long, n long, " + ", ".join(f"fp{k} long" for k in range(LANES)))


# --- candidates -----------------------------------------------------------------------------------


def _product(a, na, b, nb):
    """Places of all members of ranges ``a`` against all of ``b``."""
    size = na * nb
    which = np.repeat(np.arange(len(size)), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    return a[which] + at // nb[which], b[which] + at % nb[which]


class _Members:
    """The rows of a run of buckets: leaves of equal keys, their members, and the groups found so far."""

    def __init__(self, node, n, wide, leaf, sizes, similarity):
        self.n, self.wide, self.leaf, self.sizes, self.similarity = n, wide, leaf, sizes, similarity
        self.groups = Groups(node)

    def compare(self, i, j) -> None:
        """Joins the pairs that are alike; those in one group already need no look."""
        apart = self.groups.apart(i, j)
        i, j = i[apart], j[apart]
        a, b = self.n[i], self.n[j]
        fits = np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9  # no set of another size can be that similar
        i, j = i[fits], j[fits]
        near = np.bitwise_count(self.wide[:, i] ^ self.wide[:, j]).sum(axis=0, dtype=np.int64) <= WIDE_BUDGET
        self.groups.join(i[near], j[near])

    def leaves(self, x, y) -> None:
        """Compares the members of the leaves ``x`` with those of ``y`` (the same ones: of one leaf)."""
        small = self.sizes[x] * self.sizes[y] <= LEAF_PAIRS
        for k in range(0, len(x), 1024):
            m = small[k : k + 1024]
            p, q = x[k : k + 1024][m], y[k : k + 1024][m]
            i, j = _product(self.leaf[p], self.sizes[p], self.leaf[q], self.sizes[q])
            self.compare(i[i < j], j[i < j])
            for p, q in zip(x[k : k + 1024][~m].tolist(), y[k : k + 1024][~m].tolist(), strict=True):
                self.large(p, q)

    def large(self, x, y) -> None:
        """Two large leaves: neighbours and the first member come first; then what is not in the largest group is compared with all."""
        a = np.arange(self.leaf[x], self.leaf[x] + self.sizes[x])
        b = np.arange(self.leaf[y], self.leaf[y] + self.sizes[y])
        self.compare(a[:-1], a[1:])
        self.compare(b[:-1], b[1:])
        self.compare(np.full(len(b), a[0]), b)
        both = np.unique(np.concatenate([a, b]))
        of = self.groups.of[self.groups.row[both]]
        name, count = np.unique(of, return_counts=True)
        others = both[of != name[np.argmax(count)]]
        for u in range(0, len(others), LEAF_BLOCK):
            for v in range(0, len(both), LEAF_BLOCK):
                c, d = others[u : u + LEAF_BLOCK], both[v : v + LEAF_BLOCK]
                i, j = np.repeat(c, len(d)), np.tile(d, len(c))
                self.compare(i[i != j], j[i != j])


def _cluster_links(batches, lanes, similarity):
    """Links of the least node of a group with its other nodes, for the candidates of each run of whole buckets."""
    routes = len(block_bits(TABLE_BITS, TABLE_BUDGET))
    for bucket, v, node, n, *wide in _whole_buckets(batches, ["bucket", "v", "node", "n", *lanes]):
        v, wide = v.view(np.uint64), [w.view(np.uint64) for w in wide]
        order = np.lexsort((*wide, v, bucket))  # members of a leaf stand beside those most like them
        bucket, v = bucket[order], v[order]
        leaf = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (v[1:] != v[:-1])]))
        edge = np.flatnonzero(np.diff(bucket[leaf])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(leaf)]])
        sizes = np.diff(np.append(leaf, len(v)))
        rows = _Members(node[order], n[order], np.stack([w[order] for w in wide]), leaf, sizes, similarity)
        many = np.flatnonzero((sizes > 1) & ((bucket[leaf] >> 8) % routes == 0))  # equal keys meet on a table's first route
        rows.leaves(many, many)
        for x, y, _ in trie_pairs(v[leaf], starts, ends, TABLE_BITS, TABLE_BUDGET):
            rows.leaves(x, y)
        low, other = rows.groups.stars()
        yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(other)], names=["a", "b"])


def candidate_clusters(wide: DataFrame, similarity: float) -> DataFrame:
    """``(node, component)`` of the nodes of ``wide`` that have a candidate."""
    lanes = [f"fp{k}" for k in range(LANES)]
    blocks = block_bits(TABLE_BITS, TABLE_BUDGET)
    per = 256 * len(blocks)
    routes = [F.struct((F.shiftrightunsigned(k, s).bitwiseAND(F.lit((1 << w) - 1)) + F.lit(t * per + n * 256)).cast("long").alias("bucket"), k.alias("v")) for t, k in enumerate(table_keys(lanes)) for n, (s, w) in enumerate(blocks)]
    routed = wide.select("node", "n", *lanes, F.explode(F.array(*routes)).alias("r")).select("r.bucket", "r.v", "node", "n", *lanes)
    links = routed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _cluster_links(batches, lanes, similarity), "a long, b long")
    return connected_components(links)


# --- exact comparison -----------------------------------------------------------------------------


def similar_pairs(sets: list[np.ndarray], left: np.ndarray | None, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of pairs of sets with the similarity: of all pairs, or of a set marked in ``left`` with one that isn't."""
    size = np.array([len(s) for s in sets], np.int64)
    if left is None and len(sets) == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row, shared = np.repeat(np.arange(len(sets)), size), count[code] > 1
        row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
        a = np.arange(len(sets)) if left is None else np.flatnonzero(left)
        b = np.arange(len(sets)) if left is None else np.flatnonzero(~left)
        common = np.zeros((len(a), len(b)), np.float32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for first in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
            s = slice(*np.searchsorted(code, [first, first + COLUMNS]))
            held = np.zeros((len(sets), COLUMNS), np.float32)
            held[row[s], code[s] - first] = 1
            common += held[a] @ held[b].T
        if left is not None:
            i, j = np.nonzero((common > 0) & (common >= similarity * (size[a][:, None] + size[b][None, :] - common) - 1e-6))
            return a[i], b[j]
    i, j = np.nonzero((common > 0) & (common >= similarity * (size[:, None] + size[None, :] - common) - 1e-6))
    return i[i < j], j[i < j]


def _block_links(batches, similarity, sided):
    """Links of the groups that the similar pairs of each block (rows of one ``(component, block)``) form."""

    def links(rows):
        node = np.array([r[0] for r in rows], np.int64)
        left = np.array([r[2] for r in rows], bool)
        groups = Groups(node)
        groups.join(*similar_pairs([np.frombuffer(r[1], np.uint64) for r in rows], left if sided and not left.all() else None, similarity))
        return groups.stars()

    key, held, out = None, [], []
    names = ["component", "block", "node", "s", "is_left"]
    for batch in batches:
        for c, b, node, s, is_left in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in names), strict=True):
            if (c, b) != key:
                if len(held) > 1:
                    out.append(links(held))
                key, held = (c, b), []
            held.append((node, s, is_left))
        yield _batch_of(out)
        out = []
    if len(held) > 1:
        yield _batch_of([links(held)])


def _batch_of(stars):
    a, b = (np.concatenate([np.zeros(0, np.int64), *(s[k] for s in stars)]) for k in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _compared(rows: DataFrame, similarity: float, sided: bool) -> DataFrame:
    dealt = rows.repartition("component", "block").sortWithinPartitions("component", "block")
    return stored(dealt.mapInArrow(lambda batches: _block_links(batches, similarity, sided), "a long, b long"))


def _blocks_of(shingles, texts):
    return F.greatest(F.ceil(shingles / BLOCK_SHINGLES), F.ceil(texts / BLOCK_TEXTS), F.lit(1)).cast("int")


def near_duplicate_groups(texts: DataFrame, text: str = "text", node: str = "node", size: int = NEAR_SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, component)`` of the nodes (distinct longs, each with one text) that have a near-duplicate: another text whose shingle set has a Jaccard similarity of ``similarity`` or more.

    ``component`` is the least node that near-duplicates reach. Texts without
    words are near-duplicates of nothing. A pair that no table brings into one
    cluster, directly or over others, is missed (about 2 % of lone pairs at a
    similarity of just 0.8); none is linked that is less similar than stated.
    """
    own = texts.select(F.col(node).alias("node"), F.col(text).alias("t"))
    wide = stored(wide_fingerprints(own, size))
    clusters = candidate_clusters(wide, similarity)
    members = stored(wide.select("node", "n").join(clusters, "node"))
    placed = placed_in_blocks(members)

    def sets(batches):
        for batch in batches:
            held = [batch.column(batch.schema.get_field_index(c)) for c in ("node", "component", "blocks")]
            yield pa.RecordBatch.from_arrays([*held, pa.array([s.tobytes() for s in _sets(batch, "t", size)], pa.binary())], names=["node", "component", "blocks", "s"])

    shingled = own.join(placed, "node").select("node", "component", "blocks", "t").mapInArrow(sets, "node long, component long, blocks int, s binary")
    return exact_groups(shingled, similarity)


def placed_in_blocks(members: DataFrame) -> DataFrame:
    """``members(node, n, component, ..)`` with ``blocks``: in how many blocks a cluster is compared."""
    blocks = members.groupBy("component").agg(_blocks_of(F.sum("n"), F.count("*")).alias("blocks"))
    return members.join(blocks, "component")


def exact_groups(shingled: DataFrame, similarity: float) -> DataFrame:
    """``(node, component)`` of the groups that pairs of sufficient similarity form within each cluster of ``shingled(node, component, blocks, s)``, ``s`` being the bytes of the ascending distinct hashes of a set."""
    shingled = stored(shingled.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")))
    # the first block of a cluster goes to all its blocks
    to = F.when((F.col("blocks") > 1) & (F.col("own") == 0), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    found = _compared(shingled.select("component", F.explode(to).alias("block"), "node", "s", F.lit(True).alias("is_left")), similarity, False)
    large = shingled.where("blocks > 1")
    if large.isEmpty():
        return connected_components(found)
    labelled = large.join(connected_components(found).withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    counts = labelled.groupBy("component", "label").agg(F.count("*").alias("n"))
    most = counts.groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    labelled = stored(labelled.join(most, "component").withColumn("rest", F.col("label") != F.col("most")).select("component", "node", "blocks", "own", "rest", "s"))
    shares = labelled.where("rest").groupBy("component").agg(_blocks_of(F.sum(F.length("s") / 8), F.count("*")).alias("rest_blocks"))
    both = labelled.join(shares, "component").withColumn("at", F.pmod(F.xxhash64("node"), "rest_blocks").cast("int"))
    # block m of the rest meets block b of the largest group as (m, b), and block m' >= m of the rest as (m, blocks + m')
    span = lambda a, b: F.sequence(F.lit(a) if isinstance(a, int) else a, b)
    key = lambda m, b, left: F.struct((m * (F.col("blocks") + F.col("rest_blocks")) + b).alias("block"), F.lit(left).alias("is_left"))
    as_left = F.transform(F.concat(span(0, F.col("blocks") - 1), span(F.col("blocks") + F.col("at"), F.col("blocks") + F.col("rest_blocks") - 1)), lambda b: key(F.col("at"), b, True))
    as_right = F.filter(F.transform(span(0, F.col("at")), lambda m: key(m, F.col("blocks") + F.col("at"), False)), lambda x: x["block"] < F.col("at") * (F.col("blocks") + F.col("rest_blocks")))
    of_most = F.transform(span(0, F.col("rest_blocks") - 1), lambda m: key(m, F.col("own"), False))
    rows = both.select("component", "node", "s", F.explode(F.when(F.col("rest"), F.concat(as_left, as_right)).otherwise(of_most)).alias("k"))
    more = _compared(rows.select("component", F.col("k.block").cast("long").alias("block"), "node", "s", "k.is_left"), similarity, True)
    return connected_components(found.union(more))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", size: int = NEAR_SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near-duplicates: of each group of equal or near-duplicate texts the row with the least id stays.

    Equal texts (null and blank ones too: null is the empty text) are one node.
    Groups are those of ``near_duplicate_groups``. Ids may be of any type that
    has an order; a null id comes last; of rows with equal ids and texts the
    other columns decide, and of wholly equal rows one stays. Columns are those
    of ``docs``, whatever their names; an empty table gives no rows.
    """
    digest, row, node = (spare(docs, f"_vs_{x}") for x in ("digest", "row", "node"))
    others = [quoted(c) for c in docs.columns if c not in (id_col, text)]
    key = quoted(id_col)
    keyed = docs.withColumns({digest: F.md5(F.coalesce(F.col(quoted(text)), F.lit("")).cast("binary")), row: F.xxhash64(F.col(key), F.to_json(F.struct(F.lit(0).alias("_"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(others)])))})
    order = F.struct(F.col(key).isNull().alias("no_id"), F.col(key).alias("id"), F.col(row).alias("row"))
    first = keyed.groupBy(digest).agg(F.min(order).alias("first")).withColumn(node, F.monotonically_increasing_id())
    nodes = stored(first.select(digest, node, "first"))
    picked = keyed.join(nodes.select(digest, F.col("first.row").alias(row), node), [digest, row]).dropDuplicates([digest, row])
    one = stored(picked.select(*[F.col(quoted(c)) for c in docs.columns], node))
    groups = near_duplicate_groups(one.select(F.col(node).alias("node"), F.col(quoted(text)).alias("text")), "text", "node", size, similarity)
    grouped = nodes.select(F.col(node).alias("node"), "first").join(groups, "node")
    stays = grouped.groupBy("component").agg(F.min(F.struct("first", "node"))["node"].alias("node"))
    goes = groups.select("node").join(stays, "node", "left_anti").select(F.col("node").alias(node))
    return one.join(goes, node, "left_anti").select(*[F.col(quoted(c)) for c in docs.columns])
