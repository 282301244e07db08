"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Maps A-Z to a-z and leaves every other byte, so non-ASCII letters keep their case.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's ``spark.checkpoint.dir``. Where it is unset, a local master (tests) gets a folder of our own; a cluster needs a shared one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="viewspan-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: ``df`` is written to the shared checkpoint folder and read from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder (smaller there than as a checkpoint, and it can be read by column)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/viewspan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> str:
    """A column name as ``F.col`` takes it, dots included."""
    return "`" + name.replace("`", "``") + "`"


def spare(df: DataFrame, name: str) -> str:
    """``name``, made longer until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def add_columns(df: DataFrame, fields: list[tuple[str, T.DataType, pa.DataType]], make) -> DataFrame:
    """``df`` with the columns of ``fields``, computed by ``make(batch) -> list of arrays`` for each Arrow batch.

    The other columns pass through untouched, whatever their type; a column of
    ``df`` that has the name of a new one is replaced. ``make`` sees a column
    with a dot in its name under another name, since Spark can't send it by its own.
    """
    dotted = {c: spare(df, f"_vs_{k}") for k, c in enumerate(df.columns) if "." in c or "`" in c}
    if dotted:
        safe = add_columns(df.select(*[F.col(quoted(c)).alias(dotted.get(c, c)) for c in df.columns]), fields, make)
        back = {v: k for k, v in dotted.items()}
        return safe.select(*[F.col(quoted(c)).alias(back.get(c, c)) for c in safe.columns])
    names = [f[0] for f in fields]
    kept = [c for c in df.columns if c not in names]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t, _ in fields])

    def run(batches):
        for batch in batches:
            new = [a if isinstance(a, pa.Array) else pa.array(a, type=t) for a, (_, _, t) in zip(make(batch), fields, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(c)) for c in kept] + new, names=kept + names)

    return df.mapInArrow(run, schema)


class Groups:
    """Groups of the nodes of one bounded batch, joined by arrays of row pairs; the least node stands for its group."""

    def __init__(self, nodes: np.ndarray) -> None:
        self.nodes, self.row = np.unique(nodes, return_inverse=True)
        self.of = np.arange(len(self.nodes))

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return self.of[self.row[i]] != self.of[self.row[j]]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.of[self.row[i]], self.of[self.row[j]]
        new = a != b
        if not new.any():
            return
        parent: dict[int, int] = {}

        def find(x):
            root = parent.setdefault(x, x)
            while parent[root] != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for x, y in np.unique(np.stack([np.minimum(a, b)[new], np.maximum(a, b)[new]]), axis=1).T.tolist():
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
        to = np.arange(len(self.nodes))
        to[list(parent)] = [find(x) for x in parent]
        self.of = to[self.of]

    def stars(self) -> tuple[np.ndarray, np.ndarray]:
        """(the group's least node, another of its nodes) for each such node."""
        other = np.flatnonzero(self.of != np.arange(len(self.nodes)))
        return self.nodes[self.of[other]], self.nodes[other]


#: Edges of one task when a graph is thinned before its components are found, and the fewest such tasks.
THIN_EDGES, THIN_TASKS = 200_000, 8


def _thinned(batches):
    held = [np.zeros((2, 0), np.int64)]
    for batch in batches:
        held.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
    pairs = np.concatenate(held, axis=1)
    groups = Groups(pairs.ravel())
    n = pairs.shape[1]
    groups.join(np.arange(n), np.arange(n, 2 * n))
    low, other = groups.stars()
    yield pa.RecordBatch.from_arrays([pa.array(other), pa.array(low)], names=["u", "v"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph of long ids as ``(node, component)``, the component being its least node.

    First every task reduces a bounded share of the edges to links with the
    least node of each group it sees, so that a dense group costs a few links a
    member from then on. Then alternating large-star and small-star rounds
    (Kiveris et al., 2014) on shuffled edge tables; every round is written to
    the checkpoint folder, so neither the plan nor recovery grows with the
    number of rounds. Nothing but counts and a checksum for each round reaches
    the driver. Self-loops, nulls and repeated edges are ignored; isolated
    nodes aren't returned.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = cut(e)
    e = cut(e.repartition(max(THIN_TASKS, -(-e.count() // THIN_EDGES))).mapInArrow(_thinned, "u long, v long").distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = cut(e)
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
