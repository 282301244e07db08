"""Packed draws say what long ones say, and each chain is a task of its own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewspan.operators import bayes as B
from viewspan.operators import predictive as P


@pytest.fixture(scope="module")
def both(spark):
    rng = np.random.default_rng(5)
    deck = np.repeat([-2.0, -1, 0, 1, 2], [1, 2, 3, 2, 1])
    rows = [("s", f"p{i}", 3 * i + 1, j + 1, float(v)) for i in range(9) for j, v in enumerate(rng.permutation(deck))]
    sorts = spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double")
    lengths = {"iterations": 90, "burn": 30, "thin": 2}
    of = lambda schema, **k: spark.createDataFrame(B.draws(sorts, [1, 2, 3], **lengths, **k).toPandas(), schema).cache()
    whole, B.PIECE = B.PIECE, 7
    try:
        yield sorts, of(B.DRAWS), of(B.PACKED, packed=True)
    finally:
        B.PIECE = whole


def rows(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=str)


def test_packed_rows_hold_the_same_draws(both):
    _, long, packed = both
    assert packed.agg(F.max(F.size("values") / F.col("k"))).first()[0] == 7
    assert rows(B.long(packed)) == rows(long)
    assert rows(B.long(packed, "zscore")) == rows(long.where("kind = 'zscore'"))


@pytest.mark.parametrize("read", [
    lambda d: B.summary(d, "loading"), lambda d: B.summary(d, "zscore"), B.convergence, B.flag_claims, B.distinguishing_claims, B.consensus_claims,
    B.star_claims, B.claim_families, B.claims, B.ladder, B.effective_sizes,
])
def test_readers_take_both(both, read):
    _, long, packed = both
    assert rows(read(packed)) == rows(read(long))


def test_checks_take_both(both):
    sorts, long, packed = both
    assert rows(P.checked_draws(packed, sorts, 4)) == rows(P.checked_draws(long, sorts, 4))


def test_each_chain_is_a_task(both):
    sorts, *_ = both
    one = B.draws(sorts, [1, 2, 3, 4, 5], iterations=12, burn=10, thin=2).withColumn("task", F.spark_partition_id())
    assert one.groupBy("task").agg(F.count_distinct("k", "chain").alias("n")).agg(F.max("n"), F.count("*")).first()[:] == (1, 10)
