"""Draws are sampled once for each fingerprint and K, and read back for every error rate."""

import os

import pytest
from pyspark.sql import functions as F

from viewspan.operators import bayes as B

SHORT = dict(chains=2, iterations=60, burn=20, thin=4)


@pytest.fixture(scope="module")
def study(spark):
    from viewspan.plans import queries as Q

    return Q.sorts(spark, "/root/testdata/sf0.001").where("p_idx <= 12").withColumn("study_id", F.lit("007"))


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_store(spark, study, tmp_path):
    root = str(tmp_path)
    first = B.stored_draws(study, [1, 2], root, **SHORT)
    rows = lambda df: sorted(map(tuple, df.collect()))
    fresh = rows(B.draws(study, [1, 2], **SHORT))
    assert rows(first) == fresh and first.columns == B.draws(study, [1], **SHORT).columns
    assert {r[0] for r in fresh} == {"007"}
    before = files(root)
    # the same cells in other partitions and with another column: nothing is sampled
    again = B.stored_draws(study.repartition(5).withColumn("more", F.lit(1)), [2], root, **SHORT)
    assert rows(again) == [r for r in fresh if r[1] == 2] and files(root) == before
    assert rows(B.fdr_claims(B.flag_claims(again, 0.05).drop("claimed", "expected_false"), 0.1, B.KEYS)) == rows(B.flag_claims(again, 0.1))
    # a larger K is appended, those that are there stay as they are
    more = B.stored_draws(study, [1, 2, 3], root, **SHORT)
    assert sorted(r[0] for r in more.select("k").distinct().collect()) == [1, 2, 3]
    after = files(root)
    assert before.items() <= after.items() and all("/k-3/" in f for f in after.keys() - before.keys())
    assert rows(more.where("k = 3")) == rows(B.draws(study, [3], **SHORT))
    # other cells, settings: other draws
    marks = {B.fingerprint(study, 2, 60, 20, 4, 42), B.fingerprint(study.withColumn("value", -F.col("value")), 2, 60, 20, 4, 42), B.fingerprint(study, 2, 120, 20, 4, 42), B.fingerprint(study.where("p_idx < 5"), 2, 60, 20, 4, 42)}
    assert len(marks) == 4
    assert B.stored_draws(study, [], root, **SHORT).count() == 0


def test_interrupted_batch_is_sampled_anew(spark, study, tmp_path):
    root = str(tmp_path)
    whole = B.stored_draws(study, [2], root, **SHORT)
    n = whole.count()
    (batch,) = {f.split("/by_study")[0] for f in files(root)}
    os.remove(f"{batch}/_SUCCESS")
    os.remove(sorted(files(root))[0])
    assert B.stored_draws(study, [2], root, **SHORT).count() == n
