"""Permutations of blocks of participants are permutations of all."""

import numpy as np
from pyspark.sql import functions as F

from viewspan.operators import priorities as R


def test_levels_are_dealt_whole():
    counts, sizes = np.array([7, 20, 13]), np.array([9, 11, 5, 15])
    shares = [R.permuted_levels(counts, sizes, at, 3, 1, 4000) for at in range(4)]
    assert (sum(shares) == counts).all()
    for share, m in zip(shares, sizes):
        assert (share.sum(axis=1) == m).all()
        np.testing.assert_allclose(share.mean(axis=0), m * counts / 40, atol=0.1)
    drawn = R.permuted_codes(np.zeros(11, int), counts, sizes, 1, 3, 1, 4000)
    assert (np.stack([(drawn == c).sum(axis=1) for c in range(3)], axis=1) == shares[1]).all()
    np.testing.assert_allclose((drawn == 1).mean(axis=0), 0.5, atol=0.05)


def test_p_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    deck = np.repeat([-2.0, -1, 0, 1, 2], [1, 2, 3, 2, 1])
    rows = [("s", f"p{i}", i, j + 1, float(v)) for i in range(60) for j, v in enumerate(rng.permutation(deck))]
    sorts = spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double")
    people = sorts.select("study_id", "participant", "p_idx").distinct()
    groups = people.select("study_id", "participant", F.lit("a").alias("attribute"), (F.col("p_idx") % 3).cast("string").alias("level"))
    planted = sorts.withColumn("value", F.when((F.col("p_idx") % 3 == 0) & (F.col("stmt_num") == 1), 9.0).otherwise(F.col("value")))
    p = lambda s: R.permanova_test(s, groups, 1999).first()
    one = p(sorts)
    # the permutations of one block are those of the form before, over all sorts in one task
    x = np.array([v for *_, v in sorted(rows, key=lambda r: (r[1], r[3]))]).reshape(60, 9)
    codes = np.array([int(i[1:]) % 3 for i in sorted({r[1] for r in rows})])
    ssw = lambda c: sum(((x[c == k] - x[c == k].mean(0)) ** 2).sum() for k in range(3))
    more = 0
    for b in range(4):
        g = np.random.default_rng([1, b])
        more += sum(ssw(g.permutation(codes)) <= ssw(codes) * (1 + 1e-12) for _ in range(min(500, 1999 - 500 * b)))
    assert one["p"] == (more + 1) / 2000 and one["permutations"] == 1999
    monkeypatch.setattr(R, "PERMUTED", 13)
    many = p(sorts)
    assert abs(many["p"] - one["p"]) < 0.06 and abs(many["f"] - one["f"]) < 1e-9 and many["permutations"] == 1999
    assert p(planted)["p"] == 1 / 2000
    assert p(sorts.repartition(7))["p"] == many["p"]
