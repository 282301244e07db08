"""op9 against its SQL, and the Poisson draw against the distribution."""

import math
from collections import Counter

from pyspark.sql import functions as F

from tests.oracle import connect, differences
from viewspan.llm import mixing as M

SF = "/root/testdata/sf0.001"


def test_against_sql(spark):
    assert differences(M.op9_source_mixing(spark, SF), connect(SF), M.OP9_SQL) is None


def test_draw_follows_poisson(spark):
    for rate in (0.3, 2.5, 200.0):
        parts = max(1, math.ceil(rate / M.PART))
        df = spark.range(20_000).withColumn("k", M.copies(M.cumulative(F.lit(rate / parts)), F.lit(parts), 1, "id"))
        mean, var = df.agg(F.avg("k"), F.var_samp("k")).first()
        assert abs(mean - rate) < 5 * math.sqrt(rate / 20_000) and abs(var / rate - 1) < 0.06


def test_targets_and_edges(spark):
    rows = [(k, "t", "big" if k % 3 else "small") for k in range(6000)] + [(None, None, None), (None, None, None), (1, "t", "none")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, `_vs.c` int")
    weights = spark.createDataFrame([("big", 1.0), ("small", 3.0), ("absent", 9.0), ("none", -1.0)], "source string, weight double")
    got = Counter(r["source"] for r in M.mix(df, weights, size=8000).collect())
    assert abs(got["small"] - 6000) < 400 and abs(got["big"] - 2000) < 250 and set(got) == {"big", "small"}
    assert M.mix(df.limit(0)).count() == 0
    assert M.mix(df).columns == ["doc_id", "text", "source", "_vs.c", "copy_no"]
    again = sorted(map(str, M.mix(df.repartition(7)).collect()))
    assert again == sorted(map(str, M.mix(df).collect()))
