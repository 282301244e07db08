"""Exact and drawn tests, workbook layouts, attribute specifications and other parts without SQL."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewspan.functions.distributions import chi2_sf, normal_p2, t_p2
from viewspan.operators import attributes as A
from viewspan.operators import bayes as B
from viewspan.operators import comparisons as M
from viewspan.operators import plotdata as G
from viewspan.sources import delimited as D
from viewspan.sources import kenq as K


def test_tails(spark):
    rows = [(0.0, 0.0, 1), (1.0, 1.0, 1), (1.959963984540054, 3.841458820694124, 1), (-3.0, 7.0, 3), (12.0, 40.0, 10), (0.5, 11.07049769351635, 5), (2.0, 12.591587243743977, 6)]
    got = spark.createDataFrame(rows, "z double, x double, df int").select(normal_p2(F.col("z")), chi2_sf(F.col("x"), F.col("df")), t_p2(F.col("z"), F.col("df"))).collect()
    for (z, x, df), (p, c, t) in zip(rows, got, strict=True):
        assert abs(p - math.erfc(abs(z) / math.sqrt(2))) < 1e-12
        grid = np.linspace(0, max(x, 1e-9), 400_001)[1:]
        density = np.exp((df / 2 - 1) * np.log(grid) - grid / 2 - math.lgamma(df / 2) - df / 2 * math.log(2))
        assert abs(c - (1 - density.sum() * grid[0])) < 5e-3
        grid = np.linspace(0, abs(z), 200_001)
        density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + grid**2 / df) ** (-(df + 1) / 2)
        assert abs(t - (1 - 2 * (density.sum() - (density[0] + density[-1]) / 2) * (grid[1] - grid[0]))) < 1e-6
    assert [round(r[1], 6) for r in got[-2:]] == [0.05, 0.05]


def test_drawn_tests():
    parts = [np.array([1.0, 2, 3]), np.array([2.0, 4, 5]), np.array([6.0, 7])]
    r = np.concatenate(parts).argsort().argsort()
    assert len(r) == 8
    values = np.concatenate(parts)
    ranks = np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])
    stat = lambda x: x[:3].sum() ** 2 / 3 + x[3:6].sum() ** 2 / 3 + x[6:].sum() ** 2 / 2
    seen = stat(ranks)
    exact = np.mean([stat(np.array(x)) >= seen - 1e-9 for x in itertools.permutations(ranks)])
    assert abs(M.kruskal_draws(parts, 100_000, [1]) - exact) < 0.005
    table = np.array([[3, 1], [1, 3]])
    assert abs(M.simulated_fisher(table, 20_000, 1) - 34 / 70) < 0.02  # 16 + 16 + 1 + 1 of 70 tables are as improbable


def test_small_levels(spark):
    rng = np.random.default_rng(3)
    rows = [("s", f"p{k}", k, j, float(rng.integers(-3, 4) + (2 if j == 1 and k < 6 else 0))) for k in range(18) for j in (1, 2, 3)]
    sorts = spark.createDataFrame(rows + [("s", f"p{k}", k, 4, 1.0) for k in range(18)], "study_id string, participant string, p_idx int, stmt_num int, value double")
    groups = spark.createDataFrame([("s", f"p{k}", "three", "abc"[k // 6]) for k in range(18)] + [("s", f"p{k}", "two", "xy"[k // 9]) for k in range(18)], "study_id string, participant string, attribute string, level string")
    gates = groups.select("study_id", "attribute").distinct().withColumn("passed", F.lit(True))
    got = {(r["attribute"], r["stmt_num"]): r for r in M.compare_groups(sorts, groups, gates, draws=20_000).collect()}
    assert len(got) == 8 and got["three", 4]["label"] == "Not testable (no variation)" and got["three", 4]["p"] is None
    assert got["two", 1]["test"] == "mann_whitney" and got["three", 1]["test"] == "kruskal_wallis"
    for j in (1, 2, 3):
        parts = [np.array([v for _, p, k, s, v in rows if s == j and k // 9 == g]) for g in (0, 1)]
        both = np.concatenate(parts)
        ranks = np.array([(both < v).sum() + ((both == v).sum() + 1) / 2 for v in both])
        sums = np.array([ranks[list(c)].sum() for c in itertools.combinations(range(18), 9)])
        exact = np.mean(np.abs(sums - sums.mean()) >= abs(ranks[:9].sum() - sums.mean()) - 1e-9)
        assert abs(got["two", j]["p"] - exact) < 1e-9 and got["two", j]["hl_lower"] <= got["two", j]["hl_shift"] <= got["two", j]["hl_upper"]
    none = M.compare_groups(sorts, groups, gates.withColumn("passed", F.lit(False)), draws=100)
    assert {r["label"] for r in none.collect()} == {"No overall group difference"}
    assert M.compare_groups(sorts.limit(0), groups, gates, draws=100).count() == 0


def test_numeric_notes(spark):
    sorts = spark.createDataFrame([("s", f"p{k}", k, j, float(k * j % 5) if j < 3 else 1.0) for k in range(8) for j in (1, 2, 3)], "study_id string, participant string, p_idx int, stmt_num int, value double")
    numbers = spark.createDataFrame([("s", f"p{k}", "age", float(k)) for k in range(8)] + [("s", f"p{k}", "same", 2.0) for k in range(8)] + [("s", f"p{k}", "few", float(k)) for k in range(3)], "study_id string, participant string, attribute string, num double")
    gates = spark.createDataFrame([("s", "age", True)], "study_id string, attribute string, passed boolean")
    got = {(r["attribute"], r["stmt_num"]): (r["note"], r["label"]) for r in M.compare_numbers(sorts, numbers, gates).collect()}
    assert got["age", 3] == ("no variation, not testable", "Not testable (no variation)")
    assert got["same", 1] == ("attribute has no variation, not testable", "Not compared (insufficient data)")
    assert got["few", 2] == ("not compared, n = 3", "Not compared (insufficient data)")


WANT = ([["Ann", "Bob"], [[-1.0, 0.0, 1.0, 0.0], [1.0, 0.0, 0.0, -1.0]]])


def test_grid_layouts():
    by_value = [["Respondent", "Ann", "Bob"], [-1, 1, 4], [0, 2, 2], [0, "4.0", 3], [1, 3, 1]]
    assert K.grid_sorts(by_value) == (*WANT, [1, 2, 1], "by_value")
    assert K.grid_sorts(by_value, kind=1)[:2] == tuple(WANT)
    by_person = [["Ann", -1, 0, 1, 0], ["Bob", 1, 0, 0, -1], [None, None]]
    assert K.grid_sorts(by_person) == (*WANT, None, "by_person") and K.grid_sorts(by_person, kind=2)[3] == "by_person"
    pattern = [["Sort Pattern", -1, 0, 0, 1], ["4"], *by_person]
    assert K.grid_sorts(pattern) == (*WANT, [1, 2, 1], "by_person_old") and K.grid_sorts(pattern, kind=2)[3] == "by_person_old"
    heading = [["0", "x"], ["1", "My project"], *[[k - 10, None] for k in range(20)], ["", "Ann", "Bob"], *by_value[1:]]
    assert K.grid_sorts(heading) == (*WANT, [1, 2, 1], "by_value_old")
    twice = [["", "Ann"], [-1, 1], [1, 1], [0, 9], [0, None]]
    assert K.grid_sorts(twice, 2)[1] == [[1.0, None]]
    with pytest.raises(ValueError):
        K.grid_sorts([[1, 2, 3], [4, 5, 6]])
    assert K.pattern_deck([["-2", "-1", "0", "1", "2"], [0, 1, 2, 0, 1, 0], []]) == [1, 2, 0, 1]
    sheets = {"Sorts": [[None]], "Example - sorts": by_person, "Statements": [[1, "a"], [2, "."], [3, "c"], [4, "d"]], "Type": [["kind", 2]]}
    people, values, texts, deck, name = K.project_workbook(sheets)
    assert (people, values, name) == (*WANT, "by_person") and texts == ["a", "c", "d"] and deck is None


def test_rows_of_a_split_file(spark, tmp_path):
    """Ids and attribute rows follow the file, also when it is read in many pieces."""
    n = 3000
    (tmp_path / "big.csv").write_text("a,b,c\n" + "".join(f"{k % 5},{k % 3},{k % 7}\n" for k in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        assert spark.read.csv(str(tmp_path / "big.csv")).rdd.getNumPartitions() > 4
        rows = D.read_attributes(spark, str(tmp_path / "big.csv")).where("attribute = 'c'").collect()
        assert sorted((r["row"], r["raw"]) for r in rows) == [(k + 1, str(k % 7)) for k in range(n)]
        people = {r["participant"] for r in D.read_sorts(spark, str(tmp_path / "big.csv")).select("participant").distinct().collect()}
        assert people == {f"P{k + 1}" for k in range(n)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_binning_settings():
    with pytest.raises(ValueError):
        A.checked_binning("numeric", breaks=[1, 1, 2], labels=["a", "b"])
    with pytest.raises(ValueError):
        A.checked_binning("categorical", levels=["a", "b"], mapping={"a": "x"})
    with pytest.raises(ValueError):
        A.checked_binning("categorical", levels=["a"], mapping={"a": "x"}, order=["y"])
    assert A.renamed({"a": "b", "c": None}, {"b": "d"}, {"d": "e"}) == {"a": "e", "c": None}


def test_linkage_order(spark):
    r = {(1, 2): 0.9, (1, 3): 0.1, (1, 4): 0.2, (2, 3): 0.0, (2, 4): 0.1, (3, 4): 0.8}
    corr = spark.createDataFrame([("s", a, b, v) for (a, b), v in r.items()], "study_id string, p_i int, p_j int, r double")
    places = {x["p_idx"]: x["place"] for x in G.linkage_order(corr).collect()}
    assert places == {1: 1, 2: 2, 3: 3, 4: 4} and G.correlation_frame(corr).count() == 16
    with pytest.raises(ValueError):
        G.frame("none", {})


def test_longer_runs_and_sizes(spark):
    assert B.continued(12_000, [2, 3], "sampling") == (24_000, [2, 3]) and B.continued(40_000, [2], "sampling")[0] == 48_000
    assert B.continued(12_000, [6, 7], "k") == (12_000, [6, 7, 8])
    rng = np.random.default_rng(5)
    white, walk = rng.normal(size=400), [0.0]
    for x in rng.normal(size=399):
        walk.append(0.9 * walk[-1] + x)
    rows = [("s", 2, 0, d, "loading", 1, f, float(v)) for f, chain in ((1, white), (2, walk)) for d, v in enumerate(chain)]
    ess = {r["factor"]: r["ess"] for r in B.effective_sizes(spark.createDataFrame(rows, "study_id string, k int, chain int, draw int, kind string, item int, factor int, value double")).collect()}
    assert ess[1] > 200 and 8 < ess[2] < 80
