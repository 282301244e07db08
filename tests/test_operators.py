"""Fixtures with known answers, and invariants of what has no SQL."""

import inspect

import numpy as np
import pytest
from pyspark.sql import functions as F

from viewspan.operators import attributes as A
from viewspan.operators import bayes as B
from viewspan.operators import correlation as C
from viewspan.operators import extraction as X
from viewspan.operators import factors as V
from viewspan.operators import priorities as R
from viewspan.operators import study as S
from viewspan.plans import analyze as N
from viewspan.plans import queries as Q

SF = "/root/testdata/sf0.01"


def long(spark, rows, study="s"):
    return spark.createDataFrame([(study, f"P{i}", i, j, float(v) if v is not None else None) for i, r in enumerate(rows, 1) for j, v in enumerate(r, 1)], S.SORTS)


def planted():
    """24 sorts on 12 statements, deck 1-3-4-3-1: the first half puts S1 on top, the second at the bottom."""
    a, b = [-2] + [-1] * 3 + [0] * 4 + [1] * 3, [-1] * 3 + [0] * 4 + [1] * 3 + [2]
    rows = []
    for i in range(1, 25):
        pair = (i + 1) // 2
        rest, shift, top = (a, pair - 1, 2) if pair <= 6 else (b, pair - 7, -2)
        rows.append([top, *rest[shift:], *rest[:shift]])
    return rows


DECK = [1, 3, 4, 3, 1]


@pytest.fixture(scope="module")
def prior(spark):
    return long(spark, planted()).cache()


@pytest.fixture(scope="module")
def halves(spark):
    rows = [("s", f"P{i}", a, v) for i in range(1, 25) for a, v in (("grp", "A" if i <= 12 else "B"), ("rand", "XY"[i % 2]), ("age3", "18-40" if i <= 10 else "41-70" if i <= 20 else "71+"))]
    return spark.createDataFrame(rows, "study_id string, participant string, attribute string, level string")


def test_decks():
    assert [S.deck_neutral(d) for d in ([1, 3, 4, 3, 1], [1, 2, 2, 1], [1, 2, 4, 3, 2], [1, 2, 3, 2])] == [0, 0, 0.25, 0.375]
    with pytest.raises(ValueError):
        S.deck_neutral([-1, 2])
    assert all(sum(d) == j or d[len(d) // 2] == 0 for j in range(5, 90) for d in [S.default_deck(j)]) and S.default_deck(25) == S.DECK
    assert sum(S.fitted_deck([1, 2, 3, 2, 1], 20)) == 20


def test_priorities(prior, halves):
    t = {r["stmt_num"]: r for r in R.ranked_table(prior, DECK).collect()}
    assert len(t) == 12 and all(r["n_above"] + r["n_at"] + r["n_below"] == 24 for r in t.values())
    usable = R.usable_levels(halves)
    assert {r["note"] for r in R.level_notes(halves).collect()} == {"level '71+' not compared, n = 4"}
    gates = R.permanova_test(prior, usable, 199)
    g = {r["attribute"]: r for r in gates.collect()}
    assert g["grp"]["passed"] and g["grp"]["p"] == pytest.approx(1 / 200) and not g["rand"]["passed"] and g["rand"]["r2"] < 1e-9
    tests = {(r["attribute"], r["stmt_num"]): r for r in R.group_tests(prior, usable, gates).collect()}
    s1 = tests["grp", 1]
    assert s1["test"] == "mann_whitney" and s1["flagged"] and s1["effect"] == 1 and s1["hl"] == pytest.approx(4, abs=1e-3) and s1["label"].startswith("A higher")
    assert all(r["label"] == "No overall group difference" for (a, _), r in tests.items() if a == "rand")
    assert tests["age3", 1]["n_levels"] == 2
    w = R.kendall_w(prior).first()
    assert w["df"] == 11 and w["chi2"] == pytest.approx(24 * 11 * w["w"])
    assert R.top_n(prior, halves, 5).count() == 35


def test_tiny_study(spark):
    tiny = long(spark, [[-1, 0, 1], [1, 0, -1]])
    t = R.ranked_table(tiny, [1, 1, 1]).collect()
    assert all(r["mean"] == 0 and r["rank"] == 1 and r["tied"] for r in t)
    n = {r["stmt_num"]: r for r in R.neutral_tests(tiny, [1, 1, 1]).collect()}
    assert n[2]["label"] == "Not testable (no variation)"


def test_flags(spark):
    rows = [[0.8, 0.2, 0.1], [0.2, 0.85, 0.1], [0.6, 0.5, 0.3], [0.1, 0.1, 0.9], [0.5, 0.5, 0.5]]
    load = spark.createDataFrame([("s", f"Q{i}", f, v) for i, r in enumerate(rows, 1) for f, v in enumerate(r, 1)], "study_id string, participant string, factor int, loading double")
    got = {(r["participant"], r["factor"]) for r in V.flag_auto(load, 40).where("flagged").collect()}
    assert got == {("Q1", 1), ("Q2", 2), ("Q3", 1), ("Q4", 3)}


def test_scores(spark):
    sorts = long(spark, [[-2, -1, 0, 1, 2]] * 2 + [[2, 1, 0, -1, -2]] * 2)
    load = spark.createDataFrame([("s", f"P{i}", f, v, (f == 1) == (i <= 2)) for i, r in enumerate([[0.8, 0.1], [0.7, 0.2], [0.1, 0.8], [0.2, 0.7]], 1) for f, v in enumerate(r, 1)], "study_id string, participant string, factor int, loading double, flagged boolean")
    sc = V.factor_scores(sorts, load, [1, 1, 1, 1, 1])
    assert sc.count() == 10 and V.score_correlations(sc).first()["r"] < 0
    z = spark.createDataFrame([("s", 1, k + 1, v) for k, v in enumerate([1.5, 1.0, 0.5, 0.0, -0.5, -1.0, -1.5])], "study_id string, factor int, stmt_num int, zscore double")
    assert [r["score"] for r in V.with_grid_score(z, [1, 2, 1, 2, 1]).orderBy("stmt_num").collect()] == [2, 1, 1, 0, -1, -1, -2]


def test_reliability(spark):
    rows = [("s", f"{n}-{k}", f, 0.7, True) for f, n in enumerate([1, 2, 3, 5, 10, 20], 1) for k in range(n)]
    c = V.characteristics(spark.createDataFrame(rows, "study_id string, participant string, factor int, loading double, flagged boolean")).orderBy("factor").collect()
    assert [round(r["composite_reliability"], 3) for r in c] == [0.8, 0.889, 0.923, 0.952, 0.976, 0.988]


def test_distinguishing(spark):
    def run(f, sed):
        k = len(f)
        sc = spark.createDataFrame([("s", i, j, float(v)) for i, r in enumerate(f, 1) for j, v in enumerate(r, 1)], "study_id string, factor int, stmt_num int, zscore double")
        sm = spark.createDataFrame([("s", a, b, sed) for a in range(1, k + 1) for b in range(1, k + 1)], "study_id string, f int, g int, sed double")
        pairs = V.pairwise(sc, sm)
        return V.distinguishing(pairs), {r["stmt_num"]: r["category"] for r in V.statement_class(sc, pairs).collect()}

    d, c = run([[2, 1.5, 0, -1, -2], [-2, -1.5, 0, 1, 2]], 0.3)
    assert {r["stmt_num"] for r in d.collect()} == {1, 2, 4, 5} and c[3] == "Consensus"
    d, c = run([[2, 1.5, 0.5, -0.5, -1.5, 0, 0.8, -0.8, 1.2, -1.2], [0.5, 0.3, 0.5, -0.3, -0.5, 0, 2, -2, 0.5, -0.5], [0.3, 0.2, 0.3, -0.2, -0.3, 0, 0.3, -0.3, 0.5, -0.5]], 0.15)
    assert d.where("factor = 2").count() > 0 and c[6] == "Consensus"
    d, c = run([[1, 0.5, 0, -0.5, -1]], 0.3)
    assert set(c.values()) == {"Consensus"}


def test_attributes(spark):
    p = spark.createDataFrame([("s", f"qsort{k}") for k in (1, 2, 7)], "study_id string, participant string")
    a = spark.createDataFrame([("s", r, c, v) for r, vals in enumerate((("1", "x"), ("2", "y"), ("2", "z"), ("8", "w")), 1) for c, v in zip(("id", "fact"), vals)], "study_id string, row int, attribute string, raw string")
    assert {(r["participant"], r["row"]) for r in A.match(p, a).collect()} == {("qsort1", 1), ("qsort2", 2), ("qsort7", None)}
    rep = A.match_report(p, a).first()
    assert (rep["id_col"], rep["matched"], rep["unmatched"], rep["normalized"]) == ("id", 2, 1, True)
    v = spark.createDataFrame([(float(x),) if x is not None else (None,) for x in (0, 50, 51, None, 120)], "v double")
    assert [r[0] for r in v.select(A.bin_numeric(F.col("v"), [0, 50, 100], ["low", "high"])).collect()] == ["low", "low", "high", None, None]
    with pytest.raises(ValueError):
        A.bin_numeric(F.lit(1), [1, 1], ["x"])


def test_careless_and_missing(spark):
    rows = np.random.default_rng(1).integers(-2, 3, (8, 10)).tolist() + [[0] * 10]
    s = long(spark, rows)
    out = {r["participant"]: r for r in C.careless(s, C.pearson(s), [1, 2, 4, 2, 1]).collect()}
    assert out["P9"]["variance"] == 0 and out["P9"]["signs"] >= 1
    assert C.kendall(s).where("p_i = 1 and p_j = 9").first()["r"] is None


@pytest.fixture(scope="module")
def study(spark):
    return Q.sorts(spark, SF).cache()


def test_varimax_recovers_regions(spark, study):
    load = X.extract(study, 5, "pca", "varimax")
    view = Q.viewpoints(spark, SF, 5).select("study_id", "participant", "factor", "loading")
    phi = np.abs(np.array([[r["phi"] for r in V.tucker(load, view).orderBy("f", "g").collect()]]).reshape(5, 5))
    assert sorted(phi.argmax(axis=1)) == list(range(5)) and phi.max(axis=1).min() > 0.9


def test_parallel_analysis_is_partition_free(spark, study):
    a, b = (X.parallel_analysis(s, 20, seed=3).orderBy("k").collect() for s in (study, study.repartition(7)))
    assert [r["threshold"] for r in a] == pytest.approx([r["threshold"] for r in b]) and sum(r["retain"] for r in a[:8]) >= 4


def test_bootstrap(spark, study):
    s = study.where("p_idx <= 60")
    boot, original = X.bootstrap(s, 3, 20).cache(), X.original_solution(s, 3)
    ci = X.bootstrap_ci(boot, original)
    assert ci.where("ci_low > boot_mean or boot_mean > ci_high").count() == 0
    st = {r["kind"]: r for r in X.stability(boot, original).collect()}
    assert st["loading"]["mean"] > 0.7 and st["loading"]["replicates"] == 20
    f = X.flag_frequency(boot)
    assert f.where("flag_frequency > flag_frequency_when_sampled + 1e-12").count() == 0


def test_bayes(spark, study):
    s = study.where("p_idx <= 30")
    d = B.draws(s, [1, 2], 2, 120, 60, 2).cache()
    assert d.groupBy("k", "chain").agg(F.max("draw")).count() == 4
    load = B.summary(d, "loading")
    assert load.where("abs(mean) > 1 or low > mean or mean > high").count() == 0
    claims = B.flag_claims(d)
    assert claims.where("claimed and p < 0.5").count() == 0
    rungs = B.ladder(d).select("study_id", "k", F.lit(True).alias("adequate"), F.col("adequate").alias("supported"))
    assert B.verdicts(rungs).first()["verdict"] in ("selected", "adequate_but_unsupported")
    assert B.to_flags(d, 2, s).count() == 2 * s.select("p_idx").distinct().count()


def test_whole_analyses(spark, study, tmp_path):
    from viewspan.plans import analyze as N

    s = study.where("p_idx <= 40")
    for flagging in ("auto", "theoretical", "manual"):
        out = N.analyze(s, S.DECK, 3, flagging=flagging)
        assert out["flags"].count() == 3 * s.select("p_idx").distinct().count()
    out = N.analyze(s, S.DECK, 3)
    assert out["arrays"].groupBy("factor").agg(F.sum("score").alias("t")).where("t <> 0").count() == 0
    edits = out["flags"].where("factor = 1").select("study_id", "participant", "factor", F.lit(False).alias("flagged"))
    assert N.recalculate_after_flagging(s, out["flags"], edits, S.DECK)["scores"].where("factor = 1").count() == 0
    with pytest.raises(ValueError):
        N.analyze(s, S.DECK, 3, p=1.5)
    groups = Q.groups(spark, SF)
    got = N.priorities(s, S.DECK, groups, Q.numbers(spark, SF), ("band",), permutations=99)
    assert set(got) == {"table", "neutral", "concordance", "gates", "tests", "notes", "top", "concordance_by_level", "numeric"}
    assert got["gates"].where("attribute = 'acctbal'").count() == 1


def test_registered_sizes(spark, monkeypatch):
    """Registered queries take all participants and the operators' own lengths."""
    seen = {}

    def noting(name, real):
        def call(sorts, *args, **kwargs):
            bound = inspect.signature(real).bind(sorts, *args, **kwargs)
            bound.apply_defaults()
            seen[name] = dict(bound.arguments, n=sorts.select("participant").distinct().count())
            raise StopIteration

        return call

    for module, name, query in ((B, "draws", "bayes_loadings"), (R, "permanova_test", "group_tests"), (X, "bootstrap", "bootstrap_ci"), (N, "priorities", "priorities_numeric_gate")):
        monkeypatch.setattr(module, name, noting(name, getattr(module, name)))
        with pytest.raises(StopIteration):
            Q.QUERIES[query].run(spark, SF)
    everyone = Q.sorts(spark, SF).select("participant").distinct().count()
    assert {v["n"] for v in seen.values()} == {everyone} and everyone > 40
    assert [seen["draws"][k] for k in ("iterations", "burn", "thin")] == [12_000, 2_000, 5] and {2, 3, 4, 5} <= set(seen["draws"]["ks"])
    assert seen["permanova_test"]["permutations"] == seen["priorities"]["permutations"] == 9_999
    assert seen["bootstrap"]["replicates"] == 1_000


def test_claims_of_one_reading(spark):
    rng = np.random.default_rng(3)
    deck = np.repeat([-2.0, -1, 0, 1, 2], [1, 2, 3, 2, 1])
    rows = [("s", f"p{i}", i + 1, j + 1, float(v)) for i in range(8) for j, v in enumerate(rng.permutation(deck))]
    sorts = spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double")
    draws = spark.createDataFrame(B.draws(sorts, [1, 2], iterations=60, burn=20, thin=2).toPandas(), B.DRAWS)
    assert draws.count() == 2 * 20 * (8 + 9) * 3
    key = lambda df: sorted((r["k"], r["item"], r["factor"], round(r["p"], 12), r["claimed"]) for r in df.collect())
    both = B.claims(draws).cache()
    assert key(both.where("kind = 'loading'")) == key(B.flag_claims(draws))
    assert key(both.where("kind = 'zscore' and k = 2")) == key(B.distinguishing_claims(draws))
    assert {r["k"] for r in B.ladder(draws).collect()} == {1, 2}


def test_latents_keep_the_order_of_the_grid():
    rng = np.random.default_rng(5)
    x = np.stack([rng.permutation([-1.0, -1, 0, 0, 0, 1, 1]) for _ in range(5)] + [np.array([-2.0, -2, 3, 3, 3, 3, 3])])
    y = x + 1e-3 * rng.random(x.shape)
    for _ in range(20):
        y = B._latents(y, rng.standard_normal(x.shape), B._columns(x), rng)
        for values, latents in zip(x, y):
            tops = [latents[values == c] for c in np.unique(values)]
            assert all(a.max() < b.min() for a, b in zip(tops, tops[1:]))
