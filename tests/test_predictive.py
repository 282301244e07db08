"""Posterior predictive checks against plain versions, and the ladder that rests on them."""

import numpy as np
import pytest

from viewspan.operators import bayes as B
from viewspan.operators import predictive as P

DECK = np.repeat([-3.0, -2, -1, 0, 1, 2, 3], [2, 3, 4, 6, 4, 3, 2])


def people(n, factors, noise, seed):
    rng = np.random.default_rng(seed)
    views = rng.standard_normal((factors, len(DECK)))
    y = 1.6 * views[np.arange(n) % factors] + noise * rng.standard_normal((n, len(DECK)))
    return DECK[y.argsort(axis=1).argsort(axis=1)]


def as_sorts(spark, studies):
    rows = [(s, f"p{i}", i + 1, j + 1, float(v)) for s, x in studies.items() for i, r in enumerate(x) for j, v in enumerate(r) if not np.isnan(v)]
    return spark.createDataFrame(rows, "study_id string, participant string, p_idx int, stmt_num int, value double")


def stored(spark, sorts, ks, **lengths):
    return spark.createDataFrame(B.draws(sorts, ks, **lengths).toPandas(), B.DRAWS).cache()


@pytest.fixture(scope="module")
def two(spark):
    sorts = as_sorts(spark, {"two": people(40, 2, 1.0, 5)}).cache()
    draws = stored(spark, sorts, [1, 2], iterations=900, burn=300, thin=3)
    return sorts, draws, P.checked_draws(draws, sorts, 2).cache()


def test_discrepancies_are_those_of_whole_sorts():
    x = people(30, 3, 1.0, 1)
    x[4, 7] = x[9, 0] = np.nan
    rng = np.random.default_rng(2)
    load, f = rng.uniform(-0.6, 0.6, (30, 2)), rng.standard_normal((2, len(DECK)))
    sums = P.block_sums(x, load, f, np.random.default_rng(7))
    rep, mean = P.replicate(x, load, f, np.random.default_rng(7))
    got = P.discrepancies(sums, f)
    assert (np.isnan(rep) == np.isnan(x)).all() and (np.sort(rep, axis=1)[0] == np.sort(x, axis=1)[0]).all()
    assert (np.sort(rep, axis=1)[4, :-1] == np.sort(x, axis=1)[4, :-1]).all()
    for at, y in ((0, x), (1, rep)):
        u = P._units(y)
        r = u @ u.T
        assert got[at] == pytest.approx(r[np.triu_indices(30, 1)].mean())
        left = u - u @ np.linalg.pinv(f) @ f
        assert got[2 + at] == pytest.approx(np.linalg.svd(left)[1][0] ** 2 / (u**2).sum())
        d = np.zeros(len(DECK))
        for j in range(len(DECK)):
            for i in range(len(DECK)):
                both = ~np.isnan(y[:, j]) & ~np.isnan(y[:, i])
                above = (y[both, j] > y[both, i]).mean() + 0.5 * (y[both, j] == y[both, i]).mean()
                if i != j:
                    d[j] += (above - B._cdf((mean[both, j] - mean[both, i]) / np.sqrt(2)).mean()) ** 2
        np.testing.assert_allclose(got[6 + at], d, atol=1e-9)
        assert got[4 + at] == pytest.approx(d.sum() / 2)


def test_blocks_add_up(two, spark):
    """Observed values depend on neither blocks nor partitions; replicates on no partition."""
    sorts, draws, checked = two
    one = draws.where("k = 2 and draw < 40")
    rows = lambda df: {tuple(r[:4]): r for r in df.collect()}
    a, b, c = (rows(P.checked_draws(one.repartition(n), sorts.repartition(n), 4, block=size)) for n, size in ((1, 16), (7, 16), (3, 256)))
    assert set(a) == set(b) == set(c) and len(a) == 2 * 10
    for key, r in a.items():
        for name in ("agreement_obs", "agreement_rep", "extra_obs", "extra_rep", "paired_obs", "paired_rep"):
            assert r[name] == pytest.approx(b[key][name], abs=1e-9)
        assert r["extra_obs"] == pytest.approx(c[key]["extra_obs"], abs=1e-9)


def test_a_missing_factor_is_seen(two):
    sorts, draws, checked = two
    got = {r["k"]: r for r in P.checks(checked).collect()}
    assert got[1]["percentile"] > 0.95 and not got[1]["adequate"]
    assert got[2]["adequate"] and got[2]["n_draws"] == 2 * 100
    assert P.statement_checks(checked).count() == 2 * len(DECK)
    assert all(0 <= r["worst_statement_p"] <= 1 and 0 <= r["agreement_p"] <= 1 for r in got.values())


def test_ladder_by_data(two):
    """Two views are selected at every error rate, from draws that were taken once."""
    sorts, draws, checked = two
    checks = P.checks(checked).cache()
    got = P.rejudge(draws, checks).collect()
    assert sorted(r["q"] for r in got) == list(B.LENSES)
    assert {(r["verdict"], r["k_star"], r["k_active"], r["k_source"]) for r in got} == {("selected", 2, 2, "model")}
    strict = P.rejudge(draws, checks, (1e-9,)).first()
    assert strict["k_source"] in ("model", "fallback") and strict["k_active"] in (1, 2)


def test_active_k(spark):
    rungs = [("one", 1, True, True), ("one", 2, False, False), ("tension", 2, True, False), ("tension", 3, False, True), ("unsupported", 2, True, False), ("none", 2, False, False), ("range", 2, False, True)]
    got = P.active_k(B.verdicts(spark.createDataFrame(rungs, "study_id string, k int, adequate boolean, supported boolean")))
    assert {r["study_id"]: (r["verdict"], r["k_active"], r["k_source"]) for r in got.collect()} == {
        "one": ("single_viewpoint", 1, "model"),
        "tension": ("tension", 2, "inspect"),
        "unsupported": ("adequate_but_unsupported", 1, "fallback"),
        "none": ("no_shared_structure", 1, "fallback"),
        "range": ("no_adequate_rung", 1, "fallback"),
    }


def test_missing_cells_constant_sorts_and_empty_tables(spark, two):
    sorts, draws, _ = two
    x = people(12, 2, 1.0, 3)
    x[2, 5] = np.nan
    x[3] = 1.0
    holes = as_sorts(spark, {"two": x})
    got = P.checked_draws(draws.where("k = 2 and draw = 0"), holes, 1).collect()
    assert len(got) == 2 and all(np.isfinite([r["extra_obs"], r["extra_rep"], r["paired_obs"]]).all() for r in got)
    assert P.checks(P.checked_draws(draws, sorts.limit(0))).count() == 0
    with pytest.raises(ValueError):
        P.checked_draws(draws, sorts, 0)


def test_audit_view_and_overview(spark):
    from viewspan.functions import linalg as L
    from viewspan.operators import extraction as X
    from viewspan.sources import sinks

    x = people(6, 2, 1.0, 4)
    sorts = as_sorts(spark, {"few": x, "many": people(20, 3, 1.0, 8)}).cache()
    got = {(r["study_id"], r["p_idx"], r["factor"]): r for r in X.unrotated_wide(sorts, 2).collect()}
    assert len(got) == 6 * 5 + 20 * 8  # one under the participants, eight at most
    want = L.signed(L.extract(np.corrcoef(x), 5, "pca"))
    for i in range(6):
        for f in range(5):
            assert got["few", i + 1, f + 1]["loading"] == pytest.approx(want[i, f], abs=1e-8)
            assert got["few", i + 1, f + 1]["cumulative_h2"] == pytest.approx((want[i, : f + 1] ** 2).sum())
    assert X.unrotated_wide(sorts, 2, "minres").agg({"factor": "max"}).first()[0] == 2
    flags = X.extract(sorts, 2, "pca", "varimax").selectExpr("*", "abs(loading) > 0.5 as flagged")
    rows = {(r["study_id"], r["item"]): r["value"] for r in sinks.overview(sorts, flags, majority=False, exported="now").collect()}
    assert rows["few", "Sorts"] == "6" and rows["many", "Statements"] == "24" and rows["many", "Factors"] == "2" and rows["few", "Flagging"] == "auto at p < 0.05" and rows["few", "Exported"] == "now"


def test_equal_contrasts_go_to_the_first(spark):
    from viewspan.operators import priorities as R

    rows = [("s", "g", 1, "b", "c", 2.0), ("s", "g", 1, "a", "b", -2.0), ("s", "g", 1, "a", "c", None), ("s", "g", 2, "a", "b", None)]
    got = R.dunn_top(spark.createDataFrame(rows, "study_id string, attribute string, stmt_num int, level_a string, level_b string, z double")).collect()
    assert [(r["stmt_num"], r["level_a"], r["level_b"], r["winner"]) for r in got] == [(1, "a", "b", "b")]


def test_queries_share_the_stored_draws(spark, monkeypatch):
    """The registered queries over one table of draws, here of short chains: sampled once, and again where the table is gone."""
    from viewspan import storage
    from viewspan.plans import queries as Q

    d, calls, real = "/root/testdata/sf0.001", [], B.draws

    def short(sorts, ks, **_):
        calls.append(ks)
        return real(sorts, ks[:3], iterations=140, burn=40, thin=2)

    monkeypatch.setattr(B, "draws", short)
    monkeypatch.setattr(storage, "_PATHS", {})
    checks = Q.QUERIES["bayes_checks"].run(spark, d).collect()
    assert [r["k"] for r in sorted(checks)] and {r["n_draws"] for r in checks} == {2 * 5} and all(0 <= r["percentile"] <= 1 for r in checks)
    judged = Q.QUERIES["bayes_rejudged"].run(spark, d).collect()
    assert len(judged) == len(B.LENSES) and all(r["headline"] for r in judged)
    assert Q.QUERIES["bayes_statement_checks"].run(spark, d).count() == 3 * 25
    assert Q.QUERIES["bayes_effective_sizes"].run(spark, d).where("ess <= 0 or ess is null").count() == 0
    assert Q.QUERIES["bayes_ladder"].run(spark, d).count() == 3
    assert len(calls) == 1
    monkeypatch.setattr(storage, "_there", lambda *_: False)
    Q.QUERIES["bayes_loadings"].run(spark, d)
    assert len(calls) == 2
