"""Columns of loadings brought back into place: exact assignment, draws that switch labels, other people; linkage; pairs of factors told apart."""

import itertools

import numpy as np
import pytest

from viewspan.functions import linalg as M
from viewspan.operators import alignment as A
from viewspan.operators import bayes as B
from viewspan.operators import extraction as X
from viewspan.operators import plotdata as G

LOADINGS = "study_id string, participant string, factor int, loading double"


@pytest.mark.parametrize("k", range(1, 7))
def test_assignment_is_the_best(k):
    rng = np.random.default_rng(k)
    for turn in range(40):
        score = rng.normal(size=(k, k)) if turn % 2 else rng.integers(0, 3, (k, k)).astype(float)
        got = M.assignment(score)
        best = max(sum(score[i, p[i]] for i in range(k)) for p in itertools.permutations(range(k)))
        assert sorted(got) == list(range(k)) and score[np.arange(k), got].sum() == pytest.approx(best)


def planted(rng, n=60, k=3):
    base = np.zeros((n, k))
    base[np.arange(n), np.arange(n) % k] = rng.uniform(0.5, 0.9, n)
    return base


def test_draws_that_switch_labels_signs_and_turns():
    rng = np.random.default_rng(1)
    base = planted(rng)
    plain = [base + rng.normal(0, 0.05, base.shape) for _ in range(100)]
    seen = []
    for i, x in enumerate(plain):
        if i % 2:
            seen.append(x[:, rng.permutation(3)] * rng.choice([-1, 1], 3))  # a switch of labels and signs
        else:
            seen.append(x @ np.linalg.qr(rng.normal(size=(3, 3)))[0])  # any turn
    turns = M.match_align(seen, base)
    for x, s, t in zip(plain, seen, turns, strict=True):
        assert np.allclose(t.T @ t, np.eye(3)) and np.abs(s @ t - x).max() < 0.1
    one = M.match_align([base[:, :1], -base[:, :1]], base[:, :1])
    assert one[0] == 1 and one[1] == -1


def test_sampled_chains_meet():
    rng = np.random.default_rng(2)
    base = planted(rng, 24, 2)
    latent = base @ rng.normal(size=(2, 15)) + rng.normal(0, 0.4, (24, 15))
    x = np.argsort(np.argsort(latent, axis=1), axis=1) // 3.0
    one, two = (np.mean([h for h, _ in B.sample(x, 2, 400, 200, 2, [9, c])], axis=0) for c in (0, 1))
    assert np.abs(one - two).max() < 0.35 and np.corrcoef(one.ravel(), two.ravel())[0, 1] > 0.95


def test_curves_undo_a_cycle_with_mirrors():
    rng = np.random.default_rng(3)
    target = np.stack([rng.beta(a, b, 300) * 2 - 1 for a, b in ((1, 4), (3, 1.5), (8, 8), (0.5, 0.5))], axis=1)
    cycle = target[:, [1, 2, 3, 0]] * np.array([1, -1, 1, -1])
    back = M.align_by_curves(cycle, target)
    for j in (0, 1):  # the other two are symmetric: their sign can't be told from curves
        assert np.allclose(back[:, j], target[:, j])
    for j in (2, 3):
        assert np.allclose(np.abs(back[:, j]), np.abs(target[:, j]))


def as_rows(study, x, names):
    return [(study, n, f + 1, float(v)) for n, row in zip(names, x, strict=True) for f, v in enumerate(row)]


def test_align_loadings(spark):
    rng = np.random.default_rng(4)
    t = np.stack([rng.beta(1, 4, 40), rng.beta(3, 1.5, 40) * 2 - 1], axis=1)
    turn = np.array([[0.8, -0.6], [0.6, 0.8]])
    names = [f"p{i}" for i in range(40)]
    target = as_rows("names", t, names) + as_rows("curves", t, names) + as_rows("fewer", t, names) + as_rows("two common", t, names)
    own = as_rows("names", t[:9] @ turn, names[:9]) + as_rows("curves", -t[:, ::-1], [f"q{i}" for i in range(40)]) + as_rows("fewer", t[:, :1], names) + as_rows("alone", t, names)
    own += as_rows("two common", t[:, ::-1], names[:2] + [f"q{i}" for i in range(38)])
    got = A.align_loadings(spark.createDataFrame(own, LOADINGS), spark.createDataFrame(target, LOADINGS)).collect()
    method = {r["study_id"]: r["method"] for r in got}
    assert method == {"names": "names", "curves": "curves", "fewer": "unaligned", "alone": "unaligned", "two common": "curves"}
    of = lambda study: np.array([r["loading"] for r in sorted((r for r in got if r["study_id"] == study), key=lambda r: (int(r["participant"][1:]), r["factor"]))]).reshape(-1, 2 if study != "fewer" else 1)
    assert np.allclose(of("names"), t[:9]) and np.allclose(of("curves"), t) and np.allclose(of("fewer"), t[:, :1]) and np.allclose(of("alone"), t)
    holed = spark.createDataFrame([(s, n, f, None if (n, f) == ("p0", 1) else v) for s, n, f, v in own], LOADINGS)
    again = A.align_loadings(holed.where("study_id = 'names'"), spark.createDataFrame(target, LOADINGS))
    assert again.where("loading is null").count() == 2 and again.count() == 18
    assert A.align_loadings(spark.createDataFrame([], LOADINGS), spark.createDataFrame(target, LOADINGS)).count() == 0


def test_bootstrap_alignments(spark):
    from viewspan.plans import queries as Q

    s = Q.sorts(spark, "/root/testdata/sf0.001").where("p_idx <= 20")
    original = X.original_solution(s, 2)
    for align in ("names", "curves", "positional"):
        r = {x["kind"]: x for x in X.stability(X.bootstrap(s, 2, 10, align=align), original).collect()}
        assert r["loading"]["replicates"] >= 5
        if align == "names":
            assert r["loading"]["mean"] > 0.6
    with pytest.raises(ValueError):
        X.bootstrap(s, 2, 10, align="none")


def plain_linkage(d):
    """The same tree by a search of all distances at each join."""
    n = len(d)
    leaves, made = {i: [i] for i in range(n)}, [(-np.inf, i) for i in range(n)]
    for step in range(n - 1):
        i, j = sorted(divmod(int(np.argmin(d)), n))
        first, second = (i, j) if made[i] <= made[j] else (j, i)
        height = d[i, j]
        joined = leaves.pop(first) + leaves.pop(second)
        leaves[i], made[i] = joined, (height, n + step)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
    return leaves.popitem()[1]


@pytest.mark.parametrize("n", [1, 2, 3, 9, 70])
def test_linkage_as_by_full_search(n):
    rng = np.random.default_rng(n)
    for turn in range(12):
        d = 1 - np.atleast_2d(np.corrcoef(rng.normal(size=(n, 6))))
        d = np.round((d + d.T) / 2, 1 if turn % 2 else 12)  # with ties and without
        np.fill_diagonal(d, np.inf)
        assert G.complete_linkage(d.copy()) == plain_linkage(d.copy())


def test_a_lone_leaf_comes_before_a_branch():
    d = np.array([[np.inf, 0.1, 0.5], [0.1, np.inf, 0.6], [0.5, 0.6, np.inf]])
    assert G.complete_linkage(d) == [2, 0, 1]


def test_stars(spark):
    z = {1: [2.0, 1.0, 3.0, 2.0], 2: [0.0, 0.5, 0.0, 1.0], 3: [1.0, 2.0, 2.5, 2.5]}
    rows = [("s", 3, 0, d, "zscore", 7, f, v) for f, values in z.items() for d, v in enumerate(values)]
    rows += [("s", 1, 0, d, "zscore", 7, 1, 0.0) for d in range(4)]
    draws = spark.createDataFrame(rows, B.DRAWS)
    got = {(r["factor"], r["other"]): (r["diff"], r["p"], r["claimed"], r["expected_false"]) for r in B.star_claims(draws, 0.2).collect()}
    assert got == {(1, 2): (1.625, 1.0, True, 0.0), (2, 3): (-1.625, 1.0, True, 0.0), (1, 3): (0.0, 0.5, True, 0.5)}
    assert not {(r["factor"], r["other"]): r["claimed"] for r in B.star_claims(draws, 0.1).collect()}[1, 3]
    assert {r["family"]: r["n"] for r in B.claim_families(draws).where("k = 3").collect()} == {"distinguishing": 3, "consensus": 1, "stars": 3}
