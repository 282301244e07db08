"""Posterior predictive checks of stored draws, and what a ladder of K says by them.

Each checked draw sorts the cards once more for every participant: latent values from the
draw's loadings and scores with unit noise, laid out on the participant's own grid. What a
check needs of a study's sorts are sums over participants (their number, the sum of unit sorts, the
cross-products of statements and the counts of pairs of statements), so blocks of participants
are simulated where they stand, their sums meet by (study, K, chain, draw), and no task holds a study.

* agreement: mean correlation of two participants;
* extra factor: the largest share of variance in one direction that the draw's factors leave over;
* paired comparisons: squared distance of the shares "j above i" from those that the draw expects.

The noise is seeded by (seed, study, K, chain, draw, block), so results don't depend on partitions or
retries. Missing cells are missing in the replicate too; participants with fewer than two different
values say nothing and are left out. Numeric parity with another sampler's checks isn't aimed at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bayes as B
from . import gram as S

#: Every how many draws one is checked, and participants of a block.
EVERY, BLOCK = 10, 256
DRAW = ["study_id", "k", "chain", "draw"]
CHECKED = "study_id string, k int, chain int, draw int, agreement_obs double, agreement_rep double, extra_obs double, extra_rep double, paired_obs double, paired_rep double, statement_obs array<double>, statement_rep array<double>"


def replicate(x: np.ndarray, load: np.ndarray, f: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(sorts like ``x``, latent means): ``load`` holds correlations with the factors; nan stays nan."""
    raw = load / np.sqrt(np.maximum(1e-9, 1 - (load**2).sum(axis=1, keepdims=True)))
    mean = raw @ f
    y = np.where(np.isnan(x), np.inf, mean + rng.standard_normal(x.shape))
    return np.take_along_axis(np.sort(x, axis=1), y.argsort(axis=1).argsort(axis=1), axis=1), mean


def _units(x: np.ndarray) -> np.ndarray:
    d = np.nan_to_num(x - np.nanmean(x, axis=1, keepdims=True))
    return d / np.linalg.norm(d, axis=1, keepdims=True)


def _above(x: np.ndarray) -> np.ndarray:
    """How many participants place j above i, ties as half."""
    a, b = x[:, :, None], x[:, None, :]
    return (a > b).sum(axis=0) + 0.5 * (a == b).sum(axis=0)


def block_sums(x: np.ndarray, load: np.ndarray, f: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    rep, mean = replicate(x, load, f, rng)
    seen = ~np.isnan(x)
    both = seen[:, :, None] & seen[:, None, :]
    expected = np.where(both, B._cdf(np.clip((mean[:, :, None] - mean[:, None, :]) / np.sqrt(2), -8, 8)), 0.0).sum(axis=0)
    u, v = _units(x), _units(rep)
    return np.concatenate([[len(x)], u.sum(axis=0), v.sum(axis=0), *(m.ravel() for m in (u.T @ u, v.T @ v, _above(x), _above(rep), expected, both.sum(axis=0)))])


def discrepancies(sums: np.ndarray, f: np.ndarray) -> tuple:
    """(agreement, extra, paired) of the observed and the replicated sorts, and the paired distance of each statement of both."""
    j = f.shape[1]
    n, flat = sums[0], sums[1 + 2 * j :].reshape(6, j, j)
    agree = [(s @ s - n) / (n * (n - 1)) if n > 1 else np.nan for s in (sums[1 : 1 + j], sums[1 + j : 1 + 2 * j])]
    q, _ = np.linalg.qr(f.T)
    rest = np.eye(j) - q @ q.T
    extra = [np.linalg.eigvalsh(rest @ g @ rest)[-1] / np.trace(g) for g in flat[:2]]
    expected, both = flat[4], flat[5]
    off = (both > 0) & ~np.eye(j, dtype=bool)
    distance = [np.where(off, ((c - expected) / np.maximum(both, 1)) ** 2, 0.0).sum(axis=1) for c in flat[2:4]]
    return agree[0], agree[1], extra[0], extra[1], distance[0].sum() / 2, distance[1].sum() / 2, distance[0].tolist(), distance[1].tolist()


def _values(struct_list: str) -> Column:
    return F.transform(struct_list, lambda c: c["value"])


def _scores(draws: DataFrame) -> DataFrame:
    """``(DRAW, f)``: the draw's scores, factor by factor."""
    return draws.where("kind = 'zscore'").groupBy(*DRAW).agg(F.array_sort(F.collect_list(F.struct("factor", "item", "value"))).alias("c")).select(*DRAW, _values("c").alias("f"))


def checked_draws(draws: DataFrame, sorts: DataFrame, every: int = EVERY, seed: int = B.SEED, block: int = BLOCK) -> DataFrame:
    """The discrepancies of each ``every``-th draw, observed and replicated (``CHECKED``).

    ``draws`` as of ``bayes.draws``, better a stored table than a plan that samples: it is read
    twice. Statements are the study's statement numbers in order. A draw without participants that vary has no row.
    """
    if every < 1 or block < 1:
        raise ValueError("every and block must be at least one")
    some = B.long(draws).where(F.col("draw") % every == 0)
    at = F.floor(F.col("p_idx") / block).cast("long").alias("block")
    loads = some.where("kind = 'loading'").withColumnRenamed("item", "p_idx").select("*", at).groupBy(*DRAW, "block").agg(F.array_sort(F.collect_list(F.struct("p_idx", "factor", "value"))).alias("c"))
    loads = loads.select(*DRAW, "block", F.transform("c", lambda c: c["p_idx"]).alias("who"), _values("c").alias("load"))
    deck = sorts.groupBy("study_id").agg(F.array_sort(F.collect_set("stmt_num")).alias("statements"))
    varied = S.packed(sorts).where((F.size("v") > 1) & (F.array_min("v") < F.array_max("v")))
    people = varied.select("*", at).groupBy("study_id", "block").agg(F.array_sort(F.collect_list(F.struct("p_idx", "s", "v"))).alias("c"))
    people = people.select("study_id", "block", F.transform("c", lambda c: c["p_idx"]).alias("p"), F.flatten(F.transform("c", lambda c: c["s"])).alias("s"), F.flatten(F.transform("c", lambda c: c["v"])).alias("v"), F.transform("c", lambda c: F.size(c["v"])).alias("m"))
    scores = _scores(some)
    rows = loads.join(scores, DRAW).join(people, ["study_id", "block"]).join(deck, "study_id")

    def simulate(parts):
        for pdf in parts:
            out = []
            for r in pdf.itertuples(index=False):
                statements, p = np.asarray(r.statements), np.asarray(r.p)
                f = np.asarray(r.f).reshape(r.k, len(statements))
                x = np.full((len(p), len(statements)), np.nan)
                x[np.repeat(np.arange(len(p)), r.m), np.searchsorted(statements, r.s)] = r.v
                who, load = np.asarray(r.who)[:: r.k], np.asarray(r.load).reshape(-1, r.k)
                known = np.isin(p, who)
                if known.any():
                    rng = np.random.default_rng([seed, zlib.crc32(r.study_id.encode()), r.k, r.chain, r.draw, r.block])
                    part = block_sums(x[known], load[np.searchsorted(who, p[known])], f, rng)
                    out.append((r.study_id, r.k, r.chain, r.draw, S._bytes(part)))
            yield pd.DataFrame(out, columns=[*DRAW, "part"])

    parts = rows.mapInPandas(simulate, "study_id string, k int, chain int, draw int, part binary")
    whole = S._sums(parts, DRAW).join(scores, DRAW)

    def solve(row):
        f = np.asarray(row.f).reshape(row.k, -1)
        return (row.study_id, row.k, row.chain, row.draw, *discrepancies(np.frombuffer(row.part, np.float64), f))

    return S._each(whole, solve, CHECKED)


def _at_least(kind: str) -> Column:
    return F.avg((F.col(f"{kind}_rep") >= F.col(f"{kind}_obs")).cast("double"))


def checks(checked: DataFrame) -> DataFrame:
    """Per study and K: posterior predictive p of agreement and of paired comparisons, that of the worst statement, and the extra factor's percentile.

    The percentile is the share of replicates below the observed value, ties as half: near one the
    sorts hold a direction that the model lacks, near zero it has more than they show. ``adequate``: within the band.
    """
    below = F.avg((F.col("extra_rep") < F.col("extra_obs")).cast("double") + 0.5 * (F.col("extra_rep") == F.col("extra_obs")).cast("double"))
    out = checked.groupBy(*B.KEYS).agg(F.count("*").alias("n_draws"), _at_least("agreement").alias("agreement_p"), below.alias("percentile"), _at_least("paired").alias("paired_p"))
    worst = statement_checks(checked).groupBy(*B.KEYS).agg(F.min("p").alias("worst_statement_p"))
    return out.join(worst, B.KEYS).withColumn("adequate", F.col("percentile").between(*B.ADEQUATE))


def statement_checks(checked: DataFrame) -> DataFrame:
    """Posterior predictive p of each statement's paired comparisons, by its place among the study's statements."""
    each = checked.select(*B.KEYS, F.posexplode(F.arrays_zip("statement_obs", "statement_rep")).alias("at", "d"))
    return each.groupBy(*B.KEYS, (F.col("at") + 1).alias("place")).agg(F.avg((F.col("d.statement_rep") >= F.col("d.statement_obs")).cast("double")).alias("p"))


def evidence(draws: DataFrame, checks: DataFrame, q: float = 0.05) -> DataFrame:
    """Rungs ``(study_id, k, adequate, supported, percentile)`` for ``bayes.verdicts``: adequacy by the checks, support by the claims at ``q``."""
    support = B.ladder(draws, q).select(*B.KEYS, F.col("adequate").alias("supported"))
    return checks.select(*B.KEYS, "percentile", "adequate").join(support, B.KEYS)


def active_k(verdicts: DataFrame) -> DataFrame:
    """The K that is shown and why: the model's pick; for a tension the least adequate K, to be inspected; else one factor, which a single viewpoint is the model's own conclusion."""
    v = F.col("verdict")
    k = F.when(v == "selected", F.col("k_star")).when(v == "tension", F.col("k_fit")).otherwise(1)
    source = F.when(v.isin("selected", "single_viewpoint"), "model").when(v == "tension", "inspect").otherwise("fallback")
    return verdicts.select("*", k.cast("int").alias("k_active"), source.alias("k_source"))


def rejudge(draws: DataFrame, checks: DataFrame, qs: tuple[float, ...] = B.LENSES) -> DataFrame:
    """The verdict at each error rate, all from the stored draws: claims and support are read anew, nothing is sampled and the checks stay."""
    out = None
    for q in qs:
        one = active_k(B.verdicts(evidence(draws, checks, q))).withColumn("q", F.lit(float(q)))
        out = one if out is None else out.unionByName(one)
    return out
