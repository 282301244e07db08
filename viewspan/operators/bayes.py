"""A Bayesian rank-order factor model: draws by Gibbs sampling for each study, number of factors and chain; everything after that is SQL over draws.

Latent values keep the order of a sort's grid columns (the exact partition
likelihood: every card of a higher column above every card of a lower one) and
follow factors: y = ΛF + e. Draws are turned to a common orientation before
they are written, so posterior summaries, claims at any error rate and the
ladder over K are aggregations of stored draws, with no refit.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from .extraction import _unpacked

ITERATIONS, BURN, THIN, SEED = 12_000, 2_000, 5, 42
#: Rows of draws that leave the sampler at a time, about, participants whose latent values are drawn together (as fit a core's cache), and draws of a packed row.
DRAW_ROWS, SWEEP, PIECE = 100_000, 2048, 200
DRAWS = "study_id string, k int, chain int, draw int, kind string, item int, factor int, value double"
#: Draws by parameter: ``values`` holds ``PIECE`` draws from ``first``, one after the other, each with all factors.
PACKED = "study_id string, k int, chain int, kind string, item int, first int, values array<double>"


def _phi(x):
    return 0.5 * np.vectorize(math.erfc)(-np.clip(x, -8, 8) / math.sqrt(2))


# fixed tables of the normal distribution with even steps, so that truncated draws need neither searches nor series:
# the cdf by x, and the upper quantile by sqrt(-2 ln p), in which it is almost straight
_STEP = 1000
_GRID = np.linspace(-8, 8, 16 * _STEP + 1)
_CDF = _phi(_GRID)
_TAIL_P = _phi(-np.linspace(0, 8, 8 * _STEP + 1))
_TAIL = np.linspace(math.sqrt(2 * math.log(2)), 8.3, 16_385)
_UPPER = np.interp(_TAIL, np.sqrt(-2 * np.log(_TAIL_P)), np.linspace(0, 8, 8 * _STEP + 1))
_CDF_SLOPE, _UPPER_SLOPE = np.diff(_CDF, append=1.0), np.diff(_UPPER, append=_UPPER[-1])


def _between(table, slope, at):
    """``table`` at the places ``at`` (0, 1, ...), straight between them."""
    k = at.astype(np.intp)
    out = at - k
    out *= slope.take(k)
    out += table.take(k)
    return out


def _cdf(x):
    return _between(_CDF, _CDF_SLOPE, (x + 8) * _STEP)


def _quantile(u):
    s = np.minimum(u, 1 - u)
    np.log(np.maximum(s, 1e-300, out=s), out=s)
    s *= -2
    np.sqrt(s, out=s)
    s -= _TAIL[0]
    s *= 1 / (_TAIL[1] - _TAIL[0])
    np.minimum(np.maximum(s, 0, out=s), len(_TAIL) - 1, out=s)
    return np.copysign(_between(_UPPER, _UPPER_SLOPE, s), u - 0.5)


def _columns(value):
    """Of each grid column from the lowest: its cells by row, where each row's cells begin, and these rows."""
    out = []
    for c in np.unique(value[~np.isnan(value)]):
        rows, cards = np.nonzero(value == c)
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        out.append((rows, cards, first, rows[first]))
    return out


def _latents(y, mean, columns, rng):
    """One sweep over grid columns from the lowest: each card between the greatest of the columns below and the least of those above."""
    above = [np.full(len(y), np.inf)]
    for rows, cards, first, who in reversed(columns[1:]):
        least = above[-1].copy()
        least[who] = np.minimum(least[who], np.minimum.reduceat(y[rows, cards], first))
        above.append(least)
    below = np.full(len(y), -np.inf)
    for (rows, cards, first, who), least in zip(columns, reversed(above), strict=True):
        m, lo, hi = mean[rows, cards], below[rows], least[rows]
        a, b = _cdf(np.clip(lo - m, -8, 8)), _cdf(np.clip(hi - m, -8, 8))
        new = np.clip(m + _quantile(a + (b - a) * rng.uniform(1e-9, 1 - 1e-9, len(m))), lo + 1e-9, hi - 1e-9)
        y[rows, cards] = new
        below[who] = np.maximum(below[who], np.maximum.reduceat(new, first))
    return y


def _forced(value):
    """Of complete sorts with one shape: where each cell of a row by rank stands (J x n, flat), and where grid columns begin and end by rank; None for others."""
    if np.isnan(value).any():
        return None
    order = np.argsort(value, axis=1, kind="stable")
    ranked = np.take_along_axis(value, order, axis=1)
    if (ranked != ranked[0]).any():
        return None
    cuts = [0, *(np.flatnonzero(np.diff(ranked[0])) + 1), value.shape[1]]
    return (order + np.arange(len(value))[:, None] * value.shape[1]).T, list(zip(cuts[:-1], cuts[1:]))


def _forced_latents(y, mean, forced, rng):
    """``_latents`` of sorts with one shape: grid columns are slices of cells by rank."""
    flat, columns = forced
    ys, ms = y.ravel()[flat], mean.ravel()[flat]
    above = [None]
    for start, end in reversed(columns[1:]):
        least = ys[start:end].min(axis=0)
        above.append(least if above[-1] is None else np.minimum(least, above[-1]))
    below = None
    for (start, end), hi in zip(columns, reversed(above), strict=True):
        m = ms[start:end]
        a = 0.0 if below is None else _cdf(np.minimum(np.maximum(below - m, -8), 8))
        b = 1.0 if hi is None else _cdf(np.minimum(np.maximum(hi - m, -8), 8))
        u = rng.random(m.shape)
        np.minimum(np.maximum(u, 1e-9, out=u), 1 - 1e-9, out=u)
        u *= b - a
        u += a
        new = _quantile(u)
        new += m
        if below is not None:
            np.maximum(new, below + 1e-9, out=new)
        if hi is not None:
            np.minimum(new, hi - 1e-9, out=new)
        ys[start:end] = new
        top = new.max(axis=0)
        below = top if below is None else np.maximum(below, top)
    y.reshape(-1)[flat] = ys
    return y


def sample(x: np.ndarray, k: int, iterations: int, burn: int, thin: int, seed, sigma: float = 1.0):
    """(loadings, scores) draws of one chain, each turned by varimax and matched, column by column, to the chain's pivot (``linalg.match_align``)."""
    rng = np.random.default_rng(seed)
    n, j = x.shape
    y = np.stack([np.argsort(np.argsort(r + 1e-6 * rng.random(j))) for r in x]).astype(float)
    y = (y - y.mean(1, keepdims=True)) / y.std(1, keepdims=True)
    # complete sorts by the smaller Gram matrix: no participants by participants are formed
    start = L.pca(L.correlation(x), k)[0] if np.isnan(x).any() else L.pca_of_rows(x, k)[0]
    load = L.rotate(start, "varimax")
    kept, reference, forced = [], load, _forced(x) is not None
    rows = [slice(at, at + SWEEP) for at in range(0, n, SWEEP)]
    latents, shapes = (_forced_latents, [_forced(x[s]) for s in rows]) if forced else (_latents, [_columns(x[s]) for s in rows])
    f = np.linalg.lstsq(load, y, rcond=None)[0]
    for it in range(iterations):
        for s, shape in zip(rows, shapes, strict=True):
            latents(y[s], load[s] @ f, shape, rng)
            y[s] -= y[s].mean(axis=1, keepdims=True)
        cov = np.linalg.inv(load.T @ load + np.eye(k))
        f = cov @ (load.T @ y) + np.linalg.cholesky(cov) @ rng.standard_normal((k, j))
        cov = np.linalg.inv(f @ f.T + np.eye(k) / sigma**2)
        load = (y @ f.T) @ cov + rng.standard_normal((n, k)) @ np.linalg.cholesky(cov).T
        # parameter expansion: scales move between scores and loadings
        scale = f.std(axis=1, ddof=1)
        f, load = f / scale[:, None], load * scale
        if it >= burn and (it - burn) % thin == 0:
            kept.append((load / np.sqrt(1 + (load**2).sum(axis=1, keepdims=True)), f))
    # in place, so that the draws are held once
    for i, t in enumerate(L.match_align([h for h, _ in kept], reference)):
        kept[i] = kept[i][0] @ t, t.T @ kept[i][1]
    return kept


def _standardised(f: np.ndarray) -> np.ndarray:
    return (f - f.mean(1, keepdims=True)) / f.std(1, ddof=1, keepdims=True)


def draws(sorts: DataFrame, ks: list[int], chains: int = 2, iterations: int = ITERATIONS, burn: int = BURN, thin: int = THIN, seed: int = SEED, packed: bool = False) -> DataFrame:
    """Long draws ``(study_id, k, chain, draw, kind, item, factor, value)``: loadings by p_idx and z-scores by stmt_num; a task for each (study, K, chain).

    ``packed``: as ``PACKED`` instead, which holds what the long rows hold; all that reads draws takes both.
    """
    studies = sorts.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "stmt_num", "value", "participant"))).alias("cells"))
    # by range: hashes would put several of a few chains in one task, and that task would take as many times as long
    tasks = studies.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).repartitionByRange(len(ks) * chains, "study_id", "k", "chain")

    def pieces(row, idx, kept):
        for first in range(0, len(kept), PIECE):
            part = kept[first : first + PIECE]
            for kind, item, values in (("loading", idx, [load for load, _ in part]), ("zscore", np.arange(1, len(kept[0][1].T) + 1), [_standardised(f).T for _, f in part])):
                step = max(1, 10 * DRAW_ROWS // (len(part) * row.k))
                for at in range(0, len(item), step):
                    own = np.stack([v[at : at + step] for v in values], axis=1)
                    yield pd.DataFrame({"study_id": row.study_id, "k": row.k, "chain": row.chain, "kind": kind, "item": item[at : at + step], "first": first, "values": list(own.reshape(len(own), -1))})

    def run(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                x, idx, _ = _unpacked(row.cells)
                n, j = x.shape
                k = row.k
                kept = sample(x, k, iterations, burn, thin, [seed, k, row.chain])
                if packed:
                    yield from pieces(row, idx, kept)
                    continue
                item = np.concatenate([np.repeat(idx, k), np.tile(np.arange(1, j + 1), k)])
                factor = np.concatenate([np.tile(np.arange(1, k + 1), n), np.repeat(np.arange(1, k + 1), j)])
                kind = np.repeat(["loading", "zscore"], [n * k, j * k])
                step = max(1, DRAW_ROWS // len(item))
                for start in range(0, len(kept), step):
                    part = kept[start : start + step]
                    value = np.concatenate([v for load, f in part for v in (load.ravel(), _standardised(f).ravel())])
                    m = len(part)
                    yield pd.DataFrame({"study_id": row.study_id, "k": k, "chain": row.chain, "draw": np.repeat(np.arange(start, start + m), len(item)), "kind": np.tile(kind, m), "item": np.tile(item, m), "factor": np.tile(factor, m), "value": value})

    return tasks.mapInPandas(run, PACKED if packed else DRAWS)


def long(draws: DataFrame, kind: str | None = None) -> DataFrame:
    """Draws, packed or long, as long rows, of one ``kind`` if it is stated."""
    own = draws if kind is None else draws.where(F.col("kind") == kind)
    if "values" not in draws.columns:
        return own
    each = own.select("study_id", "k", "chain", "kind", "item", "first", F.posexplode("values").alias("at", "value"))
    return each.select("study_id", "k", "chain", (F.col("first") + F.floor(F.col("at") / F.col("k"))).cast("int").alias("draw"), "kind", "item", (F.col("at") % F.col("k") + 1).cast("int").alias("factor"), "value")


def _of_parameters(draws: DataFrame, by: list[str], of, names: list[str]) -> DataFrame:
    """``(*by, factor, *names)`` of packed draws: ``of(values) -> {name: numbers by factor}``, the values (draws x K) of a key in the order of chains and draws."""
    k_at = by.index("k")

    def run(batches):
        key, held = None, []

        def done():
            found = of(np.concatenate(held).reshape(-1, key[k_at]))
            return pd.DataFrame({**dict(zip(by, key, strict=True)), "factor": np.arange(1, key[k_at] + 1), **found})

        for pdf in batches:
            out = []
            for *this, values in zip(*(pdf[c] for c in by), pdf["values"], strict=True):
                if this != key:
                    if held:
                        out.append(done())
                    key, held = this, []
                held.append(values)
            if out:
                yield pd.concat(out)
        if held:
            yield done()

    types = [f"{c} {draws.schema[c].dataType.simpleString()}" for c in by]
    rows = draws.repartition(*by).sortWithinPartitions(*by, *[c for c in ("chain", "first") if c not in by]).select(*by, "values")
    return rows.mapInPandas(run, ", ".join([*types, "factor int", *(f"{c} double" for c in names)]))


def _flag_shares(draws: DataFrame) -> DataFrame:
    """``(*KEYS, item, factor, p)``: the share of draws in which a sort defines a factor, counted where packed rows stand, so that no draw is sent."""
    if "values" not in draws.columns:
        sq = F.col("value") * F.col("value")
        rest = F.sum(sq).over(Window.partitionBy(*KEYS, "chain", "draw", "item")) - sq
        return draws.where("kind = 'loading'").withColumn("hit", (sq > rest) & (F.abs("value") > 0.3)).groupBy(*KEYS, "item", "factor").agg(F.avg(F.col("hit").cast("double")).alias("p"))

    def count(batches):
        for pdf in batches:
            for k, own in pdf.groupby("k"):
                sizes = np.array([len(v) for v in own["values"]])
                values = np.concatenate(own["values"].to_numpy()).reshape(-1, k)
                sq = values * values
                hits = np.add.reduceat((2 * sq > sq.sum(axis=1, keepdims=True)) & (np.abs(values) > 0.3), np.cumsum(sizes // k) - sizes // k, axis=0, dtype=np.int64)
                yield pd.DataFrame({"study_id": np.repeat(own["study_id"].to_numpy(), k), "k": k, "item": np.repeat(own["item"].to_numpy(), k), "factor": np.tile(np.arange(1, k + 1), len(own)), "hits": hits.ravel(), "n": np.repeat(sizes // k, k)})

    counted = draws.where("kind = 'loading'").select("study_id", "k", "item", "values").mapInPandas(count, "study_id string, k int, item int, factor int, hits long, n long")
    return counted.groupBy(*KEYS, "item", "factor").agg((F.sum("hits") / F.sum("n")).alias("p"))


def fingerprint(sorts: DataFrame, chains: int, iterations: int, burn: int, thin: int, seed: int) -> str:
    """What draws depend on but K: the settings and the cells of ``sorts``, whatever their order or partitions; extra columns don't count."""
    cells = sorts.select(F.xxhash64("study_id", F.col("p_idx").cast("long"), F.col("stmt_num").cast("long"), F.col("value").cast("double")).cast("decimal(38,0)").alias("h"))
    seen = cells.agg(F.count("*").alias("n"), F.sum("h").alias("s"), F.sum(F.abs(F.col("h"))).alias("a")).first()
    return hashlib.sha256(json.dumps([chains, iterations, burn, thin, seed, *map(str, seen)]).encode()).hexdigest()[:32]


def _batches(spark, path: str) -> dict[str, list[int]]:
    """Folders of draws under ``path`` that were finished, with the K that each holds, by the name they were given."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return {}
    there = [s.getPath() for s in fs.listStatus(p)]
    done = [x for x in there if x.getName().startswith("k-") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(x, "_SUCCESS"))]
    return {x.toString(): [int(k) for k in x.getName()[2:].split("-")] for x in done}


def stored_draws(sorts: DataFrame, ks: list[int], root: str, chains: int = 2, iterations: int = ITERATIONS, burn: int = BURN, thin: int = THIN, seed: int = SEED) -> DataFrame:
    """``draws`` kept under ``root``, a folder that all executors share: a table for each fingerprint, partitioned by study, K and chain.

    Only the K that no finished batch holds are sampled, all in one job, and
    appended as a batch of their own; a batch that was interrupted has no mark
    of success and is sampled anew. Longer chains are other draws and have a
    table of their own. No K asked: no rows.
    """
    spark = sorts.sparkSession
    path = f"{root.rstrip('/')}/draws-{fingerprint(sorts, chains, iterations, burn, thin, seed)}"
    batches = _batches(spark, path)
    missing = sorted(set(ks) - {k for held in batches.values() for k in held})
    if missing:
        new = f"{path}/k-{'-'.join(map(str, missing))}"
        # study names stay a column: as folder names they would be read back as other types
        out = draws(sorts, missing, chains, iterations, burn, thin, seed).withColumns({"by_study": F.xxhash64("study_id"), "by_k": F.col("k"), "by_chain": F.col("chain")})
        out.write.mode("overwrite").partitionBy("by_study", "by_k", "by_chain").parquet(new)
        batches[new] = missing
    wanted = [b for b, held in batches.items() if set(held) & set(ks)]
    if not wanted:
        return spark.createDataFrame([], DRAWS)
    parts = [spark.read.schema(DRAWS + ", by_study long, by_k int, by_chain int").parquet(b) for b in wanted]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out.where(F.col("by_k").isin(sorted(set(ks)))).drop("by_study", "by_k", "by_chain")


KEYS = ["study_id", "k"]


def summary(draws: DataFrame, kind: str) -> DataFrame:
    """Posterior mean, sd and 95 % interval of loadings or z-scores."""
    if "values" in draws.columns:

        def of(v):
            low, high = np.quantile(v, [0.025, 0.975], axis=0)
            return {"mean": v.mean(axis=0), "sd": v.std(axis=0, ddof=1) if len(v) > 1 else np.nan, "low": low, "high": high}

        return _of_parameters(draws.where(F.col("kind") == kind), [*KEYS, "item"], of, ["mean", "sd", "low", "high"])
    return draws.where(F.col("kind") == kind).groupBy(*KEYS, "item", "factor").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))


def convergence(draws: DataFrame) -> DataFrame:
    """Split-free R-hat of each parameter and the worst of each K; none of a parameter that never moves."""
    if "values" in draws.columns:
        # what never moves has no variance, whatever its mean's last bit
        of = lambda v: {"m": v.mean(axis=0), "v": np.where(v.min(axis=0) < v.max(axis=0), v.var(axis=0, ddof=1) if len(v) > 1 else np.nan, 0.0), "n": float(len(v))}
        per = _of_parameters(draws, [*KEYS, "kind", "item", "chain"], of, ["m", "v", "n"])
    else:
        per = draws.groupBy(*KEYS, "kind", "item", "factor", "chain").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    r = per.groupBy(*KEYS, "kind", "item", "factor").agg(F.avg("v").alias("w"), F.var_samp("m").alias("b"), F.min("n").alias("n"))
    rhat = F.sqrt(((F.col("n") - 1) / F.col("n") * F.col("w") + F.coalesce("b", F.lit(0.0))) / F.col("w"))
    return r.withColumn("rhat", F.when(F.col("w") > 0, rhat)).groupBy(*KEYS, "kind").agg(F.max("rhat").alias("worst_rhat"), F.avg("rhat").alias("mean_rhat"))


def fdr_claims(claims: DataFrame, q: float, by: list[str], ties: tuple[str, ...] = ("item", "factor")) -> DataFrame:
    """One posterior error rule: in falling probability ``p``, claims are made while the mean of 1 - p stays within ``q``; ``expected_false`` counts them.

    Probabilities are shares of draws, so means that differ by rounding alone count as equal. Equal probabilities are taken in the order of ``ties``, which must tell all claims apart.
    """
    upto = Window.partitionBy(*by).orderBy(F.desc("p"), *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = claims.withColumn("_m", F.round(F.avg(1 - F.col("p")).over(upto), 12)).withColumn("claimed", F.col("_m") <= q)
    return out.withColumn("expected_false", F.sum(F.when(F.col("claimed"), 1 - F.col("p")).otherwise(0.0)).over(upto)).drop("_m")


def flag_claims(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """Sorts that define a factor: probability that its loading has the larger share of the sort's communality and is not negligible."""
    return fdr_claims(_flag_shares(draws), q, KEYS)


def distinguishing_claims(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """Statements on which a factor stands above or below all others: the larger of both probabilities."""
    d = long(draws.where("k >= 2"), "zscore")
    by = Window.partitionBy(*KEYS, "chain", "draw", "item")
    hi, lo = F.max("value").over(by), F.min("value").over(by)
    p = d.withColumn("top", (F.col("value") == hi).cast("double")).withColumn("bottom", (F.col("value") == lo).cast("double")).groupBy(*KEYS, "item", "factor").agg(F.greatest(F.avg("top"), F.avg("bottom")).alias("p"))
    return fdr_claims(p, q, KEYS)


def consensus_claims(draws: DataFrame, q: float = 0.05, width: float = 0.75) -> DataFrame:
    """Statements on which all factors lie within ``width``."""
    d = long(draws.where("k >= 2"), "zscore").groupBy(*KEYS, "chain", "draw", "item").agg((F.max("value") - F.min("value")).alias("spread"))
    p = d.groupBy(*KEYS, "item").agg(F.avg((F.col("spread") < width).cast("double")).alias("p")).withColumn("factor", F.lit(0))
    return fdr_claims(p, q, KEYS)


def star_claims(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """Pairs of factors that a statement tells apart: the larger probability of one score above the other; ``diff`` is its posterior mean.

    A draw's scores of a statement are one array of K values, so pairs are made of K values and never by a join of draws.
    """
    by = long(draws.where("k >= 2"), "zscore").groupBy(*KEYS, "chain", "draw", "item").agg(F.array_sort(F.collect_list(F.struct("factor", "value"))).alias("z"))
    pairs = F.flatten(F.transform("z", lambda a: F.transform(F.filter("z", lambda b: b["factor"] > a["factor"]), lambda b: F.struct(a["factor"].alias("factor"), b["factor"].alias("other"), (a["value"] - b["value"]).alias("diff")))))
    each = by.select(*KEYS, "item", F.inline(pairs))
    p = F.greatest(F.avg((F.col("diff") > 0).cast("double")), F.avg((F.col("diff") < 0).cast("double")))
    return fdr_claims(each.groupBy(*KEYS, "item", "factor", "other").agg(F.avg("diff").alias("diff"), p.alias("p")), q, KEYS, ("item", "factor", "other"))


def claim_families(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """``(study_id, k, family, n, claimed, expected_false)``: how many claims of each of the four families are made at ``q`` and how many of them are expected to be false."""
    families = {"flags": flag_claims, "distinguishing": distinguishing_claims, "consensus": consensus_claims, "stars": star_claims}
    out = None
    for name, of in families.items():
        one = of(draws, q).groupBy(*KEYS).agg(F.count("*").alias("n"), F.count_if("claimed").alias("claimed"), F.sum(F.when(F.col("claimed"), 1 - F.col("p")).otherwise(0.0)).alias("expected_false")).select(*KEYS, F.lit(name).alias("family"), "n", "claimed", "expected_false")
        out = one if out is None else out.unionByName(one)
    return out


def claims(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """``flag_claims`` (kind loading) and ``distinguishing_claims`` (kind zscore) from one reading of long draws, so that they are sampled once (packed ones are a stored table).

    Scores of a lone factor have no others to stand apart from: their ``p`` and ``claimed`` are null.
    """
    if "values" in draws.columns:
        load = _flag_shares(draws).withColumn("kind", F.lit("loading"))
        return fdr_claims(load, q, [*KEYS, "kind"]).unionByName(claims(long(draws, "zscore"), q))
    by = Window.partitionBy(*KEYS, "chain", "draw", "kind", "item")
    sq = F.col("value") * F.col("value")
    hit = (2 * sq > F.sum(sq).over(by)) & (F.abs("value") > 0.3)
    seen = draws.select("*", hit.cast("double").alias("hit"), (F.col("value") == F.max("value").over(by)).cast("double").alias("top"), (F.col("value") == F.min("value").over(by)).cast("double").alias("bottom"))
    p = F.when(F.col("kind") == "loading", F.avg("hit")).when(F.col("k") >= 2, F.greatest(F.avg("top"), F.avg("bottom")))
    return fdr_claims(seen.groupBy(*KEYS, "kind", "item", "factor").agg(p.alias("p")), q, [*KEYS, "kind"])


def ladder(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """Per K: factors with at least two defining sorts and one distinguishing statement, and whether all have them."""
    f = claims(draws, q).groupBy(*KEYS, "factor").agg(F.count_if(F.col("claimed") & (F.col("kind") == "loading")).alias("n_flags"), F.count_if(F.col("claimed") & (F.col("kind") == "zscore")).alias("n_dist"))
    ok = (F.col("n_flags") >= 2) & ((F.col("n_dist") >= 1) | (F.col("k") == 1))
    return f.groupBy(*KEYS).agg(F.count_if(ok).cast("int").alias("supported"), F.bool_and(ok).alias("adequate"), F.sum("n_flags").alias("n_flags"), F.sum("n_dist").alias("n_distinguishing"))


def composition(draws: DataFrame, q: float = 0.05) -> DataFrame:
    """Defining sorts of each factor by the sign of their loading; small: fewer than five."""
    s = flag_claims(draws, q).where("claimed").join(summary(draws, "loading").select(*KEYS, "item", "factor", "mean"), [*KEYS, "item", "factor"])
    return s.groupBy(*KEYS, "factor").agg(F.count_if(F.col("mean") > 0).alias("n_positive"), F.count_if(F.col("mean") < 0).alias("n_negative"), (F.count("*") < 5).alias("small"))


def to_flags(draws: DataFrame, k: int, sorts: DataFrame, q: float = 0.05) -> DataFrame:
    """The classical shape: posterior mean loadings with flags, ready for scores, characteristics and the rest."""
    people = sorts.select("study_id", "participant", "p_idx").distinct()
    load = summary(draws.where(F.col("k") == k), "loading").select("study_id", F.col("item").alias("p_idx"), "factor", F.col("mean").alias("loading"))
    own = flag_claims(draws.where(F.col("k") == k), q).where("claimed").select("study_id", F.col("item").alias("p_idx"), "factor", F.lit(True).alias("flagged"))
    return people.join(load, ["study_id", "p_idx"]).join(own, ["study_id", "p_idx", "factor"], "left").fillna(False, ["flagged"])


def unspanned_clusters(sorts: DataFrame, unspanned: DataFrame) -> DataFrame:
    """Pairs of unspanned people ``(study_id, p_idx)`` who are each other's nearest; r is compared to 12 places, of equal ones the least p_idx is taken."""
    from .correlation import nearest

    best = nearest(sorts.join(unspanned.select("study_id", "p_idx"), ["study_id", "p_idx"], "left_semi"))
    back = best.select("study_id", F.col("p_j").alias("p_i"), F.col("p_i").alias("p_j"))
    return best.join(back, ["study_id", "p_i", "p_j"]).where("p_i < p_j")


# --- what a ladder of K says ------------------------------------------------------------------------------

# The headline of each verdict, and the band of the extra-factor percentile.
HEADLINES = {
    "selected": "The search suggests K = %d",
    "single_viewpoint": "One shared viewpoint",
    "tension": "Two defensible solutions",
    "adequate_but_unsupported": "Fit without full support",
    "no_adequate_rung": "No adequate K in this range",
    "no_shared_structure": "No shared structure",
}
ADEQUATE = (0.05, 0.95)
#: Error rates that a reading may be set to, iterations that sampling may grow to, steps and limit of K.
LENSES, MOST_ITERATIONS, MORE_K, MOST_K = (0.01, 0.05, 0.10), 48_000, 2, 8


def verdicts(evidence: DataFrame) -> DataFrame:
    """The verdict over a ladder ``(study_id, k, adequate, supported, fit)``.

    ``adequate``: no sign of a missing factor; ``supported``: every factor has
    two defining sorts and a distinguishing statement; ``fit``: the larger, the
    better. Both at once at some K of two or more: selected, the smallest. Else,
    where fit and support are best at different K: tension. Some K adequate:
    adequate but unsupported. One factor supported alone: a single viewpoint.
    Support somewhere but no adequate K: no adequate rung. Else no shared structure.
    """
    many = F.col("k") >= 2
    s = evidence.groupBy("study_id").agg(
        F.min(F.when(many & F.col("adequate") & F.col("supported"), F.col("k"))).alias("k_star"),
        F.min(F.when(many & F.col("adequate"), F.col("k"))).alias("k_fit"),
        F.max(F.when(many & F.col("supported"), F.col("k"))).alias("k_support"),
        F.bool_or((F.col("k") == 1) & F.col("supported")).alias("one"),
        F.bool_or("adequate").alias("some"),
    )
    tension = F.col("k_fit").isNotNull() & F.col("k_support").isNotNull()
    v = F.when(F.col("k_star").isNotNull(), "selected").when(tension, "tension").when(F.col("k_fit").isNotNull(), "adequate_but_unsupported").when(F.coalesce("one", F.lit(False)), "single_viewpoint").when(F.col("k_support").isNotNull(), "no_adequate_rung").otherwise("no_shared_structure")
    out = s.withColumn("verdict", v).withColumn("k_reported", F.coalesce("k_star", "k_fit", "k_support", F.lit(1)))
    headline = F.when(F.col("verdict") == "selected", F.format_string(HEADLINES["selected"], "k_reported"))
    for name, text in HEADLINES.items():
        if name != "selected":
            headline = headline.when(F.col("verdict") == name, text)
    return out.select("study_id", "verdict", "k_star", "k_fit", "k_support", "k_reported", headline.alias("headline"))


def ladder_evidence(rungs: DataFrame, reported: DataFrame, q: float = 0.05) -> DataFrame:
    """A status for each K of ``rungs(study_id, k, percentile, supported)``; ``reported(study_id, k_reported, k_star)``."""
    in_band = F.coalesce(F.col("percentile").between(*ADEQUATE), F.lit(False))
    own, star = F.col("k") == F.col("k_reported"), F.coalesce(F.col("k") == F.col("k_star"), F.lit(False))
    status = F.when(own & star, "Reported · model's pick").when(own, "Reported").when(star, "model's pick").when((F.col("k") > 1) & ~F.col("supported"), f"support incomplete at q = {q:g}").when(~in_band, "outside the adequate band").otherwise("")
    return rungs.join(reported, "study_id").select("study_id", "k", "percentile", in_band.alias("in_band"), "supported", status.alias("status"))


def full_composition(flags: DataFrame, reliability: DataFrame | None = None) -> DataFrame:
    """Flags of each factor by sign with the sorts that no factor has; small: under five flags or a reliability under one half.

    ``flags(study_id, participant, factor, loading, flagged)``; ``reliability(study_id, factor, composite_reliability)``.
    """
    person = flags.groupBy("study_id", "participant").agg(F.bool_or("flagged").alias("any"))
    rest = person.groupBy("study_id").agg(F.count_if(~F.col("any")).alias("n_unclassified"), F.count("*").alias("n_sorts"))
    out = flags.groupBy("study_id", "factor").agg(F.count_if("flagged").alias("n_flagged"), F.count_if(F.col("flagged") & (F.col("loading") > 0)).alias("n_positive"), F.count_if(F.col("flagged") & (F.col("loading") < 0)).alias("n_negative")).join(rest, "study_id")
    weak = F.lit(False)
    if reliability is not None:
        out = out.join(reliability.select("study_id", "factor", "composite_reliability"), ["study_id", "factor"], "left")
        weak = F.coalesce(F.col("composite_reliability") < 0.5, F.lit(False))
    return out.select("study_id", "factor", "n_flagged", "n_positive", "n_negative", "n_unclassified", "n_sorts", ((F.col("n_flagged") < 5) | weak).alias("small"))


def statement_roles(scores: DataFrame, distinguishing: DataFrame, consensus: DataFrame, show: str = "all") -> DataFrame:
    """Statements of each factor with their role: the factors they distinguish, or consensus; ``show``: all, dist or cons."""
    names = distinguishing.groupBy("study_id", "stmt_num").agg(F.concat(F.lit("distinguishing "), F.array_join(F.transform(F.array_sort(F.collect_set("factor")), lambda f: F.concat(F.lit("F"), f.cast("string"))), ", ")).alias("d"))
    out = scores.join(names, ["study_id", "stmt_num"], "left").join(consensus.select("study_id", "stmt_num", F.lit("consensus").alias("c")).distinct(), ["study_id", "stmt_num"], "left").withColumn("role", F.coalesce("d", "c", F.lit(""))).drop("d", "c")
    return out.where({"all": "true", "dist": "role like 'distinguishing%'", "cons": "role = 'consensus'"}[show])


def continued(iterations: int, ks: list[int], more: str) -> tuple[int, list[int]]:
    """Settings of a longer run: ``sampling`` doubles the iterations, ``k`` tries two more factors, both up to their limits."""
    if more == "sampling":
        return min(2 * iterations, MOST_ITERATIONS), ks
    return iterations, sorted({*ks, *range(max(ks) + 1, min(max(ks) + MORE_K, MOST_K) + 1)})


def effective_sizes(draws: DataFrame, lags: int = 50) -> DataFrame:
    """Effective sample size of each parameter: draws over the autocorrelation time, summed until the first negative pair of lags.

    A chain's draws are ordered in an array of one parameter, bounded by the sampler's length.
    """
    if "values" in draws.columns:

        def of(v):
            c = v - v.mean(axis=0)
            n, tau, go = len(c), np.ones(c.shape[1]), (c * c).sum(axis=0) > 0
            for lag in range(1, min(lags, n - 1) + 1):
                rho = np.divide((c[: n - lag] * c[lag:]).sum(axis=0), (c * c).sum(axis=0), out=np.zeros(c.shape[1]), where=go)
                go = go & (rho > 0)
                tau = np.where(go, tau + 2 * rho, tau)
                if not go.any():
                    break
            return {"ess": n / tau}

        return _of_parameters(draws, [*KEYS, "kind", "item", "chain"], of, ["ess"]).groupBy(*KEYS, "kind", "item", "factor").agg(F.sum("ess").alias("ess"))
    per = draws.groupBy(*KEYS, "kind", "item", "factor", "chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("draw", "value"))), lambda x: x["value"]).alias("v"))
    n = F.size("v")
    mean = F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / n
    centred = per.withColumn("n", n).withColumn("c", F.transform("v", lambda x: x - mean))
    cov = lambda lag: F.aggregate(F.zip_with(F.slice("c", F.lit(1), F.greatest(F.lit(0), F.col("n") - lag)), F.slice("c", lag + 1, F.greatest(F.lit(0), F.col("n") - lag)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    centred = centred.withColumn("rho", F.transform(F.sequence(F.lit(0), F.least(F.lit(lags), F.col("n") - 1)), lambda lag: cov(lag)))
    rho = F.when(F.element_at("rho", 1) > 0, F.transform("rho", lambda r: r / F.element_at("rho", 1)))
    start = F.struct(F.lit(1.0).alias("tau"), F.lit(True).alias("go"))
    step = lambda a, r: F.struct(F.when(a["go"] & (r > 0), a["tau"] + 2 * r).otherwise(a["tau"]).alias("tau"), (a["go"] & (r > 0)).alias("go"))
    tau = F.aggregate(F.slice(rho, 2, lags), start, step, lambda a: a["tau"])
    return centred.withColumn("ess", F.coalesce(F.col("n") / tau, F.col("n").cast("double"))).groupBy(*KEYS, "kind", "item", "factor").agg(F.sum("ess").alias("ess"))


def person_check(sorts: DataFrame, flags: DataFrame, scores: DataFrame, least: float = 0.3) -> DataFrame:
    """Each participant's best correlation with a factor's z-scores; ``stands_apart`` below ``least`` in size, and where no factor has scores (``nearest`` and ``r`` are null)."""
    from .priorities import _corr

    r = sorts.join(scores.select("study_id", "stmt_num", "factor", "zscore"), ["study_id", "stmt_num"]).groupBy("study_id", "participant", "factor").agg(_corr("value", "zscore").alias("r"))
    best = r.groupBy("study_id", "participant").agg(F.max_by(F.struct("factor", "r"), F.struct(F.abs("r"), -F.col("factor"))).alias("b"))
    n = flags.groupBy("study_id", "participant").agg(F.count_if("flagged").alias("n_flags"))
    people = sorts.select("study_id", "participant").distinct()
    return people.join(best, ["study_id", "participant"], "left").join(n, ["study_id", "participant"], "left").select("study_id", "participant", F.col("b.factor").alias("nearest"), F.col("b.r").alias("r"), "n_flags", (F.coalesce(F.abs("b.r"), F.lit(0.0)) < least).alias("stands_apart"))
