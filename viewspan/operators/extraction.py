"""Extraction, rotation, retention and bootstrap: small dense algebra for each study, Monte Carlo spread over tasks.

Principal components of complete sorts, their rotations, eigenvalues, quality and
bootstrap and the nulls of parallel analysis come from sums over participants
(``gram``), however many there are, and so do minres factors of many complete sorts; centroid
factors of complete sorts take their unit rows. Other minres factors and studies with missing cells
need the study as a matrix: its sorts are packed into one row and kernels
run on it in grouped functions, so many studies run side by side. Replicates are
seeded by (seed, replicate), which makes results independent of partitioning and retries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import linalg as L
from ..functions import stats
from . import gram as S
from .factors import weight as _weight  # noqa: F401  (the same rule, as a column)


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(participants by statements, p_idx, names), ordered by index and statement."""
    pdf = pdf.sort_values(["p_idx", "stmt_num"])
    idx, first = np.unique(pdf["p_idx"].to_numpy(), return_index=True)
    x = pdf.pivot(index="p_idx", columns="stmt_num", values="value").sort_index().to_numpy(float)
    return x, idx, pdf["participant"].to_numpy()[first]


def _pairwise_r(x: np.ndarray) -> np.ndarray:
    """Correlations of rows, pairwise complete; undefined ones are 0."""
    if not np.isnan(x).any():
        return L.correlation(x)
    r = np.nan_to_num(pd.DataFrame(x.T).corr().to_numpy())
    np.fill_diagonal(r, 1.0)
    return r


LOADINGS = S.LOADINGS


def _extract_packed(sorts: DataFrame, k: int, method: str, rotation: str, clip: bool = False) -> DataFrame:
    """``clip``: a study with too few participants or statements gives the factors that it has."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, idx, names = _matrix(pdf)
        load = L.signed(L.rotate(L.extract(_pairwise_r(x), min(k, *x.shape) if clip else k, method), rotation))
        n, m = load.shape
        return pd.DataFrame({"study_id": pdf["study_id"].iloc[0], "participant": np.repeat(names, m), "p_idx": np.repeat(idx, m), "factor": np.tile(np.arange(1, m + 1), n), "loading": load.ravel()})

    return sorts.groupBy("study_id").applyInPandas(run, LOADINGS)


def extract(sorts: DataFrame, k: int, method: str = "pca", rotation: str = "none") -> DataFrame:
    """``(study_id, participant, p_idx, factor, loading)``: pca, centroid or minres; then varimax, quartimax, oblimin, promax or none."""
    rows = S.whole_rows(sorts)
    if method == "centroid":
        return S.centroid(rows, k, rotation).unionByName(_extract_packed(S.unwhole_sorts(sorts), k, method, rotation))
    if method == "minres":
        if rotation != "none":
            return _extract_packed(sorts, k, method, rotation)
        large = rows.where((F.col("n") >= S.MINRES_ROWS) & (F.size("v") > k))
        rest = sorts.join(F.broadcast(large.select("study_id").distinct()), "study_id", "left_anti")
        return S.minres(large, k).unionByName(_extract_packed(rest, k, method, rotation))
    return S.loadings(rows, S.solution(rows, k, rotation)).unionByName(_extract_packed(S.unwhole_sorts(sorts), k, method, rotation))


#: Unrotated factors shown for the audit, however many are retained.
WIDE = 8


def unrotated_wide(sorts: DataFrame, k: int, method: str = "pca") -> DataFrame:
    """Unrotated loadings of up to ``WIDE`` factors (one fewer than participants at most, ``k`` at least) with the communality they reach so far.

    Minres isn't fitted again for the view: its ``k`` retained factors stand in. Studies with fewer
    statements than factors show as many as there are statements.
    """
    sizes = sorts.where("value is not null").groupBy("study_id").agg(F.count_distinct("p_idx").alias("n"), F.count_distinct("stmt_num").alias("j"))
    shown = F.least(F.greatest(F.lit(k), F.least(F.lit(WIDE), F.col("n") - 1)), F.col("j"), F.col("n"))
    if method == "minres":
        own = extract(sorts, k, method)
    else:
        wide = max(k, WIDE)
        few = sizes.where(F.least("n", "j") < wide).select("study_id")
        own = extract(sorts.join(few, "study_id", "left_anti"), wide, method).unionByName(_extract_packed(sorts.join(few, "study_id", "left_semi"), wide, method, "none", clip=True))
    upto = Window.partitionBy("study_id", "p_idx").orderBy("factor").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = own.join(sizes, "study_id").where(F.col("factor") <= shown).select(*own.columns)
    return out.withColumn("cumulative_h2", F.sum(F.col("loading") * F.col("loading")).over(upto))


def factor_correlations(sorts: DataFrame, k: int, rotation: str) -> DataFrame:
    """``(study_id, f, g, phi)``: correlations of rotated principal components of whole studies; pattern times ``phi`` is the structure."""
    return S.factor_correlations(S.solution(S.whole_rows(sorts), k, rotation))


def structure(pattern: DataFrame, phi: DataFrame) -> DataFrame:
    """Pattern loadings with ``structure``, a sort's correlation with each factor: the sum of its pattern loadings times the factors' correlations."""
    p = pattern.select("study_id", "participant", "p_idx", F.col("factor").alias("f"), F.col("loading").alias("l")).join(phi, ["study_id", "f"])
    own = p.groupBy("study_id", "participant", "p_idx", F.col("g").alias("factor")).agg(F.sum(F.col("l") * F.col("phi")).alias("structure"))
    return pattern.select("study_id", "participant", "p_idx", "factor", "loading").join(own, ["study_id", "participant", "p_idx", "factor"])


def eigenvalues(sorts: DataFrame) -> DataFrame:
    """``(study_id, k, eigenvalue, variance, cumulative)`` of the by-person correlations."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, idx, _ = _matrix(pdf)
        w = L.eigen(_pairwise_r(x))[0]
        return pd.DataFrame({"study_id": pdf["study_id"].iloc[0], "k": np.arange(1, len(w) + 1), "eigenvalue": w, "n": len(idx)})

    holed = S.unwhole_sorts(sorts).groupBy("study_id").applyInPandas(run, "study_id string, k int, eigenvalue double, n long")
    spectra = S.spectra(S.whole_rows(sorts))
    # all but the first J are 0
    at = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
    whole = spectra.select("study_id", "n", "w", at.alias("k")).select("study_id", "k", F.coalesce(F.get("w", F.col("k") - 1), F.lit(0.0)).alias("eigenvalue"), "n")
    share = F.col("eigenvalue") / F.col("n")
    upto = Window.partitionBy("study_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return whole.unionByName(holed).select("study_id", "k", "eigenvalue", share.alias("variance"), F.sum(share).over(upto).alias("cumulative"))


def _replicated(sorts: DataFrame, n: int) -> DataFrame:
    """Each study's packed sorts once for each replicate."""
    packed = sorts.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("p_idx", "stmt_num", "value", "participant"))).alias("cells"))
    return packed.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("b")).repartition("study_id", "b")


def _unpacked(cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(pd.DataFrame([tuple(c.values()) if isinstance(c, dict) else tuple(c) for c in cells], columns=["p_idx", "stmt_num", "value", "participant"]))


def _null_eigenvalues(sorts: DataFrame, iterations: int, null: str, seed: int) -> DataFrame:
    def run(parts):
        studies: dict = {}
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                if row.study_id not in studies:
                    studies[row.study_id] = _unpacked(row.cells)[0]
                x = studies[row.study_id]
                rng = np.random.default_rng([seed, row.b])
                if null == "permute_columns":
                    y = np.stack([rng.permutation(c) for c in x.T]).T
                else:
                    y = rng.choice(x[~np.isnan(x)], size=x.shape)
                w = L.pca_of_rows(y, 1)[1]
                out.append(pd.DataFrame({"study_id": row.study_id, "b": row.b, "k": np.arange(1, len(w) + 1), "eigenvalue": w}))
            yield pd.concat(out) if out else pd.DataFrame({"study_id": [], "b": [], "k": [], "eigenvalue": []})

    return _replicated(sorts, iterations).mapInPandas(run, "study_id string, b int, k int, eigenvalue double")


def parallel_analysis(sorts: DataFrame, iterations: int = 100, percentile: float = 0.95, null: str = "pooled_resample", seed: int = 42) -> DataFrame:
    """Eigenvalues against the percentile of those of a null: values pooled and drawn again, or each statement permuted (``permute_columns``)."""
    spectra = S.null_spectra(S.whole_rows(sorts), iterations, null, seed)
    longest = spectra.groupBy("study_id").agg(F.max(F.size("w")).alias("most"))
    whole = spectra.join(longest, "study_id").select("study_id", "w", F.explode(F.sequence(F.lit(1), "most")).alias("k")).select("study_id", "k", F.coalesce(F.get("w", F.col("k") - 1), F.lit(0.0)).alias("eigenvalue"))
    holed = _null_eigenvalues(S.unwhole_sorts(sorts), iterations, null, seed).select("study_id", "k", "eigenvalue")
    limit = whole.unionByName(holed).groupBy("study_id", "k").agg(F.percentile("eigenvalue", F.lit(percentile)).alias("threshold"))
    # eigenvalues beyond the longest null are 0 in every replicate
    limited = eigenvalues(sorts).join(limit, ["study_id", "k"], "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.0)))
    return limited.select("study_id", "k", "eigenvalue", "threshold", (F.col("eigenvalue") > F.col("threshold")).alias("retain"))


def number_of_factors(sorts: DataFrame, iterations: int = 100, seed: int = 42) -> DataFrame:
    """``(study_id, k)``: eigenvalues over the permutation null, held to 2..7."""
    p = parallel_analysis(sorts, iterations, null="permute_columns", seed=seed)
    return p.groupBy("study_id").agg(F.least(F.lit(7), F.greatest(F.lit(2), F.count_if("retain"))).cast("int").alias("k"))


def retention_evidence(sorts: DataFrame, max_k: int = 8, method: str = "pca", iterations: int = 100, seed: int = 42) -> DataFrame:
    """Per k: eigenvalue, share, threshold, Kaiser, Humphrey's rule and two significant loadings."""
    statements = sorts.groupBy("study_id").agg(F.count_distinct("stmt_num").alias("j"), F.count_distinct("p_idx").alias("n"))
    load = extract(sorts, max_k, method)
    a = F.abs("loading")
    rank = F.row_number().over(Window.partitionBy("study_id", "factor").orderBy(a.desc(), "p_idx"))
    top = load.withColumn("rn", rank).join(statements, "study_id").groupBy("study_id", F.col("factor").alias("k")).agg(
        (F.max(F.when(F.col("rn") == 1, a)) * F.max(F.when(F.col("rn") == 2, a)) > 2 / F.sqrt(F.max("j"))).alias("humphrey"),
        (F.count_if(a > 1.96 / F.sqrt("j")) >= 2).alias("two_loadings"),
    )
    p = parallel_analysis(sorts, iterations, seed=seed).where(F.col("k") <= max_k).join(statements, "study_id").where(F.col("k") < F.col("n"))
    upto = Window.partitionBy("study_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = p.withColumn("variance", F.col("eigenvalue") / F.col("n")).withColumn("cumulative", F.sum(F.col("eigenvalue") / F.col("n")).over(upto))
    return p.join(top, ["study_id", "k"]).select("study_id", "k", "eigenvalue", "variance", "cumulative", "threshold", F.col("retain").alias("parallel"), (F.col("eigenvalue") > 1).alias("kaiser"), "humphrey", "two_loadings")


def quality_metrics(sorts: DataFrame) -> DataFrame:
    """KMO, Bartlett's p, determinant and mean correlation of each study, with how they are read; nan where the matrix is singular."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, _, _ = _matrix(pdf)
        r = _pairwise_r(x)
        n, j = x.shape
        sign, logdet = np.linalg.slogdet(r)
        det = math.exp(logdet) if sign > 0 else 0.0
        df = n * (n - 1) / 2
        p = stats.chi2_sf(-(j - 1 - (2 * n + 5) / 6) * logdet, df) if det > 1e-300 and j > 1 else math.nan
        return pd.DataFrame([{"study_id": pdf["study_id"].iloc[0], "kmo": L.kmo(r), "bartlett_p": p, "determinant": det, "avg_r": float(r[np.tril_indices(n, -1)].mean())}])

    # with as many participants as statements or more R is singular and only its mean is left to find
    rows = S.whole_rows(sorts)
    large = rows.where(F.col("n") >= F.size("v"))
    singular = S.spectra(large).select("study_id", F.lit(math.nan).alias("kmo"), F.lit(math.nan).alias("bartlett_p"), F.lit(0.0).alias("determinant"), "avg_r")
    rest = sorts.join(large.select("study_id").distinct(), "study_id", "left_anti")
    out = singular.unionByName(rest.groupBy("study_id").applyInPandas(run, "study_id string, kmo double, bartlett_p double, determinant double, avg_r double"))
    k, b = F.col("kmo"), F.col("bartlett_p")
    return out.withColumns({
        "kmo_band": F.when(k.isNull() | F.isnan(k), "Not available").when(k >= 0.9, "Excellent").when(k >= 0.8, "Good").when(k >= 0.7, "Acceptable").when(k >= 0.6, "Mediocre").otherwise("Poor - reconsider analysis"),
        "bartlett_band": F.when(b.isNull() | F.isnan(b), "Not available").when(b < 0.001, "Highly significant").when(b < 0.05, "Significant").otherwise("Not significant"),
        "determinant_band": F.when(F.col("determinant") > 1e-5, "OK").otherwise("Near singular"),
    })


# --- bootstrap ------------------------------------------------------------------------------------


def _zscores(x: np.ndarray, load: np.ndarray, flags: np.ndarray) -> np.ndarray:
    s = np.where(flags, S.weights_of(load), 0.0).T @ np.nan_to_num(x)
    sd = s.std(axis=1, ddof=1, keepdims=True)
    z = np.divide(s - s.mean(axis=1, keepdims=True), sd, out=np.zeros_like(s), where=sd > 0)
    z[~flags.any(axis=0)] = np.nan
    return z


#: How a replicate's loadings of the people ``drawn`` are turned to those of the original.
ALIGNMENTS = {
    "person": lambda load, target, drawn: L.procrustes(load, target[drawn]),
    "names": lambda load, target, drawn: L.align_people(load, drawn, target, np.arange(len(target))),
    "positional": lambda load, target, drawn: L.procrustes(load, target),
    "curves": lambda load, target, drawn: L.align_by_curves(load, target),
}


def bootstrap(sorts: DataFrame, k: int, replicates: int = 1000, method: str = "pca", rotation: str = "varimax", seed: int = 42, align: str = "person", level: float | None = None) -> DataFrame:
    """Replicates as long rows ``(study_id, b, kind, item, factor, value, flagged)``; kind is loading (item: p_idx) or zscore (item: stmt_num).

    Participants are drawn with replacement; each replicate is extracted,
    rotated and turned to the original loadings. ``align``: rows are paired
    with the person drawn ("person") or that person once, however often drawn
    ("names"), by position ("positional", as older tools do), or columns are
    assigned by their sorted curves, as for other people ("curves"). Copies of a person are averaged back; people not drawn have
    no row. Principal components of whole studies are found from weighted sums, the rest from copies of the packed study.
    With ``level`` no rows are made of the loadings of the former: what is returned are the ``intervals`` of that level, found where the participants are.
    """
    if align not in ALIGNMENTS:
        raise ValueError(f"{align}: one of {', '.join(ALIGNMENTS)}")
    if method == "pca" and align == "person":
        if level is not None:
            loads, z = S.bootstrap_intervals(S.whole_rows(sorts), k, replicates, rotation, seed, level)
            return loads.unionByName(intervals(z.unionByName(_bootstrap_packed(S.unwhole_sorts(sorts), k, replicates, method, rotation, seed, align)), level))
        return S.bootstrap(S.whole_rows(sorts), k, replicates, rotation, seed).unionByName(_bootstrap_packed(S.unwhole_sorts(sorts), k, replicates, method, rotation, seed, align))
    rows = _bootstrap_packed(sorts, k, replicates, method, rotation, seed, align)
    return rows if level is None else intervals(rows, level)


def _bootstrap_packed(sorts: DataFrame, k: int, replicates: int, method: str, rotation: str, seed: int, align: str) -> DataFrame:
    def run(parts):
        studies: dict = {}  # a study's sorts and original solution, found once in each task
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                if row.study_id not in studies:
                    x, idx, _ = _unpacked(row.cells)
                    studies[row.study_id] = x, idx, L.signed(L.rotate(L.extract(_pairwise_r(x), k, method), rotation))
                x, idx, target = studies[row.study_id]
                n, j = x.shape
                rng = np.random.default_rng([seed, row.b])
                drawn = rng.integers(0, n, n)
                try:
                    load = L.rotate(L.extract(_pairwise_r(x[drawn]), k, method), rotation)
                except np.linalg.LinAlgError:
                    continue
                if np.isnan(load).any():
                    continue
                load = ALIGNMENTS[align](load, target, drawn)
                flags = S.flagged_loads(load, j)
                z = _zscores(x[drawn], load, flags)
                people = np.unique(drawn)
                mean = np.stack([load[drawn == p].mean(axis=0) for p in people])
                own = S.flagged_loads(mean, j)
                out.append(pd.DataFrame({"study_id": row.study_id, "b": row.b, "kind": "loading", "item": np.repeat(idx[people], k), "factor": np.tile(np.arange(1, k + 1), len(people)), "value": mean.ravel(), "flagged": own.ravel()}))
                out.append(pd.DataFrame({"study_id": row.study_id, "b": row.b, "kind": "zscore", "item": np.tile(np.arange(1, j + 1), k), "factor": np.repeat(np.arange(1, k + 1), j), "value": z.ravel(), "flagged": False}))
            if out:
                yield pd.concat(out)

    return _replicated(sorts, replicates).mapInPandas(run, "study_id string, b int, kind string, item int, factor int, value double, flagged boolean")


def intervals(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """``(study_id, kind, item, factor, boot_mean, boot_sd, ci_low, ci_high, n)`` of replicates."""
    lo, hi = (1 - level) / 2, (1 + level) / 2
    own = samples.where(~F.isnan("value"))
    return own.groupBy("study_id", "kind", "item", "factor").agg(F.avg("value").alias("boot_mean"), F.stddev_samp("value").alias("boot_sd"), F.percentile("value", F.lit(lo)).alias("ci_low"), F.percentile("value", F.lit(hi)).alias("ci_high"), F.count("*").alias("n"))


def bootstrap_ci(samples: DataFrame, original: DataFrame, level: float = 0.95) -> DataFrame:
    """Mean, sd, percentile interval, bias and bias-corrected estimate; ``samples``: rows of replicates, or their ``intervals``; ``original(study_id, kind, item, factor, value)``."""
    s = samples if "boot_mean" in samples.columns else intervals(samples, level)
    o = original.select("study_id", "kind", "item", "factor", F.col("value").alias("original"))
    return s.join(o, ["study_id", "kind", "item", "factor"]).withColumn("bias", F.col("boot_mean") - F.col("original")).withColumn("bc_estimate", F.col("original") - F.col("bias"))


def flag_frequency(samples: DataFrame) -> DataFrame:
    """How often a sort is flagged: of all replicates, and of those in which it was drawn."""
    total = samples.groupBy("study_id").agg(F.count_distinct("b").alias("replicates"))
    s = samples.where("kind = 'loading'").groupBy("study_id", F.col("item").alias("p_idx"), "factor").agg(F.count_if("flagged").alias("k"), F.count("*").alias("n"))
    return s.join(total, "study_id").select("study_id", "p_idx", "factor", (F.col("k") / F.col("replicates")).alias("flag_frequency"), (F.col("k") / F.col("n")).alias("flag_frequency_when_sampled"))


def bootstrap_flags(sorts: DataFrame, k: int, replicates: int = 1000, rotation: str = "varimax", seed: int = 42) -> DataFrame:
    """``flag_frequency`` of ``bootstrap`` by principal components without its rows: whole studies are counted by blocks of participants."""
    counted = S.flag_counts(S.whole_rows(sorts), k, replicates, rotation, seed)
    whole = counted.select("study_id", "p_idx", "factor", (F.col("k") / replicates).alias("flag_frequency"), (F.col("k") / F.col("n")).alias("flag_frequency_when_sampled"))
    return whole.unionByName(flag_frequency(_bootstrap_packed(S.unwhole_sorts(sorts), k, replicates, "pca", rotation, seed, "person")))


def stability(samples: DataFrame, original: DataFrame) -> DataFrame:
    """Per kind the correlation of each replicate with the original: mean, sd, least, greatest."""
    return _spread(_agreement(samples, original))


def bootstrap_stability(sorts: DataFrame, k: int, replicates: int = 1000, rotation: str = "varimax", seed: int = 42) -> DataFrame:
    """``stability`` of ``bootstrap`` by principal components without rows of its loadings: whole studies are summed by blocks of participants."""
    original = original_solution(sorts, k, "pca", rotation)
    loads, z = S.bootstrap_agreement(S.whole_rows(sorts), k, replicates, rotation, seed)
    rest = _bootstrap_packed(S.unwhole_sorts(sorts), k, replicates, "pca", rotation, seed, "person")
    return _spread(loads.unionByName(_agreement(z, original.where("kind = 'zscore'"))).unionByName(_agreement(rest, original)))


def _agreement(samples: DataFrame, original: DataFrame) -> DataFrame:
    o = original.select("study_id", "kind", "item", "factor", F.col("value").alias("original"))
    return samples.where(~F.isnan("value")).join(o, ["study_id", "kind", "item", "factor"]).groupBy("study_id", "kind", "b").agg(F.corr("value", "original").alias("r"))


def _spread(per: DataFrame) -> DataFrame:
    return per.groupBy("study_id", "kind").agg(F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min("r").alias("min"), F.max("r").alias("max"), F.count("*").alias("replicates"))


def stability_verdict(ci: DataFrame) -> DataFrame:
    """Per factor: Tucker congruence of original and bootstrap means, median width of intervals, and whether it is weak."""
    s = ci.where("kind = 'loading'").groupBy("study_id", "factor").agg((F.sum(F.col("original") * F.col("boot_mean")) / F.sqrt(F.sum(F.col("original") * F.col("original")) * F.sum(F.col("boot_mean") * F.col("boot_mean")))).alias("phi"), F.median(F.col("ci_high") - F.col("ci_low")).alias("median_width"))
    return s.withColumn("weak", F.col("phi") < 0.90)


def rank_range(ci: DataFrame) -> DataFrame:
    """The ranks that a statement may take within its interval: those of the upper and lower bounds."""
    by = Window.partitionBy("study_id", "factor")
    return ci.where("kind = 'zscore'").select("study_id", "factor", F.col("item").alias("stmt_num"), F.rank().over(by.orderBy(F.desc("ci_high"))).alias("best_rank"), F.rank().over(by.orderBy(F.desc("ci_low"))).alias("worst_rank"))


def original_solution(sorts: DataFrame, k: int, method: str = "pca", rotation: str = "varimax") -> DataFrame:
    """Loadings and z-scores of all participants in the shape of ``bootstrap``."""
    load = extract(sorts, k, method, rotation)
    statements = sorts.groupBy("study_id").agg(F.count_distinct("stmt_num").alias("j"))
    flagged = load.join(statements, "study_id")
    sq = F.col("loading") * F.col("loading")
    flag = (F.abs("loading") > S.Z05 / F.sqrt("j")) & (2 * sq > F.sum(sq).over(Window.partitionBy("study_id", "p_idx")))
    clipped = F.signum("loading") * F.least(F.lit(0.9999), F.greatest(F.lit(1e-4), F.abs("loading")))
    weights = flagged.select("study_id", "p_idx", "factor", F.when(flag, clipped / (1 - clipped * clipped)).otherwise(0.0).alias("w"), flag.alias("flag"))
    sums = sorts.select("study_id", "p_idx", "stmt_num", "value").join(weights, ["study_id", "p_idx"]).groupBy("study_id", "factor", F.col("stmt_num").alias("item")).agg(F.sum(F.coalesce("value", F.lit(0.0)) * F.col("w")).alias("wsum"), F.bool_or("flag").alias("any"))
    z = S.standardised(sums, ["study_id", "factor"], F.col("any"))
    return load.select("study_id", F.lit("loading").alias("kind"), F.col("p_idx").alias("item"), "factor", F.col("loading").alias("value")).unionByName(z.select("study_id", F.lit("zscore").alias("kind"), "item", "factor", F.col("zscore").alias("value")))


def suggested_k(evidence: DataFrame) -> DataFrame:
    """Per study the number of factors that each rule of ``retention_evidence`` leaves: all before the first that fails it."""
    first = lambda rule: F.coalesce(F.min(F.when(~F.col(rule), F.col("k"))) - 1, F.max("k")).cast("int")
    return evidence.groupBy("study_id").agg(first("parallel").alias("k_parallel"), first("kaiser").alias("k_kaiser"), first("two_loadings").alias("k_two"))


def flag_agreement(samples: DataFrame, flags: DataFrame) -> DataFrame:
    """Share of sorts and factors of each replicate that are flagged as in the original: mean, sd, least, greatest."""
    own = samples.where("kind = 'loading'").select("study_id", "b", F.col("item").alias("p_idx"), "factor", F.col("flagged").alias("again"))
    per = own.join(flags.select("study_id", "p_idx", "factor", "flagged"), ["study_id", "p_idx", "factor"]).groupBy("study_id", "b").agg(F.avg((F.col("again") == F.col("flagged")).cast("double")).alias("a"))
    return per.groupBy("study_id").agg(F.avg("a").alias("mean"), F.stddev_samp("a").alias("sd"), F.min("a").alias("min"), F.max("a").alias("max"), F.count("*").alias("replicates"))


def bootstrap_success(samples: DataFrame, asked: int, least: float = 0.5, good: float = 0.9) -> DataFrame:
    """Per study how many replicates came out and what that means: under half no result should be read, under nine tenths with care."""
    share = F.col("done") / asked
    return samples.groupBy("study_id").agg(F.count_distinct("b").alias("done")).select("study_id", "done", share.alias("share"), F.when(share < least, "failed").when(share < good, "warning").otherwise("ok").alias("status"))
