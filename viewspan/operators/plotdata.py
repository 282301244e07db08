"""The data behind figures: tidy frames that any plotting library can draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FACTOR = ["study_id", "factor"]
STATEMENT = ["study_id", "stmt_num"]


def contrast_color(df: DataFrame, colour: str = "colour") -> DataFrame:
    """``text``: black on light colours (#rrggbb), white on dark, by luminance."""
    part = lambda at: F.conv(F.substring(colour, at, 2), 16, 10).cast("int")
    lum = 0.299 * part(2) + 0.587 * part(4) + 0.114 * part(6)
    return df.withColumn("text", F.when(lum > 0.6 * 255, "#000000").otherwise("#ffffff"))


def loadings_frame(flags: DataFrame) -> DataFrame:
    return flags.withColumn("place", F.row_number().over(Window.partitionBy(*FACTOR).orderBy(F.desc("loading"), "participant")))


def scores_frame(scores: DataFrame, n: int) -> DataFrame:
    by = Window.partitionBy(*FACTOR)
    down, up = F.row_number().over(by.orderBy(F.desc("zscore"), "stmt_num")), F.row_number().over(by.orderBy("zscore", F.desc("stmt_num")))
    return scores.select(*FACTOR, "stmt_num", "zscore", F.when(down <= n, "Top").when(up <= n, "Bottom").otherwise("Middle").alias("pole"))


def comparison_frame(scores: DataFrame) -> DataFrame:
    by = Window.partitionBy(*STATEMENT)
    out = scores.withColumns({"variance": F.var_samp("zscore").over(by), "spread": F.max("zscore").over(by) - F.min("zscore").over(by)})
    return out.withColumn("place", F.dense_rank().over(Window.partitionBy("study_id").orderBy(F.desc("variance"), "stmt_num")))


def crib_panel_frame(scores: DataFrame, margin: float = 0.5) -> DataFrame:
    """Statements that a factor holds clearly higher or lower than every other one, on z."""
    by = Window.partitionBy(*STATEMENT)
    r = scores.withColumns({"hi": F.row_number().over(by.orderBy(F.desc("zscore"), "factor")), "lo": F.row_number().over(by.orderBy("zscore", "factor"))})
    pick = lambda c, k: F.max(F.when(F.col(c) == k, F.col("zscore"))).over(by)
    r = r.withColumns({"top": F.when(F.col("hi") == 1, pick("hi", 2)).otherwise(pick("hi", 1)), "bottom": F.when(F.col("lo") == 1, pick("lo", 2)).otherwise(pick("lo", 1))})
    side = F.when(F.col("zscore") > F.col("top") + margin, "Higher").when(F.col("zscore") < F.col("bottom") - margin, "Lower")
    return r.select(*FACTOR, "stmt_num", side.alias("side")).where("side is not null")


def composition_frame(groups: DataFrame) -> DataFrame:
    n = groups.groupBy("study_id", "attribute", "level").agg(F.count("*").alias("n"))
    return n.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("study_id", "attribute")))


def priorities_frame(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("side", F.when(F.round("mean", 12) >= 0, "right").otherwise("left"))


def pyramid_frame(sorts: DataFrame) -> DataFrame:
    row = F.row_number().over(Window.partitionBy("study_id", "participant", "value").orderBy("stmt_num"))
    return sorts.where("value is not null").select("study_id", "participant", F.col("value").cast("int").alias("grid_value"), row.alias("card_row"), "stmt_num")


def scree_frame(eigen: DataFrame, people: int) -> DataFrame:
    """Eigenvalues with their share of variance and its running sum."""
    upto = Window.partitionBy("study_id").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return eigen.withColumn("variance", F.col("eigenvalue") / people).withColumn("cumulative", F.sum(F.col("eigenvalue") / people).over(upto))


def loadings_with_ci(flags: DataFrame, ci: DataFrame | None = None) -> DataFrame:
    """Loadings in order of their factor with the bootstrap's interval, ``ci(study_id, p_idx, factor, low, high)``, where there is one."""
    out = loadings_frame(flags)
    if ci is None:
        return out.withColumns({"low": F.lit(None).cast("double"), "high": F.lit(None).cast("double")})
    return out.join(ci.select("study_id", "p_idx", "factor", "low", "high"), ["study_id", "p_idx", "factor"], "left")


def listed_scores(scores: DataFrame, listed: DataFrame) -> DataFrame:
    """z-scores on all factors of the statements of ``listed(study_id, stmt_num)``, those with the widest spread first."""
    own = comparison_frame(scores).join(listed.select(*STATEMENT).distinct(), STATEMENT, "left_semi")
    place = F.dense_rank().over(Window.partitionBy("study_id").orderBy(F.desc("spread"), "stmt_num"))
    return own.select(*STATEMENT, "factor", "zscore", "spread", place.alias("place"))


def disagreement_frame(scores: DataFrame) -> DataFrame:
    """Statements by the range of their z over factors, widest first, with the factors at both ends."""
    s = scores.groupBy(*STATEMENT).agg((F.max("zscore") - F.min("zscore")).alias("spread"), F.max_by("factor", F.struct("zscore", -F.col("factor"))).alias("highest"), F.min_by("factor", F.struct("zscore", "factor")).alias("lowest"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("study_id").orderBy(F.desc("spread"), "stmt_num")))


def linkage_order(corr: DataFrame) -> DataFrame:
    """``(study_id, p_idx, place)``: participants in the order of a complete-linkage tree on 1 - r.

    A study's tree needs all its distances at once, so a figure's participants
    are one group; a picture of more than some thousands couldn't be read.
    Distances only grow as branches join, so a branch's nearest one is sought
    anew only if it has just been joined itself. Unknown r counts as 0.
    """
    import numpy as np
    import pandas as pd

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        people, inverse = np.unique(np.concatenate([pdf["p_i"], pdf["p_j"]]), return_inverse=True)
        half = len(pdf)
        d = np.full((len(people), len(people)), np.inf)
        d[inverse[:half], inverse[half:]] = d[inverse[half:], inverse[:half]] = 1 - pdf["r"].fillna(0.0).to_numpy()
        np.fill_diagonal(d, np.inf)
        placed = people[complete_linkage(d)]
        return pd.DataFrame({"study_id": pdf["study_id"].iloc[0], "p_idx": placed, "place": np.arange(1, len(placed) + 1)})

    return corr.groupBy("study_id").applyInPandas(order, "study_id string, p_idx int, place int")


def complete_linkage(d) -> list[int]:
    """Leaves of the complete-linkage tree of distances ``d`` (inf on the diagonal, overwritten), the tighter branch of each join first: lone leaves before branches, at equal heights the branch made first, of two leaves the first one."""
    import numpy as np

    n = len(d)
    near, dist = d.argmin(axis=1), d.min(axis=1)
    leaves, made = {i: [i] for i in range(n)}, [(-np.inf, i) for i in range(n)]
    for step in range(n - 1):
        i = int(dist.argmin())
        i, j = sorted((i, int(near[i])))
        height = dist[i]
        first, second = (i, j) if made[i] <= made[j] else (j, i)
        joined = leaves.pop(first) + leaves.pop(second)
        leaves[i], made[i] = joined, (height, n + step)
        d[i] = d[:, i] = np.maximum(d[i], d[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        dist[j] = np.inf
        for a in {i, *np.flatnonzero((near == i) | (near == j)).tolist()} & leaves.keys():
            near[a] = d[a].argmin()
            dist[a] = d[a, near[a]]
    return next(iter(leaves.values()))


def correlation_frame(corr: DataFrame) -> DataFrame:
    """All ordered pairs of participants with r and both places in the linkage order, the diagonal included."""
    at = linkage_order(corr)
    both = corr.select("study_id", "p_i", "p_j", "r").union(corr.select("study_id", "p_j", "p_i", "r")).union(at.select("study_id", "p_idx", "p_idx", F.lit(1.0)))
    x = at.select("study_id", F.col("p_idx").alias("p_i"), F.col("place").alias("row"))
    y = at.select("study_id", F.col("p_idx").alias("p_j"), F.col("place").alias("column"))
    return both.join(x, ["study_id", "p_i"]).join(y, ["study_id", "p_j"])


#: Kinds of figures and the function that makes each one's frame from the parts of an analysis.
FRAMES = {
    "loadings": lambda a: loadings_with_ci(a["flags"], a.get("loading_ci")),
    "scores": lambda a: scores_frame(a["scores"], a.get("n", 3)),
    "correlation": lambda a: correlation_frame(a["correlation"]),
    "arrays": lambda a: a["arrays"],
    "distinguishing": lambda a: listed_scores(a["scores"], a["distinguishing"]),
    "consensus": lambda a: listed_scores(a["scores"], a["statement_class"].where("category = 'Consensus'")),
    "scree": lambda a: scree_frame(a["eigenvalues"], a["people"]),
    "comparison": lambda a: comparison_frame(a["scores"]),
}


def frame(kind: str, parts: dict) -> DataFrame:
    """The frame of one kind of figure."""
    if kind not in FRAMES:
        raise ValueError(f"{kind}: one of {', '.join(FRAMES)}")
    return FRAMES[kind](parts)
