"""Priorities: ranked statements, tests against a neutral point and between groups, gates, concordance, labels.

Test statistics are windows and aggregations over ``(study_id, attribute,
stmt_num)``; only p-values that need an exact distribution, Hodges-Lehmann
intervals and permutations run in Python, one statement or one block of
participants at a time.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ranks import mid_rank, min_rank, tie_term, tied, with_bh
from .gram import _bytes, _dealt, _each, _sums
from .study import deck_neutral

STATEMENT = ["study_id", "stmt_num"]
#: Participants that a level needs to be compared.
MIN_LEVEL = 5


def ranked_table(sorts: DataFrame, deck: list[int]) -> DataFrame:
    """Statements by mean value: counts above, at and below the neutral point, rank, ties."""
    mu = F.lit(deck_neutral(deck))
    v = F.col("value")
    out = sorts.groupBy(*STATEMENT).agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.median(v).alias("median"),
        F.count_if(v > mu).alias("n_above"), F.count_if(v == mu).alias("n_at"), F.count_if(v < mu).alias("n_below"), F.count(v).alias("n"),
    )
    mean = F.round("mean", 12)
    return out.withColumn("rank", min_rank(mean, ["study_id"])).withColumn("tied", tied(mean, ["study_id"]))


# --- against the neutral point --------------------------------------------------------------------


def neutral_statistics(sorts: DataFrame, deck: list[int]) -> DataFrame:
    """Signed ranks with Pratt's zeros: T+, T-, z and rank-biserial correlation of each statement."""
    d = F.col("value") - F.lit(deck_neutral(deck))
    # the distance is rounded so that equal ones tie whatever the neutral point's last bit
    ranked = sorts.where("value is not null").withColumn("d", F.round(d, 9)).withColumn("a", F.abs("d"))
    ranked = ranked.withColumn("r", mid_rank(F.col("a"), STATEMENT))
    plus, minus = F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0))
    squares = F.sum(F.when(F.col("d") != 0, F.col("r") * F.col("r")).otherwise(0.0))
    out = ranked.groupBy(*STATEMENT).agg(F.count_if(F.col("d") != 0).alias("n_nonzero"), plus.alias("t_plus"), minus.alias("t_minus"), squares.alias("squares"))
    total = F.col("t_plus") + F.col("t_minus")
    return out.select(*STATEMENT, "n_nonzero", "t_plus", "t_minus", F.when(F.col("squares") > 0, (F.col("t_plus") - total / 2) / F.sqrt(F.col("squares") / 4)).alias("z"), F.when(total > 0, (F.col("t_plus") - F.col("t_minus")) / total).alias("rank_biserial"))


def neutral_tests(sorts: DataFrame, deck: list[int], q: float = 0.05) -> DataFrame:
    """Exact or asymptotic p, Hodges-Lehmann estimate and interval, BH over the study's statements, and the label."""
    mu = deck_neutral(deck)

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["value"].to_numpy(float)
        t = stats.signed_rank(x, mu)
        est, lo, hi = stats.hodges_lehmann_one(x)
        return pd.DataFrame([{"study_id": pdf["study_id"].iloc[0], "stmt_num": pdf["stmt_num"].iloc[0], "p": t["p"], "exact": t["exact"], "rank_biserial": t["rank_biserial"], "hl": est, "hl_low": lo, "hl_high": hi}])

    tests = sorts.groupBy(*STATEMENT).applyInPandas(test, "study_id string, stmt_num int, p double, exact boolean, rank_biserial double, hl double, hl_low double, hl_high double")
    tests = with_bh(tests.withColumn("p", F.when(~F.isnan("p"), F.col("p"))), "p", ["study_id"])
    flagged = F.coalesce(F.col("p_adj") <= q, F.lit(False))
    label = F.when(F.col("p").isNull(), "Not testable (no variation)").when(flagged & (F.col("rank_biserial") > 0), "Prioritized").when(flagged & (F.col("rank_biserial") < 0), "Deprioritized").otherwise("No evidence")
    return tests.withColumn("flagged", flagged).withColumn("label", label)


# --- groups ---------------------------------------------------------------------------------------


def usable_levels(groups: DataFrame, min_n: int = MIN_LEVEL) -> DataFrame:
    """``groups(study_id, participant, attribute, level)`` without null levels and those of fewer than ``min_n``; nothing of attributes left with under two."""
    n = groups.where("level is not null").withColumn("level_n", F.count("*").over(Window.partitionBy("study_id", "attribute", "level"))).where(F.col("level_n") >= min_n)
    one = Window.partitionBy("study_id", "attribute")
    return n.withColumn("_lo", F.min("level").over(one)).withColumn("_hi", F.max("level").over(one)).where("_lo <> _hi").drop("_lo", "_hi")


def level_notes(groups: DataFrame, min_n: int = MIN_LEVEL) -> DataFrame:
    """Why levels were left out."""
    n = groups.where("level is not null").groupBy("study_id", "attribute", "level").agg(F.count("*").alias("n")).where(F.col("n") < min_n)
    return n.withColumn("note", F.format_string("level '%s' not compared, n = %d", "level", "n"))


def _grouped(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    return sorts.where("value is not null").join(groups, ["study_id", "participant"])


BY = ["study_id", "attribute", "stmt_num"]


def mann_whitney(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """Attributes of two levels: z (ties corrected) and probability that the first level, by name, ranks above the second."""
    g = _grouped(sorts, groups).withColumn("r", mid_rank(F.col("value"), BY)).withColumn("first", F.min("level").over(Window.partitionBy("study_id", "attribute")))
    mine = F.col("level") == F.col("first")
    s = g.groupBy(*BY).agg(F.min("level").alias("level_a"), F.max("level").alias("level_b"), F.count_if(mine).cast("double").alias("n1"), F.count_if(~mine).cast("double").alias("n2"), F.sum(F.when(mine, F.col("r")).otherwise(0.0)).alias("w"), F.sum(F.col("r") * F.col("r")).alias("rr"))
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("n1") + F.col("n2")
    var = n1 * n2 / n * (F.col("rr") - n * (n + 1) / 2 * (n + 1) / 2) / (n - 1)
    ps = (F.col("w") - n1 * (n1 + 1) / 2) / (n1 * n2)
    return s.select(*BY, "level_a", "level_b", F.when(var > 1e-12, (F.col("w") - n1 * (n + 1) / 2) / F.sqrt(var)).alias("z"), ps.alias("ps"), F.when(ps > 0.5, F.col("level_a")).when(ps < 0.5, F.col("level_b")).alias("winner"))


def kruskal_wallis(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """Tie-corrected H, degrees of freedom and ε² = H / (n - 1)."""
    g = _grouped(sorts, groups).withColumn("r", mid_rank(F.col("value"), BY)).withColumn("t", tie_term(F.col("value"), BY))
    per = g.groupBy(*BY, "level").agg(F.sum("r").alias("sr"), F.count("*").cast("double").alias("n"), F.sum("t").alias("t"))
    s = per.groupBy(*BY).agg(F.sum(F.col("sr") * F.col("sr") / F.col("n")).alias("s"), F.sum("n").alias("n"), F.sum("t").alias("t"), (F.count("*") - 1).alias("df"))
    n = F.col("n")
    h = (12 / (n * (n + 1)) * F.col("s") - 3 * (n + 1)) / (1 - F.col("t") / (n * n * n - n))
    return s.select(*BY, F.when(F.col("t") < n * n * n - n, h).alias("h"), "df", F.when(F.col("t") < n * n * n - n, h / (n - 1)).alias("eps2"))


def dunn(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """z of each pair of levels from joint mid-ranks, with the tie-corrected variance."""
    g = _grouped(sorts, groups).withColumn("r", mid_rank(F.col("value"), BY)).withColumn("t", tie_term(F.col("value"), BY))
    per = g.groupBy(*BY, "level").agg(F.avg("r").alias("m"), F.count("*").cast("double").alias("k"), F.sum("t").alias("t"))
    one = Window.partitionBy(*BY)
    per = per.withColumn("n", F.sum("k").over(one)).withColumn("tt", F.sum("t").over(one))
    a = per.select(*BY, F.col("level").alias("level_a"), F.col("m").alias("ma"), F.col("k").alias("ka"), "n", "tt")
    b = per.select(*BY, F.col("level").alias("level_b"), F.col("m").alias("mb"), F.col("k").alias("kb"))
    n = F.col("n")
    var = (n * (n + 1) / 12 - F.col("tt") / (12 * (n - 1))) * (1 / F.col("ka") + 1 / F.col("kb"))
    return a.join(b, BY).where("level_a < level_b").select(*BY, "level_a", "level_b", F.when(var > 1e-12, (F.col("ma") - F.col("mb")) / F.sqrt(var)).alias("z"))


def dunn_top(contrasts: DataFrame) -> DataFrame:
    """The strongest contrast of each statement and the level that is higher in it; of equally strong ones the first by name."""
    best = contrasts.where("z is not null").groupBy(*BY).agg(F.min_by(F.struct("level_a", "level_b", "z"), F.struct(-F.abs("z"), "level_a", "level_b")).alias("b"))
    return best.select(*BY, "b.level_a", "b.level_b", "b.z", F.when(F.col("b.z") > 0, F.col("b.level_a")).otherwise(F.col("b.level_b")).alias("winner"))


def _corr(x: str, y: str) -> Column:
    n = F.count(x).cast("double")
    vx, vy = n * F.sum(F.col(x) * F.col(x)) - F.sum(x) * F.sum(x), n * F.sum(F.col(y) * F.col(y)) - F.sum(y) * F.sum(y)
    return F.when((vx > 0) & (vy > 0), (n * F.sum(F.col(x) * F.col(y)) - F.sum(x) * F.sum(y)) / F.sqrt(vx * vy))


def linear_by_linear(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """Ordinal attributes, levels ordered by name: z = r(level index, value) √(n - 1), and the direction."""
    g = _grouped(sorts, groups).withColumn("i", F.dense_rank().over(Window.partitionBy("study_id", "attribute").orderBy("level")).cast("double"))
    s = g.groupBy(*BY).agg(_corr("i", "value").alias("r"), F.count("*").alias("n"))
    z = F.col("r") * F.sqrt(F.col("n") - 1)
    return s.select(*BY, "r", z.alias("z"), F.when(z > 0, "rises").when(z < 0, "falls").alias("direction"))


def spearman_numeric(sorts: DataFrame, numbers: DataFrame) -> DataFrame:
    """``numbers(study_id, participant, attribute, num)``: ρ of each statement with a numeric attribute, at least five participants."""
    g = _grouped(sorts, numbers.where("num is not null")).withColumn("rx", mid_rank(F.col("num"), BY)).withColumn("ry", mid_rank(F.col("value"), BY))
    return g.groupBy(*BY).agg(_corr("rx", "ry").alias("rho"), F.count("*").alias("n")).where("n >= 5")


# --- gates ----------------------------------------------------------------------------------------


def permanova(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    """Euclidean F and R² of each attribute, from centroids: no distances between pairs are formed."""
    g = _grouped(sorts, groups)
    cells = g.groupBy("study_id", "attribute", "level", "stmt_num").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("ss"), F.count("*").cast("double").alias("n"))
    within = cells.groupBy("study_id", "attribute", "stmt_num").agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("ssw"), (F.sum("ss") - F.sum("s") * F.sum("s") / F.sum("n")).alias("sst"), F.sum("n").alias("n"), F.count("*").alias("k"))
    t = within.groupBy("study_id", "attribute").agg(F.sum("ssw").alias("ssw"), F.sum("sst").alias("sst"), F.max("n").alias("n"), F.max("k").alias("k"))
    f = ((F.col("sst") - F.col("ssw")) / (F.col("k") - 1)) / (F.col("ssw") / (F.col("n") - F.col("k")))
    return t.select("study_id", "attribute", F.when(F.col("sst") > 0, f).alias("f"), F.when(F.col("sst") > 0, 1 - F.col("ssw") / F.col("sst")).alias("r2"), F.col("n").cast("long").alias("n"), F.col("k").cast("long").alias("levels"))


def median_split(numbers: DataFrame) -> DataFrame:
    """Levels low (up to the median) and high of a numeric attribute, for the gate."""
    med = F.median("num").over(Window.partitionBy("study_id", "attribute"))
    return numbers.where("num is not null").select("study_id", "participant", "attribute", F.when(F.col("num") <= med, "low").otherwise("high").alias("level"))


def permuted_levels(counts: np.ndarray, sizes: np.ndarray, at: int, seed: int, b: int, own: int) -> np.ndarray:
    """(own x levels): how many of each level's ``counts`` each of ``own`` permutations of batch ``b`` puts into block ``at`` of blocks with ``sizes`` participants.

    Blocks are halved again and again; the left half's share is a multivariate hypergeometric draw of its own seed, level by level for the whole batch, so a block finds its share without the others.
    """
    left = np.tile(np.asarray(counts, np.int64), (own, 1))
    lo, hi = 0, len(sizes)
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, b, lo, hi])
        take, rest, share = np.full(own, sizes[lo:mid].sum(), np.int64), left.sum(axis=1), np.zeros_like(left)
        for c in range(left.shape[1]):
            rest = rest - left[:, c]
            share[:, c] = rng.hypergeometric(left[:, c], rest, take)
            take = take - share[:, c]
        if at < mid:
            left, hi = share, mid
        else:
            left, lo = left - share, mid
    return left


def permuted_codes(codes: np.ndarray, counts: np.ndarray, sizes: np.ndarray, at: int, seed: int, b: int, own: int) -> np.ndarray:
    """(own x participants of the block): the levels that the permutations of batch ``b`` give them."""
    if len(sizes) == 1:
        rng = np.random.default_rng([seed, b])
        return np.stack([rng.permutation(codes) for _ in range(own)])
    ends = permuted_levels(counts, sizes, at, seed, b, own).cumsum(axis=1)
    out = np.zeros((own, len(codes)), np.int16)
    for c in range(len(counts) - 1):
        out += np.arange(len(codes)) >= ends[:, c : c + 1]
    return np.random.default_rng([seed, b, at, at]).permuted(out, axis=1)


#: Participants of a block of a permutation test.
PERMUTED = 16_384


def permanova_test(sorts: DataFrame, groups: DataFrame, permutations: int = 9999, seed: int = 1, batch: int = 500) -> DataFrame:
    """p of the PERMANOVA gate. A permutation deals the levels to blocks of participants and shuffles them there, seeded by (seed, batch, block).

    F needs no more of a permutation than each level's sums over its participants, so a task has one block,
    and what is sent are sums that grow with the blocks; no task holds a study of more than ``PERMUTED`` participants.
    """
    by = ["study_id", "attribute"]
    wide = _grouped(sorts, groups).groupBy(*by, "participant", "level").agg(F.transform(F.array_sort(F.collect_list(F.struct("stmt_num", "value"))), lambda s: s["value"].cast("double")).alias("v")).persist()
    levels = wide.groupBy(*by, "level").agg(F.count("*").alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("level", "c"))).alias("z"))
    levels = levels.select(*by, F.transform("z", lambda z: z["level"]).alias("names"), F.transform("z", lambda z: z["c"]).alias("counts"))
    n_blocks = F.ceil(F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c) / PERMUTED)
    placed = wide.join(F.broadcast(levels), by).withColumn("at", F.pmod(F.xxhash64("participant"), n_blocks).cast("int")).withColumn("code", F.array_position("names", F.col("level")) - 1)
    block = placed.groupBy(*by, "counts", "at").agg(F.array_sort(F.collect_list(F.struct("participant", "code", "v"))).alias("c"))
    sizes = placed.groupBy(*by, "at").agg(F.count("*").alias("m")).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("at", "m"))).alias("b"))
    block = block.join(F.broadcast(sizes), by).select(*by, "counts", F.transform("b", lambda b: b["m"]).alias("sizes"), (F.array_position(F.transform("b", lambda b: b["at"]), F.col("at")) - 1).cast("int").alias("at"), F.transform("c", lambda c: c["code"]).alias("code"), F.flatten(F.transform("c", lambda c: c["v"])).alias("v"))

    def add(parts):
        for pdf in parts:
            for row in pdf.itertuples(index=False):
                codes, counts, sizes = (np.asarray(x, np.int64) for x in (row.code, row.counts, row.sizes))
                x, k = np.asarray(row.v, float).reshape(len(codes), -1), len(counts)
                total, squares = x.sum(axis=0), (x * x).sum()
                level = lambda drawn: np.stack([(drawn == c).astype(float) @ x for c in range(k)], axis=1)
                observed = level(codes[None])
                for b in range(-(-permutations // batch)):
                    own = min(batch, permutations - b * batch)
                    sums = level(permuted_codes(codes, counts, sizes, row.at, seed, b, own))
                    flat = np.concatenate([observed.ravel(), sums.ravel(), total, [squares]])
                    yield pd.DataFrame({"study_id": [row.study_id], "attribute": [row.attribute], "batch": [b], "part": [_bytes(flat)]})

    def compare(row):
        counts = np.asarray(row.counts, float)
        n, k = counts.sum(), len(counts)
        flat = np.frombuffer(row.part, np.float64)
        own = min(batch, permutations - row.batch * batch)
        j = (len(flat) - 1) // ((own + 1) * k + 1)
        mean = flat[-1 - j : -1] / n
        sums = flat[: -1 - j].reshape(own + 1, k, j) - counts[:, None] * mean
        sst = flat[-1] - n * (mean @ mean)
        ssw = sst - (sums * sums / counts[:, None]).sum(axis=(1, 2))
        f = np.divide((sst - ssw) / (k - 1), ssw / (n - k) if n > k else 0.0, out=np.full(own + 1, np.inf), where=(ssw > 1e-12 * sst) & (n > k))
        return row.study_id, row.attribute, int((f[1:] >= f[0] * (1 - 1e-12)).sum()), own

    parts = _dealt(block, *by, "at").mapInPandas(add, "study_id string, attribute string, batch int, part binary")
    counts = _each(_sums(parts, [*by, "batch"]).join(F.broadcast(levels.select(*by, "counts")), by), compare, "study_id string, attribute string, more long, done long")
    p = counts.groupBy("study_id", "attribute").agg(((F.sum("more") + 1) / (F.sum("done") + 1)).alias("p"), F.sum("done").alias("permutations"))
    return permanova(sorts, groups).join(p, ["study_id", "attribute"]).withColumn("passed", F.col("p") <= 0.05)


# --- tests with p-values and labels ---------------------------------------------------------------


def group_tests(sorts: DataFrame, groups: DataFrame, gates: DataFrame, ordinal: list[str] = (), q: float = 0.05) -> DataFrame:
    """``comparisons.compare_groups`` with the shift of two levels as ``hl``, ``hl_low``, ``hl_high``: the same tests, draws, contrasts and labels."""
    from .comparisons import compare_groups

    return compare_groups(sorts, groups, gates, ordinal, q).withColumnsRenamed({"hl_shift": "hl", "hl_lower": "hl_low", "hl_upper": "hl_high"})


# --- concordance and rankings ---------------------------------------------------------------------


def w_band(w: Column) -> Column:
    return F.when(w < 0.1, "very weak").when(w < 0.3, "weak").when(w < 0.5, "moderate").when(w.isNotNull(), "strong")


def kendall_w(sorts: DataFrame, by: list[str] = ("study_id",)) -> DataFrame:
    """Kendall's W over complete sorts with ties, χ² and its band; ``by`` may add a level column of ``sorts``."""
    by = list(by)
    person = [*by, "participant"]
    full = Window.partitionBy(*by)
    s = sorts.withColumn("_filled", F.count("value").over(Window.partitionBy(*person))).withColumn("_j", F.max("stmt_num").over(full)).where("_filled = _j")
    r = s.withColumn("r", mid_rank(F.col("value"), person)).withColumn("t", tie_term(F.col("value"), person))
    stmt = r.groupBy(*by, "stmt_num").agg(F.sum("r").alias("rj"), F.count("*").cast("double").alias("m"), F.sum("t").alias("t"))
    tot = stmt.groupBy(*by).agg((F.sum(F.col("rj") * F.col("rj")) - F.sum("rj") * F.sum("rj") / F.count("*")).alias("s"), F.max("m").alias("m"), F.count("*").cast("double").alias("j"), F.sum("t").alias("t"))
    m, j = F.col("m"), F.col("j")
    den = m * m * (j * j * j - j) - m * F.col("t")
    w = F.when((m >= 2) & (den > 0), 12 * F.col("s") / den)
    return tot.select(*by, w.alias("w"), (m * (j - 1) * w).alias("chi2"), (j - 1).cast("long").alias("df"), m.cast("long").alias("m"), w_band(w).alias("band"))


def level_means(sorts: DataFrame, groups: DataFrame) -> DataFrame:
    return _grouped(sorts, groups).groupBy("study_id", "attribute", "level", "stmt_num").agg(F.avg("value").alias("mean"))


def top_n(sorts: DataFrame, groups: DataFrame, n: int = 5, bottom: bool = False) -> DataFrame:
    """The first ``n`` statements of every level, small levels too; ``tied``: equal to a neighbour or to what was just left out."""
    by = Window.partitionBy("study_id", "attribute", "level")
    means = level_means(sorts, groups.where("level is not null")).withColumn("m", F.round("mean", 12))
    place = F.row_number().over(by.orderBy(F.col("m").asc() if bottom else F.col("m").desc(), "stmt_num"))
    out = means.withColumn("place", place).withColumn("tied", F.count("*").over(Window.partitionBy("study_id", "attribute", "level", "m")) > 1)
    return out.where(F.col("place") <= n).select("study_id", "attribute", "level", "place", "stmt_num", "mean", "tied")


def group_rankings(sorts: DataFrame, groups: DataFrame, deck: list[int]) -> DataFrame:
    """Each level's own rank of each statement beside the overall one."""
    by = ["study_id", "attribute", "level"]
    own = level_means(sorts, groups).withColumn("level_rank", min_rank(F.round("mean", 12), by))
    overall = ranked_table(sorts, deck).select("study_id", "stmt_num", F.col("rank").alias("overall_rank"))
    return own.join(overall, ["study_id", "stmt_num"]).select(*by, "stmt_num", "level_rank", "overall_rank", (F.col("level_rank") - F.col("overall_rank")).alias("shift"))


def rank_flow(rankings: DataFrame) -> DataFrame:
    """(level key, rank, statement) for a flow chart; the attribute is put before a level name that another attribute has too."""
    names = rankings.select("study_id", "attribute", "level").distinct()
    many = names.groupBy("study_id", "level").agg((F.count("*") > 1).alias("many"))
    key = F.when(F.col("many"), F.concat_ws(": ", "attribute", "level")).otherwise(F.col("level"))
    return rankings.join(many, ["study_id", "level"]).select("study_id", key.alias("level_key"), "level_rank", "stmt_num")


def verdict(neutral: DataFrame, tests: DataFrame, w: DataFrame) -> DataFrame:
    """One row a study: statements off neutral, statements that differ by group, and the strength of agreement."""
    a = neutral.groupBy("study_id").agg(F.count("*").alias("n_statements"), F.count_if("flagged").alias("n_departures"))
    b = tests.groupBy("study_id").agg(F.count_if("flagged").alias("n_differences"), F.count_distinct(F.when(F.col("flagged"), F.col("attribute"))).alias("n_attributes"))
    return a.join(b, "study_id", "left").join(w.select("study_id", "w", "band"), "study_id", "left").fillna(0, ["n_differences", "n_attributes"])
