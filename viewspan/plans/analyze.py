"""Whole analyses: the steps of a study put together, as named DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import extraction as X
from ..operators import factors as V
from ..operators import priorities as R


def solution(sorts: DataFrame, flags: DataFrame, deck: list[int], criterion: str = "all", av_rel: float = 0.8) -> dict[str, DataFrame]:
    """All that follows from flagged loadings: scores, characteristics, standard errors, differences, classes."""
    scores = V.factor_scores(sorts, flags, deck)
    chars = V.characteristics(flags, av_rel)
    sed = V.sed_matrix(chars)
    pairs = V.pairwise(scores, sed)
    return {
        "flags": flags,
        "weights": V.factor_weights(flags),
        "scores": scores,
        "characteristics": chars,
        "sed": sed,
        "pairwise": pairs,
        "statement_class": V.statement_class(scores, pairs),
        "distinguishing": V.distinguishing(pairs, criterion),
        "crib_sheet": V.crib_sheet(scores),
        "arrays": V.factor_array(scores),
    }


def analyze(
    sorts: DataFrame,
    deck: list[int],
    factors: int | None = None,
    extraction: str = "pca",
    rotation: str = "varimax",
    flagging: str = "auto",
    p: float = 0.05,
    majority: bool = True,
    threshold: float | None = None,
    correlation: str = "pearson",
    criterion: str = "all",
    av_rel: float = 0.8,
) -> dict[str, DataFrame]:
    """The classical query: correlate, extract, rotate, flag, score, characterise, distinguish.

    ``flagging``: auto, theoretical (``threshold``, by default the critical loading) or manual.
    Without ``factors`` each study needs the same number by ``number_of_factors``. A study needs
    two participants at least, and no more factors than participants can be found.
    """
    statements = sum(deck)
    fewest = sorts.where("value is not null").groupBy("study_id").agg(F.count_distinct("p_idx").alias("n")).agg(F.min("n")).first()[0]
    if fewest is None or fewest < 2:
        raise ValueError("a study needs two participants at least")
    if factors is None:
        least, most = X.number_of_factors(sorts).agg(F.min("k"), F.max("k")).first()
        if least != most:
            raise ValueError(f"the studies need {least} to {most} factors; analyse them one by one or state a number")
        factors = min(most, fewest)
    if factors > fewest:
        raise ValueError(f"{factors} factors can't be found among {fewest} participants")
    if not 0 < p < 1 or factors < 1 or statements < 3:
        raise ValueError("p must lie between 0 and 1, with at least one factor and three statements")
    loadings = X.extract(sorts, factors, extraction, rotation)
    flags = {
        "auto": lambda: V.flag_auto(loadings, statements, p, majority),
        "theoretical": lambda: V.flag_theoretical(loadings, threshold if threshold is not None else V.critical(p) / statements**0.5),
        "manual": lambda: V.flag_manual(loadings),
    }[flagging]()
    return {"correlation": C.CORRELATIONS[correlation](sorts), "eigenvalues": X.eigenvalues(sorts), "loadings": loadings} | solution(sorts, flags, deck, criterion, av_rel)


def reanalyze_rotated(sorts: DataFrame, loadings: DataFrame, deck: list[int], f1: int, f2: int, degrees: float, p: float = 0.05) -> dict[str, DataFrame]:
    """A pair of factors turned by hand, then everything after it again."""
    turned = V.rotate_manual(loadings, f1, f2, degrees)
    return {"loadings": turned} | solution(sorts, V.flag_auto(turned, sum(deck), p), deck)


def recalculate_after_flagging(sorts: DataFrame, flags: DataFrame, edits: DataFrame, deck: list[int]) -> dict[str, DataFrame]:
    """``edits(study_id, participant, factor, flagged)`` replace automatic flags; the rest follows."""
    e = edits.select(*V.PERSON, "factor", F.col("flagged").alias("_edit"))
    return solution(sorts, flags.join(e, [*V.PERSON, "factor"], "left").withColumn("flagged", F.coalesce("_edit", "flagged")).drop("_edit"), deck)


def split_and_recalculate(sorts: DataFrame, loadings: DataFrame, deck: list[int], factor: int, p: float = 0.05) -> dict[str, DataFrame]:
    """A bipolar factor split in two, and all that depends on the loadings computed anew."""
    parts = V.split_bipolar(loadings, factor, 1.96 / sum(deck) ** 0.5)
    return {"loadings": parts} | solution(sorts, V.flag_auto(parts, sum(deck), p), deck)


def priorities(sorts: DataFrame, deck: list[int], groups: DataFrame | None = None, numbers: DataFrame | None = None, ordinal: tuple[str, ...] = (), q: float = 0.05, permutations: int = 9999, seed: int = 1) -> dict[str, DataFrame]:
    """The ranking query: table, tests against neutral, gates, group tests, concordance over all and by level.

    ``groups(study_id, participant, attribute, level)``; ``numbers(study_id,
    participant, attribute, num)`` join the gates as halves at their median.
    """
    if not 0 < q < 1 or permutations < 1:
        raise ValueError("q must lie between 0 and 1 and there must be a permutation")
    out = {"table": R.ranked_table(sorts, deck), "neutral": R.neutral_tests(sorts, deck, q), "concordance": R.kendall_w(sorts)}
    if groups is None and numbers is None:
        return out
    usable = R.usable_levels(groups) if groups is not None else None
    halves = R.median_split(numbers) if numbers is not None else None
    parts = [x.select("study_id", "participant", "attribute", "level") for x in (usable, halves) if x is not None]
    gates = R.permanova_test(sorts, parts[0] if len(parts) == 1 else parts[0].union(parts[1]), permutations, seed)
    out["gates"] = gates
    if usable is not None:
        out |= {
            "tests": R.group_tests(sorts, usable, gates, list(ordinal), q),
            "notes": R.level_notes(groups),
            "top": R.top_n(sorts, groups),
            "concordance_by_level": R.kendall_w(sorts.join(usable, ["study_id", "participant"]), ["study_id", "attribute", "level"]),
        }
    if numbers is not None:
        out["numeric"] = R.spearman_numeric(sorts, numbers)
    return out


def run_all(plans: dict[str, Callable[[], DataFrame]], path: str) -> None:
    """Writes each plan's result under ``path``."""
    for name, plan in plans.items():
        plan().write.mode("overwrite").parquet(f"{path}/{name}")
