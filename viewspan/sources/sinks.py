"""Result tables as folders of Parquet or CSV, sessions, and small workbooks."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import correlation as C
from ..operators import extraction as X
from ..operators import factors as V
from .xlsx import write_workbook


def overview(sorts: DataFrame, flags: DataFrame, extraction: str = "pca", rotation: str = "varimax", correlation: str = "pearson", p: float = 0.05, majority: bool = True, exported: str | None = None) -> DataFrame:
    """What each study is and how it was analysed: ``(study_id, place, item, value)``; ``exported`` is the time now unless stated."""
    size = sorts.groupBy("study_id").agg(F.count_distinct("stmt_num").alias("j"), F.count_distinct("participant").alias("n")).join(flags.groupBy("study_id").agg(F.count_distinct("factor").alias("k")), "study_id")
    flagging = f"auto at p < {p:.2f}" + (", majority of common variance" if majority else "")
    when = F.lit(exported) if exported else F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm")
    items = {"Project": F.col("study_id"), "Statements": F.col("j"), "Sorts": F.col("n"), "Factors": F.col("k"), "Extraction": F.lit(extraction), "Rotation": F.lit(rotation), "Correlation": F.lit(correlation), "Flagging": F.lit(flagging), "Exported": when}
    rows = F.array(*[F.struct(F.lit(name).alias("item"), value.cast("string").alias("value")) for name, value in items.items()])
    return size.select("study_id", F.posexplode(rows).alias("at", "row")).select("study_id", (F.col("at") + 1).alias("place"), "row.item", "row.value")


def factor_tables(sorts: DataFrame, flags: DataFrame, deck: list[int], statements: DataFrame | None = None, factors: int | None = None, extraction: str = "pca", **about) -> dict[str, DataFrame]:
    """The tables of a factor solution by the names of a workbook's sheets, in their order; factors are rows, so there is one table of each kind.

    ``about``: the other settings of ``overview``. ``factors``: how many were retained, counted in ``flags`` unless stated.
    """
    wide = X.unrotated_wide(sorts, factors or flags.agg(F.max("factor")).first()[0], extraction)
    corr = C.pearson(sorts)
    scores = V.factor_scores(sorts, flags, deck)
    chars = V.characteristics(flags)
    sed = V.sed_matrix(chars)
    pairs = V.pairwise(scores, sed)
    out = {"Overview": overview(sorts, flags, extraction, **about)} | ({"Statements": statements} if statements is not None else {})
    return out | {
        "Q sorts": sorts,
        "Correlations": corr,
        "Unrotated loadings": wide.drop("cumulative_h2"),
        "Cumulative communalities": wide.drop("loading"),
        "Loadings": flags.join(V.communalities(flags), V.PERSON),
        "Loadings by factor": V.loading_order(flags),
        "Sort descriptives": C.sort_descriptives(sorts),
        "Score ranks": scores,
        "Score correlations": V.score_correlations(scores),
        "Factor weights": V.factor_weights(flags),
        "Defining correlations": V.defining_correlations(sorts, flags),
        "Differences": pairs,
        "Consensus vs disagreement": V.statement_class(scores, pairs),
        "Factor characteristics": chars,
        "Standard errors of differences": sed,
        "Distinguishing": V.distinguishing(pairs),
        "Consensus statements": V.statement_class(scores, pairs).where(F.col("category") == "Consensus"),
        "Relative rankings": V.crib_sheet(scores),
    }


def write_tables(tables: dict[str, DataFrame], path: str, kind: str = "parquet") -> None:
    """One folder a table, written by all tasks."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        target = f"{path}/{name.replace(' ', '_').lower()}"
        w.parquet(target) if kind == "parquet" else w.option("header", True).csv(target)


def workbook(tables: dict[str, DataFrame], most_rows: int = 50_000) -> bytes:
    """A workbook of tables that a person can read; a table of over ``most_rows`` rows is refused, not cut."""
    sheets = {}
    for name, df in tables.items():
        rows = df.limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"{name} has over {most_rows} rows: write it as a table")
        sheets[name] = [df.columns, *[list(r) for r in rows]]
    return write_workbook(sheets)


def save_session(tables: dict[str, DataFrame], path: str, **settings) -> None:
    """Tables and a manifest from which ``load_session`` restores them."""
    write_tables(tables, path)
    spark = next(iter(tables.values())).sparkSession
    manifest = json.dumps({"tables": list(tables), "settings": settings})
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")


def load_session(spark: SparkSession, path: str) -> tuple[dict[str, DataFrame], dict]:
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    return {n: spark.read.parquet(f"{path}/{n.replace(' ', '_').lower()}") for n in manifest["tables"]}, manifest["settings"]


def priorities_tables(ranked: DataFrame, tests: DataFrame | None = None, top: DataFrame | None = None, attributes: DataFrame | None = None, figures: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables of a priorities workbook by sheet; group comparisons only where there are tests, and one sheet for each figure's data."""
    out = {"Ranked": ranked}
    for name, df in (("Group comparisons", tests), ("Top by group", top), ("Attributes", attributes)):
        if df is not None:
            out[name] = df
    return out | {f"Figure {k}": v for k, v in (figures or {}).items()}


def bayesian_tables(draws: DataFrame, k: int, sorts: DataFrame, deck: list[int], q: float = 0.05, ladder: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a posterior at ``k`` factors by sheet: twelve where a ladder was fitted, else eleven."""
    from ..operators import bayes as B

    own = draws.where(F.col("k") == k)
    flags = B.to_flags(draws, k, sorts, q)
    scores = V.factor_scores(sorts, flags, deck)
    chars = V.characteristics(flags)
    pairs = V.pairwise(scores, V.sed_matrix(chars))
    claims = B.flag_claims(own, q).withColumn("claim", F.lit("flag")).unionByName(B.distinguishing_claims(own, q).withColumn("claim", F.lit("distinguishing"))).unionByName(B.consensus_claims(own, q).withColumn("claim", F.lit("consensus")))
    overview = sorts.groupBy("study_id").agg(F.count_distinct("participant").alias("participants"), F.count_distinct("stmt_num").alias("statements")).withColumns({"factors": F.lit(k), "q": F.lit(q)})
    out = {
        "Overview": overview,
        "Loadings & Flags": flags.join(B.summary(own, "loading").select("study_id", F.col("item").alias("p_idx"), "factor", "sd", "low", "high"), ["study_id", "p_idx", "factor"], "left"),
        "Statement Scores": B.summary(own, "zscore"),
        "Factor Arrays": V.factor_array(scores),
        "Distinguishing": B.distinguishing_claims(own, q).where("claimed"),
        "Consensus": B.consensus_claims(own, q).where("claimed"),
        "Contrasts": pairs,
        "Claims": claims,
        "Characteristics": chars,
        "Diagnostics": B.convergence(own),
        "Person Check": B.person_check(sorts, flags, scores),
    }
    return out | ({"Choice of K": ladder} if ladder is not None else {})
