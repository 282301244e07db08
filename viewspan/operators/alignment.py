"""Loadings of one solution turned to those of another, whoever took part in it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import linalg as L

TURNS = "study_id string, method string, source int, factor int, weight double"


def _curves(loadings: DataFrame, name: str) -> DataFrame:
    """``(study_id, name)``: of each factor in order its number and the quantiles of its loadings."""
    each = loadings.groupBy("study_id", "factor").agg(F.percentile("loading", F.array(*[F.lit(float(x)) for x in L.CURVE])).alias("curve"))
    return each.groupBy("study_id").agg(F.array_sort(F.collect_list(F.struct("factor", "curve"))).alias(name))


def turns(loadings: DataFrame, target: DataFrame) -> DataFrame:
    """``(study_id, method, source, factor, weight)``: how each study's ``loadings`` are mixed to be like ``target``.

    Both hold ``(study_id, participant, factor, loading)``. Method "names":
    Procrustes over the people both hold, where they are more than the factors.
    "curves": no such people, so factors are assigned, with signs, by their
    sorted loadings. "unaligned": another number of factors, or no target; they
    stay as they are. People without a loading on one side count on neither.

    A study is sent to the algebra as sums of products of two factors and 50
    quantiles of each factor, never as its people.
    """
    a = loadings.select("study_id", "participant", F.col("factor").alias("source"), F.col("loading").alias("x"))
    b = target.select("study_id", "participant", "factor", F.col("loading").alias("y"))
    sums = a.join(b, ["study_id", "participant"]).groupBy("study_id", "source", "factor").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.count(F.col("x") * F.col("y")).alias("people"))
    products = sums.groupBy("study_id").agg(F.min("people").alias("people"), F.collect_list(F.struct("source", "factor", "xy")).alias("products"))
    rows = _curves(loadings, "own").join(_curves(target, "other"), "study_id", "left").join(products, "study_id", "left")

    def solve(parts):
        for pdf in parts:
            out = []
            for row in pdf.itertuples(index=False):
                source, k = [x["factor"] for x in row.own], len(row.own)
                factor = source if row.other is None else [x["factor"] for x in row.other]
                if row.other is None or len(factor) != k:
                    method, factor, turn = "unaligned", source, np.eye(k)
                elif row.products is not None and len(row.products) == k * k and row.people > k:
                    at = {(x["factor"], x["source"]): x["xy"] for x in row.products}
                    u, _, vt = np.linalg.svd(np.array([[at[f, s] for s in source] for f in factor], float))
                    method, turn = "names", vt.T @ u.T
                else:
                    method, turn = "curves", L.curve_turn(*(np.array([list(x["curve"]) for x in side], float) for side in (row.other, row.own)))
                out.append(pd.DataFrame({"study_id": row.study_id, "method": method, "source": np.repeat(source, k), "factor": np.tile(factor, k), "weight": turn.ravel()}))
            if out:
                yield pd.concat(out)

    return rows.mapInPandas(solve, TURNS)


def align_loadings(loadings: DataFrame, target: DataFrame) -> DataFrame:
    """``(study_id, participant, factor, loading, method)``: ``loadings`` turned as ``turns`` says; a person with a null loading keeps nulls."""
    t = turns(loadings, target).where("weight <> 0")
    mixed = loadings.select("study_id", "participant", F.col("factor").alias("source"), "loading").join(t, ["study_id", "source"])
    unknown = F.count_if(F.col("loading").isNull()) > 0
    return mixed.groupBy("study_id", "participant", "factor").agg(F.when(~unknown, F.sum(F.col("loading") * F.col("weight"))).alias("loading"), F.first("method").alias("method"))
