"""Delimited files of sorts, statements and attributes, read by Spark and recognised by their header."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.study import unique_ids, wide_to_long

# Cells that mean "no value", headers of each layout.
NA = ["", "NA", "N/A", "."]
STATEMENT_COLUMN = re.compile(r"(?i)^s\d+$|^statement[_-]?\d+$")
ID_COLUMN = re.compile(r"(?i)^uid$|^id$|^participant")
NOT_STATEMENT = {"uid", "id", "record_id"}


def read_table(spark: SparkSession, path: str, sep: str = ",", skip: int = 0) -> DataFrame:
    """All columns as text, in file order; a byte-order mark is taken off the first name.

    ``skip`` lines before the header are left out; a file read that way holds
    no line breaks in its cells.
    """
    if skip:
        return _after(spark, path, sep, skip)
    df = spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def _after(spark: SparkSession, path: str, sep: str, skip: int) -> DataFrame:
    lines = row_numbers(spark.read.text(path), "_line")
    header = lines.where(F.col("_line") == skip).first()
    if header is None:
        raise ValueError(f"{path}: no header after {skip} lines")
    options = {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    first = header["value"].lstrip("\ufeff")
    parts = lambda line, names: F.from_csv(line, ", ".join(f"{n} string" for n in names), options)
    width = first.count(sep) + 1  # at most: a quoted cell may hold the separator
    names = [x.strip() for x in spark.range(1).select(parts(F.lit(first), [f"c{k}" for k in range(width)]).alias("h")).first()["h"] if x is not None]
    cells = [f"c{k}" for k in range(len(names))]
    body = lines.where((F.col("_line") > skip) & (F.trim("value") != "")).select(parts(F.col("value"), cells).alias("cells"))
    return body.select("cells.*").toDF(*names)


def observed(df: DataFrame, cells: dict[str, Column], lost: Observation | None) -> DataFrame:
    """``df`` that counts for ``lost``, in the pass that reads it, the cells that are filled (``filled``) and of these the ones that don't read as numbers, in all (``lost``) and by name (``lost in <name>``)."""
    if lost is None:
        return df
    bad = {n: F.count_if(c.isNotNull() & c.try_cast("double").isNull()) for n, c in cells.items()}
    filled = sum((F.count(c) for c in cells.values()), F.lit(0))
    return df.observe(lost, filled.alias("filled"), sum(bad.values(), F.lit(0)).alias("lost"), *[b.alias(f"lost in {n}") for n, b in bad.items()])


def row_numbers(df: DataFrame, name: str = "_order") -> DataFrame:
    """``df`` with rows numbered from 0 in file order, however many partitions the file has.

    Partitions are counted first; the count of those before is added to each
    row's place in its own, so no row moves.
    """
    part, at = f"{name}_part", f"{name}_at"
    placed = df.withColumn(at, F.monotonically_increasing_id()).withColumn(part, F.shiftrightunsigned(at, 33))
    before, total = {}, 0
    for r in placed.groupBy(part).agg(F.count("*").alias("n")).orderBy(part).collect():  # one row a partition
        before[r[0]], total = total, total + r["n"]
    starts = F.create_map(*[F.lit(x) for kv in (before or {0: 0}).items() for x in kv])
    return placed.withColumn(name, F.col(at).bitwiseAND((1 << 33) - 1) + starts[F.col(part)]).drop(part, at)


def cleaned(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.col(f"`{c}`").isin(*NA), F.col(f"`{c}`")).alias(c) for c in df.columns])


def layout(columns: list[str]) -> str:
    """htmlq, flashq, transposed, long or wide, by the names of the columns."""
    low = [c.lower() for c in columns]
    if "uid" in low and ("datetime" in low or "timestamp" in low):
        return "htmlq"
    if "id" in low and "time" in low:
        return "flashq"
    if sum(bool(re.fullmatch(r"s\d+", c)) for c in low) >= 2:
        return "htmlq"
    if sum(bool(re.fullmatch(r"qsort\d+", c)) for c in low) >= 2 and any(c.startswith("statement") for c in low):
        return "transposed"
    if {"participant", "statement", "value"} <= set(low):
        return "long"
    return "wide"


def numeric_columns(df: DataFrame, names: list[str]) -> list[str]:
    """The columns whose filled cells all read as numbers: one aggregation over the file."""
    if not names:
        return []
    bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(f"b{k}") for k, c in enumerate(names)], *[F.count(F.col(f"`{c}`")).alias(f"n{k}") for k, c in enumerate(names)]).first()
    return [c for k, c in enumerate(names) if bad[f"b{k}"] == 0 and bad[f"n{k}"] > 0]


def read_sorts(spark: SparkSession, path: str, study_id: str | None = None, id_col: str | None = None, sep: str = ",", skip: int = 0, lost: Observation | None = None) -> DataFrame:
    """Long sorts of a delimited file of any layout; ids are kept, missing ones are P1, P2, ...

    ``skip`` lines come before the header. Cells that don't read as numbers are
    null; ``lost`` counts them as the result is read (see ``observed``).
    """
    df = row_numbers(cleaned(read_table(spark, path, sep, skip)))
    columns = [c for c in df.columns if c != "_order"]
    kind = layout(columns)
    study = study_id or re.sub(r"\.[^.]*$", "", path.rstrip("/").split("/")[-1])
    df = df.withColumn("study_id", F.lit(study))
    if kind == "long":
        names = {c.lower(): c for c in columns}
        df = observed(df, {names["value"]: F.col(f"`{names['value']}`")}, lost)
        return _numbered(df.select("study_id", F.col(names["participant"]).alias("participant"), F.col(names["statement"]).alias("_s"), F.expr(f"try_cast(`{names['value']}` as double)").alias("value")))
    if kind == "transposed":
        people = [c for c in columns if re.fullmatch(r"(?i)qsort\d+", c)]
        rows = observed(df, {c: F.col(f"`{c}`") for c in people}, lost).withColumn("_s", F.col("_order").cast("string"))
        long = rows.unpivot(["study_id", "_order"], people, "participant", "v")
        return _numbered(long.select("study_id", "participant", F.lpad(F.col("_order").cast("string"), 20, "0").alias("_s"), F.expr("try_cast(v as double)").alias("value")))
    given = id_col or next((c for c in columns if ID_COLUMN.search(c)), None)
    if kind in ("htmlq", "flashq"):
        statements = [c for c in columns if STATEMENT_COLUMN.match(c)] or numeric_columns(df, [c for c in columns if c.lower() not in NOT_STATEMENT and c != given])
    else:
        statements = numeric_columns(df, [c for c in columns if c != given])
    if not statements:
        raise ValueError(f"{path}: no column of numbers")
    df = observed(df, {c: F.col(f"`{c}`") for c in statements}, lost)
    who = F.col(f"`{given}`") if given else F.lit(None).cast("string")
    df = df.withColumn("participant", F.coalesce(who, F.concat(F.lit("P"), (F.col("_order") + 1).cast("string"))))
    return wide_to_long(df, statements, order="_order")


def _numbered(long: DataFrame) -> DataFrame:
    """Indexes for participants and statements of (study_id, participant, _s, value), both in order of their names."""
    from pyspark.sql import Window

    p = F.dense_rank().over(Window.partitionBy("study_id").orderBy(F.length(F.regexp_extract("participant", r"(\d*)$", 1)), "participant"))
    n = F.dense_rank().over(Window.partitionBy("study_id").orderBy(F.coalesce(F.expr("try_cast(_s as bigint)"), F.lit(0)), "_s"))
    return long.select("study_id", F.col("participant").cast("string").alias("participant"), p.alias("p_idx"), n.alias("stmt_num"), "value")


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """``(stmt_num, statement)``: a line each, or the text column of a table; leading numbers are taken off."""
    strip = lambda c: F.regexp_replace(F.trim(c), r"^\d+[.):;\s]+", "")
    if path.lower().endswith((".csv", ".tsv")):
        df = cleaned(read_table(spark, path, "\t" if path.lower().endswith(".tsv") else ","))
        sizes = df.agg(*[F.avg(F.length(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
        best = max(range(len(df.columns)), key=lambda k: sizes[f"c{k}"] or 0)
        lines = df.select(F.monotonically_increasing_id().alias("at"), F.col(f"`{df.columns[best]}`").alias("line"))
    else:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    kept = lines.where("trim(line) <> ''").withColumn("statement", strip(F.col("line")))
    from pyspark.sql import Window

    return kept.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("at")).alias("stmt_num"), "statement")  # a deck's statements: at most hundreds


def read_attributes(spark: SparkSession, path: str, study_id: str = "study") -> DataFrame:
    """``(study_id, row, attribute, raw)`` of an attribute file, all as text, blanks and NA null."""
    df = row_numbers(cleaned(read_table(spark, path)), "row").withColumn("row", F.col("row") + 1)
    return df.select(F.lit(study_id).alias("study_id"), "*").unpivot(["study_id", "row"], [c for c in df.columns if c != "row"], "attribute", "raw")


__all__ = ["layout", "read_attributes", "read_sorts", "read_statements", "read_table", "unique_ids"]
