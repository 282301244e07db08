"""Queries with a stated result schema, the same in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Decimal places of floating-point results; sums in another order differ far below that.
PLACES = 6


def rounded(c: Column, places: int = PLACES) -> Column:
    """``round(c, places)``, the same bits: that goes through a decimal of each number, which here only large ones and those close to a tie do."""
    unit = float(10**places)
    y = F.abs(c) * unit
    return F.when((y >= 1e9) | (F.abs(y - F.floor(y) - 0.5) < 1e-4), F.round(c, places)).otherwise(F.signum(c) * (F.floor(y + 0.5) / F.lit(unit)))


@dataclass
class Query:
    """``columns``: ``name:kind`` words; kinds are s(tring), i(nteger), d(ouble) and b(oolean)."""

    columns: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    def spec(self) -> list[tuple[str, str]]:
        return [tuple(c.split(":")) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        shape = {"s": lambda c: F.col(c).cast("string"), "i": lambda c: F.col(c).cast("long"), "b": lambda c: F.col(c).cast("boolean"), "d": lambda c: rounded(F.col(c).cast("double")) + F.lit(0.0)}
        return df.select(*[shape[k](c).alias(c) for c, k in self.spec()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        shape = {"s": "{0}::varchar", "i": "{0}::bigint", "b": "{0}::boolean", "d": f"round({{0}}::double, {PLACES}) + 0.0"}
        return "select " + ", ".join(f"{shape[k].format(c)} as {c}" for c, k in self.spec()) + f" from ({self.sql})"
