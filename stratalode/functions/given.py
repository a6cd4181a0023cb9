"""What users bring along: table functions and rules.

A table function is a class with ``eval``, registered by name and called in
LATERAL joins; what it raises for one row is a row of its own, with the error,
so that a bad value costs itself alone. Rules are rows of a table, so one that
is added holds for the next query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_extractor(spark: SparkSession, name: str, extract: Callable[..., Iterable[tuple]], columns: str) -> None:
    """Makes ``extract`` a table function of SQL: name(value) gives rows of ``columns`` and ``error`` (null: none).

    extract: a value to tuples. Null values give no rows.
    """
    width = len([c for c in columns.split(",") if c.strip()])

    class Extractor:
        def eval(self, value):
            if value is None:
                return
            try:
                rows = [(*row, None) for row in extract(value)]
            except Exception as error:  # noqa: BLE001 - told as a row
                rows = [(*[None] * width, f"{type(error).__name__}: {error}")]
            yield from rows

    spark.udtf.register(name, F.udtf(Extractor, returnType=f"{columns}, error string"))


def extracted(rows: DataFrame, name: str, column: str) -> DataFrame:
    """rows with what a registered table function gives for a column, a row each."""
    return rows.sparkSession.sql(f"SELECT r.*, x.* FROM {{rows}} r, LATERAL {name}(r.`{column}`) x", rows=rows)


def by_rules(values: DataFrame, column: str, rules: DataFrame, split: Callable = lambda c: F.split(F.lower(c), r"[^\p{L}\p{N}]+")) -> DataFrame:
    """values (distinct) with ``semantic`` and ``confidence`` of the best rule of each, null where none applies.

    rules: (word, semantic, confidence); a rule applies to a value that holds its
    word. The highest confidence wins, then the smallest word and semantic.
    split: a value to its words, any function from column to column.
    """
    told = values.select(column).distinct()
    words = told.select(column, F.explode(F.array_distinct(split(F.col(column)))).alias("word"))
    met = words.join(rules.where("word is not null and confidence is not null"), "word")
    best = met.groupBy(column).agg(F.min(F.struct((-F.col("confidence")).alias("least"), "word", "semantic")).alias("best"))
    return told.join(best.select(column, F.col("best.semantic").alias("semantic"), (-F.col("best.least")).alias("confidence")), column, "left")
