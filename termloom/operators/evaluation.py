"""Comparison of ranked runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def augmented(a: DataFrame, b: DataFrame) -> DataFrame:
    """``query_id, doc_id, ra, rb``: both runs over their joint documents.

    A document that a run lacks follows its last one, in the order of the other run.
    """
    met = a.select("query_id", "doc_id", F.col("rank").alias("ra")).join(b.select("query_id", "doc_id", F.col("rank").alias("rb")), ["query_id", "doc_id"], "full")
    query = Window.partitionBy("query_id")

    def filled(own: str, other: str):
        missing = F.sum(F.col(own).isNull().cast("int")).over(query.orderBy(other, "doc_id").rowsBetween(Window.unboundedPreceding, 0))
        return F.coalesce(F.col(own), F.max(own).over(query) + missing)

    return met.select("query_id", "doc_id", filled("ra", "rb").alias("ra"), filled("rb", "ra").alias("rb"))


def spearman(a: DataFrame, b: DataFrame) -> DataFrame:
    """``query_id, docs, rho`` with rho = 1 - 6 sum d^2 / (k (k^2 - 1))."""
    d = F.col("ra") - F.col("rb")
    per = augmented(a, b).groupBy("query_id").agg(F.count("*").alias("docs"), F.sum(d * d).alias("dd"))
    k = F.col("docs").cast("double")
    return per.select("query_id", "docs", F.when(F.col("docs") > 1, F.round(1 - 6 * F.col("dd") / (k * (k * k - 1)), 6)).alias("rho"))


def run_lines(ranked: DataFrame, model: str | None = None) -> DataFrame:
    """``value``: TREC lines ``query Q0 doc position score``, positions from 0."""
    parts = [F.col("query_id").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), (F.col("rank") - 1).cast("string"), F.format_string("%.6f", "score")]
    return ranked.select(F.concat_ws(" ", *parts, *([F.lit(model)] if model else [])).alias("value"))


def renamed(run: DataFrame, names: DataFrame) -> DataFrame:
    """A run with its documents' other ids. names: (doc_id, new_id); documents without one drop out."""
    return run.join(names, "doc_id").drop("doc_id").withColumnRenamed("new_id", "doc_id")
