"""Sinks: text and CSV forms of results. Indexes are written by ``operators.index``."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def term_dictionary(terms: DataFrame, path: str) -> None:
    """Lines ``term cf df`` sorted by term, in files of ascending ranges."""
    lines = terms.repartitionByRange("term").sortWithinPartitions("term").select(F.concat_ws(" ", "term", "cf", "df"))
    lines.write.mode("overwrite").text(path)


def statistics(stats: DataFrame, path: str) -> None:
    """The one-row collection statistics as six lines."""
    groups = [("docs",), ("tokens", "terms"), ("tokens_per_doc", "terms_per_doc"), ("avg_term_length",), ("short_tokens", "short_terms", "long_tokens", "long_terms"), ("hapaxes",)]
    rows = F.array(*[F.concat_ws(" ", *[F.col(c).cast("string") for c in g]) for g in groups])
    stats.select(F.explode(rows)).coalesce(1).write.mode("overwrite").text(path)


def extremes(rows: DataFrame, path: str) -> None:
    """Lines ``term cf`` of the most and least frequent terms."""
    rows.orderBy(F.desc("side"), "place").select(F.concat_ws(" ", "term", "cf")).coalesce(1).write.mode("overwrite").text(path)


def entities(tokens: DataFrame, path: str) -> None:
    """Quoted CSV of the entity tokens, a folder a kind; repeats stay."""
    tokens.where("kind != 'plain'").select("kind", "term").write.mode("overwrite").partitionBy("kind").csv(path, quoteAll=True)


def stem_comparison(stems: DataFrame, path: str) -> None:
    stems.repartitionByRange("term").sortWithinPartitions("term").select(F.concat_ws(" ", *stems.columns)).write.mode("overwrite").text(path)


def predictions(rows: DataFrame, path: str, order: str = "line_no", label: str = "lang_pred") -> None:
    """One label a line, in input order."""
    rows.orderBy(order).select(F.coalesce(label, F.lit(""))).write.mode("overwrite").text(path)


def run(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def trec_documents(docs: DataFrame, path: str) -> None:
    text = F.format_string("<DOC>\n<DOCNO>%s</DOCNO>\n%s - %s\n</DOC>", F.col("doc_id").cast("string"), "title", "text")
    docs.select(text).write.mode("overwrite").text(path)


def trec_topics(queries: DataFrame, path: str) -> None:
    text = F.format_string("<TOP>\n<NUM>%s<NUM>\n<TITLE>%s\n</TOP>", F.col("query_id").cast("string"), F.array_join("words", " "))
    queries.select(text).write.mode("overwrite").text(path)


def statistics_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def crawl_records(pages: DataFrame, path: str) -> None:
    pages.write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True)


def document_ids(docs: DataFrame, path: str) -> None:
    docs.select("name", "doc_id").write.mode("overwrite").csv(path)


def timings(cases, spark, path: str) -> None:
    """CSV of ``query_id, n_terms, seconds``: how long each of the cases (id, terms, action) takes."""
    rows = []
    for query_id, n_terms, action in cases:
        began = time.perf_counter()
        action()
        rows.append((query_id, n_terms, time.perf_counter() - began))
    spark.createDataFrame(rows, "query_id long, n_terms long, seconds double").coalesce(1).write.mode("overwrite").csv(path, header=True)
