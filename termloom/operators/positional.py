"""Phrase and proximity retrieval over positions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.common import BROADCAST_ROWS, small_or_shuffled
from . import within
from .tokenize import plain_tokens


def positions(tokens: DataFrame) -> DataFrame:
    """``doc_id, term, at``: places (from 0) among the kept tokens."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    kept = tokens.where("term is not null and pos is not null")
    return kept.select("doc_id", "term", (F.row_number().over(order) - 1).alias("at"))


def phrase(places: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, doc_id``: all terms in a row. queries: (query_id, i, term), i from 0.

    A place with offset i votes for the start at - i; a start with a vote from every offset is a match.
    """
    size = queries.groupBy("query_id").agg(F.count("*").alias("need"))
    q = queries.join(size, "query_id")
    votes = places.join(small_or_shuffled(q), "term").groupBy("query_id", "doc_id", "need", (F.col("at") - F.col("i")).alias("start")).agg(F.count_distinct("i").alias("n"))
    return votes.where("n = need").select("query_id", "doc_id").distinct()


def windows(places: DataFrame, size: int) -> DataFrame:
    """``doc_id, at, words``: every ``size`` kept words in a row, as an array."""
    order = Window.partitionBy("doc_id").orderBy("at")
    words = [F.col("term"), *[F.lead("term", k).over(order) for k in range(1, size)]]
    return places.select("doc_id", "at", F.array(*words).alias("words")).where(F.element_at("words", -1).isNotNull())


def phrase_windows(places: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """``query_id, start, docs``: documents that hold each phrase; one join on whole phrases, however many are asked.

    queries: (query_id, start, words). Phrases that nobody asks for are left out before the shuffle.
    """
    asked = small_or_shuffled(queries.select("words").distinct())
    met = windows(places, size).join(asked, "words", "left_semi").select("words", "doc_id").distinct()
    per = met.groupBy("words").agg(F.count("*").alias("docs"))
    return queries.join(per, "words").select("query_id", "start", "docs")


def near(places: DataFrame, pairs: DataFrame, distance: int = 1, symmetric: bool = False) -> DataFrame:
    """``query_id, i, doc_id``: the pair's terms within the distance. pairs: (query_id, i, a, b).

    A place of the first term is spread over the places it reaches, so the join is on equal keys.
    """
    reach = [d for d in range(-distance if symmetric else 1, distance + 1) if d]
    p = small_or_shuffled(pairs)
    left = places.join(p, places["term"] == F.col("a")).select("query_id", "i", "b", "doc_id", F.explode(F.array(*[F.col("at") + d for d in reach])).alias("at"))
    right = places.select(F.col("doc_id"), F.col("term").alias("b"), "at")
    return left.join(right, ["doc_id", "b", "at"]).select("query_id", "i", "doc_id").distinct()


def _pairs(queries: DataFrame) -> DataFrame:
    nxt = queries.select("query_id", (F.col("i") - 1).alias("i"), F.col("term").alias("b"))
    return queries.join(nxt, ["query_id", "i"]).select("query_id", "i", F.col("term").alias("a"), "b")


def _every_pair(found: DataFrame, pairs: DataFrame) -> DataFrame:
    need = pairs.groupBy("query_id").agg(F.count("*").alias("need"))
    per = found.groupBy("query_id", "doc_id").agg(F.count("*").alias("n"))
    return per.join(small_or_shuffled(need), "query_id").where("n = need").select("query_id", "doc_id")


def phrase_pairwise(places: DataFrame, queries: DataFrame) -> DataFrame:
    """Each neighbouring pair occurs somewhere in the document: weaker than ``phrase``."""
    pairs = _pairs(queries)
    return _every_pair(near(places, pairs), pairs)


def proximity(places: DataFrame, queries: DataFrame, distance: int = 3) -> DataFrame:
    """Each pair of neighbouring query terms lies within the distance, in either order."""
    pairs = _pairs(queries)
    return _every_pair(near(places, pairs, distance, True), pairs)


def search_texts(docs: DataFrame, queries: DataFrame, kind: str = "phrase", distance: int = 3) -> DataFrame:
    """``phrase``, ``phrase_pairwise`` or ``proximity`` over (doc_id, text) themselves: each document is looked at once, nothing is shuffled.

    Beyond a bounded number of query words, or where ids repeat, the operators over places answer.
    """
    reach = {"phrase": None, "phrase_pairwise": [1], "proximity": [d for d in range(-distance, distance + 1) if d]}[kind]
    asked = within.asked(queries, BROADCAST_ROWS)
    if asked is None or not within.one_row_each(docs):
        places = positions(plain_tokens(docs))
        return proximity(places, queries, distance) if kind == "proximity" else {"phrase": phrase, "phrase_pairwise": phrase_pairwise}[kind](places, queries)
    return within.matches(docs, asked, queries.schema["query_id"].dataType, reach)


def literal_queries(spark, queries: list[list[str]]) -> DataFrame:
    rows = reduce(list.__add__, [[(n, i, t) for i, t in enumerate(q)] for n, q in enumerate(queries)], [])
    return spark.createDataFrame(rows, "query_id long, i int, term string")
