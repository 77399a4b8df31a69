"""From documents to tokens and term frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def plain_tokens(docs: DataFrame, low: int = 3, high: int = 25, table=X.FOLD_ACUTE, column: str = "text") -> DataFrame:
    """``doc_id, pos, raw, term``: lower case, folded, split at white space, letters and numbers kept.

    ``term`` is null for tokens that the length filter drops, so collection statistics see them too.
    """
    split = docs.select("doc_id", F.posexplode(X.words(X.normalize(F.col(column), table))).alias("pos", "raw"))
    cleaned = split.withColumn("term", X.remove_punctuation("raw"))
    return cleaned.withColumn("term", F.when(F.length("term").between(low, high), F.col("term")))


def kept_text(column: str = "text", table=X.FOLD_ACUTE):
    """A text as ``plain_tokens`` reads it, cleaned before it is split: its words are the same, in the same order."""
    return X.remove_punctuation_keep_spaces(X.normalize(F.col(column), table))


def typed_tokens(docs: DataFrame, low: int = 3, high: int = 25, names: bool = True, table=X.FOLD_FULL) -> DataFrame:
    """``doc_id, pos, token, term, kind`` by the entity pipeline.

    Fold, split, classify (number, mail_url, abbreviation, date, plain), clean, lower. Numbers, mails,
    URLs and dates pass the length filter; plain tokens must be of letters a-z only. Proper names
    follow as terms of several words without a position, while their words count singly too.
    """
    folded = docs.select("doc_id", X.fold(F.col("text"), table).alias("t"))
    split = folded.select("doc_id", F.posexplode(X.words(F.col("t"))).alias("pos", "token"))
    kept = classified(split, low, high).select("doc_id", "pos", "token", "kind", "term")
    if not names:
        return kept
    found = folded.select("doc_id", F.explode(X.proper_names("t")).alias("token"))
    found = found.select("doc_id", F.lit(None).cast("int").alias("pos"), "token", F.lit("proper_name").alias("kind"), F.lower("token").alias("term"))
    return kept.unionByName(found)


def classified(tokens: DataFrame, low: int = 3, high: int = 25) -> DataFrame:
    """Adds ``kind, term`` to rows with a ``token``, and drops those that the entity pipeline drops."""
    special = F.col("kind").isin("number", "mail_url", "date")
    plain = F.lower(X.remove_punctuation_keep_spaces("token"))
    term = F.when(special, F.lower(X.clean_special("token"))).otherwise(plain)
    return tokens.withColumn("kind", X.kind("token")).withColumn("term", term).where(special | (X.only_letters("term") & F.length("term").between(low, high)))


def entity_tokens(docs: DataFrame, low: int = 3, high: int = 25) -> DataFrame:
    """``doc_id, term, kind`` by the older pipeline: all numbers inside a token are taken, the first in its place.

    Abbreviations are suppressed where the word without its period, or in lower case, is a term itself; the
    vocabulary for that is the whole collection's.
    """
    split = docs.select("doc_id", F.explode(X.words(X.fold(F.col("text"), X.FOLD_WIDE))).alias("token"))
    split = split.withColumn("numbers", X.inner_numbers("token"))
    numbers = split.select("doc_id", F.explode("numbers").alias("term"), F.lit("number").alias("kind"))
    rest = split.where(F.size("numbers") == 0)
    mails = rest.where(X.is_mail_or_url("token")).select("doc_id", F.col("token").alias("term"), F.lit("mail_url").alias("kind"))
    rest = rest.where(~X.is_mail_or_url("token"))
    abbreviated = X.is_abbreviation("token")
    word = F.lower(X.remove_punctuation("token"))
    plain = rest.where(~abbreviated).select("doc_id", word.alias("term"), F.lit("plain").alias("kind")).where(F.length("term").between(low, high))
    known = plain.select("term").distinct().withColumnRenamed("term", "known")
    short = rest.where(abbreviated).select("doc_id", "token", word.alias("word"))
    is_known = short.join(known, F.col("word") == F.col("known"), "left")
    abbreviations = is_known.select(
        "doc_id",
        F.when(F.col("known").isNull(), F.col("token")).otherwise(F.col("word")).alias("term"),
        F.when(F.col("known").isNull(), F.lit("abbreviation")).otherwise(F.lit("plain")).alias("kind"),
    ).where((F.col("kind") == "abbreviation") | F.length("term").between(low, high))
    return numbers.union(mails).union(plain).union(abbreviations)


def without_stop_words(tokens: DataFrame, stop_words: DataFrame | list[str], column: str = "term") -> DataFrame:
    """Drop the listed terms: a literal list, or a table with a column of the same name."""
    if isinstance(stop_words, list):
        return tokens.where(~F.col(column).isin(stop_words)) if stop_words else tokens
    return tokens.join(stop_words.select(column).distinct(), column, "left_anti")


def term_frequencies(tokens: DataFrame) -> DataFrame:
    """``doc_id, term, tf``."""
    return tokens.where("term is not null").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
