"""Collection statistics, dictionary sizes and the laws of Zipf and Heaps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..plans.common import numbered, running_sums, written
from . import tokenize, within


def term_statistics(tf: DataFrame) -> DataFrame:
    """``term, cf, df``."""
    return tf.groupBy("term").agg(F.sum("tf").alias("cf"), F.count("*").alias("df"))


def document_counts(docs: DataFrame, tf: DataFrame) -> DataFrame:
    """``doc_id, n_terms, size_bytes``: distinct terms and the text's size."""
    terms = tf.groupBy("doc_id").agg(F.count("*").alias("n_terms"))
    sizes = docs.select("doc_id", F.octet_length("text").cast("long").alias("size_bytes"))
    return sizes.join(terms, "doc_id", "left").select("doc_id", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), "size_bytes")


def collection_statistics(tokens: DataFrame) -> DataFrame:
    """One row over ``plain_tokens``: tokens count before the filters, terms after them.

    Shortest and longest documents are by tokens, then the smaller id.
    """
    per_doc_term = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    per_doc = per_doc_term.groupBy("doc_id").agg(F.sum("n").alias("tokens"), F.count("term").alias("terms"))
    docs = per_doc.agg(
        F.count("*").alias("docs"),
        F.sum("tokens").alias("tokens"),
        F.min(F.struct("tokens", "doc_id", "terms")).alias("short"),
        F.max(F.struct("tokens", -F.col("doc_id"), "terms")).alias("long"),
    )
    terms = term_statistics(per_doc_term.where("term is not null").withColumnRenamed("n", "tf"))
    vocabulary = terms.agg(
        F.count("*").alias("terms"), F.avg(F.length("term")).alias("avg_term_length"), F.count(F.when(F.col("cf") == 1, 1)).alias("hapaxes")
    )
    joined = docs.crossJoin(vocabulary)  # one row each
    return joined.select(
        "docs",
        "tokens",
        "terms",
        (F.col("tokens") / F.col("docs")).alias("tokens_per_doc"),
        (F.col("terms") / F.col("docs")).alias("terms_per_doc"),
        F.round("avg_term_length", 6).alias("avg_term_length"),
        F.col("short.tokens").alias("short_tokens"),
        F.col("short.terms").alias("short_terms"),
        F.col("long.tokens").alias("long_tokens"),
        F.col("long.terms").alias("long_terms"),
        "hapaxes",
    )


def top_bottom(terms: DataFrame, n: int = 10) -> DataFrame:
    """``side, place, term, cf, df``: the first and last n of the order by (cf, df, term)."""
    from pyspark.sql import Window

    up = terms.orderBy("cf", "df", "term").limit(n)
    down = terms.orderBy(F.desc("cf"), F.desc("df"), F.desc("term")).limit(n)
    low = up.withColumn("place", F.row_number().over(Window.orderBy("cf", "df", "term")))
    high = down.withColumn("place", F.row_number().over(Window.orderBy(F.desc("cf"), F.desc("df"), F.desc("term"))))
    return high.select(F.lit("top").alias("side"), "place", "term", "cf", "df").union(low.select(F.lit("bottom"), "place", "term", "cf", "df"))


def entity_kinds(docs: DataFrame) -> DataFrame:
    """``kind, tokens, terms`` of ``typed_tokens`` without names: equal tokens are counted first, then classified once."""
    every = within.tokens(docs, by_document=False).groupBy("token").agg(F.sum("n").alias("n"))
    per = tokenize.classified(every).groupBy("kind", "term").agg(F.sum("n").alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("tokens"), F.count("term").alias("terms"))


def entity_terms(docs: DataFrame, low: int = 3, high: int = 25) -> DataFrame:
    """``kind, term, cf, df`` of ``entity_tokens``, in one pass over the documents and one shuffle by term.

    An abbreviation counts both as itself and, apart, as the word that it may be; which of the two holds is
    known once the plain terms are.
    """
    found = within.tokens(docs, X.FOLD_WIDE).withColumn("numbers", X.inner_numbers("token")).withColumn("word", F.lower(X.remove_punctuation("token")))
    entry = lambda kind, term, word=F.lit(None).cast("string"): F.struct(F.lit(kind).alias("kind"), term.alias("term"), word.alias("word"))
    token, word, fits = F.col("token"), F.col("word"), F.length("word").between(low, high)
    short = F.when(fits, F.array(entry("abbreviation", token, word), entry("maybe", word))).otherwise(F.array(entry("abbreviation", token, word)))
    entries = (
        F.when(F.size("numbers") > 0, F.transform("numbers", lambda x: entry("number", x)))
        .when(X.is_mail_or_url("token"), F.array(entry("mail_url", token)))
        .when(X.is_abbreviation("token"), short)
        .when(fits, F.array(entry("plain", word)))
    )
    each = found.select("doc_id", "n", F.explode(entries).alias("e")).select("doc_id", "n", "e.*").withColumn("maybe", F.col("kind") == "maybe")
    each = each.withColumn("kind", F.when(F.col("maybe"), "plain").otherwise(F.col("kind"))).repartition("kind", "term")
    sure = F.sum(F.when(~F.col("maybe"), F.col("n")))
    per = each.groupBy("kind", "term", "doc_id").agg(F.sum("n").alias("n"), sure.alias("sure"), F.first("word").alias("word"))
    known = written(per.groupBy("kind", "term").agg(F.sum("n").alias("cf"), F.count("*").alias("df"), F.count("sure").alias("sure"), F.first("word").alias("word")), "entities")
    plain = known.where("kind = 'plain' and sure > 0")
    others = known.where("kind <> 'plain'").join(plain.select(F.col("term").alias("word"), F.lit(True).alias("is_word")), "word", "left").where("is_word is null")
    return plain.select("kind", "term", "cf", "df").unionByName(others.select("kind", "term", "cf", "df"))


def index_totals(tf: DataFrame) -> DataFrame:
    """One row: documents, vocabulary, postings, and the length of the longest term."""
    return tf.agg(
        F.count_distinct("doc_id").alias("docs"), F.count_distinct("term").alias("terms"), F.count("*").alias("postings"), F.max(F.length("term")).cast("long").alias("longest_term")
    )


def posting_sizes(terms: DataFrame, width: int = 4) -> DataFrame:
    """``posting_bytes, n_terms``."""
    return terms.groupBy((F.col("df") * width).alias("posting_bytes")).agg(F.count("*").alias("n_terms"))


def document_overhead(counts: DataFrame, width: int = 4) -> DataFrame:
    """``doc_id, index_bytes, size_bytes, overhead``."""
    index = F.col("n_terms") * width
    return counts.select(
        "doc_id", index.alias("index_bytes"), "size_bytes", F.when(F.col("size_bytes") > 0, F.round(index / F.col("size_bytes"), 6)).alias("overhead")
    )


def dictionary_sizes(terms: DataFrame, cut: int = 20, pointer: int = 4) -> DataFrame:
    """One row: a dictionary at fixed width, as one string, with pointers, and with terms cut to ``cut``."""
    n = F.length("term").cast("long")
    return terms.agg(
        F.count("*").alias("terms"),
        (F.count("*") * F.max(n)).alias("fixed_bytes"),
        F.sum(n).alias("string_bytes"),
        (F.sum(n) + pointer * F.count("*")).alias("string_pointer_bytes"),
        F.sum(F.least(n, F.lit(cut))).alias("cut_bytes"),
        F.count(F.when(n > cut, 1)).alias("longer_than_cut"),
        F.round(100 * (1 - (F.sum(n) + pointer * F.count("*")) / (F.count("*") * F.max(n))), 6).alias("saving_percent"),
    )


def word_lengths(terms: DataFrame) -> DataFrame:
    """``length, n_terms``."""
    return terms.groupBy(F.length("term").cast("long").alias("length")).agg(F.count("*").alias("n_terms"))


def word_length_summary(terms: DataFrame) -> DataFrame:
    """One row: count, mean, sample deviation, least, quartiles and greatest length, from the histogram."""
    n = F.length("term").cast("long")
    q = lambda p: F.percentile(n, F.lit(p)).alias(f"p{int(p * 100)}")
    return terms.agg(
        F.count("*").alias("terms"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("deviation"), F.min(n).alias("least"), q(0.25), q(0.5), q(0.75), F.max(n).alias("greatest")
    )


def frequency_ranks(terms: DataFrame) -> DataFrame:
    """``rank, term, cf`` by descending frequency, then term."""
    return numbered(terms.select("term", "cf"), F.desc("cf"), F.col("term")).select(F.col("row").alias("rank"), "term", "cf")


def loglog_fit(points: DataFrame, x: str = "rank", y: str = "cf") -> DataFrame:
    """One row: slope and intercept of ln y on ln x, and their correlation."""
    lx, ly = F.ln(F.col(x).cast("double")), F.ln(F.col(y).cast("double"))
    return points.where((F.col(x) > 0) & (F.col(y) > 0)).agg(
        F.round(F.regr_slope(ly, lx), 6).alias("slope"), F.round(F.regr_intercept(ly, lx), 6).alias("intercept"), F.round(F.corr(lx, ly), 6).alias("correlation")
    )


def power_law_fit(points: DataFrame, x: str = "rank", y: str = "cf", steps: int = 50) -> tuple[float, float, float]:
    """Least squares of y = a x^b by Gauss-Newton; each step is one aggregation of five sums.

    Starts at the log-log fit. Returns a, b and the correlation of y with the prediction.
    """
    points = points.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    start = loglog_fit(points, "x", "y").first()
    if start is None or start["slope"] is None:
        return float("nan"), float("nan"), float("nan")
    a, b = math.exp(start["intercept"]), start["slope"]

    def sums(a: float, b: float):
        power = F.pow("x", F.lit(b))
        da, db, r = power, a * power * F.ln("x"), F.col("y") - a * power
        return points.agg(F.sum(da * da), F.sum(da * db), F.sum(db * db), F.sum(da * r), F.sum(db * r), F.sum(r * r)).first()

    now = sums(a, b)
    for _ in range(steps):
        aa, ab, bb, ar, br, error = now
        det = aa * bb - ab * ab
        if not det:
            break
        step_a, step_b = (bb * ar - ab * br) / det, (aa * br - ab * ar) / det
        scale = 1.0
        while scale > 1e-6:
            new = sums(a + scale * step_a, b + scale * step_b)
            if new[5] is not None and new[5] <= error:
                break
            scale /= 2
        else:
            break
        a, b, now = a + scale * step_a, b + scale * step_b, new
        if abs(scale * step_b) < 1e-10 and abs(scale * step_a) <= 1e-10 * abs(a):
            break
    fit = points.agg(F.corr("y", a * F.pow("x", F.lit(b)))).first()[0]
    return a, b, float("nan") if fit is None else fit


def threshold_share(terms: DataFrame, thresholds=(100, 1000, 10000)) -> DataFrame:
    """``threshold, n_terms, share, predicted_share`` of terms at least so frequent.

    The prediction is the share of ranks whose log-log fitted frequency reaches the threshold.
    """
    ranks = frequency_ranks(terms)
    fit = ranks.agg(
        F.regr_slope(F.ln("cf"), F.ln(F.col("rank").cast("double"))).alias("b"), F.regr_intercept(F.ln("cf"), F.ln(F.col("rank").cast("double"))).alias("a"), F.count("*").alias("v")
    )
    counts = [F.count(F.when(F.col("cf") >= t, 1)).alias(f"n{t}") for t in thresholds]
    one = terms.agg(*counts).crossJoin(fit)  # one row each
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"n{t}").alias("n_terms")) for t in thresholds])
    reach = F.floor(F.exp((F.ln(F.col("threshold").cast("double")) - F.col("a")) / F.col("b")) + 1e-9)
    predicted = F.least(F.greatest(reach, F.lit(0)), F.col("v"))
    return one.select("a", "b", "v", F.explode(rows).alias("r")).select("a", "b", "v", "r.*").select(
        "threshold", "n_terms", F.round(F.col("n_terms") / F.col("v"), 6).alias("share"), F.round(predicted / F.col("v"), 6).alias("predicted_share")
    )


def heaps_by_document(tokens: DataFrame) -> DataFrame:
    """``doc_id, tokens, terms``: running totals of tokens and of distinct terms after each document.

    A term counts at its first document; all tokens count, filtered ones too.
    """
    per = tokens.groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    counts = per.groupBy("doc_id").agg(F.sum("n").alias("n"))
    first = per.where("term is not null").groupBy("term").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id").agg(F.count("*").alias("new"))
    joined = counts.join(first, "doc_id", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return running_sums(joined, "doc_id", {"n": "tokens", "new": "terms"}).select("doc_id", "tokens", "terms")


def heaps_curve(tokens: DataFrame) -> DataFrame:
    """``tokens, terms`` after every single token, in the order of documents and positions."""
    from pyspark.sql import Window

    # A term's first place is combined before the shuffle.
    first = tokens.where("term is not null").groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    first = first.select("at.doc_id", "at.pos", F.lit(1).alias("new"))
    marked = tokens.join(first, ["doc_id", "pos"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    within = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).alias("i"), F.sum("new").over(within).alias("s"))
    totals = heaps_by_document(tokens).select("doc_id", F.col("tokens").alias("after"), F.col("terms").alias("seen"))
    size = tokens.groupBy("doc_id").agg(F.count("*").alias("n"))
    last = local.groupBy("doc_id").agg(F.max("s").alias("own"))
    starts = totals.join(size, "doc_id").join(last, "doc_id").select("doc_id", (F.col("after") - F.col("n")).alias("t0"), (F.col("seen") - F.col("own")).alias("s0"))
    return local.join(starts, "doc_id").select((F.col("t0") + F.col("i")).alias("tokens"), (F.col("s0") + F.col("s")).alias("terms"))
