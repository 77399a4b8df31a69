"""Sources: collections, vocabularies, topics, runs, page records and other text formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..plans.common import numbered, small_or_shuffled


def documents(spark: SparkSession, path: str, recursive: bool = True, encoding: str = "UTF-8", pattern: str | None = None) -> DataFrame:
    """One file a document, ids from 1 in the order of paths."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    files = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)
    named = files.select("path", F.decode("content", encoding).alias("text"), F.col("length").alias("size_bytes"))
    ids = small_or_shuffled(numbered(files.select("path"), F.col("path")))  # paths alone are sorted
    return named.join(ids, "path").select(F.col("row").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "text", "size_bytes")


def lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, text`` of every line."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """``term`` of comma-separated lists."""
    return spark.read.text(path).select(F.explode(F.split("value", ",")).alias("term")).select(F.trim("term").alias("term")).where("term != ''").distinct()


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """``term_id, idf, term`` of tab-separated lines with a header."""
    return spark.read.csv(path, sep="\t", header=True, schema="term_id int, idf double, term string", enforceSchema=True).where("term is not null")


def document_terms(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, term_ids`` of lines ``doc n: (1, 2, ...)``."""
    ids = F.regexp_extract_all(F.substring_index("value", "(", -1), F.lit("[0-9]+"), F.lit(0))
    found = spark.read.text(path).where(F.col("value").rlike(r"^\S+ [0-9]+:"))
    return found.select(F.regexp_extract("value", r"^\S+ ([0-9]+):", 1).cast("int").alias("doc_id"), ids.cast("array<int>").alias("term_ids"))


def topics(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, title`` of TREC topics: their title lines, numbered from 1."""
    text = spark.read.text(path, wholetext=True)
    titles = F.regexp_extract_all("value", F.lit(r"(?m)^<TITLE>\s*(.*?)\s*(?:</TITLE>)?\s*$"), F.lit(1))
    return text.select(F.posexplode(titles).alias("i", "title")).select((F.col("i") + 1).alias("query_id"), "title")


def run(spark: SparkSession, path: str) -> DataFrame:
    """A TREC run; the model column may be missing."""
    return spark.read.csv(path, sep=" ", schema=schemas.RUN)


def names(spark: SparkSession, path: str) -> DataFrame:
    """``name, id`` of lines ``id,.../name``."""
    return spark.read.text(path).select(F.element_at(F.split("value", "/"), -1).alias("name"), F.split_part("value", F.lit(","), F.lit(1)).alias("id"))


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``.I`` records, one row each."""
    rows = spark.read.option("lineSep", "\n.I ").text(path)
    return rows.select(F.regexp_replace("value", r"^\.I ", "").alias("value")).where(F.col("value").rlike("^[0-9]+"))


def _section(name: str):
    return F.regexp_extract("value", rf"(?s)\n\.{name}\n(.*?)(?=\n\.[A-Z]\n|\z)", 1)


def cisi_documents(spark: SparkSession, path: str, joiner: str = " ") -> DataFrame:
    """``doc_id, title, author, text`` of .I/.T/.A/.W/.X records, lines joined by ``joiner``."""
    flat = lambda c: F.trim(F.regexp_replace(c, "\n", joiner))
    number = F.regexp_extract("value", "^([0-9]+)", 1).cast("int")
    return _records(spark, path).select(number.alias("doc_id"), flat(_section("T")).alias("title"), flat(_section("A")).alias("author"), flat(_section("W")).alias("text"))


def cisi_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, words``: words of 5 to 20 letters of each record's text."""
    from ..functions.text import QUERY_WORD

    number = F.regexp_extract("value", "^([0-9]+)", 1).cast("int")
    return _records(spark, path).select(number.alias("query_id"), F.regexp_extract_all(_section("W"), F.lit(QUERY_WORD), F.lit(0)).alias("words"))


def structured_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, terms`` of lines ``#qN = ... 'term' ...``."""
    found = spark.read.text(path).where(F.col("value").rlike(r"^#q[0-9]+\s*="))
    return found.select(F.regexp_extract("value", "^#q([0-9]+)", 1).cast("int").alias("query_id"), F.regexp_extract_all("value", F.lit("'([^']*)'"), F.lit(1)).alias("terms"))


def postings_text(spark: SparkSession, path: str) -> DataFrame:
    """``term, df, doc_ids`` of lines ``term:df:id,id,...``; ids are sorted."""
    part = lambda n: F.split_part("value", F.lit(":"), F.lit(n))
    ids = F.filter(F.split(part(3), ","), lambda x: x != "").cast("array<bigint>")
    return spark.read.text(path).where("value != ''").select(part(1).alias("term"), part(2).cast("int").alias("df"), F.array_sort(ids).alias("doc_ids"))


def seeds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("url")).where("url != ''")


def crawl_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=";", header=True, schema="id bigint, url string, l_depth int, p_depth int, dynamic boolean")


def word_list(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("value").alias("term")).where("term != ''")


def language_texts(spark: SparkSession, path: str, encoding: str = "ISO-8859-1") -> DataFrame:
    """``lang, line_no, text``: one file a language, named after it."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("lang"), F.decode("content", encoding).alias("t"))
    return files.select("lang", F.posexplode(F.split("t", "\n")).alias("line_no", "text"))


def language_labels(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, lang`` of lines ``n language``."""
    return spark.read.text(path).select(F.split_part("value", F.lit(" "), F.lit(1)).cast("int").alias("line_no"), F.split_part("value", F.lit(" "), F.lit(2)).alias("lang"))


def saved_index(spark: SparkSession, path: str, build) -> DataFrame:
    """Postings under the path; ``build(path)`` makes them first if there are none."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/postings")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        build(path)
    return spark.read.parquet(f"{path}/postings")
