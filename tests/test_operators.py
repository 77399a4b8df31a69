import math
import re

import pytest
from pyspark.sql import functions as F

from termloom.operators import evaluation, graph, index, language, positional, retrieval, statistics, tokenize
from termloom.plans import boolean
from termloom.plans.common import numbered, running_sums
from termloom.sources import readers, writers
from termloom.streaming import incremental


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three two"), (2, "two three four. Ángel žarnićli"), (3, "three"), (4, ""), (5, "one three-two aa 2021-12-09 u.s.a")]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def tf(docs):
    return tokenize.term_frequencies(tokenize.plain_tokens(docs))


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_typed_tokens(docs):
    got = {(r.doc_id, r.term, r.kind) for r in tokenize.typed_tokens(docs).collect()}
    assert (5, "20211209", "date") in got and (5, "usa", "abbreviation") in got
    assert not any(t in ("ángel", "zarnicli", "žarnićli", "aa") for _, t, _ in got)


def test_statistics(docs, tf):
    s = statistics.collection_statistics(tokenize.plain_tokens(docs)).first()
    assert (s.docs, s.short_tokens, s.long_tokens) == (5, 1, 5)
    terms = {r.term: (r.cf, r.df) for r in statistics.term_statistics(tf).collect()}
    assert terms["three"] == (3, 3) and terms["two"] == (3, 2)
    assert statistics.heaps_by_document(tokenize.plain_tokens(docs)).count() == 5
    curve = sorted((r.tokens, r.terms) for r in statistics.heaps_curve(tokenize.plain_tokens(docs)).collect())
    assert curve[:4] == [(1, 1), (2, 2), (3, 3), (4, 3)] and curve[-1][1] == len(terms)


def test_power_law(spark):
    points = spark.createDataFrame([(x, 50.0 * x**-0.7) for x in range(1, 60)], "rank long, cf double")
    a, b, r = statistics.power_law_fit(points)
    assert abs(a - 50) < 1e-3 and abs(b + 0.7) < 1e-5 and r > 0.999


def test_numbered_and_sums(spark):
    df = spark.range(0, 1000, numPartitions=7).selectExpr("(id * 37) % 1000 as k")
    assert all(r.row == r.k + 1 for r in numbered(df, df["k"]).collect())
    sums = running_sums(df.selectExpr("k", "1 as one"), "k", {"one": "n"}, block=64)
    assert all(r.n == r.k + 1 for r in sums.collect())


def test_index_files(spark, tf, tmp_path, docs):
    path = str(tmp_path / "index")
    index.write_index(tf, path, tokenize.plain_tokens(docs))
    assert ids(index.posting(spark, path, "two")) == [1, 2] and index.posting(spark, path, "zzz").count() == 0
    assert index.read_terms(spark, path).count() == tf.select("term").distinct().count()
    index.append_block(tf.withColumn("doc_id", tf["doc_id"] + 10), path)
    index.merge_blocks(spark, path, str(tmp_path / "merged"))
    assert ids(index.posting(spark, str(tmp_path / "merged"), "two")) == [1, 2, 11, 12]
    assert index.posting(spark, path, "two", "positions").count() == 2
    assert readers.saved_index(spark, path, None).count() == 2 * tf.count()


@pytest.mark.parametrize("method", ["vb", "gamma"])
@pytest.mark.parametrize("gapped", [True, False])
def test_compressed_index(tf, method, gapped):
    back = index.decompressed(index.compressed_index(tf, method, gapped), method, gapped)
    assert sorted(back.collect()) == sorted(tf.select("term", "doc_id", "tf").collect())


def test_skips(spark):
    tf = spark.createDataFrame([("a", d, 1) for d in range(10, 20)] + [("b", 1, 1)], "term string, doc_id long, tf long")
    got = {(r.term, r.idx) for r in index.skips(tf).collect()}
    assert got == {("a", 4), ("a", 8), ("b", 1)}
    assert {(r.term, r.idx) for r in index.skips(tf, False).collect()} == {("a", 5), ("a", 9)}


def test_boolean(tf):
    cases = {"one & three": [1], "one | three": [1, 2, 3, 5], "three - two": [3], "zzz": [], "(one | two) & (three | four)": [1, 2], "one - two - three": [1, 5]}
    for text, want in cases.items():
        assert ids(boolean.search(tf, text)) == want, text
        assert ids(boolean.search_by_sets(tf, text)) == want, text
    for bad in ("", "a &", "(a", "a b"):
        with pytest.raises(ValueError):
            boolean.parse(bad)
    assert all(boolean.parse(q) for q in boolean.templates(["a", "b"]) + boolean.templates(["a", "b", "c"]))


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "aaa bbb xxx bbb ccc"), (2, "aaa bbb ccc"), (3, "ccc xxx bbb aaa"), (4, "aaa aaa")], "doc_id long, text string")
    places = positional.positions(tokenize.plain_tokens(docs))
    q = positional.literal_queries(spark, [["aaa", "bbb", "ccc"], ["aaa", "aaa"], ["aaa", "zzz"]])
    pairs = lambda df: sorted((r.query_id, r.doc_id) for r in df.collect())
    assert pairs(positional.phrase(places, q)) == [(0, 2), (1, 4)]
    assert pairs(positional.phrase_pairwise(places, q)) == [(0, 1), (0, 2), (1, 4)]
    far = positional.literal_queries(spark, [["aaa", "ccc"]])
    assert pairs(positional.proximity(places, far)) == [(0, 2), (0, 3)]


def test_ranking(tf, spark):
    q = spark.createDataFrame([(1, "two", 1), (1, "zzz", 2), (2, "four", 1)], "query_id long, term string, qtf long")
    n, df = 4, 2
    for name in retrieval.SCHEMES:
        got = retrieval.rank(tf, q, name).collect()
        assert {(r.query_id, r.doc_id) for r in got} <= {(1, 1), (1, 2), (2, 2)}, name
    best = [r.doc_id for r in retrieval.rank(tf, q, "tfidf").where("query_id = 1").orderBy("rank").collect()]
    assert best[0] == 1
    assert sorted(ids(retrieval.all_terms(tf, q).where("query_id = 1"))) == [1, 2]
    assert math.log10(n / df) > 0


def test_spearman(spark):
    a = spark.createDataFrame([(1, d, r) for r, d in enumerate("abcd", 1)], "query_id long, doc_id string, rank int")
    b = spark.createDataFrame([(1, d, r) for r, d in enumerate("abcx", 1)], "query_id long, doc_id string, rank int")
    got = {r.doc_id: (r.ra, r.rb) for r in evaluation.augmented(a, b).collect()}
    assert got == {"a": (1, 1), "b": (2, 2), "c": (3, 3), "d": (4, 5), "x": (5, 4)}
    assert evaluation.spearman(a, a).first().rho == 1.0


def test_language(spark):
    train = spark.createDataFrame([(1, "the thing that then", "en"), (2, "le les la elle", "fr")], "doc_id long, text string, lang string")
    test = spark.createDataFrame([(1, "that thing"), (2, "elles le la"), (3, ""), (4, None)], "doc_id long, text string")
    for kind in language.GRAMS:
        got = {r.doc_id: r.lang_pred for r in language.predict(test, language.profiles(train, kind), kind).collect()}
        assert got == {1: "en", 2: "fr", 3: None, 4: None}, kind


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    ranks = {r.id: r.score for r in graph.pagerank(e, 60).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-9 and ranks["c"] > ranks["d"]
    scores = {r.id: (r.hub, r.authority) for r in graph.hits(e, 5).collect()}
    assert abs(sum(h for h, _ in scores.values()) - 1) < 1e-9 and scores["d"][0] == 0
    pages = spark.createDataFrame(
        [(1, "http://h.org/", '<a href="/a">x</a><a href="/b">x</a><a href="/a#z">y</a>'), (2, "http://h.org/a", '<a href="http://o.org/q">o</a>')], "page_id long, url string, html string"
    )
    seeds = spark.createDataFrame([("http://h.org/",)], "url string")
    got = {(r.url, r.depth, r.found) for r in graph.crawl(pages, seeds).collect()}
    assert got == {("http://h.org/", 0, True), ("http://h.org/a", 1, True), ("http://h.org/b", 1, False), ("http://o.org/q", 2, False)}
    assert graph.crawl(pages, seeds, per_host=2).count() == 3 and graph.crawl(pages, seeds, limit=1).count() == 1
    one = spark.createDataFrame([("a", 1), ("b", 2)], "id string, row long")
    two = spark.createDataFrame([("b", 1), ("a", 2)], "id string, row long")
    assert sorted((r.i, r.overlap) for r in graph.overlap(one, two).collect()) == [(0, 0.0), (1, 0.0)]


def test_sources_and_sinks(spark, tmp_path, tf, docs):
    (tmp_path / "c" / "sub").mkdir(parents=True)
    (tmp_path / "c" / "x.txt").write_text("uno dos\ntres")
    (tmp_path / "c" / "sub" / "y.txt").write_text("cuatro")
    got = readers.documents(spark, str(tmp_path / "c"))
    assert sorted((r.doc_id, r.name) for r in got.collect()) == [(1, "y.txt"), (2, "x.txt")] and readers.lines(got).count() == 3
    f = tmp_path / "f.txt"

    def read(reader, text):
        f.write_text(text)
        return [tuple(r) for r in reader(spark, str(f)).collect()]

    assert sorted(read(readers.stop_words, "el, la,los\n")) == [("el",), ("la",), ("los",)]
    assert read(readers.topics, "<TOP>\n<TITLE>first one\n</TOP>\n<TOP>\n<TITLE>second\n") == [(1, "first one"), (2, "second")]
    assert read(readers.run, "1 Q0 d7 0 1.5 m\n")[0][2:5] == ("d7", 0, 1.5)
    assert read(readers.postings_text, "casa:3:7,1,4,\n") == [("casa", 3, [1, 4, 7])]
    assert read(readers.document_terms, "head\ndoc 3: (4, 5)\n") == [(3, [4, 5])]
    assert read(readers.vocabulary, "id\tidf\tterm\n4\t0.5\tx\n") == [(4, 0.5, "x")]
    assert read(readers.structured_queries, "#q2 = or('alpha' 'beta')\n") == [(2, ["alpha", "beta"])]
    cisi = ".I 1\n.T\nA title\n.A\nWho\n.W\nline one\nline two\n.X\n1 2\n.I 2\n.T\nB\n.W\nother words here\n"
    assert read(readers.cisi_documents, cisi) == [(1, "A title", "Who", "line one line two"), (2, "B", "", "other words here")]
    assert read(readers.cisi_queries, ".I 1\n.W\nalpha be gamma\n") == [(1, ["alpha", "gamma"])]
    writers.term_dictionary(statistics.term_statistics(tf), str(tmp_path / "dict"))
    assert spark.read.text(str(tmp_path / "dict")).count() == tf.select("term").distinct().count()
    writers.statistics(statistics.collection_statistics(tokenize.plain_tokens(docs)), str(tmp_path / "stats"))
    assert spark.read.text(str(tmp_path / "stats")).count() == 6


def test_stream_index(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    want = tokenize.term_frequencies(tokenize.plain_tokens(docs)).count()
    assert incremental.indexed(spark, str(tmp_path / "out")).count() == want


def test_hits_to_tolerance(spark):
    import numpy as np

    pairs = [(a, b) for a in range(12) for b in range(12) if (a * 7 + b * 5) % 4 == 0 or b == 0]
    got = {r.id: (r.hub, r.authority) for r in graph.hits(spark.createDataFrame(pairs, "src long, dst long"), 30, tolerance=1e-8).collect()}
    m = np.zeros((12, 12))
    for a, b in pairs:
        m[a, b] = 1
    h = np.ones(12)
    for _ in range(200):
        a = m.T @ h / (m.T @ h).sum()
        h = m @ a / (m @ a).sum()
    assert all(abs(got[i][0] - h[i]) < 1e-7 and abs(got[i][1] - a[i]) < 1e-7 for i in range(12))


def test_heaps_query_has_every_token(spark):
    from termloom.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = tokenize.plain_tokens(spark.read.parquet(f"{folder}/documents.parquet")).collect()
    seen, want = set(), []
    for i, r in enumerate(sorted(rows, key=lambda r: (r.doc_id, r.pos)), 1):
        seen |= {r.term} - {None}
        want.append((i, len(seen)))
    assert sorted((r.tokens, r.terms) for r in QUERIES["heaps_curve"](spark, folder).collect()) == want


def test_pagerank_to_tolerance(spark):
    import numpy as np

    pairs = [(a, (a * 5 + k) % 11) for a in range(9) for k in range(1 + a % 3)]
    got = {r.id: r.score for r in graph.pagerank(spark.createDataFrame(pairs, "src long, dst long").distinct()).collect()}
    out = np.zeros((11, 11))
    for a, b in set(pairs):
        out[a, b] = 1
    p = np.full(11, 1 / 11)
    for _ in range(500):
        spread = np.where(out.sum(1) > 0, p / np.maximum(out.sum(1), 1), 0)
        p = 0.2 / 11 + 0.8 * (out.T @ spread + p[out.sum(1) == 0].sum() / 11)
    assert all(abs(got[i] - p[i]) < 1e-9 for i in got) and len(got) == 11


def test_blocks_of_long_lists(spark):
    """Gaps, skips and codes are the same in blocks of few document numbers."""
    from termloom.operators import index

    rows = [(d, t, 1 + d % 4) for t in ("a", "b") for d in range(0, 200, 3 if t == "a" else 7)]
    tf = spark.createDataFrame(rows, "doc_id long, term string, tf long")
    whole = {(r.term, r.doc_id): (r.idx, r.before, r.df) for r in index.placed(tf).collect()}
    assert whole == {(r.term, r.doc_id): (r.idx, r.before, r.df) for r in index.placed(tf, 10).collect()}
    assert whole["a", 9] == (4, 6, 67) and whole["b", 0] == (1, None, 29)
    for method in ("vb", "gamma"):
        for gapped in (True, False):
            codes = index.compressed_index(tf, method, gapped, 10)
            assert codes.count() > 2
            back = index.decompressed(codes, method, gapped).collect()
            assert sorted((r.doc_id, r.term, r.tf) for r in back) == sorted(rows)


def test_skip_intersection(spark, tmp_path):
    from termloom.operators import index

    rows = [(d, "long", 1) for d in range(0, 400, 2)] + [(d, "short", 1) for d in (3, 4, 150, 151, 398, 401)] + [(7, "one", 1)]
    tf, path = spark.createDataFrame(rows, "doc_id long, term string, tf long"), str(tmp_path / "i")
    index.write_index(tf, path)
    index.write_skips(tf, path)
    ids = lambda *terms: sorted(r.doc_id for r in index.skip_intersection(spark, path, *terms).collect())
    assert ids("long", "short") == ids("short", "long") == [4, 150, 398]
    assert ids("one", "short") == [] and ids("long", "nothing") == [] and ids("one", "one") == [7]


def test_helpers_keep_own_columns(spark):
    """Inputs may have columns of any name."""
    from termloom.plans.common import numbered, running_sums

    names = ["_at", "_part", "_n", "_start", "_block", "_v", "at", "part", "block"]
    df = spark.createDataFrame([(i * 10**9, i, *[f"{c}{i}" for c in names]) for i in range(9)], ", ".join(["k long", "v long", *[f"{c} string" for c in names]]))
    for out in (numbered(df, "k"), running_sums(df, "k", {"v": "total"}, block=2)):
        assert all(r[c] == f"{c}{r.v}" for r in out.collect() for c in names)
    assert {r.v: r.row for r in numbered(df, "k").collect()} == {i: i + 1 for i in range(9)}
    assert {r.v: r.total for r in running_sums(df, "k", {"v": "total"}, block=2).collect()} == {i: i * (i + 1) // 2 for i in range(9)}


def test_inner_proper_names(spark):
    from termloom.functions import text as X

    texts = ["Ana went to Buenos Aires. Then Juan Perez saw Luis.", "Only", "we saw The Beatles and Al", "x Rosa, y Maria Jose z"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.n for r in df.select(X.proper_names_inside("text", ["the"]).alias("n")).collect()]
    want = [[m for m in (x.strip() for x in re.findall(X.PROPER_NAME_INSIDE, t)) if m.lower() != "the" and 3 <= len(m) <= 25] for t in texts]
    assert got == want and "Buenos Aires" in [x for r in got for x in r] and not any("Ana" in r or "Then" in r for r in got)


def test_detectors(spark):
    from termloom.operators import language

    df = spark.createDataFrame([(1, "der und"), (2, None)], "doc_id long, text string")
    of_column = language.detected(df, lambda c: F.when(c.contains("der"), "de").otherwise("en"))
    of_series = language.detected(df, lambda texts: ["de" if "der" in t else "en" for t in texts])
    assert sorted(of_column.collect()) == sorted(of_series.collect()) == [(1, "de"), (2, "en")]


def test_round_trips_against_sql(spark):
    """Some of the queries that write and read files, against their SQL."""
    import os

    import duckdb

    import __spark_entry__

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from read_parquet('{folder}/{f}')")
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    for name in ("source_flat", "source_names", "trec_topics", "source_cisi_documents", "source_structured_queries", "crawl_csv", "sink_timings", "stored_posting", "rank_tfidf"):
        df = queries[name](spark, folder)
        got = con.execute(sql[name])
        columns = [d[0] for d in got.description]
        mine = sorted(tuple(map(str, r)) for r in df.select(*columns).collect())
        assert mine == sorted(tuple(map(str, r)) for r in got.fetchall()), name
