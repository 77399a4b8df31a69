import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions import compress, html, stem
from termloom.functions import text as X


@given(st.lists(st.integers(1, 1 << 40)))
def test_codes_round_trip(numbers):
    assert compress.vb_decode(compress.vb_encode(numbers)) == numbers
    assert compress.gamma_decode(*compress.gamma_encode(numbers)) == numbers


def test_codes_edges():
    numbers = [1, 127, 128, 16383, 16384, 70000]
    assert compress.vb_decode(compress.vb_encode(numbers)) == numbers
    with pytest.raises(ValueError):
        compress.gamma_encode([0])


def test_code_sizes_as_columns(spark):
    numbers = [1, 2, 127, 128, 16383, 16384, 70000]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", compress.vb_bytes("n").alias("v"), compress.gamma_bits("n").alias("g")).collect()
    for n, v, g in rows:
        data, padding = compress.gamma_encode([n])
        assert v == len(compress.vb_encode([n])) and g == 8 * len(data) - padding


def test_porter_and_lancaster():
    for word, want in {"caresses": "caress", "ponies": "poni", "relational": "relat", "hopping": "hop", "happy": "happi", "rate": "rate", "probate": "probat", "controll": "control"}.items():
        assert stem.porter(word) == want
    for word, want in {"maximum": "maxim", "presumably": "presum", "multiply": "multiply", "provision": "provid", "owed": "ow", "ear": "ear"}.items():
        assert stem.lancaster(word) == want


def test_spanish():
    for word, want in {"universidad": "univers", "universidades": "univers", "chicas": "chic", "torneadas": "torn", "cosas": "cos", "nacionalidad": "nacional"}.items():
        assert stem.spanish(word) == want


def test_visible_text():
    page = "<html><head><title>t</title></head><body><!-- c --><p>a <b>b</b></p><script>var x='</p>'</script>c &amp; d</body>"
    assert html.visible(page) == "a b c & d"
    assert html.visible("") == "" and html.visible(None) is None


def test_token_kinds(spark):
    want = {"12.5": "number", "4|5": "number", "abc123456789": "number", "u.s.a": "abbreviation", "NASA": "abbreviation", "a@b.com": "mail_url", "http://a.b.org/x1": "mail_url", "1/2/2020": "date", "2021-12-09": "date", "house": "plain"}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", X.kind("t").alias("k")).collect()
    assert {r.t: r.k for r in rows} == want


def test_clean_special_drops_hyphens(spark):
    assert spark.range(1).select(X.clean_special(F.lit("2021-12-09"))).first()[0] == "20211209"


def test_grams(spark):
    row = spark.createDataFrame([("aB c\nd",), ("",), ("x",)], "t string").select(X.letters(F.col("t")).alias("l"), X.bigrams(F.col("t")).alias("b")).collect()
    assert row[0].l == list("abcd") and row[0].b == ["ab", "b ", "c\n", "\nd"]
    assert row[1].l == [] and row[1].b == [] and row[2].b == []


def test_links(spark):
    df = spark.createDataFrame([("http://h.org/a", "/b#x"), ("h.org/", "http://o.org/#t")], "u string, l string")
    assert [r[0] for r in df.select(X.link_target("u", "l")).collect()] == ["http://h.org/a//b", "http://o.org/"]
    assert df.select(X.resolved_target("u", "l")).first()[0] == "http://h.org/b"
