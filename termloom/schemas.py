"""Schemas of the tables that operators exchange, as DDL."""

DOCUMENTS = "doc_id bigint, name string, text string, size_bytes bigint"
TOKENS = "doc_id bigint, pos int, token string, kind string"
TERM_FREQUENCIES = "doc_id bigint, term string, tf bigint"
TERMS = "term string, cf bigint, df bigint"
POSTINGS = "term string, doc_id bigint, tf bigint"
POSITIONS = "term string, doc_id bigint, tf bigint, positions array<int>"
RUN = "query_id string, iter string, doc_id string, rank int, score double, model string"
EDGES = "src string, dst string"
PAGES = "id bigint, url string, outlinks array<bigint>, depth int, p_depth int, dynamic boolean"
