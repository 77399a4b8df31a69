"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import ann, decontaminate, langid, mixing, neardup, quality, secrets, sharding, tokens, toolcalls
from .common import table


def op1_neighbours(spark, sf_dir):
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op2_quality(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_tool_calls(spark, sf_dir):
    return toolcalls.format_chats(table(spark, sf_dir, "conversations"))


def op4_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op5_near_duplicates(spark, sf_dir):
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_language(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark, sf_dir):
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op9_mix(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents")).placed().select("doc_id", "shard_id", "shard_row")


QUERIES = {
    "op1_neighbours": op1_neighbours,
    "op2_quality": op2_quality,
    "op3_tool_calls": op3_tool_calls,
    "op4_secret_scan": op4_secret_scan,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_language": op6_language,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_counts": op8_token_counts,
    "op9_mix": op9_mix,
    "op10_shards": op10_shards,
}

ORACLE_SQL = {
    "op9_mix": mixing.ORACLE_SQL,
}
