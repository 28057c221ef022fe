"""One query for each operator, and DuckDB's equivalent where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, embeddings, lines, mixing, neardup, packing, pii, quality, sampling, search, substrings, tokens, toxicity
from .oracles import ORACLE_SQL  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.ledger(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    measures = [F.col(m) for m in quality.MEASURES[:5]]
    base_failed = ~quality.passes("base")
    return rows.select("doc_id", *measures, base_failed.alias("base_failed"), (~base_failed & quality.passes("v1")).alias("kept"), "fail_bits")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(_read(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op5_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.sample_pieces(_read(spark, sf_dir, "documents"), digest=True)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines.drop_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find_personal(_read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    order = F.create_map(*[x for i, k in enumerate(pii.KINDS) for x in (F.lit(k), F.lit(i))])

    def text(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    placed = F.transform(F.concat("base", "added"), lambda s: F.struct(order[s["kind"]].alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    rows = rows.withColumn("spans", F.array_sort(placed))
    return rows.select("doc_id", *map(count, pii.KINDS[:4]), F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"), F.size("added").cast("long").alias("n_added"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.drop_repeats(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(conversations.repair(conversations.damage(_read(spark, sf_dir, "conversations"))))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank_documents(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_quality_rules": op2_quality_rules,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_token_packing": op5_token_packing,
    "op6_mixing": op6_mixing,
    "op7_sentencepiece_sampling": op7_sentencepiece_sampling,
    "op8_line_dedup": op8_line_dedup,
    "op9_personal_data": op9_personal_data,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_token_counts": op11_token_counts,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_lexical_search": op13_lexical_search,
}
