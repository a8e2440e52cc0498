"""Registered queries of this subpackage: each operator with production parameters on its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenderlens.llm import (bpe, chat_trees, crf_quality, exact_dedup, importance, kmeans_tree, line_blocks, merkle,
                            mixing, prefix_join, rule_forest, secrets, toxicity)
from tenderlens.llm.common import fold, table
from tenderlens.llm.oracle import ORACLE

RANKS = "byte_bpe_50k.tiktoken"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = crf_quality.train(docs, table(spark, sf_dir, "labels"))
    return crf_quality.score(docs, model, out="score").select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(
        F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(marked).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    chats = chat_trees.format_trees(chat_trees.threads(rows))
    read = chats.select("tree", "formatted", chat_trees.read_turns(F.col("formatted")).alias("turns"),
                        chat_trees.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").alias("conv_id"), F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocate(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return line_blocks.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_join.near_duplicates(table(spark, sf_dir, "documents"), words=3, similar=90)


def vocabulary(spark: SparkSession) -> bpe.Vocabulary:
    return bpe.Vocabulary.load(spark, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocabulary(spark))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, out="score").select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
        toxicity.rejected(model, F.col("score"), F.col("lang")).alias("rejected"))


def op9_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return kmeans_tree.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10, vec="embedding")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan(docs)

    def written(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    counts = [count(kind) for kind in ("assign", "access", "hex", "entropy")]
    return found.select("doc_id", *counts[:3], F.sha2(written(base), 256).alias("base_sha256"),
                        written(F.col("secrets")).alias("spans"), counts[3])


def op11_rule_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rule_forest.judge(docs, table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.verify(table(spark, sf_dir, "documents"), marked)


QUERIES = {f.__name__: f for f in (
    op1_exact_dedup, op2_quality, op3_chat_format, op4_mixing, op5_main_text, op6_prefix_join, op7_bpe,
    op8_toxicity, op9_kmeans_tree, op10_secrets, op11_rule_forest, op12_resampling, op13_merkle)}
__all__ = ["ORACLE", "QUERIES"]
