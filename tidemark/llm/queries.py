"""The registered queries of this subpackage, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    cover_tree,
    decontaminate,
    fill_in_middle,
    html_text,
    line_dedup,
    lm,
    minhash,
    packing,
    quality,
    secret_scan,
    sharding,
    spelling,
    toxicity,
)
from tidemark.llm.common import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = minhash.near_duplicates(docs, shingle_words=3, numerator=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html_text.main_text(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"),
        "contaminated",
    )


def tokenizer_path() -> str:
    """Where the installed word-BPE vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return lm.score_texts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.cosine_links(table(spark, sf_dir, "embeddings"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), quality.graded(table(spark, sf_dir, "labels")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    findings, _ = secret_scan.scan_increment(docs)
    spans = F.col("spans")
    base = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return secret_scan.join_back(docs, findings).select(
        "doc_id",
        *(count(kind) for kind in base),
        F.sha2(secret_scan.joined_text(F.filter(spans, lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        secret_scan.joined_text(spans).alias("spans"),
    )


def op11_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    numbered = sharding.slots(sharding.place(docs, sharding.TREE))
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        sharding.shard_of(F.col("doc_id"), sharding.grown(sharding.TREE)).alias("grown_shard"),
    )


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    restored = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored, 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_html_text": op2_html_text,
    "op3_decontaminate": op3_decontaminate,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op6_attention_lm": op6_attention_lm,
    "op7_cover_tree": op7_cover_tree,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_secret_scan": op10_secret_scan,
    "op11_hash_tree": op11_hash_tree,
    "op12_spelling": op12_spelling,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE = {
    "op3_decontaminate": decontaminate.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op10_secret_scan": secret_scan.ORACLE,
    "op11_hash_tree": sharding.ORACLE,
    "op12_spelling": spelling.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
