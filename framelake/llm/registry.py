"""The registered queries of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm import bytepairs, lm, manifest, neardup, oracles, packing, phrases, pieces, quality, secrets, suffixes, topk, toxicity, urls
from framelake.llm.shared import ascii_lower

#: Fixed rules of the URL query.
URL_RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=80, k=2)


def op2_piece_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op3_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vecs = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_products(vecs, F.col("vec_id") % 20 == 0, k=20)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.crc32(F.col("doc_id").cast("string")) % 7
    scores = lm.interpolated_scores(table(spark, sf_dir, "documents"), train=part != 2, tune=part == 3)
    return scores.select("doc_id", F.coalesce(part == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def line_frequency_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rules with limits that small tables reach: lines in two texts of a host and 1 % of them, documents that lose a fiftieth."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality.quality_rules(docs, max_percent=1, min_docs=1, min_share=0.98).select("doc_id", "n_words", "base_failed", "kept")


def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), length=400, digest=True, counted=51)


def op7_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return urls.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op8_confirmed_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op9_prefix_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.token_counts(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op11_bucket_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine_phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = toxicity.train(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"), usable=part != 0)
    scores = toxicity.toxicity(docs, model)
    return scores.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, manifest.leaf(*rest, ascii_lower(F.col("text"))))
    found = manifest.merkle_manifest(docs, carry={"tampered": tampered})
    folded = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("proof")))
    return folded.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


QUERIES = {f.__name__: f for f in (
    line_frequency_strict,
    op1_superminhash, op2_piece_offsets, op3_norm_buckets, op4_deleted_interpolation, op5_line_frequency, op6_suffix_arrays, op7_link_trust, op8_confirmed_secrets, op9_prefix_counts, op10_hilbert_packing,
    op11_bucket_phrases, op12_string_kernel, op13_merkle_manifest)}
ORACLES = oracles.ORACLES
