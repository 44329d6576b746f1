"""The queries of the training-data operators, with the contract's parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprint, html, language, media, mixing, neardup, oracles, phrases, pii, quality, urls, warc, whitening
from .common import bounded_batches, table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its component of two-word shingle sets of similarity 0.8 or more."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2, percent=80).drop("th", "set_key")


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words that lie in windows of 13 words of ``benchmark``."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), span=13).drop("th")


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data: base spans, their digest, and all spans with those of disclosing terms."""
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    found = pii.personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(count(k) for k in pii.PATTERNS), F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its score; labels of held-out documents are not learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    return quality.scored(docs.select("doc_id", "text"), model, 0.7).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_warc_chunked_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record, read back: equal payloads are stored once."""
    return warc.restored(warc.archived(table(spark, sf_dir, "pages"), min_bytes=0))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its nearest language; held-out documents are not learned from."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    profiles = language.learn(docs.where(~held_out))
    return language.identified(docs.select("doc_id", "text"), profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the words of it that the mixture takes."""
    out = mixing.mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with the rule that decides its url, or the list."""
    return urls.judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with fingerprints of its text and its edited text, and their likeness."""
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op10_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with its main text."""
    return html.main_texts(table(spark, sf_dir, "pages"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector of ``embeddings`` on up to 32 whitened components."""
    return whitening.whitened(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=32)


def op12_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` as a baseline JPEG, read back; feature is the image's size and its thumbnail's hash."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("payload"))
    files = media.stored(docs).select("doc_id", F.coalesce(F.length("payload"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    files = files.withColumn("media_bytes", F.length("media").cast("long")).withColumn("media_sha256", F.sha2("media", 256))
    read = media.media_columns(files)
    feature = F.concat(F.col("width"), F.lit("x"), F.col("height"), F.lit(":"), F.col("thumbnail_hash"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best 2,000 phrases of ``documents`` (lang, rank, phrase, a, l, r, n, score)."""
    return phrases.collocations(table(spark, sf_dir, "documents"), least=30, first=2000, percent=80)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bounded_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_minhash_near_dedup, op2_benchmark_decontamination, op3_personal_data, op4_quality_classifier, op5_warc_chunked_records,
        op6_language_id, op7_source_mixing, op8_url_filter, op9_document_fingerprints, op10_html_main_text, op11_embedding_whitening, op12_media_columns, op13_phrase_collocations,
    )
    return {q.__name__: _bounded(q) for q in every}


def oracle_sql() -> dict[str, str]:
    """The others hang on learned models, seeded samples or Python's text rules; tests hold them to brute force."""
    return {
        "op1_minhash_near_dedup": oracles.NEAR_DEDUP,
        "op2_benchmark_decontamination": oracles.CONTAMINATION,
        "op5_warc_chunked_records": oracles.ARCHIVED,
        "op13_phrase_collocations": oracles.COLLOCATIONS,
        "op8_url_filter": oracles.url_filter(urls.RULES, urls.BLOCKLIST, urls.NAMES),
    }
