"""Queries of this subpackage, each over its whole intended table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import byte_bpe, byte_cnn, compression, filter_audit, fingerprint, mixing, neardup, pieces, preference, pseudonyms, resampling, secret_scan, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path("piece_bpe_32k.model"))


def byte_vocabulary() -> bytes:
    import public_tokenizers

    return pieces.read_model(public_tokenizers.path("byte_bpe_50k.json"))


def op1_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = preference.formatted(preference.neighbour_pairs(_table(spark, sf_dir, "conversations")))
    masks = [F.expr(preference.span_text(f"{side}_spans")).alias(f"{side}_mask") for side in ("chosen", "rejected")]
    return found.select("pair_id", "n_common", "prompt", "chosen", "rejected", *masks)


def op2_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), secret_scan.default_forest(spark))


def op3_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.rules(_table(spark, sf_dir, "documents"))


def op4_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(spark, sf_dir)
    return found.select("doc_id", "text", F.size("findings").cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct("findings.kind")), " ").alias("kinds"))


def pseudonymised(spark: SparkSession, sf_dir: str, key: str = "a demonstration key; a real one comes from a key store") -> DataFrame:
    return pseudonyms.pseudonymised(_table(spark, sf_dir, "documents"), key)


def op5_entropy_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = mixing.sized(_table(spark, sf_dir, "documents"))
    mixed = mixing.mix(sizes, mixing.share_out(mixing.cyclic_weights(sizes)))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies")


def op6_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    texts, known, odds = byte_cnn.sample(docs, labels.filter(~held_out))
    weights = byte_cnn.fit(texts, known, odds=odds) if texts else None
    found = byte_cnn.scores(docs, weights)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents"))


def op8_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprint.grouped(fingerprint.edits(docs), docs)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip_digests(_table(spark, sf_dir, "documents"), piece_model())


def op10_url_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judged(pages, url_filter.fit(url_filter.examples(pages)))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip_digests(_table(spark, sf_dir, "documents"), byte_vocabulary())


def queries() -> dict:
    found = (
        op1_preference_pairs,
        op2_secret_forest,
        op3_compression_bands,
        op4_feistel_pseudonyms,
        op5_entropy_mixing,
        op6_byte_cnn,
        op7_dart_minhash,
        op8_canonical_digest,
        op9_sentencepiece,
        op10_url_markov,
        op11_filter_audit,
        op12_importance_resampling,
        op13_byte_bpe,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_preference_pairs": preference.ORACLE, "op11_filter_audit": filter_audit.ORACLE}
