"""Thin registered queries: each reads its whole table and applies its operator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import best_fit_packing as packing
from . import language_id as language
from . import katz, media_avi, near_dedup, piece_transducer, pii, sharding, token_matrix
from . import quality_rules as quality


TRUSTED_LOSS = 0.01  # of the trusted documents of a language, below its cut


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_bpe() -> str:
    """The word vocabulary's file; operators take any other path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_prob_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for every document; its id is the least doc_id in it."""
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op2_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7; law ``rows``: counts differ by one at most."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = sharding.consistent_hash_shards(docs, "doc_id", shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard", "hops")


def op3_avi_shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's AVI file, of what is read back from it, and of its clips."""
    stored = media_avi.write_media(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    back = media_avi.read_media(stored)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media, payload, shots = (batch.column(c).to_pylist() for c in ("media", "payload", "clips"))
            feature = ["; ".join(f"{c['start_s']:g}-{c['end_s']:g}:{c['mean']:g}" for c in x) for x in shots]
            made = [
                pa.array(map(len, payload), pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in payload], pa.string()),
                pa.array([zlib.crc32(p[-64:]) for p in payload], pa.int64()),
                pa.array(map(len, media), pa.int64()),
                pa.array([hashlib.sha256(m).hexdigest() for m in media], pa.string()),
                pa.array(feature, pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *made], names)

    return back.mapInArrow(digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_token_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_matrix.token_matrix(_table(spark, sf_dir, "documents"), word_bpe())


def op5_complement_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"), word_bpe())


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.crc_bucket(F.col("doc_id"), 5) == 0)
    out = language.identify_language(docs.select("doc_id", "held_out", "text"), docs.where("not held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score")


def op7_deobfuscated_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2(F.encode("base", "UTF-8"), 256).alias("base_sha256"), "spans")


def op8_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document and, decoded from them, the CRC of its text again."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    encoded = piece_transducer.encode_pieces(_table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    out = piece_transducer.decode_pieces(encoded, path)
    crc = lambda c: F.crc32(F.encode(c, "UTF-8"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", crc("decoded").alias("decoded_crc32"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op9_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").withColumn("held_out", language.crc_bucket(F.col("doc_id"), 10) == 0)
    out, model = katz.katz_scores(docs)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the documents that are labelled as of good quality."""
    return _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")


def op10_ngram_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality_rules(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), trusted(spark, sf_dir), group="lang", loss=TRUSTED_LOSS)
    return out.select("doc_id", *quality.MEASURES, "ratio", "kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_prob_minhash, op2_ring_shards, op3_avi_shots, op4_token_matrix, op5_complement_packing, op6_cross_parsing, op7_deobfuscated_pii, op8_piece_transducer, op9_katz_backoff, op10_ngram_ratio)
    }


def oracle_sql() -> dict[str, str]:
    return {}
