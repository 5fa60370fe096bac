"""The operators as queries over the driver's tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import durable, read_table, scratch_folder
from . import bpe, dialogue, lattice, lexical, lm, media, minhash, mixing, pii, quality, secret_scan, suffixes, toxicity
from .common import crc_fold


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read_table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"))


def op3_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_vectors(read_table(spark, sf_dir, "embeddings"), threshold=0.93)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    held_out = crc_fold(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted", "passages")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    with scratch_folder(spark, "media") as folder:
        index = durable(media.index_media(media.store_media(docs, "text", folder)).drop("file", "row"))
    sequences = media.interleave(media.pages_of(docs, "doc_id", "text"), "doc_id", "html")
    # of the sequence and its captions only digests are shuffled
    ordered = sequences.select("doc_id", "items", F.size("items").alias("n_items"), F.sha2(F.to_json("items").cast("binary"), 256).alias("items_sha256"))
    refs = media.references(ordered, ["doc_id", "n_items", "items_sha256"]).withColumns({"items_sha256": F.unhex("items_sha256"), "positions": F.array_join("positions", ","), "captions_sha256": F.unhex(F.sha2(F.to_json("captions").cast("binary"), 256))}).drop("captions")
    found = media.resolve(refs, index)
    hashes = {c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256", "items_sha256", "captions_sha256")}
    return found.withColumns(hashes).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "positions", "n_items", "items_sha256", "captions_sha256")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(F.col("doc_id"), 5) == 1
    scored = lm.score_texts(read_table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality.featurise(read_table(spark, sf_dir, "documents"))
    model = quality.train(table, read_table(spark, sf_dir, "labels"), lambda c: crc_fold(c, 4) != 2)
    return quality.score_quality(table, model).select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85, bands=21, rows=6)


#: Domain of a source in the mixture tree.
DOMAIN_SQL = "CASE WHEN source = 'src0' THEN 'web' WHEN source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') THEN 'books' WHEN source IN ('src7', 'src8', 'src9', 'src10', 'src11', 'src12', 'src13') THEN 'forums' ELSE 'reference' END"
WEIGHTS = {"domain": {"web": 40, "books": 30, "forums": 10, "reference": 20}, "lang": {"en": 50, "de": 20, "fr": 20, "es": 10}, "source": {}}


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), F.expr(DOMAIN_SQL), WEIGHTS, percent=120, max_epochs=3, seed=17)


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10).select("item_id", "rank", "doc_id", "score")


def op12_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.without_repeats(read_table(spark, sf_dir, "documents"), length=200)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogue.audit_damaged(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": op1_secrets,
        "op2_bpe": op2_bpe,
        "op3_lattice": op3_lattice,
        "op4_pii": op4_pii,
        "op5_toxicity": op5_toxicity,
        "op6_media": op6_media,
        "op7_lm": op7_lm,
        "op8_quality": op8_quality,
        "op9_minhash": op9_minhash,
        "op10_mixing": op10_mixing,
        "op11_lexical": op11_lexical,
        "op12_suffixes": op12_suffixes,
        "op13_dialogue": op13_dialogue,
    }
