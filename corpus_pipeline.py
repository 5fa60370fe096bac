"""Corpus preparation in five stages, each a function of (spark, docs, sf_dir).

quality     keeps the documents that the positive-unlabelled classifier scores at 0.7 or more
near_dups   keeps one document, the smallest id, of each group of near copies
pii         masks personal data in the text and corrects n_chars; every document stays
mixing      takes documents by source budgets: the target weights over one epoch
bpe         encodes the text; (doc_id, n_tokens, ids)

All but the last return the columns of documents. Null and empty texts pass through the
stages as their operators define: nulls and empty texts are scored by the classifier like
others, link with nothing, hold no personal data and take no budget; a null id stays null and
is no one's copy. Rows that repeat an id stay or go together, but for quality, which judges each
text, and the mixture, which may end its budget between them. The first four stages hand on every
column of their input under its name, with its values, also those that an operator adds for its
own work; masking changes text and n_chars alone. Each stage reads what its predecessor wrote;
when the next one has been written, that is deleted.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptloom.llm import bpe, minhash, mixing, pii, quality
from scriptloom.llm.components import without
from scriptloom.llm.queries import DOMAIN_SQL, WEIGHTS
from scriptloom.session import checkpoint_folder, delete_folder, durable, read_table

#: Hundredths of all tokens that the mixture may hold.
MIX_PERCENT = 90


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that score 0.7 or more; without positive labels every row scores 0.5 and goes."""
    model = quality.train(quality.featurise(docs), read_table(spark, sf_dir, "labels"), lambda c: F.lit(True))
    return quality.keep_good(docs, model, threshold=0.7)


def near_dups_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that repeat the id of a kept document are kept with it, and so are null ids."""
    found = minhash.near_duplicates(docs, width=5, percent=80, bands=25, rows=5)
    gone = durable(found.where(~F.col("kept")).select("doc_id").distinct())
    return without(docs, "doc_id", gone, gone.count())


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, with personal data masked; null texts stay null."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each text taken, with all its columns as they were."""
    held = {c: f"held_{i}" for i, c in enumerate(docs.columns)}
    own = docs.select("doc_id", "text", "lang", "source", *(F.col(c).alias(name) for c, name in held.items()))
    taken = mixing.mix(own, F.expr(DOMAIN_SQL), WEIGHTS, percent=MIX_PERCENT, max_epochs=1, seed=17, payload=list(held.values()))
    return taken.select(*(F.col(name).alias(c) for c, name in held.items()))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every row; null and empty texts have none."""
    return bpe.encode_column(docs)


STAGES = [("quality", quality_stage), ("near_dups", near_dups_stage), ("pii", pii_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: Fitted models and hashes are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written and read again by the next."""
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
