"""The corpus pipeline: documents to packed training sequences, one operator a stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Every row is decided by its
own text, also where rows share a doc_id or have none. Further columns stay as they are. An empty table stays empty.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfare.llm import decontamination, jaccard, packing, secret_scan, toxicity
from wayfare.llm.shared import few, materialise, own_keys, shared_dir, table

#: A document is toxic from this score on.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the lexicon scores as toxic; it learns from the labelled rows that op4 learns from.

    Null and empty texts have the score of a text without hits. Without labels of both classes nothing is dropped.
    """
    usable = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable)
    return docs.where(toxicity.score(F.col("text"), lexicon) < TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first row, by id (nulls last), of each group of near copies (five-word sets, similarity 0.8 or more).

    Null and empty texts are one group; every row is compared with its own text, whether or not others share its id.
    """
    keyed, _ = own_keys(docs, "doc_id", ["text"], "near-rows", "_row_key")
    found = jaccard.similar(keyed, id_col="_row_key").where("id <> class_id").select(F.col("id").alias("_row_key"))
    return keyed.join(few(materialise(found, "near-duplicates")), "_row_key", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text overlaps a benchmark item; null and empty texts overlap none."""
    found = decontamination.by_text(docs, table(spark, sf_dir, "benchmark")).select("id", "text_key").distinct()
    found = few(materialise(found, "contaminated"))
    return docs.join(found, docs["doc_id"].eqNullSafe(found["id"]) & (decontamination.text_key(docs["text"]) == found["text_key"]), "left_anti").select(docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret in the text and counts its characters anew; no document is dropped.

    Null texts stay null; repeated rows are redacted each.
    """
    found = secret_scan.scan_versions(docs, path_col="doc_id", text_col="text", ledger=shared_dir(spark, "secret-ledger")).where("size(spans) > 0")
    found = few(materialise(found.dropDuplicates(["path", "blob"]).toDF("_path", "_blob", "_spans"), "secrets"), weight=40 * F.size("_spans") + 64)
    text = docs["text"]
    same = docs["doc_id"].eqNullSafe(found["_path"]) & (secret_scan.content_address(text) == found["_blob"])
    clean = F.when(F.col("_spans").isNull(), text).otherwise(secret_scan.redact(text, F.col("_spans")))
    changed = docs.join(found, same, "left").select(*[clean.alias("text") if c == "text" else docs[c] for c in docs.columns])
    return changed.withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens, with their ids (little-endian unsigned 32-bit).

    Null and empty texts are the end id alone.
    """
    return packing.pack_texts(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: SQL can't express the learned lexicon, the tokenizer and the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
