"""The corpus pipeline: documents in, packed training sequences out.

Each stage works on all that its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import DOCUMENT_COLUMNS, stored, table
from siftline.llm.packing import pack
from siftline.llm.quality_classifier import quality_classifier
from siftline.llm.quality_rules import quality_rules
from siftline.llm.secret_scan import secret_scan
from siftline.llm.simhash import as_hex, fingerprints, simhash_groups


def with_new_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents, with ``text`` for their text."""
    new = {"text": F.col(text), "n_chars": F.char_length(F.col(text)).cast("long")}
    return docs.select(*(new.get(c, F.col(c)).alias(c) for c in DOCUMENT_COLUMNS))


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without their failing lines."""
    judged = quality_rules(docs, [c for c in DOCUMENT_COLUMNS if c not in ("text", "n_chars")])
    return with_new_text(judged.filter("kept"), "cleaned")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among them, predicts to be good."""
    return quality_classifier(docs, table(spark, sf_dir, "labels"), DOCUMENT_COLUMNS).filter("predicted = 1").select(*DOCUMENT_COLUMNS)


#: So many ids (of eight bytes each) at most are broadcast; more are joined by a shuffle.
BROADCAST_IDS = 500_000


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates.

    A row without an id can't be the smallest of its group, nor be told from others by it: it stays. Where
    ids repeat, rows are told by id and fingerprint, and the row of the least text hash of each such pair stays. Texts are
    shuffled only then, or if more documents go than can be broadcast.
    """
    docs = docs.select(*DOCUMENT_COLUMNS)
    groups = stored(simhash_groups(docs).filter("doc_id is not null"), "groups")
    n, ids, n_gone = groups.agg(F.count("*"), F.count_distinct("doc_id"), F.count_if(F.expr("doc_id <> component_id"))).first()
    if n == ids:
        gone = groups.filter("doc_id <> component_id").select("doc_id")
        return docs.join(F.broadcast(gone) if n_gone <= BROADCAST_IDS else gone.hint("merge"), "doc_id", "left_anti").select(*DOCUMENT_COLUMNS)
    marked = fingerprints(docs, DOCUMENT_COLUMNS).withColumn("fingerprint", as_hex(F.col("bits")))
    least = groups.filter("doc_id = component_id").select("doc_id", "fingerprint").distinct()
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), *DOCUMENT_COLUMNS)).alias("first")
    named = marked.join(least, ["doc_id", "fingerprint"], "left_semi").groupBy("doc_id", "fingerprint").agg(first).select("first.*")
    return named.select(*DOCUMENT_COLUMNS).unionByName(marked.filter("doc_id is null").select(*DOCUMENT_COLUMNS))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret masked."""
    return with_new_text(secret_scan(docs, [c for c in DOCUMENT_COLUMNS if c not in ("text", "n_chars")]), "masked")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of training sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", clean_lines),
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("packing", packed),
]

#: SQL can express neither the hashes nor the trained models; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
