"""A corpus from raw documents to packed sequences: each stage calls one operator of quarry.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import minhash, mixing, packing, secrets, toxicity
from quarry.llm.common import drop_made, global_index, kept, made, read

#: No SQL says the learned toxicity score or the best-fit plan; tests hold the pipeline against brute force.
ORACLE_SQL = None
#: Documents that share this percentage of their five-word shingles are near-duplicates here; op6 has its own.
NEAR_PERCENT = 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at 0.3 or more go. Where labels tell nothing, none does."""
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_text"))
    return toxicity.score(rows, model, "_text").filter(F.col("score") < toxicity.THRESHOLD).select("_doc.*")


def numbered(docs: DataFrame) -> DataFrame:
    """docs written with _quarry_rid, which tells rows apart whatever their ids are."""
    return kept(docs.withColumn("_quarry_rid", F.monotonically_increasing_id()), "numbered")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays.

    Rows without an id stay. Rows that share an id are documents of their own, in the order of their places.
    """
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").head(1):
        rows = numbered(docs)
        places = global_index(rows.filter("doc_id is not null").select("doc_id", "_quarry_rid"), [F.col("doc_id"), F.col("_quarry_rid")], "_quarry_place")
        texts = rows.join(places.select("_quarry_rid", "_quarry_place"), "_quarry_rid").select(F.col("_quarry_place").alias("doc_id"), "text")
        found = minhash.near_duplicates(kept(texts, "texts"), percent=NEAR_PERCENT).filter(~F.col("kept")).select(F.col("doc_id").alias("_quarry_place"))
        gone = kept(places.join(found, "_quarry_place", "left_semi").select("_quarry_rid"), "gone")
        return rows.join(gone, "_quarry_rid", "left_anti").select(*docs.columns)
    gone = kept(minhash.near_duplicates(docs, percent=NEAR_PERCENT).filter(~F.col("kept")).select("doc_id"), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets are replaced in the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def place_of(mixed: DataFrame) -> DataFrame:
    return mixed.withColumn("_quarry_place", F.col("slot") * (1 << 16) + F.col("row_in_block"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their rows and files in the order of the interleaved blocks."""
    rows = numbered(docs)
    places = place_of(mixing.mix(rows.select("doc_id", "source", "_quarry_rid"))).select("_quarry_rid", "_quarry_place")
    return rows.join(places, "_quarry_rid").repartitionByRange("_quarry_place").sortWithinPartitions("_quarry_place").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its ids and its place in a sequence.

    The order of rows is not a table's to keep, so the mix is made again, of ids and sources alone; pieces of one
    length go by it, and sequences are numbered in the order of their first pieces.
    """
    rows = packing.sized(docs, "source", with_ids=True)
    mixed = place_of(mixing.mix(rows.select("doc_id", "source", "_rid", "_n")))
    return packing.with_ids(packing.pack_sized(mixed, place="_quarry_place"), rows)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage over what the one before kept, written as Parquet and read again; what a stage leaves is dropped."""
    docs, before = read(spark, sf_dir, "documents"), made()
    for name, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir), name)
        drop_made(spark, before)
    return docs
