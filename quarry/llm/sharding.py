"""Sharding by vector bin packing (operator 8).

Documents with equal texts form groups, measured in bytes, tokens and rows. A group of over 1/parts of a shard in
any measure is an item of its own and stays whole, unless it is over 1/CHUNKS of a shard: such a group is cut into
chunks of about that size by document, as no shard could hold it beside its share of the rest. Groups of 1/parts or
less also stay whole; they are gathered by the hash of their text into a fixed number of lots, which are placed as
one. There are at most 3 * shards * parts groups that are items and 3 * shards * CHUNKS chunks more, so the items
are bounded by parameters, whatever the table's size. Items are placed from the largest down, each where the dot
product of its vector with the residual capacity is highest; afterwards the fullest and the emptiest shard exchange
items while that evens them out.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import WORD, global_index, read, shared_dir, small_table


#: A group over this part of a shard is cut.
CHUNKS = 16


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item; a row of items is its vector of bytes, tokens and rows."""
    total = items.sum(axis=0)
    scaled = items / np.where(total > 0, total, 1) * shards
    room = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), dtype=np.int64)
    for i in np.argsort(-scaled.sum(axis=1), kind="stable"):
        best = room @ scaled[i]
        fits = (room >= scaled[i]).all(axis=1)
        out[i] = at = int(np.argmax(np.where(fits, best, -np.inf) if fits.any() else best))
        room[at] -= scaled[i]
    return out


def evened(scaled: np.ndarray, where: np.ndarray, shards: int, rounds: int = 200, among: int = 256) -> np.ndarray:
    """Items moved or exchanged between the fullest and the emptiest shard by bytes, while that evens out all measures."""
    where = where.copy()
    load = np.zeros((shards, scaled.shape[1]))
    np.add.at(load, where, scaled)
    for _ in range(rounds):
        a, b = int(load[:, 0].argmax()), int(load[:, 0].argmin())
        small = [x[np.argsort(scaled[x, 0], kind="stable")[:among]] for x in (np.flatnonzero(where == a), np.flatnonzero(where == b))]
        left, right = (np.vstack([np.zeros(scaled.shape[1]), scaled[x]]) for x in small)  # the first row: no item
        moved = left[:, None, :] - right[None, :, :]
        apart = load[a] - load[b]
        after = ((apart - 2 * moved) ** 2).sum(axis=2)
        i, j = np.unravel_index(int(after.argmin()), after.shape)
        if after[i, j] > (apart**2).sum() * (1 - 1e-6):
            break
        load[a] -= moved[i, j]
        load[b] += moved[i, j]
        if i:
            where[small[0][i - 1]] = b
        if j:
            where[small[1][j - 1]] = a
    return where


def shard(docs: DataFrame, shards: int = 24, parts: int = 256, lots: int = 8192) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row; slots of a shard go by doc_id.

    A null text has size 8 and the crc of no bytes, and is a group with the empty ones. Null ids and repeated
    rows are placed as often as they come. An empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("tokens"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"), F.xxhash64(text).alias("_h")
    ).checkpoint()
    measures = {"size": F.sum("size"), "tokens": F.sum("tokens"), "n": F.count("*")}
    sums = [v.alias(k) for k, v in measures.items()]
    total = rows.agg(*sums).first()
    part = F.greatest(*[F.col(c) / max(1, total[c] or 0) for c in measures]) * shards
    large = rows.groupBy("_h").agg(*sums).select("_h", part.alias("part")).filter(F.col("part") * parts > 1).select("_h", F.ceil(F.col("part") * CHUNKS).alias("cuts")).collect()
    heavy = small_table(spark, [{"_h": r["_h"], "cuts": r["cuts"]} for r in large], "_h long, cuts long")
    lot = F.struct(F.lit(-1).cast("long").alias("cut"), F.pmod("_h", F.lit(lots)).alias("h"))
    own = F.struct(F.pmod(F.xxhash64("doc_id", F.lit("cut")), F.col("cuts")).alias("cut"), F.col("_h").alias("h"))
    rows = rows.join(F.broadcast(heavy), "_h", "left").withColumn("item", F.when(F.col("cuts").isNull(), lot).otherwise(own))
    items = rows.groupBy("item").agg(*sums).select("item.*", *measures).orderBy("cut", "h").collect()
    vectors = np.array([[r[c] for c in measures] for r in items], dtype=np.float64).reshape(-1, 3)
    where = evened(vectors / np.maximum(vectors.sum(axis=0), 1) * shards, place(vectors, shards), shards)
    plan = small_table(spark, [{"cut": r["cut"], "h": r["h"], "shard": int(s)} for r, s in zip(items, where, strict=True)], "cut long, h long, shard int")
    placed = rows.select("doc_id", "size", "text_crc32", "item.*").join(F.broadcast(plan), ["cut", "h"]).drop("cut", "h")
    placed = global_index(placed, [F.col("shard"), F.col("doc_id")], "_idx")
    first = {r["shard"]: r["_first"] for r in placed.groupBy("shard").agg(F.min("_idx").alias("_first")).collect()}
    start = F.element_at(F.split(F.lit(",".join(str(first.get(s, 0)) for s in range(shards))), ","), F.col("shard") + 1).cast("long")
    return placed.select("doc_id", "size", "text_crc32", "shard", (F.col("_idx") - start).alias("slot"))


def op8_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents in 24 shards of near equal bytes, tokens and rows; the law is that of bytes."""
    out = shard(read(spark, sf_dir, "documents"), 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
