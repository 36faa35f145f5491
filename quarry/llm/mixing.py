"""Mixing sources to target weights by Pfair scheduling (operator 10).

Documents of a source, in doc_id order, form blocks of `block_rows`. With integer shares a_s that sum to a
period D, block j of source s is released at floor(j*D/a_s) and due at ceil((j+1)*D/a_s); earliest deadline
first gives one block to each slot. All deadlines are met, so after any number of slots a source is less than
one block from its share. When a source has no block left, a new phase begins with the weights of the others.

D is PERIOD, far over the slots of a phase, so shares are the target weights but for slots/2**32 of a block and a
phase is planned to its end: one plan row a block. The driver needs one count for each source, makes the plan in
order and writes it in pieces of PLAN_ROWS to the shared folder. Rows are placed by two equi-joins with it, in
DataFrame operations only. A smaller `period` is planned once and repeated, with weights rounded to it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import global_index, new_path, read, small_table

#: More plan rows than this are joined by shuffle instead of a broadcast.
BROADCAST_ROWS = 100_000
#: Block numbers up to 2**31 times this fit a long.
PERIOD = 1 << 32
#: The driver holds so many rows of the plan at once.
PLAN_ROWS = 50_000
SLOTS = "phase int, source string, nth long, slot_in long"


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Integer shares, at least 1 each, with sum period: largest remainders."""
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) / total * period for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    short = period - sum(out.values())
    for s in sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s))[: max(0, short)]:
        out[s] += 1
    for _ in range(-short):  # taken from those that are most over their weight
        out[max((s for s in out if out[s] > 1), key=lambda s: (out[s] - exact[s], s))] -= 1
    return out


def pfair(share: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, its block) for each slot of one period, by earliest deadline among the released blocks."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in share]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // share[s]), s, j))
        due, s, j = heapq.heappop(ready)
        assert due > slot
        yield s, j
        if j + 1 < share[s]:
            heapq.heappush(waiting, ((j + 1) * period // share[s], s, j + 1))


def planned(blocks: dict[str, int], weights: dict[str, float], period: int, segments: list[dict]) -> Iterator[dict]:
    """The slots (the order in one period of each phase), and into segments what each phase takes of each source.

    Sources without a positive weight come after the others, in proportion to their blocks.
    """
    left = {s: n for s, n in blocks.items() if n > 0}
    taken, begin, phase = dict.fromkeys(left, 0), 0, 0
    while left:
        now = {s: weights.get(s, 0.0) for s in left if weights.get(s, 0.0) > 0} or dict(left)
        size = max(period, 4 * len(now)) if len(now) > 1 else 1
        share = shares(now, size)
        whole = min(left[s] // share[s] for s in now)
        used = {s: whole * share[s] for s in now}
        end = whole * size
        more = all(used[s] < left[s] for s in now)  # into the next period, until a source has no more
        for i, (s, j) in enumerate(pfair(share)):
            if more and used[s] == left[s]:
                more = False
            if more:
                used[s] += 1
                end += 1
            elif not whole:
                break
            yield {"phase": phase, "source": s, "nth": j, "slot_in": i}
        for s in now:
            segments.append({"source": s, "phase": phase, "first": taken[s], "last": taken[s] + used[s] - 1, "begin": begin, "share": share[s], "period": size})
            taken[s] += used[s]
            left[s] -= used[s]
        left = {s: n for s, n in left.items() if n}
        begin += end
        phase += 1


def plan(blocks: dict[str, int], weights: dict[str, float], period: int = PERIOD) -> tuple[list[dict], list[dict]]:
    """Segments and slots of a plan that fits in memory."""
    segments: list[dict] = []
    slots = list(planned(blocks, weights, period, segments))
    return segments, slots


def plan_table(spark: SparkSession, slots: Iterator[dict]) -> tuple[DataFrame, int]:
    """The slots as a table, and how many they are; over PLAN_ROWS they are written in pieces."""
    piece = list(islice(slots, PLAN_ROWS))
    n = len(piece)
    if n < PLAN_ROWS:
        return small_table(spark, piece, SLOTS), n
    path = new_path(spark, "plan")
    while piece:
        small_table(spark, piece, SLOTS).write.mode("append").parquet(path)
        piece = list(islice(slots, PLAN_ROWS))
        n += len(piece)
    return spark.read.schema(SLOTS).parquet(path), n


def temperature_weights(counts: dict[str, int], power: float = 0.7) -> dict[str, float]:
    """The usual target: a source counts as its size to a power below 1."""
    return {s: n**power for s, n in counts.items()}


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = 16, period: int = PERIOD) -> DataFrame:
    """All rows with block, release, deadline, slot (of the block) and row_in_block.

    Null sources are one source. Repeated rows and null ids take places next to each other. An empty table
    gives no rows. Columns of the same names are replaced. The driver sees the source table (one count a source)
    and makes the plan from it.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "release", "deadline", "slot", "row_in_block", "phase")
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    counts = {r["s"]: r["n"] for r in docs.groupBy(key.alias("s")).agg(F.count("*").alias("n")).collect()}
    target = temperature_weights(counts) if weights is None else {f"={s}" if s is not None else "null": w for s, w in weights.items()}
    segments: list[dict] = []
    order, many = plan_table(spark, planned({s: -(-n // block_rows) for s, n in counts.items()}, target, period, segments))
    starts, at = [], 0
    for s in sorted(counts, key=lambda s: s.encode()):
        starts.append({"source": s, "start": at})
        at += counts[s]
    def hint(table: DataFrame, rows: int) -> DataFrame:
        """Broadcast if its size is known to allow it; segments are at most half the square of the sources."""
        return F.broadcast(table) if rows <= BROADCAST_ROWS else table

    seg = small_table(spark, segments, "source string, phase int, first long, last long, begin long, share long, period long")
    seg = seg.join(small_table(spark, starts, "source string, start long"), "source").withColumnRenamed("source", "_s")
    rows = global_index(docs.select(F.struct("*").alias("_row"), key.alias("_s")), [F.col("_s"), F.col("_row.doc_id")], "_idx")
    rows = rows.join(hint(small_table(spark, starts, "source string, start long").withColumnRenamed("source", "_s"), len(starts)), "_s")
    rows = rows.withColumn("_rank", F.col("_idx") - F.col("start")).drop("start", "_idx")
    rows = rows.withColumns({"block": F.expr(f"_rank div {block_rows}"), "row_in_block": F.expr(f"_rank % {block_rows}")})
    rows = rows.alias("r").join(hint(seg.drop("start"), len(segments)).alias("g"), F.expr("r._s = g._s and r.block between g.first and g.last")).select("r.*", *[f"g.{c}" for c in ("phase", "first", "begin", "share", "period")])
    rows = rows.withColumns({"_round": F.expr("(block - first) div share"), "_nth": F.expr("(block - first) % share")})
    rows = rows.alias("r").join(hint(order, many).alias("o"), F.expr("r.phase = o.phase and r._s = o.source and r._nth = o.nth")).select("r.*", "o.slot_in")
    base = F.expr("begin + _round * period")
    return rows.select(
        "_row.*", "block", (base + F.expr("(_nth * period) div share")).alias("release"), (base + F.expr("((_nth + 1) * period + share - 1) div share")).alias("deadline"), (base + F.col("slot_in")).alias("slot"), "row_in_block", "phase"
    )


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, interleaved by size to the power 0.7."""
    return mix(read(spark, sf_dir, "documents").select("doc_id", "source"))
