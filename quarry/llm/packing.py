"""Best-fit packing of token ids into several permitted sequence lengths (operator 1).

Lengths are those of the texts' ids with an end id. The permitted lengths are optimised jointly: a plan is made for
each set of them that bins may be opened with, by the least cost a token or the least size that fits, every bin is
downsized to its contents at the end, and the plan of least total cost is kept.

Best-fit decreasing needs only the number of pieces of each length, and there are at most max(sizes) lengths:
the plan is made from that histogram and holds runs of equal bins, not bins. Each run of pieces of one length
maps to a run of bins by arithmetic, so every row finds its bin from its place in the order (length descending,
doc_id) without meeting other rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from quarry.llm.common import global_index, kept, read
from quarry.llm.tokenids import SLICE, encoder_of, public_tokenizer
from quarry.llm.words import raw

SIZES = (512, 1024, 2048, 4096)


def default_cost(size: int) -> float:
    """A sequence costs its positions, attention over them, and a fixed share of a step."""
    return size * (1 + size / 16384) + 128


class Plan:
    """Runs of placements, in order of the pieces, and runs of bins; bins are opened with the sizes `opened`."""

    def __init__(self, counts: dict[int, int], sizes: tuple[int, ...], cost=default_cost, opened: tuple[int, ...] | None = None, smallest: bool = False):
        sizes = tuple(sorted(sizes))
        opened = tuple(sorted(opened or sizes))
        runs: list[tuple[int, int, int, int, int, int]] = []  # piece from, pieces a bin, bin from, offset, length, pieces
        open_: dict[tuple[int, int], list[tuple[int, int]]] = {}  # (room, size) -> runs of bins: from, count
        rooms: list[tuple[int, int]] = []
        done: list[tuple[int, int, int]] = []  # bin from, count, contents
        tokens = sum(n * k for n, k in counts.items())
        at = bins = 0

        def put_back(room: int, size: int, first: int, n: int) -> None:
            if room == 0:
                done.append((first, n, size))
            elif n:
                if (room, size) not in open_:
                    open_[room, size] = []
                    bisect.insort(rooms, (room, size))
                open_[room, size].append((first, n))

        for length in sorted(counts, reverse=True):
            left = counts[length]
            while left:
                i = bisect.bisect_left(rooms, (length, 0))
                if i < len(rooms):
                    room, size = rooms[i]
                    first, n = open_[rooms[i]].pop()
                    if not open_[rooms[i]]:
                        del open_[rooms.pop(i)]
                else:  # while sizes[-1] tokens are left, the choice stays: open as many bins as these pieces fill
                    size = room = min((s for s in opened if s >= length), key=lambda s: s if smallest else (cost(s) / min(s, tokens), s))
                    each = size // length
                    first, n = bins, min(-(-left // each), 1 + max(0, tokens - sizes[-1]) // (each * length))
                    bins += n
                each = room // length  # best fit returns to the bin that it has just used
                full = min(n, left // each)
                rest = left - full * each if full < n else 0
                for k, many, skip in ((each, full, 0), (rest, 1, full)):
                    if k and many:
                        runs.append((at, k, first + skip, size - room, length, k * many))
                        at += k * many
                        left -= k * many
                        tokens -= k * many * length
                        put_back(room - k * length, size, first + skip, many)
                put_back(room, size, first + full + bool(rest), n - full - bool(rest))
        for (room, size), groups in open_.items():
            done += [(f, n, size - room) for f, n in groups]
        self.runs = np.array(runs, dtype=np.int64).reshape(-1, 6)
        done.sort()
        self.bin_from = np.array([x[0] for x in done], dtype=np.int64)
        used = np.array([x[2] for x in done], dtype=np.int64)
        self.bin_size = np.array(sizes, dtype=np.int64)[np.searchsorted(sizes, used)] if done else used
        self.bin_used = used
        self.bins, self.bin_counts = bins, np.array([x[1] for x in done], dtype=np.int64)
        self.cost = sum(cost(int(s)) * int(n) for s, n in zip(self.bin_size, self.bin_counts, strict=True))

    def place(self, idx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bin, its final size and the offset in it of the pieces at these places."""
        if not len(idx):
            return idx, idx, idx
        at, each, first, offset, length, _ = self.runs[np.searchsorted(self.runs[:, 0], idx, side="right") - 1].T
        k = idx - at
        bin_id = first + k // each
        return bin_id, self.bin_size[np.searchsorted(self.bin_from, bin_id, side="right") - 1], offset + k % each * length


def policies(sizes: tuple[int, ...]) -> Iterator[tuple[tuple[int, ...], bool]]:
    """(sizes that bins are opened with, whether the smallest that fits is): each set that has the largest size."""
    *rest, largest = sorted(sizes)
    for n in range(len(rest) + 1):
        for some in combinations(rest, n):
            yield (*some, largest), False
            if some:
                yield (*some, largest), True


def best_plan(counts: dict[int, int], sizes: tuple[int, ...], cost=default_cost) -> Plan:
    """The plan of least total cost over all policies; among equals the one with fewer bins."""
    return min((Plan(counts, sizes, cost, opened, smallest) for opened, smallest in policies(sizes)), key=lambda p: (p.cost, p.bins))


def sized(docs: DataFrame, *others: str, tokenizer: str | None = None, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, the columns `others`, _rid (tells rows apart), _n ids of the text with the end id and, if asked, _ids.

    Written to the shared folder, so texts are encoded once. A null text is an empty one.
    """
    path = tokenizer or public_tokenizer()
    rows = docs.select(F.coalesce("text", F.lit("")).alias("_quarry_text"), F.col("doc_id").cast("long").alias("doc_id"), *others, F.monotonically_increasing_id().alias("_rid"))
    more = [StructField("_n", LongType())] + [StructField("_ids", ArrayType(IntegerType()))] * with_ids
    schema = StructType([*rows.schema.fields[1:], *more])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path, end_id)
        for b in batches:
            at = 0
            while at < len(b):  # as many rows as make about a slice
                sizes = np.diff(raw(b.column(0).slice(at))[1])
                part = b.slice(at, max(1, int(np.searchsorted(np.cumsum(sizes), SLICE, side="right"))))
                at += len(part)
                ids, counts = encoder.encode(part.column(0))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids.astype(np.int32)))] if with_ids else []
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts, pa.int64()), *lists], names=schema.names)

    return kept(rows.mapInArrow(run, schema), "sized")


def pack_sized(rows: DataFrame, sizes: tuple[int, ...] = SIZES, cost=default_cost, place: str | None = None) -> DataFrame:
    """_rid, doc_id, piece, n_tokens, bin_id, bin_size, bin_offset for the pieces of rows (_rid, doc_id, _n).

    Rows over the largest size are cut into full pieces and a rest. `place` names a column to keep the order of:
    pieces of one length are packed in it, and bins are numbered in the order of their first pieces.
    """
    largest, order = max(sizes), [place] if place else []
    rows = rows.select("_rid", "doc_id", *order, "_n", F.explode(F.expr(f"sequence(0L, (_n - 1) div {largest})")).alias("piece"))
    rows = rows.select("doc_id", F.col("piece").cast("int"), F.least(F.lit(largest), F.col("_n") - F.col("piece") * largest).alias("n_tokens"), "_rid", *order)
    rows = global_index(rows, [-F.col("n_tokens"), *map(F.col, order), F.col("doc_id"), F.col("piece")], "_idx")
    plan = best_plan({r["n_tokens"]: r["n"] for r in rows.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}, sizes, cost)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = plan.place(b.column(4).to_numpy(zero_copy_only=False))
            names = ["doc_id", "piece", "n_tokens", "_rid", "bin_id", "bin_size", "bin_offset", *b.schema.names[5:]]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array(x) for x in found), *b.columns[5:]], names=names)

    out = "doc_id long, piece int, n_tokens long, _rid long, bin_id long, bin_size long, bin_offset long"
    columns = ["doc_id", "piece", "n_tokens", "_rid", "_idx"]
    if not place:
        return rows.select(*columns).mapInArrow(put, out)
    kind = rows.schema[place].dataType.simpleString()
    packed = rows.select(*columns, F.col(place).alias("_place")).mapInArrow(put, f"{out}, _place {kind}")
    first = global_index(packed.filter("bin_offset = 0").select("bin_id", "_place"), [F.col("_place"), F.col("bin_id")], "_new").drop("_place")
    return packed.join(first, "bin_id").select("doc_id", "piece", "n_tokens", "_rid", F.col("_new").alias("bin_id"), "bin_size", "bin_offset")


def with_ids(packed: DataFrame, rows: DataFrame, largest: int = SIZES[-1]) -> DataFrame:
    """Each piece with its ids, from rows (_rid, _ids)."""
    both = packed.join(rows.select("_rid", "_ids"), "_rid")
    return both.select("doc_id", "piece", "n_tokens", "bin_id", "bin_size", "bin_offset", F.slice("_ids", F.col("piece") * largest + 1, F.lit(largest)).alias("ids"))


def sequences(packed: DataFrame) -> DataFrame:
    """bin_id, bin_size, doc_ids, offsets, ids: one row a sequence; a sequence is as long as its size at most."""
    parts = F.array_sort(F.collect_list(F.struct("bin_offset", "doc_id", "ids")))
    rows = packed.groupBy("bin_id", "bin_size").agg(parts.alias("x"))
    return rows.select("bin_id", "bin_size", F.col("x.doc_id").alias("doc_ids"), F.col("x.bin_offset").alias("offsets"), F.flatten("x.ids").alias("ids"))


def pack(docs: DataFrame, sizes: tuple[int, ...] = SIZES, cost=default_cost, place: str | None = None, tokenizer: str | None = None, ids: bool = False) -> DataFrame:
    """doc_id, piece, n_tokens, bin_id, bin_size, bin_offset and, if asked, ids for every piece of every document.

    Null or empty texts are one end token. Null ids and repeated rows are packed as often as they come; ties go
    by input place. An empty table gives no rows. Other columns are not read, but `place` (see pack_sized).
    """
    rows = sized(docs, *([place] if place else []), tokenizer=tokenizer, with_ids=ids)
    packed = pack_sized(rows, sizes, cost, place)
    return with_ids(packed, rows, max(sizes)) if ids else packed.drop("_rid")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents, packed into sequences of 512 to 4096 ids."""
    return pack(read(spark, sf_dir, "documents"))
