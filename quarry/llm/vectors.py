"""Embedding near-duplicates by sorted projection passes (operator 7).

Equal vectors are one class. In each pass a class has a key of BITS signs of random projections; classes are put
in the lexicographic order of the keys, and each is compared with the WINDOW that follow it. Pairs of cosine
THRESHOLD or more are united across the passes into components. A window cannot hold all of a cluster that is
larger than it, so links are counted afterwards inside components, block by block, over all pairs of each: no
partner is lost to the window's width once the components are found.

The number of passes follows the table. Two vectors that share more bits than a class shares with the one a window
after it are surely within that window, and a pair at THRESHOLD shares each bit with the chance AGREE. So the passes
count, for classes that no window linked, how many bits that takes, and go on until a pair at the threshold is
missed with a chance of 1 - RECALL or less, on average over these classes: more of them the larger the table is and
the denser its vectors lie.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import global_index, kept, read, shared_dir
from quarry.llm.graph import components
from quarry.llm.minhash import spanning

THRESHOLD, PASSES, BITS, WINDOW, BLOCK = 0.95, 12, 62, 256, 1024
#: PASSES is the least number of them.
RECALL = 0.99
AGREE = 1 - np.arccos(THRESHOLD) / np.pi


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(vectors as rows of doubles, which rows are usable): usable are those of the commonest length, finite, not zero."""
    offsets = np.asarray(column.offsets, dtype=np.int64)
    flat = column.flatten()
    start = offsets[:-1] - offsets[0]
    size = np.diff(offsets)
    good = np.asarray(column.is_valid()) & (size > 0)
    dim = int(size[good].max()) if good.any() else 1
    good &= size == dim
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), dim))
    out[good] = values[start[good][:, None] + np.arange(dim)]
    good &= np.isfinite(out).all(axis=1)
    out[~good] = 0
    norm = np.linalg.norm(out, axis=1)
    good &= norm > 0
    return out / np.where(norm > 0, norm, 1)[:, None], good


def _planes(dim: int, begin: int, end: int) -> list[np.ndarray]:
    return [np.random.default_rng([7, p]).standard_normal((dim, BITS)) for p in range(begin, end)]


def passes_needed(depths: dict[int, int]) -> int:
    """Passes until classes with so many bits to share (and how many classes have each) reach RECALL on average."""
    bits, many = np.array(list(depths), dtype=np.float64), np.array(list(depths.values()), dtype=np.float64)
    missed = 1 - AGREE**bits

    def enough(n: int) -> bool:
        return (many * missed**n).sum() <= (1 - RECALL) * many.sum()

    low, high = 0, 1
    while not enough(high):
        low, high = high, 2 * high
    while high - low > 1:
        n = (low + high) // 2
        low, high = (low, n) if enough(n) else (n, high)
    return high


def _keys(classes: DataFrame, begin: int, end: int) -> DataFrame:
    """(pass, key, cid) for each class and pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        planes: dict[int, list[np.ndarray]] = {}
        for b in batches:
            size = np.diff(np.asarray(b.column(1).offsets))
            for dim in np.unique(size).tolist():
                same = b.filter(pa.array(size == dim))
                x, _ = matrix(same.column(1))
                if dim not in planes:
                    planes = {dim: _planes(dim, begin, end)}  # of one length at a time
                for p in range(begin, end):
                    key = (x @ planes[dim][p - begin] > 0) @ powers
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p, np.int32)), pa.array(key), same.column(0)], names=["pass", "key", "cid"])

    return classes.select("cid", "v").mapInArrow(run, "pass int, key long, cid long")


def _grouped(keys: int, group):
    """Calls group with the columns of each run of rows that are equal in the first `keys` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def cut(table: pa.Table) -> Iterator[pa.Table]:
            k = [table.column(i).to_numpy() for i in range(keys)]
            edge = [0, *(np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in k])) + 1).tolist(), len(table)]
            for a, z in zip(edge[:-1], edge[1:], strict=True):
                yield table.slice(a, z - a)

        for b in batches:
            if not len(b):
                continue
            if waiting and any(waiting[-1].column(i)[-1] != b.column(i)[0] for i in range(keys)):
                for t in cut(pa.Table.from_batches(waiting)):
                    yield from group(t.combine_chunks())
                waiting = []
            waiting.append(b)
            last = b.slice(len(b) - 1)
            if any(b.column(i)[0] != last.column(i)[0] for i in range(keys)):
                *done, rest = cut(pa.Table.from_batches(waiting))
                for t in done:
                    yield from group(t.combine_chunks())
                waiting = rest.to_batches()
        if waiting:
            for t in cut(pa.Table.from_batches(waiting)):
                yield from group(t.combine_chunks())

    return run


def _array(table: pa.Table, name: str) -> pa.Array:
    c = table.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks)


def depths(key: np.ndarray, own: int, window: int) -> np.ndarray:
    """For the first `own` of these sorted keys, how many bits surely keep a partner within the window."""
    out = np.zeros(own, np.int64)
    n = max(0, min(own, len(key) - window))
    apart = np.frexp((key[:n] ^ key[window : window + n]).astype(np.float64))[1]
    out[:n] = np.minimum(BITS, BITS - apart + 1)
    return out


def _in_windows(window: int):
    """A spanning forest of the links in the windows, and the depths of the classes that have none."""

    def group(t: pa.Table) -> Iterator[pa.RecordBatch]:
        x, _ = matrix(_array(t, "v"))
        cid, key, own = t.column("cid").to_numpy(), t.column("key").to_numpy(), int(t.column("own").to_numpy().sum())
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, own, window):
            e = min(s + window, own)
            i, j = np.nonzero(x[s:e] @ x[s + 1 : e + window].T >= THRESHOLD)
            near = (j >= i) & (j < i + window)
            a.append(i[near] + s)
            b.append(j[near] + s + 1)
        a, b = np.concatenate(a), np.concatenate(b)
        nodes = np.unique(np.concatenate([a, b]))
        linked = np.zeros((len(nodes), len(nodes)), bool)
        a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
        linked[a, b] = linked[b, a] = True
        a, b = spanning(linked) if len(nodes) else (a, b)
        alone = np.ones(len(x), bool)
        alone[nodes] = False
        depth, many = np.unique(depths(key, own, window)[alone[:own]], return_counts=True)
        pad, dim = np.zeros(len(a), np.int64), int(t.column("dim")[0].as_py())
        links = [pa.array(cid[nodes[a]]), pa.array(cid[nodes[b]]), *(pa.array(pad) for _ in range(3))]
        alone_rows = [pa.nulls(len(depth), pa.int64())] * 2 + [pa.array(np.full(len(depth), dim, np.int64)), pa.array(depth), pa.array(many.astype(np.int64))]
        for columns in (links, alone_rows):
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "dim", "depth", "n"])

    return group


def _in_blocks(t: pa.Table) -> Iterator[pa.RecordBatch]:
    """Links of the classes of one block with those of another, or with each other."""
    x, _ = matrix(_array(t, "v"))
    cid, copies, side = (t.column(c).to_numpy() for c in ("cid", "copies", "side"))
    bi, bj = int(t.column("bi")[0].as_py()), int(t.column("bj")[0].as_py())
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1) if bi != bj else np.flatnonzero(side == 0)
    linked = x[left] @ x[right].T >= THRESHOLD
    if bi == bj:
        np.fill_diagonal(linked, False)
        ids, many = cid[left], linked @ copies[right]
    else:
        ids, many = np.concatenate([cid[left], cid[right]]), np.concatenate([linked @ copies[right], linked.T @ copies[left]])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(many.astype(np.int64))], names=["cid", "links"])


def _windows(classes: DataFrame, begin: int, end: int, window: int, block: int) -> DataFrame:
    """What _in_windows finds in these passes."""
    placed = global_index(_keys(classes, begin, end).join(classes.select("cid", "dim"), "cid"), [F.col("dim"), F.col("pass"), F.col("key"), F.col("cid")], "idx")
    width = max(block, window)
    key = ["cid", "dim", "pass", "key"]
    own = placed.select(*key, F.expr(f"idx div {width}").alias("blk"), "idx", F.lit(1).alias("own"))
    tail = placed.filter(f"idx >= {width} and idx % {width} < {window}").select(*key, F.expr(f"idx div {width} - 1").alias("blk"), "idx", F.lit(0).alias("own"))
    dealt = own.unionByName(tail).join(classes.select("cid", "v"), "cid").select("blk", "dim", "pass", "idx", "cid", "v", "own", "key")
    dealt = dealt.repartition("blk").sortWithinPartitions("blk", "dim", "pass", "idx")
    return dealt.mapInArrow(_grouped(3, _in_windows(window)), "a long, b long, dim long, depth long, n long").checkpoint()


def near_vectors(vectors: DataFrame, passes: int = PASSES, window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding); of `passes` or more passes.

    Null, empty and zero vectors, and those with a null or non-finite component, link with nothing. A row without
    an id links with nothing, has no component and is kept. Repeated rows are copies of each other. An empty table
    gives no rows. Vectors are compared with those of their own length only. Other columns are not read.
    """
    shared_dir(vectors.sparkSession)
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding").cast(kind)
    usable = F.size(v) > 0
    usable &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = kept(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)), v).alias("v")), "vectors")
    classes = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("cid"), F.count("*").alias("copies"))
    classes = classes.withColumn("dim", F.size("v")).checkpoint()
    begin, end, found = 0, passes, []
    while begin < end:
        found.append(_windows(classes, begin, end, window, block))
        alone: dict[int, dict[int, int]] = {}
        for part in found:
            for r in part.filter("a is null").groupBy("dim", "depth").agg(F.sum("n").alias("n")).collect():
                of = alone.setdefault(r["dim"], {})
                of[r["depth"]] = of.get(r["depth"], 0) + r["n"]
        begin, end = end, max([end, *(passes_needed(x) for x in alone.values())])
    found = functools.reduce(DataFrame.unionByName, found).filter("a is not null").select("a", "b").distinct().checkpoint()
    labels = components(found)
    return _counted(rows, classes, labels, block)


def _counted(rows: DataFrame, classes: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    sizes = labels.groupBy("component").agg(F.ceil(F.count("*") / block).alias("nb"))
    mine = labels.withColumnRenamed("node", "cid").join(sizes, "component").withColumn("mine", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("cid"), F.col("nb"))).otherwise(F.lit(0).cast("long")))
    dealt = mine.select("component", "cid", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    dealt = dealt.select("component", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cid")
    key = ["component", "bi", "bj"]
    dealt = dealt.join(classes.select("cid", "copies", "v"), "cid").select(*key, "side", "cid", "copies", "v").repartition(*key).sortWithinPartitions(*key)
    links = dealt.mapInArrow(_grouped(3, _in_blocks), "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    of = classes.select("cid", "v", "copies").join(labels.withColumnRenamed("node", "cid"), "cid", "left").join(links, "cid", "left")
    of = of.select("v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "cid").alias("c"))
    out = rows.join(of, "v", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op7_projection_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of embeddings: cosine of 0.95 or more."""
    return near_vectors(read(spark, sf_dir, "embeddings"))
