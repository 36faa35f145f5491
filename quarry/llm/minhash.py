"""MinHash near-duplicates by bottom-k sketches from one hash function (operator 6).

1. A document's set is the hashes of its distinct 5-word shingles; its sketch is the SKETCH smallest of them.
   Documents with equal sets are one class, whatever their number; only classes go on.
2. Inverted lists: each of a class's smallest values, as many as `listed` says, names the classes that retain it.
   Classes at the threshold share none of them with a chance of MISSED or less, and surely share one where a set is
   so small that these values are its prefix for the threshold. Lists of one class are dropped before sketches are
   sent. A list of over BLOCK classes is dealt as pairs of blocks, so no task holds it all.
3. In each list, a pair is looked at where its smallest shared listed value is. Set sizes and the overlap in the
   union's sketch (a pair at the threshold shares fewer values with a chance of MISSED or less) filter it; two sets
   that their sketches hold whole are compared exactly.
4. The pairs left are verified on full sets, which are made again from the texts of their classes alone. A list,
   or pair of blocks, that has many more such pairs than classes is a family: it returns no pairs, but is dealt
   again with full sets, all its pairs are counted exactly by a product of incidence matrices, and a spanning
   forest of the links comes back. So no pair is left out and none of a family's is sent.
5. Components of the verified pairs, and of classes to documents.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import kept, read, shared_dir
from quarry.llm.graph import components
from quarry.llm.words import shingle_sets

SKETCH, BLOCK, MISSED, MANY = 32, 1024, 1e-9, 8
#: A block also holds about this many shingles at most, so that its full sets fit in memory.
BLOCK_SHINGLES = 1 << 19
PERCENT = 85
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_PAIRS_AT_ONCE = 1 << 15


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, sig (a digest of the set), sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(1))
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            ends = np.cumsum([0] + [min(SKETCH, len(s)) for s in sets])
            flat = np.concatenate([s[:SKETCH] for s in sets]) if sets else np.zeros(0, np.uint64)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sig, pa.binary()), lists], names=["doc_id", "n", "sig", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n long, sig binary, sketch array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """sig and the full set of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column(0))
            sig = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
            ends = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64)))], names=["sig", "shingles"])

    return docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "sig binary, shingles array<long>")


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared, seen): of the `seen` smallest values of each pair's union, how many both hold."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.zeros(both.shape, bool)
    np.equal(both[:, 1:], both[:, :-1], out=twice[:, 1:])
    real = both != _NONE
    distinct = np.cumsum(~twice & real, axis=1)
    k = a.shape[1]
    return (twice & real & (distinct <= k)).sum(axis=1), np.minimum(distinct[:, -1], k)


@functools.cache
def listed(percent: int) -> int:
    """How many of its smallest values list a class: (1 - threshold) ** listed is MISSED or less."""
    return min(SKETCH, math.ceil(math.log(MISSED) / math.log(max(MISSED, 1 - percent / 100))))


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many values both hold, the smallest of them or _NONE) of each pair of rows."""
    both = np.sort(np.concatenate([a, b], axis=1), axis=1)
    twice = np.where(both[:, 1:] == both[:, :-1], both[:, 1:], _NONE)
    return (twice != _NONE).sum(axis=1), twice.min(axis=1)


@functools.cache
def least_shared(percent: int) -> np.ndarray:
    """For 0 to SKETCH values seen, the least shared ones that pass: fewer have a binomial chance of MISSED or less."""
    t, out = percent / 100, []
    for seen in range(SKETCH + 1):
        chance, k = (1 - t) ** seen, 0
        while k < seen and chance <= MISSED:
            k += 1
            chance += math.comb(seen, k) * t**k * (1 - t) ** (seen - k)
        out.append(k)
    return np.array(out)


def similar(value: int, i: np.ndarray, j: np.ndarray, n: np.ndarray, sk: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the pairs (i, j) of a list, those that belong to it and may reach the threshold, with estimates."""
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    ok = low * 100 >= percent * high
    i, j = i[ok], j[ok]
    many = listed(percent)
    ok = common(sk[i, :many], sk[j, :many])[1] == value
    i, j = i[ok], j[ok]
    shared, seen = estimate(sk[i], sk[j])
    ok = shared >= least_shared(percent)[seen]
    small = np.flatnonzero((n[i] <= SKETCH) & (n[j] <= SKETCH))  # these sketches are the sets
    both = common(sk[i[small]], sk[j[small]])[0]
    ok[small] = both * 100 >= percent * (n[i[small]] + n[j[small]] - both)
    est = shared / np.maximum(seen, 1)
    return i[ok], j[ok], est[ok]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None, columns: int = 2048) -> np.ndarray:
    """The size of the intersection of each set of left with each of right (or of left), from incidence matrices a
    bounded number of columns wide."""
    sets = [*left, *(right or [])]
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    order = np.argsort(flat, kind="stable")
    flat, row = flat[order], row[order]
    column = np.cumsum(np.append(False, flat[1:] != flat[:-1]), dtype=np.int32) if len(flat) else np.zeros(0, np.int32)
    del flat, order
    many = np.bincount(column) > 1  # what one set alone holds is in no intersection
    row, column = row[many[column]], column[many[column]]
    column = (np.cumsum(many, dtype=np.int32) - 1)[column]
    out = np.zeros((len(left), len(right or left)), np.float32)
    for at in range(0, int(many.sum()), columns):
        a, z = np.searchsorted(column, [at, at + columns])
        x = np.zeros((len(sets), columns), np.float32)
        x[row[a:z], column[a:z] - at] = 1
        out += x[: len(left)] @ (x[len(left) :] if right else x).T
    return out


def reach(both: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs with these intersections reach the threshold, a strip of rows at a time."""
    out = np.zeros(both.shape, bool)
    for a in range(0, len(both), 128):
        x = both[a : a + 128].astype(np.int64)
        out[a : a + 128] = x * 100 >= percent * (n_left[a : a + 128, None] + n_right[None, :] - x)
    return out


def spanning_between(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (row, column) of a spanning forest of the links between rows and columns."""
    new = [np.ones(linked.shape[0], bool), np.ones(linked.shape[1], bool)]
    edges: tuple[list[int], list[int]] = ([], [])
    while new[0].any():
        x = int(np.argmax(new[0]))
        new[0][x] = False
        todo = [(0, x)]
        while todo:
            side, x = todo.pop()
            found = np.flatnonzero((linked[:, x] if side else linked[x]) & new[1 - side]).tolist()
            new[1 - side][found] = False
            todo += [(1 - side, y) for y in found]
            edges[side].extend([x] * len(found))
            edges[1 - side].extend(found)
    return np.array(edges[0], np.int64), np.array(edges[1], np.int64)


def spanning(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of an adjacency matrix."""
    new = np.ones(len(linked), bool)
    a, b = [], []
    while new.any():
        todo = [int(np.argmax(new))]
        new[todo[0]] = False
        while todo:
            x = todo.pop()
            found = np.flatnonzero(linked[x] & new)
            new[found] = False
            todo += found.tolist()
            a += [x] * len(found)
            b += found.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def _pairs(side: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a group, a bounded number at a time; of a pair of blocks, those between them."""
    m = len(side)
    if cross:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        step = max(1, _PAIRS_AT_ONCE // max(1, len(right)))
        for a in range(0, len(left), step):
            x = left[a : a + step]
            yield np.repeat(x, len(right)), np.tile(right, len(x))
    else:
        a = 0
        while a < m - 1:
            step = max(1, min(m - 1 - a, _PAIRS_AT_ONCE // (m - a)))
            rows = np.arange(a, a + step)
            many = m - 1 - rows
            i = np.repeat(rows, many)
            yield i, np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + i + 1
            a += step


def _by_sketch(v, bi, bj, side, cid, n, sketch, percent) -> Iterator[tuple[list[int], list[int | None]]]:
    """The pairs of a list that may be links, or one row without b if they are many for its size."""
    sk = np.full((len(sketch), SKETCH), _NONE)
    for r, x in enumerate(sketch):
        sk[r, : len(x)] = x
    i, j, total = [], [], 0
    for x in _pairs(side, bi != bj):
        a, b, _ = similar(v, *x, n, sk, percent)
        i.append(a)
        j.append(b)
        total += len(a)
        if total > MANY * len(cid):
            yield [int(cid[0])], [None]
            return
    if total:
        yield cid[np.concatenate(i)].tolist(), cid[np.concatenate(j)].tolist()


def _exactly(v, bi, bj, side, cid, n, sets, percent) -> Iterator[tuple[list[int], list[int | None]]]:
    """A spanning forest of the links of a list, or of those between two blocks of it."""
    if bi == bj:
        a, b = spanning(reach(shared_counts(list(sets)), n, n, percent))
    else:
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(left) or not len(right):
            return
        both = shared_counts(list(sets[left]), list(sets[right]))
        a, b = spanning_between(reach(both, n[left], n[right], percent))
        a, b = left[a], right[b]
    yield cid[a].tolist(), cid[b].tolist()


def _each_list(group):
    """For rows (v, bi, bj, side, cid, n, values) sorted by list: what group returns, as (a, b, v, bi, bj)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(b: pa.RecordBatch):
            lists = b.column(6)
            values = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            offsets = np.asarray(lists.offsets) - np.asarray(lists.offsets)[0]
            sets = np.empty(len(lists), object)
            for r in range(len(lists)):
                sets[r] = values[offsets[r] : offsets[r + 1]]
            return [*(b.column(k).to_numpy(zero_copy_only=False) for k in range(6)), sets]

        waiting: list[list[np.ndarray]] = []
        a_out: list[int] = []
        b_out: list[int | None] = []
        key_out: list[tuple[int, int, int]] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64()), *(pa.array([k[x] for k in key_out], pa.int64()) for x in range(3))], names=["a", "b", "v", "bi", "bj"])
            a_out.clear()
            b_out.clear()
            key_out.clear()
            return out

        def take(cols: list[np.ndarray]) -> None:
            v, bi, bj = cols[:3]
            edge = np.flatnonzero((v[1:] != v[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(v)], strict=True):
                if e - s > 1:
                    for a, b in group(np.int64(v[s]).view(np.uint64), bi[s], bj[s], *(c[s:e] for c in cols[3:])):
                        a_out.extend(a)
                        b_out.extend(b)
                        key_out.extend([(int(v[s]), int(bi[s]), int(bj[s]))] * len(a))

        for b in batches:
            cols = cut(b)
            key = tuple(int(c[-1]) for c in cols[:3])
            open_ = np.flatnonzero((cols[0] != key[0]) | (cols[1] != key[1]) | (cols[2] != key[2]))
            done = int(open_[-1]) + 1 if len(open_) else 0  # the last group may go on in the next batch
            if done or waiting and tuple(int(c[0]) for c in waiting[-1][:3]) != key:
                parts = [*waiting, [c[:done] for c in cols]]
                take([np.concatenate(x) for x in zip(*parts, strict=True)])
                waiting = []
            waiting.append([c[done:] for c in cols])
            if len(a_out) > 20_000:
                yield flush()
        if waiting:
            take([np.concatenate(x) for x in zip(*waiting, strict=True)])
        yield flush()

    return run


def _members(classes: DataFrame, block: int, percent: int) -> DataFrame:
    """(v, bi, bj, side, cid): who is compared in which list, or pair of a list's blocks."""
    lists = classes.select("cid", "n", F.explode(F.slice("sketch", 1, listed(percent))).alias("v"))
    blocks = F.ceil(F.greatest(F.col("m") / block, F.col("size") / BLOCK_SHINGLES))
    many = lists.groupBy("v").agg(F.count("*").alias("m"), F.sum("n").alias("size")).filter("m > 1").select("v", F.least("m", blocks).alias("nb"))
    lists = lists.join(many, "v")
    lists = lists.withColumn("mine", F.when(F.col("nb") > 1, F.pmod(F.xxhash64("cid"), F.col("nb"))).otherwise(F.lit(0).cast("long")))
    lists = lists.select("v", "cid", "mine", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("other"))
    return lists.select("v", F.least("mine", "other").alias("bi"), F.greatest("mine", "other").alias("bj"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "cid")


def _compared(rows: DataFrame, group) -> DataFrame:
    key = ["v", "bi", "bj"]
    rows = rows.select(*key, "side", "cid", "n", "values").repartition(*key).sortWithinPartitions(*key)
    return rows.mapInArrow(_each_list(group), "a long, b long, v long, bi long, bj long")


def _links(docs: DataFrame, classes: DataFrame, block: int, percent: int) -> DataFrame:
    """(a, b): pairs of classes whose full sets reach the threshold, enough of them for all components."""
    members = _members(classes, block, percent).checkpoint()
    found = _compared(members.join(classes.select("cid", "n", F.col("sketch").alias("values")), "cid"), functools.partial(_by_sketch, percent=percent)).checkpoint()
    pairs = found.filter("b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct().checkpoint()
    families = members.join(found.filter("b is null").select("v", "bi", "bj").distinct(), ["v", "bi", "bj"], "left_semi").checkpoint()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(families.select("cid")).distinct().checkpoint()
    texts = docs.select(F.col("doc_id").cast("long").alias("cid"), "text").join(wanted, "cid", "left_semi")
    sigs = classes.join(wanted, "cid", "left_semi").select("cid", "n", "sig")
    sets = kept(full_sets(texts).dropDuplicates(["sig"]).join(sigs, "sig").select("cid", "n", "shingles"), "sets")
    a = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    links = pairs.join(a, "a").join(b, "b").filter(both * 100 >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")
    in_families = _compared(families.join(sets.withColumnRenamed("shingles", "values"), "cid"), functools.partial(_exactly, percent=percent)).select("a", "b")
    return links.unionByName(in_families).distinct().checkpoint()


def near_duplicates(docs: DataFrame, block: int = BLOCK, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; documents are linked at `percent` of similarity.

    A null or empty text has no shingles and is linked with nothing. A row without an id is linked with nothing,
    has no component and is kept. Rows with one id are one document, linked by any of their texts. An empty table
    gives no rows. Other columns are not read.
    """
    shared_dir(docs.sparkSession)
    rows = kept(sketches(docs), "sketches")
    classes = rows.filter("n > 0 and doc_id is not null").groupBy("sig", "n", "sketch").agg(F.min("doc_id").alias("cid"))
    classes = classes.checkpoint()
    labels = components(_links(docs, classes, block, percent))
    of = classes.select("sig", "cid").join(labels, F.col("cid") == F.col("node"), "left").select("sig", F.coalesce("component", "cid").alias("c"))
    out = rows.select("doc_id", "n", "sig").join(of, "sig", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("c")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole of documents: 5-word shingles, similarity of 0.85 or more."""
    return near_duplicates(read(spark, sf_dir, "documents"))
