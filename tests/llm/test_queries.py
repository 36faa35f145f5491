"""Each registered query on a small folder of tables, against brute force where its contract fixes values."""

import hashlib
import zlib

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from quarry.llm import mixing, queries, tokenids
from tests.llm.test_operators import LONG, SECRETS, brute_components, expected_spans, near_rows, shingles

TEXTS = near_rows(7)
TEXTS = [(i, t) for n, (i, t) in enumerate(TEXTS) if i is not None and i not in {x for x, _ in TEXTS[:n]}]
TEXTS += [(2000 + i, t) for i, t in enumerate(SECRETS)] + [(3000, LONG), (-5, "negative id")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('sf')}"
    rows = [(i, t, "en", f"s{n % 3 if n % 2 else 0}", 1) for n, (i, t) in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 2)) for i, _ in TEXTS], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(i, f"u{i}", None if i % 9 == 0 else f"<p>{i % 4}</p>" * (i % 4 * 2000)) for i in range(40)], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    r = np.random.default_rng(0)
    x = np.repeat(r.standard_normal((20, 16)), 3, axis=0)
    x += 0.05 * r.standard_normal(x.shape)
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")
    return d, x.astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def run(spark, tables):
    done: dict = {}

    def go(name, *columns):
        if name not in done:
            done[name] = [r.asDict() for r in queries.QUERIES[name](spark, tables[0]).collect()]
        assert all(set(columns) <= set(r) for r in done[name])
        return done[name]

    return go


def test_op1(run):
    rows = run("op1_best_fit_packing", "doc_id", "piece", "n_tokens", "bin_id", "bin_size", "bin_offset")
    bins: dict = {}
    for r in rows:
        bins.setdefault((r["bin_id"], r["bin_size"]), []).append((r["bin_offset"], r["n_tokens"]))
    for (_, size), parts in bins.items():
        parts.sort()
        assert size in (512, 1024, 2048, 4096) and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and sum(n for _, n in parts) <= size
    assert {r["doc_id"] for r in rows} == {i for i, _ in TEXTS}


def test_op2(run):
    rows = {r["doc_id"]: r for r in run("op2_secret_scans", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for i, t in TEXTS:
        base, _ = expected_spans(t or "")
        said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{z}" for a, k, z in base)
        assert rows[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest() and [rows[i][f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(x == n for _, x, _ in base) for n in range(3)]


def test_op3(run):
    rows = {r["page_id"]: r for r in run("op3_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")}
    payload = {i: "" if i % 9 == 0 else f"<p>{i % 4}</p>" * (i % 4 * 2000) for i in range(40)}
    for i, p in payload.items():
        last = max(j for j, q in payload.items() if p == q)
        assert (rows[i]["payload_bytes"], rows[i]["record_type"], rows[i]["refers_to"]) == (len(p), "response" if i == last else "revisit", None if i == last else last)


def test_op4(run):
    rows = run("op4_toxicity", "doc_id", "held_out", "score", "predicted")
    assert len(rows) == len(TEXTS)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_op5(run):
    rows = {r["doc_id"]: r for r in run("op5_media_columns", "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")}
    for i, t in TEXTS:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (rows[i]["n_bytes"], rows[i]["payload_bytes"], rows[i]["payload_sha256"], rows[i]["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))


def test_op6(run):
    rows, want = run("op6_minhash_near_dedup", "doc_id", "n_shingles", "component_id", "kept"), brute_components(TEXTS)
    sizes = {i: len(shingles(t)) for i, t in TEXTS}
    assert {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows} == {(i, sizes[i], want[i], i == want[i]) for i, _ in TEXTS}


def test_op7(run, tables):
    x = tables[1] / np.linalg.norm(tables[1], axis=1)[:, None]
    near = x @ x.T >= 0.95
    rows = {r["vec_id"]: r for r in run("op7_projection_near_dedup", "vec_id", "n_links", "component_id", "kept")}
    assert all(rows[i]["n_links"] == near[i].sum() - 1 for i in range(60))


def test_op8(run):
    rows = run("op8_vector_sharding", "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    size = {i: len((t or "").encode()) + 8 for i, t in TEXTS}
    slots: dict = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["law"] == "bytes" and 0 <= r["shard"] < 24 and r["grown_shard"] is None
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == len(TEXTS) and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_op9(run):
    t, at = Tokenizer.from_file(tokenids.public_tokenizer()), 0
    rows = {r["doc_id"]: r for r in run("op9_token_ids", "doc_id", "start", "n_tokens", "ids_crc32")}
    for i, text in sorted(TEXTS):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op10(run):
    rows = run("op10_pfair_mixing", "doc_id", "source", "block", "release", "deadline", "slot")
    assert sorted(r["doc_id"] for r in rows) == sorted(i for i, _ in TEXTS) and all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    counts: dict = {}
    for r in rows:
        counts[r["source"]] = counts.get(r["source"], 0) + 1
    weights, blocks = mixing.temperature_weights(counts), {}
    for r in rows:
        blocks[r["slot"]] = (r["phase"], r["source"])
    first = [s for _, (p, s) in sorted(blocks.items()) if p == 0]
    for n in range(1, len(first) + 1):
        assert all(abs(first[:n].count(s) - n * w / sum(weights.values())) < 1 for s, w in weights.items())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(run, tables, name):
    with duckdb.connect() as c:
        for t in ("documents", "pages", "embeddings"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0].removeprefix('file://')}/{t}.parquet/*.parquet'")
        found = c.execute(queries.ORACLE_SQL[name])
        columns = [d[0] for d in found.description]
        want = [dict(zip(columns, r, strict=True)) for r in found.fetchall()]
    rows = run(name)
    assert sorted(rows, key=lambda r: str(sorted(r.items()))) == sorted(want, key=lambda r: str(sorted(r.items()))) and rows
