import random

import corpus_pipeline as cp
from quarry.llm import common, minhash, toxicity
from quarry.llm.common import kept
from tests.llm.test_operators import brute_components, id_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus(spark, tmp_path):
    r = random.Random(11)
    plain = ["".join(r.choice(["ba", "lo", "mi", "ren", "tu", "sha"]) for _ in range(r.randrange(1, 5))) for _ in range(400)]
    rows = []
    for i in range(400):
        words = [r.choice(plain) for _ in range(r.randrange(8, 60))]
        if i % 7 == 0:
            words.insert(3, "grumblex")
            words.insert(1, "snarfle")
        if i % 10 == 1:
            words = rows[-1][1].split()[:-1] + ["end"] if len(rows[-1][1].split()) > 60 else rows[-1][1].split()
        if i % 20 == 3:
            words.insert(2, "token=abcdef123")
        rows.append((i, " ".join(words), "en", f"src{i % 3 and 1}", 0))
    rows += [(1000, None, None, None, None), (1001, "", "en", None, 0), (None, "no id here at all", None, "src1", 5), (1002, "twice the same row here", "en", "src1", 3), (1002, "twice the same row here", "en", "src1", 3)]
    d = f"file://{tmp_path}/sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, rows


def test_pipeline_against_brute_force(spark, tmp_path):
    d, rows = corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in cp.STAGES:
        docs = kept(stage(spark, docs, d), name)
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == COLUMNS
    first = spark.read.parquet(f"{d}/documents.parquet")
    model = toxicity.fit(first, spark.read.parquet(f"{d}/labels.parquet"))
    clean = [r for r in toxicity.score(first, model).collect() if r["score"] < 0.3]
    assert sorted(map(str, (r["doc_id"] for r in clean))) == sorted(str(r["doc_id"]) for r in seen["toxicity"]) and not any("grumblex" in (r["text"] or "") for r in seen["toxicity"])
    pairs = [(r["doc_id"], r["text"]) for r in seen["toxicity"]]
    comp = brute_components(pairs)
    want = sorted(str(i) for i in {c for c in comp.values()} | {None})
    assert sorted(str(r["doc_id"]) for r in seen["near_dedup"]) == want
    assert len(seen["secrets"]) == len(seen["near_dedup"]) and not any("token=abc" in (r["text"] or "") for r in seen["secrets"]) and any("[REDACTED]" in (r["text"] or "") for r in seen["secrets"])
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in seen["secrets"])
    assert sorted(map(str, seen["mixing"])) == sorted(map(str, seen["secrets"]))
    tokens = dict(zip([r["doc_id"] for r in seen["mixing"]], id_counts([r["text"] for r in seen["mixing"]])))
    got = {}
    for r in seen["packing"]:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["n_tokens"]
    assert got == tokens
    assert sorted(map(str, cp.run(spark, d).collect())) == sorted(map(str, seen["packing"]))


def test_near_copies_at_80_percent(spark):
    words = [f"w{i}" for i in range(110)]
    texts = [words[:100], words[:90] + words[100:], words[:80] + [f"x{i}" for i in range(20)]]  # 86 of 106, 76 of 116 shingles
    docs = spark.createDataFrame([(i, " ".join(x), "en", "a", 0) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in cp.drop_near_copies(spark, docs, "").collect()) == [0, 2]
    assert minhash.near_duplicates(docs).filter("kept").count() == 3


def test_packing_follows_the_mix(spark, monkeypatch):
    rows = [(i, "w " * (i % 40), "en", "ab"[i % 3 == 0], 0) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    runs = []
    for power in (0.7, 9.0):
        monkeypatch.setattr(cp.mixing, "temperature_weights", lambda counts, power=power: {s: n**power for s, n in counts.items()})
        place = {r["doc_id"]: r["_quarry_place"] for r in cp.place_of(cp.mixing.mix(docs)).collect()}
        out = sorted(cp.pack_sequences(spark, cp.mix_sources(spark, docs, ""), "").collect(), key=lambda r: (r["bin_id"], r["bin_offset"]))
        first = [place[r["doc_id"]] for r in out if r["bin_offset"] == 0]
        assert first == sorted(first) and sorted({r["bin_id"] for r in out}) == list(range(len(first)))
        assert sorted(r["doc_id"] for r in out) == list(range(3000))
        ends = {}
        for r in out:
            assert r["bin_offset"] == ends.get(r["bin_id"], 0) and r["bin_offset"] + r["n_tokens"] <= r["bin_size"]
            ends[r["bin_id"]] = r["bin_offset"] + r["n_tokens"]
        runs.append(sorted(map(str, out)))
    assert runs[0] != runs[1]


def test_stages_keep_columns_and_rows_apart(spark, tmp_path):
    many = " ".join(f"k{i}" for i in range(30))
    rows = [(1, many, 0.25), (1, "another text under one id", 0.5), (2, many + " x", 1.0), (None, many, 2.0), (None, "token=abcdef123 here", 3.0), (3, None, None), (3, None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, x, 7, "b", 5, True) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, slot int, block string, _idx int, kept boolean")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    out = docs
    for (_, stage), n in zip(cp.STAGES[:-1], (7, 6, 6, 6)):
        out = kept(stage(spark, out, f"file://{tmp_path}"), "stage")
        assert out.schema.simpleString() == docs.schema.simpleString() and out.count() == n
    assert sorted(str((r["doc_id"], r["score"])) for r in out.collect()) == sorted(map(str, [(1, 0.25), (1, 0.5), (None, 2.0), (None, 3.0), (3, None), (3, None)]))
    assert sum(r["text"] == "[REDACTED] here" for r in out.collect()) == 1
    packed = cp.pack_sequences(spark, out, "").collect()
    assert len(packed) == 6 and all(len(r["ids"]) == r["n_tokens"] for r in packed)


def test_run_leaves_one_table(spark, tmp_path):
    d, _ = corpus(spark, tmp_path)
    before = common.made()
    out = cp.run(spark, d)
    assert common.made() == before + 1 and out.count() > 100


def test_pipeline_of_nothing(spark, tmp_path):
    d = f"file://{tmp_path}/sf"
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert cp.run(spark, d).count() == 0
