"""Secret scans through a trigram index (operator 2).

From each rule's expression a Boolean query over trigrams is derived. The inverted index holds, for the trigrams
that some query names, the documents whose lower-cased text contains them. Posting lists are intersected and
united by document as bits, which are partly summed before the shuffle; only documents that satisfy a rule's query
are searched by its expression. Rules without a mandatory trigram search every text. All of it is DataFrame
expressions. Texts meet the candidates by an inner join, before which Spark can drop other texts by a Bloom filter
or send no text at all where the candidates are few; results join by (doc_id, hash of the text).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import kept, read, shared_dir
from quarry.llm.trigrams import grams, trigram_query


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Of the match, the group that must have `least` characters.
    group: int = 0
    least: int = 1


#: The first three are fixed by the operator's contract.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),  # the runs of 24 or more of [0-9a-f]+
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("git_host", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("payment", r"sk_live_[A-Za-z0-9]+", 0, 24),
    Rule("url_login", r"://[A-Za-z0-9._~-]+:[A-Za-z0-9._~%!$&*+=-]+@"),
)
BASE = ("assign", "access", "hex")
_SPANS = "array<struct<start: int, kind: int, end: int>>"


def spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, number, end) of a rule's matches in code points: what lies between them is measured."""
    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    parts = F.arrays_zip(gaps.alias("gap"), matches.alias("match"), F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"))
    begin = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {_SPANS})").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        found = F.array(F.struct(start.alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(F.length(x["value"]) >= rule.least, F.concat(acc["out"], found)).otherwise(acc["out"]).alias("out"))

    return F.when(text.rlike(rule.pattern), F.aggregate(parts, begin, step)["out"]).otherwise(begin["out"])


def postings(docs: DataFrame, wanted: list[str]) -> DataFrame:
    """(gram, doc_id): the inverted index of these trigrams; gram is a place in `wanted`."""
    low = F.lower(F.coalesce("text", F.lit("")))
    held = F.array_compact(F.array(*[F.when(F.contains(F.col("low"), F.lit(g)), F.lit(i)) for i, g in enumerate(wanted)]))
    return docs.select("doc_id", low.alias("low")).select("doc_id", F.explode(held).alias("gram"))


def candidates(index: DataFrame, rules: dict[int, object], wanted: list[str]) -> DataFrame:
    """(doc_id, rules): the rules whose queries the posting lists satisfy, by document."""
    place = {g: i for i, g in enumerate(wanted)}
    words = -(-len(wanted) // 62)
    bits = [F.bit_or(F.when(F.expr(f"gram div 62 = {w}"), F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"w{w}") for w in range(words)]

    def test(query: object) -> Column:
        if isinstance(query, str):
            i = place[query]
            return F.col(f"w{i // 62}").bitwiseAND(F.lit(1 << i % 62)) != 0
        if query[0] == "and" and all(isinstance(x, str) for x in query[1]):
            masks = [sum(1 << place[x] % 62 for x in query[1] if place[x] // 62 == w) for w in range(words)]
            return reduce(Column.__and__, [F.col(f"w{w}").bitwiseAND(F.lit(m)) == m for w, m in enumerate(masks) if m])
        return reduce(Column.__and__ if query[0] == "and" else Column.__or__, map(test, query[1]))

    found = F.array_compact(F.array(*[F.when(test(q), F.lit(n)) for n, q in rules.items()]))
    return index.groupBy("doc_id").agg(*bits).select("doc_id", found.alias("rules")).filter(F.size("rules") > 0)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, text_hash, spans for every row: an array of (start, kind: place of the rule, end), in that order.

    A null text is empty and has no spans. Rows with one id, or without, are candidates together, and each is
    searched itself. An empty table gives no rows. Other columns are not read.
    """
    shared_dir(docs.sparkSession)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    indexed = {n: q for n, q in queries.items() if q is not True}
    everywhere = [spans(F.col("text"), r, n) for n, r in enumerate(rules) if n not in indexed]
    none = F.expr(f"cast(array() as {_SPANS})")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_h"), F.concat(none, *everywhere).alias("_full"))
    if not indexed:
        return rows.select("doc_id", F.col("_h").alias("text_hash"), F.array_sort("_full").alias("spans"))
    wanted = sorted(set().union(*map(grams, indexed.values())))
    found = candidates(postings(docs, wanted), indexed, wanted).withColumnRenamed("doc_id", "_id")
    found = kept(found, "candidates")  # its size is known then: texts are shuffled only where it is large
    searched = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_id")))
    by_rule = [F.when(F.array_contains("rules", n), spans(F.col("text"), rules[n], n)).otherwise(none) for n in indexed]
    searched = searched.select(F.col("_id"), F.xxhash64("text").alias("_g"), F.concat(*by_rule).alias("_some")).filter(F.size("_some") > 0).distinct()
    searched = kept(searched, "secrets")
    rows = rows.join(searched, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    return rows.select("doc_id", F.col("_h").alias("text_hash"), F.array_sort(F.concat("_full", F.coalesce("_some", none))).alias("spans"))


def joined(spans_column: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans_column, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    base = [n for n, r in enumerate(rules) if r.kind in BASE]
    counts = [F.expr(f"cast(size(filter(spans, x -> x.kind = {n})) as long)").alias(f"n_{rules[n].kind}") for n in base]
    own = F.filter("spans", lambda x: x["kind"].isin(base))
    return found.select("doc_id", *counts, F.sha2(joined(own, rules).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """docs with the spans of all rules replaced in text; rows without spans, and null texts, stay as they are."""
    found = scan(docs, rules).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_quarry_id"), F.col("text_hash").alias("_quarry_hash"), F.col("spans").alias("_quarry_spans")).distinct()
    found = kept(found, "found")
    same = F.col("doc_id").eqNullSafe(F.col("_quarry_id")) & (F.xxhash64("text") == F.col("_quarry_hash"))
    text = F.when(F.col("_quarry_spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("_quarry_spans"), mark))
    return docs.join(found, same, "left").withColumn("text", text).select(*docs.columns)


def redact(text: Column, spans_column: Column, mark: str = "[REDACTED]") -> Column:
    """The text with each span, or run of overlapping spans, replaced by the mark."""
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = x["start"] >= acc["at"]
        piece = F.when(new, F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), piece.alias("out"))

    return F.aggregate(spans_column, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents."""
    return digest(scan(read(spark, sf_dir, "documents")))
