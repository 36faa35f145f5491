"""Toxicity by Levenshtein automata over a lexicon trie (operator 4).

The lexicon is learned: words whose share of labelled toxic documents is many times that of the others, in enough
different contexts (copies of one text give one context). A text's distinct words run through one automaton, the
intersection of the lexicon's trie with the Levenshtein automata of its terms: a state is a set of (trie node,
edits so far), made into a deterministic state when it is first met. So misspelled terms are found at the cost of a
table look-up a letter, and words that are near no term end after a few letters. Each hit has a score of its window,
from 0 (abuse) to 1 (quotation), by the distance of quotation marks around it and of words of report before it, and
counts to that part as a quotation, which has its own feature. A logistic regression on a handful of features,
fitted on a bounded sample of labelled rows, gives the score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read, shared_dir
from quarry.llm.words import AT_ONCE, LOWER, hashes, raw, split

#: Labelled rows that a model is fitted on, about; the bound holds at any size of the input.
FIT_ROWS = 20_000
MIN_CONTEXTS, MIN_LIFT, WINDOW, THRESHOLD = 6, 8.0, 6, 0.3
#: The score of every text where labels tell nothing.
NOTHING = 0.01
#: Beginnings of words of these lengths are terms too, if they are as telling in STEM_CONTEXTS contexts; written with a star.
STEMS, STEM_CONTEXTS = (4, 5, 6), 12
EDGE = "\"'`.,;:!?()[]{}<>«»„“”‘’…*#%&$|-–—~_=+/\\"
QUOTES = "\"“”„«»‘’'`"
#: Verbs and nouns of report, in the languages of the corpus. Fixed values.
REPORT = frozenset("said says called calls wrote quoted quote word term insult slur said: dit disait appelé mot insulte citation sagte sagt nannte wort zitat beleidigung dijo dice llamó palabra insulto cita".split())
FEATURES = ("hit", "log_hits", "log_near", "log_quoted", "density", "terms")


def edits(term: str) -> int:
    """Edits in which a word still counts as the term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """Words within edits(term) of a term, and words that begin with a starred term; terms may be exact only."""

    def __init__(self, terms: list[str], exact_only: frozenset[str] = frozenset()):
        self.children: list[dict[str, int]] = [{}]
        self.stem: dict[int, int] = {}
        self.term: list[int] = [-1]
        self.reach: list[int] = [0]  # the most edits of a term below the node
        self.terms = sorted(set(terms))
        self.limit = [0 if t in exact_only or t[-1:] == "*" else edits(t) for t in self.terms]
        for n, t in enumerate(self.terms):
            at = 0
            self.reach[0] = max(self.reach[0], self.limit[n])
            for c in t.removesuffix("*"):
                at = self.children[at].setdefault(c, len(self.children))
                if at == len(self.term):
                    self.children.append({})
                    self.term.append(-1)
                    self.reach.append(0)
                self.reach[at] = max(self.reach[at], self.limit[n])
            if t[-1:] == "*":
                self.stem[at] = n
            else:
                self.term[at] = n
        self.letters = frozenset(c for t in self.terms for c in t)
        self.states: list[dict[int, int]] = []
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[int, int] | None] = []
        self.surely: list[tuple[int, int] | None] = []  # whatever follows
        self.number: dict[frozenset[tuple[int, int]], int] = {}
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of the state that also holds what is reached by leaving letters of a term out; -1: none."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if nodes.get(node) != e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
                    todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if not key:
            return -1
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(dict(nodes))
            self.steps.append({})
            ends = [(e, self.term[n]) for n, e in nodes.items() if self.term[n] >= 0 and e <= self.limit[self.term[n]]]
            self.ends.append(min(ends) if ends else None)
            self.surely.append(next(((0, self.stem[n]) for n, e in nodes.items() if e == 0 and n in self.stem), None))
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        nodes: dict[int, int] = {}
        for node, e in self.states[state].items():
            if (child := self.children[node].get(c)) is not None and e < nodes.get(child, 9):
                nodes[child] = e
            if e + 1 <= self.reach[node] and e + 1 < nodes.get(node, 9):  # a letter too many
                nodes[node] = e + 1
            for child in self.children[node].values():  # another letter
                if e + 1 <= self.reach[child] and e + 1 < nodes.get(child, 9):
                    nodes[child] = e + 1
        self.steps[state][c] = out = self._state(nodes)
        return out

    def find(self, word: str) -> tuple[int, int] | None:
        """(edits, place of the term) of the nearest term, or None."""
        state, steps, letters, surely = self.start, self.steps, self.letters, self.surely
        for c in word:
            if c not in letters:
                c = "\0"  # all letters that no term has do the same
            nxt = steps[state].get(c)
            if nxt is None:
                nxt = self._step(state, c)
            if nxt < 0:
                return None
            state = nxt
            if surely[state]:
                return surely[state]
        return self.ends[state]


def levenshtein(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    exact_only: frozenset[str] = frozenset()
    mean: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES)))
    scale: np.ndarray = field(default_factory=lambda: np.ones(len(FEATURES)))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(len(FEATURES) + 1))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def quotation(text: bytes, begin: np.ndarray, length: np.ndarray, first: int, last: int, at: int) -> float:
    """How far the window of a hit makes it a quotation: 0 abuse, 1 quoted or reported.

    Marks of quotation on both sides count by the words between them and the hit, words of report before it by their
    distance; the stronger of the two counts.
    """
    low, high = max(first, at - WINDOW), min(last, at + WINDOW + 1)
    around = [text[begin[k] : begin[k] + length[k]].decode("utf-8", "replace") for k in range(low, high)]
    here = at - low
    opens = next((here - k for k in range(here, -1, -1) if around[k][:1] in QUOTES), None)
    closes = next((k - here for k in range(here, len(around)) if (w := around[k].rstrip(".,;:!?")) and w[-1] in QUOTES), None)
    marks = 0.0 if opens is None or closes is None else min(1.0, 2 - (opens + closes) / (WINDOW + 1))
    report = next((k for k in range(1, min(here, WINDOW) + 1) if around[here - k].strip(EDGE).lower() in REPORT), None)
    return max(marks, 0.0 if report is None else min(1.0, (WINDOW + 1 - report) / 4))


def hits(column: pa.Array, automaton: Automaton) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    """(number of words, [(term, edits, quotation)]) of each row."""
    data, offsets = raw(column)
    if len(data) > AT_ONCE and len(column) > 1:
        half = min(max(1, int(np.searchsorted(offsets, len(data) // 2))), len(column) - 1)
        yield from hits(column.slice(0, half), automaton)
        yield from hits(column.slice(half), automaton)
        return
    begin, length, first = split(data, offsets)
    rows: list[list[tuple[int, int, float]]] = [[] for _ in range(len(column))]
    if len(begin):
        _, at, inverse = np.unique(hashes(LOWER[data], begin, length), return_index=True, return_inverse=True)
        text, term, near = data.tobytes(), np.full(len(at), -1), np.zeros(len(at), int)
        for u, (a, n) in enumerate(zip(begin[at].tolist(), length[at].tolist(), strict=True)):
            if found := automaton.find(text[a : a + n].decode("utf-8", "replace").strip(EDGE).lower()):
                near[u], term[u] = found
        which = term[inverse]
        for w in np.flatnonzero(which >= 0).tolist():
            row = int(np.searchsorted(first, w, side="right")) - 1
            rows[row].append((int(which[w]), int(near[inverse[w]]), quotation(text, begin, length, int(first[row]), int(first[row + 1]), w)))
    yield from zip((first[1:] - first[:-1]).tolist(), rows, strict=True)


def features(words: int, found: list[tuple[int, int, float]]) -> list[float]:
    """Each hit counts as abuse by what its window leaves of it, and as a quotation by the rest."""
    plain = sum(1 - q for _, e, q in found if e == 0)
    near = sum(1 - q for _, e, q in found if e > 0)
    quoted = sum(q for _, _, q in found)
    terms: dict[int, float] = {}
    for t, _, q in found:
        terms[t] = max(terms.get(t, 0.0), 1 - q)
    return [min(1.0, max(terms.values(), default=0.0)), math.log1p(plain), math.log1p(near), math.log1p(quoted), min(1.0, 20 * (plain + near) / max(1, words)), math.log1p(sum(terms.values()))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights, the constant first, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lexicon(sample: DataFrame) -> list[str]:
    """The learned terms of a sample (text, toxic)."""
    low = F.split(F.lower(F.regexp_replace(F.trim("text"), r"[\x09-\x0D]", " ")), " +")
    words = sample.select("toxic", low.alias("w"))

    def units(word):
        return F.array_compact(F.array(word, *[F.when(F.length(word) >= n, F.concat(F.substring(word, 1, n), F.lit("*"))) for n in STEMS]))

    # A text counts once for each of its units, so they are made distinct where it is and sums are partial ones.
    long = F.filter(F.array_distinct(F.transform("w", lambda x: F.btrim(x, F.lit(EDGE)))), lambda x: F.length(x) >= 3)
    of_text = words.select("toxic", F.explode(F.array_distinct(F.flatten(F.transform(long, units)))).alias("word"))
    in_context = F.transform("w", lambda x, i: F.struct(F.btrim(x, F.lit(EDGE)).alias("word"), F.xxhash64(F.get("w", i - 1)).alias("context")))
    pairs = words.filter("toxic = 1").select(F.inline(in_context)).filter("length(word) >= 3").select(F.explode(units(F.col("word"))).alias("word"), "context").distinct()
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    least = F.when(F.col("word").endswith("*"), STEM_CONTEXTS).otherwise(MIN_CONTEXTS)
    contexts = pairs.groupBy("word").agg(F.count("*").alias("contexts")).filter(F.col("contexts") >= least)
    toxic = of_text.filter("toxic = 1").groupBy("word").agg(F.count("*").alias("docs")).join(contexts, "word").checkpoint()
    clean = of_text.filter("toxic = 0").join(toxic.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("clean"))
    share = (F.least("docs", "contexts") / total[1]) / ((F.coalesce("clean", F.lit(0)) + 0.5) / total[0])
    found = {r["word"] for r in toxic.join(clean, "word", "left").filter(share >= MIN_LIFT).select("word").collect()}
    return sorted(w for w in found if w[-1] != "*" or not any(w[:n] + "*" in found for n in STEMS if n < len(w) - 1))


def labelled(docs: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(text, toxic): about `rows` labelled rows that are not held out, chosen by a hash of the id."""
    known = labels.filter("toxic in (0, 1) and doc_id is not null").filter(~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # toxic, where labels of one id differ
    n = known.count()
    if n > rows:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(rows / n * (1 << 20)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic")).filter("text is not null")


def is_held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model of the labels.

    Where they are all alike, or no word tells them apart, nothing is known of any text and the model finds none
    toxic: its score is NOTHING, whatever the share of toxic rows is.
    """
    shared_dir(docs.sparkSession)
    sample = labelled(docs, labels, rows).checkpoint()
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    terms = lexicon(sample) if len(total) == 2 else []
    if not terms:
        return Model(weights=np.array([math.log(NOTHING / (1 - NOTHING))] + [0.0] * len(FEATURES)))
    automaton = Automaton(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = list(hits(b.column(0), automaton))
            kind = pa.list_(pa.struct([("term", pa.int32()), ("edits", pa.int32()), ("quoted", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([n for n, _ in out], pa.int64()), pa.array([[{"term": t, "edits": e, "quoted": q} for t, e, q in f] for _, f in out], kind)], names=["toxic", "words", "hits"])

    found = sample.select("text", "toxic").mapInArrow(run, "toxic int, words long, hits array<struct<term: int, edits: int, quoted: double>>").checkpoint()
    # A term whose misspellings are as common in other texts counts in its own spelling alone.
    near = found.select("toxic", F.explode(F.array_distinct(F.expr("transform(filter(hits, x -> x.edits > 0), x -> x.term)"))).alias("term")).groupBy("term", "toxic").count().collect()
    share = {(r["term"], r["toxic"]): r["count"] / total[r["toxic"]] for r in near}
    loose = frozenset(t for n, t in enumerate(automaton.terms) if share.get((n, 0), 0) * 4 > share.get((n, 1), 0))
    rows_ = found.collect()  # at most the sample's rows, without texts
    x = np.array([features(r["words"], [(h["term"], h["edits"], h["quoted"]) for h in r["hits"] if h["edits"] == 0 or automaton.terms[h["term"]] not in loose]) for r in rows_])
    y = np.array([r["toxic"] for r in rows_], float)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    return Model(automaton.terms, loose, mean, np.maximum(scale, 1e-3), logistic((x - mean) / np.maximum(scale, 1e-3), y))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with the column score; a null text is scored as an empty one. A column of that name is replaced."""
    docs = docs.drop("score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(model.terms, model.exact_only)
        for b in batches:
            x = np.array([features(n, f) for n, f in hits(b.column(0), automaton)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(model.score(x))], names=[*b.schema.names[1:], "score"])

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*docs.schema.fields, StructField("score", DoubleType())])
    return docs.select(F.coalesce(F.col(text), F.lit("")).alias("_quarry_text"), "*").mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents; labels are learned from rows that are not held out.

    Rows without an id are scored and not held out; repeated rows have equal scores; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"))
    out = score(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


