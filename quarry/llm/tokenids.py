"""Token ids in word-aligned Simple-8b files (operator 9).

A file is a run of frames, in ascending document order; it is written by Spark's own file writer, one frame a
record, a newline byte after each. All numbers are little-endian. A frame:

    "QS8B", u32 documents, u64 ids, u32 blocks, u32 words, then
    documents * (i64 id, u8 id is there, u64 ids), blocks * u32 (the word at which the block begins), words * u64

A block holds 128 ids (the last one fewer). The top 4 bits of a word select how many ids it packs and in how
many bits; selector 0 is an escape: the next word is one id of any 64 bits; selector 1 is a run of 128 zeros or
the rest of the block.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm.common import drop_path, new_path, read, small_table
from quarry.llm.words import LOWER, SPACES, hashes, raw, split

BLOCK = 128
#: Ids a word and bits an id, by selector. Fixed values of Simple-8b, but for 0 (escape) and 1 (zeros).
COUNT = np.array([1, BLOCK, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BITS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
HEAD = struct.Struct("<4sIQII")
#: Ids a frame, about.
FRAME_IDS = 1 << 19


_WIDTH_OF = np.frompyfunc(int.bit_length, 1, 1)(range(1 << 16)).astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    top = int(ids.max()).bit_length() if len(ids) else 0
    if top <= 16:
        return _WIDTH_OF[ids]
    width = np.zeros(len(ids), np.uint8)
    for b in range(top):
        width += ids >= np.uint64(1 << b)
    return width


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, word at which each block begins)."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    # Widths by block; the last block is filled up with zeros. A word may end with its block, part full.
    grid = np.zeros(-(-n // BLOCK) * BLOCK, np.uint8)
    grid[:n] = _widths(ids)
    widest_of, run = {1: grid.reshape(-1, BLOCK)}, 1
    while run < BLOCK:
        longer = widest_of[run].copy()
        np.maximum(longer[:, :-run], widest_of[run][:, run:], out=longer[:, :-run])
        run *= 2
        widest_of[run] = longer
    pick, open_ = np.zeros(n, np.uint8), np.ones(n, bool)
    for s in range(1, 16):
        k = int(COUNT[s])
        p = 1 << (k.bit_length() - 1)
        widest = widest_of[p].copy()
        if k > p:
            np.maximum(widest[:, : BLOCK - k + p], widest_of[p][:, k - p :], out=widest[:, : BLOCK - k + p])
        fits = open_ & (widest.reshape(-1)[:n] <= BITS[s])
        pick[fits] = s
        open_ &= ~fits
    place_in = np.arange(n)
    step = np.minimum(COUNT[pick], np.minimum(BLOCK - place_in % BLOCK, n - place_in))
    # Follow each block's words side by side.
    at = np.arange(0, n, BLOCK)
    end = np.minimum(at + BLOCK, n)
    found = []
    while len(at):
        found.append(at)
        at = at + step[at]
        more = at < end
        at, end = at[more], end[more]
    begin = np.sort(np.concatenate(found))
    sel = pick[begin]
    place = np.arange(len(begin)) + np.cumsum(sel == 0) - (sel == 0)
    words = np.zeros(len(begin) + int((sel == 0).sum()), np.uint64)
    words[place] = sel.astype(np.uint64) << np.uint64(60)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        first, here = begin[rows], place[rows]
        if s == 0:
            words[here + 1] = ids[first]
        elif s > 1:
            full = step[first] == COUNT[s]
            packed, at_ = np.zeros(len(rows), np.uint64), first[full]
            whole = np.zeros(len(at_), np.uint64)
            for j in range(int(COUNT[s])):
                whole |= ids[at_ + j] << np.uint64(j * int(BITS[s]))
            packed[full] = whole
            part = np.flatnonzero(~full)
            for j in range(int(COUNT[s]) if len(part) else 0):
                ok = part[step[first[part]] > j]
                packed[ok] |= ids[first[ok] + j] << np.uint64(j * int(BITS[s]))
            words[here] |= packed
    return words, place[np.searchsorted(begin, np.arange(0, n, BLOCK))].astype(np.uint32)


def unpack(words: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The n ids of these words."""
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    is_word = np.ones(len(words), bool)
    sel = (words >> np.uint64(60)).astype(np.uint8)
    if (sel == 0).any():  # what follows an escape is not a word; blocks without zero selectors need no look
        for b in np.unique(np.searchsorted(starts, np.flatnonzero(sel == 0), side="right") - 1):
            i, end = int(starts[b]), int(starts[b + 1]) if b + 1 < len(starts) else len(words)
            while i < end:
                if sel[i] == 0:
                    is_word[i + 1] = False
                    i += 1
                i += 1
    at = np.flatnonzero(is_word)
    sel = sel[at]
    block = np.searchsorted(starts, at, side="right") - 1
    sizes = COUNT[sel]
    before = np.cumsum(sizes) - sizes
    begin = block * BLOCK + before - before[np.searchsorted(at, starts)][block]  # a block's last word may be part full
    end = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(sel):
        rows = np.flatnonzero(sel == s)
        if s == 0:
            out[begin[rows]] = words[at[rows] + 1]
        elif s > 1:
            mask = np.uint64((1 << int(BITS[s])) - 1)
            for j in range(int(COUNT[s])):
                ok = rows[begin[rows] + j < end[rows]]
                out[begin[ok] + j] = words[at[ok]] >> np.uint64(j * int(BITS[s])) & mask
    return out


def frame(doc_ids: list[int | None], counts: list[int], ids: np.ndarray) -> bytes:
    words, starts = pack(ids)
    docs = np.zeros(len(doc_ids), dtype=[("id", "<i8"), ("there", "u1"), ("n", "<u8")])
    docs["id"] = [0 if d is None else d for d in doc_ids]
    docs["there"] = [d is not None for d in doc_ids]
    docs["n"] = counts
    return b"".join((HEAD.pack(b"QS8B", len(docs), len(ids), len(starts), len(words)), docs.tobytes(), starts.astype("<u4").tobytes(), words.astype("<u8").tobytes()))


def frames(data: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents, ids) of each frame of a file."""
    kind, at = np.dtype([("id", "<i8"), ("there", "u1"), ("n", "<u8")]), 0
    while at < len(data):
        magic, n_docs, n_ids, n_blocks, n_words = HEAD.unpack_from(data, at)
        if magic != b"QS8B":
            raise ValueError("not a frame")
        at += HEAD.size
        docs = np.frombuffer(data, kind, n_docs, at)
        at += docs.nbytes
        starts = np.frombuffer(data, "<u4", n_blocks, at)
        at += starts.nbytes
        words = np.frombuffer(data, "<u8", n_words, at)
        at += words.nbytes + 1
        yield docs, unpack(words, starts, n_ids)


#: Marks that may follow letters; the tokenizer takes a run of them as one piece. An apostrophe can begin another.
MARKS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
PROBE = "the quick brown fox été größe niño façade s t re ll antidisestablishmentarianism"
#: Classes of bytes: white space, lower-case letters (with the Latin-1 ones, see _classes), marks, all others.
_SPACE, _LETTER, _MARK, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[97:123], _CLASS[[ord(c) for c in MARKS]], _CLASS[SPACES] = _LETTER, _MARK, _SPACE
#: Bytes of text that are encoded at once, but for a longer text; words in letters that the tokenizer gets at once.
SLICE, AT_ONCE = 1 << 22, 10_000
#: Parts in letters that a worker knows at most; a bound on memory only.
KNOWN = 1_000_000


def _lowered(data: np.ndarray) -> np.ndarray:
    """Letters of ASCII and Latin-1 in lower case."""
    data = LOWER[data]
    two = np.flatnonzero(data[:-1] == 0xC3) + 1
    two = two[(data[two] <= 0x9E) & (data[two] != 0x97)]
    data[two] += 0x20
    return data


def _classes(data: np.ndarray) -> np.ndarray:
    out = _CLASS[data]
    two = np.flatnonzero(data[:-1] == 0xC3)
    two = two[(data[two + 1] > 0x9E) & (data[two + 1] != 0xB7)]
    out[two] = out[two + 1] = _LETTER
    return out


class Known:
    """Ids of parts by hash: sorted arrays, a few bytes an entry, begun anew beyond `limit` entries."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.many, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, "<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of each key, whether it is there)."""
        at = np.searchsorted(self.keys, keys)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, ids: np.ndarray, many: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, len(self.flat) + np.cumsum(many) - many)
        self.many = np.insert(self.many, at, many)
        self.flat = np.concatenate([self.flat, ids])


_ENCODERS: dict[tuple[str, int], "Encoder"] = {}


class Encoder:
    """Texts -> their ids, each text's followed by the end id.

    The tokenizer splits at white space before anything else and drops it, and parts letters from the marks that
    follow them; so the ids of a text are those of its words, and of the two parts of a word in letters and final
    marks. Each distinct part of a slice of texts is encoded once: parts are told apart by a 64-bit hash of their
    bytes, letters in lower case as the tokenizer puts them itself. Those in lower-case letters go to the tokenizer
    in one text, in which the ids that end a word tell them apart; for them, normalising and the search for word
    boundaries find nothing to do and are left out. All others are encoded as they are.
    """

    def __init__(self, tokenizer_path: str, end_id: int):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.end, self.plain = end_id, None
        self.known = Known(KNOWN)
        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if suffix and "Lowercase" in str(self.tokenizer.normalizer):
            self.ends_word = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
            self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
            plain = Tokenizer.from_file(tokenizer_path)
            plain.normalizer = normalizers.Sequence([])
            plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            if plain.encode(PROBE).ids == self.tokenizer.encode(PROBE).ids:
                self.plain = plain

    def _parts(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, length, whether in letters alone) of the parts of words, in order."""
        kind = _classes(data)
        end = begin + length
        turn = kind == _OTHER
        turn[1:] |= (kind[:-1] == _MARK) & (kind[1:] == _LETTER)  # marks and then letters
        odd = np.cumsum(turn, dtype=np.int32)
        plain = (odd[end - 1] == odd[begin]) & (kind[begin] != _OTHER)
        del odd, turn
        mark = np.cumsum(kind == _MARK, dtype=np.int32)
        marks = np.where(plain, mark[end - 1] - mark[begin] + (kind[begin] == _MARK), 0)
        del mark, kind
        cut = np.flatnonzero(plain & (marks > 0) & (marks < length))
        starts = np.concatenate([begin, end[cut] - marks[cut]])
        sizes = np.concatenate([length, marks[cut]])
        sizes[cut] -= marks[cut]
        letters = np.concatenate([plain & (marks < length), np.zeros(len(cut), bool)])
        order = np.argsort(starts, kind="stable")
        return starts[order], sizes[order], letters[order]

    def _encode_letters(self, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, how many each has) of parts in letters, or None if they cannot be told apart."""
        out, sizes = [], []
        for i in range(0, len(begin), AT_ONCE):  # what the tokenizer keeps of a text is many times its size
            first, wide = begin[i : i + AT_ONCE], length[i : i + AT_ONCE] + 1
            after = np.cumsum(wide)
            joined = data[np.minimum(np.repeat(first - (after - wide), wide) + np.arange(after[-1]), len(data) - 1)]
            joined[after - 1] = 32
            ids = np.array(self.plain.encode_batch_fast([joined.tobytes().decode("utf-8")], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) != len(first):
                return None
            out.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(out), np.concatenate(sizes)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in turn, how many are each row's) of a string column without nulls."""
        data, offsets = raw(column)
        if len(data) > SLICE and len(column) > 1:
            half = min(max(1, int(np.searchsorted(offsets, len(data) // 2))), len(column) - 1)
            a, b = self.encode(column.slice(0, half)), self.encode(column.slice(half))
            return np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
        text = data.tobytes()
        if self.plain and b"<|" not in text:  # special tokens are found before letters are put in lower case
            data = _lowered(data)
        begin, length, first = split(data, offsets)
        if not len(begin):
            return np.full(len(column), self.end, "<u4"), np.ones(len(column), np.int64)
        letters = np.zeros(len(begin), bool)
        if self.plain:
            begin, length, letters = self._parts(data, begin, length)
            first = np.searchsorted(begin, offsets)
        keys, at, which = np.unique(hashes(data, begin, length), return_index=True, return_inverse=True)
        begin, length, letters = begin[at], length[at], letters[at]
        many, start, rest = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), ~letters
        if letters.any():
            if len(self.known.keys) + int(letters.sum()) > self.known.limit:
                self.known.clear()
            new = np.flatnonzero(letters)
            new = new[~self.known.find(keys[new])[1]]
            found = self._encode_letters(data, begin[new], length[new]) if len(new) else None
            if found is not None:
                self.known.add(keys[new], *found)
            elif len(new):
                rest[new] = True
            plain = np.flatnonzero(~rest)
            place, _ = self.known.find(keys[plain])
            many[plain], start[plain] = self.known.many[place], self.known.start[place]
        rest = np.flatnonzero(rest)
        words = [text[a : a + n].decode("utf-8") for a, n in zip(begin[rest].tolist(), length[rest].tolist(), strict=True)]
        others = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        many[rest] = np.fromiter(map(len, others), np.int64, len(others))
        start[rest] = len(self.known.flat) + np.cumsum(many[rest]) - many[rest]
        flat = np.concatenate([self.known.flat, np.array([i for x in others for i in x], dtype="<u4")])
        n = many[which]
        after = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat((start[which] - after[:-1]).astype(np.int32), n)
        place += np.arange(after[-1], dtype=np.int32)
        return np.insert(flat[place], after[first[1:]], self.end), np.diff(after[first]) + 1


def encoder_of(tokenizer_path: str, end_id: int) -> Encoder:
    """The worker's encoder: read once, it knows the parts that it met in earlier tasks."""
    key = tokenizer_path, end_id
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(tokenizer_path, end_id)
    return _ENCODERS[key]


def encoder(tokenizer_path: str, end_id: int):
    """text -> its ids and the end id as little-endian u32."""
    e = encoder_of(tokenizer_path, end_id)
    return lambda text: e.encode(pa.array([text]))[0].astype("<u4").tobytes()


def write_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1, frames_per_file: int = 32) -> None:
    """Writes the files under path; their partitions and numbers ascend with doc_id (null ids first).

    Rows that share an id, or have none, go by their input place, so they are dealt over many files too.
    """
    schema = "frame binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer_path, end_id)
        for b in batches:
            at = 0
            while at < len(b):  # as many rows as make about a slice, in frames
                sizes = np.diff(raw(b.column(1).slice(at))[1])
                part = b.slice(at, max(1, int(np.searchsorted(np.cumsum(sizes), SLICE, side="right"))))
                at += len(part)
                ids, counts = encoder.encode(part.column(1))
                names, ends = part.column(0).to_pylist(), np.cumsum(counts)
                cuts = np.flatnonzero(np.diff(ends // FRAME_IDS, append=-1)) + 1
                for a, z in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
                    made = frame(names[a:z], counts[a:z].tolist(), ids[ends[a] - counts[a] : ends[z - 1]])
                    yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["frame"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("at"))
    rows = rows.repartitionByRange("doc_id", "at").sortWithinPartitions("doc_id", "at").select("doc_id", "text")
    rows.mapInArrow(run, schema).select(F.col("frame").cast("string")).write.option("maxRecordsPerFile", frames_per_file).text(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files alone."""
    schema = "path string, nth long, doc_id long, before long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                nth = before = 0
                for docs, ids in frames(data.as_py()):
                    raw, counts = ids.astype("<u4").tobytes(), docs["n"].astype(np.int64)
                    ends = np.cumsum(counts)
                    crcs = [zlib.crc32(raw[4 * a : 4 * z]) for a, z in zip((ends - counts).tolist(), ends.tolist(), strict=True)]
                    n = len(docs)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p] * n), pa.array(np.arange(nth, nth + n)), pa.array(docs["id"].astype(np.int64), mask=docs["there"] == 0), pa.array(before + ends - counts), pa.array(counts), pa.array(crcs, pa.int64())],
                        names=["path", "nth", "doc_id", "before", "n_tokens", "ids_crc32"],
                    )
                    nth, before = nth + n, before + int(ends[-1])

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content").mapInArrow(run, schema)


def with_starts(found: DataFrame) -> DataFrame:
    """Adds each document's first place, in the order of the files' partitions and numbers (as numbers, not as text).

    Files add up inside their partition; the driver gets one sum a partition of the writer, not one a file.
    """
    spark = found.sparkSession
    at = [F.regexp_extract("path", r"part-(\d+)[^/]*$", 1).cast("long").alias("p"), F.coalesce(F.regexp_extract("path", r"-c(\d+)[^/]*$", 1).try_cast("long"), F.lit(0)).alias("c")]
    found = found.select(*at, "doc_id", "before", "n_tokens", "ids_crc32")
    files = found.groupBy("p", "c").agg(F.sum("n_tokens").alias("n"))
    in_part = F.sum("n").over(W.partitionBy("p").orderBy("c").rowsBetween(W.unboundedPreceding, -1))
    files = files.select("p", "c", "n", F.coalesce(in_part, F.lit(0)).alias("here")).checkpoint()
    first, parts = 0, []
    for r in files.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        parts.append({"p": r["p"], "first": first})
        first += r["n"]
    files = files.join(small_table(spark, parts, "p long, first long"), "p").select("p", "c", (F.col("first") + F.col("here")).alias("first"))
    return found.join(files, ["p", "c"]).select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as ids in files, read back.

    Null and empty texts have the end id alone; null ids come first; repeated rows stay next to each other; an
    empty table gives no rows; other columns are not read.
    """
    path = new_path(spark, "ids")
    write_files(read(spark, sf_dir, "documents"), path, public_tokenizer())
    found = read_files(spark, path).checkpoint()
    drop_path(spark, path)
    return with_starts(found)
