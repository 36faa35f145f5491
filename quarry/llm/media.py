"""Media columns: ISO base media containers (operator 5).

`to_media` stores bytes as a track of 8x8 grey frames of 8-bit samples, one container in a binary column.
`probe` walks the boxes of such a column, decodes the sample tables of each track and returns codec, duration
and the byte ranges of the key frames; media data is not decoded. `read_payload` gives the samples' bytes back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import read

FRAME, KEY_EVERY, CHUNK_FRAMES, TIMESCALE = 64, 16, 64, 25
#: Boxes within boxes that are followed; deeper ones are damage.
DEEPEST = 16
#: Texts of a batch that are held as containers at once, in bytes.
AT_ONCE = 1 << 22
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
PROBE_SCHEMA = "track int, kind string, codec string, width int, height int, timescale long, duration long, samples long, keyframes array<struct<sample: long, begin: long, length: long>>, error string"


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    return payload + bytes(max(FRAME, -(-len(payload) // FRAME) * FRAME) - len(payload))


def encode(payload: bytes) -> bytes:
    """A container of this payload, whose length is a positive multiple of FRAME."""
    n = len(payload) // FRAME
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    ftyp = box(b"ftyp", b"qt  ", struct.pack(">I", 512), b"qt  isom")
    chunks = -(-n // CHUNK_FRAMES)
    rest = n - (chunks - 1) * CHUNK_FRAMES
    stsc = [(1, CHUNK_FRAMES, 1)] * (chunks > 1 or rest == CHUNK_FRAMES) + [(chunks, rest, 1)] * (rest != CHUNK_FRAMES)
    keys = np.arange(1, n + 1, KEY_EVERY, dtype=">u4")
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIIIHHIIIH32sHh", 1, 0, 0, 0, 0, 0, 8, 8, 72 << 16, 72 << 16, 0, 1, bytes(32), 40, -1))

    def moov(first: int) -> bytes:
        offsets = first + np.arange(chunks, dtype=np.int64) * CHUNK_FRAMES * FRAME
        large = int(offsets[-1]) >= 1 << 32
        stbl = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            full_box(b"stsz", struct.pack(">II", FRAME, n)),
            full_box(b"co64" if large else b"stco", struct.pack(">I", chunks), offsets.astype(">u8" if large else ">u4").tobytes()),
        )
        minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, n, 0x55C4, 0)), full_box(b"hdlr", b"mhlr", b"vide", bytes(13)), minf)
        tkhd = full_box(b"tkhd", struct.pack(">IIIIIIIhhhh", 0, 0, 1, 0, n, 0, 0, 0, 0, 0, 0), matrix, struct.pack(">II", 8 << 16, 8 << 16), flags=3)
        mvhd = full_box(b"mvhd", struct.pack(">IIIIIH10s", 0, 0, TIMESCALE, n, 0x10000, 0x100, bytes(10)), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    size = len(moov(0))
    mdat = struct.pack(">I4s", 8 + len(payload), b"mdat") if head == 8 else struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload))
    return b"".join((ftyp, moov(len(ftyp) + size + head), mdat, payload))


def boxes(data: memoryview, begin: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the contents of each box in this range."""
    while begin < end:
        if end - begin < 8:
            raise ValueError("a box is cut short")
        size, kind, head = int.from_bytes(data[begin : begin + 4]), bytes(data[begin + 4 : begin + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[begin + 8 : begin + 16]), 16
        elif size == 0:
            size = end - begin
        if size < head or begin + size > end:
            raise ValueError(f"box {kind!r} does not fit")
        yield kind, begin + head, begin + size
        begin += size


def walk(data: memoryview, begin: int, end: int, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """Every box, containers before what is in them."""
    if len(path) > DEEPEST:
        raise ValueError("boxes are nested too deep")
    for kind, a, b in boxes(data, begin, end):
        yield (*path, kind), a, b
        if kind in CONTAINERS:
            yield from walk(data, a, b, (*path, kind))


class Track:
    """The sample tables of one track."""

    def __init__(self) -> None:
        self.kind = self.codec = ""
        self.width = self.height = self.timescale = self.duration = 0
        self.at: dict[bytes, np.ndarray] = {}
        self.size, self.count, self.most = 0, 0, 0

    def take(self, kind: bytes, data: memoryview, a: int, b: int) -> None:
        def table(dtype: str, skip: int = 8, columns: int = 1) -> np.ndarray:
            n = int.from_bytes(data[a + skip - 4 : a + skip])
            need = n * columns * np.dtype(dtype).itemsize
            if a + skip + need > b:
                raise ValueError(f"table {kind!r} is cut short")
            return np.frombuffer(data[a + skip : a + skip + need], dtype=dtype).astype(np.int64).reshape(n, columns)

        if kind == b"mdhd":
            self.timescale, self.duration = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
        elif kind == b"hdlr":
            self.kind = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            self.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
            if self.kind == "vide":
                self.width, self.height = struct.unpack_from(">HH", data, a + 8 + 8 + 24)
        elif kind == b"stsz":
            self.size, self.count = struct.unpack_from(">II", data, a + 4)
            if not self.size:
                self.at[kind] = table(">u4", 12)[:, 0]
            elif self.size * self.count > len(data):
                raise ValueError("the samples are larger than the file")
        elif kind == b"stz2":
            bits, self.count = data[a + 7], int.from_bytes(data[a + 8 : a + 12])
            if bits not in (4, 8, 16) or a + 12 + -(-self.count * bits // 8) > b:
                raise ValueError(f"table {kind!r} is cut short")
            entries = np.frombuffer(data[a + 12 : a + 12 + -(-self.count * bits // 8)], ">u2" if bits == 16 else "u1").astype(np.int64)
            self.at[b"stsz"] = (entries if bits > 4 else np.stack([entries >> 4, entries & 15], axis=1).reshape(-1))[: self.count]
        elif kind in (b"stco", b"co64"):
            self.at[b"chunks"] = table(">u8" if kind == b"co64" else ">u4")[:, 0]
        elif kind == b"stsc":
            self.at[kind] = table(">u4", columns=3)
        elif kind == b"stts":
            self.at[kind] = table(">u4", columns=2)
        elif kind == b"stss":
            self.at[kind] = table(">u4")[:, 0]

    def samples(self) -> tuple[np.ndarray, np.ndarray]:
        """Offset and length of each sample, from chunk offsets, samples a chunk and sizes."""
        if not self.size and b"stsz" not in self.at:
            raise ValueError("a track has no sample sizes")
        sizes = self.at[b"stsz"] if not self.size else np.full(self.count, self.size, dtype=np.int64)
        chunks, runs = self.at.get(b"chunks", np.zeros(0, np.int64)), self.at.get(b"stsc", np.zeros((0, 3), np.int64))
        last = np.append(runs[1:, 0], len(chunks) + 1) - runs[:, 0]
        if (last < 0).any() or int(last.sum()) != len(chunks):
            raise ValueError("the runs of chunks disagree")
        each = np.repeat(runs[:, 1], last)
        if each.sum() != len(sizes) or len(each) != len(chunks):
            raise ValueError("the sample tables disagree")
        chunk = np.repeat(np.arange(len(chunks)), each)
        before = np.cumsum(sizes) - sizes
        first = np.cumsum(each) - each
        return chunks[chunk] + before - before[first[chunk]] if len(sizes) else sizes, sizes

    def keyframes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offset, size = self.samples()
        k = self.at[b"stss"] - 1 if b"stss" in self.at else np.arange(len(size))
        if len(k) and (k.min() < 0 or k.max() >= len(size)):
            raise ValueError("a key frame is no sample")
        return k + 1, offset[k], size[k]


def tracks(data: memoryview) -> list[Track]:
    out: list[Track] = []
    for path, a, b in walk(data, 0, len(data)):
        if path[-1] == b"moof":
            raise ValueError("fragmented files are not read")
        if path[-1] == b"trak":
            out.append(Track())
        elif out and path[:2] == (b"moov", b"trak"):
            out[-1].take(path[-1], data, a, b)
    return out


def read_payload(data: bytes, track: Track | None = None) -> bytes:
    """The samples of a track, or of the first one, in order."""
    view = memoryview(data)
    offset, size = (track or tracks(view)[0]).samples()
    if not len(size):
        return b""
    cuts = np.flatnonzero(np.append(True, offset[1:] != (offset + size)[:-1]))  # ranges without gaps
    ends = np.append(cuts[1:], len(offset)) - 1
    if int((offset + size).max()) > len(view):
        raise ValueError("a sample lies outside the file")
    return b"".join(view[a:b] for a, b in zip(offset[cuts].tolist(), (offset + size)[ends].tolist(), strict=True))


def slices(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about AT_ONCE bytes of that binary column; a longer row is a piece of its own."""
    ends = np.cumsum(np.diff(np.frombuffer(b.column(column).buffers()[1], np.int64 if pa.types.is_large_binary(b.column(column).type) else np.int32)[b.column(column).offset :][: len(b) + 1].astype(np.int64)))
    at = 0
    while at < len(b):
        n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")) - at)
        yield b.slice(at, n)
        at += n


def to_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with the binary column `media`: the UTF-8 of the text (null: empty), padded to whole frames."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, b.schema.get_field_index(media))):
            i = b.schema.get_field_index(media)
            made = pa.array([encode(padded(x)) for x in b.column(i).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([made if j == i else c for j, c in enumerate(b.columns)], names=b.schema.names)

    with_bytes = docs.drop(media).withColumn(media, F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8"))
    return with_bytes.mapInArrow(build, with_bytes.schema)


def probe_one(data: bytes | None) -> list[dict]:
    if data is None:
        return []
    try:
        out = []
        for n, t in enumerate(tracks(memoryview(data))):
            keys = [{"sample": int(a), "begin": int(b), "length": int(c)} for a, b, c in zip(*t.keyframes(), strict=True)]
            ticks = int((t.at[b"stts"][:, 0] * t.at[b"stts"][:, 1]).sum()) if b"stts" in t.at else t.duration
            out.append({"track": n, "kind": t.kind, "codec": t.codec.strip(), "width": t.width, "height": t.height, "timescale": t.timescale, "duration": ticks, "samples": t.count, "keyframes": keys, "error": None})
        return out
    except (ValueError, struct.error, KeyError, IndexError, OverflowError) as e:
        return [{"track": None, "error": str(e) or type(e).__name__}]


def probe(df: DataFrame, id_column: str, media: str = "media") -> DataFrame:
    """One row a track of each container; a container that cannot be read has one row with its error."""
    schema = f"{id_column} {df.schema[id_column].dataType.simpleString()}, {PROBE_SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(parsed)
        for b in (x for b in batches for x in slices(b, 1)):
            rows = [{id_column: i} | x for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for x in probe_one(data)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    from pyspark.sql.types import StructType

    parsed = StructType.fromDDL(schema)
    return df.select(id_column, media).mapInArrow(run, schema)


def digests(df: DataFrame, media: str = "media") -> DataFrame:
    """doc_id and what is computed from the stored bytes, read back through the sample tables."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for b in batches for x in slices(b, 2)):
            out = []
            for data in (x.as_py() for x in b.column(2)):
                t = tracks(memoryview(data))[0]
                payload = read_payload(data, t)
                key, begin, length = t.keyframes()
                ranges = zlib.crc32(np.stack([key, begin, length]).astype("<i8").tobytes())
                feature = f"{t.kind}/{t.codec.strip()} {t.width}x{t.height} duration={t.duration}/{t.timescale} samples={t.count} keyframes={len(key)} first={begin[0]}+{length[0]} last={begin[-1]}+{length[-1]} ranges={ranges:08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-FRAME:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=names)

    return df.select(F.col("doc_id").cast("long"), F.col("n_bytes").cast("long"), media).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents as a container, read back and described.

    Null and empty texts are one frame of zeros with n_bytes 0; null ids and repeated rows stay; an empty table
    gives no rows; other columns are not read. A row's work and memory follow its own text.
    """
    docs = read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("n_bytes"), "text")
    return digests(to_media(docs).drop("text"))
