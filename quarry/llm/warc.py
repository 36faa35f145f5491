"""WARC archives with segments and chunked transfer coding (operator 3).

`write_archive` stores pages as response and revisit records; a record whose block is longer than a segment goes on
in continuation records. `read_archive` parses archives, groups segments by the identifier of their origin, orders
them by number, verifies the total length, decodes chunked transfer coding and checks the payload digest. Records
in one piece are decoded where they are read; only segments are shuffled, and a group is one record's segments.
A revisit's length and digest are those of the response that was read back. Damaged records give a row with an
error, and reading goes on at the next record; records that other programs wrote have no page_id.

Files are written by Spark's text writer, whose line separator is the two line ends that close a WARC record, so
tasks commit and are repeated as for any table, in any file system that Spark can write.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import drop_made, drop_path, kept, made, new_path, read, shared_dir

SEGMENT, CHUNK, RECORDS_PER_FILE = 8192, 4096, 2000
END = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, error string, payload binary"
_PARTS = RECORDS + ", origin string, number int, total long, content binary"
_IDENT = re.compile(r"<urn:page:(-?\d*)(:[^<>]*)?>")
_START = re.compile(rb"\r\n\r\n(?=WARC/1\.)")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        piece = payload[i : i + size]
        parts += [b"%x" % len(piece), END, piece, END]
    return b"".join([*parts, b"0", END, END])


def dechunked(body: bytes) -> bytes:
    """The content of a chunked body; extensions of chunks and trailers are passed over."""
    out, at = [], 0
    while True:
        line = body.index(END, at)
        size = int(body[at:line].split(b";")[0].strip(), 16)
        at = line + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != END:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + lines.encode() + END + block


def _line(text: str) -> str:
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in text)


def records(page_id: int | None, row: int, url: str | None, payload: bytes, refers_to: int | None, date: str, segment: int = SEGMENT, alone: bool = False) -> list[bytes]:
    """The record of a page, in as many segments as it needs, each without the closing line ends.

    alone: the response that revisits of its payload refer to is one record; it is named by its id and payload then,
    so that they can name it. Otherwise they say its page alone.
    """
    digest = digest32(payload)
    ident = f"<urn:page:{'' if page_id is None else page_id}:{digest if alone and refers_to is None else row}>"
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", ident), ("WARC-Date", date)]
    headers += [("WARC-Target-URI", _line(url))] if url is not None else []
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        named = [("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}>")] * alone
        return [_record([*headers, *named, ("X-Refers-To-Page", str(refers_to)), ("WARC-Profile", PROFILE)], HTTP)]
    block = HTTP + chunked(payload)
    if len(block) <= segment:
        return [_record(headers, block)]
    cuts = range(0, len(block), segment)
    out = [_record([*headers, ("WARC-Segment-Number", "1")], block[:segment])]
    for n, i in enumerate(cuts[1:], 2):
        more = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"{ident[:-1]}:{n}>"), ("WARC-Date", date), ("WARC-Segment-Origin-ID", ident), ("WARC-Segment-Number", str(n))]
        out.append(_record(more + [("WARC-Segment-Total-Length", str(len(block)))] * (i + segment >= len(block)), block[i : i + segment]))
    return out


def _record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(headers with lower-case names, block, where the next record begins)."""
    if not data.startswith(b"WARC/1.", at):
        raise ValueError(f"no record at {at}")
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8").split("\r\n")[1:]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if "content-length" not in headers or "warc-type" not in headers or "warc-record-id" not in headers:
        raise ValueError(f"the record at {at} lacks a header")
    size = int(headers["content-length"])
    block = data[end + 4 : end + 4 + size]
    if size < 0 or len(block) != size or data[end + 4 + size : end + 8 + size] != b"\r\n\r\n":
        raise ValueError(f"the record at {at} is cut short")
    return headers, block, end + 8 + size


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers with lower-case names, block) of each record of an archive."""
    at = 0
    while at < len(data):
        headers, block, at = _record_at(data, at)
        yield headers, block


def parse_on(data: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """(headers, block, error): as parse, but what cannot be read is an error, after which the next record follows."""
    at = 0
    while at < len(data):
        try:
            headers, block, at = _record_at(data, at)
        except ValueError as e:
            found = _START.search(data, at)
            at = found.end() if found else len(data)
            headers, block, error = {}, b"", str(e)
        else:
            error = None
        yield headers, block, error


def _page(ident: str) -> int | None:
    """The page of one of our record ids, if it has one."""
    found = _IDENT.fullmatch(ident)
    return int(found[1]) if found and found[1] not in ("", "-") else None


def decode(headers: dict[str, str], block: bytes, with_payload: bool) -> dict:
    """What a whole record says; its digest and length are those of the decoded payload."""
    out = {"page_id": _page(headers["warc-record-id"]), "record_type": headers["warc-type"], "url": headers.get("warc-target-uri")}
    named = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    if out["record_type"] == "revisit":  # its length follows from the response
        page = headers.get("x-refers-to-page", "")
        return out | {"payload_digest": named or None, "refers_to": int(page) if re.fullmatch(r"-?\d{1,18}", page) else _page(headers.get("warc-refers-to", ""))}
    try:
        head, _, body = block.partition(b"\r\n\r\n")
        payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    except ValueError as e:
        return out | {"error": str(e)}
    digest = digest32(payload)
    return out | {"payload_bytes": len(payload), "payload_digest": digest, "payload": payload if with_payload else None, "error": None if digest == (named or digest) else "the payload digest differs"}


def write_archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", segment: int = SEGMENT) -> None:
    """Of the pages with equal payloads of at least min_bytes, the one with the largest page_id is the response.

    Null payloads are empty. Pages without an id are revisits of a page that has one, or else all responses; rows
    that repeat a response's id and payload are responses too. Pages meet their group's largest id by a join that
    Spark splits where a payload has very many copies; the groups are summed before the shuffle.
    """
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col("page_id").cast("long").alias("page_id"), "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"))
    digest = F.sha1("payload")
    groups = pages.select(F.col("page_id").cast("long").alias("page_id"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).filter(F.length("payload") >= min_bytes).select(digest.alias("digest"), "page_id")
    groups = groups.groupBy("digest", "page_id").agg(F.count("*").alias("m")).groupBy("digest").agg(F.sum("m").alias("n"), F.max(F.struct("page_id", "m")).alias("lead"))
    groups = groups.filter("n > 1 and lead.page_id is not null").select("digest", F.col("lead.page_id").alias("first"), (F.col("lead.m") == 1).alias("alone"))
    groups = kept(groups, "groups")  # its size is known then: pages are shuffled only where it is large
    role = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.withColumn("digest", digest).join(groups, "digest", "left").select("page_id", "row", "url", "payload", role.alias("refers_to"), F.coalesce("alone", F.lit(False)).alias("alone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 500):
                out = [r for *x, alone in zip(*(c.to_pylist() for c in b.slice(a, 500).columns), strict=True) for r in records(*x, date, segment, alone)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    written = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string"))
    written.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def read_archive(spark: SparkSession, path: str, with_payload: bool = False, drop: bool = False) -> DataFrame:
    """One row a record: what RECORDS names; error says why a record could not be put together or differs.

    The archives are parsed when this is called; the rows do not need them afterwards. drop: they go once they are parsed.
    """
    names = [x.split()[0] for x in _PARTS.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _PARTS.split(", ")])
    arrow_out = pa.schema([f for f in arrow][: len(RECORDS.split(", "))])

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                out = []
                for headers, block, error in parse_on(data.as_py()):
                    number = headers.get("warc-segment-number", "")
                    if error:
                        out.append({"error": error})
                    elif headers["warc-type"] not in ("response", "revisit", "continuation"):
                        continue
                    elif not number:
                        out.append(decode(headers, block, with_payload))
                    elif not re.fullmatch(r"\d{1,9}", number):
                        out.append({"error": "the segment's number is none"})
                    else:
                        number = int(number)
                        row = {"origin": headers.get("warc-segment-origin-id", headers["warc-record-id"]), "number": number, "content": block, "record_type": headers["warc-type"]}
                        row |= {"total": int(x)} if re.fullmatch(r"\d{1,18}", x := headers.get("warc-segment-total-length", "")) else {}
                        if number == 1:
                            row |= {"payload_digest": headers.get("warc-payload-digest"), "url": headers.get("warc-target-uri")}
                        out.append(row)
                    if len(out) == 1000:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(take, _PARTS)
    before = made()
    found = kept(found, "records")
    if drop:
        drop_path(spark, path)
    whole = found.filter("origin is null").select(*names[: len(arrow_out)])
    parts = found.filter("origin is not null")
    parts = parts.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "total", "content", "payload_digest", "url", "record_type"))).alias("parts"))

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for origin, segments in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seg = segments.as_py()
                block = b"".join(s["content"] for s in seg)
                row = {"page_id": _page(origin), "record_type": seg[0]["record_type"], "url": seg[0]["url"]}
                if [s["number"] for s in seg] != list(range(1, len(seg) + 1)):
                    row["error"] = "segments are missing or repeated"
                elif seg[-1]["total"] != len(block):
                    row["error"] = "the total length differs"
                else:
                    row = decode({"warc-record-id": origin, "warc-type": seg[0]["record_type"], "warc-payload-digest": seg[0]["payload_digest"] or ""} | ({"warc-target-uri": seg[0]["url"]} if seg[0]["url"] else {}), block, with_payload)
                yield pa.RecordBatch.from_pylist([row], schema=arrow_out)

    read = kept(whole.unionByName(parts.mapInArrow(join_up, RECORDS)), "payloads")
    drop_made(spark, before)  # the segments
    responses = read.filter("record_type = 'response' and error is null").groupBy("payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    revisits = read.filter("record_type = 'revisit'").join(responses, "payload_digest", "left")
    missing = F.when(F.col("_bytes").isNull(), F.lit("the response of this payload is not there"))
    revisits = revisits.withColumns({"payload_bytes": F.col("_bytes"), "error": F.coalesce("error", missing)})
    return read.filter("record_type is distinct from 'revisit'").unionByName(revisits.select(read.columns))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of pages, written to archives and read back.

    Null payloads are empty; pages without an id have their record too; an empty table gives no rows; columns other
    than page_id, url and html are not read.
    """
    shared_dir(spark)
    path = new_path(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), path)
    return read_archive(spark, path, drop=True).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")
