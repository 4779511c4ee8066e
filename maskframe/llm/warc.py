"""WARC archives by conversion of legacy ARC archives.

ARC files of version 1 and 2 are parsed by their header lines and declared lengths; for each record equivalent WARC identifiers,
timestamps, types and digests are synthesised. Records with equal payloads become revisit records of the first one. Archives are
stored as segments of gzip members in a table in the shared folder (name, segment, data), which Spark commits as a whole: a lost
executor leaves no half archive, and no executor needs another one's files.

Defined results: a null payload is an empty one; a null or blank URL becomes a urn of the row; spaces in a URL are escaped as ARC
headers can't hold them; a row with a null key is archived like any other, after all others when the first of a group of equal
payloads is chosen; of rows with equal key and payload one is the response; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.llm.common import lean, materialize, placed, slices

#: The header fields of the two ARC versions, as their version blocks list them.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SEGMENT_BYTES = 8 << 20
ARC_DATE = "20240101000000"


@dataclass
class ArcRecord:
    fields: dict[str, str]
    content: bytes
    version: int


def arc_file_header(version: int, name: str, date: str = ARC_DATE, origin: str = "maskframe") -> bytes:
    """The version block that opens an ARC file; its last line names the fields of all later header lines."""
    block = f"{version} 0 {origin}\n{' '.join(ARC_FIELDS[version])}\n\n".encode()
    extra = "200 - - 0 " + name + " " if version == 2 else ""
    return f"filedesc://{name} 0.0.0.0 {date} text/plain {extra}{len(block)}\n".encode() + block


def arc_record(version: int, url: str, content: bytes, date: str = ARC_DATE, ip: str = "0.0.0.0", kind: str = "text/html", name: str = "-", offset: int = 0) -> bytes:
    values = {"URL": url, "IP-address": ip, "Archive-date": date, "Content-type": kind, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(content))}
    return " ".join(values[f] for f in ARC_FIELDS[version]).encode("utf-8", "replace") + b"\n" + content + b"\n"


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of an ARC file, without the version block. Lengths are as declared; what is cut off at the end isn't returned."""
    names, version, at = ARC_FIELDS[1], 1, 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        eol = data.find(b"\n", at)
        if eol < 0:
            return
        values = data[at:eol].decode("utf-8", "replace").rstrip("\r").split(" ")
        try:
            size = int(values[-1])
        except ValueError:  # not a header line: go on at the next line
            at = eol + 1
            continue
        if eol + 1 + size > len(data):
            return
        content = data[eol + 1 : eol + 1 + size]
        at = eol + 1 + size
        if values[0].startswith("filedesc://"):
            lines = content.decode("utf-8", "replace").split("\n")
            version = 2 if lines[0].startswith("2") else 1
            names = lines[1].split(" ") if len(lines) > 1 and lines[1].startswith("URL ") else ARC_FIELDS[version]
            continue
        if len(values) > len(names):  # spaces in a URL
            spare = len(values) - len(names)
            values = ["%20".join(values[: spare + 1]), *values[spare + 1 :]]
        yield ArcRecord(dict(zip(names, values, strict=False)), content, version)


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(HTTP head with its blank line, payload); without an HTTP head all is payload."""
    if not content.startswith(b"HTTP/"):
        return b"", content
    end = content.find(b"\r\n\r\n")
    return (content[: end + 4], content[end + 4 :]) if end >= 0 else (b"", content)


def warc_date(arc_date: str) -> str:
    """ARC's YYYYMMDDhhmmss, possibly cut short, as ISO 8601; an unreadable one becomes the epoch."""
    digits = re.sub(r"\D", "", arc_date)
    digits = digits[:14] + "19700101000000"[min(len(digits), 14) :]
    try:
        return datetime.strptime(digits, "%Y%m%d%H%M%S").replace(tzinfo=UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return "1970-01-01T00:00:00Z"


def record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'maskframe:' + row)}>"


@dataclass
class WarcRecord:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    def encode(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in self.headers.items())
        return f"WARC/1.1\r\n{head}Content-Length: {len(self.block)}\r\n\r\n".encode("utf-8", "replace") + self.block + b"\r\n\r\n"


def to_warc(arc: ArcRecord, row: str, refers_to: str | None = None) -> WarcRecord:
    """The WARC record equivalent to an ARC record; refers_to: the row of the response that this one revisits."""
    head, payload = split_http(arc.content)
    digest = hashlib.sha256(payload).hexdigest()
    headers = {
        "WARC-Type": "revisit" if refers_to is not None else "response" if head else "resource",
        "WARC-Record-ID": record_id(row),
        "WARC-Date": warc_date(arc.fields.get("Archive-date", "")),
        "WARC-Target-URI": arc.fields.get("URL", ""),
        "WARC-IP-Address": arc.fields.get("IP-address", "0.0.0.0"),
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response" if head else arc.fields.get("Content-type", "application/octet-stream"),
        "X-Row": row,
        "X-Payload-Length": str(len(payload)),
    }
    if refers_to is None:
        return WarcRecord(headers, head + payload)
    headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Row": refers_to}
    return WarcRecord(headers, head)


def parse_warc(data: bytes) -> Iterator[WarcRecord]:
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = dict(x.split(": ", 1) for x in lines if ": " in x)
        size = int(headers.pop("Content-Length"))
        yield WarcRecord(headers, data[end + 4 : end + 4 + size])
        at = end + 4 + size + 4


def members(data: bytes) -> Iterator[bytes]:
    """The contents of concatenated gzip members."""
    while data:
        d = zlib.decompressobj(31)
        yield d.decompress(data) + d.flush()
        data = d.unused_data


def gzipped(data: bytes, level: int = 1) -> bytes:
    c = zlib.compressobj(level, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def http_response(payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload


def arc_url(url, row: str) -> str:
    url = re.sub(r"\s", "%20", url.strip()) if isinstance(url, str) else ""
    return url or f"urn:x-row:{row}"


def first_rows(rows: DataFrame, least: int) -> DataFrame:
    """uid and refers_to, refers_uid of the rows whose payload (digest, size) another row holds first."""
    rank = F.struct(F.col("key").isNull(), F.col("key"), F.col("uid"))
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min(rank).alias("f"), F.count("*").alias("n")).where("n > 1")
    # Written first, so that Spark can split the rows of a frequent payload in the join.
    firsts = materialize(firsts.select("digest", F.col("f.key").alias("refers_to"), F.col("f.uid").alias("refers_uid")), "firsts")
    return rows.where(F.col("size") >= least).select("uid", "digest").join(firsts, "digest").where(F.col("uid") != F.col("refers_uid")).select("uid", "refers_to", "refers_uid")


def write_archives(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 100, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Writes pages as ARC records, converts them to WARC, and stores the archives: name, segment, data (gzip members).

    Rows are told apart by their place in the table's files, so null and repeated keys are safe."""
    told, file, row = placed(pages)
    rows = told.select(F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("html"), F.concat_ws("-", F.col(file), F.col(row)).alias("uid"))
    narrow = rows.select("uid", "key", F.sha2(F.col("html").cast("binary"), 256).alias("digest"), F.octet_length("html").alias("size"))
    revisits = materialize(first_rows(narrow, least), "revisits")
    joined = rows.join(revisits, "uid", "left").select("uid", F.col("key").cast("string").alias("key"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"), F.col("refers_uid").cast("string").alias("refers_uid"))

    def run(frames):
        name, segment, have, size = uuid.uuid4().hex, 0, [], 0
        for b in slices(frames, "html"):
            for uid, key, url, html, to, to_uid in zip(*(b[c].to_pylist() for c in ("uid", "key", "url", "html", "refers_to", "refers_uid")), strict=True):
                row = f"{uid}:{'' if key is None else key}"
                version = 1 + segment % 2
                legacy = arc_file_header(version, name) + arc_record(version, arc_url(url, row), http_response(html.encode("utf-8", "replace")), name=name)
                refers = f"{to_uid}:{'' if to is None else to}" if to_uid is not None else None
                for arc in parse_arc(legacy):
                    data = gzipped(to_warc(arc, row, refers).encode())
                have.append(data)
                size += len(data)
                if size >= segment_bytes:
                    yield _segment([(name, segment, b"".join(have))])
                    segment, have, size = segment + 1, [], 0
        if have:
            yield _segment([(name, segment, b"".join(have))])

    return materialize(joined.mapInArrow(lean(run), "name string, segment int, data binary"), "warc")


def _segment(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary()), strict=True)], names=["name", "segment", "data"])


def read_archives(archives: DataFrame, key_col: str = "page_id") -> DataFrame:
    """key_col, payload_bytes, payload_digest, record_type, refers_to (and url, warc_date) of each record.

    A response's length and digest are taken anew from its payload; a digest that differs from the declared one raises."""

    def number(row: str):
        return int(row.split(":")[1]) if row.split(":")[1] else None

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [key_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri", "warc_date"]

    def run(frames):
        for b in frames:
            for data in b["data"]:
                rows = []
                for member in members(data.as_py()):
                    for r in parse_warc(member):
                        h = r.headers
                        declared, size = h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Length"])
                        if h["WARC-Type"] != "revisit":
                            payload = split_http(r.block)[1]
                            if hashlib.sha256(payload).hexdigest() != declared or len(payload) != size:
                                raise ValueError(f"damaged record {h['WARC-Record-ID']}")
                        to = h.get("X-Refers-To-Row")
                        rows.append((number(h["X-Row"]), size, declared, h["WARC-Type"], None if to is None else number(to), h["WARC-Target-URI"], h["WARC-Date"]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return archives.mapInArrow(lean(run), f"{key_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, warc_date string")


def convert_files(spark: SparkSession, path: str, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Archives (name, segment, data) with the records of the ARC files at path, plain or as gzip members. Each file is read by one task, whole; a
    record's row is its file and number."""

    def run(frames):
        for b in frames:
            for at, content in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                name, segment, have, size = hashlib.sha256(at.encode()).hexdigest()[:32], 0, [], 0
                data = b"".join(members(content)) if content.startswith(b"\x1f\x8b") else content
                for number, arc in enumerate(parse_arc(data)):
                    have.append(gzipped(to_warc(arc, f"{name}-{number}:").encode()))
                    size += len(have[-1])
                    if size >= segment_bytes:
                        yield _segment([(name, segment, b"".join(have))])
                        segment, have, size = segment + 1, [], 0
                if have:
                    yield _segment([(name, segment, b"".join(have))])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return materialize(files.mapInArrow(lean(run), "name string, segment int, data binary"), "warc")


def export(archives: DataFrame, folder: str) -> DataFrame:
    """Writes each segment as <name>-<segment>.warc.gz to a folder that all executors share, whole or not at all; returns their paths. A task that
    runs again writes the same files again."""

    def run(frames):
        os.makedirs(folder, exist_ok=True)
        for b in frames:
            paths = []
            for name, segment, data in zip(*(b[c].to_pylist() for c in ("name", "segment", "data")), strict=True):
                paths.append(f"{folder}/{name}-{segment:05}.warc.gz")
                part = f"{paths[-1]}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(data)
                os.replace(part, paths[-1])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return archives.mapInArrow(run, "path string")


ORACLE_SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, url, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to,
       url AS target_uri, '2024-01-01T00:00:00Z' AS warc_date
FROM f
"""
