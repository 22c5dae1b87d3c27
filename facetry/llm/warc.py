"""WARC archives, index first.

Writing gives each record its place: tasks append records to archives in the shared folder and return an index row
(archive, offset, length, page_id, url, digest) per record. The index is a Parquet table and the only way in: reading takes
any selection of index rows, sorts them by (archive, offset), joins ranges that lie close together into one read each, and
parses the records out of it. An archive that a lost or repeated task left behind is in no index row and is never read.

The folder is reached through pyarrow's file systems (file, s3, gs, hdfs).
"""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batch_of, cut, map_arrow, parts, read, steps, table_path

#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: Bytes after which a task begins a new archive.
ARCHIVE_BYTES = 64 << 20
#: Bytes that a read may skip to reach the next record, and bytes of one read at most.
GAP, SPAN = 64 << 10, 4 << 20
DATE = "2020-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id {kind}, url string, payload_digest string, record_type string"


def _files(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))


def digests(pages: DataFrame) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    The smallest page_id of equal payloads of LEAST bytes or more is the response; rows that share it are all responses, and
    a null page_id is larger than others. A payload that fills a third of the table splits over tasks: both sides of the
    join are plain exchanges, and the small one holds only payloads that occur more than once.
    """
    body = F.coalesce("html", F.lit(""))
    own = [c for c in pages.columns if c not in ("payload_bytes", "payload_digest", "record_type", "refers_to")]
    full = pages.select(*own, F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    many = full.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("·first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = full.join(cut(many, "responses"), "payload_digest", "left")
    again = F.col("·first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("·first")) & (F.col("payload_bytes") >= LEAST)
    return joined.select(*own, "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("·first")).alias("refers_to"))


def record(page_id, url: str | None, html: str | None, kind: str, digest: str, refers_to) -> bytes:
    """One record; a revisit has the digest and size of the payload it stands for, and no payload."""
    body = b"" if kind == "revisit" else (html or "").encode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>", f"WARC-Date: {DATE}"]
    head.append(f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~-._')}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len((html or '').encode())}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record; its declared length must agree with what is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record at this offset")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    body, end = rest[: int(headers["Content-Length"])], rest[int(headers["Content-Length"]) :]
    if end != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    return headers, body


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """The index of the archives that hold the pages (as digests() gives them); itself a table in the folder."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        fs, root = _files(folder)
        out = name = None
        at = 0
        for b in steps(batches, "html"):
            rows = {k: b.column(k).to_pylist() for k in ("page_id", "url", "html", "record_type", "payload_digest", "refers_to")}
            archives, offsets, lengths = [], [], []
            for values in zip(*rows.values(), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc", 0
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(f"{root}/{name}")
                raw = record(*values)
                out.write(raw)
                archives.append(name)
                offsets.append(at)
                lengths.append(len(raw))
                at += len(raw)
            yield batch_of(archive=pa.array(archives), offset=pa.array(offsets, pa.int64()), length=pa.array(lengths, pa.int64()), page_id=b.column("page_id"), url=b.column("url"), payload_digest=b.column("payload_digest"), record_type=b.column("record_type"))
        if out is not None:
            out.close()

    taken = pages.select("page_id", F.col("url").cast("string").alias("url"), "html", "record_type", "payload_digest", F.col("refers_to").cast("string").alias("refers_to"))
    index = map_arrow(taken, run, INDEX.format(kind=kind))
    path = f"{folder}/index"
    index.write.parquet(path)
    return pages.sparkSession.read.schema(index.schema).parquet(path)


def ranges(offset: np.ndarray, length: np.ndarray, gap: int = GAP, span: int = SPAN) -> list[tuple[int, int]]:
    """Index intervals of sorted records that one read takes: near each other, and no more than span bytes unless it is one record."""
    out, first = [], 0
    for i in range(1, len(offset) + 1):
        if i == len(offset) or offset[i] - (offset[i - 1] + length[i - 1]) > gap or offset[i] + length[i] - offset[first] > span:
            out.append((first, i))
            first = i
    return out


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """page_id, url, html (null for revisits), payload_bytes, payload_digest, record_type, refers_to (text), checked (digest agrees).

    index: any selection of index rows. They are dealt by ranges of (archive, offset), so tasks get even shares of neighbours.
    """
    kind = index.schema["page_id"].dataType.simpleString()
    spark = index.sparkSession
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    dealt = index.repartitionByRange(parts(spark, size, ARCHIVE_BYTES), "archive", "offset").sortWithinPartitions("archive", "offset")

    def run(batches):
        fs, root = _files(folder)
        open_name, file = None, None
        for b in batches:
            names, offset, length = b.column("archive").to_pylist(), b.column("offset").to_numpy(), b.column("length").to_numpy()
            edges = [0, *[i for i in range(1, len(names)) if names[i] != names[i - 1]], len(names)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                if open_name != names[lo]:
                    if file is not None:
                        file.close()
                    open_name, file = names[lo], fs.open_input_file(f"{root}/{names[lo]}")
                for i, j in ranges(offset[lo:hi], length[lo:hi]):
                    i, j = i + lo, j + lo
                    start = int(offset[i])
                    raw = file.read_at(int(offset[j - 1] + length[j - 1]) - start, start)
                    cols: dict[str, list] = {k: [] for k in ("html", "payload_bytes", "payload_digest", "record_type", "refers_to", "checked")}
                    for o, n in zip(offset[i:j], length[i:j], strict=True):
                        head, body = parse(raw[int(o) - start : int(o + n) - start])
                        revisit = head["WARC-Type"] == "revisit"
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        cols["html"].append(None if revisit else body.decode())
                        cols["payload_bytes"].append(int(head["X-Payload-Length"]) if revisit else len(body))
                        cols["payload_digest"].append(digest if revisit else hashlib.sha256(body).hexdigest())
                        cols["record_type"].append(head["WARC-Type"])
                        cols["refers_to"].append(head.get("X-Refers-To-Page-ID") or None)
                        cols["checked"].append(revisit or hashlib.sha256(body).hexdigest() == digest)
                    part = b.slice(i, j - i)
                    yield batch_of(page_id=part.column("page_id"), url=part.column("url"), html=pa.array(cols["html"], pa.string()), payload_bytes=pa.array(cols["payload_bytes"], pa.int64()), payload_digest=pa.array(cols["payload_digest"], pa.string()), record_type=pa.array(cols["record_type"], pa.string()), refers_to=pa.array(cols["refers_to"], pa.string()), checked=pa.array(cols["checked"], pa.bool_()))
        if file is not None:
            file.close()

    return map_arrow(dealt.select("archive", "offset", "length", "page_id", "url"), run, f"page_id {kind}, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to string, checked boolean")


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads all records back.

    A null html is an empty payload, a null url an empty one; very long payloads are a record each, read by one read; repeated
    rows and ties of the smallest page_id make a record each; other columns are not written, so names cannot clash; an empty
    table gives no rows.
    """
    folder = table_path(pages.sparkSession, "warc")
    index = write_archives(digests(pages.select("page_id", "url", "html")), folder)
    kind = pages.schema["page_id"].dataType
    return read_records(index, folder).withColumn("refers_to", F.col("refers_to").cast(kind))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)
"""
