"""WARC archives with revisit resolution (operator 6).

Headers (id, url, digest, size) are shuffled by payload digest to find, for
equal payloads, the record that keeps the payload. Revisits are written from
their headers alone. Responses are the pages without them: where the revisits'
keys are few enough (their size is checked) they travel to the pages and no payload moves;
beyond that pages are shuffled by digest once.

A record is a gzip member of its own. Archives are written by Spark's own text
writer, so they can lie in any store Spark can write to: a member's last byte
is the uppermost of its length and 0 up to 16 MB, so members less that byte are the
"lines" and a zero byte the line separator; a longer one is followed by an empty
member, whose last byte is 0. They are read back by Content-Length, never by
looking for a separator.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecmill.llm.common import in_batches, materialize

CRLF = "\r\n"
HTTP = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of a SHA-1: four times 40 bits as eight digits of base 32."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def headers(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """(id, url, payload, payload_bytes, payload_digest) of every page; what is not asked for is not computed."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), payload.alias("payload"))
    return rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1("payload").alias("payload_digest"))


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0,
    sent_bytes: int = 32 << 20) -> DataFrame:
    """One record per row: (id, url, payload, payload_bytes, payload_digest, record_type, refers_to, refers_url).

    Of records with equal payloads of at least ``min_bytes`` the one with the
    largest id (null smallest) is the response, the others revisit it and carry
    no payload; rows that repeat that id and payload are responses too. A null
    payload is an empty one, a null url an empty string. An empty table gives
    no records; other columns are ignored, whatever their names.

    Keys of revisits are sent to all tasks if they take at most ``sent_bytes``.
    """
    key = ["payload_digest", "payload_bytes"]
    heads = materialize(headers(pages, id_col, url_col, html_col).drop("payload"), "headers")
    tops = (
        heads.where(F.col("payload_bytes") >= min_bytes)
        .groupBy(*key)
        .agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "url")).alias("top"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*key, F.col("top.id").alias("refers_to"), F.col("top.url").alias("refers_url"))
    )
    revisits = materialize(heads.join(tops, key).where(~F.col("id").eqNullSafe(F.col("refers_to"))), "revisits")
    size = revisits.agg(F.sum(F.length(F.coalesce(F.col("id").cast("string"), F.lit(""))) + 64)).first()[0] or 0
    gone = revisits.select(*key, F.col("id").alias("gone"))
    gone = F.broadcast(gone) if size <= sent_bytes else gone.hint("merge")
    rows = headers(pages, id_col, url_col, html_col).alias("r")
    same = [F.col(f"r.{k}") == gone[k] for k in key] + [F.col("r.id").eqNullSafe(gone["gone"])]
    kinds = dict(revisits.dtypes)
    responses = rows.join(gone, same, "left_anti").select(
        "id", "url", "payload", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
            F.lit(None).cast(kinds["refers_to"]).alias("refers_to"), F.lit(None).cast("string").alias("refers_url")
    )
    again = revisits.select("id", "url", F.lit(None).cast("string").alias("payload"), "payload_bytes", "payload_digest",
        F.lit("revisit").alias("record_type"), "refers_to", "refers_url")
    return responses.unionAll(again)


def record_text(date: str = "1970-01-01T00:00:00Z") -> Column:
    """The record as it stands in the archive, with fresh headers, without the blank lines after it."""
    def ident(id_: Column, url: Column) -> Column:
        """Pages that share an id have ids of their own by url and payload."""
        own = F.lower(F.hex(F.xxhash64(url, F.col("payload_digest"))))
        return F.concat(F.lit("<urn:vecmill:record:"), F.coalesce(id_.cast("string"), F.lit("null")), F.lit("/"), own, F.lit(">"))

    def target(url: Column) -> Column:
        # a header ends with its line: what would end it early is percent-encoded
        return F.regexp_replace(F.regexp_replace(url, "\r", "%0D"), "\n", "%0A")

    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(f"{HTTP}Content-Length: "), F.col("payload_bytes"), F.lit(CRLF * 2))
    block = F.concat(http, F.coalesce("payload", F.lit("")))
    referred = F.concat(F.lit(f"WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "), ident(F.col("refers_to"), F.col("refers_url")),
        F.lit(f"{CRLF}WARC-Refers-To-Target-URI: "), target(F.col("refers_url")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), ident(F.col("id"), F.col("url"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), target(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("payload_digest")),
        F.concat(F.lit("WARC-Payload-Length: "), F.col("payload_bytes")),
        F.when(revisit, referred),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block)),
    ]
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block)


def members(recs: DataFrame) -> DataFrame:
    """(value): each record as a gzip member, less its last byte, which is 0; see above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = gzip.compress(b"", mtime=0)
        for b in batches:
            out, size = [], 0
            for text in b.column("value"):
                member = gzip.compress(text.as_buffer().to_pybytes() + b"\r\n\r\n", 6, mtime=0)
                out.append((member if member[-1] == 0 else member + end)[:-1])
                size += len(member)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    return in_batches(recs.select(record_text().alias("value")), run, "value binary")


#: Records by the most bytes of their payload, and how many go to an archive, so that none exceeds some 128 MB but by a single record.
CLASSES = ((1 << 16, 2000), (1 << 22, 30), (None, 1))


def write_archives(recs: DataFrame, path: str, records_per_file: int = 2000) -> None:
    """Archives below ``path``, files of gzip members whatever their names, of at most ``records_per_file`` records and fewer where payloads are long."""
    size = F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    longest, least = recs.select(size.alias("n")).agg(F.max("n"), F.min("n")).first()
    begin = 0
    for n, (most, each) in enumerate(CLASSES):
        here = (size >= begin) & (size <= most) if most else size >= begin
        if n == 0 or longest is not None and longest >= begin and (most is None or least <= most):
            part = recs if n == 0 and (longest or 0) <= most else recs.where(here)
            part = members(part).select(F.col("value").cast("string").alias("value"))
            part.write.option("lineSep", "\0").option("maxRecordsPerFile", min(each, records_per_file)).text(f"{path}/{n}")
        begin = (most or 0) + 1


def parse_archive(data: Iterator[bytes]) -> Iterator[dict]:
    """Records of one archive from its bytes, read by Content-Length."""
    buf, at = bytearray(), 0

    def need(n: int) -> bool:
        nonlocal at
        while len(buf) - at < n:
            chunk = next(data, None)
            if chunk is None:
                return False
            del buf[:at]
            at = 0
            buf.extend(chunk)
        return True

    while need(1):
        while (end := buf.find(b"\r\n\r\n", at)) < 0:
            if not need(len(buf) - at + 1):
                raise ValueError("an archive ends within a header")
        version, *lines = bytes(buf[at:end]).decode("utf-8").split(CRLF)
        if not version.startswith("WARC/"):
            raise ValueError(f"not a record: {version[:40]!r}")
        head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        at = end + 4
        length = int(head["content-length"])
        if not need(length + 4) or buf[at + length : at + length + 4] != b"\r\n\r\n":
            raise ValueError("an archive ends within a record")
        block = bytes(buf[at : at + length])
        at += length + 4
        unwrap = lambda k: None if (v := head.get(k, "<urn:vecmill:record:null/>")[20:-1].rpartition("/")[0]) == "null" else v
        yield {
            "id": unwrap("warc-record-id"), "payload_bytes": int(head["warc-payload-length"]),
                "payload_digest": head["warc-payload-digest"].removeprefix("sha1:"),
            "record_type": head["warc-type"], "refers_to": unwrap("warc-refers-to"), "url": head["warc-target-uri"],
            "payload": block.split(b"\r\n\r\n", 1)[1] if head["warc-type"] == "response" else None,
        }


def _unzipped(data: bytes, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of all members, a part at a time."""
    view, at, z = memoryview(data), 0, zlib.decompressobj(31)
    while at < len(view):
        part = view[at : at + step]
        if out := z.decompress(part):
            yield out
        at += len(part) - len(z.unused_data)
        if z.eof:
            z = zlib.decompressobj(31)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of all archives below ``path``. Each response's payload is held against its digest and length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import base64
        import hashlib

        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
        for b in batches:
            for content in b.column("content"):
                rows, size = [], 0
                for r in parse_archive(_unzipped(content.as_py())):
                    if r["payload"] is not None:
                        digest = base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
                        if (digest, len(r["payload"])) != (r["payload_digest"], r["payload_bytes"]):
                            raise ValueError(f"record {r['id']}: the payload does not match its headers")
                        size += len(r["payload"])
                        if not with_payload:
                            r["payload"] = None
                    rows.append(r)
                    if len(rows) >= 2000 or size > 1 << 23:
                        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n,
                            k in zip(names, kinds, strict=True)], names)
                        rows, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup",
        "true").load(path).select("content")
    return in_batches(files, run, RECORD)


def restore_payloads(recs: DataFrame) -> DataFrame:
    """Revisits with the payload of the response they refer to, joined by digest and length."""
    originals = recs.where("record_type = 'response'").select("payload_digest", "payload_bytes", F.col("payload").alias("original"),
        F.col("id").alias("refers_to"))
    revisits = recs.where("record_type = 'revisit'").drop("payload")
    back = revisits.join(originals, ["payload_digest", "payload_bytes", "refers_to"], "left").withColumnRenamed("original", "payload")
    return recs.where("record_type = 'response'").unionByName(back)
