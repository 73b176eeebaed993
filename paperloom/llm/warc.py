"""WARC archives (operator 1): writing captures, reading records, assembling transactions.

Each page gives three records that share concurrent-to identifiers: its response (or a revisit of
an equal payload), the request and a metadata record. Records are written through Spark's own
writer, whose commit protocol survives lost executors; "CR LF CR LF" after a record is the writer's
line separator, and every file is one gzip stream of bounded length. Reading parses a file at a
time, record by record.

Assembly joins the records of a transaction to one nested row per capture: requests and metadata
name their response by a concurrent-to identifier, or the response names them, or they name a
record that does. Only identifiers are joined over several hops; each record's content moves once,
and the writer's digests stand in for payloads where these are not asked for.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, remove_folder, salted_join, ship, working_folder

PRIMARY = ("response", "revisit", "resource")
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digits of Spark's conv() in base 32.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: Bytes of records, before compression, after which the writer begins another file.
FILE_BYTES = 64 << 20


def base32_of_hex(hexed: Column) -> Column:
    """Base-32 text of 40 hex digits, 10 at a time."""
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), CONV32, BASE32)


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """The pages' columns and a struct ``w`` of record_type, refers_to, payload_digest and payload_bytes.

    Of pages with equal payloads of at least ``min_payload`` bytes that with the largest identifier
    is the response; the others revisit it. Rows that repeat that identifier are responses too.
    Equal means an equal SHA-1 digest and length. Groups are counted on digests and identifiers alone,
    combined before their shuffle; only payloads that several rows share are joined back, the rows of
    a hot one dealt over salts.
    """
    payload = F.coalesce(F.col(payload_col), F.lit("")).cast("binary")
    digest, n_bytes = base32_of_hex(F.sha1(payload)), F.octet_length(payload).cast("long")
    equal = F.concat(digest, F.lit(":"), n_bytes.cast("string"))
    shared = cut(pages.filter(n_bytes >= min_payload).select(equal.alias("equal"), F.col(id_col).alias("id")).groupBy("equal").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    rows = pages.select(F.struct(*pages.columns).alias("page"), equal.alias("equal"))
    joined = salted_join(rows, shared, "equal", F.coalesce(F.col(f"page.{id_col}").cast("string"), F.lit("")), how="left")
    again = F.col("largest").isNotNull() & ~F.col(f"page.{id_col}").eqNullSafe(F.col("largest"))
    parts = F.split("equal", ":")
    w = F.struct(parts[0].alias("payload_digest"), parts[1].cast("long").alias("payload_bytes"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("largest")).alias("refers_to"))
    return joined.select("page.*", w.alias("w"))


def _record(kind: Column, name: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One WARC record without its closing line breaks. Null headers are left out."""
    lines = [F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: <"), name, F.lit(f">\r\nWARC-Date: {DATE}")]
    lines += [F.coalesce(F.concat(F.lit(f"\r\n{k}: "), v), F.lit("")) for k, v in headers]
    return F.concat(*lines, F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0, file_bytes: int = FILE_BYTES) -> None:
    """Write each page's transaction to gzip'd WARC files under ``path``.

    Payloads are the column's text in UTF-8; null is an empty one. A null address is left out of
    the headers; line breaks in one become spaces. A file ends with the record that takes it to
    ``file_bytes`` bytes before compression, which bounds what a reader holds, however long pages are.
    """
    source = pages.select(F.col(id_col), F.col(url_col), F.col(payload_col))
    rows = with_revisits(source, id_col, payload_col, min_payload)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    url = F.regexp_replace(F.col(url_col), "[\r\n]+", " ")
    name = lambda kind, of=key: F.concat(F.lit("urn:page:"), of, F.lit(f":{kind}"))
    revisit = F.col("w.record_type") == "revisit"
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("w.payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    shown = [("WARC-Target-URI", url)]
    held = _record(
        F.col("w.record_type"),
        name("response"),
        shown
        + [
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("w.payload_digest"))),
            ("WARC-Profile", F.when(revisit, F.lit(REVISIT_PROFILE))),
            ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), name("response", F.col("w.refers_to").cast("string")), F.lit(">")))),
            ("Content-Type", F.lit("application/http;msgtype=response")),
        ],
        F.concat(http, F.when(revisit, F.lit("")).otherwise(payload)),
    )
    beside = F.concat(F.lit("<"), name("response"), F.lit(">"))
    request = _record(F.lit("request"), name("request"), [*shown, ("WARC-Concurrent-To", beside), ("Content-Type", F.lit("application/http;msgtype=request"))], F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1\r\n\r\n")))
    metadata = _record(
        F.lit("metadata"),
        name("metadata"),
        [*shown, ("WARC-Concurrent-To", F.concat(F.lit("<"), name("request"), F.lit(">"))), ("Content-Type", F.lit("application/warc-fields"))],
        F.concat(F.lit("pageId: "), key, F.lit("\r\n")),
    )
    records = rows.select(F.explode(F.array(held, request, metadata)).alias("value"))
    ship(pages.sparkSession)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the number of the task's file that a record goes to."""
        before = 0
        for batch in batches:
            stops = before + np.cumsum(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False).astype(np.int64))
            starts = np.concatenate([[before], stops[:-1]])
            before = int(stops[-1]) if len(stops) else before
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(starts // file_bytes, pa.int32())], names=["value", "file"])

    numbered = records.mapInArrow(number, "value string, file int")
    numbered.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").partitionBy("file").mode("errorifexists").text(path)


RECORD = "record_id string, warc_type string, concurrent_to array<string>, refers_to string, target_uri string, payload_digest string, payload_bytes long, computed_digest string, fields string, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("warc_type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("computed_digest", pa.string()), ("fields", pa.string()), ("payload", pa.binary())])
#: Payload bytes after which the reader hands on what it holds.
_HAND_ON = 4_000_000


def parse_records(content: bytes) -> Iterator[dict]:
    """Records of one archive, gzip'd (one stream or a member per record) or plain."""
    stream = gzip.GzipFile(fileobj=io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:60]!r}")
        headers: dict[str, list[str]] = {}
        while (line := stream.readline()).strip():
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers.setdefault(k.strip().lower(), []).append(v.strip())
        one = lambda k: headers.get(k, [None])[0]  # noqa: B023, E731
        n = int(one("content-length") or 0)
        block = stream.read(n)
        if len(block) < n:
            raise ValueError("a WARC record is cut short")
        kind = (one("warc-type") or "").lower()
        out = {"record_id": (one("warc-record-id") or "").strip("<>"), "warc_type": kind, "concurrent_to": [x.strip("<>") for x in headers.get("warc-concurrent-to", [])], "refers_to": (one("warc-refers-to") or "").strip("<>") or None, "target_uri": one("warc-target-uri"), "payload_digest": (one("warc-payload-digest") or "").removeprefix("sha1:") or None, "payload_bytes": None, "computed_digest": None, "fields": None, "payload": None}
        if kind in ("response", "revisit") and "http" in (one("content-type") or ""):
            head, _, body = block.partition(b"\r\n\r\n")
            declared = next((int(x.partition(b":")[2]) for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            if kind == "response":
                out |= {"payload": body, "payload_bytes": len(body), "computed_digest": base64.b32encode(hashlib.sha1(body).digest()).decode()}
            else:
                out["payload_bytes"] = declared
        elif kind == "resource":
            out |= {"payload": block, "payload_bytes": n, "computed_digest": base64.b32encode(hashlib.sha1(block).digest()).decode()}
        else:
            out["fields"] = block.decode("utf-8", "replace")
        yield out


def read_archives(spark, path: str, with_payload: bool = True) -> DataFrame:
    """Records under ``path``; see RECORD. A malformed archive fails the job rather than lose records.

    ``with_payload=False`` leaves payloads out, having measured and hashed them.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for r in parse_records(content.as_py()):
                    held += len(r["payload"] or b"") + 200
                    rows.append(r if with_payload else r | {"payload": None})
                    if held > _HAND_ON:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content").mapInArrow(run, RECORD)


def assemble_transactions(records: DataFrame) -> DataFrame:
    """One row per response, revisit or resource record, with its requests and metadata nested.

    Columns: the record's own, then requests and metadata, arrays of (record_id, target_uri,
    fields) sorted by record_id. A record that no identifier ties to a capture is left out; a
    capture without others has empty arrays. Captures that repeat a record_id stay separate rows.
    """
    main = records.filter(F.col("warc_type").isin(*PRIMARY))
    side = records.filter(~F.col("warc_type").isin(*PRIMARY))
    ids = cut(records.select("record_id", "warc_type", "concurrent_to"))
    named, other = ids.filter(F.col("warc_type").isin(*PRIMARY)), ids.filter(~F.col("warc_type").isin(*PRIMARY))
    names = named.select(F.col("record_id").alias("capture"))
    links = other.select("record_id", F.explode("concurrent_to").alias("other"))
    direct = links.join(names, F.col("other") == F.col("capture"), "left_semi").select("record_id", F.col("other").alias("capture"))
    stated = named.select(F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture"))
    near = direct.union(stated).distinct()
    over = links.join(near.select(F.col("record_id").alias("other"), "capture"), "other").select("record_id", "capture")
    tied = near.union(over).distinct()
    nested = (
        side.select("record_id", "warc_type", "target_uri", "fields")
        .join(tied, "record_id")
        .groupBy("capture")
        .agg(*[F.array_sort(F.collect_list(F.when(F.col("warc_type") == kind, F.struct("record_id", "target_uri", "fields")))).alias(out) for kind, out in (("request", "requests"), ("metadata", "metadata"))])
    )
    none = F.array().cast("array<struct<record_id:string,target_uri:string,fields:string>>")
    return main.join(nested, F.col("record_id") == F.col("capture"), "left").drop("capture").withColumns({c: F.coalesce(c, none) for c in ("requests", "metadata")})


def warc_captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_payload: int = 0) -> DataFrame:
    """Write ``pages`` to archives in the shared folder, read these back and assemble the captures.

    Per page: id, payload_bytes, payload_digest, record_type, refers_to, target_uri, n_requests,
    n_metadata. Null payloads are empty ones; a null identifier comes back as null; an empty table
    gives no rows; other columns are ignored. A response's digest and length are those of the
    payload read back, a revisit's those its record states.
    """
    spark = pages.sparkSession
    path = working_folder(spark, "warc")
    write_archives(pages, path, id_col, url_col, payload_col, min_payload)
    if pages.isEmpty():
        records = spark.createDataFrame([], RECORD)
    else:
        records = cut(read_archives(spark, path, with_payload=False))
    remove_folder(spark, path)  # what is asked for is in the checkpoint
    kind = pages.schema[id_col].dataType
    page = lambda c: F.expr(f"try_cast(nullif(regexp_extract({c}, '^urn:page:(.*):response$', 1), '') as {kind.simpleString()})")
    return assemble_transactions(records).select(
        page("record_id").alias(id_col),
        F.col("payload_bytes"),
        F.coalesce("computed_digest", "payload_digest").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        page("refers_to").alias("refers_to"),
        "target_uri",
        F.size("requests").alias("n_requests"),
        F.size("metadata").alias("n_metadata"),
    )
