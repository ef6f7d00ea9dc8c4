"""WARC archives: pages out as response and revisit records, and records of any segmentation back in."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ._shared import cut, prepare, shared_dir

CRLF = b"\r\n"
END = CRLF * 2
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
#: Bytes of rows that a task hands over at once.
FLUSH_BYTES = 8 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int) -> bytes:
    """``payload`` in chunked transfer framing."""
    out = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes | None:
    """What chunked framing holds; chunk extensions and trailers are skipped. None if the framing is broken or stops early."""
    out, at = [], 0
    while True:
        eol = body.find(CRLF, at)
        if eol < 0:
            return None
        digits = body[at:eol].split(b";", 1)[0].strip()
        if not digits or digits.strip(b"0123456789abcdefABCDEF"):
            return None
        n, at = int(digits, 16), eol + 2
        if n == 0:
            while True:
                eol = body.find(CRLF, at)
                if eol < 0:
                    return None
                if eol == at:
                    return b"".join(out)
                at = eol + 2
        if body[at + n : at + n + 2] != CRLF:
            return None
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> tuple[bytes | None, str]:
    """The payload of an HTTP response and its status: ``ok``, ``http`` (no end of headers) or ``chunks`` (broken framing)."""
    end = block.find(END)
    if end < 0:
        return None, "http"
    head, body = block[:end].lower(), block[end + 4 :]
    coded = any(line.startswith(b"transfer-encoding:") and b"chunked" in line for line in head.split(CRLF))
    if not coded:
        return body, "ok"
    payload = unchunked(body)
    return payload, "ok" if payload is not None else "chunks"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}:{digest}').urn}>"


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """One record, whole but for its last line feed, which the writer of lines puts after it. Fields without a value are left out; controls in values are percent-encoded."""
    lines = [f"{k}: {''.join(c if c >= ' ' and c != chr(127) else f'%{ord(c):02X}' for c in str(v))}\r\n" for k, v in fields if v is not None]
    return b"WARC/1.1\r\n" + "".join(lines).encode("utf-8", "surrogatepass") + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r"


def response(page_id: int | None, url: str | None, payload: bytes, date: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """A response as one record, or as a first segment and continuation records if its block is longer than ``segment_bytes``."""
    digest = base32_sha1(payload)
    block = (HTTP + "Transfer-Encoding: chunked\r\n\r\n").encode() + chunked(payload, chunk_bytes)
    origin, n = record_id(page_id, digest), -(-len(block) // segment_bytes)
    out = []
    for k in range(n):
        part = block[k * segment_bytes : (k + 1) * segment_bytes]
        out.append(
            record(
                [
                    ("WARC-Type", "continuation" if k else "response"),
                    ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{origin}:{k}').urn}>" if k else origin),
                    ("WARC-Date", date),
                    ("WARC-Target-URI", url),
                    ("Page-ID", page_id),
                    ("Content-Type", None if k else "application/http;msgtype=response"),
                    ("WARC-Payload-Digest", None if k else f"sha1:{digest}"),
                    ("WARC-Block-Digest", f"sha1:{base32_sha1(part)}"),
                    ("WARC-Segment-Number", k + 1 if n > 1 else None),
                    ("WARC-Segment-Origin-ID", origin if k else None),
                    ("WARC-Segment-Total-Length", len(block) if k and k == n - 1 else None),
                ],
                part,
            )
        )
    return out


def revisit(page_id: int | None, url: str | None, payload: bytes, head: int | None, date: str) -> bytes:
    digest = base32_sha1(payload)
    block = (HTTP + "\r\n").encode()
    return record(
        [
            ("WARC-Type", "revisit"),
            ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'revisit:{page_id}:{url}:{digest}').urn}>"),
            ("WARC-Date", date),
            ("WARC-Target-URI", url),
            ("Page-ID", page_id),
            ("Content-Type", "application/http;msgtype=response"),
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(head, digest)),
            ("WARC-Payload-Digest", f"sha1:{digest}"),
            ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ],
        block,
    )


def write_warc(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = 32_768, chunk_bytes: int = 4096, archive_bytes: int = 32 << 20, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html) to gzip archives under ``path``.

    Of rows with equal payloads (html in UTF-8, null as empty) of ``min_revisit_bytes`` or more, those with the largest page_id are
    responses and the others revisit records that refer to it; a null page_id is the smallest. Rows that share page_id and payload
    are the same record, written as often as the row comes. Responses are framed in chunks, and a block longer than ``segment_bytes`` is
    cut into a first segment and continuation records. A task goes on to its next archive after about ``archive_bytes``.
    Other columns are ignored. No rows make no archives.

    Only digests seen under several page_ids are kept for the join; html is shuffled only where that table is too large to broadcast
    (Spark compares its size with its own threshold).
    """
    if segment_bytes < 1 or chunk_bytes < 1:
        raise ValueError("segments and chunks have at least one byte")
    prepare(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    seen = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("head"), F.min("page_id").alias("least"), F.max(F.col("page_id").isNull()).alias("unnamed"))
    shared = cut(seen.where((F.col("least") < F.col("head")) | (F.col("unnamed") & F.col("head").isNotNull())).select("digest", "head"), "warc-heads")
    judged = rows.join(shared, "digest", "left").select("page_id", "url", "payload", "head", (F.col("head").isNotNull() & ~F.col("head").eqNullSafe(F.col("page_id"))).alias("again"))

    def run(batches):
        archive, size, held, n_held = 0, 0, [], 0
        start = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in held], pa.int32()), pa.array([r for _, r in held], pa.binary())], names=["archive", "record"])

        for b in batches:
            for page_id, url, data, head, again in zip(*(b.column(k) for k in range(5)), strict=True):
                page_id, url, data = page_id.as_py(), url.as_py(), data.as_py()
                parts = [revisit(page_id, url, data, head.as_py(), date)] if again.as_py() else response(page_id, url, data, date, segment_bytes, chunk_bytes)
                for r in parts:
                    if size >= archive_bytes:
                        archive, size = archive + 1, 0
                    if size == 0:
                        held.append((archive, start))
                    held.append((archive, r))
                    size += len(r) + 1
                    n_held += len(r)
                    if n_held >= FLUSH_BYTES:
                        yield flush()
                        held, n_held = [], 0
        if held:
            yield flush()

    lines = judged.mapInArrow(run, "archive int, record binary").select("archive", F.col("record").cast("string").alias("record"))
    lines.write.partitionBy("archive").option("compression", "gzip").option("lineSep", "\n").text(path)


def parse_records(raw: bytes):
    """Header fields (names lower-cased) and block of each record of an archive, gzip members or plain. A cut-off last record comes with the status ``cut off``."""
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    at = 0
    while at < len(raw):
        if raw.startswith(CRLF, at) or raw.startswith(b"\n", at):
            at += 2 if raw.startswith(CRLF, at) else 1
            continue
        end = raw.find(END, at)
        if end < 0 or not raw.startswith(b"WARC/", at):
            yield {}, raw[at:], "cut off" if raw.startswith(b"WARC/", at) else "format"
            return
        fields = {}
        for line in raw[at:end].split(CRLF)[1:]:
            name, _, value = line.partition(b":")
            fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        try:
            n = int(fields.get("content-length", ""))
        except ValueError:
            yield fields, b"", "format"
            return
        block = raw[end + 4 : end + 4 + n]
        yield fields, block, "ok" if len(block) == n else "cut off"
        at = end + 4 + n


READ = "whole boolean, record_id string, segment int, record_type string, page_id long, url string, refers_to_id string, declared string, total long, block binary, payload binary, payload_bytes long, payload_digest string, status string"
NAMES = [c.split()[0] for c in READ.split(", ")]


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(_parse_datatype_string(ddl))


def _number(text: str | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def _judge(row: dict, block: bytes, payloads: bool) -> dict:
    """Fill in a whole record's payload, its size and digest, and compare with what the record declares."""
    if row["record_type"] == "response":
        payload, status = payload_of(block)
        if payload is not None:
            row["payload_bytes"], row["payload_digest"] = len(payload), base32_sha1(payload)
            row["payload"] = payload if payloads else None
            if row["declared"] is not None and row["declared"] != row["payload_digest"]:
                status = "digest"
        if row["status"] == "ok":
            row["status"] = status
    elif row["record_type"] == "revisit":
        row["payload_digest"] = row["declared"]
    return row


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records of the archives under ``path``, segments put together.

    Columns: record_id, record_type, page_id, url, refers_to_id (of revisits), payload (null without ``payloads`` and for revisits), payload_bytes, payload_digest
    (bare base-32 SHA-1), status. Archives (gzip or plain) are read as whole files, so they should be of some tens of megabytes. Segments of a record are grouped by
    the identifier of its origin and ordered by number; they must run from 1 without a gap and add up to the total length that the last one
    declares. Chunked framing is decoded. Status is ``ok`` or the first thing wrong: ``format``, ``cut off``, ``block digest``, ``segments``
    (missing or contradicting), ``length``, ``http``, ``chunks``, ``digest``; such rows come with the payload null where it can't be told. Records of other types than
    response, revisit and continuation are left out. A record written several times with the same identifier comes back as often.
    """
    prepare(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("content")

    schema = _arrow(READ)

    def parse(batches):
        held, size = [], 0
        for b in batches:
            for content in b.column(0):
                for f, block, status in parse_records(content.as_py()):
                    kind = f.get("warc-type")
                    if status == "ok" and kind not in ("response", "revisit", "continuation"):
                        continue
                    row = dict.fromkeys(NAMES)
                    declared = f.get("warc-block-digest")
                    if status == "ok" and declared is not None and declared.startswith("sha1:") and declared[5:] != base32_sha1(block):
                        status = "block digest"
                    origin, number = f.get("warc-segment-origin-id"), _number(f.get("warc-segment-number"))
                    digest = f.get("warc-payload-digest")
                    row |= {"record_id": origin or f.get("warc-record-id"), "record_type": kind, "page_id": _number(f.get("page-id")), "url": f.get("warc-target-uri"), "refers_to_id": f.get("warc-refers-to"), "declared": digest[5:] if digest and digest.startswith("sha1:") else None, "status": status}
                    row["whole"] = number is None and kind != "continuation"
                    if row["whole"]:
                        _judge(row, block, payloads)
                    else:
                        row |= {"segment": number, "total": _number(f.get("warc-segment-total-length")), "block": block}
                    held.append(row)
                    size += len(row["block"] or b"") + len(row["payload"] or b"") + 500
                    if size >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    parsed = cut(files.mapInArrow(parse, READ), "warc-records")
    out = ["record_id", "record_type", "page_id", "url", "refers_to_id", "payload", "payload_bytes", "payload_digest", "status"]
    return parsed.where("whole").select(out).unionByName(assembled(parsed.where(~F.col("whole")), payloads).select(out))


def assembled(pieces: DataFrame, payloads: bool = True) -> DataFrame:
    """Records put together from segments.

    Equal pieces (a record written several times) are counted first, so that a record takes one group of its own segments, however often it comes.
    """
    fields = F.struct("record_type", "page_id", "url", "declared", "total", "block", "status")
    once = pieces.withColumn("own", F.sha1("block")).groupBy("record_id", "segment").agg(F.count(F.lit(1)).alias("copies"), F.min("own").alias("low"), F.max("own").alias("high"), F.first(fields).alias("f"))
    listed = F.struct("segment", "copies", (F.col("low") == F.col("high")).alias("same"), "f.*")
    grouped = once.select("record_id", listed.alias("p")).groupBy("record_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))

    schema = _arrow(f"{READ}, copies long")

    def join(batches):
        for b in batches:
            rows = []
            for origin, ps in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first = ps[0]
                row = dict.fromkeys([*NAMES, "copies"]) | {"record_id": origin, "record_type": first["record_type"], "page_id": first["page_id"], "url": first["url"], "declared": first["declared"], "status": "ok", "copies": max(p["copies"] for p in ps)}
                if row["record_type"] == "continuation":
                    row["record_type"] = "response"
                block = b"".join(p["block"] for p in ps)
                bad = next((p["status"] for p in ps if p["status"] != "ok"), None)
                if bad:
                    row["status"] = bad
                elif [p["segment"] for p in ps] != list(range(1, len(ps) + 1)) or ps[-1]["total"] is None or not all(p["same"] for p in ps) or len({p["copies"] for p in ps}) > 1:
                    row["status"] = "segments"
                elif ps[-1]["total"] != len(block):
                    row["status"] = "length"
                else:
                    _judge(row, block, payloads)
                rows.append(row)
            yield pa.RecordBatch.from_pylist(rows, schema)

    return grouped.mapInArrow(join, f"{READ}, copies long").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")


def resolved(records: DataFrame) -> DataFrame:
    """Revisits with the size of the payload they refer to and the page_id of its response (refers_to); responses as they are.

    A revisit whose response is missing has the status ``no response``, one whose digest differs from it ``digest``.
    """
    slim = records.drop("payload")
    answers = slim.where(F.col("record_type") == "response").groupBy(F.col("record_id").alias("refers_to_id")).agg(F.first(F.struct("page_id", "payload_bytes", "payload_digest")).alias("r"))
    again = slim.where(F.col("record_type") == "revisit").join(answers, "refers_to_id", "left")
    status = F.when(F.col("status") != "ok", F.col("status")).when(F.col("r").isNull(), "no response").when(~F.col("payload_digest").eqNullSafe(F.col("r.payload_digest")), "digest").otherwise("ok")
    columns = ["page_id", "url", "payload_digest", "record_type", "status"]
    revisits = again.select(*columns[:-1], status.alias("status"), F.col("r.payload_bytes").alias("payload_bytes"), F.col("r.page_id").alias("refers_to"))
    responses = slim.where(F.col("record_type") != "revisit").select(*columns, "payload_bytes", F.lit(None).cast("long").alias("refers_to"))
    return responses.unionByName(revisits)


def op12_web_archives(spark, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/framelark-warc-{uuid.uuid4().hex}"
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    records = cut(read_warc(spark, path, payloads=False), "warc-read")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status")
