"""WARC archives: exact round trips, records written by hand, and what is broken in them."""

import base64
import gzip
import hashlib

import pytest

from framelark.llm import warc

LONG = "".join(chr(0x4E00 + i % 3000) for i in range(9000))
ROWS = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/", "<p>one</p>"),
    (7, "http://c/\r\nX: y", "<p>one</p>"),
    (3, None, None),
    (4, "http://d/", ""),
    (5, "http://e/", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 30),
    (6, "http://f/", LONG),
    (9007199254740993, "http://f/", LONG),
    (9007199254740995, "http://g/", "x" * 100_000),
    (None, "http://h/", "no id"),
    (None, "http://h/", "no id"),
    (None, "http://i/", "<p>one</p>"),
    (8, "http://j/", "twice"),
    (8, "http://j/", "twice"),
    (8, "http://j/", "y" * 70_000),
    (8, "http://j/", "y" * 70_000),
    (10, "é ü", "line\nline\r\n\r\nline\x00\x85"),
]


def sha(t):
    return base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()


def expected(rows, least=0):
    heads = {}
    for i, _, t in rows:
        if len((t or "").encode()) >= least:
            heads.setdefault(t or "", []).append(i)
    out = []
    for i, _, t in rows:
        known = [x for x in heads.get(t or "", []) if x is not None]
        head = max(known) if known else i
        again = head != i and len((t or "").encode()) >= least
        out.append((i, len((t or "").encode()), sha(t), "revisit" if again else "response", head if again else None, "ok"))
    return sorted(out, key=repr)


def pages(spark, rows):
    return spark.createDataFrame([(i, u, t, "p", "h") for i, u, t in rows], "page_id long, url string, html string, payload string, head string")


def back(spark, path):
    return sorted(map(tuple, warc.resolved(warc.read_warc(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "status").collect()), key=repr)


@pytest.mark.parametrize("least,segment,chunk,archive", [(0, 32_768, 4096, 1 << 20), (0, 100, 7, 3000), (11, 1000, 1 << 20, 1)])
def test_round_trip(spark, tmp_path, least, segment, chunk, archive):
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages(spark, ROWS), path, least, segment, chunk, archive)
    assert back(spark, path) == expected(ROWS, least)
    got = warc.read_warc(spark, path).where("record_type = 'response'").collect()
    assert {(r.page_id, bytes(r.payload).decode()) for r in got} == {(i, t or "") for i, _, t in ROWS if any(e[0] == i and e[2] == sha(t) and e[3] == "response" for e in expected(ROWS, least))}
    assert next(r.url for r in got if r.page_id == 7) == "http://c/%0D%0AX: y"
    files = list(tmp_path.rglob("*.gz"))
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo") for f in files) and len(files) >= (10 if archive < 5000 else 1)


def test_empty_table(spark, tmp_path):
    warc.write_warc(pages(spark, ROWS).limit(0), f"file://{tmp_path}/w")
    assert back(spark, f"file://{tmp_path}/w") == []


def by_hand(kind, ident, block, *more):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{ident}>\r\n" + "".join(f"{m}\r\n" for m in more)
    return head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def test_records_by_hand(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nContent-Type: text/plain\r\n\r\n"
    coded = b"HTTP/1.1 200 OK\r\ntransfer-encoding: Chunked\r\n\r\n"
    body = coded + b"4;ext=1\r\nWiki\r\nA\r\npedia in\r\n\r\n0\r\nTrailer: x\r\n\r\n"
    parts = [body[:20], body[20:60], body[60:]]
    seg = lambda i, k, b, *m: by_hand("continuation" if k > 1 else "response", f"{i}{k if k > 1 else ''}", b, f"WARC-Segment-Number: {k}", *([f"WARC-Segment-Origin-ID: <urn:{i}>"] if k > 1 else []), *m)
    total = f"WARC-Segment-Total-Length: {len(body)}"
    good = [seg("s", 3, parts[2], total), seg("s", 1, parts[0]), by_hand("request", "q", b"GET /"), seg("s", 2, parts[1])]
    bad = [
        by_hand("response", "plain", http + b"hello"),
        by_hand("response", "nohttp", b"hello"),
        by_hand("response", "badchunk", coded + b"zz\r\nhello"),
        by_hand("response", "short", coded + b"5\r\nhello\r\n"),
        by_hand("response", "digest", http + b"hello", "WARC-Payload-Digest: sha1:AAAA"),
        by_hand("response", "block", http + b"hello", "WARC-Block-Digest: sha1:AAAA"),
        seg("gap", 1, parts[0]),
        seg("gap", 3, parts[2], total),
        seg("long", 1, parts[0]),
        seg("long", 2, parts[1], total),
        seg("noend", 1, parts[0]),
        seg("twofold", 1, parts[0]),
        seg("twofold", 2, parts[1], total),
        seg("twofold", 2, parts[2], total),
        by_hand("revisit", "lost", b"", "WARC-Refers-To: <urn:nowhere>", "WARC-Payload-Digest: sha1:BBBB"),
    ]
    (tmp_path / "a.warc").write_bytes(b"".join(good[:2] + bad[:7]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, good[2:] + bad[7:])))
    (tmp_path / "c.warc").write_bytes(by_hand("response", "torn", http + b"hello")[:-9])
    (tmp_path / "d.warc").write_bytes(b"no archive at all")
    records = warc.read_warc(spark, f"file://{tmp_path}")
    got = {r.record_id: r for r in records.collect()}
    assert {k and k[5:-1]: r.status for k, r in got.items()} == {"s": "ok", "plain": "ok", "nohttp": "http", "badchunk": "chunks", "short": "chunks", "digest": "digest", "block": "block digest", "gap": "segments", "long": "length", "noend": "segments", "twofold": "segments", "lost": "ok", "torn": "cut off", None: "format"}
    assert bytes(got["<urn:s>"].payload) == b"Wikipedia in\r\n" and bytes(got["<urn:plain>"].payload) == b"hello"
    assert [r.status for r in warc.resolved(records).where("record_type = 'revisit'").collect()] == ["no response"]


def test_parameters(spark, tmp_path):
    with pytest.raises(ValueError):
        warc.write_warc(pages(spark, ROWS), f"file://{tmp_path}/w", segment_bytes=0)
