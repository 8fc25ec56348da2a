import base64
import hashlib

import pytest

from convlens.llm import warc as w
from convlens.llm.common import shared_path

FAKE = (w.MAGIC + b"WARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n").decode()
PAGES = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/ x\r\ny%", "<p>one</p>"), (3, None, None), (4, "é", ""), (5, "u", "tail " + w.MAGIC.decode()),
    (6, "u", FAKE), (7, "u", "pre " + FAKE * 3 + " post"), (8, "u", w.MAGIC.decode() * 2), (9, "u", "\r\n\r\n"), (10, "u", "x" * 9000 + FAKE),
    (None, "n", "<p>one</p>"), (12, "u", FAKE), (12, "u", FAKE), (13, "u", "é ☃"), (1, "u", "other"),
]


def expected():
    data = [(p, (h or "").encode()) for p, _, h in PAGES]
    out = []
    for p, h in data:
        top = max((q for q, x in data if x == h and q is not None), default=None)
        ref = top if p is not None and p < top else None
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if ref is not None else "response", ref))
    return sorted(out, key=repr)


@pytest.mark.parametrize("split, block", [(None, w.BLOCK_BYTES), (700, 512), (4000, 1000)])
def test_round_trip(spark, rows, split, block):
    path = shared_path(spark, "w")
    pages = rows([(*p, "x", "y") for p in PAGES], "page_id long, url string, html string, sha string, refers_to string", 2)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    w.write_archives(pages, path)
    try:
        if split:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = w.read_archives(spark, path, True, block).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted([(r["page_id"], r["bytes"], r["digest"], r["type"], r["refers_to"]) for r in got], key=repr) == expected()
    texts = {(r["page_id"], r["digest"]): r for r in got}
    for p, u, h in PAGES:
        h = (h or "").encode()
        r = texts[p, base64.b32encode(hashlib.sha1(h).digest()).decode()]
        assert r["payload"] is None if r["type"] == "revisit" else bytes(r["payload"]) == h
    assert {r["url"] for r in got} == {u for _, u, _ in PAGES}


def test_min_bytes_and_empty(spark, rows):
    path = shared_path(spark, "w")
    w.write_archives(rows([(1, "a", "xx"), (2, "a", "xx"), (3, "a", "yyyy"), (4, "a", "yyyy")], "page_id long, url string, html string"), path, 3)
    got = {r["page_id"]: (r["type"], r["refers_to"]) for r in w.read_archives(spark, path).collect()}
    assert got == {1: ("response", None), 2: ("response", None), 3: ("revisit", 4), 4: ("response", None)}
    path = shared_path(spark, "w")
    w.write_archives(rows([], "page_id long, url string, html string"), path)
    assert w.read_archives(spark, path).count() == 0


def test_embedded_records_that_do_not_parse(spark, rows):
    magic, tail = w.MAGIC.decode(), "\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    texts = [
        magic + "WARC-Type: revisit\r\nContent-Length: 0\r\n\r\n\r\n\r\n", magic + "X-Page-ID: abc" + tail, magic + "X-Page-ID: " + str(2**64) + tail,
        magic + "WARC-Target-URI: %zz" + tail, *(magic + f"Content-Length: {n}\r\n\r\nx" for n in (10**17, 2**63, "9" * 5000)),
    ]
    pages = rows([(i, "u", t) for i, t in enumerate(texts)], "page_id long, url string, html string", 2)
    path = shared_path(spark, "w")
    w.write_archives(pages, path)
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in w.read_archives(spark, path).collect()} == dict(enumerate(texts))
    assert w.read_archives(spark, path, False).where("page_id = 3").count() == 1
    links = w.candidates(spark, path, False, w._split_starts(spark, path))
    assert links.where("successor > 100000").count() == 0
