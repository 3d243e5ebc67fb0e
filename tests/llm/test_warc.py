from __future__ import annotations

import hashlib

from attestra.llm import warc
from attestra.llm.common import scratch_path

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    out, first = [], {}
    for i, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        body = (h or "").encode()
        first.setdefault(body, i)
    for i, _, h in rows:
        body = (h or "").encode()
        revisit = len(body) >= 100 and first[body] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", first[body] if revisit else None))
    return sorted(out, key=repr)


def run(spark, rows, schema=SCHEMA):
    raw, clean = scratch_path(spark, "w"), scratch_path(spark, "c")
    warc.write_archives(spark.createDataFrame(rows, schema), raw)
    warc.deduplicate_archives(spark, raw, clean)
    return raw, clean, sorted((tuple(r) for r in warc.resolved(spark, clean).collect()), key=repr)


def test_awkward_payloads(spark):
    tricky = "x" * 90 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/1", "é" * 60), (2, "http://a/2", "é" * 60), (3, None, None), (4, "http://b\r\nX: y", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", tricky), (8, "u", tricky), (9, "u", tricky + "\r\n"), (10, "u", "\r\n" * 70)]
    assert run(spark, rows)[2] == brute(rows)


def test_payloads_come_back_whole(spark):
    rows = [(i, f"http://h/{i}", ("ab\r\n" * i) + "tail") for i in range(80)]
    raw, clean, _ = run(spark, rows)
    back = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_archives(spark, raw).collect()}
    assert back == {i: h for i, _, h in rows}
    kept = warc.read_archives(spark, clean).filter("warc_type = 'response'").count()
    assert kept == len(rows)


def test_one_page_in_three_is_a_copy(spark):
    rows = [(i, "u", "hot " * 50 if i % 3 == 0 else f"page {i} " * 30) for i in range(300)]
    assert run(spark, rows)[2] == brute(rows)


def test_equal_rows_have_one_response(spark):
    got = run(spark, [(7, "u", "z" * 200)] * 3)[2]
    assert [g[3] for g in got].count("response") == 1 and all(g[4] in (None, 7) for g in got)


def test_empty(spark):
    assert run(spark, [])[2] == []


def test_small_parts_of_records(spark):
    """Archives without a final record end, or cut short, are refused."""
    import pytest

    path = scratch_path(spark, "broken")
    spark.createDataFrame([("WARC/1.1\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha256:0\r\nWARC-Record-ID: <a>\r\nContent-Length: 99\r\n\r\nabc",)], "value string").write.text(path)
    with pytest.raises(Exception, match="ends inside a record"):
        warc.read_archives(spark, path).collect()
