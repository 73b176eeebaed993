import base64
import gzip
import hashlib
import io

import pytest

from paperloom.llm.warc import RECORD, assemble_transactions, parse_records, read_archives, warc_captures, write_archives

PAGES = [(1, "http://a", "same"), (2, "http://b\r\nX: y", "same"), (9, None, "same"), (3, "u", None), (4, "u", ""), (5, "u", "WARC/1.1\r\n\r\n\r\né日本\r\n\r\n"), (6, "u", "x" * 300_000), (None, "u", "no id"), (7, "u", "twice"), (7, "u", "twice")]


def brute(rows, least=0):
    out = []
    for i, _, html in rows:
        raw = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == raw and j is not None]
        again = len(raw) >= least and ids and i != max(ids)
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 3])
def test_captures(spark, least):
    df = spark.createDataFrame([(*r, "x", "y", 1, "z") for r in PAGES], "page_id long, url string, html string, w string, equal string, n int, page string")
    got = warc_captures(df, min_payload=least)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(PAGES, least)
    assert got.filter("n_requests < 1 or n_metadata < 1").count() == 0
    assert warc_captures(df.limit(0)).count() == 0


def test_hot_payload(spark):
    """A third of the pages share one payload: their rows are dealt over salts."""
    pages = [(i, "u", "hot" if i % 3 == 0 else f"own {i // 2}") for i in range(300)]
    got = warc_captures(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(pages)


def test_payloads_come_back(spark, tmp_path):
    df = spark.createDataFrame(PAGES[:7], "page_id long, url string, html string")
    write_archives(df.repartition(1), str(tmp_path / "w"), file_bytes=2_000)
    files = [len(gzip.open(f).read()) for f in (tmp_path / "w").rglob("*.gz")]
    assert len(files) >= 4 and sorted(files)[-2] < 4_000  # but for the one long page
    got = assemble_transactions(read_archives(spark, str(tmp_path / "w")))
    payloads = {r["record_id"]: bytes(r["payload"]) for r in got.filter("warc_type = 'response'").collect()}
    assert payloads["urn:page:5:response"] == PAGES[5][2].encode() and payloads["urn:page:6:response"] == PAGES[6][2].encode()
    assert {r["payload_digest"] == r["computed_digest"] for r in got.filter("warc_type = 'response'").collect()} == {True}


def test_members_plain_files_and_damage():
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <a>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for content in (record * 2, gzip.compress(record) + gzip.compress(record)):
        assert [r["payload"] for r in parse_records(content)] == [b"abc", b"abc"]
    with pytest.raises(ValueError):
        list(parse_records(record[:-6]))
    with pytest.raises(ValueError):
        list(parse_records(b"junk\r\n"))
    assert list(parse_records(b"")) == [] and io is not None


def test_links_in_either_direction(spark):
    row = lambda rid, kind, other: (rid, kind, other, None, None, None, None, None, None, None)
    records = spark.createDataFrame([row("r1", "response", ["q1"]), row("q1", "request", []), row("m1", "metadata", ["q1"]), row("r2", "response", []), row("q2", "request", ["r2"]), row("lost", "metadata", ["none"])], RECORD)
    got = {r["record_id"]: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in assemble_transactions(records).collect()}
    assert got == {"r1": (["q1"], ["m1"]), "r2": (["q2"], [])}
