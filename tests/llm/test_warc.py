import base64
import hashlib
import io
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.llm import warc
from strandloom.llm.warc import _gzip, assemble, members, parse_record, read_records, record, resolve_revisits, write_archives

PAGES = "page_id long, url string, html string"


def captures(spark, rows, **kw):
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).withColumn("own", F.lit(1))
    return resolve_revisits(assemble(read_records(write_archives(pages, **kw)))).collect()


ROWS = [(5, "http://h/a?q=1", "<p>é</p>"), (3, None, "<p>é</p>"), (9, "http://h/\r\nX: y", None), (4, "u v", ""), (None, "x", "no id"), (7, "", "long " * 300_000), (8, "", "\r\n\r\nx"), (3, "z", "<p>é</p>")]


@pytest.mark.parametrize("most", [0, 150_000])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", most)
    got = captures(spark, ROWS)
    groups = defaultdict(list)
    for p, _, h in ROWS:
        groups[(h or "").encode()].append(p)
    assert len(got) == len(ROWS)
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        mine = [r for r in got if r.response.digest == digest]
        assert sorted((r.metadata.fields.get("page-id") for r in mine), key=repr) == sorted((None if i is None else str(i) for i in ids), key=repr)
        kinds = [r.response.type for r in mine]
        assert kinds.count("response") == 1 and all(r.response.payload_bytes == len(payload) for r in mine)
        for r in mine:
            if r.response.type == "response":
                assert bytes(r.response.payload) == payload
                first = r
        for r in mine:
            if r.response.type == "revisit":
                assert r.response.refers_to == first.id == r.original.id and r.original.metadata.fields["page-id"] == str(min(ids)) and r.original.url == first.url
            else:
                assert r.original is None
    assert all(r.request is not None and "host" in r.request.fields for r in got)


def test_small_payloads_and_empty(spark):
    assert all(r.response.type == "response" for r in captures(spark, ROWS, min_bytes=1000))
    assert captures(spark, []) == []


def test_concurrent_to_in_every_direction(spark):
    def raw(kind, own, block=b"HTTP/1.1 200 OK\r\n\r\nx", to=None):
        return record({"WARC-Type": kind, "WARC-Record-ID": own, "WARC-Concurrent-To": to}, block)

    data = [raw("response", "<r1>", to="<q1>"), raw("request", "<q1>"), raw("metadata", "<m1>", b"a: b\r\n", "<q1>"), raw("response", "<r2>"), raw("request", "<q9>", to="<gone>"), raw("warcinfo", "<w>", b"")]
    rows = [r for d in members(io.BytesIO(b"".join(map(_gzip, data)))) if (r := parse_record(d, True))]
    got = {r.id: r for r in assemble(spark.createDataFrame([(*r[:8], dict(r[8])) for r in rows], warc.RECORD)).collect()}
    assert set(got) == {"<r1>", "<r2>"} and got["<r1>"].request.id == "<q1>" and got["<r1>"].metadata.fields == {"a": "b"} and got["<r2>"].request is None


def test_a_revisit_is_resolved_by_its_identifier_alone(spark):
    """Originals in another archive are found; without their record a revisit has none."""
    rows = [(i, f"u{i}", "same" if i % 2 else f"own {i}") for i in range(40)]
    records = read_records(write_archives(spark.createDataFrame(rows, PAGES).repartition(6), min_bytes=0))
    whole = resolve_revisits(assemble(records)).collect()
    assert {int(r.original.metadata.fields["page-id"]) for r in whole if r.response.type == "revisit"} == {1}
    first = next(r.original.id for r in whole if r.original)
    cut = resolve_revisits(assemble(records.where(F.col("id") != first))).collect()
    assert len(cut) == 39 and sum(r.response.type == "revisit" for r in cut) == 19 and all(r.original is None for r in cut)


def test_damage_is_found():
    bad = record({"WARC-Type": "response", "WARC-Record-ID": "<x>", "WARC-Payload-Digest": "sha1:AAAA"}, b"HTTP/1.1 200 OK\r\n\r\nx")
    with pytest.raises(ValueError):
        parse_record(bad, True)
    with pytest.raises(ValueError):
        list(members(io.BytesIO(_gzip(b"x" * 100)[:-12])))
