import gzip
import hashlib
import os

import pytest

from catchment.llm import arc_warc, common
from catchment.llm.arc_warc import ArcRecord, Reject, arc_records, inflated, iso_date, split_http, warc_records
from catchment.session import fresh_path
from hard_rows import EXTRA, N_EXTRA

PAGE = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\n<html>one\r\n\r\nWARC/1.0\r\ntwo</html>"
BINARY = b"HTTP/1.1 200 OK\nX-Page-Id: 9\n\n" + bytes(range(256)) * 2


def version_1(*records, block=b"1 0 Somebody\nURL IP-address Archive-date Content-type Archive-length\n"):
    first = b"filedesc://old.arc 0.0.0.0 20010203040506 text/plain %d\n" % len(block) + block
    return b"\n".join([first, *[b"%s 10.0.0.1 %s text/html %d\n" % (url, date, len(body)) + body for url, date, body in records]]) + b"\n"


def version_2(*records):
    block = b"2 0 Somebody\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    first = b"filedesc://new.arc 0.0.0.0 20010203040506 text/plain 200 - - 0 new.arc %d\n" % len(block) + block
    lines = [b"%s 10.0.0.1 %s text/html; charset=x 200 abc - 77 new.arc %d\n" % (url, date, len(body)) + body for url, date, body in records]
    return b"\n".join([first, *lines]) + b"\n"


@pytest.mark.parametrize("version, file", [(1, version_1), (2, version_2)])
def test_records_of_both_versions(version, file):
    data = file((b"http://a.example/x y", b"19960102030405", PAGE), (b"http://b.example/", b"200001", b""), (b"dns:b.example", b"20000102030405", BINARY))
    first, *rest = arc_records(data)
    assert (first.url[:9], first.version) == ("filedesc:", version)
    assert [(r.version, r.url, r.ip, r.date, r.block) for r in rest] == [
        (version, "http://a.example/x y", "10.0.0.1", "19960102030405", PAGE),
        (version, "http://b.example/", "10.0.0.1", "200001", b""),
        (version, "dns:b.example", "10.0.0.1", "20000102030405", BINARY),
    ]
    assert rest[0].media_type == ("text/html" if version == 1 else "text/html; charset=x")
    assert all(data[r.offset:].startswith(r.url.encode()) for r in rest)


def test_without_a_version_block_the_line_tells():
    whole = version_2((b"http://a/", b"19960102030405", PAGE))
    (record,) = arc_records(whole[whole.index(b"http://a/"):])
    assert (record.version, record.block) == (2, PAGE)
    (record,) = arc_records(b"http://a/ 1.2.3.4 19960102030405 no-type 3\nabc\n")
    assert (record.version, record.media_type, record.block) == (1, "no-type", b"abc")


def test_a_wrong_length_costs_one_record():
    good = (b"http://c.example/", b"19960102030405", PAGE)
    data = version_1(good, good).replace(b"text/html %d\n" % len(PAGE), b"text/html %d\n" % (len(PAGE) - 9), 1)
    found = list(arc_records(data))
    assert [type(r) for r in found] == [ArcRecord, ArcRecord, Reject, ArcRecord]
    assert found[2].reason == "no record line" and found[3].block == PAGE
    cut = list(arc_records(version_1(good, good)[:-20]))
    assert [type(r) for r in cut] == [ArcRecord, ArcRecord, Reject] and cut[2].reason == "shorter than declared"
    assert list(arc_records(b"")) == [] and list(arc_records(b"\n\r\n")) == []


def test_members_of_gzip():
    parts = [os.urandom(100_000), b"a" * 300_000, b"", b"last"]
    members = b"".join(map(gzip.compress, parts))
    assert inflated(members) == inflated(gzip.compress(b"".join(parts))) == b"".join(parts)
    assert inflated(members + b"\nrubbish") == b"".join(parts)
    assert inflated(b"plain") == b"plain" and inflated(b"") == b""


def test_dates_and_heads():
    assert iso_date("20040131120001") == "2004-01-31T12:00:01Z"
    assert iso_date("200401311200") == "2004-01-31T12:00:00Z" and iso_date("2004") == "2004-01-01T00:00:00Z"
    assert iso_date("20041399000000") == "1970-01-01T00:00:00Z" and iso_date("20040131120001999") == "2004-01-31T12:00:01Z"
    assert split_http(BINARY)[1] == bytes(range(256)) * 2
    assert split_http(b"no head") == (b"", b"no head") and split_http(b"HTTP/1.0 204 No Content") == (b"HTTP/1.0 204 No Content", b"")
    assert arc_warc.tag_of(b"HTTP/1.1 200 OK\r\nx-page-id: -7\r\nX-Page-Id: 8\r\n\r\n", "X-Page-Id") == -7
    assert arc_warc.tag_of(b"HTTP/1.1 200 OK\r\nX-Page-Id: 99999999999999999999\r\n\r\n", "X-Page-Id") is None


def put(spark, *files):
    folder = fresh_path(spark, "files").removeprefix("file:")
    os.makedirs(folder)
    for i, data in enumerate(files):
        with open(f"{folder}/f{i}", "wb") as out:
            out.write(data)
    return folder


@pytest.fixture
def converted(spark):
    big = b"HTTP/1.1 200 OK\r\n\r\n" + b"same payload " * 20
    source = put(
        spark,
        version_1((b"http://a/", b"19990102030405", big), (b"http://a/", b"19980102030405", big), (b"http://s/", b"19980102030405", b"HTTP/1.1 200 OK\r\n\r\nsmall")),
        gzip.compress(version_2((b"http://b/", b"20000102030405", BINARY), (b"dns:b", b"20000102030405", b"b. IN A 1.2.3.4"), (b"ftp://b/", b"20000102030405", big[19:]))),
        version_1((b"http://s/", b"19980102030405", b"HTTP/1.1 200 OK\r\n\r\nsmall"))[:-9],
    )
    target = fresh_path(spark, "warc")
    rejects = arc_warc.convert_arc(spark, source, target).collect()
    return rejects, spark.read.format("binaryFile").load(target).where("length > 0"), {r.record_id: r for r in arc_warc.read_warc(spark, target).collect()}


def test_conversion(converted):
    rejects, files, rows = converted
    assert [r.trouble for r in rejects] == ["shorter than declared"]
    assert all(r.intact and r.trouble is None for r in rows.values())
    by = lambda uri, kind: [r for r in rows.values() if (r.uri, r.type) == (uri, kind)]
    assert len([r for r in rows.values() if r.type == "warcinfo"]) == 3
    (first,), (again,) = by("http://a/", "response"), by("http://a/", "revisit")
    assert (first.date, again.date) == ("1998-01-02T03:04:05Z", "1999-01-02T03:04:05Z")
    assert again.refers_to == first.record_id and again.payload_digest == first.payload_digest == hashlib.sha256(b"same payload " * 20).hexdigest()
    assert by("ftp://b/", "resource")[0].payload_digest == first.payload_digest  # no HTTP response, so no revisit
    assert by("dns:b", "response") and by("http://b/", "response")[0].tag == 9
    assert by("http://b/", "response")[0].payload_digest == hashlib.sha256(bytes(range(256)) * 2).hexdigest()
    assert len(by("http://s/", "response")) == 1


def test_files_can_be_read_by_their_lengths(converted):
    _, files, rows = converted
    read = [r for f in files.collect() for r in warc_records(inflated(bytes(f.content)))]
    assert {fields["warc-record-id"] for _, fields, _ in read} == set(rows)
    for _, fields, block in read:
        assert fields["warc-block-digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and len(block) == int(fields["content-length"])
        if fields["warc-type"] == "revisit":
            assert block == b"HTTP/1.1 200 OK\r\n\r\n" and fields["warc-refers-to-date"] == "1998-01-02T03:04:05Z"


def test_equal_archives_stay_whole(spark):
    body = b"HTTP/1.1 200 OK\r\n\r\n" + b"same payload " * 20
    one = version_1((b"http://a/", b"19990102030405", body), (b"http://a/", b"19980102030405", body))
    target = fresh_path(spark, "warc")
    arc_warc.convert_arc(spark, put(spark, one, one), target)
    records = arc_warc.read_warc(spark, target)
    assert sorted(r.type for r in records.collect()) == ["response"] * 2 + ["revisit"] * 2 + ["warcinfo"] * 2
    assert arc_warc.resolved(records).where("payload_bytes = 260").count() == 4


def test_warc_rejects():
    good = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    found = list(warc_records(good + b"WARC/1.1\r\nWARC-Type: x\r\n\r\n" + good + good[:-6]))
    assert [type(r) is Reject for r in found] == [False, True, False, True]


def pages(spark, rows):
    full = [(i, url, html, *[None] * N_EXTRA) for i, url, html in rows]
    return spark.createDataFrame(full, f"page_id bigint, url string, html string, {EXTRA}")


def expected(rows):
    out, first = [], {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        payload = (html or "").encode()
        digest = hashlib.sha256(payload).hexdigest()
        again = len(payload) >= 100 and digest in first
        out.append((i, len(payload), digest, "revisit" if again else "response", first[digest] if again else None))
        first.setdefault(digest, i)
    return sorted(out, key=str)


ROWS = [
    (5, "http://a/\n b", "x" * 100), (3, "", "x" * 100), (3, None, "x" * 100), (None, "http://n/", "x" * 100), (9, "http://a/", "x" * 99), (8, "http://a/", "x" * 99),
    (1, "http://e/", None), (2, "http://e/", ""), (7, "http://u/ü", "é" * 50), (-4, "http://u/", "é" * 50), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 30),
    (11, "u", "\nhttp://x/ 1.1.1.1 20040101000000 text/html 7\n" * 9), (12, "u", "long " * 300_000), (1 << 62, "u", "long " * 300_000),
    (None, "u", "only here " * 30), (None, "u", "only here " * 30),
]


@pytest.mark.parametrize("file_bytes, most_ids", [(1 << 24, 1_000_000), (500, 0)])
def test_hard_rows(spark, monkeypatch, file_bytes, most_ids):
    monkeypatch.setattr(arc_warc, "MOST_IDS", most_ids)  # 0: the join by shuffle
    got = arc_warc.archive_pages(pages(spark, ROWS), file_bytes=file_bytes).collect()
    assert sorted(map(tuple, got), key=str) == expected(ROWS)
    assert arc_warc.archive_pages(pages(spark, ROWS).limit(0)).count() == 0


@pytest.mark.parametrize("share", [1, 1000])
def test_hot_payloads(spark, monkeypatch, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)  # 1: no payload is hot
    rows = [(i, "u", ("hot " if i % 3 else f"rare {i // 9} ") * 40) for i in range(600)]
    got = arc_warc.archive_pages(pages(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_archives_are_removed(spark):
    folder = fresh_path(spark, "x").removeprefix("file:").rsplit("/", 1)[0]
    before = {n for n in os.listdir(folder) if n.startswith(("arc-", "warc-"))}
    arc_warc.archive_pages(pages(spark, ROWS[:3])).count()
    assert {n for n in os.listdir(folder) if n.startswith(("arc-", "warc-"))} == before
