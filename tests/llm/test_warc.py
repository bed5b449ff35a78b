import hashlib

from cardlens.llm import warc
from cardlens.llm.warc import read_archives, write_archives


def inner(body):
    """A whole record, as a payload may quote it."""
    return ("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\n"
            f"Content-Length: {len(body)}\r\n\r\n{body}\r\n\r\n")


def pages():
    long = "<p>" + "long text " * 30
    rows = [(i, f"http://h/{i}", f"<html>{i} é漢🙂" + "x" * i) for i in range(40)]
    rows += [(50, "u", long), (51, "u", long), (52, None, long), (53, "u", "short"), (54, "u", "short"),
             (55, "bad\r\nurl\n", None), (56, "u", ""), (None, "u", long), (None, None, None),
             (60, "u", "a WARC/1.1\r\n b WARC/1.1\r\nWARC-Type: x\r\n\r\n"),
             (61, "u", inner("quoted body")), (62, "u", inner("q" * 200) + inner("r")),
             (63, "u", "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
             (64, "u", "WARC/1.1\r\n" * 30), (65, "u", "x" * 300_000), (66, "u", "WARC/1.1\r"),
             (67, "u", inner("quoted body")), (70, "u", "same id"), (70, "u", "same id")]
    return rows


def brute(rows):
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 100 and i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = first.get(b) if i is not None and first.get(b, i) < i else None
        out.append((str(i), len(b), hashlib.sha256(b).hexdigest(),
                    "response" if to is None else "revisit", str(to)))
    return sorted(out)


def got(df):
    return sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"],
                   str(r["refers_to"])) for r in df.collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows],
                                 "page_id long, url string, html string, file long, value string")


def test_round_trip_with_magic_in_payloads(spark, tmp_path):
    rows = pages()
    write_archives(frame(spark, rows), str(tmp_path / "a"))
    back = read_archives(spark, str(tmp_path / "a"))
    assert got(back) == brute(rows)
    assert all(r["intact"] for r in back.collect())


def test_files_cut_for_many_tasks(spark, tmp_path):
    rows = pages()
    write_archives(frame(spark, rows).coalesce(1), str(tmp_path / "a"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        assert got(read_archives(spark, str(tmp_path / "a"))) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_archive_is_plain_warc(spark, tmp_path):
    write_archives(frame(spark, [(1, "u", "body")]).coalesce(1), str(tmp_path / "a"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "a").glob("part-*")))
    record = warc.parse(raw[len(warc.MAGIC):])
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and raw.endswith(b"body\r\n\r\n")
    assert len(raw) == len(warc.MAGIC) + record["head"] + record["length"] + 4


def test_empty(spark, tmp_path):
    write_archives(frame(spark, [(1, "u", "x")]).limit(0), str(tmp_path / "a"))
    assert read_archives(spark, str(tmp_path / "a")).collect() == []


def test_parse_rejects_what_is_no_header():
    assert warc.parse(b"no end") is None
    assert warc.parse(b"no colon\r\n\r\n") is None
    assert warc.parse(b"Content-Length: x\r\n\r\n") is None
    assert warc.parse(b"A: b\r\nContent-Length: 3\r\n\r\nabc")["length"] == 3


def test_every_record_has_the_fields_of_the_standard(spark, tmp_path):
    """Type, id, date and length of all records, a profile of revisits; ids are
    unique, and a revisit names the id of a response with its digest."""
    import datetime
    import re
    rows = pages() + [(80, "http://h/a b c", "x" * 150), (81, None, "x" * 150)]
    write_archives(frame(spark, rows).repartition(3), str(tmp_path / "a"),
                   datetime.datetime(2024, 5, 6, 7, 8, 9, tzinfo=datetime.UTC))
    records = []
    for file in (tmp_path / "a").glob("part-*"):
        data, at = file.read_bytes(), 0
        while at < len(data):
            record = warc.parse(data[at + len("WARC/1.1\r\n"):])
            assert data[at:].startswith(b"WARC/1.1\r\n")
            at += len("WARC/1.1\r\n") + record["head"] + record["length"] + 4
            assert data[at - 4:at] == b"\r\n\r\n"
            records.append(record)
    assert len(records) == len(rows)
    ids = {r["warc-record-id"]: r for r in records}
    assert len(ids) == len(rows) and all(re.fullmatch(r"<urn:page:(none|\d+):[0-9a-f]{16}(:\d+)?>", i) for i in ids)
    for r in records:
        assert r["warc-type"] in ("response", "revisit") and r["warc-date"] == "2024-05-06T07:08:09Z"
        assert " " not in r.get("warc-target-uri", "") and r.get("warc-target-uri") != ""
        if r["warc-type"] == "revisit":
            first = ids[r["warc-refers-to"]]
            assert first["warc-type"] == "response" and "warc-profile" in r
            assert first["warc-payload-digest"] == r["warc-payload-digest"]
    assert any(r.get("warc-target-uri") == "http://h/a%20b%20c" for r in records)
