import base64
import hashlib

import pytest
import zstandard

from formlens.llm.warc import archive_pages, archive_records, parse_record, read_archives, record_bytes, write_archives


def expected(rows, least=0):
    out = []
    latest = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        latest[payload] = max((x for x in (latest.get(payload), page) if x is not None), default=None)
    for page, url, html in rows:
        payload = (html or "").encode()
        revisit = len(payload) >= least and page != latest[payload]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out.append((page, url, len(payload), digest, "revisit" if revisit else "response", latest[payload] if revisit else None))
    return sorted(out, key=str)


ROWS = [
    (1, "http://a/1", "<p>same é</p>"), (2, None, "<p>same é</p>"), (7, "http://a/%0A\r\nb", "<p>same é</p>"), (3, "", None),
    (4, "u", ""), (None, "n", "<p>same é</p>"), (None, "m", "only"), (5, "x", "long\r\n\r\n " * 50_000), (6, "a: b", "WARC/1.1\r\n"),
    (7, "http://a/%0A\r\nb", "<p>same é</p>"),
] + [(100 + k, f"http://b/{k}", f"<html><body>page {k} of the site {k * 7919}</body></html>") for k in range(60)]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*row, "d") for row in ROWS], "page_id long, url string, html string, digest string").repartition(3)
    assert sorted(map(tuple, archive_pages(pages).collect()), key=str) == expected(ROWS)
    got = sorted(map(tuple, archive_pages(pages, min_revisit_bytes=14).collect()), key=str)
    assert got == expected(ROWS, 14)


def test_archives_are_small_and_self_contained(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").repartition(2)
    manifest = write_archives(pages, str(tmp_path), archive_bytes=2_000)
    names = manifest.collect()
    assert sum(row.n_records for row in names) == len(ROWS) and len(names) > 2
    for row in names:
        content = (tmp_path / row.path).read_bytes()
        assert len(content) == row.n_bytes and content[:4] == bytes.fromhex("5d2a4d18")
        assert len(list(archive_records(memoryview(content)))) == row.n_records
    # What an abandoned attempt left is not read.
    (tmp_path / "pages-000000-999-0000.warc.zst").write_bytes(content)
    assert read_archives(spark, str(tmp_path), manifest).count() == len(ROWS)


def test_damage_is_noticed():
    record = record_bytes(1, "u", b"payload", 7, "A" * 32, "1970-01-01T00:00:00Z")
    with pytest.raises(ValueError):
        parse_record(record)
    with pytest.raises((ValueError, zstandard.ZstdError)):
        frame = zstandard.compress(record)
        list(archive_records(memoryview(bytes.fromhex("5d2a4d18") + bytes(4) + frame[:-3])))


def test_empty_table(spark):
    assert archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
