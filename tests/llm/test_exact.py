"""Exact dedup, WARC archives and the registered SQL."""

import hashlib
import re

import pytest
from cases import TABLES
from pyspark.sql import functions as F

from calllens.llm import exact_dedup, queries, warc
from calllens.llm.store import put

import check


@pytest.fixture(scope="module")
def con(small):
    return check.connect(small)


@pytest.mark.parametrize("name", list(queries.ORACLE))
def test_query_equals_sql(spark, small, con, name):
    got = queries.QUERIES[name](spark, small).toPandas()
    assert check.difference(got, con.execute(queries.ORACLE[name]).fetchdf()) is None


def by_hand(rows):
    norm = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t, _ in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    out = []
    for i, t in norm:
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("most_sent", [0, 1_000_000])
@pytest.mark.parametrize("bits", ["all", "two", "none"])
def test_exact_groups_whatever_collides(odd, bits, most_sent):
    hashes = {
        "all": exact_dedup.md5_128,
        "two": lambda c: F.pmod(F.length(c), F.lit(2)),
        "none": lambda c: F.lit(1),
    }
    got = exact_dedup.exact_groups(odd, content_hash=hashes[bits], most_sent=most_sent).collect()
    assert sorted(map(tuple, got), key=str) == by_hand(TABLES["rows"])


def test_exact_dedup_keeps_columns_and_empty_tables(odd, none):
    kept = exact_dedup.deduplicate(odd)
    assert kept.columns == odd.columns
    # case counts; null and empty are equal; blanks alone are one space
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 1, 2, 3, 5, 6, 7]
    assert exact_dedup.exact_groups(none).count() == 0


PAGES = [
    (1, "http://a/1", "same body"),
    (9, "http://a/9\r\nX-Bad: 1", "same body"),
    (4, None, "same body"),
    (9, "http://a/9b", "same body"),
    (5, "http://b", None),
    (6, "http://b", ""),
    (7, "http://c", "ünï" * 50_000),
    (None, "http://d", "same body"),
    (None, "http://d", "only here"),
]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").withColumn("digest", F.lit(1))
    got = warc.archive(pages, archive_bytes=2000).collect()
    assert all(r.problem is None for r in got)
    rows = sorted((r.page_id or -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got)
    want = []
    for i, _, html in PAGES:
        body = (html or "").encode()
        top = max((j for j, _, h in PAGES if (h or "") == (html or "") and j is not None), default=None)
        first = top is None or i == top
        want.append((i or -1, "response" if first else "revisit", None if first else top, len(body), warc.sha1_base32(body)))
    assert rows == sorted(want)
    payloads = {(r.page_id, bytes(r.payload)) for r in got if r.record_type == "response"}
    assert (7, ("ünï" * 50_000).encode()) in payloads
    assert next(r for r in got if r.page_id == 4).target_uri == "about:blank"


def test_no_pages_no_archives(spark):
    pages = spark.createDataFrame(PAGES[:1], "page_id bigint, url string, html string").limit(0)
    assert warc.archive(pages).count() == 0


def sample(dictionary: bytes = b"", compressed: bool = True) -> tuple[bytes, list[bytes]]:
    import zstandard

    raws = [warc.record(i, f"http://x/{i}", b"<p>body %d</p>" % i * 20, None) for i in range(40)]
    codec = zstandard.ZstdCompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=True
    )
    return warc.archive_head(dictionary, compressed) + b"".join(map(codec.compress, raws)), raws


@pytest.mark.parametrize("compressed", [True, False])
def test_dictionary_in_the_leading_frame(compressed):
    words = warc.train([warc.record(i, f"http://x/{i}", b"<p>body %d</p>" % i * 20, None) for i in range(300)], 2048)
    assert words
    data, raws = sample(words, compressed)
    assert [r for r, fault in warc.frames(data)] == raws and all(f is None for _, f in warc.frames(data))
    assert warc.leading_dictionary(data)[0] == words


def test_archive_without_dictionary_frame_is_read():
    data, raws = sample()
    assert [r for r, _ in warc.frames(data[8:])] == raws


def test_faults_are_named():
    data, raws = sample()
    assert list(warc.frames(data[:-3]))[-1][1].startswith("frame at byte")
    broken = bytearray(data)
    broken[-10] ^= 0xFF
    assert list(warc.frames(bytes(broken)))[-1][1] is not None
    assert len(list(warc.frames(data, most=10))) == 40 and all(r is None for r, _ in warc.frames(data, most=10))
    good = raws[0]
    assert warc.parse(good)["problem"] is None
    assert "no WARC header" == warc.parse(b"HTTP/1.1 200 OK\r\n\r\n")["problem"]
    assert "missing" in warc.parse(good.replace(b"WARC-Date", b"X-Date"))["problem"]
    assert "Content-Length" in warc.parse(good[:-30])["problem"]
    assert "line breaks" in warc.parse(good + b"x")["problem"]
    assert "digest" in warc.parse(good.replace(b"body 0", b"body 1"))["problem"]
    assert "number" in warc.parse(good.replace(b"X-Page-ID: 0", b"X-Page-ID: zero"))["problem"]


def test_reader_reports_broken_archives_as_rows(spark, tmp_path):
    data, _ = sample()
    put(str(tmp_path), "part-000000-00000.warc.zst", data[:-3])
    rows = warc.read_archives(spark, str(tmp_path)).collect()
    assert len(rows) == 40 and [r.problem is None for r in rows].count(False) == 1
