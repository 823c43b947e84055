import hashlib

import pytest
import zstandard

from ledgerloom.llm import warc

BIG, BIG2 = "<p>" + "x" * 2000, "<p>é\r\n\r\n" + "y" * 1500


@pytest.fixture
def pages(spark):
    rows = [(1, "http://a/1", BIG), (2, None, BIG), (3, "http://a/ 3\r\nX: y", BIG), (4, "u", None), (5, "u", ""), (6, "u", "small"), (7, "u", "small"),
            (8, "u", BIG2), (9, "u", BIG2), (9, "u", BIG2), (10, "u", "z" * 1000), (11, "u", "z" * 1000), (12, "u", "w" * 999), (13, "u", "w" * 999),
            (14, "u", "long" * 200_000), (None, "u", BIG)]
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, digest string")


def test_round_trip(pages):
    found = sorted(map(tuple, warc.archived(pages).drop("url").collect()), key=str)
    rows = pages.collect()
    want = []
    for r in rows:
        body = (r.html or "").encode()
        last = max((x.page_id for x in rows if (x.html or "") == (r.html or "") and x.page_id is not None), default=None)
        again = len(body) >= 1000 and r.page_id is not None and r.page_id != last
        want.append((r.page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", last if again else None))
    assert found == sorted(want, key=str)
    assert warc.archived(pages.limit(0)).count() == 0


def test_seekable_bundles(pages, spark, tmp_path):
    path = str(tmp_path / "a")
    warc.write(pages, path, bundle_bytes=1)
    bundles = spark.read.parquet(path).collect()
    assert len(bundles) > 1 and sum(b.n_records for b in bundles) == 16
    content = next(b.content for b in bundles if warc.read_record(bytes(b.content), "8"))
    [data] = warc.read_record(bytes(content), "8")
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: revisit") and b"WARC-Refers-To: <urn:page:9>" in data
    # Any Zstandard reader sees the records alone: index and seek table are skippable frames.
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(content), read_across_frames=True).read()
    assert data in whole


def test_damage_is_noticed(pages, spark, tmp_path):
    bundle = warc.Bundle()
    bundle.add("1", warc.record(1, "u", b"body", "0" * 40))
    archives = spark.createDataFrame([(0, 1, bytearray(bundle.close()))], warc.ARCHIVE)
    with pytest.raises(Exception, match="does not have the digest"):
        warc.read(archives).collect()
