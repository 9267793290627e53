import base64
import hashlib
from collections import Counter

import pytest

from millrace.llm import warc

PAGES = [
    (1, "http://a/", "<p>one</p>"),
    (2, "http://b/", "<p>one</p>"),
    (3, None, None),
    (4, "http://c/\r\nX: y", ""),
    (5, "u", "é漢😀" * 20_000),
    (6, "u", "é漢😀" * 20_000),
    (6, "u", "é漢😀" * 20_000),
    (7, "u", "WARC/1.1\r\n\r\nfake\r\n\r\n0\r\n\r\n"),
    (None, "u", "nobody"),
    (-8, "u", "nobody"),
]


def expected():
    of = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    top = {}
    for k, _, h in PAGES:
        top[h or ""] = max(top.get(h or "", -(10**9)), -(10**9) if k is None else k)
    done, out = set(), Counter()
    for k, _, h in PAGES:
        first = k == top[h or ""] and (k, h) not in done
        done.add((k, h))
        out[k, len((h or "").encode()), of(h), "response" if first else "revisit", None if first else top[h or ""]] += 1
    return out


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_archives_read_back(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW_REPEATS", few)
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string").selectExpr("*", "1 as id", "'x' as sha", "2 as top").repartition(3)
    rows = warc.archived_pages(df).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == expected()
    assert warc.archived_pages(df.limit(0)).count() == 0


def test_payloads_and_segments(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/a")
    records = warc.read_records(spark, f"file://{tmp_path}/a")
    assert records.filter("segment > 1").count() == 5  # 180,000 bytes in six pieces
    kept = {bytes(r.payload).decode() for r in warc.reassemble(records).filter("type = 'response'").collect()}
    assert kept == {h or "" for _, _, h in PAGES}
    for broken in (records.filter("segment <> 2"), records.filter("not (segment > 1 and total is not null)"), records.unionByName(records.filter("segment = 3"))):
        with pytest.raises(Exception, match="segments of"):
            warc.reassemble(broken).collect()


def test_chunked_framing():
    for body in (b"", b"x", b"\r\n" * 9000, "é".encode() * 9001):
        assert warc.unchunked(warc.chunked(body)) == body
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    with pytest.raises(ValueError, match="chunk"):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_archives_are_sized_by_bytes(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(k, "u", f"<p>{k}</p>" * 100) for k in range(400)], "page_id bigint, url string, html string").coalesce(1)
    monkeypatch.setattr(warc, "FILE_BYTES", 100_000)
    warc.write_archives(pages, f"file://{tmp_path}/a")
    assert 3 <= len(list((tmp_path / "a").glob("*.gz"))) <= 12
    assert warc.read_records(spark, f"file://{tmp_path}/a").count() == 400


def test_foreign_archives(spark, tmp_path):
    """Uncompressed files, and gzip members one after another, with bytes that aren't text and empty blocks."""
    import gzip

    record = lambda k, b: b"WARC/1.0\r\nWARC-Type: metadata\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (k, len(b), b)
    blocks = [b"\xff\xfe\x00", b"", b"\r\n\r\n", b"a\r\n\r\n\r\n\r\nb", b"plain\r\n"]
    (tmp_path / "a.warc").write_bytes(b"".join(record(k, b) for k, b in enumerate(blocks)))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(record(k + 10, b)) for k, b in enumerate(blocks)))
    got = {r.origin: bytes(r.block) for r in warc.read_records(spark, f"file://{tmp_path}").collect()}
    assert got == {f"<urn:{k + of}>": b for of in (0, 10) for k, b in enumerate(blocks)}
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record(1, b"cut off")[:-6]))
    with pytest.raises(Exception, match="record"):
        warc.read_records(spark, f"file://{tmp_path}").collect()


def test_parser_checks_lengths():
    good = b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [b for _, b in warc.parse(good * 2)] == [b"abc", b"abc"]
    assert [b for _, b in warc.joined((good * 2).split(b"\r\n\r\n")[:-1])] == [b"abc", b"abc"]
    for bad in (good[:-3], good.replace(b": 3", b": 4"), b"junk" + good):
        with pytest.raises((ValueError, KeyError)):
            list(warc.parse(bad))
