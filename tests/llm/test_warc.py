import gzip
import io

from stratiform.llm.warc import Gap, SalvageReader, base32_sha1, read_archives, record_bytes, write_archives


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, path string")


ROWS = [(1, "http://a/\r\nX: y", "<p>é</p>"), (5, "http://b/", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 3), (None, "u", "lone"), (9, "u", "x" * 3_000_000)]


def test_round_trip(spark):
    got = read_archives(write_archives(_pages(spark, ROWS))).collect()
    assert all(r.kind == "record" for r in got) and len(got) == len(ROWS)
    by = {r.page_id: r for r in got}
    assert (by[1].record_type, by[1].refers_to, by[1].payload_bytes) == ("revisit", 5, len("<p>é</p>".encode()))
    assert (by[5].record_type, bytes(by[5].payload).decode()) == ("response", "<p>é</p>")
    assert (by[2].record_type, by[2].refers_to, by[3].record_type) == ("revisit", 3, "response")
    assert by[9].payload_digest == base32_sha1(b"x" * 3_000_000) and by[None].payload_bytes == 4
    longer = read_archives(write_archives(_pages(spark, ROWS), min_bytes=100)).collect()
    assert {r.record_type for r in longer} == {"response"}
    assert read_archives(write_archives(_pages(spark, ROWS).limit(0))).count() == 0


def _records(n):
    return [record_bytes(i, f"http://h/{i}", b"payload %d " % i * 40, "response") for i in range(n)]


def _read(data):
    out = list(SalvageReader(io.BytesIO(data)))
    return [int(x.headers["warc-page-id"]) for x in out if not isinstance(x, Gap)], [(x.offset, x.length) for x in out if isinstance(x, Gap)]


def test_salvage_plain_and_gzip():
    plain = _records(6)
    packed = [gzip.compress(r) for r in plain]
    for parts in (plain, packed):
        assert _read(b"".join(parts)) == (list(range(6)), [])
        start = len(parts[0]) + len(parts[1])
        data = bytearray(b"".join(parts))
        for k in range(40, 60):
            data[start + k] ^= 0xFF
        ids, gaps = _read(bytes(data))
        assert ids == [0, 1, 3, 4, 5] and gaps == [(start, len(parts[2]))]
        cut = b"".join(parts[:2]) + parts[2][: len(parts[2]) // 2] + b"".join(parts[3:])
        assert _read(cut)[0] == [0, 1, 3, 4, 5]
        assert _read(b"".join(parts)[:-9])[0] == list(range(5))
        assert _read(b"junk\n" + parts[0] + b"\0" * 3_000_000 + parts[1]) == ([0, 1], [(0, 5), (5 + len(parts[0]), 3_000_000)])


def test_wrong_length_keeps_the_next_record():
    a, b = _records(2)
    bad = a.replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 1", 1)
    bad = bad if bad != a else a[:-1]
    ids, gaps = _read(bad + b)
    assert ids == [1] and gaps == [(0, len(bad))]
    assert _read(b"") == ([], []) and _read(b"no archive at all") == ([], [(0, 17)])
