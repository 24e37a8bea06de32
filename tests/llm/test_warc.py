import base64
import hashlib
import io

import pytest
import zstandard

from strataq.llm import warc as W

from .conftest import prose

PAGES = "page_id long, url string, html string"


def want(rows, least=0):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    out = []
    for page, _, html in rows:
        body = (html or "").encode()
        best = top.get(html or "") if len(body) >= least else None
        again = best is not None and page != best
        out.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", best if again else None))
    return sorted(out, key=repr)


ROWS = [(1, "http://a/ü?x=1\r\n y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (9, "u", "\r\n\r\nWARC/1.1\r\n\r\n"), (5, "u", "<p>one</p>"), (None, "u", "<p>one</p>"), (6, "u", "🎉" * 3000), (7, "u", prose(1, 30_000)), (7, "u", prose(1, 30_000))]
ROWS += [(100 + i, f"http://h/{i}", f"<html><body>{prose(i, 60)}</body></html>") for i in range(60)]


def digest(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, table, least):
    archives = W.write_archives(table(ROWS, PAGES, "pages"), least=least)
    got = W.read_archives(spark, archives, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]).collect()
    assert digest(got) == want(ROWS, least) and sum(a["records"] for a in archives) == len(ROWS)
    whole = W.read_archives(spark, archives).where("record_type = 'response'").collect()
    kept = {(r["page_id"], bytes(r["payload"])) for r in whole}
    assert kept <= {(p, (h or "").encode()) for p, _, h in ROWS} and {b for _, b in kept} == {(h or "").encode() for _, _, h in ROWS}


def some(n=30):
    rows = [(i, "u", f"<p>{prose(i, 50)}</p>".encode()) for i in range(n)]
    return [(p, u, b, base64.b32encode(hashlib.sha1(b).digest()).decode(), None, False) for p, u, b in rows]


def test_archive_is_a_dictionary_frame_and_a_frame_a_record():
    rows = some()
    raw = b"".join(W.archive(rows))
    assert raw[:4] == (0x184D2A5D).to_bytes(4, "little")
    got = [W.parsed(x) for x in W.frames(io.BytesIO(raw))]
    assert [r["page_id"] for r in got] == list(range(30)) and [r["payload"] for r in got] == [r[2] for r in rows]
    small = some(1)
    assert len([*W.frames(io.BytesIO(b"".join(W.archive(small))))]) == 1
    assert b"".join(W.archive([])) == b""


def test_frames_across_small_reads(monkeypatch):
    raw = b"".join(W.archive(some()))
    monkeypatch.setattr(W, "READ_BYTES", 7)
    assert len([*W.frames(io.BytesIO(raw))]) == 30


def test_damage_is_found():
    raw = b"".join(W.archive(some()))
    size = int.from_bytes(raw[4:8], "little") + 8
    for bad in (raw[: size - 5], raw[size:], raw[:-3], b"", raw[:-10] + bytes(10)):
        with pytest.raises((ValueError, zstandard.ZstdError)):
            [W.parsed(x) for x in W.frames(io.BytesIO(bad))]
    one = W.record(*some(1)[0])
    for bad in (one[:-1], one + b"x", one.replace(b"WARC/1.1", b"WARC/0.9"), one.replace(b"Content-Length: ", b"Content-Length: x", 1), one.replace(b"<p>", b"<q>"), one.replace(b"sha1:", b"md5:"), one.replace(b"urn:page:0", b"urn:other")):
        with pytest.raises(ValueError):
            W.parsed(bad)


def test_empty_and_extra_columns(spark, table):
    assert W.read_archives(spark, W.write_archives(table([], PAGES, "pages"))).count() == 0
    docs = table([(1, "u", "x", "clash", 5)], PAGES + ", sha1 string, largest long", "pages")
    assert W.read_archives(spark, W.write_archives(docs)).count() == 1


def test_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    result = con.execute(W.ORACLE_SQL["op10_warc_zstd"])
    columns = [d[0] for d in result.description]
    assert sorted(map(repr, result.fetchall())) == sorted(repr(tuple(r)) for r in W.op10_warc_zstd(spark, path).select(*columns).collect())
