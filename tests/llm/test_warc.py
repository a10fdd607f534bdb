import hashlib
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from panelrisk.llm import warc as W


@given(st.binary(max_size=300), st.integers(1, 50))
def test_chunks_round_trip(payload, size):
    assert W.unchunked(W.chunked(payload, size)) == payload


@pytest.mark.parametrize("body", [b"", b"zz\r\n", b"5\r\nabc\r\n0\r\n\r\n", b"3\r\nabc0\r\n\r\n", b"-1\r\n\r\n"])
def test_bad_chunks(body):
    with pytest.raises(ValueError):
        W.unchunked(body)


def test_chunk_extensions_and_trailers():
    assert W.unchunked(b"3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: x\r\n\r\n") == b"abc0123456789"


@given(st.binary(max_size=400), st.integers(1, 90))
def test_records_parse_back(payload, segment):
    recs = W.records("urn:page:1", "http://x/\r\ny", hashlib.sha256(payload).hexdigest(), payload, None, segment)
    back = list(W.parse(b"".join(r + b"\r\n\r\n" for r in recs)))
    assert len(back) == len(recs) and back[0]["kind"] == "response" and back[0]["uri"] == "http://x/ y"
    block = b"".join(r["block"] for r in back)
    assert W.opened(block, back[0]["digest"]) == (payload, None)
    if len(back) > 1:
        assert [r["segment"] for r in back] == list(range(1, len(back) + 1)) and back[-1]["total"] == len(block)


def test_broken_archives():
    good = W.records("urn:page:1", "u", "d", b"abc", None)[0]
    for bad in (b"nonsense", good[:40], good[:-1]):
        with pytest.raises(ValueError):
            list(W.parse(bad))


def rows_of():
    rng = random.Random(6)
    same, big = "same page " * 30, "".join(rng.choice("abé\r\n\r\nWARC/1.1 0") for _ in range(30_000))
    return [(1, "http://a/1", same), (2, "http://a/2", same), (3, None, None), (4, "http://a/4", ""), (5, "http://b/5", big),
            (6, "http://b/6", big), (7, "http://c/7", "short"), (8, "http://c/8", "short"), (9, "http://d/9", "x" * 99),
            (10, "http://d/10", "x" * 99), (11, "http://d/11", "x" * 100), (12, "http://d/12", "x" * 100), (13, "u\r\nv: w", "WARC/1.1\r\n" * 20)]


@pytest.mark.parametrize("segment,per_file", [(16_384, 2_000), (50, 3)])
def test_round_trip(spark, tmp_path, segment, per_file):
    pages = spark.createDataFrame(rows_of(), "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as key", "3 as id")
    path = str(tmp_path / "warc")
    W.write_archives(pages, path, segment_bytes=segment, file_records=per_file)
    out = {int(r["record_id"][9:]): r for r in W.read_archives(spark, path).collect()}
    assert len(out) == len(rows_of())
    refers = {2: 1, 6: 5, 12: 11}
    for i, url, html in rows_of():
        r = out[i]
        assert r["error"] is None
        assert r["digest"] == hashlib.sha256((html or "").encode()).hexdigest()
        assert r["uri"] == (None if url is None else url.replace("\r\n", " "))
        if i in refers:
            assert (r["kind"], r["refers_to"], r["payload"]) == ("revisit", f"urn:page:{refers[i]}", None)
        else:
            assert (r["kind"], r["refers_to"], bytes(r["payload"])) == ("response", None, (html or "").encode())
    W.write_archives(pages.filter("false"), path + "-none")
    assert W.read_archives(spark, path + "-none").collect() == []


def test_missing_and_wrong_segments(spark):
    payload = b"0123456789" * 30
    recs = list(W.parse(b"".join(r + b"\r\n\r\n" for r in W.records("o", "u", hashlib.sha256(payload).hexdigest(), payload, None, 100))))
    seg = [{k: W._segment(r)[k] for k in W._SEGMENT.names} for r in recs]

    def run(rows):
        frame = spark.createDataFrame([tuple(r[k] for k in W._SEGMENT.names) for r in rows], W._SEGMENT)
        r = W.payloads(W.reassemble(frame)).collect()[0]
        return r["payload"] and bytes(r["payload"]), r["error"]

    assert run(seg[::-1]) == (payload, None)
    assert run(seg[:1] + seg[2:]) == (None, "segments")
    assert run(seg[1:]) == (None, "segments")
    assert run(seg[:-1]) == (None, "segments")
    assert run(seg + seg[1:2]) == (None, "segments")
    assert run([*seg[:-1], {**seg[-1], "total": 7}]) == (None, "length")
    assert run([{**seg[0], "digest": "0"}, *seg[1:]]) == (None, "digest")


def test_repeated_and_null_ids_with_long_pages(spark, tmp_path):
    long = ["".join(random.Random(s).choice("abc d") for _ in range(40_000)) for s in range(4)]
    rows = ([(1, "u", long[0])] * 3 + [(1, "u", long[1]), (1, "v", "short")] + [(2, "u", long[0]), (3, "u", long[1]), (3, "u", long[1])]
            + [(None, "u", long[2])] * 2 + [(None, "w", long[3]), (None, None, long[0]), (None, None, None), (4, "u", long[2])])
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3).write.parquet(path)
    W.write_archives(spark.read.parquet(path), str(tmp_path / "warc"))
    back = W.read_archives(spark, str(tmp_path / "warc")).collect()
    assert len(back) == len(rows) == len({r["record_id"] for r in back}) and not any(r["error"] for r in back)
    responses = {r["record_id"]: r for r in back if r["kind"] == "response"}
    assert all(responses[r["refers_to"]]["digest"] == r["digest"] for r in back if r["kind"] == "revisit")
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {sha(t): min(i for i, _, u in rows if i is not None and u == t) for t in long[:3]}
    want = []
    for i, _, t in rows:
        to = first.get(sha(t))
        again = to is not None and to != i
        want.append((i, len(t or ""), sha(t), "revisit" if again else "response", to if again else None))
    got = [tuple(r) for r in W.op8_warc(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_rows_without_id_revisit_the_smallest(spark, tmp_path):
    long, other = "x" * 200, "y" * 150
    rows = [(1, "u", long), (None, "u", long), (2, "u", long), (None, "v", other), (None, "v", other), (None, "w", "short"), (3, "w", "short"),
            (None, "z", "z" * 120), (7, "z", "z" * 120)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in W.op8_warc(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted([(1, 200, "response", None), (None, 200, "revisit", 1), (2, 200, "revisit", 1), (None, 150, "response", None),
                          (None, 150, "response", None), (None, 5, "response", None), (3, 5, "response", None), (7, 120, "response", None),
                          (None, 120, "revisit", 7)], key=str)
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, payload_bytes, record_type, refers_to FROM ({W.ORACLE['op8_warc']})").fetchall()
    assert sorted(want, key=str) == got
