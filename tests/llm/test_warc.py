import hashlib

from maskframe.llm import warc


def test_both_versions():
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello\nworld\n"
    for version in (1, 2):
        data = warc.arc_file_header(version, "x.arc") + warc.arc_record(version, "http://a/b", body, date="20010203040506") + warc.arc_record(version, "http://a/c", b"", kind="text/plain")
        one, two = warc.parse_arc(data)
        assert (one.version, one.fields["URL"], one.content, two.content) == (version, "http://a/b", body, b"")
        record = warc.to_warc(one, "7:1")
        back = next(warc.parse_warc(record.encode()))
        assert back.block == body and back.headers["WARC-Date"] == "2001-02-03T04:05:06Z" and back.headers["WARC-Type"] == "response"
        assert back.headers["WARC-Payload-Digest"] == "sha256:" + hashlib.sha256(b"hello\nworld\n").hexdigest()
        assert warc.to_warc(two, "7:2").headers["WARC-Type"] == "resource"
    assert [r.content for r in warc.parse_arc(data[:-20])] == [body]
    assert warc.warc_date("2001") == "2001-01-01T00:00:00Z" and warc.warc_date("junk") == "1970-01-01T00:00:00Z"


def test_rows(spark):
    long = "x" * 200
    rows = [(3, "u v", long, 1), (1, None, long, 1), (2, "u", "short", 1), (4, "u", "short", 1), (5, "u", None, 1), (6, "u", "", 1), (None, "u", long, 1), (1, "u", long, 1), (7, "u", "é" * 50, 1), (8, "u", "é" * 50, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, uid int").coalesce(1)
    got = warc.read_archives(warc.write_archives(df)).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted((str(k), len((t or "").encode()), digest(t)) for k, _, t, _ in rows)
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"]) for r in got)
    assert kinds == sorted([("3", "revisit", 1), ("1", "response", None), ("1", "revisit", 1), ("None", "revisit", 1), ("2", "response", None), ("4", "response", None), ("5", "response", None), ("6", "response", None), ("7", "response", None), ("8", "revisit", 7)], key=str)
    assert warc.read_archives(warc.write_archives(df.where("false"))).count() == 0


def test_revisits_against_sql(spark, tmp_path):
    import duckdb

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    more = pages.where("page_id % 3 = 0").selectExpr("page_id + 100000 AS page_id", "concat(url, '/again') AS url", "html")
    short = pages.selectExpr("page_id + 200000 AS page_id", "url", "substr(html, 1, 99 + cast(page_id % 3 AS int)) AS html")
    pages.unionByName(more).unionByName(more.selectExpr("page_id + 100000 + 1000000 AS page_id", "url", "html")).unionByName(short).write.parquet(str(tmp_path / "pages"))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    got = warc.read_archives(warc.write_archives(spark.read.parquet(str(tmp_path / "pages"))))
    want = c.sql(warc.ORACLE_SQL)
    assert sorted(map(str, map(tuple, got.select(*want.columns).collect()))) == sorted(map(str, want.fetchall()))
    assert got.where("record_type = 'revisit'").count() > 30


def test_files(spark, tmp_path):
    import gzip

    body = b"HTTP/1.1 200 OK\r\n\r\npage"
    arc = warc.arc_file_header(1, "a.arc") + warc.arc_record(1, "http://a/b", body) + warc.arc_record(1, "http://a/c", b"plain", kind="text/plain")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.arc").write_bytes(arc)
    (tmp_path / "in/b.arc.gz").write_bytes(gzip.compress(arc[:200]) + gzip.compress(arc[200:]))
    archives = warc.convert_files(spark, str(tmp_path / "in"))
    paths = [r["path"] for r in warc.export(archives, str(tmp_path / "out")).collect()]
    assert len(paths) == 2
    for p in paths:
        with gzip.open(p, "rb") as f:
            records = list(warc.parse_warc(f.read()))
        assert [(r.headers["WARC-Type"], r.headers["WARC-Target-URI"], r.block) for r in records] == [("response", "http://a/b", body), ("resource", "http://a/c", b"plain")]
    assert sorted(tuple(r) for r in warc.read_archives(archives).select("record_type", "payload_bytes").collect()) == [("resource", 5)] * 2 + [("response", 4)] * 2
