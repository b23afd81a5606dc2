import base64
import hashlib
import random

from mediacat.llm import registry, warc


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows, least=0):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(first.get(html or "", page), page)
    out = []
    for page, _, html in rows:
        size = len((html or "").encode())
        other = first.get(html or "")
        revisit = page is not None and size >= least and other != page
        out.append((page, size, digest(html), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def run(spark, df, block=7, **kw):
    archives = warc.write_archives(df, **kw)
    index = warc.write_index(archives, block)
    return archives, index


ROWS = [
    (5, "http://www.a.example.com/x?y=1#z", "same"), (3, "http://a.example.com/x?y=1", "same"), (9, "https://a.example.com:8443/", None), (8, None, ""), (7, "not a url\nWARC-Type: x", "é日本" * 1000),
    (None, "http://b.example.org", "same"), (3, "http://a.example.com/x?y=1", "same"), (11, "http://[::1]:80/q", "WARC/1.1\r\n\r\n"), (12, "http://é.example/日本", "h"),
]


def test_edge_rows(spark):
    df = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, digest int").repartition(3)
    for least in (0, 3):
        archives, index = run(spark, df, min_revisit_bytes=least)
        assert got(warc.lookup(index, archives, warc.keys_of(df))) == brute(ROWS, least)
    empty = df.limit(0)
    archives, index = run(spark, empty)
    assert warc.lookup(index, archives, warc.keys_of(empty)).count() == 0
    assert warc.lookup(index, archives, warc.keys_of(df)).count() == 0


def test_hot_url_and_lookups_over_many_blocks(spark):
    rng = random.Random(5)
    rows = [(i, "http://hot.example.com/" if i % 3 == 0 else f"http://h{rng.randrange(40)}.example.com/{rng.randrange(20)}", f"<p>{rng.randrange(50)}") for i in range(600)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    archives, index = run(spark, df)
    assert got(warc.lookup(index, archives, warc.keys_of(df))) == brute(rows)
    some = spark.createDataFrame([("com,example,hot)/",), ("com,example,h3)/4",), ("zz",), ("",), (None,), ("com,example,hot)/",)], "key string")
    wanted = {"http://hot.example.com/", "http://h3.example.com/4"}
    assert got(warc.lookup(index, archives, some)) == [x for x in brute(rows) if any(r[0] == x[0] and r[1] in wanted for r in rows)]
    lines = index.directory.selectExpr("sum(lines)").first()[0]
    assert lines == 600 and index.directory.where("first_key > last_key").count() == 0


def test_many_tasks_fetch(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, f"http://h{i}.example.com/", f"<p>{i}") for i in range(400)], "page_id long, url string, html string").repartition(4)
    archives, index = run(spark, df)
    tasks = warc.lookup(index, archives, warc.keys_of(df)).select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_archives_read_in_order_too(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    archives, _ = run(spark, pages)
    files = [r.file for r in archives.captures.select("file").distinct().collect()]
    kinds = [r["headers"]["warc-type"] for f in files for r in warc.read_archive(archives.folder, f)]
    assert kinds.count("warcinfo") == len(files) and len(kinds) - len(files) == pages.count()
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    assert got(registry.op10_warc(spark, sf)) == brute(rows)


def test_keys():
    assert warc.url_key("http://www.Example.com:80/a?b#c") == "com,example)/a?b"
    assert warc.url_key("https://user@m.example.net:8443") == "net,example,m:8443)/"
    assert warc.url_key(None) == warc.NO_URL and warc.url_key("a b") == "a%20b"
