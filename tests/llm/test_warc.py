import gzip
import hashlib

from pyspark.sql import functions as F

from keelson.llm import queries, warc

PAGES = "page_id long, url string, html string"


def test_odd_pages(spark, tables):
    big = "é" * 600
    pages = [(1, "http://a.b/x", big), (2, "http://a.b/x", big), (3, None, big), (4, "http://c.d", "small"), (5, "http://c.d", "small"), (6, "", None), (7, "x\r\ny://z", ""), (None, "http://a.b/", big), (3, None, big), (8, "http://l", "y" * 3_000_000)]
    rows = queries.op4_warc_index(spark, tables(pages=(pages, PAGES))).collect()
    got = sorted(((r.page_id is None, r.page_id or 0), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)
    want = []
    for p, _, h in pages:
        raw = (h or "").encode()
        same = [q for q, _, x in pages if x == h]
        top = max(q for q in same if q is not None)
        again = len(raw) >= 1000 and p != top
        want.append(((p is None, p or 0), len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=lambda x: x[:4])
    assert queries.op4_warc_index(spark, tables(pages=([], PAGES))).collect() == []


def test_many_blocks_one_url_and_whole_files(spark, tmp_path):
    pages = spark.range(500).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 > 0, "http://www.Example.com/a?b#c").otherwise(F.concat(F.lit("http://h"), F.col("id").cast("string"))).alias("url"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("html"))
    archive = warc.write_archive(pages.repartition(3), block_lines=7)
    assert len(archive.directory.places) > 60
    keys = pages.select(warc.surt_key(F.col("url")).alias("surt"), "page_id")
    got = {(r.page_id, bytes(r.payload)) for r in archive.read(archive.lookup(keys)).collect()}
    assert got == {(i, b"p%d" % i) for i in range(500)}
    assert archive.lookup(spark.createDataFrame([("no,such)", 1)], "surt string, page_id long")).count() == 0
    fs, top = warc.file_system(f"{archive.folder}/warc")
    import pyarrow.fs as pafs

    found = [f.path for f in fs.get_file_info(pafs.FileSelector(top)) if f.size]
    text = b"".join(gzip.decompress(fs.open_input_file(p).read()) for p in found)
    assert text.count(b"WARC/1.1\r\n") == 500


def test_keys(spark):
    one = lambda u: spark.range(1).select(warc.surt_key(F.lit(u))).first()[0]
    assert one("https://WWW.Example.com/A/b?q=1#x") == "com,example,www)/A/b?q=1"
    assert one("http://h") == "h)" and one("") == ""
