import gzip
import hashlib
import random
from collections import Counter

from tallyloom.llm import warc as W
from tallyloom.plans.scratch import scratch_path


def test_loser_tree_merges():
    draw = random.Random(4)
    for count in (0, 1, 2, 3, 7, 8, 20):
        runs = [sorted(((draw.choice("abc"), str(draw.randint(0, 3)), draw.choice([None, 1, 2]), 0, "", "", None, f"f{k}", i) for i in range(draw.randint(0, 9))), key=W.rank) for k in range(count)]
        assert list(W.LoserTree(runs)) == sorted((r for run in runs for r in run), key=W.rank)


def test_url_keys():
    assert W.url_key("http://www.A.example:80/x?y=1#f") == "example,a)/x?y=1"
    assert W.url_key("https://user@b.example:8080") == "example,b:8080)/" and W.url_key("odd#x") == "odd"


def plain(pages):
    out = Counter()
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    for i, _, html in pages:
        body = (html or "").encode()
        old = first.get(body) if i is not None else None
        again = old is not None and old != i
        out[i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", old if again else None] += 1
    return out


def result(rows):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows)


def test_round_trip_of_odd_pages(odd_pages):
    rows = W.archive_pages(odd_pages).collect()
    assert result(rows) == plain([(r.page_id, r.url, r.html) for r in odd_pages.collect()])
    assert W.archive_pages(odd_pages.limit(0)).collect() == []


def test_files_are_archives(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    W.write_archives(pages, str(tmp_path / "warc"))
    found = {}
    for file in (tmp_path / "warc").glob("part-*"):
        for _, headers, block in W.records(gzip.open(file).read()):
            if headers["WARC-Type"] == "response":
                found[W.page_name(headers["WARC-Record-ID"])] = block.partition(b"\r\n\r\n")[2].decode()
    html = {r.page_id: r.html for r in pages.collect()}
    assert all(html[i] == text for i, text in found.items()) and set(found.values()) == set(html.values())


def test_histories_are_in_global_order(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    path = scratch_path(spark, "order")
    W.write_archives(pages.repartition(6).selectExpr("page_id", "if(page_id % 3 = 0, 'http://hot.example/', url) AS url", "html"), path)
    rows = sorted(W.capture_index(spark, path).collect(), key=lambda r: (r.part, r.place))
    keys = [(r.url_key, r.capture_time, r.page_id) for r in rows]
    assert keys == sorted(keys) and len(rows) == pages.count()
    assert len({r.part for r in rows if r.url_key == "example,hot)/"}) > 1  # a URL with a third of the captures is cut
    assert result(rows) == plain([(r.page_id, r.url, r.html) for r in pages.collect()])
