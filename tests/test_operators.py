"""Keyed tables, crawls, routes, trees, images and streams."""

import io
import random
import struct
import zipfile
import zlib
from collections import deque

from pyspark.sql import functions as F

from pagewright.operators import crawl, dom, images, site, store
from pagewright.plans.session import scratch_path
from pagewright.sources import files
from pagewright.streaming import events


def test_upsert_keeps_old_values(spark):
    kind = "scan string, url string, raw string, n int, seq int"
    old = spark.createDataFrame([("s", "a", "old", 1, 0), (None, "a", "x", 1, 0)], kind)
    new = spark.createDataFrame([("s", "a", None, 2, 1), ("s", "b", "b", 3, 2), (None, "a", "y", 2, 3)], kind)
    got = {tuple(r) for r in store.upsert(old, new, ["scan", "url"], ["raw"]).collect()}
    assert got == {("s", "a", "old", 2, 1), ("s", "b", "b", 3, 2), (None, "a", "x", 1, 0), (None, "a", "y", 2, 3)}
    first = {tuple(r) for r in store.upsert(old, new, ["scan", "url"], keep_first=["n"]).where("scan = 's'").collect()}
    assert ("s", "a", None, 1, 1) in first


def plain_frontier(offers, seen, max_depth, max_pages):
    seen, out = set(seen), []
    for _, key, depth, inside in sorted(offers, key=lambda o: o[0]):
        if key is None:
            out.append("invalid_url")
        elif depth > max_depth:
            out.append("depth_exceeded")
        elif key in seen:
            out.append("duplicate")
        elif len(seen) >= max_pages:
            out.append("page_limit_reached")
        elif not inside:
            out.append("out_of_scope")
        else:
            seen.add(key)
            out.append("enqueued")
    return out


def test_frontier_equals_sequential(spark):
    rng = random.Random(3)
    for most in (1, 4, 9, 50):
        scope = {k: rng.random() < 0.8 for k in range(20)}
        offers = [(i, k := rng.choice([None, *range(20)]), rng.choice([1, 1, 3]), scope.get(k, True)) for i in range(60)]
        table = spark.createDataFrame(offers, "seq int, key int, depth int, in_scope boolean")
        seen = spark.createDataFrame([(0,), (1,)], "key int")
        got = [r["status"] for r in crawl.enqueue(table, seen, 2, most).orderBy("seq").collect()]
        assert got == plain_frontier(offers, {0, 1}, 2, most)


def test_crawl_equals_sequential(spark):
    rng = random.Random(8)
    links = [(rng.randrange(30), rng.randrange(60), i, rng.random() < 0.9) for i in range(200)]
    for most in (3, 12, 60):
        seen, queue = {0: 0}, deque([0])
        for depth in (1, 2, 3):
            for source, target, _, inside in sorted((x for x in links if seen.get(x[0]) == depth - 1), key=lambda x: (x[0], x[2])):
                if target not in seen and len(seen) < most and inside:
                    seen[target] = depth
        got = {r["key"]: r["depth"] for r in crawl.crawl(spark.createDataFrame(links, "source int, target int, seq int, in_scope boolean"), spark.createDataFrame([(0,)], "key int"), 3, most).collect()}
        assert got == seen and queue


def test_routes(spark):
    paths = [("s", p) for p in ("/", "/about", "/blog/a", "/blog/b", "/shop/1", "/shop/2", "/x/1/y", "/x/2/y")]
    table = spark.createDataFrame(paths, "site string, path string")
    got = {(r["pattern"], r["n_paths"]) for r in site.greedy_patterns(table, "site", "path").collect()}
    assert got == {("/blog/:slug", 2), ("/shop/:id", 2), ("/x/:param2/y", 2)}
    assert site.greedy_patterns(table.limit(0), "site", "path").count() == 0


def test_dom(spark):
    html = '<html><head><title>t</title></head><body><nav role="navigation"><a href="/a">A</a><a href="/b">B</a></nav><p>x <b>y</p><script>var a = "</p>";</script></body></html>'
    rows = dom.nodes(spark.createDataFrame([(1, html), (2, None)], "page_id int, html string"))
    tags = [(r["depth"], r["tag"], r["parent_id"]) for r in rows.orderBy("node_id").collect()]
    assert tags == [(0, "html", None), (1, "body", 0), (2, "nav", 1), (2, "p", 1), (3, "a", 2), (3, "a", 2), (3, "b", 3)]
    assert [tuple(r) for r in dom.sibling_groups(rows).select("tag", "n").collect()] == [("a", 2)]
    assert rows.select(dom.component_kind(F.col("tag"), F.col("role"))).where("1 = 1").collect()[2][0] == "Navigation"
    assert dom.roots(rows).count() == 1


def rgba(width, height, colour, changed=()):
    data = bytearray(bytes(colour) * (width * height))
    for x, y in changed:
        data[(y * width + x) * 4] ^= 255
    return {"width": width, "height": height, "data": bytes(data)}


def test_image_diff(spark):
    kind = "key int, a struct<width:int,height:int,data:binary>, b struct<width:int,height:int,data:binary>"
    rows = [(1, rgba(4, 4, (0, 0, 0, 255)), rgba(4, 4, (0, 0, 0, 255), [(0, 0), (3, 3)])), (2, rgba(3, 2, (9, 9, 9, 255)), rgba(2, 3, (9, 9, 9, 255))), (3, rgba(1, 1, (0, 0, 0, 0)), None), (4, rgba(2, 2, (32, 0, 0, 0)), rgba(2, 2, (0, 0, 0, 0)))]
    got = {r["key"]: (r["total"], r["mismatched"], r["similarity"], r["error"]) for r in images.rgba_diff(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: (16, 2, 87.5, None), 2: (9, 5, 44.44, None), 3: (None, None, None, "invalid_image"), 4: (4, 0, 100.0, None)}


def test_png_round_trip():
    rng = random.Random(1)
    data = rng.randbytes(5 * 3 * 4)
    assert images.decode_png(images.encode_png(5, 3, data)) == (5, 3, data)
    # every filter: lines of a known image, filtered by the format's own rules
    lines = [rng.randbytes(12) for _ in range(5)]

    def filtered(kind, line, above):
        out = bytearray()
        for i, x in enumerate(line):
            a, b, c = line[i - 3] if i > 2 else 0, above[i], above[i - 3] if i > 2 else 0
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            out.append((x - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        return bytes([kind]) + bytes(out)

    raw = b"".join(filtered(k, line, lines[k - 1] if k else bytes(12)) for k, line in enumerate(lines))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 4, 5, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    width, height, got = images.decode_png(png)
    assert (width, height) == (4, 5)
    assert b"".join(got[i : i + 3] for i in range(0, len(got), 4)) == b"".join(lines)


def test_archives(spark):
    rows = [("a", "x/1.txt", b"1"), ("a", "b.txt", b"22"), ("bad", "../x", b"")]
    packed = files.archives(spark.createDataFrame(rows, "k string, path string, content binary"), "k").cache()
    assert {r["k"]: r["reason"] for r in packed.collect()} == {"a": None, "bad": "unsafe_path"}
    entries = files.read_archive(packed.where("archive is not null"), "k").collect()
    assert [(r["path"], r["size"], r["crc"]) for r in entries] == [("b.txt", 2, zlib.crc32(b"22")), ("x/1.txt", 1, zlib.crc32(b"1"))]


def test_archives_in_volumes_hold_all_files(spark, monkeypatch):
    monkeypatch.setattr(files, "MOST_FILES", 5)
    monkeypatch.setattr(files, "MOST_BYTES", 100)
    rows = [("many", f"f/{i}.txt", b"ab") for i in range(23)] + [("large", f"{i}.bin", b"x" * 60) for i in range(4)] + [("large", "huge.bin", b"y" * 300), ("small", "a", b"1"), ("bad", "../x", b"")]
    table = spark.createDataFrame(rows, "k string, path string, content binary").repartition(3)
    assert {r["k"]: r["reason"] for r in files.archives(table, "k").collect()} == {"many": "too_many_files", "large": "too_large", "small": None, "bad": "unsafe_path"}
    packed = files.archives(table, "k", volumes=True).cache()
    assert {(r["k"], r["reason"]) for r in packed.collect()} == {("many", None), ("large", None), ("small", None), ("bad", "unsafe_path")}
    good = packed.where("archive is not null")
    got = [(r["k"], r["path"], r["size"], r["crc"]) for r in files.read_archive(good, "k").collect()]
    assert sorted(got) == sorted((k, p, len(c), zlib.crc32(c)) for k, p, c in rows if k != "bad")
    each = [(len(z.infolist()), sum(i.file_size for i in z.infolist())) for z in (zipfile.ZipFile(io.BytesIO(r["archive"])) for r in good.collect())]
    assert all(n <= 5 and (size <= 100 or n == 1) for n, size in each)


def test_stream_windows_and_dedupe(spark, sf):
    path = scratch_path(spark, "events-stream")
    rows = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id")
    rows.repartition(3).write.parquet(path)
    rows.limit(50).write.mode("append").parquet(path)  # sent twice
    counts = events.windowed_counts(events.read_events(spark, path, 10), "1 hour")
    query = counts.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    query.awaitTermination()
    got = spark.table("windows").agg(F.sum("n")).first()[0]
    assert 0 < got <= rows.count()
    whole = {(r["start"], r["event_type"]): r["n"] for r in events.windowed_counts(rows).collect()}
    assert all(whole[r["start"], r["event_type"]] == r["n"] for r in spark.table("windows").collect())
