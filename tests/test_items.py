"""Names, addresses, order, ledger and files against plain Python."""

import csv
import glob
import random
import re
from contextlib import contextmanager
from urllib.parse import urljoin

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixelmill.functions import filters as FL, paths as P, urls as U
from pixelmill.operators import catalog as C, ledger as L, markup as M, names as N, ordering as O, skew as K
from pixelmill.sources import files as SF, sinks as SK
from tests_util import png


def column(df, c):
    return [r[0] for r in df.select(c).collect()]


def test_natural_order(spark):
    names = ["img2", "img10", "IMG1", "007", "7", "9" * 40, "img", "img0", "a1b2", "a1b10", "", "x-1", "x 1"]
    key = lambda s: [int(t) if t.isdigit() else t.lower() for t in re.split(r"(\d+)", s)]
    df = spark.createDataFrame([(n,) for n in names], "path string")
    want = sorted(names, key=lambda s: (key(s), s))
    assert [r.path for r in O.natural_sort(df).collect()] == want
    ranked = O.global_rank(df).collect()
    assert {r.path: r.rank for r in ranked} == {n: i for i, n in enumerate(want)}
    assert {r.path for r in O.resume_from(df, 5).collect()} == set(want[5:])


def test_resolve_like_the_standard_library(spark):
    bases = ["http://h.example/a/b/c", "https://h.example/a/b/", "http://h.example", "http://h.example/x?q=1#f",
             "https://u@h.example:81/d/e.html?z=/y"]
    refs = ["p", "/p", "//o.example/p", "?q", "#f", "", ".", "..", "./", "../", "../../../g", "a//b", "/a//b/../c",
            "g;x=1/../y", "http:g", "https://o.example/a/../b", "mailto:a@b", "data:image/png;base64,AA", "g?y/./x",
            "./g/.", "a/./b/../c/..", "/./g", "%20x", "HTTP://o.example/p"]
    df = spark.createDataFrame([(b, r) for b in bases for r in refs], "b string, r string")
    for row in df.select("b", "r", U.resolve_url(F.col("b"), F.col("r")).alias("u")).collect():
        assert row.u.lower() == urljoin(row.b, row.r).lower(), (row.b, row.r)


def test_two_decimals_like_python(spark):
    rng = random.Random(1)
    values = [0.125, 0.375, 1.005, 2.675, 201 / 200, 0.0, 5.0] + [rng.randint(1, 3000) / rng.randint(1, 3000) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert column(df, FL.two_decimals(F.col("v"))) == [f"{v:.2f}" for v in values]


def test_stem_and_suffix(spark):
    import pathlib

    names = ["/a/b.png", "/a/.hidden", "/a/x.tar.gz", "/a/noext", "/a/dot.", "/a.b/c"]
    df = spark.createDataFrame([(n,) for n in names], "p string")
    for p, s in zip(names, column(df, P.stem(F.col("p")))):
        assert s == pathlib.PurePosixPath(p).stem or p.endswith(".")


def slow_names(requests, files):
    """One request after the other; plain names of the batch are reserved."""
    reserved, used, out = {b for _, b in requests}, set(files), {}
    for k, base in sorted(requests):
        name, n = base, 1
        while name in used or (n > 1 and name in reserved):
            n += 1
            name = f"{base}_{n:03d}"
        used.add(name)
        out[k] = name
    return out


def test_unique_names_like_the_loop(spark):
    rng = random.Random(3)
    requests = [(i, rng.choice(["hot", "hot", "hot", "a", "b", "a_002", "c"])) for i in range(3000)]
    files = ["hot", "hot_003", "hot_1000", "hot_0005", "b_002", "a"] + [f"c_{n:03d}" for n in range(2, 300, 3)]
    planned = spark.createDataFrame([(i, "/d", b, ".png") for i, b in requests], "i long, dir string, base string, ext string")
    there = spark.createDataFrame([("/d", f + ".png") for f in files], "dir string, name string")
    want = slow_names(requests, files)
    for parts in (1, 3, 16):
        with shuffles(spark, parts):
            assert {r.i: r.name for r in N.unique_names(planned, there, ["i"]).collect()} == {k: v + ".png" for k, v in want.items()}


def test_unique_names_meet_in_blocks(spark, monkeypatch):
    """Names with more requests than a block has, numbers far apart, beyond all requests, and blocks without any."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "WIDE", 64)
    requests = [(i, b) for i, b in enumerate(["few"] * 3 + ["gap"] * 150 + ["none"] * 40 + ["all"] * 30 + ["gap_007"] * 2 + ["there"] * 20)]
    files = ["gap_002", "gap_003", "gap_060", "gap_061", "gap_120", "gap_99999", "few_123456789012345", "there", "there_010", "unasked_005"] + [f"all_{n:03d}" for n in range(2, 90)]
    planned = spark.createDataFrame([(i, "/d", b, ".png") for i, b in requests], "i long, dir string, base string, ext string")
    there = spark.createDataFrame([("/d", f + ".png") for f in files], "dir string, name string")
    named = N.unique_names(planned, there, ["i"])
    assert named.columns == ["i", "dir", "base", "ext", "name"]
    assert {r.i: r.name for r in named.collect()} == {k: v + ".png" for k, v in slow_names(requests, files).items()}


@contextmanager
def shuffles(spark, parts):
    """More parts than rows of a key, fewer, and one."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_ordered_scans_equal_a_loop(spark, parts):
    """Also for a key that is null or holds a third of the rows, null and equal times, runs over several parts."""
    rng = random.Random(parts)
    rows = [(rng.choice([None, None, "hot", "hot", "a", "b", float("nan")]), rng.choice([None, *range(30)]), i, rng.choice(["x", "x", "x", "y", None]) if i > 600 else "x", rng.choice([None, 1, 2])) for i in range(900)]
    rows = [(None if k is None else str(k), *rest) for k, *rest in rows]
    df = spark.createDataFrame(rows, "k string, t int, i long, s string, n int").repartition(3)
    want, last = {}, {}
    for k, t, i, s, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] or 0, r[2])):
        total, rank, run, before = last.get(k, (None, -1, 0, None))
        run += rank < 0 or before != s
        total = total if n is None else (total or 0) + n
        want[i] = (total, rank + 1, run, before)
        last[k] = (total, rank + 1, run, s)
    with shuffles(spark, parts):
        out = K.ordered(df, ["k"], ["t", "i"], sums={"total": F.col("n"), "rank": F.lit(1)}, previous={"before": "s"}, runs={"run": "s"}).collect()
        ranks = {r.i: r["rank"] for r in K.rank_within(df, ["k"], ["t", "i"]).collect()}
    assert {r.i: (r.total, r["rank"] - 1, r.run, r.before) for r in out} == want
    assert ranks == {i: w[1] for i, w in want.items()} and set(out[0].asDict()) == {"k", "t", "i", "s", "n", "total", "rank", "run", "before"}


def test_keys_that_are_not_a_number(spark):
    df = spark.createDataFrame([(float("nan"), i) for i in range(200)] + [(None, i) for i in range(50)], "k double, i long")
    with shuffles(spark, 7):
        assert sorted(r["rank"] for r in K.rank_within(df, ["k"], ["i"]).collect()) == sorted([*range(200), *range(50)])
        assert K.rank_within(df.limit(0), ["k"], ["i"]).collect() == []


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_global_rank_in_any_number_of_parts(spark, parts):
    df = spark.range(3000).select(F.concat(F.lit("img"), (F.col("id") * 7919 % 30011).cast("string")).alias("path"))
    want = {f"img{n}": i for i, n in enumerate(sorted(k * 7919 % 30011 for k in range(3000)))}
    with shuffles(spark, parts):
        assert {r.path: r["rank"] for r in O.global_rank(df).collect()} == want
        text = O.global_rank(df)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in text and text.count("Scan") <= 1
        assert parts == 1 or ("SinglePartition" not in text and re.search(rf"rangepartitioning\(.*, {parts}\)", text))


@pytest.mark.parametrize("parts,alpha", [(1, 0.3), (6, 0.3), (40, 0.05), (6, 0.01), (6, 0.999)])
def test_moving_average_is_the_recursion(spark, parts, alpha):
    rng = random.Random(5)
    xs = [(rng.choice(["r", "r", None, *"abcdefg"]), i, rng.choice([0.0, -1.0, None, rng.random() * 10**rng.randrange(9)]) if i > 400 else rng.random()) for i in range(2500)]
    e, want = {}, {}
    for k, i, x in xs:
        if x is not None and x > 0:
            e[k] = want[i] = x if k not in e else (1 - alpha) * e[k] + alpha * x
    df = spark.createDataFrame(xs, "k string, i long, x double").repartition(5)
    with shuffles(spark, parts):
        got = {r.i: r.ema for r in L.ema(df, ["k"], ["i"], "x", alpha).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] / want[i] - 1) for i in want) < 1e-11


def test_linear_scan_of_any_length():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 20_000):
        for keep in (0.999, 0.7, 0.001):
            x, y, want = rng.random(n) * 10.0 ** rng.integers(-6, 6, n), 0.0, []
            for v in x.tolist():
                y = keep * y + v
                want.append(y)
            assert np.allclose(L.linear_scan(x, keep), want, rtol=1e-12, atol=0)
            starts = np.unique(np.append(0, rng.integers(0, max(n, 1), 30))) if n else np.zeros(0, int)
            parts = [L.linear_scan(x[a:b], keep) for a, b in zip(starts, np.append(starts[1:], n))]
            assert np.allclose(L.segment_scan(x, starts, keep), np.concatenate(parts) if parts else x, rtol=1e-12, atol=0)


def test_resume_after_any_prefix(spark):
    items = spark.createDataFrame([(f"/{i}", "m") for i in range(20)], "path string, model string")
    for n in (0, 7, 20):
        ledger = items.limit(n).select(F.col("path").alias("input_path"), "model", F.lit("done").alias("status"))
        assert L.resume(items, ledger).count() == 20 - n


def test_files(spark, tmp_path):
    sub = tmp_path / "in" / "sub"
    sub.mkdir(parents=True)
    rng = np.random.default_rng(2)
    pics = {"a.png": rng.integers(0, 256, (4, 6, 3), np.uint8), "b.png": rng.integers(0, 256, (5, 3, 4), np.uint8)}
    for name, pic in pics.items():
        png(tmp_path / "in" / name, pic)
    png(sub / "c.PNG", rng.integers(0, 256, (2, 2, 1), np.uint8))
    (tmp_path / "in" / "note.txt").write_text("x")
    found = SF.scan_assets(spark, [str(tmp_path / "in")])
    assert {(r.stem, r.ext) for r in found.collect()} == {("a", "png"), ("b", "png"), ("c", "PNG")}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    assert SF.scan_assets(spark, [str(tmp_path / "in")], recursive=False).count() == 2
    heads = SF.image_headers(spark.read.format("binaryFile").load(str(tmp_path / "in" / "*.png"))).collect()
    assert sorted((r.width, r.height) for r in heads) == [(3, 5), (6, 4)]

    rasters, facts = SF.load_rasters(spark, str(tmp_path / "in"))
    ids = {r.path.rsplit("/", 1)[1]: (r.image_id, r.w, r.h) for r in facts.collect()}
    cells = {(r.image_id, r.c, r.y): r.v for r in rasters.collect()}
    for name, pic in pics.items():
        i, w, h = ids[name]
        assert (h, w) == pic.shape[:2]
        for c in range(pic.shape[2]):
            for y in range(h):
                assert np.allclose(cells[i, c, y], pic[y, :, c] / 255)
    SK.write_rasters(rasters, str(tmp_path / "out"), buckets=4)
    assert SK.read_rasters(spark, str(tmp_path / "out")).count() == rasters.count()


def test_log_csv(spark, tmp_path):
    texts = ['plain', 'with "quotes"', "comma, here"]
    df = spark.createDataFrame([(t,) for t in texts], "entry string").coalesce(1)
    SK.export_log_csv(df, str(tmp_path / "log"))
    raw = open(glob.glob(str(tmp_path / "log" / "*.csv"))[0], encoding="utf-8").read()
    assert '"with ""quotes"""' in raw
    rows = list(csv.reader(raw.splitlines()))
    assert rows[0] == ["Entry"] and [r[0] for r in rows[1:]] == texts


def test_skipped_and_kept_are_all(views):
    from pixelmill.plans.batch import plan_items, skipped_entries

    rules = FL.SkipRules(skip_existing=True, size_limits=True, min_width=500)
    items = plan_items(views.assets(), views.outputs(), rules, mode="folder", root=F.col("root"))
    skipped, kept = skipped_entries(items, 1, "m").count(), items.where("reason IS NULL").count()
    assert skipped + kept == views.assets().count() and skipped > 0 and kept > 0
    assert C.filter_extension(views.assets()).count() < views.assets().count()


def header_files():
    """(name, bytes, size): the smallest headers of each format, and damaged ones."""
    be, le = (lambda n, k: n.to_bytes(k, "big")), (lambda n, k: n.to_bytes(k, "little"))
    segment = lambda marker, body: bytes([0xFF, marker]) + be(len(body) + 2, 2) + body
    jpeg = b"\xff\xd8" + b"".join(segment(0xE2, b"x" * 60_000) for _ in range(70)) + b"\xff\xff" + segment(0xC4, b"y" * 9)
    jpeg += segment(0xC2, b"\x08" + be(777, 2) + be(1234, 2) + b"\x03")
    entry = lambda order, tag, kind, value: order(tag, 2) + order(kind, 2) + order(1, 4) + (order(value, 2) + b"\0\0" if kind == 3 else order(value, 4))
    tiff = lambda mark, order: mark + order(8, 4) + order(3, 2) + entry(order, 255, 4, 0) + entry(order, 256, 3, 640) + entry(order, 257, 4, 70_000)
    riff = lambda kind, body: b"RIFF" + le(100, 4) + b"WEBP" + kind + le(len(body), 4) + body
    return [
        ("j", jpeg, (1234, 777)), ("t", tiff(b"II*\0", le), (640, 70_000)), ("u", tiff(b"MM\0*", be), (640, 70_000)),
        ("v", riff(b"VP8 ", b"\0\0\0\x9d\x01\x2a" + le(300 | 0x4000, 2) + le(200, 2)), (300, 200)),
        ("l", riff(b"VP8L", b"\x2f" + le(4999 | 1999 << 14, 4)), (5000, 2000)),
        ("x", riff(b"VP8X", b"\0\0\0\0" + le(69_999, 3) + le(11, 3)), (70_000, 12)),
        ("g", b"GIF89a" + le(9, 2) + le(8, 2), (9, 8)), ("b", b"BM" + b"\0" * 16 + le(5, 4) + (-6).to_bytes(4, "little", signed=True), (5, 6)),
        ("cut", jpeg[:5000], (None, None)), ("none", b"text", (None, None)), ("empty", b"", (None, None)), ("null", None, (None, None)),
    ]


def test_headers_of_all_formats(spark):
    cases = header_files()
    df = spark.createDataFrame([(n, bytearray(b) if b is not None else None) for n, b, _ in cases], "path string, content binary")
    assert {r.path: (r.width, r.height) for r in SF.image_headers(df).collect()} == {n: s for n, _, s in cases}


def test_files_that_cannot_be_decoded_are_rows(spark, tmp_path):
    png(tmp_path / "good.png", np.zeros((2, 3, 3), np.uint8))
    (tmp_path / "bad.png").write_bytes(b"\x89PNG no picture")
    rasters, facts = SF.load_rasters(spark, str(tmp_path))
    found = {r.path.rsplit("/", 1)[1]: (r.w, r.h, r.status, r.reason) for r in facts.collect()}
    assert found == {"good.png": (3, 2, "done", None), "bad.png": (None, None, "failed", "cannot be decoded")}
    assert rasters.select("image_id").distinct().count() == 1


def test_writers_spread_with_the_pictures(spark, tmp_path):
    """Distinct keys of the shuffle before the write grow with the pictures."""
    rows = spark.range(300).select(F.col("id").alias("image_id"), F.lit(0).alias("c"), F.lit(0).alias("y"), F.lit(1).alias("h"), F.array(F.lit(0.5)).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        SK.write_rasters(rows, str(tmp_path / "out"), buckets=2)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(glob.glob(str(tmp_path / "out" / "bucket=0" / "*.parquet"))) > 30
    assert SK.read_rasters(spark, str(tmp_path / "out")).count() == 300


def html_of(spark, f, texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "html string").select(f(F.col("html"))).collect()]


def images(html):
    return [attrs for phase, _, _, _, attrs in M.read_page(html.encode()) if phase == M.IMAGE]


@pytest.mark.parametrize("html,want", [
    ('<img src="a.png" alt="5" tall"><img src="b.png">', [{"src": "a.png", "alt": "5", 'tall"': ""}, {"src": "b.png"}]),
    ("<img alt=it's src=c.png><p>", [{"alt": "it's", "src": "c.png"}]),
    ("<imgx src=a><img/><img src=a/>", [{}, {"src": "a/"}]),
    ('<img alt="x > y" src=z>', [{"alt": "x > y", "src": "z"}]),
    ("<img A=1 b = 'x y' a=2 c d=><IMG ÄÖ=é>", [{"a": "1", "b": "x y", "c": "", "d": ""}, {"äö": "é"}]),
    ('<a title="<img src=no>"><img src="&lt;&amp;lt;">', [{"src": "<&lt;"}]),
    ('<img alt="never closed><img src=a>', []), ("<img " + "word " * 200_000, []), ("", []), ("< img src=a><<img src=b>", [{"src": "b"}]),
    ("<script>'<img src=a>'</script ><img src=b><style><img></style><!-- <img> --><img src=c>", [{"src": "b"}, {"src": "c"}]),
    ("<img src=a><script>b<img src=x>", [{"src": "a"}]), ("<img src=a><!-- b<img src=x>", [{"src": "a"}]), ("<style>b<img>", []),
    ("<scripty><img src=a></scripty>", [{"src": "a"}]),
])
def test_start_tags_follow_attribute_syntax(html, want):
    assert images(html) == want


def test_pictures_sources_and_backgrounds_are_counted_in_order():
    html = ("<source src=a><picture><source src=b><img src=i><source src=c></picture ><source src=d>"
            "<div style='background:url(x)'><picture><picture><source src=e></picture><source src=f><picture><source src=g><p><source src=h>")
    got = [(phase, pos, sub, inside, attrs.get("src", attrs.get("style"))) for phase, pos, sub, inside, attrs in M.read_page(html.encode())]
    assert got == [(2, 0, 0, False, "a"), (2, 1, 0, True, "b"), (1, 0, 0, True, "i"), (2, 1, 1, True, "c"), (2, 2, 0, False, "d"),
                   (3, 0, 0, True, "background:url(x)"), (2, 3, 0, True, "e"), (2, 4, 0, False, "f"), (2, 5, 0, True, "g"), (2, 5, 1, True, "h")]


def test_elements_of_a_table_of_pages(spark):
    pages = spark.createDataFrame([("p", "u", "<img src=1>", 9), (None, None, "<img src=2><img>", 9), ("q", "v", None, 9), ("r", "w", "", 9)], "page_id string, url string, html string, phase int")
    rows = sorted((tuple(r) for r in M.elements(pages).collect()), key=str)
    assert rows == sorted([("p", "u", 1, 0, 0, True, {"src": "1"}), (None, None, 1, 0, 0, True, {"src": "2"}), (None, None, 1, 1, 0, True, {})], key=str)
    assert M.elements(pages.limit(0)).collect() == []


@pytest.mark.parametrize("unit", ["<script ", "<picture ", "<!-- ", "<img '", "<img a=", "<", "</script ", "<style></style", "<a b c d e ", "<p/ / / "])
def test_reading_time_grows_with_the_page(unit):
    from time import perf_counter

    def seconds(n):
        start = perf_counter()
        list(M.read_page(unit.encode() * n))
        return perf_counter() - start

    assert seconds(160_000) < 16 * seconds(40_000) + 0.5


def test_background_addresses(spark):
    from pixelmill.functions import html as H

    styles = ["background: #fff url( 'a b.png' ) no-repeat; x", "background-image:url(x.png)", 'color:red; background-image: url("q.jpg")', "background:red", "background: url(data:image/png;base64,AA)"]
    assert html_of(spark, H.background_url, styles) == ["a b.png", "x.png", "q.jpg", None, None]


@pytest.mark.parametrize("mode", ["suffix", "substring"])
def test_domains_like_a_loop(spark, mode):
    from pixelmill.operators import pages as PG

    rng = random.Random(7)
    part = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(1, 5)))
    hosts = [".".join(part() for _ in range(rng.randrange(1, 5))) for _ in range(80)] + ["hot.example.com"] * 40
    urls = [(i, f"https://u@{h.upper() if i % 3 else h}:80/x") for i, h in enumerate(hosts)] + [(900, None), (901, "mailto:x@y"), (902, "https:///x")]
    rules = [".".join(part() for _ in range(rng.randrange(1, 3))) for _ in range(40)] + ["..example.com", "com", "a", "bc", "", ".", "nowhere.org", "EXAMPLE.com", None]
    clean = {r.lower().lstrip(".") for r in rules if r} - {""}
    fits = lambda h, d: d in h if mode == "substring" else h == d or h.endswith("." + d)
    want = sorted((i, d) for i, h in enumerate(hosts) for d in clean if fits(h, d))
    df = PG.match_domains(spark.createDataFrame(urls, "i long, url string"), spark.createDataFrame([(r,) for r in rules], "domain string"), mode)
    assert sorted((r.i, r.domain) for r in df.collect()) == want and len(want) > 50 and df.columns == ["i", "url", "domain"]
