"""Image-corpus views over the given tables, by integer arithmetic and concatenation.

The same rules are written as SQL in `oracle.VIEWS`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pixelmill.functions.paths import output_path
from pixelmill.functions.pixels import clamp

EXTENSIONS = ("png", "jpg", "JPEG", "webp", "bmp", "tiff", "tif", "gif", "txt", "PNG")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def assets(self) -> DataFrame:
        d, i = self.table("documents"), F.col("doc_id")
        known = lambda c: F.when(i % 97 != 0, c)
        folder = F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), F.col("lang"))
        return d.select(
            "doc_id", F.lit("/corpus").alias("root"), folder.alias("dir"),
            F.concat(F.lit("doc"), i.cast("string")).alias("stem"),
            F.get(F.array(*[F.lit(e) for e in EXTENSIONS]), (i % 10).cast("int")).alias("ext"),
            known(F.col("n_chars") * 10).alias("size_bytes"),
            (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=i.cast("int"))).alias("mtime"),
            known((F.lit(64) + F.col("n_chars") * 7 % 2000).cast("int")).alias("width"),
            known((F.lit(64) + F.col("n_chars") * 13 % 2000).cast("int")).alias("height"),
        ).withColumn("path", F.concat("dir", F.lit("/"), "stem", F.lit("."), "ext"))

    def outputs(self) -> DataFrame:
        """Outputs there already: those of labelled documents, older, equal or newer."""
        out = output_path(F.col("path"), "folder", root=F.col("root"))
        shift = F.when(F.col("quality") == 1, 60).when(F.col("toxic") == 1, 0).otherwise(-60)
        return self.assets().join(self.table("labels"), "doc_id").select(
            out.alias("output_path"),
            (F.col("mtime") + F.make_dt_interval(secs=shift.cast("decimal(18,6)"))).alias("mtime"),
        )

    def collide(self) -> DataFrame:
        li = self.table("lineitem")
        return li.select(
            F.lit("/out").alias("dir"),
            F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("base"),
            F.lit(".png").alias("ext"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        )

    def images(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("image_id"),
            (F.col("o_custkey") % 3000 + 1).cast("int").alias("w"),
            (F.col("o_orderkey") * 31 % 3000 + 1).cast("int").alias("h"),
        )

    def _unit(self) -> DataFrame:
        unit = F.transform("embedding", lambda e: clamp((e.cast("double") + 1.0) / 2.0, 0.0, 1.0))
        return self.table("embeddings").select("vec_id", unit.alias("u"))

    def _square(self, image_id: Column, c: Column) -> DataFrame:
        rows = self._unit().select(image_id.alias("image_id"), c.alias("c"), "u", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("y"))
        return rows.select("image_id", "c", "y", F.lit(8).alias("h"), F.slice("u", F.col("y") * 8 + 1, F.lit(8)).alias("v"))

    def rasters(self) -> DataFrame:
        """Grey 8x8 pictures, one per vector."""
        return self._square(F.col("vec_id"), F.lit(0))

    def rgba(self) -> DataFrame:
        """8x8 pictures with four channels, four vectors each."""
        return self._square(F.floor(F.col("vec_id") / 4), (F.col("vec_id") % 4).cast("int"))

    def tall(self) -> DataFrame:
        """Grey 64x100 pictures, one vector per picture row."""
        return self._unit().select(
            F.floor(F.col("vec_id") / 100).alias("image_id"), F.lit(0).alias("c"),
            (F.col("vec_id") % 100).cast("int").alias("y"), F.lit(100).alias("h"), F.col("u").alias("v"),
        )

    def frames(self) -> DataFrame:
        """User streams as animations; numbered by time, see `operators.skew`."""
        from pixelmill.operators.skew import rank_within

        ev = self.table("events").select(
            F.col("user_id").alias("anim_id"), "ts", "event_id", F.col("event_type").alias("sig"),
            F.floor(F.col("value") * 10).cast("int").alias("duration_ms"),
        )
        return rank_within(ev, ["anim_id"], ["ts", "event_id"], "frame_no").select(
            "anim_id", "frame_no", "duration_ms", "sig"
        )

    def header_files(self) -> DataFrame:
        """The first bytes of a file of each format, with the size of an asset; no bytes without a size."""
        byte = lambda n, k: F.lpad(F.hex(F.floor(n / 256**k) % 256), 2, "0")
        little = lambda n, size: F.concat(*[byte(n, k) for k in range(size)])
        big = lambda n, size: F.concat(*[byte(n, k) for k in reversed(range(size))])
        w, h = F.col("width"), F.col("height")
        kinds = (
            ("89504E470D0A1A0A0000000D49484452", big(w, 4), big(h, 4)),
            ("474946383961", little(w, 2), little(h, 2)),
            ("424D" + "00" * 16, little(w, 4), little(h, 4)),
            ("FFD8FFE000040000FFC0001108", big(h, 2), big(w, 2)),
            ("524946460000000057454250" + "565038580A00000000000000", little(w - 1, 3), little(h - 1, 3)),
            ("49492A000800000002000001030001000000", little(w, 2), F.concat(F.lit("00000101030001000000"), little(h, 2), F.lit("0000"))),
        )
        start = F.lit(None).cast("string")
        for k, (head, a, b) in enumerate(kinds):
            start = F.when(F.col("doc_id") % 6 == k, F.concat(F.lit(head), a, b)).otherwise(start)
        return self.assets().select("path", F.unhex(start).alias("content"))

    def ledger(self) -> DataFrame:
        kind = F.col("event_type")
        return self.table("events").select(
            (F.col("user_id") % 10).alias("run_id"),
            F.concat(F.lit("/in/"), F.col("event_id").cast("string"), F.lit(".png")).alias("input_path"),
            F.concat(F.lit("/out/"), F.col("event_id").cast("string"), F.lit("_up.png")).alias("output_path"),
            F.concat(F.lit("m"), (F.col("user_id") % 3).cast("string")).alias("model"),
            F.when(kind == "error", "failed").when(kind == "signup", "skipped").otherwise("done").alias("status"),
            F.when(kind == "signup", "output exists").alias("reason"),
            F.col("value").alias("elapsed_s"), F.col("ts").cast("timestamp").alias("ts"),
        )

    def models(self) -> DataFrame:
        n = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
        factor = F.pow(F.lit(2), F.col("p_size") % 4).cast("int").cast("string")
        shape = F.col("p_partkey") % 5
        name = (
            F.when(shape == 0, F.concat(n, F.lit("_"), factor, F.lit("x.onnx")))
            .when(shape == 1, F.concat(F.lit("x2048_"), n, F.lit(".onnx")))
            .when(shape == 2, F.concat(n, F.lit(".onnx")))
            .when(shape == 3, F.concat(n, F.lit("-8X.onnx")))
            .otherwise(F.concat(factor, F.lit("x_"), n, F.lit(".onnx")))
        )
        return self.table("part").select(
            F.col("p_partkey").alias("pos"), F.concat(F.lit("/models/"), name).alias("path"), name.alias("name"),
            "p_size",
        )

    def devices(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("device_id"), (F.col("c_custkey") % 24).cast("double").alias("mem_gb")
        )

    def rois(self) -> DataFrame:
        i = F.col("vec_id")
        place, size = (i % 11 - 2).cast("int"), (i % 12 + 1).cast("int")
        return self.table("embeddings").select(
            i.alias("image_id"), place.alias("x"), place.alias("y"), size.alias("w"), size.alias("h")
        )

    def links(self) -> DataFrame:
        """Link addresses of the pages, with reference forms the pages do not have."""
        href = r'<a href="([^"]*)"'
        raw = self.table("pages").select(
            "page_id", F.col("url").alias("base"), F.posexplode(F.regexp_extract_all("html", F.lit(href), F.lit(1))).alias("pos", "href")
        )
        tail = F.expr("substring(href, 2)")
        form = F.col("pos") % 9
        ref = (
            F.when(form == 0, F.col("href")).when(form == 1, tail)
            .when(form == 2, F.concat(F.lit("../"), tail, F.lit(".jpg")))
            .when(form == 3, F.concat(F.lit("//cdn.example.net/"), tail, F.lit(".TIFF?w=1")))
            .when(form == 4, F.lit("?page=2")).when(form == 5, F.lit("#top"))
            .when(form == 6, F.concat(F.lit("a/./b/../"), tail, F.lit("/..")))
            .when(form == 7, F.concat(F.lit("https://Host.Example.com:8080/x/"), tail, F.lit(".tif")))
            .otherwise(F.lit("mailto:someone@example.com"))
        )
        return raw.select("page_id", "base", "pos", ref.alias("ref"))

    def image_pages(self) -> DataFrame:
        i = F.col("page_id").cast("string")
        pieces = []
        for part in IMAGE_HTML:
            pieces += [F.lit(part), i]
        return self.table("pages").select("page_id", "url", F.concat("html", *pieces[:-1]).alias("html"))

    def texts(self) -> DataFrame:
        i = F.col("doc_id").cast("string")
        kind = F.col("doc_id") % 4
        extra = (
            F.when(kind == 0, F.concat(F.lit(" see https://img.example.com/a/"), i, F.lit(".jpeg?w=10&h=20, ok")))
            .when(kind == 1, F.concat(F.lit(" (HTTP://IMG.example.com/B"), i, F.lit(".PNG)")))
            .when(kind == 2, F.concat(F.lit(" https://x.example.com/page https://x.example.com/"), i, F.lit(".tif")))
            .otherwise(F.lit(""))
        )
        return self.table("documents").select("doc_id", F.concat("text", extra).alias("text"))

    def manifests(self) -> DataFrame:
        i, s = F.col("page_id"), F.col("page_id").cast("string")
        url = F.concat(F.lit("https://site.example.org/chapter/"), F.lower(F.hex(i + 4096)), F.lit("-ab/1"))
        whole = F.concat(
            F.lit('{"baseUrl":"https://cdn'), (i % 5).cast("string"), F.lit('.example.org","chapter":{"hash":"h'), s,
            F.lit('","data":["p1-'), s, F.lit('.png","p2.png"'), F.when(i % 2 == 0, F.lit(',"p3.jpg"')).otherwise(F.lit("")), F.lit("]}}"),
        )
        json = (
            F.when(i % 11 == 0, F.concat(F.lit('{"baseUrl":'), s, F.lit(",")))
            .when(i % 7 == 0, F.concat(F.lit('{"baseUrl":"https://c.example.org","chapter":{"data":["x'), s, F.lit('.png"]}}')))
            .otherwise(whole)
        )
        return self.table("pages").select("page_id", url.alias("url"), json.alias("json"))

    def exif(self) -> DataFrame:
        s = F.col("doc_id").cast("string")
        tags = {271: F.concat(F.lit("Maker"), s), 282: F.lit("72"), 283: F.lit("72"), 296: F.lit("2"),
                40962: s, 40963: F.lit("600"), 36867: F.concat(F.lit("2024:"), s)}
        text = {"Software": F.concat(F.lit("tool "), s), "dpi": F.lit("72"), "aspect": F.lit("1"),
                "icc_profile": F.lit("b"), "Title": F.col("source")}
        pairs = lambda d: F.create_map(*[x for k, v in d.items() for x in (F.lit(k), v)])
        return self.table("documents").select(
            F.col("doc_id").alias("image_id"), pairs(tags).alias("exif"), pairs(text).alias("text")
        )

    def presets(self) -> DataFrame:
        i = F.col("c_custkey")
        good = F.concat(
            F.lit('{"p":{"tile_width":"'), (i % 9 * 64).cast("string"), F.lit('","no_such_field":"1","kernel":"k'),
            (i % 3).cast("string"), F.lit('"}}'),
        )
        return self.table("customer").select(
            "c_custkey", F.col("c_name").alias("name"), F.when(i % 6 == 0, F.lit("{not json")).otherwise(good).alias("json")
        )

    def history(self) -> DataFrame:
        return self.table("events").select(
            F.col("event_type").alias("category"), F.concat(F.lit("/m/"), F.col("user_id").cast("string"), F.lit(".onnx")).alias("path"),
            F.col("ts").cast("timestamp").alias("used_at"), "event_id",
        )

    def looks(self) -> DataFrame:
        """Directory looks: a file per user, its size changing with the event."""
        return self.table("events").select(
            F.concat(F.lit("/watch/"), F.col("user_id").cast("string"), F.lit(".png")).alias("path"),
            (F.floor(F.col("value")) % 3 * 100).alias("size_bytes"),
            F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("look_id"),
        )


# Markup put before each page; the page's number stands between the pieces.
IMAGE_HTML = (
    '<img data-src="/img/', '.jpg" width="800" height="900" alt="cover ', '">'
    '<img src="small.png" srcset="s', '.png 640w, big', '.png 2x, mid.png" width="1200" height="1600">'
    '<img src="plain.jpg" srcset="a.jpg 10.5w, b.jpg 20w" height=700>'
    '<img src="/dup/', '.png" width="100" height="100"><img alt="x > y" src="/dup/', '.png" width="900" height="900">'
    '<img src="data:image/png;base64,AAAA"><img data-lazy-src="blob:x" src="../rel/',
    '.webp"><picture class="p"><source srcset="//cdn.example.net/p', '.avif 1x, //cdn.example.net/q',
    '.avif 2x"><img src="?v=', '"></picture><source type="image/webp" src="free.webp">'
    '<source src="video.mp4" type="video/mp4"><div class=x style="background-image: url(\'/bg/',
    '.jpg\')" width="900" height="900"></div><IMG DATA-SRCSET="l1.jpg 300w, l2.jpg 600w" src=fallback.jpg>'
    '<!-- <img src="hidden.png"> --><script>var s="<img src=\'x.png\'>";</script><img src="/q',
    '?a=1&amp;b=2" width="12px" height="900" alt="',
    "abcdefghij" * 12 + '">',
)
