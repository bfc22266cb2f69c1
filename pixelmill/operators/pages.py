"""Images of fetched pages: candidates, first occurrences, size filter, download plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pixelmill.functions import bind, html as H
from pixelmill.functions.filters import has_inline_scheme
from pixelmill.functions.urls import resolve_url, url_filename, url_host
from .markup import elements

# Smallest page image worth keeping.
MIN_WIDTH, MIN_HEIGHT = 400, 600

#: Characters of an index key, and parts a host's addresses are dealt into.
GRAM, SPREAD = 3, 16

_COLUMNS = ("page_id", "phase", "pos", "sub", "url", "width", "height", "alt")


def _present(value: Column) -> Column:
    """Keeps rows whose value is not null, computing it once.

    As a generator it also stops later filters from being pushed below it, which
    would compute the value a second time.
    """
    return F.explode(F.filter(F.array(value), lambda u: u.isNotNull()))


def img_candidates(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Every usable image reference of every page (page_id, url, html), made absolute.

    Phase 1 is `<img>`, phase 2 `<picture>` sources and image-typed `<source>`, phase 3
    inline background images; `pos`, `sub` is document order inside a phase. A page is
    read once, where it lies: no shuffle.
    """
    found = elements(pages)
    attrs, phase = F.col("attrs"), F.col("phase")

    best, plain = H.best_srcset(H.attribute(attrs, "srcset")), H.lazy_source(attrs, strict)
    image = bind(plain, lambda u: F.when(u.isNotNull(), F.coalesce(F.nullif(best, F.lit("")), u)))
    typed = F.coalesce(H.attribute(attrs, "type").contains("image"), F.lit(False))
    ref = (
        F.when(phase == 1, image)
        .when(phase == 2, F.when(F.col("inside") | typed, H.source_element_url(attrs)))
        .otherwise(H.background_url(H.attribute(attrs, "style")))
    )
    # A laid-out box would need a browser; a styled tag's own size attributes stand in.
    width, height = H.image_size(attrs)
    sized = lambda n: F.when(phase == 2, F.lit(H.UNKNOWN_SIZE)).otherwise(n)
    alt = F.when(phase == 1, H.truncate_alt(H.attribute(attrs, "alt"))).otherwise(F.lit(""))
    return (
        found.select(
            "page_id", "page_url", "phase", "pos", "sub", sized(width).alias("width"),
            sized(height).alias("height"), alt.alias("alt"), _present(ref).alias("ref"),
        )
        .withColumn("url", _present(resolve_url(F.col("page_url"), F.col("ref"))))
        .select(*_COLUMNS)
    )


def filter_scheme(df: DataFrame, column: str = "url") -> DataFrame:
    return df.where(~has_inline_scheme(F.col(column)))


def dedupe_urls(page_images: DataFrame) -> DataFrame:
    """First occurrence of an address on a page, by phase and document order.

    A minimum over (phase, pos, sub, rest): it combines before the shuffle, so an
    address repeated any number of times reaches its reducer once per task.
    """
    rest = [c for c in page_images.columns if c not in ("page_id", "url", "phase", "pos", "sub")]
    first = F.min(F.struct("phase", "pos", "sub", *rest)).alias("s")
    return page_images.groupBy("page_id", "url").agg(first).select("page_id", "url", "s.*")


def filter_min_image(page_images: DataFrame, width: int = MIN_WIDTH, height: int = MIN_HEIGHT) -> DataFrame:
    """Apply after `dedupe_urls`: a small first copy hides a large later one."""
    return page_images.where((F.col("width") >= width) & (F.col("height") >= height))


def write_manifest(page_images: DataFrame, folder: str = "/downloads") -> DataFrame:
    """Download plan: destination per address and how many addresses share it."""
    plan = page_images.select(
        "page_id", "url",
        F.concat(F.lit(folder.rstrip("/") + "/"), F.col("page_id").cast("string"), F.lit("/"), url_filename(F.col("url"))).alias("dest"),
    )
    sharing = plan.groupBy("page_id", "dest").agg(F.count(F.lit(1)).alias("n_sharing"))
    return plan.join(sharing, ["page_id", "dest"])


def host_suffixes(host: Column) -> Column:
    """`a.b.c` -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), ".")
    )


def _grams(text: Column, size: Column) -> Column:
    """Distinct runs of `size` characters."""
    n = F.length(text)
    return F.array_distinct(F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.substring(text, i, size))).otherwise(F.array()))


def _by_suffix(hosts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hosts at or below a domain. The engine splits a suffix that most hosts have (skewed join)."""
    return hosts.withColumn("domain", F.explode(host_suffixes(F.col("__host")))).join(wanted, "domain")


def _by_substring(hosts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Hosts that hold a domain, by an index of the rules under their rarest run of three characters.

    A rule is looked up where that run occurs and then compared, so a host has three rows per
    character at most, and a run that most hosts have leads to no rule unless it has nothing rarer. Rules
    of one or two characters are their own run.
    """
    every = F.concat(*[_grams(F.col("__host"), F.lit(n)) for n in range(1, GRAM + 1)])
    at = hosts.select("__host", F.explode(every).alias("gram"))
    own = wanted.select("domain", F.explode(_grams(F.col("domain"), F.least(F.length("domain"), F.lit(GRAM)))).alias("gram"))
    seen = at.join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = own.join(seen, "gram", "left").groupBy("domain").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    index = rarest.where("r.n > 0").select("domain", F.col("r.gram").alias("gram"))
    return at.join(index, "gram").where(F.contains("__host", "domain")).select("__host", "domain")


def match_domains(urls: DataFrame, rules: DataFrame, mode: str = "suffix") -> DataFrame:
    """Addresses with each rule that applies to their host; adds `domain`.

    `suffix`: the host is the domain or below it. `substring`: the domain occurs anywhere in the
    host. Distinct hosts are matched, so the work grows with hosts; their addresses follow by
    equality, a popular host's in SPREAD parts.
    """
    if mode not in ("suffix", "substring"):
        raise ValueError(f"unknown match mode: {mode}")
    wanted = rules.select(F.regexp_replace(F.lower("domain"), r"^\.+", "").alias("domain")).where("domain <> ''").distinct()
    hosts = urls.withColumn("__host", url_host(F.col("url")))
    distinct = hosts.select("__host").where("__host <> ''").distinct()
    matched = (_by_suffix if mode == "suffix" else _by_substring)(distinct, wanted)
    spread = matched.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salted = hosts.withColumn("__salt", F.pmod(F.xxhash64("url", *[c for c in urls.columns if c != "url"]), F.lit(SPREAD)).cast("int"))
    return salted.join(spread, ["__host", "__salt"]).drop("__host", "__salt")
