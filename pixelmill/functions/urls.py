"""Addresses: splitting, resolving, naming, classifying."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import bind
from .paths import IMAGE_SUFFIXES, stem, suffix

# Path endings of a direct image link. `.tif` is not among them.
DIRECT_IMAGE_ENDINGS = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".bmp", ".tiff", ".avif")

# Fixed pattern: an image address inside running text.
IMAGE_URL_IN_TEXT = (
    r"(?i)https?://[^\s<>\"']+\.(?:png|jpg|jpeg|gif|webp|bmp|tiff?)(?:\?[^\s<>\"']*)?"
)

# Generic address syntax (RFC 3986, appendix B):
# 2 scheme, 3 //authority, 4 authority, 5 path, 7 query, 9 fragment.
_PARTS = r"^(([A-Za-z][A-Za-z0-9+.-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Schemes under which a reference is resolved against its base.
RELATIVE_SCHEMES = (
    "", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp",
    "mms", "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
)


def url_part(url: Column, part: str) -> Column:
    group = {"scheme": 2, "authority": 4, "path": 5, "query": 7, "fragment": 9}[part]
    value = F.regexp_extract(url, _PARTS, group)
    return F.lower(value) if part == "scheme" else value


def url_host(url: Column) -> Column:
    """Host name, lower-cased, without user and port."""
    authority = F.regexp_replace(url_part(url, "authority"), r"^.*@", "")
    return F.lower(F.regexp_replace(authority, r":\d*$", ""))


def _file_part(url: Column) -> Column:
    """Last path segment, without the `;parameters` that may follow it."""
    return F.regexp_replace(F.regexp_extract(url_part(url, "path"), r"[^/]*$", 0), r";.*$", "")


def is_webpage_url(url: Column) -> Column:
    path = F.lower(F.regexp_replace(url_part(url, "path"), r";[^/]*$", ""))
    image = F.lit(False)
    for ending in DIRECT_IMAGE_ENDINGS:
        image = image | path.endswith(ending)
    web = F.lower(url).startswith("http://") | F.lower(url).startswith("https://")
    return F.coalesce(web & ~image, F.lit(False))


def extract_image_url(text: Column) -> Column:
    """First image address in a text, or null."""
    found = F.regexp_extract(text, IMAGE_URL_IN_TEXT, 0)
    return F.when(found != "", found)


def url_filename(url: Column) -> Column:
    """File name to store an address under; a hash name when it has none."""
    name = _file_part(url)
    hashed = F.concat(F.lit("image_"), F.substring(F.md5(url.cast("binary")), 1, 8), F.lit(".jpg"))
    return F.when((name == "") | ~name.contains("."), hashed).otherwise(name)


def dropped_filename(url: Column) -> Column:
    """The other naming rule, for a single dropped link: unknown suffixes become png."""
    name = _file_part(url)
    usable = F.when((name == "") | ~name.contains("."), F.lit("downloaded_image.png")).otherwise(name)
    known = F.lower(suffix(usable)).isin(*IMAGE_SUFFIXES)
    return F.when(known, usable).otherwise(F.concat(stem(usable), F.lit(".png")))


def _fold_dots(segments: Column) -> Column:
    """Apply `.` and `..`; a trailing one leaves a trailing slash."""
    empty = F.array().cast("array<string>")
    folded = F.aggregate(
        segments,
        empty,
        lambda done, seg: F.when(
            seg == "..",
            F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(done),
        ).when(seg == ".", done).otherwise(F.concat(done, F.array(seg))),
    )
    last = F.element_at(segments, -1)
    return F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)


def _all_parts(url: Column) -> Column:
    names = ("scheme", "authority", "path", "query", "fragment")
    return F.struct(url.alias("whole"), *[url_part(url, n).alias(n) for n in names])


def _merged_path(base_path: Column, ref_path: Column) -> Column:
    """Path of a reference, dots folded; a relative one is joined without empty inner segments."""
    above = bind(
        F.split(base_path, "/"),
        lambda parts: F.when(
            F.element_at(parts, -1) != "",
            F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))),
        ).otherwise(parts),
    )
    below = bind(
        F.concat(above, F.split(ref_path, "/")),
        lambda j: F.filter(j, lambda seg, i: (i == 0) | (i == F.size(j) - 1) | (seg != "")),
    )
    kept = F.when(ref_path.startswith("/"), F.split(ref_path, "/")).otherwise(below)
    text = F.array_join(bind(kept, _fold_dots), "/")
    return bind(text, lambda t: F.when(t == "", F.lit("/")).otherwise(t))


def _absolute(base: Column, ref: Column) -> Column:
    has_authority, no_path = ref["authority"] != "", ref["path"] == ""
    path = (
        F.when(has_authority, ref["path"]).when(no_path, base["path"])
        .otherwise(_merged_path(base["path"], ref["path"]))
    )
    authority = F.when(has_authority, ref["authority"]).otherwise(base["authority"])
    query = F.when(~has_authority & no_path & (ref["query"] == ""), base["query"]).otherwise(ref["query"])
    after = lambda mark, text: bind(text, lambda t: F.when(t != "", F.concat(F.lit(mark), t)).otherwise(F.lit("")))
    place = bind(
        F.struct(authority.alias("a"), path.alias("p")),
        lambda s: F.concat(
            F.when(s["a"] != "", F.concat(F.lit("//"), s["a"])).otherwise(F.lit("")),
            F.when((s["a"] != "") & (s["p"] != "") & ~s["p"].startswith("/"), F.lit("/")).otherwise(F.lit("")),
            s["p"],
        ),
    )
    return F.concat(
        F.when(base["scheme"] != "", F.concat(base["scheme"], F.lit(":"))).otherwise(F.lit("")),
        place, after("?", query), after("#", ref["fragment"]),
    )


def resolve_url(base: Column, ref: Column) -> Column:
    """Absolute address of `ref` as written on the page at `base`."""
    def pick(s: Column) -> Column:
        b, r = s["b"], s["r"]
        same = (r["scheme"] == "") | (r["scheme"] == b["scheme"])
        return (
            F.when(r["whole"] == "", b["whole"])
            .when(b["whole"] == "", r["whole"])
            .when(~same | ~b["scheme"].isin(*RELATIVE_SCHEMES), r["whole"])
            .otherwise(_absolute(b, r))
        )

    none = F.lit("")
    both = F.struct(_all_parts(F.coalesce(base, none)).alias("b"), _all_parts(F.coalesce(ref, none)).alias("r"))
    return bind(both, pick)
