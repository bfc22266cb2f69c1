"""Elements of fetched pages that may hold an image, read in one pass over each page.

A page is a row of bytes that one pattern cuts into tokens from left to right, as a parser's states
do: comments, scripts and style sheets are stepped over whole, and a start tag is taken with its
quoted values, so nothing inside them is mistaken for a tag. Each token is matched once and never
given back (possessive groups), so the time grows with the page. Attributes are read
only of elements that are kept, and leave as a map.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, types as T

#: Attribute syntax: a quote opens a value only after `=`; elsewhere it belongs to the name or the bare value.
_VALUE = rb"""(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s"'>][^\s>]*+)"""
_ATTRIBUTES = rb"(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+" + _VALUE + rb"?+)?+)*+"
#: Unclosed comments, scripts, style sheets and tags reach to the end of the page.
_TOKEN = re.compile(
    rb"(?is)<(?:!--.*?(?:-->|\Z)|(?:script\b.*?(?:</script\s*+>|\Z))|(?:style\b.*?(?:</style\s*+>|\Z))"
    rb"|(?P<end>/picture)\s*+>|(?P<name>[a-z][^\s/>]*+)(?P<body>(?=[\s/>])" + _ATTRIBUTES + rb")(?P<shut>>|\Z))"
)
_ATTRIBUTE = re.compile(rb"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(" + _VALUE + rb")?+)?+")
#: `&amp;` last, so nothing is decoded twice.
_ENTITIES = ((b"&lt;", b"<"), (b"&gt;", b">"), (b"&quot;", b'"'), (b"&#39;", b"'"), (b"&amp;", b"&"))
IMAGE, SOURCE, STYLED = 1, 2, 3

_FOUND = [
    T.StructField("phase", T.IntegerType()), T.StructField("pos", T.IntegerType()), T.StructField("sub", T.IntegerType()),
    T.StructField("inside", T.BooleanType()), T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
]


def attributes(body: bytes) -> dict[str, str]:
    """Attributes by lower-cased name; the first of equal names wins, one without value is empty."""
    out: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(body):
        key = name.decode("utf-8", "replace").lower()
        if key not in out:
            if len(value) > 1 and value[0] in b"\"'" and value[-1] == value[0]:
                value = value[1:-1]
            if b"&" in value:
                for entity, char in _ENTITIES:
                    value = value.replace(entity, char)
            out[key] = value.decode("utf-8", "replace")
    return out


def read_page(html: bytes) -> Iterator[tuple[int, int, int, bool, dict[str, str]]]:
    """(phase, pos, sub, inside, attributes) of a page's images, picture sources and tags with a background."""
    images = sources = styled = 0
    picture = sub = -1  # the number of the open picture among blocks and free sources
    for token in _TOKEN.finditer(html):
        name = token["name"]
        if name is None:
            if token["end"]:
                picture = -1
            continue
        if not token["shut"]:
            return
        name, body = name.lower(), token["body"]
        if name == b"picture" and picture < 0:
            picture, sub, sources = sources, 0, sources + 1
        elif name == b"img":
            yield IMAGE, images, 0, True, attributes(body)
            images += 1
        elif name == b"source":
            if picture >= 0:
                yield SOURCE, picture, sub, True, attributes(body)
                sub += 1
            else:
                yield SOURCE, sources, 0, False, attributes(body)
                sources += 1
        if b"background" in body:
            yield STYLED, styled, 0, True, attributes(body)
            styled += 1


def elements(pages: DataFrame) -> DataFrame:
    """One row per element of `pages` (page_id, url, html): page_id, page_url, phase, pos, sub, inside, attrs.

    `pos` counts the elements of a phase in document order; a picture and a source outside of one are one
    count, and `sub` counts a picture's sources. An unclosed picture reaches to the page's end.
    `inside` is false for sources outside of a picture. Null pages have no elements.
    """
    given = pages.select("page_id", pages["url"].alias("page_url"), pages["html"].cast("binary").alias("html"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.map_(pa.string(), pa.string())]
        for batch in batches:
            page, found = [], []
            for k, html in enumerate(batch.column("html")):
                if html.is_valid and html.as_buffer().size:
                    these = list(read_page(html.as_buffer().to_pybytes()))
                    page += [k] * len(these)
                    found += these
            columns = list(zip(*found)) or [()] * len(types)
            columns[4] = [list(a.items()) for a in columns[4]]
            at = pa.array(page, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id").take(at), batch.column("page_url").take(at), *(pa.array(c, t) for c, t in zip(columns, types))],
                ["page_id", "page_url", *(f.name for f in _FOUND)],
            )

    return given.mapInArrow(rows, T.StructType([given.schema["page_id"], given.schema["page_url"], *_FOUND]))
