"""From fetched pages to a download plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pixelmill.operators.ordering import largest_first
from pixelmill.operators.pages import (
    dedupe_urls, filter_min_image, filter_scheme, img_candidates, write_manifest,
)


def page_images(pages: DataFrame, strict: bool = False) -> DataFrame:
    """Images worth fetching, first occurrences only, largest first per page."""
    seen = dedupe_urls(filter_scheme(img_candidates(pages, strict)))
    return largest_first(filter_min_image(seen))


def download_plan(pages: DataFrame, folder: str = "/downloads") -> DataFrame:
    seen = dedupe_urls(filter_scheme(img_candidates(pages)))
    return write_manifest(filter_min_image(seen), folder)
