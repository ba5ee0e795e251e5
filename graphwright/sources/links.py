"""Links of web pages, in the order in which they stand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place (from 1) and link for every href."""
    links = F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))
    return pages.select("page_id", F.posexplode(links).alias("k", "link")).select("page_id", (F.col("k") + 1).alias("place"), "link")
