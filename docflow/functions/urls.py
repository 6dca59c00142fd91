"""Image address variants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: upper-case asset id, optionally followed by a variant name.
ASSET_PATTERN = r"/asset/([A-Z0-9]+)(?:/\w+)?"


def url_variants(url: Column, cdn_host: str) -> Column:
    """struct<primary, fallback>: the medium variant first for CDN assets."""
    asset = F.nullif(F.regexp_extract(url, ASSET_PATTERN, 1), F.lit(""))
    on_cdn = F.contains(url, F.lit(f"{cdn_host}/asset/"))
    base = F.when(on_cdn, F.concat(F.lit(f"https://{cdn_host}/asset/"), asset))
    return F.struct(
        F.coalesce(F.concat(base, F.lit("/medium")), url).alias("primary"),
        base.alias("fallback"),
    )
