"""URL functions (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "gif", "webp", "bmp", "svg", "tif", "tiff", "avif", "heic", "heif", "jfif", "pjpeg", "pjp", "mov")
UTM = "utm_source=chatgpt.com"


def domain(url: Column) -> Column:
    """Network location with every ``www.`` removed; port and case are kept."""
    return F.replace(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def plain_domain(d: Column) -> Column:
    """Lower-case domain without final dots and one leading ``www.``; all Wikipedias are one."""
    x = F.regexp_replace(F.regexp_replace(F.lower(F.trim(d)), r"\.+$", ""), r"^www\.", "")
    return F.when(x.endswith(".wikipedia.org"), "wikipedia.org").otherwise(x)


def without_utm(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(url), r"\?utm_source=chatgpt\.com$", ""), r"&utm_source=chatgpt\.com$", "")


def match_key(url: Column) -> Column:
    """URL as it is compared between source lists."""
    return F.regexp_replace(without_utm(url), r"/+$", "")


def with_scheme(url: Column) -> Column:
    """URL completed with https, or null if it has no host."""
    x = F.trim(url)
    full = F.when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), x).otherwise(F.concat(F.lit("https://"), x))
    return F.when(full.rlike(r"^https?://[^/?#\s]+"), full)


def is_image(url: Column) -> Column:
    """A picture or film by its last letters, or a thumbnail of the image search host."""
    low = F.lower(url)
    return low.rlike(r"\.(" + "|".join(IMAGE_ENDINGS) + ")$") | low.rlike(r"^https?://tse[^/?#]*\.mm\.bing\.net(?:[/?#]|$)")
