"""URL parts, resolution against a base, and the crawlable test, as column expressions."""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column, functions as F

# Page types worth fetching; any other known extension is not.
PAGE_TYPES = ("text/html", "application/xhtml+xml", "text/plain")
SKIPPED_PREFIXES = ("#", "javascript:", "mailto:", "tel:")

_KNOWN = mimetypes.MimeTypes(filenames=())
BLOCKED_EXTENSIONS = sorted(
    ext for ext, kind in _KNOWN.types_map[True].items() if kind not in PAGE_TYPES
)
PACKED_EXTENSIONS = sorted(_KNOWN.encodings_map)
ARCHIVE_EXTENSIONS = sorted(_KNOWN.suffix_map)


def origin(url: Column) -> Column:
    return F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)


def host(url: Column) -> Column:
    """Host with its port, as it stands between the slashes."""
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def decoded_target(url: Column) -> Column:
    """Everything after the host, with percent-encoding undone where it is well formed."""
    decoded = F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(
        F.coalesce(decoded, url), r"(?s)^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*(.*)$", 1
    )


def without_query(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def _without_dots(p: Column) -> Column:
    """Resolve "." and ".." segments of an absolute path."""
    parts = F.split(F.substring(p, 2, F.length(p)), "/")
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    closed = F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(
        F.contains(p, F.lit("/.")), F.concat(F.lit("/"), F.array_join(closed, "/"))
    ).otherwise(p)


def resolve(href: Column, base: Column) -> Column:
    """The absolute URL of a link on a page, query and fragment removed."""
    link = without_query(href)
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(href, F.lit("//")), F.concat(F.regexp_extract(base, r"^([^/]*:)", 1), link))
        .when(F.startswith(href, F.lit("/")), F.concat(origin(base), _without_dots(link)))
        .when(link == "", F.concat(origin(base), path(base)))
        .otherwise(F.concat(origin(base), _without_dots(F.concat(folder, link))))
    )


def _extension(p: Column) -> Column:
    return F.regexp_extract(p, r"[^/.][^/]*?(\.[^./]*)$", 1)


def is_crawlable(url: Column) -> Column:
    """The guessed type is a page, plain text or unknown. Compression suffixes are looked through."""
    p = path(url)
    ext = _extension(p)
    packed = ext.isin(PACKED_EXTENSIONS)
    inner = F.when(packed, _extension(F.regexp_replace(p, r"\.[^./]*$", ""))).otherwise(ext)
    return ~(
        F.lower(inner).isin(BLOCKED_EXTENSIONS) | F.lower(ext).isin(ARCHIVE_EXTENSIONS)
    )


def is_web_address(url: Column) -> Column:
    return url.rlike(r"^(?i)https?://[^/?#]+")
