"""Which addresses may be read, and what may come back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HTML_BYTES, PDF_BYTES = 2 * 1024 * 1024, 10 * 1024 * 1024
# Last labels of host names that are never public.
_PRIVATE_NAMES = r"(?i)(?:^|\.)(?:localhost|local|internal|invalid|test)$"


def url_part(url: Column, part: str) -> Column:
    return F.try_parse_url(url, F.lit(part))


def admissible(url: Column) -> Column:
    """http or https, without credentials or a port of its own, and no private name."""
    scheme, host, authority = F.lower(url_part(url, "PROTOCOL")), F.lower(url_part(url, "HOST")), url_part(url, "AUTHORITY")
    port = F.regexp_extract(F.coalesce(authority, F.lit("")), r":(\d+)$", 1)
    default = (port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443"))
    name = F.regexp_replace(host, r"\.$", "")
    return F.coalesce(scheme.isin("http", "https") & host.isNotNull() & (host != "") & url_part(url, "USERINFO").isNull() & default & ~name.rlike(_PRIVATE_NAMES), F.lit(False))


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def source_format(content: Column, content_type: Column, url: Column) -> Column:
    """html or pdf, or why the bytes can't be used: too_large, unsupported_format."""
    kind = F.coalesce(content_type, F.lit(""))
    pdf = F.substring(content, 1, 5) == F.lit("%PDF-").cast("binary")
    hinted = kind.rlike("(?i)application/pdf") | url_part(url, "PATH").rlike(r"(?i)\.pdf$")
    head = F.decode(F.substring(content, 1, 512), "UTF-8")
    html = kind.rlike(r"(?i)text/html|application/xhtml\+xml") | head.rlike(r"(?i)^\s*<!doctype html|^\s*<html")
    limit = F.when(F.coalesce(hinted, F.lit(False)) | pdf, F.lit(PDF_BYTES)).otherwise(F.lit(HTML_BYTES))
    return F.when(F.octet_length(content) > limit, "too_large").when(pdf, "pdf").when(html, "html").otherwise("unsupported_format")
