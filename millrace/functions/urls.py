"""URL functions: normalisation, parts, validity."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_URL = re.compile(r"^(https?)://([^/?#]*)([^#]*)", re.I)


def normalised(url: str | None) -> str | None:
    """The one form of a URL; None where it is rejected.

    Scheme and host in lower case, www. before a bare two-label host, no :80, no fragment, a path of at least /. A file
    name glued to the host's top-level domain is taken apart. Script links and paths that repeat a run of two or more
    segments three times, the mark of a crawler trap, are rejected; the last rule is our own reading.
    """
    m = _URL.match((url or "").strip())
    if not m or "javascript:" in m[3].lower():
        return None
    scheme, host, rest = m[1].lower(), m[2].lower(), m[3]
    host = re.sub(r":80$" if scheme == "http" else r":443$", "", host)
    glued = re.match(r"^(.*\.(?:com|net|org|no))(index\.[a-z]+)$", host)
    if glued:
        host, rest = glued[1], f"/{glued[2]}{rest}"
    if not re.fullmatch(r"[a-z0-9-]+(\.[a-z0-9-]+)+(:\d+)?", host):
        return None
    if host.count(".") == 1:
        host = "www." + host
    if not rest.startswith("/"):
        rest = "/" + rest
    if re.search(r"((?:/[^/?]+){2,})\1\1", rest):
        return None
    return f"{scheme}://{host}{rest}"


@F.pandas_udf(StringType())
def normalise(urls: pd.Series) -> pd.Series:
    return urls.map(normalised)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    """Without query and fragment; / where empty."""
    p = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def parts(url: Column) -> dict[str, Column]:
    """host, host_no_www, domain (last two labels), tld, n_subdomains, depth, path_length."""
    h = host(url)
    labels = F.split(h, r"\.")
    p = path(url)
    return {"host": h, "host_no_www": F.regexp_replace(h, r"^www\.", ""), "domain": F.substring_index(h, ".", -2), "tld": F.substring_index(h, ".", -1), "n_subdomains": F.greatest(F.size(labels) - 2, F.lit(0)).cast("long"), "depth": F.size(F.filter(F.split(p, "/"), lambda s: s != "")).cast("long"), "path_length": F.length(p).cast("long")}


def regular_host(name: Column) -> Column:
    """Lower case, no doubled, leading or trailing dots; loopback addresses as localhost."""
    h = F.regexp_replace(F.regexp_replace(F.lower(name), r"\.+", "."), r"^\.|\.$", "")
    return F.when(h.rlike(r"^127\.0\.0\.1$|^localhost(\.localdomain)?$"), F.lit("localhost")).otherwise(h)


def without_query(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\?.*$", ""), r"(?i)/default\.aspx$", "/")


def absolute(url: Column, at_host: Column) -> Column:
    """A redirect's target: a leading slash means the same host."""
    return F.when(url.startswith("/"), F.concat(F.lit("http://"), at_host, url)).otherwise(url)


def is_valid(url: Column) -> Column:
    return url.rlike(r"(?i)^https?://[a-z0-9-]+(\.[a-z0-9-]+)+(:[0-9]+)?([/?#]|$)") & ~F.lower(url).contains("javascript:")


def robots_blocks(html: Column, rule: str) -> Column:
    """Whether a page's robots meta tag holds a rule such as noindex or nofollow."""
    return html.rlike(rf"(?is)<meta\s+name\s*=\s*[\"']?robots[^>]*{rule}")


LINK = '<a[^>]+href="([^"#]+)'


def links(html: Column) -> Column:
    """Targets of a page's anchors without fragments, in order; images and other elements don't count."""
    return F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
