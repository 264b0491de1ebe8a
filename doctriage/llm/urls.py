"""Canonical URLs and the keys they are looked up by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that do not select content.
IGNORED_PARAMETERS = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, ``www.``, the scheme's default port, fragment, closing slashes
    and parameters that do not select content; the other parameters in order.  Null without a host.
    Without a scheme both default ports are cut."""
    bare = F.regexp_replace(F.trim(url), r"#[\s\S]*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    bare = F.regexp_replace(bare, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    served = (
        F.when(scheme == "http", F.regexp_replace(host, r":(80)?$", ""))
        .when(scheme == "https", F.regexp_replace(host, r":(443)?$", ""))
        .when(scheme == "", F.regexp_replace(host, r":(80|443)?$", ""))
        .otherwise(F.regexp_replace(host, r":$", ""))
    )
    host = F.regexp_replace(served, r"^www\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(/[^?]*)?", 1), r"/+$", "")
    query = F.regexp_extract(bare, r"\?([\s\S]*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(IGNORED_PARAMETERS))
    )
    asked = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, path, asked))


def host_of(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^[^/?]*", 0)


def path_of(canonical: Column) -> Column:
    return F.regexp_extract(canonical, r"^[^/?]*([^?]*)", 1)
