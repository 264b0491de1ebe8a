"""URL filters by dated lists: every capture is judged by the entries active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctriage.llm.asof import carry_forward
from doctriage.llm.personal_data import let
from doctriage.llm.urls import canonical_url, host_of, path_of

# Kinds of entries, from the least to the most specific.
DOMAIN, HOST, PREFIX = "domain", "host", "prefix"
RANKS = {DOMAIN: 1, HOST: 2, PREFIX: 3}


def entry_key(list_name: Column, kind: Column, value: Column) -> Column:
    return F.concat_ws("\t", kind, value, list_name)


def entry_value(kind: Column, value: Column) -> Column:
    """The entry's value written as captures are, so that capitals, ``www.``, schemes, default ports
    and closing slashes do not matter; a domain may begin with ``.`` or ``*.``.  Null where it can
    cover no capture: no host, parameters, or a path where a host or domain is asked for."""
    bare = F.when(kind == DOMAIN, F.regexp_replace(F.trim(value), r"^(\*?\.)+", "")).otherwise(value)
    # The address is computed once, however often it is asked for.
    return let(
        canonical_url(bare),
        lambda address: F.when(
            ~address.contains("?") & ((kind == PREFIX) | (path_of(address) == "")), address
        ),
    )


def flaw() -> Column:
    """Why an entry is not used, null where it is."""
    known = lambda name, values: F.coalesce(F.col(name).isin(*values), F.lit(False))
    return (
        F.when(F.col("list_name").isNull(), "no list")
        .when(~known("kind", RANKS), "unknown kind")
        .when(F.col("value").isNull(), "no value")
        .when(entry_value(F.col("kind"), F.col("value")).isNull(), "covers no address")
        .when(~known("action", ("add", "remove")), "unknown action")
        .when(F.col("dated").isNull(), "no date")
    )


def unused(entries: DataFrame) -> DataFrame:
    """The rows of ``entries`` that no interval is made of, with a ``flaw`` saying why."""
    return entries.withColumn("flaw", flaw()).filter("flaw IS NOT NULL")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``list_name, kind, value, allow, category, valid_from, valid_to`` of dated
    ``entries`` (``entry_id, list_name, kind, value, action, allow, category, dated``).

    An ``add`` holds until the next entry of the same list, kind and value, whatever its action;
    ``valid_to`` is exclusive and null while nothing follows.  Of entries at one moment the one
    with the largest id holds.  Values are compared and returned as ``entry_value`` writes them.
    Entries lacking list, known kind, value, known action or date are not used; ``unused`` names them.
    """
    value = entry_value(F.col("kind"), F.col("value")).alias("value")
    used = entries.filter(flaw().isNull()).select(
        "entry_id", "list_name", "kind", value, "action", "allow", "category", "dated"
    )
    # Walked from the latest entry to the earliest, so the state carried is the next one's date.
    backwards = (
        used.withColumn("key", entry_key(F.col("list_name"), F.col("kind"), F.col("value")))
        .withColumn("_moment", -F.unix_micros("dated"))
        .withColumn("_number", -F.col("entry_id"))
    )
    walked = carry_forward(backwards, "key", ["_moment", "_number"], F.lit(True), ["dated"])
    held = walked.withColumn("valid_to", F.col("carried.dated")).filter(
        "action = 'add' AND (valid_to IS NULL OR valid_to > dated)"
    )
    return held.select(
        "key",
        "list_name",
        "kind",
        "value",
        F.coalesce("allow", F.lit(False)).alias("allow"),
        "category",
        F.col("dated").alias("valid_from"),
        "valid_to",
    )


def lookup_values(canonical: Column, labels: int, depth: int) -> Column:
    """``kind, value, size`` of all entries that would cover a URL: its host, the domains of one to
    ``labels`` labels it lies in, and its path prefixes of none to ``depth`` segments."""
    host, path = host_of(canonical), path_of(canonical)
    names = F.split(host, r"\.")
    steps = F.split(F.regexp_replace(path, "^/", ""), "/")

    def value(kind: str, text: Column, size: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), text.alias("value"), size.cast("int").alias("size"))

    domains = F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(max(1, labels))), lambda n: n <= F.size(names)),
        lambda n: value(DOMAIN, F.array_join(F.slice(names, -n, n), "."), n),
    )
    prefixes = F.transform(
        F.filter(
            F.sequence(F.lit(1), F.lit(max(1, depth))), lambda n: (n <= F.size(steps)) & (path != "")
        ),
        lambda n: value(
            PREFIX, F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, n), "/")), n
        ),
    )
    whole = F.array(value(HOST, host, F.lit(0)), value(PREFIX, host, F.lit(0)))
    return F.concat(whole, domains, prefixes)


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """``capture_id, url, fetched_at, blocked, active, list_name, kind, value, category`` for every row
    of ``captures`` (``capture_id, url, fetched_at``).

    ``active`` counts the entries that cover the URL at its fetch time.  The most specific one
    decides: a path prefix before the host before a domain, longer before shorter, allowing before
    blocking, then the smaller list name; it is named in the last columns.  Entries are spelled as
    ``entry_value`` allows; those that cannot be used are left out (``unused``).  Rows without URL, host
    or time, and rows that no entry covers, are not blocked.  Repeated rows are judged alike.
    Further columns are ignored; empty tables are fine on either side.
    """
    held = intervals(entries)
    # Longer domains and deeper prefixes than any entry has cannot be covered.
    sizes = held.agg(
        F.max(F.when(F.col("kind") == DOMAIN, F.size(F.split("value", r"\.")))).alias("labels"),
        F.max(F.when(F.col("kind") == PREFIX, F.size(F.split("value", "/")) - 1)).alias("depth"),
    ).first()
    rows = captures.select(
        F.col("capture_id").cast("long").alias("capture_id"),
        F.col("url").alias("given"),
        "fetched_at",
        canonical_url(F.col("url")).alias("url"),
    )
    looked = (
        rows.filter("url IS NOT NULL AND fetched_at IS NOT NULL")
        .select("capture_id", "url", "fetched_at")
        .distinct()
        .withColumn("at", F.explode(lookup_values(F.col("url"), sizes["labels"] or 0, sizes["depth"] or 0)))
        .select("capture_id", "url", "fetched_at", "at.*")
    )
    named = held.select("kind", "value", "key").distinct()
    asked = looked.join(named, ["kind", "value"])
    nothing = lambda kind: F.lit(None).cast(kind)
    events = asked.select(
        "key",
        F.col("fetched_at").alias("moment"),
        F.lit(1).alias("turn"),
        "capture_id",
        "url",
        "kind",
        "value",
        "size",
        nothing("timestamp").alias("valid_to"),
        nothing("boolean").alias("allow"),
        nothing("string").alias("category"),
        nothing("string").alias("list_name"),
    ).unionByName(
        held.select(
            "key",
            F.col("valid_from").alias("moment"),
            F.lit(0).alias("turn"),
            nothing("long").alias("capture_id"),
            nothing("string").alias("url"),
            nothing("string").alias("kind"),
            nothing("string").alias("value"),
            nothing("int").alias("size"),
            "valid_to",
            "allow",
            "category",
            "list_name",
        )
    )
    joined = carry_forward(
        events,
        "key",
        ["moment", "turn", "capture_id"],
        F.col("turn") == 0,
        ["valid_to", "allow", "category", "list_name"],
    )
    active = joined.filter(
        "turn = 1 AND carried IS NOT NULL AND (carried.valid_to IS NULL OR moment < carried.valid_to)"
    )
    rank = F.lit(0)
    for kind, at in RANKS.items():
        rank = F.when(F.col("kind") == kind, at).otherwise(rank)
    entry = F.struct(
        (-rank).alias("rank"),
        (-F.col("size")).alias("length"),
        (~F.col("carried.allow")).alias("blocks"),
        F.col("carried.list_name").alias("list_name"),
        "kind",
        "value",
        F.col("carried.category").alias("category"),
    )
    decided = active.groupBy(
        F.col("capture_id").alias("_id"), F.col("url").alias("_url"), F.col("moment").alias("_moment")
    ).agg(F.count("*").alias("active"), F.min(entry).alias("first"))
    same = (
        F.col("capture_id").eqNullSafe(F.col("_id"))
        & (F.col("url") == F.col("_url"))
        & (F.col("fetched_at") == F.col("_moment"))
    )
    return rows.join(decided, same, "left").select(
        "capture_id",
        F.col("given").alias("url"),
        "fetched_at",
        F.coalesce("first.blocks", F.lit(False)).alias("blocked"),
        F.coalesce("active", F.lit(0)).alias("active"),
        "first.list_name",
        "first.kind",
        "first.value",
        "first.category",
    )
