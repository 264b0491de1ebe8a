import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from doctriage.llm import revisits, url_lists
from doctriage.llm.asof import carry_forward
from doctriage.llm.queries import QUERIES
from doctriage.llm.urls import canonical_url

ZERO = datetime(2024, 1, 1)


def at(minutes):
    return None if minutes is None else ZERO + timedelta(minutes=minutes)


@pytest.mark.parametrize("batch", [3, 10_000])
def test_states_are_carried_across_batches_and_ranges(spark, batch):
    rng = random.Random(batch)
    rows = []
    for i in range(600):
        key = "hot" if i % 3 else f"k{rng.randrange(40)}"
        rows.append((key, rng.randrange(400), i, rng.random() < 0.05, f"v{i}"))
    rows += [("late", 1000 + i, 1000 + i, i == 0, f"v{1000 + i}") for i in range(200)]
    expected = {}
    latest = {}
    for key, moment, number, state, value in sorted(rows):
        expected[number] = latest.get(key)
        if state:
            latest[key] = value
    df = spark.createDataFrame(rows, "key string, moment long, number long, state boolean, value string")
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    try:
        spark.conf.set(setting, batch)
        found = carry_forward(df, "key", ["moment", "number"], F.col("state"), ["value"]).collect()
    finally:
        spark.conf.set(setting, before)
    assert {r.number: r.carried and r.carried.value for r in found} == expected
    assert len(found) == len(rows)


def test_canonical_urls(spark):
    urls = {
        "HTTP://WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top": "example.com/a/b?a=1&b=2",
        "https://example.com/a/b?a=1&b=2": "example.com/a/b?a=1&b=2",
        "//example.com": "example.com",
        "example.com/?ref=1": "example.com",
        "http://example.com:443/a": "example.com:443/a",
        "https://example.com:80/a": "example.com:80/a",
        "https://example.com:443/a": "example.com/a",
        "example.com:443/a": "example.com/a",
        "ftp://example.com:80/a": "example.com:80/a",
        "https:///path": None,
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(canonical_url(F.col("url"))).collect()] == list(urls.values())


CAPTURES = (
    "capture_id long, url string, fetched_at timestamp, status int, headers map<string,string>, "
    "key string, carried int, outcome string"
)


def captures(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "o") for r in rows], CAPTURES)


def test_revisits(spark):
    page, tag = "http://a.example/x", {"ETag": '"1"', "Content-Length": "9", "Vary": "a"}
    rows = [
        (1, page, at(0), 200, tag),
        (2, page, at(5), 200, {"etag": 'W/"2"', "Last-Modified": "monday"}),
        (10, page, at(0), 304, tag),  # not strictly later
        (11, "https://www.a.example/x/#f", at(1), 304, {"eTAG": 'W/"1"', "content-length": "0", "Age": "3"}),
        (12, page, at(6), 304, {"etag": '"1"'}),  # of an older response only
        (13, page, at(6), 304, {"last-modified": "monday", "vary": "b"}),
        (14, page, at(6), 304, {"etag": '"9"', "last-modified": "monday"}),
        (15, page, at(7), 304, None),
        (16, None, at(7), 304, tag),
        (17, page, None, 304, tag),
        (18, page, at(7), 500, tag),
        (None, page, at(7), 304, {"ETag": '"2"', "etag": '"3"'}),
        (3, page, None, 200, {"etag": '"1"'}),
        (13, page, at(6), 304, {"last-modified": "monday", "vary": "b"}),  # repeated
    ]
    found = sorted(
        (r.capture_id or -1, r.outcome, r.response_id, r.headers)
        for r in revisits.resolve(captures(spark, rows)).collect()
    )
    merged = {"etag": 'W/"2"', "last-modified": "monday", "vary": "b"}
    assert found == [
        (-1, "resolved", 2, {"etag": '"2"', "last-modified": "monday"}),
        (10, "no earlier response", None, None),
        (11, "resolved", 1, {"etag": 'W/"1"', "content-length": "9", "vary": "a", "age": "3"}),
        (12, "validator mismatch", None, None),
        (13, "resolved", 2, merged),
        (13, "resolved", 2, merged),
        (14, "validator mismatch", None, None),
        (15, "no validator", None, None),
        (16, "no url", None, None),
        (17, "no earlier response", None, None),
    ]
    assert revisits.resolve(captures(spark, [])).count() == 0


def test_given_pages_give_every_outcome(spark):
    rows = QUERIES["op4_revisits"](spark, "/root/testdata/sf0.01").collect()
    outcomes = Counter(r.outcome for r in rows)
    assert set(outcomes) == {"resolved", "no earlier response", "no validator", "validator mismatch"}
    judged = QUERIES["op6_url_lists"](spark, "/root/testdata/sf0.01").collect()
    assert {r.blocked for r in judged} == {True, False} and {r.kind for r in judged} > {"host", "domain"}


ENTRIES = (
    "entry_id long, list_name string, kind string, value string, action string, allow boolean, "
    "category string, dated timestamp, key string, valid_to int"
)


def test_lists(spark):
    def entry(number, kind, value, action, minute, allow=False, name="l"):
        return (number, name, kind, value, action, allow, f"c{number}", at(minute), "k", 1)

    entries = [
        entry(1, "host", "bad.example.com", "add", 10),
        entry(2, "host", "bad.example.com", "remove", 20),
        entry(3, "host", "bad.example.com", "add", 30),
        entry(4, "domain", "example.com", "add", 0),
        entry(5, "prefix", "bad.example.com/ok", "add", 0, True),
        entry(6, "prefix", "bad.example.com/ok/no", "add", 5, None),
        entry(7, "host", "tie.org", "add", 5, False, "a"),
        entry(8, "host", "tie.org", "add", 5, True, "b"),
        entry(9, "host", "same.org", "add", 5),
        entry(10, "host", "same.org", "remove", 5),
        entry(11, "mask", "other.org", "add", 0),
        entry(12, "host", None, "add", 0),
        entry(13, "host", "other.org", "add", None),
        entry(14, "host", "other.org", None, 1),
    ]
    rows = [
        (1, "http://bad.example.com/", 10), (2, "http://bad.example.com/", 20), (3, "http://bad.example.com/x", 31),
        (4, "http://bad.example.com/ok/", 15), (5, "http://bad.example.com/ok/no?x=1", 15),
        (6, "http://bad.example.com/okay", 15), (7, "http://tie.org", 6), (8, "http://same.org", 6),
        (9, "http://other.org", 6), (10, None, 6), (11, "http://tie.org", None), (12, "http://tie.org", 4),
        (13, "http://a.b.example.com", 1), (14, "http://notexample.com", 1), (7, "http://tie.org", 6), (None, "http://tie.org", 7),
    ]
    table = spark.createDataFrame(
        [(i, u, at(m), "k", True) for i, u, m in rows],
        "capture_id long, url string, fetched_at timestamp, kind string, active boolean",
    )
    lists = spark.createDataFrame(entries, ENTRIES)
    found = [(r.capture_id or -1, r.blocked, r.active, r.category) for r in url_lists.judge(table, lists).collect()]
    assert sorted(found) == [
        (-1, False, 2, "c8"), (1, True, 2, "c1"), (2, True, 1, "c4"), (3, True, 2, "c3"), (4, False, 3, "c5"),
        (5, True, 4, "c6"), (6, True, 2, "c1"), (7, False, 2, "c8"), (7, False, 2, "c8"), (8, False, 0, None),
        (9, False, 0, None), (10, False, 0, None), (11, False, 0, None), (12, False, 0, None),
        (13, True, 1, "c4"), (14, False, 0, None),
    ]
    assert url_lists.judge(table.limit(0), lists).count() == 0
    assert not any(r.blocked for r in url_lists.judge(table, lists.limit(0)).collect())


def test_entries_as_people_write_them(spark):
    written = [
        ("prefix", "HTTP://www.Example.com:80/ads/"), ("host", "www.Shop.example"), ("domain", "zip"),
        ("domain", "*.wild.org"), ("prefix", "whole.org/"), ("host", "https://deep.org/x"), ("prefix", "asks.org/?a=1"),
        ("host", "http://"), ("mask", "mask.org"), ("host", None), (None, "none.org"),
    ]
    rows = [(i, "l", kind, value, "add", False, "c", at(0), "k", 1) for i, (kind, value) in enumerate(written)]
    rows += [(20, "l", "host", "late.org", "add", False, "c", None, "k", 1), (21, None, "host", "a.org", "add", False, "c", at(0), "k", 1)]
    rows += [(22, "l", "host", "late.org", "drop", False, "c", at(0), "k", 1)]
    # Written otherwise, but the same entry: it ends the first one.
    rows += [(23, "l", "domain", ".Gone.org", "add", False, "c", at(0), "k", 1), (24, "l", "domain", "gone.org", "remove", False, "c", at(1), "k", 1)]
    entries = spark.createDataFrame(rows, ENTRIES)
    urls = [
        "http://example.com/ads/1", "https://example.com/adsense", "http://shop.example", "http://a.zip/x", "http://zip",
        "http://x.wild.org", "http://whole.org/any/page?q=1", "http://deep.org/x", "http://asks.org/?a=1", "http://gone.org", "http://late.org",
    ]
    table = spark.createDataFrame([(i, u, at(5)) for i, u in enumerate(urls)], "capture_id long, url string, fetched_at timestamp")
    blocked = {r.url: r.value for r in url_lists.judge(table, entries).collect() if r.blocked}
    assert blocked == {
        "http://example.com/ads/1": "example.com/ads", "http://shop.example": "shop.example", "http://a.zip/x": "zip",
        "http://zip": "zip", "http://x.wild.org": "wild.org", "http://whole.org/any/page?q=1": "whole.org",
    }
    flaws = {r.entry_id: r.flaw for r in url_lists.unused(entries).collect()}
    assert flaws == {
        5: "covers no address", 6: "covers no address", 7: "covers no address", 8: "unknown kind", 9: "no value",
        10: "unknown kind", 20: "no date", 21: "no list", 22: "unknown action",
    }
