"""Temporal list join against a plain replay of the list's history."""

import datetime as dt
import random

from salesflow.llm.url_filters import filter_captures, longest_entries, query, url_keys, validity_intervals

T0 = dt.datetime(2024, 1, 1)
SF = "/root/testdata/sf0.001"


def at(hours):
    return None if hours is None else T0 + dt.timedelta(hours=hours)


def frames(spark, captures, entries):
    c = spark.createDataFrame([(k, u, at(h), "x", "y") for k, u, h in captures], "page_id bigint, url string, fetched_at timestamp, k string, list_name string")
    e = spark.createDataFrame([(a, b, c_, at(h), 1) for a, b, c_, h in entries], "list_name string, url_key string, action string, listed_at timestamp, url int")
    return c, e


def run(spark, captures, entries):
    return {(r.page_id, r.url, r.fetched_at): (r.url_host, r.n_entries, r.first_list, r.first_key, r.blocked) for r in filter_captures(*frames(spark, captures, entries)).collect()}


def plain_keys(url):
    """Keys by plain string work, for URLs without odd parts."""
    host, *parts = [p for p in url.split("://")[1].split("/") if p]
    labels = host.split(".")
    return ["d:" + ".".join(labels[i:]) for i in range(len(labels))] + ["p:" + "/".join([host, *parts[:i + 1]]) for i in range(len(parts))]


def replay(captures, entries):
    out = {}
    for key, url, h in captures:
        active = []
        for name, k in {e[:2] for e in entries}:
            said = sorted((e[3], e[2]) for e in entries if e[:2] == (name, k) and e[3] <= h)
            if k in plain_keys(url) and said and said[-1][1] == "add":
                active.append((name, k))
        first = min(active, default=(None, None))
        out[key, url, at(h)] = (url.split("/")[2], len(active), *first, bool(active))
    return out


def test_against_a_replay(spark):
    rng = random.Random(3)
    url = lambda: "https://" + ".".join(rng.choices("abc", k=rng.randint(1, 4))) + "".join("/" + rng.choice("xy") for _ in range(rng.randint(0, 4)))
    captures = [(i, url(), rng.randint(0, 200)) for i in range(150)]
    entries = [(rng.choice(["one", "two"]), rng.choice(plain_keys(rng.choice(captures)[1])), rng.choice(["add", "add", "remove"]), rng.randint(0, 200)) for _ in range(400)]
    assert run(spark, captures, entries) == replay(captures, entries)


def test_the_time_of_the_fetch_decides(spark):
    entries = [("l", "d:a.b", "add", 20), ("l", "d:a.b", "remove", 22), ("l", "d:c", "add", 5), ("l", "d:c", "remove", 5)]
    got = run(spark, [(1, "http://a.b/", 8), (2, "http://a.b/", 20), (3, "http://a.b/", 21), (4, "http://a.b/", 22), (5, "http://c/", 9)], entries)
    assert {k[0]: v[-1] for k, v in got.items()} == {1: False, 2: True, 3: True, 4: False, 5: False}
    spans = validity_intervals(frames(spark, [], [*entries, ("l", "d:a.b", "add", 21), ("l", None, "add", 1), (None, "d:z", "add", 1)])[1])
    assert [(r.url_key, r.valid_from, r.valid_to) for r in spans.collect()] == [("d:a.b", at(20), at(22))]


def test_entries_of_any_depth(spark):
    host = ".".join(f"l{i}" for i in range(11))
    path = "/".join(f"s{i}" for i in range(12))
    entries = [("l", "d:" + host, "add", 0), ("l", "p:h.x/" + "/".join(f"s{i}" for i in range(10)), "add", 0)]
    got = run(spark, [(1, f"http://{host}/a", 1), (2, f"http://h.x/{path}", 1), (3, "http://h.x/s0/s1", 1)], entries)
    assert {k[0]: v[-1] for k, v in got.items()} == {1: True, 2: True, 3: False}
    assert longest_entries(frames(spark, [], entries)[1]) == (11, 10) and longest_entries(frames(spark, [], [])[1]) == (0, 0)


def test_odd_urls_nulls_repeats_and_empty_tables(spark):
    entries = [("l", "d:host.org", "add", 0), ("l", "p:host.org/Path", "add", 0)]
    captures = [(1, "HTTP://user:pw@Host.ORG:8080/Path?q=/x#f", 1), (2, None, 1), (3, "not a url", 1), (None, "http://host.org", 1), (5, "http://host.org/path", None),
                (6, "http://sub.host.org", 1), (6, "http://sub.host.org", 1), (7, "http://nothost.org/", 1), (8, "", 1)]
    got = run(spark, captures, entries)
    assert len(got) == 8
    assert {k[0]: (v[0], v[1]) for k, v in got.items()} == {1: ("host.org", 2), 2: (None, 0), 3: (None, 0), None: ("host.org", 1), 5: ("host.org", 0),
                                                            6: ("sub.host.org", 1), 7: ("nothost.org", 0), 8: (None, 0)}
    assert run(spark, [], entries) == {} and not any(v[-1] for v in run(spark, captures, []).values())
    keys = spark.createDataFrame([("http://a.b.c/x/y",)], "u string").select(url_keys("u"), url_keys("u", 2, 1)).first()
    assert sorted(keys[0]) == ["d:a.b.c", "d:b.c", "d:c", "p:a.b.c/x", "p:a.b.c/x/y"] and sorted(keys[1]) == ["d:b.c", "d:c", "p:a.b.c/x"]


def test_query_runs_over_all_pages(spark):
    assert query(spark, SF).count() == spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url").distinct().count()
