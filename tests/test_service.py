from __future__ import annotations

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from larkspur.api import Engine
from larkspur.operators import ingest, limits, reports, result_cache
from larkspur.sources.feed import StoryFeed, decode_items, top_ids
from larkspur.streaming import reindex, stateful

ITEMS = "arrival_no long, id long, type string, title string, text string, url string, score int"
REQUESTS = "request_id long, ip string, epoch double, q string, page int, page_size int"


def items(spark, rows):
    return spark.createDataFrame(rows, ITEMS)


def test_story_filter_and_projection(spark):
    rows = items(
        spark,
        [
            (1, 10, "story", "A", None, None, 3), (2, 11, "poll", "B", "x", "u", 3), (3, None, "story", "C", "x", "u", 3),
            (4, 12, None, "D", "x", "u", 3), (5, 13, "story", None, "x", "u", 3), (6, 14, "story", "F", "x", "u", None),
        ],
    )
    got = ingest.project_stories(ingest.only_stories(rows)).collect()
    assert got == [(10, "A", "A ", "", 3)]


def test_keyword_is_literal(spark):
    rows = spark.createDataFrame([("100% Rust",), ("100 rust",), (None,)], "title string")
    assert ingest.keyword_filter(rows, "0% R").count() == 1
    assert ingest.keyword_filter(rows, "_").count() == 0
    assert ingest.keyword_filter(rows, None).count() == 3


def test_insert_if_absent_takes_the_first_and_never_updates(spark):
    stored = spark.createDataFrame([(1, "old"), (None, "x")], "id long, title string")
    crawled = spark.createDataFrame([(3, 2, "late"), (2, 2, "first"), (1, 1, "new"), (4, None, "n")], "pos long, id long, title string")
    assert ingest.insert_if_absent(stored, crawled, "pos").collect() == [(2, "first")]
    assert ingest.insert_if_absent(stored, crawled.limit(0), "pos").collect() == []
    assert ingest.insert_if_absent(stored.limit(0), crawled, "pos").count() == 2


def test_reports(spark):
    at = dt.datetime(2026, 1, 1)
    rows = [(1, "a", 0, at), (2, "a", 3, at), (3, "b", 0, None), (4, None, 0, at), (5, "A", None, at), (1, "a", 0, at)]
    log = reports.once(spark.createDataFrame(rows, "id long, query string, results_count int, timestamp timestamp"))
    assert reports.top_searches(log).collect() == [("#1", "a", 2), ("#2", "A", 1), ("#3", "b", 1), ("#4", None, 0)]
    assert [r.query for r in reports.zero_searches(log).collect()] == ["b", None, "a"]
    assert reports.top_searches(log.limit(0)).collect() == []


def limiter_model(rows, limit, window):
    out, seen = {}, {}
    for rid, ip, us in sorted(rows, key=lambda r: (r[2], r[0])):
        past = [t for t in seen.get(ip, []) if t > us - window]
        out[rid] = "allow" if len(past) < limit else "reject"
        seen[ip] = [*past, us]
    return out


def bursty(seed, n=300):
    rng = random.Random(seed)
    now, rows = 1_767_225_600.0, []
    for i in range(n):
        now += rng.choice([0, 0, 0.001, 0.4, 3, 59.999, 60, 700])
        rows.append((i, rng.choice(["a", "a", "a", "b", None]), round(now, 3), rng.choice(["x", " ", "yy", None]), rng.choice([1, None, 0]), 5))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_limiter_matches_model(spark, seed):
    rows = bursty(seed)
    got = limits.admit(spark.createDataFrame(rows, REQUESTS), limit=4).collect()
    want = limiter_model([(r[0], r[1], round(r[2] * 1e6)) for r in rows], 4, 60_000_000)
    assert {r.request_id: r.decision for r in got} == want
    assert len(got) == len(rows)


def test_limiter_window_edge(spark):
    rows = [(1, "a", 0.0), (2, "a", 59.999999), (3, "a", 60.0), (4, "a", 60.0), (5, "a", None)]
    got = limits.admit(spark.createDataFrame(rows, "request_id long, ip string, epoch double"), limit=1).collect()
    assert {r.request_id: r.prior for r in got} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_debounce(spark):
    rows = [(1, "a", 1.0, "da"), (2, "a", 1.299, "dat"), (3, "a", 1.599, "data"), (4, "a", 9.0, "d"), (5, "b", 1799.9, "xx"),
            (6, "b", 1800.1, "xy"), (7, "c", 1.0, "  "), (8, "c", 5.0, None)]
    got = limits.debounce(spark.createDataFrame(rows, "request_id long, ip string, epoch double, q string"))
    assert sorted(r.request_id for r in got.collect()) == [2, 3, 6]


def cache_model(rows, ttl):
    out, expires = {}, {}
    valid = [(r[0], r[2], (r[3], 1 if r[4] is None else r[4], r[5])) for r in rows if r[3] is not None and r[4] != 0]
    for rid, epoch, key in sorted(valid, key=lambda r: (r[1], r[0])):
        us = round(epoch * 1e6)
        out[rid] = "hit" if us < expires.get(key, -1) else "miss"
        if out[rid] == "miss":
            expires[key] = us + ttl * 1_000_000
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cache_outcomes_match_model(spark, seed):
    rows = bursty(seed)
    got = result_cache.outcomes(spark.createDataFrame(rows, REQUESTS), ttl_seconds=700).collect()
    assert {r.request_id: r.outcome for r in got} == cache_model(rows, 700)


def test_cache_put_and_get(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    pages = spark.createDataFrame([("x", 1, 5, "v")], "q string, page int, page_size int, value string")
    stored = result_cache.put(pages, at(0)).unionByName(result_cache.put(pages.withColumn("value", F.lit("w")), at(10)))
    asked = spark.createDataFrame([("x", 1, 5), ("X", 1, 5)], "q string, page int, page_size int")
    assert {(r.q, r.value) for r in result_cache.get(asked, stored, at(3609)).collect()} == {("x", "w"), ("X", None)}
    assert {r.value for r in result_cache.get(asked, stored, at(3610)).collect()} == {None}


def run_stream(spark, tmp_path, rows, build, name):
    for part in range(3):
        own = rows[part * len(rows) // 3 : (part + 1) * len(rows) // 3]
        spark.createDataFrame(own, REQUESTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = build(stream).writeStream.format("memory").queryName(name).outputMode("append")
    query = query.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    return spark.table(name).collect()


def test_stateful_limiter_agrees_with_batch(spark, tmp_path):
    rows = bursty(5, 120)
    got = run_stream(spark, tmp_path, rows, lambda s: stateful.admit_stream(s, limit=4), "admitted")
    want = limits.admit(spark.createDataFrame(rows, REQUESTS), limit=4).collect()
    assert {r.request_id: (r.prior, r.decision) for r in got} == {r.request_id: (r.prior, r.decision) for r in want}


def test_stateful_cache_agrees_with_batch(spark, tmp_path):
    rows = bursty(6, 120)
    got = run_stream(spark, tmp_path, rows, lambda s: stateful.cache_stream(s, ttl_seconds=700), "cached")
    assert {r.request_id: r.outcome for r in got} == cache_model(rows, 700)


def test_streamed_ingestion(spark, tmp_path):
    batches = [[(1, 1, "story", "Running Dogs", None, None, 5), (2, 2, "poll", "x", "x", "x", 1)], [(3, 1, "story", "Changed", "b", "u", 9), (4, 3, "story", "Cats", "", "u", 2)]]
    flushed = []
    for batch in batches:
        items(spark, batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(ITEMS).parquet(str(tmp_path / "in"))
        query = reindex.start(stream, str(tmp_path / "stories"), str(tmp_path / "state"), every=None, flush=lambda: flushed.append(1))
        assert query.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "stories")).orderBy("id").collect()
    assert [(r.id, r.title, r.preprocessed_text) for r in got] == [(1, "Running Dogs", "run dog"), (3, "Cats", "cat")]
    assert len(flushed) == 2


@pytest.fixture
def feed(tmp_path):
    bodies = {
        1: {"id": 1, "type": "story", "title": "Fast database engines", "score": 5, "url": "u"},
        2: {"id": 2, "type": "comment", "text": "no"},
        3: {"id": 3, "type": "story", "title": "Slow cats", "text": "databases sleep", "score": 1},
        4: None,
    }
    (tmp_path / "item").mkdir()
    (tmp_path / "topstories.json").write_text(json.dumps([3, 1, 2, 4, 99, 1]))
    for k, body in bodies.items():
        (tmp_path / "item" / f"{k}.json").write_text(json.dumps(body))
    return f"file://{tmp_path}"


def test_feed(spark, feed):
    spark.dataSource.register(StoryFeed)
    bodies = spark.read.format("story_feed").option("base_url", feed).option("limit", 5).load()
    assert sorted(r.item_id for r in bodies.collect()) == [1, 2, 3, 4, 99]
    got = decode_items(bodies).orderBy("rank").collect()
    assert [(r.rank, r.id, r.type) for r in got] == [(0, 3, "story"), (1, 1, "story"), (2, 2, "comment")]
    assert [r.id for r in top_ids(decode_items(bodies), 2).collect()] == [1, 3]


def test_an_item_that_cannot_be_read_is_dropped(spark, feed, tmp_path):
    (tmp_path / "item" / "2.json").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "item" / "4.json").write_text('{"id": 4, ')
    spark.dataSource.register(StoryFeed)
    got = decode_items(spark.read.format("story_feed").option("base_url", feed).option("limit", 5).load())
    assert sorted(r.id for r in got.collect()) == [1, 3]


def test_live_limiter_decides_as_over_a_log(spark):
    rows = bursty(7, 150)
    limiter, got = limits.Limiter(limit=4), {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        try:
            limiter.check(r[1], r[2])
            got[r[0]] = "allow"
        except limits.TooManyRequests:
            got[r[0]] = "reject"
    want = limits.admit(spark.createDataFrame(rows, REQUESTS), limit=4).collect()
    assert got == {r.request_id: r.decision for r in want}


def test_engine_recrawls_starts_from_stored_stories_and_limits_clients(spark, feed, tmp_path):
    root = str(tmp_path / "service")
    engine = Engine(spark, root, limiter=limits.Limiter(limit=2))
    with pytest.raises(LookupError):
        engine.search("database")
    assert engine.reindex(feed) == "Reindexed 3 stories"  # one is listed twice
    again = Engine(spark, root, limiter=limits.Limiter(limit=2))  # indexes what is stored
    assert [r["id"] for r in again.search("cats", page_size=1, client="a").results] == [3]
    (tmp_path / "topstories.json").write_text(json.dumps([5]))
    (tmp_path / "item" / "5.json").write_text(json.dumps({"id": 5, "type": "story", "title": "Zebra database", "score": 2}))
    query = again.start_reindexing(feed, str(tmp_path / "state"), every=None)
    assert query.awaitTermination(120)
    for _ in range(3):
        again.build()
    assert len(again._versions()) == 2
    assert again.search("zebra", page_size=1, client="a").results[0]["id"] == 5
    with pytest.raises(limits.TooManyRequests):
        again.search("zebra", client="a")
    assert again.search("zebra", page_size=1, client="b").cache == "hit"


def test_engine(spark, feed, tmp_path):
    engine = Engine(spark, str(tmp_path / "service"))
    assert engine.index(engine.crawl(feed)) == "Indexed 2 new stories"
    assert engine.index(engine.crawl(feed)) == "Indexed 0 new stories"
    first = engine.search("database", page_size=1)
    assert (first.total, first.total_pages, first.cache) == (1, 1, "miss")
    again = engine.search("database", page_size=1)
    assert again.cache == "hit" and again.results == first.results
    assert len(engine.search("database").results) == 2
    engine.flush()
    assert engine.search("database", page_size=1).cache == "miss"
    assert engine.autocomplete("da") == ["database"]
    assert engine.top_searches().collect() == [("#1", "database", 3)]
    assert engine.zero_searches().collect() == []
    with pytest.raises(ValueError):
        engine.search("x", page=0)
    newer = spark.createDataFrame([(0, 7, "story", "Database news", "", "u", 4)], ITEMS.replace("arrival_no long", "rank int"))
    assert engine.index(newer, corpus="latest") == "Indexed 1 new stories"
    assert [r["id"] for r in engine.search("database").results] == [7]
    engine.build()
    engine.flush()
    assert {r["id"] for r in engine.search("database").results} == {1, 3, 7}
