"""Formatting duplicates, term frequency, heavy hitters and seen-before, against brute force."""

from __future__ import annotations

import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from larkspur.llm import heavy_hitters as hh
from larkspur.llm.formatting_duplicates import formatting_duplicates
from larkspur.llm.seen_before import Ribbon, SeenBefore
from larkspur.llm.term_frequency import RadixSpill, term_frequency


def words(text):
    folded = "".join(c.casefold() if len(c.casefold()) == 1 else c.lower() for c in text)
    return tuple("".join(" " if c.isspace() or unicodedata.category(c)[0] == "P" else c for c in folded).split())


def key(query):
    if "=" not in query:
        return ("plain", words(query))
    fields = []
    for field in query.split("&"):
        name, sign, value = field.partition("=")
        if words(name) or words(value):
            fields.append((words(name), sign, words(value)))
    return ("line", tuple(sorted(fields)))


def record_model(rows):
    groups = defaultdict(lambda: (set(), set()))
    for i, query in rows:
        if i is not None and query is not None and any(unicodedata.category(c)[0] in "LN" for c in query):
            groups[key(query)][0].add(i)
            groups[key(query)][1].add(query)
    return {(min(ids), len(ids), len(spellings), min(spellings)) for ids, spellings in groups.values()}


def log(spark, rows):
    # Extra columns bear names that the operators use inside.
    schema = "id long, query string, text string, n long, fields int, lane0 long, value string, digest long"
    return spark.createDataFrame([(i, q, "x", 1, None, 2, "v", 3) for i, q in rows], schema)


QUERIES = [
    "Foo  bar", "foo-bar!", "FOO BAR", "bar foo", "foobar", "größer", "GRÖSSER", "GRÖẞER", "kapı", "kapi", "KAPI", "q=Foo&page=2", "page = 2 & Q=foo", "page=2&q=foo&q=foo",
    "q=foo&q=foo&page=2", "q=foo&page=2&", "q foo page 2", "q&page=2", "q=&page=2", "a=b=c", "a = b=c", "a=c=b", "=", "&=&", "", " ", "...", None, "é", "é",
    "x " * 20_000, "X-" * 20_000, "k=v&" * 3000, "&k = V" * 3000, "1", "１", "page=1&page=2", "page=2&page=1", "a&b=c", "b=c&a",
    "&".join(f"f{k}=v" for k in range(5000)) + "&f1=v", "f1=v&" + "&".join(f"F{k} = v" for k in range(4999, -1, -1)),
]


def test_formatting_duplicates(spark):
    rows = [(k, q) for k, q in enumerate(QUERIES * 2)] + [(0, QUERIES[0])] * 3 + [(None, "Foo bar")]
    got = formatting_duplicates(log(spark, rows)).collect()
    assert {tuple(r) for r in got} == record_model(rows)
    assert len(got) == len(record_model(rows))


def test_colliding_fingerprints_are_told_apart(spark, monkeypatch):
    from larkspur.llm import formatting_duplicates as module

    monkeypatch.setattr(module, "_PRIME", 1)  # every hash is 0
    rows = [(k, q) for k, q in enumerate(QUERIES)]
    assert {tuple(r) for r in formatting_duplicates(log(spark, rows)).collect()} == record_model(rows)


def test_formatting_duplicates_of_an_empty_table(spark):
    assert formatting_duplicates(log(spark, [])).collect() == []


def test_one_record_with_a_third_of_all_rows(spark):
    rows = [(k, "  ".join(["Hot", "query"]) if k % 2 else "hot QUERY") for k in range(1000)] + [(k + 1000, f"q{k}") for k in range(2000)]
    got = {r.first_id: r.n_copies for r in formatting_duplicates(log(spark, rows)).collect()}
    assert got[0] == 1000 and len(got) == 2001


def term_model(rows):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = min(t, texts.get(i, t))
    occurrences, records = Counter(), Counter()
    for t in texts.values():
        occurrences.update(t.split())
        records.update(set(t.split()))

    def mark(n):
        return "rare" if n <= 2 else "common" if 6 * n >= len(texts) else None

    return {(t, occurrences[t], records[t], mark(records[t])) for t in occurrences}


@pytest.mark.parametrize("budget", [48 << 20, 2000])
def test_term_frequency(spark, budget):
    rng = random.Random(1)
    rows = [(k, "  ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(rng.randrange(30)))) for k in range(300)]
    rows += [(1, rows[1][1])] * 2 + [(None, "w1"), (900, None), (901, ""), (902, "z\u0085y\x1cz " * 5000), (1, "w0")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id long, preprocessed_text string, term string, hash int")
    got = term_frequency(frame, task_bytes=budget).collect()
    assert {tuple(r) for r in got} == term_model(rows)
    assert len(got) == len(term_model(rows))
    assert {tuple(r) for r in term_frequency(frame, few=0).collect()} == term_model(rows)
    assert term_frequency(frame.limit(0)).collect() == []


def test_spill_folders_are_named_as_arrow_does():
    from larkspur.llm.term_frequency import _opened_by_arrow

    assert _opened_by_arrow("s3a://bucket/x") == "s3://bucket/x"
    assert [_opened_by_arrow(u) for u in ("file:/a", "/a", "gs://b/c", "hdfs://h/x")] == ["file:/a", "/a", "gs://b/c", "hdfs://h/x"]


def test_radix_spill_splits_again_and_leaves_nothing(tmp_path):
    rng = np.random.default_rng(0)
    hashes = np.concatenate([rng.integers(0, 1 << 52, 3000), np.full(3000, 5)])
    terms = [f"t{h}" for h in hashes]
    table = pa.table({"hash": hashes, "term": terms, "occurrences": np.ones(6000, np.int64), "n_records": np.ones(6000, np.int64)})
    spill = RadixSpill(str(tmp_path), 4000)
    out = pa.Table.from_batches(list(spill.run(iter(table.to_batches(max_chunksize=500)), 3)))
    assert dict(zip(out["term"].to_pylist(), out["occurrences"].to_pylist())) == dict(Counter(terms))
    assert spill.spilled > 2 * 4000 * 16
    assert list(tmp_path.iterdir()) == []


def frequent_model(rows, one_in):
    pairs = {(i, q) for i, q in rows if i is not None}
    total = len({i for i, _ in pairs})
    counts = Counter(q for _, q in pairs if q and any(unicodedata.category(c)[0] in "LN" for c in q))
    return {(q, n) for q, n in counts.items() if n * one_in >= total}


@pytest.mark.parametrize("groups", [1, 64])
def test_heavy_hitters_never_miss(spark, groups):
    rng = random.Random(groups)
    rows = [(k, f"tail {k}" if rng.random() < 0.5 else f"hot {int(rng.paretovariate(1))}") for k in range(4000)]
    rows += [(k + 5000, None if k % 2 else " ?") for k in range(400)] + rows[:300] + [(None, "hot 1")] * 500
    got = hh.heavy_hitters(log(spark, rows), groups=groups).collect()
    assert {(r.value, r.exact_count) for r in got} == frequent_model(rows, 200)
    assert all(r.approx_count >= r.exact_count for r in got)
    assert all(r.n_records == 4400 for r in got)


def test_heavy_hitters_of_small_tables(spark):
    assert hh.heavy_hitters(log(spark, [])).collect() == []
    assert hh.heavy_hitters(log(spark, [(1, None), (2, "")])).collect() == []
    assert [r.value for r in hh.heavy_hitters(log(spark, [(1, "x" * 100_000)])).collect()] == ["x" * 100_000]


def test_lists_too_long_to_decode_call_for_more_groups():
    counters = np.zeros((1, 1, 14, 16), np.int64)
    digests = np.arange(1, 40) * 0x9E3779B97F % (1 << 40)
    hh.add_to_sketch(counters, digests, np.full(len(digests), 10))
    assert not hh.decode(counters, 10)[1]
    wide = np.zeros((3, 256, 14, 16), np.int64)
    hh.add_to_sketch(wide, digests, np.full(len(digests), 10))
    found, whole = hh.decode(wide, 10)
    assert whole and set(digests.tolist()) <= set(found)


def test_code_tells_any_two_messages_apart_in_five_symbols():
    rng = np.random.default_rng(0)
    message = rng.integers(0, 1 << 40, 500).astype(np.uint64)
    for bits in (1, 4, 40):
        other = message ^ rng.integers(1, 1 << bits, 500).astype(np.uint64)
        assert ((hh.encode(message) != hh.encode(other)).sum(axis=1) >= 5).all()


@pytest.mark.parametrize("n", [0, 1, 500, 30_000])
def test_ribbon_has_no_misses_and_few_false_answers(n):
    keys = np.unique(np.random.default_rng(n).integers(-(2**62), 2**62, n))
    ribbon = Ribbon.build(keys, 10)
    assert ribbon.contains(keys).all()
    absent = np.arange(200_000)
    absent = absent[~np.isin(absent, keys)]
    assert ribbon.contains(absent).mean() < 3 / 1024


def test_keys_that_contradict_are_kept_exactly(monkeypatch):
    from larkspur.llm import seen_before as module

    monkeypatch.setattr(module, "_BLOCK_KEYS", 600)  # more keys than slots
    keys = np.arange(3000)
    full = Ribbon.build(keys, 8)
    assert len(full.bumped) > 300
    assert full.contains(keys).all()
    assert full.contains(np.arange(10_000, 60_000)).mean() < 3 / 256


def seen_model(stored, incoming):
    known, out = {k for (k,) in stored}, {}
    for order, key_ in sorted((r for r in incoming if r[0] is not None), key=lambda r: r[0]):
        out[order] = key_ is not None and key_ in known
        known.add(key_)
    return out


def test_seen_before(spark):
    rng = random.Random(2)
    stored = [(rng.randrange(400),) for _ in range(300)] + [(None,)]
    incoming = [(k, 7 if rng.random() < 0.3 else rng.choice([None, rng.randrange(2000), -rng.randrange(9)])) for k in range(3000)] + [(None, 1)]
    rng.shuffle(incoming)
    frames = spark.createDataFrame(stored, "id long"), spark.createDataFrame([(*r, 1, 2) for r in incoming], "arrival_no long, id long, shard int, first int")
    seen = SeenBefore(*frames, generation_rows=250, shard_keys=300, bits=4)
    got = seen.answers().collect()
    assert {r.arrival: r.seen for r in got} == seen_model(stored, incoming)
    assert len(got) == 3000
    report = {r.generation: r for r in seen.report().collect()}
    assert len(report) == 13 and report[0].n_asked is None
    assert sum(r.n_wrong or 0 for r in report.values()) > 0  # four bits answer wrongly at times, and it is reported
    assert 0 < report[0].audit_rate < 0.2


def test_filters_decide_which_keys_are_looked_up(spark):
    stored, incoming = [(k,) for k in range(2000)], [(k, k) for k in range(1000, 4000)]
    frames = spark.createDataFrame(stored, "id long"), spark.createDataFrame(incoming, "arrival_no long, id long")
    looked_up = {}
    for bits in (1, 16):
        seen = SeenBefore(*frames, generation_rows=500, bits=bits)
        assert {r.arrival for r in seen.answers().filter("seen").collect()} == set(range(1000, 2000))
        looked_up[bits] = {r.key for r in seen.looked_up().collect()}
        plan = seen.wrong()._jdf.queryExecution().optimizedPlan().toString()
        assert "(yes" in plan.split("Join")[1]
    # A weak filter says yes to most keys; a strong one to hardly more than those that were seen.
    assert set(range(1000, 2000)) <= looked_up[16] <= looked_up[1] | looked_up[16]
    assert len(looked_up[16]) < 1050 < 2000 < len(looked_up[1])


def test_seen_before_with_empty_tables(spark):
    ids, arrivals = spark.createDataFrame([(1,)], "id long"), spark.createDataFrame([(1, 1), (2, 5)], "arrival_no long, id long")
    assert {r.arrival: r.seen for r in SeenBefore(ids, arrivals).answers().collect()} == {1: True, 2: False}
    assert SeenBefore(ids, arrivals.limit(0)).answers().collect() == []
    assert {r.seen for r in SeenBefore(ids.limit(0), arrivals).answers().collect()} == {False}
