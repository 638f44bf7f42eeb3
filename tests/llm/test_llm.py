"""Percentiles, the tokenizer, packing and subjects against brute force, exact round trips and held-out labels."""

import bisect
import random
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import bpe, packing, quantiles, subjects
from tidemark.llm.queries import LLM

SF = "/root/testdata/sf0.001"
VOCABULARY = Path(bpe.TOKENIZERS) / bpe.BYTE_BPE
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no tokenizer files")
DAY = 86_400_000_000_000
CHECKS = settings(deadline=None, suppress_health_check=list(HealthCheck))


@pytest.mark.skipif(not Path(SF).exists() or not VOCABULARY.exists(), reason="no test data")
@pytest.mark.parametrize("name", sorted(LLM.queries))
def test_queries_run(spark, name):
    assert LLM.queries[name](spark, SF).count() > 0


def check_percentiles(spark, data, epsilon, **kw):
    """data: (eval_id, key, ns, value); checks every answer against the sorted values."""
    df = spark.createDataFrame(data, "eval_id long, key string, at long, value long").withColumn("n", F.lit("clash"))
    got = quantiles.percentile_table(df.repartition(7), "eval_id", "key", "at", "value", epsilon=epsilon).collect()
    values = defaultdict(list)
    for _, key, at, value in {(i, k, a, v) for i, k, a, v in data if None not in (k, a, v) and v >= 0}:
        for period in ("", str(np.datetime64(at // DAY, "D"))):
            values[key, period].append(value)
    assert {(r["key"], r["period"]) for r in got} == set(values) and len(got) == len(values)
    for r in got:
        ordered = sorted(values[r["key"], r["period"]])
        assert r["n"] == len(ordered) and r["max_rank_error"] <= epsilon * r["n"]
        for p in (50, 90, 95, 99):
            rank, v = -(-r["n"] * p // 100), r[f"p{p}"]
            low, high = bisect.bisect_left(ordered, v) + 1, bisect.bisect_right(ordered, v)
            assert high >= low and max(0, low - rank, rank - high) <= r["max_rank_error"]


def test_percentiles_within_the_stated_error_with_a_hot_key(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FAN_IN", 2)
    r = random.Random(1)
    data = [(i, "hot" if i % 3 else f"k{i % 40}", r.randint(0, 9) * DAY, int(r.paretovariate(0.4)) if i % 2 else r.randint(0, 5)) for i in range(20_000)]
    check_percentiles(spark, data + data[:500], 0.02)


def test_parts_of_a_task_meet_before_tasks_do(spark):
    r = random.Random(8)
    data = [("hot" if i % 3 else "cold", 5, r.randint(0, 10**6)) for i in range(6_000)]
    values = spark.createDataFrame(data, "key string, day int, value long").repartition(3)
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(batch, "200")
    parts = quantiles.leaf_summaries(values, 0.01, chunk_rows=500).groupBy("key", "chunk").agg(F.count_distinct("part").alias("n"), F.count(F.lit(1)).alias("rows"))
    assert all(p.n == p.rows > 1 for p in parts.collect())
    got = quantiles.read_percentiles(quantiles.day_summaries(values, 0.02, fan_in=2, chunk_rows=500), [50, 99]).collect()
    spark.conf.unset(batch)
    assert len(got) == 2 and quantiles.rounds_of(1, 2) == 0 and quantiles.rounds_of(17, 16) == 2
    for row in got:
        ordered = sorted(v for k, _, v in data if k == row.key)
        assert row.n == len(ordered) and row.max_rank_error <= 0.02 * row.n
        for p in (50, 99):
            assert abs(bisect.bisect_left(ordered, row[f"p{p}"]) + 1 - -(-row.n * p // 100)) <= row.max_rank_error + 1


def test_percentiles_of_nulls_negatives_and_ties(spark):
    data = [(1, "a", 0, None), (2, "a", 0, -5), (3, "a", 0, 7), (3, "a", 0, 7), (4, "a", -1, 7), (5, None, 0, 1), (6, "b", None, 1), (7, "c", 0, 2**62), (8, "d", 0, None)]
    check_percentiles(spark, data, 0.01)
    empty = spark.createDataFrame([], "eval_id long, key string, at long, value long")
    assert quantiles.percentile_table(empty, "eval_id", "key", "at", "value").count() == 0


@CHECKS
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=60), min_size=1, max_size=7), st.integers(1, 9))
def test_summaries_bound_every_rank(parts, width):
    sources = []
    for i, part in enumerate(parts):
        v = np.sort(np.array(part, dtype=np.int64))
        zero = np.zeros(len(v), dtype=np.int64)
        _, v, g, d = quantiles.compress(zero, v, np.ones_like(v), zero, np.full(len(v), width))
        sources.append((np.full(len(v), i), v, g, d))
    source, v, g, d = (np.concatenate(x) for x in zip(*sources, strict=True))
    group, v, g, d = quantiles.merge_all(np.zeros(len(v), dtype=np.int64), source, v, g, d)
    group, v, g, d = quantiles.compress(group, v, g, d, np.full(len(v), width))
    everything = sorted(x for p in parts for x in p)
    low = np.cumsum(g)
    assert low[-1] == len(everything) and v[0] == everything[0]
    for value, a, b in zip(v, low, low + d, strict=True):
        first, last = bisect.bisect_left(everything, value) + 1, bisect.bisect_right(everything, value)
        assert first <= b and a <= last  # some place of the value lies in the interval


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary.load(str(VOCABULARY))


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(str(Path(bpe.TOKENIZERS) / "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


PIECES = st.text(alphabet="ab 's're\n\t12é漢🚨<|endoftxt>!=\x00　", max_size=30)


@needs_vocabulary
@CHECKS
@given(st.one_of(PIECES, st.text(max_size=40)))
def test_encoding_equals_the_public_one_and_decodes(words, reference, text):
    ids = words.encode(text)
    assert ids == reference(text) and b"".join(words.token[i] for i in ids) == text.encode() and words.count(text) == len(ids)


@needs_vocabulary
@CHECKS
@given(PIECES, st.lists(st.tuples(st.integers(0, 40), st.integers(0, 8), PIECES), max_size=4))
def test_edits_give_what_encoding_anew_gives(words, reference, text, edits):
    kept = bpe.EncodedText(words, text)
    table = bpe.PrefixTable(words, text.encode())
    for start, length, new in edits:
        start = min(start, len(kept.text))
        end = min(start + length, len(kept.text))
        a, b = len(kept.text[:start].encode()), len(kept.text[:end].encode())
        kept.replace(start, end, new)
        table.replace(a, b, new.encode())
        assert kept.ids() == reference(kept.text)
    kept.append("'re")
    assert kept.ids() == reference(kept.text)
    assert table.ids() == bpe.PrefixTable(words, table.data).ids()


@needs_vocabulary
def test_prefix_tables_without_the_automaton(words):
    plain = bpe.Vocabulary(dict(words.ranks))
    plain._ends = None
    for data in (b"", b"hello world", b"=" * 700, "ünïcode 漢字".encode(), bytes(range(256))):
        a, b = bpe.PrefixTable(words, data), bpe.PrefixTable(plain, data)
        assert a.last == b.last and b"".join(words.token[i] for i in a.ids()) == data


@needs_vocabulary
def test_encode_column(spark, reference):
    texts = [None, "", " ", "<|endoftext|>", "a" * 30_000, "x y" * 20_000, "same", "same", "\x00퟿"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(1))
    got = {r.doc_id: r.ids for r in bpe.encode_column(df).collect()}
    assert got == {i: reference(t) if t else [] for i, t in enumerate(texts)}
    assert {r.doc_id: r.n_tokens for r in bpe.count_column(df).collect()} == {i: len(x) for i, x in got.items()}
    assert bpe.encode_column(df.limit(0)).count() == 0


def check_containers(df, items, limits):
    got = df.collect()
    whole = defaultdict(int)
    loads = defaultdict(list)
    for r in got:
        whole[r.doc_id] += r.size
        loads[r.container].append(r.size)
    want = defaultdict(int)
    for key, size in items:
        if size and size > 0:
            want[key] += size
    assert whole == want and len({(r.doc_id, r.piece) for r in got}) <= len(got)
    tokens, documents, attention = limits.vector()
    assert all(sum(x) <= tokens and len(x) <= documents and sum(s * s for s in x) <= attention for x in loads.values())
    assert sorted(loads) == list(range(len(loads)))
    return len(loads)


def test_packing(spark):
    r = random.Random(2)
    items = [(i, r.choice([1, 7, 7, 7, r.randint(1, 300), 2048, r.randint(2049, 9000)])) for i in range(3_000)] + [(-1, 0), (-2, None), (-3, 5000)]
    df = spark.createDataFrame(items, "doc_id long, n_tokens long").repartition(6).withColumn("container", F.lit("clash"))
    limits = packing.Limits(2048)
    used = check_containers(packing.pack(df, limits=limits), items, limits)
    least = -(-sum(s or 0 for _, s in items) // 2048)
    assert used <= least * 1.01 + 1
    pieces = rows(packing.pack(df.filter("doc_id = -3")), "piece", "size")
    assert pieces == [(0, 2048), (1, 2048), (2, 904)]
    assert packing.pack(df.limit(0)).count() == 0 and packing.pack(df.filter("doc_id IN (-1, -2)")).count() == 0


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_packing_under_every_constraint(spark, score):
    r = random.Random(5)
    items = [(i, r.randint(1, 100)) for i in range(500)]
    limits = packing.Limits(256, documents=5, attention=12_000, weights=(1.0, 0.5, 0.5), score=score)
    df = spark.createDataFrame(items, "doc_id long, n_tokens long")
    check_containers(packing.pack(df, limits=limits), items, limits)
    with pytest.raises(ValueError):
        packing.plan({300: 1}, limits)
    assert limits.piece() == 109
    long = spark.createDataFrame([(1, 250), (2, 3), (3, 110)], "doc_id long, n_tokens long")
    assert rows(packing.pack(long, limits=limits), "doc_id", "piece", "size") == [(1, 0, 109), (1, 1, 109), (1, 2, 32), (2, 0, 3), (3, 0, 109), (3, 1, 1)]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
def test_plans_place_every_item_once_and_within_twice_the_least(histogram):
    runs = packing.plan(histogram, packing.Limits(50))
    placed = defaultdict(int)
    loads = defaultdict(int)
    for run in runs:
        assert run.first_item == placed[run.size]
        placed[run.size] += run.items
        for i in range(run.items):
            loads[run.first + i // run.per] += run.size
    assert placed == histogram and all(v <= 50 for v in loads.values()) and sorted(loads) == list(range(len(loads)))
    assert len(loads) <= 11 / 9 * (-(-sum(s * n for s, n in histogram.items()) // 50)) * 1.5 + 1


TERMS = {"law": ["court", "statute", "verdict", "appeal", "lawyer"], "food": ["bread", "kitchen", "recipe", "soup", "menu"], "software": ["compiler", "thread", "linter", "stack", "registry"]}
NEUTRAL = ["the run took long", "nothing else changed", "see the step log for details", "slots were free again", "we will look tomorrow"]


def corpus(n, seed):
    r = random.Random(seed)
    docs, truth = [], {}
    for i in range(n):
        main = r.sample(list(TERMS), r.choice([1, 1, 1, 2])) if r.random() < 0.85 else []
        sentences = [f"numbers for {r.choice(TERMS[s])} and {r.choice(TERMS[s])} look right" for s in main for _ in range(r.randint(3, 6))] + r.sample(NEUTRAL, r.randint(1, 4))
        if r.random() < 0.2:
            other = r.choice(list(TERMS))
            sentences += [] if other in main else [f"a note on {r.choice(TERMS[other])}"]
        r.shuffle(sentences)
        docs.append((i, ". ".join(sentences) + ".", "mail:x", "en"))
        truth[i] = set(main) or {"software"}
    return docs, truth


def test_subjects_on_held_out_documents(spark):
    docs, truth = corpus(3_000, 7)
    labels = [(i, s) for i in range(500) for s in truth[i]]
    odd = [(10_000, None), (10_001, ""), (10_002, " \n"), (10_003, "?!... --"), (10_004, "数据管道已完成"), (10_005, "raw_x_daily 17"), (10_006, "court " * 50_000)]
    frame = spark.createDataFrame([*docs, *[(i, t, None, None) for i, t in odd]], "doc_id long, text string, source string, lang string").withColumn("known", F.lit("clash")).withColumn("mask", F.lit(9))
    named = spark.createDataFrame([(s,) for s in [*TERMS, *TERMS]], "subject string")
    label_frame = spark.createDataFrame([*labels, (None, "law"), (1, "nonsense"), (77_777, "law")], "doc_id long, subject string")
    got = defaultdict(set)
    for r in subjects.assign_subjects(frame, label_frame, named, ["source"], "software", whole=True).collect():
        assert 0 <= r.posterior <= 1
        got[r.doc_id].add(r.subject)
    held = [i for i in truth if i >= 500]
    hit = sum(len(got[i] & truth[i]) for i in held)
    precision, recall = hit / sum(len(got[i]) for i in held), hit / sum(len(truth[i]) for i in held)
    assert precision > 0.95 and recall > 0.95
    assert not any(i in got for i in range(10_000, 10_004))
    assert got[10_004] == got[10_005] == {"software"} and got[10_006]


def test_composition_sums_all_posteriors(spark):
    docs, truth = corpus(900, 11)
    frame = spark.createDataFrame([*docs, (5_000, " ", "mail:x", "en")], "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, s) for i in range(300) for s in truth[i]], "doc_id long, subject string")
    named = spark.createDataFrame([(s,) for s in TERMS], "subject string")
    every = subjects.assign_subjects(frame, labels, named, ["lang"], "software", threshold=0.0)
    want = {r.subject: (r.n, round(r.e, 6)) for r in every.groupBy("subject").agg(F.count_if(F.col("posterior") >= 0.5).alias("n"), F.sum("posterior").alias("e")).collect()}
    assert every.count() == 900 * 3 and want["law"][1] > 0
    got = subjects.compose_subjects(frame, labels, named, ["lang"], "software").collect()
    assert {r.subject: (r.n_documents, round(r.expected_documents, 6)) for r in got} == want and {r.lang for r in got} == {"en"}
    assert subjects.compose_subjects(frame, labels, named.limit(0), ["lang"]).count() == 0


def test_each_subject_is_calibrated_by_itself():
    r = np.random.default_rng(3)
    truth = (r.random((4_000, 3)) < [0.5, 0.1, 0.3]).astype(int)
    # The first subject is seldom mentioned in passing, the third often: the same votes mean less for it.
    passing = r.random(truth.shape) < [0.02, 0.2, 0.6]
    votes = np.column_stack([truth * r.integers(1, 4, truth.shape) + passing * r.integers(1, 4, truth.shape), r.integers(0, 4, 4_000)]).astype(float)
    fitted, fresh = slice(0, 2_000), slice(2_000, None)
    weights = subjects.calibrate(votes[fitted], truth[fitted], None)
    error = lambda p: [subjects.calibration_error(p[:, c], truth[fresh][:, c]) for c in range(3)]
    own = error(subjects.posteriors(votes[fresh], weights, None))
    x = subjects.vote_features(votes[fitted], None)
    pooled = subjects.fit_logistic(x.reshape(-1, x.shape[-1]), truth[fitted].reshape(-1).astype(float))
    assert max(own) < 0.05 and sum(own) < 0.7 * sum(error(subjects.posteriors(votes[fresh], np.tile(pooled, (3, 1)), None)))
    assert subjects.calibration_error(np.array([0.5, 0.5]), np.array([1, 0])) == 0 and subjects.calibration_error(np.array([1.0]), np.array([0])) == 1


def test_subjects_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words"), (1, "some words")], "doc_id long, text string")
    labels, named = spark.createDataFrame([], "doc_id long, subject string"), spark.createDataFrame([("law",), ("software",)], "subject string")
    assert rows(subjects.assign_subjects(docs, labels, named, fallback="software"), "doc_id", "subject") == [(1, "software")] * 2
    assert subjects.assign_subjects(docs, labels, named).count() == 0
    assert subjects.assign_subjects(docs.limit(0), labels, named, fallback="software").count() == 0
    assert subjects.assign_subjects(docs, labels, named.limit(0), fallback="software").count() == 0
    one = spark.createDataFrame([(1, "law")], "doc_id long, subject string")
    assert subjects.assign_subjects(docs, one, named, whole=True).count() >= 2 and subjects.compose_subjects(docs, one, named, ["doc_id"]).count() >= 1
