"""Log lines into entries: mined layouts, entries of many lines, decoys, and written times."""

import random
from datetime import UTC, datetime

import pytest

from tidemark.functions.logtime import parse_time
from tidemark.operators import log_templates as L

NOW = 1_735_689_600_000_000_000  # 2025-01-01
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
MESSAGES = ("loaded {} rows into raw_x", "queue depth is {}", "retrying after error, attempt {}", "step finished: mart_{}", "config: threads={} pool=gpu", "caught [WARN] from child {}")


def message(r):
    return r.choice(MESSAGES).format(r.randint(1, 999))


LAYOUTS = {
    "dash": (lambda r, lv: f"2025-01-01 02:03:04,567 - app.load - {lv} - {message(r)}", "app.load", 1735696984567000),
    "bracket": (lambda r, lv: f"[2025-01-01 02:03:04] [web-agent] {lv.lower()}: {message(r)}", "web-agent", 1735696984000000),
    "bare": (lambda r, lv: f"{lv}:{r.choice(('root', 'app.clean'))}:{message(r)}", None, -1),
    "letter": (lambda r, lv: f"{lv[0]}0101 02:03:04.567891  {r.randint(1, 99999)} {r.choice(('scan_node', 'plan'))}.cc:{r.randint(1, 999)}] {message(r)}", None, 1735696984567891),
    "syslog": (lambda r, lv: f"Jan  1 02:03:04 node-{r.randint(1, 40)} agent[{r.randint(1, 9999)}]: {lv.lower()}: {message(r)}", "agent", 1735696984000000),
    "none": (lambda r, lv: f"2025-01-01 02:03:04.567 UTC [{r.randint(1, 9999)}] {lv}:  {message(r)}", "", 1735696984567000),
    "pipes": (lambda r, lv: f"2025-01-01 03:03:04.567 +0100 | {lv:<8} | {r.choice(('app.load', 'root'))}:{r.choice(('<module>', 'run'))}:{r.randint(1, 500)} - {message(r)}", None, 1735696984567000),
    "pairs": (lambda r, lv: f'level={lv.lower()} ts=1735696984.567 logger="flow::plan" msg="{message(r)}"', "flow::plan", 1735696984567000),
    "json": (lambda r, lv: f'{{"msg": "{message(r)}", "ctx": {{"level": "info"}}, "lvl": "{lv}", "time": 1735696984567, "target": "flow::plan"}}', "flow::plan", 1735696984567000),
    "colour": (lambda r, lv: f"\x1b[2m2025-01-01T02:03:04.567891Z\x1b[0m \x1b[32m {lv}\x1b[0m \x1b[2mflow::exec\x1b[0m: {message(r)}", "flow::exec", 1735696984567891),
}
DECOYS = ("warning signs: none", "Info about raw_x follows", "pipelines.StepError: ERROR in child", "2025-08-20 was the last full day", "    | INFO:child:restarted", "Traceback (most recent call last):", '{', '  "level": "warn",', "}", "", "WHERE d.level = 'ERROR'")


def build(seed, lines=400):
    r = random.Random(seed)
    texts, want = [], []
    for _ in range(lines // 10):
        out, expected = [], []
        for _ in range(10):
            name = r.choice(list(LAYOUTS))
            make, component, us = LAYOUTS[name]
            level = r.choice(LEVELS)
            out.append(make(r, level))
            expected.append((len(out), level.lower(), component, us))
            out += r.sample(DECOYS, r.randint(0, 2))
        texts.append(("\r\n" if r.random() < 0.3 else "\n").join(out))
        want.append(expected)
    return texts, want


@pytest.fixture(scope="module")
def logs(spark):
    texts, want = build(3)
    data = [(i, NOW, t if i % 3 == 0 else None, t if i % 3 == 1 else "", t if i % 3 == 2 else None) for i, t in enumerate(texts)]
    data += [data[0], (9_998, None, None, None, None), (9_999, NOW, "no log line at all\n", "\x00" * 10, "x" * 200_000)]
    schema = "log_id long, timestamp long, stdout string, stderr string, logs string"
    return spark.createDataFrame(data, schema).repartition(5), want


def test_entries_of_all_layouts(spark, logs):
    df, want = logs
    layouts = L.find_layouts(L.mine_templates(df))
    got = L.parse_entries(df, layouts).collect()
    by = {(r.log_id, r.line_no): r for r in got}
    assert len(by) == len(got) == sum(map(len, want))
    for i, expected in enumerate(want):
        for line, level, component, us in expected:
            row = by[i, line]
            assert (row.level, row.ts_us) == (level, us)
            assert component is None or row.component == component
            assert row.n_lines >= 1 and row.message
    assert {r.component for r in got if r.component.endswith(".cc")} == {"scan_node.cc", "plan.cc"}


def test_n_lines_leaves_blank_lines_out(spark, logs):
    reader = L.Reader(L.find_layouts(L.mine_templates(logs[0])))
    text = "lost\nINFO:root:a b\n\n  trace\r\n   \nmore\nERROR:root:last one\n"
    assert [(e[0], e[1], e[3], e[4]) for e in reader.entries(text, NOW)] == [(2, 3, "info", "root"), (7, 1, "error", "root")]
    assert list(reader.entries(text, NOW))[0][5] == "a b\n\n  trace\n   \nmore"


def test_empty_table_has_no_layouts_and_no_entries(spark, logs):
    empty = logs[0].limit(0)
    layouts = L.find_layouts(L.mine_templates(empty))
    assert layouts.plain == [] and L.parse_entries(empty, layouts).count() == 0


def test_lcs_and_templates():
    assert L.lcs(list("abcbdab"), list("bdcaba")) in (list("bcba"), list("bdab"), list("bcab"))
    assert L.generalise(["a", "x", "b", "c"], ["a", "b", "y", "c"]) == ["a", "*", "b", "*", "c"]
    merged = L.Cluster()
    for tokens in (("loaded", "<N>", "rows"), ("loaded", "<N>", "rows"), ("loaded", "many", "rows")):
        merged.add(tokens)
    assert merged.templates == [[["loaded", "*", "rows"], 3]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-11-18T01:43:55.202894123Z", "2024-11-18T01:43:55.202894"), ("2024-11-18 03:18:24,7 +0130", "2024-11-18T01:48:24.700000"), ("17/Nov/2024:20:36:45 -0500", "2024-11-18T01:36:45"),
        ("24/11/18 02:17:44", "2024-11-18T02:17:44"), ("Dec 31 23:59:59", "2024-12-31T23:59:59"), ("Jan  2 00:00:00", "2025-01-02T00:00:00"), ("1231 23:00:00.5", "2024-12-31T23:00:00.500000"),
        ("1731884277.683", "2024-11-17T22:57:57.683000"), ("1731884277683", "2024-11-17T22:57:57.683000"), ("1731884277683111222", "2024-11-17T22:57:57.683111"),
    ],
)
def test_written_times(text, want):
    us = int(datetime.fromisoformat(want).replace(tzinfo=UTC).timestamp() * 1_000_000)
    assert abs(parse_time(text, NOW) - us) <= 1


def test_times_that_are_none():
    for text in ("", "soon", "2024-13-40 00:00:00", "Feb 30 00:00:00"):
        assert parse_time(text, NOW) is None
    assert parse_time("Dec 31 23:59:59", None) is None
