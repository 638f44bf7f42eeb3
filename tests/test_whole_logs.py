"""Programs that are rare, share their opening with another or use another's keys keep their entries."""

import pandas as pd
import pytest

from tidemark.operators import log_templates as L

NOW = 1_735_689_600_000_000_000  # 2025-01-01
SCHEMA = "log_id long, timestamp long, stdout string, stderr string, logs string"
AT = "2025-01-01 02:03:04"
LEVELS = ("INFO", "WARN", "ERROR", "DEBUG")
MESSAGES = ("loaded {} rows", "queue depth is {}", "attempt {} failed", "finished after {} seconds", "config: {} threads", "no lease for slot {}")


def program(n, form):
    return [form.format(level=LEVELS[i % 4], low=LEVELS[i % 4].lower(), comp=("app.load", "root", "flow")[i % 3], msg=MESSAGES[i % 6].format(i)) for i in range(n)]


PLAIN, NAMED = AT + " {level} {msg}", AT + " {level} {comp}: {msg}"


def read(spark, *programs):
    """Per program the (level, component) of its lines' entries, each line a text of its own."""
    lines = [line for p in programs for line in p]
    df = spark.createDataFrame([(i, NOW, t, None, None) for i, t in enumerate(lines)], SCHEMA)
    got = {r.log_id: (r.level, r.component) for r in L.parse_entries(df, L.find_layouts(L.mine_templates(df))).collect()}
    out, at = [], 0
    for p in programs:
        out.append([got.get(at + i) for i in range(len(p))])
        at += len(p)
    return out


def test_a_rare_program_keeps_its_layout(spark):
    heavy, rare = program(60_000, "[{level}] " + AT + " {comp}: {msg}"), program(4, "<" + AT + "> {level} {msg}")
    assert [x[0] for x in read(spark, heavy, rare)[1]] == ["info", "warn", "error", "debug"]


@pytest.mark.parametrize(("named", "bare"), [(950, 50), (600, 400), (300, 700)])
def test_programs_that_share_an_opening(spark, named, bare):
    first, second = read(spark, program(named, NAMED), program(bare, PLAIN))
    assert [x[1] for x in first] == [("app.load", "root", "flow")[i % 3] for i in range(named)]
    assert None not in second and all(x[1] == "" for i, x in enumerate(second) if i % 6 != 4)


def test_keys_are_typed_by_their_set(spark):
    heavy = ['{"level": "info", "time": 1735696984567, "target": %d, "msg": "a b"}' % i for i in range(2000)]
    light = ['{"level": "warn", "target": "flow::plan", "msg": "a b", "seq": %d}' % i for i in range(40)]
    assert read(spark, heavy, light)[1] == [("warn", "flow::plan")] * 40


def test_templates_of_one_head_merge_with_their_levels():
    rows = pd.DataFrame([("plain", "o", "h", '["a", "b"]', 2, 1, None), ("plain", "o", "h", '["a", "b"]', 3, 4, None)], columns=L.COLUMNS)
    assert L.merge_templates(rows)[["lines", "levels"]].values.tolist() == [[5, 5]]


def test_three_lines_of_one_level_are_a_program(spark):
    heavy, rare = program(30_000, "[{level}] " + AT + " {comp}: {msg}"), [f"{AT},{i}00 [main] WARN {m}" for i, m in enumerate(("disk is full", "lease lost", "no reply"))]
    assert read(spark, heavy, rare)[1] == [("warn", "main")] * 3


def test_long_keys_and_levels_far_to_the_right(spark):
    long_key = "k" * 80
    pairs = [f'{long_key}={i} level={LEVELS[i % 4].lower()} ts=1735696984.567 logger=flow.plan msg="a b"' for i in range(50)]
    far = [f"{AT} " + " ".join(f"[f{k} {i}]" for k in range(20)) + f" app.load {LEVELS[i % 4]} {MESSAGES[i % 6].format(i)}" for i in range(50)]
    got = read(spark, program(500, PLAIN), pairs, far)
    assert got[1] == [(LEVELS[i % 4].lower(), "flow.plan") for i in range(50)]
    assert [x and x[0] for x in got[2]] == [LEVELS[i % 4].lower() for i in range(50)]


def test_forms_of_an_opening_share_their_evidence(spark):
    """A thread's name in brackets has one word or several; one form occurs once."""
    common = [f"{AT} INFO [main] app.load - {MESSAGES[i % 6].format(i)}" for i in range(60)]
    before = [f"{AT} [main] app.load {LEVELS[i % 4]} - {MESSAGES[i % 6].format(i)}" for i in range(60)]
    odd = [f"{AT} [http worker 7 of 9] app.load WARN - no lease"]
    got = read(spark, common, before, odd)
    assert got[2] == [("warn", "app.load")] and [x[0] for x in got[1]] == [LEVELS[i % 4].lower() for i in range(60)]
    assert L.same_program(("<T>", "[", L.W, "]", L.L), ("<T>", "[", L.W, L.N, L.W, "]", L.L)) and not L.same_program(("<T>", L.W, L.L), ("<T>", L.W, L.W, L.L))


def test_a_sentence_with_a_time_is_no_opening(spark):
    assert not L.is_structured(("<T:date>", L.W, L.W, L.W, L.L)) and L.is_structured(("<T:month>", L.W, L.W, "[", L.N, "]", ":", L.L)) and not L.is_structured((L.L, ":"))
    got = read(spark, program(500, NAMED), [f"{AT} the nightly backup ended with ERROR"])
    assert got[1] == [None]


def test_templates_are_not_forced_together():
    words = [tuple(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}x" for k in "abcd") for i in range(300)]
    cluster = L.Cluster()
    for w in words:
        cluster.add(w)
    assert len(cluster.templates) == 300 and cluster.add(words[7]) == 0 and cluster.templates[7] == [list(words[7]), 2]
    long = tuple("abcdefghijklmnopqrstuvwxyz") * 4
    assert cluster.add(long) == 105 and cluster.closest((*long[:90], "zz9")) == 300
    for a, b in ((long, long[::-1]), (tuple("abcbdab"), tuple("bdcaba")), ((), ("a",)), (("a", "*"), ("*", "a"))):
        constants = [t for t in a if t not in L.VARIABLE]
        masks = {t: sum(1 << i for i, x in enumerate(constants) if x == t) for t in constants}
        assert L.lcs_length(masks, len(constants), b) == len(L.lcs(a, b))


def test_tasks_that_hand_on_often_find_the_same(spark, monkeypatch):
    texts = program(300, NAMED) + program(40, "<" + AT + "> {level} {msg}") + ['{"level": "%s", "time": 1735696984567, "x%d": 1, "target": "flow::plan", "msg": "a b"}' % (LEVELS[i % 4], i) for i in range(60)]
    once = L.Reader(L.find_layouts(spark.createDataFrame(pd.concat(list(L.mine_texts(iter(texts)))))))
    monkeypatch.setattr(L, "HELD", 40)
    parts = list(L.mine_texts(iter(texts)))
    assert len(parts) > 10 and sum(p[p["syntax"] == "total"]["lines"].sum() for p in parts) == 400
    df = spark.createDataFrame([(i, NOW, t, None, None) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    often = L.Reader(L.find_layouts(L.mine_templates(df, fan_in=2)))
    assert [once.opening(t, NOW) for t in texts] == [often.opening(t, NOW) for t in texts] and once.opening(texts[-1], NOW)[2] == "flow::plan"


def test_rare_sets_of_keys_are_read_by_their_template(spark):
    """Each line has a key of its own, so no set occurs twice; the sequences are one template."""
    lines = ['{"when": "%s", "sev": "%s", "unit": "flow.plan", "k%d": "a b c", "text": "a b"}' % (AT, LEVELS[i % 4], i) for i in range(50)]
    layouts = L.find_layouts(L.mine_templates(spark.createDataFrame([(i, NOW, t, None, None) for i, t in enumerate(lines)], SCHEMA)))
    assert [t for t, _ in layouts.templates["json"]] == [["when", "sev", "unit", "*", "text"]] and not layouts.sets
    assert [L.Reader(layouts).opening(t, NOW)[1:3] for t in lines] == [(LEVELS[i % 4].lower(), "flow.plan") for i in range(50)]
