"""Log text into entries by mined templates.

Lines are cut into typed tokens (times, levels, numbers, values, words, marks). Within lines that
agree up to their level, token sequences are clustered by their longest common subsequence: the
sequence is the constant part, the gaps are variable slots. Each task mines its own lines; the
templates of the tasks are merged in rounds by the same rule. What all message templates of such a
cluster share is the layout of a program's lines; its slots are classified by type as time, level,
component, other or message. Lines that don't follow it are split again until each follows a layout.
Openings are clustered in the same way, so that a rare form of a program's opening (a name of
several words in brackets) rests on the evidence of all forms. Lines made of keys and values (JSON
objects, key=value) are sequences of keys, clustered by the same rule; a key is classified by the
type of its values within its template. Entries are then cut and read by the layouts.

A task hands its templates on whenever it holds ``HELD`` tokens, and starts anew: nothing is dropped.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.logtime import LETTER_TIME, LEVEL_LETTERS, LEVEL_OF, TIME, parse_time
from tidemark.session import cut_lineage, ship_package, spread

STREAMS = ("stdout", "stderr", "logs")
GAP = "*"
#: Tokens of distinct sequences (and counts of keys) that a task holds before it hands its templates on.
HELD = 2_000_000
#: Lines that a cluster needs to be a program's layout and not chance: ``MIN_LINES``, or this share of all candidate
#: lines if that is less. With fewer, from two on, a time and two levels do; an opening that is a time, marks and a
#: level word, with no run of words that could be a sentence, needs no second line.
MIN_SHARE = 0.0002
MIN_LINES = 20
#: Message templates that show the lines with a component of their own to be a program's.
PROGRAM_TEMPLATES = 3
#: Share of a cluster's lines that must agree with its layout.
AGREEMENT = 0.9
FAN_IN = 16
#: Entries that a task holds before it hands them on.
OUTPUT_ENTRIES = 10_000

# Colour codes; keys whose values aren't the component though they look like one.
COLOUR = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
NOT_COMPONENT = ("host", "hostname", "node", "process", "pid", "tid", "thread", "threadname", "func", "function", "funcname", "method", "line", "lineno", "asset", "run", "run_id", "step", "pool", "user", "id", "env")
_WORD = r"[^\W\d][\w$]*(?:(?:[.\-/]|::)[\w<>$]+)*|<[^\W\d]\w*>"
_TOKEN = re.compile(rf"(?P<T>{TIME})|(?P<G>(?<![\S])[{LEVEL_LETTERS}](?={LETTER_TIME}))|(?P<W>{_WORD})|(?P<N>\d+(?:\.\d+)*)|(?P<P>\S)")
_LETTER_TIME = re.compile(LETTER_TIME)
_PAIR = re.compile(r'([A-Za-z_@][\w.@-]*)=("(?:[^"\\]|\\.)*(?:"|$)|[^\s"]*)(?:\s+|$)')
_TIME = re.compile(rf"(?:{TIME})")
_VALUE = re.compile(r"[_.:/$<\d]")
_PLAIN_WORD = re.compile(r"[^\s\"{}\[\],;=]+")
T, L, LETTER, G, N, V, W = "<T>", "<L>", "<l>", "<G>", "<N>", "<V>", "<W>"
VARIABLE = (GAP, V)
LEVEL_BIT = {level: i for i, level in enumerate(sorted(set(LEVEL_OF.values())))}


def time_form(text: str) -> str:
    """The token of a written time: its form, as one program writes its times in one form."""
    if text[0].isalpha():
        return "<T:month>"
    if text[2] == "/":
        return "<T:day/month>" if text[3].isalpha() else "<T:short>"
    return "<T:date>" if ":" in text else "<T:number>"


def is_time(token: str) -> bool:
    return token.startswith("<T")


def lcs(a: Sequence[str], b: Sequence[str]) -> list[str]:
    """The longest common subsequence of two token lists; gaps and values are variable and never match."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] and a[i] not in VARIABLE else max(best[i + 1][j], best[i][j + 1])
    i = j = 0
    found = []
    while i < len(a) and j < len(b):
        if a[i] == b[j] and a[i] not in VARIABLE and best[i][j] == best[i + 1][j + 1] + 1:
            found.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def generalise(template: Sequence[str], tokens: Sequence[str]) -> list[str]:
    """The constants two token lists share, with a gap wherever either has something between them."""
    found, i, j = [], 0, 0
    for constant in [*lcs(template, tokens), None]:
        gap = False
        while i < len(template) and template[i] != constant:
            gap, i = True, i + 1
        while j < len(tokens) and tokens[j] != constant:
            gap, j = True, j + 1
        if gap:
            found.append(GAP)
        if constant is not None:
            found.append(constant)
            i, j = i + 1, j + 1
    return found


def lcs_length(masks: dict[str, int], size: int, tokens: Sequence[str]) -> int:
    """The length of the longest common subsequence of a list of ``size`` constants, given as the bits of the
    places of each, and a token list: bit-parallel, a few operations on one long integer per token."""
    every = (1 << size) - 1
    row = every
    for token in tokens:
        if here := masks.get(token):
            hit = row & here
            row = ((row + hit) | (row - hit)) & every
    return size - row.bit_count()


class Cluster:
    """Templates of like token sequences, each with its lines, their levels and the kinds of its keys' values."""

    def __init__(self) -> None:
        self.templates: list[list] = []  # [tokens, lines]
        self.masks: list[int] = []  # the levels of each template's lines, as bits
        self.kinds: list[dict[str, Counter]] = []
        self.known: dict[tuple[str, ...], int] = {}
        self._constants: list[int] = []
        self._places: dict[str, list[int]] = defaultdict(list)  # the templates that have a constant, or once had

    def closest(self, tokens: Sequence[str]) -> int | None:
        """The template that shares the longest subsequence with some tokens, at least half of the constants of
        either; the first of equals. Templates that share too few constants in any order are passed over."""
        constants = [t for t in tokens if t not in VARIABLE]
        shared: Counter = Counter()
        for token, n in Counter(constants).items():
            for i in self._places.get(token, ()):
                shared[i] += n
        masks: dict[str, int] = defaultdict(int)
        for i, token in enumerate(constants):
            masks[token] |= 1 << i
        best, at = 0, None
        for i, most in sorted(shared.items(), key=lambda x: (-x[1], x[0])):
            if most < best:
                break
            need = max(len(constants), self._constants[i])
            if 2 * most >= need:
                score = lcs_length(masks, len(constants), self.templates[i][0])
                if 2 * score >= need and (score > best or (score == best and (at is None or i < at))):
                    best, at = score, i
        return at

    def hold(self, template: Sequence[str]) -> None:
        """Take a template as it is."""
        for token in {t for t in template if t not in VARIABLE}:
            self._places[token].append(len(self.templates))
        self.templates.append([list(template), 0])
        self.masks.append(0)
        self.kinds.append(defaultdict(Counter))
        self._constants.append(sum(t not in VARIABLE for t in template))

    def add(self, tokens: tuple[str, ...], lines: int = 1, levels: int = 0, kinds: dict[str, dict[str, int]] | None = None) -> int:
        """Count lines under their template; returns how many tokens are held for the first time."""
        held, at = 0, self.known.get(tokens)
        if at is None:
            held, at = len(tokens) + 1, self.closest(tokens)
            if at is None:
                at = len(self.templates)
                self.hold(tokens)
            else:
                self.templates[at][0] = generalise(self.templates[at][0], tokens)
                self._constants[at] = sum(t not in VARIABLE for t in self.templates[at][0])
            self.known[tokens] = at
        self.templates[at][1] += lines
        self.masks[at] |= levels
        for key, counts in (kinds or {}).items():
            self.kinds[at][key].update(counts)
        return held


def tokenise(line: str) -> tuple[tuple[str, ...], tuple[str, ...], str] | None:
    """(tokens up to the level, tokens after it, level) of a line that opens with a level, else None.

    A mark right behind the level, as in ``INFO:``, belongs to the opening.
    """
    opening: list[str] = []
    for found in _TOKEN.finditer(line):
        kind, text = found.lastgroup, found.group()
        if kind == "G":
            if opening:
                return None
            rest = _LETTER_TIME.match(line, found.end())
            return (G,), (T, *_after(line, rest.end())), LEVEL_OF[text.lower()]
        if kind == "W" and text.lower() in LEVEL_OF and (len(text) > 1 or (opening and is_time(opening[-1]) and text.isupper())):
            opening.append(L if len(text) > 1 else LETTER)
            end = found.end()
            if line[end : end + 1].strip() and not line[end].isalnum() and line[end] not in "_'\"":
                opening.append(line[end])
                end += 1
            return tuple(opening), tuple(_after(line, end)), LEVEL_OF[text.lower()]
        opening.append(time_form(text) if kind == "T" else W if kind == "W" else N if kind == "N" else text)
    return None


def _after(line: str, start: int) -> list[str]:
    tokens = []
    for found in _TOKEN.finditer(line, start):
        kind, text = found.lastgroup, found.group()
        if kind in ("W", "G"):
            tokens.append(V if _VALUE.search(text) else text)
        else:
            tokens.append(T if kind == "T" else N if kind == "N" else text)
    return tokens


def is_slot(token: str) -> bool:
    """A word or value, as against a mark, a number or a time."""
    return token in VARIABLE or token[0].isalnum() or token[0] == "_"


def head_of(tokens: Sequence[str]) -> tuple[str, ...]:
    """The marks right after the level with at most one word among them; templates of two such forms aren't merged."""
    head, end = [], 0
    for token in tokens:
        if is_slot(token):
            if GAP in head:
                break
            head.append(GAP)
        elif token in (N, T):
            break
        else:
            head.append(token)
            end = len(head)
    return tuple(head[:end])


def pairs_of(line: str) -> tuple[str, list[tuple[str, str | None]]] | None:
    """(syntax, top-level keys with the text of their scalar values) of a JSON or key=value line."""
    if line.startswith("{"):
        try:
            found = json.loads(line, object_pairs_hook=list, parse_float=str, parse_int=str)
        except (ValueError, RecursionError):
            return None
        return ("json", [(k, v if isinstance(v, str) else None) for k, v in found]) if found else None
    if "=" not in line:
        return None
    pairs, at = [], 0
    while at < len(line):
        found = _PAIR.match(line, at)
        if found is None:
            return None
        value = found.group(2)
        if value.startswith('"'):
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), value[1:-1] if len(value) > 1 and value.endswith('"') else value[1:])
        pairs.append((found.group(1), value))
        at = found.end()
    return ("pairs", pairs) if len(pairs) > 1 else None


def value_type(value: str | None) -> str:
    """``level``, ``time``, ``word`` (no white space), ``text`` or ``other`` (none, nested, empty, number)."""
    if not value:
        return "other"
    if value.lower() in LEVEL_OF and len(value) > 1:
        return "level"
    if _TIME.fullmatch(value):
        return "time"
    if value.replace(".", "", 1).lstrip("-").isdigit():
        return "other"
    return "word" if _PLAIN_WORD.fullmatch(value) else "text"


def lines_of(text: str) -> list[str]:
    """The lines of a text, which end with LF or CRLF."""
    return [line[:-1] if line.endswith("\r") else line for line in text.split("\n")]


SCHEMA = "syntax string, opening string, head string, template string, lines long, levels long, kinds string"
COLUMNS = ["syntax", "opening", "head", "template", "lines", "levels", "kinds"]


class Miner:
    """Templates of lines: plain ones by opening and head, lines of keys and values by syntax, and their sets of keys."""

    def __init__(self) -> None:
        self.clusters: dict[tuple, Cluster] = defaultdict(Cluster)
        self.sets: dict[tuple[str, tuple[str, ...]], Counter] = defaultdict(Counter)
        self.total = self.held = 0

    def add(self, line: str) -> None:
        if keyed := pairs_of(line):
            syntax, pairs = keyed
            self.total += 1
            found = self.sets[syntax, tuple(sorted({k for k, _ in pairs}))]
            before = len(found)
            kinds: dict[str, Counter] = defaultdict(Counter)
            for key, value in pairs:
                kind = value_type(value)
                kinds[key][kind] += 1
                found[key, kind] += 1
            self.held += len(found) - before + self.clusters[syntax, (), ()].add(tuple(k for k, _ in pairs), 1, 0, kinds)
        elif cut := tokenise(line):
            self.total += 1
            self.held += self.clusters["plain", cut[0], head_of(cut[1])].add(cut[1], 1, 1 << LEVEL_BIT[cut[2]])

    def rows(self) -> pd.DataFrame:
        rows = [
            (syntax, json.dumps(opening), json.dumps(head), json.dumps(t), n, c.masks[i], json.dumps(c.kinds[i]) if c.kinds[i] else None)
            for (syntax, opening, head), c in self.clusters.items()
            for i, (t, n) in enumerate(c.templates)
        ]
        rows += [(f"{syntax} set", json.dumps(keys), "", json.dumps(pair), n, 0, None) for (syntax, keys), kinds in self.sets.items() for pair, n in kinds.items()]
        rows.append(("total", "", "", "", self.total, 0, None))
        return pd.DataFrame(rows, columns=COLUMNS)


def mine_texts(texts: Iterator[str]) -> Iterator[pd.DataFrame]:
    """Templates of the lines of some texts, in one part or more."""
    miner = Miner()
    for text in texts:
        for raw in lines_of(text):
            line = COLOUR.sub("", raw) if "\x1b" in raw else raw
            if line and not line[0].isspace():
                miner.add(line)
                if miner.held > HELD:
                    yield miner.rows()
                    miner = Miner()
    yield miner.rows()


def merge_templates(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge the templates of one cluster that several tasks found."""
    first = rows.iloc[0]
    merged = Cluster()
    for template, lines, levels, kinds in rows.sort_values(["lines", "template"], ascending=[False, True])[["template", "lines", "levels", "kinds"]].itertuples(index=False):
        merged.add(tuple(json.loads(template)), lines, levels, json.loads(kinds) if kinds else None)
    out = [
        (first["syntax"], first["opening"], first["head"], json.dumps(t), n, m, json.dumps(k) if k else None)
        for (t, n), m, k in zip(merged.templates, merged.masks, merged.kinds, strict=True)
    ]
    return pd.DataFrame(out, columns=COLUMNS)


def mine_templates(logs: DataFrame, streams: Sequence[str] = STREAMS, fan_in: int = FAN_IN) -> DataFrame:
    """The templates of all lines: those of each task, merged cluster by cluster in rounds.

    A round hands one call at most ``fan_in`` parts of a cluster: first the parts of one task, then
    those of tasks. Counts of key sets are sums. Null and empty texts have no lines.
    """
    ship_package(logs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        texts = (t for batch in batches for s in streams for t in batch[s] if isinstance(t, str) and t)
        for number, rows in enumerate(mine_texts(texts)):
            yield rows.assign(task=TaskContext.get().partitionId(), part=number)

    # Stored once: templates and counts both start from what the tasks found.
    found = cut_lineage(spread(logs.select(*streams)).mapInPandas(run, f"{SCHEMA}, task int, part int"))
    mined = ~F.col("syntax").endswith(" set") & (F.col("syntax") != "total")
    counts = found.filter(~mined).groupBy("syntax", "opening", "head", "template").agg(F.sum("lines").alias("lines"))
    merged = found.filter(mined)
    most = found.agg(F.max("part"), F.max("task")).first()

    def fold(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return merge_templates(rows).assign(task=key[3], part=key[4])

    for column, last in zip(("part", "task"), most, strict=True):
        groups = (last or 0) + 1
        while groups > 1:
            groups = -(-groups // fan_in)
            merged = merged.withColumn(column, F.floor(F.col(column) / fan_in).cast("int"))
            merged = merged.groupBy("syntax", "opening", "head", "task", "part").applyInPandas(fold, f"{SCHEMA}, task int, part int")
    return merged.drop("task", "part").unionByName(counts.withColumns({"levels": F.lit(0).cast("long"), "kinds": F.lit(None).cast("string")}))


@dataclass
class Layout:
    """How the lines of a program open: a pattern with the groups time, level and component."""

    pattern: str
    lines: int
    tokens: int


@dataclass
class Layouts:
    #: Of programs with many lines, in the order in which they are tried.
    plain: list[Layout]
    #: By syntax: the keys that hold the level, the time, the component and the message, most used first.
    keyed: dict[str, dict[str, list[str]]]
    #: The same by syntax and set of keys, for the sets that occur often enough.
    sets: dict[tuple[str, frozenset[str]], dict[str, list[str]]] = field(default_factory=dict)
    #: By syntax: templates of key sequences, each with the kind of those of its keys that occur often enough.
    templates: dict[str, list[tuple[list[str], dict[str, str]]]] = field(default_factory=dict)
    #: Layouts of programs with few lines, by opening: they are looked up, so any number costs the same.
    rare: dict[tuple[str, ...], list[Layout]] = field(default_factory=dict)


def follows(template: Sequence[str], header: Sequence[str]) -> bool:
    return len(template) >= len(header) and all(h == GAP or h == t for h, t in zip(header, template, strict=False))


def headers_of(heads: dict[tuple[str, ...], list[tuple[list[str], int, int]]], least: float) -> list[tuple[tuple[str, ...], int, int]]:
    """(header, lines, levels) of the forms of the lines with one opening; ``heads`` has their templates, lines and levels.

    Lines with a component of their own right after the level are a program's if their messages vary;
    all others are taken together. Of each, the lines that don't follow the header found are split again.
    """
    total = sum(n for templates in heads.values() for _, n, _ in templates)
    apart = [h for h, found in heads.items() if GAP in h and len(found) >= PROGRAM_TEMPLATES and least <= sum(n for _, n, _ in found) < AGREEMENT * total]
    groups = [heads[h] for h in apart] + [[t for h, found in heads.items() if h not in apart for t in found]]
    headers = []
    for rest in groups:
        while rest:
            header = header_of([(t, n) for t, n, _ in rest])
            here = [t for t in rest if follows(t[0], header)]
            headers.append((header, sum(n for _, n, _ in here), reduce(or_, (m for _, _, m in here), 0)))
            rest = [t for t in rest if not follows(t[0], header)]
    return headers


# Brackets and their partners.
BRACKETS = {"[": "]", "(": ")", "<": ">", "{": "}"}


def in_brackets(tokens: Sequence[str]) -> list[bool]:
    """For each token whether it stands between a bracket and its partner."""
    inside, close = [], None
    for i, token in enumerate(tokens):
        if close is not None and token == close:
            close = None
        inside.append(close is not None)
        if close is None and token in BRACKETS and BRACKETS[token] in tokens[i + 1 :]:
            close = BRACKETS[token]
    return inside


def same_program(a: Sequence[str], b: Sequence[str]) -> bool:
    """Whether two openings are forms of one: all that isn't in brackets is in their longest common subsequence."""
    bare = [[t for t, inside in zip(x, in_brackets(x), strict=True) if not inside] for x in (a, b)]
    return bare[0] == bare[1] and Counter(lcs(a, b)) >= Counter(bare[0])


def families_of(found: Sequence[tuple[tuple[str, ...], int, int]]) -> dict[tuple[str, ...], tuple[int, int]]:
    """The lines and levels of each opening's family, by (opening, lines, levels); the heaviest opening begins one."""
    families: dict[tuple[str, ...], list[list]] = defaultdict(list)
    of: dict[tuple[str, ...], list] = {}
    for opening, lines, levels in sorted(found, key=lambda x: (-x[1], x[0])):
        bare = tuple(t for t, inside in zip(opening, in_brackets(opening), strict=True) if not inside)
        family = next((f for f in families[bare] if same_program(f[0], opening)), None)
        if family is None:
            families[bare].append(family := [opening, 0, 0])
        family[1] += lines
        family[2] |= levels
        of[opening] = family
    return {opening: (f[1], f[2]) for opening, f in of.items()}


def is_structured(opening: Sequence[str]) -> bool:
    """A time, marks and a level word, in which no words follow one another but for two before a mark, as a host and a program."""
    run = longest = 0
    for i, token in enumerate(opening):
        run = run + 1 if token == W else 0
        followed = i + 1 < len(opening) and opening[i + 1] not in (W, N, L)
        longest = max(longest, run - (run == 2 and followed))
    first = 1 if opening[0] in BRACKETS else 0
    return opening[first : first + 1] != () and is_time(opening[first]) and L in opening and longest <= 1


def header_of(templates: Sequence[tuple[list[str], int]]) -> tuple[str, ...]:
    """What most of the templates begin with, up to a mark.

    The longest common subsequence of the heaviest template with each other one is a candidate, as
    far as it is aligned (one token in each slot); the longest that ``AGREEMENT`` of the lines
    follow is taken, up to its last mark. Words of the language aren't part of a layout.
    """
    total = sum(n for _, n in templates)
    seed = max(templates, key=lambda t: (t[1], t[0]))[0]

    def aligned(a: Sequence[str], b: Sequence[str]) -> list[str]:
        shared, found, at = lcs(a, b), [], 0
        for constant in shared:
            if at < min(len(a), len(b)) and a[at] == b[at] == constant:
                found.append(constant)
                at += 1
            elif at + 1 < min(len(a), len(b)) and a[at + 1] == b[at + 1] == constant:
                found += [GAP, constant]
                at += 2
            else:
                break
        return found

    def marks_only(header: list[str]) -> list[str]:
        """Cut before the first word or value that is the same in all, and after the last mark."""
        for i, token in enumerate(header):
            if token in (V, GAP, N, T) or not token[0].isalnum():
                continue
            header = header[:i]
            break
        while header and header[-1] in (GAP, V, N):
            header = header[:-1]
        return header

    candidates = {tuple(marks_only(aligned(seed, t))) for t, _ in templates} | {()}
    # Shorter forms of a candidate hold wherever it does.
    candidates |= {tuple(marks_only(list(c[:k]))) for c in candidates for k in range(len(c))}
    support = {c: sum(n for t, n in templates if follows(t, c)) for c in candidates}
    return max((c for c in candidates if support[c] >= AGREEMENT * total), key=lambda c: (len(c), c))


def layout_of(opening: Sequence[str], header: Sequence[str], lines: int, family: tuple[int, int], least: float) -> Layout | None:
    """The layout of an opening and what follows the level, or None if it has no level and more.

    ``family`` has the lines and levels of all forms of the opening.
    """
    support, levels = family[0], family[1].bit_count()
    tokens = [*opening, *(GAP if x == V else x for x in header)]
    mark = next(i for i, x in enumerate(tokens) if x in (L, LETTER, G))
    times = sum(map(is_time, tokens))
    timed = times == 1
    enough = support >= least or (support >= 2 and levels >= 2) or is_structured(opening) if timed else support >= least and levels >= 2
    if times > 1 or not enough:
        return None
    component = component_slot(tokens, mark)
    if not timed and component is None:
        return None
    if not timed and not any(x not in (W, GAP, L, LETTER) for x in tokens):
        return None
    parts = []
    for i, token in enumerate(tokens):
        if is_time(token):
            part = f"(?P<time>{LETTER_TIME if tokens[0] == G else TIME})"
        elif token == L:
            words = "|".join(sorted((w for w in LEVEL_OF if len(w) > 1), key=len, reverse=True))
            part = rf"(?P<level>(?i:{words}))(?![\w.-])"
        elif token in (LETTER, G):
            part = f"(?P<level>[{LEVEL_LETTERS}])" + r"(?!\w)" * (token == LETTER)
        elif token in (W, GAP):
            part = f"(?P<component>{_WORD})" if i == component else f"(?:{_WORD})"
        elif token == N:
            part = r"\d+(?:\.\d+)*"
        else:
            part = re.escape(token)
        parts.append(part)
    return Layout(r"[ \t]*".join(parts), lines, len(tokens))


def component_slot(tokens: Sequence[str], level: int) -> int | None:
    """The slot among the words of an opening that is the component, by its neighbours.

    A word before a bracketed number is a program; of words joined by colons the first is the module
    and the rest are function and line; a word right after the time that another word follows is the
    host. A name of several words in brackets isn't one.
    """
    best, slot = 0, None
    inside = in_brackets(tokens)
    for i, token in enumerate(tokens):
        if token not in (W, GAP):
            continue
        before, after = tokens[i - 1] if i else "", tokens[i + 1] if i + 1 < len(tokens) else ""
        phrase = inside[i] and any(inside[j] and tokens[j] in (W, GAP, N) for j in (i - 1, i + 1) if 0 <= j < len(tokens))
        chained = before == ":" and i >= 2 and tokens[i - 2] in (W, GAP)
        if chained or phrase or (is_time(before) and after in (W, GAP)):
            continue
        program = after == "[" and list(tokens[i + 2 : i + 4]) == [N, "]"]
        score = 4 if program else 3 if i > level and after else 2
        if score > best:
            best, slot = score, i
    return slot


def find_layouts(templates: DataFrame, min_share: float = MIN_SHARE) -> Layouts:
    """The layouts of mined templates.

    Headers are found opening by opening in the cluster. What comes to the driver are one row or a few
    for each opening, the templates of key sequences, and the kinds of the key sets of ``MIN_LINES``
    lines or more.
    """
    ship_package(templates.sparkSession)
    templates = cut_lineage(templates)
    sequences = templates.filter("kinds IS NOT NULL OR syntax = 'total'").orderBy(F.desc("lines"), "template").collect()
    least = max(2, min(sum(r["lines"] for r in sequences if r["syntax"] == "total") * min_share, MIN_LINES))

    def headers(rows: pd.DataFrame) -> pd.DataFrame:
        heads: dict[tuple, list] = defaultdict(list)
        for head, template, lines, levels in rows.sort_values(["head", "template"])[["head", "template", "lines", "levels"]].itertuples(index=False):
            heads[tuple(json.loads(head))].append((json.loads(template), int(lines), int(levels)))
        return pd.DataFrame([(rows["opening"].iloc[0], json.dumps(h), n, m) for h, n, m in headers_of(heads, least)], columns=["opening", "header", "lines", "levels"])

    found = templates.filter("syntax = 'plain'").groupBy("opening").applyInPandas(headers, "opening string, header string, lines long, levels long").collect()
    candidates = sorted((tuple(json.loads(r["opening"])), tuple(json.loads(r["header"])), r["lines"], r["levels"]) for r in found)
    sums: dict[tuple[str, ...], list[int]] = defaultdict(lambda: [0, 0])
    for opening, _, lines, levels in candidates:
        sums[opening][0] += lines
        sums[opening][1] |= levels
    pooled = families_of([(opening, *x) for opening, x in sums.items()])
    plain, rare = [], defaultdict(list)
    for opening, header, lines, levels in candidates:
        # An opening in a form of its own has its own evidence; one of a family of forms has that of all.
        family = pooled[opening]
        evidence = (lines, levels) if family == tuple(sums[opening]) else family
        if layout := layout_of(opening, header, lines, evidence, least):
            if lines >= least:
                plain.append(layout)
            else:
                rare[opening].append(layout)
    order = lambda x: (-x.tokens, -x.lines, x.pattern)

    by_syntax: dict[str, dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    of_template: dict[str, list[tuple[list[str], dict[str, str]]]] = defaultdict(list)
    for r in (r for r in sequences if r["kinds"] is not None):
        kinds = {key: Counter(n) for key, n in json.loads(r["kinds"]).items()}
        for key, counts in kinds.items():
            by_syntax[r["syntax"]][key].update(counts)
        if r["lines"] >= MIN_LINES:
            own = {key: key_kind(key, n) for key, n in kinds.items() if sum(n.values()) >= MIN_LINES}
            of_template[r["syntax"]].append((json.loads(r["template"]), own))
    keyed = {syntax: kinds_of(kinds) for syntax, kinds in by_syntax.items()}
    rows = templates.filter(F.col("syntax").endswith(" set"))
    often = rows.groupBy("syntax", "opening").agg(F.max("lines").alias("__n")).filter(F.col("__n") >= MIN_LINES)
    sets: dict[tuple[str, frozenset[str]], dict[str, Counter]] = defaultdict(lambda: defaultdict(Counter))
    for r in rows.join(often, ["syntax", "opening"], "left_semi").collect():
        key, kind = json.loads(r["template"])
        sets[r["syntax"].removesuffix(" set"), frozenset(json.loads(r["opening"]))][key][kind] += r["lines"]
    own = {k: set_kinds(counts, keyed.get(k[0], {})) for k, counts in sets.items()}
    return Layouts(sorted(plain, key=order), keyed, own, dict(of_template), {k: sorted(v, key=order) for k, v in rare.items()})


def kinds_of(counts: dict[str, Counter]) -> dict[str, list[str]]:
    """The keys by kind, most used first."""
    out: dict[str, list[str]] = {}
    for key, found in sorted(counts.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        out.setdefault(key_kind(key, found), []).append(key)
    return out


def key_kind(key: str, kinds: Counter) -> str:
    n = sum(kinds.values())
    kind = next((k for k in ("level", "time", "word") if kinds[k] >= AGREEMENT * n), "text" if kinds["text"] > n / 2 else "other")
    return "other" if kind == "word" and key.lower().lstrip("@") in NOT_COMPONENT else kind


def set_kinds(counts: dict[str, Counter], everywhere: dict[str, list[str]]) -> dict[str, list[str]]:
    """The keys of one set by kind; those that are of the kind in all lines of the syntax come first."""
    rank = {key: (kind, i) for kind, keys in everywhere.items() for i, key in enumerate(keys)}
    kinds = {key: key_kind(key, found) for key, found in counts.items()}
    short = [k for k, kind in kinds.items() if kind == "word" and rank.get(k, ("",))[0] == "text"]
    if "text" not in kinds.values() and sum(kind == "word" for kind in kinds.values()) > len(short):
        kinds |= dict.fromkeys(short, "text")  # messages of one word each
    out: dict[str, list[str]] = {}
    for key, kind in sorted(kinds.items(), key=lambda x: (rank.get(x[0], ("",))[0] != x[1], rank.get(x[0], ("", len(rank)))[1], x[0])):
        out.setdefault(kind, []).append(key)
    return out


class Reader:
    """Reads the opening of a line by the layouts found."""

    def __init__(self, layouts: Layouts) -> None:
        self.keyed, self.sets = layouts.keyed, layouts.sets
        # All layouts as one pattern: of those that match the first counts, as if tried one by one.
        self.pattern, self.groups = self._joined(layouts.plain)
        self.rare = {opening: self._joined(found) for opening, found in layouts.rare.items()}
        # By syntax the keys with their kind, most used first.
        self.everywhere = {s: {key: (i, kind) for kind, keys in kinds.items() for i, key in enumerate(keys)} for s, kinds in self.keyed.items()}
        self.sequences: dict[str, tuple[Cluster, list[dict[str, str]]]] = {}
        for syntax, found in layouts.templates.items():
            cluster = Cluster()
            for template, _ in found:
                cluster.hold(template)
            self.sequences[syntax] = cluster, [kinds for _, kinds in found]
        self._kinds: dict[tuple, dict[str, list[str]]] = {}

    @staticmethod
    def _joined(layouts: Sequence[Layout]) -> tuple[re.Pattern | None, dict[str, tuple[int | None, int, int | None]]]:
        """One pattern for several layouts, and the numbers of the groups of each by the name of its last group."""
        if not layouts:
            return None, {}
        named = [re.sub(r"\(\?P<(time|level|component)>", rf"(?P<\g<1>{i}>", x.pattern) + f"(?P<end{i}>)" for i, x in enumerate(layouts)]
        pattern = re.compile("|".join(f"(?:{x})" for x in named))
        at = pattern.groupindex
        return pattern, {f"end{i}": (at.get(f"time{i}"), at[f"level{i}"], at.get(f"component{i}")) for i in range(len(layouts))}

    def opening(self, line: str, near_ns: int | None) -> tuple[int, str, str, str] | None:
        """(time or -1, level, component, message) if an entry begins at the line."""
        if not line or line[0].isspace():
            return None
        if keyed := pairs_of(line):
            return self._of_pairs(*keyed, near_ns)
        found, groups = self.pattern.match(line) if self.pattern else None, self.groups
        if found is None and self.rare and (cut := tokenise(line)) and cut[0] in self.rare:
            pattern, groups = self.rare[cut[0]]
            found = pattern.match(line)
        if found is None:
            return None
        time, level, component = groups[found.lastgroup]
        at = parse_time(found[time], near_ns) if time else None
        return -1 if at is None else at, LEVEL_OF[found[level].lower()], (found[component] if component else "") or "", line[found.end() :].lstrip(" \t")

    def _kinds_of(self, syntax: str, keys: tuple[str, ...]) -> dict[str, list[str]]:
        """The keys by kind: of their set, else each of the closest template of key sequences, else of the syntax."""
        if (syntax, keys) not in self._kinds:
            if len(self._kinds) >= 100_000:
                self._kinds.clear()
            kinds = self.sets.get((syntax, frozenset(keys)))
            if kinds is None:
                cluster, of_template = self.sequences.get(syntax, (Cluster(), []))
                at, known = cluster.closest(keys), self.everywhere.get(syntax, {})
                own, kinds = {} if at is None else of_template[at], {}
                for key in sorted(set(keys), key=lambda k: (known.get(k, (len(known),))[0], k)):
                    kinds.setdefault(own.get(key) or known.get(key, (0, "other"))[1], []).append(key)
            self._kinds[syntax, keys] = kinds
        return self._kinds[syntax, keys]

    def _of_pairs(self, syntax: str, pairs: list[tuple[str, str | None]], near_ns: int | None) -> tuple[int, str, str, str] | None:
        values: dict[str, str | None] = {}
        for key, value in pairs:
            values.setdefault(key, value)
        kinds = self._kinds_of(syntax, tuple(k for k, _ in pairs))

        def first(kind: str) -> str | None:
            return next((values[k] for k in kinds.get(kind, ()) if values.get(k)), None)

        level = LEVEL_OF.get((first("level") or "").lower())
        at, component = first("time"), first("word")
        if level is None or (at is None and component is None):
            return None
        parsed = parse_time(at, near_ns) if at else None
        return -1 if parsed is None else parsed, level, component or "", first("text") or ""

    def entries(self, text: str, near_ns: int | None) -> Iterator[tuple[int, int, int, str, str, str]]:
        """(line_no, n_lines, time, level, component, message) of each entry of a text."""
        current: list | None = None
        for number, raw in enumerate(lines_of(text), 1):
            line = COLOUR.sub("", raw) if "\x1b" in raw else raw
            if opened := self.opening(line, near_ns):
                if current:
                    yield self._closed(current)
                current = [number, 1, opened, [opened[3]]]
            elif current:
                current[1] += bool(line.strip())
                current[3].append(line)
        if current:
            yield self._closed(current)

    @staticmethod
    def _closed(entry: list) -> tuple[int, int, int, str, str, str]:
        number, lines, (at, level, component, _), message = entry
        return number, lines, at, level, component, "\n".join(message).rstrip()


def parse_entries(logs: DataFrame, layouts: Layouts, record: str = "log_id", timestamp: str = "timestamp", streams: Sequence[str] = STREAMS, message: bool = True) -> DataFrame:
    """One row per log entry: record, stream, line_no, n_lines, ts_us, level, component[, message].

    An entry runs from its opening line to the next; lines before the first opening belong to none.
    n_lines counts its lines that aren't blank; ts_us is -1 without a time, component '' if there is
    none. Records repeated with the same content come out once. Null and empty streams have no entry.
    """
    ship_package(logs.sparkSession)
    columns = ["record", "stream", "line_no", "n_lines", "ts_us", "level", "component", *(["message"] if message else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(layouts)
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                near = None if pd.isna(row[1]) else int(row[1])
                for stream, text in zip(streams, row[2:], strict=True):
                    if isinstance(text, str) and text:
                        out += [(row[0], stream, *entry[: 6 if message else 5]) for entry in reader.entries(text, near)]
                if len(out) >= OUTPUT_ENTRIES:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
            yield pd.DataFrame(out, columns=columns)

    schema = "record long, stream string, line_no long, n_lines long, ts_us long, level string, component string" + ", message string" * message
    near = F.col(timestamp).cast("string")  # whole nanoseconds, which a float column with nulls would round
    return spread(logs.select(F.col(record).cast("long"), near, *streams)).mapInPandas(run, schema).distinct().withColumnRenamed("record", record)
