"""Byte-level BPE by dynamic programming over prefixes.

Every prefix of a byte string has one BPE encoding, and that of a longer prefix ends in one token
``t`` such that the encoding of what comes before ``t`` ends in a token that ``t`` may follow. It is
therefore enough to store, for each prefix, its last token: the encoding is read off backwards, more
bytes extend the table without touching it, and an edit changes it from the edited byte only.
Two tokens may follow each other if merging their joined bytes gives back these two tokens.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tidemark.session import ship_package, spread

TOKENIZERS = os.environ.get("TIDEMARK_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = "byte_bpe_50k.tiktoken"

# The public pre-tokenizer pattern of the byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The longest look-ahead of SPLIT past the end of a piece that it may change: contractions of three characters.
REACH = 2
#: Pieces and pairs remembered by a worker; beyond it the memory starts anew, which costs time only.
REMEMBERED = 400_000
#: Tokens that a task holds before it hands them on.
OUTPUT_TOKENS = 1_000_000


class Vocabulary:
    """Ranks of byte strings, with the pair test that the prefix tables rest on."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._pieces: dict[str, tuple[int, ...]] = {}
        self._split = regex.compile(SPLIT)
        self._ends = self._automaton()

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Read a rank file: a base64 token and its rank on each line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())})

    def _automaton(self):
        try:
            import ahocorasick
        except ImportError:
            return None
        found = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            found.add_word(token.decode("latin-1"), (len(token), rank))
        found.make_automaton()
        return found

    def merge(self, data: bytes) -> list[int]:
        """BPE by its definition, lowest rank first; used on the few bytes of a pair of tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min(((self.ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def may_follow(self, first: int, second: int) -> bool:
        known = self._pairs.get((first, second))
        if known is None:
            if len(self._pairs) >= REMEMBERED:
                self._pairs.clear()
            known = self._pairs[first, second] = self.merge(self.token[first] + self.token[second]) == [first, second]
        return known

    def candidates(self, data: bytes, start: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(end, tokens that end there as (length, rank)) for each end after ``start``."""
        low = max(0, start - self.longest)
        if self._ends is None:
            for end in range(start + 1, len(data) + 1):
                spans = ((n, self.ranks.get(data[end - n : end])) for n in range(1, min(end, self.longest) + 1))
                yield end, [(n, r) for n, r in spans if r is not None]
            return
        at, found = start + 1, []
        for last, hit in self._ends.iter(data[low:].decode("latin-1")):
            end = low + last + 1
            if end <= start:
                continue
            while at < end:
                yield at, found
                at, found = at + 1, []
            if hit[0] <= end:
                found.append(hit)
        while at <= len(data):
            yield at, found
            at, found = at + 1, []

    def pieces(self, text: str) -> list[str]:
        return self._split.findall(text)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        ids = self._pieces.get(piece)
        if ids is None:
            if len(self._pieces) >= REMEMBERED:
                self._pieces.clear()
            ids = self._pieces[piece] = tuple(PrefixTable(self, piece.encode("utf-8", "surrogatepass")).ids())
        return ids

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; [] for an empty or null one. Special tokens' strings are plain text."""
        ids: list[int] = []
        get, encode = self._pieces.get, self.encode_piece
        for piece in self._split.findall(text or ""):
            ids.extend(get(piece) or encode(piece))
        return ids

    def count(self, text: str | None) -> int:
        get, encode = self._pieces.get, self.encode_piece
        return sum(len(get(piece) or encode(piece)) for piece in self._split.findall(text or ""))


class PrefixTable:
    """The last token of each prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary, self.data, self.last = vocabulary, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; what is stored for its prefixes stays as it is."""
        start, self.data = len(self.data), self.data + more
        vocabulary, last, token = self.vocabulary, self.last, self.vocabulary.token
        for end, tokens in vocabulary.candidates(self.data, start):
            for length, rank in tokens:
                before = last[end - length]
                if length == end or vocabulary.may_follow(before, rank):
                    last.append(rank)
                    break
            else:
                raise ValueError(f"no token of the vocabulary ends at byte {end}: {token.get(last[-1])!r}")

    def replace(self, start: int, end: int, new: bytes) -> None:
        """Put ``new`` in place of bytes [start, end); only what follows ``start`` is computed anew."""
        tail = new + self.data[end:]
        self.data, self.last = self.data[:start], self.last[: start + 1]
        self.append(tail)

    def ids(self) -> list[int]:
        found, at = [], len(self.data)
        while at:
            found.append(self.last[at])
            at -= len(self.vocabulary.token[self.last[at]])
        return found[::-1]


class EncodedText:
    """A text with its encoding, kept up to date through appends and edits."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary, self.text, self.parts = vocabulary, "", []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> None:
        """Put ``new`` in place of characters [start, end) and split and encode only near it."""
        kept, at = 0, 0
        while kept < len(self.parts) and at + len(self.parts[kept]) + REACH < start:
            at += len(self.parts[kept])
            kept += 1
        shift = len(new) - (end - start)
        old_ends, stop = {}, at
        for i in range(kept, len(self.parts)):
            stop += len(self.parts[i])
            if stop >= end:
                old_ends[stop + shift] = i + 1
        self.text = self.text[:start] + new + self.text[end:]
        fresh, tail = [], []
        for found in self.vocabulary._split.finditer(self.text, at):
            fresh.append(found.group())
            # From a boundary past the edit that was one before, the old pieces hold.
            if found.end() >= start + len(new) and found.end() in old_ends:
                tail = self.parts[old_ends[found.end()] :]
                break
        self.parts = [*self.parts[:kept], *fresh, *tail]

    def ids(self) -> list[int]:
        return [i for part in self.parts for i in self.vocabulary.encode_piece(part)]


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, one for each worker process."""
    return Vocabulary.load(path)


def encode_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """``key`` and ``ids`` (array<int>) of each row, without special tokens.

    A null, an empty text and a text of no bytes give []. Whole texts are encoded, in the input's
    partitions (a small input is first spread over all cores). Strings that look like special tokens are plain text; rows that
    repeat a key stay. An empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            flat, offsets, first = [], [0], 0
            for i, value in enumerate(batch.column(1).to_pylist(), 1):
                flat.extend(words.encode(value))
                offsets.append(len(flat))
                # Long texts are handed on before a whole batch of them is held.
                if len(flat) >= OUTPUT_TOKENS or i == batch.num_rows:
                    ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, i - first), ids], [key, "ids"])
                    flat, offsets, first = [], [0], i

    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_column(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = f"{TOKENIZERS}/{BYTE_BPE}") -> DataFrame:
    """``key`` and ``n_tokens`` (long) of each row; 0 for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            counts = pa.array([words.count(v) for v in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts], [key, "n_tokens"])

    ship_package(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(run, f"`{key}` {kind}, n_tokens long")
