"""Subject areas of documents: complement naive Bayes, refined by expectation-maximisation, calibrated.

Words and word pairs are hashed into a fixed number of buckets, so the model has one size for any
corpus. A bucket is evidence for a subject by how much more often it occurs there than in the
complement, all other subjects together; weak evidence, which platform talk has for everything, is
none. Sentences carry the evidence: a subject is a main one by how many sentences of the document
speak of it, which tells it from a mention in passing.

Training starts from the labelled documents and goes on over all documents: in each round the
sentences of every document are assigned by the current evidence and by what the rest of the
document is about (E), and the counts are taken anew (M). The labels of every ``HELD_OUT``-th labelled
document are kept from all rounds but the last; on these documents the posterior of each subject is
calibrated by a regression of its own, which is drawn towards that of all subjects where labels are few.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, ship_package, spread

#: Hash buckets of words and word pairs: the size of the model.
BUCKETS = 1 << 18
#: Labelled documents that training and calibration use at most, chosen by the hash of their id.
LABELLED_DOCUMENTS = 50_000
#: Rounds of expectation-maximisation over all documents.
ROUNDS = 3
#: A word is evidence if it is this many times as frequent in a subject as spread evenly over one other
#: subject; against the complement of n - 1 subjects the ratio is n - 1 times higher.
LEAST_RATIO = 1.8
SMOOTHING = 0.2
#: Trust in a person's label against what the text says, while training.
LABEL_TRUST = 0.9
MAX_SUBJECTS = 60
#: Words that a task holds before it hands them on.
OUTPUT_TOKENS = 1_000_000
THRESHOLD = 0.5
#: One in so many labelled documents is kept from training, for calibration.
HELD_OUT = 5
#: How strongly a subject's calibration is drawn to that of all subjects (in the unit of the ridge penalty).
PRIOR = 5.0

# Words, and the ends of sentences: line breaks, and full stops and the like before white space.
_TOKEN = re.compile(r"[^\W\d]+|[\n\r]|[.!?;](?=\s)")
_CACHE: dict[str, int] = {}
_CACHED = 500_000
_END, _NO_WORD = -1, -2
_ENDS = frozenset("\n\r.!?;")


def least_evidence(subjects: int) -> float:
    """The log ratio below which a word is no evidence; a sentence speaks of a subject from this sum on."""
    return float(np.log(LEAST_RATIO * max(subjects - 1, 1)))


def _code(token: str) -> int:
    """31 bits for a word; names with _ are no words."""
    if len(_CACHE) >= _CACHED:
        _CACHE.clear()
    kind = _END if token in _ENDS else _NO_WORD if "_" in token else zlib.crc32(token.encode("utf-8", "surrogatepass")) >> 1
    _CACHE[token] = kind
    return kind


def token_codes(text: str) -> list[int]:
    """The codes of the words of a text in order, with an end after each sentence."""
    get = _CACHE.get
    codes = [_code(t) if (c := get(t)) is None else c for t in _TOKEN.findall(text.lower())]
    codes.append(_END)
    return codes


def sentence_features(codes: np.ndarray, document: np.ndarray, documents: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and word pairs sentence by sentence, their number in each sentence, and the
    number of features and of sentences of each document."""
    sentence = np.cumsum(codes == _END) - (codes == _END)
    words = codes >= 0
    code, sentence, document = codes[words].astype(np.uint64), sentence[words], document[words]
    pair = np.flatnonzero(sentence[1:] == sentence[:-1]) if len(code) else np.zeros(0, np.int64)
    mixed = (code[pair] * np.uint64(0x9E3779B97F4A7C15) + code[pair + 1] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)
    bucket = np.concatenate([code % np.uint64(BUCKETS), mixed % np.uint64(BUCKETS)]).astype(np.int32)
    of = np.concatenate([sentence, sentence[pair]])
    order = np.argsort(of, kind="stable")
    lengths = np.bincount(of) if len(of) else np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]]) if len(sentence) else np.zeros(0, np.int64)
    per_document = np.bincount(document, minlength=documents) + np.bincount(document[pair], minlength=documents)
    return bucket[order], lengths[lengths > 0].astype(np.int32), per_document, np.bincount(document[first], minlength=documents)


ENCODED = "known boolean, features array<int>, lengths array<int>"


def encode_documents(documents: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` columns, ``known`` (the text has a letter or digit), and the features by sentence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known, flat, sizes, first = [], [], [], 0
            for i, value in enumerate(batch.column(len(keep)).to_pylist(), 1):
                before = len(flat)
                if value:
                    flat.extend(token_codes(value))
                sizes.append(len(flat) - before)
                known.append(bool(value) and any(c.isalnum() for c in value))
                if len(flat) >= OUTPUT_TOKENS or i == batch.num_rows:
                    document = np.repeat(np.arange(len(sizes)), sizes)
                    features, lengths, per_document, sentences = sentence_features(np.array(flat, dtype=np.int64), document, len(sizes))
                    offsets = [pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)) for n in (per_document, sentences)]
                    lists = [pa.ListArray.from_arrays(o, pa.array(v)) for o, v in zip(offsets, (features, lengths), strict=True)]
                    kept_columns = [c.slice(first, i - first) for c in batch.columns[: len(keep)]]
                    yield pa.RecordBatch.from_arrays([*kept_columns, pa.array(known), *lists], [*keep, "known", "features", "lengths"])
                    known, flat, sizes, first = [], [], [], i

    kept = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return spread(documents.select(*keep, text)).mapInArrow(run, f"{kept}, {ENCODED}")


@dataclass
class Evidence:
    """The buckets that are evidence for a subject, and what they weigh for each; all others weigh nothing."""

    buckets: np.ndarray
    weights: np.ndarray

    @classmethod
    def of(cls, weights: np.ndarray) -> Evidence:
        buckets = np.flatnonzero(weights.any(1))
        return cls(buckets.astype(np.int32), weights[buckets])

    def row(self) -> np.ndarray:
        """The row of each bucket, -1 for those without evidence."""
        row = np.full(BUCKETS, -1, dtype=np.int32)
        row[self.buckets] = np.arange(len(self.buckets), dtype=np.int32)
        return row


@dataclass
class Batch:
    """Sentences of a batch of documents in flat form."""

    feature: np.ndarray  # bucket of each feature
    start: np.ndarray  # first feature of each sentence
    sentence: np.ndarray  # sentence of each feature
    document: np.ndarray  # document of each sentence
    size: int

    @classmethod
    def of(cls, features: pa.Array, lengths: pa.Array) -> Batch:
        length = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        document = np.repeat(np.arange(len(lengths)), pc.list_value_length(lengths).to_numpy(zero_copy_only=False))
        start = np.r_[0, np.cumsum(length)[:-1]].astype(np.int64) if len(length) else np.zeros(0, np.int64)
        return cls(features.flatten().to_numpy(zero_copy_only=False), start, np.repeat(np.arange(len(length)), length), document, len(lengths))

    def scores(self, evidence: Evidence) -> np.ndarray:
        """Evidence of each sentence for each subject; features without evidence are passed over."""
        scores = np.zeros((len(self.start), evidence.weights.shape[1]))
        row = evidence.row()[self.feature]
        kept = np.flatnonzero(row >= 0)
        if len(kept):
            of = self.sentence[kept]
            first = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            scores[of[first]] = np.add.reduceat(evidence.weights[row[kept]], first, axis=0, dtype=np.float64)
        return scores

    def votes(self, scores: np.ndarray) -> np.ndarray:
        """Sentences of each document that speak of each subject, and in the last column of none."""
        subjects = scores.shape[1]
        best = scores.argmax(1) if len(scores) else np.zeros(0, np.int64)
        choice = np.where(scores.max(1) > least_evidence(subjects), best, subjects) if len(scores) else best
        return np.bincount(self.document * (subjects + 1) + choice, minlength=self.size * (subjects + 1)).reshape(self.size, -1).astype(np.float64)

    def add_counts(self, share: np.ndarray, totals: np.ndarray) -> None:
        """Add each feature to ``totals`` with its sentence's share of each subject."""
        for c in range(share.shape[1]):
            totals[:, c] += np.bincount(self.feature, weights=share[self.sentence, c], minlength=len(totals))


def label_shares(masks: np.ndarray, subjects: int) -> np.ndarray:
    bits = (masks[:, None] >> np.arange(subjects)) & 1
    return bits / np.maximum(1, bits.sum(1, keepdims=True))


def evidence_of(counts: np.ndarray) -> Evidence:
    """Log ratio of a bucket's rate in a subject to that in its complement; weak evidence is 0."""
    others = counts.sum(1, keepdims=True) - counts
    own = np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * len(counts)))
    rest = np.log((others + SMOOTHING) / (others.sum(0) + SMOOTHING * len(counts)))
    found = (own - rest).astype(np.float32)
    found[found < least_evidence(counts.shape[1])] = 0
    return Evidence.of(found)


def count_features(encoded: DataFrame, subjects: int, weights: Evidence | None, fallback: int | None) -> np.ndarray:
    """Counts of buckets by subject: from the labels in ``mask`` alone (no ``weights``), else one round of EM over all.

    A task sends at most ``BUCKETS`` rows and so many come to the driver, whatever the corpus.
    """
    context = encoded.sparkSession.sparkContext
    shared = None if weights is None else context.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((BUCKETS, subjects))
        for batch in batches:
            masks = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            part = Batch.of(batch.column(1), batch.column(2))
            labelled = label_shares(masks, subjects)
            if shared is None:
                # At first a document of several subjects can't say which of its words is whose: it counts for little.
                part.add_counts((labelled**3)[part.document], totals)
                continue
            scores = part.scores(shared.value)
            about = part.votes(scores)[:, :subjects]
            if fallback is not None:
                about[about.sum(1) == 0, fallback] = 1
            about /= np.maximum(1e-9, about.sum(1, keepdims=True))
            told = (masks > 0)[:, None]
            about = np.where(told, (1 - LABEL_TRUST) * about + LABEL_TRUST * labelled, about)
            share = np.exp(scores - scores.max(1, keepdims=True)) * (about[part.document] + 0.003) if len(scores) else scores
            part.add_counts(share / np.maximum(1e-300, share.sum(1, keepdims=True)), totals)
        used = np.flatnonzero(totals.sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), *(pa.array(totals[used, c]) for c in range(subjects))], ["bucket", *(f"c{c}" for c in range(subjects))])

    names = [f"c{c}" for c in range(subjects)]
    rows = encoded if weights is not None else encoded.filter("mask > 0")
    sums = rows.select("mask", "features", "lengths").mapInArrow(run, "bucket int, " + ", ".join(f"{n} double" for n in names))
    found = sums.groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toPandas()
    counts = np.zeros((BUCKETS, subjects))
    counts[found["bucket"].to_numpy(dtype=np.int64)] = found[names].to_numpy()
    return counts


def vote_features(votes: np.ndarray, fallback: int | None) -> np.ndarray:
    """[documents, subjects, features]: what the calibration sees of a subject in a document."""
    of, none = votes[:, :-1], votes[:, -1:]
    total = of.sum(1, keepdims=True)
    share = of / np.maximum(total, 1e-6)
    own = np.zeros_like(of)
    if fallback is not None:
        own[:, fallback] = 1
    silent = np.exp(-total) * np.ones_like(of)
    columns = [
        np.log(of + 0.1), np.log(share + 0.02), of / np.maximum(total + none, 1e-6), (of >= of.max(1, keepdims=True)) & (of > 0), np.minimum(of, 3) / 3,
        share * np.minimum(of, 2), own, own * silent, own * np.log(total + 0.1), silent, np.ones_like(of),
    ]
    return np.stack([c.astype(np.float64) for c in columns], -1)


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray | None = None, steps: int = 30, penalty: float = 0.1) -> np.ndarray:
    """Weights of a logistic regression by Newton's method, with a ridge penalty on the distance from ``prior``."""
    centre = np.zeros(x.shape[1]) if prior is None else prior
    w = centre.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty * (w - centre)
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), gradient)
    return w


def calibrate(votes: np.ndarray, truth: np.ndarray, fallback: int | None) -> np.ndarray:
    """Weights of each subject's calibration [subjects, features], from votes and labels of held-out documents."""
    x = vote_features(votes, fallback)
    shared = fit_logistic(x.reshape(-1, x.shape[-1]), truth.reshape(-1).astype(np.float64))
    return np.stack([fit_logistic(x[:, c], truth[:, c].astype(np.float64), shared, penalty=PRIOR) for c in range(truth.shape[1])])


def posteriors(votes: np.ndarray, calibration: np.ndarray, fallback: int | None) -> np.ndarray:
    """The calibrated probability of each subject for each document, independently of the others."""
    return 1 / (1 + np.exp(-np.clip(np.einsum("dsf,sf->ds", vote_features(votes, fallback), calibration), -30, 30)))


def calibration_error(posterior: np.ndarray, truth: np.ndarray, bins: int = 10) -> float:
    """Mean distance between posterior and share of true cases over equal bins of the posterior, by their number."""
    at = np.minimum((posterior.reshape(-1) * bins).astype(int), bins - 1)
    n, p, t = (np.bincount(at, weights=w, minlength=bins) for w in (np.ones(at.shape), posterior.reshape(-1), truth.reshape(-1).astype(float)))
    return float(np.abs(p - t).sum() / max(1.0, n.sum()))


@dataclass
class Model:
    subjects: list[str]
    weights: Evidence
    calibration: np.ndarray | None  # of each subject; none if there were no labels
    fallback: int | None


def votes_of(encoded: DataFrame, weights: Evidence, keep: Sequence[str], finish) -> DataFrame:
    """Apply ``finish(kept columns, known, votes)`` to batches; it returns a pandas frame."""
    shared = encoded.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = Batch.of(batch.column(len(keep) + 1), batch.column(len(keep) + 2))
            yield pa.RecordBatch.from_pandas(finish(batch.select(list(range(len(keep)))).to_pandas(), batch.column(len(keep)).to_numpy(zero_copy_only=False), part.votes(part.scores(shared.value))), preserve_index=False)

    return encoded.select(*keep, "known", "features", "lengths").mapInArrow(run, finish.schema)


class _Votes:
    """The votes themselves, for the labelled documents that calibration uses."""

    def __init__(self, subjects: int) -> None:
        self.subjects = subjects
        self.schema = "mask long, " + ", ".join(f"v{i} double" for i in range(subjects + 1))

    def __call__(self, kept: pd.DataFrame, known: np.ndarray, votes: np.ndarray) -> pd.DataFrame:
        return pd.concat([kept.reset_index(drop=True), pd.DataFrame(votes, columns=[f"v{i}" for i in range(self.subjects + 1)])], axis=1)


class _Subjects:
    """One row per document and subject whose calibrated posterior reaches the threshold.

    With ``whole``, a text in which no subject reaches it is given the likeliest.
    """

    def __init__(self, model: Model, schema: str, threshold: float, whole: bool) -> None:
        self.names, self.calibration, self.fallback = np.asarray(model.subjects, dtype=object), model.calibration, model.fallback
        self.schema, self.threshold, self.whole = schema, threshold, whole

    def judge(self, votes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors and what is chosen, [documents, subjects]."""
        if self.calibration is None:
            posterior = np.zeros((len(votes), len(self.names)))
            chosen = np.zeros(posterior.shape, dtype=bool)
            if self.fallback is not None:
                chosen[:, self.fallback] = True
        else:
            posterior = posteriors(votes, self.calibration, self.fallback)
            chosen = posterior >= self.threshold
            if len(chosen) and self.whole:
                chosen[np.arange(len(chosen)), posterior.argmax(1)] |= ~chosen.any(1)
        return posterior, chosen & known.astype(bool)[:, None]

    def __call__(self, kept: pd.DataFrame, known: np.ndarray, votes: np.ndarray) -> pd.DataFrame:
        posterior, chosen = self.judge(votes, known)
        row, subject = np.nonzero(chosen)
        return kept.iloc[row].reset_index(drop=True).assign(subject=self.names[subject], posterior=posterior[row, subject])


class _Composition(_Subjects):
    """Per batch, group and subject: documents chosen, and the sum of the posteriors of all documents, also below the threshold."""

    def __call__(self, kept: pd.DataFrame, known: np.ndarray, votes: np.ndarray) -> pd.DataFrame:
        posterior, chosen = self.judge(votes, known)
        posterior = posterior * known.astype(bool)[:, None]
        columns = list(kept.columns)
        every = pd.concat([kept.assign(subject=name, n=chosen[:, c].astype(np.int64), expected=posterior[:, c]) for c, name in enumerate(self.names)])
        return every.groupby([*columns, "subject"], dropna=False, sort=False).sum().reset_index()


def label_masks(labels: DataFrame, subjects: Sequence[str], limit: int = LABELLED_DOCUMENTS) -> DataFrame:
    """doc_id and a bit mask of its labelled subjects, of at most ``limit`` documents (by hash of the id)."""
    bit = F.element_at(F.create_map(*(x for i, s in enumerate(subjects) for x in (F.lit(s), F.lit(1 << i).cast("long")))), F.col("subject"))
    masks = labels.filter(F.col("doc_id").isNotNull() & F.col("subject").isin(list(subjects))).groupBy("doc_id").agg(F.bit_or(bit).alias("mask"))
    return masks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def train(encoded: DataFrame, subjects: Sequence[str], fallback: str | None = None, rounds: int = ROUNDS) -> Model:
    """Train on ``encoded`` documents, whose ``mask`` has the labels where there are any and ``held`` those that calibrate.

    The last round uses the held-out labels too; the calibration rests on the evidence of the round before.
    If no label is held out, or all are, the calibration uses the labels that there are.
    """
    subjects = list(subjects)
    n, default = len(subjects), subjects.index(fallback) if fallback in subjects else None
    labelled = encoded.filter("mask > 0")
    held = {r[0] for r in labelled.select("held").distinct().collect()}
    if not held:
        return Model(subjects, Evidence.of(np.zeros((BUCKETS, n), np.float32)), None, default)
    split = len(held) == 2
    apart = encoded.withColumn("mask", F.when(~F.col("held"), F.col("mask"))) if split else encoded
    weights = evidence_of(count_features(apart, n, None, default))
    for _ in range(rounds - 1):
        weights = evidence_of(count_features(apart, n, weights, default))
    told = votes_of(labelled.filter("held") if split else labelled, weights, ["mask"], _Votes(n)).toPandas()  # at most LABELLED_DOCUMENTS rows
    truth = (told["mask"].to_numpy(dtype=np.int64)[:, None] >> np.arange(n)) & 1
    calibration = calibrate(told.drop(columns="mask").to_numpy(dtype=np.float64), truth, default)
    return Model(subjects, evidence_of(count_features(encoded, n, weights, default)) if rounds else weights, calibration, default)


@dataclass
class Trained:
    """Encoded documents and the model trained on them; ``kept`` are the columns carried along."""

    encoded: DataFrame
    model: Model
    kept: list[str]
    types: str

    def assign(self, threshold: float, whole: bool) -> DataFrame:
        finish = _Subjects(self.model, f"{self.types}, subject string, posterior double", threshold, whole)
        return votes_of(self.encoded, self.model.weights, self.kept, finish)

    def compose(self, by: Sequence[str], threshold: float, whole: bool) -> DataFrame:
        types = ", ".join(f"`{c}` {t}" for c, t in self.encoded.select(*by).dtypes)
        finish = _Composition(self.model, f"{types}, subject string, n long, expected double", threshold, whole)
        parts = votes_of(self.encoded, self.model.weights, list(by), finish)
        sums = parts.groupBy(*by, "subject").agg(F.sum("n").alias("n_documents"), F.sum("expected").alias("expected_documents"))
        return sums.filter("n_documents > 0 OR expected_documents > 0")


def trained(documents: DataFrame, labels: DataFrame, subjects: DataFrame, keep: Sequence[str], fallback: str | None) -> Trained | None:
    """The model of some documents; None without subjects."""
    names = [r[0] for r in subjects.select("subject").filter("subject is not null").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    if len(names) > MAX_SUBJECTS:
        raise ValueError(f"at most {MAX_SUBJECTS} subjects")
    if not names:
        return None
    ship_package(documents.sparkSession)
    kind, kept = documents.schema["doc_id"].dataType.simpleString(), ["doc_id", *keep]
    masks = label_masks(labels, names).select(F.col("doc_id").cast(kind), "mask", (F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(HELD_OUT)) == 0).alias("held"))
    # The label list is bounded by LABELLED_DOCUMENTS, so the texts needn't be shuffled for it.
    marked = documents.select(*kept, "text").join(F.broadcast(masks), "doc_id", "left")
    encoded = cut_lineage(encode_documents(marked, [*kept, "mask", "held"]))
    types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in kept)
    return Trained(encoded, train(encoded, names, fallback), kept, types)


def assign_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, keep: Sequence[str] = (), fallback: str | None = None, threshold: float = THRESHOLD, whole: bool = False
) -> DataFrame:
    """doc_id, ``keep`` columns, subject, posterior: the main subjects of each document.

    Texts that are null, empty, blank or mere punctuation have no row. Every other text has a row for
    each subject whose calibrated posterior reaches ``threshold``; with ``whole`` it has one row at
    least, the likeliest subject. ``fallback`` names a subject that also stands for texts in which
    nothing speaks of any subject. Rows that repeat a doc_id are judged one by one. Labels of unknown
    subjects or documents are ignored; with no labels at all every text goes to the fallback, with
    posterior 0 (no rows without a fallback); with no subjects there are no rows.
    """
    found = trained(documents, labels, subjects, keep, fallback)
    if found is None:
        types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in ["doc_id", *keep])
        return documents.sparkSession.createDataFrame([], f"{types}, subject string, posterior double")
    return found.assign(threshold, whole)


def compose_subjects(
    documents: DataFrame, labels: DataFrame, subjects: DataFrame, by: Sequence[str], fallback: str | None = None, threshold: float = THRESHOLD, whole: bool = False
) -> DataFrame:
    """``by`` columns, subject, n_documents, expected_documents: the make-up of the corpus.

    n_documents are those that ``assign_subjects`` gives the subject; expected_documents is the sum of
    the posteriors of all texts of the group, whether they reach the threshold or not.
    """
    found = trained(documents, labels, subjects, [c for c in by if c != "doc_id"], fallback)
    if found is None:
        types = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in by)
        return documents.sparkSession.createDataFrame([], f"{types}, subject string, n_documents long, expected_documents double")
    return found.compose(by, threshold, whole)
