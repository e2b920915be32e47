"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors.

Voters are lexicon entries (prefixes of words, found among labelled rows by how much more often toxic documents
hold them, over whole texts and all languages together), a fixed English lexicon, the number of different hits,
patterns of style, and how much a text repeats its words.  The label model is fitted by expectation maximisation: it estimates how often each voter
fires on toxic and on other documents, and how accurate the given labels are; correlations that are left between
voters given the posterior discount those that repeat each other.  A logistic regression over the voters'
firings and hit counts learns the posteriors and scores all documents.  Of its targets ``GIVEN`` is the given label
itself: posteriors alone deny each label that no voter supports, which leaves such rows without any rank.

The model learns from a bounded sample: at most ``SAMPLE_POSITIVE`` and ``SAMPLE_NEGATIVE`` labelled rows, which
is the only part that is broadcast; scores cover whole texts of all rows.

Defined results: null and empty texts get the score of a text in which no voter fires; a table without labels of
both kinds gives the score 0 everywhere; labels that repeat a doc_id count once, as toxic if one is; labels
without a doc_id, and null labels, count for nothing; repeated documents each get their row, and one text is
learned from for each label.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import textkit
from furrow.llm.language import held_out
from furrow.llm.session import prepared, settled

SAMPLE_POSITIVE = 4000
SAMPLE_NEGATIVE = 8000
VOTERS = 96
PREFIX_CHARS = range(3, 9)
THRESHOLD = 0.3
#: Share of the given label in what the classifier learns.
GIVEN = 0.2
#: Texts of so many words whose share of different words is below these are repetitive.
REPETITIVE_WORDS, REPETITIVE = 20, (0.2, 0.4)
# A small English lexicon.
LEXICON = ("asshole", "bastard", "bitch", "clown", "creep", "crap", "cretin", "damn", "disgusting", "dumb", "dumbass", "filth", "fool", "freak", "fuck", "garbage", "hate", "hideous", "idiot", "imbecile", "jerk", "kill", "loser", "lunatic", "moron", "parasite", "pathetic", "pig", "psycho", "scum", "shit", "shut", "slut", "stupid", "sucks", "trash", "ugly", "vermin", "whore", "worthless")
#: Bytes by which a word is known to begin no voter's prefix.
_HEAD = 3


@dataclass
class Model:
    prefixes: list[bytes]
    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        place, words = {p: i for i, p in enumerate(self.prefixes)}, {w.encode() for w in LEXICON}
        entries = place.keys() | words
        # a spelling may be a learned prefix, a word of the lexicon, or both
        self.by_length = {n: {p: (place.get(p), p in words) for p in entries if len(p) == n} for n in sorted({len(p) for p in entries})}
        self.sieve = np.zeros(1 << 24, bool)
        self.sieve[[int.from_bytes(p[:_HEAD], "little") for p in entries]] = True

    def features(self, data: np.ndarray, off: np.ndarray, style: np.ndarray) -> np.ndarray:
        """A row for each text: firings of the prefixes, then of the other voters."""
        starts, ends, first = textkit.words(data, off, textkit.NOT_ALNUM)
        n = np.diff(first)
        different = np.diff(textkit.distinct(textkit.word_hashes(data, starts, ends), first)[1])
        style = np.hstack([style, *[((n >= REPETITIVE_WORDS) & (different < share * n))[:, None] for share in REPETITIVE]])
        v = len(self.prefixes)
        hits = np.zeros((len(n), v + 1))
        if len(starts):
            long = np.flatnonzero(ends - starts >= _HEAD)
            at = starts[long]
            head = data[at].astype(np.int64) | data[at + 1].astype(np.int64) << 8 | data[at + 2].astype(np.int64) << 16
            maybe = long[self.sieve[head]]
            text = np.searchsorted(first, maybe, "right") - 1
            raw = data.tobytes()
            for t, a, z in zip(text.tolist(), starts[maybe].tolist(), ends[maybe].tolist(), strict=True):
                for length, known in self.by_length.items():
                    if length > z - a:
                        break
                    i, word = known.get(raw[a : a + length], (None, False))
                    if i is not None:
                        hits[t, i] += 1
                    if word and length == z - a:
                        hits[t, -1] += 1
        return voters(hits, n, style)


def voters(hits: np.ndarray, n_words: np.ndarray, style: np.ndarray) -> np.ndarray:
    """Firings from hit counts: each prefix, the lexicon, two and three different hits, density, style and repetition."""
    kinds, total = (hits[:, :-1] > 0).sum(1), hits[:, :-1].sum(1)
    dense = total / np.maximum(n_words, 1)
    extra = np.stack([hits[:, -1] > 0, total > 0, total > 1, total > 2, kinds > 1, kinds > 3, dense > 0.005, dense > 0.01, *style.T], 1)
    return np.hstack([hits[:, :-1] > 0, extra]).astype(np.float64)


def styles(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Pattern voters on the text as it is: mostly capitals, many exclamation marks."""
    upper, letter, mark = (np.concatenate([[0], np.cumsum(x)]) for x in ((data >= 65) & (data <= 90), ((data | 32) >= 97) & ((data | 32) <= 122), data == 33))
    count = lambda x: (x[off[1:]] - x[off[:-1]]).astype(float)
    size = np.maximum(off[1:] - off[:-1], 1)
    return np.stack([count(upper) > 0.5 * np.maximum(count(letter), 1), count(mark) / size > 0.02], 1)


def label_model(votes: np.ndarray, label: np.ndarray, weight: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of each row: voters independent given the class, then discounted by their left-over correlations."""
    post = np.where(label == 1, 0.95, 0.05)
    trust, discount = 0.95, np.ones(votes.shape[1])
    for _ in range(rounds):
        w1, w0 = post * weight, (1 - post) * weight
        p1 = (w1 @ votes + 0.5) / (w1.sum() + 1)
        p0 = (w0 @ votes + 0.5) / (w0.sum() + 1)
        left = (votes - np.outer(post, p1) - np.outer(1 - post, p0)) * np.sqrt(weight)[:, None]
        cov = left.T @ left
        spread = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        rho = np.clip(cov / np.outer(spread, spread), 0, 1)
        discount = 1 / rho.sum(1)
        prior = np.clip((post * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4)
        agree = np.where(label == 1, post, 1 - post)
        trust = np.clip((agree * weight).sum() / weight.sum(), 0.6, 0.999)
        logit = np.log(prior / (1 - prior)) + np.where(label == 1, 1, -1) * np.log(trust / (1 - trust))
        logit = logit + votes @ (discount * np.log(p1 / p0)) + (1 - votes) @ (discount * np.log((1 - p1) / (1 - p0)))
        post = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return post


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (weight * (y - p)) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _prefixes(drawn: DataFrame) -> list[bytes]:
    """The prefixes that most set toxic documents of the sample apart; of those in the same documents, the shortest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: dict[int, Counter[bytes]] = {0: Counter(), 1: Counter()}
            lower = pc.utf8_lower(b.column(0))
            for (lo, hi, data, off), labels in ((s, b.column(1)[s[0] : s[1]].to_pylist()) for s in textkit.slices(lower)):
                starts, ends, first = textkit.words(data, off, textkit.NOT_ALNUM)
                raw = data.tobytes()
                for i in range(hi - lo):
                    words = {raw[a:z] for a, z in zip(starts[first[i] : first[i + 1]].tolist(), ends[first[i] : first[i + 1]].tolist(), strict=True)}
                    seen[labels[i]].update({t[:k].encode() for t in (w.decode("utf-8", "replace") for w in words) for k in PREFIX_CHARS if len(t) >= k})
            both = list(seen[1].keys() | seen[0].keys())
            yield pa.record_batch([pa.array(both, pa.binary()), pa.array([seen[1][p] for p in both], pa.int64()), pa.array([seen[0][p] for p in both], pa.int64())], ["prefix", "pos", "neg"])

    counts = drawn.select("text", "toxic").mapInArrow(run, "prefix binary, pos long, neg long").groupBy("prefix").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    totals = drawn.agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg")).first()
    odds = F.log((F.col("pos") + 0.5) / (totals["pos"] + 1)) - F.log((F.col("neg") + 0.5) / (totals["neg"] + 1))
    best = counts.where("pos >= 3").withColumn("odds", odds).where("odds > 1.5").withColumn("gain", F.col("odds") * F.sqrt("pos"))
    rows = best.orderBy(F.desc("gain"), F.length("prefix"), "prefix").limit(40 * VOTERS).collect()  # in this order
    found = {bytes(r["prefix"]): (r["pos"], r["neg"]) for r in rows}

    def told(p: bytes) -> bool:
        """Whether a beginning of it, on all its toxic documents at least, is about as clean."""
        pos, neg = found[p]
        return any(p[:n] in found and 2 * neg * found[p[:n]][0] >= found[p[:n]][1] * pos for n in range(1, len(p)))

    return [p for p in found if not told(p)][:VOTERS]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """A model learned from the given labels."""
    spark = prepared(docs.sparkSession)
    marked = labels.select(F.col("doc_id").alias("labelled"), F.col(label_col).cast("int").alias("toxic")).where("labelled IS NOT NULL AND toxic IN (0, 1)").groupBy("labelled").agg(F.max("toxic").alias("toxic"))
    size = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return None
    order = F.xxhash64("labelled")
    picked = marked.where("toxic = 1").orderBy(order).limit(SAMPLE_POSITIVE).unionByName(marked.where("toxic = 0").orderBy(order).limit(SAMPLE_NEGATIVE))
    texts = docs.select(F.col(id_col).alias("labelled"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), "labelled")
    # one text for each label, so that a doc_id on many rows doesn't outgrow the sample; read once
    drawn = settled(texts.groupBy("labelled").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic"))
    prefixes = _prefixes(drawn)
    probe = spark.sparkContext.broadcast(Model(prefixes, np.zeros(0), 0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, fired in _firings(probe.value, b.column(0)):
                yield pa.record_batch([b.column(1)[lo:hi], pa.array([r.tobytes() for r in np.packbits(fired > 0, axis=1)], pa.binary())], ["toxic", "fired"])

    got = sorted((r["toxic"], bytes(r["fired"])) for r in drawn.mapInArrow(run, "toxic int, fired binary").collect())
    label = np.array([t for t, _ in got])
    if not 0 < label.sum() < len(label):
        return None
    width = voters(np.zeros((1, len(prefixes) + 1)), np.zeros(1), np.zeros((1, 2 + len(REPETITIVE)))).shape[1]
    votes = np.unpackbits(np.stack([np.frombuffer(f, np.uint8) for _, f in got]), axis=1)[:, :width].astype(np.float64)
    drawn_size = {c: (label == c).sum() for c in (0, 1)}
    weight = np.where(label == 1, size[1] / drawn_size[1], size[0] / drawn_size[0])
    weight *= len(weight) / weight.sum()
    w = regression(votes, (1 - GIVEN) * label_model(votes, label, weight) + GIVEN * label, weight)
    return Model(prefixes, w[:-1], float(w[-1]))


def _firings(model: Model, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    lower = pc.utf8_lower(column)
    for lo, hi, data, off in textkit.slices(column):
        low_data, low_off = textkit.buffers(lower[lo:hi])
        yield lo, hi, model.features(low_data, low_off, styles(data, off))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # at most VOTERS prefixes
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if m is None:
                yield pa.record_batch([b.column(0), pa.array(np.zeros(b.num_rows))], ["doc_id", "score"])
                continue
            for lo, hi, fired in _firings(m, b.column(1)):
                yield pa.record_batch([b.column(0)[lo:hi], pa.array(1 / (1 + np.exp(-np.clip(fired @ m.weights + m.bias, -30, 30))))], ["doc_id", "score"])

    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return base.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted); learns from labels of rows that aren't held out."""
    found = score(docs, fit(docs, labels.where(~held_out("doc_id", 4, 2))))
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
