"""Language identification with a string kernel.

A text is the set of hashed byte n-grams, n from 1 to 4, of its lower case (blended-spectrum presence
features); the kernel of two texts is the cosine of their sets.  Nyström landmarks stand for the whole sample,
and one-versus-rest ridge regression is solved in the space they span.  As the kernel is linear in the
features, the landmarks and their weights fold into one matrix, and a batch of texts is scored by one matrix
product.

The model learns from a bounded sample of labelled rows: about ``SAMPLE_ROWS`` different texts, spread evenly over
the languages, of which ``LANDMARKS`` are landmarks.  Of each language those texts are drawn whose hash is lowest,
up to a border that its number of different texts sets; so the sample doesn't depend on the partitions, copies of
a text count once, and every language has at least one text in it.  Everything else covers all rows and whole texts.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text when there
is nothing to learn from; rows without a lang aren't learned from; rows without a doc_id count as held out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import textkit
from furrow.llm.session import prepared

FEATURES = 1 << 14
ORDERS = (1, 2, 3, 4)
SAMPLE_ROWS = 4000
LANDMARKS = 600
RIDGE = 0.1
#: Scores are the softmax of the regressions' values times this.
SHARPNESS = 6.0
UNDETERMINED = "und"
_SALTS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_BLOCK = 1 << 18
#: Bits of a text's place in the order in which the sample is drawn.
_PLACES = 48


@dataclass
class Model:
    names: list[str]
    weights: np.ndarray  # features by languages
    bias: np.ndarray

    def scores(self, features: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(features.sum(1, dtype=np.float32), 1))[:, None]
        product = np.concatenate([features[lo : lo + 64].astype(np.float32) @ self.weights for lo in range(0, len(features), 64)])
        value = SHARPNESS * (product / norm + self.bias)
        value = np.exp(value - value.max(1, keepdims=True))
        return value / value.sum(1, keepdims=True)


def presence(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which hashed n-grams each text has; n-grams don't reach over the end of a text."""
    out = np.zeros((len(off) - 1, FEATURES), bool)
    flat = out.ravel()
    for lo in range(0, len(data), _BLOCK):
        hi = min(lo + _BLOCK, len(data))
        edges = np.clip(off, lo, hi)
        text = np.repeat(np.arange(len(off) - 1) * FEATURES, np.diff(edges))
        left = np.repeat(off[1:], np.diff(edges)) - np.arange(lo, hi)  # bytes up to the text's end
        piece = data[lo : hi + 3].astype(np.uint32)
        gram = np.zeros(hi - lo, np.uint32)
        for n in ORDERS:
            more = piece[n - 1 : n - 1 + hi - lo]
            m = len(more)
            gram[:m] = (gram[:m] << np.uint32(8)) | more
            fits = left[:m] >= n
            slot = (gram[:m] * _SALTS[n - 1] + np.uint32(n)) * np.uint32(0x2545F491) >> np.uint32(32 - 14)
            flat[(text[:m] + slot)[fits]] = True
    return out


def _lettered(column: pa.Array, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether each text has a letter."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.concatenate([[0], np.cumsum(ascii_letter)])
    found = total[off[1:]] > total[off[:-1]]
    for i in np.flatnonzero(~found & (off[1:] > off[:-1])):
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def held_out(column: str, parts: int, part: int) -> F.Column:
    """Whether crc32 of the id as text leaves that remainder; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))), F.lit(parts)) == part


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS, landmarks: int = LANDMARKS) -> Model | None:
    """A model of the languages of the given rows; None if no row has a text and a language."""
    prepared(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    place = F.pmod(F.xxhash64("text"), F.lit(1 << _PLACES))
    # copies count once, so that a share of the places is that share of a language's different texts; a sketch counts them
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct(place, 0.02).alias("n"), F.min(place).alias("first")).collect()
    if not sizes:
        return None
    each = max(1, sample_rows // len(sizes))
    # the first place is drawn whatever the share is, so no language is missing
    border = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(r["first"] + 1, int(min(1.0, each / r["n"]) * (1 << _PLACES))))])
    drawn = rows.where(place < border[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, off in textkit.slices(pc.utf8_lower(b.column(0))):
                bits = np.packbits(presence(data, off), axis=1)
                yield pa.record_batch([b.column(1)[lo:hi], pa.array([r.tobytes() for r in bits], pa.binary())], ["lang", "bits"])

    # an even share of each language, in an order that doesn't depend on the partitions; copies count once
    got = sorted((r["lang"], bytes(r["bits"])) for r in drawn.mapInArrow(run, "lang string, bits binary").distinct().collect())
    if not got:
        return None
    names = sorted({lang for lang, _ in got})
    bits = np.stack([np.frombuffer(x, np.uint8) for _, x in got])
    label = np.array([names.index(lang) for lang, _ in got])
    order = np.random.default_rng(5).permutation(len(got))
    rank = np.empty(len(got), int)
    for c in range(len(names)):
        own = order[label[order] == c]
        rank[own] = np.arange(len(own))
    chosen = np.sort(np.argsort(rank, kind="stable")[:landmarks])

    def unit(part: np.ndarray) -> np.ndarray:
        x = np.unpackbits(part, axis=1).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(1), 1))[:, None]  # in place, as this is the driver's memory
        return x

    marks = unit(bits[chosen])
    kernel = np.concatenate([unit(bits[lo : lo + 256]) @ marks.T for lo in range(0, len(bits), 256)]).astype(np.float64)
    value, vector = np.linalg.eigh(kernel[chosen])
    sound = value > 1e-6 * value.max()
    root = vector[:, sound] / np.sqrt(value[sound])
    z = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.bincount(label, minlength=len(names))[label]
    weight *= len(weight) / weight.sum()
    ridge = RIDGE * np.eye(z.shape[1])
    ridge[-1, -1] = 1e-6
    solved = np.linalg.solve((z * weight[:, None]).T @ z + ridge, (z * weight[:, None]).T @ y)
    return Model(names, (marks.T @ (root @ solved[:-1]).astype(np.float32)).astype(np.float32), solved[-1].astype(np.float32))


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # features by languages, whatever the input
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        m = shared.value
        for b in batches:
            lower = pc.utf8_lower(b.column(1))
            for lo, hi, data, off in textkit.slices(lower):
                lettered = _lettered(lower[lo:hi], data, off)
                if m is None:
                    names, best = [UNDETERMINED] * (hi - lo), np.zeros(hi - lo)
                else:
                    score = m.scores(presence(data, off))
                    names = [m.names[c] if ok else UNDETERMINED for c, ok in zip(score.argmax(1).tolist(), lettered.tolist(), strict=True)]
                    best = np.where(lettered, score.max(1), 0.0)
                yield pa.record_batch([b.column(0)[lo:hi], pa.array(names, pa.string()), pa.array(best.astype(np.float64))], ["doc_id", "lang_pred", "score"])

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score); learns from the rows that aren't held out."""
    model = fit(docs.where(~held_out("doc_id", 5, 0)))
    found = predict(docs, model)
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


def _with_letters(docs: DataFrame) -> DataFrame:
    """The documents, with their columns, whose text has a letter."""
    prepared(docs.sparkSession)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        for b in batches:
            lower = pc.utf8_lower(b.column(1))
            for lo, hi, data, off in textkit.slices(lower):
                yield pa.record_batch([b.column(0)[lo:hi].filter(pa.array(_lettered(lower[lo:hi], data, off)))], ["row"])

    return whole.mapInArrow(run, T.StructType([whole.schema["row"]])).select("row.*")


def accepted(docs: DataFrame, least_score: float = 0.0) -> DataFrame:
    """The documents, with their columns, whose language can be told: not ``und``, and of at least that score.

    Without a model there are no scores, and every text with a letter stays.
    """
    model = fit(docs.where(~held_out("doc_id", 5, 0)))
    if model is None:
        return _with_letters(docs)
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return predict(whole, model, "row", "text").where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least_score)).select("doc_id.*")
