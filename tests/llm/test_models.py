"""Fingerprints, language scores and the label model against plain loops."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from furrow.llm import fingerprints, language, textkit, toxicity
from tests.llm import brute

M64 = (1 << 64) - 1
TEXTS = ["a b c d e f g", "A b C d E f g h", "one two", "", " \t ", "x " * 40, "ß é ü ö ä ñ ø", "the quick brown fox jumps over the lazy dog again and again"]


def shingle_hash(words: tuple[str, ...]) -> int:
    """The hash of one shingle by itself."""
    data, off = textkit.encode([" ".join(words)])
    starts, ends, first = textkit.words(data, off)
    return int(textkit.windows(textkit.word_hashes(data, starts, ends), first, 5)[0][0])


def test_minima_equal_a_loop_over_shingles():
    got = fingerprints.minima(*textkit.encode(TEXTS))
    for row, text in zip(got, TEXTS, strict=True):
        hashes = [shingle_hash(s) for s in brute.shingles(text, 5)]
        for i in range(fingerprints.PERMUTATIONS):
            a, b = int(fingerprints._A[i]), int(fingerprints._B[i])
            assert row[i] == (min((a * x + b) & M64 for x in hashes) & 0xFFFF if hashes else 0xFFFF)


def test_likeness_is_the_share_of_equal_minima(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = {r["doc_id"]: r for r in fingerprints.edited_fingerprints(docs).collect()}
    values = lambda h: [h[i : i + 4] for i in range(0, len(h), 4)]
    share = lambda x, y: sum(a == b for a, b in zip(values(x), values(y), strict=True)) / fingerprints.PERMUTATIONS
    for i, r in rows.items():
        after = rows[(i + 1) % len(TEXTS)]
        assert r["near_edited"] == pytest.approx(share(r["fingerprint"], r["edited_fingerprint"])) and r["near_next"] == pytest.approx(share(r["fingerprint"], after["fingerprint"]))


def grams(text: str) -> set[int]:
    """The hashed places of a text's byte n-grams."""
    raw, out = text.encode(), set()
    for n in language.ORDERS:
        for p in range(len(raw) - n + 1):
            x = int.from_bytes(raw[p : p + n], "big") & 0xFFFFFFFF
            out.add(((x * int(language._SALTS[n - 1]) + n) & 0xFFFFFFFF) * 0x2545F491 % (1 << 32) >> (32 - 14))
    return out


def test_language_scores_equal_plain_sums(spark):
    rng = random.Random(1)
    word = lambda kind: "".join(rng.choice({"x": "aeiouklm", "y": "bdgrstäö"}[kind]) for _ in range(rng.randrange(2, 7)))
    rows = [(i, " ".join(word(k) for _ in range(12)), k) for i, k in enumerate("xy" * 40)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), landmarks=30)
    asked = [t for _, t, _ in rows[:6]] + TEXTS[:3]
    got = model.scores(language.presence(*textkit.encode(asked)))
    for row, text in zip(got, asked, strict=True):
        held = grams(text)
        value = [language.SHARPNESS * (sum(float(model.weights[g, c]) for g in held) / math.sqrt(max(len(held), 1)) + float(model.bias[c])) for c in range(2)]
        total = sum(math.exp(v - max(value)) for v in value)
        assert row.tolist() == pytest.approx([math.exp(v - max(value)) / total for v in value], rel=1e-3)
    right = [model.names[c] == k for c, (_, _, k) in zip(model.scores(language.presence(*textkit.encode([t for _, t, _ in rows]))).argmax(1).tolist(), rows, strict=True)]
    assert sum(right) == len(rows)


def test_empty_tables_and_missing_labels_of_the_models(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language.identify(none).count() == 0
    assert toxicity.classify(none, spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
    some = spark.createDataFrame([(1, "a text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in language.identify(some).collect()] == [("und", 0.0)]
    assert [tuple(r)[2:] for r in toxicity.classify(some, spark.createDataFrame([(1, 1)], "doc_id long, toxic int")).collect()] == [(0.0, 0)]


def looped_label_model(votes, label, weight, rounds):
    rows, voters = len(votes), len(votes[0])
    post, discount = [0.95 if y == 1 else 0.05 for y in label], [1.0] * voters
    for _ in range(rounds):
        w1, w0 = [p * w for p, w in zip(post, weight, strict=True)], [(1 - p) * w for p, w in zip(post, weight, strict=True)]
        p1 = [(sum(w1[i] * votes[i][j] for i in range(rows)) + 0.5) / (sum(w1) + 1) for j in range(voters)]
        p0 = [(sum(w0[i] * votes[i][j] for i in range(rows)) + 0.5) / (sum(w0) + 1) for j in range(voters)]
        left = [[(votes[i][j] - post[i] * p1[j] - (1 - post[i]) * p0[j]) * math.sqrt(weight[i]) for j in range(voters)] for i in range(rows)]
        cov = lambda j, k: sum(r[j] * r[k] for r in left)  # noqa: B023, E731
        spread = [math.sqrt(max(cov(j, j), 1e-9)) for j in range(voters)]
        discount = [1 / sum(min(1.0, max(0.0, cov(j, k) / (spread[j] * spread[k]))) for k in range(voters)) for j in range(voters)]
        prior = min(1 - 1e-4, max(1e-4, sum(w1) / sum(weight)))
        trust = min(0.999, max(0.6, sum((p if y == 1 else 1 - p) * w for p, y, w in zip(post, label, weight, strict=True)) / sum(weight)))
        new = []
        for i in range(rows):
            logit = math.log(prior / (1 - prior)) + (1 if label[i] == 1 else -1) * math.log(trust / (1 - trust))
            logit += sum(discount[j] * (math.log(p1[j] / p0[j]) if votes[i][j] else math.log((1 - p1[j]) / (1 - p0[j]))) for j in range(voters))
            new.append(1 / (1 + math.exp(-min(30, max(-30, logit)))))
        post = new
    return post


@pytest.mark.parametrize("seed", range(3))
def test_label_model_equals_plain_loops(seed):
    rng = random.Random(seed)
    label = [int(rng.random() < 0.3) for _ in range(50)]
    votes = [[float(rng.random() < (0.7 if y else 0.1)) for _ in range(4)] for y in label]
    votes = [[*v, v[0]] for v in votes]  # one voter repeats another
    weight = [rng.choice([0.5, 1.0, 2.0]) for _ in label]
    got = toxicity.label_model(np.array(votes), np.array(label), np.array(weight), rounds=6)
    assert got.tolist() == pytest.approx(looped_label_model(votes, label, weight, 6), abs=1e-6)
