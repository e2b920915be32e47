"""Texts that take long or lose something if a step is careless: repetitions, broken quotes, runs of a rule's beginning, hot keys."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from furrow.llm import decontaminate, html_text, near_dedup, private_data, secret_scan, session, textkit, toxicity
from tests.llm import brute

DOCS = "doc_id long, text string"


# 4: longest matches


def searched(texts, items, window=10):
    block = decontaminate.Block.of(items, window)
    return {row: (best, found) for row, _, found, best in decontaminate._search(*textkit.encode(texts), block, window)[1]}


def longest(doc, items, window):
    d, best = brute.ALNUM.findall(doc), 0
    for _, text in items:
        b = brute.ALNUM.findall(text)
        for p in range(len(d)):
            for q in range(len(b)):
                n = 0
                while p + n < len(d) and q + n < len(b) and d[p + n] == b[q + n]:
                    n += 1
                if n and (n >= window or n == len(b)):
                    best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_longest_matches_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(40):
        items = [(str(i), " ".join(rng.choice("abc") for _ in range(rng.choice([0, 2, 5, 30])))) for i in range(4)]
        docs = [" ".join(rng.choice("abcd") for _ in range(rng.choice([0, 3, 20, 60]))) for _ in range(4)] + [items[2][1], items[1][1] + " " + items[2][1] + " d " + items[3][1][:21]]
        got = searched(docs, items, 4)
        assert [got.get(i, (0,))[0] for i in range(len(docs))] == [longest(doc, items, 4) for doc in docs]


def test_repetitive_texts_and_common_lines_take_linear_time():
    began = time.perf_counter()
    assert searched(["a " * 100_000], [("1", "a " * 20_000)])[0][0] == 20_000
    line = " ".join(f"w{i}" for i in range(10))
    best, found = searched([(line + " x. ") * 8000], [(str(i), f"{line} y{i}") for i in range(8000)])[0]
    assert best == 10 and len(found) == 8000
    assert time.perf_counter() - began < 10


# 6: secrets


@pytest.mark.parametrize("start", ["eyJ", "eyJabcdefgh.", "-----BEGIN ", "ghp_", "xoxb-", "AIza", "sk_live_", "password", "token = ", "AKIA", "abcdef", "api_key:"])
def test_runs_of_a_rules_beginning_take_linear_time(spark, start):
    docs = spark.createDataFrame([(1, start * (1_000_000 // len(start)) + " .eyJ")], DOCS)
    began = time.perf_counter()
    assert secret_scan.digest(docs).count() == 1 and secret_scan.digest(docs).first() is not None
    assert time.perf_counter() - began < 30


def test_tokens_begin_where_their_run_does(spark):
    token = "eyJabcdefgh.eyJabcdefgh.abcdefgh_"
    texts = [token, f"({token})", f"x{token}", f"{token} {token}", f"é{token}", f"{token}.{token}", f"eyJ.{token}"]
    got = {r["doc_id"]: [(s["start"], s["end"]) for s in r["spans"] if s["kind"] == "jwt"] for r in secret_scan.spans(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    n = len(token)
    assert got == {0: [(0, n)], 1: [(1, 1 + n)], 2: [], 3: [(0, n), (n + 1, 2 * n + 1)], 4: [(1, 1 + n)], 5: [(0, n), (n + 1, 2 * n + 1)], 6: [(4, 4 + n)]}
    masked = {r["doc_id"]: r["text"] for r in secret_scan.redacted(spark.createDataFrame([(1, f"({token}) x{token}")], DOCS)).collect()}
    assert masked == {1: f"([secret]) x{token}"}


def test_many_candidates_and_hot_texts(spark, monkeypatch):
    rows = [(i, "") for i in range(300)] + [(i, None) for i in range(300, 400)] + [(i, f"secret: abcdef{i % 7}") for i in range(400, 900)] + [(i, "a secret is kept") for i in range(900, 1000)]
    docs = spark.createDataFrame(rows, DOCS)
    wanted = sorted(map(tuple, secret_scan.digest(docs).collect()))
    masked = sorted((r["doc_id"], r["text"]) for r in secret_scan.redacted(docs).collect())
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, secret_scan.digest(docs).collect())) == wanted
    assert sorted((r["doc_id"], r["text"]) for r in secret_scan.redacted(docs).collect()) == masked
    assert sum(t == "[secret]" for _, t in masked) == 500


# 7: pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<a title='x>more</a><p>She said \"no\" and 5\" pipes", 'more She said "no" and 5" pipes'),
        ('<img alt="a picture><p>It\'s a dog\'s life, don\'t', "It's a dog's life, don't"),
        ("<p>\"One\" isn't two</p><a href='x>three</a><p>\"four\" five", "\"One\" isn't two three \"four\" five"),
        ("<p>'a' \"b\"</p><i title=\"x>y</i><b title='z>w</b><p>c", "'a' \"b\" yw c"),
        ("<a title='x>y</a><p>It's \"said\"", "y It's \"said\""),
        ("<b y='>'one <b class='>'two", "'one 'two"),
        ("<p>plain \"quotes\" and it's fine", "plain \"quotes\" and it's fine"),
    ],
)
def test_an_unclosed_quote_costs_itself_alone(page, text):
    assert html_text.main_text(page) == text


def test_many_tags_with_unclosed_quotes_take_linear_time():
    began = time.perf_counter()
    for tag in ("<a title='x>y</a>", '<a title="x>y</a>', "<a title=\"x>y</a><b title='z>", "<b y='>'", "<b y='>\"", "<a x=\"'>"):
        html_text.main_text(tag * (1_000_000 // len(tag)) + "<p>It's \"said\"")
    assert time.perf_counter() - began < 30


def test_spans_of_hits_are_listed(spark):
    item = " ".join(f"v{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {item} y {item}"), (2, None), (3, "x")], DOCS)
    got = {r["doc_id"]: (r["longest_match"], r["spans"]) for r in decontaminate.report(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (12, "1:13,14:26"), 2: (0, ""), 3: (0, "")}
    assert decontaminate.report(docs.where(F.lit(False)), spark.createDataFrame([], "item_id long, text string")).count() == 0


# 8: hot components, copies and rows


def test_hot_components_and_rows_meet_by_broadcast(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randrange(900)}" for _ in range(60)]
    near = [" ".join([*base[:i], f"x{i}", *base[i + 1 :]]) for i in range(12)]
    rows = [(i, rng.choice(near)) for i in range(60)] + [(100 + i, f"alone {i} and of many other words {i}") for i in range(8)] + [(7, near[0])] * 30 + [(None, "no id but words here")] * 9 + [(200, None), (201, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("n", F.lit(1)).withColumn("key", F.lit("x"))
    wanted = brute.components([(i, t) for i, t in rows if i is not None], 5, 0.8)
    plain = sorted(map(repr, map(tuple, near_dedup.first_of_each(docs).collect())))
    monkeypatch.setattr(session, "HOT_ROWS", 3)
    monkeypatch.setattr(session, "HOT_KEYS", 1000)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_components(docs).collect() if r["doc_id"] is not None}
    assert got == wanted
    hot = near_dedup.first_of_each(docs)
    assert hot.columns == docs.columns and sorted(map(repr, map(tuple, hot.collect()))) == plain
    assert sorted(r["doc_id"] for r in hot.collect() if r["doc_id"] is not None) == sorted({*wanted.values()})
    assert near_dedup.first_of_each(docs.where("doc_id < 0")).count() == 0


def test_ranks_of_texts_without_toxic_words():
    data, off = textkit.encode(["ha " * 40, " ".join(f"word{i}" for i in range(40)), "ha ha"])
    fired = toxicity.Model([b"loser"], np.zeros(0), 0.0).features(data, off, np.zeros((3, 2)))
    assert fired[:, -2:].tolist() == [[1, 1], [0, 0], [0, 0]]


# 9: mail addresses


def test_mail_domains_of_other_scripts_are_found(spark):
    texts = ["write to anna9@müller.de or x@почта.рф, not to a@b", "anna9@example.com"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    there = private_data.pseudonymised(docs)
    got = {r["doc_id"]: r for r in there.collect()}
    assert got[0]["n_email"] == 2 and "anna9@" not in got[0]["text"] and "@müller.de" in got[0]["text"] and "@почта.рф" in got[0]["text"] and got[0]["text"].endswith("a@b")
    assert got[0]["text"].split("@")[0].removeprefix("write to ") == got[1]["text"].split("@")[0]  # linked whatever the domain
    back = private_data.pseudonymised(there.select("doc_id", "text"), inverse=True)
    assert {r["doc_id"]: r["text"] for r in back.collect()} == dict(enumerate(texts))
