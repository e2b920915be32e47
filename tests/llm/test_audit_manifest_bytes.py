"""Filter audit and manifest against plain Python, byte-pair tokens against the tokenizers library."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from furrow.llm import byte_pairs, filter_audit, manifest, textkit
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"
LONG = " ".join(f"w{i}" for i in range(200))
ODD = [
    (1, LONG, "en", "a", 7), (2, LONG, "en", "a", 7), (2, LONG, "en", "a", 7), (3, None, None, None, None), (4, "", "", "", 0), (None, LONG, "en", None, 1), (None, "x y", "de", "a", 3),
    (5, "AB c $", "de", "b", 6), (5, "other text", "de", "b", 6), (6, "é ß " * 300, "de", "ä", None), (7, "Same " * 150, "en", "a", 1), (8, "　x y", "en", "a", 1), (9, "A" * 5000, "en", "a", 1),
    (-3, "AB c $", "de", "b", 6), (1 << 62, "AKIA|", "en", "a", 1), (-(1 << 63), "a", "en", "a", 1),
]
MARKS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (5, 0, 1), (77, 1, 1), (None, 1, 1), (6, None, None)]


def same(df, wanted):
    assert Counter(map(repr, map(tuple, df.collect()))) == Counter(map(repr, wanted))


# 11: filter audit


def audited(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    failed = defaultdict(list)
    for i, t, lang, *_ in docs:
        t = t or ""
        w = brute.WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        failed[lang or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out = []
    for part, rows in failed.items():
        shapley, steps = Counter(), []
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [(g, t) for x, g, t in rows if f in x and not x & before]
                shapley[f] += len(here)
                steps.append((part, "".join(order), k + 1, sum(not x & (before | {f}) for x, *_ in rows), len(here), sum(f in x and bool(x & before) for x, *_ in rows), sum(x == {f} for x, *_ in rows), sum(g for g, _ in here), sum(t for _, t in here), f))
        out += [(*s[:-1], shapley[s[-1]]) for s in steps]
    return out


def test_audit_of_odd_rows_equals_brute_force(spark):
    docs, labels = spark.createDataFrame(ODD, DOCS).withColumn("word", F.lit(1)).withColumn("n", F.lit("x")), spark.createDataFrame(MARKS, LABELS)
    same(filter_audit.audit(docs, labels), audited(ODD, MARKS))


def test_audit_of_random_rows_equals_brute_force(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "B", "c#", "Dd", "e"]) + str(rng.randrange(rng.choice([5, 400]))) for _ in range(rng.choice([3, 99, 100, 250]))) for _ in range(60)]
    docs = [(i, rng.choice(texts), rng.choice(["x", "y", None]), None, None) for i in range(150)]
    labels = [(rng.randrange(150), rng.randrange(2), rng.randrange(2)) for _ in range(80)]
    same(filter_audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)), audited(docs, labels))


def test_audit_of_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filter_audit.audit(none, labels).count() == 0
    got = filter_audit.audit(spark.createDataFrame(ODD[:3], DOCS), labels)
    assert got.count() == 600 and got.agg(F.sum("good_lost")).first()[0] == 0


def test_words_of_repeated_rows_count_once(spark):
    rows = spark.createDataFrame([(1, "a b a")] * 40 + [(2, "a b a"), (3, "")], "doc_id long, text string").withColumn("h", F.xxhash64("text"))
    got = {r["doc_id"]: (r["n_words"], r["n_distinct"]) for r in filter_audit.word_counts(rows).collect()}
    assert got == {1: (3, 2), 2: (3, 2), 3: (0, 0)}


# 12: manifest


def manifested(docs):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, t, lang, source, n):
        return brute.sha("".join(map(field, (i, source, lang, n, t))))

    def climb(nodes, at, fold):
        siblings = ""
        while len(nodes) > 1:
            run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
            siblings += "".join(run[: at % 16] + run[at % 16 + 1 :])
            fold = brute.sha("".join(run[: at % 16] + [fold] + run[at % 16 + 1 :]))
            nodes, at = [brute.sha("".join(nodes[k : k + 16])) for k in range(0, len(nodes), 16)], at // 16
        return nodes[0], siblings, fold

    groups = defaultdict(list)
    for i, t, lang, source, n in docs:
        lower = None if t is None else t.translate(brute.FOLD)
        changed = leaf(i, lower if i is not None and zlib.crc32(str(i).encode()) % 5 == 0 else t, lang, source, n)
        groups[(source is not None, (source or "").encode())].append(((i is not None, i or 0), leaf(i, t, lang, source, n), i, changed))
    order = sorted(groups)
    for g in order:
        groups[g].sort(key=lambda x: x[:2])
    tops = [climb([x[1] for x in groups[g]], 0, "")[0] for g in order]
    out = []
    for k, g in enumerate(order):
        for at, (_, own, i, changed) in enumerate(groups[g]):
            top, inner, fold = climb([x[1] for x in groups[g]], at, changed)
            root, outer, fold = climb(tops, k, fold)
            out.append((i, own, top, root, brute.sha(inner + outer), fold, fold == root))
    return out


def test_manifest_of_odd_rows_equals_brute_force(spark):
    docs = spark.createDataFrame(ODD, DOCS)
    same(manifest.manifest(docs.withColumn("g", F.lit(1)).withColumn("at", F.lit("x"))), manifested(ODD))


@pytest.mark.parametrize("rows", [1, 16, 17, 600])
def test_manifest_of_so_many_rows(spark, rows):
    rng = random.Random(rows)
    docs = [(rng.randrange(-5000, 1 << 40), f"Text {k}", "en", rng.choice(["hot", "hot", "hot", f"s{k % 40}"]) if rows > 17 else "s", k) for k in range(rows)]
    same(manifest.manifest(spark.createDataFrame(docs, DOCS).repartition(5)), manifested(docs))


def test_manifest_of_repeated_rows_and_many_sources(spark, monkeypatch):
    monkeypatch.setattr(manifest, "COPIES", 7)
    monkeypatch.setattr(manifest, "DIGIT_BITS", 4)
    docs = [(5, "same", None, "s", 1)] * 40 + [(k % 3, f"t{k % 5}", None, "s", 1) for k in range(40)] + [(k, "x", None, f"https://site{k}.org", 1) for k in range(60)]
    same(manifest.manifest(spark.createDataFrame(docs, DOCS)), manifested(docs))
    tops = spark.createDataFrame([("=" + s, s) for s in ("b", "a", "https://x", "https://y", "é", "", "abcd", "abc")] + [("", "null")], "g string, digest string")
    got = {r["g"]: r["at"] for r in manifest.source_ranks(tops, 2).collect()}
    assert [g for g, _ in sorted(got.items(), key=lambda x: x[1])] == sorted(got, key=str.encode) and sorted(got.values()) == list(range(9))


def test_manifest_of_an_empty_table(spark):
    assert manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


# 13: byte pairs


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.Vocabulary.of(byte_pairs.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(byte_pairs.VOCABULARY))


PIECES = ["a", "b", " ", "  ", "\n", "'", "s", "'s", "'re", "l", "ll", "1", "23", "!", "--", "é", "ß", " ", "　", "日", "😀", "\t", "T", "the", " don't", "<|endoftext|>", "<|endof", "́", "²", "Ⅷ", "\x00", "\x85", "…", "'S"]


def encoded(vocabulary, texts):
    ids, first = byte_pairs.tokens(vocabulary, *textkit.encode(texts))
    return [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]


def mixed(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)] + ["", "a" * 3000, "-" * 3000, " " * 2000, "\n" * 999 + "x", "word " * 2000]


@pytest.mark.parametrize("segment", [16, byte_pairs.SEGMENT_BYTES])
def test_tokens_and_texts_equal_the_library(vocabulary, library, monkeypatch, segment):
    monkeypatch.setattr(byte_pairs, "SEGMENT_BYTES", segment)
    texts = mixed(2000, segment)
    got = encoded(vocabulary, texts)
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [byte_pairs._text(vocabulary, np.array(ids, np.int32), 3) for ids in got] == texts


def test_broken_characters_decode_as_in_the_library(vocabulary, library):
    rng = random.Random(11)
    for _ in range(1500):
        ids = [rng.randrange(50257) if rng.random() < 0.5 else rng.randrange(256) for _ in range(rng.randrange(12))]
        assert byte_pairs._text(vocabulary, np.array(ids, np.int32), 1) == library.decode(ids, skip_special_tokens=False)


def test_streaming_within_the_lookahead_equals_merging_whole(vocabulary):
    rng = random.Random(4)
    known = [b for b in vocabulary.bytes if b]
    hard = [b"-" * 700, b" " * 700, b"=" * 900, b"a" * 900, rng.randbytes(2000)]
    hard += [b"".join(rng.choice(known) for _ in range(100)) for _ in range(60)]
    for _ in range(60):
        k = rng.choice(known)
        hard.append(b"".join(rng.choice([k, k[:1], k[-1:], k[1:]]) for _ in range(200)))
    assert 0 < vocabulary.lookahead < 1000
    for data in hard:
        encoder, out, at = byte_pairs.Encoder(vocabulary, 1), [], 0
        while at < len(data):
            step = rng.randrange(1, 9)
            out += encoder.feed(data[at : at + step])
            at += step
            assert len(encoder.held) <= encoder.most
        assert out + encoder.flush() == vocabulary.merged(data)


def test_lookahead_of_small_merge_lists():
    assert byte_pairs.lookahead([], [1]) == 0
    # ab first, then bc: whether "b c" merges doesn't depend on the right; "a (bc)" needs all of bc
    assert byte_pairs.lookahead([(0, 1, 3)], [1, 1, 1, 2]) == 1
    # c d before b c before a b: a byte after "abc" decides whether a and b are joined
    assert byte_pairs.lookahead([(2, 3, 4), (1, 2, 5), (0, 1, 6)], [1, 1, 1, 1, 2, 2, 2]) == 3


def test_round_trip_of_odd_rows(spark, library):
    texts = [None, "", " \n\t ", "don't 've 'll", "a" * 70_000, "word " * 30_000, "one", "one", "x<|endoftext|>y", "ß é 日本"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, ids string")
    wanted = []
    for i, t in [*enumerate(texts), (None, "no id")]:
        ids = library.encode(t or "", add_special_tokens=False).ids
        wanted.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids, skip_special_tokens=False))))
    same(byte_pairs.round_trip(docs), wanted)
    assert byte_pairs.round_trip(docs.where("doc_id < 0")).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [None, 17250, 99_999_999, -5]), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in byte_pairs.decode(odd).collect()} == {1: "", 2: library.decode([17250]), 3: ""}
