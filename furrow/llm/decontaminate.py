"""Benchmark decontamination with suffix arrays over the documents.

Documents go by in shards of a few MB.  A shard's words become numbers of the benchmark's vocabulary (0: not
in it), and its suffix array holds, in sorted order, every suffix that can match at all: those that begin
with as many vocabulary words as the shortest window has.  Suffixes are ordered by their first ten words;
every benchmark suffix is found by binary search in each shard, which gives the range of all its occurrences.  A
document lies in one shard, so nothing is shuffled.

How far a match goes on is told by the benchmark's own suffix array, which is in full order: the longest match of a
place is with one of its two neighbours there.  Suffixes are compared by names, numbers for runs of 1, 2, 4, ... words
that are equal only for equal runs, so a comparison takes as many steps as the length has bits, and a text that repeats
itself, or a line that thousands of items share, takes no more time than others.

The benchmark comes to the tasks in blocks of at most ``BLOCK_BYTES`` of text; with several blocks the
documents pass one after another of them.

Words: A-Z are lower-cased, then ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.  A window is ten consecutive words of
an item, or all words of an item that has fewer.  Defined results: null texts have no words; an item without
words occurs nowhere; an item without an item_id marks words but isn't listed; items that share an item_id
are one item; repeated documents each get their row; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import textkit
from furrow.llm.session import prepared, settled

WINDOW_WORDS = 10
#: Text of the benchmark in one broadcast.
BLOCK_BYTES = 8 << 20
#: Text of the documents in one suffix array.
SHARD_BYTES = 4 << 20
#: Places of windows that are told apart by item at once.
_PIECE = 1 << 17


@dataclass
class Block:
    """A part of the benchmark, ready for search."""

    item_ids: list[str | None]
    words: np.ndarray  # numbers from 1 in ``vocabulary``, item after item, a 0 after each
    item: np.ndarray  # of each word
    vocabulary: np.ndarray  # sorted word hashes
    sieve: np.ndarray  # whether any vocabulary hash has these low 16 bits
    keys: dict[int, np.ndarray]  # by window length: the sorted distinct windows
    at: dict[int, tuple[np.ndarray, np.ndarray]]  # by window length: first occurrence of each window in places, places
    least: int
    names: list[np.ndarray]  # by level k: the name of the 1 << k words from each place, 0 if a 0 is among them
    pairs: list[np.ndarray]  # by level k > 0: the sorted pairs of lower names, in the order of the names from 1
    order: np.ndarray  # places of words, by the suffixes that begin there

    @classmethod
    def of(cls, rows: list[tuple[str | None, str | None]], window: int) -> Block:
        data, off = textkit.encode([t or "" for _, t in rows])
        starts, ends, first = textkit.words(data, off, textkit.NOT_ALNUM)
        hashes = textkit.word_hashes(data, starts, ends)
        vocabulary, number = np.unique(hashes, return_inverse=True)
        n = np.diff(first)
        words = np.zeros(len(hashes) + len(rows), np.uint32)
        item = np.repeat(np.arange(len(rows)), n + 1)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(rows)), n)
        words[place] = number + 1
        sieve = np.zeros(1 << 16, bool)
        sieve[vocabulary & np.uint64(0xFFFF)] = True
        keys, at = {}, {}
        for length in np.unique(np.minimum(n[n > 0], window)).tolist():
            own = n >= window if length == window else n == length
            of_item = np.where(own, n - length + 1, 0)
            begin = np.repeat(first[:-1] + np.arange(len(rows)), of_item) + textkit._within(of_item)
            whole = _keys(words, begin, length)
            order = np.argsort(whole, kind="stable")
            keys[length], head = np.unique(whole[order], return_index=True)
            at[length] = (np.append(head, len(begin)), begin[order])
        names, pairs = _named(words)
        return cls([i for i, _ in rows], words, item, vocabulary, sieve, keys, at, min(keys, default=0), names, pairs, _ordered(words))


def _after(values: np.ndarray, step: int) -> np.ndarray:
    """The value ``step`` places on, 0 beyond the end."""
    out = np.zeros_like(values)
    out[: max(len(values) - step, 0)] = values[step:]
    return out


def _named(words: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Names of all runs of 1, 2, 4, ... words without a 0, while there are any."""
    names, pairs = [words.astype(np.int64)], [np.zeros(0, np.int64)]
    while True:
        low = names[-1]
        both = (low << 32) | _after(low, 1 << (len(names) - 1))
        known, number = np.unique(np.where((low > 0) & (both & 0xFFFFFFFF > 0), both, 0), return_inverse=True)
        if not len(known) or known[-1] == 0:
            return names, pairs
        names.append(number + (known[0] > 0))
        pairs.append(known[known > 0])


def _ordered(words: np.ndarray) -> np.ndarray:
    """Places of words in the order of their suffixes, each up to the next 0, by doubling the length compared."""
    rank, step = words.astype(np.int64), 1
    while len(rank):
        _, number = np.unique((rank << 32) | np.where(rank > 0, _after(rank, step), 0), return_inverse=True)
        number = np.where(words > 0, number + 1, 0)
        if number.max() == rank.max() and step > 1:
            break
        rank, step = number, 2 * step
    return np.argsort(rank, kind="stable")[np.count_nonzero(words == 0) :]


def _keys(words: np.ndarray, begin: np.ndarray, length: int) -> np.ndarray:
    """The next ``length`` words from each place as byte strings that sort as the words do."""
    padded = np.concatenate([words, np.zeros(length, words.dtype)])
    return np.ascontiguousarray(padded[begin[:, None] + np.arange(length)].astype(">u4")).view(f"S{4 * length}").ravel()


def _names_in(words: np.ndarray, block: Block) -> list[np.ndarray]:
    """The benchmark's names of the runs from each place of other words, 0 of runs that the benchmark doesn't have."""
    names = [words.astype(np.int64)]
    for k, known in enumerate(block.pairs[1:]):
        both = (names[-1] << 32) | _after(names[-1], 1 << k)
        at = np.minimum(np.searchsorted(known, both), len(known) - 1)
        names.append(np.where(known[at] == both, at + 1, 0))
    return names


def _common(names: list[np.ndarray], p: np.ndarray, block: Block, t: np.ndarray) -> np.ndarray:
    """How many words from places p of a text equal those from places t of the benchmark."""
    length = np.zeros(len(p), np.int64)
    for k in reversed(range(len(names))):
        x = names[k][p + length]
        length += ((x > 0) & (x == block.names[k][t + length])).astype(np.int64) << k
    return length


def _longest(words: np.ndarray, p: np.ndarray, block: Block) -> np.ndarray:
    """The length of the longest run from each place p of a text that the benchmark has anywhere: binary search.

    Only the runs of known words that hold these places are looked at.
    """
    run = np.cumsum(words == 0)
    asked = np.zeros(int(run[-1]) + 1, bool)
    asked[run[p]] = True
    kept = asked[run]
    words, p = np.append(words[kept], 0), (np.cumsum(kept) - 1)[p]
    names = _names_in(words, block)
    low, high = np.zeros(len(p), np.int64), np.full(len(p), len(block.order))
    best = np.zeros(len(p), np.int64)
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) // 2
        t = block.order[middle]
        n = _common(names, p[open_], block, t)
        best[open_] = np.maximum(best[open_], n)
        less = block.words[t + n] < words[p[open_] + n]
        low[open_], high[open_] = np.where(less, middle + 1, low[open_]), np.where(less, high[open_], middle)
    return best


def _search(data: np.ndarray, off: np.ndarray, block: Block, window: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, set, int]]]:
    """Words of each text; for texts with hits: (row, hit flags of its words, items, longest match)."""
    starts, ends, first = textkit.words(data, off, textkit.NOT_ALNUM)
    n_words = np.diff(first)
    if not len(starts) or not block.least:
        return n_words, []
    # where each text's words are followed by a 0
    place = np.arange(len(starts)) + np.repeat(np.arange(len(n_words)), n_words)
    words = np.zeros(len(starts) + len(n_words) + 1, np.uint32)
    hashes = textkit.word_hashes(data, starts, ends)
    maybe = np.flatnonzero(block.sieve[hashes & np.uint64(0xFFFF)])
    found = np.minimum(np.searchsorted(block.vocabulary, hashes[maybe]), len(block.vocabulary) - 1)
    ok = block.vocabulary[found] == hashes[maybe]
    words[place[maybe[ok]]] = found[ok] + 1
    known = np.concatenate([[0], np.cumsum(words > 0)])
    m = block.least
    suffixes = np.flatnonzero(known[m:] - known[:-m] == m)
    if not len(suffixes):
        return n_words, []
    keys = _keys(words, suffixes, window)
    order = np.argsort(keys, kind="stable")
    keys, suffixes = keys[order], suffixes[order]
    text_first = first + np.arange(len(first))
    hit = np.zeros(len(words) + 1, np.int32)
    per_text: dict[int, set] = {}
    best = np.zeros(len(n_words), np.int64)
    for length, queries in block.keys.items():
        low = np.searchsorted(keys, queries, "left")
        high = np.searchsorted(keys, _last(queries, length, window), "right")
        some = np.flatnonzero(high > low)
        counts = (high - low)[some]
        p = suffixes[np.repeat(low[some], counts) + textkit._within(counts)]
        q = np.repeat(some, counts)
        np.add.at(hit, p, 1)
        np.add.at(hit, p + length, -1)
        head, places = block.at[length]
        text = np.searchsorted(text_first, p, "right") - 1
        for row, window_of in _expanded(np.unique(text * len(queries) + q), head, places, len(queries)):
            pairs = np.unique(row * len(block.item_ids) + block.item[window_of])
            for x in pairs.tolist():
                at, item = divmod(x, len(block.item_ids))
                per_text.setdefault(at, set()).add(block.item_ids[item])
        n = _longest(words, p, block) if length == window else np.full(len(p), length)
        np.maximum.at(best, text, n)
    covered = np.cumsum(hit) > 0
    return n_words, [(row, covered[text_first[row] : text_first[row] + n_words[row]], items - {None}, int(best[row])) for row, items in sorted(per_text.items())]


def _expanded(keys: np.ndarray, head: np.ndarray, places: np.ndarray, queries: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(quotient of the key, place of its window in the benchmark) for all places, piece by piece.

    A key's remainder is the number of its window.  A window that many items hold comes in several pieces.
    """
    row, window = np.divmod(keys, queries)
    ends = np.cumsum(head[window + 1] - head[window])
    for lo in range(0, int(ends[-1]) if len(ends) else 0, _PIECE):
        index = np.arange(lo, min(lo + _PIECE, int(ends[-1])))
        at = np.searchsorted(ends, index, "right")
        yield row[at], places[head[window[at] + 1] - (ends[at] - index)]


def _last(queries: np.ndarray, length: int, window: int) -> np.ndarray:
    """The greatest key that begins with each query."""
    if length == window:
        return queries
    raw = np.full((len(queries), 4 * window), 0xFF, np.uint8)
    raw[:, : 4 * length] = np.frombuffer(queries.astype(f"S{4 * length}").tobytes(), np.uint8).reshape(len(queries), -1)
    return raw.view(f"S{4 * window}").ravel()


def _shards(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    return textkit.slices(column, SHARD_BYTES)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> Iterator[Block]:
    rows, size = [], 0
    for r in benchmark.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        if rows and size + len(r["t"] or "") > BLOCK_BYTES:
            yield Block.of(rows, window)
            rows, size = [], 0
        rows.append((r["i"], r["t"]))
        size += len(r["t"] or "")
    yield Block.of(rows, window)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_hit, items, longest_match, spans) of every row.

    ``items`` are the sorted ids, as text, of items with occurring windows, ``longest_match`` is the length in
    words of the longest verbatim match with an item that holds one of its windows, ``spans`` are the runs of hit words as start and
    end (exclusive) after one another.
    """
    spark = prepared(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumns({"n_words": F.lit(0).cast("long"), "items": F.expr("cast(array() as array<string>)"), "longest_match": F.lit(0).cast("long"), "spans": F.expr("cast(array() as array<int>)")})
    schema = base.schema
    arrow = [pa.int64(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int32())]

    def step(shared) -> object:  # noqa: ANN001
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo, hi, data, off in _shards(b.column(1)):
                    n_words, found = _search(data, off, shared.value, window)
                    items, longest, spans = (b.column(i)[lo:hi].to_pylist() for i in (3, 4, 5))
                    for row, covered, ids, best in found:
                        if spans[row]:
                            covered = covered.copy()
                            for x, y in zip(spans[row][::2], spans[row][1::2], strict=True):
                                covered[x:y] = True
                        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                        items[row], longest[row], spans[row] = sorted({*items[row], *ids}), max(longest[row], best), edges.tolist()
                    yield pa.record_batch([b.column(0)[lo:hi], b.column(1)[lo:hi], *(pa.array(v, t) for v, t in zip((n_words, items, longest, spans), arrow, strict=True))], [f.name for f in schema])

        return run

    done = base
    for k, block in enumerate(_blocks(benchmark, item_col, item_text_col, window)):
        if k and k % 4 == 0:
            done = settled(done)
        done = done.mapInArrow(step(spark.sparkContext.broadcast(block)), schema)
    done = done.withColumn("n_hit", _hits("spans"))
    return done.select("doc_id", "n_words", "n_hit", "items", "longest_match", "spans")


def _hits(spans: str) -> F.Column:
    return F.aggregate(F.transform(F.col(spans), lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of ``contamination`` for each document."""
    found = contamination(docs, benchmark)
    places = F.transform(F.sequence(F.lit(0), (F.size("spans") / 2).cast("int") - 1), lambda i: F.concat_ws(":", F.get("spans", 2 * i), F.get("spans", 2 * i + 1)))
    spans = F.when(F.size("spans") > 0, F.array_join(places, ",")).otherwise("")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest_match",
        spans.alias("spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, with their columns, that hold no window of the benchmark."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return contamination(whole, benchmark, "row", "text").where("n_hit = 0").select("doc_id.*")
