"""Substring dedup with difference-cover anchors.

A passage of ``window`` words repeats if the same words start anywhere else, in the same document or another.
Hashing every window would shuffle a row for each word.  Instead, short anchors are hashed only at positions
that are in a difference cover modulo a period: for any two places there is a shift below the period that puts
both into the cover, so two equal windows always share an anchor at the same distance from their starts.
Anchors that repeat are extended: only windows that hold one are hashed in full and counted, which is exact.

Both counts take rows per (hash, place).  A task first finds repeats among its own rows; a run of such places in
one document becomes one row that is dealt evenly, and a single row speaks for each hash, so a passage in a third
of all documents puts no more rows on one key than there are batches.  Of exact copies, whose windows all repeat,
only one has its windows hashed.  Documents are shuffled once, for both joins.

Defined results: a null text has no words; a document shorter than the window loses nothing; rows with the same
doc_id and text are occurrences of their own; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import textkit
from furrow.llm.session import joined_by_size, parallelism, prepared, settled

WINDOW_WORDS = 35
#: Perfect difference sets: every difference modulo the period is that of two members.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16)}
#: Words that an anchor has at least, if the window allows it.
ANCHOR_WORDS = 12
#: Text whose repeats a task finds by itself.
SPAN_BYTES = 8 << 20
# code: bits 0-1 flags, 2-31 position, 32-47 check of the document, 48-63 more bits of the window's hash, or in a
# row of known repeats how far after the position their last one is
_KNOWN, _SPEAKS = 1, 2
_PLACE = (1 << 48) - 4


def cover_for(window: int) -> tuple[int, tuple[int, ...], int]:
    """(period, cover, anchor length) for a window."""
    period = max(p for p in COVERS if p == 1 or window - p + 1 >= ANCHOR_WORDS)
    return period, COVERS[period], window - period + 1


def _dealt(hashes: np.ndarray, key: np.ndarray, code: np.ndarray, forced: np.ndarray, step: int) -> pa.RecordBatch:
    """Rows (pkey, key, code): once by hash if alone here; else known repeats by their place, and one row by hash for all.

    Known repeats at most ``step`` apart in one document, with none between them that isn't known, are one row.
    ``forced`` ones are known to repeat elsewhere.
    """
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    later = np.concatenate([[False], same])[: len(h)]
    known = np.zeros(len(h), bool)
    known[order] = later | np.concatenate([same, [False]])[: len(h)]
    known |= forced
    sorted_known = known[order]
    # a hash speaks once if any of its places is known
    start = np.flatnonzero(~later)
    speaking = order[start[np.maximum.reduceat(sorted_known, start)]] if len(h) else order
    pos = (code >> 2) & ((1 << 30) - 1)
    at = np.flatnonzero(known)
    split = np.ones(len(at), bool)
    if len(at) > 1:
        gap = pos[at[1:]] - pos[at[:-1]]
        block = pos[at] >> 15  # so that a run's length fits into 16 bits
        split[1:] = (np.diff(at) != 1) | (key[at[1:]] != key[at[:-1]]) | (gap <= 0) | (gap > step) | (block[1:] != block[:-1])
    head = np.flatnonzero(split)
    span = pos[at[np.append(head[1:], len(at)) - 1]] - pos[at[head]] if len(at) else pos[:0]
    run_key, run_code = key[at[head]], (code[at[head]] & np.int64(_PLACE)) | (span << 48) | _KNOWN
    alone = ~known
    speaks = (code[speaking] & ~np.int64((1 << 48) - 1)) | _SPEAKS
    spread = textkit.mix(run_key.view(np.uint64) + textkit.mix(run_code.view(np.uint64)))
    return pa.record_batch(
        [
            pa.array(np.concatenate([hashes[alone], hashes[speaking], spread]).view(np.int64)),
            pa.array(np.concatenate([key[alone], np.zeros(len(speaks), np.int64), run_key])),
            pa.array(np.concatenate([code[alone], speaks, run_code])),
        ],
        ["pkey", "key", "code"],
    )


def _repeated(rows: DataFrame) -> DataFrame:
    """The (key, code) of places, or runs of places, whose hash another row has."""
    dealt = rows.repartition(parallelism(rows.sparkSession), "pkey").withColumn("tag", F.shiftright("code", 48))
    same = Window.partitionBy("pkey", "tag")
    counted = dealt.select("key", "code", F.count("*").over(same).alias("n"), F.max(F.col("code").bitwiseAND(_SPEAKS)).over(same).alias("spoken"))
    flag = lambda bit: F.col("code").bitwiseAND(bit) != 0
    found = counted.where(~flag(_SPEAKS) & (flag(_KNOWN) | (F.col("n") > 1) | (F.col("spoken") > 0)))
    return found.select("key", F.when(flag(_KNOWN), F.col("code").bitwiseAND(~_KNOWN)).otherwise(F.col("code").bitwiseAND(_PLACE)).alias("code"))


def _gathered(parts: list[tuple[np.ndarray, ...]], step: int) -> pa.RecordBatch:
    return _dealt(*(np.concatenate(x) for x in zip(*parts, strict=True)), step)


def _places(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last place of each run."""
    first = (codes >> 2) & ((1 << 30) - 1)
    return first, first + ((codes >> 48) & 0xFFFF)


def _anchors(window: int) -> object:
    period, cover, length = cover_for(window)
    residue = np.isin(np.arange(period), cover)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, hi, data, off in textkit.slices(b.column(1)):
                starts, ends, first = textkit.words(data, off)
                runs, at = textkit.windows(textkit.word_hashes(data, starts, ends, fold=False), first, length, short=False)
                n = np.diff(at)
                pos = textkit._within(n)
                take = residue[pos % period] & np.repeat(np.diff(first) >= window, n)
                parts.append((runs[take], np.repeat(keys[lo:hi], n)[take], pos[take] << 2, np.zeros(np.count_nonzero(take), bool)))
                size += len(data)
                if size >= SPAN_BYTES:
                    yield _gathered(parts, period)
                    parts, size = [], 0
        if parts:
            yield _gathered(parts, period)

    return run


def _windows(window: int) -> object:
    period, _, _ = cover_for(window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for b in batches:
            keys, checks = b.column(0).to_numpy(), b.column(1).to_numpy()
            positions, copied = b.column(3), b.column(4).to_numpy(zero_copy_only=False)
            for lo, hi, data, off in textkit.slices(b.column(2)):
                starts, ends, first = textkit.words(data, off)
                hashes = textkit.word_hashes(data, starts, ends, fold=False)
                runs, at = textkit.windows(hashes, first, window, short=False)
                anchor = positions[lo:hi]
                counts = np.diff(anchor.offsets.to_numpy())
                begin, end = _places(anchor.flatten().to_numpy())
                low = np.maximum(begin - period + 1, 0)
                n = np.diff(at)
                most = np.repeat(n, counts)  # starts of each position's text
                fits = low < most
                base = np.repeat(at[:-1], counts)
                edge = np.zeros(len(runs) + 1, np.int64)
                np.add.at(edge, (base + low)[fits], 1)
                np.add.at(edge, (base + np.minimum(end + 1, most))[fits], -1)
                take = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
                text = np.searchsorted(at, take, "right") - 1
                more = textkit.mix(hashes[first[text] + take - at[text]] ^ (runs[take] * np.uint64(0x9FB21C651E98DF25))) & np.uint64(0xFFFF)
                tail = textkit.mix(hashes[first[text] + take - at[text] + window - 1] + more * np.uint64(3)) & np.uint64(0xFFFF)
                code = ((take - at[text]) << 2) | (checks[lo:hi][text] << 32) | (tail.astype(np.int64) << 48)
                parts.append((runs[take], keys[lo:hi][text], code, copied[lo:hi][text]))
                size += len(data)
                if size >= SPAN_BYTES:
                    yield _gathered(parts, 1)
                    parts, size = [], 0
        if parts:
            yield _gathered(parts, 1)

    return run


def _kept(window: int, names: list[str]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            checks, copied = b.column(2).to_pylist(), b.column(4).to_pylist()
            n_words, n_removed, out = [], [], []
            for text, check, found, copy in zip(b.column(1), checks, b.column(3), copied, strict=True):
                w = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                n_words.append(len(w))
                if copy and len(w) >= window:
                    w = []
                elif found.is_valid:
                    code = found.values.to_numpy()
                    first, last = _places(code[((code >> 32) & 0xFFFF) == check])
                    edge = np.zeros(len(w) + 1, np.int64)
                    np.add.at(edge, first, 1)
                    np.add.at(edge, last + window, -1)
                    left = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                    w = [w[i] for i in left.tolist()] if len(left) < len(w) else w
                n_removed.append(n_words[-1] - len(w))
                out.append(b" ".join(w).decode("utf-8", "surrogatepass"))
            yield pa.record_batch([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(out, pa.string())], names)

    return run


def _copies(base: DataFrame) -> DataFrame:
    """(key, speaks) of the rows whose text another row has; ``speaks`` marks one row of each text."""
    texts = base.select("key", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(5), "text").alias("t2"))
    sizes = texts.groupBy("t1", "t2").agg(F.count("*").alias("n"), F.min("key").alias("first"))
    groups = settled(sizes.where("n > 1"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    return joined_by_size(texts, groups, ["t1", "t2"], total).select("key", (F.col("key") == F.col("first")).alias("speaks")).distinct()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row: its text without words of windows that repeat, joined by spaces."""
    spark = prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    base = base.withColumns({"key": F.xxhash64("doc_id", "text"), "check": F.pmod(F.xxhash64(F.lit(11), "text", "doc_id"), F.lit(1 << 16))})
    row = "pkey long, key long, code long"
    anchors = _repeated(base.select("key", "text").mapInArrow(_anchors(window), row))
    copies = settled(_copies(base))
    positions = anchors.groupBy("key").agg(F.collect_list("code").alias("positions")).join(copies, "key", "left")
    positions = settled(positions.where("speaks IS NULL OR speaks").select("key", "positions", F.col("speaks").isNotNull().alias("copied")))
    # both joins read the same columns of it, so the plan has one exchange of the documents
    dealt = base.repartition(parallelism(spark), "key")
    held = dealt.join(positions, "key").select("key", "check", "text", "positions", "copied", "doc_id")
    found = _repeated(held.mapInArrow(_windows(window), row)).groupBy("key").agg(F.collect_list("code").alias("found"))
    found = found.join(copies.select("key", F.lit(True).alias("copied")), "key", "full")
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return dealt.join(found, "key", "left").select("doc_id", "text", "check", "found", "copied").mapInArrow(_kept(window, schema.names), schema)


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
