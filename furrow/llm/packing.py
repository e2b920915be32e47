"""Best-fit packing of documents into token sequences, with certified bin counts.

Documents are tokenised in Arrow tasks; documents longer than a sequence are cut, and full pieces are sequences
of their own.  The other pieces are dealt to partitions of bounded size.  Each runs best-fit decreasing and
compares its number of bins with lower bounds from dual feasible functions over its lengths: equal means that
no packing of this partition has fewer.  Bins that a certified partition fills nearly are final; the pieces of
the rest, and of all unfilled bins of partitions with a gap, are exchanged between partitions and packed again,
in ever fewer partitions, until one is left or an exchange has saved less than ``LEAST_SAVING`` of its bins.

Defined results: a null text is empty and gives the end id alone; repeated rows are documents of their own; an
empty table gives no pieces.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from furrow.llm import textkit
from furrow.llm.session import prepared, settled

SEQUENCE_TOKENS = 4096
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Pieces that one task packs.
PIECES_PER_TASK = 20_000
#: Slack of a bin that a certified partition keeps as it is.
NEARLY_FULL = SEQUENCE_TOKENS // 64
#: Share of the exchanged bins that the next exchange must be able to hope for: one that saved less is the last.
LEAST_SAVING = 0.0005
#: Exchanges at most, as the turn is part of a sequence's number; each shrinks eightfold what is dealt, so far fewer happen.
MOST_TURNS = 31

_KIND = np.full(256, 3, np.uint8)  # 1: letter or digit, 2: punctuation that parts, 3: neither
_KIND[[i for i in range(128) if chr(i).isalnum()]] = 1
_KIND[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "'"]] = 2


def _units(data: np.ndarray, off: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words' spans, parted further between letters or digits and punctuation."""
    if not len(starts):
        return starts, ends, np.searchsorted(starts, off)
    kind = _KIND[data]
    # of a letter U+00C0 to U+00FF, the first byte begins and the second byte ends it
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    first = np.zeros(len(data), bool)
    first[:-1] = second[1:]
    letter_ends, letter_begins, mark = (kind == 1) | second, (kind == 1) | first, kind == 2
    border = np.flatnonzero((letter_ends[:-1] & mark[1:]) | (mark[:-1] & letter_begins[1:])) + 1
    inner = border[~np.isin(border, off)]  # a text's first byte is a start already
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    return starts, ends, np.searchsorted(starts, off)


class WordTokens:
    """Token ids of units that this vocabulary never joins; units met before are looked up.

    White space always parts tokens, and so does the border between an ASCII letter, digit or Latin-1 letter
    and ASCII punctuation other than an apostrophe.  A-Z are folded, as the vocabulary folds them.  Texts that
    may name a special token are only parted at white space, and not folded, as only the names in lower case are
    special.  The table keeps one unit a slot, so its memory is bounded, and a new unit takes the slot; a worker
    process keeps it from task to task.
    """

    SLOT_BITS = 21
    POOL = 1 << 23

    @classmethod
    def of(cls, path: str) -> WordTokens:
        return textkit.kept(path, lambda: cls(path))

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.id_type = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.reset()

    def reset(self) -> None:
        self.key = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self.count = np.zeros(1 << self.SLOT_BITS, np.int32)
        self.at = np.zeros(1 << self.SLOT_BITS, np.int32)
        self.pool = np.zeros(1 << 16, self.id_type)
        self.used = 0

    def _store(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), self.id_type)])
        self.pool[at : self.used] = ids
        return at

    def __call__(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and where each text's begin."""
        if self.used > self.POOL:
            self.reset()
        raw = data.tobytes()
        starts, ends, first = textkit.words(data, off)
        plain = b"<|" not in raw
        if plain:
            starts, ends, first = _units(data, off, starts, ends)
        hashes = textkit.word_hashes(data, starts, ends, fold=plain)
        slot = (hashes >> np.uint64(64 - self.SLOT_BITS)).astype(np.int64)
        count, at = self.count[slot].astype(np.int64), self.at[slot].astype(np.int64)
        new = np.flatnonzero(self.key[slot] != hashes)
        if len(new):
            _, head, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            head = new[head]
            units = [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[head].tolist(), ends[head].tolist(), strict=True)]
            ids = [c.ids for lo in range(0, len(units), 1000) for c in self.tokenizer.encode_batch_fast(units[lo : lo + 1000], add_special_tokens=False)]
            n = np.array([len(x) for x in ids], np.int64)
            begin = self._store(np.array([i for x in ids for i in x], self.id_type)) + np.cumsum(n) - n
            self.key[slot[head]], self.count[slot[head]], self.at[slot[head]] = hashes[head], n, begin
            count[new], at[new] = n[back], begin[back]
        ids = self.pool[np.repeat(at, count) + textkit._within(count)] if len(count) else self.pool[:0]
        return ids, np.concatenate([[0], np.cumsum(count)])[first]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, own): the pieces of every row; ``own`` numbers them, from 0 up."""
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "own"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens.of(public_tokenizers.path(vocabulary))
        own = TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, hi, data, off in textkit.slices(b.column(1)):
                ids, first = tokens(data, off)
                rows = []
                for i in range(hi - lo):
                    doc = np.append(ids[first[i] : first[i + 1]], END_ID).astype("<u4")
                    for piece, start in enumerate(range(0, len(doc), SEQUENCE_TOKENS)):
                        part = doc[start : start + SEQUENCE_TOKENS]
                        rows.append((lo + i, piece, start, len(part), zlib.crc32(part), own))
                        own += 1
                at, *rest = zip(*rows, strict=True)
                yield pa.record_batch([b.column(0).take(pa.array(at)), *(pa.array(x, t) for x, t in zip(rest, [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()], strict=True))], names)

    long = T.LongType()
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, [kind, T.IntegerType(), long, long, long, long], strict=True)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def least_bins(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> int:
    """The best of the lower bounds that dual feasible functions give for the number of bins.

    Two families: one counts items over ``capacity - e`` as whole bins and drops those under e, the other rounds
    ``(k + 1) * x / capacity`` down unless it is whole.
    """
    counts = np.bincount(lengths, minlength=capacity + 1)
    x = np.arange(capacity + 1)
    best = -(-int((counts * x).sum()) // capacity)
    whole = np.concatenate([np.cumsum(counts[::-1])[::-1], [0]])  # items of at least x
    weight = np.concatenate([np.cumsum((counts * x)[::-1])[::-1], [0]])
    e = np.arange(1, capacity // 2 + 1)
    large = whole[capacity - e + 1]
    middle = weight[e] - weight[capacity - e + 1]
    best = max(best, int((large - (-middle // capacity)).max()))
    for k in range(1, 33):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, k * x, capacity * (scaled // capacity))  # times k
        best = max(best, -(-int((counts * value).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin, offset) of each item and the fill of each bin."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by room left
    room = 0  # bit r: some bin has r left
    fill: list[int] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fitting = room >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                room ^= 1 << left
        else:
            b, left = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        left -= n
        if left:
            if not open_bins[left]:
                room |= 1 << left
            open_bins[left].append(b)
    return bins, offsets, np.array(fill, np.int64)


def _pack(turn: int, last: bool) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lengths = table.column("length").to_numpy()
        bins, offsets, fill = best_fit_decreasing(lengths)
        certified = len(fill) == least_bins(lengths)
        done = np.full(len(fill), last) | (SEQUENCE_TOKENS - fill <= (NEARLY_FULL if certified else 0))
        ids = bins + (TaskContext.get().partitionId() << 36) + (turn << 58)
        for name, values in (("sequence_id", ids), ("offset", offsets), ("done", done[bins])):
            table = table.append_column(name, pa.array(values))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, least_saving: float = LEAST_SAVING) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every row."""
    whole = settled(pieces(docs, id_col, text_col, vocabulary))
    columns = [c for c in whole.columns if c != "own"]
    full = F.col("length") == SEQUENCE_TOKENS
    out = whole.where(full).select(*columns, F.col("own").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = whole.where(~full)
    schema = T.StructType([*left.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("done", T.BooleanType())])
    begins = F.col("offset") == 0
    rows, turn, partitions, bins = left.count(), 1, None, None
    while rows:
        most = -(-rows // PIECES_PER_TASK)
        partitions = most if partitions is None else max(most, partitions // 8)
        dealt = left.coalesce(1) if partitions == 1 else left.repartition(partitions, F.xxhash64("own", F.lit(turn)))
        packed = settled(dealt.mapInArrow(_pack(turn, partitions == 1), schema))
        now = packed.agg(F.count_if(begins).alias("all"), F.count_if(begins & ~F.col("done")).alias("open"), F.count_if(~F.col("done")).alias("rows")).first()
        last = turn == MOST_TURNS or bins is not None and bins - now["all"] < max(1, least_saving * bins)
        out = out.unionByName(packed.where(F.lit(last) | F.col("done")).select(out.columns))
        left, rows, bins, turn = packed.where("NOT done").select(left.columns), 0 if last else now["rows"], now["open"], turn + 1
    return out
