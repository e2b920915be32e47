r"""Byte-pair encoding and decoding as streaming transducers with bounded lookahead.

``lookahead`` is computed from the merge list.  Compare two byte strings that agree up to some place, and merge
both, rule by rule in order.  They can first differ in a merge ``a b`` that reaches past that place, so its border
lies less than ``len(b)`` before it.  A border that differs later is that of a rule whose right part is consumed
by an earlier rule to the right in one of them (the chain goes on from there, ``len(b)`` further), or whose right
part was only formed in one of them (the chain goes on from the border inside ``b``).  The longest such chain
bounds how far a byte can act to its left, so a border that many bytes behind the newest one is final.
``Encoder`` therefore holds a bounded window: it merges the window, hands out the tokens that end before the last
``lookahead`` bytes, and keeps the rest, as merging goes on independently on both sides of a final border.

``Decoder`` turns tokens into bytes, and bytes into text by a state machine over the bytes of one character: what
isn't UTF-8 becomes U+FFFD, once for each longest well-formed beginning.

Texts are first parted into units as the vocabulary's pattern does: contractions, letters, numbers and other signs
with one blank before them, and white space.  Units are runs of one class of characters (the library that reads the
vocabulary tells each character's class), so the borders of a batch of texts are found by numpy passes over its
bytes.  Units met before are looked up in a table of bounded size; long units go through the transducer window by
window, and long texts are parted at places where a unit surely ends.  Memory beside a text and its tokens is
bounded, unless a text has megabytes of one class of characters.

Defined results: a null text is empty and has no tokens; a special token's name in a text is that token, as the
library has it; repeated rows each get their row; an empty table gives an empty table; ids that the vocabulary
doesn't have, or null, give no bytes; null ids give an empty text.
"""

from __future__ import annotations

import heapq
import json
from codecs import getincrementaldecoder
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import pre_tokenizers

from furrow.llm import textkit
from furrow.llm.session import prepared

VOCABULARY = "byte_bpe_50k.json"
#: Bytes of a unit that is looked up; longer ones stream through an ``Encoder``.
LONG_UNIT = 128
#: Bytes that a transducer holds beside its lookahead.
WINDOW = 1024
#: Bytes of text that are parted into units at once.
SEGMENT_BYTES = 1 << 18

_LETTER, _NUMBER, _OTHER, _BLANK, _UNKNOWN = range(5)


def _byte_of() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones are themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges by rank, special tokens, and how far a byte can act to its left."""

    @classmethod
    def of(cls, name: str) -> Vocabulary:
        return textkit.kept(f"bytes:{name}", lambda: cls(public_tokenizers.path(name)))

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            stored = json.load(f)
        byte_of = _byte_of()
        ids = stored["model"]["vocab"]
        self.special = {t["content"].encode(): t["id"] for t in stored["added_tokens"]}
        self.bytes: list[bytes] = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token
        pairs = [pair if isinstance(pair, list) else pair.split(" ") for pair in stored["model"]["merges"]]
        rules = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]
        self.rank = {(a, b): rank for rank, (a, b, _) in enumerate(rules)}
        self.made = [made for *_, made in rules]
        self.single = [ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        self.lookahead = lookahead(rules, [len(b) for b in self.bytes])
        self.pattern = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        sizes = np.array([len(b) for b in self.bytes], np.int64)
        self.pool, self.at = np.frombuffer(b"".join(self.bytes), np.uint8), np.concatenate([[0], np.cumsum(sizes)])
        self.classes = np.full(0x110000, _UNKNOWN, np.uint8)
        self.table = Units()

    def classified(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point, as the library's pattern has it: what a letter, number or sign is joined to."""
        out = self.classes[points]
        if (out == _UNKNOWN).any():
            for c in np.unique(points[out == _UNKNOWN]).tolist():
                joined = [len(self.pattern.pre_tokenize_str(x + chr(c))) == 1 for x in "a1!"]
                self.classes[c] = joined.index(True) if any(joined) else _BLANK
            out = self.classes[points]
        return out

    def merged(self, data: bytes) -> list[int]:
        """The tokens of a byte string: the pair of least rank is merged, the leftmost first, while there is one."""
        token: list[int] = [self.single[b] for b in data]
        return self._merged_short(token) if len(token) <= LONG_UNIT // 2 else self._merged_long(token)

    def _merged_short(self, token: list[int]) -> list[int]:
        """A search among all pairs each time, which few pairs make the faster way."""
        get, none = self.rank.get, len(self.made)
        ranks = [get(pair, none) for pair in zip(token, token[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            token[i] = self.made[best]
            del token[i + 1], ranks[i]
            if i:
                ranks[i - 1] = get((token[i - 1], token[i]), none)
            if i < len(ranks):
                ranks[i] = get((token[i], token[i + 1]), none)
        return token

    def _merged_long(self, token: list[int]) -> list[int]:
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.rank.get
        heap = [(rank, i, token[i], token[i + 1]) for i in range(n - 1) if (rank := get((token[i], token[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if token[i] != a or j >= n or token[j] != b:
                continue  # one of the two was merged meanwhile
            token[i], token[j] = self.made[rank], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := get((token[i], token[k]))) is not None:
                    heapq.heappush(heap, (rank, i, token[i], token[k]))
            h = before[i]
            if h >= 0 and (rank := get((token[h], token[i]))) is not None:
                heapq.heappush(heap, (rank, h, token[h], token[i]))
        return [t for t in token if t >= 0]


def lookahead(rules: list[tuple[int, int, int]], size: list[int]) -> int:
    """The most bytes that a byte can act to its left, from (left, right, made) of the merges in order.

    ``reach`` is the longest chain that ends in the rule that makes a token, ``left`` the length of that rule's left
    part, and ``blocked`` the longest chain of the earlier rules that consume a token as their left part.
    """
    reach: dict[int, int] = {}
    left: dict[int, int] = {}
    blocked: dict[int, int] = {}
    for a, b, made in rules:
        found = max(size[b] + blocked.get(b, 0), left.get(b, 0) + reach.get(b, 0))
        reach[made] = max(reach.get(made, 0), found)
        left[made] = max(left.get(made, 0), size[a])
        blocked[a] = max(blocked.get(a, 0), found)
    return max(reach.values(), default=0)


class Units:
    """Tokens of units by hash, one unit a slot: a new unit takes the slot, so memory is bounded."""

    SLOT_BITS, POOL = 20, 1 << 23

    def __init__(self) -> None:
        self.key = np.zeros(1 << self.SLOT_BITS, np.uint64)
        self.count = np.zeros(1 << self.SLOT_BITS, np.int64)
        self.at = np.zeros(1 << self.SLOT_BITS, np.int64)
        self.pool = np.zeros(1 << 16, np.int32)
        self.used = 0

    def store(self, ids: np.ndarray) -> int:
        at, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[at : self.used] = ids
        return at


class Encoder:
    """Bytes of one unit in, tokens out as soon as they are final; ``flush`` gives the rest."""

    def __init__(self, vocabulary: Vocabulary, window: int = WINDOW) -> None:
        self.vocabulary, self.held = vocabulary, b""
        self.most = vocabulary.lookahead + max(window, max(map(len, vocabulary.bytes)))

    def feed(self, data: bytes) -> list[int]:
        out: list[int] = []
        self.held += data
        while len(self.held) > self.most:
            window, end = self.held[: self.most], 0
            for token in self.vocabulary.merged(window):
                after = end + len(self.vocabulary.bytes[token])
                if after > len(window) - self.vocabulary.lookahead:
                    break
                out.append(token)
                end = after
            self.held = self.held[end:]
        return out

    def flush(self) -> list[int]:
        out, self.held = self.vocabulary.merged(self.held), b""
        return out


class Decoder:
    """Tokens in, text out as soon as its characters are whole; ``flush`` gives what a broken end becomes."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary, self.state = vocabulary, getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self.vocabulary.bytes))]
        at, pool = self.vocabulary.at, self.vocabulary.pool
        size = at[known + 1] - at[known]
        return self.state.decode(pool[np.repeat(at[known], size) + textkit._within(size)].tobytes() if len(known) else b"")

    def flush(self) -> str:
        return self.state.decode(b"", True)


def _classes(vocabulary: Vocabulary, data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte is of."""
    out = vocabulary.classified(np.arange(128))[data & 0x7F]
    head = np.flatnonzero(data >= 0xC0)
    if len(head):
        byte = lambda i: data[np.minimum(head + i, len(data) - 1)].astype(np.int64)
        size = 2 + (byte(0) >= 0xE0) + (byte(0) >= 0xF0)
        point = byte(0) & (0x7F >> size)
        for i in (1, 2, 3):
            point = np.where(i < size, point << 6 | byte(i) & 0x3F, point)
        kind = vocabulary.classified(np.minimum(point, 0x10FFFF))
        for i in range(4):
            more = (i < size) & (head + i < len(data))
            out[head[more] + i] = kind[more]
    return out


def units(vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all units, and the index of each text's first unit (with the total at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    kind = _classes(vocabulary, data)
    text = np.zeros(n, bool)
    text[off[:-1][off[1:] > off[:-1]]] = True
    run = text.copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    # the last blank of a run before another class goes with what follows, or alone if it isn't a plain blank
    after = np.flatnonzero(run[1:] & ~text[1:] & (kind[:-1] == _BLANK)) + 1
    last = after - 1
    for _ in range(3):
        last = last - ((data[last] & 0xC0) == 0x80)
    start[last] = True
    start[after[data[last] == 0x20]] = False
    # contractions: an apostrophe that begins a unit, and the letters after it
    q = np.flatnonzero((data[:-1] == 0x27) & start[:-1] & run[1:] & ~text[1:])
    here = data[q + 1]
    more = np.where((q + 2 < n) & ~text[np.minimum(q + 2, n - 1)], data[np.minimum(q + 2, n - 1)], 0)
    one = np.isin(here, np.frombuffer(b"stmd", np.uint8))
    two = np.isin(here, np.frombuffer(b"rv", np.uint8)) & (more == ord("e")) | (here == ord("l")) & (more == ord("l"))
    start[q[one | two] + 1] = False
    end = np.concatenate([q[one] + 2, q[two] + 3])
    start[end[end < n]] = True
    starts = np.flatnonzero(start)
    return starts, np.append(starts[1:], n), np.searchsorted(starts, off)


def _parts(vocabulary: Vocabulary, data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Parts of a long text that units don't cross: each ends between two classes, where a unit surely ends."""
    lo, size = 0, SEGMENT_BYTES
    while len(data) - lo > size:
        hi = lo + size
        while hi < len(data) and data[hi] & 0xC0 == 0x80:
            hi += 1
        kind = _classes(vocabulary, data[lo:hi])
        left, right = kind[:-1], kind[1:]
        sure = np.flatnonzero((left != right) & (left != _BLANK) & ~((left == _OTHER) & (right == _LETTER)))
        if len(sure):
            yield lo, lo + int(sure[-1]) + 1
            lo, size = lo + int(sure[-1]) + 1, SEGMENT_BYTES
        else:
            size *= 2
    yield lo, len(data)


def _looked_up(vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, one after another, and where each text's begin."""
    starts, ends, first = units(vocabulary, data, off)
    if not len(starts):
        return np.zeros(0, np.int32), first
    if vocabulary.table.used > Units.POOL:
        vocabulary.table = Units()
    table = vocabulary.table
    hashes = np.maximum(textkit.word_hashes(data, starts, ends, fold=False), np.uint64(1))
    slot = (hashes >> np.uint64(64 - Units.SLOT_BITS)).astype(np.int64)
    count, at = table.count[slot], table.at[slot]
    new = np.flatnonzero(table.key[slot] != hashes)
    if len(new):
        _, head, back = np.unique(hashes[new], return_index=True, return_inverse=True)
        head = new[head]
        found = [_unit(vocabulary, data[a:b]) for a, b in zip(starts[head].tolist(), ends[head].tolist(), strict=True)]
        n = np.array([len(x) for x in found], np.int64)
        begin = table.store(np.array([t for x in found for t in x], np.int32)) + np.cumsum(n) - n
        short = ends[head] - starts[head] <= LONG_UNIT
        table.key[slot[head[short]]], table.count[slot[head[short]]], table.at[slot[head[short]]] = hashes[head[short]], n[short], begin[short]
        count[new], at[new] = n[back], begin[back]
    ids = table.pool[np.repeat(at, count) + textkit._within(count)]
    return ids, np.concatenate([[0], np.cumsum(count)])[first]


def _unit(vocabulary: Vocabulary, data: np.ndarray) -> list[int]:
    if len(data) <= LONG_UNIT:
        return vocabulary.merged(data.tobytes())
    encoder, out = Encoder(vocabulary), []
    for lo in range(0, len(data), WINDOW):
        out += encoder.feed(data[lo : lo + WINDOW].tobytes())
    return out + encoder.flush()


def _special_parts(vocabulary: Vocabulary, raw: bytes) -> Iterator[tuple[int, int, int | None]]:
    """(start, end, None) of plain parts of a text and (start, end, id) of special tokens' names, the leftmost and longest first."""
    lo = 0
    while True:
        found = [(at, -len(name), name) for name in vocabulary.special if (at := raw.find(name, lo)) >= 0]
        if not found:
            break
        at, _, name = min(found)
        yield lo, at, None
        lo = at + len(name)
        yield at, lo, vocabulary.special[name]
    yield lo, len(raw), None


def tokens(vocabulary: Vocabulary, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts, one after another, and where each text's begin (with the total at the end)."""
    raw = data.tobytes()
    if len(data) <= 2 * SEGMENT_BYTES and not any(name in raw for name in vocabulary.special):
        return _looked_up(vocabulary, data, off)
    segments, first = [], [0]
    for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
        for lo, hi, special in _special_parts(vocabulary, raw[a:b]):
            inner = _parts(vocabulary, data[a + lo : a + hi]) if special is None else [(0, hi - lo)]
            segments += [(a + lo + x, a + lo + y, special) for x, y in inner]
        first.append(len(segments))
    out, count = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    done = 0
    while done < len(segments):
        end = done + 1
        while end < len(segments) and segments[end][1] - segments[done][0] <= SEGMENT_BYTES:
            end += 1
        group = segments[done:end]
        lo = group[0][0]
        ids, begin = _looked_up(vocabulary, data[lo : group[-1][1]], np.array([x - lo for x, *_ in group] + [group[-1][1] - lo]))
        kept, size = np.ones(len(ids), bool), np.diff(begin)
        for i, (*_, special) in enumerate(group):
            if special is not None:  # its name was read as plain text
                ids[begin[i]], size[i] = special, 1
                kept[begin[i] + 1 : begin[i + 1]] = False
        out.append(ids[kept])
        count.append(size)
        done = end
    return np.concatenate(out), np.cumsum(np.concatenate(count))[np.array(first)]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids) of every row: the tokens of its whole text, without any added by the vocabulary's own template."""
    prepared(docs.sparkSession)
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.of(vocabulary)
        for b in batches:
            for lo, hi, data, off in textkit.slices(b.column(1)):
                ids, first = tokens(known, data, off)
                yield pa.record_batch([b.column(0)[lo:hi], pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(coded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of every row: the text of its tokens, special ones by their names."""
    prepared(coded.sparkSession)
    schema = T.StructType([T.StructField("doc_id", coded.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.of(vocabulary)
        for b in batches:
            texts = [_text(known, ids) for ids in _rows(b.column(1))]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return coded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def _rows(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row; a null is -1, a null row is empty."""
    for row in column:
        yield row.values.fill_null(-1).to_numpy(zero_copy_only=False) if row.is_valid else np.zeros(0, np.int32)


def _text(vocabulary: Vocabulary, ids: np.ndarray, at_once: int = SEGMENT_BYTES) -> str:
    decoder = Decoder(vocabulary)
    return "".join([*(decoder.feed(ids[lo : lo + at_once]) for lo in range(0, len(ids), at_once)), decoder.flush()])


def _joined(ids: str) -> Column:
    return F.array_join(F.col(ids).cast("array<string>"), ",")


def round_trip(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: it is encoded, and its tokens are decoded."""
    digest = F.struct("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(_joined("ids"), 256).alias("ids_sha256"))
    back = decode(encode(docs).select(digest.alias("doc_id"), "ids"))
    return back.select("doc_id.*", F.sha2("text", 256).alias("decoded_sha256"))
