"""Near-duplicate links by banded MinHash signatures, confirmed on full shingle sets, and their components.

Documents with equal shingle sets are one node.  A node's signature is cut into bands; nodes that agree in a
band share a bucket.  Candidates meet in groups of bounded size, so no task ever holds a whole bucket:

* A bucket of up to ``BLOCK`` nodes is one group, in which every pair counts.
* A larger bucket is dealt into blocks, and its pivot (another one in each band) meets each block.  In a bucket of
  near copies this links almost all nodes, with as many rows as it has nodes.
* Then only those pairs of a large bucket can matter that are in different components so far.  The nodes outside
  the bucket's largest component meet it, and one another, block by block; a bucket that is one component is done.

Within a group, signatures first tell which nodes have a likely partner (each pair counts only in the first band
it agrees in); these nodes' full sets then confirm links exactly.  A pair that is already connected inside its
group isn't confirmed again, as only components are asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from furrow.llm import textkit
from furrow.llm.session import few, files_for, joined_by_size, parallelism, prepared, settled

#: Nodes of a bucket in one block; a group has at most two blocks.
BLOCK = 256
#: Pairs whose signatures are compared at once.
_PAIRS = 1 << 13
_MEMBER = ["bucket", "bi", "bj", "left", "pivot", "band", "h1", "h2"]


@dataclass(frozen=True)
class Signature:
    """``min``: each permutation's minimum; ``minmax``: its minimum and its maximum, so half the permutations do."""

    kind: str
    permutations: int
    rows: int
    seed: int = 20

    @property
    def values(self) -> int:
        return self.permutations * (2 if self.kind == "minmax" else 1)

    @property
    def bands(self) -> int:
        return self.values // self.rows

    def of(self, runs: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A row of 16-bit values for each text, all of which have shingles."""
        rng = np.random.default_rng(self.seed)
        a = rng.integers(0, 1 << 63, self.permutations, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, self.permutations, dtype=np.uint64)
        out = np.empty((len(first) - 1, self.values), np.uint16)
        for i in range(self.permutations):
            x = runs * a[i] + b[i]
            if self.kind == "minmax":
                out[:, 2 * i] = np.minimum.reduceat(x, first[:-1]).astype(np.uint16)
                out[:, 2 * i + 1] = np.maximum.reduceat(x, first[:-1]).astype(np.uint16)
            else:
                out[:, i] = np.minimum.reduceat(x, first[:-1]).astype(np.uint16)
        return out

    def least_equal(self, threshold: float) -> int:
        """Equal values below which a pair isn't confirmed: six standard deviations under the expected number."""
        return int(self.values * threshold - 6 * (self.values * threshold * (1 - threshold)) ** 0.5)


def _sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = textkit.words(data, off)
    return textkit.distinct(*textkit.windows(textkit.word_hashes(data, starts, ends), first, k))


def _names(runs: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each nonempty set, whatever its order."""
    at = first[:-1]
    return tuple(np.add.reduceat(textkit.mix(runs ^ np.uint64(salt)), at).view(np.int64) for salt in (0x5BF0, 0xA3C59AC2E8D1))


def signatures(docs: DataFrame, id_col: str, text_col: str, k: int, signature: Signature, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, sig, the kept columns) of every row; h1, h2 and sig are null where a text has no words."""
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        for b in batches:
            for lo, hi, data, off in textkit.slices(b.column(1)):
                runs, first = _sets(data, off, k)
                n = np.diff(first)
                full = n > 0
                at = first[np.append(np.flatnonzero(full), len(n))]
                h = np.zeros((2, hi - lo), np.int64)
                sig = np.array([None] * (hi - lo), object)
                if full.any():
                    h[0, full], h[1, full] = _names(runs, at)
                    sig[full] = [r.tobytes() for r in signature.of(runs, at)]
                yield pa.record_batch([b.column(0)[lo:hi], pa.array(n, pa.int64()), pa.array(h[0], pa.int64(), mask=~full), pa.array(h[1], pa.int64(), mask=~full), pa.array(sig, pa.binary()), *[c[lo:hi] for c in b.columns[2:]]], schema.names)

    names = ["doc_id", "n_shingles", "h1", "h2", "sig"]
    fields = [T.StructField(n, t) for n, t in zip(names, [kind, T.LongType(), T.LongType(), T.LongType(), T.BinaryType()], strict=True)]
    schema = T.StructType([*fields, *[docs.schema[c] for c in keep]])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *keep).mapInArrow(run, schema)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = column.buffers()
    lo = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.uint16, len(column) * width, int(lo)).reshape(len(column), width)


def _pairs(edges: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows to compare: all pairs of a group of left rows, or each left row with each right row."""
    sizes = np.diff(edges)
    two = edges[:-1][sizes == 2]
    firsts, seconds = [two], [two + 1]
    for lo, hi in zip(edges[:-1][sizes > 2], edges[1:][sizes > 2], strict=True):
        side = left[lo:hi]
        if side.all():
            i, j = np.triu_indices(hi - lo, 1)
        else:
            i, j = (x.ravel() for x in np.meshgrid(np.flatnonzero(side), np.flatnonzero(~side), indexing="ij"))
        firsts.append(i + lo)
        seconds.append(j + lo)
    i, j = np.concatenate(firsts), np.concatenate(seconds)
    return i, j


def _likely(table: pa.Table, edges: np.ndarray, signature: Signature, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the groups' pairs, those with enough equal values that agree in no band before this one, and their equal values.

    Pairs with a pivot count in any band, as the bucket of the first may have another pivot.
    """
    sig, band = _matrix(table.column("sig"), signature.values), table.column("band").to_numpy()
    pivot = table.column("pivot").to_numpy()
    i, j = _pairs(edges, table.column("left").to_numpy())
    out = []
    for at in range(0, len(i), _PAIRS):
        a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
        same = sig[a] == sig[b]
        enough = same.sum(1)
        ok = np.flatnonzero(enough >= least)
        agree = same[ok, : signature.bands * signature.rows].reshape(len(ok), signature.bands, signature.rows).all(2)
        ok = ok[pivot[a[ok]] | (agree.argmax(1) == band[a[ok]])]
        out.append((a[ok], b[ok], enough[ok]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (i, j, i)


def _groups(batches: Iterator[pa.RecordBatch], keys: int, most_rows: int = 4096) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows that are sorted by the first ``keys`` columns, several at a time, and their edges."""
    held: list[pa.RecordBatch] = []
    n = 0

    def cut(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows - 1, bool)
        for c in range(keys):
            x = table.column(c).to_numpy()
            change |= x[1:] != x[:-1]
        return np.concatenate([[0], np.flatnonzero(change) + 1])

    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < most_rows:
            continue
        table = pa.Table.from_batches(held)
        edges = cut(table)
        if edges[-1]:
            yield table.slice(0, int(edges[-1])), edges
            held = table.slice(int(edges[-1])).combine_chunks().to_batches()
            n = sum(x.num_rows for x in held)
    if held:
        table = pa.Table.from_batches(held)
        yield table, np.append(cut(table), table.num_rows)


def _grouped(rows: DataFrame) -> DataFrame:
    keys = ["bucket", "bi", "bj"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.select(*keys, *rest).repartition(parallelism(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def _candidates(signature: Signature, least: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        for table, edges in _groups(batches, 3):
            i, j, _ = _likely(table, edges, signature, least)
            hit = np.unique(np.concatenate([i, j]))
            if len(hit):
                yield from table.select(_MEMBER).take(pa.array(hit)).combine_chunks().to_batches()

    return run


def _confirm(signature: Signature, least: int, ratio: Fraction) -> Callable:
    num, den = ratio.numerator, ratio.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        for table, edges in _groups(batches, 3, 256):
            i, j, enough = _likely(table, edges, signature, least)
            group = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
            shingles = [np.frombuffer(x, np.uint64) for x in table.column("shingles").combine_chunks().to_pylist()]
            root = list(range(table.num_rows))

            def find(x: int, root: list[int] = root) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            linked = []
            for p in np.lexsort((-enough, group[i])) if len(i) else []:
                x, y = int(i[p]), int(j[p])
                if find(x) == find(y):
                    continue
                a, b = shingles[x], shingles[y]
                if den * min(len(a), len(b)) < num * max(len(a), len(b)):
                    continue
                both = np.intersect1d(a, b, assume_unique=True).size
                if den * both >= num * (len(a) + len(b) - both):
                    root[find(x)] = find(y)
                    linked.append((x, y))
            if linked:
                xy = np.array(linked)
                h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
                yield pa.record_batch([pa.array(h[xy[:, s]]) for s in (0, 1) for h in (h1, h2)], ["a1", "a2", "b1", "b2"])

    return run


def _shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        textkit.forget()
        for b in batches:
            for _, _, data, off in textkit.slices(b.column(0)):
                runs, first = _sets(data, off, k)
                first = first[np.append(np.flatnonzero(np.diff(first)), len(first) - 1)]
                if len(first) > 1:
                    h1, h2 = _names(runs, first)
                    yield pa.record_batch([pa.array(h1), pa.array(h2), pa.array([runs[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())], ["h1", "h2", "shingles"])

    return docs.select("text").mapInArrow(run, "h1 long, h2 long, shingles binary")


def _first_groups(keyed: DataFrame, others: DataFrame, large: DataFrame) -> DataFrame:
    """Members of small buckets, each bucket a group; of large ones, each block with the pivot."""
    whole = keyed.join(others, "bucket").select("bucket", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(True).alias("left"), F.lit(False).alias("pivot"), "band", "h1", "h2")
    members = keyed.join(large, "bucket").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = members.withColumn("pivot", F.xxhash64("h1", "h2", "band") == F.col("first"))
    own = F.pmod(F.xxhash64("h1", "h2", F.lit("block")), "blocks").cast("int")
    members = members.withColumn("bj", F.explode(F.when(F.col("pivot"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))))
    # in a large bucket, pairs count whatever band they agree in first
    dealt = members.select("bucket", F.lit(0).alias("bi"), "bj", F.col("pivot").alias("left"), F.lit(True).alias("pivot"), "band", "h1", "h2")
    return whole.unionByName(dealt).select(*_MEMBER)


def _other_groups(members: DataFrame, files: int) -> DataFrame:
    """Of large buckets' members with their component so far: the ones outside the largest meet it and one another."""
    parts = members.groupBy("bucket", "part").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("part", "n").alias("largest"), F.max("n").alias("most"), F.sum("n").alias("size"))
    open_ones = few(parts.where("most < size"), files)
    dealt = members.join(open_ones, "bucket").withColumn("few", F.col("part") != F.col("largest"))
    few_blocks, most_blocks = (F.ceil(n / BLOCK).cast("int") for n in (F.col("size") - F.col("most"), F.col("most")))
    own = F.pmod(F.xxhash64("h1", "h2", F.lit("other")), F.when(F.col("few"), few_blocks).otherwise(most_blocks)).cast("int")
    group = lambda bi, bj, left: F.struct(bi.alias("bi"), bj.alias("bj"), left.alias("left"))
    to_most = F.transform(F.sequence(F.lit(0), most_blocks - 1), lambda k: group(F.col("own"), k, F.lit(True)))
    to_few = F.transform(F.sequence(F.lit(0), few_blocks - 1), lambda k: group(F.least("own", k), -1 - F.greatest("own", k), F.col("own") <= k))
    of_most = F.transform(F.sequence(F.lit(0), few_blocks - 1), lambda k: group(k, F.col("own"), F.lit(False)))
    dealt = dealt.withColumn("own", own).withColumn("g", F.explode(F.when(F.col("few"), F.concat(to_most, to_few)).otherwise(of_most)))
    return dealt.select("bucket", "g.bi", "g.bj", "g.left", F.lit(False).alias("pivot"), "band", "h1", "h2").select(*_MEMBER)


def _linked(members: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, threshold: float, signature: Signature, known: DataFrame | None = None) -> DataFrame:
    """(node, root) of what the confirmed links of the groups connect, together with ``known`` links (u, v).

    Tables are settled in as many files as the number of nodes is worth; no fewer tasks work on a large one.
    """
    files = files_for(nodes.count())
    least, ratio = signature.least_equal(threshold), Fraction(threshold).limit_denominator(1000)
    members = settled(members.coalesce(files))
    nodes = settled(nodes.join(few(members.select("h1", "h2").distinct(), files), ["h1", "h2"], "left_semi").coalesce(files))
    sigs = nodes.select("h1", "h2", "sig")
    likely = _grouped(members.join(sigs, ["h1", "h2"])).mapInArrow(_candidates(signature, least), "bucket long, bi int, bj int, left boolean, pivot boolean, band int, h1 long, h2 long")
    likely = settled(likely.coalesce(files))
    chosen = likely.select("h1", "h2").distinct()
    wanted = few(nodes.join(chosen, ["h1", "h2"], "left_semi").select(F.col("min_id").alias("wanted_id")).distinct(), files)
    texts = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("wanted_id")), "left_semi")
    full = _shingle_sets(texts, k).join(chosen, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("shingles").alias("shingles"))
    rows = likely.join(sigs, ["h1", "h2"]).join(full, ["h1", "h2"])
    found = _grouped(rows).mapInArrow(_confirm(signature, least, ratio), "a1 long, a2 long, b1 long, b2 long")
    links = found.select(_name("a1", "a2").alias("u"), _name("b1", "b2").alias("v"))
    return connected(links if known is None else links.unionByName(known), files)


def _name(a: str, b: str) -> F.Column:
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def roots(docs: DataFrame, nodes: DataFrame, k: int, threshold: float, signature: Signature) -> DataFrame:
    """(node, root) of all nodes that have links; docs: (doc_id, text)."""
    width = 2 * signature.rows
    pieces = F.array(*[F.substring("sig", 1 + b * width, width) for b in range(signature.bands)])
    keyed = nodes.select("h1", "h2", F.posexplode(pieces).alias("band", "piece")).select("h1", "h2", "band", F.xxhash64("band", "piece").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min(F.xxhash64("h1", "h2", "band")).alias("first"))
    files = files_for(nodes.count())
    large = few(sizes.where(F.col("size") > BLOCK), files)
    others = sizes.where(F.col("size").between(2, BLOCK)).select("bucket")
    found = _linked(_first_groups(keyed, others, large), docs, nodes, k, threshold, signature)
    if large.isEmpty():
        return found
    members = keyed.join(large.select("bucket"), "bucket").withColumn("node", _name("h1", "h2")).join(found, "node", "left").select("bucket", "band", "h1", "h2", F.xxhash64(F.coalesce("root", "node")).alias("part"))
    return _linked(_other_groups(members, files), docs, nodes, k, threshold, signature, found.select(F.col("node").alias("u"), F.col("root").alias("v")))


def connected(edges: DataFrame, files: int) -> DataFrame:
    """(node, root): the least node of each edge's component, by rounds of large-star and small-star over columns u, v.

    The edges are first settled in ``files`` files.  Within a round every table that the next step names more than once is
    settled too: each join by size names its tables several times, so a plan of a whole round would repeat them dozens
    of times, and the driver keeps such a plan, its metrics and its descriptions.
    """
    edges = settled(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().coalesce(files))
    total = edges.count()
    files = files_for(total)  # the rounds' edges are no more
    of_each = (F.min("v").alias("m"), F.count("*").alias("n"))
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settled(both.groupBy("u").agg(*of_each).select("u", F.least("u", "m").alias("m"), "n").coalesce(files))
        large = settled(joined_by_size(both.where("v > u"), least, ["u"], total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(files))
        least = settled(large.groupBy("u").agg(*of_each).coalesce(files))
        stars = joined_by_size(large, least, ["u"], total).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        edges = settled(stars.coalesce(files))
        state = tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _rooted(signed: DataFrame, texts: DataFrame, k: int, threshold: float, signature: Signature) -> DataFrame:
    """(h1, h2, min_id, n, root) of every node, which n rows have; a node without links is its own root."""
    nodes = settled(signed.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("min_id"), F.count("*").alias("n"), F.first("sig").alias("sig")))
    named = nodes.select("h1", "h2", "min_id", "n", _name("h1", "h2").alias("node")).join(roots(texts, nodes, k, threshold, signature), "node", "left")
    return named.withColumn("root", F.coalesce("root", "node"))


def components(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, signature: Signature) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    ``component_id`` is the least doc_id that links reach, its own included.  A text without words is linked
    with nothing; a null doc_id counts only where a whole component has no other.  Giant components and texts with
    very many copies meet their rows by broadcast.
    """
    signed = settled(signatures(docs, id_col, text_col, k, signature))
    named = settled(_rooted(signed, docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), k, threshold, signature))
    sizes = named.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    least = named.groupBy("root").agg(F.min("min_id").alias("component_id"), F.count("*").alias("n"))
    named = joined_by_size(named, least, ["root"], sizes["nodes"]).select("h1", "h2", "component_id", "n")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    rows = signed.where("n_shingles > 0").select("h1", "h2", "doc_id", "n_shingles")
    return joined_by_size(rows, named, ["h1", "h2"], sizes["rows"]).select("doc_id", "n_shingles", "component_id").unionByName(empty)


def text_key(text: F.Column) -> F.Column:
    """128 bits that tell texts apart; a null text counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def firsts(docs: DataFrame, id_col: str, text_col: str, k: int, threshold: float, signature: Signature) -> DataFrame:
    """(first_id, first_key, copies): of each component the least doc_id, nulls last, with the least key of its texts.

    ``copies`` rows have both.  Texts without words are linked with nothing, so each doc_id and text is there.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), text_key(F.col(text_col)).alias("key"))
    signed = settled(signatures(texts, "doc_id", "text", k, signature, ("key",)))
    named = _rooted(signed, texts.drop("key"), k, threshold, signature)
    rows = signed.groupBy("h1", "h2", "doc_id", "key").agg(F.count("*").alias("copies"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("first_id"), F.col("key").alias("first_key"), "copies")
    of_node = rows.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(F.min(order).alias("first"))
    full = of_node.join(named.select("h1", "h2", "root"), ["h1", "h2"]).groupBy("root").agg(F.min("first").alias("first"))
    empty = rows.where("h1 IS NULL").select(order.alias("first"))
    return full.select("first").unionByName(empty).select("first.first_id", "first.first_key", "first.copies")
