"""A Merkle manifest of a table: a leaf for each row, a tree of fan-out 16 for each source, and one over the sources.

Ranks come from a radix trie instead of a sort.  The bits in which ids differ are cut into digits; rows are counted
by (source, all digits), these counts are added up to counts by shorter prefixes, and a running sum over the at most
``1 << DIGIT_BITS`` children of each prefix gives what lies before a child.  The sums along a row's path are its exact
rank in its source.  Rows that share an id are told apart by further digits, those of their leaf.

Trees are keyed by rank digits in base 16: all but the last digit name a node's parent.  Levels are reduced from the
longest prefix up, each by groups of at most 16 nodes; the paths then come down again, from root to the parents of
leaves, where each holds its leaves' siblings.  Proofs and folded roots follow inside the row, so long paths are
shuffled once for 16 documents.

``H`` is the lowercase hex SHA-256 of its inputs one after another.  A leaf's inputs are doc_id, source, lang, n_chars
and text: ``-`` if null, else the value's UTF-8 length in bytes, ``:`` and the value.

Defined results: null sources are one source, before all others, and differ from the empty one; null ids come before
all others; rows that share source and id come in the order of their leaves, so repeated rows have neighbouring places;
a proof without siblings is the digest of nothing; an empty table gives an empty table.  Ids must be whole numbers.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from furrow.llm.session import settled

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN_BITS = 4
#: Children of a prefix of digits: the rows of one window at most.
DIGIT_BITS = 13
#: Copies of one row that are told apart in one task.
COPIES = 1 << 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(values: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def is_tampered(doc_id: Column) -> Column:
    """Whether a tamperer meets the row: 5 divides its id's checksum."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(g, doc_id, leaf, tampered) of every row; g orders sources as their UTF-8 bytes do, null first.

    ``tampered`` is the leaf after a tamperer has lower-cased A-Z in the text of the rows that it meets.
    """
    doc_id, source, *_, text = [F.col(c) for c in fields]
    before = [F.col(c) for c in fields[:-1]]
    g = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
    lowered = F.when(is_tampered(doc_id), leaf_hash([*before, F.translate(text, _UPPER, _LOWER)]))
    hashed = docs.select(g.alias("g"), doc_id.cast("long").alias("doc_id"), leaf_hash([*before, text]).alias("leaf"), lowered.alias("lowered"))
    return hashed.select("g", "doc_id", "leaf", F.coalesce("lowered", "leaf").alias("tampered"))


def id_digits(rows: DataFrame, bits: int = DIGIT_BITS) -> list[Column]:
    """Digits of doc_id, most significant first, that order ids as numbers; leading ones that all ids share are left out."""
    ends = rows.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    if ends["low"] is None:
        return [F.lit(0)]
    differ = (ends["low"] ^ ends["high"]) & ((1 << 64) - 1)
    width = max(1, differ.bit_length())
    levels = -(-width // bits)
    each = -(-width // levels)
    flipped = F.col("doc_id").bitwiseXOR(F.lit(-1 << 63))
    digits = [F.shiftrightunsigned(flipped, each * k).bitwiseAND((1 << each) - 1) for k in reversed(range(levels))]
    return [F.coalesce(d, F.lit(-1)) for d in digits]


def ranked(counted: DataFrame, group: list[str], digits: list[str]) -> DataFrame:
    """``counted`` (group, digits and ``n`` rows, each combination once) with ``rank``, the group's rows before it, and the group's ``size``."""
    prefixes = [[*group, *digits[:k]] for k in range(len(digits) + 1)]
    sums = [counted]
    for k in range(len(digits) - 1, 0, -1):
        sums.append(sums[-1].groupBy(*prefixes[k]).agg(F.sum("n").alias("n")))
    above = None
    for k, level in enumerate(reversed(sums)):
        siblings = Window.partitionBy(*prefixes[k])
        before = siblings.orderBy(digits[k]).rowsBetween(Window.unboundedPreceding, -1)
        at = level.withColumn("rank", F.coalesce(F.sum("n").over(before), F.lit(0)))
        if above is None:
            at = at.withColumn("size", F.sum("n").over(siblings))
        else:
            at = at.join(above, prefixes[k]).withColumn("rank", F.col("rank") + F.col("above")).drop("above")
        above = at.select(*prefixes[k + 1], F.col("rank").alias("above"), "size")
    return at


def ranked_leaves(rows: DataFrame) -> DataFrame:
    """(g, doc_id, leaf, tampered, at, size) of every row of ``leaves``: its place in its source, from 0, and the source's size."""
    counted = settled(rows.groupBy("g", "doc_id", "leaf", "tampered").agg(F.count("*").alias("n")))
    digits = id_digits(counted)
    again = counted.groupBy("g", "doc_id").agg(F.count("*").alias("different")).where("different > 1").limit(1).count()
    if again:  # rows that share an id: their leaves' digits follow
        hexes = DIGIT_BITS // 4
        digits += [F.substring("leaf", 1 + i * hexes, hexes) for i in range(4)] + [F.substring("leaf", 1 + 4 * hexes, 64)]
    names = [f"d{i}" for i in range(len(digits))]
    placed = ranked(counted.select("*", *[d.alias(name) for d, name in zip(digits, names, strict=True)]), ["g"], names).drop(*names)
    blocks = placed.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(COPIES).cast("long"))))
    copy = F.explode(F.sequence("first", F.least(F.col("n"), F.col("first") + COPIES) - 1))
    each = blocks.select("g", "doc_id", "leaf", "tampered", "size", "rank", copy.alias("copy"))
    return each.select("g", "doc_id", "leaf", "tampered", "size", (F.col("rank") + F.col("copy")).alias("at"))


@dataclass(frozen=True)
class Tree:
    """Levels of nodes, each (group, at, digest) with the group's size ``size``; all but the first also hold children.

    Children are structs of digit and digest, and on the level above leaves whatever else was carried.
    """

    group: list[str]
    levels: list[DataFrame]

    @classmethod
    def over(cls, nodes: DataFrame, group: list[str], carried: list[str]) -> Tree:
        """``nodes``: (group, at, digest, size) and carried columns."""
        most = nodes.agg(F.max("size")).first()[0] or 0
        levels = [nodes]
        depth = 0
        while most > 1 << (FAN_BITS * depth):
            below = levels[-1].where(F.col("size") > 1 << (FAN_BITS * depth))
            child = F.struct(F.col("at").bitwiseAND((1 << FAN_BITS) - 1).alias("digit"), "digest", *carried)
            grouped = below.groupBy(*group, F.shiftright("at", FAN_BITS).alias("at")).agg(F.array_sort(F.collect_list(child)).alias("children"), F.first("size").alias("size"))
            digest = F.sha2(F.array_join(F.transform("children", lambda c: c["digest"]), ""), 256)
            levels.append(settled(grouped.withColumn("digest", digest)))
            depth, carried = depth + 1, []
        return cls(group, levels)

    def tops(self) -> DataFrame:
        """(group, digest) of every group's last node."""
        found = [level.where(_is_top(depth)).select(*self.group, "digest") for depth, level in enumerate(self.levels)]
        return reduce(DataFrame.unionByName, found)

    def paths(self, lowest: int, above: DataFrame | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
        """The nodes of the lowest level asked for, with ``path``: (children, at) of what stands above, the nearest first.

        ``above`` has the path of each group's top, and columns carried down; without it, a top's path is empty.
        """
        none = F.expr("cast(array() as array<struct<children: array<string>, at: int>>)")
        found: DataFrame | None = None
        for depth in reversed(range(lowest, len(self.levels))):
            level = self.levels[depth]
            here = level.where(_is_top(depth))
            here = here.withColumn("path", none) if above is None else here.join(above, self.group)
            if found is not None:
                digests = F.transform("children", lambda c: c["digest"])
                parents = found.select(*self.group, F.col("at").alias("parent"), digests.alias("digests"), F.col("path").alias("up"), *carried)
                inner = level.where(F.col("size") > 1 << (FAN_BITS * depth)).withColumn("parent", F.shiftright("at", FAN_BITS)).join(parents, [*self.group, "parent"])
                run = F.array(F.struct(F.col("digests").alias("children"), F.col("at").bitwiseAND((1 << FAN_BITS) - 1).cast("int").alias("at")))
                here = here.unionByName(inner.withColumn("path", F.concat(run, F.col("up"))).drop("digests", "up", "parent"))
            found = here
        return found


def _is_top(depth: int) -> Column:
    """Whether a node on this level is the last of its group."""
    size = F.col("size")
    fits = size <= 1 << (FAN_BITS * depth)
    return fits if depth == 0 else fits & (size > 1 << (FAN_BITS * (depth - 1)))


def proof(path: Column) -> Column:
    """All siblings along a path, one after another."""
    siblings = F.transform(path, lambda run: F.array_join(F.filter(run["children"], lambda c, i: i != run["at"]), ""))
    return F.array_join(siblings, "")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings along its path give."""

    def up(digest: Column, run: Column) -> Column:
        return F.sha2(F.array_join(F.transform(run["children"], lambda c, i: F.when(i == run["at"], digest).otherwise(c)), ""), 256)

    return F.aggregate(path, leaf, up)


def source_ranks(tops: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(g, digest, at, size): the sources in order.  Beyond ``most`` of them, digits of their bytes keep windows that small."""
    hexes, digits = F.hex("g"), []
    while True:
        widest = tops.groupBy(*[d.alias(f"d{i}") for i, d in enumerate(digits)]).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
        if widest <= most:
            break
        digits.append(F.substring(hexes, 1 + 4 * len(digits), 4))
    names = [f"d{i}" for i in range(len(digits) + 1)]
    counted = tops.select("*", F.lit(1).cast("long").alias("n"), *[d.alias(name) for d, name in zip([*digits, F.col("g")], names, strict=True)])
    return ranked(counted, [], names).select("g", "digest", F.col("rank").alias("at"), "size")


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``fields`` are the columns that a leaf hashes: the id first, the source second, the text last.
    """
    rows = settled(ranked_leaves(leaves(docs, fields)).withColumnRenamed("leaf", "digest"))
    carried, down = ("doc_id", "tampered"), ("subroot", "root")
    inner = Tree.over(rows, ["g"], list(carried))
    outer = Tree.over(settled(source_ranks(settled(inner.tops()))), [], ["g"])
    root = outer.tops().select(F.col("digest").alias("root")).scalar()
    above = settled(outer.paths(0).select("g", F.col("digest").alias("subroot"), "path").withColumn("root", root))
    found = rows.where("size = 1").join(above, "g").select(*carried, F.col("digest").alias("leaf"), "path", *down)
    if len(inner.levels) > 1:
        digests = F.transform("children", lambda c: c["digest"])
        parents = inner.paths(1, above, down).select("path", *down, digests.alias("digests"), F.posexplode("children").alias("place", "child"))
        run = F.array(F.struct(F.col("digests").alias("children"), F.col("place").alias("at")))
        found = found.unionByName(parents.select(*[F.col(f"child.{c}").alias(c) for c in carried], F.col("child.digest").alias("leaf"), F.concat(run, F.col("path")).alias("path"), *down))
    back = folded(F.col("tampered"), F.col("path"))
    out = found.select("doc_id", "leaf", "subroot", "root", F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
