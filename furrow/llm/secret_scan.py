r"""Secret scans through a trigram inverted index, with DataFrame functions alone.

From each rule's regular expression follows a Boolean query over lower-cased trigrams: a set of alternatives,
each the trigrams of its literal runs, all of which a matching text must hold.  The index has a posting (trigram,
document) for every trigram that some query names, where the document also holds the rarest trigram of that
alternative; postings are intersected by counting them for each document and alternative, and only documents that
fulfil an alternative are verified with the expression itself.  A rule without mandatory trigrams scans all
documents.

Texts are not shuffled: the candidates' keys come to the documents by broadcast, and the places of matches are sums
inside the row.  Beyond a million candidates only texts that hold the rarest trigram of some alternative are joined to
them, hot texts by broadcast; the others need no answer.  Each expression takes time in proportion to a text.

Spans are code points, end exclusive.  Matches are leftmost and do not overlap within a kind, and a match whose
checked group is too short is dropped after it was found.  Defined results: a null text is empty; repeated rows
each get their row; an empty table gives an empty table.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from furrow.llm import session
from furrow.llm.session import joined_by_size, settled


@dataclass(frozen=True)
class Rule:
    """``least`` characters in ``group`` make a match count; with ``own`` the group, which ends the match, is its span."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = False
    own: bool = False
    fast: str | None = None  # finds the same counted matches in fewer steps


# The three base rules, as the contract of the query gives them, then common credential formats.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, True, fast=r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
    # only where a run of its letters begins, as else a run of such beginnings would be read again from each
    Rule("jwt", r"(?:^|[^A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, own=True),
)
#: Classes of up to so many characters are spelled out as alternatives.
SPELL = 5
#: Letters that are in most words; a trigram with fewer of them is rarer.
_COMMON = frozenset("etaoinsrhldu")
#: Matches whose places are summed at once; longer lists of them are worked through block by block.
_MATCHES = 512


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives of trigrams, one of which every match holds in full; an empty alternative holds always."""
    states = _walk(parser.parse(pattern), [(frozenset(), "")])
    found = {grams | _grams(run) for grams, run in states}
    return sorted((q for q in found if not any(o < q for o in found)), key=sorted)


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i : i + 3] for i in range(len(run) - 2))


def _broken(states: list) -> list:
    return list({(grams | _grams(run), "") for grams, run in states})


def _walk(nodes, states: list) -> list:  # noqa: ANN001
    """Each state: the trigrams so far and the literal run that may go on."""
    for op, arg in nodes:
        if op is C.LITERAL:
            states = [(g, run + chr(arg).lower()) for g, run in states]
        elif op is C.IN and all(o is C.LITERAL for o, _ in arg) and len(arg) <= SPELL:
            states = list({(g, run + chr(a).lower()) for g, run in states for _, a in arg})
        elif op is C.SUBPATTERN:
            states = _walk(arg[3], states)
        elif op is C.BRANCH:
            states = [s for way in arg[1] for s in _walk(way, states)]
        elif op is C.MAX_REPEAT and arg[:2] == (0, 1) and len(arg[2]) == 1 and arg[2][0][0] is C.LITERAL:
            states = states + _walk(arg[2], states)
        else:
            states = _broken(states)
    return states


def _lead(grams: frozenset[str]) -> str:
    return min(grams, key=lambda g: (sum(c in _COMMON for c in g), g))


def _leads(queries: list[frozenset[str]]) -> dict[str, set[str]]:
    """By rarest trigram, the trigrams of the alternatives that it leads."""
    leads: dict[str, set[str]] = {}
    for q in queries:
        leads.setdefault(_lead(q), set()).update(q)
    return leads


def postings(docs: DataFrame, queries: list[frozenset[str]]) -> DataFrame:
    """(k1, k2, trigram): which documents hold which of the queries' trigrams, in either case."""
    lower = docs.select("k1", "k2", F.lower("text").alias("lower"))
    holds = lambda t: F.contains("lower", F.lit(t))
    leads = _leads(queries)
    held = [F.when(holds(lead), F.array_compact(F.array(F.lit(lead), *[F.when(holds(t), F.lit(t)) for t in sorted(grams - {lead})]))) for lead, grams in sorted(leads.items())]
    return lower.select("k1", "k2", F.explode(F.flatten(F.array_compact(F.array(*held)))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(k1, k2, kinds): documents whose postings fulfil the queries of these kinds."""
    ways = [(r.kind, i, q) for r in rules for i, q in enumerate(trigram_query(r.pattern))]
    asked = [(kind, i, t, len(q)) for kind, i, q in ways for t in sorted(q)]
    table = F.broadcast(docs.sparkSession.createDataFrame(asked, "kind string, way int, trigram string, asked int"))  # a few rows a rule
    hits = postings(docs, [q for *_, q in ways]).join(table, "trigram").groupBy("k1", "k2", "kind", "way").agg(F.count_distinct("trigram").alias("held"), F.first("asked").alias("asked"))
    return hits.where("held = asked").groupBy("k1", "k2").agg(F.collect_set("kind").alias("kinds"))


def _parted(rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], tuple[Rule, ...]]:
    """Rules without mandatory trigrams, and rules with them."""
    scanned = tuple(r for r in rules if frozenset() in trigram_query(r.pattern))
    return scanned, tuple(r for r in rules if r not in scanned)


def _asked(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The documents with ``kinds``: which of the indexed rules may match."""
    _, indexed = _parted(rules)
    none = F.expr("cast(array() as array<string>)")
    if not indexed:
        return docs.withColumn("kinds", none)
    found = settled(candidates(docs, indexed))
    if found.count() <= session.BROADCAST_ROWS:
        return docs.join(F.broadcast(found), ["k1", "k2"], "left")
    led = docs.withColumn("led", reduce(or_, [F.contains(F.lower("text"), F.lit(t)) for t in _leads([q for r in indexed for q in trigram_query(r.pattern)])]))
    asking = led.where("led").drop("led")
    groups = settled(asking.groupBy("k1", "k2").agg(F.count("*").alias("n")).join(found, ["k1", "k2"], "left"))
    total = groups.agg(F.sum("n")).first()[0] or 0
    answered = joined_by_size(asking, groups, ["k1", "k2"], total)
    return answered.unionByName(led.where(~F.col("led")).drop("led").withColumn("kinds", none))


def _wanted(rule: Rule, rules: tuple[Rule, ...]) -> Column:
    holds = F.col("text").rlike(rule.fast or rule.pattern)
    return holds if rule in _parted(rules)[0] else F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & holds


def _matches(rule: Rule) -> Column:
    """The text before each match, the match, and its checked group; at last the text after all."""
    pattern = rule.fast or rule.pattern
    hits, checked = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, rule.group))
    return F.arrays_zip(F.split("text", pattern, -1).alias("gap"), hits.alias("hit"), checked.alias("checked"))


def _places(rule: Rule, rank: int) -> Column:
    """The counted matches of a row as (start, rank, kind, end): running sums of the lengths, block by block."""
    before = lambda m: F.length(m["hit"]) - F.length(m["checked"]) if rule.own else F.lit(0)
    lengths = F.transform(_matches(rule), lambda m: F.struct((F.length(m["gap"]) + F.coalesce(before(m), F.lit(0))).cast("long").alias("gap"), (F.length(m["hit"]) - before(m)).cast("long").alias("hit"), (F.length(m["checked"]) >= rule.least).alias("counts")))
    size = lambda a, m: a + m["gap"] + F.coalesce(m["hit"], F.lit(0))
    span = lambda a, m: F.struct((a + m["gap"]).alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), size(a, m).alias("end"))
    none = F.expr("cast(array() as array<struct<start: bigint, rank: int, kind: string, end: bigint>>)")

    def step(state: Column, m: Column) -> Column:
        found = F.when(m["counts"], F.concat(state["found"], F.array(span(state["at"], m)))).otherwise(state["found"])
        return F.struct(size(state["at"], m).alias("at"), found.alias("found"))

    def placed(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), none.alias("found")), step, lambda state: state["found"])

    def of(matches: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / _MATCHES).cast("int")), lambda b: F.slice(matches, b * _MATCHES + 1, F.lit(_MATCHES)))
        return F.transform(F.array(blocks), in_blocks)[0]

    def in_blocks(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("long"), size))
        starts = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), placed))

    return F.transform(F.array(lengths), of)[0]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row; spans: array of (start, rank, kind, end), by start, then by the rules' order."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = _asked(base.withColumns({"k1": F.xxhash64("doc_id", "text"), "k2": F.xxhash64(F.lit(3), "text", "doc_id")}), rules)
    each = [F.when(_wanted(r, rules), _places(r, rank)) for rank, r in enumerate(rules)]
    return base.select("doc_id", F.array_sort(F.flatten(F.array_compact(F.array(*each)))).alias("spans"))


def _joined(column: Column) -> Column:
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans of each document."""
    bases = [r.kind for r in RULES if r.base]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return spans(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in bases],
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"].isin(bases))), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def _masked(rule: Rule) -> Column:
    before = lambda m: F.substring(m["hit"], F.lit(1), F.length(m["hit"]) - F.length(m["checked"])) if rule.own else F.lit("")
    mask = lambda m: F.when(F.length(m["checked"]) >= rule.least, F.concat(before(m), F.lit("[secret]"))).otherwise(F.coalesce(m["hit"], F.lit("")))
    return F.array_join(F.transform(_matches(rule), lambda m: F.concat(m["gap"], mask(m))), "")


def redacted(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, with their columns, whose texts have ``[secret]`` in place of every counted match, rule by rule.

    Postings decide which documents are searched at all, as in ``spans``; the others pass unchanged.
    """
    row = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = _asked(row.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(3), "text")}), rules)
    text = F.col("text")
    for r in rules:
        keyed = keyed.withColumn("text", F.when(_wanted(r, rules), _masked(r)).otherwise(text))
    fields = [F.when(F.col("row")[c].isNull(), F.lit(None)).otherwise(text).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return keyed.select(*fields)
