"""What each of five filters removes, in every order, by a relational pipeline over words.

Words are exploded and counted by (document, word), then by document: the sums are a text's words, the rows its
different words.  Every row also sends the word ``''``, which no text has: its count is how often the document is
repeated, and keeps documents without words.

Flags that need no words, the first holder of each text, and labels come to the word counts by outer joins on
narrow rows.  A document's five failures are one of 32 masks, and one aggregation by part has 32 conditional counts
(and as many of good and of toxic documents), from which the rows of all 120 orders follow inside each part's row.

Filters: A: fewer than 100 words; B: 100 * different words < 80 * words; C: 100 * ``[A-Z]`` characters > 10 * code
points; D: any of ``#$%&*|``; E: the text is that of a document with a smaller id.

Defined results: a null text is empty; a null lang is the part ``''``, as an empty lang is; a null id is smaller than
none and has no smaller ones, and no labels; repeated rows are documents of their own, none smaller than the other;
an id with several labels is good if one says so, and toxic if one does; an empty table gives no parts, and so no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT_PCT, MOST_UPPER_PCT = 100, 80, 10
BLANKS, SIGNS = r"[\x20\x09-\x0D]+", r"[#$%&*|]"
_MASKS = 1 << len(FILTERS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, h, n_words, n_distinct) of every (doc_id, h, text), repeated rows once: explode, count by word, then by document.

    Texts are dealt out once, by document and by the partition that they come from, so that a row that is repeated
    very often is split; words then stay where their text is, and only the counts of documents are shuffled.
    """
    words = F.concat(F.array(F.lit("")), F.filter(F.split("text", BLANKS), lambda w: w != ""))
    dealt = docs.select("doc_id", "h", "text", F.spark_partition_id().alias("origin")).repartition("origin", "doc_id", "h")
    counted = dealt.select("origin", "doc_id", "h", F.explode(words).alias("word")).groupBy("origin", "doc_id", "h", "word").agg(F.count("*").alias("n"))
    whole = counted.groupBy("origin", "doc_id", "h").agg(F.sum("n").alias("n"), F.max(F.when(F.col("word") == "", F.col("n"))).alias("copies"), F.count("*").alias("kinds"))
    alike = whole.select("doc_id", "h", F.expr("n div copies - 1").alias("n_words"), (F.col("kinds") - 1).alias("n_distinct"))
    return alike.groupBy("doc_id", "h").agg(F.max("n_words").alias("n_words"), F.max("n_distinct").alias("n_distinct"))


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E, good, toxic) of every document: which filters it fails, and its labels."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    upper = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    flags = base.select("doc_id", "h", "part", F.unhex(F.sha2("text", 256)).alias("digest"), (100 * upper > MOST_UPPER_PCT * F.length("text")).alias("C"), F.col("text").rlike(SIGNS).alias("D"))
    first = flags.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    known = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    counted = word_counts(base).select(F.col("doc_id").alias("of"), F.col("h").alias("of_h"), "n_words", "n_distinct")
    joined = flags.join(counted, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left").drop("of", "of_h")
    joined = joined.join(first, ["digest", "doc_id"], "left").join(known, "doc_id", "left")
    return joined.select(
        "doc_id",
        "part",
        (F.col("n_words") < LEAST_WORDS).alias("A"),
        (100 * F.col("n_distinct") < LEAST_DISTINCT_PCT * F.col("n_words")).alias("B"),
        "C",
        "D",
        (F.col("first").isNull() & F.col("doc_id").isNotNull()).alias("E"),
        F.coalesce("good", F.lit(False)).alias("good"),
        F.coalesce("toxic", F.lit(False)).alias("toxic"),
    )


def masks(failed: DataFrame) -> DataFrame:
    """(part, masks): for each of the 32 sets of filters, the numbers of documents that fail just these, good ones and toxic ones."""
    mask = reduce(Column.bitwiseOR, [F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    counts = [F.count_if((F.col("mask") == m) & ok).alias(f"{kind}{m}") for m in range(_MASKS) for kind, ok in kinds.items()]
    wide = failed.withColumn("mask", mask).groupBy("part").agg(*counts)
    each = [F.struct(F.lit(m).alias("mask"), *[F.col(f"{kind}{m}").alias(kind) for kind in kinds]) for m in range(_MASKS)]
    return wide.select("part", F.array(*each).alias("masks"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley), 600 rows a part.

    ``shapley`` is the sum, over all orders, of what the step's filter removes: a document that fails k filters is
    removed by each of them in one of k orders.
    """
    counted = masks(failures(docs, labels, id_col, text_col, part_col))
    orders = F.explode(F.lit(["".join(p) for p in permutations(FILTERS)]))
    steps = counted.select("part", "masks", orders.alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))
    bits = lambda text: reduce(lambda a, b: a + b, [F.when(F.contains(text, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)])
    steps = steps.withColumns({"own": bits(F.substr("filter_order", F.col("step"), F.lit(1))), "before": bits(F.substr("filter_order", F.lit(1), F.col("step") - 1))})
    own, before = F.col("own"), F.col("before")
    fails = lambda m: m["mask"].bitwiseAND(own) != 0
    here = lambda m: fails(m) & (m["mask"].bitwiseAND(before) == 0)
    every = len(list(permutations(FILTERS)))

    def total(where, what="n", times=lambda m: F.lit(1)) -> Column:  # noqa: ANN001
        return F.aggregate(F.filter("masks", where), F.lit(0).cast("long"), lambda a, m: a + m[what] * times(m))

    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda m: m["mask"].bitwiseAND(own + before) == 0).alias("kept"),
        total(here).alias("removed"),
        total(lambda m: fails(m) & (m["mask"].bitwiseAND(before) != 0)).alias("redundant"),
        total(lambda m: m["mask"] == own).alias("unique_fails"),
        total(here, "good").alias("good_lost"),
        total(here, "toxic").alias("toxic_lost"),
        total(fails, times=lambda m: (F.lit(every) / F.bit_count(m["mask"])).cast("long")).alias("shapley"),
    )
