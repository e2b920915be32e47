"""MinHash near-duplicates by min-max hashing.

Each permutation of the shingles gives two signature values, its minimum and its maximum, which halves the
number of hashes for a signature of one length; the share of equal values is an unbiased estimate of the
Jaccard likeness with a lower variance than minima alone.  The signature is banded, candidate pairs are
confirmed on full shingle sets, and links give components.

80 permutations are 160 values in 32 bands of 5: a pair at a likeness of 0.85 is missed with probability
(1 - 0.85**5)**32 < 1e-8, one at 0.8 with 3e-6.  No bucket or number of partners is capped.

Defined results: a text that is null or has no words has no shingles and is linked with nothing; a text of
fewer words than a shingle is one shingle; rows with equal texts, repeated rows included, are one class, and
``kept`` marks the rows that have the class's least doc_id.  An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.llm import linking, session
from furrow.llm.session import joined_by_size, settled

SIGNATURE = linking.Signature("minmax", permutations=80, rows=5)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, signature: linking.Signature = SIGNATURE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    found = linking.components(docs, id_col, text_col, shingle_words, threshold, signature)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, threshold: float = 0.8, signature: linking.Signature = SIGNATURE) -> DataFrame:
    """One document, with its columns, of each component: the least doc_id, nulls last, and of its texts one by their hash.

    It is found again by doc_id and hash of the text, so repeated and null ids bring back no other row; rows that
    repeat doc_id and text stay once; a row that is repeated very often is found by broadcast.
    """
    first = linking.firsts(docs, id_col, text_col, shingle_words, threshold, signature)
    key = lambda i, t: [i.isNull().alias("null_id"), F.coalesce(i.cast("string"), F.lit("")).alias("id"), t.alias("key")]
    first = settled(first.select(*key(F.col("first_id"), F.col("first_key")), "copies", F.col("copies").alias("n")))
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # so that no column of theirs clashes
    rows = rows.select("row", *key(F.col("row")[id_col], linking.text_key(F.col("row")[text_col])))
    sizes = first.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    names = ["null_id", "id", "key"]
    kept = joined_by_size(rows, first, names, sizes["total"]) if sizes["most"] > session.HOT_ROWS else rows.join(first, names)
    once = kept.where("copies = 1").select("row.*")
    again = kept.where("copies > 1").select("row.*").dropDuplicates([id_col, text_col])
    return once.unionByName(again)
