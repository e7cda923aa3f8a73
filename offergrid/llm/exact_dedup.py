"""Exact deduplication by a 128-bit content hash, with bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from offergrid.llm.common import free_name, settle, squeezed

#: Members of one group that meet one copy of the keeper's text in a join key.
BLOCK = 1_000


def md5_128(body: Column) -> Column:
    return F.unhex(F.md5(body))


def exact_groups(docs: DataFrame, hashed: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical without white space; a null text is
    empty.  The row with the most code points stays, then the smallest doc_id;
    a null doc_id loses to any other.  Repeated rows that carry the keeper's id
    are all marked kept (``keep_rows`` returns one of them).  Other columns are
    ignored, an empty table gives no rows.

    Digests are grouped with partial sums.  Only rows of groups of two or more
    bring their text once more: each is compared with the keeper's text, which
    is dealt out to as many blocks as the group needs.  Rows of a collision are
    grouped anew by their whole text.
    """
    texts = docs.select("doc_id", squeezed(F.col("text")).alias("body"),
                        F.char_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    marked = texts.select("doc_id", "body", "n", hashed(F.col("body")).alias("h"))
    digests = settle(marked.select("doc_id", "n", "h", F.unhex(F.sha2("body", 256)).alias("sha")), "digests")
    best = F.min_by("doc_id", F.struct((-F.col("n")).alias("less"), F.col("doc_id").isNull().alias("none"), "doc_id")).alias("first")
    groups = settle(digests.groupBy("h").agg(F.count(F.lit(1)).alias("size"), best)
                    .filter(F.col("size") > 1)
                    .select(F.col("h").alias("g"), "size", "first"), "groups")
    in_groups = digests.join(groups, F.col("h") == F.col("g")).select(
        F.col("doc_id").alias("id"), "g", "size", "first")
    members = settle(marked.join(in_groups.distinct(), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("g")))
                     .select("doc_id", "body", "n", "h", "size", "first"), "members")
    blocks = (F.col("size") / BLOCK).cast("int") + 1
    keeper = F.col("doc_id").eqNullSafe(F.col("first"))
    # repeated ids: of rows with the keeper's id and hash, the longest body by value stands for the group
    keepers = (members.filter(keeper).groupBy("h").agg(F.max("body").alias("kept_body"), F.max("size").alias("size"))
               .select(F.col("h").alias("g"), "kept_body", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block")))
    dealt = members.withColumn("b", F.pmod(F.xxhash64("doc_id"), blocks))
    collided = settle(dealt.join(keepers, (F.col("h") == F.col("g")) & (F.col("b") == F.col("block")))
                      .filter(F.col("body") != F.col("kept_body")).select("doc_id", "h", "n", "body"), "collided")
    regrouped = collided.groupBy("body").agg(F.count(F.lit(1)).alias("size2"), best)
    moved = collided.join(regrouped, "body").select(
        F.col("doc_id").alias("id2"), F.col("h").alias("h2"), F.unhex(F.sha2("body", 256)).alias("sha2"), "size2",
        F.col("first").alias("first2")).distinct()
    gone = collided.groupBy(F.col("h").alias("h3")).agg(F.count(F.lit(1)).alias("gone"))
    sizes = groups.join(gone, F.col("g") == F.col("h3"), "left").select(
        "g", "first", (F.col("size") - F.coalesce("gone", F.lit(0))).alias("size"))
    whole = (digests.join(sizes, F.col("h") == F.col("g"), "left")
             .join(moved, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("h") == F.col("h2"))
                   & (F.col("sha") == F.col("sha2")), "left"))
    alone = F.col("g").isNull()
    keep_id = F.when(F.col("h2").isNotNull(), F.col("first2")).when(alone, F.col("doc_id")).otherwise(F.col("first"))
    size = F.coalesce("size2", "size", F.lit(1)).cast("long")
    return (whole.withColumn("keep_id", keep_id)
            .select("doc_id", "keep_id", size.alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.lower(F.hex("sha")).alias("text_sha256")))


def keep_rows(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; one of repeated rows."""
    id_, sha_ = free_name(docs, "id"), free_name(docs, "sha")
    kept = exact_groups(docs).filter("kept").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(sha_))
    kept = settle(kept, "kept")
    repeated = kept.groupBy(id_, sha_).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").limit(1).count()
    sha = F.sha2(squeezed(F.col("text")), 256)
    rows = docs.join(kept.distinct() if repeated else kept, F.col("doc_id").eqNullSafe(F.col(id_)) & (sha == F.col(sha_)),
                     "left_semi")
    return rows.dropDuplicates(["doc_id", "text"]) if repeated else rows


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents),
     g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY body) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM g
"""
