"""Exact deduplication by skew-safe combining.

Texts are compared whole, after white space is normalised. The combining runs in three stages, each
an aggregation whose key holds the full text beside its digest:

1. locally: the map side of the first aggregation folds equal texts of one input partition;
2. by (digest, salt, text): a digest's local winners are spread over `salts` groups, so that a group
   of copies that every partition holds does not meet in one task;
3. by (digest, text): at most `salts` salt winners per text remain.

What leaves is (digest, smallest id, number of rows) per text. Documents meet it on the digest
alone; Spark splits that join where a group of copies is large. Should two different texts ever
share a digest, the join takes the text as well.

Nulls and odd input: a null text counts as empty; a null id never wins unless the whole group has
none; rows that repeat the winning id are all marked kept; an empty table gives an empty result;
columns of the input named like an output column are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.storage import written

#: White-space runs other than one single space; the rest is normalised as it is.
_UNEVEN = "[\\x09-\\x0D][\\x20\\x09-\\x0D]*|\\x20[\\x20\\x09-\\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _UNEVEN, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def groups(
    docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per distinct text: __digest, __text, __keep (smallest id), __size."""
    base = docs.select(
        F.col("doc_id").alias("__id"),
        normalised(F.col("text")).alias("__text"),
        F.pmod(F.spark_partition_id(), F.lit(salts)).alias("__salt"),
    ).withColumn("__digest", digest(F.col("__text")))
    salted = base.groupBy("__digest", "__salt", "__text").agg(
        F.min("__id").alias("__keep"), F.count("*").alias("__size")
    )
    return salted.groupBy("__digest", "__text").agg(
        F.min("__keep").alias("__keep"), F.sum("__size").alias("__size")
    )


def annotate(
    docs: DataFrame, salts: int = 16, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """Every row of `docs` with keep_id, group_size, kept and text_sha256."""
    found = groups(docs, salts, digest)
    thin = written(found.select("__digest", "__keep", "__size"), "exact-groups")
    keyed = docs.withColumn("__text", normalised(F.col("text"))).withColumn(
        "__digest", digest(F.col("__text"))
    )
    ambiguous = thin.groupBy("__digest").count().where("count > 1").limit(1).count() > 0
    joined = (
        keyed.join(found, ["__digest", "__text"])
        if ambiguous
        else keyed.join(thin, "__digest")
    )
    return (
        joined.withColumn("text_sha256", sha256(F.col("__text")) if digest is not sha256 else F.col("__digest"))
        .withColumn("keep_id", F.col("__keep"))
        .withColumn("group_size", F.col("__size"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("__keep")))
        .drop("__digest", "__text", "__keep", "__size")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns they came with."""
    clean = docs.drop("keep_id", "group_size", "kept", "text_sha256")
    return annotate(clean).where("kept").select(*clean.columns)


def query(spark, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return annotate(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents
)
select doc_id, min(doc_id) over (partition by body) as keep_id,
       count(*) over (partition by body) as group_size,
       doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256
from t
"""
