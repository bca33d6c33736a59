"""What several operators of this subpackage share."""

from __future__ import annotations

import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One run of white space, and one word, as every contract of this subpackage defines them.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, text) of every row; a null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )


def held_out(doc_id: Column) -> Column:
    """True for the quarter of the ids that no model may learn from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): the labels that a model may learn anything from, none of them held out."""
    return labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id"))).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")
    )


def share_of_good(labels: DataFrame) -> float | None:
    """The mean of all learnable labels; None where there are none."""
    return learnable(labels).agg(F.avg("quality").alias("x")).first()["x"]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, per_class: int, longest: int
) -> list[tuple[str, int]]:
    """A bounded training sample of (text, quality), on the driver.

    At most `per_class` rows of each quality, taken in the order of a hash of their ids, none of
    them held out, none with a text above `longest` characters: at most
    2 * per_class * longest characters. Scoring has no such bounds.
    """
    usable = learnable(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    picked = [
        usable.where(F.col("quality") == q).distinct().orderBy(*order).limit(per_class)
        for q in (0, 1)
    ]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * per_class rows at most
    rows = (
        texts(docs)
        .where(F.length("text") <= longest)
        .join(chosen, "doc_id")
        .select("doc_id", "text", "quality")
        .collect()
    )
    return [(r.text, r.quality) for r in sorted(rows, key=lambda r: (r.doc_id, r.quality, r.text))]


def worker_cache() -> dict:
    """A dictionary that lives as long as the Python worker, shared by the tasks it runs.

    Code of this package travels to executors by value, so module globals start anew in each task.
    """
    name = "_barloom_worker_cache"
    return sys.modules.setdefault(name, types.ModuleType(name)).__dict__.setdefault("kept", {})


def ranges(lengths):
    """numpy: 0..n-1 for each n of `lengths`, joined."""
    import numpy as np

    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - lengths, lengths)
