"""Packing token sequences: shortest-pack-first over the length histogram.

A document is its ids and the end id. Whole sequences of `size` ids are cut off first; what is
left over is one piece of 1 to size - 1 ids. Only the histogram of these lengths (at most `size` numbers) goes to
the driver. There lengths are placed longest first, each into the shortest pack it fits, many packs of one
pattern at a time. Where gaps of `gap` ids or more remain, the emptiest packs are taken
apart and their pieces cut to fill the gaps of others. The plan has a few rows per length; it says, by length
and rank, which pack and offset a piece takes, and is joined back to the documents.

Ranks within a length are taken in two steps, over hash buckets and inside them, so a length that a third of all
documents share is not ranked in one task. Pieces carry their ids in a table in the shared folder;
texts are tokenized once. Sequence ids are numbered without gaps over the packs of the plan.

Ids come from the given byte-level vocabulary; the same ranks are read by the faster of the two libraries
that ship it, and a test holds its ids against the other.

Nulls and odd input: a null or empty text is the end id alone; rows that repeat an id are packed each for itself (their
pieces show the same doc_id and start); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import table, texts, worker_cache
from barloom.storage import written

SIZE = 1024
END = 0
GAP = 8
BUCKETS = 1024
VOCABULARY = "byte_bpe_50k.tiktoken"


def encoder(name: str = VOCABULARY):
    """The tokenizer of this worker, loaded once."""
    kept = worker_cache()
    if name not in kept:
        import base64

        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        kept[name] = tiktoken.Encoding(
            name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
    return kept[name]


def pieces(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, doc_tokens, crc, ids): sequences of whole size, and what is left over.

    ids holds unsigned 32-bit numbers and is null for whole sequences, whose checksum is final.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        import numpy as np

        encode = encoder(vocabulary).encode_ordinary
        names = ["doc_id", "start", "length", "doc_tokens", "crc", "ids"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text)
                ids.append(END)
                n, raw = len(ids), np.array(ids, "<u4").tobytes()
                for at in range(0, n, size):
                    part = raw[4 * at : 4 * (at + size)]
                    whole = len(part) == 4 * size
                    rows.append((doc_id, at, len(part) // 4, n, zlib.crc32(part), None if whole else part))
                if len(rows) >= 4096:
                    yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names)

    return texts(docs).mapInArrow(
        cut, "doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
    )


def plan(histogram: dict[int, int], size: int = SIZE, gap: int = GAP) -> list[tuple]:
    """Rows (length, first rank, end rank, part start, part length, first sequence, offset).

    Ranks count the pieces of one length from 0. A piece's parts are the rows that hold its rank.
    """
    # packs of equal make: [count, [(length, first rank, part start, part length), ...]]; by space left
    open_packs: dict[int, list[list]] = {}
    done: list[tuple[int, list]] = []

    def put(left: int, count: int, parts: list) -> None:
        if left:
            open_packs.setdefault(left, []).append([count, parts])
        else:
            done.append((count, parts))

    def split(group: list, count: int) -> list:
        """Take `count` packs off a group; the ranks of the rest move on."""
        parts = group[1]
        group[0] -= count
        group[1] = [(length, rank + count, start, part) for length, rank, start, part in parts]
        return parts

    for length in sorted(histogram, reverse=True):
        waiting, rank = histogram[length], 0
        while waiting:
            left = max(open_packs, default=0)
            if left < length:  # the shortest pack is too full: a new one
                put(size - length, waiting, [(length, rank, 0, length)])
                break
            groups = open_packs[left]
            count = min(waiting, groups[-1][0])
            parts = split(groups[-1], count)
            if not groups[-1][0]:
                groups.pop()
                if not groups:
                    del open_packs[left]
            put(left - length, count, [*parts, (length, rank, 0, length)])
            waiting, rank = waiting - count, rank + count

    # take the emptiest packs apart and cut their pieces to the gaps of the fullest
    while open_packs:
        spare = sum(left * c for left, groups in open_packs.items() if left >= gap for c, _ in groups)
        emptiest = max(open_packs)
        if emptiest < gap or spare < size:
            break
        giver = open_packs[emptiest].pop()
        if not open_packs[emptiest]:
            del open_packs[emptiest]
        count = min(giver[0], spare // size)  # what is taken apart fits the gaps that stay
        parts = split(giver, count)
        if giver[0]:
            put(emptiest, *giver)
        for length, rank, start, part in parts:
            loose = [(count, rank, start, part)]
            while loose:
                count_, rank_, start_, part_ = loose.pop()
                left = min((x for x in open_packs if x >= gap), default=0)
                if not left:  # the last few: packs of their own
                    put(size - part_, count_, [(length, rank_, start_, part_)])
                    continue
                groups = open_packs[left]
                some = min(count_, groups[-1][0])
                filled = split(groups[-1], some)
                if not groups[-1][0]:
                    groups.pop()
                    if not groups:
                        del open_packs[left]
                fits = min(left, part_)
                put(left - fits, some, [*filled, (length, rank_, start_, fits)])
                if some < count_:
                    loose.append((count_ - some, rank_ + some, start_, part_))
                if fits < part_:
                    loose.append((some, rank_, start_ + fits, part_ - fits))

    rows, sequence = [], 0
    for count, parts in done + [(c, p) for groups in open_packs.values() for c, p in groups]:
        offset = 0
        for length, rank, start, part in parts:
            rows.append((length, rank, rank + count, start, part, sequence, offset))
            offset += part
        sequence += count
    return rows


def packed(docs: DataFrame, size: int = SIZE, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    spark = docs.sparkSession
    cut = written(
        pieces(docs, size, vocabulary).withColumn(
            "bucket", F.pmod(F.xxhash64("doc_id", "start", "crc"), F.lit(BUCKETS)).cast("int")
        ),
        "pieces",
    )
    per_bucket = written(cut.groupBy("length", "bucket").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in per_bucket.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select(
        "length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "crc")
    thin = cut.select("doc_id", "start", "length", "doc_tokens", "crc", "bucket", "ids")
    ranked = (
        thin.withColumn("within", F.row_number().over(inside) - 1)
        .join(before, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("within"))
    )
    rows = plan(histogram, size)
    # a few rows for each of at most `size` lengths, whatever the size of the table
    slots = F.broadcast(
        spark.createDataFrame(
            rows,
            "p_length long, first long, end long, part_start long, part_length long, sequence long, offset long",
        )
    )
    placed = ranked.join(
        slots,
        (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")),
    )
    # a cut piece's checksum comes from its ids; a whole one has its own already
    part = F.expr("substring(ids, cast(4 * part_start + 1 as int), cast(4 * part_length as int))")
    return placed.select(
        "doc_id",
        (F.col("start") + F.col("part_start")).alias("start"),
        F.col("part_length").alias("length"),
        F.when(F.col("part_length") == F.col("length"), F.col("crc")).otherwise(F.crc32(part)).alias("ids_crc32"),
        "doc_tokens",
        (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"),
        "offset",
    )


def query(spark, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))
