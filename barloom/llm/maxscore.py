"""Ranked lexical search by pair-bound MaxScore.

Index. The documents are cut into shards of some `SHARD` terms in the order in which they are read. A shard is a set of rows: one for
each of its terms with the documents and occurrences, and one with the ids and lengths of its documents. The index covers every term
of every document and knows no query.

Lists. Queries come in batches of some `ITEMS`. For each shard and batch the posting lists of the batch's terms are gathered,
with the impact of each posting, and with the precomputed intersections: for each item its terms are ordered by
weight, and each meets the next `REACH` in that order. Of an intersection the lists keep its size and the *joint maximum*: the
largest sum of both impacts in one document. The intersections also give each document a lower bound, the largest joint
impact it has; the k-th largest lower bound over all shards is a threshold that no document below can enter an
item's result with.

Search. In a shard, disjoint pairs are chosen where the joint maximum saves most: a pair's bound is the largest of its joint maximum and
either term's own maximum, since a document that holds one of them gets no more than that. The terms of least impact whose
bound, pairs combined, stays below the threshold are not essential: no document that holds only those can enter. A shard whose terms together stay
below it is skipped. The essential lists are added up; the others are only looked up for documents that can still enter,
with the bound of what is left checked after each. Ties at the threshold are kept, so results are exact.

Size: a task holds one shard's lists for one batch; a document longer than a shard is one by itself. Each shard emits at most k rows an item.

Nulls and odd input: a null or empty text has no terms, counts in neither N nor L and is never found; rows that
repeat an id are documents of their own; a null id comes after others among equal scores; equal rows of items count
once, items that share an id are ranked each by itself; an item without a known term has no rows; empty tables give an
empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import table
from barloom.storage import written

SHARD = 1 << 20  # terms after which a shard closes
ITEMS = 256  # items that are searched together, about
TOGETHER = 4  # shards that a task searches, about
REACH = 2  # how far in the order of weights terms are paired
MOST = 2**63 - 1

INDEX = "shard long, term string, df int, docs array<int>, counts array<int>, doc_ids array<long>, lengths array<int>"
LISTS = (
    "shard long, batch int, doc_ids array<long>, weights array<long>, ends array<int>, docs binary, impacts binary, "
    "used array<int>, users array<int>, firsts array<int>, seconds array<int>, sizes array<int>, joint array<long>, "
    "bounded array<int>, bounds array<long>"
)

#: Bytes of a term keep their value (A-Z in lower case), all others become a space.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text (UTF-8), in order."""
    return text.translate(_TERMS).split()


# ---- index ---------------------------------------------------------------------------------------


def index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The index of `docs` as a table in the shared folder."""
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        ids, lengths, flat, vocabulary = [], [], [], {}

        def close():
            n = np.array(lengths, np.int64)
            at = np.repeat(np.arange(len(n)), n)
            known = np.concatenate(flat) if flat else np.empty(0, np.int64)
            both, counts = np.unique((known << 32) | at, return_counts=True)
            term, doc = both >> 32, (both & 0xFFFFFFFF).astype(np.int32)
            ends = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(vocabulary))))).astype(np.int32)
            k = len(vocabulary)
            size = np.diff(ends).astype(np.int32)
            none = lambda n, kind: pa.nulls(n, pa.list_(kind))
            shard = (part << 32) + number
            lists = lambda v: pa.ListArray.from_arrays(pa.array(ends), pa.array(v))
            yield pa.record_batch(
                [
                    pa.array([shard] * k, pa.int64()), pa.array([t.decode("utf-8", "replace") for t in vocabulary], pa.string()), pa.array(size),
                    lists(doc), lists(counts.astype(np.int32)), none(k, pa.int64()), none(k, pa.int32()),
                ],
                names,
            )
            yield pa.record_batch(
                [
                    pa.array([shard], pa.int64()), pa.nulls(1, pa.string()), pa.nulls(1, pa.int32()), none(1, pa.int32()), none(1, pa.int32()),
                    pa.array([ids], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int32())),
                ],
                names,
            )

        size = 0
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms(raw)
                flat.append(np.array([vocabulary.setdefault(t, len(vocabulary)) for t in found], np.int64))
                ids.append(doc_id)
                lengths.append(len(found))
                size += len(found) + 16
                if size >= SHARD:
                    yield from close()
                    number, size = number + 1, 0
                    ids, lengths, flat, vocabulary = [], [], [], {}
        if ids:
            yield from close()

    raw = F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw")
    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), raw).mapInArrow(run, INDEX), "lexical-index")


def totals(indexed: DataFrame) -> tuple[int, int]:
    """N and L: documents with a term, and terms in all."""
    length = F.explode("lengths").alias("n")
    found = indexed.where("term IS NULL").select(length).where("n > 0")
    row = found.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return row.docs, row.terms


# ---- items ---------------------------------------------------------------------------------------


def weighted(items: DataFrame, indexed: DataFrame, docs: int, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: (batch, j, item_id), the items numbered in their batch, and (batch, term, weight, users), the items of a term."""
    distinct = items.select("item_id", F.coalesce(F.col(text), F.lit("")).alias("text")).distinct()
    keyed = distinct.withColumn("key", F.sha2("text", 256))
    batches = max(1, -(-keyed.count() // ITEMS))
    batch = F.pmod(F.xxhash64("item_id", "key"), F.lit(batches)).cast("int")
    keyed = written(keyed.withColumn("batch", batch), "items")
    numbered = (
        keyed.groupBy("batch")
        .agg(F.sort_array(F.collect_list(F.struct("item_id", "key"))).alias("all"))
        .select("batch", F.posexplode("all").alias("j", "item"))
        .select("batch", "j", "item.item_id", "item.key")
    )
    numbered = written(numbered, "items-numbered")

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            rows = [
                (batch, j, t.decode("utf-8", "replace"))
                for batch, j, raw in zip(*[c.to_pylist() for c in b.columns])
                for t in dict.fromkeys(terms(raw))
            ]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            yield pa.record_batch(columns, ["batch", "j", "term"])

    whole = keyed.join(numbered.select("batch", "key", "j", F.col("item_id").alias("__id")), ["batch", "key"])
    whole = whole.where(F.col("item_id").eqNullSafe(F.col("__id")))
    used = written(whole.select("batch", "j", F.col("text").cast("binary").alias("raw")).mapInArrow(run, "batch int, j int, term string"), "item-terms")
    frequency = indexed.where("term IS NOT NULL").select("term", "df").join(used.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(F.lit(1000) * F.log(F.lit(float(2 * docs + 2)) / (2 * F.col("df") + 1))).cast("long")
    of_term = (
        used.groupBy("batch", "term")
        .agg(F.sort_array(F.collect_list("j")).alias("users"))  # the items of one batch at most
        .join(frequency.withColumn("weight", weight).where("weight > 0"), "term")
        .select("batch", "term", "weight", "users")
    )
    return numbered.drop("key"), written(of_term, "term-weights")


# ---- lists ---------------------------------------------------------------------------------------


def impacts(counts, lengths, docs: int, all_terms: int):
    """numpy: what a weight of one gives for `counts` occurrences in documents of `lengths` terms."""
    import numpy as np

    if 50 * int(lengths.max(initial=0)) * docs < MOST:
        spread = 50 * lengths.astype(np.int64) * docs // all_terms
    else:
        spread = np.array([50 * n * docs // all_terms for n in lengths.tolist()], np.int64)
    tf = counts.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 20 * (50 + spread))


def intersection(a_docs, a, b_docs, b):
    """numpy: the documents of both lists, and the sums of both impacts there."""
    import numpy as np

    if len(a_docs) > len(b_docs):
        a_docs, a, b_docs, b = b_docs, b, a_docs, a
    if not len(a_docs):
        return a_docs, a
    at = np.minimum(np.searchsorted(b_docs, a_docs), len(b_docs) - 1)
    both = b_docs[at] == a_docs
    return a_docs[both], a[both] + b[at[both]]


def _gather(k: int, docs: int, all_terms: int):
    """The lists of one shard for one batch, with joint maxima of pairs and lower bounds of documents."""
    names = [f.split()[0] for f in LISTS.split(", ")]

    def run(group: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow.compute as pc

        schema = pa.schema([
            ("shard", pa.int64()), ("batch", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("weights", pa.list_(pa.int64())),
            ("ends", pa.list_(pa.int32())), ("docs", pa.binary()), ("impacts", pa.binary()), ("used", pa.list_(pa.int32())),
            ("users", pa.list_(pa.int32())), ("firsts", pa.list_(pa.int32())), ("seconds", pa.list_(pa.int32())),
            ("sizes", pa.list_(pa.int32())), ("joint", pa.list_(pa.int64())), ("bounded", pa.list_(pa.int32())), ("bounds", pa.list_(pa.int64())),
        ])
        if group.num_rows < 2:  # a shard without any of the terms
            return schema.empty_table()
        group = group.combine_chunks()
        own = group.filter(pc.is_null(group["term"])).to_pylist()[0]
        lists = group.filter(pc.is_valid(group["term"])).sort_by([("weight", "ascending"), ("term", "ascending")]).combine_chunks()
        flat = lambda c: lists[c].combine_chunks().flatten().to_numpy()
        sizes = lists["docs"].combine_chunks().value_lengths().to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
        at, lengths = flat("docs"), np.array(own["lengths"], np.int64)
        weights = lists["weight"].to_numpy()
        impact = impacts(flat("counts"), lengths[at], docs, all_terms)
        score = impact * np.repeat(weights, sizes)
        users = lists["users"].to_pylist()
        of_item: dict[int, list[int]] = {}
        for t, some in enumerate(users):  # in the order of weights
            for j in some:
                of_item.setdefault(j, []).append(t)
        met: dict[tuple[int, int], tuple] = {}
        bounded, bounds = [], []
        for j, own_terms in of_item.items():
            low = np.zeros(len(lengths), np.int64)
            for n, a in enumerate(own_terms):
                part = slice(ends[a], ends[a + 1])
                low[at[part]] = np.maximum(low[at[part]], score[part])
                for b in own_terms[n + 1 : n + 1 + REACH]:
                    if (a, b) not in met:
                        other = slice(ends[b], ends[b + 1])
                        met[a, b] = intersection(at[part], score[part], at[other], score[other])
                    some, joint = met[a, b]
                    low[some] = np.maximum(low[some], joint)
            best = low[low > 0]
            best = np.partition(best, len(best) - k)[-k:] if len(best) > k else best
            bounded += [j] * len(best)
            bounds += best.tolist()
        values = [
            own["shard"], own["batch"], own["doc_ids"], weights.tolist(), ends.tolist(), at.astype("<i4").tobytes(), impact.astype("<i4").tobytes(),
            [t for t, some in enumerate(users) for _ in some], [j for some in users for j in some],
            [a for a, _ in met], [b for _, b in met], [len(d) for d, _ in met.values()], [int(s.max(initial=0)) for _, s in met.values()],
            bounded, bounds,
        ]
        return pa.table([pa.array([v], f.type) for v, f in zip(values, schema)], names=names)

    return run


def lists(indexed: DataFrame, weights: DataFrame, k: int, docs: int, all_terms: int) -> DataFrame:
    """One row per shard and batch that has any of its terms: posting lists, pairs, lower bounds."""
    last = weights.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    postings = indexed.where("term IS NOT NULL").select("shard", "term", "docs", "counts").join(weights, "term")
    own = indexed.where("term IS NULL").select("shard", "doc_ids", "lengths")
    own = own.withColumn("batch", F.explode(F.expr(f"filter(sequence(0, {max(last, 0)}), b -> b <= {last})")))
    gathered = postings.unionByName(own, allowMissingColumns=True)
    columns = ["shard", "batch", "term", "weight", "users", "docs", "counts", "doc_ids", "lengths"]
    return written(gathered.select(*columns).groupBy("shard", "batch").applyInArrow(_gather(k, docs, all_terms), LISTS), "lexical-lists")


# ---- search --------------------------------------------------------------------------------------


def matched(own: list[int], most: list[int], joint: dict[tuple[int, int], int]) -> dict[int, tuple[int, int]]:
    """Disjoint pairs with the largest savings: {term: (partner, bound of both)}, both ways."""
    saving = []
    for (a, b), both in joint.items():
        bound = max(both, most[a], most[b])
        if bound < most[a] + most[b]:
            saving.append((most[a] + most[b] - bound, a, b, bound))
    out: dict[int, tuple[int, int]] = {}
    for _, a, b, bound in sorted(saving, reverse=True):
        if a not in out and b not in out:
            out[a], out[b] = (b, bound), (a, bound)
    return out


def prefix_bounds(order: list[int], most: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The bound of the first 0, 1, 2, … terms of `order`: pairs whose terms are both among them count once."""
    out, total, seen = [0], 0, set()
    for t in order:
        partner, both = pairs.get(t, (None, 0))
        total += both - most[partner] if partner in seen else most[t]
        seen.add(t)
        out.append(total)
    return out


def best_of(own: list[int], joint: dict, ends, docs, score, most: list[int], n_docs: int, threshold: int, k: int):
    """numpy: (documents, scores) that may be among the k best of an item; all with a score of at least `threshold` and 1."""
    import numpy as np

    nothing = np.empty(0, np.int64), np.empty(0, np.int64)
    order = sorted(own, key=lambda t: (most[t], t))
    bounds = prefix_bounds(order, most, matched(own, most, joint))
    threshold = max(threshold, 1)
    if bounds[-1] < threshold:
        return nothing
    cut = max(n for n, b in enumerate(bounds) if b < threshold)  # the first `cut` terms are not essential
    found = np.zeros(n_docs, np.int64)
    for t in order[cut:]:
        part = slice(ends[t], ends[t + 1])
        found[docs[part]] += score[part]
    at = np.flatnonzero(found)
    sums = found[at]
    for left in range(cut, -1, -1):  # `left` lists are still to be looked up
        if len(at) > k:
            threshold = max(threshold, int(np.partition(sums, len(sums) - k)[len(sums) - k]))
        stay = sums + bounds[left] >= threshold
        at, sums = at[stay], sums[stay]
        if left and len(at):
            part = slice(ends[order[left - 1]], ends[order[left - 1] + 1])
            some = docs[part]
            if len(some):
                place = np.minimum(np.searchsorted(some, at), len(some) - 1)
                sums = sums + np.where(some[place] == at, score[part][place], 0)
    return at, sums


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            for row in range(batch.num_rows):
                r = batch.slice(row, 1).to_pylist()[0]
                ends, docs = r["ends"], np.frombuffer(r["docs"], "<i4")
                sizes = np.diff(ends)
                score = np.frombuffer(r["impacts"], "<i4").astype(np.int64) * np.repeat(np.array(r["weights"], np.int64), sizes)
                most = np.maximum.reduceat(score, ends[:-1]).tolist()
                ids = np.array([MOST if i is None else i for i in r["doc_ids"]], np.int64)
                thresholds = {t["j"]: t["low"] for t in r["thresholds"] or []}
                joint = dict(zip(zip(r["firsts"], r["seconds"]), r["joint"]))
                of_item: dict[int, list[int]] = {}
                for t, j in zip(r["used"], r["users"]):
                    of_item.setdefault(j, []).append(t)
                out = []
                for j, own in of_item.items():
                    near = {(a, b): joint[a, b] for n, a in enumerate(own) for b in own[n + 1 : n + 1 + REACH]}
                    at, sums = best_of(own, near, ends, docs, score, most, len(ids), thresholds.get(j, 0), k)
                    first = np.lexsort((ids[at], -sums))[:k]
                    out += [(r["batch"], j, r["doc_ids"][d], s) for d, s in zip(at[first].tolist(), sums[first].tolist())]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.record_batch([pa.array([o[c] for o in out], kind) for c, kind in enumerate(kinds)], ["batch", "j", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    indexed = index(docs)
    n, all_terms = totals(indexed)
    numbered, weights = weighted(items, indexed, n)
    ready = lists(indexed, weights, k, max(n, 1), max(all_terms, 1))
    lows = ready.select("batch", F.explode(F.arrays_zip("bounded", "bounds")).alias("x")).select("batch", "x.bounded", "x.bounds")
    order = Window.partitionBy("batch", "bounded").orderBy(F.col("bounds").desc())
    kth = lows.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k).where(F.col("at") == k)
    thresholds = kth.groupBy("batch").agg(F.collect_list(F.struct(F.col("bounded").alias("j"), F.col("bounds").alias("low"))).alias("thresholds"))
    # the shards of a batch are dealt to as many tasks as they need, each with the batch's thresholds
    salts = max(1, -(-ready.count() // TOGETHER))
    thresholds = thresholds.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = ready.drop("sizes", "bounded", "bounds").withColumn("salt", F.pmod(F.xxhash64("shard"), F.lit(salts)).cast("int"))
    met = dealt.join(thresholds, ["batch", "salt"], "left")
    found = met.mapInArrow(_search(k), "batch int, j int, doc_id long, score long")
    best = Window.partitionBy("batch", "j").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.join(numbered, ["batch", "j"]).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def query(spark, folder: str) -> DataFrame:
    return search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

SQL = f"""
WITH split AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(len(w)) AS BIGINT) AS terms FROM split WHERE len(w) > 0
), items AS (
  SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                            '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), found AS (
  SELECT row, doc_id, CAST(len(w) AS BIGINT) AS n, term, count(*) AS tf
  FROM (SELECT row, doc_id, w, unnest(w) AS term FROM split)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT term, count(*) AS df FROM found GROUP BY term), totals
), scores AS (
  SELECT item_id, row, doc_id,
         CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM items JOIN weights USING (term) JOIN found USING (term), totals GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""
