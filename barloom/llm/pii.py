"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers that pass their checks. These are the seeds.
The words before an identifier are its lexical patterns (the last word, the last two). Patterns and
identifiers form a graph over the whole corpus: every identifier-like run of the texts, seed or not,
is an instance of the patterns it follows. Spark scores the graph in rounds: an instance's score is 1 for a seed and otherwise
the confidence of the best pattern that first found it. A pattern's confidence in a kind weighs the scores of its
instances against the number of those that do not have the kind's shape; unseen ones of that shape, which are what the method
is for, count neither way. A pattern is accepted with `SUPPORT` different scored instances and a confidence of
`CONFIDENCE`; rounds end when no more are. What accepted patterns precede, and has the shape of the kind, is reported beside the base spans.

Nothing of the graph is collected: patterns, instances and occurrences are tables, scored by
aggregations (combined before the shuffle, so a pattern such as "the" is no hot spot) and joins.

Nulls and odd input: a null text counts as empty; rows that repeat an id are searched each for
itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table, texts
from barloom.storage import written

KINDS = ["email", "ip", "card", "phone"]
SUPPORT = 10
CONFIDENCE = 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a failed start fails again further into the same digits; the look-behind only saves the attempts
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE = re.compile("[ \\t\\n\\v\\f\\r]")
LONG_WORD = 256  # characters from which a word of a pattern stands by its hash
_OPENING, _CLOSING = "\"'([{<*", "\"')]}>*.,;:!?"
_NUMERIC = re.compile(r"[0-9().+-]+")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_SPELLED = re.compile(r"[\[({][\x20\x09-\x0D]*at[\x20\x09-\x0D]*[\])}]", re.IGNORECASE)
_FIRST_BRACKET = re.compile(r"[\[({]")
_DOT = re.compile(r"[\x20\x09]*[\[({][\x20\x09-\x0D]*(?:dot|\.)[\x20\x09-\x0D]*[\])}][\x20\x09]*[^\x20\x09-\x0D\[({]+", re.IGNORECASE)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from each @ outwards."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        match = _DOMAIN.match(text, at + 1) if start < at else None
        if match:
            yield start, match.end()
            done = at = match.end()
        else:
            at += 1


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind and start; code points, end exclusive."""
    out = [(0, s, e) for s, e in emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub("", m.group())
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


class _Leads:
    """The patterns before the spans of one text: the last word and the last two, in lower case.

    A word of more than `LONG_WORD` characters stands by a hash of all of them, fed from one span to the next.
    """

    def __init__(self, text: str) -> None:
        self.text, self.gaps = text, [m.start() for m in _SPACE.finditer(text)]
        self.begin, self.done, self.hash = -1, 0, hashlib.sha256()

    def _word(self, begin: int, end: int) -> str:
        if end - begin <= LONG_WORD:
            return self.text[begin:end].lower()
        if begin != self.begin or end < self.done:
            self.begin, self.done, self.hash = begin, begin, hashlib.sha256()
        self.hash.update(self.text[self.done : end].encode("utf-8", "surrogatepass"))
        self.done = end
        return "#" + self.hash.copy().hexdigest()

    def before(self, start: int) -> list[str]:
        at, words, text = start, [], self.text
        while len(words) < 2:
            end = at
            while end and text[end - 1] in " \t\n\v\f\r" + _OPENING:
                end -= 1
            gap = bisect.bisect_left(self.gaps, end)
            at = self.gaps[gap - 1] + 1 if gap else 0
            if at >= end:
                break
            words.append(self._word(at, end))
        return [" ".join(reversed(words[:k])) for k in range(1, len(words) + 1)]


def shaped(instance: str) -> list[int]:
    """The kinds whose shape an identifier-like run has; wider than the base patterns."""
    digits = len(_NOT_DIGIT.sub("", instance))
    groups = len([g for g in _NOT_DIGIT.split(instance) if g])
    numeric = _NUMERIC.fullmatch(instance.replace(" ", "")) is not None
    return [
        k
        for k, fits in enumerate(
            (
                "@" in instance or _SPELLED.search(instance) is not None,
                instance.count(":") >= 3 or (numeric and groups == 4 and instance.count(".") == 3),
                numeric and 12 <= digits <= 19,
                numeric and 7 <= digits <= 15,
            )
        )
        if fits
    ]


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Spans of addresses with a bracketed "at": its word and the next, or those beside it, and further parts behind a bracketed "dot"."""
    done = 0
    for m in _SPELLED.finditer(text):
        if m.start() < done:
            continue
        start, end = m.span()
        while start > done and text[start - 1] in " \t":
            start -= 1
        while start > done and text[start - 1] not in " \t\n\v\f\r":
            start -= 1
        while end < len(text) and text[end] in " \t":
            end += 1
        word = _TOKEN.match(text, end)
        if not word:
            continue
        cut = _FIRST_BRACKET.search(text, end, word.end())
        end = cut.start() if cut and cut.start() > end and _DOT.match(text, cut.start()) else word.end()
        while more := _DOT.match(text, end):
            end = more.end()
        run = text[start:end]
        start += len(run) - len(run.lstrip(_OPENING))
        end -= len(run) - len(run.rstrip(_CLOSING))
        if start < m.start() and end > m.end():
            yield start, end
            done = end


def occurrences(text: str, base: list[tuple[int, int, int]]):
    """(start, end, instance, seed kind or None, kinds it is shaped like, patterns) of every identifier-like run."""
    leads = _Leads(text)
    for kind, start, end in base:
        yield start, end, _key(text[start:end].lower()), kind, [], leads.before(start)
    taken, k = sorted((s, e) for _, s, e in base), 0
    free = []
    for start, end in spelled(text):
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or taken[k][0] >= end:
            free.append((start, end))
            yield _found(text, (start, end, False), leads)
    taken, k = sorted(taken + free), 0
    held = None
    for m in _TOKEN.finditer(text):
        if not any(c in "0123456789@" for c in m.group()):
            continue
        word = m.group()
        start = m.start() + len(word) - len(word.lstrip(_OPENING.replace("(", "")))
        end = max(start, m.end() - len(word) + len(word.rstrip(_CLOSING)))
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if start >= end or (k < len(taken) and taken[k][0] < end):
            continue
        numeric = _NUMERIC.fullmatch(text, start, end) is not None
        if held and numeric and held[2] and text[held[1] : start] == " ":
            held = (held[0], end, True)
            continue
        if held:
            yield _found(text, held, leads)
        held = (start, end, numeric)
    if held:
        yield _found(text, held, leads)


def _key(instance: str) -> str:
    """What stands for an instance in the graph: itself, or a hash where it is long."""
    if len(instance) <= 256:
        return instance
    return "#" + hashlib.sha256(instance.encode("utf-8", "surrogatepass")).hexdigest()


def _found(text: str, held: tuple[int, int, bool], leads: _Leads):
    instance = text[held[0] : held[1]].lower()
    return held[0], held[1], _key(instance), None, shaped(instance), leads.before(held[0])


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    runs = pa.list_(
        pa.struct(
            [
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("instance", pa.string()),
                ("seed", pa.int32()),
                ("shapes", pa.list_(pa.int32())),
                ("patterns", pa.list_(pa.string())),
            ]
        )
    )
    names = ["start", "end", "instance", "seed", "shapes", "patterns"]
    for batch in batches:
        base, seen = [], []
        for text in batch.column(1).to_pylist():
            found = base_spans(text) if any(map(text.__contains__, "0123456789@")) else []
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            likely = found or any(map(text.__contains__, "0123456789@")) or _SPELLED.search(text)
            seen.append([dict(zip(names, x)) for x in occurrences(text, found)] if likely else [])
        yield pa.record_batch([batch.column(0), pa.array(base, spans), pa.array(seen, runs)], ["doc_id", "base", "runs"])


def searched(docs: DataFrame) -> DataFrame:
    """One row per document with its base spans and identifier-like runs, in the shared folder."""
    schema = (
        "doc_id long, base array<struct<kind int, start long, end long>>, runs array<struct<start long, "
        "end long, instance string, seed int, shapes array<int>, patterns array<string>>>"
    )
    found = texts(docs).mapInArrow(_search, schema)
    return written(found.withColumn("row", F.monotonically_increasing_id()), "pii-search")


def confident(seen: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the accepted patterns, from a table of `searched`."""
    run = seen.select(F.explode("runs").alias("run")).select("run.*")
    edges = written(
        run.select(F.explode("patterns").alias("pattern"), "instance", "seed", "shapes").distinct(), "pii-edges"
    )
    size = edges.groupBy("pattern").agg(F.count_distinct("instance").alias("size")).where(F.col("size") >= SUPPORT)
    kinds = F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.col("shapes"))
    fits = (
        edges.select("pattern", "instance", F.explode(kinds).alias("kind"))
        .groupBy("pattern", "kind")
        .agg(F.count_distinct("instance").alias("fits"))
    )
    # what follows a pattern and is neither a seed of the kind nor shaped like it
    against = written(
        size.join(fits, "pattern").select("pattern", "kind", (F.col("size") - F.col("fits")).alias("against")), "pii-sizes"
    )
    scores = written(
        edges.where("seed is not null").select("instance", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct(),
        "pii-scores",
    )
    count = -1
    while True:
        accepted = written(
            edges.select("pattern", "instance")
            .distinct()
            .join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
            .join(against, ["pattern", "kind"])
            .withColumn("confidence", F.col("mass") / (F.col("mass") + F.col("against")))
            .where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE))
            .select("pattern", "kind", "confidence"),
            "pii-patterns",
        )
        # scores stay as first given, so patterns are only ever added, and none added means none to come
        before, count = count, accepted.count()
        if count in (before, 0):
            return accepted
        found = (
            edges.where("seed is null")
            .select("pattern", "instance", F.explode("shapes").alias("kind"))
            .join(accepted, ["pattern", "kind"])
            .groupBy("instance", "kind")
            .agg(F.max("confidence").alias("score"))
        )
        scores = written(scores.unionByName(found.join(scores, ["instance", "kind"], "left_anti")), "pii-scores")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end); added holds what patterns found."""
    seen = searched(docs)
    runs = seen.select("row", F.explode("runs").alias("run")).select("row", "run.*").where("seed is null")
    added = (
        runs.select("row", "start", "end", F.explode("shapes").alias("kind"), "patterns")
        .select("row", "start", "end", "kind", F.explode("patterns").alias("pattern"))
        .join(confident(seen), ["pattern", "kind"])
        .groupBy("row", "start", "end")
        .agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))
        .groupBy("row")
        .agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    )
    return seen.select("row", "doc_id", "base").join(added, "row", "left").drop("row")


def _joined(array):
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])
    return F.array_join(F.transform(array, one), ",")


def query(spark, folder: str) -> DataFrame:
    found = spans(table(spark, folder, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    everything = F.array_sort(F.concat("base", F.coalesce("added", F.expr("cast(array() as array<struct<kind int, start long, end long>>)"))))
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(everything).alias("spans"),
    )
