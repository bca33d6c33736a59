"""Removal of repeated 100-byte strings with difference-cover suffix sorting.

A byte goes if a string of `LENGTH` bytes that covers it also starts earlier (smaller id, or same document and earlier
start). Equality of 100 bytes is all that counts, so most of the corpus needs no suffix sorting: four passes decide what they
can exactly and leave the rest.

1. Anchors. Of the 69 windows of 32 bytes in every 100-byte string the one with the smallest hash is its anchor, so
   equal strings have the same anchor at the same place. An anchor's context is the text of all strings whose
   anchor it is, 135 bytes on average. About one byte in 35 starts an anchor.
2. Contexts. Anchors meet by their own hash. Every occurrence of a context but the first goes as a whole. The first stays
   where its anchor has no other context. Only first occurrences of anchors with several contexts - the
   rims of what is repeated - are left.
3. Suffix sorting of what is left, by the difference cover {1, 2} modulo 3. Contexts of an anchor meet in one task with their
   bytes. Positions 1 and 2 modulo 3 are sampled; triples of eight-byte words are sorted and named; the same is done on triples of
   names, which multiplies the depth by three, until it exceeds the string length; positions 0 modulo 3 are sorted by a byte
   and the rank behind it and merged in; neighbours are compared over 100 bytes. Of each run of equals all but
   the earliest go.
4. Rows of spans meet their documents and are cut out.

Sorting all suffixes this way would name two thirds of all bytes, 16 bytes of shuffle each in every round;
that does not fit four times the input on disk, the reason for steps 1 and 2.

Skew. Copies are folded inside an Arrow batch before anything is shuffled. An anchor with many contexts in one
batch (`HOT`; the rim of a passage that a third of all documents hold) is dealt by context, with one marking row to those dealt
by anchor. Contexts of such an anchor, and of one with more than `TOGETHER` contexts in all, are sorted over all tasks: by
what stands before the anchor, read backwards, and by what stands behind it. Their neighbours bound how far a context agrees
with any other on either side; only the few strings within both bounds are compared, as rows (128-bit
hash, position), whose minimum is combined before the shuffle. A task streams its rows sorted and never holds more
than `TOGETHER` contexts of one anchor.

Nulls and odd input: a null text counts as empty; texts below 100 bytes lose nothing; a null id comes before
all others; rows that repeat an id count as one document with two texts; an empty table gives an empty result. Ids and the
longest text must fit 63 bits together (`ValueError` otherwise). Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import table, worker_cache
from barloom.storage import release, written

LENGTH = 100  # bytes of a string
GRAM = 32  # bytes of an anchor
BEFORE = LENGTH - GRAM  # how far a string reaches before its anchor
WINDOW = BEFORE + 1  # anchors to choose from in a string
SLICE = 1 << 20  # bytes hashed at a time
FOLDED = 200_000  # anchors of one batch that are folded at a time
HOT = 200  # contexts of one anchor among these, above which it is dealt by context
TOGETHER = 4_000  # contexts of one anchor that are sorted together
MARK = -1


def _constants(size: int):
    """numpy: (value of each byte, powers of an odd base, powers of its inverse), modulo 2^64."""
    import numpy as np

    kept = worker_cache()
    if kept.get("powers", (0,))[0] < size:
        base = 0x9E3779B97F4A7C15
        inverse = pow(base, -1, 1 << 64)
        row = lambda b: np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)])
        values = np.random.default_rng(20240607).integers(0, 2**64, 512, np.uint64).reshape(2, 256)
        kept["powers"] = (size, values, row(base), row(inverse))
    return kept["powers"][1:]


def _sliding(x, width: int, op):
    """numpy: op (minimum or maximum) over each `width` neighbours."""
    import numpy as np

    n = len(x)
    padded = np.zeros(-(-n // width) * width, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = op.accumulate(rows, axis=1).ravel()
    right = op.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - width + 1], left[width - 1 : n])


def _anchors(parts: list[tuple[int, int, int, bytes]]):
    """numpy: (part, start, anchor hash, context hash, reach before, reach behind) of the anchors of several texts.

    parts: (first start wanted, end of those wanted, start of the slice in its text, slice). A slice reaches BEFORE
    and LENGTH beyond what is wanted, or to the rim of its text.
    """
    import numpy as np

    data = np.frombuffer(b"".join([p[3] for p in parts]), np.uint8)
    n = len(data)
    values, power, inverse = _constants(max(n, 2 * SLICE))
    upto = np.concatenate(([np.uint64(0)], np.cumsum(values[0][data] * power[:n])))
    h = (upto[GRAM:] - upto[:-GRAM]) * inverse[: n - GRAM + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    ends = np.cumsum([len(p[3]) for p in parts])
    low = _sliding(h, WINDOW, np.minimum)
    for e in ends[:-1].tolist():  # strings across two texts are none
        low[max(0, e - LENGTH + 1) : e] = 0
    high = _sliding(np.concatenate([np.zeros(BEFORE, np.uint64), low, np.zeros(BEFORE, np.uint64)]), WINDOW, np.maximum)
    at = np.flatnonzero(high == h)
    part = np.searchsorted(ends, at, "right")
    begin = ends - [len(p[3]) for p in parts]
    first, last, base = (np.array([p[k] for p in parts], np.int64) for k in range(3))
    start = at - begin[part] + base[part]
    keep = (start >= first[part]) & (start < last[part])
    at, part, start = at[keep], part[keep], start[keep]
    # the strings of an anchor start in a stretch of equal minima that its reach covers
    new = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    until = np.r_[new[1:], len(low)] - 1
    run = np.searchsorted(until, at, "right") - 1  # no later stretch ends in its reach
    run = np.minimum(np.maximum(run, 0) + 1, len(new) - 1)  # but its own may end behind it
    wrong = np.flatnonzero(low[new[run]] != h[at])
    while len(wrong):
        run[wrong] -= 1
        wrong = wrong[low[new[run[wrong]]] != h[at[wrong]]]
    before = at - np.maximum(new[run], at - BEFORE)
    behind = np.minimum(until[run], at) + LENGTH - at
    context = (upto[at + behind] - upto[at - before]) * inverse[at - before]
    context ^= context >> np.uint64(31)
    context = context * np.uint64(0xBF58476D1CE4E5B9) + (before * 128 + behind).astype(np.uint64)
    return part, start, h[at], context, before, behind


def _runs(starts, ends):
    """numpy: the unions of spans, sorted."""
    import numpy as np

    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order]) if len(ends) else ends
    new = np.r_[True, starts[1:] > ends[:-1]] if len(starts) else np.empty(0, bool)
    return starts[new], ends[np.r_[new[1:], True]] if len(starts) else ends


ANCHORS = "hot int, gram long, context long, at long, before int, behind int"
_ANCHOR_NAMES = ["hot", "gram", "context", "at", "before", "behind"]


def _rows(hot, gram, context, at, before, behind) -> pa.RecordBatch:
    import numpy as np

    long = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
    short = lambda x: pa.array(np.asarray(x, np.int32))
    return pa.record_batch(
        [short(hot), long(gram), long(context), long(at), short(before), short(behind)], _ANCHOR_NAMES
    )


def _find(bits: int):
    """Anchors of Arrow batches of (doc_id, text bytes), folded where a batch repeats a context.

    hot: 0 or 1 for a first occurrence in its batch, MARK for the notice that an anchor is hot, 2 for a span to remove
    (from `at`, `before` bytes to the left to `behind` bytes to the right).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        parts: list[tuple] = []
        owners: list[int] = []
        found: list[tuple] = []

        def hash_parts():
            part, start, *rest = _anchors(parts)
            found.append(((np.array(owners, np.int64)[part] << bits) + start, *rest))
            parts.clear()
            owners.clear()

        for batch in batches:
            size = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = memoryview(text.as_buffer())
                n = len(text)
                if n < LENGTH:
                    continue
                for first in range(0, n - GRAM + 1, SLICE):
                    last = min(first + SLICE, n - GRAM + 1)
                    begin = max(0, first - BEFORE)
                    parts.append((first, last, begin, bytes(text[begin : min(n, last + LENGTH)])))
                    owners.append(doc_id)
                    size += last - first
                    if size >= SLICE:
                        hash_parts()
                        size = 0
                if sum(len(f[0]) for f in found) >= FOLDED:
                    yield from _fold(found)
                    found.clear()
            if parts:
                hash_parts()
            if found:
                yield from _fold(found)
                found.clear()

    return run


def _fold(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Anchors with repeated contexts folded; what is behind an equal one as spans."""
    import numpy as np

    at, gram, context, before, behind = map(np.concatenate, zip(*found))
    order = np.lexsort((at, context, gram))
    at, gram, context, before, behind = (x[order] for x in (at, gram, context, before, behind))
    other = np.r_[True, (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])] if len(at) else np.empty(0, bool)
    # equal positions (repeated ids) are no earlier ones
    first = np.maximum.accumulate(np.where(other, np.arange(len(at)), 0)) if len(at) else np.empty(0, np.int64)
    gone = at > at[first]
    starts, ends = _runs(at[gone] - before[gone], at[gone] + behind[gone])
    if len(starts):
        yield _rows(np.full(len(starts), 2), starts * 0, starts * 0, starts, starts * 0, ends - starts)
    gram, context, at, before, behind = (x[other] for x in (gram, context, at, before, behind))
    if not len(at):
        return
    group = np.cumsum(np.r_[True, gram[1:] != gram[:-1]]) - 1
    hot = (np.bincount(group) > HOT)[group].astype(np.int32)
    yield _rows(hot, gram, context, at, before, behind)
    marks = np.unique(gram[hot == 1])
    if len(marks):
        none = np.zeros(len(marks), np.int64)
        yield _rows(none + MARK, marks, none, none, none, none)


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by (gram, context, at): spans to remove (hot 2) and contexts left undecided (hot 0 or 1).

    Of the running anchor the first rows of at most TOGETHER contexts are held; with more it is hot and its rows
    pass on as they come.
    """
    import numpy as np

    held: list[tuple] = []  # arrays (gram, context, at, before, behind) of first rows of the running anchor
    count = 0  # how many they are
    last_gram = last_context = None
    hot_gram = False
    first_at = 0

    def finished():
        """The rows of the running anchor, if it has several contexts."""
        if count > 1 or (count and hot_gram):
            rows = tuple(map(np.concatenate, zip(*held)))
            yield _rows(np.full(count, int(hot_gram)), *rows)

    for batch in batches:
        hot, gram, context, at, before, behind = (batch.column(k).to_numpy() for k in range(6))
        ready = hot == 2
        if ready.any():
            yield batch.filter(pa.array(ready))
            hot, gram, context, at, before, behind = (x[~ready] for x in (hot, gram, context, at, before, behind))
        if not len(gram):
            continue
        new_gram = np.r_[gram[0] != last_gram, gram[1:] != gram[:-1]]
        new_context = new_gram | np.r_[context[0] != last_context, context[1:] != context[:-1]]
        real = hot != MARK
        # a mark sorts among the contexts of its anchor; what follows it counts as a first again, which only leaves more undecided
        firsts = real & (new_context | np.r_[False, ~real[:-1]])
        lead = np.maximum.accumulate(np.where(firsts, np.arange(len(gram)), -1))
        gone = real & ~firsts & (at > np.where(lead >= 0, at[np.maximum(lead, 0)], first_at))
        if gone.any():
            yield _rows(np.full(int(gone.sum()), 2), gram[gone], context[gone], at[gone], before[gone], behind[gone])
        starts = np.flatnonzero(new_gram)
        if len(starts) and starts[0] == 0 or last_gram is None:
            yield from finished()
            held, count, hot_gram = [], 0, False
        else:
            starts = np.r_[0, starts]  # rows of the anchor of the batch before come first
        if len(starts) > 1 and not (starts[0] == 0 and new_gram[0]):
            # the running anchor ends in this batch
            s, e = 0, starts[1]
            mine = np.flatnonzero(firsts[s:e])
            held.append(tuple(x[s:e][mine] for x in (gram, context, at, before, behind)))
            count += len(mine)
            hot_gram = hot_gram or bool(((hot[s:e] == 1) | ~real[s:e]).any()) or count > TOGETHER
            yield from finished()
            held, count, hot_gram = [], 0, False
            starts = starts[1:]
        tail = int(starts[-1])  # the anchor that may go on in the next batch
        group = np.cumsum(np.r_[True, gram[1:tail] != gram[: tail - 1]]) - 1 if tail else np.empty(0, np.int64)
        if tail:
            begin = int(starts[0])
            contexts = np.bincount(group, firsts[:tail])
            marked = np.bincount(group, ~real[:tail] | (hot[:tail] == 1)) > 0
            marked |= contexts > TOGETHER
            left = firsts[:tail] & ((contexts > 1) | marked)[group]
            left[:begin] = False  # of the anchor that has just ended
            if left.any():
                k = np.flatnonzero(left)
                yield _rows(marked[group[k]].astype(np.int64), gram[k], context[k], at[k], before[k], behind[k])
        mine = tail + np.flatnonzero(firsts[tail:])
        held.append(tuple(x[mine] for x in (gram, context, at, before, behind)))
        count += len(mine)
        hot_gram = hot_gram or bool(((hot[tail:] == 1) | ~real[tail:]).any()) or count > TOGETHER
        if hot_gram:
            yield from finished()
            held, count = [], 0
        last_gram, last_context = gram[-1], (context[-1] if real[-1] else None)
        if lead[-1] >= 0:
            first_at = at[lead[-1]]
    yield from finished()


def _ranks(x):
    """numpy: dense ranks."""
    import numpy as np

    order = np.argsort(x)
    sorted_ = x[order]
    out = np.empty(len(x), np.int64)
    out[order] = np.cumsum(np.r_[False, sorted_[1:] != sorted_[:-1]]) if len(x) else 0
    return out


def _triples(a, b, c):
    """numpy: dense ranks of triples of dense ranks; as one number each where they are below 2^21."""
    if max(a.max(initial=0), b.max(initial=0), c.max(initial=0)) < 1 << 21:
        return _ranks((a << 42) | (b << 21) | c)
    return _ranks((_ranks((a << 32) | b) << 32) | c)


def order_suffixes(text, need: int):
    """numpy: all positions of `text` (bytes, with `need` + 300 zeros behind) in the order of their first `need` bytes or more.

    Difference cover {1, 2} modulo 3. Names are dense ranks; three of them are sorted as one number.
    """
    import numpy as np

    n = len(text) - need - 300
    word = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | text[k : len(text) - 7 + k]
    name = _ranks(word)  # eight bytes each
    sample = np.flatnonzero(np.arange(len(name)) % 3 != 0)
    depth, step = 8, 8
    while True:
        # sort sampled triples, name them by rank; names of other positions are never asked for after the first round
        at = sample[sample + 2 * step < len(name)]
        rank = _triples(name[at], name[at + step], name[at + 2 * step])
        name = np.zeros(len(name), np.int64)
        name[at] = rank + 1
        depth, step = 3 * depth, 3 * depth
        if depth > need + 2:
            break
    one, two, rest = (np.arange(k, n, 3) for k in (1, 2, 0))
    byte = text.astype(np.int64)
    # positions 0 modulo 3: by a byte and the rank behind it
    by1 = lambda p: (byte[p] << 32) | name[p + 1]
    by2 = lambda p: (byte[p] << 40) | (byte[p + 1] << 32) | name[p + 2]
    rest = rest[np.argsort(by1(rest))]
    one, two = one[np.argsort(name[one])], two[np.argsort(name[two])]
    cover = np.concatenate([one, two])
    cover = cover[np.argsort(name[cover], kind="stable")]
    # merge: how many of the cover stand before each of the rest
    ahead = np.searchsorted(by1(one), by1(rest), "left") + np.searchsorted(by2(two), by2(rest), "left")
    ahead = np.maximum.accumulate(ahead)  # equals beyond the depth may stand either way
    out = np.empty(n, np.int64)
    spot = np.arange(len(rest)) + ahead
    free = np.ones(n, bool)
    out[spot], free[spot] = rest, False
    out[free] = cover
    return out


def repeated(contexts: list[bytes], anchors, at):
    """numpy: (start, end) of the strings of several contexts that also stand earlier among them.

    anchors: where in its context each anchor stands; at: the position of the anchor in the corpus.
    """
    import numpy as np

    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(sizes) - sizes
    text = np.frombuffer(b"".join(contexts) + bytes(LENGTH + 300), np.uint8)
    owner = np.repeat(np.arange(len(contexts)), sizes)
    offset = np.arange(len(owner)) - begin[owner]
    starts = (offset <= anchors[owner]) & (offset + LENGTH <= sizes[owner])  # strings that hold the anchor
    order = order_suffixes(text, LENGTH)
    order = order[starts[order]]
    same = np.ones(max(0, len(order) - 1), bool)
    wide = np.zeros(len(text) - 7, np.uint64)
    for k in range(8):
        wide = (wide << np.uint64(8)) | text[k : len(text) - 7 + k]
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:  # compare neighbours
        some = np.flatnonzero(same)
        same[some] = wide[order[some] + k] == wide[order[some + 1] + k]
    where = at[owner[order]] + offset[order] - anchors[owner[order]]
    run = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.empty(0, np.int64)
    earliest = np.minimum.reduceat(where, run) if len(run) else where
    gone = where > np.repeat(earliest, np.diff(np.r_[run, len(order)]))
    spots = np.unique(where[gone])
    return _runs(spots, spots + LENGTH)


SPANS = "start long, end long"


def _longs(names: list[str], *columns) -> pa.RecordBatch:
    import numpy as np

    return pa.record_batch([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns], names)


def _sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hot, gram, at, before, bytes) sorted by gram, none of them hot, to spans.

    Whole anchors are sorted together, several at a time.
    """
    import numpy as np

    held: list[tuple] = []
    last = None

    def flush():
        spans = repeated([h[1] for h in held], np.array([h[2] for h in held]), np.array([h[0] for h in held]))
        held.clear()
        return _longs(["start", "end"], *spans)

    for batch in batches:
        for _, gram, at, before, context in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if len(held) >= 3_000 and gram != last:
                yield flush()
            held.append((at, context, before))
            last = gram
    if held:
        yield flush()


SIDES = "gram long, at long, before int, bytes binary, reach int"


def _agreement(behind: bool):
    """Rows (gram, at, before, bytes, reach) sorted by gram and one side of the anchor: how far each agrees there with
    a neighbour. All are taken to agree at the rims of a partition. reach: before the anchor below 256, behind it above.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def side(row) -> bytes:
            return row["bytes"][row["before"] + GRAM :] if behind else row["bytes"][: row["before"]][::-1]

        def measured(rows: list[dict], own: slice) -> pa.RecordBatch:
            text = np.zeros((len(rows), BEFORE), np.uint8)
            size = np.zeros(len(rows), np.int64)
            for k, row in enumerate(rows):
                part = side(row)[:BEFORE]
                text[k, : len(part)], size[k] = np.frombuffer(part, np.uint8), len(part)
            gram = np.array([r["gram"] for r in rows])
            same = np.logical_and.accumulate(text[1:] == text[:-1], axis=1).sum(axis=1)
            same = np.minimum(same, np.minimum(size[1:], size[:-1])) * (gram[1:] == gram[:-1])
            far = np.maximum(np.r_[BEFORE, same], np.r_[same, BEFORE])  # the rims agree with all
            out = [r | {"reach": r["reach"] + int(f) * (256 if behind else 1)} for r, f in zip(rows[own], far[own])]
            return pa.RecordBatch.from_pylist(out, schema)

        schema = pa.schema([("gram", pa.int64()), ("at", pa.int64()), ("before", pa.int32()), ("bytes", pa.binary()), ("reach", pa.int32())])
        held: list[dict] = []  # the last two rows: one to compare with, one still to be measured
        done = 0  # how many of the held rows have left
        for batch in batches:
            held += batch.to_pylist()
            if len(held) > 2:
                yield measured(held, slice(done, len(held) - 1))
                held, done = held[-2:], 1
        if held:
            yield measured(held, slice(done, None))

    return run


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of hot anchors to their strings (a, b: 128 bits of hash; at: start) within both bounds."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            rows = batch.slice(at, 2000).to_pydict()
            yield _longs(["a", "b", "at"], *_strings(list(zip(rows["at"], rows["bytes"], rows["before"], rows["reach"]))))


def _strings(rows: list[tuple]):
    """numpy: (hash, other hash, start) of the strings of some contexts."""
    import numpy as np

    contexts = [r[1] for r in rows]
    sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
    begin = np.cumsum(sizes) - sizes
    data = np.frombuffer(b"".join(contexts), np.uint8)
    owner = np.repeat(np.arange(len(rows)), sizes)
    offset = np.arange(len(owner)) - begin[owner]
    at, before, reach = (np.array([r[k] for r in rows], np.int64) for k in (0, 2, 3))
    ahead = before[owner] - offset  # bytes of the string before the anchor
    inside = (ahead >= 0) & (offset + LENGTH <= sizes[owner])
    spots = np.flatnonzero(inside & (ahead <= (reach % 256)[owner]) & (BEFORE - ahead <= (reach // 256)[owner]))
    values, power, inverse = _constants(max(len(data), 2 * SLICE))
    both = []
    for v in values:
        upto = np.concatenate(([np.uint64(0)], np.cumsum(v[data] * power[: len(data)])))
        both.append((upto[spots + LENGTH] - upto[spots]) * inverse[spots])
    return *both, at[owner[spots]] + offset[spots] - before[owner[spots]]


def _contexts(bits: int):
    """Rows (doc_id, text, wanted) to rows (hot, gram, at, before, bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["hot", "gram", "at", "before", "bytes"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows = []
            for text, wanted in zip(batch.column(1), batch.column(2).to_pylist()):
                text = memoryview(text.as_buffer())
                for w in wanted:
                    k = w["at"] & ((1 << bits) - 1)
                    part = bytes(text[k - w["before"] : k + w["behind"]])
                    rows.append((w["hot"], w["gram"], w["at"], w["before"], part))
                if len(rows) >= 10_000:
                    yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)
                    rows = []
            if rows:
                yield pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows), kinds)], names)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, spans) to what is left of each text."""
    import hashlib

    import numpy as np

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    for batch in batches:
        rows = []
        for doc_id, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text = memoryview(text.as_buffer())
            starts = np.array([s["start"] for s in spans or []], np.int64)
            ends = np.array([s["end"] for s in spans or []], np.int64)
            starts, ends = _runs(starts, ends)
            digest, at = hashlib.sha256(), 0
            for s, e in zip(starts.tolist(), ends.tolist()):
                digest.update(text[at:s])
                at = e
            digest.update(text[at:])
            rows.append((doc_id, len(text), int((ends - starts).sum()), len(starts), digest.hexdigest()))
        kinds = [pa.int64()] * 4 + [pa.string()]
        yield pa.record_batch([pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], names)


def removed_spans(docs: DataFrame, bits: int) -> DataFrame:
    """(doc_id, start, end) of bytes to remove, overlapping, from rows (doc_id, text) with binary text."""
    spark = docs.sparkSession
    home = F.when(F.col("hot") == 1, F.col("context")).when(F.col("hot") == 2, F.col("at")).otherwise(F.col("gram"))
    decided = written(
        docs.mapInArrow(_find(bits), ANCHORS)
        .repartition(home)
        .sortWithinPartitions("gram", "context", "at")
        .mapInArrow(_decide, ANCHORS),
        "suffix-contexts",
    )
    release(spark)
    doc = F.shiftright("at", bits).alias("doc_id")
    wanted = (
        decided.where("hot < 2")
        .groupBy(doc)
        .agg(F.collect_list(F.struct("hot", "gram", "at", "before", "behind")).alias("wanted"))
    )
    contexts = written(
        docs.join(wanted, "doc_id").mapInArrow(
            _contexts(bits), "hot int, gram long, at long, before int, bytes binary"
        ),
        "suffix-texts",
    )
    release(spark)
    sorted_ = (
        contexts.where("hot = 0").repartition("gram").sortWithinPartitions("gram").mapInArrow(_sort, SPANS)
    )
    hot = contexts.where("hot = 1").select("gram", "at", "before", "bytes", F.lit(0).alias("reach"))
    for behind in (False, True):
        side = (
            F.expr(f"substring(bytes, before + {GRAM + 1})")
            if behind
            else F.reverse(F.hex(F.expr("substring(bytes, 1, before)")))
        )
        # digits of bytes read backwards order them as well as bytes do: equal ends stand together
        hot = written(
            hot.repartitionByRange("gram", side)
            .sortWithinPartitions("gram", side)
            .mapInArrow(_agreement(behind), SIDES),
            "suffix-sides",
        )
    strings = written(hot.mapInArrow(_compared, "a long, b long, at long"), "suffix-strings")
    earliest = strings.groupBy("a", "b").agg(F.min("at").alias("low"))
    late = strings.join(earliest, ["a", "b"]).where("at > low").select(
        F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end")
    )
    whole = decided.where("hot = 2").select(
        (F.col("at") - F.col("before")).alias("start"), (F.col("at") + F.col("behind")).alias("end")
    )
    everything = written(whole.unionByName(sorted_).unionByName(late), "suffix-spans")
    release(spark)
    doc = F.shiftright("start", bits)
    base = F.shiftleft(doc, bits)
    return everything.select(
        doc.alias("doc_id"), (F.col("start") - base).alias("start"), (F.col("end") - base).alias("end")
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""
    text = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )
    size = text.agg(
        F.max(F.length("text")).alias("longest"), F.max(F.abs("doc_id")).alias("widest")
    ).first()
    bits = max(8, int(size["longest"] or 0).bit_length())
    if int(size["widest"] or 0).bit_length() + bits > 62:
        raise ValueError("ids and lengths must fit 63 bits together")
    null = -(1 << (62 - bits))  # before all others
    keyed = text.withColumn("doc_id", F.coalesce("doc_id", F.lit(null)))
    spans = (
        removed_spans(keyed, bits)
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    )
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        keyed.join(spans, "doc_id", "left")
        .mapInArrow(_cut, schema)
        .withColumn("doc_id", F.when(F.col("doc_id") != null, F.col("doc_id")))
    )


def query(spark, folder: str) -> DataFrame:
    return deduplicated(table(spark, folder, "documents"))
