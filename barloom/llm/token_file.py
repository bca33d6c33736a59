"""Token ids as compressed binary files: canonical length-limited Huffman coding.

Writing takes two passes. Texts are tokenized and counted once, into a table of raw ids. The global counts (one
number per vocabulary entry) give code lengths of at most `LIMIT` bits by package-merge; canonical codes follow from the
lengths alone. Documents are range-sorted by id and coded in blocks.

The format. A folder `code` holds (token, bits): the lengths. A folder `blocks` holds one row per
block in Spark's own container, so writing is committed by task and survives a lost executor:

* part, block: the block's place; blocks follow one another by (part, block);
* doc_ids, lengths: the block's documents and their numbers of ids (little-endian 64-bit);
* checkpoints: the bit offset of every `EVERY`-th id of the block (little-endian 64-bit);
* payload: the codes, most significant bit first, in big-endian 32-bit words.

A block holds whole documents and closes at `BLOCK` ids, so blocks are decoded independently. The
decoder looks `LIMIT` bits up in a table; all checkpoints of a batch advance together, one id a step.

Nulls and odd input: a null or empty text is the end id alone; rows that repeat an id are kept, a null id comes
first; a table with one distinct id uses one bit each; an empty table writes no blocks; other columns are ignored.
"""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import ranges, table, texts, worker_cache
from barloom.storage import shared_folder, written

END = 2
LIMIT = 16  # bits of the longest code, or more where the vocabulary needs it
BLOCK = 1 << 16  # ids after which a block closes
EVERY = 512  # ids between checkpoints
VOCABULARY = "word_bpe_49k.json"
CACHE = 400_000  # words a worker remembers before it drops those met once


class WordEncoder:
    """A word-level tokenizer that remembers the words it has met.

    The vocabulary's tokens never reach over white space, so a text's ids are those of its words in
    turn. Nor do they reach from a letter to a sign, so a space between both changes nothing and tells a word from the signs around it; an
    apostrophe may begin a token that ends with a letter and stays where it is. A vocabulary may ignore the case of A-Z. All this
    is done to a whole batch of texts at once, as bytes, and leaves far fewer different words.

    New words are encoded many at a time, as one line. Letters alone make one token sequence, closed by an
    end-of-word id, which tells words apart. Such words of small Latin letters (`PLAIN`) need neither the tokenizer's normalization nor its search
    for words, only its model. Signs behind other letters are a sequence of their own; such words are put together from the ids of
    the bare word and of the signs. Other words have a mark between them that no other text encodes to, and words that hold the
    mark itself go one by one.
    """

    MARK = "\ue000"
    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # a-z and the small letters of Latin-1, in UTF-8

    def __init__(self, name: str) -> None:
        import numpy as np
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = True
        model = self.tokenizer.model
        if hasattr(model, "_resize_cache"):  # its own memory of words is of no use to words seen for the first time
            model._resize_cache(0)
        self.mark = self._encode(self.MARK)
        ends = [i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[ends] = True
        letters = string.ascii_uppercase
        self.caseless = all(self._encode(t) == self._encode(t.lower()) for t in (letters, " ".join(letters)))
        signs = string.punctuation.replace("'", "")
        self.apart = self._encode("".join(f"o{s}ó{s}O" for s in signs)) == self._encode("".join(f"o {s} ó {s} O" for s in signs))
        self.letter, self.sign = np.zeros(256, bool), np.zeros(256, bool)
        self.letter[[*string.ascii_letters.encode()]] = True
        self.sign[[*signs.encode()]] = True
        # the model alone, on bytes as the vocabulary shows them
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        self.shown = dict(zip((b for b in range(33, 256) if b not in seen), range(256 + 33, 512)))
        self.model = Tokenizer(model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        small = string.ascii_lowercase + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
        probes = [*small, small, small[::-1], *(a + b for a, b in zip(small, small[1:]))]
        ids = self._encode_model([p.encode() for p in probes])
        self.whole = ids is not None and ids[0].tolist() == self._encode(" ".join(probes))
        self.forget()

    def forget(self) -> None:
        import numpy as np

        self.known: dict[bytes, int] = {}  # by UTF-8
        self.starts, self.flat = np.zeros(1, np.int64), np.empty(0, np.int32)
        self.met = np.empty(0, np.int64)  # how often, since words were last dropped

    def thin(self) -> None:
        """Drop the words met only once, and all if that is not enough."""
        import numpy as np

        stay = self.met > 1
        if stay.sum() > CACHE // 2:
            return self.forget()
        number = np.cumsum(stay) - 1
        self.known = dict(zip([w for w, k in self.known.items() if stay[k]], number[stay].tolist()))
        sizes = np.diff(self.starts)
        self.flat = self.flat[np.repeat(stay, sizes)]
        self.starts = np.concatenate(([0], np.cumsum(sizes[stay])))
        self.met = np.zeros(len(self.known), np.int64)

    def _encode(self, line: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([line], add_special_tokens=False)[0].ids

    def _encode_model(self, words: list[bytes]):
        """As _encode_words, for words of PLAIN; None where they can't be told apart."""
        import numpy as np

        line = b" ".join(words).decode("latin-1")
        line = line if line.isascii() else line.translate(self.shown)
        ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.int64)
        ends = np.flatnonzero(self.closing[ids])
        return (ids, np.diff(ends, prepend=-1)) if len(ends) == len(words) else None

    def _encode_plain(self, words: list[str]):
        """As _encode_words, for words of letters alone."""
        import numpy as np

        ids = np.array(self._encode(" ".join(words)), np.int64)
        ends = np.flatnonzero(self.closing[ids])
        if len(ends) != len(words):
            return self._encode_words(words)
        return ids, np.diff(ends, prepend=-1)

    def _encode_words(self, words: list[str]):
        """numpy: (ids of all words, number of ids of each)."""
        import numpy as np

        if not any(self.MARK in w for w in words):
            ids = np.array(self._encode(f" {self.MARK} ".join([*words, ""])), np.int64)
            hit = np.ones(max(0, len(ids) - len(self.mark) + 1), bool)
            for k, i in enumerate(self.mark):
                hit &= ids[k : k + len(hit)] == i
            at = np.flatnonzero(hit)
            if len(at) == len(words):
                sizes = np.diff(at, prepend=-len(self.mark)) - len(self.mark)
                inside = np.ones(len(ids), bool)
                for k in range(len(self.mark)):
                    inside[at + k] = False
                return ids[inside], sizes
        each = [self._encode(w) for w in words]
        return np.array([i for ids in each for i in ids], np.int64), np.array([*map(len, each)], np.int64)

    def _keep(self, words: list[bytes], flat: list, sizes: list) -> None:
        """Remember new words by their ids, given in parts."""
        import numpy as np

        first = len(self.known)
        self.known.update(zip(words, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, *flat]).astype(np.int32)
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(np.concatenate(sizes))])

    def _bare(self, word: str) -> str | None:
        """The word's letters, without the signs behind them and a capital; None where it is built otherwise."""
        letters = word.rstrip(string.punctuation)
        if not letters.isalpha():
            return None
        # a few letters become a letter and a mark, which would join the signs
        if not letters.isascii() and not unicodedata.normalize("NFC", letters).lower().isalpha():
            return None
        return letters[0].lower() + letters[1:] if self.caseless and letters[0] in string.ascii_uppercase else letters

    def learn(self, words: list[bytes]) -> None:
        """Words that are not known yet, each once."""
        import numpy as np

        if self.whole:
            plain = sorted((w for w in words if self.PLAIN.fullmatch(w)), key=bytes.isascii)
            parts = [self._encode_model(plain[at : at + 2000]) for at in range(0, len(plain), 2000)]
            if parts and all(p is not None for p in parts):
                self._keep(plain, *zip(*parts))
                words = [w for w in words if w not in self.known]
        bare, signs, other, built = {}, {}, {}, []
        for raw in words:
            w = raw.decode()
            letters = self._bare(w)
            if letters is None:
                other[w] = None
                continue
            bare[letters] = None
            if letters != w:
                behind = w[len(letters) :]
                built.append((raw, letters.encode(), behind.encode()))
                if behind:
                    signs[behind] = None
        for some, encode in ((bare, self._encode_plain), (other | signs, self._encode_words)):
            some = [w for w in some if w.encode() not in self.known]
            parts = [encode(some[at : at + 2000]) for at in range(0, len(some), 2000)]
            if parts:
                self._keep([w.encode() for w in some], *zip(*parts))
        if built:
            # two pieces a word, the second of them empty where no signs follow
            piece = np.array([[self.known[a], self.known[b] if b else -1] for _, a, b in built], np.int64).ravel()
            sizes = np.where(piece < 0, 0, self.starts[piece + 1] - self.starts[piece])
            ids = self.flat[np.repeat(self.starts[piece], sizes) + ranges(sizes)]
            self._keep([w for w, _, _ in built], [ids], [sizes.reshape(-1, 2).sum(axis=1)])

    def split(self, texts: list[bytes]) -> list[list[bytes]]:
        """The words of each text, A-Z in lower case where that does not count, signs apart from letters where that does not."""
        import numpy as np

        data = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        if self.caseless and len(data):
            upper = (data >= 65) & (data <= 90)
            # from U+0300 on there are marks, which join capitals other than small letters
            upper[:-1] &= data[1:] < 0xCC
            data = data + (upper.view(np.uint8) << 5)
        if self.apart and len(data):
            letter, sign = self.letter[data], self.sign[data]
            cut = letter[:-1] & sign[1:] | sign[:-1] & letter[1:]
            latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # À to ÿ, but for the signs × and ÷
            cut[1:] |= latin[:-1] & sign[2:]
            cut[:-1] |= sign[:-2] & latin[1:]
            at = np.flatnonzero(cut) + 1
            data = np.insert(data, at, 32)
            ends = ends + np.searchsorted(at, ends, "left")
        raw, upto = data.tobytes(), ends.tolist()
        return [raw[a:b].split() for a, b in zip([0, *upto], upto)]

    def batch(self, lines: list[str], end: int):
        """numpy: (ids of all texts, number of ids of each), each text closed by `end`."""
        from itertools import chain, repeat

        import numpy as np

        if len(self.known) > CACHE:
            self.thin()
        words = self.split([t.encode() for t in lines])
        line = list(chain.from_iterable(words))
        which = np.fromiter(map(self.known.get, line, repeat(-1)), np.int64, len(line))
        missing = np.flatnonzero(which < 0)
        if len(missing):
            self.learn(list(dict.fromkeys(line[k] for k in missing.tolist())))
            which[missing] = [self.known[line[k]] for k in missing.tolist()]
        self.met = np.bincount(which, minlength=len(self.known)) + np.pad(self.met, (0, len(self.known) - len(self.met)))
        # the end id comes as one more word behind each text
        upto = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        which = np.insert(which, upto, len(self.known))
        flat, starts = np.append(self.flat, np.int32(end)), np.append(self.starts, len(self.flat) + 1)
        sizes = starts[which + 1] - starts[which]
        ids = flat[np.repeat(starts[which], sizes) + ranges(sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[upto + np.arange(1, len(upto) + 1)]
        return ids, np.diff(ends, prepend=0)


def width_of(vocabulary: str) -> int:
    """Bytes that hold any id of a vocabulary."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return 2 if Tokenizer.from_file(public_tokenizers.path(vocabulary)).get_vocab_size() <= 1 << 16 else 4


def tokens(docs: DataFrame, width: int, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    """(doc_id, ids, seen): each text's ids and the end id, as little-endian numbers of `width` bytes.

    `seen` is NULL but in one more row behind those of each task, which has no ids: how often every id occurred in the
    task, as little-endian 64-bit pairs (id, number).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kept = worker_cache()
        if vocabulary not in kept:
            kept[vocabulary] = WordEncoder(vocabulary)
        total = np.zeros(0, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                ids, n = kept[vocabulary].batch(some.column(1).to_pylist(), end)
                here = np.bincount(ids, minlength=len(total))
                here[: len(total)] += total
                total = here
                raw = ids.astype(f"<u{width}").tobytes()
                ends = np.concatenate(([0], np.cumsum(n) * width)).tolist()
                parts = [raw[a:b] for a, b in zip(ends, ends[1:])]
                columns = [some.column(0), pa.array(parts, pa.binary()), pa.nulls(some.num_rows, pa.binary())]
                yield pa.record_batch(columns, ["doc_id", "ids", "seen"])
        met = np.flatnonzero(total)
        pairs = np.stack([met, total[met]], axis=1).astype("<i8").tobytes()
        last = [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([pairs], pa.binary())]
        yield pa.record_batch(last, ["doc_id", "ids", "seen"])

    return texts(docs).mapInArrow(run, "doc_id long, ids binary, seen binary")


def counts(raw: DataFrame) -> dict[int, int]:
    """How often each id occurs; at most one number per vocabulary entry. Reads the row of each task alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            pairs = np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8").reshape(-1, 2)
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["token", "n"])

    rows = raw.where("seen IS NOT NULL").select("seen").mapInArrow(run, "token long, n long")
    return {r["token"]: r["n"] for r in rows.groupBy("token").agg(F.sum("n").alias("n")).collect()}


def code_lengths(frequency: dict[int, int], limit: int = LIMIT) -> dict[int, int]:
    """Optimal code lengths of at most `limit` bits, by package-merge."""
    import numpy as np

    if not frequency:
        return {}
    order = sorted(frequency, key=lambda t: (frequency[t], t))
    n = len(order)
    if n == 1:
        return {order[0]: 1}
    limit = max(limit, (n - 1).bit_length())
    single = np.array([frequency[t] for t in order], np.int64)
    levels, previous = [], np.empty(0, np.int64)
    for _ in range(limit):
        pairs = previous[: len(previous) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([single, pairs])
        by = np.argsort(both, kind="stable")
        levels.append(by >= n)  # which of the sorted items are packages
        previous = both[by]
    bits, take = np.zeros(n, np.int64), 2 * n - 2
    for packages in reversed(levels):
        inside = int(packages[:take].sum())
        bits[: take - inside] += 1
        take = 2 * inside
    return dict(zip(order, bits.tolist()))


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, bits) of each token: codes count up by (bits, token)."""
    out, code, last = {}, 0, 0
    for token in sorted(lengths, key=lambda t: (lengths[t], t)):
        code <<= lengths[token] - last
        last = lengths[token]
        out[token] = (code, last)
        code += 1
    return out


def pack(ids, codes, bits):
    """numpy: (payload, checkpoints) of one block; codes and bits by token."""
    import numpy as np

    size = bits[ids]
    ends = np.cumsum(size)
    at = ends - size
    words = int(ends[-1] + 31) // 32 + 1 if len(ids) else 0
    shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    # codes share no bit, so sums of the halves are their unions, exact in doubles
    total = np.bincount(word, (shifted >> np.uint64(32)).astype(np.float64), words)
    total += np.bincount(word + 1, (shifted & np.uint64(2**32 - 1)).astype(np.float64), words)[:words]
    return total.astype(">u4").tobytes(), at[::EVERY].astype("<i8").tobytes()


def unpack(blocks: list[tuple[bytes, bytes, int]], token, bits, limit: int):
    """numpy: the ids of several blocks (payload, checkpoints, number of ids), in turn.

    token, bits: by the next `limit` bits.
    """
    import numpy as np

    data = np.frombuffer(b"".join([p for p, _, _ in blocks]) + bytes(8), np.uint8).astype(np.uint32)
    at4 = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    base = np.cumsum([0] + [len(p) * 8 for p, _, _ in blocks])
    marks = [np.frombuffer(c, "<i8") + b for (_, c, _), b in zip(blocks, base)]
    left = [np.minimum(EVERY, n - EVERY * np.arange(len(m))) for m, (_, _, n) in zip(marks, blocks)]
    position, todo = np.concatenate(marks), np.concatenate(left)
    order = np.argsort(-todo, kind="stable")  # those with fewer ids drop out at the end
    position, todo = position[order], todo[order]
    out = np.zeros((EVERY, len(todo)), np.uint32)
    live = np.searchsorted(-todo, -np.arange(EVERY), "left")  # how many have more than k ids
    down = np.uint32(32 - limit)
    for k in range(EVERY):
        m = live[k]
        if not m:
            break
        p = position[:m]
        look = (at4[p >> 3] << (p & 7).astype(np.uint32)) >> down
        out[k, :m] = token[look]
        position[:m] = p + bits[look]
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    sizes = np.concatenate(left)
    return np.ascontiguousarray(out.T)[back][np.arange(EVERY) < sizes[:, None]]


def write(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END) -> None:
    """Write the token files of `docs` to a folder that all executors share."""
    import numpy as np

    spark = docs.sparkSession
    width = width_of(vocabulary)
    raw = written(tokens(docs, width, vocabulary, end), "token-ids")
    lengths = code_lengths(counts(raw))
    spark.createDataFrame(sorted(lengths.items()), "token long, bits int").coalesce(1).write.parquet(f"{folder}/code")
    book = canonical(lengths)
    top = max(book, default=0) + 1
    codes, bits = np.zeros(top, np.uint64), np.zeros(top, np.int64)
    for t, (c, b) in book.items():
        codes[t], bits[t] = c, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, block, held, size = TaskContext.get().partitionId(), 0, [], 0

        def close():
            ids = np.frombuffer(b"".join([r for _, r in held]), f"<u{width}")
            payload, marks = pack(ids, codes, bits)
            n = np.array([len(r) // width for _, r in held], "<i8").tobytes()
            docs_ = pa.array([[d for d, _ in held]], pa.list_(pa.int64()))
            blob = lambda x: pa.array([x], pa.binary())
            return pa.record_batch(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), docs_, blob(n), blob(marks), blob(payload)],
                ["part", "block", "ids", "doc_ids", "lengths", "checkpoints", "payload"],
            )

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append((doc_id, ids))
                size += len(ids) // width
                if size >= BLOCK:
                    yield close()
                    block, held, size = block + 1, [], 0
        if held:
            yield close()

    documents = raw.where("seen IS NULL").select("doc_id", "ids")
    documents.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(
        run,
        "part int, block int, ids long, doc_ids array<long>, lengths binary, checkpoints binary, payload binary",
    ).write.parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, place, doc_id, before, ids): each document's ids from the files; before: ids of the block before it."""
    import numpy as np

    lengths = {r["token"]: r["bits"] for r in spark.read.parquet(f"{folder}/code").collect()}
    limit = max(lengths.values(), default=1)
    token, bits = np.zeros(1 << limit, np.uint32), np.zeros(1 << limit, np.uint8)
    for t, (c, b) in canonical(lengths).items():
        token[c << (limit - b) : (c + 1) << (limit - b)] = t
        bits[c << (limit - b) : (c + 1) << (limit - b)] = b
    shared = spark.sparkContext.broadcast((token, bits))  # 5 bytes for each of at most 2^LIMIT entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                yield decoded(batch.slice(at, 16))

    def decoded(some: pa.RecordBatch) -> pa.RecordBatch:
        rows = some.to_pydict()
        ids = unpack(list(zip(rows["payload"], rows["checkpoints"], rows["ids"])), *shared.value, limit)
        raw, at, out = ids.astype("<u4").tobytes(), 0, []
        for part, block, doc_ids, sizes in zip(rows["part"], rows["block"], rows["doc_ids"], rows["lengths"]):
            before = 0
            for place, (d, n) in enumerate(zip(doc_ids, np.frombuffer(sizes, "<i8").tolist())):
                out.append((part, block, place, d, before, raw[4 * at : 4 * (at + n)]))
                before, at = before + n, at + n
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
        return pa.record_batch(
            [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
            ["part", "block", "place", "doc_id", "before", "ids"],
        )

    return spark.read.parquet(f"{folder}/blocks").mapInArrow(
        run, "part int, block int, place int, doc_id long, before long, ids binary"
    )


def block_starts(spark: SparkSession, folder: str) -> DataFrame:
    """(part, block, block_start): ids of all blocks before; only one row per part is summed in one place."""
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "ids")
    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_part = parts.select(
        "part", F.coalesce(F.sum("n").over(upto(Window.orderBy("part"))), F.lit(0)).alias("part_start")
    )
    inside = F.coalesce(F.sum("ids").over(upto(Window.partitionBy("part").orderBy("block"))), F.lit(0))
    return blocks.withColumn("inside", inside).join(of_part, "part").select(
        "part", "block", (F.col("part_start") + F.col("inside")).alias("block_start")
    )


def query(spark, folder: str) -> DataFrame:
    files = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write(table(spark, folder, "documents"), files)
    thin = read(spark, files).select(
        "part",
        "block",
        "doc_id",
        "before",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
    return thin.join(block_starts(spark, files), ["part", "block"]).select(
        "doc_id", (F.col("block_start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )
