"""Packing, mixing and token files against brute force and exact round trips."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barloom.llm import mixing, packing, token_file
from tests.llm import fixtures

ODD = [
    "", " ", "a\n\n b  c\t\t d  x　y  ", "<|endoftext|> x", "it's 'S IT'LL don't we'd.", "\x1c\x1d a b\u0085c  ",
    "日本語テキスト 123²½ Ⅷ", "é ́", "😀👨‍👩‍👧 a​b﻿", "x" * 5000, " " * 300, "\n" * 50 + "a",
    "İstanbul. ΣΑΣ, ΟΔΥΣΣΕΥΣ ǅ ß ẞ a., a.. ., , . a,b. ,a", " ab",
]


def reference(name):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    tokenizer.encode_special_tokens = True
    return lambda t: tokenizer.encode(t or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_both_libraries_give_the_same_ids():
    encode, other = packing.encoder().encode_ordinary, reference("byte_bpe_50k.json")
    for text in ODD + [r[1] or "" for r in fixtures.documents()]:
        assert encode(text) == other(text)


def test_word_encoder_equals_whole_texts(monkeypatch):
    texts = ODD + [r[1] or "" for r in fixtures.documents()]
    encode = reference(token_file.VOCABULARY)
    for cache in (10**6, 1):
        monkeypatch.setattr(token_file, "CACHE", cache)
        encoder = token_file.WordEncoder(token_file.VOCABULARY)
        for part in (texts, texts[::-1]):
            ids, n = encoder.batch(part, 2)
            ends = np.cumsum(n)
            for text, e, k in zip(part, ends, n):
                assert ids[e - k : e].tolist() == [*encode(text), 2]


def test_words_of_letters_and_signs():
    """Random words of letters, capitals, signs, contractions and letters that fall into a letter and a mark."""
    import random

    dice = random.Random(3)
    signs = "abcABZzéÉçßİıΣσς\u0958.,;:!?()*$%&#'’_-<|>0129 \t\n\x1c\u0301ſK中ñÑ"
    pieces = [*signs, "don't", "I'LL", "<|endoftext|>", "A\u0301b", "x's.", "ǅ."]
    encode, encoder = reference(token_file.VOCABULARY), token_file.WordEncoder(token_file.VOCABULARY)
    for _ in range(3):
        texts = ["".join(dice.choices(pieces, k=dice.randrange(60))) for _ in range(1000)]
        ids, n = encoder.batch(texts, 2)
        for text, e, k in zip(texts, np.cumsum(n), n):
            assert ids[e - k : e].tolist() == [*encode(text), 2]


def test_words_are_remembered_without_signs_and_capitals():
    """Signs are told from letters, but for those that mean something together, and case goes where no mark follows."""
    import random

    encode, encoder = reference(token_file.VOCABULARY), token_file.WordEncoder(token_file.VOCABULARY)
    dice = random.Random(4)
    bare = ["".join(dice.choices("abcdefghijklmnoprstuvwzäéñßÿ", k=9)) for _ in range(500)]
    forms = ["{}", "{}.", "{},", '"{}"', "({})", "{}?!", "<{}>", "{}..."]
    text = " ".join(dice.choice(forms).format(w if dice.random() < 0.5 else w.capitalize()) for w in bare * 8)
    odd = "J\u030c, É. É, ÿ. a×. a÷, ×a x'.s x.'s 'S.'s o'.o `a^b~ a=\u0338b ll'll \u00e9\u0301. \u00df\x0b.\x0c\u00a0. \u0142. a\u2026. \u2026.a \u00c3. Ã."
    for part in ([text, odd], [odd, text], [*odd, "", text]):
        ids, n = encoder.batch(part, 2)
        for t, e, k in zip(part, np.cumsum(n), n):
            assert ids[e - k : e].tolist() == [*encode(t), 2]
    first = sum(not w[0].isascii() for w in bare)  # their capitals are words of their own
    assert len(encoder.known) < len(bare) + 2 * first + 100


@pytest.mark.parametrize(
    "histogram",
    [{}, {5: 1}, {1024: 3}, {700: 500}, {700: 10, 100: 3}, {1: 5000}, {600: 1000, 500: 10}, {k: k % 5 for k in range(1, 1025)}],
)
def test_plan_places_every_id_once(histogram):
    histogram = {k: n for k, n in histogram.items() if n}
    cover, packs = defaultdict(list), defaultdict(list)
    for length, first, end, start, part, sequence, offset in packing.plan(histogram):
        for rank in range(first, end):
            cover[length, rank].append((start, part))
            packs[sequence + rank - first].append((offset, part))
    assert set(cover) == {(k, r) for k, n in histogram.items() for r in range(n)}
    for (length, _), parts in cover.items():
        assert [s for s, _ in sorted(parts)] == np.cumsum([0] + [p for _, p in sorted(parts)])[:-1].tolist()
        assert sum(p for _, p in parts) == length
    padding = 0
    for parts in packs.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0] + [p for _, p in parts])[:-1].tolist()
        total = sum(p for _, p in parts)
        assert total <= 1024
        padding += 1024 - total
    total = sum(k * n for k, n in histogram.items())
    assert padding <= 1024 + 0.005 * total


def test_plan_does_not_grow_with_counts():
    assert len(packing.plan({k: 10**9 + k for k in range(1, 1025)})) < 20_000
    assert len(packing.plan({100: 10**10})) < 5000


def test_packed_documents(spark):
    rows = list({r[0]: r for r in fixtures.documents()}.values())
    encode = reference("byte_bpe_50k.json")
    ids = {r[0]: [*encode(r[1]), 0] for r in rows}
    found = packing.packed(fixtures.frame(spark, rows, extra=True)).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for doc_id, parts in by_doc.items():
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc_id])
            assert r["ids_crc32"] == crc(ids[doc_id][at : at + r["length"]])
            at += r["length"]
        assert at == len(ids[doc_id])
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.packed(fixtures.empty(spark)).count() == 0
    assert packing.packed(fixtures.frame(spark, rows[:3] * 2)).count() >= 6  # repeated rows


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "BLOCK", 700)
    rows = fixtures.documents()
    encode = reference(token_file.VOCABULARY)
    folder = str(tmp_path / "files")
    token_file.write(fixtures.frame(spark, rows, extra=True), folder)
    found = token_file.read(spark, folder).join(token_file.block_starts(spark, folder), ["part", "block"]).collect()
    found.sort(key=lambda r: (r["part"], r["block"], r["place"]))
    at = 0
    for r in found:
        assert r["block_start"] + r["before"] == at
        at += len(r["ids"]) // 4
    assert [r["doc_id"] for r in found] == sorted(r[0] for r in rows)
    assert sorted((r["doc_id"], zlib.crc32(r["ids"])) for r in found) == sorted((r[0], crc([*encode(r[1]), 2])) for r in rows)


@pytest.mark.parametrize("texts", [[], ["", None]])
def test_token_files_of_little(spark, tmp_path, texts):
    folder = str(tmp_path / "files")
    docs = fixtures.frame(spark, [(k, t, "en", "s", 0) for k, t in enumerate(texts)])
    token_file.write(docs, folder)
    assert [r["ids"] for r in token_file.read(spark, folder).collect()] == [b"\2\0\0\0"] * len(texts)


def test_token_files_of_null_and_repeated_ids(spark, tmp_path):
    texts = [(7, "seven"), (None, "no id"), (7, "seven"), (7, "other"), (None, None), (-1, "first of the ids")]
    folder, encode = str(tmp_path / "files"), reference(token_file.VOCABULARY)
    token_file.write(fixtures.frame(spark, [(d, t, "en", "s", 0) for d, t in texts]), folder)
    found = token_file.read(spark, folder).collect()
    found.sort(key=lambda r: (r["part"], r["block"], r["place"]))
    assert [r["doc_id"] for r in found] == [None, None, -1, 7, 7, 7]
    want = sorted((d is not None, d or 0, crc([*encode(t), 2])) for d, t in texts)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(r["ids"])) for r in found) == want


def test_code_lengths_are_limited_and_optimal():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    frequency = dict(enumerate(fibonacci))
    free, tight = token_file.code_lengths(frequency, 40), token_file.code_lengths(frequency, 8)
    assert max(free.values()) == 29 and max(tight.values()) == 8
    for lengths in (free, tight):
        assert sum(2.0**-b for b in lengths.values()) == 1
    cost = lambda x: sum(frequency[t] * b for t, b in x.items())
    import heapq

    heap, huffman = list(frequency.values()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        huffman += both
        heapq.heappush(heap, both)
    assert cost(free) == huffman <= cost(tight)
    codes = [f"{c:0{b}b}" for c, b in token_file.canonical(tight).values()]
    assert not any(x != y and y.startswith(x) for x in codes for y in codes)


def mix_model(rows, weights=(1, 2, 3), epochs=3):
    import hashlib

    size = lambda t: len((t or "").split())
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(r[1]) for r in rows if r[3] == s) for s in sources}
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    goal, open_, left = {}, set(sources), sum(total.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > epochs * total[s]}
        if not full:
            goal.update(share)
            break
        for s in full:
            goal[s] = epochs * total[s]
            left -= goal[s]
        open_ -= full
    order = lambda r: (hashlib.md5(f"mix:{r[0]}".encode()).hexdigest(), size(r[1]))
    copies = []
    for no, s in enumerate(sources):
        sent = 0
        for r in sorted((r for r in rows if r[3] == s), key=order):
            sent += size(r[1])
            if goal[s] > 0 and size(r[1]):
                copies += [((total[s] * e + sent) / goal[s], no, sent, e, r) for e in range(epochs)]
    taken, spent = defaultdict(int), 0
    for c in sorted((c for c in copies if c[0] <= 2), key=lambda c: c[:4]):
        spent += size(c[4][1])
        if spent > sum(total.values()):
            break
        taken[c[4][0]] += size(c[4][1])
    return {r[0]: (size(r[1]), total[r[3]], round(goal[r[3]], 6), taken[r[0]]) for r in rows}


def test_mix(spark):
    rows = list({r[0]: r for r in fixtures.documents()}.values())
    docs = fixtures.frame(spark, rows, extra=True)
    got = mixing.mix(docs, ["doc_id"]).collect()
    assert {r["doc_id"]: (r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got} == mix_model(rows)
    assert all(r["taken"] <= 3 * r["size"] for r in got)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.count() == sum(r["copies"] for r in got)


def test_mix_odd_input(spark):
    assert mixing.mix(fixtures.empty(spark), ["doc_id"]).count() == 0
    rows = fixtures.documents()
    assert mixing.mix(fixtures.frame(spark, rows), ["doc_id"]).count() == len(rows)
    silent = [(1, None, "en", None, 0), (2, "", "en", "a", 0)]
    assert [r["taken"] for r in mixing.mix(fixtures.frame(spark, silent), ["doc_id"]).collect()] == [0, 0]


def test_no_python_in_the_mix(spark):
    plan = mixing.mix(fixtures.frame(spark, fixtures.documents()), ["doc_id"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
