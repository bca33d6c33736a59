"""Small tables with the cases every operator must survive."""

from __future__ import annotations

import random

WORDS = "the of and to harbour stone river lantern copper meadow winter signal basket thunder violet orchard pepper".split()


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(9))]) for _ in range(words))


def documents(seed: int = 1) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): nulls, empty and long texts, ties, copies, near copies, repeated rows."""
    rng = random.Random(seed)
    texts: list[str | None] = [prose(rng, rng.choice([3, 20, 80, 200])) for _ in range(60)]
    texts += [None, "", "   ", "\n\t", "one", "one two three", "ÄÖÜ ß ñ 日本語 😀", "x" * 3000, "ab" * 400, "\n".join(["same line"] * 30)]
    texts += texts[:12]  # copies
    texts += [t.replace(" ", "\n  ", 3) for t in texts[12:18]]  # equal after normalising
    texts += [t + " once" for t in texts[20:26]]  # near copies
    texts += [prose(rng, 5) + " " + texts[30] + " " + prose(rng, 5) for _ in range(4)]  # a shared passage
    texts.append(prose(rng, 30_000))  # very long
    rows = [(k * 3 + 1, t, "en", None if k % 7 == 3 else f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[5])  # a repeated row
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows: list[tuple], extra: bool = False):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:  # names that the operators use themselves
        for name in ("keep_id", "size", "score", "bucket", "fp", "length", "kept", "__row"):
            df = df.selectExpr("*", f"'x' AS {name}")
    return df


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows: list[tuple]):
    return spark.createDataFrame(
        [(r[0], r[0] % 2, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int"
    )
