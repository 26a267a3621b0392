"""Small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, digest string"


def prose(seed: int, n: int, words: int = 300) -> str:
    r = random.Random(seed)
    return " ".join(f"{r.choice(['Ba', 'co', 'du', 'fé', 'gi', 'ha'])}{r.randrange(words)}" for _ in range(n))


def texts() -> list[str | None]:
    base = [prose(k, 12 + 9 * k) for k in range(14)]
    out: list[str | None] = [None, "", " \t\n", "!!! ***", "a", "A", "one two", "one  TWO", "one two three four five"]
    out += base
    for k in (3, 5, 8, 11, 13):  # near copies: some words changed
        words = base[k].split()
        for change in (1, 3, 9):
            own = list(words)
            for i in range(change):
                own[(7 * i + change) % len(own)] = f"new{i}{change}"
            out.append(" ".join(own))
    passage = prose(99, 55)
    out += [f"{prose(200 + k, 30)} {passage} {prose(300 + k, 25)}" for k in range(6)]
    out += [base[4].upper(), base[4].replace(" ", "  "), base[4] + "\n", base[6], base[6], base[6]]
    out += ["x" * 60_000, prose(7, 9_000), "7" * 30_000, "a@" * 5_000, "a.b" * 8_000 + "@c.d" + ".e" * 8_000, "+1" + "(" * 20_000, "e" * 40_000 + "f0" * 40]
    return out


def rows() -> list[tuple]:
    out = [(i, t, ["en", "fr", None][i % 3], f"src{i % 4}" if i % 7 else None, None, True, "x") for i, t in enumerate(texts())]
    return out + [out[10], out[10], (None, "no id here", None, None, None, None, None)]


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
