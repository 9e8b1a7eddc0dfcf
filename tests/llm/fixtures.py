"""Small tables for the operators' tests."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
AWKWARD = "doc_id long, text string, lang string, source string, n_chars long, epoch string, TOKENS long, gone string, spans string, keep string"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    words = [f"w{min(int(rng.paretovariate(0.6)), vocabulary) if rng.random() < 0.5 else rng.randrange(vocabulary)}" for _ in range(n)]
    out, at = [], 0
    while at < n:
        size = rng.randint(4, 12)
        out.append(" ".join(words[at : at + size]).capitalize() + ".")
        at += size
    return "\n".join(" ".join(out[i : i + 3]) for i in range(0, len(out), 3))


def awkward(spark, n: int = 40, seed: int = 1):
    """Nulls in every column, empty, blank and long texts, repeats, clashing names."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(1, 200)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), 1) for i in range(n)]
    rows += [(None, prose(rng, 60), "en", "a", 1), (None, None, None, None, None), (100, "", "en", "a", 0), (101, " \n\t ", "en", "b", 3), (102, None, "en", "b", None), (103, "!", "en", None, 1)]
    rows += [(104, prose(rng, 30_000), "en", "a", 1), (105, "word " * 5000, "en", "a", 1), (106, "x" * 100_000, "de", "b", 1), (107, "é" * 300 + "\n" + "日本語。" * 50, None, "b", 1)]
    rows += [rows[0], rows[0], (1, prose(rng, 80), "en", "a", 1)]
    return spark.createDataFrame([(*r, "e", 7, None, "s", "k") for r in rows], AWKWARD)


def empty(spark):
    return spark.createDataFrame([], AWKWARD)
