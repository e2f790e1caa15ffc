"""Rows with what operators must stand: nulls in any column, empty, blank and long texts, ties, repeated rows, clashing columns."""

import random

WORDS = "the of and to in is that for it was on are as with be by at from his they have this or had not but what all were when".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; their values must not matter.
CLASH = {"size": 7, "kept": True, "component": 1, "sha": "x", "node": 3, "label": 4, "score": 0.5, "rep": 9, "own": 1, "ids": 1, "n_tokens": "n", "Round_Trip": 2, "__id": 3, "__row": 5, "__score": 0.1, "__copies": 6, "a b": 1}


def prose(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(["", "er", "ing", "ly", ""]) for _ in range(n))


def edited(text: str, edits: int, seed: int) -> str:
    r, words = random.Random(seed), text.split()
    for _ in range(edits):
        words[r.randrange(len(words))] = r.choice(WORDS) + "x"
    return " ".join(words)


def documents() -> list[tuple]:
    base = [prose(120, k) for k in range(12)]
    rows = [(k, t, "en", f"src{k % 4}", len(t)) for k, t in enumerate(base)]
    for k in range(12):  # near copies of several grades, exact copies, copies that differ in white space only
        rows.append((100 + k, edited(base[k % 4], 1 + k, k), "en", f"src{k % 5}", 0))
    rows += [(200 + k, base[0], "en", "src9", 0) for k in range(5)] + [(300, base[0].replace(" ", "\n  "), "de", None, None), (301, base[5] + " ", None, "src1", 1)]
    rows += [(400, "", "en", "src1", 0), (401, None, None, None, None), (402, " \n\t ", "en", "src2", 3), (403, "one", "en", "src2", 3), (404, "one two", "en", "src3", 7), (405, "ONE  two", "en", "src3", 8)]
    rows += [(500, prose(20_000, 77), "en", "src0", 0), (501, "x" * 50_000, "en", "src0", 0), (502, "é漢𝔘   ü", "fr", "src1", 9), (None, "an id is missing here and there", "en", "src1", 5)]
    return rows + [rows[3], rows[3]]


def frame(spark, rows=None, clash: bool = True):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(documents() if rows is None else rows, DOCS).repartition(3)
    return df.withColumns({k: F.lit(v) for k, v in CLASH.items()}) if clash else df


def empty(spark):
    return spark.createDataFrame([], DOCS)
