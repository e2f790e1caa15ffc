"""Text functions: normalisation, exact / near / absent matching, offsets, counts, quotes.

Phrases are constants of the plan, so everything that depends on them alone (their words, edit budgets, empty ones) is
settled on the driver.  Offsets are 0-based with -1 for absent.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .arrays import scan

#: Latin letters that look like Cyrillic ones, folded onto those.
HOMOGLYPHS = str.maketrans("aeopcyx", "аеорсух")
_PUNCTUATION = re.compile(r"[^\w\s]")


def normalise(text: str | None) -> str:
    folded = unicodedata.normalize("NFKC", text or "").casefold().translate(HOMOGLYPHS)
    return " ".join(_PUNCTUATION.sub(" ", folded).split())


@F.pandas_udf(StringType())
def normalise_text(text: pd.Series) -> pd.Series:
    """NFKC and case folding have no built-in; callers materialise this once a text."""
    return text.map(normalise)


def edit_budget(word: str) -> int:
    """Edits allowed in a word: none up to 4 letters, 1 up to 7, 2 beyond."""
    return 0 if len(word) <= 4 else 1 if len(word) <= 7 else 2


def near(tokens: Column, phrase: str) -> Column:
    """Whether some run of tokens equals the normalised phrase word by word, within each word's edit budget."""
    words = phrase.split()

    def fits(i: Column) -> Column:
        tests = [F.get(tokens, i + k) == w if not edit_budget(w) else F.levenshtein(F.get(tokens, i + k), F.lit(w), edit_budget(w)) >= 0 for k, w in enumerate(words)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    enough = F.size(tokens) >= len(words)
    return F.when(enough, F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - len(words))), fits)).otherwise(False)


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def match_status(norm: Column, tokens: Column, phrases: list[str]) -> Column:
    """exact if any phrase is a substring of the normalised text, else near if any nearly is, else absent."""
    wanted = [p for p in map(normalise, phrases) if p]
    return F.when(_any([F.contains(norm, F.lit(p)) for p in wanted]), "exact").when(_any([near(tokens, p) for p in wanted]), "near").otherwise("absent")


def offset(low: Column, needle: str) -> Column:
    return F.instr(low, needle.lower()) - 1


def first_offset(low: Column, phrases: list[str]) -> Column:
    """Smallest offset of any phrase, -1 if none occurs."""
    found = [F.when(F.contains(low, F.lit(p.lower())), offset(low, p)) for p in phrases if p]
    if not found:
        return F.lit(-1)
    return F.coalesce(F.least(*found) if len(found) > 1 else found[0], F.lit(-1))


def occurrences(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences; an empty needle has none."""
    if not needle:
        return F.lit(0)
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def total_occurrences(text: Column, needles: list[str]) -> Column:
    out = F.lit(0).cast("long")
    for n in needles:
        out = out + occurrences(text, n)
    return out


def all_offsets(low: Column, needle: str) -> Column:
    """Offsets of the non-overlapping occurrences, in order: lengths of the parts between them, summed up."""
    parts = F.split(low, re.escape(needle), -1)
    return scan(F.slice(parts, 1, F.size(parts) - 1), F.lit(0), "int", lambda pos, part: (F.array(pos + F.length(part)), pos + F.length(part) + len(needle)))


def count_outside(low: Column, words: list[str], mandated: list[str]) -> Column:
    """Occurrences of ``words`` that do not begin inside an occurrence of a mandated phrase."""
    total = F.lit(0).cast("long")
    for w in (w.lower() for w in words if w):
        if not mandated:
            total = total + occurrences(low, w)
            continue
        total = total + F.size(F.filter(all_offsets(low, w), _not_in(low, mandated)))
    return total


def _not_in(low: Column, mandated: list[str]):
    def test(pos: Column) -> Column:
        held = F.lit(False)
        for m in (m.lower() for m in mandated if m):
            held = held | F.exists(all_offsets(low, m), _covers(pos, len(m)))
        return ~held

    return test


def _covers(pos: Column, size: int):
    return lambda start: (start <= pos) & (pos < start + size)


def quote(text: Column, phrases: list[str], around: int = 40) -> Column:
    """The first phrase of the list that occurs (raw, lower-cased), with up to ``around`` characters on each side."""
    low, tries = F.lower(text), []
    for p in (p for p in phrases if p):
        at = offset(low, p)
        begin = F.greatest(F.lit(0), at - around)
        cut = F.substring(text, begin + 1, at + len(p) + around - begin)
        tries.append(F.when(at >= 0, F.btrim(cut, F.lit(" \t\r\n"))))
    return F.coalesce(*tries) if tries else F.lit(None).cast("string")


def mmss(seconds: Column) -> Column:
    s = F.bround(seconds, 0).cast("long")
    return F.when(F.coalesce(seconds, F.lit(0.0)) > 0, F.format_string("%d:%02d", F.floor(s / 60), s % 60)).otherwise("—")


def parse_json_object(raw: Column) -> Column:
    """The JSON object of a model's answer as text: the whole answer, else a fenced block, else from the first { to the
    last }; null if none of them is an object."""
    fenced = F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(raw, r"(?s)\{.*\}", 0)

    def as_object(x: Column) -> Column:
        v = F.try_parse_json(F.when(F.trim(x) != "", x))
        return F.when(F.schema_of_variant(v).startswith("OBJECT"), F.to_json(v))

    return F.coalesce(*(as_object(x) for x in (raw, fenced, braces)))


def strict_boolean(value: Column) -> Column:
    """true / false as JSON booleans or words; anything else is null (unknown), never true."""
    low = F.lower(F.trim(value.cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def unit_score(value: Column) -> Column:
    """A number in [0, 1], else null."""
    n = value.try_cast("double")
    return F.when(n.between(0.0, 1.0), n)
