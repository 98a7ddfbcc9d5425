"""String similarity on candidate pairs.

Spark has Levenshtein and Soundex but neither an insert/delete ratio nor Metaphone. Metaphone is a fold of substitutions
in column expressions; the ratio runs as an Arrow-batched UDF, only ever on pairs that a join produced.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklore.functions.text import matching_form


def lcs_length(left: str, right: str) -> int:
    """Longest common subsequence, one machine word per 64 characters (bit-parallel)."""
    if not left or not right:
        return 0
    positions: dict[str, int] = {}
    for index, letter in enumerate(left):
        positions[letter] = positions.get(letter, 0) | (1 << index)
    full = (1 << len(left)) - 1
    row = full
    for letter in right:
        hit = row & positions.get(letter, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(left) - row.bit_count()


def indel_similarity(left: str, right: str) -> float:
    total = len(left) + len(right)
    return 1.0 if total == 0 else 2.0 * lcs_length(left, right) / total


# Metaphone (Philips 1990) as substitutions over a text whose words stand between blanks of their own. Small letters are
# still to be coded, capitals and 0 are codes. Neither lookaround nor back references in a pattern, so that Java, Python
# and RE2 (the SQL equivalents) take the same rules. Groups stay small letters, to be coded by a later rule.
METAPHONE_RULES = [
    *((f"{letter}{letter}+", letter) for letter in "abdefghijklmnopqrstuvwxyz"),
    (" [gkp]n", " n"), (" ae", " e"), (" wr", " r"), (" wh", " w"), (" x", " s"), (" thom", " tom"), ("mb ", "m "),
    ("tch", "ch"), ("ti([ao])", "Xi<1>"), ("th", "0"),
    ("cia", "Xia"), ("sch", "SK"), ("ch", "X"), ("sc([iey])", "S<1>"), ("c([iey])", "S<1>"), ("c?k", "K"), ("c+", "K"),
    ("dg([eiy])", "J<1>"), ("d", "T"),
    ("([ao]u)gh ", "<1>F "), ("gh([^aeiou])", "<1>"), ("gh", "K"), ("gn(eT)? ", "n "), ("g([iey])", "J<1>"), ("g", "K"),
    ("ph", "F"), ("sh", "X"), ("([aeiou])h([^aeiou])", "<1><2>"),
    ("si([ao])", "Xi<1>"), ("x", "KS"), ("w([aeiou])", "W<1>"), ("w", ""), ("y([aeiou])", "Y<1>"), ("y", ""),
    *((f" {vowel}", f" {vowel.upper()}") for vowel in "aeiou"), ("[aeiou]", ""),
]
#: Letters that are their own code, or always the same one.
METAPHONE_LETTERS = ("bfhjlmnpqrstvz", "BFHJLMNPKRSTFS")


def metaphone_text(text: str) -> str:
    """Metaphone word by word, so that a leading article changes only the first word."""
    code = " " + re.sub("[^a-z]+", "  ", text.lower()) + " "
    for pattern, replacement in METAPHONE_RULES:
        code = re.sub(pattern, re.sub("<([12])>", r"\\\1", replacement), code)
    return re.sub(" +", " ", code.translate(str.maketrans(*METAPHONE_LETTERS))).strip(" ")


def article_variant(left: str, right: str) -> bool:
    short, long = sorted((left, right), key=len)
    return long == "the " + short and not short.startswith("the ")


def fuzzy_similarity(left: str, right: str, left_code: str | None = None, right_code: str | None = None) -> float:
    """0..1 on already folded names: 80 % insert/delete ratio, 20 % equal sound."""
    if not left or not right:
        return 0.0
    if left == right:
        return 1.0
    ratio = indel_similarity(left, right)
    if article_variant(left, right):
        return max(0.9, ratio)
    left_code = metaphone_text(left) if left_code is None else left_code
    right_code = metaphone_text(right) if right_code is None else right_code
    return ratio * 0.8 + (0.2 if left_code and left_code == right_code else 0.0)


def best_substring_errors(pattern: str, text: str) -> int:
    """Fewest edits that turn `pattern` into some substring of `text` (bit-parallel, Myers 1999)."""
    size = len(pattern)
    if size == 0:
        return 0
    positions: dict[str, int] = {}
    for index, letter in enumerate(pattern):
        positions[letter] = positions.get(letter, 0) | (1 << index)
    mask, last = (1 << size) - 1, 1 << (size - 1)
    up, down, errors, best = mask, 0, size, size
    for letter in text:
        match = positions.get(letter, 0)
        diagonal = ((((match & up) + up) ^ up) | match | down) & mask
        rise = (down | ~(diagonal | up)) & mask
        fall = up & diagonal
        if rise & last:
            errors += 1
        elif fall & last:
            errors -= 1
        best = min(best, errors)
        rise, fall = (rise << 1) & mask, (fall << 1) & mask
        up, down = (fall | ~(diagonal | rise)) & mask, rise & diagonal
    return best


@F.pandas_udf(T.DoubleType())
def _indel_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else indel_similarity(a, b) for a, b in zip(left, right)],
                     dtype="float64")


@F.pandas_udf(T.DoubleType())
def _fuzzy_udf(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_similarity(a or "", b or "") for a, b in zip(left, right)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def _substring_errors_udf(pattern: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([best_substring_errors(p, t) for p, t in zip(pattern, text)], dtype="int32")


def indel_ratio(left: Column | str, right: Column | str) -> Column:
    return _indel_udf(left, right)


def metaphone(value: Column | str) -> Column:
    """`metaphone_text` in column expressions, in fewer passes over the text.

    The rules for repeated letters do not touch each other and are one pattern; rules without pattern signs are plain
    replacements; the last rule, which drops the vowels, goes with the letter table.
    """
    value = F.col(value) if isinstance(value, str) else value
    code = F.concat(F.lit(" "), F.regexp_replace(F.lower(value), "[^a-z]+", "  "), F.lit(" "))
    repeated = [rule for rule in METAPHONE_RULES if re.fullmatch(r"([a-z])\1\+", rule[0])]
    code = F.regexp_replace(code, f"([{''.join(letter for _, letter in repeated)}])\\1+", "$1")
    *rules, (vowels, _) = METAPHONE_RULES[len(repeated):]
    for pattern, replacement in rules:
        if re.fullmatch("[a-z ]+", pattern):
            code = F.replace(code, F.lit(pattern), F.lit(replacement))
        else:
            code = F.regexp_replace(code, pattern, re.sub("<([12])>", r"$\1", replacement))
    letters, codes = METAPHONE_LETTERS
    return F.trim(F.regexp_replace(F.translate(code, letters + vowels.strip("[]"), codes), " +", " "))


def fuzzy_score(left: Column | str, right: Column | str) -> Column:
    return _fuzzy_udf(matching_form(left), matching_form(right))


def substring_errors(pattern: Column | str, text: Column | str) -> Column:
    return _substring_errors_udf(pattern, text)
