"""Text functions: token decoding, ground-truth filters, edit distances."""

from __future__ import annotations

import random
import re
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

#: The recogniser's vocabulary, in order of token ids.
VOCABULARY = [
    "blank", "!", "\"", "#", "$", "%", "&", "'", "(", ")", "*", "+", ",", "-", ".", "/", ":", ";", "<", "=",
    ">", "?", "।", "ঁ", "ং", "ঃ", "অ", "আ", "ই", "ঈ", "উ", "ঊ", "ঋ", "এ", "ঐ", "ও", "ঔ", "ক", "খ", "গ",
    "ঘ", "ঙ", "চ", "ছ", "জ", "ঝ", "ঞ", "ট", "ঠ", "ড", "ঢ", "ণ", "ত", "থ", "দ", "ধ", "ন", "প", "ফ", "ব",
    "ভ", "ম", "য", "র", "ল", "শ", "ষ", "স", "হ", "া", "ি", "ী", "ু", "ূ", "ৃ", "ে", "ৈ", "ো", "ৌ", "্",
    "ৎ", "ড়", "ঢ়", "য়", "০", "১", "২", "৩", "৪", "৫", "৬", "৭", "৮", "৯", "\u200d", "sep", "pad",
]
SEPARATOR = VOCABULARY.index("sep")

#: Strings before the normaliser and after, applied in this order; precomposed letters stay precomposed.
NUKTA_FORMS = (("\u09a1\u09bc", "\u09dc"), ("\u09a2\u09bc", "\u09dd"), ("\u09af\u09bc", "\u09df"), ("\u09c7\u09be", "\u09cb"), ("\u09c7\u09d7", "\u09cc"))


def argmax(values: Column) -> Column:
    """0-based place of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def decoded(tokens: Column, vocabulary: list[str] = VOCABULARY, separator: int = SEPARATOR) -> Column:
    """Text of a row of token ids: the first position is skipped, and the separator ends it; nothing is collapsed."""
    words = F.array(*[F.lit(w) for w in vocabulary])
    body = F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))
    end = F.array_position(body, F.lit(separator).cast("int"))
    kept = F.when(end > 0, F.slice(body, F.lit(1), (end - 1).cast("int"))).otherwise(body)
    return F.array_join(F.transform(kept, lambda t: F.element_at(words, t + 1)), "")


def decoded_logits(logits: Column, vocabulary: list[str] = VOCABULARY, separator: int = SEPARATOR) -> Column:
    return decoded(F.transform(logits, argmax), vocabulary, separator)


def normalised_word(text: Column) -> Column:
    """Native part of the word normaliser: composed forms, no joiner at an end; null becomes empty. A fuller rule set can be plugged in as a pandas UDF."""
    out = F.coalesce(text, F.lit(""))
    for before, after in NUKTA_FORMS:
        out = F.replace(out, F.lit(before), F.lit(after))
    return F.regexp_replace(out, "^[\u200c\u200d\u09cd]+|[\u200c\u200d]+$", "")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def has_latin(text: Column) -> Column:
    """ASCII letters or digits: such words are not scored."""
    return stripped(text).rlike("[A-Za-z0-9]")


def gt_word(text: Column, normalise=normalised_word) -> Column:
    """A ground-truth word ready for scoring; null if it is not scored."""
    parts = F.filter(F.transform(F.split(stripped(text), " "), normalise), lambda w: w.isNotNull())
    return F.when(~has_latin(text), F.array_join(parts, " "))


def plain_gt_word(text: str | None) -> str | None:
    """gt_word of one text, with the native normaliser."""
    text = None if text is None else text.strip(" \t\n\v\f\r")
    if text is None or re.search("[A-Za-z0-9]", text):
        return None
    parts = text.split(" ")
    for before, after in NUKTA_FORMS:
        parts = [p.replace(before, after) for p in parts]
    return " ".join(re.sub("^[\u200c\u200d\u09cd]+|[\u200c\u200d]+$", "", p) for p in parts)


def word_distance(gt: Column, pred: Column) -> Column:
    return F.when(F.length(gt) == 0, F.length(pred)).when(F.length(pred) == 0, F.length(gt)).otherwise(F.levenshtein(gt, pred)).cast("int")


def word_ned(gt: Column, pred: Column) -> Column:
    """Edit distance over the longer length; 1 if either side is empty."""
    longest = F.greatest(F.length(gt), F.length(pred))
    return F.when((F.length(gt) == 0) | (F.length(pred) == 0), F.lit(1.0)).otherwise(F.levenshtein(gt, pred) / longest)


def edits(a: Sequence, b: Sequence) -> int:
    """Edit distance of two sequences, by bit vectors: a bit for each item of the longer one, a step for each of the shorter one."""
    if len(a) < len(b):
        a, b = b, a
    lo, hi = 0, 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    while hi < len(b) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not b:
        return len(a)
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    every, top, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    plus, minus = every, 0
    for x in b:
        same = at.get(x, 0)
        across = ((same & plus) + plus ^ plus) | same
        up, down = minus | (every & ~(across | plus)), plus & across
        if up & top:
            distance += 1
        elif down & top:
            distance -= 1
        same |= minus
        up = up << 1 | 1
        plus = every & (down << 1 | ~(same | up))
        minus = every & up & same
    return distance


@F.arrow_udf(T.LongType())
def edits_of(a: pa.Array, b: pa.Array) -> pa.Array:
    """Edit distances of pairs of texts, in code points, or of pairs of lists."""
    return pa.array([None if x is None or y is None else edits(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)], pa.int64())


def document_cer(reference: Column, hypothesis: Column) -> Column:
    """Character edits over the reference's length; null for an empty reference."""
    return F.try_divide(edits_of(reference, hypothesis).cast("double"), F.length(reference).cast("double"))


def document_words(text: Column, delimiter: str = r"\s+") -> Column:
    return F.filter(F.split(text, delimiter), lambda w: w != "")


def word_edits(reference: str, hypothesis: str) -> int:
    """Word edit distance of two texts."""
    return edits(reference.split(), hypothesis.split())


@F.pandas_udf(T.DoubleType())
def slow_wer(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word error rate of any pair."""
    return pd.Series([None if r is None or h is None or not r.split() else word_edits(r, h) / len(r.split()) for r, h in zip(reference, hypothesis, strict=True)], dtype="float64")


def document_wer(reference: Column, hypothesis: Column, delimiter: str = r"\s+") -> Column:
    """Word edits over the reference's words; null for an empty reference."""
    a, b = document_words(reference, delimiter), document_words(hypothesis, delimiter)
    return F.try_divide(edits_of(a, b).cast("double"), F.size(a).cast("double"))


def permutation(n: int, seed: int = 5) -> list[int]:
    """The seeded order in which a document's n regions are joined."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def permutation_of(n: pd.Series) -> pd.Series:
    known: dict[int, list[int]] = {}
    return pd.Series([known.setdefault(k, permutation(k)) for k in n.fillna(0).astype(int)])


def shuffled(items: Column, order: Column) -> Column:
    """items in the order of 0-based places."""
    return F.transform(order, lambda i: F.element_at(items, i + 1))


def f1(precision: Column, accuracy: Column) -> Column:
    total = precision + accuracy
    return F.when(total > 1e-5, F.lit(2.0) * precision * accuracy / total).otherwise(F.lit(0.0))
