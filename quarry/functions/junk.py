"""Normal form of terms, and the tests that mark a term as junk."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.fixed import LAB_VALUE, STOP_WORDS
from quarry.functions.text import BLANK, strip


def _bare(term: Column) -> Column:
    return strip(F.coalesce(term, F.lit("")))


def normalize(term: Column) -> Column:
    """Lower case, bare ends, single spaces; null becomes empty."""
    return F.regexp_replace(F.lower(_bare(term)), rf"(?U){BLANK}+", " ")


def is_punctuation(term: Column) -> Column:
    """No letter and no number."""
    return _bare(term).rlike(r"\A[^\p{L}\p{N}]*\z")


def is_anonymised(term: Column) -> Column:
    return _bare(term).contains("___") | _bare(term).rlike(r"\A_+\z")


def is_stop_word(term: Column, words=STOP_WORDS) -> Column:
    plain = F.lower(_bare(term))
    return plain.rlike(r"\A[a-z]+\z") & plain.isin(list(words)) if words else F.lit(False)


def is_digits(term: Column) -> Column:
    return _bare(term).rlike(r"\A\p{Nd}+\z")


def is_lab_value(term: Column) -> Column:
    plain = F.lower(_bare(term))
    return reduce(or_, (plain.rlike(rf"\A{p}\z") for p in LAB_VALUE))


def is_blacklisted(term: Column, blacklist=()) -> Column:
    return F.lower(_bare(term)).isin(list(blacklist)) if blacklist else F.lit(False)


def is_junk(term: Column, stop_words=STOP_WORDS, blacklist=()) -> Column:
    return (
        is_punctuation(term) | is_anonymised(term) | is_stop_word(term, stop_words) | is_digits(term)
        | is_blacklisted(term, blacklist) | is_lab_value(term)
    )


def junk_columns(df: DataFrame, term: str = "term", stop_words=STOP_WORDS, blacklist=()) -> DataFrame:
    """``df`` with the normal form of ``term`` and each junk test as a column; the bare term is worked out once a row."""
    bare, plain = F.col("_bare"), F.lower("_bare")
    shape = lambda p: plain.rlike(rf"\A{p}\z")
    tests = {
        "punctuation": bare.rlike(r"\A[^\p{L}\p{N}]*\z"), "anonymised": bare.contains("___") | bare.rlike(r"\A_+\z"),
        "stop_word": plain.rlike(r"\A[a-z]+\z") & plain.isin(list(stop_words)) if stop_words else F.lit(False), "digits": bare.rlike(r"\A\p{Nd}+\z"),
        "lab_value": reduce(or_, map(shape, LAB_VALUE)), "blacklisted": plain.isin(list(blacklist)) if blacklist else F.lit(False),
    }
    flagged = df.withColumn("_bare", _bare(F.col(f"`{term}`"))).withColumns({"normal": F.regexp_replace(plain, rf"(?U){BLANK}+", " "), **tests}).drop("_bare")
    return flagged.withColumn("junk", reduce(or_, (F.col(c) for c in tests)))
