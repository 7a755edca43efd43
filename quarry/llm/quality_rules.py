"""Quality rules: a threshold table compiled into one projection (native).

Every measure is an expression of built-in functions over the whole text, every
rule is one row of a table, and the table compiles to boolean columns of the
same projection: no shuffle, no user function. Windows of five words are told
apart by 64-bit hashes of their words, compared within one text only.

Defined results for odd input: a null or blank text has zero words and fails;
repeated rows are judged one by one; columns besides ``doc_id`` and ``text`` are
ignored by :func:`measures` and carried through by :func:`keep`; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import let, words_of

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "a an and are as at be by for from had has have he in is it of on or that the this to was were with "
    "au aux avec ce dans de des du elle en est et la le les ou par pas pour que qui sur un une "
    "al como con del el es la las lo los no para por se su un una y "
    "auch das dem den der des die ein eine für ist mit nicht sich und von zu"
).split()

LONGEST_STOP_WORD = max(len(w.encode()) for w in STOP_WORDS)

WINDOW = 5


@dataclass(frozen=True)
class Rule:
    """``least <= 1000 * over / under <= most``, in whole thousandths; a bound may be missing.

    ``after`` is the number of words from which the rule applies.
    """

    name: str
    over: str
    under: str
    least: int | None = None
    most: int | None = None
    after: int = 0


#: The method's own thresholds, in thousandths. They sit far outside what prose of the corpus shows.
RULES = (
    Rule("word_length", "word_chars", "n_words", least=2000, most=15000),
    Rule("symbols", "n_symbols", "n_words", most=300),
    Rule("stop_words", "n_stop_words", "n_words", least=20, after=50),
    Rule("exclamations", "n_exclamations", "n_words", most=300),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", most=500),
)

BASE_LEAST_WORDS, BASE_REPEAT_PERCENT = 10, 20

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words", "n_exclamations")


def _covered(starts: Column) -> Column:
    """Words under windows that begin at the ascending ``starts``."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, x: F.struct((acc["n"] + F.least(F.lit(WINDOW), x - acc["last"])).cast("long").alias("n"), x.alias("last")),
        lambda acc: acc["n"],
    )


#: Up to so many different repeated windows are looked up by scanning their list, more by sorting places.
FEW = 32


def _repeated(hashes: Column) -> Column:
    """Words in windows that occur twice or more, from the windows' hashes in order.

    Equal neighbours among the sorted hashes are the repeated ones; the cost is
    n log n at most and no pairs are made.
    """

    def by_sort(h):
        return let(
            F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
            lambda s: _covered(
                F.sort_array(
                    F.transform(
                        F.filter(s, lambda x, k: x["h"].eqNullSafe(F.get(s, k + 1)["h"]) | x["h"].eqNullSafe(F.get(s, k - 1)["h"])),
                        lambda x: x["i"],
                    )
                )
            ),
        )

    def by_scan(h, repeated):
        places = F.transform(h, lambda x, i: F.when(F.array_contains(repeated, x), i))
        return _covered(F.array_compact(places))

    twice = let(F.sort_array(hashes), lambda s: F.array_distinct(F.filter(s, lambda x, i: x.eqNullSafe(F.get(s, i + 1)))))
    return let(twice, lambda r: F.when(F.size(r) <= FEW, by_scan(hashes, r)).otherwise(by_sort(hashes)))


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with one long column for each of MEASURES, prefixed ``_q_``."""
    words, lines = F.col("_q_words"), F.col("_q_lines")
    text = F.coalesce(F.col("text"), F.lit(""))
    hashes = F.when(
        F.size(words) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW)))),
    ).otherwise(F.array().cast("array<bigint>"))
    first = docs.withColumns({
        "_q_words": words_of(F.col("text")),
        "_q_lines": F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
    })
    second = first.withColumn("_q_hashes", hashes)
    may_repeat = F.size(F.array_distinct(F.col("_q_hashes"))) < F.size(F.col("_q_hashes"))
    values = {
        "n_words": F.size(words),
        "word_chars": F.length(F.array_join(words, "")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": F.when(may_repeat, _repeated(F.col("_q_hashes"))).otherwise(0),
        "n_lines": F.size(lines),
        "n_stop_words": F.size(F.filter(words, lambda w: (F.octet_length(w) <= LONGEST_STOP_WORD) & F.lower(w).isin(STOP_WORDS))),
        "n_exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
    }
    # The row number keeps a later filter above this projection; below it, the filter
    # would work out the words again for each of its expressions, and inside lambdas for each word.
    values["row"] = F.monotonically_increasing_id()
    return second.withColumns({f"_q_{k}": v.cast("long") for k, v in values.items()}).drop("_q_words", "_q_lines", "_q_hashes")


def _passes(rule: Rule, col) -> Column:
    over, under = col(rule.over) * 1000, col(rule.under)
    ok = F.lit(True)
    if rule.least is not None:
        ok = ok & (over >= under * rule.least)
    if rule.most is not None:
        ok = ok & (over <= under * rule.most)
    return ok | (col("n_words") < rule.after) if rule.after else ok


def _verdict(df: DataFrame, rules) -> DataFrame:
    col = lambda k: F.col(f"_q_{k}")
    failed = F.filter(F.array(*(F.when(~_passes(r, col), F.lit(r.name)) for r in rules)), lambda x: x.isNotNull())
    base = (col("row") < 0) | (col("n_words") < BASE_LEAST_WORDS) | (100 * col("n_repeat_words") > BASE_REPEAT_PERCENT * col("n_words"))
    return df.withColumns({"_q_base_failed": base, "_q_failed": failed})


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """One row a document: the measures, ``base_failed``, ``kept`` and the names of failed rules."""
    df = _verdict(measures(docs.select("doc_id", "text")), rules)
    return df.select(
        "doc_id",
        *(F.col(f"_q_{k}").alias(k) for k in MEASURES[:5]),
        F.col("_q_base_failed").alias("base_failed"),
        (~F.col("_q_base_failed") & (F.size("_q_failed") == 0)).alias("kept"),
        F.array_join("_q_failed", ",").alias("failed_rules"),
    )


def keep(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, whatever their names."""
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_q_carried"), F.col("text"))
    df = _verdict(measures(own), rules)
    return df.filter(~F.col("_q_base_failed") & (F.size("_q_failed") == 0)).select(*(F.col("_q_carried").getField(c).alias(c) for c in docs.columns))
