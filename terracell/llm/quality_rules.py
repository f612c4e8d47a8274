"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Every measure is an expression over the row's own text, so a pass over the corpus is a scan without
a shuffle. Arrays that are named more than once are bound by ``let``.

Defined results: a null text counts as empty; an empty text has measures of zero, ratios of zero and
fails the length rule. Repeated rows get equal results. Columns of the input that have the names of
results are replaced, all others stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import WORD, fresh, let, replace_columns, whole, without_spaces, words_of

#: Frequent function words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "a", "and", "as", "at", "be", "by", "for", "from", "in", "is", "it", "of", "on", "or", "that",
    "the", "this", "to", "was", "with",
    "das", "den", "der", "die", "ein", "eine", "ist", "mit", "nicht", "sich", "und", "von", "zu",
    "au", "aux", "avec", "dans", "des", "du", "elle", "est", "et", "la", "le", "les", "par", "pas",
    "pour", "que", "qui", "sur", "une",
    "al", "con", "de", "del", "el", "en", "es", "las", "los", "no", "por", "se", "un", "una", "y",
)

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= ratio <= high``; ``share`` names two measures to divide."""

    name: str
    share: tuple[str, str | None]
    low: float | None = None
    high: float | None = None


#: The base rules first, then the ratios. Wide on purpose: ordinary prose has to pass.
RULES = (
    Rule("short", ("n_words", None), low=50),
    Rule("repeated_words", ("n_repeat_words", "n_words"), high=0.5),
    Rule("symbols", ("n_symbols", "n_words"), high=0.2),
    Rule("stop_words", ("n_stop_words", "n_words"), low=0.03),
    Rule("mean_word_length", ("word_chars", "n_words"), low=2.0, high=20.0),
    Rule("repeated_lines", ("n_dup_lines", "n_lines"), high=0.5),
)
BASE_RULES = ("short", "repeated_words")


def repeat_words(words: Column) -> Column:
    """Words inside windows of three that occur twice or more, each counted once.

    The windows' hashes are sorted with their places; neighbours of equal hash are repeats, and a
    window adds the words up to the next repeated window, three at most.
    """

    def windows(w: Column) -> Column:
        at = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        return F.sort_array(
            F.transform(
                at,
                lambda x, i: F.struct(
                    F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")
                ),
            )
        )

    def places(s: Column) -> Column:
        twice = F.transform(
            s,
            lambda e, j: F.when(
                (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]), e["i"]
            ),
        )
        return F.sort_array(F.filter(twice, lambda x: x.isNotNull()))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(p, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(let(let(words, windows), places), covered)


def measured(t: Column) -> Column:
    """Struct of all measures of a text. One expression that names each array once, so a filter on it
    that the planner moves below a projection still costs one evaluation."""

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    def together(p: Column) -> Column:
        w, k = p["words"], p["lines"]
        return F.struct(
            w["n_words"].alias("n_words"),
            p["chars"].alias("word_chars"),
            p["symbols"].alias("n_symbols"),
            k["n_lines"].alias("n_lines"),
            k["n_dup_lines"].alias("n_dup_lines"),
            w["n_repeat_words"].alias("n_repeat_words"),
            w["n_stop_words"].alias("n_stop_words"),
        )

    parts = F.struct(
        let(words_of(t), of_words).alias("words"),
        let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)), of_lines).alias("lines"),
        F.length(without_spaces(t)).cast("long").alias("chars"),
        F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("symbols"),
    )
    return let(parts, together)


def measures(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` and one long per measure."""
    df = replace_columns(df, list(MEASURES))
    m = fresh(df, "measures")
    out = df.withColumn(m, measured(whole(text_col)))
    return out.select(*df.columns, *[F.col(m)[x].alias(x) for x in MEASURES])


def fails(rule: Rule, m: Column) -> Column:
    """True where the measures break the rule; compared by products, so nothing is divided."""
    top, base = rule.share
    left = m[top].cast("double")
    of = m[base].cast("double") if base else F.lit(1.0)
    broken = F.lit(False)
    if rule.low is not None:
        broken = broken | (left < F.lit(float(rule.low)) * of)
    if rule.high is not None:
        broken = broken | (left > F.lit(float(rule.high)) * of)
    return broken


def apply_rules(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, base: tuple[str, ...] = BASE_RULES, text_col: str = "text"
) -> DataFrame:
    """``df`` with its measures, ``failed_rules`` (names in table order), ``base_failed``, ``kept``."""
    df = replace_columns(df, [*MEASURES, "failed_rules", "base_failed", "kept"])

    def judged(m: Column) -> Column:
        names = F.array(*[F.when(fails(r, m), F.lit(r.name)) for r in rules])
        of_base = F.lit(False)
        for r in rules:
            if r.name in base:
                of_base = of_base | fails(r, m)
        return F.struct(
            *[m[x].alias(x) for x in MEASURES],
            F.filter(names, lambda x: x.isNotNull()).alias("failed_rules"),
            of_base.alias("base_failed"),
        )

    def with_verdict(v: Column) -> Column:
        return F.struct(
            *[v[x].alias(x) for x in (*MEASURES, "failed_rules", "base_failed")],
            (F.size(v["failed_rules"]) == 0).alias("kept"),
        )

    v = fresh(df, "verdict")
    out = df.withColumn(v, let(let(measured(whole(text_col)), judged), with_verdict))
    return out.select(*df.columns, *[F.col(v)[x].alias(x) for x in (*MEASURES, "failed_rules", "base_failed", "kept")])
