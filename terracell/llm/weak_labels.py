"""Quality classifier from weak labels.

1. A table of heuristic labellers votes good, bad or nothing on each document, from its measures.
2. Documents are counted by pattern of votes: at most 3**labellers rows, whatever the corpus, over all
   documents. Expectation-maximisation on these counts estimates each labeller's chances of each vote
   given the unknown class, and the share of good documents.
3. The posterior of a document is a sum of the log ratios of its votes.
4. The posteriors are soft labels (two weighted rows a document) of a logistic regression on hashed
   words and word shapes, fitted by the distributed solver on ``train_rows`` documents chosen by a hash
   of their id: the documented bound of the sample. All documents are scored.

Defined results: a null text counts as empty; an empty text has only votes that its zero measures give.
Repeated rows get equal results. With fewer than two classes among the posteriors, or an empty table, no scorer
is fitted and the score is the posterior. Extra columns pass through, columns named like results are
replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import WORD, fresh, let, replace_columns, stored, whole, without_spaces, words_of
from terracell.llm.quality_rules import STOP_WORDS

TRAIN_ROWS = 20_000
FEATURES = 1 << 14
GOOD, BAD, NONE = 2, 1, 0
LEAST_WORDS = 20


@dataclass(frozen=True)
class Labeller:
    """Bad above ``bad``, good below ``good`` (the other way round where ``bad < good``)."""

    name: str
    share: tuple[str, str]
    good: float
    bad: float


LABELLERS = (
    Labeller("symbols", ("n_symbols", "n_words"), good=0.02, bad=0.15),
    Labeller("stop_words", ("n_stop_words", "n_words"), good=0.12, bad=0.04),
    Labeller("few_windows", ("n_windows", "n_words"), good=0.75, bad=0.5),
    Labeller("few_words", ("n_distinct", "n_words"), good=0.3, bad=0.1),
    Labeller("few_lines", ("n_distinct_lines", "n_lines"), good=0.9, bad=0.6),
    Labeller("upper_case", ("n_upper", "n_chars"), good=0.1, bad=0.3),
    Labeller("exclamations", ("n_exclaims", "n_words"), good=0.02, bad=0.15),
    Labeller("long_words", ("n_chars", "n_words"), good=8.0, bad=12.0),
)


def measured(t: Column) -> Column:
    """Struct of a text's measures and its distinct words; the words are taken once."""

    def of_words(w: Column) -> Column:
        inner = F.slice(w, F.lit(1), F.greatest(F.size(w) - 2, F.lit(0)))
        windows = F.transform(inner, lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return F.struct(
            F.size(w).alias("n_words"),
            F.size(F.array_distinct(windows)).alias("n_windows"),
            F.size(F.filter(w, lambda x: x.isin(*STOP_WORDS))).alias("n_stop_words"),
            F.array_distinct(w).alias("words"),
        )

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).alias("n_lines"), F.size(F.array_distinct(x)).alias("n_distinct_lines"))

    def count(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern))

    parts = F.struct(
        let(words_of(t), of_words).alias("w"),
        let(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD)), of_lines).alias("l"),
        F.length(without_spaces(t)).alias("n_chars"),
        count("[#*$%&|<>]").alias("n_symbols"),
        count(r"\p{Lu}").alias("n_upper"),
        count("!").alias("n_exclaims"),
    )

    def together(p: Column) -> Column:
        counts = [p["w"][c].alias(c) for c in ("n_words", "n_windows", "n_stop_words", "words")]
        counts += [p["l"][c].alias(c) for c in ("n_lines", "n_distinct_lines")]
        counts += [p[c].alias(c) for c in ("n_chars", "n_symbols", "n_upper", "n_exclaims")]
        return F.struct(*counts, F.size(p["w"]["words"]).alias("n_distinct"))

    return let(parts, together)


def vote(labeller: Labeller, m: Column) -> Column:
    top, base = (m[c].cast("double") for c in labeller.share)
    if labeller.good < labeller.bad:
        good, bad = top <= labeller.good * base, top >= labeller.bad * base
    else:
        good, bad = top >= labeller.good * base, top <= labeller.bad * base
    # few words say nothing about shares
    return F.when((base <= 0) | (m["n_words"] < LEAST_WORDS), NONE).when(bad, BAD).when(good, GOOD).otherwise(NONE)


def with_votes(df: DataFrame, text_col: str, votes: str, words: str) -> DataFrame:
    """``df`` with its votes as one number of base 3, and its distinct words."""
    m = fresh(df, "measures")

    def pattern(m: Column) -> Column:
        total = F.lit(0)
        for i, labeller in enumerate(LABELLERS):
            total = total + vote(labeller, m) * 3**i
        return F.struct(total.cast("int").alias("votes"), m["words"].alias("words"))

    out = df.withColumn(m, let(measured(whole(text_col)), pattern))
    return out.select(*df.columns, F.col(m)["votes"].alias(votes), F.col(m)["words"].alias(words))


def votes_of(pattern: int) -> list[int]:
    return [pattern // 3**i % 3 for i in range(len(LABELLERS))]


@dataclass(frozen=True)
class WeakModel:
    """Log odds of good without votes, and what each vote of each labeller adds."""

    prior: float
    adds: tuple[tuple[float, float, float], ...]

    def log_odds(self, pattern: int) -> float:
        return self.prior + sum(a[v] for a, v in zip(self.adds, votes_of(pattern)))


def estimate(counts: dict[int, int], rounds: int = 200, close: float = 1e-9) -> WeakModel:
    """Expectation-maximisation from the majority of votes; chances are smoothed by one vote of each kind.

    ``counts`` has the documents of each pattern. A labeller's silence says nothing.
    """
    patterns = {p: votes_of(p) for p in sorted(counts)}
    total = sum(counts.values())
    good = {}
    for p, vs in patterns.items():
        up, down = vs.count(GOOD), vs.count(BAD)
        good[p] = (up + 1) / (up + 4 * down + 2)  # one bad vote weighs as four good ones
    model = WeakModel(0.0, ((0.0, 0.0, 0.0),) * len(LABELLERS))
    last = None
    for _ in range(rounds):
        n_good = sum(counts[p] * good[p] for p in patterns)
        prior = math.log((n_good + 1) / (total - n_good + 1))
        adds = []
        for i in range(len(LABELLERS)):
            sums = [[0.0, 0.0], [1.0, 1.0], [1.0, 1.0]]
            for p, vs in patterns.items():
                if vs[i] != NONE:
                    sums[vs[i]][1] += counts[p] * good[p]
                    sums[vs[i]][0] += counts[p] * (1 - good[p])
            of_bad, of_good = (sum(s[k] for s in sums) for k in (0, 1))
            adds.append((0.0, *(math.log(s[1] / of_good) - math.log(s[0] / of_bad) for s in sums[1:])))
        model = WeakModel(prior, tuple(adds))
        good = {p: sigmoid(model.log_odds(p)) for p in patterns}
        now = sum(counts[p] * good[p] for p in patterns)
        if last is not None and abs(now - last) <= close * max(total, 1):
            break
        last = now
    return model


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def posterior(model: WeakModel, votes: Column) -> Column:
    odds = F.lit(model.prior)
    for i, adds in enumerate(model.adds):
        at = F.pmod(F.floor(votes / F.lit(3**i)), F.lit(3)) + 1
        odds = odds + F.element_at(F.array(*[F.lit(a) for a in adds]), at.cast("int"))
    return 1.0 / (1.0 + F.exp(-odds))


def tokens(text: Column, words: Column) -> Column:
    """Distinct words, and distinct shapes of words: runs of letters and digits shrunk to one sign."""
    shape = text
    for pattern, sign in ((r"\p{Lu}+", "A"), (r"\p{Ll}+", "a"), (r"\p{N}+", "0")):
        shape = F.regexp_replace(shape, pattern, sign)
    shapes = F.transform(F.array_distinct(words_of(shape)), lambda s: F.concat(F.lit("\x00"), s))
    return F.concat(words, shapes)


def classify(
    df: DataFrame, text_col: str = "text", id_col: str = "doc_id", train_rows: int = TRAIN_ROWS, seed: int = 5
) -> DataFrame:
    """``df`` with votes (string), posterior and score (double) and kept: a score of 0.5 or more."""
    df = replace_columns(df, ["votes", "posterior", "score", "kept"])
    pattern, words, hashed, unit = (fresh(df, c) for c in ("vote_pattern", "tokens", "hashed", "unit"))
    raw, chance, guess = (fresh(df, c) for c in ("raw_score", "chance", "guess"))
    counted = with_votes(df.select(F.col(text_col).alias("text")), "text", "pattern", "words").groupBy("pattern").count()
    counts = {r["pattern"]: r["count"] for r in counted.collect()}
    model, n = estimate(counts), sum(counts.values())

    tf = HashingTF(numFeatures=FEATURES, binary=True, inputCol=words, outputCol=hashed)
    norm = Normalizer(inputCol=hashed, outputCol=unit)

    def prepared(rows: DataFrame) -> DataFrame:
        rows = with_votes(rows, text_col, pattern, words).withColumn("posterior", posterior(model, F.col(pattern)))
        return norm.transform(tf.transform(rows.withColumn(words, tokens(whole(text_col), F.col(words)))))

    at = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(max(n, 1)))
    sample = prepared(df.select(id_col, text_col).where(at < train_rows)).select(unit, "posterior")
    soft = F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), (1.0 - F.col("posterior")).alias("weight")),
    )
    rows = sample.select(unit, F.explode(soft).alias("s")).select(unit, "s.label", "s.weight").where("weight > 1e-6")
    rows = stored(rows)
    classes = {r["label"] for r in rows.select("label").distinct().collect()}
    out = prepared(df)
    if len(classes) == 2:
        fit = LogisticRegression(
            featuresCol=unit, weightCol="weight", rawPredictionCol=raw, probabilityCol=chance, predictionCol=guess,
            maxIter=30, regParam=1e-4,
        ).fit(rows)
        out = fit.transform(out).withColumn("score", vector_to_array(F.col(chance))[1])
    else:
        out = out.withColumn("score", F.col("posterior"))
    signs = F.array(*[F.lit(c) for c in ("-", "b", "g")])
    one = [F.element_at(signs, (F.pmod(F.floor(F.col(pattern) / F.lit(3**i)), F.lit(3)) + 1).cast("int")) for i in range(len(LABELLERS))]
    out = out.withColumns({"votes": F.concat(*one), "kept": F.col("score") >= 0.5})
    return out.select(*df.columns, "votes", "posterior", "score", "kept")
