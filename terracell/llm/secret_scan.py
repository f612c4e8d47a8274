"""Secret scan: fixed forms, and random-looking strings told by character Markov models.

Two models give the chance of each character after the one before, one of random strings and one of
ordinary identifiers. Both are counted from labelled samples, (text, label) rows of any number, into at
most 2 * 67 * 67 sums; their log ratios are one constant array of the scoring expression. A run of
characters is a secret when its summed log-likelihood ratio is high enough.

Everything is built-in functions. Positions of matches come from the lengths of the pieces between
them. Training shuffles pre-aggregated counts only; scoring is a map. Passes over the matches of a text
collect what they find in blocks (``scan``), and values are cut from chunks of the text (``cut``), so a text of
very many matches takes time that is nearly linear in its length.

Defined results: a null text counts as empty and has no spans. Without samples both models are uniform
and no run scores. Repeated rows get equal spans. Extra columns pass through, a column named like the
result is replaced. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import fresh, let, replace_columns, whole

# fixed values: the base forms, and the least lengths of what they catch
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
LEAST_ASSIGNED, LEAST_ACCESS = 12, 18
BASE = ("assign", "access", "hex")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]"
#: Runs of this length or more are scored.
LEAST_RUN = 20
#: Log-likelihood ratio that a run must reach, in all and for each step.
LEAST_SCORE, LEAST_STEP = 15.0, 0.4
#: Shares of a character's chance: by the one before, by itself, and equal for all. Shares, not added
#: counts, so that a ratio has a limit that no number of samples moves.
BY_PAIR, BY_SINGLE, EQUAL = 0.7, 0.2, 0.1
#: Runs that may be ordinary identifiers: 12 characters, or 6 with a digit, a joint or an inner capital.
NAMES = rf"(?<!{RUN})(?:{RUN}{{12,}}+|(?=[A-Za-z]*(?:[0-9+/_=-]|[a-z][A-Z])){RUN}{{6,}}+)"
#: What ordinary identifiers are made of, three quarters of their characters at least.
NAME_PARTS = r"[A-Z]?[a-z]{3,}|[A-Z][a-z]{2}|[A-Z]{3,}|[0-9]{2,}|[+/_=-]"


#: What scans find, the rows of a scan's block and the code points of a chunk of text.
SPAN = "struct<start:int,end:int,kind:string,value:string>"
PART = "struct<start:int,end:int>"
SCAN_BLOCK, CHUNK = 256, 1000


def scan(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], element: str, last: Callable[[Column], Column] | None = None) -> Column:
    """Array of what ``step`` finds in a pass over ``items`` with a running state, nulls left out.

    ``step`` gives the next state and a find, ``last`` a find from the state at the end. An array that grows
    inside a fold is copied at each step, so finds are gathered a block at a time.
    """
    none, nones = F.array().cast(f"array<{element}>"), F.array().cast(f"array<array<{element}>>")
    n_blocks = F.ceil(F.size(items) / F.lit(SCAN_BLOCK)).cast("int")
    numbers = F.when(n_blocks > 0, F.sequence(F.lit(1), n_blocks)).otherwise(F.array().cast("array<int>"))

    def inside(acc: Column, item: Column) -> Column:
        state, find = step(acc["state"], item)
        more = let(find, lambda f: F.when(f.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], f)))
        return F.struct(state.alias("state"), more.alias("out"))

    def over(acc: Column, number: Column) -> Column:
        block = F.slice(items, (number - 1) * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), none.alias("out")), inside)
        return let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    def finish(acc: Column) -> Column:
        if last is None:
            return F.flatten(acc["out"])
        end = F.filter(F.array(last(acc["state"])), lambda f: f.isNotNull())
        return F.concat(F.flatten(acc["out"]), end)

    return F.aggregate(numbers, F.struct(first.alias("state"), nones.alias("out")), over, finish)


def chunks_of(text: Column) -> Column:
    """The text in pieces of ``CHUNK`` code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(chunks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` (exclusive, more than ``start``) without a walk from the text's begin."""
    low, high = F.floor(start / F.lit(CHUNK)).cast("int"), F.floor((end - 1) / F.lit(CHUNK)).cast("int")
    near = F.array_join(F.slice(chunks, low + 1, high - low + 1), "")
    return F.substring(near, F.pmod(start, F.lit(CHUNK)) + 1, end - start)


def matches(text: Column, pattern: str, kind: str, group: int = 0, least: int = 1) -> Column:
    """Array of (start, end, kind, value): leftmost matches that don't overlap, of which those with a
    shorter group than ``least`` are dropped afterwards."""
    none = F.array().cast(f"array<{SPAN}>")

    def placed(parts: Column) -> Column:
        steps = F.transform(
            parts["whole"],
            lambda m, i: F.struct(F.length(F.get(parts["between"], i)).alias("gap"), F.length(m).alias("n"), F.get(parts["value"], i).alias("v")),
        )

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            a = at + s["gap"]
            one = F.struct(a.alias("start"), (a + s["n"]).alias("end"), F.lit(kind).alias("kind"), s["v"].alias("value"))
            return a + s["n"], F.when(F.length(s["v"]) >= least, one)

        return let(steps, lambda x: scan(x, F.lit(0), step, SPAN))

    parts = F.struct(
        F.split(text, pattern, -1).alias("between"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("whole"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    return F.when(text.rlike(pattern), let(parts, placed)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed forms by start, then kind."""
    found = F.concat(
        matches(text, ASSIGN, "assign", 2, LEAST_ASSIGNED),
        matches(text, ACCESS, "access", 0, LEAST_ACCESS),
        matches(text, HEX, "hex"),
    )
    return in_order(found)


def in_order(spans: Column) -> Column:
    rank = {k: i for i, k in enumerate((*BASE, "random"))}

    def with_rank(s: Column) -> Column:
        r = F.lit(len(rank))
        for k, i in rank.items():
            r = F.when(s["kind"] == k, i).otherwise(r)
        return F.struct(s["start"], r.alias("rank"), s["end"], s["kind"], s["value"])

    ordered = F.sort_array(F.transform(spans, with_rank))
    return F.transform(ordered, lambda s: F.struct(s["start"], s["end"], s["kind"], s["value"]))


def labelled_samples(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(sample, random) rows of a corpus, over all its texts.

    Random: values of the fixed forms, and one checksum in base 64 of each text. Ordinary: all runs
    outside the fixed forms that are made of words, numbers and joints, with digits, capitals, / and =.
    """
    t = whole(text_col)
    fixed = rf"{ASSIGN}|{ACCESS}|{HEX}"
    runs = F.regexp_extract_all(F.regexp_replace(t, fixed, " "), F.lit(NAMES), F.lit(0))
    named = F.filter(runs, lambda r: F.length(F.regexp_replace(r, NAME_PARTS, "")) * 4 <= F.length(r))
    ordinary = df.select(F.explode(named).alias("sample"), F.lit(False).alias("random"))
    values = F.filter(base_spans(t), lambda s: s["value"].rlike("[A-Za-z]"))
    drawn = F.array(F.substring(F.base64(F.unhex(F.sha2(t, 512))), 1, 85))
    random = df.select(F.explode(F.concat(F.transform(values, lambda s: s["value"]), drawn)).alias("sample"), F.lit(True).alias("random"))
    return ordinary.unionByName(random)


def code(char: Column) -> Column:
    """1 to 67, 0 for other characters."""
    return F.position(char, F.lit(ALPHABET))


def pairs_of(text: Column) -> Column:
    """Codes of neighbouring characters, as one number each."""
    m = len(ALPHABET) + 1
    codes = F.transform(F.split(text, ""), code)
    return let(codes, lambda c: F.transform(F.slice(c, F.lit(2), F.greatest(F.size(c) - 1, F.lit(0))), lambda x, i: F.get(c, i) * m + x))


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the two models for each pair of characters, other characters neutral.

    The counts are the only rows that reach the driver, two for each pair of characters at most.
    """
    m = len(ALPHABET) + 1
    counts = (
        samples.where(F.length("sample") > 1)
        .select("random", F.explode(pairs_of(F.col("sample"))).alias("pair"))
        .groupBy("random", "pair")
        .count()
        .collect()
    )
    return log_ratios({(r["random"], r["pair"]): r["count"] for r in counts})


def log_ratios(counts: dict[tuple[bool, int], int]) -> list[float]:
    """Log ratios from the counts of (random, pair). Equal multiples of all counts give equal ratios."""
    m = len(ALPHABET) + 1
    chance = {}
    for k in (True, False):
        n = {(a, b): counts.get((k, a * m + b), 0) for a in range(1, m) for b in range(1, m)}
        row = {a: sum(n[a, b] for b in range(1, m)) for a in range(1, m)}
        every = sum(row.values())
        for b in range(1, m):
            equal = 1 / (m - 1)
            column = sum(n[a, b] for a in range(1, m))
            single = (BY_SINGLE * (column / every if every else equal) + EQUAL * equal) / (BY_SINGLE + EQUAL)
            for a in range(1, m):
                pair = n[a, b] / row[a] if row[a] else single
                chance[k, a, b] = BY_PAIR * pair + (1 - BY_PAIR) * single
    table = [0.0] * (m * m)
    for a in range(1, m):
        for b in range(1, m):
            table[a * m + b] = math.log(chance[True, a, b] / chance[False, a, b])
    return table


def ratios_of(text: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of each step of a run: random against ordinary."""
    ratios = F.split(F.lit(",".join(repr(round(x, 6)) for x in table)), ",").cast("array<double>")
    return F.transform(pairs_of(text), lambda p: F.get(ratios, p))


def score(text: Column, table: list[float]) -> Column:
    """Summed log-likelihood ratio of a run."""
    return F.aggregate(ratios_of(text, table), F.lit(0.0), lambda acc, x: acc + x)


def outside(runs: Column, base: Column) -> Column:
    """Array of (start, end): what the base spans leave of the runs, pieces of ``LEAST_RUN`` or more.

    One pass over runs and base spans by start: ``at`` is where the run's next piece begins, ``end`` where the
    run ends and ``cover`` the end of all base spans so far.
    """
    events = F.sort_array(
        F.concat(
            F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(False).alias("run"))),
            F.transform(runs, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), F.lit(True).alias("run"))),
        )
    )
    zero = F.lit(0)
    first = F.struct(zero.alias("at"), zero.alias("end"), zero.alias("cover"))

    def piece(at: Column, end: Column) -> Column:
        return F.when(end - at >= LEAST_RUN, F.struct(at.alias("start"), end.alias("end")))

    def step(s: Column, e: Column) -> tuple[Column, Column]:
        after = F.struct(
            F.when(e["run"], F.greatest(e["start"], s["cover"])).otherwise(F.greatest(s["at"], e["end"])).alias("at"),
            F.when(e["run"], e["end"]).otherwise(s["end"]).alias("end"),
            F.when(e["run"], s["cover"]).otherwise(F.greatest(s["cover"], e["end"])).alias("cover"),
        )
        return after, piece(s["at"], F.least(e["start"], s["end"]))

    return let(events, lambda x: scan(x, first, step, PART, lambda s: piece(s["at"], s["end"])))


def stretches(value: Column, table: list[float]) -> Column:
    """Array of (start, end): the best-scoring stretches of a piece that are secrets.

    A running sum of the ratios above ``LEAST_STEP`` starts anew where it falls to nothing, or by
    ``LEAST_SCORE`` below its best; a stretch goes from the start to the best place.
    """
    zero, first = F.lit(0.0), F.lit(0)
    start = F.struct(first.alias("at"), first.alias("from"), zero.alias("sum"), first.alias("to"), zero.alias("best"))

    def closed(s: Column) -> Column:
        steps = s["to"] - s["from"]
        good = (steps + 1 >= LEAST_RUN) & (s["best"] + LEAST_STEP * steps >= LEAST_SCORE)
        return F.when(good, F.struct(s["from"].alias("start"), (s["to"] + 1).alias("end")))

    def step(s: Column, ratio: Column) -> tuple[Column, Column]:
        at, total = s["at"] + 1, s["sum"] + ratio - LEAST_STEP
        ends = (total <= 0) | (total < s["best"] - LEAST_SCORE)
        up = total > s["best"]
        after = F.struct(
            at.alias("at"),
            F.when(ends, at).otherwise(s["from"]).alias("from"),
            F.when(ends, 0.0).otherwise(total).alias("sum"),
            F.when(ends | up, at).otherwise(s["to"]).alias("to"),
            F.when(ends, 0.0).when(up, total).otherwise(s["best"]).alias("best"),
        )
        return after, F.when(ends, closed(s))

    return let(ratios_of(value, table), lambda x: scan(x, start, step, PART, closed))


def is_random(value: Column, table: list[float]) -> Column:
    return let(score(value, table), lambda x: (x >= LEAST_SCORE) & (x >= LEAST_STEP * (F.length(value) - 1)))


def random_parts(value: Column, table: list[float]) -> Column:
    """Array of (start, end): the whole piece if it is a secret, else what between / _ - = or anywhere is one.

    Parts that overlap or meet are one.
    """
    tokens = F.filter(matches(value, rf"[A-Za-z0-9+]{{{LEAST_RUN},}}", "random"), lambda m: is_random(m["value"], table))
    found = F.sort_array(F.concat(F.transform(tokens, lambda m: F.struct(m["start"], m["end"])), stretches(value, table)))
    nothing = F.lit(None).cast("int")

    def open_part(s: Column) -> Column:
        return F.when(s["end"].isNotNull(), s)

    def step(s: Column, part: Column) -> tuple[Column, Column]:
        apart = s["end"].isNull() | (s["end"] < part["start"])
        joined = F.struct(s["start"].alias("start"), F.greatest(s["end"], part["end"]).alias("end"))
        return F.when(apart, part).otherwise(joined), F.when(apart, open_part(s))

    first = F.struct(nothing.alias("start"), nothing.alias("end"))
    joined_parts = let(found, lambda x: scan(x, first, step, PART, open_part))
    whole_piece = F.array(F.struct(F.lit(0).alias("start"), F.length(value).alias("end")))
    return F.when(is_random(value, table), whole_piece).otherwise(joined_parts)


def find_secrets(df: DataFrame, table: list[float], text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``df`` with its spans: array of (start, end, kind, value), ordered by start, then kind.

    Runs are cut at the edges of the fixed forms; what the models take for random in the pieces, whole
    or a stretch behind or before ordinary words, is added as ``random``.
    """
    df = replace_columns(df, [spans_col]) if spans_col != text_col else df
    base, runs, chunks = fresh(df, "base_spans"), fresh(df, "scored_runs"), fresh(df, "text_chunks")
    t = whole(text_col)
    run = rf"{RUN}{{{LEAST_RUN},}}"
    df2 = df.withColumns({base: base_spans(t), runs: matches(t, run, "random"), chunks: F.when(t.rlike(run), chunks_of(t))})

    def both(s: Column) -> Column:
        def placed(piece: Column) -> Column:
            def one(p: Column) -> Column:
                start, end = piece["start"] + p["start"], piece["start"] + p["end"]
                value = cut(s["chunks"], start, end)
                return F.struct(start.alias("start"), end.alias("end"), F.lit("random").alias("kind"), value.alias("value"))

            parts = let(cut(s["chunks"], piece["start"], piece["end"]), lambda v: random_parts(v, table))
            return F.transform(parts, one)

        return in_order(F.concat(s["base"], F.flatten(F.transform(outside(s["runs"], s["base"]), placed))))

    spans = let(F.struct(F.col(base).alias("base"), F.col(runs).alias("runs"), F.col(chunks).alias("chunks")), both)
    return df2.withColumn(spans_col, F.when(F.size(F.col(runs)) > 0, spans).otherwise(F.col(base))).drop(base, runs, chunks)
