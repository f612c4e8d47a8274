"""Quality of a low-dimensional encoding against the vectors it came from.

``m`` sampled query rows are compared with all rows. Only the queries travel to the tasks, their
number is a parameter; a task sends on its k best per query, then counts. The m x n distances are
never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.operators.folds import sample_rows


def _distances(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    sq = (queries**2).sum(1)[:, None] - 2 * queries @ rows.T + (rows**2).sum(1)[None, :]
    return np.sqrt(np.maximum(sq, 0.0))


def encoding_quality(df: DataFrame, original: str, code: str, m: int = 100, k: int = 10, key: str = "hex_code", seed: int = 42) -> DataFrame:
    """One row: residual variance, trustworthiness and continuity at k neighbours."""
    picked = sample_rows(df.select(key, original, code), [key], m, seed).toPandas().sort_values(key)
    ids = picked[key].to_numpy()
    qa, qb = np.stack(picked[original].to_numpy()), np.stack(picked[code].to_numpy())
    rows = df.select(key, original, code)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            da = _distances(qa, np.stack(pdf[original].to_numpy()))
            db = _distances(qb, np.stack(pdf[code].to_numpy()))
            own = ids[:, None] == pdf[key].to_numpy()[None, :]
            da[own], db[own] = np.inf, np.inf
            for space, dist in (("a", da), ("b", db)):
                top = np.argsort(dist, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(ids)), top.shape[1])
                t = top.ravel()
                yield pd.DataFrame(
                    {"q": q, "space": space, "id": pdf[key].to_numpy()[t], "a": da[q, t], "b": db[q, t]}
                )

    best = rows.mapInPandas(near, "q int, space string, id long, a double, b double")
    by_space = F.when(F.col("space") == "a", F.col("a")).otherwise(F.col("b"))
    top = (
        best.groupBy("q", "space")
        .agg(F.slice(F.sort_array(F.collect_list(F.struct(by_space.alias("d"), "id", "a", "b"))), 1, k).alias("t"))
        .select("q", "space", F.inline("t"))
        .toPandas()
    )
    # m * k neighbours per space; each needs its rank in the other space.
    tq, ts = top["q"].to_numpy(), top["space"].to_numpy()
    ta, tb = top["a"].to_numpy(), top["b"].to_numpy()

    def closer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            da = _distances(qa, np.stack(pdf[original].to_numpy()))
            db = _distances(qb, np.stack(pdf[code].to_numpy()))
            own = ids[:, None] == pdf[key].to_numpy()[None, :]
            da[own], db[own] = np.inf, np.inf
            for i in range(len(tq)):
                other, limit = (db, tb[i]) if ts[i] == "a" else (da, ta[i])
                yield pd.DataFrame({"i": [i], "n": [int((other[tq[i]] < limit).sum())]})
            fa, fb = da[~own], db[~own]
            sums = [len(fa), fa.sum(), fb.sum(), (fa * fb).sum(), (fa * fa).sum(), (fb * fb).sum()]
            yield pd.DataFrame({"i": range(-1, -7, -1), "n": sums})

    got = rows.mapInPandas(closer, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).toPandas()
    value = dict(zip(got["i"], got["n"], strict=True))
    n_pairs, sa, sb, sab, saa, sbb = (value[i] for i in range(-1, -7, -1))
    cov = sab / n_pairs - sa * sb / n_pairs**2
    corr = cov / np.sqrt((saa / n_pairs - (sa / n_pairs) ** 2) * (sbb / n_pairs - (sb / n_pairs) ** 2))
    n = n_pairs / len(ids) + 1
    ranks = np.array([value[i] + 1 for i in range(len(tq))])
    norm = 2.0 / (len(ids) * k * (2 * n - 3 * k - 1))

    def score(space: str) -> float:
        return float(1 - norm * np.maximum(ranks[ts == space] - k, 0).sum())

    return df.sparkSession.createDataFrame(
        [(float(1 - corr**2), score("b"), score("a"))],
        "residual_variance double, trustworthiness double, continuity double",
    )
