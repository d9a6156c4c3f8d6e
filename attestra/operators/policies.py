"""Selection policies, bounds and resampling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.prob import CLIP


def survivors(rows: DataFrame, key: str, loss: float, seed: int) -> DataFrame:
    """Drops floor(n * loss) keys, first in the order of the digest of "seed:key". For reference tables of bounded size."""
    order = W.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), key)
    ranked = rows.select("*", F.row_number().over(order).alias("_r"), F.count(F.lit(1)).over(W.partitionBy()).alias("_n"))
    return ranked.where(F.col("_r") > F.floor(F.col("_n") * loss)).drop("_r", "_n")


def shrunken(rows: DataFrame, by: list[str], wrong: str, weight: float) -> DataFrame:
    """Rates by bin, shrunk towards the overall rate (1 + wrong) / (n + 2); the prior is one row."""
    k = F.count(F.when(F.col(wrong), 1))
    prior = rows.agg(((1 + k) / (F.count(F.lit(1)) + 2)).alias("_q"))
    bins = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), k.alias("_k")).join(F.broadcast(prior))
    return bins.select(*by, "n", F.round((F.col("_k") + weight * F.col("_q")) / (F.col("n") + weight), 6).alias("risk"))


def drawn_sums(stats: DataFrame, group: str, columns: list[str], draws: int) -> DataFrame:
    """draw, and the sum of each column over the groups under Poisson(1) weights, in each of `draws` draws (a multiple of 16).

    A weight comes from 16 bits of the SHA-256 of "group:block", with 16 draws to a block, so it doesn't depend on partitions
    or order. Each task multiplies its groups' weights with their sums as matrices, and gives one row for each draw.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.lit(draws // 16 - 1)), lambda i: F.unhex(F.sha2(F.concat(F.col(group), F.lit(":"), i.cast("string")), 256)))
    bits = stats.select(F.aggregate(blocks, F.lit(b"").cast("binary"), lambda s, x: F.concat(s, x)).alias("bits"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    total, term, steps = 0.0, math.exp(-1), []
    for i in range(1, 8):
        total += term
        term /= i
        steps.append(total)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((draws, len(columns)))
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                u = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u2").reshape(-1, draws) / 65536.0
                x = np.asarray(batch.column(1).flatten()).reshape(-1, len(columns))
                out += np.searchsorted(steps, u, side="right").astype(np.float64).T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws, dtype=np.int32)), *[pa.array(c) for c in out.T]], names=["draw", *columns])

    each = bits.mapInArrow(multiply, "draw int, " + ", ".join(f"{c} double" for c in columns))
    return each.groupBy("draw").agg(*[F.sum(c).alias(c) for c in columns])


def binomial_upper(k: int, n: int, alpha: float, empty: float | None = None) -> float | None:
    """One-sided Clopper-Pearson upper bound of an error rate; `empty` for n = 0, by bisection on log-gamma sums."""
    if n == 0:
        return empty
    if k >= n:
        return 1.0
    if k == 0:
        return 1 - alpha ** (1 / n)

    def tail(p: float) -> float:
        lp, lq = math.log(p), math.log1p(-p)
        terms = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * lp + (n - i) * lq for i in range(k + 1)]
        top = max(terms)
        return math.exp(top) * sum(math.exp(t - top) for t in terms)

    lo, hi = k / n, 1.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if tail(mid) > alpha else (lo, mid)
    return hi


def zero_error_sample_size(risk: float, alpha: float) -> int:
    """Least number of rows without an error that shows a rate below `risk`."""
    return math.ceil(math.log(alpha) / math.log1p(-risk))


def certified_threshold(grid: DataFrame, by: str, threshold: str, n: str, wrong: str, risk: float, alpha: float) -> DataFrame:
    """The least threshold of each policy whose upper bound is at most `risk`, at alpha over the size of its grid; null if none."""

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        level = alpha / len(group)
        fit = [(t, m, b) for t, m, k in zip(group[threshold], group[n], group[wrong], strict=True) if (b := binomial_upper(int(k), int(m), level)) is not None and b <= risk]
        best = min(fit, default=(None, 0, None))
        return pd.DataFrame({by: [group[by].iloc[0]], "threshold": [best[0]], "accepted": [best[1]], "bound": [None if best[2] is None else round(best[2], 6)]})

    return grid.groupBy(by).applyInPandas(choose, f"{by} string, threshold double, accepted bigint, bound double")


def admit_budget(rows: DataFrame, by: list[str], key: str, score: str, budget: float) -> DataFrame:
    """Admits rows by falling score (ties by key) while the group's summed 1 - score is within budget; others are skipped.

    The walk is sequential within a group, so groups are laid out sorted and streamed: a task holds one batch and a sum, never
    a group.
    """
    fits = rows.where(1 - F.col(score) <= budget + 1e-12)
    laid = fits.repartition(*by).sortWithinPartitions(*by, F.desc(score), key)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, spent = None, 0.0
        for batch in batches:
            keep = []
            for own, s in zip(batch[by].itertuples(index=False, name=None), batch[score], strict=True):
                if own != group:
                    group, spent = own, 0.0
                ok = spent + (1 - s) <= budget + 1e-12
                spent += (1 - s) if ok else 0.0
                keep.append(ok)
            yield batch[keep]

    return laid.mapInPandas(walk, fits.schema)


def fit_temperature(rows: DataFrame, by: str, p: str, gold_is_positive: str) -> DataFrame:
    """Temperature by golden section on log T in [ln 0.05, ln 20], all arms at once: each step is one aggregation over the
    rows at two temperatures for each arm. Stops when the bracket is 1e-4 wide."""
    ratio = (math.sqrt(5) - 1) / 2
    spark = rows.sparkSession
    arms = [r[0] for r in rows.select(by).distinct().collect()]  # policies, not rows
    brackets = {a: (math.log(0.05), math.log(20.0)) for a in arms}

    def loss(points: dict[str, list[float]]) -> dict[tuple[str, int], float]:
        at = spark.createDataFrame([(a, i, math.exp(x)) for a, xs in points.items() for i, x in enumerate(xs)], f"{by} string, i int, t double")
        z = (F.log(F.greatest(F.col(p), F.lit(CLIP))) - F.log(F.greatest(1 - F.col(p), F.lit(CLIP)))) / F.col("t")
        z = F.when(F.col(gold_is_positive), z).otherwise(-z)
        nll = F.greatest(-z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
        return {(r[by], r["i"]): r["l"] for r in rows.join(F.broadcast(at), by).groupBy(by, "i").agg(F.avg(nll).alias("l")).collect()}  # two rows an arm

    while arms and max(b - a for a, b in brackets.values()) > 1e-4:
        points = {k: [b - ratio * (b - a), a + ratio * (b - a)] for k, (a, b) in brackets.items()}
        got = loss(points)
        for k, (a, b) in brackets.items():
            brackets[k] = (a, points[k][1]) if got[k, 0] <= got[k, 1] else (points[k][0], b)
    return spark.createDataFrame([(k, round(math.exp((a + b) / 2), 4)) for k, (a, b) in sorted(brackets.items())], f"{by} string, temperature double")


def decide(requests: DataFrame, backend, schema: T.StructType) -> DataFrame:
    """Runs a decision backend over requests in Arrow batches. `backend(rows: DataFrame) -> DataFrame` may fail for a row only
    by an error column; an exception of a whole batch becomes an ERROR for each of its rows, never a fallback answer."""
    names = [f.name for f in schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                out = backend(batch)
            except Exception as e:  # noqa: BLE001  a backend may raise anything
                out = batch.assign(error=f"{type(e).__name__}: {e}")
            for name in names:
                if name not in out:
                    out[name] = None
            yield out[names]

    return requests.mapInPandas(run, schema)
