"""Mixing sources to target shares of the tokens by Poisson replication."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, looked_up, shuffle_partitions
from .encode import token_counts

#: The unit interval of the documents' hashes is cut into so many bins; a source's rate is solved on its token sums by bin.
BINS = 4096


def uniform(key: str, seed: int) -> Column:
    """A hash of the key as a number in [0, 1), the same in every run."""
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(seed)), 11).cast("double") / float(1 << 53)


def poisson_cdf(mean: float, upto: int) -> list[float]:
    """P(X <= 0), ..., P(X <= upto)."""
    out, total = [], 0.0
    for k in range(upto + 1):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        out.append(min(total, 1.0))
    return out


@dataclass(frozen=True)
class Rate:
    """For one source: a document with hash u is used as often as there are ``steps`` not above u."""

    source: str
    mean: float
    steps: tuple[float, ...]


def solve_rate(source: str, tokens: np.ndarray, target: float, cap: int) -> Rate:
    """The Poisson mean at which the capped copies of the source's documents come to ``target`` tokens.

    ``tokens`` has the tokens of the documents whose hash is in each bin. The number of copies of a document, the
    inverse of the Poisson distribution at its hash, does not fall as the mean grows; so the sum over the documents
    there are, not only its expectation, is solved for, and capping is allowed for; what is left is at most the tokens
    of ``cap`` bins, one in 4096 of the source's tokens each on average. Where even ``cap`` copies of all
    documents don't reach the target, all are used ``cap`` times.
    """
    above = np.concatenate([np.cumsum(tokens[::-1])[::-1], [0]]).astype(float)  # from each bin's lower border on

    def total(mean: float) -> float:
        steps = np.array(poisson_cdf(mean, cap - 1))
        return float(np.interp(steps * len(tokens), np.arange(len(above)), above).sum())

    if target <= 0 or cap <= 0 or not tokens.sum():
        return Rate(source, 0.0, ())
    if target >= cap * tokens.sum():
        return Rate(source, math.inf, (0.0,) * cap)
    low, high = 0.0, 1.0
    while total(high) < target:  # it ends: nearly all copies are made as the mean grows
        high *= 2
    for _ in range(80):
        mean = (low + high) / 2
        low, high = (mean, high) if total(mean) < target else (low, mean)
    return Rate(source, high, tuple(poisson_cdf(high, cap - 1)))


@dataclass(frozen=True)
class Mix:
    rates: DataFrame  #: source, target_share, max_repeats, mean, steps; a row for each listed source
    tokens: DataFrame  #: doc_id, source, n_tokens, u of the listed sources' documents
    total: int  #: tokens of all of them


_RATES = "source string, target_share double, max_repeats int, mean double, steps array<double>"


def _solver(total: int):
    """One source's rate from its row of the list and its sums of at most ``BINS`` bins."""

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for r in left.to_pylist():
            tokens = np.zeros(BINS, np.int64)
            np.add.at(tokens, right.column("bin").to_numpy(), right.column("n").to_numpy())
            share, cap = r["target_share"] or 0.0, r["max_repeats"] or 0
            rate = solve_rate(r["source"], tokens, share * total, cap)
            out.append({"source": r["source"], "target_share": share, "max_repeats": cap, "mean": rate.mean, "steps": list(rate.steps)})
        schema = pa.schema([("source", pa.string()), ("target_share", pa.float64()), ("max_repeats", pa.int32()), ("mean", pa.float64()), ("steps", pa.list_(pa.float64()))])
        return pa.Table.from_pylist(out, schema)

    return solve


def plan_mix(documents: DataFrame, targets: DataFrame, path: str, seed: int = 1, keep: bool = False) -> Mix:
    """Rates at which the listed sources' documents are to be repeated.

    Sizes are tokens of the whole texts, none for empty and null ones. The total to be shared out is what all
    documents of the listed sources hold. Texts are counted once, as this function is called; what is written as a
    checkpoint is the sums of at most ``BINS`` bins for each source and, with ``keep``, a row for each document. Rates are
    solved source by source where the sums are; the driver gets the total. A source listed twice counts once, with its
    largest share and cap. Rows without source are not listed.
    """
    listed = targets.filter(F.col("source").isNotNull()).groupBy("source")
    listed = listed.agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    named = looked_up(documents.select("doc_id", "source", "text"), listed.select("source"), "source", spread="doc_id")
    tokens = token_counts(named, path).withColumn("u", uniform("doc_id", seed))
    tokens = checkpoint(tokens) if keep else tokens
    sums = checkpoint(tokens.groupBy("source", F.floor(F.col("u") * BINS).cast("int").alias("bin")).agg(F.sum("n_tokens").alias("n")))
    total = sums.agg(F.sum("n")).first()[0] or 0
    return Mix(listed.groupBy("source").cogroup(sums.groupBy("source")).applyInArrow(_solver(total), _RATES), tokens, total)


def copies(u: Column, steps: Column) -> Column:
    return F.size(F.filter(steps, lambda s: s <= u))


def mix(documents: DataFrame, targets: DataFrame, path: str, seed: int = 1) -> DataFrame:
    """``doc_id, copy, source, text`` of the mixture, in an order that is random over the whole.

    Copies of a document are numbered from 1. The order is that of a hash of document, copy and seed: copies are sent
    to partitions by it and sorted within. A document's copies follow from its own hash and the rate of its source,
    which is broadcast if the sources are few (``looked_up``), so the texts are shuffled once.
    """
    rates = plan_mix(documents, targets, path, seed).rates
    rows = looked_up(documents.select("doc_id", "source", "text"), rates.select("source", "steps"), "source", spread="doc_id")
    n = copies(uniform("doc_id", seed), F.col("steps"))
    rows = rows.withColumn("copy", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))))
    place = F.xxhash64("doc_id", "copy", F.lit(seed + 1))
    rows = rows.select("doc_id", "copy", "source", "text", place.alias("__place"))
    return rows.repartition(shuffle_partitions(documents.sparkSession), "__place").sortWithinPartitions("__place", "doc_id", "copy").drop("__place")


def mix_report(documents: DataFrame, targets: DataFrame, path: str, seed: int = 1) -> DataFrame:
    """A row for each listed source: what it was to contribute and what it really does.

    ``source, target_share, max_repeats, documents, tokens_available, mean_rate, documents_used, copies, most_copies,
    tokens, actual_share``; the last is of all tokens of the mixture, null if that is empty.
    """
    plan = plan_mix(documents, targets, path, seed, keep=True)
    n = copies(F.col("u"), F.col("steps")).cast("bigint")
    used = looked_up(plan.tokens, plan.rates.select("source", "steps"), "source", spread="doc_id").withColumn("n", n)
    sums = used.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("n_tokens").alias("tokens_available"),
        F.count_if(F.col("n") > 0).alias("documents_used"),
        F.sum("n").alias("copies"),
        F.max("n").alias("most_copies"),
        F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"),
    )
    numbers = [c for c in sums.columns if c != "source"]
    out = plan.rates.join(sums, "source", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in numbers})
    total = out.agg(F.sum("tokens")).first()[0] or 0
    share = F.col("tokens") / F.lit(total) if total else F.lit(None).cast("double")
    return out.select("source", "target_share", "max_repeats", "documents", "tokens_available", F.col("mean").alias("mean_rate"), "documents_used", "copies", "most_copies", "tokens", share.alias("actual_share"))
