"""Mixing: shares, caps, the Poisson distribution, and the edges."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from relgrain.llm.bpe import encoder  # noqa: E402
from relgrain.llm.encode import vocabulary  # noqa: E402
from relgrain.llm.mixing import mix, mix_report, poisson_cdf, solve_rate  # noqa: E402


def test_poisson():
    cdf = poisson_cdf(2.5, 10)
    assert cdf[3] == pytest.approx(sum(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(4)))
    assert poisson_cdf(0.0, 2) == [1.0, 1.0, 1.0] and poisson_cdf(2000.0, 3)[3] == pytest.approx(0.0)


@pytest.mark.parametrize(("share", "cap"), [(0.3, 1), (0.9, 1), (1.5, 2), (2.5, 3), (0.01, 5)])
def test_rate_meets_the_target(share, cap):
    r = np.random.default_rng(1)
    u, size = r.random(20_000), r.integers(1, 500, 20_000)
    bins = np.bincount((u * 4096).astype(int), size, 4096)
    rate = solve_rate("s", bins, share * size.sum(), cap)
    n = (u[:, None] >= np.array(rate.steps)).sum(axis=1)
    assert n.max() <= cap and (n * size).sum() == pytest.approx(share * size.sum(), abs=cap * bins.max())


def test_rate_at_the_edges():
    tokens = np.full(4096, 10)
    assert solve_rate("s", tokens, 2 * tokens.sum(), 2).steps == (0.0, 0.0)  # all, as often as allowed
    assert solve_rate("s", tokens, 99 * tokens.sum(), 2).mean == math.inf
    assert solve_rate("s", tokens, 0, 2).steps == () == solve_rate("s", tokens, 5, 0).steps == solve_rate("s", tokens * 0, 5, 3).steps


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randrange(1, 60)))
    rows = [(i, r.choice(["big"] * 12 + ["mid"] * 4 + ["small", "other", None]), text()) for i in range(3000)]
    rows += [(9001, "big", None), (9002, "big", ""), (9003, None, "x"), (9004, "mid", "long " * 20_000)]
    docs = spark.createDataFrame([(*x, 1, "n") for x in rows], "doc_id long, source string, text string, copy int, n_tokens string").repartition(5)
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.15, 2), ("gone", 0.05, 9), (None, 0.5, 1), ("big", 0.4, 1)], "source string, target_share double, max_repeats int")
    return rows, docs, targets


def test_shares_and_caps(spark, tables):
    rows, docs, targets = tables
    count = encoder(vocabulary()).count
    have = Counter()
    for _, s, t in rows:
        if s in ("big", "mid", "small"):
            have[s] += count(t)
    total = sum(have.values())
    report = {r["source"]: r for r in mix_report(docs, targets, vocabulary()).collect()}
    assert set(report) == {"big", "mid", "small", "gone"} and report["gone"]["tokens"] == 0
    assert {s: report[s]["tokens_available"] for s in have} == dict(have)
    for s, share, cap in (("big", 0.4, 1), ("mid", 0.4, 3), ("small", 0.15, 2)):
        want = min(share * total, cap * have[s])
        assert report[s]["tokens"] == pytest.approx(want, abs=max(0.05 * want, 200) + 25_000 * (s == "mid"))
        assert report[s]["most_copies"] <= cap
    mixture = mix(docs, targets, vocabulary()).collect()
    n = Counter(r["doc_id"] for r in mixture)
    by = Counter()
    source = {i: (s, t) for i, s, t in rows}
    for r in mixture:
        assert (r["source"], r["text"]) == source[r["doc_id"]]
        by[r["source"]] += count(r["text"])
    assert dict(by) == {s: report[s]["tokens"] for s in report if report[s]["tokens"]}
    assert all(sorted(r["copy"] for r in mixture if r["doc_id"] == i) == list(range(1, k + 1)) for i, k in list(n.items())[:20])
    order = [r["doc_id"] for r in mixture]
    assert order != sorted(order) and [r["doc_id"] for r in mix(docs, targets, vocabulary()).collect()] == order  # shuffled, and the same again


def test_nothing_to_mix(spark, tables):
    _, docs, targets = tables
    assert mix(docs.limit(0), targets, vocabulary()).count() == 0 and mix(docs, targets.limit(0), vocabulary()).count() == 0
    empty = mix_report(docs.limit(0), targets, vocabulary()).collect()
    assert {r["source"]: r["actual_share"] for r in empty} == dict.fromkeys(("big", "mid", "small", "gone"))


def test_more_sources_than_are_broadcast(spark):
    """Eleven thousand sources: rates are solved where the sums are, and joined with a salt."""
    docs = spark.range(30_000).selectExpr("id as doc_id", "case when id < 10000 then 'hot' else concat('s', id % 11000) end as source", "'a b c' as text")
    targets = spark.range(11_000).selectExpr("concat('s', id) as source", "0.5 / 11000 as target_share", "3 as max_repeats").unionByName(spark.sql("select 'hot' as source, 0.5 as target_share, 3 as max_repeats"))
    out = mix(docs, targets, vocabulary())
    by = {r["source"] == "hot": r["n"] for r in out.groupBy("source").count().withColumnRenamed("count", "n").groupBy((F.col("source") == "hot").alias("h")).agg(F.max(F.when(F.col("source") == "hot", "hot").otherwise("")).alias("source"), F.sum("n").alias("n")).collect()}
    assert by[True] == pytest.approx(15_000, rel=0.02) and by[False] > 0 and out.filter("copy > 3").count() == 0


def test_rates_of_any_size():
    tokens = np.full(4096, 1)
    rate = solve_rate("s", tokens, 39_000 * tokens.sum(), 40_000)
    assert rate.mean == pytest.approx(39_000, rel=0.01) and len(rate.steps) == 40_000
