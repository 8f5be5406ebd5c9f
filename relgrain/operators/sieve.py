"""A sieve of keys: a bitmap of bounded size that tells before a shuffle which rows can't have a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of 64 bits: the sieve never has more rows than that, 16 bytes each, however many keys there are.
WORDS = 1 << 19


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(words)).cast("bigint")


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int"))


def sieve(keys: DataFrame, key: str, words: int = WORDS) -> DataFrame:
    """``__word, __bits`` of the hashes of the keys that are not null: at most ``words`` rows, combined before the shuffle."""
    h = F.xxhash64(key)
    return keys.filter(F.col(key).isNotNull()).select(_word(h, words).alias("__word"), _bit(h).alias("__b")).groupBy("__word").agg(F.bit_or("__b").alias("__bits"))


def sifted(rows: DataFrame, sieve: DataFrame, key: str, words: int = WORDS, always: Column | None = None) -> DataFrame:
    """The rows whose key may be in the sieve, and those for which ``always`` is true; never fewer than belong there.

    The sieve is broadcast, which its number of words bounds. Where keys are so many that its bits are all set, every
    row passes, and what follows is an ordinary join.
    """
    h = F.xxhash64(key)
    there = (F.col("__bits").bitwiseAND(_bit(h)) != 0) & F.col(key).isNotNull()
    passes = F.coalesce(there, F.lit(False))
    found = rows.withColumn("__at", F.when(F.col(key).isNotNull(), _word(h, words)))
    found = found.join(F.broadcast(sieve), F.col("__at") == F.col("__word"), "left" if always is not None else "inner")
    return found.filter(passes | F.coalesce(always, F.lit(False)) if always is not None else passes).drop("__at", "__word", "__bits")
