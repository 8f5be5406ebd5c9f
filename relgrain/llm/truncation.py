"""Texts that stop before their message does, and how often each source cuts them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sieve import sieve, sifted
from ..session import checkpoint, looked_up
from .messages import ending, words

#: Measures of a text; any size can be a limit.
_MEASURES = ("chars", "bytes", "body_chars", "body_bytes", "lines")
_ENDINGS = pa.schema(
    [("doc_id", pa.int64()), *((c, pa.string()) for c in ("source", "structure", "token", "pair")), ("bare", pa.bool_()), ("prose", pa.bool_()), ("whole", pa.bool_()), *((c, pa.int64()) for c in _MEASURES)]
)
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean"}


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names))


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, source, text in _columns(batch, "doc_id", "source", "text"):
            end = ending(text)
            if end is None:
                rows.append((doc_id, source, None, None, None, False, False, False, *[None] * len(_MEASURES)))
            else:
                rows.append((doc_id, source, end.structure, end.token, end.pair, end.bare, end.prose, end.whole, len(text), len(text.encode("utf-8", "replace")), end.body_chars, end.body_bytes, text.count("\n") + 1))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ENDINGS)], schema=_ENDINGS)


def scan_endings(documents: DataFrame) -> DataFrame:
    """A row per document on how its whole text ends, written as a checkpoint; small beside the texts."""
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return checkpoint(rows.mapInArrow(_endings, ", ".join(f"{f.name} {_SQL[f.type]}" for f in _ENDINGS)))


def _counted(held: int = 300_000, letters: int = 1 << 26):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pairs, read = Counter(), Counter(), 0

        def tally() -> pa.RecordBatch:
            found = [*counts.items(), *((f"{a} {b}", n) for (a, b), n in pairs.items())]
            counts.clear()
            pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

        for batch in batches:
            for (text,) in _columns(batch, "text"):
                if text and text.strip():
                    read += len(text)
                    for found in words(text):
                        counts.update(found)
                        pairs.update(zip(found, found[1:]))
            if len(counts) + len(pairs) >= held or read >= letters:
                yield tally()
                read = 0
        if counts:
            yield tally()

    return run


def count_words(documents: DataFrame) -> DataFrame:
    """``word, n``: the words and pairs of words of all whole texts, as the tasks counted them, to be summed by word.

    Words are those of the decoded texts. The words with which texts stop are not counted.
    """
    return documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted(), "word string, n bigint")


def last_words(endings: DataFrame) -> DataFrame:
    """``last, ends, sizes``: the words and pairs with which texts end, each once, how many do and of how many different
    sizes they are; written as a checkpoint."""
    by_size = endings.select(F.explode(F.array("token", "pair")).alias("last"), "chars").filter("last is not null").groupBy("last", "chars").agg(F.count("*").alias("n"))
    return checkpoint(by_size.groupBy("last").agg(F.sum("n").alias("ends"), F.count("*").alias("sizes")))


def trie_nodes(counted: DataFrame, lasts: DataFrame, known_from: int = 3) -> DataFrame:
    """The nodes at which texts end of the trie of all words and pairs: ``prefix, n, below, below_n``.

    ``n`` is how often the node itself was seen within texts, null if it is no word or pair; ``below`` counts the known
    words and pairs that go on from it and ``below_n`` how often they were seen. Known is what was seen at least
    ``known_from`` times. A pair's nodes begin within its second word.

    Prefixes are made where the words were counted, of the lengths that last words have, and pass a sieve of the last
    words before anything is shuffled; so what is shuffled goes with the last words, not with the vocabulary. Words may
    be of any length. The driver gets the distinct lengths.
    """
    sizes = [r[0] for r in lasts.select(F.length("last").alias("size")).distinct().collect()]
    if not sizes:
        sizes = [0]
    first = F.instr("word", " ")
    size = F.explode(F.filter(F.lit(sorted(sizes)), lambda k: (k > first) & (k <= F.length("word"))))
    prefixes = counted.select("word", "n", size.alias("size")).select("word", "n", F.substring("word", F.lit(1), F.col("size")).alias("prefix"))
    words = sifted(prefixes, sieve(lasts, "last"), "prefix").groupBy("prefix", "word").agg(F.sum("n").alias("n"))
    whole = F.col("prefix") == F.col("word")
    known = ~whole & (F.col("n") >= known_from)
    return words.groupBy("prefix").agg(F.max(F.when(whole, F.col("n"))).alias("n"), F.count_if(known).alias("below"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("below_n"))


def cut_ends(lasts: DataFrame, nodes: DataFrame, goes_on_from: int = 10, ends_at_most: float = 0.02, pieces_at_most: float = 0.005, closes_from: int = 10, closes_at_least: float = 0.1, word_closes_at_least: float = 0.5) -> DataFrame:
    """Last words and pairs, each once, that tell a cut or its absence: ``last, unknown_prefix, goes_on, closes, settled``.

    ``unknown_prefix``: the trie knows something that it is a proper prefix of, and it was itself seen no more often
    than pieces of that are: texts quote others that were cut, so pieces come up the more the larger the corpus, at
    most ``pieces_at_most`` of the times that what goes on from them does, give or take twice the root of that number.
    ``goes_on``: a pair that is seen ``goes_on_from`` times within texts and next to never at their end. ``closes``: a
    pair that ``closes_from`` texts end with, ``closes_at_least`` of the times that it is seen within texts, as with the
    last line of a footer, or a word that so many end with, ``word_closes_at_least`` of those times, as with "and so
    on"; ``settled`` if those texts are of several sizes, so that no limit can have made them end so.
    The shares decide in a corpus of any size; the numbers of times only keep what was hardly
    ever seen from deciding anything.
    """
    seen = lasts.join(nodes, F.col("last") == F.col("prefix"), "left")
    goes_on = F.contains("last", F.lit(" ")) & (F.col("n") >= goes_on_from) & (F.col("ends") <= F.greatest(F.lit(1.0), ends_at_most * F.col("n")))
    pieces = pieces_at_most * F.col("below_n")
    unknown = (F.col("below") > 0) & (F.coalesce("n", F.lit(0)) < pieces + 2 * F.sqrt(pieces))
    unknown = F.coalesce(unknown, F.lit(False))
    often = F.when(F.contains("last", F.lit(" ")), closes_at_least).otherwise(word_closes_at_least) * F.coalesce("n", F.lit(0))
    closes = ~unknown & (F.col("ends") >= closes_from) & (F.col("ends") >= often)
    out = seen.select("last", unknown.alias("unknown_prefix"), F.coalesce(goes_on, F.lit(False)).alias("goes_on"), closes.alias("closes"), (closes & (F.col("sizes") > 2)).alias("settled"))
    return out.filter("unknown_prefix or goes_on or closes")


def judged_endings(endings: DataFrame, cut: DataFrame, salts: int = 16) -> DataFrame:
    """The endings with ``unknown_prefix``, ``prose`` as the corpus corrects it, and ``open``: any sign of a cut there is.

    What tells a cut is joined with ``salts`` copies each, so that a word with which many texts end is spread; texts
    that don't end with a word, which are most, match nothing and are spread over all tasks.
    """
    cut = cut.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    words = cut.filter(~F.contains("last", F.lit(" "))).select(F.col("last").alias("token"), "salt", F.col("unknown_prefix").alias("cut_word"), F.col("closes").alias("word_closes"), F.col("settled").alias("word_settled"))
    pairs = cut.filter(F.contains("last", F.lit(" "))).select(F.col("last").alias("pair"), F.col("salt").alias("pair_salt"), F.col("unknown_prefix").alias("cut_pair"), "goes_on", "closes", "settled")
    spread = lambda c: F.pmod(F.xxhash64("doc_id"), F.when(F.col(c).isNull(), 1 << 20).otherwise(salts)).cast("int")
    salted = endings.withColumns({"salt": spread("token"), "pair_salt": spread("pair")})
    out = salted.join(words, ["token", "salt"], "left").join(pairs, ["pair", "pair_salt"], "left")
    unknown = F.coalesce("cut_word", F.lit(False)) | F.coalesce("cut_pair", F.lit(False))
    stops = lambda unless: (F.col("prose") & ~F.coalesce(unless, F.lit(False)) & ~F.coalesce(f"word_{unless}", F.lit(False))) | (F.col("bare") & F.coalesce("goes_on", F.lit(False)))
    signs = unknown | F.col("structure").isNotNull() | stops("settled")
    return out.select("doc_id", "source", "structure", "whole", unknown.alias("unknown_prefix"), stops("closes").alias("prose"), signs.alias("open"), *_MEASURES)


def length_limits(judged: DataFrame, least: int = 3, of_source: float = 2e-4, share: float = 0.2, open_at_least: float = 0.8) -> DataFrame:
    """``source, measure, size, n``: sizes at which a source's texts pile up because longer ones were cut there.

    A cut puts all longer texts at one size, so that size holds much of what is that long or longer: at least
    ``share`` of it, and of the source's texts ``of_source``, at least ``least``. It stands out: it holds five times
    what the ten sizes below hold each. And the texts stop there as cut ones do: of those that don't end with what
    closes their structure, at least ``open_at_least`` end with an unknown proper prefix, within a sentence or with
    their structure open. So a form letter that is always as long is no limit, however short or long it is. A text of
    several such sizes counts for the one whose texts are open most often, and the others must hold without it: where
    all messages are of one line and most are cut at eighty characters, one line is no limit.

    Texts are measured in characters and bytes, with and without their headers, and in lines. A source whose limit
    changed, or that puts a mark where it cuts, has several. Counts per size are combined before the shuffle; the
    running sums are over a source's sizes, which are no more than its longest text is long, not over its texts.
    """
    sizes = judged.select("source", "whole", "open", F.stack(F.lit(len(_MEASURES)), *[x for m in _MEASURES for x in (F.lit(m), F.col(m))]).alias("measure", "size"))
    counts = sizes.filter("size > 0").groupBy("source", "measure", "size").agg(F.count("*").alias("n"), F.count_if(F.col("open") & ~F.col("whole")).alias("open"), F.count_if(~F.col("whole")).alias("may"))
    own = Window.partitionBy("source", "measure")
    longer = F.sum("n").over(own.orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, 0))
    near = F.coalesce(F.sum("n").over(own.orderBy("size").rangeBetween(-10, -1)), F.lit(0))
    out = counts.withColumns({"from_here": longer, "near": near, "all": F.sum("n").over(own)})
    piled = (F.col("n") >= F.greatest(F.lit(float(least)), of_source * F.col("all"))) & (F.col("n") >= share * F.col("from_here")) & (F.col("n") * 2 >= F.col("near"))
    open_too = (F.col("open") > 0) & (F.col("open") >= open_at_least * F.col("may"))
    piles = out.filter(piled & open_too).select("source", "measure", "size", (F.col("open") / F.col("may")).alias("rate"))
    best = _at(judged, piles).filter("at is not null").groupBy("source", F.col("at.measure").alias("measure"), F.col("at.size").alias("size"))
    best = best.agg(F.count("*").alias("n"), F.count_if(F.col("open") & ~F.col("whole")).alias("open"), F.count_if(~F.col("whole")).alias("may"))
    return best.filter((F.col("n") >= least) & open_too).select("source", "measure", "size", "n", (F.col("open") / F.col("may")).alias("rate"))


def _at(judged: DataFrame, limits: DataFrame) -> DataFrame:
    """``judged`` with ``at``: of the limits of its source that a text is at, the one with the highest rate. A source has
    few, since each holds a share of what is above it."""
    named, place = F.coalesce("source", F.lit("\0")), F.array_position(F.array(*map(F.lit, _MEASURES)), F.col("measure"))
    best = F.struct((-F.col("rate")).alias("rate"), place.alias("place"), "measure", "size")
    lists = limits.groupBy(named.alias("__s")).agg(F.sort_array(F.collect_list(best)).alias("limits"))
    out = looked_up(judged.withColumn("__s", named), lists, "__s", "left", spread="doc_id")
    here = F.create_map(*[x for m in _MEASURES for x in (F.lit(m), F.col(m))])
    return out.withColumn("at", F.get(F.filter("limits", lambda x: x["size"] == here[x["measure"]]), F.lit(0))).drop("__s", "limits")


def truncated(documents: DataFrame, known_from: int = 3) -> DataFrame:
    """Every document with the evidence that its text stops before its message does.

    ``doc_id, source, structure, unknown_prefix, at_limit, prose, truncated``. A text is taken as cut if

    * its last word, alone or after the word before it, is a proper prefix of some of the corpus's words and pairs and
      itself unknown or next to never seen beside them, or
    * its size is one at which its source cuts, told by how texts of that size end, and it doesn't end with what closes
      a multipart or markup, or
    * its own structure is unfinished (headers, multipart, markup or a transfer encoding), or
    * it stops within a sentence of running text (``prose``), seen by its last paragraph, unless many texts
      end with its last pair of words, or by a last pair that elsewhere goes on.

    Null, empty and blank texts are not cut. Words and pairs are known, as what pieces are compared with, if seen
    ``known_from`` times other than as the last of a text. The texts are read twice, whole: for how they end, which is
    written as a checkpoint as this function is called, and for the words that their last words begin.
    """
    endings = scan_endings(documents)
    lasts = last_words(endings)
    # What tells a cut is used for words and for pairs, the judged endings for the limits and for each text: each made once.
    cut = checkpoint(cut_ends(lasts, trie_nodes(count_words(documents), lasts, known_from)))
    judged = checkpoint(judged_endings(endings, cut))
    out = _at(judged, length_limits(judged))
    at = F.col("at").isNotNull() & ~F.col("whole")
    verdict = F.col("unknown_prefix") | at | F.col("structure").isNotNull() | F.col("prose")
    return out.select("doc_id", "source", "structure", "unknown_prefix", at.alias("at_limit"), "prose", F.coalesce(verdict, F.lit(False)).alias("truncated"))


def truncation_by_source(documents: DataFrame) -> DataFrame:
    """``source, documents, truncated, share``, how many by each evidence, and how many by that one alone (``only_...``)."""
    signs = {"at_limit": F.col("at_limit"), "unknown_prefix": F.col("unknown_prefix"), "unfinished": F.col("structure").isNotNull(), "in_sentence": F.col("prose")}
    how_many = sum((c.cast("int") for c in signs.values()), F.lit(0))
    by = truncated(documents).withColumn("__signs", how_many).groupBy("source").agg(
        F.count("*").alias("documents"),
        F.count_if("truncated").alias("truncated"),
        *[F.count_if(c).alias(n) for n, c in signs.items()],
        *[F.count_if(c & (F.col("__signs") == 1)).alias(f"only_{n}") for n, c in signs.items()],
    )
    return by.withColumn("share", F.col("truncated") / F.col("documents"))
