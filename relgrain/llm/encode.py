"""Token ids of a whole corpus by a public byte-level BPE vocabulary."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import check_supported, encoder


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public vocabulary is; a path of one's own can be given to every operator instead."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(16)
def check_vocabulary(path: str) -> None:
    with open(path, encoding="utf-8") as f:
        check_supported(json.load(f))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """The columns of ``df`` but ``text``, and ``ids``: the token ids of the whole text, without special tokens.

    An empty and a null text have no ids. Strings of special tokens in a text are ordinary text. A row of any length
    is encoded whole. A column of ``df`` named as the result is replaced by it. Narrow: nothing is shuffled. A vocabulary
    that is not byte-level BPE, or that says to normalize or split texts otherwise, is an error.
    """
    check_vocabulary(path)
    kept = [c for c in df.columns if c not in (text, ids)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = encoder(path).encode_packed
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            parts = [packed(t) if t else b"" for t in texts]
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(p) // 4 for p in parts], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(parts), np.int32))
            if offsets[-1] < 2**31:
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)
            else:
                lists = pa.LargeListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), lists], [*kept, ids])

    types = dict(df.dtypes)
    return df.select(*kept, text).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{ids}` array<int>"]))


def token_counts(df: DataFrame, path: str, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """The columns of ``df`` but ``text``, and the number of tokens of the whole text; 0 for an empty or null one."""
    check_vocabulary(path)
    kept = [c for c in df.columns if c not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path).count
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            n = pa.array([count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), n], [*kept, out])

    types = dict(df.dtypes)
    return df.select(*kept, text).mapInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{out}` bigint"]))
