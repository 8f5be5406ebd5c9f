"""The prefix encoder against another tokenizer with the same vocabulary, and its appends and edits."""

import base64
import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from relgrain.llm.bpe import EncodedText, encoder, find_pieces  # noqa: E402
from relgrain.llm.encode import encode, token_counts, vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def own():
    return encoder(vocabulary())


@pytest.fixture(scope="module")
def other():
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


TEXTS = st.one_of(st.text(max_size=60), st.text(alphabet="abAB01 '\n\t\r.,é漢 \x1c\x85", max_size=60), st.lists(st.sampled_from(["the", " the", "ing", "  ", "'s", "'LL", "don't", "\n\n", " 123", "=E2=80", "ZXhhbXBsZQ", "😀", "ß"])).map("".join))


@settings(max_examples=300, deadline=None)
@given(TEXTS)
@example("<|endoftext|>")
@example("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa")
@example("a  b \x1f 'x")
def test_ids_are_those_of_another_tokenizer(text):
    own, ref = encoder(vocabulary()), _other()
    assert own.encode(text) == ref.encode_ordinary(text)
    assert own.count(text) == len(ref.encode_ordinary(text)) and "".join(find_pieces(text)) == text


_kept = []


def _other():
    if not _kept:
        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _kept.append(tiktoken.Encoding("other", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _kept[0]


def test_random_letters_and_long_pieces(own, other):
    r = random.Random(4)
    for n in (3, 9, 40, 300):
        for _ in range(60):
            text = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") for _ in range(n))
            assert own.encode(text) == other.encode_ordinary(text)
    long = "".join(r.choice("abcdefgh") for _ in range(100_000))
    assert len(own.encode(long + " ")) == own.count(long) + 1
    assert own.encode(" " * 5000 + "x") == other.encode_ordinary(" " * 5000 + "x")


def test_each_prefix_has_one_last_token(own):
    """The array for a text begins with the arrays of all its prefixes, and each is the encoding of its prefix."""
    text = b"unbelievableness"
    last = own.last_tokens(text)
    for n in range(1, len(text) + 1):
        assert own.last_tokens(text[:n]) == last[:n]
        ids = own.read_back(last[:n])
        assert b"".join(own.token_bytes[i] for i in ids) == text[:n] and ids[-1] == last[n - 1]


@settings(max_examples=150, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 20), TEXTS), max_size=4))
def test_appends_and_edits(text, edits):
    ref, kept = _other(), EncodedText(encoder(vocabulary()), text)
    kept.append(" and more")
    text += " and more"
    assert kept.ids() == ref.encode_ordinary(text)
    for at, n, new in edits:
        at = min(at, len(text))
        kept.edit(at, min(at + n, len(text)), new)
        text = text[:at] + new + text[at + n :]
        assert kept.text == text and kept.ids() == ref.encode_ordinary(text)


def test_an_edit_encodes_little_again(own):
    kept = EncodedText(own, "The quick brown fox jumps over the lazy dog. " * 200)
    kept.edit(4000, 4003, "cat")
    assert kept.redone < 100
    kept.append(" End")
    assert kept.redone < 100 and kept.ids() == own.encode(kept.text)


def test_operator(spark, own):
    rows = [(1, "Hello world", "a"), (2, "", "b"), (3, None, None), (4, " \n", "c"), (5, "x" * 200_000, "d"), (1, "Hello world", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = encode(df, vocabulary())
    assert out.columns == ["doc_id", "ids"] and dict(out.dtypes)["ids"] == "array<int>"
    got = sorted((r["doc_id"], r["ids"]) for r in out.collect())
    assert got == sorted((i, own.encode(t)) for i, t, _ in rows) and got[2][1] == []
    counts = token_counts(df, vocabulary()).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, counts)) == sorted((i, len(own.encode(t))) for i, t, _ in rows)
    assert encode(df.limit(0), vocabulary()).count() == 0
    assert "Exchange" not in encode(spark.createDataFrame(rows, df.schema), vocabulary())._jdf.queryExecution().executedPlan().toString()


def test_other_vocabularies_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Hello")], "doc_id long, text string")
    for f in (encode, token_counts):
        with pytest.raises(ValueError, match="end_of_word_suffix, it normalizes texts, it splits texts otherwise"):
            f(docs, vocabulary("word_bpe_49k.json"))
    with pytest.raises(ValueError, match="it normalizes"):
        encoder(vocabulary("word_bpe_49k.json"))
    assert encoder(vocabulary()).encode("Hello")


def test_ids_beyond_twenty_bits(own, tmp_path):
    """Ids are only names: a vocabulary whose ids lie three million higher encodes the same, shifted."""
    import json

    with open(vocabulary(), encoding="utf-8") as f:
        v = json.load(f)
    v["model"]["vocab"] = {t: i + 3_000_000 for t, i in v["model"]["vocab"].items()}
    path = tmp_path / "far.json"
    path.write_text(json.dumps(v), encoding="utf-8")
    for text in ("The quick brown fox, unbelievableness 123", "é漢 \n\n  don't"):
        assert encoder(str(path)).encode(text) == [i + 3_000_000 for i in own.encode(text)]
