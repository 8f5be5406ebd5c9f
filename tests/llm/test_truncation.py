"""Cuts made on purpose are found; messages that rightly end as they do are not."""

import base64
import os
import random
import time

import pytest

from relgrain.llm.messages import ending, stopped_in_sentence, words
from relgrain.llm.truncation import count_words, cut_ends, judged_endings, last_words, length_limits, scan_endings, trie_nodes, truncated, truncation_by_source

HEAD = "From: Ann <ann@example.org>\nTo: bob@example.org\nSubject: Rota\nMIME-Version: 1.0\n"
PLAIN = HEAD + "Content-Type: text/plain; charset=utf-8\n\n"
SENTENCE = "The driver left the northern warehouse early and should reach the depot within nineteen hours. "
MULTI = HEAD + 'Content-Type: multipart/mixed; boundary="xyz"\n\n--xyz\nContent-Type: text/plain\n\n' + SENTENCE + "\n--xyz\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\n" + "QUJD" * 30 + "\n--xyz--\n"
HTML = HEAD + "Content-Type: text/html\n\n<html><body><p>" + SENTENCE + "</p></body></html>\n"
B64 = HEAD + "Content-Type: text/plain\nContent-Transfer-Encoding: base64\n\n" + base64.encodebytes((SENTENCE * 3).encode()).decode()

WHOLE = [
    PLAIN + SENTENCE, PLAIN + "on my way", PLAIN + "just landed, back online tonight", PLAIN + SENTENCE + "\n\nKind regards,\nAnn Miller\n", PLAIN + SENTENCE + "\nBest regards\nAnn",
    PLAIN + SENTENCE + "\n\n- damaged crate (24)\n* loading schedule (54)", PLAIN + SENTENCE + "\n\nAldersee            2095\nTotal               8270", PLAIN + SENTENCE + "\nretry=3 wait=20\nx = y + 1\n",
    PLAIN + SENTENCE + "\n\nSent from my handset", PLAIN + SENTENCE + "\n_______\nTo leave this list visit https://lists.example.org/leave/1828041", PLAIN + SENTENCE + " 🙏", PLAIN + SENTENCE + "…",
    PLAIN + "Ann Miller wrote on 2023-01-31:\n> no worries\n> thx, got it\n>\n", PLAIN + "He sent this:\n> The driver left the northern ware [message clipped]\n\nIt was cut, sadly.", PLAIN + "皆様\n\n請求書の金額をお支払いください。\n以上,\nAnn Miller",
    MULTI, MULTI + "\n_______\nfooter\n", HTML, B64, PLAIN, PLAIN + "A forward of mine:\n" + HEAD + 'Content-Type: multipart/mixed; boundary="abc"\n',
]
CUT = [
    PLAIN + SENTENCE + "The driver left the nor", PLAIN + SENTENCE + "The driver left the northern", PLAIN + SENTENCE + "\n\nThe driver left the northern warehouse early and", PLAIN + SENTENCE + "The driver le...", PLAIN + SENTENCE + "The driver left the\n[message clipped]",
    PLAIN + SENTENCE + "The dri\r\n\r\n\r\n", MULTI[:-30], MULTI[: len(MULTI) // 2], MULTI.replace("--xyz--", ""), HTML[:-30], HTML[:-60], HEAD, HEAD[:60], B64[:-50].rstrip() + "A", HEAD + 'Content-Type: multipart/mixed; boundary="xyz',
]


def told(e):
    return e is not None and bool(e.structure or e.prose)


@pytest.mark.parametrize("text", WHOLE)
def test_whole(text):
    assert not told(ending(text))


def test_null_empty_blank():
    assert ending(None) is None and ending("") is None and ending(" \n\t") is None and not stopped_in_sentence("")


def test_long_texts_take_no_longer_than_they_are_long():
    began = time.time()
    for text in (PLAIN + "a" * 1_000_000, PLAIN + " " * 1_000_000 + "x", PLAIN + "<" * 500_000, PLAIN + "\n" * 500_000 + "b", "x:" * 300_000, PLAIN + ". " * 300_000, PLAIN + "(" * 300_000):
        ending(text)
    assert time.time() - began < 30


@pytest.fixture(scope="module")
def found(spark):
    rows = [(i, "a", t) for i, t in enumerate(WHOLE)] + [(1000 + i, "a", t) for i, t in enumerate(CUT)]
    rows += [(2000, None, None), (2001, "a", ""), (2002, "a", " \n"), (None, "b", PLAIN + SENTENCE)]
    r = random.Random(6)
    for i in range(40):  # one source cuts at 600 characters
        text = PLAIN + SENTENCE * r.randrange(1, 12)
        rows.append((3000 + i, "limited", text[:600]))
    df = spark.createDataFrame([(*x, "t") for x in rows], "doc_id long, source string, text string, token string").repartition(4)
    return df, rows, {x["doc_id"]: x for x in truncated(df).collect()}


def test_cuts_are_found_and_whole_messages_not(found):
    _, rows, got = found
    assert [t for i, _, t in rows if i is not None and i < 1000 and got[i]["truncated"]] == []
    assert [t for i, _, t in rows if i is not None and 1000 <= i < 2000 and not got[i]["truncated"]] == []
    assert not any(got[i]["truncated"] for i in (2000, 2001, 2002, None)) and len(got) == len(rows)


def test_limit_of_a_source(found, spark):
    df, rows, got = found
    endings = scan_endings(df)
    lasts = last_words(endings)
    limits = length_limits(judged_endings(endings, cut_ends(lasts, trie_nodes(count_words(df), lasts)))).filter("measure = 'chars'").collect()
    assert [(x["source"], x["size"]) for x in limits] == [("limited", 600)]
    for i, s, t in rows:
        if s == "limited":
            assert got[i]["truncated"] == (len(t) == 600)


def _lasts(spark, *words):
    return spark.createDataFrame([(w, 1, 1) for w in words], "last string, ends long, sizes long")


def test_trie(spark):
    words = spark.createDataFrame([("depot", 4), ("depots", 3), ("deal", 1), ("the depot", 5), ("depot", 5), ("the dew", 2)], "word string, n long")
    nodes = {r["prefix"]: (r["n"], r["below"], r["below_n"]) for r in trie_nodes(words, _lasts(spark, "dep", "depot", "depots", "the de", "dea", "xyz")).collect()}
    assert nodes == {"dep": (None, 2, 12), "depot": (9, 1, 3), "depots": (3, 0, 0), "the de": (None, 1, 5), "dea": (None, 0, 0)}
    assert trie_nodes(words, _lasts(spark)).count() == 0 and trie_nodes(words.limit(0), _lasts(spark, "dep")).count() == 0


def test_words_of_any_length(spark):
    """Runs of letters without blanks, as some scripts write them, and far longer ones."""
    long = "東京都港区の倉庫から荷物が届きました" * 8
    docs = spark.createDataFrame([(i, "a", PLAIN + long + "。 " + "q" * 100_000 + " end.") for i in range(4)] + [(9, "a", PLAIN + long[:100])], "doc_id long, source string, text string")
    assert len(long) > 64 and [r["doc_id"] for r in truncated(docs).filter("unknown_prefix").collect()] == [9]


def test_words_are_those_of_the_decoded_text():
    quoted = HEAD + "Content-Type: text/plain\nContent-Transfer-Encoding: quoted-printable\n\nDas Gew=C3=A4chshaus am n=C3=B6rdli=\nchen Tor ist zu.\n"
    assert words(quoted) == [["Das", "Gewächshaus", "am", "nördlichen", "Tor", "ist"]]
    assert words(B64)[0][:4] == ["The", "driver", "left", "the"] and len(words(B64)[0]) == 3 * 15 - 1
    for mark in ("\n[message clipped]", " (truncated)", "...", "\n--- remainder omitted by gateway ---"):
        assert words(PLAIN + "The driver left the nor" + mark) == [["The", "driver", "left", "the"]]
    both = HEAD + 'Content-Type: multipart/mixed; boundary="xyz"\n\n--xyz\nContent-Type: text/plain\n\nThe driver\n--xyz\nContent-Type: image/png\n\nQUJD\n--xyz\n\nleft the nor'
    assert words(both) == [[], ["The", "driver"], ["left", "the"]] and words(both + "thern depot\n--xyz--\n")[2] == ["left", "the", "northern", "depot"]
    assert words(HEAD) == [] and words(PLAIN + "see /t/a72f6b or R07054 there") == [["see", "t", "or"]]


def test_cut_within_a_declaration():
    assert ending(HEAD + "Content-Type: text/html\n\n<!DOCTYPE htm").structure == "markup"


def test_pieces_are_rarer_than_their_words_and_words_are_not(spark):
    vocabulary = spark.createDataFrame([("nor", 40), ("northern", 20_000), ("the nor", 4), ("the northern", 8_000), ("depot", 2), ("depots", 3), ("in", 900), ("invoice", 9_000)], "word string, n long")
    lasts = _lasts(spark, "nor", "the nor", "depot", "in")
    assert sorted(r["last"] for r in cut_ends(lasts, trie_nodes(vocabulary, lasts)).collect() if r["unknown_prefix"]) == ["nor", "the nor"]


@pytest.mark.parametrize(
    "end",
    [
        "Get back to me when the northern warehouse has counted the", "To leave the depot early you need the second", "ERROR reports from the northern warehouse go to the",
        "- We counted the crates. Nobody from the northern", "- We counted the crates.\n- Nobody from the northern",
    ],
)
def test_no_beginning_of_a_line_hides_a_cut(end):
    assert stopped_in_sentence(SENTENCE + "\n\n" + end)


def test_footers_are_learned(spark):
    footer = "\n\nGet the new courier box for nothing today"
    rows = [(i, "a", PLAIN + SENTENCE + footer) for i in range(20)] + [(20, "a", PLAIN + SENTENCE + "\n\nGet back to me when the depot has the")]
    got = truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).filter("prose").collect()
    assert [r["doc_id"] for r in got] == [20]
    for end in ("-- \nAnn Miller\nStores, Quayside\nTel. +44 1632 960143", "Tel. 01632 960013", "- damaged crate\n- loading schedule of the northern depot"):
        assert not stopped_in_sentence(SENTENCE + "\n\n" + end)


def test_short_limits_are_seen_and_form_letters_are_none(spark):
    """A gateway that cuts at 80 characters, one at nine lines; and short and long letters that are all of one size."""
    r = random.Random(8)
    words = SENTENCE.strip(" .").lower().split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, "sms", " ".join(say(r.randrange(3, 9)) for _ in range(r.randrange(1, 8)))[:80]) for i in range(120)]
    rows += [(1000 + i, "lines", "\n".join([PLAIN + say(9), *(" ".join(r.choice(words) for _ in range(9)) for _ in range(r.randrange(1, 12))), "and so on."][: 10]).replace("\n\n", "\n\n", 1)) for i in range(60)]
    rows += [(2000 + i, "letters", PLAIN + "Your parcel no. 10%02d has come." % i) for i in range(60)] + [(3000 + i, "letters", PLAIN + SENTENCE * 20 + "No. 10%02d." % i) for i in range(60)]
    got = {x["doc_id"]: x for x in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert all(got[i]["at_limit"] == (len(t) == 80) for i, s, t in rows if s == "sms") and sum(got[i]["at_limit"] for i in range(120)) > 30
    assert not any(got[i]["truncated"] for i, s, _ in rows if s == "letters")


def test_parts_within_parts_without_end():
    def nested(deep, text):
        for i in range(deep):
            text = f'Content-Type: multipart/mixed; boundary="b{i}"\n\n--b{i}\n{text}\n--b{i}--\n'
        return "From: Ann <ann@example.org>\n" + text

    leaf = "Content-Type: text/plain\n\n" + SENTENCE
    whole = nested(40, leaf)
    assert not told(ending(whole)) and ["The", "driver", "left"] in [x[:3] for x in words(whole)]
    open_ = whole[: whole.index("nineteen") + 3]
    assert ending(open_).structure == "multipart" and ending(open_).token == "nin" and words(open_)[-1][-1] == "within"


def test_words_that_close_a_message_are_learned(spark):
    """A word with which many texts of all sizes end, whatever comes before it, stops no sentence; ordinary words do."""
    r = random.Random(3)
    words = SENTENCE.strip(" .").lower().split()
    say = lambda n: " ".join(r.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, "a", PLAIN + " ".join(say(r.randrange(4, 12)) for _ in range(r.randrange(2, 9))) + (" undsoweiter" if i < 30 else " The " + say(5).lower()[:-1])) for i in range(60)]
    got = {x["doc_id"]: x["truncated"] for x in truncated(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()}
    assert not any(got[i] for i in range(30)) and sum(got[i] for i in range(30, 60)) > 27


def test_by_source_and_empty_table(found):
    df, rows, got = found
    by = {r["source"]: r for r in truncation_by_source(df).collect()}
    assert by["limited"]["only_at_limit"] + by["limited"]["only_unknown_prefix"] <= by["limited"]["truncated"] and by["a"]["only_unfinished"] > 0
    assert by["limited"]["documents"] == 40 and by["limited"]["truncated"] == sum(x["truncated"] for x in got.values() if x["source"] == "limited")
    assert truncated(df.limit(0)).count() == 0


FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test data are not here")
def test_queries_run(spark):
    from relgrain.llm.queries import QUERIES

    for name, f in QUERIES.items():
        assert f(spark, FOLDER).count() > 0, name
