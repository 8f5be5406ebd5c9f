"""Byte-level BPE by dynamic programming over prefixes.

The tokens of a text's encoding that lie before a token border are the encoding of that prefix. So every byte prefix
has one valid last token, and a text's encoding is read backwards from the last token of the whole: that array of last
tokens is all the state there is. Appending bytes extends the array exactly; an edit needs the array again only from
the edited piece on, until the pieces agree with the old ones.

A token t may follow the encoding of a prefix whose last token is s if encoding the bytes of s and t together leaves
the border between them alone. This is seen by undoing, latest first, the merges that made s and t: the border holds
unless, at some point on the way, the two parts that meet there have a merge of their own that is earlier than the
merges undone so far.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex

#: Fixed value: how texts are cut into pieces before merging, in the notation of the ``regex`` module.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_find = regex.compile(PIECES).findall
#: The same pieces of texts that are ASCII only; ``re`` is faster where it can do it.
_find_ascii = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:[sdmt]|ll|ve|re)| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall


#: The same for texts of the scripts below only, whose letters, numbers and blanks are these few ranges.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0400-\u0481\u048a-\u052f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \x85\xa0"
_find_near = re.compile(rf" ?[{_L}]+| ?[{_N}]+|'(?:[sdmt]|ll|ve|re)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_far = re.compile("[^\x00-\u024f\u0400-\u0481\u048a-\u052f\u2010-\u2027\u20ac]").search


def find_pieces(text: str) -> list[str]:
    if text.isascii():
        return _find_ascii(text)
    return _find(text) if _far(text) else _find_near(text)


def _byte_names() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if printable, else from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + n): b for n, b in enumerate(rest)}


def check_supported(vocabulary: dict) -> None:
    """Raise unless texts are encoded as the vocabulary file says: byte-level BPE whose pieces are those above."""
    own, pre, model = "byte-level BPE", vocabulary.get("pre_tokenizer") or {}, vocabulary.get("model") or {}
    wrong = []
    if model.get("type", "BPE") != "BPE":
        wrong.append(f"its model is {model['type']}")
    wrong += [f"its model has {x}" for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(x)]
    if vocabulary.get("normalizer"):
        wrong.append("it normalizes texts")
    if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        wrong.append("it splits texts otherwise")
    if wrong:
        raise ValueError(f"only {own} is encoded; of this vocabulary {', '.join(wrong)}")


class PrefixEncoder:
    """Encoder of one byte-level BPE vocabulary. Its caches are bounded and only save time."""

    def __init__(self, path: str, cached: int = 400_000) -> None:
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)
        check_supported(vocabulary)
        model = vocabulary["model"]
        names = _byte_names()
        raw = {t: bytes(map(names.__getitem__, t)) for t in model["vocab"] if all(c in names for c in t)}
        self.token_id = {b: model["vocab"][t] for t, b in raw.items()}
        self.token_bytes = {i: b for b, i in self.token_id.items()}
        self._merge: dict[int, tuple[int, int, int]] = {}  # token -> (rank, left, right)
        self._rank: dict[int, int] = {}  # left << 32 | right -> rank
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b = self.token_id[raw[left]], self.token_id[raw[right]]
            self._merge.setdefault(self.token_id[raw[left] + raw[right]], (rank, a, b))
            self._rank[a << 32 | b] = rank
        self._border: dict[int, bool] = {}
        self._known: dict[bytes, list[int]] = {}
        self._ids: dict[str, bytes] = _Cache(self._piece, cached)
        # Lengths, descending, of the tokens that can end a prefix, by its last four bytes: most are the end of none so long.
        ends: dict[bytes, set[int]] = {}
        for b in self.token_id:
            if len(b) > 3:
                ends.setdefault(b[-4:], set()).add(len(b))
        self._three = {b for b in self.token_id if len(b) == 3}
        self._ends = {k: (*sorted(v, reverse=True), *((3, 2, 1) if k[1:] in self._three else (2, 1))) for k, v in ends.items()}

    def border_holds(self, s: int, t: int) -> bool:
        """Whether s followed by t is how their bytes are encoded."""
        key = s << 32 | t
        known = self._border.get(key)
        if known is None:
            if len(self._border) > 2_000_000:
                self._border.clear()
            known = self._border[key] = self._holds(s, t)
        return known

    def _holds(self, s: int, t: int) -> bool:
        rank, merge = self._rank, self._merge
        undone, strict = float("inf"), True  # a merge across the border counts if it comes before what was undone
        while True:
            own = rank.get(s << 32 | t)
            if own is not None and (own < undone or (not strict and own == undone)):
                return False
            left, right = merge.get(s), merge.get(t)
            if left is None and right is None:
                return True
            # The later of the two merges is undone. Equal merges happen from the left: then the right one is later.
            if right is None or (left is not None and left[0] > right[0]):
                undone, strict, s = left[0], True, left[2]
            else:
                undone, strict, t = right[0], False, right[1]

    def last_tokens(self, text: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix of a piece, beginning with the shortest, its encoding's last token; ``known`` has the first ones."""
        last = list(known) if known else []
        ids, border, ends, three = self.token_id, self._border, self._ends, self._three
        for end in range(len(last) + 1, len(text) + 1):
            sizes = ends.get(text[end - 4 : end]) if end > 3 else None
            for size in sizes or ((3, 2, 1) if text[end - 3 : end] in three else (2, 1)):
                if size > end:
                    continue
                t = ids.get(text[end - size : end])
                if t is None:
                    continue
                if size == end:
                    break
                s = last[end - size - 1]
                holds = border.get(s << 32 | t)
                if holds is None:
                    holds = self.border_holds(s, t)
                if holds:
                    break
            last.append(t)
        return last

    def read_back(self, last: list[int]) -> list[int]:
        out, at = [], len(last)
        size = self.token_bytes
        while at:
            t = last[at - 1]
            out.append(t)
            at -= len(size[t])
        out.reverse()
        return out

    def _piece(self, piece: str) -> bytes:
        text = piece.encode("utf-8", "surrogatepass")
        t = self.token_id.get(text)
        if t is not None:  # every token of the vocabulary encodes as itself
            return t.to_bytes(4, "little")
        head = text[:3]
        known = self._known.get(head)
        if known is None:
            if len(self._known) > 300_000:
                self._known.clear()
            known = self._known[head] = self.last_tokens(head)
        ids = self.read_back(self.last_tokens(text, known))
        return array("i", ids).tobytes()

    def encode_packed(self, text: str) -> bytes:
        """The ids as 4-byte little-endian numbers."""
        return b"".join(map(self._ids.__getitem__, find_pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, without special tokens; none for an empty or null text."""
        return np.frombuffer(self.encode_packed(text or ""), np.int32).tolist()

    def count(self, text: str | None) -> int:
        return len(self.encode_packed(text or "")) // 4


class _Cache(dict):
    def __init__(self, make, size: int) -> None:
        self.make, self.size = make, size

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(key) <= 32:
            if len(self) >= self.size:
                self.clear()
            self[key] = value
        return value


class EncodedText:
    """A text with its encoding, kept right under appends and edits by encoding again only what they touch."""

    def __init__(self, encoder: PrefixEncoder, text: str = "") -> None:
        self.encoder, self.text = encoder, ""
        self.pieces: list[str] = []
        self.last: list[list[int]] = []
        self.redone = 0
        self.edit(0, 0, text)

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace ``text[start:end]``. Pieces before the edit stay, and those after it once borders agree again."""
        text = self.text[:start] + new + self.text[end:]
        at, keep = 0, 0
        # A piece's end depends on at most the two characters behind it, so pieces that end well before the edit stand.
        while keep < len(self.pieces) and at + len(self.pieces[keep]) <= start - 2:
            at += len(self.pieces[keep])
            keep += 1
        keep = max(0, keep - 1)
        at = sum(map(len, self.pieces[:keep]))
        old, place = {}, 0
        for k, p in enumerate(self.pieces):
            if place >= end:
                old[place + len(new) - (end - start)] = k
            place += len(p)
        pieces, last, self.redone = self.pieces[:keep], self.last[:keep], 0
        resume, stop = (self.pieces[keep], self.last[keep]) if keep < len(self.pieces) else ("", []), at
        for m in regex.finditer(PIECES, text, pos=at):
            if m.start() in old and m.start() > start + len(new) + 2:
                k = old[m.start()]
                pieces += self.pieces[k:]
                last += self.last[k:]
                break
            piece = m.group()
            known = resume[1] if m.start() == stop and resume[0] and piece.startswith(resume[0]) else None
            pieces.append(piece)
            last.append(self.encoder.last_tokens(piece.encode("utf-8", "surrogatepass"), known))
            self.redone += len(piece)
        self.text, self.pieces, self.last = text, pieces, last

    def ids(self) -> list[int]:
        return [i for x in self.last for i in self.encoder.read_back(x)]


@lru_cache(4)
def encoder(path: str) -> PrefixEncoder:
    """One encoder a Python worker and vocabulary; it stays while the worker does."""
    return PrefixEncoder(path)
