"""What the end of a stored message tells: whether its own structure is finished, and with which words it stops."""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
from collections.abc import Iterator
from typing import NamedTuple

_HEADER = re.compile(r"\A\s*(?:From |[!-9;-~]+:)")
_HEAD_END = re.compile(r"\r?\n[ \t]*\r?\n")
_FOLD = re.compile(r"\r?\n[ \t]+")
_BOUNDARY = re.compile(r"(?im)^content-type:\s*multipart/[^\n]*?boundary=\"?([^\"\s;]+)")
_MULTIPART = re.compile(r"(?im)^content-type:\s*multipart/")
_TYPE = re.compile(r"(?im)^content-type:\s*([\w.+-]+/[\w.+-]+)")
_ENCODING = re.compile(r"(?im)^content-transfer-encoding:\s*([\w-]+)")
_BASE64_LINE = re.compile(r"^[A-Za-z0-9+/]{40,}={0,2}$")
_TAG = re.compile(r"<[^<>]*>")
#: Marks that stand for what was left out. One alone proves nothing: people write and quote them too.
_MARK = re.compile(r"(?:\s*(?:\.{3}|…|\[[^\[\]\n]{0,40}\]|\([a-z ]{0,40}\)|-{2,3} [^\n]{0,60} -{2,3}))\s*\Z")
_WORD = re.compile(r"[^\W\d_]+")
#: Words, and as nothing the letters beside digits in numbers, hashes and addresses.
_VOCABULARY = re.compile(r"(?<=[\d_])[A-Za-z]++|(?<![A-Za-z])[A-Za-z]++(?=[\d_])|([^\W\d_]+)")
_STOPS, _CLOSERS = ".!?。！？…:;", "'\")»”]"
_OTHER_END = re.compile(r"[)\]]\Z|[^\w\s.,&%$€£/\\'\"<>=+*@#-]\Z")
_HEADER_LINE = re.compile(r"(?:From|To|Cc|Subject|Date|Reply-To|In-Reply-To|References|Received|Message-ID|MIME-Version|Content-[\w-]+):", re.I)
_QUOTE = re.compile(r"^[ \t]*(?:[>|][ \t]?)+", re.M)
_ITEM = re.compile(r"[-*•] ")
_LABELLED = re.compile(r"[^\W\d_a-z][^\W\d_]*[.:]? [+(\d][\d ()/.-]*\Z")
_STOP = re.compile(r"[.!?。！？]['\")»”]*(?=\s|\Z)")


#: How far back a mark is looked for: more than the longest that there can be, blanks before it aside.
_TAIL = 400


def _unmarked(text: str) -> str:
    """The text without a mark at its end. Only the end is searched, so a text of any length takes as long as its end."""
    m = _MARK.search(text[-_TAIL:])
    return (text[:-_TAIL] + text[-_TAIL:][: m.start()]).rstrip() if m else text


def _ended(text: str) -> bool:
    """Whether the text ends as a sentence may: with a stop, closing quotes and brackets aside, or with a symbol."""
    return text.rstrip(_CLOSERS)[-1:] in _STOPS and bool(text.strip(_CLOSERS)) or bool(_OTHER_END.search(text[-1:]))


def _last_word(text: str) -> str | None:
    at = len(text)
    while at and _WORD.match(text[at - 1]):
        at -= 1
    if at and at < len(text) and (text[at - 1].isdigit() or text[at - 1] == "_") and text[at:].isascii():
        return None
    return text[at:] or None


def _words(text: str) -> list[str]:
    return [x for x in _VOCABULARY.findall(text) if x]


def _last_two(text: str) -> list[str]:
    """The last two words. As much of the text is read as they take."""
    size = _TAIL
    while True:
        tail = text[-size:]
        if size < len(text):
            begins = re.search(r"\W", tail)  # what comes before may be the rest of a word
            tail = tail[begins.end() :] if begins else ""
        found = _words(tail)
        if len(found) > 1 or size >= len(text):
            return found[-2:]
        size *= 8


class Ending(NamedTuple):
    structure: str | None  #: what is unfinished: headers, multipart, markup, encoding
    token: str | None  #: the word with which the text stops, unless something follows it
    pair: str | None  #: that word and the one before
    bare: bool  #: it is in small letters and stands alone, not in an address or the like
    prose: bool  #: it stops within a sentence of running text
    whole: bool  #: it ends with what closes its structure, so nothing can be missing
    body_chars: int
    body_bytes: int


def _decode(body: str, encoding: str | None) -> tuple[str, bool]:
    """The readable text of a part, and whether its encoding stops half-way."""
    if encoding == "base64":
        raw = re.sub(r"[^A-Za-z0-9+/=]", "", body)
        whole = raw[: len(raw) - len(raw) % 4]
        try:
            return base64.b64decode(whole).decode("utf-8", "ignore"), bool(len(raw) % 4)
        except (binascii.Error, ValueError):
            return "", False
    if encoding == "quoted-printable":
        cut = bool(re.search(r"=[0-9A-Fa-f]?\Z", body.rstrip("\r\n ")))
        raw = quopri.decodestring(re.sub(r"=[0-9A-Fa-f]?\Z", "", body.rstrip("\r\n ")).encode("utf-8", "replace"))
        tail = len(raw) and raw[-1] >= 0x80 and raw[-4:].decode("utf-8", "ignore").encode() != raw[-4:].lstrip(bytes(range(0x80, 0xC0)))
        return raw.decode("utf-8", "ignore"), cut or bool(tail)
    return body, False


def _last_part(head: str, body: str) -> tuple[str, str]:
    """Headers and body of the innermost part in which an unfinished multipart stops."""
    while True:  # the body grows shorter each time
        flat = _FOLD.sub(" ", head)
        m = _BOUNDARY.search(flat)
        if not m:
            return head, body
        at = body.rfind("--" + m.group(1))
        if at < 0:
            return head, body
        line = body.find("\n", at)
        if line < 0:
            return "", ""
        rest = body[line + 1 :]
        cut = _HEAD_END.search(rest)
        if rest.startswith(("\n", "\r\n")):
            head, body = "", rest
        elif cut:
            head, body = rest[: cut.start()], rest[cut.end() :]
        else:
            return rest, ""


def stopped_in_sentence(text: str) -> bool:
    """Whether running text stops before its sentence does.

    Short messages, lists, tables, signatures, commands and addresses rightly end without a full stop. Running text is
    told by what comes before in its last paragraph: a finished sentence, or enough words after a capital letter. Lines
    that many texts end with are told by the corpus (``cut_ends``).
    """
    text = _QUOTE.sub("", text.replace("\r\n", "\n")).rstrip()
    if not text or _ended(text):
        return False
    paragraph = re.split(r"\n\s*\n", text)[-1]
    lines = paragraph.split("\n")
    last = lines[-1].strip()
    if re.match(r"_{5,}|https?://", last) or re.search(r" {3,}\S", last):
        return False
    if _ITEM.match(last):
        # Items end without a full stop, unless this one holds a sentence or those before it end with one.
        before = [x.strip() for x in lines[:-1] if _ITEM.match(x.strip())]
        return bool(_STOP.search(last[2:])) or bool(before) and all(_STOP.search(x) and _ended(x) for x in before)
    if any(x.rstrip() == "--" for x in lines) or _LABELLED.match(last):
        return False  # a signature, or a labelled number
    if "://" in last.split()[-1] or _HEADER_LINE.match(last):
        return False
    # What follows a line that announces a quotation stands for itself.
    announced = [k for k, x in enumerate(lines) if x.rstrip().endswith((":", "："))]
    if announced:
        lines = lines[announced[-1] + 1 :]
        paragraph = "\n".join(lines)
    # The part after the last finished sentence of the paragraph.
    stops = [m.end() for m in _STOP.finditer(paragraph)]
    tail = paragraph[stops[-1] :].strip() if stops else paragraph.strip()
    if stops and "\n" not in paragraph[stops[-1] :].strip(" ") and tail:
        return True  # on the line on which the sentence before ended
    words = _WORD.findall(tail)
    if re.search(r"[\u3040-\u30ff\u4e00-\u9fff]", last):
        return len(tail) >= 8  # no capitals and no blanks to go by, but closings are short
    if re.search(r"[\u3040-\u30ff\u4e00-\u9fff]", tail):
        return False  # a closing and a name
    if not words or not tail[:1].isupper():
        return False
    if stops and len(tail.split("\n")) == 1 and len(words) <= 3:
        return False  # a name or a closing on its own line
    if tail.count("\n") and all(len(x) < 30 for x in tail.split("\n")):
        return False  # a closing and a name
    return len(words) >= 5


def ending(text: str) -> Ending | None:
    """None for null, empty and blank texts."""
    if text is None or not text.strip():
        return None
    cut = _HEAD_END.search(text)
    own = bool(_HEADER.match(text))
    if own and not cut:
        return Ending("headers", None, None, False, False, False, 0, 0)
    head, body = (text[: cut.start()], text[cut.end() :]) if own else ("", text)
    flat = _FOLD.sub(" ", head)
    structure, sizes = None, (len(body), len(body.encode("utf-8", "replace")))
    m = _BOUNDARY.search(flat)
    part_head, part = head, body
    if m:
        if f"--{m.group(1)}--" in body:
            return Ending(None, None, None, False, False, body.rstrip().endswith(f"--{m.group(1)}--"), *sizes)
        structure = "multipart"
        part_head, part = _last_part(head, body)
    flat = _FOLD.sub(" ", part_head)
    kind, encoding = _TYPE.search(flat), _ENCODING.search(flat)
    kind, encoding = (kind.group(1).lower() if kind else "text/plain"), (encoding.group(1).lower() if encoding else None)
    unmarked = _unmarked(part.rstrip())
    marked = unmarked != part.rstrip()
    readable, half = _decode(unmarked if marked and encoding else part, encoding if kind.startswith("text/") else None)
    if half and not structure:
        structure = "encoding"
    markup = readable.lower()
    if not structure and (("<html" in markup and "</html" not in markup) or re.search(r"<[a-zA-Z/!][^<>]*\Z", readable.rstrip())):
        structure = "markup"
    whole = not structure and markup.rstrip().endswith("</html>")
    if not kind.startswith("text/"):
        return Ending(structure, None, None, False, False, whole, *sizes)
    plain = html.unescape(_TAG.sub(" ", readable)) if "</" in readable or kind == "text/html" else readable
    plain = plain.rstrip()
    bare = _unmarked(plain) if marked else plain
    if _ended(bare) and bare != plain:
        return Ending(structure, None, None, False, False, whole, *sizes)
    token = _last_word(bare)
    near = _last_two(bare) if token else []
    pair = f"{near[-2]} {token}" if len(near) > 1 and near[-1] == token else None
    alone = bool(token) and token[0].islower() and len(bare.rsplit(None, 1)[-1]) - len(token) <= 2
    return Ending(structure, token, pair, alone, stopped_in_sentence(bare), whole, *sizes)


def _leaves(head: str, body: str) -> Iterator[tuple[str, str, bool]]:
    """Headers and body of every part that is no multipart itself, in order, and whether the message may stop within it."""
    left = [(head, body, True, True)]
    while left:
        head, body, stops, headed = left.pop()
        m = _BOUNDARY.search(_FOLD.sub(" ", head)) if headed else None
        if not m:
            yield head, body, stops
            continue
        lines = list(re.finditer(rf"(?m)^--{re.escape(m.group(1))}(--)?[ \t]*\r?(?:\n|\Z)", body))
        closed = any(x.group(1) for x in lines)
        parts = [("", body[: lines[0].start()] if lines else body, stops and not lines, False)]
        for line, end in zip(lines, [*(x.start() for x in lines[1:]), len(body)]):
            part, last = body[line.end() : end], stops and not closed and end == len(body)
            bare = line.group(1) or part.startswith(("\n", "\r\n"))
            cut = None if bare else _HEAD_END.search(part)
            if cut:
                parts.append((part[: cut.start()], part[cut.end() :], last, True))
            elif bare:
                parts.append(("", part, last, False))
        left += reversed(parts)


def words(text: str) -> list[list[str]]:
    """Words for the vocabulary, a list for each readable part, as ``ending`` reads it: decoded, without tags and
    without a mark. The word with which the message may stop is left out. Headers and lines of base64 aren't words.
    """
    cut = _HEAD_END.search(text)
    own = bool(_HEADER.match(text))
    if own and not cut:
        return []
    out = []
    for head, body, stops in _leaves(text[: cut.start()], text[cut.end() :]) if own else [("", text, True)]:
        flat = _FOLD.sub(" ", head)
        kind, encoding = _TYPE.search(flat), _ENCODING.search(flat)
        kind, encoding = (kind.group(1).lower() if kind else "text/plain"), (encoding.group(1).lower() if encoding else None)
        if not kind.startswith("text/"):
            continue
        unmarked = _unmarked(body.rstrip()) if stops else body
        marked = stops and unmarked != body.rstrip()
        readable, _ = _decode(unmarked if marked and encoding else body, encoding)
        plain = html.unescape(_TAG.sub(" ", readable)) if "</" in readable or kind == "text/html" else readable
        plain = _unmarked(plain.rstrip()) if marked else plain
        lines = [x for x in plain.split("\n") if not (len(x) > 40 and _BASE64_LINE.match(x.strip()))]
        found = _words("\n".join(lines))
        out.append(found[:-1] if stops else found)
    return out
