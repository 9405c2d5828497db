"""How a text ends: its closing words, and whether they are ones that close a sentence or a line. Small helpers for the tasks of ``truncated``."""

from __future__ import annotations

import re
from collections import Counter

#: A word is a run without blanks, or one Chinese or Japanese character.
CJK = "぀-ヿ㐀-䶿一-鿿"
WORD = re.compile(rf"[{CJK}]|[^\s{CJK}。！？；，、：（）《》“”]+|[。！？；，、：（）《》“”]|\n")
STOPS = "。！？；"
#: What a line begins with if its kind is told by it: a list's mark or number, a heading, a quotation, a speaker, a label.
KIND = re.compile(r"(?:[-*+#>|]+|\d+[.)]|\w+:)$")
#: Marks that end a sentence, and those that may follow them.
CLOSED = re.compile(r"""[.!?。！？][)\]"'”’》）*_]*$|^\s*```$""", re.M)
DOTS = re.compile(r"(?:\.{2,}|…+)$")
#: Remarks in brackets at the end that tell of an omission.
OMISSION = re.compile(r"\s*[\[(（【][^\[\]()（）【】\n]{0,20}(?:more|cut|truncated|shortened|omitted|left|continued|gekürzt|abgeschnitten|截断|省略)[^\[\]()（）【】\n]{0,40}[\])）】]\s*$", re.I)
FENCE = re.compile(r"^\s*```", re.M)
BROKEN = "�"
#: The forms of words met so far.
FORMS: dict[str, str] = {}


def form(token: str) -> str:
    """A word as it is counted: lower case, names and numbers as their kind, without the marks after it."""
    if (known := FORMS.get(token)) is not None:
        return known
    if len(FORMS) > 1 << 17:
        FORMS.clear()
    FORMS[token] = found = _form(re.sub(r"""[.,;:!?'")\]}…]+$""", "", token) or token)
    return found


def _form(t: str) -> str:
    if t[0] == "`" and len(t) > 1:
        return "`x`" if t[-1] == "`" else "`x"
    if re.search(r"[a-z][A-Z].*[a-z]", t) or re.search(r"\d", t) and re.search(r"[A-Za-z]", t) and len(t) > 12:
        return "Name"
    return re.sub(r"\d+", "0", t.lower())[:40]


def tokens(text: str) -> list[str]:
    return WORD.findall(text)


def kind(first: str) -> str:
    return re.sub(r"\d+", "0", first) if KIND.match(first) else ""


def key(words: list[str], k: int) -> tuple[str, str]:
    """The word at place k with what stands before it; a Chinese character with the two before."""
    w, before = words[k], words[k - 1] if k else "\n"
    if len(w) == 1 and w >= "\u3040":
        return (words[k - 2] if k > 1 else "") + before, w
    return (before if before == "\n" else form(before)), form(w)


def count(text: str, into: Counter) -> None:
    """Add to ``into`` for each word but the last whether it ends a line without a mark: (kind of line, before, word, ends), and the same without what is before."""
    words = tokens(text)
    last = max((k for k, w in enumerate(words) if w != "\n"), default=0)
    of = kind(words[0]) if words else ""
    for k in range(last):
        if words[k] == "\n":
            of = kind(words[k + 1])
            continue
        bare = words[k + 1] == "\n" and words[k] not in STOPS and not CLOSED.search(words[k])
        before, w = key(words, k)
        into[of, before, w, bare] += 1
        into[of, "", w, bare] += 1


def ending(text: str) -> tuple[str, str, str, str]:
    """(state, before, word) of a text's end: 'blank'; 'broken' within a character; 'inside' an open block or quotation of code; 'omitted' by a remark; 'dots'; 'closed' by a sentence mark; or 'open'. The rest are the kind of the last line, what is before the last word, and it, of open ends and those with dots."""
    body = text.rstrip()
    if not body:
        return "blank", "", "", ""
    if body.endswith(BROKEN):
        return "broken", "", "", ""
    omission = OMISSION.search(body)
    dots = DOTS.search(body)
    if omission or dots:
        body = body[: (omission or dots).start()].rstrip()
    if len(FENCE.findall(body)) % 2 or body.rsplit("\n", 1)[-1].replace("```", "").count("`") % 2:
        return "inside", "", "", ""
    if not omission and not dots and CLOSED.search(body.rsplit("\n", 1)[-1]):
        return "closed", "", "", ""
    words = [w for w in tokens(body)]
    while words and words[-1] == "\n":
        words.pop()
    if not words:
        return "blank", "", "", ""
    if omission:
        return "omitted", "", "", ""
    if dots and CLOSED.search(body.rsplit("\n", 1)[-1]):
        return "closed", "", "", ""
    start = len(words) - words[::-1].index("\n") if "\n" in words else 0
    return ("dots" if dots else "open"), kind(words[start]), *key(words, len(words) - 1)
