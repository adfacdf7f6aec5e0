"""Personal data, also where it is disguised: normalise, detect, and map back to the source.

The base pass finds identifiers as they stand. Texts in which a transducer would change anything go
through them as well: look-alike letters and digits become ASCII, invisible characters go, "[at]",
"(dot)", " at ... dot ", spelled digits and "plus" become the characters they stand for. Every
character of the normalised text knows the source range it came from, so what the same detectors
find there is mapped back to code points of the source. A span found so is added when it holds
something disguised and does not lie inside one base span; base spans always stay.

All patterns take time in proportion to the text: none can start again inside a run it has tried.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from holdfast.llm.frames import map_texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match cannot start inside a run of digits: where the run's first digit fails, so do the others.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]")


def emails(text: str) -> list[Span]:
    """From each @ the longest local part to its left, then the domain to its right."""
    found, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            free = domain.end()
            found.append((start, free))
        at = text.find("@", max(at + 1, free))
    return found


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _card(text: str) -> bool:
    digits = _NO_DIGIT.sub("", text)
    return 16 <= len(digits) <= 19 and luhn(digits)


def detect(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind: leftmost, not overlapping, failing matches dropped."""
    return {
        "email": emails(text),
        "ip": [m.span() for m in _IP.finditer(text) if all(map(_byte, m.groups()))],
        "card": [m.span() for m in _CARD.finditer(text) if _card(m[0])],
        "phone": [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NO_DIGIT.sub("", m[0])) <= 15],
    }


# Letters of other scripts that look like ASCII letters.
_LOOKALIKES = dict(zip("АВЕЗКМНОРСТХУаеорсухіјѕԁԛԝһ", "ABE3KMHOPCTXYaeopcyxijsdqwh"))
_LOOKALIKES |= dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧανορυιτ", "ABEZHIKMNOPTYXavopuit"))
# Invisible characters.
_INVISIBLE = "­​‌‍⁠﻿"
# Spelled digits.
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
           "seven": "7", "eight": "8", "nine": "9"}


def _ascii_of(ch: str) -> str | None:
    """The one ASCII character that a compatibility form or a digit of another script stands for."""
    if ch in _LOOKALIKES:
        return _LOOKALIKES[ch]
    digit = unicodedata.decimal(ch, None)
    if digit is not None:
        return str(digit)
    plain = unicodedata.normalize("NFKC", ch)
    return plain if len(plain) == 1 and "!" <= plain <= "~" else None


# By rule: everything beyond Latin-1 that stands for one ASCII character.
_FOLD = {c: a for c in range(0x100, 0x20000) if (a := _ascii_of(chr(c)))}


def _ranges(codes: Sequence[int]) -> str:
    out, codes = [], sorted(codes)
    start = last = codes[0]
    for c in [*codes[1:], -1]:
        if c != last + 1:
            out.append(f"\\U{start:08x}-\\U{last:08x}")
            start = c
        last = c
    return "".join(out)


_SUSPECT = re.compile(f"[{_ranges([*_FOLD, *map(ord, _INVISIBLE)])}]")
_OPEN, _CLOSE = r"[\[({<]", r"[\])}>]"
_SPELLED = "|".join(_DIGITS)
# Fixed values: "at" without brackets counts only before a domain that ends in one of these.
_TOP = "com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|eu|it|nl|ch|at|us|ca|au"
# A run of spaces before a bracket is tried from its start alone.
_BEFORE = rf"(?: (?<![ \t]) [ \t]+ )? {_OPEN}"
_SAID_DOT = rf"(?: [ \t]+ dot [ \t]+ | [ \t]* {_OPEN} [ \t]* (?:dot|\.) [ \t]* {_CLOSE} [ \t]* )"
_TOKEN = re.compile(rf"""
    (?P<at>   {_BEFORE} [ \t]* (?:at|@) [ \t]* {_CLOSE} [ \t]*
            | (?<=\w) [ \t]+ at [ \t]+ (?= [\w-]+ (?: {_SAID_DOT} [\w-]+ ){{0,4}} {_SAID_DOT} (?:{_TOP}) \b ) )
  | (?P<dot>  {_BEFORE} [ \t]* (?:dot|\.) [ \t]* {_CLOSE} [ \t]* | (?<=\w) [ \t]+ dot [ \t]+ (?=\w) )
  | (?P<plus> \b plus [ \t]+ (?= (?:{_SPELLED}|[0-9]+) \b ) )
  | (?P<said> \b (?:{_SPELLED}) (?: [ \t,-]+ (?: (?:{_SPELLED}) \b | [0-9]+ \b ) )* (?!\w) )
  | (?P<gone> [{_INVISIBLE}]+ )""", re.VERBOSE | re.IGNORECASE)
_WORD = re.compile(rf"(?:{_SPELLED})|[0-9]", re.IGNORECASE)


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return "\xad" not in text


def _tokens(folded: str) -> Iterator[tuple[re.Match[str], list[re.Match[str]]]]:
    """What is to be replaced, in order, and the number words of it. A single number word is a word."""
    for m in _TOKEN.finditer(folded):
        words = list(_WORD.finditer(m[0])) if m["said"] else []
        if len(words) == 1 and not words[0][0].isdigit() and \
                not re.match(r"[ \t]+dot[ \t]", folded[m.end():m.end() + 8], re.IGNORECASE) and not \
                re.search(r"(?:dot|plus)[ \t]+\Z", folded[max(0, m.start() - 8):m.start()], re.IGNORECASE):
            continue
        yield m, words


# What every match of _TOKEN that is replaced holds, alternative by alternative: "at" and "dot" in brackets, "dot" as a
# word, "plus" before a number, and two number words in a row (a single one counts beside "dot" or "plus" alone).
_BRACKETED = re.compile(rf"{_OPEN}[ \t]*(?:at|@|dot|\.)[ \t]*{_CLOSE}")
_SAID_PLUS = re.compile(rf"plus[ \t]+(?:{_SPELLED}|[0-9])")
_SAID_PAIR = re.compile(rf"\b(?:{_SPELLED})[ \t,-]+(?:{_SPELLED}|[0-9])")


def disguised(text: str) -> bool:
    """May a transducer change the text? Cheap, and true wherever one would."""
    if not _latin(text) and _SUSPECT.search(text):
        return True
    # The patterns take these two for an i as well.
    low = text.lower() if text.isascii() else text.replace("\u0130", "i").replace("\u0131", "i").lower()
    return bool("dot " in low or "dot\t" in low or _BRACKETED.search(low) or "plus" in low and _SAID_PLUS.search(low)
                or any(word in low for word in _DIGITS) and _SAID_PAIR.search(low))


def normalise(text: str) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The normalised text; for each of its characters the source range, and whether it was changed."""
    folded = text if text.isascii() else text.translate(_FOLD)
    out, starts, ends, changed, at = [], [], [], [], 0

    def copy(to: int) -> None:
        if to > at:
            out.append(folded[at:to])
            place = np.arange(at, to)
            starts.append(place), ends.append(place + 1)
            changed.append(np.zeros(to - at, bool) if folded is text else
                           np.array([a != b for a, b in zip(folded[at:to], text[at:to])]))

    def put(piece: str, spans: Sequence[Span]) -> None:
        out.append(piece)
        starts.append(np.array([a for a, _ in spans], np.int64)), ends.append(np.array([b for _, b in spans], np.int64))
        changed.append(np.ones(len(piece), bool))

    for m, words in _tokens(folded):
        copy(m.start())
        at = m.end()
        if m["at"] or m["dot"] or m["plus"]:
            put("@" if m["at"] else "." if m["dot"] else "+", [m.span()])
        elif m["said"]:
            put("".join(_DIGITS.get(w[0].lower(), w[0]) for w in words),
                [(m.start() + w.start(), m.start() + w.end()) for w in words])
    copy(len(folded))
    if not out:
        return "", *(np.zeros(0, np.int64),) * 2, np.zeros(0, bool)
    return "".join(out), np.concatenate(starts), np.concatenate(ends), np.concatenate(changed)


def revealed(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Spans that only the normalised text shows, in code points of ``text``."""
    plain, start, end, changed = normalise(text)
    taken = sorted(s for spans in base.values() for s in spans)
    begins, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    added: dict[str, list[Span]] = {}
    for kind, spans in detect(plain).items():
        for a, b in spans:
            span = int(start[a]), int(end[b - 1])
            broken = changed[a:b].any() or (start[a + 1:b] != end[a:b - 1]).any()
            before = bisect_right(begins, span[0])
            if broken and not (before and reach[before - 1] >= span[1]):
                added.setdefault(kind, []).append(span)
    return added


def _texts(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans.get(kind, ())))


def find_personal(docs: DataFrame, keep: Sequence[str], text: str = "text") -> DataFrame:
    """``keep`` of each row, counts and digest of the base spans, ``n_added``, and all ``spans``.

    One row for each row of ``docs``. NULL and empty texts hold nothing: counts 0, empty ``spans``,
    the digest of the empty string. Spans are ``kind:start:end``, in code points, end exclusive.
    """
    def work(column: pa.Array):
        rows = []
        for value in column.to_pylist():
            base = detect(value or "")
            more = revealed(value, base) if value and disguised(value) else {}
            rows.append(([len(base[k]) for k in KINDS], hashlib.sha256(_texts(base).encode()).hexdigest(),
                         sum(map(len, more.values())), _texts({k: base[k] + more.get(k, []) for k in KINDS})))
        counts = np.array([r[0] for r in rows], np.int64)
        return [*[pa.array(counts[:, k]) for k in range(4)], pa.array([r[1] for r in rows]),
                pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows])]

    return map_texts(docs, text, keep, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, "
                                       "n_added long, spans string", work)


def redact(text: str) -> str:
    """The text with every identifier replaced by its kind in brackets; overlapping ones as one."""
    base = detect(text)
    more = revealed(text, base) if disguised(text) else {}
    spans = sorted((a, b, kind) for kind in KINDS for a, b in base[kind] + more.get(kind, []))
    out, at = [], 0
    for a, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, keep: Sequence[str], text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``keep`` of each row, its redacted text and the new number of characters. NULL stays NULL, with its count."""
    def work(column: pa.Array):
        texts = [value if value is None else redact(value) for value in column.to_pylist()]
        return [pa.array(texts, pa.string()), pa.array([None if t is None else len(t) for t in texts], pa.int64())]

    return map_texts(docs, text, [c for c in keep if c not in (text, n_chars)], f"`{text}` string, `{n_chars}` long", work)
