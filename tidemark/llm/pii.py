"""Personal information in free text, found and replaced by typed placeholders.

Patterns and word lists propose forms, the corpus decides on each of them. Every form has terms: the words around it, the shape of a
number, the words of a name, the ending of an address of mail. For every term the co-occurrence over all documents estimates how
strongly it reveals a protected entity, as the logarithm of the odds of its counts next to forms that can hardly be
anything else (a number with its country code, a known given name before a known family name) against those next to
numbers given to things, or elsewhere. A form is removed if what its terms disclose together, and what its pattern
alone is worth (``SEED``, or nothing for an ambiguous one), exceed the threshold. So ten digits may be a phone by their
neighbours, and what looks like a phone may stay because the corpus knows such numbers as those of orders.

Text is read in a normal form (character references, wrongly decoded UTF-8, widths, combining marks and invisible characters
undone) of which every character knows its place in the original, so positions and all that is kept are those of
the original.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark import storage

THRESHOLD = 0.0  #: sum of the log odds of its terms, and of its pattern, above which a form is taken
SEED = 3.0  #: log odds of a form that by its pattern can hardly be anything else
STRONGEST = 2.9  #: log odds of one term at most, either way, so that no single term outweighs a pattern
AFTER = 0.3  #: weight of the terms behind a number against those before it, which name it more often
KEPT_COUNTS = 300_000  #: terms that a task counts before it hands them on
BROADCAST_TERMS = 500_000  #: terms up to which their table is sent to all executors
PLACEHOLDERS = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "person_name": "[PERSON]"}

_REFERENCE = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_INVISIBLE = frozenset("​‌‍⁠﻿­‎‏")
_PLAIN = re.compile(r"[\x00-\x25\x27-\x7f]*\Z")


def _cp1252() -> dict[str, int]:
    """Characters that show a byte of 0x80 to 0x9f when it is decoded by that code page."""
    out = {chr(b): b for b in range(0x80, 0x100)}
    for b in range(0x80, 0xA0):
        try:
            out[bytes([b]).decode("cp1252")] = b
        except UnicodeDecodeError:
            pass
    return out


_BYTE = _cp1252()


def normal_form(text: str) -> tuple[str, list[int] | range]:
    """The text as a reader sees it, and for each character the place of its first character in the original."""
    if _PLAIN.match(text):
        return text, range(len(text))
    chars: list[str] = []
    place: list[int] = []
    at = 0
    for m in _REFERENCE.finditer(text):
        meant = html.unescape(m.group(0))
        if meant == m.group(0):
            continue
        chars.extend(text[at : m.start()])
        place.extend(range(at, m.start()))
        chars.extend(meant)
        place.extend([m.start()] * len(meant))
        at = m.end()
    chars.extend(text[at:])
    place.extend(range(at, len(text)))
    out: list[str] = []
    where: list[int] = []
    i, n = 0, len(chars)
    while i < n:
        c = chars[i]
        o = ord(c)
        if 0xC2 <= o <= 0xF4:  # may be the first of bytes that were decoded one by one
            size = 2 if o < 0xE0 else 3 if o < 0xF0 else 4
            rest = [_BYTE.get(x, 0) for x in chars[i + 1 : i + size]]
            if len(rest) == size - 1 and all(0x80 <= b < 0xC0 for b in rest):
                try:
                    c = bytes([o, *rest]).decode("utf-8")
                    o = ord(c)
                    at = place[i]
                    i += size
                except UnicodeDecodeError:
                    at, i = place[i], i + 1
            else:
                at, i = place[i], i + 1
        else:
            at, i = place[i], i + 1
        if o > 127:
            if c in _INVISIBLE:
                continue
            if unicodedata.combining(c) and out:
                joined = unicodedata.normalize("NFC", out[-1] + c)
                if len(joined) == 1:
                    out[-1] = joined
                    continue
            one = unicodedata.normalize("NFKC", c)
            c = one if len(one) == 1 else c
            if c.isspace():
                c = " "
        out.append(c)
        where.append(at)
    return "".join(out), where


# ---- forms. The patterns and word lists of this section.

_AT_WORD = "(?:at|ät|arroba|chiocciola|ma[łl]pa|arobase|klammeraffe)"
_DOT_WORD = "(?:dot|punkt|punto|point|kropka)"
_AT = rf"(?:[ ]{{0,2}}@[ ]{{0,2}}|[ ]{{0,2}}[(\[{{][ ]?{_AT_WORD}[ ]?[)\]}}][ ]{{0,2}}|[ ]{{1,2}}{_AT_WORD}[ ]{{1,2}})"
_DOT = rf"(?:\.|[ ]{{0,2}}[(\[{{][ ]?{_DOT_WORD}[ ]?[)\]}}][ ]{{0,2}}|[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}})"
_LOCAL = rf"(?:\"[^\"\n]{{1,64}}\"|(?<![A-Za-z0-9._%+\-])[A-Za-z0-9_%+\-]+(?:(?:\.|[ ]{{1,2}}{_DOT_WORD}[ ]{{1,2}}|[ ]?[(\[]{_DOT_WORD}[)\]][ ]?)[A-Za-z0-9_%+\-]+)*)"
EMAIL = re.compile(rf"({_LOCAL})({_AT})([A-Za-z0-9\-]+(?:{_DOT}[A-Za-z0-9\-]+)*{_DOT}([A-Za-z]{{2,24}}))(?![A-Za-z0-9]|[ ]?@)", re.I)
#: in all texts with an ``EMAIL`` that has no at sign; to be tried on small letters
_AT_HINT = re.compile(rf"[ (\[{{][ ]?{_AT_WORD}[ ]?[ )\]}}][ ]{{0,2}}[a-z0-9\-]+{_DOT}[a-z0-9\-]")
_HANDLE = re.compile(r"(?<!\w)@[A-Za-z]\w+")
_DOMAINS = frozenset("com net org info edu gov biz io eu co uk de fr es it pl jp us example test invalid localhost".split())

_SEP = r"[ .\-/]"
_END = r"(?![0-9A-Za-z]|[\-./]\d)"
_BEGIN = r"(?<![A-Za-z0-9À-ɏ#@])(?<![0-9A-Za-z][\-./])"
_DIGIT_WORDS = "zero|oh|one|two|three|four|five|six|seven|eight|nine|null|eins|zwei|zwo|drei|vier|fünf|sechs|sieben|acht|neun|zéro|deux|trois|quatre|cinq|sept|huit|neuf|cero|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|due|tre|quattro|cinque|sei|sette|otto|nove|jeden|dwa|trzy|cztery|pięć|sześć|siedem|osiem|dziewięć"
SURE_PHONE = re.compile(
    rf"\+\d{{1,3}}(?:[ ]{{0,2}}\(0\))?(?:{_SEP}{{0,2}}\(?\d{{1,8}}\)?){{1,6}}{_END}"
    rf"|{_BEGIN}00[1-9]\d{{0,2}}(?:[ ]{{0,2}}\(0\))?(?:{_SEP}{{0,2}}\d{{1,8}}){{1,6}}{_END}"
    rf"|(?<![A-Za-z0-9])\(\d{{2,5}}\)[ .\-]{{0,2}}\d{{3,5}}{_SEP}{{0,2}}\d{{3,5}}{_END}"
    rf"|{_BEGIN}1{_SEP}{{1,2}}\d{{3}}{_SEP}{{1,2}}\d{{3}}{_SEP}{{1,2}}\d{{4}}{_END}"
    rf"|{_BEGIN}0[1-9](?:[ .\-]{{1,2}}\d{{2}}){{4}}{_END}"
    rf"|{_BEGIN}0[1-9]\d{{1,3}}[ ]{{0,2}}/[ ]{{0,2}}\d{{3,8}}(?:[\- ]{{1,2}}\d{{1,5}})?{_END}"
    rf"|{_BEGIN}0[1-9]\d{{0,3}}[ \-]{{1,2}}\d{{4,8}}(?:[ \-]{{1,2}}\d{{3,6}})?{_END}",
    re.I,
)
SPELLED_PHONE = re.compile(rf"(?<![^\W\d_])(?:(?:{_DIGIT_WORDS})[\s,\-]{{1,3}}){{6,14}}(?:{_DIGIT_WORDS})(?![^\W\d_])", re.I)
_DIGIT_SET = frozenset(_DIGIT_WORDS.split("|"))
MAYBE_PHONE = re.compile(
    rf"{_BEGIN}(?:\d{{3}}[ .\-]{{1,2}}\d{{3}}[ .\-]{{1,2}}\d{{4}}|\d{{3}}(?:[ .\-]{{1,2}}\d{{2}}){{3}}|\d{{3}}[ ]{{1,2}}\d{{3}}[ ]{{1,2}}\d{{3}}|\d{{3}}[ ]\d{{4}}[ ]\d{{4}}|0\d{{3,4}}[ \-]{{1,2}}\d{{3}}[ \-]{{1,2}}\d{{3}}|0\d{{3,4}}[ ]{{1,2}}\d{{6,8}}|0\d{{9,10}}|\d{{9,10}}){_END}"
)
SURE_ID = re.compile(
    rf"{_BEGIN}(?:[A-Za-z]{{2}}[ ]{{0,3}}\d{{2}}[ ]{{0,3}}\d{{2}}[ ]{{0,3}}\d{{2}}[ ]{{0,3}}[A-Da-d](?![A-Za-z0-9])"
    rf"|[12][ .]{{0,2}}\d{{2}}[ .]{{0,2}}\d{{2}}[ .]{{0,2}}\d{{2}}[ .]{{0,2}}\d{{3}}[ .]{{0,2}}\d{{3}}[ .]{{0,2}}\d{{2}}{_END}"
    rf"|[XYZxyz][ \-]?\d{{7}}[ \-]?[A-Za-z](?![A-Za-z0-9])"
    rf"|[A-Za-z]{{6}}\d{{2}}[A-Za-z]\d{{2}}[A-Za-z]\d{{3}}[A-Za-z](?![A-Za-z0-9]))"
)
MAYBE_ID = re.compile(
    rf"{_BEGIN}(?:\d{{3}}[ \-.]{{0,2}}\d{{2}}[ \-.]{{0,2}}\d{{4}}|\d{{8}}[ \-]{{0,2}}[A-Za-z]|\d{{2}}[ ]{{0,2}}\d{{3}}[ ]{{0,2}}\d{{3}}[ ]{{0,2}}\d{{3}}|[A-Za-z]{{1,2}}[ ]?\d{{6,9}}|\d{{8}}|\d{{4}}[ \-]\d{{4}}[ \-]\d{{4}}|\d{{12}})(?![0-9A-Za-z]|[\-./]\d)"
)
#: numbers given to things: a letter and many digits, thirteen digits as on goods, digits behind a number sign, groups of digits that no form of
#: a person's number has, the letters and pairs of an insurance number without its end, hexadecimal groups, versions
THING = re.compile(
    r"(?<![A-Za-z0-9])(?:[A-Z]\d{10,12}|[A-Z]{2}\d{10,12}|\d{13}|#\d{6,12}|[A-Z]{2} \d{2} \d{2} \d{2}(?! ?[A-D]\b)|\d{4}-\d{2}-\d{4}|\d{2}-\d{4}-\d{5,7}|(?=[0-9A-F\-]*[A-F])[0-9A-F]{4}-[0-9A-F]{4}-[0-9A-F]{4}|v?\d{1,3}\.\d{1,3}\.\d{1,5})(?![A-Za-z0-9])",
    re.I,
)
ID_LABEL = re.compile(
    r"(?<![^\W\d_])(?:ssn|social|id card(?: n\w*)?|identity card|identity n\w+|carte d['’]identité|carta d['’]identità|social security(?: n\w*)?|nino?|ni n\w+|national insurance(?: n\w*)?|tax id|itin|passport(?: n\w*)?|nir|s[ée]cu|s[ée]curit[ée] sociale|id-?nr|steuer-?id|steuer\w*nummer|ausweis\w*|reisepass\w*|personalausweis\w*|dni|nie|nif|pasaporte|passeport|passaporto|codice fiscale|pesel|nip|paszport\w*|dow[óo]d\w*|マイナンバー|個人番号|パスポート番号)(?![^\W\d_])\.?[^\n.!?。\d]{0,40}\Z",
    re.I,
)

_EN_TYPES = r"(?:roads?|rd|streets?|st|lane|ln|drive|dr|close|terrace|ter|avenue|ave|boulevard|blvd|crescent|cres|grove|gardens|mews|parade|walk)\b\.?"
_EN_MORE = r"(?:Way|Court|Ct|Square|Sq|Hill|Place|Pl|Quay|Row|Green|Park|Gate)\b\.?"
_NO = r"\d{1,5}(?:[ ]?[a-zA-Z](?![^\W_]))?"
_FR_TYPES = r"(?:rue|r\.|avenue|av\.?|boulevard|bd\.?|boul\.|chemin|ch\.|place|pl\.|quai|impasse|imp\.|all[ée]e|cours|route|passage|square|sentier|ruelle)"
_ES_TYPES = r"(?:calle|c/|avenida|avda\.?|av\.|plaza|pza\.?|paseo|pº|camino|carrera|ronda|traves[íi]a|callej[óo]n|via|viale|corso|piazza|vicolo|largo|strada|ulica|ul\.|aleja|al\.|plac|pl\.|os\.)"
#: each with what a text in small letters must hold for the pattern to be tried, or None if it begins with a number
ADDRESSES = (
    (
        re.compile(
            rf"(?<![\w.,/\-]){_NO},?[ ]+(?:(?!and\b|or\b|of\b|in\b|the\b|a\b|to\b|days?\b|hours?\b|minutes?\b|weeks?\b|months?\b|years?\b|stars?\b|by\b|my\b)[^\W\d_][^\W\d_'’\-]*[ ]+){{1,3}}{_EN_TYPES}(?![^\W_])"
            rf"|(?<![\w.,/\-]){_NO},?[ ]+(?:(?-i:[A-Z])[^\W\d_'’\-]*[ ]+){{1,3}}(?-i:{_EN_MORE})(?![^\W_])"
            rf"|(?<![\w.,/\-])\d{{1,4}}(?:[ ]?(?:bis|ter|quater|[a-d]))?[ ]?,?[ ]+{_FR_TYPES}[ ]+(?:(?:de|du|des|la|le|les|aux?|à|st|saint|sainte)[ ]+|[ld]['’]){{0,3}}[^\W\d_][\w'’\-]*",
            re.I,
        ),
        None,
    ),
    (
        re.compile(
            rf"(?<![\w\-])[^\W\d_]{{2,}}(?:-[^\W\d_]+)*(?:-?(?:stra(?:ß|ss)e|str\.|gasse|weg|allee)|[ ](?-i:Stra(?:ß|ss)e|Str\.))[ ]+{_NO}(?![\w/]|[.,]\d)"
            rf"|(?<![\w\-])(?-i:[A-ZÄÖÜ])[^\W\d_]+(?:-[^\W\d_]+)*-?(?-i:[Pp]latz|[Uu]fer|[Dd]amm|[Ss]teig|[Cc]haussee)[ ]+{_NO}(?![\w/]|[.,]\d)",
            re.I,
        ),
        re.compile("stra(?:ß|ss)e|str\\.|gasse|weg|allee|platz|ufer|damm|steig|chaussee"),
    ),
    (
        re.compile(rf"(?<![^\W_]){_ES_TYPES}[ ]+(?:[^\W\d_][\w'’\-]*[ ]+){{0,4}}?[^\W\d_][\w'’\-]*,?[ ]+(?:(?:n[.ºo°]{{0,2}}|nr\.?|núm\.?|number)[ ]*)?{_NO}(?![\w/%]|[.,]\d)", re.I),
        re.compile(rf"(?<![^\W_]){_ES_TYPES}[ ]"),
    ),
)

TITLES = frozenset("mr mrs ms miss mx sir dr prof herr herrn frau fr m mme mlle madame monsieur sr sra srta don doña señor señora sig signor signora dott dott.ssa pan pani pana panem".split())
PARTICLES = frozenset("de del della di da dos van von der den la le du zu ten ter af av el y d' vom zum".split())
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_DIGITS = re.compile(r"\d+")
BESIDE = 12  #: characters beside digits that a pattern of a number can take in or look at; without a digit in so many, none goes on
_RESPECT = ("さん", "様", "氏", "先生")


@lru_cache(200_000)
def _flat(word: str) -> str:
    """A word for comparison: small letters, a doubled letter once."""
    return re.sub(r"(.)\1+", r"\1", word.lower())


def _close(a: str, b: str) -> bool:
    """Equal, or one letter put in, left out, changed or swapped with the next."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


class NameModel:
    """Name words: the known ones, and those made of a stem and an ending that known ones of the kind have.

    A cut of a word into stem and ending counts if both occur with several partners among the known words of its kind.
    """

    def __init__(self, known: list[tuple[str, str]], brands: list[str], partners: int = 3):
        self.sets: dict[str, frozenset[str]] = {}
        self.parts: dict[str, tuple[frozenset[str], frozenset[str]]] = {}
        self.longest: dict[str, tuple[int, int]] = {}
        for kind in ("given", "family"):
            words = {w.lower() for w, k in known if w and k == kind}
            ends, stems = {}, {}
            for w in words:
                for i in range(2, len(w) - 1):
                    ends.setdefault(w[i:], set()).add(w[:i])
                    stems.setdefault(w[:i], set()).add(w[i:])
            good_end = {e for e, s in ends.items() if len(s) >= partners and len(e) >= 2}
            good_stem = {s for s, e in stems.items() if len(e & good_end) >= partners}
            good_end = {e for e in good_end if len(ends[e] & good_stem) >= partners}
            self.sets[kind] = frozenset(_flat(w) for w in words)
            self.parts[kind] = (frozenset(good_stem), frozenset(good_end))
            #: no word with more letters is made of a stem and an ending, even with letters doubled
            self.longest[kind] = max(map(len, good_stem), default=0), max(map(len, good_end), default=0)
        parts = [[_flat(p) for p in b.split()] for b in brands if b]
        self.brands = frozenset((p[0], p[-1]) for p in parts if len(p) > 1)
        self._seen: dict[str, dict[str, int]] = {"given": {}, "family": {}}

    def kind(self, word: str, kind: str) -> int:
        """2 if the word is known as a name of the kind, 1 if it is made like one, else 0."""
        seen = self._seen[kind]
        got = seen.get(word)
        if got is None:
            if len(seen) > 150_000:
                seen.clear()
            got = seen[word] = self._judge(word, kind)
        return got

    def _judge(self, word: str, kind: str) -> int:
        w = word.lower()
        if _flat(w) in self.sets[kind]:
            return 2
        stems, ends = self.parts[kind]
        stem, end = self.longest[kind]
        for form in {w, re.sub(r"(.)\1+", r"\1", w)}:
            for i in range(max(2, len(form) - end), min(stem, len(form) - 2) + 1):
                if form[:i] in stems and form[i:] in ends:
                    return 1
        return 0

    def near(self, word: str, kind: str) -> bool:
        """One letter swapped, left out, put in or changed away from a name of the kind."""
        w = word.lower()
        if not 5 <= len(w) <= sum(self.longest[kind]) + 1:
            return False
        for i in range(len(w)):
            if self.kind(w[:i] + w[i + 1 :], kind) or (i + 1 < len(w) and self.kind(w[:i] + w[i + 1] + w[i] + w[i + 2 :], kind)):
                return True
        letters = set("".join(self.parts[kind][0]) + "".join(self.parts[kind][1]))
        return any(self.kind(w[:i] + c + w[i:], kind) for i in range(1, len(w) + 1) for c in letters)

    def is_brand(self, first: str, last: str) -> bool:
        """Whether two words are a brand; one of them may be misspelled by a letter."""
        a, b = _flat(first), _flat(last)
        return any((a == x and _close(b, y)) or (b == y and _close(a, x)) for x, y in self.brands)


class Form:
    """A place in the normal form that is, or may be, personal information."""

    __slots__ = ("kind", "start", "end", "sure", "terms")

    def __init__(self, kind: str, start: int, end: int, sure: bool, terms: tuple[str, ...] = ()):
        self.kind, self.start, self.end, self.sure, self.terms = kind, start, end, sure, terms


# Abbreviations before numbers, after which a stop ends no sentence.
_SHORT = frozenset("tel tél telef mob cel port ph fax no nr n num núm idnr id nip st".split())


def _around(t: str, start: int, end: int) -> tuple[str, ...]:
    """The terms next to a number in its sentence: one and two words before it, one and two after it.

    A line break counts as a word. A stop followed by a blank ends the sentence, but not behind an abbreviation.
    """
    left = t[max(0, start - 48) : start]
    m = re.search(r"([^\W\d_]*)([.!?。][ ]+[^\w\n+(]*)\Z", left)
    if m and m.group(1).lower() not in _SHORT:
        left = ""
    right = re.split(r"[.!?。](?!\w)", t[end : end + 48], maxsplit=1)[0]
    before = [_flat(w) for w in re.findall(r"\n|[^\W\d_]+", left)[-2:]]
    after = [_flat(w) for w in re.findall(r"\n|[^\W\d_]+", right)[:2]]
    out = []
    if before:
        out += ["<" + before[-1], "<<" + " ".join(before)]
    if after:
        out += [">" + after[0], ">>" + " ".join(after)]
    return tuple(out)


def _shape(s: str) -> str:
    """A number with all digits alike and all letters alike, but for a leading zero and the digit behind it, which name a numbering plan."""
    head = 2 if s[:1] == "0" else 0
    return "#" + s[:head] + re.sub(r"[^\W\d_]", "A", re.sub(r"\d", "9", s[head:]))


def _number(kind: str, t: str, start: int, end: int, sure: bool) -> Form:
    """A number with the terms that tell what it is: those around it and its shape."""
    return Form(kind, start, end, sure, (*_around(t, start, end), _shape(t[start:end])))


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def _overlaps(taken: bytearray, a: int, b: int) -> bool:
    return taken.find(1, a, b) >= 0


def words_of(t: str) -> list[tuple[str, int, int]]:
    return [(m.group(0), m.start(), m.end()) for m in _WORD.finditer(t)]


def regions_of(t: str) -> list[tuple[int, int]]:
    """The parts of a text that numbers can lie in: digits with what patterns of numbers take in around them."""
    out: list[list[int]] = []
    for m in _DIGITS.finditer(t):
        a, b = max(0, m.start() - BESIDE), min(len(t), m.end() + BESIDE)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _at_numbers(pattern: re.Pattern, t: str) -> Iterator[re.Match]:
    """The matches of a pattern that can begin at the first digit of a number only."""
    end = 0
    for d in _DIGITS.finditer(t):
        if d.start() >= end and (m := pattern.match(t, d.start())):
            yield m
            end = m.end()


def find_forms(t: str, names: NameModel, words: list[tuple[str, int, int]] | None = None) -> list[Form]:
    """Forms in a text in normal form; they do not overlap, except that an ambiguous number can have two readings.

    ``words`` are those of the text, if they are known.
    """
    words = words_of(t) if words is None else words
    regions = regions_of(t)
    numbers = lambda pattern: (m for a, b in regions for m in pattern.finditer(t, a, b))
    out: list[Form] = []
    taken = bytearray(len(t))  # 1 where a character belongs to a form

    def take(f: Form) -> None:
        out.append(f)
        taken[f.start : f.end] = b"\1" * (f.end - f.start)

    small = t.lower().replace("i\u0307", "i").replace("ı", "i")  # as patterns that ignore case see it
    m = EMAIL.search(t) if "@" in t or _AT_HINT.search(small) else None
    while m:
        terms = (*_around(t, m.start(1), m.end(3)), "@" + m.group(4).lower())
        spelled = "@" not in m.group(2) and not re.search(r"[(\[{]", m.group(2))
        if spelled and m.group(4).lower() not in _DOMAINS:
            out.append(Form("email", m.start(1), m.end(3), False, terms))
            m = EMAIL.search(t, m.end(2))  # it may be an "at" of the sentence, and the address begin behind it
            continue
        take(Form("email", m.start(1), m.end(3), True, terms))
        m = EMAIL.search(t, m.end())
    for m in _HANDLE.finditer(t):
        taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    for pattern, hints in ADDRESSES if regions else ():
        if hints is None:  # such an address begins with its number
            found = _at_numbers(pattern, t)
        elif hints.search(small):
            found = pattern.finditer(t)
        else:
            continue
        for m in found:
            if not _overlaps(taken, m.start(), m.end()):
                take(Form("address", m.start(), m.end(), True, _around(t, m.start(), m.end())))
    for m in numbers(SURE_ID):
        if not _overlaps(taken, m.start(), m.end()):
            take(_number("id_number", t, m.start(), m.end(), True))
    for m in numbers(SURE_PHONE):
        n, first = _digits(m.group(0)), m.group(0)
        if _overlaps(taken, m.start(), m.end()) or ID_LABEL.search(t[max(0, m.start() - 70) : m.start()]):
            continue
        if not (12 <= n <= 15 if first.startswith("00") else 9 <= n <= 15):
            continue
        take(_number("phone", t, m.start(), m.end(), True))
    parts = "-".join([w for w, _, _ in words]).lower().replace("i\u0307", "i").replace("ı", "i").replace("'", "-").replace("’", "-").split("-")
    if sum(map(_DIGIT_SET.__contains__, parts)) >= 7:
        for m in SPELLED_PHONE.finditer(t):
            if not _overlaps(taken, m.start(), m.end()):
                take(Form("phone", m.start(), m.end(), True, _around(t, m.start(), m.end())))
    for m in numbers(MAYBE_ID):
        if _overlaps(taken, m.start(), m.end()):
            continue
        labelled = bool(ID_LABEL.search(t[max(0, m.start() - 70) : m.start()])) or bool(re.match(r"(?i)[^\n]{0,16}\bmy (?:ssn|social|tax id|passport|ni)\b", t[m.end() : m.end() + 40]))
        f = _number("id_number", t, m.start(), m.end(), labelled)
        take(f) if labelled else out.append(f)
    for m in numbers(MAYBE_PHONE):
        if not _overlaps(taken, m.start(), m.end()):
            out.append(_number("phone", t, m.start(), m.end(), False))
    out += [f for f in _find_names(t, names, words) if not _overlaps(taken, f.start, f.end)]
    return out


# Frequent French words that are no words of the neighbouring languages.
_FRENCH = frozenset("les des est et très pour une chez du au avec merci cordialement sans livré reçue jours dans mesures j qui vous".split())


def _is_french(words: list[tuple[str, int, int]]) -> bool:
    """Whether one word in fifteen is French; there, ``M.`` is a form of address and not an initial."""
    n = sum(w.lower().split("'")[0].split("’")[0] in _FRENCH for w, _, _ in words)
    return n >= 2 and n * 15 >= len(words)


_BLANKS = frozenset((" ", "  ", "   "))  #: what may stand between the words of a name
_STOPS = frozenset((".", ". ", ".  ", ".   "))


def _find_names(t: str, names: NameModel, words: list[tuple[str, int, int]]) -> list[Form]:
    """Family names with a given name, an initial or a form of address."""
    out: list[Form] = []
    done, french = -1, None

    def family(w: str) -> int:
        return min(names.kind(p, "family") for p in w.split("-")) if "-" in w else names.kind(w, "family")

    def given(w: str) -> int:
        return min(names.kind(p, "given") for p in w.split("-")) if "-" in w else names.kind(w, "given")

    for i, (w, a, b) in enumerate(words):
        if len(w) < 3 or a < done:
            continue
        f = family(w)
        if not f and not w[0].isupper():
            continue
        # what stands before: particles, then a given name, an initial or a title
        j, start = i - 1, a
        while j >= 0 and j >= i - 3 and words[j][0].lower() in PARTICLES and t[words[j][2] : start].isspace() and "\n" not in t[words[j][2] : start]:
            start = words[j][1]
            j -= 1
        with_particle = start
        gap = t[words[j][2] : start] if j >= 0 else ""
        lead = words[j][0] if j >= 0 else ""
        form = None
        if j >= 0 and gap in _BLANKS:
            g = given(lead)
            if g and (f or lead[0].isupper()):
                form = (words[j][1], g, lead)
            elif not g and f and len(lead) >= 5 and lead[0].isupper() and names.near(lead, "given"):
                form = (words[j][1], 1, lead)
            elif lead.lower() in TITLES and f:
                form = (with_particle, 2, "")
        elif j >= 0 and gap in _STOPS and len(lead) == 1 and f:
            k = j - 1
            if k >= 0 and t[words[k][2] : words[j][1]] in _BLANKS and given(words[k][0]):
                form = (words[k][1], given(words[k][0]), words[k][0])
            elif lead.lower() == "m" and (french := _is_french(words) if french is None else french):
                form = (with_particle, 2, "")
            else:
                form = (words[j][1], 2, "")
        elif j >= 0 and gap in _STOPS and gap != "." and lead.lower() in TITLES and f:
            form = (with_particle, 2, "")
        if form is None and f:
            # family name, given name or initial; or a form of address behind it
            rest = t[b : b + 40]
            m = re.match(r",[ ]{1,2}([^\W\d_]+(?:-[^\W\d_]+)*)", rest)
            if m and given(m.group(1)):
                form = (with_particle if with_particle != a else a, given(m.group(1)), m.group(1))
                b = b + m.end()
            elif m and len(m.group(1)) == 1 and rest[m.end() : m.end() + 1] == ".":
                form = (a, 2, "")
            elif rest.startswith(_RESPECT):
                form = (a, 2, "")
        if form is None:
            continue
        begin, g, first = form
        titled = False
        if first:
            back = t[max(0, begin - 12) : begin]
            titled = bool(re.search(r"(?i)(?<![^\W\d_])(?:mr|mrs|ms|miss|dr|prof|herrn?|frau|mme|m|mlle|sr|sra|sig|pani?)\.?[ ]+\Z", back))
        if first and names.is_brand(first, w) and not titled:
            continue
        if f:
            out.append(Form("person_name", begin, b, True, tuple("=" + _flat(x) for x in _WORD.findall(t[begin:b]) if len(x) > 2)))
            done = b
        elif first and g == 2 and w[0].isupper() and len(w) >= 4 and names.near(w, "family"):
            out.append(Form("person_name", begin, b, False, ("=" + _flat(w),)))
    return out


# ---- the corpus

_cache: dict[int, NameModel] = {}


def _model(known: list, brands: list) -> NameModel:
    key = hash((tuple(known), tuple(brands)))
    if key not in _cache:
        _cache[key] = NameModel(known, brands)
    return _cache[key]


FORMS = "uid long, kind string, start long, stop long, sure boolean, terms array<string>, n long"


def read_forms(documents: DataFrame, known: list, brands: list) -> DataFrame:
    """Forms of all texts, and what else the corpus teaches; every text is read once.

    Rows of the kinds of ``PLACEHOLDERS`` are forms, with places in the original text. Rows without ``uid`` are evidence:
    ``thing``, the terms next to a number that is certainly given to a thing; ``name``, the words of a name;
    ``seen``, a capitalised word and how often (``n``) texts of a task have it.
    """

    fields = [c.split() for c in FORMS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _model(known, brands)
        counts: dict[str, Counter] = {"thing": Counter(), "name": Counter(), "seen": Counter()}

        def evidence_rows() -> list[tuple]:
            out = [(None, kind, None, None, True, [term], n) for kind, c in counts.items() for term, n in c.items()]
            for c in counts.values():
                c.clear()
            return out

        for batch in batches:
            rows: list[tuple] = []
            seen: Counter = Counter()
            for uid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                t, place = normal_form(text)
                words = words_of(t)
                forms = find_forms(t, names, words)
                covered = bytearray(len(t))
                for f in forms:
                    covered[f.start : f.end] = b"\1" * (f.end - f.start)
                    stop = place[f.end] if f.end < len(place) else len(text)
                    rows.append((uid, f.kind, place[f.start], stop, f.sure, list(f.terms), 1))
                    if f.kind == "person_name":
                        counts["name"].update("=" + _flat(x) for x in _WORD.findall(t[f.start : f.end]) if len(x) > 2)
                for m in (m for a, b in regions_of(t) for m in THING.finditer(t, a, b)):
                    if _overlaps(covered, m.start(), m.end()):
                        continue  # what may be personal teaches nothing about things
                    counts["thing"].update((*_around(t, m.start(), m.end()), _shape(m.group(0))))
                seen.update(w for w, _, _ in words if w[0].isupper())
            for w, n in seen.items():
                counts["seen"]["=" + _flat(w)] += n
            if sum(map(len, counts.values())) > KEPT_COUNTS:
                rows += evidence_rows()
            if rows:
                yield made(rows)
        if rows := evidence_rows():
            yield made(rows)

    return documents.select("uid", "text").mapInArrow(run, FORMS)


KINDS = ("phone", "id_number", "email", "address", "thing", "name", "seen")


def evidence(forms: DataFrame) -> DataFrame:
    """``term`` and, for each of ``KINDS``, how often it stands by such a form, over all documents."""
    rows = forms.where(F.col("sure") & F.col("kind").isin(*KINDS)).select("kind", F.explode("terms").alias("term"), "n")
    return rows.groupBy("term").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in KINDS])


def strengths(counts: DataFrame) -> DataFrame:
    """``term, kind, strength``: log odds that what stands by the term is of the kind. Terms never seen disclose nothing (0).

    A number is told from numbers of the other kind and of things; an address, which its form tells from the other kinds, from
    things only; a name from the same word where it is part of none.
    """
    odds = lambda yes, no: F.log((yes + 0.5) / (no + 0.5))
    c = F.col
    personal = c("phone") + c("id_number") + c("email") + c("address")
    each = {
        "phone": odds(c("phone"), c("thing") + c("id_number")), "id_number": odds(c("id_number"), c("thing") + c("phone")),
        "email": odds(personal, c("thing")), "address": odds(personal, c("thing")),
        "person_name": odds(c("name"), F.greatest(F.lit(0), c("seen") - c("name"))),
    }
    bound = lambda x: F.least(F.lit(STRONGEST), F.greatest(F.lit(-STRONGEST), x))
    return counts.select("term", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), bound(x).alias("strength")) for k, x in each.items()])))


def scored(documents: DataFrame, known_names: DataFrame, items: DataFrame) -> DataFrame:
    """``uid, kind, start, stop, sure, corpus, strength`` of every form; ``corpus`` is what its terms disclose, ``strength`` with its pattern.

    ``documents`` must have ``uid`` and ``text``. ``known_names`` (``word``, ``word_kind``) and the brands of ``items`` are word
    lists that do not grow with the corpus; they are collected.
    """
    known = sorted({(r[0], r[1]) for r in known_names.where("word is not null").select("word", "word_kind").collect()}, key=str)
    brands = sorted({r[0] for r in items.where("brand is not null").select("brand").distinct().collect()})
    forms = storage.staged(read_forms(documents, known, brands), "forms")
    table = storage.staged(strengths(evidence(forms)), "strengths")
    found = forms.where(F.col("uid").isNotNull())
    if table.count() <= 5 * BROADCAST_TERMS:
        table = F.broadcast(table)
    where = ["uid", "kind", "start", "stop", "sure"]
    terms = found.select(*where, F.explode_outer("terms").alias("term")).join(table, ["term", "kind"], "left")
    weighted = F.coalesce(F.col("strength"), F.lit(0.0)) * F.when(F.col("term").startswith(">"), AFTER).otherwise(1.0)
    out = terms.groupBy(*where).agg(F.when(F.col("kind") == "person_name", F.max(weighted)).otherwise(F.sum(weighted)).alias("corpus"))
    # each word of a name would do by itself: a given name that is mostly alone says nothing against the family name behind it
    return out.withColumn("strength", F.col("corpus") + F.when(F.col("sure"), SEED).otherwise(0.0))


def spans(documents: DataFrame, known_names: DataFrame, items: DataFrame) -> DataFrame:
    """``uid, kind, start, stop, first, last`` of every case, with positions in code points of the original text.

    Of forms that overlap, the one that discloses most is the case, at ``start``; ``first`` to ``last`` is all that they
    cover together, so that nothing of a lesser one is left when the case is replaced.
    """
    taken = scored(documents, known_names, items).where(F.col("strength") > THRESHOLD)
    over = Window.partitionBy("uid").orderBy("start", "stop", "kind")  # the forms of one text
    reach = F.max("stop").over(over.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.when(F.coalesce(F.col("start") < reach, F.lit(False)), 0).otherwise(1)
    groups = taken.withColumn("apart", apart).withColumn("case", F.sum("apart").over(over))
    best = F.max(F.struct("sure", "strength", "kind", "start", "stop"))
    groups = groups.groupBy("uid", "case").agg(best.alias("b"), F.min("start").alias("first"), F.max("stop").alias("last"))
    return groups.select("uid", "b.kind", "b.start", "b.stop", "first", "last")


def with_uid(documents: DataFrame, *columns: str) -> DataFrame:
    """Rows numbered so that each is one of its own, whatever its id; staged, so that the numbers stay."""
    return storage.staged(documents.select(*columns).withColumn("uid", F.monotonically_increasing_id()), "documents")


def found(documents: DataFrame, known_names: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, pii_kind, start_pos``: every case of personal information in the texts.

    Null, empty and blank texts have none. Repeated rows have theirs each. An empty corpus gives an empty result; empty word lists
    leave only what needs no names. Further columns are ignored.
    """
    d = with_uid(documents, "doc_id", "text")
    s = spans(d, known_names, items)
    return s.join(d.select("uid", "doc_id"), "uid").select("doc_id", F.col("kind").alias("pii_kind"), F.col("start").alias("start_pos"))


def sanitised(documents: DataFrame, known_names: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, text, replaced``: each text with its cases replaced by placeholders, the rest unchanged.

    Null texts stay null, empty ones empty. One row per row of the input.
    """
    d = with_uid(documents, "doc_id", "text")
    s = spans(d, known_names, items).groupBy("uid").agg(F.collect_list(F.struct("first", "last", "kind")).alias("cases"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for text, cases in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                out, at, n = [], 0, 0
                for c in sorted(cases or [], key=lambda c: c["first"]):
                    out += [text[at : c["first"]], PLACEHOLDERS[c["kind"]]]
                    at, n = c["last"], n + 1
                texts.append(None if text is None else "".join([*out, text[at:]]))
                counts.append(n)
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "replaced"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return d.join(s, "uid", "left").select("doc_id", "text", "cases").mapInArrow(run, f"doc_id {kind}, text string, replaced int")
