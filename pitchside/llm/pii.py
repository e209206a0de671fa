"""Personal data: exact base patterns, and disguised identifiers by offset-preserving transducers.

The base patterns run over the source text. Texts that show a sign of disguise also pass through
transducers, which rewrite homoglyphs, invisible characters, spelled digits and at/dot disguises and
keep, for every character they write, the source characters that it stands for. The same patterns
run over the rewritten text; what they find is mapped back to the source and added, unless a base span of
its kind covers it or sticks out of it.

Defined cases: a null or empty text has no spans. Repeated rows give the same row each. A null
doc_id is kept. An empty table gives an empty result. Other columns are ignored. Time is linear in
the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable
from functools import cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pitchside.llm.common import per_document

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match never ends or starts inside a run of digits, so each run is tried once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches: the whole local run before an @ that a domain follows."""
    out, free = [], 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            free = m.end()
    return out


def ips(text: str) -> list[Span]:
    return [m.span() for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(doubled)) % 10 == 0


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]


DETECT: dict[str, Callable[[str], list[Span]]] = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Letters of other scripts that look like Latin ones, in the order of what they stand for.
LOOKALIKES = {
    "а": "a", "ɑ": "a", "α": "a", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ι": "i", "ј": "j", "ӏ": "l", "ո": "n", "о": "o", "ο": "o", "р": "p", "ԛ": "q", "ѕ": "s", "υ": "u", "ѵ": "v", "ν": "v", "ѡ": "w", "х": "x", "у": "y",
    "А": "A", "Α": "A", "В": "B", "Β": "B", "С": "C", "Е": "E", "Ε": "E", "Ζ": "Z", "Н": "H", "Η": "H", "І": "I", "Ι": "I", "Ј": "J", "К": "K", "Κ": "K", "М": "M", "Μ": "M", "Ν": "N", "О": "O", "Ο": "O", "Р": "P", "Ρ": "P", "Ѕ": "S", "Т": "T", "Τ": "T", "Υ": "Y", "Х": "X", "Χ": "X",
    "。": ".", "｡": ".", "․": ".", "﹒": ".", "﹫": "@",
}
INVISIBLE = "­​‌‍⁠﻿"
#: Kinds of Unicode decompositions that keep what a character means; raised and lowered digits do not.
FORMS = ("<font>", "<wide>", "<small>", "<circle>", "<narrow>")
#: Spelled digits in English, German, French and Spanish.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
REPEATS = {"double": 2, "triple": 3}
SIGNS = {"plus": "+", "dot": ".", "point": ".", "punkt": ".", "punto": ".", "dash": "-", "minus": "-"}
_UNIT = "|".join(sorted([*SPELLED, *REPEATS, *SIGNS, r"[0-9]"], key=len, reverse=True))
RUN = re.compile(rf"(?<!\w)(?:{_UNIT})(?:[ ,-]{{1,2}}(?:{_UNIT}))+(?!\w)", re.I)
UNIT = re.compile(rf"(?:{_UNIT})(?!\w)", re.I)
_WORD = r"\s?(at|arroba|arobase|ät|@|dot|punkt|point|punto|\.)\s?"
BRACKETED = re.compile(rf" ?(?:\[{_WORD}\]|\({_WORD}\)|\{{{_WORD}\}}) ?", re.I)
#: How a domain with a spoken at and spoken dots has to end, so that prose is left alone: country codes and the most common others.
TOP_LEVEL = frozenset(
    """com org net edu gov mil int info biz io name pro aero coop museum jobs mobi travel tel cat asia post arpa dev app page new cloud online site store shop tech blog xyz club live life world today news media agency email
    company digital design studio solutions services systems software network global group team work works space website press wiki zone top vip win fun one plus link click guru expert academy school university college education
    health care clinic dental law legal finance financial bank insurance consulting capital ventures partners energy earth eco bio farm garden restaurant cafe bar pizza hotel tours football tennis golf sport games game video film
    photo photos photography pics gallery art music band audio love family kids baby dog house homes estate properties land city town berlin hamburg koeln cologne bayern wien zuerich paris london wales scot irish nyc tokyo amsterdam brussels vlaanderen gent
    swiss quebec madrid barcelona eus gal bzh alsace corsica ruhr saarland tirol moscow istanbul africa lat kiwi ngo ong foundation charity church gmbh ltd llc inc
    ac ad ae af ag ai al am ao aq ar as at au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee eg er es et eu fi fj fk fm fo fr
    ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in iq ir is it je jm jo jp ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz
    na nc ne nf ng ni nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sk sl sm sn so sr ss st su sv sx sy sz tc td tf tg th tj tk tl tm tn to tr tt tv tw tz
    ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw""".split()
)
#: Of these, words that prose has after "the dot"; with a spoken at they end no domain whose label before is an article.
WORDY = frozenset("am as be do et id is la me my no pa re se so to new page live life world today news work works space top win fun one plus link love family house land city town school university college health care game games video art music band group team bar name post bank law cat dog".split())
ARTICLES = frozenset("the this that a each every one".split())
_AT, _DOT = "at|arroba|arobase", "dot|punkt|point|punto"
#: An at and a domain of any style; where the address starts and ends is up to `_local_start` and `_domain_end`.
SPOKEN = re.compile(rf"( (?:{_AT}) | ?@ ?)([A-Za-z0-9-]+(?:(?: (?:{_DOT}) |\.)[A-Za-z0-9-]+)+)", re.I)
DOT_BEFORE = tuple(f" {w} " for w in ("dot", "punkt", "punto"))
LABEL_END = re.compile(rf"(?: (?:{_DOT}) |\.)([A-Za-z0-9-]+)(?!\w)", re.I)
ENDING = re.compile(r"[A-Za-z]{2,}|xn--[A-Za-z0-9-]+", re.I)
SPOKEN_WORD = re.compile(rf" ({_AT}|{_DOT}) | ?(@) ?", re.I)
#: Bracketed or spoken signs, or a run of spelled digits.
SPELLED_SIGNS = re.compile(
    rf"[\[({{]\s?(?:at|arroba|arobase|ät|@|dot|punkt|point|punto|\.)\s?[\])}}]"
    rf"|(?: (?:{_AT}) |@ ?)[a-z0-9.-]+ (?:{_DOT}) | (?:dot|punkt|punto) [a-z0-9_%+.-]+ (?:{_AT}) [a-z0-9-]+\.[a-z]|(?<!\w)(?:{'|'.join([*SPELLED, *REPEATS])})[ ,-]{{1,2}}(?:{_UNIT})[ ,-]{{1,2}}(?:{_UNIT})[ ,-]{{1,2}}(?:{_UNIT})(?!\w)",
    re.I,
)


class Tape:
    """A rewritten text: each character with the source range that it stands for."""

    def __init__(self, text: str, spans: list[Span] | None = None):
        self.text = text
        self.spans = spans if spans is not None else [(i, i + 1) for i in range(len(text))]

    def rewrite(self, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Tape:
        """Each edit (start, end, output) puts characters, each for a range of this tape, in place of a range."""
        out, spans, at = [], [], 0
        for start, end, pieces in edits:
            out.append(self.text[at:start])
            spans += self.spans[at:start]
            for char, s, e in pieces:
                out.append(char)
                spans.append((self.spans[s][0], self.spans[e - 1][1]))
            at = end
        out.append(self.text[at:])
        spans += self.spans[at:]
        return Tape("".join(out), spans)

    def source(self, span: Span) -> Span:
        return self.spans[span[0]][0], self.spans[span[1] - 1][1]


@cache
def plain_character(c: str) -> str:
    """The ASCII character that one stands for: look-alikes, decimal digits of all scripts, and compatibility forms (wide, small, circled, mathematical)."""
    if c in INVISIBLE:
        return ""
    if c.isascii():
        return c
    if c.isdecimal():
        return str(int(c))
    form, *of = unicodedata.decomposition(c).split() or [""]
    if form in FORMS and len(of) == 1 and int(of[0], 16) < 128:
        return chr(int(of[0], 16))
    return LOOKALIKES.get(c, c)


@cache
def disguising() -> frozenset[str]:
    """All characters that stand for another."""
    return frozenset(c for c in map(chr, chain(range(128, 0xD800), range(0xE000, 0x20000))) if plain_character(c) != c)


def may_hide(text: str) -> bool:
    """A text for which this is false has nothing to rewrite: no character that stands for another, no bracketed or spoken sign, no spelled digits."""
    return not (text.isascii() or disguising().isdisjoint(text)) or SPELLED_SIGNS.search(text) is not None


def characters(tape: Tape) -> Tape:
    """Homoglyphs, other decimal digits and invisible characters."""
    edits = []
    for i, c in enumerate(tape.text):
        if not c.isascii() and (p := plain_character(c)) != c:
            edits.append((i, i + 1, [(p, i, i + 1)] if p else []))
    return tape.rewrite(edits)


def spelled_digits(tape: Tape, least: int = 4) -> Tape:
    """Runs with at least so many spelled digits; digits keep one space between them, signs stand alone."""
    edits = []
    for m in RUN.finditer(tape.text):
        units = list(UNIT.finditer(tape.text, m.start(), m.end()))
        if sum(u.group().lower() in SPELLED for u in units) < least:
            continue
        pieces: list[tuple[str, int, int]] = []
        times = 1
        for i, u in enumerate(units):
            word = u.group().lower()
            if word in REPEATS:
                times = REPEATS[word]
                continue
            char = SPELLED.get(word) or SIGNS.get(word) or word
            start = units[i - 1].start() if times > 1 else u.start()
            pieces += [(char, start, u.end())] * times
            times = 1
        edits.append((m.start(), m.end(), pieces))
    return tape.rewrite(edits)


def _local_start(text: str, at: int, floor: int) -> int | None:
    """Where the local part before an at starts: letters, digits and signs, and plain or spoken dots before one of them."""
    i, starts = at, []
    while i > floor:
        c, inside = text[i - 1], i < at and (text[i].isalnum() or text[i] == "_")
        if c in LOCAL and (c != "." or inside):
            i -= 1
        elif inside and (word := next((w for w in DOT_BEFORE if text[max(floor, i - len(w)) : i].lower() == w), None)):
            starts.append(i)
            i -= len(word)
        else:
            break
    before = text[i - 1 : i]
    if not (before.isalnum() or before in ("_", ".", "+", "-") and before):
        starts.append(i)
    return next((s for s in reversed(starts) if s < at and text[s].isascii() and text[s].isalnum()), None)


def _domain_end(tape: Tape, local: str, m: re.Match) -> int | None:
    """Where the address with this local part and a match of SPOKEN ends; None if it is none.

    Any ending will do where the at is a sign, a dot of the domain stands for a bracketed one, or the
    local part has dots or underscores; else it has to be a known one.
    """
    start = m.start(2)
    sign = "@" in m.group(1)
    bracketed = any(c == "." and tape.spans[i][1] - tape.spans[i][0] > 1 for i, c in enumerate(m.group(2), start))
    free = sign or bracketed or re.search(r"[A-Za-z]\.[A-Za-z]|_", local) is not None
    spoken = bracketed or " " in local
    known = other = None
    before = re.match(r"[A-Za-z0-9-]+", m.group(2)).group()
    for x in LABEL_END.finditer(tape.text, start, m.end()):
        spoken = spoken or x.group()[0] == " "
        label = x.group(1)
        if (sign or spoken) and label.lower() in TOP_LEVEL and (sign or not (label.lower() in WORDY and before.lower() in ARTICLES)):
            known = x.end() if spoken else 0  # 0: a plain address, with prose after it
        if spoken and free and ENDING.fullmatch(label):
            other = x.end()
        before = label
    return other if known is None else known or None


def at_and_dot(tape: Tape) -> Tape:
    """Bracketed signs anywhere; spoken ones only in an address as a whole, of which some signs may be plain or bracketed."""
    edits = []
    for m in BRACKETED.finditer(tape.text):
        word = (m.group(1) or m.group(2) or m.group(3)).lower()
        edits.append((m.start(), m.end(), [("@" if word in ("at", "arroba", "arobase", "ät", "@") else ".", m.start(), m.end())]))
    tape = tape.rewrite(edits)
    edits, at = [], 0
    while m := SPOKEN.search(tape.text, at):
        start = _local_start(tape.text, m.start(), at)
        end = None if start is None else _domain_end(tape, tape.text[start : m.start()], m)
        at = end or m.start(2)
        for w in SPOKEN_WORD.finditer(tape.text, start, end) if end else ():
            edits.append((w.start(), w.end(), [("@" if w.group(2) or w.group(1).lower() in ("at", "arroba", "arobase") else ".", w.start(), w.end())]))
    return tape.rewrite(edits)


def find(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans and all spans, by kind and start."""
    base = {k: DETECT[k](text) for k in KINDS}
    if not may_hide(text):
        return base, base
    tape = at_and_dot(spelled_digits(characters(Tape(text))))
    found = {}
    for k in KINDS:
        own = base[k]
        more = [s for s in map(tape.source, DETECT[k](tape.text)) if not any(s[0] < b[1] and b[0] < s[1] and not (s != b and s[0] <= b[0] and b[1] <= s[1]) for b in own)]
        found[k] = sorted(own + more)
    return base, found


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(chain.from_iterable((f"{k}:{s}:{e}" for s, e in spans[k]) for k in KINDS))


FIELDS = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"


def _row(key: int | None, text: str) -> tuple:
    base, found = find(text)
    counts = [len(base[k]) for k in KINDS]
    return (key, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), sum(map(len, found.values())) - sum(counts))


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of docs; offsets are code points of the source, the end is exclusive."""
    return per_document(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _row, FIELDS)


def masked(text: str, mask: str = "*") -> str:
    """The text with every found span overwritten, same length."""
    out = list(text)
    for s, e in chain.from_iterable(find(text)[1].values()):
        out[s:e] = mask * (e - s)
    return "".join(out)
