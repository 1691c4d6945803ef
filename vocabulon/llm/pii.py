"""Personal data: base patterns on the text as it is, and the same patterns on a deobfuscated form.

Deobfuscation is a chain of transducers.  Each rewrites part of a text and keeps, for every
character of its output, the span of source characters it came from: homoglyphs and compatibility
forms become ASCII, invisible characters vanish, bracketed or spelled ``at`` and ``dot`` become
``@`` and ``.``, spelled digits become digits.  What the patterns find there maps back to source
spans.  Base spans always stay; a further span is added unless a base span of its kind covers it.

Defined cases: null text counts as empty; repeated rows each get a row; matches that fail their
test (a part over 255, a wrong checksum, too few digits) are dropped without a second try; matching
is linear in the text's length, so long texts and long runs are safe; extra columns aren't looked at,
and ``redacted`` returns them as they were; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The kinds in the order in which they are listed.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain: every ``@`` with the run of local characters before it."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1  # no local part reaches across an @
        at = text.find("@", max(done, at + 1))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def find(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    out = [(0, s, e) for s, e in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(x := g.lstrip("0")) < 4 and int(x or 0) <= 255 for g in m.groups())]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        if "+" in text:
            out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# Letters of other scripts that look like ASCII letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j",
    "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "м": "m", "н": "h", "т": "t", "к": "k",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C",
    "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "α": "a", "ο": "o", "ρ": "p",
    "ν": "v", "ι": "i", "κ": "k", "υ": "u", "χ": "x", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z",
    "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "ɡ": "g", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".",
}
INVISIBLE = "­​‌‍⁠﻿"
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_EXOTIC = re.compile("[­ıɡͰ-ϿЀ-ԯ٠-٩۰-۹०-९​-‍‐-–․⁠-ₜ−①-⒛。﹒﹫﻿！-～\U0001d400-\U0001d7ff]")
_I = re.I | re.A
# Blanks are read from the start of their run only, and never given back, so long runs take linear time.
_BLANKS = r"(?:(?<![\x20\t])[\x20\t]++)?"
_BRACKET_AT = re.compile(_BLANKS + r"[\[({<][\x20\t]*+(?:at|@)[\x20\t]*+[\])}>][\x20\t]*+", _I)
_BRACKET_DOT = re.compile(_BLANKS + r"[\[({<][\x20\t]*+(?:dot|punkt|point|punto|\.)[\x20\t]*+[\])}>][\x20\t]*+", _I)
# Last labels with which a domain spelled in plain words is believed.
TOP_LEVEL = "|".join(
    (
        "com net org edu gov mil int info biz name pro aero coop museum jobs mobi tel travel asia cat post arpa app dev page cloud online site website tech "
        "store shop blog email xyz club agency company digital solutions services systems software design media news network studio academy center community "
        "consulting foundation group health law live ltd llc gmbh world space berlin wien london nyc paris example test ac ad ae af ag ai al am ao aq ar as at "
        "au aw ax az ba bb bd be bf bg bh bi bj bm bn bo br bs bt bv bw by bz ca cc cd cf cg ch ci ck cl cm cn co cr cu cv cw cx cy cz de dj dk dm do dz ec ee "
        "eg er es et eu fi fj fk fm fo fr ga gb gd ge gf gg gh gi gl gm gn gp gq gr gs gt gu gw gy hk hm hn hr ht hu id ie il im in io iq ir is it je jm jo jp "
        "ke kg kh ki km kn kp kr kw ky kz la lb lc li lk lr ls lt lu lv ly ma mc md me mg mh mk ml mm mn mo mp mq mr ms mt mu mv mw mx my mz na nc ne nf ng ni "
        "nl no np nr nu nz om pa pe pf pg ph pk pl pm pn pr ps pt pw py qa re ro rs ru rw sa sb sc sd se sg sh si sj sk sl sm sn so sr ss st su sv sx sy sz tc "
        "td tf tg th tj tk tl tm tn to tr tt tv tw tz ua ug uk us uy uz va vc ve vg vi vn vu wf ws ye yt za zm zw"
    ).split()
)
# Last labels that are also words; a determiner as the whole domain before one is prose ("look at the dot is").
_PROSE = r"(?!(?:the|an?|this|that|each|every|any|another|its?|his|her|their|our|your|my|one|which)[\x20\t]+(?:dot|punkt|point|punto)[\x20\t]+(?:am|as|be|by|do|et|is|la|live|me|my|name|no|online|post|so|to|center|space|group|news)(?![A-Za-z0-9-]))"
_DOT = r"[\x20\t]+(?:dot|punkt|point|punto)[\x20\t]+"
_WORDS = re.compile(rf"(?<=[A-Za-z0-9])([\x20\t]+at[\x20\t]+)({_PROSE}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}(?:{TOP_LEVEL}))(?![A-Za-z0-9-]|{_DOT})", _I)
_AFTER_SIGN = re.compile(rf"(?<=[A-Za-z0-9])(@)([A-Za-z0-9-]+(?:(?:{_DOT}|\.)[A-Za-z0-9-]+)*?{_DOT}(?:{TOP_LEVEL}))(?![A-Za-z0-9-]|{_DOT})", _I)
_JOINED = re.compile(rf"(?<=[A-Za-z0-9])([_-]at[_-])([A-Za-z0-9]+(?:[_-]dot[_-][A-Za-z0-9]+)*?[_-]dot[_-](?:{TOP_LEVEL}))(?![A-Za-z0-9])", _I)
# A spelled sign before a domain as it is written counts only after words that announce an address.
_ANNOUNCED = re.compile(
    r"\b(?:e-?mail|mail|contact|write[\x20\t]+to|reach)(?:[\x20\t]+(?:me|us|him|her|them))?(?:[\x20\t]+(?:at|to|is))?(?:[\x20\t]*:)?[\x20\t]+(?!(?:me|us|him|her|them|it|you|is|at|to)[\x20\t])"
    rf"[A-Za-z0-9._%+-]*[A-Za-z0-9]([\x20\t]+at[\x20\t]+)((?:[A-Za-z0-9-]+\.)+(?:{TOP_LEVEL}))(?![A-Za-z0-9-]|\.[A-Za-z0-9])",
    _I,
)
_ANNOUNCE_HINTS = ("mail", "contact", "write", "reach")
_SEPARATOR = re.compile(rf"{_DOT}|[_-]dot[_-]", _I)
_NUMBER_DOT = re.compile(r"(?<=[0-9])[\x20\t]+(?:dot|punkt|point|punto)[\x20\t]+(?=[0-9])", _I)
_NUMBER_WORD = "zero|oh|one|two|three|four|five|six|seven|eight|nine"
_SPELLED = re.compile(rf"\b(?:(?:{_NUMBER_WORD}|[0-9]+)[\x20\t,-]+(?:(?:dot|point)[\x20\t]+)?){{2,}}(?:{_NUMBER_WORD}|[0-9]+)\b", _I)
_SPELLED_HINT = re.compile(rf"\b(?:{_NUMBER_WORD})[\x20\t,-]+(?:{_NUMBER_WORD}|[0-9]|dot|point)", _I)
_PLUS = re.compile(r"\bplus[\x20\t]+(?=[0-9])", _I)
_PIECE = re.compile(rf"{_NUMBER_WORD}|dot|point|[0-9]+|[\x20\t,-]+", _I)
_SPACED_SIGN = re.compile(r"(?<=[A-Za-z0-9])[\x20\t]+([@])[\x20\t]+(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[\x20\t]+(@)(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])(@)[\x20\t]+(?=[A-Za-z0-9])")
_DOT_HINTS = ("dot", "punkt", "point", "punto", " @", "@ ", "\t@", "@\t", "[@", "(@", "{@", "<@", "[at", "(at", "{at", "<at", "[ at", "( at", "{ at", "< at", "[.", "(.", "{.", "<.")


class Mapped:
    """A rewritten text and, per character, the source span it stands for."""

    def __init__(self, text: str):
        self.text, self.start, self.end = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, pieces: list[tuple[int, int, str]]) -> bool:
        """Replace each (start, end, by); pieces are in order and apart.  Every new character stands for the whole piece."""
        if not pieces:
            return False
        text, start, end, at = [], [], [], 0
        for s, e, by in pieces:
            text += (self.text[at:s], by)
            start += self.start[at:s] + [self.start[s]] * len(by)
            end += self.end[at:s] + [self.end[e - 1]] * len(by)
            at = e
        text.append(self.text[at:])
        self.text, self.start, self.end = "".join(text), start + self.start[at:], end + self.end[at:]
        return True

    def source(self, s: int, e: int) -> tuple[int, int]:
        return self.start[s], self.end[e - 1]


def _plain(c: str) -> str:
    if c in INVISIBLE:
        return ""
    digit = unicodedata.decimal(c, None)
    if digit is not None:
        return str(digit)
    folded = HOMOGLYPHS.get(c) or unicodedata.normalize("NFKC", c)
    return folded if folded.isascii() and len(folded) == 1 else c


def _spelled(m: re.Match) -> str:
    """Digits of a run of spelled or written digits; separators between two pieces go if either is spelled."""
    pieces = _PIECE.findall(m[0])
    out = ""
    for i, p in enumerate(pieces):
        if p.lower() in DIGITS:
            out += DIGITS[p.lower()]
        elif p.lower() in ("dot", "point"):
            out += "."
        elif p[0].isdigit() or not any(x.lower() in DIGITS or x.isalpha() for x in (pieces[i - 1], pieces[i + 1])):
            out += p
    return out


def _signs(m: re.Match) -> list[tuple[int, int, str]]:
    """The pieces of a domain spelled in words: the sign before it and its separators."""
    return [(m.start(1), m.end(1), "@"), *((x.start(), x.end(), ".") for x in _SEPARATOR.finditer(m.string, m.start(2), m.end(2)))]


def deobfuscate(text: str) -> Mapped | None:
    """The deobfuscated form; None where nothing is disguised."""
    exotic = None if text.isascii() else _EXOTIC.search(text)
    m, changed = Mapped(text) if exotic else None, False
    if exotic:
        changed |= m.rewrite([(x.start(), x.end(), p) for x in _EXOTIC.finditer(text) if (p := _plain(x[0])) != x[0]])
    lower = (m.text if m else text).lower()
    spelled = any(w in lower for w in DIGITS) and _SPELLED_HINT.search(m.text if m else text)
    dots = any(h in lower for h in _DOT_HINTS)
    announced = any(h in lower for h in _ANNOUNCE_HINTS) and _ANNOUNCED.search(m.text if m else text)
    if not (changed or spelled or dots or announced):
        return None
    m = m or Mapped(text)
    if spelled:
        changed |= m.rewrite([(x.start(), x.end(), _spelled(x)) for x in _SPELLED.finditer(m.text) if any(c.isalpha() for c in x[0])])
        changed |= m.rewrite([(x.start(), x.end(), "+") for x in _PLUS.finditer(m.text)])
    if dots:
        changed |= m.rewrite([(x.start(), x.end(), ".") for x in _NUMBER_DOT.finditer(m.text)])
        for rule, by in ((_BRACKET_AT, "@"), (_BRACKET_DOT, "."), (_SPACED_SIGN, "@")):
            changed |= m.rewrite([(x.start(), x.end(), by) for x in rule.finditer(m.text)])
        for rule in (_WORDS, _AFTER_SIGN, _JOINED):
            changed |= m.rewrite([piece for x in rule.finditer(m.text) for piece in _signs(x)])
    if announced:
        changed |= m.rewrite([(x.start(1), x.end(1), "@") for x in _ANNOUNCED.finditer(m.text)])
    return m if changed else None


def spans_of(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, by kind as listed, then start."""
    base = find(text)
    m = deobfuscate(text)
    if m is None:
        return base, base
    more = set()
    for k, s, e in find(m.text):
        s, e = m.source(s, e)
        if not any(k == b[0] and b[1] <= s and e <= b[2] for b in base):
            more.add((k, s, e))
    return base, sorted({*base, *more})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


DIGEST = ", ".join([*(f"n_{k} long" for k in KINDS), "base_sha256 string", "spans string"])


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, hashes, spans = [[] for _ in KINDS], [], []
            for t in b.column("text"):
                base, every = spans_of(t.as_py() or "")
                for k, c in enumerate(counts):
                    c.append(sum(x[0] == k for x in base))
                hashes.append(hashlib.sha256(joined(base).encode()).hexdigest())
                spans.append(joined(every))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(hashes, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    picked = docs.select("doc_id", "text")
    kind = picked.schema["doc_id"].dataType.simpleString()
    return picked.mapInArrow(run, f"doc_id {kind}, {DIGEST}")


def redact(text: str) -> str:
    """Every found span replaced by its kind in brackets; of overlapping spans the first, then longest, names the kind."""
    spans = sorted(((s, -e, k) for k, s, e in spans_of(text)[1]))
    out, at = [], 0
    for s, e, k in spans:
        e = -e
        if s < at:
            if e > at:  # the rest of an overlapping span goes too
                at = e
            continue
        out += (text[at:s], f"[{KINDS[k].upper()}]")
        at = e
    out.append(text[at:])
    return "".join(out)


def redacted(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """``docs`` with its columns, personal data in ``text`` replaced and ``n_chars`` counted anew; null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            clean = [None if t is None else redact(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(clean, pa.string())], ["doc", "text"])

    picked = docs.select(F.struct(*[F.col(c) for c in docs.columns if c != text]).alias("doc"), F.col(text).alias("text"))
    done = picked.mapInArrow(run, picked.schema)
    count = docs.schema[n_chars].dataType if n_chars in docs.columns else None
    value = {text: F.col("text"), n_chars: F.coalesce(F.length("text").cast(count), F.col(f"doc.{n_chars}")) if count else None}
    return done.select(*[(value[c] if c in value else F.col(f"doc.{c}")).alias(c) for c in docs.columns])
