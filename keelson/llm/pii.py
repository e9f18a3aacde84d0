"""Personal data by anchor expansion: an Aho-Corasick automaton finds anchors, local parsers expand and validate them.

One pass of the automaton over a text finds at-signs, ``://``, plus signs before digits, digit pairs and cue words of accounts.  What stands
around an anchor is read by the parser of its kind: to the left as far as the characters of the kind go (never into the last match of that kind), to the
right by one anchored pattern.  Then the boundaries are validated: numbers of an address, digit counts, check digits.  Text without anchors is
never looked at by Python, and every parser moves past what it has read, so that work is linear in the text.

Kinds, in the order of their ranks: ``email``, ``ip``, ``card`` and ``phone`` are the leftmost non-overlapping matches of their patterns that pass
their test; the method adds ``login`` (an address with a scheme and a user), ``account`` (an identifier of 6 to 20 digits behind a cue word) and ``iban`` (behind its cue,
checked modulo 97).  Spans of different kinds may overlap.

Defined results for odd input: a null or empty text has no spans; repeated rows each get theirs; a text of any length is read whole; an empty
table gives an empty table; further columns stay, whatever their names and types; if ``spans`` is taken, the new column is ``spans_2`` and so on.
"""

from __future__ import annotations

import re
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_extend, fresh_name

KINDS = ("email", "ip", "card", "phone", "login", "account", "iban")
BASE_KINDS = KINDS[:4]
EMAIL, IP, CARD, PHONE, LOGIN, ACCOUNT, IBAN = range(len(KINDS))

#: Words before an account's number, and before an international one.
ACCOUNT_CUES = ("account", "Account", "ACCOUNT", "acct", "Acct", "ACCT", "passport", "Passport", "PASSPORT")
IBAN_CUES = ("iban", "Iban", "IBAN")
#: What may follow a cue and what counts as identifier (group 1); fixed values.
ACCOUNT_TAIL = r"(?:\x20(?:no|No|NO|number|Number)\.?)?\x20?[:=#]?\x20?([A-Z]{0,4}[0-9](?:[\x20-]?[0-9])+)"
IBAN_TAIL = r"\x20?[:=#]?\x20?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?)"
#: Characters of a scheme and of what stands between it and the at-sign.
SCHEME, USER = "A-Za-z0-9+.-", "A-Za-z0-9._~%!$&()*+,;=:-"

_DIGITS = "0123456789"
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = _LOCAL - set("_%")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_NUMBER = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_USERINFO = re.compile(rf"[{USER}]+@[A-Za-z0-9.-]+")
_ACCOUNT, _IBAN = re.compile(ACCOUNT_TAIL), re.compile(IBAN_TAIL)


def luhn(digits: str) -> bool:
    """The sum of the digits, every second one from the right doubled (less 9 if above 9), is divisible by 10."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(number: str) -> int:
    """Remainder of an international account number: its first four characters last, letters as 10 to 35."""
    rest = 0
    for c in number[4:] + number[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest


def _only_digits(s: str) -> str:
    return s.replace(" ", "").replace("-", "")


class Scan:
    """Spans (start, rank, end) of one text; ``past`` holds where the last look of each kind ended."""

    def __init__(self, text: str) -> None:
        self.text, self.past, self.found = text, [0] * len(KINDS), []

    def left(self, at: int, chars, floor: int) -> int:
        while at > floor and self.text[at - 1] in chars:
            at -= 1
        return at

    def email(self, first: int, end: int) -> None:
        start = self.left(first, _LOCAL, self.past[EMAIL])
        if start < first and (m := _DOMAIN.match(self.text, end)):
            self.found.append((start, EMAIL, m.end()))
            self.past[EMAIL] = m.end()

    def dotted(self, first: int, end: int) -> None:
        """A chain of numbers and single dots: an address for each four of them."""
        if first < self.past[IP]:
            return
        chain = _CHAIN.match(self.text, self.left(first, _DIGITS, self.past[IP]))
        self.past[IP] = chain.end()
        parts: list[tuple[int, int]] = []
        for m in _NUMBER.finditer(self.text, chain.start(), chain.end()):
            parts.append(m.span())
            if len(parts) == 4:
                small = (self.text[a:b].lstrip("0") if b - a > 3 else self.text[a:b] for a, b in parts)
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in small):
                    self.found.append((parts[0][0], IP, parts[3][1]))
                parts = []

    def digits(self, first: int, end: int) -> None:
        if first < self.past[CARD]:
            return
        m = _CARD.match(self.text, first)
        self.past[CARD] = m.end()
        if m.end() - first >= 14 and 14 <= len(number := _only_digits(m[0])) <= 19 and luhn(number):
            self.found.append((first, CARD, m.end()))

    def plus(self, first: int, end: int) -> None:
        if m := _PHONE.match(self.text, first):
            if 10 <= sum(c in _DIGITS for c in m[0]) <= 15:
                self.found.append((first, PHONE, m.end()))

    def scheme(self, first: int, end: int) -> None:
        start = self.left(first, _SCHEME, self.past[LOGIN])
        while start < first and self.text[start] not in _LETTERS:
            start += 1
        if start < first and (m := _USERINFO.match(self.text, end)):
            self.found.append((start, LOGIN, m.end()))
            self.past[LOGIN] = m.end()

    def account(self, first: int, end: int) -> None:
        if first >= self.past[ACCOUNT] and (m := _ACCOUNT.match(self.text, end)):
            self.past[ACCOUNT] = m.end()
            if 6 <= sum(c in _DIGITS for c in m[1]) <= 20:
                self.found.append((m.start(1), ACCOUNT, m.end()))

    def iban(self, first: int, end: int) -> None:
        if first >= self.past[IBAN] and (m := _IBAN.match(self.text, end)):
            self.past[IBAN] = m.end()
            if mod97(m[1].replace(" ", "")) == 1:
                self.found.append((m.start(1), IBAN, m.end()))


@cache
def anchors() -> ahocorasick.Automaton:
    """Automaton over all anchors; each gives its length and the parsers it calls."""
    called: dict[str, list] = {"@": [Scan.email], "://": [Scan.scheme]}
    for a in _DIGITS:
        called[f"+{a}"] = [Scan.plus]
        for b in _DIGITS:
            called[f"{a}.{b}"] = [Scan.dotted]
            called |= {f"{a}{gap}{b}": [Scan.digits] for gap in ("", " ", "-")}
    called |= {cue: [Scan.account] for cue in ACCOUNT_CUES} | {cue: [Scan.iban] for cue in IBAN_CUES}
    automaton = ahocorasick.Automaton()
    for word, parsers in called.items():
        automaton.add_word(word, (len(word), parsers))
    automaton.make_automaton()
    return automaton


def scan_text(text: str | None) -> list[tuple[int, int, int]]:
    """Spans (start, rank, end; code points) of a text, in order."""
    if not text:
        return []
    scan = Scan(text)
    for last, (width, parsers) in anchors().iter(text):
        for parse in parsers:
            parse(scan, last - width + 1, last + 1)
    return sorted(scan.found)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_SPANS_SQL = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("rank", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("kind", T.StringType())]))


def _spans_of(texts: pa.Array) -> pa.Array:
    return pa.array([[{"start": a, "rank": k, "end": b, "kind": KINDS[k]} for a, k, b in scan_text(t.as_py())] for t in texts], _SPANS)


def find_personal(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with the spans (start, rank, end, kind) of personal data in their texts, and the name of that column."""
    name, where = fresh_name("spans", docs.columns), docs.columns.index(text_col)
    return arrow_extend(docs, lambda b: [_spans_of(b.column(where))], [T.StructField(name, _SPANS_SQL)]), name


def mask_text(text: str | None) -> str | None:
    """``text`` with each run of overlapping or touching spans replaced by the kind of its first one, in brackets."""
    out, at, reach = [], 0, -1
    for start, kind, end in scan_text(text):
        if start > reach:
            out.append(f"{text[at:start]}[{KINDS[kind]}]")
        at = reach = max(reach, end)
    return text if not out else "".join(out) + text[at:]


def mask_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with personal data in their texts masked; a null text stays null."""
    where, taken = docs.columns.index(text_col), docs.columns
    masked = fresh_name("masked", taken)
    out = arrow_extend(docs, lambda b: [pa.array([mask_text(t.as_py()) for t in b.column(where)], pa.string())], [T.StructField(masked, T.StringType())])
    return out.toDF(*(str(i) for i in range(len(taken) + 1))).select(*(f"`{len(taken) if i == where else i}`" for i in range(len(taken)))).toDF(*taken)
