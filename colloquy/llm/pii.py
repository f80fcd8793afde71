"""Personal data by anchor expansion.

Method: one Aho-Corasick automaton finds anchors (at-signs, URL schemes, plus
signs, digits, and cues of secrets and accounts); a small parser for each kind
then expands an anchor to its boundaries and validates what it has found. All
parsers are deterministic, move forward only and look at the text around their
anchor alone.

Kinds of the base: email, ip, card, phone. Kinds that cues add: url, secret
(key=value credentials), key (access key ids) and account (IBANs that pass the
mod-97 test). Spans of different kinds may overlap.

Defined results: a null text counts as empty and has no spans. Offsets are code points,
end exclusive. Every row gives one row. An empty table gives an empty result. Texts of
any length are searched whole. Only the id and the text are read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Order of kinds at equal starts.
KINDS = ("email", "ip", "card", "phone", "url", "secret", "key", "account")
BASE = KINDS[:4]

#: Fixed cues, as written in lower or upper case.
SCHEMES = ("http://", "https://", "ftp://", "www.")
SECRET_CUES = ("password", "passwd", "token", "secret", "api_key", "apikey")
KEY_CUES = ("AKIA", "ASIA")
ACCOUNT_CUES = ("iban", "account")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGITS = frozenset("0123456789")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
NUMBER = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
DIALLED = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
ADDRESS = re.compile(r"[^\x20\x09-\x0D<>\"']+")
ASSIGNED = re.compile(r"[\x20\"']{0,3}[=:][\x20]?[\"']?([A-Za-z0-9+/_.~-]{8,})")
KEY_ID = re.compile(r"[A-Z0-9]{16}(?![A-Za-z0-9])")
IBAN = re.compile(r"[^A-Za-z0-9]{1,12}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")


@functools.cache
def automaton() -> ahocorasick.Automaton:
    """Cue -> (kind of parser, length of the cue)."""
    found = ahocorasick.Automaton()
    cues = {"@": "email", "+": "phone"} | {d: "digit" for d in "0123456789"}
    for kind, words in (("url", SCHEMES), ("secret", SECRET_CUES), ("key", KEY_CUES), ("account", ACCOUNT_CUES)):
        cues |= {v: kind for w in words for v in ((w,) if kind == "key" else (w, w.upper(), w.capitalize()))}
    for cue, kind in cues.items():
        found.add_word(cue, (kind, len(cue)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def is_byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    significant = digits.lstrip("0")
    return len(significant) <= 3 and int(significant or "0") <= 255


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class Parsers:
    """Expands the anchors of one text from left to right; ``done`` is where each kind's last match ended."""

    def __init__(self, text: str) -> None:
        self.text, self.spans, self.done = text, [], dict.fromkeys((*KINDS, "run"), 0)

    def take(self, kind: str, start: int, end: int, valid: bool = True) -> None:
        self.done[kind] = end
        if valid:
            self.spans.append((start, KINDS.index(kind), end))

    def email(self, at: int, _: int) -> None:
        start, least = at, self.done["email"]
        while start > least and self.text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(self.text, at + 1)):
            self.take("email", start, m.end())

    def phone(self, at: int, _: int) -> None:
        if at >= self.done["phone"] and (m := DIALLED.match(self.text, at)):
            self.take("phone", at, m.end(), 10 <= sum(c in DIGITS for c in m[0]) <= 15)

    def digit(self, at: int, _: int) -> None:
        """A digit is tried once for each kind, where a run of digits begins or the last match ended."""
        first = at == 0 or self.text[at - 1] not in DIGITS
        if at >= self.done["ip"] and (first or at == self.done["ip"]) and (m := QUAD.match(self.text, at)):
            self.take("ip", at, m.end(), all(map(is_byte, m[0].split("."))))
        if at >= self.done["card"] and (m := NUMBER.match(self.text, at)):
            digits = re.sub(r"[\x20-]", "", m[0])
            self.take("card", at, m.end(), 14 <= len(digits) <= 19 and luhn(digits))

    def url(self, at: int, size: int) -> None:
        if at >= self.done["url"] and (m := ADDRESS.match(self.text, at + size)):
            end = at + size + len(m[0].rstrip(".,;:!?)]}"))
            if end > at + size:
                self.take("url", at, end)

    def secret(self, at: int, size: int) -> None:
        if at >= self.done["secret"] and (m := ASSIGNED.match(self.text, at + size)):
            self.take("secret", at, m.end(1))

    def key(self, at: int, size: int) -> None:
        alone = at == 0 or not self.text[at - 1].isalnum()
        if alone and at >= self.done["key"] and (m := KEY_ID.match(self.text, at + size)):
            self.take("key", at, m.end())

    def account(self, at: int, size: int) -> None:
        if at >= self.done["account"] and (m := IBAN.match(self.text, at + size)) and mod97(m[1].replace(" ", "")):
            self.take("account", m.start(1), m.end(1))


def spans_of(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) by start, then kind."""
    parsers = Parsers(text)
    for end, (kind, size) in automaton().iter(text):
        getattr(parsers, kind)(end - size + 1, size)
    return [(start, KINDS[k], end) for start, k, end in sorted(parsers.spans)]


def finder(kind: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e} for s, k, e in spans_of(t or "")] for t in b["_text"]]
            yield pd.DataFrame({"_id": b["_id"], "spans": found})

    return run


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id and spans, an array of (kind, start, end)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInPandas(finder(kind), f"_id {kind}, spans array<struct<kind:string,start:int,end:int>>").withColumnRenamed("_id", id_col)
