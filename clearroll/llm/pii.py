"""Personal data in texts: patterns propose, checksums confirm, nearby words adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .spans import SPAN, in_order
from .store import per_text

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "card13", "ssn"]

IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_IBAN_END = re.compile(r"(?<=[A-Z0-9])(?![A-Za-z0-9])")
#: Characters of an account number by country.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 "
    "GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 "
    "MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 "
    "TN24 TR26 UA29 VA22 VG24 XK20"
).split()}
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
DIGIT = re.compile(r"[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Words that make a kind likelier, and words that speak against any.
CONTEXT = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "address", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "cvv", "expires"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "contact"),
    "iban": ("iban", "bank", "account", "transfer", "bic", "swift"),
    "card13": ("card", "visa", "credit", "payment", "cvv", "expires"),
    "ssn": ("ssn", "social", "security", "taxpayer", "tax"),
}
AGAINST = ("example", "sample", "version", "isbn", "order", "invoice", "serial")
#: Score of a confirmed proposal before its context; spans beyond the base ones need ``THRESHOLD``.
START = {"email": 0.8, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "card13": 0.4, "ssn": 0.4}
THRESHOLD, NEAR, STEP = 0.6, 48, 0.25
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def scored(text: str, kind: str, start: int, end: int) -> float:
    """The kind's starting score, moved by the words within ``NEAR`` characters of the span."""
    around = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR])}
    for_it, against = around & set(CONTEXT[kind]), around & set(AGAINST)
    return min(1.0, max(0.0, START[kind] + STEP * bool(for_it) - STEP * bool(against)))


def ibans(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping account numbers that pass mod-97.

    A number may end where a token ends: the end that gives its country's length is tried first, then the longest.
    """
    found, at = [], 0
    while m := IBAN.search(text, at):
        start, at = m.start(), m.start() + 1
        ends = [e.start() for e in _IBAN_END.finditer(text, start, m.end() + 1) if e.start() <= m.end()]
        tried = sorted(((text[start:e].replace(" ", ""), e) for e in ends), key=lambda x: (len(x[0]) == IBAN_LENGTH.get(x[0][:2]), x[1]), reverse=True)
        for plain, end in tried:
            if len(plain) >= 15 and mod97(plain):
                found.append((start, end))
                at = end
                break
    return found


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses: every ``@`` has one possible local part, the run before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return found


def scan(text: str | None) -> list[tuple]:
    """``(kind, start, end, value_start, score)`` of all personal data of a text."""
    if not text:
        return []
    found = [("email", a, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            for m in IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                    found.append(("ip", m.start(), m.end()))
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card" if len(digits) > 13 else "card13", m.start(), m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    found.append(("phone", m.start(), m.end()))
        found += [("iban", a, b) for a, b in ibans(text)]
        found += [("ssn", m.start(), m.end()) for m in SSN.finditer(text)]
    out = [(k, a, b, a, scored(text, k, a, b)) for k, a, b in found]
    return [s for s in out if s[0] in BASE or s[4] >= THRESHOLD]


def find_personal_data(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and ``personal``, the spans of every row (empty for null or clean texts).

    Base kinds (email, ip, card, phone) stay whatever their score; iban (mod-97), 13-digit
    cards (Luhn) and ssn need ``THRESHOLD`` after their context.  Offsets are code points,
    ends exclusive.  Repeated rows and empty tables pass through.
    """
    return per_text(docs, text, [("personal", SPAN)], lambda: lambda texts: [[in_order(scan(t), KINDS) for t in texts]], keep, encode=False)
