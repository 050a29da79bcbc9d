"""Personal data: patterns propose spans, checksums confirm them, context words adjust scores.

Base kinds (email, ip, card, phone) are found wherever their pattern and check hold. The method
adds kinds whose pattern alone would be too weak: a proposal starts with a score of its
pattern, a passed checksum raises it, nearby context words raise it or lower it, and it is
reported from ``THRESHOLD`` up.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import spans
from .spans import Span

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "card_short", "national_id", "phone_local")
#: Characters on either side in which context words count.
CONTEXT = 48
THRESHOLD = 0.6

# Each pattern is linear: no start inside a run can match where the run's own start did not.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
#: Context words by kind, in the four languages of the corpus: those that raise a score, and those that lower any.
RAISE = {
    "iban": re.compile(r"(?i)\b(iban|account|bank|konto|compte|cuenta|transfer)"),
    "card_short": re.compile(r"(?i)\b(card|visa|amex|mastercard|karte|carte|tarjeta|credit|payment)"),
    "national_id": re.compile(r"(?i)\b(ssn|social security|national id|ausweis|dni)"),
    "phone_local": re.compile(r"(?i)\b(phone|tel|call|fax|mobile|cell|telefon|anruf|appel|llam)"),
}
LOWER = re.compile(r"(?i)\b(order|invoice|isbn|serial|version|tracking|part no|sku|example)")
#: Score of a pattern by itself, and what a passed checksum adds.
PRIOR = {"iban": 0.2, "card_short": 0.1, "national_id": 0.35, "phone_local": 0.35}
CONFIRMED = {"iban": 0.5, "card_short": 0.3, "national_id": 0.0, "phone_local": 0.0}


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """Whether an account number passes the ISO 13616 check (remainder 1 modulo 97)."""
    rest = 0
    for c in code[4:] + code[:4]:
        n = ord(c) - 48 if c <= "9" else ord(c) - 55
        rest = (rest * (100 if n > 9 else 10) + n) % 97
    return rest == 1


def emails(text: str) -> list[Span]:
    """Leftmost non-overlapping addresses, found from the at signs outward."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > end and text[a - 1] in LOCAL_CHARS:
            a -= 1
        if a < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", a, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def _octets(ip: str) -> bool:
    return all(len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255 for part in ip.split("."))


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by kind as listed, then by start."""
    found = emails(text)
    found += [("ip", *m.span()) for m in IP.finditer(text) if _octets(m.group())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m.group()) <= 15]
    return found


def score(kind: str, text: str, a: int, b: int, confirmed: bool) -> float:
    """Score of a proposal: its pattern's, the checksum's, 0.4 for a word that raises it nearby and -0.3 for one that lowers it."""
    near = text[max(0, a - CONTEXT) : a] + "\n" + text[b : b + CONTEXT]
    s = PRIOR[kind] + CONFIRMED[kind] * confirmed
    s += 0.4 * bool(RAISE[kind].search(near))
    return s - 0.3 * bool(LOWER.search(near))


def _proposals(text: str):
    """(kind, start, end, checksum passed) of the added kinds."""
    for m in IBAN.finditer(text):
        code, end = m.group(), m.end()
        while True:  # a following word may have been taken in: give back whole groups
            plain = code.replace(" ", "")
            if 15 <= len(plain) <= 34 and mod97(plain):
                yield "iban", m.start(), end, True
                break
            cut = code.rfind(" ")
            if cut < 0:
                break
            end, code = m.start() + cut, code[:cut]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 15 and luhn(digits):
                yield "card_short", *m.span(), True
    for m in NATIONAL.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield "national_id", *m.span(), False
    for m in LOCAL_PHONE.finditer(text):
        yield "phone_local", *m.span(), False


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans (by kind as listed, then start) of a text.

    An added span that overlaps a base span or an earlier added one is left out.
    """
    base = base_spans(text)
    if not re.search(r"[0-9]{2}", text):
        return base, base
    likely = [(k, a, b) for k, a, b, ok in _proposals(text) if score(k, text, a, b, ok) >= THRESHOLD]
    return base, base + spans.apart(likely, base)


def _finder() -> Callable[[str], tuple[list[Span], list[Span]]]:
    return find


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every row.

    A null or empty text has no spans; repeated rows are reported alike; an empty table
    gives no rows; other columns are ignored.
    """
    return spans.report(docs, BASE_KINDS, _finder)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of personal data replaced by its kind, as in ``<email>``."""
    return spans.rewritten(docs, _finder)
