"""Secrets: patterns, and the novelty of candidates to a primed zstandard compressor.

A candidate is a long run of identifier characters. A compressor primed with a dictionary of
common identifiers and with the text around the candidate measures the bytes that the
candidate adds. Words, identifiers, repeats and anything said nearby compress away; a random
key does not. An incompressible candidate in a sensitive context is reported. Where copies of
the candidate itself are nearby, it is measured again without them, also against its shuffled
characters: a random key stays incompressible, so one said twice is reported at both places.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from . import spans
from .spans import Span

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Candidates: runs of so many characters at least, with a digit, and not of digits alone.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}={0,2}")
#: What parts of a candidate lie between, and from how many characters on a part said alone is a copy.
PART, LONG_PART = re.compile(r"[/+_=-]+"), 16
#: Parts of lower-cased text without which neither the assign pattern nor a sensitive context can occur.
ASSIGN_PARTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "private", "credential", "signature", "session", "cookie")
#: Words of a sensitive context, within so many characters before or after.
SENSITIVE = re.compile(r"(?i)(pass|pwd|secret|token|api.?key|auth|bearer|private|credential|access.?key|signature|session|cookie)")
CONTEXT = 64
#: Text around a candidate that primes the compressor.
AROUND = 2048
#: Bytes added per character: 1 for a random string, whose characters stay literals; about half for known words run together.
NOVELTY = 0.7
#: A string said more than once nearby, as identifiers are, must also add so much of what its shuffled characters add: 1 for a random string.
REPEATED = 0.9
#: Common identifiers and code words, fixed values.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret "
    "authorization bearer session cookie signature username user_name hostname localhost http https www com org net "
    "import from return function class const static void string integer boolean true false null None self this "
    "undefined config configuration settings environment development production testing database connection "
    "request response header content type length encoding application json text html utf8 base64 sha256 md5 "
    "index value name key id uuid version timestamp created_at updated_at file path directory src lib bin test "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890 xxxxxxxxxxxxxxxx"
)


def base_spans(text: str) -> list[Span]:
    """Spans of the base kinds, by start, then by kind as listed."""
    found: list[Span] = []
    low = text.lower()
    if any(p in low for p in ASSIGN_PARTS):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(1)) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], BASE_KINDS.index(s[0])))


def _without(text: str, candidate: str) -> str:
    """``text`` without copies of the candidate or of its long parts."""
    for own in (candidate.rstrip("="), *(p for p in PART.split(candidate) if len(p) >= LONG_PART)):
        text = text.replace(own, " ")
    return text


class Novelty:
    """Marginal compressed size of a string after a dictionary of identifiers and its surroundings."""

    def __init__(self, identifiers: str = IDENTIFIERS, level: int = 6) -> None:
        import zstandard

        self._z, self._dictionary, self._level = zstandard, identifiers.encode(), level

    def _size(self, primer: bytes, data: bytes) -> int:
        prime = self._z.ZstdCompressionDict(self._dictionary + b" " + primer, dict_type=self._z.DICT_TYPE_RAWCONTENT)
        params = self._z.ZstdCompressionParameters.from_level(self._level, write_content_size=0, write_checksum=0, write_dict_id=0)
        return len(self._z.ZstdCompressor(dict_data=prime, compression_params=params).compress(data))

    def __call__(self, text: str, a: int, b: int) -> float:
        """Bytes that ``text[a:b]`` adds, per character, given up to AROUND characters on each side."""
        before, after = text[max(0, a - AROUND) : a].encode("utf-8", "replace"), text[b : b + AROUND].encode("utf-8", "replace")
        primer, data = after + b" " + before, text[a:b].encode()
        return (self._size(primer, data) - self._size(primer, b"")) / max(1, b - a)

    def reported(self, text: str, a: int, b: int) -> bool:
        """Whether ``text[a:b]`` is novel, or would be if it were said only here."""
        if self(text, a, b) >= NOVELTY:
            return True
        # longer by the candidate, so that no copy is cut in two before it is left out
        own, reach = text[a:b], AROUND + b - a
        sides = text[max(0, a - reach) : a], text[b : b + reach]
        before, after = (_without(side, own) for side in sides)
        if (before, after) == sides:
            return False
        before, after = before[-AROUND:], after[:AROUND]
        shuffled = "".join(random.Random(0).sample(own, len(own)))  # the same characters, with nothing to repeat
        alone, most = (self(before + s + after, len(before), len(before) + len(own)) for s in (own, shuffled))
        return alone >= NOVELTY and alone >= REPEATED * most


def _mixed(s: str) -> bool:
    """Whether a string mixes letters and digits as keys do: letters, at least two digits, eight different characters."""
    return any(c.isalpha() for c in s) and sum(c.isdigit() for c in s) >= 2 and len(set(s)) >= 8


def finder() -> Callable[[str], tuple[list[Span], list[Span]]]:
    """A function from a text to its base spans and all its spans (by start, then kind)."""
    novelty = Novelty()
    order = {k: i for i, k in enumerate((*BASE_KINDS, "novel"))}

    def find(text: str) -> tuple[list[Span], list[Span]]:
        base = base_spans(text)
        low = text.lower()
        if not any(p in low for p in SENSITIVE_PARTS):
            return base, base
        likely = []
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            near = text[max(0, a - CONTEXT) : a] + "\n" + text[b : b + CONTEXT]
            if _mixed(m.group()) and SENSITIVE.search(near) and spans.apart([("novel", a, b)], base) and novelty.reported(text, a, b):
                likely.append(("novel", a, b))
        return base, sorted(base + likely, key=lambda s: (s[1], order[s[0]]))

    return find


def secrets_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and all spans of every row.

    A null or empty text has no spans; repeated rows are reported alike; an empty table
    gives no rows; other columns are ignored.
    """
    return spans.report(docs, BASE_KINDS, finder)
