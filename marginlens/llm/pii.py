"""Personal data by patterns, checksums and context.

Patterns propose spans, validators confirm them (number ranges, Luhn for cards, mod-97 and the country's length for bank
accounts), and what no checksum can confirm needs a score: it starts at the pattern's own weight, rises with words nearby that
speak of such data and falls with words that speak of examples. The words that a pattern itself demands are no context.
E-mail, address, card and phone spans are the base and stay whatever the score says; the method adds further kinds.
Scanning is linear in the text: no pattern starts again inside a run that it has already failed on.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginlens.llm.common import Batches, batch, map_batches

BASE = ("email", "ip", "card", "phone")
#: The kinds that the method adds, in their order after the base.
ADDED = ("iban", "ssn", "secret")
_ORDER = {kind: at for at, kind in enumerate(BASE + ADDED)}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_])(?:password|passwd|secret|token|api_?key)\x20{0,2}[=:]\x20{0,2}[\"']?([A-Za-z0-9_/+.-]{8,})", re.IGNORECASE)
#: Weight of a pattern that no checksum confirms, what a context word adds or takes, the score needed, and how far context reaches.
WEIGHTS, CONTEXT_WEIGHT, NEEDED, REACH = {"ssn": 0.4, "secret": 0.4}, 0.3, 0.6, 60
_CONTEXT = {
    "ssn": re.compile(r"\b(?:ssn|social|security|insurance|tax|identity|id)\b", re.IGNORECASE),
    "secret": re.compile(r"\b(?:login|log[ -]?in|credentials?|username|user|account|auth|private|key|config)\b", re.IGNORECASE),
}
# words of their own: a host such as example.com is no example
_AGAINST = {
    "ssn": re.compile(r"(?<![\w@.-])(?:example|sample|dummy|fictitious|part|serial|invoice|order|model)(?![.-]?\w)", re.IGNORECASE),
    "secret": re.compile(r"(?<![\w@.-])(?:example|sample|dummy|placeholder|fictitious)(?![.-]?\w)", re.IGNORECASE),
}
# The length of an account number by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VG": 24, "XK": 20,
}
_DOUBLED = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)

_FIELDS = ("kind", "start", "end", "score")
_SPAN = pa.struct(list(zip(_FIELDS, (pa.string(), pa.int32(), pa.int32(), pa.float64()), strict=True)))
_SPANS = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(_SPAN))])


def luhn(digits: str) -> bool:
    values = [ord(d) - 48 for d in reversed(digits)]
    return (sum(values[::2]) + sum(_DOUBLED[v] for v in values[1::2])) % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number with its country and check digits in front leaves 1 after division by 97."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _emails(text: str) -> list[tuple[int, int]]:
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        at = text.find("@", domain.end() if domain else at + 1)
    return found


def _accounts(text: str) -> list[tuple[int, int]]:
    """Account numbers of their country's length that the checksum confirms; words may follow one after a space."""
    found, at = [], 0
    while m := _IBAN.search(text, at):
        at = m.end()
        end, left = m.start(), IBAN_LENGTHS.get(m[0][:2], 0)
        while left and end < m.end():
            left -= text[end] != " "
            end += 1
        whole = end == m.end() or text[end] == " "
        if not left and end > m.start() and whole and mod97(text[m.start() : end].replace(" ", "")):
            found.append((m.start(), end))
            at = end
    return found


def _ssn_in_range(number: str) -> bool:
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _octet(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _score(kind: str, text: str, start: int, end: int) -> float:
    """Between 0 and 1, from the pattern's weight and the words around text[start:end]."""
    around = text[max(0, start - REACH) : start] + " " + text[end : end + REACH]
    turns = len(_CONTEXT[kind].findall(around)) - len(_AGAINST[kind].findall(around))
    return min(1.0, max(0.0, WEIGHTS[kind] + CONTEXT_WEIGHT * turns))


def _secret_score(text: str, m: re.Match) -> float:
    """Of a named value: letters mixed with digits speak for a secret, a plain word against one."""
    value = m[1]
    mixed = any(c.isdigit() for c in value) and any(c.isalpha() for c in value)
    shape = CONTEXT_WEIGHT if mixed else -CONTEXT_WEIGHT if value.isalpha() and (value.islower() or value.istitle()) else 0.0
    return min(1.0, max(0.0, _score("secret", text, *m.span()) + shape))


def scored(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of BASE and ADDED; code points, end exclusive.

    What a pattern or checksum settles has score 1; other spans are given from NEEDED on.
    """
    found = [("email", *s, 1.0) for s in _emails(text)] if "@" in text else []
    found += [("ip", *m.span(), 1.0) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span(), 1.0))
    if "+" in text:
        found += [("phone", *m.span(), 1.0) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    found += [("iban", *s, 1.0) for s in _accounts(text)]
    found += [("ssn", *m.span(), _score("ssn", text, *m.span())) for m in _SSN.finditer(text) if _ssn_in_range(m[0])]
    if "=" in text or ":" in text:
        found += [("secret", *m.span(1), _secret_score(text, m)) for m in _SECRET.finditer(text)]
    return sorted((s for s in found if s[3] >= NEEDED), key=lambda s: (s[1], _ORDER[s[0]]))


def spans(text: str) -> list[tuple[str, int, int]]:
    """``scored`` without the scores."""
    return [s[:3] for s in scored(text)]


def _batches(batches: Batches) -> Batches:
    for rows in batches:
        found = [[dict(zip(_FIELDS, s, strict=True)) for s in scored(t.as_py() or "")] for t in rows.column("text")]
        yield batch(_SPANS, rows.column("doc_id"), found)


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, spans array of (kind, start, end, score)), one row per row of ``docs`` (columns doc_id, text; others are not read).

    A null text counts as empty and has no spans. Spans of different kinds may overlap. Repeated rows come out as often as
    they go in; no rows in, no rows out.
    """
    rows = docs.select(F.col("doc_id").cast("bigint"), "text")
    return map_batches(rows, _batches, "doc_id bigint, spans array<struct<kind string, start int, end int, score double>>")
