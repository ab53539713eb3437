"""Personal data: patterns propose, checksums confirm, context adjusts (operator 8).

E-mail addresses, IP addresses, card numbers and phone numbers are found by
pattern and their own tests. Two further kinds need more than a pattern: an
IBAN must pass mod 97, and a bare identity number is only reported when words
near it say what it is. Every span has a score: what its pattern and checksum
are worth, raised or lowered by the words just before and after it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import fields

# The patterns of the base kinds. Digits that stand before a number's first digit would have
# begun the match, so the look-behinds change no match; possessive repeats only keep long runs linear.
EMAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HEAD = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The added kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
# Characters of an IBAN by country. In other countries each end before a space is tried.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22,
    "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22,
    "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30,
    "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31,
    "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
IDENTITY = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")

BASE = ["email", "ip", "card", "phone"]
KINDS = [*BASE, "iban", "identity"]
#: What a pattern with its own checks is worth, and what a kind must reach to be reported.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "identity": 0.3}
REPORTED_FROM = {"iban": 0.5, "identity": 0.5}
CONTEXT = {
    "email": {"email", "e-mail", "mail", "contact", "write"},
    "ip": {"ip", "address", "server", "host", "client"},
    "card": {"card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta", "transfer"},
    "identity": {"ssn", "social", "security", "identity", "insurance"},
}
AGAINST = {"example", "sample", "version", "test", "isbn", "order", "serial"}
CONTEXT_CHARS, RAISE, LOWER = 60, 0.25, 0.2
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
COUNTS = [f"n_{k}" for k in BASE]


def luhn(digits: str) -> bool:
    """Whether the digit sum with every second digit from the right doubled is a multiple of ten."""
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def mod97(iban: str) -> bool:
    """The ISO 13616 check: four leading characters moved to the end, letters as 10 to 35."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of head and tail, found from the ``@`` outward."""
    free, at = 0, text.find("@")
    while at >= 0:
        following = at + 1
        # the head is the whole run of head characters before the @, as far back as the last match
        if (tail := EMAIL_TAIL.match(text, at)) and at > free:
            start = at
            while start > free:
                step = max(free, start - 64)
                head = EMAIL_HEAD.search(text[step:start])
                start = step + head.start() if head else start
                if not head or head.start():
                    break
            if start < at:
                yield start, tail.end()
                free = following = tail.end()
        at = text.find("@", following)


def only_digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of the base kinds."""
    found = [(start, 0, end) for start, end in emails(text)]
    if not re.search("[0-9]", text):
        return found
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text)
              if all(len(part) <= 3 and int(part or "0") <= 255 for part in (x.lstrip("0") for x in m[0].split(".")))]
    for m in CARD.finditer(text):
        if len(m[0]) <= 37 and 12 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return found


def iban_end(text: str, start: int, longest: int) -> int | None:
    """Where the IBAN from ``start`` on ends, ``longest`` at most; None if its check fails."""
    places = [k for k in range(start, longest) if text[k] != " "]
    wanted = IBAN_LENGTHS.get(text[start:start + 2])
    for n in [wanted] if wanted else range(min(len(places), 34), 14, -1):
        if n <= len(places) and not text[places[n - 1] + 1:places[n - 1] + 2].isalnum() and mod97("".join(text[k] for k in places[:n])):
            return places[n - 1] + 1
    return None


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Proposals of the added kinds whose checksums hold."""
    if not re.search("[0-9]", text):
        return []
    found = [(m.start(), 5, m.end()) for m in IDENTITY.finditer(text)]
    found += [(m.start(), 4, end) for m in IBAN.finditer(text) if (end := iban_end(text, m.start(), m.end()))]
    return found


def score(text: str, start: int, kind: int, end: int) -> float:
    """Between 0 and 1: the kind's own score, adjusted by words near the span."""
    name = KINDS[kind]
    near = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
    words = {w.lower() for w in WORD.findall(near)}
    value = SCORE[name] + RAISE * bool(words & CONTEXT[name]) - LOWER * bool(words & AGAINST)
    return min(1.0, max(0.0, round(value, 2)))


def findings(text: str) -> list[tuple[int, int, int, float]]:
    """(start, index of the kind, end, score) of all reported spans, in order."""
    spans = [(*s, score(text, *s)) for s in base_spans(text)]
    spans += [s for s in ((*s, score(text, *s)) for s in added_spans(text)) if s[3] >= REPORTED_FROM[KINDS[s[1]]]]
    return sorted(spans)


def find_pii(docs: DataFrame) -> DataFrame:
    """The findings of each row of ``docs`` (doc_id, text): one row for each row.

    Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256 (of the base
    spans), spans (all as kind:start:end in code points, end exclusive, by start
    and then kind, comma-joined) and scores (in the same order).

    A null text counts as empty; a null doc_id is kept; repeated rows each give
    their row; an empty table gives none; other columns are ignored. Spans of
    different kinds may overlap. Texts of any length are searched whole, numbers
    of any length are judged by their digits.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                found = findings(text.as_py() or "")
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b, _ in found]
                base = ",".join(s for s, f in zip(said, found, strict=True) if f[1] < len(BASE))
                rows.append((*(sum(f[1] == k for f in found) for k in range(len(BASE))),
                             hashlib.sha256(base.encode()).hexdigest(), ",".join(said), [f[3] for f in found]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()),
                 pa.array(columns[5], pa.string()), pa.array(columns[6], pa.list_(pa.float64()))],
                ["doc_id", *COUNTS, "base_sha256", "spans", "scores"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(find, fields(
        doc_id=kind, **dict.fromkeys(COUNTS, "long"), base_sha256="string", spans="string", scores="array<double>"))
