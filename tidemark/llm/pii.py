"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts a score.

Base spans (e-mail, IPv4, card with a Luhn digit, phone) are always reported. The method adds bank
account numbers (mod-97) and national numbers in the form 3-2-4, which are reported when their
score reaches THRESHOLD. A score is the kind's own weight, raised by a word of its context
within NEAR code points and lowered by a word that speaks of something else.

Null and empty texts have no spans. Places are code points, the end excluded. Spans of different
kinds may overlap; repeated rows give repeated results; further columns are ignored.
"""

import re

from pyspark.sql import DataFrame

from tidemark.llm.common import read
from tidemark.llm.spans import Span, joined, map_texts, matches, sha

# Patterns of the base kinds, digit limits, and context words.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A run of digits fails as a whole or not at all, so a match need only be tried at its start.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
GATE = "[0-9@]"
ORDER = {k: i for i, k in enumerate(("email", "ip", "card", "phone", "iban", "national"))}
WEIGHT = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national": 0.4}
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national": ("ssn", "social", "security", "national", "tax"),
}
AGAINST = ("version", "build", "isbn", "order", "serial", "part")
NEAR, RAISE, LOWER, THRESHOLD = 40, 0.3, 0.3, 0.6
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _ip(m: re.Match) -> bool:
    parts = [p.lstrip("0") for p in m[0].split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _card(m: re.Match) -> bool:
    digits = _digits(m[0]) if len(m[0]) <= 40 else ""
    return 12 <= len(digits) <= 19 and luhn(digits)


def _phone(m: re.Match) -> bool:
    return 9 <= len(_digits(m[0])) <= 15


def emails(text: str) -> list[Span]:
    """From each @: the run of local characters before it, then the domain. The run starts after the last match."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            floor = m.end()
        at = text.find("@", max(at + 1, floor))
    return found


def base_spans(text: str) -> list[Span]:
    found = emails(text)
    found += matches(IP, "ip", text, _ip)
    found += matches(CARD, "card", text, _card)
    if "+" in text:
        found += matches(PHONE, "phone", text, _phone)
    return found


def score(text: str, span: Span) -> float:
    kind, start, end = span
    around = text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR]
    words = set(_WORD.findall(around.lower()))
    value = WEIGHT[kind]
    if any(w in words for w in CONTEXT[kind]):
        value += RAISE
    if any(w in words for w in AGAINST):
        value -= LOWER
    return round(min(1.0, max(0.0, value)), 3)


def added_spans(text: str) -> list[Span]:
    found = matches(IBAN, "iban", text, lambda m: mod97(m[0].replace(" ", "")))
    found += matches(NATIONAL, "national", text, lambda m: True)
    return [s for s in found if score(text, s) >= THRESHOLD]


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores string"
)


def _row(doc_id, text: str) -> tuple:
    base = base_spans(text)
    every = sorted(base + added_spans(text), key=lambda x: (x[1], ORDER[x[0]], x[2]))
    counts = [sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")]
    scores = ",".join(f"{score(text, s):g}" for s in every)
    return (doc_id, *counts, sha(joined(base, ORDER)), joined(every, ORDER), scores)


def find(docs: DataFrame) -> DataFrame:
    """A row per document: counts and digest of the base spans, all spans, and their scores."""
    nothing = sha("")
    return map_texts(
        docs, SCHEMA, GATE,
        lambda pairs: [_row(*p) for p in pairs],
        lambda ids: [(i, 0, 0, 0, 0, nothing, "", "") for i in ids],
    )


def query(spark, folder: str) -> DataFrame:
    return find(read(spark, folder, "documents"))
