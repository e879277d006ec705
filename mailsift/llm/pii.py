"""Personal data: regular expressions propose, checksums confirm, context words weigh.

Candidates of five kinds (e-mail address, IPv4 address, payment card, phone number, IBAN) come
from one left-to-right scan per kind. A kind's validator decides whether a candidate stays:
every address part at most 255, the Luhn sum for 13 to 19 card digits, 9 to 15 phone digits,
mod 97 for an IBAN. A candidate that fails is dropped and the scan goes on behind it. The score
starts from the kind's own weight and is raised by words near the span that name the kind.

The scans are linear in the text: each pattern is anchored at a character that starts it and
cannot restart inside a run it has already read.

Null or empty text: a row without spans. Every input row gives one output row, also with a null
or repeated id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, texts

# The patterns and limits of the base kinds.
EMAIL_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9]+(?:[ -][0-9]+)*")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]

#: Score without context; a word of the kind nearby adds half of what is missing to 1.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.95}
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT_CHARS = 40

#: A context word stands alone: no letter on either side.
_NEARBY = {k: re.compile(rf"(?<![^\W\d_])(?:{'|'.join(words)})(?![^\W\d_])") for k, words in CONTEXT.items()}

SPAN = "struct<kind:string,start:bigint,end:bigint,score:double>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                 ("score", pa.float64())]))
_DIGITS = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        head = text[done:at]
        local = len(head) - len(head.rstrip(EMAIL_LOCAL))
        m = EMAIL_DOMAIN.match(text, at + 1) if local else None
        if m:
            yield at - local, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def _valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in found.split("."))
    digits = "".join(_DIGITS.findall(found))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return mod97(found.replace(" ", ""))


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]).lower()
    prior = PRIOR[kind]
    return round(prior + (1 - prior) / 2, 4) if _NEARBY[kind].search(near) else prior


def spans_of(text: str) -> list[tuple[str, int, int, float]]:
    """All confirmed spans of one text, by kind as listed, then by start (code points)."""
    out = [("email", s, e) for s, e in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        for kind, pattern, needs in (("ip", IP, "."), ("card", CARD, ""), ("phone", PHONE, "+"), ("iban", IBAN, "")):
            if needs in text:
                out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m[0])]
    return [(k, s, e, _score(text, k, s, e)) for k, s, e in out]


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, spans array<struct<kind, start, end, score>>)``, one row per row of ``docs``."""

    def scan(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)]
                     for t in texts(batch, "_text")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(found, _SPAN_TYPE)], ["_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), scan,
                      f"_id {kind}, spans array<{SPAN}>")
    return out.withColumnRenamed("_id", id_col)
