"""Personal data in texts: patterns propose spans, checksums confirm them, nearby words adjust a score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import shipped, texts


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if k % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def mod97(code: str) -> bool:
    """The check of international bank account numbers: letters as 10 to 35, first four characters last."""
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def digits_of(match: str) -> str:
    return "".join(c for c in match if "0" <= c <= "9")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: re.Pattern
    holds: Callable[[str], bool]
    base: float  # score without context
    context: re.Pattern  # words that raise it


# Possessive quantifiers and look-behinds keep each search linear: a run of characters that fails once
# fails from each of its places, so only its first place is tried. The matches are those of the plain patterns.
IP = Kind("ip", re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"), lambda m: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.split(".")), 0.5, re.compile(r"(?i)\b(ip|host|server|address|from|login)\b"))
CARD = Kind("card", re.compile(r"[0-9](?:[ -]?[0-9])++"), lambda m: 13 <= len(d := digits_of(m)) <= 19 and luhn(d), 0.6, re.compile(r"(?i)\b(card|visa|credit|debit|payment|master ?card|cvv)\b"))
PHONE = Kind("phone", re.compile(r"\+[0-9][ ().0-9-]+[0-9]"), lambda m: 9 <= len(digits_of(m)) <= 15, 0.5, re.compile(r"(?i)\b(phone|tel|telephone|call|mobile|fax|whatsapp)\b"))
EMAIL_CONTEXT = re.compile(r"(?i)\b(e-?mail|mail|contact|write|reply)\b")
IBAN = Kind("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), lambda m: 15 <= len(c := m.replace(" ", "")) <= 34 and mod97(c), 0.5, re.compile(r"(?i)\b(iban|bank|account|konto|bic|swift)\b"))
# Lengths of account numbers by country, for some large ones; such a length raises a number's score by LENGTH_FITS.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
LENGTH_FITS = 0.25
#: What a context word near a span adds, and what a word of another use takes off.
RAISED, LOWERED = 0.35, 0.3
OTHER_USE = re.compile(r"(?i)\b(version|release|invoice|order|isbn|serial|ticket|build)\b")
#: Least score of the kinds that the method adds to the base ones.
LEAST_SCORE = 0.6

KINDS = ("email", "ip", "card", "phone", "iban")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ outwards, which visits each character at most twice."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            done = domain.end()
        else:
            done = max(done, at + 1)  # no later match holds this @
        at = text.find("@", max(done, at + 1))


def find_spans(text: str, window: int = 40, least: float = LEAST_SCORE) -> Iterator[tuple[str, int, int, float]]:
    """(kind, start, end, score) by kind, then start; code points, end exclusive.

    Words within ``window`` characters adjust the score, between 0 and 1: those of the kind's context raise it, those of another use lower
    it. The base kinds are all kept whatever the score; an added kind is kept from ``least`` on.
    """
    def score(base: float, context: re.Pattern, start: int, end: int) -> float:
        before, after = (max(0, start - window), start), (end, min(len(text), end + window))
        near = lambda words: words.search(text, *before) or words.search(text, *after)
        return min(1.0, max(0.0, base + (RAISED if near(context) else 0.0) - (LOWERED if near(OTHER_USE) else 0.0)))

    if "@" in text:
        for start, end in emails(text):
            yield "email", start, end, score(0.9, EMAIL_CONTEXT, start, end)
    for kind in (IP, CARD, PHONE, IBAN):
        for m in kind.pattern.finditer(text):
            if kind.holds(m[0]):
                fits = kind is IBAN and IBAN_LENGTHS.get(m[0][:2]) == len(m[0].replace(" ", ""))
                found = score(kind.base + LENGTH_FITS * fits, kind.context, m.start(), m.end())
                if kind is not IBAN or found >= least:
                    yield kind.name, m.start(), m.end(), found


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def find_pii(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, text, ...) -> (doc_id, spans: array of (kind, start, end, score)), one row per input row.

    Base kinds: email, ip, card (Luhn) and phone; the method adds iban (mod 97) from a score of ``least`` on. Null and empty texts
    have no span. Repeated rows and rows without doc_id are judged one by one; further columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), x)) for x in find_spans(text, least=least)] for text in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, SPANS)], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return shipped(docs).select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, spans array<struct<kind string, start bigint, end bigint, score double>>")


def op2(docs: DataFrame, likely: float = 0.7) -> DataFrame:
    """The contract's columns, ``n_iban``, ``scores`` (of all spans, in their order) and ``n_likely``, the spans whose score is at least ``likely``."""
    spans = find_pii(docs)
    listed = lambda column: F.array_join(F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS[:4]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    sure = F.size(F.filter("spans", lambda s: s["score"] >= likely)).cast("long")
    return spans.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("iban"), scores.alias("scores"), sure.alias("n_likely"))
