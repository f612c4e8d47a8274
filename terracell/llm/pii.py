"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, address schemes and
cues of identifiers. At each anchor a small parser of its kind expands to both sides and validates
what it has found; texts without anchors cost the pass only.

Kinds: email, ip, card (Luhn), phone are the base ones. Added: address (``scheme://`` with user data or
a numeric host), iban (behind the cue, check digits valid), ssn (behind a cue, in its valid ranges).
Spans of one kind don't overlap, kinds may. Offsets count code points, ends are exclusive.

Per row, so a map over Arrow batches without a shuffle; the parsers never look back behind the end
of the span before, which keeps the time linear in the text.

Defined results: a null text counts as empty; an empty text has no spans; repeated rows get equal
spans. Extra columns pass through, a column named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from terracell.llm.common import fresh, replace_columns, whole

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "address", "iban", "ssn")

# fixed values: the forms of the kinds
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[0-9]+")
ADDRESS = re.compile(r"(?:([^\s/@:]+)(?::[^\s/@]*)?@)?([A-Za-z0-9.-]+)(?::[0-9]{1,5})?(?:/[^\s\"'<>]*)?")
IBAN = re.compile(r"[\x20:#.]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")
SSN = re.compile(r"[\x20:#.]{0,4}(?:(?:no|number)[\x20:#.]{1,4})?([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])", re.I)
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
IBAN_CUES = ("IBAN", "iban", "Iban")
SSN_CUES = ("SSN", "ssn", "Social Security", "social security", "SOCIAL SECURITY")

Span = tuple[str, int, int]


@lru_cache(maxsize=1)
def anchors():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in [
        ("@", "at"),
        ("+", "plus"),
        *((d, "digit") for d in "0123456789"),
        *((s, "scheme") for s in SCHEMES),
        *((s, "iban") for s in IBAN_CUES),
        *((s, "ssn") for s in SSN_CUES),
    ]:
        a.add_word(word, kind)
    a.make_automaton()
    return a


def digits_of(s: str) -> list[int]:
    return [int(c) for c in s if "0" <= c <= "9"]


def luhn(digits: list[int]) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def iban_valid(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def byte_parts(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def spans_of(text: str) -> list[Span]:
    """All spans, by kind as in ``KINDS``, then by start."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    past = dict.fromkeys(KINDS, 0)  # each kind goes on behind its last match

    def add(kind: str, start: int, end: int, good: bool) -> None:
        past[kind] = end
        if good:
            found[kind].append((kind, start, end))

    for end, anchor in anchors().iter(text):
        if anchor == "digit":
            if end >= past["card"]:
                m = CARD.match(text, end)
                if m:
                    digits = digits_of(m.group())
                    add("card", end, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
                else:
                    past["card"] = end + 1
            if end >= past["ip"]:
                m = IP.match(text, end)
                if m:
                    add("ip", end, m.end(), byte_parts(m.group()))
                else:
                    past["ip"] = DIGITS.match(text, end).end()
        elif anchor == "at":
            start = end
            while start > past["email"] and text[start - 1] in LOCAL:
                start -= 1
            m = DOMAIN.match(text, end + 1) if start < end else None
            if m:
                add("email", start, m.end(), True)
        elif anchor == "plus":
            m = PHONE.match(text, end) if end >= past["phone"] else None
            if m:
                add("phone", end, m.end(), 8 <= len(digits_of(m.group())) <= 15)
        elif anchor == "scheme":
            start = end - 2  # the colon
            while start > past["address"] and "a" <= text[start - 1] <= "z":
                start -= 1
            m = ADDRESS.match(text, end + 1) if start >= past["address"] else None
            if m:
                numeric = IP.fullmatch(m.group(2)) is not None and byte_parts(m.group(2))
                add("address", start, m.end(), numeric or bool(m.group(1)) and "." in m.group(2))
        elif anchor == "iban":
            m = IBAN.match(text, end + 1)
            if m and m.start(1) >= past["iban"]:
                add("iban", m.start(1), m.end(1), iban_valid(m.group(1)))
        elif anchor == "ssn":
            m = SSN.match(text, end + 1)
            if m and m.start(1) >= past["ssn"]:
                area, group, serial = m.groups()
                good = area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"
                add("ssn", m.start(1), m.end(3), good)
    return [s for k in KINDS for s in found[k]]


SPANS = ArrayType(
    StructType(
        [
            StructField("kind", StringType(), False),
            StructField("start", IntegerType(), False),
            StructField("end", IntegerType(), False),
        ]
    ),
    False,
)
ARROW_SPANS = pa.list_(
    pa.field(
        "element",
        pa.struct(
            [
                pa.field("kind", pa.string(), False),
                pa.field("start", pa.int32(), False),
                pa.field("end", pa.int32(), False),
            ]
        ),
        False,
    )
)


def scan_batches(batches: Iterator[pa.RecordBatch], work: str, spans_col: str):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(work))
        spans = pa.array(
            [[{"kind": k, "start": a, "end": b} for k, a, b in spans_of(t.as_py())] for t in texts], ARROW_SPANS
        )
        kept = [i for i, name in enumerate(batch.schema.names) if name != work]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in kept), spans], names=[*(batch.schema.names[i] for i in kept), spans_col]
        )


def find_personal_data(df: DataFrame, text_col: str = "text", spans_col: str = "spans") -> DataFrame:
    """``df`` with its spans: array of (kind, start, end)."""
    df = replace_columns(df, [spans_col]) if spans_col != text_col else df
    work = fresh(df, "text_to_scan")
    schema = StructType([*df.schema.fields, StructField(spans_col, SPANS, False)])
    return df.withColumn(work, whole(text_col)).mapInArrow(
        lambda batches: scan_batches(batches, work, spans_col), schema
    )
