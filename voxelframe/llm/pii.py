"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at-signs, digits, plus signs, schemes, cue words); a local parser then expands
each to the boundaries of an address, number, link or secret and validates it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from voxelframe.llm.common import arrow_map, id_text, slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "iban", "ssn", "secret")
SCHEMA = ("doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "masked string")
SCHEMES = ("http://", "https://", "ftp://", "mailto:")
CUES = {"iban": ("iban",), "ssn": ("ssn", "social security"),
        "secret": ("token", "api_key", "api key", "apikey", "password", "passwd", "secret", "access_key", "access key", "access-key", "api-key",
                   "private_key", "private key", "private-key")}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
QUAD = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`]*[^\s<>\"'`.,;:!?()\[\]{}]")
LABELS = r"(?:[\s:=#_-]{0,3}(?i:numbers?|num|nummer|no|nr|is|id|code|key|value)(?![A-Za-z0-9])\.?){0,3}"  # "number is", "no."
IBAN = re.compile(LABELS + r"[\s:=#]{0,3}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30})")
SSN = re.compile(LABELS + r"[\s:=#]{0,3}([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9])")
SECRET = re.compile(r"s?(?:" + LABELS + r"[\"']?\s{0,2}[:=]\s{0,2}|\s{1,2}(?i:is|are)\s{1,2})[\"']?([A-Za-z0-9_+/.=-]{8,})")
KEYS = {"akia": re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])"), "aiza": re.compile(r"AIza[0-9A-Za-z_-]{35}"),  # issuers' prefixes, lower-cased, and forms
        "ghp_": re.compile(r"ghp_[0-9A-Za-z]{36}"), "xoxb-": re.compile(r"xoxb-[0-9A-Za-z-]{20,}"), "sk_live_": re.compile(r"sk_live_[0-9A-Za-z]{16,}")}
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
SHAPE = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
IBAN_SIZES = {c[:2]: int(c[2:]) for c in (  # characters by country, for numbers without a cue
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 "
    "FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 "
    "ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 "
    "ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}

Span = tuple[int, str, int]


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for c in "0123456789":
        a.add_word(c, ("digit", 1))
    a.add_word("@", ("email", 1))
    a.add_word("+", ("phone", 1))
    for kind, words in {"url": SCHEMES, **CUES, "key": KEYS}.items():
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban_end(text: str) -> int:
    """Length of the longest start of the candidate whose check digits are right; 0 if none is."""
    for end in range(len(text), 14, -1):
        s = text[:end].replace(" ", "")
        if text[end - 1] != " " and len(s) >= 15 and right_iban(s):
            return end
    return 0


def right_iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def bare_iban(text: str, start: int) -> int:
    """End of the number that starts there, of its country's size and with right check digits; 0 if there is none."""
    m = None if start and text[start - 1].isalnum() else SHAPE.match(text, start)
    size = IBAN_SIZES.get(text[start:start + 2])
    if not m or not size:
        return 0
    end = start
    while size and end < m.end():
        size -= text[end] != " "
        end += 1
    return end if not size and not text[end:end + 1].isalnum() and right_iban(text[start:end].replace(" ", "")) else 0


def likely_secret(value: str) -> bool:
    """Not a word of a sentence: digits with letters, or a long mixture of both cases. Digits alone are other kinds' matter."""
    letters, digits = sum(c.isalpha() for c in value), sum(c.isdigit() for c in value)
    ups, lows = sum(c.isupper() for c in value), sum(c.islower() for c in value)
    return bool(letters and digits) or len(value) >= 12 and ups >= 3 and lows >= 3 and len(set(value)) >= 8


def right_ssn(value: str) -> bool:
    """Areas 000, 666 and from 900 on, group 00 and serial 0000 are never given out."""
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def lower(text: str) -> str:
    """Lower case, of equal length: only the dotted capital I becomes two."""
    return text.replace("\u0130", "i").lower()


def find(text: str) -> list[Span]:
    """(start, kind, end) of every span in code points, by start and kind.

    Per base kind exactly the leftmost non-overlapping matches of its pattern that pass its check: a failed match is
    passed over whole. An anchor inside what its kind has already consumed is skipped.
    """
    spans: list[Span] = []
    done = dict.fromkeys((*KINDS, "digit"), 0)  # per kind, the end of what is consumed
    for last, (kind, width) in automaton().iter(lower(text)):
        at = last + 1 - width
        if kind == "digit":
            if at >= done["iban"] + 2 and text[at - 1] in UPPER and text[at - 2] in UPPER and (end := bare_iban(text, at - 2)):
                done["iban"] = end
                spans.append((at - 2, "iban", end))
            if at >= done["card"]:
                if m := DIGITS.match(text, at):
                    done["card"] = m.end()
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        spans.append((at, "card", m.end()))
                else:
                    done["card"] = at + 1
            if at >= done["ip"]:
                if m := QUAD.match(text, at):
                    done["ip"] = m.end()
                    if all(len(g) <= 3 and int(g) <= 255 or int(g[-3:]) <= 255 and not g[:-3].strip("0") for g in m.groups()):
                        spans.append((at, "ip", m.end()))
                else:  # another digit of this run cannot begin a match either
                    end = at + 1
                    while end < len(text) and text[end] in "0123456789":
                        end += 1
                    done["ip"] = end
        elif kind == "email":
            start = at
            while start > done["email"] and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                done["email"] = m.end()
                spans.append((start, "email", m.end()))
        elif kind == "phone":
            if at >= done["phone"] and (m := PHONE.match(text, at)):
                done["phone"] = m.end()
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    spans.append((at, "phone", m.end()))
        elif kind == "url":
            if at >= done["url"] and (m := URL.match(text, last + 1)):
                done["url"] = m.end()
                spans.append((at, "url", m.end()))
        elif kind == "key":
            if at >= done["secret"] and not (at and text[at - 1].isalnum()) and (m := KEYS[lower(text[at:last + 1])].match(text, at)):
                done["secret"] = m.end()
                spans.append((at, "secret", m.end()))
        elif last + 1 >= done[kind]:
            m = {"iban": IBAN, "ssn": SSN, "secret": SECRET}[kind].match(text, last + 1)
            right = {"iban": iban_end, "ssn": lambda v: right_ssn(v) * len(v), "secret": lambda v: likely_secret(v) * len(v)}[kind]
            if m and (size := right(m.group(1))):
                done[kind] = m.start(1) + size
                spans.append((m.start(1), kind, done[kind]))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[1])))


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span, or each union of overlapping spans, replaced by the kind of its first in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for start, kind, end in spans:
        if merged and start < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], end)
        else:
            merged.append([start, kind, end])
    for start, kind, end in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_masked: bool = True) -> DataFrame:
    """Counts, digest of the base spans, all spans and, if wanted, the masked text; a row for each input row.

    Null texts count as empty: no spans, the digest of nothing, and a null masked text. Repeated rows and null ids give a
    row each; other columns are ignored.
    """

    def of(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        found = [find(t) if t else [] for t in texts]
        base = [[s for s in f if s[1] in BASE] for f in found]
        return {"doc_id": batch.column(0), **{f"n_{k}": [sum(s[1] == k for s in b) for b in base] for k in BASE},
                "base_sha256": [hashlib.sha256(listed(b).encode()).hexdigest() for b in base],
                "spans": [listed(f) for f in found],
                **({"masked": [t if not f else mask(t, f) for t, f in zip(texts, found, strict=True)]} if with_masked else {})}

    return arrow_map(id_text(docs, id_col, text_col), of, SCHEMA if with_masked else SCHEMA.removesuffix(", masked string"))


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs with every span of their texts masked; null texts and all other columns stay as they are."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = batch.columns
            columns[at] = pa.array([mask(t, find(t)) if t else t for t in columns[at].to_pylist()], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
