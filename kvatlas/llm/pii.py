"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs, plus signs, digits, URL schemes and
identifier cues. Local parsers then expand each anchor to the boundaries of an e-mail address, an IP or web
address, a phone, card or account number, and validate it. Expansion never looks past the run of characters
that a kind allows, so its cost is that of the text.

Base kinds, each leftmost and without overlaps within its kind: ``email``, ``ip`` (parts at most 255),
``card`` (13 to 19 digits, Luhn), ``phone`` (9 to 15 digits). The method adds ``account`` (an identifier after
a cue such as ``iban``, ``account`` or ``passport``; IBANs must pass their check), ``secret`` (a credential
after ``password``, ``token``, ...) and ``url``. Spans are in code points, the end exclusive.

Results for odd input: null and empty texts have no spans; long texts are scanned whole; repeated rows are
scanned once each; an empty table gives an empty result; extra columns are left out, so names can't clash.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvatlas.llm.shared import table

BASE, EXTRA = ("email", "ip", "card", "phone"), ("account", "secret", "url")
#: What announces a web address, an account and a credential.
SCHEMES = ("http://", "https://", "ftp://", "sftp://", "ws://", "wss://", "mailto:")
ACCOUNT_CUES = ("iban", "account", "acct", "passport", "ssn", "licence", "license no", "customer id", "member id")
SECRET_CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "api-key", "apikey", "access_key")

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
IP_RUN, CARD_RUN = re.compile(r"[0-9.]+"), re.compile(r"[0-9 -]+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"'`]+")
ACCOUNT = re.compile(r"(?:\s*(?:no|nr|number|id)\b\.?)?\s*[:=#]?\s*([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){3,8}|[A-Z]{0,2}[0-9][0-9-]{4,20}[0-9])", re.I)
SECRET = re.compile(r"\s*[:=]\s*[\"']?([A-Za-z0-9_./+=-]{8,})")
DIGITS = re.compile(r"[^0-9]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{10,30}", s):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in [("@", "at"), ("+", "plus"), *((d, "digit") for d in "0123456789")]:
        a.add_word(word, (kind, 1))
    for kind, words in (("scheme", SCHEMES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    a.make_automaton()
    return a


def _lower(text: str) -> str:
    """Lower case of the same length, so that places agree."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c if len(x := c.lower()) != 1 else x for c in text)


def find_spans(text: str, anchors) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind, ascending."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE + EXTRA}
    email_end = digit_end = phone_end = url_end = 0
    for last, (kind, size) in anchors.iter(_lower(text)):
        start, end = last - size + 1, last + 1
        if kind == "digit":
            if start < digit_end:
                continue
            # a run of digits, dots, blanks and hyphens around the anchor holds all that overlaps it
            run = CARD_RUN.match(text, start)
            dotted = IP_RUN.match(text, start)
            digit_end = max(_after_digits(text, run.end()), _after_digits(text, dotted.end()))
            # go on while a run of either kind reaches further
            while True:
                reach = digit_end
                for pattern in (CARD_RUN, IP_RUN):
                    if m := pattern.match(text, reach - 1):
                        digit_end = max(digit_end, _after_digits(text, m.end()))
                if digit_end == reach:
                    break
            for m in IP.finditer(text, start, digit_end):
                if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
                    found["ip"].append(m.span())
            for m in CARD.finditer(text, start, digit_end):
                digits = DIGITS.sub("", m.group())
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "at":
            first = start
            while first > email_end and text[first - 1] in _LOCAL_CHARS:
                first -= 1
            if first < start and (m := DOMAIN.match(text, end)):
                found["email"].append((first, m.end()))
                email_end = m.end()
        elif kind == "plus":
            if start >= phone_end and (m := PHONE.match(text, start)):
                phone_end = m.end()
                if 9 <= len(DIGITS.sub("", m.group())) <= 15:
                    found["phone"].append(m.span())
        elif kind == "scheme":
            if start >= url_end and (start == 0 or not text[start - 1].isalnum()) and (m := URL.match(text, end)):
                url_end = m.end()
                found["url"].append((start, start + len(text[start:url_end].rstrip(".,;:!?)]}"))))
        elif (start == 0 or not text[start - 1].isalnum()) and (m := (ACCOUNT if kind == "account" else SECRET).match(text, end)):
            size = len(m.group(1)) if kind == "secret" else _account_size(m.group(1))
            if size:
                found[kind].append((m.start(1), m.start(1) + size))
    for k in EXTRA:
        found[k] = _apart(found[k])
    return found


def _account_size(value: str) -> int:
    """Length of the account number that ``value`` begins with: an IBAN up to one of its blanks, or digits."""
    if not (value[:2].isalpha() and value[2:4].isdigit() and len(value) >= 15):
        return len(value)
    while value and not iban(value):
        value = value[: max(value.rfind(" "), 0)]
    return len(value)


def _after_digits(text: str, end: int) -> int:
    """Back from ``end`` to just behind a digit."""
    while not ("0" <= text[end - 1] <= "9"):
        end -= 1
    return end


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in sorted(set(spans), key=lambda s: (s[0], -s[1])):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, and ``found``: array of (kind, start, end, text), by kind as listed above, then by start."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        anchors = automaton()
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                spans = find_spans(text, anchors) if text else {}
                rows.append([{"kind": k, "start": s, "end": e, "text": text[s:e]} for k, own in spans.items() for s, e in own])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "found": rows})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(scan, "doc_id long, found array<struct<kind:string,start:int,end:int,text:string>>")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_spans(table(spark, sf_dir, "documents"))
    as_text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", *[count(k) for k in BASE + EXTRA], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))
