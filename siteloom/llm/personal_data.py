"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, digits, "://" and identifier cues. From each anchor a local
parser expands to the boundaries of an address, number or account and checks it. The base kinds (email, ip, card, phone)
come out as leftmost non-overlapping matches of their patterns would: every match must contain its anchor, anchors are
visited from the left, and none inside an earlier match of the kind counts. Two more kinds are added: uri (an address with
user data before an at-sign) and account (an identifier after a cue, by mod 97 if it is an IBAN).

Nulls and edge cases: a null or empty text has no span; offsets are code points of the whole text; repeated rows are
rows of their own; a null doc_id is returned as it is; extra columns pass through `find_personal_data`, which replaces a
column `personal`.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteloom.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone", "uri", "account")
BASE = KINDS[:4]
CUES = ("iban", "account number", "account no", "acct", "passport", "ssn", "social security", "tax id", "national id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile("[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_USER = re.compile(r"://[^\s/?#@]+@[^\s/?#@]+")
_ACCOUNT = re.compile(r"(?:\x20*(?:number|no\.?|is|code))?\x20*[:=#]?\x20*([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?|[A-Z0-9][A-Z0-9-]{5,24})(?![A-Za-z0-9])")

_automata: list = []


def _anchors() -> ahocorasick.Automaton:
    if not _automata:
        a = ahocorasick.Automaton()
        for mark in ("@", "+", "://", *"0123456789"):
            a.add_word(mark, "0" if mark.isdigit() else mark)
        for cue in CUES:
            for form in {cue, cue.upper(), cue.title(), cue.capitalize()}:
                a.add_word(form, "cue")
        a.make_automaton()
        _automata.append(a)
    return _automata[0]


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _iban(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end), by start and then in the order of KINDS."""
    text = text or ""
    found: list[tuple[str, int, int]] = []
    end = dict.fromkeys(KINDS, 0)  # where the last match of the kind ended, kept or dropped
    for last, mark in _anchors().iter(text):
        at = last
        if mark == "0":
            if at >= end["ip"]:
                if m := _IP.match(text, at):
                    end["ip"] = m.end()
                    if all(len(g) < 4 and int(g or 0) <= 255 for g in (x.lstrip("0") for x in m.groups())):
                        found.append(("ip", at, m.end()))
                else:  # what fails at a run of digits fails at its later digits, too
                    end["ip"] = _DIGITS.match(text, at).end()
            if at >= end["card"] and (m := _CARD.match(text, at)):
                end["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and _luhn(digits):
                    found.append(("card", at, m.end()))
        elif mark == "@":
            start = at
            while start > end["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                end["email"] = m.end()
                found.append(("email", start, m.end()))
        elif mark == "+":
            if m := _PHONE.match(text, at):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", at, m.end()))
        elif mark == "://":
            at -= 2
            m = _USER.match(text, at) if at >= end["uri"] else None
            start = at
            while m and start > end["uri"] and text[start - 1] in _SCHEME:
                start -= 1
            while start < at and not (text[start].isascii() and text[start].isalpha()):
                start += 1
            if m and start < at:
                end["uri"] = m.end()
                found.append(("uri", start, m.end()))
        elif (m := _ACCOUNT.match(text, last + 1)) and m.start(1) >= end["account"]:
            code = m[1]
            if _iban(code) if re.match("[A-Z]{2}[0-9]{2}", code) and len(code) >= 15 else sum(c.isdigit() for c in code) >= 5:
                end["account"] = m.end(1)
                found.append(("account", m.start(1), m.end(1)))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


def _join(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def _digest(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = spans(text)
        base = [s for s in found if s[0] in BASE]
        rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(_join(base).encode()).hexdigest(), _join(found), len(found) > 0))
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "found"])


def _masked(texts: pd.Series) -> pd.Series:
    out = []
    for text in texts:
        if text is None:
            out.append(None)
            continue
        at, parts = 0, []
        for kind, a, b in spans(text):
            if a >= at:
                parts += [text[at:a], f"<{kind}>"]
                at = b
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column `personal`: struct of counts, digest, spans, and whether any is found."""
    small_batches(docs.sparkSession)
    found = F.pandas_udf(_digest, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found boolean")
    return docs.withColumn("personal", found(F.col(text)))


def mask_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in angle brackets."""
    small_batches(docs.sparkSession)
    return docs.withColumn(text, F.pandas_udf(_masked, "string")(F.col(text)))


def personal_data_digest(docs: DataFrame) -> DataFrame:
    return find_personal_data(docs.select("doc_id", "text")).select("doc_id", "personal.*")
