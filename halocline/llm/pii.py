"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds the anchors: at-signs, plus signs, digits, URL schemes and cue words for
accounts, secrets and addresses. A parser for each kind then reads the text around its anchors only and decides where
the span starts and ends and whether it is valid. Spans of one kind never overlap; those of different kinds may.

Base kinds (leftmost, non-overlapping; a match that fails its check is dropped and scanning goes on behind it):
email, ip (parts at most 255), card (16 to 19 digits passing Luhn), phone (8 to 15 digits).
Further kinds of the method: url, account (IBAN, cut to its country's length, with its check digits), secret (behind a cue and a
sign, a long value, or behind a cue and a verb, one with letters and digits) and address. An address is a house number, one to three
capitalised words of any length and a street word (English), a word that ends in a street word and a number (German), or
a street word, at most three small words, one to three capitalised words and a number (French and Spanish, where the number may
also come first).

Positions are code points, ends exclusive. Defined results: null or empty text has no spans; repeated rows are reported
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account", "secret", "address")
# Cues in the languages of the corpus, and the lengths of account numbers by country.
SECRET_CUES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "passwort", "kennwort", "mot de passe", "contraseña")
ACCOUNT_CUES = ("iban",)
STREET_CUES = ("street", "avenue", "road", "boulevard", "lane", "st.", "ave.", "rd.")
ENDING_CUES = ("strasse", "straße", "str.", "gasse", "platz", "allee")
LEADING_CUES = ("rue", "avenue", "boulevard", "impasse", "calle", "avenida", "plaza", "paseo")
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18,
    "DO": 28, "EE": 20, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23,
    "IS": 26, "IT": 27, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30,
    "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26,
    "UA": 29, "XK": 20,
}
SCHEMES = ("http://", "https://", "ftp://")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
URL = re.compile(r"[^\s<>\"']+")
SECRET = re.compile(r"[\x20\t]{0,3}[:=][\x20\t]{0,3}[\"']?([A-Za-z0-9_+/=.-]{16,})")
SAID = re.compile(r"[\x20\t]{1,3}(?:is|ist|lautet|est|es)[\x20\t]{1,3}[\"']?((?=[A-Za-z_+/=-]*[0-9])(?=[0-9_+/=-]*[A-Za-z])[A-Za-z0-9_+/=-]{8,})")
IBAN = re.compile(r"[\x20:]{0,3}([A-Z]{2}[0-9]{2})")
BEHIND = re.compile(r"\x20([0-9]{1,5}[a-z]?)(?![\w])")
FOLLOWS = re.compile(r"(?:\x20(?:de|del|des|du|la|las|le|les|los|el)){0,3}((?:\x20[A-ZÀ-Þ][\w'-]*){0,3})(?:,?\x20([0-9]{1,5}))?(?![\w])")
NAME = re.compile(r"[A-Z][\w'-]*")
NUMBER = re.compile(r"(?<![^\W_])[0-9]{1,5}")


@lru_cache(1)
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    words = [("@", "email"), ("+", "phone"), *((d, "digit") for d in "0123456789"), *((s, "url") for s in SCHEMES)]
    for kind, cues in (("secret", SECRET_CUES), ("account", ACCOUNT_CUES), ("address", STREET_CUES), ("ending", ENDING_CUES), ("leading", LEADING_CUES)):
        words += [(form, kind) for cue in cues for form in {cue, cue.upper(), cue.capitalize()}]
    kinds: dict[str, list[str]] = {}
    for word, kind in words:
        kinds.setdefault(word, []).append(kind)
    for word, own in kinds.items():
        found.add_word(word, (tuple(own), len(word)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def iban_end(text: str, at: int) -> int:
    """Where an account number that starts at `at` ends: after its country's number of letters and digits, between which single
    spaces may stand. -1 if there are fewer, more follow without a space, or the check digits are wrong."""
    size, found, end = IBAN_LENGTHS.get(text[at : at + 2], 0), [], at
    while len(found) < size and end < len(text):
        c = text[end]
        if "A" <= c <= "Z" or "0" <= c <= "9":
            found.append(c)
        elif c != " " or text[end - 1] == " ":
            return -1
        end += 1
    if not size or len(found) < size or text[end : end + 1].isalnum():
        return -1
    return end if int("".join(str(int(c, 36)) for c in found[4:] + found[:4])) % 97 == 1 else -1


def street_before(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The address whose street word at `at` ends a capitalised word and stands before a house number."""
    start = at
    while start and (text[start - 1].isalpha() or text[start - 1] == "-"):
        start -= 1
    number = BEHIND.match(text, end)
    return (start, number.end(1)) if number and text[start].isupper() else None


def street_after(text: str, at: int, end: int) -> tuple[int, int] | None:
    """The address that a street word at `at` begins, with a name behind it and a house number behind that or before it."""
    name = FOLLOWS.match(text, end)
    if at and text[at - 1].isalnum() or not name or not name[1] and not name[2]:
        return None
    number = re.search(r"(?<![\w])[0-9]{1,5},?\x20$", text[max(0, at - 7) : at])
    if name[2]:
        return at, name.end(2)
    return (max(0, at - 7) + number.start(), name.end(1)) if number and name[1] else None


def address_start(text: str, at: int) -> int:
    """Where an address starts whose street word stands at `at`; -1 if none does."""
    end = at - 1  # of the word before, whose last place is a space
    for _ in range(4):
        if end < 1 or text[end] != " ":
            return -1
        start = text.rfind(" ", 0, end) + 1
        if end < at - 1 and (m := NUMBER.search(text, max(start, end - 5), end)) and m.end() == end:
            return m.start()
        if not NAME.fullmatch(text, start, end):
            return -1
        end = start - 1
    return -1


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end), by kind as listed in KINDS and then by start."""
    spans: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    behind = dict.fromkeys(KINDS, 0)  # the end of each kind's last match, kept or dropped
    n = len(text)

    def take(kind: str, start: int, end: int, good: bool = True) -> None:
        behind[kind] = end
        if good:
            spans[kind].append((start, end))

    for last, anchor, size in ((last, kind, size) for last, (kinds, size) in _anchors().iter(text) for kind in kinds):
        at = last - size + 1
        if anchor == "digit":
            if at >= behind["ip"] and (at == behind["ip"] or not "0" <= text[at - 1] <= "9") and (m := IP.match(text, at)):
                take("ip", at, m.end(), all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.groups()))
            if at >= behind["card"] and (m := CARD.match(text, at)):
                digits = m[0].replace(" ", "").replace("-", "")
                take("card", at, m.end(), 16 <= len(digits) <= 19 and luhn(digits))
        elif anchor == "email":
            start, least = at, behind["email"]
            while start > least and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                take("email", start, m.end())
        elif anchor == "phone":
            if at >= behind["phone"] and (m := PHONE.match(text, at)):
                take("phone", at, m.end(), 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15)
        elif anchor == "url":
            if at >= behind["url"] and (m := URL.match(text, last + 1)):
                end = m.start() + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    take("url", at, end)
        elif anchor == "secret":
            if at >= behind["secret"] and (m := SECRET.match(text, last + 1) or SAID.match(text, last + 1)):
                take("secret", m.start(1), m.end(1))
        elif anchor == "account":
            if at >= behind["account"] and (m := IBAN.match(text, last + 1)):
                end = iban_end(text, m.start(1))
                take("account", m.start(1), max(end, m.end(1)), end >= 0)
        elif anchor in ("ending", "leading"):
            span = (street_before if anchor == "ending" else street_after)(text, at, last + 1)
            if span and span[0] >= behind["address"]:
                take("address", *span)
        elif (last + 1 == n or not text[last + 1].isalnum()) and (start := address_start(text, at)) >= behind["address"]:
            take("address", start, last + 1)
    return [(k, s, e) for k in KINDS for s, e in spans[k]]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, a count per base kind, base_sha256, all spans and their number."""

    @F.pandas_udf("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint")
    def scan(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            spans = find_spans(text or "")
            base = [s for s in spans if s[0] in BASE]
            rows.append((*(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans)))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", scan(F.col("text").cast("string")).alias("found")).select("doc_id", "found.*")
