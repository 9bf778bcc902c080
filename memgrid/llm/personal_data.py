"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The base kinds (e-mail, IP, card, phone) are reported as they are found. Further kinds are proposed by looser patterns; those with a
checksum (IBAN by mod 97, French social security number by its mod-97 key, Spanish identity number by its mod-23 letter) must pass it, the
others (US social security number, local phone number) only follow rules of their form. Each kind has a score to start from, a word of
its list near a span raises it, a word that speaks against it lowers it, and a further span is reported from LEAST on. Of further spans
that overlap the better one stays, and none stays that overlaps a base span. Scores of base spans are given, but decide nothing.

Patterns are matched so that each character is looked at a bounded number of times, whatever the text: e-mails from their "@" to both
sides, IPs and cards out of maximal chains of digits. The result is that of a leftmost match of the plain patterns (tests compare).

Texts stay where they are, in Arrow batches; nothing is shuffled. Python holds one slice of texts, or one long text, at once.

Defined results: a null text is an empty one without spans; repeated rows each get their result; an empty table gives an empty one;
other columns pass through redacted() untouched, and op12 ignores them.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import base

#: Kinds in the order they are listed in; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "iban", "fr_nir", "es_dni", "us_ssn", "local_phone")
BASE = 4
#: The score that a span of a kind starts with, by a checksum's strength.
START = (0.9, 0.6, 0.8, 0.7, 0.8, 0.7, 0.5, 0.4, 0.3)
#: What a word nearby adds or takes, the least score of a further span, and how far a word may stand, in code points before and after.
RAISE, LOWER, LEAST, BEFORE, AFTER = 0.3, 0.3, 0.6, 60, 30
# Words that speak for a kind, in four languages, and words that speak against every kind.
WORDS = {
    "email": ("mail", "e-mail", "email", "contact", "kontakt", "courriel", "correo"),
    "ip": ("ip", "host", "server", "address", "adresse", "login", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "carte", "karte", "tarjeta", "kreditkarte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "téléphone", "anruf", "teléfono", "telefono", "móvil", "appelez"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta", "banque", "banco"),
    "fr_nir": ("nir", "sécurité", "securite", "sociale", "insee", "assuré"),
    "es_dni": ("dni", "nif", "nie", "identidad", "documento"),
    "us_ssn": ("ssn", "social", "security"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "telephone", "téléphone", "anruf", "teléfono", "telefono", "móvil", "appelez"),
}
AGAINST = ("version", "isbn", "issn", "order", "invoice", "bestellnummer", "facture", "pedido", "example", "doi")
# Lengths of account numbers by country, and the letters of the Spanish identity number.
IBAN_LENGTHS = {
    "AD": 24, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25,
    "RO": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
}
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
CHAIN = re.compile(r"[0-9]+(?:[ -][0-9]+)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
DNI = re.compile(r"(?<![A-Za-z0-9])(?:[0-9]{8}|[XYZ][0-9]{7})-?[A-Z](?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9+.-])(?:\(0[0-9]{1,4}\)|0[0-9]{1,4})(?:[ ./-]?[0-9]{2,8}){1,5}(?![0-9])")
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """Whether the sum over digits, every second from the right doubled and its digits added, ends in zero."""
    twice = "0246813579"
    return (sum(map(int, digits[-1::-2])) + sum(int(twice[int(x)]) for x in digits[-2::-2])) % 10 == 0


def mod97(code: str) -> bool:
    """An IBAN without spaces: the first four characters at the end, letters as 10 to 35, leave 1."""
    return int("".join(str(int(x, 36)) for x in code[4:] + code[:4])) % 97 == 1


def nir_key(code: str) -> bool:
    """A French number of 13 places, with 2A and 2B as 19 and 18, and its key of two."""
    body = code[:13].replace("2A", "19").replace("2B", "18")
    return body.isdigit() and 97 - int(body) % 97 == int(code[13:])


def dni_letter(code: str) -> bool:
    code = code.replace("-", "")
    return DNI_LETTERS[int(code[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == code[-1]


def ssn_form(code: str) -> bool:
    area, group, serial = code.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern: a match's local part is all of its characters before the "@" that no match has taken."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Each four numbers in turn of a maximal dotted chain; all at most 255."""
    for chain in DOTTED.finditer(text):
        at, numbers = chain.start(), chain[0].split(".")
        for k in range(0, len(numbers) - 3, 4):
            four = numbers[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    """Maximal chains of digits with single spaces or hyphens, of 13 to 19 digits that pass Luhn."""
    for m in CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum(x.isdigit() for x in m[0]) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many characters as the country's numbers have; what follows must not go on with a letter or digit."""
    for m in IBAN.finditer(text):
        left, at = IBAN_LENGTHS.get(m[0][:2], 0), m.start()
        while left and at < m.end():
            left -= text[at] != " "
            at += 1
        code = text[m.start() : at].replace(" ", "")
        if not left and code and text[at : at + 1] not in LETTERS_DIGITS and mod97(code):
            yield m.start(), at


LETTERS_DIGITS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")


def checked(pattern: re.Pattern, valid, text: str) -> Iterator[tuple[int, int]]:
    for m in pattern.finditer(text):
        if valid(m[0]):
            yield m.span()


def context(text: str, start: int, end: int, kind: int) -> float:
    """The score of a span."""
    near = [w.lower() for a, z in ((max(0, start - BEFORE), start), (end, end + AFTER)) for w in WORD.findall(text, a, z)]
    score = START[kind] + RAISE * any(w in WORDS[KINDS[kind]] for w in near) - LOWER * any(w in AGAINST for w in near)
    return round(min(1.0, max(0.0, score)), 2)


def scanned(text: str) -> list[tuple[int, int, int, float]]:
    """(kind, start, end, score) of all spans, by kind and start."""
    digits = any(map(text.__contains__, "0123456789"))
    found = [(0, *x) for x in emails(text)]
    if digits:
        found += [(k, *x) for k, of in ((1, ips), (2, cards), (3, phones)) for x in of(text)]
    out = [(*x, context(text, x[1], x[2], x[0])) for x in found]
    if not digits:
        return out
    more = [(4, *x) for x in ibans(text)]
    more += [(5, *x) for x in checked(NIR, lambda x: nir_key(x.replace(" ", "")), text)]
    more += [(6, *x) for x in checked(DNI, dni_letter, text)]
    more += [(7, *x) for x in checked(SSN, ssn_form, text)]
    more += [(8, *x) for x in checked(LOCAL_PHONE, lambda x: 8 <= sum(map(str.isdigit, x)) <= 13, text)]
    scored = [(*x, context(text, x[1], x[2], x[0])) for x in more]
    ends = sorted((a, z) for _, a, z in found)
    reach = np.maximum.accumulate([z for _, z in ends]) if ends else []
    clear = lambda a, z: not (k := bisect_left(ends, (z, -1))) or reach[k - 1] <= a
    taken: list[tuple[int, int]] = []
    kept = []
    for x in sorted((x for x in scored if x[3] >= LEAST and clear(x[1], x[2])), key=lambda x: (-x[3], x[0], x[1])):
        k = bisect_left(taken, (x[1], x[2]))
        if (k == len(taken) or taken[k][0] >= x[2]) and (not k or taken[k - 1][1] <= x[1]):
            taken.insert(k, (x[1], x[2]))
            kept.append(x)
    return out + sorted(kept)


SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of each document: an array of (kind, start, end, score), kind a place in KINDS, ends exclusive, in code points."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches):
            rows = [[dict(zip(("kind", "start", "end", "score"), x, strict=True)) for x in scanned(t or "")] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(rows, SPANS)], ["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(f, "doc_id long, spans array<struct<kind: int, start: long, end: long, score: double>>")


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each run of overlapping spans in `text` replaced by the name of its first kind in brackets; other texts stay, null included."""
    at = next(c for c in docs.columns if c.lower() == "text")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in base.slices(batches, at):
            texts = []
            for t in b.column(at).to_pylist():
                spans, pieces, end = sorted((a, z, k) for k, a, z, _ in scanned(t or "")), [], 0
                for a, z, k in spans:
                    if a >= end:
                        pieces += [t[end:a], f"[{KINDS[k].upper()}]"]
                    end = max(end, z)
                texts.append("".join([*pieces, t[end:]]) if spans else t)
            yield b.set_column(b.schema.get_field_index(at), b.schema.field(at), pa.array(texts, b.schema.field(at).type))

    return docs.mapInArrow(f, docs.schema)


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = lambda rows: ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in rows)
        for b in batches:
            rows = b.column("spans").to_pylist()
            own = [[x for x in r if x["kind"] < BASE] for r in rows]
            counts = [pa.array([sum(x["kind"] == k for x in r) for r in own], pa.int64()) for k in range(BASE)]
            texts = [[hashlib.sha256(listed(r).encode()).hexdigest() for r in own], [listed(r) for r in rows], [",".join(f"{x['score']:.2f}" for x in r) for r in rows]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, *(pa.array(x, pa.string()) for x in texts)], names)

    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "scores"]
    return found(base.documents(spark, sf_dir)).mapInArrow(f, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS[:BASE]) + ", base_sha256 string, spans string, scores string")
