"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors (at signs, dots and plus signs before digits, schemes and
cues such as "iban"); local parsers expand each anchor to the left and right and validate what they
find. The four base kinds follow these patterns exactly (leftmost, non-overlapping per kind; a match
that fails its check is dropped without another try):

email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, ip ``[0-9]+(\\.[0-9]+){3}`` with parts
up to 255, card ``[0-9]([\\x20-]?[0-9])+`` with 13 to 19 digits that pass Luhn, phone
``\\+[0-9][\\x20().0-9-]+[0-9]`` with 9 to 15 digits.

Added kinds: ``account`` (an account or identity number behind a cue: iban with its check digits,
"ssn", "passport", "account", "acct"), ``url`` (an address behind a scheme that carries a user part, or an
e-mail address or phone number in its query) and ``secret`` (a value behind "token", "password", "api_key" and the like).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded_batches, forget, release

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url", "secret")
CUES = ("iban", "account", "acct", "ssn", "passport")
SECRET_CUES = ("token", "password", "passwd", "api_key", "apikey", "secret")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "mailto:", "tel:")
_LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOCAL = frozenset(_LETTERS + "0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_RUN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NUMBER = re.compile(r"(?=[A-Z0-9-]*[0-9]{4})[A-Z0-9][A-Z0-9-]{4,24}[A-Z0-9](?![A-Za-z0-9])")
_BEHIND_CUE = re.compile(r"(?: ?(?:no|nr|number|id))?\.? ?[#:=]? ?\"?")
_SIGN = re.compile(r" ?[:=] ?[\"']?")
_VALUE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_ADDRESS = re.compile(r"[^\s\"'<>]+")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    for d in "0123456789":
        a.add_word("." + d, ("dot", 2))
        a.add_word("+" + d, ("plus", 2))
        for e in "0123456789":
            a.add_word(d + e, ("digits", 2))
            a.add_word(d + " " + e, ("digits", 3))
            a.add_word(d + "-" + e, ("digits", 3))
    for kind, words in (("cue", CUES), ("secret", SECRET_CUES)):
        for w in words:
            for form in {w, w.upper(), w.capitalize()}:
                a.add_word(form, (kind, len(form)))
    for w in SCHEMES:
        a.add_word(w, ("scheme", len(w)))
    a.make_automaton()
    return a


_AUTOMATON = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban_holds(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def find_spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans ``(kind, start, end)`` by kind as listed in ``KINDS``, then start; code points."""
    if not text:
        return []
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the search for the next match of a kind begins
    for last, (kind, size) in _AUTOMATON.iter(text):
        at = last - size + 1
        if kind == "at":
            start, low = at, done["email"]
            while start > low and text[start - 1] in _LOCAL:
                start -= 1
            m = _DOMAIN.match(text, at + 1) if start < at else None
            if m:
                done["email"] = m.end()
                found["email"].append((start, m.end()))
        elif kind == "dot":
            start, low = at, done["ip"]
            while start > low and text[start - 1] in _DIGITS:
                start -= 1
            m = _QUAD.match(text, start) if start < at else None
            if m:
                done["ip"] = m.end()
                parts = [p.lstrip("0") for p in m[0].split(".")]  # of any length
                if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                    found["ip"].append(m.span())
        elif kind == "digits":
            # the automaton meets the first two digits of a run first, so a run begins at its anchor
            if at >= done["card"]:
                m = _RUN.match(text, at)
                done["card"] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    found["card"].append(m.span())
        elif kind == "plus":
            if at >= done["phone"]:
                m = _PHONE.match(text, at)
                if m:
                    done["phone"] = m.end()
                    if 9 <= sum(c in _DIGITS for c in m[0]) <= 15:
                        found["phone"].append(m.span())
        elif kind == "cue":
            if (at and text[at - 1].isalnum()) or last < done["account"]:
                continue
            start = _BEHIND_CUE.match(text, last + 1).end()
            if start == last + 1:
                continue
            iban = text[at : last + 1].lower() == "iban"
            m = (_IBAN if iban else _NUMBER).match(text, start)
            if m and (not iban or iban_holds(m[0])):
                done["account"] = m.end()
                found["account"].append(m.span())
        elif kind == "secret":
            sign = _SIGN.match(text, last + 1)
            m = _VALUE.match(text, sign.end()) if sign and sign.end() >= done["secret"] else None
            if m:
                done["secret"] = m.end()  # a value without a digit holds none behind a cue inside it either
                if any(c in _DIGITS for c in m[0]):
                    found["secret"].append(m.span())
        elif at >= done["url"]:
            m = _ADDRESS.match(text, last + 1)
            if m:
                done["url"] = m.end()
                host, _, rest = m[0].partition("/")
                if "@" in host or "@" in rest.partition("?")[2] or _PHONE.search(rest.partition("?")[2]) or text[at:last] in ("mailto", "tel"):
                    found["url"].append((at, m.end()))
    return [(k, s, e) for k in KINDS for s, e in found[k]]


def shown(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, spans array<struct<kind, start, end>>``.

    Null and empty texts have no spans; ids may be null or repeat; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_spans(t)] for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(got, pa.list_(span))], names=["doc_id", "spans"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(spans, f"doc_id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")


def text_of(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select(
        "doc_id",
        *[F.size(F.expr(f"filter(spans, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


def masked(text: str | None) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans become one."""
    if text is None:
        return None
    out, at = [], 0
    for k, s, e in sorted(find_spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
            at = e
        elif e > at:
            at = e
    return "".join([*out, text[at:]]) if out else text


def mask(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """``docs`` with masked texts; ``length_col``, if there, follows the text. All rows stay."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for texts in batches:
            yield pd.Series([masked(t) for t in texts.tolist()], dtype=object)
        release()

    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if length_col in docs.columns:
        out = out.withColumn(length_col, F.length(text_col).cast(docs.schema[length_col].dataType))
    return out.select(*docs.columns)
