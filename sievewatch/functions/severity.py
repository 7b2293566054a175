"""The severity scales of the domain. They disagree on purpose and are never merged."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import col, js_parse_int

# fixed values: band, lowest rule level, colour of the queue view
QUEUE_BANDS = [
    ("CRITICAL", 12, "#e53e3e"),
    ("HIGH", 8, "#ed8936"),
    ("MEDIUM", 4, "#ecc94b"),
    ("LOW", None, "#38a169"),
]
# fixed values: lowest rule level of the triage request keywords
REQUEST_CRITICAL, REQUEST_HIGH = 10, 7
# fixed values: lowest CVSS score and advice text
CVSS_BANDS = [
    (9.0, "CRITICAL", "immediate action required"),
    (7.0, "HIGH", "urgent attention needed"),
    (4.0, "MEDIUM", "schedule remediation"),
    (None, "LOW", "monitor"),
]


def _banded(value: Column, rows) -> Column:
    """First row whose bound is reached; the last row has no bound and is the default."""
    *bounded, (_, default) = rows
    out = None
    for bound, result in bounded:
        hit = value >= bound
        out = F.when(hit, F.lit(result)) if out is None else out.when(hit, F.lit(result))
    return out.otherwise(F.lit(default))


def level_number(level: Column | str) -> Column:
    """Rule level as a number; text without a leading number is null."""
    return js_parse_int(F.coalesce(col(level).cast("string"), F.lit("0")))


def queue_band(level: Column | str) -> Column:
    return _banded(level_number(level), [(b, name) for name, b, _ in QUEUE_BANDS])


def queue_colour(level: Column | str) -> Column:
    return _banded(level_number(level), [(b, colour) for _, b, colour in QUEUE_BANDS])


def cvss_text(score: Column | str) -> Column:
    s = col(score)
    advice = _banded(s, [(b, f"/10 — {name} ({text})") for b, name, text in CVSS_BANDS])
    return F.when(s.isNull(), F.lit("No CVSS score available")).otherwise(
        F.concat(s.cast("string"), advice)
    )
