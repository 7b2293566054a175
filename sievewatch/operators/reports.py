"""Incident reports: fixed text around findings, and the report sections as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, first_truthy
from .prompts import fill

# fixed values: report layout, section names and the steps under them; defaults that callers may replace
BASIC_REPORT = """================================================
{title}
Generated: {generated}
================================================

NOTE: LLM unavailable — basic report generated.

FINDINGS SUMMARY:
{findings}

RECOMMENDED ACTION:
Investigate immediately and escalate to senior analyst.
================================================"""
TITLE = "INCIDENT REPORT"
STATUS = "Under Investigation"
UNMAPPED = "Under analysis"
ASSET_PURPOSE, ASSET_STATUS = "Production Server", "Suspected Compromised"
ACTIONS = [
    ("Immediate — Within 1 Hour",
     "Isolate {host} and block all suspicious source IPs at the perimeter firewall. Notify the "
     "incident response team and escalate to senior analyst immediately."),
    ("Short Term — Within 24 Hours",
     "Conduct full forensic analysis of {host}. Review all authentication logs, running processes, "
     "and network connections. Patch all identified vulnerabilities."),
    ("Long Term — Within 1 Week",
     "Introduce a second factor for logins, tune the alert rules that fired late or too often, and "
     "rehearse the answer to {technique} with the team."),
]
SECTIONS = [
    ("Containment", [
        "Isolate {host} ({ip}) from the network if active threat is confirmed",
        "Block source IP addresses identified in the alert at the perimeter firewall immediately",
        "Revoke all active sessions and credentials on the affected system",
        "Enable enhanced logging on adjacent systems to detect lateral movement",
    ]),
    ("Eradication", [
        "Identify and confirm the point of entry for the attack",
        "Remove all malicious files, processes, or artifacts introduced by the attacker",
        "Apply all pending security patches and configuration hardening measures",
        "Disable unused services and enforce the principle of least privilege",
        "Scan the host again for rootkits and known vulnerabilities, and keep the results",
    ]),
    ("Recovery", [
        "Restore {host} from a verified clean backup if compromise is confirmed",
        "Verify full system integrity before reconnecting to the production network",
        "Monitor {host} closely for 72 hours post-recovery for signs of re-infection",
        "Confirm all services are operational and performing normally before closing the incident",
        "Update incident status to Resolved after full verification and sign-off",
    ]),
    ("Lessons Learned", [
        "Note how long it took from the first alert to its classification, and what delayed it",
        "Check whether the mapped technique matched what the investigation found",
        "The rule fired at level {level} of 15; decide whether that level was right",
        "Correct this report where the investigation has gone beyond it",
        "Bring what was learned here to the next review of the rules",
    ]),
]


def basic_report(findings: Column | str, generated: Column | str, title: str = TITLE) -> Column:
    """Report without a model; the time is an input, so a rerun gives the same text."""
    return fill(BASIC_REPORT, title=F.lit(title), generated=col(generated), findings=col(findings))


def _or(name: str, empty: str) -> Column:
    return F.coalesce(F.nullif(F.col(name).cast("string"), F.lit("")), F.lit(empty))


def _fields() -> dict[str, Column]:
    return {
        "host": _or("agent_name", "Unknown"), "ip": _or("agent_ip", "Unknown"),
        "level": F.coalesce(F.nullif(F.col("rule_level").cast("string"), F.lit("0")), F.lit("—")),
        "technique": first_truthy("technique", F.lit("identified attack technique")),
    }


def incident_summary(alerts: DataFrame, source: str = "SIEM") -> DataFrame:
    """Summary fields per alert (needs ``severity``)."""
    f = _fields()
    return alerts.select(
        "alert_id", "severity", F.lit(STATUS).alias("status"),
        F.concat(F.lit(f"{source} — Rule "), _or("rule_id", "—")).alias("detection_source"),
        F.concat(f["host"], F.lit(" ("), f["ip"], F.lit(")")).alias("affected_host"),
        F.concat(f["level"], F.lit(" / 15")).alias("rule_level"),
    )


def incident_timeline(alerts: DataFrame, source: str = "SIEM") -> DataFrame:
    """Three rows per alert: detected, mapped, classified (needs ``severity, technique``)."""
    f = _fields()
    place = F.concat(f["host"], F.lit(" ("), f["ip"], F.lit(")"))
    entries = [
        (source, F.concat(F.lit("Alert triggered — "), _or("description", "Unknown"), F.lit(" on "),
                          place)),
        ("Retrieval", F.concat(F.lit("MITRE ATT&CK technique mapped: "),
                               first_truthy("technique", F.lit(UNMAPPED)))),
        ("Classification", F.concat(F.lit("Severity classified as "), F.col("severity"),
                                    F.lit(" — incident report generated"))),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(who).alias("detection_source"), text.alias("event"))
        for i, (who, text) in enumerate(entries, start=1)
    ])
    return alerts.select("alert_id", "timestamp", F.inline(rows))


def affected_assets(alerts: DataFrame) -> DataFrame:
    """Hosts with the alert descriptions seen on them."""
    f = _fields()
    return alerts.select(
        f["host"].alias("server"), f["ip"].alias("ip_address"),
        F.lit(ASSET_PURPOSE).alias("purpose"), F.lit(ASSET_STATUS).alias("status"),
        _or("description", "Unknown").alias("comments"),
    ).distinct()


def recommended_actions(alerts: DataFrame, actions: list[tuple[str, str]] = ACTIONS) -> DataFrame:
    """A row per alert and action ``(label, text)`` with host and technique filled in."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(label).alias("label"),
                 fill(text, **_fields()).alias("action"))
        for i, (label, text) in enumerate(actions, start=1)
    ])
    return alerts.select("alert_id", F.inline(rows))


def section_items(alerts: DataFrame, sections: list[tuple[str, list[str]]] = SECTIONS) -> DataFrame:
    """The steps of each section as list rows: containment, eradication, recovery and lessons, if not others."""
    rows = F.array(*[
        F.struct(F.lit(name).alias("section"), F.lit(i).alias("item"),
                 fill(text, **_fields()).alias("text"))
        for name, items in sections for i, text in enumerate(items, start=1)
    ])
    return alerts.select("alert_id", F.inline(rows))
