"""Model answers as text -> columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import col, first_truthy, js_trim, py_strip

# fixed values: answer patterns (no look-ahead, so that other engines take them too)
SEVERITY = r"(?i)SEVERITY[:\s]+([A-Z]+)"
REASONING = r"(?is)REASONING[:\s]+(.*?)(?:RECOMMENDED|MITRE|\z)"
TECHNIQUE = r"(?is)MITRE TECHNIQUES?[:\s]+(.*?)(?:CONFIDENCE|RECOMMENDED|\z)"
ACTION = r"Action:\s*([a-zA-Z_]+)"
ACTION_INPUT = r"(?s)Action Input:\s*(.+?)(?:\n\n|\nThought|\nAction:|$)"
THOUGHT = r"(?s)Thought:\s*(.+?)(?:\nAction:|$)"
# fixed values: severities in order of weight, tools of an investigation
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
TOOLS = ["query_siem", "lookup_threat_intel", "map_to_mitre", "check_cve", "generate_report"]


def _found(text: Column, pattern: str) -> Column:
    """First group of the first match, null when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def clean_text(text: Column | str) -> Column:
    r"""Literal ``\n`` to line breaks, bullets to one form, trimmed."""
    c = F.replace(col(text), F.lit("\\n"), F.lit("\n"))
    c = F.replace(c, F.lit("\n- "), F.lit("\n• "))
    return js_trim(F.regexp_replace(c, r"(?m)^\s*[-•]\s*", "• "))


def endpoint_json(text: Column | str) -> Column:
    """The answer as the text of the service's JSON object, as a browser hands it on."""
    return F.to_json(F.struct(F.lit(True).alias("success"), col(text).alias("classification")))


def parse_answers(answers: DataFrame, text: str = "text") -> DataFrame:
    """Add ``severity, reasoning, technique`` from the three patterns.

    Columns ``severity``, ``reasoning``, ``result`` and ``mitre_technique`` of the input, where
    present, fill what the text does not give.
    """
    have = set(answers.columns)

    def given(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    # one stage per step, so that each pattern runs once per text
    raw = F.coalesce(text, F.lit(""))
    found = answers.select(
        "*", F.regexp_extract(raw, SEVERITY, 1).alias("_severity"),
        F.regexp_extract(raw, REASONING, 1).alias("_reasoning"),
        F.regexp_extract(raw, TECHNIQUE, 1).alias("_technique"),
    )
    trimmed = found.withColumns({
        "_reasoning": first_truthy(
            js_trim("_reasoning"), given("reasoning"), F.coalesce(given("result"), F.lit(""))
        ),
        "_technique": js_trim("_technique"),
    })
    out = {
        "severity": F.coalesce(F.nullif("_severity", F.lit("")), given("severity")),
        "reasoning": clean_text("_reasoning"),
        "technique": first_truthy("_technique", given("mitre_technique")),
    }
    keep = [c for c in answers.columns if c not in out and c not in {"result", "mitre_technique"}]
    return trimmed.select(*keep, *[c.alias(n) for n, c in out.items()])


def _section(text: Column, heading: str, stops: list[str]) -> Column:
    """Text between a heading line and the next of the stop headings."""
    ends = "|".join(rf"^[ \t]*{s}" for s in stops)
    tail = f"{ends}|" if ends else ""
    return F.regexp_extract(text, rf"(?ims)^[ \t]*{heading}:[ \t]*(.*?)(?:{tail}\z)", 1)


def _bullets(section: Column) -> Column:
    """Items of the lines that begin with a bullet."""
    lines = F.filter(F.split(section, "\n"), lambda x: x.rlike(r"^\s*[-•]"))
    return F.transform(lines, lambda x: py_strip(F.regexp_replace(x, r"^\s*[-•]\s*", "")))


def parse_sections(answers: DataFrame, text: str = "text") -> DataFrame:
    """All prompted sections by line-anchored headings.

    ``severity, techniques[], reasons[], action`` of a classification and ``primary_id,
    primary_name, confidence, reason, secondary`` of a mapping answer.
    """
    t = F.coalesce(text, F.lit(""))
    stops = ["MITRE TECHNIQUES IDENTIFIED:", "REASONING:", "RECOMMENDED ACTION:"]
    line = lambda head: _found(t, rf"(?im)^[ \t]*{head}:[ \t]*([^\n]*)")
    primary = line("PRIMARY TECHNIQUE")
    return answers.select(
        *[c for c in answers.columns if c != text],
        F.upper(_found(t, r"(?im)^[ \t]*SEVERITY:[ \t]*([A-Z]+)")).alias("severity"),
        _bullets(_section(t, "MITRE TECHNIQUES IDENTIFIED", stops[1:])).alias("techniques"),
        _bullets(_section(t, "REASONING", [stops[0], stops[2]])).alias("reasons"),
        F.nullif(py_strip(_section(t, "RECOMMENDED ACTION", stops[:2])), F.lit("")).alias("action"),
        F.nullif(F.regexp_extract(primary, r"^(\S+)", 1), F.lit("")).alias("primary_id"),
        py_strip(F.nullif(F.regexp_extract(primary, r"^\S+\s+-\s+(.*)$", 1), F.lit("")))
        .alias("primary_name"),
        py_strip(line("CONFIDENCE")).alias("confidence"),
        py_strip(line("REASON")).alias("reason"),
        py_strip(line(r"SECONDARY TECHNIQUE(?: \(if applicable\))?")).alias("secondary"),
    )


def text_severity(text: Column | str) -> Column:
    """Severity in the first line that says SEVERITY:, the heaviest one named there."""
    lines = F.split(F.upper(F.coalesce(col(text), F.lit(""))), "\n")
    line = F.coalesce(
        F.get(F.filter(lines, lambda x: x.contains("SEVERITY:")), F.lit(0)), F.lit("")
    )
    out = F
    for name in SEVERITIES:
        out = out.when(line.contains(name), F.lit(name))
    return out.otherwise(F.lit("UNKNOWN"))


def step_parts(steps: DataFrame, reply: str = "reply") -> DataFrame:
    """Add ``action``, ``action_input`` (both null unless both are found) and ``thought``."""
    r = F.coalesce(reply, F.lit(""))
    found = steps.select(
        "*", F.regexp_extract(r, ACTION, 1).alias("_action"),
        F.regexp_extract(r, ACTION_INPUT, 1).alias("_input"),
        F.regexp_extract(r, THOUGHT, 1).alias("_thought"),
    )
    both = (F.length("_action") > 0) & (F.length("_input") > 0)
    bare = py_strip(F.btrim(py_strip("_input"), F.lit("\"'")))
    return found.select(
        *steps.columns,
        F.when(both, F.col("_action")).alias("action"),
        F.when(both, bare).alias("action_input"),
        F.when(F.length("_thought") > 0, py_strip("_thought"))
        .otherwise(F.lit("Investigating...")).alias("thought"),
    )


def tool_usage(steps: DataFrame) -> DataFrame:
    """Calls per tool: ``tool, status, n``; unreadable steps and unknown tools are told apart."""
    name = F.lower(F.trim("action"))
    status = F.when(name.isNull(), "unreadable").when(name.isin(*TOOLS), "known").otherwise("unknown")
    return step_parts(steps).groupBy(name.alias("tool"), status.alias("status")).agg(
        F.count("*").alias("n")
    )


def saved_classification(rows: DataFrame) -> DataFrame:
    """``alert_id, severity, reasoning, mitre_tactics`` as stored; a tactics list is joined."""
    dtype = rows.schema["mitre_tactics"].dataType.typeName()
    tactics = F.array_join("mitre_tactics", ", ") if dtype == "array" else F.col("mitre_tactics")
    return rows.select(
        "alert_id",
        F.coalesce(F.nullif("severity", F.lit("")), F.lit("UNKNOWN")).alias("severity"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.coalesce(tactics, F.lit("")).alias("mitre_tactics"),
    )
