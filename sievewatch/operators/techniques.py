"""Attack-technique knowledge from STIX objects (``pos, id, type, name, ...`` rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col, cut, join_or, one_line, py_strip, title_case
from ..plans.joins import broadcast_if_small

# fixed values: names in the bundle and text lengths
ATTACK_SOURCE = "mitre-attack"
TECHNIQUE, GROUP, RELATION, USES = "attack-pattern", "intrusion-set", "relationship", "uses"
DESCRIPTION_LENGTH = 1500
NO_DESCRIPTION = "No description available"
NO_DETECTION = "No detection guidance available"


def active_techniques(objects: DataFrame) -> DataFrame:
    """Techniques that are neither deprecated nor revoked; a missing flag counts as false."""
    no = F.lit(False)
    return objects.where(
        (F.col("type") == TECHNIQUE)
        & ~F.coalesce("x_mitre_deprecated", no)
        & ~F.coalesce("revoked", no)
    )


def technique_id(refs: Column | str = "external_references") -> Column:
    """External id of the first reference of the technique catalogue, null if there is none."""
    own = F.filter(col(refs), lambda r: r["source_name"] == ATTACK_SOURCE)
    return F.get(own, F.lit(0))["external_id"]


def tactics(phases: Column | str = "kill_chain_phases") -> Column:
    """Tactic names in feed order, 'initial-access' shown as 'Initial Access'."""
    own = F.filter(col(phases), lambda p: p["kill_chain_name"] == ATTACK_SOURCE)
    name = lambda p: title_case(
        F.replace(F.coalesce(p["phase_name"], F.lit("unknown")), F.lit("-"), F.lit(" "))
    )
    return F.coalesce(F.transform(own, name), F.array().cast("array<string>"))


def platforms(n: int | None = None) -> Column:
    c = F.col("x_mitre_platforms")
    return F.slice(c, 1, n) if n else c


def data_sources(n: int) -> Column:
    return F.slice("x_mitre_data_sources", 1, n)


def strip_links(text: Column | str) -> Column:
    """Markdown links reduced to their text."""
    return F.regexp_replace(col(text), r"\[([^\]]+)\]\([^)]+\)", "$1")


def with_parts(objects: DataFrame) -> DataFrame:
    """Evaluate the technique id and the tactics once; documents and metadata build on these."""
    return objects.select(
        "*", technique_id().alias("technique_id"), tactics().alias("tactic_names")
    )


def technique_document() -> Column:
    """Rich document text over the columns of ``with_parts``."""
    description = cut(
        strip_links(F.coalesce("description", F.lit(NO_DESCRIPTION))), DESCRIPTION_LENGTH
    )
    return py_strip(F.concat(
        F.lit("MITRE ATT&CK Technique: "), F.coalesce("technique_id", F.lit("UNKNOWN")),
        F.lit(" — "), F.coalesce("name", F.lit("Unknown")),
        F.lit("\n\nTactics: "), join_or("tactic_names", "Unknown"),
        F.lit("\nPlatforms: "), join_or(platforms(), "Unknown"),
        F.lit("\n\nDescription:\n"), description,
        F.lit("\n\nDetection Data Sources: "), join_or(data_sources(5), "Not specified"),
        F.lit("\n"),
    ))


def technique_document_plain() -> Column:
    """Plain document text: description and detection guidance."""
    return F.concat(
        technique_id(), F.lit(" - "), F.coalesce("name", F.lit("Unknown")),
        F.lit("\n\nDescription: "), F.coalesce("description", F.lit(NO_DESCRIPTION)),
        F.lit("\n\nDetection: "), F.coalesce("x_mitre_detection", F.lit(NO_DETECTION)),
        F.lit("\n"),
    )


def plain_techniques(objects: DataFrame) -> DataFrame:
    return active_techniques(objects).where(F.length(technique_id()) > 0).select(
        technique_id().alias("id"), F.coalesce("name", F.lit("Unknown")).alias("name"),
        technique_document_plain().alias("text"),
    )


def object_index(objects: DataFrame) -> DataFrame:
    """One row per id, the last definition wins: ``id, type, name``.

    The aggregate keeps one candidate per id in every map task, so a much-repeated id is
    reduced before the shuffle.
    """
    last = F.max(F.struct("pos", "type", "name")).alias("last")
    return objects.groupBy("id").agg(last).select("id", "last.pos", "last.type", "last.name")


def edge_ends(objects: DataFrame) -> DataFrame:
    """Index of the objects that can be an end of a ``uses`` edge.

    Only rows of group or technique ids are indexed, so the relationships, most of a large graph,
    are not shuffled. A later definition with another type still counts.
    """
    fields = ["id", "pos", "type", "name"]
    is_end = F.coalesce(F.col("type").isin(GROUP, TECHNIQUE), F.lit(False))
    ends = objects.where(is_end).select(*fields)
    redefined = objects.where(~is_end).select(*fields).join(
        ends.select("id").distinct(), "id", "left_semi"
    )
    return object_index(ends.unionByName(redefined))


def group_edges(objects: DataFrame) -> DataFrame:
    """``uses`` edges from groups to techniques: ``stix_id, pos, group_name``.

    ``pos`` gives the bundle order of the groups of a technique. The map stays in row form, so
    a technique used by very many groups is not gathered into one value.
    """
    edges = objects.where((F.col("type") == RELATION) & (F.col("relationship_type") == USES)).select(
        "pos", "source_ref", "target_ref"
    )
    # names and ids only: one count decides for both sides of the edges
    index = broadcast_if_small(edge_ends(objects))
    groups = index.where(F.col("type") == GROUP).select(
        F.col("id").alias("source_ref"),
        F.coalesce("name", F.lit("Unknown Group")).alias("group_name"),
    )
    targets = index.where(F.col("type") == TECHNIQUE).select(F.col("id").alias("target_ref"))
    return (
        edges.join(groups, "source_ref").join(targets, "target_ref")
        .select(F.col("target_ref").alias("stix_id"), "pos", "group_name")
    )


def group_count(edges: DataFrame) -> DataFrame:
    return edges.agg(F.countDistinct("group_name").alias("n_groups"))


def techniques_of_group(edges: DataFrame, techniques: DataFrame, group_name: str) -> DataFrame:
    """Techniques a named group uses."""
    used = edges.where(F.col("group_name") == group_name).select("stix_id").distinct()
    return techniques.join(used, techniques["id"] == used["stix_id"], "left_semi")


def first_groups(edges: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` groups of each technique in bundle order, joined to one text.

    The rank filter runs before the shuffle as well, so at most ``n`` rows per technique and
    task are moved and at most ``n`` names are gathered.
    """
    order = Window.partitionBy("stix_id").orderBy("pos", "group_name")
    top = edges.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)
    names = F.transform(F.array_sort(F.collect_list(F.struct("rn", "group_name"))),
                        lambda s: s["group_name"])
    return top.groupBy("stix_id").agg(F.array_join(names, ", ").alias("threat_groups"))


def technique_rows(objects: DataFrame) -> DataFrame:
    """Knowledge rows of the active techniques: document text and flat metadata."""
    base = with_parts(active_techniques(objects)).where("technique_id <> 'UNKNOWN'")
    rows = base.select(
        F.col("id").alias("stix_id"),
        F.col("technique_id").alias("id"),
        F.coalesce("name", F.lit("Unknown")).alias("name"),
        technique_document().alias("text"),
        join_or("tactic_names", "unknown").alias("tactics"),
        join_or(platforms(5), "unknown").alias("platforms"),
        F.col("technique_id").contains(".").alias("is_subtechnique"),
        join_or(data_sources(3), "").alias("detection"),
    )
    return (
        rows.join(first_groups(group_edges(objects)), "stix_id", "left")
        .withColumn("threat_groups", F.coalesce("threat_groups", F.lit("none")))
        .withColumn("source", F.lit("MITRE ATT&CK"))
    )


def first_techniques(objects: DataFrame, n: int = 10) -> DataFrame:
    """The first techniques of a bundle with a short one-line description."""
    return (
        objects.where(F.col("type") == TECHNIQUE).orderBy("pos").limit(n)
        .select(
            "pos", F.coalesce(technique_id(), F.lit("N/A")).alias("technique_id"),
            F.coalesce("name", F.lit("Unknown")).alias("name"),
            F.concat(one_line(cut(F.coalesce("description", F.lit("")), 200)), F.lit("..."))
            .alias("summary"),
        )
    )
