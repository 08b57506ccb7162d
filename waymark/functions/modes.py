"""Labels of transport modes, as lookups in literal maps."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

#: Labels of the mode codes.
MODE_LABELS = {0: "Walk", 1: "Bike", 2: "Bus", 3: "Car", 4: "Train", 8: "Taxi"}


def _entries(labels: Mapping) -> Column:
    """The labels as an array of (code as text, label)."""
    rows = [F.struct(F.lit(str(code)).alias("code"), F.lit(label).alias("label")) for code, label in labels.items()]
    return F.array(*rows) if rows else F.array().cast("array<struct<code:string,label:string>>")


def mode_label(code: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Label of a code: an override, the default, or ``mode N``; null stays null."""
    text = code.cast("string")
    found = [F.try_element_at(F.map_from_entries(_entries(labels)), text) for labels in (overrides, MODE_LABELS) if labels]
    return F.coalesce(*found, F.concat(F.lit("mode "), text))


def mode_code(label: Column, overrides: Mapping[str, str] | None = None) -> Column:
    """Code of a label, whatever its case; null if unknown.

    Of codes with the same label a default one comes first, then overrides in
    their order; override codes that are no whole numbers have none.
    """
    known = F.concat(_entries(MODE_LABELS), _entries(overrides or {}))
    numbered = F.transform(known, lambda e: F.struct(F.lower(e["label"]).alias("label"), e["code"].try_cast("int").alias("code")))
    hits = F.filter(numbered, lambda e: (e["label"] == F.lower(label)) & e["code"].isNotNull())
    return F.get(hits, 0)["code"]
