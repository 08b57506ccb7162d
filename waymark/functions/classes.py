"""Classes of places and speeds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Word patterns of the place classes, in order of precedence.
POI_RULES = (
    ("station|rail|train|metro|subway|bus|transport|transit", "transit"),
    ("mall|shop|store|market|retail|department", "shop"),
    ("park|garden|green|forest|playground", "park"),
    ("restaurant|food|ramen|soba|izakaya|cafe|coffee|bar|eatery", "food"),
    ("school|university|college|kindergarten|library", "school"),
    ("hospital|clinic|medical|pharmacy|health", "health"),
    ("hotel|hostel|ryokan|inn", "lodging"),
    ("bank|atm|post|office", "office"),
    ("museum|art|gallery|theatre|theater|zoo|aquarium", "culture"),
    ("fuel|gas|charging", "fuel"),
)
#: Upper edges of the speed classes in km/h.
SPEED_EDGES = (5, 20, 50, 80)


def poi_class(category: Column) -> Column:
    """Class of a place by the first rule that its category's text hits, else ``other``."""
    out = None
    for pattern, name in POI_RULES:
        hit = F.lower(category).rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def speed_class(kmh: Column) -> Column:
    """0 below the first edge, and so on up to 4; null for an unknown speed."""
    out = F.when(kmh.isNull(), F.lit(None).cast("int"))
    for i, edge in enumerate(SPEED_EDGES):
        out = out.when(kmh < edge, i)
    return out.otherwise(len(SPEED_EDGES))
