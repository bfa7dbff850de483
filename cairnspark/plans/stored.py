"""Queries on what is stored once: an index of names, and the merged list in the order of a curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairnspark.operators.nameindex import NameIndex
from cairnspark.plans import fixtures as X
from cairnspark.plans.registry import points, query
from cairnspark.sources.placed import PlacedList
from cairnspark.sources.shared import shared_folder

ASKED = "SELECT ' ' || upper(substr(event_type, 2)) || ' ' AS q FROM events UNION SELECT substr(event_type, 1, 2) FROM events UNION SELECT substr(event_type, 1, 1) FROM events UNION SELECT substr(c_name, -4) FROM customer UNION SELECT 'nobody' FROM events"


def asked(s, d):
    e, c = X.table(s, d, "events"), X.table(s, d, "customer")
    kind = F.col("event_type")
    made = [e.select(F.concat(F.lit(" "), F.upper(F.substr(kind, F.lit(2))), F.lit(" ")).alias("q")), e.select(F.substring(kind, 1, 2)), e.select(F.substring(kind, 1, 1)), c.select(F.substring("c_name", -4, 4)), e.select(F.lit("nobody"))]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    return out.distinct()


@query(f"""SELECT q, row_number() OVER (PARTITION BY q ORDER BY lower(name), name, ord) AS rank, name, ord FROM (SELECT DISTINCT q, lower(trim(q)) AS t FROM ({ASKED})) a JOIN wp w ON w.name <> '' AND contains(lower(w.name), a.t) QUALIFY rank <= 8""")
def suggest_many(s, d):
    """Pieces of all event types and the ends of all customers' names, each asked of the index of all points' names."""
    index = NameIndex.build(points(s, d).select("ord", "name"))
    return index.suggest(asked(s, d)).select("q", "rank", "name", "ord")


@query("SELECT ord, name, lat, lon FROM wp WHERE lat BETWEEN -10 AND 25.5 AND (lon >= 170 OR lon <= -150)")
def viewport_stored(s, d):
    """A viewport over the date line on the stored list."""
    return PlacedList(s, shared_folder(s, "placed")).write(points(s, d), 32).viewport(-10, 25.5, 170, -150).select("ord", "name", "lat", "lon")


@query("SELECT ord, name, lat, lon FROM (SELECT ord, name, lat, lon FROM wp WHERE NOT bookmark UNION ALL SELECT -ord, name || '!', lat, lon FROM wp WHERE bookmark) WHERE lat BETWEEN -30 AND 40 AND lon BETWEEN 5 AND 90")
def viewport_changed(s, d):
    """A viewport on the stored list after every bookmark was replaced by another."""
    at = PlacedList(s, shared_folder(s, "placed")).write(points(s, d), 32)
    marked = points(s, d).where("bookmark")
    at.change(marked.withColumn("ord", -F.col("ord")).withColumn("name", F.concat("name", F.lit("!"))), marked)
    return at.viewport(-30, 40, 5, 90).select("ord", "name", "lat", "lon")
