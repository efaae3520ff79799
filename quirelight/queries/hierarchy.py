"""Problem 4: full hierarchies of zones."""

from __future__ import annotations

from quirelight.operators import hierarchy as H
from quirelight.runtime import table

QUERIES = {
    "p4_found": lambda s, d: H.level_errors(table(s, d, "zones")),
    "p4_hierarchy": lambda s, d: H.zone_hierarchy(table(s, d, "zones")).select("zone_id", "root_id", "depth", "ring"),
    "p4_paths": lambda s, d: H.zone_paths(table(s, d, "zones")),
    "p4_descendants": lambda s, d: H.zone_descendants(table(s, d, "zones")),
}

_NODES = """
WITH RECURSIVE cur AS (
  SELECT zone_id, lower(trim(zone_id)) AS id, nullif(lower(trim(parent_id)), '') AS parent, level
  FROM zones WHERE zone_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY zone_id ORDER BY saved_at DESC) = 1
),
n AS (
  SELECT c.zone_id, c.id, c.level, p.id AS parent
  FROM cur c LEFT JOIN cur p ON c.parent = p.id
),
down AS (
  SELECT zone_id, id, level, zone_id AS root_id, 0 AS depth, [id] AS path FROM n WHERE parent IS NULL
  UNION ALL
  SELECT n.zone_id, n.id, n.level, d.root_id, d.depth + 1, list_append(d.path, n.id) FROM n JOIN down d ON n.parent = d.id
),
loose AS (SELECT * FROM n WHERE zone_id NOT IN (SELECT zone_id FROM down)),
up AS (
  SELECT zone_id, id, parent FROM loose
  UNION
  SELECT u.zone_id, u.id, l.parent FROM up u JOIN loose l ON u.parent = l.id
),
ring AS (
  SELECT u.zone_id, min(l.zone_id) AS ring
  FROM up u JOIN loose l ON u.parent = l.id
  WHERE l.id IN (SELECT id FROM up WHERE id = parent)
  GROUP BY u.zone_id
),
h AS (
  SELECT zone_id, level, root_id, depth, CAST(NULL AS VARCHAR) AS ring, path FROM down
  UNION ALL
  SELECT l.zone_id, l.level, r.ring, -1, r.ring, NULL FROM loose l JOIN ring r USING (zone_id)
)
"""

SQL = {
    "p4_found": _NODES + "SELECT zone_id, root_id, depth FROM h WHERE depth = -1 OR level IS NULL OR level <> depth",
    "p4_hierarchy": _NODES + "SELECT zone_id, root_id, depth, ring FROM h",
    "p4_paths": _NODES + "SELECT zone_id, root_id, depth, path FROM h",
    "p4_descendants": _NODES + "SELECT a AS zone_id, zone_id AS descendant_id, depth - k + 1 AS distance FROM (SELECT zone_id, depth, unnest(path) AS a, generate_subscripts(path, 1) AS k FROM h) WHERE k <= depth",
}
