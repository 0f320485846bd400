"""Queries of the general data-processing problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.hierarchy import descendants, hierarchy
from tessera.operators.packed import explode_packed
from tessera.storage import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(concept_id, pos, related): the values packed in ``concepts.related_concepts``."""
    rows = read_table(spark, sf_dir, "concepts").select("concept_id", "related_concepts").where("concept_id is not null").distinct()
    return explode_packed(rows, "related_concepts", "related").select("concept_id", "pos", "related")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tradition_id, root_id, depth) of every tradition; -1 on a loop, -2 below one."""
    tree = hierarchy(read_table(spark, sf_dir, "traditions"), "tradition_id", "parent")
    return tree.select(F.col("node").alias("tradition_id"), F.col("root").alias("root_id"), "depth")


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ancestor, descendant, distance) over the whole table."""
    return descendants(hierarchy(read_table(spark, sf_dir, "traditions"), "tradition_id", "parent"))


QUERIES = {"p3_found": p3_found, "p7_found": p7_found, "p7_descendants": p7_descendants}

_BLANK = r'[\s\x{a0}\x{3000}]'
_SEPARATORS = r';,|、，；｜\t\n\r'


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"


# One item with the separator after it: a quoted span that is all of it, or anything up to there.
_ITEM = rf'''{_BLANK}*("(?:[^"\\]|""|\\(?s:.))*"|“[^”]*”|(?:\\[{_SEPARATORS}/"\\]|[^{_SEPARATORS}])*?){_BLANK}*(?:[{_SEPARATORS}]|{_BLANK}/{_BLANK})'''
PACKED_SQL = rf"""WITH c AS (SELECT DISTINCT concept_id, {_stripped('related_concepts')} AS s FROM concepts WHERE related_concepts IS NOT NULL AND concept_id IS NOT NULL),
b AS (SELECT *, s LIKE '[%]' AS bracketed, CASE WHEN s LIKE '[%]' AND json_valid(s) THEN json_transform(s, '["VARCHAR"]') END AS listed FROM c WHERE s <> ''),
i AS (SELECT concept_id, listed, regexp_extract_all(CASE WHEN bracketed THEN s[2:-2] ELSE s END || ';', '{_ITEM}', 1) AS items FROM b),
u AS (SELECT concept_id, list_filter(CASE WHEN listed IS NOT NULL THEN list_transform(listed, lambda x: {_stripped('x')}) ELSE list_transform(list_transform(items, lambda x: {_stripped('x')}), lambda x: {_stripped(rf'''CASE WHEN x LIKE '"%"' AND length(x) > 1 THEN regexp_replace(replace(x[2:-2], '""', '"'), '(?s)\\(.)', '\1', 'g') WHEN x LIKE '“%”' THEN x[2:-2] ELSE regexp_replace(x, '\\([{_SEPARATORS}/"\\])', '\1', 'g') END''')}) END, lambda x: x <> '') AS v FROM i)
SELECT concept_id, generate_subscripts(v, 1)::INT AS pos, unnest(v) AS related FROM u"""

_P7_LINKS = """
WITH RECURSIVE n AS (SELECT DISTINCT tradition_id AS node, regexp_replace(lower(regexp_replace(parent, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')), '[^\\p{L}\\p{M}\\p{N}]+', '_', 'g') AS k FROM traditions),
names AS (SELECT regexp_replace(lower(regexp_replace(node, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')), '[^\\p{L}\\p{M}\\p{N}]+', '_', 'g') AS k, min(node) AS parent FROM n GROUP BY 1),
l AS (SELECT n.node, min(names.parent) AS parent FROM n LEFT JOIN names ON n.k = names.k AND n.k <> '' GROUP BY 1),
down AS (SELECT node, node AS root, 0 AS depth FROM l WHERE parent IS NULL
  UNION ALL SELECT l.node, down.root, down.depth + 1 FROM l JOIN down ON l.parent = down.node)
"""

ORACLES = {
    "p3_found": PACKED_SQL,
    "p7_found": _P7_LINKS
    + """, rest AS (SELECT node, parent FROM l WHERE node NOT IN (SELECT node FROM down)),
up AS (SELECT node, parent AS seen, 1 AS step FROM rest
  UNION SELECT up.node, rest.parent, step + 1 FROM up JOIN rest ON up.seen = rest.node WHERE step < (SELECT count(*) FROM rest)),
cyc AS (SELECT DISTINCT node FROM up WHERE node = seen)
SELECT node AS tradition_id, root AS root_id, depth FROM down
UNION ALL SELECT up.node, min(up.seen), CASE WHEN any_value(up.node) IN (SELECT node FROM cyc) THEN -1 ELSE -2 END
FROM up WHERE up.seen IN (SELECT node FROM cyc) GROUP BY up.node""",
    "p7_descendants": """
WITH RECURSIVE n AS (SELECT DISTINCT tradition_id AS node, regexp_replace(lower(regexp_replace(parent, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')), '[^\\p{L}\\p{M}\\p{N}]+', '_', 'g') AS k FROM traditions),
names AS (SELECT regexp_replace(lower(regexp_replace(node, '^[\\s\\x{a0}\\x{3000}]+|[\\s\\x{a0}\\x{3000}]+$', '', 'g')), '[^\\p{L}\\p{M}\\p{N}]+', '_', 'g') AS k, min(node) AS parent FROM n GROUP BY 1),
l AS (SELECT n.node, min(names.parent) AS parent FROM n LEFT JOIN names ON n.k = names.k AND n.k <> '' GROUP BY 1),
tree AS (SELECT node FROM l WHERE parent IS NULL UNION ALL SELECT l.node FROM l JOIN tree ON l.parent = tree.node),
pairs AS (SELECT l.parent AS ancestor, l.node AS descendant, 1 AS distance FROM l JOIN tree USING (node) WHERE l.parent IS NOT NULL
  UNION ALL SELECT l.parent, pairs.descendant, distance + 1 FROM pairs JOIN l ON l.node = pairs.ancestor WHERE l.parent IS NOT NULL)
SELECT ancestor, descendant, distance FROM pairs""",
}
