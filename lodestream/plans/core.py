"""Queries of the general corpus operators (problems 1 and 3)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.operators import hierarchy, units
from lodestream.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated quantities of edges and table cells in common units."""
    return units.found_quantities(table(spark, sf_dir, "graph_edge"), table(spark, sf_dir, "table_record"), table(spark, sf_dir, "quantity_unit"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roots and depths of all nodes of the taxonomies, circles reported."""
    found = hierarchy.depths(hierarchy.kind_links(table(spark, sf_dir, "graph_edge")))
    return found.select(F.col("grp").alias("paper_id"), "node", "root", "depth")


def p3_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path, depth, root and all descendants of every node of the taxonomies."""
    found = hierarchy.hierarchies(hierarchy.kind_links(table(spark, sf_dir, "graph_edge")))
    return found.withColumnRenamed("grp", "paper_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p3_found, p3_hierarchy)}


_LINKS = r"""
    letters AS (SELECT paper_id, regexp_replace(lower(relation), '[^a-z]', '', 'g') AS rel,
        trim(lower(regexp_replace(source, '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g'))) AS s, trim(lower(regexp_replace(target, '[\s\p{Z}\x1c-\x1f\x{85}]+', ' ', 'g'))) AS t FROM graph_edge),
    links AS (SELECT DISTINCT paper_id, CASE WHEN rel IN ('parentof', 'superclassof', 'hassubclass') THEN t ELSE s END AS child, CASE WHEN rel IN ('parentof', 'superclassof', 'hassubclass') THEN s ELSE t END AS parent
        FROM letters WHERE rel IN ('isa', 'subclassof', 'rdfssubclassof', 'kindof', 'parentof', 'superclassof', 'hassubclass') AND paper_id IS NOT NULL AND s <> '' AND t <> '')"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": f"""
            WITH RECURSIVE {_LINKS},
            nodes AS (SELECT paper_id, child AS node FROM links UNION SELECT paper_id, parent FROM links),
            up AS (SELECT paper_id, child AS node, parent AS above FROM links UNION SELECT up.paper_id, up.node, links.parent FROM up JOIN links ON links.paper_id = up.paper_id AND links.child = up.above),
            circular AS (SELECT DISTINCT paper_id, node FROM up WHERE node = above),
            bad AS (SELECT paper_id, node FROM circular UNION SELECT up.paper_id, up.node FROM up JOIN circular c ON c.paper_id = up.paper_id AND c.node = up.above),
            tops AS (SELECT paper_id, node FROM nodes ANTI JOIN links ON links.paper_id = nodes.paper_id AND links.child = nodes.node),
            walk AS (SELECT paper_id, node, node AS root, 0 AS depth FROM tops
                UNION SELECT l.paper_id, l.child, w.root, w.depth + 1 FROM walk w JOIN links l ON l.paper_id = w.paper_id AND l.parent = w.node ANTI JOIN bad b ON b.paper_id = l.paper_id AND b.node = l.child)
            SELECT paper_id, node, root, CAST(min(depth) AS BIGINT) AS depth FROM walk GROUP BY ALL
            UNION ALL SELECT paper_id, node, '' AS root, CAST(-1 AS BIGINT) AS depth FROM bad""",
    }
