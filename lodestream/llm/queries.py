"""Queries of the llm operators: problem N as pN_..., each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm import bpe, canon, linkage, packing, pairs, reading, scans, splitting
from lodestream.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records of different sources that are one paper."""
    members, links = linkage.match_nodes(table(spark, sf_dir, "candidate_paper"), table(spark, sf_dir, "canon_entity"))
    return linkage.matched_pairs(members, links).select("cand_id_a", "cand_id_b")


def p2_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between distinct records with their confidence; exact copies are one node."""
    _, links = linkage.match_nodes(table(spark, sf_dir, "candidate_paper"), table(spark, sf_dir, "canon_entity"))
    return links.select("a", "b", F.round("confidence", 6).alias("confidence"))


def p2_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The node that stands for each record in p2_links: records of equal canonical fields have one."""
    members, _ = linkage.match_nodes(table(spark, sf_dir, "candidate_paper"), table(spark, sf_dir, "canon_entity"))
    return members.select("cand_id", "node")


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = canon.typed_values(table(spark, sf_dir, "graph_edge"), table(spark, sf_dir, "layout_node"))
    return rows, canon.map_values(rows, table(spark, sf_dir, "canon_entity"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of canon_entity that each typed value means, 0 if none."""
    rows, mapped = _mapped(spark, sf_dir)
    return canon.map_rows(rows, mapped)


def p4_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct typed value with its entry and score."""
    _, mapped = _mapped(spark, sf_dir)
    return mapped.select("value", "canon_id", F.round("score", 6).alias("score"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections over 2,000 characters and the level at which they can be cut."""
    return splitting.oversized(splitting.split_sections(table(spark, sf_dir, "section_record")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces of all sections."""
    return splitting.split_sections(table(spark, sf_dir, "section_record"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective pairs with the first of their defects."""
    return pairs.first_defect(pairs.pair_defects(table(spark, sf_dir, "qa_example")))


def p6_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every triggered defect of every pair."""
    return pairs.pair_defects(table(spark, sf_dir, "qa_example")).select("qa_id", F.explode("defects").alias("defect"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of scan noise in each section."""
    return scans.noise_kinds(scans.find_noise(table(spark, sf_dir, "section_record")))


def p7_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every section as continuous paragraphs."""
    sections = table(spark, sf_dir, "section_record")
    return scans.repair(sections, scans.find_noise(sections))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode_column(table(spark, sf_dir, "documents"))


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(bpe.encode_column(table(spark, sf_dir, "documents"), counts=True, keep=("source",)))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be split because they are larger than a container."""
    return packing.split_items(_placed(spark, sf_dir))


def p9_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document or piece of one."""
    return _placed(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading level of every English document."""
    return reading.reading_levels(table(spark, sf_dir, "documents"), table(spark, sf_dir, "reading_labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (p2_found, p2_links, p2_members, p4_found, p4_values, p5_found, p5_pieces, p6_found, p6_defects, p7_found, p7_repaired, p8_ids, p9_found, p9_placement, p10_found)
    return {f.__name__: f for f in every}




def oracle_sql() -> dict[str, str]:
    """SQL where it can say the same over whole tables: levels and pieces of p5 are exact in SQL."""
    return {
        "p5_found": r"""
            WITH big AS (SELECT section_id, content FROM section_record WHERE length(content) > 2000),
            units AS (
              SELECT section_id,
                list_max(list_transform(regexp_split_to_array(content, '[^\S\n\r]*(\r\n|\n|\r)[^\S\n\r]*(\r\n|\n|\r)\s*'), lambda x: length(x))) AS paragraph,
                list_max(list_transform(string_split(regexp_replace(regexp_replace(content, '([.!?])[\s\x{85}\p{Z}]+', concat('\1', chr(1)), 'g'), '[^\S\n\r]*(\r\n|\n|\r)[^\S\n\r]*(\r\n|\n|\r)\s*', chr(1), 'g'), chr(1)), lambda x: length(x))) AS sentence,
                list_max(list_transform(regexp_split_to_array(content, '[\s\x{85}\p{Z}]+'), lambda x: length(x))) AS word
              FROM big)
            SELECT section_id, CASE WHEN paragraph <= 2000 THEN 'paragraph' WHEN sentence <= 2000 THEN 'sentence' WHEN word <= 2000 THEN 'word' ELSE 'char' END AS cut
            FROM units""",
    }
