"""Queries on plain texts, references of examples and recorded pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestream.operators import plaintext, terms
from lodestream.plans.reference_sql import SCORES
from lodestream.plans.registry import Registry
from lodestream.session import table
from lodestream.sources import readers, sinks

query = Registry()

_LINES = "regexp_split_to_array(coalesce(content, ''), '\\r\\n|\\r|\\n')"


@query(f"""WITH l AS (SELECT section_id, list_filter({_LINES}, lambda x: length(x) <> 1 AND NOT starts_with(lower(x), 'footnote')) AS l FROM section_record),
    k AS (SELECT section_id, list_filter(l, lambda x: len(list_filter(l, lambda y: y = x)) <= 3 OR trim(x) = '') AS l FROM l) SELECT section_id, regexp_replace(array_to_string(l, chr(10)), '\\n{{2,}}', chr(10), 'g') AS text FROM k""")
def line_cleanup(spark, d):
    return table(spark, d, "section_record").select("section_id", plaintext.cleaned(F.col("content"), 3).alias("text"))


@query("""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n')) AS line, generate_subscripts(regexp_split_to_array(coalesce(text, ''), '\\r\\n|\\r|\\n'), 1) AS k FROM documents WHERE text IS NOT NULL),
    n AS (SELECT doc_id, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY ALL HAVING count(*) > 2) SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY k) AS text FROM l LEFT JOIN n ON n.doc_id = l.doc_id AND n.line = l.line WHERE n.n IS NULL GROUP BY l.doc_id""")
def repeated_line_removal(spark, d):
    return plaintext.repeated(table(spark, d, "documents").where("text is not null"), "doc_id", "text", 2)


@query()
def plain_sections(spark, d):
    return plaintext.extracted(table(spark, d, "documents"), "doc_id", "text", marked=False).select("doc_id", "section", "first", "last")


@query("SELECT doc_id, nullif(regexp_extract(coalesce(text, ''), '(?i)\\b(10\\.\\d{4,9}/[-._;()/:A-Z0-9]*[A-Z0-9])', 1), '') AS doi, CAST(greatest(1, length(coalesce(text, '')) // 4) AS BIGINT) AS tokens FROM documents")
def dois_in_text(spark, d):
    return table(spark, d, "documents").select("doc_id", plaintext.doi_in(F.col("text")).alias("doi"), plaintext.token_estimate(F.col("text")).alias("tokens"))


@query("""SELECT DISTINCT id, kind FROM (SELECT unnest(coalesce(from_uuids, [])) AS id, 'example' AS kind FROM qa_example UNION ALL SELECT unnest(list_concat(coalesce(anchor_pdf, []), coalesce(reference_pdf, []))), 'paper' FROM qa_example)""")
def example_references(spark, d):
    return readers.used_ids(table(spark, d, "qa_example"))


@query("SELECT uuid FROM qa_example WHERE list_contains(tags, 'objective')")
def tagged_examples(spark, d):
    return readers.tagged(table(spark, d, "qa_example"), "objective")


@query("SELECT uuid, arg_max(answer, qa_id) AS answer FROM qa_example WHERE answer IS NOT NULL AND trim(uuid) <> '' GROUP BY uuid")
def last_answers(spark, d):
    return readers.last_answers(table(spark, d, "qa_example").withColumn("ord", F.col("qa_id")))


@query(SCORES + " SELECT qa_id, score FROM scores JOIN qa_example USING (qa_id) WHERE uuid NOT IN (SELECT u FROM (SELECT unnest(from_uuids) AS u FROM qa_example) WHERE u IS NOT NULL)")
def scored_dataset(spark, d):
    from lodestream.operators import evaluation

    q = table(spark, d, "qa_example")
    used = readers.used_ids(q).where("kind = 'example'").select(F.col("id").alias("uuid"))
    return evaluation.scored(sinks.without(q, used, "uuid")).select("qa_id", "score")


@query("SELECT entity_type, CASE WHEN n <= 0 THEN 0 ELSE CAST(greatest(1, least(n, greatest(2, round_even(n * 0.25, 0)))) AS INTEGER) END AS target FROM (SELECT entity_type, count(*) AS n FROM canon_entity GROUP BY 1)")
def category_targets(spark, d):
    counts = table(spark, d, "canon_entity").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.select("entity_type", terms.target_count(F.col("n"), ratio=0.25, least=2).alias("target"))


@query("""WITH r AS (SELECT entity_type, canon_id, canon_name, canon_id % 3 = 0 AS curated, lower(canon_name) IN ('magnetite', 'coercivity', 'x-ray diffraction') AS p FROM canon_entity),
    k AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY p DESC, canon_id) AS k, greatest(5, sum(CASE WHEN p THEN 1 ELSE 0 END) OVER (PARTITION BY entity_type)) AS m FROM r WHERE curated OR p) SELECT entity_type, canon_id FROM k WHERE k <= m""")
def category_protection(spark, d):
    c = table(spark, d, "canon_entity").select("entity_type", F.col("canon_id").alias("ord"), F.col("canon_name").alias("category"), (F.col("canon_id") % 3 == 0).alias("curated"))
    return terms.protected(c, ["entity_type"], ["magnetite", "Coercivity", "X-ray diffraction"], 5).select("entity_type", F.col("ord").alias("canon_id"))


@query("""WITH s AS (SELECT entity_type, canon_id, canon_name, unnest(CASE WHEN len(coalesce(synonyms, [])) > 0 THEN synonyms ELSE [NULL] END) AS sub, row_number() OVER () AS o FROM canon_entity),
    n AS (SELECT entity_type, canon_id, canon_name, list(sub ORDER BY o) FILTER (sub IS NOT NULL) AS subs FROM s GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY canon_id) AS k FROM n)
    SELECT entity_type, string_agg('Main Category ' || k || ': ' || canon_name || chr(10) || chr(10) || coalesce(array_to_string(list_transform(subs, lambda x, i: '    Subcategory ' || i || ': ' || x), chr(10)), ''), chr(10) || chr(10) ORDER BY k) AS text FROM b GROUP BY entity_type""")
def category_text(spark, d):
    c = table(spark, d, "canon_entity")
    pairs = c.select("entity_type", "canon_id", F.col("canon_name").alias("category"), F.posexplode_outer("synonyms").alias("k", "subcategory"))
    return terms.category_text(pairs.withColumn("ord", F.col("canon_id") * 1000 + F.coalesce("k", F.lit(0))), ["entity_type"])


@query("""WITH f AS (SELECT record_id, list_transform(coalesce(columns, []), lambda c, i: CASE WHEN trim(coalesce(c, '')) = '' THEN 'Column ' || i ELSE trim(c) END) AS f FROM table_record)
    SELECT record_id, array_to_string(list_transform(f, lambda c, i: CASE WHEN len(list_filter(f[1:i - 1], lambda p: p = c)) > 0 THEN c || ' ' || (len(list_filter(f[1:i - 1], lambda p: p = c)) + 1) ELSE c END), '|') AS names FROM f""")
def unique_columns(spark, d):
    from lodestream.operators import documents

    t = table(spark, d, "table_record")
    return t.select("record_id", F.array_join(documents.unique_names(F.coalesce("columns", F.array().cast("array<string>"))), "|").alias("names"))
