"""Scans, sinks and incremental ingest over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import fixed, text
from quern.plans.checks.registry import Check
from quern.plans.tables import derive, plain, shared, table
from quern.sources import csv_tables, incremental, json_docs, profile, sketches
from quern.sources.tables import fresh_path
from quern.streaming import batches
from quern.streaming.ingest import process_new_files

TALK = """
SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 THEN 'n/a' WHEN conv_id % 7 = 1 THEN '' ELSE role END AS role, text
FROM {conversations}
"""
PADDED = """
SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN NULL WHEN 1 THEN ' nan ' WHEN 2 THEN concat(chr(10), ' ', chr(9))
  ELSE concat('  ', text, chr(10)) END AS text FROM {documents}
"""
SUPPLIERS = """
SELECT s_suppkey, CASE WHEN s_suppkey % 17 = 0 THEN concat('{{"name": "', s_name)
  ELSE concat('{{"name": "', s_name, '", "keys": [', CAST(s_nationkey AS STRING), ']}}') END AS value FROM {supplier}
"""
UNKEYED = """
SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('own-', CAST(event_id AS STRING)) END AS recipe_id,
  concat('dir/part/', CAST(event_id AS STRING), '.json') AS file_name FROM {events}
"""
LISTS = """
SELECT p_partkey, version * 1000000000 + p_partkey AS ord,
  CASE WHEN p_size % 8 = 0 THEN '["cut' WHEN p_size % 8 = 1 THEN NULL
       ELSE concat('["', p_name, '","', p_type, CAST(version AS STRING), '"]') END AS items
FROM (SELECT *, 0 AS version FROM {part} UNION ALL SELECT *, 1 AS version FROM {part} WHERE p_size % 3 = 0)
"""
# Documents arrive, every tenth one twice; those with a label are stored already.
INCOMING = """
SELECT doc_id AS id, concat(lang, ' ', source) AS title, source AS image,
  CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE concat('http://', source, '/', CAST(doc_id AS STRING)) END AS sourceUrl
FROM (SELECT * FROM {documents} UNION ALL SELECT * FROM {documents} WHERE doc_id % 10 = 0)
"""
LOG = """
SELECT event_id, CASE event_type WHEN 'error' THEN NULL ELSE CAST(150 + (event_id % 6) * 50 AS INT) END AS status FROM {events}
"""
GAPS = """
SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey END AS o_custkey, o_orderstatus, o_totalprice,
  o_orderdate, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM {orders}
"""


def s01_csv_scan(spark, sf_dir):
    """The given rows are written as CSV, with texts that span lines, and scanned back."""
    path = fresh_path(spark, "talk")
    csv_tables.write_csv(derive(spark, sf_dir, TALK), path)
    return csv_tables.read_csv(spark, path, "conv_id bigint, turn bigint, role string, text string")


def s01_csv_lines(spark, sf_dir):
    """Without cells that span lines, files can be split."""
    path = fresh_path(spark, "orders-csv")
    csv_tables.write_csv(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    return csv_tables.read_csv(spark, path, "o_orderkey bigint, o_orderstatus string, o_orderpriority string", multi_line=False)


def s02_required_columns(spark, sf_dir):
    checked = csv_tables.require_columns(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return checked.groupBy("lang").agg(F.count("doc_id").alias("n"))


def s03_documents(spark, sf_dir):
    found = csv_tables.text_documents(derive(spark, sf_dir, PADDED), "doc_id", "text")
    return found.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("digest"))


def supplier_files(spark, sf_dir):
    def write():
        path = fresh_path(spark, "supplier-files")
        derive(spark, sf_dir, SUPPLIERS).write.partitionBy("s_suppkey").text(path)
        return path

    return json_docs.read_documents(spark, shared(spark, sf_dir, "supplier-files", write), "*.txt")


def s04_json_files(spark, sf_dir):
    documents = supplier_files(spark, sf_dir)
    key = F.regexp_extract("file_path", r"s_suppkey=(\d+)", 1).cast("bigint")
    return documents.select(
        key.alias("s_suppkey"), "loaded", F.try_variant_get("doc", "$.name", "string").alias("name"),
        F.try_variant_get("doc", "$.keys[0]", "bigint").alias("nation"),
    )


def s04_load_summary(spark, sf_dir):
    return json_docs.load_summary(supplier_files(spark, sf_dir))


def s05_record_keys(spark, sf_dir):
    return json_docs.with_key(derive(spark, sf_dir, UNKEYED))


def s06_nested_sink(spark, sf_dir):
    path = fresh_path(spark, "nested")
    nested = table(spark, sf_dir, "part").select(
        "p_partkey", F.struct("p_name", F.split("p_name", " ").alias("words"), F.lit(None).cast("string").alias("note")).alias("p")
    )
    json_docs.write_records(nested, path)
    back = spark.read.schema(nested.schema).json(path)
    return back.select("p_partkey", "p.p_name", F.array_join("p.words", "|").alias("words"), "p.note")


def s07_flat_sink(spark, sf_dir):
    path = fresh_path(spark, "flat")
    flat = table(spark, sf_dir, "customer")
    csv_tables.write_csv(flat, path, rows_per_file=500)
    return csv_tables.read_csv(spark, path, flat.schema)


def s08_keyed_lists(spark, sf_dir):
    path = fresh_path(spark, "keyed")
    json_docs.write_keyed_lists(derive(spark, sf_dir, LISTS), "p_partkey", "items", "ord", path)
    back = spark.read.schema("p_partkey bigint, items array<string>").json(path)
    return back.select("p_partkey", F.array_join("items", "|").alias("items"))


def stored(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("recipe_id"))


def s09_new_rows(spark, sf_dir):
    listing = incremental.listing_rows(derive(spark, sf_dir, INCOMING))
    fresh = incremental.new_rows(listing, stored(spark, sf_dir), "recipe_id")
    return fresh.groupBy("recipe_id", "title", "image", "calories", "instructions").agg(F.count(F.lit(1)).alias("n"))


def s09_append(spark, sf_dir):
    """Append to a stored listing, then again: the second run finds only in-batch repeats stored."""
    path = fresh_path(spark, "listing")
    incoming = derive(spark, sf_dir, INCOMING)
    schema = incremental.listing_rows(incoming).schema
    incremental.append_new(incoming, stored(spark, sf_dir), path)
    incremental.append_new(incoming, spark.read.schema(schema).parquet(path).unionByName(stored(spark, sf_dir), allowMissingColumns=True), path)
    return profile.table_counts(spark.read.schema(schema).parquet(path), "recipe_id")


def streamed(spark, rows, work):
    """Rows written as files, taken in as a stream whose second run finds nothing new; the target folder."""
    source, target, marks = (fresh_path(spark, name) for name in ("stream-in", "stream-target", "stream-marks"))
    rows.write.parquet(source)
    for _ in range(2):
        batches.run(spark, source, rows.schema, target, marks, work)
    return target


def s09_stream(spark, sf_dir):
    """The same append from a stream."""
    listing = incremental.listing_rows(derive(spark, sf_dir, INCOMING))
    target = streamed(spark, listing, batches.unseen("recipe_id", stored(spark, sf_dir)))
    found = batches.committed(spark, target)
    return found.groupBy("recipe_id", "title", "image", "calories", "instructions").agg(F.count(F.lit(1)).alias("n"))


def work(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")


def s10_to_do(spark, sf_dir):
    return incremental.to_do(*work(spark, sf_dir), "doc_id")


def s10_plan_counts(spark, sf_dir):
    return incremental.plan_counts(*work(spark, sf_dir), "doc_id")


def s10_new_files(spark, sf_dir):
    """The document files go through a checkpointed run; a second run finds nothing new."""
    target, marks = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-marks")
    schema = table(spark, sf_dir, "documents").schema

    def count_words(df):
        return df.select("doc_id", F.size(text.word_tokens(F.col("text"))).cast("bigint").alias("n_words"))

    for _ in range(2):
        process_new_files(spark, f"{sf_dir}/documents*.parquet", schema, count_words, target, marks)
    return spark.read.parquet(target)


def s11_outcomes(spark, sf_dir):
    return incremental.outcome_counts(derive(spark, sf_dir, LOG))


def s11_stream(spark, sf_dir):
    return batches.tallied(spark, streamed(spark, derive(spark, sf_dir, LOG), batches.tallies()))


def s12_sketched(spark, sf_dir):
    """Counts of the parts of a table, merged: rows exactly, keys within five standard errors."""
    gaps = derive(spark, sf_dir, GAPS)
    parts = sketches.sketch_columns(gaps, ["o_custkey"], F.pmod(F.col("o_orderkey"), F.lit(7)))
    merged = sketches.estimates(sketches.merge(parts))
    exact = gaps.agg(F.count_distinct("o_custkey").alias("n_keys"))
    near = F.abs(F.col("n_distinct") - F.col("n_keys")) <= 5 * sketches.STANDARD_ERROR * F.col("n_keys")
    return merged.withColumn("one", F.lit(1)).join(exact.withColumn("one", F.lit(1)), "one").select("n_rows", "n_missing", "n_keys", near.alias("near"))


def s12_counts(spark, sf_dir):
    return profile.table_counts(derive(spark, sf_dir, GAPS), "o_custkey")


def s13_profile(spark, sf_dir):
    return profile.profile(derive(spark, sf_dir, GAPS), "o_custkey")


def sql(statement: str) -> str:
    return plain(statement).replace("AS STRING", "AS VARCHAR")


DTYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": None, "o_orderpriority": "string",
}
PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS column_name, '{dtype or 'timestamp_ntz'}' AS dtype, count(*) AS n_rows, "
    f"count(*) FILTER ({name} IS NULL) AS n_nulls, count(DISTINCT o_custkey) AS n_keys FROM gaps"
    for name, dtype in DTYPES.items()
)
LAST_LISTS = f"""SELECT p_partkey, CASE WHEN items IS NULL OR items = '["cut' THEN ''
    ELSE replace(replace(replace(items, '["', ''), '"]', ''), '","', '|') END AS items
  FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY ord DESC) AS nth FROM ({sql(LISTS)})) WHERE nth = 1"""
NA_LIST = ", ".join(f"'{token}'" for token in fixed.NA_TOKENS)

CHECKS = {
    "s01_csv_scan": Check(s01_csv_scan, f"""
        SELECT conv_id, turn, CASE WHEN role NOT IN ({NA_LIST}) THEN role END AS role,
          CASE WHEN text NOT IN ({NA_LIST}) THEN text END AS text FROM ({sql(TALK)})"""),
    "s01_csv_lines": Check(s01_csv_lines, "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders"),
    "s02_required_columns": Check(s02_required_columns, "SELECT lang, count(*) AS n FROM documents GROUP BY lang"),
    "s03_documents": Check(s03_documents, f"""
        SELECT doc_id, length(t) AS n_chars, md5(t) AS digest
        FROM (SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM ({sql(PADDED)}))
        WHERE t <> '' AND t <> 'nan'"""),
    "s04_json_files": Check(s04_json_files, """
        SELECT s_suppkey, s_suppkey % 17 <> 0 AS loaded, CASE WHEN s_suppkey % 17 <> 0 THEN s_name END AS name,
          CASE WHEN s_suppkey % 17 <> 0 THEN CAST(s_nationkey AS BIGINT) END AS nation FROM supplier"""),
    "s04_load_summary": Check(s04_load_summary, """
        SELECT count(*) AS total, count(*) FILTER (s_suppkey % 17 <> 0) AS loaded, count(*) FILTER (s_suppkey % 17 = 0) AS failed
        FROM supplier"""),
    "s05_record_keys": Check(s05_record_keys, """
        SELECT CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS VARCHAR) ELSE concat('own-', event_id) END AS recipe_id,
          concat('dir/part/', event_id, '.json') AS file_name FROM events"""),
    "s06_nested_sink": Check(s06_nested_sink, """
        SELECT p_partkey, p_name, replace(p_name, ' ', '|') AS words, CAST(NULL AS VARCHAR) AS note FROM part"""),
    "s07_flat_sink": Check(s07_flat_sink, "SELECT * FROM customer"),
    "s08_keyed_lists": Check(s08_keyed_lists, LAST_LISTS),
    "s09_new_rows": Check(s09_new_rows, f"""
        SELECT id AS recipe_id, title, image, '' AS calories,
          coalesce(nullif(sourceUrl, ''), 'No instructions provided') AS instructions, count(*) AS n
        FROM ({sql(INCOMING)}) WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL"""),
    "s09_append": Check(s09_append, f"""
        SELECT count(*) AS n_rows, count(DISTINCT id) AS n_keys FROM ({sql(INCOMING)})
        WHERE id NOT IN (SELECT doc_id FROM labels)"""),
    "s10_to_do": Check(s10_to_do, "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"),
    "s10_plan_counts": Check(s10_plan_counts, """
        SELECT count(*) AS total, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels)) AS skipped,
          count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM labels)) AS to_do FROM documents"""),
    "s10_new_files": Check(s10_new_files, r"""
        SELECT doc_id, CAST(len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS BIGINT) AS n_words FROM documents"""),
    "s11_outcomes": Check(s11_outcomes, """
        SELECT CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 6 IN (1, 2) THEN 'saved' ELSE 'not_found' END AS outcome,
          count(*) AS n FROM events GROUP BY ALL"""),
    "s12_sketched": Check(s12_sketched, f"""
        SELECT count(*) AS n_rows, count(*) - count(o_custkey) AS n_missing, count(DISTINCT o_custkey) AS n_keys, true AS near FROM ({sql(GAPS)})"""),
    "s12_counts": Check(s12_counts, f"SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM ({sql(GAPS)})"),
    "s13_profile": Check(s13_profile, f"WITH gaps AS ({sql(GAPS)}) {PROFILE_SQL}"),
}
CHECKS |= {"s09_stream": Check(s09_stream, CHECKS["s09_new_rows"].sql), "s11_stream": Check(s11_stream, CHECKS["s11_outcomes"].sql)}
