"""Names, messages, membership, totals and transfers over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import members as mb
from granary.operators import messages as ms
from granary.operators import scorecard as sc
from granary.operators import transfer as tr
from granary.plans.base import Catalogue, load
from granary.session import shared_dir

C = Catalogue()

_message = "CASE event_id % 5 WHEN 0 THEN 'malformed statement: ' || event_type WHEN 1 THEN 'symbol index ' || event_id || ' beyond table' WHEN 2 THEN 'typed literal 0x' || CASE WHEN event_id % 2 = 0 THEN 'AF' ELSE 'b0' END || ' at 3' WHEN 3 THEN 'builtin escape number 0' || (event_id % 7) || ' unmapped' ELSE ' ' || event_type || ' ' END"


@C.add("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'malformed statement shape' WHEN 1 THEN 'symbol index beyond table' WHEN 2 THEN 'typed literal 0x' || CASE WHEN event_id % 2 = 0 THEN 'af' ELSE 'b0' END WHEN 3 THEN 'builtin escape number ' || (event_id % 7) ELSE event_type END AS id FROM events")
def message_ids(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", ms.schema_id(F.expr(_message)).alias("id"))


@C.add("SELECT conv_id, list_sort(list_distinct(list(CASE turn % 3 WHEN 0 THEN 'malformed statement shape' WHEN 1 THEN 'typed literal 0x0a' END) FILTER (WHERE turn % 3 < 2 AND role <> 'system' AND length(text) % 2 = 1))) AS blockers FROM conversations GROUP BY conv_id")
def section_blockers(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    failure = F.when(F.col("turn") % 3 == 0, "malformed statement: x").when(F.col("turn") % 3 == 1, "typed literal 0x0A")
    s = F.struct("turn", F.when(F.length("text") % 2 == 0, F.col("text")).alias("text"), (F.col("role") == "system").alias("sentinel"), failure.alias("failure"))
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(s)).alias("s"))
    return g.select("conv_id", F.array_sort(ms.blockers(F.col("s"))).alias("blockers"))


C.sql["section_blockers"] = "SELECT conv_id, coalesce(blockers, []) AS blockers FROM (" + C.sql["section_blockers"] + ")"


@C.add("SELECT o_orderkey, CASE WHEN v BETWEEN 0 AND 255 THEN 'int8' WHEN v BETWEEN -32767 AND 32767 THEN 'int16' ELSE 'int32' END AS kind, length(v::VARCHAR)::INTEGER AS width FROM (SELECT o_orderkey, o_orderkey * 7 - 30000 AS v FROM orders)")
def integer_literals(spark, sf_dir):
    return load(spark, sf_dir, "orders").select("o_orderkey", ms.integer_code(F.col("o_orderkey") * 7 - 30000).alias("c")).select("o_orderkey", "c.kind", "c.width")


@C.add("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size WHEN 2 THEN 1 ELSE 2 END::INTEGER AS lo, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN p_size ELSE 26 END::INTEGER AS hi FROM part")
def arity_specs(spark, sf_dir):
    spec = F.expr("CASE p_partkey % 4 WHEN 0 THEN '?' WHEN 1 THEN cast(p_size AS string) WHEN 2 THEN '1-26' ELSE 'M2-26' END")
    return load(spark, sf_dir, "part").select("p_partkey", ms.arity(spec).alias("a")).select("p_partkey", "a.lo", "a.hi")


@C.add("SELECT n_nationkey, 's' || lpad((row_number() OVER (ORDER BY n_name))::VARCHAR, 4, '0') AS label FROM nation")
def numbered_corpus(spark, sf_dir):
    return ms.numbered(load(spark, sf_dir, "nation"), "n_name").select("n_nationkey", "label")


@C.add("SELECT event_id AS offset, CASE WHEN event_id % 10 = 1 THEN 'lost' WHEN event_id % 10 = 2 THEN 'altered' ELSE 'stranger' END AS change FROM events WHERE event_id % 10 IN (1, 3) OR event_id % 10 = 2 AND NOT (500 < event_id + 1 AND event_id < 600)")
def damage_ledger(spark, sf_dir):
    e = load(spark, sf_dir, "events").select(F.col("event_id").alias("offset"), F.lit(1).alias("declared"), F.col("event_type").alias("stream"))
    after = e.where("offset % 10 <> 1").withColumn("stream", F.when(F.col("offset") % 10 == 2, F.concat("stream", F.lit("!"))).otherwise(F.col("stream")))
    return ms.ledger(e.where("offset % 10 <> 3"), after, 500, 600)


_ext = "CASE page_id % 4 WHEN 0 THEN 'dir/P' || page_id || '.SCX' WHEN 1 THEN 'P' || (page_id - 1) || '.sct' WHEN 2 THEN 'a b' || page_id || '.fxp' ELSE 'q' || page_id || '.vcx' END"


@C.add("SELECT 'dir/P' || page_id || '.SCX' AS table, 'P' || page_id || '.sct' AS memo FROM pages WHERE page_id % 4 = 0 AND page_id + 1 IN (SELECT page_id FROM pages)")
def side_file_pairs(spark, sf_dir):
    return mb.side_files(load(spark, sf_dir, "pages").select(F.expr(_ext).alias("name")))


C.sql["side_file_pairs"] = C.sql["side_file_pairs"].replace("AS table,", 'AS "table",')


@C.add("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'P' || page_id || '.SCX' WHEN 1 THEN 'P' || (page_id - 1) || '.sct' WHEN 2 THEN 'a b' || page_id || '.prg' ELSE 'q' || page_id || '.vcx' END AS landed, CASE page_id % 4 WHEN 0 THEN 'P' || page_id || '.SCX' WHEN 1 THEN 'P' || (page_id - 1) || '.sct' WHEN 2 THEN 'a_b' || page_id || '.fxp' ELSE 'q' || page_id || '.vcx' END AS safe, CASE page_id % 4 WHEN 2 THEN 'fxp' WHEN 1 THEN NULL ELSE 'table' END AS format FROM pages")
def output_names(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", F.expr(_ext).alias("name"), F.encode("html", "utf-8").alias("content"))
    kind = F.when(F.col("page_id") % 4 == 2, "compiled_without_module_magic").otherwise("text")
    return p.select("page_id", mb.output_name(F.col("name"), kind).alias("landed"), mb.safe_name(F.col("name")).alias("safe"), mb.input_format(F.col("name"), F.col("content")).alias("format"))


@C.add("SELECT p_partkey, 'F' || p_partkey || '.TXT' AS filename FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 3 = 0)")
def missing_members(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    want = p.where("p_size > 25").select("p_partkey", F.concat(F.lit("F"), F.col("p_partkey").cast("string"), F.lit(".TXT")).alias("filename"))
    have = p.where("p_partkey % 3 = 0").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string"), F.lit(".txt")).alias("filename"))
    return mb.missing_members(want, have)


@C.add("SELECT cast(sum(size) AS bigint) AS modules, cast(sum(size) AS bigint) AS lifted, false AS verified FROM (SELECT p_size AS size FROM part)")
def directory_totals(spark, sf_dir):
    rows = load(spark, sf_dir, "part").select(F.col("p_size").alias("modules"), F.col("p_size").alias("lifted"), F.when(F.col("p_partkey") == 7, "gone").alias("miss"))
    return mb.directory_totals(rows)


@C.add("SELECT lang AS axis, count(*) AS pairs, count(*) FILTER (WHERE quality = 1) AS good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def structural_summary(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return sc.axis_aggregate(d, {"lang": sc.axis_values(F.col("lang"))}, {"good": F.col("quality") == 1}).select(F.col("value").alias("axis"), F.col("records").alias("pairs"), "good")


@C.add("SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 3 = 0) AS hits, count(*) FILTER (WHERE doc_id % 3 <> 0) AS misses FROM documents")
def cache_receipt(spark, sf_dir):
    from granary.operators import cache

    keyed = cache.with_key(load(spark, sf_dir, "documents").select("doc_id", "text"), "v1", "public", "default", F.col("doc_id").cast("string"), F.col("text"))
    stored = keyed.where("doc_id % 3 = 0").select("key", F.lit("public").alias("identity"), F.lit(1).alias("length"), F.lit(b"a").alias("payload"), F.lit(None).cast("string").alias("error"))
    return cache.receipt(keyed, stored, "public")


@C.add("SELECT p_partkey, p_name, p_size FROM part UNION ALL SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40")
def copy_append_roundtrip(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    path = shared_dir(spark, "copy")
    tr.copy_to(p, path, "csv")
    return tr.append_file(p, path, "csv", F.col("p_size") > 40)


@C.add("SELECT p_partkey, try_cast(p_brand AS INTEGER) AS p_brand, NULL::VARCHAR AS note FROM part")
def alter_table(spark, sf_dir):
    return tr.alter(load(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), {"note": "string"}, {"p_brand": "int"}, ["p_size"])


@C.add("SELECT r_regionkey, r_name FROM region")
def xml_roundtrip(spark, sf_dir):
    return tr.from_xml_rows(tr.to_xml_rows(load(spark, sf_dir, "region")), "r_regionkey int, r_name string")


@C.add("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def json_rows(spark, sf_dir):
    return tr.to_json_rows(load(spark, sf_dir, "region"))


@C.add("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 0 THEN 'delete' ELSE 'update' END AS action FROM supplier WHERE s_suppkey % 10 = 0 OR s_suppkey % 10 = 1 UNION ALL SELECT s_suppkey + 1000000, 'insert' FROM supplier WHERE s_suppkey % 10 = 2")
def updategram(spark, sf_dir):
    s = load(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    kept = s.where("s_suppkey % 10 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 10 == 1, "changed").otherwise(F.col("s_name")))
    return tr.updategram(s, kept.unionByName(s.where("s_suppkey % 10 = 2").withColumn("s_suppkey", F.col("s_suppkey") + 1000000)), "s_suppkey")


_fails = {0: None, 1: "lift: no such thing", 2: "0 non-empty sections", 3: "record not found", 4: "unparsed: x"}
_fail = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _fails.items() if v) + " END"


@C.add(f"""
WITH r AS (SELECT doc_id % 5 = 0 AS canonical, {_fail} AS fail, n_chars AS s, n_chars - doc_id % 2 AS d, doc_id % 2 AS m FROM documents),
     b AS (SELECT CASE WHEN canonical THEN 'canonical_pass' WHEN fail LIKE '0 non-empty%' THEN 'no_code_sections' WHEN fail LIKE 'lift%' THEN 'lift_unsupported' WHEN fail LIKE 'unparsed%' THEN 'unparsed' ELSE 'record_not_found' END AS bucket, count(*) AS n FROM r GROUP BY 1)
SELECT count(*) AS sampled, count(*) FILTER (WHERE canonical) AS compiled_clean, count(*) FILTER (WHERE canonical) AS canonical_pass, 100.0::DOUBLE * count(*) FILTER (WHERE canonical) / count(*) AS canonical_pct, cast(sum(s) AS bigint) AS statements,
 100.0::DOUBLE * sum(d) / sum(s) AS decoded_pct, 100.0::DOUBLE * (sum(d) - sum(m)) / (sum(s) - sum(m)) AS decoded_strict_pct, cast(sum(m) AS bigint) AS macro_verbatim, (SELECT string_agg(bucket || '=' || n, ',' ORDER BY bucket) FROM b) AS buckets FROM r""")
def run_summary(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    odd = F.col("doc_id") % 2
    out = sc.run_summary(d, F.col("doc_id") % 5 == 0, F.col("doc_id") % 5 == 0, F.expr(_fail), F.col("n_chars"), F.col("n_chars") - odd, odd)
    return out.withColumn("buckets", F.array_join(F.transform(F.map_entries("buckets"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ","))


@C.add(f"SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'record_not_found' WHEN d.doc_id % 2 = 0 THEN CASE WHEN toxic = 1 THEN 'lift_unsupported' ELSE 'lifted_vmfree' END ELSE 'other_record_failure' END AS bucket FROM documents d LEFT JOIN labels l USING (doc_id)")
def pair_lookup(spark, sf_dir):
    """Documents as the sample, labels as the rows: what has no label stays, as a failure."""
    found = sc.pair_lookup(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), "doc_id")
    unit = F.when((F.col("doc_id") % 2 == 0) & F.col("fail").isNull(), "method").otherwise("record_failure")
    blockers = F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return found.select("doc_id", sc.row_bucket(unit, blockers, F.col("fail")).alias("bucket"))


@C.add("SELECT 'lang' AS field, lang AS value, count(*) AS n, (SELECT count(*) FROM documents) AS pairs FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*), (SELECT count(*) FROM documents) FROM documents GROUP BY source")
def exclusion_summary(spark, sf_dir):
    return sc.exclusion_summary(load(spark, sf_dir, "documents"), "lang", "source")


@C.add("WITH b AS (SELECT lang AS kind, source, max((n_chars > 3000)::INT) AS f FROM documents WHERE lang IN ('en', 'de') GROUP BY 1, 2) SELECT k AS kind, cast(coalesce(sum(f), 0) AS bigint) AS fully, count(b.kind) AS in_part, 25::BIGINT AS denominator, 100.0::DOUBLE * coalesce(sum(f), 0) / 25 AS fully_pct, 100.0::DOUBLE * count(b.kind) / 25 AS in_part_pct FROM (VALUES ('en'), ('de'), ('xx')) v(k) LEFT JOIN b ON k = b.kind GROUP BY k")
def coverage_summary(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select(F.col("lang").alias("kind"), "source", F.when(F.col("n_chars") > 3000, "full").otherwise("partial").alias("status"))
    return sc.coverage_summary(d, "source", "status", {"en": 25, "de": 25, "xx": 25})
