"""Scorecards, sequences and ranges over the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.operators import scorecard as sc
from granary.operators import sequence as sq
from granary.plans.base import Catalogue, load

C = Catalogue()

AXES = {"returnflag": "l_returnflag", "priority": "o_orderpriority", "segment": "c_mktsegment", "nation": "n_name"}
JOINED = "lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_arm = """SELECT '{a}' AS axis, {c} AS value, count(*) AS records, count(*) FILTER (WHERE l_discount > 0.05) AS discounted, count(*) FILTER (WHERE l_linestatus = 'F') AS closed,
 sum(cast(l_extendedprice * (1 - l_discount) AS decimal(18,4))) AS price_num, sum(cast(l_extendedprice AS decimal(18,4))) AS price_den FROM {j} GROUP BY {c}"""


@C.add(
    "SELECT axis, value, records, discounted, closed, cast(price_num AS double) AS price_num, cast(price_den AS double) AS price_den, 0::BIGINT AS missing, (SELECT count(*) FROM lineitem) AS total, 100.0::DOUBLE * discounted / records AS discounted_pct FROM ("
    + " UNION ALL ".join(_arm.format(a=a, c=c, j=JOINED) for a, c in AXES.items())
    + ")"
)
def axis_scorecard(spark, sf_dir):
    """The flagship: four axes in one pass over one join."""
    li = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_discount", "l_extendedprice")
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    counters = {"discounted": F.col("l_discount") > 0.05, "closed": F.col("l_linestatus") == "F"}
    deltas = {"price": (F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"))}
    out = sc.axis_aggregate(rows, {a: sc.axis_values(F.col(x)) for a, x in AXES.items()}, counters, deltas)
    out = out.withColumns({c: F.col(c).cast("double") for c in ("price_num", "price_den")})
    return out.withColumn("discounted_pct", sc.rate(F.col("discounted"), F.col("records")))


@C.add("SELECT 'quality' AS axis, v AS value, n AS records, t AS toxic, m AS missing, a AS total FROM (SELECT lang AS v, count(*) AS n, count(*) FILTER (WHERE toxic = 1) AS t, (SELECT count(*) FROM documents d LEFT JOIN labels l USING (doc_id) WHERE d.lang = 'en' OR d.lang = '') AS m, (SELECT count(*) FROM documents) AS a FROM documents LEFT JOIN labels USING (doc_id) WHERE lang <> 'en' GROUP BY lang)")
def axis_missing(spark, sf_dir):
    """English counts as a missing value here; unlabelled documents stay in the denominators."""
    d = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    axis = sc.axis_values(F.when(F.col("lang") == "en", "?").otherwise(F.col("lang")))
    return sc.axis_aggregate(d, {"quality": axis}, {"toxic": F.col("toxic") == 1}).select("axis", "value", "records", "toxic", "missing", "total")


FINDINGS = {"long": "n_chars > 3000", "pipe": "text LIKE '%|%'", "digits": "regexp_like(text, '[0-9]')", "lines": "length(text) - length(replace(text, chr(10), '')) > 10"}


def findings(spark, sf_dir):
    tests = [F.when(F.expr(t), F.lit(k)) for k, t in FINDINGS.items()]
    return load(spark, sf_dir, "documents").select("doc_id", "source", F.array_compact(F.array(*tests)).alias("blockers"))


_found = "(SELECT doc_id, source, list_filter([" + ", ".join(f"CASE WHEN {t.replace('regexp_like(', 'regexp_matches(')} THEN '{k}' END" for k, t in FINDINGS.items()) + "], lambda x: x IS NOT NULL) AS b FROM documents)"


@C.add(f"""
WITH r AS (SELECT doc_id, source, len(b) = 1 AS solo, unnest(b) AS blocker FROM {_found}),
     s AS (SELECT blocker, source, count(*) AS n, count(*) FILTER (WHERE solo) AS solo FROM r GROUP BY 1, 2),
     t AS (SELECT *, row_number() OVER (PARTITION BY blocker ORDER BY n DESC, source) AS rn FROM s)
SELECT blocker, cast(sum(n) AS bigint) AS blocked, cast(sum(solo) AS bigint) AS solo, cast(sum(n) - sum(solo) AS bigint) AS combo, count(*) AS repos, max(source) FILTER (WHERE rn = 1) AS top_repo, max(n) FILTER (WHERE rn = 1) AS top_count FROM t GROUP BY blocker""")
def multilabel_impact_rank(spark, sf_dir):
    return sc.blocker_ranking(findings(spark, sf_dir), "doc_id", "blockers", "source")


@C.add(f"WITH r AS (SELECT doc_id, unnest(b) AS x FROM {_found}) SELECT a.x AS first, b.x AS second, count(*) AS n FROM r a JOIN r b ON a.doc_id = b.doc_id AND a.x < b.x GROUP BY 1, 2 ORDER BY n DESC, first, second LIMIT 8")
def blocker_pair_topk(spark, sf_dir):
    return sc.blocker_pairs(findings(spark, sf_dir), "blockers")


EXCLUDED = ["src1", "src12", "src150x", "src3zz", "src7a", "src7b"]


@C.add(f"""
WITH e AS (SELECT unnest({EXCLUDED}) AS name)
SELECT doc_id, CASE WHEN source IN (SELECT name FROM e) THEN source WHEN source <> '' AND (SELECT count(*) FROM e WHERE starts_with(name, source)) = 1 THEN (SELECT min(name) FROM e WHERE starts_with(name, source)) END AS excluded_by FROM documents""")
def partition_excluded(spark, sf_dir):
    return sc.partition_excluded(load(spark, sf_dir, "documents").select("doc_id", "source"), "source", EXCLUDED).select("doc_id", "excluded_by")


_fail = "CASE event_type WHEN 'click' THEN 'lift: no arm' WHEN 'view' THEN '0 non-empty sections' WHEN 'purchase' THEN 'record not found' WHEN 'signup' THEN NULL ELSE 'timeout: ' || event_type END"


@C.add(f"""
SELECT event_id, CASE WHEN value > 90 THEN 'canonical_pass' WHEN f LIKE '0 non-empty sections%' THEN 'no_code_sections' WHEN f LIKE 'lift%' THEN 'lift_unsupported'
 WHEN f = 'record not found' THEN 'record_not_found' WHEN f IS NOT NULL THEN 'other:' || split_part(f, ':', 1) ELSE 'no_verdict' END AS bucket FROM (SELECT event_id, value, {_fail} AS f FROM events)""")
def outcome_bucket(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "value", F.expr(_fail).alias("fail"))
    return e.select("event_id", sc.outcome_bucket(F.col("value") > 90, F.col("fail")).alias("bucket"))


@C.add("""
WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 'method' ELSE 'failure' END AS unit, role || ':' || (length(text) % 3) AS outcome FROM conversations),
     l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM t)
SELECT conv_id, count(*) FILTER (WHERE unit = 'method') AS methods,
 CASE WHEN max(unit) FILTER (WHERE rn = 1) <> 'method' THEN max(outcome) FILTER (WHERE rn = 1) WHEN count(*) FILTER (WHERE unit = 'method') <> 1 THEN 'method_directory' ELSE min(outcome) FILTER (WHERE unit = 'method') END AS outcome
FROM l GROUP BY conv_id""")
def collapse_records(spark, sf_dir):
    c = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", "method").otherwise("failure").alias("unit"), F.concat("role", F.lit(":"), (F.length("text") % 3).cast("string")).alias("outcome"))
    return sc.collapse_records(c, "conv_id", "turn", "unit", "outcome")


_theirs = "CASE WHEN quality = 1 THEN 'canonical_pass' WHEN toxic = 1 THEN 'method_directory' ELSE 'compile_failed' END"
_mine = "CASE WHEN n_chars > 2000 THEN 'lifted_vmfree' WHEN n_chars > 1000 THEN 'canonical_pass' WHEN n_chars > 500 THEN 'method_directory' ELSE 'unparsed' END"


@C.add(f"""
SELECT doc_id, theirs, mine, CASE WHEN mine = theirs THEN 'agreement' WHEN mine = 'lifted_vmfree' AND theirs IN ('canonical_pass', 'compile_failed', 'canonical_mismatch') THEN 'compatible' WHEN mine = 'method_directory' THEN 'compatible' ELSE 'disagreement' END AS verdict
FROM (SELECT doc_id, {_theirs} AS theirs FROM labels) JOIN (SELECT doc_id, {_mine} AS mine FROM documents) USING (doc_id)""")
def reconcile_runs(spark, sf_dir):
    frozen = load(spark, sf_dir, "labels").select("doc_id", F.expr(_theirs).alias("bucket"), F.lit(1).alias("ord"))
    mine = load(spark, sf_dir, "documents").select("doc_id", F.expr(_mine).alias("bucket"), F.lit(1).alias("ord"))
    return sc.reconcile(frozen, mine, "doc_id", "ord")


@C.add("""
WITH o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 100000), w AS (SELECT DISTINCT o_custkey FROM orders WHERE o_totalprice > 120000),
 so AS (SELECT * FROM o ORDER BY md5(o_custkey::VARCHAR), o_custkey LIMIT 50), sw AS (SELECT * FROM w ORDER BY md5(o_custkey::VARCHAR), o_custkey LIMIT 50)
SELECT old_size, new_size, shared, overlap, old_sample, new_sample, CASE WHEN old_size = new_size AND shared = old_size THEN CASE WHEN overlap = old_sample AND overlap = new_sample THEN 'reproducible' ELSE 'rule drift' END ELSE 'stale' END AS verdict
FROM (SELECT (SELECT count(*) FROM o) AS old_size, (SELECT count(*) FROM w) AS new_size, (SELECT count(*) FROM o JOIN w USING (o_custkey)) AS shared, (SELECT count(*) FROM so JOIN sw USING (o_custkey)) AS overlap, (SELECT count(*) FROM so) AS old_sample, (SELECT count(*) FROM sw) AS new_sample)""")
def sample_drift(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_custkey", "o_totalprice")
    return sc.drift(o.where("o_totalprice > 100000"), o.where("o_totalprice > 120000"), "o_custkey", 50)


def _sections(c):
    """A conversation as sections: one for each turn, its frames the role and length class, its symbols the role."""
    frames = F.when(F.length("text") < 60, F.array().cast("array<string>")).otherwise(F.array(F.col("role"), (F.length("text") % 2).cast("string")))
    s = F.struct("turn", F.struct(frames.alias("frames"), F.array(F.col("role")).alias("symbols")).alias("s"))
    return c.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(s), lambda a, b: a.getField("turn").cast("int") - b.getField("turn").cast("int")), lambda x: x.getField("s")).alias("sections"))


def _neighbours(spark, sf_dir):
    s = _sections(load(spark, sf_dir, "conversations"))
    nxt = s.select((F.col("conv_id") - 1).alias("conv_id"), F.col("sections").alias("others"))
    return s.join(nxt, "conv_id")


@C.add()
def ordered_sequence_match(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("conv_id", sq.ordered_match(F.col("sections"), F.col("others")).alias("matched"))


@C.add("""
WITH t AS (SELECT conv_id, turn, role || (length(text) % 2) AS f FROM conversations WHERE length(text) >= 60),
 l AS (SELECT conv_id, list(f ORDER BY turn) AS fs FROM t GROUP BY 1), a AS (SELECT DISTINCT conv_id FROM conversations)
SELECT a.conv_id, coalesce(x.fs, []) = coalesce(y.fs, []) AS matched FROM a JOIN a b ON b.conv_id = a.conv_id + 1 LEFT JOIN l x ON x.conv_id = a.conv_id LEFT JOIN l y ON y.conv_id = a.conv_id + 1""")
def sequence_bijection(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("conv_id", sq.bijection(F.col("sections"), F.col("others")).alias("matched"))


_pos = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS p, event_type FROM events)"


@C.add(f"""
WITH x AS (SELECT user_id, p, event_type FROM {_pos}), j AS (SELECT a.user_id, a.p, a.event_type AS b, n.event_type AS a FROM x a LEFT JOIN x n ON n.user_id = a.user_id + 1 AND n.p = a.p UNION ALL SELECT n.user_id - 1, n.p, NULL, n.event_type FROM x n WHERE NOT EXISTS (SELECT 1 FROM x a WHERE a.user_id = n.user_id - 1 AND a.p = n.p) AND EXISTS (SELECT 1 FROM x a WHERE a.user_id = n.user_id - 1)),
 k AS (SELECT * FROM j WHERE EXISTS (SELECT 1 FROM x WHERE x.user_id = j.user_id + 1)), d AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS isl FROM k WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b)
SELECT user_id, min(p) AS start, max(p) + 1 AS "end" FROM d GROUP BY user_id, isl UNION ALL SELECT user_id, min(p), max(p) + 1 FROM k WHERE a IS NULL OR b IS NULL GROUP BY user_id""")
def changed_ranges(spark, sf_dir):
    """Each user's event types against the next user's, place by place."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = load(spark, sf_dir, "events").select("user_id", (F.row_number().over(w).cast("long") - 1).alias("p"), "event_type")
    users = x.select("user_id").distinct()
    pairs = users.join(users.select((F.col("user_id") - 1).alias("user_id")), "user_id")
    left = x.join(pairs, "user_id", "left_semi").withColumnRenamed("event_type", "before")
    right = x.select((F.col("user_id") - 1).alias("user_id"), "p", F.col("event_type").alias("after")).join(pairs, "user_id", "left_semi")
    return sq.changed_ranges(left.join(right, ["user_id", "p"], "full"), "user_id", "p", "before", "after")


_ranges = "(SELECT user_id, event_id AS ord, (epoch_us(ts) // 1000000) AS start, (epoch_us(ts) // 1000000) + 20000 + (event_id % 7) * 10000 AS \"end\" FROM events WHERE event_type = 'purchase')"
_points = "(SELECT event_id, user_id, epoch_us(ts) // 1000000 AS at FROM events WHERE event_type = 'click')"


def _range_tables(spark, sf_dir):
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    e = load(spark, sf_dir, "events").withColumn("at", F.floor(at).cast("long"))
    ranges = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("order"), F.col("at").alias("start"), (F.col("at") + 20000 + F.col("event_id") % 7 * 10000).alias("end"))
    return e.where("event_type = 'click'").select("event_id", "user_id", "at"), ranges


@C.add(f'SELECT p.event_id, p.user_id, p.at, min(r.ord) AS owner FROM {_points} p LEFT JOIN {_ranges} r ON p.user_id = r.user_id AND r.start <= p.at AND p.at < r."end" GROUP BY 1, 2, 3')
def range_owner_lookup(spark, sf_dir):
    points, ranges = _range_tables(spark, sf_dir)
    return sq.owner_lookup(points, ranges, "user_id", "at", 50_000)


@C.add(f'SELECT p.event_id FROM {_points} p WHERE NOT EXISTS (SELECT 1 FROM {_ranges} r WHERE p.user_id = r.user_id AND r.start <= p.at AND p.at < r."end")')
def unowned_hits(spark, sf_dir):
    points, ranges = _range_tables(spark, sf_dir)
    return sq.owner_lookup(points, ranges, "user_id", "at", 50_000).where("owner is null").select("event_id")


@C.add("""
WITH v AS (SELECT user_id, ts, max(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY 1, 2), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT c.event_id, c.user_id, c.ts, v.seen FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ts >= v.ts""")
def asof_binding(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return sq.as_of(e.where("event_type = 'click'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("seen")), "user_id", "ts", "seen")


@C.add(f"""
WITH r AS (SELECT *, lag("end") OVER (PARTITION BY user_id ORDER BY ord) AS pe FROM {_ranges})
SELECT user_id, count(*) AS entries, max("end") AS last_end, count(*) FILTER (WHERE start < pe) AS n_overlaps, count(*) FILTER (WHERE start < pe) = 0 AND max("end") >= 1704000000 - 262144 AS accepted FROM r GROUP BY user_id""")
def overlap_validation(spark, sf_dir):
    return sq.accepted(_range_tables(spark, sf_dir)[1], "user_id", "order", "start", "end", 1704000000, 262144)


@C.add("SELECT page_id, (SELECT count(*) FROM unnest(regexp_extract_all(html, '<a |<p>|<h1')) u) AS hits, CASE WHEN regexp_matches(html, '<a |<p>|<h1') THEN CASE WHEN contains(html, '<h1') THEN 'module' ELSE 'empty' END ELSE 'rejected' END AS verdict FROM pages")
def marker_scan_classify(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", "html")
    hits = sq.magic_hits(pages, "html", ["<a ", "<p>", "<h1"]).groupBy("page_id").agg(F.count(F.lit(1)).alias("hits"), F.max((F.col("magic") == "<h1").cast("int")).alias("head"))
    out = pages.select("page_id").join(hits, "page_id", "left")
    verdict = F.when(F.col("hits").isNull(), "rejected").when(F.col("head") == 1, "module").otherwise("empty")
    return out.select("page_id", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), verdict.alias("verdict"))


@C.add("SELECT page_id, CASE WHEN length(html) = 0 THEN 'empty' WHEN substr(html, 1, 2) = 'BM' THEN 'bmp' WHEN substr(html, 1, 1) = '0' THEN 'dbf_header' WHEN regexp_full_match(substr(html, 1, 64), '[\\x20-\\x7E\\t\\n\\r]*') THEN 'text' ELSE 'other' END AS kind FROM pages")
def payload_kind(spark, sf_dir):
    p = load(spark, sf_dir, "pages").select("page_id", "url", F.encode("html", "utf-8").alias("content"))
    return p.select("page_id", sq.payload_kind(F.col("content"), F.lit("page.html")).alias("kind"))


@C.add("SELECT 's_acctbal' AS field, count(*) FILTER (WHERE s_nationkey < 10) AS changes FROM supplier UNION ALL SELECT 's_name', count(*) FILTER (WHERE s_suppkey % 3 = 0) FROM supplier")
def field_change_histogram(spark, sf_dir):
    before = load(spark, sf_dir, "supplier")
    after = before.withColumn("s_acctbal", F.when(F.col("s_nationkey") < 10, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))).withColumn("s_name", F.when(F.col("s_suppkey") % 3 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return sc.field_changes(before, after, "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"])


@C.add("SELECT doc_id, sha256('v1' || chr(10) || 'public' || chr(10) || 'default' || chr(10) || 'doc' || doc_id || chr(10) || sha256(text)) AS key FROM documents WHERE doc_id % 3 <> 0 AND NOT regexp_matches(text, '(?i)#\\s*include|set\\s+procedure')")
def cache_miss_set(spark, sf_dir):
    from granary.operators import cache

    d = load(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = cache.with_key(d, "v1", "public", "default", F.concat(F.lit("doc"), F.col("doc_id").cast("string")), F.col("text"))
    stored = keyed.where("doc_id % 3 = 0").select("key", F.lit("public").alias("identity"), F.lit(5).alias("length"), F.lit(b"abcde").alias("payload"), F.lit(None).cast("string").alias("error"))
    return cache.misses(keyed.where(cache.cacheable(F.col("text"))), stored, "public").select("doc_id", "key")


@C.add("SELECT conv_id, list(role ORDER BY p) AS values FROM (SELECT conv_id, role, min(turn) AS p FROM conversations GROUP BY 1, 2) GROUP BY conv_id")
def first_seen_union(spark, sf_dir):
    return sq.first_seen(load(spark, sf_dir, "conversations"), "conv_id", "turn", "role")


@C.add("SELECT event_id, user_id, ts, coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2030-01-01') AS extent_end FROM events")
def module_extent(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    from pyspark.sql import Window

    return e.withColumn("extent_end", F.coalesce(F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("2030-01-01").cast("timestamp_ntz")))
