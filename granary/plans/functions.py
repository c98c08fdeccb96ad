"""The scalar function library over the supplied tables, a family in each query."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions import conditional as cd
from granary.functions import dates as dt
from granary.functions import numeric as nu
from granary.functions import string as st
from granary.plans.base import Catalogue, load

C = Catalogue()


def _dec(c, n=6):
    return F.round(c.cast("decimal(28,10)"), n).cast("double")


def _sdec(x, n=6):
    return f"cast(round(cast({x} AS decimal(28,10)), {n}) AS double)"


@C.add("SELECT p_partkey, ascii(p_name)::INTEGER AS asc_, chr(65 + p_size % 26) AS chr_, upper(p_name) AS upper_, lower(p_type) AS lower_, left(p_name, 3) AS left_, right(p_name, 3) AS right_, substr(p_name, 2, 4) AS substr_, length(p_name)::INTEGER AS len_, repeat(p_brand, 2) AS replicate_, trim('  ' || p_name || ' ') AS alltrim_, ltrim('  ' || p_name || ' ') AS ltrim_, rtrim('  ' || p_name || ' ') AS rtrim_, replace(p_name, 'a', 'AA') AS strtran_, translate(p_name, 'aeiou', '12345') AS chrtran_, left(p_name, 1) || 'XY' || substr(p_name, 4) AS stuff_, 'a' || '   ' AS space_ FROM part")
def fn_string_basic(spark, sf_dir):
    name, typ = F.col("p_name"), F.col("p_type")
    s = F.concat(F.lit("  "), name, F.lit(" "))
    return load(spark, sf_dir, "part").select("p_partkey", st.asc(name).alias("asc_"), st.chr_(65 + F.col("p_size") % 26).alias("chr_"), st.upper(name).alias("upper_"), st.lower(typ).alias("lower_"), st.left(name, 3).alias("left_"), st.right(name, 3).alias("right_"), st.substr(name, 2, 4).alias("substr_"), st.length(name).alias("len_"), st.replicate(F.col("p_brand"), 2).alias("replicate_"), st.alltrim(s).alias("alltrim_"), st.ltrim(s).alias("ltrim_"), st.rtrim(s).alias("rtrim_"), st.strtran(name, "a", "AA").alias("strtran_"), st.chrtran(name, "aeiou", "12345").alias("chrtran_"), st.stuff(name, 2, 2, "XY").alias("stuff_"), F.concat(F.lit("a"), st.space(3)).alias("space_"))


@C.add("SELECT p_partkey, instr(p_name, 'a')::INTEGER AS at_, instr(lower(p_name), 'a')::INTEGER AS atc_, CASE WHEN contains(p_name, 'a') THEN length(p_name) - instr(reverse(p_name), 'a') + 1 ELSE 0 END::INTEGER AS rat_, (length(p_name) - length(replace(p_name, 'a', '')))::INTEGER AS occurs_, p_name LIKE '%a_e%' AS like_, regexp_matches(p_name, '^[A-Za-z]') AS isalpha_, regexp_matches(p_brand, '^[0-9]') AS isdigit_, regexp_matches(p_name, '^[A-Z]') AS isupper_, regexp_matches(p_name, '^[a-z]') AS islower_ FROM part")
def fn_string_search(spark, sf_dir):
    name = F.col("p_name")
    return load(spark, sf_dir, "part").select("p_partkey", st.at("a", name).alias("at_"), st.atc("A", name).alias("atc_"), st.rat("a", name).cast("int").alias("rat_"), st.occurs("a", name).alias("occurs_"), st.like("*a?e*", name).alias("like_"), st.isalpha(name).alias("isalpha_"), st.isdigit(F.col("p_brand")).alias("isdigit_"), st.isupper(name).alias("isupper_"), st.islower(name).alias("islower_"))


@C.add("SELECT p_partkey, lpad(p_brand, 12, '*') AS padl_, rpad(p_brand, 12, '.') AS padr_, rpad(repeat(' ', cast(greatest(floor((13 - length(p_brand)) / 2), 0) AS INTEGER)) || p_brand, 13, ' ') AS padc_, len(list_filter(string_split(p_type, ' '), lambda x: x <> ''))::INTEGER AS words_, coalesce(list_filter(string_split(p_type, ' '), lambda x: x <> '')[2], '') AS word2_, lpad(printf('%.2f', p_retailprice), 12, ' ') AS str_, p_size::DOUBLE AS val_, split_part(split_part(p_brand || '#end', '#', 2), '#', 1) AS extract_, hex(p_brand::BLOB) AS conv_ FROM part")
def fn_pad_words(spark, sf_dir):
    brand, typ = F.col("p_brand"), F.col("p_type")
    return load(spark, sf_dir, "part").select("p_partkey", st.padl(brand, 12, "*").alias("padl_"), st.padr(brand, 12, ".").alias("padr_"), st.padc(brand, 13).alias("padc_"), st.getwordcount(typ, " ").alias("words_"), st.getwordnum(typ, 2, " ").alias("word2_"), st.str_(F.col("p_retailprice"), 12, 2).alias("str_"), st.val(F.concat(F.col("p_size").cast("string"), F.lit(" cm"))).alias("val_"), st.strextract(F.concat(brand, F.lit("#end")), "#", "#").alias("extract_"), st.strconv(brand, 15).alias("conv_"))


@C.add("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INTEGER AS lines_, coalesce(string_split(text, chr(10))[1], '') AS line1_, CASE WHEN text IS NULL THEN NULL WHEN contains(text, 'a') THEN list_position(list_transform(string_split(text, chr(10)), lambda x: contains(x, 'a')), true) ELSE 0 END::INTEGER AS atline_ FROM documents")
def fn_lines(spark, sf_dir):
    t = F.col("text")
    return load(spark, sf_dir, "documents").select("doc_id", st.memlines(t).alias("lines_"), st.mline(t, 1).alias("line1_"), st.atline("a", t).alias("atline_"))


@C.add(f"SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, abs(-l_linenumber) AS abs_, cast(ceil(l_extendedprice) AS bigint) AS ceiling_, cast(floor(l_extendedprice) AS bigint) AS floor_, cast(trunc(-l_extendedprice) AS bigint) AS int_, {_sdec('sqrt(l_linenumber)')} AS sqrt_, {_sdec('ln(l_linenumber)')} AS log_, {_sdec('log10(l_linenumber)')} AS log10_, {_sdec('exp(l_discount)')} AS exp_, {_sdec('sin(l_linenumber)')} AS sin_, {_sdec('atan2(l_linenumber, 2)')} AS atn2_, {_sdec('radians(l_linenumber)')} AS dtor_, sign(l_discount - 0.05)::DOUBLE AS sign_, greatest(l_linenumber, 3) AS max_, least(l_linenumber, 3) AS min_, cast(round(cast(l_extendedprice AS decimal(28,10)), 1) AS double) AS round_, (CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_linenumber % 3 - 3 END)::BIGINT AS mod_ FROM lineitem")
def fn_math(spark, sf_dir):
    x, y = F.col("l_extendedprice"), F.col("l_linenumber")
    return load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", nu.abs_(-y).alias("abs_"), nu.ceiling(x).alias("ceiling_"), nu.floor(x).alias("floor_"), nu.int_(-x).alias("int_"), _dec(nu.sqrt(y)).alias("sqrt_"), _dec(nu.log(y.cast("double"))).alias("log_"), _dec(nu.log10(y.cast("double"))).alias("log10_"), _dec(nu.exp("l_discount")).alias("exp_"), _dec(nu.sin(y)).alias("sin_"), _dec(nu.atn2(y, F.lit(2))).alias("atn2_"), _dec(nu.dtor(y)).alias("dtor_"), nu.sign(F.col("l_discount") - 0.05).alias("sign_"), nu.max_(y, F.lit(3)).alias("max_"), nu.min_(y, F.lit(3)).alias("min_"), nu.round_(x, 1).cast("double").alias("round_"), nu.mod(y, -3).cast("long").alias("mod_"))


@C.add("SELECT o_orderkey, o_custkey & 12 AS and_, o_custkey | 12 AS or_, xor(o_custkey, 12) AS xor_, ~o_custkey AS not_, o_custkey << 2 AS left_, o_custkey >> 1 AS right_, (o_custkey >> 3) & 1 = 1 AS test_, o_custkey | 16 AS set_, o_custkey & ~16 AS clear_, 1 + 256 * 2 + 65536 * 3 AS rgb_ FROM orders")
def fn_bits(spark, sf_dir):
    k = F.col("o_custkey")
    return load(spark, sf_dir, "orders").select("o_orderkey", nu.bitand(k, 12).alias("and_"), nu.bitor(k, 12).alias("or_"), nu.bitxor(k, 12).alias("xor_"), nu.bitnot(k).alias("not_"), nu.bitlshift(k, 2).alias("left_"), nu.bitrshift(k, 1).alias("right_"), nu.bittest(k, 3).alias("test_"), nu.bitset(k, 4).alias("set_"), nu.bitclear(k, 4).alias("clear_"), nu.rgb(1, 2, 3).alias("rgb_"))


@C.add(f"SELECT o_orderkey, {_sdec('o_totalprice * (1 - power(1.01, -12)) / 0.01', 2)} AS pv_, {_sdec('o_totalprice * (power(1.01, 12) - 1) / 0.01', 2)} AS fv_, {_sdec('o_totalprice * 0.01 / (1 - power(1.01, -12))', 2)} AS payment_ FROM orders")
def fn_financial(spark, sf_dir):
    p = F.col("o_totalprice")
    return load(spark, sf_dir, "orders").select("o_orderkey", _dec(nu.pv(p, 0.01, 12), 2).alias("pv_"), _dec(nu.fv(p, 0.01, 12), 2).alias("fv_"), _dec(nu.payment(p, 0.01, 12), 2).alias("payment_"))


@C.add("SELECT o_orderkey, year(o_orderdate)::INTEGER AS year_, month(o_orderdate)::INTEGER AS month_, day(o_orderdate)::INTEGER AS day_, quarter(o_orderdate)::INTEGER AS quarter_, (((month(o_orderdate) + 8) % 12) // 3 + 1)::INTEGER AS fiscal_, weekofyear(o_orderdate)::INTEGER AS week_, (dayofweek(o_orderdate) + 1)::INTEGER AS dow_, ((dayofweek(o_orderdate) + 6) % 7 + 1)::INTEGER AS dow_monday, dayname(o_orderdate) AS cdow_, monthname(o_orderdate) AS cmonth_, strftime(o_orderdate, '%Y%m%d') AS dtos_, strftime(o_orderdate, '%m/%d/%Y') AS dtoc_, strftime(o_orderdate, '%d %B %Y') AS dmy_, strftime(o_orderdate, '%B %d, %Y') AS mdy_, cast(cast(o_orderdate AS date) + INTERVAL 1 MONTH AS date) AS gomonth_, cast(o_orderdate AS date) AS ttod_, cast(strptime(strftime(o_orderdate, '%m/%d/%Y'), '%m/%d/%Y') AS date) AS ctod_ FROM orders")
def fn_date(spark, sf_dir):
    d = F.col("o_orderdate")
    return load(spark, sf_dir, "orders").select("o_orderkey", dt.year(d).alias("year_"), dt.month(d).alias("month_"), dt.day(d).alias("day_"), dt.quarter(d).alias("quarter_"), dt.quarter(d, 4).alias("fiscal_"), dt.week(d).alias("week_"), dt.dow(d).alias("dow_"), dt.dow(d, 2).alias("dow_monday"), dt.cdow(d).alias("cdow_"), dt.cmonth(d).alias("cmonth_"), dt.dtos(d).alias("dtos_"), dt.dtoc(d).alias("dtoc_"), dt.dmy(d).alias("dmy_"), dt.mdy(d).alias("mdy_"), dt.gomonth(d.cast("date"), 1).alias("gomonth_"), dt.ttod(d).alias("ttod_"), dt.ctod(dt.dtoc(d)).alias("ctod_"))


@C.add("SELECT event_id, hour(ts)::INTEGER AS hour_, minute(ts)::INTEGER AS minute_, second(ts)::INTEGER AS sec_, (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::INTEGER AS seconds_, strftime(ts, '%m/%d/%Y %H:%M:%S') AS ttoc_ FROM events")
def fn_time(spark, sf_dir):
    t = F.col("ts")
    return load(spark, sf_dir, "events").select("event_id", dt.hour(t).alias("hour_"), dt.minute(t).alias("minute_"), dt.sec(t).alias("sec_"), dt.seconds(t).alias("seconds_"), dt.ttoc(t).alias("ttoc_"))


@C.add("SELECT event_id, CASE WHEN value > 50 THEN 'hi' ELSE 'lo' END AS iif_, CASE WHEN value > 90 THEN 1 WHEN value > 50 THEN 2 ELSE 3 END AS icase_, coalesce(CASE WHEN value > 50 THEN event_type END, 'none') AS nvl_, value <= 50 AS isnull_, trim(CASE WHEN value > 50 THEN event_type ELSE '  ' END) = '' AS empty_, CASE WHEN value > 50 THEN event_type ELSE 'blank' END AS evl_, value BETWEEN 20 AND 40 AS between_, event_type IN ('click', 'view') AS inlist_, try_cast(event_type AS INTEGER) AS cast_, 'C' AS type_text, 'N' AS type_num FROM events")
def fn_null_cond(spark, sf_dir):
    v, k = F.col("value"), F.col("event_type")
    missing, blank = F.when(v > 50, k), F.when(v > 50, k).otherwise("  ")
    return load(spark, sf_dir, "events").select("event_id", cd.iif(v > 50, "hi", "lo").alias("iif_"), cd.icase(v > 90, 1, v > 50, 2, 3).alias("icase_"), cd.nvl(missing, "none").alias("nvl_"), cd.isnull(missing).alias("isnull_"), cd.empty(blank, T.StringType()).alias("empty_"), cd.evl(blank, "blank", T.StringType()).alias("evl_"), cd.between(v, 20, 40).alias("between_"), cd.inlist(k, "click", "view").alias("inlist_"), cd.cast(k, "int").alias("cast_"), cd.vartype(k).alias("type_text"), cd.vartype(v).alias("type_num"))


@C.add("SELECT vec_id, len(embedding)::INTEGER AS alen_, len(e)::INTEGER AS adel_, e[1] AS first_, list_sort(embedding[1:3])[1] AS asort_, 3 AS aelement_, 2 AS row_, 1 AS col_ FROM (SELECT *, embedding[2:] AS e FROM embeddings)")
def fn_array(spark, sf_dir):
    e = F.col("embedding")
    return load(spark, sf_dir, "embeddings").select("vec_id", cd.alen(e).alias("alen_"), cd.alen(cd.adel(e, 1)).alias("adel_"), F.get(cd.adel(e, 1), F.lit(0)).alias("first_"), F.get(cd.asort(F.slice(e, 1, 3)), F.lit(0)).alias("asort_"), cd.aelement(2, 1, 2).alias("aelement_"), cd.asubscript(3, 2, 1).alias("row_"), cd.asubscript(3, 2, 2).alias("col_"))


@C.add("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS fname_, regexp_replace(url, '/?[^/]*$', '') AS path_, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') || '.bak' AS forced_ FROM pages")
def fn_path(spark, sf_dir):
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", cd.justfname(u).alias("fname_"), cd.justpath(u).alias("path_"), cd.forceext(cd.justfname(u), "bak").alias("forced_"))


@C.add()
def fn_code_page(spark, sf_dir):
    from granary.functions import codepages

    d = load(spark, sf_dir, "documents").select("doc_id", F.encode("text", "utf-8").alias("content"))
    return d.select("doc_id", codepages.code_page_of(F.col("content")).alias("code_page"))
