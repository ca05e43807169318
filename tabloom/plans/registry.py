"""Queries over the test tables, by name, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.functions import text as tx
from tabloom.operators import dedupe, extract, headers, joins, lines, parts, recon, union
from tabloom.plans import consolidate
from tabloom.sources import sheets
from tabloom.sources.shared import shared_dir

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Shapes that the test texts hold, in a form that both engines' patterns take.
SHAPES = {"email": r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", "phone": r"\d{3}-\d{3}-\d{4}", "ip": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "card": r"(?:^|[^0-9])[0-9]{16}(?:$|[^0-9])"}
#: Pattern of white space for Spark and DuckDB alike.
WS = r"[ \t\r\n\x0b\x0c]+"


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES_SQL = "l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents)"


# Shapes, masks, classes ---------------------------------------------------------------------------------------------


@query(f"""WITH {_LINES_SQL},
h AS (SELECT source, line_no, doc_id, {', '.join(f"len(regexp_extract_all(line, '{p}'))::BIGINT AS {k}" for k, p in SHAPES.items())} FROM l)
SELECT source, count(DISTINCT CASE WHEN {' + '.join(SHAPES)} > 0 THEN doc_id END) AS n_docs, {', '.join(f'sum({k})::BIGINT AS {k}' for k in SHAPES)},
count(*) AS n_lines, sum({' + '.join(SHAPES)})::BIGINT AS n_hits FROM h GROUP BY source""")
def pii_shape_hits_by_source(spark, sf_dir):
    # No shape crosses a line end, so whole texts are counted, one row a document; ^ and $ are ends of lines.
    docs = _t(spark, sf_dir, "documents").filter("text is not null")
    hits = docs.select("source", (F.length("text") - F.length(F.translate("text", "\n", "")) + 1).alias("lines"), *[F.regexp_count("text", F.lit(f"(?m){p}")).cast("long").alias(k) for k, p in SHAPES.items()])
    total = sum((F.col(k) for k in SHAPES), F.lit(0).cast("long"))
    return hits.groupBy("source").agg(F.count_if(total > 0).alias("n_docs"), *[F.sum(k).alias(k) for k in SHAPES], F.sum("lines").cast("long").alias("n_lines"), F.sum(total).alias("n_hits"))


@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[0-9]', '#', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g')) AS masked FROM documents")
def masked_texts(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", F.md5(tx.mask_shape("text")).alias("masked"))


@query(f"""WITH w AS (SELECT source, len(list_filter(string_split_regex(text, '{WS}'), lambda x: x <> '')) AS n FROM documents)
SELECT source, CASE WHEN n = 0 THEN 'No' WHEN n < 5 THEN 'Partial' ELSE 'Yes' END AS class, count(*) AS n_docs FROM w GROUP BY 1, 2""")
def searchability_class(spark, sf_dir):
    words = F.size(F.filter(F.split("text", WS), lambda w: w != ""))
    return _t(spark, sf_dir, "documents").withColumn("n", words).groupBy("source", tx.searchability("n").alias("class")).agg(F.count("*").alias("n_docs"))


@query("SELECT source, count(*) AS total, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic IS NULL) AS unlabelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source")
def file_summary(spark, sf_dir):
    joined = _t(spark, sf_dir, "documents").select("doc_id", "source").join(_t(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.groupBy("source").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic").isNull()).alias("unlabelled"))


@query(r"""WITH n AS (SELECT c_name AS name FROM customer UNION ALL SELECT '  ' || p_name || '_(' || p_brand || ')-x' FROM part UNION ALL SELECT s_name || ' No.1' FROM supplier)
SELECT name, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS a, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS b,
trim(regexp_replace(regexp_replace(lower(name), '[\s_\-]+', ' ', 'g'), '[^\w ]', '', 'g')) AS c, lower(trim(regexp_replace(name, '\s+', ' ', 'g'))) AS d, lower(trim(name)) AS e,
regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS f FROM n""")
def header_key_variants(spark, sf_dir):
    names = _t(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(_t(spark, sf_dir, "part").select(F.concat(F.lit("  "), "p_name", F.lit("_("), "p_brand", F.lit(")-x")))).union(_t(spark, sf_dir, "supplier").select(F.concat("s_name", F.lit(" No.1"))))
    return names.select("name", tx.key_words("name").alias("a"), tx.key_compact("name").alias("b"), tx.key_snake("name").alias("c"), tx.key_squeezed("name").alias("d"), tx.key_trimmed("name").alias("e"), tx.key_flagged("name", True).alias("f"))


#: Headers that no list of spellings holds, with the canonical name that their words give.
_OTHER_HEADERS = [("Payer Name", None), ("Location", None), ("Plan Encounter Date", "Date of Service"), ("DOS (dos)", "Date of Service"), ("Prsn Nmbr", "Person Number"), ("Pts. Nme", "Patient Name"), ("Encntrs Nos", "Encounter Number"), ("Person", None), ("Svc Dte of visit", "Date of Service"), ("dos of the claim", None), ("", None), ("Name of Patient", "Patient Name")]
_CANONICAL = [(x, name) for name, spellings in tx.HEADER_ALIASES.items() for x in (name, *spellings)] + _OTHER_HEADERS


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', {repr(c) if c else 'NULL'})" for h, c in _CANONICAL) + ") v(raw, canonical)")
def canonical_headers(spark, sf_dir):
    return spark.createDataFrame([(h,) for h, _ in _CANONICAL], "raw string").select("raw", tx.canonical_header("raw").alias("canonical"))


# Unions ------------------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, c_nationkey::VARCHAR AS nation, c_mktsegment AS segment, '' AS extra, 'customer' AS "Source" FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR, '', s_suppkey::VARCHAR, 'supplier' FROM supplier""")
def union_by_name(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_name").alias(" Name "), F.col("s_suppkey").alias("KEY"), F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("extra"))
    return union.by_name([c, s], ["customer", "supplier"])


@query("""SELECT c_custkey::VARCHAR AS key, c_name AS name, c_mktsegment AS segment, '' AS "Extra_4" FROM customer
UNION ALL SELECT s_suppkey::VARCHAR, s_name, s_nationkey::VARCHAR, s_name FROM supplier""")
def union_by_position(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("n"), "s_nationkey", F.col("s_name").alias("more"))
    return union.by_position([c, s])


_SCHEMAS = [("Emp ID", 1), ("Name", 2), ("emp  id", 3), ("Amount", 4), ("NAME ", 5), ("Joined", 6), ("amount", 7)]


@query("SELECT * FROM (VALUES ('emp id', 'Emp ID', 1), ('name', 'Name', 2), ('amount', 'Amount', 4), ('joined', 'Joined', 6)) v(key, display, ord)")
def column_union_first_seen(spark, sf_dir):
    return union.column_registry(spark.createDataFrame(_SCHEMAS, "name string, ord int"))


@query("""SELECT '' AS "Missing", n_name AS "N_NAME", n_nationkey::VARCHAR AS n_nationkey FROM nation""")
def realign_to_expected(spark, sf_dir):
    return union.realigned(_t(spark, sf_dir, "nation"), ["N_NAME", "Missing", "n_nationkey"])


# De-duplication ----------------------------------------------------------------------------------------------------


@query(f"""WITH k AS (SELECT doc_id, source, upper(trim(regexp_replace(text, '{WS}', ' ', 'g'))) AS key FROM documents)
SELECT min(doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM k GROUP BY key""")
def dedupe_keep_first(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedupe.keep_first(docs, F.xxhash64(F.upper(F.trim(F.regexp_replace("text", WS, " ")))), ["doc_id"]).select("doc_id", "source")


@query("""WITH k AS (SELECT event_id, event_type, CASE WHEN event_type = 'error' THEN NULL ELSE user_id || '|' || event_type END AS key FROM events)
SELECT event_id, event_type FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY event_id) = 1""")
def dedupe_blank_keys_never_collapse(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "event_type", "user_id")
    key = F.when(F.col("event_type") != "error", F.concat_ws("|", F.col("user_id").cast("string"), "event_type"))
    return dedupe.keep_first(e, key, ["event_id"]).select("event_id", "event_type")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_custkey::VARCHAR END AS ssn, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS name, o_orderstatus AS addr FROM orders),
k AS (SELECT *, CASE WHEN ssn <> '' THEN '0|' || ssn WHEN name <> '' THEN '1|' || name || '|' || addr END AS key FROM o)
SELECT o_orderkey FROM k QUALIFY key IS NULL OR row_number() OVER (PARTITION BY key ORDER BY o_orderkey) = 1""")
def dedupe_key_hierarchy(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "").otherwise(F.col("o_custkey").cast("string")).alias("ssn"), F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("name"), F.col("o_orderstatus").alias("addr"))
    return dedupe.keep_first(o, dedupe.key_ladder(("ssn",), ("name", "addr")), ["o_orderkey"]).select("o_orderkey")


@query("""WITH o AS (SELECT o_custkey::VARCHAR AS name, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS code, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderstatus END AS number, o_orderkey FROM orders),
p AS (SELECT name, code, number, min(o_orderkey) AS ord FROM o WHERE code <> '' OR number <> '' GROUP BY 1, 2, 3)
SELECT name, string_agg(code, ':' ORDER BY ord) AS code, string_agg(number, ':' ORDER BY ord) AS number FROM p GROUP BY name""")
def collapse_ordered_pairs(spark, sf_dir):
    key = F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("name"), F.when(key % 5 != 0, F.col("o_orderpriority")).alias("code"), F.when(key % 3 == 0, " ").otherwise(F.col("o_orderstatus")).alias("number"), "o_orderkey")
    return dedupe.collapse(o, "name", ["code", "number"], ["o_orderkey"])


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) = 1")
def one_row_per_key(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return joins.pick_by_priority(li, ["l_orderkey"], -F.col("l_extendedprice"), ["l_linenumber", "l_partkey", "l_suppkey"]).select("l_orderkey", "l_linenumber", "l_partkey")


# Parts -------------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority || ' <' || o_orderstatus || '>.' AS key, count(*) AS n, o_orderpriority || ' _' || o_orderstatus || '_' AS file_name FROM orders GROUP BY 1, 3""")
def split_by_key(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.concat("o_orderpriority", F.lit(" <"), "o_orderstatus", F.lit(">.")).alias("k"))
    return parts.group_files(o, "k")


@query("SELECT o_orderkey, ((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 + 1)::INT AS part, ceil(count(*) OVER () / 1000.0)::INT AS parts FROM orders")
def part_numbers(spark, sf_dir):
    return parts.fixed_parts(_t(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"], 1000).withColumn("parts", F.col("parts").cast("int"))


@query("""WITH RECURSIVE s AS (SELECT CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE l_suppkey END AS block, count(*) AS rows FROM lineitem GROUP BY 1),
c AS (SELECT block, rows, unnest(range(1, (rows + 4999) // 5000 + 1)) AS chunk FROM s),
o AS (SELECT block, rows, chunk, (chunk - 1) * 5000 AS first, least(rows - (chunk - 1) * 5000, 5000) AS n, row_number() OVER (ORDER BY block, chunk) AS k FROM c),
caps AS (SELECT unnest(range((SELECT max(n) FROM o), 5001)) AS cap),
f AS (SELECT cap, k, n AS load, 1 AS part FROM caps JOIN o ON k = 1
UNION ALL SELECT cap, o.k, CASE WHEN load + n > cap THEN n ELSE load + n END, CASE WHEN load + n > cap THEN part + 1 ELSE part END FROM f JOIN o ON o.k = f.k + 1),
t AS (SELECT cap, max(part) AS parts FROM f GROUP BY cap),
best AS (SELECT min(cap) AS cap FROM t WHERE parts <= (SELECT parts FROM t WHERE cap = 5000))
SELECT block, rows, chunk::INT AS chunk, first, n, part::INT AS part FROM f JOIN best USING (cap) JOIN o USING (k)""")
def part_plan_blocks(spark, sf_dir):
    key = F.when(F.col("l_suppkey") % 7 == 0, 0).otherwise(F.col("l_suppkey")).cast("long")
    blocks = _t(spark, sf_dir, "lineitem").groupBy(key.alias("block")).agg(F.count("*").alias("rows"))
    return parts.whole_blocks(blocks, ["block"], "rows", 5000)


@query("""WITH n AS (SELECT doc_id, n_chars AS pages FROM documents WHERE n_chars > 0), c AS (SELECT doc_id, pages, unnest(range(0, ((pages + 99) // 100)::BIGINT)) AS i FROM n)
SELECT doc_id, (i + 1)::INT AS chunk, i * 100 + 1 AS first, least(i * 100 + 100, pages) AS last FROM c""")
def chunk_plan_fixed(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(parts.page_chunks("n_chars", fixed=100)).alias("c"))
    return d.select("doc_id", F.col("c.chunk").alias("chunk"), F.col("c.first").alias("first"), F.col("c.last").alias("last"))


@query("""WITH n AS (SELECT doc_id, n_chars AS p, greatest(1, least(4, n_chars // 25)) AS k FROM documents WHERE n_chars > 0), c AS (SELECT *, unnest(range(1, k + 1)) AS i FROM n)
SELECT doc_id, i::INT AS chunk, (i - 1) * (p // k) + least(i - 1, p % k) + 1 AS first, i * (p // k) + least(i, p % k) AS last FROM c""")
def chunk_plan_balanced(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", F.explode(parts.page_chunks("n_chars")).alias("c"))
    return d.select("doc_id", F.col("c.chunk").alias("chunk"), F.col("c.first").alias("first"), F.col("c.last").alias("last"))


# Lines, blocks, bands ----------------------------------------------------------------------------------------------


def _words(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + 10).alias("x1"), F.col("l_quantity").alias("top"), (F.col("l_quantity") + 5).alias("bottom"), F.col("l_partkey").cast("string").alias("text"))


_WORDS_SQL = "w AS (SELECT l_orderkey AS page, l_extendedprice AS x0, l_extendedprice + 10 AS x1, l_quantity AS top, l_partkey::VARCHAR AS text FROM lineitem)"


@query(f"WITH {_WORDS_SQL} SELECT page, round_even(top / 3, 0) * 3 AS line_y, count(*) AS n_words, string_agg(text, ' ' ORDER BY x0, text) AS text FROM w GROUP BY 1, 2")
def line_bucket(spark, sf_dir):
    return lines.bucket_lines(_words(spark, sf_dir), ["page"])


@query(f"""WITH RECURSIVE {_WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, x0, text) AS i FROM w),
f AS (SELECT page, i, top, x0, text, 0 AS line_no, top AS anchor FROM o WHERE i = 1
UNION ALL SELECT o.page, o.i, o.top, o.x0, o.text, CASE WHEN o.top - f.anchor > 4 THEN f.line_no + 1 ELSE f.line_no END, CASE WHEN o.top - f.anchor > 4 THEN o.top ELSE f.anchor END FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT page, line_no::INT AS line_no, min(top) AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM f GROUP BY 1, 2""")
def line_anchor_fold(spark, sf_dir):
    return lines.page_lines(_words(spark, sf_dir), ["page"], "anchor", 4.0).select("page", "line_no", "top", "text")


@query(f"""WITH RECURSIVE {_WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, x0, text) AS i FROM w),
f AS (SELECT page, i, top, x0, text, 0 AS line_no, top AS s, 1.0::DOUBLE AS n FROM o WHERE i = 1
UNION ALL SELECT o.page, o.i, o.top, o.x0, o.text, CASE WHEN o.top - s / n > 4 THEN line_no + 1 ELSE line_no END, CASE WHEN o.top - s / n > 4 THEN o.top ELSE s + o.top END, CASE WHEN o.top - s / n > 4 THEN 1.0 ELSE n + 1 END FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT page, line_no::INT AS line_no, min(top) AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM f GROUP BY 1, 2""")
def line_mean_fold(spark, sf_dir):
    return lines.page_lines(_words(spark, sf_dir), ["page"], "mean", 4.0).select("page", "line_no", "top", "text")


@query("""WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 3600000000 THEN 1 ELSE 0 END AS new FROM events),
b AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS block FROM g) SELECT user_id, block::INT AS block, count(*) AS n FROM b GROUP BY 1, 2""")
def blocks_by_gap(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    gap = F.timestamp_diff("MICROSECOND", F.col("prev_ts"), F.col("ts")) > 3_600_000_000
    return lines.blocks_by_gap(e, ["user_id"], ["ts", "event_id"], gap).groupBy("user_id", "block").agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, (sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn, text))::INT AS block FROM conversations")
def blocks_by_marker(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations")
    return lines.blocks_by_marker(c, ["conv_id"], ["turn", "text"], F.col("role") == "user").select("conv_id", "turn", "block")


_BANDS = [("id", 0.0, 20000.0), ("name", 20000.0, 50000.0), ("amount", 50000.0, 80000.0)]


@query("SELECT CASE WHEN l_extendedprice >= 0 AND l_extendedprice < 20000 THEN 'id' WHEN l_extendedprice < 50000 THEN 'name' WHEN l_extendedprice < 80000 THEN 'amount' END AS band, count(*) AS n, sum(l_quantity) AS qty FROM lineitem GROUP BY 1")
def band_join(spark, sf_dir):
    li = _t(spark, sf_dir, "lineitem")
    return li.groupBy(joins.band_of(F.col("l_extendedprice"), _BANDS).alias("band")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT (SELECT arg_min(k, (abs(l_extendedprice - c), k)) FROM (VALUES ('birth', 10000.0), ('hire', 45000.0), ('term', 90000.0)) v(k, c)) AS col, count(*) AS n FROM lineitem GROUP BY 1")
def nearest_band(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").groupBy(joins.nearest_of(F.col("l_extendedprice"), [("birth", 10000.0), ("hire", 45000.0), ("term", 90000.0)]).alias("col")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT DISTINCT l_suppkey, floor(l_extendedprice / 100)::BIGINT AS bin FROM lineitem WHERE floor(l_extendedprice / 100) >= 300 AND floor(l_extendedprice / 100) < 700
UNION SELECT DISTINCT l_suppkey, 299 FROM lineitem UNION SELECT DISTINCT l_suppkey, 700 FROM lineitem),
r AS (SELECT l_suppkey, bin + 1 AS start, lead(bin) OVER (PARTITION BY l_suppkey ORDER BY bin) - bin - 1 AS width FROM b)
SELECT l_suppkey, start, width FROM r WHERE width > 0 QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY width DESC, start) = 1""")
def gutter_widest_gap(spark, sf_dir):
    w = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x0"), F.col("l_extendedprice").alias("x1"))
    return lines.gutters(w, ["l_suppkey"], 30000.0, 70000.0, 100.0)


@query("""WITH w AS (SELECT l_suppkey, l_extendedprice AS x0, l_extendedprice + 50 AS x1 FROM lineitem),
m AS (SELECT *, CASE WHEN x0 - max(x1) OVER (PARTITION BY l_suppkey ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 200 THEN 1 ELSE 0 END AS new FROM w),
c AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY x0, x1 RANGE UNBOUNDED PRECEDING) AS cluster FROM m)
SELECT l_suppkey, cluster::INT AS cluster, min(x0) AS x_left, max(x1) AS x_right, count(*) AS n_words FROM c GROUP BY 1, 2""")
def column_clusters(spark, sf_dir):
    w = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_extendedprice").alias("x0"), (F.col("l_extendedprice") + 50).alias("x1"))
    return lines.column_clusters(w, ["l_suppkey"], 200.0)


@query("""WITH v AS (SELECT user_id, event_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM v""")
def carry_forward(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumn("v", F.when(F.col("event_type") == "purchase", F.col("value")))
    return e.select("event_id", joins.carried(e, ["user_id"], ["ts", "event_id"], "v").alias("carried"))


@query(f"""WITH {_LINES_SQL}, n AS (SELECT doc_id, line_no, lead(line, 1) OVER w AS a, lead(line, 2) OVER w AS b, lead(line, 3) OVER w AS c FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no::INT AS line_no, md5(coalesce(CASE WHEN trim(a) <> '' THEN a END, CASE WHEN trim(b) <> '' THEN b END, CASE WHEN trim(c) <> '' THEN c END)) AS following FROM n""")
def lookahead_next_nonblank(spark, sf_dir):
    ls = _lines(spark, sf_dir)
    return ls.select("doc_id", "line_no", F.md5(lines.look_ahead(ls, ["doc_id"], ["line_no"], "line", 3)).alias("following"))


# Reconciliation, joins ---------------------------------------------------------------------------------------------


@query("""SELECT o_custkey, expected, coalesce(produced, 0) AS produced, greatest(expected - coalesce(produced, 0), 0) AS missing, coalesce(produced, 0) >= expected AS complete
FROM (SELECT o_custkey, count(*) AS expected FROM orders GROUP BY 1) LEFT JOIN (SELECT o_custkey, count(*) AS produced FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) GROUP BY 1) USING (o_custkey)""")
def reconciliation(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    produced = orders.join(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    return recon.reconciled(orders, produced, "o_custkey")


@query(r"""WITH r AS (SELECT doc_id, 'lines' AS method, len(list_filter(string_split(text, chr(10)), lambda x: x <> ''))::BIGINT AS a, 0::BIGINT AS b FROM documents
UNION ALL SELECT doc_id, 'stops', len(list_filter(string_split(text, '.'), lambda x: x <> ''))::BIGINT, 1 FROM documents)
SELECT doc_id, arg_max(method, (a, b)) AS method FROM r GROUP BY doc_id""")
def best_of_two_readers(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    n = lambda sep: F.size(F.filter(F.split("text", sep), lambda x: x != "")).cast("long")
    r = d.select("doc_id", F.explode(F.array(F.struct(F.lit("lines").alias("method"), n("\n").alias("a"), F.lit(0).alias("b")), F.struct(F.lit("stops").alias("method"), n(r"\.").alias("a"), F.lit(1).alias("b")))).alias("r")).select("doc_id", "r.*")
    return recon.best_reading(r, ["doc_id"], ["a", "b"], "method")


_DONOR_SQL = "t AS (SELECT c_custkey AS k, c_nationkey::VARCHAR AS n, CASE WHEN c_custkey % 3 = 0 THEN ' ' ELSE c_mktsegment END AS seg FROM customer), d AS (SELECT s_suppkey AS k, 'N' || s_nationkey AS n2, s_name AS seg FROM supplier)"


def _target(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("string").alias("n"), F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment")).alias("seg"))


@query(f"""WITH {_DONOR_SQL}, one AS (SELECT n_nationkey::VARCHAR AS n, n_name AS seg FROM nation)
SELECT t.k, t.n, CASE WHEN trim(t.seg) = '' THEN CASE WHEN d.k IS NOT NULL THEN d.seg ELSE one.seg END ELSE t.seg END AS seg, CASE WHEN d.k IS NOT NULL THEN 'k' WHEN one.n IS NOT NULL THEN 'n' END AS filled_from
FROM t LEFT JOIN d ON t.k = d.k LEFT JOIN one ON t.n = one.n""")
def fill_blanks_from_donor(spark, sf_dir):
    by_key = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit(None).cast("string").alias("n"), F.col("s_name").alias("seg"))
    by_nation = _t(spark, sf_dir, "nation").select(F.lit(None).cast("long").alias("k"), F.col("n_nationkey").cast("string").alias("n"), F.col("n_name").alias("seg"))
    return joins.fill_from_donor(_target(spark, sf_dir), by_key.union(by_nation), ["k", "n"], ["seg"])


@query(f"WITH {_DONOR_SQL} SELECT t.k, t.n, CASE WHEN d.k IS NOT NULL AND trim(t.seg) <> '' THEN d.seg ELSE t.seg END AS seg FROM t LEFT JOIN d ON t.k = d.k")
def conditional_update(spark, sf_dir):
    d = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("seg"))
    return joins.conditional_update(_target(spark, sf_dir), d, "k", ["seg"])


@query(f"WITH {_DONOR_SQL} SELECT t.k, t.n, CASE WHEN d.k IS NOT NULL AND trim(t.seg) = '' THEN d.seg ELSE t.seg END AS seg FROM t LEFT JOIN d ON t.k = d.k")
def conditional_update_blank_only(spark, sf_dir):
    d = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("seg"))
    return joins.conditional_update(_target(spark, sf_dir), d, "k", ["seg"], when="blank")


@query("""WITH a AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice < 300000), b AS (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 100000)
SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def engine_diff(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return joins.difference(o.filter("o_totalprice < 300000").select("o_custkey", "o_orderstatus"), o.filter("o_totalprice > 100000").select("o_custkey", "o_orderstatus"))


@query("""WITH f AS (SELECT lower(p_name) AS stem, p_partkey::VARCHAR AS path FROM part), n(name) AS (VALUES ('Small Ring'), ('red widget.pdf'), ('RED WIDGET'), ('no such part'), ('missing.txt')),
e AS (SELECT name, path, 'exact' AS found FROM n JOIN f ON lower(name) = stem), s AS (SELECT name, path, 'stripped' AS found FROM n JOIN f ON lower(regexp_replace(name, '\\.[^.]*$', '')) = stem WHERE name NOT IN (SELECT name FROM e))
SELECT DISTINCT * FROM e UNION SELECT * FROM s UNION SELECT name, NULL, 'not found' FROM n WHERE name NOT IN (SELECT name FROM e) AND name NOT IN (SELECT name FROM s)""".replace("\\\\", "\\"))
def not_found_and_fallback_lookup(spark, sf_dir):
    wanted = spark.createDataFrame([(x,) for x in ("Small Ring", "red widget.pdf", "RED WIDGET", "no such part", "missing.txt")], "name string")
    return joins.lookup_names(wanted, _t(spark, sf_dir, "part").select(F.col("p_name").alias("stem"), F.col("p_partkey").cast("string").alias("path")))


@query("SELECT l_orderkey, l_returnflag, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_linenumber, l_partkey) = 1")
def priority_pick(spark, sf_dir):
    rank = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    li = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_partkey")
    return joins.pick_by_priority(li, ["l_orderkey"], rank, ["l_linenumber", "l_partkey"]).select("l_orderkey", "l_returnflag", "l_linenumber")


@query("SELECT doc_id, source FROM documents ANTI JOIN labels USING (doc_id)")
def resume_anti_join(spark, sf_dir):
    return joins.unprocessed(_t(spark, sf_dir, "documents").select("doc_id", "source"), _t(spark, sf_dir, "labels"), "doc_id")


# Scalars -----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS first, split_part(p_name, ' ', 2) AS last, split_part(p_name, ' ', 2) AS comma_last, split_part(p_name, ' ', 1) AS comma_first FROM part")
def name_split(spark, sf_dir):
    p = _t(spark, sf_dir, "part").select("p_partkey", tx.split_plain_name("p_name").alias("n"), tx.split_comma_name(F.concat_ws(", ", F.split_part("p_name", F.lit(" "), F.lit(2)), F.split_part("p_name", F.lit(" "), F.lit(1)))).alias("c"))
    return p.select("p_partkey", F.col("n.first").alias("first"), F.col("n.last").alias("last"), F.col("c.last").alias("comma_last"), F.col("c.first").alias("comma_first"))


@query("SELECT c_custkey, regexp_matches(c_name, '[^a-zA-Z ]') OR regexp_matches(c_mktsegment, '[^a-zA-Z ]') AS non_letter, contains(c_name, '-') OR contains(c_mktsegment, '-') AS hyphen, trim(c_name) = '' OR trim(c_mktsegment) = '' AS blank FROM customer")
def quality_flags(spark, sf_dir):
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.quality_flags("c_name", "c_mktsegment").alias("q")).select("c_custkey", "q.*")


@query("SELECT o_orderkey, CASE WHEN o_orderkey * 20 BETWEEN 20000 AND 80000 THEN strftime(DATE '1899-12-30' + (o_orderkey * 20)::INT, '%m/%d/%Y') ELSE (o_orderkey * 20)::VARCHAR END AS value FROM orders")
def serial_date_coercion(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.serial_date((F.col("o_orderkey") * 20).cast("string")).alias("value"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS value FROM orders")
def norm_date_pivot(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.norm_date(F.concat(F.lit("due "), F.date_format("o_orderdate", "M/d/yy"), F.lit(" at noon"))).alias("value"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = floor(l_quantity) THEN l_quantity::BIGINT::VARCHAR ELSE l_quantity::VARCHAR END AS quantity,
CASE WHEN l_discount = floor(l_discount) THEN l_discount::BIGINT::VARCHAR ELSE l_discount::VARCHAR END AS discount, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem""")
def cell_to_text(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.number_text("l_quantity").alias("quantity"), tx.number_text("l_discount").alias("discount"), tx.time_text("l_shipdate").alias("shipped"))


@query(r"SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '[?&]page=([^&]*)', 1) AS page FROM pages")
def label_values(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "[?&]page=([^&]*)", 1).alias("page"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_map_round_trip(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    again = F.from_json(F.to_json("m"), "map<string,string>")
    return e.select("event_id", F.try_element_at(again, F.lit("k")).alias("k"))


@query(r"""WITH m AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\r\n\x0b\x0c]+'), lambda x: x <> '')) AS w, length(regexp_replace(text, '[^A-Za-z0-9 \n\t.,;:''"()/&#%$-]', '', 'g'))::DOUBLE / length(text) AS r, length(text) - length(regexp_replace(text, '[‐‑‒–—]', '', 'g')) AS d FROM documents)
SELECT doc_id, r AS readable, CASE WHEN w = 0 THEN 'no text' WHEN r < 0.85 THEN 'unreadable' WHEN d > 0 THEN 'dash variant' WHEN w < 5 THEN 'short' ELSE 'ok' END AS verdict FROM m""")
def text_verdict(spark, sf_dir):
    words = F.size(F.filter(F.split("text", WS), lambda w: w != ""))
    dashes = F.length("text") - F.length(F.translate("text", "‐‑‒–—", ""))
    measured = _t(spark, sf_dir, "documents").select("doc_id", tx.readable_ratio("text").alias("readable"), words.alias("n"), dashes.alias("dashes"))
    return measured.select("doc_id", "readable", recon.text_verdict(F.col("n"), F.col("readable"), F.col("dashes")).alias("verdict"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}($|[^0-9])') THEN 'SSN' WHEN regexp_matches(text, '(^|[^0-9])[0-9]{2}-[0-9]{7}($|[^0-9])') THEN 'EIN' END AS kind FROM
(SELECT doc_id, 'no ' || (100 + doc_id % 900) || CASE WHEN doc_id % 3 = 0 THEN '-12-' WHEN doc_id % 3 = 1 THEN '-' ELSE ' ' END || (1000 + doc_id % 9000) || '.' || (10 + doc_id % 80) || '-' || (1000000 + doc_id % 9000000) AS text FROM documents)""")
def tin_type_ladder(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat(F.lit("no "), (100 + i % 900).cast("string"), F.when(i % 3 == 0, "-12-").when(i % 3 == 1, "-").otherwise(" "), (1000 + i % 9000).cast("string"), F.lit("."), (10 + i % 80).cast("string"), F.lit("-"), (1000000 + i % 9000000).cast("string"))
    return _t(spark, sf_dir, "documents").select("doc_id", tx.tin(text, F.lit("INDIVIDUAL"))["type"].alias("kind"))


# Header rows -------------------------------------------------------------------------------------------------------


def _grid(spark, sf_dir):
    return _lines(spark, sf_dir).select(F.col("source").alias("file"), F.col("doc_id").cast("string").alias("sheet"), (F.col("line_no") + 1).alias("row_no"), F.split("line", " ").alias("cells"))


_GRID_SQL = _LINES_SQL + ", g AS (SELECT source AS file, doc_id::VARCHAR AS sheet, line_no + 1 AS row_no, string_split(line, ' ') AS cells FROM l)"


@query(f"""WITH {_GRID_SQL}, n AS (SELECT file, sheet, row_no, len(list_filter(cells, lambda c: trim(c) <> '')) AS n FROM g WHERE row_no <= 30 AND len(list_filter(cells, lambda c: starts_with(regexp_replace(lower(c), '[^a-z0-9]', '', 'g'), 'the'))) > 0)
SELECT file, sheet, arg_max(row_no, (n, row_no))::INT AS header_row FROM n WHERE n >= 2 GROUP BY 1, 2""")
def header_row_by_keyword(spark, sf_dir):
    return headers.by_keyword(_grid(spark, sf_dir), "the")


@query(f"""WITH {_GRID_SQL}, n AS (SELECT file, sheet, row_no, len(list_intersect(list_transform(cells, lambda c: regexp_replace(lower(c), '[^a-z0-9]', '', 'g')), ['the', 'and', 'of', 'in', 'de'])) AS n FROM g WHERE row_no <= 25)
SELECT file, sheet, arg_max(row_no, (n, -row_no))::INT AS header_row, max(n)::INT AS matched FROM n WHERE n >= 2 GROUP BY 1, 2""")
def header_row_by_targets(spark, sf_dir):
    return headers.by_targets(_grid(spark, sf_dir), ("the", "and", "of", "in", "de"))


@query(f"""WITH {_GRID_SQL} SELECT file, sheet, min(row_no)::INT AS header_row FROM g WHERE len(list_filter(cells, lambda c: trim(c) <> '')) > 0 GROUP BY 1, 2""")
def header_row_first_filled(spark, sf_dir):
    return headers.first_filled(_grid(spark, sf_dir))


@query(f"""WITH {_GRID_SQL}, v AS (SELECT file, sheet, row_no, cells, list_filter(list_transform(cells, lambda c: trim(c, chr(32) || chr(9) || chr(11) || chr(12) || chr(13))), lambda c: c <> '') AS x FROM g),
f AS (SELECT *, row_number() OVER (PARTITION BY file, sheet ORDER BY row_no) AS i, count(*) OVER (PARTITION BY file, sheet) AS total FROM v WHERE len(x) > 0),
p AS (SELECT file, sheet, i, unnest(cells) AS c, generate_subscripts(cells, 1) AS pos FROM f WHERE i <= 80),
q AS (SELECT file, sheet, i, pos FROM p WHERE trim(c, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
h AS (SELECT file, sheet, i, row_no, x, least(total - i, 40) AS below FROM f WHERE i <= 40 AND total > i),
d AS (SELECT h.file, h.sheet, h.i, q.pos FROM h JOIN q ON q.file = h.file AND q.sheet = h.sheet AND q.i > h.i AND q.i <= h.i + 40 GROUP BY h.file, h.sheet, h.i, h.below, q.pos HAVING count(*) >= CASE WHEN h.below <= 2 THEN 1 ELSE 2 END),
u AS (SELECT file, sheet, i, count(*) AS used FROM d GROUP BY 1, 2, 3),
b AS (SELECT file, sheet, i, count(*) AS hit FROM d JOIN q USING (file, sheet, i, pos) GROUP BY 1, 2, 3),
s AS (SELECT file, sheet, i, row_no, (coalesce(hit, 0)::DOUBLE / used) * 0.45 + (len(list_filter(x, lambda c: NOT regexp_matches(replace(c, ',', ''), '{headers.NUMERIC}')))::DOUBLE / len(x)) * 0.20
+ (len(list_distinct(list_transform(x, lambda c: lower(c))))::DOUBLE / len(x)) * 0.15 + (len(list_filter(x, lambda c: length(c) <= 60))::DOUBLE / len(x)) * 0.10 + (1 - (len(x) - coalesce(hit, 0))::DOUBLE / len(x)) * 0.10 AS score
FROM h JOIN u USING (file, sheet, i) LEFT JOIN b USING (file, sheet, i)),
t AS (SELECT file, sheet, max(score) AS top FROM s GROUP BY 1, 2),
e AS (SELECT file, sheet, min(row_no) AS row_no FROM s JOIN t USING (file, sheet) WHERE top >= 0.55 AND score >= top - 0.06 GROUP BY 1, 2)
SELECT f.file, f.sheet, coalesce(e.row_no, f.row_no)::INT AS header_row FROM f LEFT JOIN e USING (file, sheet) WHERE f.i = 1""")
def header_row_score(spark, sf_dir):
    return headers.by_score(_grid(spark, sf_dir))


@query(f"""WITH {_GRID_SQL}, n AS (SELECT *, len(list_filter(cells, lambda c: trim(c) <> '')) AS n FROM g), s AS (SELECT file, sheet, min(row_no) FILTER (n > 0) AS f, arg_min(cells, row_no) AS c, arg_min(n, row_no) AS m, count(*) FILTER (n > 0 AND row_no > 1) AS d FROM n GROUP BY 1, 2),
x AS (SELECT *, len(list_filter(c, lambda v: regexp_matches(v, '[A-Za-z]'))) AS t, len(list_filter(c, lambda v: length(v) > 120)) AS big FROM s)
SELECT file, sheet, CASE WHEN f IS NULL THEN 'the sheet is empty' WHEN f <> 1 THEN 'the first filled row is row ' || f WHEN m < 2 THEN 'row 1 has fewer than 2 filled cells' WHEN t < 2 OR t < 0.6 * m THEN 'row 1 is mostly not text' WHEN big > 0 THEN 'row 1 has a cell of over 120 characters' WHEN d = 0 THEN 'no data below row 1' END AS reason FROM x""")
def header_row_or_reason(spark, sf_dir):
    return headers.first_row_or_reason(_grid(spark, sf_dir))


@query(f"""WITH {_GRID_SQL} SELECT file, sheet, count(*) AS n_rows FROM g WHERE len(list_filter(cells, lambda c: trim(c) <> '')) > 0 GROUP BY 1, 2""")
def rows_per_sheet(spark, sf_dir):
    return _grid(spark, sf_dir).filter(headers.filled("cells") > 0).groupBy("file", "sheet").agg(F.count("*").alias("n_rows"))


@query(r"""WITH t AS (SELECT page_id::VARCHAR AS file, unnest(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1)) AS t, generate_subscripts(regexp_extract_all(html, '(?s)<ul>(.*?)</ul>', 1), 1) AS i FROM pages)
SELECT file, 'Table ' || i AS sheet, 1 AS row_no, array_to_string(list_transform(regexp_extract_all(t, '(?s)<li>(.*?)</li>', 1),
  lambda c: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(c, '<[^>]*>', '', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '[ \t\r\n]+', ' ', 'g'))), '|') AS row FROM t""")
def html_cells(spark, sf_dir):
    # The pages hold no tables, but lists: whole pages are parsed, with a list as a table of one row.
    html = F.col("html")
    for a, b in (("<ul>", "<table><tr>"), ("</ul>", "</tr></table>"), ("<li>", "<td>"), ("</li>", "</td>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    pages = _t(spark, sf_dir, "pages").select("page_id", html.alias("html"))
    return sheets.html_cells(pages, "page_id", "html").select("file", "sheet", "row_no", F.array_join("cells", "|").alias("row"))


@query("""SELECT source, sum(len(regexp_extract_all(text, '(?:^|[^0-9])[0-9]{3}-[0-9]{3}-[0-9]{4}')))::BIGINT AS phones, count(*) FILTER (regexp_matches(text, '(^|[^0-9-])[0-9]{9}($|[^0-9-])')) AS nine_digits FROM documents GROUP BY source""")
def number_shapes(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit("(?:^|[^0-9])[0-9]{3}-[0-9]{3}-[0-9]{4}")).cast("long")).alias("phones"), F.count_if(tx.ssn_shapes("text")["bare"] > 0).alias("nine_digits"))


@query("""WITH t AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
SELECT p_partkey, a AS first, left(b, 1) AS middle, b || ' ' || a AS last FROM t""")
def name_split_second_initial(spark, sf_dir):
    a, b = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    name = F.concat_ws(" ", a, F.substring(b, 1, 1), b, a)
    return _t(spark, sf_dir, "part").select("p_partkey", tx.split_second_initial_name(name).alias("n")).select("p_partkey", "n.first", "n.middle", "n.last")


@query("""WITH v AS (SELECT c_custkey, unnest([c_custkey::VARCHAR, c_name, '-' || c_custkey || '.50', '--']) AS v FROM customer)
SELECT CASE WHEN regexp_full_match(replace(v, ' ', ''), '[0-9]+') THEN 'id' WHEN regexp_full_match(v, '-?[0-9][0-9,]*[.][0-9]+') THEN 'decimal' WHEN regexp_matches(v, '[A-Za-z]') THEN 'name' END AS shape, count(*) AS n FROM v GROUP BY 1""")
def value_shapes(spark, sf_dir):
    key = F.col("c_custkey").cast("string")
    values = F.explode(F.array(key, F.col("c_name"), F.concat(F.lit("-"), key, F.lit(".50")), F.lit("--"))).alias("v")
    return _t(spark, sf_dir, "customer").select(values).groupBy(tx.value_shape("v").alias("shape")).agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, c_name AS name, CASE c_custkey % 3 WHEN 0 THEN 'a b' WHEN 1 THEN 'c' ELSE 'd' END AS target FROM customer WHERE c_custkey % 4 <> 3""")
def pasted_pairs(spark, sf_dir):
    key = F.col("c_custkey")
    line = F.when(key % 4 == 3, F.col("c_name")).when(key % 3 == 0, F.concat("c_name", F.lit("\ta b"))).when(key % 3 == 1, F.concat("c_name", F.lit(" , c"))).otherwise(F.concat(F.lit(" "), "c_name", F.lit("   d ")))
    return _t(spark, sf_dir, "customer").select("c_custkey", tx.pasted_pair(line).alias("p")).filter("p is not null").select("c_custkey", "p.name", "p.target")


@query(f"""WITH RECURSIVE {_WORDS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY top, x0, text) AS i FROM w),
f AS (SELECT page, i, x0, text, top, [top] AS firsts, 0 AS line_no FROM o WHERE i = 1
UNION ALL SELECT o.page, o.i, o.x0, o.text, o.top, CASE WHEN len(list_filter(firsts, lambda x: abs(x - o.top) <= 4)) > 0 THEN firsts ELSE list_append(firsts, o.top) END,
CASE WHEN len(list_filter(firsts, lambda x: abs(x - o.top) <= 4)) > 0 THEN list_position(list_transform(firsts, lambda x: abs(x - o.top) <= 4), true) - 1 ELSE len(firsts) END FROM f JOIN o ON o.page = f.page AND o.i = f.i + 1)
SELECT page, line_no::INT AS line_no, min(top) AS top, string_agg(text, ' ' ORDER BY x0, text) AS text FROM f GROUP BY 1, 2""")
def line_first_fit(spark, sf_dir):
    return lines.page_lines(_words(spark, sf_dir), ["page"], "first_fit", 4.0).select("page", "line_no", "top", "text")


@query("""WITH g AS (SELECT conv_id, turn, role, text, last_value(CASE WHEN role = 'user' THEN 'u' || turn WHEN turn % 5 = 4 THEN '' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) AS within FROM conversations)
SELECT conv_id, turn, within FROM g WHERE role <> 'user' AND turn % 5 <> 4 AND within <> ''""")
def contained_turns(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    label = F.concat(F.lit("u"), F.col("turn").cast("string"))
    return joins.contained(c, ["conv_id"], ["turn", "text"], F.col("role") == "user", F.col("turn") % 5 == 4, label).select("conv_id", "turn", "within")


@query(f"""WITH {_GRID_SQL}, k AS (SELECT file, sheet, row_no, regexp_replace(array_to_string(list_transform(cells, lambda c: trim(regexp_replace(lower(c), '[^a-z0-9]+', ' ', 'g'))), chr(31)), chr(31) || '+$', '') AS k FROM g)
SELECT a.file, a.sheet, count(*) AS n_rows FROM k a JOIN k h ON a.file = h.file AND a.sheet = h.sheet AND h.row_no = 1 WHERE a.row_no > 1 AND a.k <> h.k GROUP BY 1, 2""")
def rows_without_repeated_headers(spark, sf_dir):
    return headers.without_repeated_headers(_grid(spark, sf_dir).withColumn("header_row", F.lit(1))).groupBy("file", "sheet").agg(F.count("*").alias("n_rows"))


# More scalar rules, each over made-up values of a test table ----------------------------------------------------------


def _number(spark, sf_dir):
    """doc_id and a text that holds a number in one of six spellings."""
    i = F.col("doc_id")
    a, b, c = F.lpad((100 + i % 800).cast("string"), 3, "0"), F.lpad((i % 90 + 10).cast("string"), 2, "0"), F.lpad((i % 9000 + 1000).cast("string"), 4, "0")
    text = F.when(i % 6 == 0, F.concat(F.lit("id "), a, F.lit("-"), b, F.lit("-"), c)).when(i % 6 == 1, F.concat(a, F.lit("\u2013"), b, F.lit("\u2013"), c, F.lit(" end")))
    text = text.when(i % 6 == 2, F.concat(F.lit("XXX-XX-"), c)).when(i % 6 == 3, F.concat(F.lit("no "), a, b, c, F.lit("."))).when(i % 6 == 4, F.concat(F.lit("zip 12345-"), c)).otherwise("none")
    return _t(spark, sf_dir, "documents").select("doc_id", text.alias("t"))


_NUMBER_SQL = """p AS (SELECT doc_id, (100 + doc_id % 800)::VARCHAR AS a, (doc_id % 90 + 10)::VARCHAR AS b, (doc_id % 9000 + 1000)::VARCHAR AS c FROM documents),
t AS (SELECT doc_id, a, b, c, CASE doc_id % 6 WHEN 0 THEN 'id ' || a || '-' || b || '-' || c WHEN 1 THEN a || chr(8211) || b || chr(8211) || c || ' end' WHEN 2 THEN 'XXX-XX-' || c WHEN 3 THEN 'no ' || a || b || c || '.' WHEN 4 THEN 'zip 12345-' || c ELSE 'none' END AS t FROM p)"""


@query(f"""WITH {_NUMBER_SQL} SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN a || '-' || b || '-' || c WHEN 1 THEN a || '-' || b || '-' || c WHEN 2 THEN 'XXX-XX-' || c WHEN 3 THEN a || b || c END AS ssn,
CASE doc_id % 6 WHEN 0 THEN a || '-' || b || '-' || c WHEN 1 THEN a || '-' || b || '-' || c WHEN 2 THEN 'XXX-XX-' || c WHEN 3 THEN a || '-' || b || '-' || c END AS norm,
CASE WHEN doc_id % 6 IN (0, 1, 3) THEN a || b || c WHEN doc_id % 6 = 2 THEN 'XXXXX' || c END AS key FROM t""")
def ssn_found_and_normalised(spark, sf_dir):
    found = _number(spark, sf_dir).select("doc_id", tx.find_ssn("t").alias("ssn"))
    return found.select("doc_id", "ssn", tx.norm_ssn("ssn").alias("norm"), tx.ssn_key("ssn").alias("key"))


@query(f"""WITH {_NUMBER_SQL} SELECT doc_id, replace(t, chr(8211), '-') AS folded, CASE doc_id % 6 WHEN 0 THEN 'id ***-**-' || c WHEN 1 THEN '***-**-' || c || ' end' WHEN 2 THEN '***-**-' || c ELSE t END AS masked FROM t""")
def folded_and_masked_numbers(spark, sf_dir):
    return _number(spark, sf_dir).select("doc_id", tx.fold("t").alias("folded"), tx.mask_ssn("t").alias("masked"))


@query(f"""WITH {_NUMBER_SQL} SELECT doc_id, trim(list_aggregate(list_transform(string_split(t, ' '), lambda w: CASE WHEN lower(w) IN ('id', 'zip') THEN w ELSE regexp_replace(regexp_replace(regexp_replace(w, '[0-9]', '#', 'g'), '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g') END), 'string_agg', ' ')) AS shown FROM t""")
def masked_except_safe_words(spark, sf_dir):
    return _number(spark, sf_dir).select("doc_id", F.trim(tx.mask_except(F.col("t"), ("ID", "zip"))).alias("shown"))


@query("""WITH n AS (SELECT p_partkey AS k, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b FROM part)
SELECT k, CASE k % 4 WHEN 0 THEN a || ' ' || b WHEN 1 THEN 'Mroz ' || b WHEN 2 THEN b WHEN 3 THEN a END AS bare, k % 4 <> 3 OR length(a) >= 2 AS name,
k % 5 = 0 AS entity, k % 5 = 1 AS joint FROM n""")
def honorifics_and_kinds_of_name(spark, sf_dir):
    k, a, b = F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.split_part("p_name", F.lit(" "), F.lit(2))
    text = F.when(k % 4 == 0, F.concat(F.lit("Mr. "), a, F.lit("  "), b)).when(k % 4 == 1, F.concat(F.lit("Mroz "), b)).when(k % 4 == 2, F.concat(F.lit("Dr Mrs "), b)).otherwise(F.concat(F.lit("Miss "), a))
    kind = F.when(k % 5 == 0, F.concat(a, F.lit(" Holdings LLC"))).when(k % 5 == 1, F.concat(a, F.lit(" & "), b)).otherwise(F.concat(a, F.lit(" "), b))
    return _t(spark, sf_dir, "part").select(k.alias("k"), tx.strip_honorific(text).alias("bare"), tx.looks_like_name(text).alias("name"), tx.looks_like_entity(kind).alias("entity"), tx.looks_like_joint(kind).alias("joint"))


def _address(spark, sf_dir):
    k = F.col("c_custkey")
    city, state, zip_code = F.concat(F.lit("City"), F.translate(k.cast("string"), "0123456789", "abcdefghij")), F.element_at(F.array(*[F.lit(x) for x in ("DE", "NV", "CA")]), (k % 3 + 1).cast("int")), F.lpad((k % 90000 + 10000).cast("string"), 5, "0")
    place = F.when(k % 4 == 0, F.concat(city, F.lit(", "), state, F.lit(" "), zip_code)).when(k % 4 == 1, F.concat(city, F.lit(" "), state, F.lit("  "), zip_code)).when(k % 4 == 2, F.concat(city, F.lit(","), state, F.lit(","), zip_code, F.lit("-1234"))).otherwise(F.concat(city, F.lit(" , "), state, F.lit(" "), zip_code))
    street = F.concat((k % 900 + 1).cast("string"), F.lit(" Main St"))
    lines = F.when(k % 3 == 0, F.array(F.concat(street, F.lit(" Apt 2B")), place)).when(k % 3 == 1, F.array(street, F.lit("Suite 9"), place)).otherwise(F.array(F.lit("PO Box 7"), place))
    return _t(spark, sf_dir, "customer").select(k.alias("k"), place.alias("place"), lines.alias("lines"))


@query("""WITH c AS (SELECT c_custkey AS k, 'City' || translate(c_custkey::VARCHAR, '0123456789', 'abcdefghij') AS city, ['DE', 'NV', 'CA'][c_custkey % 3 + 1] AS state, (c_custkey % 90000 + 10000)::VARCHAR || CASE WHEN c_custkey % 4 = 2 THEN '-1234' ELSE '' END AS zip FROM customer)
SELECT k, CASE k % 3 WHEN 2 THEN 'PO Box 7' ELSE (k % 900 + 1) || ' Main St' END AS street, CASE k % 3 WHEN 0 THEN 'Apt 2B' WHEN 1 THEN 'Suite 9' ELSE '' END AS unit, city, state, zip, true AS is_address FROM c""")
def address_fields(spark, sf_dir):
    return _address(spark, sf_dir).select("k", tx.address_parts("lines").alias("a"), tx.looks_like_address("place").alias("is_address")).select("k", "a.street", "a.unit", "a.city", "a.state", "a.zip", "is_address")


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN 'DUE LATER' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS value, year(o_orderdate) < 1890 OR year(o_orderdate) > 2030 AS suspect FROM orders""")
def date_values(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    text = F.when(k % 4 == 0, F.date_format(d, "M/d/yyyy")).when(k % 4 == 1, F.date_format(d, " yyyy-MM-dd ")).when(k % 4 == 2, F.date_format(d, "M-d-yyyy")).otherwise("due  later")
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.date_value(text).alias("value"), tx.date_suspect(F.date_format(d, "MM/dd/yyyy")).alias("suspect"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts::DATE, '%Y-%m-%d') WHEN ts = date_trunc('day', ts) THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS shown FROM events""")
def date_cells(spark, sf_dir):
    t = F.when(F.col("event_id") % 2 == 0, F.date_trunc("day", "ts")).otherwise(F.col("ts"))
    return _t(spark, sf_dir, "events").select("event_id", tx.time_text(t.cast("timestamp")).alias("shown"))


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a_b__c' WHEN 1 THEN 'x' WHEN 2 THEN '(blank)' ELSE 'q_' || source END AS file_name, CASE doc_id % 4 WHEN 3 THEN length(text) ELSE 3 END AS n FROM documents""")
def safe_names_and_cells(spark, sf_dir):
    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, "a/b<>c. ").when(k % 4 == 1, " x... ").when(k % 4 == 2, "  ").otherwise(F.concat(F.lit("q?"), "source"))
    cell = F.when(k % 4 == 3, F.concat(F.lit("\x01\x0b"), "text")).otherwise("a\x00bc")
    return _t(spark, sf_dir, "documents").select("doc_id", tx.safe_file_name(raw).alias("file_name"), F.length(tx.safe_cell(cell)).alias("n"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'REDACTED' ELSE upper(o_orderpriority) END AS status, CASE WHEN o_orderkey % 3 = 0 THEN 'REDACTED' ELSE 'Ann Alpha' END AS name, CASE WHEN o_orderkey % 3 = 0 THEN 'REDACTED' ELSE (1000 + o_orderkey)::VARCHAR || '-A' END AS number FROM orders""")
def status_or_redacted(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.when(k % 3 == 0, "_|#").otherwise(F.lower("o_orderpriority"))
    fields = tx.status_fields(F.when(k % 3 == 0, "|| x").otherwise(" Ann  Alpha"), F.when(k % 3 == 0, "|.").otherwise(F.concat((1000 + k).cast("string"), F.lit(" -a."))))
    return _t(spark, sf_dir, "orders").select("o_orderkey", tx.status_text(status).alias("status"), fields.alias("f")).select("o_orderkey", "status", "f.*")


@query("""SELECT p_partkey, p_name AS name, CASE p_partkey % 2 WHEN 0 THEN p_brand ELSE '' END AS brand FROM part""")
def captioned_values(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.concat(F.lit("NAME: "), "p_name", F.when(k % 2 == 0, F.concat(F.lit("  BRAND: "), "p_brand")).otherwise(""), F.lit("\nFUND NAME: other"))
    return _t(spark, sf_dir, "part").select("p_partkey", tx.label_value(text, "NAME", ("BRAND", "FUND NAME")).alias("name"), tx.label_value(text, "BRAND", ("NAME",)).alias("brand"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN [c_name, '123-45-6789', 'x'] WHEN c_custkey % 3 = 1 THEN ['123-45-6789'] ELSE [c_name] END AS parts FROM customer""")
def glued_words(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.when(k % 3 == 0, F.concat("c_name", F.lit("123-45-6789x"))).when(k % 3 == 1, "123-45-6789").otherwise(F.col("c_name"))
    name = F.translate("c_name", "#0123456789", "Nabcdefghij")
    word = F.struct(F.lit(0.0).alias("x0"), F.lit(30.0).alias("x1"), F.replace(text, F.col("c_name"), name).alias("text"))
    found = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", name.alias("n"), word.alias("w"))
    return found.select("c_custkey", F.transform(tx.split_glued("w"), lambda p: F.when(p["text"] == F.col("n"), F.col("c_name")).otherwise(p["text"])).alias("parts"))


@query("""WITH d AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS layouts FROM documents GROUP BY source)
SELECT count(*) AS files, sum(n)::BIGINT AS rows, max(n) AS largest, string_agg(layouts, ' | ' ORDER BY source) AS layouts FROM d""")
def run_totals(spark, sf_dir):
    per = recon.per_file(_t(spark, sf_dir, "documents").filter("source is not null"), "source", "lang")
    return recon.totals(per, "source")


@query("""SELECT n_nationkey, n_name AS "Name", coalesce(n_name, '') AS first, upper(n_name) || '.0' AS raw, upper(n_name) || '.0' AS normal, '(' || n_nationkey || ')' AS cleaned_from, n_nationkey::VARCHAR AS cleaned FROM nation""")
def first_filled_and_normal_values(spark, sf_dir):
    n = _t(spark, sf_dir, "nation")
    raw = F.concat(F.lower("n_name"), F.lit(".0"))
    out = n.withColumn("a", F.lit("  ")).withColumn("b", F.lit(None).cast("string")).withColumn("Name", F.col("n_name"))
    return out.select("n_nationkey", "Name", union.first_filled("b", "a", "n_name").alias("first"), F.upper(raw).alias("raw"), tx.normal_value(raw).alias("normal"), F.concat(F.lit("("), F.col("n_nationkey").cast("string"), F.lit(")")).alias("cleaned_from"), tx.cleaned_number(F.concat(F.lit("$ "), F.col("n_nationkey").cast("string"), F.lit(" x"))).alias("cleaned"))


@query("""WITH a AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders), f AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F')
SELECT k, c FROM a ANTI JOIN f USING (k)""")
def list_rows_without_forms(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    listed = o.select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_custkey").alias("c"))
    forms = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("k"))
    return joins.without_listed(listed, forms.union(spark.createDataFrame([("",)], "k string")), ["k"]).select(F.col("k").cast("long").alias("k"), "c")


@query("""WITH e AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT user_id, n::INT AS n, event_id FROM e WHERE n <= 2""")
def first_two_events(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _t(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("user_id", "n", "event_id")


@query("""WITH h AS (SELECT c_custkey::VARCHAR AS file, ['A', 'a', '', c_mktsegment, 'A'] AS cells FROM customer)
SELECT file, unnest([0, 1, 2, 3, 4])::INT AS pos, unnest(['A', 'a_2', 'Column_3', cells[4], 'A_3']) AS name FROM h""")
def cleaned_header_names(spark, sf_dir):
    h = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("file"), F.lit("s").alias("sheet"), F.array(F.lit("A"), F.lit(" a "), F.lit(None).cast("string"), F.col("c_mktsegment"), F.lit("A")).alias("cells"))
    return headers.cleaned_names(h).select("file", "pos", "name")


@query("""SELECT 'customer' AS src, c_custkey AS k, c_mktsegment AS seg FROM customer""")
def columns_that_hold_something(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.lit("customer").alias("src"), F.col("c_custkey").alias("k"), F.lit(" ").alias("empty"), F.col("c_mktsegment").alias("seg"), F.lit(None).cast("string").alias("none"))
    return union.without_empty_columns(c, ["empty", "seg", "none"])


@query("""WITH t AS (SELECT o_orderkey AS k, '[' || replace(o_orderpriority || ']x', ']', ']]') || ']' AS bracketed, '{' || replace(o_comment_, '}', '}}') || '}' AS quoted FROM (SELECT *, o_orderstatus || '}' AS o_comment_ FROM orders))
SELECT k, bracketed, quoted, 'UID=u;PWD=***;X=' || k AS scrubbed FROM t""")
def quoted_identifiers(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    return o.select(k.alias("k"), tx.bracketed(F.concat("o_orderpriority", F.lit("]x"))).alias("bracketed"), tx.odbc_quoted(F.concat("o_orderstatus", F.lit("}"))).alias("quoted"), tx.scrubbed(F.concat(F.lit("UID=u;PWD={a;b"), k.cast("string"), F.lit("};X="), k.cast("string"))).alias("scrubbed"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN doc_id % 10 = 0 THEN 'ocr' ELSE 'native' END AS kind FROM documents), s AS (SELECT doc_id % 7 AS file, kind FROM d)
SELECT file, count(*) AS pages, count(*) FILTER (kind = 'native') AS native, count(*) FILTER (kind = 'ocr') AS ocr, count(*) FILTER (kind = 'empty') AS empty FROM s GROUP BY file""")
def pages_by_reading(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select((F.col("doc_id") % 7).alias("file"), F.col("text"), (F.col("doc_id") % 10 == 0).alias("by_ocr"))
    return recon.page_kinds(d, "file", "text", "by_ocr")


# Layout rules over words ----------------------------------------------------------------------------------------------


def _page_words(spark, sf_dir):
    """A page per order with a line of words per lineitem: id at 20, name at 120, number at 300; some lines have no id."""
    li = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"))
    y = (F.col("l_linenumber") * 12 + 40).cast("double")
    head = F.array(*[F.struct(F.lit(x).alias("x0"), F.lit(28.0).alias("top"), F.lit(t).alias("text")) for x, t in ((20.0, "ID"), (120.0, "NAME"), (300.0, "SSN"))])
    word = lambda x, t: F.struct(F.lit(x).alias("x0"), y.alias("top"), t.alias("text"))
    row = F.array(word(20.0, F.when(F.col("l_linenumber") % 3 != 2, F.lpad(F.col("part").cast("string"), 6, "0"))), word(120.0, F.concat(F.lit("N"), F.translate(F.col("part").cast("string"), "0123456789", "abcdefghij"))), word(300.0, F.when(F.col("l_linenumber") % 3 != 2, F.concat(F.lit("100-20-"), F.lpad(F.col("supp").cast("string"), 4, "0")))))
    lines = li.select(F.col("l_orderkey").cast("string").alias("file"), F.lit(1).alias("page"), F.explode(row).alias("w"))
    heads = li.select(F.col("l_orderkey").cast("string").alias("file"), F.lit(1).alias("page")).distinct().select("file", "page", F.explode(head).alias("w"))
    return lines.unionByName(heads).filter("w.text is not null").select("file", "page", "w.x0", (F.col("w.x0") + 40).alias("x1"), "w.top", (F.col("w.top") + 9).alias("bottom"), "w.text")


_PAGE_SQL = """li AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp FROM lineitem GROUP BY 1, 2),
r AS (SELECT l_orderkey::VARCHAR AS file, l_linenumber AS n, CASE WHEN l_linenumber % 3 <> 2 THEN lpad(part::VARCHAR, 6, '0') ELSE '' END AS id, 'N' || translate(part::VARCHAR, '0123456789', 'abcdefghij') AS name, CASE WHEN l_linenumber % 3 <> 2 THEN '100-20-' || lpad(supp::VARCHAR, 4, '0') ELSE '' END AS ssn FROM li)"""


@query(f"""WITH {_PAGE_SQL}, g AS (SELECT *, sum((id <> '')::INT) OVER (PARTITION BY file ORDER BY n) AS b FROM r)
SELECT file, max(id) AS id, string_agg(name, ' ' ORDER BY n) AS name, max(ssn) AS ssn FROM g WHERE b > 0 GROUP BY file, b""")
def banded_table_rows(spark, sf_dir):
    ls = lines.page_lines(_page_words(spark, sf_dir), ["file", "page"], "anchor", 4.0)
    return extract.banded_rows(ls, {"id": ("ID",), "name": ("NAME",), "ssn": ("SSN",)}).select("file", "id", "name", "ssn")


@query(f"""WITH {_PAGE_SQL} SELECT file, ssn, name, id AS student_id FROM r WHERE ssn <> ''""")
def rows_by_number(spark, sf_dir):
    ls = lines.page_lines(_page_words(spark, sf_dir), ["file", "page"], "anchor", 4.0)
    return extract.id_lines(ls).select("file", "ssn", "name", "student_id")


@query(f"""WITH {_PAGE_SQL} SELECT file, string_agg(name, ' ' ORDER BY n) AS text FROM (SELECT file, n, name FROM r UNION ALL SELECT DISTINCT file, 0, 'NAME' FROM r) GROUP BY file""")
def cropped_column(spark, sf_dir):
    crop = extract.cropped_text(_page_words(spark, sf_dir), 100.0, 200.0)
    return crop.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda s: s["text"]), " ").alias("text"))


@query(f"""WITH {_PAGE_SQL} SELECT file, 1 AS page, CASE WHEN count(*) FILTER (ssn <> '') > 0 THEN 'table' END AS layout FROM r GROUP BY file""")
def page_layouts(spark, sf_dir):
    ls = lines.page_lines(_page_words(spark, sf_dir), ["file", "page"], "anchor", 4.0)
    return extract.layouts(ls, {"table": ("ID NAME SSN", "100-20-"), "form": ("NAME", "EMPLOYER")})


@query(f"""WITH {_PAGE_SQL}, k AS (SELECT *, CASE WHEN ssn <> '' THEN 's' || ssn ELSE 'n' || name END AS k FROM r)
SELECT file, name, ssn FROM k QUALIFY row_number() OVER (PARTITION BY file, k ORDER BY n) = 1""")
def people_once(spark, sf_dir):
    ls = lines.page_lines(_page_words(spark, sf_dir), ["file", "page"], "anchor", 4.0).filter("line_no > 0")
    get = lambda x: F.coalesce(F.get(F.transform(F.filter("words", lambda w: w["x0"] == x), lambda w: w["text"]), F.lit(0)), F.lit(""))
    return extract.unique_people(ls.select("file", get(120.0).alias("name"), get(300.0).alias("ssn"), "line_no"), ["line_no"]).select("file", "name", "ssn")


@query(f"""WITH {_PAGE_SQL}, t AS (SELECT DISTINCT file, 40.0 + 12 * n AS top FROM r UNION SELECT file, 28.0 FROM r), g AS (SELECT file, lead(top) OVER (PARTITION BY file ORDER BY top) - top AS gap FROM t), m AS (SELECT file, list_sort(list(gap)) AS gaps FROM g WHERE gap IS NOT NULL GROUP BY file)
SELECT file, 9.0::DOUBLE AS height, gaps[len(gaps) // 2 + 1]::DOUBLE AS gap FROM m""")
def page_measures(spark, sf_dir):
    return lines.measures(_page_words(spark, sf_dir), ["file", "page"]).select("file", "height", "gap")


@query("""WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY text, role) AS k FROM conversations) SELECT conv_id, count(*) AS rows, max(turn)::INT AS last FROM c WHERE k = 1 AND conv_id % 3 = 0 GROUP BY conv_id""")
def records_over_pages(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").filter("conv_id % 3 = 0").select("conv_id", "turn").distinct()
    rows = c.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").cast("int").alias("page"), F.concat(F.lit("n"), F.col("turn").cast("string")).alias("name"), F.lit("1").alias("id"))
    # Every page's record has identity, so none joins another.
    return extract.carried_over_pages(rows, ["name", "id"], ["page"]).groupBy(F.col("file").cast("long").alias("conv_id")).agg(F.count("*").alias("rows"), F.max("page").alias("last"))


@query("""SELECT 'Sheet' AS sheet, row_no::INT AS row_no, v AS c1, CASE WHEN row_no = 1 THEN 'c65' ELSE '' END AS c65 FROM (SELECT 1 AS row_no, 'c1' AS v, 0 AS k UNION ALL SELECT 1 + row_number() OVER (ORDER BY o_orderkey), o_orderkey::VARCHAR, o_orderkey FROM orders)""")
def merged_wide_rows(spark, sf_dir):
    """A folder of one wide text file, written from the orders, merged: 65 columns of which 64 are blank."""
    folder = f"{shared_dir(spark).rstrip('/')}/merge-{uuid.uuid4().hex}"
    # The keys are sorted, not the rows: the file is one, so one task writes it.
    keys = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("at")).union(spark.range(1).select(F.lit(None).cast("long"), F.lit(0)))
    row = F.when(F.col("at") == 0, ",".join(f"c{i}" for i in range(1, 66))).otherwise(F.concat(F.col("o_orderkey").cast("string"), F.lit("," * 64)))
    keys.coalesce(1).sortWithinPartitions("at", "o_orderkey").select(row.alias("value")).write.text(f"{folder}/in")
    out = consolidate.merged(spark, f"{folder}/in", [f"c{i}" for i in range(1, 66)])
    return out.select(F.lit("Sheet").alias("sheet"), "row_no", "c1", "c65")
