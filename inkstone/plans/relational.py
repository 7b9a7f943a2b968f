"""Queries of the operator kit on the star schema, the events and the pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import dims
from inkstone.functions import scalars as S
from inkstone.operators import intervals as I
from inkstone.operators import relations as R

from .base import by_key, query, table


@query("""SELECT event_id, last_view FROM (SELECT event_id, event_type, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM events) WHERE event_type = 'click'""")
def asof_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    views = e.filter("event_type = 'view'").withColumn("view", F.col("event_id"))
    found = I.as_of(e.filter("event_type = 'click'"), views, "user_id", ["ts", "event_id"], "view", ["ts", "event_id"])
    return found.select("event_id", F.col("last_view"))


@query("SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id, event_type")
def modifier_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.last_wins(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "value")


@query("""SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 5000 THEN c_mktsegment END, CASE WHEN n_nationkey > 12 THEN n_name END, r_name) AS label,
  coalesce(CASE WHEN c_acctbal < 0 THEN c_nationkey END, n_regionkey) AS code FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""")
def property_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    own = {"label": F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")), "code": F.when(F.col("c_acctbal") < 0, F.col("c_nationkey"))}
    middle = {"label": F.coalesce(F.when(F.col("n_nationkey") > 12, F.col("n_name")), F.col("r_name")), "code": F.col("n_regionkey")}
    return joined.select("c_custkey", *R.overlay(own, middle))


@query("""WITH RECURSIVE up AS (SELECT p_partkey AS id, 0 AS depth, p_partkey AS node, CASE WHEN p_size > 40 THEN p_brand END AS brand, CASE WHEN p_retailprice > 1000 THEN p_type END AS kind FROM part
  UNION ALL SELECT u.id, u.depth + 1, p.p_partkey, coalesce(u.brand, CASE WHEN p_size > 40 THEN p_brand END), coalesce(u.kind, CASE WHEN p_retailprice > 1000 THEN p_type END)
  FROM up u JOIN part p ON p.p_partkey = u.node // 2 AND u.node > 0)
SELECT id, depth, brand, kind FROM up WHERE node = 0""")
def style_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    nodes = part.select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_partkey") > 0, F.expr("p_partkey div 2")).alias("parent"),
        F.when(F.col("p_size") > 40, F.col("p_brand")).alias("brand"),
        F.when(F.col("p_retailprice") > 1000, F.col("p_type")).alias("kind"),
    )
    return R.chain(spark, nodes, "id", "parent", ["brand", "kind"]).select("id", "depth", "brand", "kind")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round_even(100 + (l_quantity - 1) * (l_linenumber * 37) / 8.0, 0)::BIGINT AS x,
  CASE WHEN l_suppkey % 3 > 0 THEN round_even((l_partkey - l_linenumber) * 200 / (l_suppkey % 3)::DOUBLE, 0)::BIGINT END AS y FROM lineitem""")
def group_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    lit = lambda v: F.lit(v).cast("double")
    x = S.affine(F.col("l_quantity"), (lit(1), lit(9)), (lit(100), lit(100) + F.col("l_linenumber") * 37))
    y = S.affine(F.col("l_partkey").cast("double"), (F.col("l_linenumber").cast("double"), F.col("l_linenumber") + (F.col("l_suppkey") % 3).cast("double")), (lit(0), lit(200)))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x"), y.alias("y"))


@query("""SELECT p_partkey, CASE WHEN c = 4278190080 THEN 'auto' ELSE printf('%02X%02X%02X', c & 255, (c >> 8) & 255, (c >> 16) & 255) END AS rgb
FROM (SELECT p_partkey, CASE WHEN p_size > 45 THEN 4278190080 ELSE (p_partkey * 40503) & 16777215 END AS c FROM part)""")
def colorref_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.when(F.col("p_size") > 45, F.lit(0xFF000000)).otherwise((F.col("p_partkey") * 40503).bitwiseAND(F.lit(0xFFFFFF)))
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", S.colorref(F.col("c")).alias("rgb"))


@query("""SELECT o_orderkey, CASE WHEN t <> 0 THEN strftime(make_timestamp(t // 10 - 11644473600000000), '%Y-%m-%dT%H:%M:%SZ') END AS iso
FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE (epoch_us(o_orderdate) + o_custkey * 1000000 + 11644473600000000) * 10 END AS t FROM orders)""")
def filetime_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = F.unix_micros(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") * 1_000_000 + 11_644_473_600_000_000
    ticks = F.when(F.col("o_orderstatus") == "P", F.lit(0).cast("bigint")).otherwise(micros * 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", ticks.alias("t")).select("o_orderkey", S.filetime(F.col("t")).alias("iso"))


@query(r"""WITH u AS (SELECT page_id, unnest([url, replace(url, 'http', 'HTTP'), 'java' || 'script:' || url, url || ' x', 'mailto:' || page_id || '@example.com', 'https://', 'ftp://example.com/' || page_id]) AS target FROM pages)
SELECT page_id, target, NOT regexp_matches(target, '[\s\x00-\x20\x7f]') AND regexp_matches(target, '^(?i:https?://[^/?#]+|mailto:.)') AS safe FROM u""")
def hyperlink_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id").cast("string")
    some = F.array(url, F.replace(url, F.lit("http"), F.lit("HTTP")), F.concat(F.lit("javascript:"), url), F.concat(url, F.lit(" x")), F.concat(F.lit("mailto:"), page, F.lit("@example.com")), F.lit("https://"), F.concat(F.lit("ftp://example.com/"), page))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(some).alias("target")).withColumn("safe", S.hyperlink_safe(F.col("target")))


@query(r"""WITH i AS (SELECT page_id, unnest([' hyperlink \o "' || url || '" \t', 'REF ' || page_id || ' \h', 'HYPERLINK "' || url || '"', '= 1 + ' || page_id, 'SEQ \* "a\"b" x']) AS ins FROM pages)
SELECT page_id, ins, CASE WHEN ltrim(ins) LIKE '=%' THEN '=' ELSE upper(regexp_extract(ins, '^\s*(\S+)', 1)) END AS kind,
  coalesce(nullif(regexp_replace(regexp_extract(ins, '^\s*\S+\s+(?:\\\S+\s+)*"((?:[^"\\]|\\.)*)"', 1), '\\(.)', '\1', 'g'), ''), nullif(regexp_extract(ins, '^\s*\S+\s+(?:\\\S+\s+)*([^\s"\\]+)', 1), '')) AS argument FROM i""")
def field_first_arg(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, page = F.col("url"), F.col("page_id").cast("string")
    some = F.array(F.concat(F.lit(' hyperlink \\o "'), url, F.lit('" \\t')), F.concat(F.lit("REF "), page, F.lit(" \\h")), F.concat(F.lit('HYPERLINK "'), url, F.lit('"')), F.concat(F.lit("= 1 + "), page), F.lit('SEQ \\* "a\\"b" x'))
    ins = table(spark, sf_dir, "pages").select("page_id", F.explode(some).alias("ins"))
    return ins.select("page_id", "ins", S.field_type(F.col("ins")).alias("kind"), S.field_argument(F.col("ins")).alias("argument"))


@query("""SELECT event_id, k.kind, k.class, coalesce(k.class = 'live', false) AS live FROM events LEFT JOIN (VALUES ('view', 'PAGE', 'live'), ('click', 'HYPERLINK', 'target'), ('signup', 'DDE', 'active'), ('purchase', 'SEQ', 'target')) k(t, kind, class) ON event_type = k.t""")
def field_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = spark.createDataFrame([("view", "PAGE"), ("click", "HYPERLINK"), ("signup", "DDE"), ("purchase", "SEQ")], "t string, kind string")
    known = F.broadcast(named.join(dims.field_classes(spark), "kind"))  # five rows at any scale
    return table(spark, sf_dir, "events").join(known, F.col("event_type") == F.col("t"), "left").select("event_id", "kind", "class", F.coalesce(F.col("class") == "live", F.lit(False)).alias("live"))


@query(r"""WITH t AS (SELECT page_id, i, tags[i] AS tag FROM (SELECT page_id, tags, unnest(range(1, len(tags) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '</?[a-zA-Z][a-zA-Z0-9]*') AS tags FROM pages)))
SELECT page_id, i - 1 AS i, tag, (sum(CASE WHEN tag LIKE '</%' THEN -1 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY i))::BIGINT AS depth FROM t""")
def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("</?[a-zA-Z][a-zA-Z0-9]*"), 0)).alias("i", "tag"))
    closes = F.col("tag").startswith("</")
    return R.bracket_depth(tags, ["page_id"], ["i"], ~closes, closes).select("page_id", F.col("i").cast("bigint").alias("i"), "tag", F.col("depth").cast("bigint").alias("depth"))


@query("""WITH t AS (SELECT page_id, lower(regexp_replace(url, '[?#].*$', '')) AS target FROM pages)
SELECT page_id, target, first_value(page_id) OVER (PARTITION BY target ORDER BY page_id) AS owner, row_number() OVER (PARTITION BY target ORDER BY page_id) > 1 AS collides FROM t""")
def dest_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("target").orderBy("page_id")
    named = table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_replace("url", r"[?#].*$", "")).alias("target"))
    return named.select("page_id", "target", F.first("page_id").over(w).alias("owner"), (F.row_number().over(w) > 1).alias("collides"))


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49)")
def anti_missing_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, used = table(spark, sf_dir, "part").select("p_partkey", "p_name"), table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select("l_partkey")
    return R.missing(part, used, part["p_partkey"] == used["l_partkey"])


@query("""WITH e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS a FROM events)
SELECT i.event_id AS inner_id, o.event_id AS outer_id FROM (SELECT user_id, event_id, a, a + 1 AS b FROM e WHERE event_type = 'error') i JOIN (SELECT user_id, event_id, a, a + 7200000000 AS b FROM e WHERE event_type = 'view') o
ON i.user_id = o.user_id AND o.a <= i.a AND i.b <= o.b""")
def contain_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"))
    inner = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("inner_id"), F.col("a").alias("i0"), (F.col("a") + 1).alias("i1"))
    outer = e.filter("event_type = 'view'").select("user_id", F.col("event_id").alias("outer_id"), F.col("a").alias("o0"), (F.col("a") + 7_200_000_000).alias("o1"))
    return I.contain_join(inner, outer, "user_id", ("i0", "i1"), ("o0", "o1")).select("inner_id", "outer_id")


@query("""WITH b AS (SELECT l_orderkey AS k, l_linenumber + 4 * (l_partkey & 3) AS l, l_linenumber + 4 * (l_partkey & 3) + l_quantity::INT AS r, l_partkey, l_suppkey, l_linenumber FROM lineitem),
e AS (SELECT k, edge, row_number() OVER (PARTITION BY k ORDER BY edge) - 1 AS c FROM (SELECT k, l AS edge FROM b UNION SELECT k, r FROM b))
SELECT b.k, b.l_linenumber, b.l_partkey, b.l_suppkey, x.c AS first, y.c - x.c AS span FROM b JOIN e x ON x.k = b.k AND x.edge = b.l JOIN e y ON y.k = b.k AND y.edge = b.r""")
def grid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.col("l_linenumber") + 4 * F.col("l_partkey").bitwiseAND(F.lit(3).cast("bigint"))
    b = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_partkey", "l_suppkey", left.alias("l"), (left + F.col("l_quantity").cast("bigint")).alias("r"))
    return R.grid(b, "k", "row", "l", "r").select("k", "l_linenumber", "l_partkey", "l_suppkey", F.col("first").cast("bigint").alias("first"), F.col("span").cast("bigint").alias("span"))


@query("""WITH m AS (SELECT l_orderkey, l_quantity, sum(CASE WHEN l_returnflag = 'N' AND n > 1 THEN 0 ELSE 1 END) OVER w AS cell FROM (SELECT *, row_number() OVER w AS n FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity))
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING))
SELECT l_orderkey, cell::BIGINT AS cell, sum(l_quantity)::BIGINT AS width, count(*) AS span FROM m GROUP BY l_orderkey, cell""")
def merge_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    return R.merged_cells(table(spark, sf_dir, "lineitem"), ["l_orderkey"], order, F.col("l_returnflag") == "N", F.col("l_quantity").cast("bigint"))


@query("""SELECT count(*) AS file_count, (count(*) FILTER (WHERE html LIKE '<!DOCTYPE html>%'))::BIGINT AS succeeded, (count(*) FILTER (WHERE html IS NULL OR html NOT LIKE '<!DOCTYPE html>%'))::BIGINT AS failed,
  sum(len(html) - len(replace(html, '***', '')))::BIGINT // 3 AS warning_count FROM pages""")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.coalesce(F.col("html").startswith("<!DOCTYPE html>"), F.lit(False))
    marks = F.length("html") - F.length(F.replace(F.col("html"), F.lit("***"), F.lit("")))
    total = table(spark, sf_dir, "pages").agg(F.count("*").alias("file_count"), F.count_if(good).alias("succeeded"), F.count_if(~good).alias("failed"), F.sum(marks).alias("marks"))
    return total.select("file_count", "succeeded", "failed", F.expr("marks div 3").alias("warning_count"))


@query("""WITH b AS (SELECT p_size, p_partkey, p_partkey AS l, p_partkey + p_size AS r, p_size * 2 AS t, p_size * 2 + p_partkey % 7 AS u FROM part)
SELECT i.p_partkey FROM b i WHERE EXISTS (SELECT 1 FROM b o WHERE o.p_size = i.p_size AND o.p_partkey <> i.p_partkey AND o.l <= i.l AND i.r <= o.r + 8 AND o.t <= i.t AND i.u <= o.u)""")
def rect_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_partkey").alias("l"), (F.col("p_partkey") + F.col("p_size")).alias("r"), (F.col("p_size") * 2).alias("t"), (F.col("p_size") * 2 + F.col("p_partkey") % 7).alias("u"))
    return R.contained_2d(p, p, "p_size", "p_partkey", slack=8).select("p_partkey")


@query("""WITH t AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events WHERE event_type = 'view'),
r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord FROM events WHERE event_type = 'click')
SELECT user_id, ord, r.event_id AS reference, t.event_id AS body FROM r FULL JOIN t USING (user_id, ord)""")
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    refs, texts = (e.filter(F.col("event_type") == kind).select("user_id", "ts", "event_id") for kind in ("click", "view"))
    return R.positional(refs, texts, "user_id", ["ts", "event_id"], "event_id", "reference", "body")


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS picture_id FROM events")
def dense_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", rank.alias("stream"))
    return e.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("stream", "ts", "event_id")).cast("bigint").alias("picture_id"))


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type IN ('view', 'click', 'signup') AS opens FROM events),
d AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) - CASE WHEN opens THEN 0 ELSE -1 END AS level FROM m),
p AS (SELECT *, lead(event_id) OVER w AS partner, lead(opens) OVER w AS next_opens FROM d WINDOW w AS (PARTITION BY user_id, level ORDER BY ts, event_id))
SELECT user_id, event_id, level::BIGINT AS level, CASE WHEN NOT next_opens THEN partner END AS partner FROM p WHERE opens""")
def bracket_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.col("event_type").isin("view", "click", "signup").alias("opens"))
    return R.bracket_match(marks, ["user_id"], ["ts", "event_id"], "opens", "event_id").select("user_id", "event_id", F.col("level").cast("bigint").alias("level"), "partner")


@query("""WITH o AS (SELECT l_orderkey, l_linenumber AS lo, l_linenumber + (l_suppkey & 3) AS hi, l_partkey * 100 + l_suppkey AS ord, l_shipdate FROM lineitem WHERE l_returnflag = 'R'),
c AS (SELECT DISTINCT l_orderkey, l_linenumber AS cell FROM lineitem)
SELECT c.l_orderkey, c.cell, max(o.ord) AS style FROM c LEFT JOIN o ON o.l_orderkey = c.l_orderkey AND o.lo <= c.cell AND c.cell < o.hi GROUP BY ALL""")
def cell_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = by_key(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_suppkey", "l_partkey"), "l_orderkey")
    cells = li.select("l_orderkey", F.col("l_linenumber").alias("cell")).distinct()
    ranges = li.filter("l_returnflag = 'R'").select("l_orderkey", F.col("l_linenumber").alias("lo"), (F.col("l_linenumber") + F.col("l_suppkey").bitwiseAND(F.lit(3).cast("bigint"))).alias("hi"), (F.col("l_partkey") * 100 + F.col("l_suppkey")).alias("style"))
    return R.range_overrides(cells, ranges, ["l_orderkey"], "cell", "lo", "hi", "style", "style")


@query("""SELECT a.user_id FROM (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events WHERE value > 1 GROUP BY user_id) a JOIN (SELECT user_id, list_sort(list(DISTINCT event_type)) AS s FROM events GROUP BY user_id) b ON a.user_id = b.user_id AND a.s = b.s""")
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 1, F.col("event_type"))).alias("some"), F.collect_set("event_type").alias("all"))
    return sets.filter((F.size("some") > 0) & (F.size(F.array_except("all", "some")) == 0) & (F.size(F.array_except("some", "all")) == 0)).select("user_id")


@query("SELECT p_partkey FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') UNION SELECT * FROM (SELECT p_partkey FROM part WHERE p_size > 40 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.07)")
def set_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, li = table(spark, sf_dir, "part"), table(spark, sf_dir, "lineitem")
    gone = part.select("p_partkey").subtract(li.filter("l_returnflag = 'R'").select("l_partkey"))
    both = part.filter("p_size > 40").select("p_partkey").intersect(li.filter("l_tax > 0.07").select("l_partkey"))
    return gone.union(both).distinct()


@query("""SELECT c_nationkey, c_custkey, c_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3""")
def top_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return table(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_acctbal", F.row_number().over(w).alias("n")).filter("n <= 3").drop("n")


@query("""WITH d(lid, tag) AS (VALUES (1033, 'en-US'), (1031, 'de-DE'), (1036, 'fr-FR'), (1034, 'es-ES'), (255, 'zxx'))
SELECT doc_id, CASE lang WHEN 'en' THEN 1033 WHEN 'de' THEN 1031 WHEN 'fr' THEN 1036 WHEN 'es' THEN 1034 ELSE 255 END AS lid, coalesce(tag, 'und') AS tag FROM documents LEFT JOIN d ON d.lid = CASE lang WHEN 'en' THEN 1033 WHEN 'de' THEN 1031 WHEN 'fr' THEN 1036 WHEN 'es' THEN 1034 ELSE 255 END""")
def language_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    lid = F.when(F.col("lang") == "en", 1033).when(F.col("lang") == "de", 1031).when(F.col("lang") == "fr", 1036).when(F.col("lang") == "es", 1034).otherwise(255)
    docs = table(spark, sf_dir, "documents").select("doc_id", lid.alias("lid"))
    return docs.join(F.broadcast(dims.languages(spark)), "lid", "left").select("doc_id", "lid", F.coalesce("tag", F.lit("und")).alias("tag"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN v = 0 THEN 'auto' WHEN l_returnflag = 'A' THEN 'auto' WHEN v < 0 THEN 'exact' ELSE 'atLeast' END AS spacing,
  CASE WHEN i = 0 OR i = -2047 THEN NULL ELSE abs(i) END AS list_id,
  CASE WHEN (l_partkey * 7 + 500) // 1000 BETWEEN 15 AND 31680 THEN (l_partkey * 7 + 500) // 1000 END AS scaled, l_linenumber / 20.0::DOUBLE AS points,
  l_linenumber::BIGINT * 635 AS emu, ((l_partkey & 65535) >> 10) & 7 AS sgc, [1, 1, 2, 4, 2, 2, -1, 3][((l_partkey & 65535) >> 13) + 1] AS operand
FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN -l_linenumber ELSE l_linenumber - 1 END AS v, l_linenumber - 3 AS i FROM lineitem)""")
def paragraph_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    v = F.when(F.col("l_linestatus") == "F", -F.col("l_linenumber")).otherwise(F.col("l_linenumber") - 1)
    code = F.col("l_partkey").bitwiseAND(F.lit(65535).cast("bigint"))
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        S.line_spacing(v, F.col("l_returnflag") == "A").alias("spacing"),
        S.list_index(F.col("l_linenumber") - 3).alias("list_id"),
        S.scaled(F.col("l_partkey"), F.lit(7)).alias("scaled"),
        S.twips_to_points(F.col("l_linenumber")).alias("points"),
        S.twips_to_emu(F.col("l_linenumber")).alias("emu"),
        S.sprm_group(code).alias("sgc"),
        S.sprm_size(code).alias("operand"),
    )


@query("""SELECT c_custkey, CASE b WHEN 0 THEN false WHEN 1 THEN true WHEN 128 THEN s WHEN 129 THEN NOT s END AS bold FROM (SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'MACHINERY' THEN 1 WHEN 'HOUSEHOLD' THEN 128 WHEN 'AUTOMOBILE' THEN 129 ELSE 2 END AS b, coalesce(c_acctbal > 0, false) AS s FROM customer)""")
def toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg = F.col("c_mktsegment")
    b = F.when(seg == "BUILDING", 0).when(seg == "MACHINERY", 1).when(seg == "HOUSEHOLD", 0x80).when(seg == "AUTOMOBILE", 0x81).otherwise(2)
    return table(spark, sf_dir, "customer").select("c_custkey", S.toggle(b, F.col("c_acctbal") > 0).alias("bold"))


@query("""WITH l AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 1 WHEN o_orderstatus = 'O' THEN 2 ELSE 3 END AS level, o_orderdate FROM orders),
a AS (SELECT *, count(*) FILTER (WHERE level = 1) OVER w AS n1, count(*) FILTER (WHERE level < 3) OVER w AS above FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))
SELECT o_custkey, o_orderkey, n1::VARCHAR || '.' || (count(*) FILTER (WHERE level = 2) OVER (PARTITION BY o_custkey, n1 ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::VARCHAR
  || '.' || (count(*) FILTER (WHERE level = 3) OVER (PARTITION BY o_custkey, above ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING))::VARCHAR || ')' AS label FROM a""")
def list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).otherwise(3).alias("level"))
    numbered = R.list_numbers(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "level", 3)
    return numbered.select("o_custkey", "o_orderkey", S.list_label(F.lit("%1.%2.%3)"), [F.col(f"n{k}") for k in (1, 2, 3)]).alias("label"))


@query("""SELECT n_name, p.k AS bookmark FROM nation JOIN (SELECT DISTINCT lower(r_name) AS k FROM region UNION SELECT lower(n_name) FROM nation WHERE n_regionkey > 1) p ON lower(n_name) = p.k""")
def name_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = r.select(F.lower("r_name").alias("bookmark")).union(n.filter("n_regionkey > 1").select(F.lower("n_name"))).distinct()
    return n.join(names, F.lower("n_name") == F.col("bookmark")).select("n_name", "bookmark")


@query("""SELECT user_id, string_agg(m || ':' || event_id, ' ' ORDER BY ts, k, event_id) AS marks FROM (SELECT user_id, ts, event_id, CASE event_type WHEN 'error' THEN 0 ELSE 1 END AS k, CASE event_type WHEN 'error' THEN 'end' ELSE 'start' END AS m FROM events WHERE event_type IN ('error', 'signup')) GROUP BY user_id""")
def boundary_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter(F.col("event_type").isin("error", "signup"))
    k = F.when(F.col("event_type") == "error", 0).otherwise(1)
    marks = F.array_sort(F.collect_list(F.struct(F.col("ts"), k.alias("k"), F.col("event_id"))))
    text = F.array_join(F.transform(marks, lambda m: F.concat(F.when(m["k"] == 0, "end:").otherwise("start:"), m["event_id"].cast("string"))), " ")
    return e.groupBy("user_id").agg(text.alias("marks"))
