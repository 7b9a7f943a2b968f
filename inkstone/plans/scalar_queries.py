"""Queries of scalar and nested-value operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkstone.functions import dims
from inkstone.functions import scalars as S
from inkstone.operators import relations as R

from .base import query, table


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(printf('%.2f', f * 100 / 65536.0), '\\.?0+$', '') || '%' AS opacity FROM (SELECT *, (l_linenumber * 8192)::BIGINT AS f FROM lineitem)")
def opacity_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.opacity((F.col("l_linenumber") * 8192).cast("bigint")).alias("opacity"))


@query("""WITH p AS (SELECT user_id, event_id, (event_id * 7919) % 1000 AS x, (event_id * 104729) % 777 AS y FROM events),
b AS (SELECT *, min(x) OVER u AS x0, greatest(1, max(x) OVER u - min(x) OVER u) AS w, min(y) OVER u AS y0, greatest(1, max(y) OVER u - min(y) OVER u) AS h FROM p WINDOW u AS (PARTITION BY user_id))
SELECT user_id, event_id, round_even((x - x0) * 21600 / w, 0)::INT AS x, round_even((y - y0) * 21600 / h, 0)::INT AS y FROM b""")
def polygon_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = (F.col("event_id") * 7919) % 1000, (F.col("event_id") * 104729) % 777
    points = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", x.alias("x"), y.alias("y")))).alias("p"))
    both = F.arrays_zip(F.transform("p", lambda p: p["event_id"]).alias("event_id"), S.in_square(F.col("p")).alias("q"))
    return points.select("user_id", F.explode(both).alias("z")).select("user_id", "z.event_id", "z.q.x", "z.q.y")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size > 10 THEN p_size END, 5400) AS a0, coalesce(CASE WHEN p_size > 30 THEN p_size * 2 END, 10800) AS a1, 16200 AS a2 FROM part""")
def adjust_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.array(F.when(F.col("p_size") > 10, F.col("p_size")), F.when(F.col("p_size") > 30, F.col("p_size") * 2))
    merged = table(spark, sf_dir, "part").select("p_partkey", S.merged_list(own, [5400, 10800, 16200]).alias("a"))
    return merged.select("p_partkey", *[F.col("a")[k].alias(f"a{k}") for k in range(3)])


@query("""SELECT p_partkey, coalesce(string_split('decimal upperRoman lowerRoman upperLetter lowerLetter ordinal cardinalText ordinalText hex chicago ideographDigital japaneseCounting aiueo iroha decimalFullWidth decimalHalfWidth japaneseLegal japaneseDigitalTenThousand decimalEnclosedCircle decimalFullWidth2 '
  || 'aiueoFullWidth irohaFullWidth decimalZero bullet ganada chosung decimalEnclosedFullstop decimalEnclosedParen decimalEnclosedCircleChinese ideographEnclosedCircle ideographTraditional ideographZodiac ideographZodiacTraditional taiwaneseCounting ideographLegalTraditional taiwaneseCountingThousand taiwaneseDigital '
  || 'chineseCounting chineseLegalSimplified chineseCountingThousand decimal koreanDigital koreanCounting koreanLegal koreanDigital2 hebrew1 arabicAlpha hebrew2 arabicAbjad hindiVowels hindiConsonants hindiNumbers hindiCounting thaiLetters thaiNumbers thaiCounting vietnameseCounting numberInDash russianLower russianUpper', ' ')[p_size + 10], 'unsupported') AS format FROM part""")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.broadcast(dims.number_formats(spark))  # the codes of the format: a fixed size
    part = table(spark, sf_dir, "part").join(named, F.col("p_size") + 9 == F.col("code"), "left")
    return part.select("p_partkey", F.coalesce("name", F.lit("unsupported")).alias("format"))


@query("""SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id, event_type) AS n, (CASE WHEN value > 50 THEN 1 ELSE 0 END + CASE WHEN event_type = 'view' THEN 1 ELSE 0 END + 1)::INT AS present FROM events""")
def property_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = S.present(F.when(F.col("value") > 50, F.col("value")), F.when(F.col("event_type") == "view", F.lit(1)), F.col("props"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.count("*").over(Window.partitionBy("user_id", "event_type")).alias("n"), some.alias("present"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS sizes FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 10) GROUP BY user_id")
def secondary_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    kept = whole.select("user_id", F.array_sort(F.map_entries(F.map_filter("m", lambda _, n: n > 10))).alias("e")).filter(F.size("e") > 0)
    return kept.select("user_id", F.array_join(F.transform("e", lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("sizes"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def keep_last_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.keep_last(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT s_suppkey, CASE WHEN v IS NULL THEN '@' || CASE WHEN r > 32767 THEN r - 65537 ELSE r - 1 END ELSE v END AS x FROM (SELECT s_suppkey, r, CASE r WHEN 0 THEN 'left' WHEN 65532 THEN 'center' WHEN 65528 THEN 'right' WHEN 65524 THEN 'inside' WHEN 65520 THEN 'outside' END AS v
  FROM (SELECT s_suppkey, ([0, 65532, 65528, 65524, 65520, s_suppkey * 3, 65000 + s_suppkey])[s_suppkey % 7 + 1] AS r FROM supplier))""")
def frame_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    raw = F.element_at(F.array(*(F.lit(v).cast("bigint") for v in (0, 65532, 65528, 65524, 65520)), key * 3, key + 65000), (key % 7 + 1).cast("int"))
    names = {0: "left", 65532: "center", 65528: "right", 65524: "inside", 65520: "outside"}
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.place(raw, names).alias("x"))


@query("""SELECT page_id, ins, regexp_replace(ins, '^(\\s*)(?i:FTNREF)(\\s|$)', '\\1NOTEREF\\2') AS said FROM (SELECT page_id, unnest(['FTNREF a' || page_id || ' \\h', ' ftnref b', 'FTNREFS c', 'REF FTNREF', 'FTNREF']) AS ins FROM pages)""")
def field_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.array(F.concat(F.lit("FTNREF a"), F.col("page_id").cast("string"), F.lit(" \\h")), *(F.lit(x) for x in (" ftnref b", "FTNREFS c", "REF FTNREF", "FTNREF")))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(some).alias("ins")).withColumn("said", S.noteref(F.col("ins")))


@query("SELECT c_custkey, CASE WHEN lid = 1063 THEN 567 WHEN list_contains(string_split('1026 1027 1029 1030 1035 1038 1039 1043 1044 1045 1048 1051 1055 1058 1059 1060 1061 1067 1068 1069 1078 1079 1087 1088 1089 1092 2074', ' '), lid::VARCHAR) THEN 708 ELSE 720 END AS twips FROM (SELECT c_custkey, 1024 + c_custkey % 80 AS lid FROM customer)")
def header_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.header_distance(F.col("c_custkey") % 80 + 1024).alias("twips"))


@query("SELECT s_suppkey, id, regexp_full_match(id, '[A-Za-z.][A-Za-z0-9.]{0,38}') AS valid FROM (SELECT s_suppkey, unnest(['Word.Document.' || s_suppkey, s_suppkey || '.x', '', repeat('a', s_suppkey), 'a b', '.x']) AS id FROM supplier)")
def prog_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    some = F.array(F.concat(F.lit("Word.Document."), key), F.concat(key, F.lit(".x")), F.lit(""), F.repeat(F.lit("a"), F.col("s_suppkey").cast("int")), F.lit("a b"), F.lit(".x"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(some).alias("id")).withColumn("valid", S.ole_prog_id(F.col("id")))


@query("""WITH v AS (SELECT p.vec_id, p.embedding AS a, q.embedding AS b FROM embeddings p JOIN embeddings q ON q.vec_id = p.vec_id + 1),
x AS (SELECT vec_id, unnest(a)::DOUBLE AS a, unnest(b)::DOUBLE AS b FROM v)
SELECT vec_id, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) * (a - b))), 6) AS rmse,
  round((2 * avg(a) * avg(b) + 6.5025) * (2 * covar_pop(a, b) + 58.5225) / ((avg(a) * avg(a) + avg(b) * avg(b) + 6.5025) * (var_pop(a) + var_pop(b) + 58.5225)), 6) AS ssim FROM x GROUP BY vec_id""")
def page_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return R.picture_differences(e.join(other, "vec_id").select("vec_id", F.col("embedding").alias("a"), "b"), "vec_id", "a", "b")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT l_partkey) AS variants FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conflicts(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(CASE WHEN l_tax > 0.05 THEN (l_tax * 100)::INT * 20 END, CASE WHEN l_discount > 0.05 THEN (l_discount * 100)::INT * 30 END, (l_quantity * 10)::INT) AS width FROM lineitem")
def width_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    hundredths = lambda c: F.round(F.col(c) * 100).cast("int")
    width = F.coalesce(F.when(F.col("l_tax") > 0.05, hundredths("l_tax") * 20), F.when(F.col("l_discount") > 0.05, hundredths("l_discount") * 30), (F.col("l_quantity") * 10).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", width.alias("width"))


@query(r"""SELECT s_suppkey, CASE WHEN regexp_matches(s_name || CASE WHEN s_suppkey % 2 = 0 THEN chr(2) ELSE '' END, '[\x00-\x08]') THEN 'S' || s_suppkey ELSE s_name END AS font FROM supplier""")
def font_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat("s_name", F.when(F.col("s_suppkey") % 2 == 0, "\x02").otherwise(""))
    return table(spark, sf_dir, "supplier").select("s_suppkey", S.font_name(name, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).alias("font"))


@query("""SELECT c_custkey, n_name, coalesce(n_regionkey, -1) AS author, CASE WHEN n_name IS NULL THEN 'AUTHOR_MISSING' WHEN s IS NULL THEN 'RANGE_MISSING' END AS code, s AS range_start FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS s FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey""")
def comment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs, authors = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    ranges = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("range_start"))
    joined = refs.join(authors, F.col("n_nationkey") == F.col("c_nationkey"), "left").join(ranges, F.col("o_custkey") == F.col("c_custkey"), "left")
    code = F.when(F.col("n_name").isNull(), "AUTHOR_MISSING").when(F.col("range_start").isNull(), "RANGE_MISSING")
    return joined.select("c_custkey", "n_name", F.coalesce("n_regionkey", F.lit(-1)).alias("author"), code.alias("code"), "range_start")
