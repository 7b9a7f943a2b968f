"""Queries on stories: paragraphs, character positions, spans, tallies over the text of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions import scalars as S
from inkstone.operators import intervals as I
from inkstone.operators import relations as R

from .base import query, table

#: The paragraphs of a story: a last terminator adds none, and an empty story has one.
PARAGRAPHS = """
paras AS (SELECT doc_id, i - 1 AS ix, ps[i] AS p FROM (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM (
  SELECT doc_id, CASE WHEN len(s) > 1 AND s[len(s)] = '' THEN s[1:len(s) - 1] ELSE s END AS ps
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)))),
spans AS (SELECT doc_id, ix, len(p) + 1 AS n, (sum(len(p) + 1) OVER (PARTITION BY doc_id ORDER BY ix))::BIGINT AS cp_end FROM paras),
par AS (SELECT doc_id, ix, cp_end - n AS cp_start, cp_end FROM spans)"""


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, ix, p``: a generator inside the scan's stage."""
    s = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    whole = docs.select("doc_id", s.alias("s"))
    cut = F.when((F.size("s") > 1) & (F.element_at("s", -1) == ""), F.slice("s", 1, F.size("s") - 1)).otherwise(F.col("s"))
    return whole.select("doc_id", F.posexplode(cut).alias("ix", "p"))


def paragraph_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, ix, cp_start, cp_end``: lengths are shuffled, texts are not."""
    lengths = paragraphs(docs).select("doc_id", F.col("ix").cast("bigint").alias("ix"), (S.utf16_width(F.col("p")).cast("bigint") + 1).alias("n"))
    return I.offsets(lengths, "doc_id", ["ix"], F.col("n")).select("doc_id", "ix", "cp_start", "cp_end")


def pieces(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, piece, p_start, p_end``: the text and its last terminator in pieces of a fixed width."""
    n = S.utf16_width(F.coalesce("text", F.lit(""))).cast("bigint")
    ends = F.coalesce(F.col("text").endswith("\n"), F.lit(False)) & (n > 0)
    sized = docs.select("doc_id", F.when(ends, n).otherwise(n + 1).alias("n"))
    each = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {width}"))).alias("piece"))
    return each.select("doc_id", "piece", (F.col("piece") * width).alias("p_start"), F.least("n", (F.col("piece") + 1) * width).alias("p_end"))


def _piece_sql(width: int) -> str:
    return f"""piece AS (SELECT doc_id, piece, piece * {width} AS p_start, least(n, (piece + 1) * {width}) AS p_end
  FROM (SELECT doc_id, n, unnest(range(0, (n - 1) // {width} + 1)) AS piece FROM (SELECT doc_id, max(cp_end) AS n FROM par GROUP BY doc_id)))"""


@query(f"WITH {PARAGRAPHS} SELECT doc_id, count(*) AS paragraphs FROM paras GROUP BY doc_id")
def story_paragraph_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    n = F.size(F.split(text, "\n", -1))
    return table(spark, sf_dir, "documents").select("doc_id", F.when((n > 1) & text.endswith("\n"), n - 1).otherwise(n).cast("bigint").alias("paragraphs"))


@query(f"WITH {PARAGRAPHS} SELECT * FROM par")
def story_cp_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_spans(table(spark, sf_dir, "documents"))


@query(f"WITH {PARAGRAPHS}, {_piece_sql(4096)} SELECT par.doc_id, piece, ix, greatest(p_start, cp_start) AS start, least(p_end, cp_end) AS stop FROM par JOIN piece ON par.doc_id = piece.doc_id AND p_start < cp_end AND cp_start < p_end")
def piece_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = I.overlap_join(pieces(docs, 4096), paragraph_spans(docs), ["doc_id"], ("p_start", "p_end"), ("cp_start", "cp_end"), "start", "stop")
    return both.select("doc_id", "piece", "ix", "start", "stop")


@query(f"""WITH {PARAGRAPHS}, {_piece_sql(1000)},
edge AS (SELECT doc_id, cp_start AS e FROM par UNION SELECT doc_id, cp_end FROM par UNION SELECT doc_id, p_start FROM piece UNION SELECT doc_id, p_end FROM piece),
unit AS (SELECT doc_id, e AS cp_start, lead(e) OVER (PARTITION BY doc_id ORDER BY e) AS cp_end FROM edge)
SELECT u.doc_id, u.cp_start, u.cp_end, p.piece, q.ix FROM unit u JOIN piece p ON p.doc_id = u.doc_id AND p.p_start <= u.cp_start AND u.cp_end <= p.p_end
JOIN par q ON q.doc_id = u.doc_id AND q.cp_start <= u.cp_start AND u.cp_end <= q.cp_end""")
def span_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    a = pieces(docs, 1000).select("doc_id", F.col("p_start").alias("cp_start"), F.col("p_end").alias("cp_end"), "piece")
    return I.compose(a, paragraph_spans(docs), "doc_id", "piece", "ix").select("doc_id", "cp_start", "cp_end", "piece", "ix")


@query(f"""WITH {PARAGRAPHS}, flag AS (SELECT doc_id, ix, cp_start, cp_end, cp_end - cp_start > 60 AS long FROM par),
mark AS (SELECT *, CASE WHEN long IS DISTINCT FROM lag(long) OVER w THEN 1 ELSE 0 END AS new FROM flag WINDOW w AS (PARTITION BY doc_id ORDER BY ix)),
run AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ix) AS g FROM mark)
SELECT doc_id, long, min(cp_start) AS cp_start, max(cp_end) AS cp_end FROM run GROUP BY doc_id, g, long""")
def span_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = paragraph_spans(table(spark, sf_dir, "documents")).withColumn("long", F.col("cp_end") - F.col("cp_start") > 60)
    return I.coalesce(spans, ["doc_id"], ["long"]).select("doc_id", "long", "cp_start", "cp_end")


@query(f"""WITH {PARAGRAPHS}, g AS (SELECT doc_id, cp_start, cp_end, lag(cp_end) OVER w AS before, lead(cp_start) OVER w AS after FROM par WINDOW w AS (PARTITION BY doc_id ORDER BY ix))
SELECT doc_id, count(*) AS spans, (count(*) FILTER (WHERE before = cp_start))::BIGINT AS touching, (count(*) FILTER (WHERE after < cp_end))::BIGINT AS overlapping FROM g GROUP BY doc_id""")
def plc_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("ix")
    g = paragraph_spans(table(spark, sf_dir, "documents")).select("doc_id", "cp_start", "cp_end", F.lag("cp_end").over(w).alias("before"), F.lead("cp_start").over(w).alias("after"))
    return g.groupBy("doc_id").agg(F.count("*").alias("spans"), F.count_if(F.col("before") == F.col("cp_start")).alias("touching"), F.count_if(F.col("after") < F.col("cp_end")).alias("overlapping"))


@query("SELECT doc_id, regexp_replace(concat(text, chr(1), chr(11), chr(31), 'z'), '[^\\x09\\x0A\\x0D\\x20-\\x{D7FF}\\x{E000}-\\x{FFFD}\\x{10000}-\\x{10FFFF}]', '�', 'g') AS clean FROM documents")
def xml_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.xml_clean(F.concat(F.coalesce("text", F.lit("")), F.lit("\x01\x0b\x1fz"))).alias("clean"))


@query("""WITH b AS (SELECT doc_id, list_transform(range(1, len(source) + 1), lambda i: ascii(source[i])) AS bytes FROM documents),
f AS (SELECT doc_id, len(bytes) AS n, list_reduce(list_concat([0], list_reverse(bytes)), lambda h, x: xor(((h >> 14) & 1) | ((h << 1) & 32767), x)) AS h FROM b)
SELECT doc_id, xor(xor(((h >> 14) & 1) | ((h << 1) & 32767), n), 52811)::INT AS verifier FROM f""")
def xor_verifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.sequence(F.lit(1), F.length("source")), lambda i: F.ascii(F.substring(F.col("source"), i, F.lit(1))))
    filled = F.when(F.length("source") > 0, points).otherwise(F.array().cast("array<int>"))
    return table(spark, sf_dir, "documents").select("doc_id", S.xor_verifier(filled).cast("int").alias("verifier"))


@query("SELECT doc_id, text_md5 FROM (SELECT doc_id, md5(text) AS text_md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A minimum by key combines map-side; ranking would shuffle every row.
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("text_md5"))
    return hashed.groupBy("text_md5").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text_md5")


@query("SELECT source, n_chars, count(*) AS n, count(DISTINCT md5(text)) AS variants, count(DISTINCT md5(text)) > 1 AS fatal FROM documents GROUP BY ALL HAVING count(*) > 1")
def dup_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = table(spark, sf_dir, "documents").select("source", "n_chars", F.md5("text").alias("signature"))
    return R.conflicts(keyed, ["source", "n_chars"], F.col("signature")).withColumn("fatal", F.col("variants") > 1)


@query("""SELECT doc_id, CASE WHEN d IS NOT NULL AND l IS NOT NULL THEN 'both' WHEN d IS NOT NULL THEN 'document' ELSE 'label' END AS side
FROM (SELECT DISTINCT doc_id, 1 AS d FROM documents) FULL JOIN (SELECT DISTINCT doc_id, 1 AS l FROM labels) USING (doc_id)""")
def full_outer_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t).select("doc_id").distinct() for t in ("documents", "labels"))
    return R.full_outer(docs, labels, "doc_id", "document", "label")


_CODES = """SELECT doc_id, lang, unnest(list_filter([CASE WHEN coalesce(text, '') = '' THEN 'EMPTY_STORY' END, CASE WHEN len(text) > 4000 THEN 'LONG_STORY' END,
  CASE WHEN text LIKE '%' || chr(10) || chr(10) || '%' THEN 'EMPTY_PARAGRAPH' END, CASE WHEN NOT coalesce(text, '') LIKE '%' || chr(10) THEN 'UNTERMINATED' END], lambda c: c IS NOT NULL)) AS code FROM documents"""


def diagnostics(docs: DataFrame) -> DataFrame:
    """``doc_id, lang, code``: recoverable findings about each story."""
    text = F.coalesce("text", F.lit(""))
    codes = F.array(
        F.when(text == "", "EMPTY_STORY"),
        F.when(F.length("text") > 4000, "LONG_STORY"),
        F.when(F.col("text").contains("\n\n"), "EMPTY_PARAGRAPH"),
        F.when(~text.endswith("\n"), "UNTERMINATED"),
    )
    return docs.select("doc_id", "lang", F.explode(F.array_compact(codes)).alias("code"))


@query(f"SELECT lang, count(*) AS n, string_agg(DISTINCT code, ',' ORDER BY code) AS codes, (count(*) FILTER (WHERE code = 'LONG_STORY'))::BIGINT AS long_stories FROM ({_CODES}) GROUP BY lang")
def diag_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics(table(spark, sf_dir, "documents"))
    return found.groupBy("lang").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("code"))).alias("codes"), F.count_if(F.col("code") == "LONG_STORY").alias("long_stories"))


@query(f"SELECT doc_id, count(*) AS warnings FROM ({_CODES}) GROUP BY doc_id ORDER BY warnings DESC, doc_id LIMIT 20")
def top_docs_by_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diagnostics(table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("warnings"))
    return found.orderBy(F.col("warnings").desc(), "doc_id").limit(20)


@query("""SELECT source, count(*) AS documents, sum(n_chars)::BIGINT AS chars, (count(*) FILTER (WHERE text LIKE '%' || chr(10) || '%'))::BIGINT AS multi_paragraph,
  sum(len(string_split(coalesce(text, ''), chr(10))))::BIGINT AS lines, (count(*) FILTER (WHERE lang = 'en'))::BIGINT AS english, max(n_chars) AS longest,
  (count(*) FILTER (WHERE regexp_matches(text, '[0-9]')))::BIGINT AS with_digits, (count(*) FILTER (WHERE regexp_matches(text, 'https?://')))::BIGINT AS with_urls FROM documents GROUP BY source""")
def stats_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return (
        table(spark, sf_dir, "documents")
        .groupBy("source")
        .agg(
            F.count("*").alias("documents"),
            F.sum("n_chars").alias("chars"),
            F.count_if(text.contains("\n")).alias("multi_paragraph"),
            F.sum(F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1))).alias("lines"),
            F.count_if(F.col("lang") == "en").alias("english"),
            F.max("n_chars").alias("longest"),
            F.count_if(text.rlike("[0-9]")).alias("with_digits"),
            F.count_if(text.rlike("https?://")).alias("with_urls"),
        )
    )


@query("SELECT doc_id, lang, CASE WHEN lang IS NULL THEN 'missing' ELSE 'named' END AS fate FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("known"))
    return R.missing(docs, labels, docs["doc_id"] == labels["known"]).withColumn("fate", F.when(F.col("lang").isNull(), "missing").otherwise("named"))


@query("""SELECT role, count(*) AS runs, sum(n)::BIGINT AS turns, max(n)::BIGINT AS longest FROM (SELECT conv_id, role, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM (SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations))
  GROUP BY conv_id, g, role) GROUP BY role""")
def run_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    runs = I.islands(turns, ["conv_id"], ["turn"], ["role"]).groupBy("conv_id", "island", "role").agg(F.count("*").alias("n"))
    return runs.groupBy("role").agg(F.count("*").alias("runs"), F.sum("n").alias("turns"), F.max("n").alias("longest"))


@query("""WITH m AS (SELECT conv_id, turn, role, text, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM conversations),
r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS g FROM m)
SELECT conv_id, role, min(turn) AS first_turn, max(turn) AS last_turn, string_agg(text, chr(10) ORDER BY turn) AS text FROM r GROUP BY conv_id, g, role""")
def run_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = I.islands(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], ["role"])
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    joined = F.concat_ws("\n", F.transform(parts, lambda p: p["text"]))
    return runs.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), joined.alias("text")).drop("island")
