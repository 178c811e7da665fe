"""Further queries: run geometry, joins of lines, styles, trims and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import replies as R
from quire.operators import styles
from quire.plans import views as V
from quire.plans.catalog import query

ITEMS = """i AS (SELECT page, id, CASE id % 3 WHEN 0 THEN 0.15 WHEN 1 THEN 0.0 ELSE 2.0 END AS slope, "left" AS e, top AS f, "right" - "left" AS advance, CASE WHEN id % 4 = 0 THEN 'ABCDEF+Name' ELSE 'Name' END AS font_name, CASE WHEN id % 5 = 0 THEN ' ' ELSE 'x' END AS text FROM boxes),
r AS (SELECT *, 10.0 / sqrt(100 + slope * slope * 100) * advance AS dx, slope * 10 / sqrt(100 + slope * slope * 100) * advance AS dy FROM i)"""


@query(
    "q52_run_geometry",
    V.with_("boxes", more=ITEMS)
    + """SELECT page, id, round(e, 4) AS x, round(dx, 4) AS width, round(greatest(abs(dy), 11.8), 4) AS height, round(f - 8.8 - (greatest(abs(dy), 11.8) - 11.8) * (0.88 / 1.18), 4) AS y, regexp_replace(font_name, '^[^+]*\\+', '') AS font FROM r
  WHERE trim(text) <> '' AND dx > 0 AND abs(dy) <= 0.15 * abs(dx) + 1e-9""",
)
def _(spark, d):
    b = V.boxes(spark, d)
    k = F.col("id") % 3
    slope = F.when(k == 0, 0.15 - 1e-12).when(k == 1, 0.0).otherwise(2.0)
    items = b.select("page", "id", F.when(F.col("id") % 5 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("text"), F.when(F.col("id") % 4 == 0, F.lit("ABCDEF+Name")).otherwise(F.lit("Name")).alias("font_name"), F.lit(10.0).alias("a"), (slope * 10).alias("b"), F.lit(0.0).alias("c"), F.lit(10.0).alias("d"), F.col("left").alias("e"), F.col("top").alias("f"), (F.col("right") - F.col("left")).alias("advance"))
    r = styles.runs_of(items)
    return r.select("page", "id", *[F.round(c, 4).alias(c) for c in ("x", "width", "height", "y")], "font")


@query(
    "q53_formula_split",
    V.with_("runs", more="l AS (SELECT doc_id AS page, para_index // 8 AS para, para_index AS seq, CASE WHEN length(text) < 40 THEN 1 ELSE 0 END AS formula FROM runs), g AS (SELECT *, lag(formula) OVER (PARTITION BY page, para ORDER BY seq) AS p FROM l)")
    + "SELECT page, para, seq, sum(CASE WHEN p IS NOT NULL AND p <> formula THEN 1 ELSE 0 END) OVER (PARTITION BY page, para ORDER BY seq ROWS UNBOUNDED PRECEDING) AS part FROM g",
)
def _(spark, d):
    lines = V.runs(spark, d).select(F.col("doc_id").alias("page"), F.expr("para_index div 8").alias("para"), F.col("para_index").alias("seq"), (F.length("text") < 40).cast("int").alias("formula"))
    return styles.split_at_formulas(lines).select("page", "para", "seq", "part")


@query(
    "q54_line_join",
    V.with_("units", more="o AS (SELECT doc_id, source, row_number() OVER (PARTITION BY doc_id ORDER BY para_index) AS rn FROM units)", recursive=True)
    .rstrip("\n")
    + f""",
f AS (SELECT doc_id, rn, source AS t FROM o WHERE rn = 1 UNION ALL SELECT o.doc_id, o.rn, f.t || CASE WHEN regexp_matches(f.t, '[A-Za-z0-9)\\]\\x{{0370}}-\\x{{03ff}}]$') AND regexp_matches(o.source, '^[A-Za-z0-9(\\[\\x{{0370}}-\\x{{03ff}}]') THEN ' ' ELSE '' END || o.source FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1),
z AS (SELECT doc_id, arg_max(t, rn) AS t FROM f GROUP BY doc_id)
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '{V.W}+', ' ', 'g'), '^{V.W}+', ''), '{V.W}+$', '')) AS text_md5 FROM z""",
)
def _(spark, d):
    per = V.units(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_index", "source"))), lambda x: x["source"]).alias("parts"))
    return per.select("doc_id", F.md5(styles.join_lines(F.col("parts"))).alias("text_md5"))


@query(
    "q55_region_trim",
    V.with_("boxes", more="""p AS (SELECT page, id, "left", top, "right", bottom FROM boxes WHERE kind <> 0), g AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY id) AS k, "left" AS gl, top - 80 + 6 AS gt, "right" AS gr, bottom - 80 + 70 AS gb FROM boxes WHERE kind = 0),
  f AS (SELECT page, id, "left" AS l, "right" AS r, top AS t, bottom AS b, false AS blocked, 0 AS k FROM p UNION ALL
  SELECT f.page, f.id, l, r, CASE WHEN touch AND NOT low AND gb <= t + 10 AND gt <= t THEN gb + 0.5 ELSE t END, CASE WHEN low THEN gt - 0.5 ELSE b END, blocked OR (touch AND NOT low AND NOT (gb <= t + 10 AND gt <= t)), k
  FROM (SELECT f.page, f.id, l, r, t, b, blocked, g.k, gl, gt, gr, gb, (l <= gr AND r >= gl AND t <= gb AND b >= gt) AS touch, (l <= gr AND r >= gl AND t <= gb AND b >= gt AND gt >= b - 10 AND gb >= b) AS low FROM f JOIN g ON g.page = f.page AND g.k = f.k + 1) f),
  n AS (SELECT page, max(k) AS k FROM g GROUP BY page)""", recursive=True)
    + "SELECT f.page, f.id, round(t, 4) AS top, round(b, 4) AS bottom, CAST(blocked AS INTEGER) AS blocked FROM f LEFT JOIN n ON n.page = f.page WHERE f.k = coalesce(n.k, 0)",
)
def _(spark, d):
    b = V.boxes(spark, d)
    g = b.where("kind = 0").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("id", "left", (F.col("top") - 80 + 6).alias("top"), "right", (F.col("bottom") - 80 + 70).alias("bottom")))).alias("regions"))
    none = F.array().cast("array<struct<id:int,left:double,top:double,right:double,bottom:double>>")
    p = b.where("kind <> 0").join(g, "page", "left").withColumn("regions", F.coalesce("regions", none)).withColumn("size", F.lit(10.0))
    return styles.trim_to_regions(p).select("page", "id", F.round("top", 4).alias("top"), F.round("bottom", 4).alias("bottom"), F.col("blocked").cast("int").alias("blocked"))


@query(
    "q56_paragraph_styles",
    V.with_("runs", more="""s AS (SELECT doc_id AS page, para_index // 6 AS para, para_index AS seq, size + para_index % 3 AS size, y + 8.8 AS baseline, length(text) AS chars, CASE WHEN para_index % 2 = 0 THEN length(text) ELSE 0 END AS bold_chars FROM runs),
  t AS (SELECT *, baseline - lag(baseline) OVER (PARTITION BY page, para ORDER BY baseline, seq) AS step FROM s),
  a AS (SELECT page, para, list_sort(list(size)) AS ss, list_sort(list(step) FILTER (step > 0.5)) AS ts, sum(bold_chars) AS b, sum(chars) AS c, count(*) AS n FROM t GROUP BY page, para)""")
    + "SELECT page, para, round(ss[CAST(floor(len(ss) / 2) AS INTEGER) + 1], 4) AS size, round(coalesce(ts[CAST(floor(len(ts) / 2) AS INTEGER) + 1], ss[CAST(floor(len(ss) / 2) AS INTEGER) + 1] * 1.2), 4) AS leading, CAST(b > c * 0.6 AS INTEGER) AS bold, n AS lines FROM a",
)
def _(spark, d):
    p, n = F.col("para_index"), F.length("text")
    lines = V.runs(spark, d).select(F.col("doc_id").alias("page"), F.expr("para_index div 6").alias("para"), p.alias("seq"), (F.col("size") + p % 3).alias("size"), (F.col("y") + 8.8).alias("baseline"), n.alias("chars"), F.when(p % 2 == 0, n).otherwise(0).alias("bold_chars"))
    s = styles.paragraph_styles(lines)
    return s.select("page", "para", F.round("size", 4).alias("size"), F.round("leading", 4).alias("leading"), F.col("bold").cast("int").alias("bold"), "lines")


BODIES = """b AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CAST(json_object('error', json_object('message', role)) AS VARCHAR) WHEN 1 THEN CAST(json_object('choices', [json_object('message', json_object('content', role))], 'usage', json_object('total_tokens', length(text))) AS VARCHAR)
  WHEN 2 THEN CAST(json_object('message', role) AS VARCHAR) ELSE 'plain ' || role END AS body, text, role FROM conversations WHERE text IS NOT NULL)"""


@query("q57_reply_fields", f"WITH {BODIES} SELECT conv_id, turn, CASE turn % 4 WHEN 1 THEN left(body, 300) WHEN 3 THEN left(body, 300) ELSE role END AS error, CASE turn % 4 WHEN 1 THEN role END AS content, CASE turn % 4 WHEN 1 THEN length(text) END AS tokens FROM b")
def _(spark, d):
    k = F.col("turn") % 4
    body = (
        F.when(k == 0, F.to_json(F.struct(F.struct(F.col("role").alias("message")).alias("error"))))
        .when(k == 1, F.to_json(F.struct(F.array(F.struct(F.struct(F.col("role").alias("content")).alias("message"))).alias("choices"), F.struct(F.length("text").alias("total_tokens")).alias("usage"))))
        .when(k == 2, F.to_json(F.struct(F.col("role").alias("message"))))
        .otherwise(F.concat(F.lit("plain "), F.col("role")))
    )
    c = V.read(spark, d, "conversations").where("text IS NOT NULL").select("conv_id", "turn", body.alias("body"))
    return c.select("conv_id", "turn", R.error_summary(F.col("body")).alias("error"), R.completion_text(F.col("body")).alias("content"), R.total_tokens(F.col("body")).alias("tokens"))
