"""Queries of the service's side and of glyphs: profiles, requests, offline translations, font dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import glyphs, offline, service
from quire.plans import views as V
from quire.plans.catalog import UTF16, query

FIRST = '{"id":"a","preset":"openai","label":"","model":" m-a ","temperature":0.7}'
SECOND = '{"id":"b","preset":"nowhere","label":"B","baseURL":" https://b/v1 ","apiKey":"k","model":"","concurrency":2,"jsonMode":false,"maxTokens":64}'
THIRD = '{"id":"ollama","preset":"ollama","label":"Mine","model":"q"}'


def settings(spark, d):
    """One row a conversation turn: five stored lists, two of them unreadable, six active ids, flat settings now and then."""
    t = V.read(spark, d, "conversations").select("conv_id", "turn", (F.col("conv_id") * 7 + F.col("turn")).alias("n"))
    n = F.col("n")
    lists = F.when(n % 5 == 0, F.lit("[]")).when(n % 5 == 1, F.lit(f"[{FIRST},{SECOND},{THIRD}]")).when(n % 5 == 2, F.lit(f"[{SECOND}]")).when(n % 5 == 3, F.lit(f"[{FIRST},")).otherwise(F.lit(FIRST))
    active = F.element_at(F.array(*[F.lit(v) for v in ("a", "b", "ollama", "", "openai", "none")]), (n % 6 + 1).cast("int"))
    return t.select(
        F.concat_ws(":", "conv_id", "turn").alias("setting_id"), lists.alias("providers"), active.alias("active"), F.when(n % 7 == 0, F.lit(" https://flat/v1 ")).otherwise(F.lit("")).alias("base_url"),
        F.lit("").alias("api_key"), F.when(n % 4 == 0, F.lit("flat")).otherwise(F.lit("")).alias("model"), F.when(n % 3 == 0, 0.1).alias("temperature"), F.lit(None).cast("int").alias("concurrency"),
    )


PRESETS = "presets(ord, id, label, url, model, json) AS (VALUES " + ", ".join("(" + ", ".join([str(k), *(f"'{v}'" for v in p[:4]), str(p[4]).lower()]) + ")" for k, p in enumerate(service.PRESETS)) + ")"
SETTINGS = f"""{PRESETS}, stored(kind, pos, id, preset, label, url, model, temp, conc, json, tokens) AS (VALUES (1, 0, 'a', 'openai', '', '', ' m-a ', 0.7::DOUBLE, NULL::INT, NULL::BOOLEAN, NULL::INT),
  (1, 1, 'b', 'nowhere', 'B', ' https://b/v1 ', '', NULL, 2, false, 64), (1, 2, 'ollama', 'ollama', 'Mine', '', 'q', NULL, NULL, NULL, NULL), (2, 0, 'b', 'nowhere', 'B', ' https://b/v1 ', '', NULL, 2, false, 64)),
s AS (SELECT conv_id || ':' || turn AS setting_id, n % 5 AS kind, (['a', 'b', 'ollama', '', 'openai', 'none'])[CAST(n % 6 + 1 AS INTEGER)] AS active, CASE WHEN n % 7 = 0 THEN 'https://flat/v1' END AS flat_url,
  CASE WHEN n % 4 = 0 THEN 'flat' END AS flat_model, CASE WHEN n % 3 = 0 THEN 0.1::DOUBLE END AS flat_temp FROM (SELECT conv_id, turn, conv_id * 7 + turn AS n FROM conversations) t)"""


@query(
    "q72_active_profiles",
    f"""WITH {SETTINGS}, o AS (SELECT s.*, st.*, row_number() OVER (PARTITION BY s.setting_id ORDER BY CASE WHEN st.id = s.active THEN 0 ELSE 1 END, st.pos) AS rn FROM s LEFT JOIN stored st ON st.kind = s.kind),
p AS (SELECT o.*, q.id AS pid, q.url AS purl, q.model AS pmodel, q.json AS pjson FROM o JOIN presets q ON q.id = coalesce((SELECT r.id FROM presets r WHERE r.id = CASE WHEN o.pos IS NULL THEN coalesce(nullif(o.active, ''), 'deepseek') ELSE o.preset END), 'custom') WHERE rn = 1),
f AS (SELECT setting_id, CASE WHEN pos IS NULL THEN pid ELSE id END AS profile_id, trim(coalesce(flat_url, nullif(url, ''), purl)) AS base_url, trim(coalesce(flat_model, nullif(model, ''), CASE WHEN pos IS NULL THEN pmodel END, '')) AS model,
  coalesce(flat_temp, temp, 0.2) AS temperature, coalesce(conc, 4) AS concurrency, tokens AS max_tokens, CAST(coalesce(CASE WHEN pos IS NULL THEN pjson ELSE json END, true) AS INTEGER) AS json_mode FROM p)
SELECT *, CASE WHEN base_url = '' THEN 'No service is configured.' WHEN model = '' THEN 'No model is configured.' END AS error FROM f""",
)
def _(spark, d):
    got = service.active_profiles(settings(spark, d)).drop("api_key", "extra_body")
    return got.withColumn("json_mode", F.col("json_mode").cast("int"))


@query(
    "q73_offered_profiles",
    f"""WITH {SETTINGS}, e AS (SELECT s.setting_id, 0 AS part, p.ord, p.id AS profile_id, p.label FROM s CROSS JOIN presets p WHERE NOT EXISTS (SELECT 1 FROM stored st WHERE st.kind = s.kind AND st.id = p.id)
  UNION ALL SELECT s.setting_id, 1, st.pos, st.id, coalesce(nullif(st.label, ''), st.id) FROM s JOIN stored st ON st.kind = s.kind)
SELECT setting_id, CAST(row_number() OVER (PARTITION BY setting_id ORDER BY part, ord) - 1 AS INTEGER) AS position, profile_id, label FROM e""",
)
def _(spark, d):
    return service.offered_profiles(settings(spark, d))


@query(
    "q74_request_bodies",
    V.with_("units")
    + """SELECT doc_id, para_index, 'm' || doc_id % 3 AS model, md5(source) AS user_md5, 'Into ' || CASE doc_id % 3 WHEN 0 THEN 'Simplified Chinese' WHEN 1 THEN 'German' ELSE 'xx' END || '.' AS system,
  CASE WHEN para_index % 5 = 1 THEN '1' WHEN para_index % 2 = 0 THEN '0.5' ELSE '0.2' END AS temperature, CASE WHEN para_index % 5 = 1 THEN '9' WHEN para_index % 3 = 1 THEN '100' END AS max_tokens,
  CASE WHEN para_index % 5 = 1 THEN '0.9' END AS top_p, CASE WHEN doc_id % 2 = 0 THEN 'json_object' WHEN para_index % 5 = 1 THEN 'text' END AS form FROM units""",
)
def _(spark, d):
    p, doc = F.col("para_index"), F.col("doc_id")
    tag = F.when(doc % 3 == 0, F.lit("zh-CN")).when(doc % 3 == 1, F.lit("de")).otherwise(F.lit("xx"))
    system = F.concat(F.lit("Into "), X.language_name(tag), F.lit("."))
    extra = F.when(p % 5 == 1, F.lit('{"temperature":1,"max_tokens":9,"top_p":0.9,"response_format":{"type":"text"}}')).when(p % 5 == 2, F.lit("no object"))
    body = service.request_body(
        F.concat(F.lit("m"), (doc % 3).cast("string")), system, F.col("source"), F.when(p % 2 == 0, 0.5), F.when(p % 3 == 0, 0).when(p % 3 == 1, 100), extra, doc % 2 == 0,
    )
    b = V.units(spark, d).select("doc_id", "para_index", body.alias("body"))
    field = lambda path: F.get_json_object("body", path)
    return b.select(
        "doc_id", "para_index", field("$.model").alias("model"), F.md5(field("$.messages[1].content")).alias("user_md5"), field("$.messages[0].content").alias("system"),
        F.regexp_replace(field("$.temperature"), r"\.0$", "").alias("temperature"), field("$.max_tokens").alias("max_tokens"), field("$.top_p").alias("top_p"), field("$.response_format.type").alias("form"),
    )


PAGES = f"""p AS (SELECT doc_id, para_index // 5 AS page_index, para_index, source, {UTF16('source')} AS n, para_index % 9 = 8 AS formula FROM units),
t AS (SELECT doc_id, page_index, regexp_replace(string_agg(source, ' ' ORDER BY para_index), '{X.WHITE}', '', 'g') AS txt FROM p WHERE page_index % 4 <> 3 GROUP BY ALL),
h AS (SELECT p.*, t.txt, CAST(floor(n / greatest(sum(n) OVER (PARTITION BY doc_id, page_index), 1) * length(txt) + 0.5) AS INTEGER) AS share FROM p LEFT JOIN t USING (doc_id, page_index) WHERE NOT formula),
c AS (SELECT *, coalesce(sum(share) OVER (PARTITION BY doc_id, page_index ORDER BY para_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begun FROM h)"""


@query(
    "q75_page_shares",
    V.with_("units", more=PAGES) + "SELECT doc_id, page_index, para_index, md5(coalesce(nullif(substr(txt, CAST(begun AS BIGINT) + 1, greatest(share, 4)), ''), '【译】' || source)) AS translated_md5 FROM c",
)
def _(spark, d):
    p = F.col("para_index")
    u = V.units(spark, d).select("doc_id", F.expr("para_index div 5").alias("page_index"), "para_index", "source", (p % 9 == 8).alias("formula"))
    lines = F.array_sort(F.collect_list(F.struct("para_index", "source")))
    pages = u.where("page_index % 4 <> 3").groupBy("doc_id", "page_index").agg(F.array_join(F.transform(lines, lambda x: x["source"]), " ").alias("text"))
    return offline.page_shares(u, pages).select("doc_id", "page_index", "para_index", F.md5("translated").alias("translated_md5"))


@query(
    "q76_cache_by_source",
    V.with_("units", "cache") + "SELECT doc_id, count(*) FILTER (c.source IS NOT NULL) AS hit, count(*) FILTER (c.source IS NULL) AS miss FROM units u LEFT JOIN cache c ON c.source = u.source WHERE u.para_index % 9 <> 8 GROUP BY doc_id",
)
def _(spark, d):
    entries = V.cache(spark, d).select(X.cache_key(F.md5(F.lit("any")), F.col("source")).alias("key"), "translated", "ord")
    u = V.units(spark, d).withColumn("formula", F.col("para_index") % 9 == 8)
    return offline.hits(offline.by_source(u, entries))


def shown(spark, d):
    """Each line of a document sets a font (even lines only), and inside save and restore another one; it is shown in both, with micro signs for m and ligatures for f."""
    p = F.col("para_index")
    parts = {"unicode": F.split(F.translate("source", "mf", "µﬁ"), ""), "font_char": F.transform(F.split("source", ""), lambda c: F.concat(F.lit("g"), c)), "width": F.transform(F.sequence(p * 7, p * 7 + F.length("source") - 1), lambda n: 300.0 + n % 50)}
    u = V.units(spark, d).select("doc_id", "para_index", *[c.alias(n) for n, c in parts.items()]).withColumn("glyph", F.arrays_zip(*parts))
    glyph = F.col("glyph")  # made once a line, and shown twice
    none = F.lit(None).cast("array<struct<unicode: string, font_char: string, width: double>>")
    step = lambda op, font=None, g=none: F.struct(F.lit(op).alias("op"), (F.lit(None).cast("string") if font is None else font).alias("font_id"), g.alias("glyphs"))
    outer, inner = F.concat(F.lit("A"), (p % 3).cast("string")), F.concat(F.lit("B"), (p % 2).cast("string"))
    steps = F.array(step("restore"), step("save"), step("setFont", inner), step("showText", g=glyph), step("restore"), step("showText", g=glyph))
    all_steps = F.when(p % 2 == 0, F.concat(F.array(step("setFont", outer)), steps)).otherwise(steps)
    ops = u.select("doc_id", F.lit(0).alias("page_index"), "para_index", F.posexplode(all_steps).alias("k", "s"))
    return ops.select("doc_id", "page_index", (F.col("para_index").cast("long") * 10 + F.col("k")).alias("seq"), "s.op", "s.font_id", "s.glyphs")


SHOWN = """o AS (SELECT doc_id, para_index, source, coalesce('A' || max(CASE WHEN para_index % 2 = 0 THEN para_index END) OVER (PARTITION BY doc_id ORDER BY para_index) % 3, '') AS outer_font FROM units),
g AS (SELECT doc_id, para_index, source, 'B' || para_index % 2 AS font_id, 0 AS part FROM o UNION ALL SELECT doc_id, para_index, source, outer_font, 1 FROM o),
c AS (SELECT doc_id, para_index, font_id, part, unnest(string_split(source, '')) AS c, generate_subscripts(string_split(source, ''), 1) - 1 AS i FROM g),
k AS (SELECT *, CASE c WHEN 'm' THEN 'µ' WHEN 'f' THEN 'ﬁ' ELSE c END AS ch, 0 AS way FROM c UNION ALL SELECT *, CASE c WHEN 'm' THEN 'μ' ELSE 'fi' END, 1 FROM c WHERE c IN ('m', 'f')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, font_id, ch ORDER BY para_index, part, i, way) AS rn FROM k)"""


@query("q77_glyph_dictionary", V.with_("units", more=SHOWN) + "SELECT doc_id, font_id, ch, 'g' || c AS font_char, 300.0::DOUBLE + (para_index * 7 + i) % 50 AS width FROM r WHERE rn = 1")
def _(spark, d):
    return glyphs.glyph_dictionary(shown(spark, d)).drop("page_index")


@query(
    "q78_glyph_positions",
    V.with_("units", more="""d AS (SELECT doc_id % 3 AS doc, ascii(ch) AS a, ch, 200.0::DOUBLE + ascii(ch) % 90 AS w FROM (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,-', '')) AS ch), (VALUES (0), (1)) v(doc_id)),
c AS (SELECT doc_id, para_index, unnest(string_split(source, '')) AS ch, generate_subscripts(string_split(source, ''), 1) AS pos FROM units),
j AS (SELECT c.*, CASE WHEN c.ch = ' ' THEN 250.0 ELSE d.w END AS w, c.ch <> ' ' AS drawn FROM c LEFT JOIN d ON d.doc = c.doc_id % 3 AND d.ch = c.ch),
b AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY doc_id, para_index ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(w) OVER (PARTITION BY doc_id, para_index) AS total FROM j)""")
    + """SELECT doc_id, para_index, CAST(bool_and(w IS NOT NULL) AND doc_id % 3 < 2 AS INTEGER) AS whole, CASE WHEN bool_and(w IS NOT NULL) AND doc_id % 3 < 2 THEN count(*) FILTER (drawn) END AS n,
  CASE WHEN bool_and(w IS NOT NULL) AND doc_id % 3 < 2 THEN round(max(before / total * 500.0) FILTER (drawn), 4) END AS last FROM b GROUP BY doc_id, para_index""",
)
def _(spark, d):
    """Lines as runs; the font's letters are known in two of three documents, and documents of the third kind have no font."""
    u = V.units(spark, d).select("doc_id", F.lit(0).alias("page_index"), F.col("para_index").alias("id"), F.lit("F").alias("font_id"), F.col("source").alias("text"), F.lit(500.0).alias("width"))
    letters = F.split(F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ.,-"), "")
    docs = u.select("doc_id", "page_index", "font_id").distinct().where("doc_id % 3 < 2")
    known = docs.select("*", F.explode(F.filter(letters, lambda c: c != "")).alias("ch")).select("*", F.concat(F.lit("g"), "ch").alias("font_char"), (200.0 + F.ascii("ch") % 90).alias("width"))
    fonts = docs.select("doc_id", "font_id", F.lit(1000.0).alias("units_per_em"), F.lit(None).cast("double").alias("space_width"))
    got = glyphs.glyph_positions(u, known, fonts)
    return got.select("doc_id", F.col("id").alias("para_index"), F.col("glyphs").isNotNull().cast("int").alias("whole"), F.when(F.col("glyphs").isNotNull(), F.size("glyphs").cast("long")).alias("n"), F.round(F.array_max(F.transform("glyphs", lambda g: g["x"])), 4).alias("last"))


@query(
    "q79_font_names",
    V.with_("units", more="f AS (SELECT DISTINCT doc_id, 'f' || para_index % 4 AS font_id FROM units WHERE para_index % 4 <> 3)")
    + "SELECT u.doc_id, para_index, CASE WHEN para_index % 11 = 10 THEN '' WHEN para_index % 4 = 2 OR f.font_id IS NULL THEN 'f' || para_index % 4 ELSE 'Name-' || f.font_id END AS font FROM units u LEFT JOIN f ON f.doc_id = u.doc_id AND f.font_id = 'f' || u.para_index % 4",
)
def _(spark, d):
    font = F.concat(F.lit("f"), (F.col("para_index") % 4).cast("string"))
    u = V.units(spark, d).select("doc_id", "para_index", font.alias("font_id"))
    fonts = u.where("para_index % 4 <> 3").distinct().select("doc_id", "font_id", F.when(F.col("font_id") == "f2", F.lit("")).otherwise(F.concat(F.lit("Name-"), "font_id")).alias("name"))
    runs = u.withColumn("font_id", F.when(F.col("para_index") % 11 != 10, F.col("font_id")))
    return glyphs.with_font_names(runs, fonts).select("doc_id", "para_index", "font")


@query("q80_unmapped_blanks", V.with_("units") + "SELECT doc_id, para_index, md5(regexp_replace(source, '[^a-zA-Z ]', ' ', 'g')) AS drawn_md5 FROM units")
def _(spark, d):
    return V.units(spark, d).select("doc_id", "para_index", F.md5(glyphs.blank_unmapped(F.col("source"), "[a-zA-Z ]")).alias("drawn_md5"))
