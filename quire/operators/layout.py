"""Reading order, paragraphs, gutters and regions, page by page, as windows and bounded joins.

Everything is keyed by page, so that a page's rows meet in one place and pages spread over the cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import geometry as G


def upper_median(values: Column) -> Column:
    """Element floor(n / 2) of the sorted array."""
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def reading_order(lines: DataFrame) -> DataFrame:
    """lines(page, id, col, x, y) plus seq from 1: spanning lines (col < 0) close a band; in a band the left column comes before the right."""
    by_place = Window.partitionBy("page").orderBy("y", "x", "id")
    band = F.sum(F.when(F.col("col") < 0, 1).otherwise(0)).over(by_place.rowsBetween(Window.unboundedPreceding, 0))
    part = F.when(F.col("col") < 0, 0).when(F.col("col") == 0, 1).otherwise(2)
    rows = lines.withColumn("band", band).withColumn("part", part)
    # within a column the order is by y with ties in place order, which is (y, x, id)
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy("page").orderBy("band", "part", "y", "x", "id"))).drop("band", "part")


def column_edges(lines: DataFrame, tolerance: float = 14) -> DataFrame:
    """Right edge of each line's column: the farthest right end among lines of the same column whose left ends are within tolerance."""
    near = Window.partitionBy("page", "col").orderBy("x").rangeBetween(-tolerance, tolerance)
    return lines.withColumn("edge", F.max(F.col("x") + F.col("width")).over(near))


def paragraphs(lines: DataFrame) -> DataFrame:
    """lines(page, seq, x, y, width, height, baseline, size, col, text) in reading order, plus para from 0.

    A line starts a paragraph when the column changes, sizes differ, a bullet or an indent opens it, or the line before ends or stands too far off.
    With a column bold, two bold lines around one middle are a heading: where they begin and end parts nothing."""
    order = Window.partitionBy("page").orderBy("seq")
    rows = column_edges(lines)
    rows = rows if "bold" in rows.columns else rows.withColumn("bold", F.lit(False))
    prev = {c: F.lag(c).over(order) for c in ("x", "y", "width", "height", "baseline", "size", "col", "text", "edge", "bold")}
    rows = rows.select("*", *[v.alias(f"p_{c}") for c, v in prev.items()])
    lead = F.greatest("p_size", "size")
    ratio = F.when(F.col("p_col") == F.col("col"), (F.col("baseline") - F.col("p_baseline")) / lead)
    rows = rows.withColumn("ratio", F.when((ratio > 0.85) & (ratio < 1.7), ratio))
    usual = F.coalesce(upper_median(F.collect_list("ratio").over(Window.partitionBy("page"))), F.lit(1.2))
    rows = rows.withColumn("usual", usual)
    bullet = r"^\s*[•●]"
    apart = F.abs(F.col("p_x") + F.col("p_width") / 2 - F.col("x") - F.col("width") / 2)
    free = ~(F.col("bold") & F.col("p_bold") & (apart < lead * 0.25))
    starts = F.col("p_x").isNotNull() & (
        (F.col("col") != F.col("p_col"))
        | (F.abs(F.col("size") - F.col("p_size")) > lead * 0.15)
        | F.col("text").rlike(bullet)
        | ((F.col("col") >= 0) & free & (F.col("x") > F.col("p_x") + lead * 0.65) & (F.col("x") < F.col("p_x") + lead * 3) & ~F.col("p_text").rlike(bullet))
        | (F.col("baseline") - F.col("p_baseline") > lead * F.col("usual") * 1.3)
        | (F.col("y") - (F.col("p_y") + F.col("p_height")) > lead * 0.65)
        | (free & (F.col("p_width") < F.greatest(F.col("p_edge") - F.col("p_x"), F.lit(1.0)) * 0.82))
        | (free & (F.col("x") > F.col("p_x") + F.greatest(F.lit(12.0), lead)))
    )
    return rows.withColumn("para", F.sum(F.when(starts, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))


def widest_gap(runs: DataFrame, low: float = 0.25, high: float = 0.75, least: float = 8, ems: float = 1.2) -> DataFrame:
    """runs(page, line, id, left, right, size) -> page, line, gap, centre of the widest gap in the middle of the block; the first of equals."""
    block = Window.partitionBy("page")
    line = Window.partitionBy("page", "line").orderBy("left", "id")
    rows = runs.select("*", F.min("left").over(block).alias("l"), F.max("right").over(block).alias("r"), F.lag("right").over(line).alias("end"), F.max("size").over(Window.partitionBy("page", "line")).alias("largest"))
    gap = F.col("left") - F.col("end")
    centre = F.col("end") + gap / 2
    width = F.col("r") - F.col("l")
    ok = (gap >= F.greatest(F.lit(float(least)), F.col("largest") * ems)) & (centre >= F.col("l") + width * low) & (centre <= F.col("l") + width * high)
    found = rows.where(ok).select("page", "line", gap.alias("gap"), centre.alias("centre"), F.col("left").alias("at"), "id")
    best = F.min_by(F.struct("gap", "centre"), F.struct((-F.col("gap")).alias("g"), "at", "id"))
    return found.groupBy("page", "line").agg(best.alias("b")).select("page", "line", "b.gap", "b.centre")


def assign_column(lines: DataFrame) -> DataFrame:
    """lines(left, right, gutter, gap_from, gap_to, threshold) plus col: 0 left, 1 right, -1 spanning, 2 to be split at the gap that holds the gutter."""
    inside = (F.col("gap_from") <= F.col("gutter")) & (F.col("gap_to") >= F.col("gutter")) & (F.col("gap_to") - F.col("gap_from") >= F.col("threshold"))
    col = F.when(F.col("gutter").isNull() | (F.col("right") <= F.col("gutter")), 0).when(F.col("left") >= F.col("gutter"), 1).when(F.coalesce(inside, F.lit(False)), 2).otherwise(-1)
    return lines.withColumn("col", col)


def needs_space(runs: DataFrame) -> DataFrame:
    """runs(page, line, id, left, right, size, text) plus space: 1 where a blank belongs before the run."""
    w = Window.partitionBy("page", "line").orderBy("left", "id")
    rows = runs.select("*", F.lag("text").over(w).alias("p_text"), F.lag("right").over(w).alias("p_right"), F.lag("size").over(w).alias("p_size"))
    gap = F.col("left") - F.col("p_right")
    blank = F.col("text").rlike(r"^\s") | F.col("p_text").rlike(r"\s$")
    wide = gap > F.greatest(F.lit(1.0), F.greatest("p_size", "size") * 0.22)
    word = (gap <= 0.5) & F.col("p_text").rlike(r"[\p{L}\p{N}]$") & F.col("text").rlike(r"^[\p{L}\p{N}]")
    return rows.withColumn("space", F.when(F.col("p_text").isNotNull() & ~blank & (wide | word), 1).otherwise(0)).drop("p_text", "p_right", "p_size")


def running_heads(lines: DataFrame, share: float = 0.4) -> DataFrame:
    """lines(doc, page, key) -> the keys on at least max(2, ceil(share * pages)) distinct pages of the document."""
    pages = lines.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    keys = lines.groupBy("doc", "key").agg(F.countDistinct("page").alias("n"))
    return keys.join(pages, "doc").where(F.col("n") >= F.greatest(F.lit(2), F.ceil(F.col("pages") * share))).select("doc", "key", "n")


def gutter_votes(votes: DataFrame, spread: float = 36, least: int = 6) -> DataFrame:
    """votes(page, v) -> page, n_votes, gutter: upper median of the largest cluster anchored at its first vote; null below least votes.

    The fold is over a page's sorted votes; a cluster is a run of votes within spread of its first."""
    per = votes.groupBy("page").agg(F.array_sort(F.collect_list("v")).alias("vs"))
    zero = F.struct(F.lit(0).alias("start"), F.lit(0).alias("best"), F.lit(0).alias("count"), F.lit(0).alias("i"))

    def step(a, v):
        new = v - F.get(per["vs"], a["start"]) > spread
        size = a["i"] - a["start"]
        better = new & (size > a["count"])
        return F.struct(F.when(new, a["i"]).otherwise(a["start"]).alias("start"), F.when(better, a["start"]).otherwise(a["best"]).alias("best"), F.when(better, size).otherwise(a["count"]).alias("count"), (a["i"] + 1).alias("i"))

    def end(a):
        size = a["i"] - a["start"]
        last = size > a["count"]
        return F.struct(F.when(last, a["start"]).otherwise(a["best"]).alias("best"), F.when(last, size).otherwise(a["count"]).alias("count"))

    folded = per.withColumn("c", F.aggregate("vs", zero, step, end))
    gutter = F.when(F.col("c.count") >= least, F.get("vs", F.col("c.best") + F.floor(F.col("c.count") / 2).cast("int")))
    return folded.select("page", F.size("vs").alias("n_votes"), gutter.alias("gutter"))


def borrow_gutters(pages: DataFrame, tolerance: float = 0.025, least: int = 2) -> DataFrame:
    """pages(doc, page, width, gutter) plus borrowed: own gutter, else the upper median of the largest cluster among the document's
    pages of the same width. Pages compare within a document and a bin of widths."""
    have = pages.where("gutter IS NOT NULL").select("doc", F.col("page").alias("o"), F.col("width").alias("ow"), F.col("gutter").alias("og"), F.floor("width").cast("long").alias("bin"))
    widths = pages.where("gutter IS NULL").select("doc", "width").distinct()  # pages of one width borrow the same
    lack = widths.select("doc", "width", F.explode(F.array(*[F.floor("width").cast("long") + k for k in (-1, 0, 1)])).alias("bin"))
    seen = lack.join(have, ["doc", "bin"]).where(F.abs(F.col("ow") - F.col("width")) < 1).groupBy("doc", "width").agg(F.sort_array(F.collect_list("og")).alias("e"))
    distinct = F.array_distinct("e")
    clusters = F.transform(distinct, lambda v: F.filter("e", lambda o: F.abs(o - v) < F.col("width") * tolerance))
    best = F.aggregate(clusters, F.array().cast("array<double>"), lambda a, c: F.when(F.size(c) > F.size(a), c).otherwise(a))
    borrowed = seen.withColumn("best", best).select("doc", "width", F.when(F.size("best") >= least, F.get("best", F.floor(F.size("best") / 2).cast("int"))).alias("b"))
    return pages.join(borrowed, ["doc", "width"], "left").withColumn("borrowed", F.coalesce("gutter", "b")).drop("b")


def outside_regions(runs: DataFrame, regions: DataFrame) -> DataFrame:
    """runs that overlap no region of their page: an anti join on the page with a range condition."""
    a, b = runs.alias("a"), regions.alias("b")
    return a.join(b, (F.col("a.page") == F.col("b.page")) & G.overlap("a", "b"), "left_anti")


def touching_pairs(boxes: DataFrame, gap: float = 0) -> DataFrame:
    a, b = boxes.alias("a"), boxes.alias("b")
    return a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")) & G.touches("a", "b", gap)).select(F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def smallest_container(covers: DataFrame, fills: DataFrame) -> DataFrame:
    """Each cover's smallest fill that holds its centre; -1 for none; ties to the smaller id."""
    c, f = covers.alias("c"), fills.alias("f")
    x, y = (F.col("c.left") + F.col("c.right")) / 2, (F.col("c.top") + F.col("c.bottom")) / 2
    inside = (x >= F.col("f.left")) & (x <= F.col("f.right")) & (y >= F.col("f.top")) & (y <= F.col("f.bottom"))
    area = (F.col("f.right") - F.col("f.left")) * (F.col("f.bottom") - F.col("f.top"))
    both = c.join(f, (F.col("c.page") == F.col("f.page")) & inside, "left")
    return both.groupBy(F.col("c.page").alias("page"), F.col("c.id").alias("id")).agg(F.coalesce(F.min(F.when(F.col("f.id").isNotNull(), F.struct(area.alias("area"), F.col("f.id").alias("id"))))["id"], F.lit(-1)).cast("long").alias("fill"))


#: Room that a cover takes around its text: left, top, right, bottom (fixed values).
PADDING = (1.2, 2.5, 1.6, 2.0)


def padded(boxes: DataFrame) -> DataFrame:
    """Boxes grown to what must be covered when their text is replaced."""
    return boxes.withColumns({"left": F.col("left") - PADDING[0], "top": F.col("top") - PADDING[1], "right": F.col("right") + PADDING[2], "bottom": F.col("bottom") + PADDING[3]})


def overlapping_pairs(boxes: DataFrame) -> DataFrame:
    """page, a, b, area: pairs of a page's boxes (a < b) that share an inner point, and the area they share."""
    a, b = boxes.alias("a"), boxes.alias("b")
    width = F.least("a.right", "b.right") - F.greatest("a.left", "b.left")
    height = F.least("a.bottom", "b.bottom") - F.greatest("a.top", "b.top")
    both = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.id") < F.col("b.id")) & G.overlap("a", "b"))
    return both.select(F.col("a.page").alias("page"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), (width * height).alias("area"))


def aligned_rules(boxes: DataFrame, ends: float = 8, reach: float = 100, least: int = 3) -> DataFrame:
    """For each rule with at least least aligned rules (itself included): their union."""
    a, b = boxes.alias("a"), boxes.alias("b")
    near = (F.abs(F.col("b.left") - F.col("a.left")) < ends) & (F.abs(F.col("b.right") - F.col("a.right")) < ends) & (F.abs(F.col("b.top") - F.col("a.top")) < reach)
    both = a.join(b, (F.col("a.page") == F.col("b.page")) & near)
    out = both.groupBy(F.col("a.page").alias("page"), F.col("a.id").alias("id")).agg(
        F.count("*").alias("n"), F.min("b.left").alias("left"), F.min("b.top").alias("top"), F.max("b.right").alias("right"), F.max("b.bottom").alias("bottom")
    )
    return out.where(F.col("n") >= least)


def subtract_boxes(cover, regions):
    """Column: the parts of a cover struct outside all regions (array of box structs), taken away one after the other."""
    kind = "array<struct<left:double,top:double,right:double,bottom:double>>"

    def box(l, t, r, b):
        return F.struct(l.cast("double").alias("left"), t.cast("double").alias("top"), r.cast("double").alias("right"), b.cast("double").alias("bottom"))

    def cut(c, g):
        l, r = F.greatest(c["left"], g["left"]), F.least(c["right"], g["right"])
        t, b = F.greatest(c["top"], g["top"]), F.least(c["bottom"], g["bottom"])
        parts = F.array(box(c["left"], c["top"], c["right"], t), box(c["left"], b, c["right"], c["bottom"]), box(c["left"], t, l, b), box(r, t, c["right"], b))
        whole = F.array(box(c["left"], c["top"], c["right"], c["bottom"]))
        return F.when((l >= r) | (t >= b), whole).otherwise(F.filter(parts, lambda p: (p["right"] > p["left"]) & (p["bottom"] > p["top"])))

    start = F.array(box(cover["left"], cover["top"], cover["right"], cover["bottom"])).cast(kind)
    return F.aggregate(regions, start, lambda acc, g: F.flatten(F.transform(acc, lambda c: cut(c, g))))
