import json
import os
import random
import threading
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire import sinks
from quire.functions import geometry as G
from quire.operators import batching, enrich, folds, layout, lines, lookup, report, typeset
from quire.sinks import append_checkpoint, append_log, clear_checkpoint, output_names, write_cache, write_structure
from quire.sources.glossary import read_glossary
from quire.sources.structure import read_cache, read_checkpoint, read_structure


def test_batches_fill_the_budget_exactly(spark):
    df = spark.createDataFrame([(1, 0, "a" * 876), (1, 1, "b" * 876), (1, 2, "c"), (2, 0, "x" * 5000), (2, 1, "y")], "doc_id long, para_index int, source string")
    got = {(r["doc_id"], r["para_index"]): r["batch"] for r in batching.batches(df).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 1, (2, 0): 0, (2, 1): 1}


def test_results_keep_source_on_failure(spark):
    df = spark.createDataFrame([(1, 0, "a ⟦M1⟧", "b ⟦M1⟧"), (1, 1, "a", None), (1, 2, "a", "x ⟦M2⟧")], "doc_id long, para_index int, source string, reply string")
    got = [(r["failed"], r["translated"]) for r in lookup.results(df).orderBy("para_index").collect()]
    assert got == [(False, "b ⟦M1⟧"), (True, "a"), (True, "a")]


def test_reading_order_of_bands(spark):
    rows = [(1, 1, -1, 0.0, 0.0), (1, 2, 1, 300.0, 10.0), (1, 3, 0, 0.0, 12.0), (1, 4, 0, 0.0, 30.0), (1, 5, -1, 0.0, 40.0), (1, 6, 1, 300.0, 50.0)]
    df = spark.createDataFrame(rows, "page long, id long, col int, x double, y double")
    assert [r["id"] for r in layout.reading_order(df).orderBy("seq").collect()] == [1, 3, 4, 2, 5, 6]


def test_page_geometry(spark):
    for turn, want in {0: (60, 100), 90: (500, 60), 180: (340, 500), 270: (100, 340)}.items():
        x, y = G.to_display(F.lit(60.0), F.lit(500.0), F.lit(400.0), F.lit(600.0), G.quarter(F.lit(turn)))
        r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
        assert (r["x"], r["y"]) == want
        assert folds.Page(*((600, 400) if turn in (90, 270) else (400, 600)), turn=turn).display(60, 500) == want


def test_rectangle_difference(spark):
    c = F.struct(*[F.lit(v).alias(n) for n, v in (("left", 0.0), ("top", 0.0), ("right", 10.0), ("bottom", 10.0))])
    g = F.array(F.struct(*[F.lit(v).alias(n) for n, v in (("left", 4.0), ("top", 4.0), ("right", 6.0), ("bottom", 6.0))]))
    parts = spark.range(1).select(layout.subtract_boxes(c, g).alias("p")).first()["p"]
    assert len(parts) == 4 and sum((p["right"] - p["left"]) * (p["bottom"] - p["top"]) for p in parts) == 96


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(0, 12), st.integers(0, 12)), max_size=14), st.randoms())
def test_merge_is_idempotent_and_order_free(raw, rng):
    boxes = [(x, y, x + w, y + h) for x, y, w, h in raw]
    once = folds.merge_boxes(boxes, 2)
    mixed = boxes[:]
    rng.shuffle(mixed)
    assert sorted(folds.merge_boxes(mixed, 2)) == sorted(once) == sorted(folds.merge_boxes(once, 2))


def test_gutter_votes_anchor_on_the_first(spark):
    rng = random.Random(3)
    pages = {p: sorted(rng.choice([rng.uniform(0, 400), rng.gauss(200, 20)]) for _ in range(rng.randint(1, 40))) for p in range(30)}
    df = spark.createDataFrame([(p, v) for p, vs in pages.items() for v in vs], "page long, v double")
    got = {r["page"]: r["gutter"] for r in layout.gutter_votes(df).collect()}
    for p, vs in pages.items():
        groups = []
        for v in vs:
            if groups and v - groups[-1][0] <= 36:
                groups[-1].append(v)
            else:
                groups.append([v])
        best = max(groups, key=len)
        assert got[p] == (best[len(best) // 2] if len(best) >= 6 else None)


def test_text_table_and_prose(spark):
    cells = [(1, 0, x, 10.0 * r, 30.0, 11.0, 10.0, f"CELL{r}{k}") for r in range(3) for k, x in enumerate((50.0, 145.0, 240.0))]
    prose = [(1, 0, 40.0, 60.0, 260.0, 11.0, 10.0, "Body below table remains translatable.")]
    df = spark.createDataFrame(cells + prose, "doc_id long, page_index long, x double, y double, width double, height double, size double, text string")
    assert [tuple(r)[2:] for r in folds.table_regions(df).collect()] == [(0, 50.0, 0.0, 270.0, 31.0)]


def test_text_tables_equal_brute_force(spark):
    """Rows by their first run, cells by gaps, grids of like rows: against the definition, row by row."""
    rng = random.Random(8)
    rows = []
    for page in range(25):
        grid = [50.0 + 90.0 * k for k in range(rng.randrange(2, 5))]
        for r in range(rng.randrange(1, 14)):
            y = 14.0 * r + rng.choice([0.0, 0.0, 1.0, 1.9])
            for x in grid:
                for part in range(rng.choice([1, 1, 1, 1, 2, 0]) if r % 4 == 3 else 1):
                    rows.append((page % 3, page, x + rng.choice([0.0, 0.0, 0.0, 4.0]) + 20 * part, y + rng.choice([0.0, 1.0]), rng.choice([8.0, 12.0]), 11.0, 10.0, rng.choice(["ab", "cd", "a cell of many words", "x"])))
    want = []
    for page in sorted({r[1] for r in rows}):
        own = sorted((r for r in rows if r[1] == page), key=lambda r: (r[3], r[2]))
        lines = []
        for r in own:
            if lines and abs(r[3] - lines[-1][0][3]) < max(r[6], lines[-1][0][6]) * 0.3:
                lines[-1].append(r)
            else:
                lines.append([r])
        grids = []
        for line in lines:
            cells = []
            for r in sorted(line, key=lambda r: (r[2], r[3], r[7])):
                if cells and r[2] - cells[-1]["right"] < r[6] * 1.5:
                    cells[-1]["right"] = max(cells[-1]["right"], r[2] + r[4])
                    cells[-1]["text"] += " " + r[7]
                else:
                    cells.append({"x": r[2], "y": r[3], "right": r[2] + r[4], "bottom": r[3] + r[5], "text": r[7]})
            if len(cells) >= 3 and all(len(c["text"]) < 40 for c in cells):
                grids.append(cells)
        for g in grids:
            same = [o for o in grids if len(o) == len(g) and abs(o[0]["y"] - g[0]["y"]) < 100 and all(abs(a["x"] - b["x"]) < 5 for a, b in zip(o, g, strict=True))]
            if len(same) >= 3:
                every = [c for o in same for c in o]
                want.append((page, min(c["x"] for c in every), min(c["y"] for c in every), max(c["right"] for c in every), max(c["bottom"] for c in every)))
    df = spark.createDataFrame(rows, "doc_id long, page_index long, x double, y double, width double, height double, size double, text string")
    got = sorted((r["page_index"], r["left"], r["top"], r["right"], r["bottom"]) for r in folds.table_regions(df).collect())
    assert got == sorted(set(want)) and len(got) > 5


def test_attached_scripts():
    body = lines._Line([(40.0, 0, "A long body line of text", 240.0, 10.0)], 100.0, 0)
    script = lines._Line([(100.0, 1, "2", 103.0, 6.0)], 96.0, 0)
    lines.attached([body, script])
    assert script.to is body and body.to is None and len(body.runs) == 2


def test_many_boxes_merge_in_seconds():
    rng = random.Random(4)
    boxes = [(x, y, x + rng.uniform(0, 4), y + rng.uniform(0, 4)) for x, y in ((rng.uniform(0, 9000), rng.uniform(0, 9000)) for _ in range(100_000))]
    begun = time.time()
    merged = folds.merge_boxes(boxes, 1.0)
    assert 1 < len(merged) < len(boxes) and time.time() - begun < 60


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(0, 12), st.integers(0, 12)), max_size=25), st.sampled_from([0.0, 2.0, 6.0]))
def test_merge_equals_brute_force(raw, gap):
    boxes = [(x, y, x + w, y + h) for x, y, w, h in raw]
    want = boxes[:]
    pair = True
    while pair:
        pair = next(((i, j) for i in range(len(want)) for j in range(i) if folds.touching(want[i], want[j], gap)), None)
        if pair:
            i, j = pair
            want.append(folds.union([want.pop(i), want.pop(j)]))
    assert sorted(folds.merge_boxes(boxes, gap)) == sorted(want)


def drawing(spark, ops, captions=None):
    rows = [("d", 0, i, o, None if a is None else [float(v) for v in a], None if b is None else [float(v) for v in b], 400.0, 600.0) for i, (o, a, b) in enumerate(ops)]
    df = spark.createDataFrame(rows, "doc_id string, page_index int, seq long, op string, args array<double>, bounds array<double>, width double, height double")
    got = folds.page_regions(df, captions).collect()
    return sorted(tuple(r[c] for c in ("left", "top", "right", "bottom")) for r in got if r["kind"] == "protected"), [r for r in got if r["kind"] == "fill"]


def test_drawing_fold(spark):
    ops = [("save", None, None), ("transform", [1, 0, 0, 1, 40, 370], None), ("paintFormXObjectBegin", None, [0, 0, 160, 70]), ("setFillRGBColor", [204, 229, 178], None), ("constructPath", None, [0, 0, 50, 50]), ("fill", None, None), ("paintFormXObjectEnd", None, None), ("restore", None, None)]
    regions, (fill,) = drawing(spark, ops)
    assert (39, 159, 201, 231) in regions and regions[0] == (39, 159, 201, 231)
    assert (fill["left"], fill["top"], fill["right"], fill["bottom"]) == (40, 180, 90, 230) and [round(fill[c], 2) for c in ("red", "green", "blue")] == [0.8, 0.9, 0.7]
    rules = [("constructPath", None, [40, y, 300, y + 1]) for y in (310, 288, 266)]
    regions, fills = drawing(spark, [x for r in rules for x in (r, ("stroke", None, None))])
    assert any(b[0] == 39 and b[2] == 301 for b in regions) and not fills
    # a caption's box needs its rule near by; an empty form and a path that is only built protect nothing
    far = [("constructPath", None, [40, y, 300, y + 1]) for y in (500, 380, 270)]
    captions = spark.createDataFrame([("d", 0, 42.0, 98.0, 100.0, 10.0)], "doc_id string, page_index int, x double, y double, width double, size double")
    drawn = [x for r in far for x in (r, ("stroke", None, None))]
    assert drawing(spark, drawn)[0] == [] and drawing(spark, drawn, captions)[0] == [(39, 98, 301, 331)]
    assert drawing(spark, [("paintFormXObjectBegin", None, [0, 0, 160, 70]), ("constructPath", None, [0, 0, 90, 90]), ("endPath", None, None), ("paintFormXObjectEnd", None, None), ("restore", None, None)]) == ([], [])
    regions, fills = drawing(spark, [("setFillCMYKColor", [0, 1, 1, 0], None), ("constructPath", None, [0, 0, 9, 9]), ("fill", None, None), ("setFillGray", [1], None), ("constructPath", None, [0, 0, 8, 8]), ("eoFill", None, None), ("transform", [90, 0, 0, 80, 10, 20], None), ("paintImageXObject", None, None)])
    assert regions == [(9, 499, 101, 581)] and [(f["red"], f["green"], f["blue"], f["ord"]) for f in fills] == [(1, 0, 0, 0)]


@pytest.mark.parametrize(("text", "fits"), [("标题", True), ("长段落" * 2000, False)])
def test_fit(text, fits):
    got = typeset.fit(text, 240, 23.6, 20, 24)
    assert got["fits"] is fits and (not fits or got["size"] > 15)
    assert abs(typeset.fit("短句", 240, 120, 10, 12)["leading"] / 12 - 1) < 1e-6


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab ，。（长⟦", max_size=80), st.floats(2, 20))
def test_wrapping_keeps_text(text, room):
    m = typeset.within(typeset.measure(text, {}), room)
    lines = typeset.break_lines(m, room)
    kept = "".join(m.texts[k] for a, b in lines for k in range(a, b))
    assert kept.replace(" ", "") == text.replace(" ", "")
    assert lines == naive_lines(typeset.measure(text, {}), room)


def naive_lines(atoms, room):
    """Lines by their definition, atom by atom."""
    flat = [x for t, w, *_ in atoms for x in ([(c, typeset.em_width(c)) for c in t] if t and w > room else [(t, w)])]
    lines, line = [], []
    for k, (t, w) in enumerate(flat):
        if line and sum(flat[i][1] for i in line) + w > room + 1e-9:
            take = [line.pop()] if (t is not None and typeset.CLOSING.match(t)) or (flat[line[-1]][0] is not None and typeset.OPENING.search(flat[line[-1]][0])) else []
            lines += [line] if line else []
            line = take
        if line or t is None or t.strip():
            line.append(k)
    return [(x[0], x[-1] + 1) for x in lines + ([line] if line else [])]


def naive_fit(text, width, height, size, leading):
    atoms, ratio = typeset.measure(text, {}), min(1.6, max(1.05, leading / size))
    for k in range(int((size * 0.5 + 0.01) / 0.1) + 1):
        now = size - k * 0.1
        m = typeset.within(atoms, width / now)
        lines = naive_lines(atoms, width / now)
        if now * (0.9 + 0.28 + max(0, len(lines) - 1) * ratio) <= height + 0.01 and all((m.ends[b] - m.ends[a]) * now <= width + 0.01 for a, b in lines):
            return now, len(lines), True
    return size * 0.5, 0, False


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="abcd ，。（长", max_size=200), st.floats(20, 200), st.floats(5, 90))
def test_fit_tries_every_size(text, width, height):
    got = typeset.fit(text, width, height, 10.0, 12.0)
    assert (got["size"], got["lines"], got["fits"]) == naive_fit(text, width, height, 10.0, 12.0)


class Script:
    def __init__(self, *replies):
        self.replies, self.asked, self.systems = list(replies), [], []

    def complete(self, system, segments):
        self.asked.append([s["i"] for s in segments])
        self.systems.append(system)
        r = self.replies.pop(0)
        if isinstance(r, Exception):
            raise r
        return (r(segments) if callable(r) else r), 100


def whole(segments, mark="译"):
    return json.dumps({"segments": [{"i": s["i"], "t": mark + s["t"]} for s in segments]})


def test_retries_are_numbered_from_zero():
    t = Script(lambda s: whole(s[:-1]), whole)
    rows, reason, tokens = enrich.translate_batch(["a", "b", "c", "d"], "", t, wait=lambda _: None)
    assert t.asked == [[0, 1, 2, 3], [0]] and not any(r["failed"] for r in rows) and reason is None and tokens == 200


def test_backoff_and_error_classes():
    waits = []
    rows, reason, _ = enrich.translate_batch(["a", "b"], "", Script(*[OSError("down")] * 3), wait=waits.append)
    assert waits == [0.5, 1.0] and all(r["failed"] for r in rows) and reason == "down"
    for status, calls in ((400, 1), (200, 1), (429, 3), (503, 3)):
        t = Script(*[enrich.ServiceError(status)] * 3)
        enrich.translate_batch(["a"], "", t, wait=lambda _: None)
        assert len(t.asked) == calls
    t = Script("no json", whole)
    assert enrich.translate_batch(["a"], "", t, wait=lambda _: None)[0][0]["translated"] == "译a"


def test_tokens_of_a_reply_that_cannot_be_read_count():
    rows, _, tokens = enrich.translate_batch(["a"], "", Script("no json", whole), wait=lambda _: None)
    assert tokens == 200 and rows[0]["attempts"] == 2


def test_batches_of_a_task_are_under_way_together(spark):
    df = spark.createDataFrame([(1, b, b, f"text {b}") for b in range(12)], "doc_id long, batch int, para_index int, source string").coalesce(1)

    def slow():
        def complete(system, segments):
            import json as js
            import time as clock

            clock.sleep(0.5)
            return js.dumps([{"i": s["i"], "t": "译" + s["t"]} for s in segments]), 1

        import types

        return types.SimpleNamespace(complete=complete)

    start = time.time()
    got = enrich.enrich(df, slow, concurrency=12).collect()
    assert sorted(r["translated"] for r in got) == sorted(f"译text {b}" for b in range(12)) and time.time() - start < 6


def test_repair_needs_fewer_issues():
    audit = lambda s, r: ["short"] if len(r) < 4 else []
    cut = lambda s: json.dumps([{"i": x["i"], "t": "x"} for x in s])
    t = Script(cut, lambda s: whole(s, "long "))
    rows, _, _ = enrich.translate_batch(["text"], "sys", t, audit=audit)
    assert rows[0]["quality"] == "retried" and "Correction pass" in t.systems[1]
    assert enrich.translate_batch(["text"], "", Script(cut, cut), audit=audit)[0][0]["quality"] == "suspect"
    assert enrich.translate_batch(["text"], "", Script(cut, OSError()), audit=audit)[0][0]["quality"] is None


@pytest.mark.parametrize(
    ("raw", "want"),
    [('[{"i":0,"t":"a"},{"i":0,"t":"b"}]', {0: "b"}), ('```json\n{"segments":[{"index":"1","text":"x"}]}\n```', {1: "x"}), ('{"segments":[{"i":true,"t":"y"},{"i":1.5,"t":"z"},{"i":2,"t":3}]}', {1: "y"}), ("{}", {})],
)
def test_parse_reply(raw, want):
    assert enrich.parse_reply(raw) == want


def test_enrich_on_spark(spark):
    df = spark.createDataFrame([(1, 0, i, f"text {i}") for i in range(4)] + [(2, 0, 0, "z")], "doc_id long, batch int, para_index int, source string")
    got = enrich.enrich(df, enrich.MockTranslator).collect()
    assert len(got) == 5 and all(r["translated"].startswith("【译】") for r in got) and sum(r["tokens"] for r in got) == 240


def test_output_names_do_not_collide(spark):
    df = spark.createDataFrame([(1, "same-dir", "/d/a.pdf"), (2, "same-dir", "/d/a..pdf"), (3, "custom", "/d/....pdf"), (4, "storage", "/d/b")], "doc_id long, mode string, path string")
    got = {r["doc_id"]: r["path"] for r in output_names(df, ".x", "/out", "/st").collect()}
    assert got == {1: "/d/a.x.pdf", 2: "/d/a.x (2).pdf", 3: "/out/document.x.pdf", 4: "/st/b.x.pdf"}


def test_glossary_file(spark, tmp_path):
    (tmp_path / "g.txt").write_text("row buffer,行缓冲区\nDRAM\t动态随机存取存储器\n# comment line\nno-separator-here\nDram,again\n,x\n")
    assert [(r["source"], r["target"]) for r in read_glossary(spark, str(tmp_path / "g.txt")).orderBy("ord").collect()] == [("row buffer", "行缓冲区"), ("DRAM", "动态随机存取存储器")]


def test_cache_and_checkpoint_tables(spark, tmp_path):
    entries = spark.createDataFrame([(f"k{i}", f"t{i}", i) for i in range(10)], "key string, translated string, ord long")
    write_cache(entries, str(tmp_path / "c"), "ns", keep=4)
    assert {r["key"] for r in read_cache(spark, str(tmp_path / "c"), "ns").collect()} == {"k6", "k7", "k8", "k9"}
    assert read_cache(spark, str(tmp_path / "c"), "other").count() == 0 == read_cache(spark, str(tmp_path / "c"), "ns", version=2).count()
    rows = spark.createDataFrame([("d", "0:0", "one"), ("d", "0:1", "two")], "doc_key string, unit_key string, translated string")
    append_checkpoint(rows, str(tmp_path / "p"), "ns")
    append_checkpoint(rows.where("unit_key = '0:0'").withColumn("translated", F.lit("new")), str(tmp_path / "p"), "ns")
    got = {r["unit_key"]: r["translated"] for r in read_checkpoint(spark, str(tmp_path / "p"), "d", "ns").collect()}
    assert got == {"0:0": "new", "0:1": "two"}
    later = F.current_timestamp() + F.expr("INTERVAL 8 DAYS")
    assert read_checkpoint(spark, str(tmp_path / "p"), "d", "ns").count() == 2
    from quire.streaming.checkpoint import expire

    assert expire(spark.read.parquet(str(tmp_path / "p")), 7, later).count() == 0


def test_requests_of_a_whole_job_are_bounded(spark, tmp_path):
    class Slow:
        """Answers after a while, and notes when it was asked and when it had answered."""

        def __init__(self, folder):
            self.folder = folder

        def complete(self, system, segments):
            begun = time.time()
            time.sleep(0.15)
            with open(f"{self.folder}/{os.getpid()}-{begun}-{threading.get_ident()}", "w") as f:
                f.write(f"{begun} {time.time()}")
            return json.dumps({"segments": [{"i": s["i"], "t": s["t"]} for s in segments]}), 1

    units = spark.createDataFrame([(d, 0, k, f"text {k}") for d in range(24) for k in range(2)], "doc_id long, batch int, para_index int, source string").repartition(4)
    folder = str(tmp_path)
    enriched = enrich.enrich(units, lambda: Slow(folder), concurrency=2, at_once=4)
    assert enriched.rdd.getNumPartitions() == 2 and enriched.count() == 48
    spans = [tuple(map(float, p.read_text().split())) for p in tmp_path.iterdir()]
    most = max(sum(a <= at < b for a, b in spans) for at, _ in spans)
    assert len(spans) == 24 and 1 < most <= 4


@pytest.mark.parametrize("stop", [1, 2])
def test_a_clear_that_stops_loses_nothing(spark, tmp_path, monkeypatch, stop):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(f"d{k}", "0:0", f"t{k}") for k in range(40)], "doc_key string, unit_key string, translated string")
    append_checkpoint(rows, path, "ns")
    move, calls = sinks._move, []

    def breaks(*args):
        calls.append(args)
        if len(calls) == stop:
            raise OSError("stopped")
        move(*args)

    monkeypatch.setattr(sinks, "_move", breaks)
    with pytest.raises(OSError):
        clear_checkpoint(spark, path, "d7", "ns")
    monkeypatch.setattr(sinks, "_move", move)
    sinks.restore_checkpoint(spark, path)
    known = lambda: {r["doc_key"] for r in read_checkpoint(spark, path, None, "ns").collect()}
    assert known() == {f"d{k}" for k in range(40)}
    clear_checkpoint(spark, path, "d7", "other")
    clear_checkpoint(spark, path, "nobody", "ns")
    assert len(known()) == 40
    clear_checkpoint(spark, path, "d7", "ns")
    assert known() == {f"d{k}" for k in range(40)} - {"d7"}


def test_a_batch_that_comes_again_takes_its_own_place(spark, tmp_path):
    path = str(tmp_path / "p")
    rows = spark.createDataFrame([(f"d{k}", "0:0", "one") for k in range(10)], "doc_key string, unit_key string, translated string")
    for _ in range(3):
        append_checkpoint(rows, path, "ns", batch="s-0")
    append_checkpoint(rows.limit(1), path, "ns", batch="s-1")
    assert spark.read.parquet(path).count() == 11


def test_clear_log_and_interchange(spark, tmp_path):
    rows = spark.createDataFrame([("d", "0:0", "one"), ("e", "0:1", "two")], "doc_key string, unit_key string, translated string")
    append_checkpoint(rows, str(tmp_path / "p"), "ns")
    clear_checkpoint(spark, str(tmp_path / "p"), "d", "ns")
    assert [r["doc_key"] for r in spark.read.parquet(str(tmp_path / "p")).collect()] == ["e"]
    for m in ("a", "b"):
        append_log(spark.createDataFrame([(m,)], "message string"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    runs = spark.createDataFrame([("d", i, 0, f"t{i}") for i in range(5)], "doc_id string, page_index int, ord int, text string")
    write_structure(runs, str(tmp_path / "s"))
    assert [r["text"] for r in read_structure(spark, str(tmp_path / "s"), "runs", 2, 3).orderBy("page_index").collect()] == ["t1", "t2"]


def test_too_many_names(spark):
    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("same-dir").alias("mode"), F.lit("/d/a.pdf").alias("path"))
    assert output_names(df.limit(499)).count() == 499
    with pytest.raises(Exception, match="Too many outputs"):
        output_names(df).collect()
    assert {r["path"] for r in output_names(df, overwrite=True).collect()} == {"/d/a.bilingual.pdf"}


def test_names_of_a_whole_corpus(spark):
    """Beyond MAX_NAMES equal names, numbers go on where no bound is asked for."""
    df = spark.range(1200).select(F.col("id").alias("doc_id"), F.lit("same-dir").alias("mode"), F.lit("/d/a.pdf").alias("path"))
    got = {r["doc_id"]: r["path"] for r in output_names(df, most=None).collect()}
    assert got == {i: f"/d/a.bilingual{f' ({i + 1})' if i else ''}.pdf" for i in range(1200)}


def test_structure_pages(spark, tmp_path):
    (tmp_path / "r.json").write_text("\n".join(json.dumps({"doc_id": "d", "page_index": i, "ord": 0, "text": "t"}) for i in range(5)))
    assert read_structure(spark, str(tmp_path / "r.json"), "runs", 2, 3).count() == 2


def test_streamed_batches_resume(spark, tmp_path):
    from quire.streaming.checkpoint import persist_batches, resume

    rows = spark.createDataFrame([("d", f"0:{i}", f"t{i}") for i in range(6)], "doc_key string, unit_key string, translated string")
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        persist_batches(stream, str(tmp_path / "out"), "ns", str(tmp_path / "log")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6
    units = spark.createDataFrame([("d", f"0:{i}", "s") for i in range(8)], "doc_key string, unit_key string, source string")
    answered, pending = resume(units, read_checkpoint(spark, str(tmp_path / "out"), "d", "ns"))
    assert answered.count() == 6 and pending.count() == 2


def test_guards(spark):
    df = spark.createDataFrame([(1, "unchanged"), (1, "formula"), (1, "unchanged"), (2, "draw"), (3, "formula")], "doc_id long, reason string")
    got = {r["doc_id"]: r["message"] for r in report.nothing_rendered(df).collect()}
    assert list(got) == [1] and "- 2 paragraph(s) came back unchanged" in got[1]


def test_paint_events_equal_the_trace(spark):
    """Random operators over turned and shifted pages, some with forms, in pieces over partitions: bit for bit what trace yields, and pages without forms are never traced one by one."""
    rng, ops, want = random.Random(8), [], []
    number = lambda n: [rng.choice([0.0, -0.0, 0.5, 1.0, 3.0, 51.0, 255.0, rng.uniform(-9, 300)]) for _ in range(n)]
    for page in range(60):
        form = ["paintFormXObjectBegin", "paintFormXObjectEnd"] if page % 4 == 3 else []
        sheet = (rng.choice([200.0, 300.0]), 400.0, rng.choice([0.0, 7.5]), rng.choice([0.0, -3.0]), rng.choice([0, 90, 180, 270]))
        rows = []
        for seq in range(rng.choice([1, 5, 60])):
            op = rng.choice(["save", "save", "restore", "restore", "transform", "setFillGray", "setFillRGBColor", "setFillCMYKColor", "paintImageXObject", "stroke", "eoFill", "fill", "constructPath", "constructPath", "endPath", "other", *form])
            args = number(rng.choice([6, 6, 6, 5, 4])) if op in ("transform", *form) else number(rng.choice([1, 3, 4])) if op.startswith("setFill") else None
            args = [*args[:-1], None] if args and op.startswith("setFill") and rng.random() < 0.1 else args
            bounds = rng.choice([None, number(4), number(4), [0.0, 1.0, None, 2.0], [1.0, 2.0, 3.0, float("inf")]]) if op == "constructPath" else number(4) if form and op == form[0] else None
            rows.append({"op": op, "args": args, "bounds": bounds, "seq": seq})
        ops += [(f"d{page % 7}", page, *r.values(), *sheet) for r in rows]
        for what, since, until, box, color in folds.trace(rows, folds.Page(*sheet[:2], sheet[2:4], sheet[4])):
            want.append((f"d{page % 7}", page, what, since, until, *box, *(color or (None,) * 3), *sheet[:2]))
    rng.shuffle(ops)
    df = spark.createDataFrame(ops, "doc_id string, page_index int, op string, args array<double>, bounds array<double>, seq int, width double, height double, x0 double, y0 double, turn int").repartition(5)
    got = [tuple(r) for r in folds.paint_events(df).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len({w[2] for w in want}) == 4
    called = []
    rows = df.where("page_index % 4 <> 3").select("doc_id", "page_index", F.col("seq").cast("long"), F.lit(0).cast("byte").alias("code"), "args", "bounds", "width", "height", "x0", "y0", "turn").toArrow()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(folds, "trace", lambda *a: called.append(a) or [])
        list(folds._events(rows, [0, rows.num_rows], None))
    assert not called


def test_regions_of_pages_in_place(spark):
    """Pages that lie together already give the same regions without an exchange of operators; operators out of order are an error."""
    rng, rows = random.Random(9), []
    for page in range(40):
        for k in range(rng.randrange(1, 9)):
            x, y = rng.randrange(500), rng.randrange(700)
            steps = [("setFillGray", [rng.choice([0.2, 1.0])], None), ("constructPath", None, [float(x), float(y), x + rng.choice([5.0, 60.0, 200.0]), y + rng.choice([1.0, 30.0, 90.0])]), (rng.choice(["fill", "stroke"]), None, None)]
            rows += [(page, 0, k * 10 + i, *s, 700.0, 900.0) for i, s in enumerate(steps)]
    ops = spark.createDataFrame(rows, "doc_id long, page_index int, seq long, op string, args array<double>, bounds array<double>, width double, height double")
    together = ops.repartition(3, "doc_id").sortWithinPartitions("doc_id", "seq")
    want = sorted(map(repr, folds.page_regions(ops.repartition(5)).collect()))
    assert sorted(map(repr, folds.page_regions(together, in_place=True).collect())) == want and len(want) > 40
    assert folds.paint_events(together, in_place=True)._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1
    with pytest.raises(Exception, match="in order"):
        folds.paint_events(ops.repartition(1, "doc_id").sortWithinPartitions("doc_id", F.desc("seq")), in_place=True).collect()
