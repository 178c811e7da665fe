"""Settings, a service over HTTP on this machine, offline texts and glyphs on literal rows."""

import json
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quire.operators import enrich, glyphs, offline, service


def test_config():
    got = service.Config.of({"concurrency": "8", "quality_audit": "False", "column_gap_pt": "3.5", "other": "x"})
    assert (got.concurrency, got.quality_audit, got.column_gap_pt, got.batch_chars) == (8, False, 3.5, 1800)
    with pytest.raises(ValueError):
        service.Config.of({"max_retries": "many"})


@pytest.fixture
def server():
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((self.path, self.headers.get("Authorization"), body))
            status = 200 if body["model"] == "m" else 401
            user = body["messages"][1]["content"]
            text = "ok" if user == "ping" else json.dumps({"segments": [{"i": s["i"], "t": "T:" + s["t"]} for s in json.loads(user)["segments"]]})
            reply = {"choices": [{"message": {"content": text}}], "usage": {"total_tokens": 7}} if status == 200 else {"error": {"message": "no key"}}
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/v1/", seen
    s.shutdown()


def test_http_translator(spark, server):
    url, seen = server
    make = lambda: service.HttpTranslator(url, "m", "key", extra={"top_p": 0.5})
    rows = spark.createDataFrame([(1, 0, k, f"text {k}") for k in range(3)], "doc_id long, batch int, para_index int, source string")
    got = enrich.enrich(rows, make, system="Into German.").orderBy("para_index").collect()
    assert [r["translated"] for r in got] == ["T:text 0", "T:text 1", "T:text 2"] and got[0]["tokens"] == 7
    path, key, body = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer key" and body["top_p"] == 0.5 and body["response_format"] == {"type": "json_object"}
    text, ms = service.probe(make())
    assert text == "ok" and ms >= 0 and "response_format" not in seen[-1][2]
    with pytest.raises(enrich.ServiceError) as error:
        service.HttpTranslator(url, "other").complete("", [])
    assert error.value.status == 401 and "no key" in str(error.value)


def test_requests_are_the_translators(spark):
    rows = spark.createDataFrame([(1, 0, 2, "b"), (1, 0, 0, "a"), (1, 1, 3, None)], "doc_id long, batch int, para_index int, source string")
    bodies = {r["batch"]: json.loads(r["body"]) for r in service.requests(rows, "m", "S", extra='{"temperature": 1}').collect()}
    assert bodies[0]["temperature"] == 1 and json.loads(bodies[0]["messages"][1]["content"]) == {"segments": [{"i": 0, "t": "a"}, {"i": 1, "t": "b"}]}
    assert set(bodies[1]) == {"model", "messages", "temperature", "response_format"}


def test_page_texts_by_share_and_by_position(spark):
    units = spark.createDataFrame([(1, 0, 0, "x" * 10, False), (1, 0, 1, "E=m", True), (1, 0, 2, "y" * 30, False), (1, 0, 3, None, False), (1, 1, 0, "z", False)], "doc_id long, page_index int, para_index int, source string, formula boolean")
    pages = spark.createDataFrame([(1, 0, "ab cd\nefgh")], "doc_id long, page_index int, text string")
    got = {(r["page_index"], r["para_index"]): r["translated"] for r in offline.page_shares(units, pages).collect()}
    assert got == {(0, 0): "abcd", (0, 2): "cdefgh", (0, 3): "【译】", (1, 0): "【译】z"}
    texts = spark.createDataFrame([(1, "0:2", "T")], "doc_id long, key string, translated string")
    assert {r["para_index"] for r in offline.by_position(units, texts).where("translated = 'T'").collect()} == {2}


def test_glyphs(spark):
    show = lambda *g: [{"unicode": u, "font_char": c, "width": float(w)} for u, c, w in g]
    ops = [
        (1, 0, 0, "restore", None, None), (1, 0, 1, "setFont", "A", None), (1, 0, 2, "save", None, None), (1, 0, 3, "setFont", "B", None), (1, 0, 4, "showText", None, show(("µ", "p", 500), ("a", "q", 300), ("a", "r", 1))),
        (1, 0, 5, "restore", None, None), (1, 0, 6, "showText", None, show(("b", "s", 400), ("", "t", 1), ("c", "", 1))),
    ]
    ops = spark.createDataFrame(ops, "doc_id long, page_index int, seq int, op string, font_id string, glyphs array<struct<unicode: string, font_char: string, width: double>>")
    known = glyphs.glyph_dictionary(ops)
    assert {(r["font_id"], r["ch"], r["font_char"]) for r in known.collect()} == {("B", "µ", "p"), ("B", "μ", "p"), ("B", "a", "q"), ("A", "b", "s")}
    fonts = spark.createDataFrame([(1, "A", 1000.0, None), (1, "B", 2000.0, 200.0)], "doc_id long, font_id string, units_per_em double, space_width double")
    runs = spark.createDataFrame([(1, 0, 1, "B", "a μ", 100.0), (1, 0, 2, "B", "ab", 10.0), (1, 0, 3, "C", "a", 10.0), (1, 0, 4, "A", " ", 5.0), (1, 0, 5, "A", None, 5.0), (1, 0, 6, "A", "", 5.0)], "doc_id long, page_index int, id int, font_id string, text string, width double")
    got = {r["id"]: r["glyphs"] for r in glyphs.glyph_positions(runs, known, fonts).collect()}
    assert [(g["font_char"], g["x"]) for g in got[1]] == [("q", 0.0), ("p", 50.0)]
    assert got[2] is None and got[3] is None and got[4] == [] and got[5] is None and got[6] is None
    drawn = spark.createDataFrame([("aé b",)], "t string").select(glyphs.blank_unmapped(F.col("t"), "[a-z ]").alias("d")).first()["d"]
    assert drawn == "a  b"


def test_dictionary_is_shuffled_once(spark):
    """Pages in pieces over partitions, operators out of order: equal to a plain loop, with one exchange and no row a glyph before it."""
    rng, ops, want = random.Random(5), [], {}
    for page in ((d, p) for d in range(6) for p in range(2)):
        font, kept = "", []
        for seq in range(40):
            op = rng.choice(["showText", "showText", "setFont", "save", "restore", "stroke"])
            named = rng.choice("AB") if op == "setFont" else None
            shown = [(rng.choice(["a", "b", "ﬁ", "fi", "µ", "", "é"]), rng.choice(["", "x", "y"]), rng.random()) for _ in range(rng.randrange(5))] if op == "showText" else None
            ops.append((*page, seq, op, named, shown))
            font = named if op == "setFont" else kept.pop() if op == "restore" and kept else font
            kept += [font] * (op == "save")
            for u, c, w in shown or []:
                for ch in [u, {"ﬁ": "fi", "µ": "μ"}.get(u)]:
                    if u and c and ch:
                        want.setdefault((*page, font, ch), (c, w))
    rng.shuffle(ops)
    df = spark.createDataFrame(ops, "doc_id long, page_index int, seq int, op string, font_id string, glyphs array<struct<unicode: string, font_char: string, width: double>>").repartition(7)
    got = glyphs.glyph_dictionary(df)
    assert {(r["doc_id"], r["page_index"], r["font_id"], r["ch"]): (r["font_char"], r["width"]) for r in got.collect()} == want and got.count() == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Join", "Aggregate", "Generate")) and plan.count("RepartitionByExpression") == 1


def test_positions_without_rows_of_characters(spark):
    """Against a plain loop; texts are shuffled once and characters are never rows."""
    rng = random.Random(6)
    known = [(d, p, f, ch, f"g{ch}", float(rng.randrange(1, 9))) for d in range(4) for p in range(2) for f in "AB" for ch in ["a", "b", "μ", "fi", "😀"] if rng.random() < 0.8]
    fonts = [(d, "A", 1000.0, None) for d in range(4)] + [(d, "B", 2000.0, 3.0) for d in range(3)]
    runs = [(rng.randrange(4), rng.randrange(3), i, rng.choice(["A", "B", "C", None]), rng.choice([None, "", "".join(rng.choices("ab ﬁµ😀", k=rng.randrange(1, 6)))]), rng.choice([10.0, 7.5, None])) for i in range(300)]
    space, widths, want = {(d, f): s or u / 4 for d, f, u, s in fonts}, {k[:4]: k[4:] for k in known}, {}
    for d, p, i, f, text, width in runs:
        got = [(None, space.get((d, f))) if c == " " else next((widths[d, p, f, k] for k in (c, {"ﬁ": "fi", "µ": "μ"}.get(c)) if (d, p, f, k) in widths), (None, None)) for c in text or ""]
        if got and (d, f) in space and all(w is not None for _, w in got):
            total = sum(w for _, w in got)
            want[d, p, i] = [(c, None if width is None else sum(w for _, w in got[:k]) / total * width) for k, (c, _) in enumerate(got) if c]
        else:
            want[d, p, i] = None
    frame = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(5)
    place = glyphs.glyph_positions(
        frame(runs, "doc_id long, page_index int, id int, font_id string, text string, width double"), frame(known, "doc_id long, page_index int, font_id string, ch string, font_char string, width double"),
        frame(fonts, "doc_id long, font_id string, units_per_em double, space_width double"),
    )
    assert {(r["doc_id"], r["page_index"], r["id"]): r["glyphs"] and [tuple(g) for g in r["glyphs"]] for r in place.collect()} == want and sum(v is not None for v in want.values()) > 10
    plan = place._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Join", "Generate", "Window"))
