"""Operators against brute force, exact round trips and awkward inputs."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, html_text, jaccard_join, media_ts, mixing, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# url filter


def verdicts(rows, rules):
    out = {}
    for i, url in rows:
        host, path = "", ""
        if url and "://" in url:
            host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host.lower() == h or host.lower().endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        out[i] = (best[2], best[3])
    return out


def test_cascade_is_exact(spark):
    rng = random.Random(2)
    hosts = ["a.net", "x.y.example.net", "Example.NET", "example.com", "b.org", "net", "notnet", "org.net", ""]
    rows = [(i, rng.choice([None, "", "junk", "http://" + rng.choice(hosts) + rng.choice(["", "/", "/en/1", "/en", "/de/x?q=/fr/", "/fr/a#z", "/fr//", "?a=b"])])) for i in range(400)]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("keys", F.lit(1))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.RULES).collect()}
    assert got == verdicts(rows, url_filter.RULES)
    many = [(f"h{k}.net", "/en/", "block" if k % 2 else "allow") for k in range(300)]
    rows = [(i, f"http://s.h{i}.net/en/{i}") for i in range(900)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), many).collect()}
    assert got == verdicts(rows, many)


def test_no_pages_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.RULES).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(one, []).first()["verdict"] == "allow"


# mixing


def test_targets_stop_at_the_cap():
    got = mixing.targets([10, 1000, 0, 100], [5, 2, 1, 5], 1110)
    assert got[0] == 30 and got[2] == 0 and got[3] == 300 and abs(sum(got) - 1110) < 1e-9


def test_flight_keeps_its_sums():
    rng = np.random.default_rng(1)
    p, x = rng.random(500), rng.integers(0, 300, 500).astype(float)
    q = mixing.flight(p, x)
    assert abs(q.sum() - p.sum()) < 1e-6 and abs((q * x).sum() - (p * x).sum()) < 1e-3
    assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 2
    r = mixing.landing(q, x)
    assert set(np.unique(r)) <= {0.0, 1.0} and abs((r * x).sum() - (p * x).sum()) <= 300


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "b", "c", "c", "c", None])) for i in range(3000)] + [(7, None, "a"), (7, None, "a"), (8, "", "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).repartition(5)
    for group in (4096, 64):
        got = mixing.mix(df, group=group).collect()
        assert len(got) == len(rows)
        for s in {r["source"] for r in got}:
            own = [r for r in got if r["source"] == s]
            assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 60
            assert all(r["taken"] <= 3 * r["size"] for r in own) and own[0]["source_size"] == sum(r["size"] for r in own)
    again = mixing.mix(df.repartition(3), group=64)
    key = lambda r: (r["doc_id"], r["tie"], r["row"], r["copies"])
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    assert mixing.mix(df.where("false")).count() == 0


# media


@pytest.mark.parametrize("n", [0, 1, 100, 161, 162, 163, 164, 175, 176, 177, 359, 360, 16_384, 16_385, 300_000])
def test_transport_stream_round_trip(n):
    data = random.Random(n).randbytes(n)
    stream = media_ts.mux(data)
    got = media_ts.demux(stream)
    assert got.payload == data and not got.faults and len(stream) % 188 == 0
    assert [u[0] for u in got.units] == [3600 * k for k in range(len(got.units))] and all(u[1] == (k % 8 == 0) for k, u in enumerate(got.units))


def test_damage_is_reported():
    stream = media_ts.mux(bytes(range(256)) * 40)
    assert any("continuity" in f for f in media_ts.demux(stream[: 188 * 9] + stream[188 * 10 :]).faults)
    assert media_ts.demux(stream[:-7]).faults and media_ts.demux(b"x" * 999).faults and media_ts.demux(b"").payload == b""
    assert media_ts.demux(stream[188:]).faults == ["no program"]


def test_repeated_packets_full_fields_and_later_tables():
    data = bytes(range(256)) * 300
    stream = media_ts.mux(data)
    packets = [stream[i : i + 188] for i in range(0, len(stream), 188)]
    got = media_ts.demux(b"".join(p * (2 if i % 7 == 0 else 1) for i, p in enumerate(packets)))
    assert got.payload == data and not got.faults
    full = bytes([0x47, 0x40, 0, 0x30, 183]) + bytes(183)
    assert media_ts.demux(full + stream).payload == data
    bad = bytearray(packets[0])
    bad[20] ^= 255
    later = media_ts.demux(bytes(bad) + packets[0] + b"".join(packets[1:]))
    assert later.payload == data and later.faults == ["table 0 is damaged"]


def test_stored_index_is_what_is_read(spark):
    df = spark.createDataFrame([(1, None), (2, "x" * 400_000)], "doc_id long, text string")
    stored = media_ts.encode(df)
    read = {r["doc_id"]: r["units"] for r in media_ts.decode(stored).collect()}
    assert {r["doc_id"]: r["index"] for r in stored.collect()} == read and len(read[2]) == 25


def test_media_digest(spark):
    rows = [(1, None), (2, ""), (3, "é" * 40), (3, "é" * 40), (4, "x" * 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = [r.asDict() for r in media_ts.digest(media_ts.decode(media_ts.encode(df))).collect()]
    for r in got:
        raw = (dict(rows)[r["doc_id"]] or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    assert media_ts.encode(df.where("false")).count() == 0


# near duplicates


def classes(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(low))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return sorted((i, len(s), find(i)) for i, s in sets)


def corpus(rng, n, vocabulary, length):
    rows, texts = [], []
    for i in range(n):
        kind = rng.random()
        if texts and kind < 0.6:
            w = rng.choice(texts).split()
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        else:
            t = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, length)))
        texts.append(t)
        rows.append((i * 3 + 1, t.upper() if kind < 0.1 else t))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = corpus(rng, 260, [f"w{k}" for k in range(30 if seed == 1 else 400)], 160) + [(2, None), (3, ""), (5, " \t\n"), (6, "a b"), (8, "A  B"), (9, "a b c"), (6, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash")).withColumn("n", F.lit(0)).repartition(4)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_duplicates(df).collect())
    assert got == classes(rows)


def test_null_and_repeated_ids_keep_their_links(spark):
    """Rows without an id bridge others, and have the class of those they link with; ids that come with several texts are one for each."""
    words = [f"word{k}" for k in range(60)]
    near = lambda *at: " ".join("other" if k in at else w for k, w in enumerate(words))
    alone = " ".join(f"alone{k}" for k in range(30))
    rows = [(5, near(3)), (None, near(3, 4)), (7, near(3, 4, 8)), (9, near(40)), (None, near()), (None, near()), (None, alone), (None, alone + " end"), (None, None), (11, "by itself"), (11, near(41)), (12, "by itself")]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by_row = [(i if d is not None else -1 - i, t) for i, (d, t) in enumerate(rows)]  # every row an id of its own
    label = {i: c for i, _, c in classes(by_row)}
    least = {}
    for (i, _), (d, _) in zip(by_row, rows, strict=True):
        least[label[i]] = min((x for x in (least.get(label[i]), d) if x is not None), default=None)
    want = sorted(((d, least[label[i]]) for (i, _), (d, _) in zip(by_row, rows, strict=True)), key=repr)
    assert sorted(((r["doc_id"], r["component_id"]) for r in got), key=repr) == want
    assert sum(c == 5 for d, c in want if d is None) == 3


def test_join_of_nothing(spark):
    assert jaccard_join.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    blank = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.near_duplicates(blank).collect()) == [(1, 0, 1), (2, 0, 2)]


def test_regions_take_little_memory_beside_their_blocks(monkeypatch):
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(3)
    rows = []
    for i in range(20):
        which = np.repeat(np.arange(300, dtype="<u4"), 100)
        keys = rng.integers(0, 1 << 32, len(which), dtype=np.uint64).astype("<u4")
        keys[::100] = 7 << 20  # one region of every document
        rows.append((0, keys.tobytes(), which.tobytes(), np.arange(300 * i, 300 * i + 300).tobytes(), np.full(300, 100).tobytes()))
    pdf = pd.DataFrame(rows, columns=["part", "keys", "which", "nodes", "sizes"])
    tracemalloc.start()
    got = jaccard_join._regions(pdf)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[got["region"] != -1]) == 6000 and (got["a"] == 0).sum() >= 6000
    assert peak < 20 * 600_000  # bytes a signature
    monkeypatch.setattr(jaccard_join, "RUN", 1 << 40)
    whole = jaccard_join._regions(pdf)
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(map(tuple, whole.to_numpy().tolist()))


def test_linked_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for _ in range(1500):
        n = int(rng.integers(1, 400))
        u = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        drop = int(rng.integers(0, n // 4 + 1))
        v = np.unique(np.concatenate([rng.permutation(u)[drop:], rng.integers(0, 2**64, int(rng.integers(0, n // 4 + 1)), dtype=np.uint64)]))
        if len(v) and 100 * len(np.intersect1d(u, v)) >= 80 * len(np.union1d(u, v)):
            assert np.intersect1d(jaccard_join.signatures(u), jaccard_join.signatures(v)).size


def test_metric_join_loses_no_pair():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 6, (12, 64))
    x = np.maximum(base[rng.integers(0, 12, 400)] + rng.integers(-1, 2, (400, 64)) * (rng.random((400, 64)) < 0.3), 0).astype(np.int32)
    group = rng.integers(0, 40, 400)
    got = set(jaccard_join.metric_join(x, group))
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if group[i] != group[j] and jaccard_join.weighted_distance(x[i], x[j]) <= 0.2 + 1e-9}
    assert got == want and want


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)] + [(k, k + 1) for k in range(5000, 5300)] + [(9000, k) for k in range(9001, 9400)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["label"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# neighbours


def test_neighbours_recall_and_order(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, 16))
    x = (centres[rng.integers(0, 12, 3000)] + 0.4 * rng.standard_normal((3000, 16))).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)] + [(3001, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [None] * 16), (3080, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash")).repartition(4)
    got = ann.nearest(df, F.col("vec_id") % 20 == 0, cell=300).collect()
    x = x.astype(float)
    hit = total = 0
    for q in range(0, 3000, 20):
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - x[q] @ x[r["vec_id"]]) < 1e-9 and r["vec_id"] != q for r in own)
        assert all((-a["score"], a["vec_id"]) < (-b["score"], b["vec_id"]) for a, b in zip(own, own[1:], strict=False))
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20]
        hit += len(set(best) & {r["vec_id"] for r in own})
        total += 20
    assert hit / total >= 0.9 and not {r["query_id"] for r in got} & {3020, 3040, 3060, 3080}
    assert abs(ann.chi2_quantile(0.95, 8) - 15.507) < 0.01


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0])], schema)
    assert [(r["vec_id"], r["rank"]) for r in ann.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]


# pages


def page(k, body, title="T"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">buy {k} now</div><article><h1>Title {k}</h1>{body}<div class="share">Share this</div></article><section id="comments"><p>nice {k}</p></section><footer>&copy; {k}</footer></body>'


def test_article_text(spark):
    rows = [(k, f"http://h{k % 2}.org/{k}", page(k, f"<p>First &amp; {k}\n  words<p>Second&nbsp;<b>bold</b> {k}</p>")) for k in range(40)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://one.org/", "<p>plain <i>text</i><br>next<script>bad()</script>"), (103, "http://one.org/", "no tags at all & < more"), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("h", F.lit(0))
    got = {}
    out = html_text.main_text(df).collect()
    assert len(out) == len(rows)
    for r in out:
        got[r["page_id"]] = r["text"]
        assert r["n_chars"] == len(r["text"])
    for k in range(40):
        assert got[k] == f"Title {k}\nFirst & {k} words\nSecond bold {k}"
    assert got[100] == got[101] == "" and got[102] == "plain text\nnext" and got[103] == "no tags at all & < more"
    assert html_text.main_text(df.where("false")).count() == 0


def texts_of(spark, pages, parts=3):
    df = spark.createDataFrame([(i, f"http://host.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string").repartition(parts)
    return [r["text"] for r in html_text.main_text(df).orderBy("page_id").collect()]


def test_repeated_text_is_template(spark):
    pages = [page(k, f"<p>Body {k}</p><p>Subscribe to our letter today</p>") for k in range(12)]
    assert texts_of(spark, pages)[3] == "Title 3\nBody 3"


def test_a_page_has_one_text(spark):
    """Partitions, copies of pages, other hosts and any number of mates beyond the template's need make no difference."""
    body = lambda k: page(k, f"<p>Body {k} with words of its own</p><div class='x{k % 2}'><b>Label {k % 2}</b></div>" + ("<p>passage that some pages share</p>" if k % 7 == 0 else ""))
    few, many = [body(k) for k in range(40)], [body(k) for k in range(90)]
    want = [f"Title {k}\nBody {k} with words of its own" + ("\npassage that some pages share" if k % 7 == 0 else "") for k in range(90)]
    assert texts_of(spark, few, 1) == want[:40]
    assert texts_of(spark, many, 13) == want
    assert texts_of(spark, many + few[:9] * 6, 3)[:90] == want


def test_odd_pages_do_not_undo_the_template(spark):
    notice = "<p>Our shop is closed on Sundays</p>"
    body = lambda k: f"<body class='page-{k}'><div>offer {k}</div><article class='post-{k}'><p>Text {k} of a page with enough words to hold most of it, twice over</p>{notice}</article></body>"
    odd = "<body><article><p>one odd page</p></article><article><p>with two parts</p></article></body>"
    got = texts_of(spark, [body(k) for k in range(40)] + [odd])
    assert got[:40] == [f"Text {k} of a page with enough words to hold most of it, twice over" for k in range(40)]
    assert got[40] == "one odd page\nwith two parts"
    # two templates on one host: each page loses its own template's text
    lists = [f"<body><div class='list'><ul><li>Item {k}</li></ul><b>Sorted by date</b></div></body>" for k in range(20)]
    got = texts_of(spark, [body(k) for k in range(20)] + lists)
    assert got[20:] == [f"Item {k}" for k in range(20)]
    # copies of a page aren't a template
    copies = [f"<body><div class='x'><p>a {k}</p>" + "".join(f"<p>paragraph {i}</p>" for i in range(9)) + "</div></body>" for k in range(12)]
    assert all(len(t.split("\n")) == 10 for t in texts_of(spark, copies + [body(k) for k in range(20)])[:12])


def test_nothing_beside_the_largest_element_is_lost(spark):
    pages = [f"<body><div class='post'><h1>Title {k}</h1><p class='lead'>Lead {k}</p><div class='text'><p>{f'long {k} ' * 40}</p><p>end {k}</p></div></div><nav>x</nav></body>" for k in range(12)]
    assert texts_of(spark, pages)[3] == "Title 3\nLead 3\n" + ("long 3 " * 40).strip() + "\nend 3"


def test_deep_pages_take_linear_time():
    import time

    for unit in ("<div>", "<p><span>", "<div class='side'>", "<ul><li>"):
        start = time.process_time()
        blocks, _ = html_text.parse(unit * 10_000 + "deep text")
        assert [b[4] for b in blocks] == ["deep text"] and time.process_time() - start < 2


@pytest.mark.parametrize("start, end", [("<html class='header-fixed'><body class='has-sidebar'><article class='post tag-social'>", "</article>"), ("<body><div id='main' class='with-comments'>", "</div>"), ("<main class='promo'>", "</main>")])
def test_class_words_of_the_holder_are_no_boilerplate(start, end):
    blocks, _ = html_text.parse(f"{start}<h1>T</h1><p>Some text of the page</p><div class='social'>share it</div>{end}<div class='ad'>buy</div>")
    assert [b[4] for b in blocks] == ["T", "Some text of the page"]
