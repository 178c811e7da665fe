"""Trained operators on small corpora, by accuracy on rows they haven't seen, and on awkward inputs."""

import math
import random
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import chars, language, quality, toxicity
from quire.llm.common import held_out, order_bits, quantiles

SYLLABLES = {"en": "the and ing ion ent ther wh ou st".split(), "fr": "le é eau tion oi qu è ment ai".split(), "ru": "при ов ого ние ста ть во ен".split()}


def words(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def tongues():
    rng = random.Random(1)
    return [(i, words(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(5, 60)), lang) for i in range(400)]


def test_language(spark, tongues):
    df = spark.createDataFrame(tongues, "doc_id long, text string, lang string")
    model = language.train(df.where(~held_out(F.col("doc_id"), 4, 2)))
    odd = [(1000, None), (1001, ""), (1002, "12 34 !!"), (1003, "日本語の文章です"), (1004, "the " * 50_000), (0, "the and ing")]
    rows = [(i, t) for i, t, _ in tongues] + odd
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang_pred", F.lit("clash")), model).collect()
    assert len(out) == len(rows)
    truth = {i: x for i, _, x in tongues}
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in out if r["doc_id"] in truth]) > 0.98
    got = {r["doc_id"]: r for r in out if r["doc_id"] >= 1000}
    assert all(got[i]["lang_pred"] == "und" and got[i]["lang_score"] == 0 and got[i]["lang_rejected"] for i in (1000, 1001, 1002))
    assert got[1004]["lang_pred"] == "en" and not got[1004]["lang_rejected"] and got[1003]["lang_rejected"]
    assert all(0 <= r["lang_score"] <= 1 for r in out)


def padded(text):
    """Letters of a text, lower-cased, runs of anything else as one 0, between two 0s in front and one behind."""
    out = [0, 0]
    for ch in text.lower():
        c = ord(ch) if unicodedata.category(ch)[0] in "LM" else 0
        if c or out[-1]:
            out.append(c)
    return out + [0] * (out[-1] != 0)


def brute_kneser_ney(texts, d):
    """P(w | u v) from definitions."""
    tri = Counter(tuple(p[i : i + 3]) for p in map(padded, texts) for i in range(len(p) - 2) if p[i + 1] or p[i + 2])
    bi = Counter((v, w) for _, v, w in tri)
    uni = Counter(w for _, w in bi)

    def p1(w):
        seen = len(uni)
        return (max(uni[w] - d, 0) + d * seen / (seen + 1)) / sum(uni.values()) if w in uni else None

    def p2(v, w):
        row = [n for (a, _), n in bi.items() if a == v]
        return max(bi[v, w] - d, 0) / sum(row) + d * len(row) / sum(row) * p1(w) if row else p1(w)

    def p3(u, v, w):
        own = [n for (a, b, _), n in tri.items() if (a, b) == (u, v)]
        return max(tri[u, v, w] - d, 0) / sum(own) + d * len(own) / sum(own) * p2(v, w) if own else p2(v, w)

    return p3


def test_kneser_ney_equals_its_definition(spark):
    texts = {"en": ["the thing in the ring", "then sing.", "a"], "he": ["שלום עולם טוב", "עולם שלום"], "ar": ["سلام عالم", "عالم سلام"]}
    rows = [(i, t, x) for i, (x, t) in enumerate((x, t) for x, own in texts.items() for t in own)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    asked = [(x, t) for x, t in [("en", "the ring sings"), ("en", "thinng a"), ("he", "טוב שלום"), ("ar", "عالم")]]
    got = language.entropies([t for _, t in asked], model.tables())
    for (x, t), h in zip(asked, got, strict=True):
        p, c = brute_kneser_ney(texts[x], language.DISCOUNT), padded(t)
        want = -np.mean([math.log(p(*c[i : i + 3])) for i in range(len(c) - 2) if c[i + 1] or c[i + 2]])
        assert abs(h[model.langs.index(x)] - want) < 1e-5, (x, t)
        assert model.langs[h.argmin()] == x
    alone = np.concatenate([language.entropies([t], model.tables()) for _, t in asked])
    assert np.allclose(alone, got)


def test_letters_of_every_plane_and_bare_marks(spark):
    model = language.train(spark.createDataFrame([(1, "the ring", "en")], "doc_id long, text string, lang string"))
    rows = [(1, "\u0301\u0302 12"), (2, chr(0x30001) * 3), (3, "i\u0301")]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got == {1: "und", 2: "en", 3: "en"}


def test_language_without_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = language.train(none)
    assert language.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first()["lang_pred"] == "und"


def test_language_is_calibrated_on_every_row(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, lang := rng.choice(list(SYLLABLES)), rng.randint(3, 12)), lang) for i in range(5200)]
    rows += [(9001, "12 34", "xx"), (9002, "", "en"), (9003, "12 34", "fr"), (9004, "the", "en")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5))
    assert model.langs == ["en", "fr", "ru"]
    rows = [r for r in rows if any(map(str.isalpha, r[1]))]
    h, letters = language.entropies([t for _, t, _ in rows], model.tables()), chars.letters([t for _, t, _ in rows])
    truth = np.array([model.langs.index(x) for _, _, x in rows])
    for j in range(3):
        assert model.ceiling[j] == pytest.approx(np.quantile(h[(truth == j) & (letters > 20), j], language.REJECT) + language.MARGIN, abs=1e-12)

    def loss(t):
        p = np.exp(-t * h) / np.exp(-t * h).sum(1, keepdims=True)
        return -np.log(np.maximum(p[np.arange(len(h)), truth], 1e-12)).sum()

    assert model.temperature == min(language.TEMPERATURES, key=loss)


def test_languages_keep_every_gram_beyond_a_shard(spark, tongues, monkeypatch):
    df = spark.createDataFrame(tongues + [(900, "đ đe đa", "vi")], "doc_id long, text string, lang string")
    asked = spark.createDataFrame([(i, t) for i, t, _ in tongues] + [(1000, None), (1001, ""), (1003, "日本語の文章です"), (1004, "đa the ring " * 9000)], "doc_id long, text string")
    columns = ("lang_pred", "lang_score", "lang_entropy", "lang_rejected")
    whole = language.train(df)
    want = {r["doc_id"]: [r[c] for c in columns] for r in language.identify(asked, whole).collect()}
    monkeypatch.setattr(language, "MAX_GRAMS", 300)
    cut = language.train(df)
    assert cut.shards > 2 and cut.langs == whole.langs and cut.temperature == whole.temperature and np.allclose(cut.ceiling, whole.ceiling, rtol=1e-9)
    held = [sum(len(cut.part(k)[j][0][0]) for k in range(cut.shards)) for j in range(len(cut.langs))]
    assert held == [len(whole.orders[j][0][0]) for j in range(len(cut.langs))]
    got = language.identify(asked, cut).collect()
    assert len(got) == len(want)
    for r in got:
        a, b = [r[c] for c in columns], want[r["doc_id"]]
        assert a[::3] == b[::3] and np.allclose(a[1:3], b[1:3], rtol=1e-6), r["doc_id"]


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    values = {0: rng.normal(size=999), 1: np.array([-0.0, 0.0, -1e-300, 5.0, 5.0]), 7: np.array([3.25])}
    rows = [(k, int(b)) for k, x in values.items() for b in order_bits(x)]
    qs = [0.0, 0.05, 0.5, 0.999, 1.0]
    got = quantiles(spark.createDataFrame(rows, "k long, v long").repartition(7), "k", "v", qs)
    assert set(got) == set(values)
    for k, x in values.items():
        assert np.allclose(got[k], np.quantile(x, qs), rtol=1e-12, atol=0)
    assert quantiles(spark.createDataFrame([], "k long, v long"), "k", "v", qs) == {}


def test_quality(spark):
    rng = random.Random(2)
    rows, marks = [], []
    for i in range(900):
        bad = rng.random() < 0.25
        t = words(rng, "en", rng.randint(20, 80)).capitalize() + "."
        if bad:
            t = rng.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join(w + "###" for w in t.split())])
        rows.append((i, t))
        if rng.random() < 0.5:
            marks.append((i, int(not bad)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")
    fold = held_out(F.col("doc_id"), 4, 2)
    model = quality.train(docs.where(~fold), labels.where(~fold))
    assert 0.6 < model.prior < 0.9
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "word " * 60_000), (5001, "")], "doc_id long, text string")
    out = quality.score(docs.unionByName(odd).withColumn("quality_score", F.lit("clash")), model).collect()
    assert len(out) == 904 and all(0 <= r["quality_score"] <= 1 for r in out)
    truth, score = dict(marks), {r["doc_id"]: r["quality_score"] for r in out}
    assert np.mean([(score[i] >= quality.THRESHOLD) == bool(y) for i, y in truth.items()]) > 0.95
    assert quality.score(docs.where("false"), model).count() == 0
    blank = quality.train(docs.where("false"), labels)
    assert quality.score(odd, blank).count() == 4


def test_quality_is_fitted_on_every_row(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["the", "ring", "and", "Sing.", "12"]) for _ in range(rng.randint(1, 5))) + (" ##!" if i % 4 == 0 else "")) for i in range(21_000)] + [(None, "no id"), (30_000, None)]
    marks = [(i, 1) for i in range(21_000) if i % 4 and i % 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = quality.train(docs, spark.createDataFrame(marks, "doc_id long, quality int"))
    import pyarrow as pa

    rows = [r for r in rows if r[1] is not None]
    x = np.concatenate([x for _, _, x in quality.batch_features(pa.array([t for _, t in rows]))]).astype(np.float64)
    assert np.allclose(model.mean, x.mean(0), rtol=1e-6, atol=1e-9)
    good = np.isin([-1 if i is None else i for i, _ in rows], [i for i, _ in marks])
    x = np.clip((x - model.mean) / model.scale, -6, 6)
    assert 0.7 < model.prior < 0.8

    def risk(v):
        z = x @ v[:-1] + v[-1]
        below = np.logaddexp(0, z).mean() - model.prior * np.logaddexp(0, z[good]).mean()
        return model.prior * np.logaddexp(0, -z[good]).mean() + max(0, below) + max(quality.DECAY, quality.PRIOR_ROWS / len(x)) * (v[:-1] ** 2).sum() / 2, below

    v = np.append(model.w, model.b)
    least, below = risk(v)
    assert below >= 0
    for _ in range(30):
        step = np.random.default_rng(rng.randrange(1 << 30)).normal(size=len(v))
        assert risk(v + 0.01 * step)[0] > least - 1e-6


def test_features_do_not_depend_on_neighbours():
    texts = ["Hello world. Hello world.", "", "ALL CAPS!!\nx", "é ü"]
    import pyarrow as pa

    together = np.concatenate([x for _, _, x in quality.batch_features(pa.array(texts))])
    alone = np.concatenate([x for t in texts for _, _, x in quality.batch_features(pa.array([t]))])
    assert np.allclose(together, alone)


def test_toxicity(spark):
    rng = random.Random(3)
    insults = ["idiot", "moron", "scumface"]
    rows, marks = [], []
    for i in range(1600):
        w = words(rng, "en", rng.randint(15, 50)).split()
        kind = rng.random()
        toxic = kind < 0.2
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(insults) + rng.choice(["", "s", "like"]))
        elif kind < 0.3:
            w.insert(rng.randrange(len(w)), "not an " + rng.choice(insults))
        rows.append((i, " ".join(w) + "."))
        marks.append((i, int(toxic)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    fold = held_out(F.col("doc_id"), 5, 0)
    grammar = toxicity.train(docs.where(~fold), labels.where(~fold))
    odd = spark.createDataFrame([(5000, None), (5001, ""), (5002, "word " * 60_000 + "idiot idiot"), (5001, "")], "doc_id long, text string")
    out = toxicity.score(docs.where(fold).unionByName(odd).withColumn("toxic_clauses", F.lit("clash")), grammar).collect()
    score, truth = {r["doc_id"]: r["toxic_score"] for r in out}, dict(marks)
    assert all(0 <= s <= 1 for s in score.values()) and score[5002] > 0.5 > score[5001] and score[5000] == score[5001]
    assert np.mean([(s >= 0.5) == bool(truth[i]) for i, s in score.items() if i in truth]) > 0.95
    pair = spark.createDataFrame([(1, "you are an idiot"), (2, "he is not an idiot")], "doc_id long, text string")
    two = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(pair, grammar).collect()}
    assert two[1] > two[2]


def test_readings():
    hits = lambda t: {t.index("idiot"): 2.0}
    for text, at in (("an idiot came", toxicity.PLAIN), ("he is not an idiot", toxicity.NEGATED), ("she said idiot", toxicity.REPORTED), ("“idiot” it read", toxicity.REPORTED), ("you idiot", toxicity.AIMED), ("no. idiot", toxicity.PLAIN)):
        x = toxicity.readings(text, hits(text))
        assert np.flatnonzero(x[:4]).tolist() == [at], text


def test_threats_count_by_themselves(spark):
    for text, at in (("I will stab you", toxicity.AIMED), ("I will not stab you", toxicity.NEGATED), ("he wrote I will stab you", toxicity.REPORTED), ("ich werde dich töten", toxicity.AIMED), ("the hunt went on", toxicity.PLAIN)):
        x = toxicity.readings(text, {})
        assert np.flatnonzero(x[9:]).tolist() == [at] and (x[8] > 0) == (at == toxicity.AIMED), text
    rng = random.Random(4)
    rows = [(i, words(rng, "en", 20) + (" idiot." if i % 4 == 0 else ".")) for i in range(800)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(800)], "doc_id long, toxic int")
    grammar = toxicity.train(docs, labels)
    some = spark.createDataFrame([(1, "I will stab you tonight."), (2, "I will see you tonight."), (3, "the hunt went on"), (4, "c'est l'idiot")], "doc_id long, text string")
    got = {r["doc_id"]: r["toxic_score"] for r in toxicity.score(some, grammar).collect()}
    assert got[1] > 0.5 > got[2] and got[3] < 0.5 < got[4]


def test_hits_inside_an_elided_word():
    text = "c'est l'idiot"
    assert toxicity.readings(text, {text.index("idiot"): 2.0})[toxicity.PLAIN] > 0


def test_lexicon_knows_whole_words_and_scripts_apart():
    begin, keys = toxicity.word_keys(chars.codes(["extraordinarily extraordinarilz ab שלום עולם x1idiot"])[0])
    whole = keys[-1]
    assert len(begin) == 7 and len(set(whole.tolist())) == 7 and keys[0][0] == keys[0][1] >= 0 and keys[0][2] == -1
    text = "x1idiot came"
    assert toxicity.readings(text, {text.index("idiot"): 2.0})[toxicity.PLAIN] > 0


def test_words_with_the_same_letters_are_different_words():
    import pyarrow as pa

    base = quality._K * quality._K + quality.LONGEST
    x = np.concatenate([x for _, _, x in quality.batch_features(pa.array(["xabcy xbacy xcaby", "xabcy xabcy xabcy"]))])
    assert x[0, base] == 1 and abs(x[1, base] - 1 / 3) < 1e-6


def test_no_toxic_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    g = toxicity.train(docs, spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int"))
    assert toxicity.score(docs, g).where("toxic_score < 0.5").count() == 2
    g = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(docs, g).count() == 2
