"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from quire.llm.resampling import gains, ranked, resample, weigh

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    mine, theirs = Counter(), Counter()
    for _, t in rows:
        mine.update(map(bucket, grams(t)[1]))
    for t in target:
        theirs.update(map(bucket, grams(t)[1]))
    s_all, t_all = sum(mine.values()), sum(theirs.values())
    gain = lambda b: math.floor(1000 * math.log((theirs[b] + 1) * (s_all + 10_000) / ((mine[b] + 1) * (t_all + 10_000))))
    out = []
    for d, t in rows:
        n, fs = grams(t)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([d, n, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for r in out:
        r.append(None)
    for k, r in enumerate(able[: 5 * len(able) // 100], 1):
        r[5] = k
    return sorted((tuple(r) for r in out), key=repr)


def documents(seed=1):
    rng = random.Random(seed)
    words = ["the", "The", "ÉTÉ", "été", "x1", "a-b", "naïve", "中文", "don't", "A.B", "zz_top"] + [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 90)))) for i in range(400)]
    rows += [(None, rows[7][1]), (None, rows[7][1]), (8, rows[9][1]), (8, rows[9][1]), (500, None), (501, ""), (502, " \x00-\n"), (503, "word " * 5_000), (504, "ſharp ßtreet ÀB")]
    return rows, ["W1 w2, w3 the été", "x1 w5 w6 w7", None, ""]


def test_draw_equals_brute_force(spark):
    rows, target = documents()
    docs = spark.createDataFrame([(*r, "a", 7, 1) for r in rows], "doc_id long, text string, n_words string, score int, rank int")
    weighed = weigh(docs, spark.createDataFrame([(t,) for t in target], "text string"))
    got = ranked(weighed).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, target)
    assert sum(r[5] is not None for r in brute(rows, target)) > 10


def test_drawn_documents_keep_their_columns(spark):
    rows, target = documents(2)
    docs = spark.createDataFrame([(*r, "kept") for r in rows], "doc_id long, text string, source string")
    got = resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    want = {(r[0], r[5]) for r in brute(rows, target) if r[5]}
    assert {(r["doc_id"], r["draw_rank"]) for r in got} == want and all(r["source"] == "kept" and r["text"] for r in got)


def test_nothing_to_draw(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    assert ranked(weigh(none, target)).count() == 0
    few = ranked(weigh(spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string"), target)).collect()
    assert sorted((r["doc_id"], r["n_features"], r["rank"]) for r in few) == [(1, 6, None), (2, 0, None)]
    assert gains([0, 0], [0, 0]) == [0, 0]
