"""Substring dedup against brute force."""

import hashlib
import random
import re

import pytest

from quire.llm import substrings
from quire.llm.substrings import Automaton, Words, pieces, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """Sorted results of rows (doc_id, text); equal ids are one document in the order of places."""
    last = max([d for d, _ in rows if d is not None], default=0) + 1
    words = [(last if d is None else d, WORD.findall(t or "")) for d, t in rows]
    first = {}
    for d, w in words:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (doc, _), (d, w) in zip(rows, words, strict=True):
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < (d, i) for k in range(window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def documents(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    prose = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    shared, line = prose(60), prose(10)
    rows = []
    for i in range(60):
        w = prose(rng.randrange(0, 120))
        if i % 3 == 0:
            at = rng.randrange(len(w) + 1)
            w[at:at] = shared[rng.randrange(0, 20) : rng.randrange(30, 61)]
        if i % 2 == 0:
            w += line + prose(3)
        if i % 10 == 1:
            w = w * 2
        if i % 15 == 2:
            w = ["again", "and"] * rng.randrange(5, 40)
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(w)))
    whole = rows[6][1]
    return rows + [(None, whole), (None, whole + " more"), (70, whole), (70, whole), (70, "x " + whole), (3, rows[9][1]), (-4, rows[12][1]), (80, None), (81, ""), (82, " \n"), (83, " ".join(shared * 40))]


@pytest.mark.parametrize("seed,heavy", [(1, 2_000), (2, 2)])
def test_repeats_equal_brute_force(spark, monkeypatch, seed, heavy):
    monkeypatch.setattr(substrings, "HEAVY", heavy)
    monkeypatch.setattr(substrings, "SHARD", 40)
    rows = documents(seed)
    docs = spark.createDataFrame([(d, t, "a", 1, "k") for d, t in rows], "doc_id long, text string, words string, a int, key string")
    assert sorted(map(tuple, remove_repeats(docs).collect()), key=repr) == brute(rows)


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_window_is_in_one_piece():
    texts = [t.encode() for _, t in documents(5) if t]
    words = Words(texts)
    text, at, windows, anchor = pieces(words)
    seen = sorted(p for a, n in zip(at.tolist(), windows.tolist(), strict=True) for p in range(a, a + n))
    assert seen == [i for k in range(len(texts)) for i in range(words.first[k], words.first[k + 1] - 19)]
    assert [len(WORD.findall(t.decode())) for t in texts] == (words.first[1:] - words.first[:-1]).tolist()


@pytest.mark.parametrize("seed", range(20))
def test_automaton_knows_earliest_places(seed):
    rng = random.Random(seed)
    texts = [[rng.randrange(3) for _ in range(rng.randrange(1, 30))] for _ in range(rng.randrange(1, 6))]
    automaton, window = Automaton(), rng.randrange(1, 5)
    for k, t in enumerate(texts):
        automaton.add(t, k << 40)
    automaton.close()
    asked = [rng.randrange(4) for _ in range(40)]
    for i, got in enumerate(automaton.earliest(asked, window)):
        want = [(k << 40) + j + window - 1 for k, t in enumerate(texts) for j in range(len(t) - window + 1) if i + 1 >= window and t[j : j + window] == asked[i + 1 - window : i + 1]]
        assert got == min(want, default=-1)
