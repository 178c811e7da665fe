"""The prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest

from quire.llm import prefix_trie
from quire.llm.prefix_trie import trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        words = len(WORD.findall(node[-1][1])) if node else 0
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in children[node])
    out = []
    for node, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(rebuilt[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(cs), len(node), parent, len(cs), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed):
    rng = random.Random(seed)
    turns = [("user", "hello there"), ("assistant", "yes"), ("user", None), (None, "go on \n now"), ("user", "a b c"), ("system", "")]
    rows = []
    for c in rng.sample(range(200), 90):
        for k in range(rng.randrange(1, 6)):
            rows.append((c, k, *turns[min(int(rng.expovariate(0.9)), 5)]))
    whole = [(k, "user", f"turn {k}") for k in range(12)]
    for c in (300, 301, 320, 340, 341, 360, 5_000, 9_000):  # long copies, one that ends early and one that goes on
        rows += [(c, *t) for t in whole[: 10 if c == 340 else 12]] + ([(c, 41, "user", "more")] if c == 360 else [])
    rows += [(400, None, "user", "first"), (400, 0, "user", "tie b"), (400, 0, "user", "tie a"), (400, 0, "user", "tie a"), (401, None, None, None), (None, 0, "user", "nobody's")]
    rows += [(-7, 0, "user", "below"), (-7, 1, "user", "zero"), (-20, 0, "user", "below"), (0, 0, "user", "hello there")]
    return rows


@pytest.mark.parametrize("seed,stretch", [(1, 4_096), (2, 10)])
def test_trie_equals_brute_force(spark, monkeypatch, seed, stretch):
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    rows = conversations(seed)
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, words string, depth int")
    assert sorted(map(tuple, trie(turns).collect()), key=repr) == brute([(c, t, r, x) for c, t, r, x in rows])


@pytest.mark.parametrize("rows", [[], [(None, 1, "user", "x")], [(21, 0, "user", "a"), (21, 1, "user", "b")], [(21, 0, "u", "a"), (22, 0, "u", "a")]])
def test_small_tables(spark, rows):
    got = trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)
