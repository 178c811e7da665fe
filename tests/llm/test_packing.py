import random
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from quire.llm import packing  # noqa: E402


def test_chunks_give_the_tokenizers_own_ids():
    path = public_tokenizers.path(packing.TOKENIZER)
    own, plain = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(5)
    alphabet = list("abcdeXYZ'’.,!?#$%0123 \n\t éèÉßñÇ̈́ªµº½Σσςİıé日本語한국😀\u0085  　​\x1c\x1f\x7f`≮<|>")
    texts = ["", " ", "Don't stop, it's we'll THEY'RE 1,234.5", "<|endoftext|> a<|startoftext|>b", "É́a é ≮", "ΑΣ ΑΣ."]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for t in texts:
        got = np.frombuffer(own.encode(t), f"<u{own.width}").tolist()
        assert got == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_pieces_tile_the_stream(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "hello world " * 4000, "x"), (3, "hello world", "y"), (4, "Ünïcode text.", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = [r.asDict() for r in packing.pack(docs, length=256).collect()]
    assert sum(r["start"] == 0 for r in got) == len(rows)
    stream = sorted((r["sequence_id"], r["offset"], r["length"]) for r in got)
    at = 0
    for seq, off, n in stream:
        assert (seq, off) == divmod(at, 256) and 1 <= n <= 256 - off
        at += n
    t = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = {(i, len(ids)): ids for i, x, _ in rows for ids in [t.encode(x or "", add_special_tokens=False).ids + [1]]}
    assert sum(r["doc_tokens"] > 256 for r in got) > 30  # the long document crosses many borders
    for r in got:
        piece = want[r["doc_id"], r["doc_tokens"]][r["start"] : r["start"] + r["length"]]
        assert r["length"] == len(piece) and r["ids_crc32"] == zlib.crc32(np.array(piece, "<u4").tobytes())


def test_tables_are_bounded_by_bytes():
    table = packing.Recent(lambda x: x.encode())
    words = [f"{'w' * (i % 50)}{i}" for i in range(2000)]
    before, packing.MAX_BYTES = packing.MAX_BYTES, 50_000
    try:
        for w in words + words[::-1]:
            assert table[w] == w.encode() and table.size <= 50_000
    finally:
        packing.MAX_BYTES = before
    assert len(table) + len(table.older) < 600


def test_new_words_of_many_texts_are_encoded_together():
    path = public_tokenizers.path(packing.TOKENIZER)
    own, plain = packing.ChunkTokenizer(path), Tokenizer.from_file(path)
    rng = random.Random(7)
    syllables = ["ba", "qu", "É", "ßo", "th", "X", "çö", "ing", "'s", "'LL", ",", "..", "12", "-", "<|", "日", "\u0307"]
    texts = [" ".join("".join(rng.choices(syllables, [9] * 8 + [1] * 9, k=rng.randint(1, 6))) for _ in range(40)) for _ in range(500)]
    runs, ids = [], own._ids
    own._ids = lambda some: runs.append(len(some)) or ids(some)
    before, packing.MAX_BYTES = packing.MAX_BYTES, 300_000  # the table turns over on the way
    try:
        for t, got in zip(texts, own.encode_all(texts), strict=True):
            assert np.frombuffer(got, f"<u{own.width}").tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)
    finally:
        packing.MAX_BYTES = before
    assert len(runs) <= 2  # not one for each new word


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
