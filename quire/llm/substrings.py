"""Substring dedup by suffix automata of reference shards: every word of a long passage that also starts earlier goes.

The reference is the corpus itself, so automata of all of it can't be sent to every task: that costs shards times documents.
Documents are streamed in pieces instead, and a piece meets the one shard that can hold its repeats:

1. A window (20 words) is known by its anchor, the least hash of its 6-word runs; equal windows have equal anchors. A document
   becomes pieces, runs of at most 15 windows whose anchor stands at one place. Anchors are counted over all documents; a piece
   whose anchor occurs once has no repeated window and goes no further.
2. Pieces whose anchor occurs more often are a shard's reference text, each different piece once, with the first place where it
   stands. A shard's suffix automaton is built where its pieces are, each state with the earliest place of its words; the pieces
   are streamed through it, and where 20 words match, the state tells where these words stand first. Pieces hold the words
   themselves, so a match is exact. Pieces of an anchor with over HEAVY occurrences are cut to single windows, whose own hash
   then chooses the shard: no anchor can fill one.
3. A window goes if its words stand earlier; each occurrence of a piece learns that from its place and the piece's, and each
   document the words that its windows cover.

Only hashes travel for texts that repeat nothing; the text itself is shuffled once (the exchange is used by three branches)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import materialise, slices, table, worker_tables

WINDOW = 20
#: Words of a run whose hash may become an anchor.
GRAM = 6
#: Occurrences of an anchor from which on its pieces are cut to windows; about so many occurrences share an automaton.
HEAVY, SHARD = 2_000, 2_000
#: Bytes of text hashed at a time.
SLICE = 1_000_000
#: A start and a mask of windows in one number: start * MASK + mask.
MASK = 1 << 16
#: Stands for a null doc_id, which comes after every other.
LAST = 2**63 - 1

_U = np.uint64
_RNG = np.random.default_rng(20240611)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_MUL = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)
_R = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    own = worker_tables("substrings")
    if len(own.get(which, ((),))[0]) < n:
        rows = []
        for r in (_R[which], pow(_R[which], -1, 2**64)):
            p = np.full(max(n, SLICE + 1), _U(r), np.uint64)
            p[0] = 1
            rows.append(np.multiply.accumulate(p))
        own[which] = rows
    return own[which][0][:n], own[which][1][:n]


def _spans(x: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    """Hashes of x[lo:hi] for many ranges: they don't depend on where a range stands."""
    up, down = _powers(which, len(x) + 1)
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[:-1], out=total[1:])
    return _mix((total[hi] - total[lo]) * down[lo] + (hi - lo).astype(np.uint64))


class Words:
    """The words of some texts: where they start and end in data, their hashes, and each text's first (first[-1]: their number)."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts) + b"\n"
        flat = np.frombuffer(self.data, np.uint8)
        space = _SPACE[flat]
        before = np.concatenate([[True], space[:-1]])
        self.starts, self.ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
        borders = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, borders)
        self.hashes = np.zeros(len(self.starts), np.uint64)
        i = 0
        while i < len(self.starts):  # whole words, about SLICE bytes at a time
            j = max(i + 1, int(np.searchsorted(self.ends, self.starts[i] + SLICE, "right")))
            low = self.starts[i]
            self.hashes[i:j] = _spans(_BYTE[flat[low : self.ends[j - 1]]], self.starts[i:j] - low, self.ends[i:j] - low, 0)
            i = j


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Where the least of each w consecutive values stands, the first of several."""

    def better(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return np.where(x[j] < x[i], j, i)

    at, size = np.arange(len(x)), 1
    while size * 2 <= w:
        at = better(at[:-size], at[size:])
        size *= 2
    return better(at[: len(at) - (w - size)], at[w - size :]) if size < w else at


def pieces(words: Words, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, at, windows, anchor) of each piece; at: index of its first word among all words. Every window is in one piece."""
    h, gram = words.hashes, min(gram, window)
    none = np.zeros(0, np.int64)
    if len(h) < window:
        return none, none, none, none
    grams = np.zeros(len(h) - gram + 1, np.uint64)
    for k in range(gram):
        grams += h[k : len(h) - gram + 1 + k] * _MUL[k]
    grams = _mix(grams)
    anchors = _least(grams, window - gram + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    at = np.arange(len(anchors))
    at = at[at + window <= words.first[1:][text[: len(anchors)]]]
    if not len(at):
        return none, none, none, none
    new = np.ones(len(at), bool)
    new[1:] = (anchors[at[1:]] != anchors[at[:-1]]) | (at[1:] != at[:-1] + 1)
    cut = np.flatnonzero(new)
    return text[at[cut]], at[cut], np.diff(np.append(cut, len(at))), grams[anchors[at[cut]]].view(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        for a, b in slices(list(map(len, texts)), SLICE):
            yield batch.slice(a, b - a), Words(texts[a:b])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, words in _batches(batches):
        a, n = np.unique(pieces(words)[3], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n)], ["a", "n"])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, words in _batches(batches):
        text, at, _, a = pieces(words)
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays([pa.array(a), batch.column("did").take(rows), batch.column("key").take(rows), pa.array((at - words.first[text]).astype(np.int32))], ["a", "did", "key", "start"])


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of a document's repeated anchors, each different one with its words once a slice."""
    for batch, words in _batches(batches):
        text, at, windows, a = pieces(words)
        start = at - words.first[text]
        asked = batch.column("asked").to_pylist()  # start * 2, one more if the anchor is heavy
        code = np.fromiter((t << 40 | x for t, some in enumerate(asked) for x in some), np.int64)
        code.sort()
        mine = text.astype(np.int64) << 40 | start << 1
        found = np.searchsorted(code, mine)
        got = code[np.minimum(found, max(len(code) - 1, 0))] if len(code) else np.full(len(mine), -1)
        plain, heavy = np.flatnonzero(got == mine), np.flatnonzero(got == mine + 1)
        many = np.repeat(heavy, windows[heavy])
        step = np.arange(len(many)) - np.repeat(np.cumsum(windows[heavy]) - windows[heavy], windows[heavy])
        text, start = np.concatenate([text[plain], text[many]]), np.concatenate([start[plain], start[many] + step])
        windows = np.concatenate([windows[plain], np.ones(len(many), np.int64)])
        lo = words.first[text] + start
        hi = lo + windows + WINDOW - 1
        c1, c2 = _spans(words.hashes, lo, hi, 0), _spans(_mix(words.hashes ^ _MUL[63]), lo, hi, 1)
        a = np.concatenate([a[plain], c1[len(plain) :].view(np.int64)])
        said = np.zeros(len(lo), bool)
        said[np.unique(c1 + _mix(c2), return_index=True)[1]] = True
        bounds = zip(said.tolist(), words.starts[lo].tolist(), words.ends[hi - 1].tolist(), strict=True)
        rows = pa.array(text)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), batch.column("did").take(rows), batch.column("key").take(rows), pa.array(start.astype(np.int32)), pa.array(windows.astype(np.int32)), pa.array([words.data[i:j] if s else None for s, i, j in bounds], pa.binary())],
            ["a", "c1", "c2", "did", "key", "start", "windows", "words"],
        )


class Automaton:
    """Suffix automaton of several word sequences; every state knows the earliest end of its words."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.first = [-1], [0], [1 << 100]

    def _split(self, p: int, q: int, word) -> int:
        """The state of p's longest string and word, where q holds longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.first.append(1 << 100)
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def add(self, words: list, ends: int) -> None:
        """ends: place of the first word; places of words count on from it."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        last = 0
        for place, word in enumerate(words, ends):
            q = nexts[last].get(word)
            if q is not None:
                last = self._split(last, q, word)
            else:
                state = len(nexts)
                nexts.append({})
                length.append(length[last] + 1)
                link.append(0)
                first.append(1 << 100)
                p = last
                while p >= 0 and word not in nexts[p]:
                    nexts[p][word] = state
                    p = link[p]
                if p >= 0:
                    link[state] = self._split(p, nexts[p][word], word)
                last = state
            if place < first[last]:
                first[last] = place

    def close(self) -> None:
        """Places go up to shorter suffixes; nothing is added after this."""
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.link[v]
            if self.first[v] < self.first[up]:
                self.first[up] = self.first[v]

    def earliest(self, words: list, window: int) -> list[int]:
        """Matching statistics cut at window: for each word whose last window words match as a whole, the earliest place where they end; else -1."""
        nexts, link, length, first = self.next, self.link, self.length, self.first
        out, v, n = [], 0, 0
        for word in words:
            while v and word not in nexts[v]:
                v = link[v]
                n = length[v]
            if word in nexts[v]:
                v, n = nexts[v][word], n + 1
            if n >= window:
                n = window
                while length[link[v]] >= window:
                    v = link[v]
            out.append(first[v] if n == window else -1)
        return out


def _shard(pieces_: pa.Table) -> pa.Table:
    """mask of each piece: bit j is set if the words of its window j stand earlier than where the piece first stands."""
    rows = sorted(zip(pieces_["did"].to_pylist(), pieces_["start"].to_pylist(), pieces_["words"].to_pylist(), range(pieces_.num_rows), strict=True))
    rank = {did: k for k, did in enumerate(sorted({r[0] for r in rows}))}
    ids: dict[bytes, int] = {}
    texts = [[ids.setdefault(w, len(ids)) for w in r[2].split()] for r in rows]
    automaton = Automaton()
    for (did, start, _, _), words in zip(rows, texts, strict=True):
        automaton.add(words, rank[did] << 40 | start)
    automaton.close()
    masks = [0] * len(rows)
    for (did, start, _, k), words in zip(rows, texts, strict=True):
        own = (rank[did] << 40 | start) + WINDOW - 1
        for j, place in enumerate(automaton.earliest(words, WINDOW)[WINDOW - 1 :]):
            masks[k] |= (0 <= place < own + j) << j
    return pieces_.select(["c1", "c2", "did", "start"]).append_column("mask", pa.array(masks, pa.int64()))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
            words = (text or "").encode().split()
            n = len(words)
            cover = np.zeros(n + 1, np.int64)
            for start, mask in (divmod(x, MASK) for x in gone or ()):
                for j in range(mask.bit_length()):
                    if mask >> j & 1:
                        cover[start + j] += 1
                        cover[start + j + WINDOW] -= 1
            kept = b" ".join(words if not gone else [words[i] for i in np.flatnonzero(np.cumsum(cover[:n]) == 0).tolist()])
            left = n if not gone else int((np.cumsum(cover[:n]) == 0).sum())
            for column, v in zip(out, (n, n - left, hashlib.sha256(kept).hexdigest(), kept.decode()), strict=True):
                column.append(v)
        names = ["n_words", "n_removed", "kept_sha256", "kept"]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], ["doc_id", *names])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept of every row of docs(doc_id, text); kept: the words that stay, joined by one space.

    A place is earlier than another if its doc_id is smaller, or equal and its start is smaller; a null doc_id comes last. Rows that
    share a doc_id are one document in that order, so what stands at the same start in two of them is earlier in neither, and equal rows
    have equal results. Null and empty texts have no words; fewer than 20 words are no window. Extra columns are ignored; an empty table
    gives no rows. A text's memory grows with its own length only."""
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(LAST)).alias("did"), F.xxhash64("text").alias("key"), "text")
    counted = keyed.select("text").mapInArrow(_counts, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    repeated = materialise(counted, "anchors")
    total = repeated.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    here = keyed.select("did", "key", "text").mapInArrow(_anchors, "a long, did long, key long, start int")
    asked = here.join(repeated, "a").select("did", "key", (F.col("start").cast("long") * 2 + (F.col("n") > HEAVY).cast("long")).alias("at"))
    asked = materialise(asked.groupBy("did", "key").agg(F.collect_set("at").alias("asked")), "asked")

    texts = keyed.repartition("did", "key")
    found = texts.join(asked, ["did", "key"]).mapInArrow(_occurrences, "a long, c1 long, c2 long, did long, key long, start int, windows int, words binary")
    piece = ["c1", "c2"]
    distinct = found.groupBy(piece).agg(F.min("a").alias("a"), F.min(F.struct("did", "start")).alias("at"), F.first("words", ignorenulls=True).alias("words"))
    distinct = distinct.select(*piece, "at.did", "at.start", "words", F.pmod("a", F.lit(shards)).alias("shard"))
    known = distinct.groupBy("shard").applyInArrow(_shard, "c1 long, c2 long, did long, start int, mask long")
    known = known.select(*piece, F.struct("did", "start").alias("at"), "mask")
    gone = F.when(F.col("at") < F.struct("did", "start"), F.pow(F.lit(2), "windows").cast("long") - 1).otherwise(F.col("mask"))
    spans = found.drop("a", "words").join(known, piece).withColumn("mask", gone.cast("long")).where("mask <> 0")
    spans = spans.groupBy("did", "key").agg(F.collect_set(F.col("start").cast("long") * MASK + F.col("mask")).alias("gone"))
    return texts.join(spans, ["did", "key"], "left").mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), spans AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS pos, w FROM words WHERE len(w) >= 20
), hashed AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(w, pos, pos + 19), ' ')) AS h FROM spans
), later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY h ORDER BY doc_id, pos) AS k FROM hashed) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, pos + unnest(range(20)) AS pos FROM later
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS text, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM words) LEFT JOIN gone USING (doc_id, pos)
  WHERE gone.pos IS NULL GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
