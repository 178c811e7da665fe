"""Importance resampling towards a target: hashed n-gram features, weights from bucket counts, a Gumbel top-k draw.

An integer dictionary maps each distinct word to an id. The n-grams of a slice of texts are tuples of ids, and each distinct tuple's
bytes are put together and hashed once: a tuple goes on from the shorter tuple it extends, and CRC-32 goes on with it. The counts
and buckets of the distinct tuples are then joined back to their occurrences by position. Dictionary and tuples belong to a worker and
a slice: a bucket depends on the bytes alone, so one dictionary for all would only move every n-gram twice through a shuffle.

Pass 1 counts buckets: each task sends one number a bucket. Pass 2 sums each document's gains. Both read the documents whole and
shuffle none of their text. Ranks come from a range partitioning and the partitions' counts, not from one sorted task."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import materialise, slices, table, worker_tables

BUCKETS = 10_000
LONGEST = 3
#: The draw: a share in hundredths of the documents with so many words.
PERCENT, LEAST_WORDS = 5, 20
SEED = 42
#: Bytes of text whose tuples are told apart at a time; words a worker's dictionary holds before it starts anew.
SLICE, MAX_WORDS = 2_000_000, 400_000
#: Bytes of words: digits, letters (A-Z read as a-z) and whatever isn't ASCII; the rest is space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


class Dictionary(dict):
    """Word -> id, with the CRC-32 of each word and the bytes by which it continues a tuple."""

    def __init__(self):
        super().__init__()
        self.spaced: list[bytes] = []
        self.crc = np.zeros(1024, np.uint32)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.spaced)
        self.spaced.append(b" " + word)
        if n == len(self.crc):
            self.crc = np.concatenate([self.crc, np.zeros(n, np.uint32)])
        self.crc[n] = zlib.crc32(word)
        return n


def _dictionary() -> Dictionary:
    own = worker_tables("resampling")
    if len(own.get("words", ())) > MAX_WORDS or "words" not in own:
        own["words"] = Dictionary()
    return own["words"]


def features(texts: list[bytes]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """Words of each text, and for n = 1, 2, ...: the CRC-32 of each distinct tuple of n ids, its number for each
    n-gram, and the index of each n-gram's text."""
    known = _dictionary()
    words = [t.translate(_WORD_BYTES).split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    ids = np.fromiter((known[w] for some in words for w in some), np.int64, int(counts.sum()))
    text = np.repeat(np.arange(len(texts)), counts)
    used, number = np.unique(ids, return_inverse=True)
    crc, out = known.crc[used], []
    out.append((crc, number, text))
    for n in range(2, LONGEST + 1):
        if len(ids) < n:
            break
        whole = text[: len(ids) - n + 1] == text[n - 1 :]
        shorter = number[: len(ids) - n + 1][whole] if n == 2 else number[np.searchsorted(at, np.arange(len(ids))[: len(ids) - n + 1][whole])]
        at = np.flatnonzero(whole)
        distinct, first, number = np.unique(shorter << 32 | ids[at + n - 1], return_index=True, return_inverse=True)
        last = ids[at[first] + n - 1].tolist()
        crc = np.fromiter(map(zlib.crc32, map(known.spaced.__getitem__, last), crc[shorter[first]].tolist()), np.uint32, len(distinct))
        out.append((crc, number, text[at]))
    return counts, out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, list]]:
    for batch in batches:
        texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
        for a, b in slices(list(map(len, texts)), SLICE):
            yield batch.slice(a, b - a), *features(texts[a:b])


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features of all texts by bucket: one row a bucket and task is shuffled, one a bucket comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for _, _, grams in _slices(batches):
            for crc, number, _ in grams:
                often = np.bincount(number, minlength=len(crc))
                total += np.bincount(crc % buckets, weights=often, minlength=buckets).astype(np.int64)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], ["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(docs: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and in the documents."""
    s_all, t_all, n = float(sum(docs)), float(sum(target)), len(docs)
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(docs, target, strict=True)]


def weigh(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, key (a hash of the text), n_words, n_features, weight, score of every row of docs(doc_id, text), weighed towards target(text).

    Null and empty texts have no features and weight 0. Repeated rows count each; an empty target makes every count 0. A null
    doc_id draws its noise as the empty text would. Other columns are ignored."""
    gain = np.array(gains(bucket_counts(docs, buckets), bucket_counts(target, buckets)), np.int64)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, counts, grams in _slices(batches):
            n, weight = np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
            for crc, number, text in grams:
                borders = np.searchsorted(text, np.arange(len(counts) + 1))
                total = np.concatenate([[0], np.cumsum(gain[crc % buckets][number])])
                n += np.diff(borders)
                weight += total[borders[1:]] - total[borders[:-1]]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(counts), pa.array(n), pa.array(weight)], ["doc_id", "key", "n_words", "n_features", "weight"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("key"), "text")
    weighed = keyed.mapInArrow(add, "doc_id long, key long, n_words long, n_features long, weight long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighed.withColumn("score", F.col("weight") + noise)


def ranked(weighed: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """weighed's rows with rank: 1, 2, 3 ... for the drawn ones, highest score first, ties to the smaller doc_id (null last); else null.

    Drawn are percent hundredths, rounded down, of the rows with at least least_words words."""
    weighed = materialise(weighed, "weighed")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("key")]
    able = weighed.where(F.col("n_words") >= least_words).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    able = materialise(able, "ranges")
    counts = sorted(map(tuple, able.groupBy("part").count().collect()))  # one row a partition
    base, rows = 0, []
    for part, n in counts:
        rows.append((part, base))
        base += n
    bases = F.broadcast(weighed.sparkSession.createDataFrame(rows, "part int, base long"))
    rank = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = able.join(bases, "part").withColumn("rank", rank).drop("part", "base")
    placed = placed.withColumn("rank", F.when(F.col("rank") <= percent * base // 100, F.col("rank")))
    rest = weighed.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that the draw takes, with their rank; rows that repeat id and text have the rank of the best of them."""
    drawn = ranked(weigh(docs, target), percent).where("rank IS NOT NULL").groupBy("doc_id", "key").agg(F.min("rank").alias("rank"))
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    return keyed.join(drawn.withColumnRenamed("doc_id", "__id"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("key"))).select(*(keyed[c] for c in docs.columns), drawn["rank"].alias("draw_rank"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    weighed = weigh(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return ranked(weighed).select("doc_id", "n_features", "weight", "score", "rank")


OP12_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), lut AS (
  SELECT list(c ORDER BY i) AS lut FROM steps WHERE k = 8
), texts AS (
  SELECT true AS mine, row_number() OVER () AS r, doc_id, text FROM documents
  UNION ALL SELECT false, -row_number() OVER (), NULL, text FROM benchmark
), words AS (
  SELECT mine, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), grams AS (
  SELECT mine, r, array_to_string(list_slice(w, pos, pos + n - 1), ' ') AS f
  FROM (SELECT mine, r, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM words, (SELECT unnest([1, 2, 3]) AS n))
), bytes AS (
  SELECT f, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT) AS b FROM (SELECT DISTINCT f FROM grams)
), buckets AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, lut[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, lut
), counts AS (
  SELECT mine, r, bucket, count(*) AS n FROM grams JOIN buckets USING (f) GROUP BY ALL
), sums AS (
  SELECT bucket, sum(n) FILTER (mine) AS s, sum(n) FILTER (NOT mine) AS t FROM counts GROUP BY bucket
), totals AS (
  SELECT sum(coalesce(s, 0)) AS s_all, sum(coalesce(t, 0)) AS t_all FROM sums
), gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (s_all + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g FROM sums, totals
), weighed AS (
  SELECT r, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM counts JOIN gain USING (bucket) WHERE mine GROUP BY r
), scored AS (
  SELECT doc_id, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM words LEFT JOIN weighed USING (r) WHERE mine
), places AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS k, count(*) OVER (PARTITION BY able) AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 5 * n // 100 THEN k END AS rank FROM places
"""
