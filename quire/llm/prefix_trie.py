"""Prefix trie of conversations by partition refinement.

Equal conversations are one sequence from the start, with their number and their smallest id. All sequences begin in one class,
the root. Each round takes the active classes one turn further: a class splits by its members' next turn, and each part is a
node. A part of one sequence retires: its tail is a unary chain whose nodes need no more rounds. Parts of several sequences go
on. At the end, leaves and saved tokens are folded back from the deepest classes to the root; a chain's sums follow from its
sequence's running totals.

Conversations are rows of turns throughout, not arrays, so one may hold a third of all turns. Turns are numbered by a range
partitioning and prefix sums over its partitions; what is joined by a hot conversation or class is a plain join that Spark
can split. A round moves only sequences that still share their beginning with another."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, materialise, table

#: Conversations whose first turns take the place of the first turns of others: the ids divisible by GROUP.
GROUP, SHARED = 20, 4
#: Ids of one stretch of numbers that are put in order at a time when a node's ends are hashed.
STRETCH = 4_096
NOTHING = hashlib.sha256(b"").hexdigest()

TURN = ["h1", "h2"]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running numbers and word totals of rows sorted by conversation, inside a partition."""
    from pyspark import TaskContext

    part, key, n, total = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, words = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "words"))
        new = np.concatenate([[True], ids[1:] != ids[:-1]])
        begin = np.flatnonzero(new)
        sizes = np.diff(np.append(begin, len(ids)))
        upto = np.cumsum(words)
        place = np.arange(len(ids)) - np.repeat(begin, sizes) + 1
        upto = upto - np.repeat(upto[begin] - words[begin], sizes)
        if ids[0] == key:  # goes on from the batch before
            place[: sizes[0]] += n
            upto[: sizes[0]] += total
        key, n, total = ids[-1], int(place[-1]), int(upto[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", *TURN, "words")), pa.array(place), pa.array(upto), pa.array(np.full(len(ids), part, np.int32))], ["conv_id", *TURN, "words", "place", "upto", "part"])


def numbered(turns: DataFrame) -> DataFrame:
    """conv_id, h1, h2 (128 bits of role and text), words, place (from 1 in its conversation), upto (words up to and with it).

    turns: conv_id, turn, role, text. Null roles and texts are empty, a null turn comes first, equal turns are ordered by role and text;
    rows without conv_id are in no conversation."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.where("conv_id IS NOT NULL").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    hashed = [F.xxhash64("role", "text").alias("h1"), F.xxhash64(F.lit(1), "text", "role").alias("h2"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", *hashed)
    written = materialise(ranged.mapInArrow(_number, "conv_id long, h1 long, h2 long, words long, place long, upto long, part int"), "turns")
    borders = written.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", "upto")).alias("last"))
    key, place, upto, rows = None, 0, 0, []
    for part, first, last in sorted(map(tuple, borders.collect())):  # one row a partition
        if first != key:
            place, upto = 0, 0
        rows.append((part, first, place, upto))
        place, upto = (place + last[1], upto + last[2]) if first == last[0] else (last[1], last[2])
        key = last[0]
    before = F.broadcast(turns.sparkSession.createDataFrame(rows, "part int, conv_id long, p long, u long"))
    added = [(F.col(c) + F.coalesce(d, F.lit(0))).alias(c) for c, d in (("place", "p"), ("upto", "u"))]
    return written.join(before, ["part", "conv_id"], "left").select("conv_id", *TURN, "words", *added)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after the exchange of first turns: all conv_id; and numbered's columns of the rebuilt turns."""
    own = numbered(turns)
    heads = own.where(F.col("place") < SHARED).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", *TURN, "words"))).alias("head"))
    heads = materialise(heads, "heads")  # at most SHARED - 1 turns each
    plan = heads.select("conv_id", F.col("head").alias("mine"), (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % SHARED).cast("int").alias("h"))
    plan = plan.join(heads.withColumnRenamed("conv_id", "base"), "base", "left")

    def words(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda n, t: n + t["words"])

    given = F.when(F.col("head").isNull(), F.array().cast(heads.schema["head"].dataType)).otherwise(F.slice("head", 1, F.col("h")))
    plan = plan.select("conv_id", "h", given.alias("given"), words(F.slice("mine", 1, F.col("h"))).alias("lost"))
    shared = plan.select("conv_id", F.posexplode("given").alias("k", "t"), "given").select("conv_id", *(F.col("t")[c].alias(c) for c in (*TURN, "words")), (F.col("k") + 1).cast("long").alias("place"), words(F.slice("given", 1, F.col("k") + 1)).alias("upto"))
    moved = own.join(plan.select("conv_id", "h", F.size("given").alias("n"), (words(F.col("given")) - F.col("lost")).alias("more")), "conv_id").where(F.col("place") > F.col("h"))
    kept = moved.select("conv_id", *TURN, "words", (F.col("place") - F.col("h") + F.col("n")).alias("place"), (F.col("upto") + F.col("more")).alias("upto"))
    return heads.select("conv_id"), materialise(shared.unionByName(kept), "rebuilt")


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash over a sequence's stretches of ids as they stream by in order: memory doesn't grow with their number."""

    def done(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["rep", "ends"])

    rep, state = None, None
    for batch in batches:
        out = []
        for r, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if r != rep:
                if state:
                    out.append((rep, state.hexdigest()))
                rep, state = r, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield done(out)
    if state:
        yield done([(rep, state.hexdigest())])


def sequences(conversations: DataFrame, turns: DataFrame) -> DataFrame:
    """Each different conversation once: rep (smallest id), length, total (words), copies, ends (SHA-256 of all its ids)."""
    marks = [F.bit_xor(F.xxhash64("place", *TURN)).alias("f1"), F.bit_xor(F.xxhash64("h2", "h1", "place")).alias("f2")]
    known = conversations.join(turns.groupBy("conv_id").agg(F.count("*").alias("length"), F.sum("words").alias("total"), *marks), "conv_id", "left").fillna(0)
    known, whole = materialise(known, "known"), ["length", "total", "f1", "f2"]
    distinct = materialise(known.groupBy(whole).agg(F.min("conv_id").alias("rep"), F.count("*").alias("copies")), "distinct")
    again = known.join(distinct.where("copies > 1"), whole).select("rep", "conv_id", F.floor(F.col("conv_id") / STRETCH).alias("stretch"))
    stretches = again.groupBy("rep", "stretch").agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    hashed = stretches.repartition("rep").sortWithinPartitions("rep", "stretch").select("rep", "ids").mapInArrow(_hash_ends, "rep long, ends string")
    ends = F.coalesce("ends", F.sha2(F.col("rep").cast("string"), 256))
    return materialise(distinct.join(hashed, "rep", "left").select("rep", "length", "total", "copies", ends.alias("ends")), "sequences")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of all rebuilt conversations of turns(conv_id, turn, role, text): conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    Null roles and texts are empty; a null turn comes first, equal turns are ordered by role and text, repeated rows are turns each; rows without
    conv_id are in no conversation; the remainder of a negative conv_id is negative, as in SQL; other columns are ignored; a table without
    conversations has no nodes. There are as many rounds as turns that two different conversations begin with in common, and one."""
    conversations, rows = rebuilt(turns)
    every = sequences(conversations, rows)
    steps = materialise(rows.join(every.select(F.col("rep").alias("conv_id"), "length", "total", "copies"), "conv_id").withColumnRenamed("conv_id", "rep"), "steps")
    node, members, ended = every.agg(F.min("rep"), F.sum("copies"), F.max(F.when(F.col("length") == 0, F.col("rep")))).first()  # one row
    alone = [] if node is None else [(node, None, members, 0, ended)]
    root = turns.sparkSession.createDataFrame(alone, "node long, parent long, n_convs long, words long, ended long")
    active = every.where("length > 0").select("rep", F.lit(node).cast("long").alias("class"))

    classes, retired, depth = [root], [], 0
    while True:  # a round: the active classes go one turn further
        depth += 1
        at = materialise(active.join(steps.where(F.col("place") == depth), "rep").withColumn("more", F.col("length") > depth), "active")
        one = [F.first(c).alias(c) for c in ("length", "total", "copies", "upto")]  # of use where the part has one member
        parts = at.groupBy("class", *TURN).agg(F.min("rep").alias("node"), F.count("*").alias("members"), F.sum("copies").alias("n_convs"), F.max("words").alias("words"), F.max(F.when(~F.col("more"), F.col("rep"))).alias("ended"), *one)
        parts = materialise(parts.withColumnRenamed("class", "parent"), "parts")
        retired.append(parts.where("members = 1").select(F.col("node").alias("rep"), "parent", F.lit(depth).cast("long").alias("top"), (F.col("upto") - F.col("words")).alias("before"), "total", "copies"))
        going = parts.where("members > 1")
        if going.isEmpty():
            break
        classes.append(going.select("node", "parent", "n_convs", "words", "ended"))
        split = going.select(F.col("parent").alias("class"), *TURN, F.col("node").alias("next"))
        active = at.where("more").join(split, ["class", *TURN]).select("rep", F.col("next").alias("class"))

    folded, below = [], None
    for depth in reversed(range(len(classes))):  # leaves and savings go up; below: the classes one turn deeper
        tops = retired[depth].select("parent", F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * (F.col("total") - F.col("before"))).alias("saved"))
        children = tops if below is None else tops.unionByName(below.select("parent", "n_leaves", F.col("saved_tokens").alias("saved")))
        sums = children.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        joined = classes[depth].join(sums.withColumnRenamed("parent", "node"), "node", "left")
        saved = (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))
        below = materialise(joined.select("node", F.lit(depth).cast("long").alias("depth"), "parent", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_leaves", F.lit(1)).alias("n_leaves"), saved.alias("saved_tokens"), "ended"), "folded")
        folded.append(below)

    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = _union(folded).select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ended")
    here = nodes.where("ended IS NOT NULL").join(every.select(F.col("rep").alias("ended"), F.col("ends").alias("ends_sha256")), "ended").select(names)
    through = nodes.where("ended IS NULL").withColumn("ends_sha256", F.lit(NOTHING)).select(names)
    tails = _union(retired).select("rep", "parent", "top").join(every.select("rep", "ends"), "rep")
    chain = steps.join(tails, "rep").where(F.col("place") >= F.col("top"))
    last = F.col("place") == F.col("length")
    chain = chain.select(
        F.col("rep").alias("conv_id"), F.col("place").alias("depth"), F.when(F.col("place") == F.col("top"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), F.col("copies").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"), ((F.col("copies") - 1) * (F.col("total") - F.col("upto") + F.col("words"))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"),
    )
    return here.unionByName(through).unionByName(chain)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH RECURSIVE steps AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8
), lut AS (
  SELECT list(c ORDER BY i) AS lut FROM steps WHERE k = 8
), own AS (
  SELECT conv_id, list(md5(md5(coalesce(role, '')) || md5(coalesce(text, ''))) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS t,
    list(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), held AS (
  SELECT conv_id, t, n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, lut[(xor(c, x) & 255) + 1])), 4294967295) % 4 AS h FROM own, lut
), rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(a.t, h + 1, len(a.t))) AS t,
    list_concat(coalesce(list_slice(b.n, 1, h), []), list_slice(a.n, h + 1, len(a.n))) AS n
  FROM held a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20
), members AS (
  SELECT conv_id, len(t) AS length, d, array_to_string(list_slice(t, 1, d), '') AS node, coalesce(n[d], 0) AS words
  FROM (SELECT *, unnest(range(len(t) + 1)) AS d FROM rebuilt)
), nodes AS (
  SELECT d, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), '')) AS ends_sha256
  FROM members GROUP BY d, node
), children AS (
  SELECT left(node, 32 * (d - 1)::INT) AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1
), below AS (
  SELECT left(node, 32 * up::INT) AS node, sum((n_convs - 1) * words) AS saved, count(*) FILTER (n_children IS NULL) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS up FROM nodes LEFT JOIN children USING (node)) GROUP BY 1
)
SELECT a.conv_id, a.d AS depth, p.conv_id AS parent_conv_id, a.n_convs, coalesce(n_children, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, a.ends_sha256
FROM nodes a JOIN below USING (node) LEFT JOIN children USING (node) LEFT JOIN nodes p ON a.d > 0 AND p.node = left(a.node, 32 * (a.d - 1)::INT)
"""
