"""Mixing sources to target weights by the cube method.

Targets: sources in code-point order (null last) share the corpus's words by cyclic weights; no target
is above CAP times its source, the excess is shared again by weight. A document is taken
floor(r) times for sure, r = target / source size, and once more with probability frac(r). The cube
method draws that last copy: within a group of documents of one source, the vector of fractional
probabilities moves through the null space of two constraints (tokens taken and documents taken)
until a coordinate reaches 0 or 1. Three undecided documents suffice for a move; at most two
stay undecided in a group. These go on to the next round, in groups of their own, until a source
has one group left; its last documents are landed by the cheapest of the few outcomes.

Groups hold GROUP documents at most, whatever the source's size, so a source with a third of all rows
is many groups; rounds shrink the rows by GROUP / 2 each.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, materialise, table

GROUP = 4096
CAP = 3.0
#: Cyclic source weights of the contract: fixed values.
WEIGHTS = (5.0, 2.0, 1.0)
MAX_SOURCES = 100_000


def targets(sizes: list[float], weights: list[float], total: float, cap: float = CAP) -> list[float]:
    """Share total by weight; a source above cap times its size keeps that and the rest is shared again."""
    out = [0.0] * len(sizes)
    free, left = [i for i in range(len(sizes)) if sizes[i] > 0], float(total)
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            return out
        for i in over:
            out[i] = cap * sizes[i]
        left -= sum(out[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


def flight(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Flight phase for the constraints sum(p) and sum(p * x): at most two coordinates stay strictly between 0 and 1."""
    p, eps = p.astype(float).copy(), 1e-9
    waiting = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    live: list[int] = []
    for i in waiting:
        live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        v = np.array([x[b] - x[c], x[c] - x[a], x[a] - x[b]], float)  # null space of (1, 1, 1) and (xa, xb, xc)
        if not v.any():
            v = np.array([1.0, -1.0, 0.0])
        v /= np.abs(v).max()
        now = p[live]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(v > 0, (1 - now) / v, np.where(v < 0, -now / v, np.inf)).min()
            down = np.where(v > 0, now / v, np.where(v < 0, (now - 1) / v, np.inf)).min()
        # either end keeps the expectation with these odds; the choice is a fixed function of the ids' order
        step = up if _coin(a, b, c, float(now.sum())) * (up + down) < down else -down
        p[live] = np.clip(now + step * v, 0, 1)
        live = [k for k in live if eps < p[k] < 1 - eps]
    return p


def _coin(a: int, b: int, c: int, s: float) -> float:
    h = (a * 0x9E3779B97F4A7C15 + b * 0xBF58476D1CE4E5B9 + c * 0x94D049BB133111EB + int(s * 1e6) * 0xD6E8FEB86659FD93) & (2**64 - 1)
    h ^= h >> 31
    h = h * 0x7FB5D329728EA185 & (2**64 - 1)
    return (h >> 11) / 2**53


def landing(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The few coordinates left take the 0/1 values that come nearest to the tokens still due, then to the documents."""
    open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    out = np.round(p)
    if len(open_):
        due, docs = float((p * x)[open_].sum()), float(p[open_].sum())
        best = min(product((0, 1), repeat=len(open_)), key=lambda z: (abs(float(np.dot(z, x[open_])) - due), abs(sum(z) - docs), z))
        out[open_] = best
    return out


def _round(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tie", "row"], kind="stable")
        p = flight(pdf["p"].to_numpy(float), pdf["size"].to_numpy(float))
        if last:
            p = landing(p, pdf["size"].to_numpy(float))
        return pdf.assign(p=np.where(p < 1e-9, 0.0, np.where(p > 1 - 1e-9, 1.0, p)))

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP, group: int = GROUP) -> DataFrame:
    """docs(doc_id, text, source) plus nothing else -> doc_id, source, size, source_size, target, copies, taken, row.

    Null text has size 0 and is never taken more than its probability says (taken is 0 words anyway);
    null source is a source of its own, last in order. Repeated rows are rows of their own (row tells
    them apart in order of doc_id, text hash). Empty input gives empty output. Reruns agree: coins are functions
    of positions in a group, whose members and order come from hashes of ids and texts."""
    spark = docs.sparkSession
    sized = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("tie"),
    )
    # copies of the very same row get numbers, so that each has its own coin
    sized = sized.withColumn("row", F.expr("row_number() OVER (PARTITION BY doc_id, tie ORDER BY source)"))
    sized = materialise(sized, "mix-sizes")
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()  # one row a source
    if len(per) > MAX_SOURCES:
        raise ValueError(f"{len(per)} sources; the bound is {MAX_SOURCES}")
    per = sorted(per, key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-8")))
    goal = targets([r["source_size"] for r in per], [weights[i % len(weights)] for i in range(len(per))], sum(r["source_size"] for r in per), cap)
    plan = spark.createDataFrame(
        [(i, r["source"], int(r["source_size"]), float(t), int(r["n"]), float(t / r["source_size"]) if r["source_size"] else 0.0) for i, (r, t) in enumerate(zip(per, goal, strict=True))],
        "sid int, source string, source_size long, target double, n long, rate double",
    )
    rows = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["source"])).drop(plan["source"])
    rows = rows.withColumn("sure", F.floor("rate")).withColumn("p", F.col("rate") - F.floor("rate"))
    most = max((r["n"] for r in per), default=0)
    left, done = rows.select("sid", "doc_id", "row", "tie", "size", "p", "n"), []
    number = 0
    while True:
        last = most <= group
        n_groups = F.ceil(F.col("n") / (group // 2)).cast("int") if not last else F.lit(1)
        keyed = left.withColumn("g", F.pmod(F.xxhash64("tie", "row", F.lit(number)), n_groups) if not last else F.lit(0))
        moved = keyed.groupBy("sid", "g").applyInPandas(_round(last), keyed.schema).drop("g")
        moved = materialise(moved, f"mix-{number}")
        if last:
            done.append(moved)
            break
        done.append(moved.where("p <= 0 OR p >= 1"))
        left = moved.where("p > 0 AND p < 1").drop("n")
        counts = left.groupBy("sid").agg(F.count("*").alias("n"))
        most = counts.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        left = left.join(F.broadcast(counts), "sid")  # one row a source
        left = left.select("sid", "doc_id", "row", "tie", "size", "p", "n")
        number += 1
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    drawn = drawn.select("sid", F.col("doc_id"), "row", "tie", "size", F.col("p").cast("long").alias("extra"))
    out = drawn.join(F.broadcast(plan), "sid")
    copies = F.floor("rate").cast("long") + F.col("extra")
    return out.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row", "tie")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")
