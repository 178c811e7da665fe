"""Toxicity by a weighted finite-state pattern grammar.

Three transducers are composed. The lexicon reads words and writes classes: insult with a weight, threat, target, negation,
report, quotation mark, other. Insult patterns are whole words and word stems (the first 4 to 6 letters) whose document
frequencies among toxic and clean training rows differ by their log-odds, near copies counted once; the short closed-class lists are fixed. The scope transducer
reads classes along a clause and writes each insult's or threat's reading: plain, negated, reported or aimed at a target. The scorer
adds the weights up by reading, clause by clause. A logistic layer over these sums, fitted on training rows, gives the
score: how much a negated or reported insult counts is learned, not set. A threat that has a target counts like a strong insult of the same
reading, aimed threats like plain ones; features of its own let training rows say otherwise.

Workers find lexicon hits by hashing the stems of all words of a batch at once; only clauses with a hit or a threat word walk the transducers.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chars
from quire.llm.common import hashed_share, held_out, materialise, slices, table, worker_tables

#: Bound of the labelled rows that the lexicon and the scorer are fitted on; least support, precision and weight of a pattern; letters of a slice.
MAX_LABELLED = 40_000
SUPPORT, PRECISION, LEAST_WEIGHT = 8, 0.3, 1.5
STEMS = (4, 5, 6)
SLICE = 1_000_000
THRESHOLD = 0.5

# Closed-class words in English, German, French and Spanish.
THREATS = "kill hurt destroy beat stab shoot burn hunt murder töten umbringen schlagen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours they them their he she him her people everyone all du dich dir euch ihr sie tu toi vous ils elles usted ustedes tú te ellos ellas".split()
#: Targets that stand before the verb as its object.
OBJECTS = "dich dir euch te toi vous usted ustedes".split()
NEGATIONS = "not no never none nobody neither isn't aren't wasn't don't doesn't nicht kein keine keiner nie niemals pas jamais aucun aucune nunca jamás ningún ninguna".split()
REPORTS = "said says say wrote writes called calls quoted quotes reported claims claimed told sagte sagt schrieb nannte berichtete dit écrit appelé rapporté dijo dice escribió llamó".split()

_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")
_CLAUSE_END = re.compile(r"[.!?;\n]")
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, OBJECT = range(8)
_CLASS = {w: k for k, ws in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (OBJECT, OBJECTS)) for w in ws} | dict.fromkeys('"“”«»', QUOTE)
PLAIN, NEGATED, REPORTED, AIMED = range(4)
#: Words that a negation reaches over, and a target.
NEGATION_SPAN, TARGET_SPAN = 3, 4
N_FEATURES = 13
#: A threat's weight where no lexicon gives one; quantile of the lexicon's weights that is a threat's.
THREAT_WEIGHT, THREAT_QUANTILE = 2.0, 0.9


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    own = worker_tables("toxicity")
    if len(own.get("up", ())) < n:
        for name, r in (("up", 0x9E3779B97F4A7C15), ("down", pow(0x9E3779B97F4A7C15, -1, 2**64))):
            p = np.full(max(n, SLICE + 1), np.uint64(r))
            p[0] = 1
            own[name] = np.multiply.accumulate(p)
    return own["up"][:n], own["down"][:n]


def word_keys(c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of all words in letters c, and for each pattern kind (stems by length, whole words of any length) the words' keys, hashes
    of 61 bits; -1 where a word is no longer than the stem."""
    edge = c != 0
    begin = np.flatnonzero(edge & ~np.concatenate([[False], edge[:-1]]))
    length = np.flatnonzero(edge & ~np.concatenate([edge[1:], [False]])) - begin + 1
    up, down = _powers(len(c) + 1)
    run = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(c.astype(np.uint64) * up[:-1], out=run[1:])

    def key(size: np.ndarray | int, tag: int) -> np.ndarray:
        h = (run[np.minimum(begin + size, len(c))] - run[begin]) * down[begin] + np.uint64(tag)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((h ^ (h >> np.uint64(32))) >> np.uint64(3)).astype(np.int64)

    return begin, [*(np.where(length > n, key(n, n), -1) for n in STEMS), key(length, 0)]


#: Marks the key of "the pattern occurs twice or more in the document".
TWICE = np.int64(1) << 61


def _grouped(k: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, document) pairs and their counts."""
    order = np.lexsort((doc, k))
    k, doc = k[order], doc[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])])) if len(k) else np.zeros(0, np.int64)
    return k[first], doc[first], np.diff(np.append(first, len(k)))


def _lexicon_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, toxic documents, documents) of a task's rows, for patterns and for patterns that repeat in a document."""
    got: list[np.ndarray] = []
    for batch in batches:
        texts, toxic = [t or "" for t in batch.column("text").to_pylist()], np.array(batch.column("toxic").to_pylist(), np.int64)
        for a, b in slices(list(map(len, texts)), SLICE):
            c, starts = chars.codes(texts[a:b])
            begin, keys = word_keys(c)
            doc = np.searchsorted(starts, begin, "right") - 1
            for k in keys:
                key, d, n = _grouped(k[k >= 0], doc[k >= 0])
                for some, mark in ((n >= 1, np.int64(0)), (n >= 2, TWICE)):
                    u, inv = np.unique(key[some] | mark, return_inverse=True)
                    got.append(np.stack([u, np.bincount(inv, toxic[a:b][d[some]], len(u)).astype(np.int64), np.bincount(inv, minlength=len(u))]))
    if got:
        m = np.concatenate(got, axis=1)
        u, inv = np.unique(m[0], return_inverse=True)
        t, n = np.bincount(inv, m[1], len(u)).astype(np.int64), np.bincount(inv, m[2], len(u)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(t), pa.array(n)], ["key", "t", "n"])


@dataclass
class Grammar:
    keys: np.ndarray
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: float

    @functools.cached_property
    def threat(self) -> float:
        """Weight of a threat with a target."""
        return float(np.quantile(self.weights, THREAT_QUANTILE)) if len(self.weights) else THREAT_WEIGHT

    def filter(self) -> np.ndarray:
        bits = np.zeros(1 << 20, bool)
        bits[_slot(self.keys & ~TWICE)] = True
        return bits

    def weight(self, keys: np.ndarray) -> np.ndarray:
        """0 for keys that are no pattern."""
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], 0.0)

    def hits(self, texts: list[str], bits: np.ndarray) -> list[dict[int, float]]:
        """For each text: position of a matched word -> the largest weight of its patterns."""
        out: list[dict[int, float]] = [{} for _ in texts]
        if not len(self.keys):
            return out
        for a, b in slices(list(map(len, texts)), SLICE):
            c, starts = chars.codes(texts[a:b])
            begin, keys = word_keys(c)
            for k in keys:
                some = np.flatnonzero(bits[_slot(k)])
                some = some[k[some] >= 0]
                key, where = k[some], begin[some]
                doc = np.searchsorted(starts, where, "right") - 1
                _, of = np.unique(np.stack([key, doc]), axis=1, return_inverse=True) if len(key) else (None, np.zeros(0, np.int64))
                twice = np.bincount(of.reshape(-1))[of.reshape(-1)] >= 2 if len(key) else np.zeros(0, bool)
                weight = np.maximum(self.weight(key), np.where(twice, self.weight(key | TWICE), 0.0))
                for d, p, x in zip(doc.tolist(), (where - starts[doc] - 1).tolist(), weight.tolist(), strict=True):
                    if x:
                        own = out[a + d]
                        own[p] = max(own.get(p, 0.0), x)
        return out


def _slot(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(44)).astype(np.int64)


def threats(text: str) -> list[int]:
    """Positions of the threat words."""
    low = text.lower()
    some = [w for w in THREATS if w in low]
    return [m.start() for m in re.finditer(rf"(?i)(?<![^\W_])(?:{'|'.join(some)})(?![^\W_])", text)] if some else []


def lexicon(clause: str, offset: int, hits: dict[int, float], threat: float = THREAT_WEIGHT) -> Iterator[tuple[int, float]]:
    """First transducer: words to (class, weight). A hit may stand inside a word, after an elided article."""
    for m in _TOKEN.finditer(clause):
        weight = max((hits[p] for p in range(offset + m.start(), offset + m.end()) if p in hits), default=0.0)
        word = m[0].lower()
        if weight:
            yield INSULT, weight
        else:
            kind = _CLASS.get(word) or _CLASS.get(word.rpartition("'")[2], OTHER)
            yield kind, threat if kind == THREAT else 1.0


def scope(tags: Iterator[tuple[int, float]]) -> Iterator[tuple[int, int, float]]:
    """Second transducer: (class, weight) to (class, reading, weight); the state is (words since a negation, reported, in quotation, words since a target,
    words since an object). A threat also looks at the words after it for its target; without one its weight is 0."""
    negation, reported, quoted, target, object_ = NEGATION_SPAN + 1, False, False, TARGET_SPAN + 1, TARGET_SPAN + 1
    tags = list(tags)
    for i, (kind, weight) in enumerate(tags):
        negation, target, object_ = negation + 1, target + 1, object_ + 1
        if kind == NEGATION:
            negation = 0
        elif kind == REPORT:
            reported = True
        elif kind == QUOTE:
            quoted = not quoted
        elif kind == TARGET:
            target = 0
        elif kind == OBJECT:
            target = object_ = 0
        elif kind in (INSULT, THREAT):
            aimed = target <= TARGET_SPAN
            if kind == THREAT:
                aimed = object_ <= TARGET_SPAN or any(k in (TARGET, OBJECT) for k, _ in tags[i + 1 : i + 1 + TARGET_SPAN])
                weight = weight if aimed else 0.0
            reading = REPORTED if reported or quoted else NEGATED if negation <= NEGATION_SPAN else AIMED if aimed else PLAIN
            yield kind, reading, weight


def clauses(text: str, hits: dict[int, float]) -> Iterator[tuple[str, int]]:
    """The clauses that hold a hit or a threat word, with their offsets."""
    done = -1
    for p in sorted({*hits, *threats(text)}):
        if p < done:
            continue
        start = max(text.rfind(ch, 0, p) for ch in ".!?;\n") + 1
        m = _CLAUSE_END.search(text, p)
        done = m.end() if m else len(text)
        yield text[start:done], start


def readings(text: str, hits: dict[int, float], threat: float = THREAT_WEIGHT) -> np.ndarray:
    """Third transducer: sums by reading (4), the heaviest clause, threats beside insults, clauses, the sum of distinct weights that are meant (neither negated
    nor reported), whether there is one, threats by reading (4). Threats with a target are in the sums too, aimed ones as plain."""
    x = np.zeros(N_FEATURES)
    weights: set[float] = set()
    for clause, offset in clauses(text, hits):
        total, insults, beside, some = 0.0, 0.0, 0, False
        for kind, reading, weight in scope(lexicon(clause, offset, hits, threat)):
            plain = reading in (PLAIN, AIMED)
            some |= weight > 0
            total += weight if plain else 0.0
            if plain and weight:
                weights.add(weight)
            if kind == INSULT:
                x[reading] += weight
                insults += weight if plain else 0.0
            else:
                x[9 + reading] += 1
                x[PLAIN if reading == AIMED else reading] += weight
                beside += plain
        x[4] = max(x[4], total)
        x[5] += beside if insults else 0
        x[6] += some
    x[7] = sum(weights)
    x[:4], x[5:8], x[9:] = np.log1p(x[:4]), np.log1p(x[5:8]), np.log1p(x[9:])
    x[8] = 1.0 if weights else 0.0
    return x


def fit_scorer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Ridge logistic regression by Newton steps; constant columns get weight 0."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (p - y) / len(y) + ridge * np.append(w[:-1], 0)
        h = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(np.append(np.full(len(w) - 1, ridge), 1e-9))
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-7:
            break
    return mean, scale, w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Grammar:
    """docs(doc_id, text), labels(doc_id, toxic): both already without held-out rows. Without both classes every score is the base rate."""
    marks = labels.where("toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = marks.where(hashed_share(F.col("doc_id"), max_labelled, marks.count()))
    rows = docs.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("long").alias("toxic"))  # max_labelled ids
    # near copies teach a lexicon nothing new: it counts one row, by a hash of its text, of those that share both the least and the largest hashed word triple
    words = F.split(F.lower("text"), r"\s+")
    triples = F.transform(F.sequence(F.lit(1), F.greatest(F.size("ws") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("ws", i, 3)))
    rows = rows.withColumn("ws", words).withColumn("triples", triples).withColumn("family", F.struct(F.array_min("triples"), F.array_max("triples"), "toxic")).drop("ws", "triples")
    rows = rows.withColumn("first", F.expr("row_number() OVER (PARTITION BY family ORDER BY xxhash64(text), text)") == 1).drop("family")
    rows = materialise(rows, "toxic-rows")
    total = rows.agg(F.count("*").alias("all"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"), F.count_if("first").alias("n"), F.coalesce(F.sum(F.when(F.col("first"), F.col("toxic"))), F.lit(0)).alias("t")).first()
    t, clean = total["t"], total["n"] - total["t"]
    both = rows.where("first").select("text", "toxic").mapInArrow(_lexicon_counts, "key long, t long, n long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("n").alias("n")).where(F.col("t") >= SUPPORT)
    odds = F.log((F.col("t") + 0.5) / F.lit(t + 1.0)) - F.log((F.col("n") - F.col("t") + 0.5) / F.lit(clean + 1.0))
    kept = both.where(F.col("t") >= PRECISION * F.col("n")).select("key", odds.alias("w")).where(F.col("w") >= LEAST_WEIGHT).toPandas().sort_values("key")  # words of max_labelled rows, each in SUPPORT of them
    g = Grammar(kept["key"].to_numpy(np.int64), kept["w"].to_numpy(float), np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), float(np.log((total["toxic"] + 0.5) / (total["all"] - total["toxic"] + 0.5))))
    if not t or not clean:
        return g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = g.filter()
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            x = [readings(s, h, g.threat) for s, h in zip(texts, g.hits(texts, bits), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([r.tobytes() for r in x], pa.binary())], ["y", "x"])

    got = rows.select("text", "toxic").mapInArrow(run, "y long, x binary").collect()  # max_labelled rows of N_FEATURES numbers
    g.mean, g.scale, g.w, g.b = fit_scorer(np.array([np.frombuffer(r["x"]) for r in got]), np.array([r["y"] for r in got], float))
    return g


def score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """All columns of docs plus toxic_score and toxic_clauses (text and start of each matched clause); null texts count as empty.
    Clashing toxic_* columns are replaced."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StructField, StructType, _parse_datatype_string

    docs = docs.drop("toxic_score", "toxic_clauses")
    kind = _parse_datatype_string("array<struct<start:int,text:string>>")
    schema = StructType([*docs.schema.fields, StructField("toxic_score", DoubleType()), StructField("toxic_clauses", kind)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = grammar.filter()
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                some = batch.slice(k, 2000)
                texts = [x or "" for x in some.column("text").to_pylist()]
                found = grammar.hits(texts, bits)
                x = np.array([readings(s, h, grammar.threat) for s, h in zip(texts, found, strict=True)]).reshape(-1, N_FEATURES)
                z = ((x - grammar.mean) / grammar.scale) @ grammar.w + grammar.b
                spans = [[{"start": at, "text": c} for c, at in clauses(s, h)] for s, h in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(c.cast(f.type) for c, f in zip(some.columns, arrow, strict=False)), pa.array(1 / (1 + np.exp(-np.clip(z, -40, 40)))), pa.array(spans, arrow.field("toxic_clauses").type)], schema=arrow
                )

    return docs.mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = held_out(F.col("doc_id"), 5, 0)
    grammar = train(docs.where(~fold), labels.where(~fold))
    out = score(docs.select("doc_id", "text"), grammar)
    return out.select("doc_id", fold.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_clauses").alias("n_clauses"))
