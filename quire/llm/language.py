"""Language identification by interpolated Kneser-Ney character models.

An n-gram is hashed to one number that holds its code points, so that letters of every script stay apart. Trigrams are counted over every
training row, inside the tasks and then by groupBy; continuation counts of bigrams and letters are aggregates of these. A language's model
is sorted arrays of n-gram hashes with their parts of the interpolated estimate
    P(w | u v) = max(n(u v w) - D, 0) / n(u v .) + D * N(u v .) / n(u v .) * P(w | v)
and the same for P(w | v) over continuation counts. No n-gram is left out: where the languages have more than MAX_GRAMS trigrams together, the
models are cut into shards by a trigram's middle letter, and texts are scored in one pass a shard. A shard holds all that its trigrams need: the
trigrams, the bigrams that start or end with its letters, and every letter.

A text's language is the one with the lowest cross-entropy per letter. The score is the posterior of that language with
a temperature fitted on all training rows. A text is rejected if its best cross-entropy is above what training rows of the
language show: the REJECT quantile of all of them plus a margin of MARGIN nats.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, BooleanType, DoubleType, StringType, StructField, StructType

from quire.llm import chars
from quire.llm.common import discard, held_out, materialise, order_bits, quantiles, slices, table, worker_tables

#: About how many trigrams a shard of the models holds; a slice's letters; languages that are scored at a time; counts a task holds.
MAX_GRAMS = 1_000_000
SLICE = 250_000
TOGETHER = 16
HELD = 2_000_000
REJECT, MARGIN = 0.999, 1.0
DISCOUNT = 0.75
FLOOR = -16.0
TEMPERATURES = (0.5, 1, 2, 4, 8, 16, 32, 64)
#: Losses are summed as whole numbers of this part of a nat: the sum doesn't depend on the order of rows.
LOSS_UNIT = 1e-12
_B = chars.BITS
_MASK = (1 << _B) - 1


def grams(c: np.ndarray) -> np.ndarray:
    """Hashes of the trigrams of letters c."""
    c = c.astype(np.int64)
    return c[:-2] << 2 * _B | c[1:-1] << _B | c[2:]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([p[1] for p in parts]), len(keys)).astype(np.int64)

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            k, n = parts[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        texts, langs = [t or "" for t in batch.column("text").to_pylist()], np.array(batch.column("lang").to_pylist(), object)
        for lang in sorted(set(langs.tolist())):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for a, b in slices(list(map(len, own)), SLICE):
                c, _ = chars.squeezed(*chars.codes(own[a:b]))
                c = np.concatenate([[0], c, [0]]).astype(np.uint32)
                # a trigram never spans two texts: the squeezed 0 between them stands for both ends
                k, n = np.unique(grams(c)[(c[1:-1] != 0) | (c[2:] != 0)], return_counts=True)
                held[lang] = [merged([*held.get(lang, []), (k, n)])]
            size = sum(len(p[0][0]) for p in held.values())
            if size > HELD:
                yield from flush()
    yield from flush()


def estimates(counts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of counts(lang, gram, n) of all trigrams: trigrams (n, total, kinds of their context), contexts and bigrams (total, kinds; cont, row, kinds1),
    letters (cont, kinds of all), each with its language."""
    second, last = F.shiftright("gram", _B), F.col("gram").bitwiseAND(F.lit((1 << 2 * _B) - 1))
    context = counts.groupBy("lang", second.alias("ctx")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    bigram = counts.groupBy("lang", last.alias("gram")).agg(F.count("*").alias("cont"))
    row = bigram.groupBy("lang", F.shiftright("gram", _B).alias("v")).agg(F.sum("cont").alias("row"), F.count("*").alias("kinds1"))
    letter = bigram.groupBy("lang", F.col("gram").bitwiseAND(F.lit(_MASK)).alias("w")).agg(F.count("*").alias("cont1"))
    three = counts.withColumn("ctx", second).join(context, ["lang", "ctx"]).select("lang", "gram", "n", "total", "kinds")
    two = bigram.join(context.withColumnRenamed("ctx", "gram"), ["lang", "gram"], "full").withColumn("v", F.shiftright("gram", _B)).join(row, ["lang", "v"], "left")
    one = letter.withColumnRenamed("w", "v").join(row, ["lang", "v"], "full").select("lang", F.col("v").alias("gram"), "cont1", "row", "kinds1")
    return three, two.select("lang", "gram", "cont", "row", "kinds1", "total", "kinds"), one


def _arrays(rows: DataFrame) -> dict[str, dict[str, np.ndarray]]:
    """The rows of each language, sorted by gram."""
    names = [c for c in rows.columns if c != "lang"]
    got = rows.select("lang", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in names)).toArrow()  # a shard, or each language's letters
    lang = got.column("lang").to_numpy(zero_copy_only=False) if got.num_rows else np.zeros(0, object)
    gram = got.column("gram").to_numpy()
    out = {}
    for x in sorted(set(lang.tolist())):
        own = np.flatnonzero(lang == x)
        own = own[np.argsort(gram[own])]
        out[x] = {c: got.column(c).to_numpy()[own] for c in names}
    return out


@dataclass
class Table:
    """Some languages' log-probabilities over the union of their n-grams: trigrams; bigrams with backoff weights of contexts; letters with theirs."""

    grams: list[np.ndarray]
    logs: list[np.ndarray]
    weights: list[np.ndarray]

    def scores(self, g: np.ndarray) -> np.ndarray:
        """log P(w | u v) of trigrams under each language. What a language doesn't hold as a trigram is NaN in logs[0] and backs off."""
        at, hit = _find(self.grams[0], g)
        out = np.full((len(g), self.logs[0].shape[1]), np.nan, np.float32)
        out[hit] = self.logs[0][at[hit]]
        i, j = np.nonzero(np.isnan(out))
        if len(i):
            some, of = np.unique(g[i], return_inverse=True)
            out[i, j] = self._backed(some)[of.reshape(-1), j]
        return out

    def _backed(self, g: np.ndarray) -> np.ndarray:
        two, one = g & ((1 << 2 * _B) - 1), g & _MASK
        at2, hit2 = _find(self.grams[1], two)
        at1, hit1 = _find(self.grams[2], one)
        p1 = np.where(hit1[:, None], self.logs[2][at1], FLOOR)
        atv, hitv = _find(self.grams[2], two >> _B)
        p2 = np.where(hit2[:, None], self.logs[1][at2], np.nan)
        p2 = np.where(np.isnan(p2), p1 + np.where(hitv[:, None], self.weights[2][atv], 0), p2)
        atc, hitc = _find(self.grams[1], g >> _B)
        return np.maximum(p2 + np.where(hitc[:, None], self.weights[1][atc], 0), FLOOR)


def _find(keys: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of x in sorted keys, and whether it stands there."""
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return at, (keys[at] == x if len(keys) else np.zeros(len(x), bool))


@dataclass
class Model:
    """By language: (sorted n-gram hashes, log-probabilities, log backoff weights) of trigrams, bigrams, letters.

    orders is empty where there are several shards: these are made of counts when they are asked for, one at a time."""

    langs: list[str]
    orders: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]
    temperature: float = 1.0
    ceiling: list[float] = field(default_factory=list)
    shards: int = 1
    counts: DataFrame | None = None

    def part(self, k: int) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """What shard k holds of each language."""
        if self.shards == 1:
            return self.orders
        three, two, one = estimates(self.counts)
        first, last = (F.expr(f"{letter} % {self.shards} = {k}") for letter in (f"shiftright(gram, {_B})", f"(gram & {_MASK})"))
        middle = F.expr(f"(shiftright(gram, {_B}) & {_MASK}) % {self.shards} = {k}")
        return kneser_ney(_arrays(three.where(middle)), _arrays(two.where(first | last)), _arrays(one)).orders

    def tables(self, k: int = 0) -> list[Table]:
        return _tables(self.part(k))


def _tables(orders: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> list[Table]:
    return [_table(orders[a : a + TOGETHER]) for a in range(0, len(orders), TOGETHER)]


def _table(own: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> Table:
    out = Table([], [], [])
    for order in range(3):
        keys = np.unique(np.concatenate([o[order][0] for o in own]))
        if not len(keys):
            keys = np.full(1, -1, np.int64)
        logs = np.full((len(keys), len(own)), np.nan if order < 2 else FLOOR, np.float32)
        weights = np.zeros((len(keys), len(own)), np.float32)
        for j, o in enumerate(own):
            at = np.searchsorted(keys, o[order][0])
            logs[at, j], weights[at, j] = o[order][1], o[order][2]
        out.grams.append(keys)
        out.logs.append(logs)
        out.weights.append(weights)
    return out


def kneser_ney(three: dict, two: dict, one: dict, discount: float = DISCOUNT) -> Model:
    """Models of what `_arrays` gives of `estimates`. A language without a trigram or bigram in this shard has its letters only."""
    langs = sorted(one, key=lambda s: s.encode("utf-8"))
    model = Model(langs, [])
    none = np.zeros(0, np.int64)
    for lang in langs:
        t = three.get(lang) or dict.fromkeys(("gram", "n", "total", "kinds"), none)
        b = two.get(lang) or dict.fromkeys(("gram", "cont", "row", "kinds1", "total", "kinds"), none)
        u = one[lang]
        with np.errstate(divide="ignore", invalid="ignore"):
            cont1 = u["cont1"].astype(float)
            seen = max((cont1 > 0).sum(), 1)
            p1 = (np.maximum(cont1 - discount, 0) + discount * seen / (seen + 1)) / max(cont1.sum(), 1)  # one part of the mass is for letters not seen
            w1 = np.where(u["row"] > 0, discount * u["kinds1"] / np.maximum(u["row"], 1), 1.0)
            at, hit = _find(u["gram"], b["gram"] & _MASK)
            low = np.where(hit, p1[at], np.exp(FLOOR))
            p2 = np.where(b["cont"] > 0, np.maximum(b["cont"] - discount, 0) / np.maximum(b["row"], 1), 0.0)
            p2 = p2 + np.where(b["row"] > 0, discount * b["kinds1"] / np.maximum(b["row"], 1), 1.0) * low
            w2 = np.where(b["total"] > 0, discount * b["kinds"] / np.maximum(b["total"], 1), 1.0)
            at, hit = _find(b["gram"], t["gram"] & ((1 << 2 * _B) - 1))
            atl, hitl = _find(u["gram"], t["gram"] & _MASK)
            low = np.where(hit, p2[at] if len(p2) else 0, np.where(hitl, p1[atl], np.exp(FLOOR)))
            p3 = np.maximum(t["n"] - discount, 0) / t["total"] + discount * t["kinds"] / t["total"] * low
        logs = [np.log(np.maximum(p, np.exp(FLOOR))).astype(np.float32) for p in (p3, p2, p1)]
        logs[1] = np.where(b["cont"] > 0, logs[1], np.nan).astype(np.float32)  # held as a context only
        model.orders.append([(t["gram"], logs[0], np.zeros(len(logs[0]), np.float32)), (b["gram"], logs[1], np.log(w2).astype(np.float32)), (u["gram"], logs[2], np.log(w1).astype(np.float32))])
    return model


def entropies(texts: list[str], tables: list[Table], shard: int = 0, shards: int = 1) -> np.ndarray:
    """Mean negative log-probability of each text's letters and word ends under each language; of several shards, one's part of that sum."""
    n_langs = sum(t.logs[0].shape[1] for t in tables)
    out = np.zeros((len(texts), n_langs))
    for a, b in slices(list(map(len, texts)), SLICE):
        c, s = chars.squeezed(*chars.codes(texts[a:b]))
        full = np.concatenate([[0], c, [0]]).astype(np.uint32)
        used = (c != 0) | (full[2:] != 0)
        g = grams(full)  # position i scores full[i + 2], that is c[i + 1]; text k owns s[k] .. s[k + 1]
        mine = used & ((g >> _B & _MASK) % shards == shard) if shards > 1 else used
        total = np.zeros((b - a, n_langs))
        for lo in range(0, len(g), SLICE):  # one very long text is scored in parts
            part = slice(lo, lo + SLICE)
            at = 0
            inside = np.flatnonzero((s >= lo) & (s < lo + SLICE))
            cuts = np.concatenate([[] if len(inside) and s[inside[0]] == lo else [0], s[inside] - lo]).astype(np.int64)
            of = np.concatenate([[] if len(inside) and s[inside[0]] == lo else [np.searchsorted(s, lo, "right") - 1], inside]).astype(np.int64)
            for t in tables:
                w = t.logs[0].shape[1]
                scored = np.zeros((len(g[part]), w), np.float32)
                scored[mine[part]] = t.scores(g[part][mine[part]])
                total[of, at : at + w] += np.add.reduceat(scored, cuts, axis=0, dtype=np.float64)
                at += w
        n = np.maximum(np.add.reduceat(used.astype(np.int64), s), 1)
        out[a:b] = -total / n[:, None]
    return out


def _tables_here(name: str, orders: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]) -> list[Table]:
    own = worker_tables("language")
    if name not in own:
        own.clear()
        own[name] = _tables(orders)
    return own[name]


def _scored(docs: DataFrame, model: Model, finish: Callable[[pa.RecordBatch, list[str], np.ndarray], pa.RecordBatch], schema: StructType) -> DataFrame:
    """finish(batch, texts, entropies under each language) of all rows of docs, which needs text. Each shard is a pass of its own; between
    passes the rows are written with what they have so far, so that a worker holds one shard."""
    kept, so_far = docs.columns, f"entropies_{uuid.uuid4().hex}"
    carried, before = StructType([*docs.schema.fields, StructField(so_far, BinaryType())]), None
    for k in range(model.shards):
        shared, name, last = docs.sparkSession.sparkContext.broadcast(model.part(k)), uuid.uuid4().hex, k + 1 == model.shards

        def run(batches: Iterator[pa.RecordBatch], k: int = k, shards: int = model.shards, shared=shared, name: str = name, last: bool = last) -> Iterator[pa.RecordBatch]:
            tables = _tables_here(name, shared.value)
            for whole in batches:
                for at in range(0, whole.num_rows, 2000):
                    batch = whole.slice(at, 2000)
                    texts = [t or "" for t in batch.column("text").to_pylist()]
                    h = entropies(texts, tables, k, shards)
                    if k:
                        h += np.frombuffer(b"".join(batch.column(so_far).to_pylist())).reshape(h.shape)
                        batch = batch.select(kept)
                    if last:
                        yield finish(batch, texts, h)
                    else:
                        yield pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, to_arrow_schema(carried), strict=False)), pa.array([r.tobytes() for r in h], pa.binary())], schema=to_arrow_schema(carried))

        docs = docs.mapInArrow(run, schema if last else carried)
        if not last:
            docs = materialise(docs, "entropies")
            shared.unpersist()
            if before is not None:
                discard(before)
            before = docs
    return docs


def train(docs: DataFrame) -> Model:
    """Model of rows of docs(doc_id, text, lang): every row's trigrams count, and temperature and ceilings are fitted on every row;
    rows with null lang or text teach nothing."""
    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "grams")
    n_grams = counts.count()
    if not n_grams:
        return Model([], [])
    shards = -(-n_grams // MAX_GRAMS)
    if shards == 1:
        model = kneser_ney(*map(_arrays, estimates(counts)))
    else:
        langs = sorted((r[0] for r in counts.select("lang").distinct().collect()), key=lambda s: s.encode("utf-8"))
        model = Model(langs, [], shards=shards, counts=counts)
    calibrate(rows, model)
    return model


def calibrate(rows: DataFrame, model: Model) -> None:
    """Set model's temperature, the one of TEMPERATURES with the least loss over all rows(text, lang) with letters, and each language's
    ceiling from all its rows with over 20 letters. A language without one has the ceiling 12; rows of a language without n-grams have no letters."""
    langs, ts = {x: j for j, x in enumerate(model.langs)}, range(len(TEMPERATURES))

    def finish(batch: pa.RecordBatch, texts: list[str], h: np.ndarray) -> pa.RecordBatch:
        truth = np.array([langs.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
        letters = chars.letters(texts)
        ok = (letters > 0) & (truth >= 0)
        h, truth, letters = h[ok], truth[ok], letters[ok]
        lost = [np.rint(_losses(h, truth, t) / LOSS_UNIT).astype(np.int64) for t in TEMPERATURES]
        own = pa.array(order_bits(h[np.arange(len(h)), truth]), mask=letters <= 20)
        return pa.RecordBatch.from_arrays([pa.array(truth), own, *map(pa.array, lost)], ["truth", "own", *(f"loss{i}" for i in ts)])

    fields = ", ".join(["truth long", "own long", *(f"loss{i} long" for i in ts)])
    seen = materialise(_scored(rows, model, finish, StructType.fromDDL(fields)), "calibration")
    loss = seen.agg(*(F.coalesce(F.sum(F.col(f"loss{i}").cast("decimal(20, 0)")), F.lit(0)) for i in ts)).first()
    model.temperature = float(TEMPERATURES[min(ts, key=lambda i: loss[i])])
    found = quantiles(seen.where("own IS NOT NULL"), "truth", "own", [REJECT])
    model.ceiling = [found[j][0] + MARGIN if j in found else 12.0 for j in range(len(model.langs))]
    discard(seen)


def _posterior(h: np.ndarray, temperature: float) -> np.ndarray:
    z = -temperature * (h - h.min(1, keepdims=True))
    e = np.exp(z)
    return e / e.sum(1, keepdims=True)


def _losses(h: np.ndarray, truth: np.ndarray, t: float) -> np.ndarray:
    return -np.log(np.maximum(_posterior(h, t)[np.arange(len(h)), truth], 1e-12))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of docs plus lang_pred, lang_score, lang_entropy, lang_rejected; docs needs text.

    Null texts and texts without a letter are `und` with score 0 and rejected; so is everything under a model without
    languages. Ties go to the language first by code point. A clashing lang_* column of docs is replaced."""
    docs = docs.drop("lang_pred", "lang_score", "lang_entropy", "lang_rejected")
    schema = StructType(docs.schema.fields + [StructField("lang_pred", StringType()), StructField("lang_score", DoubleType()), StructField("lang_entropy", DoubleType()), StructField("lang_rejected", BooleanType())])
    arrow = to_arrow_schema(schema)
    langs, temperature, ceiling = model.langs, model.temperature, model.ceiling

    def finish(batch: pa.RecordBatch, texts: list[str], h: np.ndarray) -> pa.RecordBatch:
        n = len(texts)
        lang, score, best, bad = np.full(n, "und", object), np.zeros(n), np.zeros(n), np.ones(n, bool)
        if langs:
            ok = chars.letters(texts) > 0
            k = h.argmin(1)
            lang[ok] = np.array(langs, object)[k[ok]]
            score[ok] = _posterior(h, temperature).max(1)[ok]
            best = h.min(1)
            bad = ~ok | (best > np.array(ceiling)[k])
        return pa.RecordBatch.from_arrays([*(c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)), pa.array(lang, pa.string()), pa.array(score), pa.array(best), pa.array(bad)], schema=arrow)

    return _scored(docs, model, finish, schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_entropy").alias("entropy"), F.col("lang_rejected").alias("rejected"))
