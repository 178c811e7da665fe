"""N-gram Jaccard join in metric space, exact, with one row per document.

Jaccard distance is a metric, so pivots and the triangle inequality can split a set of documents. But documents that share nothing
with any pivot all stand at distance 1 from it, and no pivot tells them apart. The first split is therefore by signatures:
the shingles' hash range is cut into k ranges, k above the largest symmetric difference that a link allows, so that linked
documents agree on one whole range at least (pigeonhole; k by size class, see Plan). Documents that agree on a range form a region.

Within a region the smallest member is the pivot. Documents within the threshold of their pivot are linked with it and need no
comparison with each other: they are in one class already. What is left are documents of one region in different classes.
Their regions join recursively (metric_join): pivots create Voronoi cells, documents within twice the threshold of a
cell's border are copied into it, cells join by themselves. The distance is the weighted Jaccard distance of
count vectors (shingles counted by the low bits of their hashes), a metric too, and never above the true distance, so nothing is lost.
Every pair that remains is compared on its whole sets.

Equal sets are one node from the start, whatever their number. Signatures travel as sorted blocks of numbers, not as rows.
Classes come from links by large-star/small-star rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import discard, materialise, release, slices, table, worker_tables

K = 5
#: A link needs 100 * |A and B| >= PERCENT * |A or B|.
PERCENT = 80
EPS = 1 - PERCENT / 100
MIN_DIMS, MAX_DIMS = 128, 4096
#: Signatures in one exchange block's partition, and those of them that are sorted at a time; members up to which a region's pairs are listed; bytes of text a slice.
PER_PART, RUN = 1_500_000, 150_000
SMALL = 4
SLICE = 250_000
#: Ids of documents to compare are broadcast up to this number; beyond, the texts are joined by a shuffle.
MAX_BROADCAST = 1_000_000
#: Members of a region that are compared in one task, at most twice as many.
BLOCK = 20_000
#: Documents from which on a signature is a region of rows, not part of a block; so many of one block count towards it.
HOT, COMMON = 20_000, 20
#: Members that are compared with their hub in one run; links that a task contracts at a time.
MEMBERS, FOREST = 5_000, 1_000_000
#: Regions a document is known by when two of them are asked for an earlier region in common.
EARLIER = 16

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z read as a-z
_R = _U(0x9E3779B97F4A7C15)
_R_INV = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MUL = [_U(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _MUL[0]
    x = (x ^ (x >> _U(27))) * _MUL[1]
    return x ^ (x >> _U(31))


def _times(k: int, i: int) -> np.uint64:
    return _U(k * int(_MUL[i]) & (1 << 64) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    own = worker_tables("jaccard")
    if len(own.get("up", ())) < n:
        for name, r in (("up", _R), ("down", _R_INV)):
            p = np.full(max(n, SLICE + 1), r, np.uint64)
            p[0] = 1
            own[name] = np.multiply.accumulate(p)
    return own["up"][:n], own["down"][:n]


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word 5-grams; of its whole word sequence if it has fewer words; none without words."""
    out: list[np.ndarray] = []
    for a, b in slices(list(map(len, texts)), SLICE):
        data = np.frombuffer(b" ".join(texts[a:b]) + b" ", np.uint8)
        ends_of = np.cumsum([len(t) + 1 for t in texts[a:b]])
        space = _SPACE[data]
        ends = np.flatnonzero(space & ~np.concatenate([[True], space[:-1]]))
        starts = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        up, down = _powers(len(data) + 1)
        total = np.empty(len(data) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
        words = _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        if len(words) >= K:
            grams = sum((words[i : len(words) - K + 1 + i] * _MUL[i] for i in range(K)), np.zeros(1, np.uint64))
            grams = _mix(grams)
        first = np.searchsorted(starts, np.concatenate([[0], ends_of[:-1]]))
        last = np.append(first[1:], len(starts))
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            if j - i >= K:
                out.append(np.unique(grams[i : j - K + 1]))
            elif j > i:
                h = np.array([j - i], np.uint64)
                for k in range(i, j):
                    h = _mix(h * _MUL[4] + words[k : k + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def set_id(u: np.ndarray) -> int:
    """63-bit id of a whole set: equal sets, equal ids."""
    both = np.array([_mix(u).sum(dtype=np.uint64), _mix(u + _MUL[2]).sum(dtype=np.uint64)]) * np.array([_U(1), _MUL[3]])
    return int(_mix(both[:1] ^ both[1:] ^ _U(len(u)))[0] >> _U(1))


def counts_of(u: np.ndarray) -> bytes:
    """Shingles counted by the low bits of their hashes, in 2 to 4 times fewer cells than shingles, one or two bytes each."""
    dims = MIN_DIMS
    while dims < MAX_DIMS and dims * 4 < len(u):
        dims *= 2
    n = np.bincount((u & _U(dims - 1)).astype(np.int64), minlength=dims)
    return bytes([int(n.max()) > 255]) + np.minimum(n, 65535).astype("<u2" if n.max() > 255 else "u1").tobytes()


def vectors(packed: list[bytes]) -> np.ndarray:
    """Count vectors of equal length: longer ones are folded, which keeps the distance a lower bound."""
    raw = [np.frombuffer(p, "<u2" if p[0] else "u1", offset=1).astype(np.int32) for p in packed]
    dims = min((len(v) for v in raw), default=MIN_DIMS)
    return np.stack([v.reshape(-1, dims).sum(0) for v in raw]) if raw else np.zeros((0, dims), np.int32)


class Plan:
    """Size classes and numbers of hash ranges.

    Class c holds sizes in [edges[c], edges[c + 1]). A linked pair of sizes a <= b has b <= 1.25 a and differs in (a + b) / 9
    shingles at most. The pair meets in the class of its smaller document, so a document signs for its own class, and for the class below
    where it can be the larger of a pair. ranges(c) exceeds every such difference, with a reserve for ranges that are empty in both."""

    def __init__(self, largest: int = 1 << 40):
        self.edges = [1]
        while self.edges[-1] < largest:
            self.edges.append(max(self.edges[-1] + 1, int(self.edges[-1] * 1.5)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def difference(self, c: int) -> int:
        a = self.edges[c + 1] - 1
        return (a + a * 5 // 4) // 9

    def ranges(self, c: int) -> int:
        d = self.difference(c)
        return d + 1 + (2 + d // 20 if d else 0)

    def classes(self, n: int) -> list[tuple[int, int]]:
        """(class, largest difference there) in which a document of n shingles signs."""
        c = self.of(n)
        out = [(c, (n + n * 5 // 4) // 9)]
        if c and n <= (self.edges[c] - 1) * 5 // 4:
            out.append((c - 1, 2 * n // 9))
        return out


_PLAN = Plan()


def signatures(u: np.ndarray) -> np.ndarray:
    """Signatures of a set; two linked sets have one in common at least."""
    out, n = [], len(u)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(u + _MUL[2]), dtype=np.uint64)])
    for c, difference in _PLAN.classes(n):
        k = _PLAN.ranges(c)
        at = ((u >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)  # hashes are sorted, so ranges are runs
        ends = np.cumsum(np.bincount(at, minlength=k))
        begins = np.concatenate([[0], ends[:-1]])
        used = np.flatnonzero(ends > begins)
        tag = _times(c + 1, 3) + used.astype(np.uint64) * _MUL[4]
        out.append(_mix((sums[ends[used]] - sums[begins[used]]) ^ tag))
        if k - len(used) >= k - difference:  # the range agreed on may be an empty one
            out.append(_mix(np.array([_times(c + 1, 0)])))
    return np.concatenate(out)


def _sign(parts: int):
    """Task: one row a document (doc_id, n, node) and blocks of signatures (part, keys, which, nodes, sizes)."""
    names = ["doc_id", "n", "node", "vec", "part", "keys", "which", "nodes", "sizes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]

    def block(held: list[tuple[int, int, np.ndarray]]) -> pa.RecordBatch:
        nodes, sizes = np.array([h[0] for h in held], np.int64), np.array([h[1] for h in held], np.int64)
        keys = np.concatenate([h[2] for h in held])
        which = np.repeat(np.arange(len(held), dtype=np.uint32), [len(h[2]) for h in held])
        held.clear()
        part = keys >> _U(32)
        part *= _U(parts)
        part = (part >> _U(32)).astype(np.int32)
        keys = keys.astype("<u4")  # the low bits
        order = np.argsort(part, kind="stable")
        keys, which, part = keys[order], which[order], part[order]
        cuts = np.flatnonzero(np.diff(part)) + 1
        rows = []
        for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True):
            own, small = np.unique(which[a:b], return_inverse=True)
            rows.append((int(part[a]), keys[a:b].tobytes(), small.astype("<u4").tobytes(), nodes[own].tobytes(), sizes[own].tobytes()))
        n = len(rows)
        cols = [pa.nulls(n, k) for k in kinds[:4]] + [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds[4:])]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray]] = []
        seen: set[int] = set()
        size = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                some = batch.slice(k, 1000)
                sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()])
                ids = [set_id(u) if len(u) else None for u in sets]
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [some.column("doc_id"), pa.array([len(u) for u in sets], kinds[1]), pa.array(ids, kinds[2]), pa.array([counts_of(u) if len(u) else None for u in sets], kinds[3])] + [pa.nulls(n, t) for t in kinds[4:]], names
                )
                for node, u in zip(ids, sets, strict=True):
                    if node is not None and node not in seen:
                        seen.add(node)
                        held.append((node, len(u), signatures(u)))
                        size += len(held[-1][2])
                if size > 2_000_000:
                    yield block(held)
                    held, seen, size = [], set(), 0
        if held:
            yield block(held)
        release()  # workers wait beside later stages

    return run


SIGNED = "doc_id long, n long, node long, vec binary, part int, keys binary, which binary, nodes binary, sizes binary"
REGIONS = "region long, a long, b long"


def _regions(pdf: pd.DataFrame) -> pd.DataFrame:
    """Documents of one part that share a signature: all pairs (a < b) of a small region; of a larger one, pairs with the
    pivot and a row per member (region, a). Signatures are sorted in runs of some RUN, by ranges of their keys."""
    blocks = [(np.frombuffer(k, "<u4"), np.frombuffer(w, "<u4"), np.frombuffer(n, np.int64), np.frombuffer(s, np.int64)) for k, w, n, s in zip(pdf["keys"], pdf["which"], pdf["nodes"], pdf["sizes"], strict=True)]
    runs = -(-sum(len(b[0]) for b in blocks) // RUN) or 1
    edges = [(r << 32) // runs for r in range(runs + 1)]
    return pd.concat([_regions_between(blocks, low, high) for low, high in zip(edges, edges[1:], strict=False)]).drop_duplicates()


def _regions_between(blocks: list[tuple[np.ndarray, ...]], low: int, high: int) -> pd.DataFrame:
    """The regions of the signatures whose keys are in [low, high)."""
    keys, nodes, sizes = [], [], []
    for k, w, n, s in blocks:
        at = np.flatnonzero((k >= np.uint32(low)) & (k <= np.uint32(high - 1)))
        which = w[at]
        keys.append(k[at])
        nodes.append(n[which])
        sizes.append(s[which])
    key, node, size = np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes)
    if not len(key):
        return pd.DataFrame({"region": [], "a": [], "b": []}, dtype="int64")
    order = np.lexsort((node, key))
    key, node, size = key[order], node[order], size[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])])
    key, node, size = key[new], node[new], size[new]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    m = np.diff(np.append(begin, len(key)))
    out = []
    for width in range(2, SMALL + 1):
        b = begin[m == width]
        for i in range(width):
            for j in range(i + 1, width):
                out.append(np.stack([np.full(len(b), -1), b + i, b + j]))
    for b, width in zip(begin[m > SMALL].tolist(), m[m > SMALL].tolist(), strict=True):
        members = np.arange(b, b + width)
        name = int(_mix(np.array([node[members].astype(np.uint64).sum(dtype=np.uint64) ^ _U(width)]))[0] >> _U(1))
        out.append(np.stack([np.full(width - 1, -1), np.full(width - 1, b), members[1:]]))
        out.append(np.stack([np.full(width, name), members, members]))
    if not out:
        return pd.DataFrame({"region": [], "a": [], "b": []}, dtype="int64")
    r, i, j = np.concatenate(out, axis=1)
    ok = (size[i] * 100 >= size[j] * PERCENT) & (size[j] * 100 >= size[i] * PERCENT)
    return pd.DataFrame({"region": r[ok], "a": node[i[ok]], "b": node[j[ok]]}).drop_duplicates()


def weighted_distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weighted Jaccard distance of count vectors, rows against rows (broadcast)."""
    return 1 - np.minimum(x, y).sum(-1) / np.maximum(np.maximum(x, y).sum(-1), 1)


def _across(x: np.ndarray, group: np.ndarray, tol: float, met: list[list[np.ndarray]] | None = None) -> list[tuple[int, int]]:
    """Pairs i < j of different groups within tol: every row outside the largest group against all rows.

    met: for each row, the rows it has met elsewhere already; such pairs are left out."""
    _, of, sizes = np.unique(group, return_inverse=True, return_counts=True)
    minor = of != sizes.argmax()
    open_ = np.ones(len(x), bool)
    out = []
    for i in np.flatnonzero(minor):
        open_[i] = False
        ask = group != group[i]
        ask &= open_ | ~minor
        if met is not None:
            for rows in met[i]:
                ask[rows] = False
        j = np.flatnonzero(ask)
        if len(j):
            near = j[weighted_distance(x[i], x[j]) <= tol]
            out += [(min(int(i), k), max(int(i), k)) for k in near.tolist()]
    return out


def metric_join(x: np.ndarray, group: np.ndarray, met: list[list[np.ndarray]] | None = None, eps: float = EPS, leaf: int = 64, cells: int = 8, depth: int = 0) -> list[tuple[int, int]]:
    """Pairs i < j of different groups within eps of each other, by recursive Voronoi cells of pivots.

    A document belongs to its nearest pivot's cell and is copied into every cell whose pivot is at most 2 eps farther;
    if i is at home in a cell and j is within eps of i, j is in that cell too. What a split doesn't shrink is compared directly."""
    tol = eps + 1e-9
    _, sizes = np.unique(group, return_counts=True)
    if len(sizes) < 2:
        return []
    if len(x) <= leaf or depth > 8 or len(x) - sizes.max() <= cells:
        return sorted(set(_across(x, group, tol, met)))
    pivots = [0]
    far = weighted_distance(x, x[0])
    d = [far]
    while len(pivots) < cells and far.max() > tol:
        pivots.append(int(far.argmax()))
        d.append(weighted_distance(x, x[pivots[-1]]))
        far = np.minimum(far, d[-1])
    dist = np.stack(d, axis=1)
    home = dist.argmin(1)
    window = dist <= dist[np.arange(len(x)), home][:, None] + 2 * tol
    if window.sum() > 0.7 * window.size:
        return sorted(set(_across(x, group, tol, met)))
    found: set[tuple[int, int]] = set()
    for c in range(len(pivots)):
        members = np.flatnonzero(window[:, c])
        if (home[members] == c).any():
            at = np.full(len(x), -1)
            at[members] = np.arange(len(members))
            own = [[(r := at[rows])[r >= 0] for rows in met[i]] for i in members] if met is not None else None
            found.update((int(members[i]), int(members[j])) for i, j in metric_join(x[members], group[members], own, eps, leaf, cells, depth + 1 if len(members) < 0.9 * len(x) else 99))
    return sorted(found)


def _region_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """Pairs of a region's documents that are of different classes and may link; pairs that meet in an earlier region are left to that one."""
    pdf = pdf.drop_duplicates("node").sort_values("node")
    region, node = pdf["region"].iloc[0], pdf["node"].to_numpy()
    earlier = [np.asarray(r, np.int64) for r in pdf["regions"]]
    earlier = [r[r < region] for r in earlier]
    rows = np.repeat(np.arange(len(node)), [len(r) for r in earlier])
    flat = np.concatenate(earlier) if earlier else np.zeros(0, np.int64)
    order = np.argsort(flat, kind="stable")
    cuts = np.flatnonzero(np.diff(flat[order])) + 1
    shared = dict(zip(flat[order][np.concatenate([[0], cuts])].tolist(), np.split(rows[order], cuts), strict=True)) if len(flat) else {}
    met = [[shared[r] for r in own.tolist()] for own in earlier]
    ij = np.array(metric_join(vectors(pdf["vec"].tolist()), pdf["label"].to_numpy(), met), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": node[ij[:, 0]], "b": node[ij[:, 1]]})


def _links(u: np.ndarray, v: np.ndarray) -> bool:
    n = len(u) + len(v)
    least = -(-PERCENT * n // (100 + PERCENT))  # 100 * i >= PERCENT * (n - i)
    if min(len(u), len(v)) < least:
        return False
    return len(np.intersect1d(u, v, assume_unique=True)) >= max(least, 1)


SETS = "hub long, salt int, member boolean, node long, grams binary"


def _own_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text, jobs) -> a row for each job, with the whole set: for a hub one a salt, for a member one a hub. A doc_id may come with several
    texts, so that only the text with the node's own set counts; one row a node and task."""
    seen: set[int] = set()
    names, kinds = ["hub", "salt", "member", "node", "grams"], [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()]
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            some = batch.slice(k, 500)
            sets = shingle_sets([(t or "").encode("utf-8", "surrogatepass") for t in some.column("text").to_pylist()])
            rows = []
            for node, u, jobs in zip(some.column("node").to_pylist(), sets, some.column("jobs").to_pylist(), strict=True):
                if len(u) and node not in seen and set_id(u) == node:
                    seen.add(node)
                    packed = u.tobytes()
                    rows += [(j["hub"], j["salt"], j["hub"] != node, node, packed) for j in jobs]
            for at in range(0, len(rows), 500):
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at : at + 500]], t) for i, t in enumerate(kinds)], names)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> node, text: each set once a task."""
    seen: set[int] = set()
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            texts = batch.column("text").slice(k, 500)
            new = []
            for i, u in enumerate(shingle_sets([t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()])):
                if len(u) and (node := set_id(u)) not in seen:
                    seen.add(node)
                    new.append((i, node))
            yield pa.RecordBatch.from_arrays([pa.array([n for _, n in new], pa.int64()), texts.take(pa.array([i for i, _ in new], pa.int64()))], ["node", "text"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (hub, salt, member): every member that links with its hub, compared set by set; one hub is held at a time."""
    hub, own = None, None
    for batch in batches:
        grams = batch.column("grams")
        a, b = [], []
        for k, (at, member, node) in enumerate(zip(batch.column("hub").to_pylist(), batch.column("member").to_pylist(), batch.column("node").to_pylist(), strict=True)):
            if not member:
                hub, own = at, np.frombuffer(grams[k].as_py(), np.uint64)
            elif hub == at and _links(own, np.frombuffer(grams[k].as_py(), np.uint64)):
                a.append(at)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose count vectors are within the threshold: none that links is lost."""
    for batch in batches:
        keep = []
        for a, b in zip(batch.column("vec_a").to_pylist(), batch.column("vec_b").to_pylist(), strict=True):
            x, y = vectors([a, b])
            keep.append(bool(weighted_distance(x, y) <= EPS + 1e-9))
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], ["a", "b"])


@dataclass
class Texts:
    """Where whole texts of nodes come from: the documents, and one document of each node."""

    docs: DataFrame
    nodes: DataFrame  # node, doc_id, vec


def _verify(pairs: DataFrame, texts: Texts, name: str) -> DataFrame:
    """The pairs (a, b) that link. Members travel once to each of their hubs a; hubs with many members are dealt over salts."""
    pairs = materialise(pairs, f"{name}-pairs")
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("salts"))
    hubs = salts.select(F.col("a").alias("node"), F.col("a").alias("hub"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    members = pairs.join(salts, "a").select(F.col("b").alias("node"), F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    jobs = hubs.unionByName(members).groupBy("node").agg(F.collect_list(F.struct("hub", "salt")).alias("jobs"))
    ids = materialise(texts.nodes.select("node", F.col("doc_id").alias("of")).join(jobs, "node"), f"{name}-jobs")
    docs = texts.docs.where("text IS NOT NULL")
    nameless = ids.where("of IS NULL")
    small = ids.agg(F.coalesce(F.sum(F.size("jobs") + 1), F.lit(0))).first()[0] <= MAX_BROADCAST
    some = docs.join(F.broadcast(ids) if small else ids, docs["doc_id"] == ids["of"]).select("node", "text", "jobs")
    if not nameless.isEmpty():  # sets whose documents all have a null id are told by the set itself
        named = docs.where("doc_id IS NULL").select("text").mapInArrow(_nodes, "node long, text string")
        some = some.unionByName(named.join(nameless, "node").select("node", "text", "jobs"))
    sets = some.mapInArrow(_own_sets, SETS).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "member")
    return materialise(sets.mapInArrow(_linked, "a long, b long"), f"{name}-links", 500)


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a partition to stars (node, least node of its tree), FOREST links at a time; what is connected stays connected."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    def stars() -> pa.RecordBatch:
        rows = [(x, find(x)) for x in list(root)]
        rows = [(x, r) for x, r in rows if x != r]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in (0, 1)], ["u", "v"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
                root.setdefault(min(a, b), min(a, b))
        if len(root) > FOREST:
            yield stars()
    if root:
        yield stars()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) for every node of links(a, b).

    Partitions first contract their own links; large-star and small-star rounds of joins then run until every node but a root has
    one neighbour, its root. Rounds grow with the logarithm of the largest component."""
    edges = links.where("a <> b").select("a", "b").mapInArrow(_forest, "u long, v long")
    while True:
        edges = materialise(edges, f"{name}-edges")
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("k")), f"{name}-least")
        open_ = least.agg(F.count(F.when((F.col("m") < F.col("u")) & (F.col("k") > 1), 1))).first()[0]
        if not open_:
            return least.select(F.col("u").alias("node"), F.least("u", "m").alias("label"))
        # large star: larger neighbours go to the least of all; small star: smaller neighbours, and the node itself
        up = both.join(least.select("u", F.least("u", "m").alias("m")), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = up.groupBy("u").agg(F.min("v").alias("m"))
        down = up.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = down.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _relabel(label: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels after more links: components of the labels that these links join, looked up for every node."""
    met = _labelled(_labelled(links, label, "a"), label, "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).where("a <> b").distinct()
    top = components(met, name).select(F.col("node").alias("label"), F.col("label").alias("now"))
    return materialise(label.join(top, "label", "left").select("node", F.coalesce("now", "label").alias("label")), f"{name}-labels")


def _labelled(df: DataFrame, label: DataFrame, c: str) -> DataFrame:
    """df plus label_<c>, the class so far of the node in column c."""
    return df.join(label.select(F.col("node").alias(c), F.col("label").alias(f"label_{c}")), c)


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of a block that many of its documents have: (part, key, n)."""
    for batch in batches:
        for part, keys in zip(batch.column("part").to_pylist(), batch.column("keys").to_pylist(), strict=True):
            key, n = np.unique(np.frombuffer(keys, "<u4"), return_counts=True)
            some = n >= COMMON
            yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), part), pa.int32()), pa.array(key[some].astype(np.int64)), pa.array(n[some])], ["part", "key", "n"])


def _without(hot: dict[int, np.ndarray], inverse: bool):
    """Blocks without the hot signatures; inverse: a row for each document of a hot signature (region, a, n) instead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [[], [], [], [], []]
            for r in batch.to_pylist():
                keys, which = np.frombuffer(r["keys"], "<u4"), np.frombuffer(r["which"], "<u4")
                out = np.isin(keys, hot.get(r["part"], np.zeros(0, np.uint32)))
                if inverse:
                    at = which[out]
                    for c, v in zip(cols, (keys[out].astype(np.int64) << 31 | r["part"], np.frombuffer(r["nodes"], np.int64)[at], np.frombuffer(r["sizes"], np.int64)[at]), strict=False):
                        c.append(v)
                else:
                    for c, v in zip(cols, (r["part"], keys[~out].tobytes(), which[~out].tobytes(), r["nodes"], r["sizes"]), strict=True):
                        c.append(v)
            if inverse:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in cols[:3]], ["region", "a", "n"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], ["part", "keys", "which", "nodes", "sizes"])

    return run


def _joined(blocks: DataFrame, parts: int) -> DataFrame:
    """REGIONS of all signatures. A signature of more than HOT documents is a region of its own, joined with its pivot by a join of rows."""
    common = blocks.mapInArrow(_common, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT)
    found = common.select("part", "key").collect()  # all signatures / HOT at most
    if not found:
        return materialise(blocks.repartition(parts, "part").groupBy("part").applyInPandas(_regions, REGIONS), "regions")
    hot = {p: np.array([r["key"] for r in found if r["part"] == p], np.uint32) for p in {r["part"] for r in found}}
    rest = blocks.mapInArrow(_without(hot, False), blocks.schema)
    usual = rest.repartition(parts, "part").groupBy("part").applyInPandas(_regions, REGIONS)
    rows = blocks.mapInArrow(_without(hot, True), "region long, a long, n long")
    pivot = rows.groupBy("region").agg(F.min(F.struct("a", "n")).alias("p"))
    own = rows.join(F.broadcast(pivot), "region")
    ok = (F.col("n") * 100 >= F.col("p.n") * PERCENT) & (F.col("p.n") * 100 >= F.col("n") * PERCENT) & (F.col("a") != F.col("p.a"))
    pairs = own.where(ok).select(F.lit(-1).cast("long").alias("region"), F.col("p.a").alias("a"), F.col("a").alias("b"))
    return materialise(usual.unionByName(rows.select("region", "a", F.col("a").alias("b"))).unionByName(pairs), "regions")


def _dealt(mixed: DataFrame) -> DataFrame:
    """Members of regions with several classes, each in every group (x <= y) of blocks where it meets members of other classes: the largest class of a region
    and the others are dealt in blocks of BLOCK; two blocks of the largest class never meet."""
    sizes = mixed.groupBy("region", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("all"))
    major, minor = F.ceil(F.col("k") / BLOCK).cast("int"), F.ceil((F.col("all") - F.col("k")) / BLOCK).cast("int")
    at = F.xxhash64("node")
    own = F.when(F.col("label") == F.col("main"), F.pmod(at, F.col("major"))).otherwise(F.pmod(at, F.col("minor")) + F.col("major")).cast("int")
    others = F.when(F.col("label") == F.col("main"), F.sequence(F.col("major"), F.col("major") + F.col("minor") - 1)).otherwise(F.sequence(F.lit(0), F.col("major") + F.col("minor") - 1))
    several = main.where("k < all").select("region", "main", major.alias("major"), minor.alias("minor"))
    blocks = mixed.join(several, "region").withColumn("own", own).withColumn("other", F.explode(others)).where("own <> other")
    return blocks.select("region", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", "label")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text).

    Null and blank texts have no shingles and are classes of their own; texts of fewer than five words link with equal word
    sequences. Repeated rows share a class. Rows without doc_id link like others and have their class's id, which is null where no row of the class
    has one. Other columns are ignored; an empty table gives an empty result."""
    docs = docs.select("doc_id", "text")
    chars = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    parts = max(1, int(chars / 6 * 0.5 / PER_PART) + 1)
    signed = materialise(docs.mapInArrow(_sign(parts), SIGNED), "signed", 2000)
    rows = materialise(signed.where("part IS NULL").select("doc_id", "n", "node"), "rows")
    blocks = signed.where("part IS NOT NULL").select("part", "keys", "which", "nodes", "sizes")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("vec").alias("vec"))
    nodes = materialise(nodes, "classes")
    found = _joined(blocks, parts)
    discard(signed)
    pairs = found.where("region = -1").select("a", "b").distinct()
    vec = nodes.select("node", "vec")
    near = pairs.join(vec.select(F.col("node").alias("a"), F.col("vec").alias("vec_a")), "a").join(vec.select(F.col("node").alias("b"), F.col("vec").alias("vec_b")), "b")
    pairs = materialise(near.select("a", "b", "vec_a", "vec_b").mapInArrow(_near, "a long, b long"), "near")
    texts = Texts(docs, nodes)
    # first every document with its least pivot, then with the other pivots that are in another class still
    done = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = components(_verify(done, texts, "first"), "first")
    label = materialise(nodes.select("node").join(first, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    more = _labelled(_labelled(pairs.join(done, ["a", "b"], "left_anti"), label, "a"), label, "b").where("label_a <> label_b").select("a", "b")
    label = _relabel(label, _verify(more, texts, "second"), "second")
    # then regions that hold several classes; pairs of a small region have all been compared
    members = found.where("region <> -1").select("region", F.col("a").alias("node")).distinct()
    mixed = materialise(members.join(label, "node").select("region", "node", "label"), "members")
    several = mixed.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("region")
    mixed = materialise(mixed.join(several, "region", "left_semi"), "mixed")
    of = mixed.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("region")), 1, EARLIER).alias("regions")).join(vec, "node")
    rest = _dealt(mixed).join(of, "node").select("region", "x", "y", "node", "label", "vec", "regions").groupBy("region", "x", "y").applyInPandas(_region_pairs, "a long, b long")
    rest = rest.distinct().join(pairs, ["a", "b"], "left_anti")
    label = _relabel(label, _verify(rest, texts, "third"), "third")
    named = nodes.select("node", "doc_id").join(label, "node")
    least = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of = materialise(named.join(least, "label").select("node", "component_id"), "components")
    return rows.join(of, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
