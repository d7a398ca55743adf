"""Most similar vectors by a hierarchical k-means tree with best-bin-first search.

The tree is fitted on a bounded sample; every vector is then filed in its leaf. A query walks the tree with a priority
queue of branches, nearest centre first, and visits so many leaves as the calibration found enough:
visits are widened until a sample of queries, whose true neighbours among all vectors are known by brute force, proves the recall.

Only short codes (sides of random planes) travel to all leaves that are visited. What they say of the distances, give or take an estimate's margin, tells
which leaves can hold a neighbour; the vector itself goes to these alone, and meets a leaf's own vectors there as a matrix product.
The final similarities are taken in double precision, pair by pair.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evispark.functions.encoding import half_precision
from evispark.staging import broadcast_if_small, stage

#: Numbers in a vector of each model: fixed values.
DIMENSIONS = {"vec-base-1": 1536, "vec-small-0": 768}
K, MIN_COSINE = 10, 0.5
#: Bounds of what the driver sees of a model: rows the tree is fitted on and calibrated with.
SAMPLE_ROWS = 8192
#: Queries of the calibration.
HELD_ROWS = 1024
LEAF_ROWS, BRANCHES = 1536, 8
RECALL = 0.995
#: A leaf's vectors are worked on in blocks of this many, its codes in so many blocks at once.
BLOCK_ROWS, CODE_BLOCKS = 8192, 8
#: Bits of a vector's code.
CODE_BITS = 1536
_PLANES: dict[int, np.ndarray] = {}
#: An id on more rows than this is brought to one row before anything else.
REPEATS = 8


def _direction(raw: bytes) -> bytes:
    """The value but for a power of two: vectors that are equal in this have exactly equal cosines with all others."""
    x = np.frombuffer(raw, dtype="<f2").astype(np.float64)
    return (x / 2.0 ** np.frexp(np.abs(x).max())[1]).tobytes()


def _matrix(raw: list[bytes]) -> np.ndarray:
    """Unit vectors in single precision."""
    x = np.frombuffer(b"".join(raw), dtype="<f2").reshape(len(raw), -1).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def readable_vectors(recordings: DataFrame, dimensions: dict[str, int] = DIMENSIONS) -> DataFrame:
    """(model, vec_id, vec, h): the readable values of the models in ``dimensions``; h is a hash of the direction. Rows may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            keep, vec, h = [], [], []
            for i, (model, value) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                raw = half_precision(value, dimensions[model])
                if raw is not None:
                    keep.append(i), vec.append(raw), h.append(xxhash.xxh64_intdigest(_direction(raw)))
            at = pa.array(keep, pa.int32())
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(vec, pa.binary()), pa.array(np.array(h, dtype=np.uint64).view(np.int64))], names=["model", "vec_id", "vec", "h"])

    rows = recordings.select("model", F.col("vec_id").cast("bigint").alias("vec_id"), "embedding_f16_b64").filter(F.col("model").isin(*dimensions) & F.col("vec_id").isNotNull())
    return rows.mapInArrow(run, "model string, vec_id bigint, vec binary, h bigint")


class Tree:
    """Centres of a hierarchical k-means tree over unit vectors. Node 0 is the root; leaves are numbered from 0."""

    def __init__(self, x: np.ndarray, leaf_rows: int, seed: int = 0) -> None:
        self.children: list[list[int]] = []
        self.centres: list[np.ndarray] = []
        self.leaf: list[int] = []
        self.n_leaves = 0
        rng = np.random.default_rng(seed)
        self._grow(x, np.arange(len(x)), max(2, leaf_rows), rng, x.mean(axis=0))
        self.all = np.stack(self.centres).astype(np.float32)

    def _grow(self, x: np.ndarray, at: np.ndarray, leaf_rows: int, rng: np.random.Generator, centre: np.ndarray) -> int:
        node = len(self.centres)
        self.centres.append(centre / max(np.linalg.norm(centre), 1e-12))
        self.children.append([])
        self.leaf.append(-1)
        label = _kmeans(x[at], min(BRANCHES, -(-at.size // leaf_rows)), rng) if at.size > leaf_rows else np.zeros(at.size, dtype=int)
        parts = np.unique(label)
        if parts.size < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return node
        for p in parts:
            own = at[label == p]
            self.children[node].append(self._grow(x, own, leaf_rows, rng, x[own].mean(axis=0)))
        return node

    def visits(self, x: np.ndarray, most: int) -> np.ndarray:
        """For each row the first ``most`` leaves in best-bin-first order, -1 where the tree has fewer."""
        near = x @ self.all.T
        out = np.full((len(x), most), -1, dtype=np.int32)
        for i in range(len(x)):
            queue, found = [(0.0, 0)], 0
            while queue and found < most:
                _, node = heapq.heappop(queue)
                while self.children[node]:  # go down to the nearest child, keep the others
                    ordered = sorted(self.children[node], key=lambda c: -near[i, c])
                    for c in ordered[1:]:
                        heapq.heappush(queue, (-float(near[i, c]), c))
                    node = ordered[0]
                out[i, found] = self.leaf[node]
                found += 1
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), size=k, replace=False)]
    label = None
    for _ in range(rounds):
        new = np.argmax(x @ centres.T, axis=1)
        if label is not None and (new == label).all():
            break
        label = new
        for c in range(k):
            own = x[label == c]
            centres[c] = own.mean(axis=0) if len(own) else x[rng.integers(len(x))]
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
    return label


def fit_tree(x: np.ndarray, n_rows: int) -> tuple[Tree, np.ndarray]:
    """(tree, places of the held rows) from a sample ``x``, one row a direction, of ``n_rows`` vectors.

    Leaves hold about LEAF_ROWS of all vectors, and three of the sample at least. A quarter of the sample, HELD_ROWS at most, has no part in the
    tree: its rows are the queries of the calibration.
    """
    order = np.random.default_rng(0).permutation(len(x))
    apart = min(HELD_ROWS, max(1, len(x) // 4)) if len(x) >= 64 else 0
    seen = x[order[apart:]]
    return Tree(seen, max(3, int(len(seen) * LEAF_ROWS / max(n_rows, 1)))), order[:apart]


def enough_visits(tree: Tree, held: np.ndarray, query: np.ndarray, leaf: np.ndarray, recall: float = RECALL) -> int:
    """The least number of leaves to visit that proves ``recall``, else all. ``query`` and ``leaf`` are the true neighbours' rows of ``held`` and their leaves.

    Proved is what the lower bound of the recall (one-sided, 95 %) reaches, pairs taken each for itself (Wilson) and by query; no or few pairs prove nothing.
    """
    walk = tree.visits(held, tree.n_leaves)
    rank = np.empty_like(walk)
    np.put_along_axis(rank, walk, np.arange(tree.n_leaves, dtype=walk.dtype)[None], axis=1)
    needed, z, n = rank[query, leaf], 1.645, len(query)
    pairs = np.bincount(query, minlength=len(held))
    for visits in range(1, tree.n_leaves if n else 0):
        hits = np.bincount(query[needed < visits], minlength=len(held))
        r = hits.sum() / n
        wilson = (r + z * z / (2 * n) - z * np.sqrt(r * (1 - r) / n + z * z / (4 * n * n))) / (1 + z * z / n)
        by_query = r - z * np.sqrt(((hits - r * pairs) ** 2).sum()) / n
        if min(wilson, by_query) >= recall:
            return visits
    return tree.n_leaves


_TRUE = "model string, query int, h bigint, cosine float, leaf int"


def true_neighbours(vectors: DataFrame, held: dict[str, tuple[Tree, np.ndarray, np.ndarray]], k: int) -> DataFrame:
    """(model, query, h, cosine, leaf): the ``k`` most similar other directions, at MIN_COSINE or more, of each held query among all ``vectors``, with their leaves.

    ``held`` has the tree, the queries and the hashes of their directions for each model. A task compares its vectors with all queries and keeps k a query.
    """
    shared = vectors.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {m: (np.full((len(q), k), -2, np.float32), np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int32)) for m, (_, q, _) in shared.value.items()}
        for batch in batches:
            models, hashes = np.array(batch.column(0).to_pylist(), dtype=object), batch.column(1).to_numpy()
            for model in set(models) & set(best):
                tree, queries, own = shared.value[model]
                at = np.flatnonzero(models == model)
                at = at[np.unique(hashes[at], return_index=True)[1]]
                for part in np.array_split(at, -(-at.size // 1024)):
                    x, h = _matrix(batch.column(2).take(pa.array(part)).to_pylist()), hashes[part]
                    near = queries @ x.T
                    near[own[:, None] == h[None]] = -2
                    top = np.argpartition(-near, k - 1, axis=1)[:, :k] if part.size > k else np.broadcast_to(np.arange(part.size), (len(near), part.size))
                    c = np.take_along_axis(near, top, axis=1)
                    use = np.unique(top[(c >= MIN_COSINE) & (c > best[model][0].min(axis=1)[:, None])])
                    if not use.size:
                        continue
                    leaf = np.zeros(part.size, np.int32)
                    leaf[use] = tree.visits(x[use], 1)[:, 0]
                    c, hs, leaves = (np.hstack(y) for y in zip(best[model], (c, h[top], leaf[top]), strict=True))
                    order = np.lexsort((-c, hs))  # a direction that came before counts once
                    c, hs, leaves = (np.take_along_axis(y, order, axis=1) for y in (c, hs, leaves))
                    c[:, 1:][hs[:, 1:] == hs[:, :-1]] = -2
                    order = np.argsort(-c, axis=1, kind="stable")[:, :k]
                    best[model] = tuple(np.take_along_axis(y, order, axis=1) for y in (c, hs, leaves))
        for model, (c, hs, leaves) in best.items():
            i, j = np.nonzero(c >= MIN_COSINE)
            yield pa.record_batch([pa.array([model] * i.size, pa.string()), pa.array(i.astype(np.int32)), pa.array(hs[i, j]), pa.array(c[i, j]), pa.array(leaves[i, j])], names=["model", "query", "h", "cosine", "leaf"])

    rows = vectors.select("model", "h", "vec").filter(F.col("model").isin(*held)).mapInArrow(run, _TRUE)
    rows = rows.groupBy("model", "query", "h").agg(F.max("cosine").alias("cosine"), F.min("leaf").alias("leaf"))
    w = Window.partitionBy("model", "query").orderBy(F.col("cosine").desc(), "h")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("rank")


def _planes(size: int) -> np.ndarray:
    """Random planes through the origin, the same in every process; column by column the bits of a code."""
    if size not in _PLANES:
        _PLANES[size] = np.random.default_rng(size).standard_normal((size, CODE_BITS), dtype=np.float32)
    return _PLANES[size]


def codes(x: np.ndarray) -> np.ndarray:
    """The sides of :data:`CODE_BITS` random planes on which each row of ``x`` lies, as bytes: the share of unlike bits estimates the angle."""
    return np.packbits(x @ _planes(x.shape[1]) >= 0, axis=1)


_CODED = "model string, vec_id bigint, h bigint, code binary, leaves array<int>"


def _coded(vectors: DataFrame, trees: dict[str, tuple[Tree, int]]) -> DataFrame:
    """Every vector's code and the leaves it visits, its own first; an id with several values goes on with that of the least hash."""
    shared = vectors.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = np.array(batch.column(0).to_pylist(), dtype=object)
            for model in set(models):
                tree, most = shared.value[model]
                for at in np.array_split(np.flatnonzero(models == model), -(-int((models == model).sum()) // 512)):
                    part = batch.take(pa.array(at))
                    x = _matrix(part.column(3).to_pylist())
                    leaves = [row[row >= 0] for row in tree.visits(x, most)]
                    yield pa.record_batch([*(part.column(c) for c in range(3)), pa.array([c.tobytes() for c in codes(x)], pa.binary()), pa.array(leaves, pa.list_(pa.int32()))], names=["model", "vec_id", "h", "code", "leaves"])

    rows = vectors.select("model", "vec_id", "h", "vec").mapInArrow(run, _CODED)
    return rows.groupBy("model", "vec_id").agg(F.min(F.struct("h", "code", "leaves")).alias("x")).select("model", "vec_id", "x.*")


def _unlike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The numbers of unlike bits between the rows of two arrays of 64-bit words."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def _words(packed: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(packed.to_pylist()), dtype=np.uint64).reshape(len(packed), -1)


_WANTED = "model string, vec_id bigint, leaf int, sub int, near array<int>"
#: Half the width of an estimate of the angle, in bits: so many standard deviations.
DEVIATIONS = 4
_MARGIN = int(DEVIATIONS * np.sqrt(CODE_BITS / 4))
_FARTHEST = int(CODE_BITS * np.arccos(MIN_COSINE) / np.pi) + _MARGIN


def _wanted(rows: pa.Table, k: int) -> pa.Table:
    """Of a part of a leaf: for each asking code and each block (sub) of the leaf the ``k`` least distances, where any is near enough to MIN_COSINE."""
    own, asking = rows.filter(rows["base"]), rows.filter(pc.invert(rows["base"]))
    ids, subs, base = own["vec_id"].to_numpy(), own["sub"].to_numpy(), _words(own["code"])
    q_ids, q = asking["vec_id"].to_numpy(), _words(asking["code"])
    who, of, near = [], [], []
    for sub in np.unique(subs):
        mine = subs == sub
        for at in range(0, len(q), 256):
            d = _unlike(q[at : at + 256], base[mine])
            d[q_ids[at : at + 256, None] == ids[mine][None]] = 2 * CODE_BITS
            d = np.sort(np.partition(d, k - 1, axis=1)[:, :k] if d.shape[1] > k else d, axis=1)
            hit = np.flatnonzero(d[:, 0] <= _FARTHEST)
            who.append(q_ids[at + hit]), of.append(np.full(hit.size, sub)), near.extend(d[hit].tolist())
    who, of = (np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (who, of))
    first = {c: rows[c][0].as_py() for c in ("model", "leaf")}
    return pa.table([pa.array([first["model"]] * who.size, pa.string()), pa.array(who, pa.int64()), pa.array(np.full(who.size, first["leaf"], dtype=np.int32)), pa.array(of.astype(np.int32)), pa.array(near, pa.list_(pa.int32()))], names=["model", "vec_id", "leaf", "sub", "near"])


def _routes(coded: DataFrame, k: int) -> DataFrame:
    """(model, vec_id, h, leaf, sub, part, base, asks): where each vector must go.

    Only codes go to all leaves that a vector visits. A leaf, or a block of a crowded one, gets the vector itself if its nearest code may, within the
    estimate's margin, be among the vector's k nearest; so what is dropped can't be a neighbour. ``sub`` counts the blocks of a leaf by its own number
    of rows, ``part`` those of the askers by theirs: each pair of parts is a task of bounded size.
    """
    visits = coded.select("model", "vec_id", "code", F.posexplode("leaves").alias("turn", "leaf"))
    sizes = visits.groupBy("model", "leaf").agg(F.sum((F.col("turn") == 0).cast("bigint")).alias("own"), F.count("*").alias("asked"))
    up = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    sizes = sizes.select("model", "leaf", up(F.col("own"), BLOCK_ROWS).alias("subs"), up(F.col("own"), BLOCK_ROWS * CODE_BLOCKS).alias("blocks"), up(F.col("asked"), BLOCK_ROWS * CODE_BLOCKS).alias("parts")).filter("subs > 0")
    sizes = stage(sizes, "leaves")  # a row a leaf
    number = F.xxhash64("vec_id")
    rows = visits.join(F.broadcast(sizes), ["model", "leaf"]).withColumn("sub", F.pmod(number, F.col("subs")).cast("int")).withColumn("mine", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("parts")).cast("int"))
    to = lambda block, part, base: F.struct(block.cast("int").alias("block"), part.cast("int").alias("part"), F.lit(base).alias("base"))
    asks = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: to(b, F.col("mine"), False))
    base = F.when(F.col("turn") == 0, F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: to(F.pmod("sub", "blocks"), p, True)))
    rows = rows.select("model", "leaf", "vec_id", "sub", "code", F.explode(F.concat(asks, F.coalesce(base, F.array().cast("array<struct<block:int,part:int,base:boolean>>")))).alias("to")).select("model", "leaf", "vec_id", "sub", "code", "to.*")
    wanted = stage(rows.groupBy("model", "leaf", "block", "part").applyInArrow(lambda rows: _wanted(rows, k), _WANTED), "wanted")
    kth = wanted.groupBy("model", "vec_id").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("d")).select("model", "vec_id", F.coalesce(F.try_element_at("d", F.lit(k)), F.lit(2 * CODE_BITS)).alias("kth"))
    asked = wanted.join(kth, ["model", "vec_id"]).filter(F.col("near")[0] <= F.col("kth") + _MARGIN).select("model", "vec_id", "leaf", "sub")
    asked = stage(asked, "asked")
    parts = asked.groupBy("model", "leaf", "sub").agg(up(F.count("*"), BLOCK_ROWS).alias("parts"))
    own = coded.select("model", "vec_id", F.col("leaves")[0].alias("leaf")).join(F.broadcast(sizes.select("model", "leaf", "subs")), ["model", "leaf"]).select("model", "vec_id", "leaf", F.pmod(number, F.col("subs")).cast("int").alias("sub"))
    flags = own.withColumn("base", F.lit(True)).withColumn("asks", F.lit(False)).unionByName(asked.withColumn("base", F.lit(False)).withColumn("asks", F.lit(True)))
    flags = flags.groupBy("model", "vec_id", "leaf", "sub").agg(F.max("base").alias("base"), F.max("asks").alias("asks"))
    rows = flags.join(broadcast_if_small(parts, 100_000), ["model", "leaf", "sub"]).withColumn("mine", F.pmod(F.xxhash64(F.lit(2), "vec_id"), F.col("parts")).cast("int"))
    every = F.when(F.col("base"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("mine"))
    rows = rows.withColumn("part", F.explode(every)).withColumn("asks", F.col("asks") & (F.col("part") == F.col("mine")))
    return rows.join(coded.select("model", "vec_id", "h"), ["model", "vec_id"]).select("model", "vec_id", "h", "leaf", "sub", "part", "base", "asks")


_NEAR = "model string, vec_id bigint, other bigint, cosine double"


def _leaf_neighbours(own: pa.Table, asking: pa.Table, k: int) -> pa.RecordBatch:
    """For each asking vector its ``k`` most similar ones of ``own``, if they reach MIN_COSINE."""
    out: list[list[np.ndarray]] = [[], [], []]
    ids = own["vec_id"].to_numpy()
    first = np.unique(ids, return_index=True)[1]  # rows may repeat
    ids, raw = ids[first], own["vec"].take(pa.array(first)).to_pylist()
    base = _matrix(raw) if raw else None
    q_ids, again = np.unique(asking["vec_id"].to_numpy(), return_index=True)
    q_raw = asking["vec"].take(pa.array(again)).to_pylist()
    for at in range(0, len(q_ids) if raw else 0, 512):
        near = _matrix(q_raw[at : at + 512]) @ base.T
        near[q_ids[at : at + 512, None] == ids[None]] = -2
        # whatever rounding in single precision could have kept out is taken along
        kth = np.partition(near, -k, axis=1)[:, -k] if near.shape[1] > k else np.full(len(near), -1.0)
        i, j = np.nonzero(near >= np.maximum(kth, MIN_COSINE)[:, None] - 1e-5)
        for part in np.array_split(np.arange(i.size), -(-i.size // 2048)) if i.size else []:
            a = np.frombuffer(b"".join(q_raw[at + x] for x in i[part]), dtype="<f2").reshape(part.size, -1).astype(np.float64)
            b = np.frombuffer(b"".join(raw[x] for x in j[part]), dtype="<f2").reshape(part.size, -1).astype(np.float64)
            cosine = (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
            good = cosine >= MIN_COSINE
            for col, x in zip(out, (q_ids[at + i[part]], ids[j[part]], cosine), strict=True):
                col.append(x[good])
    q, o, c = (np.concatenate(x) if x else np.zeros(0) for x in out)
    order = np.lexsort((o, -c, q))
    q, o, c = q[order].astype(np.int64), o[order].astype(np.int64), c[order]
    begin = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if q.size else np.zeros(0, dtype=int)
    place = np.arange(q.size) - np.repeat(begin, np.diff(np.concatenate([begin, [q.size]])))
    best = place < k
    model = own["model"][0] if own.num_rows else asking["model"][0] if asking.num_rows else None
    return pa.record_batch([pa.array([model.as_py() if model is not None else None] * int(best.sum()), pa.string()), pa.array(q[best]), pa.array(o[best]), pa.array(c[best])], names=["model", "vec_id", "other", "cosine"])


def nearest_vectors(recordings: DataFrame, k: int = K, recall: float = RECALL, dimensions: dict[str, int] = DIMENSIONS) -> DataFrame:
    """(model, vec_id, other, cosine, rank): for each readable vector its ``k`` most similar ones of its model at MIN_COSINE or more.

    Equal similarities go by the smaller id; an id that stands on several rows counts once. Of more than k + 1
    ids with one and the same direction only the k + 1 least can be among anybody's neighbours: the others are neither filed
    nor sent, and their own neighbours are the least ids of their value. Leaves that hold more than BLOCK_ROWS are cut into
    blocks by their own number of rows, each in its own task (:func:`_routes`). Unreadable values and models that aren't in
    ``dimensions`` have no rows.
    """
    vectors = readable_vectors(recordings, dimensions)
    # copies: only ids and hashes are shuffled; WindowGroupLimit keeps k + 2 rows of a value before the shuffle
    values = stage(vectors.groupBy("model", "vec_id", "h").agg(F.count("*").alias("rows")), "values")
    often = values.filter(F.col("rows") > REPEATS).select("model", "vec_id").distinct()
    if often.limit(1).count():  # an id that was delivered again and again goes on once
        once = vectors.join(often, ["model", "vec_id"], "left_semi").groupBy("model", "vec_id").agg(F.min("vec").alias("vec"), F.min("h").alias("h"))
        vectors = vectors.join(often, ["model", "vec_id"], "left_anti").unionByName(once.select(*vectors.columns))
    counts = values.groupBy("model", "h").agg(F.count("*").alias("n")).filter(F.col("n") > k + 1)
    least = values.join(counts, ["model", "h"], "left_semi").withColumn("r", F.row_number().over(Window.partitionBy("model", "h").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    least = stage(least, "copies")
    crowd = values.join(least.select("model", "h").distinct(), ["model", "h"], "left_semi").join(least, ["model", "vec_id"], "left_anti")
    crowd = stage(crowd, "crowd")
    crowded = crowd.limit(1).count() > 0
    kept = vectors.join(crowd.select("model", "vec_id"), ["model", "vec_id"], "left_anti") if crowded else vectors

    sizes = {r["model"]: r["n"] for r in values.groupBy("model").agg(F.countDistinct("vec_id").alias("n")).collect()}  # a row a known model
    directions = values.groupBy("model", "h").agg(F.min("vec_id").alias("vec_id")).withColumn("o", F.xxhash64("h"))  # copies have one row
    trees, held = {}, {}
    for model, n in sizes.items():
        picked = directions.filter(F.col("model") == model)
        if n > SAMPLE_ROWS:
            cut = picked.select("o").orderBy("o").limit(SAMPLE_ROWS).agg(F.max("o").alias("o")).first()["o"]
            picked = picked.filter(F.col("o") <= cut)
        rows = vectors.join(F.broadcast(picked.select("model", "vec_id", "h")), ["model", "vec_id", "h"]).select("h", "vec").toArrow()  # at most SAMPLE_ROWS directions, REPEATS rows each
        hashes, first = np.unique(rows["h"].to_numpy(), return_index=True)
        x = _matrix(rows["vec"].take(pa.array(first)).to_pylist())
        tree, apart = fit_tree(x, n)
        trees[model] = (tree, tree.n_leaves)
        if tree.n_leaves > 1 and apart.size:
            held[model] = (tree, x[apart], hashes[apart])
    if held:
        rows = true_neighbours(vectors, held, k).select("model", "query", "leaf").toArrow()  # at most k a held query
        for model, (tree, queries, _) in held.items():
            own = rows.filter(pc.equal(rows["model"], model))
            trees[model] = (tree, enough_visits(tree, queries, own["query"].to_numpy(), own["leaf"].to_numpy(), recall))

    routes = _routes(stage(_coded(kept, trees), "codes"), k)
    routes = stage(routes.groupBy("model", "vec_id", "h").agg(F.collect_list(F.struct("leaf", "sub", "part", "base", "asks")).alias("to")), "routes")  # at most a place a leaf visited, a few for a base
    filed = kept.join(broadcast_if_small(routes, 1_000_000), ["model", "vec_id", "h"]).withColumn("to", F.explode("to")).select("model", "vec_id", "vec", "to.*")

    def meet(rows: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_leaf_neighbours(rows.filter(rows["base"]), rows.filter(rows["asks"]), k)])

    near = filed.select("model", "leaf", "sub", "part", "vec_id", "vec", "base", "asks").groupBy("model", "leaf", "sub", "part").applyInArrow(meet, _NEAR)
    if crowded:  # the least ids of one's own value are nearer than all else
        copies = least.select("model", "h", F.col("vec_id").alias("other"), "r").filter(F.col("r") <= k)
        near = near.unionByName(crowd.join(copies, ["model", "h"]).select("model", "vec_id", "other", F.lit(1.0).alias("cosine")))
    w = Window.partitionBy("model", "vec_id").orderBy(F.col("cosine").desc(), "other")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def neighbour_pairs(nearest: DataFrame) -> DataFrame:
    """(vec_id_a, vec_id_b) with the smaller id first, each pair once."""
    return nearest.select(F.least("vec_id", "other").alias("vec_id_a"), F.greatest("vec_id", "other").alias("vec_id_b")).distinct()
