"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors are rotated and cut into BLOCKS blocks. If two vectors lie within squared distance D,
then in at least one block they lie within their share of D, which is in proportion to the block's
dimensions. So each block is range-joined under its share alone, the union of what the blocks admit
are the candidates, and each candidate is verified by its cosine in double precision.

The vectors of a label are dealt into tiles, and every two tiles meet once, in one task; pairs are
counted and joined there and never leave it. In a task each block is joined by a sweep: rows are
sorted along the direction in which the block spreads most, a strip of them meets the window of rows
that its share reaches, and the block's distance decides. A vector goes to as many tasks as its
label has tiles. At a cosine of 0.93 a block's share is about as wide as the block itself, so a window
leaves out only a quarter to a half of the rows, and the block's distances tell candidates from others: the
candidates that are verified are few, the distances in blocks grow with the square of a label (see
the README).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .op06_minhash import _groups, _roots

BLOCKS = 4
#: Vectors of a tile, of a part of it that is joined at a time, and of a strip of the part that sweeps over the other tile.
TILE, PART, STRIP = 2048, 1024, 128


def rotation(dims: int, seed: int = 8) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dims])).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _cut(dims: int, blocks: int) -> list[tuple[int, int]]:
    edge = [dims * k // blocks for k in range(blocks + 1)]
    return [(a, b) for a, b in zip(edge[:-1], edge[1:], strict=True) if b > a]


def _budgets(dims: int, blocks: int, cosine: float) -> np.ndarray:
    """Squared distance of each block, in proportion to its dimensions, and a little for single precision."""
    return np.array([(2 - 2 * cosine) * (b - a) / dims + 1e-5 for a, b in _cut(dims, blocks)])


def _unit(vectors: list) -> list[np.ndarray | None]:
    """The vectors in double precision, scaled by their largest component; None for what can't be compared."""
    out: list[np.ndarray | None] = []
    for v in vectors:
        x = None if v is None or not len(v) or any(c is None for c in v) else np.array(v, np.float64)
        top = 0.0 if x is None or not np.isfinite(x).all() else float(np.abs(x).max())
        out.append(None if top == 0.0 else x / top)
    return out


def _bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """rep, dims and bytes of each vector; dims 0 marks one that can't be compared."""
    for batch in batches:
        scaled = _unit(batch.column(1).to_pylist())
        dims = [0 if x is None else len(x) for x in scaled]
        vec = [b"" if x is None else x.tobytes() for x in scaled]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(dims, pa.int32()), pa.array(vec, pa.binary())], ["rep", "dims", "vec"])


_known: dict[int, np.ndarray] = {}


def _rotations(dims: int) -> np.ndarray:
    if dims not in _known:
        _known[dims] = rotation(dims)
    return _known[dims]


def _within(a: np.ndarray, b: np.ndarray, share: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Range join of one block: the pairs of rows of a and b within squared distance `share`, as numbers of rows."""
    both = np.concatenate([a, b])
    spread = np.linalg.eigh(np.cov(both, rowvar=False).reshape(a.shape[1], -1))[1][:, -1]
    reach = np.sqrt(share)
    at, to = a @ spread, b @ spread
    rows, cols = np.argsort(at), np.argsort(to)
    at, to = at[rows], to[cols]
    # distances as one product: (x, |x|^2, 1) by (-2 y, 1, |y|^2)
    x = np.column_stack([a, (a * a).sum(1), np.ones(len(a))])[rows].astype(np.float32)
    y = np.column_stack([-2 * b, np.ones(len(b)), (b * b).sum(1)])[cols].astype(np.float32).T
    room, limit = np.empty(STRIP * len(cols), np.float32), np.float32(share)
    first, second = [], []
    for lo in range(0, len(rows), STRIP):
        hi = min(lo + STRIP, len(rows))
        left, right = np.searchsorted(to, at[lo] - reach), np.searchsorted(to, at[hi - 1] + reach, "right")
        if left == right:
            continue
        far = np.matmul(x[lo:hi], y[:, left:right], out=room[: (hi - lo) * (right - left)].reshape(hi - lo, -1))
        hit = np.flatnonzero(far.ravel() <= limit)
        if len(hit):
            first.append(rows[lo + hit // (right - left)])
            second.append(cols[left + hit % (right - left)])
    return first, second


def candidates(turned: np.ndarray, x: np.ndarray, y: np.ndarray, cosine: float, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """The union of the pairs of rows of x and y (numbers of rows of turned) that lie within a block's share in that block, each once."""
    codes = [np.zeros(0, np.int64)]
    for (lo, hi), share in zip(_cut(turned.shape[1], blocks), _budgets(turned.shape[1], blocks, cosine), strict=True):
        for i, j in zip(*_within(turned[x, lo:hi], turned[y, lo:hi], share), strict=True):
            codes.append(i * len(y) + j)
    met = np.unique(np.concatenate(codes))
    return x[met // len(y)], y[met % len(y)]


def _join(cosine: float, blocks: int):
    """Links of one bucket of tile pairs: (rep, links, root), links weighted by copies."""

    def run(table: pa.Table) -> pa.Table:
        rep, copies, own = (table.column(c).to_numpy() for c in ("rep", "copies", "own"))
        dims, vec = table.column("dims").to_numpy(), table.column("vec").to_pylist()
        out: list[tuple[np.ndarray, ...]] = []
        for g in _groups(table, "key"):
            raw = np.frombuffer(b"".join(vec[k] for k in g), np.float64).reshape(len(g), int(dims[g[0]]))
            raw = raw / np.linalg.norm(raw, axis=1)[:, None]
            turned = raw @ _rotations(raw.shape[1])
            tile = own[g]
            first, second = np.flatnonzero(tile == tile.min()), np.flatnonzero(tile == tile.max())
            links, pairs = np.zeros(len(g), np.int64), [np.zeros((0, 2), np.int64)]
            for lo in range(0, len(first), PART):
                i, j = candidates(turned, first[lo : lo + PART], second, cosine, blocks)
                if tile.min() == tile.max():
                    i, j = i[i < j], j[i < j]
                fine = np.ones(len(i), bool)
                for k in range(0, len(i), TILE):
                    fine[k : k + TILE] = np.einsum("ij,ij->i", raw[i[k : k + TILE]], raw[j[k : k + TILE]]) >= cosine
                i, j = i[fine], j[fine]
                np.add.at(links, i, copies[g[j]])
                np.add.at(links, j, copies[g[i]])
                pairs.append(np.stack([i, j], 1))
            found = np.concatenate(pairs)
            if len(found):
                root = _roots(len(g), found)
                least = np.full(len(g), np.iinfo(np.int64).max)
                np.minimum.at(least, root, rep[g])
                on = np.unique(found)
                out.append((rep[g[on]], links[on], least[root[on]]))
        names = ("rep", "links", "root")
        return pa.table({n: np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64) for k, n in enumerate(names)})

    return run


@common.settled
def near_vectors(vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", blocks: int = BLOCKS) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Rows are linked if their labels are equal and not null, their vectors have as many components
    and their cosine is `cosine` or more. Vectors that are null, empty or zero or hold null or
    non-finite components, and rows without a label, link with nothing. n_links counts the other
    rows linked with a row directly, rows that repeat it too. Vectors are scaled by their largest
    component first, so finite ones of any size take part. Rows with a null id take part like any
    others. An empty table gives an empty result; other columns are not read.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = common.store(rows, "vectors")
    # equal vectors of a label are one class; v is null or holds no null past this point
    able = rows.filter("label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    reps = able.groupBy("label", "v").agg(F.min("vec_id").alias("rep0"), F.count("*").alias("copies"))
    # an id that repeats with different vectors stands for several classes, so classes have numbers of their own
    reps = common.store(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")
    common.bounded_batches(vectors.sparkSession)
    able_ = reps.select("rep", "v").mapInArrow(_bytes, "rep long, dims int, vec binary")
    unit = common.store(able_.join(reps.select("rep", "label", "copies"), "rep"), "unit")
    fit = unit.filter("dims > 0")
    size = fit.groupBy("label", "dims").agg(F.count("*").alias("c"))
    size = common.store(size.withColumn("tiles", F.ceil(F.col("c") / TILE).cast("int")), "sizes")
    total = fit.count()
    placed = common.skew_join(fit, size, ["label", "dims"], "c", total)
    placed = placed.withColumn("own", F.pmod(F.xxhash64(F.lit(8), "rep"), F.col("tiles")).cast("int"))
    # every two tiles meet once, a tile also by itself
    e = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other"))
    e = e.select(F.xxhash64("label", "dims", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "rep", "copies", "own", "dims", "vec")
    rows_met = size.agg(F.sum(F.col("c") * F.col("tiles"))).first()[0] or 0
    dealt = e.withColumn("bucket", F.pmod("key", F.lit(common.buckets(rows_met, TILE))))
    met = dealt.groupBy("bucket").applyInArrow(lambda t: _join(cosine, blocks)(t), "rep long, links long, root long")
    met = common.store(met, "met")
    links = met.groupBy("rep").agg(F.sum("links").alias("links"))
    ids = reps.select("rep", "rep0")
    stars = met.select("rep", "root").filter("rep != root").distinct().join(ids, "rep").select("root", F.col("rep0").alias("a"))
    stars = stars.join(ids.select(F.col("rep").alias("root"), F.col("rep0").alias("b")), "root").select("a", "b")
    part = common.components(stars).withColumnRenamed("node", "rep0")
    usable = fit.select("rep", F.lit(True).alias("usable"))
    known = reps.join(links, "rep", "left").join(usable, "rep", "left").join(part, "rep0", "left")
    alone = F.col("usable").isNull()
    known = known.select(
        "label", "v", "copies",
        F.when(~alone, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.when(~alone, F.coalesce("component", "rep0")).alias("component_id"),
    )
    known = common.store(known, "known")
    got = common.skew_join(able, known.withColumn("k", F.col("copies")).drop("copies"), ["label", "v"], "k", rows.count())
    got = got.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    unable = rows.filter("not coalesce(label is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null), false)")
    out = got.unionByName(unable.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
