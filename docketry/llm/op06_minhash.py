"""MinHash near-dedup: minwise trees, and an exact prefix join where they leave large nodes.

1. Every document becomes a set of shingle hashes. The hashes are dealt into SKETCH ranges, and the
   least one of each range is a minwise token; a set's tokens agree with another's in about as large
   a share of the ranges as the sets' similarity. Documents with the same digest are one class with
   one representative.
2. Trees: each deals the representatives out to nodes by one minwise token, taken by an order of the
   ranges of its own. Small nodes are compared exhaustively, by sketches or, where both sets are
   small, exactly. The documents of a large node are dealt into tiles that the node's pivot, one of
   its documents, is in, which finds large groups of near copies. Independent trees are repeated to
   the target recall.
3. The pairs that the trees propose make families; a family's documents meet, with their whole
   sets, in one task and are linked by exact similarity. A family too large for one task is cut
   into tiles that share a pivot; where that leaves documents of a node apart, the node's documents
   meet with their whole sets, so the cuts lose no pair that the trees proposed.
4. Large nodes that still hold several parts are joined exactly, by prefixes of whole sets. In one
   order of all shingles, frequent ones last, two sets as alike as the threshold share one of the
   first few of each. So the documents of different parts that share such a shingle are paired,
   however many have it: long lists are cut into tiles so that every pair meets in one. Pairs whose
   places in the order rule them out aren't made. Pairs are confirmed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .shingles import batches_of, shingle_sets

#: Ranges of hashes of a sketch.
SKETCH = 128
#: Independent trees. A node, or a list of documents with a shingle, of up to NODE documents is compared in one piece.
TREES, NODE = 10, 128
#: At most so many shingles count as frequent and come last, by their counts; the order decides what the join costs, not what it finds.
FREQUENT = 1 << 17
#: Pairs whose sketches estimate a similarity of threshold - MARGIN are checked exactly.
MARGIN = 0.18
#: Sets up to this size are compared exactly wherever sketches would be: in small sets, shingles that fall in one range count for much.
FEW = 21
#: Documents, and shingles, of a family that one task holds; rows of a group of nodes and of texts that one call takes, about.
FAMILY, FAMILY_SHINGLES, NODES_AT_ONCE, TEXTS_AT_ONCE = 512, 2_000_000, 1024, 512
#: Pairs whose sketches are compared at once.
_PAIRS = 1 << 15
#: Each tree's order of the ranges.
_ORDER = np.stack([np.random.Generator(np.random.PCG64([6, t])).permutation(SKETCH) for t in range(64)])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n_shingles, digest of the set, its trees' tokens, its sketch and, of a small set, 32 bits of each hash."""
    for batch in batches:
        for lo, n, data, offsets in batches_of(batch.column(1)):
            h, at = shingle_sets(data, offsets)
            size = np.diff(at)
            some = size > 0
            # sets are sorted, so a range's least member is its first
            doc, bucket = np.repeat(np.arange(n), size), (h >> np.uint64(57)).astype(np.int64)
            lead = np.ones(len(h), bool)
            lead[1:] = (doc[1:] != doc[:-1]) | (bucket[1:] != bucket[:-1])
            least = np.zeros((n, SKETCH), np.uint32)
            least[doc[lead], bucket[lead]] = np.maximum(h[lead] & np.uint64(0xFFFFFFFF), 1).astype(np.uint32)
            sketch = np.zeros((n, SKETCH), np.uint8)
            sketch[doc[lead], bucket[lead]] = 1 + (h[lead] & np.uint64(0xFFFF)) % np.uint64(255)
            roots, rows = np.zeros((n, TREES), np.int64), np.arange(n)
            for t in range(TREES):
                # the first range of the tree's order in which the set has a hash
                first = _ORDER[t][(least[:, _ORDER[t]] > 0).argmax(1)]
                roots[:, t] = np.where(some, first << 32 | least[rows, first].astype(np.int64), 0)
            ends = list(zip(at[:-1].tolist(), at[1:].tolist(), strict=True))
            digest = [xxhash.xxh3_128_digest(h[a:b].tobytes()) for a, b in ends]
            low = (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
            few = [low[a:b].tobytes() if b - a <= FEW else b"" for a, b in ends]
            cols = [
                batch.column(0).slice(lo, n), pa.array(size), pa.array(digest, pa.binary()),
                pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * TREES, pa.array(roots.ravel())),
                pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array(few, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "digest", "roots", "sketch", "few"])


def _estimates(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Similarity estimates of all pairs, (len(a), len(b)); 0 where sizes alone rule a pair out."""
    out = np.empty((len(a), len(b)), np.float32)
    for k in range(len(a)):
        same = ((b == a[k]) & (b > 0)).sum(1)
        any_ = ((b > 0) | (a[k] > 0)).sum(1)
        out[k] = same / np.maximum(any_, 1)
    ratio = np.minimum(na[:, None], nb[None, :]) * 100 >= np.maximum(na[:, None], nb[None, :]) * round(100 * least)
    out[~ratio] = 0
    return out


def _decide_few(e: np.ndarray, rows: np.ndarray, sets: list[np.ndarray], n: np.ndarray, percent: int) -> None:
    """Put the similarity, or 0 below the threshold, in place of the estimates e (rows x all) of pairs of small sets."""
    small = np.flatnonzero(n <= FEW)
    if len(small) < 2:
        return
    size = np.array([len(sets[k]) for k in small])
    value = np.unique(np.concatenate([sets[k] for k in small]), return_inverse=True)[1]
    holders = np.split(np.repeat(np.arange(len(small)), size)[np.argsort(value, kind="stable")], np.cumsum(np.bincount(value))[:-1])
    own = dict(zip(small.tolist(), np.split(value, np.cumsum(size)[:-1]), strict=True))
    for row, k in enumerate(rows.tolist()):
        if k in own:
            both = np.bincount(np.concatenate([holders[v] for v in own[k]]), minlength=len(small))
            any_ = np.maximum(n[k] + n[small] - both, 1)
            e[row, small] = np.where(100 * both >= percent * any_, both / any_, 0)


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index that each of n items reaches over the pairs."""
    root = np.arange(n)
    while len(pairs):
        low = np.minimum(root[pairs[:, 0]], root[pairs[:, 1]])
        new = root.copy()
        np.minimum.at(new, root[pairs[:, 0]], low)
        np.minimum.at(new, root[pairs[:, 1]], low)
        while (new[new] != new).any():
            new = new[new]
        new = new[root]
        if (new == root).all():
            break
        root = new
    return root


def _groups(table: pa.Table, key: str):
    """Rows of each key, as index arrays, of one bucket's table."""
    k = table.column(key).to_numpy()
    order = np.argsort(k, kind="stable")
    cut = np.flatnonzero(np.diff(k[order])) + 1
    return np.split(order, cut) if len(order) else []


def _pairs_of(groups: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within each group, a bounded number at a time, groups of one size together."""
    size = np.array([len(g) for g in groups])
    for c in np.unique(size[size > 1]).tolist():
        own = np.stack([groups[k] for k in np.flatnonzero(size == c)])
        x, y = np.triu_indices(c, 1)
        each = max(1, _PAIRS // len(x))
        for lo in range(0, len(own), each):
            yield own[lo : lo + each][:, x].ravel(), own[lo : lo + each][:, y].ravel()


def _alike(table: pa.Table, threshold: float, wanted=lambda x, y: True) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Wanted pairs of rows of a bucket's nodes that sizes and sketches, or small sets themselves, let through."""
    percent, n = round(100 * threshold), table.column("n").to_numpy()
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
    few = table.column("few").to_pylist()
    for x, y in _pairs_of(_groups(table, "key")):
        # sizes alone rule many pairs out
        fit = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
        fit &= wanted(x, y)
        x, y = x[fit], y[fit]
        a, b = sketch[x], sketch[y]
        same, any_ = ((a == b) & (a > 0)).sum(1), ((a > 0) | (b > 0)).sum(1)
        fine = same >= (threshold - MARGIN) * any_
        for k in np.flatnonzero((n[x] <= FEW) & (n[y] <= FEW)).tolist():
            both = len(np.intersect1d(np.frombuffer(few[x[k]], np.uint32), np.frombuffer(few[y[k]], np.uint32)))
            fine[k] = 100 * both >= percent * (int(n[x[k]] + n[y[k]]) - both)
        yield x[fine], y[fine]


def _propose(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        ids, own = np.unique(table.column("rep").to_numpy(), return_inverse=True)
        found = [np.zeros((0, 2), np.int64)] + [np.stack([own[x], own[y]], 1) for x, y in _alike(table, threshold)]
        # a star for each part that holds together: the pairs themselves aren't needed
        root = _roots(len(ids), np.concatenate(found))
        moved = root != np.arange(len(ids))
        return pa.table({"a": ids[moved], "b": ids[root[moved]]})

    return run


def _across(threshold: float):
    """Members (hub, rep, inside) of one bucket of lists: for any two documents of different parts that may be alike, the larger part and both of them."""

    def run(table: pa.Table) -> pa.Table:
        rep, comp, c, rich = (table.column(x).to_numpy(zero_copy_only=False) for x in ("rep", "comp", "c", "rich"))
        found = [np.zeros((0, 3), np.int64)]
        for x, y in _alike(table, threshold, lambda x, y: (comp[x] != comp[y]) & (rich[x] | rich[y])):
            swap = (c[y] > c[x]) | ((c[y] == c[x]) & (comp[y] < comp[x]))
            x, y = np.where(swap, y, x), np.where(swap, x, y)
            for z, inside in ((x, 1), (y, 0)):
                found.append(np.unique(np.stack([comp[x], rep[z], np.full(len(z), inside)], 1), axis=0))
        rows = np.unique(np.concatenate(found), axis=0)
        return pa.table({"hub": rows[:, 0], "rep": rows[:, 1], "inside": rows[:, 2] > 0})

    return run


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """h, c: the shingles that a slice of texts has in more than one set, counted."""
    for batch in batches:
        for _, _, data, offsets in batches_of(batch.column(2), common.BATCH_BYTES):
            h, c = np.unique(shingle_sets(data, offsets)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h[c > 1].view(np.int64)), pa.array(c[c > 1])], ["h", "c"])


def _prefixes(percent: int, often: np.ndarray, count: np.ndarray):
    """h, rep, comp, rich: the first shingles of each set, one of which any set as alike as `percent` has among its first ones too.

    `often` are the frequent shingles, sorted, which come last by their count. A set of n shingles
    shares percent * n / 100 at least, so the first of them in the order has no more than the rest before it. It is
    `rich` if so much follows that the other set may be as large: two sets are alike only if one is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, comp = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for lo, n, data, offsets in batches_of(batch.column(2), common.BATCH_BYTES):
                h, at = shingle_sets(data, offsets)
                size, h = np.diff(at), h.view(np.int64)
                doc, all_ = np.repeat(np.arange(n), size), np.repeat(size, size)
                if len(often):
                    k = np.minimum(np.searchsorted(often, h), len(often) - 1)
                    h = h[np.lexsort((np.where(often[k] == h, count[k], 0), doc))]
                left = all_ - (np.arange(len(h)) - np.repeat(at[:-1], size))
                first = 100 * left >= percent * all_
                rich = (100 + percent) * left >= 2 * percent * all_
                doc = lo + doc[first]
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(rep[doc]), pa.array(comp[doc]), pa.array(rich[first])], ["h", "rep", "comp", "rich"])

    return run


def _exact(threshold: float):
    """What one bucket of tiles connects: (a, b), each linked document and the least of those it hangs together with."""
    percent = round(100 * threshold)

    def run(table: pa.Table) -> pa.Table:
        rep, comp = table.column("rep").to_numpy(), table.column("comp").to_numpy()
        sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        text = table.column("text").combine_chunks()
        a, b = [], []
        for g in _groups(table, "key"):
            if len(g) < 2:
                continue
            sets: list[np.ndarray] = []
            for _, m, data, offsets in batches_of(text.take(pa.array(g))):
                h, at = shingle_sets(data, offsets)
                sets += [h[at[k] : at[k + 1]] for k in range(m)]
            n = np.array([len(s) for s in sets])
            number = np.unique(np.concatenate(sets), return_inverse=True)[1]
            ids = np.split(number, np.cumsum(n)[:-1])
            mark = np.zeros(int(number.max()) + 1, bool)
            e = _estimates(sketch[g], n, sketch[g], n, threshold)
            e[e < threshold - MARGIN] = 0
            _decide_few(e, np.arange(len(g)), sets, n, percent)
            # rows of one document, and documents known to hang together, need no check
            _, root = np.unique(comp[g], return_inverse=True)
            each = 1
            while True:
                e[root[:, None] == root[None, :]] = 0
                live = np.flatnonzero(e.max(1) > 0)
                if not len(live):
                    break
                # the likeliest pairs first, more of them each time
                k = min(each, len(g))
                best = np.argpartition(e[live], len(g) - k, axis=1)[:, len(g) - k :]
                x, y = np.repeat(live, k), best.ravel()
                x, y = x[e[x, y] > 0], y[e[x, y] > 0]
                pairs = np.unique(np.sort(np.stack([x, y], 1), axis=1), axis=0)
                fine, last = [], -1
                for x, y in pairs.tolist():
                    if x != last:
                        if last >= 0:
                            mark[ids[last]] = False
                        mark[ids[x]] = True
                        last = x
                    both = int(mark[ids[y]].sum())
                    if 100 * both >= percent * (int(n[x] + n[y]) - both):
                        fine.append((x, y))
                mark[ids[last]] = False
                e[pairs[:, 0], pairs[:, 1]] = e[pairs[:, 1], pairs[:, 0]] = 0
                each *= 2
                if fine:
                    # joined documents take one number
                    root = _roots(int(root.max()) + 1, root[np.array(fine)])[root]
            # a star for each part that holds together: the links themselves aren't needed
            least = np.full(int(root.max()) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, root, rep[g])
            a.append(rep[g])
            b.append(least[root])
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        moved = cat(a) != cat(b)
        return pa.table({"a": cat(a)[moved], "b": cat(b)[moved]})

    return run


def _nodes(reps: DataFrame, total: int) -> tuple[DataFrame, DataFrame]:
    """Members (key, rep) of all nodes to compare exhaustively and of the tiles of larger ones; members of the larger ones."""
    root = reps.select("rep", F.posexplode("roots").alias("tree", "token"))
    level = common.store(root.select(F.xxhash64(F.lit(0), "tree", "token").alias("key"), "rep"), "level")
    size = level.groupBy("key").agg(F.count("*").alias("c"), F.min("rep").alias("pivot")).filter("c > 1")
    size = common.store(size.withColumn("k", F.col("c")), "sizes")
    met = common.store(common.skew_join(level, size, ["key"], "k", total * TREES), "met")
    # a node of NODE documents or less is one tile; the pivot is in every tile
    tiles = F.ceil(F.col("c") / NODE).cast("int")
    tile = F.when(F.col("rep") == F.col("pivot"), F.sequence(F.lit(0), tiles - 1)).otherwise(F.array(F.pmod(F.xxhash64("key", "rep"), tiles).cast("int")))
    nodes = met.select("key", "rep", F.explode(tile).alias("tile")).select(F.xxhash64("key", "tile").alias("key"), "rep")
    return nodes, met.filter(F.col("c") > NODE).select("key", "rep")


@common.settled
def near_groups(docs: DataFrame, threshold: float = 0.75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked if their shingle sets' intersection is `threshold` of the union or
    more; components are what links connect. Null, empty and wordless texts have n_shingles 0 and
    stand alone. Rows that repeat an id take part alike. Each row with a null id takes part as a
    document of its own that comes after all ids: its component_id is the least id of its component,
    or null if that has no id at all, and then one row of the component is kept. Texts of any length take part with
    all their shingles. A pair may be missed only if no tree has it in one node, or if its sketches differ by far more than
    its sets do; README has figures. An empty table gives an empty result.
    """
    common.bounded_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    source, own_id = common.with_ids(source)
    schema = "doc_id long, n_shingles long, digest binary, roots array<long>, sketch binary, few binary"
    signed = common.store(source.mapInArrow(_signed, schema), "signed")
    some = signed.filter("n_shingles > 0")
    # equal sets are one class; its least id stands for it
    classes = some.groupBy("digest").agg(
        F.min(F.struct("doc_id", "n_shingles", "roots", "sketch", "few")).alias("r"), F.count("*").alias("copies")
    )
    reps = common.store(
        classes.select("digest", "copies", F.col("r.doc_id").alias("rep"), F.col("r.n_shingles").alias("n"), "r.roots", "r.sketch", "r.few"), "reps"
    )
    total = reps.count()
    nodes, large = _nodes(reps, total)
    nodes = common.store(nodes, "nodes")
    dealt = nodes.join(reps.select("rep", "n", "sketch", "few"), "rep").withColumn("bucket", F.pmod("key", F.lit(common.buckets(nodes.count(), NODES_AT_ONCE))))
    proposed = common.store(dealt.groupBy("bucket").applyInArrow(lambda t: _propose(threshold)(t), "a long, b long").distinct(), "proposed")
    family = common.store(common.components(proposed), "family")
    links = _confirm(source, reps, nodes, large, family, threshold, total)
    found = common.components(links).withColumnRenamed("node", "rep")
    ids = reps.select("digest", "rep", "copies").join(found, "rep", "left")
    ids = common.store(ids.select("digest", F.coalesce("component", "rep").alias("component_id"), "copies"), "ids")
    alone = signed.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = common.skew_join(some.select("doc_id", "n_shingles", "digest"), ids, ["digest"], "copies", signed.count())
    out = linked.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    out = out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    return out.withColumns({c: own_id(F.col(c)) for c in ("doc_id", "component_id")})


def _confirm(source: DataFrame, reps: DataFrame, nodes: DataFrame, large: DataFrame, family: DataFrame, threshold: float, total: int) -> DataFrame:
    """Exact links (a, b) within families and large nodes: enough of them to connect what is connected."""
    sized = family.join(reps.select("rep", "n", "sketch"), family["node"] == reps["rep"]).select("rep", "component", "n", "sketch")
    sized = common.store(sized, "sized")
    size = sized.groupBy("component").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    tiles = F.greatest(F.ceil(F.col("c") / FAMILY), F.ceil(F.col("w") / FAMILY_SHINGLES), F.lit(1)).cast("int")
    size = common.store(size.withColumn("tiles", tiles), "families")
    member = common.skew_join(sized, size.select("component", "tiles", "c"), ["component"], "c", total)
    member = member.withColumn("own", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64(F.lit(7), "rep"), F.col("tiles"))).otherwise(F.lit(0)).cast("int"))
    # the pivot, which gives the family its number, is in every tile
    at = F.when(F.col("rep") == F.col("component"), F.sequence(F.lit(0), F.col("tiles") - 1)).otherwise(F.array("own"))
    member = common.store(member.select("rep", "component", "n", "sketch", "tiles", "own", F.explode(at).alias("tile")), "members")
    # texts move once, by the same plan at every size
    wanted = member.select(F.col("rep").alias("doc_id")).unionByName(large.select(F.col("rep").alias("doc_id"))).distinct().hint("merge")
    held = source.join(wanted, "doc_id", "left_semi")
    # a repeated id may have several texts; the representative's is the one with its set
    text = held.groupBy("doc_id").agg(F.collect_set("text").alias("texts"))
    text = _own_text(text, reps)
    text = common.store(text, "texts")

    def check(rows: DataFrame) -> DataFrame:
        per = common.buckets(rows.count(), TEXTS_AT_ONCE)
        rows = rows.join(text, "rep").withColumn("bucket", F.pmod("key", F.lit(per)))
        return common.store(rows.groupBy("bucket").applyInArrow(lambda t: _exact(threshold)(t), "a long, b long"), "links")

    key = F.xxhash64("component", "tile").alias("key")
    links = check(member.select(key, "rep", F.col("rep").alias("comp"), "sketch"))
    split = member.filter("tiles > 1")
    if split.take(1):
        # Large families: every pair that the trees proposed is in a node, so the nodes that still hold several parts are checked.
        split = _parts(split.select("rep", "sketch").dropDuplicates(["rep"]), links)
        within = common.store(nodes.join(split, "rep"), "within")
        mixed = within.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x != y").select("key")
        rows = within.join(mixed, "key", "left_semi").select("key", "rep", "comp", "sketch")
        links = links.unionByName(check(common.store(rows, "mixed")))
    # Large nodes that still hold several parts: the pairs of theirs that the trees have not proposed.
    apart = _apart(large, _parts(large.select("rep").distinct(), links), total * TREES)
    if not apart.take(1):
        return links
    own = common.store(apart.select("rep", "comp").distinct(), "own")
    hubs = _sharing(own, text, reps, threshold).distinct()
    return links.unionByName(check(_hubs(common.store(hubs, "hubs"), own, reps)))


def _parts(reps: DataFrame, links: DataFrame) -> DataFrame:
    """reps with comp, the part that the links put each into."""
    part = common.components(links).select(F.col("node").alias("rep"), F.col("component").alias("part"))
    return reps.join(part, "rep", "left").withColumn("comp", F.coalesce("part", "rep")).drop("part")


def _apart(large: DataFrame, parts: DataFrame, rows: int) -> DataFrame:
    """(key, rep, comp) of the large nodes that hold several parts."""
    held = common.store(large.join(parts, "rep"), "held")
    mixed = held.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("k")).filter("x != y")
    return common.store(common.skew_join(held, mixed.select("key", "k"), ["key"], "k", rows), "apart")


def _sharing(own: DataFrame, text: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Members (hub, rep, inside), as _across gives them, of documents that share a shingle among the first ones of both, and may be alike by sizes and sketches.

    Lists with the same documents are compared once; those of more than NODE documents in tiles.
    """
    percent = round(100 * threshold)
    sets = own.join(text, "rep").select("rep", "comp", "text")
    limit = max(NODE, (own.join(reps.select("rep", "n"), "rep").agg(F.sum("n")).first()[0] or 0) // FREQUENT)
    often = sets.mapInArrow(_counted, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).filter(F.col("c") > limit)
    often = often.toArrow().sort_by("h")
    first = _prefixes(percent, often.column("h").to_numpy(), often.column("c").to_numpy())
    rows = common.store(sets.mapInArrow(first, "h long, rep long, comp long, rich boolean"), "prefixes")
    size = rows.groupBy("h").agg(F.count("*").alias("k"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.bool_or("rich").alias("some"))
    size = common.store(size.filter("x != y and some").select("h", "k", F.col("k").alias("c")), "shared")
    met = common.store(common.skew_join(rows, size, ["h"], "k", rows.count()), "shares")
    lists = met.filter(F.col("c") <= NODE).groupBy("h").agg(F.sort_array(F.collect_list(F.struct("rep", "comp", "rich"))).alias("l"))
    lists = lists.groupBy("l").agg(F.min("h").alias("key")).select("key", F.inline("l"))
    met = common.store(lists.unionByName(_tiled(met.filter(F.col("c") > NODE).drop("c"))), "lists")
    part = own.groupBy("comp").agg(F.count("*").alias("c"))
    known = own.join(part, "comp").select("rep", "c").join(reps.select("rep", "n", "sketch", "few"), "rep")
    met = met.join(known, "rep").withColumn("bucket", F.pmod("key", F.lit(common.buckets(met.count(), NODES_AT_ONCE))))
    return met.groupBy("bucket").applyInArrow(lambda t: _across(threshold)(t), "hub long, rep long, inside boolean")


def _tiled(rows: DataFrame) -> DataFrame:
    """(key, rep, comp, rich): long lists cut into tiles in which any two rows of different parts meet, one of which is rich.

    Most of a long list may be one part, whose rows needn't meet each other: rich rows of other parts
    meet all rows, and rich rows of the largest part meet the other parts' rows that aren't rich.
    """
    part = rows.groupBy("h", "comp").agg(F.count("*").alias("c"), F.count_if("rich").alias("r"))
    part = part.groupBy("h").agg(F.max(F.struct("c", "comp", "r")).alias("m"), F.sum("c").alias("k"), F.sum("r").alias("r"))
    tiles = lambda c: F.ceil(c / NODE).cast("int")
    few, most, main = F.col("r") - F.col("m.r"), F.col("m.r"), F.col("m.comp").alias("main")
    poor = F.col("k") - F.col("r") - F.col("m.c") + F.col("m.r")
    part = part.select("h", "k", main, tiles(few).alias("few"), tiles(F.col("k")).alias("all"), tiles(most).alias("most"), tiles(poor).alias("poor"))
    met = common.skew_join(rows, common.store(part, "long"), ["h"], "k", rows.count())
    other = F.col("comp") != F.col("main")
    own = lambda n: F.pmod(F.xxhash64("h", "rep"), F.greatest(F.col(n), F.lit(1))).cast("int")
    upto = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    at = lambda grid, x, y: F.struct(F.lit(grid).alias("grid"), x.alias("x"), y.alias("y"))
    across = lambda n, grid, f: F.transform(upto(n), lambda t: at(grid, *f(t)))
    none = F.array().cast("array<struct<grid:int,x:int,y:int>>")
    column = across("few", 0, lambda t: (t, own("all")))
    row = F.when(other & F.col("rich"), across("all", 0, lambda t: (own("few"), t))).otherwise(none)
    rest = F.when(~other & F.col("rich"), across("poor", 1, lambda t: (own("most"), t))).when(other & ~F.col("rich"), across("most", 1, lambda t: (t, own("poor")))).otherwise(none)
    out = met.select("h", "rep", "comp", "rich", F.explode(F.array_distinct(F.concat(column, row, rest))).alias("t"))
    return out.select(F.xxhash64("h", "t.grid", "t.x", "t.y").alias("key"), "rep", "comp", "rich")


def _hubs(rows: DataFrame, own: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, rep, comp, sketch): tiles in which each hub's own documents meet the others that may be alike to one of them."""
    size = rows.groupBy("hub").agg(F.count_if("inside").alias("x"), F.count_if(~F.col("inside")).alias("y"), F.count("*").alias("k"))
    tiles = lambda c: F.ceil(F.col(c) * 2 / FAMILY).cast("int")
    size = common.store(size.select("hub", tiles("x").alias("x"), tiles("y").alias("y"), "k"), "hub_sizes")
    met = common.skew_join(rows, size, ["hub"], "k", rows.count())
    mine = F.pmod(F.xxhash64("hub", "rep"), F.when(F.col("inside"), F.col("x")).otherwise(F.col("y"))).cast("int")
    other = F.sequence(F.lit(0), F.when(F.col("inside"), F.col("y")).otherwise(F.col("x")) - 1)
    met = met.select("hub", "rep", "inside", mine.alias("mine"), F.explode(other).alias("other"))
    key = F.when(F.col("inside"), F.xxhash64("hub", "mine", "other")).otherwise(F.xxhash64("hub", "other", "mine"))
    met = met.select(key.alias("key"), "rep").join(own, "rep").join(reps.select("rep", "sketch"), "rep")
    return common.store(met.select("key", "rep", "comp", "sketch"), "ends")


def _own_text(held: DataFrame, reps: DataFrame) -> DataFrame:
    """rep, text: of each representative, the text whose set it stands for."""
    one = held.filter(F.size("texts") == 1).select(F.col("doc_id").alias("rep"), F.col("texts")[0].alias("text"))
    more = held.filter(F.size("texts") > 1).select("doc_id", F.explode("texts").alias("text"))
    signed = more.mapInArrow(_with_digest, "rep long, text string, digest binary")
    own = signed.join(reps.select("rep", "digest"), ["rep", "digest"]).groupBy("rep").agg(F.min("text").alias("text"))
    return one.unionByName(own)


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digest = []
        for _, n, data, offsets in batches_of(batch.column(1)):
            h, at = shingle_sets(data, offsets)
            digest += [xxhash.xxh3_128_digest(h[at[k] : at[k + 1]].tobytes()) for k in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digest, pa.binary())], ["rep", "text", "digest"])
