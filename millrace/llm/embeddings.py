"""Near-duplicate embeddings by a robust-pruned flat graph over overlapping cluster shards.

A label of many vectors is dealt to overlapping shards: a vector goes to its two nearest pivots, and to every other within
a margin of the nearest. The margin follows from how far apart two vectors in range can lie and from the dimensions that
the pivots spread over; where these are few it is the bound that no pair escapes. Shards that are still large are dealt
again to pivots of their own. Each shard builds a graph: a vector's neighbours are pruned so that none is much nearer to
another neighbour than to the vector. A vector's adjacency lists from its shards are united, and every vector searches
its shards over the united lists: greedily from the medoid first, then expanding whatever lies near the range. What it
finds is verified by its cosine in double precision. Large shards that pivots don't split are compared block by block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import components

LEAST = 0.93
SLACK = 0.05  # how far below the range vectors are still expanded
SHARD = 1000  # vectors that search together
LARGE = 8 * SHARD  # a larger label or shard is dealt to pivots
PIVOTS = 256  # of a shard at most; fitted on a sample of about so many vectors
APART = 0.8  # pivots are less similar than this, so that one cluster of near copies has one pivot
SPREADS = 1.25  # margin, in standard deviations of what a pair in range differs by between two pivots
NEAR, POOL = 24, 64  # neighbours of a vector in a shard, and those they are chosen from
ALPHA = 1.2
SALT = 8_000  # vectors dealt to pivots together


def _unit(column: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in column])
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def shards_of(x: np.ndarray, p: np.ndarray, least: float) -> np.ndarray:
    """Which of the pivots p each unit vector of x is dealt to: the two nearest and those within the margin.

    Vectors x and y in range are |x - y| apart at most, so y prefers pivot b to x's nearest a only if x lies within
    |x - y| of the plane between them. Over d dimensions the part of x - y across that plane deviates by |x - y| / sqrt(d).
    """
    among = p @ p.T
    dims = min(x.shape[1], len(p) ** 2 / (among**2).sum())
    near = x @ p.T
    first = near.argmax(axis=1)
    margin = min(1.0, SPREADS / np.sqrt(dims)) * np.sqrt(max(0.0, 2 - 2 * least)) * np.sqrt(np.maximum(0, 2 - 2 * among))
    dealt = near[np.arange(len(x)), first][:, None] - near <= margin[first]
    np.put_along_axis(dealt, np.argsort(-near, axis=1, kind="stable")[:, :2], True, axis=1)
    return dealt


def _assigner(least: float):
    def assign(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        """The pivots that each vector is dealt to; -1 where one pivot is all there is."""
        if not len(rows):
            return pd.DataFrame({"rep": [], "node": [], "shard": [], "parts": []})
        parts = [[-1]] * len(rows)
        if len(pivots):
            p = _unit(pivots.sort_values(["rep", "node"])["embedding"])
            kept: list[int] = []
            for i in range(len(p)):
                if not kept or (p[kept] @ p[i]).max() < APART:
                    kept.append(i)
            if len(kept) > 1:
                parts = [np.flatnonzero(own).tolist() for own in shards_of(_unit(rows["embedding"]), p[kept], least)]
        return pd.DataFrame({"rep": rows["rep"], "node": rows["node"], "shard": rows["shard"], "parts": parts})

    return assign


def robust_graph(x: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Neighbours among unit vectors x of those at the places `own`, NEAR of each at most; -1 where fewer."""
    n, pool = len(own), min(POOL, len(x) - 1)
    out = np.full((n, NEAR), -1, np.int64)
    if pool < 1:
        return out
    near = x[own] @ x.T
    near[np.arange(n), own] = -np.inf
    best = np.argpartition(-near, pool - 1, axis=1)[:, :pool]
    far = np.take_along_axis(near, best, 1)
    order = np.lexsort((best, -far), axis=1)
    best, far = np.take_along_axis(best, order, 1), np.take_along_axis(far, order, 1)
    far = np.sqrt(np.maximum(0, 2 - 2 * far))
    for lo in range(0, n, 256):
        part = slice(lo, lo + 256)
        held = x[best[part]]
        between = np.sqrt(np.maximum(0, 2 - 2 * held @ held.transpose(0, 2, 1)))
        every = np.arange(len(held))
        alive, k = np.ones((len(held), pool), bool), np.zeros(len(held), np.int64)
        for j in range(pool):
            take = every[alive[:, j] & (k < NEAR)]
            out[lo + take, k[take]] = best[lo + take, j]
            k[take] += 1
            alive[take] &= ALPHA * between[take, j] > far[lo + take]
    return out


def range_search(x: np.ndarray, own: np.ndarray, adjacency: np.ndarray, least: float) -> np.ndarray:
    """Which of x each of those at the places `own` finds at a cosine of `least` or more: all step together.

    Each goes greedily from the medoid to ever nearer vectors, then follows the lists of itself and of all that it met
    near the range, until nothing near the range is left.
    """
    n, m, q = len(own), len(x), x[own]
    similar = np.full((n, m + 1), -np.inf)  # the last column stands for no neighbour
    done = np.zeros((n, m + 1), bool)

    def visit(rows: np.ndarray, to: np.ndarray) -> None:
        new = (to >= 0) & (similar[rows, to] == -np.inf)
        key = np.unique(rows[new] * (m + 1) + to[new])
        for k in range(0, len(key), 1 << 16):
            i, j = np.divmod(key[k : k + (1 << 16)], m + 1)
            similar[i, j] = np.einsum("ij,ij->i", q[i], x[j])

    at = np.full(n, int((x @ x.mean(axis=0)).argmax()))
    active = np.arange(n)
    visit(active, at)
    while len(active):
        to = adjacency[at[active]]
        visit(np.repeat(active, to.shape[1]), to.ravel())
        done[active, at[active]] = True
        there = np.where(to >= 0, similar[active[:, None], to], -np.inf)
        best = there.argmax(axis=1)
        nearer = there[np.arange(len(active)), best] > similar[active, at[active]]
        active, step = active[nearer], to[np.arange(len(active)), best][nearer]
        at[active] = step
    similar[np.arange(n), own] = 1.0
    while True:
        rows, nodes = np.nonzero((similar[:, :m] >= least - SLACK) & ~done[:, :m])
        if not len(rows):
            break
        done[rows, nodes] = True
        for k in range(0, len(rows), 1 << 14):
            to = adjacency[nodes[k : k + (1 << 14)]]
            visit(np.repeat(rows[k : k + (1 << 14)], to.shape[1]), to.ravel())
    return similar[:, :m] >= least


def _earlier(a: pd.Series, b: pd.Series, shard: int) -> np.ndarray:
    """Which pairs of vectors share a shard of a smaller number than this one."""
    known = {s: k for k, s in enumerate(sorted({s for own in (*a, *b) for s in own if s < shard}))}
    out = np.zeros((len(a), len(b)), bool)
    if known:
        bits = []
        for side in (a, b):
            x = np.zeros((len(side), -(-len(known) // 64) * 64), bool)
            for k, own in enumerate(side):
                x[k, [known[s] for s in own if s < shard]] = True
            bits.append(np.packbits(x, axis=1).view(np.uint64))
        for p, q in zip(bits[0].T, bits[1].T, strict=True):
            out |= (p[:, None] & q) != 0
    return out


def _builder(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The neighbours of a block's vectors in their shard."""
    rows = rows.sort_values(["rep", "node"]).reset_index(drop=True)
    own = np.flatnonzero(rows["own"])
    nodes = rows["node"].to_numpy()
    graph = robust_graph(_unit(rows["embedding"]), own)
    return pd.DataFrame({"rep": rows["rep"][own], "node": nodes[own], "near": [nodes[g[g >= 0]] for g in graph]})


def _searcher(least: float):
    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """For each vector of a block how many others it links with, counting a pair in the smallest shard both are in;
        for each that is linked, the least of those it is linked with here. A block on its own links both ways."""
        shard, one, other = int(key[-3]), int(key[-2]), int(key[-1])
        rows = rows.sort_values(["rep", "node"]).reset_index(drop=True)
        x, nodes = _unit(rows["embedding"]), rows["node"].to_numpy()
        if other < 0:  # a block against its shard, over the graph
            own, of = np.flatnonzero(rows["own"]), np.arange(len(rows))
            order = np.argsort(nodes, kind="stable")
            lists = [list(near) if near is not None else [] for near in rows["near"]]
            size = np.array([len(near) for near in lists])
            to = np.concatenate([np.empty(0, np.int64), *(np.asarray(near, np.int64) for near in lists)])
            place = order[np.minimum(np.searchsorted(nodes[order], to), len(nodes) - 1)]
            i, here = np.repeat(np.arange(len(rows)), size), nodes[place] == to
            # links go both ways, as searches do
            i, j = np.concatenate([i[here], place[here]]), np.concatenate([place[here], i[here]])
            pairs = np.unique(i * len(rows) + j)
            i, j = np.divmod(pairs, len(rows))
            count = np.bincount(i, minlength=len(rows))
            adjacency = np.full((len(rows), max(1, count.max(initial=0))), -1, np.int64)
            adjacency[i, np.arange(len(i)) - (np.cumsum(count) - count)[i]] = j
            found = range_search(x, own, adjacency, least)
            found[np.arange(len(own)), own] = False
            if len(own) == len(rows):
                found |= found.T
        else:  # two blocks of a shard that pivots don't split
            block = rows["block"].to_numpy()
            own, of = np.flatnonzero(block == one), np.flatnonzero(block == other)
            found = x[own] @ x[of].T >= least
            if one == other:
                np.fill_diagonal(found, False)
        times, shards = rows["times"].to_numpy(), rows["shards"]
        some, seen = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
        own, of, found = own[some], of[seen], found[np.ix_(some, seen)]
        if not len(own):
            return pd.DataFrame({"rep": [], "node": [], "n": [], "to_rep": [], "to_node": []})
        count = found & ~_earlier(shards[own], shards[of], shard)
        n = np.bincount(own, weights=count @ times[of], minlength=len(rows)).astype(np.int64)
        if other >= 0 and one != other:
            n += np.bincount(of, weights=times[own] @ count, minlength=len(rows)).astype(np.int64)
        label, before = np.arange(len(rows)), None
        while before is None or (label != before).any():
            before = label.copy()
            label[own] = np.minimum(label[own], np.where(found, label[of], len(rows)).min(axis=1))
            label[of] = np.minimum(label[of], np.where(found, label[own][:, None], len(rows)).min(axis=0))
        some = np.unique(np.concatenate([own, of]))
        rep = rows["rep"].to_numpy()
        return pd.DataFrame({"rep": rep[some], "node": nodes[some], "n": n[some], "to_rep": rep[label[some]], "to_node": nodes[label[some]]})

    return search


def _placed(found: DataFrame, least: float) -> DataFrame:
    """label, dim, rep, node, shard, dense: the shards of each vector; dense ones are those that pivots don't split, as
    comparing all within the parts would take more than half of comparing all at once."""
    group, ids = ["label", "dim"], ["rep", "node"]
    placed, done, level = found.select(*group, *ids, F.lit(0).cast("long").alias("shard")), None, 0
    while True:
        sizes = placed.groupBy(*group, "shard").agg(F.count("*").alias("k"))
        sizes = checkpoint(sizes.withColumn("salts", F.ceil(F.col("k") / SALT).cast("int")))
        small = placed.join(sizes.where(F.col("k") <= LARGE), [*group, "shard"], "left_semi").withColumn("dense", F.lit(False))
        done = small if done is None else done.unionByName(small)
        large = sizes.where(F.col("k") > LARGE)
        if large.isEmpty():
            return done
        open_ = placed.join(large, [*group, "shard"]).join(found.select(*group, *ids, "embedding"), [*group, *ids])
        wanted = F.least(F.lit(PIVOTS), F.ceil(F.col("k") * 4 / SHARD)) / F.col("k")
        pivots = open_.where(F.pmod(F.xxhash64("node", F.lit(level), F.lit(1)), F.lit(1 << 30)) < wanted * (1 << 30))
        pivots = pivots.select(*(F.col(c).alias(c) for c in (*group, "shard", *ids, "embedding")), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        dealt = open_.select(*group, "shard", F.pmod(F.xxhash64("node", F.lit(2)), F.col("salts")).cast("int").alias("salt"), *ids, "embedding")
        keys = [*group, "shard", "salt"]
        parts = dealt.groupBy(*keys).cogroup(pivots.groupBy(*keys)).applyInPandas(_assigner(least), "rep long, node long, shard long, parts array<int>")
        # a vector's label follows from its id
        parts = checkpoint(parts.join(found.select(*group, *ids), ids).select(*group, *ids, "shard", F.explode("parts").alias("part")))
        cost = parts.groupBy(*group, "shard", "part").agg(F.count("*").alias("n")).groupBy(*group, "shard").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("cost"))
        judged = checkpoint(large.join(cost, [*group, "shard"]).select(*group, "shard", (F.col("cost") * 2 < F.col("k").cast("double") * F.col("k")).alias("split")))
        done = done.unionByName(placed.join(judged.where("not split"), [*group, "shard"], "left_semi").withColumn("dense", F.lit(True)))
        placed = parts.join(judged.where("split"), [*group, "shard"], "left_semi").select(*group, *ids, F.xxhash64("shard", "part", F.lit(level)).alias("shard"))
        level += 1


def near_duplicates(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row.

    Vectors are compared within equal labels and lengths. Those that are null, empty, zero or hold null or non-finite
    components, and those without a label, link with nothing. Equal vectors link without a search. A null vec_id names
    no component. A vec_id that comes with several vectors or labels stands for several vectors, a row of its own for
    each. Other columns are not read.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"), F.col(label).alias("label"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    good = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & F.forall("embedding", finite) & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False)))
    same, group, ids = ["label", "embedding"], ["label", "dim"], ["rep", "node"]
    # a vector is known by the least of its ids and its own hash
    found = rows.where("good").groupBy(*same).agg(F.min("vec_id").alias("rep"), F.count("*").alias("times"))
    found = checkpoint(found.withColumns({"dim": F.size("embedding"), "node": F.xxhash64("label", "embedding")}))
    placed = checkpoint(_placed(found, least))
    sizes = placed.groupBy(*group, "shard").agg(F.count("*").alias("k"))
    sizes = sizes.select(*group, "shard", F.when(F.col("k") > 2 * SHARD, F.ceil(F.col("k") / SHARD)).otherwise(1).cast("int").alias("blocks"))  # two blocks go together anyway
    own = placed.groupBy(*group, *ids).agg(F.collect_list("shard").alias("shards"))  # of few shards each
    cells = placed.join(sizes, [*group, "shard"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int"))
    cells = cells.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(found.select(*group, *ids, "embedding", "times"), [*group, *ids])
    whole = cells.where("not dense").withColumn("own", F.expr("block = k"))
    near = whole.groupBy(*group, "shard", "k").applyInPandas(_builder, "rep long, node long, near array<long>")
    near = near.groupBy(*ids).agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # of its shards
    whole = whole.join(near, ids, "left").withColumns({"i": F.col("k"), "j": F.lit(-1)})
    dense = cells.where("dense").withColumns({"own": F.lit(True), "near": F.lit(None).cast("array<long>"), "i": F.least("block", "k"), "j": F.greatest("block", "k")})
    cells = whole.unionByName(dense).join(own, [*group, *ids])
    links = checkpoint(cells.groupBy(*group, "shard", "i", "j").applyInPandas(_searcher(least), "rep long, node long, n long, to_rep long, to_node long"))
    counts = links.groupBy(*ids).agg(F.sum("n").alias("n"))
    part = components(links.select(F.struct(*ids).alias("a"), F.struct(F.col("to_rep").alias("rep"), F.col("to_node").alias("node")).alias("b")))
    part = part.select(F.col("id.rep").alias("rep"), F.col("id.node").alias("node"), F.col("component.rep").alias("component"))
    reps = found.join(counts, ids, "left").join(part, ids, "left").select(*same, F.coalesce("n", F.lit(0)).alias("n"), "times", F.coalesce("component", "rep").alias("component"))
    # bad vectors don't take part in the join; the others find their class by the vector itself
    out = rows.where("good").join(reps, same).select("vec_id", (F.col("n") + F.col("times") - 1).alias("n_links"), F.col("component").alias("component_id"))
    out = out.union(rows.where("not good").select("vec_id", F.lit(0).cast("long"), F.col("vec_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def audit(vectors: DataFrame, found: DataFrame, least: float = LEAST, step: int = 50) -> DataFrame:
    """links, found, recall: brute force for the vectors whose id is divisible by `step`, against all, beside n_links; recall
    is null where there is nothing to find.

    The queries of a label go, in blocks of SHARD, to each part of that label's vectors.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), "label").where("label is not null and embedding is not null and size(embedding) > 0")
    rows = rows.where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & F.exists("embedding", lambda v: v != 0)).withColumn("dim", F.size("embedding"))
    sizes = rows.groupBy("label", "dim").agg(F.ceil(F.count("*") / SALT).cast("int").alias("parts"))
    rows = rows.join(sizes, ["label", "dim"])
    keys = ["label", "dim", "part"]
    queries = rows.where(F.col("vec_id") % step == 0).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def count(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({"vec_id": [], "n": []})
        u, v = _unit(q["embedding"]), _unit(x["embedding"])
        n = np.concatenate([(u[k : k + SHARD] @ v.T >= least).sum(axis=1) for k in range(0, len(u), SHARD)])
        return pd.DataFrame({"vec_id": q["vec_id"], "n": n - np.isin(q["vec_id"], x["vec_id"])})

    queries = queries.select(*(F.col(c).alias(c) for c in (*keys, "vec_id", "embedding")))
    true = queries.groupBy(*keys).cogroup(rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).groupBy(*keys)).applyInPandas(count, "vec_id long, n long")
    true = true.groupBy("vec_id").agg(F.sum("n").alias("n")).join(found, "vec_id")
    return true.agg(F.sum("n").alias("links"), F.sum("n_links").alias("found"), F.try_divide(F.sum(F.least("n", "n_links")), F.sum("n")).alias("recall"))


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))
