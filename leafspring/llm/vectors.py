"""Near-equal embeddings by a robust-pruned flat graph on cluster shards."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import components, stored

DEGREE, POOL, BEAM, ALPHA = 24, 64, 32, 1.2
SHARD, FAN, MARGIN = 4096, 16, np.deg2rad(7.0)


def robust_prune(x: np.ndarray, degree: int = DEGREE, pool: int = POOL, alpha: float = ALPHA) -> np.ndarray:
    """Adjacency (n, degree; -1 pads) of rows of x (unit vectors): from each
    row's pool of nearest rows, the nearest is kept again and again, and rows that
    are alpha times nearer to it than to the row itself are dropped; reverse
    edges fill free places."""
    n = len(x)
    pool = min(pool, n - 1)
    out = np.full((n, degree), -1, np.int64)
    if pool <= 0:
        return out
    near, dist = np.empty((n, pool), np.int64), np.empty((n, pool))
    for a in range(0, n, 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, pool - 1, 1)[:, :pool]
        order = np.argsort(-np.take_along_axis(s, top, 1), 1, kind="stable")
        near[a : a + 512] = np.take_along_axis(top, order, 1)
        dist[a : a + 512] = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(s, near[a : a + 512], 1), 0))
    for a in range(0, n, 512):
        who, d = near[a : a + 512], dist[a : a + 512]
        live = np.ones(who.shape, bool)
        rows = np.arange(len(who))
        vec = x[who]
        for k in range(degree):
            any_ = live.any(1)
            if not any_.any():
                break
            first = live.argmax(1)
            out[a + rows[any_], k] = who[rows, first][any_]
            between = np.sqrt(np.maximum(2 - 2 * np.einsum("nd,npd->np", vec[rows, first], vec), 0))
            live &= alpha * between > d
            live[rows, first] = False
    free = (out < 0).sum(1)
    for i in np.nonzero((out >= 0).any(1))[0]:
        for j in out[i][out[i] >= 0]:
            if free[j] > 0 and i not in out[j]:
                out[j, degree - free[j]] = i
                free[j] -= 1
    return out


class Shard:
    """Search over one shard's graph. own marks vectors whose home is here;
    the others (of neighbouring shards) only lead the way."""

    def __init__(self, x: np.ndarray, adjacency: list[np.ndarray], own: np.ndarray):
        self.x, self.own = x, own
        width = max([1, *map(len, adjacency)])
        self.adj = np.full((len(x), width), -1, np.int64)
        for i, a in enumerate(adjacency):
            self.adj[i, : len(a)] = a
        mean = x.mean(0)
        self.medoids = np.unique(np.concatenate([[int((x @ mean).argmax())], np.linspace(0, len(x) - 1, min(len(x), 8)).astype(int)]))
        self.seen = np.zeros(len(x), np.int64)
        self.tick = 1
        # every row can be reached from an entry row, however the graph falls apart
        entries, at = [self.medoids], self.medoids
        self.seen[at] = self.tick
        while True:
            while len(at):
                at = self._fresh(at)
            at = np.nonzero(self.seen != self.tick)[0][:1]
            if not len(at):
                break
            self.seen[at] = self.tick
            entries.append(at)
        self.medoids = np.concatenate(entries)

    def _fresh(self, at: np.ndarray) -> np.ndarray:
        nb = np.unique(self.adj[at].ravel())
        nb = nb[(nb >= 0)]
        nb = nb[self.seen[nb] != self.tick]
        self.seen[nb] = self.tick
        return nb

    def exact(self, q: np.ndarray, least: float, rows: int = 64) -> list[np.ndarray]:
        """By brute force, for each row of q: rows with a dot product of least or more."""
        return [np.nonzero(s >= least)[0] for a in range(0, len(q), rows) for s in q[a : a + rows] @ self.x.T]

    def search(self, q: np.ndarray, least: float, beam: int, slack: float = 0.04, own: int | None = None) -> np.ndarray:
        """Rows with a dot product of least or more: a greedy beam search from
        the entry rows and the query's own row, then the range grows from what it
        has found (down to slack below least) until no new row comes up."""
        self.tick += 1
        at = self.medoids if own is None else np.union1d(self.medoids, [own])
        self.seen[at] = self.tick
        sims = self.x[at] @ q
        found, scores = [at], [sims]
        done = np.zeros(len(at), bool)
        while True:
            top = np.argsort(-sims, kind="stable")[:beam]
            at, sims, done = at[top], sims[top], done[top]
            todo = np.nonzero(~done)[0][:6]
            if not len(todo):
                break
            done[todo] = True
            new = self._fresh(at[todo])
            s = self.x[new] @ q
            found.append(new), scores.append(s)
            at, sims, done = np.concatenate([at, new]), np.concatenate([sims, s]), np.concatenate([done, np.zeros(len(new), bool)])
        every, all_s = np.concatenate(found), np.concatenate(scores)
        grow = every[all_s >= least - slack]
        while len(grow):
            new = self._fresh(grow)
            s = self.x[new] @ q
            every, all_s = np.concatenate([every, new]), np.concatenate([all_s, s])
            grow = new[s >= least - slack]
        return every[all_s >= least]


def _matrix(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, "<f8") for b in blobs])


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 0, sums / np.maximum(norm, 1e-12), c)
    return c


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, dim, x) of every row: x is the vector as unit vector of
    doubles, null where it links with nothing."""

    def run(batches):
        for b in batches:
            blobs, dims = [], []
            for name, label, v in zip(b.column(0), b.column(1), b.column(2), strict=True):
                x = None
                if name.is_valid and label.is_valid and v.is_valid and len(v):
                    v = np.array(v.as_py(), float)  # None becomes NaN
                    with np.errstate(over="ignore", invalid="ignore"):
                        top = np.abs(v).max()
                        if np.isfinite(v).all() and top > 0:
                            v = v / top
                            x = v / np.sqrt((v * v).sum())
                dims.append(0 if x is None else len(x)), blobs.append(None if x is None else x.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dims, pa.int32()), pa.array(blobs, pa.binary())], ["vec_id", "label", "dim", "x"])

    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    return rows.mapInArrow(run, "vec_id long, label long, dim int, x binary")


ROUTED = ("rep", "id", "weight", "cell", "home", "nav", "asks", "x")


def _by_cell(rows: DataFrame, made: DataFrame, each, schema: str) -> DataFrame:
    """each(part, k, centers, angles) -> frame, of the rows of a cell in a batch;
    angles (rows, k) to the centers of its parts."""

    def run(batches):
        for b in batches:
            out = []
            for _, part in b.to_pandas().groupby("cell", sort=False):
                k = int(part["k"].iloc[0])
                c = np.frombuffer(part["c"].iloc[0], "<f8").reshape(k, -1)
                out.append(each(part, k, np.arccos(np.clip(_matrix(part["x"]) @ c.T, -1, 1))))
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), preserve_index=False)

    return rows.join(made, "cell").mapInArrow(run, schema)


def route(rows: DataFrame, least: float, shard: int = SHARD) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(routed, counts, edges) of rows(rep, id, weight, cell, x).

    Cells larger than a shard are split by k-means on a bounded sample, level by
    level. A vector's home is the nearest part; it leads the way (nav) in the second
    nearest of the last split too. Home rows and visiting rows alike go on to every
    part that is hardly farther than the nearest (within MARGIN), with two
    exceptions, by the triangle inequality on angles: a part whose members are all
    too far to link, and one whose members are all near enough. The latter is
    covered: its weight is counted for the vector (counts: rep, others) and two links
    tie them together (edges: a, b; one from the vector to a member, one from each
    member to one of the vectors that cover it), and no row is moved. So a ball of
    near-equal vectors, however large, sends each of its rows to one cell."""
    far = float(np.arccos(least))
    yes = F.lit(True)
    now = stored(rows.select("rep", "id", "weight", "cell", yes.alias("home"), yes.alias("nav"), yes.alias("asks"), "x"), "cells")
    settled, counts, edges = [], [], []
    for level in range(40):
        sizes = now.where("home").groupBy("cell").count()
        big = stored(sizes.where(F.col("count") > shard), "big")
        if not big.limit(1).count():
            break
        settled.append(now.join(big.select("cell"), "cell", "left_anti").select(*ROUTED))
        share = 2048 / F.col("count")
        sample = now.where("home").join(big, "cell").where(F.pmod(F.xxhash64("rep", F.lit(level)), F.lit(1 << 20)) < share * (1 << 20)).select("cell", "count", "rep", "x")

        def centers(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("rep")
            k = int(min(FAN, len(pdf), max(2, -(-2 * pdf["count"].iloc[0] // shard))))
            return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "k": [k], "c": [_kmeans(_matrix(pdf["x"]), k, 1).tobytes()]})

        made = stored(sample.groupBy("cell").applyInPandas(centers, "cell string, k int, c binary"), "centers")

        def nearest(part, k, angle):
            at = angle.argmin(1)
            return pd.DataFrame({"cell": part["cell"].to_numpy(), "j": at.astype("int32"), "angle": angle[np.arange(len(at)), at], "weight": part["weight"].to_numpy(), "id": part["id"].to_numpy()})

        # of every part: its radius, what its members weigh, and one of them
        homes = _by_cell(now.where("home").select("cell", "id", "weight", "x"), made, nearest, "cell string, j int, angle double, weight long, id long")
        stats = stored(homes.groupBy("cell", "j").agg(F.max("angle").alias("radius"), F.sum("weight").alias("held"), F.min("id").alias("member")), "stats")
        radii = stats.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("j", "radius"))).alias("r"))
        parts = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.coalesce(F.try_element_at("r", j), F.lit(-1.0)))
        with_radii = stored(made.join(radii, "cell").select("cell", "k", "c", parts.alias("r")), "radii")

        def assign(part, k, angle):
            order, home = np.argsort(angle, 1, kind="stable"), part["home"].to_numpy(dtype=bool)[:, None]
            radius = np.array(list(part["r"].iloc[0]), float)[None]
            first = (order[:, :1] == np.arange(k)) & home
            second = (order[:, min(1, k - 1)][:, None] == np.arange(k)) & home
            covered = (radius >= 0) & (angle + radius <= far - 1e-6) & ~first
            near = (angle <= angle.min(1, keepdims=True) + MARGIN) & (angle - radius <= far + 1e-6) & (radius >= 0) & ~covered
            # 1: home, 2: leads the way, 4: asks, 8: covered
            kind = first * 7 | second * 2 | near * 4 | covered * 8
            i, j = np.nonzero(kind)
            t, own = part.iloc[i], kind[i, j]
            cell = t["cell"].to_numpy() + np.array([f".{c}" for c in range(k)], object)[j]
            x = np.where(own & 7, t["x"].to_numpy(), None)
            return pd.DataFrame({"rep": t["rep"].to_numpy(), "id": t["id"].to_numpy(), "weight": t["weight"].to_numpy(), "cell": cell, "kind": own.astype("int32"), "x": x})

        asking = now.where("asks").select("rep", "id", "weight", "cell", "home", "x")
        dealt = stored(_by_cell(asking, with_radii, assign, "rep long, id long, weight long, cell string, kind int, x binary"), "dealt")
        has = lambda bit: F.col("kind").bitwiseAND(bit) > 0
        told = stats.select(F.concat(F.col("cell"), F.lit("."), F.col("j").cast("string")).alias("cell"), "held", "member")
        cover = dealt.where(has(8)).select("rep", "id", "cell").join(told, "cell")
        counts.append(cover.groupBy("rep").agg(F.sum("held").alias("others")))
        hubs = cover.groupBy("cell").agg(F.min("id").alias("hub"))
        edges.append(cover.select(F.col("id").alias("a"), F.col("member").alias("b")))
        edges.append(dealt.where(has(1)).select("id", "cell").join(hubs, "cell").select(F.col("id").alias("a"), F.col("hub").alias("b")))
        now = dealt.where(has(7)).select("rep", "id", "weight", "cell", has(1).alias("home"), has(2).alias("nav"), has(4).alias("asks"), "x")
    for part in settled:
        now = now.unionByName(part)
    return now, counts, edges


def link_vectors(
    vectors: DataFrame, *, least: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
    shard: int = SHARD, block: int = 1024, audit: int = 8,
) -> DataFrame:
    """One row per row of vectors: vec_id, n_links (other rows of the label with
    cosine >= least), component_id (smallest vec_id reachable), kept.

    Equal vectors are one weighted class. A graph is built on each cluster shard
    (overlapping: a vector is in its two nearest), adjacency lists are united over
    shards, and blocks of at most `block` queries search each shard they visit. A
    block is audited: `audit` of its queries are also answered by brute force, and
    where one of them found fewer than 97 of 100 of its links the whole block is
    answered by brute force inside the cell. Links are counted and joined inside a
    block, and only counts and spanning edges leave it. Shards all of whose members
    link with a vector, as angles to their centers tell, are counted and tied to it
    without a visit (see route()), so a ball of near-equal vectors moves rows in
    proportion to its members. What the split loses (a link to a part farther than
    MARGIN beyond the nearest) no audit sees; tests measure it on borderline pairs.

    Vectors that are null, empty, zero or hold a null or non-finite component, or
    whose label or id is null, link with nothing; vectors of other lengths are not
    compared; ids that repeat are rows of their own (each with its own vector's links) but one node; an empty table
    gives an empty result; other columns are not read."""
    unit = stored(unit_vectors(vectors, id_col, vec_col, label_col), "units")
    classes = unit.where("x is not null").groupBy("label", "dim", "x").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    # a smallest id shared by classes (repeated ids) would mix them: such classes take a key of their own
    keyed = stored(classes.withColumn("rep", F.xxhash64("label", "dim", "x", "id")), "keyed")
    routed, counted, tied = route(keyed.withColumn("cell", F.concat_ws("/", "label", "dim")), least, shard)
    routed = stored(routed, "routed")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        ids = pdf["rep"].to_numpy()
        adj = robust_prune(_matrix(pdf["x"]))
        return pd.DataFrame({"rep": ids, "near": [ids[a[a >= 0]].tolist() for a in adj]})

    lists = routed.where("nav").groupBy("cell").applyInPandas(build, "rep long, near array<bigint>")
    union = lists.groupBy("rep").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    nodes = stored(routed.where("nav").join(union, "rep").select("cell", "rep", "id", "weight", "home", "x", "near"), "nodes")
    visits = routed.where("asks")
    load = visits.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    queries = visits.join(load, "cell").select("cell", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("blocks")).cast("int").alias("block"), "rep", "id", "x")
    copies = nodes.join(load, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "rep", "id", "weight", "home", "x", "near")

    def search(q: pd.DataFrame, n: pd.DataFrame) -> pd.DataFrame:
        cols = {"kind": [], "key": [], "value": []}
        if len(q) and len(n):
            q, n = q.sort_values("rep"), n.sort_values("rep")
            ids = n["rep"].to_numpy()
            place = {r: i for i, r in enumerate(ids)}
            graph = Shard(_matrix(n["x"]), [np.array([place[r] for r in a if r in place], np.int64) for a in n["near"]], n["home"].to_numpy())
            weight, own, names = n["weight"].to_numpy(), graph.own, n["id"].to_numpy()
            qx, qid, qname = _matrix(q["x"]), q["rep"].to_numpy(), q["id"].to_numpy()
            hits = [graph.search(v, least, BEAM, own=place.get(r)) for v, r in zip(qx, qid, strict=True)]
            checked = np.arange(0, len(qx), max(1, len(qx) // audit))
            want = graph.exact(qx[checked], least)
            if any(100 * len(np.intersect1d(hits[i], w)) < 97 * len(w) for i, w in zip(checked, want, strict=True)):
                hits = graph.exact(qx, least)
            parent = np.arange(len(ids) + len(qid))
            for i, h in enumerate(hits):
                h = h[own[h] & (ids[h] != qid[i])]
                cols["kind"].append(0), cols["key"].append(qid[i]), cols["value"].append(int(weight[h].sum()))
                if len(h):
                    at = np.append(h, len(ids) + i)
                    roots = parent[at]
                    while (parent[roots] != roots).any():
                        roots = parent[roots]
                    parent[roots] = roots.min()
            roots = parent
            while (parent[roots] != roots).any():
                roots = parent[roots]
            every = np.concatenate([names, qname])
            for i in np.nonzero(roots != np.arange(len(roots)))[0]:
                cols["kind"].append(1), cols["key"].append(every[i]), cols["value"].append(every[roots[i]])
        return pd.DataFrame(cols).astype({"kind": "int32", "key": "int64", "value": "int64"})

    grouped = queries.groupBy("cell", "block").cogroup(copies.groupBy("cell", "block"))
    found = stored(grouped.applyInPandas(search, "kind int, key long, value long"), "found")
    counts = found.where("kind = 0").select(F.col("key").alias("rep"), F.col("value").alias("others"))
    edges = found.where("kind = 1").select(F.col("key").alias("a"), F.col("value").alias("b"))
    for more in counted:
        counts = counts.unionByName(more)
    for more in tied:
        edges = edges.unionByName(more)
    member = stored(unit.join(keyed, ["label", "dim", "x"], "left").select("vec_id", "rep", "id", "weight"), "members")
    # an id of several classes ties them together
    spans = member.where("id is not null").groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("vec_id", "a")
    edges = edges.unionByName(member.join(spans, "vec_id").select("a", F.col("id").alias("b")))
    joined = components(edges).withColumnRenamed("node", "id")
    out = member.join(counts.groupBy("rep").agg(F.sum("others").alias("others")), "rep", "left").join(joined, "id", "left")
    out = out.select("vec_id", F.coalesce(F.col("others") + F.col("weight") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
