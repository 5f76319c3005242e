import duckdb
import numpy as np
import pytest

from leafspring.llm import vectors
from leafspring.llm.queries import ORACLE_SQL


def brute(rows, least=0.98):
    usable = {}
    for i, (vid, v, label) in enumerate(rows):
        if v is None or label is None or vid is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float)
        usable[i] = (label, len(v), v / np.linalg.norm(v))
    links, parent = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    keys = sorted(usable)
    for i in keys:
        for j in keys:
            if i < j and usable[i][:2] == usable[j][:2] and usable[i][2] @ usable[j][2] >= least:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                parent[max(a, b, key=lambda k: rows[k][0])] = min(a, b, key=lambda k: rows[k][0])
    return [(rows[i][0], links[i], rows[find(i)][0]) for i in range(len(rows))]


def made(rng, groups=12, size=30, dim=24):
    rows = []
    for g in range(groups):
        c = rng.standard_normal(dim)
        for _ in range(int(rng.integers(1, size))):
            rows.append((len(rows), (c + 0.11 * rng.standard_normal(dim)).astype(float).tolist(), int(g % 3)))
    rows += [(len(rows) + i, rows[3][1], rows[3][2]) for i in range(40)]  # one vector many times
    return rows


@pytest.mark.parametrize("shard", [4096, 40])
def test_links_against_brute_force(spark, shard):
    rows = made(np.random.default_rng(3))
    n = len(rows)
    rows += [(n, None, 1), (n + 1, [0.0] * 24, 1), (n + 2, [float("nan")] * 24, 1), (n + 3, [None] + [1.0] * 23, 1), (n + 4, rows[0][1], None), (n + 5, [], 1), (n + 6, [1.0, 2.0], 0), (n + 7, [2.0, 4.0], 0)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, cell string, weight int")
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in vectors.link_vectors(df, shard=shard, block=64).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert len(got) == len(rows)
    links = sum(r[1] for r in want.values())
    assert sum(r[1] for r in got.values()) >= 0.97 * links
    assert all(got[i][1] <= want[i][1] for i in want)
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.97 * len(want)
    assert vectors.link_vectors(df.where("false")).count() == 0


def test_links_of_the_table(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding), r.label) for r in df.collect()]
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in vectors.link_vectors(df).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert sum(r[1] for r in got.values()) >= 0.97 * sum(r[1] for r in want.values())


def test_links_of_the_table_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    rel = con.sql(ORACLE_SQL["op5_vectors"])
    got = vectors.link_vectors(spark.read.parquet(f"{sf}/embeddings.parquet")).select(*rel.columns).collect()
    assert sorted(map(tuple, got)) == sorted(rel.fetchall())


def test_graph_reaches_everything():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    adj = vectors.robust_prune(x)
    assert adj.shape[1] == vectors.DEGREE and (adj[:, 0] >= 0).all()
    graph = vectors.Shard(x, [a[a >= 0] for a in adj], np.ones(600, bool))
    found = total = 0
    for q in x[:100]:
        want = np.nonzero(x @ q >= 0.7)[0]
        found += len(np.intersect1d(graph.search(q, 0.7, vectors.BEAM), want))
        total += len(want)
    assert found >= 0.95 * total


def test_groups_of_near_copies(spark):
    """Groups larger than a row's pool of nearest rows: no edge leaves a group."""
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((20, 24))
    x = np.concatenate([c / np.linalg.norm(c) + 0.002 * rng.standard_normal((100 + g, 24)) for g, c in enumerate(centers)])
    group = np.repeat(np.arange(20), np.arange(100, 120))
    order = rng.permutation(len(x))
    x, group = x[order], group[order]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.98).sum(1) - 1
    assert (want >= 99).all()
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.link_vectors(df).collect()}
    assert [got[i].n_links for i in range(len(x))] == want.tolist()
    first = {g: int(np.nonzero(group == g)[0][0]) for g in range(20)}
    assert [got[i].component_id for i in range(len(x))] == [first[g] for g in group]


def ball(rng, n, noise, dim=32):
    c = rng.standard_normal(dim)
    x = c / np.linalg.norm(c) + noise * rng.standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_a_ball_is_not_sent_everywhere(spark, monkeypatch):
    """Rows a vector, in a ball of near-equal vectors, don't grow with the ball; all
    links are counted."""
    rng, rows = np.random.default_rng(11), {}
    kept = vectors.stored
    for n in (500, 4000):
        seen = {}
        monkeypatch.setattr(vectors, "stored", lambda df, name: (out := kept(df, name), seen.__setitem__(name, out))[0])  # noqa: B023
        df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(ball(rng, n, 0.003))], "vec_id long, embedding array<double>, label int")
        got = vectors.link_vectors(df, shard=256).collect()
        assert all(r.n_links == n - 1 and r.component_id == 0 for r in got) and len(got) == n
        rows[n] = seen["routed"].count() / n
    assert max(rows.values()) < 2.5


def test_borderline_links_across_cells(spark):
    """Pairs just above the least cosine, in shards so small that many are split."""
    rng = np.random.default_rng(13)
    base = rng.standard_normal((1500, 32))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    other = rng.standard_normal(base.shape)
    other -= (other * base).sum(1, keepdims=True) * base
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    near = 0.9803 * base + np.sqrt(1 - 0.9803**2) * other
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in vectors.link_vectors(df, shard=128).collect()}
    found = sum(got[i + 1500].component_id == i and got[i].n_links >= 1 for i in range(1500))
    assert found >= 0.97 * 1500


def test_balls_of_all_sizes_against_brute_force(spark):
    """Balls so wide that some links of theirs hold and some don't, beside others."""
    rng = np.random.default_rng(17)
    x = np.concatenate([ball(rng, 300, e) for e in (0.002, 0.01, 0.02, 0.025, 0.03, 0.05)] + [ball(rng, 1, 0)] * 3)
    x = np.concatenate([x, x[:40]])
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = {r.vec_id: (r.vec_id, r.n_links, r.component_id) for r in vectors.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), shard=64).collect()}
    want = {r[0]: r for r in brute(rows)}
    assert all(got[i][1] <= want[i][1] for i in want) and sum(g[1] for g in got.values()) >= 0.97 * sum(w[1] for w in want.values())
    assert sum(got[i][2] == want[i][2] for i in want) >= 0.97 * len(want)


def test_repeated_ids_keep_their_own_links(spark):
    a, b = [1.0, 0.0], [0.0, 1.0]
    df = spark.createDataFrame([(1, a, 1), (2, a, 1), (2, b, 1), (3, b, 1), (4, b, 1), (1, None, 1), (2, a, None)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.link_vectors(df).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 0, 2), (2, 1, 1), (2, 2, 1), (3, 2, 1), (4, 2, 1)]
