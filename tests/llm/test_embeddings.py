import numpy as np
import pytest

from epochflow.llm import embeddings as E
from epochflow.llm.queries import op7_embedding_near_dedup, op8_nearest_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def planted(n=400, seed=5):
    """Random vectors of three labels, some of them copies, near copies and scaled ones of others."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, 16))
    for i in range(n // 2, n):
        j = int(rng.integers(0, n // 4))
        base[i] = base[j] * (1 + (i % 3)) if i % 4 == 0 else base[j] if i % 4 == 1 else base[j] + rng.standard_normal(16) * 0.18
    return base.astype(np.float32), rng.integers(0, 3, n)


def brute_links(x, labels, cosine=0.98):
    x = x.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= cosine) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    part = np.arange(len(x))
    while True:
        new = np.minimum(part, np.where(near, part[None, :], len(x)).min(axis=1))
        if (new == part).all():
            return near.sum(axis=1), part
        part = new


@pytest.mark.parametrize("cell_rows", [8, 64, 8192])
def test_links_and_components_match_brute_force(spark, cell_rows):
    x, labels = planted()
    df = spark.createDataFrame([(i, v.tolist(), int(k), "x") for i, (v, k) in enumerate(zip(x, labels))], SCHEMA)
    n, part = brute_links(x, labels)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df, cell_rows=cell_rows, compare_rows=cell_rows).collect()}
    assert got == {i: (n[i], part[i], part[i] == i) for i in range(len(x))}
    assert n.sum() > 100


@pytest.mark.parametrize("size", [1, 2, 16, 64, 300])
def test_codes_and_estimates_leave_out_no_pair(size):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((200, size))
    x = np.concatenate([x, x + rng.standard_normal(x.shape) * 0.2 * rng.random((200, 1))])
    unit = E._unit(x)
    codes, factor = E.encoded(unit, 3)
    low, high = np.arange(400) + 1, np.full(400, 400)
    near = {(i, j) for i, j in np.argwhere(unit @ unit.T >= 0.98).tolist() if i < j}
    close = {(int(i), int(j)) for p, q in E.close_codes(codes, low, high, E.code_radius(size, 0.98), width=64) for i, j in zip(p, q)}
    open_ = {(int(i), int(j)) for p, q in E.Estimates(unit, codes, factor, 3).open_pairs(low, high, 0.98) for i, j in zip(p, q)}
    assert len(near) >= 40 and near <= close and near <= open_
    assert size < 16 or len(open_) < len(near) + 400 and len(close) < len(near) + 400


def test_estimates_are_unbiased():
    rng = np.random.default_rng(4)
    x, y = E._unit(rng.standard_normal((2, 64)))[:, None]
    found = []
    for seed in range(200):
        codes, factor = E.encoded(y, seed)
        e = E.Estimates(np.concatenate([x, y]), np.concatenate([codes, codes]), np.repeat(factor, 2), seed)
        found.append((e.rotated[0] @ e.directions[1]) / e.factor[1])
        E.stacked.cache_clear()
    true = float((x @ y.T).item())
    assert abs(np.mean(found) - true) < 4 * np.std(found) / 200**0.5 and np.std(found) < 0.06


def test_odd_vectors(spark):
    v = [1.0, 2.0]
    rows = [(1, v, 1, ""), (2, v, 1, ""), (2, v, 1, ""), (3, v, 2, ""), (4, v, None, ""), (5, None, 1, ""), (6, [0.0, 0.0], 1, ""), (7, [float("nan"), 1.0], 1, ""), (8, [float("inf"), 1.0], 1, ""), (9, [], 1, ""), (10, [1.0, None], 1, ""), (None, v, 1, ""), (11, [1.0, 2.0, 0.0], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in E.near_duplicates(df).collect()), key=str)
    assert got == sorted([(0, 3, 1, False), (1, 3, 1, True), (2, 3, 1, False), (2, 3, 1, False), *[(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]], key=str)
    assert E.near_duplicates(df.limit(0)).count() == 0
    found = [(r.query_id, r["rank"], r.vec_id) for r in E.nearest(df, every=2, k=5).orderBy("query_id", "rank").collect()]
    assert found == [(2, 1, 1), (2, 2, 3), (2, 3, 4), (4, 1, 1), (4, 2, 2), (4, 3, 3)]
    assert E.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_rows", [100, 8192])
def test_nearest_against_brute_force(spark, shard_rows):
    x, _ = planted(1500, 2)
    df = spark.createDataFrame([(i, v.tolist(), 0, "") for i, v in enumerate(x)], SCHEMA)
    unit = E._unit(x.astype(np.float64))
    hit = total = 0
    rows = E.nearest(df, every=20, shard_rows=shard_rows, least=64).collect()
    for q in range(0, 1500, 20):
        got = {r.vec_id: r for r in rows if r.query_id == q}
        cos = unit @ unit[q]
        cos[q] = -9
        want = np.lexsort((np.arange(1500), -np.round(cos, 12)))[:5]
        hit += len(set(want.tolist()) & got.keys())
        total += 5
        assert sorted(r["rank"] for r in got.values()) == [1, 2, 3, 4, 5]
        assert all(abs(cos[i] - r.score) < 1e-9 for i, r in got.items())
    assert hit / total >= 0.9


def test_queries(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x, labels = np.array([r.embedding for r in rows]), np.array([r.label for r in rows])
    n, _ = brute_links(x, labels)
    assert {r.vec_id: r.n_links for r in op7_embedding_near_dedup(spark, sf_dir).collect()} == {r.vec_id: k for r, k in zip(rows, n)}
    found = op8_nearest_neighbours(spark, sf_dir).collect()
    unit = E._unit(x.astype(np.float64))
    ids = [r.vec_id for r in rows]
    hits = 0
    queries = [i for i in range(len(ids)) if ids[i] % 50 == 0]
    for i in queries:
        cos = unit @ unit[i]
        cos[i] = -9
        hits += len({ids[j] for j in np.argsort(-cos)[:5]} & {r.vec_id for r in found if r.query_id == ids[i]})
    assert hits >= 0.9 * 5 * len(queries)


def test_links_match_their_sql(spark):
    import duckdb

    from epochflow.llm.queries import ORACLES

    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    cur = con.execute(ORACLES["op7_embedding_near_dedup"])
    names = [d[0] for d in cur.description]
    df = op7_embedding_near_dedup(spark, sf)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(cur.fetchall())
