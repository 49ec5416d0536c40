"""Behaviour of the engine's own operators: the reference's six assertions, identities and guards."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slabwise import model
from slabwise.operators import contrastive, graph, linalg, mixture, neighbors, ordering, registration, svg, transport, viz
from slabwise.session import ship
from slabwise.sources import files


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def slices(spark, sizes, dim=3):
    rows = []
    for name, n in sizes.items():
        for i in range(n):
            rows.append((name, i, 10.0 * i / max(1, n - 1), 5.0 * i / max(1, n - 1), [float((i * 7 + k) % 5) for k in range(dim)]))
    return spark.createDataFrame(rows, "sampleid string, row int, coor_x_ad2 double, coor_y_ad2 double, vec array<double>")


def test_coordinates_are_derived(spark):
    got = files.derive_xy(slices(spark, {"T300": 5}))
    assert {"x", "y"} <= set(got.columns) and got.count() == 5
    with pytest.raises(KeyError):
        files.derive_xy(spark.createDataFrame([(1,)], "a int"))


def test_split_and_cube(spark):
    merged = slices(spark, {"T300": 4, "T301": 6})
    spots = model.spots_from(merged, "sampleid", "row")
    cube = model.Cube(spots, z_spacing=3.0, z_base=2.0)
    infos = cube.slice_infos()
    assert [(i.key, i.z, i.n_obs) for i in infos] == [("T300", 2.0, 4), ("T301", 5.0, 6)]
    assert cube.spots_3d().filter("x_raw <> x or y_raw <> y").count() == 0
    assert set(cube.spots_3d().columns) >= {"x", "y", "z"}
    with pytest.raises(ValueError):
        model.Cube(spots, lambda_z=0)
    with pytest.raises(ValueError):
        model.spots_from(merged, "sampleid", "row", sort="odd")
    with pytest.raises(ValueError):
        cube.with_clusters(spots.select("gid", F.lit(1).alias("cluster")).limit(3))


def test_null_slice_is_nan(spark):
    df = spark.createDataFrame([(None, 1, 0.0, 0.0), ("a", 2, 1.0, 1.0)], "s string, row int, x double, y double")
    assert [r.slice_id for r in model.spots_from(df, "s", "row").orderBy("gid").collect()] == ["a", "nan"]


def test_pair_schedule():
    assert registration.alignment_pairs(2) == [(1, 0)]
    assert registration.alignment_pairs(2, "middle_out") == [(1, 0)]
    assert registration.alignment_pairs(3, "middle_out") == [(0, 1), (2, 1)]
    assert registration.alignment_pairs(4, "middle_out") == [(0, 1), (2, 1), (3, 2)]
    with pytest.raises(ValueError):
        registration.alignment_pairs(3, "odd")


def rigid_pair(spark):
    rng = np.random.default_rng(0)
    xy = rng.normal(size=(40, 2)) * 5
    x = rng.normal(size=(40, 12))
    x[:, :2] = 0.1 * xy
    x += 1e-6 * np.arange(40)[:, None]
    moved = xy @ registration.rotation(math.radians(37)).T + [12.3, -4.5]
    rows = [(i, 0, *map(float, xy[i]), x[i].tolist()) for i in range(40)] + [(40 + i, 1, *map(float, moved[i]), x[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "gid long, slice_idx int, x double, y double, vec array<double>")
    return model.Cube(df.select("gid", "slice_idx", "x", "y"), embedding=df.select("gid", "slice_idx", "vec")), xy


@pytest.mark.parametrize("how", ["adjacent", "anchor", "global"])
def test_known_rigid_transform_is_recovered(spark, how):
    cube, xy = rigid_pair(spark)
    o = registration.Options(subsample_n=40, svd_dim=10, feature_mode="svd", expr_knn=None, transport="emd", n_iter=3)
    if how == "adjacent":
        moved, results, _ = registration.align_adjacent(cube, o)
        assert results[0].n_source == 40 and results[0].method.startswith("coarse_emd_rigid")
        assert moved.mapping.filter("rank = 1 and gid_hi - 40 <> gid_lo").count() == 0
    elif how == "anchor":
        moved, _ = registration.align_to_anchor(cube, o, anchor=0)
    else:
        moved, report = registration.align_global(cube, o)
        assert report["cost"] < 1e-6
    got = np.array([(r.x, r.y) for r in moved.spots.filter("slice_idx = 1").orderBy("gid").collect()])
    assert np.abs(got - xy).max() < 1e-2


@pytest.mark.parametrize("small", [4096, 0])
def test_neighbours_match_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(neighbors, "SMALL", small)
    rng = np.random.default_rng(3)
    pts = np.concatenate([rng.integers(0, 12, size=(150, 2)).astype(float), rng.normal(size=(50, 2)) * 0.01, [[500.0, 500.0]], [[3.0, 3.0]] * 3])
    df = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(pts)], "gid long, slice_idx int, x double, y double")
    d = ((pts[:, None] - pts[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j)) for i in range(len(pts)) for j in np.lexsort((np.arange(len(pts)), d[i]))[:7]}
    assert {(r.src, r.dst) for r in neighbors.knn_within(df, 7).collect()} == want
    i, j = np.nonzero(d <= 4.0)
    assert {(r.src, r.dst) for r in neighbors.radius_within(df, 2.0).collect()} == set(zip(i.tolist(), j.tolist()))


@pytest.mark.parametrize("small", [4096, 0])
def test_fewer_points_than_neighbours(spark, monkeypatch, small):
    monkeypatch.setattr(neighbors, "SMALL", small)
    df = spark.createDataFrame([(0, 0, 0.0, 0.0), (1, 0, 1.0, 0.0), (2, 1, 0.0, 0.0)], "gid long, slice_idx int, x double, y double")
    assert {(r.src, r.dst) for r in neighbors.knn_within(df, 5).collect()} == {(0, 1), (1, 0)}
    assert {(r.src, r.dst) for r in neighbors.knn_across(df, 5).collect()} == {(0, 2), (1, 2), (2, 0), (2, 1)}


def test_assignment_is_optimal():
    import itertools

    rng = np.random.default_rng(0)
    for n in (1, 2, 5, 7):
        c = rng.normal(size=(n, n))
        to = transport.assignment(c)
        assert sorted(to) == list(range(n))
        assert abs(c[np.arange(n), to].sum() - min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))) < 1e-9


def test_sinkhorn_marginals():
    rng = np.random.default_rng(1)
    c = rng.random((6, 8))
    pi = transport.sinkhorn(np.full(6, 1 / 6), np.full(8, 1 / 8), c, 0.1)
    assert np.allclose(pi.sum(1), 1 / 6, atol=1e-6) and np.allclose(pi.sum(0), 1 / 8, atol=1e-6)


def test_path_and_direction():
    import itertools

    rng = np.random.default_rng(2)
    for n in (3, 5, 6):
        d = rng.random((n, n))
        d = d + d.T
        np.fill_diagonal(d, 0)
        path = ordering.held_karp(d)
        assert abs(ordering.path_cost(d, path) - min(ordering.path_cost(d, p) for p in itertools.permutations(range(n)))) < 1e-12
    line = np.abs(np.subtract.outer(np.arange(5.0), np.arange(5.0)))
    assert ordering.held_karp(line) == [4, 3, 2, 1, 0] and ordering.held_karp(line, canonical=True) == [0, 1, 2, 3, 4]


def ring(spark):
    edges = [(a, b, 1.0) for c in (0, 10) for i in range(6) for a, b in ((c + i, c + (i + 1) % 6), (c + (i + 1) % 6, c + i))]
    return spark.createDataFrame([*edges, (0, 10, 0.1), (10, 0, 0.1)], "src long, dst long, w double")


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_leiden_finds_the_parts(spark, limit):
    found = {r.gid: r.cluster for r in graph.leiden(ring(spark), resolution=0.2, task_edges=limit).collect()}
    assert len({found[i] for i in range(6)}) == 1 and len({found[i] for i in range(10, 16)}) == 1 and found[0] != found[10]


def test_diffusion_reaches_its_fixed_point(spark):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (1, 2, 2.0), (2, 1, 2.0)], "src long, dst long, w double")
    x = np.array([[1.0, 0.0], [0.0, 1.0], [2.0, 3.0]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "gid long, vec array<double>")
    a = np.array([[0, 1, 0], [1 / 3, 0, 2 / 3], [0, 1, 0]])
    want = 0.5 * np.linalg.solve(np.eye(3) - 0.5 * a, x)
    got = np.array([r.vec for r in linalg.diffuse(edges, df, 0.5, 15, 1e-4).orderBy("gid").collect()])
    assert np.abs(got - want).max() < 1e-3
    with pytest.raises(ValueError):
        linalg.diffuse(edges, df, 1.0)


def test_svd_preserves_distances(spark):
    x = np.random.default_rng(0).normal(size=(30, 6)) @ np.diag([5, 3, 1, 0, 0, 0])
    df = spark.createDataFrame([(i, i % 2, v.tolist()) for i, v in enumerate(x)], "gid long, slice_idx int, vec array<double>")
    got = np.array([r.vec for r in linalg.svd_embedding(df, 3).orderBy("gid").collect()])
    assert np.allclose(transport.squared_distances(got, got), transport.squared_distances(x, x), atol=1e-6)


def test_mixture_guards_and_separation(spark):
    rows = [(i, [10.0 * (i % 2) + 0.01 * i, 0.0]) for i in range(12)]
    x = spark.createDataFrame(rows, "gid long, vec array<double>")
    edges = spark.createDataFrame([(i, (i + 2) % 12, 1.0) for i in range(12)], "src long, dst long, w double")
    found, means, rounds = mixture.gmm(x, edges, 2, n_iter=4, init="random")
    labels = {r.gid: r.cluster for r in mixture.gmm(x, edges, 2, n_iter=3)[0].collect()}
    assert len({labels[i] for i in range(0, 12, 2)}) == 1 and labels[0] != labels[1] and rounds <= 4 and found.count() == 12
    for bad in ({"n_clusters": 1}, {"n_clusters": 20}, {"n_clusters": 2, "init": "odd"}):
        with pytest.raises(ValueError):
            mixture.gmm(x, edges, **bad)


def test_contrastive_loss_falls():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(64, 8))
    y = x + 0.05 * rng.normal(size=x.shape)
    c = model.ContrastiveConfig(epochs=60, embed_dim=4, hidden_dim=16, lr=1e-2)
    _, losses = contrastive.train([(x, y)] * 60, c)
    assert losses[-1] < losses[0]
    w = {k: rng.normal(size=s) for k, s in (("a", (8, 5)), ("b", 5), ("c", (5, 3)), ("d", 3))}
    loss, g = contrastive.loss_and_gradient(x, y, w, 0.2)
    w2 = {k: v.copy() for k, v in w.items()}
    w2["a"][1, 2] += 1e-6
    assert abs((contrastive.loss_and_gradient(x, y, w2, 0.2)[0] - loss) / 1e-6 - g["a"][1, 2]) < 1e-4


def test_tests_find_a_gradient(spark):
    spots = spark.createDataFrame([(i, float(i % 20), float(i // 20)) for i in range(400)], "gid long, x double, y double")
    flat = [(i, 0, "flat", float(1 + (i * 7919) % 5)) for i in range(400)]
    slope = [(i, 1, "slope", float(1 + i % 20)) for i in range(400)]
    counts = spark.createDataFrame(flat + slope, "gid long, gene_idx long, gene string, value double")
    got = {r.gene: r for r in svg.spatially_variable(spots, counts).collect()}
    assert got["slope"].adjusted < 1e-6 < 0.01 < got["flat"].p1
    with pytest.raises(ValueError):
        svg.top_genes(counts, sort_by="no", fallback="neither")


def test_traces_and_optional_plots(spark):
    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0, "ab"[i % 2]) for i in range(6)], "gid long, x double, y double, z double, l string")
    rows = {r.code: r for r in viz.traces(pts, "l").collect()}
    assert rows[0].n == 3 and rows[1].x == [1.0, 3.0, 5.0] and rows[0].colour != rows[1].colour
    assert viz.palette(0) == [] and len(viz.palette(10)) == 10 and viz.palette(9)[8] == viz.palette(1)[0]
    with pytest.raises(ValueError):
        viz.plotly_pointcloud(pts.drop("z"))


def test_feature_neighbours_tie_by_id_among_many_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(3, 8)) * 0.1
    ids = rng.permutation(600)
    rows = [(int(g), i % 2, base[i % 3].tolist()) for i, g in enumerate(ids)]
    df = spark.createDataFrame(rows, "gid long, slice_idx int, vec array<double>")
    got = {}
    for r in neighbors.feature_knn(df, 4).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    vec = {g: np.array(v) for g, _, v in rows}
    low = [g for g, i, _ in rows if i == 0]
    for g, i, v in rows:
        if i == 1:
            want = sorted(low, key=lambda h: (((vec[h] - vec[g]) ** 2).sum(), h))[:4]
            assert [got[g][k] for k in (1, 2, 3, 4)] == want


def test_every_adjacent_pair_is_assigned_and_every_gene_tested(spark):
    from slabwise.plans import load_catalog

    data, found = "/root/testdata/sf0.001", load_catalog().QUERIES
    sizes = dict(spark.read.parquet(f"{data}/embeddings.parquet").groupBy("label").count().collect())
    slices = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    pairs = found["lap_assign"](spark, data).collect()
    assert len(pairs) == sum(min(sizes[i], sizes[i + 1]) for i in range(9)) and all(slices[p.dst] == slices[p.src] + 1 for p in pairs)
    assert found["sparkx_test"](spark, data).count() == found["sparkx_statistic"](spark, data).count()


def test_the_order_is_of_all_slices(spark):
    from slabwise.plans import load_catalog

    data, found = "/root/testdata/sf0.001", load_catalog().QUERIES
    assert sorted(r.slice_idx for r in found["infer_order"](spark, data).collect()) == list(range(10))


@pytest.mark.parametrize("small", [4096, 0])
def test_neighbours_of_uneven_slices(spark, monkeypatch, small):
    """By blocks and by cells: one outlier, a dense cluster within a sparse field, a thousand spots at one place: exact, and no cell of all spots."""
    monkeypatch.setattr(neighbors, "SMALL", small)
    rng = np.random.default_rng(9)
    pts = np.concatenate([rng.normal(size=(1500, 2)) * 0.01, rng.random((300, 2)) * 100, np.full((400, 2), 7.0), [[1e6, 1e6]]])
    df = spark.createDataFrame([(i, i % 2, *map(float, p)) for i, p in enumerate(pts)], "gid long, slice_idx int, x double, y double")
    got = {}
    for r in neighbors.knn_within(df, 6).collect():
        got.setdefault(r.src, {})[r["rank"]] = r.dst
    across = {}
    for r in neighbors.knn_across(df, 6).collect():
        across.setdefault(r.src, {})[r["rank"]] = r.dst
    ids = np.arange(len(pts))
    for i in range(len(pts)):
        d = ((pts - pts[i]) ** 2).sum(1)
        for found, own in ((got, (ids % 2 == i % 2) & (ids != i)), (across, ids % 2 != i % 2)):
            want = ids[own][np.lexsort((ids[own], d[own]))[:6]].tolist()
            assert [found[i][k] for k in range(1, 7)] == want


def test_sparse_and_wide_features_embed_like_dense_ones(spark, monkeypatch):
    rng = np.random.default_rng(11)
    x = np.where(rng.random((60, 90)) < 0.1, rng.integers(1, 9, (60, 90)), 0).astype(float)
    x[:, 5:] *= 0.05
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero())], "gid long, gene_idx long, value double")
    spots = spark.createDataFrame([(i, i % 2) for i in range(62)], "gid long, slice_idx int")
    _, s, vt = np.linalg.svd(x, full_matrices=False)
    want = x @ vt[:4].T
    got = {r.gid: r.vec for r in linalg.sparse_embedding(spots, entries, 4).collect()}
    assert len(got) == 62 and got[61] == [0.0] * 4
    sparse = np.array([got[i] for i in range(60)])
    assert np.abs(sparse @ sparse.T - want @ want.T).max() < 1e-3 * s[0] ** 2
    monkeypatch.setattr(linalg, "MOST_GRAM", 10)
    dense = spark.createDataFrame([(i, i % 2, x[i].tolist()) for i in range(60)], "gid long, slice_idx int, vec array<double>")
    wide = np.array([r.vec for r in linalg.svd_embedding(dense, 4).orderBy("gid").collect()])
    assert np.abs(wide @ wide.T - want @ want.T).max() < 1e-3 * s[0] ** 2


def test_long_vectors_are_added_up_in_pieces(spark):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(30, 150))
    df = spark.createDataFrame([(i % 4, float(i), x[i].tolist()) for i in range(30)], "g int, w double, vec array<double>")
    for weight, scale in (("w", np.arange(30.0)), (None, np.ones(30))):
        for r in linalg.mean_vector(df, ["g"], weight=weight).collect():
            own = np.arange(30) % 4 == r.g
            want = (x[own] * scale[own, None]).sum(0) / (1 if weight else own.sum())
            assert np.allclose(r.vec, want)


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(13)
    v = rng.integers(0, 50, 500).astype(float)
    df = spark.createDataFrame([(i % 3, float(v[i])) for i in range(500)] + [(1, None)], "g int, v double")
    from slabwise.operators.ranking import quantiles

    for r in quantiles(df, ["g"], "v", [0.0, 0.3, 0.5, 1.0]).collect():
        assert abs(r["quantile"] - np.quantile(v[np.arange(500) % 3 == r.g], r.share)) < 1e-9


def test_matrix_market_files(spark, tmp_path):
    """One standard file is written; comments, integer, pattern and symmetric files are read, and an entry that reads like the size line."""
    rows = [(5, 10, 2.5), (5, 30, 1.0), (9, 10, 3.0), (7, 20, 4.0)]
    files.write_matrix(spark.createDataFrame(rows, "gid long, gene_idx long, value double"), str(tmp_path / "m.mtx"))
    lines = (tmp_path / "m.mtx").read_text().splitlines()
    assert lines[:2] == ["%%MatrixMarket matrix coordinate real general", "3 3 4"] and len(lines) == 6
    got = {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "m.mtx")).collect()}
    assert got == {(1, 1, 2.5), (3, 1, 1.0), (1, 3, 3.0), (2, 2, 4.0)}
    (tmp_path / "i.mtx").write_text("%%MatrixMarket matrix coordinate integer general\n% a remark\n2 2 2\n1 1 7\n2 2 2\n")
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "i.mtx")).collect()} == {(1, 1, 7.0), (2, 2, 2.0)}
    (tmp_path / "p.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n3 3 2\n2 1\n3 3\n")
    assert {tuple(r) for r in files.read_matrix(spark, str(tmp_path / "p.mtx")).collect()} == {(2, 1, 1.0), (1, 2, 1.0), (3, 3, 1.0)}
    (tmp_path / "a.mtx").write_text("%%MatrixMarket matrix array real general\n1 1\n2\n")
    with pytest.raises(ValueError):
        files.read_matrix(spark, str(tmp_path / "a.mtx"))


def test_result_tables_are_checked(spark, tmp_path):
    (tmp_path / "r.csv").write_text("gene,adjustedPval,combinedPval\na,0.5,0.25\nb,0.1,0.05\n")
    genes = spark.createDataFrame([("a",), ("b",)], "gene string")
    got = {r.gene: (r.combinedPval, r.adjustedPval) for r in files.read_results(spark, str(tmp_path / "r.csv"), genes=genes).collect()}
    assert got == {"a": (0.25, 0.5), "b": (0.05, 0.1)}
    with pytest.raises(ValueError):
        files.read_results(spark, str(tmp_path / "r.csv"), genes=genes.union(spark.createDataFrame([("c",)], "gene string")))
    with pytest.raises(ValueError):
        files.read_results(spark, str(tmp_path / "r.csv"), "gene string, other double")


def test_tiles_find_what_cells_find(spark, monkeypatch):
    """A tile is searched in one task without a row for a pair; tiles of too many rows go by a join of cells, with the same result."""
    rng = np.random.default_rng(21)
    pts = np.concatenate([rng.integers(0, 40, size=(1500, 2)).astype(float), rng.normal(size=(300, 2))])
    df = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(pts)], "gid long, slice_idx int, x double, y double")
    monkeypatch.setattr(neighbors, "SMALL", 0)
    calls, real = [], neighbors._looked_up_by_cells
    monkeypatch.setattr(neighbors, "_looked_up_by_cells", lambda *a: calls.append(1) or real(*a))
    found = []
    for most in (400_000, 300):
        monkeypatch.setattr(neighbors, "TILE_ROWS", most)
        found.append(sorted(map(tuple, neighbors.knn_within(df, 6).collect())))
        assert bool(calls) == (most == 300)
    assert found[0] == found[1]
    d = ((pts[:, None] - pts[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert {(r[1], r[2]) for r in found[0]} == {(i, int(j)) for i in range(len(pts)) for j in np.lexsort((np.arange(len(pts)), d[i]))[:6]}


def test_the_feature_test_writes_no_kernels(spark, monkeypatch):
    """Spots are written with their coordinates alone, and the transformed ones are neither written nor shuffled."""
    rng = np.random.default_rng(8)
    spots = spark.createDataFrame([(i, 0, *map(float, p)) for i, p in enumerate(rng.random((60, 2)))], "gid long, slice_idx int, x double, y double")
    counts = spark.createDataFrame([(i, g, f"g{g}", float(1 + (i * g) % 5)) for i in range(60) for g in range(1, 5)], "gid long, gene_idx long, gene string, value double")
    written, real = [], svg.cut
    monkeypatch.setattr(svg, "cut", lambda df: written.append(df.columns) or real(df))
    found = svg.projection_test(spots, counts)
    assert written == [["gid", "x", "y"]]
    wide = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(gene_idx" in line]
    assert len(wide) == 1 and "REPARTITION_BY_COL" in wide[0]
    assert found.count() == 4 and found.columns[:3] == ["gene_idx", "gene", "p1"]


def test_sparse_rows_give_what_joins_give(spark, monkeypatch):
    """Few columns are multiplied by whole rows, without a written vector for each row and round; many by joins."""
    rng = np.random.default_rng(14)
    x = np.where(rng.random((80, 12)) < 0.4, rng.integers(1, 9, (80, 12)), 0).astype(float)
    entries = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero())] + [(3, 5, None)], "gid long, gene_idx long, value double")
    written, real = [], linalg.cut
    monkeypatch.setattr(linalg, "cut", lambda df: written.append(df.columns) or real(df))
    found = {r.gid: r.vec for r in linalg.sparse_svd(entries, 4).collect()}
    assert written == [["gene_idx"], ["gid", "at", "v"]]
    monkeypatch.setattr(linalg, "MOST_COLUMNS", 3)
    joined = {r.gid: r.vec for r in linalg.sparse_svd(entries, 4).collect()}
    assert found.keys() == joined.keys()
    a, b = (np.array([f[g] for g in sorted(f)]) for f in (found, joined))
    assert np.abs(a @ a.T - b @ b.T).max() < 1e-4 * np.abs(a @ a.T).max()
    assert np.allclose(np.linalg.norm(a, axis=0), np.linalg.svd(x, compute_uv=False)[:4], rtol=1e-4)


def test_radius_graph_shuffles_no_edges(spark):
    """Graphs by radii are quadratic: edges are neither shuffled nor written, and equal those that are added up (ids that stand twice go that way)."""
    from slabwise.operators import graph

    from .test_leiden import shuffled_rows

    rng = np.random.default_rng(5)
    rows = [(i, i % 3, float(x), float(y)) for i, (x, y) in enumerate(rng.normal(0, 1, (900, 2)))] + [(900, 3, 50.0, 50.0), (901, 3, 50.0, 50.0)]
    df = spark.createDataFrame(rows, "gid long, slice_idx int, x double, y double")
    edges, moved = shuffled_rows(spark, lambda: graph.weighted_graph(df, radius_intra=1.5, radius_inter=1.5).collect())
    found = {(r.src, r.dst): r.w for r in edges}
    assert len(edges) == len(found) > 250_000
    twice = df.unionByName(spark.createDataFrame([(5000, 9, 0.0, 0.0), (5000, 9, 0.0, 0.0)], df.schema))
    want = {(r.src, r.dst): r.w for r in graph.weighted_graph(twice, radius_intra=1.5, radius_inter=1.5).collect()}
    assert found.keys() == want.keys() and all(abs(found[p] - want[p]) < 1e-12 for p in want)
    assert moved < len(edges) / 2


def test_medians_of_rows_made_anew(spark):
    from slabwise.operators import ranking

    rng = np.random.default_rng(6)
    groups = {0: rng.random(1001), 1: rng.random(1000), 2: np.array([0.25]), 3: np.array([0.1, 0.9]), 4: np.full(50, 0.5), 5: 0.7 + rng.random(3000) * 1e-9}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g int, v double")
    few = ranking._FEW
    try:
        for ranking._FEW in (few, 10):
            found = {r.g: r.quantile for r in ranking.medians_of_made(df, "g", "v", 1.0).collect()}
            assert found == {g: float(np.median(vs)) for g, vs in groups.items()}
    finally:
        ranking._FEW = few
    assert ranking.medians_of_made(df.filter("false"), "g", "v", 1.0).count() == 0


def test_poses_do_not_wait_for_the_mapping(spark, monkeypatch):
    """Alignment makes the mapping when it is asked for, and once."""
    made = []
    monkeypatch.setattr(registration, "mapping_to_previous", lambda e, k=5: made.append(k) or e.select("gid"))
    rng = np.random.default_rng(8)
    rows = [(i, i // 30, "S", float(x), float(y), [float(v) for v in (x, y, 1.0)]) for i, (x, y) in enumerate(rng.normal(0, 1, (60, 2)))]
    df = spark.createDataFrame(rows, "gid long, slice_idx int, slice_id string, x double, y double, vec array<double>")
    cube = model.Cube(df.drop("vec"), embedding=df.select("gid", "slice_idx", "vec"))
    options = registration.Options(svd_dim=2, feature_mode="svd", expr_knn=None, n_iter=1)
    for moved, poses in (registration.align_adjacent(cube, options)[::2], registration.align_to_anchor(cube, options, anchor=0)):
        made.clear()
        assert poses.count() == 1 and made == []
        assert moved.mapping.count() == moved.mapping.count() == 60 and made == [5]
