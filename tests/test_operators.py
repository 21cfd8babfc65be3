"""Operators without a SQL twin, against numpy or plain Python."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.functions import adapters, keys
from prismata.functions import vectors as V
from prismata.operators import clustering as C
from prismata.operators import labels as L
from prismata.operators import metrics as M
from prismata.operators import similarity as S
from prismata.operators import tables as T
from prismata.operators.graph import components
from prismata.sources import files
from prismata.streaming import suppress


def vectors(spark, n=60, d=8, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    x[1] = x[0]
    return x, spark.createDataFrame([(i, v.tolist(), int(i % 4)) for i, v in enumerate(x)], "id long, vec array<double>, label long")


def distances(x):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    return 1 - u @ u.T


def test_components_of_paths_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (200, 201), (201, 200), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(30)) and got[201] == 200
    assert components(spark.createDataFrame([], "src long, dst long")).collect() == []


@pytest.mark.parametrize("block", [16, 4096])
def test_joins_in_blocks(spark, block):
    x, df = vectors(spark)
    d = distances(x)
    got = {(r.src, r.dst) for r in S.threshold_join(df, 0.6, block=block).collect()}
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if d[i, j] <= 0.6}
    knn = {(r.src, r["rank"]): r.dst for r in S.knn_join(df, 5, block=block).collect()}
    for i in range(60):
        near = sorted((round(d[i, j], 12), j) for j in range(60) if j != i)[:5]
        assert [knn[i, r] for r in range(1, 6)] == [j for _, j in near]


def naive_cut(x, t, method):
    d = distances(x)
    groups = [[i] for i in range(len(x))]
    link = {"single": np.min, "complete": np.max, "average": np.mean}[method]
    while len(groups) > 1:
        h, a, b = min((link(d[np.ix_(p, q)]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j)
        if h > t:
            break
        groups[a] += groups.pop(b)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("method", ["single", "complete", "average"])
def test_cut_tree(method):
    x = np.random.default_rng(3).normal(size=(40, 5))
    for t in (0.2, 0.5, 0.9):
        labels = C.cut_tree(x, t, method)
        assert {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())} == naive_cut(x, t, method)


def test_single_linkage_equals_the_cut(spark):
    x, df = vectors(spark)
    got = {r.id: r.component for r in C.single_linkage(df, 0.5).collect()}
    labels = C.cut_tree(x, 0.5, "single")
    assert {frozenset(i for i in got if got[i] == c) for c in set(got.values())} == {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist())}


def test_batched_hierarchical_covers_all(spark):
    _, df = vectors(spark)
    out = C.batched_hierarchical(df, 0.6, 20).collect()
    assert sorted(r.id for r in out) == list(range(60))
    found = sorted({r.label for r in out})
    assert found == list(range(len(found))) and len({r.label for r in out if r.id < 2}) == 1


def naive_constrained(edges, max_sz, step, max_iter=100):
    pool = {}
    for a, b, s in edges:
        pool.setdefault((min(a, b), max(a, b)), []).append(s)
    pool = {k: sum(v) / len(v) for k, v in pool.items()}
    th, nodes, out = min(pool.values()), {n for k in pool for n in k}, {}
    live = dict(pool)
    for _ in range(max_iter):
        parent = {n: n for n in nodes}

        def find(n):
            while parent[n] != n:
                n = parent[n]
            return n

        for a, b in live:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
        groups = {}
        for n in nodes:
            groups.setdefault(find(n), []).append(n)
        big = [g for g in groups.values() if len(g) > max_sz]
        out |= {n: r for r, g in groups.items() if len(g) <= max_sz for n in g}
        if not big:
            break
        nodes = {n for g in big for n in g}
        th += (1 - th) * step
        live = {k: s for k, s in live.items() if s >= th and k[0] in nodes and k[1] in nodes}
    return out


def test_constrained_components(spark):
    rng = np.random.default_rng(4)
    edges = [(int(a), int(b), float(s)) for a, b, s in zip(rng.integers(0, 30, 60), rng.integers(0, 30, 60), rng.random(60), strict=True) if a != b]
    got = {r.id: r.component for r in C.constrained_components(spark.createDataFrame(edges, "src long, dst long, score double"), 6, 0.2).collect()}
    assert got == naive_constrained(edges, 6, 0.2)


def test_nms_is_greedy(spark):
    rng = np.random.default_rng(5)
    members = {(int(p), int(n)) for p, n in zip(rng.integers(0, 15, 120), rng.integers(0, 25, 120), strict=True)}
    scores = {p: round(float(rng.random()), 1) for p in range(15)}
    sets = {p: {n for q, n in members if q == p} for p in scores}
    alive = []
    for p in sorted(scores, key=lambda p: (-scores[p], p)):
        if sets[p] and all(len(sets[p] & sets[q]) / len(sets[p] | sets[q]) <= 0.2 for q in alive):
            alive.append(p)
    want = {}
    for p in alive:
        for n in sets[p]:
            want.setdefault(n, p)
    m, s = spark.createDataFrame(sorted(members), "proposal_id long, node long"), spark.createDataFrame(sorted(scores.items()), "proposal_id long, score double")
    assert {r.node: r.proposal_id for r in C.nms(m, s, 0.2).collect()} == want


def test_approximate_joins_recall(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    exact = {(r.src, r.dst) for r in S.knn_join(df, 10).collect()}
    assert len(exact & {(r.src, r.dst) for r in S.ivf_knn(df, 10, cells=16, nprobe=12).collect()}) >= 0.9 * len(exact)
    assert exact == {(r.src, r.dst) for r in S.ivf_knn(df, 10, cells=16, nprobe=16).collect()}
    near = {(r.src, r.dst) for r in S.threshold_join(df, 0.65).collect()}
    got = {(r.src, r.dst) for r in S.lsh_join(df, 0.65).collect()}
    assert got <= near and len(got) >= 0.9 * len(near)


def test_ivf_queries_ask_all_rows(spark, sf):
    """Every twentieth row asks, all rows are indexed; with all cells probed it is the brute-force search, copies and ties included."""
    import __spark_entry__

    df = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    both = df.unionByName(df.select((F.col("id") + 1000).alias("id"), "vec"))
    exact = {(r.src, r["rank"], r.dst) for r in S.knn_join(both, 5).collect() if r.src % 20 == 0}
    assert exact == {(r.src, r["rank"], r.dst) for r in S.ivf_knn(both, 5, cells=4, nprobe=4, queries=F.col("id") % 20 == 0, block=100).collect()}
    brute = {(r.src, r.dst) for r in S.knn_join(df, 10).collect() if r.src % 20 == 0}
    got = {(r.src, r.dst) for r in __spark_entry__.queries()["ivf_knn"](spark, sf).collect()}
    assert {src for src, _ in got} == {src for src, _ in brute} and len(got & brute) >= 0.9 * len(brute)


def test_lsh_groups_lose_no_link(spark):
    """Groups and numbers of links as brute force has them, whichever tiles the projections leave out."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8))
    vecs = np.concatenate([centres[i % 40] * (1 + i) + 0.25 * (1 + i) * rng.normal(size=8) for i in range(900)]).reshape(900, 8)
    vecs = np.concatenate([vecs, vecs[:50] * 3])
    unit = vecs / np.sqrt((vecs * vecs).sum(1))[:, None]
    links = 1 - unit @ unit.T <= 0.02
    np.fill_diagonal(links, False)
    reach, near = np.arange(950), links | np.eye(950, dtype=bool)
    while ((new := np.where(near, reach[None], 950).min(1)) != reach).any():
        reach = new
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)] + [(950, None), (951, [0.0] * 8)], "id long, vec array<double>")
    want = {i: (int(reach[i]), int(links[i].sum())) for i in range(950)} | {950: (950, 0), 951: (951, 0)}
    for block in (200, 8192):
        assert {r.id: (r.component, r.n_links) for r in S.lsh_groups(df, 0.02, block=block).collect()} == want
    assert {(r.src, r.dst) for r in S.lsh_join(df, 0.02, block=200).collect()} == {(i, j) for i, j in np.argwhere(links).tolist() if i < j}
    whole = sum(len(a) * len(b) for a, b in S.tiles(np.repeat(unit, 8, 0), np.repeat(unit, 8, 0), 0.02, 1.0, 8, 0))
    assert whole < (8 * 950) ** 2


def test_template_means(spark):
    _, df = vectors(spark)
    out = S.template_means(df.select(F.col("label").alias("track"), "id", "vec"), 3).collect()
    assert len(out) == 4 and all(len(r.vec) == 8 for r in out)


def test_metrics_extremes(spark):
    same = spark.createDataFrame([(i, i % 3, i % 3) for i in range(12)], "id long, y_true int, y_pred int")
    r = M.report(same).first()
    assert r.pairwise_fscore == r.bcubed_fscore == r.nmi == r.ari == r.purity == r.accuracy == 1
    alone = spark.createDataFrame([(i, i, i) for i in range(5)], "id long, y_true int, y_pred int")
    assert M.pairwise(alone).first().precision is None
    permuted = same.withColumn("y_pred", (F.col("y_pred") + 1) % 3)
    assert M.adjusted_rand(permuted).first().ari == 1 and M.accuracy(permuted).first().accuracy == 0
    with pytest.raises(ValueError):
        M.evaluate(same, "none")


def test_review_decisions(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(23)], "id long, label long")
    moves = spark.createDataFrame([(1, 2), (2, 3), (4, -1)], "old_label long, new_label long")
    got = {r.id: r.label for r in L.update_annotations(df, moves, final=True).collect()}
    assert {got[1], got[2], got[3]} == {0} and got[4] == -1 and got[0] == 1


def test_keys(spark):
    df = spark.createDataFrame([("chan_frame_20230525100138412614_face_0.png",), ("a_b_c_d_e_f.png",), ("x.png",)], "name string")
    got = [r.p for r in df.select(keys.parse_key(F.col("name")).alias("p")).collect()]
    assert got[0].channel == "chan" and got[0].ts == datetime.datetime(2023, 5, 25, 10, 1, 38, 412614) and got[0].face == 0 and got[1] is None and got[2] is None
    row = df.limit(1).select(keys.params_of(F.lit("k_80_th_0.7_step_0.05")).alias("m"), keys.swap_suffix(F.lit("a.png"), "png", "jpg").alias("s"), keys.tuple_of_ints(F.lit("[1, 2, 3]")).alias("t"), keys.pair_key(F.lit(1), F.lit(2)).alias("k")).first()
    assert row.m["k"] == "80" and row.m["th"] == "0.7" and row.s == "a.jpg" and row.t == [1, 2, 3] and row.k == "1,2"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    a, b = F.col("a"), F.col("b")
    r = df.select(V.cosine_distance(a, b).alias("c"), V.euclidean(a, b).alias("e"), V.normalise(a).alias("n"), V.softmax(a).alias("s"), V.clamp(F.lit(1.5)).alias("k"), V.normalised_distribution(F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(3.0))).alias("m"), V.set_scores(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("z")).collect()
    assert r[0].c == pytest.approx(0.04) and r[0].e == pytest.approx(2**0.5) and r[0].n == pytest.approx([0.6, 0.8]) and r[1].c is None and r[1].n == [0, 0]
    assert sum(r[0].s) == pytest.approx(1) and r[0].k == 1 and r[0].m == {"x": 0.25, "y": 0.75} and r[0].z.iou == pytest.approx(1 / 3)


def test_histogram_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-91.0, -90.0, 0.0, 89.5, 90.0, 90.5)], "v double")
    got = {r.angle: r.n for r in T.angle_histogram(df, F.col("v")).collect()}
    assert got[-90] == 1 and got[0] == 1 and got[89] == 2 and sum(got.values()) == 4


def test_smoothing_keeps_polynomials(spark):
    df = spark.createDataFrame([(i, float(i**3 - 4 * i)) for i in range(30)], "i int, v double")
    for r in T.savitzky_golay(df, "i", "v", 11, 3).collect():
        assert r.smooth is None if not 5 <= r.i <= 24 else r.smooth == pytest.approx(r.v, abs=1e-6)


def test_splits_are_disjoint(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "id long, c long")
    out = T.stratified_split(df, "c", "id", 0.3).groupBy("c", "test").count().collect()
    assert {(r.c, r["count"]) for r in out if r.test} == {(c, int(0.3 * (15 if c < 2 else 14))) for c in range(7)}
    assert T.class_disjoint_split(df, "c", 0.5).select("c", "train").distinct().count() == 7


def test_last_emitted_holds_the_last_emitted(spark):
    keep, state = suppress.last_emitted(np.array([0.0, 5.0, 0.0, 0.5, 9.0]), None, lambda a, b: abs(a - b) > 1)
    assert keep.tolist() == [True, True, True, False, True] and state == 9
    rows = [(i, i % 3, float((i * 7) % 11)) for i in range(200)] + [(1000 + i, None, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    want = set()
    for k in (0, 1, 2, None):
        mine = sorted(r for r in rows if r[1] == k)
        flags, _ = suppress.last_emitted(np.array([r[2] for r in mine]), None, lambda a, b: abs(a - b) > 3)
        want |= {r[0] for r, f in zip(mine, flags, strict=True) if f}
    assert {r.id for r in suppress.suppress_batch(df, "k", ["id"], "v", 3).collect()} == want


def test_streams_equal_batches(spark, tmp_path):
    src = f"file://{tmp_path}/in"
    rows = [(i, i % 3, float((i * 7) % 11)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k int, v double")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    got = suppress.run_once(suppress.suppress_stream(stream, "k", "id", "v", 3), "s", f"file://{tmp_path}")
    assert {r.id for r in got.collect()} == {r.id for r in suppress.suppress_batch(df, "k", ["id"], "v", 3).collect()}
    _, vecs = vectors(spark)
    vecs = vecs.withColumn("shard", F.col("id") % 2)
    vecs.coalesce(1).write.parquet(f"{src}-v")
    online = suppress.online_stream(spark.readStream.schema(vecs.schema).parquet(f"{src}-v"), 0.5)
    a = {(r.id, r.shard, r.label) for r in suppress.run_once(online, "o", f"file://{tmp_path}").collect()}
    assert a == {(r.id, r.shard, r.label) for r in suppress.online_labels(vecs, "shard", 0.5).collect()}


def test_similarity_index():
    index = suppress.SimilarityIndex(suppress.euclidean_many, 0.5)
    labels = [index.add(np.array(v)) for v in ([0.0, 0], [0.1, 0], [5, 5], [5.1, 5], [0.2, 0], [5, 9])]
    assert labels == [0, 0, 1, 1, 0, 2] and set(index.depths()) == {0, 1, 2}
    again = suppress.SimilarityIndex(suppress.euclidean_many, 0.5).load(index.dump())
    assert again.add(np.array([0.05, 0.0])) == 0 and suppress.SimilarityIndex(suppress.euclidean_many, 1).search(np.zeros(2)) == (None, float("inf"))


def test_index_pairs_beside_siblings_all_alike():
    index = suppress.SimilarityIndex(suppress.euclidean_many, 0.5)
    index.root = index._node(np.zeros(1), None, False)
    ends = [index._node(np.zeros(1), k, True) for k in (0, 1)]
    alone = index._node(np.zeros(1), 2, True)
    for end in ends:
        index._attach(end, index.root)
    index._attach(alone, ends[0])
    assert index._sibling_distance(ends[0]) == float("inf") and index._sibling_distance(alone) == 0.0


def test_tar_where_far_just_reaches_its_target(spark):
    """By hand: fold 0 trains on a negative at 0.5 (FAR 1 from 0.75 on), fold 1 on one at 0.3 (from 0.5 on)."""
    pairs = spark.createDataFrame([(0, 0.1, True), (1, 0.3, False), (2, 0.2, True), (3, 0.5, False)], "pair_id long, dist double, is_same boolean")
    r = M.tar_at_far(pairs, 1.0, 0.25, 2).first()
    assert (r.tar, r.tar_std, r.far) == (1.0, 0.0, 0.5)
    assert M.tar_at_far(pairs.filter("is_same"), 1.0, 0.25, 2).first().tar == 0.0


def test_membership_ends_with_the_largest_size(spark):
    rows = spark.createDataFrame([(k,) for k, n in enumerate((1, 1, 3, 7)) for _ in range(n)], "k long")
    assert [(r.lo, r.n) for r in T.membership_histogram(rows, "k").orderBy("lo").collect()] == [(1, 2), (2, 1), (6, 1), (7, 0)]
    assert T.membership_histogram(rows.limit(0), "k").collect() == []


def test_files(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(1000, 6)).astype(np.float32)
    (tmp_path / "m.bin").write_bytes(x.tobytes())
    rows = files.read_matrix(spark, str(tmp_path / "m.bin"), 6, rows_a_part=128)
    got = {r.id: r.vec for r in rows.collect()}
    assert np.allclose([got[i] for i in range(1000)], x)
    files.write_matrix(rows, f"{tmp_path}/parts")
    back = {r.id: r.vec for r in files.read_matrix_parts(spark, f"{tmp_path}/parts", 6).collect()}
    assert back == got
    (tmp_path / "l.meta").write_text("3\n1\n1\n")
    assert [(r.id, r.label) for r in files.read_labels(spark, str(tmp_path / "l.meta")).orderBy("id").collect()] == [(0, 3), (1, 1), (2, 1)]
    (tmp_path / "a.json").write_text('{"labels": {"f1": {"label": 2, "mask": 0.5}}, "ignore": ["1,2"]}')
    labels, ignored = files.read_annotations(spark, str(tmp_path / "a.json"))
    assert labels.first().label == 2 and tuple(ignored.first()) == (1, 2)
    assert '"f1":{"label":2' in files.annotations_json(labels.select("name", "label")).first().value
    (tmp_path / "e.json").write_text('{"matches": {"1,2": 0.25}}')
    assert tuple(files.read_matches(spark, str(tmp_path / "e.json")).first()) == (1, 2, 0.25)
    (tmp_path / "d.csv").write_text('name,confidence,box,left_eye,right_eye,nose,mouth_left,mouth_right,image,face,crop\nf,0.9,"[1, 2, 3, 4]","(1, 2)","(3, 4)","(5, 6)","(7, 8)","(9, 10)","(720, 1280, 3)","(10, 10, 3)","(20, 20, 3)"\n')
    d = files.read_detections(spark, str(tmp_path / "d.csv")).first()
    assert d.box == [1, 2, 3, 4] and d.landmarks.nose.y == 6 and d.image == [720, 1280, 3]
    (tmp_path / "pairs.txt").write_text("10\t300\nA_B 1 4\nA_B 1 C_D 2\n")
    pairs = files.read_pairs(spark, str(tmp_path / "pairs.txt")).orderBy("pair_id").collect()
    assert [(p.first, p.second, p.is_same) for p in pairs] == [("A_B/A_B_0001.jpg", "A_B/A_B_0004.jpg", True), ("A_B/A_B_0001.jpg", "C_D/C_D_0002.jpg", False)]
    (tmp_path / "run.log").write_text("2023-05-25 10:08:42\tINFO\tstart\n")
    assert files.read_log(spark, str(tmp_path / "run.log")).first().level == "INFO"
    (tmp_path / "frames").mkdir()
    for n in ("c_frame_20230525100138412614.png", "bad.png", "c_frame_20230525100139000000.png"):
        (tmp_path / "frames" / n).write_bytes(b"x")
    frames = files.read_frames(spark, str(tmp_path / "frames"))
    assert frames.count() == 2 and files.next_batch(frames.select("name"), "c_frame_20230525100138412614.png", 5).count() == 1
    parts = spark.createDataFrame([("a", "p1", 1), ("a", "p2", 2), ("b", "p1", 3)], "name string, file string, v int")
    assert {(r.name, r.v) for r in files.merge_parts(parts).collect()} == {("a", 2), ("b", 3)}


def test_adapters(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string")
    got = df.select(adapters.represent(F.col("text"), "hashing").alias("v")).collect()
    assert np.linalg.norm(got[0].v) == pytest.approx(1) and not any(got[1].v)
    found = adapters.detect(df, "id", "text", lambda: lambda t: [{"word": w} for w in t.split()], "word string").collect()
    assert [(r.id, r.place, r.word) for r in found] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "a")]
    with pytest.raises(ValueError):
        adapters.get_model("none")
    flat, edge = np.zeros((20, 20)), np.pad(np.full((10, 10), 200.0), 5)
    assert adapters.blur_score(flat) == 0 < adapters.blur_score(edge) and adapters.emptiness(flat) == 1 > adapters.emptiness(edge)
    assert adapters.center_crop(edge, 0.25).shape == (10, 10) and adapters.padded_crop(edge, (5, 5, 10, 10)).shape == (20, 20)


def test_nothing_outside_imports_the_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "prismata"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "llm" in p.read_text()]


def test_proposals_search_neighbours_once(spark, sf, monkeypatch):
    """nms reads members several times; what they come from must not be searched again for each."""
    from prismata.plans import similarity as plans

    runs = spark.sparkContext.accumulator(0)

    def counted(spark, sf_dir, k=10, knn=plans._knn):
        def count(batches):
            for batch in batches:
                runs.add(batch.num_rows)
                yield batch

        found = knn(spark, sf_dir, k)
        return found.mapInArrow(count, found.schema)

    monkeypatch.setattr(plans, "_knn", counted)
    got = plans.nms_iou(spark, sf).collect()
    assert got and runs.value == 10 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
