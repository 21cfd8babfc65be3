"""Registered queries that take whole tables, against plain Python."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__
from prismata.plans import similarity


def test_components_of_all_orders(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect()
    parent = {r.l_partkey: r.l_partkey for r in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    first = {}
    for order, part in rows:
        x, y = find(first.setdefault(order, part)), find(part)
        parent[max(x, y)] = min(x, y)
    got = __spark_entry__.queries()["connected_components"](spark, sf).collect()
    assert {r.id: r.component for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)


def test_components_keep_groups_apart(spark, tmp_path):
    """Orders beyond key 2000 and parts that 5 does not divide count too."""
    lines = [(1, 10), (1, 11), (5000, 11), (5000, 12), (7000, 21), (7000, 22), (8000, 31), (8001, 41), (8001, 40)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = __spark_entry__.queries()["connected_components"](spark, str(tmp_path)).collect()
    assert {r.id: r.component for r in got} == {10: 10, 11: 10, 12: 10, 21: 21, 22: 21, 31: 31, 40: 40, 41: 40}


def test_proposals_of_all_rows(spark, sf):
    run = lambda name: __spark_entry__.queries()[name](spark, sf).collect()
    rows = {r.vec_id: r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label").collect()}
    knn = run("knn_topk")
    members, sims = {}, {}
    for r in knn:
        members.setdefault(r.src, {r.src}).add(r.dst)
        sims.setdefault(r.src, []).append(1 - r.dist)
    assert members.keys() == rows.keys()
    score = {p: sum(x) / len(x) for p, x in sims.items()}
    assert {(r.proposal_id, r.size) for r in run("stat_cluster")} == {(p, len(m)) for p, m in members.items()}
    pairs = {(min(r.src, r.dst), max(r.src, r.dst)) for r in knn}
    assert {(r.proposal_id, r.src, r.dst) for r in run("proposals_edges")} == {(p, a, b) for p, m in members.items() for a, b in pairs if a in m and b in m}
    best = {r.node: r.proposal_id for r in run("nms_first")}
    assert best.keys() == rows.keys() and all(n in members[p] and score[p] >= max(score[q] for q, m in members.items() if n in m) - 1e-5 for n, p in best.items())
    iou = lambda a, b: len(members[a] & members[b]) / len(members[a] | members[b])
    exact = {r.proposal_id: r.score for r in similarity._proposals(spark, sf)[1].collect()}
    kept, want = [], {}
    for p in sorted(members, key=lambda p: (-exact[p], p)):
        if all(iou(p, q) <= 0.1 for q in kept):
            kept.append(p)
            for n in members[p]:
                want.setdefault(n, p)
    assert {r.node: r.proposal_id for r in run("nms_iou")} == want and any(p % 5 for p in kept)
    good = {n: p for n, p in best.items() if score[p] >= 0.3 + 1e-5}
    groups = {r.id: r.component for r in run("deoverlap")}
    assert groups.keys() == rows.keys() and all(groups[n] == min(m for m, q in good.items() if q == p) for n, p in good.items())
    sizes = {}
    for label in rows.values():
        sizes[label] = sizes.get(label, 0) + 1
    ids = sorted(i for i, label in rows.items() if sizes[label] >= sum(sizes.values()) / len(sizes))
    number = {i: n for n, i in enumerate(ids)}
    assert {(r.src, r.dst) for r in run("sub_graph")} == {(number[r.src], number[r.dst]) for r in knn if r.src in number and r.dst in number}


def test_having_filters_add_rows_in_order(spark, tmp_path):
    """Sums of doubles depend on their order: rows dealt over files give what SQL adds up in the order of the rows."""
    import duckdb

    digits = np.random.default_rng(3).integers(0, 10, (400, 28))
    digits[:, -1] += 126 - digits.sum(1)  # the mean is 0.045, but for noise
    rows = [(p, o, float(x) / 100) for o, line in enumerate(digits.T) for p, x in enumerate(line)] + [(None, 99, 0.25)] * 25 + [(1000, 99, None)] * 25
    for k in range(7):
        part = pa.table(dict(zip(("l_partkey", "l_orderkey", "l_discount"), map(list, zip(*rows[k * len(rows) // 7 : (k + 1) * len(rows) // 7], strict=True)), strict=True)), pa.schema([("l_partkey", pa.int64()), ("l_orderkey", pa.int64()), ("l_discount", pa.float64())]))
        (tmp_path / "lineitem.parquet").mkdir(exist_ok=True)
        pq.write_table(part, tmp_path / "lineitem.parquet" / f"part-{k}.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = set(con.execute(__spark_entry__.oracle_sql()["having_filters"]).fetchall())
    assert {tuple(r) for r in __spark_entry__.queries()["having_filters"](spark, str(tmp_path)).collect()} == want and 40 < len(want) < 360
