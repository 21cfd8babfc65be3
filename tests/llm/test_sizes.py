"""What keeps the operators small on large groups: where rows meet, and what leaves a join."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from prismata.llm import common, jaccard, lines, warc

from .helpers import prose, table


def test_lines_run_no_python(spark, monkeypatch):
    frame = type(spark.range(0))

    def refuse(self, *args, **options):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr(frame, "mapInArrow", refuse)
    long = prose(31, 90)
    docs = table(spark, [(1, "first line here\n" + long, "", 0), (2, "First  line HERE!\n" + long.replace(long.split()[40], "changed"), "", 0), (3, None, "", 0)])
    got = {r.doc_id: (r.text, r.line_n_removed) for r in lines.dedup_lines(docs).collect()}
    assert got == {1: ("first line here\n" + long, 0), 2: ("", 2), 3: (None, 0)}


def test_lines_with_many_edits_are_judged_whole(spark):
    """Copies of over CARRIED characters with a share of words changed, on either side of the threshold."""
    base = prose(32, 200).split()
    near = [f"q{w}" if i % 8 == 0 else w for i, w in enumerate(base)]
    far = [w[::-1] if i >= 120 else w for i, w in enumerate(base)]
    docs = table(spark, [(i, " ".join(x), "", 0) for i, x in enumerate((base, near, far))])
    assert [r.line_n_removed for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1, 0]


def test_folded_maps_rule_pairs_out_in_the_join(spark):
    r = np.random.default_rng(3)
    x = r.integers(1, 2**63, 700, dtype=np.uint64)
    y, z = np.concatenate([x[:690], x[:0], r.integers(1, 2**63, 10, dtype=np.uint64)]), np.concatenate([x[:400], r.integers(1, 2**63, 300, dtype=np.uint64)])
    maps = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([jaccard.parity(s) for s in (x, y, z)])], ["key", "map"])
    (folds,) = jaccard._folded(iter([maps]))
    fx, fy, fz = (list(row.values())[1:] for row in folds.to_pylist())
    assert sum((int(a) ^ int(b)).bit_count() if (a ^ b) >= 0 else ((a ^ b) & (1 << 64) - 1).bit_count() for a, b in zip(fx, fy, strict=True)) <= 20
    cols = [*(f"{c}{s}" for s in "xy" for c in ("n", "p", "before", *jaccard.FOLDS))]
    row = lambda f, n: (n, 0, 0, *f)
    small = [(1 << i) - 1 for i in range(len(fx))]
    rows = [(*row(fx, 700), *row(fy, 700)), (*row(small, 60), *row([~v for v in small], 60))]
    df = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in cols))
    assert [v for (v,) in df.select(jaccard._bounded(80)).collect()] == [True, False]


def test_copies_of_a_page_never_meet_with_their_payload(spark, monkeypatch, tmp_path):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans = []
    stored = common.stored
    monkeypatch.setattr(common, "stored", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stored(df, *a))
    try:
        page = "copied " * 40
        pages = spark.createDataFrame([(i, f"http://a/{i}", page if i % 2 else f"own {i} " * 30) for i in range(40)], "page_id long, url string, html string")
        files = warc.write_warc(pages, f"file://{tmp_path}/warc")
        got = {r.name.rpartition(":")[2]: (r.kind, r.refers_to) for r in warc.read_warc(spark, files).select("name", "kind", F.substring_index("refers_to", ":", -1).alias("refers_to")).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {str(i): ("revisit", "1") if i % 2 and i > 1 else ("response", None) for i in range(40)}
    dealt = [line for line in plans[0].splitlines() if "Exchange hashpartitioning(" in line]
    assert dealt and any("hashpartitioning(page_id" in line for line in dealt)


def test_line_tables_go_once_they_are_read(spark, monkeypatch, tmp_path):
    """While lines are compared, neither the table of all lines nor the keys stay on disk, and texts are kept without sketches."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    there, columns = {}, {}
    stored = common.stored

    def watched(df, name, compression=None):
        out = stored(df, name, compression)
        there[name] = {p.name.rpartition("-")[0] for p in (tmp_path / "prismata").iterdir() if any(p.iterdir())}
        columns[name] = out.columns
        return out

    monkeypatch.setattr(common, "stored", watched)
    base = prose(33, 90)
    docs = table(spark, [(i, base.replace(base.split()[i], f"w{i}"), "", 0) for i in range(4)])
    assert [r.line_n_removed for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [0, 1, 1, 1]
    assert not there["line-pairs"] & {"lines", "line-keys"}
    assert columns["line-texts"] == ["id", "n", "norm"]


def test_sums_of_pieces_are_upper_bounds(spark):
    """Never under the edit distance, and near it where words changed, so that most copies need no whole band."""
    rows = []
    for i in range(40):
        base = prose(8000 + i, 120 + 10 * i).split()
        rows.append((" ".join(base), " ".join(f"é{w[::-1]}" if (j * 7 + i) % 9 == 0 else w for j, w in enumerate(base))))
        rows.append((" ".join(base), prose(9000 + i, 140)))
        rows.append((" ".join(base), " ".join(base[60:] + base[:60])))
    pairs = spark.createDataFrame(rows, "x string, y string").withColumn("n", F.greatest(F.char_length("x"), F.char_length("y")))
    got = pairs.select("n", F.levenshtein("x", "y").alias("d"), F.expr(lines.pieces_apart("x", "y")).alias("most"), lines.similar("x", "y", "n").alias("s")).collect()
    assert all(r.most >= r.d and r.s == (5 * r.d <= r.n) for r in got)
    near = [r for r in got if 5 * r.d <= r.n]
    assert len(near) >= 40 and sum(5 * r.most <= r.n for r in near) >= 0.9 * len(near)


def test_large_lists_make_no_rows_of_pairs_that_differ(spark, monkeypatch):
    """Long lines around one passage share keys but few are similar: what differs never becomes a row, what is similar is found."""
    made = []
    stored = common.stored

    def watched(df, name, compression=None):
        out = stored(df, name, compression)
        if name == "line-pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(common, "stored", watched)
    passage = prose(51, 40)
    around = [f"{prose(5000 + i, 16)} {passage} {prose(7000 + i, 16)}" for i in range(150)]
    copies = [x.replace(x.split()[3], "changed") for x in around[:20]]
    docs = table(spark, [(i, x, "", 0) for i, x in enumerate([*around, *copies])])
    gone = [r.line_n_removed for r in lines.dedup_lines(docs).orderBy("doc_id").collect()]
    assert gone == [0] * 150 + [1] * 20
    assert sum(made) < 170 * 10, made


def test_copies_of_large_lists_grow_with_the_entries(spark, monkeypatch):
    """A list that is dealt to several tasks has its rows copied to each: three times the lines are about three times the rows."""
    monkeypatch.setattr(lines, "SMALL", 4)
    monkeypatch.setattr(lines, "SPREAD", 1)
    monkeypatch.setattr(lines, "PAIRS_AN_ENTRY", 10**9)
    context = spark.sparkContext
    passage = prose(51, 40)

    def dealt(n):
        def total():
            context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), None)
            return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

        docs = table(spark, [(i, f"{prose(5000 + i, 16)} {passage} {prose(7000 + i, 16)}", "", 0) for i in range(n)])
        before = total()
        assert lines.dedup_lines(docs).filter("line_n_removed > 0").count() == 0
        return sum(m for k, m in total().items() if k not in before)

    few, many = dealt(40), dealt(120)
    assert many < 4.5 * few, (few, many)


def test_lines_in_turns_are_the_same(spark, monkeypatch):
    """What is dealt out in turns links the same lines; no turn's rows are lost or taken twice."""
    monkeypatch.setattr(lines, "SMALL", 8)
    monkeypatch.setattr(lines, "PAIRS_AN_ENTRY", 10**9)
    monkeypatch.setattr(lines, "TURN", 100)
    monkeypatch.setattr(lines, "TURNS", 2)
    turned = []
    in_turns = common.stored_in_turns
    monkeypatch.setattr(common, "stored_in_turns", lambda frames, name, *a: turned.append(name) or in_turns(frames, name, *a))
    passage = prose(52, 30)
    around = [f"{prose(5500 + i, 12)} {passage} {prose(7500 + i, 12)}" for i in range(30)]
    copies = [x.replace(x.split()[3], "changed") for x in around[:10]]
    short = ["call number one now", "write a letter home", "call number ones now", "write the letter home!"]
    docs = table(spark, [(i, x, "", 0) for i, x in enumerate([*around, *copies, *short])])
    assert [r.line_n_removed for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [0] * 30 + [1] * 10 + [0, 0, 1, 1]
    assert {"line-texts", "line-entries", "line-pairs", "line-open"} <= set(turned)


def test_strings_at_fitting_places(spark):
    """Texts within the limit have a string where an alignment can have it; one passage at other places is not enough."""
    rows = []
    for i in range(30):
        base = prose(600 + i, 60).split()
        near = [w if j % 6 else w + "é" for j, w in enumerate(base)]
        rows.append((" ".join(base), " ".join(near[2:] + ["added", "words"]), True))
        rows.append((" ".join(base[:25] + prose(700 + i, 35).split()), " ".join(prose(800 + i, 35).split() + base[:25]), False))
    pairs = spark.createDataFrame(rows, "x string, y string, same boolean").withColumn("n", F.greatest(F.char_length("x"), F.char_length("y")))
    got = pairs.withColumn("limit", F.expr("cast(n div 5 AS int)")).select("same", F.expr(lines.anchored("x", "y", "limit")).alias("at"), (F.levenshtein("x", "y") * 5 <= F.col("n")).alias("d"), lines.similar("x", "y", "n", rare=True).alias("s")).collect()
    assert all(r.same == r.at == r.d == r.s for r in got)
