"""Properties of the core: recovery of known trees, identities, exact restore, files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from colforest.functions import codes as C
from colforest.operators import kinds as K
from colforest.operators import models as M
from colforest.operators import pairs as P
from colforest.operators import profile as R
from colforest.operators import segments as S
from colforest.plans import forest as G
from colforest.plans import report as Z
from colforest.sources import delimited as D
from colforest.sources import synthetic as Y
from colforest.sources.tables import numbered

TREES = [
    (2_000, 5, 5, [(0, 1), (0, 2), (1, 3), (2, 4)], 0.25),
    (5_000, 10, 7, [(0, 1), (0, 2), (1, 3), (2, 4), (5, 6), (5, 7), (6, 8), (8, 9)], 0.70),
    (20_000, 15, 8, [(0, 1), (0, 2), (1, 3), (1, 4), (2, 5), (2, 6), (3, 7), (4, 8), (5, 9), (6, 10), (7, 11), (8, 12), (9, 13), (10, 14)], 0.80),
]


@pytest.mark.parametrize("rows,columns,cardinality,edges,least", TREES)
def test_tree_recovery(spark, rows, columns, cardinality, edges, least):
    data = Y.from_tree(spark, rows, edges, columns, cardinality)
    found = G.learn_forest(data, [f"col_{i}" for i in range(columns)], screen=True, key="row_id").edges
    assert found and G.recall(edges, found) >= least


def test_numeric_tree_recovery(spark):
    data = Y.from_tree(spark, 50_000, [(0, 1), (0, 2)], 3, categorical=False)
    forest = G.learn_forest(data, ["col_0", "col_1", "col_2"], mode="hashed", buckets=32)
    assert G.recall([(0, 1), (0, 2)], forest.edges) >= 0.5


def test_two_phase_sampled(spark):
    data = Y.from_tree(spark, 20_000, TREES[0][3], 5, 5)
    forest = G.learn_forest(data, [f"col_{i}" for i in range(5)], two_phase=True, key="row_id", mode="auto")
    assert G.recall(TREES[0][3], forest.edges) >= 0.75


def test_measured_charge(spark):
    data = Y.from_tree(spark, 5_000, TREES[1][3], 10, 7)
    forest = G.learn_forest(data, [f"col_{i}" for i in range(10)], charge=P.measured_bits)
    assert G.recall(TREES[1][3], forest.edges) >= 0.7


def test_information_identities(spark):
    df = Y.noisy_pair(spark, 3_000, 2.0).withColumn("again", F.col("parent"))
    e = {(r.i, r.j): r for r in R.pair_entropies(df, ["parent", "child", "again"]).collect()}
    assert e[0, 2].mi_bits == pytest.approx(e[0, 2].h_x)
    assert e[0, 1].mi_bits == pytest.approx(e[1, 2].mi_bits)
    assert all(-1e-9 <= r.mi_bits <= min(r.h_x, r.h_y) + 1e-9 for r in e.values())
    scores = {(r.i, r.j): r.mi / P.LN2 for r in P.pair_scores(P.pair_histogram(df, ["parent", "child", "again"])).collect()}
    assert scores[0, 1] == pytest.approx(e[0, 1].mi_bits)


def test_forest_helpers():
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (3, 4, -1.0)]
    assert G.maximum_forest(5, edges) == [(0, 1, 1.0), (0, 2, 1.0)]
    assert G.orient(5, [(1, 2, 1.0), (0, 2, 1.0)]) == [-1, 2, 0, -1, -1]
    assert G.depths([-1, 2, 0, -1, -1]) == [0, 2, 1, 0, 0]
    assert G.maximum_forest(3, []) == [] and G.recall([], []) == 1.0
    assert [G.phase_rows(n, 1) for n in (500, 5_000, 50_000, 500_000, 5_000_000)] == [500, 2_500, 5_000, 25_000, 100_000]
    assert [G.phase_rows(n, 2) for n in (5_000, 50_000, 500_000, 5_000_000)] == [5_000, 20_000, 50_000, 200_000]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert G.learn_forest(empty, ["a", "b"]).edges == []
    assert P.pair_histogram(empty, ["a"]).count() == 0
    one = spark.createDataFrame([("x", None)], "a string, b string")
    assert P.pair_histogram(one, ["a", "b"]).first().y == ""


ODD = [None, "", "nan", "None", "007", "+5", " 7", "-0", "1.0", "1.50", "1e5", "1_000", "1d", "0x10", "inf", "9007199254740993", "9223372036854775808", "2025-01-01 00:18:38", "2025-01-01T00:18:38", "2025/01/01 00:18:38", "2025-01-01 00:18:38.5", "2025-01-01T00:18:38+0200", "a,b", 'q"q', "line\nbreak"]


def test_exact_restore_of_odd_cells(spark):
    rows = [(i, ODD[i % len(ODD)], str(i % 7), f"{i / 100:.2f}", f"2025-01-01 00:00:{i % 60:02d}", "constant", f"id{i}", "3.50" if i % 5 else str(i), ODD[i % len(ODD)] if i % 11 == 0 else str(i * 10**15)) for i in range(600)]
    df = spark.createDataFrame(rows, "k long, odd string, small string, price string, stamp string, same string, unique string, mostly string, mixed string")
    cols = df.columns[1:]
    back = S.round_trip(df, "k", cols, stripe=128)
    assert [tuple(r[c] for c in cols) for r in back.orderBy("row_id").collect()] == [r[1:] for r in rows]


@pytest.mark.parametrize("n", [0, 1])
def test_restore_of_tiny_tables(spark, n):
    df = spark.createDataFrame([(i, "x", str(i)) for i in range(n)], "k long, a string, b string")
    assert S.round_trip(df, "k", ["a", "b"]).count() == n


def test_restore_along_a_chain(spark, tmp_path):
    df = Y.from_tree(spark, 2_000, TREES[0][3], 5, 6)
    cols = [f"col_{i}" for i in range(5)]
    S.write_archive(df, str(tmp_path / "a"), cols, "row_id", forest="chain", stripe=500)
    back = S.read_archive(spark, str(tmp_path / "a"))
    assert S.same_content(back.select("row_id", *cols), df.select("row_id", *[F.col(c).cast("string") for c in cols]))
    s = S.archive_statistics(spark, str(tmp_path / "a")).first()
    assert s.n_edges == 4 and s.payload_bytes > 0


@pytest.mark.parametrize("coder", ["model", "neural", "autoregressive"])
def test_restore_with_models(spark, coder):
    df = Y.from_tree(spark, 1_500, TREES[0][3], 5, 6).withColumn("rare", F.when(F.col("row_id") % 500 == 3, F.col("row_id")).otherwise(F.col("col_1")))
    cols = [f"col_{i}" for i in range(5)] + ["rare"]
    back = S.round_trip(df, "row_id", cols, stripe=400, coder=coder, epochs=8, max_rows=400)
    assert S.same_content(back.select("row_id", *cols), df.select("row_id", *[F.col(c).cast("string") for c in cols]))


@pytest.mark.parametrize("values", [[], [5], [0] * 50, list(range(100)), [-(2**63), 2**63 - 1, 0, -1] * 3, [1, 1, 1, 9] * 20, [7] * 30 + [8] * 40])
def test_codecs(values):
    v = np.array(values, dtype=np.int64)
    assert np.array_equal(S.from_varints(S.varints(v)) if len(v) else v, v)
    codec, body = S.encode_ints(v)
    assert np.array_equal(S.decode_ints(codec, body), v)


def test_code_lengths(spark):
    rows = {r.v: r for r in spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 10, 11, 100)], "v long").select("v", C.gamma_bits(F.col("v")).alias("g"), C.golomb_bits(F.col("v"), F.lit(10)).alias("b"), C.zigzag(-F.col("v")).alias("z")).collect()}
    assert [rows[v].g for v in (0, 1, 2, 3, 4)] == [1, 1, 3, 3, 5]
    assert [rows[v].b for v in (1, 10, 11, 100)] == [4, 5, 5, 14]
    assert [rows[v].z for v in (0, 1, 2)] == [0, 1, 3]


def test_rare_limits():
    assert K.rare_limits(50_000, 10) == (0.01, 1)
    assert K.rare_limits(500_000, 20_000) == (0.0002, 50)
    assert K.rare_limits(2_000_000, 6_000) == (0.0003, 20)
    assert K.rare_limits(50_001, 2_001) == (0.002, 8)


def test_kinds(spark):
    df = spark.createDataFrame([(str(i), f"{i}.25", f"{i}.{i}123456789", f"2025-01-01 00:00:{i:02d}", "abc") for i in range(1, 50)], "a string, b string, c string, d string, e string")
    kinds = K.infer_kinds(df, df.columns)
    assert [kinds[c].name for c in df.columns] == ["integer", "decimal", "float", "timestamp", "categorical"]
    assert kinds["b"].digits == 2 and kinds["b"].scale == 4


def test_model(spark):
    df = spark.range(1_000).select("id", (F.col("id") % 10).alias("parent"), (F.col("id") % 10 % 5).alias("child"))
    net = M.train(df, ["parent"], "child", "id", epochs=40)
    again = M.Net.from_bytes(net.to_bytes())
    ids = np.arange(10)[:, None]
    np.testing.assert_allclose(net.logits(ids), again.logits(ids), rtol=1e-2, atol=1e-3)
    assert 0 < net.model_bits < 1e6
    from colforest.operators.ranker import nll_bits

    assert nll_bits(df, "parent", "child", M.model_table(spark, net)).first().bits < 10 * 1_000
    coded = M.with_ranks(df, ["parent"], "child", net)
    assert M.from_ranks(coded.drop("child"), ["parent"], "child", net).where("child != id % 10 % 5").count() == 0
    assert M.averaged(df, ["parent"], "child", net).groupBy("p").agg(F.sum("prob").alias("s")).where("abs(s - 1) > 1e-6").count() == 0
    assert M.train(df.limit(50), ["parent"], "child", "id") is None


def test_text_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes(b'h1,h2,h3\r\n1,,3\r\n4,5\r\n6,7,8,9\r\n6,7,8,\r\n"a,b","c\r\nd",e\r\n')
    assert D.line_ending(spark, str(path)) == "\r\n"
    rows = [tuple(r) for r in D.scan(spark, str(path)).orderBy("row_id").select("c0", "c1", "c2").collect()]
    assert [r for r in rows if r[0] != "a,b"] == [("h1", "h2", "h3"), ("1", "", "3"), ("4", "5", "")]
    assert any(r[0] == "a,b" and r[2] == "e" for r in rows)
    D.write_text(D.scan(spark, str(path)), str(tmp_path / "out"), order="row_id", one_file=True)
    back = D.scan(spark, str(tmp_path / "out"))
    assert [tuple(r) for r in back.orderBy("row_id").select("c0", "c1", "c2").collect()] == rows
    assert D.delimiter_of(r"\t") == "\t"


def test_prepare_and_results(spark, tmp_path):
    (tmp_path / "raw.txt").write_text("1; a ;?\n2;NA;0.5\n3;c;7\n")
    D.prepare_file(spark, str(tmp_path / "raw.txt"), str(tmp_path / "clean"))
    assert D.scan(spark, str(tmp_path / "clean")).count() == 4
    res = spark.createDataFrame([("d", "m", "1.5", "None"), ("e", "m", "", "2")], "dataset string, method string, ratio string, time string")
    D.append_results(res, str(tmp_path / "res"), res.columns)
    got = D.read_results(spark, str(tmp_path / "res")).orderBy("dataset").collect()
    assert [(r.ratio, r.time) for r in got] == [(1.5, None), (None, 2.0)]
    assert D.not_done(res, res.where("dataset = 'd'"), ["dataset"]).count() == 1
    for name in ("a/x.csv", "a/x_sample.csv", "b/y.csv", "b/y_restored.csv"):
        (tmp_path / "sets" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "sets" / name).write_text("1\n")
    assert [p.rsplit("/", 1)[1] for p in D.find_datasets(spark, str(tmp_path / "sets"))] == ["x_sample.csv", "y.csv"]
    D.parquet_to_text(spark, _parquet(spark, tmp_path), str(tmp_path / "text"))
    assert D.scan(spark, str(tmp_path / "text")).count() >= 4


def test_several_files(spark, tmp_path):
    """A folder of files of unequal size keeps the order of its files, archived and restored too; only a table with
    line breaks in its cells is read in one task a file."""
    folder = tmp_path / "many"
    folder.mkdir()
    sizes = [3, 4_000, 1, 250]
    lines = [f"{k},{i},{'x' * (i % 50)}" for k, n in enumerate(sizes) for i in range(n)]
    done = 0
    for k, n in enumerate(sizes):
        (folder / f"part-{k}.csv").write_text("\n".join(lines[done : done + n]) + "\n")
        done += n
    assert not D.breaks_in_cells(spark, str(folder))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        rows = D.scan(spark, str(folder))
        assert D.scan(spark, str(folder), row_ids=False).rdd.getNumPartitions() > len(sizes)
        assert [",".join((r.c0, r.c1, r.c2)) for r in rows.orderBy("row_id").collect()] == lines
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    S.write_archive(rows, str(tmp_path / "kept"), ["c0", "c1", "c2"], "row_id", stripe=512)
    assert [",".join((r.c0, r.c1, r.c2)) for r in S.read_archive(spark, str(tmp_path / "kept")).orderBy("row_id").collect()] == lines
    (folder / "part-4.csv").write_text('4,"a\nb",c\n')
    assert D.breaks_in_cells(spark, str(folder))
    assert D.scan(spark, str(folder)).where("c0 = 4").select("c1").first().c1 == "a\nb"


def test_unseen_values(spark):
    """A model trained on fewer rows than there are classes still codes every row, in any batches."""
    rows = [(i, f"p{i % 7}", f"c{i % 211}" if i % 3 else None) for i in range(2_000)]
    df = spark.createDataFrame(rows, "id long, parent string, child string").repartition(5)
    net = M.train(df, ["parent"], "child", "id", max_rows=120, epochs=2)
    assert net is not None and len(net.children) < 142
    coded = M.with_ranks(df, ["parent"], "child", net)
    assert coded.where("unseen is not null").count() > 0
    back = M.from_ranks(coded.drop("child").repartition(3), ["parent"], "child", net)
    assert {(r.id, r.child) for r in back.collect()} == {(i, c or "") for i, _, c in rows}
    few = M.fit([["a"] * 60 + ["b"] * 40 + [f"v{i}" for i in range(20)]], ["x", "y"] * 60, epochs=1, most_values=2)
    assert few.parents == [["a", "b"]]


def test_bins_and_quantiles(spark):
    values = [float(x) for x in range(-50, 50)] + [1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for edges in ([], [0.0], [float(e) for e in range(-40, 40, 3)], [float(e) for e in range(-100, 155)]):
        got = {r.v: r.b for r in df.select("v", P.bin_of(F.col("v"), edges).alias("b")).collect()}
        assert got == {v: sum(e <= v for e in edges) for v in values}
    assert R.exact_quantiles(df, "v", (0.0, 0.5, 0.99, 1.0)) == pytest.approx(np.quantile(values, (0.0, 0.5, 0.99, 1.0)).tolist())
    assert R.exact_quantiles(df.limit(0), "v", (0.5,)) == [None]


def _parquet(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "p"))
    return str(tmp_path / "p")


def test_report_text(spark):
    text = "Original size: 10.0 MB\ngzip:\n  size: 2.5 MB ratio x4.00\n  time: 1.50s\n  throughput: 6.67 MB/s\ncolumnar zstd:\n  size: 512.0 KB ratio x20.00\n  time: 0.5s\n  throughput: 2.0 GB/s\n"
    got = Z.parse_report(spark.createDataFrame([("d", text), ("e", "nothing")], "dataset string, text string")).orderBy("method").collect()
    assert [(r.method, r.size, r.ratio, r.seconds, r.mb_s) for r in got] == [("columnar zstd", 524288, 20.0, 0.5, 2048.0), ("gzip", 2621440, 4.0, 1.5, 6.67)]
    one = spark.createDataFrame([(1.0, 2.0)], "size double, seconds double").select(C.throughput_text(F.lit(3145728), F.lit(2)).alias("a"), C.throughput_text(F.lit(1), F.lit(0)).alias("b"), C.short_label(F.lit("a" * 20)).alias("c")).first()
    assert tuple(one) == ("1.50 MB/s", "-", "a" * 15 + "...")


def test_human_bytes(spark):
    sizes = [0.0, 1023.0, 1024.0, 1280.0, 1792.0, 1.25 * 1024**3, 1024.0**4, 1.75 * 1024**4, None]
    got = spark.createDataFrame([(n,) for n in sizes], "n double").select(C.human_bytes(F.col("n")).alias("a"), C.human_bytes(F.col("n"), largest="GB").alias("b")).collect()
    assert [r.a for r in got] == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.2 GB", "1.0 TB", "1.8 TB", None]
    assert [r.b for r in got] == ["0.0 B", "1023.0 B", "1.0 KB", "1.2 KB", "1.8 KB", "1.2 GB", "1024.0 GB", "1792.0 GB", None]


def test_numbers_are_contiguous(spark):
    df = numbered(spark.range(1_000).repartition(7), ["id"])
    assert df.where("row_id <> id").count() == 0


def test_windowed_stream(spark, sf_dir, tmp_path):
    from colforest.streaming import counts as T

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    out = T.drain(T.windowed_counts(stream, ["event_type", "user_id"], "ts"), "windowed", str(tmp_path / "c"))
    assert out.agg(F.sum("c")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()


def test_command_line(spark, tmp_path, capsys):
    from colforest import cli

    (tmp_path / "t.csv").write_text("A,B,C\r\n" + "".join(f"{i % 5},{(i % 5 + i % 2) % 7},{i % 3}\r\n" for i in range(200)), newline="")
    cli.main(["compress", "--input", str(tmp_path / "t.csv"), "--output", str(tmp_path / "a"), "--mi-mode", "auto", "--profile"])
    assert "forest" in capsys.readouterr().out
    cli.main(["restore", "--input", str(tmp_path / "a"), "--output", str(tmp_path / "b")])
    parts = sorted((tmp_path / "b").glob("part-*"))
    assert b"".join(p.read_bytes() for p in parts) == (tmp_path / "t.csv").read_bytes()
    cli.main(["prepare", "--input", str(tmp_path / "t.csv"), "--output", str(tmp_path / "c"), "--has-header"])
    assert D.scan(spark, str(tmp_path / "c")).count() == 201


def test_sweep(spark, tmp_path):
    from colforest.plans import sweep

    sets = {"x": Y.from_tree(spark, 300, [(0, 1)], 2, 4), "y": Y.noisy_pair(spark, 300, 3.0)}
    got = sweep.compare(spark, sets, str(tmp_path / "r"), ["own", "chain", "gzip", "columnar gzip"])
    assert got.count() == 8 and got.where("size <= 0 or ratio is null").count() == 0
    assert sweep.compare(spark, sets, str(tmp_path / "r"), ["own", "chain", "gzip", "columnar gzip"]).count() == 8
    grid = sweep.grid(spark, sets["x"], [1, 5], [64, 256])
    assert grid.count() == 4
