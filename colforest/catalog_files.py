"""Queries on files, sources, samples, models' distributions and sweeps; see :mod:`colforest.catalog`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import BUCKETS, COND_SQL, GEO, GEO_SQL, HASHED_SQL, LINE, LINE_SQL, MEASURES, NUMERIC_SQL, ORDERS, PART, geo, load, long_sql, query, r6, score_sql
from .functions import codes as C
from .operators import kinds as K
from .operators import models as M
from .operators import pairs as P
from .operators import profile as R
from .operators import segments as S
from .plans import forest as G
from .plans import report as Z
from .plans import sweep as W
from .sources import delimited as D
from .sources import synthetic as Y
from .sources.tables import shared_path

# ---- delimited files ---------------------------------------------------------------------------------

PART_TEXT = "SELECT p_partkey::VARCHAR AS c0, p_name AS c1, p_type || ', \"' || p_brand || '\"' AS c2, row_number() OVER (ORDER BY p_partkey) - 1 AS row_id FROM part"


def _part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')).alias("kind"))


@query("text_scan", PART_TEXT)
def text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with delimiters and quotes written to a folder of files and read back in their order."""
    path = shared_path(spark, "text")
    D.write_text(_part(spark, sf_dir).repartitionByRange(5, "p_partkey").sortWithinPartitions("p_partkey"), path)
    return D.scan(spark, path)


@query("text_endings", PART_TEXT.replace(" FROM part", ", chr(13) || chr(10) AS ending FROM part"))
def text_endings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "text")
    D.write_text(_part(spark, sf_dir).withColumn("at", F.col("p_partkey")), path, order="at", ending="\r\n", one_file=True)
    return D.scan(spark, path).withColumn("ending", F.lit(D.line_ending(spark, spark.read.text(path).inputFiles()[0])))


@query("text_lines", "SELECT n_nationkey || ',' || n_name || ',' || n_regionkey AS line FROM nation")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    D.write_text(load(spark, sf_dir, "nation"), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("parquet_lines", "SELECT 'r_regionkey,r_name' AS line UNION ALL SELECT r_regionkey || ',' || r_name FROM region")
def parquet_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lines")
    D.parquet_to_text(spark, f"{sf_dir}/region.parquet", path)
    return spark.read.text(path).select(F.col("value").alias("line"))


RESULT_ROWS = "SELECT event_type AS dataset, 'm' || (user_id % 2) AS method, count(*)::DOUBLE AS original, sum(user_id)::DOUBLE AS size, 0.5::DOUBLE AS seconds FROM events GROUP BY 1, 2"


@query("result_tables", RESULT_ROWS)
def result_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result table written in two goes, a third left out as done already, and read back."""
    path = shared_path(spark, "results")
    rows = load(spark, sf_dir, "events").groupBy(F.col("event_type").alias("dataset"), F.concat(F.lit("m"), (F.col("user_id") % 2).cast("string")).alias("method")).agg(F.count("*").alias("original"), F.sum("user_id").alias("size")).withColumn("seconds", F.lit(0.5))
    for some in (rows.where("method = 'm0'"), rows):
        try:
            some = D.not_done(some, D.read_results(spark, path), ["dataset", "method"])
        except Exception as e:  # no table yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
        D.append_results(some, path, W.COLUMNS)
    return D.read_results(spark, path)


@query("dataset_discovery", "SELECT 'n_regionkey=' || n_regionkey AS dataset, count(*) AS n FROM nation GROUP BY 1")
def dataset_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "sets")
    load(spark, sf_dir, "nation").coalesce(1).write.partitionBy("n_regionkey").csv(path)
    found = D.find_datasets(spark, path)
    files = spark.createDataFrame([(f.rsplit("/", 2)[1], f) for f in found], "dataset string, file string")
    lines = spark.read.text(found).select(F.regexp_extract(F.input_file_name(), "/([^/]*)/[^/]*$", 1).alias("dataset"))
    return lines.groupBy("dataset").agg(F.count("*").alias("n")).join(files, "dataset").select("dataset", "n")


# ---- synthetic tables --------------------------------------------------------------------------------


def _uniform(seed: int, name: str) -> str:
    return f"(('0x' || substr(md5('{seed}|{name}|' || row_id), 1, 13))::BIGINT::DOUBLE / {2**52}::DOUBLE)"


def _normal(seed: int, name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {_uniform(seed, name + '/r')})) * cos(2 * pi() * {_uniform(seed, name + '/a')}))"


def _noisy(k: str, noise: float) -> str:
    return f"CASE WHEN {_uniform(3, 'u' + k)} < {1 - noise!r}::DOUBLE THEN (p + row_id % 3)::INTEGER % 20 ELSE floor({_uniform(3, 'c' + k)} * 20)::INTEGER END"


@query("synthetic_noisy_pair", f"SELECT row_id, p AS parent, {_noisy('', 1 - 2.0 / 4.321928094887363)} AS child FROM (SELECT range AS row_id, floor({_uniform(3, 'p').replace('row_id', 'range')} * 20)::INTEGER AS p FROM range(2000))")
def synthetic_noisy_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.noisy_pair(spark, 2_000, 2.0, 3)


@query("synthetic_gaussian_pair", f"SELECT row_id, round(p, 6) AS parent, round(0.8 * p + sqrt(1 - 0.8 * 0.8) * {_normal(3, 'n')}, 6) AS child FROM (SELECT row_id, {_normal(3, 'p')} AS p FROM (SELECT range AS row_id FROM range(2000)))")
def synthetic_gaussian_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.gaussian_pair(spark, 2_000, 0.8, 3).select("row_id", r6("parent"), r6("child"))


@query("synthetic_pair_sweep", "SELECT a.row_id, " + ", ".join(f"p{i} AS parent_{i}, {_noisy(str(i), min(0.95, max(0.0, 1 - 3.0 * i / 2 / 4.321928094887363))).replace('(p +', f'(p{i} +')} AS child_{i}" for i in range(3)) + " FROM (SELECT row_id, " + ", ".join(f"floor({_uniform(3, f'p{i}')} * 20)::INTEGER AS p{i}" for i in range(3)) + " FROM (SELECT range AS row_id FROM range(1000))) a")
def synthetic_pair_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.pair_sweep(spark, 1_000, 3, 3)


# ---- weights and samples -----------------------------------------------------------------------------


@query("edge_weights_hashed", f"WITH {score_sql(HASHED_SQL, 3)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(w, 6) AS w FROM score")
def edge_weights_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = load(spark, sf_dir, "orders")
    counted = G.encode_for_counting(orders, ORDERS, "hashed", BUCKETS, orders.count())
    return P.pair_scores(P.pair_histogram(counted, ORDERS)).select("i", "j", r6("w"))


GEO_SAMPLE = "(SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY md5('0|' || c_custkey), c_custkey LIMIT 100)"
GEO_PART_SQL = GEO_SQL[: GEO_SQL.index(" FROM ")] + f" FROM {GEO_SAMPLE}"


@query("edge_weights_sampled", f"WITH {score_sql(GEO_PART_SQL, 5)} SELECT i::INTEGER AS u, j::INTEGER AS v, round((SELECT count(*) FROM customer) * mi / ln(2) - bits, 6) AS w FROM score")
def edge_weights_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs weighed on a sample of rows, scaled to the whole table."""
    c, n, r = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("c_custkey", *GEO)
    forest = G.learn_forest(rows, GEO, sample=100, key="c_custkey")
    return spark.createDataFrame([(u, v, round(w, 6)) for u, v, w in forest.candidates], "u int, v int, w double")


SMALL = ["l_returnflag", "l_linestatus"]


@query("measured_charge_small", f"WITH {score_sql('SELECT l_returnflag AS c0, l_linestatus AS c1 FROM lineitem', 2)} SELECT i::INTEGER AS i, j::INTEGER AS j, bits FROM score WHERE k <= 20")
def measured_charge_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measured charge of a pair of few cells is the proxy charge."""
    return P.measured_bits(P.pair_histogram(load(spark, sf_dir, "lineitem"), SMALL))


@query("measured_charge")
def measured_charge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of a compressor: SQL has none."""
    return P.measured_bits(P.pair_histogram(load(spark, sf_dir, "lineitem"), LINE))


@query("edge_weight_matrix", f"WITH {score_sql(LINE_SQL, 6)} SELECT i::INTEGER AS i, " + ", ".join(f"round(coalesce(max(CASE WHEN j = {k} THEN w END), 0), 6) AS m{k}" for k in range(6)) + " FROM (SELECT i, j, w FROM score UNION ALL SELECT j, i, w FROM score) GROUP BY i")
def edge_weight_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.pair_scores(P.pair_histogram(load(spark, sf_dir, "lineitem"), LINE)).select("i", "j", F.col("w").alias("value"))
    return Z.matrix(scores, len(LINE)).select("i", *[F.round(f"m{k}", 6).alias(f"m{k}") for k in range(len(LINE))])


# ---- values ------------------------------------------------------------------------------------------


@query("vocabulary_cap", "SELECT p_name AS v, count(*) AS c FROM part GROUP BY 1 ORDER BY c DESC, v LIMIT 20")
def vocabulary_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.frequent_values(load(spark, sf_dir, "part"), "p_name", 20)


@query("sparse_roundtrip", "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_linestatus FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_suppkey, l_linenumber ORDER BY l_linestatus) = 1")
def sparse_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column kept as its dominant value and patches, and put together again."""
    key = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    rows = load(spark, sf_dir, "lineitem").groupBy(*key).agg(F.min("l_linestatus").alias("l_linestatus")).withColumn("row", F.concat_ws("-", *key))
    mode, patches = K.sparse_parts(rows, "row", "l_linestatus")
    return K.sparse_restored(rows.drop("l_linestatus"), "row", "l_linestatus", mode, patches).drop("row")


@query("top_parents", "WITH d AS (SELECT turn::VARCHAR AS p, role AS c, count(*) AS n FROM conversations GROUP BY ALL), w AS (SELECT c, sum(n) / (SELECT sum(n) FROM d) AS share FROM d GROUP BY c), b AS (SELECT p, sum(n) AS total FROM d GROUP BY p ORDER BY total DESC, p LIMIT 3) SELECT p, sum(n)::BIGINT AS n, arg_min(d.c, (-n, d.c)) AS top_child, round(sum(n / total * ln(n / total / share)), 6) AS kl FROM d JOIN b USING (p) JOIN w ON w.c = d.c GROUP BY p")
def top_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_parents(load(spark, sf_dir, "conversations"), "turn", "role").select("p", "n", "top_child", r6("kl"))


TABLES = {"part": PART, "lineitem": MEASURES, "nation": ["n_nationkey", "n_name", "n_regionkey"]}


@query("dataset_characteristics", " UNION ALL ".join(f"SELECT '{t}' AS dataset, (SELECT count(*) FROM {t}) AS n_rows, n_columns, b.bytes, share AS numeric_share FROM ({NUMERIC_SQL.replace('{src}', long_sql(t, c))}), (SELECT (sum({' + '.join(f'strlen({x}::VARCHAR)' for x in c)}) + {len(c)} * count(*))::BIGINT AS bytes FROM {t}) b" for t, c in TABLES.items() if t != "lineitem"))
def dataset_characteristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in TABLES.items():
        if t != "lineitem":  # SQL engines spell doubles in ways of their own
            one = R.characteristics(load(spark, sf_dir, t).select(*c)).select(F.lit(t).alias("dataset"), "n_rows", "n_columns", "bytes", "numeric_share")
            out = one if out is None else out.unionByName(one)
    return out


@query("unit_parsing", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN floor(q) WHEN 1 THEN floor(q * 1024) WHEN 2 THEN floor(q * 1048576) ELSE NULL END::BIGINT AS bytes, CASE o_orderkey % 3 WHEN 0 THEN round(q / 1024, 6) WHEN 1 THEN q ELSE q * 1024 END AS mb_s FROM (SELECT o_orderkey, (o_orderkey % 1000)::DOUBLE / 4 AS q FROM orders)")
def unit_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.format_string("%.2f", (F.col("o_orderkey") % 1000) / 4.0)
    unit = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names) + 1).cast("int"))
    return load(spark, sf_dir, "orders").select("o_orderkey", C.parse_bytes(F.concat(q, F.lit(" "), unit("B", "KB", "MB", "x"))).alias("bytes"), F.round(C.parse_throughput(F.concat(q, F.lit(" "), unit("KB/s", "MB/s", "GB/s"))), 6).alias("mb_s"))


@query("report_parsing", "SELECT s_suppkey::VARCHAR AS dataset, 'm' || (s_suppkey % 5) AS method, (s_suppkey * 512)::BIGINT AS size, ((s_suppkey % 7) + 0.25)::DOUBLE AS ratio, ((s_suppkey % 9) + 0.5)::DOUBLE AS seconds, ((s_suppkey % 11) * 1024)::DOUBLE AS mb_s FROM supplier")
def report_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    text = F.format_string("Original size: 1.0 MB\nm%d:\n  size: %.1f KB ratio x%.2f\n  time: %.2fs\n  throughput: %.1f GB/s\n", k % 5, k / 2.0, k % 7 + 0.25, k % 9 + 0.5, (k % 11).cast("double"))
    return Z.parse_report(load(spark, sf_dir, "supplier").select(k.cast("string").alias("dataset"), text.alias("text")))


@query("same_content", "SELECT 'order' AS test, count(*) = 0 AS same FROM (SELECT * FROM part EXCEPT ALL SELECT * FROM part) UNION ALL SELECT 'row', (SELECT count(*) FROM (SELECT p_brand FROM part EXCEPT ALL SELECT p_brand FROM part WHERE p_partkey > 1)) = 0 UNION ALL SELECT 'cell', (SELECT count(*) FROM (SELECT p_partkey, p_size FROM part EXCEPT ALL SELECT p_partkey, p_size + (p_partkey = 1)::INTEGER FROM part)) = 0")
def same_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = load(spark, sf_dir, "part")
    cells = part.select("p_partkey", "p_size")
    changed = cells.withColumn("p_size", F.col("p_size") + (F.col("p_partkey") == 1).cast("int"))
    out = [("order", S.same_content(part, part.repartition(7))), ("row", S.same_content(part.select("p_brand"), part.where("p_partkey > 1").select("p_brand"))), ("cell", S.same_content(cells, changed))]
    return spark.createDataFrame(out, "test string, same boolean")


@query("short_labels", "SELECT p_partkey, CASE WHEN length(p_name) > 15 THEN left(p_name, 15) || '...' ELSE p_name END AS label FROM part")
def short_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select("p_partkey", C.short_label(F.col("p_name")).alias("label"))


# ---- archives and models -----------------------------------------------------------------------------


def _talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("row", F.concat_ws("-", "conv_id", "turn", "role"))


TALK_TEXT = "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, role FROM conversations"


def _coded(spark: SparkSession, sf_dir: str, coder: str) -> DataFrame:
    return S.round_trip(_talk(spark, sf_dir), "row", ["conv_id", "turn", "role"], stripe=2048, coder=coder, epochs=5).drop("row_id")


@query("roundtrip_model", TALK_TEXT)
def roundtrip_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model for each child column where one beats the histogram by the margin."""
    return _coded(spark, sf_dir, "model")


@query("roundtrip_neural", TALK_TEXT)
def roundtrip_neural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "neural")


@query("roundtrip_autoregressive", TALK_TEXT)
def roundtrip_autoregressive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _coded(spark, sf_dir, "autoregressive")


@query("roundtrip_chain", TALK_TEXT)
def roundtrip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.round_trip(_talk(spark, sf_dir), "row", ["conv_id", "turn", "role"], stripe=2048, forest="chain").drop("row_id")


def _net(spark: SparkSession, sf_dir: str) -> M.Net:
    net = M.train(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", "o_orderkey", epochs=5)
    if net is None:
        raise RuntimeError("the table gave no model")
    return net


EVERY_PAIR = "(SELECT DISTINCT o_orderstatus AS p FROM orders) CROSS JOIN (SELECT DISTINCT o_orderpriority AS c FROM orders)"


@query("model_bytes", f"SELECT p, c, 0.0::DOUBLE AS change FROM {EVERY_PAIR}")
def model_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model written and read back tells every pair the same."""
    net = _net(spark, sf_dir)
    back = M.model_table(spark, M.Net.from_bytes(net.to_bytes())).withColumnRenamed("prob", "again")
    return M.model_table(spark, net).join(back, ["p", "c"]).select("p", "c", F.abs(F.col("prob") - F.col("again")).alias("change"))


@query("model_averages", f"SELECT p, count(*) AS n, 1.0::DOUBLE AS total FROM {EVERY_PAIR} GROUP BY 1")
def model_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    averaged = M.averaged(load(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderpriority", _net(spark, sf_dir))
    return averaged.groupBy("p").agg(F.count("*").alias("n"), F.round(F.sum("prob"), 6).alias("total"))


@query("model_distributions", f"SELECT p, c, round(coalesce(prob, 0), 6) AS share FROM {EVERY_PAIR} LEFT JOIN (" + COND_SQL.format(p="o_orderstatus", c="o_orderpriority", t="orders") + ") USING (p, c)")
def model_distributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram's shares beside a model's, for every pair that either knows."""
    both = M.compare_distributions(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority", _net(spark, sf_dir))
    return both.where((F.col("prob") > 0) & (F.col("prob") <= 1)).select("p", "c", r6("share"))


@query("codec_originals", " UNION ALL ".join(f"SELECT '{m}' AS method, col AS \"column\", (sum(strlen(v) + 1) - 1)::BIGINT AS original FROM (SELECT 'o_orderstatus' AS col, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders UNION ALL SELECT '*', o_orderstatus || ',' || o_orderpriority FROM orders) GROUP BY col" for m in ("bzip2", "gzip", "zstd")))
def codec_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes before compression, of single columns and whole rows, where each codec makes them fewer."""
    sizes = S.codec_sizes(load(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", stripe=1 << 30)
    return sizes.where("size < original").select("method", "column", "original")


@query("histogram_bits", f"WITH {score_sql('SELECT n_regionkey::VARCHAR AS c0, c_nationkey::VARCHAR AS c1 FROM customer JOIN nation ON c_nationkey = n_nationkey', 2)}, d AS (SELECT sum(-c * log2(c::DOUBLE / cx)) AS data FROM marg) SELECT round(bits + data, 6) AS histogram_bits FROM score, d")
def histogram_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model has to beat: the histogram's own bits and those of the data under it."""
    rows = load(spark, sf_dir, "customer").join(load(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return spark.createDataFrame([(round(M.choose(rows, "n_regionkey", "c_nationkey", "c_custkey", epochs=1)["histogram_bits"], 6),)], "histogram_bits double")


@query("archive_columns", "SELECT 'p_partkey' AS name, 'integer' AS kind, 0::BIGINT AS n_values UNION ALL SELECT 'p_size', 'integer', 0 UNION ALL SELECT 'p_type', 'categorical', count(DISTINCT p_type) FROM part")
def archive_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of an archive, with the size of each column's dictionary."""
    path = shared_path(spark, "archive")
    S.write_archive(load(spark, sf_dir, "part").select("p_partkey", "p_size", "p_type"), path, ["p_partkey", "p_size", "p_type"], "p_partkey", rare=0)
    values = spark.read.parquet(f"{path}/dictionary").groupBy("col_id").agg(F.count("*").alias("n_values"))
    return spark.read.parquet(f"{path}/manifest").join(values, "col_id", "left").select("name", "kind", F.coalesce("n_values", F.lit(0)).cast("long").alias("n_values"))


# ---- sweeps ------------------------------------------------------------------------------------------


def _bytes_sql(table: str, columns: list[str]) -> str:
    return f"(SELECT (sum({' + '.join(f'strlen({c}::VARCHAR)' for c in columns)}) + {len(columns)} * count(*))::BIGINT FROM {table})"


SWEPT = {"nation": ["n_name", "n_regionkey"], "region": ["r_name"]}


@query("sweep_resumed", "SELECT dataset, method, original::DOUBLE AS original FROM (" + " UNION ALL ".join(f"SELECT '{t}' AS dataset, {_bytes_sql(t, c)} AS original" for t, c in SWEPT.items()) + "), (VALUES ('gzip'), ('columnar zstd')) m(method)")
def sweep_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sweep that is stopped after one method and taken up again measures each pair once."""
    path = shared_path(spark, "sweep")
    sets = {t: load(spark, sf_dir, t).select(F.col(f"{t[0]}_{t}key").alias("row_id"), *c) for t, c in SWEPT.items()}
    W.compare(spark, sets, path, ["gzip"])
    return W.compare(spark, sets, path, ["gzip", "columnar zstd"]).select("dataset", "method", "original")


@query("sweep_grid", "SELECT r.r::INTEGER AS rare, b.b::INTEGER AS buckets, true AS measured FROM (VALUES (1), (20)) r(r), (VALUES (1024), (16384)) b(b)")
def sweep_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("row_id"), "n_name", "n_regionkey")
    return W.grid(spark, rows, (1, 20), (1024, 16384)).select("rare", "buckets", (F.col("ratio") > 0).alias("measured"))
