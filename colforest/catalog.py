"""Queries over the driver's tables, one or more for each operator, and the SQL that states the same.

The SQL is written against the definitions, not against the Spark plans: unions of pairs where Spark
explodes, recursive walks where the driver keeps a union-find.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import codes as C
from .operators import kinds as K
from .operators import pairs as P
from .operators import profile as R
from .operators import ranker as N
from .plans import forest as G

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str):
    return F.round(c, 6).alias(c)


# ---- tables the queries share ------------------------------------------------------------------------

GEO = ["c_nationkey", "c_mktsegment", "n_name", "n_regionkey", "r_name"]
GEO_SQL = "SELECT c_nationkey::VARCHAR AS c0, c_mktsegment AS c1, n_name AS c2, n_regionkey::VARCHAR AS c3, r_name AS c4 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
LINE = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def text_sql(table: str, columns: list[str]) -> str:
    return "SELECT " + ", ".join(f"coalesce({c}::VARCHAR, '') AS c{k}" for k, c in enumerate(columns)) + f" FROM {table}"


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, nation, region = (load(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    return customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey).select(*GEO)


def hist_sql(source: str, n: int) -> str:
    """CTEs t and hist(i, j, x, y, c) over columns c0 to c(n-1)."""
    union = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, c{i} AS x, c{j} AS y FROM t" for i, j in combinations(range(n), 2))
    return f"t AS ({source}), hist AS (SELECT i, j, x, y, count(*) AS c FROM ({union}) GROUP BY ALL)"


def gamma_sql(v: str) -> str:
    return f"(CASE WHEN {v} <= 0 THEN 1 ELSE 2 * length(bin({v})) - 1 END)"


def golomb_sql(v: str, m: str) -> str:
    width = f"length(bin({m} - 1))"
    return f"(CASE WHEN {v} <= 0 THEN 1 WHEN {m} <= 1 THEN {gamma_sql(v)} ELSE {v} // {m} + 1 + CASE WHEN {v} % {m} < (1 << {width}) - {m} THEN {width} - 1 ELSE {width} END END)"


def score_sql(source: str, n: int) -> str:
    """CTEs up to score(i, j, n, k, mi, bits, w)."""
    return f"""{hist_sql(source, n)},
marg AS (SELECT *, sum(c) OVER (PARTITION BY i, j, x) AS cx, sum(c) OVER (PARTITION BY i, j, y) AS cy, sum(c) OVER (PARTITION BY i, j) AS n, count(*) OVER (PARTITION BY i, j) AS k FROM hist),
charged AS (SELECT *, CAST(greatest(least(floor(0.693::DOUBLE * (n::DOUBLE / k)), 8192), 8) AS BIGINT) AS m FROM marg),
score0 AS (SELECT i, j, n, k, greatest(0, sum(c::DOUBLE / n * ln(c::DOUBLE * n / (cx::DOUBLE * cy)))) AS mi,
  sum(CASE WHEN n::DOUBLE / k > 1 AND n::DOUBLE / k < 100 THEN {golomb_sql('c', 'm')} ELSE {gamma_sql('(c + 1)')} END) + {gamma_sql('k')} AS bits FROM charged GROUP BY i, j, n, k),
score AS (SELECT i, j, n, k, mi, bits::DOUBLE AS bits, n * mi / ln(2) - bits AS w FROM score0)"""


def forest_sql(source: str, n: int) -> str:
    """CTEs up to forest(u, v, w) of the columns c0 to c(n-1): an edge stays unless heavier ones join its ends."""
    return f"""{score_sql(source, n)},
edge AS (SELECT i AS u, j AS v, round(w, 6) AS w, row_number() OVER (ORDER BY round(w, 6) DESC, i, j) AS rk FROM score WHERE w > 0),
reach(rk, node) AS (SELECT rk, u FROM edge UNION SELECT r.rk, CASE WHEN e.u = r.node THEN e.v ELSE e.u END FROM reach r JOIN edge e ON e.rk < r.rk AND (e.u = r.node OR e.v = r.node)),
forest AS (SELECT u, v, w FROM edge e WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.rk = e.rk AND r.node = e.v))"""


FOREST_SQL = forest_sql(GEO_SQL, 5)
ORIENT_SQL = f"""{FOREST_SQL},
near AS (SELECT u AS a, v AS b FROM forest UNION ALL SELECT v, u FROM forest),
seen(top, node) AS (SELECT k, k FROM range(5) r(k) UNION SELECT s.top, n.b FROM seen s JOIN near n ON n.a = s.node),
root AS (SELECT node, min(top) AS top FROM seen GROUP BY node),
walk(node, parent, depth) AS (SELECT node, -1::BIGINT, 0 FROM root WHERE node = top UNION ALL SELECT n.b, w.node, w.depth + 1 FROM walk w JOIN near n ON n.a = w.node WHERE n.b <> w.parent)"""
NAMES_SQL = "(VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(GEO)) + ") AS nm(k, name)"


# ---- forests -----------------------------------------------------------------------------------------


@query("forest_customer_geo", f"WITH RECURSIVE {FOREST_SQL} SELECT u::INTEGER AS u, v::INTEGER AS v, w FROM forest")
def forest_customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.learn_forest(geo(spark, sf_dir), GEO).edge_table(spark)


@query("orient_customer_geo", f"WITH RECURSIVE {ORIENT_SQL} SELECT node::INTEGER AS col_id, name, parent::INTEGER AS parent_id, depth::INTEGER AS depth FROM walk JOIN {NAMES_SQL} ON k = node")
def orient_customer_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.learn_forest(geo(spark, sf_dir), GEO).node_table(spark)


@query("forest_statistics", f"""WITH RECURSIVE {ORIENT_SQL}, size AS (SELECT top, count(*) AS c FROM root GROUP BY top)
SELECT 5::INTEGER AS n_columns, (SELECT count(*) FROM forest)::INTEGER AS n_edges, (SELECT count(*) FROM size)::INTEGER AS n_roots, (SELECT count(*) FROM size WHERE c > 1)::INTEGER AS n_trees,
 (SELECT max(c) FROM size)::INTEGER AS largest, (SELECT min(w) FROM forest) AS min_w, (SELECT max(w) FROM forest) AS max_w, (SELECT max(depth) FROM walk)::INTEGER AS depth""")
def forest_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.forest_statistics(G.learn_forest(geo(spark, sf_dir), GEO), spark)
    return s.withColumns({"min_w": F.round("min_w", 6), "max_w": F.round("max_w", 6)})


@query("forest_two_phase", f"WITH RECURSIVE {FOREST_SQL} SELECT u::INTEGER AS u, v::INTEGER AS v, w FROM forest")
def forest_two_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a row key no sample is drawn: both phases see all rows and must agree with one."""
    return G.learn_forest(geo(spark, sf_dir), GEO, two_phase=True).edge_table(spark)


@query("edge_candidates_topk", f"WITH {score_sql(GEO_SQL, 5)} SELECT rank, i::INTEGER AS u, j::INTEGER AS v, w FROM (SELECT i, j, round(w, 6) AS w, row_number() OVER (ORDER BY round(w, 6) DESC, i, j)::INTEGER AS rank FROM score WHERE w > 0) WHERE rank <= 4")
def edge_candidates_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = P.pair_scores(P.pair_histogram(geo(spark, sf_dir), GEO)).where("w > 0").select(F.col("i").alias("u"), F.col("j").alias("v"), r6("w"))
    top = scores.orderBy(F.desc("w"), "u", "v").limit(4)
    return top.withColumn("rank", F.row_number().over(P.Window.orderBy(F.desc("w"), "u", "v"))).select("rank", "u", "v", "w")


@query("chain_baseline", f"SELECT (k - 1)::INTEGER AS u, k::INTEGER AS v, 1.0::DOUBLE AS w FROM (SELECT unnest(range(1, count(*)::BIGINT)) AS k FROM (DESCRIBE {GEO_SQL}))")
def chain_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(G.chain(len(geo(spark, sf_dir).columns)), "u int, v int, w double")


@query("edge_recall", f"WITH RECURSIVE {FOREST_SQL} SELECT round(count(f.u)::DOUBLE / 4, 6) AS recall FROM range(1, 5) r(k) LEFT JOIN forest f ON f.u = k - 1 AND f.v = k")
def edge_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = G.learn_forest(geo(spark, sf_dir), GEO).edge_table(spark)
    chain = spark.createDataFrame(G.chain(len(GEO)), "u int, v int, w double").select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    hit = chain.join(found.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), F.lit(1).alias("hit")), ["a", "b"], "left")
    return hit.agg(F.round(F.count("hit") / F.count("*"), 6).alias("recall"))


# ---- pairs -------------------------------------------------------------------------------------------

LINE_SQL = text_sql("lineitem", LINE)
EVENTS, ORDERS = ["user_id", "event_type", "props"], ["o_custkey", "o_orderstatus", "o_orderpriority"]
BUCKETS, BINS = 256, 64
HASHED_SQL = "SELECT " + ", ".join(f"(('0x' || substr(md5({c}::VARCHAR), 1, 8))::BIGINT % {BUCKETS})::VARCHAR AS c{k}" for k, c in enumerate(ORDERS)) + " FROM orders"
MEASURES = ["l_quantity", "l_extendedprice", "l_discount"]
EDGES_SQL = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [k / {BINS}.0 FOR k IN range({BINS + 1})])))[2:-2] AS e{k}" for k, c in enumerate(MEASURES))
LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
EDGE_ROWS_SQL = f"(SELECT * FROM lineitem ORDER BY md5('0|' || " + " || '|' || ".join(LINE_KEY) + f"), {', '.join(MEASURES)} LIMIT {P.EDGE_ROWS})"
QUANTILE_SQL = f"SELECT " + ", ".join(f"len(list_filter(e{k}, lambda e: e <= {c}))::VARCHAR AS c{k}" for k, c in enumerate(MEASURES)) + f" FROM lineitem, (SELECT {EDGES_SQL} FROM {EDGE_ROWS_SQL})"


@query("pair_hist_lineitem", f"WITH {hist_sql(LINE_SQL, 6)} SELECT i::INTEGER AS i, j::INTEGER AS j, x, y, c FROM hist")
def pair_hist_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_histogram(load(spark, sf_dir, "lineitem"), LINE)


def _mi(df: DataFrame, columns: list[str]) -> DataFrame:
    return P.pair_scores(P.pair_histogram(df, columns)).select("i", "j", "n", "k", r6("mi"))


MI_OUT = "SELECT i::INTEGER AS i, j::INTEGER AS j, n::BIGINT AS n, k, round(mi, 6) AS mi FROM score"


@query("mi_exact_lineitem", f"WITH {score_sql(LINE_SQL, 6)} {MI_OUT}")
def mi_exact_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mi(load(spark, sf_dir, "lineitem"), LINE)


@query("mi_hashed_orders", f"WITH {score_sql(HASHED_SQL, 3)} {MI_OUT}")
def mi_hashed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mi(P.hashed(load(spark, sf_dir, "orders"), ORDERS, BUCKETS), ORDERS)


@query("mi_quantile_lineitem", f"WITH {score_sql(QUANTILE_SQL, 3)} {MI_OUT}")
def mi_quantile_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mi(P.quantile_bins(load(spark, sf_dir, "lineitem"), MEASURES, BINS, LINE_KEY), MEASURES)


@query("mdl_proxy_lineitem", f"WITH {score_sql(LINE_SQL, 6)} SELECT i::INTEGER AS i, j::INTEGER AS j, n::BIGINT AS n, k, bits FROM score")
def mdl_proxy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_scores(P.pair_histogram(load(spark, sf_dir, "lineitem"), LINE)).select("i", "j", "n", "k", "bits")


@query("edge_weights_events", f"WITH {score_sql(text_sql('events', EVENTS), 3)} SELECT i::INTEGER AS i, j::INTEGER AS j, round(w, 6) AS w FROM score")
def edge_weights_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pair_scores(P.pair_histogram(load(spark, sf_dir, "events"), EVENTS)).select("i", "j", r6("w"))


@query("mi_matrix_lineitem", f"WITH {score_sql(LINE_SQL, 6)} SELECT i::INTEGER AS i, " + ", ".join(f"round(coalesce(max(CASE WHEN j = {k} THEN mi END), 0), 6) AS m{k}" for k in range(6)) + " FROM (SELECT i, j, mi FROM score UNION ALL SELECT j, i, mi FROM score) GROUP BY i")
def mi_matrix_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.report import matrix

    scores = P.pair_scores(P.pair_histogram(load(spark, sf_dir, "lineitem"), LINE)).select("i", "j", F.col("mi").alias("value"))
    return matrix(scores, len(LINE)).select("i", *[F.round(f"m{k}", 6).alias(f"m{k}") for k in range(len(LINE))])


@query("corr_trend", f"WITH {score_sql(GEO_SQL, 5)}, ent AS (SELECT i, j, -sum(c::DOUBLE / n * log2(c::DOUBLE / n)) AS h FROM marg GROUP BY i, j), hx AS (SELECT i, j, -sum(p * log2(p)) AS h FROM (SELECT DISTINCT i, j, x, cx::DOUBLE / n AS p FROM marg) GROUP BY i, j), "
 "g AS (SELECT s.mi / ln(2) AS mi_bits, ent.h - hx.h AS given FROM score s JOIN ent USING (i, j) JOIN hx USING (i, j)) SELECT count(*) AS n, round(corr(mi_bits, given), 6) AS correlation, round(regr_slope(given, mi_bits), 6) AS slope, round(regr_intercept(given, mi_bits), 6) AS intercept FROM g")
def corr_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.pair_entropies(geo(spark, sf_dir), GEO)
    return R.trend(e, "mi_bits", "h_y_given_x").select("n", r6("correlation"), r6("slope"), r6("intercept"))


# ---- profiles ----------------------------------------------------------------------------------------

PART = ["p_name", "p_brand", "p_type", "p_size"]
PROFILED = {"part": PART, "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "events": ["event_id", "user_id", "event_type", "props"]}


def long_sql(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, coalesce({c}::VARCHAR, '') AS v FROM {table}" for c in columns)


@query("cardinality_profile", " UNION ALL ".join(f"SELECT '{t}' AS \"table\", col AS \"column\", count(*) AS n_rows, count(DISTINCT v) AS n_distinct, round(100.0 * count(DISTINCT v) / count(*), 6)::DOUBLE AS pct FROM ({long_sql(t, c)}) GROUP BY col" for t, c in PROFILED.items()))
def cardinality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, c in PROFILED.items():
        one = R.cardinality(load(spark, sf_dir, t), c).select(F.lit(t).alias("table"), "column", "n_rows", "n_distinct", r6("pct"))
        out = one if out is None else out.unionByName(one)
    return out


@query("cardinality_screen", f"SELECT col AS \"column\", count(*) AS n_rows, count(DISTINCT v) AS n_distinct, count(DISTINCT v) > floor(count(*) * 0.5) AS skip FROM ({long_sql('orders', PROFILED['orders'])}) GROUP BY col")
def cardinality_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.high_cardinality(load(spark, sf_dir, "orders"), PROFILED["orders"])


@query("cardinality_screen_sample", f"WITH s AS (SELECT * FROM part ORDER BY md5('0|' || p_partkey::VARCHAR), p_partkey LIMIT 500) SELECT col AS \"column\", count(*) AS n_rows, count(DISTINCT v) AS n_distinct, count(DISTINCT v) > floor(count(*) * 0.5) AS skip FROM ({long_sql('s', PART)}) GROUP BY col")
def cardinality_screen_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.high_cardinality(P.sample_rows(load(spark, sf_dir, "part"), "p_partkey", 500), PART)


@query("value_counts_top3", f"SELECT col AS \"column\", rank, v, c FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY c DESC, v)::INTEGER AS rank FROM (SELECT col, v, count(*) AS c FROM ({long_sql('part', PART)}) GROUP BY col, v)) WHERE rank <= 3")
def value_counts_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top_values(load(spark, sf_dir, "part"), PART)


@query("numeric_profile", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", min({c}) AS minimum, max({c}) AS maximum, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS deviation FROM lineitem" for c in [*MEASURES, "l_tax"]))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numeric_profile(load(spark, sf_dir, "lineitem"), [*MEASURES, "l_tax"]).select("column", "minimum", "maximum", r6("mean"), r6("deviation"))


@query("entropy_columns", f"SELECT col AS \"column\", round(-sum(p * log2(p)), 6) AS bits FROM (SELECT col, v, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY col) AS p FROM ({long_sql('part', PART)}) GROUP BY col, v) GROUP BY col")
def entropy_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.entropy(load(spark, sf_dir, "part"), PART).select("column", r6("bits"))


H_SQL = "-sum(p * log2(p))"


@query("entropy_conditional", f"""WITH {hist_sql(GEO_SQL, 5)}, marg AS (SELECT *, sum(c) OVER (PARTITION BY i, j, x) AS cx, sum(c) OVER (PARTITION BY i, j, y) AS cy, sum(c) OVER (PARTITION BY i, j) AS n FROM hist),
xy AS (SELECT i, j, {H_SQL} AS h_xy FROM (SELECT i, j, c::DOUBLE / n AS p FROM marg) GROUP BY i, j), x AS (SELECT i, j, {H_SQL} AS h_x FROM (SELECT DISTINCT i, j, x, cx::DOUBLE / n AS p FROM marg) GROUP BY i, j),
y AS (SELECT i, j, {H_SQL} AS h_y FROM (SELECT DISTINCT i, j, y, cy::DOUBLE / n AS p FROM marg) GROUP BY i, j)
SELECT i::INTEGER AS i, j::INTEGER AS j, round(h_x, 6) AS h_x, round(h_y, 6) AS h_y, round(h_xy, 6) AS h_xy, round(h_xy - h_x, 6) + 0.0 AS h_y_given_x, round(h_x + h_y - h_xy, 6) AS mi_bits,
 round(CASE WHEN round(h_xy - h_x, 9) > 0 THEN h_y / (h_xy - h_x) ELSE 0 END, 6) AS gain, round((h_x + h_y - h_xy) / h_y, 6) AS saving FROM xy JOIN x USING (i, j) JOIN y USING (i, j)""")
def entropy_conditional(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = R.pair_entropies(geo(spark, sf_dir), GEO)
    return e.select("i", "j", r6("h_x"), r6("h_y"), r6("h_xy"), (F.round("h_y_given_x", 6) + 0.0).alias("h_y_given_x"), r6("mi_bits"), r6("gain"), r6("saving"))


COND_SQL = "SELECT {p} AS p, {c} AS c, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY {p}) AS prob FROM {t} GROUP BY 1, 2"


@query("cond_distribution", "SELECT p, c, n, round(prob, 6) AS prob FROM (" + COND_SQL.format(p="o_orderstatus", c="o_orderpriority", t="orders") + ")")
def cond_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.conditional_distribution(load(spark, sf_dir, "orders"), "o_orderstatus", "o_orderpriority").select("p", "c", "n", r6("prob"))


KL_SQL = "WITH a AS (" + COND_SQL.format(p="event_type", c="props", t="(SELECT * FROM events WHERE event_id % 2 = 0)") + "), b AS (" + COND_SQL.format(p="event_type", c="props", t="(SELECT * FROM events WHERE event_id % 2 = 1)") + ") SELECT coalesce(a.p, b.p) AS p, sum(CASE WHEN coalesce(a.prob, 0) > 0 THEN a.prob * ln(a.prob / coalesce(b.prob, 1e-10)) ELSE 0 END) AS kl FROM a FULL JOIN b ON a.p = b.p AND a.c = b.c GROUP BY 1"


def _kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events")
    half = lambda k: R.conditional_distribution(e.where(F.col("event_id") % 2 == k), "event_type", "props")
    return R.divergence(half(0), half(1))


@query("kl_by_parent", f"SELECT p, round(kl, 6) AS kl FROM ({KL_SQL})")
def kl_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kl(spark, sf_dir).select("p", r6("kl"))


@query("kl_mean", f"SELECT count(*) AS n_parents, round(avg(kl), 6) AS mean_kl FROM ({KL_SQL}) WHERE kl > 0")
def kl_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_divergence(_kl(spark, sf_dir)).select("n_parents", r6("mean_kl"))


@query("residual_summary", "SELECT round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS deviation, round(avg(abs(r)), 6) AS mean_size, round(100.0 * avg((r = 0)::INTEGER), 6) AS pct_exact, round(quantile_cont(r, 0.01), 6) AS low, round(quantile_cont(r, 0.99), 6) AS high FROM (SELECT l_quantity - l_linenumber AS r FROM lineitem)")
def residual_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = R.residuals(load(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber")
    return out.select(*[r6(c) for c in out.columns])


@query("correlation_matrix", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in MEASURES for b in MEASURES) + ")")
def correlation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.correlation_matrix(load(spark, sf_dir, "lineitem"), MEASURES).select("a", "b", r6("r"))


@query("delta_runs", "SELECT stripe, count(*) AS n, round(avg((v = 0)::INTEGER), 6) AS zero_share, round(avg((v = b)::INTEGER), 6) AS run_share, round(avg(abs(v - b)), 6) AS mean_step FROM (SELECT event_id // 4096 AS stripe, user_id AS v, lag(user_id) OVER (PARTITION BY event_id // 4096 ORDER BY event_id) AS b FROM events) GROUP BY stripe")
def delta_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").withColumn("stripe", F.expr("event_id div 4096"))
    return R.runs(e, "user_id", "event_id", "stripe").select("stripe", "n", r6("zero_share"), r6("run_share"), r6("mean_step"))


# ---- kinds -------------------------------------------------------------------------------------------

TYPED = {"p": ("part", {"p_partkey": "p_partkey::VARCHAR", "p_brand": "p_brand", "p_size": "p_size::VARCHAR"}), "o": ("orders", {"o_orderkey": "o_orderkey::VARCHAR", "o_orderstatus": "o_orderstatus", "o_orderdate": "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')"}), "l": ("lineitem", {"l_discount": "l_discount::VARCHAR", "l_quantity": "l_quantity::VARCHAR"})}
NUMBER_SQL = C.NUMBER.replace("'", "''")
WHOLE_SQL = "(abs(x - round(x * {s}) / {s}) <= 1e-10 + 1e-9 * abs(round(x * {s}) / {s}))"
FACTS_SQL = "SELECT col, count(*) AS n, count(*) FILTER (trim(v) = '') AS n_blank, count(x) AS n_number, count(*) FILTER ((regexp_matches(trim(v), '^[+-]?[0-9]+$') AND try_cast(trim(v) AS BIGINT) IS NOT NULL) OR (" + WHOLE_SQL.format(s=1) + " AND abs(x) < 9007199254740992)) AS n_integer, count(*) FILTER (length(v) > 10 AND regexp_matches(v, '" + K.STAMP + "')) AS n_stamp, coalesce(max(CASE WHEN x IS NOT NULL THEN length(regexp_extract(trim(v), '[.]([0-9]*?)0*$', 1)) END), 0) AS digits, " + ", ".join(f"count(*) FILTER ({WHOLE_SQL.format(s=s)}) AS whole_{s}" for s in K.SCALES) + f" FROM (SELECT col, v, CASE WHEN regexp_matches(trim(v), '{NUMBER_SQL}') THEN try_cast(trim(v) AS DOUBLE) END AS x FROM ({{src}})) GROUP BY col"


def typed_source() -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS col, {e} AS v FROM {t}" for t, cols in TYPED.values() for c, e in cols.items())


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, cols in TYPED.values():
        df = load(spark, sf_dir, t)
        text = [(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c == "o_orderdate" else F.col(c).cast("string")).alias(c) for c in cols]
        one = K.kind_facts(df.select(*text), list(cols))
        out = one if out is None else out.unionByName(one)
    return out


WHOLE_MAX = "greatest(" + ", ".join(f"whole_{s}" for s in K.SCALES) + ")"


@query("type_inference", f"SELECT col AS \"column\", n AS n_rows, n_blank, n_number, n_integer, n_stamp, CASE WHEN n_number = n AND n_integer = n THEN 'integer' WHEN n_number = n AND {WHOLE_MAX} >= 0.995 * n AND digits <= 6 THEN 'decimal' WHEN n_number = n THEN 'float' WHEN n_stamp > 0.7 * n THEN 'timestamp' ELSE 'categorical' END AS kind FROM ({FACTS_SQL.replace("{src}", typed_source())})")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typed(spark, sf_dir).select("column", "n_rows", "n_blank", "n_number", "n_integer", "n_stamp", K.kind_column().alias("kind"))


PRICES = ["l_quantity", "l_discount", "l_tax"]


@query("scale_detect", "SELECT col AS \"column\", digits, CASE " + " ".join(f"WHEN whole_{s} >= 0.995 * n THEN {s}" for s in K.SCALES) + " END::INTEGER AS scale FROM (" + FACTS_SQL.replace("{src}", long_sql("lineitem", PRICES)) + ")")
def scale_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.kind_facts(load(spark, sf_dir, "lineitem"), PRICES).select("column", "digits", K.scale_column().alias("scale"))


@query("timestamp_kind", "SELECT event_id, epoch(date_trunc('second', ts))::BIGINT AS seconds FROM events")
def timestamp_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("text"))
    return e.select("event_id", K.stamp_seconds(F.col("text")).alias("seconds"))


@query("sentinel_sparse", f"WITH c AS (SELECT col, v, count(*) AS c FROM (SELECT 'toxic' AS col, toxic::VARCHAR AS v FROM labels UNION ALL {long_sql('lineitem', ['l_discount', 'l_linestatus'])}) GROUP BY col, v) SELECT col AS \"column\", arg_min(v, (-c, v)) AS mode, round(max(c)::DOUBLE / sum(c), 6) AS share, max(c)::DOUBLE / sum(c) > 0.5 AS sparse FROM c GROUP BY col")
def sentinel_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = K.sparse_sentinel(load(spark, sf_dir, "labels"), ["toxic"]).unionByName(K.sparse_sentinel(load(spark, sf_dir, "lineitem"), ["l_discount", "l_linestatus"]))
    return one.select("column", "mode", r6("share"), "sparse")


@query("dictionary_first_seen", "SELECT v, (row_number() OVER (ORDER BY f) - 1)::BIGINT AS code, n FROM (SELECT p_type AS v, min(p_partkey) AS f, count(*) AS n FROM part GROUP BY 1)")
def dictionary_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.first_seen(load(spark, sf_dir, "part"), "p_type", "p_partkey")


@query("sorted_codes", "SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS code FROM (SELECT DISTINCT p_brand AS v FROM part)")
def sorted_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.sorted_codes(load(spark, sf_dir, "part"), "p_brand")


RARE_SQL = """WITH c AS (SELECT props AS v, count(*) AS c FROM events GROUP BY 1), s AS (SELECT sum(c) AS n, count(*) AS k FROM c),
l AS (SELECT n, k, CASE WHEN n < 100000 THEN 0.01 WHEN n < 1000000 THEN 0.002 ELSE 0.0003 END AS f0, CASE WHEN n < 100000 THEN {t} WHEN n < 1000000 THEN greatest({t}, 4) ELSE greatest({t}, 15) END AS m0 FROM s)
SELECT v, c, ((c <= m0 AND c::DOUBLE / n < f0) OR (c::DOUBLE / n < f0 / 2 AND c <= 2 * m0)) AND v NOT IN ('', 'nan') AS rare FROM c, l"""


@query("rare_bucketing", RARE_SQL.format(t=20))
def rare_bucketing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.rare_values(load(spark, sf_dir, "events"), "props", threshold=20)


@query("occurrence_index", "SELECT l_orderkey, l_linenumber, l_orderkey // 4096 AS stripe, row_number() OVER (PARTITION BY l_orderkey // 4096, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey)::INTEGER AS k FROM lineitem")
def occurrence_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = load(spark, sf_dir, "lineitem").withColumn("o", F.struct("l_orderkey", "l_partkey", "l_suppkey"))
    return K.occurrence_index(line, "l_linenumber", "o", F.expr("l_orderkey div 4096")).select("l_orderkey", "l_linenumber", "stripe", "k")


@query("sample_deterministic", "SELECT o_orderkey FROM orders ORDER BY md5('7|' || o_orderkey::VARCHAR), o_orderkey LIMIT 100")
def sample_deterministic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.sample_rows(load(spark, sf_dir, "orders"), "o_orderkey", 100, 7).select("o_orderkey")


@query("prepare_clean", "SELECT page_id, trim(url) AS url, CASE WHEN trim(html) IN ('?', 'NA', 'N/A', 'null', '') THEN NULL ELSE trim(html) END AS html FROM pages")
def prepare_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = load(spark, sf_dir, "pages")
    return R.prepare(raw.select(F.col("page_id").cast("string").alias("page_id"), "url", "html"))


NUMERIC_SQL = "SELECT count(*)::INTEGER AS n_columns, sum(num)::INTEGER AS n_numeric, sum(num)::DOUBLE / count(*) AS share FROM (SELECT col, min((try_cast(trim(v) AS DOUBLE) IS NOT NULL)::INTEGER) AS num FROM ({src}) GROUP BY col)"


@query("numeric_share", NUMERIC_SQL.replace("{src}", long_sql("part", PART)))
def numeric_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.numeric_share(load(spark, sf_dir, "part").select(*PART))


# ---- coding ------------------------------------------------------------------------------------------

GEO_COND = COND_SQL.format(p="c3", c="c0", t=f"({GEO_SQL})")
TALK_COND = COND_SQL.format(p="turn::VARCHAR", c="role", t="conversations")
RANK_SQL = "SELECT '{n}' AS pair, rank::INTEGER AS rank, sum(n)::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY round(prob, 12) DESC, c) - 1 AS rank FROM ({src})) GROUP BY 2"


@query("rank_code", RANK_SQL.format(n="geo", src=GEO_COND) + " UNION ALL " + RANK_SQL.format(n="talk", src=TALK_COND))
def rank_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = N.rank_histogram(geo(spark, sf_dir), "n_regionkey", "c_nationkey").select(F.lit("geo").alias("pair"), "rank", "n")
    return a.unionByName(N.rank_histogram(load(spark, sf_dir, "conversations"), "turn", "role").select(F.lit("talk").alias("pair"), "rank", "n"))


@query("rank_roundtrip", "SELECT conv_id, turn, role FROM conversations")
def rank_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = load(spark, sf_dir, "conversations")
    ranks = N.rank_table(R.conditional_distribution(talk, "turn", "role"))
    coded = N.rank_encode(talk, "turn", "role", ranks).drop("role")
    return N.rank_decode(coded, "turn", ranks, "role").select("conv_id", "turn", "role")


@query("nll_bits", "SELECT '{a}' AS pair, sum(n)::BIGINT AS n, round(sum(-n * log2(prob)), 6) AS bits FROM ({x}) UNION ALL SELECT '{b}', sum(n)::BIGINT, round(sum(-n * log2(prob)), 6) FROM ({y})".format(a="geo", x=GEO_COND, b="talk", y=TALK_COND))
def nll_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = N.nll_bits(geo(spark, sf_dir), "n_regionkey", "c_nationkey").select(F.lit("geo").alias("pair"), "n", r6("bits"))
    return a.unionByName(N.nll_bits(load(spark, sf_dir, "conversations"), "turn", "role").select(F.lit("talk").alias("pair"), "n", r6("bits")))


VALUES = [0, 1, 2, 3, 7, 8, 9, 100, 127, 128, 1000, 16384, 123456]
LENGTHS_SQL = "SELECT v, {g}::BIGINT AS gamma, {b}::BIGINT AS golomb, greatest(1, ceil(length(bin(v)) / 7.0))::BIGINT AS varint, ('0x' || substr(md5(v::VARCHAR), 1, 8))::BIGINT % 4096 AS bucket FROM (SELECT unnest({vs})::BIGINT AS v UNION ALL SELECT DISTINCT p_size::BIGINT FROM part)".format(g=gamma_sql("v"), b=golomb_sql("v", "11"), vs=VALUES)


@query("code_lengths", LENGTHS_SQL)
def code_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = spark.createDataFrame([(v,) for v in VALUES], "v long").union(load(spark, sf_dir, "part").select(F.col("p_size").cast("long")).distinct())
    v = F.col("v")
    return some.select("v", C.gamma_bits(v).alias("gamma"), C.golomb_bits(v, F.lit(11)).alias("golomb"), C.varint_length(v).alias("varint"), C.hash_bucket(v, 4096).alias("bucket"))


from . import catalog_files, catalog_more  # noqa: E402, F401  add the queries on files and sources, archives, models, reports and streams
