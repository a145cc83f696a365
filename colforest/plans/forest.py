"""From a table to a dependency forest over its columns.

Counting is distributed; what reaches the driver is one number per pair of columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairs as P

Edge = tuple[int, int, float]


def phase_rows(n: int, phase: int) -> int:
    """Rows to sample of n: for ranking all pairs (1), for scoring the best of them (2)."""
    if phase == 1:
        steps = ((1_000, 0, 1), (10_000, 3_000, 2), (100_000, 5_000, 4), (1_000_000, 50_000, 20), (None, 100_000, 35))
        for most, rows, part in steps:
            if most is None or n <= most:
                return n if not rows else min(rows, n // part)
    if n <= 10_000:
        return n
    if n <= 100_000:
        return min(n, max(20_000, n // 5))
    return min(100_000, n // 10) if n <= 1_000_000 else min(200_000, n // 20)


def phase_buckets(n: int, buckets: int) -> int:
    return buckets if n <= 100_000 else min(buckets, 8192) if n <= 1_000_000 else min(2 * buckets, 16384)


def ranked(edges: Sequence[Edge]) -> list[Edge]:
    """Heaviest first; equal weights (to six digits) by column numbers."""
    return sorted(((u, v, w) for u, v, w in edges), key=lambda e: (-round(e[2], 6), e[0], e[1]))


def maximum_forest(n_columns: int, edges: Sequence[Edge]) -> list[Edge]:
    """The maximum-weight forest of positive edges: take the heaviest that joins two trees."""
    root = list(range(n_columns))

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    out = []
    for u, v, w in ranked(edges):
        if w > 0 and find(u) != find(v):
            root[find(u)] = find(v)
            out.append((u, v, w))
    return out


def orient(n_columns: int, edges: Sequence[Edge]) -> list[int]:
    """Parent of each column, -1 for roots; a tree is rooted at its lowest column and walked breadth first."""
    near: dict[int, list[int]] = {i: [] for i in range(n_columns)}
    for u, v, _ in edges:
        near[u].append(v)
        near[v].append(u)
    parent: list[int | None] = [None] * n_columns
    for top in range(n_columns):
        if parent[top] is None:
            parent[top], line = -1, [top]
            for at in line:
                for k in near[at]:
                    if parent[k] is None:
                        parent[k] = at
                        line.append(k)
    return parent  # type: ignore[return-value]


def depths(parents: Sequence[int]) -> list[int]:
    def depth(i: int) -> int:
        d = 0
        while parents[i] >= 0:
            i, d = parents[i], d + 1
        return d

    return [depth(i) for i in range(len(parents))]


def chain(n_columns: int) -> list[Edge]:
    """The baseline: every column hangs on the one before it."""
    return [(i - 1, i, 1.0) for i in range(1, n_columns)]


def recall(true: Sequence[tuple[int, int]], found: Sequence[Edge]) -> float:
    pair = lambda e: (min(e[0], e[1]), max(e[0], e[1]))
    want = {pair(e) for e in true}
    return len(want & {pair(e) for e in found}) / len(want) if want else 1.0


@dataclass
class Forest:
    columns: list[str]
    edges: list[Edge]
    candidates: list[Edge]

    @property
    def parents(self) -> list[int]:
        return orient(len(self.columns), self.edges)

    def edge_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(u, v, round(w, 6)) for u, v, w in self.edges], "u int, v int, w double")

    def node_table(self, spark: SparkSession) -> DataFrame:
        p = self.parents
        return spark.createDataFrame([(i, c, p[i], d) for i, (c, d) in enumerate(zip(self.columns, depths(p)))], "col_id int, name string, parent_id int, depth int")


def encode_for_counting(df: DataFrame, columns: Sequence[str], mode: str, buckets: int, rows: int, numeric: Sequence[str] = ()) -> DataFrame:
    """Columns as counted: as they are, or in buckets; numeric ones in quantile bins where buckets are asked for."""
    if mode == "auto":
        mode = "exact" if rows <= 10_000 else "hashed"
    if mode == "exact":
        return df.select(*columns)
    if mode != "hashed":
        raise ValueError(f"unknown mode {mode!r}: exact, hashed or auto")
    edges = P.quantile_edges(df, numeric, min(256, buckets)) if numeric else {}
    return df.select(*[P.bin_of(F.col(c).cast("double"), edges[c]).alias(c) if c in edges else P.hash_bucket(F.col(c), buckets).alias(c) for c in columns])


def learn_forest(
    df: DataFrame, columns: Sequence[str] | None = None, mode: str = "exact", buckets: int = 4096, screen: bool = False, sample: int | None = None,
    key: str | None = None, two_phase: bool = False, charge: Callable[[DataFrame], DataFrame] | None = None, seed: int = 0,
) -> Forest:
    """Screen columns, weigh all pairs, keep the maximum-weight forest of positive edges.

    ``charge`` maps a pair histogram to (i, j, bits) and replaces the proxy charge.  ``sample`` (with the
    row key ``key``) counts on so many rows and scales to all.  ``two_phase`` ranks on a sample and weighs
    the best pairs again on a larger one.
    """
    columns = list(columns or df.columns)
    df = df.select(*dict.fromkeys([*columns, *([key] if key else [])]))
    n = df.count()
    numeric = [c for c, t in df.dtypes if c in columns and t in ("double", "float")]
    keep = set(range(len(columns)))
    if screen and n:
        some = P.sample_rows(df, key or columns[0], min(500, n), seed) if n > 500 else df
        skip = {r.column for r in P.high_cardinality(some, columns).where("skip").collect()} - set(numeric)
        keep = {i for i in keep if columns[i] not in skip}
    candidates = [(i, j) for i in sorted(keep) for j in sorted(keep) if i < j]

    def weigh(rows: int, some: Sequence[tuple[int, int]], how: str, many: int) -> list[Edge]:
        if not some or not n:
            return []
        part = P.sample_rows(df, key, rows, seed) if rows < n and key else df
        hist = P.pair_histogram(encode_for_counting(part, columns, how, many, rows, numeric), columns, some)
        scores = P.pair_scores(hist, n)
        if charge:
            scores = scores.drop("bits", "w").join(charge(hist), ["i", "j"]).withColumn("w", n * F.col("mi") / P.LN2 - F.col("bits"))
        return [(r.i, r.j, r.w) for r in scores.select("i", "j", "w").collect()]  # one row per pair of columns

    if two_phase:
        first = [e for e in ranked(weigh(phase_rows(n, 1), candidates, mode, phase_buckets(n, buckets))) if e[2] > 0]
        best = first[: min(len(first), max(25 * len(columns), 1500), 3000)]
        edges = weigh(phase_rows(n, 2), [(u, v) for u, v, _ in best], "exact" if mode == "auto" else mode, buckets)
    else:
        edges = weigh(min(n, sample or n), candidates, mode, buckets)
    return Forest(columns, maximum_forest(len(columns), edges), ranked(edges))


def forest_statistics(forest: Forest, spark: SparkSession) -> DataFrame:
    """One row: columns, edges, roots, components of two or more, largest tree, weight range, depth."""
    parents = forest.parents
    tree = {}
    for i in range(len(parents)):
        top = i
        while parents[top] >= 0:
            top = parents[top]
        tree.setdefault(top, []).append(i)
    w = [e[2] for e in forest.edges]
    row = (len(parents), len(w), sum(p < 0 for p in parents), sum(len(t) > 1 for t in tree.values()), max(map(len, tree.values()), default=0), min(w, default=None), max(w, default=None), max(depths(parents), default=0))
    return spark.createDataFrame([row], "n_columns int, n_edges int, n_roots int, n_trees int, largest int, min_w double, max_w double, depth int")
