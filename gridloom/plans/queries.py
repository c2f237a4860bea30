"""The catalogue: every operator as a query over the tables, with the SQL that it is checked against.

The codebook of a query is, unless it trains one, the embeddings with the smallest ids laid out on
the grid, so both engines have the same one.  Floats are rounded to six decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.config import MapConfig
from gridloom.functions import lattice
from gridloom.functions.distances import COLUMNS
from gridloom.functions.neighborhoods import NEIGHBORHOODS
from gridloom.functions.schedules import schedule_table
from gridloom.operators import bmu, clustering, codebook, maps, prepare, quality, retrieval, scores, training
from gridloom.plans.model import FeatureMap
from gridloom.sources.tables import codebook_array, codebook_table, read_table
from gridloom.streaming import assign as streaming

Query = Callable[[SparkSession, str], DataFrame]
X, Y = 5, 5
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


# ---- inputs


def samples(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("embedding").cast("array<double>").alias("features"), "label")


def book(spark: SparkSession, d: str, x: int = X, y: int = Y) -> DataFrame:
    first = read_table(spark, d, "embeddings").filter(F.col("vec_id") < x * y)
    return first.select(F.col("vec_id").cast("int").alias("neuron_id"), F.expr(f"cast(vec_id div {y} as int)").alias("row"), (F.col("vec_id") % y).cast("int").alias("col"), F.col("embedding").cast("array<double>").alias("w"))


def assigned(spark: SparkSession, d: str, distance: str = "euclidean", strategy: str = "arrow", x: int = X, y: int = Y) -> DataFrame:
    return bmu.assign(samples(spark, d), book(spark, d, x, y), distance, strategy=strategy)


def sql_e() -> str:
    return "e AS (SELECT vec_id AS row_id, embedding::DOUBLE[] AS v, label FROM embeddings)"


def sql_cb(x: int = X, y: int = Y) -> str:
    return f"cb AS (SELECT vec_id::INTEGER AS nid, (vec_id // {y})::INTEGER AS r, (vec_id % {y})::INTEGER AS c, embedding::DOUBLE[] AS w FROM embeddings WHERE vec_id < {x * y})"


def sql_d(distance: str, a: str, b: str) -> str:
    each = f"list_transform(range(1, len({a}) + 1), lambda i: abs({a}[i] - {b}[i]))"
    size = lambda v: f"greatest(sqrt(list_inner_product({v}, {v})), 1e-12)"
    return {
        "euclidean": f"list_distance({a}, {b})",
        "cosine": f"greatest(0::DOUBLE, least(1::DOUBLE, 1 - list_inner_product({a}, {b}) / ({size(a)} * {size(b)})))",
        "manhattan": f"list_sum({each})",
        "chebyshev": f"list_max({each})",
    }[distance]


def sql_bmu(distance: str = "euclidean", x: int = X, y: int = Y, k: int = 2) -> str:
    """CTEs up to b(row_id, label, n1, d1, n2, d2) and rk(row_id, nid, d, k)."""
    return f"""{sql_e()}, {sql_cb(x, y)},
p AS (SELECT row_id, label, nid, {sql_d(distance, "v", "w")} AS d FROM e CROSS JOIN cb),
rk AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY d, nid) AS k FROM p QUALIFY k <= {k}),
b AS (SELECT row_id, any_value(label) AS label, max(CASE WHEN k = 1 THEN nid END) AS n1, max(CASE WHEN k = 1 THEN d END) AS d1,
      max(CASE WHEN k = 2 THEN nid END) AS n2, max(CASE WHEN k = 2 THEN d END) AS d2 FROM rk GROUP BY row_id)"""


# ---- search and quality: D1, E1-E3, C1-C4, F1-F5

for _name in COLUMNS:

    @query(f"bmu_{_name}", f"WITH {sql_bmu(_name)} SELECT row_id, n1 AS nid1, round(d1, 6) AS d1 FROM b")
    def _bmu(spark, d, name=_name):
        got = bmu.assign(samples(spark, d), book(spark, d), name, strategy="sql" if name == "chebyshev" else "arrow", second=False)
        return got.select("row_id", "nid1", r6("d1").alias("d1"))

    @query(f"quantization_error_{_name}", f"WITH {sql_bmu(_name)} SELECT round(avg(d1), 6) AS qe FROM b")
    def _qe(spark, d, name=_name):
        return quality.quantization_error(assigned(spark, d, name)).select(r6("qe").alias("qe"))


@query("bmu_top2", f"WITH {sql_bmu()} SELECT row_id, n1 AS nid1, n2 AS nid2, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM b")
def bmu_top2(spark, d):
    return assigned(spark, d).select("row_id", "nid1", "nid2", r6("d1").alias("d1"), r6("d2").alias("d2"))


@query("bmu_topk3", f"WITH {sql_bmu(k=3)} SELECT row_id, k::INTEGER AS rank, nid AS neuron_id, round(d, 6) AS d FROM rk")
def bmu_topk3(spark, d):
    return bmu.top_k_rows(samples(spark, d), book(spark, d), 3).withColumn("d", r6("d"))


def sql_hex(r1: str, c1: str, r2: str, c2: str) -> str:
    q = lambda r, c: f"(({c}) - (({r}) - (abs({r}) % 2)) / 2.0)"
    return f"((abs({q(r1, c1)} - {q(r2, c2)}) + abs(({r1}) - ({r2})) + abs({q(r1, c1)} + ({r1}) - {q(r2, c2)} - ({r2}))) / 2.0)"


def sql_te(topology: str, pbc: bool, x: int, y: int) -> str:
    cells = f"c4 AS (SELECT n1 // {y} AS r1, n1 % {y} AS c1, n2 // {y} AS r2, n2 % {y} AS c2 FROM b)"
    if topology == "hexagonal":
        images = [sql_hex("r1", "c1", f"r2 + {dr}", f"c2 + {dc}") for dr in ((-x, 0, x) if pbc else (0,)) for dc in ((-y, 0, y) if pbc else (0,))]
        wrong = f"least({', '.join(images)}) > 1" if pbc else f"{images[0]} > 1"
    else:
        dr, dc = "(r2 - r1)::DOUBLE", "(c2 - c1)::DOUBLE"
        if pbc:
            dr, dc = f"({dr} - {x} * round({dr} / {x}))", f"({dc} - {y} * round({dc} / {y}))"
        wrong = f"sqrt({dr} * {dr} + {dc} * {dc}) > 1.42"
    return f"WITH {sql_bmu(x=x, y=y)}, {cells} SELECT round(avg(CASE WHEN {wrong} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS te FROM c4"


for _name, _topology, _pbc, _x, _y in (("te_rect", "rectangular", False, 5, 5), ("te_rect_torus", "rectangular", True, 5, 5), ("te_hex", "hexagonal", False, 6, 4), ("te_hex_torus", "hexagonal", True, 6, 4)):

    @query(_name, sql_te(_topology, _pbc, _x, _y))
    def _te(spark, d, t=_topology, pbc=_pbc, x=_x, y=_y):
        return quality.topographic_error(assigned(spark, d, x=x, y=y), x, y, t, pbc).select(r6("te").alias("te"))


# ---- maps: F6-F13, E4, D5, I1-I3

SQL_GRID = f"WITH {sql_bmu()}"
SQL_STATS = f"{SQL_GRID}, st AS (SELECT n1, count(*) AS n, avg(v[1]) AS m, CASE WHEN count(*) > 1 THEN stddev_samp(v[1]) ELSE 1e-8 END AS s FROM b JOIN e USING (row_id) GROUP BY n1)"


def neurons(spark: SparkSession, x: int = X, y: int = Y) -> DataFrame:
    return lattice.neuron_table(spark, x, y)


def targeted(spark: SparkSession, d: str) -> DataFrame:
    """Assigned rows with the first component as target."""
    rows = samples(spark, d).withColumn("target", F.col("features")[0])
    return bmu.assign(rows, book(spark, d))


@query("hit_map", f"{SQL_GRID} SELECT r AS row, c AS col, count(b.row_id) AS value FROM cb LEFT JOIN b ON b.n1 = cb.nid GROUP BY r, c")
def hit_map(spark, d):
    return maps.hit_map(neurons(spark), assigned(spark, d))


@query("bmu_index", f"{SQL_GRID} SELECT n1 AS neuron_id, count(*) AS n, min(row_id) AS first_row, string_agg(row_id::VARCHAR, ',' ORDER BY row_id) AS row_ids FROM b GROUP BY n1")
def bmu_index(spark, d):
    got = maps.bmus_data_map(assigned(spark, d))
    return got.select("neuron_id", F.size("row_ids").cast("long").alias("n"), F.col("row_ids")[0].alias("first_row"), F.array_join(F.col("row_ids").cast("array<string>"), ",").alias("row_ids"))


@query("metric_mean_map", f"{SQL_STATS} SELECT r AS row, c AS col, round(m, 6) AS value FROM cb LEFT JOIN st ON n1 = nid")
def metric_mean_map(spark, d):
    return maps.metric_map(neurons(spark), targeted(spark, d), "target", "mean").withColumn("value", r6("value"))


@query("metric_std_map", f"{SQL_STATS} SELECT r AS row, c AS col, round(s, 6) AS value FROM cb LEFT JOIN st ON n1 = nid")
def metric_std_map(spark, d):
    return maps.metric_map(neurons(spark), targeted(spark, d), "target", "std").withColumn("value", r6("value"))


@query("score_map", f"{SQL_STATS} SELECT r AS row, c AS col, round(CASE WHEN n = 1 THEN 1e-8 ELSE greatest(s / sqrt(n) * ln((SELECT count(*) FROM e)::DOUBLE / n), 1e-8) END, 6) AS value FROM cb LEFT JOIN st ON n1 = nid")
def score_map(spark, d):
    return maps.score_map(neurons(spark), targeted(spark, d), "target").withColumn("value", r6("value"))


@query("rank_map", f"{SQL_STATS}, k AS (SELECT n1, row_number() OVER (ORDER BY s DESC, n1)::INTEGER AS value FROM st) SELECT r AS row, c AS col, value FROM cb LEFT JOIN k ON n1 = nid")
def rank_map(spark, d):
    return maps.rank_map(neurons(spark), targeted(spark, d), "target")


def sql_offsets(topology: str, order: int) -> str:
    """off(parity, ring, dr, dc): the rings' offsets by arithmetic."""
    span = f"range({-3 * order}, {3 * order + 1})"
    if topology == "rectangular":
        return f"off AS (SELECT p AS parity, greatest(abs(dr), abs(dc)) AS ring, dr, dc FROM unnest([0, 1]) AS a(p), unnest({span}) AS s(dr), unnest({span}) AS t(dc) WHERE greatest(abs(dr), abs(dc)) BETWEEN 1 AND {order})"
    # even rows convert as if they lay to the right
    return f"""off AS (SELECT p AS parity, greatest(abs(q), abs(dr), abs(q + dr)) AS ring, dr,
  CASE WHEN p = 0 THEN q + (dr + abs(dr) % 2) // 2 ELSE q + (dr - abs(dr) % 2) // 2 END AS dc
  FROM unnest([0, 1]) AS a(p), unnest({span}) AS s(dr), unnest({span}) AS t(q) WHERE greatest(abs(q), abs(dr), abs(q + dr)) BETWEEN 1 AND {order})"""


def sql_neighbors(x: int, y: int) -> str:
    return f"""nb AS (SELECT (r * {y} + c)::INTEGER AS neuron_id, ((r + dr) * {y} + c + dc)::INTEGER AS nbr_id, ring::INTEGER AS ring
  FROM unnest(range({x})) AS a(r), unnest(range({y})) AS b(c), off WHERE parity = r % 2 AND r + dr BETWEEN 0 AND {x - 1} AND c + dc BETWEEN 0 AND {y - 1})"""


for _topology in ("rectangular", "hexagonal"):
    _short = _topology[:4].replace("hexa", "hex")

    @query(f"neighbors_{_short}", f"WITH {sql_offsets(_topology, 3)}, {sql_neighbors(7, 6)} SELECT neuron_id, nbr_id, ring FROM nb")
    def _neighbors(spark, d, t=_topology):
        return lattice.neighbor_table(spark, 7, 6, t, 3).select("neuron_id", "nbr_id", "ring")

    @query(
        f"classification_map_{_short}",
        f"""WITH {sql_bmu()}, {sql_offsets(_topology, 1)}, {sql_neighbors(X, Y)},
n AS (SELECT n1, label, count(*) AS n FROM b GROUP BY 1, 2),
t AS (SELECT n1, min(label) AS label, count(*) AS ties FROM (SELECT *, max(n) OVER (PARTITION BY n1) AS m FROM n) WHERE n = m GROUP BY n1),
v AS (SELECT neuron_id, n.label, sum(n.n) AS n FROM nb JOIN n ON n.n1 = nbr_id GROUP BY 1, 2),
w AS (SELECT neuron_id, label FROM v QUALIFY row_number() OVER (PARTITION BY neuron_id ORDER BY n DESC, label) = 1)
SELECT r AS row, c AS col, CASE WHEN ties > 1 THEN coalesce(w.label, t.label) ELSE t.label END AS value
FROM cb LEFT JOIN t ON t.n1 = nid LEFT JOIN w ON w.neuron_id = nid""",
    )
    def _classification(spark, d, t=_topology):
        return maps.classification_map(neurons(spark), assigned(spark, d), "label", lattice.neighbor_table(spark, X, Y, t, 1))

    for _order in (1, 2):
        for _scaling in ("sum", "mean"):
            _fold = "sum(d)" if _scaling == "sum" else "avg(d)"

            @query(
                f"distance_map_{_scaling}_{_short}_order{_order}",
                f"""WITH {sql_cb()}, {sql_offsets(_topology, _order)}, {sql_neighbors(X, Y)},
each AS (SELECT neuron_id, list_distance(a.w, b.w) AS d FROM nb JOIN cb a ON a.nid = neuron_id JOIN cb b ON b.nid = nbr_id),
m AS (SELECT neuron_id, {_fold} AS v FROM each GROUP BY neuron_id)
SELECT r AS row, c AS col, round(v / (SELECT max(v) FROM m), 6) AS value FROM cb JOIN m ON neuron_id = nid""",
            )
            def _distance_map(spark, d, t=_topology, o=_order, s=_scaling):
                return maps.distance_map(book(spark, d), lattice.neighbor_table(spark, X, Y, t, o), "euclidean", s).withColumn("value", r6("value"))


@query("component_planes", f"WITH {sql_cb()} SELECT (f - 1)::INTEGER AS feature, r AS row, c AS col, round(w[f], 6) AS value FROM cb, unnest(range(1, len(w) + 1)) AS s(f)")
def component_planes(spark, d):
    return maps.component_planes(book(spark, d)).withColumn("value", r6("value"))


@query("build_maps", f"{SQL_STATS} SELECT 'hit' AS map, r AS row, c AS col, coalesce(n, 0)::DOUBLE AS value FROM cb LEFT JOIN st ON n1 = nid UNION ALL SELECT 'metric', r, c, round(m, 6) FROM cb LEFT JOIN st ON n1 = nid")
def build_maps(spark, d):
    model = FeatureMap(spark, MapConfig(X, Y), codebook_array(book(spark, d)))
    rows = samples(spark, d).withColumn("target", F.col("features")[0])
    got = model.build_maps([{"type": "hit"}, {"type": "metric", "kwargs": {"reduction": "mean"}}], rows, "target")
    hit, metric = got.values()
    return hit.select(F.lit("hit").alias("map"), "row", "col", F.col("value").cast("double").alias("value")).unionByName(metric.select(F.lit("metric").alias("map"), "row", "col", r6("value").alias("value")))


LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

def line_book() -> np.ndarray:
    i = np.arange(25)
    return np.column_stack((i % 3 - 1, i // 3 % 3 - 1, i // 9 % 3 - 1, i * 7 % 5 / 2.0 - 1)).astype(float)


@query(
    "hit_map_lineitem",
    f"""WITH s AS (SELECT {", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(LINE))} FROM lineitem),
z AS (SELECT [{", ".join(f"({c} - m{i}) / s{i}" for i, c in enumerate(LINE))}]::DOUBLE[] AS v FROM lineitem, s),
g AS (SELECT i::INTEGER AS nid, [(i % 3) - 1, (i // 3) % 3 - 1, (i // 9) % 3 - 1, (i * 7 % 5) / 2.0 - 1]::DOUBLE[] AS w FROM range(25) AS t(i)),
u AS (SELECT DISTINCT v, (SELECT arg_min(nid, round(list_distance(v, w), 9) * 1000 + nid * 1e-9) FROM g) AS nid FROM (SELECT DISTINCT v FROM z)),
h AS (SELECT u.nid, count(*) AS n FROM z JOIN u USING (v) GROUP BY u.nid)
SELECT (g.nid // 5)::INTEGER AS row, (g.nid % 5)::INTEGER AS col, coalesce(n, 0) AS value FROM g LEFT JOIN h ON h.nid = g.nid""",
)
def hit_map_lineitem(spark, d):
    rows = prepare.vectorize(prepare.standardize(read_table(spark, d, "lineitem").select(*LINE), LINE), LINE)
    return maps.hit_map(neurons(spark), bmu.assign(rows, line_book(), second=False))


# ---- lattice, kernels, schedules: C6-C35

for _name, _topology, _pbc in (("grid_dist_rect", "rectangular", False), ("grid_dist_hex", "hexagonal", False), ("grid_dist_torus", "rectangular", True), ("grid_dist_hex_torus", "hexagonal", True)):
    _gx, _gy = ("r::DOUBLE", "c::DOUBLE") if _topology == "rectangular" else ("r + 0.5::DOUBLE * (r % 2)", "c * (sqrt(3.0::DOUBLE) / 2)")
    _ly = "5::DOUBLE" if _topology == "rectangular" else "(5 * sqrt(3.0::DOUBLE) / 2)"
    _dx, _dy = "(p.gx - q.gx)", "(p.gy - q.gy)"
    if _pbc:
        _dx, _dy = f"({_dx} - 6 * round({_dx} / 6))", f"({_dy} - {_ly} * round({_dy} / {_ly}))"

    @query(
        _name,
        f"""WITH g AS (SELECT (r * 5 + c)::INTEGER AS nid, {_gx} AS gx, {_gy} AS gy FROM unnest(range(6)) AS a(r), unnest(range(5)) AS b(c))
SELECT p.nid AS a, q.nid AS b, round({_dx} * {_dx} + {_dy} * {_dy}, 6) AS d2 FROM g p CROSS JOIN g q""",
    )
    def _grid(spark, d, t=_topology, pbc=_pbc):
        return lattice.grid_distance_table(lattice.neuron_table(spark, 6, 5, t), 6, 5, t, pbc).withColumn("d2", r6("d2"))


_KERNEL_SQL = {
    "gaussian": "exp(-d2 / (2 * 1.5 * 1.5))",
    "mexican_hat": "(1 - 0.25 * d2 / (1.5 * 1.5)) * exp(-d2 / (2 * 1.5 * 1.5))",
    "bubble": "CASE WHEN d2 <= 1.5 * 1.5 THEN 1 ELSE 0 END",
    "triangle": "greatest(1.5 - sqrt(d2), 0) / 1.5",
}
for _name in NEIGHBORHOODS:

    @query(
        f"kernel_{_name}",
        f"""WITH g AS (SELECT (r * 5 + c)::INTEGER AS nid, r, c FROM unnest(range(5)) AS a(r), unnest(range(5)) AS b(c)),
p AS (SELECT g.nid AS bmu, q.nid AS neuron_id, ((g.r - q.r) * (g.r - q.r) + (g.c - q.c) * (g.c - q.c))::DOUBLE AS d2 FROM g CROSS JOIN g q)
SELECT bmu, neuron_id, round(({_KERNEL_SQL[_name]})::DOUBLE, 6) + 0.0::DOUBLE AS h FROM p""",
    )
    def _kernel(spark, d, name=_name):
        pairs = lattice.grid_distance_table(lattice.neuron_table(spark, 5, 5), 5, 5, "rectangular", False)
        return pairs.select(F.col("a").alias("bmu"), F.col("b").alias("neuron_id"), r6(NEIGHBORHOODS[name](F.col("d2"), 1.5)).alias("h"))


@query(
    "decay_schedules",
    """SELECT t AS epoch, round(0.5::DOUBLE * 0.2 / (0.2 + t), 6) AS lr_inverse, round(0.5::DOUBLE * (1 - t / 20.0::DOUBLE), 6) AS lr_linear,
round(3.0::DOUBLE / (1 + t * (2.0::DOUBLE / 20)), 6) AS sigma_inverse, round(3.0::DOUBLE + t * (-2.0::DOUBLE / 20), 6) AS sigma_linear,
round(0.5::DOUBLE / (1 + t / 10.0::DOUBLE), 6) AS lr_asymptotic, round(3.0::DOUBLE / (1 + t / 10.0::DOUBLE), 6) AS sigma_asymptotic FROM range(20) AS s(t)""",
)
def decay_schedules(spark, d):
    got = schedule_table(spark, 20, lr_inverse=("lr_inverse_decay_to_zero", 0.5), lr_linear=("lr_linear_decay_to_zero", 0.5), sigma_inverse=("sig_inverse_decay_to_one", 3.0), sigma_linear=("sig_linear_decay_to_one", 3.0), lr_asymptotic=("asymptotic_decay", 0.5), sigma_asymptotic=("asymptotic_decay", 3.0))
    return got.select("epoch", *(r6(c).alias(c) for c in got.columns[1:]))


@query(
    "hex_coords",
    """SELECT r::INTEGER AS row, c::INTEGER AS col, c - (r - r % 2) / 2.0::DOUBLE AS q, r::DOUBLE AS ar, -(c - (r - r % 2) / 2.0::DOUBLE) - r AS cube_y,
round((c + 0.5::DOUBLE * (r % 2)) * sqrt(3.0::DOUBLE), 6) AS display_x, round(r * 1.5::DOUBLE, 6) AS display_y, c + 0.5::DOUBLE * (r % 2) AS plot_x, round(r * sqrt(3.0::DOUBLE) / 2, 6) AS plot_y,
r::INTEGER AS back_row, c::INTEGER AS back_col FROM unnest(range(6)) AS a(r), unnest(range(5)) AS b(c)""",
)
def hex_coords(spark, d):
    g = lattice.neuron_table(spark, 6, 5).select("row", "col")
    row, col = F.col("row"), F.col("col")
    q, r = lattice.offset_to_axial(row, col)
    cube = lattice.axial_to_cube(q, r)
    back = lattice.axial_to_offset(*lattice.cube_to_axial(*cube))
    dx, dy = lattice.display_xy(row, col)
    px, py = lattice.plot_xy(row, col)
    return g.select("row", "col", q.alias("q"), r.alias("ar"), cube[1].alias("cube_y"), r6(dx).alias("display_x"), r6(dy).alias("display_y"), px.alias("plot_x"), r6(py).alias("plot_y"), back[0].alias("back_row"), back[1].alias("back_col"))


@query(
    "hex_distance_matrix",
    f"""WITH g AS (SELECT (r * 5 + c)::INTEGER AS nid, r, c FROM unnest(range(6)) AS a(r), unnest(range(5)) AS b(c))
SELECT p.nid AS a, q.nid AS b, ({sql_hex("p.r", "p.c", "q.r", "q.c")})::INTEGER AS d,
least({", ".join(sql_hex("p.r", "p.c", f"q.r + {i}", f"q.c + {j}") for i in (-6, 0, 6) for j in (-5, 0, 5))})::INTEGER AS torus FROM g p CROSS JOIN g q""",
)
def hex_distance_matrix(spark, d):
    g = lattice.neuron_table(spark, 6, 5)
    o = g.select(F.col("neuron_id").alias("b"), F.col("row").alias("r2"), F.col("col").alias("c2"))
    pair = (F.col("row"), F.col("col"), F.col("r2"), F.col("c2"))
    return g.crossJoin(F.broadcast(o)).select(F.col("neuron_id").alias("a"), "b", lattice.offset_distance(*pair).alias("d"), lattice.torus_offset_distance(*pair, 6, 5).alias("torus"))


@query(
    "hex_six_neighbors",
    """WITH g AS (SELECT r, c FROM unnest(range(4)) AS a(r), unnest(range(3)) AS b(c))
SELECT r::INTEGER AS row, c::INTEGER AS col, (r + dr)::INTEGER AS nbr_row, (c + dc + CASE WHEN dr <> 0 THEN r % 2 ELSE 0 END)::INTEGER AS nbr_col
FROM g, (VALUES (-1, -1), (-1, 0), (0, -1), (0, 1), (1, -1), (1, 0)) AS o(dr, dc)""",
)
def hex_six_neighbors(spark, d):
    rows = [(r, c, a, b) for r in range(4) for c in range(3) for a, b in lattice.six_neighbors(r, c)]
    return spark.createDataFrame(rows, "row int, col int, nbr_row int, nbr_col int")


# ---- preparation: B1-B7, F16-F17


@query("zscore_pop", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER (), 6) AS z_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_pop(p_retailprice) OVER (), 6) AS z_price FROM part")
def zscore_pop(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("z_size"), F.col("p_retailprice").alias("z_price"))
    return prepare.standardize(part, ["z_size", "z_price"]).select("p_partkey", r6("z_size").alias("z_size"), r6("z_price").alias("z_price"))


@query("zscore_sample", "SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS z_size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS z_price FROM part")
def zscore_sample(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("z_size"), F.col("p_retailprice").alias("z_price"))
    return prepare.standardize(part, ["z_size", "z_price"], sample=True).select("p_partkey", r6("z_size").alias("z_size"), r6("z_price").alias("z_price"))


@query("train_test_split", "SELECT vec_id AS row_id, row_number() OVER (ORDER BY (vec_id * 2654435761) % 1000003, vec_id) <= floor(0.8 * count(*) OVER ()) AS is_train FROM embeddings")
def train_test_split(spark, d):
    return prepare.train_test_split(samples(spark, d).select("row_id"))


@query("label_encoding", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand)::INTEGER AS label FROM part")
def label_encoding(spark, d):
    return prepare.encode_labels(read_table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "label")


@query("nan_rows", "SELECT vec_id AS row_id FROM embeddings WHERE NOT (vec_id % 7 = 3)")
def nan_rows(spark, d):
    rows = samples(spark, d).withColumn("features", F.when(F.col("row_id") % 7 == 3, F.array(F.lit(float("nan")))).otherwise(F.col("features")))
    return prepare.drop_nan_rows(rows).select("row_id")


SQL_U = "WITH u AS (SELECT vec_id, i, embedding[i]::DOUBLE AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) AS s(i))"


def matrix(spark: SparkSession, values: np.ndarray, name: str) -> DataFrame:
    return spark.createDataFrame([(i, j, float(v)) for i, row in enumerate(values) for j, v in enumerate(row)], f"i int, j int, {name} double").withColumn(name, r6(name))


@query("column_covariance", f"{SQL_U} SELECT (a.i - 1)::INTEGER AS i, (b.i - 1)::INTEGER AS j, round(covar_samp(a.v, b.v), 6) + 0.0::DOUBLE AS cov FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i")
def column_covariance(spark, d):
    return matrix(spark, codebook.covariance(*codebook.moments(samples(spark, d))), "cov")


@query("gram_matrix", f"{SQL_U} SELECT (a.i - 1)::INTEGER AS i, (b.i - 1)::INTEGER AS j, round(sum(a.v * b.v), 6) + 0.0::DOUBLE AS gram FROM u a JOIN u b USING (vec_id) GROUP BY a.i, b.i")
def gram_matrix(spark, d):
    return matrix(spark, codebook.moments(samples(spark, d))[2], "gram")


@query("global_std", "SELECT round(stddev_samp(v), 6) AS sd FROM (SELECT unnest(embedding)::DOUBLE AS v FROM embeddings)")
def global_std(spark, d):
    return samples(spark, d).select(F.explode("features").alias("v")).agg(r6(F.stddev_samp("v")).alias("sd"))


# ---- training: G1-G5, F14-F15


def sql_fit(epochs: int, lr: float = 0.5, sigma: float = 1.0) -> str:
    """CTEs w0 ... wT (nid, f, x) of full-batch training on a 5 x 5 map."""
    parts = [f"{sql_e()}, {sql_cb()}", "l AS (SELECT row_id, v FROM e)", "u AS (SELECT row_id, f, v[f] AS x FROM e, unnest(range(1, len(v) + 1)) AS s(f))", "w0 AS (SELECT nid, f, w[f] AS x FROM cb, unnest(range(1, len(w) + 1)) AS s(f))"]
    for t in range(epochs):
        a, s = lr / (1 + t / (epochs / 2)), sigma / (1 + t / (epochs / 2))
        parts += [
            f"v{t} AS (SELECT nid, list(x ORDER BY f) AS w FROM w{t} GROUP BY nid)",
            f"b{t} AS (SELECT row_id, nid FROM (SELECT row_id, nid, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(v, w), nid) AS k FROM l CROSS JOIN v{t}) WHERE k = 1)",
            f"s{t} AS (SELECT b.nid, f, sum(x) AS s, count(*) AS n FROM b{t} b JOIN u USING (row_id) GROUP BY 1, 2)",
            f"h{t} AS (SELECT p.nid AS k, q.nid AS j, exp(-((p.r - q.r) * (p.r - q.r) + (p.c - q.c) * (p.c - q.c)) / (2 * {s}::DOUBLE * {s}::DOUBLE)) AS h FROM cb p CROSS JOIN cb q)",
            f"d{t} AS (SELECT k, f, sum(h * s) AS hs, sum(h * n) AS hn FROM h{t} JOIN s{t} ON nid = j GROUP BY k, f)",
            f"w{t + 1} AS (SELECT w.nid, w.f, w.x + {a}::DOUBLE / (SELECT count(*) FROM e) * (coalesce(hs, 0) - coalesce(hn, 0) * w.x) AS x FROM w{t} w LEFT JOIN d{t} ON d{t}.k = w.nid AND d{t}.f = w.f)",
        ]
    return ", ".join(parts)


def trained(spark: SparkSession, d: str, epochs: int, strategy: str) -> tuple[np.ndarray, list]:
    config = MapConfig(X, Y, epochs=epochs, learning_rate=0.5, sigma=1.0, strategy=strategy)
    return training.fit(samples(spark, d), config, codebook_array(book(spark, d)))


def long_form(spark: SparkSession, weights: np.ndarray) -> DataFrame:
    return maps.component_planes(codebook_table(spark, weights, Y)).select((F.col("row") * Y + F.col("col")).alias("neuron_id"), "feature", r6("value").alias("weight"))


for _epochs, _strategy in ((1, "local"), (2, "arrow")):

    @query(f"fit_epoch{_epochs}", f"WITH {sql_fit(_epochs)} SELECT nid AS neuron_id, (f - 1)::INTEGER AS feature, round(x, 6) AS weight FROM w{_epochs}")
    def _fit(spark, d, epochs=_epochs, strategy=_strategy):
        return long_form(spark, trained(spark, d, epochs, strategy)[0])


def sql_errors(t: int) -> str:
    return f"""v{t}e AS (SELECT nid, list(x ORDER BY f) AS w FROM w{t} GROUP BY nid),
k{t}e AS (SELECT row_id, nid, d, row_number() OVER (PARTITION BY row_id ORDER BY d, nid) AS k FROM (SELECT row_id, nid, list_distance(v, w) AS d FROM l CROSS JOIN v{t}e)),
x{t}e AS (SELECT row_id, max(CASE WHEN k = 1 THEN nid END) AS a, max(CASE WHEN k = 2 THEN nid END) AS b, min(d) AS d FROM k{t}e WHERE k <= 2 GROUP BY row_id)"""


@query(
    "fit_history",
    f"WITH {sql_fit(2)}, {sql_errors(1)}, {sql_errors(2)} "
    + " UNION ALL ".join(
        f"SELECT {t - 1} AS epoch, round(avg(d), 6) AS qe, round(100 * avg(CASE WHEN sqrt((a // 5 - b // 5) ** 2 + (a % 5 - b % 5) ** 2) > 1.42 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS te_pct FROM x{t}e" for t in (1, 2)
    ),
)
def fit_history(spark, d):
    _, history = trained(spark, d, 2, "local")
    return spark.createDataFrame(history, "epoch int, qe double, te_pct double").select("epoch", r6("qe").alias("qe"), r6("te_pct").alias("te_pct"))


BATCHES = 4


def sql_key(row_id: str, epoch: int, seed: int = 42) -> str:
    return f"(({row_id} % {prepare.BATCH_PRIME} + 1) * {pow(48271, epoch + seed + 1, prepare.BATCH_PRIME)} % {prepare.BATCH_PRIME})"


def sql_random(neurons: int = X * Y) -> str:
    """CTEs n0 (rows in shuffled order) and w0 (nid, f, x): a start from rows."""
    return f"""o0 AS (SELECT row_number() OVER (ORDER BY {sql_key("vec_id", 0)}, vec_id) - 1 AS k, embedding::DOUBLE[] AS v FROM embeddings),
w0 AS MATERIALIZED (SELECT nid::INTEGER AS nid, f, v[f] AS x FROM range({neurons}) AS g(nid) JOIN o0 ON k = nid % (SELECT count(*) FROM o0), unnest(range(1, len(v) + 1)) AS s(f))"""


def sql_minibatch(epochs: int, batches: int, lr: float = 0.5, sigma: float = 1.0) -> tuple[str, int]:
    """CTEs w0 ... wT of hexagonal training in batches that the shuffled order of ids gives, and T."""
    gx, gy = "(nid // 5 + 0.5::DOUBLE * (nid // 5 % 2))", "(nid % 5 * (sqrt(3.0::DOUBLE) / 2))"
    parts, t = [f"{sql_e()}, {sql_random()}, u AS MATERIALIZED (SELECT row_id, f, v[f] AS x FROM e, unnest(range(1, len(v) + 1)) AS s(f))", f"g AS (SELECT nid, {gx} AS gx, {gy} AS gy FROM range({X * Y}) AS r(nid))"], 0
    for epoch in range(epochs):
        a, s = lr / (1 + epoch / (epochs / 2)), sigma / (1 + epoch / (epochs / 2))
        parts.append(f"h_{epoch} AS MATERIALIZED (SELECT p.nid AS k, q.nid AS j, exp(-((p.gx - q.gx) ** 2 + (p.gy - q.gy) ** 2) / (2 * {s}::DOUBLE * {s}::DOUBLE)) AS h FROM g p CROSS JOIN g q)")
        for b in range(batches):
            parts += [
                f"v{t} AS MATERIALIZED (SELECT nid, list(x ORDER BY f) AS w FROM w{t} GROUP BY nid)",
                f"b{t} AS MATERIALIZED (SELECT row_id, nid FROM (SELECT row_id, nid, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(v, w), nid) AS k FROM e CROSS JOIN v{t} WHERE {sql_key('row_id', epoch)} % {batches} = {b}) WHERE k = 1)",
                f"s{t} AS MATERIALIZED (SELECT b.nid, f, sum(x) AS s, count(*) AS n FROM b{t} b JOIN u USING (row_id) GROUP BY 1, 2)",
                f"d{t} AS MATERIALIZED (SELECT k, f, sum(h * s) AS hs, sum(h * n) AS hn FROM h_{epoch} JOIN s{t} ON nid = j GROUP BY k, f)",
                f"w{t + 1} AS MATERIALIZED (SELECT w.nid, w.f, w.x + {a}::DOUBLE / (SELECT count(*) FROM b{t}) * (coalesce(hs, 0) - coalesce(hn, 0) * w.x) AS x FROM w{t} w LEFT JOIN d{t} ON d{t}.k = w.nid AND d{t}.f = w.f)",
            ]
            t += 1
    return ", ".join(parts), t


_SQL, _LAST = sql_minibatch(2, BATCHES)
for _name, _strategy in (("fit_minibatch", "arrow"), ("fit_minibatch_local", "local")):

    @query(_name, f"WITH {_SQL} SELECT nid AS neuron_id, (f - 1)::INTEGER AS feature, round(x, 6) AS weight FROM w{_LAST}")
    def _minibatch(spark, d, strategy=_strategy):
        rows = samples(spark, d)
        size = -(-rows.count() // BATCHES)
        config = MapConfig(X, Y, epochs=2, batch_size=size, topology="hexagonal", init="random", strategy=strategy)
        return long_form(spark, training.fit(rows, config)[0])


@query("pca_init")
def pca_init(spark, d):
    return long_form(spark, codebook.initial_weights(samples(spark, d), MapConfig(X, Y), "pca"))


@query("random_init", f"WITH {sql_random()} SELECT nid AS neuron_id, (f - 1)::INTEGER AS feature, round(x, 6) AS weight FROM w0")
def random_init(spark, d):
    return long_form(spark, codebook.initial_weights(samples(spark, d), MapConfig(X, Y), "random"))


# ---- retrieval: H1-H6, D6-D8, E5-E6


def split_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries (the 20 largest ids), history, and a codebook; the first component is the output."""
    rows = samples(spark, d).select("row_id", F.slice("features", 2, 63).alias("features"), F.col("features")[0].alias("output"))
    cut = rows.agg(F.max("row_id")).first()[0] - 19
    cb = book(spark, d).withColumn("w", F.slice("w", 2, 63))
    return rows.filter(F.col("row_id") >= cut), rows.filter(F.col("row_id") < cut), cb


def collected(spark: SparkSession, d: str, mode: str, threshold: int = 50) -> DataFrame:
    asked, history, cb = split_rows(spark, d)
    index = maps.bmu_index(bmu.assign(history, cb, second=False))
    queries = bmu.assign(asked, cb, second=False).select(F.col("row_id").alias("query_id"), F.col("nid1").alias("bmu"))
    return retrieval.collect_samples(queries, index, cb, lattice.neighbor_table(spark, X, Y, "rectangular", 1), mode, threshold, historical=history)


def sql_collect(mode: str, threshold: int = 50) -> str:
    tiers = ["SELECT u AS bmu, u AS nid, 1 AS tier FROM un JOIN fl ON fl.nid = u"]
    if mode != "bmu_only":
        tiers.append("SELECT u AS bmu, nbr_id AS nid, 2 AS tier FROM un JOIN nb ON neuron_id = u JOIN fl ON fl.nid = nbr_id")
    extra = ""
    if mode == "bmu_neighborhood_knn":
        extra = f""",
got AS (SELECT u, coalesce(sum(n), 0) AS got FROM un LEFT JOIN t12 ON bmu = u LEFT JOIN fl ON fl.nid = t12.nid GROUP BY u HAVING coalesce(sum(n), 0) <= {threshold}),
cand AS (SELECT u AS bmu, fl.nid, n, got, coalesce(sum(n) OVER (PARTITION BY u ORDER BY list_distance(a.w, b.w), fl.nid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM got JOIN cb a ON a.nid = u CROSS JOIN fl JOIN cb b ON b.nid = fl.nid WHERE NOT EXISTS (SELECT 1 FROM t12 WHERE t12.bmu = u AND t12.nid = fl.nid)),
tiers AS (SELECT * FROM t12 UNION ALL SELECT bmu, nid, 3 FROM cand WHERE got + ahead <= {threshold})"""
    else:
        extra = ", tiers AS (SELECT * FROM t12)"
    return f"""e AS (SELECT vec_id AS row_id, embedding[2:]::DOUBLE[] AS v, embedding[1]::DOUBLE AS output FROM embeddings),
cb AS (SELECT vec_id::INTEGER AS nid, embedding[2:]::DOUBLE[] AS w FROM embeddings WHERE vec_id < {X * Y}), {sql_offsets("rectangular", 1)}, {sql_neighbors(X, Y)},
b AS (SELECT row_id, nid, (row_id > (SELECT max(row_id) FROM e) - 20) AS is_query FROM (SELECT row_id, nid, row_number() OVER (PARTITION BY row_id ORDER BY list_distance(v, w), nid) AS k FROM e CROSS JOIN cb) WHERE k = 1),
ix AS (SELECT nid, row_id FROM b WHERE NOT is_query), fl AS (SELECT nid, count(*) AS n FROM ix GROUP BY nid), un AS (SELECT DISTINCT nid AS u FROM b WHERE is_query),
t12 AS ({" UNION ALL ".join(tiers)}){extra},
res AS (SELECT q.row_id AS query_id, tier, ix.row_id FROM b q JOIN tiers ON bmu = q.nid JOIN ix ON ix.nid = tiers.nid WHERE q.is_query)"""


for _short, _mode in (("bmu_only", "bmu_only"), ("neighborhood", "bmu_neighborhood"), ("knn", "bmu_neighborhood_knn")):

    @query(f"collect_{_short}", f"WITH {sql_collect(_mode, 120 if _short == 'knn' else 50)} SELECT query_id, tier::INTEGER AS tier, row_id FROM res")
    def _collect(spark, d, mode=_mode):
        return collected(spark, d, mode, 120 if mode.endswith("knn") else 50).select("query_id", "tier", "row_id")


@query("local_line", f"WITH {sql_collect('bmu_neighborhood_knn')} SELECT query_id, count(*) AS n, round(regr_slope(output, v[1]), 6) AS slope, round(regr_intercept(output, v[1]), 6) AS intercept FROM res JOIN e ON e.row_id = res.row_id GROUP BY query_id")
def local_line(spark, d):
    rows = collected(spark, d, "bmu_neighborhood_knn").withColumn("x", F.col("features")[0])
    return retrieval.local_line(rows, "x", "output").select("query_id", "n", r6("slope").alias("slope"), r6("intercept").alias("intercept"))


@query("local_mean", f"WITH {sql_collect('bmu_neighborhood')} SELECT query_id, round(avg(output), 6) AS prediction, count(*) AS n FROM res JOIN e ON e.row_id = res.row_id GROUP BY query_id")
def local_mean(spark, d):
    return retrieval.local_mean(collected(spark, d, "bmu_neighborhood"), "output").withColumn("prediction", r6("prediction"))


@query("local_ols")
def local_ols(spark, d):
    rows = collected(spark, d, "bmu_neighborhood_knn")
    return retrieval.local_ols(rows, "features", "output").withColumn("coef", F.transform("coef", lambda c: F.round(c, 6)))


# ---- clustering and its scores: G7-G14, F18-F26


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The codebook's neurons, clustered by rows of the grid; one neuron is noise."""
    label = F.when(F.col("neuron_id") == 7, -1).otherwise(F.expr("cast(row div 2 as int)"))
    return book(spark, d).select(F.col("neuron_id").alias("id"), "row", "col", label.alias("label"), F.col("w").alias("features"))


SQL_P = f"WITH {sql_cb()}, p AS (SELECT nid AS id, r, c, (r // 2)::INTEGER AS label, w AS f FROM cb WHERE nid <> 7)"
SQL_CENTER = "m AS (SELECT label, i, avg(f[i]) AS v, count(*) AS n FROM p, unnest(range(1, len(f) + 1)) AS s(i) GROUP BY label, i), ce AS (SELECT label, list(v ORDER BY i) AS f, max(n) AS n FROM m GROUP BY label)"


@query(
    "silhouette",
    f"""{SQL_P}, d AS (SELECT a.id, a.label, b.label AS ol, avg(list_distance(a.f, b.f)) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT id, max(CASE WHEN ol = label THEN d END) AS a, min(CASE WHEN ol <> label THEN d END) AS b FROM d GROUP BY id)
SELECT round(avg(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM s""",
)
def silhouette(spark, d):
    return scores.silhouette(labelled(spark, d)).select(r6("silhouette").alias("silhouette"))


@query(
    "davies_bouldin",
    f"""{SQL_P}, {SQL_CENTER}, sp AS (SELECT label, any_value(ce.f) AS f, avg(list_distance(p.f, ce.f)) AS s FROM p JOIN ce USING (label) GROUP BY label),
w AS (SELECT a.label, max((a.s + b.s) / list_distance(a.f, b.f)) AS r FROM sp a JOIN sp b ON a.label <> b.label GROUP BY a.label) SELECT round(avg(r), 6) AS davies_bouldin FROM w""",
)
def davies_bouldin(spark, d):
    return scores.davies_bouldin(labelled(spark, d)).select(r6("davies_bouldin").alias("davies_bouldin"))


@query(
    "calinski_harabasz",
    f"""{SQL_P}, {SQL_CENTER}, al AS (SELECT list(v ORDER BY i) AS f FROM (SELECT i, avg(f[i]) AS v FROM p, unnest(range(1, len(f) + 1)) AS s(i) GROUP BY i)),
b AS (SELECT sum(n * list_distance(ce.f, al.f) ** 2) AS b, count(*) AS k FROM ce, al), w AS (SELECT sum(list_distance(p.f, ce.f) ** 2) AS w, count(*) AS n FROM p JOIN ce USING (label))
SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS calinski_harabasz FROM b, w""",
)
def calinski_harabasz(spark, d):
    return scores.calinski_harabasz(labelled(spark, d)).select(r6("calinski_harabasz").alias("calinski_harabasz"))


for _topology in ("rectangular", "hexagonal"):
    _cell = "sqrt((a.r - b.r) ** 2 + (a.c - b.c) ** 2)" if _topology == "rectangular" else sql_hex("a.r", "a.c", "b.r", "b.c")

    @query(
        f"topological_quality_{_topology[:4].replace('hexa', 'hex')}",
        f"""{SQL_P}, q AS (SELECT a.label, avg({_cell}) AS d, count(DISTINCT a.id) AS n FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id GROUP BY a.label)
SELECT round(sum(n / (1 + d / 5)) / sum(n), 6) AS topological_quality FROM q""",
    )
    def _topological(spark, d, t=_topology):
        return scores.topological_quality(labelled(spark, d), X, Y, t).select(r6("topological_quality").alias("topological_quality"))


@query("cluster_counts", f"WITH {sql_cb()}, p AS (SELECT CASE WHEN nid = 7 THEN -1 ELSE r // 2 END AS label FROM cb) SELECT count(DISTINCT CASE WHEN label <> -1 THEN label END) AS n_clusters, count(*) FILTER (label = -1) AS n_noise_points, round(count(*) FILTER (label = -1) / count(*)::DOUBLE, 6) AS noise_ratio FROM p")
def cluster_counts(spark, d):
    return scores.cluster_counts(labelled(spark, d)).withColumn("noise_ratio", r6("noise_ratio"))


@query("cluster_centers", f"{SQL_P}, {SQL_CENTER} SELECT label, n, (i - 1)::INTEGER AS feature, round(ce.f[i], 6) AS value FROM ce, unnest(range(1, len(ce.f) + 1)) AS s(i)")
def cluster_centers(spark, d):
    return scores.centers(labelled(spark, d)).select("label", "n", F.posexplode("center").alias("feature", "value")).withColumn("value", r6("value"))


def clustered(spark: SparkSession, d: str, method: str, k: int | None = None, x: int = 8, y: int = 6, **options) -> DataFrame:
    weights = codebook_array(book(spark, d, x, y))
    return clustering.cluster(spark, weights, method, k, **options).table(spark, y)


@query("cluster_kmeans")
def cluster_kmeans(spark, d):
    return clustered(spark, d, "kmeans", 3)


@query("cluster_gmm")
def cluster_gmm(spark, d):
    return clustered(spark, d, "gmm", 2)


@query("cluster_gmm_large")
def cluster_gmm_large(spark, d):
    """More neurons than components, so that the covariances have full rank."""
    return clustered(spark, d, "gmm", 2, x=20, y=20)


@query("bic_k")
def bic_k(spark, d):
    """BIC and AIC of mixtures of 1 to 4 components, and which has the lowest BIC."""
    weights = codebook_array(book(spark, d, 20, 20))
    found = [(k, *(float(clustering.gmm(spark, weights, k).extra[c]) for c in ("bic", "aic"))) for k in range(1, 5)]
    best = min(found, key=lambda r: r[1])[0]
    return spark.createDataFrame([(k, round(b, 6), round(a, 6), k == best) for k, b, a in found], "k int, bic double, aic double, is_best boolean")


@query("silhouette_samples", f"""{SQL_P}, d AS (SELECT a.id, a.label, b.label AS ol, avg(list_distance(a.f, b.f)) AS d FROM p a JOIN p b ON a.id <> b.id GROUP BY 1, 2, 3),
s AS (SELECT id, any_value(label) AS label, max(CASE WHEN ol = label THEN d END) AS a, min(CASE WHEN ol <> label THEN d END) AS b FROM d GROUP BY id)
SELECT id, label, round(CASE WHEN a IS NULL OR b IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END, 6) AS s FROM s""")
def silhouette_samples(spark, d):
    return scores.silhouette_samples(labelled(spark, d)).select("id", "label", r6("s").alias("s"))


@query("cluster_hdbscan")
def cluster_hdbscan(spark, d):
    return clustered(spark, d, "hdbscan", min_cluster_size=3)


@query("auto_k")
def auto_k(spark, d):
    weights = codebook_array(book(spark, d))
    curve = clustering.inertia_curve(spark, weights, 5, starts=2)
    return clustering.inertia_table(spark, curve).withColumns({"inertia": F.round("inertia", 6), "is_elbow": F.col("k") == clustering.elbow_of(curve)})


# ---- streams: S8


def stream_rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double")
    return read_table(spark, d, "events").select("event_id", "ts", F.array(F.col("value") / 100, k / 100).alias("features"))


def stream_book() -> np.ndarray:
    i = np.arange(9)
    return np.column_stack((i // 3 / 2.0 + 0.013, i % 3 / 2.0 + 0.007))


SQL_STREAM = """s AS (SELECT event_id, ts, [value / 100, (props::JSON ->> '$.k')::DOUBLE / 100]::DOUBLE[] AS v FROM events),
g AS (SELECT i::INTEGER AS nid, [i // 3 / 2.0 + 0.013, i % 3 / 2.0 + 0.007]::DOUBLE[] AS w FROM range(9) AS t(i)),
b AS (SELECT event_id, ts, nid, d FROM (SELECT event_id, ts, nid, list_distance(v, w) AS d, row_number() OVER (PARTITION BY event_id ORDER BY list_distance(v, w), nid) AS k FROM s CROSS JOIN g) WHERE k = 1)"""


@query("stream_bmu", f"WITH {SQL_STREAM} SELECT event_id, nid AS nid1, round(d, 6) AS d1 FROM b")
def stream_bmu(spark, d):
    return streaming.assign_stream(stream_rows(spark, d), stream_book()).select("event_id", "nid1", r6("d1").alias("d1"))


@query("qe_by_window", f"WITH {SQL_STREAM} SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, count(*) AS n, round(avg(d), 6) AS qe FROM b GROUP BY 1")
def qe_by_window(spark, d):
    got = streaming.drift_by_window(streaming.assign_stream(stream_rows(spark, d), stream_book()))
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n", r6("qe").alias("qe"))


@query("hits_by_window", f"WITH {SQL_STREAM} SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, nid, count(*) AS n FROM b GROUP BY 1, 2")
def hits_by_window(spark, d):
    got = streaming.hits_by_window(streaming.assign_stream(stream_rows(spark, d), stream_book()))
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "nid", "n")
