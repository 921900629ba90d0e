"""Queries over the test tables, one per operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quartzite.functions.columns import micros
from quartzite.operators import bilinear, cluster, draws, factors, graph, impute, prepare, som, trace
from quartzite.plans.registry import LINE, PART, query, rounded, table
from quartzite.sources import prv
from quartzite.storage import cut


@query("oca_inertia")
def oca_inertia(spark, sf_dir):
    """Prepare, fit a map, explain its shape: the flagship flow."""
    own = prepare.fill(prepare.zeros_missing(table(spark, sf_dir, "lineitem").select(*LINE), ["l_tax", "l_discount"]), LINE, "mean")
    own = cut(prepare.standardise(own, LINE))  # read once an epoch
    lattice = som.Lattice(6, 6)
    codebook, _ = som.train_batch(own, LINE, lattice, som.regular_grid(lattice, *som.bounds(own, LINE)), epochs=5)
    return som.inertia(spark, codebook, LINE)


@query(
    "prep_filter_derive",
    "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 6) as net, round(abs(l_discount - l_tax), 6) as gap from lineitem where l_quantity > 10 and l_discount < 0.05",
)
def prep_filter_derive(spark, sf_dir):
    own = prepare.keep(table(spark, sf_dir, "lineitem"), ["l_quantity > 10", "l_discount < 0.05"])
    own = prepare.derive(own, {"net": "l_extendedprice * (1 - l_discount)", "gap": "euclidean(l_discount, l_tax)"})
    return rounded(own.select("l_orderkey", "l_linenumber", "net", "gap"), "net", "gap")


@query(
    "zero_to_null_profile",
    " union all ".join(f"select '{c}' as feature, count(*) filter (where nullif({c}, 0) is null) as n_missing, round(count(*) filter (where nullif({c}, 0) is null)::double / count(*), 6) as ratio from lineitem" for c in LINE),
)
def zero_to_null_profile(spark, sf_dir):
    return rounded(prepare.missing_profile(prepare.zeros_missing(table(spark, sf_dir, "lineitem"), LINE), LINE), "ratio")


@query("missing_pattern", "select " + " || ".join(f"(nullif({c}, 0) is null)::int::varchar" for c in LINE) + " as pattern, count(*) as n_rows from lineitem group by 1")
def missing_pattern(spark, sf_dir):
    return prepare.missing_patterns(prepare.zeros_missing(table(spark, sf_dir, "lineitem"), LINE), LINE)


_FILL_SQL = {"mean": "avg(x)", "median": "quantile_cont(x, 0.5)", "geo": "exp(avg(ln(x)) filter (where x > 0))", "harmonic": "count(x) / sum(1.0 / x)", "max": "max(x)", "min": "min(x)", "zero": "max(0.0)"}
for _method, _sql in _FILL_SQL.items():

    @query(f"fill_{_method}", f"with own as (select l_orderkey, l_linenumber, nullif(l_tax, 0) as x from lineitem), f as (select {_sql} as v from own) select l_orderkey, l_linenumber, round(coalesce(x, v), 6) as l_tax from own, f")
    def _fill(spark, sf_dir, method=_method):
        own = prepare.zeros_missing(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax"), ["l_tax"])
        return rounded(prepare.fill(own, ["l_tax"], method), "l_tax")


def _scaled(name: str, fn: Callable[[DataFrame], DataFrame], of: Callable[[str], str]):
    cols = ", ".join(f"round({of(c)}, 6) as {c}" for c in PART)

    @query(name, f"select p_partkey, {cols} from part")
    def _run(spark, sf_dir):
        return rounded(fn(table(spark, sf_dir, "part").select("p_partkey", *PART)), *PART)


_scaled("standardize", lambda d: prepare.standardise(d, PART), lambda c: f"({c} - (select avg({c}) from part)) / (select stddev_pop({c}) from part)")
_scaled("standardize_sample", lambda d: prepare.standardise(d, PART, sample=True), lambda c: f"({c} - (select avg({c}) from part)) / (select stddev_samp({c}) from part)")
_scaled("minmax", lambda d: prepare.min_max(d, PART), lambda c: f"({c} - (select min({c}) from part))::double / (select max({c}) - min({c}) from part)")
_scaled("norm_l1", lambda d: prepare.normalise(d, PART, "l1"), lambda c: f"{c}::double / (select sum(abs({c})) from part)")
_scaled("norm_l2", lambda d: prepare.normalise(d, PART, "l2"), lambda c: f"{c}::double / (select sqrt(sum({c}::double * {c})) from part)")
_scaled("norm_max", lambda d: prepare.normalise(d, PART, "max"), lambda c: f"{c}::double / (select max(abs({c})) from part)")
_scaled("log_transfer", lambda d: prepare.logarithm(d, PART), lambda c: f"log10({c})")


@query("feature_importance", "with v as (select " + ", ".join(f"var_samp({c}) as {c}" for c in LINE) + " from lineitem) " + " union all ".join(f"select '{c}' as feature, round({c}, 4) as variance, round({c} / ({' + '.join(LINE)}), 6) as share from v" for c in LINE))
def feature_importance(spark, sf_dir):
    return rounded(rounded(prepare.feature_importance(table(spark, sf_dir, "lineitem"), LINE), "share"), "variance", digits=4)


@query("corr_filter", " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(LINE) for b in LINE[i + 1 :]))
def corr_filter(spark, sf_dir):
    return rounded(prepare.correlations(table(spark, sf_dir, "lineitem"), LINE), "r")


@query("group_size_std", "select l_returnflag, count(*) as n_rows, round((" + " + ".join(f"stddev_samp({c})" for c in LINE) + ") / 4.0, 4) as mean_std from lineitem group by 1")
def group_size_std(spark, sf_dir):
    return rounded(prepare.group_summary(table(spark, sf_dir, "lineitem"), "l_returnflag", LINE), "mean_std", digits=4)


@query("group_centroids", "select l_returnflag, " + ", ".join(f"round(avg({c}), 4) as {c}" for c in LINE) + " from lineitem group by 1")
def group_centroids(spark, sf_dir):
    return rounded(prepare.centroids(table(spark, sf_dir, "lineitem"), "l_returnflag", LINE), *LINE, digits=4)


@query("cluster_duration_rank", "with t as (select o_orderpriority, round(sum(o_totalprice), 2) as total from orders group by 1) select o_orderpriority, total, (row_number() over (order by total desc, o_orderpriority) - 1)::int as rank from t")
def cluster_duration_rank(spark, sf_dir):
    return rounded(prepare.rank_by_duration(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice"), "total", digits=2)


@query("crosstab", "select l_returnflag, count(*) filter (where l_linestatus = 'F') as F, count(*) filter (where l_linestatus = 'O') as O from lineitem group by 1")
def crosstab(spark, sf_dir):
    return prepare.crosstab(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"])


@query("freq_topk", "select o_custkey, count(*) as n_rows from orders group by 1 order by 2 desc, 1 limit 10")
def freq_topk(spark, sf_dir):
    return prepare.frequencies(table(spark, sf_dir, "orders"), "o_custkey", 10)


@query("describe", " union all ".join(f"select '{c}' as feature, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as least, quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as median, quantile_cont({c}, 0.75) as q3, max({c})::double as most from lineitem" for c in LINE))
def describe(spark, sf_dir):
    return rounded(prepare.describe(table(spark, sf_dir, "lineitem"), LINE), "mean", "std", digits=4)


@query("label_encode", "select c_custkey, c_mktsegment, (dense_rank() over (order by c_mktsegment) - 1)::int as code from customer")
def label_encode(spark, sf_dir):
    return prepare.encode_labels(table(spark, sf_dir, "customer"), "c_mktsegment", "code").select("c_custkey", "c_mktsegment", "code")


@query("balance_count", "with t as (select c_mktsegment, count(*) as n_rows from customer group by 1) select c_mktsegment, n_rows, (select max(n_rows) from t) as target from t")
def balance_count(spark, sf_dir):
    return prepare.balanced_counts(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("union_all", "select s_suppkey as k, s_acctbal as v from supplier union all select c_custkey, c_acctbal from customer")
def union_all(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("v"))
    return a.unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v")))


@query("index_concat", "select coalesce(s_suppkey, n_nationkey::bigint) as row_id, s_name, n_name from supplier full join nation on s_suppkey = n_nationkey")
def index_concat(spark, sf_dir):
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_name")
    return a.join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("row_id"), "n_name"), "row_id", "full")


@query("anti_join", "select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def anti_join(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("equal_width_bins", "select least(floor((p_retailprice - a) / (b - a) * 100), 99)::bigint as bin, count(*) as n_rows from part, (select min(p_retailprice) as a, max(p_retailprice) as b from part) group by 1")
def equal_width_bins(spark, sf_dir):
    own = prepare.with_stats(table(spark, sf_dir, "part"), {"_a": F.min("p_retailprice"), "_b": F.max("p_retailprice")})
    bin_ = F.least(F.floor((F.col("p_retailprice") - F.col("_a")) / (F.col("_b") - F.col("_a")) * 100), F.lit(99)).cast("long")
    return own.groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("trace_duration", "select event_id, epoch_us(ts) - coalesce(lag(epoch_us(ts)) over (partition by user_id order by ts, event_id), 0) as duration from events")
def trace_duration(spark, sf_dir):
    return trace.durations(table(spark, sf_dir, "events"), "user_id", micros("ts"), ["ts", "event_id"]).select("event_id", "duration")


@query("trace_next_edge", "select event_id::varchar as src, coalesce(lead(event_id::varchar) over (partition by user_id order by ts, event_id), 'finish') as dst from events")
def trace_next_edge(spark, sf_dir):
    return trace.successors(table(spark, sf_dir, "events"), "user_id", "event_id", ["ts", "event_id"])


def _prv_lines(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("cpu"), F.lit(1).alias("appl"), (F.col("user_id") + 1).alias("task"), F.lit(1).alias("thread"), micros("ts").alias("t"), F.col("value").cast("long").alias("cyc"), (F.col("event_id") % 7).alias("ins"))
    lines = prv.render_events(own, ["cpu", "appl", "task", "thread"], "t", {"42000059": "cyc", "42000050": "ins", "70000001": "event_id"})
    ids = F.element_at(F.split("value", ":"), -1).cast("long")
    return lines.withColumn("line_no", ids)


_COUNTERS = {"42000059": "cyc", "42000050": "ins", "70000001": "event_id"}


@query(
    "prv_parse",
    """with own as (select event_id, '1.1.' || (user_id + 1) || '.1' as object_id, epoch_us(ts) as ts, trunc(value)::bigint as cyc, event_id % 7 as ins, user_id from events),
    d as (select *, ts - coalesce(lag(ts) over (partition by user_id order by ts, event_id), 0) as duration from own)
    select event_id, object_id, ts, duration, cyc, ins, round(ins::double / nullif(cyc, 0), 6) as ipc from d where not (cyc = 0 and ins = 0)""",
)
def prv_parse(spark, sf_dir):
    own = prv.events(_prv_lines(spark, sf_dir), _COUNTERS, cycles="cyc", instructions="ins")
    return rounded(own.select("event_id", "object_id", "ts", "duration", "cyc", "ins", "ipc"), "ipc")


@query(
    "prv_edit",
    """select '2:1:1:' || (user_id + 1) || ':1:' || epoch_us(ts) || ':42000059:' || case when event_id % 5 = 0 then 77 else trunc(value)::bigint end || ':42000050:' || (event_id % 7) || ':70000001:' || event_id
    || case when event_id % 5 = 0 then ':99:' || event_id else '' end as value from events""",
)
def prv_edit(spark, sf_dir):
    own = table(spark, sf_dir, "events").where("event_id % 5 = 0").select(F.concat(F.lit("1.1."), (F.col("user_id") + 1).cast("string"), F.lit(".1")).alias("object_id"), micros("ts").alias("ts"), "event_id")
    edits = own.select("object_id", "ts", F.explode(F.array(F.struct(F.lit("42000059").alias("code"), F.lit("77").alias("new_value"), F.lit("u").alias("tag")), F.struct(F.lit("99").alias("code"), F.col("event_id").cast("string").alias("new_value"), F.lit("a").alias("tag")))).alias("e")).select("object_id", "ts", "e.*")
    return prv.edit(_prv_lines(spark, sf_dir), edits).select("value")


@query(
    "burst_overlap",
    """with b as (select event_id, epoch_us(ts) - (select min(epoch_us(ts)) from events) as b, epoch_us(ts) - (select min(epoch_us(ts)) from events) + 1000000 + (value * 1000000)::bigint as e from events)
    select x.event_id, round(sum(greatest(0, least(x.e, y.e) - greatest(x.b, y.b)))::double / (x.e - x.b), 5) as factor from b x, b y group by x.event_id, x.e, x.b""",
)
def burst_overlap(spark, sf_dir):
    own = prepare.with_stats(table(spark, sf_dir, "events").withColumn("t", micros("ts")), {"_low": F.min("t")})
    b = F.col("t") - F.col("_low")
    bursts = own.select("event_id", b.alias("b"), (b + 1_000_000 + F.round(F.col("value") * 1_000_000).cast("long")).alias("e"))
    return rounded(trace.overlap(bursts, "event_id", "b", "e"), "factor", digits=5)


@query("comm_graph", "select s.event_id as src, r.event_id as dst, epoch_us(r.ts) - epoch_us(s.ts) as weight from events s join events r on r.event_id = s.event_id + 1 where s.event_id % 2 = 0")
def comm_graph(spark, sf_dir):
    own = table(spark, sf_dir, "events").withColumn("t", micros("ts"))
    sends = own.where("event_id % 2 = 0").select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("m"), F.col("t").alias("sent"))
    return trace.communications(sends, own.select(F.col("event_id").alias("dst"), F.col("event_id").alias("m"), F.col("t").alias("got")), "m", "sent", "got")


_KNN_SQL = """with v as (select vec_id, embedding::double[] as e from embeddings),
d as (select a.vec_id as src, b.vec_id as dst, list_distance(a.e, b.e) as distance from v a join v b on a.vec_id <> b.vec_id),
g as (select src, dst, distance from (select *, row_number() over (partition by src order by distance, dst) as r from d) where r <= 7) """


def _knn(spark, sf_dir, k: int = 7) -> DataFrame:
    return graph.knn(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k)


@query("knn_graph", _KNN_SQL + "select src, dst, round(distance, 6) as distance from g")
def knn_graph(spark, sf_dir):
    return rounded(_knn(spark, sf_dir), "distance")


@query("knn_rbf", _KNN_SQL + "select src, dst, round(exp(-0.5 * distance * distance), 6) as weight from g")
def knn_rbf(spark, sf_dir):
    return rounded(graph.weighted(_knn(spark, sf_dir)).select("src", "dst", "weight"), "weight")


@query("knn_degree", _KNN_SQL + "select vec_id as id, (select count(*) from g where src = vec_id) as out_degree, (select count(*) from g where dst = vec_id) as in_degree from v")
def knn_degree(spark, sf_dir):
    return graph.degrees(_knn(spark, sf_dir))


@query("knn_mutual", _KNN_SQL + "select a.src, a.dst, round(a.distance, 6) as distance from g a join g b on a.src = b.dst and a.dst = b.src")
def knn_mutual(spark, sf_dir):
    return rounded(graph.mutual(_knn(spark, sf_dir)), "distance")


@query(
    "laplacian_score",
    _KNN_SQL
    + """, w as (select src, dst, exp(-0.5 * distance * distance) as w from g), deg as (select src as id, sum(w) as d from w group by 1),
f as (select vec_id as id, unnest(range(0, len(e))) as feature, unnest(e) as f from v), m as (select feature, sum(f * d) / sum(d) as m from f join deg using (id) group by 1),
h as (select f.id, f.feature, d, f - m as h from f join m using (feature) join deg on deg.id = f.id),
x as (select a.feature, sum(w * a.h * b.h) as ww from w join h a on a.id = src join h b on b.id = dst and b.feature = a.feature group by 1)
select h.feature::int as feature, round(abs(sum(d * h * h) - any_value(ww)), 6) as score from h join x using (feature) group by h.feature""",
)
def laplacian_score(spark, sf_dir):
    return rounded(graph.laplacian_scores(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", graph.weighted(_knn(spark, sf_dir))), "score")


@query("graph_merge", _KNN_SQL + ", a as (select * from g where src % 2 = 0), b as (select src, dst, distance * 0.9 as distance from g where dst % 2 = 0) select src, dst, round(min(distance), 6) as distance from (select * from a union all select * from b) group by 1, 2")
def graph_merge(spark, sf_dir):
    own = _knn(spark, sf_dir)
    return rounded(graph.merge(own.where("src % 2 = 0"), own.where("dst % 2 = 0").withColumn("distance", F.col("distance") * 0.9)), "distance")


@query(
    "mahalanobis",
    """with s as (select avg(p_size) as mx, avg(p_retailprice) as my, var_samp(p_size) as a, var_samp(p_retailprice) as c, covar_samp(p_size, p_retailprice) as b from part)
    select p_partkey, round((c * (p_size - mx) ^ 2 - 2 * b * (p_size - mx) * (p_retailprice - my) + a * (p_retailprice - my) ^ 2) / (a * c - b * b), 6) as distance from part, s""",
)
def mahalanobis(spark, sf_dir):
    return rounded(prepare.mahalanobis(table(spark, sf_dir, "part"), PART).select("p_partkey", "distance"), "distance")


_GRID_SQL = """with s as (select min(p_size)::double as ax, max(p_size)::double as bx, min(p_retailprice) as ay, max(p_retailprice) as b_y from part),
n as (select (i * 8 + j)::bigint as neuron, i, j, ax - 0.2 * (bx - ax) + i * 1.4 * (bx - ax) / 7 as x, ay - 0.2 * (b_y - ay) + j * 1.4 * (b_y - ay) / 7 as y from range(8) a(i), range(8) b(j), s),
u as (select p_partkey, arg_min(neuron, ((p_size - x) ^ 2 + (p_retailprice - y) ^ 2)) as bmu from part, n group by 1) """


def _grid(spark, sf_dir) -> tuple[DataFrame, som.Lattice, np.ndarray]:
    own, lattice = table(spark, sf_dir, "part").select("p_partkey", *PART), som.Lattice(8, 8)
    return own, lattice, som.regular_grid(lattice, *som.bounds(own, PART))


@query("som_bmu", _GRID_SQL + "select p_partkey, bmu::int as bmu from u")
def som_bmu(spark, sf_dir):
    own, _, codebook = _grid(spark, sf_dir)
    return som.best_units(own, PART, codebook).select("p_partkey", "bmu")


@query("som_hits", _GRID_SQL + "select neuron, count(bmu) as n_rows from n left join u on bmu = neuron group by 1")
def som_hits(spark, sf_dir):
    own, lattice, codebook = _grid(spark, sf_dir)
    return som.hits(som.best_units(own, PART, codebook), "bmu", lattice)


@query("som_umatrix", _GRID_SQL + "select a.neuron, round(avg(sqrt((a.x - b.x) ^ 2 + (a.y - b.y) ^ 2)), 6) as distance from n a join n b on abs(a.i - b.i) + abs(a.j - b.j) = 1 group by 1")
def som_umatrix(spark, sf_dir):
    _, lattice, codebook = _grid(spark, sf_dir)
    return rounded(som.unified_distances(spark, codebook, lattice), "distance")


@query("som_train")
def som_train(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "part").select(*PART), PART)
    lattice = som.Lattice(8, 8)
    return som.codebook_table(spark, som.train_online(own, PART, lattice, som.initial(own, PART, lattice, "rrg"), epochs=300)[0])


@query("som_train_batch")
def som_train_batch(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "part").select(*PART), PART)
    lattice = som.Lattice(8, 8)
    return som.codebook_table(spark, som.train_batch(own, PART, lattice, som.regular_grid(lattice, *som.bounds(own, PART)), epochs=5)[0])


@query(
    "blt_forward",
    """with p as (select p_partkey, p_size::double as x, p_retailprice::double as y from part), c as (select *, floor(x / 10) as i, floor((y - 900) / 500) as j from p),
    q as (select *, (x - i * 10) / 10 as u, (y - 900 - j * 500) / 500 as v from c where i < 6 and j < 4)
    select p_partkey, round(i * 10 + 0.5 * j + (10 + 0) * u + 0.5 * v, 6) as new_x, round(900 + j * 500 + i + 1 * u + 500 * v, 6) as new_y from q""",
)
def blt_forward(spark, sf_dir):
    """Cells of 10 by 500, whose corner (i, j) moves by (j / 2, i)."""
    move = lambda i, j: (i * 10 + 0.5 * j, 900 + j * 500 + i)
    rows = [(j * 6 + i, i * 10.0, 900.0 + j * 500, 10.0, 500.0, *(float(v) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)) for v in move(i + a, j + b))) for j in range(4) for i in range(6)]
    corners = spark.createDataFrame(rows, "cell long, x0 double, y0 double, l double, w double, x00 double, y00 double, x10 double, y10 double, x01 double, y01 double, x11 double, y11 double")
    own = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    out = bilinear.forward(own, "x", "y", (0.0, 900.0), (10.0, 500.0), 6, bilinear.coefficients(corners))
    return rounded(out.where("new_x is not null").select("p_partkey", "new_x", "new_y"), "new_x", "new_y")


@query(
    "ks_statistic",
    """with s as (select l_extendedprice as v, l_orderkey % 2 as s from lineitem), n as (select count(*) filter (where s = 0) as na, count(*) filter (where s = 1) as nb from s),
    c as (select v, count(*) filter (where s = 0) as a, count(*) filter (where s = 1) as b from s group by v), w as (select sum(a) over (order by v) as ca, sum(b) over (order by v) as cb from c)
    select round(max(abs(ca::double / na - cb::double / nb)), 6) as statistic, any_value(na) as n1, any_value(nb) as n2 from w, n""",
)
def ks_statistic(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 2).alias("s"), "l_extendedprice")
    return rounded(impute.ks(own, "s", "l_extendedprice"), "statistic")


@query(
    "pmm_impute",
    """with near as (select a.p_partkey, b.p_size as y, abs(b.p_retailprice - a.p_retailprice) as d, row_number() over (partition by a.p_partkey order by abs(b.p_retailprice - a.p_retailprice), b.p_partkey) as r from part a, part b where a.p_partkey % 11 = 0 and b.p_partkey % 11 <> 0)
    select p_partkey, round(sum(y / greatest(d, 1e-12)) / sum(1 / greatest(d, 1e-12)), 6) as value from near where r <= 3 group by 1""",
)
def pmm_impute(spark, sf_dir):
    own = table(spark, sf_dir, "part").withColumn("p_size", F.when(F.col("p_partkey") % 11 != 0, F.col("p_size")))
    return rounded(impute.nearest_mean(own, "p_partkey", "p_size", "p_retailprice", 3), "value")


@query("mice_norm")
def mice_norm(spark, sf_dir):
    own = prepare.zeros_missing(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE), ["l_tax", "l_discount"])
    return impute.mice(own, LINE, "norm", sweeps=3)


@query("dbscan")
def dbscan(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), ["s_acctbal", "s_nationkey"])
    return cluster.dbscan(own, "s_suppkey", ["s_acctbal", "s_nationkey"], 0.4, 4)


@query("kmeans")
def kmeans(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "part").select("p_partkey", *PART), PART)
    return cluster.kmeans(own, PART, 4).select("p_partkey", "cluster")


@query("pca")
def pca(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE), LINE)
    return cluster.principal_components(own, LINE, 2).select("l_orderkey", "l_linenumber", "pc1", "pc2")


@query("factor_rotation")
def factor_rotation(spark, sf_dir):
    """Varimax of the correlations' two leading factors."""
    own = table(spark, sf_dir, "lineitem")
    r = np.eye(len(LINE))
    for row in prepare.correlations(own, LINE).collect():  # one row a pair of columns
        i, j = LINE.index(row["a"]), LINE.index(row["b"])
        r[i, j] = r[j, i] = row["r"]
    values, vectors = np.linalg.eigh(r)
    pattern = factors.varimax(vectors[:, -2:] * np.sqrt(np.maximum(values[-2:], 0)))
    return spark.createDataFrame([(c, float(a), float(b)) for c, (a, b) in zip(LINE, pattern, strict=True)], "feature string, f1 double, f2 double")


@query("weighted_bootstrap")
def weighted_bootstrap(spark, sf_dir):
    return draws.with_replacement(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 100, "o_totalprice", bags=2)


@query("missing_cells", "select l_orderkey, unnest(list_filter([case when l_discount = 0 then 'l_discount' end, case when l_tax = 0 then 'l_tax' end], lambda x: x is not null)) as feature from lineitem")
def missing_cells(spark, sf_dir):
    own = prepare.zeros_missing(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"])
    return prepare.missing_cells(own, "l_orderkey", ["l_discount", "l_tax"])


@query("ranked_scores", "with v as (select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature, unnest([var_samp(l_quantity), var_samp(l_extendedprice), var_samp(l_discount), var_samp(l_tax)]) as variance from lineitem) select feature, (row_number() over (order by variance desc, feature) - 1)::int as rank from v")
def ranked_scores(spark, sf_dir):
    own = prepare.feature_importance(table(spark, sf_dir, "lineitem"), LINE)
    return own.select("feature", (F.row_number().over(Window.orderBy(F.desc("variance"), "feature")) - 1).alias("rank"))
