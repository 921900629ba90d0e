"""Queries for the relational building blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzite.functions.columns import micros
from quartzite.operators import prepare
from quartzite.operators import relational as rel
from quartzite.plans.registry import LINE, PART, query, rounded, table
from quartzite.sources import prv


@query("distinct_count", " union all ".join(f"select '{c}' as feature, count(distinct {c}) as n_distinct from lineitem" for c in [*LINE, "l_returnflag"]))
def distinct_count(spark, sf_dir):
    return rel.distinct_counts(table(spark, sf_dir, "lineitem"), [*LINE, "l_returnflag"])


@query("distinct_object_ids", "select distinct '1.1.' || (user_id + 1) || '.1' as object_id from events")
def distinct_object_ids(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.lit(1).alias("cpu"), F.lit(1).alias("appl"), (F.col("user_id") + 1).alias("task"), F.lit(1).alias("thread"))
    return rel.distinct_ids(own, ["cpu", "appl", "task", "thread"])


@query(
    "mean_row",
    "with t as (select l_returnflag, avg(l_tax) as l_tax, avg(l_discount) as l_discount from lineitem group by 1) select l_returnflag, round(l_tax, 6) as l_tax, round(l_discount, 6) as l_discount from t union all select 'mean', round(avg(l_tax), 6), round(avg(l_discount), 6) from t",
)
def mean_row(spark, sf_dir):
    own = prepare.centroids(table(spark, sf_dir, "lineitem"), "l_returnflag", ["l_tax", "l_discount"])
    return rounded(rel.with_mean_row(own, "l_returnflag", ["l_tax", "l_discount"]), "l_tax", "l_discount")


_BAGS = " union all ".join(f"select '{c}' as feature, l_orderkey % 5 as bag, var_samp({c}) as score from lineitem group by 2" for c in LINE)


@query("mean_scores", f"with s as ({_BAGS}) select feature, round(avg(score), 4) as score from s group by 1")
def mean_scores(spark, sf_dir):
    """Scores of five bags, averaged."""
    bag = table(spark, sf_dir, "lineitem").groupBy((F.col("l_orderkey") % 5).alias("bag")).agg(*(F.var_samp(c).alias(c) for c in LINE))
    return rounded(rel.mean_scores(bag.unpivot("bag", LINE, "feature", "score"), "feature", "score"), "score", digits=4)


@query("arg_min_group", "select o_orderpriority, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as o_orderkey, min(o_totalprice) as o_totalprice from orders group by 1")
def arg_min_group(spark, sf_dir):
    return rel.arg_least(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", ["o_orderpriority"])


@query("arg_max", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 1")
def arg_max(spark, sf_dir):
    return rel.arg_least(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", most=True)


@query("sort_multi", "select o_orderkey, o_custkey, (row_number() over (order by o_custkey, o_totalprice desc, o_orderkey) - 1)::bigint as place from orders")
def sort_multi(spark, sf_dir):
    return rel.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_custkey", F.desc("o_totalprice"), "o_orderkey"], "place").drop("o_totalprice")


@query("argsort", "select l_orderkey, l_linenumber, list_transform(list_sort([(l_tax * 10, 1), (l_discount * 10, 2), (l_quantity, 3)]), lambda x: x[2] - 1)[1] as first, list_transform(list_sort([(l_tax * 10, 1), (l_discount * 10, 2), (l_quantity, 3)]), lambda x: x[2] - 1)[3] as last from lineitem")
def argsort(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("o", rel.ordering(F.array(F.col("l_tax") * 10, F.col("l_discount") * 10, F.col("l_quantity"))))
    return own.select("l_orderkey", "l_linenumber", F.col("o")[0].alias("first"), F.col("o")[2].alias("last"))


@query("pair_sort", "with p as (select o_custkey, list(o_orderkey order by o_totalprice desc, o_orderkey) as x from orders group by 1) select o_custkey, array_to_string(x, ',') as sorted from p")
def pair_sort(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("p"))
    return per.select("o_custkey", F.array_join(rel.pair_sort(F.col("p.o_orderkey"), F.col("p.o_totalprice"), descending=True), ",").alias("sorted"))


@query("first_lines", "select event_id, user_id from events order by event_id limit 100")
def first_lines(spark, sf_dir):
    return rel.first_lines(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, "event_id")


@query("iteration_diff", "select o_orderkey, round(o_totalprice - lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey), 4) as difference from orders")
def iteration_diff(spark, sf_dir):
    return rounded(rel.differences(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], ["o_custkey"]).select("o_orderkey", "difference"), "difference", digits=4)


_PATH = "with p as (select o_custkey, list(o_totalprice order by o_orderkey) as p from orders group by 1), "


@query(
    "path_diff",
    _PATH + "d as (select o_custkey, list_transform(range(2, len(p) + 1), lambda i: p[i] - p[i - 1]) as d, list_transform(range(2, len(p) + 1), lambda i: abs((p[i] - p[i - 1]) / p[i - 1])) as r from p) select o_custkey, round(coalesce(list_sum(d), 0), 2) as total, round(coalesce(list_sum(list_transform(d, lambda x: abs(x))), 0), 2) as way, round(coalesce(list_sum(r), 0), 4) as relative from d",
)
def path_diff(spark, sf_dir):
    per = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_totalprice"))).alias("p"))
    total = lambda how: F.aggregate(rel.path_differences(F.col("p.o_totalprice"), how), F.lit(0.0), lambda a, x: a + x)
    return per.select("o_custkey", F.round(total("diff"), 2).alias("total"), F.round(total("diff_abc"), 2).alias("way"), F.round(total("diff_pro_abs"), 4).alias("relative"))


_KEYS = "a as (select distinct l_partkey as k from lineitem where l_returnflag = 'R'), b as (select distinct l_partkey as k from lineitem where l_returnflag = 'A' and l_quantity > 25)"


@query("set_edge_keys", f"with {_KEYS} select 'both' as part, k from a where k in (select k from b) union all select 'first', k from a where k not in (select k from b) union all select 'second', k from b where k not in (select k from a)")
def set_edge_keys(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    a, b = own.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), own.where("l_returnflag = 'A' and l_quantity > 25").select(F.col("l_partkey").alias("k"))
    both, first, second = rel.edge_keys(a, b)
    named = lambda df, name: df.select(F.lit(name).alias("part"), "k")
    return named(both, "both").unionByName(named(first, "first")).unionByName(named(second, "second"))


@query("symmetric_difference", f"with {_KEYS} (select k from a except select k from b) union all (select k from b except select k from a)")
def symmetric_difference(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem")
    return rel.symmetric_difference(own.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), own.where("l_returnflag = 'A' and l_quantity > 25").select(F.col("l_partkey").alias("k")))


@query("interior_nodes", "select i * 40 + j as neuron from range(1, 39) a(i), range(1, 39) b(j)")
def interior_nodes(spark, sf_dir):
    """The nodes of a 40 by 40 lattice less those on its edge."""
    every = spark.range(1600).select(F.col("id").alias("neuron"))
    i, j = F.floor(F.col("neuron") / 40), F.col("neuron") % 40
    return rel.without(every, every.where((i == 0) | (i == 39) | (j == 0) | (j == 39)).select(F.col("neuron").alias("edge")), "neuron", "edge")


@query("distinct_rows", "with d as (select distinct l_returnflag, l_linestatus, l_tax from lineitem) select *, row_number() over (order by l_returnflag, l_linestatus, l_tax) as number from d")
def distinct_rows(spark, sf_dir):
    return rel.distinct_rows(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_tax"])


@query("map_values", "select c_custkey, case c_mktsegment when 'BUILDING' then 'B' when 'MACHINERY' then 'M' else c_mktsegment end as segment from customer")
def map_values(spark, sf_dir):
    return rel.mapped(table(spark, sf_dir, "customer"), "c_mktsegment", {"BUILDING": "B", "MACHINERY": "M"}, "segment").select("c_custkey", "segment")


@query("dict_inner_join", "select s_suppkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def dict_inner_join(spark, sf_dir):
    """Two steps through two dictionaries."""
    step = rel.joined_through(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"), "s_suppkey", "s_nationkey", "n_nationkey", "n_regionkey")
    return rel.joined_through(step, table(spark, sf_dir, "region"), "s_suppkey", "n_regionkey", "r_regionkey", "r_name")


@query("label_isin", "select p_partkey from part where p_size in (6, 7, 8, 9)")
def label_isin(spark, sf_dir):
    """The list's strings are compared as the column's numbers."""
    return rel.isin(table(spark, sf_dir, "part"), "p_size", ["6", "7", "8", "9"]).select("p_partkey")


@query("ratio", "select l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 8) as l_extendedprice, round(l_quantity / nullif(l_tax, 0), 8) as l_tax from lineitem")
def ratio(spark, sf_dir):
    own = rel.ratios(rel.ratios(table(spark, sf_dir, "lineitem"), ["l_extendedprice"], "l_quantity"), ["l_tax"], "l_quantity", invert=True)
    return rounded(own.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_tax"), "l_extendedprice", "l_tax", digits=8)


@query("strip_lower_split", "select p_partkey, split_part(lower(trim(p_type)), ' ', 1) as word, p_name from part")
def strip_lower_split(spark, sf_dir):
    own = rel.trimmed_names(table(spark, sf_dir, "part").withColumnRenamed("p_name", " p_name "))
    return own.select("p_partkey", rel.first_word(F.col("p_type")).alias("word"), "p_name")


@query("strip_returns", "select event_id, event_type || '|' as value from events")
def strip_returns(spark, sf_dir):
    own = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("\r|\r")).alias("value"))
    return rel.without_returns(own)


@query("factorize", "with f as (select event_type, min(event_id) as m from events group by 1), c as (select event_type, row_number() over (order by m) - 1 as code from f) select event_id, code from events join c using (event_type)")
def factorize(spark, sf_dir):
    return rel.factorised(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_id", "code")


@query("drop_null_rows", "select l_orderkey, l_linenumber from lineitem where l_tax <> 0 and l_discount <> 0")
def drop_null_rows(spark, sf_dir):
    return rel.drop_null_rows(prepare.zeros_missing(table(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"]), ["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber")


@query("drop_empty_columns", "select o_orderkey, o_custkey from orders")
def drop_empty_columns(spark, sf_dir):
    return prepare.drop_empty_columns(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.lit(None).cast("double").alias("void")))


@query("drop_zero_rows", "select l_orderkey, l_linenumber from lineitem where not (l_tax = 0 and l_discount = 0)")
def drop_zero_rows(spark, sf_dir):
    return prepare.drop_zero_rows(table(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber")


@query("finite_rows", "select l_orderkey, l_linenumber, round(l_quantity / l_tax, 6) as ratio from lineitem where l_tax <> 0")
def finite_rows(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").withColumn("ratio", F.when(F.col("l_tax") == 0, F.lit(float("inf"))).otherwise(F.col("l_quantity") / F.nullif(F.col("l_tax"), F.lit(0.0))))
    return rounded(rel.finite_rows(own, ["ratio"]).select("l_orderkey", "l_linenumber", "ratio"), "ratio")


@query("within_box", "select p_partkey from part where p_size between 10 and 20 and p_retailprice between 1000 and 1500")
def within_box(spark, sf_dir):
    return rel.within_box(table(spark, sf_dir, "part"), {"p_size": (10, 20), "p_retailprice": (1000, 1500)}).select("p_partkey")


@query("select_features", "select l_tax, l_quantity from lineitem")
def select_features(spark, sf_dir):
    return rel.selected(table(spark, sf_dir, "lineitem"), ["l_tax", table(spark, sf_dir, "lineitem").columns.index("l_quantity")])


@query("feature_mask", "select unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as feature, unnest([0, 1, 0, 1]) as chosen")
def feature_mask(spark, sf_dir):
    return spark.createDataFrame(list(zip(LINE, rel.mask(LINE, ["l_tax", "l_extendedprice"], binary=True), strict=True)), "feature string, chosen int")


@query("ln_exp", "select p_partkey, round(ln(p_retailprice), 6) as logarithm, round(exp(ln(p_retailprice)), 4) as back from part")
def ln_exp(spark, sf_dir):
    own = prepare.log_in(table(spark, sf_dir, "part").withColumn("back", F.col("p_retailprice")), ["p_retailprice", "back"])
    return prepare.exp_out(own, ["back"]).select("p_partkey", F.round("p_retailprice", 6).alias("logarithm"), F.round("back", 4).alias("back"))


@query("scalar_arithmetic", "select p_partkey, round(sqrt(p_retailprice), 6) as root, round(power(p_size, 2), 3) as square, round_even(p_retailprice / 8, 1) as even from part")
def scalar_arithmetic(spark, sf_dir):
    own = prepare.derive(table(spark, sf_dir, "part"), {"root": "sqrt(p_retailprice)", "square": "power(p_size, 2)"})
    return own.select("p_partkey", F.round("root", 6).alias("root"), F.round("square", 3).alias("square"), F.bround(F.col("p_retailprice") / 8, 1).alias("even"))


@query("reset_types", "select p_partkey, round_even(p_size * 1.5, 0)::int as p_size from part")
def reset_types(spark, sf_dir):
    """Numbers that a model made fractional become whole again, halves to the even one."""
    own = table(spark, sf_dir, "part")
    return prepare.reset_types(own.withColumn("p_size", F.col("p_size") * 1.5), own.schema).select("p_partkey", "p_size")


@query("numeric_columns", "select unnest(['p_partkey', 'p_size', 'p_retailprice', 'p_name', 'p_brand', 'p_type']) as feature, unnest(['number', 'number', 'number', 'text', 'text', 'text']) as kind")
def numeric_columns(spark, sf_dir):
    own = prepare.as_categories(table(spark, sf_dir, "part"), [])
    numbers, texts = prepare.split_columns(own)
    return spark.createDataFrame([(c, "number") for c in numbers] + [(c, "text") for c in texts], "feature string, kind string")


@query("normalise_rows", "select p_partkey, " + ", ".join(f"round({c} / sqrt(p_size * p_size + p_retailprice * p_retailprice), 6) as {c}" for c in PART) + " from part")
def normalise_rows(spark, sf_dir):
    return rounded(prepare.normalise_rows(table(spark, sf_dir, "part"), PART, "l2").select("p_partkey", *PART), *PART)


@query("relabel_by_duration", "with t as (select o_orderpriority, round(sum(o_totalprice), 2) as total from orders group by 1), r as (select o_orderpriority, (row_number() over (order by total desc, o_orderpriority) - 1) as rank from t) select o_orderkey, rank as o_orderpriority from orders join r using (o_orderpriority)")
def relabel_by_duration(spark, sf_dir):
    own = prepare.relabel_by_duration(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")
    return own.select("o_orderkey", "o_orderpriority")


@query("pattern_rows", "with p as (select (l_tax = 0)::int::varchar || (l_discount = 0)::int::varchar as pattern, l_orderkey * 10 + l_linenumber as k from lineitem) select pattern, count(*) as n_rows, min(k) as first_row, sum(k)::bigint as total from p group by 1")
def pattern_rows(spark, sf_dir):
    """Which rows have each pattern of missing cells."""
    own = prepare.zeros_missing(table(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"]).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return prepare.pattern_rows(own, "k", ["l_tax", "l_discount"]).groupBy("pattern").agg(F.count(F.lit(1)).alias("n_rows"), F.min("k").alias("first_row"), F.sum("k").alias("total"))


@query("null_flags", "select l_orderkey, l_linenumber, (l_tax = 0)::int as l_tax, (l_discount = 0)::int as l_discount from lineitem")
def null_flags(spark, sf_dir):
    own = prepare.zeros_missing(table(spark, sf_dir, "lineitem"), ["l_tax", "l_discount"])
    return prepare.null_flags(own, ["l_tax", "l_discount"]).select("l_orderkey", "l_linenumber", "l_tax", "l_discount")


@query("edit_list", """select '1.1.' || (user_id + 1) || '.1' as object_id, epoch_us(ts) as ts, '42000059' as code, '5' as new_value, 'u' as tag from events where event_id % 50 = 0""")
def edit_list(spark, sf_dir):
    """Imputed cells as edits of a trace: which counter of which event, its new value, and whether it is new to the line."""
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("1.1."), (F.col("user_id") + 1).cast("string"), F.lit(".1")).alias("object_id"), micros("ts").alias("ts"), F.when(F.col("event_id") % 50 != 0, F.lit(7.0)).alias("cyc"))
    return prv.edit_list(own, own.fillna(5.0, ["cyc"]).withColumnRenamed("cyc", "filled"), {"cyc": "filled"}, {"cyc": "42000059"}, ["object_id", "ts"], whole=["cyc"])


@query("edit_and_apply", "select count(*) as n from events where event_id % 50 = 0")
def edit_and_apply(spark, sf_dir):
    """The edit list's edits reach the trace."""
    own = table(spark, sf_dir, "events").select("event_id", F.lit(1).alias("cpu"), F.lit(1).alias("appl"), (F.col("user_id") + 1).alias("task"), F.lit(1).alias("thread"), micros("ts").alias("t"), F.lit(3).alias("cyc"))
    lines = prv.render_events(own, ["cpu", "appl", "task", "thread"], "t", {"42000059": "cyc", "70000001": "event_id"}).withColumn("line_no", F.element_at(F.split("value", ":"), -1).cast("long"))
    edited = prv.edit(lines, edit_list(spark, sf_dir))
    return edited.where(F.col("value").contains(":42000059:5:")).agg(F.count(F.lit(1)).alias("n"))
