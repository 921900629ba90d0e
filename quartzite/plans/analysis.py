"""Queries for files, settings, draws, agreement of labels, preparation, trace graphs, maps and feature selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quartzite.functions.columns import micros
from quartzite.operators import agreement as agree
from quartzite.operators import draws, graph, impute, lattice, models, outliers, prepare, selection, som, trace, validate
from quartzite.operators.pipeline import prepare_data
from quartzite.plans.registry import LINE, PART, query, rounded, table
from quartzite.sources import prv, tables
from quartzite.storage import fresh_path


@query("csv_load", "select c_custkey, c_acctbal, c_mktsegment from customer")
def csv_load(spark, sf_dir):
    """Written with blanks around the names, read without them and without a column."""
    path = fresh_path(spark, "customer.csv")
    tables.write_csv(table(spark, sf_dir, "customer").withColumnsRenamed({"c_custkey": " c_custkey", "c_name": "c_name "}), path)
    return tables.load(spark, path, "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", drop=["c_name", "c_nationkey", "absent"])


@query(
    "csv_load_labelled",
    "with t as (select p_retailprice as x, p_size from part where p_size in (6, 7, 8, 9)) select round((x - (select min(x) from t)) / (select max(x) - min(x) from t), 6) as p_retailprice, p_size from t",
)
def csv_load_labelled(spark, sf_dir):
    path = fresh_path(spark, "part.csv")
    tables.write_csv(table(spark, sf_dir, "part"), path)
    own = tables.load_labelled(spark, path, ["p_retailprice"], "p_size", ["6", "7", "8", "9"])
    return rounded(own, "p_retailprice").withColumn("p_size", F.col("p_size").cast("int"))


@query("settings", "select unnest(['hardware_counters', 'scale', 'threads']) as k, unnest(['ins,cyc', 'true', '4']) as v")
def settings(spark, sf_dir):
    """Settings written, read, laid over one another and turned into a trace's."""
    path = fresh_path(spark, "settings.json")
    spark.createDataFrame([('{"hardware_counters": {"42000050": "ins"}, "scale": false, "thread_numbers": 4}',)], "value string").coalesce(1).write.text(path)
    got = tables.merged(tables.settings(spark, path), {"hardware_counters": {"42000059": "cyc"}, "scale": True})
    own = tables.TraceSettings.of(got)
    return spark.createDataFrame([("hardware_counters", ",".join(own.counters.values())), ("scale", str(got["scale"]).lower()), ("threads", str(own.threads))], "k string, v string")


@query("prv_file", "select count(*) as n, sum(cyc)::bigint as cycles from (select trunc(value)::bigint as cyc, event_id % 7 as ins from events) where not (cyc = 0 and ins = 0)")
def prv_file(spark, sf_dir):
    """A trace written as text, read, parsed, written as CSV and read again."""
    own = table(spark, sf_dir, "events").select(F.lit(1).alias("cpu"), F.lit(1).alias("appl"), (F.col("user_id") + 1).alias("task"), F.lit(1).alias("thread"), micros("ts").alias("t"), F.col("value").cast("long").alias("cyc"), (F.col("event_id") % 7).alias("ins"))
    path, csv = fresh_path(spark, "trace.prv"), fresh_path(spark, "events.csv")
    prv.render_events(own, ["cpu", "appl", "task", "thread"], "t", {"42000059": "cyc", "42000050": "ins"}).write.text(path)
    tables.write_events(prv.events(prv.read(spark, path), {"42000059": "cyc", "42000050": "ins"}), csv, ["cyc", "ins"])
    return tables.load(spark, csv).agg(F.count(F.lit(1)).alias("n"), F.sum("cyc").cast("long").alias("cycles"))


@query("imputed_csv", "select p_partkey, p_name, round(case when p_partkey % 11 = 0 then (select avg(p_retailprice) from part where p_partkey % 11 <> 0) else p_retailprice end, 6) as p_retailprice, p_brand from part")
def imputed_csv(spark, sf_dir):
    """Filled columns beside those that pass through, in a CSV file with its list of edits."""
    own = table(spark, sf_dir, "part").select("p_partkey", "p_name", F.when(F.col("p_partkey") % 11 != 0, F.col("p_retailprice")).alias("p_retailprice"), "p_brand")
    parted, gaps = tables.imputation_parts(own, {"hardware_counters": {"1": "p_retailprice"}}, "p_partkey")
    done = prepare.fill(parted.work, gaps, "mean")
    edits = prv.edit_list(parted.work, done.withColumnRenamed("p_retailprice", "filled"), {"p_retailprice": "filled"}, {"p_retailprice": "1"}, ["p_partkey"])
    path, other = fresh_path(spark, "imputed.csv"), fresh_path(spark, "edits.csv")
    tables.write_imputed(parted, done, edits, path, other)
    return rounded(tables.load(spark, path, "p_partkey long, p_name string, p_retailprice double, p_brand string"), "p_retailprice")


@query("report", "select count(*)::bigint as n, round(avg(p_size), 6) as mean, 0.5 as accuracy from part")
def report(spark, sf_dir):
    path = fresh_path(spark, "report.json")
    tables.write_report(spark, tables.report(table(spark, sf_dir, "part"), PART, {"accuracy": 0.5}), path)
    got = tables.settings(spark, path)
    return spark.createDataFrame([(got["profile"]["p_size"]["n"], round(got["profile"]["p_size"]["mean"], 6), got["accuracy"])], "n long, mean double, accuracy double")


@query("made_blobs", "select unnest([0, 1, 2]) as label, unnest([334, 333, 333])::bigint as n")
def made_blobs(spark, sf_dir):
    return tables.make(spark, "blobs", 1000).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("draw_with_replacement", "select unnest([0, 1, 2]) as bag, 500::bigint as n, 0::bigint as light")
def draw_with_replacement(spark, sf_dir):
    """Rows of no weight are never drawn."""
    own = table(spark, sf_dir, "orders").withColumn("w", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(0.0))
    got = draws.with_replacement(own, 500, "w", bags=3)
    return got.groupBy("bag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("w") == 0).alias("light"))


@query("balanced_classes", "with t as (select c_mktsegment, count(*) as n from customer group by 1) select c_mktsegment, (select max(n) from t) as n from t")
def balanced_classes(spark, sf_dir):
    return draws.balanced(table(spark, sf_dir, "customer"), "c_mktsegment").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("contingency", "select l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by 1, 2")
def contingency(spark, sf_dir):
    return agree.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus")


@query(
    "label_agreement",
    """with c as (select c_mktsegment as a, c_nationkey % 5 as b, count(*)::double as n from customer group by 1, 2), r as (select a, sum(n) as n from c group by 1), k as (select b, sum(n) as n from c group by 1), t as (select sum(n) as n from c),
    i as (select sum(c.n / t.n * ln(t.n * c.n / (r.n * k.n))) as v from c join r using (a) join k using (b), t), h as (select -sum(r.n / t.n * ln(r.n / t.n)) as v from r, t), g as (select -sum(k.n / t.n * ln(k.n / t.n)) as v from k, t)
    select round(i.v / ((h.v + g.v) / 2), 8) as nmi, round(i.v / h.v, 8) as homogeneity, round(i.v / g.v, 8) as completeness, round(2 * i.v / (h.v + g.v), 8) as v_measure, round((select sum(n * (n - 1)) from c) / sqrt((select sum(n * (n - 1)) from r) * (select sum(n * (n - 1)) from k)), 8) as fowlkes_mallows from i, h, g""",
)
def label_agreement(spark, sf_dir):
    own = table(spark, sf_dir, "customer").withColumn("b", F.col("c_nationkey") % 5)
    got = {k: round(v, 8) for k, v in agree.agreement(own, "c_mktsegment", "b").items() if k != "ami"}
    return spark.createDataFrame([tuple(got.values())], ", ".join(f"{k} double" for k in got))


@query(
    "prepare_data",
    """with t as (select p_partkey, p_retailprice / p_size as x, p_size::double as s, p_retailprice / p_size - p_size as gap from part where p_brand <> 'Brand#11' and p_size in (5, 6, 7, 8, 9) and p_retailprice > 905)
    select p_partkey, round((x - (select min(x) from t)) / (select max(x) - min(x) from t), 6) as p_retailprice, round((gap - (select min(gap) from t)) / (select max(gap) - min(gap) from t), 6) as gap from t""",
)
def prepared(spark, sf_dir):
    own = table(spark, sf_dir, "part").where("p_brand <> 'Brand#11'").withColumn("group", F.col("p_size"))
    got = prepare_data(own, ["p_retailprice"], "group", ["5", "6", "7", "8", "9"], {"fraction": 1.0}, ["p_retailprice > 905"], divisor="p_size", derived={"gap": "p_retailprice - p_size"}, normalise="minmax")
    return rounded(got.select("p_partkey", "p_retailprice", "gap"), "p_retailprice", "gap")


@query("outliers")
def outlying(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *LINE)
    return outliers.drop_outliers(own, LINE, 0.05).select("l_orderkey", "l_linenumber")


_STATES = "select '1.1.' || (user_id + 1) || '.1' as o, epoch_us(ts) as b, epoch_us(ts) + event_id % 100 as e, event_id % 5 as s from events"


@query(
    "status_edges",
    f"with t as ({_STATES}), m as (select o, min(b) as b, max(e) as e from t group by 1) select o || ':' || b as src, o || ':' || e as dst, e - b as weight, s::int as status from t union all select 'start:0', o || ':' || b, b, 98 from m union all select o || ':' || e, 'finish', 0, 99 from m",
)
def status_edges(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.concat(F.lit("1.1."), (F.col("user_id") + 1).cast("string"), F.lit(".1")).alias("object_id"), micros("ts").alias("begin_time"), (F.col("event_id") % 5).alias("state"), "event_id")
    return trace.status_edges(own.withColumn("end_time", F.col("begin_time") + F.col("event_id") % 100))


@query(
    "label_edges",
    "with t as (select user_id, epoch_us(ts) as t, event_type, lead(epoch_us(ts)) over w as n, row_number() over w as r from events window w as (partition by user_id order by ts, event_id)) select user_id || ':' || t as src, coalesce(user_id || ':' || n, 'finish') as dst, coalesce(n - t, 0) as weight, event_type as label from t union all select 'start:0', user_id || ':' || t, t, null from t where r = 1",
)
def label_edges(spark, sf_dir):
    return trace.label_edges(table(spark, sf_dir, "events").withColumn("t", micros("ts")), "user_id", "t", "event_type", ["ts", "event_id"])


@query("joined_edges", "select 'even' as kind, (event_id % 2 = 0)::varchar as n, count(*) as edges from events where event_id % 2 = 0 group by 2 union all select 'odd', (event_id % 2 = 0)::varchar, count(*) from events where event_id % 2 = 1 group by 2")
def joined_edges(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("event_id").alias("src"), (F.col("event_id") + 1).alias("dst"), F.lit(1).alias("weight"))
    both = trace.joined_edges(even=own.where("src % 2 = 0"), odd=own.where("src % 2 = 1"))
    return both.groupBy("kind", (F.col("src").cast("long") % 2 == 0).cast("string").alias("n")).agg(F.count(F.lit(1)).alias("edges"))


_EDGES = "e as (select o_custkey as src, o_orderkey % 1000 as dst, min(o_totalprice) as distance from orders group by 1, 2)"


@query("graph_undirected", f"with {_EDGES} select least(src, dst) as a, greatest(src, dst) as b, round(arg_max(distance, src), 4) as distance from e group by 1, 2")
def graph_undirected(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst")).agg(F.min("o_totalprice").alias("distance"))
    return rounded(graph.undirected(own), "distance", digits=4)


@query("graph_update", f"with {_EDGES} select src, dst, round(least(distance, case when dst % 3 = 0 then 50000.0 end), 4) as distance from e")
def graph_update(spark, sf_dir):
    own = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 1000).alias("dst")).agg(F.min("o_totalprice").alias("distance"))
    return rounded(graph.update(own, own.where("dst % 3 = 0").withColumn("distance", F.lit(50000.0))), "distance", digits=4)


@query("lattice_cells", "select i * 5 + j as cell, 0.25 as area from range(0, 3) a(i), range(0, 5) b(j)")
def lattice_cells(spark, sf_dir):
    """Cells of a regular lattice have one area."""
    own = som.Lattice(4, 6)
    book = som.regular_grid(own, (0.0, 0.0), (1.5, 2.5), (0.0, 0.0), margin=0.0)
    return spark.createDataFrame([(k, round(float(a), 9)) for k, a in enumerate(lattice.cell_areas(book, own))], "cell long, area double")


@query("map_goodness")
def map_goodness(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "part").select(*PART), PART)
    shape = som.Lattice(6, 6)
    book, _ = som.train_batch(own, PART, shape, som.initial(own, PART, shape, "rrg"), epochs=3)
    got = validate.goodness_of_fit(own, PART, book, shape)
    return spark.createDataFrame([(k, float(v)) for k, v in got.items()], "measure string, value double")


@query("map_clusters")
def map_clusters(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "part").select("p_partkey", *PART), PART)
    shape = som.Lattice(6, 6)
    book, _ = som.train_batch(own, PART, shape, som.initial(own, PART, shape, "rrg"), epochs=3)
    labels = lattice.neuron_labels(lattice.heat(book, shape, bandwidth=1.0), merge_range=0.5)
    return lattice.neuron_clusters(som.best_units(own, PART, book), "bmu", labels).select("p_partkey", "bmu", "cluster")


@query("spectral_features")
def spectral_features(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(*LINE)
    parts = [selection.spectral_ranking(own, LINE, m, size=300).select(F.lit(m).alias("method"), "feature", "score") for m in ("mcfs", "spec_cut", "spec_normalised", "spec_clusters")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("representative_features")
def representative_features(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").select(*LINE)
    found = [("principal", f) for f in selection.principal_features(own, LINE, 2)] + [("independent", f) for f in selection.independent_features(own, LINE, 2)]
    return spark.createDataFrame(found, "method string, feature string")


@query("reachability_order")
def reachability_order(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"])
    return models.reachability(own, "s_suppkey", ["s_acctbal", "s_nationkey"], 5)


@query("embedding_isomap")
def embedding_isomap(spark, sf_dir):
    own = prepare.standardise(table(spark, sf_dir, "supplier"), ["s_acctbal", "s_nationkey"])
    return models.embedding(own, "s_suppkey", ["s_acctbal", "s_nationkey"], "isomap")


@query("mice_classes", "select p_partkey, (p_size > 25)::int::double as large from part")
def mice_classes(spark, sf_dir):
    """A class that its features tell exactly is filled as it was."""
    own = table(spark, sf_dir, "part").withColumn("far", F.when(F.col("p_size") > 25, 100.0).otherwise(0.0) + F.col("p_size") / 10)
    large = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") > 25).cast("double"))
    got = impute.mice(own.select("p_partkey", "far", large.alias("large")), ["far", "large"], "lda", sweeps=1)
    return got.select("p_partkey", "large")
