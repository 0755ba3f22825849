"""Queries on walks, ranks, caches, upserts and small parsed texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import allpairs, history, walks
from ..sources.tables import scratch, table
from .catalogue import _TRANS, _transitions, query
from .parsed import golden, keyed

#: Each supplier leads to two others by its key and nation.
_SPARSE = "z as (select count(*) as z from supplier), e as (select distinct s_suppkey as src, (s_suppkey * 3 + s_nationkey) % z as dst from supplier, z union select s_suppkey, (s_suppkey + 7 + s_nationkey % 3) % z from supplier, z)"
_WAYS = f"""with recursive {_SPARSE}, w as (select distinct src as source, src as node, 0 as distance from e union select source, e.dst, distance + 1 from w join e on w.node = e.src where distance < 25),
m as (select source, node, min(distance) as distance from w group by 1, 2),
p as (select distinct src as source, src as node, 0 as distance, 0 as k from e union all select p.source, e.dst, p.distance + 1, 0 from p join e on p.node = e.src join m on m.source = p.source and m.node = e.dst and m.distance = p.distance + 1),
f as (select source, node, distance, count(*) as ways from p group by all)"""


def _sparse(spark, d):
    s = table(spark, d, "supplier")
    n = s.count()
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return s.select(key.alias("src"), F.explode(F.array((key * 3 + nation) % n, (key + 7 + nation % 3) % n)).alias("dst")).select("src", F.col("dst").cast("long").alias("dst"))


def _sources(edges):
    return edges.select(F.col("src").alias("node")).distinct()


@query(f"{_WAYS} select source, node, distance, ways from f")
def graph_distances(spark, d):
    e = _sparse(spark, d)
    return allpairs.distances(e, _sources(e))


@query(f"{_WAYS}, n as (select count(distinct x) as n from (select unnest([src, dst]) as x from e)) select source, count(*) - 1 as reached, max(distance) as eccentricity, round(coalesce((count(*) - 1) / nullif(sum(distance), 0), 0), 4) as closeness, round(case when count(*) = n then 1 / (1 + max(distance)) else 0 end, 4) as centre from f, n group by source, n")
def graph_closeness(spark, d):
    """Closeness, and 1 / (1 + eccentricity) where all nodes are reached."""
    e = _sparse(spark, d)
    n = e.select(F.explode(F.array("src", "dst")).alias("x")).agg(F.countDistinct("x").alias("n"))
    out = allpairs.closeness(e, _sources(e)).crossJoin(F.broadcast(n))  # one row
    return out.withColumn("centre", F.round(F.when(F.col("reached") + 1 == F.col("n"), F.lit(1.0) / (F.col("eccentricity") + 1)).otherwise(0.0), 4)).drop("n")


@query(f"""{_WAYS} select * from (select a.node, round(sum(a.ways * b.ways / c.ways) + 1e-7, 4) as score from f a join f b on a.node = b.source join f c on c.source = a.source and c.node = b.node and c.distance = a.distance + b.distance
where a.distance > 0 and b.distance > 0 group by 1) where score > 0""")
def graph_betweenness(spark, d):
    e = _sparse(spark, d)
    return allpairs.betweenness(e, _sources(e))


@query(f"with {_SPARSE}, n as (select count(distinct x) as nodes from (select unnest([src, dst]) as x from e)) select nodes, count(*) as edges, round(count(*) / (nodes * (nodes - 1)), 4) as density, round(count(*) / nodes, 4) as degree from e, n group by nodes")
def graph_statistics(spark, d):
    return walks.statistics(_sparse(spark, d))


@query(f"with recursive {_TRANS}, p as (select [src, dst] as path, dst as at from t where src <> dst union all select list_append(path, dst), dst from p join t on p.at = t.src where not list_contains(path, dst) and len(path) < 4) select array_to_string(path, '>') as path from p")
def graph_simple_paths(spark, d):
    return walks.simple_paths(_transitions(spark, d), 3).select(F.array_join("path", ">").alias("path"))


@query("select user_id, event_type, rank::int as rank from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as rank from events group by 1, 2) where rank between 2 and 4")
def alternative_ranks(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type")
    per = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("rank", F.row_number().over(w)).where("rank between 2 and 4").drop("n")


@query("select p_brand, arg_min(p_partkey, (-p_retailprice, p_partkey)) as best, max(p_retailprice) as price from part group by 1")
def best_per_group(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), "p_partkey")).alias("best"), F.max("p_retailprice").alias("price"))


@query("select user_id, case when max(ts) < (select max(ts) from events) - interval 168 hours then 'expired' when max(value) > 95 then 'changed' else 'hit' end as state from events group by 1")
def cache_read(spark, d):
    e = table(spark, d, "events")
    last = e.agg(F.max("ts").alias("anchor"))  # one row
    per = e.groupBy("user_id").agg(F.max("ts").alias("t"), F.max("value").alias("v")).crossJoin(F.broadcast(last))
    return per.select("user_id", F.when(F.col("t") < F.col("anchor") - F.expr("interval 168 hours"), "expired").when(F.col("v") > 95, "changed").otherwise("hit").alias("state"))


@query("""with n as (select doc_id, quality + 10 as q from labels), o as (select doc_id, 0 as q from documents)
select coalesce(n.doc_id, o.doc_id) as doc_id, coalesce(n.q, o.q)::int as q from o full join n on o.doc_id = n.doc_id""")
def state_upsert(spark, d):
    """New values over old ones by key: one full outer join."""
    new = table(spark, d, "labels").select("doc_id", (F.col("quality") + 10).alias("n"))
    old = table(spark, d, "documents").select("doc_id", F.lit(0).alias("o"))
    return old.join(new, "doc_id", "full_outer").select("doc_id", F.coalesce("n", "o").alias("q"))


@query("select o_custkey, sum(case when o_orderstatus = 'F' then 1 else 0 end)::bigint as done, count(*) as n, case when bool_and(o_orderstatus = 'F') then 'passed' when bool_or(o_orderstatus = 'F') then 'partial' else 'failed' end as state from orders group by 1")
def validation_status(spark, d):
    ok = F.col("o_orderstatus") == "F"
    state = F.when(F.bool_and(ok), "passed").when(F.bool_or(ok), "partial").otherwise("failed")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count_if(ok).alias("done"), F.count(F.lit(1)).alias("n"), state.alias("state"))


@query("select l_orderkey, unnest(list_filter([case when count(*) > 3 then 'files' end, case when sum(l_quantity) > 320 then 'lines' when sum(l_quantity) > 160 then 'many lines' end], lambda x: x is not null)) as violation from lineitem group by 1")
def policy_gate(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    rules = F.array(F.when(F.col("n") > 3, "files"), F.when(F.col("q") > 320, "lines").when(F.col("q") > 160, "many lines"))
    return g.select("l_orderkey", F.explode(F.filter(rules, lambda x: x.isNotNull())).alias("violation"))


_PERIOD = "p_size || [' days', ' weeks ago', ' month', ' soon'][p_partkey % 4 + 1]"


@query(f"select p_partkey, {_PERIOD} as text, (p_size * [1, 7, 30, 0][p_partkey % 4 + 1] + [0, 0, 0, 90 - p_size * 0][p_partkey % 4 + 1])::int as days from part")
def period_days(spark, d):
    """Periods in words as days; 90 for what is none."""
    unit = F.element_at(F.array(*map(F.lit, (" days", " weeks ago", " month", " soon"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), unit).alias("text")).withColumn("days", history.period(F.col("text")))


@query(golden("side, line, n", ("added", "x§ = 2", 2), ("removed", "x§ = 1", 1)))
def diff_lines(spark, d):
    """Added and removed lines of diffs without headers and comments."""
    rows = keyed(spark, d, [("--- a/f.py\n+++ b/f.py\n-x§ = 1\n+x§ = 2\n+# note\n y\n",), ("+++ b/g.py\n+x§ = 2\n",), (None,)], "text string")
    line = rows.select(F.explode(F.split("text", "\n")).alias("l")).where(F.col("l").rlike(r"^(\+(?!\+\+)|-(?!--))[ \t]*[^# \t]"))
    return line.groupBy(F.when(F.col("l").startswith("+"), "added").otherwise("removed").alias("side"), F.trim(F.expr("substring(l, 2)")).alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query(golden("name, day, kind, project", ("web§_scan_20240305_101500.json", "2024-03-05", "scan", "web§"), ("my_app_fix_20240306_000000.json", "2024-03-06", "fix", "my_app"), ("other.json", None, None, None)))
def report_names(spark, d):
    p = r"^(.+)_(scan|fix)_(\d{8})_(\d{6})"
    rows = keyed(spark, d, [("web§_scan_20240305_101500.json",), ("my_app_fix_20240306_000000.json",), ("other.json",)], "name string")
    part = lambda i: F.when(F.col("name").rlike(p), F.regexp_extract("name", p, i))
    return rows.select("name", F.date_format(F.try_to_timestamp(part(3), F.lit("yyyyMMdd")), "yyyy-MM-dd").alias("day"), part(2).alias("kind"), part(1).alias("project"))
