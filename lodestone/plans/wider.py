"""Further queries: paths, deltas, evidence, graphs, sinks, streams, syntax."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import delta, findings, graph, paths, syntax, votes
from ..sources import sinks
from ..sources.tables import scratch, table
from ..streaming import incremental, live
from .parsed import keyed
from .catalogue import _EDGES, _TRANS, _edges, _transitions, query

_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))


@query(f"select case regexp_extract(lower({_PATH}), '\\.[^./]+$') when '.html' then 'html' when '.php' then 'php' when '.js' then 'javascript' else 'unknown' end as language, count(*) as n from pages group by 1")
def language_detect(spark, d):
    return paths.with_language(_pages(spark, d), "path").groupBy("language").agg(F.count(F.lit(1)).alias("n"))


_SKIP = ["es", "node_modules", "build", "dist"]


@query(f"select page_id, {_PATH} as path from pages where list_has_any(string_split({_PATH}, '/'), {_SKIP}) or regexp_matches(lower({_PATH}), '\\.(html|md|txt)$')")
def path_exclusion(spark, d):
    return _pages(spark, d).where(paths.excluded(F.col("path"), _SKIP, [".html", ".md", ".txt"]))


@query(f"select page_id from pages where not ({_PATH} glob '/fr/*' or len(list_filter(string_split({_PATH}, '/'), lambda x: x glob '*.html' or x glob '7?')) > 0)")
def ignore_glob(spark, d):
    return _pages(spark, d).where(~paths.ignored(F.col("path"), ["/fr/*", "*.html", "7?"])).select("page_id")


@query("with l as (select page_id, unnest(string_split(html, chr(10))) as line from pages) select page_id, (length(regexp_extract(line, '^[ \\t]*')) // 4)::bigint as depth, count(*) as n from l group by 1, 2")
def nesting_lines(spark, d):
    lines = table(spark, d, "pages").select("page_id", F.explode(F.split("html", "\n")).alias("line"))
    return lines.select("page_id", paths.nesting(F.col("line")).alias("depth")).groupBy("page_id", "depth").agg(F.count(F.lit(1)).alias("n"))


@query("""with f as (select l_orderkey as o_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) as l_partkey from lineitem where l_returnflag = 'R' group by 1)
select o_orderkey, coalesce(l_partkey, -1) as fix, case when l_partkey is not null then 'fixed' else o_orderstatus end as status from orders left join f using (o_orderkey)""")
def bugs_fixes_join(spark, d):
    fixes = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    out = delta.last_wins(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), fixes, "o_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_partkey")
    return out.select("o_orderkey", F.coalesce("l_partkey", F.lit(-1)).alias("fix"), F.when(F.col("l_partkey").isNotNull(), "fixed").otherwise(F.col("o_orderstatus")).alias("status"))


@query("""with s as (select event_id, least(100.0, 40 * case event_type when 'error' then 1.0 when 'purchase' then 0.75 when 'click' then 0.5 else 0.25 end + 20 * least(1.0, value / 100) + case when user_id % 10 = 0 then 15 when user_id % 5 = 0 then 10 else 0 end) as score from events)
select event_id, round(score, 4) as score, case when score >= 60 then 'P1' when score >= 40 then 'P2' else 'P3' end as priority from s""")
def static_priority(spark, d):
    kind, user = F.col("event_type"), F.col("user_id")
    severity = F.when(kind == "error", 1.0).when(kind == "purchase", 0.75).when(kind == "click", 0.5).otherwise(0.25)
    bonus = F.when(user % 10 == 0, 15).when(user % 5 == 0, 10).otherwise(0)
    score = F.least(F.lit(100.0), severity * 40 + F.least(F.lit(1.0), F.col("value") / 100) * 20 + bonus)
    return table(spark, d, "events").withColumn("s", score).select("event_id", F.round("s", 4).alias("score"), findings.ladder(F.col("s"), [(60, "P1"), (40, "P2")], "P3").alias("priority"))


@query("""with m as (select user_id % 5 as model, avg((event_type <> 'error')::int) as success from events group by 1),
v as (select date_trunc('hour', ts) as context, event_type, round(least(1.0, value / 100) * (0.5 + 0.5 * success), 6) + 1e-7 as w from events join m on user_id % 5 = model),
p as (select context, event_type, count(*) as v, max(w) as w from v group by 1, 2), r as (select *, sum(v) over (partition by context) as n, row_number() over (partition by context order by w desc, v desc, event_type desc) as rn from p)
select context, event_type as winner, round(w, 4) as score, round(v / n, 4) as agreement from r where rn = 1""")
def vote_weighted(spark, d):
    e = table(spark, d, "events").withColumn("model", F.col("user_id") % 5)
    success = e.groupBy("model").agg(F.avg((F.col("event_type") != "error").cast("int")).alias("success"))
    w = F.round(F.least(F.lit(1.0), F.col("value") / 100) * (F.col("success") * 0.5 + 0.5), 6) + 1e-7
    return votes.weighted(e.join(success, "model").select(F.date_trunc("hour", "ts").alias("context"), "event_type", w.alias("w")), "context", "event_type", "w")


@query("select user_id, round(min(value), 4) as strength, arg_min(event_id, (value, event_id)) as weakest from events group by 1")
def chain_strength(spark, d):
    return votes.weakest_link(table(spark, d, "events"), "user_id", "event_id", "value").withColumn("strength", F.round("strength", 4))


@query("""with t as (select user_id, event_type, round(avg(value), 6) as mean, sum(value) as s, count(*) as n from events group by 1, 2)
select user_id, round(sum(s) / sum(n) + 1e-7, 4) as quality, arg_max(event_type, (mean, event_type)) as best_type from t group by 1""")
def evidence_profile(spark, d):
    t = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    return t.groupBy("user_id").agg(F.round(F.sum("s") / F.sum("n") + 1e-7, 4).alias("quality"), F.max_by("event_type", F.struct("mean", "event_type")).alias("best_type"))


@query("""with g as (select conv_id, count(*) as n, count(distinct role) as kinds, round(avg(length(text)), 4) as mean from conversations group by 1)
select *, case when (n not between 3 and 12)::int + (kinds < 2)::int + (mean < 80)::int = 0 then 'PASSED' when (n not between 3 and 12)::int + (kinds < 2)::int + (mean < 80)::int < 3 then 'RETRY' else 'REJECTED' end as decision from g""")
def evidence_gate(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("role").alias("kinds"), F.round(F.avg(F.length("text")), 4).alias("mean"))
    errors = (~F.col("n").between(3, 12)).cast("int") + (F.col("kinds") < 2).cast("int") + (F.col("mean") < 80).cast("int")
    return g.withColumn("decision", F.when(errors == 0, "PASSED").when(errors < 3, "RETRY").otherwise("REJECTED"))


_TAGS = {"api": ["token", "http"], "data": ["table", "data"], "licence": ["licen", "copyright"], "mail": ["@"]}
_TAG_SQL = ", ".join(f"case when {' or '.join(f'contains(lower(text), {w!r})' for w in words)} then '{tag}' end" for tag, words in _TAGS.items())


@query(f"""with t as (select *, trim(string_split(text, chr(10))[1], ' ') as line from documents)
select doc_id, case when length(line) > 80 then line[:77] || '...' else line end as title, array_to_string(list_filter([{_TAG_SQL}], lambda x: x is not null), ',') as tags from t""")
def title_component_tags(spark, d):
    line, low = F.trim(F.split("text", "\n")[0]), F.lower("text")
    title = F.when(F.length(line) > 80, F.concat(F.substring(line, 1, 77), F.lit("..."))).otherwise(line)
    tags = []
    for tag, words in _TAGS.items():
        test = F.lit(False)
        for w in words:
            test = test | low.contains(w)
        tags.append(F.when(test, tag))
    return table(spark, d, "documents").select("doc_id", title.alias("title"), F.array_join(F.array(*tags), ",").alias("tags"))


@query("""with o as (select doc_id, case when doc_id % 7 = 0 then 'old' else md5(text) end as h from documents union all select -1 - doc_id, 'gone' from labels where toxic = 1), n as (select doc_id, md5(text) as h from documents union all select 1000000000 + event_id, md5(props) from events)
select coalesce(o.doc_id, n.doc_id) as doc_id, case when o.doc_id is null then 'added' when n.doc_id is null then 'deleted' when o.h = n.h then 'unchanged' else 'modified' end as state from o full join n on o.doc_id = n.doc_id""")
def snapshot_delta(spark, d):
    """An old state (some texts changed, the toxic labels' rows gone) against the new
    one (the events' properties added)."""
    own = table(spark, d, "documents").select("doc_id", F.md5("text").alias("h"))
    gone = table(spark, d, "labels").where("toxic = 1").select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), F.lit("gone").alias("h"))
    old = own.withColumn("h", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h"))).unionByName(gone)
    new = own.unionByName(table(spark, d, "events").select((F.lit(1000000000) + F.col("event_id")).alias("doc_id"), F.md5("props").alias("h")))
    return delta.snapshot(old, new, "doc_id", "h")


@query("""with b as (select distinct unnest(regexp_extract_all(text, '[a-z]+')) as w from benchmark), t as (select distinct unnest(regexp_extract_all(text, '[a-z]+')) as w from documents)
select case when b.w is null then 'added' when t.w is null then 'removed' else 'kept' end as state, count(*) as n from b full join t on b.w = t.w group by 1""")
def symbol_set_diff(spark, d):
    words = [table(spark, d, t).select(F.explode(F.regexp_extract_all("text", F.lit("[a-z]+"), 0)).alias("w")) for t in ("benchmark", "documents")]
    return graph.diff(words[0], words[1], ["w"]).groupBy("state").agg(F.count(F.lit(1)).alias("n"))


_FILES = "f as (select -1 - s_suppkey as node, 'nation ' || s_nationkey as file from supplier union all select p_partkey, p_brand from part)"


def _files(spark, d):
    s = table(spark, d, "supplier").select((F.lit(-1) - F.col("s_suppkey")).alias("node"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("file"))
    return s.unionAll(table(spark, d, "part").select("p_partkey", "p_brand"))


@query(f"with {_EDGES}, {_FILES} select distinct a.file as src, b.file as dst from e join f a on a.node = e.src join f b on b.node = e.dst")
def file_dependencies(spark, d):
    return graph.group_dependencies(_edges(spark, d), _files(spark, d))


@query(f"with {_EDGES}, {_FILES}, g as (select distinct a.file as src, b.file as dst from e join f a on a.node = e.src join f b on b.node = e.dst) select src as file, 'imports' as side, dst as other from g union all select dst, 'dependents', src from g where src <> dst")
def file_graph(spark, d):
    """Imports and dependents of each file; a file is no dependent of its own."""
    g = graph.group_dependencies(_edges(spark, d), _files(spark, d))
    return g.select(F.col("src").alias("file"), F.lit("imports").alias("side"), F.col("dst").alias("other")).unionAll(g.where("src <> dst").select("dst", F.lit("dependents"), "src"))


@query(f"with {_EDGES} select dst as node, 'caller' as side, src as other from e union all select src, 'callee', dst from e")
def graph_neighbours(spark, d):
    return graph.neighbours(_edges(spark, d))


@query(f"""with recursive {_TRANS}, p as (select src as first, [src] as path, dst as next from t where src <= dst union all
select first, list_append(path, next), t.dst from p join t on t.src = p.next where p.next > first and not list_contains(path, p.next) and len(path) < 5)
select array_to_string(path, '>') as path, len(path)::int as length from p where next = first""")
def graph_cycles(spark, d):
    return graph.cycles(_transitions(spark, d)).withColumn("path", F.array_join("path", ">"))


def _hits(n: int) -> str:
    first = f"with {_EDGES}, h0 as (select distinct src as node, 1.0::double as x from e)"
    step = "b{j} as materialized (select dst as node, sum(x) as x from e join h{i} on node = src group by 1), a{j} as materialized (select node, x / (select sum(x) from b{j}) as x from b{j}), c{j} as materialized (select src as node, sum(x) as x from e join a{j} on node = dst group by 1), h{j} as materialized (select node, x / (select sum(x) from c{j}) as x from c{j})"
    return ", ".join([first, *[step.format(i=i, j=i + 1) for i in range(n)]]) + f" select coalesce(h.node, a.node) as node, round(coalesce(h.x, 0), 6) as hub, round(coalesce(a.x, 0), 6) as authority from h{n} h full join a{n} a on h.node = a.node"


@query(_hits(20))
def graph_hits(spark, d):
    return graph.hits(_edges(spark, d), 20, tolerance=0).select("node", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


@query("""with p as (select l_suppkey, round(0.4 * least(1.0, avg(l_quantity) / 50) + 0.3 * least(1.0, count(*) / 1000) + 0.3 * avg(l_discount) * 10, 6) as p from lineitem group by 1)
select l_suppkey, round(p, 4) as p, case when p >= 0.5 then 'high' when p >= 0.4 then 'medium' else 'low' end as risk from p where p >= 0.3""")
def bug_probability(spark, d):
    p = F.least(F.lit(1.0), F.avg("l_quantity") / 50) * 0.4 + F.least(F.lit(1.0), F.count(F.lit(1)) / 1000) * 0.3 + F.avg("l_discount") * 10 * 0.3
    own = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(p, 6).alias("x")).where("x >= 0.3")
    return own.select("l_suppkey", F.round("x", 4).alias("p"), findings.ladder(F.col("x"), [(0.5, "high"), (0.4, "medium")], "low").alias("risk"))


@query("select item_id, i::int as dim, ('0x' || substr(md5(text), (i % 16 * 2 + 1)::int, 2))::int / 128 - 1 as value from benchmark, range(128) r(i)")
def hash_embedding(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(vectors.hash_embedding(F.col("text"))).alias("dim", "value"))


@query("""with o as (select o_orderkey as id, o_orderstatus as status, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as needs from orders)
select a.id, a.status from o a left join o b on a.needs = b.id where a.status not in ('F', 'P') and (b.id is null or b.status = 'F')""")
def ready_subproblems(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.lag("o_orderkey").over(w).alias("needs"))
    return delta.ready(o.select("id", "status"), o.where("needs is not null").select("id", "needs"), "F", "P")


@query("""with g as (select *, case when ts < lag(ts) over w + interval 2 hours then 0 else 1 end as new from events window w as (partition by user_id order by ts, event_id)),
s as (select *, sum(new) over (partition by user_id order by ts, event_id) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def session_windows(spark, d):
    return table(spark, d, "events").groupBy("user_id", F.session_window(F.col("ts").cast("timestamp"), "2 hours")).agg(F.min("ts").alias("start"), F.count(F.lit(1)).alias("n")).select("user_id", "start", "n")


@query("select strftime(date_trunc('day', ts), '%Y-%m-%d') as day, event_type as kind, count(*) as n from events group by 1, 2")
def stream_incremental(spark, d):
    like = table(spark, d, "events")
    stream = spark.readStream.schema(like.schema).parquet(f"{d}/events.parq*")
    out = incremental.drained(incremental.window_counts(stream), scratch(spark, "counts"), scratch(spark, "state"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


@query("""with e as (select event_id, user_id, event_type = 'error' as f, row_number() over w as n, lag(event_type) over w = 'error' as f1, lag(event_type, 2) over w = 'error' as f2 from events window w as (partition by user_id order by epoch_us(ts), event_id)),
o as (select user_id, min(n) as n from e where f and f1 and f2 group by 1)
select event_id, e.user_id as user_id, case when e.n > o.n then 'skipped' when f then 'error' else 'ok' end as outcome from e left join o on o.user_id = e.user_id""")
def live_breaker(spark, d):
    """Breakers of users over a stream that comes in two parts: what is counted in the first
    still counts in the second."""
    events = table(spark, d, "events").select("event_id", "user_id", "ts", (F.col("event_type") == "error").alias("failed"))
    middle = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), 0.5).alias("m")).first()["m"]
    source, out, state = scratch(spark, "calls"), scratch(spark, "outcomes"), scratch(spark, "breakers")
    first = F.unix_micros(F.col("ts").cast("timestamp")) <= middle
    for part in (first, ~first):
        events.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        done = live.appended(live.outcomes(stream, "user_id", "event_id", "ts", "failed"), out, state)
    return done.select(F.col("id").alias("event_id"), F.col("key").alias("user_id"), "outcome")


@query("select event_type, count(*) as n, round(sum(value), 4) as total from events group by 1")
def export_roundtrip(spark, d):
    rows, out = table(spark, d, "events").select("event_id", "event_type", "value"), scratch(spark, "export")
    sinks.export(rows, out, "json", ("event_type",))
    return sinks.imported(rows, out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


#: Small sources with known symbols.
SOURCES = [("a.py", "import os\nclass A§:\n    def f(self):\n        return os.getcwd()\n"), ("b.py", "from a import A\ndef g():\n    A().f()\n"), ("c.py", "def broken(:\n")]


@query("""select s_suppkey || '/' || path as path, replace(name, '§', s_suppkey::varchar) as name, kind, line_start, line_end, replace(detail, '§', s_suppkey::varchar) as detail from supplier, (values ('a.py', 'os', 'import', 1, 1, ''), ('a.py', 'A§', 'class', 2, 4, ''), ('a.py', 'f', 'function', 3, 4, 'A§'), ('a.py', 'os.getcwd', 'call', 4, 4, 'A§.f'),
('b.py', 'a.A', 'import', 1, 1, ''), ('b.py', 'g', 'function', 2, 3, ''), ('b.py', 'A().f', 'call', 3, 3, 'g'), ('b.py', 'A', 'call', 3, 3, 'g'), ('c.py', 'SyntaxError', 'error', 1, 1, '')) v(path, name, kind, line_start, line_end, detail)""")
def ast_symbols(spark, d):
    return syntax.symbols(keyed(spark, d, SOURCES, "path string, text string"))
