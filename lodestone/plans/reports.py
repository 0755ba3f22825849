"""Queries on reports, counters, stores, scans by rules, plug-ins and workflows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import plugins
from ..functions import nearest, vectors
from ..operators import findings, graph, history, ingest, problems, reports, rules, symbols, walks
from ..sources.tables import scratch, table
from .catalogue import _LINES, _SEV_SQL, _TRANS, _severity, _transitions, query
from .gates import BEFORE, FIXES, _choice
from .parsed import _TRACE, LOG, _texts, golden, keyed
from .ranked import _SPARSE, _WAYS, _sparse


def _q(s):
    return s.replace("'", "''")


_LINE_SQL = " union all ".join(f"select doc_id, line_no::int as line_no, {i} as n_rule, '{n}' as rule, case when {n == 'crypto'} and contains(lower(line), 'password') then 'CRITICAL' else '{s}' end as severity from l where regexp_matches(line, '(?i){_q(p)}')" for i, (n, s, p) in enumerate(rules.LINE_RULES))


@query(f"with {_LINES} select * from ({_LINE_SQL})")
def rule_pack_lines(spark, d):
    """The line rules of the pack over all texts."""
    return rules.line_hits(table(spark, d, "documents"))


def _text_rule(i, n, s, p):
    return f"select doc_id, {i} as n_rule, '{n}' as rule, '{s}' as severity, regexp_extract_all(text, '(?i){_q(p)}') as m, string_split_regex(text, '(?i){_q(p)}') as g from documents where regexp_matches(text, '(?i){_q(p)}')"


_BREAKS = "length(x) - length(replace(x, chr(10), ''))"


@query(f"""with r as ({" union all ".join(_text_rule(i, *r) for i, r in enumerate(rules.TEXT_RULES))}), k as (select *, unnest(range(1, len(m) + 1)) as k from r),
x as (select *, 1 + list_sum(list_transform(g[1:k], lambda x: {_BREAKS})) + coalesce(list_sum(list_transform(m[1 : k - 1], lambda x: {_BREAKS})), 0) as a from k)
select doc_id, n_rule, rule, severity, a::int as line_start, (a + length(m[k]) - length(replace(m[k], chr(10), '')))::int as line_end from x""")
def rule_pack_texts(spark, d):
    """The text rules of the pack over whole texts, with the lines of each match."""
    return rules.text_hits(table(spark, d, "documents"))


@query(f"with {_LINES}, u as (select n_name as rule, 'low' as severity, n_name || '|' || n_nationkey || '[0-9]{{3}}' as pattern from nation where n_nationkey < 5 and n_nationkey > 0) select doc_id, line_no::int as line_no, rule, severity from l, u where regexp_matches(line, pattern)")
def user_rules(spark, d):
    """Rules of a user's table."""
    own = table(spark, d, "nation").where("n_nationkey between 1 and 4").select(F.col("n_name").alias("rule"), F.lit("low").alias("severity"), F.concat("n_name", F.lit("|"), F.col("n_nationkey").cast("string"), F.lit("[0-9]{3}")).alias("pattern"))
    return rules.user_hits(table(spark, d, "documents"), own)


@query(f"with {_LINES} select doc_id, line_no, substr(line, 1, 100) as line from l where length(regexp_extract(line, '^[ \\t]*')) // 4 > 0")
def nesting_findings(spark, d):
    """Lines nested deeper than a bound (none here), with their first 100 characters."""
    return symbols.indent_rule(table(spark, d, "documents"), 0)


_EXT = "['src/a', 'docs/b', 'tests/c', 'lib/test_d', 'lib/e_spec', 'lib/f'][user_id % 6 + 1] || ['.py', '.md', '.js', '.ts'][user_id % 4 + 1]"


def _file():
    stem = _choice(F.col("user_id"), ["src/a", "docs/b", "tests/c", "lib/test_d", "lib/e_spec", "lib/f"])
    return F.concat(stem, _choice(F.col("user_id"), [".py", ".md", ".js", ".ts"]))


_STREAMS = f"""s as (select {_EXT} as file, 'scan' as kind, case event_type when 'error' then 'ERROR' when 'click' then 'warning' else event_type end as severity, null::double as confidence from events where event_type <> 'signup'
 union all select {_EXT}, 'candidate', case when value > 90 then 'critical' end, value / 100 from events where event_type = 'signup' union all select {_EXT}, 'hypothesis', 'medium', value / 100 from events where value >= 70),
v as (select * from s where not (split_part(file, '/', 1) in ('docs', 'tests') or regexp_matches(file, '(\\.md|_spec\\.(py|js|ts))$') or contains(file, '/test_')))"""


def _streams(spark, d):
    """Three streams of findings, without what a report leaves out."""
    e, kind = table(spark, d, "events").withColumn("file", _file()), F.col("event_type")
    scan = e.where("event_type <> 'signup'").select("file", F.lit("scan").alias("kind"), F.when(kind == "error", "ERROR").when(kind == "click", "warning").otherwise(kind).alias("severity"))
    candidate = e.where("event_type = 'signup'").select("file", F.lit("candidate").alias("kind"), F.when(F.col("value") > 90, "critical").alias("severity"), (F.col("value") / 100).alias("confidence"))
    hypothesis = e.where("value >= 70").select("file", F.lit("hypothesis").alias("kind"), F.lit("medium").alias("severity"), (F.col("value") / 100).alias("confidence"))
    return reports.union(scan, candidate, hypothesis).where(~reports.left_out(F.col("file")))


@query(f"with {_STREAMS}, l as (select file, case when upper(severity) in ('CRITICAL', 'ERROR', 'WARNING') then upper(severity) else 'INFO' end as l from v) select file, count(*) as n, count(*) filter (l = 'CRITICAL') as critical, count(*) filter (l = 'ERROR') as error, count(*) filter (l = 'WARNING') as warning, count(*) filter (l = 'INFO') as info from l group by 1")
def scan_report(spark, d):
    return reports.by_file(_streams(spark, d))


@query(f"with {_STREAMS} select kind, count(*) as n, count(distinct file) as files, round(avg(confidence), 4) as confidence from v group by 1")
def finding_streams(spark, d):
    return _streams(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("file").alias("files"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query(f"with {_STREAMS} select '- ' || upper(coalesce(severity, 'INFO')) || ' ' || kind || ' in ' || file as line, count(*) as n from v group by 1")
def report_markdown(spark, d):
    """The report's lines written as text in the order of files, and read back."""
    out = scratch(spark, "report")
    line = F.concat(F.lit("- "), F.upper(F.coalesce("severity", F.lit("INFO"))), F.lit(" "), "kind", F.lit(" in "), "file")
    _streams(spark, d).select("file", line.alias("line")).orderBy("file", "line").select("line").write.text(out)
    return spark.read.text(out).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("""with f as (select l_orderkey as o_orderkey, arg_max(l_partkey, (l_shipdate, l_linenumber, l_partkey)) as fix from lineitem where l_returnflag = 'R' group by 1), s as (select o_orderkey, fix, case when fix is not null then 'fixed' else o_orderstatus end as status from orders left join f using (o_orderkey))
select count(*) as bugs, count(*) filter (status = 'fixed') as fixed, count(*) filter (status = 'P') as pending, round(100 * count(*) filter (status = 'fixed') / count(*), 4) as success from s""")
def fix_report(spark, d):
    """Counts of a bundle of bugs and fixes, and the rate of success."""
    from ..operators import delta

    fixes = table(spark, d, "lineitem").where("l_returnflag = 'R'").withColumnRenamed("l_orderkey", "o_orderkey")
    s = delta.last_wins(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), fixes, "o_orderkey", ["l_shipdate", "l_linenumber", "l_partkey"], "l_partkey")
    status = F.when(F.col("l_partkey").isNotNull(), "fixed").otherwise(F.col("o_orderstatus"))
    n = F.count(F.lit(1))
    return s.agg(n.alias("bugs"), F.count_if(status == "fixed").alias("fixed"), F.count_if(status == "P").alias("pending"), F.round(F.count_if(status == "fixed") * 100 / n, 4).alias("success"))


@query("select o_orderkey as id, to_json({'id': o_orderkey, 'status': o_orderstatus, 'kind': o_orderpriority})::varchar as json, '<li>' || o_orderkey || ': ' || o_orderstatus || '</li>' as html from orders")
def job_reports(spark, d):
    """One job's report as JSON and as a line of HTML."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"))).alias("json"), F.format_string("<li>%d: %s</li>", "o_orderkey", "o_orderstatus").alias("html"))


@query("select '- id: R' || p_partkey || chr(9) || 'severity: ' || ['low', 'high'][p_partkey % 2 + 1] || chr(9) || 'pattern: \"' || p_name || '\"' as line from part")
def rule_file(spark, d):
    """Learned rules written as text, a rule a line, and read back."""
    out = scratch(spark, "rules")
    p = table(spark, d, "part")
    p.select(F.format_string('- id: R%d\tseverity: %s\tpattern: "%s"', "p_partkey", _choice(F.col("p_partkey"), ["low", "high"]), "p_name").alias("line")).write.text(out)
    return spark.read.text(out).withColumnRenamed("value", "line")


@query("select count(*) as rules, count(distinct p_name) as patterns from part")
def rule_store(spark, d):
    return table(spark, d, "part").agg(F.count(F.lit(1)).alias("rules"), F.countDistinct("p_name").alias("patterns"))


@query("""with c as (select doc_id, unnest(range(0, (len(l) - 1) // 50 + 1)) as chunk, l from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null)), t as (select doc_id, chunk::int as chunk, l[chunk * 50 + 1 : chunk * 50 + 50] as p from c)
select doc_id, chunk, len(p)::int as lines, ('0x' || substr(md5(array_to_string(p, chr(10))), 1, 2))::int / 128 - 1 as first, 128 as size from t""")
def vector_store(spark, d):
    """Texts in blocks of 50 lines with their hash embedding, written and read."""
    out = scratch(spark, "vectors")
    rows = reports.chunks(table(spark, d, "documents"))
    rows.withColumn("embedding", vectors.hash_embedding(F.col("text"))).write.parquet(out)
    return spark.read.parquet(out).select("doc_id", "chunk", "lines", F.col("embedding")[0].alias("first"), F.size("embedding").alias("size"))


@query("select event_id from events order by ts desc, event_id desc limit 1000")
def traffic_log(spark, d):
    """The newest thousand calls of a log are kept."""
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1000).select("event_id")


@query(golden("kind, severity, frames, first", ("heap-buffer-overflow", "critical", 3, "parse§"), ("SEGV", "high", 3, "run§")))
def crash_report(spark, d):
    """Distinct crashes with the number of their frames (ten at most are shown)."""
    found = ingest.traces(_texts(spark, d, ("1", _TRACE.format("heap-buffer-overflow", "parse§")), ("2", _TRACE.format("SEGV", "run§")), ("3", "fine")))
    return found.select("kind", ingest.crash_severity(F.col("kind")).alias("severity"), F.least("depth", F.lit(10)).alias("frames"), F.col("frame").alias("first"))


@query("with p as (select l_suppkey, round(0.4 * least(1.0, avg(l_quantity) / 50) + 0.6 * avg(l_discount) * 10, 4)::double as p from lineitem group by 1) select l_suppkey, p, case when p >= 0.5 then 'high' else 'low' end as risk from p")
def prediction_export(spark, d):
    """Predictions written as JSON and read with their schema."""
    out = scratch(spark, "predictions")
    p = F.least(F.lit(1.0), F.avg("l_quantity") / 50) * 0.4 + F.avg("l_discount") * 10 * 0.6
    rows = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(p, 4).alias("p")).withColumn("risk", findings.ladder(F.col("p"), [(0.5, "high")], "low"))
    rows.write.json(out)
    return spark.read.schema(rows.schema).json(out)


@query("""select 'analysis' as part, o_custkey as key, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as value from orders group by 2 union all select 'problem', l_suppkey, arg_max(l_returnflag, (l_shipdate, l_orderkey, l_linenumber, l_returnflag)) from lineitem group by 2
union all select 'report', user_id, arg_max(event_type, (ts, event_id)) from events group by 2""")
def history_upsert(spark, d):
    """Three history tables by their natural keys; the last row of a key stays."""
    a = reports.latest(table(spark, d, "orders").select(F.lit("analysis").alias("part"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("value"), F.struct("o_orderdate", "o_orderkey").alias("seq")), ["part", "key"], ["seq"])
    b = reports.latest(table(spark, d, "lineitem").select(F.lit("problem").alias("part"), F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("value"), F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag").alias("seq")), ["part", "key"], ["seq"])
    c = reports.latest(table(spark, d, "events").select(F.lit("report").alias("part"), F.col("user_id").alias("key"), F.col("event_type").alias("value"), F.struct("ts", "event_id").alias("seq")), ["part", "key"], ["seq"])
    return reports.union(*[x.drop("seq") for x in (a, b, c)])


@query("select md5(split_part(url, '?', 1)) as key, max(page_id) as page_id, count(*) as accesses, max(length(html))::bigint as most from pages group by 1")
def cache_upsert(spark, d):
    """Cache entries by the digest of their path."""
    key = F.md5(F.split_part("url", F.lit("?"), F.lit(1)))
    return table(spark, d, "pages").groupBy(key.alias("key")).agg(F.max("page_id").alias("page_id"), F.count(F.lit(1)).alias("accesses"), F.max(F.length("html")).cast("long").alias("most"))


@query("select count(*) as entries, sum(length(html))::bigint as size, round(1 - count(distinct md5(html)) / count(*), 4) as hit_rate from pages")
def cache_statistics(spark, d):
    """Entries, their size, and the share of lookups that a content digest would hit."""
    return table(spark, d, "pages").agg(F.count(F.lit(1)).alias("entries"), F.sum(F.length("html")).alias("size"), F.round(F.lit(1) - F.countDistinct(F.md5("html")) / F.count(F.lit(1)), 4).alias("hit_rate"))


@query("""with c as (select doc_id, md5(text) as h, doc_id % 150 as u from documents), e as (select user_id as u, max(ts) as t from events group by 1), n as (select doc_id, case when doc_id % 7 = 0 then md5(text || '!') else md5(text) end as h from documents)
select c.doc_id, case when n.h <> c.h then 'changed' when e.t is null or e.t < (select max(ts) from events) - interval 168 hours then 'expired' else 'hit' end as state from c join n using (doc_id) left join e using (u)""")
def content_cache(spark, d):
    """Cached results are read where the content's digest is the same and the entry is
    no older than 168 hours."""
    docs, e = table(spark, d, "documents"), table(spark, d, "events")
    anchor = e.agg(F.max("ts").alias("anchor"))  # one row
    stamped = e.groupBy(F.col("user_id").alias("u")).agg(F.max("ts").alias("t"))
    now = F.when(F.col("doc_id") % 7 == 0, F.md5(F.concat("text", F.lit("!")))).otherwise(F.md5("text"))
    c = docs.select("doc_id", F.md5("text").alias("h"), now.alias("n"), (F.col("doc_id") % 150).alias("u")).join(stamped, "u", "left").crossJoin(F.broadcast(anchor))
    return c.select("doc_id", F.when(F.col("n") != F.col("h"), "changed").when(F.col("t").isNull() | (F.col("t") < F.col("anchor") - F.expr("interval 168 hours")), "expired").otherwise("hit").alias("state"))


@query(f"with {_LINES}, h as (select * from ({_LINE_SQL})) select source, case when sum(case when severity = 'CRITICAL' then 1 else 0 end) > 0 then sum(case when severity = 'CRITICAL' then 1 else 0 end)::bigint else count(distinct rule) end as applied from h join documents using (doc_id) group by 1")
def distinct_rules(spark, d):
    """The number of rules applied where a scan says it, else of distinct rules."""
    docs = table(spark, d, "documents")
    h = rules.line_hits(docs.select(F.struct("doc_id", "source").alias("doc_id"), "text"))
    said = F.count_if(F.col("severity") == "CRITICAL")
    return h.groupBy("doc_id.source").agg(F.when(said > 0, said).otherwise(F.countDistinct("rule")).alias("applied"))


_CALL = "def f(a, b, c, d, e, g):\n    x = 42\n    # 7 and 8\n    return a + 3 + 1\n" + "def h():\n" + "    y = 1\n" * 60


@query(golden("path, long_methods, long_parameters, numbers", ("s.py", 1, 1, 2)))
def smell_metrics(spark, d):
    """Long methods, long parameter lists and magic numbers of a file."""
    from ..operators import code, syntax

    files = _texts(spark, d, ("s.py", _CALL)).where(F.col("path").endswith("s.py"))
    per = syntax.metrics(files).groupBy("path").agg(F.count_if(F.col("n_lines") > 50).alias("long_methods"), F.count_if(F.col("params") > 5).alias("long_parameters"))
    return per.join(files.select("path", F.size(code.numbers(F.col("text"))).alias("numbers")), "path")


@query("""with c as (select l_suppkey, count(*) filter (l_shipdate < timestamp '1998-01-01') as t1, count(*) filter (l_shipdate >= timestamp '1998-01-01') as t2, count(*) filter (l_shipdate < timestamp '1998-01-01' and l_returnflag <> 'N') as c1, count(*) filter (l_shipdate >= timestamp '1998-01-01' and l_returnflag <> 'N') as c2 from lineitem group by 1),
p as (select *, round(coalesce(100 * c1 / nullif(t1, 0), 0), 4) as before, round(coalesce(100 * c2 / nullif(t2, 0), 0), 4) as after from c) select l_suppkey, before, after, round(after - before, 4) as delta, after - before < -0.01 as regression from p""")
def coverage_delta(spark, d):
    """Coverage before and after, and whether it fell."""
    old, hit = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"), F.col("l_returnflag") != "N"
    per = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_if(old).alias("t1"), F.count_if(~old).alias("t2"), F.count_if(old & hit).alias("c1"), F.count_if(~old & hit).alias("c2"))
    share = lambda c, t: F.round(F.coalesce(F.try_divide(F.col(c) * 100, F.col(t)), F.lit(0.0)), 4)
    out = per.select("l_suppkey", share("c1", "t1").alias("before"), share("c2", "t2").alias("after"))
    gap = F.col("after") - F.col("before")
    return out.withColumn("delta", F.round(gap, 4)).withColumn("regression", gap < -0.01)


@query("select sum(case when l_returnflag <> 'N' then 1 else 0 end)::bigint as covered, count(*) as total, round(100 * sum(case when l_returnflag <> 'N' then 1 else 0 end) / count(*), 4) as percent from lineitem")
def coverage_totals(spark, d):
    hit = F.col("l_returnflag") != "N"
    return table(spark, d, "lineitem").agg(F.count_if(hit).alias("covered"), F.count(F.lit(1)).alias("total"), F.round(F.count_if(hit) * 100 / F.count(F.lit(1)), 4).alias("percent"))


@query("select count(*) as files, round(100 * count(*) filter (length(text) > 0) / count(*), 2) as success, round(avg(n_chars), 2) as mean, round(1 - count(distinct md5(text)) / count(*), 4) as hit_rate from documents")
def parse_statistics(spark, d):
    n = F.count(F.lit(1))
    return table(spark, d, "documents").agg(n.alias("files"), F.round(F.count_if(F.length("text") > 0) * 100 / n, 2).alias("success"), F.round(F.avg("n_chars"), 2).alias("mean"), F.round(F.lit(1) - F.countDistinct(F.md5("text")) / n, 4).alias("hit_rate"))


@query("select count(*) as total, count(*) filter (value > 90) as kept, round(1 - count(*) filter (value > 90) / count(*), 4) as reduction, round(100 * (count(distinct user_id) - count(distinct case when value > 90 then user_id end)) / count(distinct user_id), 4) as filtered from events")
def reduction_ratio(spark, d):
    n, hit = F.count(F.lit(1)), F.col("value") > 90
    users, left = F.countDistinct("user_id"), F.countDistinct(F.when(hit, F.col("user_id")))
    return table(spark, d, "events").agg(n.alias("total"), F.count_if(hit).alias("kept"), F.round(F.lit(1) - F.count_if(hit) / n, 4).alias("reduction"), F.round((users - left) * 100 / users, 4).alias("filtered"))


@query(f"with s as (select user_id, count(*) as total, count(*) filter ({_SEV_SQL} = 'critical') as critical, count(*) filter ({_SEV_SQL} = 'high') as high from events group by 1) select *, total || ' findings, ' || critical || ' critical, ' || high || ' high' as summary from s")
def report_counters(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(_severity() == "critical").alias("critical"), F.count_if(_severity() == "high").alias("high"))
    return s.withColumn("summary", F.format_string("%d findings, %d critical, %d high", "total", "critical", "high"))


@query("select count(*) filter (o_orderstatus in ('O', 'P')) as active, count(*) filter (o_orderstatus = 'F') as completed, count(*) as jobs from orders")
def job_counters(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").agg(F.count_if(s.isin("O", "P")).alias("active"), F.count_if(s == "F").alias("completed"), F.count(F.lit(1)).alias("jobs"))


@query(f"select event_id, {_EXT} as file from events where not (split_part({_EXT}, '/', 1) in ('docs', 'tests') or regexp_matches({_EXT}, '(\\.md|_spec\\.(py|js|ts))$') or contains({_EXT}, '/test_'))")
def report_paths(spark, d):
    """Findings in files that a report shows."""
    return table(spark, d, "events").select("event_id", _file().alias("file")).where(~reports.left_out(F.col("file")))


@query("with n as (select event_id, 'id:' || event_id || ',cov:' || floor(value)::int || case when event_type = 'error' then ',+cov' else '' end as name from events) select event_id, name from n where contains(name, '+cov') or regexp_extract(name, 'cov:([0-9]+)', 1)::int >= 100")
def interesting_inputs(spark, d):
    name = F.concat(F.lit("id:"), F.col("event_id").cast("string"), F.lit(",cov:"), F.floor("value").cast("string"), F.when(F.col("event_type") == "error", ",+cov").otherwise(""))
    return table(spark, d, "events").select("event_id", name.alias("name")).where(reports.interesting(F.col("name"), F.lit(1)))


@query("with n as (select 'id:' || lpad(event_id::varchar, 6, '0') || ',src:' || user_id || ',op:' || event_type || case when value > 90 then ',+cov' else '' end as name from events) select split_part(split_part(name, ',', 1), ':', 2) as id, split_part(split_part(name, ',', 2), ':', 2) as src, split_part(split_part(name, ',', 3), ':', 2) as op, contains(name, '+cov') as new from n")
def fuzz_queue(spark, d):
    """The names of a fuzzer's queue as columns."""
    name = F.concat(F.lit("id:"), F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit(",src:"), F.col("user_id").cast("string"), F.lit(",op:"), "event_type", F.when(F.col("value") > 90, ",+cov").otherwise(""))
    rows = table(spark, d, "events").select(name.alias("name")).withColumn("m", F.str_to_map("name", F.lit(","), F.lit(":")))
    return rows.select(*[F.try_element_at("m", F.lit(k)).alias(k) for k in ("id", "src", "op")], F.col("name").contains("+cov").alias("new"))


@query("select o_orderkey, name, created from (select o_orderkey, ['app_scan_', 'app_fix_', 'report_', 'other_'][o_orderkey % 4 + 1] || o_custkey || '.json' as name, o_orderdate::date::varchar as created from orders) where regexp_matches(name, '_scan_|_fix_|^report_') order by created desc, o_orderkey limit 200")
def report_scan(spark, d):
    """Report files by their names, the newest first."""
    name = F.concat(_choice(F.col("o_orderkey"), ["app_scan_", "app_fix_", "report_", "other_"]), F.col("o_custkey").cast("string"), F.lit(".json"))
    rows = table(spark, d, "orders").select("o_orderkey", name.alias("name"), F.to_date("o_orderdate").cast("string").alias("created"))
    return rows.where(F.col("name").rlike("_scan_|_fix_|^report_")).orderBy(F.desc("created"), "o_orderkey").limit(200)


@query("select o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as newest from orders where o_orderpriority = '1-URGENT' or o_orderstatus = 'F' group by 1")
def report_lookup(spark, d):
    """The newest report of each project that fits a name or a path."""
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' or o_orderstatus = 'F'")
    return o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("newest"))


def _confidence(events):
    """(user_id, c): the mean of a user's values, summed in the order of the events: at a
    tie of the rounding the last bit decides, which follows from the order."""
    return reports.mean_in_order(events, "user_id", "value", "event_id").select("user_id", F.round(F.least(F.lit(1.0), F.col("mean") / 60), 6).alias("c"))


@query("with c as (select user_id, round(least(1.0, avg(value) / 60), 6) as c from events group by 1) select user_id, round(c, 4) as confidence, row_number() over (order by c desc, user_id) as rank from c")
def evidence_ranking(spark, d):
    """Candidates numbered by confidence: a sort by ranges, one number a range."""
    c = _confidence(table(spark, d, "events"))
    return reports.numbered(c, [F.desc("c"), F.col("user_id")]).select("user_id", F.round("c", 4).alias("confidence"), "rank")


@query("with c as (select user_id, round(least(1.0, avg(value) / 60), 6) as c from events where event_type = 'click' group by 1) select u.user_id, round(coalesce(c, 0.5), 4)::double as confidence, row_number() over (order by coalesce(c, 0.5) desc, u.user_id)::int as rank from (select distinct user_id from events) u left join c using (user_id) order by rank limit 20")
def candidate_rerank(spark, d):
    """The twenty best by aggregated confidence, .5 where there is none."""
    e = table(spark, d, "events")
    c = _confidence(e.where("event_type = 'click'"))
    top = e.select("user_id").distinct().join(c, "user_id", "left").withColumn("c", F.coalesce("c", F.lit(0.5))).orderBy(F.desc("c"), "user_id").limit(20)
    return top.select("user_id", F.round("c", 4).alias("confidence"), F.row_number().over(Window.orderBy(F.desc("c"), "user_id")).alias("rank"))  # 20 rows


@query(f"with r as (select event_id, row_number() over (order by round(value, 0) desc, case {_SEV_SQL} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, event_id)::int as one, row_number() over (order by case {_SEV_SQL} when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end, -value, event_id)::int as two from events) select * from r where one <= 30 or two <= 30")
def two_key_sorts(spark, d):
    """Rows among the first thirty by confidence and severity, or by severity and
    confidence, with both ranks."""
    e = table(spark, d, "events").select("event_id", "value", findings.severity_rank(_severity()).alias("s"))
    one = reports.numbered(e, [F.desc(F.round("value", 0)), F.col("s"), F.col("event_id")], "one").select("event_id", F.col("one").cast("int").alias("one"))
    two = reports.numbered(e, [F.col("s"), F.desc("value"), F.col("event_id")], "two").select("event_id", F.col("two").cast("int").alias("two"))
    return one.join(two, "event_id").where("one <= 30 or two <= 30")


@query("""with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, unnest([{'n': 'quantity', 'v': l_quantity / 50}, {'n': 'discount', 'v': l_discount::double * 10}, {'n': 'tax', 'v': l_tax::double * 10}, {'n': 'line', 'v': l_linenumber / 7}, {'n': 'price', 'v': l_extendedprice / 100000}, {'n': 'part', 'v': (l_partkey % 100) / 100}]) as x from lineitem),
r as (select x.n as feature, row_number() over (partition by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity order by round(x.v, 6) desc, x.n) as r from f) select feature, count(*) as n from r where r <= 5 group by 1""")
def top_importances(spark, d):
    """How often each feature is among the five largest of a row, sorted in the row."""
    pairs = {"quantity": F.col("l_quantity") / 50, "discount": F.col("l_discount").cast("double") * 10, "tax": F.col("l_tax").cast("double") * 10, "line": F.col("l_linenumber") / 7, "price": F.col("l_extendedprice") / 100000, "part": (F.col("l_partkey") % 100) / 100}
    entries = F.array_sort(F.array(*[F.struct((-F.round(v, 6)).alias("v"), F.lit(n).alias("n")) for n, v in pairs.items()]))
    rows = table(spark, d, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]).select(F.explode(F.transform(F.slice(entries, 1, 5), lambda x: x["n"])).alias("feature"))
    return rows.groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("select o_orderkey, o_orderpriority from orders where o_orderstatus = 'O' order by o_orderpriority, o_orderdate, o_orderkey limit 100")
def work_order(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderpriority")


_TARGETS = [("parse_input", "memcpy(a, b); free(a)", 2, 0.2 + 0.15 * 2 + 0.2), ("read_file", "gets(s)", 0, 0.2 + 0.15), ("sum", "return a", 1, 0.1), ("exec_eval_socket", "strcpy(a, b); sprintf(s); malloc(3)", 0, 0.6 + 0.15 * 3)]


@query("select s_suppkey, s_suppkey % 4 as kind, round(least(1.0, risk), 4) as risk from supplier join (values " + ", ".join(f"({i}, {t[3]}::double + case when {i} = 1 then 0.2 else 0 end)" for i, t in enumerate(_TARGETS)) + ") v(k, risk) on k = s_suppkey % 4 where risk >= 0.5 order by least(1.0, risk) desc, s_suppkey limit 10")
def fuzz_targets(spark, d):
    """The ten functions most worth fuzzing, from .5 on; the SQL has the scores by hand."""
    k = F.col("s_suppkey")
    risk = reports.fuzz_risk(_choice(k, [t[0] for t in _TARGETS]), _choice(k, [t[1] for t in _TARGETS]), _choice(k, [t[2] for t in _TARGETS]), k % 4 == 1)
    return table(spark, d, "supplier").select("s_suppkey", (k % 4).alias("kind"), F.round(risk, 4).alias("risk")).where("risk >= 0.5").orderBy(F.desc("risk"), "s_suppkey").limit(10)


@query("select o_orderkey, plus, minus from orders join (values (0, 0, 0), (1, 2, 0), (2, 1, 1), (3, 1, 1), (4, 8, 0), (5, 1, 1), (6, 1, 0), (7, 1, 4)) v(k, plus, minus) on k = o_orderkey % 8")
def unified_diffs(spark, d):
    """Added and removed lines of unified diffs; the SQL has the counts by hand."""
    rows = table(spark, d, "orders").select("o_orderkey", F.lit(BEFORE).alias("before"), _choice(F.col("o_orderkey"), [f[0] for f in FIXES]).alias("after"))
    out = reports.unified(rows, "before", "after").withColumn("l", F.split("diff", "\n"))
    side = lambda c: F.size(F.filter("l", lambda x: x.startswith(c) & ~x.startswith(c * 3)))
    return out.select("o_orderkey", side("+").alias("plus"), side("-").alias("minus"))


@query("with l as (select doc_id, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, unnest(string_split(text, chr(10))) as x from documents), h as (select *, row_number() over (partition by doc_id order by n) as r from l where contains(x, '(') and contains(x, ')')) select doc_id, md5('L' || n || ': ' || trim(x, ' ')) as snippet from h where r <= 100")
def call_snippets(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(reports.call_snippets(F.col("text"))).alias("s")).select("doc_id", F.md5("s").alias("snippet"))


@query("select l_orderkey, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:4], ',') as first, len(list_distinct(list(l_partkey)))::int as n from lineitem group by 1")
def list_operations(spark, d):
    """Distinct, sorted, the first four: of an order's parts."""
    parts = F.array_sort(F.collect_set("l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(parts.alias("p")).select("l_orderkey", F.array_join(F.slice("p", 1, 4), ",").alias("first"), F.size("p").alias("n"))


@query("select source, substr(sha256(string_agg(sha256(text), '' order by doc_id)), 1, 16) as hash from documents where text is not null group by 1")
def repo_hash(spark, d):
    """The hash of a repository: of its files' hashes in order (64 characters a file)."""
    rows = table(spark, d, "documents").where("text is not null").select("source", F.struct("doc_id", F.sha2("text", 256).alias("h")).alias("f"))
    return rows.groupBy("source").agg(F.substring(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["h"]), ""), 256), 1, 16).alias("hash"))


@query(golden("id, hypothesis, cause, solution, affected, confidence", (1, "a null in f§", "no check", "add one", "f.py", 0.8), (2, "x", "", "y", "", 0.7), (3, "", "", "", "", 0.5)))
def model_responses(spark, d):
    """The parts of a model's answer under four heads, with a confidence."""
    rows = keyed(spark, d, [(1, "intro\nHYPOTHESE: a null\n in f§\nURSACHE: no check\nLÖSUNG: add one\nBETROFFEN: f.py"), (2, "HYPOTHESE: x\nLÖSUNG: y"), (3, "nothing")], "id int, text string")
    return reports.sections(rows).drop("text")


@query(golden("file, day", ("x§.py", "2024-03-02")))
def last_commit_files(spark, d):
    """The files that the newest commit changed."""
    c = ingest.commits(_texts(spark, d, ("log", LOG)))
    last = c.agg(F.max("day").alias("day"))
    return c.join(F.broadcast(last), "day").select("file", "day").distinct()  # one row


@query("select case regexp_extract(lower(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\\.[^./]+$') when '.html' then 'html' when '.php' then 'php' when '.js' then 'javascript' else 'unknown' end as language, split_part(url, ':', 1) as scheme, count(*) as n from pages group by all")
def language_distribution(spark, d):
    """Files by language (the suffixes of a language summed) and scheme."""
    from ..operators import paths

    rows = table(spark, d, "pages").select(F.split_part("url", F.lit(":"), F.lit(1)).alias("scheme"), F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    return paths.with_language(rows, "path").groupBy("language", "scheme").agg(F.count(F.lit(1)).alias("n"))


@query("""with q as (select vec_id as query_id, embedding as q from embeddings where vec_id % 100 = 0), s as (select query_id, vec_id, round(list_dot_product(embedding::double[], q::double[]) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(q::double[], q::double[])), 4) as similarity from embeddings, q where vec_id <> query_id),
r as (select *, row_number() over (partition by query_id order by similarity desc, vec_id) as rank from s) select query_id, vec_id, round(1 - (2 - 2 * similarity) / 2, 4) as score from r where rank <= 10 and similarity >= 0.3""")
def vector_similar(spark, d):
    """The ten nearest of each asked vector that are similar enough; the bound comes
    after the ranking."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = vectors.top_k(rows, rows.where("vec_id % 100 = 0"), 10, 0.3)
    return out.select("query_id", "vec_id", F.round(F.lit(1) - (F.lit(2) - F.col("similarity") * 2) / 2, 4).alias("score"))


@query()
def vector_index(spark, d):
    """The ten nearest of each asked vector by an inverted file over all rows (its recall
    against the exact way is tested).  The vectors of the tables have no clusters, so
    three of four lists are looked into."""
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    return nearest.search(nearest.build(rows), rows.where("vec_id % 100 = 0"), probes=48)


@query("select p_partkey, 'Type: ' || p_type || '. Pattern: ' || p_name || '. Severity: ' || ['low', 'high'][p_partkey % 2 + 1] as text from part")
def embedding_texts(spark, d):
    """The text of a rule that a model embeds (the vector is given, none is computed)."""
    return table(spark, d, "part").select("p_partkey", F.format_string("Type: %s. Pattern: %s. Severity: %s", "p_type", "p_name", _choice(F.col("p_partkey"), ["low", "high"])).alias("text"))


_SUBS = [("boundary", 0, 0.8), ("state", 1, 0.6), ("input", 1, 0.7), ("timing", 2, 0.5), ("memory", 2, 0.9)]


@query(f"""with s as (select event_id, part, priority, round(conf * least(1.0, value / 100), 6) as c from events, (values {", ".join(map(str, _SUBS))}) v(part, priority, conf) where event_type = 'error'), r as (select *, row_number() over (partition by event_id order by priority, -c, part) as r from s) select event_id, r::int as seq, part from r where r <= 4""")
def bug_decomposition(spark, d):
    """Each bug in at most four parts, by priority, then confidence: sorted in the row."""
    c = lambda conf: -F.round(F.lit(conf) * F.least(F.lit(1.0), F.col("value") / 100), 6)
    subs = F.array_sort(F.array(*[F.struct(F.lit(p).alias("priority"), c(conf).alias("c"), F.lit(n).alias("part")) for n, p, conf in _SUBS]))
    rows = table(spark, d, "events").where("event_type = 'error'").select("event_id", F.posexplode(F.slice(subs, 1, 4)).alias("p", "s"))
    return rows.select("event_id", (F.col("p") + 1).alias("seq"), "s.part")


@query(f"with {_SPARSE}, n as (select count(distinct x) as nodes from (select unnest([src, dst]) as x from e)), c as (with recursive {_TRANS}, p as (select src as first, [src] as path, dst as next from t where src <= dst union all select first, list_append(path, next), t.dst from p join t on t.src = p.next where p.next > first and not list_contains(path, p.next) and len(path) < 5) select count(*) as cycles from p where next = first) select nodes, count(*) as edges, (select count(distinct s_nationkey) from supplier) as files, round(count(*) / (nodes * (nodes - 1)), 4) as density, round(count(*) / nodes, 4) as degree, any_value(cycles) as cycles from e, n, c group by nodes")
def graph_overview(spark, d):
    """Nodes, edges, files, density, degree, and the cycles of at most five nodes (of
    the small graph of event types)."""
    one = walks.statistics(_sparse(spark, d)).crossJoin(table(spark, d, "supplier").agg(F.countDistinct("s_nationkey").alias("files")))
    return one.crossJoin(graph.cycles(_transitions(spark, d)).agg(F.count(F.lit(1)).alias("cycles")))  # one row each


@query(f"{_WAYS} select node, distance from m where source = 0")
def graph_shortest_paths(spark, d):
    """The length of the shortest path from a node, by the paths themselves (the least of
    equal ones), each checked to be as long as its distance."""
    e = _sparse(spark, d)
    found = walks.shortest_paths(e, e.where("src = 0").select(F.col("src").alias("node")).distinct())
    return found.select("node", (F.size("path") - 1).alias("distance"))


@query("""with s as (select p_name as file, count(*) as lines from part join lineitem on l_partkey = p_partkey group by 1), d as (select split_part(file, ' ', 1) as directory, sum(lines)::bigint as lines from s group by 1) select directory, lines, case when (select sum(lines) from d) >= 50000 and (select count(*) from d) >= 2 then directory else 'all' end as shard from d""")
def repo_shards(spark, d):
    """Shards by top directory of a large repository."""
    s = table(spark, d, "part").join(table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.regexp_replace("p_name", " ", "/").alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    return plugins.shards(s, 50_000)


def registry():
    """Two agents, an analyser and two refactorings of this engine."""
    out = plugins.Registry()

    @out.agent("secrets")
    def secrets(files):
        hits = rules.line_hits(files, [("secret", "HIGH", r"token\s*=")], "file", "text")
        return hits.select("file", F.col("line_no").cast("long").alias("line_no"), "rule", "severity")

    @out.agent("long")
    def long(files):
        return files.where(F.length("text") > 2000).select("file", F.lit(1).cast("long").alias("line_no"), F.lit("long").alias("rule"), F.lit("LOW").alias("severity"))

    @out.analyser("marks")
    def marks(file, text):
        return [(i, "marks", "LOW") for i, line in enumerate(text.split("\n"), 1) if "###" in line]

    out.refactoring("trim", lambda t: t != t.strip(" "))(lambda t: t.strip(" "))
    out.refactoring("marks", lambda t: "###" in t)(lambda t: t.replace("###", ""))
    return out


@query(f"""with {_LINES} select 'secrets' as agent, doc_id::varchar as file, line_no, 'secret' as rule, 'HIGH' as severity from l where regexp_matches(line, '(?i)token\\s*=') union all select 'long', doc_id::varchar, 1, 'long', 'LOW' from documents where length(text) > 2000
union all select 'marks', doc_id::varchar, line_no, 'marks', 'LOW' from l where contains(line, '###')""")
def plugin_findings(spark, d):
    """What registered agents and analysers find."""
    return registry().findings(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))


@query("select doc_id::varchar as file, md5(replace(trim(text, ' '), '###', '')) as text, array_to_string(list_filter([case when text <> trim(text, ' ') then 'trim' end, case when contains(text, '###') then 'marks' end], lambda x: x is not null), ',') as applied from documents")
def plugin_refactorings(spark, d):
    out = registry().refactored(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))
    return out.select("file", F.md5("text").alias("text"), F.array_join("applied", ",").alias("applied"))


@query("""with c as (select event_id, value / 100 as c, event_id % 5 as need from events), h as (select *, case when c >= 0.7 then 0 else least(5, ceil(round((0.7 - c) * 10, 6)))::int end as more from c), k as (select *, round(c + more * 0.1, 6) >= 0.7 as ok from h)
select event_id, case when not ok then 'escalate' when need <= 3 then 'done' else 'escalate' end as state, (1 + 1 + more + case when ok then case when need = 0 then 1 else least(need, 3) end else 0 end + 1)::int as visits from k""")
def workflow_states(spark, d):
    """Candidates through a workflow: a hypothesis is made again at most five times until
    it is sure, then patches are tried at most three times, else it is escalated."""
    sure = "round(confidence, 6) >= 0.7"
    flow = plugins.Workflow(
        {
            "scan": plugins.Step(lambda r: r, [("hypothesis", "true")]),
            "hypothesis": plugins.Step(lambda r: r.withColumn("confidence", F.col("confidence") + F.when(F.col("made"), 0.1).otherwise(0.0)).withColumn("made", F.lit(True)), [("patch", sure), ("hypothesis", f"not ({sure})"), ("escalate", "true")], 6),
            "patch": plugins.Step(lambda r: r.withColumn("tries", F.col("tries") + 1), [("done", "tries >= need"), ("patch", "tries < need"), ("escalate", "true")], 3),
            "done": plugins.Step(lambda r: r, []),
            "escalate": plugins.Step(lambda r: r, []),
        },
        "scan",
    )
    rows = table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("confidence"), F.lit(False).alias("made"), F.lit(0).alias("tries"), (F.col("event_id") % 5).alias("need"))
    return flow(rows).select("event_id", "state", "visits")


@query("select user_id, ts, kind, n from (select user_id, date_trunc('minute', min(ts)) as ts, event_type as kind, count(*) as n from events group by user_id, event_type) where kind = 'error'")
def error_onset(spark, d):
    """The first minute of errors of each user: a chain of functions on tables."""
    first = lambda e: e.groupBy("user_id", F.col("event_type").alias("kind")).agg(F.date_trunc("minute", F.min("ts")).alias("ts"), F.count(F.lit(1)).alias("n"))
    return table(spark, d, "events").transform(first).transform(lambda e: e.where("kind = 'error'"))


@query(f"""with {_LINES}, f as (select 'secrets' as agent, doc_id::varchar as file, line_no, 'HIGH' as severity from l where regexp_matches(line, '(?i)token\\s*=') union all select 'long', doc_id::varchar, 1, 'LOW' from documents where length(text) > 2000 union all select 'marks', doc_id::varchar, line_no, 'LOW' from l where contains(line, '###')),
r as (select *, row_number() over (partition by file, line_no order by agent) as rn, count(*) over (partition by file, line_no) as confirmed, string_agg(agent, ',') over (partition by file, line_no) as a from f)
select file, line_no, agent, round(case when confirmed > 1 then least(1.0, 0.5 * 1.2) else 0.5 end, 4)::double as confidence, confirmed from r where rn = 1""")
def swarm_report(spark, d):
    """All agents over the files, their findings united; one finding a line stays, surer
    where several agents say it."""
    found = registry().findings(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("file"), "text"))
    out = findings.keep_first(found.withColumn("confidence", F.lit(0.5)), ["file", "line_no"], [F.col("agent")], "confidence", "agent")
    return out.select("file", "line_no", "agent", F.round("confidence", 4).alias("confidence"), "confirmed")
