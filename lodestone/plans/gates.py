"""Queries on the confidence of fixes, evidence packages, policies and votes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import findings, gates
from ..sources.tables import table
from .catalogue import _SEV_SQL, _seconds, _severity, query


def _choice(column, values):
    return F.element_at(F.array(*map(F.lit, values)), (column % len(values) + 1).cast("int"))


#: A source and eight fixes of it, with the scores that follow from the rules by hand:
#: syntax, dependencies, api, semantics.
BEFORE = "import os\ndef run(a, b=1):\n    return a\ndef _hid(x):\n    return x\n"
FIXES = [
    (BEFORE, 100, 100, 100, 100),
    ("import requests\nimport numpy\n" + BEFORE, 100, 60, 100, 100),
    (BEFORE.replace("run(a, b=1)", "run(b)"), 100, 100, 75, 100),
    (BEFORE.replace("run", "go"), 100, 100, 70, 100),
    (BEFORE + "x = 1\n" * 7 + "eval('1')\n", 100, 100, 100, 50),
    (BEFORE.replace("run(a, b=1)", "run(a:"), 0, 100, 70, 100),
    ("import json\n" + BEFORE, 100, 100, 100, 100),
    ("def run(a, b=1):\n    subprocess.call(a, shell=True)\n", 100, 100, 100, 70),
]
_HAND = ", ".join(f"({i}, {f[1]}::double, {f[2]}::double, {f[3]}::double, {f[4]}::double)" for i, f in enumerate(FIXES))
_ORDERED = "['syntax', 'tests', 'dependencies', 'api', 'semantics']"
_FACTORS = "[{'s': -syntax, 'i': 0, 'n': 'syntax'}, {'s': -tests, 'i': 1, 'n': 'tests'}, {'s': -dependencies, 'i': 2, 'n': 'dependencies'}, {'s': -api, 'i': 3, 'n': 'api'}, {'s': -semantics, 'i': 4, 'n': 'semantics'}]"


@query(f"""with t as (select l_orderkey as o_orderkey, count(*) as total, count(*) filter (l_returnflag <> 'A') as passed from lineitem group by 1),
f as (select o_orderkey, case when o_orderkey % 16 >= 8 then case when o_orderkey % 8 = 5 then 50 else 100 end else syntax end::double as syntax, coalesce(passed * 100 / total, 75.0)::double as tests, dependencies, api, semantics from orders join (values {_HAND}) h(k, syntax, dependencies, api, semantics) on k = o_orderkey % 8 left join t using (o_orderkey)),
g as (select *, round(0.2 * syntax + 0.25 * tests + 0.15 * dependencies + 0.2 * api + 0.2 * semantics, 1) as overall, list_sort({_FACTORS}) as o from f)
select o_orderkey, syntax, round(tests, 4) as tests, dependencies, api, semantics, overall, case when overall >= 90 then 'high' when overall >= 70 then 'medium' else 'low' end as level,
 array_to_string(list_transform(list_filter(o, lambda x: x.s <= -90), lambda x: x.n)[1:2], ',') as strong, array_to_string(list_transform(list_filter(o, lambda x: x.s > -70), lambda x: x.n)[1:2], ',') as weak from g""")
def fix_confidence(spark, d):
    """Each order has one of eight fixes; its lines are the tests.  Half of the files are
    no Python, where brackets are counted."""
    key = F.col("o_orderkey")
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("l_returnflag") != "A").alias("passed"))
    rows = table(spark, d, "orders").join(t, "o_orderkey", "left").select("o_orderkey", F.lit(BEFORE).alias("before"), _choice(key, [f[0] for f in FIXES]).alias("after"), F.when(key % 16 >= 8, "a.js").otherwise("a.py").alias("path"), "passed", "total")
    out = gates.fix_confidence(rows)
    return out.select("o_orderkey", "syntax", F.round("tests", 4).alias("tests"), "dependencies", "api", "semantics", "overall", "level", "strong", "weak")


_DETAILS = ["input of a request reaches the query", "there is a bug in the loop over rows", "too short"]
_PATHS = ["src/a.py", "src/b.rs", "docs/readme.txt", "src/c.go", "src/d.py"]
_CLASSES = ["critical", "high", "medium", "low", "low"]
_PACKAGE = f"""h as (select l_orderkey as id, list({{'title': 'part ' || l_partkey % 50, 'type': l_returnflag, 'confidence': least(1.0::double, l_discount * 10 + 0.2), 'flow': l_tax > 0.06}} order by l_linenumber, l_partkey, l_suppkey) as h from lineitem group by 1),
p as (select o_orderkey as id, {_PATHS}[o_orderkey % 5 + 1] as path, o_orderkey % 4 as first, o_custkey % 9 as last, case when o_orderkey % 7 > 0 then 'run it' else '' end as descr, case when o_orderkey % 6 > 0 then 'f(1)' else ' ' end as snip, case when o_orderkey % 5 > 0 then 'x' else '' end as input,
 o_custkey % 4 as symbols, case when o_custkey % 3 > 0 then 'a-b' else '' end as snippet, o_orderkey % 3 as depth, {_DETAILS}[o_custkey % 3 + 1] as details, case when o_custkey % 2 = 0 then 'cross_module' else 'local' end as scope, {_CLASSES}[o_custkey % 5 + 1] as risk, coalesce(h, []) as h from orders left join h on id = o_orderkey),
s as (select *, coalesce(list_sum(list_transform(h, lambda x: x.confidence)) / nullif(len(h), 0), 0) as mean, len(h) as n from p),
v as (select *, round(greatest(0.0, least(1.0, 0.4 * mean + case when snippet <> '' then 0.1 else 0 end + case when depth > 0 then 0.1 else 0 end + case when len(list_filter(h, lambda x: x.flow)) > 0 then 0.2 else 0 end + case when descr <> '' then 0.1 else 0 end + case when trim(snip) <> '' then 0.05 else 0 end + case when input <> '' then 0.05 else 0 end)), 6) as score,
 contains(details, 'there is a bug') as vague, case when risk in ('critical', 'high') then 0.6 when risk = 'medium' then 0.5 else 0.4 end as threshold from s),
e as (select *, list_filter([case when descr = '' or trim(snip) = '' then 'no reproduction' end, case when symbols = 0 then 'no symbols' end, case when vague then 'vague invariant' end, case when n < 3 then 'few hypotheses' end, case when n > 5 then 'many hypotheses' end,
 case when path like '%.txt' then 'no source file' end, case when first <= 0 or last < first then 'bad lines' end, case when score < threshold then 'under threshold' end, case when score < 0.4 then 'weak' end, case when vague then 'vague invariant again' end, case when length(details) < 20 then 'short details' end,
 case when n < 3 then 'few hypotheses again' end, case when n > 5 then 'many hypotheses again' end, case when len(list_distinct(list_transform(h, lambda x: x.title))) < n then 'equal titles' end, case when len(list_distinct(list_transform(h, lambda x: x.type))) < 2 and n >= 3 then 'one kind' end, case when mean < 0.3 then 'low confidence' end], lambda x: x is not null) as errors,
 list_filter([case when risk = 'critical' and score < 0.7 then 'critical with moderate evidence' end, case when risk = 'high' and input = '' then 'high without input' end, case when scope = 'cross_module' and score < 0.5 then 'wide with little evidence' end], lambda x: x is not null) as warnings from v)"""


def packages(spark, d):
    """An evidence package an order, its lines as hypotheses."""
    conf = F.least(F.lit(1.0), F.col("l_discount") * 10 + 0.2)
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat(F.lit("part "), (F.col("l_partkey") % 50).cast("string")).alias("title"), F.col("l_returnflag").alias("type"), conf.alias("confidence"), F.when(F.col("l_tax") > 0.06, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("data_flow_path"))
    h = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(item)).alias("hypotheses"))  # an order's lines
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    none = F.filter(F.array(F.struct(F.lit(0).cast("long"), F.lit(0).cast("long"))), lambda x: F.lit(False))
    text = lambda t, yes, no="": F.when(t, yes).otherwise(no)
    rows = table(spark, d, "orders").join(h, "o_orderkey", "left")
    empty = F.filter(F.coalesce("hypotheses", F.array().cast(h.schema["hypotheses"].dataType)), lambda x: F.lit(True))
    repro = F.struct(text(key % 7 > 0, "run it").alias("description"), text(key % 6 > 0, "f(1)", " ").alias("code_snippet"), text(key % 5 > 0, "x").alias("input_data"))
    details = _choice(cust, _DETAILS)
    symbols = F.slice(F.array(*map(F.lit, "pqrs")), 1, (cust % 4).cast("int"))
    return rows.select(
        key.alias("candidate_id"), _choice(key, _PATHS).alias("file_path"), (key % 4).alias("line_start"), (cust % 9).alias("line_end"), repro.alias("repro"), symbols.alias("symbols"), text(cust % 3 > 0, "a-b").alias("snippet"),
        (key % 3).alias("call_depth"), F.struct(F.lit("flow").alias("type"), F.lit("a value is not checked").alias("description"), details.alias("details")).alias("invariant"), text(cust % 2 == 0, "cross_module", "local").alias("scope"), _choice(cust, _CLASSES).alias("risk_class"), empty.alias("hypotheses"),
    )


@query(f"""with {_PACKAGE} select id as candidate_id, round(score, 4)::double as score, case when score < 0.4 then 'weak' when score < 0.6 then 'moderate' when score < 0.8 then 'strong' else 'very_strong' end as strength, threshold::double as threshold, array_to_string(errors, ',') as errors, array_to_string(warnings, ',') as warnings,
case when len(errors) = 0 then 'PASSED' when list_contains(errors, 'no source file') or len(errors) >= 5 or (list_contains(errors, 'no reproduction')::int + list_contains(errors, 'no symbols')::int) >= 3 then 'REJECTED' else 'RETRY' end as decision from e""")
def evidence_packages(spark, d):
    out = gates.evidence_gate(packages(spark, d))
    return out.select("candidate_id", F.round("score", 4).alias("score"), "strength", F.col("threshold").cast("double").alias("threshold"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "decision")


@query("select event_id, round(least(1.0, 0.5 + least(0.3, 0.1 * (user_id % 5)) + case when user_id % 5 > 0 and event_id % 8 <= 3 then 0.1 when user_id % 5 > 0 and event_id % 8 <= 5 then 0.05 else 0 end + case when event_type = 'error' then 0.1 else 0 end), 4)::double as confidence from events")
def hypothesis_confidence(spark, d):
    kind = F.when(F.col("event_type") == "error", "sql_injection_user_input").otherwise("other")
    return table(spark, d, "events").select("event_id", F.round(gates.hypothesis_confidence(kind, F.col("user_id") % 5, F.col("event_id") % 8), 4).alias("confidence"))


@query("""with x as (select user_id, case when event_type = 'click' and event_id % 7 = 0 then null when event_type = 'click' then 0.7 * least(1.0, 0.5 + 0.1 * least(event_id % 7, 5)) when event_type = 'view' then 0.6 * case when event_id % 2 = 0 then 0.7 else 0.5 end when value > 50 then 0.9 end as pos, case when event_type not in ('click', 'view') and value <= 50 then 0.35 end as neg from events)
select user_id, count(pos) + count(neg) as items, round(coalesce(sum(pos), 0) + 1e-7, 4)::double as positive, round(coalesce(sum(neg), 0) + 1e-7, 4)::double as negative, coalesce(sum(pos) >= 0.25, false) as confirmed from x group by 1""")
def path_evidence(spark, d):
    """Evidence of each candidate's paths; confirmed from .25 on."""
    t, i = F.col("event_type"), F.col("event_id")
    kind = F.when(t == "click", "call").when(t == "view", "block").otherwise("flow")
    ev = gates.path_evidence(kind, F.when(t == "click", i % 7).otherwise(F.lit(1)), F.col("value") > 50, F.lit(False), i % 2 == 0)
    items = table(spark, d, "events").select("user_id", ev.alias("e"))
    part = lambda s: F.sum(F.when(F.col("e.sign") == s, F.col("e.weight") * F.col("e.quality")))
    out = items.groupBy("user_id").agg(F.count("e").alias("items"), part(1).alias("p"), part(-1).alias("n"))
    return out.select("user_id", "items", F.round(F.coalesce("p", F.lit(0.0)) + 1e-7, 4).alias("positive"), F.round(F.coalesce("n", F.lit(0.0)) + 1e-7, 4).alias("negative"), F.coalesce(F.col("p") >= 0.25, F.lit(False)).alias("confirmed"))


_F = "[l_discount::double * 5, l_tax::double * 10, l_linenumber / 7, case when l_returnflag = 'A' then 0 else 0.5 end::double]"


@query(f"with f as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, {_F} as f from lineitem), g as (select *, round(sqrt(list_aggregate(f, 'var_pop')), 8) as s from f) select l_orderkey, round(avg(least(1.0, 1 - len(list_filter(f, lambda x: x = 0)) / 4 + case when s > 0.1 and s < 0.5 then 0.1 else 0 end)) + 1e-7, 3) as confidence from g group by 1")
def feature_confidence(spark, d):
    f = F.array(F.col("l_discount").cast("double") * 5, F.col("l_tax").cast("double") * 10, F.col("l_linenumber") / 7, F.when(F.col("l_returnflag") == "A", 0.0).otherwise(0.5))
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.avg(gates.estimate(f)) + 1e-7, 3).alias("confidence"))


@query("select event_id, case when abs(value - user_id) < 10 then 0.95 when abs(value - user_id) < 20 then 0.85 when abs(value - user_id) < 30 then 0.7 else 0.5 end::double as confidence from events")
def agreement_confidence(spark, d):
    return table(spark, d, "events").select("event_id", gates.agreement(F.col("value"), F.col("user_id")).alias("confidence"))


_BUGS = ["sql_injection", "auth bypass", "race condition", "null value", "memory"]


@query(f"""with e as (select l_orderkey as id, list(case l_returnflag when 'A' then 3 when 'R' then 4 else 1 end) as s, count(distinct l_partkey) as n from lineitem group by 1),
c as (select o_orderkey as id, {_BUGS}[o_orderkey % 5 + 1] as bug, case when o_orderkey % 9 = 0 then 'cross_module' when coalesce(n, 0) * 3 > 10 then 'system' when coalesce(n, 0) * 3 > 5 then 'module' else 'local' end as scope, coalesce(list_max(s), 2) as top from orders left join e on id = o_orderkey)
select id, scope, ['low', 'medium', 'high', 'critical'][top] as risk_class, case when contains(bug, 'injection') or contains(bug, 'bypass') then 'HIGH' when contains(bug, 'race') then 'MEDIUM' when scope = 'local' then 'LOW' else 'MEDIUM' end as exploitability, case scope when 'system' then 'system' when 'cross_module' then 'modules' when 'module' then 'module' else 'function' end as blast_radius, [2.5, 5.0, 7.5, 9.0][top]::double as cvss from c""")
def risk_assessment(spark, d):
    sev = F.when(F.col("l_returnflag") == "A", "high").when(F.col("l_returnflag") == "R", "critical").otherwise("low")
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_set(sev).alias("s"), F.countDistinct("l_partkey").alias("n"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id")).join(per, "id", "left")
    rows = rows.withColumn("scope", gates.scope(F.col("id") % 9 == 0, F.coalesce("n", F.lit(0)) * 3))
    return rows.select("id", "scope", gates.risk(F.coalesce("s", F.array().cast("array<string>")), F.lit("medium"), _choice(F.col("id"), _BUGS), F.col("scope")).alias("r")).select("id", "scope", "r.*")


@query("select o_orderkey, unnest(range(1, len(h) + 1))::int as seq, unnest(h) as hypothesis from (select o_orderkey, case o_orderkey % 5 when 0 then " + " when 1 then ".join(str(h[1]) for h in gates.HYPOTHESES[:2]) + f" when 2 then {gates.HYPOTHESES[2][1]} else {gates.HYPOTHESES[3][1]} end as h from orders)")
def hypothesis_templates(spark, d):
    """Hypotheses by the type of the fault: a constant lookup."""
    rows = table(spark, d, "orders").select("o_orderkey", F.posexplode(gates.hypotheses(_choice(F.col("o_orderkey"), _BUGS))).alias("p", "hypothesis"))
    return rows.select("o_orderkey", (F.col("p") + 1).alias("seq"), "hypothesis")


_DIFF = """d as (select l_orderkey as id, string_agg('--- a/src/p' || l_partkey || '.py' || chr(10) || '+++ ' || case when l_linenumber = 7 then '/dev/null' else 'b/src/p' || l_partkey || '.py' end || chr(10) || repeat('+x = 1' || chr(10), l_quantity::bigint) || '-y' || chr(10)
 || case when l_returnflag = 'R' and l_linenumber = 1 then '+os.system(q)' || chr(10) || '+import socket' || chr(10) else '' end || case when l_tax > 0.07 then '+[dependencies]' || chr(10) || '+left = "1"' || chr(10) else '' end, '' order by l_linenumber, l_partkey, l_suppkey, l_quantity) as diff from lineitem group by 1)"""


def _diffs(spark, d):
    part = F.concat(F.lit("p"), F.col("l_partkey").cast("string"), F.lit(".py"))
    new = F.when(F.col("l_linenumber") == 7, "/dev/null").otherwise(F.concat(F.lit("b/src/"), part))
    text = F.concat(
        F.lit("--- a/src/"), part, F.lit("\n+++ "), new, F.lit("\n"), F.repeat(F.lit("+x = 1\n"), F.col("l_quantity").cast("int")), F.lit("-y\n"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1), "+os.system(q)\n+import socket\n").otherwise(""), F.when(F.col("l_tax") > 0.07, '+[dependencies]\n+left = "1"\n').otherwise(""),
    )
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", text.alias("t"))
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(item)).alias("i"))  # an order's lines
    return per.select("id", F.array_join(F.transform("i", lambda x: x["t"]), "").alias("diff"))


_DIFF_COUNTS = """n as (select l_orderkey as id, count(distinct l_partkey) as files, (sum(l_quantity::bigint) + count(*) + 2 * count(*) filter (l_returnflag = 'R' and l_linenumber = 1) + 2 * count(*) filter (l_tax > 0.07))::bigint as lines, count(*) filter (l_returnflag = 'R' and l_linenumber = 1) as bad, count(*) filter (l_tax > 0.07) as deps from lineitem group by 1)"""


@query(f"""with {_DIFF_COUNTS} select id, files::int as files, lines::int as lines, array_to_string(list_filter([case when files > 3 then 'max_files_touched:block' end, case when lines > 320 then 'max_lines_changed:block' end, case when lines > 160 and lines <= 320 then 'max_lines_changed:error' end, case when bad > 0 then 'forbidden_imports:block' end, case when deps > 0 then 'no_new_dependencies:error' end], lambda x: x is not null), ',') as violations from n""")
def patch_policy(spark, d):
    """The first gate on diffs made of each order's lines; the SQL counts the lines."""
    out = gates.policy(_diffs(spark, d))
    return out.select("id", F.size(gates.touched(F.col("diff"))).alias("files"), gates.changed_lines(F.col("diff")).alias("lines"), F.array_join(F.transform("violations", lambda v: F.concat_ws(":", v["rule"], v["severity"])), ",").alias("violations"))


@query(f"with {_DIFF_COUNTS} select id, x.danger as danger, x.line as line, n from (select id, bad as n, unnest([{{'danger': 'System call', 'line': '+os.system(q)'}}, {{'danger': 'Network access', 'line': '+import socket'}}]) as x from n where bad > 0)")
def patch_dangers(spark, d):
    rows = _diffs(spark, d).select("id", F.explode(gates.dangers(F.col("diff"))).alias("x"))
    return rows.groupBy("id", "x.danger", "x.line").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {_DIFF_COUNTS} select id, case when bad > 0 then 'os.system' else '' end as forbidden, case when deps > 0 then 'left' else '' end as packages from n")
def patch_imports(spark, d):
    """Forbidden names and new packages of each diff (the lines ``x = 1`` under a
    manifest are packages to the rule, so they are left out here)."""
    rows = _diffs(spark, d).select("id", F.regexp_replace("diff", r"(?m)^\+x = 1\n", "").alias("diff"))
    return rows.select("id", F.array_join(gates.forbidden(F.col("diff")), ",").alias("forbidden"), F.array_join(gates.new_packages(F.col("diff")), ",").alias("packages"))


@query("""with b as (select o_orderkey as id, list_filter([case when o_orderpriority = '1-URGENT' then 'removed:error' end, case when o_orderstatus = 'P' then 'security:critical' end, case when (o_custkey % 100) / 100 < 0.3 then 'confidence:error' end], lambda x: x is not null) as b from orders) select id, array_to_string(b, ',') as breaking, len(b) = 0 as passed from b""")
def second_gate(spark, d):
    """Breaking changes after a patch: of the graph, of flows that touch security, and a
    verifier's confidence under .3."""
    o = table(spark, d, "orders")
    tests = [("removed:error", F.col("o_orderpriority") == "1-URGENT"), ("security:critical", F.col("o_orderstatus") == "P"), ("confidence:error", (F.col("o_custkey") % 100) / 100 < 0.3)]
    b = F.filter(F.array(*[F.when(t, n) for n, t in tests]), lambda x: x.isNotNull())
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(b, ",").alias("breaking"), (F.size(b) == 0).alias("passed"))


_CONDITIONS = ["not True and x", "True and y", "False or z", "not False or False and w", "a or b"]


@query(f"select o_orderkey, trim(replace(replace(replace(replace(replace(replace({_CONDITIONS}[o_orderkey % 5 + 1], 'not True', 'False'), 'not False', 'True'), 'True and', ''), 'False or', ''), 'True or', 'True'), 'False and', 'False'), ' ') as condition from orders")
def simpler_conditions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", gates.simplified(_choice(F.col("o_orderkey"), _CONDITIONS)).alias("condition"))


_ANY = " or ".join(f"contains(lower(p_name || ' ' || p_type), '{w}')" for w in gates.SECURITY_WORDS)


@query(f"select p_partkey, ({_ANY}) as relevant from part")
def security_flows(spark, d):
    return table(spark, d, "part").select("p_partkey", gates.touches_security(F.col("p_name"), F.col("p_type")).alias("relevant"))


def _attack_sql(name, quoted, patterns):
    rule = "|".join(f"(?:{p})" for p in patterns).replace("'", "''")
    joined = "or (contains(t, '+') and contains(lower(t), 'sql'))" if quoted else ""
    line = f"list_filter(list_zip(range(1, len(l) + 1), l), lambda x: regexp_matches(x[2], '(?i){rule}'))"
    return f"case when regexp_matches(t, '(?i){rule}') {joined} then {{'attack': '{name}', 'evidence': case when len({line}) > 0 then 'Line ' || {line}[1][1] || ': ' || substr(trim({line}[1][2], ' '), 1, 100) else '' end}} end"


_TESTED = ["x = os.system(a)", "id = kwargs['id']", "if user == admin", "e.innerHTML = q", "get('http://{h}')", "s = 'sql ' + q", "return 1"]
_TESTED_SQL = "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in _TESTED) + "]"


@query(f"""with t0 as (select o_orderkey as id, 'def f():' || chr(10) || {_TESTED_SQL}[o_orderkey % 7 + 1] as t from orders), t as (select *, string_split(t, chr(10)) as l from t0),
a as (select id, t, unnest(list_filter([{", ".join(_attack_sql(*a) for a in gates.ATTACKS)}], lambda x: x is not null)) as a from t)
select id, a.attack as attack, a.evidence as evidence, case when contains(lower(t), 'eval') or contains(lower(t), 'exec') or contains(lower(t), 'system') or contains(lower(t), 'raw') then 'CRITICAL' when contains(lower(t), 'execute') or contains(lower(t), 'query') or contains(lower(t), 'open') or contains(lower(t), 'request') then 'HIGH' else 'MEDIUM' end as severity from a""")
def attack_scenarios(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("def f():\n"), _choice(F.col("o_orderkey"), _TESTED)).alias("text"))
    return gates.attacks(rows).select("id", F.inline("attacks"))


_VOTES = """v as (select date_trunc('hour', ts) as context, event_id as seq, user_id % 5 as model, event_type as fix, round(least(1.0, 0.5 + value / 100), 6) as confidence, 1 + (user_id % 5) / 10 as weight, 0.5 + (user_id % 5) / 10 as success from events where event_type <> 'signup'),
w as (select *, confidence * weight * (0.5 + 0.5 * success) as score, count(*) over (partition by context) as total, count(*) over (partition by context, fix) as n, min(seq) over (partition by context, fix) as first from v where confidence >= 0.7),
g as (select *, row_number() over (partition by context order by n desc, first, confidence desc, seq) as r1, row_number() over (partition by context order by score desc, seq) as r2, row_number() over (partition by context order by confidence desc, seq) as r3 from w),
r as (select context, total, 'majority' as asked, 'majority' as strategy, model, confidence, round(n / total, 4) as agreement from g where r1 = 1 union all select context, total, 'weighted', 'weighted', model, confidence, round(n / total, 4) from g where r2 = 1 union all select context, total, 'confidence', 'confidence', model, confidence, round(n / total, 4) from g where r3 = 1
 union all select context, total, 'consensus', 'consensus', model, confidence, round(n / total, 4) from g where r1 = 1 and n >= 0.75 * total union all select a.context, a.total, 'consensus', 'weighted', a.model, a.confidence, round(a.n / a.total, 4) from g a join g b on a.context = b.context and b.r1 = 1 and b.n < 0.75 * b.total where a.r2 = 1)"""


@query(f"with {_VOTES} select context, total, asked, strategy, model, round(confidence, 4) as confidence, agreement, agreement >= 0.75 as consensus from r")
def vote_strategies(spark, d):
    """Four strategies on the votes of each hour; a vote under .7 does not count."""
    m = F.col("user_id") % 5
    v = table(spark, d, "events").where("event_type <> 'signup'").select(F.date_trunc("hour", "ts").alias("context"), F.col("event_id").alias("seq"), m.alias("model"), F.col("event_type").alias("fix"), F.round(F.least(F.lit(1.0), F.col("value") / 100 + 0.5), 6).alias("confidence"), (m / 10 + 1).alias("weight"), (m / 10 + 0.5).alias("success"))
    return gates.vote(v, "context").withColumn("confidence", F.round("confidence", 4))


@query("with r as (select event_id, row_number() over (partition by user_id, event_type order by ts, event_id) > 1 as replayed, first_value(event_id) over (partition by user_id, event_type order by ts, event_id) as source from events) select * from r")
def vote_cache(spark, d):
    """The first result of a context is replayed for the later ones."""
    e = table(spark, d, "events").withColumn("key", F.concat_ws("|", "user_id", "event_type"))
    out = gates.first_results(e, "key", [F.col("ts"), F.col("event_id")])
    first = F.first("event_id").over(Window.partitionBy("key").orderBy("ts", "event_id"))
    return out.select("event_id", "replayed", first.alias("source"))


@query("""with x as (select user_id, event_id, ts, event_type = 'error' as f, row_number() over (partition by user_id order by ts, event_id) as n from events), r as (select *, n - sum(f::int) over (partition by user_id order by n) as g from x),
k as (select user_id, g, count(*) filter (f) as stalled from r group by 1, 2), u as (select user_id, max(stalled) as stalled, sum(case when stalled > 0 then 1 else 0 end) as runs from k group by 1)
select user_id, stalled, (case when stalled >= 3 or runs >= 10 then least(user_id % 4 + 2, 4) else user_id % 4 + 1 end)::int as level from u""")
def escalation_levels(spark, d):
    """Ten runs of failures, or three failures in a row, raise a candidate's level."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    x = table(spark, d, "events").select("user_id", (F.col("event_type") == "error").cast("int").alias("f"), F.row_number().over(w).alias("n"), F.sum((F.col("event_type") == "error").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    k = x.groupBy("user_id", (F.col("n") - F.col("c")).alias("g")).agg(F.sum("f").alias("stalled"))
    u = k.groupBy("user_id").agg(F.max("stalled").alias("stalled"), F.count_if(F.col("stalled") > 0).alias("runs"))
    return u.select("user_id", "stalled", gates.escalation(F.col("runs"), F.col("stalled"), F.col("user_id") % 4 + 1).cast("int").alias("level"))


_WEIGHT = {"critical": 1.0, "high": 0.8, "medium": 0.5, "low": 0.2}


@query(f"""with c as (select event_id, user_id, epoch(ts)::bigint // 3600 as line, {_SEV_SQL} as sev from events where event_type <> 'click'), h as (select user_id, epoch(ts)::bigint // 3600 as line, case when value > 80 then 15 when value > 40 then 10 else 5 end as points from events where event_type = 'click'),
b as (select c.event_id, sum(points) as points from c join h on c.user_id = h.user_id and abs(c.line - h.line) <= 5 group by 1)
select event_id, round(least(100.0, 40 * case sev when 'critical' then 1.0 when 'high' then 0.8 when 'low' then 0.2 else 0.5 end + coalesce(points, 0) + case when user_id % 10 = 0 then 15 when user_id % 10 = 5 then 10 else 0 end), 4)::double as score from c left join b using (event_id)""")
def static_scores(spark, d):
    """Severity, the hits at most five lines away (hours here), and the bug type; a band
    join for the hits, at most 100."""
    e = table(spark, d, "events").withColumn("line", F.floor(_seconds() / 3600)).withColumn("sev", _severity())
    c, h = e.where("event_type <> 'click'"), e.where("event_type = 'click'")
    points = F.when(F.col("value") > 80, 15).when(F.col("value") > 40, 10).otherwise(5)
    near = findings.band_join(c.select("event_id", "user_id", "line"), h.select("user_id", F.col("line").alias("at"), points.alias("points")), "user_id", "line", "at", 5)
    sums = near.groupBy("event_id").agg(F.sum("points").alias("points"))
    weight = F.lit(0.5)
    for k, v in _WEIGHT.items():
        weight = F.when(F.col("sev") == k, v).otherwise(weight)
    bonus = F.when(F.col("user_id") % 10 == 0, 15).when(F.col("user_id") % 10 == 5, 10).otherwise(0)
    score = F.least(F.lit(100.0), weight * 40 + F.coalesce("points", F.lit(0)) + bonus)
    return c.join(sums, "event_id", "left").select("event_id", F.round(score, 4).alias("score"))
