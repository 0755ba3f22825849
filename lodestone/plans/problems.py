"""Queries on problem texts, sub-problems, solutions and their stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import code, problems, rules
from ..sources.tables import scratch, table, written
from .catalogue import _COMPLEX, _LINES, _RULES_SQL, _SEV_SQL, _severity, query


def _any(words, low="lower(text)"):
    return "(" + " or ".join(f"contains({low}, '{w}')" for w in words) + ")"


def _ladder(steps, last, low="lower(text)"):
    return "case " + " ".join(f"when {_any(words, low)} then '{name}'" for name, words in steps) + f" else '{last}' end"


_BY_TYPE = "case kind " + " ".join(f"when '{k}' then '{v}'" for k, v in problems.SEVERITY_OF.items()) + " else 'medium' end"
_SEVERE = "case " + " ".join(f"when {_any(words)} then '{name}'" for name, words in problems.SEVERITY_WORDS) + f" else {_BY_TYPE} end"
_TAGS = "array_to_string(list_sort(list_filter([" + ", ".join(f"case when {_any(words)} then '{c}' end" for c, words in problems.COMPONENTS.items()) + "], lambda x: x is not null)), ',')"
def _low():
    return F.lower("text")



def _turns(spark, d):
    return table(spark, d, "conversations")


@query(f"with t as (select *, {_ladder(problems.TYPES, 'unknown')} as kind from conversations) select conv_id, turn, kind, {_SEVERE} as severity, {_TAGS} as components from t")
def problem_intake(spark, d):
    """Type, severity and components of each text, all by words."""
    kind = problems.first_fit(_low(), problems.TYPES, "unknown")
    return _turns(spark, d).withColumn("kind", kind).select("conv_id", "turn", "kind", problems.severity(_low(), F.col("kind")).alias("severity"), F.array_join(problems.components(_low()), ",").alias("components"))


_MATCHES = ", ".join(f"{{'kind': '{k}', 'matches': {' + '.join(f'contains(lower(text), {w!r})::int' for w in words)}, 'size': {len(words)}}}" for k, words in problems.CATALOG.items())
_SCORES = f"s as (select conv_id, turn, x.kind as kind, x.matches::int as matches, (x.matches / x.size)::double as score from (select conv_id, turn, unnest([{_MATCHES}]) as x from conversations))"


def _scores(spark, d):
    return _turns(spark, d).select("conv_id", "turn", F.inline(problems.scores(_low())))


@query(f"with {_SCORES} select conv_id, turn, kind, matches, round(score, 4) as score from s where matches > 0")
def problem_scores(spark, d):
    return _scores(spark, d).where("matches > 0").withColumn("score", F.round("score", 4))


@query(f"""with {_SCORES}, r as (select *, row_number() over (partition by conv_id, turn order by score desc, kind) as rank, sum(matches) over (partition by conv_id, turn) as total from s)
select conv_id, turn, rank::int as rank, kind, round(score, 2) as confidence, round(least(least(0.3 + 0.05 * total, 0.7) + 0.1 * 1, 0.95), 2)::double as overall from r where rank between 2 and 4""")
def problem_alternatives(spark, d):
    """Ranks 2 to 4 of the types, with the confidence of the whole (one indicator)."""
    w = Window.partitionBy("conv_id", "turn")
    ranked = _scores(spark, d).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "kind"))).withColumn("total", F.sum("matches").over(w))
    out = ranked.where("rank between 2 and 4")
    return out.select("conv_id", "turn", "rank", "kind", F.round("score", 2).alias("confidence"), problems.problem_confidence(F.col("total"), F.lit(1)).alias("overall"))


@query(f"select conv_id, turn, {_ladder(problems.SUBTYPES, 'technical')} as subtype, {_ladder(problems.SOLUTIONS, 'unknown')} as solution, {_ladder(problems.BUG_SEVERITY, 'low')} as severity, case when {_any(['injection', 'xss', 'csrf', 'auth', 'security'])} then 'vulnerability' when {_any(['performance', 'optimize', 'fast'])} then 'optimization' when {_any(['best practice', 'convention', 'standard'])} then 'best_practice' else 'fix' end as pattern from conversations")
def text_types(spark, d):
    """Types of sub-problems, solutions and patterns, and the severity of a pattern."""
    pattern = problems.first_fit(_low(), [("vulnerability", ["injection", "xss", "csrf", "auth", "security"]), ("optimization", ["performance", "optimize", "fast"]), ("best_practice", ["best practice", "convention", "standard"])], "fix")
    kinds = [problems.first_fit(_low(), t, last) for t, last in ((problems.SUBTYPES, "technical"), (problems.SOLUTIONS, "unknown"), (problems.BUG_SEVERITY, "low"))]
    return _turns(spark, d).select("conv_id", "turn", *[k.alias(n) for k, n in zip(kinds, ("subtype", "solution", "severity"), strict=True)], pattern.alias("pattern"))


_WORDS = ["und", "the", "de", "la", "ui", "not", "api"]


@query(f"""with h as (select doc_id, list_filter([{", ".join(f"trim(list_filter(string_split(text, '.'), lambda s: contains(lower(s), '{w}'))[1], ' ') || '.'" for w in _WORDS)}], lambda x: x is not null)[1:5] as h from documents)
select doc_id, unnest(range(1, len(h) + 1))::int as seq, md5(unnest(h)) as sentence from h""")
def evidence_sentences(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(problems.evidence_sentences(F.col("text"), _WORDS)).alias("p", "s"))
    return rows.select("doc_id", (F.col("p") + 1).alias("seq"), F.md5("s").alias("sentence"))


@query("""with t as (select page_id, lower(html) as t from pages), b as (select *, length(t) - length(replace(t, chr(10), '')) as breaks, (length(t) - length(replace(t, '    ', ''))) / 4 as steps from t),
f as (select page_id, unnest(list_filter([case when contains(t, 'while true') or contains(t, 'sleep') or contains(t, 'timeout') or contains(t, 'lock') then {'indicator': 'performance_risk', 'weight': 0.5::double} end,
 case when contains(t, 'try:') and not contains(t, 'except') then {'indicator': 'error_handling_gap', 'weight': 0.3::double} end, case when breaks > 0 and floor(steps / nullif(breaks, 0)) > 4 then {'indicator': 'complexity_high', 'weight': 0.4::double} end], lambda x: x is not null)) as x from b) select page_id, x.indicator as indicator, x.weight as weight from f""")
def code_indicators(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(problems.code_indicators(F.lower("html"))).alias("indicator", "weight"))


_KIND = "case when user_id % 2 = 0 then 'security' else 'general' end"


@query(f"with t as (select event_id, {_KIND} as kind, case when value > 150 then 'ERROR' else upper({_SEV_SQL}) end as sev from events) select event_id, case when kind = 'security' and sev = 'CRITICAL' then 1 when kind = 'security' and sev = 'HIGH' then 2 when kind = 'security' and sev = 'MEDIUM' then 3 when sev = 'ERROR' then 2 when sev = 'HIGH' then 3 when sev = 'MEDIUM' then 4 else 5 end as priority from t")
def issue_priority(spark, d):
    sev = F.when(F.col("value") > 150, "ERROR").otherwise(F.upper(_severity()))
    return table(spark, d, "events").select("event_id", problems.issue_priority(F.when(F.col("user_id") % 2 == 0, "security").otherwise("general"), sev).alias("priority"))


@query(f"""with {_LINES}, h as (select doc_id, sum(len(list_filter([{_RULES_SQL}], lambda x: x is not null)))::bigint as hits from l group by 1), {_COMPLEX}, k as (select user_id as doc_id, count(*) as churn from events group by 1)
select doc_id, case when hits > 0 then 'semgrep_security' when cc >= 15 then 'high_complexity' when cc >= 10 then 'medium_complexity' when churn >= 10 then 'high_churn' when churn >= 5 then 'medium_churn' when contains(source, 'db') then 'database_critical' else 'code_quality' end as bug_type from documents join m using (doc_id) left join h using (doc_id) left join k using (doc_id)""")
def bug_types(spark, d):
    """The bug type of each file by rule hits, complexity, churn and its path."""
    docs = rules.line_counts(table(spark, d, "documents"))
    per = code.complexity(docs.select(F.struct("doc_id", "source", "hits").alias("doc_id"), "text")).select("doc_id.*", "cc")
    churn = table(spark, d, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("churn"))
    return per.join(churn, "doc_id", "left").select("doc_id", problems.bug_type(F.col("hits"), F.col("cc"), F.col("churn"), F.col("source")).alias("bug_type"))


_PLAN_ROWS = ", ".join(f"('{k}', {i}, '{s}')" for k, steps in problems.PLANS.items() for i, s in enumerate(steps, 1))


@query(f"with t as (select conv_id, turn, {_ladder(problems.TYPES, 'unknown')} as kind from conversations), k as (select conv_id, turn, case when kind in {tuple(problems.PLANS)} then kind else 'unknown' end as kind from t) select conv_id, turn, seq::int as seq, step, lag(step) over (partition by conv_id, turn order by seq) as needs from k join (values {_PLAN_ROWS}) p(kind, seq, step) using (kind)")
def problem_plan(spark, d):
    """The steps of each problem by its type, each needing the one before: a constant
    lookup, nothing is shuffled."""
    kind = problems.first_fit(_low(), problems.TYPES, "unknown")
    plan = None
    for k, steps in reversed(problems.PLANS.items()):
        own = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(s).alias("step"), F.lit(steps[i - 2] if i > 1 else None).cast("string").alias("needs")) for i, s in enumerate(steps, 1)])
        plan = own if plan is None else F.when(kind == k, own).otherwise(plan)
    return _turns(spark, d).select("conv_id", "turn", F.inline(plan))


@query("select o_orderkey, o_orderdate from orders where o_orderstatus = 'O' and o_orderpriority = '1-URGENT' order by o_orderdate desc, o_orderkey")
def problem_filter(spark, d):
    """Problems of a status and type, the last changed first."""
    rows = table(spark, d, "orders").withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "kind"})
    return problems.filtered(rows, [F.desc("o_orderdate"), F.col("o_orderkey")], status="O", kind="1-URGENT").select("o_orderkey", "o_orderdate")


_CATEGORY = ["security", "runtime", "correctness", "performance", "code_quality"]


@query(f"with t as (select event_id, {_SEV_SQL} as s, {_CATEGORY}[user_id % 5 + 1] as c from events) select event_id, s in ('critical', 'high') and c in ('security', 'runtime') as exploit_ready, c in ('correctness', 'performance', 'code_quality') as refactorable from t")
def finding_roles(spark, d):
    """Findings that can be exploited, and those that a refactoring can mend."""
    category = F.element_at(F.array(*map(F.lit, _CATEGORY)), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", (_severity().isin("critical", "high") & category.isin("security", "runtime")).alias("exploit_ready"), category.isin("correctness", "performance", "code_quality").alias("refactorable"))


@query("select l_orderkey, count(*) filter (l_linenumber = 1) as roots, count(*) filter (l_returnflag = 'R') as blocking, coalesce(string_agg(l_partkey::varchar, ',' order by l_linenumber, l_partkey) filter (l_returnflag = 'R'), '') as parts from lineitem group by 1")
def root_causes(spark, d):
    """Root and blocking causes, picked from each problem's array of causes."""
    cause = F.struct("l_linenumber", "l_partkey", "l_returnflag")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(cause)).alias("c"))
    blocking = F.filter("c", lambda x: x["l_returnflag"] == "R")
    return rows.select("l_orderkey", F.size(F.filter("c", lambda x: x["l_linenumber"] == 1)).cast("long").alias("roots"), F.size(blocking).cast("long").alias("blocking"), F.array_join(F.transform(blocking, lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


_RISKS = ["low", "medium", "high", "critical"]
_PATHS = f"p as (select p_partkey, p_brand, p_size % 10 + 1 as eff, p_size % 7 + 1 as inv, {_RISKS}[p_partkey % 4 + 1] as risk, p_partkey % 10 + 1 as effort, p_size % 5 + 3 as test from part), q as (select *, greatest(0.0::double, least(10.0::double, (eff + test) / 2 - (inv + case risk when 'low' then 2 when 'medium' then 5 when 'high' then 8 else 10 end + effort) / 3 + 5)) as score, eff >= 7 and effort <= 4 as quick_win, risk in ('high', 'critical') as high_risk from p)"


def _paths(spark, d):
    size, key = F.col("p_size"), F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", "p_brand", (size % 10 + 1).alias("eff"), (size % 7 + 1).alias("inv"), F.element_at(F.array(*map(F.lit, _RISKS)), (key % 4 + 1).cast("int")).alias("risk"), (key % 10 + 1).alias("effort"), (size % 5 + 3).alias("test"))
    score = problems.solution_score(*[F.col(c) for c in ("eff", "inv", "risk", "effort", "test")])
    return p.withColumn("score", score).withColumn("quick_win", (F.col("eff") >= 7) & (F.col("effort") <= 4)).withColumn("high_risk", F.col("risk").isin("high", "critical"))


@query(f"with {_PATHS} select p_partkey, round(score, 4) as score, quick_win, high_risk from q")
def solution_scores(spark, d):
    return _paths(spark, d).select("p_partkey", F.round("score", 4).alias("score"), "quick_win", "high_risk")


@query(f"""with {_PATHS}, g as (select p_brand, max(score) as best from q group by 1) select count(*) as paths, count(distinct p_brand) as subproblems, round(count(*) / count(distinct p_brand), 4) as per, round(avg(eff), 4) as effectiveness, round(avg(inv), 4) as invasiveness, round(avg(effort), 4) as effort, round(avg(test), 4) as testability, round(avg(score), 4) as score,
count(*) filter (quick_win) as quick_wins, count(*) filter (high_risk) as high_risk, round(100 * (select count(*) filter (best >= 9) / count(*) from g), 4) as completion from q""")
def solution_statistics(spark, d):
    """Averages over all paths, quick wins, and the share of sub-problems with a path of
    9 points (the selected ones)."""
    q = _paths(spark, d)
    mean = lambda c, n: F.round(F.avg(c), 4).alias(n)
    per = q.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("best"))
    done = per.agg(F.round(F.count_if(F.col("best") >= 9) * 100 / F.count(F.lit(1)), 4).alias("completion"))
    one = q.agg(F.count(F.lit(1)).alias("paths"), F.countDistinct("p_brand").alias("subproblems"), F.round(F.count(F.lit(1)) / F.countDistinct("p_brand"), 4).alias("per"), mean("eff", "effectiveness"), mean("inv", "invasiveness"), mean("effort", "effort"), mean("test", "testability"), mean("score", "score"), F.count_if("quick_win").alias("quick_wins"), F.count_if("high_risk").alias("high_risk"))
    return one.crossJoin(done)  # one row each


@query("""with o as (select o_orderkey as id, o_custkey, o_orderstatus as status, o_orderpriority as kind, case when o_orderkey % 3 > 0 then o_totalprice end as hours, lag(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as needs from orders),
r as (select a.*, a.status <> 'P' and (b.id is null or b.status = 'F') as ready from o a left join o b on a.needs = b.id)
select 'status' as part, status as value, count(*) as n, round(sum(coalesce(hours, 0)), 4) as hours from r group by status union all select 'type', kind, count(*), round(sum(coalesce(hours, 0)), 4) from r group by kind
union all select 'state', case when ready then 'ready' when status = 'P' then 'blocked' else 'waiting' end, count(*), round(sum(coalesce(hours, 0)), 4) from r group by 2 union all select 'all', '', count(*), round(sum(coalesce(hours, 0)), 4) from r""")
def decomposition_statistics(spark, d):
    """Sub-problems by status, type and state with their hours, and all: one pass over
    the rows, each counted under four headings."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    hours = F.coalesce(F.when(F.col("o_orderkey") % 3 > 0, F.col("o_totalprice")), F.lit(0.0))
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", hours.alias("hours"), F.lag("o_orderstatus").over(w).alias("before"))
    blocked = F.col("o_orderstatus") == "P"
    state = F.when(~blocked & (F.col("before").isNull() | (F.col("before") == "F")), "ready").when(blocked, "blocked").otherwise("waiting")
    heads = F.array(*[F.struct(F.lit(p).alias("part"), v.alias("value")) for p, v in (("status", F.col("o_orderstatus")), ("type", F.col("o_orderpriority")), ("state", state), ("all", F.lit("")))])
    return o.select("hours", F.inline(heads)).groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("hours"), 4).alias("hours"))


_CAPS = "c as (select c_mktsegment as stack, c_nationkey as capability, avg(c_acctbal) as a from customer group by 1, 2), v as (select stack, capability, case when a >= 5000 then 'full' when a >= 4000 then 'partial' when a >= 3000 then 'limited' else 'none' end as level, case when a >= 5000 then 3 when a >= 4000 then 2 when a >= 3000 then 1 else 0 end as rank from c)"


def _capabilities(spark, d):
    a = F.col("a")
    c = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("stack"), F.col("c_nationkey").alias("capability")).agg(F.avg("c_acctbal").alias("a"))
    return c.select("stack", "capability", F.when(a >= 5000, "full").when(a >= 4000, "partial").when(a >= 3000, "limited").otherwise("none").alias("level"), F.when(a >= 5000, 3).when(a >= 4000, 2).when(a >= 3000, 1).otherwise(0).alias("rank"))


@query(f"with {_CAPS} select stack, count(*) as capabilities, count(*) filter (rank > 0) as supported, round(100 * count(*) filter (rank > 0) / count(*), 4) as coverage, count(*) filter (level = 'full') as full, count(*) filter (level = 'partial') as partial, count(*) filter (level = 'limited') as limited, count(*) filter (level = 'none') as none from v group by 1")
def stack_statistics(spark, d):
    by = [F.count_if(F.col("level") == x).alias(x) for x in ("full", "partial", "limited", "none")]
    return _capabilities(spark, d).groupBy("stack").agg(F.count(F.lit(1)).alias("capabilities"), F.count_if(F.col("rank") > 0).alias("supported"), F.round(F.count_if(F.col("rank") > 0) * 100 / F.count(F.lit(1)), 4).alias("coverage"), *by)


@query(f"""with {_CAPS}, a as (select * from v where stack = 'BUILDING'), b as (select * from v where stack = 'MACHINERY') select coalesce(a.capability, b.capability) as capability, coalesce(a.level, 'none') as one, coalesce(b.level, 'none') as two,
case when coalesce(a.rank, 0) > coalesce(b.rank, 0) then 'one' when coalesce(a.rank, 0) < coalesce(b.rank, 0) then 'two' else 'equal' end as better, coalesce(a.rank, 0) - coalesce(b.rank, 0) as gap from a full join b on a.capability = b.capability""")
def capability_compare(spark, d):
    """Two profiles side by side, their levels compared by rank."""
    v = _capabilities(spark, d)
    a, b = (v.where(F.col("stack") == s).select("capability", F.col("level").alias(n), F.col("rank").alias(f"r{n}")) for s, n in (("BUILDING", "one"), ("MACHINERY", "two")))
    gap = F.coalesce("rone", F.lit(0)) - F.coalesce("rtwo", F.lit(0))
    out = a.join(b, "capability", "full_outer").withColumn("gap", gap)
    return out.select("capability", F.coalesce("one", F.lit("none")).alias("one"), F.coalesce("two", F.lit("none")).alias("two"), F.when(F.col("gap") > 0, "one").when(F.col("gap") < 0, "two").otherwise("equal").alias("better"), "gap")


@query("select case when s_nationkey % 5 > 0 then 'nation ' || s_nationkey else 'unknown' end as stack, row_number() over (partition by case when s_nationkey % 5 > 0 then 'nation ' || s_nationkey else 'unknown' end order by s_suppkey)::int as seq, s_name from supplier")
def models_by_stack(spark, d):
    """Models of each stack as numbered rows; a missing stack is ``unknown``."""
    stack = F.coalesce(F.when(F.col("s_nationkey") % 5 > 0, F.concat(F.lit("nation "), F.col("s_nationkey").cast("string"))), F.lit("unknown"))
    s = table(spark, d, "supplier").withColumn("stack", stack)
    return s.select("stack", F.row_number().over(Window.partitionBy("stack").orderBy("s_suppkey")).alias("seq"), "s_name")


@query("select count(*) as total, count(*) filter (s_acctbal > 5000) as loaded, count(*) filter (s_acctbal <= 0) as failed, round(sum(case when s_acctbal > 0 then s_acctbal else 0 end), 4) as memory from supplier")
def model_statistics(spark, d):
    b = F.col("s_acctbal")
    return table(spark, d, "supplier").agg(F.count(F.lit(1)).alias("total"), F.count_if(b > 5000).alias("loaded"), F.count_if(b <= 0).alias("failed"), F.round(F.sum(F.when(b > 0, b).otherwise(0.0)), 4).alias("memory"))


@query("with b as (select o_orderkey, (o_orderstatus = 'F')::int + (o_totalprice > 100000)::int + (o_orderpriority <> '5-LOW')::int + (o_orderdate >= timestamp '1996-01-01')::int as met from orders) select o_orderkey, case met when 4 then 'reached' when 0 then 'missed' else 'partly' end as verdict from b")
def goal_verdict(spark, d):
    """All, none or some of four criteria."""
    tests = [F.col("o_orderstatus") == "F", F.col("o_totalprice") > 100000, F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")]
    met = sum((t.cast("int") for t in tests), F.lit(0))
    return table(spark, d, "orders").select("o_orderkey", F.when(met == 4, "reached").when(met == 0, "missed").otherwise("partly").alias("verdict"))


@query("""with recursive o as (select o_custkey as plan, o_orderkey as id, substr(o_orderpriority, 1, 1)::int as priority, o_totalprice, lag(o_orderkey) over w as before, last_value(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey rows between unbounded preceding and unbounded following) as final from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
i as (select plan, id, priority, case when before is null and plan % 10 = 0 then final when before is not null and o_totalprice > 250000 then before end as need from o),
s as (select plan, list({'id': id, 'p': priority, 'need': need}) as items, count(*) as n from i group by plan),
c as (select plan, items, n, []::bigint[] as done, true as more from s union all
 select plan, items, n, case when len(ready) > 0 then list_append(done, list_sort(ready)[1].id) else done end, len(ready) > 0
 from (select *, list_transform(list_filter(items, lambda x: not list_contains(done, x.id) and (x.need is null or list_contains(done, x.need))), lambda x: {'p': x.p, 'since': coalesce(list_position(done, x.need), 0), 'id': x.id}) as ready from c where more)),
f as (select plan, done, items from c where not more),
x as (select plan, unnest(done) as id, unnest(range(1, len(done) + 1)) as position, len(done) as k from f),
r as (select plan, y.id as id, len(done) + row_number() over (partition by plan order by y.p, y.id) as position from (select plan, done, unnest(items) as y from f) where not list_contains(done, y.id))
select plan, id, position::int as position from x union all select plan, id, position::int from r""")
def execution_order(spark, d):
    """The order of each customer's orders: an order needs the one before where it is
    dear, and every tenth customer's first needs the last (a cycle)."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("plan"), F.col("o_orderkey").alias("id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), "o_totalprice", F.lag("o_orderkey").over(w).alias("before"), F.last("o_orderkey").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))
    needs = F.when(F.col("before").isNull() & (F.col("plan") % 10 == 0), F.array("last")).when(F.col("before").isNotNull() & (F.col("o_totalprice") > 250000), F.array("before")).otherwise(F.array().cast("array<bigint>"))
    return problems.execution_order(o.select("plan", "id", "priority", needs.alias("needs")))


@query("select o_orderkey as id, case when o_orderpriority = '1-URGENT' then 'done' else o_orderstatus end as status, o_orderpriority as kind, case when o_orderpriority = '1-URGENT' then '2002-01-01' else o_orderdate::date::varchar end as updated from orders where o_orderstatus <> 'P'")
def problem_store(spark, d):
    """Problems saved as JSON documents, loaded, some fields updated, some deleted."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("kind"), F.to_date("o_orderdate").cast("string").alias("updated"))
    path = scratch(spark, "problems")
    rows.write.json(path)
    old = spark.read.schema(rows.schema).json(path)
    new = written(old.where("kind = '1-URGENT'").select("id", F.lit("done").alias("n_status"), F.lit(None).cast("string").alias("n_kind")), "updates")
    out = old.join(new.withColumn("hit", F.lit(True)), "id", "left").join(old.where("status = 'P'").select("id"), "id", "left_anti")
    return out.select("id", F.coalesce("n_status", "status").alias("status"), F.coalesce("n_kind", "kind").alias("kind"), F.when(F.col("hit"), "2002-01-01").otherwise(F.col("updated")).alias("updated"))
