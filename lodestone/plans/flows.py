"""Queries on data flow and taints: programs are made from the columns of tables, and the
SQL derives from the columns what they do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dataflow, lexer, structure
from ..sources.tables import table
from .catalogue import query

_ITEMS = """i as (select l_orderkey as k, l_orderkey % 2 = 0 as lp, l_returnflag as r, case l_orderkey % 2 when 0 then 3 else 2 end + coalesce(sum(case l_returnflag when 'R' then 2 else 1 end) over (partition by l_orderkey order by l_linenumber, l_returnflag rows between unbounded preceding and 1 preceding), 0) as pos from lineitem),
d as (select k, lp, case r when 'R' then pos + 1 else pos end as line, r = 'A' as whole from i where r <> 'N'),
o as (select k, any_value(lp) as lp, max(pos + case r when 'R' then 2 else 1 end) as last from i group by k),
a as (select k, max(line) as line from d where whole group by k),
s as (select k, 1 as line from o union select d.k, d.line from d left join a using (k) where lp and d.line >= coalesce(a.line, 0)),
u as (select k, pos as line, false as ends from i where r = 'N' union all select k, last, true from o),
e as (select k, line, whole, false as used, false as ends from d union all select k, line, false, true, ends from u),
b as (select * from (select *, max(case when whole then line end) over (partition by k order by line rows between unbounded preceding and 1 preceding) as since from e) where used),
v as (select b.k, d.line as def_line, b.line as use_line from b join d on d.k = b.k and d.line < b.line and d.line >= coalesce(b.since, 0) join o on o.k = b.k where not (b.ends and o.lp)
 union select b.k, s.line, b.line from b join s using (k) join o on o.k = b.k where b.since is null or (b.ends and o.lp))"""


def _order_programs(spark, d):
    """A function for each order, in a loop if its key is even: a line item sets ``v``
    (A), sets it on a condition (R) or uses it (N)."""
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("items"))
    loop = F.col("k") % 2 == 0
    pad = F.when(loop, "        ").otherwise("    ")
    line = lambda x: F.when(x["l_returnflag"] == "A", F.concat(pad, F.lit("v = 1\n"))).when(x["l_returnflag"] == "R", F.concat(pad, F.lit("if c:\n"), pad, F.lit("    v = 2\n"))).otherwise(F.concat(pad, F.lit("use(v)\n")))
    head = F.concat(F.lit("def f(v, c):\n"), F.when(loop, "    while c:\n").otherwise(""))
    return items.select(F.col("k").cast("string").alias("path"), F.concat(head, F.array_join(F.transform("items", line), ""), F.lit("    return v\n")).alias("text"))


@query(f"""with {_ITEMS} select k::varchar as path, 'v' as name, def_line::int as def_line, use_line::int as use_line from v
union all select k::varchar, 'c', 1, pos::int from i where r = 'R' union all select k::varchar, 'c', 1, 2 from o where lp""")
def reaching_definitions(spark, d):
    """Every definition that reaches each use, in branches and loops."""
    return dataflow.reaching_definitions(_order_programs(spark, d)).drop("function")


_CHAIN = """c as (select s_suppkey as k, s_nationkey % 4 + 1 as deep, 0 as i, 1 as length, false as safe from supplier
 union all select k, deep, i + 1, length + case when i + 1 = deep then 2 else 3 end, safe or (i + 1 < deep and (k + i + 1) % 3 = 0) from c where i < deep)"""


def _chains(spark, d):
    """A file for each supplier: a source whose value goes down through as many functions as
    its nation says, some of which clean it; the last calls itself and a sink.  Every
    third file also has a sink for what comes back up."""
    s, key = table(spark, d, "supplier"), F.col("s_suppkey")
    deep = (F.col("s_nationkey") % 4 + 1).cast("int")
    name = lambda i: F.concat(F.lit("f"), i.cast("string"))
    middle = lambda i: F.concat(F.lit("def "), name(i), F.lit("(a):\n    b = "), F.when((key + i) % 3 == 0, F.lit("m.clean(a)")).otherwise(F.lit("a")), F.lit("\n    return "), name(i + 1), F.lit("(b)\n"))
    body = F.array_join(F.transform(F.when(deep > 1, F.sequence(F.lit(1), deep - 1)).otherwise(F.array().cast("array<int>")), middle), "")
    last = F.concat(F.lit("def "), name(deep), F.lit("(a):\n    if a:\n        "), name(deep), F.lit("(a)\n    eval(a)\n    return 1\n"))
    up = F.when(key % 3 == 0, "def get():\n    return input()\ndef show():\n    q = get()\n    os.system(q)\n").otherwise("")
    return s.select(F.concat(key.cast("string"), F.lit("/m.py")).alias("path"), F.concat(F.lit("def f0():\n    x = input()\n    return f1(x)\n"), body, last, up).alias("text"))


@query(f"""with recursive {_CHAIN} select k || '/m.py' as path, 'f0' as function, 'f' || i as sink_function, 'eval' as sink, length::int as length, safe as sanitised from c where i = deep
union all select s_suppkey || '/m.py', 'get', 'show', 'os.system', 2, false from supplier where s_suppkey % 3 = 0""")
def taint_flows(spark, d):
    """Sources that reach sinks through calls and returns."""
    return dataflow.taint_flows(_chains(spark, d)).select("path", "function", "sink_function", "sink", "length", "sanitised")


def _rule_programs(spark, d):
    """A function for each part, whose columns say which rules its lines break."""
    p, key, size = table(spark, d, "part"), F.col("p_partkey"), F.col("p_size")
    if_ = lambda test, yes, no: F.when(test, F.lit(yes)).otherwise(F.lit(no))
    lines = [
        F.lit("def f(a, b):"), F.concat(F.lit("    if a == "), if_(size % 2 == 0, "a", "b"), F.lit(":")), F.concat(F.lit("        b = "), if_(size % 3 == 0, "b", "a")),
        F.concat(F.lit("    q = 'x'"), if_(key % 2 == 0, " + a", "")), F.lit("    print(q)"), F.concat(F.lit("    b.execute("), if_(key % 3 == 0, "q", "a"), F.lit(")")),
        F.concat(F.lit("    subprocess.run(a, shell="), if_(key % 5 == 0, "True", "False"), F.lit(")")), F.lit("    try:\n        a()\n    except E:"), F.concat(F.lit("        "), if_(size % 4 == 0, "pass", "raise")),
        F.lit("    for i in range(len(b)):"), F.concat(F.lit("        print(b["), if_(key % 7 == 0, "i", "0"), F.lit("])")), F.concat(F.lit("    if a:\n        return "), if_(size % 5 == 0, "True", "a"), F.lit("\n    else:\n        return False")),
    ]
    return p.select(key.cast("string").alias("path"), F.concat_ws("\n", *lines).alias("text"))


@query(
    " union all ".join(
        f"select p_partkey::varchar as path, {line} as line_no, '{pack}' as pack, '{rule}' as rule, '{severity}' as severity from part where {test}"
        for line, pack, rule, severity, test in [
            (2, "correctness", "self_comparison", "ERROR", "p_size % 2 = 0"), (3, "correctness", "self_assignment", "WARNING", "p_size % 3 = 0"), (4, "security", "joined_query", "CRITICAL", "p_partkey % 6 = 0"), (7, "security", "shell_command", "ERROR", "p_partkey % 5 = 0"),
            (8, "errors", "swallowed_error", "WARNING", "p_size % 4 = 0"), (12, "performance", "index_loop", "INFO", "p_partkey % 7 = 0"), (14, "style", "returned_condition", "INFO", "p_size % 5 = 0"),
        ]
    )
)
def structural_rules(spark, d):
    """Five packs of tree patterns over programs made from the parts."""
    return structure.structural_findings(_rule_programs(spark, d))


_LANGUAGES = ["javascript", "rust", "go", "java", "c"]
_HEADS = ["function f(x) {", "fn f(x: i32) {", "func f(x int) {", "class A { static int f(int x) {", "int f(int x)\n{"]


def _brace_programs(spark, d):
    """A function for each customer in a language by its key, nested as deep as its nation
    says, with a string and a comment full of braces and a call inside."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    deep = (F.col("c_nationkey") % 4).cast("int")
    at = (key % 5).cast("int")
    head = F.element_at(F.array(*[F.lit(h) for h in _HEADS]), at + 1)
    level = F.lit("  if (x) { // }\n    s = \"}\" /* } */;\n")
    nested = F.concat(F.repeat(level, deep), F.concat(F.lit("    g"), key.cast("string"), F.lit("(x);\n")), F.repeat(F.lit("  }\n"), deep))
    tail = F.when(at == 3, "} }\n").otherwise("}\n")
    return c.select(key.cast("string").alias("path"), F.element_at(F.array(*[F.lit(x) for x in _LANGUAGES]), at + 1).alias("language"), F.concat(head, F.lit("\n"), nested, tail).alias("text"))


_LANG_SQL = "['javascript', 'rust', 'go', 'java', 'c'][c_custkey % 5 + 1]"


@query(f"""select c_custkey::varchar as path, {_LANG_SQL} as language, case when c_custkey % 5 = 3 then 'method' else 'function' end as kind, 'f' as name, 1 as line_no, (3 + 3 * (c_nationkey % 4) + case when c_custkey % 5 = 4 then 1 else 0 end)::int as end_line, case when c_custkey % 5 = 3 then 'A' else '' end as inside from customer
union all select c_custkey::varchar, 'java', 'class', 'A', 1, (3 + 3 * (c_nationkey % 4))::int, '' from customer where c_custkey % 5 = 3""")
def brace_symbols(spark, d):
    """Definitions and extents in five languages by nesting."""
    return lexer.symbols(_brace_programs(spark, d)).drop("depth")


@query(f"select c_custkey::varchar as path, {_LANG_SQL} as language, 'g' || c_custkey as name, (2 + 2 * (c_nationkey % 4) + case when c_custkey % 5 = 4 then 1 else 0 end)::int as line_no, 'f' as inside from customer")
def brace_calls(spark, d):
    """Calls in five languages with the function around them."""
    return lexer.calls(_brace_programs(spark, d))
