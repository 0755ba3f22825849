"""Queries on learned models, plans from templates, sections, allocations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..sources.tables import table
from .catalogue import query
from .parsed import golden, keyed


@query()
def forest_regression(spark, d):
    """A random forest on embeddings: mean prediction per label.  Fitted on the
    vectors whose id is not divisible by five, applied to all."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import RandomForestRegressor

    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = RandomForestRegressor(numTrees=100, maxDepth=10, seed=42).fit(rows.where("vec_id % 5 <> 0"))
    return model.transform(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("prediction"), 4).alias("mean"))


#: Steps of this engine for a finding, by its kind, in order.
STEPS = [("error", 1, "reproduce"), ("error", 2, "repair"), ("error", 3, "verify"), ("purchase", 1, "measure"), ("purchase", 2, "improve"), ("click", 1, "review")]
_STEPS_SQL = ", ".join(map(str, STEPS))


@query(f"""select event_id, step::int as step, action, (step - 1)::int as needs from events join (values {_STEPS_SQL}) s(kind, step, action) on kind = event_type""")
def step_plan(spark, d):
    """Each finding's chain of steps (``needs`` 0: none): a constant lookup, so nothing
    is shuffled."""
    kind, none = F.col("event_type"), F.array().cast("array<struct<step:int,action:string,needs:int>>")
    plan = none
    for k in dict.fromkeys(s[0] for s in STEPS):
        own = [F.struct(F.lit(n).alias("step"), F.lit(a).alias("action"), F.lit(n - 1).alias("needs")) for x, n, a in STEPS if x == k]
        plan = F.when(kind == k, F.array(*own)).otherwise(plan)
    return table(spark, d, "events").select("event_id", F.inline(plan))


@query(golden("id, field, body", (1, "CAUSE", "a null\nin g§"), (1, "FIX", "check it"), (2, "FIX", "none")))
def response_sections(spark, d):
    """Bodies of headed sections; a line without a head continues the last."""
    rows = keyed(spark, d, [(1, "intro\nCAUSE: a null\nin g§\nFIX: check it"), (2, "FIX: none"), (3, "no head"), (4, None)], "id int, text string")
    parts = F.regexp_extract_all("text", F.lit(r"(?ms)^((?:CAUSE|FIX):.*?)(?=^(?:CAUSE|FIX):|\z)"), 1)
    one = rows.select("id", F.explode(parts).alias("p"))
    return one.select("id", F.split_part("p", F.lit(":"), F.lit(1)).alias("field"), F.trim(F.regexp_replace(F.regexp_replace("p", r"^\w+:", ""), r"\s+$", "")).alias("body"))


@query("with a as (select p_brand, p_partkey, p_size, sum(p_size * 11) over (partition by p_brand order by p_partkey) as used from part) select p_brand, count(*) as placed, (sum(p_size))::bigint as size from a where used <= 11 * 200 group by 1")
def running_allocation(spark, d):
    """What fits a capacity of 220 with a margin of a tenth, first come first."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    own = table(spark, d, "part").withColumn("used", F.sum(F.col("p_size") * 11).over(w)).where("used <= 11 * 200")
    return own.groupBy("p_brand").agg(F.count(F.lit(1)).alias("placed"), F.sum("p_size").alias("size"))


#: Payload checks of this engine: name, pattern.
ATTACKS = [("script", r"(?i)<script\b"), ("handler", r"(?i)\bon(click|load|error)\s*="), ("query", r"(?i)['\"]\s*(or|and)\s+['\"]?1"), ("traversal", r"\.\./")]


@query("select page_id, unnest(list_filter([" + ", ".join(f"case when regexp_matches(html, '{p.replace(chr(39), chr(39) * 2)}') then '{n}' end" for n, p in ATTACKS) + "], lambda x: x is not null)) as attack from pages")
def payload_checks(spark, d):
    tests = F.array(*[F.when(F.col("html").rlike(p), n) for n, p in ATTACKS])
    return table(spark, d, "pages").select("page_id", F.explode(F.filter(tests, lambda x: x.isNotNull())).alias("attack"))
