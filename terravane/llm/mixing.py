"""Mixing sources to target weights by hierarchical budgeting (operator 7).

Documents hang in a tree of domains, languages and sources. A budget of tokens goes down the tree level by level: siblings share what
their parent got in proportion to their weights, and none gets more than its subtree can give (its tokens times the
epochs allowed). What a short sibling cannot take goes to its siblings, so a shortage leaves a parent only if all of its
children are used up; the parent's own share has been cut down to that capacity one level higher, where its siblings took
the rest. The share at which siblings are filled is found by one running sum over the siblings in the order of capacity per weight.

A leaf whose budget exceeds its tokens is read in whole epochs; the last epoch is partial, and it is the longest prefix, in an
order drawn anew for each epoch from the seed, whose tokens do not exceed what is left. Prefixes are found without sorting
a source: the drawn numbers fall into ``SLICES`` equal slices, running sums over the slices of a leaf find the one slice in
which its prefix ends, and only that slice is put in order. Every step is a DataFrame aggregate, join or window over aggregates.

Tokens are words ``[^\\x20\\x09-\\x0D]+``. Defined cases: null and empty texts have no tokens, and come with every whole
epoch and every prefix before its end; null domains, languages and sources are values of their own; repeated rows count
each; a leaf without weight, or with weight 0, gets nothing (weights that are not named are 1); with no tokens at all
nothing is selected; an empty table gives no rows; other columns are not read and may have any name.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm import common

LEVELS = ("domain", "lang", "source")
SLICES = 4096
SEED = 7
MAX_EPOCHS = 4


def n_tokens(text: str = "text") -> Column:
    return F.regexp_count(common.text_of(text), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def domain_of(source: str = "source") -> Column:
    """Domain of a source in the synthetic tables: five neighbouring numbers are one domain."""
    return F.concat(F.lit("domain"), F.floor(F.coalesce(F.regexp_extract(source, "([0-9]+)$", 1).try_cast("int"), F.lit(0)) / 5).cast("string"))


def drawn(epoch: Column, key: str, seed: int = SEED) -> Column:
    """The number of a row in an epoch's order: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.col(key).cast("string")).cast("binary"))


def weight_of(level: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(F.col(level).eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(out)
    return out


def shared_out(nodes: DataFrame, parent: list[str], budget: str = "budget", weight: str = "weight", most: str = "most") -> DataFrame:
    """``nodes`` with a column share: each parent's budget among its children, in proportion to weights up to their capacities.

    Children in the order of capacity per weight are filled up while what is left, divided by the weight that is left,
    lies above that; all after them get their part of the rest.
    """
    order = Window.partitionBy(*parent).orderBy((F.col(most) / F.col(weight)).asc_nulls_last(), *[c for c in LEVELS if c in nodes.columns])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parent)
    rows = nodes.where(F.col(weight) > 0)
    rows = rows.withColumn("left", F.col(budget) - F.coalesce(F.sum(most).over(before), F.lit(0.0)))
    rows = rows.withColumn("weight_left", F.sum(weight).over(whole) - F.coalesce(F.sum(weight).over(before), F.lit(0.0)))
    rows = rows.withColumn("full", F.col(most) / F.col(weight) <= F.col("left") / F.col("weight_left"))
    rate = F.max(F.when(~F.col("full"), F.col("left") / F.col("weight_left"))).over(whole)  # that of the first one; it falls after it
    return rows.withColumn("share", F.when(F.col("full"), F.col(most)).otherwise(F.greatest(F.lit(0.0), rate * F.col(weight)))).drop("left", "weight_left", "full")


def budgets(leaves: DataFrame, budget: float, weights: Mapping[str, Mapping[str, float]], max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with the tokens each is to give: budget, a whole number."""
    known = leaves.select(*LEVELS, "tokens", (F.col("tokens") * F.lit(float(max_epochs))).alias("most"))
    given: DataFrame | None = None
    for depth in range(1, len(LEVELS) + 1):
        own, parent = list(LEVELS[:depth]), list(LEVELS[: depth - 1])
        # A subtree can give what those of its leaves can that have weight all the way down.
        live = known
        for level in LEVELS[depth:]:
            live = live.withColumn("most", F.when(weight_of(level, weights.get(level, {})) > 0, F.col("most")).otherwise(0.0))
        nodes = live.groupBy(*own).agg(F.sum("most").alias("most")).withColumn("weight", F.when(F.col("most") > 0, weight_of(own[-1], weights.get(own[-1], {}))).otherwise(0.0))
        if given is None:
            most = F.sum(F.when(F.col("weight") > 0, F.col("most"))).over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.least(F.lit(float(budget)), F.coalesce(most, F.lit(0.0))))
            given = shared_out(nodes, [F.lit(0)])
        else:
            on = [F.col(f"n.{c}").eqNullSafe(F.col(f"p.{c}")) for c in parent]
            nodes = nodes.alias("n").join(given.select(*parent, F.col("share").alias("budget")).alias("p"), on).select("n.*", "p.budget")
            given = shared_out(nodes, parent)
    return given.select(*LEVELS, F.floor(F.col("share") + 1e-6).cast("long").alias("budget"))


def select(docs: DataFrame, weights: Mapping[str, Mapping[str, float]], budget: float | None = None, max_epochs: int = MAX_EPOCHS, seed: int = SEED, key: str = "doc_id", text: str = "text", domain: Column | None = None, lang: str = "lang", source: str = "source", slices: int = SLICES, row: str | None = None) -> DataFrame:
    """One row for every document: key, domain, lang, source, n_tokens, budget (of its leaf), epochs (how often it is taken), and the column ``row`` if named.

    Without a ``budget`` the tokens of all documents are to be given out.
    """
    spark = docs.sparkSession
    home = common.shared_dir(spark, "mixing")
    slim = docs.select(F.col(key).alias("key"), (domain_of(source) if domain is None else domain).cast("string").alias("domain"), F.col(lang).cast("string").alias("lang"), F.col(source).cast("string").alias("source"), n_tokens(text).alias("n_tokens"), *([row] if row else []))
    rows = common.stored(slim, f"{home}/rows")
    leaves = common.stored(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), f"{home}/leaves")
    if budget is None:
        budget = float(leaves.agg(F.sum("tokens")).first()[0] or 0)
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"b.{c}")) for c in LEVELS]
    plan = leaves.alias("l").join(budgets(leaves, budget, weights, max_epochs).alias("b"), on, "left").select("l.*", F.coalesce("b.budget", F.lit(0).cast("long")).alias("budget"))
    plan = plan.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long"))).withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens"))
    plan = common.stored(plan.withColumn("leaf", F.monotonically_increasing_id()), f"{home}/plan")

    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in LEVELS]
    placed = rows.alias("r").join(plan.alias("p"), on).select("r.*", "p.budget", "p.whole", "p.rest", "p.leaf").withColumn("draw", drawn(F.col("whole"), "key", seed))
    placed = common.stored(placed.withColumn("slice", F.floor(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") * slices / (1 << 32)).cast("int")), f"{home}/placed")
    sums = placed.groupBy("leaf", "slice", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("leaf").orderBy("slice"))
    edges = sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest")).groupBy("leaf").agg(F.min(F.struct("slice", (F.col("upto") - F.col("n")).alias("before"))).alias("e"))
    edges = common.stored(edges.select("leaf", F.col("e.slice").alias("edge"), F.col("e.before").alias("before")), f"{home}/edges")
    at = placed.join(edges, "leaf", "left")
    inner = at.where(F.col("edge").isNull() | (F.col("slice") != F.col("edge")))
    inner = inner.withColumn("epochs", F.col("whole") + ((F.col("rest") > 0) & (F.col("edge").isNull() | (F.col("slice") < F.col("edge")))).cast("long"))
    rim = at.where(F.col("slice") == F.col("edge"))
    running = F.sum("n_tokens").over(Window.partitionBy("leaf", "slice").orderBy("draw", "key", *([row] if row else [])).rowsBetween(Window.unboundedPreceding, 0))
    rim = rim.withColumn("epochs", F.col("whole") + ((F.col("rest") > 0) & (F.col("before") + running <= F.col("rest"))).cast("long"))
    names = ["key", *LEVELS, "n_tokens", "budget", "epochs", *([row] if row else [])]
    return inner.select(*names).unionByName(rim.select(*names))


#: Weights of the query and of the pipeline; names that are not listed weigh 1.
TARGETS = {"domain": {"domain0": 2.0, "domain3": 0.5}, "lang": {"en": 3.0, "de": 1.5}, "source": {"src0": 2.0}}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document of the table is taken to meet the target weights, with as many tokens as the table has."""
    out = select(spark.read.parquet(f"{sf_dir}/documents.parquet"), TARGETS)
    return out.withColumnRenamed("key", "doc_id")


def _share_sql(level: str, parent: str, nodes: str, budget: str) -> str:
    """SQL of one level; nodes has the columns of its path, most and weight."""
    over = f"partition by {parent}" if parent else ""
    return f"""
{level}_a as (select n.*, {budget} as budget, most / weight as per from {nodes} n where weight > 0),
{level}_b as (select *, budget - coalesce(sum(most) over ({over} order by per, {level} rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over ({over}) - coalesce(sum(weight) over ({over} order by per, {level} rows between unbounded preceding and 1 preceding), 0) as weight_left from {level}_a),
{level}_c as (select *, per <= rest / weight_left as is_full from {level}_b),
{level}_s as (select *, case when is_full then most else greatest(0e0, weight * first_value(case when not is_full then rest / weight_left end ignore nulls)
    over ({over} order by per, {level} rows between unbounded preceding and unbounded following)) end as share from {level}_c),"""


OP7_SQL = f"""
with d as (select doc_id, 'domain' || cast(cast(floor(coalesce(try_cast(regexp_extract(source, '([0-9]+)$', 1) as int), 0) / 5e0) as bigint) as varchar) as domain, lang, source,
    cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as n_tokens from documents),
leaves as (select domain, lang, source, sum(n_tokens) as tokens, sum(n_tokens) * 4e0 as most from d group by all),
n1 as (select domain, most, case when most > 0 then case domain when 'domain0' then 2e0 when 'domain3' then 0.5e0 else 1e0 end else 0e0 end as weight from (select domain, sum(most) as most from leaves group by all) x),
n2 as (select domain, lang, most, case when most > 0 then case lang when 'en' then 3e0 when 'de' then 1.5e0 else 1e0 end else 0e0 end as weight from (select domain, lang, sum(most) as most from leaves group by all) x),
n3 as (select domain, lang, source, most, case when most > 0 then case source when 'src0' then 2e0 else 1e0 end else 0e0 end as weight from leaves),
{_share_sql("domain", "", "n1", "(select cast(sum(tokens) as double) from leaves)")}
{_share_sql("lang", "domain", "n2", "(select share from domain_s p where p.domain = n.domain)")}
{_share_sql("source", "domain, lang", "n3", "(select share from lang_s p where p.domain = n.domain and p.lang = n.lang)")}
plan as (select l.domain, l.lang, l.source, l.tokens, coalesce(cast(floor(s.share + 1e-6) as bigint), 0) as budget from leaves l left join source_s s on l.domain = s.domain and l.lang = s.lang and l.source = s.source),
e as (select *, case when tokens > 0 then budget // tokens else 0 end as whole from plan),
r as (select d.*, e.budget, e.whole, e.budget - e.whole * e.tokens as rest from d join e on d.domain = e.domain and d.lang = e.lang and d.source = e.source),
o as (select *, sum(n_tokens) over (partition by domain, lang, source order by md5('7|' || cast(cast(whole as bigint) as varchar) || '|' || cast(doc_id as varchar)), doc_id rows between unbounded preceding and current row) as upto from r)
select doc_id, domain, lang, source, n_tokens, budget, cast(whole + case when rest > 0 and upto <= rest then 1 else 0 end as bigint) as epochs from o
"""
