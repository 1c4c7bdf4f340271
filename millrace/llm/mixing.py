"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

A tree of domains, languages and sources gets a budget of tokens at its root. A node's budget is dealt to its children
by weight, none getting more than its subtree can supply: what one child lacks goes to its siblings first, and only
what a whole subtree lacks goes to the ancestors' other branches. A leaf then takes a prefix of its documents' tokens
in the seeded order of each epoch. All amounts are whole numbers, so the budgets add up exactly.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

BIG = "decimal(38,0)"
DEPTHS = 2  # of buckets: the documents of one of 65,536 are ordered together
MAX_BROADCAST_LEAVES = 10_000  # rows of a leaf's names and three numbers
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Plan:
    """Weights by name at each level (others get `other`), the budget in thousandths of all tokens, epochs at most, seed."""

    domains: Mapping[str, int] = field(default_factory=dict)
    langs: Mapping[str, int] = field(default_factory=lambda: {"de": 25, "en": 40, "es": 15, "fr": 20})
    sources: Mapping[str, int] = field(default_factory=dict)
    other: int = 10
    permille: int = 800
    epochs: int = 2
    seed: int = 17

    def weight(self, level: str) -> str:
        known = {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]
        if any(w < 1 for w in (*known.values(), self.other)):
            raise ValueError("weights are whole numbers from 1")
        cases = "".join(" when {} = '{}' then {}".format(level, name.replace("'", "''"), w) for name, w in sorted(known.items()))
        return f"case{cases} else {self.other} end" if cases else str(self.other)


def n_words(text: Column) -> Column:
    """Words between white space; none in a null text."""
    t = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, r"[\x20\x09-\x0D]+"))).cast("long")


def domain_of(source: Column) -> Column:
    """Five domains by the number that ends a source's name; `none` where there is none."""
    number = F.regexp_extract(source, "([0-9]{1,9})$", 1)
    return F.when(number == "", F.lit("none")).otherwise(F.concat(F.lit("domain"), (number.cast("long") % 5).cast("string")))


def _dealt(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """nodes (parent..., name, w, cap, budget of the parent) with `own`: what each child gets."""
    order = Window.partitionBy(*parent).orderBy(F.col("cap").cast("double") / F.col("w"), name) if parent else Window.orderBy(F.col("cap").cast("double") / F.col("w"), name)
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    total = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast(BIG)
    x = nodes.withColumns({"before": total("cap", upto), "rest_w": total("w", after)})
    x = x.withColumn("full", F.col("cap") * F.col("rest_w") <= F.col("w") * (F.col("budget") - F.col("before")))
    every = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    x = x.withColumns({"left": F.col("budget") - total(F.when(F.col("full"), F.col("cap")), every), "left_w": total(F.when(~F.col("full"), F.col("w")), every)})
    x = x.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(F.expr("(w * left) div left_w").cast(BIG)))
    x = x.withColumn("odd", F.col("left") - total(F.when(~F.col("full"), F.col("share")), every))
    first = (Window.partitionBy(*parent, "full") if parent else Window.partitionBy("full")).orderBy(F.desc("w"), name)
    own = F.when(F.col("full"), F.col("cap")).otherwise(F.col("share") + F.when(F.row_number().over(first) <= F.col("odd"), 1).otherwise(0))
    return x.withColumn("own", own.cast(BIG)).drop("before", "rest_w", "full", "left", "left_w", "share", "odd")


def budgets(leaves: DataFrame, plan: Plan) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `own`, the leaf's budget of tokens. One row for each leaf."""
    x = leaves.withColumn("cap", (F.col("tokens") * plan.epochs).cast(BIG))
    total = x.agg(F.sum(F.col("tokens").cast(BIG))).first()[0]
    above, parent = None, ["one"]
    x = x.withColumn("one", F.lit(0))
    for level in LEVELS:
        keys = [*parent, level]
        nodes = x.groupBy(*keys).agg(F.sum("cap").cast(BIG).alias("cap")).withColumn("w", F.expr(plan.weight(level)).cast(BIG))
        nodes = nodes.join(above, parent) if above is not None else nodes.withColumn("budget", F.lit(str(int(total or 0) * plan.permille // 1000)).cast(BIG))
        above = _dealt(nodes, parent, level).select(*keys, F.col("own").alias("budget"))
        parent = keys
    return x.join(above, ["one", *LEVELS]).select(*LEVELS, "tokens", F.col("budget").alias("own"))


def mix(docs: DataFrame, plan: Plan = Plan(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:  # noqa: B008
    """doc_id, domain, lang, source, epoch, n_tokens, budget: the rows taken, once for each epoch that takes them.

    A document is taken while the tokens before it, in its leaf's order of that epoch, are fewer than the leaf's budget
    there; the last one may pass it. A null lang or source is the leaf `none`, a null text has no tokens. Rows that
    repeat a doc_id count each; ties of the seeded order go by doc_id, tokens and text. No row, no budget.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(lang).cast("string"), F.lit("none")).alias("lang"), F.coalesce(F.col(source).cast("string"), F.lit("none")).alias("source"), n_words(F.col(text)).alias("n_tokens"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("tie"))
    rows = checkpoint(rows.select("doc_id", domain_of(F.col("source")).alias("domain"), "lang", "source", "n_tokens", "tie"))
    leaves = budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), plan)
    epoch = leaves.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(plan.epochs - 1))))
    part = epoch.withColumn("prefix", F.least(F.col("tokens").cast(BIG), F.greatest(F.lit(0).cast(BIG), F.col("own") - F.col("epoch") * F.col("tokens")))).where("prefix > 0")
    part = checkpoint(part.select(*LEVELS, "epoch", "tokens", F.col("prefix").cast("long").alias("prefix"), F.col("own").cast("long").alias("budget")))
    order = F.md5(F.concat_ws("|", F.lit(plan.seed), F.col("epoch").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    # a few leaves go to every task, so that a hot leaf stays where it was read; more of them are joined by shuffle
    near = F.broadcast if part.count() <= MAX_BROADCAST_LEAVES else lambda df: df
    taken = ["doc_id", *LEVELS, "epoch", "n_tokens", "budget"]
    whole = rows.join(near(part.where("prefix >= tokens")), [*LEVELS]).select(*taken)
    cut = rows.join(near(part.where("prefix < tokens")), [*LEVELS]).withColumn("order", order).withColumn("before", F.lit(0).cast("long"))
    # where in its order a leaf's prefix ends: the sums of DEPTHS times 256 ever smaller buckets, then the documents of the last
    own, found = [*LEVELS, "epoch"], whole
    for depth in range(DEPTHS):
        cut = cut.withColumn("bucket", F.substring("order", 2 * depth + 1, 2))
        sums = cut.groupBy(*own, "prefix", "before", "bucket").agg(F.sum("n_tokens").alias("sum"))
        along = Window.partitionBy(*own).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("start", F.col("before") + F.coalesce(F.sum("sum").over(along), F.lit(0)))
        last = sums.where("start < prefix and start + sum >= prefix").select(*own, F.col("bucket").alias("end"), "start")
        cut = cut.join(near(last), own)
        found = found.unionByName(cut.where("bucket < end").select(*taken))
        cut = cut.where("bucket = end").drop("before", "end", "bucket").withColumnRenamed("start", "before")
    within = Window.partitionBy(*own).orderBy("order", "doc_id", "n_tokens", "tie").rowsBetween(Window.unboundedPreceding, -1)
    end = cut.withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).where("start < prefix")
    return found.unionByName(end.select(*taken))


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))


def _sql(plan: Plan) -> str:
    steps, above, parent = [], "root", "one"
    for level in LEVELS:
        keys = f"{parent}, {level}"
        k = f"nodes_{level}"
        on = " and ".join(f"n.{p.strip()} = a.{p.strip()}" for p in parent.split(","))
        steps.append(f"""
{k} as (select {keys}, sum(cap)::hugeint as cap, ({plan.weight(level)})::hugeint as w from leaves group by {keys}),
{k}_a as (select n.*, a.budget, coalesce(sum(n.cap) over (partition by {', '.join('n.' + p.strip() for p in parent.split(','))} order by n.cap::double / n.w::double, n.{level} rows between unbounded preceding and 1 preceding), 0)::hugeint as before_,
    sum(n.w) over (partition by {', '.join('n.' + p.strip() for p in parent.split(','))} order by n.cap::double / n.w::double, n.{level} rows between current row and unbounded following)::hugeint as rest_w from {k} n join {above} a on {on}),
{k}_b as (select *, cap * rest_w <= w * (budget - before_) as is_full from {k}_a),
{k}_c as (select *, budget - coalesce(sum(cap) filter (where is_full) over (partition by {parent}), 0)::hugeint as left_, coalesce(sum(w) filter (where not is_full) over (partition by {parent}), 0)::hugeint as left_w from {k}_b),
{k}_d as (select *, case when is_full then cap else (w * left_) // left_w end as share from {k}_c),
{k}_e as (select *, left_ - coalesce(sum(share) filter (where not is_full) over (partition by {parent}), 0)::hugeint as odd, row_number() over (partition by {parent}, is_full order by w desc, {level}) as place from {k}_d),
{k}_f as (select {keys}, case when is_full then cap else share + case when place <= odd then 1 else 0 end end::hugeint as budget from {k}_e)""")
        above, parent = f"{k}_f", keys
    return f"""
with docs as (select doc_id, coalesce(lang, 'none') as lang, coalesce(source, 'none') as source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens, md5(coalesce(text, '')) as tie from documents),
rows_ as (select *, case when regexp_extract(source, '([0-9]{{1,9}})$', 1) = '' then 'none' else 'domain' || (regexp_extract(source, '([0-9]{{1,9}})$', 1)::bigint % 5)::varchar end as domain from docs),
leaves as (select 0 as one, domain, lang, source, sum(n_tokens)::hugeint as tokens, sum(n_tokens)::hugeint * {plan.epochs} as cap from rows_ group by domain, lang, source),
root as (select 0 as one, (coalesce(sum(tokens), 0)::hugeint * {plan.permille}) // 1000 as budget from leaves),{','.join(steps)},
epochs as (select l.domain, l.lang, l.source, l.tokens, b.budget, e.epoch, least(l.tokens, greatest(0, b.budget - e.epoch * l.tokens)) as prefix
    from leaves l join {above} b on l.domain = b.domain and l.lang = b.lang and l.source = b.source, (select unnest(range({plan.epochs}))::int as epoch) e),
ordered as (select r.doc_id, r.domain, r.lang, r.source, e.epoch, r.n_tokens, e.budget, e.prefix, e.tokens, coalesce(sum(r.n_tokens) over (partition by r.domain, r.lang, r.source, e.epoch
    order by md5('{plan.seed}|' || e.epoch || '|' || coalesce(r.doc_id::varchar, '')), r.doc_id, r.n_tokens, r.tie rows between unbounded preceding and 1 preceding), 0) as start
    from rows_ r join epochs e on r.domain = e.domain and r.lang = e.lang and r.source = e.source where e.prefix > 0)
select doc_id, domain, lang, source, epoch, n_tokens, budget::bigint as budget from ordered where prefix >= tokens or start < prefix
"""


OP7_SQL = _sql(Plan())
