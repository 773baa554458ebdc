"""Mixing to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is domain - language - source. A node's budget is shared among its children by weight; a child that cannot
use its share (its subtree's tokens times the allowed epochs) passes the rest to its siblings. As a child's limit is
that of its whole subtree, a shortage is first made up inside the subtree, and only what the subtree cannot hold
reaches the ancestors' other children. Leaves read their documents in seeded random order, epoch after epoch, and take
the prefix that fits the budget.

All arithmetic is on integers. Texts are never shuffled: the leaf's prefix ends at a key, which is found from sums over
4096 key ranges for each leaf and the documents of the one range in which the prefix ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

SEED = 17
SHARE = (6, 10)
MAX_EPOCHS = 3
#: Positive integer weights; what isn't listed weighs 1.
DOMAIN_WEIGHTS = {"domain0": 5, "domain1": 3, "domain2": 2}
LANG_WEIGHTS = {"en": 4, "de": 2, "fr": 2, "es": 2}
SOURCE_WEIGHTS: dict[str, int] = {}
#: Leaves up to which their plan is broadcast; beyond, it is joined in salted copies.
BROADCAST_LEAVES = 50_000
SALTS = 64
LEAF = ["m_domain", "m_lang", "m_source"]


def domain_of(source: Column) -> Column:
    """The default domain: the number in the source's name modulo 3."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})", 1)
    return F.when(number == "", "other").otherwise(F.concat(F.lit("domain"), (F.when(number != "", number).cast("bigint") % 3).cast("string")))


def _weight(column: str, weights: dict[str, int]) -> Column:
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights have to be positive integers; leave a part out of the table instead")
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("bigint")


def share_out(children: DataFrame, parent: list[str]) -> DataFrame:
    """Adds ``budget`` to rows (weight, limit, parent_budget) by water filling within a parent.

    A child is full if its limit is at most its share of what fuller siblings leave; all are examined in the order of
    limit / weight. The others share the rest by weight, rounded down.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("limit") / F.col("weight"), "name")
    before = F.coalesce(F.sum("limit").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = children.withColumns({"before": before, "open": open_weight}).withColumn("full", F.col("limit") * F.col("open") <= (F.col("parent_budget") - F.col("before")) * F.col("weight"))
    all_ = Window.partitionBy(*parent)
    used = F.sum(F.when(F.col("full"), F.col("limit")).otherwise(0)).over(all_)
    weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(all_)
    rows = rows.withColumns({"used": used, "rest": weight})
    return rows.withColumn("budget", F.when(F.col("full"), F.col("limit")).otherwise(F.expr("((parent_budget - used) * weight) div rest")))


def leaf_budgets(leaves: DataFrame, share: tuple[int, int], max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """(leaf, tokens, budget) from (leaf, tokens): top down, each level by ``share_out``."""
    leaves = leaves.withColumn("limit", F.col("tokens") * max_epochs)
    langs = leaves.groupBy("m_domain", "m_lang").agg(F.sum("limit").alias("limit"))
    domains = leaves.groupBy("m_domain").agg(F.sum("limit").alias("limit"), F.sum("tokens").alias("tokens"))
    total = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    d = domains.withColumns({"parent_budget": (total * share[0]).cast("bigint"), "weight": _weight("m_domain", weights[0]), "name": F.col("m_domain"), "all": F.lit(0)})
    d = share_out(d.withColumn("parent_budget", F.expr(f"parent_budget div {share[1]}")), ["all"]).select("m_domain", F.col("budget").alias("parent_budget"))
    ls = share_out(langs.join(d, "m_domain").withColumns({"weight": _weight("m_lang", weights[1]), "name": F.col("m_lang")}), ["m_domain"]).select("m_domain", "m_lang", F.col("budget").alias("parent_budget"))
    out = share_out(leaves.join(ls, ["m_domain", "m_lang"]).withColumns({"weight": _weight("m_source", weights[2]), "name": F.col("m_source")}), ["m_domain", "m_lang"])
    return out.select(*LEAF, "tokens", "budget")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def with_leaf(docs: DataFrame, domain: Column | None) -> DataFrame:
    keys = {"m_source": F.coalesce(F.col("source").cast("string"), F.lit("unknown")), "m_lang": F.coalesce(F.col("lang").cast("string"), F.lit("und"))}
    docs = docs.drop("m_domain", *keys)
    return docs.withColumns({**keys, "m_domain": F.coalesce(domain_of(F.col("source")) if domain is None else domain, F.lit("other"))})


def leaf_cuts(docs: DataFrame, scratch: Scratch, seed: int, share: tuple[int, int], max_epochs: int, weights: tuple[dict, dict, dict]) -> DataFrame:
    """(leaf, epochs, cut): how many whole epochs, and the last key of the next epoch's prefix ('' for none)."""
    budgets = scratch.save(leaf_budgets(docs.groupBy(*LEAF).agg(F.sum("m_tokens").alias("tokens")), share, max_epochs, weights), "budgets")
    plan = budgets.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens"))
    plan = scratch.save(plan.select(*LEAF, "epochs", "rest"), "plan")
    keyed = by_leaf(docs.select("doc_id", "m_tokens", *LEAF), plan).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id"))).withColumn("range", F.substring("key", 1, 3))
    sums = keyed.groupBy(*LEAF, "range").agg(F.sum("m_tokens").alias("tokens"), F.first("rest").alias("rest"))
    upto = F.sum("tokens").over(Window.partitionBy(*LEAF).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = scratch.save(sums.withColumn("upto", upto), "ranges")
    # the last range that fits whole, and the one after it, where the prefix ends
    ends = sums.groupBy(*LEAF).agg(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("range"))).alias("whole"), F.min(F.when(F.col("upto") > F.col("rest"), F.struct("range", (F.col("upto") - F.col("tokens")).alias("base")))).alias("end"))
    ends = scratch.save(ends.select(*LEAF, "whole", F.col("end.range").alias("range"), F.col("end.base").alias("base")), "ends")
    inner = keyed.join(ends.where("range is not null"), [*LEAF, "range"])
    run = F.col("base") + F.sum("m_tokens").over(Window.partitionBy(*LEAF).orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cut = inner.withColumn("run", run).where(F.col("run") <= F.col("rest")).groupBy(*LEAF).agg(F.max("key").alias("last"))
    # a whole range ends before the first key of the next: '~' is after every digit
    return scratch.save(plan.join(ends, LEAF, "left").join(cut, LEAF, "left").select(*LEAF, "epochs", F.coalesce("last", F.concat("whole", F.lit("~")), F.lit("")).alias("cut")), "cuts")


def by_leaf(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Join a table with one row for each leaf: broadcast if it has few, else in salted copies."""
    if plan.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES:
        return docs.join(F.broadcast(plan), LEAF)
    copies = plan.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return docs.withColumn("m_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(copies, [*LEAF, "m_salt"]).drop("m_salt")


def mix(docs: DataFrame, share: tuple[int, int] = SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, domain: Column | None = None, weights: tuple[dict, dict, dict] = (DOMAIN_WEIGHTS, LANG_WEIGHTS, SOURCE_WEIGHTS)) -> DataFrame:
    """The chosen documents with ``domain``, ``copies`` (epochs in which it is read) and the columns of docs.

    The budget is share[0] / share[1] of all tokens (words). A null language, source or domain counts as "und",
    "unknown" or "other". Null and empty texts have no tokens and stay if the prefix reaches their key. Documents of a
    leaf come in the order of md5(seed:epoch:doc_id); rows with the same doc_id are taken together. Existing columns
    ``domain`` and ``copies`` are replaced. An empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    docs = with_leaf(docs, domain)
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")
    slim = scratch.save(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *LEAF, tokens.alias("m_tokens")), "tokens")
    cuts = leaf_cuts(slim, scratch, seed, share, max_epochs, weights)
    out = by_leaf(docs, cuts).withColumn("copies", (F.col("epochs") + F.when(order_key(seed, F.col("epochs"), F.col("doc_id")) <= F.col("cut"), 1).otherwise(0)).cast("int"))
    out = out.where("copies > 0").drop("domain").withColumnRenamed("m_domain", "domain")
    return out.drop("epochs", "cut", "m_lang", "m_source")


def op7_hierarchical_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixture of all documents: which are read, and how often."""
    docs = read(spark, sf_dir, "documents")
    return mix(docs).select("doc_id", "domain", "lang", "source", "copies")


def _case(column: str, weights: dict[str, int]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + " ELSE 1 END" if weights else "1"


def _share_sql(name: str, source: str, parent: str, weight: str, child: str) -> str:
    """CTEs that share a parent's budget: {name} has the columns of ``source`` and ``budget``."""
    return f"""
{name}_w AS (SELECT *, CAST({weight} AS BIGINT) AS weight FROM {source}),
{name}_o AS (
  SELECT *, coalesce(sum(lim) OVER (PARTITION BY {parent} ORDER BY lim / weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(weight) OVER (PARTITION BY {parent} ORDER BY lim / weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM {name}_w),
{name}_f AS (SELECT *, lim * open_w <= (parent_budget - before) * weight AS is_full FROM {name}_o),
{name}_u AS (
  SELECT *, sum(CASE WHEN is_full THEN lim ELSE 0 END) OVER (PARTITION BY {parent}) AS used,
         sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {parent}) AS rest_w
  FROM {name}_f),
{name} AS (SELECT *, CASE WHEN is_full THEN lim ELSE ((parent_budget - used) * weight) // rest_w END AS budget FROM {name}_u)"""


OP7_SQL = rf"""
WITH d0 AS (
  SELECT doc_id, lang, source, coalesce(source, 'unknown') AS s, coalesce(lang, 'und') AS l,
         regexp_extract(coalesce(source, ''), '(\d{{1,9}})', 1) AS num,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens
  FROM documents),
d AS (SELECT *, CASE WHEN num = '' THEN 'other' ELSE 'domain' || CAST(CAST(num AS BIGINT) % 3 AS VARCHAR) END AS dom FROM d0),
leaf0 AS (SELECT dom, l, s, sum(tokens) AS tokens, sum(tokens) * {MAX_EPOCHS} AS lim FROM d GROUP BY ALL),
dom0 AS (SELECT dom, sum(lim) AS lim, 0 AS root, (SELECT sum(tokens) * {SHARE[0]} FROM leaf0) // {SHARE[1]} AS parent_budget FROM leaf0 GROUP BY dom),
{_share_sql("dom1", "dom0", "root", _case("dom", DOMAIN_WEIGHTS), "dom").lstrip()},
lang0 AS (SELECT x.dom, x.l, sum(x.lim) AS lim, any_value(p.budget) AS parent_budget FROM leaf0 x JOIN dom1 p USING (dom) GROUP BY x.dom, x.l),
{_share_sql("lang1", "lang0", "dom", _case("l", LANG_WEIGHTS), "l").lstrip()},
src0 AS (SELECT x.dom, x.l, x.s, x.tokens, x.lim, p.budget AS parent_budget FROM leaf0 x JOIN lang1 p USING (dom, l)),
{_share_sql("src1", "src0", "dom, l", _case("s", SOURCE_WEIGHTS), "s").lstrip()},
plan AS (SELECT dom, l, s, budget, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, tokens AS all_tokens FROM src1),
keyed AS (
  SELECT d.*, p.epochs, p.budget - p.epochs * p.all_tokens AS rest,
         md5('{SEED}:' || CAST(CAST(p.epochs AS BIGINT) AS VARCHAR) || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '')) AS k
  FROM d JOIN plan p USING (dom, l, s)),
run AS (SELECT *, sum(tokens) OVER (PARTITION BY dom, l, s ORDER BY k RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, dom AS domain, lang, source, CAST(epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM run WHERE epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END > 0
"""
