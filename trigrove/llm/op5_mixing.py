"""Mixing sources to target weights by hierarchical budgeting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigrove.llm.common import materialize, table, text_key

LEVELS = ("domain", "lang", "source")
WORD = r"[^\x20\x09-\x0D]+"


def domain_weight(domain: Column) -> Column:
    """Domains whose last digit is a multiple of 3 weigh 3, others 1 or 2 by that remainder."""
    digit = F.coalesce(F.expr("try_cast(right(domain, 1) as int)"), F.lit(0))
    return F.when(digit % 3 == 0, 3).otherwise(digit % 3)


def lang_weight(lang: Column) -> Column:
    return F.when(lang == "en", 4).when(lang.isin("de", "fr"), 2).otherwise(1)


def source_weight(source: Column) -> Column:
    return F.lit(1)


def leaves_of(docs: DataFrame) -> DataFrame:
    """doc_id, key (the text's identity), the leaf's three names ('' for null) and n_tokens: words and one end mark."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.concat(F.lit("domain"), F.expr("right(coalesce(source, ''), 1)")).alias("domain"),
        F.coalesce(F.col("lang"), F.lit("")).alias("lang"), source.alias("source"), (F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)) + 1).cast("long").alias("n_tokens"),
    )


def _shares(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight``, none above its ``cap``.

    Children are taken by rising cap per weight. One is full if its cap is within its share of what is left to
    it and those after it; the full ones are a prefix, and the rest divide what remains by weight.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("weight"), name)
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parent)
    seen = nodes.withColumn("_cap", F.coalesce(F.sum("cap").over(before), F.lit(0))).withColumn("_w", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    full = F.col("cap") * F.col("_w") <= F.col("weight") * (F.col("budget") - F.col("_cap"))
    seen = seen.withColumn("_full", full)
    seen = seen.withColumn("_rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("cap"))).over(everything), F.lit(0)))
    seen = seen.withColumn("_open", F.sum(F.when(~F.col("_full"), F.col("weight"))).over(everything))
    share = F.when(F.col("_full"), F.col("cap")).otherwise(F.expr("weight * _rest div _open"))
    return seen.withColumn("budget", share).drop("_cap", "_w", "_full", "_rest", "_open")


def budgets(leaves: DataFrame, percent: int, epochs: int) -> DataFrame:
    """``(domain, lang, source, n_tokens)`` -> each leaf's tokens and budget.

    The whole budget is ``percent`` of all tokens. It goes down the tree level by level. What a subtree can give
    (its tokens times ``epochs``) is known before it gets its share, so a leaf's shortage goes to its siblings
    first, and to the ancestors' other children only what all of the leaf's siblings together can't take.
    """
    stats = leaves.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("leaf_cap", F.col("tokens") * epochs)
    node = stats.withColumn("root", F.lit(0))
    total = node.groupBy("root").agg(F.least(F.expr(f"sum(tokens) * {percent} div 100"), F.sum("leaf_cap")).alias("budget"))
    weights = {"domain": domain_weight, "lang": lang_weight, "source": source_weight}
    parent, given = ["root"], total
    for level in LEVELS:
        here = [*parent, level]
        caps = node.groupBy(*here).agg(F.sum("leaf_cap").alias("cap")).withColumn("weight", weights[level](F.col(level)).cast("long"))
        given = _shares(caps.join(given, parent), parent, level).select(*here, "budget")
        parent = here
    return stats.join(given.drop("root"), list(LEVELS)).select(*LEVELS, "tokens", "budget")


def _selected(leaves: DataFrame, percent: int, epochs: int, seed: str) -> DataFrame:
    given = materialize(budgets(leaves, percent, epochs)).withColumn("_full", F.expr("budget div tokens")).withColumn("_rest", F.col("budget") - F.col("_full") * F.col("tokens"))
    rows = leaves.join(given, list(LEVELS))
    rows = rows.withColumn("_order", F.md5(F.concat_ws(":", F.lit(seed), F.col("_full").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("_b", F.substring("_order", 1, 3))
    sums = rows.groupBy(*LEVELS, "_b").agg(F.sum("n_tokens").alias("_n"))
    before = Window.partitionBy(*LEVELS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*LEVELS, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*LEVELS, "_b").orderBy("_order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_cum", F.sum("n_tokens").over(inside)).join(offsets, [*LEVELS, "_b"])
    copies = F.col("_full") + F.when(F.col("_off") + F.col("_cum") <= F.col("_rest"), 1).otherwise(0)
    return rows.withColumn("copies", copies.cast("int")).where("copies > 0")


def mix(docs: DataFrame, percent: int = 50, epochs: int = 4, seed: str = "mix") -> DataFrame:
    """Choose documents so that tokens follow the weights of the domain-language-source tree.

    One row per chosen row of ``docs(doc_id, text, lang, source, ...)``: doc_id, domain, lang, source, n_tokens,
    copies. A leaf with budget b and t tokens gives b div t whole epochs and, of the next, the longest prefix
    in that epoch's seeded order that fits; prefix sums run over 4096 parts of the hash range, so a leaf with a
    third of all rows is no single task. Null lang or source: the leaf named ''. Null and empty texts count
    one token. Repeated rows are rows of their own. Empty table: empty result. Other columns are ignored.
    """
    chosen = _selected(materialize(leaves_of(docs)), percent, epochs, seed)
    return chosen.select("doc_id", *LEVELS, "n_tokens", "copies")


def mixed(docs: DataFrame, percent: int = 90, epochs: int = 1, seed: str = "mix") -> DataFrame:
    """The chosen rows of ``docs`` themselves, each as often as it was chosen. Rows equal in doc_id and text share one set of other columns."""
    chosen = _selected(materialize(leaves_of(docs)), percent, epochs, seed).groupBy("doc_id", "key").agg(F.sum("copies").cast("int").alias("_copies"))
    own = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    met = own.alias("d").join(chosen.alias("c"), (F.col("d.key") == F.col("c.key")) & F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).select("row", "d.doc_id", "d.key", "_copies")
    once = met.dropDuplicates(["key", "doc_id"])
    return once.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_level(n: int) -> str:
    levels = ["root", *LEVELS]
    parent, name = ", ".join(levels[:n]), levels[n]
    return f"""
, c{n} as (select {parent}, {name}, sum(leaf_cap)::bigint as cap, {('', _SQL_DOMAIN, _SQL_LANG, '1')[n]} as weight from node group by all)
, s{n} as (select c{n}.*, budget, coalesce(sum(cap) over (w rows between unbounded preceding and 1 preceding), 0) as cap0,
     sum(weight) over (partition by {parent}) - coalesce(sum(weight) over (w rows between unbounded preceding and 1 preceding), 0) as w0
   from c{n} join g{n - 1} using ({parent}) window w as (partition by {parent} order by cap / weight, {name}))
, f{n} as (select *, cap * w0 <= weight * (budget - cap0) as isfull from s{n})
, g{n} as (select {parent}, {name}, case when isfull then cap else (weight * (budget - coalesce(sum(case when isfull then cap end) over p, 0))) // sum(case when not isfull then weight end) over p end::bigint as budget
   from f{n} window p as (partition by {parent}))"""


_SQL_DOMAIN = "case when coalesce(try_cast(right(domain, 1) as int), 0) % 3 = 0 then 3 else try_cast(right(domain, 1) as int) % 3 end"
_SQL_LANG = "case when lang = 'en' then 4 when lang in ('de', 'fr') then 2 else 1 end"
SQL = (
    rf"""
with leaves as (select doc_id, md5(coalesce(text, '')) as key, 'domain' || right(coalesce(source, ''), 1) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
  (len(regexp_extract_all(coalesce(text, ''), '{WORD}')) + 1)::bigint as n_tokens from documents)
, stats as (select domain, lang, source, sum(n_tokens)::bigint as tokens, (sum(n_tokens) * 4)::bigint as leaf_cap from leaves group by all)
, node as (select *, 0 as root from stats)
, g0 as (select root, least(sum(tokens) * 50 // 100, sum(leaf_cap))::bigint as budget from node group by root)"""
    + "".join(_sql_level(n) for n in (1, 2, 3))
    + """
, given as (select domain, lang, source, tokens, budget // tokens as epochs, budget % tokens as rest from stats join g3 using (domain, lang, source))
, ordered as (select *, md5('mix:' || epochs || ':' || coalesce(doc_id::varchar, '')) as o from leaves join given using (domain, lang, source))
, summed as (select *, sum(n_tokens) over (partition by domain, lang, source order by o, doc_id, key rows between unbounded preceding and current row) as cum from ordered)
select doc_id, domain, lang, source, n_tokens, copies from (select *, (epochs + case when cum <= rest then 1 else 0 end)::int as copies from summed) where copies > 0
"""
)
