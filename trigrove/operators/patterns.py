"""Relations by clause rules and literal templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import lexicon as lx
from trigrove.functions import text as tx
from trigrove.operators.grams import texts_with_words

RULE_SCHEMA = "rule_id int, relation string, pattern string, trigger string, reverse boolean"


def rule_rows() -> list[tuple]:
    """The clause rules as rows of RULE_SCHEMA. A rule whose right name is followed by something takes the shortest names."""
    lazy = lambda end: "?" if end else ""
    return [
        (k, rel, f"({tx.WORD}{{2,{left}}}{lazy(end)}){mid}({tx.WORD}{{2,{right}}}{lazy(end)}){end}", mid, back)
        for k, (rel, back, left, mid, right, end) in enumerate(lx.CLAUSE_RULES)
    ]


def template_rows() -> list[tuple]:
    """The literal templates as rows of RULE_SCHEMA."""
    rows = []
    for k, (pattern, rel, back) in enumerate(lx.CLAUSE_TEMPLATES):
        mid, tail = pattern.removeprefix("{entity1}").split("{entity2}")
        rows.append((k, rel, f"({tx.WORD}{{2,15}}?){mid}({tx.WORD}{{2,15}}?){tail or '$'}", mid, back))
    return rows


def default_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rule_rows(), RULE_SCHEMA)


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), RULE_SCHEMA)


def _match(rule_id: int, relation: str):
    """A match's two ends and its place as a struct."""
    return lambda m, i: F.struct(F.lit(rule_id).alias("rule_id"), i.alias("match_idx"), m["e1"].alias("e1"), F.lit(relation).alias("rel"), m["e2"].alias("e2"))


def _apply_fixed(clauses: DataFrame, rows: list[tuple], technique: str) -> DataFrame:
    """All matches of rules known beforehand: one array for each clause, every pattern compiled once, no join."""
    tried = []
    for rule_id, rel, pattern, trigger, back in rows:
        one, two = (F.regexp_extract_all("clause", F.lit(pattern), F.lit(g)) for g in (1, 2))
        ends = F.arrays_zip((two if back else one).alias("e1"), (one if back else two).alias("e2"))
        tried.append(F.when(F.contains("clause", F.lit(trigger)), F.transform(ends, _match(rule_id, rel))))
    keep = [c for c in clauses.columns if c != "clause"]
    found = clauses.select(*keep, F.explode(F.flatten(F.array_compact(F.array(*tried)))).alias("m"))
    return found.select(*keep, "m.*", F.lit(technique).alias("technique"))


#: A caller's rules are broadcast up to this count.
BROADCAST_RULES = 10_000


def _candidates(clauses: DataFrame, rules: DataFrame) -> DataFrame:
    """Each clause beside the rules whose words it holds.

    A table of at most BROADCAST_RULES rules is broadcast. Of a larger one, rules and clauses meet by the rarest
    short part of a rule's words, so that no rule sees a clause without it; only rules without any words, which
    have to be tried on every clause, are broadcast then, and must not be more.
    """
    if rules.count() <= BROADCAST_RULES:
        return clauses.join(F.broadcast(rules), F.expr("contains(clause, trigger)"))
    wordless = rules.where("trigger = ''")
    if wordless.count() > BROADCAST_RULES:
        raise ValueError(f"more than {BROADCAST_RULES} rules have no trigger")
    hits = texts_with_words(clauses.select(F.col("clause").alias("text")), rules.select(F.col("trigger").alias("word")))
    met = clauses.join(hits.withColumnRenamed("text", "clause"), "clause").join(rules, F.col("word") == F.col("trigger")).drop("word")
    rest = clauses.join(F.broadcast(wordless), F.expr("contains(clause, trigger)"))
    return met.select(rest.columns).unionByName(rest)


def _apply(clauses: DataFrame, rules: DataFrame, technique: str) -> DataFrame:
    """All matches of all rules; a rule is only tried on clauses that hold its words."""
    keep = [c for c in clauses.columns if c != "clause"]
    met = _candidates(clauses, rules)
    found = F.arrays_zip(F.regexp_extract_all("clause", "pattern", F.lit(1)).alias("left"), F.regexp_extract_all("clause", "pattern", F.lit(2)).alias("right"))
    rows = met.select(*keep, "rule_id", "relation", "reverse", F.posexplode(found).alias("match_idx", "m"))
    left, right = F.col("m.left"), F.col("m.right")
    return rows.select(
        *keep, "rule_id", "match_idx", F.when(F.col("reverse"), right).otherwise(left).alias("e1"), F.col("relation").alias("rel"),
        F.when(F.col("reverse"), left).otherwise(right).alias("e2"), F.lit(technique).alias("technique"),
    )


def rule_extract(clauses: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """``clauses(..., clause)`` -> rule_id, match_idx, e1, rel, e2, technique beside the other columns.

    The rules of posts ('A holds the post C of B') give two rows: (A, 任职, B) and (A, 担任, C).
    """
    if rules is not None:
        return _apply(clauses, rules, "rule")
    plain = _apply_fixed(clauses, rule_rows(), "rule")
    keep = [c for c in clauses.columns if c != "clause"]
    for k, verb in enumerate(lx.POST_RULES):
        pattern = f"({tx.WORD}{{2,8}}){verb}({tx.WORD}{{2,10}})的({tx.WORD}{{2,10}})"
        parts = [F.regexp_extract("clause", pattern, g) for g in (1, 2, 3)]
        posts = clauses.where(F.contains("clause", F.lit(verb)) & F.col("clause").rlike(pattern)).select(*keep, *[p.alias(n) for p, n in zip(parts, "abc", strict=True)])
        both = F.posexplode(F.array(F.struct(F.lit("任职").alias("rel"), F.col("b").alias("e2")), F.struct(F.lit("担任").alias("rel"), F.col("c").alias("e2")))).alias("match_idx", "m")
        rows = posts.select(*keep, F.lit(1000 + k).alias("rule_id"), "a", both)
        plain = plain.unionByName(rows.select(*keep, "rule_id", "match_idx", F.col("a").alias("e1"), "m.rel", "m.e2", F.lit("rule").alias("technique")))
    return plain


def template_extract(clauses: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """As ``rule_extract`` with literal templates."""
    return _apply(clauses, templates, "template") if templates is not None else _apply_fixed(clauses, template_rows(), "template")
