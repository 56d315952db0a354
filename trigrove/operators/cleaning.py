"""Cleaning, expanding and deduplicating triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trigrove.functions import text as tx
from trigrove.functions.once import once
from trigrove.functions.tables import stored

SPLIT = "[和与及、]"


#: A dictionary of at most so many names is broadcast.
BROADCAST_NAMES = 200_000
#: Names are cleaned once each where there are at least so many rows for every name.
REPEATS = 4


def _forms(df: DataFrame, one: str, two: str) -> DataFrame:
    """``one`` and ``two`` cleaned and normalised as the first and the second name of a triple."""
    step = once(df, **{one: tx.clean_entity(F.col(one)), two: tx.clean_entity(F.col(two))})
    rest = tx.trim(F.regexp_replace(two, rf"^(?:[了着过]{tx.SPACE}*)+", ""))
    step = once(step, **{two: tx.trim(F.regexp_replace(rest, tx.TAIL, ""))})
    return once(step, **{one: tx.normalize_entity(F.col(one)), two: tx.normalize_entity_e2(F.col(two))})


def _cleaned(df: DataFrame, by_name: bool | None = None) -> DataFrame:
    """Names cleaned and normalised, relation trimmed.

    ``by_name``: each different name is cleaned once, and the rows find its two forms by a join with that dictionary,
    which is broadcast up to BROADCAST_NAMES names; else every row is cleaned by itself. None: as an approximate
    count of rows and names says, for which ``df``, best a stored table, is evaluated once more.
    """
    name = F.explode(F.array("e1", "e2")).alias("name")
    if by_name is None:
        seen = df.select(name).agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("name", 0.02).alias("d")).first()
        by_name = seen["n"] >= REPEATS * seen["d"]
    rows = df.withColumn("rel", tx.trim(F.col("rel")))
    if not by_name:
        return _forms(rows, "e1", "e2")
    names = df.select(name).where("name is not null").distinct()
    forms = stored(_forms(names.select("name", F.col("name").alias("_one"), F.col("name").alias("_two")), "_one", "_two"))
    few = forms.count() <= BROADCAST_NAMES
    side = lambda c, form: (F.broadcast if few else lambda x: x)(forms.select(F.col("name").alias(c), F.col(form).alias(f"_{c}")))
    met = rows.join(side("e1", "_one"), "e1", "left").join(side("e2", "_two"), "e2", "left")
    return met.withColumns({"e1": F.col("_e1"), "e2": F.col("_e2")}).select(df.columns)


def _fault():
    e1, rel, e2 = F.col("e1"), F.col("rel"), F.col("e2")
    return (
        F.when(e1.isNull() | rel.isNull() | e2.isNull() | (e1 == "") | (rel == "") | (e2 == ""), "empty").when((F.length(e1) > 50) | (F.length(e2) > 50), "too_long")
        .when(e1 == e2, "self").when(tx.is_generic_entity(e1) | tx.is_generic_entity(e2), "generic").when(tx.pair_fault(e1, rel, e2).isNotNull(), "bad_pair")
    )


def clean_triples(df: DataFrame, by_name: bool | None = None) -> DataFrame:
    """Clean ``e1, rel, e2`` and keep the rows that can be facts; quotes, tabs and line ends go last. Other columns stay.

    ``by_name``: see ``_cleaned``; False where ``df`` is the end of a long computation.
    """
    kept = _cleaned(df, by_name).where(_fault().isNull())
    return kept.withColumns({c: F.translate(c, "\"'\n\r\t", "") for c in ("e1", "rel", "e2")})


def rejected_triples(df: DataFrame, by_name: bool | None = None) -> DataFrame:
    """The rows that ``clean_triples`` drops, cleaned as far, with the first reason."""
    return _cleaned(df, by_name).withColumn("reason", _fault()).where("reason is not null")


def expand_conjunctions(df: DataFrame) -> DataFrame:
    """Names joined by 'and' words are split, each part with each; others pass unchanged."""
    parts = lambda c: F.filter(F.transform(F.split(c, SPLIT), tx.trim), lambda p: p != "")
    rows = df.withColumns({"_p1": parts("e1"), "_p2": parts("e2")})
    many = (F.size("_p1") > 1) | (F.size("_p2") > 1)
    keep = [c for c in df.columns if c not in ("e1", "e2")]
    split = rows.where(many).select(*keep, F.explode("_p1").alias("e1"), "_p2").select(*keep, "e1", F.explode("_p2").alias("e2"))
    split = once(split, e1=tx.clean_entity(F.col("e1")), e2=tx.clean_entity(F.col("e2"))).where("e1 != '' and e2 != ''")
    return rows.where(~many).select(df.columns).unionByName(split.select(df.columns))


def dedupe_normalized(df: DataFrame, within: tuple[str, ...] = ()) -> DataFrame:
    """Rows equal in normalised names and relation: the one with the smallest ordinal stays, as it is written there."""
    keyed = once(df, _n1=tx.normalize_entity(F.col("e1")), _n2=tx.normalize_entity(F.col("e2")))
    first = F.min(F.struct("ordinal", "e1", "e2")).alias("f")
    return keyed.groupBy(*within, "rel", "_n1", "_n2").agg(first).select(*within, "f.e1", "rel", "f.e2", "f.ordinal")


def rejected_counts(df: DataFrame) -> DataFrame:
    return rejected_triples(df).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


