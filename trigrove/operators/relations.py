"""Relations between mentions, merging of techniques."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import lexicon as lx
from trigrove.functions import text as tx
from trigrove.functions.once import let, once
from trigrove.operators.sentences import SENT, beside_text

PRIORITY = ("few_shot", "zero_shot", "dep", "template", "rule")


def compat_table(spark: SparkSession) -> DataFrame:
    rows = [(a, b, rel) for (a, b), rels in lx.TYPE_COMPAT.items() for rel in rels]
    return spark.createDataFrame(rows, "e1_type string, e2_type string, relation string")


def type_compat_relations(pairs: DataFrame) -> DataFrame:
    """Pairs of types (e1_type, e2_type) with each relation they allow; pairs that allow none go."""
    return pairs.join(F.broadcast(compat_table(pairs.sparkSession)), ["e1_type", "e2_type"])


def _compat(a: Column, b: Column) -> Column:
    """The allowed relations of two types as an array; empty where none is listed."""
    out = F.lit(None).cast("array<string>")
    for (x, y), rels in lx.TYPE_COMPAT.items():
        if rels:
            out = F.when((a == x) & (b == y), F.array(*map(F.lit, rels))).otherwise(out)
    return F.coalesce(out, F.array().cast("array<string>"))


def match_relation(between: Column, allowed: Column) -> Column:
    """The first relation whose words stand between, within 8 characters or at the start; else the only allowed one within 6.

    An empty list of allowed relations allows all.
    """
    free, size = F.size(allowed) == 0, F.length(between)
    tests = [F.when((free | F.array_contains(allowed, rel)) & between.rlike(words) & ((size <= 8) | between.rlike(f"^(?:{words})")), rel) for rel, words in lx.BETWEEN_WORDS]
    return F.coalesce(*tests, F.when((F.size(allowed) == 1) & (size <= 6), F.get(allowed, 0)))


MENTION = ("m_idx", "start", "end", "text", "etype")


def _pairs(mentions: DataFrame, sentences: DataFrame, how, between) -> DataFrame:
    """Pairs of mentions of one sentence, the first one ending before the second, with the text between.

    ``how`` tests two mentions, ``between`` the text (trimmed or not, as it returns it, null for no pair), both
    inside the sentence's array, so that only pairs that pass become rows.
    """
    packed = beside_text(mentions, sentences, F.struct(*MENTION))
    text = lambda a, b: F.substring("sent_text", a["end"] + 1, b["start"] - a["end"])
    pair = lambda a: lambda b: F.struct(a.alias("a"), b.alias("b"), between(text(a, b)).alias("between"))
    after = lambda a: F.filter("ms", lambda b: how(a, b) & (a["end"] <= b["start"]))
    met = F.flatten(F.transform("ms", lambda a: F.transform(after(a), pair(a))))
    rows = packed.select(*SENT, F.inline(F.filter(met, lambda p: p["between"].isNotNull())))
    return rows.select(*SENT, *[F.col(f"{p}.{c}").alias(f"{p}_{c}") for p in ("a", "b") for c in MENTION], "between")


def _matched(rows: DataFrame) -> DataFrame:
    """Pairs with a relation that the words between and the types allow."""
    typed = once(rows, allowed=_compat(F.col("a_etype"), F.col("b_etype")))
    named = once(typed, rel=match_relation(F.col("between"), F.col("allowed"))).where("rel is not null")
    return named.select(*SENT, "a_m_idx", "b_m_idx", F.col("a_text").alias("e1"), "rel", F.col("b_text").alias("e2"), F.lit("rule").alias("technique"))


def _short(most: int, ends: str | None = None):
    """The trimmed text if it has 1 to ``most`` characters and no ``ends``."""
    fine = lambda t: F.length(t).between(1, most) & (~t.rlike(ends) if ends else F.lit(True))
    return lambda between: let(tx.trim(between), lambda t: F.when(fine(t), t))


def pair_relations(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Relations of mention pairs without dates, by the words between them (1 to 25 characters of one clause)."""
    undated = lambda a, b: (a["m_idx"] < b["m_idx"]) & (a["etype"] != "时间") & (b["etype"] != "时间")
    rows = _pairs(mentions, sentences, undated, _short(25, tx.CLAUSE_END))
    return _matched(rows)


def time_pair_relations(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Relations of a mention and a later date, by at most 15 characters between them."""
    rows = _pairs(mentions, sentences, lambda a, b: (a["etype"] != "时间") & (b["etype"] == "时间"), _short(15))
    return _matched(rows)


def typed_template_pairs(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Pairs with types and words between them as a template asks, and a relation that the types allow.

    The template table is fixed and small; it is tested as one array on each pair, with no join.
    """
    rows = _pairs(mentions, sentences, lambda a, b: a["m_idx"] != b["m_idx"], lambda t: F.when(~t.rlike("[。！？；;]"), t))
    whole = F.concat("between", "b_text")
    at = F.expr("locate(b_text, concat(between, b_text))")
    rows = once(rows.withColumn("mid", whole.substr(F.lit(1), at - 1)).where("mid != ''"), allowed=_compat(F.col("a_etype"), F.col("b_etype")))
    tests = []
    for k, (words, rel, one, two) in enumerate(lx.PAIR_TEMPLATES):
        test = F.array_contains("allowed", rel) & reduce(lambda x, y: x | y, [F.contains("mid", F.lit(w)) for w in words])
        test = test & (F.col("a_etype") == one) if one else test
        test = test & (F.col("b_etype") == two) if two else test
        tests.append(F.when(test, F.struct(F.lit(k).alias("tmpl_id"), F.lit(rel).alias("rel"))))
    hits = rows.select(*SENT, "a_m_idx", "b_m_idx", "a_text", "b_text", F.explode(F.array_compact(F.array(*tests))).alias("t"))
    return hits.select(*SENT, "t.tmpl_id", "a_m_idx", "b_m_idx", F.col("a_text").alias("e1"), "t.rel", F.col("b_text").alias("e2"), F.lit("template").alias("technique"))


def _first_triple(pattern: str, relation: str, types: tuple) -> Column:
    """The first three mentions of a sentence, by number, that make the template's text when put into it, as (e1, rel, e2); null if there are none."""
    typed = lambda t, test: F.filter("ms", lambda m: (m["etype"] == t) & test(m)) if t else F.filter("ms", test)
    filled = lambda a, b, c: F.replace(F.replace(F.replace(F.lit(pattern), F.lit("{e1}"), a["text"]), F.lit("{e2}"), b["text"]), F.lit("{e3}"), c["text"])
    second = lambda a: typed(types[1], lambda b: (b["start"] > a["end"]) & (b["m_idx"] > a["m_idx"]))
    third = lambda a, b: typed(types[2], lambda c: (c["start"] > a["end"]) & (c["m_idx"] > b["m_idx"]) & (c["start"] >= b["start"]) & F.contains("sent_text", filled(a, b, c)))
    hit = lambda a, b: lambda c: F.struct(a["m_idx"].alias("x"), b["m_idx"].alias("y"), c["m_idx"].alias("z"), a["text"].alias("e1"), F.lit(relation).alias("rel"), b["text"].alias("e2"))
    hits = F.transform(typed(types[0], lambda a: F.lit(True)), lambda a: F.flatten(F.transform(second(a), lambda b: F.transform(third(a, b), hit(a, b)))))
    return F.array_min(F.flatten(hits))


def typed_template_triples(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Three mentions in order whose texts, put into a template, stand in the sentence: the first ones of each template give (e1, rel, e2).

    The fixed templates are tried on each sentence's array of mentions; no mention is joined with another.
    """
    packed = beside_text(mentions, sentences, F.struct(*MENTION))
    found = [F.struct(F.lit(k).alias("tmpl_id"), _first_triple(pattern, rel, types).alias("t")) for k, (pattern, rel, *types) in enumerate(lx.TRIPLE_TEMPLATES)]
    hits = packed.select(*SENT, F.inline(F.filter(F.array(*found), lambda x: x["t"].isNotNull())))
    return hits.select(*SENT, "tmpl_id", "t.e1", "t.rel", "t.e2", F.lit("template").alias("technique"))


def _name(t: Column, tokens: Column, generic) -> Column:
    """A token's name: itself, cleaned, if it is an entity; else joined with its compound children; else itself; null if that can be none."""
    valid = lambda c: F.when(tx.is_valid_mention(c, generic), c)
    parts = F.filter(tokens, lambda k: ((k["dep"] == "compound") & (k["head_i"] == t["tok_i"])) | (k["tok_i"] == t["tok_i"]))
    whole = lambda ps: F.when(F.size(ps) > 1, let(tx.clean_mention(F.array_join(F.transform(ps, lambda p: p["text"]), "")), valid))
    plain = let(tx.trim(t["text"]), lambda c: F.when(c.rlike(f"[{tx.CJK}]") & (F.length(c) >= 2) & ~c.isin(*generic), valid(c)))
    return F.when(t["ent_type"].isin(*lx.MODEL_LABELS), let(tx.clean_mention(t["text"]), valid)).otherwise(F.coalesce(let(parts, whole), plain))


def svo_relations(tokens: DataFrame, generic=lx.GENERIC_NOUNS) -> DataFrame:
    """Subject, verb and object of annotated tokens -> (e1, rel, e2), with the first date and place of the verb beside new ones.

    ``tokens`` has doc_id, sent_idx, tok_i, text, lemma, pos, dep, head_i, ent_type. Each sentence's tokens are one
    array, in which a verb of the fixed lexicon finds its subjects, objects, dates and places; only those get names.
    ``generic``: nouns that are no names. ``tok_i`` is unique in its sentence.
    """
    words = F.create_map(*[F.lit(x) for pair in lx.VERB_RELATIONS.items() for x in pair])
    rel = F.when(F.col("pos") == "VERB", F.coalesce(F.try_element_at(words, F.col("lemma")), F.try_element_at(words, F.col("text"))))
    token = F.struct("tok_i", "text", "dep", "head_i", F.coalesce("ent_type", F.lit("")).alias("ent_type"), rel.alias("rel"))
    packed = tokens.groupBy(*SENT).agg(F.array_sort(F.collect_list(token)).alias("ts"))
    packed = packed.where(F.exists("ts", lambda t: t["rel"].isNotNull()))
    named = lambda t: F.struct(t["tok_i"].alias("i"), _name(t, F.col("ts"), generic).alias("name"))
    child = lambda v, test: F.transform(F.filter("ts", lambda t: (t["head_i"] == v["tok_i"]) & test(t)), named)
    some = lambda xs: F.filter(xs, lambda x: x["name"].isNotNull())
    # the first one counts, with a name or without
    beside = lambda v, labels: F.get(child(v, lambda t: t["dep"].startswith("obl") & t["ent_type"].isin(*labels)), F.lit(0))["name"]
    verbs = F.transform(F.filter("ts", lambda t: t["rel"].isNotNull()), lambda v: F.struct(
        v["tok_i"].alias("verb"), v["rel"].alias("rel"), some(child(v, lambda t: t["dep"].isin("nsubj", "nsubj:pass"))).alias("ss"), some(child(v, lambda t: t["dep"].isin("obj", "dobj", "attr"))).alias("os"),
        beside(v, lx.TIME_LABELS).alias("time"), beside(v, lx.PLACE_LABELS).alias("place"),
    ))
    met = packed.select(*SENT, F.inline(verbs)).select(*SENT, "verb", "rel", F.explode("ss").alias("s"), "os", "time", "place").select("*", F.explode("os").alias("o")).where("s.name != o.name")
    # the first mention of a triple in a document counts
    order = F.struct("sent_idx", "verb", F.col("s.i").alias("s_i"), F.col("o.i").alias("o_i"), "time", "place")
    fresh = met.groupBy("doc_id", F.col("s.name").alias("s"), "rel", F.col("o.name").alias("o")).agg(F.min(order).alias("at"))
    fact = lambda r, e2: F.struct(F.col("s").alias("e1"), r.alias("rel"), e2.alias("e2"))
    facts = F.array(fact(F.col("rel"), F.col("o")), fact(F.lit("成立"), F.col("at.time")), fact(F.lit("位于"), F.col("at.place")))
    rows = fresh.select("doc_id", F.col("at.sent_idx").alias("sent_idx"), F.inline(facts)).where("e2 is not null")
    return rows.groupBy("doc_id", "e1", "rel", "e2").agg(F.min("sent_idx").alias("sent_idx")).withColumn("technique", F.lit("dep"))


def merge_by_priority(triples: DataFrame) -> DataFrame:
    """Per chunk and triple, the row of the first technique in PRIORITY (unknown ones last), then of the smallest ordinal."""
    rank = F.coalesce(*[F.when(F.col("technique") == t, k) for k, t in enumerate(PRIORITY)], F.lit(len(PRIORITY)))
    best = F.min(F.struct(rank.alias("rank"), "ordinal", "technique")).alias("b")
    return triples.groupBy("doc_id", "chunk_idx", "e1", "rel", "e2").agg(best).select("doc_id", "chunk_idx", "e1", "rel", "e2", "b.technique", "b.ordinal")


def technique_stats(triples: DataFrame) -> DataFrame:
    return triples.groupBy("technique").agg(F.count(F.lit(1)).alias("n"))


def needs_model(docs: DataFrame, fast: DataFrame, least: int = 3) -> DataFrame:
    """Documents with fewer than ``least`` fast triples."""
    counts = fast.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    return docs.join(counts, "doc_id", "left").where(F.coalesce("_n", F.lit(0)) < least).drop("_n")
