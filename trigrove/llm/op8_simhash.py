"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

from hashlib import md5
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trigrove.llm.common import discard, materialize, once_each, only_keys, table, text_batches, text_key
from trigrove.llm.components import connected_components

SEED, CHUNK = 42, 1 << 15


def fingerprint(text: str | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash: A-Z lower-cased, ASCII white space splits, shingles of ``width`` words with repeats.

    Fewer words than ``width``: the whole sequence is the one shingle. No words, or null: 0.
    """
    words = (text or "").encode().lower().split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= width:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)).tolist()
        starts = [0] + [e + 1 for e in ends[: n - width]]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[s:e], SEED) for s, e in zip(starts, ends[width - 1 :], strict=True)]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.array(hashes[at : at + CHUNK], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int.from_bytes(bits.tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, text)`` -> ``(doc_id, key, fp)``: identity of the text and the fingerprint as a signed long."""

    text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t, width) for t in pdf["text"]], dtype=np.uint64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "key": pdf["key"], "fp": fps.view(np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").mapInPandas(run, "doc_id long, key binary, fp long")


def _signed(mask: int) -> int:
    # -2^63 has no literal of its own in SQL
    return mask - (1 << 64) if mask >> 63 else mask


def _literal(masks: list[int]) -> Column:
    return F.expr("array(" + ", ".join(("(-9223372036854775807L - 1L)" if m == 1 << 63 else f"{_signed(m)}L") for m in masks) + ")")


ONES = [0] + [1 << i for i in range(64)]
TWOS = [(1 << i) | (1 << j) for half in (range(32), range(32, 64)) for i, j in combinations(half, 2)]
HALF = [0] + [1 << i for i in range(32)]


def _spread(distinct: DataFrame) -> DataFrame:
    """As many parts as shuffles have: each row is about to become very many, which a plan by present size does not see."""
    return distinct.repartition(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")


def _with_company(distinct: DataFrame) -> DataFrame:
    """Fingerprints of which one 32-bit half is within one bit of the same half of another one.

    Two fingerprints at 3 or fewer differing bits have a half in which they differ in at most one bit, so no
    fingerprint that has a link is lost. Only counts are shuffled.
    """
    def keys(fp):
        left, right = F.shiftrightunsigned(fp, 32), fp.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
        return left, right.bitwiseOR(F.lit(1 << 33).cast("long"))

    left, right = keys(F.col("fp"))
    balls = _spread(distinct).select(F.explode(F.array(left, right)).alias("k")).select(F.explode(_literal(HALF)).alias("m"), "k").select(F.col("k").bitwiseXOR(F.col("m")).alias("k"))
    shared = balls.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
    own = distinct.select("fp", F.explode(F.array(left, right)).alias("k"))
    return own.join(shared, "k", "left_semi").select("fp").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """``distinct(fp)`` -> ``(a, b)``: links that connect just what 3 or fewer differing bits connect.

    The radius 3 is split as 1 + 2: every fingerprint emits its variants within one bit, one with an odd number
    of bits also those that flip two bits of the same half. Fingerprints at distance 3 differ in parity and have
    two of their three differing bits in one half, so they meet at a variant; those at distance 1 or 2 meet
    within one bit. All that meet at a variant v are linked to its smallest fingerprint within one bit of v:
    that is at most 1 + 2 bits away, which a last test confirms. A variant has at most 65 + 992 fingerprints
    around it, however large the input is, and no pairs within a group are made.
    """
    alone = _spread(distinct).select("fp", (F.bit_count("fp") % 2 == 1).alias("odd"))
    mask = F.explode(F.when(F.col("odd"), _literal(ONES + TWOS)).otherwise(_literal(ONES)))
    met = alone.select("fp", mask.alias("m")).select(F.col("fp").bitwiseXOR(F.col("m")).alias("v"), "fp", (F.bit_count("m") <= 1).alias("near"))
    groups = met.groupBy("v").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("a"), F.collect_list("fp").alias("all"))
    pairs = groups.where("a is not null and size(all) > 1").select("a", F.explode("all").alias("b")).where("a != b")
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3).distinct()


def _components(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key, fp, root (of the component's fingerprints) and component_id of each row."""
    own = materialize(fingerprints(docs, width))
    distinct = own.groupBy("fp").agg(F.min("doc_id").alias("least"))
    survivors = materialize(_with_company(distinct.select("fp")))
    parts = connected_components(links(survivors))
    joined = distinct.join(parts, distinct["fp"] == parts["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    roots = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(joined.join(roots, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, width: int = 3) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links (3 or fewer differing bits) reach, itself included. Null and
    empty texts have fingerprint 0 and link like others. Equal fingerprints are one node, so a group of copies
    of any size costs one node. A null doc_id keeps its row and is never a component_id (null if the component
    has no other). Repeated rows give repeated rows; an empty table gives an empty result; other columns are ignored.
    """
    return _components(docs, width).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Near-duplicate texts: words of a shingle, and least similarity as a fraction.
WIDTH, SIMILAR = 5, (4, 5)
#: Partners of one text in one salted part.
SALT = 256
#: Representatives at a hash in the first round (twice as many in each further one), and rounds of them while more than MANY pairs for each hit are left; then all that is left is compared.
REPRESENTATIVES, ROUNDS, MANY = 8, 6, 8


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words (fewer words: the whole sequence; none: empty), A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    n, width = len(words), min(width, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    hashes = own[: n - width + 1]
    for k in range(1, width):
        hashes = _mix(hashes) + own[k : n - width + 1 + k]
    return np.unique(_mix(hashes))


def _prefix(n: int) -> int:
    """How many of the first of ``n`` sorted hashes move: of those of two similar sets ``n // 10 + 1`` (by the smaller n) or more are equal.

    A similar set lacks at most a fifth of the hashes, so among the first of both, a fifth and k more, k are shared.
    """
    num, den = SIMILAR
    return n - -(-n * num // den) + n // 10 + 1 if n else 0


def shingled(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` -> doc_id, key (identity of the text), node (of its set of shingles), n (its size), prefix (its smallest hashes, see ``_prefix``)."""

    text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            nodes, sizes, firsts = [], [], []
            for text in pdf["text"]:
                s = shingle_set(text, WIDTH)
                nodes.append(md5(s.tobytes()).digest())
                sizes.append(len(s))
                firsts.append(s[: _prefix(len(s))].view(np.int64))
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "key": pdf["key"], "node": nodes, "n": np.array(sizes, np.int32), "prefix": firsts})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), "text").mapInPandas(run, "doc_id long, key binary, node binary, n int, prefix array<long>")


def in_company(nodes: DataFrame) -> DataFrame:
    """``nodes(node, n, prefix)``, a row for each set -> node of the sets that share as many of their first hashes with others as with a similar partner they must.

    Exact: no set with a partner goes. Hashes of one set alone never move beyond counts.
    """
    num, den = SIMILAR
    # the partner may be smaller by a fifth
    enough = F.expr(f"(n * {num} + {den - 1}) div {den} div 10 + 1")
    rows = nodes.where("n > 0").select("node", "n", F.explode("prefix").alias("t"))
    shared = materialize(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("t"))
    hits = only_keys(rows, shared, "t").groupBy("node").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("c"))
    out = materialize(hits.where(F.col("c") >= enough).select("node"))
    discard(shared)
    return out


def rare_hits(sets: DataFrame) -> DataFrame:
    """``sets(node, s)`` -> (node, n, own, at, t): the rarest hashes of each set that others have too, with their places, and the count of those that no other has.

    Two similar sets share one at least of the first fifth and one more, in any order that holds for all sets. Here the
    rarest come first, so a set with more than a fifth of its own has no hit, and frequent hashes (a passage that very
    many texts have) only meet texts that have little else.
    """
    num, den = SIMILAR
    rows = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("t"))
    counts = materialize(rows.groupBy("t").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    ranked = only_keys(rows, counts, "t", ["c"]).groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("c", "t"))).alias("s"))
    # a set's own hashes stand before all others
    ranked = ranked.withColumn("own", F.col("n") - F.size("s"))
    first = F.slice("s", 1, F.greatest(F.col("n") - F.expr(f"(n * {num} + {den - 1}) div {den}").cast("int") + 1 - F.col("own"), F.lit(0)))
    hits = materialize(ranked.select("node", "n", "own", F.posexplode(first).alias("at", "h")).select("node", "n", "own", (F.col("own") + F.col("at")).alias("at"), F.col("h.t").alias("t")))
    discard(counts)
    return hits


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of ``wanted(node, key)``: node, s."""
    text_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"node": pdf["node"], "s": [shingle_set(t, WIDTH).view(np.int64) for t in pdf["text"]]})

    texts = only_keys(docs.select(text_key(F.col("text")).alias("key"), "text"), wanted, "key", ["node"]).dropDuplicates(["node"])
    return materialize(texts.select("node", "text").mapInPandas(run, "node binary, s array<long>"))


def similar_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``(a, b)`` of ``pairs`` whose sets ``(node, s)`` have a Jaccard similarity of at least SIMILAR.

    A set with very many partners is dealt to one part for every SALT of them.
    """

    def side(now: DataFrame, end: str) -> DataFrame:
        parts = pairs.groupBy(end).agg(F.ceil(F.count(F.lit(1)) / SALT).cast("int").alias("parts"))
        dealt = now.join(parts, end).withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.col("parts")).cast("int"))
        held = parts.select(end, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")).join(sets.select(F.col("node").alias(end), F.col("s").alias(end + "_s")), end)
        return dealt.join(held, [end, "salt"]).drop("parts", "salt")

    both, (num, den) = side(side(pairs, "a"), "b"), SIMILAR
    shared, total = F.size(F.array_intersect("a_s", "b_s")), F.size("a_s") + F.size("b_s")
    return both.where(shared * (num + den) >= total * num).select("a", "b")


def _sized(pairs: DataFrame) -> DataFrame:
    """``(x, y)``, structs of n, at and node, -> distinct (a, b), a < b, of which sizes and places allow SIMILAR.

    No hash before the first one that two sets share is shared, so it is at a place from which enough are left in both.
    """
    num, den = SIMILAR
    after = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    fit = pairs.where((after * (num + den) >= (F.col("x.n") + F.col("y.n")) * num) & (F.col("x.node") != F.col("y.node")))
    return fit.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def in_classes(hits: DataFrame, parts: DataFrame) -> DataFrame:
    """``hits`` with the class of each set in ``parts(node, component)`` -> (t, root, size, m), of hashes that several classes have; size is the class's."""
    sized = parts.join(parts.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "component")
    rows = hits.join(sized, "node", "left").select("t", F.coalesce("component", "node").alias("root"), F.coalesce("size", F.lit(1)).alias("size"), F.struct("n", "own", "at", "node").alias("m"))
    several = rows.groupBy("t").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("t")
    return materialize(rows.join(several, "t", "left_semi"))


def crossing(rows: DataFrame) -> int:
    """How many pairs of sets of two classes meet at the hashes of ``in_classes``, one at several hashes counted at each."""
    counts = rows.groupBy("t", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("t").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("x"))
    return (counts.agg(F.sum("x")).first()[0] or 0) // 2


def first_pairs(rows: DataFrame, order: int) -> DataFrame:
    """The sets of ``in_classes`` with representatives of another class, no smaller than theirs, at each hash: pairs in proportion to the rows.

    The representatives are those with the least share of hashes that nobody else has, so of the edits of one text those
    with the fewest edits, which are near to most others. Their number doubles from round to round: a set that is hard
    to link is tried with more and more of a class, and one that is linked with no more.
    """
    least = (F.col("m.own") / F.col("m.n"), F.xxhash64("m.node"), F.col("m.node"))
    rank = F.row_number().over(Window.partitionBy("t").orderBy(*least))
    chosen = rows.withColumn("rank", rank).where(F.col("rank") <= REPRESENTATIVES << order).select("t", F.col("root").alias("other"), F.col("size").alias("most"), F.col("m").alias("x"))
    return _sized(rows.join(chosen, "t").where("root != other and size <= most").select("x", F.col("m").alias("y")))


def other_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of two classes that share a hash of ``in_classes``.

    Classes meet first, so that members of one class are never paired with one another.
    """
    num, den = SIMILAR
    roots = rows.groupBy("t", "root").agg(F.max(F.col("m.n") - F.col("m.at")).alias("after"), F.min("m.n").alias("n"))
    there = roots.select("t", F.col("root").alias("other"), F.col("after").alias("o_after"), F.col("n").alias("o_n"))
    # what no pair of the two classes can pass, see ``_sized``
    may = (F.least("after", "o_after") * (num + den) >= (F.col("n") + F.col("o_n")) * num) & (F.col("root") < F.col("other"))
    met = roots.join(there, "t").where(may).select("t", "root", "other")
    met = met.join(rows.withColumnRenamed("m", "x"), ["t", "root"]).join(rows.select("t", F.col("root").alias("other"), F.col("m").alias("y")), ["t", "other"])
    return _sized(met.select("x", "y"))


def near_links(docs: DataFrame, own: DataFrame) -> DataFrame:
    """``own(key, node, n, prefix)`` of ``docs`` -> (node, component) of the sets that a Jaccard similarity of SIMILAR or more links, exactly.

    Rounds of representatives connect large groups of near copies first, as long as that saves pairs. Whatever pair of
    two classes is then left is compared, so no link is lost that joins classes.
    """
    left = in_company(once_each(own.select("node", "n", "prefix"), "node"))
    sets = shingle_sets(docs, materialize(own.join(left, "node", "left_semi").groupBy("node").agg(F.min("key").alias("key"))))
    hits = rare_hits(sets)
    many = MANY * hits.count()
    rows, tried, links, found = in_classes(hits, hits.select("node", F.col("node").alias("component")).distinct()), None, None, None
    for order in range(ROUNDS + 1):
        # a round without a link is no use
        whole = order == ROUNDS or (found is not None and found.isEmpty()) or crossing(rows) <= many
        pairs = other_pairs(rows) if whole else first_pairs(rows, order)
        pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs)
        found = materialize(similar_pairs(sets, pairs))
        links = links.unionByName(found) if links is not None else found
        parts = connected_components(links)
        if whole:
            break
        tried = tried.unionByName(pairs) if tried is not None else pairs
        discard(rows)
        rows = in_classes(hits, parts)
    return parts


def near_components(docs: DataFrame) -> DataFrame:
    """doc_id, key and root (the smallest node that verified links reach) of each row; one node for all rows with equal sets of shingles."""
    own = materialize(shingled(docs))
    return own.join(near_links(docs, own), "node", "left").select("doc_id", "key", F.coalesce("component", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest doc_id, of those the one with the smallest identity of its text.

    Texts are linked at a Jaccard similarity of 0.8 or more over their sets of five-word shingles, all of them (see
    ``in_company``, ``rare_hits`` and ``other_pairs``); texts without words are equal. A row without a doc_id stays only
    if no row of its group has one. Rows that are equal in both are one.
    """
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    kept = materialize(near_components(docs).groupBy("root").agg(F.min_by(F.struct("doc_id", "key"), order).alias("k")).select("k.*"))
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"))
    met = rows.alias("r").join(kept.alias("k"), (F.col("r.key") == F.col("k.key")) & F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")), "left_semi")
    return met.dropDuplicates(["key", "doc_id"]).select("row.*")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))
