"""Removal of long repeated substrings by prefix doubling of position ranks."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.common import discard, materialize, once_each, only_keys, table, text_batches, text_key
from trigrove.llm.rolling import span_hashes

#: Bytes of the strings that go, and of the shorter ones that a first pass looks for (about 50 words).
LENGTH, SHORT = 400, 250
#: Positions that are ranked together before the doubling rounds.
BLOCK = 16


def gram_of(length: int) -> int:
    """Bytes of the leading grams by which strings of ``length`` bytes are ranked first."""
    return max(1, length * 3 // 8)


def gram_hashes(data: bytes, gram: int) -> np.ndarray:
    """A 64-bit hash of every substring of ``gram`` bytes."""
    return span_hashes(data, slice(0, len(data) - gram + 1), slice(gram, len(data) + 1))


def runs_of(data: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive start positions that have the same leading gram: gram hash, its position, first and last start.

    The leading gram of a string of ``length`` bytes is the leftmost of those with the smallest hash. It depends
    on the string alone, so equal strings have equal leading grams at equal places.
    """
    gram = gram_of(length)
    if len(data) < length:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    h = gram_hashes(data, gram)
    m, w = len(h), length - gram + 1
    low = np.uint64((1 << 31) - 1)
    key = (h & ~low) | np.arange(m, dtype=np.uint64)
    padded = np.full(-(-m // w) * w, np.iinfo(np.uint64).max)
    padded[:m] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = m - w + 1
    at = (np.minimum(back[:starts], ahead[w - 1 : w - 1 + starts]) & low).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    last = np.r_[first[1:] - 1, starts - 1]
    return h[at[first]], at[first], first, last


def _runs(texts: DataFrame, length: int) -> DataFrame:
    """``(key, text, copies)`` -> one row for each run; ``whole`` names all bytes that its strings cover."""

    def run(batches):
        for pdf in batches:
            keys, copies, runs, whole = [], [], [], []
            for key, data, n in zip(pdf["key"], pdf["text"], pdf["copies"], strict=True):
                data = bytes(data)
                found = runs_of(data, length)
                size = len(found[0])
                if size:
                    keys += [bytes(key)] * size
                    copies += [n] * size
                    runs.append(found)
                    whole += [xxhash.xxh3_128_digest(data[s : e + length]) for s, e in zip(found[2].tolist(), found[3].tolist(), strict=True)]
            if keys:
                gram, at, first, last = (np.concatenate(x) for x in zip(*runs, strict=True))
                yield pd.DataFrame({"key": keys, "copies": copies, "gram": gram.view(np.int64), "whole": whole, "at": at, "first": first, "last": last})

    return texts.select("key", "text", "copies").mapInPandas(run, "key binary, copies int, gram long, whole binary, at int, first int, last int")


def _name(gram: int, size: int, block: int, part: bytes) -> bytes:
    return xxhash.xxh3_128_digest(struct.pack("<qii", gram, size, block) + part)


def _per_text(texts: DataFrame, parts: DataFrame, each, schema: str) -> DataFrame:
    """``each(data, rows)`` for each text and its rows of ``parts(key, ...)``; it gives the columns of ``schema`` as lists of lists or arrays."""
    columns = [c for c in parts.columns if c != "key"]
    of_text = parts.groupBy("key").agg(F.collect_list(F.struct(*columns)).alias("parts"))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        for pdf in batches:
            out = [each(bytes(text), rows) for text, rows in zip(pdf["text"], pdf["parts"], strict=True)]
            if out:
                yield pd.DataFrame({n: np.concatenate(found) for n, found in zip(names, zip(*out, strict=True), strict=True)})

    return texts.select("key", "text").join(of_text, "key").select("text", "parts").mapInPandas(run, schema)


def _blocks(length: int):
    """Cut a run into blocks of BLOCK distances from the gram: ``core`` names what the strings of a whole block have in
    common, ``full`` all that they cover (null for a block that the run cuts)."""

    def each(data: bytes, rows):
        out = []
        for r in rows:
            gram, at, first, last = r["gram"], r["at"], r["first"], r["last"]
            for b in range((at - last) // BLOCK, (at - first) // BLOCK + 1):
                right = at - b * BLOCK
                left = right - BLOCK + 1
                full = _name(gram, -BLOCK, b, data[left : right + length]) if left >= first and right <= last else None
                out.append((r["run"], r["open"], b, _name(gram, BLOCK, b, data[right : left + length]), full))
        return [np.array(x, dtype=kind) for x, kind in zip(zip(*out, strict=True), (np.int64, bool, np.int32, object, object), strict=True)]

    return each


QUARTERS = ("r0", "r1", "r2", "r3")


def _quarters(length: int):
    """First ranks of single positions: the names of a string's four quarters (the last may overlap)."""
    size = -(-length // 4)
    offsets = (0, size, 2 * size, length - size)

    def each(data: bytes, rows):
        first = np.array([r["first"] for r in rows])
        n = np.array([r["last"] for r in rows]) - first + 1
        at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        starts = np.concatenate([at + o for o in offsets])
        names = span_hashes(data, starts, starts + size).view(np.int64).reshape(4, -1)
        return np.repeat([r["run"] for r in rows], n), np.repeat([r["open"] for r in rows], n), at, *names

    return each


def doubled(rows: DataFrame) -> DataFrame:
    """``(run, open, at, r0..r3)``: positions with the ranks of their strings' quarters -> open positions of which the whole string is repeated.

    Each round pairs a position's rank with the rank at an offset that has doubled since the last round, sorts the
    pairs, drops positions of which the pair is unique, and gives the rest the pair as their new rank.
    """
    ranks = list(QUARTERS)
    while len(ranks) > 1:
        pair = ranks[:2]
        rows = materialize(rows)
        shared = rows.groupBy(*pair).agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("o")).where("n > 1 and o").select(*pair)
        rows = rows.join(shared, pair, "left_semi")
        half = len(ranks) // 2
        rows = rows.select("run", "open", "at", *[F.xxhash64(*ranks[2 * k : 2 * k + 2]).alias(ranks[k]) for k in range(half)])
        ranks = ranks[:half]
    return rows.where("open").select("run", "at")


def repeated_spans(texts: DataFrame, length: int) -> DataFrame:
    """``texts(key, text, copies)``, each text once -> (key, spans): byte ranges of strings of ``length`` bytes that start elsewhere too.

    ``copies`` over 1 says that the text itself is repeated. Positions are ranked by growing strings:

    1. by the leading gram (3/8 of the length), in runs of positions that share it; a gram that occurs once ends them all;
    2. runs by all the bytes that they cover; equal ones are past the threshold, and one stands for all of them, so a
       group of any size costs one row a run. Only runs that differ from others of their gram go on;
    3. BLOCK positions together, by what their strings share and by all that they cover;
    4. what is left, the borders of repeated stretches, position by position by rank pairs, see ``doubled``.

    What decides that bytes go has names of 128 bits.
    """
    text_batches(texts.sparkSession)
    everything = materialize(_runs(texts, length))
    twice = materialize(everything.groupBy("gram").agg(F.sum("copies").alias("n")).where("n > 1").select("gram"))
    runs = materialize(only_keys(everything, twice, "gram"))
    discard(everything)
    discard(twice)
    equal = runs.groupBy("gram", "whole").agg(F.sum("copies").alias("n"), F.min(F.struct("key", "at", "first", "last")).alias("rep"))
    classes = materialize(equal.select("gram", "whole", "n", "rep.*").withColumn("run", F.monotonically_increasing_id()))
    known = runs.join(classes.where("n > 1").select("gram", "whole"), ["gram", "whole"], "left_semi")
    spans = [materialize(known.where("copies = 1").select("key", "first", "last"))]
    discard(runs)
    several = classes.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.max(F.col("n") == 1).alias("o")).where("k > 1 and o").select("gram")
    reps = materialize(classes.join(several, "gram", "left_semi").select("run", (F.col("n") == 1).alias("open"), "key", "gram", "at", "first", "last"))
    discard(classes)
    needed = materialize(only_keys(texts, materialize(reps.select("key").distinct()), "key").select("key", "text"))
    named = materialize(_per_text(needed, reps, _blocks(length), "run long, open boolean, block int, core binary, full binary"))
    cores = named.groupBy("core").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("o")).where("n > 1 and o").select("core")
    fulls = named.where("full is not null").groupBy("full").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("run", "block")).alias("least")).where("n > 1")
    whole = named.where("full is not null").join(fulls, "full", "left").select("run", "open", "block", "core", F.col("n").isNotNull().alias("equal"), (F.col("least") == F.struct("run", "block")).alias("stands"))
    places = reps.select("run", "key", "at", "first", "last")
    ends = F.greatest("first", F.expr(f"at - block * {BLOCK} - {BLOCK - 1}")).alias("first"), F.least("last", F.expr(f"at - block * {BLOCK}")).alias("last")
    spans.append(materialize(whole.where("open and equal").select("run", "block").join(places, "run").select("key", *ends)))
    cut = named.where("full is null").select("run", "open", "block", "core", F.lit(False).alias("equal"), F.lit(True).alias("stands"))
    on = whole.where("not equal or stands").unionByName(cut).join(cores, "core", "left_semi").select("run", "block", (F.col("open") & ~F.col("equal")).alias("open"))
    border = materialize(on.join(places, "run").select("run", "open", "key", *ends))
    discard(named)
    left = doubled(_per_text(needed, border, _quarters(length), "run long, open boolean, at int, r0 long, r1 long, r2 long, r3 long"))
    spans.append(materialize(left.select("run", F.col("at").alias("first"), F.col("at").alias("last")).join(places.select("run", "key"), "run").select("key", "first", "last")))
    found = spans[0].unionByName(spans[1]).unionByName(spans[2])
    found = found.select("key", F.struct("first", (F.col("last") + length).alias("end")).alias("span")).distinct()
    found = materialize(found.groupBy("key").agg(F.collect_list("span").alias("spans")))
    for done in (*spans, needed, reps, border):
        discard(done)
    return found


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for s, e in sorted((r["first"], r["end"]) for r in (spans if spans is not None else ())):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _rest(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for s, e in cuts:
        kept.append(data[at:s])
        at = e
    return b"".join([*kept, data[at:]])


def _texts(docs: DataFrame, length: int) -> DataFrame:
    """Each text of ``length`` bytes or more once: key, text (bytes), copies (2 for a repeated one)."""
    rows = docs.where(F.octet_length("text") >= length).select(text_key(F.col("text")).alias("key"), F.col("text").cast("binary").alias("text"))
    return once_each(rows, "key")


def _segments(texts: DataFrame, spans: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Repeated stretches of ``texts``: (key, size), bytes of each text in all of them; and those of ``length`` bytes or more as texts of their own, with their start in the key."""

    def run(batches):
        for pdf in batches:
            out = []
            for key, text, copies, found in zip(pdf["key"], pdf["text"], pdf["copies"], pdf["spans"], strict=True):
                data = bytes(text)
                cuts = [(0, len(data))] if copies > 1 else merged(found)
                out.append((bytes(key), sum(e - s for s, e in cuts), [(bytes(key) + struct.pack(">i", s), data[s:e]) for s, e in cuts if e - s >= length], copies))
            yield pd.DataFrame(out, columns=["key", "size", "segments", "copies"])

    own = texts.join(spans, "key", "left").where("copies > 1 or spans is not null")
    found = materialize(own.select("key", "text", "copies", "spans").mapInPandas(run, "key binary, size long, segments array<struct<key:binary,text:binary>>, copies int"))
    return found.select("key", "size"), found.select(F.explode("segments").alias("s"), "copies").select("s.key", "s.text", "copies")


def _cut_texts(docs: DataFrame, length: int, short: int | None = None) -> DataFrame:
    """Each text that repeats something, once: key, removed, runs, digest of what is left, that as text, and with ``short`` the bytes in repeated strings of that length."""
    texts = _texts(docs, short or length)
    spans = repeated_spans(texts, short or length)
    size = None
    if short:
        # strings of the full length can only repeat inside stretches where shorter ones do
        size, segments = _segments(texts, spans, length)
        moved = F.transform("spans", lambda s: F.struct((s["first"] + F.col("start")).alias("first"), (s["end"] + F.col("start")).alias("end")))
        inner = repeated_spans(segments, length).withColumn("start", F.conv(F.hex(F.substring("key", 17, 4)), 16, 10).cast("int"))
        inner = inner.select(F.substring("key", 1, 16).alias("text_key"), moved.alias("spans")).withColumnRenamed("text_key", "key")
        spans = materialize(inner.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans")))

    def run(batches):
        for pdf in batches:
            out = []
            for key, text, copies, found in zip(pdf["key"], pdf["text"], pdf["copies"], pdf["spans"], strict=True):
                data = bytes(text)
                cuts = [(0, len(data))] if copies > 1 and len(data) >= length else merged(found)
                rest = _rest(data, cuts)
                out.append((bytes(key), sum(e - s for s, e in cuts), len(cuts), hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore")))
            yield pd.DataFrame(out, columns=["key", "removed", "runs", "digest", "rest"])

    own = texts.join(spans, "key", "left").where("copies > 1 or spans is not null")
    cut = own.select("key", "text", "copies", "spans").mapInPandas(run, "key binary, removed long, runs long, digest string, rest string")
    return cut if size is None else size.join(cut, "key", "left")


def suffix_array_dedup(docs: DataFrame, length: int = LENGTH, short: int | None = None) -> DataFrame:
    """For each row of ``docs(doc_id, text, ...)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes if a string of ``length`` bytes that covers it also starts anywhere else in the column; matches
    never cross rows, all are judged on the input. Null and empty texts: no bytes, nothing removed. Rows with
    equal texts of ``length`` bytes or more lose all bytes, repeated rows included. A null doc_id is carried.
    With ``short`` (less than ``length``) strings of that size are looked for first, and a column n_repeated says how
    many bytes they cover. Other columns are ignored. An empty table gives an empty result.
    """
    cut = _cut_texts(docs, length, short).select("key", "removed", "runs", "digest", *(["size"] if short else []))
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("key"), F.octet_length(data).cast("long").alias("n_bytes"), F.sha2(data, 256).alias("whole"))
    zero = F.lit(0).cast("long")
    more = [F.coalesce("size", zero).alias("n_repeated")] if short else []
    return own.join(cut, "key", "left").select("doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("runs", zero).alias("n_spans"), F.coalesce("digest", "whole").alias("kept_sha256"), *more)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` and ``n_chars`` counted anew.

    Bytes of a character that a cut splits go with it. Documents that lose all their text stay as empty texts; null texts stay null.
    """
    cut = _cut_texts(docs, length).select("key", "rest")
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("key")).join(cut, "key", "left")
    new = F.col("row").withField("text", F.coalesce("rest", "row.text"))
    if "n_chars" in docs.columns:
        new = new.withField("n_chars", F.when(F.col("rest").isNull(), F.col("row.n_chars")).otherwise(F.length("rest").cast(docs.schema["n_chars"].dataType)))
    return rows.select(new.alias("row")).select("row.*")


def op10_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array_dedup(table(spark, sf_dir, "documents"), LENGTH, SHORT)
