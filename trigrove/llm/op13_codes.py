"""Vector code compression: product codes whose entries are found with bounds of their own round."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.llm.bounds import SLACK, floor_means, lists, matrix, moved_since, scaled, slot_sums, squared
from trigrove.llm.common import discard, materialize, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Sums of so many labels are sent to all tasks; more are joined by a shuffle.
BROADCAST_LABELS = 100_000

STATE = "q array<int>, codes array<int>, upper array<double>, lower array<double>, upper_at array<int>, lower_at array<int>, error long, scans long"


def encode(q: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, upper_at: np.ndarray, lower_at: np.ndarray, history: np.ndarray, exact: bool = False):
    """The nearest entry of one part's codebook for each row, ties to the lower index.

    ``upper`` is the distance to the row's entry as measured in round ``upper_at``, ``lower`` the least one to any
    other as measured in round ``lower_at`` (-1: never). Since then they have changed by at most the net displacement
    of the entry, and by the largest one of the others. Rows that this leaves in doubt (all, with ``exact``) measure
    their entry anew, and those still in doubt all entries. Changes all arrays of the state; returns squared
    distances (0 where not measured) and how many distances each row measured.
    """
    now, book, drift = len(history) - 1, history[-1], moved_since(history)
    order = np.sort(drift, axis=1)
    most, second = order[:, -1], order[:, -2] if len(book) > 1 else np.zeros(len(order))
    found, scans = np.zeros(len(q), np.int64), np.zeros(len(q), np.int64)

    def doubtful(at: np.ndarray) -> np.ndarray:
        c, t = code[at], lower_at[at]
        others = np.where(drift[t, c] == most[t], second[t], most[t])
        return at[lower[at] - others <= (upper[at] + drift[upper_at[at], c]) * (1 + SLACK) + SLACK]

    known = np.flatnonzero(lower_at >= 0)
    again = known if exact else doubtful(known)
    found[again] = squared(q[again], book[code[again]])
    upper[again], upper_at[again] = np.sqrt(found[again].astype(np.float64)), now
    scans[again] += 1
    rescan = np.concatenate([np.flatnonzero(lower_at < 0), doubtful(again)])
    for at in np.array_split(rescan, max(1, -(-len(rescan) // 4096))):
        d, rows = squared(q[at][:, None, :], book[None]), np.arange(len(at))
        code[at] = d.argmin(axis=1)
        found[at] = d[rows, code[at]]
        d[rows, code[at]] = np.iinfo(np.int64).max
        upper[at], lower[at] = np.sqrt(found[at].astype(np.float64)), np.sqrt(d.min(axis=1).astype(np.float64))
        upper_at[at], lower_at[at] = now, now
        scans[at] += len(book)
    return found, scans


def step(points: DataFrame, history: np.ndarray, exact: bool = False) -> DataFrame:
    """One assignment of all parts of all points, in place: no row leaves its partition. ``history[round, part, entry, component]``."""
    parts = history.shape[1]
    keep = [c for c in points.columns if c in ("vec_id", "label")]
    schema = ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in keep) + ", " + STATE

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            q = matrix(batch, "q", np.int64).reshape(len(batch), parts, -1)
            if "codes" in batch.schema.names:
                state = [matrix(batch, c, t).copy() for c, t in (("codes", np.int64), ("upper", np.float64), ("lower", np.float64), ("upper_at", np.int64), ("lower_at", np.int64))]
                scans = batch.column("scans").to_numpy().copy()
            else:
                state = [np.full((len(q), parts), start, kind) for start, kind in ((0, np.int64), (0, np.float64), (0, np.float64), (-1, np.int64), (-1, np.int64))]
                scans = np.zeros(len(q), np.int64)
            error = np.zeros(len(q), np.int64)
            for p in range(parts):
                own = [np.ascontiguousarray(s[:, p]) for s in state]
                found, n = encode(q[:, p], *own, history[:, p], exact)
                for s, x in zip(state, own, strict=True):
                    s[:, p] = x
                error, scans = error + found, scans + n
            codes, upper, lower, upper_at, lower_at = state
            arrays = [batch.column("q"), lists(codes.astype(np.int32)), lists(upper), lists(lower), lists(upper_at.astype(np.int32)), lists(lower_at.astype(np.int32)), pa.array(error), pa.array(scans)]
            names = ["q", "codes", "upper", "lower", "upper_at", "lower_at", "error", "scans"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *arrays], names=[*keep, *names])

    return points.mapInArrow(run, schema)


def _sums(state: DataFrame, parts: int, entries: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry."""

    def own(batch):
        slot = matrix(batch, "codes", np.int64) + np.arange(parts) * entries
        return slot.reshape(-1), matrix(batch, "q", np.int64).reshape(-1, width), np.ones(slot.size, np.int64)

    sums, counts = slot_sums(state, ["q", "codes"], parts * entries, width, own)
    return sums.reshape(parts, entries, width), counts.reshape(parts, entries)


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """``vectors(vec_id, embedding, label, ...)`` -> the points with codes, error and scans (measured distances), and the codebooks of all rounds.

    All vectors have the length of the one with the smallest vec_id among those that ``parts`` divides; others
    take no part, and neither do vectors with null or non-finite components, or with one of 2**27 or more when
    scaled (their squared distances fit no long). A null vec_id is coded, but starts no entry. Repeated rows count
    each, also among the first entries (the smaller vector first). With fewer than ``entries`` usable rows there
    are as many entries; with none the result is empty. Other columns are ignored.
    """
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label").where(F.size("embedding") % parts == 0).where(F.size("embedding") > 0)
    usable = scaled(own, scale, ["vec_id", "label"])
    first = usable.where("vec_id is not null").orderBy("vec_id", "q").select(F.size("q").alias("n")).limit(1).collect()
    schema = f"vec_id long, label {vectors.schema['label'].dataType.simpleString()}, {STATE}"
    if not first:
        return spark.createDataFrame([], schema), np.zeros((1, parts, 0, 1), np.int64)
    dim = first[0]["n"]
    points = materialize(usable.where(F.size("q") == dim))
    start = np.array([r["q"] for r in points.where("vec_id is not null").orderBy("vec_id", "q").select("q").limit(entries).collect()], np.int64)
    history = start.reshape(len(start), parts, dim // parts).transpose(1, 0, 2)[None]
    for _ in range(rounds):
        points, before = materialize(step(points, history)), points
        discard(before)
        history = np.concatenate([history, floor_means(*_sums(points, *history.shape[1:]), history[-1])[None]])
    return materialize(step(points, history, exact=True)), history


def compressed(vectors: DataFrame, **settings) -> DataFrame:
    """Each usable vector's code (two hex digits a part), its error, the error summed over equal labels, and the codebooks' hash; see ``compress``."""
    points, history = compress(vectors, **settings)
    books = ",".join(map(str, history[-1].reshape(-1).tolist()))
    # at most 256 entries: an index has two digits
    code = F.lower(F.array_join(F.transform("codes", lambda c: F.lpad(F.hex(c), 2, "0")), ""))
    sums = points.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    sums = F.broadcast(sums) if sums.count() <= BROADCAST_LABELS else sums
    met = points.join(sums, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", code.alias("code"), "error", "label_error", F.lit(hashlib.sha256(books.encode()).hexdigest()).alias("codebooks_sha256"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    """Every round as a table of its own: distances of parts to entries, the nearest, floored means."""
    steps = [
        "kept as materialized (select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings"
        " where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding))",
        "pts as materialized (select rid, i // (n // 16) as p, i % (n // 16) as i, x from (select rid, len(q) as n, unnest(range(len(q))) as i, unnest(q) as x from kept))",
        "b0 as materialized (select p, e, i, x as c from pts join (select rid, row_number() over (order by vec_id, q) - 1 as e from kept) using (rid) where e < 64)",
    ]
    for r in range(ROUNDS + 1):
        steps.append(f"a{r} as materialized (select rid, p, min(struct_pack(d := d, e := e)) as a from (select rid, p, e, sum((x - c) * (x - c))::bigint as d from pts join b{r} using (p, i) group by rid, p, e) group by rid, p)")
        if r < ROUNDS:
            mean = "(s - ((s % n) + n) % n) // n"
            sums = f"select p, a.e as e, i, sum(x)::bigint as s, count(*) as n from pts join a{r} using (rid, p) group by 1, 2, 3"
            steps.append(f"b{r + 1} as materialized (select b.p, b.e, b.i, coalesce({mean}, b.c) as c from b{r} b left join ({sums}) m on m.p = b.p and m.e = b.e and m.i = b.i)")
    return (
        "with " + ", ".join(steps) + f""", v as (select rid, string_agg(format('{{:02x}}', a.e), '' order by p) as code, sum(a.d)::bigint as error from a{ROUNDS} group by rid)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, (select sha256(string_agg(c::varchar, ',' order by p, e, i)) from b{ROUNDS}) as codebooks_sha256 from kept join v using (rid)"""
    )


SQL = _sql()
