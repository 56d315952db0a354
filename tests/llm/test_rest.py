"""URL filters, media, quality, mixing, neighbours, sharding and packing."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trigrove.llm import op2_url_filter as op2
from trigrove.llm import op3_media as op3
from trigrove.llm import op4_quality as op4
from trigrove.llm import op5_mixing as op5
from trigrove.llm import op6_ann as op6
from trigrove.llm import op7_sharding as op7
from trigrove.llm import op9_packing as op9
from trigrove.llm.tokens import WordTokenizer


def brute_url(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in op2.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


def test_url_filter(spark):
    urls = [None, "", "nothing", "http://A.Example.NET/en/x", "http://example.net", "https://example.net/de?x", "http://badexample.com/de/", "http://www.example.com/de/a#b", "x://org/fr/1", "http://u.org/fr", "http://É.net/", "http://spam.org/a/", "https://www.spam.org/a?b=1", "http://spam.org/b", "://", "http://m.spam.org/a/index.html"]
    pages = spark.createDataFrame([(k, u, 1, "t") for k, u in enumerate(urls)] + [(3, urls[3], 1, "t")], "page_id long, url string, block int, rule string")
    listed = spark.createDataFrame([("http://spam.org/a",), (None,), ("junk",)], "url string")
    rows = op2.url_filter(pages, listed).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        host, path, rule, verdict = brute_url(urls[r.page_id])
        hit = r.page_id in (11, 12, 15)
        assert (r.host, r.path, r.rule, r.verdict, r.listed) == (host, path, rule, verdict or ("block" if hit else "allow"), hit)
    none = op2.url_filter(pages, listed.limit(0)).collect()
    assert len(none) == len(urls) + 1 and not any(r.listed for r in none)
    assert op2.url_filter(pages.limit(0), listed).count() == 0


def test_bloom_filter_never_loses_a_listed_url(spark):
    pages = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 700, '.com/p', id) as url")
    listed = pages.where("page_id % 7 = 0").select("url")
    rows = op2.url_filter(pages, listed, rules=()).collect()
    assert all(r.listed == (r.page_id % 7 == 0) and (r.possible or not r.listed) for r in rows)
    assert sum(r.possible and not r.listed for r in rows) < 100


def test_media_copies(spark):
    vectors = spark.createDataFrame([(k, np.random.default_rng(k).standard_normal(64).tolist()) for k in range(80)], "vec_id long, embedding array<float>")
    media = op3.media_from_vectors(vectors).selectExpr("*", "'x' as media", "1 as points", "2 as least")
    odd = spark.createDataFrame([(9000, None, 5, 5), (9001, bytearray(b"abc"), 9, 9), (9002, bytearray(100), 10, 10), (9003, bytearray(100), 10, 10), (None, bytearray(4), 2, 2), (9004, bytearray(128 * 128), 128, 128)], "media_id long, image binary, width int, height int")
    media = media.unionByName(odd, allowMissingColumns=True).unionByName(media.where("media_id = 5"))
    rows = op3.copies(media).collect()
    assert len(rows) == 80 + 8 + 6 + 1
    for r in rows:
        if r.media_id is None:
            continue
        want = r.media_id - op3.EDITED if r.media_id >= op3.EDITED else 9002 if r.media_id == 9003 else r.media_id
        assert r.class_id == want
    assert op3.copies(media.limit(0)).count() == 0


def test_media_finds_every_kind_of_edit_and_links_nothing_else(spark):
    rng = np.random.default_rng(11)
    vectors = [rng.normal(size=64) for _ in range(240)]
    image = [op3.picture(v) for v in vectors]
    extra = [(1000 + k, op3.edited(image[k], k % op3.KINDS)) for k in range(12 * op3.KINDS)]
    more = [(2000 + k, np.clip(np.rint(op3.turned(image[k].astype(float), -37)), 0, 255).astype(np.uint8)) for k in range(100, 112)]
    media = spark.createDataFrame([(k, bytearray(np.ascontiguousarray(i).tobytes()), i.shape[1], i.shape[0]) for k, i in [*enumerate(image), *extra, *more]], "media_id long, image binary, width int, height int")
    found = {r.media_id: r.class_id for r in op3.copies(media.repartition(6)).collect()}
    assert all(found[k] == k for k in range(240))
    for kind in range(op3.KINDS):
        assert sum(found[k] == k - 1000 for k, _ in extra if (k - 1000) % op3.KINDS == kind) >= 11
    assert sum(found[k] == k - 2000 for k, _ in more) >= 11


def test_media_meet_beyond_the_rows_beside_them(spark):
    rng = np.random.default_rng(4)
    bits = rng.integers(-(1 << 62), 1 << 62, (10, 4)).tolist()
    # twelve pictures with equal descriptors; only picture k and k + 6 have them at the same places
    places = [rng.integers(20, 400, (10, 2)).astype(float).tolist() for _ in range(6)]
    rows = [(k, [(*map(float, xy), 0, 0.0, *d) for xy, d in zip(places[k % 6], bits, strict=True)]) for k in range(12)]
    found = op3.matches(spark.createDataFrame(rows, f"media long, points {op3._POINTS}")).collect()
    assert sorted((r.a, r.b) for r in found) == [(k + 6, k) for k in range(6)]


def test_media_classes_walk_each_link_once(spark, monkeypatch):
    vectors = spark.createDataFrame([(k, np.random.default_rng(k).standard_normal(64).tolist()) for k in range(40)], "vec_id long, embedding array<float>")
    walked, classes = [], op3.connected_components
    monkeypatch.setattr(op3, "connected_components", lambda edges: walked.append(edges.count()) or classes(edges))
    rows = op3.copies(op3.media_from_vectors(vectors)).collect()
    assert sum(walked) == sum(r.n_links for r in rows) // 2 == 4


def test_media_other_pairs_against_counting_and_without_unshared_quarters(spark, monkeypatch):
    r = np.random.default_rng(8)
    bits = {m: [tuple(int(x) for x in (r.integers(0, 40, op3.BANDS) if m < 12 else r.integers(1 << 40, 1 << 60, op3.BANDS))) for _ in range(6)] for m in range(60)}
    root = {m: 0 if m < 3 else m for m in bits}
    count = {m: Counter((t, p[t]) for p in points for t in range(op3.BANDS)) for m, points in bits.items()}
    want = {(a, b) for a in bits for b in range(a) if root[a] != root[b] and (count[a] & count[b]).total() >= op3.AGREE}
    assert 5 < len(want)
    one = spark.createDataFrame([(m, [(0.0, 0.0, 0, 0.0, *p) for p in points]) for m, points in bits.items()], f"media long, points {op3._POINTS}")
    written, keep = [], op3.materialize
    monkeypatch.setattr(op3, "materialize", lambda df: written.append(keep(df)) or written[-1])
    found = op3.other_pairs(one, spark.createDataFrame([(k, 0) for k in range(3)], "node long, component long"))
    assert {(x.a, x.b) for x in found.collect()} == want
    # quarters of one picture alone are written nowhere
    assert max(w.count() for w in written) <= 12 * 6 * op3.BANDS


def test_media_meet_without_any_equal_part(spark, monkeypatch):
    rng = np.random.default_rng(6)
    bits = rng.integers(0, 2, (40, 10, 256))
    # picture 39 is picture 0 with 12 bits of each quarter changed in each descriptor, so no quarter is equal and no two are within NEAR
    bits[39] = bits[0]
    for k in range(10):
        for t in range(op3.BANDS):
            bits[39, k, 64 * t + rng.permutation(64)[:12]] ^= 1
    whole = np.packbits(bits, axis=2).view(">u8").astype(np.uint64).view(np.int64)
    places = rng.integers(20, 400, (10, 2)).astype(float).tolist()
    media = [(k - 20) * (1 << 58) for k in range(40)]
    rows = [(m, [(*xy, 0, 0.0, *map(int, d)) for xy, d in zip(places, w, strict=True)]) for m, w in zip(media, whole, strict=True)]
    one = spark.createDataFrame(rows, f"media long, points {op3._POINTS}").repartition(3)
    for tile in (4096, 4):
        monkeypatch.setattr(op3, "TILE", tile)
        links, parts = op3.links_and_classes(one)
        assert [(r.a, r.b) for r in links.collect()] == [(media[39], media[0])]
        assert {r.node: r.component for r in parts.collect()} == {media[0]: media[0], media[39]: media[0]}


def test_media_every_pair_against_comparing_all(spark, monkeypatch):
    image = [op3.picture(np.random.default_rng(k).standard_normal(64)) for k in range(60)]
    image += [np.ascontiguousarray(op3.edited(image[k // 3], k % op3.KINDS)) for k in range(24)]
    media = spark.createDataFrame([(k, bytearray(i.tobytes()), i.shape[1], i.shape[0]) for k, i in enumerate(image)], "media_id long, image binary, width int, height int")
    one = op3.materialize(op3.described(media).select("media", "points"))
    pairs = one.selectExpr("media as a").crossJoin(one.selectExpr("media as b")).where("a > b")
    monkeypatch.setattr(op3, "TILE", 20)
    own = sorted(r.media for r in one.collect())
    want = {(r.a, r.b) for r in op3.compared(one, pairs).collect() if not {r.a, r.b} <= set(own[:9])}
    found = op3.every_pair(one, spark.createDataFrame([(m, own[0]) for m in own[:9]], "node long, component long"))
    assert {(r.a, r.b) for r in found.collect()} == want and len(want) > 16


def test_media_describes_twenty_corners_of_each_level():
    points = op3.descriptors(np.random.default_rng(1).uniform(0, 255, (160, 160)))
    assert points.groupby("level").size().tolist() == [20] * op3.LEVELS


def test_quality_learns_and_holds_out(spark, odd_docs, no_docs, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = op4.quality(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    judged = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in judged) >= 0.97 * len(judged)
    good = [b for a, b in judged if a == 1]
    assert sum(good) >= 0.98 * len(good)
    # labels of held-out rows change nothing
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end as quality")
    again = {r.doc_id: r.score for r in op4.quality(docs, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)
    odd = op4.quality(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(r.score is not None for r in odd)
    assert op4.quality(no_docs, labels).count() == 0
    assert {r.score for r in op4.quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert op4.accepted(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_compiled_rules_say_what_the_trees_say():
    text = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 2 <= 0.5)\n     If (feature 0 <= 1.0)\n      Predict: 1.0\n     Else (feature 0 > 1.0)\n      Predict: 0.0\n    Else (feature 2 > 0.5)\n     Predict: 1.0\n"
    assert op4.tree_paths(text) == {((2, "<=", 0.5),), ((0, "<=", 1.0), (2, "<=", 0.5)), ((0, ">", 1.0), (2, "<=", 0.5)), ((2, ">", 0.5),)}


def fill(budget, caps):
    """Water-filling by hand: children {name: (weight, cap)}."""
    out, left, todo = {}, budget, dict(caps)
    while True:
        total = sum(w for w, _ in todo.values())
        full = [k for k, (w, c) in todo.items() if c * total <= w * left]
        if not full:
            break
        k = min(full, key=lambda k: (todo[k][1] / todo[k][0], k))
        out[k] = todo[k][1]
        left -= todo.pop(k)[1]
        if not todo:
            return out
    total = sum(w for w, _ in todo.values())
    return out | {k: w * left // total for k, (w, _) in todo.items()}


def test_budgets_fill_siblings_first(spark):
    r = random.Random(3)
    leaves = [(f"domain{d}", lang, f"src{s}{d}", r.choice([3, 50, 400, 9000])) for d in range(4) for lang in ("en", "de", "es") for s in range(r.randrange(1, 5))]
    got = {(x.domain, x.lang, x.source): x.budget for x in op5.budgets(spark.createDataFrame(leaves, "domain string, lang string, source string, n_tokens long"), 60, 2).collect()}
    weigh = {"domain0": 3, "domain1": 1, "domain2": 2, "domain3": 3, "en": 4, "de": 2, "es": 1}
    total = sum(x[3] for x in leaves)
    cap = lambda *key: 2 * sum(x[3] for x in leaves if x[: len(key)] == key)
    domains = fill(min(total * 60 // 100, 2 * total), {d: (weigh[d], cap(d)) for d in {x[0] for x in leaves}})
    for d, b in domains.items():
        for lang, b2 in fill(b, {x: (weigh[x], cap(d, x)) for x in {y[1] for y in leaves if y[0] == d}}).items():
            for s, b3 in fill(b2, {x[2]: (1, cap(d, lang, x[2])) for x in leaves if x[:2] == (d, lang)}).items():
                assert got[d, lang, s] == b3


def test_mixing_on_odd_rows(odd_docs, no_docs):
    rows = op5.mix(odd_docs, percent=100, epochs=1).collect()
    assert len(rows) == odd_docs.count() and all(r.copies == 1 for r in rows)
    assert op5.mix(no_docs).count() == 0
    mixed = op5.mixed(odd_docs, percent=100)
    assert mixed.columns == odd_docs.columns and mixed.count() == odd_docs.count()
    assert op5.mixed(odd_docs, percent=300, epochs=3).count() == 3 * odd_docs.count()
    assert op5.mixed(no_docs).count() == 0


def test_neighbours_recall_ties_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    vectors = r.standard_normal((3000, 16)).astype(np.float32)
    vectors[10] = vectors[11] = vectors[12] = vectors[0]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors)]
    odd = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0, None]), (5200, [float("inf")] * 16), (5250, []), (None, [1.0] * 16), (5300, [1.0, 2.0]), (0, rows[0][1])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 as v", "2 as block", "3 as part")
    got = defaultdict(list)
    for x in op6.nearest(df, (op6.F.col("vec_id") % 50 == 0)).orderBy("query_id", "rank").collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    assert set(got) == set(range(0, 3000, 50))
    exact = vectors.astype(float)
    unit = exact / np.linalg.norm(exact, axis=1, keepdims=True)
    hits = 0
    for q in got:
        sims = unit @ unit[q]
        sims[q] = -2
        best = np.lexsort((np.arange(3000), -np.round(sims, 12)))[:5]
        hits += len({v for _, v, _ in got[q]} & set(best.tolist()))
        assert [k for k, _, _ in got[q]] == [1, 2, 3, 4, 5]
        assert all(abs(s - sims[v]) < 1e-9 for _, v, s in got[q])
    assert hits >= 0.9 * 5 * len(got)
    assert [v for _, v, _ in got[0]][:3] == [10, 11, 12]
    assert op6.nearest(df.limit(0), op6.F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_neighbour_query_against_brute_force(spark, sf):
    """The query with its own parameters on a whole table: exact scores, recall of the five nearest, rows compared."""
    folder = f"/root/testdata/{sf}"
    rows = op6.usable(spark.read.parquet(f"{folder}/embeddings.parquet")).orderBy("vec_id").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.v for r in rows])
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = defaultdict(list)
    for r in op6.op6_ann(spark, folder).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    asked = np.flatnonzero(ids % 50 == 0)
    assert set(got) == set(ids[asked].tolist())
    hits = 0
    for at in asked:
        sims = unit @ unit[at]
        sims[at] = -2
        best = ids[np.lexsort((ids, -np.round(sims, 12)))[:5]]
        found = sorted(got[ids[at]])
        assert [k for k, _, _ in found] == [1, 2, 3, 4, 5] and all(abs(s - sims[np.searchsorted(ids, v)]) < 1e-12 for _, v, s in found)
        hits += len({v for _, v, _ in found} & set(best.tolist()))
    print(sf, "recall", hits / 5 / len(asked))
    assert hits >= 0.9 * 5 * len(asked)


def test_sharding(spark, odd_docs, no_docs):
    texts = ["hot"] * 400 + [f"t{k}" for k in range(500)] + [f"g{k % 60}" for k in range(300)] + [None, None, "", "é"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    rows = op7.shard(df).collect()
    count = Counter(r.shard for r in rows)
    assert len(rows) == len(texts) and max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(8))
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(count[s]))
    shards = defaultdict(set)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "rows", None)
        shards[texts[r.doc_id]].add(r.shard)
    assert sum(len(v) - 1 for k, v in shards.items() if k and k.startswith("g")) <= 3
    assert len(shards["hot"]) < 8
    odd = Counter(r.shard for r in op7.shard(odd_docs).collect())
    assert sum(odd.values()) == odd_docs.count() and max(odd.values()) - min(odd.get(s, 0) for s in range(8)) <= 1
    assert op7.shard(no_docs).count() == 0


@pytest.mark.parametrize("big", [1024, 4])
def test_sharding_where_every_row_is_linked(spark, monkeypatch, big):
    monkeypatch.setattr(op7, "BIG", big)
    texts = ["hot"] * 200 + [f"g{k % 300}" for k in range(600)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    rows = op7.shard(df).collect()
    assert Counter(r.shard for r in rows) == {s: 100 for s in range(8)} and sorted(r.doc_id for r in rows) == list(range(800))
    shards = defaultdict(set)
    for r in rows:
        shards[texts[r.doc_id]].add(r.shard)
    assert len(shards["hot"]) == 2 and all(len(v) == 1 for k, v in shards.items() if k != "hot")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abcXYZ éÉßİıſÀñ'sdlm0²½_-.,!?<|>\t\n\r\x0b\x1c\x85\xa0 漢字😀̈", max_size=40))
def test_word_cache_gives_the_tokenizers_own_ids(text):
    own = WordTokenizer(op9.tokenizer_file())
    assert np.frombuffer(own.ids(text), "<u4").tolist() == own.inner.encode(text, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 40), max_size=12))
def test_best_fit_places_everything_as_best_fit_decreasing(runs):
    bins = []
    for length in sorted(runs, reverse=True):
        for _ in range(runs[length]):
            fits = [b for b in range(len(bins)) if bins[b] >= length]
            b = min(fits, key=lambda b: bins[b]) if fits else len(bins)
            if not fits:
                bins.append(32)
            bins[b] -= length
    spans = defaultdict(list)
    for length, lo, hi, first, each, base in op9.best_fit(runs, 32):
        for k in range(hi - lo + 1):
            spans[first + k // each].append((base + k % each * length, length))
    assert len(spans) == len(bins) and sum(len(v) for v in spans.values()) == sum(runs.values())
    for parts in spans.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 32


def test_packing_round_trip(spark, odd_docs, no_docs):
    path = op9.tokenizer_file()
    inner = WordTokenizer(path).inner
    rows = op9.pack(odd_docs, path).collect()
    want = Counter()
    for r in odd_docs.select("doc_id", "text").collect():
        ids = [*inner.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], dtype="<u4")
            want[r.doc_id, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by) <= -(-sum(r.length for r in rows) // 2048) + 1
    assert op9.pack(no_docs, path).count() == 0
    made = op9.sequences(odd_docs, path).collect()
    assert sum(len(r.ids) for r in made) == sum(r.length for r in rows)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeats", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        seen.append({r.doc_id for r in docs.collect()})
        assert seen[-1] <= seen[-2] and len(seen[-1]) > 0.7 * len(seen[-2])
    want = {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()}
    assert {(r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf).collect()} == want


