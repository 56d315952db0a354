"""Substring, SimHash and suffix-array operators against brute force."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from conftest_words import words
from hypothesis import given, settings
from hypothesis import strategies as st

from trigrove.llm import op1_substring as op1
from trigrove.llm import op8_simhash as op8
from trigrove.llm import op10_suffix_array as op10


def brute_windows(values, least):
    out = set()

    def node(lo, hi):
        if hi - lo + 1 < least:
            return
        c = min(range(lo, hi + 1), key=lambda i: (values[i] >> 24, i))
        out.add((lo, c, hi))
        node(lo, c - 1)
        node(c + 1, hi)

    start = 0
    for i, v in enumerate([*values, 0]):
        if v == 0:
            node(start, i - 1)
            start = i + 1
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=60), st.integers(1, 9))
def test_compact_windows_are_the_wide_nodes_of_the_cartesian_tree(small, least):
    values = [v << 24 for v in small]
    for bits in (24, 3):  # with 3 bits, eight places and more are ranked, as texts of over 16 million words are
        found = op1.compact_windows(np.array(values, dtype=np.uint64), least, bits)
        assert set(zip(*(x.tolist() for x in found), strict=True)) == brute_windows(values, least)


def test_substring_finds_planted_passages_and_leaves_others_alone(spark):
    passage, other = words(100, 60), words(101, 80).split()
    edited = list(other)
    edited[40] = "changed"
    texts = {k: words(k, 90) for k in range(12)}
    texts[2] += " " + passage
    texts[5] = passage + "\n" + texts[5]
    texts[7] = words(70, 40) + " " + passage.upper() + " " + words(71, 40)
    texts[8] += " " + " ".join(other)
    texts[9] += " " + " ".join(edited)
    texts[20] = texts[21] = words(22, 55)
    texts[30], texts[31] = words(1, 49, 10**6), words(1, 49, 10**6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = op1.substring_duplicates(df).collect()
    assert {r.doc_id for r in rows} == {2, 5, 7, 8, 9, 20, 21}
    assert {r.class_id for r in rows if r.doc_id in (2, 5, 7)} == {2} and {r.class_id for r in rows if r.doc_id in (8, 9)} == {8} and {r.class_id for r in rows if r.doc_id in (20, 21)} == {20}
    assert all(r.similarity >= 0.8 for r in rows)
    at = next(r for r in rows if r.doc_id == 7)
    assert at.start_word <= 41 and at.end_word >= 99
    assert all(abs(r.end_word - r.start_word - 80) <= 3 for r in rows if r.doc_id in (8, 9))


@pytest.mark.parametrize("edit", range(1, 11))
@pytest.mark.parametrize("size", [60, 95, 100, 110, 120, 140, 200])
def test_verified_joins_both_sides_of_an_edited_run(size, edit):
    passage = words(size, size, 10**6).split()
    changed = list(passage)
    changed[size // 2 : size // 2 + edit] = words(7, edit, 10**6).split()
    fill = [words(k, 30, 10**6).split() for k in (8, 9, 10, 11)]
    own, other = (op1.shingles(" ".join(x).encode()) for x in (fill[0] + changed + fill[1], fill[2] + passage + fill[3]))
    shared = len(np.intersect1d(*(op1.shingles(" ".join(x).encode()) for x in (changed, passage))))
    similar = shared / (2 * (size - 4) - shared)
    at = 30 + size // 4
    found = op1.verified(own, other, (0, len(own) - 1), (0, len(other) - 1), [at])
    whole = [f for f in found if f[1] - f[0] == size]
    assert len(whole) == (similar >= 0.8) and len(found) == len(whole or found)
    assert all((f[0], f[1], f[2], f[3]) == (30, 30 + size, 30, 30 + size) and abs(f[4] - similar) < 1e-9 for f in whole)


def test_substring_many_copies_of_a_passage(spark):
    passage = words(200, 70)
    df = spark.createDataFrame([(k, f"{words(300 + k, 60)} {passage} {words(900 + k, 60)}") for k in range(300)], "doc_id long, text string")
    rows = op1.substring_duplicates(df.repartition(5)).collect()
    assert {r.doc_id for r in rows} == set(range(300)) and {r.class_id for r in rows} == {0}


def test_substring_passages_of_common_sentences(spark):
    """Texts made of common sentences, in which one shingle says little; all pairs that share a long passage are found."""
    r = random.Random(5)
    sentences = [words(1000 + k, 12) for k in range(60)]
    texts = [" ".join(r.choices(sentences, k=20)) for _ in range(260)]
    for k in range(40):
        passage = " ".join(r.sample(sentences, 8))
        for i in (k, 40 + k):
            texts[i] = words(5000 + i, 30) + " " + passage + " " + words(9000 + i, 30)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {row.doc_id: row.class_id for row in op1.substring_duplicates(df).collect()}
    assert sum(k in classes and classes[k] == classes.get(40 + k) for k in range(40)) == 40


@pytest.mark.parametrize("many", [64, 0])
def test_substring_pairs_around_a_common_line(spark, monkeypatch, many):
    """A line shorter than a passage that all texts have, and a few words around it that only two have: no representative is one of the two."""
    monkeypatch.setattr(op1, "MANY", many)
    line, texts = words(77, 40, 10**6), {}
    for k in range(40):
        passage = f"{words(100 + k, 6, 10**6)} {line} {words(200 + k, 6, 10**6)}"
        for i in (k, 40 + k):
            texts[i] = f"{words(5000 + i, 70, 10**6)} {passage} {words(9000 + i, 70, 10**6)}"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    classes = {row.doc_id: row.class_id for row in op1.substring_duplicates(df).collect()}
    assert classes == {i: i % 40 for i in texts}


def test_least_shared_against_counting():
    r = random.Random(3)
    for size, kinds in ((46, 1), (46, 10), (80, 30), (300, 60), (300, 10**6)):
        h = np.array([r.randrange(kinds) for _ in range(size)], np.uint64)
        fewest = min(len(set(h[k : k + 37].tolist())) for k in range(size - 36))
        assert op1.least_shared(h) == -(-fewest * 4 // 5)


@pytest.mark.parametrize(("edits", "originals"), [(5, 12), (40, 2)])
def test_substring_edits_meet_their_original(spark, edits, originals):
    """Edits with a similarity of just over 0.8 to their original, and below it to each other, end in its class."""
    texts, families = [], []
    for size, cut in ((55, 1), (80, 4), (120, 8)):
        for k in range(originals):
            r = random.Random(f"{size} {k} {edits}")
            passage = words(r.random(), size, 10**6).split()
            members = [passage]
            for _ in range(edits):
                changed, at = list(passage), r.randrange(5, size - 5 - cut)
                changed[at : at + cut] = words(r.random(), cut, 10**6).split()
                members.append(changed)
            families.append(range(len(texts), len(texts) + len(members)))
            texts += [f"{words(r.random(), 40, 10**6)} {' '.join(m)} {words(r.random(), 40, 10**6)}" for m in members]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = {row.doc_id: row.class_id for row in op1.substring_duplicates(df).collect()}
    family = {d: f[0] for f in families for d in f}
    assert all(family[c] == family[d] for d, c in classes.items())
    for part in (families[:originals], families[originals : 2 * originals], families[2 * originals :]):
        inside = [f[0] in classes and classes[d] == classes[f[0]] if d in classes else False for f in part for d in f[1:]]
        print("recall", len(inside), sum(inside) / len(inside))
        assert sum(inside) >= 0.9 * len(inside)


def brute_fingerprint(text):
    import re

    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not ws:
        return 0
    sh = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="aB Éé\t\n\x0b\x1c\xa0漢", max_size=60))
def test_fingerprint(text):
    assert op8.fingerprint(text) == brute_fingerprint(text)


def components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_links_connect_exactly_what_the_radius_connects(spark):
    r = random.Random(5)
    fps = []
    for _ in range(25):
        base = r.getrandbits(64)
        fps.append(base)
        for _ in range(r.randrange(6)):
            now = r.choice(fps[-3:])
            for b in r.sample(range(64), r.choice([1, 2, 3, 4, 5])):
                now ^= 1 << b
            fps.append(now)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    survivors = op8._with_company(df)
    pairs = op8.links(survivors).collect()
    place = {s: k for k, s in enumerate(signed)}
    assert all(((p.a ^ p.b) & (2**64 - 1)).bit_count() <= 3 for p in pairs)
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        a, b = find(place[p.a]), find(place[p.b])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == components(fps)


def test_simhash_on_odd_rows(spark, odd_docs, no_docs):
    rows = op8.simhash_components(odd_docs).collect()
    given_rows = odd_docs.select("doc_id", "text").collect()
    assert len(rows) == len(given_rows)
    fps = [brute_fingerprint(r.text) for r in given_rows]
    roots = components(fps)
    least = {}
    for r, root in zip(given_rows, roots, strict=True):
        if r.doc_id is not None:
            least[root] = min(r.doc_id, least.get(root, r.doc_id))
    want = sorted((str(g.doc_id), f"{f:016x}", str(least.get(root))) for g, f, root in zip(given_rows, fps, roots, strict=True))
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in rows) == want
    assert op8.simhash_components(no_docs).count() == 0


def brute_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_near(texts):
    """Component of each text, linked at a Jaccard similarity of 0.8 over sets of five-word shingles; all pairs."""
    sets = [brute_shingles(t) for t in texts]
    first, root = {}, list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, own in enumerate(sets):
        if own in first:
            root[i] = first[own]
            continue
        first[own] = i
        for other, j in list(first.items()):
            if 4 * max(len(own), len(other)) <= 5 * min(len(own), len(other)) and j != i and len(own & other) * 5 >= len(own | other) * 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(text, every, rng):
    words_ = text.split()
    for i in range(rng.randrange(every), len(words_), every):
        words_[i] = f"z{rng.randrange(10**6)}"
    return " ".join(words_)


def test_keep_one_against_brute_force(spark):
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()]
    rng = random.Random(2)
    # edits of every 45th to 90th word: similarities of about 0.8 to 0.9, on both sides of the threshold
    texts = given + [edited(words(900 + k, 400), 45 + k, rng) for k in range(46) for _ in range(2)] + [words(77, 200) for _ in range(300)] + [edited(words(77, 200), 60, rng) for _ in range(40)]
    roots = brute_near(texts)
    rows = op8.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    kept, want = {r.doc_id for r in rows}, set(roots)
    assert want <= kept and len(rows) == len(kept)
    # ball hashing may miss a link: of all that must go, at least 97 in 100 do
    assert len(kept - want) <= 0.03 * (len(texts) - len(want))


def swapped(text, at, n, rng):
    """One block of words changed."""
    parts = text.split()
    return " ".join(parts[:at] + [f"{rng.getrandbits(48):x}" for _ in range(n)] + parts[at + n :])


@pytest.mark.parametrize("rounds", [0, 6])
def test_keep_one_loses_no_link(spark, monkeypatch, rounds):
    rng = random.Random(5)
    common = words(50, 60)
    # a block of a text changed: similarities of just over and just under 0.8; many edits of one text; a passage that all others have
    texts = [t for k in range(60) for t in (words(700 + k, 300), swapped(words(700 + k, 300), 20 + k, 26 + k % 10, rng))]
    texts += [swapped(swapped(words(78, 200), 7 * (k % 20), 6, rng), 150, 5, rng) for k in range(60)]
    texts += [f"{common} {words(800 + k, 20)}" for k in range(60)] + ["a b", "A  b", "a", "", " "]
    monkeypatch.setattr(op8, "MANY", 0)
    monkeypatch.setattr(op8, "ROUNDS", rounds)
    kept = [r.doc_id for r in op8.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted(set(brute_near(texts)))


def test_keep_one_compares_a_large_group_in_proportion(spark, monkeypatch):
    """Edits of one text that are often not quite similar to each other, but to the text: each needs few comparisons."""
    r, base = np.random.default_rng(21), words(70, 150).split()
    texts = [" ".join(base)]
    for k in range(240):
        own = list(base)
        for at in r.choice(30, int(r.integers(1, 4)), replace=False):
            own[5 * int(at)] = f"e{k}x{at}"
        texts.append(" ".join(own))
    compared, similar = [], op8.similar_pairs
    monkeypatch.setattr(op8, "MANY", 0)
    monkeypatch.setattr(op8, "similar_pairs", lambda sets, pairs: compared.append(pairs.count()) or similar(sets, pairs))
    kept = [x.doc_id for x in op8.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()]
    assert sorted(kept) == sorted(set(brute_near(texts)))
    assert sum(compared) < 12 * len(texts)


def test_keep_one_on_odd_rows(odd_docs, no_docs):
    given = odd_docs.select("doc_id", "text").collect()
    least = {}
    for r, root in zip(given, brute_near([r.text for r in given]), strict=True):
        if r.doc_id is not None:
            least[root] = min(r.doc_id, least.get(root, r.doc_id))
    kept = op8.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert op8.keep_one(no_docs).count() == 0


def brute_cuts(texts, n=400):
    from collections import Counter

    datas = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in datas for i in range(len(d) - n + 1))
    out = []
    for d in datas:
        gone = bytearray(len(d))
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        kept = bytes(x for x, g in zip(d, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def planted_texts():
    r = random.Random(9)
    raw = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = raw(900), raw(401)
    near = list(p)
    for i in range(150, 900, 170):
        near[i] = "Z"
    return [raw(300) + p + raw(200), p, raw(10) + p[100:520] + raw(50), raw(20) + q, q + raw(7), raw(399), raw(500), "".join(near), raw(40) + "".join(near[:700]), "ab" * 400, "x" * 401, "x" * 400 + "y", p[:450] + raw(90) + p[400:], "é" * 250 + raw(60)]


def test_suffix_array_against_brute_force(spark, odd_docs, no_docs):
    texts = planted_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sorted(op10.suffix_array_dedup(df).collect())
    assert [tuple(r)[1:] for r in rows] == brute_cuts(texts)
    odd = odd_docs.where("coalesce(doc_id, 0) != 7").select("doc_id", "text").collect()
    want = sorted((str(r.doc_id), *c) for r, c in zip(odd, brute_cuts([r.text for r in odd]), strict=True))
    got = op10.suffix_array_dedup(odd_docs.where("coalesce(doc_id, 0) != 7")).collect()
    assert sorted((str(r[0]), *tuple(r)[1:]) for r in got) == want
    assert op10.suffix_array_dedup(no_docs).count() == 0
    cut = op10.without_repeats(odd_docs)
    assert cut.columns == odd_docs.columns and cut.count() == odd_docs.count()
    assert op10.without_repeats(no_docs).count() == 0


def test_suffix_array_counts_shorter_repeats_on_the_way(spark):
    texts = planted_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in op10.suffix_array_dedup(df, 400, 120).collect()}
    assert [rows[k].n_removed for k in range(len(texts))] == [c[1] for c in brute_cuts(texts)]
    assert [rows[k].n_repeated for k in range(len(texts))] == [c[1] for c in brute_cuts(texts, 120)]


@pytest.mark.parametrize("length", [120, 250, 800])
def test_suffix_array_follows_its_length(spark, length):
    texts = [*planted_texts(), *(2 * [words(4, 300) + words(5, 20)]), words(6, 50) + words(4, 300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(op10.suffix_array_dedup(df, length).collect())
    assert [tuple(r)[1:] for r in got] == brute_cuts(texts, length)


@pytest.mark.parametrize("part", ["identities", "windows"])
def test_substring_parts_on_odd_rows(odd_docs, no_docs, part):
    f = getattr(op1, part)
    assert f(odd_docs).count() >= 1 and f(no_docs).count() == 0


def test_substring_on_odd_rows(odd_docs, no_docs):
    rows = op1.substring_duplicates(odd_docs).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, None} and {r.class_id for r in rows} == {1}
    assert op1.substring_duplicates(no_docs).count() == 0


@pytest.mark.parametrize("places", [0, 10, 300])
def test_buckets_are_those_of_the_windows_without_their_widths(places, monkeypatch):
    parts = [np.random.default_rng(k).integers(1, 1 << 62, n, dtype=np.uint64) for k, n in enumerate((places, 46, 47, 500, 46 + places))]
    whole = pd.concat(op1._chunk_windows(list(range(5)), parts, False))
    want = sorted(b for _, b in set(zip(whole["tid"], whole["bucket"], strict=True)))
    monkeypatch.setattr(op1, "compact_windows", None)
    assert sorted(pd.concat(op1._chunk_windows(list(range(5)), parts, True))["bucket"]) == want


@pytest.mark.parametrize("width", [1, 2, 23, 46, 64])
def test_sliding_minima(width):
    values = np.random.default_rng(width).integers(0, 1 << 63, 200, dtype=np.uint64)
    assert op1._sliding_minima(values, width).tolist() == [min(values[k : k + width]) for k in range(201 - width)]
