"""Forms that must hold for large inputs: against plain versions, and by their plans."""

import random
import re
from collections import deque

import pytest
from pyspark.sql import functions as F

from trigrove.functions import lexicon as lx
from trigrove.functions import text as tx
from trigrove.functions.bloom import bloom_table, blocks_for, possible
from trigrove.functions.numbering import dense_number
from trigrove.functions.tables import stored
from trigrove.operators import cleaning, graph, mentions, patterns, relations, table
from trigrove.operators.grams import texts_with_words
from trigrove.plans.inputs import read
from trigrove.sources.store import Conflict, KeyedStore
from trigrove.streaming.merge import EDGES, NODES, merge_batch_stored, merge_stream

TOKENS = "doc_id long, sent_idx int, tok_i int, char_start int, text string, lemma string, pos string, dep string, head_i int, ent_type string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", plan(df)))


def tokens(spark, *rows):
    """rows: (text, pos, dep, head, label); places follow the texts."""
    out, at = [], 0
    for i, (text, pos, dep, head, label) in enumerate(rows):
        out.append((1, 0, i, at, text, text, pos, dep, head, label))
        at += len(text)
    return spark.createDataFrame(out, TOKENS)


def names(df):
    return sorted((r.text, r.etype, r.start, r.end) for r in df.collect())


def test_a_bad_span_hides_no_good_name(spark):
    df = tokens(spark, ("2023", "NUM", "nummod", 1, "ORG"), ("华为", "PROPN", "nsubj", 2, "ORG"), ("发布", "VERB", "ROOT", 2, ""))
    assert names(mentions.token_mentions(df)) == [("华为", "组织名", 4, 6)]
    whole = tokens(spark, ("华为", "PROPN", "nsubj", 1, "ORG"), ("公司", "PROPN", "nsubj", 2, "ORG"), ("发布", "VERB", "ROOT", 2, None))
    assert names(mentions.token_mentions(whole)) == [("华为公司", "组织名", 0, 4)]


def test_compound_parts_are_followed_through_others_and_used_once(spark):
    rows = [("华为", "NOUN", "compound:nn", 1, ""), ("通信", "NOUN", "compound:nn", 2, ""), ("技术部", "NOUN", "obj", 3, ""), ("走", "VERB", "ROOT", 3, ""), ("研发处", "NOUN", "compound:nn", 2, "")]
    # the parts do not stand in one piece, so the noun stays alone, and so does the one that hangs on it
    assert names(mentions.token_mentions(tokens(spark, *rows))) == [("技术部", "组织名", 4, 7), ("研发处", "组织名", 8, 11)]
    assert names(mentions.token_mentions(tokens(spark, *rows[:4]))) == [("华为通信技术部", "组织名", 0, 7)]
    both = [("北方院", "NOUN", "compound:nn", 1, ""), ("业务科", "NOUN", "obj", 2, ""), ("走", "VERB", "ROOT", 2, "")]
    # the first one is taken by itself first, and is part of the second one all the same
    assert names(mentions.token_mentions(tokens(spark, *both))) == [("北方院", "组织名", 0, 3), ("北方院业务科", "组织名", 0, 6)]
    loop = [("甲部", "NOUN", "compound:nn", 1, ""), ("乙部", "NOUN", "compound:nn", 0, ""), ("走", "VERB", "ROOT", 2, "")]
    assert names(mentions.token_mentions(tokens(spark, *loop))) == [("甲部乙部", "组织名", 0, 4)]
    assert mentions.token_mentions(tokens(spark, *loop).limit(0)).count() == 0


def plain_clean(text):
    edge = "|".join(lx.MENTION_EDGES)
    front = re.sub(rf"^(?:(?:{edge})\s*)+", "", text.strip()).strip()
    return re.sub(rf"(?:\s*(?:{edge}))+$", "", front).strip()


def plain_valid(text):
    chinese = re.findall("[一-鿿]", text)
    if not 2 <= len(text) <= 30 or not chinese:
        return False
    if re.fullmatch(r"\d{1,4}年\d{0,2}月?\d{0,2}日?[前后]?", text):
        return True
    if text in lx.GENERIC_NOUNS or (re.search(r"\d{4}", text) and re.search("[一-鿿]{2}", text)):
        return False
    return (len(text) - len(chinese)) * 10 <= len(text) * 7 and not (re.search(r"\d{3}", text) and len(re.sub(r"\d", "", text)) < 3)


def plain_fuse(sentence, found):
    """Mentions wait in a queue; the first one grows by those that join it, and those it passes wait for their own turn."""
    first = {}
    for m in sorted(found, key=lambda m: (m[2], m[3], m[0], m[1])):
        first.setdefault((m[2], m[3]), m)
    waiting, out = deque(first.values()), []
    while waiting:
        now, passed = waiting.popleft(), []
        while waiting:
            m = waiting[0]
            room, whole = m[2] - now[3], sentence[now[2] : m[3]]
            if room >= 0:
                if room > 3 or not re.fullmatch("[的之和与及、,，/·]*", sentence[now[3] : m[2]].strip()):
                    break
                if now[1] == m[1] or "组织名" in (now[1], m[1]):
                    if re.search("[。！？；;]", whole):
                        break
                    name = plain_clean(whole)
                    if plain_valid(name) and len(name) <= 25:
                        now = (name, "组织名", now[2], m[3])
                        waiting.popleft()
                        continue
            passed.append(waiting.popleft())
        out.append(now)
        waiting.extendleft(reversed(passed))
    return out


def test_fusing_equals_the_plain_queue(spark):
    r = random.Random(4)
    rows, sents = [], []
    for k in range(400):
        sentence = "".join(r.choice("甲乙丙丁的与，、 12；对") for _ in range(r.randrange(5, 30)))
        sents.append((k, 0, sentence))
        for _ in range(r.randrange(1, 9)):
            s = r.randrange(len(sentence) - 2)
            e = min(len(sentence), s + r.randrange(1, 5))
            rows.append((k, 0, sentence[s:e], r.choice(["组织名", "地名", "时间"]), s, e))
    found = spark.createDataFrame(rows, "doc_id long, sent_idx int, text string, etype string, start int, end int")
    sentences = spark.createDataFrame([*sents, (999, 0, "无")], "doc_id long, sent_idx int, sent_text string")
    fused = mentions.merge_adjacent_mentions(found, sentences, lx.GENERIC_NOUNS)
    got = {}
    for x in fused.orderBy("doc_id", "m_idx").collect():
        got.setdefault(x.doc_id, []).append((x.text, x.start, x.end))
    want = {k: [(m[0], m[2], m[3]) for m in plain_fuse(t, [x[2:] for x in rows if x[0] == k])] for k, _, t in sents}
    assert got == want and any(len(v) < len({x[4:] for x in rows if x[0] == k}) for k, v in want.items())
    assert "Python" not in plan(fused) and exchanges(fused) == 1


def test_pairs_and_triples_take_one_shuffle_and_no_join(spark):
    m = stored(spark.createDataFrame([(1, 0, 0, "甲院", "组织名", 0, 2)], "doc_id long, sent_idx int, m_idx int, text string, etype string, start int, end int"))
    s = stored(spark.createDataFrame([(1, 0, "甲院走")], "doc_id long, sent_idx int, sent_text string"))
    t = stored(tokens(spark, ("走", "VERB", "ROOT", 0, "")))
    for df in (relations.pair_relations(m, s), relations.time_pair_relations(m, s), relations.typed_template_pairs(m, s), relations.typed_template_triples(m, s), mentions.token_mentions(t)):
        assert exchanges(df) == 1 and "Join" not in plan(df) and "Python" not in plan(df) and df.count() == 0
    assert "Join" not in plan(relations.svo_relations(t)) and relations.svo_relations(t).count() == 0


def test_dense_numbers_of_hot_values_nulls_and_strings(spark):
    df = spark.range(300).selectExpr("case when id % 3 = 0 then 7 when id = 100 then null else id end as n", "id as tie", "concat('k', id % 50) as word")
    rows = [r.at for r in dense_number(df, "n", "at", ("tie",), parts=5).orderBy(F.col("n").asc_nulls_first(), "tie").collect()]
    assert rows == list(range(1, 301))
    assert [r.at for r in dense_number(df, "word", "at", ("tie",), parts=3, start=0).orderBy("word", "tie").collect()] == list(range(300))
    assert len(plan(dense_number(df, "n", "at", ("tie",), parts=500))) < 1.5 * len(plan(dense_number(df, "n", "at", ("tie",), parts=2)))


def test_many_rules_meet_clauses_by_their_words(spark):
    verbs = ["总部位于", "研发了", "投资了", "位于"]
    rules = [(k, "位于", f"(.{{2,8}}?){w}(.{{2,8}})", w, k % 2 == 0) for k, w in enumerate(verbs)] + [(k, "r", f"(甲{k})词{k}(乙)", f"词{k}", False) for k in range(4, 20_000)] + [(20_000, "全", "(甲)(乙)", "", False)]
    rules = spark.createDataFrame(rules, patterns.RULE_SCHEMA)
    clauses = spark.createDataFrame([(1, 0, "华为总部位于深圳"), (1, 1, "甲77词77乙"), (2, 0, "华为研发了芯片"), (3, 0, ""), (4, 0, "甲乙"), (5, 0, "华为总部位于深圳")], "doc_id long, clause_idx int, clause string")
    big = patterns.rule_extract(clauses, rules)
    assert "CartesianProduct" not in plan(big)
    kept, patterns.BROADCAST_RULES = patterns.BROADCAST_RULES, 100_000
    try:
        small = sorted(map(tuple, patterns.rule_extract(clauses, rules).collect()))
    finally:
        patterns.BROADCAST_RULES = kept
    assert sorted(map(tuple, big.collect())) == small and len(small) == 7


def test_words_with_one_beginning_meet_texts_by_their_rarest_part(spark):
    texts = spark.range(3000).select(F.format_string("供应商编号%05d号", "id").alias("text"))
    words = spark.range(5000).select(F.format_string("供应商编号%05d", F.col("id") * 2).alias("word"))
    more = spark.createDataFrame([("",), (None,), ("号",), ("供应",), ("没有",), ("编号0000",)], "word string")
    found = texts_with_words(texts.union(spark.createDataFrame([(None,), ("",), ("号",)], "text string")), words.union(more))
    got = sorted(map(tuple, found.collect()))
    every = [f"供应商编号{k:05d}号" for k in range(3000)]
    want = [(t, f"供应商编号{k:05d}") for k, t in enumerate(every) if k % 2 == 0] + [(t, w) for t in every for w in ("号", "供应")] + [(t, "编号0000") for t in every[:10]] + [("号", "号")]
    assert got == sorted(want)
    assert "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)


def test_keywords_beyond_the_broadcast_bound(spark):
    edges = spark.createDataFrame([(f"名{k % 40}院", "r", f"地{k}") for k in range(200)], "entity1 string, relation string, entity2 string")
    words = spark.createDataFrame([(f"名{k}院",) for k in range(30)] + [("地",), ("地1",)], "keyword string")
    small = sorted(map(tuple, graph.search_keywords(edges, words).select("entity1", "entity2", "keyword").collect()))
    kept, graph.BROADCAST_WORDS = graph.BROADCAST_WORDS, 0
    try:
        assert sorted(map(tuple, graph.search_keywords(edges, words).select("entity1", "entity2", "keyword").collect())) == small
    finally:
        graph.BROADCAST_WORDS = kept


def test_large_dictionaries_drop_most_places_before_the_shuffle(spark):
    sents = spark.range(200).selectExpr("id as doc_id", "0 as sent_idx", "concat('在', 900 + id, '号院的', id, '号楼') as sent_text")
    names_ = spark.range(400).selectExpr("concat(id, '号楼') as name", "'地名' as etype")
    small = sorted(map(tuple, mentions.gazetteer_mentions(sents, names_).collect()))
    kept, mentions.BROADCAST_NAMES = mentions.BROADCAST_NAMES, 0
    try:
        large = mentions.gazetteer_mentions(sents, names_)
    finally:
        mentions.BROADCAST_NAMES = kept
    assert sorted(map(tuple, large.collect())) == small and len(small) >= 200
    blocks = blocks_for(400)
    keys = spark.range(10_000).selectExpr("concat(id, '号楼') as name")
    passed = [r.name for r in possible(keys, "name", bloom_table(F.col("name"), names_, blocks), blocks).collect()]
    assert {f"{k}号楼" for k in range(400)} <= set(passed) and len(passed) < 1400


@pytest.mark.parametrize("few", [200_000, 0])
def test_names_cleaned_once_are_cleaned_the_same(spark, few):
    rows = [(r.name, "位于", "深圳等", k) for k, r in enumerate(spark.createDataFrame([(" 华为技术有限公司",), ("由腾讯",), ("",), (None,), ("公司",), ("1987年",)], "name string").collect())] * 9
    df = spark.createDataFrame([*rows, ("阿里", " 研发 ", "了芯片集团", 99), (None, None, None, None)], "e1 string, rel string, e2 string, ordinal long")
    kept, cleaning.BROADCAST_NAMES = cleaning.BROADCAST_NAMES, few
    try:
        for f in (cleaning.clean_triples, cleaning.rejected_triples):
            one, two, auto = (sorted(map(tuple, f(df, by_name=x).collect()), key=str) for x in (True, False, None))
            assert one == two == auto and one
    finally:
        cleaning.BROADCAST_NAMES = kept


def test_a_store_reads_and_adds_by_bucket(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "k long, v string", ["k"], buckets=16)
    assert store.read().count() == 0 and store.snapshot() == (0, [])
    rows = spark.range(1000).selectExpr("id as k", "concat('v', id) as v")
    assert store.merge(rows.union(rows.selectExpr("k", "concat(v, 'x')")).union(spark.createDataFrame([(None, "n")], "k long, v string"))) == 1
    assert sorted(map(tuple, store.read().collect())) == [(k, f"v{k}") for k in range(1000)]
    assert store.merge(rows.where("k < 50")) == 1 and len(store.snapshot()[1]) == 1
    assert store.merge(rows.where("k < 0")) == 1
    assert store.merge(spark.createDataFrame([(5, "new"), (5000, "new")], "k long, v string")) == 2
    assert store.read().count() == 1001 and store.read().where("k = 5").first().v == "v5"
    # few buckets are opened for few rows
    bucket = spark.range(1).select(F.pmod(F.xxhash64(F.lit(5).cast("long")), F.lit(16)).cast("int").alias("b")).first().b
    part = store.read([bucket])
    assert 20 < part.count() < 150 and "PartitionFilters: [isnotnull(store_bucket" in plan(part)
    assert store.compact() and len(store.snapshot()[1]) == 1 and store.snapshot()[0] == 3 and store.read().count() == 1001


def test_a_broken_write_is_never_read_and_a_second_writer_looks_again(spark, tmp_path):
    path = str(tmp_path / "s")
    store, other = (KeyedStore(spark, path, "k long", ["k"], buckets=4) for _ in range(2))
    store.merge(spark.range(10).selectExpr("id as k"))
    broken = spark.range(20).select(F.when(F.col("id") < 15, F.col("id")).otherwise(F.raise_error(F.lit("lost"))).cast("long").alias("k"))
    with pytest.raises(Exception, match="lost"):
        store.merge(broken)
    store._write(spark.range(100, 120).selectExpr("id as k").withColumn("store_bucket", store._bucket()))
    assert store.read().count() == 10 and store.snapshot()[0] == 1
    write, done = store._write, []

    def late(rows):
        folder = write(rows)
        if not done:
            done.append(other.merge(spark.range(8, 14).selectExpr("id as k")))
        return folder

    store._write = late
    assert store.merge(spark.range(12, 18).selectExpr("id as k")) == 3
    assert sorted(r.k for r in store.read().collect()) == list(range(18))
    store._commit = lambda *a: False
    with pytest.raises(Conflict):
        store.merge(spark.range(50).selectExpr("id as k"), tries=2)


def test_stream_into_stores(spark, tmp_path):
    src, nodes, edges = (str(tmp_path / n) for n in ("src", "nodes", "edges"))
    df = spark.createDataFrame([("a", "r", "b", 0), ("a", "r", "b", 1), ("b", "r", "a", 2), (None, "r", "x", 3)], "e1 string, rel string, e2 string, ordinal long")
    for _ in range(2):
        df.write.mode("append").parquet(src)
        merge_stream(spark.readStream.schema(df.schema).parquet(src), nodes, edges, str(tmp_path / "cp"), merge_batch_stored).awaitTermination()
    assert KeyedStore(spark, nodes, *NODES).read().count() == 3 and KeyedStore(spark, edges, *EDGES).read().count() == 2


def test_a_deep_page_reads_few_rows(spark, tmp_path):
    path = str(tmp_path / "pages")
    df = spark.range(60_000).selectExpr("concat('a', id) as e1", "'r' as rel", "'b' as e2", "id * 3 % 60000 * 10 + id % 7 as ordinal")
    table.write_pages(df, path, rows_per_group=1000)
    deep = table.page_by_id(spark.read.parquet(path), 2900)
    rows = deep.orderBy("row_id").collect()
    assert [r.row_id for r in rows] == list(range(57_980, 58_000))
    assert [r.e1 for r in rows] == [r.e1 for r in table.page(df, 2900).collect()]
    assert "PushedFilters: [IsNotNull(row_id), GreaterThanOrEqual(row_id,57980), LessThanOrEqual(row_id,57999)]" in plan(deep)
    nodes = deep._jdf.queryExecution().executedPlan().collectLeaves()
    read = nodes.head().metrics().apply("numOutputRows").value()
    assert read < 60_000 / 3


def test_token_mentions_of_a_union_are_more_than_one_task(spark):
    # the input is a union of ten branches, of which the planner makes one task where all are grouped already
    found = mentions.token_mentions(read(spark, "/root/testdata/sf0.01", "annotated"))
    assert found.rdd.getNumPartitions() > 1


def test_names_without_edges_or_digits_are_judged_as_others(spark):
    texts = ["华为", "华", "的华为", "华为的", "华为的\u0085", " 华为", "华为\n", "设有部门于", "属于", "公司", "项目", "在", "1995年", "华为2001", "20华", "a华为", "abc", "华abc", "华" * 30, "华" * 31, "一二三", "", "华为 于 在", "北京\u3000", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    clean = F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(F.btrim("t", F.lit(tx.BLANKS)), rf"^(?:(?:{tx.EDGE}){tx.SPACE}*)+", ""), F.lit(tx.BLANKS)), rf"(?:{tx.SPACE}*(?:{tx.EDGE}))+$", ""), F.lit(tx.BLANKS))
    for r in df.select("t", tx.clean_mention(F.col("t")).alias("got"), clean.alias("want")).collect():
        assert r.got == r.want, r
    c = F.col("t")
    foreign = F.length(F.regexp_replace(c, f"[{tx.CJK}]", "")) * 10 > F.length(c) * 7
    digits = (c.rlike(r"\p{Nd}{4}") & c.rlike(f"[{tx.CJK}]{{2,}}")) | (c.rlike(r"\p{Nd}{3,}") & (F.length(F.regexp_replace(c, r"\p{Nd}", "")) < 3))
    valid = F.length(c).between(2, 30) & c.rlike(f"[{tx.CJK}]") & (c.rlike(f"^{tx.DATE}$") | ~(c.isin(*lx.GENERIC_NOUNS) | foreign | digits))
    for r in df.where("t is not null").select("t", tx.is_valid_mention(c).alias("got"), valid.alias("want")).collect():
        assert r.got == r.want, r
