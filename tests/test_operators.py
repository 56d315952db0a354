"""Operators on small known cases."""

from hypothesis import given, settings
from hypothesis import strategies as st

from trigrove.functions.numbering import dense_number
from trigrove.operators import cleaning, graph, mentions, model, patterns, relations, table, text, validation
from trigrove.plans.pipeline import extract_triples

TRIPLE = "e1 string, rel string, e2 string, ordinal long"


def triples(spark, rows):
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], TRIPLE)


def got(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab。\n；", max_size=120), st.integers(1, 30), st.integers(0, 29))
def test_chunks_cover_the_text_and_end(text_, size, overlap):
    bounds = text.chunk_bounds(text_, size, overlap)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text_)
    assert all(b[0] <= a[1] and b[0] > a[0] for a, b in zip(bounds, bounds[1:], strict=False)) and all(b - a <= max(size, 0) for a, b in bounds)


def test_clauses_and_carried_subjects(spark):
    df = spark.createDataFrame([(1, "我就是太阳！卧槽\n我是奶  酪  ，  不是吧兄弟？ai。"), (2, "比亚迪不仅生产汽车，还研发了刀片电池技术"), (3, ""), (4, None)], "doc_id long, text string")
    clauses = got(text.split_clauses(df), "doc_id", "clause_idx", "clause")
    assert [c for d, _, c in clauses if d == 1] == ["我就是太阳", "卧槽", "我是奶  酪", "不是吧兄弟", "ai"]
    assert got(text.carry_subject(df.where("doc_id = 2")), "clause") == [("比亚迪不仅生产汽车",), ("比亚迪研发了刀片电池技术",)]
    assert text.nonblank_documents(df).count() == 2


def test_rules_and_templates(spark):
    df = spark.createDataFrame([(1, "华为总部位于深圳。字节跳动由张一鸣创办，张三担任华为的经理")], "doc_id long, text string")
    clauses = text.split_clauses(df)
    rules = got(patterns.rule_extract(clauses), "e1", "rel", "e2")
    assert ("华为", "位于", "深圳") in rules and ("张一鸣", "创建", "字节跳动") in rules and ("张三", "任职", "华为") in rules and ("张三", "担任", "经理") in rules
    assert ("华为", "位于", "深圳") in got(patterns.template_extract(clauses), "e1", "rel", "e2")
    own = patterns.default_rules(spark).where("relation = '位于'")
    assert got(patterns.rule_extract(clauses, own), "e1", "rel", "e2") == [("华为", "位于", "深圳")]
    cols = ("rule_id", "match_idx", "e1", "rel", "e2")
    assert got(patterns.template_extract(clauses, patterns.default_templates(spark)), *cols) == got(patterns.template_extract(clauses), *cols)


def test_clean_and_rejected(spark):
    rows = [("激素", "包含", "激素"), ("玻璃", "生产", "食品"), ("工业", "生产", "莫扎特"), ("中国", "位于", "尼泊尔"), ("华为", "研发", "5G芯片"), ("华为技术有限公司", "位于", "深圳等"), (None, "位于", "x"), ("长" * 60, "位于", "深圳")]
    df = triples(spark, rows)
    assert got(cleaning.clean_triples(df), "e1", "rel", "e2") == [("华为", "位于", "深圳"), ("华为", "研发", "5G芯片")]
    assert dict(got(cleaning.rejected_counts(df), "reason", "n")) == {"self": 1, "generic": 2, "bad_pair": 1, "empty": 1, "too_long": 1}
    once = cleaning.clean_triples(df)
    assert got(cleaning.clean_triples(once), "e1", "e2") == got(once, "e1", "e2")


def test_expand_and_dedupe(spark):
    df = triples(spark, [("比尔盖茨和保罗艾伦", "创建", "微软"), ("华为公司", "位于", "深圳"), ("华为", "位于", "深圳")])
    assert got(cleaning.expand_conjunctions(df.limit(1)), "e1", "e2") == [("保罗艾伦", "微软"), ("比尔盖茨", "微软")]
    assert got(cleaning.dedupe_normalized(df.where("ordinal > 0")), "e1") == [("华为公司",)]


def test_mentions_fuse_and_pair(spark):
    sents = spark.createDataFrame([(1, 0, "腾讯的技术中心位于深圳，1998年")], "doc_id long, sent_idx int, sent_text string")
    names = spark.createDataFrame([("腾讯", "组织名"), ("技术中心", "组织名"), ("深圳", "地名"), ("1998年", "时间")], "name string, etype string")
    found = mentions.gazetteer_mentions(sents, names)
    assert found.count() == 4
    fused = mentions.merge_adjacent_mentions(found, sents)
    assert got(fused, "text", "etype")[-1] == ("腾讯的技术中心", "组织名") and fused.count() == 3
    assert got(relations.pair_relations(fused, sents), "e1", "rel", "e2") == [("腾讯的技术中心", "位于", "深圳")]
    assert got(relations.typed_template_pairs(fused, sents), "e1", "rel", "e2") == [("腾讯的技术中心", "位于", "深圳")]


def test_token_relations(spark):
    schema = "doc_id long, sent_idx int, tok_i int, char_start int, text string, lemma string, pos string, dep string, head_i int, ent_type string"
    rows = [(1, 0, 0, 0, "任正非", "任正非", "PROPN", "nsubj", 1, "PERSON"), (1, 0, 1, 3, "创立", "创立", "VERB", "ROOT", 1, ""), (1, 0, 2, 5, "华为", "华为", "PROPN", "obj", 1, "ORG"), (1, 0, 3, 7, "1987年", "1987年", "NOUN", "obl", 1, "DATE"), (1, 0, 4, 12, "技术", "技术", "NOUN", "compound:nn", 5, ""), (1, 0, 5, 14, "研究院", "研究院", "NOUN", "dep", 1, "")]
    tokens = spark.createDataFrame(rows, schema)
    assert got(relations.svo_relations(tokens), "e1", "rel", "e2") == [("任正非", "创建", "华为"), ("任正非", "成立", "1987年")]
    assert ("技术研究院", "组织名") in got(mentions.token_mentions(tokens), "text", "etype")


def test_token_relations_take_the_list_of_generic_nouns(spark):
    schema = "doc_id long, sent_idx int, tok_i int, char_start int, text string, lemma string, pos string, dep string, head_i int, ent_type string"
    rows = [(1, 0, 0, 0, "任正非", "任正非", "PROPN", "nsubj", 1, "PERSON"), (1, 0, 1, 3, "创立", "创立", "VERB", "ROOT", 1, ""), (1, 0, 2, 5, "合同", "合同", "NOUN", "obj", 1, "")]
    tokens = spark.createDataFrame(rows, schema)
    assert got(relations.svo_relations(tokens), "e1") == []
    assert got(relations.svo_relations(tokens, ("项目",)), "e1", "rel", "e2") == [("任正非", "创建", "合同")]


def test_model_parsing_and_allocation(spark):
    df = spark.createDataFrame([(1, '```json\n[["张三","任职","华为"],["a","b"],5]\n```'), (2, '[["张三","任职","华为"],["李'), (3, "none"), (4, None)], "doc_id long, response string")
    assert got(model.parse_model_triples(df), "doc_id", "e1") == [(1, "张三"), (2, "张三")]
    for n, want in ((7, [2, 2, 3]), (2, [0, 0, 2])):
        rows = spark.createDataFrame([(1, 3, k + 1) for k in range(n)], "batch_id long, n_texts int, rn int")
        idx = [r.text_idx for r in model.allocate_batch_results(rows).collect()]
        assert [idx.count(k) for k in range(3)] == want
    prompts = spark.createDataFrame([(k, "p") for k in range(5)], "id long, prompt string")
    assert {r.response for r in model.infer_batch(prompts, lambda ps: 1 / 0).collect()} == {""}


def test_verdicts(spark):
    rows = spark.createDataFrame([(0, k, f"名{k}", "位于", "深圳") for k in (1, 2, 3, 4)], "batch_id long, idx int, e1 string, rel string, e2 string")
    text_ = '[{"index":1,"valid":true},{"index":2,"valid":false,"correction":["甲","位于","乙"]},{"index":3,"valid":false},{"index":9,"valid":false}]'
    verdicts = validation.parse_verdicts(spark.createDataFrame([(0, text_), (1, "bad")], "batch_id long, response string"))
    assert got(validation.apply_verdicts(rows, verdicts), "e1") == [("名1",), ("名4",), ("甲",)]
    assert validation.verdict_summary(verdicts).first().asDict() == {"passed": 1, "failed": 3, "corrected": 1}


def test_graph_merges_are_idempotent(spark):
    df = triples(spark, [("A", "x", "B"), ("A", "y", "B"), ("B", "x", "B"), ("A", "x", "B")])
    empty_nodes, empty_edges = graph.graph_nodes(df.limit(0)), graph.graph_edges(df.limit(0))
    nodes, edges = graph.merge_nodes(df, empty_nodes), graph.merge_edges(df, empty_edges)
    assert nodes.count() == 2 and edges.count() == 3
    assert graph.merge_nodes(df, nodes).count() == 2 and graph.merge_edges(df, edges).count() == 3
    assert got(graph.viz_edges(df.where("ordinal < 2")), "from", "to", "label") == [("A", "B", "y")]
    words = spark.createDataFrame([(w,) for w in ("A", "", "zz")], "keyword string")
    assert graph.search_keywords(edges, words).count() == 2 and graph.search_keyword(edges, "").count() == 0
    graph.BROADCAST_WORDS, kept = 0, graph.BROADCAST_WORDS
    try:
        assert graph.search_keywords(edges, words).count() == 2
    finally:
        graph.BROADCAST_WORDS = kept


def test_numbers_are_dense_for_any_number_of_parts(spark):
    df = spark.range(500).selectExpr("id * 7 % 501 as n", "id as tie").repartition(7)
    for parts in (1, 7):
        rows = dense_number(df, "n", "at", ("tie",), parts=parts).orderBy("n").collect()
        assert [r["at"] for r in rows] == list(range(1, 501))
    assert dense_number(df.limit(0), "n", "at").count() == 0


def test_table_edits_and_pages(spark):
    df = triples(spark, [(f"a{k}", "r", "b") for k in range(31)]).withColumnRenamed("ordinal", "row_id")
    edits = spark.createDataFrame([(3, "X", "r", "b"), (99, "Y", "r", "b")], "row_id long, e1 string, rel string, e2 string")
    assert [r.e1 for r in table.update_triples(df, edits).orderBy("row_id").collect()][3] == "X"
    rest = table.delete_triples(df, edits)
    assert [r.row_id for r in rest.orderBy("row_id").collect()] == list(range(30))
    assert table.pages(31) == 2 and table.page(df.withColumnRenamed("row_id", "ordinal"), 2).count() == 11 and table.page_by_id(df, 2).count() == 11
    assert table.add_triples(df, edits.selectExpr("row_id", "e1", "rel", "'' as e2")).count() == 31


def test_whole_extraction(spark):
    df = spark.createDataFrame([(1, "华为总部位于深圳。任正非创立了华为。"), (2, None), (3, "  ")], "doc_id long, text string")
    assert got(extract_triples(df), "doc_id", "e1", "rel", "e2") == [(1, "任正非", "创建", "华为"), (1, "华为", "位于", "深圳")]
