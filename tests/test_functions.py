"""Name rules on small known cases."""

import pytest
from pyspark.sql import functions as F

from trigrove.functions import lexicon as lx
from trigrove.functions import text as tx


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "c string").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize("name", ["公司", "总部", "信息", "技术", "科技", "工业", "平台", "系统", "A", "2024"])
def test_generic(spark, name):
    assert one(spark, name, tx.is_generic_entity)


@pytest.mark.parametrize("name", ["华为", "阿里巴巴", "北京", "5G芯片", "拼多多", "字节跳动"])
def test_not_generic(spark, name):
    assert not one(spark, name, tx.is_generic_entity)


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (tx.normalize_entity, "阿里巴巴集团", "阿里巴巴"), (tx.normalize_entity, "公司", "公司"), (tx.normalize_entity, "A集团", "A集团"), (tx.normalize_entity, "云计算技术", "云计算"),
        (tx.normalize_entity_e2, "云计算技术", "云计算技术"), (tx.normalize_entity_e2, "华为技术有限公司", "华为"),
        (tx.clean_entity, "通用电气", "用电气"), (tx.clean_entity, "1987年", "1987年"), (tx.clean_entity, "腾讯总部", "腾讯"), (tx.clean_entity, " 由华为 ", "华为"), (tx.clean_entity, None, None),
        (tx.clean_mention, "包括深圳", "括深圳"), (tx.clean_mention, "张三隶", "张三"),
        (tx.is_valid_mention, "1987年", True), (tx.is_valid_mention, "客户1234", False), (tx.is_valid_mention, "流程", False), (tx.is_valid_mention, "A", False), (tx.is_valid_mention, "华为", True),
        (tx.escape_relation, "创建", "`创建`"), (tx.escape_relation, "FOUNDER", "FOUNDER"), (tx.escape_relation, "A B", "`A B`"), (tx.escape_relation, "a`b", "`a``b`"),
        (tx.escape_value, "a\\b'c\"d", "a\\\\b\\'c\\\"d"), (tx.clause_subject, "我们不仅是太阳", "我们"), (tx.clause_subject, "无", None),
    ],
)
def test_rules(spark, f, value, want):
    assert one(spark, value, f) == want


def test_unescape_reverses_escape(spark):
    values = ["a\\b'c\"d", "\\\\", "'", "plain", ""]
    rows = spark.createDataFrame([(v,) for v in values], "c string").select("c", tx.unescape_value(tx.escape_value(F.col("c"))).alias("r")).collect()
    assert all(r.c == r.r for r in rows)


@pytest.mark.parametrize("name", ["采购", "绩效", "合同", "订单", "会议室", "招聘", "五险一金"])
def test_generic_nouns_are_no_mentions(spark, name):
    assert len(lx.GENERIC_NOUNS) == len(set(lx.GENERIC_NOUNS)) == 283
    assert not one(spark, name, tx.is_valid_mention)
    assert one(spark, name, lambda c: tx.is_valid_mention(c, ("项目",)))
