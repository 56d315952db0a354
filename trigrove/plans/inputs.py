"""Inputs of the registered queries, derived from the test tables by SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

INPUTS = {
    "triples": """
select '客户' || cast(c_custkey as string) as e1, '位于' as rel, n_name as e2, cast(c_custkey * 64 as bigint) as ordinal from customer join nation on c_nationkey = n_nationkey
union all select '供应商' || cast(s_suppkey as string), '位于', n_name, cast(s_suppkey * 64 + 1 as bigint) from supplier join nation on s_nationkey = n_nationkey
union all select n_name, '属于', r_name, cast(n_nationkey * 64 + 2 as bigint) from nation join region on n_regionkey = r_regionkey
union all select '供应商' || cast(l_suppkey as string), '生产', p_name, cast(l_orderkey * 64 + l_linenumber * 4 + 3 as bigint) from lineitem join part on p_partkey = l_partkey""",
    "dirty": """
select case when ordinal % 7 = 0 then e1 || '技术有限公司' when ordinal % 11 = 0 then '由' || e1 when ordinal % 17 = 0 then '公司' when ordinal % 19 = 0 then e1 || '和' || e2 else ' ' || e1 end as e1,
  case when ordinal % 23 = 0 then '包含' else rel end as rel,
  case when ordinal % 13 = 0 then e1 when ordinal % 5 = 0 then e2 || '等' when ordinal % 29 = 0 then '于1987年在' || e2 when ordinal % 31 = 0 then e2 || '集团、' || e1 when ordinal % 37 = 0 then '' else e2 end as e2, ordinal
from triples""",
    "prose": """
select cast(c_custkey as bigint) as doc_id, '客户' || cast(c_custkey as string) || '总部位于' || n_name || '，还研发了产品' || cast(c_custkey % 50 as string) || '。供应商' || cast(c_custkey % 97 as string)
  || '和供应商' || cast(c_custkey % 89 as string) || '投资了客户' || cast(c_custkey % 61 as string) || '；产品' || cast(c_custkey % 50 as string) || '由张' || cast(c_custkey % 7 as string) || '伟创立！李'
  || cast(c_custkey % 9 as string) || '担任组织' || cast(c_custkey % 3 as string) || '的主管\n王明著有《' || n_name || '志》,' || n_name || '隶属于' || r_name || '?' as text
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey""",
    "names": """
select distinct name from (select e1 as name from dirty union all select e2 from dirty union all select cast(c_custkey % 3000 as string) || '年成立的' || c_mktsegment from customer
  union all select '包括' || n_name || '部的' from nation union all select '李' || r_name from region union all select '王小' || cast(c_custkey % 7 as string) from customer
  union all select cast(1900 + c_custkey % 120 as string) || '年' from customer union all select '在中国北京' || cast(s_suppkey as string) || '领域' from supplier) as n""",
    "techniques": """
select ordinal % 100 as doc_id, cast(ordinal % 3 as int) as chunk_idx, e1, rel, e2, case ordinal % 4 when 0 then 'rule' when 1 then 'template' when 2 then 'dep' else 'zero_shot' end as technique, ordinal from triples
union all select ordinal % 100, cast(ordinal % 3 as int), e1, rel, e2, 'rule', ordinal + 1000000000 from triples where ordinal % 3 = 0""",
    "keyed": """
select cast(ordinal % 500 as bigint) as batch_id, ordinal, e1, rel, e2 from triples""",
    "responses": """
select ordinal as doc_id, case ordinal % 5 when 0 then '```json [["' || e1 || '","' || rel || '","' || e2 || '"],["a","b"],7]```' when 1 then 'answer: [["' || e1 || '","' || rel || '","' || e2 || '"],["李'
  when 2 then 'none' when 3 then '[["' || e1 || '", "' || rel || '", "' || e2 || '"], ["甲公司", "收购", "乙集团"]]' else '[]' end as response from triples""",
    "verdict_texts": """
select batch_id, case batch_id % 4 when 0 then '[{"index": 1, "valid": false, "reason": "x"}, {"index": 2, "valid": false, "correction": ["甲", "位于", "乙"]}, {"index": 999999, "valid": false}]'
  when 1 then '```json\n[{"index": 1}, {"index": 3, "valid": true, "reason": "ok"}]\n```' when 2 then 'bad [' else '[{"index": 2, "valid": false, "correction": ["丙"]}]' end as response
from (select distinct batch_id from keyed) as b""",
    "line_of": """
select cast(l_orderkey as bigint) as doc_id, cast(l_linenumber as int) as sent_idx, min(l_suppkey) as s, min(l_partkey) as p from lineitem group by l_orderkey, l_linenumber""",
    "annotated": """
select doc_id, sent_idx, 0 as tok_i, 0 as char_start, '供应商' || cast(s % 90 as string) as text, 'PROPN' as pos, 'nsubj' as dep, 1 as head_i, 'ORG' as ent_type from line_of
union all select doc_id, sent_idx, 1, 8, case s % 3 when 0 then '生产' when 1 then '研发' else '走' end, 'VERB', 'ROOT', 1, '' from line_of
union all select doc_id, sent_idx, 2, 10, cast(2000 + p % 30 as string), 'NUM', 'nummod', 3, 'ORG' from line_of
union all select doc_id, sent_idx, 3, 14, '华为', 'PROPN', case when p % 4 = 0 then 'nmod' else 'compound:nn' end, 4, case when s % 4 = 0 then '' else 'ORG' end from line_of
union all select doc_id, sent_idx, 4, 16, '零件' || cast(p % 7 as string), 'NOUN', 'compound:nn', 5, '' from line_of
union all select doc_id, sent_idx, 5, 19, case p % 3 when 0 then '技术部' when 1 then '研究院' else '项目' end, 'NOUN', 'obj', 1, '' from line_of
union all select doc_id, sent_idx, 6, 22, '业务科', 'NOUN', 'compound:nn', case when s % 5 < 2 then 5 else 9 end, '' from line_of
union all select doc_id, sent_idx, 7, 25, cast(1990 + s % 30 as string) || '年', 'NOUN', 'obl', 1, 'DATE' from line_of
union all select doc_id, sent_idx, 8, 30, case when p % 5 = 0 then 'Beijing' else '北京' end, 'PROPN', 'obl', 1, case when s % 6 = 0 then '' else 'GPE' end from line_of
union all select doc_id, sent_idx, 9, 37, case when p % 2 = 0 then '主管处' else '李明' end, case when p % 2 = 0 then 'NOUN' else 'PROPN' end, case when s % 7 = 0 then 'compound:nn' else 'dep' end, 5, case when p % 11 = 0 then 'PERSON' else '' end from line_of""",
    "edits": """
select ordinal as row_id, e1 || '改' as e1, rel, e2 from triples where ordinal % 10 = 0 union all select -1, 'x', 'y', 'z'""",
}
#: Inputs that an input builds on.
NEEDS = {"dirty": ("triples",), "names": ("triples", "dirty"), "techniques": ("triples",), "keyed": ("triples",), "responses": ("triples",), "verdict_texts": ("triples", "keyed"), "edits": ("triples",), "annotated": ("line_of",)}


def with_inputs(*names: str) -> str:
    """``with`` clauses of the named inputs and of what they need, for either engine."""
    order: list[str] = []
    for name in names:
        order += [n for n in (*NEEDS.get(name, ()), name) if n not in order]
    return "with " + ", ".join(f"{n} as ({INPUTS[n]})" for n in order)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input, or a table, as a DataFrame."""
    if name not in INPUTS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for t in TABLES:
        if t in INPUTS[name] or any(t in INPUTS[n] for n in NEEDS.get(name, ())):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    return spark.sql(f"{with_inputs(name)} select * from {name}")
