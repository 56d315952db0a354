"""All registered queries of the triple and graph operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trigrove.functions import lexicon as lx
from trigrove.functions import text as tx
from trigrove.functions.tables import scratch
from trigrove.operators import cleaning, graph, mentions, model, patterns, relations, table, text, validation
from trigrove.plans import duck
from trigrove.plans.inputs import read, with_inputs
from trigrove.plans.pipeline import extract_triples as run_extraction
from trigrove.sources import files
from trigrove.sources.store import KeyedStore
from trigrove.streaming.merge import EDGES, NODES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "extract_triples"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scratch(spark: SparkSession) -> str:
    return scratch(spark, "files")


def _recursive(ctes: str) -> str:
    return ctes.replace("with ", "with recursive ", 1)


T, D, P = with_inputs("triples"), with_inputs("dirty"), with_inputs("prose")


# Sources and sinks


@query("""select c_nationkey::bigint as nation, 'txt' as ext, string_agg(c_name, chr(10) order by c_custkey) || chr(10) as text,
  length(string_agg(c_name, chr(10)))::bigint + 1 as n_chars, 'ok' as status from customer group by c_nationkey""")
def read_text_documents(spark, sf):
    path = _scratch(spark)
    names = read(spark, sf, "customer").select("c_nationkey", "c_custkey", F.col("c_name").alias("value"))
    names.repartition("c_nationkey").sortWithinPartitions("c_nationkey", "c_custkey").drop("c_custkey").write.partitionBy("c_nationkey").text(path)
    docs = files.read_text_documents(spark, path)
    return docs.select(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).cast("long").alias("nation"), "ext", "text", "n_chars", "status")


def _sparse(spark, sf):
    return read(spark, sf, "triples").withColumn("e2", F.when(F.col("ordinal") % 9 != 0, F.col("e2")))


@query(f"{T} select e1, rel, e2 from triples where ordinal % 9 <> 0")
def read_triples_csv(spark, sf):
    path = _scratch(spark)
    _sparse(spark, sf).select("e1", "rel", "e2").write.option("header", True).csv(path)
    return files.read_triples_csv(spark, path)


@query(f"{T} select e1, rel, e2 from triples where ordinal % 9 <> 0")
def export_triples_csv(spark, sf):
    path = _scratch(spark)
    files.export_triples_csv(_sparse(spark, sf), path)
    return files.read_triples_csv(spark, path)


@query(f"{T} select e1, rel, e2, min(late)::int as late, arg_min(ordinal, late * 1000000000000 + ordinal) as ordinal from (select *, case when ordinal % 2 = 0 then 0 else 1 end as late from triples) group by all")
def write_triples_append(spark, sf):
    rows = read(spark, sf, "triples")
    return files.merged_triples(rows.where("ordinal % 2 != 0"), rows.where("ordinal % 2 = 0"), "append")


@query(f"{T} select * from triples where ordinal % 2 <> 0")
def write_triples_overwrite(spark, sf):
    rows = read(spark, sf, "triples")
    return files.merged_triples(rows.where("ordinal % 2 != 0"), rows, "overwrite")


def _merged_twice(spark, rows: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """A store that got a part of the rows first, then all of them."""
    store = KeyedStore(spark, _scratch(spark), schema, keys)
    store.merge(rows.where(F.abs(F.xxhash64(*keys)) % 3 == 0))
    store.merge(rows)
    return store.read()


@query(f"{T} select e1, rel, e2, min(ordinal) as ordinal from triples group by all")
def write_triples_stored(spark, sf):
    return _merged_twice(spark, read(spark, sf, "triples"), "e1 string, rel string, e2 string, ordinal long", ["e1", "rel", "e2"])


_ESC = "replace(replace(replace({0}, '\\', '\\\\'), '''', '\\'''), '\"', '\\\"')"
_LINE = f"'MERGE (a:Entity {{name: ''' || {_ESC.format('e1')} || '''}}) MERGE (b:Entity {{name: ''' || {_ESC.format('e2')} || '''}}) MERGE (a)-[:`' || rel || '`]->(b);'"
_QUOTED = "select e1 || case when ordinal % 3 = 0 then '\"x''' else '' end as e1, rel, e2, ordinal from triples"


def _quoted(spark, sf):
    return read(spark, sf, "triples").withColumn("e1", F.concat("e1", F.when(F.col("ordinal") % 3 == 0, "\"x'").otherwise("")))


@query(f"{T} select ordinal, {_LINE} as line from ({_QUOTED})")
def graph_script_lines(spark, sf):
    return files.graph_script_lines(_quoted(spark, sf))


@query(f"{T} select e1, rel, e2 from ({_QUOTED})")
def read_graph_script(spark, sf):
    path = _scratch(spark)
    files.write_graph_script(_quoted(spark, sf), path)
    return files.read_graph_script(spark, path)


# Text


@query(f"select doc_id, text from documents where text is not null and {duck.sub('text', tx.SPACE + '+')} <> ''")
def nonblank_documents(spark, sf):
    return text.nonblank_documents(read(spark, sf, "documents")).select("doc_id", "text")


@query(r"""
with recursive d as (select doc_id, text, length(text) as n from documents where regexp_replace(text, '[\s\p{Z}]+', '', 'g') <> '')
, c as (
  select doc_id, text, n, 0 as chunk_idx, 0 as s, 0 as nxt, 0 as e from d where false
  union all select doc_id, text, n, 0, 0, -1, -1 from d
), step as (
  select doc_id, 0 as chunk_idx, 0 as s, case when n <= 2000 then n else cut end as e, n from (select doc_id, n,
    case when p > 1 then p else 2000 end as cut from (select doc_id, n, case when contains(w, '。') then length(w) - position('。' in reverse(w)) + 1 when contains(w, chr(10)) then length(w) - position(chr(10) in reverse(w)) + 1
      when contains(w, '；') then length(w) - position('；' in reverse(w)) + 1 else 0 end as p from (select doc_id, n, text[1:2000] as w from d)))
  union all
  select doc_id, chunk_idx + 1, s2, case when s2 + 2000 >= n then n when p > 1 then s2 + p else s2 + 2000 end, n from (
    select doc_id, chunk_idx, s2, n, case when contains(w, '。') then length(w) - position('。' in reverse(w)) + 1 when contains(w, chr(10)) then length(w) - position(chr(10) in reverse(w)) + 1
      when contains(w, '；') then length(w) - position('；' in reverse(w)) + 1 else 0 end as p from (
      select step.doc_id, chunk_idx, step.n, case when e - 200 <= s then e else e - 200 end as s2, substr(text, case when e - 200 <= s then e else e - 200 end + 1, 2000) as w
      from step join d on step.doc_id = d.doc_id where e < step.n))
)
select step.doc_id, chunk_idx::int as chunk_idx, s::int as start_pos, e::int as end_pos, substr(text, s + 1, e - s) as chunk_text from step join d on step.doc_id = d.doc_id
""".replace("""
, c as (
  select doc_id, text, n, 0 as chunk_idx, 0 as s, 0 as nxt, 0 as e from d where false
  union all select doc_id, text, n, 0, 0, -1, -1 from d
)""", ""))
def chunk_text(spark, sf):
    return text.chunk_text(read(spark, sf, "documents"))


@query("select conv_id as doc_id, string_agg(text, chr(10) || chr(10) order by turn, text) as text from conversations group by conv_id")
def clean_chunks_join(spark, sf):
    turns = read(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_idx"), F.col("text").alias("chunk_text"))
    return text.clean_chunks_join(turns)


@query(f"select * from {duck.clauses('documents')}")
def split_clauses(spark, sf):
    return text.split_clauses(read(spark, sf, "documents").select("doc_id", "text"))


@query(f"select * from {duck.sentences('documents')}")
def split_sentences(spark, sf):
    return text.split_sentences(read(spark, sf, "documents").select("doc_id", "text"))


@query(f"{P} select doc_id, clause_idx, clause, nullif(regexp_extract(clause, {duck.quote(tx.SUBJECT)}, 1), '') as subject from {duck.clauses('prose')}")
def clause_subject(spark, sf):
    return text.clause_subjects(text.split_clauses(read(spark, sf, "prose")))


_CARRIED = f"""recursive_carry as (
  select doc_id, 0 as clause_idx, clause, nullif(regexp_extract(clause, {duck.quote(tx.SUBJECT)}, 1), '') as subject from cl where clause_idx = 0
  union all
  select doc_id, clause_idx, clause, coalesce(nullif(regexp_extract(clause, {duck.quote(tx.SUBJECT)}, 1), ''), subject) from (
    select cl.doc_id, cl.clause_idx, case when subject is not null and {duck.has('cl.clause', tx.CARRY)} then subject || regexp_replace(cl.clause, {duck.quote(tx.CARRY)}, '') else cl.clause end as clause, subject
    from recursive_carry r join cl on cl.doc_id = r.doc_id and cl.clause_idx = r.clause_idx + 1))"""
_CARRY = P.replace("with ", "with recursive ", 1) + f", cl as (select * from {duck.clauses('prose')}), {_CARRIED}"


@query(f"{_CARRY} select doc_id, clause_idx::int as clause_idx, clause from recursive_carry")
def carry_subject(spark, sf):
    return text.carry_subject(read(spark, sf, "prose"))


# Patterns


def _rule_sql(rows, technique: str) -> str:
    """One select per rule: all matches of its pattern in the carried clauses."""
    out = []
    for rule_id, rel, pattern, trigger, back in rows:
        a, b = (f"regexp_extract_all(clause, {duck.quote(pattern)}, {g})" for g in (1, 2))
        left, right = ("b", "a") if back else ("a", "b")
        out.append(
            f"select doc_id, clause_idx, {rule_id} as rule_id, (i - 1)::int as match_idx, {left}[i] as e1, '{rel}' as rel, {right}[i] as e2, '{technique}' as technique from"
            f" (select *, {a} as a, {b} as b from cc where contains(clause, '{trigger}')) m, lateral (select unnest(range(1, len(a) + 1)) as i) r"
        )
    return " union all ".join(out)


def _posts_sql() -> str:
    out = []
    for k, verb in enumerate(lx.POST_RULES):
        p = duck.quote(f"({tx.WORD}{{2,8}}){verb}({tx.WORD}{{2,10}})的({tx.WORD}{{2,10}})")
        for m, (rel, g) in enumerate((("任职", 2), ("担任", 3))):
            out.append(f"select doc_id, clause_idx, {1000 + k}, {m}, regexp_extract(clause, {p}, 1), '{rel}', regexp_extract(clause, {p}, {g}), 'rule' from cc where regexp_matches(clause, {p})")
    return " union all ".join(out)


_CC = f"{_CARRY}, cc as (select doc_id, clause_idx::int as clause_idx, clause from recursive_carry)"


@query(f"{_CC} {_rule_sql(patterns.rule_rows(), 'rule')} union all {_posts_sql()}")
def rule_extract(spark, sf):
    return patterns.rule_extract(text.carry_subject(read(spark, sf, "prose")))


@query(f"{_CC} {_rule_sql(patterns.template_rows(), 'template')}")
def template_extract(spark, sf):
    return patterns.template_extract(text.carry_subject(read(spark, sf, "prose")))


# Mentions


@query("select etype as label_type, count(*) as n from (select case event_type when 'click' then '人名' when 'view' then '地名' when 'purchase' then '组织名' end as etype from events) where etype is not null group by all")
def map_entity_labels(spark, sf):
    label = F.when(F.col("event_type") == "click", "PERSON").when(F.col("event_type") == "view", "GPE").when(F.col("event_type") == "purchase", "NORP").otherwise("CARDINAL")
    rows = mentions.map_entity_labels(read(spark, sf, "events").select(label.alias("label")))
    return rows.groupBy(F.col("etype").alias("label_type")).agg(F.count(F.lit(1)).alias("n"))


def _gazetteer(spark, sf):
    one = read(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit("地名").alias("etype"))
    two = read(spark, sf, "customer").select(F.concat(F.lit("客户"), F.col("c_custkey").cast("string")).alias("name"), F.lit("组织名").alias("etype"))
    three = read(spark, sf, "customer").select(F.concat(F.lit("产品"), (F.col("c_custkey") % 50).cast("string")).alias("name"), F.lit("产品名").alias("etype")).distinct()
    four = read(spark, sf, "customer").select(F.concat(F.lit("供应商"), (F.col("c_custkey") % 97).cast("string")).alias("name"), F.lit("组织名").alias("etype")).distinct()
    return one.union(two).union(three).union(four)


_GAZ = """gaz as (select n_name as name, '地名' as etype from nation union select '客户' || c_custkey, '组织名' from customer union select '产品' || (c_custkey % 50), '产品名' from customer union select '供应商' || (c_custkey % 97), '组织名' from customer)
, gm as (select s.doc_id, s.sent_idx, g.name as text, g.etype, (p - 1)::int as start, (p - 1 + length(g.name))::int as "end" from (select *, unnest(range(1, length(sent_text) + 1)) as p from st) s, (select distinct length(name) as n from gaz) l, gaz g
  where g.name = substr(s.sent_text, p, l.n) and p + l.n - 1 <= length(s.sent_text))"""
_GM = f"{P}, st as (select * from {duck.sentences('prose')}), {_GAZ}"


@query(f"{_GM} select * from gm")
def gazetteer_mentions(spark, sf):
    return mentions.gazetteer_mentions(text.split_sentences(read(spark, sf, "prose")), _gazetteer(spark, sf))


def _numbered(spark, sf):
    sents = text.split_sentences(read(spark, sf, "prose"))
    found = mentions.gazetteer_mentions(sents, _gazetteer(spark, sf))
    return mentions.merge_adjacent_mentions(found, sents), sents


def _tokens(spark, sf):
    """Annotated tokens of one sentence for each line item: a supplier, a verb, a part, a date and a place."""
    line = read(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("l")).select("l_orderkey", "l_linenumber", "l.*")
    rows = line.join(read(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    verbs = F.element_at(F.array(*[F.lit(v) for v in ("生产", "研发", "收购", "走")]), (F.col("l_orderkey") % 4 + 1).cast("int"))
    s = lambda t, pos, dep, head, ent: F.struct(t.alias("text"), t.alias("lemma"), F.lit(pos).alias("pos"), F.lit(dep).alias("dep"), F.lit(head).alias("head_i"), F.lit(ent).alias("ent_type"))
    brand = F.concat(F.lit("零件"), F.expr("right(p_brand, 2)"))
    toks = F.array(
        s(F.concat(F.lit("供应商"), (F.col("l_suppkey") % 90).cast("string")), "PROPN", "nsubj", 1, "ORG"), s(verbs, "VERB", "ROOT", 1, ""), s(brand, "NOUN", "compound", 3, ""),
        s(F.lit("技术部"), "NOUN", "obj", 1, ""), s(F.concat((F.col("l_orderkey") % 30 + 1990).cast("string"), F.lit("年")), "NOUN", "obl", 1, "DATE"), s(F.lit("北京"), "PROPN", "obl", 1, "GPE"),
    )
    flat = rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("int").alias("sent_idx"), F.posexplode(toks).alias("tok_i", "t")).select("doc_id", "sent_idx", "tok_i", "t.*")
    return flat.withColumn("char_start", F.col("tok_i") * 6)


@query(f"{_recursive(with_inputs('annotated'))}, {duck.TOKEN_MENTIONS} select * from token_names")
def token_mentions(spark, sf):
    return mentions.token_mentions(read(spark, sf, "annotated"))


@query(f"{with_inputs('names')} select name, {duck.clean_mention('name')} as cleaned from names")
def clean_mention(spark, sf):
    return read(spark, sf, "names").withColumn("cleaned", tx.clean_mention(F.col("name")))


@query(f"{with_inputs('names')} select name, {duck.valid_mention('name')} as valid from names")
def is_valid_mention(spark, sf):
    return read(spark, sf, "names").withColumn("valid", tx.is_valid_mention(F.col("name")))


_KIND = "case when length(name) % 3 = 0 then '地名' else '组织名' end"


@query(f"{with_inputs('names')} select name, {duck.person('name', _KIND)} as etype from names")
def infer_person_type(spark, sf):
    return read(spark, sf, "names").select("name", tx.infer_person_type(F.col("name"), F.expr(_KIND)).alias("etype"))


_FM = f"{_recursive(_GM)}, {duck.FUSED}"


@query(f"{_FM} select * from fm")
def merge_adjacent_mentions(spark, sf):
    return _numbered(spark, sf)[0]


@query(f"{_FM} {duck.matched(duck.pairs('fm', 'a.m_idx < b.m_idx and a.etype <> ' + duck.quote('时间') + ' and b.etype <> ' + duck.quote('时间')), 25, tx.CLAUSE_END)}")
def pair_relations(spark, sf):
    return relations.pair_relations(*_numbered(spark, sf))


_DATED = "dated as (select * replace (case when m_idx > 0 and (text like '产品%' or text like '供应商%') then '时间' else etype end as etype) from fm)"


@query(f"{_FM}, {_DATED} {duck.matched(duck.pairs('dated', 'a.etype <> ' + duck.quote('时间') + ' and b.etype = ' + duck.quote('时间')), 15)}")
def time_pair_relations(spark, sf):
    found, sents = _numbered(spark, sf)
    late = F.col("text").startswith("产品") | F.col("text").startswith("供应商")
    dated = found.withColumn("etype", F.when((F.col("m_idx") > 0) & late, "时间").otherwise(F.col("etype")))
    return relations.time_pair_relations(dated, sents)


def _types(spark, sf):
    types = F.array(*[F.lit(t) for t in lx.ENTITY_TYPES])
    pick = lambda k: F.element_at(types, (F.col("ordinal") % k % len(lx.ENTITY_TYPES) + 1).cast("int"))
    return read(spark, sf, "triples").select("ordinal", pick(97).alias("e1_type"), pick(89).alias("e2_type"))


_TYPE_LIST = "[" + ", ".join(f"'{t}'" for t in lx.ENTITY_TYPES) + "]"
_COMPAT_ROWS = ", ".join(f"('{a}', '{b}', '{r}')" for (a, b), rs in lx.TYPE_COMPAT.items() for r in rs)


@query(f"{T}, p as (select ordinal, {_TYPE_LIST}[ordinal % 97 % 9 + 1] as e1_type, {_TYPE_LIST}[ordinal % 89 % 9 + 1] as e2_type from triples) select * from p join (values {_COMPAT_ROWS}) c(e1_type, e2_type, relation) using (e1_type, e2_type)")
def type_compat_relations(spark, sf):
    return relations.type_compat_relations(_types(spark, sf))


@query(f"{_FM}, {duck.typed_pairs(duck.pairs('fm', 'a.m_idx <> b.m_idx'))}")
def typed_template_pairs(spark, sf):
    return relations.typed_template_pairs(*_numbered(spark, sf))


_POSTS = "select cast(c_custkey as bigint) as doc_id, 0 as sent_idx, '王小明在组织' || cast(c_custkey % 9 as string) || '担任主管，组织' || cast(c_custkey % 9 as string) || '由李大同于1990年创立' as sent_text from customer"
_POST_NAMES = [("王小明", "人名"), ("主管", "职位"), ("李大同", "人名"), ("1990年", "时间"), *[(f"组织{k}", "组织名") for k in range(9)]]
_POST_SQL = _FM[_FM.index("gm as") :]


@query(f"with recursive st as ({_POSTS}), gaz as (select * from (values {', '.join(map(str, _POST_NAMES))}) v(name, etype)), {_POST_SQL} {duck.typed_triples('fm')}")
def typed_template_triples(spark, sf):
    read(spark, sf, "customer").createOrReplaceTempView("customer")
    raw = spark.sql(_POSTS)
    found = mentions.gazetteer_mentions(raw, spark.createDataFrame(_POST_NAMES, "name string, etype string"))
    return relations.typed_template_triples(mentions.merge_adjacent_mentions(found, raw), raw)


@query(
    """with line as (select l_orderkey, l_linenumber, min(struct_pack(p := l_partkey, s := l_suppkey)) as l from lineitem group by all)
, s as (select l_orderkey as doc_id, min(l_linenumber)::int as sent_idx, '供应商' || (l.s % 90) as e1, case l_orderkey % 4 when 0 then '生产' when 1 then '研发' when 2 then '收购' end as rel, '零件' || right(p_brand, 2) || '技术部' as e2, (l_orderkey % 30 + 1990) || '年' as t
  from line join part on p_partkey = l.p where l_orderkey % 4 < 3 group by all)
select doc_id, e1, rel, e2, min(sent_idx)::int as sent_idx, 'dep' as technique from (select doc_id, sent_idx, e1, rel, e2 from s union all select doc_id, sent_idx, e1, '成立', t from s union all select doc_id, sent_idx, e1, '位于', '北京' from s) group by all"""
)
def svo_relations(spark, sf):
    return relations.svo_relations(_tokens(spark, sf))


_RANK = "case technique when 'few_shot' then 0 when 'zero_shot' then 1 when 'dep' then 2 when 'template' then 3 else 4 end"


@query(f"{with_inputs('techniques')} select doc_id, chunk_idx, e1, rel, e2, arg_min(technique, struct_pack(a := {_RANK}, b := ordinal)) as technique, arg_min(ordinal, struct_pack(a := {_RANK}, b := ordinal)) as ordinal from techniques group by all")
def merge_by_priority(spark, sf):
    return relations.merge_by_priority(read(spark, sf, "techniques"))


@query(f"{with_inputs('techniques')} select technique, count(*) as n from techniques group by all")
def technique_stats(spark, sf):
    return relations.technique_stats(read(spark, sf, "techniques"))


@query("select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) < 3")
def needs_model(spark, sf):
    fast = read(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"))
    return relations.needs_model(read(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), fast).select(F.col("doc_id").alias("c_custkey"))


# Model batches


@query(f"select doc_id, {duck.quote(model.PROMPTS['few_shot'])} || text as prompt from documents")
def build_prompts(spark, sf):
    return model.build_prompts(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "prompt")


@query("select doc_id, md5('few_shot:m1:' || text) as cache_key from documents")
def cache_keys(spark, sf):
    return model.cache_keys(read(spark, sf, "documents"), "few_shot", "m1").select("doc_id", "cache_key")


def _looked_up(spark, sf):
    keyed = model.cache_keys(read(spark, sf, "documents").select("doc_id", "text"), "few_shot", "m1")
    stored = keyed.where("doc_id % 3 = 0").select("cache_key", F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("triples"))
    return model.cache_lookup(keyed, stored)


@query("select doc_id from documents where text in (select text from documents where doc_id % 3 = 0)")
def cache_hits(spark, sf):
    return _looked_up(spark, sf)[0].select("doc_id")


@query("select distinct md5('few_shot:m1:' || text) as cache_key from documents where text not in (select text from documents where doc_id % 3 = 0)")
def cache_misses(spark, sf):
    return _looked_up(spark, sf)[1].select("cache_key")


@query("select doc_id, length(text)::string || ' characters' as response from documents")
def infer_batch(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", F.col("text").alias("prompt"))
    return model.infer_batch(docs, lambda prompts: [f"{len(p)} characters" for p in prompts]).select("doc_id", "response")


_PARSED = "select doc_id, 0 as item, e1, rel, e2 from (select ordinal as doc_id, e1, rel, e2 from triples where ordinal % 5 in (0, 1, 3)) union all select ordinal, 1, '甲公司', '收购', '乙集团' from triples where ordinal % 5 = 3"
_KEPT = duck.cleaned("raw", "doc_id, item")
_STRIP = lambda c: f"translate({c}, '\"''' || chr(10) || chr(13) || chr(9), '')"


@query(f"{T}, raw as ({_PARSED}) select doc_id, item::int as item, {_STRIP('e1')} as e1, {_STRIP('rel')} as rel, {_STRIP('e2')} as e2 from {_KEPT} where {duck.fault()} is null")
def parse_model_triples(spark, sf):
    return model.parse_model_triples(read(spark, sf, "responses"))


@query(f"""{with_inputs('keyed')}, r as (select batch_id, ordinal, row_number() over (partition by batch_id order by ordinal, e1, e2) as rn, count(*) over (partition by batch_id) as n, batch_id % 7 + 1 as k from keyed)
select batch_id, rn::int as rn, (case when n // k = 0 then k - 1 else least((rn - 1) // (n // k), k - 1) end)::int as text_idx from r""")
def allocate_batch_results(spark, sf):
    from pyspark.sql import Window

    order = Window.partitionBy("batch_id").orderBy("ordinal", "e1", "e2")
    rows = read(spark, sf, "keyed").withColumn("rn", F.row_number().over(order)).withColumn("n_texts", F.col("batch_id") % 7 + 1)
    return model.allocate_batch_results(rows).select("batch_id", "rn", "text_idx")


# Cleaning


@query(f"{with_inputs('names')} select name, {duck.clean_entity('name')} as cleaned from names")
def clean_entity(spark, sf):
    return read(spark, sf, "names").withColumn("cleaned", tx.clean_entity(F.col("name")))


@query(f"{with_inputs('names')} select name, {duck.normalize('name')} as e1_form, {duck.normalize_e2('name')} as e2_form from names")
def normalize_entity(spark, sf):
    name = F.col("name")
    return read(spark, sf, "names").select("name", tx.normalize_entity(name).alias("e1_form"), tx.normalize_entity_e2(name).alias("e2_form"))


@query(f"{with_inputs('names')} select name, {duck.generic('name')} as generic from names")
def is_generic_entity(spark, sf):
    return read(spark, sf, "names").withColumn("generic", tx.is_generic_entity(F.col("name")))


@query(f"{D} select ordinal, e1, rel, e2, {duck.pair_fault('e1', 'rel', 'e2')} as fault from dirty")
def is_valid_relation_pair(spark, sf):
    return read(spark, sf, "dirty").select("ordinal", "e1", "rel", "e2", tx.pair_fault(F.col("e1"), F.col("rel"), F.col("e2")).alias("fault"))


_CLEANED = duck.cleaned("dirty", "ordinal")


@query(f"{D} select ordinal, {_STRIP('e1')} as e1, {_STRIP('rel')} as rel, {_STRIP('e2')} as e2 from {_CLEANED} where {duck.fault()} is null")
def clean_triples(spark, sf):
    return cleaning.clean_triples(read(spark, sf, "dirty"))


@query(f"{D} select reason, count(*) as n from (select {duck.fault()} as reason from {_CLEANED}) where reason is not null group by all")
def rejected_triples(spark, sf):
    return cleaning.rejected_counts(read(spark, sf, "dirty"))


_PARTS = lambda c: f"list_filter(list_transform(regexp_split_to_array({c}, '{cleaning.SPLIT}'), lambda p: {duck.trim('p')}), lambda p: p <> '')"
_EXPAND = f"""pp as (select *, {_PARTS('e1')} as p1, {_PARTS('e2')} as p2 from dirty)
, cross_rows as (select ordinal, rel, a, unnest(p2) as b from (select ordinal, rel, unnest(p1) as a, p2 from pp where len(p1) > 1 or len(p2) > 1))
, expanded as (select e1, rel, e2, ordinal from pp where len(p1) <= 1 and len(p2) <= 1 union all select * from (select {duck.clean_entity('a')} as e1, rel, {duck.clean_entity('b')} as e2, ordinal from cross_rows) where e1 <> '' and e2 <> '')"""


@query(f"{D}, {_EXPAND} select * from expanded")
def expand_conjunctions(spark, sf):
    return cleaning.expand_conjunctions(read(spark, sf, "dirty"))


@query(f"""{D} select f.e1 as e1, rel, f.e2 as e2, f.ordinal as ordinal from (select rel, {duck.normalize('e1')} as n1, {duck.normalize('e2')} as n2, min(struct_pack(ordinal := ordinal, e1 := e1, e2 := e2)) as f from dirty group by all)""")
def dedupe_normalized(spark, sf):
    return cleaning.dedupe_normalized(read(spark, sf, "dirty"))


def _extract_sql() -> str:
    """The whole extraction over short documents: one chunk each, so clauses come from the text itself."""
    both = f"({_rule_sql(patterns.rule_rows(), 'rule')} union all {_posts_sql()} union all {_rule_sql(patterns.template_rows(), 'template')})"
    place = "(((0 * 2 + case when technique = 'template' then 0 else 1 end)::bigint * 4096 + rule_id) * 100000 + clause_idx) * 100000 + match_idx"
    rank = "case technique when 'template' then 3 else 4 end"
    merged = f"m as (select doc_id, e1, rel, e2, arg_min(o, struct_pack(a := {rank}, b := o)) as ordinal from (select *, {place} as o from {both}) group by all)"
    expand = _EXPAND.replace("from dirty", "from m").replace("select ordinal,", "select doc_id, ordinal,").replace("e2, ordinal from", "e2, ordinal, doc_id from")
    dedup = f"dd as (select doc_id, f.e1 as e1, rel, f.e2 as e2, f.ordinal as ordinal from (select doc_id, rel, {duck.normalize('e1')} as n1, {duck.normalize('e2')} as n2, min(struct_pack(ordinal := ordinal, e1 := e1, e2 := e2)) as f from expanded group by all))"
    return f"{_CC}, {merged}, {expand}, {dedup} select doc_id, ordinal, {_STRIP('e1')} as e1, {_STRIP('rel')} as rel, {_STRIP('e2')} as e2 from {duck.cleaned('dd', 'doc_id, ordinal')} where {duck.fault()} is null"


@query(_extract_sql())
def extract_triples(spark, sf):
    return run_extraction(read(spark, sf, "prose"))


# Validation


@query(f"""{with_inputs('keyed')}, r as (select *, row_number() over (partition by batch_id order by ordinal, e1, rel, e2) as idx from keyed)
select batch_id, count(*)::int as n, string_agg(idx || '. [' || e1 || ', ' || rel || ', ' || e2 || ']', chr(10) order by idx) || chr(10) || '---' || chr(10) || substr('source ' || arg_min(e1, idx), 1, 1000) as request from r group by batch_id""")
def validation_batches(spark, sf):
    rows = read(spark, sf, "keyed").withColumn("source", F.concat(F.lit("source "), "e1"))
    return validation.validation_batches(rows)


_VERDICTS = """v as (select batch_id, 0 as pos, 1 as idx, false as valid, 'x' as reason, null as c1, 0 as c from b where batch_id % 4 = 0 union all select batch_id, 1, 2, false, null, '甲', 3 from b where batch_id % 4 = 0
  union all select batch_id, 2, 999999, false, null, null, 0 from b where batch_id % 4 = 0 union all select batch_id, 0, 1, true, null, null, 0 from b where batch_id % 4 = 1
  union all select batch_id, 1, 3, true, 'ok', null, 0 from b where batch_id % 4 = 1 union all select batch_id, 0, 2, false, null, '丙', 1 from b where batch_id % 4 = 3)"""
_VB = f"{with_inputs('keyed')}, b as (select distinct batch_id from keyed), {_VERDICTS}"


@query(f"{_VB} select batch_id, pos::int as pos, idx::int as idx, valid, reason, c1 as first_part, case when c = 0 then null else c end::int as n_parts from v")
def parse_verdicts(spark, sf):
    rows = validation.parse_verdicts(read(spark, sf, "verdict_texts"))
    return rows.select("batch_id", "pos", "idx", "valid", "reason", F.get("correction", 0).alias("first_part"), F.nullif(F.size("correction"), F.lit(-1)).alias("n_parts"))


def _indexed(spark, sf):
    from pyspark.sql import Window

    return read(spark, sf, "keyed").withColumn("idx", F.row_number().over(Window.partitionBy("batch_id").orderBy("ordinal", "e1", "e2")))


@query(f"""{_VB}, t as (select *, row_number() over (partition by batch_id order by ordinal, e1, e2) as idx from keyed)
select distinct batch_id, case when c = 3 then '甲' else e1 end as e1, case when c = 3 then '位于' else rel end as rel, case when c = 3 then '乙' else e2 end as e2 from t left join v using (batch_id, idx) where coalesce(valid, true) or c = 3""")
def apply_verdicts(spark, sf):
    return validation.apply_verdicts(_indexed(spark, sf), validation.parse_verdicts(read(spark, sf, "verdict_texts"))).drop("at")


@query(f"{_VB} select count(*) filter (valid) as passed, count(*) filter (not valid) as failed, count(*) filter (c > 0) as corrected from v")
def verdict_summary(spark, sf):
    return validation.verdict_summary(validation.parse_verdicts(read(spark, sf, "verdict_texts")))


# Graph


@query(f"{with_inputs('names')} select name, {_ESC.format('name')} as escaped from names")
def escape_value(spark, sf):
    return read(spark, sf, "names").withColumn("escaped", tx.escape_value(F.col("name")))


@query("select p_name as name, case when regexp_matches(p_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') then p_name else '`' || p_name || '`' end as escaped from part union all select n_name, n_name from nation where regexp_matches(n_name, '^[a-zA-Z_][a-zA-Z0-9_]*$') union all select n_name, '`' || n_name || '`' from nation where not regexp_matches(n_name, '^[a-zA-Z_][a-zA-Z0-9_]*$')")
def escape_relation(spark, sf):
    names = read(spark, sf, "part").select(F.col("p_name").alias("name")).union(read(spark, sf, "nation").select("n_name"))
    return names.withColumn("escaped", tx.escape_relation(F.col("name")))


def _split(spark, sf):
    rows = read(spark, sf, "triples")
    return rows.where("ordinal % 3 = 0"), rows.where("ordinal % 3 != 0")


@query(f"{T} select e1 as name from triples union select e2 from triples")
def merge_nodes(spark, sf):
    old, new = _split(spark, sf)
    return graph.merge_nodes(new, graph.graph_nodes(old))


@query(f"{T} select distinct e1 as entity1, rel as relation, e2 as entity2 from triples")
def merge_edges(spark, sf):
    old, new = _split(spark, sf)
    return graph.merge_edges(new, graph.graph_edges(old))


@query(f"{T} select e1 as name from triples union select e2 from triples")
def merge_nodes_stored(spark, sf):
    return _merged_twice(spark, graph.graph_nodes(read(spark, sf, "triples")), *NODES)


@query(f"{T} select distinct e1 as entity1, rel as relation, e2 as entity2 from triples")
def merge_edges_stored(spark, sf):
    return _merged_twice(spark, graph.graph_edges(read(spark, sf, "triples")), *EDGES)


@query(f"{T} select ((row_number() over (order by ordinal, e1, rel, e2) - 1) // 500)::int as batch, rel, 1 as one from triples".replace("select ((", "select batch, rel, count(*) as n_rows from (select ((").replace(", 1 as one from triples", " from triples) group by all"))
def import_plan(spark, sf):
    return graph.import_plan(read(spark, sf, "triples"))


@query(f"{T}, n as (select e1 as name from triples where ordinal % 2 = 0 union select e2 from triples where ordinal % 2 = 0) select distinct e1 as entity1, rel as relation, e2 as entity2 from triples where e1 in (from n) and e2 in (from n)")
def query_all(spark, sf):
    rows = read(spark, sf, "triples")
    return graph.query_all(graph.graph_edges(rows), graph.graph_nodes(rows.where("ordinal % 2 = 0")))


@query(f"{T} select distinct e1 as entity1, rel as relation, e2 as entity2 from triples where contains(e1, 'NATION_2') or contains(e2, 'NATION_2')")
def search_keyword(spark, sf):
    return graph.search_keyword(graph.graph_edges(read(spark, sf, "triples")), "NATION_2")


@query(f"{T}, k as (select distinct substr(n_name, 2, 3) as keyword from nation), e as (select distinct e1 as entity1, rel as relation, e2 as entity2 from triples) select e.*, keyword from e, k where contains(entity1, keyword) or contains(entity2, keyword)")
def search_keywords(spark, sf):
    words = read(spark, sf, "nation").select(F.substring("n_name", 2, 3).alias("keyword"))
    return graph.search_keywords(graph.graph_edges(read(spark, sf, "triples")), words)


@query(f"{T} select count(*) as n from (select e1 from triples union select e2 from triples)")
def node_count(spark, sf):
    return graph.node_count(graph.graph_nodes(read(spark, sf, "triples")))


@query(f"{T} select count(*) as n from (select distinct e1, rel, e2 from triples)")
def relation_count(spark, sf):
    return graph.relation_count(graph.graph_edges(read(spark, sf, "triples")))


@query(f"{T} select distinct rel as relation from triples order by 1")
def relation_types(spark, sf):
    return graph.relation_types(graph.graph_edges(read(spark, sf, "triples")))


_PALETTE = "[" + ", ".join(f"'{c}'" for c in graph.PALETTE) + "]"


def _viz_nodes_sql(where: str) -> str:
    return f"""{T}, f as (select id, min(place) as place from (select e1 as id, ordinal * 2 as place from triples where {where} union all select e2, ordinal * 2 + 1 from triples where {where}) where id <> '' group by id)
select id, idx, {_PALETTE}[idx % 12 + 1] as color, {graph.NODE_SIZE} as size from (select id, row_number() over (order by place, id) - 1 as idx from f)"""


@query(_viz_nodes_sql("e1 <> '' and e2 <> ''"))
def viz_nodes(spark, sf):
    return graph.viz_nodes(read(spark, sf, "triples"))


@query(f"{D} select e1 as \"from\", e2 as \"to\", max(struct_pack(o := ordinal, rel := rel)).rel as label from dirty where e1 <> '' and e2 <> '' group by all")
def viz_edges(spark, sf):
    return graph.viz_edges(read(spark, sf, "dirty"))


@query(
    f"""select 'node' as kind, id as name, '' as target, '' as label, idx from ({_viz_nodes_sql("contains(e1, 'NATION_3') or contains(e2, 'NATION_3')")})
union all select 'edge', "from", "to", label, null from ({T} select e1 as "from", e2 as "to", max(struct_pack(o := ordinal, rel := rel)).rel as label from triples where contains(e1, 'NATION_3') or contains(e2, 'NATION_3') group by all)"""
)
def search_subgraph(spark, sf):
    nodes, edges = graph.search_subgraph(read(spark, sf, "triples"), "NATION_3")
    node = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("name"), F.lit("").alias("target"), F.lit("").alias("label"), "idx")
    return node.union(edges.select(F.lit("edge"), "from", "to", "label", F.lit(None).cast("bigint")))


# Triple table


def _with_ids(spark, sf):
    return read(spark, sf, "triples").where("rel != '生产'").withColumnRenamed("ordinal", "row_id").select("row_id", "e1", "rel", "e2")


_IDS = "ids as (select ordinal as row_id, e1, rel, e2 from triples where rel <> '生产')"


@query(f"{T}, {_IDS} select row_id, case when row_id % 10 = 0 then e1 || '改' else e1 end as e1, rel, e2 from ids")
def update_triples(spark, sf):
    return table.update_triples(_with_ids(spark, sf), read(spark, sf, "edits").where("row_id < 0 or rel != '生产'"))


@query(f"{T}, {_IDS} select row_number() over (order by row_id) - 1 as row_id, e1, rel, e2 from ids where row_id % 6 <> 0")
def delete_triples(spark, sf):
    rows = _with_ids(spark, sf)
    return table.delete_triples(rows, rows.where("row_id % 6 = 0").select("row_id"))


@query(f"{D} select e1, rel, e2, ordinal from triples union all select e1, rel, e2, ordinal from dirty where e1 <> '' and rel <> '' and e2 <> ''")
def add_triples(spark, sf):
    return table.add_triples(read(spark, sf, "triples"), read(spark, sf, "dirty"))


@query(f"{T} select * from triples where false")
def clear_triples(spark, sf):
    return table.clear_triples(read(spark, sf, "triples"))


@query(f"{T} select count(*) as total, count(*) as relations, count(distinct rel) as relation_types, (select count(*) from (select e1 from triples union select e2 from triples)) as entities from triples")
def triple_stats(spark, sf):
    return table.triple_stats(read(spark, sf, "triples"))


@query(f"{T} select rel, count(*) as n, min(ordinal) as first from triples group by rel")
def relation_distribution(spark, sf):
    return table.relation_distribution(read(spark, sf, "triples"))


@query(f"{T} select * from triples order by ordinal, e1, rel, e2 limit 20 offset 40")
def page(spark, sf):
    return table.page(read(spark, sf, "triples"), 3)


@query(f"{T} select * from triples order by ordinal, e1, rel, e2 limit 50")
def preview(spark, sf):
    return table.preview(read(spark, sf, "triples"))


@query(f"{T} select *, row_number() over (order by ordinal, e1, rel, e2) - 1 as row_id from triples order by ordinal, e1, rel, e2 limit 20 offset 6000")
def page_by_id(spark, sf):
    path = _scratch(spark)
    table.write_pages(read(spark, sf, "triples"), path)
    return table.page_by_id(spark.read.parquet(path), 301)
