"""Column expressions on names, mentions and triples. Null in, null out, unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trigrove.functions import lexicon as lx

CJK = r"\x{4e00}-\x{9fff}"
WORD = r"[\p{L}\p{N}_]"
SPACE = r"[\s\p{Z}]"
TRIM = rf"^{SPACE}+|{SPACE}+$"
#: The characters of SPACE.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
DATE = r"\p{Nd}{1,4}年\p{Nd}{0,2}月?\p{Nd}{0,2}日?[前后]?"
CLAUSE_END = r"[，。；！？\n,;!?]"
SENTENCE = r"[^。！？；;!?\n]*[。！？；;!?\n]|[^。！？；;!?\n]+$"
SUBJECT = rf"^({WORD}{{2,20}}?)(?:不仅|不但|不光|不单)?(?:{'|'.join(lx.SUBJECT_VERBS)})"
CARRY = f"^(?:{'|'.join(lx.CARRY_WORDS)})"

PREFIX = rf"^(?:[{lx.PREFIX_NOISE}]{SPACE}*)+"
SUFFIX = f"(?:{lx.SUFFIX_NOISE})$"
TAIL = f"(?:{lx.TAIL_NOISE})$"
INFIX = rf"于{DATE}在[{CJK}]{{1,6}}|于{DATE}|在[{CJK}]{{2,8}}(?:{lx.FIELD_WORDS})"
#: What is taken from a name, pass by pass; white space at the ends goes after each.
ENTITY_PASSES = (PREFIX, SUFFIX, INFIX, PREFIX, SUFFIX, TAIL, f"^{DATE}", rf"^在[{CJK}]{{1,6}}", PREFIX, SUFFIX, TAIL)
COMPANY = rf"(?:{SPACE}*(?:{'|'.join(lx.COMPANY_SUFFIXES)}))+{SPACE}*$"
COMPANY_TRADE = rf"(?:{SPACE}*(?:{'|'.join(lx.COMPANY_SUFFIXES + lx.TRADE_SUFFIXES)}))+{SPACE}*$"
EDGE = "|".join(lx.MENTION_EDGES)


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return F.regexp_replace(c, f"{SPACE}+", "") == ""


def clean_entity(c: Column) -> Column:
    """Take noise from a name. A text that is a whole date stays as it is."""
    start = trim(c)
    out = start
    for pattern in ENTITY_PASSES:
        out = trim(F.regexp_replace(out, pattern, ""))
    return F.when(start.rlike(f"^{DATE}$"), start).otherwise(out)


def normalize_entity(c: Column) -> Column:
    """Take company and trade suffixes from the end; a name that would get shorter than two characters stays."""
    out = trim(F.regexp_replace(c, COMPANY_TRADE, ""))
    return F.when(F.length(out) < 2, c).otherwise(out)


def normalize_entity_e2(c: Column) -> Column:
    """As ``normalize_entity``, but trade suffixes go only after a company suffix went."""
    company = trim(F.regexp_replace(c, COMPANY, ""))
    both = trim(F.regexp_replace(company, COMPANY_TRADE, ""))
    return F.when(F.length(company) < 2, c).when(company == c, c).when(F.length(both) < 2, c).otherwise(both)


def is_generic_entity(c: Column, words=lx.GENERIC_ENTITIES) -> Column:
    return c.isin(*words) | (F.length(c) < 2) | c.rlike(r"^\p{Nd}+$")


def pair_fault(e1: Column, rel: Column, e2: Column) -> Column:
    """Why two names and a relation are no fact; null if they may be one."""
    out = F.when((rel == "位于") & (F.length(e1) <= 2) & ~e1.rlike(f"^[{CJK}]+$"), "short_place")
    out = out.when(rel.isin("研发", "创建", "成立", "包含") & is_generic_entity(e2), "generic_e2")
    out = out.when(rel.isin("研发", "创建", "成立", "位于", "包含") & is_generic_entity(e1), "generic_e1")
    out = out.when((rel == "包含") & (F.contains(e1, e2) | F.contains(e2, e1)), "one_holds_other")
    out = out.when(e2.endswith("等领域") | e2.endswith("等方面"), "field_list")
    out = out.when((rel == "成立") & e1.startswith("帝"), "emperor")
    out = out.when((rel == "生产") & (F.length(e1) > 15), "long_producer")
    for relation, firsts, seconds in lx.NO_FACTS:
        test = rel == relation
        test = test & e1.isin(*firsts) if firsts else test
        test = test & e2.isin(*seconds) if seconds else test
        out = out.when(test, "no_fact")
    return out


def clean_mention(c: Column) -> Column:
    """Take edge words from the front, then from the back, as often as they stand there.

    What has neither a blank nor an edge word at its ends, as most names, is looked at once.
    """
    front = trim(F.regexp_replace(trim(c), rf"^(?:(?:{EDGE}){SPACE}*)+", ""))
    return F.when(c.rlike(rf"^(?:{SPACE}|{EDGE})|(?:{SPACE}|{EDGE})$"), trim(F.regexp_replace(front, rf"(?:{SPACE}*(?:{EDGE}))+$", ""))).otherwise(c)


def is_valid_mention(c: Column, generic=lx.GENERIC_NOUNS) -> Column:
    """Whether a mention can be a name: 2 to 30 characters, Chinese, no generic noun, no number in disguise.

    Names of Chinese characters alone are no date or number, so the list decides on them.
    """
    foreign = F.length(F.regexp_replace(c, f"[{CJK}]", ""))
    digits = c.rlike(r"\p{Nd}{3,}") & (F.length(F.regexp_replace(c, r"\p{Nd}", "")) < 3)
    return (
        F.when(c.rlike(f"^[{CJK}]{{2,30}}\\z"), ~c.isin(*generic)).when(~F.length(c).between(2, 30) | ~c.rlike(f"[{CJK}]"), False).when(c.rlike(f"^{DATE}$"), True).when(c.isin(*generic), False)
        .when(c.rlike(r"\p{Nd}{4}") & c.rlike(f"[{CJK}]{{2,}}"), False).when(foreign * 10 > F.length(c) * 7, False).when(digits, False).otherwise(True)
    )


def infer_person_type(text: Column, etype: Column, generic=lx.GENERIC_NOUNS) -> Column:
    """An organisation or unknown of 2 to 4 characters that starts with a surname is a person."""
    named = F.length(text).between(2, 4) & text.rlike(f"^[{lx.SURNAMES}]") & ~text.isin(*lx.ORG_SUFFIXES, *generic)
    return F.when(etype.isin("组织名", "其他") & named, "人名").otherwise(etype)


def clause_subject(c: Column) -> Column:
    """The name before the first relation verb; null if there is none."""
    return F.nullif(F.regexp_extract(c, SUBJECT, 1), F.lit(""))


def escape_value(c: Column) -> Column:
    r"""Escape ``\``, then ``'``, then ``"``."""
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit('"'), F.lit('\\"'))


def unescape_value(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(.)", "$1")


def escape_relation(c: Column) -> Column:
    """ASCII names as they are, others in backticks; a backtick inside is doubled."""
    return F.when(c.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$"), c).otherwise(F.concat(F.lit("`"), F.replace(c, F.lit("`"), F.lit("``")), F.lit("`")))
