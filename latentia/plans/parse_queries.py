"""Rows that fail to parse: queries and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from latentia.operators.errorparse import parse_ner_lines, parse_tagged_lines
from latentia.session import table

TAG_LIMIT = 1000


def _both(spark: SparkSession, sf_dir: str, failing_only: bool) -> DataFrame:
    # the tag set is a closed list, bounded here
    tags = [r.tag for r in table(spark, sf_dir, "pos_tags").select("tag").distinct().limit(TAG_LIMIT + 1).collect()]
    if len(tags) > TAG_LIMIT:
        raise ValueError("a tag set of this size is no closed list")
    ner = parse_ner_lines(table(spark, sf_dir, "ner2003_raw"), "line_id", "toks", failing_only)
    tagged = parse_tagged_lines(table(spark, sf_dir, "bllip_tagged"), "line_id", "line", tags, failing_only)
    return ner.withColumn("table_name", F.lit("ner2003_raw")).unionByName(tagged.withColumn("table_name", F.lit("bllip_tagged")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both(spark, sf_dir, True).select("table_name", "line_id", "reason")


def p2_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failing rows with the number of edits and the edits that would repair them."""
    return _both(spark, sf_dir, True).select("table_name", "line_id", "reason", "cost", F.array_join("edits", "; ").alias("edits"))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that fail by columns or values: how many delimiters, or values, the cheapest parse edits."""
    failing = _both(spark, sf_dir, True).where("reason <> 'quoting'")
    delimiters = F.size(F.filter("edits", lambda e: e.contains("delimiter")))
    n = F.when(F.col("reason") == "columns", delimiters).otherwise(F.size("edits"))
    return failing.select("table_name", "line_id", "reason", n.cast("long").alias("n"))


def p2_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid rows, one output row per field."""
    valid = _both(spark, sf_dir, False).where("reason is null")
    return valid.select("table_name", "line_id", F.posexplode("fields").alias("pos", "field"))


_NER = r"""
ner as (
  select line_id, toks,
    regexp_full_match(toks, '(?s)((?:"(?:[^"]|"")*"|[^"\t][^\t]*|)\t)*(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)') quoted_well,
    list_transform(regexp_extract_all(chr(9) || toks, '(?s)\t(?:"(?:[^"]|"")*"|[^"\t][^\t]*|)'), lambda x:
      case when x[2:2] = '"' then replace(x[3:len(x)-1], '""', '"') else x[2:] end) f
  from ner2003_raw where not regexp_full_match(toks, '[ \t]*')
), ner_r as (
  select line_id, f, case
    when not quoted_well then 'quoting'
    when len(f) <> 9 then 'columns'
    when not (regexp_full_match(f[1], 'O|[BI]-(PER|LOC|ORG|MISC)') and regexp_full_match(f[2], '[0-9]+') and regexp_full_match(f[3], '[0-9]+')
      and f[4] <> '' and f[5] <> '' and f[6] <> '' and regexp_full_match(f[9], '[0-9]+') and regexp_full_match(toks, '(?s)[\x00-\x7F]*')) then 'value' end reason
  from ner
)"""
_TAGGED = r"""
tg as (
  select line_id, list_filter(string_split(line, ' '), lambda x: x <> '') f
  from bllip_tagged where not regexp_full_match(line, '[ \t]*')
), tg_q as (
  select line_id, f,
    array_to_string(list_transform(list_filter(f, lambda x: regexp_full_match(x, '(?s)(``|'''')/[^/]*')), lambda x: case when x[1:2] = '``' then 'o' else 'c' end), '') q,
    (select list(tag) from pos_tags) tags from tg
), tg_r as (
  select line_id, f, case
    when not regexp_full_match(q, '(oc)*') then 'quoting'
    when len(list_filter(f, lambda x: not contains(x, '/'))) > 0 then 'columns'
    when len(list_filter(f, lambda x: not (regexp_full_match(x, '(?s).+/[^/]*') and list_contains(tags, regexp_extract(x, '(?s)^.*/([^/]*)$', 1))))) > 0 then 'value' end reason
  from tg_q
)"""
_ALL = f"with {_NER}, {_TAGGED}, r as (select 'ner2003_raw' table_name, * from ner_r union all select 'bllip_tagged', * from tg_r)"

QUERIES = {f.__name__: f for f in (p2_found, p2_edits, p2_counts, p2_loaded)}
_BAD = """(not regexp_full_match(f[1], 'O|[BI]-(PER|LOC|ORG|MISC)'))::BIGINT + (not regexp_full_match(f[2], '[0-9]+'))::BIGINT + (not regexp_full_match(f[3], '[0-9]+'))::BIGINT
+ (f[4] = '')::BIGINT + (f[5] = '')::BIGINT + (f[6] = '')::BIGINT + (not regexp_full_match(f[9], '[0-9]+'))::BIGINT + (not regexp_full_match(toks, '(?s)[\\x00-\\x7F]*'))::BIGINT"""
_BAD_TOKENS = r"len(list_filter(f, lambda x: not (regexp_full_match(x, '(?s).+/[^/]*') and list_contains(tags, regexp_extract(x, '(?s)^.*/([^/]*)$', 1)))))"
ORACLES = {
    "p2_counts": f"""with {_NER}, {_TAGGED} select 'ner2003_raw' table_name, line_id, reason, case reason when 'columns' then abs(len(f) - 9) else {_BAD} end n from ner_r join ner using (line_id, f) where reason <> 'quoting'
union all select 'bllip_tagged', line_id, reason, case reason when 'columns' then len(list_filter(f, lambda x: not contains(x, '/'))) else {_BAD_TOKENS} end from tg_r join tg_q using (line_id, f) where reason <> 'quoting'""",
    "p2_found": f"{_ALL} select table_name, line_id, reason from r where reason is not null",
    "p2_loaded": f"{_ALL} select table_name, line_id, (unnest(range(len(f))))::INT pos, unnest(f) field from r where reason is null",
}
