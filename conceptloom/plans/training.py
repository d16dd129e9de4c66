"""Queries of training data: nested pages to rows of every format, and out-of-fold memory, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crossfit, pagerows, spans
from ..sources import storage
from . import adapters as A
from .queries import SENT, M, query

# --- out-of-fold memory -------------------------------------------------------------------------------------------

#: Mentions whose name is not always the same.
VOTES = f"""{M}, votes AS (SELECT * REPLACE (concat(name, ' ', CAST((mention_order * 7 + length(doc_id)) % 3 AS VARCHAR)) AS name), CAST(CAST('0x' || substr(md5(concat('42:', doc_id)), 1, 15) AS BIGINT) % 5 AS INTEGER) AS fold FROM mentions),
model AS (SELECT f.fold, mention, semantic_group, name, count(*) AS n FROM votes v JOIN (SELECT unnest(range(5)) AS fold) f ON f.fold <> v.fold GROUP BY ALL),
pick AS (SELECT fold, mention, semantic_group, name AS pred_name FROM model QUALIFY row_number() OVER (PARTITION BY fold, mention, semantic_group ORDER BY n DESC, name) = 1),
oof AS (SELECT v.*, pred_name FROM votes v LEFT JOIN pick USING (fold, mention, semantic_group))"""


def _votes(spark: SparkSession, d: str) -> DataFrame:
    vote = ((F.col("mention_order") * 7 + F.length("doc_id")) % 3).cast("string")
    return A.mentions(spark, d).withColumn("name", F.concat("name", F.lit(" "), vote))


@query(f"{VOTES} SELECT doc_id, mention_id, fold, pred_name FROM oof")
def oof_predictions(spark: SparkSession, d: str) -> DataFrame:
    return crossfit.out_of_fold(_votes(spark, d)).select("doc_id", "mention_id", "fold", "pred_name")


@query(
    f"""{VOTES}, {SENT.replace("FROM mentions m JOIN", "FROM oof m JOIN")},
    said AS (SELECT *, string_agg(concat('[', mention, ']{{', semantic_group, '}} ', coalesce(pred_name, ''), chr(10)), '') OVER (PARTITION BY doc_id ORDER BY mention_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM sent)
    SELECT doc_id, mention_id, fold, concat('### Context', chr(10), rtrim(concat(l, '[', mention, ']', substr(r, length(mention) + 1)), ' ' || chr(10)), chr(10), chr(10), '### Previous Normalizations', chr(10),
      coalesce(rtrim(before, ' ' || chr(10)), 'None'), chr(10), chr(10), '### Prediction', chr(10), '[', mention, ']{{', semantic_group, '}}') AS prompt, concat(' ', name) AS completion FROM said"""
)
def oof_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Prompts with the memory that models of other folds give."""
    p = crossfit.out_of_fold(_votes(spark, d))
    located = spans.mention_in_sentence(spans.mention_in_passage(p, A.passages(spark, d)))
    return crossfit.training_rows(located, "hybrid_short").select("doc_id", "mention_id", "fold", "prompt", "completion")


@query(
    f"""{VOTES}, codes AS (SELECT name, semantic_group, min(code) AS pred_code FROM oof GROUP BY ALL)
    SELECT doc_id, string_agg(concat(mention_id, '=', coalesce(pred_name, ''), '/', coalesce(pred_code, '')), ';' ORDER BY start_span, end_span) AS entities
    FROM oof o LEFT JOIN codes c ON c.name = o.pred_name AND c.semantic_group = o.semantic_group GROUP BY doc_id"""
)
def oof_pages(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of other folds back in the pages' entities."""
    n = crossfit.nested(crossfit.out_of_fold(_votes(spark, d)))
    each = F.transform("entities", lambda e: F.concat(e["mention_id"], F.lit("="), e["db_pred_match"], F.lit("/"), e["db_pred_id"]))
    return n.select("doc_id", F.array_join(each, ";").alias("entities"))


# --- pages to rows ------------------------------------------------------------------------------------------------


def nested_pages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(pages, names): conversations as nested pages, every fifth mention in two parts, and names of which some have a brace."""
    m, p = A.mentions(spark, d), A.passages(spark, d)
    two = F.col("mention_order") % 5 == 0
    a, z = F.col("start_span").cast("int"), F.col("end_span").cast("int")
    offsets = F.when(two, F.array(F.array(a, a + 2), F.array(z - 2, z))).otherwise(F.array(F.array(a, z)))
    text = F.when(two, F.array(F.substring("mention", 1, 2), F.substring("mention", -2, 2))).otherwise(F.array("mention"))
    empty = F.lit("")
    code = F.array(F.struct(empty.alias("db_name"), F.col("code").alias("db_id"), empty.alias("db_match"), empty.alias("db_pred_id"), empty.alias("db_pred_match")))
    entity = F.struct(a.alias("at"), F.struct(F.col("mention_id").alias("id"), F.col("semantic_group").alias("type"), text.alias("text"), offsets.alias("offsets"), code.alias("normalized")).alias("e"))
    e = m.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(entity)), lambda x: x["e"]).alias("entities"))
    passage = F.struct(F.col("ordinal"), F.struct(F.col("ordinal").cast("string").alias("id"), F.lit("turn").alias("type"), F.array("text").alias("text"), F.array(F.array(F.col("start").cast("int"), F.col("stop").cast("int"))).alias("offsets")).alias("p"))
    pages = p.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(passage)), lambda x: x["p"]).alias("passages")).join(e, "doc_id")
    k = F.col("doc_id").cast("bigint") % 10
    split = F.when(k == 0, "test").when(k == 1, "validation").otherwise("train")
    names = m.select("code", F.when(F.col("code").startswith("W"), F.concat("name", F.lit("}"))).otherwise(F.col("name")).alias("entity")).distinct()
    return pages.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("document_id"), "passages", "entities", split.alias("split")), names


_CONTEXT = "concat('### Context', chr(10), rtrim(source, ' ' || chr(10)), chr(10), chr(10))"
_MEMORY = "string_agg(concat('[', m2, ']{', semantic_group, '} ', memo_name, chr(10)), '') OVER (PARTITION BY doc_id ORDER BY mention_order ROWS BETWEEN UNBOUNDED PRECEDING AND %s)"
_WHERE = "(SELECT string_agg(CASE WHEN q.ordinal = s.passage_no THEN concat(substr(q.text, 1, s.start_span - q.start), mk, substr(q.text, s.end_span - q.start + 1)) ELSE q.text END, ' ' ORDER BY q.ordinal) FROM passages q WHERE q.doc_id = s.doc_id)"
_SENTENCE = "concat(l, mk, substr(r, length(mention) + 1))"


def _rows_sql(form: str) -> str:
    """The rows of one format over ent: mentions with sentence, marks mk, mention text m2, name and memo_name."""
    if form == "long":
        return f"""SELECT 'long' AS format, doc_id, NULL AS mention_id, source, target, concat('### Context', chr(10), rtrim(source, ' ' || chr(10)), chr(10), chr(10)) AS prompt, concat('### Predictions', chr(10), rtrim(target, ' ' || chr(10))) AS completion, NULL AS fault
        FROM (SELECT doc_id, string_agg(concat('[', m2, ']{{', semantic_group, '}} ', memo_name, '<SEP>'), '' ORDER BY mention_order) AS target FROM ent GROUP BY 1) JOIN whole USING (doc_id)"""
    source = _SENTENCE if form in ("short", "hybrid_short") else _WHERE
    if form in ("short", "hybrid_medium"):
        name, target, middle = "name", "concat('[', m2, ']{', semantic_group, '} ', name)", "''"
    else:
        name, target = "memo_name", _MEMORY % "CURRENT ROW"
        middle = f"concat('### Previous Normalizations', chr(10), coalesce(rtrim({_MEMORY % '1 PRECEDING'}, ' ' || chr(10)), 'None'), chr(10), chr(10))"
    bad = f"contains({name}, '}}')"
    return f"""SELECT '{form}' AS format, doc_id, mention_id, source, target, CASE WHEN NOT bad THEN concat({_CONTEXT}, middle, '### Prediction', chr(10), '[', m2, ']{{', semantic_group, '}}') END AS prompt,
    CASE WHEN NOT bad THEN concat(' ', {name}) END AS completion, CASE WHEN bad THEN '2 closing braces' END AS fault
    FROM (SELECT *, {source} AS source, {target} AS target, {middle} AS middle, {bad} AS bad FROM ent s)"""


PAGES = f"""{M}, {SENT},
two AS (SELECT *, CASE WHEN mention_order % 5 = 0 THEN concat(substr(mention, 1, 2), ' ', substr(mention, -2)) ELSE mention END AS m2,
  CASE WHEN mention_order % 5 = 0 THEN concat('[', substr(mention, 1, 2), ']', substr(mention, 3, length(mention) - 4), '[', substr(mention, -2), ']') ELSE concat('[', mention, ']') END AS mk FROM sent),
dictionary AS (SELECT DISTINCT code, CASE WHEN code LIKE 'W%' THEN concat(name, '}}') ELSE name END AS entity FROM mentions),
best AS (SELECT code, m2, entity FROM (SELECT DISTINCT code, m2 FROM two) JOIN dictionary USING (code) QUALIFY row_number() OVER (PARTITION BY code, m2 ORDER BY levenshtein(m2, entity), entity) = 1),
ent AS MATERIALIZED (SELECT two.* EXCLUDE (name), entity AS name, first_value(entity) OVER (PARTITION BY doc_id, code ORDER BY start_span) AS memo_name FROM two JOIN best USING (code, m2)),
turns AS (SELECT t.doc_id, ordinal, string_agg(coalesce(mk, token), ' ' ORDER BY i) AS marked FROM mention_at t LEFT JOIN ent e ON e.doc_id = t.doc_id AND e.start_span = t.start_span AND e.passage_no = t.ordinal AND e.entity_idx = t.i GROUP BY 1, 2),
whole AS (SELECT doc_id, string_agg(marked, ' ' ORDER BY ordinal) AS source FROM turns GROUP BY 1),
made AS ({" UNION ALL ".join(_rows_sql(f) for f in ("short", "hybrid_short", "hybrid_medium", "hybrid_long", "long"))}),
splits AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS doc_id, CASE conv_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split FROM conversations)"""


@query(f"{PAGES} SELECT split, made.* FROM made JOIN splits USING (doc_id)")
def page_training_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sources, targets, prompts and faults of nested pages in all five formats."""
    pages, names = nested_pages(spark, d)
    return pagerows.rows(pages, names)[0]


@query(f"{PAGES} SELECT split, format, count(*) FILTER (fault IS NULL) AS rows, count(*) FILTER (fault IS NOT NULL) AS quarantined, count(DISTINCT doc_id) AS documents FROM made JOIN splits USING (doc_id) GROUP BY 1, 2")
def page_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the files written: rows, annotations and quarantine by split and format."""
    pages, names = nested_pages(spark, d)
    return pagerows.write(pages, storage.fresh_path(spark, "training"), names)
