"""Queries of encoded texts, observed runs, flattened pages and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import nested
from ..functions import text as T
from ..functions import vectors as V
from ..operators import corpus, encoding, nerexport, observed, similarity, spans
from . import adapters as A
from .queries import ALIGN, SYN, M, _entities, _synonyms, query
from .training import PAGES, nested_pages

#: The octal digits of 24 bits of a word's MD5, less 3, summed over words.
_DIGIT = "((CAST(concat('0x', substr(md5(w), 1, 6)) AS INTEGER) >> {}) & 7) - 3"
_SUMS = ", ".join(f"sum({_DIGIT.format(3 * k)}) AS s{k}" for k in range(8))


@query(f"""WITH w AS (SELECT DISTINCT p_name AS text, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part), v AS (SELECT text, count(*) AS n, {_SUMS} FROM w GROUP BY text)
    SELECT text, {", ".join(f"round(s{k} / n, 9) AS v{k}" for k in range(8))} FROM v""")
def encoded_texts(spark: SparkSession, d: str) -> DataFrame:
    """Mean token vectors of distinct names, by an encoder of exact numbers."""
    v = encoding.encode(A.table(spark, d, "part"), "p_name", encoding.HashedWords, "hashed words")
    return v.select("text", *(F.round(F.col("vector")[k], 9).alias(f"v{k}") for k in range(8)))


@query(
    f"""WITH {SYN}, t AS (SELECT entity AS text FROM n UNION SELECT mention FROM m), w AS (SELECT text, unnest(string_split(text, ' ')) AS w FROM t), v AS (SELECT text, {_SUMS} FROM w GROUP BY text),
    c AS (SELECT code, mention, entity, ({" + ".join(f"a.s{k} * b.s{k}" for k in range(8))}) AS dot, ({" + ".join(f"a.s{k} * a.s{k}" for k in range(8))}) AS x, ({" + ".join(f"b.s{k} * b.s{k}" for k in range(8))}) AS y
      FROM m JOIN n USING (code) JOIN v a ON a.text = mention JOIN v b ON b.text = entity),
    r AS (SELECT *, CASE WHEN x * y = 0 THEN -1 ELSE round(dot / (sqrt(x) * sqrt(y)), 9) END AS score FROM c)
    SELECT code, mention, entity AS best_synonym FROM r QUALIFY row_number() OVER (PARTITION BY code, mention ORDER BY score DESC, entity) = 1"""
)
def best_synonym_embedding(spark: SparkSession, d: str) -> DataFrame:
    mentions, names = _synonyms(spark, d)
    return encoding.best_synonym(mentions, names, encoding.HashedWords, "hashed words").select("code", "mention", "best_synonym")


@query("""SELECT count(*) AS rows, count(*) FILTER (event_type NOT IN ('click', 'view') OR event_type IS NULL) AS rejected, count(DISTINCT user_id) > 0 AS some, CAST(1 AS BIGINT) AS skipped FROM events""")
def observed_run(spark: SparkSession, d: str) -> DataFrame:
    """Rows, rejected kinds and skipped inputs of a run over events and a file that does not exist."""
    import warnings

    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        events, skipped = observed.read_existing(spark, [f"{d}/events.parquet", f"{d}/no-such-file.parquet"], spark.read.parquet)
    run = observed.counted(events, F.col("event_type"), ["click", "view"], skipped)
    got = run.finish()
    return spark.createDataFrame([(got["rows"], got["rejected"], got["rows"] > 0, got["skipped"])], "rows long, rejected long, some boolean, skipped long")


_FLAT = f"""{PAGES.split("dictionary AS")[0].rstrip().rstrip(",")},
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start_span) - 1 AS k FROM two)"""


@query(
    f"""{_FLAT}, l AS (
    SELECT doc_id, concat('entities.', CAST(k AS VARCHAR), '.type') AS path, semantic_group AS value FROM e
    UNION ALL SELECT doc_id, concat('entities.', CAST(k AS VARCHAR), '.normalized.0.db_id'), code FROM e
    UNION ALL SELECT doc_id, concat('entities.', CAST(k AS VARCHAR), '.offsets.0.0'), CAST(start_span AS VARCHAR) FROM e
    UNION ALL SELECT doc_id, 'entities#', CAST(count(*) AS VARCHAR) FROM e GROUP BY doc_id
    UNION ALL SELECT p.doc_id, concat('passages.', CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY ordinal) - 1 AS VARCHAR), '.text.0'), text FROM passages p WHERE p.doc_id IN (SELECT doc_id FROM e))
    SELECT * FROM l"""
)
def flattened_pages(spark: SparkSession, d: str) -> DataFrame:
    """Types, codes, first offsets and texts of nested pages by their dotted paths."""
    pages, _ = nested_pages(spark, d)
    long = nested.flattened(pages.drop("id", "split").withColumnRenamed("document_id", "doc_id"), ["doc_id"])
    return long.where(F.col("path").rlike(r"^entities(\.\d+\.(type|normalized\.0\.db_id|offsets\.0\.0)|#)$|^passages\.\d+\.text\.0$"))


@query(f"{_FLAT} SELECT doc_id, CAST((SELECT count(*) FROM passages p WHERE p.doc_id = e.doc_id) AS INTEGER) AS passages, CAST(count(*) AS INTEGER) AS entities, string_agg(concat(code, '@', CAST(start_span AS VARCHAR)), ';' ORDER BY k) AS codes FROM e GROUP BY doc_id")
def rebuilt_pages(spark: SparkSession, d: str) -> DataFrame:
    """Nested pages taken apart into paths and put together again."""
    pages, _ = nested_pages(spark, d)
    back = nested.unflattened(nested.flattened(pages, ["document_id"]), ["document_id"], pages.schema)
    codes = F.transform("entities", lambda e: F.concat(e["normalized"][0]["db_id"], F.lit("@"), e["offsets"][0][0].cast("string")))
    return back.select(F.col("document_id").alias("doc_id"), F.size("passages").alias("passages"), F.size("entities").alias("entities"), F.array_join(codes, ";").alias("codes"))


# --- small functions ----------------------------------------------------------------------------------------------


@query(f"{M} SELECT doc_id, mention_id, (row_number() OVER (ORDER BY doc_id, mention_order) - 1) // 16 AS batch FROM mentions")
def independent_batches(spark: SparkSession, d: str) -> DataFrame:
    return corpus.batches(A.mentions(spark, d), 16).select("doc_id", "mention_id", "batch")


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS id, string_split(text, ' ') AS ws FROM conversations), t AS (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) AS i FROM w),
    s AS (SELECT id, token, coalesce(sum(length(token) + 1) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM t)
    SELECT id, token, CAST(a AS BIGINT) AS start_span, CAST(a + length(token) AS BIGINT) AS end_span FROM s""")
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")
    return spans.tokens(c, "id", "text")


@query(f"""WITH {SYN} SELECT code, mention, entity, CAST(levenshtein(mention, entity) AS INTEGER) AS distance, CAST(row_number() OVER (PARTITION BY code, mention ORDER BY -levenshtein(mention, entity) DESC, entity) AS INTEGER) AS rank FROM m JOIN n USING (code)""")
def ranked_names(spark: SparkSession, d: str) -> DataFrame:
    """All names of a mention's code, the nearest first."""
    mentions, names = _synonyms(spark, d)
    pairs = mentions.distinct().join(names.distinct(), "code").withColumn("distance", V.edit_distance(F.col("mention"), F.col("entity")))
    return similarity.rank_candidates(pairs.withColumn("score", -F.col("distance")), ["code", "mention"]).drop("score")


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), p AS (SELECT vec_id, v[1:4] AS a, v[5:8] AS b, v[9:12] AS c FROM e)
    SELECT vec_id, round((a[1] + c[1]) / 2, 9) AS mean_1, round((a[4] + c[4]) / 2, 9) AS mean_4, round(a[2], 9) AS cls_2 FROM p""")
def pooled_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Three token vectors of four numbers each, the second masked: their mean, and the first."""
    tokens = F.array(F.slice("vector", 1, 4), F.slice("vector", 5, 4), F.slice("vector", 9, 4))
    v = A.vectors(spark, d).select(F.col("id").alias("vec_id"), tokens.alias("t"))
    mean = V.mean_pool(F.col("t"), F.array(F.lit(1), F.lit(0), F.lit(1)))
    return v.select("vec_id", F.round(mean[0], 9).alias("mean_1"), F.round(mean[3], 9).alias("mean_4"), F.round(V.cls_pool(F.col("t"))[1], 9).alias("cls_2"))


@query("""SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: concat('<span style="background-color: rgba(255,0,0,', printf('%.2f', least((length(w) % 5) * 0.25, 1.0)), ')">', w, '</span>')), '') AS html FROM part""")
def shaded_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of names shaded by a score of their length."""
    words = F.split("p_name", " ")
    scores = F.transform(words, lambda w: (F.length(w) % 5) * F.lit(0.25))
    return A.table(spark, d, "part").select("p_partkey", T.saliency_html(words, scores).alias("html"))


# --- entities out and in ------------------------------------------------------------------------------------------

_EXPORT = f"""{ALIGN}, x AS (SELECT *, 'span' AS span FROM q), y AS (SELECT *, 'gold' AS span, concat('C', label) AS code FROM g)"""


def _ner(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    gold, pred = _entities(spark, d)
    return pred.withColumn("span", F.lit("span")), gold.withColumnRenamed("mention_id", "gold_mention_id").withColumns({"span": F.lit("gold"), "code": F.concat(F.lit("C"), "label")})


@query(
    f"""{_EXPORT}, j AS (SELECT filename, coalesce(pred_mention_id, gold_mention_id) AS mention_id, coalesce(pred_mention_id, '') AS pred_mention_id, coalesce(gold_mention_id, '') AS gold_mention_id, coalesce(x.label, y.label) AS label, start_span, end_span,
      coalesce(x.span, y.span) AS span, coalesce(code, '') AS code, '' AS semantic_rel, '' AS annotation, pred_mention_id IS NOT NULL AS is_predicted, gold_mention_id IS NOT NULL AS is_gold,
      CASE WHEN gold_mention_id IS NULL THEN 'FP' WHEN pred_mention_id IS NULL THEN 'FN' ELSE 'TP' END AS ner_status FROM x FULL JOIN y USING (filename, start_span, end_span))
    SELECT *, row_number() OVER (ORDER BY filename, start_span, end_span, label, ner_status) AS row_nr FROM j"""
)
def ner_export(spark: SparkSession, d: str) -> DataFrame:
    """Predicted and gold entities of one place in one table, numbered in its order."""
    return corpus.global_row_number(nerexport.table(*_ner(spark, d), match_label=False), list(nerexport.ORDER))


@query(f"{_EXPORT} SELECT filename, pred_mention_id AS mention_id, pred_mention_id, '' AS gold_mention_id, label, start_span, end_span, span, '' AS code, '' AS semantic_rel, '' AS annotation, true AS is_predicted, false AS is_gold, 'PRED' AS ner_status FROM x")
def ner_export_without_gold(spark: SparkSession, d: str) -> DataFrame:
    return nerexport.table(_ner(spark, d)[0])


@query(
    f"""{_FLAT}, doc AS (SELECT doc_id, string_agg(text, ' ' ORDER BY ordinal) AS text FROM passages GROUP BY 1)
    SELECT doc_id AS id, any_value(text) AS text, coalesce(string_agg(concat(CAST(start_span AS VARCHAR), '-', CAST(end_span AS VARCHAR), semantic_group), ';' ORDER BY start_span) FILTER (mention_order % 5 <> 0 AND semantic_group IN ('G4', 'G5', 'G7')), '') AS spans
    FROM e JOIN doc USING (doc_id) GROUP BY doc_id"""
)
def labelled_texts(spark: SparkSession, d: str) -> DataFrame:
    """Texts of annotated pages with their entities of one part and of listed labels."""
    t = nerexport.labelled_texts(nested_pages(spark, d)[0], ["G4", "G5", "G7"])
    return t.select("id", "text", F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["stop"].cast("string"), s["label"])), ";").alias("spans"))
