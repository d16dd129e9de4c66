"""More queries over the driver's tables: reports, deltas, whole builds, decoding and small functions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus, decode, fusion, kb, metrics, packing, spans
from ..sources import storage
from . import adapters as A
from .queries import ALIGN, FUSE, FUSED, HIT, LEVELS, SLICES, TARGET, TYPES, M, N, P, _entities, _types, query

# --- evaluation ---------------------------------------------------------------------------------------------------

RUNS = {"p1": 6, "p2": 8, "p3": 3}
RECALLS = f"""{", ".join(A.predictions_sql(r, c=c) for r, c in RUNS.items())},
recalls AS ({" UNION ALL ".join(f"SELECT '{r}' AS run, coalesce(semantic_group, 'overall') AS semantic_group, count(*) AS n, count(*) FILTER ({HIT}) AS n_correct FROM {r} WHERE rank = 1 GROUP BY GROUPING SETS ((semantic_group), ())" for r in RUNS)}),
texts AS (SELECT *, concat(CAST(round_even(CAST(n_correct AS DOUBLE) / n * 100, 1) AS VARCHAR), '% (', CAST(n_correct AS VARCHAR), '/', CAST(n AS VARCHAR), ')') AS text FROM recalls)"""


def _recalls(spark: SparkSession, d: str) -> DataFrame:
    each = [metrics.recall_by_group(A.predictions(spark, d, c=c).where("rank = 1")).select(F.lit(r).alias("run"), "semantic_group", "n", "n_correct") for r, c in RUNS.items()]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(
    f"""WITH {RECALLS}, labels AS (SELECT semantic_group FROM recalls UNION SELECT 'absent label')
    SELECT l.semantic_group, {", ".join(f"coalesce(max(text) FILTER (run = '{r}'), '0% (0/0)') AS {r}" for r in RUNS)} FROM labels l LEFT JOIN texts t USING (semantic_group) GROUP BY 1"""
)
def grid_report(spark: SparkSession, d: str) -> DataFrame:
    labels = spark.createDataFrame([("absent label",)], "semantic_group string")
    return metrics.grid_report(_recalls(spark, d), list(RUNS), labels)


@query(f"WITH {RECALLS} SELECT run, semantic_group, printf('%.4f (%d/%d)', CAST(n_correct AS DOUBLE) / n, n_correct, n) AS report, round_even(CAST(n_correct AS DOUBLE) / n * 100, 1) AS percent FROM recalls")
def recall_reports(spark: SparkSession, d: str) -> DataFrame:
    r = _recalls(spark, d)
    return r.select("run", "semantic_group", T.recall_text(F.col("n_correct"), F.col("n")).alias("report"), T.percent(F.col("n_correct") / F.col("n")).alias("percent"))


@query(f"""{P}, c AS (SELECT coalesce(semantic_group, 'overall') AS semantic_group, count(*) AS n, count(*) FILTER ({HIT}) AS n_correct FROM preds WHERE rank = 1 AND semantic_group <> 'ECONOMY' GROUP BY GROUPING SETS ((semantic_group), ())),
    l AS (SELECT DISTINCT semantic_group FROM preds UNION SELECT 'overall' UNION SELECT 'absent label') SELECT semantic_group, coalesce(n, 0) AS n, coalesce(n_correct, 0) AS n_correct, coalesce(CAST(n_correct AS DOUBLE) / n, 0) AS recall FROM l LEFT JOIN c USING (semantic_group)""")
def recall_of_all_labels(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d).where("rank = 1")
    labels = p.select("semantic_group").union(spark.createDataFrame([("absent label",)], "semantic_group string"))
    return metrics.overall_last(metrics.with_labels(metrics.recall_by_group(p.where("semantic_group <> 'ECONOMY'")), labels))


RELATION = "CASE mention_order % 5 WHEN 0 THEN 'EXACT' WHEN 1 THEN 'BROAD' WHEN 2 THEN 'NARROW' WHEN 3 THEN 'PARTIAL' ELSE 'NO_RELATION' END"
_on = "score >= 0.96 AND"


@query(
    f"""{P}, q AS (SELECT *, {RELATION} AS relation FROM preds WHERE rank = 1),
    c AS (SELECT coalesce(semantic_group, 'overall') AS semantic_group, count(*) AS n, count(*) FILTER (score >= 0.96) AS n_pred, count(*) FILTER ({_on} {HIT}) AS n_strict, count(*) FILTER ({_on} ({HIT} OR relation = 'EXACT')) AS n_correct,
      count(*) FILTER ({_on} relation = 'EXACT') AS n_exact, count(*) FILTER ({_on} relation = 'PARTIAL') AS n_partial, count(*) FILTER ({_on} relation = 'NARROW') AS n_narrow,
      count(*) FILTER ({_on} relation IN ('BROAD', 'PARTIAL')) AS n_broad, count(*) FILTER ({_on} relation = 'NO_RELATION') AS n_no_relation FROM q GROUP BY GROUPING SETS ((semantic_group), ()))
    SELECT *, {", ".join(f"coalesce(CAST(n_{k} AS DOUBLE) / nullif(n_pred, 0), 0) AS {k}" for k in ("strict", "correct", "exact", "partial", "narrow", "broad", "no_relation"))},
      concat(CAST(round_even(CAST(n_pred AS DOUBLE) / n * 100, 1) AS VARCHAR), '% (', CAST(n_pred AS VARCHAR), '/', CAST(n AS VARCHAR), ')') AS kept FROM c"""
)
def relation_recalls_threshold(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("mention_order") % 5
    rel = F.when(o == 0, "EXACT").when(o == 1, "BROAD").when(o == 2, "NARROW").when(o == 3, "PARTIAL").otherwise("NO_RELATION")
    return metrics.relation_recalls(A.predictions(spark, d).where("rank = 1").withColumn("relation", rel), threshold=0.96)


TAGGED = """r AS (SELECT *, count(mention_id) OVER (PARTITION BY doc_id, gold_concept_code ORDER BY mention_order, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS repeat_rank,
  count(mention_id) OVER (PARTITION BY doc_id, gold_concept_code) AS repeats FROM {rows}),
tagged AS (SELECT *, length(mention) - length(replace(mention, ' ', '')) + 1 AS w,
  gold_concept_code IN (SELECT gold_concept_code FROM train) AS seen_code, mention IN (SELECT mention FROM train) AS seen_mention,
  EXISTS (SELECT 1 FROM train t WHERE t.mention = r.mention AND t.gold_concept_code = r.gold_concept_code) AS seen_pair,
  gold_concept_code IN (SELECT gold_concept_code FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100) AS top_code,
  mention IN (SELECT mention FROM train GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 100) AS top_mention FROM r)"""
_paired = " UNION ALL ".join(
    f"SELECT coalesce(semantic_group, 'overall') AS semantic_group, '{k}' AS slice, count(*) FILTER ({c}) AS n, count(*) FILTER (({c}) AND hit_base) AS n_base, count(*) FILTER (({c}) AND {HIT}) AS n_other FROM tagged GROUP BY GROUPING SETS ((semantic_group), ())"
    for k, c in (SLICES | {"multi_words": "w > 1"}).items()
)


@query(
    f"""WITH {A.enriched_sql(swap=True)}, {A.TRAIN_SQL}, {A.enriched_sql("base", swap=True, c=8)},
    joint AS (SELECT t.*, b.gold_concept_code = b.pred_concept_code AS hit_base FROM test t JOIN base b ON b.rank = 1 AND t.doc_id = b.doc_id AND t.mention_id = b.mention_id),
    {TAGGED.format(rows="joint")}, c AS ({_paired}) SELECT *, coalesce(CAST(n_other - n_base AS DOUBLE) / nullif(n, 0), 0) AS delta FROM c"""
)
def paired_delta_slices(spark: SparkSession, d: str) -> DataFrame:
    counts = metrics.counted(A.paired(spark, d, (6, 8), swap=True), {"hit": F.col("hit"), "hit_base": F.col("hit_base")}, A.in_training())
    return metrics.deltas_of_counts(storage.materialize(counts, "counts"))


@query(f"""WITH {A.enriched_sql()}, m AS (SELECT doc_id, mention_id, min_by(semantic_group, rank) AS semantic_group, bool_or({HIT}) AS hit FROM preds GROUP BY 1, 2)
    SELECT coalesce(semantic_group, 'overall') AS semantic_group, 'all_at_5' AS slice, count(*) AS n, count(*) FILTER (hit) AS n_correct, CAST(count(*) FILTER (hit) AS DOUBLE) / count(*) AS recall FROM m GROUP BY GROUPING SETS ((semantic_group), ())""")
def slice_all_at_5(spark: SparkSession, d: str) -> DataFrame:
    return metrics.all_at_k(metrics.load_predictions(A.enriched(spark, d), 5))


FUSE_RICH = f"""WITH {A.enriched_sql("p1", swap=True)}, {A.enriched_sql("p2", a=11, b=5, c=4, swap=True)}, u AS ({FUSE.partition("u AS (")[2]}"""


@query(
    f"""{FUSE_RICH}, preds AS (SELECT f.doc_id, f.mention_id, m.mention_order, m.mention, m.semantic_group, m.gold_concept_code, f.rank, f.pred_concept_code, m.gold_concept_name FROM f JOIN p1 m ON m.rank = 1 AND m.doc_id = f.doc_id AND m.mention_id = f.mention_id WHERE f.rank = 1),
    {A.TRAIN_SQL}, {TAGGED.format(rows="test")},
    c AS ({" UNION ALL ".join(f"SELECT coalesce(semantic_group, 'overall') AS semantic_group, '{k}' AS slice, count(*) FILTER ({c}) AS n, count(*) FILTER (({c}) AND {HIT}) AS n_correct FROM tagged GROUP BY GROUPING SETS ((semantic_group), ())" for k, c in SLICES.items())})
    SELECT *, coalesce(CAST(n_correct AS DOUBLE) / nullif(n, 0), 0) AS recall FROM c"""
)
def fused_all_slices(spark: SparkSession, d: str) -> DataFrame:
    top = fusion.fuse_rows(A.fusable(spark, d, FUSED, swap=True), len(FUSED), keep=A.MENTION).where("rank = 1")
    # training, its counts and the tests all read the counts
    return metrics.metrics_of_counts(storage.materialize(metrics.counted(top, {"hit": metrics.correct()}, A.in_training()), "counts"))


def _echo(name: str, k: str) -> str:
    return f"""w{k} AS (SELECT *, pred_concept_code <> gold_concept_code AND pred_concept_code <> '' AS wrong FROM {name} WHERE rank = 1),
x{k} AS (SELECT *, min(CASE WHEN wrong THEN mention_order END) OVER (PARTITION BY doc_id, gold_concept_code) AS first_at,
  first_value(pred_concept_code) OVER (PARTITION BY doc_id, gold_concept_code ORDER BY CASE WHEN wrong THEN mention_order END NULLS LAST) AS first_code FROM w{k}),
e{k} AS (SELECT coalesce(semantic_group, 'overall') AS semantic_group, count(*) FILTER (mention_order > first_at) AS n_exposed,
  count(*) FILTER (mention_order > first_at AND wrong AND pred_concept_code = first_code) AS n_echo FROM x{k} GROUP BY GROUPING SETS ((semantic_group), ())),
r{k} AS (SELECT semantic_group, n_exposed, coalesce(CAST(n_echo AS DOUBLE) / nullif(n_exposed, 0), 0) AS rate FROM e{k})"""


@query(
    f"""WITH {A.predictions_sql("p1", swap=True)}, {A.predictions_sql("p2", c=8, swap=True)}, {_echo("p1", "1")}, {_echo("p2", "2")}
    SELECT semantic_group, a.rate AS a, b.rate AS b, b.rate - a.rate AS delta, coalesce(a.n_exposed, 0) AS support,
      concat(CASE WHEN semantic_group = 'overall' THEN 'Overall (N=' ELSE concat(semantic_group, ' (n=') END, CAST(coalesce(a.n_exposed, 0) AS VARCHAR), ')') AS label FROM r1 a FULL JOIN r2 b USING (semantic_group)"""
)
def echo_context_delta(spark: SparkSession, d: str) -> DataFrame:
    each = [metrics.echo_errors(A.predictions(spark, d, c=c, swap=True).where("rank = 1")).withColumn("context", F.lit(x)) for x, c in (("a", 6), ("b", 8))]
    return metrics.context_delta(each[0].unionByName(each[1]), "a", "b")


@query(f"{P} SELECT doc_id, mention_id, rank, CASE WHEN rank % 2 = 0 THEN '' ELSE mention END AS pred_concept_name FROM preds WHERE rank <= 3 AND gold_concept_code NOT LIKE '%NO_CODE%'")
def prediction_names(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d).withColumn("pred_concept_name", F.when(F.col("rank") % 2 != 0, F.col("mention")))
    return metrics.in_order(metrics.load_predictions(p, 3), A.tasks(spark, d)).select("doc_id", "mention_id", "rank", "pred_concept_name")


_run = "concat(split_part(p_name, ' ', 1), '_', CASE p_partkey % 4 WHEN 0 THEN 'human_only_ft' WHEN 1 THEN 'human_only' WHEN 2 THEN 'full_upsampled' ELSE 'other' END, '_', CASE p_partkey % 3 WHEN 0 THEN 'hybrid_long_v2' WHEN 1 THEN 'short' ELSE 'long' END, CASE p_partkey % 5 WHEN 0 THEN '_complete_addheaders' WHEN 1 THEN '_complete' WHEN 2 THEN '_addheaders' ELSE '' END, CASE WHEN p_partkey % 2 = 0 THEN '_no_constraint' ELSE '_constraint' END, CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 7 < 4 THEN '_best' ELSE '_last' END)"


@query(
    f"""WITH r AS (SELECT p_partkey, {_run} AS run_id, p_partkey % 4 <> 3 AND p_partkey % 7 <> 0 AS ok FROM part)
    SELECT p_partkey, run_id, CASE WHEN ok THEN split_part(run_id, '_', 1) END AS model_name, CASE WHEN ok THEN CASE p_partkey % 4 WHEN 0 THEN 'human_only_ft' WHEN 1 THEN 'human_only' ELSE 'full_upsampled' END END AS aug_data,
      CASE WHEN ok THEN CASE p_partkey % 3 WHEN 0 THEN 'hybrid_long_v2' WHEN 1 THEN 'short' ELSE 'long' END END AS context_format, CASE WHEN ok THEN CASE WHEN p_partkey % 2 = 0 THEN 'no_constraint' ELSE 'constraint' END END AS "constraint",
      CASE WHEN ok THEN CASE WHEN p_partkey % 7 < 4 THEN 'best' ELSE 'last' END END AS checkpoint, CASE WHEN ok THEN substr(run_id, 1, length(run_id) - 5) END AS base_run FROM r"""
)
def run_ids(spark: SparkSession, d: str) -> DataFrame:
    r = A.table(spark, d, "part").selectExpr("p_partkey", _run.replace("'other'", "'other'") + " AS run_id")
    return r.withColumn("x", T.run_id_parts(F.col("run_id"))).select("p_partkey", "run_id", "x.*")


@query("SELECT p_partkey, concat('results/', p_brand, '/', p_name, '_', CAST(p_size AS VARCHAR), '.tsv') AS path, CASE p_partkey % 4 WHEN 0 THEN 'Disease' WHEN 1 THEN 'Overall' WHEN 2 THEN 'Organisms' ELSE p_type END AS label, CASE p_partkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'es' END AS lang, regexp_replace(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part")
def names_and_paths(spark: SparkSession, d: str) -> DataFrame:
    p, k = A.table(spark, d, "part"), F.col("p_partkey") % 4
    label = F.when(k == 0, "ENFERMEDAD").when(k == 1, "overall").when(k == 2, "Living Beings").otherwise(F.col("p_type"))
    corpus_ = F.when(k == 0, "MedMentions").when(k == 1, "QUAERO_EMEA").when(k == 2, "DisTEMIST").otherwise("none")
    return p.select("p_partkey", T.path_of("results/{a}/{b}_{c}.tsv", a=F.col("p_brand"), b=F.col("p_name"), c=F.col("p_size")).alias("path"), T.renamed(label).alias("label"), T.dataset_language(corpus_).alias("lang"), T.safe_name(F.col("p_brand")).alias("safe"))


# --- terminology --------------------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'NO_CODE' WHEN p_partkey % 4 = 0 THEN concat(CAST(p_partkey % 50 AS VARCHAR), ' + ', CAST(p_size AS VARCHAR)) ELSE CAST(p_partkey % 50 AS VARCHAR) END AS code, p_type AS grp FROM part), u AS (SELECT trim(unnest(string_split(code, '+'))) AS code, grp FROM a)
    SELECT DISTINCT code, grp FROM u WHERE code NOT IN ('NO_CODE', '')""")
def kb_priority_pairs(spark: SparkSession, d: str) -> DataFrame:
    return kb.priority_pairs(_annotated(spark, d))


def _annotated(spark: SparkSession, d: str) -> list[DataFrame]:
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    one = (k % 50).cast("string")
    code = F.when(k % 9 == 0, "NO_CODE").when(k % 4 == 0, F.concat(one, F.lit(" + "), F.col("p_size").cast("string"))).otherwise(one)
    a = p.select(code.alias("code"), F.col("p_type").alias("grp"), k)
    return [a.where("p_partkey % 2 = 0"), a.where("p_partkey % 2 = 1")]


RAW = """raw AS (SELECT CASE WHEN p_partkey % 23 = 0 THEN 'NO_CODE' ELSE CAST(p_partkey % 60 AS VARCHAR) END AS code, concat('C', CAST(p_partkey % 60 AS VARCHAR)) AS umls_cui, p_name AS entity, p_type AS grp, substr(p_type, 1, 4) AS category, p_size % 2 = 0 AS is_main FROM part),
names AS (SELECT * FROM raw WHERE code <> 'NO_CODE')"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    p, k = A.table(spark, d, "part"), F.col("p_partkey")
    code = F.when(k % 23 == 0, "NO_CODE").otherwise((k % 60).cast("string"))
    return p.select(code.alias("code"), F.concat(F.lit("C"), (k % 60).cast("string")).alias("cui"), F.col("p_name").alias("term"), F.col("p_type").alias("semantic_tag"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false").alias("mainterm"))


@query(f"WITH {RAW} SELECT * FROM names")
def kb_terminology(spark: SparkSession, d: str) -> DataFrame:
    return kb.terminology(_raw(spark, d))


BUILD = f"""WITH {RAW},
ann AS (SELECT CASE WHEN p_partkey % 9 = 0 THEN 'NO_CODE' WHEN p_partkey % 4 = 0 THEN concat(CAST(p_partkey % 50 AS VARCHAR), ' + ', CAST(p_size AS VARCHAR)) ELSE CAST(p_partkey % 50 AS VARCHAR) END AS code, p_type AS grp FROM part),
priorities AS (SELECT DISTINCT code, grp FROM (SELECT trim(unnest(string_split(code, '+'))) AS code, grp FROM ann) WHERE code NOT IN ('NO_CODE', '')),
miss AS (SELECT code, grp FROM priorities EXCEPT SELECT code, grp FROM names),
firsts AS (SELECT * FROM names QUALIFY row_number() OVER (PARTITION BY code ORDER BY is_main DESC, entity, grp) = 1),
aug AS (SELECT code, umls_cui, entity, grp, category, is_main FROM names UNION ALL SELECT f.code, umls_cui, entity, m.grp, substr(m.grp, 1, 4), is_main FROM miss m JOIN firsts f ON m.code = f.code),
pairs AS (SELECT e.code, entity, grp FROM (SELECT DISTINCT code, entity FROM aug) e JOIN (SELECT DISTINCT code, grp FROM aug) g ON e.code = g.code),
once AS (SELECT * FROM aug QUALIFY row_number() OVER (PARTITION BY code, entity, grp ORDER BY is_main DESC, category) = 1),
j AS (SELECT p.code, p.entity, p.grp, o.umls_cui, o.category, o.is_main FROM pairs p LEFT JOIN once o ON p.code = o.code AND p.entity = o.entity AND p.grp = o.grp),
filled AS (SELECT DISTINCT code, entity, grp, {", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER b, first_value({c} IGNORE NULLS) OVER a) AS {c}" for c in ("umls_cui", "category", "is_main"))} FROM j
  WINDOW b AS (PARTITION BY code ORDER BY entity, grp ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY code ORDER BY entity, grp ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
n1 AS (SELECT *, k.k FROM filled JOIN (SELECT entity, grp, count(DISTINCT code) AS k FROM filled GROUP BY 1, 2) k USING (entity, grp)),
zero AS (SELECT code, entity, grp, umls_cui, category, is_main, 0 AS ambiguous_level FROM n1 WHERE k = 1),
r1 AS (SELECT code, entity, grp, umls_cui, category, is_main FROM n1 n WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM zero z WHERE z.code = n.code AND z.grp = n.grp)),
r1k AS (SELECT r1.*, k.k FROM r1 JOIN (SELECT entity, grp, count(DISTINCT code) AS k FROM r1 GROUP BY 1, 2) k USING (entity, grp)),
done AS (SELECT * FROM zero UNION ALL SELECT code, entity, grp, umls_cui, category, is_main, 1 FROM r1k WHERE k = 1),
rest AS (SELECT n.*, EXISTS (SELECT 1 FROM priorities p WHERE p.code = n.code AND p.grp = n.grp) AS pri FROM filled n WHERE NOT EXISTS (SELECT 1 FROM done q WHERE q.entity = n.entity AND q.grp = n.grp)),
clean AS (SELECT * FROM done UNION ALL SELECT code, entity, grp, umls_cui, category, is_main, 2 FROM (SELECT * FROM rest QUALIFY row_number() OVER (PARTITION BY entity, grp ORDER BY pri DESC, code, umls_cui, category, is_main) = 1)),
lost AS (SELECT code, grp FROM priorities EXCEPT SELECT code, grp FROM clean)"""


def _build(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    part = A.table(spark, d, "part").groupBy((F.col("p_partkey") % 60).cast("string").alias("code"))
    full = part.agg(F.min_by("p_brand", "p_partkey").alias("full_name"))
    return kb.build_with_priorities(_raw(spark, d), _annotated(spark, d), full)


@query(f"{BUILD} SELECT DISTINCT c.*, p.p_brand AS full_name FROM clean c LEFT JOIN (SELECT CAST(p_partkey % 60 AS VARCHAR) AS code, min_by(p_brand, p_partkey) AS p_brand FROM part GROUP BY 1) p ON p.code = c.code")
def kb_build_with_priorities(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, d)[0]


@query(f"{BUILD} SELECT DISTINCT n.code, c.code AS chosen_code FROM filled n JOIN clean c ON n.entity = c.entity AND n.grp = c.grp WHERE n.code <> c.code AND n.code IN (SELECT code FROM lost)")
def kb_build_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _build(spark, d)[1]


def _prepared(base: str) -> str:
    from .queries import C, _kinds, _list, _short

    title = f"""coalesce(preferred[1], CASE WHEN len(title_main) = 1 THEN title_main[1] END, {_short("title_main")}, CASE WHEN len(title_en) = 1 THEN title_en[1] END, {_short("title_en")}, CASE WHEN len(title_fr) = 1 THEN title_fr[1] END, CASE WHEN len(title_es) = 1 THEN title_es[1] END)"""
    melt = " UNION ALL ".join(f"SELECT cui, title, {f"'{k[-2:]}'" if k != 'title_main' else 'NULL'} AS lang, unnest({k}) AS syn, {str(k == 'title_main').lower()} AS is_main FROM t" for k in _kinds)
    up = "(upper(substr({x}, 1, 1)) || substr({x}, 2))"
    return f"""{C}, {TYPES}, s AS (SELECT cui, {_list("tty = 'PN'")} AS preferred, {", ".join(f"{_list(c)} AS {k}" for k, c in _kinds.items())} FROM conso GROUP BY cui), t AS (SELECT *, {title} AS title FROM s),
melt AS ({melt}), sem AS (SELECT cui, tree_code, sem_name, category, grp FROM types LEFT JOIN groups USING (sem_code, sem_name)), chosen AS ({base}),
d AS (SELECT cui AS code, {up.format(x="title")} AS title, {up.format(x="syn")} AS entity, sem_name, category, grp, is_main, lang FROM melt JOIN chosen USING (cui)),
names AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY code, entity, grp ORDER BY is_main DESC, lang NULLS LAST, sem_name NULLS LAST, title NULLS LAST) = 1),
{LEVELS.removeprefix(f"{N},").strip()}
SELECT * FROM full_names f WHERE NOT (entity = upper(entity) AND EXISTS (SELECT 1 FROM full_names o WHERE o.code = f.code AND o.entity <> upper(o.entity) AND lower(o.entity) = lower(f.entity)))"""


_by_tree = "SELECT DISTINCT cui, CASE WHEN starts_with(tree_code, 'A1.1.4') THEN 'Virus' WHEN starts_with(tree_code, 'A1.2') THEN 'Anatomical Structure' ELSE 'Injury or Poisoning' END AS sem_name, category, grp FROM sem WHERE tree_code <> 'Z9'"


@query(_prepared(_by_tree))
def kb_prepare_by_tree(spark: SparkSession, d: str) -> DataFrame:
    c = A.conso(spark, d)
    return kb.prepare_by_tree(kb.codes(c), kb.synonyms(c), kb.semantic(*_types(spark, d)))


@query(_prepared("SELECT DISTINCT cui, sem_name, category, grp FROM sem WHERE category IN ('ECON', 'LARG', 'SMAL')"))
def kb_prepare_by_category(spark: SparkSession, d: str) -> DataFrame:
    c = A.conso(spark, d)
    return kb.prepare_by_category(kb.codes(c), kb.synonyms(c), kb.semantic(*_types(spark, d)), ("ECON", "LARG", "SMAL"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN concat('N', CAST(p_size AS VARCHAR), '+', 'K') WHEN p_size % 2 = 0 THEN concat('N', CAST(p_size AS VARCHAR)) ELSE CAST(p_size AS VARCHAR) END AS code FROM (SELECT p_partkey, p_size - p_size % 2 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 2 END AS p_size FROM part)""")
def corrected_codes(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part").selectExpr("p_partkey", "p_size - p_size % 2 + CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size % 2 END AS s")
    c = p.where("s % 2 = 0").select(F.col("s").cast("string").alias("code"), F.concat(F.lit("N"), F.col("s").cast("string")).alias("code_new")).distinct()
    rows = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("s").cast("string"), F.lit(" + K"))).otherwise(F.col("s").cast("string")).alias("code"))
    return corpus.correct_codes(rows, c).select("p_partkey", "code")


# --- documents ----------------------------------------------------------------------------------------------------


@query(f"{M} SELECT doc_id, mention_id, CASE WHEN mention_order % 3 = 0 THEN name ELSE '' END AS db_pred_match, CASE WHEN mention_order % 3 = 0 THEN code ELSE '' END AS db_pred_id FROM mentions")
def predictions_in_pages(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    preds = m.where("mention_order % 3 = 0").select("mention_id", F.lit(1).alias("rank"), F.col("name").alias("pred_concept_name"), F.col("code").alias("pred_concept_code"))
    nested = spans.nest_predictions(spans.with_predictions(m, preds.unionByName(preds.withColumn("rank", F.lit(2)))))
    return nested.select("doc_id", F.explode("entities").alias("e")).select("doc_id", "e.mention_id", "e.db_pred_match", "e.db_pred_id")


@query(f"""{M} SELECT doc_id, mention_id, concat('{{"id":"', mention_id, '","type":"', semantic_group, '","text":["', mention, '"],"offsets":[[', CAST(start_span AS VARCHAR), ',', CAST(end_span AS VARCHAR), ']],"normalized":[{{"db_name":"","db_id":"', code, '"}}]}}') AS record FROM mentions""")
def span_records(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    return m.select("doc_id", "mention_id", spans.span_record(m).alias("record"))


_inside = "mention_order % 4 <> 0"


@query(f"""{M}, p AS (SELECT m.*, text, start_span - p.start AS rel FROM mentions m JOIN passages p ON m.doc_id = p.doc_id AND start_span >= p.start AND start_span < p.stop)
    SELECT doc_id, mention_id, CASE WHEN {_inside} THEN trim(regexp_replace(concat(substr(text, 1, rel), '[', mention, ']{{', semantic_group, '}}', substr(text, rel + length(mention) + 1)), '\\s+', ' ', 'g')) ELSE concat('[', mention, ']{{', semantic_group, '}}') END AS marked FROM p""")
def marked_with_label(spark: SparkSession, d: str) -> DataFrame:
    m = spans.mention_in_passage(A.mentions(spark, d), A.passages(spark, d))
    start = F.when(F.expr(_inside), F.col("start_span") - F.col("passage_start")).otherwise(F.lit(-1)).cast("int")
    stop = (F.col("end_span") - F.col("passage_start")).cast("int")
    return m.select("doc_id", "mention_id", spans.marked_or_bare(F.col("passage_text"), start, stop, F.col("semantic_group"), F.col("mention")).alias("marked"))


@query(f"""{M}, t AS (SELECT doc_id, mention_order, concat('[', mention, ']{{', semantic_group, '}} ', name, '<SEP>') AS part FROM mentions), o AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY mention_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM t)
    SELECT doc_id, mention_order, CAST(start + instr(part, '}}') + 1 AS INTEGER) AS start, CAST(start + length(part) AS INTEGER) AS stop, true AS on_name, false AS on_mark FROM o""")
def completion_name_spans(spark: SparkSession, d: str) -> DataFrame:
    part = F.struct("mention_order", F.concat(T.target_text(F.col("mention"), F.col("semantic_group"), F.col("name")), F.lit("<SEP>")).alias("t"))
    c = A.mentions(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "").alias("completion"))
    c = c.withColumn("spans", spans.completion_spans(F.col("completion")))
    x = c.select("doc_id", F.posexplode("spans").alias("i", "s"), "spans")
    token = lambda a, b: F.get(spans.label_mask(F.array(F.struct(a.cast("int").alias("start"), b.cast("int").alias("stop"))), F.col("spans")), F.lit(0))
    return x.select("doc_id", (F.col("i") + 1).cast("long").alias("mention_order"), "s.start", "s.stop", token(F.col("s.start"), F.col("s.start") + 1).alias("on_name"), token(F.col("s.start") - 2, F.col("s.start") - 1).alias("on_mark"))


@query("""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS t FROM documents) SELECT doc_id, CASE WHEN i < t // 7 * 7 THEN i // (t // 7) ELSE i - t // 7 * 7 END AS chunk FROM n""")
def near_equal_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus.chunks(A.table(spark, d, "documents").select("doc_id"), ["doc_id"], 7).select("doc_id", "chunk")


@query("""WITH RECURSIVE n AS (SELECT conv_id, turn, length(text) AS len, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS i FROM conversations),
    f AS (SELECT conv_id, turn, i, len AS total, 0 AS pack FROM n WHERE i = 1 UNION ALL SELECT n.conv_id, n.turn, n.i, CASE WHEN f.total + n.len <= 600 THEN f.total + n.len ELSE n.len END, CASE WHEN f.total + n.len <= 600 THEN f.pack ELSE f.pack + 1 END FROM f JOIN n ON n.conv_id = f.conv_id AND n.i = f.i + 1)
    SELECT conv_id, turn, pack FROM f""")
def packed_batches(spark: SparkSession, d: str) -> DataFrame:
    c = A.table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"))
    return packing.packed(c, ["conv_id"], "len", ["turn"], 600)


PACKS = """n AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS i FROM documents),
    f AS (SELECT source, doc_id, n_chars, i, n_chars AS total, 0 AS pack FROM n WHERE i = 1 UNION ALL SELECT n.source, n.doc_id, n.n_chars, n.i, CASE WHEN f.total + n.n_chars <= 20000 THEN f.total + n.n_chars ELSE n.n_chars END, CASE WHEN f.total + n.n_chars <= 20000 THEN f.pack ELSE f.pack + 1 END
      FROM f JOIN n ON n.source IS NOT DISTINCT FROM f.source AND n.i = f.i + 1)"""


@query(f"WITH RECURSIVE {PACKS} SELECT source, doc_id, pack FROM f")
def packed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each source in packs of up to 20,000 characters, longest first; a source is in no task as a whole."""
    return packing.packed(A.table(spark, d, "documents"), ["source"], "n_chars", ["doc_id"], 20_000)


@query(
    f"""WITH RECURSIVE {PACKS}, s AS (SELECT *, row_number() OVER (PARTITION BY source, pack ORDER BY doc_id) AS j FROM f),
    g AS (SELECT source, pack, doc_id, j, n_chars AS total, 0 AS sub FROM s WHERE j = 1 UNION ALL SELECT s.source, s.pack, s.doc_id, s.j, CASE WHEN g.total = 0 OR g.total + s.n_chars <= 6000 THEN g.total + s.n_chars ELSE s.n_chars END, CASE WHEN g.total = 0 OR g.total + s.n_chars <= 6000 THEN g.sub ELSE g.sub + 1 END
      FROM g JOIN s ON s.source IS NOT DISTINCT FROM g.source AND s.pack = g.pack AND s.j = g.j + 1)
    SELECT source, pack, doc_id, sub FROM g"""
)
def sub_batches(spark: SparkSession, d: str) -> DataFrame:
    """Packs cut into parts of up to 6,000 characters in the order of ids."""
    docs = A.table(spark, d, "documents").select("doc_id", "n_chars")
    packs = packing.packed(A.table(spark, d, "documents"), ["source"], "n_chars", ["doc_id"], 20_000).join(docs, "doc_id")
    return packing.sub_batches(packs, ["source", "pack"], "n_chars", ["doc_id"], 6_000)


@query("""SELECT k.fold, doc_id FROM (SELECT doc_id, CAST('0x' || substr(md5(concat('42:', CAST(doc_id AS VARCHAR))), 1, 15) AS BIGINT) % 5 AS own FROM documents) d JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold) k ON k.fold <> d.own""")
def kfold_training_rows(spark: SparkSession, d: str) -> DataFrame:
    return corpus.complement(corpus.kfold_by_hash(A.table(spark, d, "documents").select("doc_id"), "doc_id"))


@query("""SELECT 'full' AS mode, 'large' AS side, doc_id FROM documents UNION ALL SELECT 'full', 'small', item_id FROM benchmark UNION ALL SELECT 'synthetic', 'small', item_id FROM benchmark UNION ALL SELECT 'human', 'large', doc_id FROM documents""")
def training_mixes(spark: SparkSession, d: str) -> DataFrame:
    a, b = A.table(spark, d, "documents").select("doc_id"), A.table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))
    each = [corpus.upsampled(a, b, "doc_id", m).select(F.lit(m).alias("mode"), "side", "doc_id") for m in ("full", "synthetic", "human")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query(f"""{M} SELECT doc_id, mention_id, concat('### Context', chr(10), name, chr(10), chr(10), '### Previous Normalizations', chr(10), CASE WHEN mention_order = 1 THEN 'None' ELSE code END, chr(10), chr(10), '### Prediction', chr(10), '[', mention, ']') AS memory,
    concat('### Context', chr(10), name, chr(10), chr(10), '### Prediction', chr(10), '[', mention, ']') AS plain, concat('### Context', chr(10), name, chr(10), chr(10), '### Predictions', chr(10), CASE WHEN mention_order = 1 THEN '' ELSE concat(code, chr(10)) END, '[', mention, ']') AS long FROM mentions""")
def inference_prompts(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    source, target = F.concat("name", F.lit("  \n")), F.concat(F.lit("["), "mention", F.lit("] "))
    before = F.when(F.col("mention_order") == 1, F.lit("")).otherwise(F.concat("code", F.lit("\n")))
    form = {"memory": "hybrid_long", "plain": "short", "long": "long"}
    return m.select("doc_id", "mention_id", *(T.inference_prompt(source, target, before, f).alias(k) for k, f in form.items()))


# --- decoding -----------------------------------------------------------------------------------------------------

_seq = "concat(p_name, ' ', p_brand)"
_word = lambda t, i: f"coalesce(string_split({t}, ' ')[{i}], '</s>')"
_greedy = ", ".join(f"({_word('name', i)} = {_word('mention', i)}) DESC, {_word('name', i)}" for i in range(1, 7))


@query(
    f"""WITH names AS (SELECT p_type AS grp, {_seq} AS name, min(CAST(p_size AS VARCHAR)) AS code FROM part GROUP BY 1, 2), m AS (SELECT p_partkey, p_type AS grp, CASE WHEN p_partkey % 3 = 0 THEN {_seq} ELSE p_name END AS mention FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS mention_id, name AS pred_concept_name, code AS pred_concept_code FROM m JOIN names USING (grp) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY {_greedy}) = 1"""
)
def trie_constrained_decode(spark: SparkSession, d: str) -> DataFrame:
    p = A.table(spark, d, "part")
    name = F.concat_ws(" ", "p_name", "p_brand")
    names = p.select(F.col("p_type").alias("grp"), name.alias("entity"), F.col("p_size").cast("string").alias("code"))
    mention = F.when(F.col("p_partkey") % 3 == 0, name).otherwise(F.col("p_name"))
    m = p.select(F.col("p_partkey").cast("string").alias("mention_id"), mention.alias("mention"), F.col("p_type").alias("semantic_group"), F.lit("").alias("prompt"))
    return decode.decode_constrained(m, names).select("mention_id", "pred_concept_name", "pred_concept_code")


MEMORY = f"""{M}, named AS (SELECT *, CASE WHEN mention_order % 2 = 0 THEN name ELSE mention END AS shown FROM mentions), least AS (SELECT semantic_group, min(name) AS least FROM mentions GROUP BY 1),
dict AS (SELECT semantic_group, name AS pred_concept_name, min(code) AS pred_concept_code FROM mentions GROUP BY 1, 2),
p AS (SELECT n.*, CASE WHEN mention_order % 2 = 0 THEN name ELSE least END AS pred_concept_name FROM named n JOIN least USING (semantic_group)),
h AS (SELECT *, string_agg(concat('[', shown, ']{{', semantic_group, '}} ', pred_concept_name), chr(10)) OVER (PARTITION BY doc_id ORDER BY mention_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS memory FROM p)"""


@query(f"""{MEMORY} SELECT doc_id, mention_id, pred_concept_name, pred_concept_code, concat('### Context', chr(10), shown, chr(10), chr(10), '### Previous Normalizations', chr(10), coalesce(memory, 'None'), chr(10), chr(10), '### Prediction', chr(10), '[', shown, ']{{', semantic_group, '}}') AS prompt FROM h JOIN dict USING (semantic_group, pred_concept_name)""")
def trie_memory_decode(spark: SparkSession, d: str) -> DataFrame:
    shown = F.when(F.col("mention_order") % 2 == 0, F.col("name")).otherwise(F.col("mention"))
    a = A.mentions(spark, d)
    m = a.select("doc_id", "mention_id", "mention_order", shown.alias("mention"), "semantic_group", shown.alias("source"))
    names = a.select(F.col("semantic_group").alias("grp"), F.col("name").alias("entity"), "code")
    return decode.decode_with_memory(m, names, beams=1, step=decode.same_place).select("doc_id", "mention_id", "pred_concept_name", "pred_concept_code", "prompt")


@query(f"{ALIGN}, x AS (SELECT filename, start_span, ner_status FROM aligned) SELECT filename, start_span, count(*) FILTER (ner_status = 'TP') AS tp, count(*) AS n FROM x GROUP BY 1, 2")
def ner_status_by_start(spark: SparkSession, d: str) -> DataFrame:
    return metrics.align_entities(*_entities(spark, d)).groupBy("filename", "start_span").agg(F.count_if(F.col("ner_status") == "TP").alias("tp"), F.count("*").alias("n"))


@query(f"{M} SELECT doc_id, mention_id, {TARGET} AS raw, concat('[', mention, ']{{', semantic_group, '}} ', name, '<+>', name) AS cleaned, round(exp(-mention_order::DOUBLE), 12) AS score FROM mentions")
def cleaned_outputs(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    t = T.target_text(F.col("mention"), F.col("semantic_group"), F.col("name"))
    raw = F.concat(F.lit("<s>"), t, F.lit("<+>  "), "name", F.lit("</s>"))
    return m.select("doc_id", "mention_id", F.concat(t, F.lit("\n")).alias("raw"), T.strip_special(raw).alias("cleaned"), F.round(T.beam_score(-F.col("mention_order").cast("double"), 5), 12).alias("score"))
