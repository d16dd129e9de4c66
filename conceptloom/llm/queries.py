"""The queries opN_<name> of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import warc

    out = common.fresh_path(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = simhash.with_fingerprints(docs).select("doc_id", "__fp")
    out = simhash.near_duplicates(marked)
    return out.select("doc_id", simhash.hex_fingerprint(F.col("__fp")).alias("fingerprint"), F.col("__component").alias("component_id"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality_rules as q

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    stats = q.statistics(docs).drop("text")
    stats = common.materialize(stats, "statistics")
    out = q.judge(stats, q.fit(stats))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *(F.col(f"__{c}").alias(c) for c in names), F.col("__distance").alias("robust_distance"))


def op4_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import htmltext

    out = htmltext.extract(common.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("__text").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import decontam

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    hit = decontam.scan_hits(docs, common.table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(__hits.spans, 0L, (a, x) -> a + x.stop - x.start)")
    return hit.select(
        "doc_id",
        F.col("__hits.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("__hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("__hits.items")), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op7_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import classlm, labelled

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = labelled.fold(F.col("doc_id"), 7) == 2
    common.bounded_batches(spark)
    model, counts = classlm.fit(docs.where(~held_out))
    out = classlm.score(docs, model, counts)
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("__n_tokens").alias("n_tokens"),
        F.col("__n_known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        F.col("__base_score").alias("base_score"),
        F.col("__score").alias("score"),
    )


#: A public vocabulary with scores; the folder is a parameter.
TOKENIZERS = "/opt/tokenizers"


def op8_token_counts(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from . import tokencount

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = tokencount.count(docs, tokencount.load_vocabulary(f"{tokenizers}/piece_bpe_32k.model"))
    return out.select("doc_id", F.col("__n_tokens").alias("n_tokens"), F.col("__n_unknown").alias("n_unknown"))


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import compression, labelled

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = compression.classify(docs, common.table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 5) != 0)
    return out.select("doc_id", (labelled.fold(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import labelled, toxicity

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.classify(docs, common.table(spark, sf_dir, "labels"), labelled.fold(F.col("doc_id"), 4) != 2)
    return out.select("doc_id", (labelled.fold(F.col("doc_id"), 4) == 2).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))


def op11_bpe(spark: SparkSession, sf_dir: str, tokenizers: str = TOKENIZERS) -> DataFrame:
    from . import bpe

    out = bpe.encode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), f"{tokenizers}/word_bpe_49k.json")
    ids = F.array_join(F.col("__ids").cast("array<string>"), " ")
    return out.select("doc_id", F.size("__ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("__decoded", 256).alias("decoded_sha256"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import merkle

    docs = common.table(spark, sf_dir, "documents").select(*merkle.COLUMNS)
    claim = [F.col("n_chars").cast("decimal(20,0)") + 1 if c == "n_chars" else F.col(c) for c in merkle.COLUMNS]
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, merkle.digest(claim))
    m = merkle.manifest(docs, more={"changed": F.when(F.col("n_chars").isNotNull(), changed)})
    out = m.withColumn("folded_root", merkle.fold(F.coalesce("changed", "leaf"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", merkle.proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: The words of a text, of which those from a on repeat the first p of them; null for a text without words. One lambda inside
#: of another would keep the optimizer from taking the runs' function out of the expression.
_PLANTED = """get(transform(transform(transform(
  filter(array(struct({words} AS w, {g} AS g)), v -> size(v.w) > 0),
  v -> struct(v.w AS w, v.g AS g, int(v.g % size(v.w)) AS a)),
  v -> struct(v.w AS w, v.a AS a, int(1 + (size(v.w) - v.a) div (3 + v.g % 8)) AS p)),
  v -> array_join(concat(slice(v.w, 1, v.a), slice(flatten(array_repeat(slice(v.w, v.a + 1, v.p), int(ceil((size(v.w) - v.a) / v.p)))), 1, size(v.w) - v.a)), ' ')), 0)"""


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import periodic

    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    h = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY))"
    planted = F.expr(_PLANTED.format(words=r"array_remove(split(text, '[\\x20\\x09-\\x0D]+'), '')", g=f"{h} div 10"))
    docs = docs.withColumn("text", F.when(F.expr(f"{h} % 10 = 0"), F.coalesce(planted, "text")).otherwise(F.col("text")))
    d = periodic.find(docs).select("doc_id", "__periodic.*")
    best = F.expr("aggregate(runs, CAST(NULL AS STRUCT<start: BIGINT, length: BIGINT, period: BIGINT>), (b, r) -> if(b IS NULL OR r.length * b.period > b.length * r.period, r, b))")
    rows = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    d = d.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(rows, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return d.select("doc_id", "n_runs", "best.start", "best.length", "best.period", milli, "runs_sha256", "collapsed_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_warc, op2_simhash, op3_quality_rules, op4_html_mincut, op5_decontamination, op6_mixing, op7_class_lm, op8_token_counts, op9_compression_quality, op10_toxicity, op11_bpe, op12_merkle_manifest, op13_periodic_runs)
    return {f.__name__: f for f in all_}


#: Digests in base 32 are spelled from five hexadecimal digits, four letters at a time.
OP1_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS top, count(*) OVER (PARTITION BY html) AS n FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST((k // 4) * 5 + 1 AS INTEGER), 5) AS INTEGER) >> CAST(5 * (3 - k % 4) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to
FROM m"""

_W = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP5_SQL = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_W} AS w FROM documents), b AS MATERIALIZED (SELECT item_id, {_W} AS w FROM benchmark),
bi AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS MATERIALIZED (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM bi),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS MATERIALIZED (SELECT doc_id, i, di.n, item FROM di JOIN bw ON bw.n = di.n AND bw.win = array_to_string(w[i:i + di.n - 1], ' ')),
places AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _leaf(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


#: crc32 bit by bit; levels are lists, one a language and level; folds go up a step at a time.
OP12_SQL = f"""WITH RECURSIVE c AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS v FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL)
  UNION ALL SELECT doc_id, s, k + 1, xor(w >> 1, CASE WHEN w & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT doc_id, s, k, CASE WHEN k % 8 = 0 THEN xor(v, ascii(substr(s, k // 8 + 1, 1))) ELSE v END AS w FROM c WHERE k < 8 * len(s))),
crc AS (SELECT doc_id, xor(v, 4294967295) AS h FROM c WHERE k = 8 * len(s)),
d AS MATERIALIZED (SELECT d.doc_id, lang, {_leaf("d.doc_id", "source", "lang", "n_chars", "text")} AS leaf,
  CASE WHEN n_chars IS NOT NULL AND h % 7 = 0 THEN {_leaf("d.doc_id", "source", "lang", "n_chars + 1", "text")} END AS changed FROM documents d LEFT JOIN crc USING (doc_id)),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
t AS (SELECT lang, 0 AS lev, list(leaf ORDER BY pos) AS a FROM p GROUP BY lang
  UNION ALL SELECT lang, lev + 1, list_transform(range(0, (len(a) + 1) // 2), lambda i: sha256(a[2 * i + 1] || coalesce(a[2 * i + 2], ''))) FROM t WHERE len(a) > 1),
sub AS (SELECT lang, a[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM t WHERE len(a) = 1),
u AS (SELECT 0 AS lev, list(subroot ORDER BY place) AS a FROM sub
  UNION ALL SELECT lev + 1, list_transform(range(0, (len(a) + 1) // 2), lambda i: sha256(a[2 * i + 1] || coalesce(a[2 * i + 2], ''))) FROM u WHERE len(a) > 1),
x AS MATERIALIZED (SELECT p.lang, p.pos, lev, (pos >> lev) & 1 AS side, coalesce(a[xor(pos >> lev, 1) + 1], '') AS sib FROM p JOIN t ON t.lang IS NOT DISTINCT FROM p.lang AND len(a) > 1
  UNION ALL SELECT p.lang, p.pos, 1000 + lev, (place >> lev) & 1, coalesce(a[xor(place >> lev, 1) + 1], '') FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN u ON len(a) > 1),
y AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang, pos ORDER BY lev) - 1 AS k FROM x),
f AS (SELECT lang, pos, 0 AS k, coalesce(changed, leaf) AS v FROM p
  UNION ALL SELECT f.lang, f.pos, f.k + 1, sha256(CASE WHEN side = 1 THEN sib || v ELSE v || sib END) FROM f JOIN y ON y.lang IS NOT DISTINCT FROM f.lang AND y.pos = f.pos AND y.k = f.k),
e AS (SELECT lang, pos, arg_max(v, k) AS folded_root FROM f GROUP BY lang, pos),
q AS (SELECT lang, pos, sha256(string_agg(sib, '' ORDER BY k)) AS proof_sha256 FROM y GROUP BY lang, pos)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM p JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN e ON e.lang IS NOT DISTINCT FROM p.lang AND e.pos = p.pos
LEFT JOIN q ON q.lang IS NOT DISTINCT FROM p.lang AND q.pos = p.pos CROSS JOIN (SELECT a[1] AS root FROM u WHERE len(a) = 1)"""


def oracle_sql() -> dict[str, str]:
    """SQL where it says all of a query; the others are tested against brute force."""
    return {"op1_warc": OP1_SQL, "op5_decontamination": OP5_SQL, "op12_merkle_manifest": OP12_SQL}
