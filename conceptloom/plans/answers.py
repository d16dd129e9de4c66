"""Queries of decoding over token tries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beams, tokentrie
from . import adapters as A
from .queries import M, query

#: The dictionary of the mentions of conversations: names of several words in each group.
ENTITIES = "entities AS (SELECT DISTINCT semantic_group AS grp, concat(name, ' of ', lower(code)) AS entity, code FROM mentions)"
WORD_ID = "CAST(concat('0x', substr(md5({}), 1, 7)) AS INTEGER) + 16"


def _entities(spark: SparkSession, d: str) -> DataFrame:
    m = A.mentions(spark, d)
    return m.select(F.col("semantic_group").alias("grp"), F.concat("name", F.lit(" of "), F.lower("code")).alias("entity"), "code").distinct()


STEPS = f"""{M}, {ENTITIES}, seqs AS (SELECT DISTINCT grp, list_append(list_transform(string_split(entity, ' '), lambda w: {WORD_ID.format("w")}), 0) AS seq FROM entities),
steps AS (SELECT DISTINCT grp, seq[1:i - 1] AS prefix, seq[i] AS next FROM (SELECT grp, seq, unnest(range(1, len(seq) + 1)) AS i FROM seqs))"""


@query(f"{STEPS} SELECT grp, CAST(len(prefix) AS INTEGER) AS depth, array_to_string(prefix, ' ') AS prefix, CAST(next AS INTEGER) AS next FROM steps")
def trie_token_edges(spark: SparkSession, d: str) -> DataFrame:
    """Every step of the tries of token ids, read back from the segments."""
    path = tokentrie.write(_entities(spark, d))
    e = tokentrie.edges(spark.read.parquet(path), path)
    return e.select("grp", "depth", F.array_join(F.col("prefix").cast("array<string>"), " ").alias("prefix"), "next")


@query(f"{STEPS}, n AS (SELECT grp, array_to_string(prefix, ' ') AS prefix, count(*) AS n, min(next) AS least, max(next) AS most FROM steps GROUP BY ALL) SELECT grp, prefix, n, least, most FROM n")
def trie_token_get(spark: SparkSession, d: str) -> DataFrame:
    """How many ids may follow each prefix, looked up prefix by prefix in memory-mapped tries."""
    import pandas as pd

    path = tokentrie.write(_entities(spark, d))
    shelf = tokentrie.Shelf(path)
    prefixes = tokentrie.edges(spark.read.parquet(path), path).select("grp", "prefix").distinct()

    def look_up(batches):
        for pdf in batches:
            found = [shelf(r.grp).get(r.prefix) for r in pdf.itertuples(index=False)]
            yield pd.DataFrame({"grp": pdf["grp"], "prefix": [" ".join(map(str, p)) for p in pdf["prefix"]], "n": [len(f) for f in found], "least": [min(f) for f in found], "most": [max(f) for f in found]})

    return prefixes.mapInPandas(look_up, "grp string, prefix string, n long, least int, most int")


#: One to three names a mention: its own, and the first and last of its group.
ASKED = f"""{M}, {ENTITIES}, ends AS (SELECT grp, min(entity) AS low, max(entity) AS high FROM entities GROUP BY grp),
asked AS (SELECT doc_id, mention_id, mention_order, semantic_group, list_slice([concat(name, ' of ', lower(code)), low, high], 1, 1 + mention_order % 3) AS names
  FROM mentions JOIN ends ON grp = semantic_group),
codes AS (SELECT grp, entity, min(code) AS code FROM entities GROUP BY ALL)"""


def _asked(spark: SparkSession, d: str, most: int = 3) -> tuple[DataFrame, DataFrame]:
    names = _entities(spark, d)
    ends = names.groupBy("grp").agg(F.min("entity").alias("low"), F.max("entity").alias("high"))
    m = A.mentions(spark, d)
    m = m.join(F.broadcast(ends), m["semantic_group"] == ends["grp"])
    all_ = F.array(F.concat("name", F.lit(" of "), F.lower("code")), "low", "high")
    mention = F.array_join(F.slice(all_, 1, (F.lit(1) + F.col("mention_order") % most).cast("int")), "<+>")
    return m.select("doc_id", "mention_id", "mention_order", "semantic_group", mention.alias("mention"), F.concat(F.lit("document "), "doc_id", F.lit(" ")).alias("source")), names


#: Tokens of an answer: word ids, 1 between names, 2 at the end. The score of a token is -(1 + id % 7) / 8, all of them wanted ones.
TOKENS = f"""tok AS (SELECT *, list_append(flatten(list_transform(names, lambda n, k: list_concat(CASE WHEN k > 1 THEN [1] ELSE [] END, list_transform(string_split(n, ' '), lambda w: {WORD_ID.format("w")})))), 2) AS ids FROM asked),
scored AS (SELECT *, list_sum(list_transform(ids, lambda t: -(1 + t % 7) / 8.0)) AS total, list_sum(list_transform(list_filter(ids, lambda t: t > 2), lambda t: -(1 + t % 7) / 8.0)) AS own, len(list_filter(ids, lambda t: t > 2)) AS n_own FROM tok),
coded AS (SELECT mention_id, string_agg(DISTINCT code, '+' ORDER BY code) AS code FROM (SELECT mention_id, semantic_group, unnest(names) AS entity FROM asked) a JOIN codes c ON c.grp = a.semantic_group AND c.entity = a.entity GROUP BY 1)"""


@query(
    f"""{ASKED}, {TOKENS} SELECT doc_id, mention_id, array_to_string(names, '<+>') AS pred_concept_name, code AS pred_concept_code, CAST(len(names) AS INTEGER) AS n_answers, CAST(len(ids) AS INTEGER) AS n_tokens,
    total / len(ids) AS score, round(exp(own / n_own), 9) AS confidence FROM scored JOIN coded USING (mention_id)"""
)
def decode_multiple(spark: SparkSession, d: str) -> DataFrame:
    """One to three answers to each mention, by a beam over the tries that may start anew after each name."""
    mentions, names = _asked(spark, d)
    out = beams.decode(mentions, tokentrie.write(names), beams.SamePlace(beams.word_ids), multiple=True, batch_size=32)
    return out.select("doc_id", "mention_id", "pred_concept_name", "pred_concept_code", "n_answers", "n_tokens", "score", F.round("confidence", 9).alias("confidence"))


@query(
    f"""{ASKED.replace("1 + mention_order % 3", "1")}, {TOKENS},
    said AS (SELECT *, coalesce(string_agg(concat('[', names[1], ']{{', semantic_group, '}} ', names[1]), chr(10)) OVER (PARTITION BY doc_id ORDER BY mention_order, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'None') AS memory,
      count(*) OVER (PARTITION BY doc_id ORDER BY mention_order, mention_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lines FROM scored)
    SELECT doc_id, mention_id, names[1] AS pred_concept_name, code AS pred_concept_code, (total - len(ids) * lines / 16.0) / len(ids) AS score,
    concat('### Context', chr(10), 'document ', doc_id, chr(10), chr(10), '### Previous Normalizations', chr(10), memory, chr(10), chr(10), '### Prediction', chr(10), '[', names[1], ']{{', semantic_group, '}}') AS prompt FROM said JOIN coded USING (mention_id)"""
)
def decode_waves(spark: SparkSession, d: str) -> DataFrame:
    """Mentions in order with what was predicted before them, many documents in each call of the scorer."""
    mentions, names = _asked(spark, d, 1)
    out = beams.decode(mentions, tokentrie.write(names), beams.SamePlace(beams.word_ids), batch_size=16, context_format="hybrid_short")
    return out.select("doc_id", "mention_id", "pred_concept_name", "pred_concept_code", "score", "prompt")
