"""Terminology building: raw releases to a dictionary with one code for each name of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.storage import materialize


def rrf_fields(lines: DataFrame, names: dict[str, int]) -> DataFrame:
    """Fields of |-separated lines by position; short lines give nulls."""
    parts = F.split("value", r"\|")
    return lines.select(*(F.get(parts, F.lit(i)).alias(n) for n, i in names.items()))


def codes(conso: DataFrame) -> DataFrame:
    """Distinct (cui, code)."""
    return conso.select("cui", "code").distinct()


def semantic(types: DataFrame, groups: DataFrame) -> DataFrame:
    """Semantic types with their category and group."""
    g = groups.select(F.col("sem_code").alias("__c"), F.col("sem_name").alias("__n"), "category", "grp").distinct()
    d = types.distinct()
    return d.join(g, (d["sem_code"] == g["__c"]) & (d["sem_name"] == g["__n"]), "left").drop("__c", "__n")


def definitions(defs: DataFrame) -> DataFrame:
    """(cui, definitions): the distinct definitions of each concept, sorted."""
    return defs.where(F.col("definition").isNotNull()).groupBy("cui").agg(F.array_sort(F.collect_set("definition")).alias("definitions"))


def term_kind(tty: Column, sab: Column, lat: Column, ts: Column) -> Column:
    """Where a term goes besides the preferred names: main titles, then titles (TS P) and synonyms of the three languages."""
    lang = F.create_map(*(F.lit(x) for x in ("ENG", "en", "FRE", "fr", "SPA", "es")))
    other = F.concat(F.when(ts == "P", F.lit("title_")).otherwise(F.lit("alias_")), F.element_at(lang, lat))
    return F.when(sab == "MTH", F.lit("title_main")).when(lat.isin("ENG", "FRE", "SPA"), other)


def synonyms(conso: DataFrame) -> DataFrame:
    """One row a concept: sorted lists of titles and aliases by language, and the best title.

    All kinds are collected in one aggregate by concept, in place of a chain of outer joins.
    """
    kinds = ("title_main", "title_fr", "title_en", "title_es", "alias_fr", "alias_en", "alias_es")
    d = conso.withColumn("kind", term_kind(F.col("tty"), F.col("sab"), F.col("lat"), F.col("ts")))
    sets = [F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("term")))).alias(k) for k in kinds]
    out = d.groupBy("cui").agg(F.array_sort(F.collect_set(F.when(F.col("tty") == "PN", F.col("term")))).alias("preferred"), *sets)
    out = out.withColumn("title", T.best_title(*(F.col(c) for c in ("preferred", "title_main", "title_en", "title_fr", "title_es"))))
    return out.where(F.greatest(*(F.size(k) for k in ("preferred", *kinds))) > 0).select("cui", *kinds, "title")


def melt_names(titles: DataFrame) -> DataFrame:
    """(cui, title, lang, syn, is_main) of all titles and aliases; only main titles are main. Lists are exploded one by one."""
    lists = [("title_main", None, True), *((f"{k}_{x}", x, False) for k in ("title", "alias") for x in ("fr", "en", "es"))]
    tagged = F.array(*(F.struct(F.lit(lang).cast("string").alias("lang"), F.lit(main).alias("is_main"), F.col(c).alias("names")) for c, lang, main in lists))
    d = titles.select("cui", "title", F.explode(tagged).alias("x"))
    return d.select("cui", "title", "x.lang", F.explode("x.names").alias("syn"), "x.is_main").where("syn <> ''")


def clean_names(df: DataFrame, columns: tuple[str, ...] = ("syn", "title")) -> DataFrame:
    return df.withColumns({c: T.capitalize_first(T.strip_unspecified(F.col(c))) for c in columns})


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key, by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")



def name_order() -> list[Column]:
    return [F.desc("is_main"), F.asc_nulls_last("lang"), F.asc_nulls_last("sem_name"), F.asc_nulls_last("title"), F.asc_nulls_last("code")]


def distinct_codes(df: DataFrame, keys: list[str], code: str = "code") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct(code).alias("__codes"))


def disambiguate(names: DataFrame) -> DataFrame:
    """Rows (code, title, entity, sem_name, category, grp, is_main, lang) with ambiguous_level 0, 1 or 2.

    0: the name has one code in its group. 1: one code is left after codes with a level-0 name are removed. 2: of codes
    without any such name, the least. Titles that are no name are added, and names in capitals that differ from another
    name of the code only by case are dropped.
    """
    key = ["entity", "grp"]
    # each step reads the one before it several times, so it is written once
    counted = materialize(names.join(distinct_codes(names, key), key), "names")
    zero = counted.where("__codes = 1").drop("__codes").withColumn("ambiguous_level", F.lit(0))
    rest = materialize(counted.where("__codes > 1").drop("__codes").join(zero.select("code").distinct(), "code", "left_anti"), "names")
    rest = rest.join(distinct_codes(rest, key), key)
    one = rest.where("__codes = 1").drop("__codes").withColumn("ambiguous_level", F.lit(1))
    left = rest.where("__codes > 1").drop("__codes").join(one.select("code").distinct(), "code", "left_anti")
    two = keep_first(left, key, [F.col("code"), *name_order()]).withColumn("ambiguous_level", F.lit(2))
    cols = ["code", "title", "entity", "sem_name", "category", "grp", "is_main", "lang", "ambiguous_level"]
    out = materialize(reduce(DataFrame.unionByName, (d.select(cols) for d in (zero, one, two))), "names")
    return drop_capitals(add_titles(out)).select(cols)


def add_titles(names: DataFrame) -> DataFrame:
    """names and a main row of level 0 for each title that no name equals."""
    titles = names.select("code", "title", "sem_name", "category", "grp").where(F.col("title").isNotNull()).distinct()
    known = names.select(F.col("entity").alias("title")).distinct()
    extra = titles.join(known, "title", "left_anti").select("*", F.col("title").alias("entity"), F.lit(True).alias("is_main"), F.lit(0).alias("ambiguous_level"))
    return names.unionByName(extra, allowMissingColumns=True)


def drop_capitals(names: DataFrame) -> DataFrame:
    """names without those all in capitals of which the code has another spelling."""
    caps = F.col("entity") == F.upper("entity")
    spelled = names.where(~caps).select("code", F.lower("entity").alias("__norm")).distinct().withColumn("__other", F.lit(True))
    d = names.withColumn("__norm", F.lower("entity")).join(spelled, ["code", "__norm"], "left")
    return d.where(~(caps & F.coalesce("__other", F.lit(False)))).drop("__norm", "__other")


def prepare_by_tree(codes_: DataFrame, titles: DataFrame, types: DataFrame) -> DataFrame:
    """The first terminology: types whose tree code has a listed beginning, named after it."""
    base = types.where(T.has_prefix(F.col("tree_code"))).withColumn("sem_name", T.prefix_class(F.col("tree_code")))
    return _prepare(codes_, titles, base)


def prepare_by_category(codes_: DataFrame, titles: DataFrame, types: DataFrame, categories=T.CATEGORIES) -> DataFrame:
    """The second terminology: types of the listed categories."""
    return _prepare(codes_, titles, types.where(F.col("category").isin(*categories)))


def _prepare(codes_: DataFrame, titles: DataFrame, types: DataFrame) -> DataFrame:
    base = types.select("cui", "sem_name", "category", "grp").distinct().join(codes_.select("cui").distinct(), "cui", "left_semi")
    d = clean_names(melt_names(titles).join(base, "cui"))
    d = d.select(F.col("cui").alias("code"), "title", F.col("syn").alias("entity"), "sem_name", "category", "grp", "is_main", "lang")
    return disambiguate(keep_first(d, ["code", "entity", "grp"], name_order()))


def priority_pairs(annotations: list[DataFrame]) -> DataFrame:
    """Distinct (code, grp) of annotated corpora, composites split, NO_CODE left out."""
    d = reduce(DataFrame.unionByName, (a.select("code", "grp") for a in annotations))
    d = d.select(F.explode(F.split("code", r"\+")).alias("code"), "grp").select(T.strip(F.col("code")).alias("code"), "grp")
    return d.where((F.col("code") != "NO_CODE") & (F.col("code") != "")).distinct()


def terminology(raw: DataFrame) -> DataFrame:
    """Second source to the common shape: the tag is the group, its first four characters the category."""
    d = raw.where(F.col("code").isNotNull() & (F.col("code") != "NO_CODE"))
    return d.select("code", F.col("cui").alias("umls_cui"), F.col("term").alias("entity"), F.col("semantic_tag").alias("grp"), F.substring("semantic_tag", 1, 4).alias("category"), F.col("mainterm").cast("boolean").alias("is_main"))


def missing_pairs(names: DataFrame, priority: DataFrame) -> DataFrame:
    """Priority pairs that no name has."""
    return priority.select("code", "grp").distinct().join(names.select("code", "grp").distinct(), ["code", "grp"], "left_anti")


def augment_missing(names: DataFrame, missing: DataFrame) -> DataFrame:
    """names and, for each missing pair, the code's first row (main first) under the missing group."""
    first = keep_first(names, ["code"], [F.desc("is_main"), "entity", "grp"]).drop("grp")
    extra = missing.join(first, "code").where(F.col("entity").isNotNull())
    return names.unionByName(extra.withColumn("category", F.substring("grp", 1, 4)), allowMissingColumns=True)


def complete_combinations(names: DataFrame) -> DataFrame:
    """Every name of a code in every group of the code; columns that a new row lacks are filled from the row of the code before it, else after."""
    pairs = names.select("code", "entity").distinct().join(names.select("code", "grp").distinct(), "code")
    once = keep_first(names, ["code", "entity", "grp"], [F.desc("is_main"), F.asc_nulls_last("category")])
    d = pairs.join(once, ["code", "entity", "grp"], "left")
    back = Window.partitionBy("code").orderBy("entity", "grp").rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("code").orderBy("entity", "grp").rowsBetween(0, Window.unboundedFollowing)
    rest = [c for c in names.columns if c not in ("code", "entity", "grp")]
    return d.withColumns({c: F.coalesce(F.last(c, True).over(back), F.first(c, True).over(on)) for c in rest}).select(names.columns).distinct()


def resolve_by_priority(names: DataFrame, priority: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names with one code each, mapping from codes given up to those chosen).

    Levels 0 and 1 as in disambiguate(), by (code, grp); of what is left, each unresolved name takes a priority pair first,
    then the least code.
    """
    key, pair = ["entity", "grp"], ["code", "grp"]
    counted = materialize(names.join(distinct_codes(names, key), key), "names")
    zero = counted.where("__codes = 1").drop("__codes").withColumn("ambiguous_level", F.lit(0))
    rest = materialize(counted.where("__codes > 1").drop("__codes").join(zero.select(pair).distinct(), pair, "left_anti"), "names")
    rest = rest.join(distinct_codes(rest, key), key)
    one = rest.where("__codes = 1").drop("__codes").withColumn("ambiguous_level", F.lit(1))
    done = materialize(zero.unionByName(one), "names")
    left = names.join(done.select(key).distinct(), key, "left_anti")
    first = priority.select(*pair).distinct().withColumn("__first", F.lit(True))
    left = left.join(first, pair, "left").withColumn("__first", F.coalesce("__first", F.lit(False)))
    order = [F.desc("__first"), F.col("code"), *(F.asc_nulls_last(c) for c in names.columns if c not in ("entity", "grp", "code"))]
    two = keep_first(left, key, order).drop("__first").withColumn("ambiguous_level", F.lit(2))
    clean = done.unionByName(two)
    chosen = clean.select("entity", "grp", F.col("code").alias("chosen_code"))
    mapping = names.select("entity", "grp", "code").join(chosen, key).where("code <> chosen_code").select("code", "chosen_code").distinct()
    return clean, mapping


def build_with_priorities(raw: DataFrame, annotations: list[DataFrame], full_names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The second terminology from end to end: load, cover, complete, resolve, and enrich with full names."""
    pairs = priority_pairs(annotations)
    names = terminology(raw)
    names = complete_combinations(augment_missing(names, missing_pairs(names, pairs)))
    clean, mapping = resolve_by_priority(names, pairs)
    lost = missing_pairs(clean, pairs)
    mapping = mapping.join(lost.select("code").distinct(), "code", "left_semi")
    if full_names is not None:
        clean = clean.join(full_names, "code", "left").distinct()
    return clean, mapping


def mappings(names: DataFrame, lang: str) -> DataFrame:
    """One row a code: title, synonyms (of lang if there are any, else of all) and groups, sorted."""
    own = F.array_sort(F.collect_set(F.when(F.col("lang") == lang, F.col("entity"))))
    d = names.groupBy("code").agg(F.min("title").alias("title"), own.alias("own"), F.array_sort(F.collect_set("entity")).alias("all"), F.array_sort(F.collect_set("grp")).alias("groups"))
    return d.select("code", "title", F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("all")).alias("synonyms"), "groups")


def text_to_code(names: DataFrame, ordinal: str) -> DataFrame:
    """(grp, entity, code): the last code of each cleaned name."""
    return names.groupBy("grp", T.clean_natural(F.col("entity")).alias("entity")).agg(F.max_by("code", ordinal).alias("code"))
