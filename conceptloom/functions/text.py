"""Scalar functions on codes, names, prompts and labels. All are column expressions; nothing leaves the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings that say "not otherwise specified", in the order in which they are cut.
UNSPECIFIED = (r"\s*\(NOS\)\s*$", r",\sNOS\s*$", r"\sNOS\s*$", r"\s*\(SAI\)\s*$", r",\sSAI\s*$", r"\sSAI\s*$")
#: Beginnings of tree codes, in order, and the names they stand for.
TREE_NAMES = {
    "A1.1.4": "Virus",
    "A1.1.2": "Bacterium",
    "A1.2": "Anatomical Structure",
    "A2.1.4.1": "Body System",
    "A1.4.2": "Body Substance",
    "A2.2": "Finding",
    "B2.3": "Injury or Poisoning",
    "B2.2.1": "Biologic Function",
    "B1.3.1": "Health Care Activity",
    "B1.3.2": "Research Activity",
    "A1.3.1": "Medical Device",
    "A2.1.5": "Spatial Concept",
    "A2.6.1": "Biomedical Occupation or Discipline",
    "A2.7": "Organization",
    "A2.9.1": "Professional or Occupational Group",
    "A2.9.2": "Population Group",
    "A1.4.1": "Chemical",
    "A1.4.3": "Food",
    "A2.4": "Intellectual Product",
    "A2.3.1": "Clinical Attribute",
    "A1.1.3": "Eukaryote",
}
#: Categories of the second terminology.
CATEGORIES = ("ANAT", "CHEM", "DEVI", "DISO", "GEOG", "LIVB", "OBJC", "PHEN", "PHYS", "PROC")
#: Labels of the relation judge.
RELATIONS = ("NO_RELATION", "EXACT", "BROAD", "NARROW")
#: Context formats without and with running memory.
SHORT_FORMATS = ("short", "hybrid_medium")
MEMORY_FORMATS = ("hybrid_short", "hybrid_short_v2", "hybrid_long", "hybrid_long_v2")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


#: White space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def rstrip(c: Column) -> Column:
    # a pattern would look at every character of a document
    return F.rtrim(c, F.lit(WHITE))


def normalize_codes(c: Column) -> Column:
    """Composite codes in one order: split at +, trimmed, sorted, joined."""
    return F.array_join(F.array_sort(F.transform(F.split(c, r"\+"), strip)), "+")


def clean_natural(c: Column) -> Column:
    """Brackets, braces, hard spaces and newlines replaced one for one, so that offsets stay."""
    return F.translate(c, "\u00a0{}[]\n", " ()() ")


def strip_unspecified(c: Column) -> Column:
    return reduce(lambda x, p: F.regexp_replace(x, p, ""), UNSPECIFIED, F.replace(c, F.lit("\u00a0"), F.lit(" ")))


def capitalize_first(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return F.when(F.lower(first) == first, F.concat(F.upper(first), F.substr(c, F.lit(2)))).otherwise(c)


def prefix_class(c: Column, names: dict[str, str] = TREE_NAMES) -> Column:
    """The name of the first beginning that fits, null if none does."""
    return F.coalesce(*(F.when(c.startswith(p), F.lit(n)) for p, n in names.items()))


def has_prefix(c: Column, prefixes=TREE_NAMES) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))


def title_score(x: Column) -> Column:
    """Length, a half less for a capital followed by lower case only; null is worst."""
    first, rest = F.substring(x, 1, 1), F.substr(x, F.lit(2))
    nice = (F.upper(first) == first) & (F.lower(rest) == rest)
    return F.when(x.isNull(), F.lit(1e9)).otherwise(F.length(x) - F.when(nice, F.lit(0.5)).otherwise(F.lit(0.0)))


def shortest_title(titles: Column) -> Column:
    """Of an array, the element of the least title_score, the first of equals."""
    scored = F.transform(titles, lambda x, i: F.struct(title_score(x).alias("s"), i.alias("i"), x.alias("x")))
    return F.array_min(scored)["x"]


def only(titles: Column) -> Column:
    return F.when(F.size(titles) == 1, titles[0])


def best_title(preferred: Column, main: Column, en: Column, fr: Column, es: Column) -> Column:
    """The first preferred title, else a single or the shortest main or English one, else a single French or Spanish one."""
    return F.coalesce(F.get(preferred, F.lit(0)), only(main), shortest_title(main), only(en), shortest_title(en), only(fr), only(es))


def trailing_number(c: Column) -> Column:
    """The number that ends an id; ids without one go last."""
    return F.coalesce(F.regexp_extract(c, r"(\d+)$", 1).try_cast("bigint"), F.lit(1_000_000_000))


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(" ")) + 1


def abbreviation_only(c: Column) -> Column:
    return c.rlike(r"^[A-Z0-9\-]{2,}$")


def abbreviation_inside(c: Column) -> Column:
    return c.rlike(r"\b[A-Z0-9\-]{2,}\b")


def percent(x: Column) -> Column:
    """A share as a percentage with one decimal; a half goes to the even digit."""
    return F.bround(x * F.lit(100.0), 1)


def ratio_text(part: Column, whole: Column) -> Column:
    """'12.3% (a/b)', '0% (0/0)' of nothing, and 'N/A' where the part is null."""
    some = F.concat(percent(F.try_divide(part.cast("double"), whole.cast("double"))).cast("string"), F.lit("% ("), part.cast("string"), F.lit("/"), whole.cast("string"), F.lit(")"))
    return F.when(part.isNull(), F.lit("N/A")).when(whole == 0, F.lit("0% (0/0)")).otherwise(some)


def recall_text(part: Column, whole: Column) -> Column:
    """'0.1234 (a/b)'; 0 of nothing."""
    return F.format_string("%.4f (%d/%d)", safe_divide(part, whole), part, whole)


def ratio_part(c: Column) -> Column:
    return F.regexp_extract(c, r"\((\d+)\s*/", 1).try_cast("bigint")


def safe_divide(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(F.lit(2.0) * p * r, p + r), F.lit(0.0))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(float(k)) + rank.cast("double"))


def confidence(log_probs: Column, special: Column | None = None) -> Column:
    """exp of the mean log-probability of an array, special positions (an array of booleans) left out."""
    kept = log_probs if special is None else F.transform(F.filter(F.arrays_zip(log_probs.alias("p"), special.alias("s")), lambda x: ~x["s"]), lambda x: x["p"])
    return F.exp(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.greatest(F.size(kept), F.lit(1)))


def beam_score(log_score: Column, beams: int) -> Column:
    return F.exp(log_score) if beams > 1 else F.lit(float("nan"))


def strip_special(c: Column, tokens=("<s>", "</s>", "<pad>", "<unk>", "<|begin_of_text|>", "<|end_of_text|>", "<|eot_id|>")) -> Column:
    """Without special tokens, and without the space after <+> and <SEP>."""
    c = reduce(lambda x, t: F.replace(x, F.lit(t), F.lit("")), tokens, c)
    return F.regexp_replace(c, r"(<\+>|<SEP>)\s+", "$1")


def predicted_name(output: Column) -> Column:
    """What follows the last '} ' of an output, NO_PREDICTION if nothing does."""
    parts = F.split(output, r"\} ")
    last = strip(F.element_at(parts, -1))
    return F.when((F.size(parts) > 1) & (last != ""), F.replace(last, F.lit("<SEP>"), F.lit(""))).otherwise(F.lit("NO_PREDICTION"))


def target_text(mention: Column, group: Column, name: Column, end: str = "") -> Column:
    return F.concat(F.lit("["), mention, F.lit("]{"), group, F.lit("} "), name, F.lit(end))


def target_fault(target: Column, context_format: str) -> Column:
    """Why training_prompt() would raise on a target, null if it would not: its last line needs exactly one closing brace."""
    if context_format == "long":
        return F.when(target.isNull(), F.lit("no target"))
    current = target if context_format in SHORT_FORMATS else F.element_at(F.filter(F.split(target, "\n"), lambda x: x != ""), -1)
    braces = F.size(F.split(current, r"\}")) - 1
    return F.when(current.isNull(), F.lit("no target")).when(braces != 1, F.concat(braces.cast("string"), F.lit(" closing braces")))


def training_prompt(source: Column, target: Column, context_format: str) -> Column:
    """struct(prompt, completion) of a training row; a target without exactly one closing brace raises when it is run."""
    head = F.concat(F.lit("### Context\n"), rstrip(source), F.lit("\n\n"))
    if context_format == "long":
        return F.struct(head.alias("prompt"), F.concat(F.lit("### Predictions\n"), rstrip(target)).alias("completion"))
    lines = F.filter(F.split(target, "\n"), lambda x: x != "")
    current = target if context_format in SHORT_FORMATS else F.element_at(lines, -1)
    parts = F.split(current, r"\}")
    ok = F.size(parts) == 2
    opening = F.when(ok, F.concat(parts[0], F.lit("}"))).otherwise(F.raise_error(F.concat(F.lit("unexpected target: "), F.coalesce(target, F.lit("null")))).cast("string"))
    done = F.when(ok, rstrip(F.get(parts, F.lit(1))))
    if context_format in SHORT_FORMATS:
        return F.struct(F.concat(head, F.lit("### Prediction\n"), opening).alias("prompt"), done.alias("completion"))
    if context_format in MEMORY_FORMATS:
        before = F.when(F.size(lines) >= 2, F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), "\n")).otherwise(F.lit("None"))
        return F.struct(F.concat(head, F.lit("### Previous Normalizations\n"), rstrip(before), F.lit("\n\n### Prediction\n"), opening).alias("prompt"), done.alias("completion"))
    raise ValueError(f"unknown context format {context_format}")


def inference_prompt(source: Column, target: Column, previous: Column, context_format: str) -> Column:
    head = F.concat(F.lit("### Context\n"), rstrip(source))
    if context_format == "long":
        return F.concat(head, F.lit("\n\n### Predictions\n"), previous, rstrip(target))
    if context_format in SHORT_FORMATS:
        return F.concat(head, F.lit("\n\n### Prediction\n"), rstrip(target))
    if context_format in MEMORY_FORMATS:
        before = F.when(F.coalesce(previous, F.lit("")) == "", F.lit("None")).otherwise(rstrip(previous))
        return F.concat(head, F.lit("\n\n### Previous Normalizations\n"), before, F.lit("\n\n### Prediction\n"), rstrip(target))
    raise ValueError(f"unknown context format {context_format}")


def judge_label(raw: Column, pred_text: Column | None = None, pred_code: Column | None = None) -> Column:
    """The relation in a judge's JSON answer; anything else, and empty predictions, are NO_RELATION."""
    label = F.upper(F.get_json_object(raw, "$.label"))
    known = F.when(label.isin(*RELATIONS), label).otherwise(F.lit("NO_RELATION"))
    for c in (pred_text, pred_code):
        if c is not None:
            known = F.when(F.coalesce(c, F.lit("")) == "", F.lit("NO_RELATION")).otherwise(known)
    return known


def dataset_language(c: Column) -> Column:
    """Language of a corpus by its name."""
    return F.when(c.rlike("(?i)mm|medmentions"), "en").when(c.rlike("(?i)emea|medline|quaero"), "fr").when(c.rlike("(?i)spaccc|sympt|distemist|medproc"), "es")


#: Corpora and their short names.
DATASET_NAMES = {"MedMentions": "MM", "QUAERO_EMEA": "EMEA", "QUAERO_MEDLINE": "MEDLINE", "SPACCC": "SPACCC"}
#: Labels and what figures call them.
LABEL_NAMES = {
    "overall": "Overall",
    "ENFERMEDAD": "Disease",
    "SINTOMA": "Symptom",
    "PROCEDIMIENTO": "Procedure",
    "Organizations": "Orgs.",
    "Geographic Areas": "Geo. Areas",
    "Concepts & Ideas": "Concepts",
    "Genes & Molecular Sequences": "Genes & Mol.",
    "Living Beings": "Organisms",
    "Chemicals & Drugs": "Chem. & Drugs",
}
#: Kinds of training data in the names of runs, the first that fits.
AUGMENTATIONS = ("human_only_ft", "full_upsampled", "human_only")


def renamed(c: Column, names: dict[str, str] = LABEL_NAMES) -> Column:
    """The name that stands for a value, or the value itself."""
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in names.items() for x in kv)), c), c)


def selected(options: list[str] | None, known: list[str]) -> list[str]:
    """The options that are known, in their own order; all that are known if there is no option."""
    return [x for x in options if x in known] if options else list(known)


def run_id_parts(c: Column, augmentations: tuple[str, ...] = AUGMENTATIONS) -> Column:
    """struct(model_name, aug_data, context_format, constraint, checkpoint, base_run) of a run's name; null if it is none.

    A name is model_augmentation_context[_complete][_addheaders]_(no_constraint|constraint)_(best|last).
    """
    tail = r"_(no_constraint|constraint)_(best|last)$"
    constraint, checkpoint = F.regexp_extract(c, tail, 1), F.regexp_extract(c, tail, 2)
    prefix = F.regexp_replace(c, tail, "")
    rest = F.regexp_extract(prefix, r"^[^_]*_(.*)$", 1)
    aug = F.coalesce(*(F.when(rest.startswith(f"{a}_"), F.lit(a)) for a in augmentations))
    context = F.regexp_replace(F.substr(rest, F.length(aug) + 2), "(_complete_addheaders|_addheaders|_complete)$", "")
    parts = F.struct(
        F.regexp_extract(prefix, r"^([^_]*)_", 1).alias("model_name"),
        aug.alias("aug_data"),
        context.alias("context_format"),
        constraint.alias("constraint"),
        checkpoint.alias("checkpoint"),
        F.substr(c, F.lit(1), F.length(c) - F.length(checkpoint) - 1).alias("base_run"),
    )
    return F.when((constraint != "") & prefix.contains("_") & aug.isNotNull(), parts)


def path_of(template: str, **parts: Column) -> Column:
    """A path template, such as "{dataset}/{model}_{checkpoint}.tsv", filled from columns; null parts give a null path."""
    import string

    pieces = []
    for literal, name, _, _ in string.Formatter().parse(template):
        pieces += [F.lit(literal)] if literal else []
        pieces += [parts[name].cast("string")] if name else []
    return F.concat(*pieces)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_")


def saliency_html(tokens: Column, scores: Column) -> Column:
    """Tokens as HTML spans shaded by scores in 0 to 1."""
    shade = lambda x: F.format_string('<span style="background-color: rgba(255,0,0,%.2f)">%s</span>', F.least(F.greatest(x["s"], F.lit(0.0)), F.lit(1.0)), x["t"])
    return F.array_join(F.transform(F.arrays_zip(tokens.alias("t"), scores.alias("s")), shade), "")
