"""Conditions of a reported result as column expressions: names, sizes, languages, settings, and when one covers another.

Everything is built-in functions on columns, so a predicate can stand in a filter, a join or an aggregate's flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evidentia.plans.scalars import DECOR, LANGUAGES, SETTING_TAGS, SIZES

#: Words before a model's name that say whose it is.
WHOSE = ("google", "our", "ours", "published", "baseline", "vanilla", "original", "proposed", "avg", "avg.", "average")
#: Short and verbal names of tasks.
TASKS = {
    "nli": "naturallanguageinference", "qa": "questionanswering", "ner": "namedentityrecognition", "mt": "machinetranslation", "mrc": "readingcomprehension", "sts": "semantictextualsimilarity",
    "pos": "partofspeechtagging", "rte": "recognizingtextualentailment", "translating": "translation", "translate": "translation", "summarizing": "summarization", "summarising": "summarization",
    "classifying": "classification",
}
#: Datasets that make up a suite.
SUITES = {
    "glue": ("cola", "sst2", "mrpc", "stsb", "qqp", "mnli", "qnli", "rte", "wnli", "diagnostic"),
    "superglue": ("boolq", "cb", "copa", "multirc", "record", "rte", "wic", "wsc"),
    "xtreme": ("xnli", "pawsx", "panx", "wikiann", "udpos", "xquad", "mlqa", "tydiqa", "bucc", "tatoeba"),
    "indicxtreme": ("indicxnli", "indiccopa", "indicsentiment", "indicxpara", "indicqa", "indicner", "indicxquad", "flores"),
}
#: What parts the two languages of a pair.
BETWEEN = r"\s*(?:-to-|\bto\b|->|[→–—/-])\s*"


def key(text: Column) -> Column:
    """Lower-cased letters and digits of ASCII; empty for null."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")


def _quoted(names) -> str:
    return ", ".join(f"'{n}'" for n in names)


def named(names: dict[str, str], k: Column) -> Column:
    """The full name behind a short one; other keys stay."""
    return F.coalesce(F.try_element_at(F.expr(f"map({', '.join(_quoted(x) for x in names.items())})"), k), k)


def params(text: Column) -> Column:
    """Parameter count in millions from a number with a unit, else null."""
    pattern, low = r"([0-9]+(?:\.[0-9]+)?)\s*(million|billion|k|m|b)\b", F.lower(text)
    unit = F.regexp_extract(low, pattern, 2)
    scale = F.when(unit == "k", 0.001).when(unit.isin("b", "billion"), 1000.0).otherwise(1.0)
    return F.nullif(F.regexp_extract(low, pattern, 1), F.lit("")).try_cast("double") * scale


def model_core(text: Column) -> tuple[Column, Column]:
    """(family, size) of a model's name: without a word that says whose it is, the words that decorate its end, and a
    trailing parameter count, which is the size unless a word such as large is."""
    said = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    bare = F.regexp_replace(said, rf"^\s*(?:{'|'.join(w.replace('.', '[.]') for w in WHOSE)})[\s:(-]+", "")
    bare = F.when(F.length(key(bare)) >= 2, bare).otherwise(said)
    counted = r"^(.*[a-z].*?)[\s_-]*([0-9]+(?:\.[0-9]+)?\s?[mbk])\s*$"
    name = F.regexp_extract(bare, counted, 1)
    has = F.length(key(name)) >= 2
    k = key(F.when(has, name).otherwise(bare))
    words = "|".join((*SIZES, *DECOR))
    label = F.regexp_extract(k, rf"^.+?({'|'.join(SIZES)})(?:{'|'.join(DECOR)})*$", 1)
    size = F.when(label != "", label).when(has, F.regexp_replace(F.regexp_extract(bare, counted, 2), r"\s", ""))
    return F.regexp_extract(k, f"^(.+?)(?:{words})*$", 1), size


def version(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"^v(?:ersion)?\s*", "")


def setting_tags(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(t)) for t, p in SETTING_TAGS.items()]))


def language_pair(text: Column) -> Column:
    """Keys of the two languages of a pair in full; empty if the text names no pair."""
    parts = F.filter(F.split(F.lower(F.trim(text)), BETWEEN), lambda x: x != "")
    return F.when(F.size(parts) == 2, F.transform(parts, lambda x: named(LANGUAGES, key(x)))).otherwise(F.array().cast("array<string>"))


def in_suite(requested: Column, observed: Column) -> Column:
    """Is the observed dataset a part of the requested suite? Parts of four characters or more may go on (mnli-m)."""
    return _part_of(key(requested), key(observed))


def _part_of(r: Column, o: Column) -> Column:
    suites = F.expr(f"map({', '.join(f"'{suite}', array({_quoted(members)})" for suite, members in SUITES.items())})")
    part = lambda m: (o == m) | ((F.length(m) >= 4) & F.startswith(o, m))
    return (r != o) & F.coalesce(F.exists(F.try_element_at(suites, r), part), F.lit(False))


def _contains(a: Column, b: Column) -> Column:
    return ((a != "") & (a == b)) | ((F.length(a) >= 4) & (F.length(b) >= 4) & (F.contains(a, b) | F.contains(b, a)))


def features(field: str, text: Column) -> Column:
    """What a value is compared by, as a struct: worked out once a value, however many others it meets.

    field: model, dataset, dataset_version, language, model_size, setting or task; others are compared by their keys.
    """
    k = key(text)
    if field == "model":
        family, size = model_core(text)
        own = [family.alias("family"), size.alias("size")]
    elif field == "dataset_version":
        own = [version(text).alias("said"), version(text).try_cast("double").alias("number")]
    elif field == "language":
        own = [named(LANGUAGES, k).alias("name"), language_pair(text).alias("pair")]
    elif field == "model_size":
        own = [k.alias("key"), params(text).alias("millions")]
    elif field == "setting":
        tags = setting_tags(text)
        # A recorded cross-lingual transfer is zero-shot unless it says that something was translated.
        transfer = F.lower(text).rlike("cross[- ]?lingual transfer") & ~F.arrays_overlap(tags, F.array(F.lit("translate-train"), F.lit("translate-test")))
        own = [k.alias("key"), tags.alias("tags"), F.when(transfer, F.array_union(tags, F.array(F.lit("zero-shot")))).otherwise(tags).alias("recorded")]
    else:
        own = [(named(TASKS, k) if field == "task" else k).alias("key")]
    return F.struct((F.coalesce(text, F.lit("")) != "").alias("given"), *own)


def _model(r: Column, o: Column) -> Column:
    return (r["family"] == o["family"]) & (r["size"].isNull() | o["size"].isNull() | (r["size"] == o["size"]))


def _dataset(r: Column, o: Column) -> Column:
    a, b = r["key"], o["key"]
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (F.startswith(a, b) | F.startswith(b, a))


def _size(r: Column, o: Column) -> Column:
    a, b = r["millions"], o["millions"]
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= 0.05 * F.greatest(a, b)).otherwise(r["key"] == o["key"])


def _setting(r: Column, o: Column) -> Column:
    a, b = r["tags"], o["recorded"]
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_except(a, b)) == 0).otherwise(_contains(r["key"], o["key"]))


_MATCH = {
    "model": _model,
    "dataset": _dataset,
    "dataset_version": lambda r, o: (r["said"] == o["said"]) | F.coalesce(r["number"] == o["number"], F.lit(False)),
    "language": lambda r, o: (r["name"] == o["name"]) | F.array_contains(r["pair"], o["name"]),
    "model_size": _size,
    "setting": _setting,
}


def agree(field: str, r: Column, o: Column, suites: bool = True) -> Column:
    """Do the features of an observed value satisfy those of a requested one? Never null: a missing value satisfies
    nothing and isn't satisfied. With ``suites``, a requested suite is also covered by results on its parts."""
    test = _MATCH.get(field, lambda a, b: _contains(a["key"], b["key"]))(r, o)
    if field == "dataset" and suites:
        test = test | _part_of(r["key"], o["key"])
    return F.coalesce(r["given"] & o["given"] & test, F.lit(False))


def values_match(field: str, requested: Column, observed: Column) -> Column:
    """Does an observed value satisfy a requested one?"""
    return agree(field, features(field, requested), features(field, observed), suites=False)


def covers(field: str, requested: Column, observed: Column) -> Column:
    """``values_match``; a requested suite is also covered by results on its parts."""
    return agree(field, features(field, requested), features(field, observed))
