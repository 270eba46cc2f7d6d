"""Coverage of named conditions over the bound results, and its SQL, written apart from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evidentia.functions.conditions import SUITES, WHOSE
from evidentia.operators.coverage import chunks_recording, joint_coverage, matching_results

from .bindings import PROFILES_SQL, profiles
from .catalogue import query

#: Requests (id, model, dataset, language): held together under other names, held apart, not held, and of one condition.
REQUESTS = [
    (1, "economy-base", "Brand#11", "NATION_1"),
    (2, "our Promo", "brand 5", "NATION_21 to NATION_7"),
    (3, "PROMO", "Brand#12", "NATION_3"),
    (4, "NO SUCH MODEL", "Brand#12", "NATION_2"),
    (5, "LARGE", "Corpus#99", None),
    (6, "SMALL", None, None),
]


def _texts() -> str:
    quoted = lambda v: "NULL" if v is None else f"'{v}'"
    return ", ".join(f"({i}, {quoted(m)}, {quoted(d)}, {quoted(n)})" for i, m, d, n in REQUESTS)


def _key(x: str) -> str:
    return f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]', '', 'g')"


def _language(x: str) -> str:
    from .scalars import LANGUAGES

    return f"CASE {x} {' '.join(f"WHEN '{code}' THEN '{name}'" for code, name in LANGUAGES.items())} ELSE {x} END"


def _core(x: str) -> str:
    """A list of family and size of a model's name."""
    from .scalars import DECOR, SIZES

    own = "|".join(w.replace(".", "[.]") for w in WHOSE)
    stripped = f"regexp_replace({x}, '(?i)^\\s*(?:{own})[\\s:(-]+', '')"
    bare = f"trim(CASE WHEN length({_key(stripped)}) >= 2 THEN {stripped} ELSE {x} END)"
    number = "(?i)^(.*?[a-z].*?)[\\s_-]*([0-9]+(?:[.][0-9]+)?\\s?[mbk])\\s*$"
    counted = f"length({_key(f"regexp_extract({bare}, '{number}', 1)")}) >= 2"
    k = _key(f"CASE WHEN {counted} THEN regexp_extract({bare}, '{number}', 1) ELSE {bare} END")
    label = f"regexp_extract({k}, '^.+?({'|'.join(SIZES)})(?:{'|'.join(DECOR)})*$', 1)"
    size = f"CASE WHEN {label} <> '' THEN {label} WHEN {counted} THEN lower(regexp_replace(regexp_extract({bare}, '{number}', 2), '\\s', '', 'g')) END"
    return f"[regexp_extract({k}, '^(.+?)(?:{'|'.join((*SIZES, *DECOR))})*$', 1), {size}]"


#: (request_id, model or dataset or language, held): requested values against the distinct recorded ones.
_SUITES = ", ".join(f"('{s}', '{m}')" for s, ms in SUITES.items() for m in ms)
_HELD = f"""
p AS ({PROFILES_SQL}), asked(request_id, r_model, r_dataset, r_language) AS (VALUES {_texts()}),
parts(suite, part) AS (VALUES {_SUITES}),
models AS (SELECT request_id, model FROM (SELECT *, {_core('r_model')} AS r, {_core('model')} AS o FROM asked CROSS JOIN (SELECT DISTINCT model FROM p WHERE model <> '') t) u
  WHERE r_model <> '' AND r[1] = o[1] AND (r[2] IS NULL OR o[2] IS NULL OR r[2] = o[2])),
datasets AS (SELECT request_id, dataset FROM (SELECT *, {_key('r_dataset')} AS r, {_key('dataset')} AS o FROM asked CROSS JOIN (SELECT DISTINCT dataset FROM p WHERE dataset <> '') t) u
  WHERE r_dataset <> '' AND (least(length(r), length(o)) >= 3 AND (left(o, length(r)) = r OR left(r, length(o)) = o)
     OR EXISTS (SELECT 1 FROM parts WHERE suite = r AND o <> r AND (o = part OR length(part) >= 4 AND left(o, length(part)) = part)))),
languages AS (SELECT request_id, language FROM (SELECT *, {_language(_key('language'))} AS o, list_filter(regexp_split_to_array(lower(trim(r_language)), '\\s*(?:-to-|\\bto\\b|->|[→–—/-])\\s*'), lambda x: x <> '') AS pair
  FROM asked CROSS JOIN (SELECT DISTINCT language FROM p WHERE language <> '') t) u
  WHERE r_language <> '' AND ({_language(_key('r_language'))} = o OR len(pair) = 2 AND ({_language(_key('pair[1]'))} = o OR {_language(_key('pair[2]'))} = o))),
met AS (SELECT a.*, p.*, m.model IS NOT NULL AS hm, d.dataset IS NOT NULL AS hd, l.language IS NOT NULL AS hl
  FROM asked a CROSS JOIN p LEFT JOIN models m ON m.request_id = a.request_id AND m.model = p.model LEFT JOIN datasets d ON d.request_id = a.request_id AND d.dataset = p.dataset
  LEFT JOIN languages l ON l.request_id = a.request_id AND l.language = p.language)"""
_FULL = "(hm OR r_model IS NULL) AND (hd OR r_dataset IS NULL) AND (hl OR r_language IS NULL)"


@query(
    "joint_coverage",
    f"""
WITH {_HELD}, per AS (
  SELECT request_id, (r_model IS NOT NULL)::int + (r_dataset IS NOT NULL)::int + (r_language IS NOT NULL)::int AS n, bool_or({_FULL}) AS whole,
         CASE WHEN r_model IS NOT NULL THEN bool_or(hm) END AS has_model, CASE WHEN r_dataset IS NOT NULL THEN bool_or(hd) END AS has_dataset, CASE WHEN r_language IS NOT NULL THEN bool_or(hl) END AS has_language,
         r_language IS NOT NULL AND bool_or((hm OR r_model IS NULL) AND (hd OR r_dataset IS NULL)) AS no_language, r_dataset IS NOT NULL AND bool_or((hm OR r_model IS NULL) AND (hl OR r_language IS NULL)) AS no_dataset,
         r_model IS NOT NULL AND bool_or((hd OR r_dataset IS NULL) AND (hl OR r_language IS NULL)) AS no_model
  FROM met GROUP BY request_id, r_model, r_dataset, r_language),
verdict AS (SELECT *, CASE WHEN n < 2 OR whole THEN NULL WHEN no_language THEN 'language' WHEN no_dataset THEN 'dataset' WHEN no_model THEN 'model' ELSE 'all' END AS blamed FROM per)
SELECT request_id, CASE WHEN n >= 2 THEN whole END AS joint, has_model, has_dataset, has_language, blamed,
       CASE WHEN n < 2 OR whole THEN coalesce(has_model::int, 0) + coalesce(has_dataset::int, 0) + coalesce(has_language::int, 0) WHEN blamed = 'all' THEN 0 ELSE n - 1 END AS n_covered
FROM verdict
""",
)
def _joint_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joint_coverage(profiles(spark, sf_dir), REQUESTS)


@query("profiles_matching", f"WITH {_HELD} SELECT request_id, profile_id, value FROM met WHERE {_FULL}")
def _profiles_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching_results(profiles(spark, sf_dir), REQUESTS).select("request_id", "profile_id", "value")


@query(
    "chunks_recording",
    f"""
WITH {_HELD}, per AS (SELECT request_id, chunk_id, count(*) AS n FROM met WHERE hl GROUP BY request_id, chunk_id HAVING bool_or({_FULL})),
top AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY n DESC, chunk_id) AS k FROM per)
SELECT request_id, chunk_id, n, k FROM top WHERE k <= 4""",
)
def _chunks_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks_recording(profiles(spark, sf_dir), REQUESTS)
