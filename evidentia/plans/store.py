"""The store of result profiles: matching, overlay, cards, conflicts and their aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.operators.conflicts import first_pairs, fresh_pairs, mine_pairs, mined_kinds, mined_totals

from .bindings import profiles
from .catalogue import query
from .dialect import Duck, Spark, sql_query
from .scalars import NAMES, family, norm

_P = lambda d: f"SELECT * FROM ({d.profiles})"
_REQ = "SELECT * FROM (VALUES (1, 'PROMO', 'Brand#5', 'NATION_7'), (2, 'SMALL', 'Brand#23', 'NATION_1'), (3, 'LARGE', 'Brand#9', 'NATION_20'), (4, 'ECONOMY', 'Brand#99', 'NATION_2')) AS r(request_id, r_model, r_dataset, r_language)"

_PATCH = "SELECT profile_id, CASE WHEN model_size IS NULL THEN true ELSE false END AS has_language, CASE WHEN model_size IS NULL THEN NULL ELSE 'x' END AS new_language, setting = 'F' AS has_value, value / 10 AS new_value"
sql_query("overlay_read", lambda d: f"""
WITH p AS ({_P(d)}), patch AS ({_PATCH} FROM p WHERE metric = 'R')
SELECT p.profile_id, CASE WHEN coalesce(has_language, false) THEN new_language ELSE language END AS language, round(CASE WHEN coalesce(has_value, false) THEN new_value ELSE value END, 4) AS value, patch.profile_id IS NOT NULL AS repaired
FROM p LEFT JOIN patch ON p.profile_id = patch.profile_id""")
sql_query("overlay_stats", lambda d: f"""
WITH patch AS ({_PATCH}, language, value FROM ({d.profiles}) WHERE metric = 'R'),
rules AS (SELECT 'language' AS rule FROM patch WHERE has_language AND coalesce(language, '') <> coalesce(new_language, '') UNION ALL SELECT 'value' FROM patch WHERE has_value AND new_value <> value)
SELECT rule, count(*) AS n FROM rules GROUP BY rule""")
sql_query("profiles_for_chunks", lambda d: f"WITH p AS ({_P(d)}), wanted AS (SELECT DISTINCT chunk_id FROM p WHERE language = 'NATION_7') SELECT p.chunk_id, count(*) AS n, min(profile_id) AS first_id, md5({d.joined('profile_id', 'profile_id')}) AS ids FROM p JOIN wanted ON p.chunk_id = wanted.chunk_id GROUP BY p.chunk_id")
sql_query("upsert_profiles", lambda d: f"""
WITH p AS ({_P(d)}), all_rows AS (SELECT profile_id, value, 1 AS load FROM p UNION ALL SELECT profile_id, value + 1, 2 FROM p WHERE metric = 'A')
SELECT profile_id, round(value, 2) AS value, load FROM (SELECT *, row_number() OVER (PARTITION BY profile_id ORDER BY load DESC) AS k FROM all_rows) t WHERE k = 1""")
sql_query("delete_papers", lambda d: f"WITH p AS ({_P(d)}), gone AS (SELECT DISTINCT 'S' || CAST(s_suppkey AS varchar(30)) AS paper_id FROM supplier WHERE s_acctbal < 3000) SELECT paper_id, count(*) AS n FROM p WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.paper_id = p.paper_id) GROUP BY paper_id")
sql_query("replace_chunk", lambda d: f"WITH p AS ({_P(d)}), kept AS (SELECT profile_id, chunk_id FROM p WHERE chunk_id <> 'S7:1997' UNION ALL SELECT profile_id || '-new', chunk_id FROM p WHERE chunk_id = 'S7:1997' AND metric = 'N') SELECT chunk_id, count(*) AS n FROM kept GROUP BY chunk_id")
sql_query("unprocessed_papers", lambda d: "SELECT s_suppkey FROM supplier s WHERE NOT (EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity > 49) AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_returnflag = 'R' AND l_quantity = 1))")
sql_query("lookup_in_order", lambda d: "SELECT a.place AS position, p.p_partkey, p.p_name FROM (SELECT * FROM (VALUES (0, 77), (1, 5), (2, 999999), (3, 12), (4, 5)) AS v(place, id)) a JOIN part p ON p.p_partkey = a.id")
sql_query("row_counts", lambda d: f"WITH p AS ({_P(d)}) SELECT (SELECT count(*) FROM documents) AS n_chunks, (SELECT count(*) FROM p) AS n_profiles, (SELECT count(*) FROM supplier) AS n_papers, (SELECT count(*) FROM p WHERE metric = 'R') AS n_repairs")
sql_query("vocabulary", lambda d: f"WITH p AS ({_P(d)}) SELECT 'dataset' AS field, dataset AS value FROM p GROUP BY dataset UNION ALL SELECT 'model', model FROM p GROUP BY model UNION ALL SELECT 'language', language FROM p WHERE language IS NOT NULL GROUP BY language")
sql_query("fill_rates", lambda d: f"WITH p AS ({_P(d)}) SELECT round(100.0 * count(language) / count(*), 4) AS pct_language, round(100.0 * count(model_size) / count(*), 4) AS pct_size, count(DISTINCT dataset) AS n_datasets, count(DISTINCT model) AS n_models, count(*) - (SELECT count(*) FROM (SELECT DISTINCT paper_id, model, dataset, language, metric, setting, model_size FROM p) t) AS n_duplicates FROM p")
sql_query("dedupe_profiles", lambda d: f"SELECT profile_id FROM (SELECT profile_id, row_number() OVER (PARTITION BY paper_id, model, dataset, coalesce(language, '~'), metric, setting, coalesce(model_size, -1) ORDER BY profile_id) AS k FROM ({d.profiles})) t WHERE k = 1")
sql_query("paper_rows", lambda d: f"WITH p AS ({_P(d)}), c AS (SELECT paper_id, count(*) AS n_profiles, count(DISTINCT chunk_id) AS n_chunks FROM p GROUP BY paper_id) SELECT 'S' || CAST(s_suppkey AS varchar(30)) AS paper_id, s_name, coalesce(n_profiles, 0) AS n_profiles, coalesce(n_chunks, 0) AS n_chunks FROM supplier LEFT JOIN c ON c.paper_id = 'S' || CAST(s_suppkey AS varchar(30))")
sql_query("merge_stats", lambda d: f"SELECT o_orderpriority, count(*) AS calls, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS bigint) AS failed, md5({d.joined("CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey AS varchar(30)) END", 'o_orderkey')}) AS errors FROM orders GROUP BY o_orderpriority")
sql_query("size_family", lambda d: f"WITH w AS (SELECT {d.part(norm(d, 'model'), '^([a-z]+?)(?:small|medium|large|base)', 1)} AS word FROM ({NAMES})), n AS (SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY word) SELECT word, n FROM (SELECT *, row_number() OVER (ORDER BY n DESC, word) AS k FROM n) t WHERE k = 1 AND n >= 4")
_TOP = lambda d, field, k: f"""SELECT chunk_id, {d.joined(field, 'r')} AS {field}s FROM (SELECT chunk_id, {field}, row_number() OVER (PARTITION BY chunk_id ORDER BY count(*) DESC, min(profile_id)) AS r FROM p WHERE {field} IS NOT NULL GROUP BY chunk_id, {field}) t WHERE r <= {k} GROUP BY chunk_id"""
sql_query("build_cards", lambda d: f"""
WITH p AS ({_P(d)}), a AS ({_TOP(d, 'dataset', 6)}), b AS ({_TOP(d, 'language', 24)}), c AS ({_TOP(d, 'model', 14)})
SELECT a.chunk_id, substr('datasets: ' || datasets || '; languages: ' || coalesce(languages, '') || '; models: ' || models, 1, 700) AS card FROM a LEFT JOIN b ON a.chunk_id = b.chunk_id JOIN c ON a.chunk_id = c.chunk_id""")
sql_query("corpus_pivot", lambda d: f"""
WITH p AS ({_P(d)}), top AS (SELECT dataset FROM (SELECT dataset, row_number() OVER (ORDER BY count(*) DESC, dataset) AS k FROM p GROUP BY dataset) t WHERE k <= 10)
SELECT dataset, {", ".join(f"nullif(CAST(sum(CASE WHEN language = 'NATION_{i}' THEN 1 ELSE 0 END) AS bigint), 0) AS nation_{i}" for i in (0, 1, 2, 4, 7, 11))} FROM p WHERE dataset IN (SELECT dataset FROM top) GROUP BY dataset""")
_SUBJECT = lambda d: f"SELECT profile_id, paper_id, chunk_id, model, dataset, language, setting, model_size, metric, CAST(round(value * 100) AS bigint) AS cents FROM ({d.profiles})"
_PAIRS = lambda d: f"""
WITH s AS ({_SUBJECT(d)}), best AS (SELECT *, row_number() OVER (PARTITION BY paper_id, model, dataset, metric ORDER BY cents DESC, profile_id) AS hi, row_number() OVER (PARTITION BY paper_id, model, dataset, metric ORDER BY cents, profile_id) AS lo FROM s),
pairs AS (SELECT a.paper_id AS paper_a, b.paper_id AS paper_b, a.model, a.dataset, a.metric, a.profile_id AS profile_a, b.profile_id AS profile_b, a.cents AS cents_a, b.cents AS cents_b,
                 a.language AS language_a, b.language AS language_b, a.model_size AS size_a, b.model_size AS size_b, a.setting AS setting_a, b.setting AS setting_b,
                 abs(a.cents - b.cents) * 1.0 / greatest(abs(a.cents), abs(b.cents), 1) AS rel
          FROM best a JOIN best b ON a.model = b.model AND a.dataset = b.dataset AND a.metric = b.metric AND a.paper_id < b.paper_id AND ((a.hi = 1 AND b.lo = 1) OR (a.lo = 1 AND b.hi = 1))),
mined AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY paper_a, paper_b, model, dataset, metric ORDER BY rel DESC, profile_a, profile_b) AS k FROM pairs WHERE rel > 0.02) t WHERE k = 1)"""  # noqa: E731


def pair_query(name: str, rest: Callable[[Spark], str], plan: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A query over mined pairs: its SQL lists them by windows over all pairs of results; ``plan`` gives the same rows without listing them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if plan is not None:
            return plan(profiles(spark, sf_dir))
        return spark.sql("WITH mined AS (SELECT * FROM {pairs})" + rest(Spark()), pairs=mine_pairs(profiles(spark, sf_dir)))

    query(name, _PAIRS(Duck()) + rest(Duck()))(run)


def _report(p: DataFrame) -> DataFrame:
    best = first_pairs(p.filter("model = 'PROMO' AND dataset = 'Brand#5'"), 6)
    place = F.expr("row_number() OVER (PARTITION BY metric ORDER BY CASE verdict WHEN 'GENUINE' THEN 0 WHEN 'EXPLAINED' THEN 1 ELSE 2 END, rel DESC, paper_a, paper_b)")
    return best.select("metric", "verdict", "paper_a", "paper_b", place.alias("k"))


def _strata(p: DataFrame) -> DataFrame:
    stratum = F.expr("CASE WHEN large THEN 'genuine large' WHEN verdict = 'GENUINE' THEN 'genuine' WHEN verdict = 'NOT_COMPARABLE' THEN 'open' WHEN differing LIKE '%,%' THEN 'several' ELSE differing END")
    return mined_kinds(p).groupBy(stratum.alias("stratum")).agg(F.sum("n").alias("n"))


def _variants(p: DataFrame) -> DataFrame:
    verdicts = mined_kinds(p).groupBy("verdict").agg(F.sum("n").alias("n"))
    explains = F.expr("CASE WHEN one_sided AND verdict = 'NOT_COMPARABLE' THEN 'EXPLAINED' ELSE verdict END")
    switches = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(o).alias("one_sided")) for v, o in (("strict", False), ("one-sided explains", True))])
    return verdicts.select(F.inline(switches), "verdict", "n").groupBy("variant", explains.alias("verdict")).agg(F.sum("n").alias("n"))


pair_query("mine_pairs", lambda d: " SELECT model, dataset, metric, count(*) AS n_pairs, round(max(rel), 6) AS most, min(profile_a) AS first_a FROM mined GROUP BY model, dataset, metric", lambda p: mined_totals(p).withColumn("most", F.round("most", 6)))
#: Verdict of a pair: a condition recorded on both sides that differs explains it, one recorded on one side leaves it open.
_VERDICT = """CASE WHEN size_a <> size_b THEN 'EXPLAINED' WHEN language_a <> language_b THEN 'EXPLAINED' WHEN setting_a <> setting_b THEN 'EXPLAINED'
 WHEN (size_a IS NULL) <> (size_b IS NULL) OR (language_a IS NULL) <> (language_b IS NULL) THEN 'NOT_COMPARABLE' ELSE 'GENUINE' END"""
_DIFFERING = lambda d: d.text_of(d.where(d.array("CASE WHEN size_a <> size_b THEN 'model_size' END", "CASE WHEN language_a <> language_b THEN 'language' END", "CASE WHEN setting_a <> setting_b THEN 'setting' END"), "x", "x IS NOT NULL"))
pair_query("classify_pairs", lambda d: f" SELECT {_VERDICT} AS verdict, {_DIFFERING(d)} AS differing, count(*) AS n FROM mined GROUP BY 1, 2", lambda p: mined_kinds(p).groupBy("verdict", "differing").agg(F.sum("n").alias("n")))
pair_query("conflict_report", lambda d: f"""
, typed AS (SELECT *, {_VERDICT} AS verdict FROM mined WHERE model = 'PROMO' AND dataset = 'Brand#5')
SELECT metric, verdict, paper_a, paper_b, k FROM (SELECT metric, verdict, paper_a, paper_b, row_number() OVER (PARTITION BY metric ORDER BY CASE verdict WHEN 'GENUINE' THEN 0 WHEN 'EXPLAINED' THEN 1 ELSE 2 END, rel DESC, paper_a, paper_b) AS k FROM typed) t WHERE k <= 6""", _report)
pair_query("pair_strata", lambda d: f", typed AS (SELECT {_VERDICT} AS verdict, {_DIFFERING(d)} AS differing, rel FROM mined) SELECT CASE WHEN verdict = 'GENUINE' AND rel > 0.5 THEN 'genuine large' WHEN verdict = 'GENUINE' THEN 'genuine' WHEN verdict = 'NOT_COMPARABLE' THEN 'open' WHEN differing LIKE '%,%' THEN 'several' ELSE differing END AS stratum, count(*) AS n FROM typed GROUP BY 1", _strata)
pair_query("variant_replay", lambda d: f"""
, switches AS (SELECT * FROM (VALUES ('strict', false), ('one-sided explains', true)) AS s(variant, one_sided))
SELECT variant, CASE WHEN one_sided AND {_VERDICT} = 'NOT_COMPARABLE' THEN 'EXPLAINED' ELSE {_VERDICT} END AS verdict, count(*) AS n FROM mined CROSS JOIN switches GROUP BY 1, 2""", _variants)
sql_query("relevant_results", lambda d: f"SELECT request_id, count(*) AS n FROM ({d.profiles}) p JOIN ({_REQ}) r ON model = r_model AND (language = r_language OR (language IS NULL AND r_language = 'NATION_2')) GROUP BY request_id")
pair_query("fresh_pairs", lambda d: ", used AS (SELECT profile_a, profile_b FROM mined WHERE metric = 'A'), used_subject AS (SELECT DISTINCT paper_a, paper_b, model FROM mined WHERE metric = 'A') SELECT m.model, m.metric, count(*) AS n FROM mined m WHERE NOT EXISTS (SELECT 1 FROM used u WHERE u.profile_a = m.profile_a) AND NOT EXISTS (SELECT 1 FROM used u WHERE u.profile_b = m.profile_b) AND NOT EXISTS (SELECT 1 FROM used_subject u WHERE u.paper_a = m.paper_a AND u.paper_b = m.paper_b AND u.model = m.model) GROUP BY m.model, m.metric", lambda p: fresh_pairs(p, "A").groupBy("model", "metric").agg(F.count("*").alias("n")))
sql_query("gold_best_match", lambda d: f"""
WITH p AS ({_SUBJECT(d)}), gold AS (SELECT paper_id, metric, dataset, model, cents FROM p WHERE setting = 'O' AND metric = 'R' AND language = 'NATION_4'),
fits AS (SELECT g.paper_id, g.cents, g.dataset AS gold_dataset, p.profile_id, CASE WHEN p.metric = g.metric THEN 1 ELSE 0 END + CASE WHEN p.dataset = g.dataset THEN 1 ELSE 0 END + CASE WHEN p.model = g.model THEN 1 ELSE 0 END AS fit
         FROM gold g JOIN p ON p.paper_id = g.paper_id AND abs(p.cents - g.cents) <= 5100)
SELECT paper_id, cents, gold_dataset, profile_id, fit FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, cents, gold_dataset ORDER BY fit DESC, profile_id) AS k FROM fits) t WHERE k = 1""")
sql_query("orphan_check", lambda d: f"WITH p AS ({_P(d)}), c AS (SELECT DISTINCT chunk_id FROM p WHERE metric <> 'R') SELECT p.paper_id, count(*) AS n_orphans FROM p LEFT JOIN c ON p.chunk_id = c.chunk_id AND p.model_size > 2 WHERE c.chunk_id IS NULL GROUP BY p.paper_id")
sql_query("chunk_evidence", lambda d: f"""
WITH p AS ({_P(d)}), own AS (SELECT chunk_id, min(language) AS seen FROM p WHERE metric = 'A' AND model = 'PROMO' GROUP BY chunk_id), paper AS (SELECT paper_id, min(language) AS seen FROM p WHERE metric = 'A' AND model = 'PROMO' GROUP BY paper_id), c AS (SELECT DISTINCT chunk_id, paper_id FROM p)
SELECT c.chunk_id, coalesce(own.seen, paper.seen) AS language, own.chunk_id IS NULL AS paper_level FROM c LEFT JOIN own ON own.chunk_id = c.chunk_id LEFT JOIN paper ON paper.paper_id = c.paper_id""")
sql_query("scope_warning_text", lambda d: f"""
WITH p AS ({_P(d)}), seen AS (SELECT request_id, min(r_model) AS r_model, max(CASE WHEN model = r_model THEN 1 ELSE 0 END) AS a, max(CASE WHEN dataset = r_dataset THEN 1 ELSE 0 END) AS b, max(CASE WHEN language = r_language THEN 1 ELSE 0 END) AS c FROM ({_REQ}) r CROSS JOIN p GROUP BY request_id)
SELECT request_id, 'covered ' || CAST(a + b + c AS varchar(30)) || ' of 3' || CASE WHEN a = 0 THEN '; model not recorded' ELSE '' END || CASE WHEN b = 0 THEN '; dataset not recorded' ELSE '' END || CASE WHEN c = 0 THEN '; language not recorded' ELSE '' END AS warning FROM seen""")
sql_query("result_predicate", lambda d: f"SELECT metric, count(*) AS n FROM (SELECT nullif(model, 'PROMO') AS model, nullif(metric, 'N') AS metric, dataset FROM ({d.profiles})) t WHERE model IS NOT NULL AND metric IS NOT NULL AND model <> dataset GROUP BY metric")
sql_query("grounded_results", lambda d: "SELECT l_suppkey, count(*) AS n, CAST(sum(CASE WHEN abs(l_extendedprice - round(l_extendedprice, 1)) < 0.000001 THEN 1 ELSE 0 END) AS bigint) AS n_grounded FROM lineitem GROUP BY l_suppkey")
sql_query("bag_difference", lambda d: """
WITH fresh AS (SELECT l_suppkey, l_quantity, row_number() OVER (PARTITION BY l_suppkey, l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey) AS k FROM lineitem WHERE l_returnflag <> 'A'),
stored AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_suppkey, l_quantity)
SELECT f.l_suppkey, count(*) AS n_added, min(f.l_quantity) AS least FROM fresh f LEFT JOIN stored s ON s.l_suppkey = f.l_suppkey AND s.l_quantity = f.l_quantity WHERE f.k > coalesce(s.n, 0) GROUP BY f.l_suppkey""")
sql_query("union_first_wins", lambda d: f"""
WITH u AS (SELECT conv_id AS id, 1 AS file, {d.sub('lower(trim(text))', r'\s+', ' ')} AS k FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT doc_id, 2, {d.sub('lower(trim(text))', r'\s+', ' ')} FROM documents), dev AS (SELECT k FROM u WHERE id % 10 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY file, id) AS r FROM u)
SELECT file, id FROM ranked x WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM dev WHERE dev.k = x.k)""")
sql_query("model_family_counts", lambda d: f"SELECT {family(d, norm(d, 'model'))} AS family, count(*) AS n FROM ({NAMES}) GROUP BY 1")
