"""Scores of labelled results: agreement, precision and recall, tests, intervals, latency, sampling."""

from __future__ import annotations

from .dialect import sql_query

_L = "SELECT doc_id, quality AS a, 1 - toxic AS b FROM labels"
_PRF = """round(tp * 1e0 / nullif(tp + fp, 0), 4) AS p, round(tp * 1e0 / nullif(tp + fn, 0), 4) AS r, round(2e0 * tp / nullif(2 * tp + fp + fn, 0), 4) AS f1"""
_COUNT = lambda test: f"CAST(sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS bigint)"

sql_query("kappa", lambda d: f"""
WITH n AS (SELECT count(*) * 1e0 AS n, {_COUNT('a = b')} AS same, {_COUNT('a = 1')} AS a1, {_COUNT('b = 1')} AS b1 FROM ({_L}) t), e AS (SELECT same / n AS po, (a1 / n) * (b1 / n) + (1 - a1 / n) * (1 - b1 / n) AS pe FROM n)
SELECT round(po, 6) AS agreement, round(CASE WHEN pe = 1 THEN 1e0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM e""")
sql_query("prf_by_group", lambda d: f"""
WITH l AS (SELECT source, a, b FROM ({_L}) t JOIN documents ON documents.doc_id = t.doc_id),
c AS (SELECT coalesce(source, 'all') AS grp, {_COUNT('a = 1 AND b = 1')} AS tp, {_COUNT('a = 0 AND b = 1')} AS fp, {_COUNT('a = 1 AND b = 0')} AS fn FROM l GROUP BY ROLLUP (source))
SELECT grp, tp, fp, fn, {_PRF} FROM c""")
sql_query("confusion", lambda d: f"SELECT a, {_COUNT('b = 0')} AS b0, {_COUNT('b = 1')} AS b1 FROM ({_L}) t GROUP BY a")
_VERDICTS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'EXPLAINED' WHEN 'O' THEN 'GENUINE' ELSE 'NOT_COMPARABLE' END AS gold, CASE WHEN o_orderkey % 7 = 0 THEN 'EXPLAINED' WHEN o_orderkey % 11 = 0 THEN 'GENUINE' ELSE CASE o_orderstatus WHEN 'F' THEN 'EXPLAINED' WHEN 'O' THEN 'GENUINE' ELSE 'NOT_COMPARABLE' END END AS said, o_orderpriority AS grp FROM orders"
_CLASSES = "SELECT * FROM (VALUES ('EXPLAINED'), ('GENUINE'), ('NOT_COMPARABLE')) AS c(class)"
_PER_CLASS = f"SELECT class, {_COUNT('gold = class AND said = class')} AS tp, {_COUNT('gold <> class AND said = class')} AS fp, {_COUNT('gold = class AND said <> class')} AS fn FROM ({_VERDICTS}) v CROSS JOIN ({_CLASSES}) c GROUP BY class"
sql_query("macro_f1", lambda d: f"SELECT round(avg(2e0 * tp / nullif(2 * tp + fp + fn, 0)), 6) AS macro_f1, CAST(sum(tp) AS bigint) AS n_right FROM ({_PER_CLASS}) t WHERE tp + fn > 0")
sql_query("per_class_prf", lambda d: f"SELECT class, tp, fp, fn, {_PRF} FROM ({_PER_CLASS}) t")
sql_query("field_scores", lambda d: f"""
WITH f AS (SELECT l_shipdate, l_returnflag AS grp, 'quantity' AS field, l_quantity > 25 AS wrong, l_quantity = 1 AS missing FROM lineitem UNION ALL SELECT l_shipdate, l_returnflag, 'discount', l_discount > 0.05, l_discount = 0 FROM lineitem UNION ALL SELECT l_shipdate, l_returnflag, 'tax', l_tax > 0.06, l_tax = 0 FROM lineitem)
SELECT field, coalesce(grp, 'all') AS grp, {_COUNT('wrong')} AS n_wrong, {_COUNT('missing')} AS n_missing, count(*) AS n FROM f GROUP BY GROUPING SETS ((field), (field, grp))""")
sql_query("scope_scores", lambda d: f"""
WITH w AS (SELECT o_orderstatus = 'F' AS expected, o_totalprice > 250000 AS warned FROM orders) SELECT {_COUNT('expected AND warned')} AS tp, {_COUNT('NOT expected AND warned')} AS fp, {_COUNT('expected AND NOT warned')} AS fn, {_COUNT('NOT expected AND NOT warned')} AS tn,
 round({_COUNT('NOT expected AND warned')} * 1e0 / {_COUNT('NOT expected')}, 6) AS false_rate FROM w""")
sql_query("answer_scores", lambda d: "SELECT event_type, round(avg(CASE WHEN value > 5 THEN 1e0 ELSE 0e0 END), 6) AS accuracy, round(avg(CASE WHEN event_id % 3 = 0 THEN NULL WHEN value > 10 THEN 1e0 ELSE 0e0 END), 6) AS supported, count(*) AS n FROM events GROUP BY event_type")
sql_query("sign_test", lambda d: f"""
WITH n AS (SELECT c_mktsegment, {_COUNT('c_acctbal > 5000 AND c_custkey % 29 = 0')} AS x, {_COUNT('c_acctbal <= 5000 AND c_custkey % 31 = 0')} AS y FROM customer GROUP BY c_mktsegment), k AS (SELECT c_mktsegment, x, y, x + y AS n, least(x, y) AS low, {d.series('0', 'least(x, y)')} AS i FROM n),
j AS (SELECT c_mktsegment, x, y, n, low, i, {d.series('0', 'i')} AS j FROM k), c AS (SELECT c_mktsegment, x, y, n, low, i, exp(sum(CASE WHEN j = 0 THEN 0e0 ELSE ln((n - j + 1) * 1e0 / j) END) - n * ln(2e0)) AS p FROM j GROUP BY c_mktsegment, x, y, n, low, i)
SELECT c_mktsegment, x, y, round(least(1e0, 2 * sum(p)), 6) AS p FROM c GROUP BY c_mktsegment, x, y""")
sql_query("wilson", lambda d: f"""
WITH n AS (SELECT l_returnflag, count(*) * 1e0 AS n, {_COUNT('l_discount > 0.04')} AS k FROM lineitem GROUP BY l_returnflag), p AS (SELECT l_returnflag, n, k / n AS p, 1.96e0 AS z FROM n)
SELECT l_returnflag, round(100 * (p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) AS low, round(100 * (p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 4) AS high FROM p""")
sql_query("latency_summary", lambda d: """
WITH v AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(CASE WHEN k = floor(0.9 * (n - 1)) + 1 THEN value END), 6) AS p90, round((max(CASE WHEN k = floor((n + 1) / 2.0) THEN value END) + max(CASE WHEN k = floor((n + 2) / 2.0) THEN value END)) / 2, 6) AS median, round(avg(value), 6) AS mean FROM v GROUP BY event_type""")
sql_query("comparison_table", lambda d: f"SELECT event_type, {', '.join(f'coalesce(CAST(round(sum(CASE WHEN event_id % 4 = {i} THEN value END) * 100) AS bigint), -1) AS run_{i}' for i in range(4))} FROM events GROUP BY event_type")
sql_query("micro_macro", lambda d: "WITH p AS (SELECT l_suppkey, count(*) AS gold, sum(CASE WHEN l_discount > 0.03 THEN 1 ELSE 0 END) AS found FROM lineitem GROUP BY l_suppkey) SELECT round(100e0 * sum(found) / sum(gold), 6) AS micro, round(avg(100e0 * found / gold), 6) AS macro FROM p")
sql_query("label_problems", lambda d: f"SELECT problem, count(*) AS n FROM (SELECT {d.explode}({d.where(d.array("CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'unknown verdict' END", "CASE WHEN o_totalprice < 1000 THEN 'value too small' END", "CASE WHEN o_orderpriority LIKE '4%' THEN 'no reason given' END"), 'x', 'x IS NOT NULL')}) AS problem FROM orders) t GROUP BY problem")
sql_query("adjudication", lambda d: f"SELECT t.doc_id, lang FROM ({_L}) t JOIN documents ON documents.doc_id = t.doc_id WHERE a <> b")
sql_query("majority_labels", lambda d: f"WITH l AS (SELECT t.doc_id, a, b, CASE WHEN lang = 'en' THEN 1 ELSE 0 END AS c FROM ({_L}) t JOIN documents ON documents.doc_id = t.doc_id) SELECT doc_id, CASE WHEN a = b THEN a ELSE c END AS gold, CASE WHEN a = b THEN 2 ELSE 3 END AS voters FROM l")
sql_query("number_grounding", lambda d: f"""
WITH n AS (SELECT conv_id, role, {d.explode}({d.found('text', '[0-9]+')}) AS number FROM conversations),
said AS (SELECT DISTINCT conv_id, number FROM n WHERE role = 'assistant'), known AS (SELECT DISTINCT conv_id, number FROM n WHERE role = 'user')
SELECT said.conv_id, count(*) AS n_numbers, count(known.number) AS n_grounded FROM said LEFT JOIN known ON known.conv_id = said.conv_id AND known.number = said.number GROUP BY said.conv_id""")
sql_query("condition_prf", lambda d: f"""
WITH found AS (SELECT DISTINCT l_suppkey, l_returnflag AS v FROM lineitem WHERE l_quantity < 3), gold AS (SELECT DISTINCT l_suppkey, l_linestatus AS v FROM lineitem UNION SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem WHERE l_quantity > 49),
j AS (SELECT coalesce(f.v, g.v) AS v, f.v IS NOT NULL AS said, g.v IS NOT NULL AS right_one FROM found f FULL OUTER JOIN gold g ON f.l_suppkey = g.l_suppkey AND f.v = g.v), c AS (SELECT coalesce(v, 'ALL') AS field, {_COUNT('said AND right_one')} AS tp, {_COUNT('said AND NOT right_one')} AS fp, {_COUNT('NOT said AND right_one')} AS fn FROM j GROUP BY ROLLUP (v))
SELECT field, tp, fp, fn, {_PRF} FROM c""")
sql_query("flagged_share", lambda d: "SELECT source, round(avg(CASE WHEN n_chars < 500 OR lang <> 'en' THEN 1e0 ELSE 0e0 END), 6) AS flagged, count(*) AS n FROM documents GROUP BY source")
sql_query("evidence_in_sources", lambda d: "WITH hit AS (SELECT o.o_orderkey, o.o_orderpriority, max(CASE WHEN l.l_linenumber = 1 AND l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS page, max(CASE WHEN l.l_returnflag = 'R' THEN 1 ELSE 0 END) AS paper FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_orderpriority) SELECT o_orderpriority, round(avg(page * 1e0), 6) AS page_share, round(avg(paper * 1e0), 6) AS paper_share FROM hit GROUP BY o_orderpriority")
sql_query("pooled_scores", lambda d: f"SELECT coalesce(grp, 'pooled') AS grp, round({_COUNT("said = 'GENUINE' AND gold <> 'GENUINE'")} * 1e0 / {_COUNT("gold <> 'GENUINE'")}, 6) AS false_genuine, {_COUNT("said = 'GENUINE' AND gold = 'GENUINE'")} AS found, {_COUNT("gold = 'GENUINE'")} AS total FROM ({_VERDICTS}) v GROUP BY ROLLUP (grp)")
sql_query("stratified_sample", lambda d: """
WITH h AS (SELECT doc_id, source, lang, md5(CAST(doc_id AS varchar(30)) || ':11') AS draw FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY draw) AS in_chunk FROM h),
f AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN in_chunk <= 6 THEN 0 ELSE 1 END, draw) AS k FROM c) SELECT source, doc_id, k FROM f WHERE k <= 20""")
sql_query("stratified_split", lambda d: """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS varchar(30)) || ':7')) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, CASE WHEN n >= 8 AND k <= greatest(1, CAST(floor(n * 0.1) AS int)) THEN 'validation' ELSE 'train' END AS part FROM r""")
sql_query("lookup_cases", lambda d: f"""
WITH g AS (SELECT paper_id, model, dataset, language, metric, setting, count(DISTINCT round(value, 2)) AS n_values, min(round(value, 2)) AS least FROM ({d.profiles}) p WHERE language IS NOT NULL GROUP BY paper_id, model, dataset, language, metric, setting HAVING count(DISTINCT round(value, 2)) <= 3),
r AS (SELECT *, md5(paper_id || model || dataset || metric || setting || ':3') AS draw FROM g), k AS (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY draw, least) AS in_paper FROM r)
SELECT paper_id, model, dataset, metric, setting, n_values FROM (SELECT *, row_number() OVER (ORDER BY draw, paper_id) AS n FROM k WHERE in_paper <= 5) t WHERE n <= 40""")
sql_query("absent_cases", lambda d: f"WITH p AS (SELECT DISTINCT model, dataset, language FROM ({d.profiles}) t WHERE language IS NOT NULL), m AS (SELECT DISTINCT model FROM p), s AS (SELECT DISTINCT dataset FROM p), l AS (SELECT DISTINCT language FROM p) SELECT m.model, s.dataset, l.language FROM m CROSS JOIN s CROSS JOIN l WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.model = m.model AND p.dataset = s.dataset AND p.language = l.language)")
sql_query("template_questions", lambda d: """
WITH t AS (SELECT * FROM (VALUES ('result', 'What does X reach on '), ('comparison', 'Is X better than Y on ')) AS t(intent, stem)), q AS (SELECT intent, stem || p_brand || '?' AS question, md5(stem || p_brand || p_name) AS draw FROM part CROSS JOIN t), u AS (SELECT intent, question, min(draw) AS draw FROM q GROUP BY intent, question)
SELECT intent, question, k FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY draw) AS k FROM u) x WHERE k <= 12""")
sql_query("last_answers", lambda d: f"WITH a AS (SELECT user_id, event_type, max_by(event_id, event_id) AS last_id, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT a.user_id, a.event_type, a.n, CAST({d.part('props', r'([0-9]+)', 1)} AS bigint) AS k FROM a JOIN events e ON e.event_id = a.last_id")
sql_query("plan_flags", lambda d: "SELECT conv_id, turn, length(text) > 200 OR role = 'system' AS refine, role <> 'system' AS retrieve, position('?' IN text) > 0 AND role = 'user' AS compare, length(text) < 60 AS review FROM conversations")
sql_query("response_previews", lambda d: f"SELECT doc_id, substr({d.sub('trim(text)', r'\s+', ' ')}, 1, 280) AS preview, CASE WHEN n_chars > 1000 THEN n_chars ELSE doc_id END AS score FROM documents")
