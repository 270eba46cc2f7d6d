"""Names, versions, sizes, settings and other strings of a condition, as expressions.

Each function below gives the SQL of one scalar operator in either dialect; the queries apply it to whole columns.
"""

from __future__ import annotations

from .dialect import Spark, sql_query

#: Spellings that mean a condition was not recorded.
NULLISH = ("not specified", "unspecified", "n/a", "na", "none", "null", "unknown", "not stated", "not applicable", "not reported", "not mentioned", "not available", "-", "--", "—", "")
#: Words that decorate a model's name, those of size first.
SIZES = ("xxlarge", "xlarge", "medium", "large", "small", "base", "tiny", "mini", "huge", "xxl", "xl")
DECOR = ("multilingual", "pretrained", "distilled", "finetuned", "ensemble", "uncased", "single", "cased")
#: Words without meaning in a metric's name, and its other names.
METRIC_NOISE = ("score", "dev", "test", "val", "validation", "avg", "average")
METRIC_NAMES = {"acc": "accuracy", "exactmatch": "em", "f1score": "f1", "fscore": "f1"}
#: Evaluation settings by pattern.
SETTING_TAGS = {
    "zero-shot": "zero[- ]?shot", "few-shot": "few[- ]?shot", "fine-tuned": "fine[- ]?tun", "translate-train": "translate[- ]?train", "translate-test": "translate[- ]?test",
    "dev": r"\b(?:dev|development|validation|val)\b", "test": r"\btest\b", "train": r"\btrain(?:ing)?\b", "single": r"\bsingle\b", "ensemble": r"\bensemble",
    "in-domain": "in[- ]?domain", "out-of-domain": "out[- ]?of[- ]?domain", "feature-based": "feature[- ]?based", "ablation": r"\bablation\b",
}
#: Kinds of setting within which two results can differ.
DIMENSIONS = (("dev", "test", "train"), ("single", "ensemble"), ("zero-shot", "few-shot", "fine-tuned", "translate-train", "translate-test", "feature-based"), ("in-domain", "out-of-domain"))
#: Intents by cue words, first match wins.
INTENTS = {
    "comparison": r"\b(compare|compared|versus|vs\.?|better than|worse than|difference|differ|outperform)\b",
    "method": r"\b(how does|how do|how is|method|approach|architecture|algorithm|technique|trained|training)\b",
    "result": r"\b(accuracy|score|f1|exact match|result|perform|performance|benchmark|achieve|obtain)\b",
    "survey": r"\b(survey|overview|review|what are the|main (ideas|approaches)|state of the art)\b",
}
#: Sections by words of their heading, first match wins.
SECTIONS = {
    "references": r"\b(references|bibliography)\b", "conclusion": r"\b(conclusions?|future work|concluding remarks|summary)\b", "abstract": r"\babstract\b", "introduction": r"\bintroduction\b",
    "related_work": r"\b(related work|background|preliminar\w*|literature review|prior work|previous work)\b", "results": r"\b(results?|findings|ablations?|main results)\b",
    "experiments": r"\b(experiments?|experimental|evaluations?|setup|implementation details|datasets?|benchmarks?|training details|hyper-?parameters?|baselines?)\b",
    "discussion": r"\b(discussion|analysis|limitations?)\b", "methods": r"\b(methods?|methodology|approach|architecture|framework|algorithm|proposed|model|models)\b",
    "other": r"\b(acknowledge?ments?|appendix|appendices|supplementary|ethics?|broader impacts?)\b",
}
#: Names of languages by code.
LANGUAGES = {
    "en": "english", "eng": "english", "hi": "hindi", "kn": "kannada", "ta": "tamil", "te": "telugu", "de": "german", "fr": "french", "es": "spanish", "zh": "chinese", "ru": "russian", "ar": "arabic",
    "sw": "swahili", "ja": "japanese", "ko": "korean", "mr": "marathi", "bn": "bengali",
}


def norm(d: Spark, x: str) -> str:
    return d.sub(f"lower(coalesce({x}, ''))", "[^a-z0-9]", "")


def nullish(d: Spark, x: str) -> str:
    listed = ", ".join(f"'{v}'" for v in NULLISH)
    return f"coalesce(lower(trim(BOTH '.' FROM trim({x}))) IN ({listed}), true)" if not isinstance(d, type(None)) and type(d) is Spark else f"coalesce(lower(trim(trim({x}), '.')) IN ({listed}), true)"


def family(d: Spark, n: str) -> str:
    """A normalised model name without the words that decorate its end; never empty."""
    return d.part(n, f"^(.+?)(?:{'|'.join((*SIZES, *DECOR))})*$", 1)


def size_label(d: Spark, n: str) -> str:
    """The size word nearest the end among those that decorate a normalised name, or null."""
    return f"nullif({d.part(n, f'^.+?({"|".join(SIZES)})(?:{"|".join(DECOR)})*$', 1)}, '')"


def params(d: Spark, x: str) -> str:
    """Parameter count in millions."""
    pattern = r"([0-9]+(?:\.[0-9]+)?)\s*(million|billion|k|m|b)\b"
    number, unit = d.part(f"lower({x})", pattern, 1), d.part(f"lower({x})", pattern, 2)
    return f"TRY_CAST(nullif({number}, '') AS double) * CASE {unit} WHEN 'k' THEN 0.001 WHEN 'b' THEN 1000 WHEN 'billion' THEN 1000 ELSE 1 END"


def metric_key(d: Spark, x: str) -> str:
    n = norm(d, x)
    for word in METRIC_NOISE:
        n = f"replace({n}, '{word}', '')"
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in METRIC_NAMES.items())
    return f"CASE {n} {cases} ELSE {n} END"


def language(d: Spark, x: str) -> str:
    n = norm(d, x)
    return f"CASE {n} {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in LANGUAGES.items())} ELSE {n} END"


def tags(d: Spark, x: str) -> str:
    """Setting tags of a text, in the order of SETTING_TAGS."""
    listed = d.array(*[f"CASE WHEN {d.has(f"lower(coalesce({x}, ''))", p)} THEN '{t}' END" for t, p in SETTING_TAGS.items()])
    return d.where(listed, "t", "t IS NOT NULL")


def first_match(d: Spark, x: str, rules: dict[str, str], other: str) -> str:
    return "CASE " + " ".join(f"WHEN {d.has(f'lower({x})', p)} THEN '{name}'" for name, p in rules.items()) + f" ELSE {other} END"


def same_dataset(d: Spark, a: str, b: str) -> str:
    """Over normalised names: equal, or one begins with the other; three characters at least."""
    return f"(length({a}) >= 3 AND length({b}) >= 3 AND (starts_with({a}, {b}) OR starts_with({b}, {a})))" if type(d) is not Spark else f"(length({a}) >= 3 AND length({b}) >= 3 AND (startswith({a}, {b}) OR startswith({b}, {a})))"


def number_text(d: Spark, cents: str) -> str:
    """A value held in hundredths, spelled without trailing zeros."""
    whole, rest = f"CAST({cents} AS bigint) // 100" if type(d) is not Spark else f"CAST({cents} AS bigint) div 100", f"CAST({cents} AS bigint) % 100"
    return f"CAST({whole} AS varchar(30)) || CASE WHEN {rest} = 0 THEN '' WHEN {rest} % 10 = 0 THEN '.' || CAST(CAST({rest} / 10 AS int) AS varchar(30)) WHEN {rest} < 10 THEN '.0' || CAST({rest} AS varchar(30)) ELSE '.' || CAST({rest} AS varchar(30)) END"


NAMES = "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_name || '-' || p_type || CASE p_partkey % 4 WHEN 0 THEN ' uncased' WHEN 1 THEN '' WHEN 2 THEN ' Ensemble' ELSE '-base' END AS model FROM part"
SETTINGS = "SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'zero-shot transfer' WHEN 1 THEN 'dev set, single model' WHEN 2 THEN 'test set (ensemble)' WHEN 3 THEN 'Fine-tuned; validation' WHEN 4 THEN 'translate-train, test' WHEN 5 THEN 'few shot in-domain' WHEN 6 THEN 'each N' WHEN 7 THEN 'out of domain training' END AS setting FROM part"

sql_query("norm_scalars", lambda d: f"SELECT p_partkey, {norm(d, 'p_name')} AS name_key, {norm(d, 'p_brand')} AS brand_key, {nullish(d, "CASE p_partkey % 5 WHEN 0 THEN ' N/A. ' WHEN 1 THEN 'Not specified' WHEN 2 THEN '--' WHEN 3 THEN p_type END")} AS unrecorded FROM part")
sql_query("model_names", lambda d: f"SELECT p_partkey, {family(d, norm(d, 'model'))} AS family, {size_label(d, norm(d, 'model'))} AS size_label FROM ({NAMES})")
_OWN = r"^\s*(?:google|ours?|published|baseline|vanilla|original|proposed|average)[\s:(\-]+"
sql_query("model_core", lambda d: f"SELECT p_partkey, {family(d, norm(d, d.sub("lower(said)", _OWN, '')))} AS family FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'Our ' WHEN 1 THEN 'baseline: ' ELSE '' END || model AS said FROM ({NAMES}))")
sql_query("parse_params", lambda d: f"SELECT p_partkey, round({params(d, 'said')}, 6) AS millions FROM (SELECT p_partkey, CAST(p_size AS varchar(30)) || CASE p_partkey % 6 WHEN 0 THEN 'M' WHEN 1 THEN '.5B' WHEN 2 THEN ' million' WHEN 3 THEN 'k' WHEN 4 THEN ' large' ELSE ' billion parameters' END AS said FROM part)")
_PARTS = r"^(.+?)\s+v?([0-9]+(?:\.[0-9]+)+)(?:\s+(development|dev|test|train|validation|val))?(?:\s+set)?$"
sql_query("split_dataset", lambda d: f"""
SELECT p_partkey, CASE WHEN {d.has('said', _PARTS)} THEN {d.part('said', _PARTS, 1)} ELSE said END AS dataset, nullif({d.part('said', _PARTS, 2)}, '') AS version,
       CASE {d.part('said', _PARTS, 3)} WHEN 'test' THEN 'test set' WHEN 'train' THEN 'train set' WHEN '' THEN NULL ELSE 'dev set' END AS split_name
FROM (SELECT p_partkey, p_brand || CASE p_partkey % 5 WHEN 0 THEN ' 1.1' WHEN 1 THEN ' v2.0 test' WHEN 2 THEN ' 2.0.1 dev set' WHEN 3 THEN '-2' ELSE ' 3.0 train' END AS said FROM part)""")
sql_query("version_equality", lambda d: f"""
WITH v AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN 'v' WHEN 1 THEN 'Version ' ELSE '' END || CAST(p_size % 7 AS varchar(30)) || CASE WHEN p_size % 3 = 0 THEN '.0' ELSE '' END AS said FROM part),
n AS (SELECT said, {d.sub('lower(trim(said))', '^v(?:ersion)?[ ]*', '')} AS plain FROM v)
SELECT a.said AS left_said, b.said AS right_said, (a.plain = b.plain OR TRY_CAST(a.plain AS double) = TRY_CAST(b.plain AS double)) AS same FROM n a CROSS JOIN n b""")
sql_query("metric_keys", lambda d: f"SELECT p_partkey, {metric_key(d, 'said')} AS metric FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Acc.' WHEN 1 THEN 'Exact Match' WHEN 2 THEN 'F1-score' WHEN 3 THEN 'dev F-score' WHEN 4 THEN 'ROUGE-L' WHEN 5 THEN 'avg accuracy' ELSE p_type END AS said FROM part)")
sql_query("language_pairs", lambda d: f"""
WITH said AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'en-de' WHEN 1 THEN 'English to German' WHEN 2 THEN 'fr' WHEN 3 THEN 'zh/ru' ELSE 'English-to-Hindi' END AS t FROM part),
cut AS (SELECT p_partkey, {d.where(d.split(d.sub('lower(t)', r'\s*(?:-to-|\bto\b|/|-)\s*', '|'), '|'), 'x', "x <> ''")} AS sides FROM said)
SELECT p_partkey, CASE WHEN {d.size}(sides) = 2 THEN {d.text_of(d.each('sides', 'x', language(d, 'x')))} ELSE '' END AS pair FROM cut""")
sql_query("values_match_matrix", lambda d: f"""
WITH n AS (SELECT DISTINCT p_brand AS brand, {norm(d, 'p_brand')} AS k FROM part), m AS (SELECT DISTINCT n_name AS name, {language(d, 'n_name')} AS k FROM nation)
SELECT 'dataset' AS field, a.brand AS requested, b.brand AS observed FROM n a JOIN n b ON {same_dataset(d, 'a.k', 'b.k')}
UNION ALL SELECT 'language', a.name, b.name FROM m a JOIN m b ON a.k = b.k""")
sql_query("suite_members", lambda d: f"""
WITH suite AS (SELECT * FROM (VALUES ('glue', 'cola'), ('glue', 'sst2'), ('glue', 'mnli'), ('glue', 'rte'), ('superglue', 'boolq'), ('superglue', 'rte'), ('xtreme', 'xnli'), ('xtreme', 'xquad')) AS s(suite, member)),
said AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'CoLA' WHEN 1 THEN 'MNLI-m' WHEN 2 THEN 'XNLI' WHEN 3 THEN 'RTE' WHEN 4 THEN 'IndicXNLI' ELSE p_brand END AS name FROM part)
SELECT p_partkey, suite FROM said JOIN suite ON {norm(d, 'name')} = member OR (length(member) >= 4 AND {norm(d, 'name')} LIKE member || '%')""")
sql_query("setting_tags", lambda d: f"SELECT p_partkey, {d.text_of(tags(d, 'setting'))} AS tags FROM ({SETTINGS})")


def _differs(d: Spark, a: str, b: str) -> str:
    """Whether two tag arrays disagree within a kind that both record."""
    tests = []
    for kind in DIMENSIONS:
        listed = ", ".join(f"'{t}'" for t in kind)
        x, y = (d.text_of(d.where(t, "t", f"t IN ({listed})" + (f" AND NOT (t IN ('test', 'train') AND (array_contains({t}, 'translate-train') OR array_contains({t}, 'translate-test')))" if "dev" in kind else ""))) for t in (a, b))
        tests.append(f"({x} <> '' AND {y} <> '' AND {x} <> {y})")
    return " OR ".join(tests)


sql_query("setting_differs", lambda d: f"""
WITH t AS (SELECT DISTINCT setting FROM ({SETTINGS}) WHERE setting IS NOT NULL), g AS (SELECT setting, {tags(d, 'setting')} AS tags FROM t)
SELECT a.setting AS left_setting, b.setting AS right_setting, ({_differs(d, 'a.tags', 'b.tags')}) AS differs FROM g a CROSS JOIN g b""")
sql_query("claim_texts", lambda d: f"""
SELECT profile_id, model || ' obtains ' || {number_text(d, 'round(value * 100)')} || ' ' || metric || ' on ' || dataset || ' (' || setting || coalesce(', ' || language, '') || coalesce(', ' || CAST(model_size AS varchar(30)), '') || ').' AS claim
FROM ({d.profiles})""")
sql_query("cut_name_lookup", lambda d: f"""
WITH known AS (SELECT DISTINCT p_name AS name, {norm(d, 'p_name')} AS k FROM part), cut AS (SELECT DISTINCT substr({norm(d, 'p_name')}, 1, 5) AS k FROM part)
SELECT cut.k AS cut_name, min(known.name) AS completed FROM cut JOIN known ON length(cut.k) >= 4 AND length(known.k) > length(cut.k) AND (known.k LIKE cut.k || '%' OR known.k LIKE '%' || cut.k) GROUP BY cut.k HAVING count(DISTINCT known.name) = 1""")
_FAMILIES = {"inference": r"\b(nli|entail|inference)", "qa": r"\b(question|qa|reading)", "translation": r"\btranslat", "summary": r"\bsummar", "tagging": r"\b(ner|pos|tagging|entity)"}
sql_query("task_families", lambda d: f"SELECT p_partkey, {d.text_of(d.where(d.array(*[f"CASE WHEN {d.has('said', p)} THEN '{n}' END" for n, p in _FAMILIES.items()]), 't', 't IS NOT NULL'))} AS families FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'question answering' WHEN 1 THEN 'nli and translation' WHEN 2 THEN 'summarization' WHEN 3 THEN 'ner tagging' ELSE 'sentiment' END AS said FROM part)")
sql_query("language_codes", lambda d: f"SELECT c_custkey, {language(d, "CASE c_custkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'DE' WHEN 2 THEN 'Hindi' ELSE c_mktsegment END")} AS language FROM customer")
sql_query("sentence_split", lambda d: f"""
WITH lines AS (SELECT doc_id, {d.explode}({d.split('text', chr(10))}) AS line FROM documents), marked AS (SELECT doc_id, {d.explode}({d.split(d.sub('line', r'([.!?])\s+([A-Z0-9])', '$1|~|$2'), '|~|')}) AS sentence FROM lines)
SELECT doc_id, count(*) AS n_sentences, CAST(sum(length(trim(sentence))) AS bigint) AS n_chars FROM marked WHERE length(trim(sentence)) >= 20 GROUP BY doc_id""")
_CITED = "CASE l_linenumber % 4 WHEN 0 THEN 'as shown [1, 3].' WHEN 1 THEN 'see [' || CAST(l_linenumber AS varchar(30)) || '] and [12].' WHEN 2 THEN '**bold** claim' ELSE '- item [2]' END"
sql_query("citations_extract", lambda d: f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {d.text_of(d.found(d.text_of(d.found('said', r'\[[0-9]+(?:\s*,\s*[0-9]+)*\]'), ' '), '[0-9]+'))} AS cited,
       trim({d.sub(d.sub('said', r'\s*\[[0-9]+(?:\s*,\s*[0-9]+)*\]', ''), '[*_`#>]+', '')}) AS plain
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_CITED} AS said FROM lineitem)""")
sql_query("turn_overlap", lambda d: f"""
WITH w AS (SELECT conv_id, turn, {d.distinct}({d.found('lower(text)', '[a-z0-9]+')}) AS words FROM conversations)
SELECT a.conv_id, a.turn, round(CASE WHEN {d.size}(a.words) = 0 THEN 0.0 ELSE {d.size}({d.intersect}(a.words, b.words)) * 1.0 / {d.size}(a.words) END, 6) AS overlap FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
sql_query("keyword_tokens", lambda d: f"SELECT token, count(*) AS n FROM (SELECT {d.explode}({d.tokens('text')}) AS token FROM documents) GROUP BY token")
sql_query("heuristic_analysis", lambda d: f"""
SELECT conv_id, turn, {first_match(d, 'said', INTENTS, "'factual'")} AS intent,
       CASE WHEN length(said) - length(replace(said, '?', '')) > 1 OR {d.size}({d.found('lower(said)', r'\b(and|also|as well as)\b')}) >= 2 OR {d.size}({d.found('said', r'\S+')}) > 30 OR {d.has('lower(said)', INTENTS['comparison'])} THEN 'complex' ELSE 'simple' END AS complexity
FROM (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'How does it work? ' WHEN 1 THEN 'Which accuracy did they obtain? ' WHEN 2 THEN 'Compare both and say which is better than the other ' WHEN 3 THEN 'Give an overview ' ELSE '' END || text AS said FROM conversations)""")
sql_query("n_shot", lambda d: f"""
SELECT p_partkey, CASE WHEN n = '' THEN NULL WHEN n IN ('0', 'zero') THEN 'zero-shot' ELSE CASE n WHEN 'one' THEN '1' WHEN 'two' THEN '2' WHEN 'five' THEN '5' ELSE n END || '-shot' END AS setting
FROM (SELECT p_partkey, {d.part("CASE p_partkey % 5 WHEN 0 THEN '0-shot' WHEN 1 THEN 'five shot' WHEN 2 THEN CAST(p_size AS varchar(30)) || '-shots' WHEN 3 THEN 'Zero-shot' ELSE 'shot' END", r'(?i)\b([0-9]{1,3}|zero|one|two|five)[- ]?shots?\b', 1)} AS raw, lower({d.part("CASE p_partkey % 5 WHEN 0 THEN '0-shot' WHEN 1 THEN 'five shot' WHEN 2 THEN CAST(p_size AS varchar(30)) || '-shots' WHEN 3 THEN 'Zero-shot' ELSE 'shot' END", r'(?i)\b([0-9]{1,3}|zero|one|two|five)[- ]?shots?\b', 1)}) AS n FROM part)""")
_TITLES = "CASE o_orderkey % 9 WHEN 0 THEN 'Main Results' WHEN 1 THEN '3.1 Experimental Setup' WHEN 2 THEN 'Related work' WHEN 3 THEN 'Our approach' WHEN 4 THEN 'References' WHEN 5 THEN 'Error analysis' WHEN 6 THEN 'Conclusion and future work' WHEN 7 THEN 'Appendix' ELSE o_orderpriority END"
sql_query("section_labels", lambda d: f"SELECT section, count(*) AS n FROM (SELECT {first_match(d, 'title', SECTIONS, 'NULL')} AS section FROM (SELECT {_TITLES} AS title FROM orders)) GROUP BY section")
sql_query("citation_labels", lambda d: f"""
SELECT s_suppkey, {d.has('said', r'^[A-Z][a-z]+(?: et al\.?)? \([0-9]{4}[a-z]?\)$')} AS is_citation, trim({d.sub('said', r'\s*\([A-Z][a-z]+ et al\.?,? [0-9]{4}[a-z]?\)', '')}) AS model
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'Devlin et al. (2018)' WHEN 1 THEN s_name || ' (Liu et al., 2019)' ELSE s_name END AS said FROM supplier)""")
sql_query("answer_numbers", lambda d: f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {d.size}({d.where(d.found(d.sub('said', r'\[[0-9, ]+\]', ''), r'[0-9]+(?:\.[0-9]+)?'), 'x', 'abs(CAST(x AS double) - gold) <= 0.051')}) > 0 AS correct
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'It reaches ' || CAST(CAST(l_quantity AS int) AS varchar(30)) || '.5 points [1, ' || CAST(l_linenumber AS varchar(30)) || '].' AS said, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity + 0.5 ELSE l_linenumber * 1.0 END AS gold FROM lineitem)""")
sql_query("names_agree", lambda d: f"""
WITH n AS (SELECT DISTINCT p_name AS name, {d.found('lower(p_name)', '[a-z0-9]+')} AS words, {norm(d, 'p_name')} AS k FROM part)
SELECT a.name AS left_name, b.name AS right_name FROM n a JOIN n b ON a.name < b.name AND ({d.size}({d.intersect}(a.words, b.words)) = least({d.size}({d.distinct}(a.words)), {d.size}({d.distinct}(b.words))) OR (length(a.k) >= 4 AND contains(b.k, a.k)) OR (length(b.k) >= 4 AND contains(a.k, b.k)))""")
sql_query("needs_chat", lambda d: f"SELECT conv_id, turn, ({d.size}({d.found('text', r'\S+')}) <= 6 OR {d.has('text', r'(?i)\b(it|that|this|those|them|he|same|instead|what about|and for)\b')}) AS follows FROM conversations WHERE role = 'user'")
sql_query("transcripts", lambda d: f"""
WITH r AS (SELECT conv_id, turn, role, substr(text, 1, 600) AS said, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE trim(text) <> '')
SELECT conv_id, md5({d.joined("role || ': ' || said", 'turn', '|')}) AS transcript FROM r WHERE k <= 4 GROUP BY conv_id""")
sql_query("perturbed_questions", lambda d: f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN lower(text) WHEN 1 THEN 'please, ' || text ELSE substr(text, 2, 1) || substr(text, 1, 1) || substr(text, 3) END AS said, substr(md5({d.sub('lower(trim(text))', r'\s+', ' ')}), 1, 16) AS digest FROM conversations")
sql_query("split_values", lambda d: f"SELECT p_partkey, {d.text_of(d.distinct + '(' + d.where(d.split(d.sub('lower(said)', r'\s*(?:[;,&]|\band\b)\s*', '|'), '|'), 'x', "x <> ''") + ')') if type(d) is Spark else d.text_of(d.where(d.split(d.sub('lower(said)', r'\s*(?:[;,&]|\band\b)\s*', '|'), '|'), 'x', "x <> ''"))} AS parts FROM (SELECT p_partkey, p_name || '; ' || p_type || ' and ' || p_brand AS said FROM part)")
sql_query("table_rows", lambda d: f"""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {d.split("'row ' || CAST(l_quantity AS varchar(30)) || CASE l_linenumber % 3 WHEN 0 THEN ' -' WHEN 1 THEN ' 84.1 88.2' ELSE ' text here' END", ' ')} AS cells FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ({d.size}({d.where('cells', 'x', d.has('x', r'^[0-9]+(\.[0-9]+)?$'))}) >= 1 AND 2 * {d.size}({d.where('cells', 'x', d.has('x', r'^([0-9]+(\.[0-9]+)?|-)$'))}) >= {d.size}(cells)) AS is_row FROM c""")
sql_query("pipe_tables", lambda d: f"""
SELECT n_nationkey, {d.text_of(d.where(d.split("'| model | ' || n_name || ' |~|---|---|~| a **b** | 1.5 |'", '~'), 'x', f"NOT {d.has('x', r'^[|: -]+$')}"), '/')} AS kept FROM nation""")
sql_query("content_words", lambda d: f"""
SELECT conv_id, turn, {d.size}({d.distinct}({d.where(d.found('lower(text)', '[a-z0-9]+'), 'x', "length(x) >= 4 AND x NOT IN ('this', 'that', 'with', 'from', 'have', 'which', 'their', 'these', 'were')")})) AS n_words FROM conversations""")
sql_query("access_guard", lambda d: "SELECT event_id, CASE WHEN event_type = 'view' THEN 200 WHEN event_type = 'signup' THEN 403 WHEN event_id % 7 = 0 THEN 401 ELSE 200 END AS status FROM events")
