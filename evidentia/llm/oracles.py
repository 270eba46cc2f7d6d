"""SQL for DuckDB of the corpus queries that SQL can express over whole tables, written from the contracts alone."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Every window of ten words of an item (all of a shorter one) is looked for in every document, as text.
DECONTAMINATED = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') AS words FROM benchmark),
item AS (SELECT item_id, words, least(len(words), 10) AS k FROM b WHERE len(words) > 0),
listed AS (SELECT DISTINCT item_id, k, array_to_string(words[i + 1:i + k], ' ') AS run FROM (SELECT item_id, k, words, unnest(range(0, len(words) - k + 1)) AS i FROM item)),
sizes AS (SELECT DISTINCT k FROM listed),
place AS (SELECT doc_id, k, words, unnest(range(0, len(words) - k + 1)) AS i FROM d, sizes WHERE len(words) >= k),
own AS (SELECT doc_id, k, i, array_to_string(words[i + 1:i + k], ' ') AS run FROM place),
hit AS (SELECT doc_id, own.k, i, item_id FROM own JOIN listed ON own.k = listed.k AND own.run = listed.run),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
held AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS varchar) AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON covered.doc_id = d.doc_id LEFT JOIN held ON held.doc_id = d.doc_id
"""

#: Every window of thirteen words of every document, as text, with the smallest document that holds it.
REPEATS = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
place AS (SELECT doc_id, words, unnest(range(0, len(words) - 12)) AS i FROM d WHERE len(words) >= 13),
own AS (SELECT doc_id, i, array_to_string(words[i + 1:i + 13], ' ') AS run FROM place),
first AS (SELECT run, min(doc_id) AS least FROM own GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM own JOIN first ON own.run = first.run WHERE least < doc_id),
each AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS p FROM d),
kept AS (SELECT each.doc_id, count(gone.p) AS n_removed, string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY each.p) AS text FROM each LEFT JOIN gone ON gone.doc_id = each.doc_id AND gone.p = each.p GROUP BY each.doc_id)
SELECT d.doc_id, CAST(len(words) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

ORACLES = {"op6_decontaminate": DECONTAMINATED, "op7_substrings": REPEATS}
