"""The corpus operators against plain versions, and on awkward tables."""

import pytest
from pyspark.sql import functions as F

from evidentia.llm import queries as Q
from evidentia.llm import substrings
from evidentia.llm.bpe import Codec, bpe_decode, bpe_round_trip
from evidentia.llm.components import connected_components
from evidentia.llm.decontaminate import decontaminate
from evidentia.llm.html import extract_main_text, main_text
from evidentia.llm.jaccard import similar_documents
from evidentia.llm.langid import fit, identify, train
from evidentia.llm.licenses import scan_licenses
from evidentia.llm.pii import find_personal_data, redact, spelled
from evidentia.llm.quality import judge_quality
from evidentia.llm.substrings import remove_repeats
from evidentia.llm.unigram import Counter, token_counts, vocabulary

from . import brute

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars long, words string, copy string, hash long"


@pytest.fixture(scope="module")
def texts(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, repeated rows, and columns with names that the operators use."""
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 2000
    own = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, long), (5, long), (6, "a@b.co and 10.0.0.1, +49 30 1234567 or 4111 1111 1111 1111"), (7, "one two"), (8, "ONE two"), (9, "x" * 100_000), (10, "license a" + ".a" * 60_000 + " \U0001f600")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", None, None, "w", "c", 0) for i, t in own], FORM)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def by_id(df, n):
    return {r[0]: tuple(r)[1 : 1 + n] for r in df.collect()}


def test_bpe_matches_the_library(spark, texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json"))
    own = [t for _, t in texts] + ["", "a" * 9000, " " * 5000, "'" * 3000 + "re" * 900, "x<|endoftext|> y", "\n \n" * 3000, "日本語 текст ² ½ ͸\U0001f600"]
    codec = Codec(Q.tokenizer_file("byte_bpe_50k.json"))
    for found, wanted in zip(codec.encode_all(own), tokenizer.encode_batch(own, add_special_tokens=False)):
        ids = memoryview(found).cast("i").tolist()
        assert ids == wanted.ids
        import numpy as np

        assert codec.decode(np.array(ids, np.int64)) == tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_on_awkward_rows(awkward, empty):
    path = Q.tokenizer_file("byte_bpe_50k.json")
    for r in bpe_decode(bpe_round_trip(awkward, path, decode=False), path).collect():
        assert r["decoded"] == (r["text"] or "")
    assert bpe_round_trip(empty, path).count() == 0


def test_token_counts_match_the_library(awkward, empty, texts):
    from tokenizers import Tokenizer, models, pre_tokenizers

    path = Q.tokenizer_file("piece_bpe_32k.model")
    pieces = vocabulary(path)
    tokenizer = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(prepend_scheme="always")
    own = [t for _, t in texts][:60] + ["", " ", " a", "a  b ", "▁a", "日本 ͸\U0001f600", "x" * 3000]
    counter = Counter(pieces)
    assert [counter.count(t) for t in own] == [len(e.ids) for e in tokenizer.encode_batch(own, add_special_tokens=False)]
    found = token_counts(awkward, path)
    assert found.count() == awkward.count() and found.filter("doc_id <= 2").agg(F.sum("n_tokens")).first()[0] == 0
    assert token_counts(empty, path).count() == 0


def test_personal_data(spark, texts, awkward, empty):
    found = find_personal_data(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", spelled("base"))
    assert by_id(found, 5) == {i: (*brute.pii(t)[0], brute.pii(t)[1]) for i, t in texts}
    odd = find_personal_data(awkward)
    assert odd.count() == awkward.count()
    assert [tuple(r) for r in odd.filter("doc_id = 6").select("n_email", "n_ip", "n_card", "n_phone").collect()] == [(1, 1, 1, 1)]
    assert find_personal_data(empty).count() == 0
    clean = redact(awkward)
    assert clean.columns == awkward.columns and clean.count() == awkward.count()
    assert clean.filter("doc_id = 6").first()["text"] == "[EMAIL] and [IP], [PHONE] or [CARD]"
    assert clean.filter("doc_id = 1").first()["text"] is None


def test_terms_that_give_a_value_away(spark):
    lines = [(i, f"filler{i} agent zzyzx wrote from spy@home.org on day{i}") for i in range(8)] + [(100 + i, f"plain agent words from day{i}") for i in range(30)]
    docs = spark.createDataFrame(lines, "doc_id long, text string")
    marked = {r["doc_id"]: r["s"] for r in find_personal_data(docs).select("doc_id", spelled("spans").alias("s")).collect()}
    assert "term" in marked[0] and marked[100] == ""
    assert "zzyzx" not in redact(docs).filter("doc_id = 3").first()["text"]


def test_terms_beside_a_value_in_few_lines(spark):
    lines = [f"filler{i} qwxyz bo wrote from rare@home.org" for i in range(2)] + [f"single{i} once from one{i}@home.org" for i in range(2)] + [f"plain words wrote from day{i}" for i in range(9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in redact(docs).collect()}
    assert clean == {0: "filler0 [TERM] [TERM] wrote from [EMAIL]", 1: "filler1 [TERM] [TERM] wrote from [EMAIL]", 2: "single0 once from [EMAIL]", 3: "single1 once from [EMAIL]"} | {i: lines[i] for i in range(4, 13)}


def test_pii_spans_in_runs(spark):
    own = [(0, "a@b.c_d@e.f 1.2.3.4.5.6.7.8 256.1.1.1 x@y " + "1." * 500), (1, " ".join(f"{i % 256}.0.0.1" for i in range(1500)))]
    found = find_personal_data(spark.createDataFrame(own, "doc_id long, text string")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", spelled("base"))
    assert by_id(found, 5) == {i: (*brute.pii(t)[0], brute.pii(t)[1]) for i, t in own}


def test_personal_data_in_a_text_full_of_it(spark):
    text = "".join(f"m{i}é@x.org, " for i in range(30_000))
    form = "doc_id long, text string, _t string, _k string, _c long, _s string, m_email string, row string, doc long, found string, base string, spans string"
    docs = spark.createDataFrame([(1, text, "t", "k", 3, "s", "m", "r", 4, "f", "b", "p"), (None, "to a@b.co" + " x" * 2000 + " +49 30 1234567", *[None] * 10)], form)
    clean = {r["doc_id"]: r for r in redact(docs).collect()}
    assert clean[1]["text"] == text  # no address: the character before the sign isn't one of its
    assert tuple(clean[1])[2:] == ("t", "k", 3, "s", "m", "r", 4, "f", "b", "p") and clean[None]["text"] == "to [EMAIL]" + " x" * 2000 + " [PHONE]"
    many = spark.createDataFrame([(1, "".join(f"m{i}@x.org, " for i in range(30_000)))], "doc_id long, text string")
    assert redact(many).first()["text"] == "[EMAIL], " * 30_000 and find_personal_data(many).first()["n_email"] == 30_000


def test_quality(spark, texts, awkward, empty):
    found = judge_quality(spark.read.parquet(f"{SF}/documents.parquet")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_id(found, 6) == {i: brute.quality(t) for i, t in texts}
    odd = judge_quality(awkward)
    assert odd.count() == awkward.count() and odd.filter("kept AND base_failed").count() == 0
    assert judge_quality(empty).count() == 0


def test_decontamination(spark, texts, awkward, empty):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontaminate(docs, items).select("doc_id", "n_words", "n_hit", "n_items", Q.sha_hex(F.array_join("item_ids", ",")), "contaminated")
    wanted = brute.decontaminated([t for _, t in texts], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert by_id(found, 5) == {i: w for (i, _), w in zip(texts, wanted)}
    short = spark.createDataFrame([(1, "One, TWO"), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    odd = decontaminate(awkward, short).select("doc_id", "n_words", "n_hit", "n_items")
    own = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    wanted = brute.decontaminated([t for _, t in own], [tuple(r) for r in short.collect()])
    assert sorted(tuple(r) for r in odd.collect()) == sorted((i, *w[:3]) for (i, _), w in zip(own, wanted))
    assert decontaminate(empty, short).count() == 0 and decontaminate(awkward, short.limit(0)).filter("contaminated").count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 25])
def test_repeated_passages(spark, texts, awkward, empty, limit):
    found = remove_repeats(spark.read.parquet(f"{SF}/documents.parquet"), broadcast_limit=limit).select("doc_id", "n_words", "n_removed", Q.sha_hex(F.col("kept_text")))
    assert by_id(found, 3) == brute.repeats_removed(texts)
    odd = remove_repeats(awkward, broadcast_limit=limit)
    assert odd.count() == awkward.count()
    assert odd.filter("doc_id = 5").first()["n_removed"] == 28000 and odd.filter("doc_id = 4").first()["n_removed"] == 0
    assert remove_repeats(empty, broadcast_limit=limit).count() == 0


@pytest.mark.parametrize(("length", "share"), [(13, 1), (13, 20), (50, 1), (50, 4096), (1, 4096), (2, 4096)])
def test_repeated_passages_by_levels(spark, monkeypatch, length, share):
    """One level, several and the shortest; with windows that all, some or none count as hot."""
    monkeypatch.setattr(substrings, "HOT_SHARE", share)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(base[:60] + [f"d{i}x{k}" for k in range(40)] + base[60 + i : 60 + i + 3 * (i % 25)])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " ".join(base)), (103, " ".join(base[:60] * 3))]
    found = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length).select("doc_id", "n_words", "n_removed", Q.sha_hex(F.col("kept_text")))
    assert by_id(found, 3) == brute.repeats_removed(rows, length)


def test_repeated_passages_without_candidates(spark):
    rows = [(i, " ".join(f"d{i}x{k}" for k in range(80))) for i in range(5)] + [(None, " ".join(f"d0x{k}" for k in range(80)))]
    found = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=50).collect()}
    assert found == {i: (80, 0) for i in (0, 1, 2, 3, 4, None)}


def near_copies(n):
    base = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for k in range(1, n):
        own = list(base)
        own[(7 * k) % 190] = f"new{k}"
        if k % 5 == 0:
            own[(11 * k) % 190 + 5] = f"other{k}"
        rows.append((k, " ".join(own)))
    return rows + [(1000 + k, f"p{k} q{k} r{k}") for k in range(20)] + [(2000, "P1 q1 R1")]


def test_similar_documents(spark, texts, awkward, empty):
    columns = ("doc_id", "n_shingles", "component_id", "n_links")
    found = similar_documents(spark.read.parquet(f"{SF}/documents.parquet")).select(*columns)
    assert by_id(found, 3) == brute.components(texts)
    odd = similar_documents(awkward).select("doc_id", "component_id")
    assert odd.count() == awkward.count() and {tuple(r) for r in odd.collect()} >= {(1, 1), (2, 2), (5, 4), (8, 7)}
    assert similar_documents(empty).count() == 0


@pytest.mark.parametrize(("rows", "percent"), [(60, 90), (400, 90), (150, 70)])
def test_similar_documents_in_large_groups(spark, rows, percent):
    rows = near_copies(rows)  # more than a block holds, and shingles that more than FEW share
    found = similar_documents(spark.createDataFrame(rows, "doc_id long, text string"), percent=percent).select("doc_id", "n_shingles", "component_id", "n_links")
    assert by_id(found, 3) == brute.components(rows, percent)


def test_similar_documents_without_ids_or_with_repeated_ones(spark):
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(None, text), (7, text), (7, text), (7, "other words stand here"), (9, text + " end"), (9, None)], "doc_id long, text string")
    found = sorted(((r["doc_id"] or 0, r["n_shingles"], r["class_id"], r["component_id"], r["n_links"]) for r in similar_documents(docs).collect()))
    assert found == [(0, 58, None, None, None), (7, 2, 7, 7, 0), (7, 58, 7, 7, 1), (7, 58, 7, 7, 1), (9, 0, 9, 9, 0), (9, 59, 9, 7, 1)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and found[102] == 100


def test_main_text(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>"</script></head><body><header>Top</header><nav><ul><li><a href=x>Menu</a></li></ul></nav>
    <div class="cookie-notice">We use cookies</div><article><h1>Head &amp; line</h1><p><b>First  one.<br><p>Second,\n one &eacute;</p><form>Sign up</form><aside>Side</aside></article>
    <section id="comments"><p>A reader wrote, at length, nothing.</p></section><footer>&copy; x</footer>"""
    assert main_text(page) == "Head & line\n\nFirst one.\n\nSecond, one é"
    body = "<html><body><div id=nav><a href=a>one</a> <a href=b>two</a></div><div id=main><p>" + "Long text, with commas, and words. " * 5 + "</p><p>" + "More text, again, and again. " * 5 + "</p></div><div class=footer>end</div></body></html>"
    assert main_text(body).count("\n\n") == 1 and "one" not in main_text(body).split()
    assert main_text("") == "" and main_text("<p>") == ""
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, "u", "", "x"), (3, "u", page, "x")], "page_id long, url string, html string, text string")
    assert [r["text"] for r in extract_main_text(pages).orderBy("page_id").collect()][:2] == ["", ""]
    assert extract_main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("other", ['<article class="comment"><p>A reader wrote, at length, nothing.</p></article>', "<article><h3>Next</h3><p>A teaser, short.</p></article>"])
def test_main_text_beside_the_only_article(other):
    entry = "<p>" + "Long text, with commas, and words. " * 5 + "</p><p>" + "More text, again, and again. " * 5 + "</p>"
    found = main_text(f'<html><body><div class="entry">{entry}</div>{other}</body></html>')
    assert found.startswith("Long text") and found.count("\n\n") == 1 and "reader" not in found and "teaser" not in found


def test_main_text_of_an_article_in_sections():
    parts = "".join(f"<section><h2>Part {i}</h2><div><p>{'Words, and more of them. ' * n}</p></div></section>" for i, n in enumerate((30, 1, 2)))
    found = main_text(f"<body><article><h1>Title</h1>{parts}</article><div><p>Beside it.</p></div></body>")
    assert found.startswith("Title") and found.count("Part") == 3 and found.count("Words") == 33 and "Beside" not in found


@pytest.mark.parametrize("name", ["content has-sidebar", "site-content no-sidebar", "page with-sidebar", "single-post search", "search"])
def test_main_text_in_a_wrapper_named_like_an_aside(name):
    entry = "<p>" + "Long text, with commas, and words. " * 5 + "</p><p>" + "More text, again, and again. " * 5 + "</p>"
    found = main_text(f'<body><div class="site-footer"><p>Imprint.</p></div><div class="{name}"><div class="entry">{entry}</div><div class="cookie-notice"><p>We use cookies.</p></div></div></body>')
    assert found.startswith("Long text") and found.count("\n\n") == 1 and "cookies" not in found and "Imprint" not in found


def test_main_text_keeps_headers_of_the_article_only():
    body = "<p>" + "Long text, with commas, and words. " * 5 + "</p>"
    assert main_text(f"<body><header><p>Site</p></header><article><header><h1>Title</h1></header>{body}</article></body>").split("\n\n")[0] == "Title"
    assert main_text(f'<body><article><div class="entry-header"><h1>Title</h1></div>{body}</article></body>').startswith("Title")


def test_main_text_without_long_comments():
    body, thread = "<p>" + "Long text, with commas, and words. " * 5 + "</p>", "<p>" + "A reader, who wrote, at length. " * 9 + "</p>"
    assert "reader" not in main_text(f'<body><article>{body}</article><div id="comments" class="comment-list">{thread * 9}</div></body>')


@pytest.mark.parametrize("junk", ["<b>", "<b>x ", "<div>", "<p><font>", "<div><header>", "<b><td>", "</b>", "<a ", "<!--", "<", "<select><option>"])
def test_main_text_among_many_open_tags(junk):
    """Time in proportion to the page: 200,000 characters of junk end within seconds, and text before them stays."""
    import time

    body, start = "<p>" + "Long text, with commas, and words. " * 20 + "</p>", time.time()
    assert main_text(f"<article>{body}</article>" + junk * (200_000 // len(junk))).startswith("Long text, with commas")
    assert time.time() - start < 30


def test_main_text_with_stray_ends():
    body = "Long text, with commas, and words. " * 5
    assert main_text(f"<article><b><table><tr><td>{body}</b> still</td></tr></table></b><p>next, one</p></article>").endswith("still\n\nnext, one")
    assert main_text(f"<article><p>{body}<i>in</p><p>next</i> more</p></article>").endswith("in\n\nnext more")


def test_languages(spark, awkward, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", F.crc32(F.col("doc_id").cast("string")) % 5 == 0)
    model = train(docs.filter("NOT held"))
    found = identify(docs.filter("held"), model)
    assert found.filter("lang_pred = lang").count() >= 0.97 * found.count()
    odd = {(r["doc_id"], r["lang_pred"]) for r in identify(awkward, model).filter("doc_id <= 3").collect()}
    assert odd == {(1, "und"), (2, "und"), (3, "und")}
    assert identify(awkward, fit([], [])).filter("lang_pred <> 'und' OR score <> 0").count() == 0
    assert identify(empty, train(empty)).count() == 0


def test_licenses(spark):
    files = [
        ("a/LICENSE", "Released under the MIT License."), ("a/b/c/code.py", "print(1)"), ("a/b/own.py", "code\nLicensed under the Apache License, Version 2.0.\nmore words here in this file and more"),
        ("d/e.txt", "nothing"), ("x.txt", None), (None, "Released under the MIT License."), ("a/b/c/code.py", "print(1)"), ("a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."), ("top.txt", ""),
    ]
    docs = spark.createDataFrame(files, "path string, text string")
    found = sorted((str(r["path"]), r["license"], r["origin"], r["from_path"]) for r in scan_licenses(docs, "path", "text").collect())
    assert found == sorted([
        ("a/LICENSE", "MIT", "file", None), ("a/b/c/code.py", "GPL-3.0", "inherited", "a/b/COPYING"), ("a/b/c/code.py", "GPL-3.0", "inherited", "a/b/COPYING"), ("a/b/own.py", "Apache-2.0", "header", None),
        ("d/e.txt", None, "none", None), ("x.txt", None, "none", None), ("None", None, "none", None), ("a/b/COPYING", "GPL-3.0", "file", None), ("top.txt", None, "none", None),
    ])
    assert {(p, o) for p, _, o, _ in found} >= {("a/b/c/code.py", "inherited"), ("a/b/own.py", "header"), ("a/LICENSE", "file"), ("d/e.txt", "none")}
    assert scan_licenses(docs.limit(0), "path", "text").count() == 0


def test_licenses_over_line_ends_and_in_files(spark):
    prose = "This line tells of other things that the program does and how it does them. " * 40
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software\nand associated documentation files (the Software), to deal in the Software without restriction"
    texts = [
        ("Apache-2.0", f"Copyright 2020 Foo Inc. Licensed under the Apache License, Version 2.0. All other rights reserved by nobody at all in this place. {prose}"), ("MIT", f"{prose} {mit} {prose}"),
        ("MIT", f"# SPDX-License-Identifier: MIT\n{prose}"), ("Apache-2.0", f"// SPDX-License-Identifier: Apache-2.0\n{prose}"), ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n{prose}"),
        ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991\n\n{prose}"), ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n{prose}"), ("Apache-2.0", f"# Licensed under the Apache\n# License, Version\n# 2.0.\n{prose}"),
        (None, f"{prose}\nA driving license is asked for.\n{prose}"), (None, f"SPDX-License-Identifier: Zlib\n{prose}"),
    ]
    docs = spark.createDataFrame([(f"{i}/x.py", t) for i, (_, t) in enumerate(texts)], "path string, text string")
    found = {r["path"]: r["license"] for r in scan_licenses(docs, "path", "text").collect()}
    assert found == {f"{i}/x.py": name for i, (name, _) in enumerate(texts)}


def test_pipeline(spark):
    import corpus_pipeline as P

    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in P.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, SF)
        assert docs.columns == list(P.COLUMNS), name
        assert docs.count() <= before.count()
    assert P.run(spark, SF).count() == docs.count()


def test_pipeline_drops_copies_with_a_replaced_block(spark):
    import corpus_pipeline as P

    base = [f"w{i}" for i in range(200)]
    block = base[:80] + [f"new{i}" for i in range(15)] + base[95:]  # 0.82 of the runs of five words, 0.84 of those of three
    far = base[:60] + [f"other{i}" for i in range(60)] + base[120:]
    docs = spark.createDataFrame([(i, " ".join(t), "en", "s", 0) for i, t in enumerate((base, block, far))], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in P.near_copies(spark, docs, SF).collect()) == [0, 2]
