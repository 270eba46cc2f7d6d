"""Personal data: patterns with checks, then terms that give a protected value away.

Base finds e-mail addresses, IP addresses, payment cards and phone numbers. The method then asks of every term that
stands in one line with a protected value how much it reveals: over all distinct lines of the corpus, the value's
information left once the term is known is -log2(lines with both / (lines with the term + 1)). The one line more stands
for those not seen, so the fewer lines there are, the more of them must agree. A term seen with the value in two distinct
lines or more that leaves at most ``max_bits`` exceeds the disclosure threshold and is marked wherever it stands; one
line alone says nothing of the two. Lines are counted once however often they are copied.

Everything is DataFrame expressions. Positions come from the gaps between matches, summed in blocks, so a text with
many matches costs no more than its length.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fenced, small, stored

#: Patterns that match what the plain ones would, without retrying inside a run and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: A text without this can't hold the kind.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
KINDS = tuple(PATTERNS)
TERM = r"[\p{L}\p{N}]{2,40}"
BLOCK = 256


def valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(r"^(?:0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def may_hold(text: Column, kind: str) -> Column:
    return F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike(r"[0-9](?:[ -]?[0-9]){13}")


def with_running_sums(df: DataFrame, lengths: str, out: str) -> DataFrame:
    """Adds how much lies before each element of an array of lengths, in blocks so that no step copies more than one."""
    count = F.size(lengths)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((count - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(lengths), b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0)
    inside = lambda block, first: F.aggregate(
        block, F.struct(first.alias("at"), F.array().cast("array<int>").alias("out")), lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"]
    )
    df = df.withColumn("_blocks", F.when(count > 0, blocks))
    df = df.withColumn("_sums", F.transform("_blocks", lambda block: F.aggregate(block, zero, lambda a, x: a + x)))
    starts = F.transform("_sums", lambda _, b: F.aggregate(F.slice("_sums", F.lit(1), b), zero, lambda a, x: a + x))
    return df.withColumn(out, F.flatten(F.zip_with("_blocks", starts, inside))).drop("_blocks", "_sums")


def add_matches(df: DataFrame, text: str, kind: str) -> DataFrame:
    """Adds ``m_kind``: valid matches of one kind in order, as structs of start, end, kind number and value."""
    t = F.col(text)
    there = may_hold(t, kind)
    pattern = PATTERNS[kind]
    df = df.withColumn("_m", F.when(there, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))))
    some = F.size("_m") > 0
    df = df.withColumn("_g", F.when(some, F.split(t, pattern, -1)))
    df = df.withColumn("_l", F.when(some, F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m))))
    df = with_running_sums(df, "_l", "_b")
    number = F.lit(KINDS.index(kind))
    at = lambda m, i: F.get(F.col("_b"), i) + F.length(F.get(F.col("_g"), i))
    spans = F.transform("_m", lambda m, i: F.struct(at(m, i).alias("start"), (at(m, i) + F.length(m)).alias("end"), number.alias("kind"), m.alias("value")))
    spans = F.filter(spans, lambda s: valid(kind, s["value"]))
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    return df.withColumn(f"m_{kind}", F.coalesce(F.when(some, spans), none)).drop("_m", "_g", "_l", "_b")


def base_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, copy, text, one array of spans for each kind, and ``base``, all of them by start and kind."""
    return with_base(docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))


def with_base(df: DataFrame) -> DataFrame:
    """Adds one array of spans of ``text`` for each kind, and ``base``, all of them by start and kind."""
    df = reduce(lambda d, kind: add_matches(d, "text", kind), KINDS, df)
    by_start = F.array_sort(F.transform(F.concat(*[F.col(f"m_{k}") for k in KINDS]), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), s["value"].alias("value"))))
    return df.withColumn("base", by_start)


def terms_of(line: Column) -> Column:
    """Distinct lower-cased terms of a line once the protected values are taken out."""
    bare = reduce(lambda t, kind: F.regexp_replace(t, PATTERNS[kind], " "), KINDS, line)
    return F.array_distinct(F.regexp_extract_all(F.lower(bare), F.lit(TERM), F.lit(0)))


def lines_of(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.explode(F.split(F.col(text_col), "\n")).alias("line")).filter(F.length("line") > 0)


def revealing_terms(docs: DataFrame, text_col: str = "text", max_bits: float = 1.0) -> DataFrame:
    """(term, value, n_both, n_term, bits): terms whose presence leaves at most ``max_bits`` of a value's information.

    Candidates are terms that share two distinct lines or more with one value; only those are then counted
    over the whole corpus. Every step aggregates in parts before its shuffle, so one value in a third of all lines is
    spread like any other.
    """
    lines = lines_of(docs, text_col)
    holding = lines.filter(reduce(lambda a, b: a | b, [may_hold(F.col("line"), k) for k in KINDS]))
    held = reduce(lambda d, kind: d.withColumn(f"v_{kind}", F.when(may_hold(F.col("line"), kind), F.filter(F.regexp_extract_all("line", F.lit(PATTERNS[kind]), F.lit(0)), lambda m: valid(kind, m)))), KINDS, holding)
    values = F.array_distinct(F.flatten(F.array_compact(F.array(*[F.col(f"v_{k}") for k in KINDS]))))
    held = held.select("line", F.xxhash64("line").alias("line_id"), values.alias("values")).filter(F.size("values") > 0)
    held = held.select("line_id", "values", terms_of(F.col("line")).alias("terms"))
    both = held.select("line_id", F.explode("values").alias("value"), "terms").select("line_id", "value", F.explode("terms").alias("term"))
    pairs = both.groupBy("value", "term", "line_id").agg(F.lit(1).alias("one")).groupBy("value", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= 2)
    # A term stands in at least as many lines as it shares with any value, which rules out common words exactly.
    lines_with = held.select("line_id", F.explode("terms").alias("term")).groupBy("term", "line_id").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n_held"))
    pairs = stored(pairs.join(lines_with, "term").filter(F.col("n_both") >= 2.0**-max_bits * (F.col("n_held") + 1)).select("value", "term", "n_both"))
    wanted = stored(pairs.select("term").distinct())
    # A line's terms meet the candidates before anything is shuffled.
    seen = lines.select(F.xxhash64("line").alias("line_id"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("line"), F.lit(TERM), F.lit(0)))).alias("term")).join(small(wanted), "term")
    counts = seen.groupBy("term", "line_id").agg(F.lit(1).alias("one")).groupBy("term").agg(F.count("*").alias("n_term"))
    bits = -F.log2(F.col("n_both") / (F.greatest(F.col("n_term"), F.col("n_both")) + 1))
    return pairs.join(counts, "term").withColumn("bits", bits).filter(F.col("bits") <= max_bits)


def term_spans(docs: DataFrame, terms: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, copy, found): where the given terms stand in each text that has any, as structs of start and end."""
    df = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Rows that hold a listed term at all, by the distinct terms of each text; positions are worked out for them only.
    some = df.select("doc", "copy", "text", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")).join(small(terms), "term")
    per = some.groupBy("doc", "copy").agg(F.collect_set("term").alias("terms"), F.first("text").alias("text"))
    per = per.withColumn("_m", F.regexp_extract_all("text", F.lit(TERM), F.lit(0))).withColumn("_g", F.split("text", TERM, -1))
    per = per.withColumn("_l", F.zip_with(F.slice("_g", F.lit(1), F.size("_m")), "_m", lambda g, m: F.length(g) + F.length(m)))
    per = with_running_sums(per, "_l", "_b")
    at = lambda i: F.get(F.col("_b"), i) + F.length(F.get(F.col("_g"), i))
    spans = F.transform("_m", lambda m, i: F.struct(at(i).alias("start"), (at(i) + F.length(m)).alias("end"), F.array_contains("terms", F.lower(m)).alias("listed")))
    spans = F.transform(F.filter(spans, lambda s: s["listed"]), lambda s: F.struct(s["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), s["end"].alias("end"), F.lit("").alias("value")))
    return per.select("doc", "copy", spans.alias("found"))


def with_reach(df: DataFrame, ends: str, out: str) -> DataFrame:
    """Adds for each element of an array of ends the furthest of those before it, 0 for the first, in blocks like running sums."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(ends) - 1) / BLOCK).cast("int")), lambda b: F.slice(F.col(ends), b * BLOCK + 1, F.lit(BLOCK)))
    df = df.withColumn("_blocks", F.when(F.size(ends) > 0, blocks))
    df = df.withColumn("_most", F.transform("_blocks", lambda block: F.array_max(block)))
    first = F.transform("_most", lambda _, b: F.coalesce(F.array_max(F.slice("_most", F.lit(1), b)), F.lit(0)))
    inside = lambda block, before: F.transform(block, lambda _, i: F.greatest(before, F.coalesce(F.array_max(F.slice(block, F.lit(1), i)), F.lit(0))))
    return df.withColumn(out, F.flatten(F.zip_with("_blocks", first, inside))).drop("_blocks", "_most")


def with_spans(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Adds ``spans``: the base ones and the method's that overlap none of them, by start and kind.

    Terms never overlap each other, so one overlaps a base span if the furthest base end before it, or the base span
    next after it, reaches into it.
    """
    extra = extra.select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "found")
    df = base.join(extra, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy")), "left").drop("_doc", "_copy")
    df = df.withColumn("_all", F.when(F.col("found").isNotNull(), F.array_sort(F.concat("base", "found")))).drop("found")
    of_term = lambda x: x["kind"] == len(KINDS)
    df = df.withColumn("_ends", F.transform("_all", lambda x: F.when(of_term(x), F.lit(0)).otherwise(x["end"])))
    df = with_reach(df, "_ends", "_before").drop("_ends")
    follows = lambda i: F.get(F.col("_all"), i + 1)
    clear = F.filter("_all", lambda x, i: ~of_term(x) | ((F.get(F.col("_before"), i) <= x["start"]) & F.coalesce(of_term(follows(i)) | (follows(i)["start"] >= x["end"]), F.lit(True))))
    return df.withColumn("spans", F.coalesce(clear, F.col("base"))).drop("_all", "_before")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: float = 1.0) -> DataFrame:
    """One row for each row of ``docs``: id, base and spans (arrays of start, kind, end, value), and counts by kind.

    Kinds are numbered as in KINDS, then ``term``; positions are code points, the end exclusive; spans of one start come
    by kind. Null or empty texts have no spans; texts of any length are read whole, in time in proportion to their length;
    repeated rows, and rows without an id, each get their row; an empty table gives an empty one; other columns, whatever
    their names, are ignored. The method's spans that overlap a base one are left out, so every base span stays as it is.
    """
    terms = stored(revealing_terms(docs, text_col, max_bits).select("term").distinct())
    base = base_spans(docs, id_col, text_col).select("doc", "copy", "base", *[F.size(f"m_{k}").cast("long").alias(f"n_{k}") for k in KINDS])
    found = with_spans(base, term_spans(docs, terms, id_col, text_col))
    return fenced(found.select(F.col("doc").alias(id_col), *[f"n_{k}" for k in KINDS], "base", "spans"))


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Characters of a stretch of a text in which pieces are looked up.
STRETCH = 1024


def piece(cut: str, x: Column) -> Column:
    """The text between ``from`` and ``to`` of a part, from the column of stretches, so that no part is looked for from the beginning."""
    a, b = (F.floor(x[c] / STRETCH).cast("int") for c in ("from", "to"))
    at = lambda k: F.coalesce(F.get(F.col(cut), k), F.lit(""))
    between = F.when(b > a + 1, F.array_join(F.slice(F.col(cut), a + 2, F.greatest(b - a - 1, F.lit(0))), "")).otherwise(F.lit(""))
    over = F.concat(F.substring(at(a), x["from"] % STRETCH + 1, F.lit(STRETCH)), between, F.substring(at(b), F.lit(1), x["to"] % STRETCH))
    return F.when(a == b, F.substring(at(a), x["from"] % STRETCH + 1, x["to"] - x["from"])).otherwise(over)


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: float = 1.0) -> DataFrame:
    """``docs`` with every span in ``text`` generalised to its kind in brackets; all columns and rows stay.

    Overlapping spans become one, named after the first. Null text stays null; texts without spans are unchanged; texts
    of any length are read whole, in time in proportion to their length. Rows without an id and repeated rows are
    treated like others, an empty table gives an empty one, and other columns keep their values, whatever their names.
    """
    terms = stored(revealing_terms(docs, text_col, max_bits).select("term").distinct())
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")  # no name of the caller's meets one of ours
    df = docs.select(row, F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = with_base(df).drop(*[f"m_{k}" for k in KINDS])
    df = with_spans(df, term_spans(docs, terms, id_col, text_col)).drop("base")
    df = with_reach(df.withColumn("_ends", F.transform("spans", lambda s: s["end"])), "_ends", "_before")
    # A part begins at each span that starts beyond all ends before it; the text between is kept.
    first = F.filter(F.sequence(F.lit(0), F.size("spans") - 1), lambda i: F.get(F.col("spans"), i)["start"] >= F.get(F.col("_before"), i))
    df = df.withColumn("_at", F.when(F.size("spans") > 0, first))
    span = lambda i: F.get(F.col("spans"), i)
    df = df.withColumn("_parts", F.transform("_at", lambda i: F.struct(F.get(F.col("_before"), i).alias("from"), span(i)["start"].alias("to"), span(i)["kind"].alias("kind"))))
    end = F.struct(F.array_max("_ends").alias("from"), F.length("text").alias("to"), F.lit(None).cast("int").alias("kind"))
    df = df.withColumn("_parts", F.when(F.size("_at") > 0, F.concat("_parts", F.array(end)))).drop("_at", "_before", "_ends", "spans")
    df = df.withColumn("_cut", F.when(F.col("_parts").isNotNull(), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))))
    labels = F.array(*[F.lit(f"[{k.upper()}]") for k in (*KINDS, "term")])
    clean = F.array_join(F.transform("_parts", lambda x: F.concat(piece("_cut", x), F.coalesce(F.get(labels, x["kind"]), F.lit("")))), "")
    df = fenced(df.select("row", F.when(F.col("_parts").isNotNull(), clean).otherwise(F.col(f"row.`{text_col}`")).alias("clean")))
    return df.select(*[(F.col("clean") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
