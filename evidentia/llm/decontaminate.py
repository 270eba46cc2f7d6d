"""Benchmark decontamination: training windows probed against a hash set of benchmark n-grams.

A window of ``n`` words holds, wherever a document has it, one of the document's blocks of (n + 1) // 2 words that begin
at multiples of that length. So each document is scanned once by its blocks, a tenth of the hashing that all its windows
would take; they probe the set of benchmark runs of that length, which is broadcast (behind a size check; beyond it the
narrow rows of blocks are shuffled). Only windows around a block that was found are then hashed and probed against the
benchmark's windows, and hits are verified word by word in the document they came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: A word is a run of ASCII letters and digits and any characters beyond ASCII; all others part words.
PARTING = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normal_words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none. One pass over the characters and a plain split, no pattern."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), PARTING + UPPER, " " * len(PARTING) + UPPER.lower()), " "), "")


def run_hash(words: Column, start: Column, length: int) -> Column:
    """Hash of ``length`` words from the given one (0 is the first) on; runs of other lengths have other hashes."""
    return F.xxhash64(F.lit(length), *[F.get(words, start + k) for k in range(length)])


def run_text(words: Column, start: Column, length: int) -> Column:
    """The same words joined by a space, which no word holds."""
    return F.concat_ws(" ", *[F.get(words, start + k) for k in range(length)])


def benchmark_windows(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct (hash, length, window, item): windows of ``n`` words, or all of a shorter item, as words joined by a space."""
    cut = items.select(F.col(id_col).cast("string").alias("item"), normal_words(F.col(text_col)).alias("words")).filter(F.size("words") > 0)
    words, size = F.col("words"), F.size("words")
    window = lambda at, k: F.struct(run_hash(words, at, k).alias("hash"), F.lit(k).alias("length"), run_text(words, at, k).alias("window"))
    found = F.when(size >= n, F.transform(F.sequence(F.lit(0), F.greatest(size - n, F.lit(0))), lambda at: window(at, n)))
    for k in range(1, n):
        found = found.when(size == k, F.array(window(F.lit(0), k)))
    return cut.select("item", F.explode(found).alias("x")).select("item", "x.hash", "x.length", "x.window").distinct()


def block_runs(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct hashes of the runs that a block within a window may be."""
    words = windows.select("length", F.split("window", " ").alias("words"))
    runs = F.array().cast("array<bigint>")
    for k in lengths:
        b = (k + 1) // 2
        runs = F.when(F.col("length") == k, F.array(*[run_hash(F.col("words"), F.lit(at), b) for at in range(k - b + 1)])).otherwise(runs)
    return words.select(F.explode(runs).alias("run")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, item_ids, spans and contaminated.

    ``spans`` holds the hit windows in order (first word, end exclusive), ``item_ids`` the items whose windows occur,
    sorted as strings. Null or empty texts have no words and no hits; texts of any length are read whole; items without
    words or ids match nothing by themselves (an item's null id is left out of ``item_ids``); items with the same window
    all count; an empty benchmark leaves every document clean; an empty table gives an empty one; repeated rows, and rows
    without an id, each get their row; other columns, whatever their names, are ignored.
    """
    windows = stored(benchmark_windows(items, n, item_id_col, item_text_col))
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())  # n values at most
    blocks = sorted({(k + 1) // 2 for k in lengths})
    known = stored(block_runs(windows, lengths))
    plain = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("t"))
    text = plain.select("doc", "copy", normal_words(F.col("t")).alias("words"))
    of_block = lambda b: F.transform(F.sequence(F.lit(0), F.floor(F.size("words") / b).cast("int")), lambda i: F.struct((i * b).alias("at"), F.when((i + 1) * b <= F.size("words"), run_hash(F.col("words"), i * b, b)).alias("run")))
    # One element without a hash stands for the row itself.
    own = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("bigint").alias("run")))
    seen = text.select("doc", "copy", F.size("words").alias("n_words"), F.concat(own, *map(of_block, blocks)).alias("runs"))
    # The words stay behind. An inner explode() would add a filter on the array, which, pushed down, works it out for each element.
    seen = seen.select("doc", "copy", "n_words", F.explode_outer("runs").alias("x")).select("doc", "copy", "n_words", "x.at", "x.run")
    met = seen.filter((F.col("at") < 0) | F.col("run").isNotNull()).join(small(known.select(F.col("run").alias("_run"))), F.col("run") == F.col("_run"), "left").filter((F.col("at") < 0) | F.col("_run").isNotNull())
    rows = stored(met.groupBy("doc", "copy").agg(F.max("n_words").alias("n_words"), F.sum((F.col("at") < 0).cast("int")).alias("rows"), F.array_sort(F.collect_set(F.when(F.col("at") >= 0, F.col("at")))).alias("found")))
    some = stored(rows.filter(F.size("found") > 0).select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "found"))
    same_row = F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("copy") == F.col("_copy"))
    texts = plain.join(small(some), same_row).select("doc", "copy", "t", "found").dropDuplicates(["doc", "copy"])
    texts = stored(texts.select("doc", "copy", normal_words(F.col("t")).alias("words"), "found"))

    # A window lies around a block: it begins so far before the block's first word that it still holds the block.
    around = lambda k: F.array_distinct(F.flatten(F.transform("found", lambda at: F.sequence(F.greatest(at - (k - (k + 1) // 2), F.lit(0)), at))))
    fits = lambda k: F.filter(around(k), lambda at: at + k <= F.size("words"))
    nothing = F.array().cast("array<struct<start:int,length:int,hash:bigint>>")
    probes = F.concat(nothing, *[F.transform(fits(k), lambda at: F.struct(at.alias("start"), F.lit(k).alias("length"), run_hash(F.col("words"), at, k).alias("hash"))) for k in lengths])
    tried = texts.select("doc", "copy", probes.alias("probes")).select("doc", "copy", F.explode_outer("probes").alias("x")).select("doc", "copy", "x.start", "x.length", "x.hash")
    listed = windows.select("hash", "length", "window").distinct()
    near = tried.join(small(stored(listed)), ["hash", "length"]).groupBy("doc", "copy").agg(F.collect_set(F.struct("start", "length", "window")).alias("near"))
    near = stored(near).withColumnRenamed("doc", "_doc").withColumnRenamed("copy", "_copy")
    true = F.filter("near", lambda x: F.coalesce(*[F.when(x["length"] == k, run_text(F.col("words"), x["start"], k)) for k in lengths], F.lit("")) == x["window"])
    hits = stored(texts.join(small(near), same_row).select("doc", "copy", F.array_sort(true).alias("hits")).filter(F.size("hits") > 0))
    each = hits.select("doc", "copy", F.explode(F.array_distinct(F.transform("hits", lambda x: x["window"]))).alias("window")).join(small(windows.select("window", "item").distinct()), "window")
    held = each.groupBy("doc", "copy").agg(F.array_sort(F.collect_set("item")).alias("item_ids")).withColumnRenamed("doc", "_doc").withColumnRenamed("copy", "_copy")
    # Hits are sorted, so a hit adds what lies beyond the furthest end before it.
    spans = F.array_distinct(F.transform("hits", lambda x: F.struct(x["start"].alias("start"), (x["start"] + x["length"]).alias("end"))))
    covered = F.aggregate(
        "spans", F.expr("struct(0 AS n, 0 AS reach)"), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["start"], a["reach"]))).alias("n"), F.greatest(a["reach"], x["end"]).alias("reach")), lambda a: a["n"]
    )
    told = hits.withColumn("spans", spans).select("doc", "copy", "spans", covered.alias("n_hit")).join(held, same_row, "left").select(F.col("doc").alias("_doc"), F.col("copy").alias("_copy"), "spans", "n_hit", "item_ids")
    out = rows.select("doc", "copy", "n_words", "rows").join(small(stored(told)), same_row, "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    ids = none("item_ids", "array<string>")
    return out.select(
        F.col("doc").alias(id_col), F.col("n_words").cast("long").alias("n_words"), hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        none("spans", "array<struct<start:int,end:int>>").alias("spans"), (hit > 0).alias("contaminated"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    ).drop("_row")
