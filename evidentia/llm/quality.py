"""Quality rules: counts of one text, then its distance from what its language usually looks like.

Each language's reference is gathered from the whole corpus: the shares of character classes, and of its common words
(those that make up at least ``min_share`` of its words, so never more than 1 / min_share of them; all others are one
bin). A text is compared with both by Jensen-Shannon distance, unless it is too short to tell. Rows without a language
are compared with the whole corpus.

A language's reference is one row of bounded size, so every text is judged where it lies: its words find their place in
the reference by a table of hash slots, are sorted by place, and counted in runs. No word of a text is shuffled but for
the corpus counts, which are summed in parts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, fenced, stored, stored_bytes

BLANKS = " \t\n\x0b\x0c\r"
#: Character classes by what a text loses without them, the most frequent first; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "blank": r"[\x20\x09-\x0D]+", "beyond": r"[\x{80}-\x{10FFFF}]+", "upper": "[A-Z]+", "digit": "[0-9]+", "symbol": "[#*$%&|<>]+"}
NAMES = (*CLASSES, "other")
ALL = "*"
#: Hash slots of a language's common words; parts of a language where references are too many to broadcast.
SLOTS, SALTS = 2048, 64


def words_of(text: Column) -> Column:
    """Runs of characters that aren't ASCII white space; null has none. A plain split, no pattern."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), BLANKS[1:], " " * (len(BLANKS) - 1)), " "), "")


def with_classes(df: DataFrame, text: str) -> DataFrame:
    """Adds ``chars`` and how many of them are of each class; each class is taken out of what the ones before have left."""
    df = df.withColumn("_left", F.col(text)).withColumn("chars", F.length(text).cast("long"))
    for name, pattern in CLASSES.items():
        df = df.withColumn("_next", F.regexp_replace("_left", pattern, "")).withColumn(name, (F.length("_left") - F.length("_next")).cast("long")).drop("_left").withColumnRenamed("_next", "_left")
    return df.withColumn("other", F.length("_left").cast("long")).drop("_left")


def with_repeated_words(df: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many words lie in three-word windows that occur twice or more in the row's own text."""
    # Hashes chained over two zips: no step looks a word up by its index.
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(w)))
    tail = lambda c, k: F.slice(c, F.lit(k), F.greatest(F.size(c) - k + 1, F.lit(0)))
    pair = F.zip_with("_h", tail("_h", 2), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_w", F.when(F.size("_h") >= 3, F.slice(F.zip_with(pair, tail("_h", 3), lambda a, b: F.xxhash64(a, b)), F.lit(1), F.greatest(F.size("_h") - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))).drop("_h")
    # Only a text in which some window repeats needs its windows in order.
    again = F.size(F.array_distinct("_w")) < F.size("_w")
    df = df.withColumn("_s", F.when(again, F.array_sort(F.transform("_w", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_w")
    hash_at = lambda j: F.get(F.col("_s"), j)["h"]
    twin = lambda x, j: F.coalesce((j > 0) & (x["h"] == hash_at(j - 1)), F.lit(False)) | F.coalesce(x["h"] == hash_at(j + 1), F.lit(False))
    df = df.withColumn("_p", F.array_sort(F.transform(F.filter("_s", twin), lambda x: x["i"]))).drop("_s")
    added = F.transform("_p", lambda p, j: F.when(j == 0, F.lit(3)).otherwise(F.least(F.lit(3), p - F.get(F.col("_p"), F.greatest(j - 1, F.lit(0))))))
    return df.withColumn(out, F.coalesce(F.aggregate(added, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")).drop("_p")


def divergence(p: Column, q: Column) -> Column:
    """One bin's part of the Jensen-Shannon divergence in bits."""
    part = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(F.lit(0.0))
    return (part(p) + part(q)) / 2


def with_whole(counts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Counts by language and ``keys`` with those of the whole corpus, which rows without a language are part of."""
    whole = counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]).withColumn("language", F.lit(ALL))
    return counts.filter(F.col("language") != ALL).unionByName(whole)


def references(texts: DataFrame, min_share: float) -> DataFrame:
    """One stored row for each language and the whole corpus ('*').

    Class shares (q_...), common words in order of their slot with their shares, q_all (the sum of those), and first:
    for each slot where its words begin, null if it has none.
    """
    classes = with_classes(texts, "t").groupBy("language").agg(*[F.sum(c).alias(c) for c in NAMES])
    classes = with_whole(stored(classes), [], list(NAMES))
    every = sum((F.col(c) for c in NAMES), F.lit(0))
    classes = classes.select("language", *[F.coalesce(F.try_divide(F.col(c), every), F.lit(0.0)).alias(f"q_{c}") for c in NAMES])
    counts = stored(texts.select("language", F.explode(words_of(F.col("t"))).alias("word")).groupBy("language", "word").agg(F.count("*").alias("n")))
    counts = with_whole(counts, ["word"], ["n"])
    totals = stored(counts.groupBy("language").agg(F.sum("n").alias("total")))
    common = counts.join(totals, "language").filter(F.col("n") >= min_share * F.col("total"))
    slot = F.pmod(F.xxhash64(F.xxhash64("word")), F.lit(SLOTS)).cast("int")
    listed = common.groupBy("language").agg(F.array_sort(F.collect_list(F.struct(slot.alias("slot"), "word", (F.col("n") / F.col("total")).alias("share")))).alias("x"))
    listed = stored(listed.select("language", F.col("x.slot").alias("slots"), F.col("x.word").alias("known"), F.col("x.share").alias("shares")))
    first = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda s: F.when(F.array_contains("slots", s), (F.array_position("slots", s) - 1).cast("int")))
    listed = listed.select("language", "slots", "known", "shares", F.aggregate("shares", F.lit(0.0), lambda a, x: a + x).alias("q_all"), first.alias("first"))
    return stored(classes.join(listed, "language", "left"))


def word_divergence(df: DataFrame, most: int) -> DataFrame:
    """Adds ``word_js`` from words, n_words and the reference's columns; ``most``: words of a slot at most."""
    h = lambda w: F.pmod(F.xxhash64(F.xxhash64(w)), F.lit(SLOTS)).cast("int")
    df = df.withColumn("_f", F.transform("words", lambda w: F.get(F.col("first"), h(w))))

    def place(w: Column, f: Column) -> Column:
        found = F.when(f.isNull(), F.lit(None).cast("int")).when(F.get(F.col("known"), f) == w, f)
        for k in range(1, most):
            found = found.when(F.get(F.col("known"), f + k) == w, f + k)
        return found

    df = df.withColumn("_f", F.array_sort(F.array_compact(F.zip_with("words", "_f", place))))
    # The last of each run of equal places; a run's length is the distance of its end from the one before.
    ends = F.filter(F.sequence(F.lit(0), F.size("_f") - 1), lambda j: F.coalesce(F.get(F.col("_f"), j) != F.get(F.col("_f"), j + 1), F.lit(True)))
    df = df.withColumn("_e", F.when(F.size("_f") > 0, ends).otherwise(F.array().cast("array<int>")))
    n = lambda e, j: e - F.when(j > 0, F.get(F.col("_e"), F.greatest(j - 1, F.lit(0)))).otherwise(F.lit(-1))
    df = df.withColumn("_r", F.transform("_e", lambda e, j: F.struct((n(e, j) / F.col("n_words")).alias("p"), F.get(F.col("shares"), F.get(F.col("_f"), e)).alias("q")))).drop("_f", "_e")
    total = lambda f: F.aggregate("_r", F.lit(0.0), lambda a, x: a + f(x))
    df = df.withColumn("_js", total(lambda x: divergence(x["p"], x["q"]))).withColumn("_p", total(lambda x: x["p"])).withColumn("_q", total(lambda x: x["q"])).drop("_r")
    q_all = F.coalesce(F.col("q_all"), F.lit(0.0))
    absent = F.greatest(q_all - F.col("_q"), F.lit(0.0)) / 2
    return df.withColumn("word_js", F.col("_js") + absent + divergence(F.greatest(1 - F.col("_p"), F.lit(0.0)), F.greatest(1 - q_all, F.lit(0.0)))).drop("_js", "_p", "_q")


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_share: float = 0.005, min_words: int = 100, max_class_distance: float = 0.26, max_word_distance: float = 0.28) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    class_distance, word_distance and kept.

    Distances are square roots of divergences in bits, 0 to 1, null for texts of fewer than ``min_words`` words, which
    they don't judge; equal distances are judged alike. Null texts count as empty and fail; texts of any length are read
    whole; rows without an id are judged like others; repeated rows each get their row; an empty table gives an empty
    one; other columns, whatever their names, are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"), F.coalesce(F.col(lang_col).cast("string"), F.lit(ALL)).alias("language"))
    reference = references(texts, min_share)
    runs = F.transform(F.array_distinct("slots"), lambda s: F.size(F.filter("slots", lambda x: x == s)))
    most = reference.select(F.max(F.array_max(runs))).first()[0] or 1
    if stored_bytes(reference) <= BROADCAST_LIMIT:
        df = texts.join(F.broadcast(reference), "language", "left")
    else:  # a hot language's texts are spread over SALTS parts
        salted = reference.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        df = texts.withColumn("salt", F.pmod(F.xxhash64("t"), F.lit(SALTS)).cast("int")).join(salted, ["language", "salt"], "left").drop("salt")
    lines = F.filter(F.split("t", "\n"), lambda line: F.translate(line, BLANKS, "") != "")
    df = with_classes(df, "t").withColumn("lines", lines).withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    df = df.withColumn("words", words_of(F.col("t"))).drop("t").withColumn("n_words", F.size("words").cast("long"))
    long_enough = F.col("n_words") >= min_words
    df = with_repeated_words(df, "words", "n_repeat_words").withColumn("words", F.when(long_enough, F.col("words")))
    df = word_divergence(df, most)
    share = lambda c: F.col(c) / F.greatest(F.col("chars"), F.lit(1))
    class_js = sum((divergence(share(c), F.coalesce(F.col(f"q_{c}"), F.lit(0.0))) for c in NAMES), F.lit(0.0))
    distance = lambda js: F.when(long_enough, F.round(F.sqrt(F.greatest(js, F.lit(0.0))), 9))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = df.select(
        F.col("doc").alias(id_col), "n_words", (F.col("chars") - F.col("blank")).alias("word_chars"), F.col("symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        distance(class_js).alias("class_distance"), distance(F.col("word_js")).alias("word_distance"),
    )
    usual = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class_distance) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= max_word_distance)
    return fenced(out.withColumn("kept", ~F.col("base_failed") & usual))
