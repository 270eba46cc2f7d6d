"""Repeated passages removed by level-wise doubling.

Levels are the wanted length halved (rounded up) until it is at most ``SHORTEST`` words, from the shortest on; 13 words
have one level, of 7, and 50 have levels of 7, 13 and 25. At each level a full window is known by its seed, the least by hash
among the windows of the level's length inside it: equal full windows choose equal seeds, so no repeat is missed while
only some positions move. Seeds found in one document alone can't be part of a repeat; full windows around the others
go on to the next level, of twice the length, until none are left or the full length is reached. There they are met
by the hashes of the whole and of the last seed with the smallest document that holds them. Words of longer repeats are
covered by full windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import hashing
from .common import BROADCAST_LIMIT, small, stored, text_slices

#: A bit table of this size goes to every task and tells most halves that one document alone holds; the join that
#: follows is exact, so a fuller table only lets more rows through to it.
FILTER_BITS, FILTER_BLOCK_BITS = 27, 17
SHORTEST = 8
#: A window that starts in more than one of so many places of all is hot; there are fewer hot windows than this.
HOT_SHARE = 4096


def levels(length: int) -> list[int]:
    """Lengths of the seeds, each at least half the next, the last at least half of ``length``."""
    sizes = [(length + 1) // 2]
    while sizes[0] > SHORTEST:
        sizes.insert(0, (sizes[0] + 1) // 2)
    return sizes


def _batches(batches: Iterator[pa.RecordBatch], length: int, size: int, before: list):
    """For each slice: document ids, the seed of ``size`` words of each full window that the levels before let through,
    hashes of all words, where among them the window starts, where in its document, and which document that is.

    before: (size, table of bits) of each level that is done.
    """
    for batch in text_slices(batches, 2 << 20):
        texts = [(t or "").encode("utf-8", "replace") for t in batch.column("text").to_pylist()]
        ids = np.asarray(batch.column("doc"), np.int64)
        hashes, first = hashing.words(texts)
        counts = np.maximum(np.diff(first) - length + 1, 0)
        doc = np.repeat(np.arange(len(ids)), counts)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = at + first[doc]
        for done, table in before:
            kept = _held(table.value, _of(hashes, length, done)[place])
            doc, at, place = doc[kept], at[kept], place[kept]
        if len(place):
            yield ids, _of(hashes, length, size)[place], hashes, place, at, doc


def _of(hashes: np.ndarray, length: int, size: int) -> np.ndarray:
    """The seed of ``size`` words of the full window from each word on."""
    return hashing.sliding_min(hashing.windows(hashes, size), length - size + 1)


def _held(table: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Are the bits of each seed set? Worked out once for each run of equal ones."""
    new = np.ones(len(seeds), bool)
    new[1:] = seeds[1:] != seeds[:-1]
    own, ok = seeds[new], np.ones(np.count_nonzero(new), bool)
    for at in _bits(own):
        ok &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return ok[np.cumsum(new) - 1]


def _seeds(length: int, size: int, before: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, seeds, _, _, _, doc in _batches(batches, length, size, before):
            new = np.ones(len(seeds), bool)
            new[1:] = (seeds[1:] != seeds[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(seeds[new].view(np.int64)), pa.array(ids[doc[new]])], ["seed", "doc"])

    return run


def _bits(seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (seeds >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (seeds & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def seed_filter(shared: DataFrame) -> np.ndarray:
    """The table of bits that the given seeds set, two each."""
    width = 1 << (FILTER_BLOCK_BITS - 3)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            bits = np.unique(np.concatenate(_bits(np.asarray(batch.column("seed")).view(np.uint64))))
            edges = np.searchsorted(bits, np.arange(0, (1 << FILTER_BITS) + 1, 1 << FILTER_BLOCK_BITS))
            for block in np.flatnonzero(np.diff(edges)).tolist():
                flags = np.zeros(1 << FILTER_BLOCK_BITS, bool)
                flags[bits[edges[block] : edges[block + 1]] - (block << FILTER_BLOCK_BITS)] = True
                own[block] = own.get(block, np.zeros(width, np.uint8)) | np.packbits(flags)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([b.tobytes() for b in own.values()], pa.binary())], ["block", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, bits in zip(batch.column("block").to_pylist(), batch.column("bits").to_pylist()):
                own[block] = own.get(block, np.zeros(width, np.uint8)) | np.frombuffer(bits, np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([b.tobytes() for b in own.values()], pa.binary())], ["block", "bits"])

    form = "block int, bits binary"
    table = np.zeros((1 << (FILTER_BITS - FILTER_BLOCK_BITS), width), np.uint8)
    for row in shared.mapInArrow(cut, form).repartition("block").mapInArrow(merge, form).collect():  # one table in all
        table[row["block"]] = np.frombuffer(row["bits"], np.uint8)
    return table.reshape(-1)


def _windows(length: int, before: list):
    """A row for each run of full windows that share a seed of the last level, with their hashes, where all levels let them through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, seeds, hashes, place, at, doc in _batches(batches, length, before[-1][0], before):
            new = np.ones(len(seeds), bool)
            new[1:] = (seeds[1:] != seeds[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
            begin = np.flatnonzero(new)
            own = hashing.windows(hashes, length)[place].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(seeds)).astype(np.int32)), pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(seeds[begin].view(np.int64)), pa.array(ids[doc[begin]]), pa.array(at[begin].astype(np.int32)), lists], ["seed", "doc", "at", "hashes"])

    return run


def later_starts(full: DataFrame) -> DataFrame:
    """(doc, at) of the windows that also start in a document of a smaller id.

    Windows that hold more than one row in ``HOT_SHARE`` would fill a task of the join, so their rows are dealt by
    document to parts of about that many rows, and the smallest document goes to each. There are fewer hot windows
    than ``HOT_SHARE`` at any size, so the list of them is broadcast.
    """
    keys = ["hash", "seed"]
    limit = max(1, full.count() // HOT_SHARE)
    parts = F.ceil(F.col("n") / limit)
    first = stored(full.groupBy(*keys).agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("first < last").select(*keys, "first", parts.alias("parts")))
    hot = first.filter(F.col("parts") > 1).select(*[F.col(k).alias(f"_{k}") for k in keys], "parts")
    marked = full.join(F.broadcast(hot), (F.col("hash") == F.col("_hash")) & (F.col("seed") == F.col("_seed")), "left")
    dealt = marked.select(*keys, "doc", "at", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("parts")), F.lit(0).cast("long")).alias("part"))
    sent = first.select(*keys, "first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(sent, [*keys, "part"]).filter("doc > first").select("doc", "at")


def repeated_spans(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """(doc, spans): the words of each document covered by windows that also start in a document of a smaller id.

    spans: merged, in order, structs of first word and end (exclusive). Documents without any have no row,
    and neither have null texts nor rows without an id. Rows of one id are taken as one document.
    """
    texts = docs.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    before: list = []
    for size in levels(length):
        seeds = texts.mapInArrow(_seeds(length, size, list(before)), "seed long, doc long")
        shared = stored(seeds.groupBy("seed").agg(F.min("doc").alias("a"), F.max("doc").alias("b")).filter("a < b").select("seed"))
        table = seed_filter(shared)
        before.append((size, docs.sparkSession.sparkContext.broadcast(table)))
        if not table.any():  # no candidates survive
            break
    runs = texts.mapInArrow(_windows(length, before), "seed long, doc long, at int, hashes array<long>").join(small(shared, broadcast_limit), "seed")
    full = stored(runs.select("seed", "doc", "at", F.posexplode("hashes").alias("k", "hash")).select("seed", "hash", "doc", (F.col("at") + F.col("k")).alias("at")))
    per = later_starts(full).groupBy("doc").agg(F.sort_array(F.collect_set("at")).alias("s"))
    # Starts in a row make one span; the next one begins where a start lies beyond the words already covered.
    begins = F.filter("s", lambda x, i: (i == 0) | (x - F.get(F.col("s"), F.greatest(i - 1, F.lit(0))) > length))
    lasts = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get(F.col("s"), i + 1) - x > length))
    return per.select("doc", F.zip_with(begins, lasts, lambda a, b: F.struct(a.alias("start"), (b + length).alias("end"))).alias("spans"))


def remove_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_removed, spans and ``kept_text``, the words left joined by a space.

    Words are runs of characters that aren't ASCII white space. Null texts have none; texts shorter than ``length``
    words keep all; rows of one id are taken as the same document; rows without an id keep all and take no word from
    others; an empty table gives an empty one; other columns, whatever their names, are ignored. A text is held whole.
    """
    spans = small(stored(repeated_spans(docs, length, id_col, text_col, broadcast_limit)), broadcast_limit)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(spans.withColumnRenamed("doc", "_doc"), F.col("doc").cast("long") == F.col("_doc"), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, removed, kept = [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                counts.append(len(words))
                at, left = 0, []
                for span in own or ():
                    left += words[at : span["start"]]
                    at = span["end"]
                left += words[at:]
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left).decode("utf-8"))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), batch.column("spans"), pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "spans", "kept_text"])

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("spans", spans.schema["spans"].dataType), T.StructField("kept_text", T.StringType())])
    return rows.mapInArrow(run, schema)
