"""Similarity join of documents on word shingles with prefix filtering, grouped into linked components.

Equal sets are one class, known by a fingerprint of its shingles. Four steps narrow the classes down, each exact:

1. Every class offers its least shingles by hash, about twice as many as its prefix has. Two sets similar enough share more
   than the surplus of the smaller, so a class of which too few offered shingles occur elsewhere has no partner.
2. Sets of the others are ordered rare first (by a fixed-size table of hashed frequencies) and met on the shingles of
   their prefixes. Pairs of a shingle that few hold pass a length, a positional and a suffix filter (differences of
   histograms); a shingle that many hold ties its holders without listing their pairs. What is tied is a cluster.
3. A cluster is cut into blocks of bounded size, by length and by hash. Every two blocks whose lengths allow links meet
   in one task, which joins their prefixes, applies the three filters, and compares each pair left once. It returns one
   row for each set: its number of links and the least member it is tied to; pairs never leave the task.
4. Ties of different blocks are joined to components.

Sets are sent once for each pair of blocks, not for each pair of sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing
from .common import discard, list_slices, small, stored, text_slices
from .components import connected_components

#: Counters of the frequency table; every task and the driver hold one such table of 16-bit counts.
COUNTER_BITS, BLOCK_BITS = 22, 12
#: Bins of a set's histogram in the join, a byte each, eight to an integer; bins inside a task.
BINS, TASK_BINS = 32, 64
#: A shingle in more prefixes than this ties its holders without listing pairs.
FEW = 64
#: Sets and shingles of a block.
BLOCK_SETS, BLOCK_SHINGLES = 256, 1 << 17
#: Shingles compared at once in a block, as columns of a matrix.
COLUMNS = 2048


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the runs of ``size`` words of each text; of all its words if it has fewer."""
    hashes, first = hashing.words([(t or "").encode("utf-8", "replace") for t in texts], lower=True)
    full = hashing.windows(hashes, size)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(hashing.windows(hashes[a:b], int(b - a)) + np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def fingerprints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit sums over the shingles of each set."""
    flat, n = np.concatenate([*sets, np.zeros(0, np.uint64)]), np.fromiter(map(len, sets), np.int64, len(sets))
    ends, marks = np.cumsum(n), []
    for salt in (0x51ED27, 0xA3C59AC3):
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashing.mix(flat + np.uint64(salt)), dtype=np.uint64)))
        marks.append((sums[ends] - sums[ends - n]).view(np.int64))
    return marks


def lists(parts: list[np.ndarray]) -> pa.Array:
    """A column of lists of 64-bit integers, without a Python object for each."""
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate([*parts, np.zeros(0, np.uint64)]).view(np.int64)))


def prefix_size(n, percent: int):
    """Shingles of a set of ``n`` one of which any partner has among as many of its own."""
    return n - -(-percent * n // 100) + 1


def surplus(n, percent: int):
    """Shingles offered beyond the prefix."""
    return n - -(-percent * n // 100)


def profile(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """doc, n, two halves of the set's fingerprint, and the shingles it offers (the least by hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            offered = [s[: prefix_size(len(s), percent) + surplus(len(s), percent)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([len(s) for s in sets], pa.int32()), *map(pa.array, fingerprints(sets)), lists(offered)], ["doc", "n", "mark1", "mark2", "offered"])

    return texts.mapInArrow(run, "doc long, n int, mark1 long, mark2 long, offered array<long>")


def wanted_sets(texts: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, items): the sets of the classes in ``wanted`` (doc, node, mark1, mark2), each once, as a stored table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes that this task has given: no more than it reads rows
        for batch in text_slices(batches, 2 << 20):
            sets = shingle_sets(batch.column("text").to_pylist(), size)
            one, two = fingerprints(sets)
            ok = (one == np.asarray(batch.column("mark1"))) & (two == np.asarray(batch.column("mark2")))
            nodes = batch.column("node").to_pylist()
            take = [i for i in np.flatnonzero(ok).tolist() if not (nodes[i] in seen or seen.add(nodes[i]))]
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in take], pa.int64()), lists([sets[i] for i in take])], ["node", "items"])

    sets = stored(texts.join(small(wanted), "doc").select("doc", "text", "node", "mark1", "mark2").mapInArrow(run, "node long, items array<long>"))
    if sets.groupBy("node").count().filter("count > 1").isEmpty():
        return sets
    return stored(sets.dropDuplicates(["node"]))  # an id repeated over tasks


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def _sets(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, ends = np.asarray(column.flatten()).view(np.uint64), np.cumsum([0, *np.diff(np.asarray(column.offsets))])
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def frequencies(sets: DataFrame) -> np.ndarray:
    """Sets by hashed shingle, over the whole table, in a table of fixed size whose counts stop at 65535."""
    form, most = "block int, counts binary", 65535

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(1 << COUNTER_BITS, np.uint32)
        for batch in list_slices(batches, "items"):
            np.add.at(own, _slots(np.asarray(batch.column("items").flatten()).view(np.uint64)), 1)
        parts = np.minimum(own, most).astype(np.uint16).reshape(-1, 1 << BLOCK_BITS)
        used = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([parts[b].tobytes() for b in used], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                sums[block] = np.minimum(sums.get(block, 0) + np.frombuffer(counts, np.uint16).astype(np.uint32), most)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.astype(np.uint16).tobytes() for s in sums.values()], pa.binary())], ["block", "counts"])

    table = np.zeros((1 << (COUNTER_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.uint16)
    for row in sets.select("items").mapInArrow(count, form).repartition("block").mapInArrow(add, form).toLocalIterator():  # one table in all
        table[row["block"]] = np.frombuffer(row["counts"], np.uint16)
    return table.reshape(-1)


def prefix_of(items: np.ndarray, rarity: np.ndarray, percent: int) -> np.ndarray:
    """The rarest shingles of a set, rare first; ties by hash."""
    return items[np.lexsort((items, rarity[_slots(items)]))[: prefix_size(len(items), percent)]]


def histograms(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """Shingles of each set by their lowest bits."""
    who = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    return np.bincount(who * bins + (np.concatenate(sets) & np.uint64(bins - 1)).astype(np.int64), minlength=len(sets) * bins).reshape(-1, bins)


def prefixes(sets: DataFrame, rarity, percent: int) -> DataFrame:
    """node, n, prefix, and the histogram as integers of eight bytes whose counts stop at 255."""
    names = [f"bins{k}" for k in range(BINS // 8)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in list_slices(batches, "items"):
            sets = _sets(batch.column("items"))
            if sets:
                bins = np.minimum(histograms(sets, BINS), 255).astype(np.uint8).view(np.int64)
                columns = [batch.column("node"), pa.array([len(s) for s in sets], pa.int32()), lists([prefix_of(s, rarity.value, percent) for s in sets]), *(pa.array(b) for b in bins.T.copy())]
                yield pa.RecordBatch.from_arrays(columns, ["node", "n", "prefix", *names])

    return sets.mapInArrow(run, "node long, n int, prefix array<long>, " + ", ".join(f"{c} long" for c in names))


def may_link(percent: int) -> Column:
    """Length, positional and suffix filters over columns of two sides, a and b."""
    n_a, n_b, i, j = (F.col(c) for c in ("n_a", "n_b", "at_a", "at_b"))
    need = F.ceil(percent * (n_a + n_b) / (100 + percent))
    length = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    position = F.least(i, j) + 1 + F.least(n_a - i - 1, n_b - j - 1) >= need
    bin_of = lambda c, k: F.shiftright(F.col(c), 8 * k).bitwiseAND(F.lit(255))
    # Counts that stop at 255 differ by no more than the true ones.
    differ = sum((F.abs(bin_of(f"bins{b}_a", k) - bin_of(f"bins{b}_b", k)) for b in range(BINS // 8) for k in range(8)), F.lit(0))
    return length & position & (differ <= n_a + n_b - 2 * need)


def candidate_ties(sets: DataFrame, rarity, percent: int) -> DataFrame:
    """(a, b), stored: edges whose components hold every pair that may link."""
    own = stored(prefixes(sets, rarity, percent))
    rows = own.select("node", "n", *[c for c in own.columns if c.startswith("bins")], F.posexplode("prefix").alias("at", "token"))
    met = rows.groupBy("token").agg(F.count("*").alias("k"), F.min("node").alias("least")).filter("k > 1")
    met = stored(rows.join(met, "token"))
    few = met.filter(F.col("k") <= FEW).drop("k", "least")
    side = lambda x: few.select("token", *[F.col(c).alias(f"{c}_{x}") for c in few.columns if c != "token"])
    pairs = side("a").join(side("b"), "token").filter(F.col("node_a") < F.col("node_b")).filter(may_link(percent)).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))
    many = met.filter((F.col("k") > FEW) & (F.col("node") != F.col("least"))).select(F.col("least").alias("a"), F.col("node").alias("b"))
    ties = stored(pairs.unionByName(many).distinct())
    discard(own, met)
    return ties


def common_counts(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets i and j."""
    if len(i) <= 4 * len(sets):
        return np.fromiter((len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist())), np.int64, len(i))
    _, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    who, kept = np.repeat(np.arange(len(sets)), [len(s) for s in sets]), held > 1
    column = (np.cumsum(kept) - 1)[number[kept[number]]]
    order = np.argsort(column, kind="stable")
    column, who = column[order], who[kept[number]][order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, int(kept.sum()), COLUMNS):
        a, b = np.searchsorted(column, (lo, lo + COLUMNS))
        held_here = np.zeros((len(sets), COLUMNS), np.float32)
        held_here[who[a:b], column[a:b] - lo] = 1
        common += held_here @ held_here.T
    return common[i, j].astype(np.int64)


def linked_pairs(sets: list[np.ndarray], other: np.ndarray, rarity: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs i < j of similar sets; where ``other`` has two values, those of two sides only."""
    n = np.array([len(s) for s in sets])
    firsts = [prefix_of(s, rarity, percent) for s in sets]
    size = np.array([len(p) for p in firsts])
    token, who, at = np.concatenate(firsts), np.repeat(np.arange(len(sets)), size), np.concatenate([np.arange(k) for k in size])
    order = np.argsort(token, kind="stable")
    token, who, at = token[order], who[order], at[order]
    may = np.zeros((len(sets), len(sets)), bool)
    crossing = other.any() and not other.all()
    for step in range(1, len(token)):  # holders of one shingle stand side by side
        met = np.flatnonzero(token[step:] == token[:-step])
        if not len(met):
            break
        i, j, p, q = who[met], who[met + step], at[met], at[met + step]
        need = -(-percent * (n[i] + n[j]) // (100 + percent))
        ok = (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])) & (np.minimum(p, q) + 1 + np.minimum(n[i] - p - 1, n[j] - q - 1) >= need)
        if crossing:
            ok &= other[i] != other[j]
        may[i[ok], j[ok]] = True
    i, j = np.nonzero(may)
    if not len(i):
        return i, j
    bins, ok = histograms(sets, TASK_BINS), np.zeros(len(i), bool)
    for lo in range(0, len(i), 1 << 14):
        a, b = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
        ok[lo : lo + (1 << 14)] = np.abs(bins[a] - bins[b]).sum(axis=1) <= n[a] + n[b] + 2 * (percent * (n[a] + n[b]) // -(100 + percent))
    i, j = i[ok], j[ok]
    common = common_counts(sets, i, j)
    linked = 100 * common >= percent * (n[i] + n[j] - common)
    return i[linked], j[linked]


def tied(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each node the least one that it is tied to by the pairs."""
    label = nodes.copy()
    while True:
        low = np.minimum(label[i], label[j])
        if (label[i] == low).all() and (label[j] == low).all():
            return label
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)


def compare_blocks(sets: DataFrame, clusters: DataFrame, rarity, percent: int) -> DataFrame:
    """(node, n_links, least, parted), stored: for each pair of blocks a row for each of their sets that has a link.

    parted: the cluster has several blocks, so the ties of one don't tell the component.
    """
    # Sets more than one length class apart differ too much in size to be linked.
    step = -math.log(percent / 100) if percent < 100 else 1e-9
    of_length = F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + 1e-9)
    members = stored(sets.select("node", F.size("items").alias("n")).join(small(clusters), "node").select("node", F.col("component").alias("cluster"), of_length.alias("length"), "n"))
    room = lambda: F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_SETS)).cast("int")
    whole = members.groupBy("cluster").agg(room().alias("whole"))
    cut = members.groupBy("cluster", "length").agg(room().alias("parts")).join(whole, "cluster")
    # A cluster that fits one block isn't cut by length.
    cut = stored(cut.select("cluster", "length", F.when(F.col("whole") > 1, F.col("length")).otherwise(F.lit(0)).alias("level"), F.when(F.col("whole") > 1, F.col("parts")).otherwise(F.lit(1)).alias("parts"), (F.col("whole") > 1).alias("parted")))
    blocks = cut.select("cluster", "level", "parted", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).distinct()
    later = blocks.select("cluster", F.col("level").alias("level_b"), F.col("part").alias("part_b"))
    near = ((F.col("level_b") == F.col("level")) & (F.col("part_b") >= F.col("part"))) | (F.col("level_b") == F.col("level") + 1)
    meetings = stored(blocks.join(later, "cluster").filter(near).withColumn("task", F.xxhash64("cluster", "level", "part", "level_b", "part_b")))
    sides = meetings.select("cluster", "level", "part", "task", "parted", F.lit(False).alias("other")).unionByName(
        meetings.filter((F.col("level_b") != F.col("level")) | (F.col("part_b") != F.col("part"))).select("cluster", F.col("level_b").alias("level"), F.col("part_b").alias("part"), "task", "parted", F.lit(True).alias("other"))
    )
    placed = members.join(small(cut), ["cluster", "length"]).select("node", "cluster", "level", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"))
    sent = sets.join(small(stored(placed.join(small(stored(sides)), ["cluster", "level", "part"]).select("node", "task", "other", "parted"))), "node")

    def run(table: pa.Table) -> pa.Table:
        rows = _sets(table.column("items"))
        nodes = table.column("node").to_numpy()
        i, j = linked_pairs(rows, np.asarray(table.column("other").to_numpy(zero_copy_only=False), bool), rarity.value, percent)
        count = np.bincount(i, minlength=len(rows)) + np.bincount(j, minlength=len(rows))
        some = np.flatnonzero(count)
        return pa.table({"node": nodes[some], "n_links": count[some].astype(np.int64), "least": tied(nodes, i, j)[some], "parted": table.column("parted").take(pa.array(some))})

    found = stored(sent.groupBy("task").applyInArrow(run, "node long, n_links long, least long, parted boolean"))
    discard(members, cut, meetings)
    return found


def similar_documents(docs: DataFrame, percent: int = 90, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_shingles, class_id (smallest id with the same set), component_id
    (smallest id reachable by links) and n_links (other classes that the row's class is linked with).

    percent: least Jaccard similarity of linked documents, in hundredths. Words are runs of characters that aren't
    ASCII white space, with A-Z lower-cased. Null, empty or blank texts have no shingles and are linked with nothing.
    Texts of any length are read whole. Equal texts are one class; its smallest id stands for it, so ties don't arise.
    Repeated rows each get their row; rows that share an id but not a text are compared each for itself. Rows without
    an id get their n_shingles only. An empty table gives an empty one; other columns, whatever their names, are
    ignored. Ids are integers.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    profiles = stored(profile(texts, size, percent))
    node = F.xxhash64("n", "mark1", "mark2").alias("node")
    heads = profiles.filter("n > 0 AND doc IS NOT NULL").groupBy("n", "mark1", "mark2").agg(F.min("doc").alias("doc"))
    heads = stored(heads.select("doc", node, "n", "mark1", "mark2"))
    offers = profiles.select("doc", node, "n", "offered").join(small(heads.select("doc", "node")), ["doc", "node"], "left_semi").select("node", "n", F.explode("offered").alias("token"))
    shared = stored(offers.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token"))
    least_n = F.ceil(percent * F.col("n") / 100)
    spare = least_n - F.ceil(percent * least_n / 100)
    left = offers.join(shared, "token").groupBy("node", "n").agg(F.count("*").alias("k")).filter(F.col("k") > spare).select("node")
    wanted = stored(heads.join(small(stored(left)), "node", "left_semi").select("doc", "node", "mark1", "mark2"))
    members = stored(profiles.select("doc", "n", node))
    discard(profiles, shared)
    sets = wanted_sets(texts, wanted, size)
    rarity = docs.sparkSession.sparkContext.broadcast(frequencies(sets))
    ties = candidate_ties(sets, rarity, percent)
    found = compare_blocks(sets, connected_components(ties), rarity, percent)
    discard(sets)
    whole = found.filter("NOT parted").select("node", "least")
    parted = stored(found.filter("parted").select(F.col("node").alias("a"), F.col("least").alias("b")))
    if not parted.isEmpty():
        whole = whole.unionByName(connected_components(parted).withColumnRenamed("component", "least"))
    linked = found.groupBy("node").agg(F.sum("n_links").alias("n_links")).join(whole, "node")
    ids = heads.select("node", F.col("doc").alias("class"))
    linked = stored(linked.join(small(ids), "node"))
    lowest = linked.groupBy("least").agg(F.min("class").alias("component"))
    linked = stored(linked.select("node", "n_links", "least").join(small(stored(lowest)), "least").select("node", "n_links", "component"))
    out = members.join(small(ids), "node", "left").join(small(linked), "node", "left")
    kind = docs.schema[id_col].dataType
    alone = F.when(F.col("n") > 0, F.col("class")).otherwise(F.col("doc"))
    own = lambda c: F.when(F.col("doc").isNotNull(), c)
    return out.select(
        F.col("doc").cast(kind).alias(id_col), F.col("n").cast("long").alias("n_shingles"), own(alone).cast(kind).alias("class_id"),
        own(F.coalesce("component", alone)).cast(kind).alias("component_id"), own(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
    )
