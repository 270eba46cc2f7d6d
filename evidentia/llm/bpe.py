"""Byte-level BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over 32 characters cuts each text where the hash meets a condition, so that a passage that documents
share is cut alike wherever it stands. A chunk is encoded once and kept in a bounded dictionary. Where two chunks
meet, the pieces around the join are encoded again in a growing window until a piece boundary agrees with one of the
right chunk; from there on the two encodings are the same, because the pre-tokenizer never looks back.

The dictionary belongs to one Python worker and lasts over its tasks. Sharing it between workers would mean shuffling
every text and every id; encoding a chunk once per worker costs less and keeps the operator a narrow map.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections import OrderedDict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

#: Fixed value: the pattern of byte-level BPE pre-tokenization.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The rolling hash sees so many characters; a cut falls once in 2 ** CUT_BITS characters on average.
WINDOW_STEPS, CUT_BITS = 5, 11
#: A piece that ends so many characters before a chunk's end can't change with what follows (contractions look ahead two).
SAFE = 3
#: Characters below this follow classes that all Unicode versions share.
SIMPLE = 0x250


def _ranges(test) -> str:
    out: list[list[int]] = []
    for c in filter(test, range(SIMPLE)):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


def simple_pattern() -> re.Pattern:
    """PATTERN for texts whose characters are all below SIMPLE, in plain classes, which run about twice as fast."""
    letter = _ranges(lambda c: unicodedata.category(chr(c))[0] == "L")
    number = _ranges(lambda c: unicodedata.category(chr(c))[0] == "N")
    space = _ranges(lambda c: chr(c) in "\t\n\x0b\f\r \x85\xa0")
    return re.compile(f"'(?:[stmd]|re|ve|ll)| ?[{letter}]+| ?[{number}]+| ?[^{space}{letter}{number}]+|[{space}]+(?![^{space}])|[{space}]+")


class Chunk:
    """Pieces of one chunk; ``ids`` gives those of a run of pieces and keeps what it gave."""

    __slots__ = ("pieces", "ends", "runs")

    def __init__(self, pieces: list[str]):
        self.pieces, self.ends, self.runs = pieces, None, {}

    def cuts(self) -> list[int]:
        if self.ends is None:
            self.ends = list(accumulate(map(len, self.pieces), initial=0))
        return self.ends


class Codec:
    """Encodes and decodes whole texts exactly as the tokenizers library does with the same file."""

    def __init__(self, path: str, max_pieces: int = 200_000, max_chunk_chars: int = 1_000_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.simple, self.full = simple_pattern(), regex.compile(PATTERN)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        #: Assigned long ago: every Unicode version has the same class for these.
        old = unicodedata.ucd_3_2_0
        self.stable = np.fromiter((old.category(chr(c)) not in ("Cn", "Cs") and old.category(chr(c))[0] == unicodedata.category(chr(c))[0] for c in range(0x110000)), bool, 0x110000)
        self.stable[:SIMPLE] = True
        byte_of = {c: b for b, c in self._byte_chars().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        added = {i: t.content.encode() for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.bytes_of = [added[i] if i in added else bytes(byte_of[c] for c in self.tokenizer.id_to_token(i) or "") for i in range(size)]
        self.table = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.lengths = np.fromiter(map(len, self.bytes_of), np.int32, size)
        self.starts = np.cumsum(self.lengths, dtype=np.int32) - self.lengths
        self.merge = self._ranked(path, set(added))
        self.max_pieces, self.max_chunk_chars = max_pieces, max_chunk_chars
        self.piece_ids: dict[str, bytes] = {}
        self.chunks: OrderedDict[str, Chunk] = OrderedDict()
        self.chunk_chars = 0
        self.reused = 0

    @staticmethod
    def _byte_chars() -> dict[int, str]:
        """The printable character that byte-level vocabularies use for each byte."""
        shown = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b < 256 and b != 0xAD]
        rest = [b for b in range(256) if b not in shown]
        return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def _ranked(self, path: str, added: set[int]):
        """A faster encoder of single pieces, where the file's ids follow its merges one by one; else None."""
        with open(path, encoding="utf-8") as file:
            merges = json.load(file)["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        first = min((self.tokenizer.token_to_id("".join(pairs[0])) if pairs else 0) or 0, len(self.bytes_of))
        if any(self.tokenizer.token_to_id(a + b) != first + k for k, (a, b) in enumerate(pairs)) or first != 256:
            return None
        import tiktoken

        ranks = {b: i for i, b in enumerate(self.bytes_of) if i not in added}
        return tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def _encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        if self.merge:
            return [self.merge(p.encode("utf-8")) for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch(pieces, add_special_tokens=False)]

    def _ids(self, pieces: list[str]) -> bytes:
        known = self.piece_ids
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        new = list({p for p in pieces if p not in known})
        if len(known) + len(new) > self.max_pieces:
            known.clear()
            new = list(set(pieces))
        for p, ids in zip(new, self._encode_pieces(new)):
            known[p] = struct.pack(f"<{len(ids)}i", *ids)
        return b"".join([known[p] for p in pieces])

    def _run(self, chunk: Chunk, a: int, b: int) -> bytes:
        if (a, b) not in chunk.runs:
            chunk.runs[a, b] = self._ids(chunk.pieces[a:b])
        return chunk.runs[a, b]

    def _chunk(self, text: str, pattern) -> Chunk:
        found = self.chunks.get(text)
        if found is not None:
            self.reused += 1
            self.chunks.move_to_end(text)
            return found
        found = self.chunks[text] = Chunk(pattern.findall(text))
        self.chunk_chars += len(text)
        while self.chunk_chars > self.max_chunk_chars and len(self.chunks) > 1:
            self.chunk_chars -= len(self.chunks.popitem(last=False)[0])
        return found

    def _join(self, left: Chunk, lo: int, right: Chunk, pattern) -> tuple[int, list[str], int | None]:
        """(k, pieces, r): left's pieces stand up to k, then ``pieces``, then right's from r; None: no agreement, the
        pieces run to right's end."""
        ends, k = left.cuts(), len(left.pieces)
        while k > lo and ends[k] > ends[-1] - SAFE:
            k -= 1
        tail, head, take = "".join(left.pieces[k:]), right.cuts(), 4
        while True:
            take = min(take, len(right.pieces))
            whole = take == len(right.pieces)
            pieces = pattern.findall(tail + "".join(right.pieces[:take]))
            at, starts = 0, {len(tail) + e: r for r, e in enumerate(head[: take + 1])}
            for n, p in enumerate(pieces, 1):
                at += len(p)
                if at in starts and (at <= len(tail) + head[take] - SAFE):
                    return k, pieces[:n], starts[at]
            if whole:
                return k, pieces, None
            take *= 2

    def encode(self, text: str, cuts: list[int], pattern) -> bytes:
        """The ids of ``text``, cut at ``cuts``, as little-endian 32-bit integers."""
        if not cuts:
            chunk = self._chunk(text, pattern)
            return self._run(chunk, 0, len(chunk.pieces))
        out, edges = [], [0, *cuts, len(text)]
        left, lo = self._chunk(text[: edges[1]], pattern), 0
        for a, b in zip(edges[1:], edges[2:]):
            right = self._chunk(text[a:b], pattern)
            k, pieces, r = self._join(left, lo, right, pattern)
            out.append(self._run(left, lo, k))
            if r is None:  # the join runs through the whole of the right chunk: its pieces are provisional
                left, lo = Chunk(pieces), 0
            else:
                out.append(self._ids(pieces))
                left, lo = right, r
        out.append(self._run(left, lo, len(left.pieces)))
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) for t in texts])
        at = cut_points(codes)
        out, lo = [], 0
        first = 0
        for text, hi in zip(texts, ends):
            last = np.searchsorted(at, hi)
            own = codes[lo:hi]
            if any(x in text for x in self.added) or not (simple := not len(own) or own.max() < SIMPLE) and not self.stable[own].all():
                out.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<i4").tobytes())
            else:
                cuts = at[first:last] - lo
                out.append(self.encode(text, cuts[cuts >= 1 << WINDOW_STEPS].tolist(), self.simple if simple else self.full))
            lo, first = hi, last
        return out

    def decode(self, ids: np.ndarray) -> str:
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths, dtype=np.int64)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + lengths, lengths)
        return self.table[at].tobytes().decode("utf-8", "replace")


def cut_points(codes: np.ndarray) -> np.ndarray:
    """Offsets before which a chunk ends, from the characters just before them alone."""
    h = codes * np.uint32(0x9E3779B1)
    for step in range(WINDOW_STEPS):
        width = 1 << step
        moved = np.zeros_like(h)
        moved[width:] = h[:-width] if len(h) > width else 0
        h = h + (moved << np.uint32(width)) if width < 32 else h
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """The codec of this process, kept for its further tasks."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _list_array(parts: list[bytes]) -> pa.Array:
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    return pa.LargeListArray.from_arrays(np.concatenate(([0], np.cumsum(sizes))), pa.array(np.frombuffer(b"".join(parts), "<i4"))).cast(pa.list_(pa.int32()))


def bpe_round_trip(docs: DataFrame, path: str, decode: bool = True) -> DataFrame:
    """Every row of ``docs`` with ``ids`` (array<int>) of its whole ``text`` and, with ``decode``, ``decoded``.

    path: a tokenizers file of a byte-level BPE, on every machine. Null text counts as empty and gives no ids.
    Other columns stay; columns named ``ids`` or ``decoded`` are replaced. A narrow map: no shuffle, memory bounded by
    the batch and the two dictionaries.
    """
    made = {"ids", "decoded"} if decode else {"ids"}
    kept = [f for f in docs.schema.fields if f.name not in made]
    schema = T.StructType([*kept, T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.StringType())] * decode)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in text_slices(batches):
            parts = own.encode_all([t or "" for t in batch.column("text").to_pylist()])
            columns = [batch.column(f.name) for f in kept] + [_list_array(parts)]
            if decode:
                columns.append(pa.array([own.decode(np.frombuffer(p, "<i4")) for p in parts], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "ids", *["decoded"] * decode])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """Every row with ``decoded``, the text of its ``ids``, special tokens included; null ids give null."""
    kept = [f for f in encoded.schema.fields if f.name != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.asarray(ids, np.int64)) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(texts, pa.string())], [*(f.name for f in kept), "decoded"])

    return encoded.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.StringType())]))
