"""Packing token pieces into sequences by linear grouping, configurations of few sizes, and best fit.

Large pieces, sorted by length, fall into groups of equal cardinality, and each length is rounded up to its
group's largest. Over these few sizes, configurations (multisets that fit a sequence) are chosen with how
often to use them; then the actual pieces take the places of the rounded ones, and the small pieces go, longest
first, into the sequence with the least room that holds them. The plan needs only histograms over lengths, at
most `capacity` numbers whatever the corpus; Spark ranks pieces within their length (in salted shards, so that
a very common length is no hot key) and a rank decides the place.
"""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domora.llm.bpe import MEMO, TreeEncoder, public_path
from domora.llm.text import blocks, release, utf8
from domora.session import materialise, table

CAPACITY = 2048
END_ID = 0
GROUPS = 160
#: Pieces that a shard of one length gets on average, at most.
SHARD = 200_000
#: UTF-8 of white space of any kind, or its start.
_WHITE = [b" ", b"\t", b"\n", b"\v", b"\f", b"\r", b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80"]
_SPACE_STARTS = re.compile(r"(?<=\S)(?= )|(?= \S)")


class ByteEncoder(TreeEncoder):
    """As TreeEncoder for byte-level BPE, where a single space belongs to the word after it."""

    def __init__(self, path: str):
        super().__init__(path)
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # the file spells bytes as printable characters: those that are printable stand for themselves, the others follow from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        special = {s: self.library.token_to_id(s) for s in self.special}
        ranks = {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)

    def batch(self, texts: list[bytes]) -> list[bytes]:
        cut = [self.cut(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def learn(self, pieces: set[bytes]) -> None:
        """Encode the pieces that the memo lacks; any piece is cheap here, as its cost is in proportion."""
        new = pieces.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = pieces
        encode, held = self.fast.encode_ordinary, self.memo
        for p in new:
            held[p] = array("I", encode(p.decode())).tobytes()
        for p in [p for p in new if any(s.encode() in p for s in self.special)]:
            held[p] = array("I", self.library.encode(p.decode(), add_special_tokens=False).ids).tobytes()

    @staticmethod
    def cut(text: bytes) -> list[bytes]:
        """Pieces that start with a space, where a token always starts too.

        A token can hold a space inside only among other white space. So a space starts a token if white space
        of any kind stands before it or after it, but not on both sides; a text's end counts as white space.
        """
        if not text.endswith(b" ") and not any(c in text and b" " + c in text for c in _WHITE):
            first, *rest = text.split(b" ")
            return ([first] if first else []) + [b" " + p for p in rest]
        return [p.encode() for p in _SPACE_STARTS.split(text.decode()) if p]


_ENCODERS: dict[str, ByteEncoder] = {}


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and an end id, cut only above the capacity.

    The first piece takes the remainder. Null and empty texts are the end id alone. Repeated rows give pieces
    each; only doc_id and text are read.
    """

    def run(batches):
        if path not in _ENCODERS:
            _ENCODERS[path] = ByteEncoder(path)
        enc = _ENCODERS[path]
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            data = raw.tobytes()
            rows: list[tuple] = []
            ids = enc.batch([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            for doc, own in zip(block.column("doc_id").to_pylist(), ids, strict=True):
                own += END_ID.to_bytes(4, "little")
                first = len(own) // 4 % capacity or capacity
                edges = [0, *range(first, len(own) // 4 + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(own[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        enc.memo = {}
        release()  # the worker lives on for other tasks

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def ranked(rows: DataFrame, by: str, order: list[str], total: int) -> DataFrame:
    """rows with rank: from 0 within each value of by. order: columns that tell rows apart."""
    shards = max(1, -(-total // SHARD))
    cut = rows.withColumn("shard", F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    counts = cut.groupBy(by, "shard").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by).orderBy("shard")) - F.col("n")
    within = F.row_number().over(Window.partitionBy(by, "shard").orderBy(*order)) - 1
    return cut.withColumn("within", within).join(counts.select(by, "shard", before.alias("before")), [by, "shard"]).withColumn("rank", F.col("before") + F.col("within")).drop("within", "before", "shard")


# -- the plan, from histograms ---------------------------------------------------------------


@dataclass
class Places:
    """Tables that turn a rank into a place."""

    start: np.ndarray
    first_bin: np.ndarray


def groups(lengths: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """(rounded size, count) of n groups of equal cardinality over (length, count), longest first."""
    total = sum(c for _, c in lengths)
    size, out, need, top = max(1, -(-total // n)), [], 0, 0
    for length, count in lengths:
        while count:
            if not need:
                need, top = size, length
                out.append([top, 0])
            take = min(need, count)
            out[-1][1] += take
            need, count = need - take, count - take
    return [tuple(x) for x in out]


def configurations(sizes: list[tuple[int, int]], capacity: int) -> list[tuple[dict[int, int], int]]:
    """[(group -> how many, how often)]: each takes the longest size left and the best fill from the others.

    A bit set over fill levels finds the fullest multiset; it is used as often as its counts allow.
    """
    left, out = [c for _, c in sizes], []
    while True:
        anchor = next((g for g, c in enumerate(left) if c), None)
        if anchor is None:
            return out
        room = capacity - sizes[anchor][0]
        levels, reach, mask = [], 1, (1 << (room + 1)) - 1
        for g, (size, _) in enumerate(sizes):
            have = left[g] - (g == anchor)
            if have <= 0 or size > room or size <= 0:
                continue
            for _ in range(min(have, room // size)):
                more = (reach | reach << size) & mask
                if more == reach:
                    break
                levels.append((g, size, reach))
                reach = more
            if reach >> room & 1:
                break
        fill, used = reach.bit_length() - 1, {anchor: 1}
        for g, size, before in reversed(levels):
            if not before >> fill & 1:
                used[g], fill = used.get(g, 0) + 1, fill - size
        often = min(left[g] // q for g, q in used.items())
        for g, q in used.items():
            left[g] -= q * often
        out.append((used, often))


def place_large(lengths: list[tuple[int, int]], capacity: int) -> tuple[Places, int]:
    """Ranks over all large pieces, longest first, to sequences; and the number of sequences."""
    sizes = groups(lengths, GROUPS)
    next_rank = np.concatenate([[0], np.cumsum([c for _, c in sizes])]).astype(int).tolist()
    start, first_bin, bins = [], [], 0
    for used, often in configurations(sizes, capacity):
        for g, q in used.items():
            for _ in range(q):
                start.append(next_rank[g])
                first_bin.append(bins)
                next_rank[g] += often
        bins += often
    order = np.argsort(np.array(start, np.int64), kind="stable")
    # the first entry stands for no place, so that any rank finds an entry
    return Places(np.append(-1, np.array(start, np.int64)[order]), np.append(0, np.array(first_bin, np.int64)[order])), bins


def best_fit(free: list[tuple[int, int]], lengths: list[tuple[int, int]], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """[(length, first rank, pieces a sequence, first free class, first rank in it)] and new sequences.

    free: (room, sequences). New sequences are the class capacity + 1.
    """
    room: dict[int, list[tuple[int, int, int]]] = {f: [(f, 0, n)] for f, n in free if f > 0}
    out, fresh = [], 0
    for length, count in sorted(lengths, reverse=True):
        rank = 0
        while count:
            f = min((f for f in room if f >= length), default=None)
            if f is None:
                f, need = capacity, -(-count // (capacity // length))
                room[f] = [(capacity + 1, fresh, need)]
                fresh += need
            origin, begin, bins = room[f].pop()
            if not room[f]:
                del room[f]
            each = min(f // length, count)
            take = min(bins, count // each)
            out.append((length, rank, each, origin, begin))
            rank, count = rank + take * each, count - take * each
            if f - each * length > 0:
                room.setdefault(f - each * length, []).append((origin, begin, take))
            if take < bins:
                room.setdefault(f, []).append((origin, begin + take, bins - take))
    return out, fresh


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. Lengths are 1 to capacity; an empty table gives an empty one.

    pieces are written to the shared folder once, so that ranks stay as they are if a task is repeated.
    """
    spark = pieces.sparkSession
    pieces = materialise(pieces)
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    histogram = [(r["length"], r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.desc("length")).collect()]
    total = sum(n for _, n in histogram)
    large = [(x, n) for x, n in histogram if x > capacity // 8]
    small = [(x, n) for x, n in histogram if x <= capacity // 8]
    places, bins = place_large(large, capacity)
    before = dict(zip([x for x, _ in large], np.concatenate([[0], np.cumsum([n for _, n in large])]).astype(int).tolist(), strict=False))
    order = ranked(pieces, "length", keys, total)
    first = np.zeros(capacity + 1, np.int64)
    for x, r in before.items():
        first[x] = r
    held = spark.sparkContext.broadcast((places, first))  # a few places for each group and configuration

    @F.pandas_udf("long")
    def large_bin(length, rank):
        at, begin = held.value
        overall = begin[length.to_numpy(np.int64)] + rank.to_numpy(np.int64)
        i = np.searchsorted(at.start, overall, "right") - 1
        import pandas as pd

        return pd.Series(at.first_bin[i] + overall - at.start[i])

    placed = materialise(order.withColumn("bin", F.when(F.col("length") > capacity // 8, large_bin("length", "rank"))))
    rooms = placed.where("bin is not null").groupBy("bin").agg((capacity - F.sum("length")).cast("long").alias("free")).where("free > 0")
    rooms = materialise(ranked(rooms, "free", ["bin"], bins))
    free = [(r["free"], r["n"]) for r in rooms.groupBy("free").agg(F.count("*").alias("n")).collect()]
    steps, _ = best_fit(free, small, capacity)
    steps.sort()
    wide = 1 << 44
    base = np.array([s[0] * wide + s[1] for s in steps], np.int64)
    rest = np.array([s[1:] for s in steps], np.int64).reshape(len(steps), 4)
    small_held = spark.sparkContext.broadcast((base, rest))  # bounded by capacity x classes

    @F.pandas_udf("struct<free:long,rank:long>")
    def small_place(length, rank):
        import pandas as pd

        base, rest = small_held.value
        r = rank.to_numpy(np.int64)
        i = np.searchsorted(base, length.to_numpy(np.int64) * wide + r, "right") - 1
        return pd.DataFrame({"free": rest[i, 2], "rank": rest[i, 3] + (r - rest[i, 0]) // rest[i, 1]})

    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    little = placed.where("bin is null").withColumn("at", small_place("length", "rank")).select(*names, F.col("at.free").alias("free"), F.col("at.rank").alias("rank"))
    fresh = little.where(F.col("free") > capacity).select(*names, (F.col("rank") + bins).alias("sequence_id"))
    filled = little.where(F.col("free") <= capacity).join(rooms, ["free", "rank"]).select(*names, F.col("bin").alias("sequence_id"))
    every = placed.where("bin is not null").select(*names, F.col("bin").alias("sequence_id")).unionByName(filled).unionByName(fresh)
    # at most `capacity` pieces share a sequence
    w = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *keys).rowsBetween(Window.unboundedPreceding, -1)
    return every.withColumn("offset", F.coalesce(F.sum("length").over(w), F.lit(0)).cast("long"))


def op3_best_fit_packing(spark, sf_dir):
    return pack(token_pieces(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json")))
