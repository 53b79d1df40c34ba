"""Exact Jaccard join of word n-gram sets: size-banded tiles, bitmap bounds, sorted-array intersection.

1. A scan digests every text's set; equal sets are one class from here on.
2. Candidates. Bands of sizes are so wide that linked sets fall into one band or neighbours. In band u linked sets
   differ in at most d elements, so if hashing deals the elements into d + 1 parts, some part is the same in
   both. A set therefore gives one key for each part (band, part, hash of the part's elements); sets that share
   none are not linked. A frequent n-gram makes no hot key, as a key is the whole part. Where a part is empty
   the elements are dealt again with another seed, so that no link rests on empty parts. Sets that share a key are
   tied to its smallest set (a star, not all pairs); a star's sets are a group that holds every pair of its keys.
3. Groups are dealt into blocks of a size band and a bounded number of elements; a tile is a pair of blocks whose
   sizes allow links. Tiles of hashed bitmaps come first: bit counts bound the overlap from above, and only sets
   within a pair's bound stay, now in groups of sets that are tied by such pairs.
4. Tiles of these groups intersect the sorted arrays exactly. The links' components, with equal sets put back, are
   the result.

Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.text import LOWER, blocks, mix, prefix, ranges, signed, utf8, windows, words
from domora.llm.suffixes import keyed, shuffles_removed
from domora.operators.graph import components
from domora.session import materialise, table

#: Elements of the sets in a block of a tile (about 4 MB); groups within it are one block, and some share a call.
BLOCK = 1 << 19
#: Width of the size bands of the blocks of larger groups; bits of a bitmap for each element, at least.
STEP = 1.0625
BITS = 4
#: Keys that a task holds before it combines and sends them; partitions of these keys, for each of Spark's shuffle partitions.
HELD_KEYS, KEY_PARTITIONS = 1 << 19, 3
#: Classes of equal sets that are known to the candidate scan, which passes over their copies.
HEAVY = 4096
#: Up to so many parts an empty one is dealt with by another seed; above, the chance that all equal parts are empty is below 1e-10 even for a pair at the threshold.
RESEED = 24


@dataclass(frozen=True)
class Rule:
    """n words a shingle; linked if den * |intersection| >= num * |union|.

    The similarity num / den is from 1/2 to 1: below, parts of sets of very different sizes no longer meet, so
    that links would be lost; such a rule raises ValueError.
    """

    n: int
    num: int
    den: int = 100

    def __post_init__(self):
        if self.n < 1 or not self.den <= 2 * self.num <= 2 * self.den:
            raise ValueError(f"similarity {self.num}/{self.den} of {self.n}-word shingles; it must be from 1/2 to 1")


@lru_cache(maxsize=8)
def bands(num: int, den: int, most: int) -> np.ndarray:
    """Lower edges: sizes a <= b with num * b <= den * a lie in one band or in neighbours."""
    edges = [1]
    while edges[-1] <= most:
        edges.append(max(edges[-1] + 1, edges[-1] * den // num + 1))
    return np.array([*edges, max(edges[-1] + 1, edges[-1] * den // num + 1), 1 << 60], np.int64)


def shingles(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(hashes, rows, number of rows): the distinct n-word hashes of each text, sorted by row and hash."""
    raw, offsets = utf8(column)
    raw = LOWER[raw]
    start, end, row = words(raw, offsets)
    hashes = ranges(prefix(raw), start, end)
    count = np.bincount(row, minlength=len(offsets) - 1)
    out, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    if len(hashes) >= n:
        inside = row[: len(row) - n + 1] == row[n - 1 :]
        out.append(windows(hashes, n)[inside])
        rows.append(row[: len(row) - n + 1][inside])
    for m in range(1, n):  # a text of fewer words is one shingle
        short = np.flatnonzero((count[row] == m) & np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
        if len(short):
            value = np.full(len(short), m, np.uint64)
            for k in range(m):
                value = mix(value * np.uint64(31) + hashes[short + k])
            out.append(value)
            rows.append(row[short])
    value, rows = np.concatenate(out), np.concatenate(rows)
    order = np.lexsort((value, rows))
    value, rows = value[order], rows[order]
    keep = np.concatenate([[True], (value[1:] != value[:-1]) | (rows[1:] != rows[:-1])]) if len(value) else np.zeros(0, bool)
    return value[keep], rows[keep], len(offsets) - 1


def _digest(value: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """A hash of each row's set; 0 for an empty one."""
    size = np.bincount(rows, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, rows, mix(value ^ np.uint64(0x5BF03635)))
    out = mix(total + size.astype(np.uint64)) | np.uint64(1)
    return np.where(size > 0, out, np.uint64(0))


def _part_keys(value: np.ndarray, rows: np.ndarray, size: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of the parts of every set."""
    edges = bands(rule.num, rule.den, int(size.max(initial=1)))
    band = np.searchsorted(edges, size, "right") - 1
    keys, owners = [], []
    for up in (0, 1):
        u = band + up
        parts = (rule.den - rule.num) * 2 * (edges[u + 1] - 1) // (rule.den + rule.num) + 1
        todo, seed = size > 0, 0
        while todo.any():
            mine = todo[rows]
            v, r = value[mine], rows[mine]
            begin = np.concatenate([[0], np.cumsum(np.where(todo, parts, 0))])
            spread = mix(v + np.uint64(seed * 7919 + 1))
            at = begin[r] + (spread >> np.uint64(16)).astype(np.int64) % parts[r]
            total, filled = np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], bool)
            np.add.at(total, at, mix(spread))
            filled[at] = True
            owner = np.repeat(np.arange(len(size)), np.where(todo, parts, 0))
            place = (np.arange(begin[-1]) - begin[owner]).astype(np.uint64)
            key = mix(total ^ mix(place + (u[owner].astype(np.uint64) << np.uint64(32)) + (np.uint64(seed) << np.uint64(56))))
            keys.append(key[filled])
            owners.append(owner[filled])
            empty = np.zeros(len(size), bool)
            empty[owner[~filled]] = True
            todo, seed = todo & empty & (parts <= RESEED), seed + 1
            if seed == 200:  # fewer elements than parts never fill them: such sets are equal or not linked
                break
    return np.concatenate(keys), np.concatenate(owners)


def digests(docs: DataFrame, rule: Rule) -> DataFrame:
    """key, doc_id, n_shingles, h for every row."""

    def run(batches: Iterator[pa.RecordBatch]):
        for block in blocks(batches):
            value, rows, n = shingles(block.column("text"), rule.n)
            out = [block.column("key"), block.column("doc_id"), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(signed(_digest(value, rows, n)))]
            yield pa.RecordBatch.from_arrays(out, names=["key", "doc_id", "n_shingles", "h"])

    return docs.mapInArrow(run, "key long, doc_id long, n_shingles long, h long")


def part_keys(docs: DataFrame, rule: Rule, heavy: dict[int, int], only: np.ndarray | None = None) -> DataFrame:
    """key, lo, hi: the parts of all sets, and a set (twice) or the least and the largest set of those that a task holds.

    Copies of the heavy classes give none but at one document. only: a filter of keys, whose sets come one by one.
    """
    shared = docs.sparkSession.sparkContext.broadcast((heavy, only))  # at most HEAVY entries, FILTER_BITS bits

    def found(block: pa.RecordBatch, held: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        value, rows, n = shingles(block.column("text"), rule.n)
        h = signed(_digest(value, rows, n))
        first = np.zeros(n, bool)
        first[np.unique(h, return_index=True)[1]] = True
        for i, (x, doc) in enumerate(zip(h.tolist(), block.column("key").to_pylist(), strict=True)):
            if x in held and held[x] != doc:
                first[i] = False
        mine = first[rows]
        keys, owner = _part_keys(value[mine], rows[mine], np.bincount(rows[mine], minlength=n), rule)
        return keys, h[owner]

    def batch(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 1 << 17):
            yield pa.RecordBatch.from_arrays([pa.array(signed(keys[a : a + (1 << 17)])), *(pa.array(x[a : a + (1 << 17)]) for x in (lo, hi))], names=["key", "lo", "hi"])

    def combined(held: list) -> Iterator[pa.RecordBatch]:
        keys, h = map(np.concatenate, zip(*held, strict=True))
        order = np.lexsort((h, keys))
        keys, h = keys[order], h[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        yield from batch(keys[new], h[new], h[np.append(new[1:], True)])

    def run(batches):
        heavy, bits = shared.value
        held, size = [], 0
        for block in blocks(batches):
            keys, h = found(block, heavy)
            if bits is not None:
                known = _may_hold(bits, keys)
                yield from batch(keys[known], h[known], h[known])
                continue
            held.append((keys, h))
            size += len(keys)
            if size >= HELD_KEYS:
                yield from combined(held)
                held, size = [], 0
        if size:
            yield from combined(held)

    return docs.select("key", "text").mapInArrow(run, "key long, lo long, hi long")


def stars(docs: DataFrame, rule: Rule, heavy: dict[int, int]) -> DataFrame:
    """h, cluster: every set that shares a key with others, with the smallest set of each such key; written.

    The few keys that several sets share make a filter, so that the join that finds their sets need not shuffle all
    keys again; a key that very many sets share is split there.
    """
    with shuffles_removed(docs.sparkSession):
        parts = KEY_PARTITIONS * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        keys = part_keys(docs, rule, heavy).repartition(parts, "key").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        common = materialise(keys.where("lo <> hi").select("key", F.col("lo").alias("cluster")))
        found = part_keys(docs, rule, heavy, key_filter(common)).join(common, "key").select(F.col("lo").alias("h"), "cluster").distinct()
        return materialise(found)


def signature(values: np.ndarray) -> bytes:
    """A bitmap of the hashed elements of a set, of a power of two of bits."""
    size = max(64, 1 << (BITS * len(values) - 1).bit_length())
    out = np.zeros(size, np.uint8)
    out[(values & np.uint64(size - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").tobytes()


def _least_common(rule: Rule, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest intersection of linked sets of these sizes."""
    return -(-rule.num * (a + b) // (rule.num + rule.den))


class Ties:
    """A forest over places, as labels; ties holds its edges."""

    def __init__(self, n: int):
        self.label, self.ties = np.arange(n), []

    def tie(self, i: int, js: np.ndarray) -> None:
        for new in np.unique(self.label[js]):
            if new != self.label[i]:
                self.ties.append((i, int(js[np.flatnonzero(self.label[js] == new)[0]])))
                self.label[self.label == new] = self.label[i]


def bounded_ties(n: np.ndarray, maps: list[bytes], side: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """A forest of the pairs whose bitmaps allow a link. side: 0 and 1, pairs are between them; all 0: pairs inside.

    Bitmaps of sizes that differ by a factor of two are compared after the larger one is folded; linked sets never
    differ by more.
    """
    level = np.array([len(x) for x in maps])
    forest = Ties(len(maps))
    for width in np.unique(level):
        folded = level == 2 * width
        rows = np.flatnonzero((level == width) | folded)
        body = np.zeros((len(rows), max(1, width // 8)), np.uint64)
        for r, i in enumerate(rows):
            words = np.frombuffer(maps[i], np.uint64)
            body[r] = words[: len(words) // 2] | words[len(words) // 2 :] if folded[i] else words
        two = side.any()
        for r, i in enumerate(rows):
            if two and side[i]:
                continue
            js = np.flatnonzero(side[rows] == 1) if two else np.arange(r + 1, len(rows))
            js = js[(forest.label[rows[js]] != forest.label[i]) & ~(folded[i] & folded[rows[js]])]
            least = _least_common(rule, n[i], n[rows[js]])
            js, least = js[least <= np.minimum(n[i], n[rows[js]])], least[least <= np.minimum(n[i], n[rows[js]])]
            if not len(js):
                continue
            mine, theirs = body[r], body[js]
            most = np.minimum(n[i] - np.bitwise_count(mine & ~theirs).sum(axis=1, dtype=np.int64), n[rows[js]] - np.bitwise_count(theirs & ~mine).sum(axis=1, dtype=np.int64))
            if (most >= least).any():
                forest.tie(i, rows[js[most >= least]])
    return forest.ties


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray], same: bool, rule: Rule, every: bool = True) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """(i, j, ties): places of the linked pairs of sorted sets, i < j if both sides are the same list, and a forest of them.

    Right places count on after the left ones in ties. Without every, pairs that are tied already are not compared.
    """
    nl, nr = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    # numbers in the order of the values: an intersection marks one side's numbers and looks the other's up
    known, flat = np.unique(np.concatenate(right), return_inverse=True)
    ends = np.concatenate([[0], np.cumsum(nr)])
    mark, base = np.zeros(len(known), bool), 0 if same else len(left)
    forest, found_i, found_j = Ties(base + len(right)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, own in enumerate(left):
        js = np.arange(i + 1 if same else 0, len(right))
        if not every:
            js = js[forest.label[base + js] != forest.label[i]]
        least = _least_common(rule, nl[i], nr[js])
        js, least = js[least <= np.minimum(nl[i], nr[js])], least[least <= np.minimum(nl[i], nr[js])]
        if not len(js):
            continue
        if same:
            at = flat[ends[i] : ends[i + 1]]
        else:
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at = at[known[at] == own]
        mark[at] = True
        dense = 2 * len(js) > js[-1] - js[0]
        body = flat[ends[js[0]] : ends[js[-1] + 1]] if dense else np.concatenate([flat[ends[j] : ends[j + 1]] for j in js])
        begin = ends[js] - ends[js[0]] if dense else np.concatenate([[0], np.cumsum(nr[js])[:-1]])
        total = np.concatenate([[0], np.cumsum(mark[body], dtype=np.int64)])
        js = js[total[begin + nr[js]] - total[begin] >= least]
        mark[at] = False
        if len(js):
            forest.tie(i, base + js)
            found_i.append(np.full(len(js), i))
            found_j.append(js)
    return np.concatenate(found_i), np.concatenate(found_j), forest.ties


def _sides(frame: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, pd.DataFrame, bool]]:
    """(left, right, whether they are one block) of each tile of a call."""
    for _, own in frame.groupby("cluster"):
        i, j = own["i"].iloc[0], own["j"].iloc[0]
        left, right = (own[own["block"] == b].sort_values("h") for b in (i, j))
        if len(left) and len(right):
            yield left, right, i == j


def _bitmap_tile(rule: Rule):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """a, b: a forest of the pairs that the bitmaps allow."""
        out = []
        for left, right, same in _sides(frame):
            both = left if same else pd.concat([left, right])
            side = np.zeros(len(both), np.int8)
            side[len(left) :] = 1
            h = both["h"].to_numpy()
            out += [(h[i], h[j]) for i, j in bounded_ties(both["n"].to_numpy(np.int64), both["signature"].to_list(), side, rule)]
        return pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return run


def _exact_tile(rule: Rule, every: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Rows a, b: a forest of the links; rows a, null: the copies that a is linked with."""
        out = [pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "links": pd.Series(dtype="int64")})]
        for left, right, same in _sides(frame):
            arrays = [[np.asarray(s, np.int64) for s in side["shingles"]] for side in ((left,) if same else (left, right))]
            i, j, ties = linked_pairs(arrays[0], arrays[-1], same, rule, every)
            hs = np.concatenate([s["h"].to_numpy() for s in ((left,) if same else (left, right))])
            if every and len(i):
                copies, base = [left["copies"].to_numpy(), right["copies"].to_numpy()], 0 if same else len(left)
                links = np.bincount(i, copies[1][j], len(hs)) + np.bincount(base + j, copies[0][i], len(hs))
                found = links > 0
                out.append(pd.DataFrame({"a": hs[found], "b": pd.array([pd.NA] * int(found.sum()), "Int64"), "links": links[found].astype(np.int64)}))
            if ties:
                out.append(pd.DataFrame({"a": hs[[t[0] for t in ties]], "b": pd.array(hs[[t[1] for t in ties]], "Int64"), "links": 0}))
        return pd.concat(out)

    return run


#: Bits of the filter that spares texts a shuffle; with many more keys it lets all pass, and the joins do the work.
FILTER_BITS = 1 << 24


def _places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(keys.view(np.uint64) + np.uint64(41))
    return (h % np.uint64(FILTER_BITS)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def key_filter(keys: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size over a column key, as 64-bit words; tasks' parts are united by Spark."""

    def run(batches):
        for batch in batches:
            at = np.unique(np.concatenate(_places(batch.column("key").to_numpy(zero_copy_only=False))))
            if len(at):
                new = np.flatnonzero(np.concatenate([[True], at[1:] >> 6 != at[:-1] >> 6]))
                bits = np.bitwise_or.reduceat(np.uint64(1) << (at & 63).astype(np.uint64), new)
                yield pa.RecordBatch.from_arrays([pa.array((at[new] >> 6).astype(np.int32)), pa.array(signed(bits))], names=["word", "bits"])

    out = np.zeros(FILTER_BITS // 64, np.uint64)
    found = keys.select("key").mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()  # FILTER_BITS / 64 rows at most
    out[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _may_hold(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    one, two = ((bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) for p in _places(keys))
    return (one & two) > 0


def passing(docs: DataFrame, bits: np.ndarray, inside: bool) -> DataFrame:
    """Rows whose key may be in the filter, or those whose key is not."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_may_hold(shared.value, batch.column("key").to_numpy(zero_copy_only=False)) == inside))

    return docs.mapInArrow(run, docs.schema)


def _tiles(members: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame]:
    """(cluster, i, j, block, call: the blocks of every tile; members with their block), of members (cluster, h, n).

    A group of more than BLOCK elements is dealt by size band and, inside a band, by a hash into blocks of about
    BLOCK elements, so nothing orders or holds a whole group.
    """
    total = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    step = F.when(F.col("total") <= BLOCK, F.lit(0)).otherwise(F.floor(F.log("n") / math.log(STEP)) + 1).cast("long")
    sized = members.join(total, "cluster").withColumn("step", step)
    cells = sized.groupBy("cluster", "step").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("salts"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.first("total").alias("total"))
    cells = materialise(cells)
    block = lambda salt: F.col("step") * (1 << 24) + salt
    members = sized.drop("total").join(cells.select("cluster", "step", "salts"), ["cluster", "step"]).withColumn("block", block(F.pmod(F.xxhash64("h"), F.col("salts")))).drop("step", "salts")
    each = cells.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).withColumn("block", block(F.col("salt")))
    i, j = each.select("cluster", F.col("block").alias("i"), "hi", "total"), each.select("cluster", F.col("block").alias("j"), "lo")
    tiles = i.join(j, "cluster").where((F.col("i") <= F.col("j")) & (F.col("hi") * rule.den >= F.col("lo") * rule.num))
    small = cells.where(F.col("total") <= BLOCK).agg(F.sum("total").alias("n")).first()["n"] or 0
    call = F.when(F.col("total") <= BLOCK, F.pmod(F.xxhash64("cluster"), F.lit(max(1, small // BLOCK)))).otherwise(F.xxhash64("cluster", "i", "j"))
    return tiles.withColumn("call", call).select("cluster", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"), "call"), members


def _in_tiles(members: DataFrame, payload: DataFrame, rule: Rule, run, schema: str) -> DataFrame:
    """run() over the tiles of members (cluster, key, h, n, ...), each set with its payload (key, ...); written."""
    with shuffles_removed(members.sparkSession):
        tiles, members = _tiles(members, rule)
        placed = members.join(payload, "key").drop("key").join(tiles, ["cluster", "block"])
        return materialise(placed.groupBy("call", "i", "j").applyInPandas(run, schema))


def near_duplicates(docs: DataFrame, rule: Rule) -> DataFrame:
    """One row per document: its group.

    doc_id, n_shingles, component_id (smallest doc_id reachable by links), n_links (documents linked directly),
    stays (the first document of its group). Null, empty and wordless texts have no shingles, are linked with
    nothing and stay; texts of fewer than n words are one shingle. Repeated rows are documents each, linked if
    they have words; a null doc_id keeps its row and is the smallest only where all of a group are null.
    A very long text is held by one task while its shingles are made. Only doc_id and text are read. An empty table gives an empty one.
    """
    return _groups(keyed(docs), rule, True).drop("key")


def keep_first(docs: DataFrame, rule: Rule, extra: list[str] = ()) -> DataFrame:
    """doc_id, text and the extra columns of the first document of each group; the same documents stay as above."""
    docs = keyed(docs, extra)
    gone = materialise(_groups(docs, rule, False).where("not stays").select("key"))
    bits = key_filter(gone)
    doubtful = passing(docs, bits, True).join(gone, "key", "left_anti")
    return passing(docs, bits, False).unionByName(doubtful).drop("key")


def _payload(docs: DataFrame, wanted: DataFrame, rule: Rule, name: str, kind: str, of) -> DataFrame:
    """key and of(sorted elements) of the documents that a column key of wanted names; the filter may let a few more pass."""
    shared = docs.sparkSession.sparkContext.broadcast(key_filter(wanted))

    def run(batches):
        for block in blocks(b.filter(pa.array(_may_hold(shared.value, b.column("key").to_numpy(zero_copy_only=False)))) for b in batches):
            value, rows, n = shingles(block.column("text"), rule.n)
            ends = np.searchsorted(rows, np.arange(n + 1))
            found = pa.array([of(value[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary() if kind == "binary" else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([block.column("key"), found], names=["key", name])

    return docs.select("key", "text").mapInArrow(run, f"key long, {name} {kind}")


def _groups(docs: DataFrame, rule: Rule, every: bool) -> DataFrame:
    """near_duplicates() of keyed documents, with their key; without every, n_links is not counted (null)."""
    known = materialise(digests(docs.select("key", "doc_id", "text"), rule))
    classes = known.where("n_shingles > 0").groupBy("h").agg(F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.max("n_shingles").alias("n"))
    classes = materialise(classes)
    heavy = {r["h"]: r["key"] for r in classes.where("copies > 1").orderBy(F.desc("copies"), "h").limit(HEAVY).collect()}
    about = classes.select("h", "key", "n", "copies")
    wide = materialise(stars(docs, rule, heavy).join(about, "h"))
    bitmaps = _payload(docs, wide, rule, "signature", "binary", signature)
    ties = _in_tiles(wide.select("cluster", "key", "h", "n"), bitmaps, rule, _bitmap_tile(rule), "a long, b long")
    narrow = materialise(components(ties).select(F.col("node").alias("h"), F.col("root").alias("cluster")).join(about, "h"))
    arrays = _payload(docs, narrow, rule, "shingles", "array<long>", lambda x: np.sort(signed(x)))
    found = _in_tiles(narrow.select("cluster", "key", "h", "n", "copies"), arrays, rule, _exact_tile(rule, every), "a long, b long, links long")
    roots = components(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
    linked = classes.select("h", "copies").join(roots.select(F.col("node").alias("h"), "root"), "h", "left").join(links.withColumnRenamed("a", "h"), "h", "left")
    n_links = F.col("copies") - 1 + F.coalesce("links", F.lit(0)) if every else F.lit(None).cast("long")
    linked = linked.select("h", F.coalesce("root", "h").alias("root"), n_links.alias("n_links"))
    labelled = known.where("n_shingles > 0").join(linked, "h")
    first = classes.select("h", "doc_id", "key").join(linked, "h").groupBy("root").agg(F.min("doc_id").alias("component_id"), F.min("key").alias("least"))
    names = ["key", "doc_id", "n_shingles", "component_id", "n_links", "stays"]
    full = labelled.join(first, "root").withColumn("stays", F.col("key") == F.col("least")).select(*names)
    none = known.where("n_shingles = 0").select("key", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays"))
    return full.unionByName(none)


def op6_jaccard_join(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), Rule(3, 90)).drop("stays")


def oracle(rule: Rule = Rule(3, 90)) -> str:
    gram = " || ' ' || ".join(f"ws[i + {k}]" for k in range(rule.n))
    return rf"""
with recursive lists as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select distinct doc_id, s from (
  select doc_id, unnest(list_transform(range(1, len(ws) - {rule.n - 2}), lambda i: {gram})) as s from lists where len(ws) >= {rule.n}
  union all select doc_id, array_to_string(ws, ' ') from lists where len(ws) between 1 and {rule.n - 1})),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
l as (select a, b from c join n na on na.doc_id = a join n nb on nb.doc_id = b where {rule.den} * c >= {rule.num} * (na.n + nb.n - c)),
r(a, b) as (select a, b from l union select r.a, l.b from r join l on r.b = l.a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) as component_id, coalesce(k.k, 0)::bigint as n_links
from documents d left join n on n.doc_id = d.doc_id left join (select a, min(b) as m from r group by a) m on m.a = d.doc_id
left join (select a, count(*) as k from l group by a) k on k.a = d.doc_id"""
