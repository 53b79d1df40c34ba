"""Repeated 100-byte strings: suffixes ordered by passes over leading bytes, limited to the threshold's depth.

Only the first 100 bytes of a suffix matter. Suffixes are dealt into buckets, and the suffixes of a bucket are ordered by passes of
eight bytes, the most significant ones first. One that is alone in its group after a pass leaves; the groups that are left
after 100 bytes are exactly the repeated windows.

* Buckets: a suffix belongs to its anchor, the 28-byte string with the least hash in its first 100 bytes. Neighbouring suffixes
  share an anchor, so one row stands for a run of about 37 suffixes, and equal windows always have equal anchors. (Buckets of
  leading bytes would shuffle a row for every byte of the corpus.)
* Before the passes: runs whose bytes are all equal hold equal windows, so only the first of them goes on; the others are
  covered whole. A run that is alone in its bucket goes too. Tasks settle repeats inside their own block before the shuffle.
* Passes: a task takes whole buckets of at most LARGE suffixes and compares bytes, not hashes.

No bucket grows with the corpus in a task's memory. Anchors that very many runs share (a bounded list from a scan) skip the buckets: their
windows are grouped by a hash of all 100 bytes at once. Buckets of more than LARGE suffixes, whatever their number, take
the same way after the first shuffle, with aggregates that tasks begin. Anchors, runs and these windows are told apart by
64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domora.llm.text import BLOCK_BYTES, blocks, mix, prefix, ranges, signed, utf8
from domora.session import materialise, table

DEPTH = 100
ANCHOR = 28
#: Anchors that are taken apart by windows at once, and how often one must stand in a block to be proposed.
HOT = 4096
HOT_IN_BLOCK = 3
#: Leading bytes of a pass, and the most suffixes of a bucket that a task orders.
DIGIT = 8
LARGE = 1 << 20
#: Bytes of runs in one batch.
_BODIES = 1 << 26
_PLACE = np.uint64((1 << 31) - 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of the width values from each place on."""
    out, size = x, 1
    while size * 2 <= width:
        out, size = np.minimum(out[:-size], out[size:]), size * 2
    return np.minimum(out[: len(out) - (width - size)], out[width - size :]) if size < width else out


def _segments(raw: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bytes, offsets, first byte): the block, or overlapping parts of one long text."""
    if len(raw) <= 2 * BLOCK_BYTES or len(offsets) > 2:
        yield raw, offsets, 0
        return
    for a in range(0, max(1, len(raw) - depth + 1), BLOCK_BYTES):
        part = raw[a : a + BLOCK_BYTES + depth - 1]
        yield part, np.array([0, len(part)]), a


def runs(raw: np.ndarray, offsets: np.ndarray, depth: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(row, start, n, anchor hash, content hash, prefix sums) of the runs of windows with one anchor."""
    width, empty = depth - anchor + 1, np.zeros(0, np.int64)
    if len(raw) < depth:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), np.zeros(1, np.uint64)
    sums = prefix(raw)
    place = np.arange(len(raw) - anchor + 1)
    hashes = ranges(sums, place, place + anchor)
    at = (_least((hashes & ~_PLACE) | place.astype(np.uint64), width) & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(at)]
    whole = np.arange(len(at)) + depth <= offsets[row + 1]
    change = np.ones(len(at), bool)
    change[1:] = (at[1:] != at[:-1]) | ~whole[:-1] | (row[1:] != row[:-1])
    start = np.flatnonzero(change & whole)
    stop = np.append(start[1:], len(at))
    good = np.concatenate([[0], np.cumsum(whole)])
    n = good[stop] - good[start]
    return row[start], start, n, hashes[at[start]], ranges(sums, start, start + n + depth - 1), sums


def _firsts(content: np.ndarray, key: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """True for the first of equal contents by (key, pos)."""
    order = np.lexsort((pos, key, content))
    first = np.ones(len(content), bool)
    first[order[1:]] = content[order[1:]] != content[order[:-1]]
    return first


def _spans(key: np.ndarray, pos: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that follow one another joined."""
    order = np.lexsort((pos, key))
    key, pos, n = key[order], pos[order], n[order]
    if not len(key):
        return key, pos, n
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (pos[1:] != pos[:-1] + n[:-1])])
    return key[new], pos[new], np.add.reduceat(n, np.flatnonzero(new))


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _block_rows(block: pa.RecordBatch, depth: int, hot: np.ndarray) -> tuple[np.ndarray, ...]:
    """(core, content, key, pos, n) of a block: runs, and single windows of hot anchors."""
    raw, offsets = utf8(block.column("text"))
    keys = block.column("key").to_numpy(zero_copy_only=False)
    out: list[tuple] = []
    for part, ends, base in _segments(raw, offsets, depth):
        row, start, n, anchor, content, sums = runs(part, ends, depth, min(ANCHOR, depth))
        known = np.isin(anchor, hot)
        if known.any():
            run, at = _windows_of(start[known], n[known])
            whole = ranges(sums, at, at + depth)
            out.append((whole, mix(whole), row[known][run], at, np.ones(len(at), np.int64), ends, base))
        out.append((anchor[~known], content[~known], row[~known], start[~known], n[~known], ends, base))
    cols = [np.concatenate([x[i] for x in out]) for i in (0, 1)]
    key = np.concatenate([keys[x[2]] for x in out])
    pos = np.concatenate([x[3] - x[5][x[2]] + x[6] for x in out])
    return cols[0], cols[1], key, pos, np.concatenate([x[4] for x in out])


def ordered(raw: np.ndarray, at: np.ndarray, bucket: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(place in `at`, group) of the suffixes that share their first depth bytes with another of their bucket, in order.

    A pass orders what is left by the next eight bytes, as one number, inside the groups of the passes before; suffixes alone in
    their group leave after it.
    """
    padded = np.concatenate([raw, np.zeros(DIGIT, np.uint8)])
    digits = np.ndarray((len(raw) + 1,), ">u8", padded, strides=(1,))
    left, group = np.arange(len(at)), bucket
    for done in range(0, depth, DIGIT):
        if not len(left):
            break
        digit = digits[at[left] + done].astype(np.uint64) >> np.uint64(8 * max(0, done + DIGIT - depth))
        order = np.lexsort((digit, group))
        left, group, digit = left[order], group[order], digit[order]
        new = np.ones(len(left) + 1, bool)
        new[1:-1] = (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])
        shared = ~(new[:-1] & new[1:])
        left, group = left[shared], np.cumsum(new[:-1])[shared]
    return left, group


def _windows_of(starts: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(run, place) of the windows of runs of so many windows."""
    run = np.repeat(np.arange(len(times)), times)
    return run, starts[run] + np.arange(len(run)) - np.repeat(np.cumsum(times) - times, times)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, the shuffle files of an action are deleted at its end; each one must be a whole pass."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def keyed(docs: DataFrame, extra: list[str] = ()) -> DataFrame:
    """key, doc_id, text and the extra columns: key is the order of documents as a unique number.

    It is doc_id itself where that is one. Null doc_ids come first; rows that share one come in the order of
    their texts. Null texts read as empty.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)
    by_id = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not by_id.where("n > 1 or doc_id is null").limit(1).count():
        return docs.select(F.col("doc_id").alias("key"), "doc_id", "text", *extra)
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first(), "text").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return materialise(ordered.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text", *extra))


def hot_anchors(docs: DataFrame, depth: int) -> np.ndarray:
    """The anchors that most runs share, at most HOT."""

    def run(batches):
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            for part, ends, _ in _segments(raw, offsets, depth):
                _, _, _, anchor, content, _ = runs(part, ends, depth, min(ANCHOR, depth))
                first = np.unique(content, return_index=True)[1]
                found, times = np.unique(anchor[first], return_counts=True)
                often = times >= HOT_IN_BLOCK
                if often.any():
                    yield _batch(["anchor", "n"], signed(found[often]), times[often].astype(np.int64))

    found = docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))
    return np.array([r["anchor"] for r in found.orderBy(F.desc("n"), "anchor").limit(HOT).collect()], np.int64).view(np.uint64)


def repeats(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """key, pos, n: windows pos .. pos + n - 1 of a text (from keyed()) that also start earlier."""
    shared = docs.sparkSession.sparkContext.broadcast(hot_anchors(docs, depth))  # at most HOT numbers

    def settled(batches):
        """Repeats inside a block."""
        for block in blocks(batches):
            _, content, key, pos, n = _block_rows(block, depth, shared.value)
            later = ~_firsts(content, key, pos)
            if later.any():
                yield _batch(["key", "pos", "n"], *_spans(key[later], pos[later], n[later]))

    def open_rows(batches):
        """The first of each block's equal runs."""
        for block in blocks(batches):
            core, content, key, pos, n = _block_rows(block, depth, shared.value)
            first = _firsts(content, key, pos)
            if first.any():
                yield _batch(["core", "content", "key", "pos", "n"], signed(core[first]), signed(content[first]), key[first], pos[first].astype(np.int32), n[first].astype(np.int32))

    texts = docs.select("key", "text")
    local = texts.mapInArrow(settled, "key long, pos long, n long")
    rows = texts.mapInArrow(open_rows, "core long, content long, key long, pos int, n int")
    rows = rows.repartition("core")
    by_core, by_content = Window.partitionBy("core"), Window.partitionBy("core", "content")
    shared_rows = (
        rows.withColumn("first", F.min(F.struct("key", "pos")).over(by_content))
        .withColumn("lo", F.min("content").over(by_core))
        .withColumn("hi", F.max("content").over(by_core))
        .withColumn("suffixes", F.sum("n").over(by_core))
        .withColumn("is_first", (F.col("first.key") == F.col("key")) & (F.col("first.pos") == F.col("pos")))
        .where("not is_first or lo <> hi")
        .select("core", "key", "pos", "n", "is_first", (F.col("suffixes") > LARGE).alias("is_large"))
    )
    held = materialise(shared_rows)
    equal = held.where("not is_first").select("key", F.col("pos").cast("long").alias("pos"), F.col("n").cast("long").alias("n"))
    found = local.unionByName(equal).unionByName(_in_buckets(texts, held.where("is_first and not is_large"), depth))
    large = held.where("is_first and is_large")
    return found.unionByName(_in_large_buckets(texts, large, depth)) if large.limit(1).count() else found


def _with_runs(texts: DataFrame, runs_: DataFrame) -> DataFrame:
    return texts.join(runs_.groupBy("key").agg(F.collect_list(F.struct("pos", "n", "core")).alias("runs")), "key")


def _runs_of(block: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(row, pos, n, core) of a block's runs."""
    lists = block.column("runs")
    row = np.repeat(np.arange(block.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
    return row, *(lists.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))


def _in_buckets(texts: DataFrame, runs_: DataFrame, depth: int) -> DataFrame:
    """Repeats among the runs of a bucket: their bytes go to the bucket's task, which orders the suffixes."""

    def cut(batches):
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            key = block.column("key").to_numpy(zero_copy_only=False)
            row, pos, n, core = _runs_of(block)
            total = np.cumsum(n + depth - 1)
            for part in np.split(np.arange(len(n)), np.searchsorted(total, np.arange(_BODIES, total[-1], _BODIES))):
                if not len(part):
                    continue
                size = n[part] + depth - 1
                ends = np.concatenate([[0], np.cumsum(size)])
                at = _windows_of((offsets[row] + pos)[part], size)[1]
                body = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw[at].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(core[part]), pa.array(key[row[part]]), pa.array(pos[part].astype(np.int32)), body], names=["core", "key", "pos", "body"])

    def settle(rows: pa.Table) -> pa.RecordBatch:
        raw, ends = utf8(rows.column("body").combine_chunks())
        run, at = _windows_of(ends[:-1], np.diff(ends) - depth + 1)
        core = rows.column("core").to_numpy()
        bucket = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
        left, group = ordered(raw, at, bucket[run], depth)
        key = rows.column("key").to_numpy()[run[left]]
        pos = rows.column("pos").to_numpy().astype(np.int64)[run[left]] + at[left] - ends[run[left]]
        later = ~_firsts(group, key, pos)
        return _batch(["key", "pos", "n"], *_spans(key[later], pos[later], np.ones(later.sum(), np.int64)))

    def passes(batches):
        """Batches come sorted by core; whole buckets are settled, the last one waits for the next batch."""
        held, size = [], 0
        for part in blocks(batches, "body"):
            held.append(part)
            size += part.column("body").nbytes
            if size < 2 * BLOCK_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            core = rows.column("core").to_numpy()
            edge = int(np.searchsorted(core, core[-1]))
            if edge:
                yield settle(rows.slice(0, edge))
                held = rows.slice(edge).combine_chunks().to_batches()
                size = sum(b.column("body").nbytes for b in held)
        if held:
            yield settle(pa.Table.from_batches(held))

    bodies = _with_runs(texts, runs_).mapInArrow(cut, "core long, key long, pos int, body binary")
    return bodies.repartition("core").sortWithinPartitions("core").mapInArrow(passes, "key long, pos long, n long")


def _in_large_buckets(texts: DataFrame, runs_: DataFrame, depth: int) -> DataFrame:
    """Repeats among the runs of large buckets: a row for each window, grouped by the hash of its bytes."""

    def windows(batches):
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            sums, key = prefix(raw), block.column("key").to_numpy(zero_copy_only=False)
            row, pos, n, _ = _runs_of(block)
            run, at = _windows_of(offsets[row] + pos, n)
            whole = ranges(sums, at, at + depth)
            yield _batch(["whole", "key", "pos"], signed(whole), key[row[run]], at - offsets[row[run]])

    each = materialise(_with_runs(texts, runs_).mapInArrow(windows, "whole long, key long, pos long"))
    place = F.struct("key", "pos")
    firsts = each.groupBy("whole").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1")
    return each.join(firsts, "whole").where(place != F.col("first")).select("key", "pos", F.lit(1).cast("long").alias("n"))


def without_repeats(docs: DataFrame, depth: int = DEPTH, extra: list[str] = ()) -> DataFrame:
    """doc_id, kept (binary: the bytes that stay), n_bytes, n_removed, n_spans and the extra columns of every row.

    A byte goes if a depth-byte string that also starts earlier covers it. Null texts read as empty and give
    an empty `kept`; null doc_ids count as the smallest, rows that share one as documents in the order of
    their texts. Other columns are not read; extra ones must have other names than the results.
    """
    docs = keyed(docs, extra)
    spans = repeats(docs, depth).groupBy("key").agg(F.collect_list(F.struct("pos", "n")).alias("spans"))

    def run(batches):
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            lists = block.column("spans")
            each = lists.flatten()
            row = np.repeat(np.arange(block.num_rows), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
            begin = offsets[row] + each.field(0).to_numpy(zero_copy_only=False)
            edge = np.zeros(len(raw) + 1, np.int64)
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + each.field(1).to_numpy(zero_copy_only=False) + depth - 1, -1)
            gone = np.cumsum(edge)[:-1] > 0
            before = np.concatenate([[0], np.cumsum(gone)])
            starts = gone.copy()
            starts[1:] &= ~gone[:-1]
            inner = offsets[:-1][np.diff(offsets) > 0]
            starts[inner] = gone[inner]
            opened = np.concatenate([[0], np.cumsum(starts)])
            kept = raw[~gone]
            ends = offsets - before[offsets]
            body = pa.Array.from_buffers(pa.binary(), block.num_rows, [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(kept.tobytes())])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    body,
                    pa.array(np.diff(offsets)),
                    pa.array(np.diff(before[offsets]).astype(np.int64)),
                    pa.array(np.diff(opened[offsets]).astype(np.int64)),
                    *(block.column(c) for c in extra),
                ],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans", *extra],
            )

    joined = docs.join(spans, "key", "left").select("doc_id", "text", "spans", *extra)
    schema = ", ".join(["doc_id long, kept binary, n_bytes long, n_removed long, n_spans long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*extra).schema)] if extra else ["doc_id long, kept binary, n_bytes long, n_removed long, n_spans long"])
    return joined.mapInArrow(run, schema)


def whole_characters(kept: str):
    """The column of kept bytes as text, without the bytes of characters that a cut divided."""

    @F.pandas_udf("string")
    def decode(column: pd.Series) -> pd.Series:
        return column.map(lambda x: None if x is None else bytes(x).decode("utf-8", "ignore"))

    return decode(F.col(kept))


def op8_suffix_dedup(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
with h as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, p, substr(h, (2 * p + 1)::bigint, {2 * DEPTH}) as s from h, unnest(range(n - {DEPTH - 1})) as t(p) where n >= {DEPTH}),
d as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) as nth from w) where nth > 1),
e as (select doc_id, p, p - lag(p) over (partition by doc_id order by p) as gap from d),
g as (select doc_id, p, sum(case when gap <= {DEPTH} then 0 else 1 end) over (partition by doc_id order by p) as g from e),
s as (select doc_id, g, min(p) as a, max(p) + {DEPTH} as b, lead(min(p)) over (partition by doc_id order by g) as next from g group by doc_id, g),
k as (select s.doc_id, count(*) as n_spans, sum(b - a) as n_removed, string_agg(substr(h, (2 * b + 1)::bigint, (2 * (coalesce(next, n) - b))::bigint), '' order by a) as tail, substr(any_value(h), 1, (2 * min(a))::bigint) as head
  from s join h on h.doc_id = s.doc_id group by s.doc_id)
select h.doc_id, n as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(case when k.doc_id is null then h.h else head || tail end)) as kept_sha256
from h left join k on k.doc_id = h.doc_id"""
