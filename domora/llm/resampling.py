"""Importance resampling of documents towards a target by hashed words and word pairs.

A feature's bucket is the CRC of its bytes. Frequent words and pairs (the head, chosen from counts over all texts)
are broadcast: words with the state of their CRC, pairs with their bucket. A word of the tail has its CRC computed,
and a pair of the tail goes on from the state of its first word over the bytes of the rest. Bucket totals of the
corpus and of the target are exact sums of both; the head decides speed alone, never a result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.text import blocks, release, utf8
from domora.operators.ranks import with_rank
from domora.session import table

BUCKETS = 10_000
#: Words and pairs of the broadcast head, at most, and what a task names of each chunk of texts as candidates.
HEAD_WORDS = 1 << 15
HEAD_PAIRS = 1 << 17
CHUNK = 1 << 23
#: Bytes of text that are cut into words at once; a longer text is cut between words.
SLICE = 1 << 20
#: A-Z in lower case, bytes that no word has as spaces.
_WORDS = bytes(32 if b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_SEPARATOR = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")
_SLOTS = 1 << 19
_MIX = 0x9E3779B97F4A7C15


@dataclass
class Head:
    """Frequent words in order of their number, and frequent pairs of such numbers."""

    words: list[bytes] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)

    def __post_init__(self):
        self.number = {w: i for i, w in enumerate(self.words)}
        states = [zlib.crc32(w) for w in self.words]
        self.states = np.array(states, np.int64)
        self.keys, self.bucket = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int32)
        if self.pairs:
            a, b = np.array(self.pairs, np.int64).T
            key = a << 32 | b
            slot = self.slot(key)
            slot, one = np.unique(slot, return_index=True)  # of pairs in one slot the first stays, the others are tail
            self.keys[slot] = key[one]
            self.bucket[slot] = [zlib.crc32(b" " + self.words[y], states[x]) % BUCKETS for x, y in zip(a[one].tolist(), b[one].tolist(), strict=True)]

    @staticmethod
    def slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(_MIX)) >> np.uint64(64 - 19)).astype(np.int64)


def slices(text: bytes) -> Iterator[bytes]:
    """A text in slices of bounded size that end between words."""
    at = 0
    while len(text) - at > SLICE:
        found = _SEPARATOR.search(text, at + SLICE)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def chunks(texts: list[bytes], limit: int = SLICE) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(row of each word, words, whether each goes on from the word before it) of texts, in chunks of bounded size.

    The word before a chunk that a text goes on in stands first in it again, with a row of -1.
    """
    rows, words, size = [], [], 0
    for row, text in enumerate(texts):
        last = None
        for piece in slices(text) if len(text) > SLICE else (text,):
            own = piece.translate(_WORDS).split()
            if own:
                if last is not None:
                    rows.append((-1, 1))
                    words.append(last)
                rows.append((row, len(own)))
                words += own
                last = own[-1]
            size += len(piece)
            if size >= limit:
                yield _flat(rows, words)
                rows, words, size = [], [], 0
    if words:
        yield _flat(rows, words)


def _flat(rows: list[tuple[int, int]], words: list[bytes]) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    row = np.repeat(np.array([r for r, _ in rows], np.int64), [n for _, n in rows])
    # a word follows the one before in its row, or the one that was repeated before it
    return row, words, np.append(False, (row[1:] == row[:-1]) | (row[:-1] == -1)) & (row >= 0)


def features(head: Head, row: np.ndarray, words: list[bytes], follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every word and of every pair."""
    number = np.fromiter(map(head.number.get, words, repeat(-1)), np.int64, len(words))
    known = number >= 0
    state = np.zeros(len(words), np.int64)
    state[known] = head.states[number[known]]
    tail = np.flatnonzero(~known)
    state[tail] = np.fromiter(map(zlib.crc32, map(words.__getitem__, tail.tolist())), np.int64, len(tail))
    second = np.flatnonzero(follows)
    key = np.where(known[second] & known[second - 1], number[second - 1] << 32 | number[second], -2)
    slot = head.slot(key)
    bucket = head.bucket[slot].astype(np.int64)
    rest = np.flatnonzero(head.keys[slot] != key)
    at = second[rest]
    bucket[rest] = np.fromiter(map(zlib.crc32, [b" " + words[i] for i in at.tolist()], state[at - 1].tolist()), np.int64, len(at)) % BUCKETS
    own = row >= 0
    return np.concatenate([row[own], row[second]]), np.concatenate([state[own] % BUCKETS, bucket])


def _texts(block: pa.RecordBatch) -> list[bytes]:
    raw, offsets = utf8(block.column("text"))
    data = raw.tobytes()
    return [data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def frequent(texts: DataFrame) -> Head:
    """The head: of each chunk of texts the most frequent words and pairs are named, and the largest sums of these make it."""

    def run(batches):
        for block in blocks(batches, limit=CHUNK):
            for row, words, follows in chunks(_texts(block), CHUNK):
                number: dict[bytes, int] = {}
                at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                names = list(number)
                counts = np.bincount(at[row >= 0], minlength=len(names))
                top = np.argsort(-counts, kind="stable")[:HEAD_WORDS]
                top = top[counts[top] > 1]
                second = np.flatnonzero(follows)
                pairs, n = np.unique(at[second - 1] << 32 | at[second], return_counts=True)
                often = np.argsort(-n, kind="stable")[:HEAD_PAIRS]
                often = often[n[often] > 1]
                first = [names[i] for i in top.tolist()] + [names[i] for i in (pairs[often] >> 32).tolist()]
                then = [None] * len(top) + [names[i] for i in (pairs[often] & 0xFFFFFFFF).tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(first, pa.binary()), pa.array(then, pa.binary()), pa.array(np.append(counts[top], n[often]), pa.int64())], names=["word", "next", "n"])
        release()

    found = texts.select("text").mapInArrow(run, "word binary, next binary, n long").groupBy("word", "next").agg(F.sum("n").alias("n"))

    def top(rows: DataFrame, limit: int) -> list:
        return rows.orderBy(F.desc("n"), "word", "next").limit(limit).collect()  # the head has that many entries, at most

    words = [bytes(r["word"]) for r in top(found.where("next is null"), HEAD_WORDS)]
    number = {w: i for i, w in enumerate(words)}
    pairs = [(number[bytes(r["word"])], number[bytes(r["next"])]) for r in top(found.where("next is not null"), HEAD_PAIRS) if bytes(r["word"]) in number and bytes(r["next"]) in number]
    return Head(words, pairs)


def totals(texts: DataFrame, head: Head) -> np.ndarray:
    """Features of each bucket over all texts."""
    shared = texts.sparkSession.sparkContext.broadcast((head.words, head.pairs))  # HEAD_WORDS and HEAD_PAIRS entries, at most

    def run(batches):
        own, sums = Head(*shared.value), np.zeros(BUCKETS, np.int64)
        for block in blocks(batches):
            for part in chunks(_texts(block)):
                sums += np.bincount(features(own, *part)[1], minlength=BUCKETS)
        release()
        yield pa.RecordBatch.from_arrays([pa.array(range(BUCKETS), pa.int32()), pa.array(sums, pa.int64())], names=["bucket", "n"])

    out = np.zeros(BUCKETS, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # BUCKETS rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + BUCKETS) / ((s + 1)(T + BUCKETS)))) by bucket."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighted(docs: DataFrame, head: Head, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean of gains, 0 without features)."""
    shared = docs.sparkSession.sparkContext.broadcast((head.words, head.pairs, gain))

    def run(batches):
        words, pairs, gain = shared.value
        own = Head(words, pairs)
        for block in blocks(batches):
            n_words, n, total = (np.zeros(block.num_rows, np.int64) for _ in range(3))
            for row, tokens, follows in chunks(_texts(block)):
                at, bucket = features(own, row, tokens, follows)
                n_words += np.bincount(row[row >= 0], minlength=len(n))
                n += np.bincount(at, minlength=len(n))
                total += np.bincount(at, gain[bucket], len(n)).astype(np.int64)  # whole numbers below 2^53
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), *[pa.array(x, pa.int64()) for x in (n_words, n, weight)]], names=["doc_id", "n_words", "n_features", "weight"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank of every document; rank is null where it is not drawn.

    Of the N documents with least_words words or more, the floor(percent N / 100) with the highest scores are drawn,
    ties to the smaller doc_id: a Gumbel draw without replacement by weight. Null and empty texts have no words and a
    weight of 0; a null doc_id has no score and is never drawn; repeated rows count each, and are scored alike. Only
    doc_id and text are read; an empty corpus gives an empty table, an empty target a target of no words.
    """
    text = F.col("text").cast("string").alias("text")
    head = frequent(docs.select(text).unionByName(target.select(text)))
    gain = gains(totals(docs.select(text), head), totals(target.select(text), head))
    rows = weighted(docs, head, gain)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    placed = with_rank(rows.withColumn("score", F.col("weight") + noise).withColumn("drawable", (F.col("n_words") >= least_words) & F.col("score").isNotNull()), [F.desc("drawable"), F.desc("score"), F.asc("doc_id"), F.asc("n_words")], "place")
    n = placed.where("drawable").count()
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("drawable") & (F.col("place") <= percent * n // 100), F.col("place")).alias("rank"))


def op12_head_tail_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC by its bitwise rule, over distinct features only.
ORACLE = f"""
with tab as materialized (select list(c order by i) as crc from (select i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) as c from range(256) r(i))),
w as (select doc_id, side, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as words
  from (select doc_id, text, 0 as side from documents union all select item_id, text, 1 from benchmark)),
f as materialized (select doc_id, side, unnest(words || list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) as feature from w),
each as materialized (select doc_id, side, feature, count(*) as n from f group by all),
hexed as (select feature, lower(hex(encode(feature))) as h from (select distinct feature from each)),
hashed as materialized (select feature, xor(4294967295, list_reduce(list_transform(range(0, len(h), 2), lambda i: (instr('0123456789abcdef', h[i + 1]) - 1) * 16 + instr('0123456789abcdef', h[i + 2]) - 1),
  lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295)) % {BUCKETS} as bucket from hexed cross join tab),
sums as (select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from each join hashed using (feature) group by bucket),
whole as (select coalesce(sum(n) filter (side = 0), 0) as s, coalesce(sum(n) filter (side = 1), 0) as t from each),
gain as (select bucket, floor(1000 * ln((coalesce(sums.t, 0) + 1)::double * (whole.s + {BUCKETS})::double / ((coalesce(sums.s, 0) + 1)::double * (whole.t + {BUCKETS})::double)))::bigint as gain from sums cross join whole),
own as (select doc_id, sum(n) as n_features, floor(sum(n * gain)::double / sum(n))::bigint as weight from each join hashed using (feature) join gain using (bucket) where side = 0 group by doc_id),
scored as (select d.doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || d.doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score, len(words) >= 20 as drawable
  from w d left join own using (doc_id) where side = 0),
placed as (select *, row_number() over (partition by drawable order by score desc, doc_id) as place, (sum(drawable::int) over ())::bigint as n from scored)
select doc_id, n_features, weight, score, case when drawable and place <= 25 * n // 100 then place end as rank from placed"""
