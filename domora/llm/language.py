"""Language mixtures: expectation-maximisation over n-gram likelihoods, the set chosen by penalised likelihood.

Training counts byte n-grams of each language over every training text in the tasks; Spark adds them up
to one table of fixed size (languages x buckets). Scoring is a scan: each word has a likelihood under each
language, EM estimates a text's proportions, languages leave the set while that raises the penalised
likelihood, and the prediction is the language with the largest share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.text import LOWER, SEPARATOR, blocks, utf8, words
from domora.session import table

BUCKETS = 1 << 15
#: Languages that may be learned; bounds the table that tasks get to 32 MB. More raise an error, none is left out.
MAX_LANGUAGES = 256
ROUNDS = 12
UNDEFINED = "und"
_CHUNK = 1024


def grams(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bucket of the byte trigram that ends at each byte; texts begin and end with a space."""
    low = np.where(SEPARATOR[raw], np.uint8(32), LOWER[raw])
    one, two = np.full(len(low), 32, np.uint8), np.full(len(low), 32, np.uint8)
    one[1:], two[2:] = low[:-1], low[:-2]
    begin = offsets[:-1][offsets[1:] > offsets[:-1]]
    one[begin] = two[begin] = 32
    second = begin + 1
    two[second[second < len(low)]] = 32
    key = two.astype(np.uint32)
    for byte in (one, low):
        key <<= np.uint32(8)
        key |= byte
    key *= np.uint32(2654435761)
    key >>= np.uint32(32 - 15)
    return key.astype(np.uint16)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}
    for block in blocks(batches):
        raw, offsets = utf8(block.column("text"))
        if not len(raw):
            continue
        found = grams(raw, offsets)
        langs = block.column("lang").to_pylist()
        codes = {x: i for i, x in enumerate(dict.fromkeys(langs))}
        row = np.repeat(np.array([codes[x] for x in langs], np.int64), np.diff(offsets))
        tally = np.bincount(row * BUCKETS + found, minlength=len(codes) * BUCKETS).reshape(len(codes), BUCKETS)
        for lang, i in codes.items():
            held[lang] = held.get(lang, 0) + tally[i]
    for lang, tally in held.items():
        for k in range(0, BUCKETS, _CHUNK):
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([k // _CHUNK], pa.int32()), pa.array([tally[k : k + _CHUNK].tolist()], pa.list_(pa.int64()))], names=["lang", "part", "counts"]
            )


@dataclass(frozen=True)
class LanguageModel:
    langs: tuple[str, ...]
    #: log likelihood of each bucket, buckets x languages
    table: np.ndarray


def fit(docs: DataFrame) -> LanguageModel:
    """Learn from the texts and languages of docs; rows where either is null count nothing, repeated rows count each.

    An empty table gives a model without languages; more languages than MAX_LANGUAGES raise ValueError.
    """
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    parts = rows.mapInArrow(_counted, "lang string, part int, counts array<long>")
    # element-wise sums without exploding: one aggregate column for each place of a chunk's halves would be wide, so explode
    sums = (
        parts.select("lang", "part", F.posexplode("counts").alias("at", "n"))
        .where("n > 0")
        .groupBy("lang", (F.col("part") * _CHUNK + F.col("at")).alias("bucket"))
        .agg(F.sum("n").alias("n"))
    )
    totals = sums.groupBy("lang").agg(F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("all"))
    top = totals.select("lang", F.col("all.bucket").alias("buckets"), F.col("all.n").alias("counts")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(top) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    top.sort(key=lambda r: r["lang"])
    out = np.zeros((BUCKETS, max(1, len(top))))
    for j, r in enumerate(top):
        out[np.array(r["buckets"], np.int64), j] = r["counts"]
    out = np.log((out + 0.05) / (out.sum(axis=0) + 0.05 * BUCKETS))
    return LanguageModel(tuple(r["lang"] for r in top), out.astype(np.float32))


def _letters(column: pa.Array, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    n = len(offsets) - 1
    found = np.diff(np.concatenate([[0], np.cumsum(ascii_letter[raw])])[offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[i] = any(c.isalpha() for c in bytes(raw[offsets[i] : offsets[i + 1]]).decode("utf-8", "replace"))
    assert len(found) == n
    return found


def _em(like: np.ndarray, row: np.ndarray, alive: np.ndarray, n: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """(shares, log likelihood) of n texts; like: scaled likelihoods of their words; alive: the language set of each."""
    share = alive / np.maximum(alive.sum(axis=1, keepdims=True), 1)
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, np.int64)
    who = row[begin]
    for _ in range(rounds):
        part = like * share[row]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-30)
        got = np.zeros((n, like.shape[1]))
        if len(begin):
            got[who] = np.add.reduceat(part, begin, axis=0)
        share = got / np.maximum(got.sum(axis=1, keepdims=True), 1e-30)
    total = np.zeros(n)
    if len(begin):
        total[who] = np.add.reduceat(np.log(np.maximum((like * share[row]).sum(axis=1), 1e-30)), begin)
    return share, total


def mixtures(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shares of each language, has a letter) for every text."""
    raw, offsets = utf8(column)
    n, k = len(offsets) - 1, len(model.langs)
    letters = _letters(column, raw, offsets)
    start, end, row = words(raw, offsets)
    if not len(start) or not k:
        return np.full((n, max(1, k)), 1 / max(1, k)), letters
    found, stop = grams(raw, offsets), np.minimum(end + 1, offsets[row + 1])
    like, sums = np.empty((len(start), k)), np.zeros(len(raw) + 1)
    for j in range(k):  # one language at a time: memory beside the words does not grow with languages
        np.cumsum(np.ascontiguousarray(model.table[:, j])[found], dtype=np.float64, out=sums[1:])
        like[:, j] = sums[stop] - sums[start]  # a word's n-grams end at its bytes and at the byte after it
    like = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -25)).astype(np.float32)
    alive = np.ones((n, k))
    share, total = _em(like, row, alive, n, ROUNDS)
    size = np.bincount(row, minlength=n)
    penalty = 0.5 * np.log(np.maximum(size, 2)) + 1
    todo = np.flatnonzero(size > 0)
    for _ in range(k - 1):  # backward elimination: drop the smallest share while the penalised likelihood gains
        todo = todo[alive[todo].sum(axis=1) > 1]
        if not len(todo):
            break
        place = np.full(n, -1)
        place[todo] = np.arange(len(todo))
        own = place[row] >= 0
        fewer = alive[todo].copy()
        fewer[np.arange(len(todo)), np.where(fewer > 0, share[todo], np.inf).argmin(axis=1)] = 0
        less, lower = _em(like[own], place[row[own]], fewer, len(todo), 4)
        gain = lower + penalty[todo] >= total[todo]
        alive[todo[gain]], share[todo[gain]], total[todo[gain]] = fewer[gain], less[gain], lower[gain]
        todo = todo[gain]
    return share, letters


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score (the share of that language) and the shares of all languages of the set.

    Null texts and texts without a letter are `und` with score 0; so is every text if nothing was learned.
    Of equal shares the first language by name is predicted; repeated rows are judged each; an empty table gives
    none. Only doc_id and text are read, whatever other columns are called. A very long text is held by one task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages floats, at most 32 MB

    def run(batches):
        held = shared.value
        for block in blocks(batches):
            share, letters = mixtures(held, block.column("text"))
            best = share.argmax(axis=1)
            known = letters & bool(held.langs)
            names = [held.langs[b] if ok else UNDEFINED for b, ok in zip(best, known, strict=True)]
            score = np.where(known, np.clip(share[np.arange(len(best)), best], 0, 1), 0.0)
            mix = [[{"lang": held.langs[j], "share": float(s[j])} for j in np.flatnonzero(s > 1e-6)] if ok else [] for s, ok in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                names=["doc_id", "lang_pred", "score", "mixture"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


#: Least share of the predicted language that a filter keeps.
MIN_SHARE = 0.5


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = MIN_SHARE) -> DataFrame:
    """The rows of docs, whole, whose language is known and has at least that share; undefined texts go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = shared.value
        for block in blocks(batches):
            share, letters = mixtures(held, block.column("text"))
            yield block.filter(pa.array(letters & bool(held.langs) & (share.max(axis=1) >= least)))

    return docs.mapInArrow(run, docs.schema)


def held_out(mod: int, rest: int):
    """crc32 of the doc_id as text, modulo mod, is rest; false for a null doc_id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % mod == rest, F.lit(False))


def op2_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(4, 2)))
    return identify(docs, model).withColumn("held_out", held_out(4, 2)).select("doc_id", "held_out", "lang_pred", "score", "mixture")
