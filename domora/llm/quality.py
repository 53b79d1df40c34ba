"""Repetition rules: characters inside duplicated n-grams and lines, by rolling hashes in numpy.

Every task turns blocks of whole texts into word hashes and slides n-grams of several lengths over them;
an n-gram's key also holds its row, so one sort finds the repeats inside each text. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.text import SEPARATOR, blocks, mix, prefix, ranges, row_sums, utf8, windows, words

#: n-gram length -> largest share of word characters inside repeats (the first of equals not counted).
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
LINE_LIMIT = 0.20
MIN_WORDS = 10
REPEAT_PERCENT = 20
SYMBOLS = "#*$%&|<>"


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(has an equal, has an equal before it) for each key."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def spread(marked: np.ndarray, places: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words covered by the marked n-word windows, which start at places."""
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, places[marked], 1)
    np.add.at(edge, places[marked] + n, -1)
    return np.cumsum(edge)[:-1] > 0


def measures(column: pa.Array) -> dict[str, np.ndarray]:
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    start, end, row = words(raw, offsets)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = lead[end] - lead[start]
    sums = prefix(raw)
    hashes = ranges(sums, start, end)
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    at = np.flatnonzero(symbol[raw])
    out = {
        "n_words": np.bincount(row, minlength=n).astype(np.int64),
        "word_chars": row_sums(chars, row, n),
        "n_symbols": np.bincount(np.searchsorted(offsets, at, "right") - 1, minlength=n).astype(np.int64) if len(at) else np.zeros(n, np.int64),
    }

    # lines: cut at \n and at the ends of texts; only those with a word count
    cuts = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([offsets[:-1], cuts + 1]))
    line_row = np.sort(np.concatenate([np.arange(n), np.searchsorted(offsets, cuts, "right") - 1]))
    stop = np.append(begin[1:], len(raw))
    stop = np.where(np.append(line_row[1:] == line_row[:-1], False), stop - 1, offsets[line_row + 1])
    inside = np.concatenate([[0], np.cumsum(~SEPARATOR[raw])])
    kept = inside[stop] > inside[begin]
    begin, stop, line_row = begin[kept], stop[kept], line_row[kept]
    _, later = repeated(mix(ranges(sums, begin, stop) ^ mix(line_row.astype(np.uint64))))
    word_chars = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_chars[np.searchsorted(start, stop)] - word_chars[np.searchsorted(start, begin)]
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n).astype(np.int64)
    out["dup_line_chars"] = row_sums(line_chars[later], line_row[later], n)

    # n-grams: a text without a repeated n-gram has no longer ones either
    live = np.ones(len(start), bool)
    out["n_repeat_words"] = np.zeros(n, np.int64)
    for k, size in enumerate(sorted(NGRAM_LIMITS)):
        name = f"dup_chars_{size}"
        out[name] = np.zeros(n, np.int64)
        own, own_row, own_chars = hashes[live], row[live], chars[live]
        places = np.flatnonzero(own_row[: max(0, len(own) - size + 1)] == own_row[size - 1 :]) if len(own) >= size else np.zeros(0, np.int64)
        if not len(places):
            live[:] = False
            continue
        any_, later = repeated(mix(windows(own, size)[places] ^ mix(own_row[places].astype(np.uint64) + np.uint64(1))))
        if k == 0:
            whole = spread(any_, places, size, len(own))
            out["n_repeat_words"] = np.bincount(own_row[whole], minlength=n).astype(np.int64)
        covered = spread(later, places, size, len(own))
        out[name] = row_sums(own_chars[covered], own_row[covered], n)
        live &= np.isin(row, np.unique(own_row[places[any_]])) if k else np.bincount(own_row[places[any_]], minlength=n)[row] > 0
    return out


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in blocks(batches):
        found = measures(block.column("text"))
        yield pa.RecordBatch.from_arrays([block.column("doc_id"), *(pa.array(v) for v in found.values())], names=["doc_id", *found])


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars", "n_repeat_words", *(f"dup_chars_{n}" for n in sorted(NGRAM_LIMITS))]


def repetition(docs: DataFrame) -> DataFrame:
    """One row per document: counts, shares and the verdict.

    A null or empty text has zero counts and fails the base rule; a null doc_id stays null; other columns
    of docs are not read, so clashing names do no harm; repeated rows are judged one by one;
    a very long text is held by one task; an empty table gives an empty one.
    """
    schema = ", ".join(["doc_id long", *(f"{x} long" for x in NAMES)])
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        lambda batches: (b.select(["doc_id", *NAMES]) for b in _measured(batches)), schema
    )
    total = F.greatest(F.col("word_chars"), F.lit(1))
    over = F.col("dup_line_chars") > total * LINE_LIMIT
    for n, most in NGRAM_LIMITS.items():
        over = over | (F.col(f"dup_chars_{n}") > total * most)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return found.withColumn("base_failed", failed).withColumn("kept", ~failed & ~over)


def op1_repetition(spark, sf_dir):
    from domora.session import table

    return repetition(table(spark, sf_dir, "documents"))


def oracle() -> str:
    """DuckDB SQL of the same figures, n-grams as strings."""
    grams = ", ".join(" || ' ' || ".join(["w", *(f"lead(w, {k}) over d" for k in range(1, n))]) + f" as g{n}" for n in sorted(NGRAM_LIMITS))
    marks = ", ".join(f"g{n} is not null and row_number() over (partition by doc_id, g{n} order by i) > 1 as later{n}" for n in sorted(NGRAM_LIMITS))
    covers = ", ".join(f"max(later{n}::int) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as in{n}" for n in sorted(NGRAM_LIMITS))
    chars = ", ".join(f"coalesce(sum(length(w)) filter (where in{n} = 1), 0)::bigint as dup_chars_{n}" for n in sorted(NGRAM_LIMITS))
    over = " or ".join([f"dup_line_chars > greatest(word_chars, 1) * {LINE_LIMIT}::double", *(f"dup_chars_{n} > greatest(word_chars, 1) * {m}::double" for n, m in NGRAM_LIMITS.items())])
    first = min(NGRAM_LIMITS)
    word = r"[^\x20\x09-\x0D]+"
    zero = ", ".join(f"coalesce({x}, 0)::bigint as {x}" for x in NAMES)
    return rf"""
with lists as (select doc_id, regexp_extract_all(text, '{word}') as ws from documents where text is not null),
w as (select doc_id, unnest(ws) as w, unnest(range(len(ws))) as i from lists),
g as (select doc_id, i, w, {grams} from w window d as (partition by doc_id order by i)),
m as (select *, {marks}, g{first} is not null and count(*) over (partition by doc_id, g{first}) > 1 as twice from g),
c as (select *, {covers}, max(twice::int) over (partition by doc_id order by i rows between {first - 1} preceding and current row) as inside from m),
by_doc as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars, sum(inside) as n_repeat_words, {chars} from c group by doc_id),
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i from documents where text is not null),
seen as (select *, row_number() over (partition by doc_id, line order by i) as nth from lines where regexp_matches(line, '{word}')),
by_line as (select doc_id, count(*) as n_dup_lines, sum(length(array_to_string(regexp_extract_all(line, '{word}'), ''))) as dup_line_chars from seen where nth > 1 group by doc_id),
t as (select d.doc_id, length(regexp_replace(coalesce(d.text, ''), '[^#*$%&|<>]', '', 'g')) as n_symbols, b.* exclude (doc_id), l.* exclude (doc_id)
  from documents d left join by_doc b on b.doc_id = d.doc_id left join by_line l on l.doc_id = d.doc_id),
z as (select doc_id, {zero} from t),
f as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > {REPEAT_PERCENT} * n_words as base_failed from z)
select *, not base_failed and not ({over}) as kept from f"""
