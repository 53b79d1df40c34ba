"""Toxicity by weak supervision: voters, a generative label model with correlations, a linear classifier.

Voters are of two kinds. A lexicon voter is a set of entries (whole words, word beginnings, pairs of words) that
stand in the same labelled texts and stand out in toxic ones. Pattern voters look at the text itself: words in
disguise (`id1ot`, `i.d.i.o.t`, `idiooot`) or spaced out, shouting, runs of marks; one votes for clean texts.
A voter that does not fire abstains. The label model treats the true label as hidden: EM starts from the count of
votes and estimates each voter's rates under both labels, and a tree of correlations between voters within the
labels, so that voters which repeat one another count once. Logistic regression then learns from the posterior
labels. Gold labels choose the voters and give the share of toxic texts and the final cut.

Everything is fitted on a sample of labelled rows of bounded size; scoring is a scan over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.language import held_out
from domora.llm.text import BLOCK_BYTES, LOWER, SEPARATOR, blocks, mix, prefix, ranges, signed, utf8, words
from domora.session import materialise, table

#: Labelled rows that the models are fitted on: about so many at most, chosen by a hash of doc_id.
SAMPLE = 24_000
#: Lexicon voters, and entries that they hold together, at most; the entries with the most evidence come first.
VOTERS = 384
ENTRIES = 4096
BEGINNINGS = (3, 4, 5, 6, 7, 8, 10)
MIN_TOXIC_TEXTS = 3
MIN_LOG_ODDS = 1.5
#: Least log likelihood ratio of an entry against the base rate: below, it may stand out by chance.
MIN_EVIDENCE = 10.0
#: Least number of letters that are spaced out.
SPACED = 4
#: Bytes of a long text that are looked at together.
PART_BYTES = BLOCK_BYTES
#: Sampled rows that the fits take at once.
ROWS = 2048
#: Files that hold the sample.
FILES = 32


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_TRIM = _bytes(b".,!?;:\"'()")
_LETTER = _bytes(bytes(range(65, 91)) + bytes(range(97, 123)))
_DROP = _bytes(b"*._-~'`^|")
_FOLD = LOWER.copy()
_FOLD[list(b"013457@$!")] = list(b"oieastasi")
#: What is counted for each text.
STATS = ("words", "letters", "capitals", "marks", "exclaims", "disguised", "spaced")
#: Pattern voters and the label that each of them speaks for.
PATTERNS = {"disguised": 1, "spaced": 1, "shouts": 1, "marks": 1, "calm": -1}
DENSITIES = 4


def _forms(sums: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the given words and of their beginnings."""
    out, rows = [mix(ranges(sums, start, end))], [row]
    for n in BEGINNINGS:
        ok = end - start >= n
        out.append(mix(ranges(sums, start[ok], start[ok] + n) + np.uint64(n)))
        rows.append(row[ok])
    return np.concatenate(out), np.concatenate(rows)


def _trimmed(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Ends of the words without up to three final marks."""
    for _ in range(3):
        end = end - ((end > start) & _TRIM[raw[np.maximum(end - 1, 0)]] if len(end) else 0)
    return end


def entries(raw: np.ndarray, offsets: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of the words that begin before byte `own`, of their beginnings and of pairs with the next word."""
    start, end, row = words(raw, offsets)
    end = _trimmed(raw, start, end)
    sums = prefix(LOWER[raw])
    whole = ranges(sums, start, end)
    mine = int(np.searchsorted(start, own))
    hashes, rows = _forms(sums, start[:mine], end[:mine], row[:mine])
    two = np.flatnonzero(row[:-1] == row[1:])
    two = two[two < mine]
    return np.concatenate([hashes, mix(mix(whole[two] * np.uint64(3)) + whole[two + 1])]), np.concatenate([rows, row[two]])


def disguises(raw: np.ndarray, offsets: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, whether spaced out) of words that are written in disguise, as they would read plainly.

    Digits and signs stand for letters, marks inside a word go, three or more equal letters are one; SPACED or more
    words of one ASCII letter in a row are one word.
    """
    start, end, row = words(raw, offsets)
    mine = int(np.searchsorted(start, own))
    start, end, row = start[:mine], _trimmed(raw, start, end)[:mine], row[:mine]
    single = np.flatnonzero((end - start == 1) & _LETTER[raw[np.minimum(start, len(raw) - 1)]])
    new = np.ones(len(single), bool)
    new[1:] = (np.diff(single) != 1) | (row[single[1:]] != row[single[:-1]])
    run = np.cumsum(new) - 1
    long = np.bincount(run, minlength=1)[run] >= SPACED if len(run) else np.zeros(0, bool)
    single, run = single[long], run[long]

    odd = (_FOLD[raw] != LOWER[raw]) | _DROP[raw]
    odd[2:] |= (LOWER[raw[2:]] == LOWER[raw[1:-1]]) & (LOWER[raw[1:-1]] == LOWER[raw[:-2]])
    count = lambda mask: np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    odds, letters = count(odd), count(_LETTER[raw] | (raw > 127))
    word = np.flatnonzero((odds[end] > odds[start]) & (letters[end] - letters[start] >= 2))
    size = (end - start)[word]
    at = np.arange(size.sum()) + np.repeat(start[word] - np.cumsum(size) + size, size)
    name = np.repeat(np.arange(len(word)), size)
    at, name = at[~_DROP[raw[at]]], name[~_DROP[raw[at]]]
    text = _FOLD[raw[at]]
    as_before = np.zeros(len(text), bool)
    as_before[1:] = (text[1:] == text[:-1]) & (name[1:] == name[:-1])
    first = np.flatnonzero(~as_before)
    many = np.repeat(np.diff(np.append(first, len(text))) > 2, np.diff(np.append(first, len(text))))
    keep = ~(as_before & many)
    text = np.concatenate([text[keep], LOWER[raw[start[single]]]])
    name = np.concatenate([name[keep], len(word) + run])
    if not len(text):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    a = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    b = np.append(a[1:], len(text))
    of = np.concatenate([row[word], np.zeros(0, np.int64)])
    first_of_run = np.full(int(run.max()) + 1 if len(run) else 0, -1, np.int64)
    first_of_run[run[::-1]] = row[single[::-1]]
    of = np.concatenate([of, first_of_run])[name[a]]
    hashes, which = _forms(prefix(text), a, b, np.arange(len(a)))
    return hashes, of[which], (name[a] >= len(word))[which]


def pieces(raw: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, own bytes) of a block; a long text, which is a block of its own, in parts.

    A part ends at white space and reads on for one word after it, for the pair across the cut. Letters that are
    spaced out across a cut read as two runs.
    """
    if len(raw) <= PART_BYTES or len(offsets) != 2:
        yield raw, offsets, len(raw)
        return
    at = 0

    def past(i: int, separator: bool) -> int:  # first byte from i on that is (no) white space
        while i < len(raw):
            seen = np.flatnonzero(SEPARATOR[raw[i : i + 4096]] == separator)
            if len(seen):
                return i + int(seen[0])
            i += 4096
        return len(raw)

    while at < len(raw):
        cut = past(min(at + PART_BYTES, len(raw)), True)
        stop = past(past(cut, False), True)
        yield raw[at:stop], np.array([0, stop - at]), cut - at
        at = cut


def hits(column: pa.Array, lexicon: np.ndarray, voter: np.ndarray, n_voters: int) -> tuple[np.ndarray, np.ndarray]:
    """(times, up to 255, that each voter's entries stand in each text; STATS of each text); lexicon: sorted hashes."""
    raw, offsets = utf8(column)
    n = len(offsets) - 1
    found, stats = np.zeros((n, n_voters), np.int64), np.zeros((n, len(STATS)), np.int64)
    maybe = np.zeros(1 << 16, bool)
    maybe[(lexicon >> np.uint64(48)).astype(np.int64)] = True

    def look(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        live = np.flatnonzero(maybe[(hashes >> np.uint64(48)).astype(np.int64)])
        at = np.minimum(np.searchsorted(lexicon, hashes[live]), max(len(lexicon) - 1, 0))
        same = lexicon[at] == hashes[live] if len(live) else np.zeros(0, bool)
        return live[same], voter[at[same]]

    for part, ends, own in pieces(raw, offsets) if len(raw) else ():
        hashes, rows = entries(part, ends, own)
        at, who = look(hashes)
        np.add.at(found, (rows[at], who), 1)
        hashes, rows, apart = disguises(part, ends, own)
        at, who = look(hashes)
        np.add.at(found, (rows[at], who), 1)
        start, _, row = words(part, ends)
        mine, ends = part[:own], np.minimum(ends, own)
        twice = np.zeros(own, bool)
        mark = (mine == 33) | (mine == 63)
        twice[:-1] = mark[:-1] & mark[1:]
        twice[np.maximum(ends[1:] - 1, 0)] = False
        capital = (mine >= 65) & (mine <= 90)
        masks = [_LETTER[mine], capital, twice, mine == 33]
        sums = [np.concatenate([[0], np.cumsum(m, dtype=np.int64)]) for m in masks]
        stats[:, 0] += np.bincount(row[start < own], minlength=n)
        stats[:, 1:5] += np.stack([s[ends[1:]] - s[ends[:-1]] for s in sums], axis=1)
        stats[:, 5] += np.bincount(rows[at[~apart[at]]], minlength=n)
        stats[:, 6] += np.bincount(rows[at[apart[at]]], minlength=n)
    return np.minimum(found, 255), stats


def votes(found: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """0 (abstains) or 1 for every lexicon voter and then for each of PATTERNS.

    shouts: 3 of 10 letters are capitals, of 20 at least; calm: 20 words or more, under 1 of 10 letters in capitals,
    no exclamation mark and no run of marks.
    """
    total, letters, capitals, marks, exclaims, disguised, spaced = stats.T
    calm = (total >= 20) & (10 * capitals < letters) & (exclaims == 0) & (marks == 0)
    patterns = [disguised > 0, spaced > 0, (letters >= 20) & (10 * capitals >= 3 * letters), marks > 0, calm]
    return np.concatenate([found > 0, np.stack(patterns, axis=1)], axis=1).astype(np.float32)


def features(found: np.ndarray, stats: np.ndarray) -> np.ndarray:
    """The votes, and how dense the hits are: any, three voters, a hit in 200 words, a hit in 50."""
    rate = found.sum(1, dtype=np.int64) / np.maximum(stats[:, 0], 1)
    kinds = (found > 0).sum(1)
    dense = np.stack([kinds > 0, kinds > 2, rate > 1 / 200, rate > 1 / 50], axis=1).astype(np.float32)
    return np.concatenate([votes(found, stats), dense], axis=1)


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: np.ndarray
    voter: np.ndarray
    n_voters: int
    weights: np.ndarray
    bias: float


@dataclass(frozen=True)
class LabelModel:
    """rates[y, j]: voter j fires under label y; parent[j]: the voter that j depends on, or -1; given[y, b, j]: j fires under y where its parent does (b = 1) or not."""

    prior: float
    rates: np.ndarray
    parent: np.ndarray
    given: np.ndarray


def correlations(rates: np.ndarray, both: np.ndarray, share: np.ndarray, n: int) -> np.ndarray:
    """Parent of each voter, or -1, in the forest of greatest mutual information within the labels.

    both[y]: how often two voters fire together under y. A correlation has to pay for its two parameters (BIC).
    """
    gain = np.zeros(both[0].shape)
    for y in (0, 1):
        p, r = both[y], rates[y]
        for cell, a, b in ((p, r, r), (r[:, None] - p, r, 1 - r), (r[None] - p, 1 - r, r), (1 - r[:, None] - r[None] + p, 1 - r, 1 - r)):
            cell = np.clip(cell, 1e-9, 1)
            gain += share[y] * cell * np.log(cell / np.maximum(np.outer(a, b), 1e-9))
    m = len(gain)
    parent = np.full(m, -1)
    best, via, inside = np.full(m, -np.inf), np.full(m, -1), np.zeros(m, bool)
    for _ in range(m):
        j = int(np.argmax(np.where(inside, -np.inf, np.where(np.isfinite(best), best, -1e300))))
        inside[j] = True
        if via[j] >= 0 and n * best[j] > np.log(max(n, 2)):
            parent[j] = via[j]
        better = ~inside & (gain[j] > best)
        best[better], via[better] = gain[j][better], j
    return parent


def log_odds(v: np.ndarray, model: LabelModel) -> np.ndarray:
    """Log odds of label 1 of each row of votes."""
    rest, off = np.log(model.given), np.log1p(-model.given)
    on, off = rest[1] - rest[0], off[1] - off[0]  # by parent's vote, voter
    out = np.full(len(v), np.log(model.prior / (1 - model.prior)))
    for a in range(0, len(v), ROWS):
        part = v[a : a + ROWS].astype(float)
        above = np.where(model.parent >= 0, part[:, np.maximum(model.parent, 0)], 0)
        out[a : a + ROWS] += (part * np.where(above > 0, on[1], on[0]) + (1 - part) * np.where(above > 0, off[1], off[0])).sum(1)
    return out


def label_model(v: np.ndarray, start: np.ndarray, prior: float, rounds: int = 12) -> tuple[np.ndarray, LabelModel]:
    """(posterior of label 1 for each row of 0/1 votes, the model) by EM from starting posteriors; the prior is held."""
    q, n, m = start.astype(float), *v.shape
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    mean = np.clip(v.mean(0, dtype=float), 0.5 / (n + 1), 1 - 0.5 / (n + 1))
    for _ in range(rounds):
        together, once = np.zeros((2, m, m)), np.zeros((2, m))
        for a in range(0, n, ROWS):
            part = v[a : a + ROWS].astype(float)
            for y, w in ((1, q[a : a + ROWS]), (0, 1 - q[a : a + ROWS])):
                together[y] += (part.T * w) @ part
                once[y] += w @ part
        size = np.array([n - q.sum(), q.sum()])
        rates = (once + mean) / (size + 1)[:, None]
        both = (together + mean[:, None] * mean) / (size + 1)[:, None, None]
        parent = correlations(rates, both, size / n, n)
        above = np.maximum(parent, 0)
        given = np.zeros((2, 2, m))
        for y in (0, 1):
            joint, up = together[y][np.arange(m), above], once[y][above]
            given[y, 1] = np.where(parent >= 0, (joint + rates[y]) / (up + 1), rates[y])
            given[y, 0] = np.where(parent >= 0, (once[y] - joint + rates[y]) / (size[y] - up + 1), rates[y])
        model = LabelModel(prior, rates, parent, np.clip(given, 1e-6, 1 - 1e-6))
        q = 1 / (1 + np.exp(-np.clip(log_odds(v, model), -30, 30)))
    return q, model


def vote_start(v: np.ndarray, lexicon: int, prior: float) -> np.ndarray:
    """Starting posteriors: 0.9 for the share `prior` of the rows with the most votes for label 1 over those against, else 0.1."""
    side = np.concatenate([np.ones(lexicon), list(PATTERNS.values())])
    count = v @ side
    return np.where((count > np.quantile(count, 1 - prior)) & (count > 0), 0.9, 0.1)


def logistic(x: np.ndarray, q: np.ndarray, l2: float = 1.0, rounds: int = 25, constant: bool = True) -> tuple[np.ndarray, float]:
    """(weights, bias) of ridge logistic regression on probabilities q by Newton steps; without constant the bias stays 0."""
    w = np.zeros(x.shape[1] + 1)
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        curve, slope = np.diag(ridge), -ridge * w
        for a in range(0, len(x), ROWS):
            part = np.column_stack([x[a : a + ROWS], np.full(len(x[a : a + ROWS]), float(constant))]).astype(float)
            p = 1 / (1 + np.exp(-np.clip(part @ w, -30, 30)))
            curve += (part.T * np.maximum(p * (1 - p), 1e-6)) @ part
            slope += part.T @ (q[a : a + ROWS] - p)
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn from the labelled rows of docs (doc_id, text) and labels (doc_id, toxic).

    Null labels, ids and texts are left out; of several labels of a document, or of equal texts, the larger counts,
    and equal texts count once. Without rows, or without a toxic one, every text is scored far below 0.5. Ties
    between entries go to the smaller hash. Other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    gold = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    count = gold.count()
    if count > SAMPLE:
        gold = gold.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(SAMPLE / count * (1 << 20)))
    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = texts.join(F.broadcast(gold), "doc_id").select("toxic", "text")  # about SAMPLE ids and labels at most
    # equal texts are united before they are dealt; a sample of bounded size, read three times below
    rows = materialise(rows.groupBy("text").agg(F.max("toxic").alias("toxic")).withColumn("mark", F.xxhash64("text")).repartition(FILES, "mark"))

    def counted(batches):
        for block in blocks(batches):
            toxic, mark = (block.column(c).to_numpy(zero_copy_only=False) for c in ("toxic", "mark"))
            for raw, offsets, own in pieces(*utf8(block.column("text"))):
                hashes, row = entries(raw, offsets, own)
                order = np.lexsort((row, hashes))
                hashes, row = hashes[order], row[order]
                new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])]) if len(row) else np.zeros(0, bool)
                yield pa.RecordBatch.from_arrays([pa.array(signed(hashes[new])), pa.array(toxic[row[new]], pa.int32()), pa.array(mark[row[new]], pa.int64())], names=["entry", "toxic", "mark"])

    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1):
        return ToxicityModel(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0, np.zeros(len(PATTERNS) + DENSITIES), -6.0)
    # parts of a long text can name an entry twice; the long text's mark tells
    seen = rows.where(F.octet_length("text") > PART_BYTES).mapInArrow(counted, "entry long, toxic int, mark long").distinct()
    seen = seen.unionByName(rows.where(F.octet_length("text") <= PART_BYTES).mapInArrow(counted, "entry long, toxic int, mark long"))
    tally = seen.groupBy("entry").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"), F.bit_xor("mark").alias("texts"))
    odds = F.log((F.col("yes") + 0.5) / (n[1] + 1)) - F.log((F.col("no") + 0.5) / (n.get(0, 0) + 1))
    rate, share = n[1] / (n[1] + n.get(0, 0)), F.col("yes") / (F.col("yes") + F.col("no"))
    evidence = F.col("yes") * F.log(share / rate) + F.when(F.col("no") > 0, F.col("no") * F.log((1 - share) / max(1 - rate, 1e-9))).otherwise(0.0)
    best = tally.where(F.col("yes") >= MIN_TOXIC_TEXTS).withColumn("odds", odds).where((F.col("odds") >= MIN_LOG_ODDS) & (evidence >= MIN_EVIDENCE))
    chosen = best.orderBy(F.desc(F.col("yes") * F.col("odds")), "texts", "entry").limit(ENTRIES).collect()
    numbers: dict[tuple, int] = {}  # entries of the same texts are one voter
    of = [numbers.setdefault((r["yes"], r["no"], r["texts"]), len(numbers)) for r in chosen]
    held = sorted((r["entry"] % (1 << 64), v) for r, v in zip(chosen, of, strict=True) if v < VOTERS)
    lexicon, voter, n_voters = np.array([e for e, _ in held], np.uint64), np.array([v for _, v in held], np.int64), min(len(numbers), VOTERS)
    shared = spark.sparkContext.broadcast((lexicon, voter, n_voters))

    def voted(batches):
        for block in blocks(batches):
            found, stats = hits(block.column("text"), *shared.value)
            yield pa.RecordBatch.from_arrays(
                [block.column("toxic"), block.column("mark"), pa.array([s.tobytes() for s in stats], pa.binary()), pa.array([f.tobytes() for f in found.astype(np.uint8)], pa.binary())],
                names=["toxic", "mark", "stats", "found"],
            )

    got = rows.mapInArrow(voted, "toxic int, mark long, stats binary, found binary").toPandas()  # SAMPLE rows of VOTERS bytes
    got = got.sort_values(["mark", "toxic"])  # the same sums wherever the rows lay
    found = np.frombuffer(b"".join(got["found"]), np.uint8).reshape(len(got), n_voters)
    stats = np.frombuffer(b"".join(got["stats"]), np.int64).reshape(len(got), len(STATS))
    gold_label = got["toxic"].to_numpy() > 0
    del got
    v = votes(found, stats)
    q, _ = label_model(v, vote_start(v, n_voters, gold_label.mean()), gold_label.mean())
    x = features(found, stats)
    weights, bias = logistic(x, q)
    # the share of positives follows the labels: shift the bias to the cut with the fewest errors
    z = x @ weights + bias
    cuts = np.unique(np.quantile(z, np.linspace(0, 1, 400)))
    cuts = np.concatenate([[0.0], (cuts[1:] + cuts[:-1]) / 2])
    errors = [((z >= c) != gold_label).mean() + 1e-6 * abs(c) for c in cuts]
    return ToxicityModel(lexicon, voter, n_voters, weights, bias - float(cuts[int(np.argmin(errors))]))


def _logits(block: pa.RecordBatch, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    """(log odds of each text, number of lexicon voters that fire)."""
    found, stats = hits(block.column("text"), model.lexicon, model.voter, model.n_voters)
    return features(found, stats) @ model.weights + model.bias, (found > 0).sum(1).astype(np.int64)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score, predicted, n_votes (lexicon voters that fire) for every row.

    Null and empty texts are scored as texts without votes; repeated rows and null ids stay, equal texts get equal
    scores, an empty table gives none. A text above PART_BYTES is read in parts. Only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = shared.value
        for block in blocks(batches):
            z, n = _logits(block, held)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(n)], names=["doc_id", "score", "predicted", "n_votes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, n_votes long")


def keep_clean(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, whole and with all their columns, that are scored below 0.5; see score for odd rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        held = shared.value
        for block in blocks(batches):
            yield block.filter(pa.array(_logits(block, held)[0] < 0))

    return docs.mapInArrow(run, docs.schema)


def op9_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(~held_out(5, 0)))
    return score(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "n_votes")
