"""Piece rounds, head-tail resampling and token spans against the libraries and brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece

from domora.llm import alignment, pieces, resampling
from domora.llm.bpe import public_path

SF = "/root/testdata/sf0.001"
PIECES, BYTES = public_path("piece_bpe_32k.model"), public_path("byte_bpe_50k.json")
BITS = [
    "ab", "abc ", "the in er on ", " ", "\n", "▁", "  ", "é", "日本語の", "\U0001f600", " x", "aaaa", "1234", "<s>", "<0x41>", "\x00", "\t", "ing", "'s", "<|endoftext|>", "qu",
    "ſ", "\x1c", "　", "\xa0", " word", " and", " of", "\r\n", "́", "            ",
]
ODD = [(None, "null id and some words"), (5, None), (6, ""), (7, " "), (8, "  "), (9, "a "), (10, "a\n "), (7, "x" * 5000), (7, "x" * 5000), (11, "word " * 3000), (12, " " * 700 + "end"), (13, "▁")]


def made(n, seed=5, bits=BITS):
    rng = random.Random(seed)
    return [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(n)]


def framed(spark, rows):
    return spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, row int, ids string")


def key(row):
    return tuple(-1 if v is None else v for v in row)


# -- pieces ------------------------------------------------------------------------------------


def test_pieces_as_the_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    rows = made(3000) + ODD + [(r["doc_id"], r["text"]) for r in docs]
    ids = pieces.encoded(framed(spark, rows), PIECES)
    want = sorted(key((d, bytes(np.array([*lib.encode(t or ""), lib.eos_id()], "<u4")))) for d, t in rows)
    assert sorted(key((r["doc_id"], bytes(r["ids"]))) for r in ids.collect()) == want
    back = sorted(key((d, lib.decode([*lib.encode(t or ""), lib.eos_id()]))) for d, t in rows)
    assert sorted(map(key, pieces.decoded(ids, PIECES).collect())) == back
    assert pieces.encoded(framed(spark, rows).limit(0), PIECES).count() == 0


def test_pieces_of_long_words():
    own, rng = pieces.PieceEncoder(PIECES), random.Random(2)
    lib = own.table.library
    for letters, n in (("abcdefghijklmnopqrstuvwxyz", 30000), ("abe", 20000), ("x", 9001), (["ab"], 5000), ("0123456789abcdef", 9000), ("日本語中国人民大", 5000), (["the", "in", "er", "tion"], 8000), (" ", 9999), ([" ", " ", "a", "▁"], 3000)):
        text = "".join(rng.choice(letters) for _ in range(n))
        want = lib.encode(text)
        assert np.frombuffer(own.batch([b" " + text.encode()])[0], "<u4").tolist() == want
        assert b"".join(own.batch([p])[0] for p in own.parts(text.encode(), 1000)) == np.array(want, "<u4").tobytes()


def test_pieces_of_texts_in_parts(spark, monkeypatch):
    lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(pieces, "SPLIT_BYTES", 400)
    rows = [(1, "word é▁\n" * 500), (1, "word é▁\n" * 500), (2, "x" * 3000), (3, "short"), (4, "日本語" * 400), (None, "ab " * 300), (5, "a" + " " * 900 + "b")]
    got = sorted(key((r["doc_id"], bytes(r["ids"]))) for r in pieces.encoded(framed(spark, rows), PIECES).collect())
    assert got == sorted(key((d, np.array([*lib.encode(t), 2], "<u4").tobytes())) for d, t in rows)


def test_decoding_any_ids():
    own = pieces.PieceEncoder(PIECES)
    lib, rng = own.table.library, random.Random(4)
    for _ in range(500):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 260), 28705, 259]) for _ in range(rng.randint(1, 12))]
        assert own.decode(np.array(ids, np.uint32)).decode() == lib.decode(ids)


# -- resampling --------------------------------------------------------------------------------


def brute_resample(docs, target, percent=25, least=20):
    def feats(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]

    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[1])
    for x in target:
        t.update(feats(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = []
    for d, x in docs:
        words, own = feats(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"7:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(own), weight, score, None, len(words) >= least and d is not None])
    can = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0]))
    for i, x in enumerate(can[: percent * len(can) // 100]):
        x[4] = i + 1
    return sorted(key(x[:5]) for x in out)


def test_resampling_as_brute_force(spark, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()] + [(100_000 + (d or 0), t) for d, t in made(200)]
    docs += [(None, "null id " * 30), (999_999, None), (999_998, "")]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [None, ""]
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    want = brute_resample(docs, target)
    for slices, head in ((1 << 20, 1 << 15), (64, 50)):  # long texts in slices, and most features in the tail
        monkeypatch.setattr(resampling, "SLICE", slices)
        monkeypatch.setattr(resampling, "HEAD_WORDS", head)
        got = resampling.resample(framed(spark, docs), aim).select("doc_id", "n_features", "weight", "score", "rank")
        assert sorted(map(key, got.collect())) == want


def test_resampling_of_little(spark):
    none = framed(spark, []), spark.createDataFrame([], "text string")
    assert resampling.resample(*none).count() == 0
    rows = [(i, "a b " * 10) for i in (3, 1, 2, 4)] * 2
    got = sorted(map(key, resampling.resample(framed(spark, rows), none[1], 50).select("rank", "doc_id").collect()))
    assert [r for r, _ in got] == [-1] * 4 + [1, 2, 3, 4]


def test_chunks_keep_pairs_over_slices(monkeypatch):
    text = b"ab cd " * 40 + b". . . . . . . . . . . . . . . . . . . . ." + b"x" * 90 + b" ef gh"
    whole = [resampling.features(resampling.Head(), *c) for c in resampling.chunks([text, b"one two"])]
    monkeypatch.setattr(resampling, "SLICE", 16)
    parts = [resampling.features(resampling.Head(), *c) for limit in (16, 1000) for c in resampling.chunks([text, b"one two"], limit)]
    assert sum((Counter(zip(*map(np.ndarray.tolist, x))) for x in whole * 2), Counter()) == sum((Counter(zip(*map(np.ndarray.tolist, x))) for x in parts), Counter())


# -- spans -------------------------------------------------------------------------------------


def brute_spans(rows):
    own, docs = alignment.Aligner(BYTES, PIECES), []
    for d, t in rows:
        docs.append((d, None))
        if not t:
            continue
        a, b = own.a.encode(" " + t, add_special_tokens=False).ids, own.b.encode(t)
        said = [own.bytes_a[i] for i in a], [own.bytes_b[i] for i in b]
        if any(b"".join(x) != (" " + t).encode() for x in said):
            continue
        ends, groups, at = [np.cumsum([len(x) for x in s]).tolist() for s in said], [], [0, 0]
        for cut in sorted(set(ends[0]) & set(ends[1])):
            upto = [e.index(cut) + 1 for e in ends]
            groups.append((a[at[0] : upto[0]], b[at[1] : upto[1]]))
            at = upto
        docs[-1] = (d, (a, b, groups))
    count, best, out = Counter(), Counter(), []
    for _, x in docs:
        count.update({(p, q) for left, right in x[2] for p in left for q in right} if x else ())
    for (p, _), n in count.items():
        best[p] = max(best[p], n)
    for d, x in docs:
        if not x:
            out.append(key((d, 0, 0, 0, 0, 0, 0, "")))
            continue
        links = [(p, q) for left, right in x[2] for p in left for q in right]
        text = ";".join(",".join(map(str, left)) + "|" + ",".join(map(str, right)) for left, right in x[2])
        out.append(key((d, len(x[0]), len(x[1]), len(x[2]), len(links), sum(count[k] == best[k[0]] for k in links), sum(count[k] for k in links), hashlib.sha256(text.encode()).hexdigest())))
    return sorted(out)


def test_spans_as_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = docs + made(1500, 8) + made(1500, 9, [x for x in BITS if x != "▁"]) + ODD
    assert sorted(map(key, alignment.align(framed(spark, rows), BYTES, PIECES).collect())) == brute_spans(rows)
    assert alignment.align(framed(spark, rows).limit(0), BYTES, PIECES).count() == 0


def test_spans_in_slices_and_with_a_small_memo(spark, monkeypatch):
    rows = made(400, 12, [x for x in BITS if x != "▁"]) + [(1, "some words and more " * 300), (1, "some words and more " * 300), (2, "x" * 2000)]
    own = alignment.Aligner(BYTES, PIECES)
    monkeypatch.setattr(alignment, "SLICE", 64)
    monkeypatch.setattr(alignment, "MEMO", 40)
    block = alignment._block(own, 0, [d for d, _ in rows], [t.encode() for _, t in rows]).to_pylist()[0]
    want = {}
    for r in brute_spans(rows):
        want.setdefault((r[1:5], r[7]), 0)
    assert set(zip(zip(*(block[c] for c in ("n_a", "n_b", "n_groups", "n_links"))), block["sha"])) == set(want)


@pytest.mark.parametrize("name", ["op11_piece_rounds", "op12_head_tail_resampling", "op13_token_spans"])
def test_queries_return_a_row_for_each_document(spark, name):
    from domora.llm.registry import QUERIES

    got = QUERIES[name](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and "doc_id" in got.columns


def test_common_ends_are_marked_and_not_sorted(monkeypatch):
    import random

    import numpy as np

    from domora.llm import alignment
    from domora.llm.bpe import public_path

    own, pick = alignment.Aligner(public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")), random.Random(3)
    units = sorted({(" " + "".join(pick.choice("abétée日本🙂zq") for _ in range(pick.randint(1, 9)))).encode() for _ in range(200)})
    monkeypatch.setattr(alignment.np, "intersect1d", lambda *a, **k: pytest.fail("ends are sorted"))
    own.learn(set(units))
    for u in units:
        text, k = u.decode(), own.unit[u]
        if not own.good[k]:
            continue
        ids_a, ids_b = own.a.encode(text, add_special_tokens=False).ids, own.b.encode(text[1:])
        ends = [set(np.cumsum([len(b[i]) for i in ids]).tolist()) for b, ids in ((own.bytes_a, ids_a), (own.bytes_b, ids_b))]
        assert (own.n_a[k], own.n_b[k]) == (len(ids_a), len(ids_b))
        assert own.n_groups[k] <= len(ends[0] & ends[1]) and own.groups[k].count(b";") == own.n_groups[k] - 1
