"""Repetition, language, packing, BPE, top-k and URL operators against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from domora.llm import bpe, language, packing, quality, topk, urls

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [
    (1, None), (2, ""), (3, "   \n\n "), (4, "a"), (5, "é ü x \U0001f600"), (6, "same line\nsame line\n\nsame line"), (7, "a b c d e " * 30),
    (7, "a b c d e " * 30), (None, "null id"), (8, "x" * 9000), (9, "word " * 3000 + "end"), (10, "tab\tand\x0bvt\x0cff\rcr\x1cfs"), (11, "1234 #$%&*|<>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "x", 5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept string, row int")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = [x for i, x in enumerate(lines) if x in lines[:i]]
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in quality.SYMBOLS), "n_dup_lines": len(dup)}
    out["dup_line_chars"] = sum(len(w) for x in dup for w in WORD.findall(x))
    for n in quality.NGRAM_LIMITS:
        grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        count, seen, later = Counter(grams), set(), set()
        for i, g in enumerate(grams):
            if g in seen:
                later.update(range(i, i + n))
            seen.add(g)
        out[f"dup_chars_{n}"] = sum(len(words[i]) for i in later)
        if n == 5:
            out["n_repeat_words"] = len({j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)})
    return out


def test_repetition_counts(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    for frame in (odd, docs):
        texts = sorted(((r["doc_id"] or -1, r["text"]) for r in frame.collect()), key=lambda x: x[0])
        got = sorted(quality.repetition(frame).collect(), key=lambda r: r["doc_id"] or -1)
        assert len(got) == len(texts)
        for r, (_, text) in zip(got, texts, strict=True):
            want = brute_quality(text)
            assert {k: r[k] for k in want} == want
            assert r["base_failed"] == (want["n_words"] < 10 or 100 * want["n_repeat_words"] > 20 * want["n_words"])
    assert quality.repetition(odd.limit(0)).count() == 0


def test_language_held_out_accuracy(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.op2_language(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == docs.count() and (held.lang_pred == held.lang).mean() > 0.97
    assert got.score.between(0, 1).all()
    assert set(got.held_out[got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)]) == {True}
    model = language.fit(docs)
    by = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [by[i]["lang_pred"] for i in (1, 2, 3, 11)] == ["und"] * 4 and len(language.identify(odd, model).collect()) == len(ODD)
    assert language.identify(odd, language.fit(docs.limit(0))).where("lang_pred <> 'und'").count() == 0


def test_language_mixture_finds_both(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    one = {x: docs.where(f"lang = '{x}' and n_chars between 2000 and 4000").orderBy("doc_id").first()["text"][:1500] for x in ("en", "de")}
    got = language.identify(spark.createDataFrame([(1, one["en"] + " " + one["de"])], "doc_id long, text string"), model).first()
    shares = {m["lang"]: m["share"] for m in got["mixture"]}
    assert set(shares) == {"en", "de"} and all(0.3 < s < 0.7 for s in shares.values())


def brute_mixture(model, text):
    """Shares of the languages by EM over words, one word and one language at a time."""
    low = [32 if b in b" \t\n\x0b\x0c\r" else b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    before = [32, 32, *low]
    gram = [(((before[i] << 16 | before[i + 1] << 8 | low[i]) * 2654435761) % 2**32) >> 17 for i in range(len(low))]
    spans, start = [], None
    for i, b in enumerate([*low, 32]):
        if b != 32 and start is None:
            start = i
        elif b == 32 and start is not None:
            spans.append((start, min(i + 1, len(low))))
            start = None
    k = len(model.langs)
    like = []
    for a, b in spans:
        sums = [sum(float(model.table[g, j]) for g in gram[a:b]) for j in range(k)]
        like.append([math.exp(max(x - max(sums), -25)) for x in sums])

    def em(alive, rounds):
        share = [1 / len(alive) if j in alive else 0.0 for j in range(k)]
        for _ in range(rounds):
            got = [0.0] * k
            for word in like:
                total = sum(x * s for x, s in zip(word, share))
                for j in alive:
                    got[j] += word[j] * share[j] / max(total, 1e-30)
            share = [x / sum(got) for x in got]
        return share, sum(math.log(max(sum(x * s for x, s in zip(word, share)), 1e-30)) for word in like)

    alive, penalty = set(range(k)), 0.5 * math.log(max(len(like), 2)) + 1
    share, total = em(alive, language.ROUNDS)
    while len(alive) > 1:
        fewer = alive - {min(sorted(alive), key=lambda j: share[j])}
        less, lower = em(fewer, 4)
        if lower + penalty < total:
            break
        alive, share, total = fewer, less, lower
    return share


def test_language_mixture_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang")
    model = language.fit(docs)
    counted = Counter()
    for r in docs.where("text is not null and lang is not null").collect():
        counted[r["lang"]] += len(r["text"].encode())
    assert model.langs == tuple(sorted(counted))
    rows = [(r["doc_id"], " ".join(r["text"].split()[:40])) for r in docs.where("text is not null").orderBy("doc_id").limit(40).collect()]
    rows += [(10_000 + i, a[1] + " " + b[1]) for i, (a, b) in enumerate(zip(rows[::2], rows[1::2], strict=True))]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, lang_pred int")
    got = {r["doc_id"]: {m["lang"]: m["share"] for m in r["mixture"]} for r in language.identify(frame, model).collect()}
    for i, text in rows:
        if any(c.isalpha() for c in text):
            want = brute_mixture(model, text)
            assert all(abs(got[i].get(lang, 0.0) - w) < 1e-3 for lang, w in zip(model.langs, want, strict=True)), (i, got[i], want)


def test_too_many_languages_raise(spark, monkeypatch):
    docs = spark.createDataFrame([("text of one", "a"), ("text of two", "b"), ("text of three", "c")], "text string, lang string")
    monkeypatch.setattr(language, "MAX_LANGUAGES", 3)
    assert language.fit(docs).langs == ("a", "b", "c")
    monkeypatch.setattr(language, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        language.fit(docs)


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.public_path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_bpe_equals_library(spark, odd):
    lib, path = library("word_bpe_49k.json"), bpe.public_path("word_bpe_49k.json")
    long = spark.createDataFrame([(20, "x" * 5000 + "yz" * 4000 + " é" + "don't" * 3000), (21, "<|endoftext|>a <|startoftext|>"), (22, "日本語" * 3000), (23, "é" * 2500 + "ΣΑΣ")], "doc_id long, text string")
    frame = odd.select("doc_id", "text").unionByName(long).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = Counter(tuple(r) for r in bpe.digests(bpe.encoded(frame, path), path).collect())
    want = Counter()
    for r in frame.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want


def test_bpe_tree_joins_exactly():
    enc = bpe.TreeEncoder(bpe.public_path("word_bpe_49k.json"))
    rng = np.random.default_rng(3)
    for size in (3000, 5001, 20000):
        part = "".join(rng.choice(list("etaoinshrdlu"), size))
        assert enc.tree(part)[0].tolist() == [t.id for t in enc.library.model.tokenize(part)]
    part = "ha" * 4000
    assert enc.tree(part)[0].tolist() == [t.id for t in enc.library.model.tokenize(part)]


def test_bpe_parts_of_long_texts(spark, monkeypatch):
    path, text = bpe.public_path("word_bpe_49k.json"), "some words and more " * 300 + "x" * 500
    monkeypatch.setattr(bpe, "SPLIT_BYTES", 1000)
    rows = spark.createDataFrame([(1, text, 0), (1, text, 0)], "doc_id long, text string, row long")
    got = [np.frombuffer(r["ids"], np.uint32).tolist() for r in bpe._parts(rows.withColumn("row", rows["row"] + 0), path).collect()]
    assert len(got) in (1, 2)
    got = [np.frombuffer(r["ids"], np.uint32).tolist() for r in bpe.encoded(rows.drop("row"), path).collect()]
    assert got == [library("word_bpe_49k.json").encode(text, add_special_tokens=False).ids] * 2


def test_bpe_leaves_of_unbroken_texts_are_rows(spark, monkeypatch):
    path, lib = bpe.public_path("word_bpe_49k.json"), library("word_bpe_49k.json")
    for name, value in (("SPLIT_BYTES", 4000), ("LEAF_ROW", 700), ("LONG_PIECE", 600), ("FAN", 3)):
        monkeypatch.setattr(bpe, name, value)
    rng = np.random.default_rng(8)
    letters = "".join(rng.choice(list("etaoinshrdluéß"), 20000))
    texts = [
        letters,
        "some words " * 300 + letters[:9000] + " and more " * 200 + letters[9000:12000],
        "don't" * 2000,
        "ha" * 5000,
        "x" * 700 + "-" * 6000 + "1" * 3000,
        "日本語" * 1500,
        "a<|endoftext|>" * 500,
        " " * 5000,
        letters[:4001] + "\n",
    ]
    rows = spark.createDataFrame([(i % 8, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = Counter((r["doc_id"], np.frombuffer(r["ids"], np.uint32).tobytes()) for r in bpe.encoded(rows, path).collect())
    assert got == Counter((i % 8, np.array(lib.encode(t, add_special_tokens=False).ids, np.uint32).tobytes()) for i, t in enumerate(texts))
    held = [u for t in texts for u in bpe.encoder(path).units(t.encode(), 1000, 700)]
    assert max(leaf for leaf, _, _ in held) > bpe.FAN**2 and all(len(w) <= 700 for _, _, words in held for w in words or [])


def test_packing_pieces_and_places(spark, odd):
    lib, path = library("byte_bpe_50k.json"), bpe.public_path("byte_bpe_50k.json")
    extra = spark.createDataFrame([(30, "a  b   c \n  d\n\n e"), (31, " lead and trail "), (32, "it's <|endoftext|> ok  x")], "doc_id long, text string")
    frame = odd.select("doc_id", "text").unionByName(extra).unionByName(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    got = packing.pack(packing.token_pieces(frame, path)).collect()
    want, total = Counter(), 0
    for r in frame.collect():
        ids = [*lib.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
            want[r["doc_id"], k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    assert len({r["sequence_id"] for r in got}) <= math.ceil(total / 2048) * 1.03 + 1
    assert packing.pack(packing.token_pieces(frame.limit(0), path)).count() == 0


def test_byte_encoder_equals_library_on_white_space():
    lib, enc = library("byte_bpe_50k.json"), packing.ByteEncoder(bpe.public_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(7)
    signs = [*"  \t\n\v\f\r\x85\xa0\u1680\u2000\u200a\u2028\u2029\u202f\u205f\u3000\u200b\x1c", " ", " ", " ", "a", "é", "日", "'s", "5", "%", "–", "<|endoftext|>"]
    texts = ["".join(rng.choice(signs, rng.integers(0, 14))) for _ in range(20000)] + ["Price: 5\xa0 \xa0 \xa0 EUR", "a \xa0 \xa0 b", "a\n \nb", "a\n "]
    for text, got in zip(texts, enc.batch([t.encode() for t in texts])):
        assert np.frombuffer(got, np.uint32).tolist() == lib.encode(text, add_special_tokens=False).ids, repr(text)


def check_places(rows, capacity):
    by = {}
    for s, o, n in rows:
        by.setdefault(s, []).append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= capacity


@pytest.mark.parametrize("kind", ["small", "large", "one length", "mixed"])
def test_packing_shapes(spark, kind):
    rng = np.random.default_rng(5)
    size = {"small": rng.integers(1, 20, 500), "large": rng.integers(700, 2049, 300), "one length": np.full(400, 1025), "mixed": rng.integers(1, 2049, 700)}[kind]
    rows = spark.createDataFrame([(i, 0, 0, int(n), 0) for i, n in enumerate(size)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(rows).collect()
    assert len(got) == len(size)
    check_places([(r["sequence_id"], r["offset"], r["length"]) for r in got], 2048)
    first = []  # first-fit decreasing
    for n in sorted(size, reverse=True):
        for i, x in enumerate(first):
            if x + n <= 2048:
                first[i] += n
                break
        else:
            first.append(n)
    assert len({r["sequence_id"] for r in got}) <= len(first) * 1.03 + 1


def brute_top(rows, queries, k):
    out = []
    for q, v in queries:
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    body = rng.integers(-300, 300, (700, 8)).tolist() + [[5] * 8] * 60
    vectors = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in enumerate(body)], "vec_id long, v array<long>")
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), 10).collect())
    assert got == brute_top(list(enumerate(body)), [(i, v) for i, v in enumerate(body) if i % 20 == 0], 10)
    few = vectors.limit(4)
    assert topk.top_k(few, few, 10).count() == 12
    assert topk.top_k(vectors.limit(0), vectors, 10).count() == 0


def test_top_k_of_several_lengths(spark):
    """Every query meets the vectors of its own length; repeated ids and clashing columns stay."""
    rng = np.random.default_rng(3)
    body = [(i, rng.integers(-9, 9, 2 + i % 3).tolist()) for i in range(60)] + [(60, [1, 1])] * 2
    vectors = spark.createDataFrame([(i, [int(x) for x in v], 1.0) for i, v in body], "vec_id long, v array<long>, score double")
    asked = [(i, v) for i, v in body if i < 9]
    got = sorted(tuple(r) for r in topk.top_k(vectors, vectors.where("vec_id < 9").select("vec_id", "v"), 4).collect())
    assert got == brute_top(body, asked, 4)


def test_quantised_leaves_out_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.0001], 7), (2, None, 7), (3, [nan, 1.0], 7), (4, [None, 1.0], 7), (5, [inf, 1.0], 7), (None, [1.0, 1.0], 7)]
    got = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")).collect()
    assert [(r["vec_id"], r["v"]) for r in got] == [(1, [512, -1])]


def test_url_rules(spark):
    cases = {
        "http://EXAMPLE.com/en/x?q": ("example.com", "/en/x", "example.com/en/", "block"), "https://www.example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
        "ftp://a.b.example.com/en": ("a.b.example.com", "/en", "com/", "allow"), "http://x.net/fr/1#t": ("x.net", "/fr/1", "net/fr/", "block"), "http://x.net": ("x.net", "", None, "allow"),
        "http://com": ("com", "", None, "allow"), "x.net/fr/": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://a.adult-x.example.net/x": ("a.adult-x.example.net", "/x", None, "block"),
        "://?": ("", "", None, "allow"), "http://xcom/": ("xcom", "/", None, "allow"),
    }
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(cases)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(pages, *urls.default_rules(spark)).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())
    assert urls.judge(pages.limit(0), *urls.default_rules(spark)).count() == 0


def test_listed_names_under_any_ending(spark):
    urls_of = ["http://www.spam-farm.example.org/a", "http://casino-win.test/", "http://free-bets.example.com/x", "http://my-spam-farm.example.org/", "http://spam-farm/", None]
    pages = spark.createDataFrame(list(enumerate(urls_of)), "page_id long, url string")
    rules = urls.default_rules(spark)[0].limit(0)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, rules, urls.hosts_by_name(pages, urls.LISTED_NAMES)).collect()}
    assert [got[i] for i in range(len(urls_of))] == ["block", "block", "block", "allow", "allow", "allow"]


def test_urls_of_many_labels_and_repeats(spark):
    """Hosts of thousands of labels, very long paths and repeated rows; of equally long keys the longer host's wins."""
    deep = ".".join(f"l{i}" for i in range(3000))
    asked = [
        (1, f"http://{deep}.x.net/fr/a"), (2, f"http://{deep}.casino-win.example.com/en/"), (2, f"http://{deep}.casino-win.example.com/en/"), (3, f"http://{deep}/"),
        (4, "http://x.net/" + "p/" * 200_000), (5, "http://" + "." * 3000 + "com/x"),
    ]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in asked], "page_id long, url string, rule string, hosts string")
    got = sorted((r["page_id"], r["rule"], r["verdict"], len(r["path"])) for r in urls.judge(pages, *urls.default_rules(spark)).collect())
    assert got == [(1, "net/fr/", "block", 5), (2, "example.com/en/", "block", 4), (2, "example.com/en/", "block", 4), (3, None, "allow", 1), (4, None, "allow", 400_001), (5, "com/", "allow", 2)]
    names = {r[0] for r in urls.hosts_by_name(pages, ["casino-win", "l2998"]).collect()}
    assert names == {"casino-win.example.com", f"{deep.split('.', 2998)[-1]}.x.net", f"{deep.split('.', 2998)[-1]}.casino-win.example.com", "l2998.l2999"}
    rules = spark.createDataFrame([("b.com", "/", "block"), ("com", "/a/x/", "allow"), ("com", "/a/", "block"), ("com", "/a/", "allow"), (None, "/", "block")], "host string, path string, verdict string")
    one = spark.createDataFrame([(1, "http://b.com/a/"), (2, "http://c.com/a/"), (3, "http://b.com/a/x/")], "page_id long, url string")
    judged = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(one, rules, spark.createDataFrame([], "host string")).collect()}
    assert judged == {1: ("b.com/", "block"), 2: ("com/a/", "block"), 3: ("com/a/x/", "allow")}


def test_cascade_of_a_long_list(spark):
    """100,000 listed keys of a universe of 300,000, against arithmetic."""
    universe = spark.range(300_000).selectExpr("id", "concat('h', id, '.example.org') as key")
    levels = urls.build(universe.where("id % 3 = 1").select("key"), universe.select("key"))
    assert sum(x.bits for x in levels) < 3_000_000
    wrong = universe.where(urls.contains(universe["key"], levels) != (universe["id"] % 3 == 1))
    assert wrong.count() == 0


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(urls, "BITS_PER_KEY", 2)  # many false positives, many levels
    universe = spark.range(3000).selectExpr("cast(id as string) as key")
    listed = spark.range(3000).where("id % 7 = 3").selectExpr("cast(id as string) as key").union(spark.sql("select null"))
    levels = urls.build(listed, universe)
    assert len(levels) > 2
    got = universe.where(urls.contains(universe["key"], levels)).count()
    assert got == 3000 // 7 + (3000 % 7 > 3)
    assert urls.build(listed.limit(0), universe) == [] and universe.where(urls.contains(universe["key"], [])).count() == 0


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    sets = [
        [(1, [97656.25, 1 / 1024]), (2, [97656.25, 2 / 1024]), (3, [97656.25, 3 / 1024]), (4, [97656.25, 5 / 1024])],
        [(1, [5e6, 1.0]), (2, [1.0, 2.0]), (3, [-5e6, 3.0])],
        [(1, [1e17, 1.0]), (2, [1e17, 2.0]), (3, [-1e17, 0.0]), (4, [0.0, 1.0]), (5, [])],
        [(i, (rng.integers(-(2**33), 2**33, 3) / 1024.0).tolist()) for i in range(80)],
    ]
    for rows in sets:
        vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
        got = sorted(tuple(r) for r in topk.top_k(vectors, vectors, 3).collect())
        whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if v}
        want = []
        for q, v in whole.items():
            met = sorted((-max(-topk.LIMIT, min(topk.LIMIT, sum(x * y for x, y in zip(v, w)))), i) for i, w in whole.items() if i != q)
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(met[:3])]
        assert got == sorted(want)
