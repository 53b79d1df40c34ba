"""Near duplicates, repeats, toxicity, language model and pipeline against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from domora.llm import jaccard, language, mixing, packing, suffixes, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SMALL = "/root/testdata/sf0.001"


def words_of(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def corpus(spark):
    """Copies, near copies, shared passages, short, empty and null texts, shared and null ids."""
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefghéü"), rng.integers(2, 8))) for _ in range(400)]
    passage = " ".join(rng.choice(vocab, 60))
    rows = []
    for i in range(40):
        base = list(rng.choice(vocab, int(rng.integers(20, 160))))
        rows.append((len(rows), " ".join(base)))
        for _ in range(int(rng.integers(0, 4))):
            near = list(base)
            for _ in range(int(rng.integers(0, 4))):
                near[int(rng.integers(0, len(near)))] = str(rng.choice(vocab))
            rows.append((len(rows), " ".join(near)))
        if i % 5 == 0:
            rows.append((len(rows), f"x{i} {passage} y{i}\n" + " ".join(rng.choice(vocab, 10))))
    rows += [(500, None), (501, ""), (502, "one"), (503, "ONE"), (504, "two words"), (505, "a" * 950), (506, "  \n "), (507, "z" * 99), (508, "z" * 100)]
    rows += [(600, rows[0][1]), (600, rows[0][1]), (None, rows[1][1])]
    return spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, h int, key string"), rows


def brute_groups(texts, rule):
    sets = []
    for t in texts:
        w = words_of(t)
        sets.append({tuple(w[i : i + rule.n]) for i in range(len(w) - rule.n + 1)} if len(w) >= rule.n else ({tuple(w)} if w else set()))
    root, links = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and rule.den * both >= rule.num * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                root[max(find(i), find(j))] = min(find(i), find(j))
    return sets, [find(i) for i in range(len(sets))], links


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90), jaccard.Rule(5, 80), jaccard.Rule(2, 60)])
def test_near_duplicates(spark, corpus, rule, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 400)  # groups of several tiles
    monkeypatch.setattr(jaccard, "HELD_KEYS", 500)
    frame, rows = corpus
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    sets, root, links = brute_groups([t for _, t in order], rule)
    group = {}
    for i, r in enumerate(root):
        group.setdefault(r, []).append(order[i][0])
    want = Counter((order[i][0], len(s), min((x for x in group[root[i]] if x is not None), default=None), links[i], i == root[i]) for i, s in enumerate(sets))
    assert Counter(tuple(r) for r in jaccard.near_duplicates(frame, rule).collect()) == want
    assert jaccard.near_duplicates(frame.limit(0), rule).count() == 0


def brute_repeats(rows, depth):
    seen, out = set(), []
    for doc, text in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        raw, gone = (text or "").encode(), set()
        for p in range(len(raw) - depth + 1):
            if raw[p : p + depth] in seen:
                gone.update(range(p, p + depth))
            seen.add(raw[p : p + depth])
        kept = bytes(b for i, b in enumerate(raw) if i not in gone)
        out.append((doc, len(raw), len(gone), sum(i - 1 not in gone for i in gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("depth", [100, 40])
def test_repeats(corpus, depth, monkeypatch):
    frame, rows = corpus
    for block, large, bodies in ((1 << 20, 1 << 20, 1 << 26), (300, 1 << 20, 500), (300, 100, 1 << 26)):  # small blocks cut texts into segments and make hot anchors
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", block)
        monkeypatch.setattr(suffixes, "LARGE", large)
        monkeypatch.setattr(suffixes, "_BODIES", bodies)
        got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept"]).hexdigest()) for r in suffixes.without_repeats(frame, depth).collect()]
        assert Counter(got) == brute_repeats(rows, depth)
    assert suffixes.without_repeats(frame.limit(0), depth).count() == 0


@pytest.mark.parametrize("depth", [1, 8, 13, 100])
def test_passes_order_suffixes(depth):
    rng = np.random.default_rng(depth)
    raw = np.concatenate([rng.choice(np.array([0, 97, 255], np.uint8), 700), np.tile(np.arange(120, dtype=np.uint8), 3)])
    at = rng.permutation(len(raw) - depth + 1)
    bucket = np.sort(rng.integers(0, 3, len(at)))
    left, group = suffixes.ordered(raw, at, bucket, depth)
    key = [(bucket[i], raw[at[i] : at[i] + depth].tobytes()) for i in range(len(at))]
    times = Counter(key)
    got = [key[i] for i in left]
    assert got == sorted(k for k in key if times[k] > 1)
    assert [a == b for a, b in zip(group, group[1:])] == [a == b for a, b in zip(got, got[1:])]
    assert len(suffixes.ordered(raw, at[:0], bucket[:0], depth)[0]) == 0


def test_long_text_in_segments():
    rng = np.random.default_rng(2)
    raw = rng.integers(97, 101, 9000).astype(np.uint8)
    whole = suffixes.runs(raw, np.array([0, len(raw)]), 100, 28)
    assert whole[2].sum() == len(raw) - 99
    assert sum(suffixes.runs(p, e, 100, 28)[2].sum() for p, e, _ in suffixes._segments(raw, np.array([0, len(raw)]), 100)) == len(raw) - 99


def test_toxicity(spark, corpus):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.op9_toxicity(spark, sf).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").toPandas()
    yes, no = got.score[got.toxic == 1].to_numpy(), got.score[got.toxic == 0].to_numpy()
    auc = ((yes[:, None] > no).mean() + (yes[:, None] == no).mean() / 2)
    assert auc > 0.93 and ((got.predicted == 1) & (got.toxic == 0)).sum() <= 0.01 * len(got)
    frame, rows = corpus
    model = toxicity.fit(frame, labels.limit(0))
    found = toxicity.score(frame, model).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] < 0.5 and r["predicted"] == 0 for r in found)


def test_label_model_counts_repeated_voters_once():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.1) for _ in range(4)], axis=1).astype(float)
    votes = np.column_stack([votes, votes[:, 0], votes[:, 0]])
    q, model = toxicity.label_model(votes, votes[:, 1], 0.3, rounds=60)
    assert ((q > 0.5) == y).mean() > 0.9 and abs(model.rates[1, 1] - 0.8) < 0.1
    # the copies of voter 0 hang on one another, and what a copy adds to the odds is nothing where its parent fires
    tied = {frozenset((j, int(p))) for j, p in enumerate(model.parent) if p >= 0}
    assert len([t for t in tied if t <= {0, 4, 5}]) == 2
    alone, thrice = np.zeros((1, 6)), np.zeros((1, 6))
    alone[0, 1] = thrice[0, [0, 4, 5]] = 1
    assert abs(toxicity.log_odds(alone, model) - toxicity.log_odds(thrice, model))[0] < 0.5


def brute_label_model(votes, start, prior, rounds):
    """The same EM in plain Python: a forest of correlations by Prim's rule, and products of probabilities."""
    n, m, q = len(votes), len(votes[0]), list(start)
    mean = [min(max(sum(v[j] for v in votes) / n, 0.5 / (n + 1)), 1 - 0.5 / (n + 1)) for j in range(m)]
    for _ in range(rounds):
        w = [[1 - x for x in q], q]
        size = [sum(x) for x in w]
        once = [[sum(x for x, v in zip(w[y], votes) if v[j]) for j in range(m)] for y in (0, 1)]
        pair = [[[sum(x for x, v in zip(w[y], votes) if v[i] and v[j]) for j in range(m)] for i in range(m)] for y in (0, 1)]
        rate = [[(once[y][j] + mean[j]) / (size[y] + 1) for j in range(m)] for y in (0, 1)]

        def gain(i, j):
            total = 0
            for y in (0, 1):
                p, a, b = (pair[y][i][j] + mean[i] * mean[j]) / (size[y] + 1), rate[y][i], rate[y][j]
                for c, e in ((p, a * b), (a - p, a * (1 - b)), (b - p, (1 - a) * b), (1 - a - b + p, (1 - a) * (1 - b))):
                    total += size[y] / n * max(c, 1e-9) * math.log(max(c, 1e-9) / max(e, 1e-9))
            return total

        parent, left, done = [-1] * m, set(range(1, m)), [0]
        while left:
            g, _, i, j = max((gain(i, j), -j, i, j) for i in done for j in left)
            parent[j] = i if n * g > math.log(n) else -1
            left.remove(j)
            done.append(j)
        out = []
        for v in votes:
            odds = math.log(prior / (1 - prior))
            for j, p in enumerate(parent):
                both = []
                for y in (0, 1):
                    if p < 0:
                        x = rate[y][j]
                    elif v[p]:
                        x = (pair[y][j][p] + rate[y][j]) / (once[y][p] + 1)
                    else:
                        x = (once[y][j] - pair[y][j][p] + rate[y][j]) / (size[y] - once[y][p] + 1)
                    both.append(x if v[j] else 1 - x)
                odds += math.log(both[1] / both[0])
            out.append(1 / (1 + math.exp(-odds)))
        q = out
    return q


def test_label_model_equals_brute_force():
    rng = np.random.default_rng(5)
    y = rng.random(200) < 0.4
    votes = np.stack([np.where(y, rng.random(200) < hi, rng.random(200) < lo) for hi, lo in ((0.7, 0.1), (0.6, 0.2), (0.5, 0.05), (0.3, 0.3))], axis=1).astype(float)
    votes = np.column_stack([votes, np.where(rng.random(200) < 0.9, votes[:, 0], votes[:, 1])])
    start = np.where(votes.sum(1) > 1, 0.9, 0.1)
    got, _ = toxicity.label_model(votes, start, 0.4, rounds=5)
    assert np.allclose(got, brute_label_model(votes.astype(int).tolist(), start.tolist(), 0.4, 5), atol=1e-6)


def test_pattern_voters_read_the_text(monkeypatch):
    import pyarrow as pa

    def plain(text):
        raw, offsets = toxicity.utf8(pa.array([text]))
        return toxicity.entries(raw, offsets, len(raw))[0]

    lexicon = np.unique(plain("idiot"))
    look = lambda texts: toxicity.hits(pa.array(texts, pa.string()), lexicon, np.zeros(len(lexicon), np.int64), 1)
    texts = ["an idiot.", "an id1ot!", "i.d.i.o.t", "idiooot", "so i d i o t yes", "i d o", "IDIOTS ARE SHOUTING LOUDLY", "what?! no", None, "", "plain words", "1000 2000 idio", "ID1OT"]
    found, stats = look(texts)
    votes = toxicity.votes(found, stats)
    names = {k: i + 1 for i, k in enumerate(toxicity.PATTERNS)}
    fires = lambda k: [t for t, v in zip(texts, votes[:, names[k]], strict=True) if v]
    assert fires("disguised") == ["an id1ot!", "i.d.i.o.t", "idiooot", "ID1OT"] and fires("spaced") == ["so i d i o t yes"]
    assert fires("shouts") == ["IDIOTS ARE SHOUTING LOUDLY"] and fires("marks") == ["what?! no"] and fires("calm") == []
    assert [t for t, v in zip(texts, votes[:, 0], strict=True) if v] == ["an idiot.", "an id1ot!", "i.d.i.o.t", "idiooot", "so i d i o t yes", "IDIOTS ARE SHOUTING LOUDLY", "1000 2000 idio", "ID1OT"]
    # a long text in parts reads as in one
    rng = np.random.default_rng(2)
    long = " ".join(rng.choice(["idiot", "id1ot", "word!!", "Other", "\n", "x", "y" * 300], 4000))
    whole = look([long])
    monkeypatch.setattr(toxicity, "PART_BYTES", 1000)
    parts = look([long])
    assert (whole[0] == parts[0]).all() and (whole[1][:, :6] == parts[1][:, :6]).all()
    raw, offsets = toxicity.utf8(pa.array([long]))
    cut = np.concatenate([toxicity.entries(*p)[0] for p in toxicity.pieces(raw, offsets)])
    assert (np.sort(cut) == np.sort(plain(long))).all()


def brute_toxicity(text, lexicon, model):
    """The score from strings; lexicon: form -> voter, forms as (kind, ...) below."""
    raw = (text or "").encode()
    low = lambda b: b.translate(bytes(toxicity.LOWER))
    letters = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    trimmed = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", raw):
        for _ in range(3):
            w = w[:-1] if w[-1:] and w[-1:] in b".,!?;:\"'()" else w
        trimmed.append(w)
    forms = lambda w: [("word", w), *(("start", w[:n]) for n in toxicity.BEGINNINGS if len(w) >= n)]
    plain = [f for w in trimmed for f in forms(low(w))] + [("pair", low(a), low(b)) for a, b in zip(trimmed, trimmed[1:])]
    hidden = []
    for w in trimmed:
        odd = any(c in b"013457@$!*._-~'`^|" for c in w) or re.search(rb"(.)\1\1", low(w), re.S)
        if odd and sum(c in letters or c > 127 for c in w) >= 2:
            read = bytes(toxicity._FOLD[c] for c in w if c not in b"*._-~'`^|")
            read = re.sub(rb"(.)\1\1+", rb"\1", read, flags=re.S)
            hidden += forms(read) if read else []
    apart, run = [], []
    for w in [*trimmed, b""]:
        if len(w) == 1 and w in letters:
            run.append(low(w))
            continue
        apart += forms(b"".join(run)) if len(run) >= toxicity.SPACED else []
        run = []
    times = [0] * model.n_voters
    for f in [*plain, *hidden, *apart]:
        if f in lexicon:
            times[lexicon[f]] += 1
    n, alpha, upper = len(trimmed), sum(c in letters for c in raw), sum(65 <= c <= 90 for c in raw)
    marks, exclaims = sum(a in b"!?" and b in b"!?" for a, b in zip(raw, raw[1:])), raw.count(b"!")
    votes = [t > 0 for t in times] + [any(f in lexicon for f in hidden), any(f in lexicon for f in apart), alpha >= 20 and 10 * upper >= 3 * alpha, marks > 0]
    votes.append(n >= 20 and 10 * upper < alpha and not exclaims and not marks)
    kinds, rate = sum(t > 0 for t in times), sum(min(t, 255) for t in times) / max(n, 1)
    x = [*votes, kinds > 0, kinds > 2, rate > 1 / 200, rate > 1 / 50]
    return 1 / (1 + math.exp(-(sum(w for w, v in zip(model.weights, x, strict=True) if v) + model.bias)))


def test_toxicity_scores_equal_brute_force(spark, corpus):
    """Whole words, beginnings and pairs, in disguise and spaced out, marks and capitals, over whole texts."""
    import pyarrow as pa

    def hashed(text, at):
        raw, offsets = toxicity.utf8(pa.array([text]))
        return int(toxicity.entries(raw, offsets, len(raw))[0][at])

    forms = {("word", b"idiot"): (hashed("idiot", 0), 0), ("start", b"stup"): (hashed("stupid", 2), 1), ("pair", b"go", b"away"): (hashed("go away", -1), 2), ("word", b"loser"): (hashed("loser", 0), 3)}
    order = sorted(forms.values())
    rng = np.random.default_rng(4)
    weights = rng.normal(size=4 + len(toxicity.PATTERNS) + toxicity.DENSITIES)
    model = toxicity.ToxicityModel(np.array([h for h, _ in order], np.uint64), np.array([v for _, v in order]), 4, weights, -0.5)
    tokens = ["idiot", "Idiot,", "id1ot", "i.d.i.o.t", "idiooot!", "STUPIDITY", "stup", "s t u p i d", "l o s e r", "go", "away.", "Go away", "l0s3r", "loser?!", "été", "plain", "words", "x", "B", "GREAT", "wow!!", "\n", "...", "''", "a_b", "a" * 12]
    texts = [" ".join(rng.choice(tokens, rng.integers(1, 40))) for _ in range(400)] + [None, "", " ", "idiot " * 300, "w " * 30, "calm words in a row " * 6]
    rows = list(enumerate(texts)) + [(1000 + i, r[1]) for i, r in enumerate(corpus[1])]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    want = {i: brute_toxicity(t, {f: v for f, (_, v) in forms.items()}, model) for i, t in rows}
    wrong = [(i, t) for i, t in rows if not math.isclose(got[i]["score"], want[i], abs_tol=1e-9)]
    assert len(got) == len(rows) and not wrong, wrong[:3]
    assert all(r["predicted"] == (want[i] >= 0.5) for i, r in got.items() if abs(want[i] - 0.5) > 1e-9)
    assert len({round(x, 6) for x in want.values()}) > 50


def test_rules_that_would_lose_links_are_refused():
    for rule in ((3, 30), (0, 90), (3, 101), (3, 49, 100)):
        with pytest.raises(ValueError, match="similarity"):
            jaccard.Rule(*rule)
    assert jaccard.Rule(3, 1, 2).num == 1 and jaccard.Rule(1, 100).den == 100


def test_toxicity_of_odd_tables(spark, corpus):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.fit(docs.withColumn("toxic", toxicity.F.lit(9)).withColumn("mark", toxicity.F.lit("x")), labels)
    twice = toxicity.fit(docs.unionByName(docs).repartition(3), labels.unionByName(labels))
    assert (model.lexicon == twice.lexicon).all() and np.allclose(model.weights, twice.weights) and np.isclose(model.bias, twice.bias)
    frame, rows = corpus
    named = frame.select("doc_id", "text", toxicity.F.lit(1).alias("score"), toxicity.F.lit("p").alias("found"))
    assert toxicity.score(named, model).count() == len(rows)
    kept = toxicity.keep_clean(named, model)
    assert kept.columns == named.columns and kept.count() == toxicity.score(named, model).where("predicted = 0").count()
    assert toxicity.score(frame.limit(0), model).count() == 0
    empty = toxicity.fit(frame.limit(0), labels)
    assert [r["predicted"] for r in toxicity.score(frame.limit(2), empty).collect()] == [0, 0]


def test_language_model(spark, corpus):
    frame, rows = corpus
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    for table in (docs, frame.select("doc_id", "text")):
        texts = [(r["doc_id"], words_of(r["text"])) for r in table.collect()]
        taught = [i is not None and zlib.crc32(str(i).encode()) % 5 != 1 for i, _ in texts]
        count = Counter(w for (_, ws), t in zip(texts, taught) if t for w in [*ws, None])
        n, v = sum(count.values()), len(count)
        want = Counter((i, len(ws) + 1, sum(count[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*ws, None]), 5)) for i, ws in texts)
        condition = language.F.coalesce(~language.held_out(5, 1), language.F.lit(False)) & language.F.col("doc_id").isNotNull()
        got = mixing.language_model(table, condition).collect()
        assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got) and all(r["bits_per_byte"] > 0 for r in got)
    assert mixing.language_model(docs.limit(0), language.F.lit(True)).count() == 0


def test_language_model_reads_word_order(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(w for i in rng.integers(0, 8, 60) for w in (f"lead{i}", f"tail{i}")) for _ in range(60)]
    swapped = " ".join(w for i in range(8) for w in (f"lead{i}", f"tail{(i + 3) % 8}"))
    same = " ".join(w for i in range(8) for w in (f"lead{i}", f"tail{i}"))
    rows = [*enumerate(texts), (100, same), (101, swapped)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixing.language_model(docs, mixing.F.col("doc_id") < 100).where("doc_id >= 100").collect()}
    assert abs(got[100]["base_score"] - got[101]["base_score"]) < 1e-9  # the same words
    assert got[100]["score"] > got[101]["score"] + 3  # in the order that was learned


def one_text(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return mixing.tokens(raw, np.array([0, len(raw)]))


def brute_continuations(rows):
    """{(key, anchor): low halves of the hashes that follow in the first other taught text} of (key, text, taught)."""
    places = {}
    for key, text, taught in rows:
        t = one_text(text)
        h, ok = mixing.anchors(t)
        for i in np.flatnonzero(ok):
            places.setdefault(int(h[i]), {}).setdefault(key, (taught, (t.hashes[i + 1 : i + 1 + mixing.AHEAD] & np.uint64(0xFFFFFFFF)).tolist()))
    out = {}
    for h, by_key in places.items():
        holders = sorted(k for k, (taught, _) in by_key.items() if taught)
        for key in by_key:
            source = next((k for k in (holders[:1] + holders[-1:]) if k != key), None)
            if source is not None:
                out[key, h] = by_key[source][1]
    return out


def test_continuations_equal_brute_force(spark, corpus):
    rows = [(n, text or "", n % 3 > 0) for n, (_, text) in enumerate(corpus[1])]
    found = mixing.continuations(spark.createDataFrame(rows, "key long, text string, taught boolean")).collect()
    got = {(r["key"], y["anchor"] % 2**64): [z % 2**32 for z in y["ahead"]] for r in found for y in r["lists"]}
    want = brute_continuations(rows)
    assert got == want and len(want) > 50
    # the word that is foretold, text by text: the one after the last anchor, as far as the continuation reaches
    lists = {r["key"]: r["lists"] for r in found}
    kind = mixing.pa.list_(mixing.pa.struct([("anchor", mixing.pa.int64()), ("ahead", mixing.pa.list_(mixing.pa.int32()))]))
    for key, text, _ in rows[:60]:
        t = one_text(text)
        word, match = mixing.predicted(t, mixing.pa.array([[y.asDict() for y in lists.get(key, [])]], kind))
        h, ok = mixing.anchors(t)
        ahead, hits = [], 0
        for i in range(len(t.hashes)):
            told = ahead.pop(0) if ahead else None
            assert (match[i] > 0) == (told is not None) and (told is None or word[i] == told)
            if told is not None:
                assert match[i] == 1 + (hits >= 2) + (hits >= 8)
            hits = hits + 1 if told is not None and told == int(t.hashes[i]) & 0xFFFFFFFF else 0
            if ok[i] and (key, int(h[i])) in want:
                ahead = list(want[key, int(h[i])])


def test_spelling_learns_each_word_about_once():
    texts = [" ".join(f"w{i}" for i in range(40)) + f" rare{k}" for k in range(200)]
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    t = mixing.tokens(raw, np.cumsum([0, *map(len, texts)]))
    words, counts = np.unique(t.hashes, return_counts=True)
    tree = mixing.tree_of(words[counts > 1], counts[counts > 1], 200)
    taken = Counter(t.hashes[mixing.spelling_words(t, np.arange(200), tree)].tolist())
    assert all(taken[int(h)] == 1 for h in words[counts == 1]) and 20 <= sum(taken[int(h)] for h in words[counts > 1]) <= 60
    none = mixing.tree_of(words[:0], counts[:0], 200)
    assert len(mixing.spelling_words(t, np.arange(200), none)) == (t.hashes != np.uint64(mixing.END)).sum()


def test_new_texts_score_above_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = mixing.language_model(docs, ~language.held_out(5, 1)).join(docs, "doc_id").withColumn("held_out", language.held_out(5, 1)).toPandas()
    new = got[got.held_out & ~got.text.isin(set(got.text[~got.held_out]))]
    assert len(new) > 150 and new.score.mean() > new.base_score.mean() + 20


def test_huffman_is_a_prefix_code():
    code = mixing.huffman(np.arange(256) ** 2)
    assert abs(sum(2.0 ** -n for n in np.diff(code.begin)) - 1) < 1e-9
    assert len({(tuple(code.node[a:b]), tuple(code.bit[a:b])) for a, b in zip(code.begin[:-1], code.begin[1:])}) == 256
    assert len(mixing.huffman(np.array([5])).node) == 0


def test_scores_do_not_depend_on_the_layout(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    condition = ~language.held_out(5, 1)
    got = [sorted(tuple(r) for r in mixing.language_model(d, condition).collect()) for d in (docs, docs.repartition(5, "text"))]
    assert [r[0] for r in got[0]] == [r[0] for r in got[1]]
    assert all(x[1:4] == y[1:4] and all(abs(u - w) < 1e-6 for u, w in zip(x[4:], y[4:])) for x, y in zip(*got))


def brute_mixed(i, row, m):
    """One text, one bit after the other."""
    weights, cost, bits = m.weights.astype(float).copy(), 0.0, list(range(len(i.bit)))
    tokens = [k for k in range(len(i.row)) if i.row[k] == row]
    for r in sorted({i.round[k] for k in tokens}):
        moves = np.zeros_like(weights)
        for k in (k for k in tokens if i.round[k] == r):
            for b in bits[i.begin[k] : i.begin[k + 1]]:
                g = i.gate[k]
                z = min(max(sum(float(x) * w for x, w in zip(i.x[:, b], weights[g])), -11.5), 11.5)
                p = 1 / (1 + math.exp(-z))
                at = min(max((z + 8) * 2, 0), 32 - 1e-3)
                refined = m.refine[g, int(at)] * (1 - at % 1) + m.refine[g, int(at) + 1] * (at % 1)
                chance = min(max((p + refined) / 2, 1e-6), 1 - 1e-6)
                cost += math.log10(chance if i.bit[b] else 1 - chance)
                moves[g] += mixing.RATE * i.x[:, b].astype(float) * (float(i.bit[b]) - p)
        weights += moves
    return cost


def test_mixing_equals_brute_force():
    rng = np.random.default_rng(4)
    size = rng.integers(1, 6, 50)
    begin = np.concatenate([[0], np.cumsum(size)])
    row, step, gate = np.repeat([0, 1], 25), np.tile(np.repeat([0, 1, 2], [9, 8, 8]), 2), rng.integers(0, mixing.GATES, 50)
    order = np.lexsort((gate, row, step))
    i = mixing.Inputs(rng.normal(0, 2, (mixing.INPUTS, begin[-1])).astype(np.float32), rng.integers(0, 2, begin[-1]).astype(np.uint8), begin, row[order], gate[order], step[order])
    refine = rng.uniform(0.01, 0.99, (mixing.GATES, mixing.BUCKETS))
    m = mixing.MixingModel(None, None, [], [], rng.normal(0.3, 0.1, (mixing.GATES, mixing.INPUTS)).astype(np.float32), refine, np.zeros((8, 6)))
    got = mixing.mixed(i, 2, m)
    assert np.allclose(got, [brute_mixed(i, r, m) for r in (0, 1)], rtol=1e-4)


def test_word_path_probabilities_sum_to_one():
    counts = np.array([50, 20, 9, 3, 1])
    code = mixing.huffman(counts)
    total = 0.0
    for a, b in zip(code.begin[:-1], code.begin[1:]):
        one = 1 / (1 + np.exp(-code.prior[code.node[a:b]].astype(float)))
        total += np.prod(np.where(code.bit[a:b] == 1, one, 1 - one))
    assert abs(total - 1) < 1e-6


def test_known_copies_score_apart(spark):
    rng = np.random.default_rng(8)
    vocab = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(vocab, 120)) for _ in range(120)]
    docs = spark.createDataFrame([*enumerate(texts), (500, texts[3]), (501, " ".join(rng.choice(vocab, 120)))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in mixing.language_model(docs, mixing.F.col("doc_id") < 500).where("doc_id >= 500").collect()}
    assert got[500]["score"] > got[500]["base_score"] * 0.7 and got[501]["score"] < got[500]["score"] * 1.3


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    stages = dict(corpus_pipeline.STAGES)
    named = stages["language"](spark, docs, SMALL)
    assert named.columns == docs.columns and ids(named) == {r["doc_id"] for r in language.identify(docs, language.fit(docs)).where("lang_pred <> 'und' and score >= 0.5").collect()}
    model = toxicity.fit(named, spark.read.parquet(f"{SMALL}/labels.parquet"))
    calm = stages["toxicity"](spark, named, SMALL)
    assert ids(calm) == ids(toxicity.score(named, model).where("predicted = 0"))
    rows = sorted((r["doc_id"], r["text"]) for r in calm.select("doc_id", "text").collect())
    _, root, _ = brute_groups([t for _, t in rows], corpus_pipeline.NEAR)
    unique = stages["near_duplicates"](spark, calm, SMALL)
    assert unique.columns == docs.columns and ids(unique) == {rows[r][0] for r in root}
    held = [(r["doc_id"], r["text"]) for r in unique.collect()]
    cut = stages["repeats"](spark, unique, SMALL)
    removed = {d: g for d, _, g, _, _ in brute_repeats(held, 100)}
    for r in cut.collect():
        before = dict(held)[r["doc_id"]].encode()
        assert len(before) - removed[r["doc_id"]] - 6 <= len(r["text"].encode()) <= len(before) - removed[r["doc_id"]] and r["n_chars"] == len(r["text"])
    packed = stages["packing"](spark, cut, SMALL)
    assert ids(packed) == ids(unique) and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    assert packing.CAPACITY == 2048


def test_mixing_weights_are_fitted_on_all_training_texts(spark, monkeypatch):
    """Every taught text counts in each pass, and the weights are those of one regression over all bits."""
    from domora.llm.toxicity import logistic

    docs, held = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null"), {}
    plain = mixing.fitted
    monkeypatch.setattr(mixing, "fitted", lambda texts, shared: held.update(texts=texts, shared=shared) or held.update(got=plain(texts, shared)) or held["got"])
    taught = (mixing.F.col("doc_id") % 7 > 0) & (mixing.F.length("text") < 3000)
    mixing.language_model(docs, taught)
    assert held["texts"].count() == docs.where(taught & (mixing.F.col("text") != "")).count() > 50
    tree, spelling, tables = held["shared"].value
    m = mixing.MixingModel(tree, spelling, tables[: len(mixing.WORD_BITS)], tables[len(mixing.WORD_BITS) :], *held["got"])
    whole = held["texts"].toArrow().combine_chunks().to_batches()[0]
    i = mixing._own_inputs(whole, m)[0]
    gate = np.repeat(i.gate, np.diff(i.begin))
    best = int(np.bincount(gate, minlength=mixing.GATES).argmax())
    mine = gate == best
    want = logistic(i.x[:, mine].T, i.bit[mine].astype(float), 1.0, 30, False)[0]
    assert np.abs(held["got"][0][best] - want).max() < 0.02
