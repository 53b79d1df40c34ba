"""BPE encoding and decoding of whole texts, with tree concatenation for long unsplit text.

Texts are cut at white space, where no token crosses, and every distinct piece is encoded once per worker
(a memo of bounded size). A piece without white space can be arbitrarily long; its pre-tokens above a limit
are halved down to leaves, the leaves are encoded, and neighbours are joined bottom-up: a window around the cut
is encoded again and grown until it shares a token with both sides. A sequence of tokens in which every adjacent
pair is the encoding of its own text is the encoding of the whole, so the join is exact. In texts above a size
the leaves are rows, which Spark deals to tasks, and the joins are rounds of grouped rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.text import blocks, release, utf8
from domora.session import table

#: Characters of a pre-token above which it is encoded as a tree, and characters of a leaf.
LONG_PIECE = 2048
LEAF = 512
#: First characters of a window on either side of a cut; it doubles until both sides agree.
WINDOW = 32
#: Distinct pieces that a worker remembers.
MEMO = 300_000
#: Bytes of a text above which its parts are encoded by different tasks.
SPLIT_BYTES = 1 << 22
#: Characters of a leaf row of such a text, neighbours that one round joins, and rounds: enough for 2 GB, the longest text that Spark holds.
LEAF_ROW = 1 << 17
FAN = 16
ROUNDS = 4
_SPACE = re.compile(rb"[ \t\n\v\f\r]")


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class TreeEncoder:
    """The encoding of the tokenizers library for a file, special tokens in texts included."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        #: ids of pieces as little-endian unsigned 32-bit integers
        self.memo: dict[bytes, bytes] = {}

    # -- one unbroken piece ------------------------------------------------------------------

    def piece(self, text: str) -> list[int]:
        """Ids of a piece without white space."""
        lib = self.library
        if len(text) <= LONG_PIECE or any(s in text for s in self.special):
            return lib.encode(text, add_special_tokens=False).ids
        whole = lib.normalizer.normalize_str(text) if lib.normalizer else text
        out: list[int] = []
        for part, _ in lib.pre_tokenizer.pre_tokenize_str(whole) if lib.pre_tokenizer else [(whole, None)]:
            out += (self.tree(part) if len(part) > LONG_PIECE else self._tokens(part))[0].tolist()
        return out

    def _tokens(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends in characters) of a pre-token."""
        found = self.library.model.tokenize(part)
        mark = "</w>" if self.library.model.end_of_word_suffix else None
        size = [len(t.value) - (len(mark) if mark and t.value.endswith(mark) else 0) for t in found]
        return np.array([t.id for t in found], np.uint32), np.cumsum(size, dtype=np.int64)

    def tree(self, part: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of a long pre-token: encode halves, then re-encode around the joins."""
        return self.joined([(x, *self._tokens(x)) for x in (part[a : a + LEAF] for a in range(0, len(part), LEAF))])[1:]

    def joined(self, nodes: list[tuple[str, np.ndarray, np.ndarray]]) -> tuple[str, np.ndarray, np.ndarray]:
        """(text, ids, ends) of neighbours in one pre-token, joined in pairs."""
        while len(nodes) > 1:
            nodes = [self._join(x, y) for x, y in zip(nodes[::2], nodes[1::2], strict=False)] + (nodes[-1:] if len(nodes) % 2 else [])
        return nodes[0]

    def _join(self, left: tuple, right: tuple) -> tuple[str, np.ndarray, np.ndarray]:
        (before, ids_a, ends_a), (after, ids_b, ends_b) = left, right
        text, cut, n = before + after, len(before), len(before) + len(after)
        ends_b = ends_b + cut
        size = WINDOW
        while True:
            lo, hi = max(0, cut - size), min(n, cut + size)
            ids, ends = self._tokens(text[lo:hi])
            if lo == 0 and hi == n:
                return text, ids, ends
            ends = ends + lo
            at = {t: i for i, t in enumerate(zip(ids.tolist(), [lo, *ends[:-1].tolist()], ends.tolist(), strict=True))}
            # shared tokens that neither encoding ends with at a cut: the last of the left, the first of the right
            i, keep_a = -1, 0
            if lo > 0:
                first = int(np.searchsorted(ends_a, lo, "right"))  # the first token that ends after lo
                shared = (k for k in range(len(ids_a) - 2, first - 1, -1) if k and ends_a[k - 1] > lo and (int(ids_a[k]), int(ends_a[k - 1]), int(ends_a[k])) in at)
                k = next(shared, None)
                i, keep_a = (None, 0) if k is None else (at[int(ids_a[k]), int(ends_a[k - 1]), int(ends_a[k])], k + 1)
            j, keep_b = len(ids), len(ids_b)
            if hi < n:
                last = int(np.searchsorted(ends_b, hi, "left"))  # tokens that end before hi
                k = next((k for k in range(1, last) if (int(ids_b[k]), int(ends_b[k - 1]), int(ends_b[k])) in at), None)
                j, keep_b = (None, 0) if k is None else (at[int(ids_b[k]), int(ends_b[k - 1]), int(ends_b[k])], k)
            if i is not None and j is not None and i < j:
                return text, np.concatenate([ids_a[:keep_a], ids[i + 1 : j], ids_b[keep_b:]]), np.concatenate([ends_a[:keep_a], ends[i + 1 : j], ends_b[keep_b:]])
            size *= 2

    def units(self, data: bytes, size_of_part: int, size_of_leaf: int) -> Iterator[tuple[int, bytes | None, list[str] | None]]:
        """(leaf, text at white space, pre-tokens) of a long text, in order; a leaf with a number above 0 goes on with the pre-token before it."""
        at = 0
        while at < len(data):
            least = min(len(data), at + size_of_part)
            found = _SPACE.search(data, least)
            part = data[at : found.start() if found else len(data)]
            at += len(part)
            if at - least <= size_of_leaf:
                yield 0, part, None
                continue
            head = part.rsplit(None, 1)
            piece = head[-1].decode()
            if len(head) > 1:
                yield 0, head[0], None
            if any(s in piece for s in self.special):
                yield 0, head[-1], None
                continue
            lib, short, size = self.library, [], 0
            whole = lib.normalizer.normalize_str(piece) if lib.normalizer else piece
            for word, _ in lib.pre_tokenizer.pre_tokenize_str(whole) if lib.pre_tokenizer else [(whole, None)]:
                if short and size + len(word) > size_of_leaf:
                    yield 0, None, short
                    short, size = [], 0
                if len(word) <= size_of_leaf:
                    short.append(word)
                    size += len(word)
                    continue
                for k, a in enumerate(range(0, len(word), size_of_leaf)):
                    yield k, None, [word[a : a + size_of_leaf]]
            if short:
                yield 0, None, short

    # -- whole texts -------------------------------------------------------------------------

    def learn(self, pieces: set[bytes]) -> None:
        """Encode the pieces that the memo lacks."""
        new = [p for p in pieces if p not in self.memo]
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = list(pieces)
        short = [p for p in new if len(p) <= LONG_PIECE]
        for p, e in zip(short, self.library.encode_batch_fast([p.decode() for p in short], add_special_tokens=False), strict=True):
            self.memo[p] = array("I", e.ids).tobytes()
        for p in new:
            if len(p) > LONG_PIECE:
                self.memo[p] = array("I", self.piece(p.decode())).tobytes()

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of texts, whose tokens never cross ASCII white space."""
        cut = [t.split() for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]


@lru_cache(maxsize=2)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


@lru_cache(maxsize=2)
def names(path: str) -> tuple[list[bytes], bool]:
    """(each id's token in UTF-8, whether decoding is joining them with spaces)."""
    lib = encoder(path).library
    return [(lib.id_to_token(i) or "").encode() for i in range(lib.get_vocab_size())], lib.decoder is None


def decode(path: str, ids: np.ndarray) -> bytes:
    """The library's decode(ids, skip_special_tokens=False) in UTF-8."""
    words, plain = names(path)
    if plain:
        return b" ".join(map(words.__getitem__, ids.tolist()))
    return encoder(path).library.decode(ids.tolist(), skip_special_tokens=False).encode()


def _split(docs: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """(encoded short texts, long texts as they are)."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > SPLIT_BYTES

    def run(batches):
        enc = encoder(path)
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            data = raw.tobytes()
            ids = enc.batch([data[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])
        enc.memo = {}
        release()  # the worker lives on for other tasks

    return rows.where(~long).select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary"), rows.where(long)


def _parts(rows: DataFrame, path: str) -> DataFrame:
    """Long texts: parts and leaves in rows of their own, encoded wherever Spark puts them; leaves are joined in rounds, then parts by number."""

    def cut(batches: Iterator[pa.RecordBatch]):
        enc = encoder(path)
        names = ["row", "doc_id", "k", "leaf", "part", "words"]
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            for row, doc, a, b in zip(block.column("row").to_pylist(), block.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                k = -1
                for leaf, part, words in enc.units(raw[a:b].tobytes(), SPLIT_BYTES // 4, LEAF_ROW):
                    k += leaf == 0
                    columns = [([row], pa.int64()), ([doc], pa.int64()), ([k], pa.int32()), ([leaf], pa.int32()), ([part], pa.binary()), ([words], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=names)

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for part, words in zip(batch.column("part").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if words is None:
                    out.append(("", enc.batch([part])[0], b""))
                elif len(words) == 1:
                    ids, ends = enc.tree(words[0])
                    out.append((words[0], ids.tobytes(), ends.tobytes()))
                else:
                    out.append(("", b"".join((enc.tree(w) if len(w) > LONG_PIECE else enc._tokens(w))[0].tobytes() for w in words), b""))
            text, ids, ends = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(text, pa.string()), pa.array(ids, pa.binary()), pa.array(ends, pa.binary())], names=node.replace(",", "").split()[::2])
        enc.memo = {}
        release()

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.sort_values("leaf").head(1).assign(leaf=frame["leaf"].min() // FAN)
        if len(frame) > 1:
            nodes = [(t, np.frombuffer(i, np.uint32), np.frombuffer(e, np.int64)) for _, t, i, e in frame[["leaf", "text", "ids", "ends"]].sort_values("leaf").itertuples(index=False)]
            text, ids, ends = encoder(path).joined(nodes)
            first = first.assign(text=[text], ids=[ids.tobytes()], ends=[ends.astype(np.int64).tobytes()])
        return first

    def glue(batches):
        for batch in batches:
            ids = [b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["k"])) for parts in batch.column("all").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    node = "row long, doc_id long, k int, leaf int, text string, ids binary, ends binary"
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as parts are small for Spark's advisory size but long to encode
    nodes = rows.mapInArrow(cut, "row long, doc_id long, k int, leaf int, part binary, words array<string>").repartition(tasks, "row", "k", "leaf").mapInArrow(run, node)
    for _ in range(ROUNDS):
        nodes = nodes.groupBy("row", "k", F.expr(f"leaf div {FAN}")).applyInPandas(lambda _, frame: join(frame), node)
    # the parts of one text only: a text's ids have to fit a row anyway
    return nodes.groupBy("row", "doc_id").agg(F.collect_list(F.struct("k", "ids")).alias("all")).mapInArrow(glue, "doc_id long, ids binary")


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit) of every text; null and empty texts have none.

    Texts above SPLIT_BYTES are cut into parts at white space, and what has none for long into leaves, which other
    tasks encode; leaves are joined in rounds and the parts of a text put together again by their number. An
    unbroken piece with a special token in it stays one part. Repeated rows stay; only doc_id and text are read. path: a tokenizer file that every executor can read.
    """
    short, long = _split(docs, path)
    return short.unionByName(_parts(long, path))


def digests(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ids and their decoding."""

    def run(batches):
        for block in blocks(batches, "ids", 1 << 22):
            out = [np.frombuffer(x, np.uint32) for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array([len(x) for x in out], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in out]),
                    pa.array([hashlib.sha256(decode(path, x)).hexdigest() for x in out]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op4_bpe_tree(spark, sf_dir):
    path = public_path("word_bpe_49k.json")
    return digests(encoded(table(spark, sf_dir, "documents"), path), path)


