"""Piece encoding and decoding of whole texts by vectorised merge rounds.

A text is cut where no piece of the vocabulary can reach across: before each run of spaces, and beside characters
that no piece holds. The distinct words of a block, but for those a worker remembers, lie in one flat array of
symbols. In each round every word looks up its neighbouring pairs, finds their least rank and merges the leftmost
occurrences of that rank that do not overlap; then the array is compacted, and words without a pair leave it.

Merging all occurrences at once is what one merge at a time would give unless a new pair ranks as low as the one
just merged; words where that happens merge their leftmost occurrence alone in that round. Words of many symbols
take the least rank of a sliding window in place of the whole word's: a merge makes a piece of at most as many
characters as the longest one, so what stands further away than that cannot come between. Long texts are cut into
rows, which Spark deals to tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domora.llm.bpe import MEMO, public_path
from domora.llm.text import blocks, release, utf8
from domora.session import table

SPACE = "▁"
#: Symbols of a word above which ranks are compared in windows instead of the whole word.
LONG_WORD = 512
#: Symbols that are merged at once, and bytes of a text above which its parts are encoded by different tasks.
ROUND_SYMBOLS = 1 << 20
SPLIT_BYTES = 1 << 22
_NONE = np.iinfo(np.int32).max
_SPACED = re.compile(rb" +[^ ]*|[^ ]+")


class PieceTable:
    """The vocabulary as arrays: symbols of characters, ranks of pairs, ids and bytes of pieces."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.vocab_size()
        self.end = lib.eos_id()
        names = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))]
        if any(lib.is_unused(i) for i in plain) or any(SPACE in names[i].lstrip(SPACE) for i in plain):
            raise ValueError("pieces that are unused or hold a space inside are not supported")
        if lib.normalize("Ａ  ﬁ ") != f"{SPACE}Ａ{SPACE}{SPACE}ﬁ{SPACE}":
            raise ValueError("a model that rewrites text, or adds no space before it, is not supported")
        piece = {names[i]: i for i in plain}
        self.longest = max(map(len, piece))
        # symbols: the pieces by id, then characters that only stand inside longer pieces
        extra = sorted({c for p in piece for c in p} - set(piece))
        self.symbols = n + len(extra)
        symbol = piece | {c: n + i for i, c in enumerate(extra)}
        self.char = np.full(0x110000, -1, np.int32)
        for s, i in symbol.items():
            if len(s) == 1:
                self.char[ord(s)] = i
        self.char[32] = self.char[ord(SPACE)]
        scores = {i: lib.get_score(i) for i in plain}
        rank = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pairs = {(symbol[p[:k]], symbol[p[k:]]): i for p, i in piece.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol}
        keys = np.array([a * self.symbols + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        into = np.array(list(pairs.values()), np.int32)[order]
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array([rank[scores[i]] for i in into.tolist()], np.int32), _NONE).astype(np.int32)
        self.into = np.append(into, -1).astype(np.int32)
        self.fallback = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        if (self.fallback == lib.unk_id()).any():
            raise ValueError("a model without byte pieces is not supported")
        #: bytes that stand in no piece: a word can be cut beside them
        held = np.zeros(256, bool)
        held[list({b for p in piece for b in p.replace(SPACE, " ").encode()})] = True
        self.bare = bytes(np.flatnonzero(~held[:128]).tolist())
        #: what a piece says in UTF-8, its space as one
        self.says = [b"" if lib.is_control(i) else bytes([int(names[i][3:5], 16)]) if lib.is_byte(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        #: pieces that decoding treats in ways of their own
        self.silent = np.array([lib.is_control(i) or lib.is_unknown(i) for i in range(n)])
        #: pairs of characters that stand side by side in a piece
        self.inner = {p[k : k + 2].replace(SPACE, " ") for p in piece for k in range(len(p) - 1)}

        # where spaces in a row merge last and from the left, a long run falls into blocks of the longest such piece
        runs = {p: i for p, i in piece.items() if len(p) > 1 and not p.strip(SPACE)}
        last = {rank[scores[i]] for i in runs.values()} == {len(rank) - 1} and not any(p.startswith(SPACE * 2) for p in set(piece) - set(runs))
        self.run = 0
        if last:
            block, own = max(map(len, runs)), runs[max(runs, key=len)].to_bytes(4, "little")
            if all(x.startswith(own) for x in self.words([b" " * m for m in range(block, 2 * block + 1)])):
                self.run = block

    # -- merge rounds ------------------------------------------------------------------------

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of the pairs, _NONE and -1 where there is none."""
        key = a.astype(np.int64) * self.symbols + b
        at = np.searchsorted(self.keys, key)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.into[at], -1)

    def _around(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least of the window before each pair, least of the window that starts with it)."""
        reach = 1 << (2 * self.longest - 1).bit_length()
        padded = np.full(len(rank) + 2 * reach, _NONE, np.int32)
        padded[reach : reach + len(rank)] = rank
        step = 1
        while step < reach:
            padded[:-step] = np.minimum(padded[:-step], padded[step:])
            step *= 2
        return padded[: len(rank)], padded[reach : reach + len(rank)]

    def _chosen(self, rank: np.ndarray, word: np.ndarray, starts: np.ndarray, long: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pairs of the least rank of their word, or of their window in a long word; pairs among them that wait for an equal one before)."""
        least, waits = np.minimum.reduceat(rank, starts)[word], np.zeros(len(rank), bool)
        if long.any():
            rows = np.flatnonzero(long)
            own = rank[rows]
            least[rows] = np.minimum(*self._around(own))
            waits[rows] = self._around(np.where(own == least[rows], _NONE, own))[0] == own
        chosen = (rank == least) & (rank < _NONE)
        if waits.any():  # what stands near a waiting pair waits too
            at = np.flatnonzero(chosen)
            chain = np.append(True, np.diff(at) > 2 * self.longest)
            upto = np.cumsum(waits[at])
            waits[at] = upto > (upto - waits[at])[np.flatnonzero(chain)][np.cumsum(chain) - 1]
        return chosen, waits & chosen

    def merged(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, word, characters of each) once no pair is left. symbols of all words in a row; lengths: of each word, 1 or more."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        chars = np.ones(len(symbols), np.int32)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        last = np.append(word[1:] != word[:-1], True)
        rank, into = self._pairs(symbols, np.append(symbols[1:], -1))
        rank[last] = _NONE
        while len(symbols):
            starts = np.flatnonzero(np.append(True, last[:-1]))
            own = np.cumsum(np.append(False, last[:-1]))
            size = np.diff(np.append(starts, len(symbols)))
            alive = np.minimum.reduceat(rank, starts) < _NONE
            if not alive.all():
                out = ~alive[own]
                done.append((symbols[out], word[out], chars[out]))
                keep = ~out
                symbols, word, chars, rank, into, last = symbols[keep], word[keep], chars[keep], rank[keep], into[keep], last[keep]
                if not len(symbols):
                    break
                starts = np.flatnonzero(np.append(True, last[:-1]))
                own = np.cumsum(np.append(False, last[:-1]))
                size = np.diff(np.append(starts, len(symbols)))
            long = size[own] > LONG_WORD
            chosen, waits = self._chosen(rank, own, starts, long)
            # of overlapping occurrences in a run, every second one
            run_start = chosen & ~np.append(False, chosen[:-1])
            at = np.flatnonzero(chosen)
            begin = np.maximum.accumulate(np.where(run_start, np.arange(len(symbols)), 0))[at]
            at = at[((at - begin) % 2 == 0) & ~waits[at]]
            new = into[at]
            # pairs that the merges make: with the symbol before (merged itself, or not) and the one after as it was
            n = len(symbols)
            before = np.where(at > 0, symbols[at - 1], -1)
            joined = np.append(False, (at[1:] - at[:-1]) == 2) if len(at) else np.zeros(0, bool)
            before = np.where(joined, np.append(-1, new[:-1]), before)
            before = np.where((at > 0) & ~last[at - 1], before, -1)
            after = np.where(at + 2 < n, symbols[np.minimum(at + 2, n - 1)], -1)
            after = np.where(last[at + 1], -1, after)
            soon = np.minimum(self._pairs(before, new)[0], self._pairs(new, after)[0])
            bad = soon <= rank[at]
            if bad.any():
                # only the leftmost occurrence in its word, or window
                wrong = np.zeros(len(size), bool)
                wrong[own[at[bad]]] = True
                gap = 2 * self.longest
                first = np.append(True, (own[at[1:]] != own[at[:-1]]) | (long[at[1:]] & (at[1:] - at[:-1] > gap)))
                at = at[first | ~wrong[own[at]]]
                new = into[at]
            symbols[at] = new
            chars[at] += chars[at + 1]
            last[at] = last[at + 1]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            place = np.cumsum(keep) - 1
            symbols, word, chars, rank, into, last = symbols[keep], word[keep], chars[keep], rank[keep], into[keep], last[keep]
            # only pairs with a merged symbol are new
            spot = place[at]
            touched = np.unique(np.concatenate([spot, spot[spot > 0] - 1]))
            following = np.where(touched + 1 < len(symbols), symbols[np.minimum(touched + 1, len(symbols) - 1)], -1)
            rank[touched], into[touched] = self._pairs(symbols[touched], np.where(last[touched], -1, following))
        if not done:
            return symbols, word, chars
        symbols, word, chars = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(word, kind="stable")
        return symbols[order], word[order], chars[order]

    def words(self, words: list[bytes]) -> list[bytes]:
        """Ids (little-endian unsigned 32-bit) of words in UTF-8; a space stands for the space symbol."""
        out: list[bytes] = []
        for part in _batches(words, ROUND_SYMBOLS):
            codes = np.frombuffer(b"".join(part).decode().encode("utf-32-le"), np.uint32)
            raw = np.frombuffer(b"".join(part), np.uint8)
            ends = np.cumsum([len(w) for w in part])
            upto = np.cumsum((raw & 0xC0) != 0x80)
            lengths = np.diff(np.append(0, upto[ends - 1]))
            symbols, word, chars = self.merged(self.char[codes], lengths)
            plain = (symbols >= 0) & (symbols < len(self.says))
            if plain.all():
                ids, owner = symbols, word
            else:  # characters that are no piece, as their bytes
                first = np.cumsum(chars) - chars
                begin = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
                size = np.where(plain, 1, begin[first + chars] - begin[first])
                ids, owner = np.repeat(symbols, size), np.repeat(word, size)
                inside = np.arange(len(ids)) - np.repeat(np.cumsum(size) - size, size)
                odd = np.repeat(~plain, size)
                ids[odd] = self.fallback[raw[(np.repeat(begin[first], size) + inside)[odd]]]
            data, edges = ids.astype("<u4").tobytes(), np.searchsorted(owner, np.arange(len(part) + 1)) * 4
            out += [data[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        return out


def _batches(words: list[bytes], limit: int) -> Iterator[list[bytes]]:
    part, size = [], 0
    for w in words:
        if part and size + len(w) > limit:
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


class PieceEncoder:
    """Texts to ids and back; words that were met before are looked up."""

    def __init__(self, path: str):
        self.table = PieceTable(path)
        self.memo: dict[bytes, bytes] = {}
        self.line = b"\n" in self.table.bare
        self.run = self.table.run
        self.run_block = b" " * self.run

    def _cut(self, text: bytes) -> list[bytes]:
        """Words of a text whose leading space is there already."""
        out: list[bytes] = []
        for line in text.split(b"\n") if self.line else [text]:
            if out:
                out.append(b"\n")
            if b"  " in line:
                found = _SPACED.findall(line)
                if self.run and self.run_block * 2 in line:
                    found = [x for w in found for x in self._run(w)]
                out += found
                continue
            first, *rest = line.split(b" ")
            if first:
                out.append(first)
            out += [b" " + w for w in rest]
        return out

    def _run(self, word: bytes) -> list[bytes]:
        """A word with the blocks of its leading spaces cut off; two spaces or more stay, as the last can belong to the word."""
        spaces = len(word) - len(word.lstrip(b" "))
        n = max(0, (spaces - 2) // self.run)
        return [self.run_block] * n + [word[n * self.run :]]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Ids of parts of texts in UTF-8, their spaces as they are; the first part of a text starts with the added one."""
        mark = SPACE.encode()
        cut = [self._cut(t.replace(mark, b" ") if mark in t else t) for t in texts]
        new = set().union(*cut).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo = {}
            new = set().union(*cut)
        held = list(new)
        self.memo.update(zip(held, self.table.words(held), strict=True))
        get = self.memo.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def parts(self, text: bytes, size: int) -> Iterator[bytes]:
        """A text with its added space in parts of about that many bytes, cut where no piece reaches across."""
        text = b" " + text.replace(SPACE.encode(), b" ")
        at = 0
        while len(text) - at > size:
            cut = self._place(text, at + size)
            yield text[at:cut]
            at = cut
        yield text[at:]

    def _place(self, text: bytes, at: int) -> int:
        """The first safe cut from a place on; the end, if there is none."""
        while at < len(text):
            upto = min(len(text), at + (1 << 16))
            while upto < len(text) and text[upto] & 0xC0 == 0x80:
                upto += 1
            while at < upto and text[at] & 0xC0 == 0x80:
                at += 1
            # the characters around each place; a pair that stands in no piece is a cut
            around = text[at:upto].decode()
            cut = next((k for k in range(1, len(around)) if around[k - 1 : k + 1] not in self.table.inner), None)
            if cut is not None:
                return at + len(around[:cut].encode())
            if upto == len(text):
                break
            at = upto - len(around[-1].encode()) if len(around) > 1 else upto
        return len(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The library's decode(ids) in UTF-8: the first space goes, the end id is silent, byte pieces are joined."""
        if self.table.silent[ids[:-1] if len(ids) and ids[-1] == self.table.end else ids].any():
            return self.table.library.decode(ids.tolist()).encode()
        said = b"".join(map(self.table.says.__getitem__, ids.tolist()))
        try:
            said.decode()
        except UnicodeDecodeError:  # byte pieces that are no character
            return self.table.library.decode(ids.tolist()).encode()
        return said[1:] if said.startswith(b" ") else said


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit, an end id last) of every text; null and empty texts are the end id alone.

    Texts above SPLIT_BYTES are cut into parts where no piece reaches across; the parts are rows that other tasks
    encode, and are put together again by number. A stretch without any such place stays one part. Repeated rows
    stay, each with its own ids; only doc_id and text are read, an empty table gives an empty one. path: a model file that every executor can read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long = F.octet_length("text") > SPLIT_BYTES

    def short_ids(batches):
        enc = encoder(path)
        end = int(enc.table.end).to_bytes(4, "little")
        for block in blocks(batches):
            raw, offsets = utf8(block.column("text"))
            data = raw.tobytes()
            ids = enc.batch([b" " + data[a:b] if b > a else b"" for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array([x + end for x in ids], pa.binary())], names=["doc_id", "ids"])
        enc.memo = {}
        release()  # the worker lives on for other tasks

    def cut(batches):
        enc = encoder(path)
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c) for c in ("row", "doc_id", "text")), strict=True):
                for k, part in enumerate(enc.parts(text.as_py().encode(), SPLIT_BYTES // 4)):
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([doc.as_py()], pa.int64()), pa.array([k], pa.int32()), pa.array([part], pa.binary())], names=["row", "doc_id", "k", "part"])

    def part_ids(batches):
        enc = encoder(path)
        for batch in batches:
            ids = [enc.batch([p])[0] for p in batch.column("part").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.binary())], names=["row", "doc_id", "k", "ids"])
        enc.memo = {}
        release()

    def glue(batches):
        end = int(encoder(path).table.end).to_bytes(4, "little")
        for batch in batches:
            ids = [b"".join(x["ids"] for x in sorted(parts, key=lambda x: x["k"])) + end for parts in batch.column("all").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, as parts are small for Spark's advisory size but long to encode
    parts = rows.where(long).mapInArrow(cut, "row long, doc_id long, k int, part binary").repartition(tasks, "row", "k").mapInArrow(part_ids, "row long, doc_id long, k int, ids binary")
    # the parts of one text only: a text's ids have to fit a row anyway
    whole = parts.groupBy("row", "doc_id").agg(F.collect_list(F.struct("k", "ids")).alias("all")).mapInArrow(glue, "doc_id long, ids binary")
    return rows.where(~long).select("doc_id", "text").mapInArrow(short_ids, "doc_id long, ids binary").unionByName(whole)


def decoded(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id and ids."""

    def run(batches):
        enc = encoder(path)
        for block in blocks(batches, "ids", 1 << 22):
            said = [enc.decode(np.frombuffer(x, "<u4")).decode() for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(said, pa.string())], names=["doc_id", "text"])

    return ids.select("doc_id", F.coalesce("ids", F.lit(b"")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def digests(ids: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 from ids and their decoding."""

    def run(batches):
        enc = encoder(path)
        decimal = [b"%d" % i for i in range(len(enc.table.says))]
        for block in blocks(batches, "ids", 1 << 22):
            out = [np.frombuffer(x, "<u4") for x in block.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id"),
                    pa.array([len(x) for x in out], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(map(decimal.__getitem__, x.tolist()))).hexdigest() for x in out], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in out], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return ids.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_piece_rounds(spark, sf_dir):
    path = public_path("piece_bpe_32k.model")
    return digests(encoded(table(spark, sf_dir, "documents"), path), path)
