"""Byte-level BPE encoding and decoding in padded numpy matrices.

Words of one length class form a padded matrix of ids. In each round every row
merges its leftmost pair of lowest rank: ranks of all pairs come from a hashed
pair table, and the matrix is compacted by one column. A word of more than LONG
bytes would take rounds by the square of its length, so its pairs wait in a queue
instead, from which they are merged in the same order. Distinct chunks of text are
encoded once for each worker.

Defined results: a null text counts as an empty one; an empty text has no ids;
repeated rows give repeated results; an empty table gives no rows; only doc_id
and text are read, so other columns, whatever their names, don't matter. A long
text is cut at places where the pattern always cuts, never shortened.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
NONE = np.int64(1 << 40)
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
CACHE = 200_000
LONG = 512
#: A single space between characters that aren't white space: the pattern always cuts before it.
CUT = regex.compile(r"(?<=\S) (?=\S)")
IRREGULAR = regex.compile(r" [\s\x1c-\x1f]|[\s\x1c-\x1f] |^ | $")


class PairTable:
    """(left id, right id) -> merged id, by open addressing, for whole arrays at once."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.mask = np.uint64((1 << max(4, (3 * len(left)).bit_length())) - 1)
        self.keys = np.full(int(self.mask) + 1, EMPTY)
        self.vals = np.full(int(self.mask) + 1, NONE)
        key, val = self._key(left, right), merged.astype(np.int64)
        slot = self._slot(key)
        while len(key):
            free = self.keys[slot] == EMPTY
            self.keys[slot[free]] = key[free]
            won = self.keys[slot] == key
            self.vals[slot[won]] = val[won]
            key, val, slot = key[~won], val[~won], (slot[~won] + np.uint64(1)) & self.mask

    @staticmethod
    def _key(left, right):
        return (left.astype(np.uint64) << np.uint64(32)) | (right.astype(np.uint64) & np.uint64(0xFFFFFFFF))

    def _slot(self, key):
        x = key * np.uint64(0x9E3779B97F4A7C15)
        return (x ^ (x >> np.uint64(29))) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merged id of each pair, NONE where there is none. Padding (-1) never merges."""
        key = self._key(left, right).ravel()
        out = np.full(key.shape, NONE)
        slot, at = self._slot(key), np.arange(len(key))
        while len(at):
            seen = self.keys[slot]
            hit = seen == key
            out[at[hit]] = self.vals[slot[hit]]
            on = ~hit & (seen != EMPTY)
            key, slot, at = key[on], (slot[on] + np.uint64(1)) & self.mask, at[on]
        return out.reshape(left.shape)


class Bpe:
    def __init__(self, ranks: dict[bytes, int], pattern: str, width: str = "<u4", cache: int = CACHE):
        self.ranks, self.width, self.limit = ranks, np.dtype(width), cache
        self.pattern = regex.compile(pattern)
        self.tokens: list[bytes] = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.byte = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        pairs = [(a, b, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None]
        left, right, merged = np.array(pairs or [(0, 0, 0)], np.int64).T[:, : len(pairs)]
        self.pairs = PairTable(left, right, merged)
        self.merged: dict[int, int] = {}  # pairs by name, made where a long word needs them
        self.known: dict[str, bytes] = {}

    # -- pieces -----------------------------------------------------------
    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece (a match of the pattern), in padded matrices by length class."""
        out, size = [b""] * len(pieces), self.width.itemsize
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (whole := self.ranks.get(p)) is not None:
                out[i] = whole.to_bytes(size, "little")
            elif len(p) > LONG:
                out[i] = self._queued(p)
            elif p:
                classes.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(i)
        for most, members in classes.items():
            step = max(1, (1 << 19) // most)
            for at in range(0, len(members), step):
                self._matrix(pieces, members[at : at + step], out)
        return out

    def _matrix(self, pieces: list[bytes], members: list[int], out: list[bytes]) -> None:
        rows = np.array(members)
        n = np.array([len(pieces[i]) for i in members])
        width = int(n.max())
        m = np.full((len(rows), width), -1, np.int32)
        m[np.arange(width)[None, :] < n[:, None]] = self.byte[np.frombuffer(b"".join(pieces[i] for i in members), np.uint8)]
        rank = self.pairs.rank(m[:, :-1], m[:, 1:])
        while len(rows):
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NONE)
            on = best < NONE
            ended, size = m[~on].astype(self.width), self.width.itemsize
            raw, step = ended.tobytes(), ended.shape[1] * size
            for i, (row, length) in enumerate(zip(rows[~on].tolist(), n[~on].tolist(), strict=True)):
                out[row] = raw[i * step : i * step + length * size]
            rows, n, m, rank, at, best = rows[on], n[on] - 1, m[on], rank[on], at[on], best[on]
            if not len(rows):
                return
            r, cols = np.arange(len(rows)), np.arange(m.shape[1] - 1)
            m = np.take_along_axis(m, cols + (cols > at[:, None]), 1)
            m[r, at] = best
            cols = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), 1)
            for side in (0, 1):  # only the pairs beside the merged one are new
                p = at - 1 + side
                ok = (p >= 0) & (p < rank.shape[1])
                rank[r[ok], p[ok]] = self.pairs.rank(m[r[ok], p[ok]], m[r[ok], p[ok] + 1])

    def _queued(self, piece: bytes) -> bytes:
        """Ids of one long piece: the pair of lowest rank, the leftmost of equal ones, is merged until none is left."""
        ids = self.byte[np.frombuffer(piece, np.uint8)]
        n, none = len(ids), int(NONE)
        if not self.merged:
            found = self.pairs.keys != EMPTY
            self.merged = dict(zip(self.pairs.keys[found].tolist(), self.pairs.vals[found].tolist(), strict=True))
        rank = [*self.pairs.rank(ids[:-1], ids[1:]).tolist(), none]
        queue = [(r << 32) | i for i, r in enumerate(rank) if r != none]
        heapq.heapify(queue)
        ids, before, behind = ids.tolist(), list(range(-1, n - 1)), list(range(1, n + 1))
        while queue:
            r, i = divmod(heapq.heappop(queue), 1 << 32)
            if rank[i] != r:
                continue  # one of the two has changed since
            gone = behind[i]
            ids[i], ids[gone], rank[gone] = r, -1, none
            nxt = behind[i] = behind[gone]
            if nxt < n:
                before[nxt] = i
            for left, right in ((before[i], i), (i, nxt)):
                if left >= 0:
                    new = rank[left] = self.merged.get((ids[left] << 32) | ids[right], none) if right < n else none
                    if new != none:
                        heapq.heappush(queue, (new << 32) | left)
        return np.array([x for x in ids if x >= 0], self.width).tobytes()

    # -- texts ------------------------------------------------------------
    @staticmethod
    def chunks(text: str) -> list[str]:
        """The text, cut where the pattern cuts whatever stands there."""
        if not text:
            return []
        parts = CUT.split(text) if IRREGULAR.search(text) else text.split(" ")
        return [parts[0], *[" " + x for x in parts[1:]]]

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian bytes of the codec's width."""
        cut = [self.chunks(t or "") for t in texts]
        new = list({c for chunks in cut for c in chunks if c not in self.known})
        if len(self.known) + len(new) > self.limit:
            here = {c for chunks in cut for c in chunks}
            self.known = {c: x for c, x in self.known.items() if c in here}
        found = [self.pattern.findall(c) for c in new]
        pieces = list({p for x in found for p in x})
        ids = dict(zip(pieces, self.merge([p.encode() for p in pieces]), strict=True))
        self.known.update(zip(new, (b"".join(map(ids.__getitem__, x)) for x in found), strict=True))
        return [b"".join(map(self.known.__getitem__, chunks)) for chunks in cut]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, self.width).tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file with lines of `base64 rank`, read on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def vocabulary(path: str | None = None) -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return read_ranks(path or public_tokenizers.path(RANKS)), public_tokenizers.PATTERN


_CODECS: dict[tuple, Bpe] = {}


def digest(ranks: dict[bytes, int], pattern: str = "") -> str:
    """What tells one vocabulary and pattern from another."""
    h = hashlib.sha256(pattern.encode())
    for token, rank in ranks.items():
        h.update(b"%d %d " % (rank, len(token)) + token)
    return h.hexdigest()


def codec(ranks: dict[bytes, int], pattern: str, width: str, key: str) -> Bpe:
    """One codec for each worker process, reused by its later tasks with the same vocabulary; key: its digest."""
    if (key, width) not in _CODECS:
        _CODECS.clear()
        _CODECS[key, width] = Bpe(ranks, pattern, width)
    return _CODECS[key, width]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """id, ids (binary, little-endian 32 bits), decoded (binary) of every row.

    The vocabulary is read on the driver and broadcast: its size is that of the
    file (about 50,000 entries), whatever the number of documents.
    """
    ranks, pattern = vocabulary(path)
    sent, key = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), digest(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = codec(*sent.value, "<u4", key)
        for batch in common.by_size(batches, 1):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            yield {"id": batch.column(0), "ids": ids, "decoded": [bpe.decode(x) for x in ids]}

    return common.arrow_map(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")), run, "id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; digests are made where the ids are."""
    ranks, pattern = vocabulary(path)
    sent, key = docs.sparkSession.sparkContext.broadcast((ranks, pattern)), digest(ranks, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = codec(*sent.value, "<u4", key)
        for batch in common.by_size(batches, 1):
            ids = bpe.encode_batch(batch.column(1).to_pylist())
            yield {
                "doc_id": batch.column(0),
                "n_tokens": [len(x) // 4 for x in ids],
                "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                "decoded_sha256": [hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids],
            }

    return common.arrow_map(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32 bits), decoded_sha256 of every row of docs."""
    out = encode(docs)
    return out.select(out["id"].alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(common.documents(spark, sf_dir))
