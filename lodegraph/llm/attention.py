"""Scores of texts by a small causal self-attention model, and by word counts.

The model reads subword ids: words, lower-cased in A-Z, cut by the first ranks of
a byte-level BPE vocabulary, and one end for each text. A text is read in windows
that score STEP ids each and overlap by CONTEXT, so that each id is scored once,
with CONTEXT ids before it at least (ends, before the text's first). Windows go
through one masked attention layer in batches; the next id is predicted in two
softmax steps of FAN, its class and then itself, so a score is a proper probability.

Learning covers the whole training part: word counts and, from them, subword
frequencies over all of it; and gradient steps on every document, which are dealt
over ROUNDS rounds: in each, every partition trains its own copy from the common
weights, and the copies are averaged by the windows they saw, level by level.

The base score sums over words. Counts of the most frequent words, FREQUENT at most,
are broadcast (a fixed bound); other words are joined by a shuffle.

Words are cut in Arrow, and what a word gives (ids, logarithm of its count) is made once
for the rows of a batch. Ids are stored, so that training and scoring read no text.

Defined results: a null text counts as an empty one and has one token, the end;
rows without a doc_id train and are not held out; repeated rows give repeated
results; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import bpe, common

FAN = 32
VOCABULARY = FAN**2  # the last id is the end
END = VOCABULARY - 1
WIDTH, HIDDEN = 8, 24
STEP, CONTEXT = 24, 8
WINDOW = STEP + CONTEXT
BATCH, BLOCK = 96, 192  # windows of a gradient step, and scored at once: what stays in the processor's cache
ROUNDS, RATE = 4, 0.02
FREQUENT = 100_000
KEPT = 300_000  # words whose ids a worker keeps; more take memory
AT_ONCE = 2_000_000  # words that a task counts before it hands the counts on
#: No logit counts beyond this, so exponentials stay finite without a search for the largest.
LIMIT = np.float32(40)
ONES = np.ones((max(FAN, WINDOW), 1), np.float32)
END_WORD = b"\n"  # no word holds white space, so this names the end


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").lower().split() if text else []


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, as words_of() makes them, and where each text's words end among them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves empty ones
    ends = np.cumsum(np.append(0, np.asarray(real)))[np.cumsum(pc.list_value_length(lists))]
    return words.filter(real).cast(pa.binary()), ends


class Subwords:
    """Words to ids: the vocabulary's first ranks, then renumbered so that a class holds tokens of like beginnings.

    Ids of new words are most of the work on text with many words, so the library's merges make them,
    and up to KEPT words keep theirs from batch to batch.
    """

    def __init__(self, ranks: dict[bytes, int]):
        kept = {t: r for t, r in ranks.items() if r < END}
        order = sorted(kept, key=lambda t: (not t.startswith(b" "), t))
        self.codec = tiktoken.Encoding("subwords", pat_str=" [^ ]+", mergeable_ranks=kept, special_tokens={})
        self.renumber = np.full(VOCABULARY, END, "<u2")
        self.renumber[[kept[t] for t in order]] = np.arange(len(order))
        self.openers = sum(t.startswith(b" ") for t in order)  # ids below this begin a word, and no others do
        self.forget()

    def cut(self, words: list[bytes]) -> np.ndarray:
        """Ids of words, one word behind the other."""
        return self.renumber[self.codec.encode_to_numpy((b" " + b" ".join(words)).decode())] if words else self.renumber[:0]

    def encode(self, texts: list[list[bytes]]) -> list[np.ndarray]:
        """Ids of lists of words, which may close with END_WORD."""
        out = []
        for ws in texts:
            closed = ws[-1:] == [END_WORD]
            ids = self.cut(ws[:-1] if closed else ws)
            out.append(np.append(ids, np.uint16(END)).astype("<u2") if closed else ids)
        return out

    def forget(self) -> None:
        """Words met so far: none but the end."""
        self.place, self.flat, self.starts, self.sizes = {END_WORD: 0}, np.array([END], "<u2"), np.zeros(1, int), np.ones(1, int)

    def by_word(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words met so far, one behind the other; where those of the given (distinct) words begin, and how many each has."""
        if len(self.place) > KEPT:
            self.forget()
        place = np.fromiter(map(self.place.get, words, repeat(-1)), int, len(words))
        at = np.flatnonzero(place < 0)
        if len(at):
            new, place[at] = words[at].tolist(), np.arange(len(at)) + len(self.starts)
            self.place.update(zip(new, place[at].tolist(), strict=True))
            ids = self.cut(new)
            starts = np.flatnonzero(ids < self.openers)
            self.starts, self.sizes = np.append(self.starts, starts + len(self.flat)), np.append(self.sizes, np.diff(np.append(starts, len(ids))))
            self.flat = np.append(self.flat, ids).astype("<u2")
        return self.flat, self.starts[place], self.sizes[place]


class Windows:
    """The windows of texts (arrays of ids that end with END), made block by block."""

    def __init__(self, texts: list[np.ndarray]):
        n = np.array([len(x) for x in texts])
        self.counts = -(-n // STEP)
        lead, tail = np.full(CONTEXT + 1, END, "<u2"), np.full(STEP, END, "<u2")
        self.flat = np.concatenate([y for x in texts for y in (lead, x, tail)])
        starts = np.cumsum(n + len(lead) + len(tail)) - n - len(lead) - len(tail)
        step = np.arange(self.counts.sum()) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        self.start = np.repeat(starts, self.counts) + step * STEP
        self.valid = np.minimum(np.repeat(n, self.counts) - step * STEP, STEP)
        self.rows = np.lib.stride_tricks.sliding_window_view(self.flat, WINDOW + 1)

    def __len__(self) -> int:
        return len(self.start)

    def block(self, which) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets, scored) of some windows: the last STEP inputs predict the targets."""
        rows = self.rows[self.start[which]]
        return rows[:, :-1], rows[:, CONTEXT + 1 :], np.arange(STEP) < self.valid[which][:, None]


class Model:
    """Weights by name, and the passes. All arrays are float32.

    The mixing layer's last row and the last hidden unit, which is always 1, are the biases.
    """

    SHAPES = {
        "embed": (VOCABULARY, WIDTH), "attend": (WIDTH, 3 * WIDTH), "distance": (WINDOW,),
        "mix": (2 * WIDTH + 1, HIDDEN), "top": (HIDDEN, FAN), "leaf": (FAN, HIDDEN, FAN),
    }
    SIZE = sum(math.prod(s) for s in SHAPES.values())
    #: How far each scored place looks back, and where it may look.
    GAP = np.arange(CONTEXT, WINDOW)[:, None] - np.arange(WINDOW)
    SEEN = GAP >= 0
    LOOKS, GAPS = np.flatnonzero(SEEN), GAP[SEEN]

    def __init__(self, flat: np.ndarray):
        self.flat = np.array(flat, np.float32)
        self.w = self.named(self.flat)
        self.room: dict[tuple, np.ndarray] = {}
        self.tables: tuple[np.ndarray, ...] | None = None

    @classmethod
    def named(cls, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Views of a flat array, by weight."""
        out, at = {}, 0
        for name, shape in cls.SHAPES.items():
            out[name] = flat[at : at + math.prod(shape)].reshape(shape)
            at += math.prod(shape)
        return out

    @classmethod
    def start(cls, frequency: np.ndarray) -> Model:
        """Seeded weights; the biases are the log frequencies of the training part's subwords."""
        m, rng = cls(np.zeros(cls.SIZE)), np.random.default_rng(11)
        for name, scale in (("embed", 0.5), ("attend", WIDTH**-0.5), ("mix", (2 * WIDTH) ** -0.5), ("top", 0.1), ("leaf", 0.1)):
            m.w[name][:] = rng.standard_normal(cls.SHAPES[name]) * scale
        m.w["attend"][:, :WIDTH] *= WIDTH**-0.5
        m.w["mix"][-1] = 0
        f = (np.asarray(frequency, float) + 0.1).reshape(FAN, FAN)
        m.w["top"][-1] = np.log(f.sum(1) / f.sum())
        m.w["leaf"][:, -1] = np.log(f / f.sum(1, keepdims=True))
        return m

    def space(self, name: str, many: int, *shape: int) -> np.ndarray:
        """Working memory that the next batch uses again: fresh pages cost more than the sums."""
        key = (name, *shape)
        if key not in self.room or len(self.room[key]) < many:
            self.room[key] = np.empty((many, *shape), np.float32)
        return self.room[key][:many]

    def copy(self, name: str, x: np.ndarray) -> np.ndarray:
        """x in working memory, without gaps."""
        out = self.space(name, *x.shape)
        out[:] = x
        return out

    def looks(self, q, columns, limit: bool) -> np.ndarray:
        """Exponentials of the scored places' attention, before division by their sums; keys lie by column, which small products want."""
        a = np.matmul(q, columns, out=self.space("a", len(q), STEP, WINDOW))
        a += np.where(self.SEEN, self.w["distance"][np.maximum(self.GAP, 0)], np.float32(-1e9))
        return self.exp(a, limit)

    @staticmethod
    def exp(x: np.ndarray, limit: bool) -> np.ndarray:
        return np.exp(np.minimum(x, LIMIT, out=x) if limit else x, out=x)

    @staticmethod
    def parts(group: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, from, to) of places in the order of their classes."""
        ends = np.searchsorted(group, np.arange(FAN + 1)).tolist()
        return [(g, i, j) for g, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if i < j]

    def score(self, inputs: np.ndarray, targets: np.ndarray, limit: bool = False) -> np.ndarray:
        """Natural log probability of each target, in the shape of the targets."""
        w, n, space = self.w, targets.size, self.space
        if self.tables is None:  # what an id alone adds, for all ids; scores are made when training is over
            self.tables = w["embed"] @ w["attend"], w["embed"] @ w["mix"][:WIDTH] + w["mix"][-1]
        t = targets.reshape(-1)
        order = np.argsort((t // FAN).astype(np.uint8), kind="stable")
        t = t[order].astype(np.intp)
        ids, group, row = inputs.astype(np.intp), t // FAN, np.arange(n) * FAN
        place = t - group * FAN
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            both = np.take(self.tables[0], ids, axis=0, out=space("both", len(ids), WINDOW, 3 * WIDTH), mode="clip")
            a = self.looks(both[:, CONTEXT:, :WIDTH], self.copy("columns", both[:, :, WIDTH : 2 * WIDTH].transpose(0, 2, 1)), limit)
            c = np.matmul(a, both[:, :, 2 * WIDTH :], out=space("c", len(a), STEP, WIDTH)).reshape(n, WIDTH)
            c /= a.reshape(n, WINDOW) @ ONES[:WINDOW]
            # from here on, places stand in the order of their targets' classes
            h = np.take(self.tables[1], ids[:, CONTEXT:].reshape(-1)[order], axis=0, out=space("h", n, HIDDEN), mode="clip")
            h += np.matmul(np.take(c, order, axis=0, out=space("cs", n, WIDTH), mode="clip"), w["mix"][WIDTH:-1], out=space("hc", n, HIDDEN))
            np.maximum(h, 0, out=h)
            h[:, -1] = 1
            p = space("p", 2 * n, FAN)  # the first step's logits, then the second's
            np.matmul(h, w["top"], out=p[:n])
            for g, i, j in self.parts(group):
                np.dot(h[i:j], w["leaf"][g], out=p[n + i : n + j])
            sums, p = (self.exp(p, limit) @ ONES[:FAN]).reshape(2, n), p.reshape(2, -1)
            got = p[0][row + group] / sums[0] * (p[1][row + place] / sums[1])
            if not limit and not (got > 0).all():  # some exponential was beyond what a float holds
                return self.score(inputs, targets, True)
        out = np.empty(n, np.float32)
        out[order] = np.log(np.maximum(got, np.float32(1e-37)))
        return out.reshape(targets.shape)

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, scored: np.ndarray, limit: bool = False) -> tuple[float, np.ndarray]:
        """Mean loss of the scored targets and its gradient by all weights.

        Scored places stand in the order of their targets' classes. What is WIDTH wide lies by
        column (its arrays end in T), so that sums and quotients by place run over long rows;
        hidden units and logits lie by row, which makes the products faster.
        """
        w, flat, many, space = self.w, self.space("gradient", self.SIZE), len(inputs), self.space
        g, ids, places = self.named(flat), inputs.astype(np.intp), many * STEP
        at = np.flatnonzero(scored)
        t = targets.reshape(-1)[at]
        order = np.argsort((t // FAN).astype(np.uint8), kind="stable")
        at, t = at[order], t[order].astype(np.intp)
        n, group = len(at), t // FAN
        parts, row = self.parts(group), np.arange(n) * FAN
        right = np.concatenate([row + group, row + (t - group * FAN + n * FAN)])
        self.tables = None
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            x = np.take(w["embed"], ids, axis=0, out=space("rows", many, WINDOW, WIDTH), mode="clip")
            xT = self.copy("x", x.transpose(2, 0, 1))
            bothT = np.matmul(w["attend"].T, xT.reshape(WIDTH, -1), out=space("both2", 3 * WIDTH * many * WINDOW).reshape(3 * WIDTH, -1)).reshape(-1, many, WINDOW)
            qT, kT = bothT[:WIDTH, :, CONTEXT:].transpose(1, 0, 2), bothT[WIDTH : 2 * WIDTH].transpose(1, 0, 2)
            vT = space("v", WIDTH + 1, many, WINDOW)
            vT[:-1], vT[-1] = bothT[2 * WIDTH :], 1
            vT = vT.transpose(1, 0, 2)
            a = self.looks(qT.transpose(0, 2, 1), kT, limit)
            cT = space("c", WIDTH + 1, many, STEP)  # by the sums of the exponentials, which come last
            np.matmul(vT, a.transpose(0, 2, 1), out=cT.transpose(1, 0, 2))
            share = 1 / cT[-1]
            xsT = space("all", 2 * WIDTH + 1, many, STEP)
            xsT[:WIDTH], xsT[-1] = xT[:, :, CONTEXT:], 1
            cT = np.multiply(cT[:-1], share, out=xsT[WIDTH:-1])
            xs = np.take(self.copy("all2", xsT.reshape(-1, places).T), at, axis=0, out=space("xs", n, 2 * WIDTH + 1), mode="clip")
            h = np.matmul(xs, w["mix"], out=space("h2", n, HIDDEN))
            np.maximum(h, 0, out=h)
            h[:, -1] = 1
            p = space("p2", 2 * n, FAN).reshape(2, n, FAN)  # the first step's logits, then the second's
            top, leaf = p
            np.matmul(h, w["top"], out=top)
            for b, i, j in parts:
                np.dot(h[i:j], w["leaf"][b], out=leaf[i:j])
            self.exp(p, limit)
            sums = p.reshape(-1, FAN) @ ONES[:FAN]
            loss = float(np.log(sums[:, 0] / p.reshape(-1)[right]).sum(dtype=np.float64))
        if not limit and not math.isfinite(loss):
            return self.gradient(inputs, targets, scored, True)
        p *= (1 / sums).reshape(2, n, 1)
        p.reshape(-1)[right] -= 1
        np.matmul(h.T, top, out=g["top"])
        dh = np.matmul(top, w["top"].T, out=space("dh", n, HIDDEN))
        back = space("back", n, HIDDEN)
        g["leaf"][:] = 0
        for b, i, j in parts:
            np.dot(h[i:j].T, leaf[i:j], out=g["leaf"][b])
            np.dot(leaf[i:j], w["leaf"][b].T, out=back[i:j])
        dh += back
        dh *= h > 0
        dh[:, -1] = 0
        np.matmul(xs.T, dh, out=g["mix"])
        dxs = space("dxs", n + 1, 2 * WIDTH + 1)
        np.matmul(dh, w["mix"].T, out=dxs[:n])
        dxs[n], where = 0, np.full(places, n)
        where[at] = np.arange(n)
        dxs = np.take(dxs, where, axis=0, out=space("dall", places, 2 * WIDTH + 1), mode="clip")
        dxsT = self.copy("dxsT", dxs[:, :-1].T).reshape(2 * WIDTH, many, STEP)  # by window again
        dcT = space("dc", WIDTH + 1, many, STEP)
        np.multiply(dxsT[WIDTH:], share, out=dcT[:-1])  # so the exponentials need no division
        np.negative((dcT[:-1] * cT).sum(0), out=dcT[-1])
        dcT = dcT.transpose(1, 0, 2)
        da = np.matmul(dcT.transpose(0, 2, 1), vT, out=space("da", many, STEP, WINDOW))
        da *= a
        g["distance"][:] = np.bincount(self.GAPS, da.sum(0).reshape(-1)[self.LOOKS], WINDOW)
        dbothT = space("dboth", 3 * WIDTH, many, WINDOW)
        dbothT[:WIDTH, :, :CONTEXT] = 0
        np.matmul(kT, da.transpose(0, 2, 1), out=dbothT[:WIDTH, :, CONTEXT:].transpose(1, 0, 2))
        np.matmul(qT, da, out=dbothT[WIDTH : 2 * WIDTH].transpose(1, 0, 2))
        np.matmul(dcT[:, :-1], a, out=dbothT[2 * WIDTH :].transpose(1, 0, 2))
        dbothT = dbothT.reshape(3 * WIDTH, -1)
        np.matmul(xT.reshape(WIDTH, -1), dbothT.T, out=g["attend"])
        dxT = np.matmul(w["attend"], dbothT, out=space("dx", WIDTH * many * WINDOW).reshape(WIDTH, -1))
        dxT.reshape(WIDTH, many, WINDOW)[:, :, CONTEXT:] += dxsT[:WIDTH]
        taken = ids.reshape(-1)
        for i in range(WIDTH):
            g["embed"][:, i] = np.bincount(taken, dxT[i], VOCABULARY)
        flat *= np.float32(1 / n)
        return loss / n, flat


class Trainer:
    """Adam on batches of windows."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate = model, rate
        self.m, self.v, self.t = np.zeros(Model.SIZE, np.float32), np.zeros(Model.SIZE, np.float32), 0

    def step(self, batch) -> float:
        """m and v are sums that decay by 0.9 and 0.99: ten times the mean of gradients, a hundred times that of their squares."""
        loss, g = self.model.gradient(*batch)
        self.t += 1
        self.m *= np.float32(0.9)
        self.m += g
        np.multiply(g, g, out=g)
        self.v *= np.float32(0.99)
        self.v += g
        rate = self.rate * min(1.0, self.t / 20) * math.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        np.sqrt(self.v, out=g)
        g += np.float32(1e-6)
        np.divide(self.m, g, out=g)
        g *= np.float32(rate)
        self.model.flat -= g
        return loss

    def learn(self, texts: list[np.ndarray]) -> int:
        """A step for every BATCH windows of the texts, which are taken in a seeded random order; how many windows there were."""
        all_ = Windows(texts)
        order = np.random.default_rng(len(all_)).permutation(len(all_))
        for i in range(0, len(order), BATCH):
            self.step(all_.block(order[i : i + BATCH]))
        return len(all_)


def score_texts(model: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text."""
    all_ = Windows(texts)
    sums = np.empty(len(all_))
    for i in range(0, len(all_), BLOCK):
        inputs, targets, scored = all_.block(slice(i, i + BLOCK))
        sums[i : i + BLOCK] = (model.score(inputs, targets) * scored).sum(1, dtype=np.float64)
    return np.add.reduceat(sums, np.cumsum(all_.counts) - all_.counts) / math.log(10)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, c over all the rows given; the end is a word too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def out(words: list[pa.Array], rows: int) -> Iterator[dict]:
            if words:
                sums = pc.value_counts(pa.chunked_array(words, pa.binary()))
                for i in range(0, len(sums), 50_000):
                    part = sums.slice(i, 50_000)
                    yield {"word": part.field(0), "c": part.field(1)}
            if rows:
                yield {"word": [END_WORD], "c": [rows]}

        held, rows = [], 0
        for batch in common.by_size(batches, 1):
            held.append(split(batch.column(1))[0])
            rows += batch.num_rows
            if sum(map(len, held)) > AT_ONCE:
                yield from out(held, rows)
                held, rows = [], 0
        yield from out(held, rows)

    return common.arrow_map(docs, run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def spread(counts: DataFrame) -> tuple[int, int, int]:
    """Tokens, distinct words, and the least count whose words, with all more frequent ones, are FREQUENT at most.

    From how many words have each count, so the driver gets no words. Words of equal count are all frequent or none.
    """
    tokens = distinct = 0
    least = None
    for r in counts.groupBy("c").agg(F.count("*").alias("words")).orderBy(F.desc("c")).collect():
        tokens, distinct = tokens + r.c * r.words, distinct + r.words
        if distinct <= FREQUENT:
            least = r.c
    return tokens, distinct, tokens + 1 if least is None else least


def subword_frequency(counts: DataFrame, ranks: dict[bytes, int]) -> np.ndarray:
    """How often each id occurs in the training part, from its word counts: VOCABULARY sums."""
    sent = counts.sparkSession.sparkContext.broadcast((ranks, bpe.digest(ranks)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sub, sums = subwords(*sent.value), np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if END_WORD in words:
                at = words.index(END_WORD)
                sums[END] += n[at]
                del words[at]
                n = np.delete(n, at)
            ids = sub.cut(words)
            sums += np.bincount(ids, n[np.cumsum(ids < sub.openers) - 1], VOCABULARY).astype(np.int64)
        yield {"id": np.arange(VOCABULARY), "n": sums}

    out = np.zeros(VOCABULARY)
    for r in common.arrow_map(counts.select("word", "c"), run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


_SUB: dict[str, Subwords] = {}


def subwords(ranks: dict[bytes, int], key: str) -> Subwords:
    """One for each worker process and vocabulary; key: its digest."""
    if key not in _SUB:
        _SUB.clear()
        _SUB[key] = Subwords(ranks)
    return _SUB[key]


def averaged(copies: DataFrame) -> np.ndarray | None:
    """The mean of (n, weights) rows, weighted by n; rows meet 32 at a time, so a task and the driver hold few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, n = None, 0
        for batch in batches:
            for k, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total, n = (0 if total is None else total) + k * np.frombuffer(w, np.float32).astype(float), n + k
        if n:
            yield {"n": [n], "w": [(total / n).astype(np.float32).tobytes()]}

    copies = common.stored(copies, "weights")
    while (parts := copies.count()) > 32:
        copies = common.stored(common.arrow_map(copies.repartition(-(-parts // 32)), run, "n long, w binary"), "weights")
    rows = copies.collect()
    n = sum(r.n for r in rows)
    return sum(r.n * np.frombuffer(r.w, np.float32).astype(float) for r in rows) / n if n else None


def place(rounds: int):
    """The round that trains on a row; every row has just one."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds))


def of_round(docs: DataFrame, r: int, rounds: int) -> DataFrame:
    """The rows that round r trains on."""
    return docs.where(place(rounds) == r)


def encoded(docs: DataFrame, ranks: dict[bytes, int], frequent: dict[bytes, int], rounds: int = ROUNDS) -> DataFrame:
    """For every row: its ids and round of training, tokens, and the base sums of frequent words; other words are listed."""
    sent = docs.sparkSession.sparkContext.broadcast((ranks, bpe.digest(ranks), list(frequent), np.log10(np.array([*frequent.values(), 0]) + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        ranks, key, frequent, logs = sent.value  # no logarithm of a count and one is zero, but for the last, which is for other words
        sub, frequent = subwords(ranks, key), pa.array(frequent, pa.binary())
        for batch in common.by_size(batches, 1, 8 << 20):
            words, ends = split(batch.column(1))
            words = words.dictionary_encode()
            distinct = pa.concat_arrays([words.dictionary, pa.array([END_WORD], pa.binary())])
            code = np.insert(np.asarray(words.indices), ends, len(distinct) - 1)
            names, ends = distinct.to_numpy(zero_copy_only=False), ends + np.arange(1, len(ends) + 1)
            begins = np.append(0, ends[:-1])
            found = logs[np.asarray(pc.fill_null(pc.index_in(distinct, frequent), len(frequent)))][code]
            rare = np.flatnonzero(found == 0)
            known = ends - begins - np.diff(np.searchsorted(rare, np.append(0, ends)))
            listed = pa.ListArray.from_arrays(np.searchsorted(rare, np.append(0, ends)).astype(np.int32), distinct.take(pa.array(code[rare])))
            # ids
            flat, starts, sizes = sub.by_word(names)
            many = sizes[code]
            to = np.cumsum(many)
            at = np.repeat(starts[code] - to + many, many)
            at += np.arange(len(at))  # in place: this is the longest array here
            ids = flat[at]
            yield {
                "doc_id": batch.column(0), "round": batch.column(2), "n_tokens": ends - begins, "known": known, "rare": listed,
                "base": [found[i:j].sum() for i, j in zip(begins.tolist(), ends.tolist(), strict=True)],
                "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(np.append(0, 2 * to[ends - 1])), pa.py_buffer(ids)]),
            }

    rows = docs.select("doc_id", "text", place(rounds).cast("int").alias("round"))
    return common.arrow_map(rows, run, "doc_id long, round int, n_tokens long, known long, rare array<binary>, base double, ids binary")


def arrays(ids: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u2") for x in ids]


def train(docs: DataFrame, ranks: dict[bytes, int], frequency: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights after `rounds` of training on documents (doc_id, text)."""
    return train_encoded(encoded(docs, ranks, {}, rounds), frequency, rounds)


def train_encoded(rows: DataFrame, frequency: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Weights after `rounds` of local training, which take in every row of encoded() once, and averaging."""
    model = Model.start(frequency)
    for r in range(rounds):
        sent = rows.sparkSession.sparkContext.broadcast((model.flat, RATE / (1 + r)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[dict]:
            flat, rate = sent.value
            trainer, seen = Trainer(Model(flat), rate), 0
            for batch in common.by_size(batches, 0, 1 << 20):
                seen += trainer.learn(arrays(batch.column(0)))
            if seen:
                yield {"n": [seen], "w": [trainer.model.flat.tobytes()]}

        mean = averaged(common.arrow_map(rows.where(F.col("round") == r).select("ids"), run, "n long, w binary"))
        if mean is not None:
            model = Model(mean)
    return model


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """The model's score of every row of encoded()."""
    sent = rows.sparkSession.sparkContext.broadcast(model.flat)
    rows = rows.drop("rare", "round")
    at = rows.columns.index("ids")
    kept = [(i, f) for i, f in enumerate(rows.schema.fields) if i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = Model(sent.value)
        for batch in common.by_size(batches, at, 1 << 20):
            yield {"score": score_texts(model, arrays(batch.column(at)))} | {f.name: batch.column(i) for i, f in kept}

    return common.arrow_map(rows, run, StructType([*(f for _, f in kept), StructField("score", DoubleType())]))


def score_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    ranks = bpe.vocabulary(path)[0]
    ranks = {t: r for t, r in ranks.items() if r < END}
    out = common.held_out("doc_id", 7, 2)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    training = rows.where(~out)
    counts = common.stored(word_counts(training), "words")
    tokens, distinct, least = spread(counts)
    frequent = {bytes(r.word): r.c for r in counts.where(F.col("c") >= least).collect()}
    known = common.stored(encoded(rows, ranks, frequent).withColumn("rid", F.monotonically_increasing_id()), "ids")
    model = train_encoded(known.where(~out), subword_frequency(counts, ranks))
    scored = common.stored(scores(known, model), "scores")
    # words beyond the frequent ones are joined to their counts
    rare = known.select("rid", F.explode("rare").alias("word"))
    rest = rare.join(counts, "word").groupBy("rid").agg(F.sum(F.log10(F.col("c") + 1)).alias("more"), F.count("*").alias("n"))
    both = scored.join(rest, "rid", "left")
    total = math.log10(tokens + distinct + 1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    return both.select(
        "doc_id", out.alias("held_out"), "n_tokens", (F.col("known") + zero(F.col("n"))).cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero(F.col("more")) - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(common.documents(spark, sf_dir))
