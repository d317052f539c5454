"""Near copies, repeated strings, scores by the language model, and the pipeline, against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lodegraph.llm import attention, bpe, common, dartminhash, shingles, suffixdedup

SCHEMA = "doc_id long, text string, k string, th long, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], SCHEMA)


# -- DartMinHash ---------------------------------------------------------------


@pytest.mark.parametrize("n", [3, 40, 600])
@pytest.mark.parametrize("share", [0.3, 0.8])
def test_signatures_estimate_jaccard(n, share):
    rng = np.random.default_rng(n)
    k = round(2 * n * share / (1 + share))
    a = rng.integers(0, 2**63, (60, 2 * n - k)).astype(np.uint64)
    sets = [x for row in a for x in (row[:n], row[n - k :])]
    sig = dartminhash.signatures(np.concatenate(sets), np.repeat(np.arange(120), n), 120, 200)
    assert abs((sig[::2] == sig[1::2]).mean() - k / (2 * n - k)) < 0.03
    assert (sig != np.iinfo(np.uint64).max).all()


def test_signatures_of_weighted_sets():
    rng, found = np.random.default_rng(7), []
    for _ in range(80):
        e, w = rng.integers(0, 2**63, 50).astype(np.uint64), rng.random((2, 50)) * 3
        s = dartminhash.signatures(np.tile(e, 2), np.repeat([0, 1], 50), 2, 200, w.reshape(-1))
        found.append((s[0] == s[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum())
    assert abs(np.mean(found)) < 0.02


def plain_groups(rows):
    sets = [(i, Counter(shingles.sequence(t).tolist())) for i, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and (x & y).total() >= 0.8 * (x | y).total():
                up[max(top(a), top(b))] = min(top(a), top(b))
    low = {}
    for a, (i, _) in enumerate(rows):
        if i is not None:
            low[top(a)] = min(low.get(top(a), i), i)
    return sorted((i if i is not None else -1, low.get(top(a), -1)) for a, (i, _) in enumerate(rows))


@pytest.mark.parametrize("small", [False, True])
def test_groups_equal_all_pairs(spark, small, monkeypatch):
    if small:  # many blocks and deals for each bucket; lambdas take these values along, settle() in the workers doesn't need to
        monkeypatch.setattr(dartminhash, "DEALT", 500)
        monkeypatch.setattr(dartminhash, "BLOCK", 300)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([6, 60, 200]))]
        for _ in range(rng.choice([1, 5, 40])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 3, 6])):
                t[rng.randrange(len(t))] = word()
            t += t[:30] * rng.choice([0, 0, 0, 1, 9])
            rows.append((len(rows), " ".join(t)))
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, "..."), (903, "one two"), (904, "One, TWO"), (0, dict(rows)[0]), (None, rows[5][1])]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.class_id if r.class_id is not None else -1) for r in dartminhash.groups(frame(spark, rows)).collect())
    want = plain_groups(rows)
    assert [g for g in got if g[0] >= 0] == [w for w in want if w[0] >= 0]
    assert dartminhash.groups(frame(spark, rows).limit(0)).count() == 0
    kept = dartminhash.stage(spark, frame(spark, rows), "")
    assert kept.columns == ["doc_id", "text", "k", "th", "n"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({c for i, c in want if i >= 0})


# -- repeated strings ----------------------------------------------------------


def plain_removed(rows, n, keep_first):
    texts = [(t or "").encode() for _, t in rows]
    order = sorted(range(len(rows)), key=lambda a: (rows[a][0] is None, rows[a][0] or 0))
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    seen, out = set(), {}
    for a in order:
        t, m = texts[a], np.zeros(len(texts[a]), bool)
        for i in range(len(t) - n + 1):
            w = t[i : i + n]
            if (w in seen) if keep_first else count[w] > 1:
                m[i : i + n] = True
            seen.add(w)
        d = np.diff(np.concatenate([[0], m.view(np.int8), [0]]))
        out[rows[a][0]] = (len(t), int(m.sum()), int((d == 1).sum()), np.frombuffer(t, np.uint8)[~m].tobytes())
    return out


def made(rng):
    chars = lambda k: "".join(rng.choice("abcdé ") for _ in range(k))
    shared = [chars(90), chars(45), chars(300)]
    rows = [(i, chars(rng.randrange(0, 200)) + rng.choice([*shared, ""]) + chars(rng.randrange(0, 90)) + rng.choice([*shared, ""])) for i in range(40)]
    return rows + [(50, "ab" * 100), (51, "x" * 150), (52, None), (53, ""), (54, "short"), (None, shared[2] + "tail")]


@pytest.mark.parametrize("hot", [suffixdedup.HOT, 0])
@pytest.mark.parametrize("keep_first", [False, True])
def test_removed_equals_plain(spark, keep_first, hot, monkeypatch):
    spans = suffixdedup.spans
    monkeypatch.setattr(suffixdedup, "spans", lambda docs, first, length: spans(docs, first, length, hot))
    rows = made(random.Random(11))
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixdedup.removed(frame(spark, rows), keep_first, 40).collect()}
    assert got == plain_removed(rows, 40, keep_first)


def shared_prefix(a, b, most):
    n = 0
    while n < min(len(a), len(b), most) and a[n] == b[n]:
        n += 1
    return n


@pytest.mark.parametrize("large", [64, suffixdedup.LARGE])
@pytest.mark.parametrize("n", [5, 8, 12, 30])
def test_factors_equal_brute_force(n, large, monkeypatch):
    monkeypatch.setattr(suffixdedup, "LARGE", large)
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(n, 4 * n))) for _ in range(12)] + [b"a" * 3 * n]
    windows = [t[i : i + n] for t in texts for i in range(len(t) - n + 1)]
    got = suffixdedup.factors(texts, n)
    lpf, other = (np.concatenate([x[k] for x in got]).tolist() for k in (0, 1))
    for i, w in enumerate(windows):
        assert lpf[i] == max((shared_prefix(w, x, n) for x in windows[:i]), default=0)
        assert other[i] == max(shared_prefix(w, x, n) for k, x in enumerate(windows) if k != i)


def test_smaller_positions():
    rng = np.random.default_rng(4)
    for position in (rng.permutation(200), np.arange(200)[::-1], np.arange(200)):
        shared = np.append(0, rng.integers(0, 50, 199))
        got = suffixdedup.smaller(position, shared)
        for i in range(200):
            j = next((k for k in range(i - 1, -1, -1) if position[k] < position[i]), None)
            assert got[i] == (0 if j is None else shared[j + 1 : i + 1].min())


def test_pieces_and_segments(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(suffixdedup, "SEGMENT", 100)
    monkeypatch.setattr(suffixdedup, "RUN", 30)
    for text in (bytes(rng.choice(b"abcd") for _ in range(700)), b"x" * 700):
        found = [(s, n, d) for _, starts, ns, _, ds in suffixdedup.pieces(text, 40) for s, n, d in zip(starts.tolist(), ns.tolist(), ds, strict=True)]
        assert [x for s, n, _ in found for x in range(s, s + n)] == list(range(661))
        assert all(n <= 30 and d == xxhash.xxh3_128_digest(text[s : s + n + 39]) for s, n, d in found)


def test_repeated_rows_and_nothing(spark):
    t = "".join(random.Random(1).choice("abcdef") for _ in range(500))
    got = suffixdedup.removed(frame(spark, [(1, t), (1, t), (2, "x" * 100)])).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 500), (1, 500), (2, 0)]
    assert suffixdedup.removed(frame(spark, [(1, t)]).limit(0)).count() == 0


def test_query_and_stage_on_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf).collect()]
    want, short = plain_removed(rows, 400, False), plain_removed(rows, suffixdedup.PASSAGE, False)
    got = suffixdedup.query(spark, sf).collect()
    assert len(got) == len(rows)
    for r in got:
        n, cut, spans, kept = want[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, cut, spans, hashlib.sha256(kept).hexdigest())
        assert r.n_passage == short[r.doc_id][1]
    first = plain_removed(rows, suffixdedup.PASSAGE, True)
    left = {r.doc_id: r.text for r in suffixdedup.stage(spark, common.documents(spark, sf), sf).collect()}
    for i, (n, cut, _, kept) in first.items():
        if cut == 0:
            assert left[i] == dict(rows)[i]
        elif i in left:
            assert len(left[i].encode()) - len(kept) <= 3 * 20 and len(left[i].encode()) < n
        else:
            assert len(kept) == 0


def test_whole_characters():
    raw = np.frombuffer("aé漢b".encode(), np.uint8)  # a, two, three bytes, b
    for s in range(8):
        for e in range(s, 8):
            m = np.zeros(7, bool)
            m[s:e] = True
            text = raw[~suffixdedup.whole_characters(raw, m)].tobytes().decode()
            assert set(text) <= set("aé漢b") and len(text.encode()) >= 7 - (e - s)


CLASH = "doc_id long, text string, lang string, th long, spans string, cuts int, _th string, _spans string, o_id int, o_th int, s long, e int, g_id int, g_th int, wins int, times int, hit_id long, hit_th long, k string, c string, id string"


def clashing(spark, rows):
    """Rows with columns that have the names which stages may use inside."""
    return spark.createDataFrame([(i, t, "en", *([None] * 18)) for i, t in rows], CLASH)


def test_stages_with_odd_rows(spark, sf):
    """Nulls, empties, a very long text, repeated rows, another text under a known id, clashing columns, no rows."""
    import corpus_pipeline

    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    a, b, long = words(120), words(120), words(40_000)
    rows = [(1, a), (7, a), (7, b), (1, a), (None, words(90)), (None, None), (2, None), (3, ""), (4, "..."), (5, long), (6, words(20) + " " + a[:400]), (8, "short text here")]
    for name, stage in corpus_pipeline.STAGES:
        df = clashing(spark, rows)
        out = stage(spark, df, sf)
        assert stage(spark, df.limit(0), sf).count() == 0, name
        got = out.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == df.columns, name
        texts = [r.text for r in got] if "text" in out.columns else None
        if name == "near_dedup":
            assert sum(t == a for t in texts) == 1 and b in texts and long in texts
        if name == "substring_dedup":
            # both rows (1, a) are one place, whose copy under 7 goes; texts without a byte stay as they came
            assert sum(t == a for t in texts) == 2 and (7, a) not in [(r.doc_id, r.text) for r in got]
            assert long in texts and None in texts and "" in texts and a[:400] not in next(r.text for r in got if r.doc_id == 6)
        if name == "decontamination":
            assert len(got) == len(rows)


# -- language model ------------------------------------------------------------


def test_windows_score_each_token_once():
    texts = [np.append(np.arange(n - 1), attention.END).astype("<u2") for n in (1, 2, 23, 24, 25, 48, 49, 200)]
    found = attention.Windows(texts)
    inputs, targets, scored = found.block(slice(None))
    assert targets[scored].tolist() == np.concatenate(texts).tolist()
    want = np.concatenate([[attention.END, *x[:-1]] for x in texts])
    assert inputs[:, attention.CONTEXT :][scored].tolist() == want.tolist()
    last = inputs[-1][: attention.CONTEXT + 1]
    assert last.tolist() == texts[-1][192 - 9 : 192].tolist()


def test_gradient_and_score():
    rng = np.random.default_rng(0)
    m = attention.Model.start(np.ones(attention.VOCABULARY))
    batch = attention.Windows([rng.integers(0, attention.END, n).astype("<u2") for n in (70, 5)]).block(slice(None))
    loss, g = m.gradient(*batch)
    assert abs(-m.score(*batch[:2])[batch[2]].mean() - loss) < 1e-4
    g = attention.Model(g.copy())
    for name in m.SHAPES:
        at = np.unravel_index(np.abs(g.w[name]).argmax(), g.w[name].shape)
        old, e = m.w[name][at], 1e-2
        m.w[name][at] = old + e
        up = m.gradient(*batch)[0]
        m.w[name][at] = old - e
        down = m.gradient(*batch)[0]
        m.w[name][at] = old
        assert abs((up - down) / (2 * e) - g.w[name][at]) < 0.1 * abs(g.w[name][at]) + 2e-4, name


def test_probabilities_sum_to_one():
    m = attention.Model.start(np.random.default_rng(1).random(attention.VOCABULARY))
    m.flat += np.random.default_rng(2).standard_normal(m.SIZE).astype(np.float32) * 0.1
    inputs, targets, _ = attention.Windows([np.array([5, 77, attention.END], "<u2")]).block(slice(None))
    total = 0.0
    for t in range(0, attention.VOCABULARY):
        targets[0, 1] = t
        total += math.exp(m.score(inputs, targets)[0, 1])
    assert abs(total - 1) < 1e-3


def plain_score(m, ids):
    """log10 probability of one text, token by token, in float64 and without batches."""
    w = {k: x.astype(float) for k, x in m.w.items()}
    d, total = attention.WIDTH, 0.0
    before = [attention.END] * (attention.CONTEXT + 1)
    seq = before + list(ids)
    for p, t in enumerate(ids):
        first = p // attention.STEP * attention.STEP  # where the window's inputs begin, in seq
        seen = seq[first : p + len(before)]
        x = [w["embed"][i] for i in seen]
        proj = [e @ w["attend"] for e in x]
        q = proj[-1][:d]
        s = np.array([q @ y[d : 2 * d] + w["distance"][len(seen) - 1 - i] for i, y in enumerate(proj)])
        a = np.exp(s) / np.exp(s).sum()
        c = sum(k * y[2 * d :] for k, y in zip(a, proj, strict=True))
        h = np.maximum(np.concatenate([x[-1], c, [1.0]]) @ w["mix"], 0)
        h[-1] = 1
        group, place = divmod(int(t), attention.FAN)
        for logits, k in ((h @ w["top"], group), (h @ w["leaf"][group], place)):
            total += logits[k] - math.log(np.exp(logits).sum())
    return total / math.log(10)


def test_score_equals_plain_attention():
    rng = np.random.default_rng(3)
    m = attention.Model.start(rng.random(attention.VOCABULARY))
    m.flat += rng.standard_normal(m.SIZE).astype(np.float32) * 0.1
    texts = [np.append(rng.integers(0, attention.END, n), attention.END).astype("<u2") for n in (0, 1, 30, 31, 32, 100, 500)]
    for got, ids in zip(attention.score_texts(m, texts), texts, strict=True):
        assert abs(got - plain_score(m, ids)) < 1e-4 * len(ids)


def test_base_score_and_odd_rows(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.documents(spark, sf).collect()] + [(7000, None), (7001, ""), (7001, ""), (7002, "THE the É é\x0b" * 3)]
    words = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    out = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in rows if not out(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    got = attention.score_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        ws = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(r.doc_id), len(ws), sum(count[w] > 0 for w in ws), n)
        assert abs(r.base_score - sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) < 1e-6 * len(ws) + 1e-9
        assert r.score < 0
    assert attention.score_documents(frame(spark, rows).limit(0)).count() == 0


def test_rare_words_are_joined(spark, sf, monkeypatch):
    docs = common.documents(spark, sf)
    want = {r.doc_id: r.base_score for r in attention.score_documents(docs).collect()}
    monkeypatch.setattr(attention, "FREQUENT", 50)
    for r in attention.score_documents(docs).collect():
        assert abs(r.base_score - want[r.doc_id]) < 1e-7 * abs(want[r.doc_id])


def test_words_of_equal_count_are_frequent_together(spark, monkeypatch):
    counts = spark.createDataFrame([(f"w{i}".encode(), c) for i, c in enumerate([9, 5, 5, 5, 2, 1, 1])], "word binary, c long")
    for most, least in ((100, 1), (7, 1), (6, 2), (5, 2), (4, 5), (3, 9), (1, 9), (0, 29)):
        monkeypatch.setattr(attention, "FREQUENT", most)
        assert attention.spread(counts) == (28, 7, least), most
    assert attention.spread(counts.limit(0)) == (0, 0, 1)


def test_subword_frequency_is_of_all_words(spark):
    ranks = {t: r for t, r in bpe.vocabulary()[0].items() if r < attention.END}
    words = [b"the", attention.END_WORD, "Straße漢".encode(), b"x" * 40, b"\x0c1,'".strip()]
    counts = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(words)], "word binary, c long")
    want = np.zeros(attention.VOCABULARY)
    for i, ids in enumerate(attention.Subwords(ranks).encode([[w] for w in words])):
        np.add.at(want, ids, 3 + i)
    assert attention.subword_frequency(counts, ranks).tolist() == want.tolist()
    assert attention.subword_frequency(counts.limit(0), ranks).sum() == 0


def test_subwords_follow_the_ranks():
    ranks = {t: r for t, r in bpe.vocabulary()[0].items() if r < attention.END}
    plain, sub, rng = bpe.Bpe(ranks, r"[\s\S]+", "<u2"), attention.Subwords(ranks), random.Random(2)
    words = ["".join(rng.choice("abcdeéß漢1.,'") for _ in range(rng.randrange(1, 30))).encode() for _ in range(500)]
    for w, ids in zip(words, sub.encode([[w] for w in words]), strict=True):
        assert ids.tolist() == sub.renumber[np.frombuffer(plain.merge([b" " + w])[0], "<u2")].tolist()
    whole = sub.encode([[*words, attention.END_WORD], [attention.END_WORD], []])
    assert whole[0].tolist() == [x for ids in sub.encode([[w] for w in words]) for x in ids.tolist()] + [attention.END]
    assert whole[1].tolist() == [attention.END] and len(whole[2]) == 0


ODD_TEXTS = ["THE the É é\x0b" * 3, None, "", " \n\t ", " lead", "trail \x1f\x0c", "no\u00a0break\u2003here \x00 nul", "a\r\nb  c\x0bd", "x" * 3000, "İstanbul ſ K"]


def test_words_cut_in_arrow():
    rng = random.Random(4)
    texts = [*ODD_TEXTS, *("".join(rng.choices(" \t\n\x0b\x0c\r\x1c\x85aBcÉ漢,", k=rng.randrange(40))) for _ in range(2000))]
    words, ends = attention.split(pa.array(texts, pa.string()))
    begins, words = [0, *ends.tolist()], words.to_pylist()
    assert [words[i:j] for i, j in zip(begins, begins[1:], strict=False)] == [attention.words_of(t) for t in texts]
    assert begins[-1] == len(words) and attention.split(pa.array([], pa.string()))[0].to_pylist() == []


def test_each_text_is_encoded_once(spark):
    """One pass over the texts gives what training, scoring and the base score take; from then on ids are read."""
    ranks = {t: r for t, r in bpe.vocabulary()[0].items() if r < attention.END}
    sub, texts = attention.Subwords(ranks), [*ODD_TEXTS, *ODD_TEXTS]
    frequent = {b"the": 6, b"lead": 1, attention.END_WORD: 20}
    rows = attention.encoded(frame(spark, list(enumerate(texts))), ranks, frequent).collect()
    assert len(rows) == len(texts) and {r.round for r in rows} <= set(range(attention.ROUNDS))
    for r in rows:
        ws = [*attention.words_of(texts[r.doc_id]), attention.END_WORD]
        assert np.frombuffer(r.ids, "<u2").tolist() == sub.encode([ws])[0].tolist()
        assert (r.n_tokens, r.known, [bytes(w) for w in r.rare]) == (len(ws), sum(w in frequent for w in ws), [w for w in ws if w not in frequent])
        assert abs(r.base - sum(math.log10(frequent[w] + 1) for w in ws if w in frequent)) < 1e-9
    none = attention.encoded(frame(spark, [(1, "a")]), ranks, {}).first()
    assert (none.known, [bytes(w) for w in none.rare]) == (0, [b"a", attention.END_WORD])


def test_the_model_is_trained(spark):
    """Held-out text scores far above subword frequencies, on a small table too."""
    docs = common.documents(spark, "/root/testdata/sf0.01").select("doc_id", "text")
    ranks = {t: r for t, r in bpe.vocabulary()[0].items() if r < attention.END}
    out = common.held_out("doc_id", 7, 2)
    frequency = attention.subword_frequency(attention.word_counts(docs.where(~out)), ranks)
    model = attention.train(docs.where(~out), ranks, frequency)
    words = [[*attention.words_of(r.text), attention.END_WORD] for r in docs.where(out).collect()]
    ids = attention.Subwords(ranks).encode(words)
    n = sum(map(len, words))
    plain = np.log10((frequency + 0.1) / (frequency + 0.1).sum())
    assert attention.score_texts(model, ids).sum() / n > sum(plain[x].sum() for x in ids) / n + 1.5


def test_every_document_trains(spark, sf):
    docs = common.documents(spark, sf).select("doc_id", "text")
    parts = [attention.of_round(docs, r, attention.ROUNDS) for r in range(attention.ROUNDS)]
    assert sorted(x.doc_id for p in parts for x in p.collect()) == sorted(x.doc_id for x in docs.collect())
    ranks = {t: r for t, r in bpe.vocabulary()[0].items() if r < attention.END}
    frequency = np.ones(attention.VOCABULARY)
    for row in [(1, "one two three"), (2, "four"), (3, None)]:
        model = attention.train(frame(spark, [row]), ranks, frequency)
        assert (model.flat != attention.Model.start(frequency).flat).any(), row


# -- pipeline ------------------------------------------------------------------


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs, seen = common.documents(spark, sf), []
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, sf), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        seen.append((name, docs, out))
        docs = out
    texts = {r.doc_id: r.text for r in seen[-1][1].collect()}
    codec = bpe.Bpe(*bpe.vocabulary())
    for r in docs.collect():
        assert codec.decode(bytes(r.ids)).decode() == texts[r.doc_id]
    _, before, after = seen[1]
    want = {c for _, c in plain_groups([(r.doc_id, r.text) for r in before.collect()])}
    assert {r.doc_id for r in after.collect()} == want
