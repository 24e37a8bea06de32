import collections
import math
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataq.llm import lm_score as L
from strataq.llm.toxicity import remainder

from .conftest import WORD, lowered, prose


def tokens(text):
    return [*WORD.findall(lowered(text)), None]


def held(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 10 == 0


def check_base(rows, got):
    counts = collections.Counter(t for k, x in rows if not held(k) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    want = sorted((k if k is not None else -1, held(k), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens(x))) for k, x in rows)
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-9)


def score(docs):
    return L.score_texts(docs.select("doc_id", "text"), remainder(F.col("doc_id"), 10) == 0).collect()


def test_base_equals_brute_force(table):
    rows = [(i, prose(i % 7, 30 + i) + (" Only%d" % i), None, None, None) for i in range(60)]
    got = score(table(rows))
    check_base([r[:2] for r in rows], got)
    assert all(r["score"] < 0 for r in got)


def test_model_gives_less_to_unlikely_texts(table):
    rows = [(i, prose(1, 80, 40), None, None, None) for i in range(80)]
    odd = next(i for i in range(100, 200) if held(i))
    rows += [(odd, "zq xj vw " * 27, None, None, None), (odd + 1000, None, None, None, None)]
    got = {r["doc_id"]: r for r in score(table(rows))}
    assert got[odd]["score"] / got[odd]["n_tokens"] < 2 * got[1]["score"] / got[1]["n_tokens"]


def entropy_code(text):
    """A learner's worth of bits and slots of one spelled word."""
    words = L.Words(pa.array([text, ""]), np.array([0, 1]), 1)
    tokens = L.Tokens(words, np.array([0, 1], np.int32), np.array([2]), np.array([True]), NO_ANCHORS)
    return next(tokens.spelled())


NO_ANCHORS = (np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint8), np.empty(0, np.uint64))


def test_words_are_spelled_bit_by_bit_with_a_closing_byte():
    at, (slots, _, place, row, bits) = entropy_code("aé")
    assert "".join(str(int(b)) for b in bits) == "".join(f"{x:08b}" for x in "aé ".encode())
    assert at.tolist() == [0] * 32 and place[::8].tolist() == [0, 1, 2, 3] and row[8] == ord("a")
    assert slots.shape == (L.BITS.contexts, 32)
    for k in range(L.BITS.contexts):
        assert ((slots[k] >= L.BITS.starts[k]) & (slots[k] < L.BITS.starts[k + 1])).all()


def test_spelling_sees_the_word_before_it():
    words = L.Words(pa.array(["ab", "x", "new", ""]), np.array([5, 5, 0, 5]), 15)
    spelt = []
    for first in (0, 1):
        tokens = L.Tokens(words, np.array([first, 2, 3], np.int32), np.array([3]), np.array([True]), NO_ANCHORS)
        (_, (slots, _, _, row, _)), = tokens.spelled()
        spelt.append((slots, row))
    assert spelt[0][1][0] == spelt[1][1][0] == ord(" ")
    assert (spelt[0][0][:2, 0] != spelt[1][0][:2, 0]).all()  # the last bytes, across words
    assert (spelt[0][0][2] == spelt[1][0][2]).all()  # the bytes of this word


def test_learner_and_model_equal_plain_loops(monkeypatch):
    monkeypatch.setattr(L, "STEP", 1)
    rng = np.random.default_rng(2)
    kind = L.Kind((4, 5), 3, 2)
    learner, n = L.Learner(kind), 400
    slots = np.stack([rng.integers(0, 16, n), 16 + rng.integers(0, 32, n)]).astype(np.int32)
    gate, row, bit = rng.integers(0, 3, n), rng.integers(0, 2, n), (slots[0] + rng.integers(0, 9, n)) % 16 > 8
    zeros, ones = [0.0] * 48, [0.0] * 48
    weights = [[0.4, 0.4] for _ in range(3)]
    hits = [[[0, 0] for _ in range(L.LEVELS)] for _ in range(2)]
    clip = lambda x: max(-L.CLIP, min(L.CLIP, x))
    squash = lambda x: 1 / (1 + math.exp(-x))
    for i in range(n):
        learner.learn(slots[:, i : i + 1], gate[i : i + 1], None, row[i : i + 1], bit[i : i + 1])
        x = [clip(math.log((ones[s] + 0.4) / (zeros[s] + 0.4))) for s in slots[:, i]]
        w = weights[gate[i]]
        logit = clip(sum(a * b for a, b in zip(w, x)))
        hits[row[i]][int((logit + L.CLIP) * (L.LEVELS - 1) / (2 * L.CLIP) + 0.5)][int(bit[i])] += 1
        for k in range(2):
            w[k] += L.RATE * (bit[i] - squash(logit)) * x[k]
            (ones if bit[i] else zeros)[slots[k, i]] += 1
    assert np.allclose(learner.mixer.weights, weights, atol=1e-5)
    assert np.array_equal(learner.tables(), [zeros, ones])
    assert np.abs(learner.hits.reshape(2, L.LEVELS, 2) - hits).sum() <= 2  # a logit at an edge

    mixer = L.merged(kind, [learner.state()])
    logits = L._stretch((np.array(ones) + 0.4) / (np.array(zeros) + np.array(ones) + 0.8)).astype(np.float32)
    got = mixer.cost(logits[slots], gate, row, bit)
    start = [squash(-L.CLIP + 2 * L.CLIP * k / (L.LEVELS - 1)) for k in range(L.LEVELS)]
    levels = [[(L.PRIOR * start[k] + learner.hits.reshape(2, L.LEVELS, 2)[r, k, 1]) / (L.PRIOR + learner.hits.reshape(2, L.LEVELS, 2)[r, k].sum()) for k in range(L.LEVELS)] for r in range(2)]
    for i in range(n):
        logit = clip(sum(w * clip(math.log((ones[s] + 0.4) / (zeros[s] + 0.4))) for w, s in zip(weights[gate[i]], slots[:, i])))
        at = (logit + L.CLIP) * (L.LEVELS - 1) / (2 * L.CLIP)
        low = min(int(at), L.LEVELS - 2)
        p = (squash(logit) + levels[row[i]][low] * (1 - at + low) + levels[row[i]][low + 1] * (at - low)) / 2
        assert math.isclose(got[i], math.log10(p if bit[i] else 1 - p), rel_tol=1e-3, abs_tol=1e-4)


def test_matches_equal_brute_force(monkeypatch):
    monkeypatch.setattr(L, "GAP", 2)
    monkeypatch.setattr(L, "RUN", 5)
    rng = random.Random(8)
    stock = [f"w{i}" for i in range(6)]
    passage = [rng.choice(stock) for _ in range(12)]
    texts = [[rng.choice(stock) for _ in range(rng.randrange(0, 15))] + passage[: rng.randrange(12)] + [rng.choice(stock) for _ in range(rng.randrange(4))] for _ in range(60)]
    held = [rng.random() < 0.3 for _ in texts]
    hashes = dict(zip([*stock, ""], L.hashes_of(pa.array([*stock, ""]))))
    found = []  # every anchor: its text, place, key, and run
    for t, words in enumerate(texts):
        flow = [*words, ""]
        at, key, n = L.anchors_of(np.array([hashes[w] for w in flow], np.uint64), np.array([len(flow)]))
        assert all(p >= L.ORDER - 1 and p + 1 < len(flow) for p in at)
        for k, p in enumerate(at.tolist()):
            stop = min(len(flow) - 1, p + L.RUN, *at[k + 1 : k + 2].tolist())
            assert n[k] == stop - p
            found.append((t, p, int(key[k]), tuple(flow[p + 1 : stop + 1])))
    assert {f[2] for f in found} and len({f[2] for f in found}) < len(found)
    short = lambda run: np.array([int(hashes[w]) >> 48 for w in run], np.uint16)
    state, n, hits = L.expected_runs(np.array([f[2] for f in found], np.uint64), np.concatenate([short(f[3]) for f in found]), np.array([len(f[3]) for f in found]), np.array([int(not held[f[0]]) for f in found], np.int32))
    some = 0
    for i, (t, p, key, run) in enumerate(found):
        others = collections.Counter(r for u, q, k, r in found if k == key and not held[u] and (u, q) != (t, p))
        now = int(held[t])
        if not others:
            assert state[now, i] == 0
            continue
        most = max(others.values())
        best = [r for r, c in others.items() if c == most]
        outcomes = [(min(len(r), len(run)), sum((r[j] == run[j]) << j for j in range(min(len(r), len(run))))) for r in best]
        assert (n[now, i], hits[now, i]) in outcomes
        unanimous, majority = most == others.total(), 2 * most > others.total()
        assert state[now, i] == 1 + min(int(math.log2(most)), 3) * 3 + (2 - unanimous - majority)
        some += len(best) == 1
    assert some > 30


def test_known_words_probabilities_sum_to_that_of_being_known():
    """All words that could stand at a place share what the decision gives to known ones."""
    words = pa.array(["a", "b", "c", "new", ""])
    counts = np.array([5, 3, 1, 0, 4])
    learners = {kind: L.Learner(kind) for kind in (L.DECISIONS, L.BITS)}
    known = L.Words(words, counts, 13)
    train = L.Tokens(known, np.array([0, 1, 0, 2, 0, 1, 4] * 9, np.int32), np.full(9, 7), np.zeros(9, bool), NO_ANCHORS)
    L.learn(train, learners)
    zeros, ones = np.concatenate([learners[k].tables() for k in (L.DECISIONS, L.BITS)], axis=1)
    model = L.Model(zeros, ones, [learners[L.DECISIONS].state()], [learners[L.BITS].state()])
    last = []
    for w in range(5):
        tokens = L.Tokens(known, np.array([0, 1, w], np.int32), np.array([3]), np.array([True]), NO_ANCHORS)
        last.append(10 ** L.token_scores(tokens, model)[2])
        (_, (slots, gate, _, row, bit)), = tokens.decisions()
        if w == 0:
            p_known = 10 ** model.cost(L.DECISIONS, slots, gate, None, row, bit)[2]
    assert math.isclose(sum(last[w] for w in (0, 1, 2, 4)), p_known, rel_tol=1e-6) and 0 < last[3] < 1 - p_known


def test_held_out_texts_score_above_the_base(spark):
    from strataq.llm.lm_score import op3_lm_score

    rows = op3_lm_score(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows["s"] > 0.9 * rows["b"]


def test_odd_rows(odd, table):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    check_base(rows, score(odd))
    assert score(table([])) == []


def test_without_training_texts(table):
    key = next(i for i in range(100) if held(i))
    (r,) = score(table([(key, "two words", None, None, None)]))
    assert (r["train_tokens"], r["n_known"], r["n_tokens"], r["base_score"]) == (0, 0, 3, 0.0) and r["score"] < 0


def test_score_depends_on_the_order_of_words(table):
    words = prose(5, 150, 2000).split()
    mixed = random.Random(1).sample(words, len(words))
    one, two = [i for i in range(100, 300) if held(i)][:2]
    rows = [(i, prose(i, 150, 2000), None, None, None) for i in range(60)] + [(60 + i, " ".join(words), None, None, None) for i in range(5)]
    rows += [(one, " ".join(words), None, None, None), (two, " ".join(mixed), None, None, None)]
    got = {r["doc_id"]: r for r in score(table(rows))}
    assert math.isclose(got[one]["base_score"], got[two]["base_score"], rel_tol=1e-9)
    assert got[one]["score"] > 0.5 * got[two]["score"]


def test_parts_of_many_texts_equal_each_text_alone(monkeypatch):
    """Texts are cut into parts at text ends only, and score alike in any company."""
    words = pa.array(["a", "b", "long-word", "é", "x" * 40, ""])
    known = L.Words(words, np.array([3, 2, 0, 1, 0, 4]), 10)
    texts = [[0, 1, 2, 3, 0, 5], [5], [1, 1, 4, 0, 5], [2, 5]]
    rng = np.random.default_rng(3)
    zeros, ones = rng.integers(0, 50, L.SLOTS).astype(np.float32), rng.integers(0, 50, L.SLOTS).astype(np.float32)
    model = L.Model(zeros, ones, [], [])
    make = lambda part: L.Tokens(known, np.array([w for t in part for w in t], np.int32), np.array([len(t) for t in part]), np.ones(len(part), bool), NO_ANCHORS)
    alone = np.concatenate([L.token_scores(make([t]), model) for t in texts])
    for size in (8, 1 << 14):
        monkeypatch.setattr(L, "RANGE", size)
        assert np.allclose(L.token_scores(make(texts), model), alone)


def test_every_training_token_is_learnt_as_often_as_it_comes(monkeypatch):
    known = L.Words(pa.array(["the", "rare", ""]), np.array([3000, 1, 1]), 3002)
    tokens = L.Tokens(known, np.array([0] * 3000 + [1, 2], np.int32), np.array([3002]), np.array([False]), NO_ANCHORS)
    learners = {kind: L.Learner(kind) for kind in (L.DECISIONS, L.BITS)}
    L.learn(tokens, learners)
    assert learners[L.DECISIONS].used.sum() == learners[L.DECISIONS].hits.sum() == 3002
    bits = 8 * len(b"rare " + b" ")  # what comes once is new, as if it were held out
    assert learners[L.BITS].used.sum() == bits and learners[L.BITS].tables().sum() == bits * L.BITS.contexts
    for kind, learner in learners.items():
        twice = L.merged(kind, [learner.state(), L.Learner(kind).state()])
        assert np.allclose(twice.weights, L.merged(kind, [learner.state()]).weights)  # a part without tokens weighs nothing


def test_a_copy_in_the_training_texts_raises_the_score(table):
    rows = [(i, prose(i, 150, 2000), None, None, None) for i in range(120)]
    twice = [i for i in range(200, 300) if held(i)][:5]
    source = [i for i in range(120) if not held(i)][:5]
    rows += [(k, rows[i][1], None, None, None) for k, i in zip(twice, source)]
    got = {r["doc_id"]: r for r in score(table(rows))}
    others = [r["bits_per_byte"] for k, r in got.items() if k < 120]
    for k in twice:
        assert got[k]["bits_per_byte"] < 0.6 * min(others), k


def test_bits_per_byte_are_of_the_coded_bytes(table):
    texts = ["Two  words", "", None, "é \n x"]
    got = {r["doc_id"]: r for r in score(table([(i, t, None, None, None) for i, t in enumerate(texts)]))}
    for i, t in enumerate(texts):
        n = sum(len((w or "").encode()) + 1 for w in tokens(t))
        assert got[i]["n_bytes"] == n and math.isclose(got[i]["bits_per_byte"], -got[i]["score"] / math.log10(2) / n, rel_tol=1e-9)


def test_matches_are_looked_up_at_every_place():
    """Each place with ORDER words of its text, but the end, which nothing follows."""
    sizes = np.array([1, 3, 4, 9, 70])
    at, _, n = L.anchors_of(L.hashes_of(pa.array([f"w{i}" for i in range(87)])), sizes)
    starts = np.cumsum(sizes) - sizes
    assert at.tolist() == [s + p for s, size in zip(starts.tolist(), sizes.tolist()) for p in range(L.ORDER - 1, size - 1)]
    assert (n == 1).all()


def test_keys_in_parts_equal_all_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    size = 400
    key, n, times = rng.integers(0, 250, size).astype(np.uint64), rng.integers(1, 4, size), rng.integers(0, 3, size).astype(np.int32)
    key[:40], n[0] = 7, L.RUN
    run = rng.integers(0, 2, n.sum()).astype(np.uint16)
    want = L.expected_runs(key, run, n, times)
    for some in (1, 16, 1 << 18):
        monkeypatch.setattr(L, "KEYS_AT_ONCE", some)
        got = L.expected(key, run, n, times)
        for a, b in zip(want, got):
            assert np.array_equal(np.where(want[0], a, 0), np.where(got[0], b, 0))
    assert [x.shape for x in L.expected(key[:0], run[:0], n[:0], times[:0])] == [(2, 0)] * 3


def test_a_short_passage_of_a_training_text_is_found_anywhere(table):
    """Passages of eight words amid others, held out, against the same words in another order: five places are predicted."""
    rows = [(i, " ".join([f"t{i}w{k}" for k in range(60)] + [f"c{k}" for k in range(60)]), None, None, None) for i in range(40)]
    rng = random.Random(6)
    for i in range(40):
        at = rng.randrange(52)
        inside = [f"t{i}w{k}" for k in range(at, at + 8)]
        rows += [(100 + i, " ".join([f"n{i}", *inside, f"m{i}"]), None, None, None), (200 + i, " ".join([f"n{i}", *inside[::-1], f"m{i}"]), None, None, None)]
    got = {r["doc_id"]: r["score"] for r in L.score_texts(table(rows).select("doc_id", "text"), F.col("doc_id") >= 100).collect()}
    for i in range(40):
        assert got[100 + i] > got[200 + i] + 10, i
