import zlib

from strataq.llm import toxicity as X

from .conftest import prose


def corpus():
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = prose(i, 60 + i % 50).split()
        if bad:
            words[10], words[30] = ("idiot", "scum") if i % 8 else ("moron", "idiot")
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, folder):
    rows, labels = corpus()
    sf = folder(documents=(rows, "doc_id long, text string, lang string, source string, n_chars long"), labels=(labels, LABELS))
    got = X.op1_toxicity(spark, sf).collect()
    assert len(got) == 400
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(r["predicted"], int(r["doc_id"] % 4 == 0)) for r in got if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)


def test_model_is_sparse_and_order_and_repeats_of_labels_do_not_matter(spark, table):
    rows, labels = corpus()
    docs = table(rows)
    part = [x for x in labels if x[0] % 3]
    a = X.fit(docs, spark.createDataFrame(part, LABELS))
    b = X.fit(docs, spark.createDataFrame(part[::-1] + part[:5], LABELS))
    assert len(a[0]) < 2000 and a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_labels_of_held_out_rows_do_not_matter(spark, folder):
    rows, labels = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    assert turned != labels
    scores = []
    for some in (labels, turned, [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]):
        sf = folder(documents=(rows, schema), labels=(some, LABELS))
        scores.append(sorted((r["doc_id"], r["score"]) for r in X.op1_toxicity(spark, sf).collect()))
    assert scores[0] == scores[1] == scores[2]


def test_ftrl_equals_a_plain_loop():
    """One coordinate after the other, with the weight from its sums each time."""
    import math
    import random

    import numpy as np

    rng, size = random.Random(5), 12
    model = X.Ftrl(size)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        l1 = 0.0 if i == size else X.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((X.BETA + math.sqrt(n[i])) / X.ALPHA + X.L2)

    for _ in range(600):
        label = rng.randrange(2)
        some = sorted(rng.sample(range(6) if label else range(3, size), 3))
        model.learn(np.array(some), label)
        used = [*some, size]
        w = {i: weight(i) for i in used}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in used:
            sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / X.ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n)
    got = model.weights(np.arange(size + 1))
    assert np.allclose(got, [weight(i) for i in range(size + 1)]) and (got == 0).any() and (got != 0).any()


def test_odd_rows(spark, odd, table):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, None), (2, None, 0), (None, 1, 1), (7, 1, 0), (7, 1, 0)], LABELS)
    model = X.fit(odd, labels)
    scores = X.score(odd, model).collect()
    assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
    none = X.fit(odd, labels.limit(0))
    assert {r["score"] for r in X.score(odd, none).collect()} == {0.0}
    assert X.score(table([]), model).count() == 0


def test_score_equals_the_sum_of_weights():
    import math

    import numpy as np
    import pyarrow as pa

    text = "One two one three"
    rows, slots = X.features(pa.array([text]))
    assert len(slots) == 4 + 4 + 3 + 2 and set(rows.tolist()) == {0}
    distinct = np.unique(slots)
    model = (np.append(distinct, 1 << X.BITS), np.arange(len(distinct) + 1) / 10)
    out = next(X._scoring(*model, [])(iter([pa.RecordBatch.from_pydict({"text": [text]})])))
    assert math.isclose(out.column("score")[0].as_py(), 1 / (1 + math.exp(-model[1].sum())))
