import random
from fractions import Fraction

import pytest

from strataq.llm import jaccard_join as J

from .conftest import SCHEMA, WORD, lowered, prose


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    """component of each row (by place), as the least identifier in it."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                up[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        r = root(i)
        if k is not None:
            least[r] = min(k, least.get(r, k))
    return [(k, len(sets[i]), least.get(root(i)) if sets[i] else k) for i, (k, _) in enumerate(rows)]


def changed(text, n, rng):
    w = text.split()
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(len(w))
        if k == 0:
            w[at] = "new" + str(rng.randrange(1000))
        elif k == 1:
            w.insert(at, "more" + str(rng.randrange(1000)))
        else:
            del w[at]
    return " ".join(w)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for b in range(12):
        base = prose(100 * seed + b, rng.randrange(8, 160), 2000)
        rows += [changed(base, rng.randrange(0, 8), rng) for _ in range(rng.randrange(1, 12))]
    passage = prose(999, 60, 2000)
    rows += [prose(5000 + i, 40, 2000) + " " + passage for i in range(25)]
    base = prose(77, 120, 2000)
    rows += [changed(base, rng.randrange(2, 5), rng) for _ in range(60)]  # many near copies, some of which link with few
    rows += [base.upper()] * 9 + ["a b", "a  B", "a b c", "", None, " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def classes(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id").collect()), key=repr)


@pytest.mark.parametrize("seed,hubs,rounds", [(1, 3, 2), (2, 1, 1)])
def test_classes_equal_brute_force(table, monkeypatch, seed, hubs, rounds):
    monkeypatch.setattr(J, "HUBS", hubs)
    monkeypatch.setattr(J, "ROUNDS", rounds)
    monkeypatch.setattr(J, "HEAVY_LEAST", 20)  # so that some shingles are heavy
    rows = corpus(seed)
    docs = table([(*r, None, None, None) for r in rows])
    assert classes(J.similar_documents(docs)) == sorted(brute(rows), key=repr)


def test_threshold_is_inclusive(table):
    # 7 shingles; 6 of them and none more: 6/8 = 75 %
    a = [f"w{i}" for i in range(11)]
    b = [*a[:10], "x"]
    rows = [(5, " ".join(a)), (3, " ".join(b))]
    got = Fraction(len(shingles(rows[0][1]) & shingles(rows[1][1])), len(shingles(rows[0][1]) | shingles(rows[1][1])))
    assert got == Fraction(3, 4)
    assert classes(J.similar_documents(table([(*r, None, None, None) for r in rows]))) == [(3, 7, 3), (5, 7, 3)]
    assert classes(J.similar_documents(table([(5, " ".join(a), None, None, None), (3, " ".join([*a[:9], "x", "y"]), None, None, None)]))) == [(3, 7, 3), (5, 7, 5)]


def test_one_of_each_stays(table):
    rows = corpus(3)
    docs = table([(*r, None, None, None) for r in rows])
    kept = J.one_of_each(docs)
    want = sorted(k for k, n, c in brute(rows) if k == c)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == want


def test_odd_rows(odd, table):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert classes(J.similar_documents(odd)) == sorted(brute(rows), key=repr)
    kept = J.one_of_each(odd)
    assert kept.columns == odd.columns
    assert len([r for r in kept.collect() if r["text"] == "same text twice here now"]) == 1
    assert len([r for r in kept.collect() if not (r["text"] or "").strip()]) == 3
    assert classes(J.similar_documents(table([]))) == [] and J.one_of_each(table([])).count() == 0


def test_rows_that_repeat_identifier_and_text(table):
    text = prose(1, 30)
    docs = table([(4, text, "en", "s", 1)] * 3 + [(None, text + " x", None, None, None), (9, "other " + prose(2, 30), None, None, None)], SCHEMA)
    assert sorted(r["doc_id"] for r in J.one_of_each(docs).collect()) == [4, 9]
    assert classes(J.similar_documents(docs)) == sorted(brute([(4, text)] * 3 + [(None, text + " x"), (9, "other " + prose(2, 30))]), key=repr)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (200, 300)]
    labels, _ = J.components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["label"] for r in labels.collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 300: 100}


@pytest.mark.parametrize("block", [4, 64])
def test_link_counts_equal_brute_force(table, odd, monkeypatch, block):
    monkeypatch.setattr(J, "BLOCK", block)
    rows = [*corpus(1), (None, "a b"), (3, None)]
    sets = [shingles(t) for _, t in rows]
    want = [(k, sum(i != j and bool(a) and bool(b) and 100 * len(a & b) >= 75 * len(a | b) for j, b in enumerate(sets))) for i, ((k, _), a) in enumerate(zip(rows, sets))]
    got = J.link_counts(table([(*r, None, None, None) for r in rows]))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert max(n for _, n in want) > 20
    assert J.link_counts(table([])).count() == 0 and J.link_counts(odd).count() == odd.count()


def test_members_of_sets_beside_other_keys():
    import numpy as np

    keys = [np.array(k, np.uint64) for k in ([1, 5, 9], [2, 5, 6], [9])]
    assert J._members(np.concatenate(keys), keys, np.array([2, 5], np.uint64)).tolist() == [[0, 1], [1, 1], [0, 0]]


def test_rounds_go_on_from_what_the_last_one_left(table, monkeypatch):
    """Shingles of one class are not dealt again, and only sets of pairs that the sketches leave are moved."""
    seen, moved = [], []
    between, kept = J._between, J.kept

    def watched(postings, parts):
        seen.append(postings.count())
        return between(postings, parts)

    def written(df, what, *rest):
        out = kept(df, what, *rest)
        if what in ("join-near", "join-links"):
            moved.append((what, out[0].count()))
        return out

    monkeypatch.setattr(J, "_between", watched)
    monkeypatch.setattr(J, "kept", written)
    rows = corpus(1)
    assert classes(J.similar_documents(table([(*r, None, None, None) for r in rows]))) == sorted(brute(rows), key=repr)
    assert len(seen) > 2 and seen[1:] == sorted(seen[1:], reverse=True) and seen[-1] < seen[0]
    assert [w for w, _ in moved] == ["join-near", "join-links"] * (len(moved) // 2)
    assert all(near >= links for (_, near), (_, links) in zip(moved[::2], moved[1::2]))


def test_sets_that_link_with_none_are_not_dealt_whole(table, monkeypatch):
    """Of texts without a like, only prefixes travel."""
    rows = list(enumerate([prose(3000 + i, 200, 2000) for i in range(60)] + [changed(prose(3000, 200, 2000), 2, random.Random(1))]))
    docs = table([(*r, None, None, None) for r in rows])
    moved, real = [], type(docs).repartitionById

    def watched(df, *args):
        moved.append(df.selectExpr("coalesce(sum(length(sets) + length(keys) + length(sizes)), 0)").first()[0])
        return real(df, *args)

    monkeypatch.setattr(type(docs), "repartitionById", watched)
    assert classes(J.similar_documents(docs)) == sorted(brute(rows), key=repr)
    total = sum(len(shingles(t)) for _, t in rows)
    assert max(moved) < 6 * total and sum(moved) < 8 * total


@pytest.mark.parametrize("margin", [4, 16, 1000])
def test_linked_sets_share_enough_of_their_prefixes(monkeypatch, margin):
    import numpy as np

    monkeypatch.setattr(J, "MARGIN", margin)
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, 150))
        pool = rng.permutation(4 * n)
        a, common = np.sort(pool[:n]), int(rng.integers(J._least(n), n + 1))
        b = np.sort(np.concatenate((rng.permutation(a)[:common], pool[n : n + int(rng.integers(0, n // 3 + 1))])))
        if 100 * common >= 75 * (len(a) + len(b) - common):
            (p, need_a), (q, need_b) = J._prefix(len(a)), J._prefix(len(b))
            assert len(np.intersect1d(a[:p], b[:q])) >= max(need_a, need_b)


def test_marks_of_digests(spark, monkeypatch):
    import numpy as np

    digests = np.array([0, 1, -1, 2**63 - 1, -(2**63), 32767, 32768, *range(10**6, 10**15, 10**12 + 7)], np.int64)
    table = spark.createDataFrame([(int(x),) for x in digests], "digest long")
    others = np.random.default_rng(1).integers(0, 2**64, 10000, np.uint64)
    for most, share in ((1 << 28, 0.1), (1 << 15, 0.1)):
        monkeypatch.setattr(J, "MOST_BITS", most)
        monkeypatch.setattr(J, "MARK_BITS", 100)
        marks = J._marked(table)
        assert len(marks) == (1 << 17 if most > 1 << 17 else most) // 8
        assert J._has_mark(marks, digests.view(np.uint64)).all() and J._has_mark(marks, others).mean() < share
    assert not J._has_mark(J._marked(table.limit(0)), others).any()
