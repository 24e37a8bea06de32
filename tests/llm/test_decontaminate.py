import random

import pyarrow as pa
import pytest

from strataq.llm import decontaminate as D

from .conftest import prose

ITEMS = "item_id long, text string"


def distance(item, text):
    """Least edits of the whole item against any part of the text."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def edited(text, n, rng):
    x = list(text)
    for _ in range(n):
        at, kind = rng.randrange(len(x)), rng.randrange(3)
        if kind == 0:
            x[at] = rng.choice("abcxyz")
        elif kind == 1:
            x.insert(at, rng.choice("abc é"))
        else:
            del x[at]
    return "".join(x)


def test_leaks_equal_brute_force():
    rng = random.Random(1)
    items = [(i, prose(i, 6 + 4 * i)) for i in range(6)]
    texts = []
    for k in range(60):
        _, item = rng.choice(items)
        a, b = prose(100 + k, 12), prose(200 + k, 8)
        texts.append(f"{a} {edited(item, rng.randrange(0, 2 * D.budget(len(item)) + 2), rng)} {b}")
    texts += [prose(300, 50), "", None]
    got = {(r, k): e for r, k, _, _, e in D.matches(D.Items(items), pa.array(texts, pa.string()))}
    want = {}
    for r, t in enumerate(texts):
        for k, (_, item) in enumerate(items):
            if len(item) >= D.Q and (d := distance(item, t or "")) <= D.budget(len(item)):
                want[r, k] = d
    assert got == want and 15 < len(want) < 60


def test_case_space_and_place():
    item = prose(1, 30)
    text = "Before.\n" + item.upper().replace(" ", "\t") + " after"
    ((row, k, start, end, edits),) = D.matches(D.Items([(9, item)]), pa.array(["x", text]))
    assert (row, k, edits) == (1, 0, 0) and text[start:end].lower().replace("\t", " ") == item


def test_item_at_the_edges_and_across_texts():
    item = prose(1, 30)
    half = len(item) // 2
    texts = [item, item[:half], item[half:], item + item]
    assert [(r, s, e) for r, _, s, e, _ in D.matches(D.Items([(1, item)]), pa.array(texts))] == [(0, 0, len(item)), (3, 0, len(item))]


@pytest.mark.parametrize("edits", [0, 1, 5])
def test_aligned_equals_full_alignment(edits):
    rng = random.Random(edits)
    item = prose(3, 12)
    text = prose(4, 3) + edited(item, edits, rng) + prose(5, 3)
    found, end = D.aligned(D.folded(item), D.folded(text), -10, len(text))
    assert found == distance(item, text)


def test_blocks_and_stage(spark, table, monkeypatch):
    items = [(i, prose(i, 20)) for i in range(20)] + [(50, None), (51, "short"), (3, prose(3, 20))]
    benchmark = table(items, ITEMS, "benchmark")
    docs = table([(i, prose(500 + i, 60) + (" " + prose(i, 20) if i % 2 else ""), "en", "s", 1) for i in range(20)])
    want = {(i, i) for i in range(1, 20, 2)}
    for size in (2_000_000, 500):
        monkeypatch.setattr(D, "BLOCK", size)
        assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, benchmark).collect()} == want
        clean = D.drop_leaked(docs, benchmark)
        assert clean.columns == docs.columns and sorted(r["doc_id"] for r in clean.collect()) == list(range(0, 20, 2))


def test_long_items_count_as_a_whole():
    rng = random.Random(2)
    item = prose(1, 1500)
    assert len(item) > 6000
    texts = ["x " + item[:4100] + " y", "a " + edited(item, 40, rng) + " b", item[200:]]
    found = D.matches(D.Items([(1, item)]), pa.array(texts))
    assert [x[0] for x in found] == [1, 2] and found[0][4] <= 40 and found[1][4] <= 200


def test_short_items_must_stand_there_unchanged():
    items = [(1, "what is seven by eight?"), (2, "tiny"), (3, "abcdefgh")]
    texts = ["ask: What  is seven by eight?", "ask: What\tis seven BY eight? xabcdefghx", "what is seven by eigth?", "tiny"]
    found = [(r, k, e) for r, k, _, _, e in D.matches(D.Items(items), pa.array(texts))]
    assert found == [(1, 0, 0), (1, 1, 0)]


@pytest.mark.parametrize("pairs", [50, 4_000_000])
def test_repetitive_texts_equal_brute_force(monkeypatch, pairs):
    monkeypatch.setattr(D, "PAIRS", pairs)
    rng = random.Random(3)
    items = [(0, "-" * 60), (1, "ab" * 40), (2, "-" * 30 + prose(1, 6) + "-" * 30), (3, " " * 50), (4, "xyz" * 13 + "w")]
    texts = ["-" * 59, "-" * 500, "q" + "ab" * 90, "=" * 70 + "-" * 57, edited("-" * 30 + prose(1, 6) + "-" * 30, 3, rng), "\t" * 49 + "x", "xyz" * 40, "-" * 20]
    got = {(r, k): e for r, k, _, _, e in D.matches(D.Items(items), pa.array(texts))}
    want = {(r, k): d for r, t in enumerate(texts) for k, (_, i) in enumerate(items) if (d := distance(i, t.replace("\t", " "))) <= D.budget(len(i))}
    assert got == want and len(want) > 6


def test_a_long_run_against_a_run_takes_little_memory():
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = D.matches(D.Items([(1, "-" * 4096)]), pa.array(["-" * 1_000_000, "=" * 100]))
    assert [x[0] for x in found] == [0] and found[0][2:] == (0, 4096, 0)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000  # KB


def test_text_identifiers_and_clashing_columns(spark, table):
    benchmark = table([("a", prose(1, 30)), (None, prose(2, 30))], "item_id string, text string", "benchmark")
    docs = table([(1, "x " + prose(1, 30), None, None, None, 5), (2, prose(2, 30), None, None, None, 6)], "doc_id long, text string, lang string, source string, n_chars long, item_id long")
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, benchmark).collect()) == [(1, "a"), (2, None)]
    assert D.drop_leaked(docs, benchmark).columns == docs.columns


def test_odd_rows_and_empty_tables(odd, table):
    benchmark = table([(1, prose(1, 30))], ITEMS, "benchmark")
    assert D.find_leaks(odd, benchmark).count() == 0 and D.drop_leaked(odd, benchmark).count() == odd.count()
    none = table([], ITEMS, "benchmark")
    assert D.find_leaks(odd, none).count() == 0 and D.drop_leaked(odd, none).columns == odd.columns
    assert D.find_leaks(table([]), benchmark).count() == 0
