import zlib

import numpy as np
import pytest

from .conftest import SCHEMA, prose
from .test_jaccard_join import brute
from .test_token_shards import ids_of

pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf(folder):
    rows = [(i, prose(i, 150), "en", f"s{i % 3}", 1) for i in range(60)]
    rows += [(100 + i, prose(i, 150) + " and more", "en", "s0", 1) for i in range(10)]  # near copies
    rows += [(200 + i, prose(400 + i, 100) + " " + prose(900, 40), "en", "s1", 1) for i in range(5)]  # leaks
    rows += [(300 + i, "junk " * 80, "en", "s2", 1) for i in range(5)] + [(400, "too short", "en", "s0", 1), (401, None, None, None, None)]
    return folder(documents=(rows, SCHEMA), benchmark=([(1, prose(900, 40))], "item_id long, text string"))


def test_stages_and_result(spark, sf):
    from strataq.llm._store import kept

    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for _, stage in pipeline.STAGES[:-1]:
        docs, _ = kept(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        seen.append(sorted(r["doc_id"] for r in docs.collect()))
    assert seen[0] == [*range(60), *range(100, 110), *range(200, 205)]
    source = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert seen[1] == sorted(k for k, _, c in brute([(k, source[k]) for k in seen[0]]) if k == c) == [*range(60), *range(200, 205)]
    assert seen[2] == list(range(60))
    assert set(seen[3]) <= set(range(60)) and len(seen[3]) > 50
    got = sorted(map(tuple, pipeline.run(spark, sf).collect()))
    want, start = [], 0
    for key in seen[3]:
        ids = ids_of(source[key])
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want


def test_shards_keep_the_order_of_the_mixture_and_tables_go(spark, sf):
    from strataq.llm import _store, token_shards
    from strataq.llm._store import kept

    at = spark._jvm.org.apache.hadoop.fs.Path(_store.shared_dir(spark))
    names = lambda: {s.getPath().getName() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in pipeline.STAGES[:3]:
        docs, _ = kept(stage(spark, docs, sf), "test-stage")
    from strataq.llm.mixture import mix_documents

    mixed, path = kept(mix_documents(docs), "test-stage")
    want = [r["doc_id"] for r in mix_documents(docs).collect()]
    before = names()
    pipeline.token_output(spark, mixed, sf).collect()
    (folder,) = {n for n in names() - before if n.startswith("token-shards")}
    files = sorted(s.getPath().toString() for s in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(at, folder)))
    assert list(token_shards.read_order([{"path": f} for f in files if "/order-" in f])) == want != sorted(want)
    before = names()
    pipeline.run(spark, sf)
    assert {n.rsplit("-", 1)[0] for n in names() - before} == {"token-shards", "pipeline-4"}


def test_an_empty_table_and_odd_rows(spark, folder, odd):
    empty = folder(documents=([], SCHEMA), benchmark=([], "item_id long, text string"))
    assert pipeline.run(spark, empty).count() == 0
    benchmark = ([(1, None), (1, None)], "item_id long, text string")
    path = folder(documents=([(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in odd.collect()], SCHEMA), benchmark=benchmark)
    assert pipeline.run(spark, path).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
