import duckdb
import pytest

from strataq.llm import quality as Q

from .conftest import WORD, prose


def base(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(again)


def measures(df):
    return df.select("__sq_n", "__sq_word_chars", "__sq_symbols", "__sq_dup_lines", "__sq_repeats")


def test_base_measures(spark, table):
    texts = ["a b c a b c", "a b c d a b", "# $$ |\nx\nx\n\n x\n", "p q " * 60, prose(1, 300), prose(2, 80) + "\n" + prose(2, 80), "\x0b\x0cone\rtwo", "the the the the"]
    docs = table([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    got = {r["doc_id"]: tuple(r)[1:] for r in Q.judge(docs).select("doc_id", *measures(Q.judge(docs)).columns).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_odd_rows(odd):
    judged = Q.judge(odd)
    assert sorted(measures(judged).collect()) == sorted(base(r["text"]) for r in odd.collect())
    kept = Q.keep_good(odd)
    assert kept.columns == odd.columns


def test_junk_goes_and_clean_text_stays(spark, table):
    clean = [prose(k, 300) for k in range(40)]
    texts = [*clean, prose(50, 300).upper() + "!!", " ".join(w + "$$$" for w in prose(51, 200).split()), " | ".join(prose(52, 200).split()), "Same " * 200, "few words"]
    docs = table([(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    kept = {r["doc_id"] for r in Q.keep_good(docs).select("doc_id").collect()}
    assert set(range(40)) <= kept and kept.isdisjoint({40, 41, 43, 44})


def test_empty_table(table):
    docs = table([])
    assert Q.fit_references(docs) == {} and Q.keep_good(docs).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_its_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = sorted(map(tuple, Q.op5_quality_rules(spark, path).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    assert got == sorted(con.execute(Q.ORACLE_SQL["op5_quality_rules"]).fetchall())


def test_plans_have_no_python_and_texts_are_read_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for p in (plan(Q.measured(docs)), plan(Q.op5_quality_rules(spark, "/root/testdata/sf0.001"))):
        assert "Python" not in p and "Arrow" not in p and "Exchange" not in p
    assert "documents.parquet" not in plan(Q.judge(docs))  # verdicts come from the written measures
