"""Operator 11 against a plain loop."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm.fim_sql import OP11_SQL, fill_in_middle, op11_fill_in_middle, restored_text
from tests.compare import connect, duck_rows, spark_rows
from tests.llm.helpers import LONG, ROWS, docs

MORE = [(k, t, "en", "a", 1, "x", 1) for k, t in enumerate(["a<P", "<P><", "<<S", "S>x<", "ends <M", "a\x00b", "éé", "line\r\nline\n", "'quoted' ''{unit}''", "x<M>y"] * 12, 100)]


def slow(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text


COLUMNS = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "fim", "restored")


def test_odd_rows_against_a_plain_loop(spark):
    rows = ROWS + MORE
    got = restored_text(fill_in_middle(docs(spark, rows)))
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=repr) == sorted((slow(r[0], r[1]) for r in rows), key=repr)
    assert {r.form for r in got.collect()} == {"plain", "psm", "spm"}
    assert restored_text(fill_in_middle(docs(spark, []))).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    df = docs(spark).withColumnRenamed("score", "N").withColumnRenamed("ids", "Form")
    got = fill_in_middle(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "form", "prefix_chars", "middle_chars", "fim"]
    assert {(r.doc_id, r.n) for r in got.collect()} == {slow(r[0], r[1])[:2] for r in ROWS}


def test_rates_and_seed(spark):
    df = docs(spark, MORE)
    assert {r.form for r in fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fill_in_middle(df, rate=100, spm=100).where("text NOT LIKE '%<_>%'").collect()} == {"spm"}
    one, two = (sorted((r.doc_id, r.fim) for r in fill_in_middle(df, seed=s).collect()) for s in ("1", "it's"))
    assert one != two
    assert restored_text(fill_in_middle(df, seed="it's")).where("text <> restored").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab<>PSM é\n\x00🙂"), max_size=12), min_size=20, max_size=60))
def test_any_text_comes_back(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = restored_text(fill_in_middle(df)).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted((slow(k, t) for k, t in enumerate(texts)), key=lambda r: r[0])


def test_long_texts_are_cut_whole(spark):
    rows = [(k, LONG + "z" * k, "de", "a", 1, "x", 1) for k in range(6)]
    got = restored_text(fill_in_middle(docs(spark, rows))).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == [slow(r[0], r[1]) for r in rows]


def test_op11_equals_sql(spark, sf):
    df = op11_fill_in_middle(spark, sf)
    assert spark_rows(df, df.columns) == duck_rows(connect(sf), OP11_SQL, df.columns)
    want = {r.doc_id: slow(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in df.collect():
        assert tuple(r) == (*want[r.doc_id][:5], digest(want[r.doc_id][5]), digest(want[r.doc_id][6]))
