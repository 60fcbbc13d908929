import duckdb
import pandas as pd

from broadsheet.llm import line_templates

LONG = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


def test_variable_fields_and_first_document(spark):
    rows = [
        (1, "Title one\nPosted by Ann on 12 May in the news desk\nunique alpha beta", 1, 9),
        (2, "Posted by Bob on 3 May in the news desk\nother delta words", 1, 9),
        (3, "x y z\nPosted by Cy on 7 May in the news desk", 1, 9),
        (4, f"{LONG}\nfirst of its kind", 1, 9),
        (5, f"clean words here\n{LONG}", 1, 9),
        (6, "wholly clean text\nnothing to see", 1, 9),
        (7, "copied text line\nanother copied line", 1, 9),
        (8, "copied text line\nanother copied line", 1, 9),
        (9, "copied text line\nanother copied line", 1, 9),
    ]
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, lines int, n_chars long")).collect()}
    assert found[1].text == rows[0][1] and found[1].recurring == 1
    assert found[2].text == "other delta words" and found[2].n_chars == 17
    assert found[3].text == "x y z"
    assert found[4].text == rows[3][1] and found[5].text == "clean words here"
    assert all(found[i].text == rows[i - 1][1] and not found[i].recurring for i in (6, 7, 8, 9))
    gone = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string, lines int, n_chars long"), keep_first=False).collect()}
    assert gone[1].text == "Title one\nunique alpha beta" and gone[6].text == rows[5][1]


def test_edges_and_sql(spark, tmp_path):
    rows = [(1, None), (None, ""), (2, "a\n\nb"), (3, "\n"), (5, "one two three"), (5, "one two three"), (6, "a\none two three"), (None, "one two three\nx"), (7, LONG + "\n" + LONG), (8, "1 2 3 and"), (9, "4 5 6 and"), (10, "7 8 9 and"), (11, "1 2 3 and\nz"), (12, "1 2 3 and\ny")]
    rows += [(20 + i, f"Les.\r\ntab\tparted\tline\nown {chr(97 + i)} line\n{'字' * 60}\n\t") for i in range(3)] + [(30, "字" * 60 + "\nLes."), (31, "字" * 19 + f"\n{'字' * 19}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    with duckdb.connect() as c:
        c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        expected = c.sql(line_templates.OP9_SQL).df()
    said = lambda f: sorted(str([None if pd.isna(x) else x if isinstance(x, str) else float(x) for x in r]) for r in f[sorted(f.columns)].astype(object).values.tolist())
    assert said(line_templates.op9_drop_template_lines(spark, str(tmp_path)).toPandas()) == said(expected)
    assert line_templates.drop_recurring_lines(docs.limit(0)).count() == 0


def test_short_and_unspaced_lines(spark):
    rows = [(i, f"Les.\r\nwhat {chr(97 + i)} says\n\n{'字' * 60 if i < 2 else ''}\ntwo\twords") for i in range(3)]
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[0].text == rows[0][1] and found[0].recurring == 3
    assert found[1].text == "what b says\n" and found[2].text == "what c says\n\n"


def test_many_lines_in_linear_time(spark):
    import time

    def lines(n, mark):
        return "\n".join(f"{mark} line {'abcdefghij'[i % 10]} {i:x}".translate(str.maketrans("0123456789", "ghijklmnop")) for i in range(n))

    docs = [(d, lines(n, "m")) for d, n in ((0, 100_000), (1, 100_000), (2, 50_000))]
    docs = [(d, f"own {'xyz'[d]} head\n{t}") for d, t in docs]
    began = time.time()
    found = {r.doc_id: r for r in line_templates.drop_recurring_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert time.time() - began < 60
    assert found[2].text == "own z head" and found[1].lines == 100_001 and found[1].dropped == 50_000
    assert found[1].text.count("\n") == 50_000
