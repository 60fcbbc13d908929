import hashlib
import zlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from broadsheet.llm import line_templates, mixing, ngram_join, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    letters = "abcdefghij"
    named = lambda i, j: "w" + "".join(letters[int(d)] for d in f"{i:03d}{j:02d}")
    plain = [f"text {i} " + " ".join(named(i, j) for j in range(40)) for i in range(120)]
    rows = [(i, f"All rights reserved to nobody\n{t}", "en", f"s{i % 3}", len(t)) for i, t in enumerate(plain)]
    rows += [(200 + i, plain[i].replace(named(i, 39), named(500 + i, 39)), "en", "s0", 1) for i in range(4)]
    rows += [(300 + i, plain[i] + " zoggish zoggan zoggor" + f" tail{i}" * 30, "en", "s1", 1) for i in range(50)]
    rows += [(400, None, None, None, None), (401, "", "en", "s2", 0)]
    return rows


def defined(before, sql):
    """What a stage's definition in SQL gives for its input."""
    with duckdb.connect() as c:
        files = ", ".join(f"'{f.removeprefix('file://')}'" for f in before.inputFiles())
        c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet([{files}])")
        return c.sql(sql).df()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest() if text is not None else None


def check_pieces(before, pieces):
    """Every id of every document is in one piece, at its place; pieces of a sequence are gapless."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    found = pieces.toPandas()
    times = before.groupBy("doc_id", "text").count().toPandas()
    assert len(found[found.start == 0]) == times["count"].sum()
    for doc_id, mine in found.groupby("doc_id", dropna=False):
        text, n = next((r.text, r.count_) for r in times.rename(columns={"count": "count_"}).itertuples() if r.doc_id == doc_id)
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        assert mine.length.sum() == n * len(ids) and (mine.doc_tokens == len(ids)).all()
        covered = np.zeros(len(ids), int)
        for r in mine.itertuples():
            covered[r.start : r.start + r.length] += 1
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert (covered == n).all()
    for _, held in found.sort_values("offset").groupby("sequence_id"):
        assert held.offset.tolist() == [0, *held.length.cumsum().tolist()[:-1]] and held.length.sum() <= packing.WINDOW


def test_stages(spark, tmp_path):
    """Each stage against its definition: labels, SQL over all lines, all pairs and the whole queue, and the tokenizer."""
    rows = corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(r[0], 0, int("zogg" in (r[1] or ""))) for r in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        if name == "toxicity":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in rows if "zogg" not in (r[1] or "")}
        elif name == "line_dedup":
            assert docs.where("text like '%All rights%'").count() == 1 and docs.count() == before.count()
            expected = defined(before, line_templates.OP9_SQL)
            assert {r.doc_id: sha(r.text) for r in docs.collect()} == {r.doc_id: r.kept_sha256 if isinstance(r.kept_sha256, str) else None for r in expected.itertuples()}
        elif name == "near_duplicates":
            gone = {r.doc_id for r in before.collect()} - {r.doc_id for r in docs.collect()}
            expected = defined(before, ngram_join.OP1_SQL)
            assert gone == set(expected[~expected.representative].doc_id) == {200, 201, 202, 203}
        elif name == "mix":
            expected = defined(before, mixing.OP7_SQL)
            times = {r.doc_id: r.taken // r.size for r in expected.itertuples() if r.taken}
            assert {r.doc_id: r["count"] for r in docs.groupBy("doc_id").count().collect()} == times
        else:
            check_pieces(before, docs)
        if name != "packing":
            assert docs.columns == names
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert again.groupBy("doc_id").sum("length").exceptAll(docs.groupBy("doc_id").sum("length")).count() == 0


def test_columns_of_the_input_stay_as_they_are(spark, tmp_path):
    """Columns named as those that stages work with pass through all stages but the last."""
    own = ["lines", "recurring", "dropped", "score", "fp", "place", "text_hash", "size", "rank", "cum", "row", "first", "line", "gone", "finish"]
    spark.createDataFrame([(r[0], 0, int("zogg" in (r[1] or ""))) for r in corpus()], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(corpus(), COLUMNS)
    docs = docs.select("*", *[(F.coalesce("doc_id", F.lit(0)) * 100 + i).alias(c) for i, c in enumerate(own)])
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.staged(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == names
        odd = F.lit(False)
        for i, c in enumerate(own):
            odd = odd | (F.col(c) != F.coalesce("doc_id", F.lit(0)) * 100 + i)
        assert docs.count() and not docs.where(odd).count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()
