import zlib

import numpy as np
import pytest

from broadsheet.llm import packing

EDGE = "doc_id long, text string, part int, left string"


def check(df, spark, expected):
    """Every id in exactly one piece, pieces gapless in their sequence. expected: {doc_id: ids}."""
    found = df.toPandas()
    for doc_id, ids in expected.items():
        mine = found[found.doc_id == doc_id].sort_values("start")
        at = 0
        for r in mine.itertuples():
            assert r.start == at and r.doc_tokens == len(ids)
            assert zlib.crc32(ids[at : at + r.length].tobytes()) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    for _, sequence in found.sort_values("offset").groupby("sequence_id"):
        at = 0
        for r in sequence.itertuples():
            assert r.offset == at
            at += r.length
        assert at <= packing.WINDOW
    return found


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.vocabulary())
    return lambda text: np.array([*whole.encode(text or "", add_special_tokens=False).ids, packing.END_ID], "<u4")


def test_round_trip_and_padding(spark, encode):
    words = "the quick brown Fox, jumps over Ünïcode straße 12.5% (a.b) don't é ΑΣ ΑΣ. x\x01y <|endoftext|>  z\tq\r\nend. ".split(" ")
    draw = np.random.default_rng(0)
    docs = [(i, " ".join(draw.choice(words, int(n)))) for i, n in enumerate(draw.integers(0, 900, 300))]
    docs.append((1000, " ".join(draw.choice(words, 9000))))
    found = check(packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(6), packing.vocabulary()), spark, {i: encode(t) for i, t in docs})
    full = found.sequence_id.nunique() * packing.WINDOW
    assert 1 - found.length.sum() / full < 0.03


def test_edges(spark, encode):
    docs = spark.createDataFrame([(1, None, 1, "x"), (2, "", 1, "x"), (None, "word", 1, "x"), (3, "same", 1, "x"), (3, "same", 1, "x")], EDGE)
    found = packing.pack(docs, packing.vocabulary()).toPandas()
    assert len(found) == 5 and found.doc_id.isna().sum() == 1 and found.sequence_id.nunique() == 1
    assert sorted(found.length) == [1, 1, 2, 2, 2]
    assert packing.pack(docs.limit(0), packing.vocabulary()).count() == 0


def test_many_tasks_merge_in_rounds(spark, encode):
    docs = [(i, "word " * (i % 7)) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    found = check(packing.pack(df, packing.vocabulary(), fan_in=2), spark, {i: encode(t) for i, t in docs})
    assert found.sequence_id.nunique() == 1


def test_cache_is_bounded(encode):
    words = packing.WordTokenizer(packing.vocabulary(), cache_chars=1000)
    texts = ["x" * 1_000_000, " ".join(f"w{i}" for i in range(5000)), "字" * 100_000 + " end", "a b"]
    for text in texts * 2:
        assert words.encode([text]) == [encode(text)[:-1].tobytes()]
        assert words.held <= 1000 and all(len(w) <= packing.CACHED_WORD for w in words.cache)
    assert words.by_word


def test_other_tokenizers_get_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    said = json.loads(Tokenizer.from_file(packing.vocabulary()).to_str())
    said["pre_tokenizer"] = None
    (tmp_path / "other.json").write_text(json.dumps(said))
    other, whole = packing.WordTokenizer(str(tmp_path / "other.json")), Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not other.by_word
    assert other.encode(["two words\nhere"])[0] == np.array(whole.encode("two words\nhere", add_special_tokens=False).ids, "<u4").tobytes()


def test_merging_ends_whatever_the_number_of_partitions(spark, encode, monkeypatch):
    """Groups of a round are known by their number, not by the task that happens to hold them."""
    frame = type(spark.range(0))
    plain = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda self, n, *c: plain(self, max(n, 37) if c else n, *c))
    docs = [(i, "word " * (i % 7)) for i in range(150)]
    df = plain(spark.createDataFrame(docs, "doc_id long, text string"), 12)
    found = check(packing.pack(df, packing.vocabulary(), fan_in=2), spark, {i: encode(t) for i, t in docs})
    assert found.sequence_id.nunique() == 1
