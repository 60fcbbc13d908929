import random

import pytest

from broadsheet.operators import identity
from broadsheet.operators.corpus import Corpus
from broadsheet.sources.log import Conflict

ARRIVAL = "arrival_seq long, publisher_id string, url string, title string, content_hash string, metadata_json string"


def arrivals(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        few = lambda stem, m: rng.choice([None, *(f"{stem}{rng.randrange(m)}" for _ in range(3))])
        page = few("https://e.org/", n // 2)
        rows.append((i, rng.choice([None, "p1", "p2"]), page, few("Story ", n // 2), few("hash", n // 2), rng.choice([None, f'{{"k{i % 3}": {i}}}'])))
    return rows


def told(outcomes, articles):
    columns = sorted(articles.columns)
    return sorted(map(tuple, outcomes.select("arrival_seq", "article_id", "outcome").collect())), sorted(str(tuple(r)) for r in articles.select(*columns).collect())


@pytest.mark.parametrize("cuts", [(30, 80)])
def test_loads_in_turn_equal_one_load(spark, tmp_path, cuts):
    """URLs, hashes and titles link at random, so later loads merge articles and components of earlier ones."""
    rows = arrivals(120, 7)
    stored = Corpus(spark, str(tmp_path / "c"), file_rows=30)
    for low, high in zip((0, *cuts), (*cuts, len(rows)), strict=True):
        stored.load(spark.createDataFrame(rows[low:high], ARRIVAL))
    outcomes, articles = identity.resolve(spark.createDataFrame(rows, ARRIVAL))
    assert told(stored.outcomes(), stored.articles()) == told(outcomes, articles)
    assert articles.where("size(merged_ids) > 0").count() and stored.log.read("parents").count()


def test_a_load_touches_its_components_alone(spark, tmp_path):
    stored = Corpus(spark, str(tmp_path / "c"), file_rows=100)
    many = [(i, "p1", f"https://e.org/{i}", f"T{i}", f"h{i}", None) for i in range(3000)]
    stored.load(spark.createDataFrame(many, ARRIVAL))
    before = stored.log.manifest()
    found = stored.load(spark.createDataFrame([(5000, "p1", "https://e.org/7", "New title", None, None), (5001, None, None, None, "h7", None), (5002, "p2", "https://e.org/new", None, None, None)], ARRIVAL))
    assert {r.arrival_seq: (r.article_id, r.outcome) for r in found.collect()} == {5000: (7, "updated"), 5001: (5001, "created"), 5002: (5002, "created")}
    after = stored.log.manifest()
    assert after["articles"][0] == before["articles"][0] and sum(r["rows"] for r in after["articles"][1:]) == 3
    assert len(before["keys"][0]["files"]) > 50 and stored.log.lookup("keys", spark.createDataFrame([("x",)], "key string")).count() == 0
    assert stored.articles().count() == 3002 and stored.outcomes().count() == 3003


def test_order_emptiness_and_conflict(spark, tmp_path):
    a, b = (Corpus(spark, str(tmp_path / "c")) for _ in range(2))
    one = lambda i: spark.createDataFrame([(i, "p1", "https://e.org/1", "T", "h", None)], ARRIVAL)
    assert a.load(one(5).limit(0)).count() == 0 and a.articles().count() == 0
    a.load(one(5))
    with pytest.raises(ValueError, match="isn't later"):
        b.load(one(5))
    base = a.log.number()
    b.load(one(6))
    with pytest.raises(Conflict):
        a.log.append({"outcomes": (a.log.read("outcomes"), None)}, base)
    assert [r.outcome for r in b.outcomes().orderBy("arrival_seq").collect()] == ["created", "unchanged"]
