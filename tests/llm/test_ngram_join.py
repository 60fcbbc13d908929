import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from broadsheet.llm import ngram_join
from broadsheet.operators import components


def plain(docs):
    """class (least id) and links of each document, from all pairs."""
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    links, root = defaultdict(int), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (find(i), links[i]) for i in sets}


def families(draw, groups, members, edits):
    vocabulary = np.array([f"w{i}" for i in range(4000)])
    docs = []
    for _ in range(groups):
        base = draw.choice(vocabulary, draw.integers(30, 200))
        for _ in range(members):
            words = base.copy()
            at = draw.integers(0, len(words), draw.integers(0, edits))
            words[at] = draw.choice(vocabulary, len(at))
            docs.append((len(docs), " ".join(words)))
    return docs


@pytest.mark.parametrize("groups, members, block", [(60, 4, 512), (1, 260, 60)])
def test_equals_all_pairs(spark, monkeypatch, groups, members, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = families(np.random.default_rng(groups), groups, members, 5)
    docs += [(len(docs) + i, docs[0][1].upper()) for i in range(20)]
    found = ngram_join.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.n_links) for r in found} == plain(docs)
    assert sum(r.first for r in found) == len({r.class_id for r in found})


def test_edges(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "one two", 1), (4, "One, two!", 1), (5, "one two three", 1), (5, "other", 1), (None, "one two", 1), (6, "x " * 50_000, 1), (6, "x " * 50_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, text_hash int")
    found = pytest.rows(ngram_join.near_duplicates(docs), "doc_id", "class_id", "n_links", "first")
    assert found == sorted([(None, 3, 2, False), (1, 1, 0, True), (2, 2, 0, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 0, True), (5, 5, 0, True), (6, 6, 1, False), (6, 6, 1, True)], key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == 6 and {r.text_hash for r in kept.collect()} == {1}
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_bayes_thresholds():
    least = ngram_join.least_matches(0.8)
    assert (np.diff(least) > 0).all() and 0.5 * ngram_join.HASHES < least[-1] < 0.8 * ngram_join.HASHES


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    found = dict(tuple(r) for r in components.components(spark.createDataFrame(path, "u long, v long")).collect())
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
