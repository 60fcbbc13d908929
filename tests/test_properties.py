"""Properties that hold for any input."""

import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from broadsheet.functions import dates, texts, urls
from broadsheet.operators import identity
from broadsheet.sources import markup
from broadsheet.sources.articles import article

words = st.text(st.characters(exclude_categories=["Cs"]), max_size=30)
parts = st.text(st.sampled_from("abcXYZ019/%.-_=&+~é"), max_size=30)
links = st.builds(lambda s, h, p, q: f"{s}://{h}/{p}?{q}", st.sampled_from(["http", "HTTPS"]), st.sampled_from(["E.org", "e.org:80", "e.org:443", "a@e.org", "[::1]"]), parts, parts)


@given(links)
@settings(max_examples=300, deadline=None)
def test_normal_urls_are_normal(url):
    once = urls.normalize_or_none(url)
    assert once is None or urls.normalize(once) == once


@given(words)
def test_keys_and_dates_never_fail(text):
    assert texts.key(texts.key(text)) == texts.key(text) or text != text.casefold()
    dates.parse(text)
    assert (dates.problem(text) is None) or dates.parse(text) is None


@given(st.text(st.sampled_from("<>/=\"' abpdivscript!-&;#"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_markup_never_fails(page):
    markup.parse(page).text()
    found = article(page, "https://e.org/")
    assert "<script" not in (found["content_html"] or "")


rows = st.lists(st.tuples(st.sampled_from([None, "https://e.org/1", "https://e.org/2", "https://e.org/1?utm_x=1"]), st.sampled_from([None, "A", "a ", "B"]), st.sampled_from([None, "h1", "h2"]), st.sampled_from([None, "p", "q"])), max_size=8)


@given(rows)
@settings(max_examples=200, deadline=None)
def test_identity_keeps_urls_and_keys_apart(arrivals):
    frame = pd.DataFrame([(i, *r) for i, r in enumerate(arrivals)], columns=["arrival_seq", "url", "title", "content_hash", "publisher_id"])
    frame["canonical_url"] = frame["metadata_json"] = None
    for c in identity.COLUMNS:
        if c not in frame:
            frame[c] = None
    found = identity.fold(frame)
    left = found[found["kind"] == "article"]
    links = [u for u in left["normalized_url"] if u]
    assert len(links) == len(set(links))  # a URL is one article
    told = found[found["kind"] == "arrival"]
    assert len(told) == len(arrivals) and set(told["article_id"]) <= set(left["article_id"])
    created = set(told[told["outcome"] == "created"]["arrival_seq"])
    assert len(left) + sum(len(m) for m in left["merged_ids"]) == len(created)
