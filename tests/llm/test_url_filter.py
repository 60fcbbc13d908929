import duckdb
import numpy as np
import pandas as pd

from broadsheet.llm import url_filter

EDGES = [
    None, "", "example.com/en/1", "https://Example.COM/en/1", "https://www.example.com/en/1", "http://a.www.example.com/en/x?q#f", "https://example.com/fr/1", "https://example.com", "https://com/x", "https://notexample.com/en/1",
    "https://x.net/es/1", "https://net/fr/", "https://x.net/en/", "ftp://ÄÖ.net/es/", "https://x.net?/es/", "https://x.net#/fr/", "x://y://net/es/", "https://u@h.net:80/fr/", "https://a.b.co.uk/x", "://", "https:///p", "https://net./fr/1", "https://x.net/" + "é" * 100_000,
]


def plain(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = ""
    while len(host) < len(rest) and rest[len(host)] not in "/?#":
        host += rest[len(host)]
    path = rest[len(host) :].partition("#")[0].partition("?")[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h, h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[2:] if fits else (None, None))


def frames(spark, pages, outcomes, rules=url_filter.RULES):
    return spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(outcomes, "page_id long, good int"), spark.createDataFrame(list(rules), "host string, path string, verdict string")


def test_hosts_paths_and_rules(spark):
    pages = [(i % 20 or None, u) for i, u in enumerate(EDGES * 3)]
    found = url_filter.judge(*frames(spark, pages, [(3, 1), (3, 0), (None, 0), (5, None), (99, 1)])).toPandas()
    assert len(found) == len(pages)
    expected = sorted(str((i, *plain(u)[:3])) for i, u in pages)
    assert sorted(str((None if pd.isna(r.page_id) else int(r.page_id), r.host, r.path, None if pd.isna(r.rule) else r.rule)) for r in found.itertuples()) == expected
    ruled = found[found.rule.notna()]
    assert (ruled.verdict == ruled.rule.map({h + p: v for h, p, v in url_filter.RULES})).all()


def test_bad_hosts_are_blocked_and_few_outcomes_are_shrunk(spark):
    rng, pages, outcomes = np.random.default_rng(1), [], []
    for host in range(120):
        bad = host % 10 == 0
        for k in range(40):
            pages.append((len(pages), f"https://h{host}.{'farm' if bad else f'site{host % 7}'}.org/{k}"))
            outcomes.append((len(pages) - 1, int(rng.random() < (0.05 if bad else 0.85))))
    pages += [(len(pages), "https://new.farm.org/"), (len(pages) + 1, "https://new.site1.org/"), (len(pages) + 2, "https://lucky.farm.org/"), (len(pages) + 3, "https://unlucky.site2.org/"), (len(pages) + 4, "https://far.away.info/")]
    outcomes += [(len(pages) - 3, 1), (len(pages) - 2, 0)]
    found = url_filter.judge(*frames(spark, pages, outcomes, [("nowhere", "/", "block")])).toPandas()
    verdict = found.groupby("host").verdict.first()
    for host in range(120):
        name = f"h{host}.{'farm' if host % 10 == 0 else f'site{host % 7}'}.org"
        assert verdict[name] == ("block" if host % 10 == 0 else "allow")
    assert verdict["new.farm.org"] == verdict["lucky.farm.org"] == "block"  # by their domain
    assert verdict["new.site1.org"] == verdict["unlucky.site2.org"] == verdict["far.away.info"] == "allow"


def test_longest_rule_and_then_longer_host(spark):
    rules = [("a.com", "/x/", "block"), ("b.a.com", "/", "allow"), ("com", "/x/yy", "block"), ("a.com", "/x/yyy", "allow")]
    pages = [(1, "https://b.a.com/x/1"), (2, "https://b.a.com/x/yyy"), (3, "https://a.com/x/yyz"), (4, "https://b.a.com/z")]
    found = {r.page_id: r.rule for r in url_filter.judge(*frames(spark, pages, [], rules)).collect()}
    assert found == {1: "b.a.com/", 2: "a.com/x/yyy", 3: "a.com/x/", 4: "b.a.com/"}


def test_empty_and_clashing(spark):
    pages, outcomes, rules = frames(spark, [], [])
    assert url_filter.judge(pages, outcomes, rules).count() == 0
    one = spark.createDataFrame([(1, "https://a.org/", "h", "r", 3)], "page_id long, url string, host string, rule string, n int")
    assert [r.verdict for r in url_filter.judge(one, outcomes, rules.limit(0)).collect()] == ["allow"]


def test_plan_is_native(spark, tmp_path):
    spark.createDataFrame([(1, "https://a.org/", "<p>")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    plan = url_filter.op11_filter_urls(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "html" not in plan and "Cartesian" not in plan


def test_sql(spark, tmp_path):
    hosts = ["a.example.net", "b.example.net", "c.other.org", "d.other.co.uk", "e.x.co.uk", ""]
    pages = [(i, f"https://{hosts[i * i % 7 % 6]}/{'enfres'[i % 6 : i % 6 + 2]}/{i}") for i in range(900)] + [(i, u) for i, u in enumerate(EDGES[:-1])]
    spark.createDataFrame(pages, "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i, None if i % 11 == 0 else int(i % 7 < i % 5)) for i in range(700)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    with duckdb.connect() as c:
        for t in ("pages", "labels"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        expected = c.sql(url_filter.OP11_SQL).fetchall()
    assert sorted(str(tuple(r)) for r in url_filter.op11_filter_urls(spark, str(tmp_path)).collect()) == sorted(map(str, expected))
