"""The report: sections as frames, one projection, and its renderings.

Sections are one row a publisher or less, so collecting them is bounded by the registry, not by the articles.
"""

from __future__ import annotations

import csv
import html
import io
import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import classify
from broadsheet.operators import joins, latest, reporting, rollups
from broadsheet.operators.candidates import canonical_kind
from broadsheet.sources.scratch import staged

METRICS = ("discovered", "fetched", "stored", "already_known", "duplicate_candidate", "error_count")


def publisher_rows(publishers: DataFrame, sources: DataFrame, articles: DataFrame, links: DataFrame, results: DataFrame) -> DataFrame:
    """One row a publisher: counts, latest article, result of the run, status, completion and priority.

    links: article_id, source_id. results: publisher_id, status, source_status, error_category of one run; a repeated result
    counts once and is named as such.
    """
    by_source = sources.select(F.col("id").alias("source_id"), "publisher_id", "enabled", "status", "success")
    counts = by_source.groupBy("publisher_id").agg(
        F.count("*").alias("sources"), F.count_if("enabled").alias("enabled_sources"),
        F.count_if(F.coalesce(F.col("status"), F.lit("")).isin("error", "failed", "failure", "partial", "warning", "completed_with_errors", "unsupported")).alias("bad"),
        F.count_if(F.coalesce(F.col("success"), F.lit(False)) | F.coalesce(F.col("status"), F.lit("")).isin("completed", "ok", "success", "healthy")).alias("good"),
    )
    of = links.join(by_source.select("source_id", "publisher_id"), "source_id").select("publisher_id", "article_id").distinct()
    news = of.join(articles.select(F.col("id").alias("article_id"), "published_at"), "article_id").groupBy("publisher_id").agg(F.count("*").alias("articles"), F.max("published_at").alias("latest_at"))
    one = results.groupBy("publisher_id").agg(F.count("*").alias("results"), F.min(F.struct("status", "source_status", "error_category")).alias("r"))
    x = publishers.select(F.col("id").alias("publisher_id"), "name", "enabled").join(counts, "publisher_id", "left").join(news, "publisher_id", "left").join(one, "publisher_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    status = classify.publisher_status(F.col("enabled"), zero("sources"), zero("articles"), zero("bad"), zero("good"), F.col("r.status"))
    status = F.when(F.col("enabled") & (zero("results") == 0), "missing_result").when(F.col("enabled") & (zero("results") > 1), "duplicate_result").otherwise(status)
    category = classify.completion(F.col("r.error_category"), F.col("r.source_status"), F.col("r.status"))
    return x.select(
        "publisher_id", "name", "enabled", *[zero(c).alias(c) for c in ("sources", "enabled_sources", "articles", "results")], "latest_at", status.alias("status"), category.alias("category"),
        classify.public_class(category).alias("completion"), classify.severity(status).alias("severity"),
    )


def _shown(row) -> dict:
    """A row as plain values; times as ISO text."""
    return {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in row.asDict(recursive=True).items()}


def projection(publishers: DataFrame, sources: DataFrame, articles: DataFrame, links: DataFrame, runs: DataFrame, stats: DataFrame, results: DataFrame, now=None, config_error: str | None = None, generation: dict | None = None) -> dict:
    """The whole report of the latest run as one plain document, at ``now`` (a time, by default the present).

    All frames have the store's columns. generation: what made the report (id, commit), as it is to be shown.
    """
    at = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    two = {r["place"]: r for r in latest.latest_two(runs, [F.col("started_at").desc_nulls_last(), F.col("finished_at").desc_nulls_last(), F.desc("id")]).collect()}
    run, previous = (two[p].asDict() if p in two else {} for p in (1, 2))
    of = lambda df, r: df.where(F.col("run_id") == F.lit(r.get("id")))
    now_stats, now_results = of(stats, run), of(results, run)

    findings = staged(reporting.article_findings(articles, links, sources, publishers, at), "findings")
    own = reporting.publisher_findings(publishers, sources, links, articles, now_results)
    told = findings.select("publisher_id", "code").distinct()
    per_publisher = findings.select("publisher_id", "code").unionByName(own.join(told, ["publisher_id", "code"], "left_anti"))
    codes = per_publisher.groupBy("publisher_id").agg(F.array_sort(F.collect_set("code")).alias("quality_codes"))
    counts = reporting.publisher_counts(publishers, sources, links, now_stats, now_results, per_publisher)
    one = now_results.groupBy("publisher_id").agg(F.min_by(F.struct(*[c for c in ("source_url", "http_status", "error_category", "error_summary", "stop_reason", "status", "source_status") if c in now_results.columns]), "id").alias("r"))
    urls_of = sources.groupBy("publisher_id").agg(F.array_sort(F.collect_set("url")).alias("source_urls"), F.array_sort(F.collect_set(canonical_kind(F.col("kind")))).alias("adapters"))
    about = publishers.select(F.col("id").alias("publisher_id"), "slug", "website_url", "country_code", "language", "region", "city", "groups")
    rows = publisher_rows(publishers, sources, articles, links, now_results)
    for part in (about, counts.drop("articles"), codes, one, urls_of):
        rows = rows.join(part, "publisher_id", "left")
    rows = [_shown(r) for r in rows.orderBy("severity", F.desc("warnings"), F.lower("name"), "publisher_id").collect()]
    enabled = [r for r in rows if r["enabled"]]

    failed = reporting.failures(now_results, now_stats)
    failures = [_shown(r) for r in failed.orderBy("class").collect()]
    histogram = reporting.quality_histogram(findings, own)
    scope = reporting.roster_scope(publishers)
    checks = reporting.criteria(scope, publishers, sources, run.get("id"), run.get("status"), now_results, failed, histogram, articles, len(rows), config_error)
    checks = [_shown(r) for r in checks.orderBy("place").collect()]
    change = [_shown(r) for r in rollups.relative_change(now_stats, of(stats, previous), list(METRICS)).orderBy("metric").collect()]
    recent = latest.top_per_key(
        reporting.associations(links, sources).select("publisher_id", "article_id").distinct().join(articles.select(F.col("id").alias("article_id"), "title", "published_at", F.coalesce("canonical_url", "normalized_url").alias("url")), "article_id"),
        ["publisher_id"], [F.col("published_at").desc_nulls_last(), F.lower("title"), F.asc("article_id")], 3, "place",
    ).orderBy("publisher_id", "place").collect()
    cover = joins.coverage(publishers.where("enabled").select(F.col("id").alias("publisher_id")), now_results, ["publisher_id"]).groupBy("state").agg(F.count("*").alias("n"))
    totals = {n: sum(r[n] or 0 for r in rows) for n in reporting.COUNTS if n in rows[0]} if rows else dict.fromkeys(reporting.COUNTS, 0)
    live = sources.where("enabled").agg(F.count("*").alias("n"), F.count_if(F.col("status").isNotNull() | F.col("success").isNotNull()).alias("registered")).first()
    passed = all(c["status"] == "PASS" for c in checks)
    return {
        "schema_version": 1, "generation": generation or {}, "run_id": run.get("id"), "previous_run_id": previous.get("id"),
        "run": {k: v.isoformat() if hasattr(v, "isoformat") else v for k, v in run.items() if k in ("id", "batch_id", "status", "started_at", "finished_at", "duration_ms", "stop_reason", "error")},
        "scope": _shown(scope.first()), "publishers": rows, "totals": totals,
        "completion": {c: sum(r["completion"] == c for r in enabled) for c in dict.fromkeys(classify.PUBLIC.values())},
        "categories": {c: sum(r["category"] == c for r in enabled) for c in classify.PUBLIC},
        "coverage": {r["state"]: r["n"] for r in cover.collect()},
        "sources": {"enabled": live["n"], "registered": live["registered"], "percent": round(live["registered"] * 100 / live["n"], 2) if live["n"] else 0.0},
        "change": change, "adapters": [_shown(r) for r in reporting.adapter_stats(sources, links).orderBy("kind").collect()],
        "quality": {r["code"]: r["n"] for r in histogram.orderBy("code").collect()}, "failures": failures,
        "external_limited": any(f["external"] for f in failures), "recent": [_shown(r) for r in recent],
        "issues": [f"{r['name']}: {r['status']}" for r in enabled if r["severity"] == 0], "checks": checks,
        "verdict": "PASS" if passed else "FAIL" if run else "INCOMPLETE",
    }


#: Columns of the table of publishers: name -> where the value is found.
CSV = {
    "generation_id": lambda p, r: p["generation"].get("id"), "commit": lambda p, r: p["generation"].get("commit"), "scope": lambda p, r: p["scope"]["status"], "acceptance_status": lambda p, r: p["verdict"],
    "expanded_roster_available": lambda p, r: p["scope"]["available"], "configured_publishers": lambda p, r: p["scope"]["configured"], "enabled_publishers": lambda p, r: p["scope"]["enabled"], "expanded_publishers": lambda p, r: p["scope"]["expanded"],
    "roster_source": lambda p, r: p["scope"]["source"], "roster_version": lambda p, r: p["scope"]["version"], "roster_sha256": lambda p, r: p["scope"]["sha256"],
    **{n: (lambda n: lambda p, r: r[n])(n) for n in ("publisher_id", "slug", "name")}, "website": lambda p, r: r["website_url"],
    **{n: (lambda n: lambda p, r: r[n])(n) for n in ("country_code", "language", "region", "city")}, "groups": lambda p, r: ";".join(r["groups"] or []), "enabled": lambda p, r: r["enabled"],
    "completion_classification": lambda p, r: r["completion"], "completion_category": lambda p, r: r["category"], "source_status": lambda p, r: _of(r, "source_status"), "status": lambda p, r: r["status"], "status_raw": lambda p, r: _of(r, "status"),
    "result_issue": lambda p, r: r["status"] if r["status"] in ("missing_result", "duplicate_result") else None, "results": lambda p, r: r["results"], "official_site": lambda p, r: r["website_url"], "news_source_url": lambda p, r: ";".join(r["source_urls"] or []),
    "adapter": lambda p, r: ";".join(r["adapters"] or []), "http_status": lambda p, r: _of(r, "http_status"),
    **{n: (lambda n: lambda p, r: r.get(n, 0))(n) for n in reporting.COUNTS}, "warning_count": lambda p, r: r["warnings"], "quality_codes": lambda p, r: ";".join(r["quality_codes"] or []),
    "failure_class": lambda p, r: _of(r, "error_category"), "external_limited": lambda p, r: p["external_limited"], "latest_news_date": lambda p, r: (r["latest_at"] or "")[:10], "wall_duration_ms": lambda p, r: p["run"].get("duration_ms"),
    "error_category": lambda p, r: _of(r, "error_category"), "error_summary": lambda p, r: _of(r, "error_summary"), "stop_reason": lambda p, r: _of(r, "stop_reason"), "run_id": lambda p, r: p["run_id"], "run_status": lambda p, r: p["run"].get("status"),
    "relative_change": lambda p, r: json.dumps({c["metric"]: c["change"] for c in p["change"]}, sort_keys=True), "evidence_path": lambda p, r: f"run:{p['run_id']}/publisher:{r['publisher_id']}",
}


def _of(row: dict, name: str):
    return (row.get("r") or {}).get(name)


def as_json(report: dict) -> bytes:
    return json.dumps(report, indent=2, sort_keys=True, ensure_ascii=False).encode()


def as_csv(report: dict) -> bytes:
    """One row a publisher. A cell that a spreadsheet would run is kept as text."""
    out = io.StringIO()
    writer = csv.DictWriter(out, list(CSV), lineterminator="\n")
    writer.writeheader()
    for row in report["publishers"]:
        cells = {n: value(report, row) for n, value in CSV.items()}
        writer.writerow({n: str(v).lower() if isinstance(v, bool) else f"'{v}" if isinstance(v, str) and v[:1] in "=+-@" and v else v for n, v in cells.items()})
    return out.getvalue().encode()


def as_articles(report: dict, articles: list[dict]) -> bytes:
    """The articles of the report with its head. For many, use write_articles()."""
    head = {k: report[k] for k in ("schema_version", "generation", "run_id", "scope", "verdict", "totals", "completion", "checks")}
    return json.dumps(head | {"articles": articles}, indent=2, sort_keys=True, ensure_ascii=False).encode()


def write_articles(articles: DataFrame, path: str) -> None:
    """All articles as JSON lines, written by the executors. articles: reporting.safe_articles()."""
    articles.write.mode("overwrite").json(path)


def _cell(value) -> str:
    return str("" if value is None else value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")


def _code(value) -> str:
    """A text as code: fenced by more marks than it has in a row."""
    text = str("" if value is None else value).replace("\n", " ")
    longest = max((len(m) for m in re.findall("`+", text)), default=0)
    pad = " " if text[:1] == "`" or text[-1:] == "`" else ""
    return f"{'`' * (longest + 1)}{pad}{text}{pad}{'`' * (longest + 1)}" if text else ""


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(_cell(v) for v in row) + " |" for row in rows]]


def _listed(values: dict) -> list[str]:
    return [f"- {_code(k)}: {v}" for k, v in values.items()] or ["None recorded."]


def as_markdown(report: dict) -> bytes:
    p, scope, run = report, report["scope"], report["run"]
    lines = [f"# Report of run {_cell(p['run_id'])}", "", f"Verdict: **{p['verdict']}**", "", "## Acceptance scope", "", f"- Roster: {_cell(scope['status'])}; {scope['configured']} publishers configured, {scope['enabled']} enabled, {_cell(scope['expanded']) or 'no'} expanded.", f"- Origin: {_code(scope['source']) or 'not supplied'} {_cell(scope['version'])} {_code(scope['sha256'])}"]
    lines += ["", "## Coverage and run counts", "", f"Sources registered: {p['sources']['registered']} of {p['sources']['enabled']} ({p['sources']['percent']} %). Results: " + ", ".join(f"{k} {v}" for k, v in sorted(p["coverage"].items()))]
    lines += [f"Run {_code(run.get('status'))}: {_cell(run.get('started_at'))} to {_cell(run.get('finished_at'))}, {_cell(run.get('duration_ms'))} ms", "Totals: " + ", ".join(f"{k}={v}" for k, v in p["totals"].items())]
    for title, values in (("Completion classifications", p["completion"]), ("Completion categories", p["categories"]), ("Quality warnings", p["quality"])):
        lines += ["", f"## {title}", "", *_listed(values)]
    lines += ["", "## External limitations", "", *_listed({f["class"]: f["n"] for f in p["failures"] if f["external"]}), "", "## Blocking failures", "", *_listed({f["class"]: f["n"] for f in p["failures"] if f["blocking"]})]
    names = ["kind", "configured", "enabled", "registered", "successful", "failed", "associations", "unique_articles"]
    lines += ["", "## Adapters", "", *_table(names, [[a[n] for n in names] for a in p["adapters"]])]
    lines += ["", "## Known issues", "", *([f"- {_cell(i)}" for i in p["issues"]] or ["None recorded."])]
    lines += ["", f"## Change since run {_cell(p['previous_run_id']) or 'none'}", "", *_table(["metric", "latest", "previous", "change"], [[c["metric"], c["latest"], c["previous"], f"{c['change']:+d}"] for c in p["change"]])]
    lines += ["", "## End criteria", "", *[f"- [{'x' if c['status'] == 'PASS' else ' '}] {_cell(c['id'])}: {_cell(c['detail'])}" for c in p["checks"]]]
    shown = {"publisher": "name", "country": "country_code", "region": "region", "status": "status", "completion": "completion", "sources": "sources", "articles": "articles", **{n: n for n in ("discovered", "parsed", "inserted", "failed")}, "latest": "latest_at", "ms": "duration_ms"}
    lines += ["", "## Publishers", "", *_table(list(shown), [[r.get(c) for c in shown.values()] for r in p["publishers"]]), "", "## Recent articles", ""]
    name_of = {r["publisher_id"]: r["name"] for r in p["publishers"]}
    for publisher in dict.fromkeys(a["publisher_id"] for a in p["recent"]):
        lines += [f"### {_cell(name_of.get(publisher, publisher))}", *[f"- {_cell(a['title']) or '(untitled)'}, {_cell(a['published_at']) or 'undated'}, {_code(a['url'])}" for a in p["recent"] if a["publisher_id"] == publisher]]
    return ("\n".join([*lines, *([] if p["recent"] else ["None recorded."])]) + "\n").encode()


def as_html(report: dict) -> bytes:
    """One page that holds its data; nothing in the data can end the script element."""
    data = json.dumps(report, ensure_ascii=True).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026")
    rows = "".join(f"<tr><td>{html.escape(str(r['name']))}</td><td>{html.escape(r['status'])}</td><td>{html.escape(str(r['completion']))}</td><td>{r['articles']}</td></tr>" for r in report["publishers"])
    checks = "".join(f"<li>{html.escape(c['status'])} {html.escape(c['id'])}: {html.escape(str(c['detail']))}</li>" for c in report["checks"])
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Report</title></head><body><h1>{html.escape(str(report["verdict"]))}</h1><ul>{checks}</ul><table>{rows}</table><script type="application/json" id="report">{data}</script></body></html>'.encode()


def render(report: dict, articles: list[dict] | None = None) -> dict[str, bytes]:
    """The report's files; articles.json holds the given articles, by default the recent ones of each publisher."""
    return {"report.json": as_json(report), "publishers.csv": as_csv(report), "articles.json": as_articles(report, report["recent"] if articles is None else articles), "report.md": as_markdown(report), "report.html": as_html(report)}


def event_page(events: DataFrame, publishers: DataFrame, sources: DataFrame, run_id: str, after: int | None = None, limit: int = 50, **filters) -> DataFrame:
    """A page of a run's events with names of publisher and source; null for orphans. Filters compare whatever the case."""
    from broadsheet.operators import paging

    x = events.where(F.col("run_id") == run_id)
    for name, value in filters.items():
        if value is not None and name != "text":
            x = x.where(F.lower(F.col(name)) == str(value).lower())
    if filters.get("text"):
        said = F.lower(F.concat_ws(" ", F.col("id").cast("string"), "level", "component", "event_type", "message", "publisher_id", "source_id", "metadata"))
        x = x.where(F.contains(said, F.lit(filters["text"].lower())))
    page = paging.keyset_page(x, "id", after, limit)
    page = joins.enrich(page, publishers.withColumnRenamed("id", "publisher_id"), "publisher_id", {"name": "publisher_name"})
    return joins.enrich(page, sources.withColumnRenamed("id", "source_id"), "source_id", {"name": "source_name", "kind": "source_kind"}).orderBy("id")


def batches(runs: DataFrame, stats: DataFrame) -> DataFrame:
    """Batches with their runs, newest first, each with its publishers' sums."""
    by = stats.groupBy("run_id", "publisher_id").agg(*[rollups.total(F.col(m)).alias(m) for m in METRICS])
    per_run = by.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("publisher_id", *METRICS))).alias("publishers"))
    x = runs.join(per_run.withColumnRenamed("run_id", "id"), "id", "left").withColumn("place", F.row_number().over(W.partitionBy("batch_id").orderBy(F.col("started_at").desc_nulls_last(), F.desc("id"))))
    return x.groupBy("batch_id").agg(F.max("started_at").alias("started_at"), F.array_sort(F.collect_list(F.struct("place", F.col("id").alias("run_id"), "status", "publishers"))).alias("runs"))
