"""Personal data: base expressions as seeds, and contexts learned from them.

The seeds of a kind induce lexical patterns: the two words before a mention, or the one that starts its line, and the two
words after it. Looser shapes of each kind (a number without country code, a card that fails
its check digit, an address spelled with [at]) are candidates. Patterns and the values that they stand at form a graph;
Spark scores it in turns: a pattern by the mean score of its values, a value by the chance that any of its patterns is
right, seeds at 1. Candidates at patterns that end with high confidence are discovered; their values are seeds of the next
round, which may raise further patterns, until a round discovers nothing more. The graph is made of mentions, so it grows
with the corpus, but never with the number of words.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, staged, table

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Looser shapes. Each starts and ends at a word's edge, so that a match is whole words.
LOOSE = {
    "email": re.compile(r"(?<!\S)[A-Za-z0-9._%+-]{1,64}\x20?[\[(]at[\])]\x20?[A-Za-z0-9-]{1,63}(?:\x20?[\[(]dot[\])]\x20?[A-Za-z0-9-]{1,63}|\.[A-Za-z0-9-]{1,63}){1,8}(?!\w)"),
    "ip": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    "card": re.compile(r"(?<![\w.-])[0-9]{4}([\x20-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![\w-])"),
    "phone": re.compile(r"(?<![\w+.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])"),
}
#: Words around a mention in its line, parted by few marks: two on either side, or the one before it that starts the line.
BEFORE, FIRST = re.compile(r"([^\W\d_]+)[^\w\n]{1,3}([^\W\d_]+)[^\w\n]{0,3}$"), re.compile(r"[^\w\n]*([^\W\d_]+)[^\w\n]{0,3}$")
AFTER = re.compile(r"[^\w\n]{0,3}([^\W\d_]+)[^\w\n]{1,3}([^\W\d_]+)")
#: Characters on either side that are looked at.
REACH = 80

#: Turns of scoring; least distinct seeds behind a pattern, and its least score, for it to discover anything.
TURNS, MIN_SEEDS, MIN_SCORE = 3, 3, 0.6

_MENTION = "struct<kind:string,start:bigint,end:bigint,pattern:string,value:string,seed:boolean>"
SCHEMA = f"doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<{_MENTION}>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    """Matches of local part and domain; the local part is the whole run of its characters before the sign."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        free = m.end() if m else at + 1
        if m:
            found.append((start, free, "email"))
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order of start, then of KINDS."""
    found = _emails(text) if "@" in text else []
    found += [(*m.span(), "ip") for m in IP.finditer(text) if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


_DIGIT = re.compile("[0-9]")


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a mention, at most one on either side: ``a b _`` or ``^ b _``, and ``_ c d``."""
    out, low = [], max(0, start - REACH)
    line = text.rfind("\n", low, start) + 1
    left, right = text[max(low, line) : start], text[end : end + REACH]
    if m := BEFORE.search(left):
        out.append(f"{m[1]} {m[2]} _".lower())
    elif (line or not low) and (m := FIRST.fullmatch(left)):
        out.append(f"^ {m[1]} _".lower())
    if m := AFTER.match(right):
        out.append(f"_ {m[1]} {m[2]}".lower())
    return out


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[dict]:
    """The seeds and candidates of a text, once for each of their patterns. Candidates don't overlap seeds."""
    found = [(*s, True) for s in base]
    starts, ends = [s for s, _, _ in base], list(accumulate((e for _, e, _ in base), max))
    has_digit = _DIGIT.search(text) is not None
    for kind, shape in LOOSE.items():
        if has_digit if kind != "email" else "[at]" in text or "(at)" in text:
            for m in shape.finditer(text):
                before = bisect_left(starts, m.end())
                if not before or ends[before - 1] <= m.start():
                    found.append((*m.span(), kind, False))
    out = []
    for start, end, kind, seed in found:
        value = re.sub(r"[\s().-]+", "", text[start:end].lower())
        out += [{"kind": kind, "start": start, "end": end, "pattern": p, "value": value, "seed": seed} for p in contexts(text, start, end)]
    return out


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    mention = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string()), ("value", pa.string()), ("seed", pa.bool_())]))
    for batch in batches:
        rows = []
        for text in batch.column(1).to_pylist():
            base = base_spans(text) if text else []
            kinds, said = [s[2] for s in base], joined(base)
            rows.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(said.encode()).hexdigest(), said, mentions(text, base) if text else []))
        columns = list(zip(*rows, strict=True)) or [()] * 7
        arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:4]], *[pa.array(c, pa.string()) for c in columns[4:6]], pa.array(columns[6], mention)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "base", "mentions"])


def pattern_scores(edges: DataFrame, turns: int = TURNS) -> DataFrame:
    """kind, pattern, score, seeds from edges (kind, pattern, value, seed), by scoring patterns and values in turns.

    A pattern's score is damped by one unknown value, so that few values give little confidence. Scores are written out, so
    that both sides of the joins are plain shuffles, whose hot patterns and values Spark splits.
    """
    edges = edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed"))
    scored = edges.withColumn("s", F.col("seed").cast("double"))
    for turn in range(turns):
        patterns = staged(scored.groupBy("kind", "pattern").agg((F.sum("s") / (F.count("*") + 1)).alias("score"), F.count_if("seed").alias("seeds")), "patterns")
        if turn + 1 < turns:
            linked = edges.join(patterns, ["kind", "pattern"])
            values = linked.groupBy("kind", "value").agg(F.max("seed").alias("sure"), (1 - F.exp(F.sum(F.ln(1.0 - F.least("score", F.lit(0.999)))))).alias("p"))
            scored = edges.join(staged(values, "values"), ["kind", "value"]).withColumn("s", F.when(F.col("sure"), 1.0).otherwise(F.col("p")))
    return patterns


def sure_patterns(edges: DataFrame, turns: int = TURNS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """The (kind, pattern) that discover: behind at least ``min_seeds`` distinct seeds and with a score of ``min_score``.

    What they discover are seeds in the next round. Scores only rise from round to round, so rounds end when no value is new.
    """
    while True:
        scores = pattern_scores(edges, turns)
        sure = staged(scores.where((F.col("seeds") >= min_seeds) & (F.col("score") >= min_score)).select("kind", "pattern"), "sure")
        new = staged(edges.where(~F.col("seed")).join(sure, ["kind", "pattern"], "left_semi").select("kind", "value").distinct(), "discovered")
        if new.isEmpty():
            return sure
        seed = F.col("seed") | F.coalesce("new", F.lit(False))
        edges = staged(edges.join(new.withColumn("new", F.lit(True)), ["kind", "value"], "left").select("kind", "pattern", "value", seed.alias("seed")), "graph")


def find_personal_data(docs: DataFrame, turns: int = TURNS, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, one row for each row of docs (doc_id, text).

    Null text is empty; an empty text has no spans and the digest of the empty string. Offsets count code points. spans
    holds the base spans and those that contexts add, by start, then kind.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scan, SCHEMA)
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "mentions")
    edges = rows.where(F.size("mentions") > 0).select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    graph = staged(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "graph")
    sure = sure_patterns(graph, turns, min_seeds, min_score)
    new = edges.where(~F.col("seed")).join(sure, ["kind", "pattern"], "left_semi")
    new = new.groupBy("row").agg(F.collect_set(F.struct("start", "end", "kind")).alias("added"))  # mentions of one text
    whole = rows.join(new, "row", "left")
    order = F.array(*[F.lit(k) for k in KINDS])
    parts = F.when(F.col("base") == "", F.array().cast("array<string>")).otherwise(F.split("base", ","))
    spans = F.transform(parts, lambda p: F.struct(F.split(p, ":")[1].cast("bigint").alias("start"), F.split(p, ":")[2].cast("bigint").alias("end"), F.split(p, ":")[0].alias("kind")))
    ranked = F.array_sort(F.transform(F.concat(spans, F.col("added")), lambda s: F.struct(s["start"].alias("a"), F.array_position(order, s["kind"]).alias("k"), s["end"].alias("e"))))
    said = F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", F.element_at(order, s["k"].cast("int")), s["a"], s["e"])), ",")
    return whole.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", F.when(F.col("added").isNull(), F.col("base")).otherwise(said).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))


def op5_find_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
