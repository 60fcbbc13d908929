"""Repair of the structure of conversations: the cheapest edits that make turns alternate, and of those the least by letters.

A conversation that is in order has nothing, or perhaps a system turn and then pairs of user and assistant turns. Each row
is kept (K), given another role (R) or deleted (D); rows without text or with an earlier row's role and text must go; rows
that break off cost more unless deleted; empty turns may be inserted (I) anywhere. Nodes of the graph are (rows consumed,
state of the order), arcs are edits. Forward and backward least costs find the arcs on cheapest paths, which are the tight
ones: forward cost + own cost + backward cost is the optimum. A traversal carries the set of nodes that the letters so far
can have led to, and takes the least letter that leaves it by a tight arc.

Rows are range-sorted by conversation and turn, so a conversation of any length spreads over tasks, and a task reads its
range as a stream. Conversations that begin and end inside a range are repaired there and then. The first and last one of
a range, and those of more than HELD characters, are handed on as rows: they are cut into segments, each segment becomes a
matrix of least costs between states (costs over segments are min-plus products), forward and backward costs at the cuts
follow from the matrices, and each segment is then traversed by itself, from every state that it can be entered in.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, shuffle_partitions, staged, table
from .resampling import CRC_TABLE_SQL, crc32_sql

#: Costs of edits; of a row that breaks off and isn't deleted.
REROLE, DELETE, INSERT, BROKEN = 1, 2, 5, 5
#: Rows of a segment; characters that a task holds of one conversation.
SEGMENT, HELD = 65_536, 4_000_000
SPACE = " \t\n\x0b\x0c\r"
INF = 1 << 60

#: States of the order: nothing yet, after system, after user, after assistant. A conversation may end in ENDS.
STATES, START, ENDS = range(4), 0, (0, 3)
#: Where a turn of a role leads from a state.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Each state's turns that can be inserted, or given to a row of another role.
MADE = {q: [(r, to) for (at, r), to in NEXT.items() if at == q and r != "s"] for q in STATES}

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
COUNTS = ("blank", "duplicate", "truncated")


def fault(text: str) -> str:
    """b (no character besides ASCII white space), t (the last such is no end of a sentence) or nothing."""
    said = text.rstrip(SPACE)
    return "b" if not said else "" if said[-1] in ".!?" else "t"


def code(role: str, fault: str) -> str:
    """One letter for what the costs of a row depend on: x must go; s, u, a, o by role; in upper case if it breaks off."""
    if fault in ("b", "d"):
        return "x"
    kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return kind.upper() if fault == "t" else kind


def arcs(row: str, state: int) -> list[tuple[str, int, int, str]]:
    """Edits of a row (its code) in a state: letter, cost, next state, role given."""
    found = [("D", DELETE, state, "")]
    if row != "x":
        extra = BROKEN if row.isupper() else 0
        if (state, row.lower()) in NEXT:
            found.append(("K", extra, NEXT[state, row.lower()], ""))
        found.extend(("R", REROLE + extra, to, r) for r, to in MADE[state])
    return found


ARCS = {(row, q): arcs(row, q) for row in "xsuaoSUAO" for q in STATES}


def inserted(costs: list[int]) -> list[int]:
    """Least costs of a layer after any insertions in it, from those before; two suffice to reach every state."""
    costs = list(costs)
    for _ in range(2):
        for q in STATES:
            for _, to in MADE[q]:
                costs[to] = min(costs[to], costs[q] + INSERT)
    return costs


def inserted_back(costs: list[int]) -> list[int]:
    costs = list(costs)
    for _ in range(2):
        for q in STATES:
            for _, to in MADE[q]:
                costs[q] = min(costs[q], costs[to] + INSERT)
    return costs


def forward(codes: str, costs: list[int]) -> list[list[int]]:
    """Costs before each row, insertions there included; last, those after all rows, without any."""
    layers = []
    for row in codes:
        costs = inserted(costs)
        layers.append(costs)
        after = [INF] * len(STATES)
        for q in STATES:
            for _, cost, to, _ in ARCS[row, q]:
                after[to] = min(after[to], costs[q] + cost)
        costs = after
    return [*layers, costs]


def backward(codes: str, costs: list[int]) -> list[list[int]]:
    """Costs to the end before each row, insertions there included; last, ``costs``: those from after all rows."""
    layers = [costs]
    for row in reversed(codes):
        costs = inserted_back([min(cost + costs[to] for _, cost, to, _ in ARCS[row, q]) for q in STATES])
        layers.append(costs)
    return layers[::-1]


def ending() -> list[int]:
    """Costs to the end once all rows are consumed."""
    return inserted_back([0 if q in ENDS else INF for q in STATES])


def traverse(codes: str, before: list[int], after: list[int], optimum: int, state: int) -> tuple[int, list[tuple[int, str, str]]] | None:
    """From (no row consumed, state) to a state after all rows, along tight arcs, the least letter at each step.

    before: forward costs at the start, insertions there not yet made. after: backward costs at the end. Edits are (row,
    letter, role given); an insertion has the number of the row that it comes before. None if no cheapest path has the state.
    """
    ahead, back = forward(codes, before), backward(codes, after)
    if before[state] + back[0][state] != optimum:
        return None
    at, frontier, edits = 0, {state}, []
    while at < len(codes):
        steps: dict[str, dict[tuple[int, str], int]] = {}
        for q in frontier:
            for letter, cost, to, role in ARCS[codes[at], q]:
                if ahead[at][q] + cost + back[at + 1][to] == optimum:
                    steps.setdefault(letter, {})[to, role] = 1
            for role, to in MADE[q]:
                if ahead[at][q] + INSERT + back[at][to] == optimum:
                    steps.setdefault("I", {})[to, role] = 0
        letter = min(steps)
        # The order of turns is deterministic: a letter leads from a state to one other, so the set keeps one node.
        (role,) = {role for _, role in steps[letter]}
        frontier = {to for to, _ in steps[letter]}
        edits.append((at, letter, role))
        at += letter != "I"
    (state,) = frontier
    return state, edits


def closing(state: int, at: int) -> list[tuple[int, str, str]]:
    """The insertions after the last row: of these, all orders that end are one user turn or one assistant turn away."""
    edits = []
    while state not in ENDS:
        role, state = MADE[state][0]
        edits.append((at, "I", role))
    return edits


NAMES = {"u": "user", "a": "assistant"}


def lines(row: tuple[str, str] | None, letter: str, given: str) -> list[str]:
    """What an edit leaves of a row (role, text)."""
    if letter == "I":
        return [f"{NAMES[given]}:"]
    if letter == "D" or row is None:
        return []
    return [f"{NAMES.get(given, row[0])}:{row[1]}"]


def repair(rows: list[tuple[int | None, str, str]]) -> dict:
    """The columns of RESULT for a conversation's rows (turn, role, text) in order."""
    counts, seen, faults = dict.fromkeys(COUNTS, 0), set(), []
    for _, role, text in rows:
        f = fault(text)
        if f != "b":
            digest = hashlib.sha256(f"{role}\0{text}".encode()).digest()
            f = "d" if digest in seen else f
            seen.add(digest)
        faults.append(f)
    for name, letter in zip(COUNTS, "bdt", strict=True):
        counts[name] = faults.count(letter)
    codes = "".join(code(r[1], f) for r, f in zip(rows, faults, strict=True))
    turns = {r[0] for r in rows if r[0] is not None}
    start = [0 if q == START else INF for q in STATES]
    optimum = backward(codes, ending())[0][START] if codes else 0
    state, edits = traverse(codes, start, ending(), optimum, START)
    edits += closing(state, len(rows))
    kept = [line for at, letter, given in edits for line in lines(rows[at][1:] if at < len(rows) else None, letter, given)]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **counts,
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False)), "cost": optimum,
        "audit": "".join(letter for _, letter, _ in edits), "repaired_sha256": hashlib.sha256("\n".join(kept).encode()).hexdigest(),
    }


def _names(schema: str) -> list[str]:
    return [c.split(" ")[0] for c in schema.split(", ")]


ROW = "conv_id long, here boolean, turn long, role string, text string"
STREAMED = f"{ROW}, {RESULT}, part long, place long, done boolean"


def _record(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    columns = list(zip(*rows, strict=True)) or [()] * len(_names(schema))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[x.split(" ")[1]]) for c, x in zip(columns, schema.split(", "), strict=True)], _names(schema))


def _streamed(most: int):
    """A range of rows in order: results of the conversations inside it, rows of the first, the last and the very long ones."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, held, size, place = None, [], 0, 0
        began, whole = False, False
        nothing = (None,) * len(_names(RESULT))

        def hand_on() -> None:
            nonlocal place, size
            for part, here, turn, role, text in held:
                out.append((conv, here, turn, role, text, *nothing, part, place, False))
                place += 1
            held.clear()
            size = 0

        def finish() -> None:
            nonlocal size
            if not whole:
                hand_on()
                return
            result = repair([r[2:] for r in held if r[1]])
            out.append((conv, True, None, None, None, *(result[n] for n in _names(RESULT)), None, None, True))
            held.clear()
            size = 0

        for batch in batches:
            for c, here, turn, role, text, part in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "here", "turn", "role", "text", "part")), strict=True):
                if not began:
                    conv, began = c, True  # the first one of a range isn't whole: it may have begun in the range before
                elif c != conv:
                    finish()
                    conv, whole = c, True
                held.append((part, here, turn, role, text))
                size += len(text) + len(role) + 64
                if size > most:
                    whole = False
                    hand_on()
            yield _record(out, STREAMED)
            out.clear()
        whole = False  # the last one may go on in the range after
        finish()
        yield _record(out, STREAMED)

    return stream


@F.pandas_udf(T.StringType())
def _fault(text: pd.Series) -> pd.Series:
    return text.map(fault)


@F.pandas_udf(T.StringType())
def _code(role: pd.Series, said: pd.Series) -> pd.Series:
    return pd.Series([code(r, f) for r, f in zip(role, said, strict=True)], dtype=object)


SUMMARY = "conv string, segment long, codes string, matrix array<array<long>>, blank long, duplicate long, truncated long, illegal long, first_role string, last_role string"


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _summary(rows: pd.DataFrame) -> pd.DataFrame:
    """One segment: its codes, least costs from each state to each, and counts that add up over segments."""
    rows = rows.sort_values("at")
    codes, initials = "".join(rows["code"]), rows["role"].tolist()
    matrix = [forward(codes, [0 if q == start else INF for q in STATES])[-1] for start in STATES]
    one = (rows["conv"].iloc[0], rows["segment"].iloc[0], codes, matrix, *((rows["fault"] == f).sum() for f in "bdt"), _illegal(initials), initials[0], initials[-1])
    return pd.DataFrame([one], columns=_names(SUMMARY))


CHAINED = "conv string, segment long, before array<long>, after array<long>, cost long, blank long, duplicate long, truncated long, illegal long"


def _chain(rows: pd.DataFrame) -> pd.DataFrame:
    """A conversation's segments in order: costs at the cuts, and its counts. A row a segment, none of them with its texts."""
    rows = rows.sort_values("segment")
    matrices = [[[int(x) for x in line] for line in m] for m in rows["matrix"]]
    costs, before, after = [0 if q == START else INF for q in STATES], [], []
    for m in matrices:
        before.append(costs)
        costs = [min(INF, *(costs[q] + m[q][to] for q in STATES)) for to in STATES]
    cost = min(c + e for c, e in zip(costs, ending(), strict=True))
    costs = ending()
    for m in reversed(matrices):
        after.append(costs)
        costs = [min(INF, *(m[q][to] + costs[to] for to in STATES)) for q in STATES]
    cuts = sum(_illegal([a, b]) for a, b in zip(rows["last_role"], rows["first_role"].iloc[1:], strict=False))
    counts = {c: int(rows[c].sum()) for c in (*COUNTS, "illegal")}
    return rows[["conv", "segment"]].assign(before=before, after=after[::-1], cost=cost, **counts | {"illegal": counts["illegal"] + cuts})


PATHS = "conv string, segment long, entered long, left long, letters string, given string"


def _paths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The traversal of each segment, from every state that a cheapest path enters it in."""
    for batch in batches:
        out = []
        for r in batch.itertuples():
            for q in STATES:
                # A path enters a segment where the last one left it; insertions follow, so costs there hold none yet.
                if int(r.before[q]) < INF and (found := traverse(r.codes, [int(x) for x in r.before], [int(x) for x in r.after], r.cost, q)):
                    left, edits = found
                    out.append((r.conv, r.segment, q, left, "".join(e[1] for e in edits), "".join(e[2] or "-" for e in edits)))
        yield pd.DataFrame(out, columns=_names(PATHS))


TAKEN = "conv string, segment long, entered long"


def _taken(rows: pd.DataFrame) -> pd.DataFrame:
    """Which of its paths each segment takes: that which enters where the one before left."""
    state, out = START, []
    steps = {(r.segment, r.entered): r.left for r in rows.itertuples()}
    for segment in sorted(rows["segment"].unique()):
        out.append((rows["conv"].iloc[0], int(segment), state))
        state = steps[segment, state]
    return pd.DataFrame(out, columns=_names(TAKEN))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows in order of conversation and place -> (conv, audit, repaired_sha256), as a stream: texts aren't held."""
    conv, hashed, empty, audit, state = None, None, True, [], START

    def end():
        nonlocal empty
        for _, letter, given in closing(state, 0):
            audit.append(letter)
            for line in lines(None, letter, given):
                hashed.update((line if empty else f"\n{line}").encode())
                empty = False
        return pd.DataFrame([(conv, "".join(audit), hashed.hexdigest())], columns=["conv", "audit", "repaired_sha256"])

    for batch in batches:
        for c, role, text, letters, given, left in zip(*(batch[n] for n in ("conv", "role", "text", "letters", "given", "left")), strict=True):
            if c != conv:
                if conv is not None:
                    yield end()
                conv, hashed, empty, audit, state = c, hashlib.sha256(), True, [], START
            for letter, to in zip(letters, given, strict=True):
                audit.append(letter)
                for line in lines((role, text), letter, to.strip("-")):
                    hashed.update((line if empty else f"\n{line}").encode())
                    empty = False
            state = int(left)
    if conv is not None:
        yield end()


EDITS = "conv string, at long, letters string, given string, left long"


def _edits(segment: int):
    """Paths of segments -> the letters and roles of each row, insertions before it included."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                out, begin = [], 0
                for end, letter in enumerate(r.letters, 1):
                    if letter != "I":
                        out.append((r.conv, r.segment * segment + len(out), r.letters[begin:end], r.given[begin:end], r.left))
                        begin = end
                yield pd.DataFrame(out, columns=_names(EDITS))

    return rows


def _numbered(rows: DataFrame, segment: int) -> DataFrame:
    """rows (conv, part, place) with ``at``, from 0 within the conversation: by range, by share of the range, within the share."""
    sizes = staged(rows.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("place").alias("low")), "sizes")
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a range
    sizes = staged(sizes.select("conv", "part", "low", before.alias("before")), "starts").hint("merge")
    rows = rows.join(sizes, ["conv", "part"]).withColumn("share", F.floor((F.col("place") - F.col("low")) / segment))
    rows = staged(rows, "placed")
    counts = rows.groupBy("conv", "part", "share").agg(F.count("*").alias("m"))
    offset = F.coalesce(F.sum("m").over(W.partitionBy("conv", "part").orderBy("share").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = staged(counts.select("conv", "part", "share", offset.alias("offset")), "shares").hint("merge")
    inner = F.row_number().over(W.partitionBy("conv", "part", "share").orderBy("place")) - 1
    return rows.withColumn("inner", inner).join(counts, ["conv", "part", "share"]).withColumn("at", F.col("before") + F.col("offset") + F.col("inner"))


def _long(rows: DataFrame, segment: int) -> DataFrame:
    """Results of conversations given as rows (conv_id, here, turn, role, text, part, place), cut into segments.

    The audit and the hash of a conversation are one value each, so its texts pass through one task at the end, as a stream.
    """
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")
    rows = _numbered(rows.where("here").select(name, "turn", "role", "text", "part", "place"), segment)
    rows = rows.select("conv", "turn", "role", "text", "at", F.sha2("text", 256).alias("digest"), _fault("text").alias("fault"), F.floor(F.col("at") / segment).alias("segment"))
    rows = staged(rows, "numbered")
    first = staged(rows.groupBy("conv", "role", "digest").agg(F.min("at").alias("first")), "first").hint("merge")
    said = F.when((F.col("at") > F.col("first")) & (F.col("fault") != "b"), "d").otherwise(F.col("fault"))
    coded = rows.select("conv", "segment", "at", "role", "digest", "fault").join(first, ["conv", "role", "digest"]).withColumn("fault", said)
    coded = coded.select("conv", "segment", "at", F.left("role", F.lit(1)).alias("role"), "fault", _code("role", "fault").alias("code"))
    segments = staged(coded.groupBy("conv", "segment").applyInPandas(_summary, SUMMARY), "segments")
    chained = staged(segments.drop("codes").groupBy("conv").applyInPandas(_chain, CHAINED), "chained")
    paths = segments.select("conv", "segment", "codes").join(chained.select("conv", "segment", "before", "after", "cost").hint("merge"), ["conv", "segment"])
    paths = staged(paths.mapInPandas(_paths, PATHS), "paths")
    taken = paths.select("conv", "segment", "entered", "left").groupBy("conv").applyInPandas(_taken, TAKEN)
    edits = staged(paths.join(taken.hint("merge"), ["conv", "segment", "entered"]).mapInPandas(_edits(segment), EDITS), "edits")
    edited = rows.select("conv", "at", "role", "text").join(edits.hint("merge"), ["conv", "at"])
    edited = edited.repartition("conv").sortWithinPartitions("conv", "at").mapInPandas(_hashes, "conv string, audit string, repaired_sha256 string")
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    gaps = turns.agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))
    return chained.where("segment = 0").select("conv", *COUNTS, "illegal", "cost").join(gaps, "conv").join(edited, "conv")


EMPTY = {"gaps": 0, **dict.fromkeys(COUNTS, 0), "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


def repair_conversations(turns: DataFrame, here: Column | None = None, segment: int = SEGMENT, held: int = HELD) -> DataFrame:
    """conv_id and the columns of RESULT, one row a conversation of turns (conv_id, turn, role, text).

    Null roles and texts read as one space; all null ids are one conversation. Rows go by turn, null first, those of one
    turn by the first 64 characters of role and text, then by a hash; copies of a row are duplicates. Rows where ``here`` is false are gone, but their conversation is
    still reported: without any row it has zeros, an empty audit and the hash of nothing. An empty table has no result.
    """
    bounded_batches(turns.sparkSession)
    here = F.lit(True) if here is None else here
    read = lambda c: F.when(here, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), here.alias("here"), F.col("turn").cast("long").alias("turn"), read("role"), read("text"))
    start = F.left(F.concat("role", F.lit("\0"), F.left("text", F.lit(64))), F.lit(64))
    # Copies of a row are numbered, so that they spread over ranges as well.
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), start, F.xxhash64("role", "text"), "copy"]
    ranged = rows.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(shuffle_partitions(turns.sparkSession), *order).sortWithinPartitions(*order)
    streamed = staged(ranged.drop("copy").withColumn("part", F.spark_partition_id()).mapInArrow(_streamed(held), STREAMED), "repaired")
    columns = _names(RESULT)
    rest = streamed.where("not done").select("conv_id", "here", "turn", "role", "text", "part", "place")
    ids = rest.select("conv_id", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv")).distinct()
    long = ids.join(_long(rest, segment), "conv", "left").select("conv_id", *[F.coalesce(c, F.lit(EMPTY[c])).alias(c) for c in columns])
    return streamed.where("done").select("conv_id", *columns).unionByName(long)


def damaged(turns: DataFrame) -> DataFrame:
    """turns as a fixed rule damages them, with ``here``: false for rows that it drops."""
    read = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(read("conv_id"), F.lit(":"), read("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(read("text"), "[.!?]", "")).otherwise(read("text"))
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(read("role")).alias("role"), text.alias("text"), (kind != 0).alias("here"), F.when(kind == 3, 2).otherwise(1).alias("times"))
    return rows.select("conv_id", "turn", "role", "text", "here", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).drop("copy")


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = damaged(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return repair_conversations(turns, F.col("here"))


#: The counts of op13_repair_conversations, for the query that has them alone; the cheapest edits are out of SQL's reach.
FAULTS_SQL = rf"""
WITH {CRC_TABLE_SQL},
kinds AS MATERIALIZED (SELECT *, {crc32_sql("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS kind FROM conversations CROSS JOIN crc_table),
rows AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') ELSE coalesce(text, ' ') END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
seen AS (
  SELECT conv_id, turn, regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS time,
         left(lag(role) OVER w, 1) || left(role, 1) AS pair FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE last = '') AS blank, count(*) FILTER (WHERE last <> '' AND time > 1) AS duplicate,
         count(*) FILTER (WHERE last NOT IN ('', '.', '!', '?') AND time = 1) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM seen GROUP BY conv_id)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal
FROM (SELECT DISTINCT conv_id FROM conversations) k LEFT JOIN counted c ON k.conv_id IS NOT DISTINCT FROM c.conv_id
"""
