"""Line dedup by a tree of log templates of fixed depth.

A line's words that hold a digit are variable fields and read ``<*>``. Lines descend by their number of words, then by
their first DEPTH words, to a leaf. In a leaf, a template is the line as a whole, or with one of four equal parts of the
remaining words left open: lines that differ in one part only share that template, so a field of other kind (a name, a
title) is generalised too, and at least three quarters of the words stay constant. Templates that recur across documents
are dropped from all but the first document (``keep_first``) or from all. A line that is fields for more than half, or has
under MIN_WORDS words, is its own template as it stands, lest rows of numbers pass for boilerplate. Words end at ASCII white
space; a line that is written without it is measured in characters. Lines without words stay.

Documents with equal text count as one: a copied document doesn't make its lines boilerplate. A line is a hash at each
level, counted with partial sums in each task; a leaf or a template that all documents share is never gathered. Only lines
in leaves that two documents share have their templates counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, let, staged, table

#: Leading words of the tree; parts of the rest that a template may leave open; least words of a line with open parts.
DEPTH, PARTS, MIN_PARTED = 2, 4, 8
#: A template recurs from so many documents; from LONG_DOCS if it is LONG_WORDS long.
MIN_DOCS, LONG_WORDS, LONG_DOCS = 3, 50, 2
#: Lines of fewer words are their own template, and so are lines that are fields for more than half.
MIN_WORDS = 3
#: A line with more characters a word than this isn't written with spaces; its length counts in characters.
UNSPACED = 20
#: White space within a line besides the space.
OTHER_SPACE = r"[\x09\x0B-\x0D]"
#: A word with a digit.
FIELD = r"[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*"


def _lines(text: Column) -> Column:
    """For each line: n (length in words), leaf, keys (its templates); null for lines without words."""

    def hashed(w: Column, line: Column) -> Column:
        n = F.size(w)
        bare = F.char_length(F.replace(line, F.lit(" "), F.lit("")))
        length = F.when((F.char_length(line) > UNSPACED * n) & (bare > UNSPACED * n), bare).otherwise(n)
        rest = n - DEPTH
        cut = lambda j: F.lit(DEPTH) + F.floor(rest * j / PARTS).cast("int")
        parted = [F.xxhash64(n, F.lit(j), F.slice(w, F.lit(1), cut(j)), F.slice(w, cut(j + 1) + 1, n - cut(j + 1))) for j in range(PARTS)]
        whole = F.xxhash64(n, F.lit(-1), w)
        fields = F.size(F.filter(w, lambda x: x == "<*>"))
        own = F.array(F.xxhash64(n, F.lit(-2), F.trim(line)))
        keys = F.when((fields * 2 > n) | (n < MIN_WORDS), own).when(n >= MIN_PARTED, F.array(whole, *parted)).otherwise(F.array(whole))
        return F.when(n > 0, F.struct(length.alias("n"), F.xxhash64(n, F.slice(w, 1, DEPTH)).alias("leaf"), keys.alias("keys")))

    spaced = F.when(text.rlike(OTHER_SPACE), F.regexp_replace(text, OTHER_SPACE, " ")).otherwise(text)
    masked = F.split(F.regexp_replace(spaced, FIELD, "<*>"), "\n")
    return F.zip_with(masked, F.split(spaced, "\n"), lambda m, line: let(F.filter(F.split(m, " "), lambda x: x != ""), lambda w: hashed(w, line)))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """doc_id, fp (xxhash64 of the text), line (from 0), first (whether its text is the first to have it), one row a line.

    A line recurs if one of its templates does; it is the first only if it is so for all of those.
    """
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("fp"), F.posexplode(_lines(F.col("text"))).alias("line", "t"))
    rows = staged(rows.where("t is not null").select("doc_id", "fp", "line", "t.n", "t.leaf", "t.keys"), "lines")
    shared = rows.groupBy("leaf").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("leaf")
    # Both sides of the joins below are plain shuffles, whose hot keys Spark splits; leaves are too many to broadcast.
    shared = staged(shared, "leaves").hint("merge")
    keyed = staged(rows.join(shared, "leaf").select("doc_id", "fp", "line", "n", F.explode("keys").alias("key")), "templates")
    once = keyed.groupBy("key", "fp").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    counted = once.groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("docs"), F.min_by("fp", F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "fp")).alias("keeper"))
    recurring = counted.where(F.col("docs") >= F.when(F.col("n") >= LONG_WORDS, LONG_DOCS).otherwise(MIN_DOCS)).select("key", "keeper")
    recurring = staged(recurring, "recurring")
    return keyed.join(recurring, "key").groupBy("doc_id", "fp", "line").agg(F.bool_and(F.col("keeper") == F.col("fp")).alias("first"))


def drop_recurring_lines(docs: DataFrame, keep_first: bool = True, counts: bool = True) -> DataFrame:
    """docs, whose columns have doc_id and text, with its recurring lines dropped.

    Lines end at line feeds. Null text stays null; a text whose lines all go is empty; other lines stay as they are, in
    order. n_chars, if docs has it, is set anew; its other columns stay as they are. ``counts`` adds numbers of lines as
    ``lines``, ``recurring`` and ``dropped``, with underscores after a name that docs has. Repeated rows are treated alike;
    with equal texts the first by doc_id, null last, is the first document.
    """
    found = recurring_lines(docs)
    goes = ~F.col("first") if keep_first else F.lit(True)
    found = found.groupBy("doc_id", "fp").agg(F.count("*").alias("recurring"), F.collect_list(F.when(goes, F.col("line"))).alias("gone"))  # lines of one document
    d, g = docs.alias("d"), found.alias("g")
    joined = d.join(g, F.col("d.doc_id").cast("long").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.fp")), "left")
    text, lines = F.col("d.text"), F.split(F.col("d.text"), "\n")
    # The numbers of the lines that stay are found by hashing, so the work grows with the lines alone.
    stay = lambda said: F.array_except(F.sequence(F.lit(0), F.size(said) - 1), F.col("g.gone"))
    kept = let(lines, lambda said: F.array_join(F.transform(stay(said), lambda i: F.get(said, i)), "\n"))
    new = F.when(F.size("g.gone") > 0, kept).otherwise(text)
    columns = [new.alias("text") if c == "text" else F.char_length(new).cast("long").alias(c) if c == "n_chars" else F.col(f"d.`{c}`") for c in docs.columns]
    numbers = {
        "lines": F.coalesce(F.size(lines), F.lit(0)),
        "recurring": F.coalesce("g.recurring", F.lit(0)),
        "dropped": F.when(F.col("g.gone").isNull(), 0).otherwise(F.size("g.gone")),
    }
    added = [number.cast("long").alias(fresh(docs, name)) for name, number in numbers.items()] if counts else []
    return joined.select(*columns, *added)


def op9_drop_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "lines", "recurring", "dropped", F.char_length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


def template_sql(documents: str = "documents") -> str:
    """DuckDB: doc_id, line, text, first for each recurring line, as a chain of CTEs ending in ``found``."""
    part = lambda j: f"{DEPTH} + (({j} * (n - {DEPTH})) // {PARTS})"
    parts = ", ".join(f"'{j} ' || n || ' ' || array_to_string(list_concat(w[:{part(j)}], w[{part(j + 1)} + 1:]), ' ')" for j in range(PARTS))
    return rf"""
tl_split AS (
  SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS said,
         unnest(string_split(regexp_replace(text, '{OTHER_SPACE}', ' ', 'g'), chr(10))) AS spaced
  FROM (SELECT DISTINCT doc_id, text FROM {documents} WHERE text IS NOT NULL)),
tl_words AS (
  SELECT *, list_filter(string_split(regexp_replace(spaced, '{FIELD}', '<*>', 'g'), ' '), lambda x: x <> '') AS w, length(replace(spaced, ' ', '')) AS bare FROM tl_split),
tl_lines AS (SELECT *, len(w) AS n, CASE WHEN bare > {UNSPACED} * len(w) THEN bare ELSE len(w) END AS long FROM tl_words WHERE len(w) > 0),
tl_keys AS (
  SELECT doc_id, text, line, long, unnest(CASE WHEN 2 * len(list_filter(w, lambda x: x = '<*>')) > n OR n < {MIN_WORDS} THEN ['= ' || trim(spaced, ' ')] WHEN n >= {MIN_PARTED} THEN ['- ' || array_to_string(w, ' '), {parts}] ELSE ['- ' || array_to_string(w, ' ')] END) AS key
  FROM tl_lines),
tl_once AS (SELECT key, text, max(long) AS n, min(doc_id) AS doc_id FROM tl_keys GROUP BY key, text),
tl_counted AS (SELECT key, max(n) AS n, count(*) AS docs, arg_min(text, coalesce(doc_id, 9223372036854775807)) AS keeper FROM tl_once GROUP BY key),
tl_recurring AS (SELECT key, keeper FROM tl_counted WHERE docs >= CASE WHEN n >= {LONG_WORDS} THEN {LONG_DOCS} ELSE {MIN_DOCS} END),
tl_found AS (
  SELECT doc_id, text, line, bool_and(keeper = text) AS first FROM tl_keys JOIN tl_recurring USING (key) GROUP BY doc_id, text, line),
tl_cleaned AS (
  SELECT s.doc_id, s.text, count(*) AS lines, count(f.line) AS recurring, count(*) FILTER (WHERE NOT f.first) AS dropped,
         coalesce(string_agg(said, chr(10) ORDER BY s.line) FILTER (WHERE f.first IS NULL OR f.first), '') AS kept
  FROM tl_split s LEFT JOIN tl_found f ON s.doc_id IS NOT DISTINCT FROM f.doc_id AND s.text = f.text AND s.line = f.line GROUP BY s.doc_id, s.text)"""


OP9_SQL = f"""
WITH {template_sql()}
SELECT d.doc_id, CAST(coalesce(lines, 0) AS BIGINT) AS lines, CAST(coalesce(recurring, 0) AS BIGINT) AS recurring, CAST(coalesce(dropped, 0) AS BIGINT) AS dropped,
       CAST(length(kept) AS BIGINT) AS kept_chars, sha256(kept) AS kept_sha256
FROM documents d LEFT JOIN tl_cleaned c ON d.doc_id IS NOT DISTINCT FROM c.doc_id AND d.text = c.text
"""
