"""Secret scans: a keyword automaton over each text, anchored expressions where it hits, then checksums.

One pass of an Aho-Corasick automaton finds all keywords of a text; an expression is tried only where its keyword starts.
Runs of hexadecimal digits have no keyword and are searched directly. Tokens that end in a checksum of their own body are
added when the checksum holds.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, table

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Tokens whose last six characters are the CRC-32 of the thirty before them, in base 62.
CHECKED = re.compile(r"(gh[pousr]|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

KINDS = ("assign", "access", "hex", "github", "npm")
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access"}
KEYWORDS |= {f"{x}_": "checked" for x in ("ghp", "gho", "ghu", "ghs", "ghr", "npm")}

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def lower_ascii(text: str) -> str:
    """Lower case of the same length as the text."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if c < "\x80" else c for c in text)


def checksum(body: str) -> str:
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def find_secrets(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind), in order of start, then of KINDS."""
    found, ends = [], dict.fromkeys(("assign", "access", "checked"), 0)
    for last, (n, kind) in keywords.iter(lower_ascii(text)):
        at = last + 1 - n
        if at < ends[kind]:
            continue
        m = (ASSIGN if kind == "assign" else ACCESS if kind == "access" else CHECKED).match(text, at)
        if not m:
            continue
        ends[kind] = m.end()
        if kind == "assign":
            if m.end(2) - m.start(2) >= 6:
                found.append((at, m.end(), kind))
        elif kind == "access":
            if m.end() - at >= 20:
                found.append((at, m.end(), kind))
        elif checksum(m[2]) == m[3]:
            found.append((at, m.end(), "npm" if m[1] == "npm" else "github"))
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, one row for each row of docs (doc_id, text).

    Null text is empty; an empty text has no spans and the digest of the empty string. Offsets count code points.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                spans = find_secrets(text, keywords) if text else []
                base = [s for s in spans if s[2] in KINDS[:3]]
                kinds = [s[2] for s in base]
                rows.append((*[kinds.count(k) for k in KINDS[:3]], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def op10_find_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
