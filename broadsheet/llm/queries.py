"""The queries of this subpackage and their SQL, as ``__spark_entry__.py`` registers them."""

from __future__ import annotations

from .ann import op8_nearest_vectors
from .conversations import FAULTS_SQL, op13_repair_conversations
from .fingerprint import op3_fingerprint
from .language import op6_identify_language
from .line_templates import OP9_SQL, op9_drop_template_lines
from .mixing import OP7_SQL, op7_mix_sources
from .ngram_join import OP1_SQL, op1_ngram_jaccard
from .packing import op2_pack
from .pii import op5_find_personal_data
from .resampling import OP12_SQL, op12_resample
from .secrets import op10_find_secrets
from .toxicity import op4_score_toxicity
from .url_filter import OP11_SQL, op11_filter_urls



def _derived(query, *columns: str):
    """A query's columns that SQL can compute as well."""
    return lambda spark, sf_dir: query(spark, sf_dir).select(*columns)


def _word(text: str) -> str:
    """An expression for a word in either case, ASCII letters alone."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in text)


EDITED_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS following FROM d)
SELECT doc_id, length(text) AS n_chars, sha256(left(text, length(text) - length(text) // 2) || left(following, length(text) // 2)) AS edited_sha256 FROM n
"""
PERSONAL_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), cards AS (
  SELECT doc_id, t, list_filter(list_transform(regexp_extract_all(t, '[0-9](?:[\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: length(x) BETWEEN 12 AND 19) AS c FROM d)
SELECT doc_id, len(regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS n_email,
  len(list_filter(regexp_extract_all(t, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+'), lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR CAST('0' || right(ltrim(p, '0'), 3) AS INTEGER) > 255)) = 0)) AS n_ip,
  len(list_filter(c, lambda x: list_sum(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(x[length(x) - i + 1] AS INTEGER) ELSE 2 * CAST(x[length(x) - i + 1] AS INTEGER) - CASE WHEN CAST(x[length(x) - i + 1] AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0)) AS n_card,
  len(list_filter(regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) BETWEEN 9 AND 15)) AS n_phone FROM cards
"""
_KEYWORDS = "|".join(map(_word, ("password", "passwd", "secret", "token", "api_?key")))
SECRETS_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?:{_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 6)) AS n_assign,
  len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM d
"""

QUERIES = {
    "op8_nearest_vectors": op8_nearest_vectors,
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op9_drop_template_lines": op9_drop_template_lines,
    "op4_score_toxicity": op4_score_toxicity,
    "op10_find_secrets": op10_find_secrets,
    "op5_find_personal_data": op5_find_personal_data,
    "op2_pack": op2_pack,
    "op3_fingerprint": op3_fingerprint,
    "op6_identify_language": op6_identify_language,
    "op7_mix_sources": op7_mix_sources,
    "op11_filter_urls": op11_filter_urls,
    "op12_resample": op12_resample,
    "op13_repair_conversations": op13_repair_conversations,
    "conversation_faults": _derived(op13_repair_conversations, "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal"),
    "fingerprint_edited_texts": _derived(op3_fingerprint, "doc_id", "n_chars", "edited_sha256"),
    "personal_data_counts": _derived(op5_find_personal_data, "doc_id", "n_email", "n_ip", "n_card", "n_phone"),
    "secret_counts": _derived(op10_find_secrets, "doc_id", "n_assign", "n_access", "n_hex"),
}
SQL = {
    "op1_ngram_jaccard": OP1_SQL,
    "op9_drop_template_lines": OP9_SQL,
    "op7_mix_sources": OP7_SQL,
    "op11_filter_urls": OP11_SQL,
    "op12_resample": OP12_SQL,
    "conversation_faults": FAULTS_SQL,
    "fingerprint_edited_texts": EDITED_SQL,
    "personal_data_counts": PERSONAL_SQL,
    "secret_counts": SECRETS_SQL,
}
