"""DuckDB statements for the pN_ queries that SQL can express over whole tables.

BPE is merges by rank as replacements; near duplicates are counted by brute force over all shared pieces. The
consistent form is spelled out for the characters that the tables hold (full-width and half-width forms, radicals, ligatures,
composed accents, look-alike letters, default-ignorables, blanks)."""

from __future__ import annotations

import unicodedata

from quillmill.llm.tokens import UNKNOWN
from quillmill.llm.visual import LOOKS_LIKE, SIGNS_LIKE
from quillmill.plans.oracle import MERGES, tokens_of


def _spelling(label: str) -> str:
    return f"nullif(regexp_replace(lower(trim(regexp_replace({label}, '[\\s\\x{{a0}}\\x{{3000}}]+', ' ', 'g'))), '[ _-]+', '_', 'g'), '')"


_UNKNOWN = "(" + ", ".join(f"'{u}'" for u in UNKNOWN) + ")"
_ROWS = f"""
  {MERGES},
  sources AS (SELECT source, min(l) AS source_language, min(d) AS source_domain FROM (SELECT {_spelling('source')} AS source, {_spelling('language')} AS l, {_spelling('domain')} AS d FROM dataset_sources) WHERE source IS NOT NULL GROUP BY source),
  known AS (SELECT id, min({_spelling('source')}) AS source, min({_spelling("meta['language']")}) AS language, min({_spelling("meta['domain']")}) AS domain, max({tokens_of('text')}) AS tokens FROM records, merges WHERE id IS NOT NULL GROUP BY id),
  asked AS (SELECT id, min({_spelling('language')}) AS language, min({_spelling('domain')}) AS domain, max({tokens_of('text')}) AS tokens FROM probes, merges WHERE id IS NOT NULL GROUP BY id),
  counted AS (
    SELECT 'records' AS origin, id, k.source, coalesce(CASE WHEN language NOT IN {_UNKNOWN} THEN language END, source_language) AS language, coalesce(domain, source_domain) AS domain, CAST(tokens AS BIGINT) AS tokens FROM known k LEFT JOIN sources s ON k.source = s.source
    UNION ALL SELECT 'probes', id, NULL, CASE WHEN language NOT IN {_UNKNOWN} THEN language END, domain, CAST(tokens AS BIGINT) FROM asked)"""

# Characters whose compatible form is written out, with that form.
_WIDE = [*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFA0), *range(0xFB00, 0xFB07), *range(0x2160, 0x2180), *range(0x2F00, 0x2FD6), 0x2026, 0x2025, 0xFFE0, 0xFFE1, 0xFFE5]
_PAIRS = [(chr(p), unicodedata.normalize("NFKC", chr(p))) for p in _WIDE] + list(LOOKS_LIKE.items())
_SIGNS = list(SIGNS_LIKE.items())
_HIDDEN = r"[\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{206f}\x{3164}\x{fe00}-\x{fe0f}\x{feff}\x{ffa0}\x{fff9}-\x{fffb}\x{e0000}-\x{e0fff}]"


def _replaced(text: str, pairs: list[tuple[str, str]]) -> str:
    listed = ", ".join("'" + (a + b).replace("'", "''") + "'" for a, b in pairs)
    return f"list_reduce([{text}, {listed}], lambda s, m: replace(s, substring(m, 1, 1), substring(m, 2)))"


_PLAIN = f"nfc_normalize({_replaced(f'''regexp_replace(nfc_normalize(text), '{_HIDDEN}', '', 'g')''', _PAIRS)})"
_LIKE = f"nfc_normalize({_replaced('t', _SIGNS)})"
_LINED = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\r\n?|[\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[^\S\n]|[\t\x{1f}\x{a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]', ' ', 'g'), ' +(\n|\z)', '\1', 'g'), '\A\n+|\n+\z', '', 'g')"
_FORMS = f"""
  forms AS (SELECT id, text, t AS form FROM (SELECT id, text, {_LINED} AS t FROM (SELECT id, text, {_LIKE} AS t FROM (SELECT id, text, {_PLAIN} AS t FROM
    (SELECT id, min(text) AS text FROM rows WHERE id IS NOT NULL AND text IS NOT NULL GROUP BY id)))) WHERE trim(t, ' ' || chr(10)) <> '')"""
_BOTH = "rows AS (SELECT id, text FROM records UNION ALL SELECT id, text FROM probes)"
#: Pairs of different ids of ``forms`` that share 0.6 of their pieces, or all of them.
_NEAR = """
  texts AS (SELECT form, row_number() OVER (ORDER BY form) AS doc FROM (SELECT DISTINCT form FROM forms)),
  pieces AS (SELECT doc, len(g) AS n, unnest(g) AS piece FROM (SELECT doc, CASE WHEN length(form) < 5 THEN [form] ELSE list_distinct([substring(form, i, 5) FOR i IN range(1, length(form) - 3)]) END AS g FROM texts)),
  near AS MATERIALIZED (SELECT x.doc AS a, y.doc AS b FROM pieces x JOIN pieces y ON x.piece = y.piece AND x.doc < y.doc AND least(x.n, y.n) >= 0.6 * greatest(x.n, y.n) - 1e-9
    GROUP BY x.doc, y.doc HAVING count(*) / CAST(any_value(x.n + y.n) - count(*) AS DOUBLE) >= CAST(0.6 AS DOUBLE)),
  members AS (SELECT id, doc FROM forms JOIN texts USING (form)),
  found AS (SELECT DISTINCT least(x.id, y.id) AS id_a, greatest(x.id, y.id) AS id_b FROM (SELECT a, b FROM near UNION ALL SELECT doc, doc FROM texts) JOIN members x ON x.doc = a JOIN members y ON y.doc = b WHERE x.id <> y.id)"""
_RECORDS = "rows AS (SELECT id, text FROM records)"
_SIDES = "sides AS (SELECT id, bool_or(lower(trim(split_name)) = 'train') AS train, bool_or(lower(trim(split_name)) IN ('validation', 'test')) AS held FROM records GROUP BY id)"

SQL: dict[str, str] = {
    "p1_found": f"WITH {_RECORDS}, {_FORMS}, {_NEAR}, {_SIDES} SELECT id_a, id_b FROM found JOIN sides a ON a.id = id_a JOIN sides b ON b.id = id_b WHERE (a.train AND b.held) OR (a.held AND b.train)",
    "p2_found": f"WITH {_BOTH}, {_FORMS} SELECT a.id AS id_a, b.id AS id_b FROM forms a JOIN forms b ON a.form = b.form AND a.id < b.id AND a.text <> b.text",
    "p2_form_classes": f"WITH {_BOTH}, {_FORMS} SELECT id, min(id) OVER c AS class_id, count(*) OVER c AS class_rows, spellings FROM forms JOIN (SELECT form, count(DISTINCT text) AS spellings FROM forms GROUP BY form) USING (form) WINDOW c AS (PARTITION BY form)",
    "p4_found": f"WITH {_RECORDS}, {_FORMS}, {_NEAR} SELECT id_a, id_b FROM found",
    "p6_row_tokens": f"WITH {_ROWS} SELECT origin, id, source, language, domain, tokens FROM counted",
    "p6_totals": f"""WITH {_ROWS} SELECT * FROM (
        SELECT origin, CASE grouping(source) * 4 + grouping(language) * 2 + grouping(domain) WHEN 7 THEN 'all' WHEN 3 THEN 'source' WHEN 4 THEN 'language+domain' WHEN 5 THEN 'language' WHEN 6 THEN 'domain' END AS slice,
               source, language, domain, count(*) AS rows, CAST(sum(tokens) AS BIGINT) AS tokens
        FROM counted GROUP BY GROUPING SETS ((origin), (origin, source), (origin, language, domain), (origin, language), (origin, domain))) WHERE slice <> 'source' OR origin = 'records'""",
}
