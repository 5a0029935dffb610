"""DuckDB statements that answer the registered queries over the same tables."""

from __future__ import annotations

# The character classes of the text columns, as RE2 writes them.
_WHITE = r"\s\x{1c}-\x{1f}\x{85}\p{Z}\x{0b}"
_NORM = "regexp_replace(regexp_replace(regexp_replace(nfc_normalize({t}), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|\\z)', '\\1', 'g'), '\\A\\n+|\\n+\\z', '', 'g')"


def _norm(t: str) -> str:
    return _NORM.replace("{t}", t)


def _bytes(t: str) -> str:
    return f"octet_length(encode({t}))"


_TRIM = "regexp_replace({t}, '\\A[" + _WHITE + "]+|[" + _WHITE + "]+\\z', '', 'g')"
_UNIQUE = "SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text"
_GRAMS = "CASE WHEN length({t}) = 0 THEN [] WHEN length({t}) < 5 THEN [{t}] ELSE list_distinct([substring({t}, i, 5) FOR i IN range(1, length({t}) - 3)]) END"
_TASKS = "(SELECT id, any_value(area) AS area, any_value(language) AS language, any_value(prompt) AS prompt, any_value(answer) AS answer, any_value(metric) AS metric, any_value(choices) AS choices FROM scored_tasks GROUP BY id)"
_SPLIT = """
  SELECT *, size >= 2 AND place > greatest(1, least(size - 1, CAST(floor(size * CAST(0.88 AS DOUBLE)) AS BIGINT))) AS is_eval FROM (
    SELECT doc_id, text, lang, row_number() OVER (PARTITION BY lang, coalesce(source, lang) ORDER BY lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS place,
           count(*) OVER (PARTITION BY lang, coalesce(source, lang)) AS size
    FROM documents)"""
_RATIOS = f"""
  SELECT doc_id, length(text) AS chars,
         length(regexp_replace(text, '[\\p{{L}}\\p{{N}}{_WHITE}]', '', 'g')) AS symbols,
         length(text) - length(regexp_replace(text, '[{_WHITE}]', '', 'g')) AS whitespace,
         CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END AS lines,
         CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - len(list_distinct(string_split(text, chr(10)))) END AS repeated_lines
  FROM documents"""
_SCORES = f"""
  docs AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS t FROM documents),
  bench AS (SELECT DISTINCT {_norm("text")} AS t FROM benchmark_items WHERE text IS NOT NULL),
  bench_grams AS (SELECT t AS b, len(g) AS nb, unnest(g) AS gram FROM (SELECT t, {_GRAMS.replace("{t}", "t")} AS g FROM bench WHERE t <> '')),
  doc_grams AS (SELECT doc_id, len(g) AS nd, unnest(g) AS gram FROM (SELECT doc_id, {_GRAMS.replace("{t}", "t")} AS g FROM docs)),
  pairs AS (SELECT doc_id, any_value(nd) AS nd, b, any_value(nb) AS nb, count(*) AS c FROM doc_grams JOIN bench_grams USING (gram) GROUP BY doc_id, b),
  best AS (SELECT doc_id, max(c / CAST(nd + nb - c AS DOUBLE)) AS s FROM pairs GROUP BY doc_id),
  scored AS (SELECT d.doc_id, CASE WHEN d.t <> '' AND d.t IN (SELECT t FROM bench) THEN 1.0 ELSE round(coalesce(s, 0.0), 4) END AS s, d.t <> '' AND d.t IN (SELECT t FROM bench) AS same
             FROM docs d LEFT JOIN best USING (doc_id))"""
_FLAT = "trim(regexp_replace({t}, '[" + _WHITE + "]+', ' ', 'g'))"
_PARAGRAPHS = """
  SELECT printf('%s-%04d', key, idx) AS id, key, idx, sha1(p) AS text_sha1, octet_length(encode(p)) AS bytes FROM (
    SELECT CAST(doc_id AS VARCHAR) AS key, unnest(ps) AS p, unnest(range(len(ps))) AS idx FROM (
      SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{cut}'), lambda x: """ + _FLAT.replace("{t}", "x") + """), lambda x: length(x) >= 8) AS ps FROM documents))"""


def _byte_rows(source: str, columns: str = "") -> str:
    """One row per byte: its text's number, its place, its two hexadecimal digits, and the two bytes before it."""
    return f"""
    SELECT *, lag(b, 1) OVER (PARTITION BY doc ORDER BY i) AS b1, lag(b, 2) OVER (PARTITION BY doc ORDER BY i) AS b2 FROM (
      SELECT doc{columns}, unnest(range(len(bs))) AS i, unnest(bs) AS b FROM (SELECT row_number() OVER () AS doc{columns}, regexp_extract_all(hex(encode(text)), '..') AS bs FROM {source} WHERE text IS NOT NULL))"""


_BPB = f"""
WITH split AS ({_SPLIT}),
train AS (SELECT text FROM split WHERE NOT is_eval AND text IS NOT NULL),
held AS (SELECT lang, text FROM split WHERE is_eval AND text NOT IN (SELECT text FROM train)),
places AS ({_byte_rows("train")}),
counts AS (SELECT 0 AS k, '' AS ctx, b, count(*) AS c FROM places GROUP BY ALL UNION ALL SELECT 1, b1, b, count(*) FROM places WHERE i >= 1 GROUP BY ALL UNION ALL SELECT 2, b2 || b1, b, count(*) FROM places WHERE i >= 2 GROUP BY ALL),
totals AS (SELECT k, ctx, sum(c) AS total FROM counts GROUP BY ALL),
spots AS (SELECT lang, coalesce(b2, '') || coalesce(b1, '') AS ctx, b, count(*) AS n FROM ({_byte_rows("held", ", lang")}) GROUP BY ALL),
keys AS (SELECT DISTINCT ctx, b FROM spots),
each AS (SELECT ctx, b, k, right(ctx, 2 * k) AS part FROM keys, (SELECT unnest([0, 1, 2]) AS k) WHERE length(ctx) >= 2 * k),
terms AS (SELECT e.ctx, e.b, e.k, pow(4.0, e.k) * coalesce(c.c, 0) / CAST(t.total AS DOUBLE) AS up, pow(4.0, e.k) AS down
          FROM each e JOIN totals t ON t.k = e.k AND t.ctx = e.part LEFT JOIN counts c ON c.k = e.k AND c.ctx = e.part AND c.b = e.b),
probs AS (SELECT o AS model_order, k.ctx, k.b, (0.1 / 256 + coalesce(sum(up) FILTER (t.k <= o), 0.0)) / (0.1 + coalesce(sum(down) FILTER (t.k <= o), 0.0)) AS p
          FROM keys k CROSS JOIN (SELECT unnest([0, 1, 2]) AS o) LEFT JOIN terms t ON t.ctx = k.ctx AND t.b = k.b GROUP BY ALL)
SELECT CAST(model_order AS BIGINT) AS model_order, lang AS language, grouping(lang) = 1 AS total, CAST(sum(n) AS BIGINT) AS bytes, round(sum(-log2(p) * n) / sum(n), 4) AS bpb
FROM spots JOIN probs USING (ctx, b) GROUP BY GROUPING SETS ((model_order, lang), (model_order))"""
_FILLER = "The archive contains routine maintenance logs from the facility. Daily status reports were filed on schedule without incident. 倉庫の在庫は定期的に点検され記録されている。 Shipments were processed and the manifests were reconciled. 会議の議事録は共有フォルダに保管されている。 The weather remained mild throughout the reporting period. "
_CELLS = f"""
  cells AS (SELECT length, depth, idx, 'NEEDLE-' || upper(substring(sha1('niah-needle-' || idx), 1, 8)) AS answer, 'access-code-' || idx AS key, substring(repeat('{_FILLER}', 40), 1, length) AS filler FROM (
    SELECT *, row_number() OVER (ORDER BY length, depth) - 1 AS idx FROM (SELECT unnest([200, 1000, 4000]) AS length), (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0])::DOUBLE AS depth))),
  placed AS (SELECT *, CAST(floor(depth * length(filler)) AS BIGINT) AS spot FROM cells)"""


# Answer metrics; the texts compared here need no compatibility composition beyond letter case.
_FOLD = "replace(lower({t}), 'ß', 'ss')"
_FORM = _TRIM.replace("{t}", "regexp_replace(" + _FOLD + ", '[" + _WHITE + "!\"#$%&''()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~。、，．！？「」『』（）：；]+', ' ', 'g')")
_LAST = "TRY_CAST(replace(regexp_extract_all({t}, '[-+]?[0-9][0-9,]*\\.?[0-9]*')[-1], ',', '') AS DOUBLE)"
_MOCK = "CASE WHEN " + _FLAT.replace("{t}", "prompt") + " = '' THEN '' ELSE '[mock] ' || " + _FLAT.replace("{t}", "prompt") + " END"


def _metric(name: str, got: str, want: str) -> str:
    """Whether a prediction passes; false where either side is null."""
    of = lambda pattern, t: pattern.replace("{t}", t)
    choice = f"""CASE WHEN length({of(_TRIM, got)}) = 1 THEN lower({of(_TRIM, got)}) = lower({of(_TRIM, want)})
        WHEN regexp_extract({got}, '(?i)answer\\s*(?:is|:)?\\s*\\(?([A-Ja-j])\\)?\\b', 1) <> '' THEN lower(regexp_extract({got}, '(?i)answer\\s*(?:is|:)?\\s*\\(?([A-Ja-j])\\)?\\b', 1)) = lower({of(_TRIM, want)})
        WHEN regexp_extract({got}, '\\(([A-Ja-j])\\)', 1) <> '' THEN lower(regexp_extract({got}, '\\(([A-Ja-j])\\)', 1)) = lower({of(_TRIM, want)}) ELSE false END"""
    sql = {
        "exact_match": f"{of(_TRIM, got)} = {of(_TRIM, want)}",
        "normalized_match": f"{of(_FORM, got)} = {of(_FORM, want)}",
        "includes": f"{of(_FORM, want)} <> '' AND contains({of(_FORM, got)}, {of(_FORM, want)})",
        "numeric_match": f"abs({of(_LAST, got)} - {of(_LAST, want)}) <= 1e-9 + 1e-9 * abs({of(_LAST, want)})",
        "multiple_choice": choice,
    }[name]
    return f"coalesce({sql}, false)"


_METRICS = ("exact_match", "normalized_match", "includes", "numeric_match", "multiple_choice")


def _passed(prediction: str) -> str:
    return "CASE metric " + " ".join(f"WHEN '{m}' THEN {_metric(m, prediction, 'answer')}" for m in _METRICS) + " END"


def _suite(prediction: str) -> str:
    return f"""
    SELECT CASE grouping(area) * 2 + grouping(language) WHEN 3 THEN 'overall' WHEN 1 THEN 'area' ELSE 'language' END AS level, area, language,
           CAST(coalesce(sum(CASE WHEN {_passed(prediction)} THEN 1 ELSE 0 END), 0) AS BIGINT) AS passed, count(*) AS total
    FROM (SELECT * REPLACE (coalesce(language, 'none') AS language) FROM {_TASKS}) GROUP BY GROUPING SETS ((), (area), (language))"""


# Tokens as single characters of a private plane: merges in order of rank are replacements from left to right.
_TOKEN = 983040
MERGES = f"merges AS (SELECT list(chr({_TOKEN} + left_id) || chr({_TOKEN} + right_id) || chr({_TOKEN} + new_id) ORDER BY merge_rank) AS merged FROM bpe_merges)"


def tokens_of(text: str) -> str:
    """Number of tokens of a text; a statement that uses it reads ``merges`` too."""
    signs = f"array_to_string(list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: chr({_TOKEN} + CAST(('0x' || x) AS INTEGER))), '')"
    return f"coalesce(length(list_reduce(list_prepend({signs}, merged), lambda s, m: replace(s, substring(m, 1, 2), substring(m, 3, 1)))), 0)"


def _compression(extra: str = "", reads: str = "") -> str:
    return f"""
p AS (SELECT id, min(language) AS language, min(domain) AS domain, min(text) AS text FROM probes GROUP BY id),
t AS (SELECT id, language, domain, length(text) AS chars, octet_length(encode(text)) AS bytes, unnest([
        {{'tokenizer': 'byte', 'tokens': octet_length(encode(text))}}, {{'tokenizer': 'char', 'tokens': length(text)}}{extra},
        {{'tokenizer': 'whitespace', 'tokens': len(list_filter(regexp_split_to_array(text, '[{_WHITE}]+'), lambda w: w <> ''))}}], recursive := true) FROM p{reads})
SELECT tokenizer, CASE WHEN grouping(id) = 0 THEN 'probe' WHEN grouping(language) = 0 THEN 'language' WHEN grouping(domain) = 0 THEN 'domain' ELSE 'overall' END AS level, language, domain, id,
       CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(chars), 0) AS BIGINT) AS chars, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes
FROM t GROUP BY GROUPING SETS ((tokenizer), (tokenizer, language), (tokenizer, domain), (tokenizer, id))"""


_CHAT = "'<bos><system>' || area || '<eos><user>' || coalesce(prompt, '') || '<eos><assistant>' || coalesce(answer, '') || '<eos>'"


def _similar(unique: str) -> str:
    """Pairs of the distinct texts of ``unique`` (pos, text) that share 0.8 of their n-grams: ctes up to ``similar``."""
    return f"""
        u AS ({unique}),
        g AS (SELECT pos, len(gs) AS n, unnest(gs) AS gram FROM (SELECT pos, {_GRAMS.replace("{t}", 'text')} AS gs FROM u)),
        p AS (SELECT x.pos AS a, y.pos AS b, count(*) AS common, any_value(x.n + y.n) AS both_sizes FROM g x JOIN g y ON x.gram = y.gram AND x.pos < y.pos AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9 GROUP BY x.pos, y.pos),
        similar_pairs AS MATERIALIZED (SELECT a, b, common, both_sizes - common AS total FROM p WHERE common / CAST(both_sizes - common AS DOUBLE) >= CAST(0.8 AS DOUBLE))"""


# The greedy rule one text at a time: a text goes if an earlier one that it is similar to is still there.
_GREEDY = """
        earlier AS MATERIALIZED (SELECT b, list(a) AS before, row_number() OVER (ORDER BY b) AS step FROM similar_pairs GROUP BY b),
        walk AS (SELECT CAST(0 AS BIGINT) AS step, CAST([] AS BIGINT[]) AS gone UNION ALL
                 SELECT w.step + 1, CASE WHEN len(list_filter(e.before, lambda x: NOT list_contains(w.gone, x))) > 0 THEN list_append(w.gone, e.b) ELSE w.gone END FROM walk w JOIN earlier e ON e.step = w.step + 1),
        dropped AS (SELECT unnest(gone) AS pos FROM (SELECT gone FROM walk ORDER BY step DESC LIMIT 1))"""
_UNIQUE_RECORDS = "SELECT min(pos) AS pos, text FROM records WHERE text IS NOT NULL AND text <> '' GROUP BY text"
_RULES = {
    **{f"{c} must be a non-empty string": f"length({c}) > 0" for c in ("id", "area", "language", "prompt")},
    "metric is unknown": "metric IN (" + ", ".join(f"'{m}'" for m in _METRICS) + ")",
    "answer must not be blank": f"length({_TRIM.replace('{t}', 'answer')}) > 0",
    "multiple choice needs choices that hold the answer": f"metric <> 'multiple_choice' OR coalesce(len(choices) > 0 AND list_contains(list_transform(choices, lambda c: {_TRIM.replace('{t}', 'c')}), {_TRIM.replace('{t}', 'answer')}), false)",
}

SQL: dict[str, str] = {
    "normalize_docs": f"SELECT doc_id, sha1(t) AS text_sha1, length(t) AS chars, {_bytes('t')} AS bytes FROM (SELECT doc_id, {_norm('text')} AS t FROM documents)",
    "record_ids": "SELECT doc_id, 'docs-' || substring(sha1('docs' || chr(0) || doc_id || chr(0) || text), 1, 16) AS record_id FROM documents",
    "ingest_docs": f"SELECT doc_id AS pos, 'docs-' || substring(sha1('docs' || chr(0) || (doc_id + 7) || chr(0) || t), 1, 16) AS id, 'docs' AS source, sha1(t) AS text_sha1 FROM (SELECT doc_id, {_norm('text')} AS t FROM documents) WHERE t <> ''",
    "exact_dedup": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "exact_dedup_records": "SELECT id, pos FROM records WHERE pos IN (SELECT min(pos) FROM records GROUP BY text)",
    "quality_filter": f"""SELECT doc_id FROM ({_RATIOS}) WHERE chars >= 200 AND chars <= 20000 AND symbols / CAST(chars AS DOUBLE) <= CAST(0.12 AS DOUBLE)
        AND whitespace / CAST(chars AS DOUBLE) <= CAST(0.3 AS DOUBLE) AND repeated_lines / CAST(lines AS DOUBLE) <= CAST(0.2 AS DOUBLE)""",
    "quality_ratios": _RATIOS,
    "char_shingle_stats": f"SELECT doc_id, len({_GRAMS.replace("{t}", 'text')}) AS shingles FROM documents",
    "contamination_flag": f"WITH {_SCORES} SELECT doc_id, same OR s >= 0.1 AS contaminated, CAST(floor(s * 1000 + 0.5) AS BIGINT) AS score_permille FROM scored",
    "contamination_flag_joined": f"WITH {_SCORES} SELECT doc_id, same OR s >= 0.1 AS contaminated, CAST(floor(s * 1000 + 0.5) AS BIGINT) AS score_permille FROM scored",
    "contamination_remove": f"WITH {_SCORES} SELECT doc_id FROM scored WHERE NOT (same OR s >= 0.1)",
    "corpus_report": "SELECT source, count(*) AS records, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes, grouping(source) = 1 AS total FROM documents GROUP BY ROLLUP (source)",
    "aggregate_shards_additive": "SELECT source, count(*) AS records, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes, grouping(source) = 1 AS total FROM documents GROUP BY ROLLUP (source)",
    "duplicate_ids": "SELECT id, count(*) AS times FROM (SELECT id FROM records UNION ALL SELECT id FROM probes) GROUP BY id HAVING count(*) > 1",
    "benchmark_index": f"""
        WITH p AS (SELECT id, min(text) AS text FROM probes GROUP BY id), t AS {_TASKS},
        c AS (SELECT 'probes:' || id AS id, text, 'probes/text' AS source, 0 AS tab, id AS pos, 0 AS part FROM p
              UNION ALL SELECT 'scored:' || id || ':prompt', prompt, 'scored/prompt', 1, id, 0 FROM t
              UNION ALL SELECT 'scored:' || id || ':answer', answer, 'scored/answer', 1, id, 1 FROM t),
        n AS (SELECT *, {_norm('text')} AS norm FROM c)
        SELECT id, sha1(text) AS text_sha1, source FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY tab, pos, part) AS r FROM n WHERE norm <> '' AND (part = 0 OR length(norm) >= 5)) WHERE r = 1""",
    "train_eval_split": f"SELECT doc_id, is_eval FROM ({_SPLIT})",
    "heldout_disjoint": f"WITH s AS ({_SPLIT}) SELECT doc_id FROM s WHERE is_eval AND text NOT IN (SELECT text FROM s WHERE NOT is_eval AND text IS NOT NULL)",
    "paragraph_explode": _PARAGRAPHS.replace("{cut}", "\\n[" + _WHITE + "]*\\n"),
    "line_explode": _PARAGRAPHS.replace("{cut}", "\\n+"),
    "tokenizer_compression": "WITH " + _compression(),
    "tokenizer_compression_bpe": f"WITH {MERGES}, " + _compression(f", {{'tokenizer': 'bpe', 'tokens': {tokens_of('text')}}}", ", merges"),
    "bpe_token_counts": f"WITH {MERGES} SELECT doc_id, CAST({tokens_of('text')} AS BIGINT) AS tokens FROM documents, merges",
    "encode_chat": f"WITH {MERGES} SELECT id AS conv_id, CAST({tokens_of(_CHAT)} AS BIGINT) AS tokens FROM {_TASKS}, merges",
    "metric_matrix": "SELECT id, " + ", ".join(f"CAST({_metric(m, 'other', 'answer')} AS INTEGER) AS {m}" for m in _METRICS) + f" FROM (SELECT id, answer, ' The answer is ' || upper(trim(answer)) || ' !' AS other FROM {_TASKS})",
    "suite_violations": " UNION ALL ".join(f"SELECT '{name}' AS rule, count(*) FILTER (WHERE NOT coalesce({ok}, false)) AS rows FROM scored_tasks" for name, ok in _RULES.items()),
    "byte_budget_cap": f"""
        WITH RECURSIVE paragraphs AS ({_PARAGRAPHS.replace("{cut}", "\\n[" + _WHITE + "]*\\n")}),
        placed AS (SELECT coalesce(lang, 'none') AS language, doc_id AS ord, idx, bytes, sum(bytes) OVER (PARTITION BY doc_id ORDER BY idx) AS upto FROM paragraphs JOIN documents ON CAST(doc_id AS VARCHAR) = key),
        sources AS (SELECT language, ord, list(upto) AS sums, row_number() OVER (PARTITION BY language ORDER BY ord) AS step FROM placed GROUP BY language, ord),
        walk AS (SELECT DISTINCT language, CAST(0 AS BIGINT) AS step, CAST(NULL AS BIGINT) AS ord, CAST(0 AS BIGINT) AS room, CAST(0 AS BIGINT) AS used FROM sources UNION ALL
                 SELECT s.language, s.step, s.ord, 60000 - w.used, CAST(w.used + coalesce(list_max(list_filter(s.sums, lambda x: x <= 60000 - w.used)), 0) AS BIGINT) FROM walk w JOIN sources s ON s.language = w.language AND s.step = w.step + 1)
        SELECT p.language, p.ord, p.idx, p.bytes FROM placed p JOIN walk w ON w.language = p.language AND w.ord = p.ord WHERE w.room > 0 AND p.upto <= w.room""",
    "near_dup_kept": f"""WITH RECURSIVE {_similar("SELECT min(doc_id) AS pos, text FROM documents WHERE text IS NOT NULL AND text <> '' GROUP BY text")}, {_GREEDY}
        SELECT min(doc_id) AS doc_id FROM documents GROUP BY text HAVING min(doc_id) NOT IN (SELECT pos FROM dropped)""",
    "near_dup_kept_records": f"""WITH RECURSIVE {_similar(_UNIQUE_RECORDS)}, {_GREEDY}
        SELECT id, pos FROM records WHERE pos IN (SELECT min(pos) FROM records GROUP BY text) AND pos NOT IN (SELECT pos FROM dropped)""",
    "probe_summary": """SELECT language, domain, grouping(language) * 2 + grouping(domain) AS level, count(*) AS probes, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS chars, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes
        FROM probes GROUP BY GROUPING SETS ((), (language), (domain))""",
    "ngram_counts": f"""
        WITH p AS ({_byte_rows("documents")})
        SELECT CAST(k AS BIGINT) AS k, CASE WHEN k = 0 THEN 0 ELSE CAST(('0x' || ctx) AS BIGINT) END AS context, CAST(('0x' || b) AS BIGINT) AS byte, n FROM (
          SELECT 0 AS k, '' AS ctx, b, count(*) AS n FROM p GROUP BY ALL UNION ALL SELECT 1, b1, b, count(*) FROM p WHERE i >= 1 GROUP BY ALL UNION ALL SELECT 2, b2 || b1, b, count(*) FROM p WHERE i >= 2 GROUP BY ALL)""",
    "ngram_bpb": _BPB,
    "scored_suite_gold": _suite("answer"),
    "scored_suite_empty": _suite("''"),
    "scored_suite_echo": _suite("prompt"),
    "scored_suite_mock": _suite(f"({_MOCK})"),
    "suite_failures": f"SELECT id FROM {_TASKS} WHERE NOT {_passed('prompt')}",
    "niah_tasks": f"""WITH {_CELLS} SELECT 'niah-L' || length || '-D' || depth AS id, answer,
        sha1(substring(filler, 1, spot) || ' Note: the secret ' || key || ' is ' || answer || '. ' || substring(filler, spot + 1) || chr(10) || chr(10) || 'What is the secret ' || key || '? Answer with the value only.') AS prompt_sha1,
        CAST(length AS BIGINT) AS length, depth, spot + 1 AS needle_pos FROM placed""",
    "niah_matrix_window": f"""WITH {_CELLS} SELECT CAST(length AS BIGINT) AS length, {', '.join(f"CAST(max(CASE WHEN depth = {d} AND spot + 1 < 600 THEN 1 WHEN depth = {d} THEN 0 END) AS BIGINT) AS d{int(d * 100)}" for d in (0.0, 0.25, 0.5, 0.75, 1.0))} FROM placed GROUP BY length""",
    "niah_accuracy": f"""WITH {_CELLS} SELECT CASE grouping(length) * 2 + grouping(depth) WHEN 3 THEN 'overall' WHEN 1 THEN 'length' ELSE 'depth' END AS level, CAST(length AS BIGINT) AS length, depth,
        CAST(sum(CASE WHEN spot + 1 < 600 THEN 1 ELSE 0 END) AS BIGINT) AS passed, count(*) AS total FROM placed GROUP BY GROUPING SETS ((), (length), (depth))""",
    "format_chat": f"SELECT id AS conv_id, '<bos><system>' || area || '<eos><user>' || coalesce(prompt, '') || '<eos><assistant>' || coalesce(answer, '') || '<eos>' AS text FROM {_TASKS}",
    "bpe_round_trip": "SELECT doc_id, sha1(text) AS text_sha1 FROM documents WHERE text IS NOT NULL",
    "bpe_pair_counts": f"""
        SELECT CAST(('0x' || b1) AS BIGINT) AS left_id, CAST(('0x' || b) AS BIGINT) AS right_id, count(*) AS n FROM ({_byte_rows("documents")}) WHERE i >= 1 GROUP BY ALL""",
    "bpe_pair_top": f"""
        SELECT CAST(('0x' || b1) AS BIGINT) AS left_id, CAST(('0x' || b) AS BIGINT) AS right_id, count(*) AS n FROM ({_byte_rows("documents")}) WHERE i >= 1 GROUP BY ALL ORDER BY n DESC, left_id, right_id LIMIT 1""",
    "vocab_gains": """SELECT name, round((before - ja) / before, 6) AS gain, v * 2048 AS embed_params FROM (SELECT *, lag(ja) OVER (ORDER BY v) AS before FROM (
        VALUES ('bpe-512', 512::BIGINT, 1.3611::DOUBLE), ('bpe-1024', 1024, 1.0598), ('bpe-2048', 2048, 0.8653), ('bpe-4096', 4096, 0.7165), ('bpe-8192', 8192, 0.6152)) AS p(name, v, ja))""",
    "vocab_knee": """WITH g AS (SELECT *, lag(ja) OVER (ORDER BY v) AS before, lag(name) OVER (ORDER BY v) AS prev FROM (
        VALUES ('bpe-512', 512, 1.3611::DOUBLE), ('bpe-1024', 1024, 1.0598), ('bpe-2048', 2048, 0.8653), ('bpe-4096', 4096, 0.7165), ('bpe-8192', 8192, 0.6152)) AS p(name, v, ja))
        SELECT prev AS name, true AS cost_knee_reached FROM g WHERE (before - ja) / before < 0.18 ORDER BY v LIMIT 1""",
    "load_order": "SELECT doc_id, ord FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ord FROM documents) WHERE ord >= 25 AND ord < 125",
    "record_json": "SELECT pos, id, sha1(text) AS text_sha1, source, meta['license'] AS license, meta['batch'] AS batch, meta['domain'] AS domain, meta['language'] AS language FROM records",
    "meta_update": "SELECT pos, 'b0' AS batch, split_name AS checked, meta['license'] AS license FROM records",
    "source_manifest_checks": """SELECT DISTINCT source, title, coalesce(regexp_matches(snapshot_date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$'), false) AS date_ok, coalesce(regexp_matches(language, '^[a-z]{2,3}(-[A-Z]{2})?$'), false) AS language_ok,
        length(coalesce(license_name, '')) > 0 AS license_ok FROM (SELECT DISTINCT * FROM dataset_sources)""",
    "archive_links": "SELECT * FROM (VALUES (1::BIGINT, 'http://a.test/cards/files/12_ruby_3.zip'), (2, 'http://b.test/c/files/abc.zip')) AS t(page_id, archive)",
    "pipeline_report": f"""WITH {_SCORES}, flags AS (SELECT doc_id, same OR s >= 0.1 AS bad FROM scored),
        n AS (SELECT d.doc_id, documents.source, d.t FROM docs d JOIN documents USING (doc_id) WHERE d.t <> ''),
        kept AS (SELECT * FROM n WHERE doc_id IN (SELECT min(doc_id) FROM n GROUP BY t) AND length(t) >= 3 AND doc_id IN (SELECT doc_id FROM flags WHERE NOT bad))
        SELECT source, count(*) AS records, CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS chars, CAST(coalesce(sum({_bytes('t')}), 0) AS BIGINT) AS bytes, grouping(source) = 1 AS total FROM kept GROUP BY ROLLUP (source)""",
    "stream_clean": f"SELECT sha1(t) AS text_sha1, CAST(1 AS BIGINT) AS rows FROM (SELECT DISTINCT {_norm('text')} AS t FROM records) WHERE length(t) >= 200",
    "near_dup_pairs": f"WITH {_similar(_UNIQUE_RECORDS)} SELECT a, b, common, total FROM similar_pairs",
}
