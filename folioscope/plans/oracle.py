"""The registered queries once more, as DuckDB SQL over the given tables."""

from __future__ import annotations

import re

from folioscope.functions import rules
from folioscope.functions.text import LATIN_FROM, LATIN_TO
from folioscope.operators import answers, context
from folioscope.operators.profile import MARKERS
from folioscope.plans import fixtures
from folioscope.plans.packs import PROFILE_MARKERS, SAMPLE_MARKERS, SAMPLE_PACK

WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
TOKEN = r"[\p{L}\p{N}]+"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(text: str) -> str:
    return f"trim({text}, {WS})"


def collapse(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


def normalize(text: str) -> str:
    return collapse(f"lower(translate({text}, '_-', '  '))")


def compact(text: str, limit: int) -> str:
    flat = collapse(text)
    return (
        f"CASE WHEN length({flat}) <= {limit} THEN {flat} "
        f"ELSE rtrim(substring({flat}, 1, {limit - 3})) || '...' END"
    )


def tokens(text: str) -> str:
    folded = f"translate(lower({text}), {quoted(LATIN_FROM)}, {quoted(LATIN_TO)})"
    return f"regexp_extract_all({folded}, '{TOKEN}')"


def contains_any(text: str, markers) -> str:
    return "(" + " OR ".join(f"contains(lower({text}), {quoted(marker.lower())})" for marker in markers) + ")"


EXTENSION = "CASE doc_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'docx' WHEN 2 THEN 'doc' ELSE 'txt' END"
TYPE = (
    "CASE doc_id % 5 WHEN 0 THEN 'order' WHEN 1 THEN 'procedure' WHEN 2 THEN 'training_manual' "
    "WHEN 3 THEN 'standard_or_norms' ELSE 'list' END"
)

DOCS = f"""
docs AS (
  SELECT doc_id AS id, '/corpus/' || source || '/' || doc_id || '.' || ext AS path,
    source || '/' || doc_id || '.' || ext AS relative_path, doc_id || '.' || ext AS name, ext AS extension,
    document_type, CASE doc_id % 3 WHEN 0 THEN 'reference' WHEN 1 THEN 'training' END AS content_category,
    source AS folder_category, '/corpus' AS scan_root, strlen(text) AS size_bytes, sha256(text) AS sha256,
    {strip("text")} <> '' AS has_text, ext = 'pdf' AND {strip("text")} = '' AS ocr_required
  FROM (SELECT *, {EXTENSION} AS ext, {TYPE} AS document_type FROM documents))"""

WHOLE_PAGES = """
pg AS (
  SELECT doc_id * 4294967296 + 1 AS id, doc_id AS document_id, 1 AS page_number, text, length(text) AS text_length
  FROM documents)"""

TABLE_PAGES = """
pg AS (
  SELECT doc_id * 4294967296 + 1 AS id, doc_id AS document_id, 1 AS page_number,
    'Table 1. ' || text || ' End of table.' AS text, length(text) + 23 AS text_length
  FROM documents)"""

LINE_PAGES = """
doc_lines AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
doc_parts AS (SELECT doc_id, lines, unnest(range((len(lines) - 1) // 20 + 1)) AS nr FROM doc_lines),
pg AS (
  SELECT doc_id * 4294967296 + nr + 1 AS id, doc_id AS document_id, nr + 1 AS page_number,
    array_to_string(lines[nr * 20 + 1 : nr * 20 + 20], chr(10)) AS text,
    length(array_to_string(lines[nr * 20 + 1 : nr * 20 + 20], chr(10))) AS text_length
  FROM doc_parts)"""

POINT_PAGES = """
doc_lines AS (
  SELECT doc_id, i, i || '. ' || string_split(text, chr(10))[i] AS line, len(string_split(text, chr(10))) AS n
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)),
pg AS (
  SELECT doc_id * 4294967296 + 1 AS id, doc_id AS document_id, 1 AS page_number,
    string_agg(line, chr(10) ORDER BY i) AS text, length(string_agg(line, chr(10) ORDER BY i)) AS text_length
  FROM doc_lines GROUP BY doc_id)"""

# A last line without text has nothing behind its number, so it is no point of its own.
SECTIONS = f"""
starts AS (
  SELECT doc_id, i, coalesce(sum(length(line) + 1) OVER (
      PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
    i < n OR {strip("substring(line, length(i || '. ') + 1)")} <> '' AS is_point
  FROM doc_lines),
point_counts AS (SELECT doc_id AS document_id, count(*) AS points FROM starts WHERE is_point GROUP BY doc_id),
sec AS (
  SELECT page_id, idx, s, e, text, e - s AS len, length({strip("text")}) > 2500 AS over FROM (
    SELECT pg.id AS page_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS idx, s,
      coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), pg.text_length) AS e,
      substring(pg.text, s + 1, coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), pg.text_length) - s) AS text
    FROM starts JOIN pg ON pg.document_id = starts.doc_id WHERE is_point)
  WHERE page_id IN (SELECT id FROM routed WHERE source_type = 'structure')),
pack AS (
  SELECT page_id, idx, over, s, e, 1 AS grp, CASE WHEN over THEN 0 ELSE len END AS buf FROM sec WHERE idx = 1
  UNION ALL
  SELECT c.page_id, c.idx, c.over, c.s, c.e,
    CASE WHEN c.over OR p.over OR p.buf + c.len > 2500 THEN p.grp + 1 ELSE p.grp END,
    CASE WHEN c.over THEN 0 WHEN p.over OR p.buf + c.len > 2500 THEN c.len ELSE p.buf + c.len END
  FROM pack p JOIN sec c ON c.page_id = p.page_id AND c.idx = p.idx + 1),
packed AS (SELECT page_id, min(s) AS s, max(e) AS e FROM pack WHERE NOT over GROUP BY page_id, grp)"""

NO_SECTIONS = """
point_counts AS (
  SELECT document_id,
    len(regexp_extract_all(text, '(?m)^\\s*\\d+(?:\\.\\d+){0,2}\\.\\s+\\S')) AS points FROM pg),
sec AS (SELECT 0 AS page_id, 0 AS s, '' AS text, false AS over WHERE false),
packed AS (SELECT 0 AS page_id, 0 AS s, 0 AS e WHERE false)"""

ROUTED = f"""
routed AS (
  SELECT pg.*, length({strip("pg.text")}) AS clean_length,
    CASE WHEN d.document_type IN ('order', 'procedure', 'instruction', 'doctrine') AND points >= 3
        THEN 'structure'
      WHEN d.content_category = 'reference' AND pg.text_length <= 3000
        AND len(regexp_extract_all(pg.text, '(?i)\\btable\\b')) >= 2 THEN 'table_page'
      WHEN pg.text_length <= 3000 THEN 'page' ELSE 'long_page' END AS source_type
  FROM pg JOIN docs d ON d.id = pg.document_id JOIN point_counts USING (document_id)
  WHERE d.has_text AND NOT d.ocr_required)"""


def _last(mark: str, window: str) -> str:
    """0-based place of the last mark in the window, -1 without one."""
    backwards = f"strpos(reverse({window}), {mark})"
    width = f"length({mark})"
    return f"(CASE WHEN {backwards} = 0 THEN -1 ELSE length({window}) - {backwards} - {width} + 1 END)"


def _window_end(start: str) -> str:
    window = f"substring(text, {start} + 1, 2500)"
    places = ", ".join(_last(mark, window) for mark in ("chr(10)", "' .'", "' !'", "' ?'"))
    best = f"greatest({places})"
    return (
        f"CASE WHEN {start} + 2500 >= n THEN n WHEN {best} > 1250 THEN {start} + {best} + 1 "
        f"ELSE {start} + 2500 END"
    )


WINDOWS = f"""
win AS (
  SELECT page_id, base, text, n, 0 AS s, {_window_end("0")} AS e FROM long_texts
  UNION ALL
  SELECT page_id, base, text, n, e - 300, {_window_end("(e - 300)")} FROM win WHERE e < n)"""

LONG_PAGES = """
long_texts AS (SELECT id AS page_id, 0 AS base, text, length(text) AS n FROM pg WHERE length(text) > 0)"""

PIECES = f"""
long_texts AS (
  SELECT id AS page_id, 0 AS base, text, length(text) AS n FROM routed WHERE source_type = 'long_page'
  UNION ALL
  SELECT page_id, s AS base, text, length(text) AS n FROM sec WHERE over),
{WINDOWS.strip()},
piece_spans AS (
  SELECT page_id, base + s AS s, base + e AS e FROM win
  UNION ALL SELECT page_id, s, e FROM packed
  UNION ALL SELECT id, 0, text_length FROM routed WHERE source_type IN ('page', 'table_page')),
pieces AS (
  SELECT r.document_id, r.id AS page_id, r.page_number, r.source_type, p.s, p.e,
    {strip("substring(r.text, p.s + 1, p.e - p.s)")} AS chunk_text
  FROM piece_spans p JOIN routed r ON r.id = p.page_id),
totals AS (SELECT document_id, sum(clean_length) AS chars FROM routed GROUP BY document_id),
kept AS (
  SELECT p.* FROM pieces p JOIN totals t USING (document_id)
  WHERE chunk_text <> '' AND (length(chunk_text) >= 100 OR (t.chars < 100 AND t.chars >= 50))
    AND NOT (t.chars < 50)),
chunks AS (
  SELECT document_id || '-' || chunk_index || '-' || substring(md5(chunk_text), 1, 8) AS chunk_id, * FROM (
    SELECT document_id, page_id, page_number,
      row_number() OVER (PARTITION BY document_id ORDER BY page_number, s) - 1 AS chunk_index, chunk_text,
      length(chunk_text) AS chunk_length, source_type, s AS start_char, e AS end_char,
      CASE source_type WHEN 'structure' THEN 'structure_based_points' WHEN 'table_page' THEN 'table_or_page_based'
        WHEN 'long_page' THEN 'split_long_page'
        ELSE CASE WHEN page_number = 1 THEN 'document_or_page_based' ELSE 'page_based' END END AS chunk_strategy
    FROM kept))"""

def with_ctes(select: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",".join(cte.strip() for cte in ctes) + "\n" + select.strip()


def _chunk_ctes(pages: str, points: bool) -> tuple[str, ...]:
    if points:
        counts, rest = SECTIONS.split("sec AS", 1)
        return DOCS, pages, counts.rstrip().rstrip(","), ROUTED, "sec AS" + rest, PIECES
    counts, rest = NO_SECTIONS.split("sec AS", 1)
    return DOCS, pages, counts.rstrip().rstrip(","), ROUTED, "sec AS" + rest, PIECES


CHUNKS = _chunk_ctes(WHOLE_PAGES, points=False)

OTHER_FIELDS = (
    "d.name || ' ' || d.relative_path || ' ' || d.document_type || ' ' || coalesce(d.content_category, '') "
    "|| ' ' || c.chunk_strategy"
)
INDEX = f"""
idx AS (
  SELECT c.chunk_id, c.document_id, c.chunk_index, d.document_type, d.content_category, c.chunk_strategy,
    {tokens("c.chunk_text")} AS tokens, len({tokens("c.chunk_text")}) + len({tokens(OTHER_FIELDS)}) AS doc_len
  FROM chunks c JOIN docs d ON d.id = c.document_id),
occ AS (
  SELECT chunk_id, pos, term, lead(term) OVER (PARTITION BY chunk_id ORDER BY pos) AS nxt
  FROM (SELECT chunk_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) AS pos FROM idx)),
corpus AS (SELECT count(*) AS n, sum(doc_len) AS total, avg(doc_len) AS avg_len FROM idx)"""

PLAIN_QUERIES = "qs AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
PHRASE_QUERIES = (
    f"qs AS (SELECT item_id AS query_id, regexp_replace(text, '^({TOKEN}) ({TOKEN})', '\\1_\\2') AS query "
    "FROM benchmark)"
)
UNITS = f"""
raw_tokens AS (
  SELECT query_id, unnest(found) AS token, generate_subscripts(found, 1) AS nr
  FROM (SELECT query_id, regexp_extract_all(lower(query), '[\\p{{L}}\\p{{N}}_]+') AS found FROM qs)),
units AS (
  SELECT query_id, token, row_number() OVER (PARTITION BY query_id ORDER BY min(nr)) - 1 AS position,
    {tokens("token")} AS words
  FROM raw_tokens WHERE length(token) >= 2 GROUP BY query_id, token)"""

SCORED = """
unit_tf AS (
  SELECT u.words, o.chunk_id, count(*) AS tf
  FROM (SELECT DISTINCT words FROM units) u
  JOIN occ o ON o.term = u.words[1] AND (len(u.words) = 1 OR o.nxt = u.words[2])
  GROUP BY u.words, o.chunk_id),
unit_idf AS (
  SELECT words, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END
    AS idf
  FROM (SELECT words, count(*) AS df FROM unit_tf GROUP BY words), corpus),
sizes AS (SELECT query_id, count(*) AS n_units FROM units GROUP BY query_id),
scored AS (
  SELECT u.query_id, i.chunk_id, i.document_id, i.chunk_index, i.document_type, i.content_category,
    i.chunk_strategy, count(*) AS matched,
    sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS bm25
  FROM units u JOIN unit_tf t ON t.words = u.words JOIN unit_idf f ON f.words = u.words
  JOIN idx i ON i.chunk_id = t.chunk_id, corpus
  GROUP BY ALL),
scored_all AS (SELECT s.*, matched = n_units AS complete FROM scored s JOIN sizes USING (query_id))"""


def lexical(name: str, k: int, boosted: bool = False, where: str = "true") -> str:
    boost = (
        "CASE WHEN document_type = 'standard_or_norms' AND content_category = 'reference' THEN 5.0 "
        "WHEN content_category = 'reference' THEN 1.0 ELSE 0.0 END"
        if boosted
        else "0.0"
    )
    return f"""
{name}_cand AS (
  SELECT *, bm25 + {boost} AS score, max(complete) OVER (PARTITION BY query_id) AS best_class
  FROM scored_all WHERE {where}),
{name} AS (
  SELECT query_id, rank, score, chunk_id, document_id, chunk_index, complete AS all_terms FROM (
    SELECT *, row_number() OVER (
      PARTITION BY query_id ORDER BY round(score, 10) DESC, document_id, chunk_index) AS rank
    FROM {name}_cand WHERE complete = best_class) WHERE rank <= {k})"""


EMBEDDED = """
emb AS (
  SELECT c.chunk_id, c.document_id, c.chunk_index, e.embedding::DOUBLE[] AS embedding
  FROM chunks c JOIN embeddings e ON e.vec_id = c.document_id WHERE c.chunk_index = 0),
qvec AS (
  SELECT item_id AS query_id, embedding::DOUBLE[] AS vector FROM benchmark JOIN embeddings ON vec_id = item_id)"""


def semantic(name: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT query_id, rank, similarity, chunk_id, document_id, chunk_index FROM (
    SELECT *, row_number() OVER (
      PARTITION BY query_id ORDER BY round(similarity, 12) DESC, document_id, chunk_index) AS rank
    FROM (SELECT query_id, chunk_id, document_id, chunk_index,
            list_cosine_similarity(vector, embedding) AS similarity FROM qvec, emb))
  WHERE rank <= {k})"""


def fused(name: str, left: str, right: str, k: int) -> str:
    return f"""
{name} AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC,
      coalesce(fts_rank, 1000000000), coalesce(embedding_rank, 1000000000)) AS rank
    FROM (
      SELECT coalesce(l.query_id, r.query_id) AS query_id, coalesce(l.chunk_id, r.chunk_id) AS chunk_id,
        coalesce(l.document_id, r.document_id) AS document_id, coalesce(l.chunk_index, r.chunk_index) AS chunk_index,
        l.rank AS fts_rank, r.rank AS embedding_rank, l.score AS fts_score, r.similarity AS embedding_similarity,
        coalesce(1.5 * (1.0::DOUBLE / (60.0::DOUBLE + l.rank)), 0)
          + coalesce(1.0::DOUBLE / (60.0::DOUBLE + r.rank), 0) AS score
      FROM {left} l FULL OUTER JOIN {right} r ON r.query_id = l.query_id AND r.chunk_id = l.chunk_id))
  WHERE rank <= {k})"""


RETRIEVAL = (*CHUNKS, INDEX, PLAIN_QUERIES, UNITS, SCORED)
BM25_COLUMNS = "query_id, rank, round(score, 6) AS score, chunk_id, document_id, chunk_index, all_terms"

QRELS = f"""
qrels AS (
  SELECT item_id AS query_id, doc_id || '.' || {EXTENSION} AS name, doc_id
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
qset AS (SELECT item_id AS query_id, text AS query FROM benchmark WHERE item_id IN (SELECT query_id FROM qrels))"""

EVALUATED = (
    *RETRIEVAL,
    EMBEDDED,
    lexical("lex", 50),
    semantic("sem", 50),
    fused("hyb", "lex", "sem", 10),
    QRELS,
    """
evaluated AS (
  SELECT *, CASE
    WHEN (fts_rank = best)::INT + 0 = 1 AND coalesce(embeddings_rank <> best, true) AND coalesce(hybrid_rank <> best, true)
      THEN 'fts'
    WHEN embeddings_rank = best AND coalesce(fts_rank <> best, true) AND coalesce(hybrid_rank <> best, true)
      THEN 'embeddings'
    WHEN hybrid_rank = best AND coalesce(fts_rank <> best, true) AND coalesce(embeddings_rank <> best, true)
      THEN 'hybrid' ELSE 'tie' END AS winner
  FROM (SELECT *, least(fts_rank, embeddings_rank, hybrid_rank) AS best FROM (
    SELECT q.query_id, q.query,
      (SELECT min(rank) FROM lex r JOIN qrels k ON k.query_id = r.query_id AND k.doc_id = r.document_id
        WHERE r.query_id = q.query_id AND rank <= 10) AS fts_rank,
      (SELECT min(rank) FROM sem r JOIN qrels k ON k.query_id = r.query_id AND k.doc_id = r.document_id
        WHERE r.query_id = q.query_id AND rank <= 10) AS embeddings_rank,
      (SELECT min(rank) FROM hyb r JOIN qrels k ON k.query_id = r.query_id AND k.doc_id = r.document_id
        WHERE r.query_id = q.query_id AND rank <= 10) AS hybrid_rank
    FROM qset q)))""",
)

LOCATION = (
    "CASE WHEN d.extension = 'pdf' THEN 'page ' || c.page_number "
    "ELSE 'fragment ' || c.chunk_index || ', chars ' || c.start_char || '-' || c.end_char END"
)
SOURCES = (
    *RETRIEVAL,
    EMBEDDED,
    lexical("lex", 70, boosted=True),
    semantic("sem", 70),
    fused("hyb", "lex", "sem", 20),
    f"""
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS citation_id FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank) AS first FROM hyb)
  WHERE first = 1),
sources AS (
  SELECT b.query_id, b.citation_id, b.document_id, b.chunk_id, d.relative_path AS display_path,
    {LOCATION} AS location, {compact("c.chunk_text", 220)} AS preview, c.page_number, d.extension AS source_type,
    '/documents/' || d.id || '/view' AS view_url, '/documents/' || d.id || '/download' AS download_url,
    '/documents/' || d.id || '/view' || CASE WHEN d.extension = 'pdf' THEN '#page=' || c.page_number ELSE '' END
      AS view_href,
    d.document_type, coalesce(d.content_category, 'unknown') AS category, {compact("c.chunk_text", 1600)} AS text
  FROM best b JOIN chunks c ON c.chunk_id = b.chunk_id JOIN docs d ON d.id = b.document_id
  WHERE citation_id <= 5)""",
)


def context_block(with_text: bool, with_id: bool) -> str:
    lines = [
        "'[' || citation_id || ']'",
        "'Document: ' || display_path",
        "'Location: ' || location",
        *(["'Document ID: ' || document_id"] if with_id else []),
        "'Type: ' || document_type",
        "'Category: ' || category",
        "'Preview: ' || preview",
        *(["'Text:' || chr(10) || text"] if with_text else []),
    ]
    return " || chr(10) || ".join(lines)


def assembled(benchmark: bool) -> str:
    missing = "" if benchmark else context.NO_SOURCES
    return f"""
SELECT q.query_id, q.query, 'conceptual' AS query_type, count(s.query_id) AS source_count,
  coalesce(string_agg({context_block(True, benchmark)}, chr(10) || chr(10) ORDER BY citation_id),
    {quoted(missing)}) AS context
FROM qs q LEFT JOIN sources s ON s.query_id = q.query_id GROUP BY q.query_id, q.query"""


ANSWERS = """
ans AS (
  SELECT conv_id || '-' || turn AS query_id, 'm' || (conv_id % 3) AS model,
    CASE WHEN (conv_id + turn) % 3 = 0 THEN text || ' [' || (turn % 4) || ']' ELSE text END AS answer,
    turn % 4 AS source_count, length(text) / 64.0::DOUBLE AS total_time_seconds,
    length(text) / 128.0::DOUBLE AS llm_time_seconds
  FROM conversations WHERE role = 'assistant')"""


def flagged(thinking, foreign) -> str:
    return f"""
flagged AS (
  SELECT *, length(answer) AS answer_chars, {strip("answer")} <> '' AS has_answer, source_count > 0 AS has_sources,
    regexp_matches(answer, '\\[\\d+\\]') AS has_citations, {contains_any("answer", thinking)} AS contains_thinking,
    {contains_any("answer", foreign)} AS wrong_language_suspected, {strip("answer")} = '' AS empty_answer,
    length({strip("answer")}) > 0 AND length({strip("answer")}) < 80 AS too_short_answer
  FROM ans)"""


FLAGGED = flagged(answers.THINKING_MARKERS, answers.RUSSIAN_MARKERS)
FLAGGED_SAMPLE = flagged(SAMPLE_MARKERS["thinking"], SAMPLE_MARKERS["foreign"])
FLAG_LIST = "coalesce(nullif(concat_ws(', ', " + ", ".join(
    f"CASE WHEN {name} THEN {quoted(label)} END" for name, label in answers.FLAG_LABELS.items()
) + "), ''), 'none')"


def _first_rule(pairs, text: str, prefix: str = "", searched=None) -> tuple[str, str]:
    both = list(zip(pairs, searched or pairs))
    value = " ".join(f"WHEN regexp_matches({text}, {quoted('(?i)' + p)}) THEN {quoted(v)}" for (v, _), (_, p) in both)
    note = " ".join(f"WHEN regexp_matches({text}, {quoted('(?i)' + p)}) THEN {quoted(prefix + n)}" for (_, n), (_, p) in both)
    return f"(CASE {value} END)", f"(CASE {note} END)"


def with_borders(pattern: str) -> str:
    """A pattern whose word borders hold for letters of every script, for RE2, which knows those of ASCII letters only: a
    border is the sign before or behind it, or an end of the text."""
    letter, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"

    def border(mark: re.Match) -> str:
        following = pattern[mark.end() :].removeprefix("(")
        if following.startswith("№"):
            return letter
        opens = following[:1].isalnum() or following.startswith((r"\d", "[0-9"))
        return f"(?:^|{other})" if opens else f"(?:$|{other})"

    return re.sub(r"\\b", border, pattern)


def bordered(pack: rules.RulePack) -> rules.RulePack:
    def each(pairs):
        return tuple((value, with_borders(pattern)) for value, pattern in pairs)

    return rules.RulePack(
        each(pack.document_types),
        each(pack.content_categories),
        tuple(map(with_borders, pack.document_numbers)),
        each(pack.organizations),
    )


def metadata(pack: rules.RulePack, start: str = "t.text_start", searched: rules.RulePack | None = None) -> tuple[str, ...]:
    """Rules as CASE chains. RE2 knows word borders of ASCII letters only, which is all the given texts start words with;
    ``searched`` is the pack in another form for texts with other words."""
    searched = searched or pack
    values, notes = [], []
    for source, column in (("name", "name_text"), ("path", "path_text"), ("text", "text")):
        value, note = _first_rule(pack.document_types, column, f"document_type:{source}:", searched.document_types)
        values.append(value)
        notes.append(note)
    category, category_note = _first_rule(pack.content_categories, "text", "content_category:", searched.content_categories)
    organization, organization_note = _first_rule(pack.organizations, "text", "organization:", searched.organizations)
    number = " ".join(
        f"WHEN regexp_matches(raw, {quoted('(?i)' + p)}) THEN {collapse(f'regexp_extract(raw, {quoted("(?i)" + p)}, 1)')}"
        for p in searched.document_numbers
    )
    number_note = " ".join(
        f"WHEN regexp_matches(raw, {quoted('(?i)' + p)}) THEN {quoted('document_number:' + n)}"
        for n, p in zip(pack.document_numbers, searched.document_numbers)
    )

    def date(pattern: str, year: int, month: int, day: int) -> str:
        parts = [f"regexp_extract(raw, {quoted(pattern)}, {group})::INT" for group in (year, month, day)]
        full = f"CASE WHEN {parts[0]} >= 100 THEN {parts[0]} WHEN {parts[0]} <= 49 THEN {parts[0]} + 2000 ELSE {parts[0]} + 1900 END"
        return (
            f"CASE WHEN regexp_matches(raw, {quoted(pattern)}) THEN "
            f"try_cast(format('{{:04d}}-{{:02d}}-{{:02d}}', {full}, {parts[1]}, {parts[2]}) AS DATE) END"
        )

    return (
        DOCS,
        LINE_PAGES,
        f"""
text_starts AS (
  SELECT document_id, substring(string_agg(text, ' ' ORDER BY page_number), 1, 5000) AS text_start
  FROM pg GROUP BY document_id),
haystacks AS (
  SELECT d.id, {normalize("d.name")} AS name_text, {normalize("d.relative_path || ' ' || d.folder_category")} AS path_text,
    concat_ws(' ', nullif(d.name, ''), nullif(d.relative_path, ''), nullif(d.folder_category, ''),
      nullif({start}, '')) AS raw
  FROM docs d LEFT JOIN text_starts t ON t.document_id = d.id),
ready AS (SELECT *, {normalize("raw")} AS text FROM haystacks),
dated AS (
  SELECT *, {date(rules.NUMERIC_DATE, 3, 2, 1)} AS numeric_date, {date(rules.ISO_LIKE_DATE, 1, 2, 3)} AS iso_date
  FROM ready),
fields AS (
  SELECT id, coalesce({", ".join(values)}) AS kind, coalesce({", ".join(notes)}) AS kind_note,
    {category} AS content_category, {category_note} AS category_note,
    CASE {number} END AS document_number, CASE {number_note} END AS number_note,
    coalesce(numeric_date, iso_date) AS document_date,
    CASE WHEN numeric_date IS NOT NULL THEN 'document_date:numeric_date'
      WHEN iso_date IS NOT NULL THEN 'document_date:iso_like_date' END AS date_note,
    {organization} AS organization, {organization_note} AS organization_note
  FROM dated),
metadata AS (
  SELECT id, coalesce(kind, 'unknown') AS document_type, content_category, document_number, document_date,
    organization,
    CASE found WHEN 5 THEN 'metadata_extracted' WHEN 0 THEN 'metadata_empty' ELSE 'metadata_partial' END
      AS metadata_status,
    concat_ws('; ', kind_note, category_note, number_note, date_note, organization_note,
      CASE WHEN found = 0 THEN 'no_rules_matched' END) AS metadata_notes
  FROM (SELECT *, (kind IS NOT NULL)::INT + (content_category IS NOT NULL)::INT + (document_number IS NOT NULL)::INT
      + (document_date IS NOT NULL)::INT + (organization IS NOT NULL)::INT AS found FROM fields))""",
    )


def re2(pattern: str) -> str:
    """The flags for Unicode classes and line ends are not known to RE2 and make no difference in these texts."""
    return pattern.replace("(?iU)", "(?i)").replace("(?mdU)", "(?m)").replace("(?U)", "")


def markers(patterns) -> tuple[str, ...]:
    counts = ", ".join(
        f'sum(len(regexp_extract_all(text, {quoted(re2(pattern))}))) AS "{name}"' for name, pattern in patterns.items()
    )
    return (
        DOCS,
        POINT_PAGES,
        f"""
doc_markers AS (
  SELECT document_id, count(*) AS n_pages, avg(text_length) AS avg_length, {counts} FROM pg GROUP BY document_id)""",
    )


RECOMMENDED = """
recommended AS (
  SELECT d.id, d.relative_path, CASE
    WHEN d.content_category = 'reference' AND "table" > 0 THEN 'table_or_page_based'
    WHEN d.document_type IN ('order', 'procedure', 'instruction', 'doctrine')
      AND greatest(point_1, point_1_1, point_1_1_1) > 0 THEN 'structure_based_points'
    WHEN d.document_type IN ('training_manual', 'law') AND greatest(section, chapter, appendix) > 0
      THEN 'section_or_page_based'
    WHEN d.document_type = 'list' THEN 'record_or_page_based'
    WHEN d.document_type IN ('poster', 'scheme', 'brandbook') THEN 'page_based'
    WHEN n_pages <= 2 AND avg_length <= 5000 THEN 'document_or_page_based'
    WHEN avg_length > 5000 THEN 'split_long_pages'
    WHEN section + chapter + appendix + point_1 + point_1_1 + point_1_1_1 + "table" = 0
      THEN 'page_based_with_review'
    ELSE 'page_based_initial' END AS recommendation
  FROM docs d JOIN doc_markers m ON m.document_id = d.id)"""


def length_stats(table: str, column: str, by: str = "") -> str:
    group = f"GROUP BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""
SELECT {lead}count({column}) AS n, coalesce(min({column}), 0) AS min, coalesce(max({column}), 0) AS max,
  coalesce(round(avg({column}), 4), 0.0::DOUBLE) AS avg, coalesce(round(median({column}), 4), 0.0::DOUBLE) AS median
FROM {table} {group}"""


VERSIONS = """
old_docs AS (
  SELECT *, CASE WHEN lang = 'en' THEN '/archive' ELSE '/corpus' END AS root FROM (
    SELECT d.*, o.lang FROM docs d JOIN documents o ON o.doc_id = d.id)
  WHERE id IN (SELECT doc_id FROM labels)),
new_docs AS (SELECT * FROM docs WHERE id IN (SELECT vec_id FROM embeddings))"""

SHORT = compact("text", 700)


def _sized(value: str) -> str:
    parts = [f"WHEN {value} < 1024 THEN {value} || ' B'"]
    for power, unit in enumerate(("KiB", "MiB", "GiB"), start=1):
        parts.append(f"WHEN {value} < {1024 ** (power + 1)} THEN format('{{:.1f}} {unit}', {value} / {1024 ** power}::DOUBLE)")
    return f"CASE {' '.join(parts)} ELSE format('{{:.1f}} TiB', {value} / {1024 ** 4}::DOUBLE) END"


def _bytes_decoded() -> str:
    """Latin letters written as single bytes come back as the Cyrillic letters of the first fallback encoding."""
    letters = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖ×ØÙÚÛÜÝÞßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿ"
    shown = "".join(chr(0x410 + ord(letter) - 0xC0) for letter in letters)
    return f"translate(text, {quoted(letters)}, {quoted(shown)})"


def _values(texts) -> str:
    return "[" + ", ".join(map(quoted, texts)) + "]"


ORACLE: dict[str, str] = {}


def _add(name: str, select: str, *ctes: str) -> None:
    ORACLE[name] = with_ctes(select, *ctes) if ctes else select.strip()


# Catalog
_add(
    "catalog_projection",
    """
SELECT path, relative_path, name, extension,
  CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' ELSE 'word' END AS document_type,
  folder_category AS parent_dir, folder_category AS relative_dir, size_bytes, sha256, folder_category,
  'cataloged' AS scan_status, scan_root FROM docs""",
    DOCS,
)
_add(
    "dup_groups",
    """
SELECT sha256, count(*) AS file_count, min(size_bytes) AS size_bytes, min(size_bytes) * (count(*) - 1) AS reclaimable_bytes
FROM docs GROUP BY sha256 HAVING count(*) > 1""",
    DOCS,
)
_add(
    "dup_members",
    """
SELECT path, sha256, file_count FROM (
  SELECT path, sha256, count(*) OVER (PARTITION BY sha256) AS file_count FROM docs) WHERE file_count > 1""",
    DOCS,
)
_add(
    "dup_flags",
    "SELECT path, count(*) OVER (PARTITION BY sha256) > 1 AS is_duplicate_candidate FROM docs",
    DOCS,
)
_add(
    "dup_summary",
    f"""
SELECT *, {_sized("total_bytes")} AS total_size, {_sized("reclaimable_bytes")} AS reclaimable_size FROM (
SELECT sum(n)::BIGINT AS files, sum(bytes)::BIGINT AS total_bytes, count(*) FILTER (n > 1) AS duplicate_groups,
  coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_files,
  coalesce(sum(size * (n - 1)) FILTER (n > 1), 0)::BIGINT AS reclaimable_bytes
FROM (SELECT count(*) AS n, sum(size_bytes) AS bytes, min(size_bytes) AS size FROM docs GROUP BY sha256))""",
    DOCS,
)
for _name, _column in (
    ("count_by_extension", "extension"),
    ("count_by_folder", "folder_category"),
    ("count_by_category", "coalesce(content_category, 'unknown')"),
    ("count_by_type", "document_type"),
):
    _add(_name, f"SELECT {_column} AS value, count(*) AS n FROM docs GROUP BY 1", DOCS)
_add("count_by_lang", "SELECT lang AS value, count(*) AS n FROM documents GROUP BY 1")
_add(
    "catalog_upsert",
    """
SELECT coalesce(o.id, n.id) AS id, coalesce(n.path, o.path) AS path,
  CASE WHEN n.id IS NOT NULL THEN n.kind ELSE o.document_type END AS document_type,
  o.content_category, coalesce(o.scan_status, 'cataloged') AS scan_status,
  coalesce(n.scan_root, o.root) AS scan_root, o.has_text
FROM (SELECT *, 'text_extracted' AS scan_status FROM old_docs) o
FULL OUTER JOIN (SELECT *, CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'text' ELSE 'word' END AS kind FROM new_docs) n
  ON o.path = n.path
WHERE n.path IS NOT NULL OR o.root <> '/corpus'""",
    DOCS,
    VERSIONS,
)
_add(
    "scan_folder",
    f"""
SELECT source || '/' || name AS relative_path, name, extension, size_bytes, sha256, source AS folder_category
FROM (SELECT ({_values(fixtures.NAME_STARTS)})[doc_id % 5 + 1] || doc_id || '.' || ext AS name, ext AS extension, source,
    strlen(text) AS size_bytes, sha256(text) AS sha256 FROM (SELECT *, {EXTENSION} AS ext FROM documents))
WHERE name NOT LIKE '~$%'""",
)
_add(
    "document_record",
    """
SELECT id, path, name AS relative_path, name, extension FROM docs WHERE id = (SELECT max(doc_id) FROM labels)""",
    DOCS,
)
_add(
    "stored_documents",
    """
SELECT id, path, CASE WHEN id % 2 = 0 THEN document_type ELSE 'unknown' END AS document_type, folder_category,
  true AS is_supported FROM docs""",
    DOCS,
)
_add("stored_pages", "SELECT id, document_id, page_number, text_length FROM pg", LINE_PAGES)
_add(
    "overwritten_chunks",
    "SELECT chunk_id, document_id, chunk_index, chunk_length FROM chunks WHERE chunk_length >= 200",
    *CHUNKS,
)
_add(
    "json_lines",
    "SELECT query_id, model, answer, source_count, total_time_seconds FROM ans",
    ANSWERS,
)
_add(
    "vanished_documents",
    "SELECT id, path FROM old_docs WHERE root = '/corpus' AND path NOT IN (SELECT path FROM new_docs)",
    DOCS,
    VERSIONS,
)
_add(
    "orphan_pages",
    "SELECT id, document_id FROM pg WHERE document_id NOT IN (SELECT doc_id FROM labels)",
    LINE_PAGES,
)
_add(
    "schema_conform",
    """
SELECT id, path, name, 'unknown' AS document_type, folder_category, false AS is_temp_file, true AS is_supported,
  'cataloged' AS scan_status, NULL::BOOLEAN AS has_text, NULL::VARCHAR AS organization FROM docs""",
    DOCS,
)
_add(
    "text_decoding",
    f"""
SELECT doc_id, CASE WHEN lang IN ('fr', 'es') AND NOT regexp_full_match(text, '[\\x00-\\x7F]*')
  THEN {_bytes_decoded()} ELSE text END AS text FROM documents""",
)
_add(
    "supported_documents",
    "SELECT id, path FROM docs WHERE extension IN ('pdf', 'doc', 'docx', 'txt')",
    DOCS,
)

# Pages
_ROLLUP = """
rollup_ AS (
  SELECT d.id AS document_id, d.extension, l.toxic = 1 AS failed, coalesce(p.n, 1) AS n, coalesce(p.any_text, false) AS any_text
  FROM docs d LEFT JOIN (SELECT document_id, count(*) AS n, bool_or({any_text}) AS any_text FROM pg GROUP BY 1) p
    ON p.document_id = d.id LEFT JOIN labels l ON l.doc_id = d.id),
rolled AS (
  SELECT document_id, extension, CASE WHEN failed THEN NULL ELSE n END AS pages_count,
    coalesce(NOT failed, true) AND any_text AS has_text,
    extension = 'pdf' AND NOT (coalesce(NOT failed, true) AND any_text) AS ocr_required,
    CASE WHEN failed THEN 'extraction_error: unreadable'
      WHEN extension = 'pdf' AND NOT any_text THEN 'ocr_required' ELSE 'text_extracted' END AS scan_status
  FROM rollup_)""".replace("{any_text}", f"{strip('text')} <> ''")
_add("page_rollup", "SELECT * EXCLUDE (extension) FROM rolled", DOCS, LINE_PAGES, _ROLLUP)
_add(
    "extraction_counters",
    """
SELECT count(*) AS documents, count(*) FILTER (extension = 'pdf') AS pdf_processed,
  count(*) FILTER (extension = 'doc') AS doc_processed, count(*) FILTER (extension = 'docx') AS docx_processed,
  count(*) FILTER (extension = 'txt') AS txt_processed,
  count(*) FILTER (scan_status NOT LIKE 'extraction_error%' AND NOT has_text) AS empty_text,
  count(*) FILTER (scan_status NOT LIKE 'extraction_error%' AND ocr_required) AS ocr_required,
  count(*) FILTER (scan_status LIKE 'extraction_error%') AS errors FROM rolled""",
    DOCS,
    LINE_PAGES,
    _ROLLUP,
)
_add(
    "page_status_update",
    """
SELECT d.id, d.path, r.pages_count, r.has_text, r.ocr_required, r.scan_status
FROM docs d JOIN rolled r ON r.document_id = d.id""",
    DOCS,
    LINE_PAGES,
    _ROLLUP,
)
_add(
    "replace_pages",
    """
SELECT document_id, page_number, text_length FROM pg WHERE document_id NOT IN (SELECT doc_id FROM labels)
UNION ALL
SELECT doc_id, 1, length(text) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)""",
    LINE_PAGES,
)
_add(
    "page_concat_prefix",
    """
SELECT document_id, substring(string_agg(text, ' ' ORDER BY page_number), 1, 5000) AS text_start
FROM pg GROUP BY document_id""",
    LINE_PAGES,
)

# Profile
_add("length_stats", length_stats("pg", "text_length"), LINE_PAGES)
_add("page_stats_by_lang", length_stats("documents", "n_chars", "lang"))
_add(
    "length_stats_by_type",
    length_stats(
        "(SELECT d.document_type, p.text_length FROM docs d LEFT JOIN pg p ON p.document_id = d.id)",
        "text_length",
        "document_type",
    ),
    DOCS,
    LINE_PAGES,
)
_add(
    "pages_by_type",
    """
SELECT d.document_type, count(DISTINCT d.id) AS documents, count(p.id) AS pages
FROM docs d LEFT JOIN pg p ON p.document_id = d.id GROUP BY 1""",
    DOCS,
    LINE_PAGES,
)
_add(
    "page_quality",
    f"""
SELECT count(*) AS pages, count(*) FILTER ({strip("text")} = '') AS empty_pages,
  count(*) FILTER (text_length > 0 AND text_length < 100) AS short_pages,
  count(*) FILTER (text_length > 5000) AS long_pages FROM pg""",
    LINE_PAGES,
)
_add(
    "quality_examples",
    """
SELECT kind, position, d.relative_path || ' p.' || page_number || ': ' || text_length || ' chars' AS line,
  greatest(n - 10, 0) AS more
FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY document_id, page_number) AS position,
    count(*) OVER (PARTITION BY kind) AS n
  FROM (SELECT *, CASE WHEN text_length > 0 AND text_length < 100 THEN 'very_short_page'
      WHEN text_length > 5000 THEN 'very_long_page' END AS kind FROM pg) WHERE kind IS NOT NULL) p
JOIN docs d ON d.id = p.document_id WHERE position <= 10""",
    DOCS,
    LINE_PAGES,
)
_add(
    "documents_without_text",
    f"""
SELECT id, relative_path FROM docs WHERE NOT has_text OR id NOT IN (SELECT doc_id FROM labels)""",
    DOCS,
)
_add("ocr_candidates", "SELECT document_id, scan_status FROM rolled WHERE ocr_required", DOCS, LINE_PAGES, _ROLLUP)
_POINT_TABLES = markers(PROFILE_MARKERS)
_DEFAULT_TABLES = markers(MARKERS)
_add(
    "document_markers",
    """
SELECT document_id, n_pages, avg_length, section::BIGINT AS section, chapter::BIGINT AS chapter,
  appendix::BIGINT AS appendix, point_1::BIGINT AS point_1, point_1_1::BIGINT AS point_1_1,
  point_1_1_1::BIGINT AS point_1_1_1, "table"::BIGINT AS "table" FROM doc_markers""",
    *_POINT_TABLES,
)
_add(
    "marker_counts",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS marker, sum(\"{name}\")::BIGINT AS occurrences, count(*) FILTER (\"{name}\" > 0) AS documents "
        "FROM doc_markers"
        for name in MARKERS
    ),
    *_DEFAULT_TABLES,
)
_add("recommendation", "SELECT id, recommendation FROM recommended", *_POINT_TABLES, RECOMMENDED)
_add(
    "recommendation_counts",
    "SELECT recommendation AS value, count(*) AS n FROM recommended GROUP BY 1",
    *_POINT_TABLES,
    RECOMMENDED,
)
_add(
    "recommendation_examples",
    """
SELECT recommendation, position, id, relative_path, greatest(n - 3, 0) AS more FROM (
  SELECT *, row_number() OVER (PARTITION BY recommendation ORDER BY id) AS position,
    count(*) OVER (PARTITION BY recommendation) AS n FROM recommended) WHERE position <= 3""",
    *_POINT_TABLES,
    RECOMMENDED,
)

# Metadata
_add("metadata_rules", "SELECT * FROM metadata", *metadata(rules.RulePack()))
_add("metadata_sample_rules", "SELECT * FROM metadata", *metadata(SAMPLE_PACK))
_RULED = (
    f"({_values(fixtures.RULED_STARTS)})[d.id % {len(fixtures.RULED_STARTS)} + 1] || ' ' || d.id % 33 || '.' || d.id % 14 || "
    f"'.' || ({_values(fixtures.YEARS)})[d.id % {len(fixtures.YEARS)} + 1] || ' 20' || lpad((d.id % 100)::VARCHAR, 2, '0') || "
    "'-' || d.id % 13 || '_' || d.id % 29 || ' ' || coalesce(t.text_start, '')"
)
_add(
    "metadata_default_rules",
    "SELECT * FROM metadata",
    *metadata(rules.RulePack(), _RULED, bordered(rules.RulePack())),
)
_add(
    "metadata_update",
    """
SELECT d.id, d.path, m.document_type, m.content_category, m.document_number, m.document_date, m.organization,
  m.metadata_status, m.metadata_notes FROM docs d JOIN metadata m ON m.id = d.id""",
    *metadata(SAMPLE_PACK),
)
_add(
    "metadata_status_counts",
    "SELECT metadata_status AS value, count(*) AS n FROM metadata GROUP BY 1",
    *metadata(SAMPLE_PACK),
)
_add(
    "text_functions",
    rf"""
SELECT doc_id, {normalize("text")} AS normalized, {SHORT} AS compacted,
  {collapse("lower(source || '/' || doc_id || '.TXT')")}[length(source) + 2 :] AS document_name,
  array_to_string(list_filter(found, lambda x, i: length(x) >= 2 AND list_position(found, x) = i), ' ') AS query_tokens,
  {_sized("n_chars * 977")} AS size_text, translate(source || ':' || lang || '/x', '/:', '__') AS safe_name,
  {strip("text")} AS without_reasoning
FROM (SELECT *, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS found FROM documents)""",
)

# Chunks
_add(
    "chunks_long",
    f"""
SELECT page_id, s AS start_char, e AS end_char, {strip("substring(text, s + 1, e - s)")} AS chunk_text FROM win
WHERE {strip("substring(text, s + 1, e - s)")} <> ''""",
    WHOLE_PAGES,
    LONG_PAGES,
    WINDOWS,
)
_CHUNK_COLUMNS = (
    "chunk_id, document_id, page_id, page_number, chunk_index, chunk_text, chunk_length, chunk_strategy, source_type, "
    "start_char, end_char"
)
_add("chunks_all", f"SELECT {_CHUNK_COLUMNS} FROM chunks", *CHUNKS)
_POINT_CHUNKS = _chunk_ctes(POINT_PAGES, points=True)
_add("chunks_points", f"SELECT {_CHUNK_COLUMNS} FROM chunks", *_POINT_CHUNKS)
_LINE_CHUNKS = (
    DOCS,
    LINE_PAGES,
    """
point_counts AS (SELECT document_id, 0 AS points FROM pg GROUP BY document_id)""",
    ROUTED,
    "sec AS" + NO_SECTIONS.split("sec AS", 1)[1],
    PIECES,
)
_add("chunks_pages", f"SELECT {_CHUNK_COLUMNS} FROM chunks", *_LINE_CHUNKS)
_add("chunks_tables", f"SELECT {_CHUNK_COLUMNS} FROM chunks", *_chunk_ctes(TABLE_PAGES, points=False))
_add("chunk_length_stats", length_stats("chunks", "chunk_length"), *CHUNKS)
_add(
    "chunks_by_strategy",
    "SELECT chunk_strategy AS value, count(*) AS n FROM chunks GROUP BY 1",
    *_POINT_CHUNKS,
)
_add(
    "chunk_eligibility",
    """
SELECT d.id, CASE WHEN l.toxic = 1 THEN 'ocr_required' WHEN coalesce(l.quality = 1, false) = false THEN 'no_text'
  WHEN d.id NOT IN (SELECT vec_id FROM embeddings) THEN 'no_text' END AS skip_reason
FROM docs d LEFT JOIN labels l ON l.doc_id = d.id""",
    DOCS,
)
_add(
    "chunking_counters",
    """
SELECT count(*) FILTER (n_kept > 0) AS documents_processed,
  0 AS ocr_required, (SELECT count(*) FROM docs WHERE NOT has_text) AS no_text,
  count(*) FILTER (n_kept = 0) AS too_short_documents, sum(n_all - n_kept)::BIGINT AS short_chunks
FROM (SELECT t.document_id,
    (SELECT count(*) FROM pieces p WHERE p.document_id = t.document_id AND chunk_text <> '') AS n_all,
    (SELECT count(*) FROM chunks c WHERE c.document_id = t.document_id) AS n_kept FROM totals t)""",
    *_LINE_CHUNKS,
)

# Full-text search
_add(
    "index_rows",
    "SELECT chunk_id, document_type, content_category, chunk_strategy, len(tokens) AS n_tokens, doc_len FROM idx",
    *CHUNKS,
    INDEX,
)
_add(
    "postings",
    """
SELECT term, chunk_id, count(*) AS tf, string_agg(pos - 1, ' ' ORDER BY pos) AS positions
FROM occ GROUP BY term, chunk_id""",
    *CHUNKS,
    INDEX,
)
_add("term_stats", "SELECT term, count(DISTINCT chunk_id) AS df FROM occ GROUP BY term", *CHUNKS, INDEX)
_add(
    "corpus_stats",
    "SELECT n AS n_chunks, total::BIGINT AS total_len, round(avg_len, 6) AS avg_len FROM corpus",
    *CHUNKS,
    INDEX,
)
_add(
    "query_units",
    "SELECT query_id, position, token, array_to_string(words, ' ') AS words FROM units",
    PHRASE_QUERIES,
    UNITS,
)
_add("bm25_topk", f"SELECT {BM25_COLUMNS} FROM lex", *RETRIEVAL, lexical("lex", 10))
_add(
    "bm25_filtered",
    f"SELECT {BM25_COLUMNS} FROM lex",
    *RETRIEVAL,
    lexical("lex", 10, where="document_type = 'procedure' AND content_category = 'training' AND chunk_strategy = 'split_long_page'"),
)
_add("bm25_boosted", f"SELECT {BM25_COLUMNS} FROM lex", *RETRIEVAL, lexical("lex", 10, boosted=True))
_add(
    "bm25_phrases",
    f"SELECT {BM25_COLUMNS} FROM lex",
    *CHUNKS,
    INDEX,
    PHRASE_QUERIES,
    UNITS,
    SCORED,
    lexical("lex", 10),
)
_add(
    "bm25_provenance",
    f"""
SELECT l.query_id, l.rank, d.name AS filename, d.path, d.relative_path, d.scan_root, c.page_number, c.chunk_index,
  c.start_char, c.end_char, d.document_type, d.content_category, c.chunk_strategy, {compact("c.chunk_text", 700)} AS shown
FROM lex l JOIN chunks c USING (chunk_id) JOIN docs d ON d.id = c.document_id""",
    *RETRIEVAL,
    lexical("lex", 10),
)

# Vectors
_add(
    "semantic_topk",
    "SELECT query_id, rank, round(similarity, 5) AS similarity, chunk_id, document_id, chunk_index FROM sem",
    *CHUNKS,
    EMBEDDED,
    semantic("sem", 10),
)
_add(
    "semantic_provenance",
    """
SELECT s.query_id, s.rank, round(s.similarity, 5) AS similarity, d.name AS filename, d.relative_path, c.page_number,
  c.chunk_index, c.start_char, c.end_char, c.chunk_strategy
FROM sem s JOIN chunks c USING (chunk_id) JOIN docs d ON d.id = c.document_id""",
    *CHUNKS,
    EMBEDDED,
    semantic("sem", 10),
)
_add(
    "cosine_expression",
    """
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 5) AS similarity
FROM embeddings e JOIN embeddings o ON o.vec_id = e.label""",
)
_add(
    "missing_embeddings",
    "SELECT chunk_id, document_id, chunk_index FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM emb)",
    *CHUNKS,
    EMBEDDED,
)
_add(
    "missing_embeddings_first",
    """
SELECT chunk_id, document_id, chunk_index FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM emb)
ORDER BY document_id, chunk_index LIMIT 25""",
    *CHUNKS,
    EMBEDDED,
)
_add(
    "embedding_coverage",
    """
SELECT 'm0' AS model, count(*) AS existing, max(len(embedding)) AS dimension,
  (SELECT count(*) FROM chunks) - count(*) AS missing FROM emb""",
    *CHUNKS,
    EMBEDDED,
)
_LETTERS = "aeinrst"
_VECTOR = ", ".join(
    f"(length(chunk_text) - length(replace(chunk_text, '{letter}', '')))::FLOAT::DOUBLE" for letter in _LETTERS
)
_add(
    "embedding_backfill",
    f"""
SELECT chunk_id, 'm0' AS model, 7 AS dimension, array_to_string(list_transform([{_VECTOR}], lambda x: x::BIGINT), ' ') AS vector
FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM emb)""",
    *CHUNKS,
    EMBEDDED,
)
_add(
    "embedding_upsert",
    """
SELECT chunk_id, 'm0' AS model, 64 AS dimension FROM emb
UNION ALL SELECT chunk_id, 'm0', 7 FROM chunks WHERE chunk_id NOT IN (SELECT chunk_id FROM emb)""",
    *CHUNKS,
    EMBEDDED,
)

# Fusion, evaluation, context
_HYBRID = (*RETRIEVAL, EMBEDDED, lexical("lex", 70), semantic("sem", 70), fused("hyb", "lex", "sem", 20))
_add(
    "hybrid_topk",
    """
SELECT query_id, rank, round(score, 8) AS score, chunk_id, fts_rank, embedding_rank, round(fts_score, 6) AS fts_score,
  round(embedding_similarity, 5) AS embedding_similarity FROM hyb""",
    *_HYBRID,
)
_add(
    "test_query_set",
    """
SELECT q.query_id, q.query, string_agg(r.name, ' ' ORDER BY r.name) AS known
FROM qset q JOIN qrels r ON r.query_id = q.query_id GROUP BY ALL""",
    QRELS,
)
_HITS = " || ' ' || ".join(
    f"'Hit@{cutoff}=' || coalesce(hybrid_rank <= {cutoff}, false)::INT" for cutoff in (1, 3, 5, 10)
)
_add(
    "eval_per_query",
    f"SELECT query_id, fts_rank, embeddings_rank, hybrid_rank, winner, {_HITS} AS hits FROM evaluated",
    *EVALUATED,
)
_add(
    "retrieval_eval",
    "\nUNION ALL\n".join(
        f"SELECT '{method}' AS method, count(*) AS queries, "
        + ", ".join(
            f"round(avg(coalesce({method}_rank <= {cutoff}, false)::INT), 6) AS hit_at_{cutoff}" for cutoff in (1, 3, 5, 10)
        )
        + " FROM evaluated"
        for method in ("fts", "embeddings", "hybrid")
    ),
    *EVALUATED,
)
_add(
    "eval_winner",
    "\nUNION ALL\n".join(
        f"SELECT '{name}' AS winner, count(*) FILTER (winner = '{name}') AS queries FROM evaluated"
        for name in ("fts", "embeddings", "hybrid", "tie")
    ),
    *EVALUATED,
)
_add("context_sources", "SELECT * FROM sources", *SOURCES)
_add("context_blocks", assembled(False), *SOURCES)
_add("benchmark_context", assembled(True), *SOURCES)
_CITING = (
    *SOURCES,
    """
citing AS (
  SELECT query_id, query || ' [1] ' || chr(10) || '[' || (length(query) % 9) || '][1]' AS answer FROM qs)""",
)
_CITED = """
cited AS (
  SELECT DISTINCT query_id, unnest(regexp_extract_all(answer, '\\[(\\d+)\\]', 1))::BIGINT AS citation_id FROM citing)"""
_add(
    "used_sources",
    """
SELECT s.query_id, s.citation_id, s.document_id, s.display_path FROM sources s JOIN cited USING (query_id, citation_id)""",
    *_CITING,
    _CITED,
)
_add(
    "citation_counts",
    """
SELECT q.query_id, (SELECT count(*) FROM sources s WHERE s.query_id = q.query_id) AS retrieved_source_count,
  (SELECT count(*) FROM sources s JOIN cited c USING (query_id, citation_id) WHERE s.query_id = q.query_id)
    AS used_source_count FROM qs q""",
    *_CITING,
    _CITED,
)
_add(
    "cited_answer_parts",
    """
SELECT p.query_id, p.position, p.part, p.citation_id, s.view_href IS NOT NULL AS resolved, s.view_href,
  s.display_path AS title
FROM (
  SELECT query_id, 1 AS position, query || ' ' AS part, NULL::BIGINT AS citation_id FROM qs
  UNION ALL SELECT query_id, 2, '[1]', 1 FROM qs
  UNION ALL SELECT query_id, 3, ' ' || chr(10), NULL FROM qs
  UNION ALL SELECT query_id, 4, '[' || (length(query) % 9) || ']', length(query) % 9 FROM qs
  UNION ALL SELECT query_id, 5, '[1]', 1 FROM qs) p
LEFT JOIN sources s ON s.query_id = p.query_id AND s.citation_id = p.citation_id""",
    *SOURCES,
)
_add(
    "final_answers",
    f"""
SELECT a.query_id, CASE WHEN count(s.citation_id) = 0 OR a.answer = '' THEN {quoted(context.INSUFFICIENT)} ELSE a.answer END
  AS answer, count(s.citation_id) AS source_count
FROM (SELECT item_id AS query_id, CASE WHEN length(text) % 2 = 0 THEN '' ELSE {strip("text")} END AS answer
  FROM benchmark) a
LEFT JOIN (SELECT * FROM sources WHERE source_type <> 'pdf') s ON s.query_id = a.query_id GROUP BY a.query_id, a.answer""",
    *SOURCES,
)
_add(
    "query_types",
    f"""
SELECT conv_id, turn, CASE WHEN {contains_any("question", context.LOOKUP_MARKERS)}
  THEN 'document_lookup' ELSE 'conceptual' END AS query_type
FROM (SELECT *, CASE WHEN role = 'user' THEN text ELSE text || ' ЩО РЕГЛАМЕНТУЄ' END AS question FROM conversations)""",
)

# Answers
_FLAG_COLUMNS = "query_id, model, answer_chars, source_count, " + ", ".join(answers.FLAGS)
_add("answer_flags", f"SELECT {_FLAG_COLUMNS} FROM flagged", ANSWERS, FLAGGED)
_add("answer_flags_sample", f"SELECT {_FLAG_COLUMNS} FROM flagged", ANSWERS, FLAGGED_SAMPLE)
_COUNTS = ", ".join(f"count(*) FILTER ({name}) AS {name}" for name in answers.FLAGS)
_add(
    "model_summary",
    f"""
SELECT *, CASE WHEN contains_thinking > 0 THEN 'reject: thinking leaks'
  WHEN wrong_language_suspected > 0 THEN 'review: language issues'
  WHEN has_citations = answers THEN 'candidate' ELSE 'review' END AS notes
FROM (SELECT model, count(*) AS answers, round(avg(total_time_seconds), 6) AS avg_total_time,
  round(avg(llm_time_seconds), 6) AS avg_llm_time, {_COUNTS} FROM flagged GROUP BY model)""",
    ANSWERS,
    FLAGGED_SAMPLE,
)
_add(
    "model_compare",
    f"""
SELECT query_id, model, total_time_seconds, llm_time_seconds, answer_chars, source_count, {FLAG_LIST} AS flags
FROM flagged WHERE model <> 'm2'""",
    ANSWERS,
    FLAGGED_SAMPLE,
)
_add(
    "model_compare_wide",
    f"""
SELECT query_id, max(CASE WHEN model = 'm0' THEN {FLAG_LIST} END) AS m0, max(CASE WHEN model = 'm1' THEN {FLAG_LIST} END) AS m1,
  max(CASE WHEN model = 'm2' THEN {FLAG_LIST} END) AS m2 FROM flagged GROUP BY query_id""",
    ANSWERS,
    FLAGGED_SAMPLE,
)
_add(
    "no_answer",
    f"""
SELECT query_id, {contains_any("answer", answers.NO_ANSWER_MARKERS)} AS no_answer FROM (
  SELECT query_id, CASE WHEN length(answer) % 2 = 0 THEN answer || ' НЕМАЄ ІНФОРМАЦІЇ' ELSE answer END AS answer FROM ans)""",
    ANSWERS,
)
