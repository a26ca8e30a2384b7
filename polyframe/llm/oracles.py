"""SQL with the results of those queries that SQL can express over whole tables."""

from __future__ import annotations

from . import chat, licenses
from .templates import TEMPLATES


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


HNSW = """
WITH RECURSIVE sound AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM sound a JOIN sound b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reached AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT r.u, l.v FROM reached r JOIN links l ON r.v = l.u),
found AS (SELECT u, min(v) AS component_id FROM reached GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, f.component_id, e.vec_id = f.component_id AS kept
FROM embeddings e JOIN found f ON e.vec_id = f.u LEFT JOIN counted c ON e.vec_id = c.u
"""


def license_scan() -> str:
    """Every window of every text against every template of its class, without bands or anchors."""
    rows = [(own.longest, own.stride, own.window, name, shingles) for own in licenses.classes(TEMPLATES) for name, shingles in own.templates]
    known = ", ".join(f"({longest}, {stride}, {window}, {_text(name)}, [{', '.join(map(_text, shingles))}])" for longest, stride, window, name, shingles in rows)
    return f"""
WITH known(longest, stride, width, license, shingles) AS (VALUES {known}),
kinds AS (SELECT DISTINCT longest, stride, width FROM known),
texts AS (SELECT doc_id, regexp_extract_all(translate(text, '{licenses.UPPER}', '{licenses.LOWER}'), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL),
starts AS (SELECT doc_id, words, longest, width, unnest(range(1, greatest(len(words), 1) + 1, stride)) AS s FROM texts, kinds),
windows AS (SELECT doc_id, longest, s, list_slice(words, s, s + width - 1) AS w FROM starts),
cut AS (SELECT doc_id, longest, s, list_distinct(list_transform(range(1, len(w) - {licenses.SHINGLE - 2}), lambda k: array_to_string(list_slice(w, k, k + {licenses.SHINGLE - 1}), ' '))) AS held FROM windows WHERE len(w) >= {licenses.SHINGLE}),
met AS (SELECT doc_id, license, s, len(list_intersect(held, shingles)) / len(shingles) AS containment FROM cut JOIN known USING (longest))
SELECT doc_id, license, max(containment) AS containment, count(*) AS n_windows FROM met WHERE containment >= {licenses.SHARE} GROUP BY doc_id, license
"""


def chat_formatting(template: chat.Template = chat.INSTRUCT) -> str:
    """Lengths by counting control strings, validity by the role before."""
    general = sum(map(len, template.general))
    marks = " ".join(f"WHEN {_text(role)} THEN {len(t.open) + len(t.close)}" for role, t in template.turns.items())
    grown = lambda c: f"length({c}) + " + " + ".join(f"(length({c}) - length(replace({c}, {_text(m)}, ''))) // {len(m)}" for m in [chr(92), *template.control])
    loss = f"role IN ({', '.join(_text(r) for r, t in template.turns.items() if t.loss)})"
    allowed = " OR ".join(f"(before = {_text(state)} AND role IN ({', '.join(map(_text, roles))}))" for state, roles in template.order.items())
    known = ", ".join(map(_text, template.turns))
    quoted = "'''' || {} || ''''".format
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
ordered AS (SELECT *, row_number() OVER w AS n, coalesce(lag(role) OVER w, 'start') AS before FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
judged AS (SELECT *, NOT coalesce({allowed}, false) AS wrong FROM ordered),
sums AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER ({loss}), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER ({loss}), '')) AS loss_sha256,
    CAST(sum({grown('text')} + CASE role {marks} ELSE {general} + {grown('role')} END) AS BIGINT) AS formatted_chars,
    min_by(CASE WHEN role IN ({known}) THEN 'turn ' || (n - 1) || ': ' || {quoted('role')} || ' after ' || {quoted('before')} ELSE 'turn ' || (n - 1) || ': unknown role ' || {quoted('role')} END, n) FILTER (wrong) AS broken,
    max_by(role, n) AS final
  FROM judged GROUP BY conv_id),
faults AS (SELECT *, coalesce(broken, CASE WHEN final NOT IN ({', '.join(map(_text, template.ends))}) THEN 'ends after ' || {quoted('final')} END) AS fault FROM sums)
SELECT conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, fault IS NULL AS valid, fault FROM faults
"""


ORACLE_SQL: dict[str, str] = {"op1_hnsw_near_dedup": HNSW, "op3_license_scans": license_scan(), "op8_chat_formatting": chat_formatting()}
