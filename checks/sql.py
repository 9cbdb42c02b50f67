"""Plain SQL for the registered queries, written against the raw tables.

Each query is a final SELECT over shared building blocks. The blocks restate the rules
from scratch (self-joins, windows, string functions); they share no code with the engine.
"""

from __future__ import annotations

import re

from citemill import fixed
from citemill.synthetic import PROTOCOL as P

WS = r"[\t\n\x0b\f\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
BREAK = rf"([.!?]){WS}+([A-ZÁÉÍÓÚÜÑ0-9])"
LINES = r"\r\n|[\n\r\x0b\f\x1c-\x1e\x{85}\x{2028}\x{2029}]"


def q(text) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def squash(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{WS}+', ' ', 'g'))"


def fires(family: str, text: str, cues=P.cues) -> str:
    """Any pattern of a family; word edges spelled out for all letters."""
    words = [p[2:-2] for p in cues.get(family, [])]
    if not words:
        return "false"
    return f"regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])({'|'.join(words)})([^\\p{{L}}\\p{{N}}_]|$)')"


def case(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {v if isinstance(v, (int, float)) else q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def yes(flag: str) -> str:
    return f"CASE WHEN {flag} THEN 'Si' ELSE 'No' END"


def first_line(limit: int, low: int, high: int, bad: tuple[str, ...]) -> str:
    fragments = "|".join(re.escape(b).replace("\\ ", " ") for b in bad)
    return (
        f"coalesce(list_filter(list_transform(string_split_regex(text, '{LINES}')[1:{limit}], lambda l: {squash('l')}), "
        f"lambda c: length(c) BETWEEN {low} AND {high} AND NOT regexp_matches(lower(c), '{fragments}'))[1], '')"
    )


def contains_any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def article_kind(title: str, study: str, text: str) -> str:
    meta = f"({title} || ' ' || {study})"
    opening = f"({meta} || ' ' || substr({text}, 1, 1800))"
    return (
        f"CASE WHEN {fires('review', opening)} THEN 'review_or_synthesis' "
        f"WHEN {fires('in_vitro', opening)} THEN 'experimental_in_vitro' "
        f"WHEN {fires('in_vivo', opening)} THEN 'experimental_in_vivo' "
        f"WHEN {contains_any(f'lower({meta})', fixed.PRECLINICAL_WORDS)} THEN 'experimental_preclinical' "
        f"WHEN {fires('human', meta).replace('persons?', 'person|persons')} OR {contains_any(f'lower({meta})', fixed.EPIDEMIOLOGY_WORDS)} THEN 'human_epidemiological' "
        "ELSE 'unclear' END"
    )


YEAR = r"\b(19[5-9]\d|20[0-3]\d)\b"
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"

LEXICON = ", ".join(
    f"({q(t.slot)}, {q(t.entity_id)}, {q(t.label_es)}, {q(t.label_en)}, {q(t.category)}, {str(t.generic).lower()}, {i}, {q('(?i)' + p)})"
    for i, t in enumerate(P.terms) for p in t.patterns
)
HEADERS = ", ".join(
    f"({q(s)}, {q(w)})" for s, ps in P.headers.items() for p in ps for w in re.sub(r"^.*?\((\w[^)]*)\).*$", r"\1", p).split("|")
)
CONTEXT_HEADERS = ", ".join(
    f"({q(s)}, {q(w)}, {i + 1})"
    for i, (s, ws) in enumerate([
        ("introduction", "of der"), ("methods", "and de"), ("results", "in"), ("discussion", "to"), ("conclusion", "was"),
        ("references", "that licensed"),
    ]) for w in ws.split()
)
CENTRAL = "('title','abstract','methods','results')"
PERIPHERAL = "('introduction','discussion','conclusion')"
CUES = ("exposure", "dose", "association", "speculative", "negation")
CONTEXT_CUES = {
    "exposure": [r"\bfor\b", r"\bfrom\b"], "dose": [r"\bon\b"], "background": [r"\bthis\b"], "review": [r"\blicensed\b"],
    "epidemiology": [r"\band\b"], "preclinical_metadata": [r"\bund\b"], "preclinical_text": [r"\bles\b"],
}
RELATION_WEIGHT = f"({case('association', fixed.ASSOCIATION_WEIGHTS, '0.0')}) * ({case('confidence', fixed.CONFIDENCE_WEIGHTS, '1.0')})"

# non-ASCII letters and digits replaced one for one, so that \b sees them as word characters
FOLD = r"regexp_replace(regexp_replace({x}, '[^\x00-\x7F\P{L}]', 'x', 'g'), '[^\x00-\x7F\P{N}]', '0', 'g')"


def fold(x: str) -> str:
    return FOLD.replace("{x}", x)


def find_hits(source: str, where: str, extra: str = "") -> str:
    return f"""
 SELECT article_id, slot, entity_id, label_es, label_en, category, generic, term_no, s AS start_at, s + length(m) AS end_at{extra}
 FROM (SELECT *, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gaps[1:i], lambda g: length(g)))
        + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0))) AS s, unnest(ms) AS m
   FROM (SELECT a.*, l.*, string_split_regex(folded, pattern) AS gaps, regexp_extract_all(folded, pattern) AS ms
         FROM (SELECT *, {fold('text')} AS folded FROM {source} WHERE {where}) a, lex l))"""


def cut(text: str, start: str, end: str) -> str:
    return f"substr({text}, greatest({start}, 0)::INT + 1, (least({end}, length({text})) - greatest({start}, 0))::INT)"


_frag = cut("text", "start_at - 900", "end_at + 900")
_at = "(start_at - greatest(start_at - 900, 0))"
SENTENCE = squash(
    f"(SELECT substr(h, 1, length(h) - 1) || t FROM (SELECT list_last(string_split(regexp_replace(substr(frag, 1, at_pos + 1), '{BREAK}', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS h, "
    f"string_split(regexp_replace(substr(frag, at_pos + 1), '{BREAK}', '\\1' || chr(1) || '\\2', 'g'), chr(1))[1] AS t))"
)

BLOCKS: dict[str, tuple[tuple[str, ...], str]] = {
    "lex": ((), f"SELECT * FROM (VALUES {LEXICON}) t(slot, entity_id, label_es, label_en, category, generic, term_no, pattern)"),
    "heads": ((), f"SELECT * FROM (VALUES {HEADERS}) t(name, word)"),
    "raw": ((), "SELECT CAST(doc_id AS VARCHAR) AS article_id, source AS source_path, text, 1 AS pages FROM documents"),
    "art": (("raw",), f"""
 SELECT *, {article_kind('title', "''", 'text')} AS article_kind FROM (
  SELECT *, {first_line(90, 12, 260, fixed.TITLE_BOILERPLATE)} AS title, regexp_extract(substr(text, 1, 4000), '{YEAR}', 1) AS year,
   rtrim(regexp_extract(substr(text, 1, 10000), '{DOI}', 0), '.') AS doi, '' AS metadata_study_type,
   len(regexp_extract_all(text, '{WORD}+')) AS word_count FROM raw)"""),
    "lines": (("raw",), f"""
 SELECT *, regexp_extract(bare, '^{WORD}+') AS word, substr(bare, length(regexp_extract(bare, '^{WORD}+')) + 1, 1) AS after,
  coalesce(max(CASE WHEN bare <> '' THEN line_start + length(line) + 1 END) OVER (PARTITION BY article_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS open_at
 FROM (SELECT article_id, n, line, regexp_replace(regexp_replace(line, '^{WS}+', ''), '{WS}+$', '') AS bare,
   coalesce(sum(length(line) + 1) OVER (PARTITION BY article_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_start
  FROM (SELECT article_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM raw))"""),
    "marks": (("lines", "heads"), """
 SELECT DISTINCT article_id, line_start AS start_at, 1 AS rank, name FROM lines JOIN heads h ON lower(lines.word) = h.word
 WHERE (regexp_matches(lines.word, '^\\p{Lu}') OR length(lines.word) = length(bare)) AND (length(bare) <= 60 OR after IN ('.', ':', '—', '–', '-'))
 UNION ALL SELECT article_id, 0, 0, 'title' FROM raw"""),
    "spans": (("marks", "raw"), """
 SELECT article_id, name, start_at, coalesce(lead(start_at) OVER (PARTITION BY article_id ORDER BY start_at, rank, name), length(text)) AS end_at
 FROM (SELECT *, max(CASE WHEN name = 'references' THEN start_at END) OVER (PARTITION BY article_id) AS terminal FROM marks) JOIN raw USING (article_id)
 WHERE terminal IS NULL OR (name = 'references' AND start_at = terminal)
   OR (name <> 'references' AND (start_at < terminal OR (start_at = terminal AND (rank = 0 OR name < 'references'))))"""),
    "hits": (("art", "lex"), find_hits("art", "word_count >= 50", ", article_kind, source_path, text")),
    "numbered": (("hits", "spans"), f"""
 SELECT h.*, {cut('h.text', 'h.start_at', 'h.end_at')} AS matched_text, coalesce(s.name, 'other') AS section,
  row_number() OVER (PARTITION BY h.article_id ORDER BY h.start_at, slot, entity_id, term_no) - 1 AS mention_idx,
  row_number() OVER (PARTITION BY h.article_id, slot, entity_id ORDER BY h.start_at) - 1 AS nth
 FROM hits h LEFT JOIN spans s ON h.article_id = s.article_id AND h.start_at >= s.start_at AND h.start_at < s.end_at"""),
    "mentions": (("numbered",), f"""
 SELECT *, ({case('section', P.weights, '1')}) + CASE WHEN generic THEN -1 ELSE 0 END + CASE WHEN c_exposure THEN 4 ELSE 0 END + CASE WHEN c_dose THEN 5 ELSE 0 END
  + CASE WHEN c_association THEN 2 ELSE 0 END - CASE WHEN c_speculative THEN 1 ELSE 0 END - CASE WHEN c_negation THEN 2 ELSE 0 END AS score
 FROM (SELECT *, {', '.join(f"{fires(c, 'context')} AS c_{c}" for c in CUES)}, {SENTENCE} AS sentence, {squash('matched_text')} AS form
  FROM (SELECT *, {squash(cut('text', 'start_at - 260', 'end_at + 260'))} AS context, {_frag} AS frag, {_at}::INT AS at_pos, 1 AS page FROM numbered))"""),
    "evidence": (("mentions",), f"""
 SELECT article_id, slot, entity_id, string_agg('p.' || page || ' [' || section || '] ' || context, ' || ' ORDER BY n) AS evidence_text FROM (
  SELECT *, row_number() OVER (PARTITION BY article_id, slot, entity_id ORDER BY
   CASE WHEN section IN {CENTRAL} THEN 0 WHEN section = 'references' THEN 2 ELSE 1 END, c_dose DESC, c_exposure DESC, score DESC, mention_idx) AS n FROM mentions)
 WHERE n <= 3 GROUP BY ALL"""),
    "histogram": (("mentions",), """
 SELECT article_id, slot, entity_id, '{' || string_agg('"' || section || '": ' || n, ', ' ORDER BY first_at) || '}' AS sections FROM (
  SELECT article_id, slot, entity_id, section, count(*) AS n, min(mention_idx) AS first_at FROM mentions GROUP BY ALL) GROUP BY ALL"""),
    "grouped": (("mentions",), f"""
 SELECT article_id, slot, entity_id, any_value(label_es) AS label_es, any_value(label_en) AS label_en, any_value(category) AS category,
  any_value(article_kind) AS kind, count(*) AS n, count_if(section = 'references') AS refs, count_if(section IN {CENTRAL}) AS central,
  count_if(section IN {PERIPHERAL}) AS peripheral, coalesce(sum(score) FILTER (section <> 'references'), 0) AS total,
  count_if(section <> 'references' AND (c_exposure OR c_dose)) AS direct, count_if(section <> 'references' AND c_association) AS assoc,
  string_agg(context, ' ' ORDER BY nth) FILTER (nth < 8) AS contexts FROM mentions GROUP BY article_id, slot, entity_id"""),
    "summaries": (("grouped", "evidence", "histogram"), f"""
 SELECT *, CASE WHEN role IN ('role_primary_focus', 'role_probable_focus', 'role_secondary_variable') THEN 'inferencia_contextual_con_evidencia_textual' ELSE 'extraccion_literal' END AS basis,
  {case('role', fixed.ROLE_LABELS, 'role')} AS role_label FROM (
 SELECT g.*, e.evidence_text, h.sections, CASE WHEN kind = 'review_or_synthesis' THEN 'role_review_mention' WHEN refs = n THEN 'role_bibliographic_only'
   WHEN central > 0 AND total >= 16 AND direct > 0 THEN 'role_primary_focus' WHEN central > 0 AND direct + assoc > 0 THEN 'role_probable_focus'
   WHEN central > 0 AND total >= 8 THEN 'role_secondary_variable' WHEN peripheral > 0 THEN 'role_intro_discussion_only' ELSE 'role_unclear' END AS role,
  CASE WHEN kind = 'human_epidemiological' OR {fires('human', 'contexts').replace('persons?', 'person|persons')} THEN 'Analizado en poblacion humana o estudio epidemiologico'
   WHEN kind = 'experimental_in_vitro' OR {fires('in_vitro', 'contexts')} THEN 'Usado en ensayos in vitro'
   WHEN kind = 'experimental_in_vivo' OR {fires('in_vivo', 'contexts')} THEN 'Usado en ensayos in vivo'
   WHEN kind = 'review_or_synthesis' THEN 'Revision o sintesis; no estudio primario' ELSE 'No queda claro' END AS study_context,
  CASE WHEN total >= 18 AND central > 0 AND direct + assoc > 0 THEN 'Alta' WHEN total >= 8 AND central > 0 THEN 'Media' ELSE 'Baja' END AS confidence
 FROM grouped g JOIN evidence e USING (article_id, slot, entity_id) JOIN histogram h USING (article_id, slot, entity_id))"""),
    "pairs": (("mentions",), f"""
 SELECT *, sa + sb + CASE WHEN {fires('association', 'evidence')} THEN 4 ELSE 0 END + CASE WHEN {fires('strong_association', 'evidence')} THEN 4 ELSE 0 END
  - CASE WHEN {fires('speculative', 'evidence')} THEN 2 ELSE 0 END - CASE WHEN {fires('negation', 'evidence')} THEN 4 ELSE 0 END AS score FROM (
 SELECT a.article_id, a.entity_id AS a_id, b.entity_id AS b_id, a.label_es AS a_label, a.category AS a_cat, b.label_es AS b_label, b.category AS b_cat,
  a.mention_idx AS ia, b.mention_idx AS ib, a.score AS sa, b.score AS sb,
  CASE WHEN (a.start_at, a.section) <= (b.start_at, b.section) THEN a.section ELSE b.section END AS section,
  CASE WHEN a.sentence <> '' AND a.sentence = b.sentence AND contains(a.sentence, a.form) AND contains(a.sentence, b.form) THEN a.sentence
   WHEN greatest(a.end_at, b.end_at) - least(a.start_at, b.start_at) > 900 THEN ''
   ELSE {squash(cut('a.text', 'least(a.start_at, b.start_at)', 'greatest(a.end_at, b.end_at)'))} END AS evidence, a.form AS fa, b.form AS fb
 FROM mentions a JOIN mentions b ON a.article_id = b.article_id AND a.slot = 'a' AND b.slot = 'b'
 WHERE abs(a.start_at - b.start_at) <= 900 OR a.sentence = b.sentence) WHERE evidence <> '' AND contains(evidence, fa) AND contains(evidence, fb)"""),
    "relations": (("pairs", "summaries"), f"""
 SELECT *, CASE WHEN association = 'asociacion_fuerte' AND section IN {CENTRAL} AND score >= 12 THEN 'Alta'
  WHEN association IN ('asociacion_fuerte', 'asociacion_debil') AND score >= 6 THEN 'Media' ELSE 'Baja' END AS confidence FROM (
 SELECT p.*, s.study_context, CASE WHEN {fires('negation', 'evidence')} THEN 'sin_evidencia_suficiente'
  WHEN {fires('strong_association', 'evidence')} AND NOT {fires('speculative', 'evidence')} THEN CASE WHEN p.section IN {CENTRAL} THEN 'asociacion_fuerte' ELSE 'asociacion_debil' END
  WHEN {fires('association', 'evidence')} THEN 'asociacion_debil' WHEN {fires('speculative', 'evidence')} THEN 'mencion_especulativa' ELSE 'sin_evidencia_suficiente' END AS association
 FROM (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY article_id, a_id, b_id ORDER BY score DESC, ia, ib) = 1) p
 JOIN summaries s ON s.article_id = p.article_id AND s.slot = 'a' AND s.entity_id = p.a_id)"""),
    "weighted": (("relations",), f"SELECT *, {RELATION_WEIGHT} AS w FROM relations"),
    "counts": (("mentions",), "SELECT article_id, slot, entity_id, any_value(label_es) AS label_es, any_value(label_en) AS label_en, any_value(category) AS category, count(*) AS n FROM mentions GROUP BY article_id, slot, entity_id"),
    "usable": (("art",), "SELECT * FROM art WHERE word_count >= 50"),
    "corpus": (("usable",), "SELECT count(*) AS n_art, sum(word_count) AS words FROM usable"),
    "tfidf": (("counts", "usable", "corpus"), """
 SELECT c.*, df, n_art, n * 10000.0 / word_count AS per_10k, ln(1 + n) * (ln((1.0 + n_art) / (1 + df)) + 1) AS tfidf, slot || '::' || label_es || '::' || entity_id AS col
 FROM (SELECT *, count(*) OVER (PARTITION BY slot, entity_id) AS df FROM counts) c JOIN usable USING (article_id), corpus"""),
    "pair_type": (("weighted",), """
 SELECT a_label AS entity_a_label, b_label AS entity_b_label, association, sum(w)::DOUBLE AS weighted_score, count(*) AS n_relations, round(avg(w), 6)::DOUBLE AS avg_strength,
  array_to_string(list_sort(list(DISTINCT article_id))[1:12], '; ') AS articles FROM weighted WHERE association <> 'sin_evidencia_suficiente' GROUP BY ALL"""),
    "pair_all": (("weighted",), """
 SELECT a_label AS entity_a_label, b_label AS entity_b_label, sum(w)::DOUBLE AS weighted_score, count(*) AS n_relations, round(avg(w), 6)::DOUBLE AS avg_strength,
  array_to_string(list_sort(list(DISTINCT article_id))[1:12], '; ') AS articles FROM weighted WHERE association <> 'sin_evidencia_suficiente' GROUP BY ALL"""),
    "features": (("summaries", "weighted", "art"), f"""
 SELECT article_id, feature, ln(1 + sum(v)) AS value FROM (
  SELECT article_id, unnest([slot || '_category::' || category, slot || '_label::' || label_es, slot || '_confidence::' || confidence]) AS feature,
   unnest([s, s * 0.65, 1.0]) AS v FROM (SELECT *, ({case('role', fixed.ROLE_WEIGHTS, '1.0')})::DOUBLE * ln(1 + n) AS s FROM summaries)
  UNION ALL SELECT article_id, unnest(['relation_association::' || association, 'relation_confidence::' || confidence, 'relation_section::' || section,
    'relation_pair::' || a_label || ' → ' || b_label, 'relation_category_pair::' || a_cat || ' → ' || b_cat]), unnest([w, w, w, w * 0.5, w])::DOUBLE FROM weighted WHERE w > 0
  UNION ALL SELECT article_id, 'article_kind::' || article_kind, 2.0 FROM art) GROUP BY ALL"""),
    "chosen_features": (("features",), "SELECT * FROM features WHERE regexp_matches(feature, '^(a_category|b_category|a_confidence|b_confidence|article_kind|relation_association|relation_confidence|relation_section)::')"),
    "fstats": (("chosen_features", "art"), """
 SELECT feature, sum(value) / n AS mean, sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) AS deviation
 FROM chosen_features, (SELECT count(*) AS n FROM art) GROUP BY feature, n HAVING sqrt(greatest(0, sum(value * value) / n - (sum(value) / n) * (sum(value) / n))) > 1e-6"""),
    "judge": ((), "SELECT CAST(doc_id AS VARCHAR) AS article_id, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS verdict FROM labels"),
    "meta": (("raw",), f"""
 SELECT r.article_id, doc_id, text, substr(coalesce(text, ''), doc_id * 7919 % greatest(length(coalesce(text, '')) - 60, 1) + 1, 60) AS t0,
  substr(coalesce(text, ''), doc_id * 104729 % greatest(length(coalesce(text, '')) - 80, 1) + 1, 80) AS t1, true AS two
 FROM raw r JOIN (SELECT doc_id, CAST(doc_id AS VARCHAR) AS article_id FROM documents) USING (article_id)"""),
    "cpages": ((), r"""
 SELECT CAST(conv_id AS VARCHAR) AS article_id, turn AS page_no,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(12), chr(10)), chr(0), ' '),
   '([\p{L}\p{N}_])-[ \t]*\n[ \t]*([\p{L}\p{N}_])', '\1\2', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS page_text
 FROM conversations"""),
    "ctitle": (("raw",), f"SELECT *, {first_line(80, 12, 220, fixed.CONTEXT_TITLE_BOILERPLATE)} AS title, len(regexp_extract_all(text, '{WORD}+')) AS word_count FROM raw"),
    "cart": (("ctitle",), f"""
 SELECT *, CASE WHEN {fires('review', "(title || ' ')", CONTEXT_CUES)} THEN 'revision_o_sintesis' WHEN {fires('epidemiology', "(title || ' ')", CONTEXT_CUES)} THEN 'epidemiologico_observacional'
  WHEN {fires('preclinical_metadata', "(title || ' ')", CONTEXT_CUES)} OR {fires('preclinical_text', "substr(text, 1, 1200)", CONTEXT_CUES)} THEN 'preclinico_experimental' ELSE 'no_determinado' END AS article_kind FROM ctitle"""),
    "cmarks": (("lines",), f"""
 SELECT article_id, open_at AS start_at, rank, name FROM lines JOIN (VALUES {CONTEXT_HEADERS}) t(name, head, rank) ON lower(word) = head
 UNION ALL SELECT article_id, 0, 0, 'title_abstract' FROM raw"""),
    "chits": (("cart", "lex"), find_hits("cart", "true", ", article_kind, source_path, text, title") + " WHERE slot = 'a'"),
    "cment": (("chits", "cmarks"), f"""
 SELECT *, ({case('section', fixed.CONTEXT_SECTION_WEIGHTS, '1')}) + CASE WHEN generic THEN -1 ELSE 0 END + CASE WHEN c_exposure THEN 4 ELSE 0 END + CASE WHEN c_dose THEN 5 ELSE 0 END - CASE WHEN c_background THEN 1 ELSE 0 END AS score
 FROM (SELECT *, {', '.join(f"{fires(c, 'context', CONTEXT_CUES)} AS c_{c}" for c in ('exposure', 'dose', 'background'))} FROM (
  SELECT h.*, {cut('text', 'start_at', 'end_at')} AS matched_text, {squash(cut('text', 'start_at - 220', 'end_at + 220'))} AS context,
   CASE WHEN start_at < least(3500, greatest(1200, floor(length(text) * 0.04))) THEN 'title_abstract' ELSE
    (SELECT arg_max(m.name, (m.start_at, m.rank)) FROM cmarks m WHERE m.article_id = h.article_id AND m.start_at <= h.start_at) END AS section,
   row_number() OVER (PARTITION BY article_id, entity_id ORDER BY pattern_no, start_at) AS ord
  FROM (SELECT *, CASE WHEN lower({cut('text', 'start_at', 'end_at')}) = 'thble' THEN 1 ELSE 0 END AS pattern_no FROM chits) h))"""),
    "cgroup": (("cment",), f"""
 SELECT *, CASE WHEN article_kind = 'revision_o_sintesis' THEN 'revision_o_sintesis' WHEN n_references = n THEN 'solo_referencias'
  WHEN n_introduction + n_references = n AND n_exposure = 0 AND n_dose = 0 THEN 'mencion_de_contexto'
  WHEN score >= 12 AND n_title_abstract + n_methods + n_results > 0 AND (n_methods > 0 OR n_results > 0 OR n_title_abstract >= 2 OR (n_title_abstract >= 1 AND n_dose >= 1))
   AND (n_exposure > 0 OR n_dose > 0 OR n_methods > 0) THEN 'trabajado_como_exposicion_o_ensayo'
  WHEN score >= 6 AND n_title_abstract + n_methods + n_results + n_discussion + n_conclusion > 0 THEN 'posible_secundario' ELSE 'mencion_de_contexto' END AS clasificacion FROM (
 SELECT article_id, label_es AS contaminante, any_value(source_path) AS pdf_path, any_value(title) AS title, any_value(article_kind) AS article_kind, any_value(category) AS familia,
  sum(score) AS score, count(*) AS n, {', '.join(f"count_if(section = '{s}') AS n_{s}" for s in fixed.CONTEXT_SECTION_WEIGHTS)},
  count_if(c_exposure) AS n_exposure, count_if(c_dose) AS n_dose, count_if(c_background) AS n_background,
  array_to_string(list('p.' || (start_at::BIGINT // 1000 + 1) || ' [' || section || '] ' || context ORDER BY CASE WHEN section IN ('title_abstract', 'methods', 'results') THEN 0 ELSE 1 END,
   c_exposure DESC, c_dose DESC, start_at::BIGINT // 1000, ord)[1:3], ' || ') AS ejemplos
 FROM cment GROUP BY article_id, label_es)"""),
    "ccat": (("cgroup",), "SELECT familia, " + ", ".join(
        f"count(DISTINCT article_id) FILTER (clasificacion = '{c}') AS articulos_{c}, coalesce(sum(n) FILTER (clasificacion = '{c}'), 0)::BIGINT AS menciones_{c}" for c in fixed.CONTEXT_CLASSES
    ) + ", count(DISTINCT article_id) AS articulos_total, sum(n)::BIGINT AS menciones_total FROM cgroup GROUP BY familia"),
    "answers": ((), """
 SELECT CAST(event_id AS VARCHAR) AS response_id, event_id % 5 AS pick,
  CASE event_id % 5 WHEN 0 THEN event_type || ' (valor actual: 3)' WHEN 1 THEN 'Valor propuesto — ' || event_type WHEN 2 THEN 'Rejilla ' || event_type WHEN 3 THEN 'Comentario ' || event_type ELSE 'Perfil' END AS question,
  event_type, user_id, value, event_id, 'k' || (user_id % 10) AS row_label,
  CASE (event_id // 5) % 6 WHEN 0 THEN 'Bien clasificado' WHEN 1 THEN 'Debería ir en otro grupo' WHEN 2 THEN 'No debería estar / sobra' WHEN 3 THEN 'No sé' ELSE '(sin responder)' END AS cell
 FROM events"""),
    "proposed": (("answers",), "SELECT response_id, event_type AS parameter, value FROM answers WHERE pick = 1 AND event_id % 7 <> 0"),
    "nodes": ((), r"""
 SELECT *, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE 'part' || p_partkey END AS entity, CASE WHEN p_partkey % 19 = 0 THEN '' ELSE p_name END AS es,
  CASE WHEN p_partkey % 5 = 0 THEN upper(p_name[1:1]) || substr(split_part(p_name, ' ', 1), 2) || coalesce(' ' || upper(split_part(p_name, ' ', 2)[1:1]) || substr(split_part(p_name, ' ', 2), 2), '') ELSE '' END AS en,
  CASE WHEN p_partkey % 11 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN '\\b' || replace(p_name, ' ', '\s+') WHEN p_partkey % 17 = 0 THEN '\bnot ' || replace(p_name, ' ', '\s+')
   ELSE '\b' || replace(p_name, ' ', '\s+') || '\b' END AS pat, CASE WHEN p_brand = 'Brand#1' THEN '' ELSE p_brand END AS brand FROM part"""),
    "sheet": ((), "SELECT 'P' || (p_partkey % 1500) AS article_id, p_partkey, p_name, p_brand FROM part WHERE p_partkey % 10 <> 9"),
}


def sql(body: str, *roots: str) -> str:
    """The body behind the blocks it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for need in BLOCKS[name][0]:
            visit(need)
        for used in re.findall(r"\b(?:FROM|JOIN)\s+(\w+)", BLOCKS[name][1]):
            if used in BLOCKS and used != name and used not in order:
                visit(used)
        if name not in order:
            order.append(name)

    for root in roots:
        visit(root)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({BLOCKS[n][1]})" for n in order) + "\n" + body


MENTION_ROW = (
    "article_id, source_path, slot AS entity_type, entity_id, label_es, label_en, category, matched_text, section, page, "
    + ", ".join(f"{yes('c_' + c)} AS cue_{c}" for c in CUES) + ", context, sentence"
)
SUMMARY_ROW = (
    "article_id, slot AS entity_type, entity_id, label_es, label_en, category, n AS n_mentions, sections, role, role_label, study_context, confidence, "
    "total::INT AS confidence_score, evidence_text, basis AS extraction_or_inference"
)
ARTICLE_ROW = f"article_id, source_path, title, year, doi, metadata_study_type, article_kind, pages, word_count, {yes('word_count >= 50')} AS text_extractable"
TOKENS = (
    "list_filter(list_distinct(list_transform(list_filter(regexp_extract_all({t}, '" + fixed.TITLE_TOKEN
    + "'), lambda w: length(w) >= 5), lambda w: lower(w))), lambda w: w NOT IN (" + ", ".join(q(w) for w in fixed.TITLE_STOPWORDS) + "))"
)
OVERLAP = "len(list_filter(" + TOKENS + ", lambda w: contains(lower(substr(text, 1, 12000)), w)))"
CTOKENS = TOKENS.replace(fixed.TITLE_TOKEN, fixed.CONTEXT_TITLE_TOKEN).replace(
    ", ".join(q(w) for w in fixed.TITLE_STOPWORDS), ", ".join(q(w) for w in fixed.CONTEXT_TITLE_STOPWORDS))
COVERLAP = "len(list_filter(" + CTOKENS + ", lambda w: contains(lower(substr(text, 1, 12000)), w)))"
SAMPLE_ROLE = """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY slot, role, confidence ORDER BY md5('13|' || article_id || '|' || slot || '|' || entity_id)) AS lvl,
 count(*) OVER (PARTITION BY slot, role, confidence) AS size, dense_rank() OVER (ORDER BY slot, role, confidence) AS place FROM summaries s) ORDER BY lvl, size DESC, place LIMIT 200"""
SAMPLE_RELATION = """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY association, confidence ORDER BY md5('13|' || article_id || '|' || a_id || '|' || b_id)) AS lvl,
 count(*) OVER (PARTITION BY association, confidence) AS size, dense_rank() OVER (ORDER BY association, confidence) AS place FROM relations s) ORDER BY lvl, size DESC, place LIMIT 200"""
SECTIONS = [s for s in P.sections if s != "other"]
B_CATEGORIES = sorted({t.category for t in P.terms if t.slot == "b"})
REVIEW_NAMES = [
    "ID del articulo", "Titulo", "Año", "DOI", f"Variable A: {P.name_a}", f"Categoria de {P.name_a.lower()}", "Numero de menciones", "Rol de la variable A",
    f"Variable B: {P.name_b}", "Rol de la variable B", "Tipo de estudio", "Modelo experimental", "Evidencia textual", "Nivel de confianza",
    f"Asociacion {P.name_a.lower()}-{P.name_b.lower()}", "Seccion de evidencia", "Extraccion o inferencia",
]
REVIEW_VALUES = [
    "a.article_id", "t.title", "t.year", "t.doi", "a.label_es", "a.category", "a.n", "a.role_label", "coalesce(b.label_es, 'no detectado')", "coalesce(b.role_label, 'no detectado')",
    "t.article_kind", "a.study_context",
    "CASE WHEN b.entity_id IS NULL THEN a.evidence_text ELSE coalesce(r.evidence, '') END", "CASE WHEN b.entity_id IS NULL THEN a.confidence ELSE coalesce(r.confidence, '') END",
    "CASE WHEN b.entity_id IS NULL THEN 'no detectado' ELSE coalesce(r.association, 'sin_evidencia_suficiente') END", "coalesce(r.section, '')",
    "CASE WHEN b.entity_id IS NULL THEN a.basis WHEN r.association IS NULL THEN 'extraccion_literal_sin_relacion_directa' ELSE 'inferencia_contextual_con_evidencia_textual' END",
]


def matrix(slot: str, value: str, zero: str) -> str:
    terms = sorted((t for t in P.terms if t.slot == slot), key=lambda t: t.entity_id)
    cells = ", ".join(
        f"coalesce(max({value}) FILTER (entity_id = {q(t.entity_id)}), {zero}) AS \"{slot}_{t.label_es}_{t.entity_id}\"" for t in terms)
    return sql(
        f"SELECT u.article_id, u.title, u.year, u.doi, u.article_kind, u.word_count, {cells} FROM usable u "
        f"LEFT JOIN (SELECT * FROM tfidf WHERE slot = {q(slot)}) t ON t.article_id = u.article_id GROUP BY ALL", "tfidf", "usable")


CO_SIDE = "SELECT DISTINCT article_id, entity_id, label_es, category FROM mentions WHERE slot = "
ORACLES: dict[str, str] = {
    "mention_totals": sql(
        "SELECT label_es AS contaminante, category AS categoria, count(*) AS menciones_totales, count(DISTINCT article_id) AS articulos_unicos, "
        "round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS porcentaje_menciones FROM hits GROUP BY label_es, category", "hits"),
    "mention_offsets": sql("SELECT article_id, mention_idx, nth, slot AS entity_type, entity_id, start_at AS start, end_at AS \"end\", matched_text FROM numbered", "numbered"),
    "mention_context": sql("SELECT article_id, mention_idx, page, context FROM mentions", "mentions"),
    "mention_sentence": sql("SELECT article_id, mention_idx, sentence FROM mentions", "mentions"),
    "mention_score": sql("SELECT article_id, mention_idx, section, score FROM mentions", "mentions"),
    "mention_rows": sql(f"SELECT {MENTION_ROW} FROM mentions", "mentions"),
    "sentence_spans": sql(f"""
 SELECT article_id, start_at AS start, start_at + length(body) AS "end", {squash('body')} AS sentence FROM (
  SELECT article_id, body, sum(length(sep)) OVER w + coalesce(sum(length(body)) OVER (PARTITION BY article_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_at FROM (
   SELECT article_id, n, CASE WHEN n = 1 THEN '' ELSE split_part(part, chr(2), 1) END AS sep, CASE WHEN n = 1 THEN part ELSE substr(part, instr(part, chr(2)) + 1) END AS body FROM (
    SELECT article_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS n FROM (
     SELECT article_id, string_split(regexp_replace(text, '([.!?])({WS}+)([A-ZÁÉÍÓÚÜÑ0-9])', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g'), chr(1)) AS parts FROM raw)))
  WINDOW w AS (PARTITION BY article_id ORDER BY n)) WHERE {squash('body')} <> ''""", "raw"),
    "clean_text": sql(
        "SELECT article_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*([\\p{L}\\p{N}_])', '\\1\\2', 'g'), "
        f"'[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{WS}+', ''), '{WS}+$', '')) AS cleaned, md5({squash('text')}) AS squashed, "
        f"len(regexp_extract_all(text, '{WORD}+')) AS words FROM raw", "raw"),
    "section_spans": sql(
        "SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY start_at) - 1 AS span_no, name AS section, start_at AS start, end_at AS \"end\" FROM spans WHERE end_at > start_at", "spans"),
    "article_rows": sql(f"SELECT {ARTICLE_ROW} FROM art", "art"),
    "metadata_choice": sql(
        f"SELECT article_id, CASE WHEN two AND {OVERLAP.replace('{t}', 't1')} > {OVERLAP.replace('{t}', 't0')} THEN t1 ELSE t0 END AS chosen_title FROM meta", "meta"),
    "context_metadata_choice": sql(
        f"SELECT article_id, CASE WHEN two AND {COVERLAP.replace('{t}', q(''))} > {COVERLAP.replace('{t}', 't0')} THEN t1 ELSE t0 END AS chosen_title FROM meta", "meta"),
    "metadata_articles": sql(f"""
 SELECT article_id, title, year, doi, study AS metadata_study_type, {article_kind('title', 'study', 'text')} AS article_kind FROM (
  SELECT article_id, text, CASE WHEN sq <> '' THEN sq ELSE line END AS title, CASE WHEN second OR year0 = '' THEN regexp_extract(substr(text, 1, 4000), '{YEAR}', 1) ELSE year0 END AS year,
   CASE WHEN second THEN rtrim(regexp_extract(substr(text, 1, 10000), '{DOI}', 0), '.') ELSE '10.1234/AB.' || article_id END AS doi, CASE WHEN second THEN 'cohort study' ELSE '' END AS study FROM (
   SELECT *, {squash('CASE WHEN second THEN t1 ELSE t0 END')} AS sq, {first_line(90, 12, 260, fixed.TITLE_BOILERPLATE)} AS line, regexp_extract('in ' || (1950 + doc_id % 100), '{YEAR}', 1) AS year0 FROM (
    SELECT *, two AND {OVERLAP.replace('{t}', 't1')} > {OVERLAP.replace('{t}', 't0')} AS second FROM meta)))""", "meta"),
    "sheet_metadata": sql("SELECT article_id, ' ' || arg_max('P' || (p_partkey % 1500), p_partkey) AS \"ID\", arg_max(p_name, p_partkey) AS \"Title\", '' AS col3, arg_max(p_brand, p_partkey) AS \"Title_2\" FROM sheet GROUP BY article_id", "sheet"),
    "natural_file_order": (
        "SELECT '/corpus/' || s || '.TXT' AS p, s AS article_id, CASE WHEN x THEN s ELSE 'A' END AS order_text, CASE WHEN x THEN '0' ELSE CAST(doc_id AS VARCHAR) END AS order_number, "
        "CASE WHEN x THEN '.txt' ELSE '' END AS order_suffix FROM (SELECT doc_id, doc_id % 3 = 0 AS x, CASE WHEN doc_id % 3 = 0 THEN 'x_' ELSE 'A' END || doc_id AS s FROM documents)"),
    "page_offsets": sql(
        "SELECT article_id, page_no, s AS page_start, s + length(page_text) AS page_end FROM (SELECT *, coalesce(sum(length(page_text) + 3) OVER "
        "(PARTITION BY article_id ORDER BY page_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM cpages)", "cpages"),
    "paged_articles": sql(
        "SELECT article_id, count(*) AS pages, length(string_agg(page_text, chr(10) || chr(12) || chr(10) ORDER BY page_no)) AS chars, "
        "md5(string_agg(page_text, chr(10) || chr(12) || chr(10) ORDER BY page_no)) AS text_md5 FROM cpages GROUP BY article_id", "cpages"),
    "paged_mentions": sql(
        f"SELECT article_id, row_number() OVER (PARTITION BY article_id ORDER BY start_at, slot, entity_id, term_no) - 1 AS mention_idx, entity_id, start_at AS start, "
        f"least(pages, 1 + length(substr(text, 1, start_at::INT)) - length(replace(substr(text, 1, start_at::INT), chr(12), ''))) AS page, {cut('text', 'start_at', 'end_at')} AS matched_text FROM ("
        + find_hits("(SELECT *, len(regexp_extract_all(text, '" + WORD + "+')) AS word_count FROM (SELECT article_id, count(*) AS pages, string_agg(page_text, chr(10) || chr(12) || chr(10) ORDER BY page_no) AS text FROM cpages GROUP BY article_id))", "word_count >= 50", ", text, pages")
        + ")", "cpages", "lex"),
    "entity_summary": sql(f"SELECT {SUMMARY_ROW} FROM summaries", "summaries"),
    "summary_roles": sql("SELECT slot AS entity_type, role, confidence, count(*) AS n, sum(total)::BIGINT AS score FROM summaries GROUP BY ALL", "summaries"),
    "relations": sql(
        "SELECT r.article_id, title, year, doi, a_id AS entity_a_id, a_label AS entity_a_label, a_cat AS entity_a_category, b_id AS entity_b_id, b_label AS entity_b_label, b_cat AS entity_b_category, "
        "association, confidence, score AS confidence_score, study_context, section, evidence AS evidence_text, 'inferencia_contextual_con_evidencia_textual' AS extraction_or_inference "
        "FROM relations r JOIN art USING (article_id)", "relations", "art"),
    "review_table": sql(
        "SELECT " + ", ".join(f'{v} AS "{n}"' for v, n in zip(REVIEW_VALUES, REVIEW_NAMES)) +
        " FROM summaries a LEFT JOIN summaries b ON b.article_id = a.article_id AND b.slot = 'b' "
        "LEFT JOIN relations r ON r.article_id = a.article_id AND r.a_id = a.entity_id AND r.b_id = b.entity_id JOIN art t ON t.article_id = a.article_id WHERE a.slot = 'a'",
        "summaries", "relations", "art"),
    "kwic": sql(
        "SELECT m.article_id, title, year, doi, slot AS entity_type, entity_id, label_es, label_en, category, matched_text, section, page, "
        f"substr({squash(cut('m.text', 'start_at - 160', 'start_at'))}, 1, 900) AS left_context, matched_text AS keyword, substr({squash(cut('m.text', 'end_at', 'end_at + 160'))}, 1, 900) AS right_context, "
        f"substr(sentence, 1, 1400) AS sentence, {', '.join(yes('c_' + c) + ' AS cue_' + c for c in CUES)} FROM mentions m JOIN art USING (article_id)",
        "mentions", "art"),
    "term_values": sql("SELECT article_id, slot AS entity_type, entity_id, col AS \"column\", n, round(per_10k, 6) AS per_10k, round(tfidf, 6) AS tfidf FROM tfidf", "tfidf"),
    "term_count_matrix": matrix("a", "n", "0"),
    "term_per_10k_matrix": matrix("b", "round(per_10k, 6)", "0.0"),
    "term_tfidf_matrix": matrix("b", "round(tfidf, 6)", "0.0"),
    "entity_frequency": sql(
        "SELECT slot AS entity_type, entity_id, label_es, label_en, category, sum(n)::BIGINT AS raw_mentions, count(*) AS articles_with_mentions, round(count(*) / n_art, 6) AS document_frequency, "
        "round(ln((1.0 + n_art) / (1 + count(*))) + 1, 6) AS idf, round(sum(n) * 10000.0 / words, 6) AS mentions_per_10k_words_corpus, round(sum(n) / n_art, 6) AS mean_mentions_per_article "
        "FROM counts, corpus GROUP BY slot, entity_id, label_es, label_en, category, n_art, words", "counts", "corpus"),
    "cooccurrence": sql(f"""
 SELECT coalesce(t.al, e.al) AS entity_a_label, coalesce(t.ac, e.ac) AS entity_a_category, coalesce(t.bl, e.bl) AS entity_b_label, coalesce(t.bc, e.bc) AS entity_b_category,
  coalesce(t.n, 0) AS article_level_n_articles, coalesce(e.n, 0) AS evidence_level_n_articles, coalesce(e.rels, 0) AS evidence_level_n_relations, coalesce(e.w, 0)::DOUBLE AS weighted_evidence_score,
  greatest(0, coalesce(t.n, 0) - coalesce(e.n, 0)) AS possible_article_level_false_positives, coalesce(t.ids, '') AS article_ids_article_level, coalesce(e.ids, '') AS article_ids_evidence_level,
  CASE WHEN e.n > 0 THEN 'evidence_backed_pair' ELSE 'article_level_cooccurrence_only_manual_check_required' END AS interpretation, coalesce(art.title, '') AS example_title
 FROM (SELECT a.entity_id AS ai, b.entity_id AS bi, a.label_es AS al, a.category AS ac, b.label_es AS bl, b.category AS bc, count(*) AS n,
   array_to_string(list_sort(list(a.article_id))[1:20], '; ') AS ids, min(a.article_id) AS f FROM ({CO_SIDE}'a') a JOIN ({CO_SIDE}'b') b ON a.article_id = b.article_id GROUP BY ALL) t
 FULL JOIN (SELECT a_id AS ai, b_id AS bi, a_label AS al, a_cat AS ac, b_label AS bl, b_cat AS bc, count(DISTINCT article_id) AS n, count(*) AS rels, sum(w) AS w,
   array_to_string(list_sort(list(DISTINCT article_id))[1:20], '; ') AS ids FROM weighted WHERE association <> 'sin_evidencia_suficiente' GROUP BY ALL) e ON t.ai = e.ai AND t.bi = e.bi
 LEFT JOIN art ON art.article_id = t.f""", "mentions", "weighted", "art"),
    "weight_sensitivity": sql(
        "SELECT s.article_id, s.slot AS entity_type, s.entity_id, any_value(s.label_es) AS label_es, any_value(s.category) AS category, any_value(role) AS role, any_value(confidence) AS confidence, "
        f"any_value(n) AS n_mentions, any_value(sections) AS sections, sum({case('section', P.weights, '1')})::BIGINT AS active_configured_section_score, "
        + ", ".join(f"sum({case('section', w, str(w['other']))})::BIGINT AS {name}_section_score" for name, w in fixed.SECTION_PROFILES.items())
        + " FROM summaries s JOIN mentions m ON m.article_id = s.article_id AND m.slot = s.slot AND m.entity_id = s.entity_id GROUP BY s.article_id, s.slot, s.entity_id", "summaries", "mentions"),
    "role_sample": sql(
        "SELECT article_id, title, slot AS entity_type, label_es, category, role AS algorithm_role, confidence AS algorithm_confidence, n AS n_mentions, sections, evidence_text, "
        f"'' AS human_role, '' AS human_confidence, '' AS correct_evidence, '' AS reviewer_notes FROM ({SAMPLE_ROLE}) JOIN art USING (article_id)", "summaries", "art"),
    "relation_sample": sql(
        "SELECT article_id, title, a_label AS entity_a_label, a_cat AS entity_a_category, b_label AS entity_b_label, b_cat AS entity_b_category, association AS algorithm_association, "
        "confidence AS algorithm_confidence, score AS confidence_score, section, evidence AS evidence_text, '' AS human_association, '' AS human_confidence, '' AS correct_evidence, '' AS reviewer_notes "
        f"FROM ({SAMPLE_RELATION}) JOIN art USING (article_id)", "relations", "art"),
    "run_summary": sql(
        "SELECT (SELECT count(*) FROM art) AS n_articles, (SELECT count(*) FROM usable) AS n_extractable_articles, (SELECT count(*) FROM mentions) AS n_mentions, (SELECT count(*) FROM summaries) AS n_entity_summaries, "
        f"(SELECT count(*) FROM relations) AS n_relations, '' AS warning, (SELECT count(*) FROM ({SAMPLE_ROLE})) AS entity_roles_rows, (SELECT count(DISTINCT place) FROM ({SAMPLE_ROLE})) AS entity_roles_strata, "
        f"(SELECT count(*) FROM ({SAMPLE_RELATION})) AS relations_rows, (SELECT count(DISTINCT place) FROM ({SAMPLE_RELATION})) AS relations_strata, 13 AS seed, 260 AS context_radius, 160 AS kwic_radius, "
        "900 AS relation_distance, 4 AS kmeans_k, 200 AS validation_sample_size, 'baseline_current' AS active_profile, 'documents' AS protocol, 'Sustancias' AS variable_a, 'Efectos' AS variable_b",
        "art", "usable", "mentions", "summaries", "relations"),
    "role_precision": sql("SELECT role, count(*) AS judged, count_if(verdict = 'yes') AS confirmed, round(avg((verdict = 'yes')::INT), 6) AS precision FROM summaries JOIN judge USING (article_id) GROUP BY role", "summaries", "judge"),
    "association_precision": sql("SELECT association, count(*) AS judged, count_if(verdict = 'yes') AS confirmed, round(avg((verdict = 'yes')::INT), 6) AS precision FROM relations JOIN judge USING (article_id) GROUP BY association", "relations", "judge"),
    "section_false_positives": sql("SELECT section, count(*) AS judged, count_if(verdict = 'no') AS false_positives FROM relations JOIN judge USING (article_id) GROUP BY section", "relations", "judge"),
    "entity_false_positives": sql("SELECT entity_id, count(*) AS judged, count_if(verdict = 'no') AS false_positives FROM summaries JOIN judge USING (article_id) GROUP BY entity_id", "summaries", "judge"),
    "reviewer_agreement": (
        "SELECT n AS items, eq AS equal, round(o, 6) AS observed, round(e, 6) AS expected, round((o - e) / (1 - e), 6) AS kappa FROM (SELECT *, eq / n AS o, (x1 * y1 + (n - x1) * (n - y1)) / (n * n) AS e FROM ("
        "SELECT count(*) AS n, count_if(quality = 1 - toxic) AS eq, count_if(quality = 1)::DOUBLE AS x1, count_if(toxic = 0)::DOUBLE AS y1 FROM labels))"),
    "detection_frequency": sql(
        "SELECT label, articles, greatest(0, (SELECT count(*) FROM f) - 35) AS labels_not_shown FROM f ORDER BY articles DESC, label LIMIT 35".replace(
            "FROM f", "FROM (SELECT label_es AS label, count(*) AS articles FROM summaries WHERE slot = 'a' AND role NOT IN ('role_bibliographic_only', 'role_unclear') GROUP BY label_es)"), "summaries"),
    "category_counts": sql("SELECT a_cat AS entity_a_category, b_cat AS entity_b_category, count(*) AS relations FROM relations WHERE association <> 'sin_evidencia_suficiente' GROUP BY ALL", "relations"),
    "articles_by_kind": sql("SELECT article_kind, count(*) AS articles FROM art GROUP BY article_kind", "art"),
    "relations_by_association": sql("SELECT association, count(*) AS relations FROM relations GROUP BY association", "relations"),
    "pairs_by_type": sql("SELECT * FROM pair_type", "pair_type"),
    "pairs_collapsed": sql("SELECT * FROM pair_all", "pair_all"),
    "section_weight_matrix": sql(
        "SELECT association, " + ", ".join(f"coalesce(sum(w) FILTER (section = '{s}'), 0)::DOUBLE AS {s}" for s in SECTIONS) + " FROM weighted WHERE association <> 'sin_evidencia_suficiente' GROUP BY association", "weighted"),
    "category_weight_matrix": sql(
        "SELECT a_cat AS entity_a_category, " + ", ".join(f"coalesce(sum(w) FILTER (b_cat = '{c}'), 0)::DOUBLE AS {c.replace(' ', '_')}" for c in B_CATEGORIES)
        + " FROM weighted WHERE association <> 'sin_evidencia_suficiente' GROUP BY a_cat", "weighted"),
    "top_pairs": sql("SELECT * FROM pair_all ORDER BY weighted_score DESC, entity_a_label, entity_b_label LIMIT 30", "pair_all"),
    "bubble_cells": sql("""
 SELECT row_no, dense_rank() OVER (ORDER BY total_b DESC, entity_b_label) AS col_no, entity_a_label, entity_b_label, weighted_score, n_relations, avg_strength,
  CASE WHEN avg_strength >= 7 THEN 'strong' WHEN avg_strength >= 4 THEN 'medium' ELSE 'weak' END AS strength FROM (
  SELECT *, sum(weighted_score) OVER (PARTITION BY entity_b_label) AS total_b FROM (
   SELECT *, dense_rank() OVER (ORDER BY total_a DESC, entity_a_label) AS row_no FROM (SELECT *, sum(weighted_score) OVER (PARTITION BY entity_a_label) AS total_a FROM pair_all)) WHERE row_no <= 18)""", "pair_all"),
    "network_edges": sql("""
 SELECT entity_a_label, entity_b_label, association, weighted_score, sum(weighted_score) OVER (PARTITION BY entity_a_label) AS weight_a, sum(weighted_score) OVER (PARTITION BY entity_b_label) AS weight_b
 FROM (SELECT * FROM pair_type ORDER BY weighted_score DESC, entity_a_label, entity_b_label, association LIMIT 55)""", "pair_type"),
    "section_totals": sql(
        "SELECT coalesce(d.section, m.section) AS section, coalesce(m.n, 0) AS menciones_totales, round(coalesce(m.n, 0) * 100.0 / (SELECT count(*) FROM mentions), 6) AS porcentaje_menciones, coalesce(d.seccion, m.section) AS seccion FROM (VALUES "
        + ", ".join(f"({q(k)}, {q(v)})" for k, v in fixed.SECTION_REPORT_LABELS.items())
        + ") d(section, seccion) FULL JOIN (SELECT section, count(*) AS n FROM mentions GROUP BY section) m ON m.section = d.section", "mentions"),
    "label_by_section": sql(
        "SELECT label_es, " + ", ".join(f"count_if(section = '{s}') AS {s}" for s in P.sections) + ", count(*) AS total FROM mentions GROUP BY label_es ORDER BY total DESC, label_es LIMIT 25", "mentions"),
    "article_features": sql("SELECT article_id, feature, round(value, 6) AS value FROM features", "features"),
    "feature_stats": sql("SELECT feature, round(mean, 6) AS mean, round(deviation, 6) AS deviation FROM fstats", "fstats"),
    "standardised_features": sql("SELECT article_id, feature, round((value - mean) / deviation, 5) AS z FROM chosen_features JOIN fstats USING (feature)", "fstats", "chosen_features"),
    "context_mention_rows": sql(
        "SELECT article_id, source_path AS pdf_path, start_at::BIGINT // 1000 + 1 AS page, title, article_kind, category AS familia, label_es AS contaminante, matched_text, section, score AS score_mencion, "
        f"{yes('c_exposure')} AS exposure_cue, {yes('c_dose')} AS dose_cue, {yes('c_background')} AS background_cue, {yes('generic')} AS generic_term, context FROM cment", "cment"),
    "context_summary": sql(
        "SELECT article_id, pdf_path, title, article_kind, familia, contaminante, clasificacion, score::BIGINT AS score_contextual, n AS menciones_totales, "
        + ", ".join(f"n_{s} AS menciones_{s}" for s in fixed.CONTEXT_SECTION_WEIGHTS)
        + ", n_exposure AS menciones_con_cue_exposicion, n_dose AS menciones_con_cue_dosis, n_background AS menciones_con_cue_fondo, ejemplos AS ejemplos_contexto FROM cgroup", "cgroup"),
    "context_articles": sql(
        "SELECT article_id, any_value(title) AS title, any_value(article_kind) AS article_kind, "
        + ", ".join(
            f"coalesce(array_to_string(list(contaminante || ' (' || familia || ')' ORDER BY score DESC, n DESC, contaminante) FILTER (clasificacion IN ({cs}))[1:8], '; '), '') AS {name}"
            for name, cs in (("contaminantes_trabajados", "'trabajado_como_exposicion_o_ensayo'"), ("contaminantes_posibles_secundarios", "'posible_secundario'"),
                             ("contaminantes_en_revision", "'revision_o_sintesis'"), ("contaminantes_solo_contexto", "'mencion_de_contexto', 'solo_referencias'")))
        + ", count_if(clasificacion = 'trabajado_como_exposicion_o_ensayo') AS n_contaminantes_trabajados, count_if(clasificacion = 'posible_secundario') AS n_contaminantes_posibles, "
        "count_if(clasificacion IN ('mencion_de_contexto', 'solo_referencias')) AS n_contaminantes_contexto, sum(n)::BIGINT AS menciones_totales FROM cgroup GROUP BY article_id", "cgroup"),
    "context_categories": sql("SELECT * FROM ccat", "ccat"),
    "context_diagnostics": sql(
        f"SELECT a.article_id, source_path AS pdf_path, title, article_kind, pages, word_count AS word_count_estimate, coalesce(n, 0) AS mentions_found, {yes('word_count >= 50')} AS text_extractable "
        "FROM cart a LEFT JOIN (SELECT article_id, count(*) AS n FROM chits GROUP BY article_id) h ON h.article_id = a.article_id", "cart", "chits"),
    "context_report": sql(
        "SELECT (SELECT count(*) FROM cart) AS articles, (SELECT count_if(word_count < 50) FROM cart) AS without_text, (SELECT count(*) FROM chits) AS mentions, "
        "count_if(clasificacion = 'trabajado_como_exposicion_o_ensayo') AS worked, count_if(clasificacion = 'posible_secundario') AS possible, "
        "count_if(clasificacion IN ('mencion_de_contexto', 'solo_referencias')) AS context_only, median(score)::DOUBLE AS median_score FROM cgroup", "cgroup", "cart", "chits"),
    "context_top_families": sql(
        "SELECT familia, articulos_trabajado_como_exposicion_o_ensayo, articulos_posible_secundario, articulos_mencion_de_contexto FROM ccat ORDER BY articulos_trabajado_como_exposicion_o_ensayo DESC, familia LIMIT 12", "ccat"),
    "context_worked_names": sql(
        "SELECT contaminante, count(*) AS articles FROM cgroup WHERE clasificacion = 'trabajado_como_exposicion_o_ensayo' GROUP BY contaminante ORDER BY articles DESC, contaminante LIMIT 25", "cgroup"),
    "context_sections": sql("SELECT section, count(*) AS mentions FROM cment GROUP BY section", "cment"),
    "run_metrics": sql(
        "SELECT 'articles' AS metric, count(*) AS value FROM art UNION ALL SELECT 'extractable_articles', count(*) FROM usable UNION ALL SELECT 'mentions', count(*) FROM mentions "
        "UNION ALL SELECT 'summaries', count(*) FROM summaries UNION ALL SELECT 'relations', count(*) FROM relations", "art", "usable", "mentions", "summaries", "relations"),
    "relation_preview": sql(
        "SELECT " + ", ".join(f"CASE WHEN length({v}) > 220 THEN rtrim(substr({v}, 1, 216)) || ' […]' ELSE {v} END AS {n}" for v, n in (
            ("a_label", "entity_a_label"), ("b_label", "entity_b_label"), ("association", "association"), ("confidence", "confidence"), ("section", "section"), ("evidence", "evidence_text")))
        + " FROM (SELECT * FROM relations ORDER BY article_id, a_id, b_id LIMIT 12)", "relations"),
    "table_preview": sql(
        "SELECT COLUMNS(*)::VARCHAR FROM (SELECT article_id, entity_type, entity_id, label_es, label_en, category, n_mentions, substr(sections, 1, 500) AS sections, role, role_label, study_context, confidence, confidence_score, "
        f"substr(evidence_text, 1, 500) AS evidence_text, extraction_or_inference FROM (SELECT {SUMMARY_ROW} FROM summaries) ORDER BY article_id, entity_type, entity_id LIMIT 25)", "summaries"),
    "taxonomy_terms": sql(
        "SELECT coalesce(entity, nullif(lower(es), ''), lower(en)) AS entity_id, es AS label_es, en AS label_en, p_type || CASE WHEN brand <> '' THEN ' > ' || brand ELSE '' END AS category, pat AS patterns, "
        "CAST(p_partkey AS VARCHAR) AS position FROM nodes WHERE pat <> '' AND (es <> '' OR en <> '')", "nodes"),
    "taxonomy_parents": sql("SELECT CASE WHEN brand <> '' THEN brand ELSE p_type END AS category, count(*) AS terms FROM nodes WHERE pat <> '' AND (es <> '' OR en <> '') GROUP BY ALL", "nodes"),
    "incomplete_terms": sql(
        f"SELECT 't' || p_partkey AS node_id, {yes(chr(40) + 'es = ' + q('') + ' AND en = ' + q('') + chr(41))} AS no_label, {yes('pat = ' + q(''))} AS no_pattern FROM nodes WHERE pat = '' OR (es = '' AND en = '')", "nodes"),
    "double_escaped": sql("SELECT 't' || p_partkey AS node_id, pat AS pattern FROM nodes WHERE contains(pat, '\\\\')", "nodes"),
    "unlabelled_categories": sql("SELECT p_type || '/' || p_brand AS node_id, count(*) AS children FROM nodes WHERE brand = '' GROUP BY ALL", "nodes"),
    "dictionary_counts": sql("SELECT count(*) AS terms, (SELECT count(DISTINCT p_type) + count(DISTINCT p_type || '/' || p_brand) FROM part) AS categories, 'Si' AS has_terms FROM nodes", "nodes"),
    "unreachable_labels": sql(
        "SELECT entity_id, lang, label FROM (SELECT 't' || p_partkey AS entity_id, unnest(['es', 'en']) AS lang, unnest([es, en]) AS label, pat FROM nodes) WHERE label <> '' AND (pat = '' OR NOT regexp_matches(label, '(?i)' || pat))", "nodes"),
    "sample_assertions": sql(f"""
 SELECT sample_id, missing, false_positives, 'absent_id' AS unknown FROM (SELECT CAST(doc_id AS VARCHAR) AS sample_id,
  CASE WHEN lang = 'de' THEN concat_ws(',', CASE WHEN NOT d THEN 'der' END, CASE WHEN NOT n THEN 'nicht' END) ELSE '' END AS missing,
  CASE WHEN lang = 'de' THEN '' ELSE concat_ws(',', CASE WHEN d THEN 'der' END, CASE WHEN n THEN 'nicht' END) END AS false_positives
  FROM (SELECT *, {fires('x', 'text', {'x': [chr(92) + 'bder' + chr(92) + 'b']})} AS d, {fires('x', 'text', {'x': [chr(92) + 'bnicht' + chr(92) + 'b']})} AS n FROM documents))""", ),
    "survey_votes": sql(
        "SELECT event_type AS parameter, '3' AS current_value, count(*) AS responses, count_if(user_id % 4 = 0) AS mantener, count_if(user_id % 4 = 1) AS subir, count_if(user_id % 4 = 2) AS bajar, count_if(user_id % 4 = 3) AS no_se, "
        "floor(count_if(user_id % 4 IN (1, 2)) * 100.0 / count(*) + 0.5)::INT AS pct_change FROM answers WHERE pick = 0 GROUP BY event_type", "answers"),
    "survey_proposals": sql("SELECT response_id, parameter, value FROM proposed", "proposed"),
    "survey_stats": sql(
        "SELECT parameter, count(*) AS n, floor(avg(value) * 100 + 0.5) / 100 AS mean, min(value) AS min, max(value) AS max, "
        "CASE WHEN count(*) % 2 = 1 THEN median(value) ELSE floor(median(value) * 100 + 0.5) / 100 END AS median FROM proposed GROUP BY parameter", "proposed"),
    "survey_grid": sql(
        "SELECT question AS grid, row_label AS term, count_if(cell = 'Bien clasificado') AS well_placed, count_if(cell = 'Debería ir en otro grupo') AS other_group, count_if(cell = 'No debería estar / sobra') AS surplus, "
        "count_if(cell = 'No sé') AS unknown, count_if(cell = '(sin responder)') AS unanswered FROM answers WHERE pick = 2 GROUP BY ALL", "answers"),
    "survey_comments": sql("SELECT response_id, question, 'nota ' || user_id AS comment FROM answers WHERE pick = 3 AND user_id % 3 <> 0", "answers"),
    "survey_profiles": sql("SELECT CASE user_id % 5 WHEN 0 THEN '(sin responder)' WHEN 1 THEN 'Docente' ELSE 'Investigador' END AS profile, count(*) AS responses FROM answers WHERE pick = 4 GROUP BY ALL", "answers"),
}
ORACLES["sample_assertions"] = ORACLES["sample_assertions"].replace("WITH \n", "", 1)
