r"""SQL building blocks: the engine's rules once more, as common table expressions that read the same tables."""

from __future__ import annotations

from hayrick.config import DEFAULT as S
from hayrick.functions import headers as H

WS = r"[\t-\r\x{1c}-\x{20}\x{85}\p{Z}]"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda w: w <> '')"


def raw_tokens(x: str) -> str:
    return rf"list_filter(string_split(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return raw_tokens(f"lower({x})")


def numbers(x: str) -> str:
    found = rf"list_filter({raw_tokens(x)}, lambda w: regexp_matches(w, '^\p{{Nd}}+$'))"
    return f"list_distinct(list_transform({found}, lambda w: CASE WHEN ltrim(w, '0') = '' THEN '0' ELSE ltrim(w, '0') END))"


def query_numbers(x: str) -> str:
    decades = f"list_filter({raw_tokens(x)}, lambda w: regexp_matches(w, '^[0-9]{{3,4}}0s$'))"
    years = f"flatten(list_transform({decades}, lambda w: list_transform(range(0, 10), lambda i: (rtrim(w, 's')::BIGINT + i)::VARCHAR)))"
    return f"list_distinct(list_concat({numbers(x)}, {years}))"


def in_order(x: str) -> str:
    """Digit strings in numeric order, space-joined."""
    return f"array_to_string(list_transform(list_sort(list_transform({x}, lambda w: {{'k': length(w), 'w': w}})), lambda r: r.w), ' ')"


def sentence_list(x: str) -> str:
    cut = f"""string_split(regexp_replace({x}, '([.!?]){WS}+([A-Z"''(])', concat('\\1', chr(1), '\\2'), 'g'), chr(1))"""
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


# Terms and postings at document level.
POSTINGS = f"""
units AS (SELECT doc_id, {tokens("coalesce(text, '')")} AS toks FROM documents),
stats AS (SELECT count(*)::DOUBLE AS n, coalesce(avg(len(toks)), 1.0) AS avgdl FROM units),
freqs AS (SELECT doc_id, dl, term, count(*) AS freq FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM units) GROUP BY ALL),
terms AS (SELECT term, count(*) AS df, ln((max(n) - count(*)::DOUBLE + 0.5::DOUBLE) / (count(*)::DOUBLE + 0.5::DOUBLE) + 1.0::DOUBLE) AS idf FROM freqs, stats GROUP BY term),
postings AS (SELECT term, doc_id, freq::DOUBLE * ({S.k1}::DOUBLE + 1) / (freq::DOUBLE + {S.k1}::DOUBLE * ((1 - {S.b})::DOUBLE + {S.b}::DOUBLE * dl::DOUBLE / avgdl)) AS tf_weight FROM freqs, stats)"""

SPARSE = f"""
asked AS (SELECT item_id AS query_id, unnest(list_distinct({tokens("text")})) AS term FROM benchmark),
matched AS (SELECT query_id, doc_id AS page_id, sum(idf * tf_weight) AS score FROM asked JOIN terms USING (term) JOIN postings USING (term) GROUP BY ALL),
every AS (SELECT item_id AS query_id, doc_id AS page_id, round({S.sparse_alpha}::DOUBLE * coalesce(score, 0) + (1 - {S.sparse_alpha})::DOUBLE * coalesce(score, 0), 6) AS score
          FROM benchmark CROSS JOIN documents LEFT JOIN matched ON item_id = query_id AND doc_id = page_id),
sparse_all AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM every),
sparse AS (SELECT * FROM sparse_all WHERE rank <= {S.sparse_depth})"""

DENSE = f"""
qv AS (SELECT item_id AS query_id, e.embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings e ON e.vec_id = item_id),
dv AS (SELECT doc_id AS page_id, e.embedding::DOUBLE[] AS v FROM documents JOIN embeddings e ON e.vec_id = doc_id),
dense_all AS (SELECT query_id, page_id, round(list_dot_product(qv.v, dv.v), 6) AS score FROM qv CROSS JOIN dv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS rank FROM dense_all) WHERE rank <= {S.dense_depth})"""

FUSED = f"""
merged AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.page_id, s.page_id) AS page_id, d.rank AS dr, s.rank AS sr,
           coalesce(1.0::DOUBLE / ({S.rrf_k} + d.rank), 0) + coalesce(1.0::DOUBLE / ({S.rrf_k} + s.rank), 0) AS score
           FROM dense d FULL OUTER JOIN sparse s ON d.query_id = s.query_id AND d.page_id = s.page_id),
fused AS (SELECT query_id, page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr ASC NULLS LAST, sr) AS rank FROM merged)"""

ALLOWED = f"""
page_numbers AS (SELECT DISTINCT doc_id AS page_id, unnest({numbers("coalesce(text, '')")}) AS number FROM documents),
asked_numbers AS (SELECT item_id AS query_id, unnest({query_numbers("text")}) AS number FROM benchmark),
allowed AS (SELECT DISTINCT query_id, page_id FROM asked_numbers JOIN page_numbers USING (number))"""

PRUNED = """
marked AS (SELECT f.*, a.page_id IS NOT NULL AS ok, bool_or(a.page_id IS NOT NULL) OVER (PARTITION BY f.query_id) AS any_ok
           FROM fused f LEFT JOIN allowed a ON a.query_id = f.query_id AND a.page_id = f.page_id),
final AS (SELECT query_id, page_id, score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM marked WHERE ok OR NOT any_ok)"""

RELEVANT = """
relevant AS (SELECT item_id AS query_id, doc_id AS page_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"""


def metrics(ranked: str, k: int = 10) -> str:
    ideal = f"(SELECT sum(1.0 / CASE WHEN i < 2 THEN 1.0 ELSE log2(i) END) FROM range(1, {k} + 1) t(i) WHERE i <= n)"
    ideal_std = f"(SELECT sum(1.0 / log2(i + 1)) FROM range(1, {k} + 1) t(i) WHERE i <= n)"
    return f"""
totals AS (SELECT query_id, count(*) AS n FROM relevant GROUP BY query_id),
hits AS (SELECT query_id, sum(CASE WHEN r.rank <= {k} THEN 1.0 / CASE WHEN r.rank < 2 THEN 1.0 ELSE log2(r.rank) END END) AS dcg,
                sum(CASE WHEN r.rank <= {k} THEN 1.0 / log2(r.rank + 1) END) AS dcg_std, count(*) FILTER (WHERE r.rank <= {k}) AS found, min(r.rank) AS first_rank
         FROM {ranked} r JOIN relevant USING (query_id, page_id) GROUP BY query_id),
scores AS (SELECT item_id AS query_id, coalesce(n, 0)::BIGINT AS n_relevant,
                  round(CASE WHEN n > 0 THEN coalesce(dcg, 0) / {ideal} ELSE 0 END, 6)::DOUBLE AS ndcg,
                  round(CASE WHEN n > 0 THEN coalesce(dcg_std, 0) / {ideal_std} ELSE 0 END, 6)::DOUBLE AS ndcg_standard,
                  round(CASE WHEN n > 0 THEN coalesce(found, 0) / n ELSE 0 END, 6)::DOUBLE AS recall, first_rank::INTEGER AS first_relevant_rank
           FROM benchmark LEFT JOIN totals ON item_id = totals.query_id LEFT JOIN hits ON item_id = hits.query_id)"""


def sentences(content: str) -> str:
    """Paragraphs, sentences, peeled headings and sections of ``documents``; ``content`` is an expression over text."""
    bare, w = words("rtrim(sent, '.')"), "bw"
    free = f"list_contains({_list(H.FUNCTION_WORDS)}, lower(x))"
    stops = _list(H.AUXILIARIES + H.PRONOUNS)
    return rf"""
paras AS (SELECT doc_id, unnest(ps) AS para, unnest(range(1, len(ps) + 1)) AS p
          FROM (SELECT doc_id, list_filter(list_transform(string_split_regex({content}, '\n{WS}*\n+'), lambda x: {strip("x")}), lambda x: x <> '') AS ps FROM documents)),
parts AS (SELECT doc_id, p, unnest(ss) AS sent, unnest(range(1, len(ss) + 1)) AS i FROM (SELECT doc_id, p, {sentence_list("para")} AS ss FROM paras)),
worded AS (SELECT *, len({words("sent")}) AS wc, {bare} AS bw FROM parts),
headed AS (SELECT *, regexp_matches(sent, '^\p{{Lu}}') AND ends_with(sent, '.') AND NOT contains(sent, '"') AND length(rtrim(sent, '.')) > 2 AND wc BETWEEN 1 AND {H.MAX_WORDS}
             AND len(list_filter({w}, lambda x: list_contains({stops}, trim(lower(x), '().,')))) = 0
             AND NOT (len({w}) > 1 AND len(list_filter({w}[2:], lambda x: regexp_matches(x, '^\p{{Lu}}'))) > 0
                      AND NOT (len(list_filter({w}, lambda x: NOT (regexp_matches(x, '^\p{{Lu}}') OR {free}))) = 0
                               AND len(list_filter({w}[2:], lambda x: regexp_matches(x, '^\p{{Ll}}') AND NOT {free})) = 0)) AS is_head FROM worded),
cuts AS (SELECT *, coalesce(max(i) FILTER (WHERE NOT is_head) OVER (PARTITION BY doc_id, p), 0) AS cut FROM headed),
peeled AS (SELECT doc_id, p, count(*) FILTER (WHERE i <= cut) AS n_body, count(*) FILTER (WHERE i > cut) AS n_heads,
                  coalesce(string_agg({strip("rtrim(sent, '.')")}, '|' ORDER BY i) FILTER (WHERE i > cut), '') AS heads FROM cuts GROUP BY doc_id, p),
numbered AS (SELECT *, coalesce(sum(n_heads) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS sec FROM peeled),
names AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p, i)::INTEGER AS sec, {strip("rtrim(sent, '.')")} AS name FROM cuts WHERE i > cut),
body AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY c.p, c.i) - 1 AS pos, c.sent, c.wc, n.sec, c.i = 1 AS starts
         FROM cuts c JOIN numbered n USING (doc_id, p) WHERE c.i <= c.cut),
sents AS (SELECT doc_id, pos, sent, wc, body.sec, starts AND pos > 0 AS forced, coalesce(name, '') AS section FROM body LEFT JOIN names USING (doc_id, sec))"""


PACKED = f"""
packed AS (
  SELECT doc_id, pos, 0 AS seg, CASE WHEN wc > {S.max_words} THEN 0 ELSE wc END AS w, wc <= {S.max_words} AS op FROM sents WHERE pos = 0
  UNION ALL
  SELECT s.doc_id, s.pos, CASE WHEN s.wc <= {S.max_words} AND p.op AND p.w + s.wc <= {S.max_words} THEN p.seg ELSE p.seg + 1 END,
         CASE WHEN s.wc > {S.max_words} THEN 0 WHEN p.op AND p.w + s.wc <= {S.max_words} THEN p.w + s.wc ELSE s.wc END, s.wc <= {S.max_words}
  FROM packed p JOIN sents s ON s.doc_id = p.doc_id AND s.pos = p.pos + 1)"""

_STEP = S.max_words - S.overlap_words


def sliding(x: str) -> str:
    """Pieces of a sentence that is longer than a chunk."""
    return f"list_transform(list_concat(range(0, len({x}) - {S.max_words}, {_STEP}), [len({x}) - {S.max_words}]), lambda s: array_to_string(list_slice({x}, s + 1, s + {S.max_words}), ' '))"


CHUNKS = f"""
spans AS (SELECT k.doc_id, k.seg, min(k.pos) AS a, max(k.pos) + 1 AS b, string_agg(s.sent, ' ' ORDER BY k.pos) AS core, max(s.wc) AS most, arg_min(s.sec, k.pos) AS sec, arg_min(s.section, k.pos) AS section
          FROM packed k JOIN sents s USING (doc_id, pos) GROUP BY k.doc_id, k.seg),
padded AS (SELECT g.doc_id, g.seg, g.sec, g.section, CASE WHEN g.most > {S.max_words} THEN {sliding(words("g.core"))} ELSE
             [CASE WHEN l.sent IS NOT NULL AND NOT f.forced AND l.wc <= {S.max_words} THEN l.sent || ' ' ELSE '' END || g.core ||
              CASE WHEN r.sent IS NOT NULL AND NOT r.forced AND r.wc <= {S.max_words} THEN ' ' || r.sent ELSE '' END] END AS bodies
           FROM spans g LEFT JOIN sents l ON l.doc_id = g.doc_id AND l.pos = g.a - 1 LEFT JOIN sents f ON f.doc_id = g.doc_id AND f.pos = g.a
           LEFT JOIN sents r ON r.doc_id = g.doc_id AND r.pos = g.b),
pieces AS (SELECT doc_id, seg, sec, section, unnest(bodies) AS body, unnest(range(0, len(bodies))) AS piece FROM padded),
chunks AS (SELECT doc_id AS page_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seg, piece) - 1)::INTEGER AS chunk_id, sec AS section_number, section, body,
                  '[' || coalesce(lang || ' ' || source, '') || '] ' || {strip("body")} AS text FROM pieces JOIN documents USING (doc_id))"""
