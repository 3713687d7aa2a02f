"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from hopline.llm.mixing import BLOCKS
from hopline.llm.quality_rules import BASE_RULES, MAX_RATE, PRIOR_WEIGHT, RULES, STRICT_RATE

_BASE = " OR ".join(f"({RULES[r]})" for r in BASE_RULES)
_LOW, _HIGH = PRIOR_WEIGHT
_RATES = ", ".join(f"v.rate_{r}" for r in RULES)


def _shrunk(rule: str) -> str:
    mean = f"(p.f_{rule} / p.n)"
    rho = f"(((p.q_{rule} - p.f_{rule} * {mean}) / ({mean} * (1 - {mean})) - (p.hosts - 1)) / (p.n - p.squares / p.n - (p.hosts - 1)))"
    known = f"{mean} * (1 - {mean}) > 0 AND p.n - p.squares / p.n - (p.hosts - 1) > 0"
    weight = f"CASE WHEN {known} THEN CASE WHEN {rho} > 1e-9 THEN least({_HIGH}, greatest({_LOW}, 1 / {rho} - 1)) ELSE {_HIGH} END ELSE {_HIGH} END"
    return f"(h.f_{rule} + {mean} * {weight}) / (h.n + {weight})"


OP1 = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT k, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, string_split(text, chr(10)) AS lines,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d
), win AS (
  SELECT k, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2])) AS win,
         unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2
), twice AS (
  SELECT k, win FROM win GROUP BY k, win HAVING count(*) > 1
), inside AS (
  SELECT DISTINCT k, i + o AS i FROM win JOIN twice USING (k, win), (VALUES (0), (1), (2)) AS s(o)
), rep AS (
  SELECT k, count(*) AS n_repeat_words FROM inside GROUP BY k
), ln AS (
  SELECT k, unnest(lines) AS line FROM w
), dup AS (
  SELECT k, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY k
), m AS (
  SELECT d.doc_id, d.source, len(w.words) AS n_words, coalesce(length(array_to_string(w.words, '')), 0) AS word_chars, w.n_symbols,
         coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.n_dup_lines, 0) AS n_dup_lines, coalesce(rep.n_repeat_words, 0) AS n_repeat_words
  FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN dup USING (k)
), h AS (
  SELECT source, count(*)::DOUBLE AS n, {", ".join(f"sum(({q})::INT)::DOUBLE AS f_{r}" for r, q in RULES.items())}
  FROM m WHERE source IS NOT NULL GROUP BY source
), p AS (
  SELECT sum(n) AS n, count(*) AS hosts, sum(n * n) AS squares, {", ".join(f"sum(f_{r}) AS f_{r}, sum(f_{r} * f_{r} / n) AS q_{r}" for r in RULES)} FROM h
), v AS (
  SELECT h.source, {", ".join(f"{_shrunk(r)} AS rate_{r}" for r in RULES)} FROM h, p
), j AS (
  SELECT m.*, coalesce(greatest({_RATES}) > {MAX_RATE}, false) AS host_rejected, ({_BASE}) AS base_failed, greatest({_RATES}) AS host_rate,
         {" OR ".join(f"(({q}) AND coalesce(rate_{r} >= {STRICT_RATE}, false))" for r, q in RULES.items())} AS rule_failed
  FROM m LEFT JOIN v ON m.source = v.source
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND NOT host_rejected AND NOT rule_failed AS kept, source, round(host_rate, 6) AS host_rate, host_rejected, rule_failed
FROM j
"""

OP9 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens,
         ('0x' || md5('block:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % {BLOCKS} AS block,
         ('0x' || md5('block:' || coalesce(doc_id::VARCHAR, ''))[9:16])::BIGINT % {BLOCKS} AS cell
  FROM documents
), s AS (
  SELECT source, sum(n_tokens)::BIGINT AS n FROM d GROUP BY source
), p AS (
  SELECT source, n, n / (SELECT sum(n)::DOUBLE FROM s) AS share FROM s
), ends AS (
  SELECT max(share) AS top, min(share) AS low FROM p WHERE n > 0
), b(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN pow(top / low, 1 - (lo + hi) / 2) <= 2.0 THEN lo ELSE (lo + hi) / 2 END,
         CASE WHEN pow(top / low, 1 - (lo + hi) / 2) <= 2.0 THEN (lo + hi) / 2 ELSE hi END
  FROM b, ends WHERE i < 20
), a AS (
  SELECT CASE WHEN top / low <= 2.0 THEN 0.0 ELSE hi END AS alpha FROM b, ends WHERE i = 20
), z AS (
  SELECT sum(pow(share, alpha)) AS z, max(pow(share, 1 - alpha)) AS m, sum(n)::DOUBLE AS whole FROM p, a WHERE n > 0
), q AS (
  SELECT source, n, CASE WHEN n > 0 THEN round(pow(share, alpha) / z * (whole * z * m))::BIGINT ELSE 0 END AS quota FROM p, a, z
), e AS (
  SELECT source, CASE WHEN n = 0 THEN 1 ELSE quota // n END AS epochs, CASE WHEN n = 0 THEN 0 ELSE quota % n END AS rest FROM q
), k AS (
  SELECT d.*, epochs, rest, '17:' || (epochs + 1) || ':' || coalesce(d.source, '') || ':' || block AS place
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
), placed AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source ORDER BY md5(place), md5(place || ':' || cell), md5('17:' || (epochs + 1) || ':' || coalesce(doc_id::VARCHAR, '')),
                                doc_id, md5(text) ROWS UNBOUNDED PRECEDING) AS upto FROM k
), passed AS (
  SELECT doc_id, source, n_tokens, block, unnest(range(1, epochs + 1)) AS epoch FROM placed
  UNION ALL
  SELECT doc_id, source, n_tokens, block, epochs + 1 FROM placed WHERE rest > 0 AND upto <= rest
)
SELECT doc_id, source, n_tokens, epoch::INT AS epoch, block::INT AS block,
       md5('17:' || epoch || ':' || coalesce(source, '') || ':' || block) || md5('17:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')) AS order_key
FROM passed
"""

OP8 = """
WITH v AS (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.k, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.k <> c.k AND len(q.x) = len(c.x)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE: dict[str, str] = {
    "op1_quality_rules": OP1,
    "op8_exact_topk": OP8,
    "op9_mixing": OP9,
}
