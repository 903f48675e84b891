"""SQL for the queries that SQL can express."""
from __future__ import annotations

from touchline.llm import quality_rules as Q

LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
BENCH = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def places(of: str, size: str) -> str:
    """The first places of all windows of ``size`` words in the list ``of``."""
    return f"unnest(generate_series(1, len({of}) - {size} + 1))"


REPEATS = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, w, {places('w', '50')} AS i FROM d WHERE len(w) >= 50),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM v),
f AS (SELECT s, MIN(doc_id) AS least FROM g GROUP BY s),
r AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM g JOIN f USING (s) WHERE doc_id > least),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
k AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.j) AS kept FROM x LEFT JOIN r ON r.doc_id = x.doc_id AND r.j = x.j WHERE r.j IS NULL GROUP BY x.doc_id),
n AS (SELECT doc_id, COUNT(*) AS n FROM r GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

ARCHIVE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, b, MAX(page_id) AS most FROM p WHERE b >= 1000 GROUP BY h, b)
SELECT page_id, p.b AS payload_bytes, p.h AS payload_digest, CASE WHEN most <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN most <> page_id THEN most END AS refers_to FROM p LEFT JOIN g ON g.h = p.h AND g.b = p.b"""

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {BENCH} AS w FROM documents),
b AS (SELECT item_id, {BENCH} AS w FROM benchmark),
c AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0),
p AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM c),
v AS (SELECT doc_id, w, n, {places('w', 'n')} AS i FROM d, (SELECT DISTINCT n FROM p) WHERE len(w) >= n),
m AS (SELECT doc_id, i, v.n, item_id FROM v JOIN p ON p.n = v.n AND p.s = array_to_string(w[i:i + v.n - 1], ' ')),
h AS (SELECT doc_id, COUNT(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""

_CUTS = ", ".join(f"({i}, {c!r}e0)" for i, c in enumerate(Q.CUTOFFS))
_LIMIT = f"{Q.ALPHA / len(Q.RULES)!r}e0"
_PARTS = {rule: [part.removeprefix("_") for part in share.split(" / ")] for rule, share in Q.RULES.items()}
_SHARES = ", ".join(f"coalesce({part} * 1e0 / nullif({whole}, 0), 0) AS {rule}" for rule, (part, whole) in _PARTS.items())
_LONG = " UNION ALL ".join(f"SELECT stratum, '{rule}' AS rule, {rule} AS share FROM held" for rule in Q.RULES)
_CHOSEN = ", ".join(f"MIN(cut) FILTER (WHERE rule = '{rule}') AS max_{rule}" for rule in Q.RULES)
_PASSED = " AND ".join(f"coalesce({rule} <= max_{rule}, TRUE)" for rule in Q.RULES)

RULED = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang AS stratum, {WORDS} AS w FROM documents),
v AS (SELECT doc_id, w, {places('w', '5')} AS i FROM d WHERE len(w) >= 5),
g AS (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + 4], ' ')) AS n FROM v),
r AS (SELECT doc_id, COUNT(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest(generate_series(i, i + 4)) AS j FROM g WHERE n > 1) GROUP BY doc_id),
l AS (SELECT doc_id, COUNT(*) AS n_lines, COUNT(*) - COUNT(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
b AS (SELECT doc_id, stratum, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
        len(regexp_extract_all(text, '[A-Z!]')) AS n_loud, coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
      FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {_SHARES} FROM b),
held AS (SELECT * FROM m WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
tested AS (SELECT stratum, rule, step, cut, COUNT(*) FILTER (WHERE share > cut) AS k, COUNT(*) AS n FROM ({_LONG}), (VALUES {_CUTS}) c(step, cut) GROUP BY ALL),
judged AS (SELECT *, k < n * {_LIMIT} AND list_sum(list_transform(generate_series(0, k), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
        + j * ln({_LIMIT}) + (n - j) * ln(1 - {_LIMIT})))) <= {Q.DELTA!r}e0 / ((SELECT COUNT(DISTINCT coalesce(stratum, '')) FROM held) * {len(Q.RULES)}) AS stands FROM tested),
ordered AS (SELECT *, BOOL_AND(stands) OVER (PARTITION BY stratum, rule ORDER BY step) AS standing FROM judged),
chosen AS (SELECT stratum, {_CHOSEN} FROM ordered WHERE standing GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_PASSED} AS kept
FROM m LEFT JOIN chosen ON chosen.stratum IS NOT DISTINCT FROM m.stratum"""

LEXICAL = rf"regexp_extract_all({LOW}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

RANKED = f"""
WITH d AS (SELECT doc_id, {LEXICAL} AS w FROM documents),
g AS (SELECT doc_id, len(w) AS n FROM d WHERE len(w) > 0),
a AS (SELECT COUNT(*) AS n_docs, SUM(n)::BIGINT AS n_terms FROM g),
p AS (SELECT doc_id, t, COUNT(*) AS tf FROM (SELECT doc_id, unnest(w) AS t FROM d) GROUP BY ALL),
q AS (SELECT item_id, t, COUNT(*) AS qf FROM (SELECT item_id, unnest({LEXICAL}) AS t FROM benchmark) GROUP BY ALL),
f AS (SELECT t, COUNT(*) AS df FROM p GROUP BY t),
v AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w FROM f, a WHERE t IN (SELECT t FROM q)),
m AS (SELECT doc_id, 100 - 75 + (75 * n * n_docs) // n_terms AS m FROM g, a),
s AS (SELECT item_id, doc_id, SUM(qf * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM q JOIN v USING (t) JOIN p USING (t) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10"""

MIXED = f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, CAST('0x' || substr(md5('11:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(SUM(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS w, 2 * source_size AS can FROM s),
b AS (SELECT SUM(w)::BIGINT AS w_all, SUM(source_size)::BIGINT * 150 / 100 AS budget FROM w),
o AS (SELECT *, can / w AS rate, (budget - (SUM(can) OVER z - can)::BIGINT) / (w_all - (SUM(w) OVER z - w)::BIGINT) AS level FROM w, b WINDOW z AS (ORDER BY can / w, place)),
l AS (SELECT arg_min(level, (rate, place)) AS shared FROM o WHERE level <= rate),
t AS (SELECT source, source_size, place, CASE WHEN shared IS NULL OR rate < shared THEN CAST(can AS DOUBLE) ELSE w * shared END AS target FROM o, l),
q AS (SELECT d.*, source_size, target, place, SUM(size) OVER (PARTITION BY place ORDER BY h, doc_id, size)::BIGINT AS done FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, (epoch * source_size + done) / target AS finish FROM q, (VALUES (0), (1)) e(epoch)),
g AS (SELECT *, SUM(size) OVER (ORDER BY finish, place, epoch, h, doc_id, size) AS total FROM f)
SELECT doc_id, source, size, source_size, target, CAST(coalesce(SUM(size) FILTER (WHERE total <= budget), 0) AS BIGINT) AS taken FROM g, b GROUP BY ALL"""

MINED = """
WITH r AS (SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a, r b WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS k
      FROM s WHERE same AND anchor_id <> other_id) WHERE k <= 5),
n AS (SELECT p.*, other_id AS negative_id, score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

ORACLES = {"op11_ranking": RANKED, "op12_mixing": MIXED, "op13_negatives": MINED, "op2_quality_rules": RULED, "op3_substring": REPEATS, "op6_warc": ARCHIVE, "op7_decontaminate": CONTAMINATION}
