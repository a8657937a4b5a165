"""DuckDB SQL with the results of the registered queries, where SQL can express them."""

_WORDS = r"""
words AS (
  SELECT doc_id, t.i AS pos, t.w AS word
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents) d,
       LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) t
)"""

OP1 = f"""
WITH {_WORDS},
windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)
),
firsts AS (SELECT seq, min(doc_id) AS first_doc FROM windows WHERE n = 13 GROUP BY seq),
late AS (SELECT w.doc_id, w.pos FROM windows w JOIN firsts f ON w.seq = f.seq AND f.first_doc < w.doc_id WHERE w.n = 13),
gone AS (SELECT DISTINCT l.doc_id, l.pos + k.k AS pos FROM late l, (SELECT unnest(range(13)) AS k) k),
kept AS (
  SELECT w.doc_id, count(*) AS n_words, count(g.pos) AS n_removed,
         coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL), '') AS txt
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.pos = g.pos GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(txt, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3 = rf"""
WITH words AS (
  SELECT doc_id, t.i AS pos, t.w AS word
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}') AS ws FROM documents) d,
       LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) t
),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}') AS ws FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, array_to_string(ws[k.k : k.k + 9], ' ') AS seq, least(len(ws), 10) AS n
  FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k) k WHERE len(ws) > 0
),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (
  SELECT a.doc_id, a.pos, l.n, string_agg(b.word, ' ' ORDER BY b.pos) AS seq
  FROM words a CROSS JOIN lengths l JOIN words b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + l.n - 1
  GROUP BY a.doc_id, a.pos, l.n HAVING count(*) = l.n
),
found AS (SELECT d.doc_id, d.pos, d.n, i.item_id FROM doc_windows d JOIN item_windows i ON d.n = i.n AND d.seq = i.seq),
hit AS (SELECT doc_id, count(DISTINCT pos + k.k) AS n_hit FROM found, LATERAL (SELECT unnest(range(n)) AS k) k GROUP BY doc_id),
leaks AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) f GROUP BY doc_id
),
sizes AS (SELECT doc_id, count(*) AS n_words FROM words GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN hit h ON d.doc_id = h.doc_id LEFT JOIN leaks l ON d.doc_id = l.doc_id
"""

OP4 = rf"""
WITH lines AS (
  SELECT doc_id, t.i AS pos, t.line, translate(trim(t.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
       LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) t
),
frequent AS (SELECT key FROM lines WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.key IS NULL), '') AS kept_text, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(f.key) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM lines l LEFT JOIN frequent f ON l.key = f.key GROUP BY l.doc_id
"""


def _drawn(what: str, value: str) -> str:
    return f"CAST('0x' || substr(md5('{what}:17:' || CAST({value} AS VARCHAR)), 1, 8) AS BIGINT)"


OP8 = rf"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM sized GROUP BY source
),
weighed AS (
  SELECT *, CAST(CASE place % 3 WHEN 1 THEN 5 WHEN 2 THEN 2 ELSE 1 END AS DOUBLE) AS weight, CAST(2 * source_size AS DOUBLE) AS most FROM sources
),
levels AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(most) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
  FROM weighed WINDOW b AS (ORDER BY most / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
fill AS (SELECT level FROM levels WHERE most > weight * level ORDER BY most / weight, level LIMIT 1),
aims AS (SELECT source, source_size, docs, least(most, coalesce(weight * (SELECT level FROM fill), most)) AS target FROM levels),
blocks AS (SELECT CAST(floor(sum(target) / 32 + CAST(0.5 AS DOUBLE)) AS BIGINT) AS n FROM aims),
seats AS (
  SELECT source, k, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, source IS NULL, source, k) AS place
  FROM aims, LATERAL (SELECT unnest(range(1, CAST((SELECT n FROM blocks) + 1 AS BIGINT))) AS k) q WHERE target > 0
),
won AS (SELECT source, count(*) AS blocks FROM seats WHERE place <= (SELECT n FROM blocks) GROUP BY source),
placed AS (
  SELECT s.doc_id, s.source, s.size, a.source_size, a.target, coalesce(w.blocks, 0) AS blocks, {_drawn("shard", "coalesce(s.doc_id, -1)")} % CAST(least(ceil(a.docs / 1024.0), 65536) AS BIGINT) AS shard
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN won w ON s.source IS NOT DISTINCT FROM w.source
),
parts AS (SELECT source, shard, CAST(sum(size) AS BIGINT) AS words, min(blocks) AS blocks FROM placed GROUP BY source, shard),
part_seats AS (
  SELECT source, shard, blocks, row_number() OVER (PARTITION BY source ORDER BY CAST(words AS DOUBLE) / (2 * k - 1) DESC, shard, k) AS place
  FROM parts, LATERAL (SELECT unnest(range(1, blocks + 1)) AS k) q WHERE words > 0
),
part_won AS (SELECT source, shard, count(*) AS quota FROM part_seats WHERE place <= blocks GROUP BY source, shard),
stream AS (
  SELECT p.*, least(coalesce(w.quota, 0), 2 * CAST(ceil(q.words / 32.0) AS BIGINT)) AS quota, CAST(ceil(q.words / 32.0) AS BIGINT) AS n,
         CAST(sum(size) OVER (PARTITION BY p.source, p.shard ORDER BY {_drawn("order", "p.doc_id")}, p.doc_id, p.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS last
  FROM placed p JOIN parts q ON p.source IS NOT DISTINCT FROM q.source AND p.shard = q.shard
  LEFT JOIN part_won w ON p.source IS NOT DISTINCT FROM w.source AND p.shard = w.shard
),
dealt AS (
  SELECT *, CASE WHEN n > 0 THEN quota // n ELSE 0 END AS once, CASE WHEN n > 0 THEN quota % n ELSE 0 END AS rest, CASE WHEN n > 0 THEN {_drawn("offset", "shard")} % n ELSE 0 END AS off FROM stream
),
edges AS (
  SELECT *, CASE WHEN n > 0 THEN 32 * ((last // 32 * rest + off) // n) + last % 32 * (((last // 32 + 1) * rest + off) // n - (last // 32 * rest + off) // n) ELSE 0 END AS upto,
    CASE WHEN n > 0 THEN 32 * (((last - size) // 32 * rest + off) // n) + (last - size) % 32 * ((((last - size) // 32 + 1) * rest + off) // n - ((last - size) // 32 * rest + off) // n) ELSE 0 END AS before
  FROM dealt
)
SELECT doc_id, size, source_size, target, CAST(size * once + upto - before AS BIGINT) AS taken FROM edges
"""


_SHARES = "[900, 700, 500, 400, 300, 200, 150, 100, 80, 60, 40, 30, 20, 10, 5, 0]"
_LENGTHS = "[40000, 30000, 20000, 15000, 12000, 10000, 9000, 8000, 7000, 6000]"


def _permille(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN {a} * 1000 // {b} ELSE 0 END"


_VALUES = {"symbols": _permille("n_symbols", "word_chars"), "duplicate_lines": _permille("n_dup_lines", "n_lines"), "repeated_words": _permille("n_repeat_words", "n_words"), "exclamations": _permille("n_exclaims", "word_chars"), "word_length": _permille("word_chars", "n_words")}

OP6 = rf"""
WITH {_WORDS.strip()},
windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
),
twice AS (SELECT doc_id, pos FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, seq) AS times FROM windows WHERE n = 5) WHERE times > 1),
repeated AS (SELECT doc_id, count(DISTINCT pos + k.k) AS n FROM twice, (SELECT unnest(range(5)) AS k) k GROUP BY doc_id),
sizes AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars FROM words GROUP BY doc_id),
texts AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
counts AS (
  SELECT t.doc_id, CAST(coalesce(s.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(s.word_chars, 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclaims
  FROM texts t LEFT JOIN sizes s ON t.doc_id = s.doc_id LEFT JOIN repeated r ON t.doc_id = r.doc_id
),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
         CASE WHEN n_words < 100 THEN 0 WHEN n_words < 400 THEN 1 WHEN n_words < 1600 THEN 2 ELSE 3 END AS stratum FROM counts
),
rules AS ({" UNION ALL ".join(f"SELECT doc_id, stratum, base_failed, '{n}' AS rule, {v} AS value, {_LENGTHS if n == 'word_length' else _SHARES} AS grid FROM judged" for n, v in _VALUES.items())}),
held AS (
  SELECT stratum, rule, g.i AS step, g.cutoff, count(*) AS n, count(*) FILTER (WHERE value > g.cutoff) AS k
  FROM rules, LATERAL (SELECT unnest(grid) AS cutoff, generate_subscripts(grid, 1) AS i) g
  WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL
),
tails AS (
  SELECT stratum, rule, step, cutoff, n, k, CASE WHEN k >= n * 0.01 THEN 1 ELSE
    list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(CAST(0.01 AS DOUBLE)) + (n - i) * ln(CAST(0.99 AS DOUBLE))))) END AS tail
  FROM held
),
walk AS (SELECT *, max(CASE WHEN tail <= 0.05 / 20 THEN 0 ELSE 1 END) OVER (PARTITION BY stratum, rule ORDER BY step) AS failed FROM tails),
cutoffs AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM walk WHERE failed = 0 GROUP BY stratum, rule),
rejected AS (SELECT DISTINCT r.doc_id FROM rules r JOIN cutoffs c ON r.stratum = c.stratum AND r.rule = c.rule AND r.value > c.cutoff)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.doc_id IS NULL AS kept
FROM judged j LEFT JOIN rejected r ON j.doc_id = r.doc_id
"""


OP9 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, t.i AS pos, t.w AS word, len(ws) AS n
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents) d,
       LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i) t
),
windows AS (
  SELECT doc_id, pos, string_agg(word, ' ') OVER w AS seq, count(*) OVER w AS size, n
  FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)
),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, seq FROM windows WHERE size = 5 OR (n < 5 AND pos = 1)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.seq = b.seq AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS MATERIALIZED (
  SELECT a, b FROM common c JOIN sizes x ON c.a = x.doc_id JOIN sizes y ON c.b = y.doc_id WHERE 100 * k >= 80 * (x.n + y.n - k)
),
reach(node, seen) AS (SELECT DISTINCT a, a FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON r.seen = l.a),
smallest AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component, d.doc_id) AS component_id
FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id LEFT JOIN smallest m ON d.doc_id = m.node
"""


def _over(table: str, sql: str) -> str:
    """A query's SQL with ``table`` in the place of documents."""
    head, rest = ("WITH RECURSIVE", sql.strip()[14:]) if sql.strip().startswith("WITH RECURSIVE") else ("WITH", sql.strip()[4:])
    return f"({head} documents AS (SELECT * FROM {table}), {rest})"


PIPELINE = f"""
WITH good AS MATERIALIZED (SELECT d.* FROM documents d JOIN ({OP6}) r ON d.doc_id = r.doc_id WHERE r.kept),
lines_out AS MATERIALIZED (
  SELECT d.doc_id, r.kept_text AS text, d.lang, d.source, CAST(length(r.kept_text) AS BIGINT) AS n_chars
  FROM good d JOIN {_over("good", OP4)} r ON d.doc_id = r.doc_id
),
apart AS MATERIALIZED (SELECT d.* FROM lines_out d JOIN {_over("lines_out", OP9)} r ON d.doc_id = r.doc_id WHERE r.component_id = d.doc_id),
clean AS MATERIALIZED (SELECT d.* FROM apart d JOIN {_over("apart", OP3)} r ON d.doc_id = r.doc_id WHERE NOT r.contaminated)
SELECT d.doc_id, d.source, r.size, r.source_size, r.target, r.taken FROM clean d JOIN {_over("clean", OP8)} r ON d.doc_id = r.doc_id
"""


OP12 = r"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '(?s)[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents
),
drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM units
),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
),
parts AS (
  SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:n], '') AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM parts
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": OP1, "op3_decontamination": OP3, "op4_line_dedup": f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({OP4})", "op6_quality_rules": OP6, "op8_source_mixing": OP8, "op9_ngram_jaccard": OP9, "op12_fill_in_middle": OP12}
