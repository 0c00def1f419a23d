"""The numbered queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from planar.llm import chat, decontamination, lines, lm, mixing, negatives, phrases, quality, rules, simhash, suffixes, token_files, toxicity
from planar.llm.common import stored, table

MIX_SQL = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, doc_id, source, md5(coalesce(text, '')) AS tie,
  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2e0 * source_size AS top, CASE (row_number() OVER (ORDER BY source NULLS LAST)) % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight,
  row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
l AS (SELECT *, row_number() OVER f AS place,
  (1.5e0 * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(top) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0e0))
  / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER (ORDER BY top / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS lv
  FROM w WINDOW f AS (ORDER BY top / weight, rank)),
o AS (SELECT *, (SELECT arg_min(lv, place) FROM l WHERE top > weight * lv) AS level FROM l),
t AS (SELECT source, coalesce('s' || source, 'n') AS key, source_size, CASE WHEN level IS NULL THEN top ELSE least(weight * level, top) END AS target,
  greatest(1, ceil(source_size / 262144))::BIGINT AS streams FROM o),
f AS (SELECT d.*, t.key, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'none') || '/' || tie), 1, 8))::BIGINT % streams AS stream
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source WHERE size > 0),
g AS (SELECT key, stream, ceil(sum(size) / 64)::BIGINT AS blocks FROM f GROUP BY key, stream),
h AS (SELECT *, sum(blocks) OVER (PARTITION BY key ORDER BY stream) - blocks AS base FROM g),
n AS (SELECT t.key, b.blocks, least(floor(target * b.blocks / source_size + 0.5e0), b.blocks * 2)::BIGINT AS slots
  FROM t JOIN (SELECT key, sum(blocks)::BIGINT AS blocks FROM g GROUP BY key) b USING (key)),
p AS (SELECT key, slots - pass * blocks AS reach, pass, unnest(range(blocks)) AS block FROM (SELECT *, unnest([0, 1]) AS pass FROM n)),
q AS (SELECT key, block, reach, row_number() OVER (PARTITION BY key, pass ORDER BY ('0x' || substr(md5(key || '/1/' || pass || '/' || block), 1, 8))::BIGINT, block) AS place FROM p WHERE reach > 0),
k AS (SELECT key, block, count(*) AS times FROM q WHERE place <= reach GROUP BY ALL),
y AS (SELECT f.r, f.key, f.size, h.base, sum(size) OVER (PARTITION BY f.key, f.stream ORDER BY doc_id, r ROWS UNBOUNDED PRECEDING) - size AS s0 FROM f JOIN h ON f.key = h.key AND f.stream = h.stream),
e AS (SELECT r, key, base, s0, size, unnest(range((s0 // 64)::BIGINT, ((s0 + size - 1) // 64)::BIGINT + 1)) AS b0 FROM y),
v AS (SELECT e.r, sum((least(s0 + size, (b0 + 1) * 64) - greatest(s0, b0 * 64)) * times)::BIGINT AS taken FROM e JOIN k ON e.key = k.key AND k.block = e.base + e.b0 GROUP BY e.r)
SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(v.taken, 0)::BIGINT AS taken
FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN v USING (r)
"""

#: The driver's conversations have some hundred words each: budgets under which windows, history and masks act on them.
CHAT_BUDGET, CHAT_HISTORY = 256, 64
CHAT_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
  SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 4 AS tokens,
  length(text) + (length(text) - length(replace(text, '\', ''))) + len(regexp_extract_all(text, '<\||</s>|\[INST\]|\[/INST\]')) AS body,
  length(role) + len(regexp_extract_all(role, '\||\\|</s>|\[INST\]|\[/INST\]')) + 8 AS around FROM c),
o AS (SELECT *, row_number() OVER w - 1 AS ordinal, sum(tokens) OVER w - tokens AS s0 FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, ordinal = 0 AND role = 'system' AS sys FROM o),
k AS (SELECT conv_id, coalesce(sum(tokens) FILTER (sys), 0) AS st, coalesce(max(tokens) FILTER (NOT sys), 0) AS longest FROM s GROUP BY conv_id),
m AS (SELECT *, greatest(1, greatest(0, 256 - st) - least(64, greatest(0, 256 - st) // 2)) AS room FROM k),
p AS (SELECT s.*, st, CASE WHEN sys THEN 0 ELSE s0 - st END AS start, greatest(1, room - least(longest, room // 2)) AS step, NOT sys AND tokens > room // 2 AS big FROM s JOIN m ON s.conv_id IS NOT DISTINCT FROM m.conv_id),
q AS (SELECT *, start // step AS cell, 2 * (sum(big::INT) OVER (PARTITION BY conv_id, start // step ORDER BY ordinal) - big::INT) + big::INT AS part0 FROM p),
r AS (SELECT *, CASE WHEN sys THEN coalesce(lead(part0) OVER (PARTITION BY conv_id, cell ORDER BY ordinal), 0) ELSE part0 END AS part FROM q),
v AS (SELECT conv_id, cell, part, min(ordinal) AS win, min(start) FILTER (NOT sys) AS b0, bool_or(sys) AS has, greatest(0, least(64, 256 - any_value(st) - coalesce(sum(tokens) FILTER (NOT sys), 0))) AS allowed FROM r GROUP BY conv_id, cell, part),
h AS (SELECT r.conv_id, sum(body + around) AS chars FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.conv_id WHERE NOT sys AND ordinal < win AND b0 - start <= allowed GROUP BY r.conv_id),
y AS (SELECT r.conv_id, sum(body + around) AS chars FROM r JOIN v ON r.conv_id IS NOT DISTINCT FROM v.conv_id WHERE sys AND NOT has GROUP BY r.conv_id),
g AS (SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ordinal)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY ordinal) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(body + around) AS chars FROM p GROUP BY conv_id),
n AS (SELECT conv_id, count(*)::BIGINT AS n_windows FROM v GROUP BY conv_id)
SELECT g.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, (g.chars + coalesce(h.chars, 0) + coalesce(y.chars, 0))::BIGINT AS formatted_chars, n_windows
FROM g JOIN n ON g.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN h ON g.conv_id IS NOT DISTINCT FROM h.conv_id LEFT JOIN y ON g.conv_id IS NOT DISTINCT FROM y.conv_id
"""

LEDGER_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
u AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i, len(w) AS total FROM d WHERE len(w) >= 8),
b AS (SELECT doc_id, i, total, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS gram FROM u),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM b WHERE i <= total - 7),
r AS (SELECT doc_id, count(DISTINCT i + k)::BIGINT AS n_repeat_words FROM g, range(8) AS t(k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines
  FROM d LEFT JOIN r USING (doc_id)),
f AS (SELECT *, ((n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 2 * n_words)::INT + 8 * (n_lines >= 5 AND 10 * n_dup_lines > 3 * n_lines)::INT
  + 16 * (word_chars < 2 * n_words)::INT + 32 * (word_chars > 30 * n_words)::INT)::INT AS failed FROM m)
"""
RULES_SQL = LEDGER_SQL + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f"
ABLATION_SQL = LEDGER_SQL + "".join(
    ("" if k == 0 else " UNION ALL ") + f"SELECT '{name}' AS rule, count(*) FILTER (failed & {1 << k} <> 0) AS fails, count(*) FILTER (failed = {1 << k}) AS only FROM f"
    for k, (name, _) in enumerate(rules.RULES)
)

LINES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
u AS (SELECT r, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM u),
h AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
g AS (SELECT r, count(*) AS n, count(*) FILTER (key IN (SELECT key FROM h)) AS gone, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM h)), '') AS kept FROM k GROUP BY r)
SELECT doc_id, n::BIGINT AS n_lines, gone::BIGINT AS n_dropped, sha256(kept) AS kept_sha256 FROM d JOIN g USING (r)
"""

NEGATIVES_SQL = r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, list_dot_product(a.v, e.v)::BIGINT AS score
  FROM e AS a JOIN e ON a.vec_id <> e.vec_id AND len(a.v) = len(e.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""

PHRASES_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT row_number() OVER () AS piece, * FROM (SELECT lang, unnest(string_split_regex(text, '[.,;:!?
-]')) AS part FROM d)),
l AS (SELECT piece, lang, regexp_extract_all(part, '[^ 	]+') AS w FROM p),
g AS (SELECT lang, x.k AS size, list_slice(w, x.i, x.i + x.k - 1) AS phrase, count(*) AS f
  FROM (SELECT *, unnest(flatten([[{'k': k, 'i': i} for i in range(1, len(w) - k + 2)] for k in range(1, 5)])) AS x FROM l) GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM g WHERE size = 1 GROUP BY lang),
f AS (SELECT * FROM g WHERE f >= 30),
c AS (SELECT lang, phrase, f AS a, size, unnest(range(1, size)) AS k FROM f WHERE size > 1),
s AS (SELECT c.*, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = c.phrase[1:k] JOIN f AS r ON r.lang = c.lang AND r.phrase = c.phrase[k + 1:]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, list_slice(phrase, x.i, x.i + x.k - 1) AS phrase, max(f) AS around
  FROM (SELECT *, unnest(flatten([[{'k': k, 'i': i} for i in range(1, size - k + 2)] for k in range(2, size)])) AS x FROM f WHERE size > 2) GROUP BY ALL),
t AS (SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN o USING (lang, phrase) WHERE around IS NULL OR 100 * around::HUGEINT < 80 * a::HUGEINT)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM t JOIN n USING (lang) QUALIFY rank <= 2000
"""


def op3_lm_scores(spark, sf_dir):
    return lm.scores(table(spark, sf_dir, "documents"))


def op4_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.read_back(stored(chat.windows(rows.unionByName(own), CHAT_BUDGET, CHAT_HISTORY), "chat"))


def op1_toxicity(spark, sf_dir):
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_quality_classifier(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark, sf_dir):
    return suffixes.removal(table(spark, sf_dir, "documents"))


def op6_token_files(spark, sf_dir):
    return token_files.token_files(table(spark, sf_dir, "documents"))


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark, sf_dir):
    entries = rules.ledger(table(spark, sf_dir, "documents"))
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "failed", (~rules.passes(1)).alias("base_failed"), rules.passes().alias("kept"))


def quality_rule_ablations(spark, sf_dir):
    """What each rule of the current policy rejects, and what only it rejects, from the ledger's masks."""
    return rules.ablations(rules.ledger(table(spark, sf_dir, "documents")))


def op10_source_mixing(spark, sf_dir):
    return mixing.taken(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return lines.digests(docs, lines.keep_bitmaps(docs))


def op12_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, moved)


def op13_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_lm_scores": op3_lm_scores,
    "op4_chat_format": op4_chat_format,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_token_files": op6_token_files,
    "op7_decontamination": op7_decontamination,
    "op8_simhash": op8_simhash,
    "op9_quality_rules": op9_quality_rules,
    "quality_rule_ablations": quality_rule_ablations,
    "op10_source_mixing": op10_source_mixing,
    "op11_line_dedup": op11_line_dedup,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

ORACLES = {
    "op4_chat_format": CHAT_SQL,
    "op9_quality_rules": RULES_SQL,
    "quality_rule_ablations": ABLATION_SQL,
    "op10_source_mixing": MIX_SQL,
    "op11_line_dedup": LINES_SQL,
    "op12_hard_negatives": NEGATIVES_SQL,
    "op13_collocations": PHRASES_SQL,
}
