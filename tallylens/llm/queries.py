"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, decontamination, divergence, langid, lmscore, mixing, neardup, neighbours, packing, phrases, sharding, tokencounts, tokenfiles
from .common import table


def op1_token_chat_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    formatted = chat.format_turns(turns.unionByName(chat.forged_conversation(spark)))
    return chat.digest(chat.read_turns(formatted))


def op2_sampled_splitter_shards(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"), 16)


def op3_adaptive_dimension_scan(spark, sf_dir):
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op4_simple8b_token_files(spark, sf_dir):
    return tokenfiles.write_and_read(table(spark, sf_dir, "documents"))


def op5_suffix_array_decontamination(spark, sf_dir):
    found = decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.fillna({"longest_at": -1, "longest_item": "", "longest_item_at": -1})


def op6_segmentation_marginal_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op7_stupid_backoff_trigram_scores(spark, sf_dir):
    scored = lmscore.score_documents(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), "n_backed_off")


def op8_bayesian_minhash_dedup(spark, sf_dir):
    found = neardup.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op9_low_discrepancy_mix(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op10_edit_aware_token_counts(spark, sf_dir):
    return tokencounts.count_edited(table(spark, sf_dir, "documents"))


def op11_source_divergence_audit(spark, sf_dir):
    return divergence.audit(table(spark, sf_dir, "documents"))


def op12_bucketed_phrase_collocations(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents")).drop("cut")


def op13_space_filling_curve_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def queries():
    return {
        f.__name__: f
        for f in (
            op1_token_chat_format,
            op2_sampled_splitter_shards,
            op3_adaptive_dimension_scan,
            op4_simple8b_token_files,
            op5_suffix_array_decontamination,
            op6_segmentation_marginal_language_id,
            op7_stupid_backoff_trigram_scores,
            op8_bayesian_minhash_dedup,
            op9_low_discrepancy_mix,
            op10_edit_aware_token_counts,
            op11_source_divergence_audit,
            op12_bucketed_phrase_collocations,
            op13_space_filling_curve_packing,
        )
    }


#: Every window of an item looked up among all windows of the documents.
_OP5 = """
WITH low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), lengths AS (
  SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM lengths)
), placed AS (
  SELECT DISTINCT item_id, n, q, array_to_string(w[q : q + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS q FROM lengths)
), sizes AS (SELECT DISTINCT n FROM lengths), grams AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM low, sizes WHERE len(w) >= n)
), met AS (SELECT doc_id, i, g.n, item_id FROM grams g JOIN windows USING (n, s)), runs AS (
  -- Windows met at consecutive places of document and item are one match.
  SELECT doc_id, item_id, i - q AS shift, n, i, q, i - row_number() OVER (PARTITION BY doc_id, item_id, i - q, n ORDER BY i) AS run
  FROM (SELECT DISTINCT g.doc_id, g.n, g.i, p.item_id, p.q FROM grams g JOIN placed p USING (n, s))
), matches AS (
  SELECT doc_id, item_id, min(i) - 1 AS doc_at, min(q) - 1 AS item_at, count(*) + any_value(n) - 1 AS length FROM runs GROUP BY doc_id, item_id, shift, n, run
), longest AS (
  SELECT doc_id, length AS longest, doc_at AS longest_at, CAST(item_id AS VARCHAR) AS longest_item, item_at AS longest_item_at FROM matches
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length DESC, doc_at, CAST(item_id AS VARCHAR), item_at) = 1
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY 1
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM met) GROUP BY 1
)
"""


_OP5 += """
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(longest, 0) AS longest, coalesce(longest_at, -1) AS longest_at, coalesce(longest_item, '') AS longest_item, coalesce(longest_item_at, -1) AS longest_item_at
FROM low LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN longest USING (doc_id)
"""


#: The template's marks are 3 + 6 + 7 + 4 characters a turn; each control string in a text adds one.
_OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, 20 + length(role) + length(text) + len(regexp_extract_all(role || chr(10) || text, '<\\*s>|\[\\*INST\]|\[\\*/INST\]|<\\*/s>|<\\*\|endoftext\|>')) AS shown FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


#: Pairs that share a shingle, exactly; then the least id reachable.
_OP8 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT DISTINCT doc_id, hash(array_to_string(w[i : i + 4], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""


#: Counts of all other documents: totals less the document's own; order 3.
_OP7 = """
WITH texts AS (
  SELECT doc_id, row_number() OVER () AS d, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
  SELECT d, i, w[i] AS w, CASE WHEN i > 1 THEN w[i - 1] END AS p, CASE WHEN i > 2 THEN w[i - 2] END AS o FROM (SELECT d, w, unnest(range(1, len(w) + 1)) AS i FROM texts)
), own1 AS (SELECT d, w, count(*) AS c FROM places GROUP BY ALL), own2 AS (
  SELECT d, p, w, count(*) AS c FROM places WHERE p IS NOT NULL GROUP BY ALL
), own3 AS (SELECT d, o, p, w, count(*) AS c FROM places WHERE o IS NOT NULL GROUP BY ALL),
all1 AS (SELECT w, sum(c) AS c FROM own1 GROUP BY ALL), all2 AS (SELECT p, w, sum(c) AS c FROM own2 GROUP BY ALL), all3 AS (SELECT o, p, w, sum(c) AS c FROM own3 GROUP BY ALL),
rest1 AS (SELECT d, w, a.c - x.c AS c FROM own1 x JOIN all1 a USING (w)),
rest2 AS (SELECT d, p, w, a.c - x.c AS c FROM own2 x JOIN all2 a USING (p, w)),
rest3 AS (SELECT d, o, p, w, a.c - x.c AS c FROM own3 x JOIN all3 a USING (o, p, w)),
sizes AS (SELECT doc_id, d, len(w) AS n_words, (SELECT count(*) FROM places) AS total FROM texts),
met AS (
  SELECT x.d, x.p, x.o, s.total - s.n_words AS size, u.c AS c1, b.c AS c2, t.c AS c3, q.c AS q1, r.c AS q2
  FROM places x JOIN sizes s ON s.d = x.d JOIN rest1 u ON u.d = x.d AND u.w = x.w
  LEFT JOIN rest2 b ON b.d = x.d AND b.p = x.p AND b.w = x.w LEFT JOIN rest3 t ON t.d = x.d AND t.o = x.o AND t.p = x.p AND t.w = x.w
  LEFT JOIN rest1 q ON q.d = x.d AND q.w = x.p LEFT JOIN rest2 r ON r.d = x.d AND r.p = x.o AND r.w = x.p
), scored AS (
  SELECT d, CASE
      WHEN c3 > 0 THEN ln(c3 / q2)
      WHEN c2 > 0 THEN (CASE WHEN o IS NULL THEN 0 ELSE ln(0.4) END) + ln(c2 / q1)
      ELSE (CASE WHEN p IS NULL THEN 0 WHEN o IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END) + CASE WHEN c1 > 0 THEN ln(c1 / size) ELSE ln(0.4 / greatest(1, size)) END END AS l,
    CASE WHEN c3 > 0 OR (o IS NULL AND c2 > 0) OR (p IS NULL AND c1 > 0) THEN 0 ELSE 1 END AS back
  FROM met
)
SELECT doc_id, n_words, round(coalesce(sum(l), 0), 4) AS log_score, CAST(coalesce(sum(back), 0) AS BIGINT) AS n_backed_off
FROM sizes LEFT JOIN scored USING (d) GROUP BY doc_id, d, n_words
"""


#: Every kept term beside every group of its language.
_OP11 = """
WITH docs AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS d,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents
), groups AS (SELECT DISTINCT lang, source FROM docs), occ AS (SELECT lang, source, d, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS total FROM occ GROUP BY 1, 2 HAVING count(DISTINCT d) >= 10),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM occ GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1), cells AS (
  SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), whole AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY 1, 2), shares AS (
  SELECT c.lang, c.source, c.term, c.n, CAST(1 + (1000000000 * (c.n + 2)) // (w.n + 2 * s.v) AS HUGEINT) AS p, CAST(1 + (1000000000 * (c.total + 2)) // (s.n + 2 * s.v) AS HUGEINT) AS q
  FROM cells c JOIN whole w ON w.lang = c.lang AND w.source = c.source JOIN sizes s ON s.lang = c.lang
), met AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS f
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN met ON met.lang = a.lang AND met.source = a.source AND met.item = b.source
), terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) QUALIFY part = 'pair' OR rank <= 10
"""


#: All n-grams counted whole, every longer candidate looked into.
_OP12 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY 1), starts AS (
  SELECT lang, w[i : i + 4] AS w FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), grams AS (
  SELECT lang, k, w[1:k] AS w, CAST(count(*) AS HUGEINT) AS f FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS k FROM starts) GROUP BY ALL HAVING count(*) >= 100
), cuts AS (SELECT lang, k, w, f AS a, unnest(range(1, k)) AS cut FROM grams WHERE k > 1), scored AS (
  SELECT c.lang, c.k, c.w, c.a, c.cut, x.f AS l, y.f AS r, n, (1000 * c.a * n) // (x.f * y.f) AS score
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.w = c.w[1 : cut] JOIN grams y ON y.lang = c.lang AND y.w = c.w[cut + 1 : c.k] JOIN sizes s ON s.lang = c.lang
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, cut) = 1), within AS (
  SELECT DISTINCT lang, w[i : i + k - 1] AS w, f FROM (
    SELECT lang, f, w, n, k, unnest(range(1, n - k + 2)) AS i FROM (SELECT lang, f, w, k AS n, unnest(range(2, k)) AS k FROM grams WHERE k > 2))
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(w, ' ')) AS rank, array_to_string(w, ' ') AS phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM best b WHERE NOT EXISTS (SELECT 1 FROM within x WHERE x.lang = b.lang AND x.w = b.w AND 100 * x.f >= 100 * b.a)
QUALIFY rank <= 2000
"""


def oracle_sql():
    return {"op12_bucketed_phrase_collocations": _OP12, "op11_source_divergence_audit": _OP11, "op1_token_chat_format": _OP1, "op5_suffix_array_decontamination": _OP5, "op7_stupid_backoff_trigram_scores": _OP7, "op8_bayesian_minhash_dedup": _OP8}
