"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shelfwise.llm import collocations, decontamination, fingerprints, language, licenses, lines, minhash, packing, prefix_trie, quality, token_counts, token_files, tokens, toxicity
from shelfwise.llm.corpus import read
from shelfwise.sources.shared import shared_folder, write_shared

Query = Callable[[SparkSession, str], DataFrame]


def op1_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of each document and of its edited text."""
    return fingerprints.fingerprint_edits(read(spark, sf, "documents"))


def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document that stand in a window of the benchmark."""
    return decontamination.decontaminate(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


def op3_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token totals of two tokenizers, the second's revised from counts of words, after toxic documents were deleted."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    byte, word = (write_shared(token_counts.count_tokens(docs, t), "counts") for t in (tokens.BYTE_BPE, tokens.WORD_BPE))
    counts = [byte, token_counts.count_words(docs, r"\S+", "words")]
    removed = labels.filter("toxic = 1").select("doc_id")
    return token_counts.maintained_totals(spark, f"{shared_folder(spark)}/rollup", counts, removed, {1: word})


def rollup_word_counts(spark: SparkSession, sf: str) -> DataFrame:
    """The same rollup over two kinds of words, which SQL can count too."""
    docs, labels = read(spark, sf, "documents"), read(spark, sf, "labels")
    counts = [token_counts.count_words(docs, r"[^ \n]+", "spaced"), token_counts.count_words(docs, "[A-Za-z]+", "letters")]
    removed = labels.filter("toxic = 1").select("doc_id")
    return token_counts.maintained_totals(spark, f"{shared_folder(spark)}/rollup", counts, removed)


def op4_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as token files and read back."""
    return token_files.token_files_round_trip(read(spark, sf, "documents"))


def op5_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the line that stays for it."""
    return lines.line_classes(read(spark, sf, "documents"))


def op6_language(spark: SparkSession, sf: str) -> DataFrame:
    """The language of each document, learnt from those of two folds in three."""
    return language.identify_languages(read(spark, sf, "documents"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed into sequences of 4,096 ids."""
    return packing.pack(read(spark, sf, "documents"))


def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality scores of documents, learnt from the labels."""
    return quality.quality_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))


def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Components of near-duplicate documents."""
    return minhash.near_duplicates(read(spark, sf, "documents"))


def op10_licenses(spark: SparkSession, sf: str) -> DataFrame:
    """Licence phrases and notices of each document."""
    return licenses.scan_licenses(read(spark, sf, "documents"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(read(spark, sf, "documents"))


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """Nodes of the prefix trie over all conversations."""
    return prefix_trie.conversation_trie(read(spark, sf, "conversations"))


def op13_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity scores of documents, learnt from the labels."""
    return toxicity.toxicity_scores(read(spark, sf, "documents"), read(spark, sf, "labels"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_fingerprints, op2_decontamination, op3_token_counts, op4_token_files, op5_line_dedup, op6_language, op7_packing, op8_quality, op9_near_duplicates, op10_licenses, op11_collocations, op12_prefix_trie, op13_toxicity, rollup_word_counts)}

_OP9 = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w
  FROM documents),
placed AS (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM worded WHERE len(w) > 0),
shingle AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM placed),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k
  FROM shingle x JOIN shingle y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b
  WHERE 100 * k >= 85 * (p.n + q.n - k)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN size USING (doc_id)
"""

_OP5 = r"""
WITH RECURSIVE line AS (
  SELECT doc_id, i - 1 AS line_no, trim(w[i], ' ') AS line
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i
        FROM (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents))
  WHERE trim(w[i], ' ') <> ''),
ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id, line_no) AS place FROM line),
text AS (SELECT line, min(place) AS id FROM ranked GROUP BY line),
shingle AS (
  SELECT DISTINCT id, substring(line, i, 8) AS s
  FROM (SELECT id, line, unnest(generate_series(1, greatest(length(line) - 7, 1))) AS i FROM text)),
size AS (SELECT id, count(*) AS n FROM shingle GROUP BY id),
common AS (
  SELECT x.id AS a, y.id AS b, count(*) AS k FROM shingle x JOIN shingle y ON x.s = y.s AND x.id <> y.id GROUP BY ALL),
link AS (
  SELECT a, b FROM common JOIN size p ON p.id = a JOIN size q ON q.id = b WHERE 100 * k >= 80 * (p.n + q.n - k)),
reach AS (
  SELECT id, id AS other FROM text
  UNION
  SELECT reach.id, link.b FROM reach JOIN link ON link.a = reach.other),
class AS (SELECT id, min(other) AS first FROM reach GROUP BY id)
SELECT r.doc_id, r.line_no, f.doc_id AS class_doc, f.line_no AS class_line,
  r.doc_id = f.doc_id AND r.line_no = f.line_no AS kept
FROM ranked r JOIN text t ON t.line = r.line JOIN class c ON c.id = t.id JOIN ranked f ON f.place = c.first
"""

_OP2 = r"""
WITH doc AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
item_window AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS i
        FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM item_window),
doc_window AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, size WHERE len(w) >= n)),
hit AS (SELECT r, item, i, d.n FROM doc_window d JOIN item_window b ON d.s = b.s AND d.n = b.n),
covered AS (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS at FROM hit),
hits AS (SELECT r, count(*) AS n_hit FROM covered GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hits USING (r) LEFT JOIN items USING (r)
"""

_ROLLUP = r"""
WITH counted AS (
  SELECT doc_id, source, lang, 'spaced' AS tokenizer_version,
    len(regexp_extract_all(coalesce(text, ''), '[^ \n]+')) AS n FROM documents
  UNION ALL
  SELECT doc_id, source, lang, 'letters', len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) FROM documents)
SELECT source, lang, tokenizer_version, count(*) AS documents, CAST(sum(n) AS BIGINT) AS tokens
FROM counted WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
GROUP BY source, lang, tokenizer_version
"""

_OP11 = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS id, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS t
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(t, '[^\x20\x09]+') AS w FROM piece),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
placed AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM worded),
suffix AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM placed),
one AS (SELECT lang, x, count(*) AS f FROM suffix GROUP BY ALL),
two AS (SELECT lang, x, y, count(*) AS f FROM suffix WHERE y IS NOT NULL GROUP BY ALL),
three AS (SELECT lang, x, y, z, count(*) AS f FROM suffix WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
longer AS (
  SELECT lang, x, y, max(f) AS f FROM (SELECT lang, x, y, f FROM three UNION ALL SELECT lang, y, z, f FROM three) GROUP BY ALL),
pairs AS (
  SELECT two.lang, two.x || ' ' || two.y AS phrase, two.f AS a, p.f AS l, q.f AS r,
    1000000::HUGEINT * two.f * two.f // (p.f::HUGEINT * q.f) AS score
  FROM two JOIN one p ON p.lang = two.lang AND p.x = two.x JOIN one q ON q.lang = two.lang AND q.x = two.y
    LEFT JOIN longer ON longer.lang = two.lang AND longer.x = two.x AND longer.y = two.y
  WHERE two.f >= 10 AND coalesce(100 * longer.f < 50 * two.f, true)),
cut AS (
  SELECT t.lang, t.x || ' ' || t.y || ' ' || t.z AS phrase, t.f AS a, p.f AS l1, q.f AS r1, u.f AS l2, v.f AS r2,
    1000000::HUGEINT * t.f * t.f // (p.f::HUGEINT * q.f) AS s1, 1000000::HUGEINT * t.f * t.f // (u.f::HUGEINT * v.f) AS s2
  FROM three t JOIN one p ON p.lang = t.lang AND p.x = t.x JOIN two q ON q.lang = t.lang AND q.x = t.y AND q.y = t.z
    JOIN two u ON u.lang = t.lang AND u.x = t.x AND u.y = t.y JOIN one v ON v.lang = t.lang AND v.x = t.z),
scored AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""

_OP12 = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(e ORDER BY i) AS crc FROM (
    SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), generate_series(1, 8)),
      lambda c, step: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) AS e FROM range(256) r(i))),
turned AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
digest AS (
  SELECT conv_id, turn, md5(concat(length(role), ':', role, text)) AS d, octet_length(encode(text)) AS b FROM turned),
conv AS (
  SELECT conv_id, list({'d': d, 'b': b} ORDER BY turn NULLS FIRST, d) AS t FROM digest GROUP BY conv_id),
hashed AS (
  SELECT conv_id, t, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) % 9 AS h
  FROM conv, crc_table),
rebuilt AS (
  SELECT p.conv_id, list_concat(coalesce(q.t[1:p.h], []), p.t[p.h + 1:]) AS t
  FROM hashed p LEFT JOIN conv q ON q.conv_id = p.conv_id - p.conv_id % 5),
member AS (
  SELECT conv_id, len(t) AS length, depth, array_to_string(list_transform(t[1:depth], lambda x: x.d), ',') AS node,
    if(depth > 0, array_to_string(list_transform(t[1:depth - 1], lambda x: x.d), ','), NULL) AS parent, t[depth].b AS b
  FROM rebuilt, LATERAL (SELECT unnest(generate_series(0, len(t))) AS depth)),
node AS (
  SELECT node, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs,
    if(depth > 0, (count(*) - 1) * any_value(b), 0) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (length = depth), '')) AS ends_sha256
  FROM member GROUP BY node, depth),
child AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n FROM node WHERE parent IS NOT NULL GROUP BY ALL),
whole AS (SELECT node.*, coalesce(n, 0) AS n_children FROM node LEFT JOIN child USING (node, depth)),
above AS (
  SELECT node AS top, depth AS top_depth, node, depth, parent FROM node
  UNION ALL
  SELECT p.node, p.depth, a.node, a.depth, p.parent FROM above a JOIN node p ON p.node = a.parent AND p.depth = a.top_depth - 1),
under AS (
  SELECT top AS node, top_depth AS depth, CAST(count_if(n_children = 0) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM above JOIN whole ON whole.node = above.node AND whole.depth = above.depth GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM whole w JOIN under USING (node, depth) LEFT JOIN node p ON p.node = w.parent AND p.depth = w.depth - 1
"""

ORACLES: dict[str, str] = {"op2_decontamination": _OP2, "op5_line_dedup": _OP5, "op9_near_duplicates": _OP9, "op11_collocations": _OP11, "op12_prefix_trie": _OP12, "rollup_word_counts": _ROLLUP}
