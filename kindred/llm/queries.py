"""Registered queries of the subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chats, decontam, divergence, jaccard, langid, linededup, merkle, packing, quality, substring, suffixlm, urlfilter
from .spark import written

#: Bytes A-Z to a-z and the words of the contracts, in DuckDB.
_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    predicted = langid.predict_languages(docs, langid.fit_languages(docs.where(~quality.held_out())))
    return predicted.select("doc_id", quality.held_out().alias("held_out"), "lang_pred", "score")


#: The rules of the contract.
URL_RULES = [
    urlfilter.site_rule("com/", "allow"),
    urlfilter.site_rule("example.com/en/", "block"),
    urlfilter.site_rule("www.example.com/en/", "allow"),
    urlfilter.site_rule("net/es/", "block"),
    urlfilter.site_rule("net/fr/", "block"),
]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixlm.score_texts(_table(spark, sf_dir, "documents"), contexts=(1, 2, 3))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.benchmark_overlap(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs.where(~quality.held_out()), _table(spark, sf_dir, "labels"))
    scored = quality.score_quality(docs, model)
    return scored.select(
        "doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_report(_table(spark, sf_dir, "documents"))


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select(*own.columns).unionByName(own)
    return chats.digests(written(chats.format_chats(turns)))


#: What a row's digest is made of, in this order.
MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = merkle.leaf(MANIFEST_COLUMNS, {"text": F.translate("text", _UPPER, _SMALL)})
    manifest = merkle.build(docs, MANIFEST_COLUMNS, kept={"tampered": F.when(tampered, lower)})
    out = manifest.proofs("doc_id", "tampered")
    out = out.withColumn("folded_root", merkle.fold(F.coalesce("tampered", "leaf"), F.col("proof")))
    proof = merkle.siblings(F.col("proof")).alias("proof_sha256")
    return out.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


_OP4 = r"""
WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM b)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(^|[^0-9A-Za-z])(spam|casino|porn|xxx|viagra|malware|phishing|torrent|warez|adserver)([^0-9A-Za-z]|$)') THEN 'block'
  ELSE 'allow' END AS verdict FROM c"""

_OP7 = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(8, len(w)) AS m, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') AS key
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
sizes AS (SELECT DISTINCT m FROM win),
dwin AS (
  SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS key
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, sizes WHERE len(w) >= m)),
hit AS (SELECT r, i, dwin.m, item FROM dwin JOIN win USING (m, key)),
covered AS (SELECT r, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT r, i, m, unnest(range(0, m)) AS k FROM hit) GROUP BY r),
who AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (r) LEFT JOIN who USING (r)"""

_OP1 = f"""
WITH RECURSIVE doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format('text')} AS w FROM documents),
gram AS (
  SELECT DISTINCT r, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT r, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
sig AS (SELECT r, sha256(string_agg(g, chr(10) ORDER BY g)) AS s, count(*) AS n FROM gram GROUP BY r),
class AS (SELECT s, n, min(doc_id) AS rep, count(*) AS n_copies, min(r) AS r FROM sig JOIN doc USING (r) GROUP BY s, n),
cg AS (SELECT s, n, g FROM class JOIN gram USING (r)),
link AS (
  SELECT a.s AS a, b.s AS b FROM cg a JOIN cg b ON a.g = b.g AND a.s <> b.s AND 5 * a.n >= 4 * b.n AND 5 * b.n >= 4 * a.n
  GROUP BY a.s, b.s, a.n, b.n HAVING 9 * count(*) >= 4 * (a.n + b.n)),
reach(a, b) AS (SELECT s, s FROM class UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
root AS (SELECT a AS s, min(rep) AS class_id FROM reach JOIN class ON reach.b = class.s GROUP BY a),
degree AS (SELECT a AS s, count(*) AS n_links FROM link GROUP BY a)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies, coalesce(n_links, 0) AS n_links
FROM doc LEFT JOIN sig USING (r) LEFT JOIN class USING (s) LEFT JOIN root USING (s) LEFT JOIN degree USING (s)"""

_OP9 = r"""
WITH parts AS (
  SELECT row(doc_id IS NULL, coalesce(doc_id, 0), coalesce(CAST('0x' || left(md5(text), 15) AS BIGINT), -1)) AS doc,
    doc_id, string_split(text, chr(10)) AS p FROM documents),
l AS (SELECT doc, i AS line, p[i + 1] AS x FROM (SELECT doc, p, unnest(range(0, len(p))) AS i FROM (SELECT DISTINCT doc, p FROM parts))),
dark AS (SELECT * FROM l WHERE regexp_matches(x, '[^\x09-\x0D\x20\xA0]')),
d AS (SELECT x, min(row(doc, line)) AS first FROM dark GROUP BY x),
f AS (SELECT x, first, length(x) AS n FROM d WHERE length(x) >= 20),
k AS (
  SELECT x, first, n, unnest([n || '|0|' || left(x, n // 2), n || '|1|' || right(x, n - n // 2),
    (n - 1) || '|0|' || left(x, (n - 1) // 2), (n - 1) || '|1|' || right(x, n - 1 - (n - 1) // 2)]) AS key FROM f),
c AS (SELECT DISTINCT a.x, a.first, a.n, b.x AS y, b.n AS m FROM k a JOIN k b ON a.key = b.key AND b.first < a.first AND abs(a.n - b.n) <= 1),
s AS (SELECT first, CASE WHEN n <= m THEN x ELSE y END AS s, CASE WHEN n <= m THEN y ELSE x END AS t FROM c),
e AS (SELECT first, s, t, coalesce(list_min(list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> substr(t, i, 1))), length(s) + 1) AS p FROM s),
near AS (SELECT DISTINCT first FROM e WHERE substr(t, p + 1) = CASE WHEN length(s) = length(t) THEN substr(s, p + 1) ELSE substr(s, p) END),
gone AS (
  SELECT doc, line FROM dark JOIN d USING (x) WHERE row(doc, line) > d.first
  UNION SELECT first[1] AS doc, first[2] AS line FROM near),
by_doc AS (SELECT doc, count(*) AS n, string_agg(line, ',' ORDER BY line) AS dropped FROM gone GROUP BY doc)
SELECT doc_id, CAST(coalesce(len(p), 0) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_dropped, coalesce(dropped, '') AS dropped_lines
FROM parts LEFT JOIN by_doc USING (doc)"""


_OP11 = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
tok AS (SELECT r, lang, source, unnest(w) AS term FROM doc),
kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM doc),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
total AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY ALL),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c, 0) + 1)) // (n + v) AS p
  FROM grp g JOIN kept k USING (lang) JOIN size USING (lang) JOIN total USING (lang, source) LEFT JOIN cnt ON g.lang = cnt.lang AND g.source = cnt.source AND k.term = cnt.term),
q AS (
  SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 1)) // ((SELECT sum(n) FROM total t WHERE t.lang = cnt.lang) + any_value(v)) AS q
  FROM cnt JOIN size USING (lang) GROUP BY lang, term),
other AS (SELECT a.lang, a.source, b.source AS item FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pair AS (SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM other LEFT JOIN far USING (lang, source, item)),
term AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""

_ESCAPED = r"""regexp_replace(coalesce({}, ''), '([<\[])(\\*)(s>|/s>|INST\]|/INST\]|\|endoftext\|>|\|im_start\|>|\|im_sep\|>|\|im_end\|>)', '\1\2\\\3', 'g')"""

_OP12 = f"""
WITH t AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
p AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    length('<|im_start|><|im_sep|><|im_end|>') + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) AS size FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(size) + length('<s></s>') AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id"""

#: crc32 of a text of ASCII characters, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT)),
    lambda c, b: list_reduce([CAST(0 AS BIGINT) FOR i IN range(8)], lambda d, i: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), 4294967295))"""

_OP13 = (
    r"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, lang, [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)] AS own, text,
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS small FROM documents),
heads AS (SELECT *, array_to_string(list_transform(own, lambda x: coalesce(strlen(x) || ':' || x, '-')), '') AS head FROM doc),
leaves AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(small) || ':' || small, '-')) AS tampered FROM heads),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree(top, lvl, g, pos, n, h, ids) AS (
  SELECT 0, 0, lang, pos, n, leaf, NULL::BIGINT[] FROM placed
  UNION ALL
  SELECT 0, lvl + 1, g, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)), NULL FROM tree WHERE n > 1 GROUP BY lvl, g, pos // 8, n),
subroot AS (SELECT g, h, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
above(lvl, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroot
  UNION ALL
  SELECT lvl + 1, pos // 8, (n + 7) // 8, sha256(string_agg(h, '' ORDER BY pos)) FROM above WHERE n > 1 GROUP BY lvl, pos // 8, n),
runs AS (SELECT lvl, g, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM tree WHERE n > 1 GROUP BY lvl, g, pos // 8),
top_runs AS (SELECT lvl, pos // 8 AS up, list(h ORDER BY pos) AS hs FROM above WHERE n > 1 GROUP BY lvl, pos // 8),
climb(r, lvl, g, pos, n, acc, proof) AS (
  SELECT r, 0, lang, pos, n, CASE WHEN mod(crc, 3) = 0 THEN tampered ELSE leaf END, ''
  FROM (SELECT *, """
    + _CRC.format("CAST(doc_id AS VARCHAR)")
    + r""" AS crc FROM placed)
  UNION ALL
  SELECT r, c.lvl + 1, c.g, c.pos // 8, (c.n + 7) // 8,
    sha256(array_to_string(hs[:c.pos % 8], '') || acc || array_to_string(hs[c.pos % 8 + 2:], '')),
    proof || array_to_string(hs[:c.pos % 8], '') || array_to_string(hs[c.pos % 8 + 2:], '')
  FROM climb c JOIN runs t ON c.n > 1 AND c.lvl = t.lvl AND c.g IS NOT DISTINCT FROM t.g AND c.pos // 8 = t.up),
climb_top(r, lvl, pos, n, acc, proof) AS (
  SELECT r, 0, s.pos, s.n, acc, proof FROM climb JOIN subroot s ON climb.n = 1 AND climb.g IS NOT DISTINCT FROM s.g
  UNION ALL
  SELECT r, c.lvl + 1, c.pos // 8, (c.n + 7) // 8,
    sha256(array_to_string(hs[:c.pos % 8], '') || acc || array_to_string(hs[c.pos % 8 + 2:], '')),
    proof || array_to_string(hs[:c.pos % 8], '') || array_to_string(hs[c.pos % 8 + 2:], '')
  FROM climb_top c JOIN top_runs t ON c.n > 1 AND c.lvl = t.lvl AND c.pos // 8 = t.up)
SELECT doc_id, leaf, s.h AS subroot, a.h AS root, sha256(proof) AS proof_sha256, acc AS folded_root, acc = a.h AS verified
FROM placed p JOIN climb_top c ON p.r = c.r AND c.n = 1 JOIN subroot s ON p.lang IS NOT DISTINCT FROM s.g JOIN above a ON a.n = 1"""
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_jaccard": op1_ngram_jaccard,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_language_id": op3_language_id,
        "op4_url_filters": op4_url_filters,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_decontamination": op7_decontamination,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_line_dedup": op9_line_dedup,
        "op10_nearest_neighbours": op10_nearest_neighbours,
        "op11_source_divergence": op11_source_divergence,
        "op12_chat_formatting": op12_chat_formatting,
        "op13_merkle_manifest": op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": _OP1, "op4_url_filters": _OP4, "op7_decontamination": _OP7, "op9_line_dedup": _OP9, "op11_source_divergence": _OP11, "op12_chat_formatting": _OP12, "op13_merkle_manifest": _OP13}
