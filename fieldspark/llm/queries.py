"""The operators' queries over the given tables, with production parameters, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import (
    anchor_pii, ecoc_language, fm_quality, hybrid_search, line_runs, permuterm, phrase_automata, pstable, rule_ledger, simhash_mih, source_mix, ss_packing, zstd_toxicity)
from fieldspark.llm.common import doc_crc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scored(rows: DataFrame, folds: int, held_out: int, threshold: float) -> DataFrame:
    return rows.select("doc_id", (doc_crc(F.col("doc_id"), folds) == held_out).alias("held_out"), "score",
                       (F.col("score") >= threshold).cast("int").alias("predicted"))


@query("op1_fm_quality")
def quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = fm_quality.train(docs, table(spark, folder, "labels"), 3, 1)
    return scored(fm_quality.score(docs, model), 3, 1, 0.5)


VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT v.vec_id, (SELECT count(*) FROM links WHERE x = v.vec_id) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = v.vec_id"""


@query("op2_pstable_near_dedup", VECTORS_SQL)
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return pstable.near_vectors(table(spark, folder, "embeddings"))


@query("op3_zstd_toxicity")
def toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = zstd_toxicity.train(docs, table(spark, folder, "labels"), 4, 2)
    return scored(zstd_toxicity.score(docs, model), 4, 2, 0.3)


LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
flagged AS (
  SELECT doc_id, pos, line, length(k) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY k) AS gone FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM flagged GROUP BY doc_id"""


@query("op4_line_dedup", LINES_SQL)
def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_runs.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op5_ecoc_language")
def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = ecoc_language.train(docs, 4, 2)
    return ecoc_language.identify(docs, model, "doc_id").select(
        "doc_id", (doc_crc(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


RULES_SQL = r"""
WITH docs AS (
  SELECT doc_id, text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls FROM documents),
grams AS (
  SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM docs)),
often AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM often, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    len(ls) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words FROM docs LEFT JOIN covered USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 10 * n_symbols > 3 * n_words OR word_chars < 2 * n_words
       OR word_chars > 20 * n_words OR 10 * n_dup_lines > 3 * n_lines) AS kept
FROM m"""


@query("op6_rule_ledger", RULES_SQL)
def rules(spark: SparkSession, folder: str) -> DataFrame:
    rows = rule_ledger.apply_policy(rule_ledger.ledger(table(spark, folder, "documents")), rule_ledger.STANDARD)
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       rule_ledger.failed(rule_ledger.BASE).alias("base_failed"), "kept")


@query("op7_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash_mih.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


PASSAGES_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
wins AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS w
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM docs)),
gone AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY w) AS owner FROM wins) WHERE owner < doc_id),
covered AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM gone, (SELECT unnest(range(0, 50)) AS k) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM docs),
kept AS (
  SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS t
  FROM words LEFT JOIN (SELECT doc_id, unnest(places) AS i FROM covered) c USING (doc_id, i) WHERE c.i IS NULL GROUP BY words.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op8_phrase_automata", PASSAGES_SQL)
def passages(spark: SparkSession, folder: str) -> DataFrame:
    rows = phrase_automata.dedup_passages(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_words", "n_removed", "kept_sha256")


def packing_config() -> ss_packing.PackConfig:
    return ss_packing.PackConfig(public_tokenizers.path("word_bpe_49k.json"))


@query("op9_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return ss_packing.pack_documents(table(spark, folder, "documents"), packing_config())


@query("op10_source_mix")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


VARIANTS_SQL = r"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
coded AS (
  SELECT run, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128
    THEN [ord(c) & 15, ord(c) >> 4] ELSE [ord(c) >> 6, 12, ord(c) & 15, 8 + ((ord(c) >> 4) & 3)] END)) AS halves FROM counted),
hashed AS (  -- crc32 by half bytes; the list is the usual table of 16 remainders
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(halves, lambda x: CAST(x AS BIGINT))), lambda c, x: xor(c >> 4,
    ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804,
      2607071920, 2262029012, 2685067896, 3183342108])[xor(c & 15, x) + 1]))) AS h FROM coded),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cut AS (SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON cut.rest = words.word
  UNION SELECT words.word, cut.word FROM cut JOIN words ON cut.rest = words.word),
best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS form, max(n) AS form_n FROM near JOIN words ON words.word = near.other GROUP BY near.word),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
walk(word, root, up) AS (
  SELECT word, word, form FROM formed UNION ALL SELECT walk.word, walk.up, formed.form FROM walk JOIN formed ON formed.word = walk.up)
SELECT formed.word, n, n_near, formed.form, form_n, root FROM formed JOIN walk ON walk.word = formed.word AND walk.up IS NULL"""


@query("op11_permuterm_variants", VARIANTS_SQL)
def spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return permuterm.variants(table(spark, folder, "documents")).select("word", "form", "root", "n", "n_near", "form_n")


SEARCH_SQL = r"""
WITH tokens AS (
  SELECT d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents) WHERE text IS NOT NULL),
sizes AS (SELECT d, doc_id, CAST(len(ts) AS BIGINT) AS n FROM tokens WHERE len(ts) > 0),
total AS (SELECT count(*) AS nd, CAST(sum(n) AS BIGINT) AS nt FROM sizes),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
postings AS (
  SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM tokens) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), total),
scores AS (
  SELECT item_id, d, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN sizes USING (d), total GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10"""


@query("op12_hybrid_search", SEARCH_SQL)
def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return hybrid_search.search(hybrid_search.build_index(table(spark, folder, "documents")), table(spark, folder, "benchmark"))


@query("op13_anchor_pii")
def private_data(spark: SparkSession, folder: str) -> DataFrame:
    rows = anchor_pii.find_private(table(spark, folder, "documents"))
    counts = [anchor_pii.count_base(kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")]
    return rows.select("doc_id", *counts, F.sha2(anchor_pii.listed(F.filter("spans", lambda s: s["base"])), 256).alias("base_sha256"),
                       anchor_pii.listed(F.col("spans")).alias("spans"))
