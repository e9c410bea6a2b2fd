"""The registered queries of this subpackage, and their SQL where SQL can compute the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tabspark.llm import (binpack, bpe_transducer, conversations, host_rules, impact_search, language, mixing, ngram_join, packing, repair,
                          reversed_search, suffix_tree, toxicity)
from tabspark.llm.common import modulo

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _tokenizer(name: str) -> str:
    """The tokenizers are on every machine, installed with Python."""
    import public_tokenizers
    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op1_sentence_noisy_or")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    labels = _table(spark, folder, "labels").select("doc_id", "toxic")
    train = modulo(F.col("doc_id"), 5) != 0
    rows = toxicity.score(docs, toxicity.learn(docs.where(train), labels.where(train)))
    return rows.select("row.doc_id", (modulo(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score",
                       (F.col("score") >= 0.5).cast("int").alias("predicted"), "worst", F.size("offending").alias("n_offending"))


@query("op2_repair_ids")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return repair.token_file(docs, _tokenizer("word_bpe_49k.json"), 49408)


@query("op3_suffix_tree_score")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    held_out = modulo(F.col("doc_id"), 5) == 1
    rows = suffix_tree.score_texts(_table(spark, folder, "documents").select("doc_id", "text"), ~held_out, whole=True)
    return rows.select("row.doc_id", (modulo(F.col("row.doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op4_compression_language")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    content = language.samples(docs.where(modulo(F.col("doc_id"), 3) != 1).select("doc_id", "lang", "text"))
    rows = language.identify(docs.select("doc_id", "text"), content)
    return rows.select("row.doc_id", (modulo(F.col("row.doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op5_best_fit_shards")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    rows = binpack.shard(_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


_OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op6_impact_ordered_search", _OP6)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return impact_search.nearest(_table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op7_linear_grouping")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json")).select("row.doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query("op8_source_schedule")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    report, _ = mixing.mix(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return report.select("row.doc_id", "size", "source_size", "target", "taken", F.try_divide("taken", "size").alias("repeats"))


_OP9 = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT k, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT k, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT k, count(*) AS n FROM (SELECT DISTINCT k, i + j AS p FROM twice, (SELECT unnest(range(5)) AS j)) GROUP BY k),
lines AS (SELECT k, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
m AS (SELECT d.k, doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l) AS n_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM d JOIN lines USING (k) LEFT JOIN covered USING (k)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base, 100 * n_symbols > 10 * word_chars AS symbols,
             100 * n_dup_lines > 30 * n_lines AS dups, word_chars < 2 * n_words OR word_chars > 12 * n_words AS letters FROM m),
long AS (UNPIVOT (SELECT source, base::INT AS base, symbols::INT AS symbols, dups::INT AS dups, letters::INT AS letters FROM f WHERE source IS NOT NULL)
         ON base, symbols, dups, letters INTO NAME rule VALUE fail),
hosts AS (SELECT source, rule, count(*) AS docs, sum(fail) AS fails, sum(fail) / count(*) AS rate FROM long GROUP BY ALL),
prior AS (SELECT rule, avg(rate) AS mean, var_pop(rate) AS var, avg(1 / docs) AS noise FROM hosts GROUP BY rule),
strength AS (SELECT rule, mean, greatest(least(mean * (1 - mean) / greatest((var - mean * (1 - mean) * noise) / greatest(1 - noise, 1e-9), 1e-6) - 1, 1e4), 1.0) AS s FROM prior),
verdict AS (SELECT source, any_value(docs) AS host_docs, max((fails + mean * s) / (docs + s)) < 0.5 AS ok FROM hosts JOIN strength USING (rule) GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base AS base_failed, NOT base AND coalesce(ok, true) AS kept,
       coalesce(ok, true) AS host_ok, host_docs FROM f LEFT JOIN verdict USING (source)
"""


@query("op9_host_rules", _OP9)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    rows = host_rules.host_rules(_table(spark, folder, "documents").select("doc_id", "source", "text"))
    return rows.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
                       "host_ok", "host_docs")


_OP10 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS m FROM g GROUP BY doc_id),
degree AS (SELECT a, count(DISTINCT y.m) AS links FROM links JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE x.m <> y.m GROUP BY a),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(degree.links, 0)::BIGINT AS links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN degree ON degree.a = d.doc_id JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) c USING (doc_id)
"""


@query("op10_shingle_join", _OP10)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    rows = ngram_join.jaccard_join(_table(spark, folder, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_shingles", "component_id", "links")


@query("op11_bpe_transducer")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    rows = bpe_transducer.digests(bpe_transducer.round_trip(docs, path, public_tokenizers.PATTERN))
    return rows.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "broken")


_OP12 = r"""
WITH w AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents WHERE text IS NOT NULL),
d AS (SELECT k, doc_id, len(t)::BIGINT AS n FROM w WHERE len(t) > 0),
tf AS (SELECT k, term, count(*) AS tf FROM (SELECT k, unnest(t) AS term FROM w) GROUP BY ALL),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM d),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
q AS (SELECT row_number() OVER () AS i, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM benchmark WHERE text IS NOT NULL),
qt AS (SELECT i, item_id, term, count(*)::BIGINT AS times FROM (SELECT i, item_id, unnest(t) AS term FROM q) GROUP BY ALL),
s AS (SELECT i, item_id, d.doc_id, k, sum(times * floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT
             * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::BIGINT AS score
      FROM qt JOIN df USING (term) JOIN tf USING (term) JOIN d USING (k), c GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query("op12_reversed_search", _OP12)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    docs, items = _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text")
    return reversed_search.search(docs, items).select("item.item_id", "rank", "doc_id", "score")


_OP13 = r"""
WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
       coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(length(key)),
               lambda i: list_concat([ord(key[i + 1])::BIGINT], [-1::BIGINT, -1, -1, -1, -1, -1, -1, -1])))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END), 4294967295) % 20 AS kind FROM k),
m AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
             unnest(CASE kind WHEN 0 THEN []::INTEGER[] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM m),
f AS (SELECT *, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev,
             CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 2
                  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM o),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 1)::BIGINT AS blank,
             count(*) FILTER (fault = 2)::BIGINT AS duplicate, count(*) FILTER (fault = 3)::BIGINT AS truncated,
             count(*) FILTER (prev IS NOT NULL AND prev || ini NOT IN ('su', 'ua', 'au'))::BIGINT AS illegal, max(i) AS n FROM f GROUP BY conv_id),
-- e, s, u, a: the least (cost, edits) after i rows with nothing, an s, a u or an a written last, and the repaired rows
p AS (SELECT conv_id, 0::BIGINT AS i, {'c': 0, 'e': '', 'r': ''} AS e, {'c': 99999999, 'e': '', 'r': ''} AS s,
             {'c': 2, 'e': 'I', 'r': chr(10) || 'user:'} AS u, {'c': 4, 'e': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'} AS a FROM c
      UNION ALL
      SELECT conv_id, i, e, s, list_min([u, {'c': a.c + 2, 'e': a.e || 'I', 'r': a.r || chr(10) || 'user:'}]) AS u, a FROM (
      SELECT conv_id, i, e, s, u, list_min([a, {'c': u.c + 2, 'e': u.e || 'I', 'r': u.r || chr(10) || 'assistant:'}]) AS a FROM (
      SELECT conv_id, i, e, s, list_min([u, {'c': e.c + 2, 'e': e.e || 'I', 'r': e.r || chr(10) || 'user:'},
             {'c': s.c + 2, 'e': s.e || 'I', 'r': s.r || chr(10) || 'user:'}, {'c': a.c + 2, 'e': a.e || 'I', 'r': a.r || chr(10) || 'user:'}]) AS u, a FROM (
      SELECT p.conv_id, f.i, {'c': e.c + 3, 'e': e.e || 'D', 'r': e.r} AS e,
             list_min([{'c': s.c + 3, 'e': s.e || 'D', 'r': s.r}, {'c': e.c + CASE WHEN go AND ini = 's' THEN t ELSE 99999999 END, 'e': e.e || 'K', 'r': e.r || own}]) AS s,
             list_min([{'c': u.c + 3, 'e': u.e || 'D', 'r': u.r},
               {'c': e.c + CASE WHEN go THEN 2 + t ELSE 99999999 END, 'e': e.e || 'R', 'r': e.r || chr(10) || 'user:' || text},
               {'c': s.c + CASE WHEN go THEN 2 + t ELSE 99999999 END, 'e': s.e || 'R', 'r': s.r || chr(10) || 'user:' || text},
               {'c': a.c + CASE WHEN go THEN 2 + t ELSE 99999999 END, 'e': a.e || 'R', 'r': a.r || chr(10) || 'user:' || text},
               {'c': e.c + CASE WHEN go AND ini = 'u' THEN t ELSE 99999999 END, 'e': e.e || 'K', 'r': e.r || own},
               {'c': s.c + CASE WHEN go AND ini = 'u' THEN t ELSE 99999999 END, 'e': s.e || 'K', 'r': s.r || own},
               {'c': a.c + CASE WHEN go AND ini = 'u' THEN t ELSE 99999999 END, 'e': a.e || 'K', 'r': a.r || own}]) AS u,
             list_min([{'c': a.c + 3, 'e': a.e || 'D', 'r': a.r},
               {'c': u.c + CASE WHEN go THEN 2 + t ELSE 99999999 END, 'e': u.e || 'R', 'r': u.r || chr(10) || 'assistant:' || text},
               {'c': u.c + CASE WHEN go AND ini = 'a' THEN t ELSE 99999999 END, 'e': u.e || 'K', 'r': u.r || own}]) AS a
      FROM p JOIN (SELECT conv_id, i, ini, text, fault NOT IN (1, 2) AS go, CASE fault WHEN 3 THEN 1 ELSE 0 END AS t, chr(10) || role || ':' || text AS own FROM f) f
        ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1)))),
best AS (SELECT p.conv_id, list_min([e, a]) AS b FROM p JOIN c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n)
SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.e, '') AS audit, sha256(coalesce(b.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM d.conv_id
"""


@query("op13_conversation_repair", _OP13)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.report(conversations.damage(_table(spark, folder, "conversations")))


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, folder)
