"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patronlens.llm import conversation_repair, decontamination, jaccard_join, language_id, license_scan, line_dedup, log_bilinear, merkle, nearest, packing, quality_crf, token_files, toxicity
from patronlens.llm.common import crc_remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    prototypes = language_id.fit(documents.where(crc_remainder("doc_id", 5) != 0))
    rows = documents.select("doc_id", (crc_remainder("doc_id", 5) == 0).alias("held_out"), "text")
    return language_id.predict(rows, prototypes, ["doc_id", "held_out"])


@query
def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated",
    )


@query
def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"), ["doc_id"])


@query
def op4_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return nearest.search(_table(spark, folder, "embeddings"), F.col("id") % 20 == 0)


@query
def op5_quality_crf(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    field = quality_crf.fit(documents, quality_crf.training_labels(_table(spark, folder, "labels")))
    rows = documents.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    scored = quality_crf.score(rows, field, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    model = toxicity.fit(documents, quality_crf.training_labels(_table(spark, folder, "labels")))
    rows = documents.select("doc_id", (crc_remainder("doc_id", 3) == 1).alias("held_out"), "text")
    scored = toxicity.score(rows, model, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op7_log_bilinear(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "documents").select("doc_id", (crc_remainder("doc_id", 7) == 2).alias("held_out"), "text")
    model, counts = log_bilinear.fit(rows.withColumn("learned", ~F.col("held_out")))
    return log_bilinear.score(rows, model, counts, ["doc_id", "held_out"])


@query
def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    found = token_files.read_files(token_files.write_files(_table(spark, folder, "documents")))
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(documents)


@query
def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.classes(_table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "n_copies", "n_links")


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    text, kind = F.coalesce("text", F.lit(" ")), F.col("_kind")
    damaged = rows.withColumn("_kind", F.crc32(key.cast("binary")) % 20).where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))),
    )
    found = conversation_repair.repair(damaged, rows)
    named = conversation_repair.digests(found.turns).withColumnRenamed("conv_id", "_conv")
    joined = found.conversations.join(named, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select(*found.conversations.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_merkle(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.col("doc_id").isNotNull() & (crc_remainder("doc_id", 3) == 0)
    lowered = F.when(hit, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    tampered = F.when(hit, merkle.leaf([lowered if c == "text" else F.col(c) for c in merkle.FIELDS])).alias("tampered")
    proofs = merkle.manifest(_table(spark, folder, "documents"), keep=[F.col("doc_id"), tampered]).proofs()
    folded = merkle.fold(F.coalesce("tampered", "leaf"), F.col("path"))
    found = proofs.select("doc_id", "leaf", "subroot", "root", merkle.path_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = license_scan.scan(_table(spark, folder, "documents"), ["doc_id"])
    base = F.filter("spans", lambda s: s["exact"])

    def labels(spans: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(spans["label"])), ",")

    best = F.coalesce(F.array_max(F.col("spans.similarity")), F.lit(0.0)).alias("score")
    return found.withColumn("base", base).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.start")).alias("first_word"),
        F.array_max(F.col("base.start")).alias("last_word"), labels(F.col("base")).alias("base_labels"), labels(F.col("spans")).alias("labels"), best,
    )


#: Words of a text column, as the operators take them, in DuckDB.
_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

ORACLES["op2_decontamination"] = f"""
WITH item AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
     win AS (SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i:i + 9], ' ') AS phrase
             FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
     doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
     spot AS (SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
              FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM doc), (SELECT DISTINCT m FROM win) WHERE i + m - 1 <= len(w)),
     found AS (SELECT r, i, spot.m, item FROM spot JOIN win ON spot.phrase = win.phrase AND spot.m = win.m),
     hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
     held AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(held.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (r) LEFT JOIN held USING (r)
"""

ORACLES["op10_jaccard_join"] = f"""
WITH RECURSIVE doc AS (SELECT doc_id, text, {_WORDS} AS w FROM documents),
     own AS (SELECT text, w, min(doc_id) AS first, count(*) AS n FROM doc WHERE len(w) > 0 GROUP BY ALL),
     node AS (SELECT first AS id, n, text, list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM own),
     gram AS (SELECT id, unnest(s) AS g FROM node),
     pair AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
     link AS (SELECT a, b FROM pair JOIN node x ON x.id = a JOIN node y ON y.id = b WHERE 5 * c >= 4 * (len(x.s) + len(y.s) - c)),
     both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
     reach(a, b) AS (SELECT id, id FROM node UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
     class AS (SELECT a AS id, min(b) AS class_id FROM reach GROUP BY a),
     others AS (SELECT both_ways.a AS id, sum(node.n) AS n FROM both_ways JOIN node ON node.id = both_ways.b GROUP BY both_ways.a)
SELECT doc.doc_id, coalesce(class.class_id, doc.doc_id) AS class_id, coalesce(node.n, 1)::BIGINT AS n_copies,
       (CASE WHEN node.id IS NULL THEN 0 ELSE node.n - 1 + coalesce(others.n, 0) END)::BIGINT AS n_links
FROM doc LEFT JOIN node ON doc.text = node.text LEFT JOIN class ON class.id = node.id LEFT JOIN others ON others.id = node.id
"""


def _crc32(text: str) -> str:
    """crc32 of an ASCII text in DuckDB, bit by bit."""
    step = "lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END"
    byte = f"lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), {step})"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), {byte}), 4294967295::BIGINT)"


_GIVEN = "coalesce(ids.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"

ORACLES["op11_conversation_repair"] = f"""
WITH RECURSIVE
     ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
     raw AS (SELECT c, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32(_GIVEN)} % 20 AS d
             FROM conversations t JOIN ids ON t.conv_id IS NOT DISTINCT FROM ids.conv_id),
     cut AS (SELECT c, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
                    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
             FROM raw, (SELECT unnest([0, 1]) AS k) WHERE d <> 0 AND (k = 0 OR d = 3)),
     pos AS (SELECT *, role[1] AS ini, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS i,
                    NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') AS open FROM cut),
     told AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS again FROM pos),
     rows AS (SELECT *, lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair, blank OR again AS gone, CASE WHEN open THEN 5 ELSE 0 END AS t FROM told),
     sums AS (SELECT c, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                     count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT gone) AS truncated,
                     count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM rows GROUP BY c),
     back AS (SELECT c, n + 1 AS i, 0 AS v0, 10 AS v1, 5 AS v2, 0 AS v3 FROM sums
              UNION ALL
              SELECT c, i, least(w0, 5 + w2, 10 + w3), least(w1, 5 + w2, 10 + w3), least(w2, 5 + w3), least(w3, 5 + w2)
              FROM (SELECT c, r.i,
                           least(2 + v0, CASE WHEN NOT gone THEN t + least(1 + v2, CASE ini WHEN 's' THEN v1 WHEN 'u' THEN v2 END) END) AS w0,
                           least(2 + v1, CASE WHEN NOT gone THEN t + least(1 + v2, CASE ini WHEN 'u' THEN v2 END) END) AS w1,
                           least(2 + v2, CASE WHEN NOT gone THEN t + least(1 + v3, CASE ini WHEN 'a' THEN v3 END) END) AS w2,
                           least(2 + v3, CASE WHEN NOT gone THEN t + least(1 + v2, CASE ini WHEN 'u' THEN v2 END) END) AS w3
                    FROM back JOIN rows r USING (c) WHERE r.i = back.i - 1)),
     cell AS (SELECT c, i, [v0, v1, v2, v3] AS v FROM back),
     walk AS (SELECT c, 1 AS i, 0 AS q, '' AS audit, []::VARCHAR[] AS said, 0 AS k FROM sums
              UNION ALL
              SELECT c, CASE WHEN e IN ('I') THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN q WHEN 'K' THEN kq ELSE fq END, audit || e,
                     CASE e WHEN 'D' THEN said WHEN 'I' THEN said || [fr || ':'] WHEN 'K' THEN said || [role || ':' || text] ELSE said || [fr || ':' || text] END, k + 1
              FROM (SELECT w.*, role, text, kq, CASE WHEN q = 2 THEN 3 ELSE 2 END AS fq, CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END AS fr,
                           CASE WHEN i > n THEN CASE WHEN q IN (1, 2) THEN 'I' END
                                WHEN now = 2 + nxt[q + 1] THEN 'D' WHEN now = 5 + cur[CASE WHEN q = 2 THEN 4 ELSE 3 END] THEN 'I'
                                WHEN NOT gone AND now = t + nxt[kq + 1] THEN 'K' ELSE 'R' END AS e
                    FROM (SELECT w.*, s.n, r.role, r.text, r.gone, r.t, a.v AS cur, a.v[q + 1] AS now, b.v AS nxt,
                                 CASE WHEN q = 0 AND ini = 's' THEN 1 WHEN q <> 2 AND ini = 'u' THEN 2 WHEN q = 2 AND ini = 'a' THEN 3 END AS kq
                          FROM walk w JOIN sums s USING (c) LEFT JOIN rows r ON r.c = w.c AND r.i = w.i
                               LEFT JOIN cell a ON a.c = w.c AND a.i = w.i LEFT JOIN cell b ON b.c = w.c AND b.i = w.i + 1) w)
              WHERE e IS NOT NULL),
     ended AS (SELECT c, arg_max(audit, k) AS audit, arg_max(said, k) AS said FROM walk GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v0, 0)::BIGINT AS cost,
       coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(said, chr(10)), '')) AS repaired_sha256
FROM ids LEFT JOIN sums USING (c) LEFT JOIN ended USING (c) LEFT JOIN (SELECT c, v0 FROM back WHERE i = 1) USING (c)
"""


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


ORACLES["op12_merkle"] = f"""
WITH RECURSIVE
     own AS (SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
                    coalesce({_crc32('doc_id::VARCHAR')} % 3 = 0, false) AS hit FROM documents),
     base AS (SELECT doc_id, g, {_sql_leaf('text')} AS leaf, CASE WHEN hit THEN {_sql_leaf('low')} ELSE {_sql_leaf('text')} END AS start FROM own),
     leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx FROM base),
     tree AS (SELECT g, 0 AS lvl, idx, leaf AS node, count(*) OVER (PARTITION BY g) AS n FROM leaves
              UNION ALL SELECT g, lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM tree WHERE n > 1 GROUP BY g, lvl, idx // 8, n),
     top AS (SELECT 0 AS lvl, g AS idx, node, count(*) OVER () AS n FROM tree WHERE n = 1
             UNION ALL SELECT lvl + 1, idx // 8, sha256(string_agg(node, '' ORDER BY idx)), (n + 7) // 8 FROM top WHERE n > 1 GROUP BY lvl, idx // 8, n),
     run AS (SELECT g, lvl, idx // 8 AS q, list(node ORDER BY idx) AS nodes FROM tree WHERE n > 1 GROUP BY ALL),
     toprun AS (SELECT lvl, idx // 8 AS q, list(node ORDER BY idx) AS nodes FROM top WHERE n > 1 GROUP BY ALL),
     walk AS (SELECT doc_id, g, leaf, idx AS i, 0 AS lvl, idx, start AS cur, '' AS proof FROM leaves
              UNION ALL SELECT doc_id, w.g, leaf, i, w.lvl + 1, idx // 8, sha256(array_to_string(nodes[1:idx % 8] || [cur] || nodes[idx % 8 + 2:], '')),
                               proof || array_to_string(nodes[1:idx % 8] || nodes[idx % 8 + 2:], '')
              FROM walk w JOIN run r ON r.g = w.g AND r.lvl = w.lvl AND r.q = w.idx // 8),
     above AS (SELECT doc_id, g, leaf, i, 0 AS lvl, g AS idx, cur, proof FROM walk w WHERE NOT EXISTS (SELECT 1 FROM run r WHERE r.g = w.g AND r.lvl = w.lvl)
               UNION ALL SELECT doc_id, g, leaf, i, w.lvl + 1, idx // 8, sha256(array_to_string(nodes[1:idx % 8] || [cur] || nodes[idx % 8 + 2:], '')),
                                proof || array_to_string(nodes[1:idx % 8] || nodes[idx % 8 + 2:], '')
               FROM above w JOIN toprun r ON r.lvl = w.lvl AND r.q = w.idx // 8)
SELECT doc_id, leaf, sub.node AS subroot, whole.node AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = whole.node AS verified
FROM above w JOIN (SELECT g, node FROM tree WHERE n = 1) sub USING (g), (SELECT node FROM top WHERE n = 1) whole
WHERE NOT EXISTS (SELECT 1 FROM toprun r WHERE r.lvl = w.lvl)
"""
