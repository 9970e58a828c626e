"""Registered queries of this package: name -> fn(spark, sf_dir), and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import (decontamination, language_id, license_scan, line_dedup, merkle, near_dedup, packing, repeats,
                           resampling, sharding, token_counts, top_k, toxicity)
from panelmill.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("key")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return merkle.manifest(docs, tampered={"n_chars": docs["n_chars"] + 1}, where=merkle.sevenths(docs["doc_id"])).drop("path")


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("matches")


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_top_k, op3_decontamination, op4_language_id, op5_toxicity, op6_line_dedup, op7_near_dedup,
    op8_repeats, op9_token_counts, op10_sharding, op11_merkle, op12_licenses,
    op13_resampling,
    pipeline)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DEDUP_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"

#: CRC-32 as a linear code: t(k, b, v) has the part of byte b with k bytes after it, z(n, v) the rest, which hangs on the length.
#: bytes(key, n, k, b) must stand before; crc(key, v) is the result. The constant is the reflected polynomial.
_CRC = """
  b256 AS (SELECT i AS b, CAST(list_reduce(list_concat([i], range(8)),
             lambda a, x: xor(a >> 1, 3988292384 * (a & 1))) AS BIGINT) AS v FROM range(256) r(i)),
  t AS (SELECT CAST(0 AS BIGINT) AS k, b, v FROM b256
        UNION ALL SELECT t.k + 1, t.b, xor(t.v >> 8, b256.v) FROM t JOIN b256 ON b256.b = (t.v & 255)
        WHERE t.k + 1 < (SELECT max(n) FROM bytes)),
  z AS (SELECT CAST(0 AS BIGINT) AS n, CAST(4294967295 AS BIGINT) AS v
        UNION ALL SELECT z.n + 1, xor(z.v >> 8, b256.v) FROM z JOIN b256 ON b256.b = (z.v & 255)
        WHERE z.n < (SELECT max(n) FROM bytes)),
  crc AS (SELECT key, xor(xor(bit_xor(t.v), any_value(z.v)), 4294967295) AS v
          FROM bytes JOIN t USING (k, b) JOIN z USING (n) GROUP BY key)"""


def _bytes_of(keys: str) -> str:
    """The CTE ``bytes`` over a query of distinct strings ``key``."""
    return f"""
  keys AS ({keys}), hexed AS (SELECT key, hex(encode(key)) AS x FROM keys),
  bytes AS (SELECT key, n, n - i AS k, CAST('0x' || substr(x, CAST(2 * i - 1 AS INTEGER), 2) AS BIGINT) AS b
            FROM (SELECT key, x, CAST(length(x) // 2 AS BIGINT) AS n FROM hexed), LATERAL generate_series(1, n) s(i))"""


def _license_templates() -> str:
    """The templates as SQL rows (t, label, base, k, word, must)."""
    rows = [f"({i}, '{t.label}', {t.base}, {k}, '{w}', {m})" for i, t in enumerate(license_scan.templates())
            for k, (w, m) in enumerate(zip(t.words, t.must))]
    return f"(VALUES {', '.join(rows)}) x(t, label, base, k, word, must)"


#: The other operators' results come from models, tokenizers, sketches, bin packing or byte strings that SQL cannot
#: express or is too slow for; tests/llm holds them against brute force.
ORACLES: dict[str, str] = {
    "op2_top_k": """
      WITH v AS (
        SELECT DISTINCT vec_id, CAST(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS e
        FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
      SELECT query_id, rank, vec_id, score FROM (
        SELECT query_id, vec_id, score,
          CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
        FROM (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id))
      WHERE rank <= 20""",
    "op3_decontamination": f"""
      WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_BENCH_WORDS} AS w FROM benchmark),
      win AS (SELECT DISTINCT item_id, least(len(w), 13) AS n,
                array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS s
              FROM item, LATERAL generate_series(1, greatest(len(w) - 12, 1)) t(i) WHERE len(w) > 0),
      doc AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
      place AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
                FROM doc, (SELECT DISTINCT n FROM win), LATERAL generate_series(1, len(w) - n + 1) t(i)),
      hit AS (SELECT place.doc_id, place.i, place.n, win.item_id FROM place JOIN win ON place.n = win.n AND place.s = win.s),
      words AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, LATERAL generate_series(0, n - 1) t(k) GROUP BY 1),
      items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS h
                FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
      SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated
      FROM doc LEFT JOIN words ON doc.doc_id = words.doc_id LEFT JOIN items ON doc.doc_id = items.doc_id""",
    "op7_near_dedup": f"""
      WITH RECURSIVE doc AS (SELECT doc_id, {_DEDUP_WORDS} AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s
             FROM doc, LATERAL generate_series(1, greatest(len(w) - 2, 1)) t(i) WHERE len(w) > 0),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
      both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id
                GROUP BY 1, 2),
      link AS (SELECT x, y FROM both_ JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
               WHERE 100 * c >= 85 * (a.n + b.n - c)),
      reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.y FROM reach JOIN link ON reach.b = link.x),
      least_ AS (SELECT a, min(b) AS c FROM reach GROUP BY 1)
      SELECT doc.doc_id, coalesce(n.n, 0) AS n_shingles, c AS component_id, doc.doc_id = c AS kept
      FROM doc JOIN least_ ON doc.doc_id = a LEFT JOIN n ON doc.doc_id = n.doc_id""",
    "op11_merkle": f"""
      WITH RECURSIVE {_bytes_of("SELECT DISTINCT CAST(doc_id AS VARCHAR) AS key FROM documents WHERE doc_id IS NOT NULL")},
      {_CRC},
      named AS (SELECT doc_id, lang, n_chars, coalesce('=' || lang, '') AS g,
                  coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') AS a,
                  coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS b,
                  coalesce(strlen(text) || ':' || text, '-') AS d FROM documents),
      leaf AS (SELECT doc_id, g, sha256(a || b || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || d) AS h,
                 sha256(a || b || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || d) AS other
               FROM named),
      placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM leaf),
      -- levels within groups: (level, g, idx, h, parent)
      tree AS (SELECT 0 AS level, g, pos AS idx, h FROM placed
               UNION ALL SELECT level + 1, g, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree
               WHERE g IN (SELECT g FROM placed GROUP BY g HAVING count(*) > power(2, level)) GROUP BY level, g, idx // 2),
      sub AS (SELECT g, arg_max(h, level) AS h, row_number() OVER (ORDER BY g) - 1 AS pos FROM
                (SELECT g, h, level FROM tree QUALIFY level = max(level) OVER (PARTITION BY g)) GROUP BY g),
      top AS (SELECT 0 AS level, pos AS idx, h FROM sub
              UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top
              WHERE (SELECT count(*) FROM sub) > power(2, level) GROUP BY level, idx // 2),
      root AS (SELECT arg_max(h, level) AS h FROM top),
      steps AS (SELECT placed.doc_id, placed.g, placed.pos, t.level, coalesce(s.h, '') AS sib, (t.idx % 2) = 1 AS at_right
                FROM placed JOIN tree t ON t.g = placed.g AND t.idx = placed.pos // CAST(power(2, t.level) AS BIGINT)
                LEFT JOIN tree s ON s.g = t.g AND s.level = t.level AND s.idx = xor(t.idx, 1)
                WHERE t.level < (SELECT max(level) FROM tree m WHERE m.g = placed.g)
                UNION ALL
                SELECT placed.doc_id, placed.g, placed.pos, 1000 + t.level, coalesce(s.h, ''), (t.idx % 2) = 1
                FROM placed JOIN sub ON sub.g = placed.g
                JOIN top t ON t.idx = sub.pos // CAST(power(2, t.level) AS BIGINT)
                LEFT JOIN top s ON s.level = t.level AND s.idx = xor(t.idx, 1)
                WHERE t.level < (SELECT max(level) FROM top)),
      path AS (SELECT g, pos, list((CASE WHEN at_right THEN 'R' ELSE 'L' END) || sib ORDER BY level) AS p FROM steps GROUP BY g, pos),
      done AS (SELECT placed.doc_id, placed.g, placed.h, coalesce(path.p, []) AS p,
                 CASE WHEN crc.v % 7 = 0 THEN other ELSE placed.h END AS given
               FROM placed LEFT JOIN path USING (g, pos) LEFT JOIN crc ON crc.key = CAST(placed.doc_id AS VARCHAR)),
      folded AS (SELECT *, list_reduce(list_concat([given], p), lambda a, x:
                   sha256(CASE WHEN x[1] = 'R' THEN x[2:] || a ELSE a || x[2:] END)) AS folded_root FROM done)
      SELECT folded.doc_id, folded.h AS leaf, sub.h AS subroot, root.h AS root,
        sha256(array_to_string(list_transform(p, lambda x: x[2:]), '')) AS proof_sha256, folded_root,
        folded_root = root.h AS verified
      FROM folded JOIN sub USING (g), root""",
    "op13_resampling": f"""
      WITH RECURSIVE texts AS (
        SELECT row_number() OVER () AS r, * FROM (SELECT doc_id, false AS bench, {_BENCH_WORDS} AS w FROM documents
                                                  UNION ALL SELECT NULL, true, {_BENCH_WORDS} FROM benchmark)),
      runs AS (SELECT r, unnest(w) AS key FROM texts
               UNION ALL SELECT r, w[i] || ' ' || w[i + 1] FROM texts, LATERAL generate_series(1, len(w) - 1) s(i)),
      counted AS (SELECT r, key, count(*) AS c FROM runs GROUP BY 1, 2),
      {_bytes_of("SELECT DISTINCT key FROM counted")}, {_CRC},
      found AS (SELECT r, v % 10000 AS bucket, sum(c) AS c FROM counted JOIN crc USING (key) GROUP BY 1, 2),
      bucket AS (SELECT bucket, sum(CASE WHEN bench THEN 0 ELSE c END) AS s, sum(CASE WHEN bench THEN c ELSE 0 END) AS t
                 FROM found JOIN texts USING (r) GROUP BY 1),
      whole AS (SELECT CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM bucket),
      gain AS (SELECT bucket, CAST(floor(1000 * ln(((CAST(b.t AS DOUBLE) + 1) * (whole.s + 10000))
                 / ((CAST(b.s AS DOUBLE) + 1) * (whole.t + 10000)))) AS BIGINT) AS gain FROM bucket b, whole),
      weighed AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(floor(sum(c * gain) / CAST(sum(c) AS DOUBLE)) AS BIGINT) AS weight
                  FROM found JOIN gain USING (bucket) GROUP BY 1),
      scored AS (SELECT doc_id, r, len(w) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)
                     AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
                 FROM texts LEFT JOIN weighed USING (r) WHERE NOT bench),
      placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS LAST) AS k,
                   count(*) OVER (PARTITION BY able) AS n FROM scored)
      SELECT doc_id, n_features, weight, score, CASE WHEN able AND k <= 25 * n // 100 THEN k END AS rank FROM placed""",
    "op12_licenses": f"""
      WITH texts AS (SELECT row_number() OVER () AS r, doc_id, {_BENCH_WORDS} AS w FROM documents),
      tpl AS (SELECT * FROM {_license_templates()}),
      size_ AS (SELECT t, any_value(label) AS label, any_value(base) AS base, count(*) AS n FROM tpl GROUP BY t),
      place AS (SELECT r, i - 1 AS i, w[i] AS word FROM texts, LATERAL generate_series(1, len(w)) s(i)
                WHERE list_contains((SELECT list(DISTINCT word) FROM tpl), w[i])),
      held AS (SELECT word, count(DISTINCT r) AS df FROM place GROUP BY word),
      able AS (SELECT t FROM tpl LEFT JOIN held USING (word) GROUP BY t HAVING bool_and(NOT must OR df IS NOT NULL)),
      rarest AS (SELECT t, word, df, row_number() OVER (PARTITION BY t ORDER BY df, word) AS k
                 FROM (SELECT DISTINCT t, word FROM tpl) JOIN able USING (t) JOIN held USING (word)),
      rare AS (SELECT t, word FROM rarest WHERE k = 1 OR (k <= 3 AND df <= 0.05 * (SELECT count(*) FROM documents))),
      need AS (SELECT t, least(2, count(*)) AS need FROM rare GROUP BY t),
      vote AS (SELECT r, tpl.t, place.i - tpl.k AS start FROM place JOIN tpl USING (word) JOIN rare USING (t, word)),
      aligned AS (SELECT r, t, start FROM vote JOIN need USING (t) GROUP BY r, t, start, need HAVING count(*) >= need),
      found AS (SELECT aligned.r, t, start, size_.label, size_.base, count(p.word) / CAST(any_value(size_.n) AS DOUBLE) AS share
                FROM aligned JOIN tpl USING (t) JOIN size_ USING (t)
                LEFT JOIN place p ON p.r = aligned.r AND p.i = aligned.start + tpl.k AND p.word = tpl.word
                GROUP BY aligned.r, t, start, size_.label, size_.base HAVING bool_and(NOT tpl.must OR p.word IS NOT NULL)),
      summed AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word,
                   max(start) FILTER (base) AS last_word, max(CASE WHEN base THEN 0.5 ELSE share END) AS score,
                   list_sort(list(DISTINCT label) FILTER (base)) AS b, list_sort(list(DISTINCT label) FILTER (base OR share >= 0.6)) AS l
                 FROM found GROUP BY r)
      SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
        CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(b, ','), '') AS base_labels,
        coalesce(array_to_string(l, ','), '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
      FROM texts LEFT JOIN summed USING (r)""",
}
