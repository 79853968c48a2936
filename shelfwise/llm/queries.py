"""One query a numbered operator, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import language_id, warc
from shelfwise.llm.common import scratch
from shelfwise.llm.filter_audit import filter_audit
from shelfwise.llm.jaccard_join import near_duplicate_classes
from shelfwise.llm.line_dedup import dedup_units
from shelfwise.llm.mixing import mix
from shelfwise.llm.mtree import top_k
from shelfwise.llm.packing import cut_pieces, pack
from shelfwise.llm.sentence_pieces import round_trip
from shelfwise.llm.spelling import spelling_groups
from shelfwise.llm.syncmers import edited_fingerprints, printed
from shelfwise.llm.token_counts import token_counts
from shelfwise.llm.token_files import token_spans, write_token_files

SEQUENCE = 2048
COUNT_LIMIT = 512


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = cut_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), 0, SEQUENCE, cache_words=900_000)
    return pack(pieces, SEQUENCE)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # A cache folder of its own, empty at first: every distinct text is counted here.
    counts = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), scratch(spark, "token-cache"))
    return counts.withColumn("over_limit", F.col("n_tokens") > COUNT_LIMIT)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_units(docs, whole=("line", "paragraph"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(_table(spark, sf_dir, "pages"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "mix.*")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), 2, scratch(spark, "token-files"), cache_words=700_000)
    return token_spans(manifest)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2)
    model = language_id.train(docs.filter(~F.col("held_out")))
    return language_id.predict(docs.select("doc_id", "held_out", "text"), model).drop("text")


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumns({c: printed(F.col(c)) for c in ("fingerprint", "edited_fingerprint")})


def op10_mtree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit(docs, _table(spark, sf_dir, "labels"))


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_token_counts, op3_substring_dedup, op4_jaccard_join, op5_warc, op6_mixing,
        op7_token_files, op8_language_id, op9_syncmers, op10_mtree_top_k, op11_filter_audit, op12_sentence_pieces,
        op13_spelling,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# A hexadecimal digit in four bits, by way of a letter that is neither digit nor bit.
_BITS = "translate(sha1(payload), '0123456789abcdef', 'ghijklmnopqrstuv')"
for _n, _letter in enumerate("ghijklmnopqrstuv"):
    _BITS = f"replace({_BITS}, '{_letter}', '{_n:04b}')"

SQL: dict[str, str] = {
    "op4_jaccard_join": rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
same AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM same JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT w.doc_id, coalesce(z.n, 0) AS n_shingles, least(w.doc_id, coalesce(r.least, w.doc_id)) AS component_id
FROM words w LEFT JOIN sizes z ON z.doc_id = w.doc_id LEFT JOIN (SELECT x, min(y) AS least FROM reach GROUP BY x) r ON r.x = w.doc_id""",
    "op5_warc": f"""
WITH bits AS (SELECT page_id, payload, {_BITS} AS b FROM (SELECT page_id, coalesce(html, '') AS payload FROM pages)),
chars AS (SELECT page_id, g, substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
      + 16 * CAST(b[5 * g + 1] AS INTEGER) + 8 * CAST(b[5 * g + 2] AS INTEGER) + 4 * CAST(b[5 * g + 3] AS INTEGER)
      + 2 * CAST(b[5 * g + 4] AS INTEGER) + CAST(b[5 * g + 5] AS INTEGER), 1) AS c
    FROM bits, range(32) t(g)),
digests AS (SELECT page_id, string_agg(c, '' ORDER BY g) AS payload_digest FROM chars GROUP BY page_id),
named AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, payload_digest, max(page_id) OVER (PARTITION BY payload_digest) AS original
    FROM bits JOIN digests USING (page_id))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> original THEN original END AS refers_to FROM named""",
    "op10_mtree_top_k": """
WITH parts AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
usable AS (SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))),
whole AS (SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS q FROM parts WHERE vec_id IN (SELECT vec_id FROM usable)),
scores AS (SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(sum(a.q * b.q) AS BIGINT) AS score
    FROM whole a JOIN whole b ON a.i = b.i AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_filter_audit": r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM texts),
failed AS (SELECT doc_id, part,
      CASE WHEN len(w) < 200 THEN 1 ELSE 0 END AS a,
      CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 1 ELSE 0 END AS b,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 1 ELSE 0 END AS c,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 1 ELSE 0 END AS d,
      CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 1 ELSE 0 END AS e FROM words),
tagged AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
masks AS (SELECT part, a + 2 * b + 4 * c + 8 * d + 16 * e AS m, count(*) AS n, sum(coalesce(good, 0)) AS g, sum(coalesce(toxic, 0)) AS x
    FROM failed LEFT JOIN tagged USING (doc_id) GROUP BY ALL),
letters AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(l, bit)),
chains AS (SELECT '' AS o, 0 AS m, 0 AS k UNION ALL SELECT o || l, m + bit, k + 1 FROM chains, letters WHERE m & bit = 0),
orders AS (SELECT o FROM chains WHERE k = 5),
places AS (SELECT o, s, bit, (SELECT coalesce(sum(q.bit), 0) FROM letters q WHERE strpos(o[1:s - 1], q.l) > 0) AS before
    FROM orders, range(1, 6) r(s), letters WHERE l = o[s]),
counted AS (SELECT part, o, s, bit,
      sum(n) FILTER (m & before = 0 AND m & bit = 0) AS kept, sum(n) FILTER (m & before = 0 AND m & bit > 0) AS removed,
      sum(n) FILTER (m & before > 0 AND m & bit > 0) AS redundant, sum(n) FILTER (m = bit) AS alone,
      sum(g) FILTER (m & before = 0 AND m & bit > 0) AS good, sum(x) FILTER (m & before = 0 AND m & bit > 0) AS bad
    FROM masks, places GROUP BY ALL)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed,
    CAST(coalesce(redundant, 0) AS BIGINT) AS redundant, CAST(coalesce(alone, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good, 0) AS BIGINT) AS good_lost,
    CAST(coalesce(bad, 0) AS BIGINT) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM counted""",
    "op13_spelling": rf"""
WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
counted AS (SELECT doc_id, r, count(*) AS c FROM runs GROUP BY ALL),
folded AS (SELECT k, k AS v, 0 AS step FROM range(256) t(k) UNION ALL
    SELECT k, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, step + 1 FROM folded WHERE step < 8),
lookup AS (SELECT list(v ORDER BY k) AS v FROM folded WHERE step = 8),
hexed AS (SELECT r, c, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS x FROM counted),
hashed AS (SELECT r, c, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
      list_transform(range(1, len(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT))),
      lambda h, b: xor(h >> 8, v[(xor(h, b) & 255) + 1])), 4294967295) AS h FROM hexed, lookup),
damaged AS (SELECT CASE WHEN h % 97 = 0 THEN r[1:h % len(r)] || r[h % len(r) + 2:] ELSE r END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged GROUP BY word HAVING sum(c) >= 3 AND len(word) >= 5),
gaps AS (SELECT word, n, len(word) AS m, i, word[1:i] || '*' || word[i + 2:] AS g, word[1:i] || word[i + 2:] AS less FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
longer AS (SELECT DISTINCT g.word, w.word AS other FROM gaps g JOIN words w ON w.word = g.less),
pairs AS (SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.g = b.g AND a.m = b.m AND a.i = b.i AND a.word <> b.word
    UNION SELECT word, other FROM longer UNION SELECT other, word FROM longer),
best AS (SELECT p.word, count(*) AS n_near, max(w.n) AS top FROM pairs p JOIN words w ON w.word = p.other GROUP BY p.word),
named AS (SELECT p.word, min(w.word) AS form FROM pairs p JOIN words w ON w.word = p.other JOIN best b ON b.word = p.word AND b.top = w.n GROUP BY p.word),
formed AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.top >= 2 * w.n THEN f.form END AS form, CASE WHEN b.top >= 2 * w.n THEN b.top END AS form_n
    FROM words w LEFT JOIN best b ON b.word = w.word LEFT JOIN named f ON f.word = w.word),
chains AS (SELECT word, word AS root, form AS further FROM formed UNION ALL
    SELECT c.word, f.word, f.form FROM chains c JOIN formed f ON f.word = c.further)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chains c ON c.word = f.word AND c.further IS NULL""",
}
