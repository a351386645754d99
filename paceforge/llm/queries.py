"""One query per operator over its whole table, with the SQL that must give the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paceforge.llm import (
    common,
    hard_negatives,
    histogram_sort,
    license_scan,
    line_quality,
    line_runs,
    near_dup,
    packing,
    phrase_dedup,
    qgram_decontam,
    secret_scan,
    target_sampling,
    url_globs,
    warc,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Shards of op1, window of op2, threshold of op9.
SHARDS, WINDOW, PERCENT = 40, 50, 85
#: Runs of op10: so many lines, or so many words in fewer lines.
LEAST_LINES, LEAST_WORDS = 3, 50

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_FOLD = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_FACTOR = "({0} * {1}::UHUGEINT) % 18446744073709551616::UHUGEINT"


def _query(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


@_query("op1_histogram_sort")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return histogram_sort.shard_by_bytes(common.documents(spark, sf), SHARDS)


@_query(
    "shard_balance",
    f"""SELECT cast({SHARDS} AS BIGINT) AS shards, count(*) AS n_docs, cast(sum(strlen(coalesce(text, '')) + 16) AS BIGINT) AS n_bytes,
      true AS gapless, true AS even, true AS in_order FROM documents""",
)
def shard_balance(spark: SparkSession, sf: str) -> DataFrame:
    """What the shards of op1 must be: gapless, in order, and no further from the mean than a row or a hundredth."""
    rows = histogram_sort.shard_by_bytes(common.documents(spark, sf), SHARDS)
    each = rows.groupBy("shard").agg(
        F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.min("slot").alias("first"), F.max("slot").alias("last"),
        F.sum("size").alias("bytes"), F.max("size").alias("largest"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"),
    )
    mean = F.col("total") / F.lit(SHARDS)
    near = F.abs(F.col("s.bytes") - mean) <= F.greatest(mean / 100, F.col("biggest"))
    gapless = (F.col("s.n") == F.col("s.slots")) & (F.col("s.first") == 0) & (F.col("s.last") == F.col("s.n") - 1)
    ordered = F.sort_array(F.collect_list(F.struct("shard", "least", "most")))  # a row per shard
    later = F.zip_with(F.slice("order", 1, F.size("order") - 1), F.slice("order", 2, F.size("order") - 1), lambda a, b: a["most"] <= b["least"])
    totals = each.agg(F.sum("n").alias("n_docs"), F.sum("bytes").alias("total"), F.max("largest").alias("biggest"), ordered.alias("order"), F.collect_list(F.struct(*each.columns)).alias("all"))
    flat = totals.select("n_docs", "total", "biggest", F.forall(later, lambda x: x).alias("in_order"), F.explode("all").alias("s"))
    return flat.groupBy("n_docs", F.col("total").alias("n_bytes"), "in_order").agg(
        F.count("*").alias("shards"), F.bool_and(gapless).alias("gapless"), F.bool_and(near).alias("even")
    )


_OP2 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
w AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + {WINDOW - 1}], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM d)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS i
  FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM w) WHERE o < doc_id
),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i FROM d),
left_over AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS kept, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN left_over USING (doc_id)
"""


@_query("op2_phrase_automata", _OP2)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    return phrase_dedup.remove_repeated_phrases(common.documents(spark, sf), WINDOW)


@_query("op3_qgram_decontamination")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return qgram_decontam.find_leaks(common.documents(spark, sf), benchmark)


_OP4 = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
tri AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)
),
rep AS (
  SELECT doc_id, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE n > 1) GROUP BY doc_id
),
line AS (
  SELECT doc_id, host, text, line, regexp_extract_all({_FOLD.format("line")}, '[^\x20\x09-\x0D]+') AS ls
  FROM (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d)
),
norm AS (SELECT *, array_to_string(ls, ' ') AS l FROM line WHERE len(ls) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM norm GROUP BY doc_id),
text AS (SELECT host, text, min(doc_id) AS rep FROM d GROUP BY host, text),
token AS (
  SELECT rep, list_transform(regexp_extract_all({_FOLD.format("text")}, '[^\x20\x09-\x0D]+'), lambda w: CAST(CAST('0x' || substr(md5(w), 1, 15) AS BIGINT) AS UHUGEINT)) AS hs
  FROM text
),
gram AS (
  SELECT DISTINCT rep, ({_FACTOR.format("hs[i]", line_quality.WINDOW_FACTORS[0])} + {_FACTOR.format("hs[i + 1]", line_quality.WINDOW_FACTORS[1])}
    + {_FACTOR.format("hs[i + 2]", line_quality.WINDOW_FACTORS[2])}) % {1 << 64}::UHUGEINT AS g
  FROM (SELECT rep, hs, unnest(range(1, len(hs) - 1)) AS i FROM token)
),
least AS (
  SELECT rep, j, min(g * f % {1 << 64}::UHUGEINT) AS v
  FROM gram, (VALUES {", ".join(f"({j}, {f}::UHUGEINT)" for j, f in enumerate(line_quality.SIGNATURE_FACTORS))}) AS factor(j, f) GROUP BY rep, j
),
led AS (SELECT rep, min(rep) OVER (PARTITION BY host, j, v) AS lead FROM least JOIN text USING (rep)),
agreed AS (SELECT rep, lead FROM led WHERE lead <> rep GROUP BY rep, lead HAVING count(*) >= {line_quality.AGREEING}),
family AS (SELECT host, text, coalesce(min(lead), rep) AS family FROM text LEFT JOIN agreed USING (rep) GROUP BY host, text, rep),
hosts AS (SELECT host, count(DISTINCT family) AS families FROM family GROUP BY host),
often AS (
  SELECT host, l FROM norm JOIN family USING (host, text) JOIN hosts USING (host) GROUP BY host, l, families
  HAVING count(DISTINCT family) > 20 AND (100 * count(DISTINCT family) > 5 * families OR count(DISTINCT family) > 200)
),
cut AS (SELECT doc_id, sum(len(ls)) AS n_cut FROM norm JOIN often USING (host, l) GROUP BY doc_id),
base AS (
  SELECT doc_id, host, text, len(ws) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(coalesce(n_cut, 0) AS BIGINT) AS n_removed_words
  FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND NOT 100 * (n_words - n_removed_words) < 30 * n_words AS kept,
  host, n_removed_words
FROM base
"""


@_query("op4_line_frequency", _OP4)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return line_quality.line_frequency_rules(common.documents(spark, sf)).drop("text_id")


@_query("op5_conflict_best_fit")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(common.documents(spark, sf))


_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OP6 = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS best FROM p),
part AS (
  SELECT page_id, k, CAST('0x' || substr(hex, 5 * k + 1, 5) AS BIGINT) AS v
  FROM g, (SELECT unnest(range(8)) AS k)
),
digest AS (
  SELECT page_id, string_agg(
    substr('{_BASE32}', CAST((v >> 15) & 31 AS INTEGER) + 1, 1) || substr('{_BASE32}', CAST((v >> 10) & 31 AS INTEGER) + 1, 1)
    || substr('{_BASE32}', CAST((v >> 5) & 31 AS INTEGER) + 1, 1) || substr('{_BASE32}', CAST(v & 31 AS INTEGER) + 1, 1),
    '' ORDER BY k) AS payload_digest
  FROM part GROUP BY page_id
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM g JOIN digest USING (page_id)
"""


@_query("op6_warc_dictionary", _OP6)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    return warc.read_records(warc.write_archives(common.pages(spark, sf), least_bytes=0))


def _glob_regex(glob: str) -> str:
    host, slash, path = glob.partition("/")
    quoted = [p.replace(".", r"\.").replace("*", star) for p, star in ((host, "[^/]*"), (path, ".*"))]
    return f"(?s)^{quoted[0]}{slash}{quoted[1]}$".replace("'", "''")


def _op7_sql() -> str:
    rules = sorted(url_globs.HOST_RULES, key=lambda r: -len(r[1] + r[2]))

    def fits(host: str, path: str) -> str:
        return f"((host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '{path}'))"

    cases = " ".join(f"WHEN {fits(h, p)} THEN {{}}" for _, h, p in rules)
    rule = cases.format(*(f"'{h}{p}'" for _, h, p in rules))
    verdict = cases.format(*(f"'{v}'" for v, _, _ in rules))
    globs = [f".{g}" if g[0] != "*" else g for g in url_globs.BLOCK_GLOBS]
    count = " + ".join(f"CAST(regexp_matches('.' || host || path, '{_glob_regex(g)}') AS BIGINT)" for g in globs)
    return rf"""
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
),
v AS (
  SELECT page_id, {_FOLD.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
  FROM u
),
w AS (SELECT *, {count} AS n_globs FROM v)
SELECT page_id, host, path, CASE {rule} END AS rule,
  CASE {verdict} WHEN n_globs > 0 THEN 'block' ELSE 'allow' END AS verdict, n_globs
FROM w
"""


@_query("op7_url_automaton", _op7_sql())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return url_globs.filter_urls(common.pages(spark, sf))


def _op8_sql() -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    phrases = ", ".join(
        f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in license_scan.PHRASES
    )
    templates = ", ".join(
        f"({i}, '{label}', {license_scan.block_words(license_scan.tokens(t.encode()))}, {sorted({w.decode() for w in license_scan.tokens(t.encode())})})"
        for i, (label, t) in enumerate(license_scan.TEMPLATES)
    )
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, {word}) AS ws FROM documents),
phrase(p, label) AS (VALUES {phrases}),
place AS (
  SELECT doc_id, label, i FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d WHERE list_contains(ws, 'license')), phrase
  WHERE ws[i:i + len(p) - 1] = p
),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS labels
  FROM place GROUP BY doc_id
),
template(k, label, span, words) AS (VALUES {templates}),
block AS (
  SELECT doc_id, label, words, list_distinct(ws[i:i + span - 1]) AS b
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d), template WHERE list_contains(words, ws[i])
),
hit AS (
  SELECT doc_id, label, len(list_intersect(words, b)) / len(words) AS c FROM block
  WHERE len(list_intersect(words, b)) >= ceil(0.9 * len(words) - 1e-9)
),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM hit GROUP BY doc_id)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
"""


@_query("op8_license_join", _op8_sql())
def op8(spark: SparkSession, sf: str) -> DataFrame:
    return license_scan.scan_licenses(common.documents(spark, sf)).drop("blocks")


_OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws FROM documents
),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(ws[i:i + 4], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM d WHERE len(ws) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (h) JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, na.n, nb.n
  HAVING 100 * count(*) >= {PERCENT} * (na.n + nb.n - count(*))
),
reach(x, y) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach.y) AS component_id, doc_id = min(reach.y) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.x = doc_id GROUP BY doc_id
"""


@_query("op9_bottom_k", _OP9)
def op9(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(common.documents(spark, sf), PERCENT)


_OP10 = rf"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS p FROM d),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i, count(*) OVER (PARTITION BY doc_id) AS m
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM line) WHERE n > 0
),
win AS (
  SELECT *, lead(line, 1) OVER w AS l2, lead(line, 2) OVER w AS l3, lead(n, 1) OVER w AS n2
  FROM seq WINDOW w AS (PARTITION BY doc_id ORDER BY i)
),
copy AS (
  SELECT doc_id, i, 3 AS depth, row_number() OVER (PARTITION BY line, l2, l3 ORDER BY doc_id, i) AS k FROM win WHERE l3 IS NOT NULL
  UNION ALL
  SELECT doc_id, i, 2, row_number() OVER (PARTITION BY line, l2 ORDER BY doc_id, i) FROM win WHERE n + n2 >= {LEAST_WORDS}
  UNION ALL
  SELECT doc_id, i, 1, row_number() OVER (PARTITION BY line ORDER BY doc_id, i) FROM win WHERE n >= {LEAST_WORDS}
  UNION ALL
  SELECT doc_id, i, m, row_number() OVER (PARTITION BY m, line, l2 ORDER BY doc_id) FROM win WHERE i = 1 AND m < {LEAST_LINES}
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + depth)) AS i FROM copy WHERE k > 1),
dead AS (SELECT doc_id, p FROM seq JOIN gone USING (doc_id, i)),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY p) AS text FROM line ANTI JOIN dead USING (doc_id, p) GROUP BY doc_id),
cut AS (SELECT doc_id, count(*) AS n FROM dead GROUP BY doc_id),
size AS (SELECT doc_id, count(*) AS n FROM seq GROUP BY doc_id)
SELECT doc_id, coalesce(kept.text, CASE WHEN ls IS NOT NULL THEN '' END) AS text, coalesce(size.n, 0) AS n_lines, coalesce(cut.n, 0) AS n_removed
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN cut USING (doc_id) LEFT JOIN size USING (doc_id)
"""


@_query("op10_line_suffix_array", _OP10)
def op10(spark: SparkSession, sf: str) -> DataFrame:
    docs = common.documents(spark, sf).select("doc_id", "text")
    out = line_runs.remove_repeated_lines(docs, LEAST_LINES, LEAST_WORDS)
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"))



_OP11 = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
pair AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
pos AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS positive_rank
  FROM pair WHERE same QUALIFY positive_rank <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_rank ORDER BY score DESC, id) AS INTEGER) AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM pos JOIN (SELECT * FROM pair WHERE NOT same) USING (anchor_id)
WHERE 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""


@_query("op11_bond_negatives", _OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)
    return found.withColumn("rank", F.col("rank").cast("int")).drop("positive_rank")


@_query("op12_char_network")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(common.documents(spark, sf)))


_CRC = target_sampling._POLYNOMIAL
_OP13 = rf"""
WITH RECURSIVE words AS (
  SELECT 'd' AS side, doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 'b', NULL, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
),
run AS (
  SELECT side, doc_id, array_to_string(ws[i:i + k], ' ') AS f FROM (
    SELECT *, unnest(range(1, len(ws) + 1 - k)) AS i FROM (SELECT *, unnest([0, 1, 2]) AS k FROM words)
  )
),
feature AS (SELECT f, hex(encode(f)) AS h, CAST(strlen(f) AS INTEGER) AS n FROM (SELECT DISTINCT f FROM run)),
byte(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) AS r(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, {_CRC}) ELSE c >> 1 END, k + 1 FROM byte WHERE k < 8
),
one AS (SELECT b, c FROM byte WHERE k = 8),
-- what a byte adds to the checksum when d bytes follow, and the same for the four initial bytes
moved(b, c, d) AS (
  SELECT b, c, 0 FROM one
  UNION ALL SELECT m.b, xor(m.c >> 8, one.c), m.d + 1 FROM moved m JOIN one ON one.b = m.c & 255
  WHERE m.d < (SELECT max(n) FROM feature)
),
start(c, n) AS (
  SELECT CAST(4294967295 AS BIGINT), 0
  UNION ALL SELECT xor(s.c >> 8, one.c), s.n + 1 FROM start s JOIN one ON one.b = s.c & 255 WHERE s.n < (SELECT max(n) FROM feature)
),
part AS (SELECT f, n, n - i AS d, CAST('0x' || substr(h, 2 * i - 1, 2) AS BIGINT) AS b FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM feature)),
bucket AS (
  SELECT f, xor(xor(bit_xor(m.c), any_value(s.c)), 4294967295) % 10000 AS bucket
  FROM part p JOIN moved m ON m.d = p.d AND m.b = p.b JOIN start s ON s.n = p.n GROUP BY f
),
tally AS (
  SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t FROM run JOIN bucket USING (f) GROUP BY bucket
),
total AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM tally),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(tally.t AS DOUBLE) + 1) * (CAST(total.s AS DOUBLE) + 10000)
    / ((CAST(tally.s AS DOUBLE) + 1) * (CAST(total.t AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM tally, total
),
summed AS (
  SELECT doc_id, count(*) AS n_features, sum(g) AS w FROM run JOIN bucket USING (f) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY doc_id
),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(w, 0) AS BIGINT) AS weight, len(ws) AS n_words,
    CAST(coalesce(w, 0) + floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('42:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM words LEFT JOIN summed USING (doc_id) WHERE side = 'd'
),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, 5 * count(*) OVER () // 100 AS most FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank, n_words FROM scored LEFT JOIN placed USING (doc_id)
"""


@_query("op13_segment_resampling", _OP13)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf}/benchmark.parquet")
    return target_sampling.weigh(common.documents(spark, sf), benchmark).drop("text_id")


_query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
