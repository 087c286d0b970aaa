"""The queries of these operators, one per operator, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.registry import query
from checks.views import table
from textlab.functions.binding import let
from textlab.llm import (
    bpe, centroids, chunk_bpe, collisions, extract, langid, licences, mixing, runs, simhash, substring,
    urls, vafile,
)
from textlab.llm.common import WORD
from textlab.llm.licence_texts import EQUIVALENT, LICENCES, NOTICES, full_texts


@query("op7_simhash")
def op7_simhash(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint and near-duplicate group of every document."""
    return simhash.simhash_groups(table(spark, sf, "documents")).drop("fp")


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
win AS (
  SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
rep AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win WHERE h IN (SELECT h FROM rep)),
word AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS words
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(words, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""


@query("op8_substring", OP8_SQL)
def op8_substring(spark: SparkSession, sf: str) -> DataFrame:
    """Words left of every document after cutting repeated passages of 35 words."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return substring.remove_repeats(docs).drop("text", "kept")


@query("op10_mixing")
def op10_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mixing.mix_counts(table(spark, sf, "documents")).drop("source")


@query("op6_bpe")
def op6_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids and round trip of every document, as digests."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.encode_documents(docs, path, digests=True).drop("text")


@query("op2_langid")
def op2_langid(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learned from the rows that are not held out."""
    docs = table(spark, sf, "documents")
    model = langid.learn(docs)
    out = langid.predict_languages(docs.select("doc_id", "text"), model)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"),
                      "lang_pred", "score")


# Fixed values: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]

OP4_SQL = rf"""
WITH r(r_host, r_path, r_verdict) AS (VALUES {", ".join(map(str, URL_RULES))}),
cut AS (
  SELECT row_number() OVER () AS n, page_id,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (
  SELECT n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{urls._UPPER}', '{urls._LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
fit AS (
  SELECT p.*, r_host || r_path AS rule, r_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(r_host || r_path) DESC NULLS LAST,
      length(r_host) DESC) AS place
  FROM p LEFT JOIN r ON (host = r_host OR ends_with(host, '.' || r_host))
    AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM fit WHERE place = 1
"""


@query("op4_urls", OP4_SQL)
def op4_urls(spark: SparkSession, sf: str) -> DataFrame:
    """Verdict on the url of every page."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    out = urls.judge_urls(table(spark, sf, "pages").select("page_id", "url"), rules)
    return out.drop("url")


# The rule for copyright lines without the look-ahead that this SQL lacks.
_BEFORE = r"^[^\p{L}\p{N}©]*"
_SIGNED = (_BEFORE + r"(?i:©|all rights reserved|\(c\) *[0-9]|(?:\(c\) *)?copyright[\s\x0B,:.–—-]*"
           r"(?:©|&copy;|\(c\)|[0-9]|by\b|[\[<{]))")
_NAMED = _BEFORE + r"(?:\([cC]\) *)?Copyright[\s\x0B]+"
_NO_NAME = r"(?:Act|Disclaimer|Holder|Interest|Law|Licen[cs]e|Notice|Owner|Statement)s?\b"


def _respelled_sql(words: str, spellings: list[tuple[str, str]]) -> str:
    words = f"(' ' || {words} || ' ')"
    for variant, standard in spellings:
        words = f"replace({words}, ' {licences._wide(variant)} ', ' {licences._wide(standard)} ')"
    return f"replace(trim({words}), '  ', ' ')"


def _canonical_sql(line: str) -> str:
    holder = (f"regexp_matches({line}, '{_SIGNED}') OR (regexp_matches({line}, '{_NAMED}\\p{{Lu}}') "
              f"AND NOT regexp_matches({line}, '{_NAMED}{_NO_NAME}'))")
    kept = f"CASE WHEN {holder} THEN '' ELSE lower({line}) END"
    return _respelled_sql(f"regexp_replace({kept}, '{licences.NOT_A_WORD}', '  ', 'g')", EQUIVALENT)


def _digest_sql(lines: str) -> str:
    several = [x for x in EQUIVALENT if " " in x[0]]
    words = f"replace(array_to_string({lines}, ' '), ' ', '  ')"
    return f"sha256({_respelled_sql(words, several)})"


def _known_sql(entries: list[tuple[str, str]]) -> str:
    rows = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in e)) for e in entries)
    return f"""
SELECT {_digest_sql(_lines_sql("t"))} AS h, min(id) AS id FROM (VALUES {rows}) v(id, t)
GROUP BY h HAVING h <> sha256('')"""


def _lines_sql(text: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), "
            f"'{licences.LINE_BREAK}'), lambda l: {_canonical_sql('l')}), lambda l: l <> '')")


OP9_SQL = f"""
WITH whole AS MATERIALIZED ({_known_sql([*LICENCES, *full_texts()])}),
single AS MATERIALIZED ({_known_sql(NOTICES)}),
d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, {_lines_sql("text")} AS lines FROM documents),
found AS (
  SELECT n, string_agg(DISTINCT id, ',' ORDER BY id) AS notices
  FROM (SELECT n, sha256(unnest(lines)) AS h FROM d) JOIN single USING (h) GROUP BY n),
hashed AS (SELECT n, doc_id, {_digest_sql("lines")} AS digest FROM d)
SELECT doc_id, digest, whole.id AS licence, notices
FROM hashed LEFT JOIN whole ON whole.h = digest LEFT JOIN found USING (n)
"""


@query("op9_licences", OP9_SQL)
def op9_licences(spark: SparkSession, sf: str) -> DataFrame:
    """Known licence and notices of every document."""
    return licences.scan_licences(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op5_vafile", OP5_SQL)
def op5_vafile(spark: SparkSession, sf: str) -> DataFrame:
    """Five best matches of every query among all vectors."""
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return vafile.top_k(rows, F.col("vec_id") % 50 == 0)


@query("op3_extract")
def op3_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    return extract.extract_pages(table(spark, sf, "pages"))


OP1_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id,
  vec_id = component_id AS kept
FROM embeddings LEFT JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op1_collisions", OP1_SQL)
def op1_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Links and near-duplicate group of every vector."""
    return collisions.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """Every tenth document by crc32 of its id repeats a stretch of its words from some
    place on. A null id plants nothing."""
    crc = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(F.col("_crc") / 10)

    def planted(words):
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        at = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(
            words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(at, " ")).otherwise("")

    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(0))
    text = F.when(F.col("_crc") % 10 == 0, let(words, planted)).otherwise(F.col("text"))
    return docs.select("doc_id", "text", crc.alias("_crc")).select("doc_id", text.alias("text"))


# Factors of up to 2**15 words: periods of documents of up to 98,304 words.
_LEVELS = 16


def _level_sql(k: int) -> str:
    half = 1 << k
    names = "SELECT r, n, i, w AS h FROM word" if k == 0 else f"""
  SELECT r, n, i, md5(h || lead(h, {half // 2}) OVER (PARTITION BY r ORDER BY i)) AS h FROM f{k - 1}
  QUALIFY i + {half} <= n AND n >= {3 * half // 2}"""
    return f"""f{k} AS MATERIALIZED ({names}),
s{k} AS (
  SELECT r, min(i) AS start, d AS period, max(i) - min(i) + d + {half} AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS island
    FROM (SELECT r, i, lead(i) OVER (PARTITION BY r, h ORDER BY i) - i AS d FROM f{k})
    WHERE 2 * d > {half} AND d <= {half})
  GROUP BY r, d, island)"""


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII string: each byte is added, then shifted out in eight steps."""
    steps = (f"flatten(list_transform(range(1, length({text}) + 1), "
             f"lambda i: [256 + ascii(substr({text}, i, 1)), 0, 0, 0, 0, 0, 0, 0, 0]))")
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda c, x:
    CASE WHEN x >= 256 THEN xor(c, x - 256) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384)
    ELSE c >> 1 END))"""


OP11_SQL = rf"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, {_crc32_sql("CAST(doc_id AS VARCHAR)")} AS crc,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
num AS (SELECT *, CAST(len(ws) AS BIGINT) AS n, crc // 10 AS g, (crc // 10) % greatest(len(ws), 1) AS a
  FROM base),
planted AS (
  SELECT r, doc_id, n, CASE WHEN crc % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
      ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END])
    ELSE ws END AS ws
  FROM num),
word AS (SELECT r, n, unnest(range(n)) AS i, unnest(ws) AS w FROM planted),
{",".join(_level_sql(k) for k in range(_LEVELS))},
run AS (
  SELECT * FROM ({" UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(_LEVELS))})
  WHERE length >= greatest(24, 3 * period)),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS words FROM word ANTI JOIN gone USING (r, i) GROUP BY r),
every AS (
  SELECT r, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS list
  FROM run GROUP BY r),
best AS (
  SELECT * FROM run
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY length / period DESC, start, period) = 1)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(start AS BIGINT) AS start,
  CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(list, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM planted LEFT JOIN every USING (r) LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""


@query("op11_runs", OP11_SQL)
def op11_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of repeated words in every document, and the words left without repetitions."""
    out = runs.collapse_runs(_with_planted_runs(table(spark, sf, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    digest = F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256)
    best = F.col("best_run")
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), best["start"].alias("start"),
        best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * best_run.length div best_run.period").alias("exponent_milli"),
        digest.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_chunk_bpe")
def op12_chunk_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids by the rank file and decoded bytes of every document, as digests."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = chunk_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return out.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def _round_sql(i: int) -> str:
    """Assignment to the centroids of round i, and the centroids that follow."""
    return f"""a{i} AS MATERIALIZED (
  SELECT r, c, d FROM (
    SELECT r, c, list_inner_product(v.e, v.e) - 2 * list_inner_product(v.e, c{i}.e)
      + list_inner_product(c{i}.e, c{i}.e) AS d FROM v CROSS JOIN c{i})
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),
m{i} AS (
  SELECT c, list(x ORDER BY p) AS e FROM (
    SELECT c, p, floor(sum(x) / count(*)) AS x
    FROM (SELECT c, unnest(e) AS x, unnest(range(64)) AS p FROM v JOIN a{i} USING (r))
    GROUP BY c, p)
  GROUP BY c),
c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m{i}.e, c{i}.e) AS e FROM c{i} LEFT JOIN m{i} USING (c))"""


OP13_SQL = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, e) - 1 AS c, e FROM v
  QUALIFY c < 8),
{",".join(_round_sql(i) for i in range(11))}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance,
  CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c10.e, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256
FROM a10 JOIN c10 USING (c) JOIN v USING (r)
"""


@query("op13_centroids", OP13_SQL)
def op13_centroids(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster of every vector after ten rounds, its distance, and the sums of distances."""
    return centroids.cluster(table(spark, sf, "embeddings").select("vec_id", "embedding"))
