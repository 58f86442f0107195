"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larderflow.llm import ann, embedding_dedup, html_extract, license_scan, merkle, ngram_join, packing, quality, sentencepiece_scan, toxicity, url_filter, whitening, word_bpe

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


JACCARD_SQL = r"""
WITH RECURSIVE worded AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) >= 5
        THEN list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
    FROM worded
), posts AS (SELECT doc_id, len(s) AS n, unnest(s) AS t FROM sets
), pairs AS (
    SELECT a.doc_id AS u, b.doc_id AS v
    FROM posts a JOIN posts b ON a.t = b.t AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(u, v) AS (
    SELECT doc_id, doc_id FROM documents
    UNION
    SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
)
SELECT doc_id, CAST(coalesce(len(s), 0) AS BIGINT) AS n_shingles, min(v) AS component_id
FROM sets JOIN reach ON u = doc_id GROUP BY doc_id, s
"""


@_query("op9_ngram_jaccard_join", JACCARD_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(_table(spark, sf_dir, "documents"))


@_query("op1_toxicity")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query("op6_best_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_table(spark, sf_dir, "documents"), near_copies=True)


RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

URL_SQL = """
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), told AS (
    SELECT page_id, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path,
        translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
    FROM cut
), rules(r_verdict, r_host, r_path) AS (VALUES """ + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES) + """),
best AS (
    SELECT u.host, u.path, max_by(r_host || r_path, length(r_host || r_path)) AS rule,
        max_by(r_verdict, length(r_host || r_path)) AS verdict
    FROM (SELECT DISTINCT host, path FROM told) u
    JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
    GROUP BY ALL
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM told LEFT JOIN best USING (host, path)
"""


@_query("op3_url_filter", URL_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, RULES))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _canonical_sql(text: str) -> str:
    """The canonical lines of ``text`` as a list, in SQL."""
    said = f"replace(translate(coalesce({text}, ''), '{license_scan.UPPER}', '{license_scan.LOWER}'), chr(13), chr(10))"
    said = f"regexp_replace({said}, {_quoted(license_scan.COPYRIGHT)}, chr(10), 'g')"
    said = f"regexp_replace({said}, {_quoted(license_scan.PUNCTUATION)}, ' ', 'g')"
    spelt = "' ' || x || ' '"
    for one, other in license_scan.SPELLINGS:
        spelt = f"replace({spelt}, ' {one} ', ' {other} ')"
    lines = f"list_filter([trim(x) FOR x IN string_split({said}, chr(10))], lambda x: x <> '')"
    return f"[trim({spelt}) FOR x IN {lines}]"


LICENCE_SQL = f"""
WITH texts(licence, body) AS (VALUES {", ".join(f"({_quoted(n)}, {_quoted(t)})" for n, ts in license_scan.LICENCES.items() for t in ts)}),
known AS (
    SELECT md5(array_to_string({_canonical_sql("body")}, ' ')) AS digest, min(licence) AS licence FROM texts GROUP BY 1
), told AS (SELECT doc_id, {_canonical_sql("text")} AS lines FROM documents
), whole AS (SELECT doc_id, md5(array_to_string(lines, ' ')) AS digest FROM told
), hits AS (
    SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS line_licences, count(*) AS n_lines
    FROM (SELECT doc_id, md5(unnest(lines)) AS digest FROM told) JOIN known USING (digest) GROUP BY doc_id
)
SELECT doc_id, digest, licence, line_licences, coalesce(n_lines, 0) AS n_lines
FROM whole LEFT JOIN known USING (digest) LEFT JOIN hits USING (doc_id)
"""


@_query("op10_license_scan", LICENCE_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"), license_scan.known_digests(spark))


COSINE_SQL = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
        AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), pairs AS (
    SELECT a.vec_id AS u, b.vec_id AS v FROM usable a
    JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach(u, v) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, pairs.v FROM reach JOIN pairs ON reach.v = pairs.u
), links AS (SELECT u, count(*) AS n FROM pairs GROUP BY u)
SELECT vec_id, coalesce(any_value(n), 0) AS n_links, min(reach.v) AS component_id, vec_id = min(reach.v) AS kept
FROM embeddings JOIN reach ON reach.u = vec_id LEFT JOIN links ON links.u = vec_id GROUP BY vec_id
"""


@_query("op2_embedding_near_dedup", COSINE_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query("op7_html_extraction")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


@_query("op8_approximate_neighbours")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


# Where the public vocabulary files lie.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


@_query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.round_trips(_table(spark, sf_dir, "documents"), PIECES)


# The file is part of an installed package, so it has the same path on every machine.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


@_query("op11_word_bpe")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    both = word_bpe.decode(word_bpe.encode(docs, WORD_BPE).select("doc_id", "ids"), WORD_BPE)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def _leaf_sql(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


# CRC-32 bit by bit: a row of digits is folded, each digit with eight shifts.
_CRC_STEP = "xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)"
_CRC_BYTE = f"list_reduce(list_prepend(xor(a, b), [0::BIGINT FOR k IN range(8)]), lambda c, k: {_CRC_STEP})"
_CRC_SQL = f"xor(list_reduce(list_prepend(4294967295, [ascii(d)::BIGINT FOR d IN string_split(doc_id::VARCHAR, '')]), lambda a, b: {_CRC_BYTE}), 4294967295)"

MERKLE_SQL = f"""
WITH RECURSIVE told AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql("text")} AS leaf,
        CASE WHEN {_CRC_SQL} % 3 = 0
            THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
            ELSE {_leaf_sql("text")} END AS claimed
    FROM documents
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM told
), nodes(tree, level, place, node, n) AS (
    SELECT tree, 0, place, leaf, count(*) OVER (PARTITION BY tree) FROM leaves
    UNION ALL
    SELECT tree, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 7) // 8
    FROM nodes WHERE n > 1 GROUP BY tree, level, place // 8
), subroots AS (
    SELECT tree, node AS subroot, row_number() OVER (ORDER BY tree) - 1 AS rank
    FROM nodes WHERE n = 1
), heads(level, place, node, n) AS (
    SELECT 0, rank, subroot, count(*) OVER () FROM subroots
    UNION ALL
    SELECT level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place)), (any_value(n) + 7) // 8
    FROM heads WHERE n > 1 GROUP BY level, place // 8
), ways AS (
    SELECT l.tree, l.place AS leaf_place, e.level, string_agg(e.node, '' ORDER BY e.place) FILTER (e.place < l.place // (8 ** e.level)::BIGINT) AS a,
        string_agg(e.node, '' ORDER BY e.place) FILTER (e.place > l.place // (8 ** e.level)::BIGINT) AS b
    FROM leaves l JOIN nodes e ON e.tree = l.tree AND e.n > 1 AND e.place // 8 = l.place // (8 ** (e.level + 1))::BIGINT
    GROUP BY ALL
    UNION ALL
    SELECT l.tree, l.place, 1000 + h.level, string_agg(h.node, '' ORDER BY h.place) FILTER (h.place < s.rank // (8 ** h.level)::BIGINT),
        string_agg(h.node, '' ORDER BY h.place) FILTER (h.place > s.rank // (8 ** h.level)::BIGINT)
    FROM leaves l JOIN subroots s USING (tree) JOIN heads h ON h.n > 1 AND h.place // 8 = s.rank // (8 ** (h.level + 1))::BIGINT
    GROUP BY ALL
), steps AS (
    SELECT tree, leaf_place AS place, coalesce(a, '') AS a, coalesce(b, '') AS b, row_number() OVER (PARTITION BY tree, leaf_place ORDER BY level) AS step
    FROM ways
), climbs(tree, place, step, node) AS (
    SELECT tree, place, 0, claimed FROM leaves
    UNION ALL
    SELECT tree, place, s.step, sha256(a || node || b) FROM climbs c JOIN steps s USING (tree, place) WHERE s.step = c.step + 1
), ends AS (
    SELECT tree, place, max_by(node, step) AS folded_root FROM climbs GROUP BY ALL
), shown AS (
    SELECT tree, place, sha256(string_agg(a || b, '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY ALL
), summit AS (
    SELECT node AS root FROM heads WHERE n = 1
)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM summit CROSS JOIN leaves JOIN subroots USING (tree) JOIN ends USING (tree, place) LEFT JOIN shown USING (tree, place)
"""


@_query("op12_merkle_manifest", MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    leaf = merkle.leaf_digest("doc_id", "source", "lang", "n_chars", "text")
    later = F.translate("text", license_scan.UPPER, license_scan.LOWER)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, later).otherwise(F.col("text"))
    claimed = merkle.leaf_digest("doc_id", "source", "lang", "n_chars", tampered)
    leaves = docs.select(F.col("lang").alias("group"), F.col("doc_id").alias("id"), leaf.alias("leaf"), claimed.alias("claimed"))
    shown = merkle.proofs(merkle.build(leaves)).withColumn("folded_root", merkle.folded("claimed"))
    return shown.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", F.sha2("siblings", 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


@_query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))
