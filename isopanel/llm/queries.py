"""The queries of this subpackage: each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, idfiles, jaccard, language, lexical, manifest, maxscore, packing, pii, secret_scan, suffix, toxicity, warc
from .common import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op3_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfiles.read_ids(idfiles.write_ids(table(spark, sf_dir, "documents")))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("class")


def op5_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return maxscore.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.documents_languages(table(spark, sf_dir, "documents"))


def llm_pages_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language operator over pages, where markup, address suffixes and hosts are."""
    return language.pages_languages(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.verified(table(spark, sf_dir, "documents"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_best_fit_packing, op2_suffix_dedup, op3_token_id_files, op4_jaccard_join, op5_warc_archives, op6_maxscore_top_k, op7_language_id, llm_pages_language, op8_toxicity, op9_pii_spans, op10_decontamination, op11_ranked_search, op12_merkle_manifest, op13_secret_scan)
}

#: A row's leaf in SQL, and what a level does to a digest and its proof.
_LEAF = "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"
_UP = "sha256(array_to_string(nodes[1:place % 8] || [h] || nodes[place % 8 + 2:], '')), proof || array_to_string(nodes[1:place % 8] || nodes[place % 8 + 2:], '')"

ORACLE_SQL: dict[str, str] = {
    "op2_suffix_dedup": """
        WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), n AS (SELECT doc_id, h, length(h) // 2 AS n FROM b),
        w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 100) AS w FROM (SELECT doc_id, h, unnest(range(1, n - 48)) AS i FROM n WHERE n >= 50)),
        f AS (SELECT w, min(doc_id) AS first FROM w GROUP BY w),
        r AS (SELECT doc_id, i FROM w JOIN f USING (w) WHERE first < doc_id),
        g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM r),
        s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
        c AS (SELECT doc_id, k, min(i) AS a, max(i) + 50 AS z FROM s GROUP BY doc_id, k),
        o AS (SELECT doc_id, a, z, lag(z, 1, 1) OVER (PARTITION BY doc_id ORDER BY a) AS low FROM c),
        p AS (SELECT o.doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * low - 1, 2 * (a - low)), '' ORDER BY a) AS kept, max(z) AS last FROM o JOIN n ON o.doc_id = n.doc_id GROUP BY o.doc_id)
        SELECT n.doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
            sha256(unhex(CASE WHEN kept IS NULL THEN h ELSE kept || substr(h, 2 * last - 1) END)) AS kept_sha256 FROM n LEFT JOIN p USING (doc_id)
    """,
    "op4_jaccard_join": r"""
        WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM t),
        n AS (SELECT doc_id, count(g) AS n FROM t LEFT JOIN s USING (doc_id) GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
        SELECT n.doc_id, n AS n_shingles, min(y) AS component_id FROM n JOIN r ON n.doc_id = r.x GROUP BY n.doc_id, n
    """,
    "op5_warc_archives": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 100 AND first < page_id THEN first END AS refers_to FROM f
    """,
    "op6_maxscore_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS score
              FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(score AS BIGINT) AS score FROM r WHERE rank <= 10
    """,
    "op11_ranked_search": r"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        g AS (SELECT count(*) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS l FROM d WHERE len(w) > 0),
        i AS (SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
        q AS (SELECT q, item_id, term, count(*) AS c FROM (SELECT q, item_id, unnest(w) AS term FROM i) GROUP BY ALL),
        t AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d) SEMI JOIN q USING (term) GROUP BY ALL),
        f AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, g GROUP BY term, n_docs),
        s AS (SELECT q, item_id, r, doc_id, CAST(sum(c * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // l)))) AS BIGINT) AS score
              FROM q JOIN t USING (term) JOIN f USING (term), g GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
    """,
    "op12_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
            xor(4294967295, list_reduce([4294967295] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])),
                lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS crc FROM documents),
        l AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, crc, {_LEAF.format("text")} AS leaf, {_LEAF.format("low")} AS lower_leaf FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS size FROM l),
        v AS (SELECT 0 AS k, tree, place, size, leaf AS node FROM n UNION ALL
            SELECT k + 1, tree, place // 8, (max(size) + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM v WHERE size > 1 GROUP BY k, tree, place // 8),
        s AS (SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS size FROM v WHERE size = 1),
        t AS (SELECT 0 AS k, place, size, node FROM s UNION ALL
            SELECT k + 1, place // 8, (max(size) + 7) // 8, sha256(string_agg(node, '' ORDER BY place)) FROM t WHERE size > 1 GROUP BY k, place // 8),
        a AS (SELECT k, tree, place // 8 AS run, list(node ORDER BY place) AS nodes FROM v WHERE size > 1 GROUP BY ALL),
        b AS (SELECT k, place // 8 AS run, list(node ORDER BY place) AS nodes FROM t WHERE size > 1 GROUP BY ALL),
        f AS (SELECT r, tree, 0 AS k, place, CASE WHEN crc % 3 = 0 THEN lower_leaf ELSE leaf END AS h, '' AS proof FROM n UNION ALL
            SELECT r, f.tree, f.k + 1, place // 8, {_UP} FROM f JOIN a ON f.k = a.k AND f.tree = a.tree AND f.place // 8 = a.run),
        g AS (SELECT r, 0 AS k, s.place, h, proof FROM (SELECT r, arg_max(tree, k) AS tree, arg_max(h, k) AS h, arg_max(proof, k) AS proof FROM f GROUP BY r) JOIN s USING (tree) UNION ALL
            SELECT r, g.k + 1, place // 8, {_UP} FROM g JOIN b ON g.k = b.k AND g.place // 8 = b.run),
        e AS (SELECT r, arg_max(h, k) AS folded_root, sha256(arg_max(proof, k)) AS proof_sha256 FROM g GROUP BY r)
        SELECT doc_id, leaf, s.node AS subroot, t.node AS root, proof_sha256, folded_root, folded_root = t.node AS verified FROM l JOIN e USING (r) JOIN s USING (tree) JOIN t ON t.size = 1
    """,
}
