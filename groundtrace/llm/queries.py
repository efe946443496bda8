"""Queries of the numbered operators over their whole tables, and the SQL that states results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from groundtrace.llm import conversation_repair, exact_dedup, language_id, license_scan, line_dedup, mixing, near_dedup, passage_dedup, pieces, quality, vector_dedup, warc, whitening
from groundtrace.llm.tables import Work


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = language_id.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return language_id.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.accepted").alias("accepted"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree of three depths below their source: every directory holds files and directories."""
    part, depth = F.col("doc_id").cast("string"), F.col("doc_id") % 3
    top = F.concat(F.coalesce("source", F.lit("unknown")), F.lit("/"))
    middle = F.concat(top, F.floor(F.col("doc_id") / 5000).cast("string"), F.lit("/"))
    low = F.concat(middle, F.floor(F.col("doc_id") / 200).cast("string"), F.lit("/"))
    path = F.concat(F.when(depth == 0, top).when(depth == 1, middle).otherwise(low), part)
    files = _table(spark, sf_dir, "documents").select(path.alias("path"), "text")
    rows = license_scan.with_inherited(license_scan.scan(files), Work(spark, "license-scan"))
    return rows.select(F.element_at(F.split("path", "/"), -1).cast("long").alias("doc_id"), "path", "own", "own_cosine",
                       "file", "file_cosine", "licence", "given_by")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text; the texts decoded from them are held against the originals."""
    vocabulary = pieces.Vocabulary.read()
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = pieces.decode(pieces.encode(docs, vocabulary), vocabulary)
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.taken_words(docs, Work(spark, "mixing")).select(
        "doc_id", "size", "source_size", "target", "taken", "first_slot")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.remove_lines(_table(spark, sf_dir, "documents"), Work(spark, "line-dedup"))
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vector_dedup.near_vectors(_table(spark, sf_dir, "embeddings"), Work(spark, "vector-dedup"))
    return rows.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), Work(spark, "near-dedup"),
                                       shingle=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "exact-dedup")
    index = exact_dedup.DigestIndex(spark, f"{work.folder}/index")
    rows = exact_dedup.deduplicate(_table(spark, sf_dir, "documents"), index, work)
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept",
                       F.lower(F.hex("digest")).alias("text_sha256"))


def op9_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = passage_dedup.remove_repeats(_table(spark, sf_dir, "documents"), Work(spark, "passage-dedup"))
    return rows.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.col("kept_sha").alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "warc")
    records = work.store(warc.read(warc.write(_table(spark, sf_dir, "pages"), work)))
    return warc.resolved(records).drop("url")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is null where a long cannot hold it, with some 10^8 vectors and more."""
    rows = whitening.whiten(_table(spark, sf_dir, "embeddings"), Work(spark, "whitening"), "vec_id", "embedding")
    return rows.select(F.col("id").alias("vec_id"), "component", "n", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"),
                       "whitened", "explained", "identity_error")


def damaged_turns(turns: DataFrame) -> DataFrame:
    """Rows changed by their key: dropped, emptied, without ends of sentences, repeated, or given to the user."""
    shown = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    fault = F.crc32(F.concat(shown["conv_id"], F.lit(":"), shown["turn"])) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(shown["text"], ".!?", "")).otherwise(shown["text"])
    return turns.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(shown["role"]).alias("role"), text.alias("text"),
                        (fault != 0).alias("present"),
                        F.explode(F.array_repeat(F.lit(1), F.when(fault == 3, 2).otherwise(1))).alias("copy"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_repair.repair(damaged_turns(_table(spark, sf_dir, "conversations")), present="present")
    return found.select(F.col("conv").alias("conv_id"), *conversation_repair.COUNTS, F.col("edits").alias("audit"),
                        F.col("digest").alias("repaired_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = quality.fit(docs, labels.filter(~held_out))
    return quality.score(docs.withColumn("held_out", held_out), model).select(
        "doc.doc_id", "doc.held_out", "quality.score", (F.col("quality.score") >= 0.7).cast("int").alias("predicted"),
        "quality.difference", "quality.good_bytes", "quality.bad_bytes")


QUERIES = {"op1_language_id": op1_language_id, "op2_license_scan": op2_license_scan, "op3_sentencepiece": op3_sentencepiece,
           "op4_mixing": op4_mixing, "op5_line_dedup": op5_line_dedup, "op6_vector_dedup": op6_vector_dedup, "op7_near_dedup": op7_near_dedup,
           "op8_exact_dedup": op8_exact_dedup, "op9_passage_dedup": op9_passage_dedup,
           "op10_warc": op10_warc, "op11_whitening": op11_whitening, "op12_repair": op12_repair, "op13_quality": op13_quality}

ORACLE = {
    "op5_line_dedup": r"""
        WITH l AS (
          SELECT doc_id, i, line, length(line) AS n,
                 regexp_matches(line, '[^\x20\x09-\x0D]') AS text_line
          FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                       unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents)),
        d AS (SELECT line, n, min((doc_id, i)) AS first FROM l WHERE text_line GROUP BY line, n),
        k AS (
          SELECT line, n, first, h, left(line, h) AS part, 'front' AS side
          FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM d WHERE n >= 16)
          UNION ALL
          SELECT line, n, first, h, right(line, h), 'back'
          FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM d WHERE n >= 16)),
        near AS (
          SELECT DISTINCT a.line FROM k a JOIN k b ON a.h = b.h AND a.side = b.side AND a.part = b.part
          WHERE b.first < a.first AND abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) <= 1),
        f AS (
          SELECT l.doc_id, l.i, l.line,
                 NOT l.text_line OR ((l.doc_id, l.i) = d.first AND near.line IS NULL) AS stays
          FROM l LEFT JOIN d ON l.text_line AND d.line = l.line LEFT JOIN near ON l.text_line AND near.line = l.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE NOT stays) AS n_removed,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE stays), '')) AS kept_sha256
        FROM f GROUP BY doc_id""".replace("\\\\", "\\"),
    "op6_vector_dedup": r"""
        WITH RECURSIVE v AS (
          SELECT vec_id, embedding::DOUBLE[64] AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
            AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AND len(embedding) = 64),
        l AS MATERIALIZED (
          SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
          WHERE array_cosine_similarity(a.e, b.e) >= 0.9),
        r(a, b) AS (
          SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
        SELECT t.vec_id, coalesce(n.k, 0) AS n_links, least(t.vec_id, coalesce(c.m, t.vec_id)) AS component_id,
               t.vec_id = least(t.vec_id, coalesce(c.m, t.vec_id)) AS kept
        FROM embeddings t LEFT JOIN (SELECT a, count(*) AS k FROM l GROUP BY a) n ON n.a = t.vec_id
        LEFT JOIN (SELECT a, min(b) AS m FROM r GROUP BY a) c ON c.a = t.vec_id""",
    "op12_repair": r"""
        WITH RECURSIVE k AS (
          SELECT *, list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, _:
            CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t,
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                           lambda ch: ascii(ch)::BIGINT) AS bytes
          FROM conversations),
        f AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 xor(list_reduce([4294967295] || bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fault
          FROM k),
        d AS (
          SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                 CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS copy
          FROM f WHERE fault <> 0),
        g AS (
          SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
                 right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS final FROM d),
        l AS (
          SELECT conv_id, turn, role, text, left(role, 1) AS r,
                 CASE WHEN final = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN final NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
                 row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before
          FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen)),
        c AS (
          SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                 count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                 count(*) FILTER (WHERE fault = 'truncated') AS truncated,
                 count(*) FILTER (WHERE before IS NOT NULL AND before || r NOT IN ('su', 'ua', 'au')) AS illegal
          FROM l GROUP BY conv_id),
        ins(q, p, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1),
                                (0, 3, 2), (1, 3, 2), (2, 2, 2), (3, 3, 2)),
        keep(q, r, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        way(conv_id, i, q, b) AS (
          SELECT conv_id, 0::BIGINT, 0, {'c': 0::BIGINT, 'a': ''} FROM c
          UNION ALL
          SELECT o.conv_id, o.i, o.p, min({'c': o.c, 'a': o.a}) FROM (
            SELECT way.conv_id, way.i + 1 AS i, e.p AS p, way.b.c + 2 * ins.n + e.c AS c, way.b.a || repeat('I', ins.n) || e.a AS a
            FROM way JOIN l ON l.conv_id IS NOT DISTINCT FROM way.conv_id AND l.i = way.i + 1 JOIN ins ON ins.q = way.q,
            LATERAL (
              SELECT ins.p AS p, 3 AS c, 'D' AS a
              UNION ALL SELECT CASE WHEN ins.p = 2 THEN 3 ELSE 2 END, 2 + (l.fault IS NOT NULL)::INT, 'R' WHERE coalesce(l.fault, '') NOT IN ('blank', 'duplicate')
              UNION ALL SELECT keep.p, (l.fault IS NOT NULL)::INT, 'K' FROM keep
                WHERE keep.q = ins.p AND keep.r = l.r AND coalesce(l.fault, '') NOT IN ('blank', 'duplicate')) e) o
          GROUP BY o.conv_id, o.i, o.p),
        best AS (
          SELECT c.conv_id, min({'c': way.b.c + 2 * ins.n, 'a': way.b.a || repeat('I', ins.n)}) AS b
          FROM c JOIN way ON way.conv_id IS NOT DISTINCT FROM c.conv_id AND way.i = c.n JOIN ins ON ins.q = way.q AND ins.p IN (0, 3)
          GROUP BY c.conv_id),
        s AS (
          SELECT conv_id, length(replace(b.a, 'D', '')) AS m, unnest(string_split(b.a, '')) AS e, generate_subscripts(string_split(b.a, ''), 1) AS x
          FROM best),
        p AS (
          SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS place
          FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY x)),
        h AS (
          SELECT p.conv_id, string_agg(
            CASE WHEN e = 'K' THEN l.role WHEN (place - m % 2) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(l.text, ''),
            chr(10) ORDER BY place) AS whole
          FROM p LEFT JOIN l ON l.conv_id IS NOT DISTINCT FROM p.conv_id AND l.i = p.i AND p.e <> 'I'
          WHERE p.e NOT IN ('D', '') GROUP BY p.conv_id)
        SELECT o.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
               coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, coalesce(best.b.c, 0) AS cost,
               coalesce(best.b.a, '') AS audit, sha256(coalesce(h.whole, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM o.conv_id""",
    "op10_warc": r"""
        WITH p AS (
          SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
          FROM pages),
        f AS (
          SELECT *, CASE WHEN payload_bytes >= 100
                    THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit'
                    ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
        FROM f""",
    "op8_exact_dedup": r"""
        WITH n AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
          FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER w = 1 AS kept, text_sha256
        FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST)""",
}
