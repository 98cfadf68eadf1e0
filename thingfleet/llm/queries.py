"""The registered queries of this subpackage, their digests and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thingfleet.session import scratch

from . import chat_format, circulant_minhash, decontaminate, filter_audit, html_extract, jaccard_join, line_runs, lm_score, packing, quality_rules, suffix_dedup, token_files, turn_repair
from .common import prepared, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        decontaminate.is_contaminated().alias("contaminated"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    lengths = F.transform("removed", lambda r: r["end"] - r["start"])
    return out.select(
        "doc_id",
        "n_bytes",
        F.aggregate(lengths, F.lit(0), lambda a, x: a + x).cast("long").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark, 500)
    out = html_extract.extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return jaccard_join.grouped(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_runs.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("new_text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return lm_score.score(table(spark, sf_dir, "documents"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    said = "<|im_end|><|im_start|>assistant ok"
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")
    )
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return chat_format.digests(chat_format.format_paths(chat_format.chains(turns.unionByName(planted))))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    target = scratch(spark, "token-files")
    token_files.write_tokens(token_files.tokenized(table(spark, sf_dir, "documents")), target)
    return token_files.digests(spark, target)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.drop("ids")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    return turn_repair.audit_table(table(spark, sf_dir, "conversations"))


def op13_circulant_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepared(spark)
    out = circulant_minhash.grouped(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate,
        op2_suffix_dedup,
        op3_html_extract,
        op4_jaccard_join,
        op5_line_dedup,
        op6_quality_rules,
        op7_lm_score,
        op8_chat_format,
        op9_token_files,
        op10_packing,
        op11_filter_audit,
        op12_turn_repair,
        op13_circulant_minhash,
    )
}

SQL: dict[str, str] = {
    "op5_line_dedup": r"""
        WITH l AS (
            SELECT doc_id, generate_subscripts(p, 1) AS no, unnest(p) AS line
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)),
        k AS (
            SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
        s AS (
            SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines,
            count(*) FILTER (WHERE s.key IS NOT NULL AND doc_id <> last_doc) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY no)
                FILTER (WHERE s.key IS NULL OR doc_id = last_doc), '')) AS kept_sha256
        FROM k LEFT JOIN s USING (key) GROUP BY doc_id""",
    "op1_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (
            SELECT item_id, w, least(13, len(w)) AS n FROM (
                SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)
            WHERE len(w) > 0),
        bw AS (
            SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
        dw AS (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM b))),
        h AS (SELECT doc_id, item_id, i, dw.n FROM dw JOIN bw USING (n, win)),
        c AS (
            SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h))
            GROUP BY doc_id),
        t AS (
            SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY doc_id)
        SELECT doc_id, coalesce(len(w), 0) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
        FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
            WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (
            SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
            WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
        r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
        FROM (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_filter_audit": r"""
        WITH w AS (
            SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        f AS (
            SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
                CASE WHEN len(w) < 200 THEN 'A' ELSE '' END
                || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
                || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END
                || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
                || CASE WHEN w.doc_id > min(w.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END AS fails
            FROM w LEFT JOIN l ON w.doc_id = l.doc_id),
        c AS (
            SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
            FROM f GROUP BY ALL),
        x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
        o AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM x a, x b, x c, x d, x e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
        g AS (SELECT filter_order, CAST(unnest(range(1, 6)) AS INTEGER) AS step FROM o),
        s AS (
            SELECT part, filter_order, step, filter_order[step] AS letter, n, good, toxic,
                contains(fails, filter_order[step]) AS failing,
                len(translate(filter_order[:step - 1], fails, '')) < step - 1 AS gone,
                fails = filter_order[step] AS alone
            FROM c, g),
        r AS (
            SELECT part, filter_order, step, letter,
                coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failing), 0)::BIGINT AS kept,
                coalesce(sum(n) FILTER (WHERE NOT gone AND failing), 0)::BIGINT AS removed,
                coalesce(sum(n) FILTER (WHERE gone AND failing), 0)::BIGINT AS redundant,
                coalesce(sum(n) FILTER (WHERE alone), 0)::BIGINT AS unique_fails,
                coalesce(sum(good) FILTER (WHERE NOT gone AND failing), 0)::BIGINT AS good_lost,
                coalesce(sum(toxic) FILTER (WHERE NOT gone AND failing), 0)::BIGINT AS toxic_lost
            FROM s GROUP BY ALL)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
            (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley
        FROM r""",
    "op13_circulant_minhash": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g)
            WHERE a.doc_id <> b.doc_id GROUP BY ALL),
        e AS (
            SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id
            WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
        r AS (SELECT doc_id, doc_id AS o FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.o = e.x)
        SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
        FROM (SELECT doc_id, min(o) AS component_id FROM r GROUP BY doc_id) LEFT JOIN n USING (doc_id)""",
}
