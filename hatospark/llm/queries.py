"""Registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import (
    decontamination,
    html_text,
    language_id,
    line_dedup,
    merkle,
    mixing,
    quality_classifier,
    quality_rules,
    simhash,
    spelling,
    substring_dedup,
    token_counts,
    token_files,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    ).drop("version")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.languages(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), path)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(_table(spark, sf_dir, "documents")).drop("version")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(_table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.token_files(_table(spark, sf_dir, "documents"), path)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_html_text,
        op3_mixing,
        op4_language_id,
        op5_token_counts,
        op6_quality_classifier,
        op7_substring_dedup,
        op8_simhash,
        op9_line_dedup,
        op10_quality_rules,
        op11_spelling_variants,
        op12_token_files,
        op13_merkle,
    )
}

#: The same results by other means, where SQL has any; the others are tested against brute force.
ORACLE: dict[str, str] = {
    # All windows of 13 tokens: a window with two substitutions keeps four tokens in a row.
    "op1_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS h
            FROM documents),
        b AS (
            SELECT min(item_id) AS item_id, h FROM (
                SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda x: x <> '') AS h
                FROM benchmark) WHERE len(h) >= 8 GROUP BY h),
        dp AS (SELECT doc_id, h, unnest(range(1, len(h) - 2)) AS i FROM d),
        bp AS (SELECT item_id, h, unnest(range(1, len(h) - 2)) AS j FROM b),
        dk AS (SELECT doc_id, i, concat_ws(' ', h[i], h[i+1], h[i+2], h[i+3]) AS k FROM dp),
        bk AS (SELECT item_id, j, concat_ws(' ', h[j], h[j+1], h[j+2], h[j+3]) AS k FROM bp),
        shifts AS (SELECT DISTINCT doc_id, item_id, i - j AS s FROM dk JOIN bk USING (k)),
        pair AS (
            SELECT doc_id, item_id, s, d.h AS x, b.h AS y, least(13, len(b.h)) AS w,
                   greatest(1, 1 - s) AS first, least(len(b.h), len(d.h) - s) AS last
            FROM shifts JOIN d USING (doc_id) JOIN b USING (item_id)),
        starts AS (SELECT *, unnest(range(first, last - w + 2)) AS j FROM pair),
        scored AS (
            SELECT doc_id, item_id, s, j, w, len(y) AS n,
                   len(list_filter(range(0, w), lambda k: x[j + s + k] = y[j + k])) AS equal
            FROM starts),
        best AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id, item_id
                                         ORDER BY equal DESC, j + s, j DESC) AS place
            FROM scored WHERE equal >= w - CASE WHEN n >= 13 THEN 2 ELSE 0 END)
        SELECT doc_id, item_id, CAST(j + s - 1 AS INT) AS doc_start, CAST(j - 1 AS INT) AS item_start,
               CAST(w AS INT) AS n_tokens, CAST(equal AS INT) AS n_equal
        FROM best WHERE place = 1""",
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
                   CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS k
            FROM documents),
        s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                   [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
            FROM d GROUP BY source),
        levels AS (
            SELECT max((total - before) / after) AS level FROM (
                SELECT 1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total,
                       (SELECT coalesce(sum(2.0::DOUBLE * y.source_size), 0) FROM s y
                        WHERE 2.0::DOUBLE * y.source_size / y.w < 2.0::DOUBLE * x.source_size / x.w) AS before,
                       (SELECT sum(y.w) FROM s y
                        WHERE 2.0::DOUBLE * y.source_size / y.w >= 2.0::DOUBLE * x.source_size / x.w) AS after
                FROM s x)),
        t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, level * w) AS target FROM s, levels),
        run AS (
            SELECT doc_id, d.source, size, source_size, target,
                   CAST(round(target) AS BIGINT) // greatest(source_size, 1) AS passes,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id
                                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
        SELECT doc_id, source, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(passes * size + greatest(0, least(size, CAST(round(target) AS BIGINT)
                    - passes * source_size - before)) AS BIGINT) AS taken
        FROM run""",
    # One edit leaves one half of a line untouched; linked lines are then followed as far as they go.
    "op9_line_dedup": r"""
        WITH RECURSIVE cut AS (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                   generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
            FROM documents WHERE doc_id IS NOT NULL),
        place AS (
            SELECT doc_id, line_no, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line
            FROM cut WHERE trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> ''),
        lines AS (SELECT line, length(line) AS n, count(*) AS times FROM place GROUP BY line),
        half AS (
            SELECT line, n, m, ((m - 1) // 2)::INT AS k FROM (
                SELECT line, n, unnest([n, n - 1]) AS m FROM lines WHERE n >= 20)),
        met AS (
            SELECT a.line AS a, b.line AS b FROM half a JOIN half b
              ON a.m = b.m AND left(a.line, a.k) = left(b.line, b.k)
            WHERE a.line <> b.line AND abs(a.n - b.n) <= 1
            UNION
            SELECT a.line, b.line FROM half a JOIN half b
              ON a.m = b.m AND right(a.line, a.k) = right(b.line, b.k)
            WHERE a.line <> b.line AND abs(a.n - b.n) <= 1),
        near AS (
            SELECT a, b FROM met WHERE length(a) >= length(b) AND len(list_filter(range(1, length(a) + 1),
                lambda i: left(a, i - 1) = left(b, i - 1) AND right(a, length(a) - i) = right(b, length(a) - i)
                          AND (length(b) = length(a) OR length(b) = length(a) - 1
                               AND left(b, i - 1) || right(b, length(a) - i) = b))) > 0),
        link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
        reach AS (
            SELECT a AS line, a AS other FROM link
            UNION
            SELECT r.line, l.b FROM reach r JOIN link l ON l.a = r.other),
        member AS (
            SELECT line, other FROM reach
            UNION ALL
            SELECT line, line FROM lines WHERE line NOT IN (SELECT a FROM link)),
        firsts AS (SELECT line, min((doc_id, line_no)) AS f FROM place GROUP BY line),
        class AS (
            SELECT m.line, CAST(sum(l.times) AS BIGINT) AS times, min(f) AS f
            FROM member m JOIN lines l ON l.line = m.other JOIN firsts ON firsts.line = m.other
            GROUP BY m.line)
        SELECT doc_id, CAST(line_no AS INT) AS line_no, struct_extract_at(f, 1) AS first_doc_id,
               CAST(struct_extract_at(f, 2) AS INT) AS first_line_no, times,
               times <= 6 OR f = (doc_id, line_no) AS kept
        FROM place JOIN class USING (line)""",
    # The logarithm is that of the bins' growth, 1.02.
    "op10_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, lang, source, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        win AS (
            SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS k
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        twice AS (SELECT doc_id, k FROM win GROUP BY doc_id, k HAVING count(*) > 1),
        repeated AS (
            SELECT doc_id, count(DISTINCT place) AS n
            FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM win JOIN twice USING (doc_id, k))
            GROUP BY doc_id),
        dup AS (
            SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS lines
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (
            SELECT doc_id, lang, source, len(w) AS n_words,
                   coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
                   len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
                   coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words,
                   coalesce(dup.lines, 0) AS n_lines
            FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN repeated USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 2 * n_repeat_words > n_words AS base_failed FROM m),
        v AS (
            SELECT doc_id, lang, source, base_failed,
                   unnest(['symbols', 'lines', 'repeats', 'length']) AS metric,
                   unnest([0.01, 0.1, 0.05, 0.1])::DOUBLE AS slack,
                   unnest([n_symbols / greatest(n_words, 1), n_dup_lines / greatest(n_lines, 1),
                           n_repeat_words / greatest(n_words, 1), word_chars / greatest(n_words, 1)]) AS value
            FROM b),
        bins AS (
            SELECT lang, source, metric, slack, count(*) AS n,
                   CASE WHEN value > 0.0001::DOUBLE
                        THEN greatest(ceil(ln(value / 0.0001::DOUBLE) / 0.01980262729617973::DOUBLE), 0) ELSE 0 END AS bin
            FROM v WHERE NOT base_failed GROUP BY ALL),
        -- Every group, and all groups together for those under 20 documents.
        scoped AS (
            SELECT false AS whole, * FROM bins
            UNION ALL SELECT true, NULL, NULL, metric, slack, n, bin FROM bins),
        ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY whole, lang, source, metric ORDER BY bin) AS upto,
                   sum(n) OVER (PARTITION BY whole, lang, source, metric) AS total,
                   CASE WHEN bin = 0 THEN 0 ELSE 0.0001::DOUBLE * pow(1.02::DOUBLE, bin - 0.5) END AS middle
            FROM scoped),
        quartiles AS (
            SELECT whole, lang, source, metric, slack, total, min(middle) FILTER (4 * upto >= total) AS low,
                   min(middle) FILTER (4 * upto >= 3 * total) AS high
            FROM ranked GROUP BY ALL),
        sizes AS (SELECT lang, source, count(*) FILTER (NOT base_failed) AS n FROM b GROUP BY ALL),
        verdict AS (
            SELECT doc_id, bool_and(value <= high + 3 * (high - low + q.slack)
                                    AND value >= low - 3 * (high - low + q.slack)) AS inside
            FROM v JOIN sizes z ON z.lang IS NOT DISTINCT FROM v.lang AND z.source IS NOT DISTINCT FROM v.source
            LEFT JOIN quartiles q ON q.metric = v.metric AND q.whole = (z.n < 20)
                 AND (q.whole OR (q.lang IS NOT DISTINCT FROM v.lang AND q.source IS NOT DISTINCT FROM v.source))
            GROUP BY doc_id)
        SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
               CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
               CAST(n_repeat_words AS BIGINT) AS n_repeat_words, CAST(n_lines AS BIGINT) AS n_lines, base_failed,
               NOT base_failed AND coalesce(inside, false) AS kept
        FROM b JOIN verdict USING (doc_id)""",
    # Words that differ by a replaced letter share what stands around it; the others lack one letter.
    "op11_spelling_variants": r"""
        WITH RECURSIVE run AS (
            SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{6,}')),
                                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
            FROM documents),
        each AS (SELECT doc_id, w, count(*) AS times FROM run GROUP BY doc_id, w),
        hashed AS (
            SELECT w, times, xor(4294967295, list_reduce(
                       flatten(list_transform(string_split(doc_id || ':' || w, ''), lambda c: CASE
                           WHEN ord(c) < 128 THEN [ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[]
                           ELSE [192 + (ord(c) >> 6), 0, 0, 0, 0, 0, 0, 0,
                                 128 + (ord(c) & 63), 0, 0, 0, 0, 0, 0, 0]::BIGINT[] END)),
                       lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)), 4294967295::BIGINT)) AS h
            FROM each),
        word AS (
            SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
                SELECT times, CASE WHEN h % 199 = 0
                                   THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word
                FROM hashed)
            WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
        gap AS (
            SELECT word, n, i, left(word, i - 1) AS l, substr(word, i + 1) AS r
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
        less AS (SELECT DISTINCT word, n, l || r AS short FROM gap),
        near AS (
            SELECT a.word, a.n, b.word AS other, b.n AS other_n
            FROM gap a JOIN gap b ON a.i = b.i AND a.l = b.l AND a.r = b.r AND a.word <> b.word
            UNION ALL
            SELECT less.word, less.n, w.word, w.n FROM less JOIN word w ON w.word = short
            UNION ALL
            SELECT w.word, w.n, less.word, less.n FROM less JOIN word w ON w.word = short),
        best AS (
            SELECT word, count(*) AS n_near, max(other_n) AS form_n,
                   min(other) FILTER (other_n = top) AS form
            FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word),
        formed AS (
            SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form,
                   CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
            FROM word LEFT JOIN best USING (word)),
        chain AS (
            SELECT word, form AS reached FROM formed WHERE form IS NOT NULL
            UNION ALL
            SELECT chain.word, f.form FROM chain JOIN formed f ON f.word = reached WHERE f.form IS NOT NULL),
        ends AS (SELECT chain.word, reached FROM chain JOIN formed f ON f.word = reached WHERE f.form IS NULL)
        SELECT word, form, coalesce(reached, word) AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n
        FROM formed LEFT JOIN ends USING (word)""",
    # The register of the CRC-32 takes eight steps a character of the id; trees rise level by level.
    "op13_merkle": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, lang, n_chars,
                   concat(coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-'),
                          coalesce(strlen(source) || ':' || source, '-'),
                          coalesce(strlen(lang) || ':' || lang, '-')) AS head,
                   coalesce(strlen(text) || ':' || text, '-') AS tail,
                   list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                                                      lambda c: [ord(c), 0, 0, 0, 0, 0, 0, 0]::BIGINT[])),
                               lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)),
                               4294967295::BIGINT) AS reg
            FROM documents),
        leaf AS (
            SELECT doc_id, lang, sha256(concat(head, coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-'), tail)) AS h,
                   sha256(concat(head, strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), tail)) AS other,
                   xor(reg, 4294967295) % 7 = 0 AND n_chars IS NOT NULL AS tampered
            FROM d),
        ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
                   count(*) OVER (PARTITION BY lang) AS n,
                   dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g
            FROM leaf),
        node AS (
            SELECT g, 0 AS level, i, h, n FROM ranked
            UNION ALL
            SELECT g, level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2
            FROM node WHERE n > 1 GROUP BY g, level, i // 2),
        sub AS (SELECT g, level AS depth, h AS subroot FROM node WHERE n = 1),
        top AS (
            SELECT 0 AS level, g AS i, subroot AS h, (SELECT count(*) FROM sub) AS n FROM sub
            UNION ALL
            SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (max(n) + 1) // 2
            FROM top WHERE n > 1 GROUP BY level, i // 2),
        goal AS (SELECT level AS height, h AS root FROM top WHERE n = 1),
        member AS (
            SELECT g, level, i, h FROM node WHERE n > 1
            UNION ALL
            SELECT g, depth + level, i, top.h FROM top, (SELECT g, depth FROM sub)),
        step AS (
            SELECT doc_id, g, i AS place, depth + height AS steps, depth,
                   CASE WHEN tampered THEN other ELSE h END AS folded, 0 AS lev, i AS x, '' AS proof
            FROM ranked JOIN sub USING (g), goal
            UNION ALL
            SELECT doc_id, s.g, place, steps, depth,
                   sha256(CASE WHEN m.h IS NULL THEN folded
                               WHEN y % 2 = 1 THEN m.h || folded ELSE folded || m.h END),
                   lev + 1, CASE WHEN lev + 1 = depth THEN s.g ELSE y // 2 END, proof || coalesce(m.h, '')
            FROM (SELECT *, CASE WHEN lev = depth THEN g ELSE x END AS y FROM step WHERE lev < steps) s
            LEFT JOIN member m ON m.g = s.g AND m.level = s.lev AND m.i = xor(s.y, 1)),
        done AS (SELECT * FROM step WHERE lev = steps)
        SELECT r.doc_id, r.h AS leaf, subroot, root, sha256(proof) AS proof_sha256, folded AS folded_root,
               folded = root AS verified
        FROM done JOIN ranked r ON r.g = done.g AND r.i = place JOIN sub ON sub.g = r.g, goal""",
}
