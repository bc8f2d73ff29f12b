"""The registered queries of the training-data operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontaminate, fim, lines, lm, minhash, mixing, quality, spelling, tokens, toxicity, urls, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(_table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mix_report(mixing.sizes(_table(spark, sf_dir, "documents")))
    return report.select(report["key"].alias("doc_id"), "size", "source_size", "target", "taken", "source")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_verdicts(_table(spark, sf_dir, "pages"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_report(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_report(_table(spark, sf_dir, "documents"), minhash.Near(shingle=4, percent=80))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(_table(spark, sf_dir, "pages"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leak_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_report(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fim_report(_table(spark, sf_dir, "documents"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_report(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op2_mix_sources": op2_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_warc": op7_warc,
    "op8_quality_rules": op8_quality_rules,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_url_filters": op10_url_filters,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_byte_bpe": op13_byte_bpe,
}

_WORD = r"'[^\x20\x09-\x0D]+'"



def _quality_sql(rules: quality.QualityRules) -> str:
    """What quality_report states, over words and lines as rows; windows of five words are equal if their words are."""
    teaser = rf"(\.\.\.|…)[\x20\x09-\x0D]*(\[?({'|'.join(rules.leads_on)})\]?)?[\x20\x09-\x0D»>]*$"
    phrases = " OR ".join(f"contains(lower(line), '{p}')" for p in rules.boilerplate)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT k, unnest(regexp_extract_all(t, {_WORD})) AS w, generate_subscripts(regexp_extract_all(t, {_WORD}), 1) AS i FROM d),
        g AS (SELECT k, i, row(w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS five, lead(w, 4) OVER o IS NOT NULL AS whole
              FROM w WINDOW o AS (PARTITION BY k ORDER BY i)),
        twice AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, five) AS c FROM g WHERE whole) WHERE c > 1),
        r AS (SELECT k, count(DISTINCT i + j) AS n FROM twice, range(5) s(j) GROUP BY k),
        l AS (SELECT k, line, len(regexp_extract_all(line, {_WORD})) AS n FROM (SELECT k, unnest(string_split(t, chr(10))) AS line FROM d)
              WHERE regexp_matches(line, {_WORD})),
        f AS (SELECT k, line, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
                     length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) > n * {rules.max_symbols}::DOUBLE
                     OR (len(regexp_extract_all(line, '[|»•·]')) >= {rules.min_bars} AND len(regexp_extract_all(line, '[|»•·]')) >= n * {rules.max_bars}::DOUBLE)
                     OR (n >= 5 AND len(list_filter(regexp_extract_all(line, {_WORD}), lambda x: regexp_matches(x, '\\p{{Lu}}.*\\p{{Lu}}')
                         AND NOT regexp_matches(x, '\\p{{Ll}}'))) > n * {rules.max_shouted}::DOUBLE)
                     OR (n <= {rules.boilerplate_words} AND ({phrases} OR regexp_matches(lower(line), '{teaser}'))) AS bad
              FROM l),
        s AS (SELECT k, count(*) - count(DISTINCT line) AS dup, count(*) FILTER (bad) AS bad, sum(chars) FILTER (NOT bad) AS kept_chars FROM f GROUP BY k),
        c AS (SELECT k, doc_id, len(regexp_extract_all(t, {_WORD}))::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                     (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols FROM d),
        b AS (SELECT c.*, coalesce(s.dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(s.bad, 0)::BIGINT AS n_bad_lines,
                     coalesce(kept_chars, 0) AS kept_chars FROM c LEFT JOIN s USING (k) LEFT JOIN r USING (k))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND kept_chars >= word_chars * {rules.min_kept}::DOUBLE AS kept, n_bad_lines
        FROM (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed FROM b)"""


def _crc_table() -> list[int]:
    """The crc32 of each byte, before the last complement: eight shifts, each with the polynomial where a bit falls out."""
    table = list(range(256))
    for _ in range(8):
        table = [x >> 1 ^ (0xEDB88320 if x & 1 else 0) for x in table]
    return table


def _spelling_sql(s: spelling.Spelling) -> str:
    """What spelling_report states. Pairs are found by leaving out each letter: two words of one length are one
    replacement apart if they agree without the same letter; the longer of two lengths is the other one without a letter."""
    return f"""
        WITH RECURSIVE r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
            unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
        g AS (SELECT id, run, count(*) AS c FROM r WHERE length(run) >= {s.min_chars} GROUP BY id, run),
        h AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(
                flatten(list_transform(string_split(id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)] ELSE [195, unicode(x) - 64] END)),
                lambda x: x::BIGINT)), lambda a, b: xor(a >> 8, CAST({_crc_table()} AS BIGINT[])[(xor(a, b) & 255) + 1]))) AS h FROM g),
        d AS (SELECT CASE WHEN h % {s.damage} = 0 THEN left(run, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM h),
        w AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM d WHERE length(word) >= {s.min_chars} GROUP BY word HAVING sum(c) >= {s.min_count}),
        v AS (SELECT word, n, length(word) AS l, i, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM w)),
        p AS (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM v a JOIN v b USING (less, i, l) WHERE a.word <> b.word
              UNION SELECT v.word, v.n, w.word, w.n FROM v JOIN w ON v.less = w.word UNION SELECT w.word, w.n, v.word, v.n FROM v JOIN w ON v.less = w.word),
        b AS (SELECT word, count(*) AS n_near, min({{'less': -other_n, 'form': other}}) AS best FROM p GROUP BY word),
        f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.less >= {s.times} * w.n THEN best.form END AS form,
                     CASE WHEN -best.less >= {s.times} * w.n THEN -best.less END AS form_n FROM w LEFT JOIN b USING (word)),
        t AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT t.word, f.form, step + 1 FROM t JOIN f ON t.root = f.word WHERE f.form IS NOT NULL),
        e AS (SELECT word, max_by(root, step) AS root FROM t GROUP BY word)
        SELECT word, form, root, n, n_near, form_n FROM f JOIN e USING (word)"""


def _fim_sql(f: fim.Fim) -> str:
    """What fim_report states, over arrays of units."""
    p, s, m = f.sentinels
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                          sha256('{f.seed}' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        e AS (SELECT doc_id, t, u, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 8 * i + 1, 8) AS BIGINT) FOR i IN range(4)] AS h FROM d),
        c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                     CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}') OR h[3] % 100 >= {f.changed_percent} THEN 'plain'
                          WHEN h[4] % 100 < {f.spm_percent} THEN 'spm' ELSE 'psm' END AS form FROM e),
        x AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{p}', pre, '{s}', suf, '{m}', mid) ELSE concat('{s}', suf, '{p}', pre, '{m}', mid) END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM x"""


ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": _spelling_sql(spelling.Spelling()),
    "op12_fill_in_middle": _fim_sql(fim.Fim()),
    "op8_quality_rules": _quality_sql(quality.QualityRules()),
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes FROM pages),
        l AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS largest FROM p)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN largest IS NOT NULL AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id <> largest THEN largest END AS refers_to, true AS checked
        FROM l""",
    "op2_mix_sources": f"""
        WITH d AS (
            SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORD})) AS BIGINT) AS size,
                   md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')) AS shuffle
            FROM documents),
        t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (
            SELECT *, 2 * source_size AS most,
                   [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
            FROM t),
        l AS (
            SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(most) OVER before, 0))
                      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
            FROM w
            WINDOW before AS (ORDER BY CAST(most AS DOUBLE) / weight, source NULLS LAST
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        g AS (
            SELECT source, source_size,
                   least(CAST(most AS DOUBLE), coalesce(weight * max(CASE WHEN level <= CAST(most AS DOUBLE) / weight THEN level END)
                         OVER (), CAST(most AS DOUBLE))) AS target
            FROM l),
        s AS (
            SELECT d.doc_id, d.source, d.size, g.source_size, g.target, CAST(floor(g.target + 0.5) AS BIGINT) AS words,
                   sum(d.size) OVER (PARTITION BY d.source ORDER BY shuffle, doc_id, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size AS start
            FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
        SELECT doc_id, size, source_size, target, source,
               CAST(CASE WHEN source_size = 0 THEN 0
                         ELSE size * (words // source_size)
                              + greatest(0, least(size, words % source_size - start)) END AS BIGINT) AS taken
        FROM s""",
}
