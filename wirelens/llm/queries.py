"""Registered queries of the corpus operators, with SQL checks where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirelens.llm import bpe, decontaminate, fim, licenses, line_dedup, minhash, quality_ledger, repeats, search, shards, toxicity, url_rules, warc
from wirelens.llm.frames import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"), url_rules.rules_frame(spark))


def op3_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_ledger.ledger(table(spark, sf_dir, "documents"))
    judged = quality_ledger.apply_policy(quality_ledger.apply_policy(book, "base", "base_ok"), "v1")
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~F.col("base_ok")).alias("base_failed"), "kept", "fail_bits",
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard_documents(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_classes(table(spark, sf_dir, "documents"), short_lines=True)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.fill_in_middle(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_url_filters": op2_url_filters,
    "op3_quality_ledger": op3_quality_ledger,
    "op4_licenses": op4_licenses,
    "op5_bpe": op5_bpe,
    "op6_sharding": op6_sharding,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_search": op11_search,
    "op12_substrings": op12_substrings,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    "op7_decontamination": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents
), t AS (
  SELECT row_number() OVER () AS ix, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM benchmark
), dp AS (SELECT rid, w, unnest(range(0, len(w) - 5)) AS i FROM d WHERE len(w) >= 6),
tp AS (SELECT ix, w, unnest(range(0, len(w) - 5)) AS j FROM t WHERE len(w) >= 6),
ds AS (
  SELECT rid, i, 0 AS m, [w[i+1], w[i+2], w[i+3], w[i+5], w[i+6]] AS k FROM dp
  UNION ALL SELECT rid, i, 1, [w[i+1], w[i+2], w[i+3], w[i+4], w[i+6]] FROM dp
), ts AS (
  SELECT ix, j, 0 AS m, [w[j+1], w[j+2], w[j+3], w[j+5], w[j+6]] AS k FROM tp
  UNION ALL SELECT ix, j, 1, [w[j+1], w[j+2], w[j+3], w[j+4], w[j+6]] FROM tp
), al AS (
  SELECT DISTINCT rid, ix, i - j AS shift FROM ds JOIN ts USING (m, k)
), pos AS (
  SELECT al.rid, al.ix, shift, len(t.w) AS n, p, CASE WHEN d.w[p + shift + 1] = t.w[p + 1] THEN 1 ELSE -4 END AS s
  FROM (SELECT al.*, unnest(range(0, (SELECT max(len(w)) FROM t))) AS p FROM al) al
  JOIN d USING (rid) JOIN t USING (ix) WHERE p < len(t.w) AND p + shift >= 0 AND p + shift < len(d.w)
), pre AS (
  SELECT *, sum(s) OVER w AS e, sum(CASE WHEN s = 1 THEN 1 ELSE 0 END) OVER w AS h FROM pos
  WINDOW w AS (PARTITION BY rid, ix, shift ORDER BY p)
), seg AS (
  SELECT x.rid, x.ix, x.shift, x.n, y.p AS b, x.p + 1 AS stop, x.e - (y.e - y.s) AS score,
    x.h - y.h + CASE WHEN y.s = 1 THEN 1 ELSE 0 END AS matched
  FROM pre x JOIN pre y ON x.rid = y.rid AND x.ix = y.ix AND x.shift = y.shift AND y.p <= x.p
), best AS (
  SELECT * FROM seg QUALIFY row_number() OVER (PARTITION BY rid, ix, shift ORDER BY score DESC, stop, b DESC) = 1
), ok AS (
  SELECT * FROM best WHERE score > 0 AND stop - b >= least(13, n)
  QUALIFY row_number() OVER (PARTITION BY rid, ix ORDER BY score DESC, b + shift, b) = 1
)
SELECT doc_id, item_id, (stop - b)::BIGINT AS overlap_words, matched::BIGINT AS matched_words,
  (b + shift)::BIGINT AS doc_start, b::BIGINT AS item_start
FROM ok JOIN d USING (rid) JOIN t USING (ix)
""",
    "op11_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents
), q AS (
  SELECT row_number() OVER () AS x, item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), totals AS (
  SELECT count(*)::BIGINT AS n, sum(len(w))::BIGINT AS l FROM d WHERE len(w) > 0
), qt AS (
  SELECT DISTINCT x, t FROM (SELECT x, unnest(w) AS t FROM q)
), tf AS (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM qt) GROUP BY r, t
), df AS (
  SELECT t, floor(1000 * ln((2 * n + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, totals GROUP BY t, n
), norms AS (
  SELECT r, doc_id, 10 + ((90 * len(w) * n) // l) AS m FROM d, totals WHERE len(w) > 0
), scores AS (
  SELECT x, r, doc_id, sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM qt JOIN tf USING (t) JOIN df USING (t) JOIN norms USING (r) GROUP BY x, r, doc_id
), best AS (
  SELECT *, row_number() OVER (PARTITION BY x ORDER BY score DESC, doc_id, r) AS rank FROM scores WHERE score > 0
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best JOIN q USING (x) WHERE rank <= 10
""",
    "op12_substrings": r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), wins AS (
  SELECT r, i, array_to_string(list_slice(w, i, i + 34), ' ') AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM t WHERE len(w) >= 35)
), spots AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY g) AS c FROM wins) WHERE c >= 2
), gone AS (
  SELECT DISTINCT r, i + k AS i FROM spots, (SELECT unnest(range(0, 35)) AS k)
), words AS (
  SELECT r, w[i] AS word, i FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM t)
), kept AS (
  SELECT r, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (r)
""",
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
    sha256('7:' || doc_id) AS k FROM documents
), h AS (
  SELECT *, len(u) AS n, ('0x' || substr(k, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(k, 9, 8))::BIGINT % (len(u) + 1) AS c2,
    text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain,
    ('0x' || substr(k, 25, 8))::BIGINT % 100 < 50 AS spm FROM t
), parts AS (
  SELECT doc_id, n, text, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form,
    array_to_string(u[:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1 : greatest(c1, c2)], '') AS m,
    array_to_string(u[greatest(c1, c2) + 1 :], '') AS s FROM h
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END)
    AS output_sha256, sha256(text) AS restored_sha256
FROM parts
""",
    "op1_minhash": r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
    lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM t WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), sets AS (
  SELECT doc_id, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id
), reps AS (
  SELECT k, min(doc_id) AS rep FROM sets GROUP BY k
), rs AS (
  SELECT doc_id, g FROM s WHERE doc_id IN (SELECT rep FROM reps)
), inter AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM rs x JOIN rs y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM inter JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), twoway AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(node, seen) AS (
  SELECT rep, rep FROM reps
  UNION
  SELECT twoway.b, reach.seen FROM reach JOIN twoway ON reach.node = twoway.a
), comp AS (
  SELECT node, min(seen) AS c FROM reach GROUP BY node
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, d.doc_id) AS component_id, coalesce(c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id
LEFT JOIN reps ON reps.k = sets.k LEFT JOIN comp ON comp.node = reps.rep
""",
    "op8_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (
  SELECT page_id, n, d, min(page_id) OVER (PARTITION BY d) AS first FROM p
)
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
""",
    "op2_url_filters": r"""
WITH rules(rhost, rpath, v) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), cut AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0
    THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT p.host, p.path, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(v, length(rhost || rpath)) AS verdict
  FROM (SELECT DISTINCT host, path FROM parts) p
  JOIN rules ON (p.host = rhost OR ends_with(p.host, '.' || rhost)) AND starts_with(p.path, rpath)
  GROUP BY p.host, p.path
)
SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.host = f.host AND p.path = f.path
""",
    "op3_quality_ledger": r"""
WITH t AS (
  SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), grams AS (
  SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)
), spots AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM grams) WHERE c >= 2
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM spots, (VALUES (0), (1), (2)) v(k) GROUP BY r
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_capitals
  FROM t LEFT JOIN rep USING (r)
), b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * word_chars < 5 * n_words OR word_chars > 12 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_capitals > 3 * word_chars THEN 32 ELSE 0 END AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits::BIGINT AS fail_bits FROM b
""",
}
