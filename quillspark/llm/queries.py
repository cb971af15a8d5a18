"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.align import align_tokens
from quillspark.llm.common import documents
from quillspark.llm.decontaminate import decontaminate
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.language import identify
from quillspark.llm.license import BASE, TEMPLATES, THRESHOLD, license_scan
from quillspark.llm.line_dedup import MIN_DOCS, dedup_lines
from quillspark.llm.packing import best_fit_pack, matrix_digests, pack_matrix
from quillspark.llm.quality import importance_resample
from quillspark.llm.simhash import near_duplicates
from quillspark.llm.spelling import spelling_variants
from quillspark.llm.substring_bytes import remove_repeated_bytes
from quillspark.llm.substring_words import remove_repeated_windows


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resample(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix_digests(pack_matrix(documents(spark, sf_dir)))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(documents(spark, sf_dir))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(documents(spark, sf_dir)).drop("kept")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(documents(spark, sf_dir)).drop("removed")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(documents(spark, sf_dir))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(documents(spark, sf_dir), with_groups=False)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(documents(spark, sf_dir)).drop("keep", "kept")


QUERIES = {
    "op1_importance_resampling": op1,
    "op2_license_scan": op2,
    "op3_packed_matrix": op3,
    "op4_best_fit_packing": op4,
    "op5_language_id": op5,
    "op6_decontamination": op6,
    "op7_substring_words": op7,
    "op8_exact_dedup": op8,
    "op9_suffix_array_dedup": op9,
    "op10_simhash": op10,
    "op11_spelling_variants": op11,
    "op12_tokenizer_alignment": op12,
    "op13_line_dedup": op13,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_LINE_WORDS = _WORDS.replace("coalesce(text, '')", "line")


def _sql_text(words: str) -> str:
    return "'" + words.replace("'", "''") + "'"


_TEMPLATE_ROWS = ", ".join(f"({k}, {_sql_text(label)}, {_sql_text(words)})" for k, (label, words) in enumerate(TEMPLATES))
_BASE_ROWS = ", ".join(f"({_sql_text(p)}, {_sql_text(label)})" for p, label in BASE.items())

_OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS p, label FROM (VALUES {_BASE_ROWS}) AS v(p, label)),
places AS (SELECT r, pos - 1 AS place, label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS pos FROM d WHERE list_contains(w, 'license')), phrases
           WHERE w[pos:pos + len(p) - 1] = p),
base AS (SELECT r, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list_sort(list(DISTINCT label)) AS base_set FROM places GROUP BY r),
templates AS (SELECT label, list_distinct(string_split(words, ' ')) AS t, len(string_split(words, ' ')) AS long FROM (VALUES {_TEMPLATE_ROWS}) AS v(k, label, words)),
blocks AS (SELECT r, {_LINE_WORDS} AS b FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
matches AS (SELECT r, label, len(list_intersect(list_distinct(b), t)) AS n, len(t) AS size FROM blocks, templates WHERE len(b) >= {THRESHOLD} * len(t)),
starts AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS pos FROM d),
runs AS (SELECT r, label, len(list_intersect(list_distinct(w[pos:pos + long - 1]), t)) AS n, len(t) AS size FROM (SELECT r, label, w, pos, long, t FROM starts, templates WHERE list_contains(t, w[pos]))),
every AS (SELECT r, label, n, size FROM matches UNION ALL SELECT r, label, n, size FROM runs),
more AS (SELECT r, list(DISTINCT label) AS more_set, max(n / size) AS best FROM every WHERE n >= {THRESHOLD} * size GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
       array_to_string(coalesce(base_set, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base_set, []), coalesce(more_set, [])))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""

_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, size, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM items)),
sizes AS (SELECT DISTINCT size FROM windows),
spots AS (SELECT r, pos, size, array_to_string(w[pos:pos + size - 1], ' ') AS win FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS pos FROM d, sizes WHERE len(w) >= size)),
hits AS (SELECT r, pos, spots.size AS size, item_id FROM spots JOIN windows ON spots.win = windows.win AND spots.size = windows.size),
covered AS (SELECT r, count(DISTINCT i) AS n_hit FROM (SELECT r, unnest(range(pos, pos + size)) AS i FROM (SELECT DISTINCT r, pos, size FROM hits)) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""

_OP7 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
spots AS (SELECT r, doc_id, pos, md5(array_to_string(w[pos:pos + 49], ' ')) AS win FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 48)) AS pos FROM d WHERE len(w) >= 50)),
least AS (SELECT win, min(doc_id) AS first_doc FROM spots GROUP BY win HAVING min(doc_id) <> max(doc_id)),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + 50)) AS i FROM spots JOIN least USING (win) WHERE first_doc < doc_id),
lists AS (SELECT r, list(i) AS gone FROM gone GROUP BY r),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN lists USING (r) LEFT JOIN kept USING (r)
"""

_OP8 = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""

_OP9 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
spots AS (SELECT r, i, md5(array_slice(b, i + 1, i + 200)) AS win FROM (SELECT r, b, unnest(range(0, octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)),
repeated AS (SELECT win FROM spots GROUP BY win HAVING count(*) > 1),
starts AS (SELECT r, i, lag(i) OVER w AS before, lead(i) OVER w AS after FROM spots SEMI JOIN repeated USING (win) WINDOW w AS (PARTITION BY r ORDER BY i)),
gone AS (SELECT r, sum(least(200, coalesce(after - i, 200))) AS n_removed, count(*) FILTER (before IS NULL OR i > before + 200) AS n_spans FROM starts GROUP BY r),
ends AS (SELECT r, 0 AS s, min(i) AS e FROM starts GROUP BY r UNION ALL SELECT r, i + 200, after FROM starts WHERE after IS NULL OR after > i + 200),
kept AS (SELECT r, string_agg(hex(array_slice(b, s + 1, coalesce(e, octet_length(b)))), '' ORDER BY s) AS bytes FROM ends JOIN d USING (r) WHERE s < coalesce(e, octet_length(b)) GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(CASE WHEN n_removed IS NULL THEN b ELSE unhex(coalesce(bytes, '')) END) AS kept_sha256
FROM d LEFT JOIN gone USING (r) LEFT JOIN kept USING (r)
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM d),
keys AS (SELECT r, doc_id, i, line, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
repeated AS (SELECT key FROM keys WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
marked AS (SELECT keys.*, repeated.key IS NOT NULL AS gone FROM keys LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""

SQL = {"op13_line_dedup": _OP13, "op9_suffix_array_dedup": _OP9, "op2_license_scan": _OP2, "op6_decontamination": _OP6, "op7_substring_words": _OP7, "op8_exact_dedup": _OP8}
