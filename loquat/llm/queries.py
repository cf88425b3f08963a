"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm.substrings import dedup_substrings

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_substrings(docs, size=13)
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("_kept").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
own AS (SELECT s, min(doc_id) AS m FROM win GROUP BY s),
hit AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM win JOIN own USING (s) WHERE m < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS k, count(*) AS n FROM words ANTI JOIN hit USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

def op2_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loquat.llm import records, storage

    path = storage.new_path(spark, "records")
    records.write_records(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), specials=True)
    return records.read_records(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loquat.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), specials=True)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm.neardup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), size=4, percent=80)
    return out.select("doc_id", F.col("_n_shingles").alias("n_shingles"), F.col("_component").alias("component_id"), F.col("_kept").alias("kept"))


OP5_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS k FROM sh GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 80 * (nx.k + ny.k - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, edge.y FROM reach JOIN edge ON reach.r = edge.x)
SELECT d.doc_id, coalesce(any_value(k), 0)::BIGINT AS n_shingles, min(r) AS component_id, d.doc_id = min(r) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""


def op6_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm.katz import score_documents

    out = score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), order=3)
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm.licenses import scan_licenses

    out = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.size("_licenses").cast("long").alias("n_licenses"), F.array_join("_licenses", ",").alias("licenses"))


def _op1_sql() -> str:
    """A template of fewer words than a shingle counts wherever its words stand in a row; any other where a window holds enough of its shingles."""
    from loquat.llm.licenses import LEAST_STEP, PERCENT, SIZE, TEMPLATES

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in sorted(TEMPLATES.items()))
    words = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    shingle = f"array_to_string(w[i:i + {SIZE - 1}], ' ') || '/' || least(len(w), {SIZE})"
    return f"""
WITH t AS (SELECT name, {words.format('body')} AS w FROM (VALUES {rows}) v(name, body)),
ts AS (SELECT DISTINCT name, {shingle} AS s FROM (SELECT name, w, unnest(range(1, greatest(len(w) - {SIZE - 2}, 2))) AS i FROM t WHERE len(w) >= {SIZE})),
short AS (SELECT name, ' ' || array_to_string(w, ' ') || ' ' AS s FROM t WHERE len(w) BETWEEN 1 AND {SIZE - 1}),
tn AS (SELECT name, count(*) AS n, greatest({LEAST_STEP}, pow(2, ceil(log2(count(*))))::BIGINT) AS step FROM ts GROUP BY name),
d AS (SELECT doc_id, {words.format('text')} AS w FROM documents),
ds AS (SELECT doc_id, i - 1 AS i, {shingle} AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SIZE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
hit AS (SELECT doc_id, name, n, i // step AS block, s FROM ds JOIN ts USING (s) JOIN tn USING (name)),
win AS (SELECT doc_id, name, n, block AS win, s FROM hit UNION ALL SELECT doc_id, name, n, block - 1, s FROM hit WHERE block > 0),
found AS (SELECT doc_id, name FROM win GROUP BY doc_id, name, n, win HAVING 100 * count(DISTINCT s) >= {PERCENT} * n),
anywhere AS (SELECT doc_id, name FROM d JOIN short ON contains(' ' || array_to_string(w, ' ') || ' ', s)),
names AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses, count(*) AS k FROM (SELECT * FROM found UNION SELECT * FROM anywhere) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(k, 0)::BIGINT AS n_licenses, coalesce(licenses, '') AS licenses
FROM d LEFT JOIN names USING (doc_id)
"""


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm.line_rules import apply_line_rules

    out = apply_line_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


OP7_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
line AS (SELECT doc_id, source, l, regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS lw
         FROM (SELECT doc_id, source, unnest(string_split(t, chr(10))) AS l FROM d)),
used AS (SELECT doc_id, source, l, array_to_string(lw, ' ') AS k, len(lw) AS n FROM line WHERE len(lw) > 0),
over AS (SELECT source, k FROM used GROUP BY source, k HAVING count(DISTINCT doc_id) > 20),
gone AS (SELECT doc_id, sum(n) AS removed FROM used JOIN over ON used.source IS NOT DISTINCT FROM over.source AND used.k = over.k GROUP BY doc_id),
dups AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n_dup FROM used GROUP BY doc_id),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_rep FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM win JOIN twice USING (doc_id, s)) GROUP BY doc_id),
f AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(removed, 0) AS removed
      FROM d LEFT JOIN dups USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed >= 0.3 * n_words) AS kept
FROM f
"""


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm.decontaminate import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.transform("_items", lambda x: x.cast("string")), ",")
    return out.select("doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(items.cast("binary"), 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"))


_NORMAL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_NORMAL} AS w FROM documents),
b AS (SELECT item_id, {_NORMAL} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
size AS (SELECT DISTINCT n FROM pat),
win AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, size WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, i, win.n AS n FROM win JOIN pat USING (n, s)),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS list FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def grades(labels: DataFrame) -> DataFrame:
    """Ratings from labels: 0 low quality, 1 good but toxic, 2 good."""
    return labels.select("doc_id", F.when(F.col("quality") < 1, 0).when(F.col("toxic") > 0, 1).when(F.col("quality") > 0, 2).alias("grade"))


def op9_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm import ordinal

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, grades(table(spark, sf_dir, "labels")))
    return ordinal.score(docs, model).select("doc_id", F.col("_expected_grade").alias("expected_grade"), F.col("_tail").alias("tail_probability"), F.col("_kept").alias("kept"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm import toxicity

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    labels = table(spark, sf_dir, "labels").where(~held_out)
    out = toxicity.score(docs, toxicity.train(docs, labels))
    return out.select("doc_id", held_out.alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


def op11_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm import storage, warc

    path = storage.new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    out = warc.records(warc.read_chunks(spark, path, payload=False))
    return out.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", F.col("sha1").alias("payload_digest"), "record_type", F.col("refers_to").cast("long").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
top AS (SELECT h, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN m > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m > page_id THEN m END AS refers_to
FROM p LEFT JOIN top USING (h)
"""


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from loquat.llm.alignment import align

    out = align(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("_n_a") > 0, F.sha2(F.col("_groups").cast("binary"), 256)).otherwise("")
    return out.select("doc_id", *(F.col(f"_{c}").alias(c) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")), digest.alias("groups_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loquat.llm import codes, storage

    vectors = table(spark, sf_dir, "embeddings")
    books = codes.train(vectors)
    coded = storage.materialise(codes.encode(vectors, books).select("vec_id", "label", "_code", "_error"), "codes")
    hexed = F.array_join(F.transform("_code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    out = codes.group_errors(coded)
    return out.select("vec_id", hexed.alias("code"), F.col("_error").alias("error"), F.col("_label_error").alias("label_error"), F.lit(books.digest()).alias("codebooks_sha256"))


def _op13_sql() -> str:
    """Every distance of every round; doubles hold these integers exactly."""
    rounds, steps = 4, []
    distance = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
    for k in range(rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, min(({distance})::BIGINT * 256 + entry) AS m FROM p JOIN b{k} USING (part) GROUP BY vec_id, part)")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT part, entry, list(c ORDER BY place) AS c FROM (
    SELECT part, m % 256 AS entry, place, floor(sum(v) / count(*)) AS c
    FROM (SELECT part, m, unnest(x) AS v, generate_subscripts(x, 1) AS place FROM a{k} JOIN p USING (vec_id, part)) GROUP BY ALL) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (part, entry))""")
    steps = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS z FROM embeddings
    WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
p AS MATERIALIZED (SELECT vec_id, part, z[part * (len(z) // 4) + 1:(part + 1) * (len(z) // 4)] AS x FROM v, range(4) r(part)),
b0 AS MATERIALIZED (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, x AS c FROM p QUALIFY entry < 256),
{steps},
coded AS (SELECT vec_id, string_agg(lpad(to_hex(m % 256), 2, '0'), '' ORDER BY part) AS code, sum(m // 256) AS error FROM a{rounds} GROUP BY vec_id),
book AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256
    FROM (SELECT part, entry, unnest(c) AS v, generate_subscripts(c, 1) AS place FROM b{rounds})),
whole AS (SELECT vec_id, label, lower(code) AS code, error FROM v JOIN coded USING (vec_id))
SELECT vec_id, code, error::BIGINT AS error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM whole, book
"""


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_records": op2_token_records,
    "op3_cost_packing": op3_cost_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash_neardup": op5_minhash_neardup,
    "op6_katz_scores": op6_katz_scores,
    "op7_line_rules": op7_line_rules,
    "op8_decontamination": op8_decontamination,
    "op9_ordinal_quality": op9_ordinal_quality,
    "op10_toxicity": op10_toxicity,
    "op11_warc_chunks": op11_warc_chunks,
    "op12_token_alignment": op12_token_alignment,
    "op13_vector_codes": op13_vector_codes,
}
ORACLE_SQL = {
    "op1_license_scan": _op1_sql(),
    "op4_substring_dedup": OP4_SQL,
    "op5_minhash_neardup": OP5_SQL,
    "op7_line_rules": OP7_SQL,
    "op8_decontamination": OP8_SQL,
    "op11_warc_chunks": OP11_SQL,
    "op13_vector_codes": _op13_sql(),
}
