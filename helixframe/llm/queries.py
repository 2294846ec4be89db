"""One query for each operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from helixframe.llm import decontamination, hard_negatives, html_text, media, mixing, prefix_hash, quality, resampling, sharding, simhash, suffix, toxicity, warc
from helixframe.llm.common import table


def op1_mixing(spark, sf_dir):
    return mixing.mixing_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_decontamination(spark, sf_dir):
    out = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.drop("items")


def op3_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality(spark, sf_dir):
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


def op6_sharding(spark, sf_dir):
    return sharding.sharding_report(table(spark, sf_dir, "documents"))


def op7_media(spark, sf_dir):
    return media.read_media(media.store_texts(table(spark, sf_dir, "documents"))).drop("error")


def op8_repeats(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op11_resampling(spark, sf_dir):
    return resampling.resampling_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_fingerprints(spark, sf_dir):
    return prefix_hash.fingerprint_report(table(spark, sf_dir, "documents"))


def op13_negatives(spark, sf_dir):
    return hard_negatives.negatives_report(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_decontamination, op3_html_text, op4_quality, op5_warc, op6_sharding, op7_media, op8_repeats, op9_toxicity, op10_simhash, op11_resampling, op12_fingerprints, op13_negatives)}

SQL = {}

SQL["op1_mixing"] = r"""
WITH sizes AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sizes GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS rnk, source_size * 3.0::DOUBLE AS most FROM totals),
summed AS (SELECT *, row_number() OVER o AS n, coalesce(sum(most) OVER (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    coalesce(sum(weight) OVER (ORDER BY most / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent,
    CAST(sum(source_size) OVER () AS DOUBLE) AS budget, sum(weight) OVER () AS weights FROM ranked WINDOW o AS (ORDER BY most / weight, rnk)),
levels AS (SELECT *, (budget - capped) / (weights - spent) AS level FROM summed),
chosen AS (SELECT arg_min(level, n) AS level FROM levels WHERE level * weight <= most),
targets AS (SELECT source, source_size, coalesce(least(most, chosen.level * weight), most) AS target FROM levels, chosen),
rates AS (SELECT s.doc_id, s.source, s.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    CAST(concat('0x', substr(md5(concat('17:', coalesce(CAST(s.doc_id AS VARCHAR), '~'))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copied AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM rates)
SELECT doc_id, size, source_size, target, size * copies AS taken, source, CAST(copies AS BIGINT) AS copies FROM copied
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL["op2_decontamination"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
    FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM wins),
cut AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS win FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, ks WHERE len(w) >= k)),
hits AS (SELECT c.doc_id, c.s, c.k, x.item_id FROM cut c JOIN wins x ON c.k = x.k AND c.win = x.win),
marked AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM (SELECT DISTINCT doc_id, s, k FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marked USING (doc_id) LEFT JOIN found USING (doc_id)
"""

SQL["op5_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS least FROM p)
SELECT page_id, payload_bytes,
    list_reduce(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST((CAST(concat('0x', substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5)) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT) + 1, 1)), lambda a, b: concat(a, b)) AS payload_digest,
    CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id = least THEN NULL ELSE least END AS refers_to FROM h
"""



def _crc_step(byte: str) -> str:
    """CRC-32's step from state c by a byte: the table's entry is the exclusive sum of the entries of its index's bits."""
    terms = []
    for k in range(8):
        entry = 1 << k
        for _ in range(8):
            entry = (entry >> 1) ^ (0xEDB88320 if entry & 1 else 0)
        terms.append(f"((xor(c, {byte}) >> {k}) & 1) * {entry}")
    out = "(c >> 8)"
    for t in terms:
        out = f"xor({out}, {t})"
    return out


SQL["op11_resampling"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
dx AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d), bx AS (SELECT item, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM (SELECT row_number() OVER () AS item, w FROM b)),
dn AS (SELECT doc_id, x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM dx WINDOW p AS (PARTITION BY doc_id ORDER BY i)), bn AS (SELECT x, lead(x) OVER p AS y, lead(x, 2) OVER p AS z FROM bx WINDOW p AS (PARTITION BY item ORDER BY i)),
du AS (SELECT doc_id, x AS f FROM dn UNION ALL SELECT doc_id, concat(x, ' ', y) FROM dn WHERE y IS NOT NULL UNION ALL SELECT doc_id, concat(x, ' ', y, ' ', z) FROM dn WHERE z IS NOT NULL),
bf AS (SELECT x AS f FROM bn UNION ALL SELECT concat(x, ' ', y) FROM bn WHERE y IS NOT NULL UNION ALL SELECT concat(x, ' ', y, ' ', z) FROM bn WHERE z IS NOT NULL),
df AS (SELECT doc_id, len(w) AS n_words, len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS n_features FROM d),
dc AS (SELECT doc_id, f, count(*) AS n FROM du GROUP BY ALL),
every AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM dc UNION SELECT f FROM bf)),
buckets AS (SELECT f, xor(list_reduce(list_transform(generate_series(1, len(h) // 2), lambda i: CAST(concat('0x', substr(h, 2 * i - 1, 2)) AS BIGINT)),
    lambda c, x: {_crc_step("x")}, CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket FROM every),
s AS (SELECT bucket, CAST(sum(n) AS BIGINT) AS s FROM dc JOIN buckets USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bf JOIN buckets USING (f) GROUP BY bucket),
totals AS (SELECT (SELECT CAST(coalesce(sum(s), 0) AS DOUBLE) FROM s) AS s_all, (SELECT CAST(coalesce(sum(t), 0) AS DOUBLE) FROM t) AS t_all),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000) / ((s::DOUBLE + 1) * (t_all + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT doc_id, CAST(sum(n * gain) AS BIGINT) AS weight FROM dc JOIN buckets USING (f) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (SELECT doc_id, n_words, CAST(n_features AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(concat('0x', substr(sha256(concat('42:', CAST(doc_id AS VARCHAR))), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM df LEFT JOIN weights USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)
"""

SQL["op13_negatives"] = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
