"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, langid, media, mixing, ngram_join, pq, quality, secrets, superminhash, toxicity, warc, whitening
from .common import WORD, table


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.describe(media.store(table(spark, sf_dir, "documents")))


def media_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The timed clip rows of the files that op2 stores."""
    return media.clips(media.store(table(spark, sf_dir, "documents")))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_with_next(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, lasting=True)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.compressed(table(spark, sf_dir, "embeddings"))


def op12_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_media": op2_media,
    "op3_fingerprints": op3_fingerprints,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_mixing": op5_mixing,
    "op6_quality": op6_quality,
    "op7_warc": op7_warc,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_language": op9_language,
    "op10_secrets": op10_secrets,
    "op11_vector_codes": op11_vector_codes,
    "op12_superminhash": op12_superminhash,
    "op13_whitening": op13_whitening,
    "media_clips": media_clips,
}

OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS d FROM pages),
     top AS (SELECT d, max(page_id) AS top_id FROM p GROUP BY d)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(d || '0', CAST((5 * i) // 4 + 1 AS INTEGER), 2) AS INTEGER) >> CAST(3 - i % 4 AS INTEGER)) & 31) AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = top_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top_id THEN NULL ELSE top_id END AS refers_to
FROM p JOIN top USING (d)
"""

def _components_sql(words: int, percent: int, more: str = "") -> str:
    """Components of the links between texts' sets of word shingles."""
    return f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
     s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')]
                  ELSE list_distinct(list_transform(range(1, len(w) - {words} + 2), lambda i: array_to_string(w[i : i + {words} - 1], ' '))) END AS s FROM w),
     sets AS (SELECT s, len(s) AS n, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s) GROUP BY s HAVING len(s) > 0),
     e AS (SELECT rep, n, unnest(s) AS g FROM sets),
     pairs AS (SELECT a.rep AS a, b.rep AS b, a.n AS an, b.n AS bn, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
     links AS (SELECT a, b FROM pairs WHERE 100 * c >= {percent} * (an + bn - c)),
     edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
     reach(a, root) AS (SELECT DISTINCT a, a FROM edges UNION SELECT edges.b, root FROM reach JOIN edges ON edges.a = reach.a),
     roots AS (SELECT a, min(root) AS root FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, CASE WHEN doc_id IS NOT NULL THEN coalesce(root, rep, doc_id) END AS component_id{more}
FROM s LEFT JOIN sets ON sets.s = list_sort(s.s) LEFT JOIN roots ON roots.a = rep
"""


OP8_SQL = _components_sql(ngram_join.WORDS, ngram_join.PERCENT)
OP12_SQL = _components_sql(superminhash.WORDS, superminhash.PERCENT, ", doc_id = component_id AS kept")

#: 60 bits of the md5 of seed:part.
HASH = "CAST('0x' || substr(md5({0}), 1, 15) AS BIGINT)"

#: The plan of mixing.py in one piece.
OP5_SQL = f"""
WITH d AS (SELECT doc_id AS id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, coalesce(CAST('0x' || substr(md5(text), 1, 15) AS BIGINT), -1) AS k FROM documents),
     s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx FROM d GROUP BY source),
     s1 AS (SELECT *, CAST([5, 2, 1][CAST(idx % 3 + 1 AS INTEGER)] AS DOUBLE) AS weight, {mixing.EPOCHS} * size AS most FROM s0),
     s2 AS (SELECT *, CAST(sum(size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
            FROM s1 WINDOW o AS (ORDER BY most / weight, idx)),
     share AS (SELECT first(level ORDER BY most / weight, idx) AS level FROM s2 WHERE NOT most <= level * weight),
     s3 AS (SELECT source, idx, size, CASE WHEN most <= s2.level * weight THEN CAST(most AS DOUBLE) ELSE (SELECT level FROM share) * weight END AS target FROM s2),
     s4 AS (SELECT *, least(greatest(CAST(least(floor(target), size) AS BIGINT) // {mixing.BLOCKS}, least(greatest(size // {mixing.BLOCKS}, 1), {mixing.FINE})), {mixing.BLOCK}) AS unit FROM s3),
     s5 AS (SELECT *, (size + unit - 1) // unit AS blocks FROM s4),
     s6 AS (SELECT *, CASE WHEN size > 0 THEN least(blocks * {mixing.EPOCHS}, CAST(round(target / size * blocks) AS BIGINT)) ELSE 0 END AS quota FROM s5),
     src AS (SELECT *, CAST(coalesce(sum(quota) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS quota_low FROM s6),
     n AS (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS slots, CAST(coalesce(sum(blocks), 0) AS BIGINT) AS blocks, (SELECT count(*) FROM documents) AS docs FROM src),
     b AS (SELECT *, greatest(1, docs // greatest({mixing.BUCKET_ROWS}, CAST(floor(sqrt(docs)) AS BIGINT))) AS doc_buckets, greatest(1, blocks // greatest({mixing.BUCKET_ROWS}, CAST(floor(sqrt(blocks)) AS BIGINT))) AS block_buckets FROM n),
     placed AS (SELECT d.id, d.size, d.k, src.idx, src.unit, src.size AS source_size, src.target,
                       CAST(coalesce(sum(d.size) OVER (PARTITION BY src.idx ORDER BY {HASH.format("'doc:' || coalesce(CAST(d.id AS VARCHAR), '-') || ':' || d.k")} % (SELECT doc_buckets FROM b), d.id NULLS FIRST, d.size, d.k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
                FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source),
     slot AS (SELECT i AS slot, {HASH.format("'slot:' || i")} % (SELECT greatest(1, slots) FROM n) AS v FROM (SELECT unnest(range((SELECT slots FROM n))) AS i)),
     drawn AS (SELECT slot, idx, quota, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS j FROM slot JOIN src ON v >= quota_low AND v < quota_low + quota),
     got AS (SELECT src.idx, src.quota, count(drawn.slot) AS got FROM src LEFT JOIN drawn ON drawn.idx = src.idx GROUP BY src.idx, src.quota),
     gap AS (SELECT idx, got, greatest(got - quota, 0) AS surplus, greatest(quota - got, 0) AS short FROM got),
     low AS (SELECT *, CAST(coalesce(sum(surplus) OVER w, 0) AS BIGINT) AS over_low, CAST(coalesce(sum(short) OVER w, 0) AS BIGINT) AS short_low FROM gap WINDOW w AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
     extra AS (SELECT slot, over_low + j - quota AS m FROM drawn JOIN low USING (idx) WHERE j >= quota),
     slots AS (SELECT idx, j FROM drawn WHERE j < quota UNION ALL SELECT idx, got + m - short_low AS j FROM extra JOIN low ON m >= short_low AND m < short_low + short),
     each AS (SELECT idx, blocks, unnest(range(blocks)) AS block FROM src),
     hashed AS (SELECT idx, block, {HASH.format("'block:' || idx || ':' || block")} AS h FROM each),
     permuted AS (SELECT idx, block, row_number() OVER (PARTITION BY idx ORDER BY h % (SELECT block_buckets FROM b), h, block) - 1 AS place FROM hashed),
     times AS (SELECT slots.idx, block, count(*) AS times FROM slots JOIN src ON src.idx = slots.idx JOIN permuted ON permuted.idx = slots.idx AND place = j % src.blocks GROUP BY slots.idx, block),
     pieces AS (SELECT * EXCLUDE (k), row_number() OVER () AS k FROM placed),
     cut AS (SELECT k, idx, unit, start, size, unnest(range(start // unit, (start + size - 1) // unit + 1)) AS block FROM pieces WHERE size > 0),
     words AS (SELECT k, sum((least(start + size, (cut.block + 1) * unit) - greatest(start, cut.block * unit)) * times) AS taken FROM cut JOIN times ON times.idx = cut.idx AND times.block = cut.block GROUP BY k)
SELECT id AS doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM pieces LEFT JOIN words USING (k)
"""


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: The assign pattern without a flag for case, which would fold letters beyond ASCII in some engines.
ASSIGN_SQL = secrets.ASSIGN.replace("(?i)", "").replace("'", "''")
for _word in ("password", "passwd", "secret", "token"):
    ASSIGN_SQL = ASSIGN_SQL.replace(_word, _either_case(_word))
ASSIGN_SQL = ASSIGN_SQL.replace("api_?key", f"{_either_case('api')}_?{_either_case('key')}")
ENDPOINT_SQL = secrets.ENDPOINT.replace("'", "''")
_SCANS = ", ".join(
    f"{{'kind': '{kind}', 'rank': {rank}, 'm': regexp_extract_all(s, '{pattern}'), 'p': regexp_split_to_array(s, '{pattern}'), 'ok': {ok.replace('PATTERN', pattern)}}}"
    for rank, (kind, pattern, ok) in enumerate(
        (
            ("assign", ASSIGN_SQL, f"list_transform(regexp_extract_all(s, 'PATTERN', 2), lambda x: length(x) >= {secrets.LEAST['assign']})"),
            ("access", secrets.ACCESS, f"list_transform(regexp_extract_all(s, 'PATTERN'), lambda x: length(x) >= {secrets.LEAST['access']})"),
            ("hex", secrets.HEX, f"list_transform(regexp_extract_all(s, 'PATTERN'), lambda x: length(x) >= {secrets.LEAST['hex']})"),
            ("key", secrets.KEY, "list_transform(regexp_extract_all(s, 'PATTERN'), lambda x: regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]') AND regexp_matches(x, '[0-9]'))"),
            ("endpoint", ENDPOINT_SQL, "list_transform(regexp_extract_all(s, 'PATTERN'), lambda x: true)"),
        ),
        1,
    )
)
_NEAR = f"x.r = a.r AND greatest(a.b - x.e, x.b - a.e) <= {secrets.SCOPE}"

OP10_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS s FROM documents),
     k AS (SELECT r, unnest([{_SCANS}]) AS k FROM t),
     x AS (SELECT r, k.kind AS kind, k.rank AS rank, unnest(k.m) AS m, unnest(k.p[1:len(k.m)]) AS p, unnest(k.ok) AS ok, generate_subscripts(k.m, 1) AS i FROM k WHERE len(k.m) > 0),
     y AS (SELECT r, kind, rank, ok, length(m) AS n, sum(length(p) + length(m)) OVER (PARTITION BY r, kind ORDER BY i) AS e FROM x),
     f AS (SELECT r, kind, rank, CAST(e - n AS BIGINT) AS b, CAST(e AS BIGINT) AS e FROM y WHERE ok),
     keys AS (SELECT * FROM f AS x WHERE kind = 'key' AND EXISTS (SELECT 1 FROM f AS a WHERE a.kind = 'access' AND {_NEAR})),
     parts AS (SELECT * FROM keys UNION ALL SELECT * FROM f WHERE kind = 'assign'),
     ends AS (SELECT * FROM f AS x WHERE kind = 'endpoint' AND EXISTS (SELECT 1 FROM f AS a WHERE a.kind = 'access' AND {_NEAR}) AND EXISTS (SELECT 1 FROM parts AS a WHERE {_NEAR})),
     spans AS (SELECT * FROM f WHERE rank <= 3 UNION ALL SELECT * FROM keys UNION ALL SELECT * FROM ends),
     g AS (SELECT r, count(*) FILTER (WHERE rank = 1) AS n_assign, count(*) FILTER (WHERE rank = 2) AS n_access, count(*) FILTER (WHERE rank = 3) AS n_hex,
                  string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) FILTER (WHERE rank <= 3) AS base, string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, rank) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(g.spans, '') AS spans FROM t LEFT JOIN g USING (r)
"""

#: Shots from the bytes themselves: a share of bytes by frame and bin, its change from frame to frame, the changes before.
CLIPS_SQL = f"""
WITH f AS (SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS known, hex(encode(coalesce(text, ''))) AS h FROM documents),
     n AS (SELECT r, doc_id, known, greatest(1, (known + {media.SAMPLES - 1}) // {media.SAMPLES}) AS frames FROM f),
     x AS (SELECT r, unnest(regexp_extract_all(h, '..')) AS h, unnest(range(known)) // {media.SAMPLES} AS frame FROM f WHERE known > 0),
     y AS (SELECT r, frame, CAST('0x' || h AS INTEGER) AS x FROM x),
     size AS (SELECT r, frame, count(*) AS n, sum(x) AS total FROM y GROUP BY r, frame),
     p AS (SELECT y.r, y.frame, x // {256 // media.BINS} AS bin, count(*) / any_value(n) AS p FROM y JOIN size ON size.r = y.r AND size.frame = y.frame GROUP BY y.r, y.frame, bin),
     d AS (SELECT r, frame, bin, sum(p) AS d FROM (SELECT r, frame, bin, p FROM p UNION ALL SELECT r, frame + 1, bin, -p FROM p) GROUP BY r, frame, bin),
     c AS (SELECT d.r, d.frame, CASE WHEN 2 * any_value(n) < {media.SAMPLES} THEN 0.0 ELSE sum(abs(d)) / 2 END AS change FROM d JOIN size ON size.r = d.r AND size.frame = d.frame WHERE d.frame > 0 GROUP BY d.r, d.frame),
     w AS (SELECT r, frame, change, avg(change) OVER before AS mean, stddev_pop(change) OVER before AS deviation FROM c WINDOW before AS (PARTITION BY r ORDER BY frame ROWS BETWEEN {media.WINDOW} PRECEDING AND 1 PRECEDING)),
     begins AS (SELECT r, 0 AS frame FROM n UNION ALL SELECT r, frame FROM w WHERE frame > 1 AND change > {media.FLOOR} AND change > mean + {media.SPREAD} * deviation + 1e-9),
     shots AS (SELECT r, frame, row_number() OVER (PARTITION BY r ORDER BY frame) - 1 AS clip, lead(frame) OVER (PARTITION BY r ORDER BY frame) AS until FROM begins)
SELECT n.doc_id, CAST(clip AS INTEGER) AS clip, CAST(shots.frame * {media.FRAME_MS} AS BIGINT) AS start_ms, CAST(coalesce(until, frames) * {media.FRAME_MS} AS BIGINT) AS end_ms, coalesce(sum(size.total) / sum(size.n), 0.0) AS mean_level
FROM shots JOIN n ON n.r = shots.r LEFT JOIN size ON size.r = shots.r AND size.frame >= shots.frame AND size.frame < coalesce(until, frames)
GROUP BY n.r, n.doc_id, clip, shots.frame, until, frames
"""



def _op11_sql(parts: int, entries: int, rounds: int, scale: int) -> str:
    """Lloyd's rounds in full: every part against every entry, each round two statements. Equal lengths, which parts divide, are taken for granted."""
    near = """a{k} AS MATERIALIZED (SELECT r, p.part, min(list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::BIGINT * {n} + entry) AS m FROM p JOIN b{k} b ON b.part = p.part GROUP BY r, p.part)"""
    move = """s{k} AS (SELECT p.part, m % {n} AS entry, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS x FROM p JOIN a{k} a ON a.r = p.r AND a.part = p.part),
     n{k} AS (SELECT part, entry, list(c ORDER BY i) AS c FROM (SELECT part, entry, i, floor(CAST(sum(x) AS DOUBLE) / count(*))::BIGINT AS c FROM s{k} GROUP BY part, entry, i) GROUP BY part, entry),
     b{next} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(n.c, b.c) AS c FROM b{k} b LEFT JOIN n{k} n ON n.part = b.part AND n.entry = b.entry)"""
    steps = [f.format(k=k, next=k + 1, n=entries) for k in range(rounds) for f in (near, move)] + [near.format(k=rounds, n=entries)]
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * {scale})::BIGINT) AS x FROM embeddings
                        WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
     p AS MATERIALIZED (SELECT r, part, x[part * (len(x) // {parts}) + 1 : (part + 1) * (len(x) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS part)),
     b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries}),
     {",\n     ".join(steps)},
     coded AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY part) AS code, CAST(sum(m // {entries}) AS BIGINT) AS error FROM a{rounds} GROUP BY r),
     books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN coded USING (r), books
"""


OP11_SQL = _op11_sql(pq.PARTS, pq.ENTRIES, pq.ROUNDS, pq.SCALE)

ORACLE_SQL: dict[str, str] = {"media_clips": CLIPS_SQL, "op11_vector_codes": OP11_SQL, "op12_superminhash": OP12_SQL, "op5_mixing": OP5_SQL, "op7_warc": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op10_secrets": OP10_SQL}
