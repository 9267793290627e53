"""Packing, tokenization, preprocessing, chat and vector queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import packing, text, vectors
from ..sources.scratch import spread
from ..sources.tables import table
from .registry import registry

L = 512
QUERIES, SQL, query = registry()


def _docs(spark, d):
    return spread(table(spark, d, "documents"))


def _pages(spark, d):
    return spread(table(spark, d, "pages"))


def _lengths(spark, d):
    return packing.lengths(_docs(spark, d).select("doc_id", "source", "text")).select("doc_id", "source", "n")


SPANS = rf"""
WITH t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '\S+')) + 1 AS BIGINT) AS n FROM documents),
     o AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS st FROM t),
     x AS (SELECT source, doc_id, n, st, unnest(range(st // {L}, (st + n - 1) // {L} + 1)) AS chunk FROM o),
     s AS (SELECT source, chunk, doc_id, greatest(st, chunk * {L}) - chunk * {L} AS start, least(st + n, (chunk + 1) * {L}) - greatest(st, chunk * {L}) AS len FROM x)
"""


@query(SPANS + "SELECT source, chunk, count(*) AS segs, CAST(sum(len) AS BIGINT) AS ntok FROM s GROUP BY source, chunk")
def pack_spans(spark, d):
    return packing.pack_spans(_lengths(spark, d), L)


@query(rf"""
WITH t AS (SELECT source, doc_id, list_append(regexp_extract_all(text, '\S+'), '<eos>') AS w FROM documents),
     u AS (SELECT source, doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS i FROM t),
     g AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY doc_id, i) - 1 AS p FROM u)
SELECT source, p // {L} AS chunk, count(*) AS n, md5(string_agg(tok, ' ' ORDER BY p)) AS digest FROM g GROUP BY source, p // {L}""")
def pack_tokens(spark, d):
    return packing.pack_tokens(_docs(spark, d), L).select("source", "chunk", "n", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(SPANS + "SELECT source, chunk, row_number() OVER (PARTITION BY source, chunk ORDER BY start) AS segment, doc_id, start, len FROM s")
def segment_map(spark, d):
    return packing.segment_map(_lengths(spark, d), L)


@query(SPANS + f"SELECT source, chunk, count(*) AS segs, CAST(sum(len) AS BIGINT) AS ntok FROM s GROUP BY source, chunk HAVING sum(len) = {L}")
def pack_drop_last(spark, d):
    return packing.pack_drop_last(_lengths(spark, d), L)


@query(SPANS + f""", d AS (SELECT source, doc_id, count(*) AS k, sum(len) AS n, max(chunk) AS last FROM s GROUP BY source, doc_id),
     a AS (SELECT source, max(last) + 1 AS n_seq, CAST(sum(n) AS BIGINT) AS n_tok, count(*) FILTER (WHERE k > 1) AS n_split_docs FROM d GROUP BY source)
SELECT source, n_seq, n_tok, n_seq * {L} - n_tok AS pad, n_split_docs, round(n_tok / (n_seq * {L}), 6) AS fill FROM a""")
def pack_stats(spark, d):
    return packing.pack_stats(_lengths(spark, d), L)


@query(r"""
WITH t AS (SELECT doc_id, list_append(regexp_extract_all(text, '\S+')[1:255], '<eos>') AS w FROM documents)
SELECT doc_id, CAST(len(w) AS BIGINT) AS kept, md5(array_to_string(list_concat(w, list_transform(range(256 - len(w)), lambda i: '<pad>')), ' ')) AS digest FROM t""")
def pad_truncate(spark, d):
    return packing.pad_truncate(_docs(spark, d), 256).select("doc_id", "kept", F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(rf"""
WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) + 1 AS BIGINT) AS n FROM documents),
     o AS (SELECT n, CAST(sum(n) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS st FROM t),
     x AS (SELECT n, st, unnest(range(st // {L}, (st + n - 1) // {L} + 1)) AS chunk FROM o)
SELECT chunk, count(*) AS segs, CAST(sum(least(st + n, (chunk + 1) * {L}) - greatest(st, chunk * {L})) AS BIGINT) AS ntok FROM x GROUP BY chunk""")
def pack_global(spark, d):
    return packing.pack_global(_lengths(spark, d), L)


FIT = r"""
WITH RECURSIVE t AS (SELECT doc_id, source, CAST(len(regexp_extract_all(text, '\S+')) + 1 AS BIGINT) AS n FROM documents),
     p AS (SELECT source, doc_id, part, least(2048, n - part * 2048) AS len FROM (SELECT *, unnest(range((n + 2047) // 2048)) AS part FROM t) WHERE {whole}),
     s AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY len DESC, doc_id, part) AS k FROM p),
     f(source, k, rooms, bin) AS (
       SELECT DISTINCT source, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(-1 AS BIGINT) FROM t UNION ALL
       SELECT source, k, CASE WHEN spot IS NULL THEN list_append(rooms, 2048 - len) ELSE list_concat(rooms[: spot - 1], [rooms[spot] - len], rooms[spot + 1 :]) END, CASE WHEN spot IS NULL THEN len(rooms) ELSE spot - 1 END
       FROM (SELECT s.source, s.k, rooms, s.len AS len, {choice} AS spot FROM f JOIN s ON s.source = f.source AND s.k = f.k + 1) AS step)
"""


@query(FIT.format(whole="part = 0", choice="list_position(list_transform(rooms, lambda x: x >= s.len), true)") + """, tops AS (SELECT source, max(bin) + 1 AS top FROM f GROUP BY source),
     more AS (SELECT source, doc_id, part, least(2048, n - part * 2048) AS len, row_number() OVER (PARTITION BY source ORDER BY doc_id, part) - 1 AS k FROM (SELECT *, unnest(range(1, (n + 2047) // 2048)) AS part FROM t))
SELECT source, bin, doc_id, part, len FROM f JOIN s USING (source, k) UNION ALL SELECT source, top + k, doc_id, part, len FROM more JOIN tops USING (source)""")
def pack_ffd(spark, d):
    return packing.pack_ffd(_lengths(spark, d), 2048)


@query(FIT.format(whole="true", choice="list_position(rooms, list_min(list_filter(rooms, lambda x: x >= s.len)))") + "SELECT source, bin, doc_id, part, len FROM f JOIN s USING (source, k)")
def pack_bfd(spark, d):
    return packing.pack_bfd(_lengths(spark, d), 2048)


@query(r"""
WITH t AS (SELECT CAST(len(regexp_extract_all(text, '\S+')) + 1 AS BIGINT) AS n FROM documents),
     b AS (SELECT n, CAST(CASE WHEN n <= 128 THEN 0 WHEN n <= 512 THEN 1 WHEN n <= 2048 THEN 2 ELSE 3 END AS BIGINT) AS bucket FROM t)
SELECT bucket, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tok, count(*) * max(n) AS padded FROM b GROUP BY bucket""")
def length_bucket(spark, d):
    return packing.length_bucket(_lengths(spark, d), (128, 512, 2048))


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '\S+'), '|')) AS digest, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents")
def tokenize_words(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(T.words("text"), "|")).alias("digest"), T.word_count("text").alias("n"))


@query("SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n, md5(array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: CAST(('0x' || h) AS INTEGER)), ',')) AS digest FROM documents")
def tokenize_bytes(spark, d):
    b = T.byte_values("text")
    return _docs(spark, d).select("doc_id", F.octet_length("text").cast("long").alias("n"), F.md5(F.array_join(F.transform(b, lambda x: x.cast("string")), ",")).alias("digest"))


@query(r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '\p{L}+|\d|[^\s\p{L}\d]+'), '~')) AS digest FROM documents")
def pretokenize(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(F.array_join(T.pieces("text"), "~")).alias("digest"))


VOCAB = r"""
WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\S+')) AS token FROM documents),
     c AS (SELECT token, count(*) AS n FROM w GROUP BY token ORDER BY n DESC, token LIMIT 1000),
     v AS (SELECT row_number() OVER (ORDER BY n DESC, token) + 1 AS id, token, n FROM c
           UNION ALL SELECT 0, '<unk>', 0 UNION ALL SELECT 1, '<eos>', 0)
"""


@query(VOCAB + "SELECT CAST(id AS BIGINT) AS id, token, CAST(n AS BIGINT) AS n FROM v")
def build_vocab(spark, d):
    return text.build_vocab(_docs(spark, d), 1000)


@query(VOCAB + r""", t AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS a FROM documents),
     u AS (SELECT doc_id, unnest(a) AS token, generate_subscripts(a, 1) AS i FROM t)
SELECT doc_id, count(*) AS n, md5(string_agg(CAST(coalesce(id, 0) AS VARCHAR), ' ' ORDER BY i)) AS digest FROM u LEFT JOIN v USING (token) GROUP BY doc_id""")
def encode_vocab(spark, d):
    docs = _docs(spark, d)
    ids = text.encode_vocab(docs, text.build_vocab(docs, 1000))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.md5(F.array_join(F.transform("ids", lambda x: x.cast("string")), " ")).alias("digest"))


@query(r"""WITH t AS (SELECT lang, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n FROM documents)
SELECT lang, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tok, quantile_cont(n, 0.5) AS p50, max(n) AS longest FROM t GROUP BY lang""")
def token_stats(spark, d):
    return text.token_stats(_docs(spark, d))


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents),
     g AS (SELECT doc_id, array_to_string(w[i : i + 7], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM t WHERE len(w) >= 8))
SELECT doc_id, count(*) AS n, count(DISTINCT gram) AS n_unlike, md5(string_agg(DISTINCT gram, '|' ORDER BY gram)) AS digest FROM g GROUP BY doc_id""")
def ngrams(spark, d):
    g = _docs(spark, d).select("doc_id", T.ngrams(T.words(F.lower("text")), 8).alias("g")).filter(F.size("g") > 0)
    unlike = F.transform(F.array(F.sort_array(F.array_distinct("g"))), lambda u: F.struct(F.size(u).cast("long").alias("n"), F.md5(F.array_join(u, "|")).alias("d")))[0]
    return g.select("doc_id", F.size("g").cast("long").alias("n"), unlike.alias("u")).select("doc_id", "n", F.col("u.n").alias("n_unlike"), F.col("u.d").alias("digest"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(T.normalize("text")).alias("digest"))


@query("SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def unicode_nfc(spark, d):
    return text.unicode_nfc(_docs(spark, d)).select("doc_id", F.md5("text").alias("digest"))


@query(r"""
WITH a AS (SELECT page_id, regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g') AS h FROM pages),
     b AS (SELECT page_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS h FROM a),
     c AS (SELECT page_id, replace(replace(replace(replace(replace(h, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS h FROM b),
     e AS (SELECT page_id, trim(regexp_replace(h, '\s+', ' ', 'g')) AS h FROM c)
SELECT page_id, CAST(length(h) AS BIGINT) AS n, md5(h) AS digest FROM e""")
def html_to_text(spark, d):
    t = _pages(spark, d).select("page_id", T.html_to_text("html").alias("h"))
    return t.select("page_id", F.length("h").cast("long").alias("n"), F.md5("h").alias("digest"))


@query(r"""SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, regexp_extract(html, '(?i)<html[^>]*\blang="([^"]*)"', 1) AS lang,
       CAST(len(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1)) AS BIGINT) AS n_links, array_to_string(regexp_extract_all(html, '(?i)<a\s+href="([^"]*)"', 1), ' ') AS links FROM pages""")
def html_parts(spark, d):
    links = T.html_links("html")
    return _pages(spark, d).select("page_id", T.html_title("html").alias("title"), T.html_lang("html").alias("lang"), F.size(links).cast("long").alias("n_links"), F.array_join(links, " ").alias("links"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(url), '^[a-z]+://', ''), '^(www|m)\.', ''), '[?#].*$', ''), '/+$', ''), '\.html$', '') AS address FROM pages""")
def canonical_url(spark, d):
    return _pages(spark, d).select("page_id", T.canonical_url("url").alias("address"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents WHERE lang IN ('en', 'de')) WHERE r <= 10")
def lang_and_source_cap(spark, d):
    return text.source_cap(_docs(spark, d).filter(F.col("lang").isin("en", "de")).select("doc_id", "source"), 10)


@query(r"""
WITH w AS (SELECT doc_id, regexp_extract_all(text, '\S+') AS w, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents),
     c AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS gram FROM w WHERE len(w) >= 3),
     k AS (SELECT doc_id, gram, count(*) AS c FROM c GROUP BY doc_id, gram),
     g AS (SELECT doc_id, count(*) AS unlike, sum(c) AS n, max(c) AS top FROM k GROUP BY doc_id)
SELECT doc_id, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0.0 END AS mean_word,
       CAST(len(list_filter(w, lambda x: list_contains(['the', 'be', 'to', 'of', 'and', 'that', 'have', 'with'], lower(x)))) AS BIGINT) AS stop_words,
       CASE WHEN len(lines) > 0 THEN round(len(list_filter(lines, lambda x: regexp_matches(x, '[.!?"]$'))) / len(lines), 6) ELSE 0.0 END AS ended_lines,
       coalesce(round(1 - unlike / n, 6), 0.0) AS repeated_grams, coalesce(round(top / n, 6), 0.0) AS top_gram FROM w LEFT JOIN g USING (doc_id)""")
def text_repetition(spark, d):
    return text.text_repetition(_docs(spark, d))


@query(r"""
WITH t AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS n_words, CAST(length(text) AS BIGINT) AS n_chars,
           len(regexp_extract_all(text, '\p{L}')) AS letters, len(regexp_extract_all(text, '[#$%&*|]')) AS marks, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, n_words, n_chars, CASE WHEN n_chars > 0 THEN round(letters / n_chars, 6) ELSE 0.0 END AS letter_share, CASE WHEN n_words > 0 THEN round(marks / n_words, 6) ELSE 0.0 END AS marks_per_word,
       CASE WHEN len(lines) > 0 THEN round(1 - len(list_distinct(lines)) / len(lines), 6) ELSE 0.0 END AS repeated_lines FROM t""")
def text_profile(spark, d):
    return text.text_profile(_docs(spark, d))


@query(r"SELECT min(doc_id) AS keep, count(*) AS copies FROM documents GROUP BY md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g')))")
def exact_dedup(spark, d):
    return text.exact_dedup(_docs(spark, d))


@query("SELECT doc_id, CASE WHEN CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 10 THEN 'valid' ELSE 'train' END AS split FROM documents")
def hash_split(spark, d):
    return text.hash_split(_docs(spark, d).select("doc_id"), 10)


@query("SELECT doc_id FROM documents WHERE CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) % 10000 < 2500")
def hash_sample(spark, d):
    return text.hash_sample(_docs(spark, d).select("doc_id"), 0.25)


@query("SELECT lang, count(*) AS n_docs, count(quality) AS n_labelled, count(*) FILTER (WHERE quality = 1) AS n_good FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def label_join(spark, d):
    return text.label_join(_docs(spark, d), table(spark, d, "labels"))


@query("SELECT conv_id, string_agg('<' || role || '>' || text || '</' || role || '>', '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def chat_template(spark, d):
    return text.chat_template(table(spark, d, "conversations"))


@query(r"""WITH t AS (SELECT conv_id, turn, repeat(CASE WHEN role = 'assistant' THEN '1' ELSE '0' END, len(regexp_extract_all(text, '\S+'))) AS m FROM conversations)
SELECT conv_id, string_agg(m, '' ORDER BY turn) AS mask FROM t GROUP BY conv_id""")
def loss_mask(spark, d):
    return text.loss_mask(table(spark, d, "conversations")).select("conv_id", F.array_join(F.transform("mask", lambda x: x.cast("string")), "").alias("mask"))


@query("""WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
SELECT conv_id, count(*) AS n_turns, max(turn) = count(*) - 1 AS contiguous, bool_and(coalesce(before <> role, true)) AS alternates, bool_and(role <> 'system' OR turn = 0) AS system_first FROM t GROUP BY conv_id""")
def turn_validation(spark, d):
    return text.turn_validation(table(spark, d, "conversations"))


@query(r"SELECT doc_id, CASE WHEN length(text) > 0 THEN round(len(regexp_extract_all(text, '[0-9+*/=<>^\\]')) / length(text), 6) ELSE 0.0 END AS density FROM documents")
def math_density(spark, d):
    return _docs(spark, d).select("doc_id", F.round(T.math_density("text"), 6).alias("density"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(coalesce(regexp_extract_all(text, '####\s*(-?[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?)', 1)[-1], regexp_extract_all(text, '(?s).*\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}', 1)[-1]), '(\d),(\d)', '\1\2', 'g'), '(\d),(\d)', '\1\2', 'g') AS answer FROM documents""")
def math_answer(spark, d):
    return _docs(spark, d).select("doc_id", T.math_answer("text").alias("answer"))


DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
COS = f"{DOT.format('a.embedding', 'b.embedding')} / (sqrt({DOT.format('a.embedding', 'a.embedding')}) * sqrt({DOT.format('b.embedding', 'b.embedding')}))"


@query(f"""SELECT a.vec_id, round({DOT.format('a.embedding', 'b.embedding')}, 6) AS dot, round({COS}, 6) AS cosine,
       round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2)))), 6) AS l2
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_similarity(spark, d):
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    x, y = F.col("embedding"), F.col("other")
    return e.join(b, "vec_id").select("vec_id", F.round(V.dot(x, y), 6).alias("dot"), F.round(V.cosine(x, y), 6).alias("cosine"), F.round(V.l2(x, y), 6).alias("l2"))


@query(f"""SELECT query, vec_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS rank FROM (
SELECT a.vec_id AS query, b.vec_id, round({COS}, 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 5""")
def nearest_vectors(spark, d):
    e = table(spark, d, "embeddings")
    return vectors.nearest(e.filter("vec_id % 50 = 0"), e, 5)


@query("SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos")
def vector_centroids(spark, d):
    return vectors.centroids(table(spark, d, "embeddings"))
