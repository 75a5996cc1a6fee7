"""Queries that apply each operator to its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, chat, host_quality, language, licences, mixing, revisits, simhash, toxicity, vector_dedup
from tessera.llm.common import id_remainder, materialize, read_table

TOXICITY_FOLDS, TOXICITY_HELD_OUT = 5, 0
LANGUAGE_FOLDS, LANGUAGE_HELD_OUT = 4, 2
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    held_out = id_remainder(F.col("doc_id"), TOXICITY_FOLDS) == TOXICITY_HELD_OUT
    model = toxicity.train(docs, labels, ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_vectors(read_table(spark, sf_dir, "embeddings"))


#: The extra conversation of op3: control strings inside its texts.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role").union(spark.sql("SELECT -7L, 1L, 'assistant'"))
    turns = chat.conversations_as_trees(rows.unionByName(extra.withColumn("text", F.lit(CONTROL_TEXT))))
    turns = materialize(turns, "conversations")
    formatted = chat.format_paths(turns, chat.reply_paths(turns.select("tree", "node", "parent", "score")))
    back = chat.read_back(materialize(formatted, "formatted"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return host_quality.judge(docs).select("doc_id", *host_quality.RULES, "base_failed", "kept")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = id_remainder(F.col("doc_id"), LANGUAGE_FOLDS) == LANGUAGE_HELD_OUT
    model = language.train(docs, ~held_out)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = bpe.encode_decode(docs, VOCABULARY, digests=True)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.transform("licences", lambda s: F.concat_ws(":", s["licence"], s["start"], s["end"]))
    return found.select("doc_id", F.size("licences").cast("long").alias("n_licences"), F.array_join(spans, ";").alias("spans"))


def page_captures(pages: DataFrame) -> DataFrame:
    """Web archive records for ``pages``, which hold no revisits of their own.

    Page p is a full response at time 10 p, with the MD5 of its HTML as entity tag. A revisit of its URL
    is recorded 15 before that for even pages and 5 after it for odd ones; by p modulo 5 its entity tag is
    weak and right (0, 1), another one (2), replaced by Last-Modified (3), or missing (4).
    """
    kind = F.col("page_id") % 5
    late = F.col("page_id") % 2 == 1
    day = F.concat(F.lit("day "), (F.col("page_id") % 7).cast("string"))
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit("")).cast("binary")), F.lit('"'))
    none = F.lit(None).cast("string")
    full = {"Content-Type": F.lit("text/html"), "ETag": tag, "Last-Modified": day, "Cache-Control": F.lit("max-age=60")}
    again = {
        "ETag": F.when(kind <= 1, F.concat(F.lit("W/"), tag)).when(kind == 2, F.lit('"other"')),
        "Last-Modified": F.when(kind == 3, day).otherwise(none),
        "Cache-Control": F.concat(F.lit("max-age="), F.col("page_id").cast("string")),
        "Content-Length": F.lit("0"),
    }

    def headers(of: dict[str, Column]) -> Column:
        return F.map_filter(F.create_map(*[x for k, v in of.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())

    first = pages.select((F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit(200).alias("status"), headers(full).alias("headers"))
    at = F.col("page_id") * 10 + F.when(late, 5).otherwise(-15)
    second = pages.select((F.col("page_id") * 2 + 1).alias("record_id"), "url", at.alias("ts"), F.lit(304).alias("status"), headers(again).alias("headers"))
    return first.unionByName(second)


def op10_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = revisits.resolve(page_captures(pages))
    lines = F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return found.select("record_id", "target_id", "verdict", F.array_join(lines, ";").alias("headers"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_vectors": op2_vectors,
    "op3_chat": op3_chat,
    "op4_simhash": op4_simhash,
    "op5_host_rules": op5_host_rules,
    "op6_mixing": op6_mixing,
    "op7_language": op7_language,
    "op8_bpe": op8_bpe,
    "op9_licences": op9_licences,
    "op10_revisits": op10_revisits,
}


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t-\r]+'), lambda x: x <> '')"


def _escaped(column: str) -> str:
    return rf"replace(replace(replace(coalesce({column}, ''), '\', '\\'), '</turn>', '<\/turn>'), '##', '#\#')"


OP2_SQL = f"""
WITH RECURSIVE vectors AS (
    SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
usable AS (
    SELECT r, vec_id, label, list_transform(v, lambda x: x / n) AS v FROM (
        SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM vectors
        WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
    WHERE n > 0),
links AS (
    SELECT a.r, b.r AS s FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.v) = len(b.v)
    WHERE list_inner_product(a.v, b.v) >= {vector_dedup.MIN_COSINE}),
steps AS (SELECT DISTINCT a.vec_id AS u, b.vec_id AS w FROM links JOIN usable a ON a.r = links.r JOIN usable b ON b.r = links.s),
reach AS (SELECT u, w FROM steps UNION SELECT reach.u, steps.w FROM reach JOIN steps ON reach.w = steps.u),
low AS (SELECT u, min(w) AS w FROM reach GROUP BY u),
counts AS (SELECT r, count(*) AS n FROM links GROUP BY r)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(w, vec_id)) AS component_id, vec_id IS NULL OR vec_id = least(vec_id, coalesce(w, vec_id)) AS kept
FROM vectors LEFT JOIN counts USING (r) LEFT JOIN low ON low.u = vec_id
"""

OP3_SQL = rf"""
WITH rows AS (
    SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, role, text FROM conversations
    UNION ALL SELECT -7, NULL, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, NULL, 1, 'assistant', '{CONTROL_TEXT}'),
turns AS (
    SELECT conv_id, alone, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
        PARTITION BY conv_id, alone ORDER BY turn NULLS FIRST, rows.role NULLS FIRST, rows.text NULLS FIRST) AS node,
        14 + length(replace({_escaped('rows.role')}, ':', '\:')) + length({_escaped('rows.text')}) AS chars
    FROM rows)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY node)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY node) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id, alone
"""

OP5_SQL = rf"""
WITH base AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
wins AS (
    SELECT r, unnest(range(1, len(ws) - 3)) AS i, ws FROM base WHERE len(ws) >= 5),
keyed AS (SELECT r, i, ws[i:i+4] AS k FROM wins),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS ls FROM base),
counts AS (
    SELECT base.r, doc_id, source, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[ \t-\r]', '', 'g'))::BIGINT AS word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
    FROM base JOIN lines USING (r) LEFT JOIN rep USING (r)),
failed AS (
    SELECT *, n_words < {host_quality.LEAST_WORDS} OR 100 * n_repeat_words > {host_quality.MOST_REPEATED_PERCENT} * n_words AS base_failed FROM counts),
hosts AS (SELECT source, count(*) AS n, sum(base_failed::BIGINT)::BIGINT AS k FROM failed GROUP BY source),
moments AS (
    SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, sum(n * (k / n) * (k / n)) AS q, sum(n::DOUBLE * n) AS s FROM hosts),
prior AS (
    SELECT k / n AS m, k / n * (1 - k / n) AS c, n - s / n - (h - 1) AS room, q - n * (k / n) * (k / n) AS dev, h FROM moments),
correlated AS (SELECT m, CASE WHEN c > 0 AND room > 0 THEN (dev / c - (h - 1)) / room ELSE 0 END AS rho FROM prior),
weighed AS (
    SELECT m, CASE WHEN rho > 1e-12 THEN least({host_quality.PRIOR_WEIGHT[1]}, greatest({host_quality.PRIOR_WEIGHT[0]}, 1 / rho - 1))
        ELSE {host_quality.PRIOR_WEIGHT[1]} END AS s FROM correlated),
verdicts AS (SELECT source, (k + m * s) / (n + s) <= {host_quality.MOST_HOST_FAILURES} AS host_kept FROM hosts, weighed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept
FROM failed JOIN verdicts ON failed.source IS NOT DISTINCT FROM verdicts.source
"""

OP6_SQL = rf"""
WITH sized AS (SELECT doc_id, source, len({_WORDS})::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [{', '.join(map(str, mixing.WEIGHTS))}][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(mixing.WEIGHTS)} + 1] AS weight FROM per),
levels AS (
    SELECT *, source_size * {mixing.MAX_REPEAT} / weight AS ful,
        (sum(source_size) OVER () - coalesce(sum(source_size * {mixing.MAX_REPEAT}) OVER before, 0))::DOUBLE
        / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS lvl
    FROM weighed WINDOW before AS (
        ORDER BY source_size * {mixing.MAX_REPEAT} / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
water AS (SELECT (SELECT lvl FROM levels WHERE lvl <= ful ORDER BY ful, lvl LIMIT 1) AS lvl),
targets AS (
    SELECT source, source_size, least((source_size * {mixing.MAX_REPEAT})::DOUBLE,
        coalesce(water.lvl * weight, (source_size * {mixing.MAX_REPEAT})::DOUBLE)) AS target FROM levels, water),
rated AS (
    SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
        ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(16**13)} AS draw
    FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + (draw < rate - floor(rate))::INT))::BIGINT AS taken FROM rated
"""

OP10_SQL = r"""
WITH parts AS (
    SELECT page_id, html, url, string_split(regexp_replace(url, '^([A-Za-z][A-Za-z0-9+.-]*:)?//', ''), '#')[1] AS plain FROM pages),
cut AS (
    SELECT page_id, html, string_split(plain, '?')[1] AS place, CASE WHEN contains(plain, '?') THEN plain[strpos(plain, '?') + 1:] ELSE '' END AS query FROM parts),
kept AS (
    SELECT page_id, html, string_split(place, '/')[1] AS host, place[len(string_split(place, '/')[1]) + 1:] AS path,
        rtrim(array_to_string(list_filter(string_split(query, '&'), lambda p: NOT starts_with(p, 'utm_')), '&'), '&') AS query FROM cut),
named AS (
    SELECT page_id, html, path, query, CASE WHEN starts_with(lower(host), 'www.') THEN lower(host)[5:] ELSE lower(host) END AS host FROM kept),
canon AS (
    SELECT page_id, html, CASE WHEN host LIKE '%:80' THEN host[:-4] WHEN host LIKE '%:443' THEN host[:-5] ELSE host END
        || CASE WHEN query = '' THEN CASE WHEN path LIKE '%/' THEN path[:-2] ELSE path END
            ELSE path || '?' || CASE WHEN query LIKE '%/' THEN query[:-2] ELSE query END END AS url FROM named),
recs AS (
    SELECT page_id, url, page_id * 2 AS record_id, page_id * 10 AS ts, 200 AS status, '"' || md5(coalesce(html, '')) || '"' AS etag,
        'day ' || (page_id % 7) AS modified, NULL::BIGINT AS kind FROM canon
    UNION ALL
    SELECT page_id, url, page_id * 2 + 1, page_id * 10 + CASE WHEN page_id % 2 = 1 THEN 5 ELSE -15 END, 304,
        CASE WHEN page_id % 5 <= 1 THEN 'W/"' || md5(coalesce(html, '')) || '"' WHEN page_id % 5 = 2 THEN '"other"' END,
        CASE WHEN page_id % 5 = 3 THEN 'day ' || (page_id % 7) END, page_id % 5 FROM canon),
joined AS (
    SELECT *, last_value(CASE WHEN status = 200 THEN {'id': record_id, 'etag': etag, 'modified': modified} END IGNORE NULLS) OVER (
        PARTITION BY url ORDER BY ts, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM recs),
judged AS (
    SELECT *, CASE WHEN t IS NULL OR url IS NULL THEN 'no_response' WHEN etag IS NULL AND modified IS NULL THEN 'unverified'
        WHEN CASE WHEN etag IS NOT NULL THEN replace(etag, 'W/', '') = t.etag ELSE modified = t.modified END THEN 'resolved'
        ELSE 'mismatch' END AS verdict
    FROM joined WHERE status = 304)
SELECT record_id, CASE WHEN url IS NOT NULL THEN t.id END AS target_id, verdict,
    'cache-control=max-age=' || page_id || CASE WHEN verdict = 'resolved'
        THEN ';content-type=text/html;etag=' || coalesce(etag, t.etag) || ';last-modified=' || coalesce(modified, t.modified)
        ELSE ';content-length=0' || coalesce(';etag=' || etag, '') || coalesce(';last-modified=' || modified, '') END AS headers
FROM judged
"""

ORACLE_SQL: dict[str, str] = {"op2_vectors": OP2_SQL, "op3_chat": OP3_SQL, "op5_host_rules": OP5_SQL, "op6_mixing": OP6_SQL, "op10_revisits": OP10_SQL}
