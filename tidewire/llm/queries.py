"""One query for each corpus operator, over its whole table with production parameters, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, byte_bpe, fill_in_middle, language_id, lexical_search, line_dedup, lm_scoring, mixing, mtree_search, secret_scan, simhash_dedup, toxicity, url_filters
from ._common import table


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filters.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language_id.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep_ids=False).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree_search.top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.detect_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm_scoring, op2_url_filters, op3_language_id, op4_source_mixing, op5_audio_features, op6_byte_bpe, op7_line_dedup,
        op8_secret_scan, op9_topk_search, op10_simhash_dedup, op11_toxicity, op12_fill_in_middle, op13_lexical_search, pipeline,
    )
}


def _glob_regex(glob: str) -> str:
    """The anchored regular expression of a glob of url_filters."""
    out, i = "", 0
    while i < len(glob):
        two = glob[i : i + 2]
        if two == "**":
            out, i = out + "(?s:.*)", i + 2
            continue
        c = glob[i]
        out += "[^/]*" if c == "*" else "[^/]" if c == "?" else "[" + c + "]" if not c.isalnum() and c != "/" else c
        i += 1
    return out


def _url_sql() -> str:
    rules = sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(('.' || host) LIKE '%.{h}' AND starts_with(path, '{p}'))" for h, p, _ in rules]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (h, p, _) in zip(fits, rules))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (_, _, v) in zip(fits, rules))
    globs = " OR ".join(f"regexp_full_match(plain, '{_glob_regex(g)}')" for g in url_filters.BLOCK_GLOBS)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    unreserved = "|".join(f"{c:02X}" for c in sorted(url_filters.UNRESERVED))

    def unescape(column: str) -> str:
        known = f"regexp_full_match(upper(substr(x, 1, 2)), '{unreserved}')"
        part = f"CASE WHEN i = 1 THEN x WHEN {known} THEN chr(CAST('0x' || substr(x, 1, 2) AS INTEGER)) || substr(x, 3) ELSE '%' || x END"
        return f"array_to_string(list_transform(string_split({column}, '%'), lambda x, i: {part}), '')"

    folded = "list_reduce(string_split(p, '/'), lambda a, x: CASE x WHEN '.' THEN a WHEN '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || x END)"
    return f"""
        WITH a AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
        c AS (SELECT page_id, translate(raw, '{upper}', '{upper.lower()}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
        d AS (SELECT *, translate({unescape("host")}, '{upper}', '{upper.lower()}') AS h, {unescape("path")} AS p FROM c),
        e AS (
            SELECT *, '.' || rtrim(regexp_replace(regexp_replace(h, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') ||
                CASE WHEN p LIKE '%/.%' THEN {folded} || CASE WHEN p LIKE '%/.' OR p LIKE '%/..' THEN '/' ELSE '' END ELSE p END AS plain
            FROM d
        )
        SELECT page_id, host, path, CASE {rule} ELSE NULL END AS rule, CASE {verdict} WHEN {globs} THEN 'block' ELSE 'allow' END AS verdict FROM e
    """


_LINES_SQL = """
    WITH l AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
        FROM documents
    ),
    k AS (
        SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM l
    ),
    r AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT k.doc_id, k.i, k.line, coalesce(k.doc_id < r.keeper, false) AS gone FROM k LEFT JOIN r ON k.key = r.key)
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM m GROUP BY doc_id
"""

_TOPK_SQL = """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings),
    s AS (
        SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
        FROM v AS q JOIN v AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
    ),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

_MIX_SQL = f"""
    WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('=' || source, '-') AS key, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    c AS (SELECT key, sqrt(count(*)) AS w, (count(*) + {mixing.BLOCK_ROWS - 1}) // {mixing.BLOCK_ROWS} AS blocks FROM d GROUP BY key),
    f AS (SELECT sum(w) AS total, least({mixing.FINE}, floor({mixing.MOST} / max(blocks * (SELECT sum(w) FROM c) / w))) AS fine FROM c),
    u AS (SELECT key, blocks, greatest(1, CAST(floor(w * fine / total + 0.5) AS BIGINT)) AS u FROM c, f),
    p AS (SELECT list(u ORDER BY key) AS units, list(key ORDER BY key) AS keys, CAST(sum(u) AS BIGINT) AS q FROM u),
    e AS (SELECT max((blocks * p.q + u - 1) // u) AS slots FROM u, p),
    r AS (
        SELECT CAST(0 AS BIGINT) AS slot, list_transform(units, lambda x: CAST(0 AS BIGINT)) AS done, CAST(0 AS BIGINT) AS s FROM p
        UNION ALL
        SELECT slot + 1, list_transform(done, lambda x, i: CASE WHEN i = pick THEN x + 1 ELSE x END), pick
        FROM (
            SELECT r.slot, r.done, CAST(list_min(list_filter(list_transform(p.units, lambda x, i:
                CASE WHEN (r.done[i] * p.q) // x <= r.slot THEN ((r.done[i] + 1) * p.q + x - 1) // x * 10000 + i ELSE NULL END),
                lambda y: y IS NOT NULL)) % 10000 AS BIGINT) AS pick
            FROM r CROSS JOIN p CROSS JOIN e WHERE r.slot < e.slots
        )
    ),
    j AS (SELECT p.keys[r.s] AS key, r.slot - 1 AS slot, row_number() OVER (PARTITION BY r.s ORDER BY r.slot) - 1 AS job FROM r CROSS JOIN p WHERE r.s > 0),
    n AS (SELECT doc_id, source, key, row_number() OVER (PARTITION BY key ORDER BY h, doc_id) - 1 AS mix_seq FROM d)
    SELECT n.doc_id, n.source, CAST(n.mix_seq AS BIGINT) AS mix_seq, CAST(n.mix_seq // {mixing.BLOCK_ROWS} AS BIGINT) AS mix_block, CAST(j.slot AS BIGINT) AS mix_slot
    FROM n JOIN j ON n.key = j.key AND n.mix_seq // {mixing.BLOCK_ROWS} = j.job
"""

_MIDDLE_SQL = """
    WITH a AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    b AS (SELECT *, CAST(length(t) AS BIGINT) AS n, list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(x, i, 8) AS BIGINT)) AS h FROM a),
    c AS (
        SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS lo, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS hi,
            CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
        FROM b
    ),
    d AS (SELECT *, substr(t, 1, lo) AS prefix, substr(t, lo + 1, hi - lo) AS middle, substr(t, hi + 1) AS suffix FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
        sha256(t) AS restored_sha256
    FROM d
"""

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS_SQL = f"regexp_extract_all(translate(text, {_UPPER}), '{lexical_search.TERM}')"
_SEARCH_SQL = f"""
    WITH r AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS_SQL} AS terms FROM documents WHERE text IS NOT NULL),
    d AS (SELECT row, doc_id, terms, CAST(len(terms) AS BIGINT) AS n FROM r WHERE len(terms) > 0),
    s AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM d),
    p AS (SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(terms) AS term FROM d) GROUP BY ALL),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM p, s GROUP BY term, docs),
    q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark) GROUP BY ALL),
    m AS (
        SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total)))) AS BIGINT) AS score
        FROM q JOIN w USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY ALL
    ),
    o AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM m WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 20
"""

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": _url_sql(),
    "op4_source_mixing": _MIX_SQL,
    "op7_line_dedup": _LINES_SQL,
    "op9_topk_search": _TOPK_SQL,
    "op12_fill_in_middle": _MIDDLE_SQL,
    "op13_lexical_search": _SEARCH_SQL,
}
