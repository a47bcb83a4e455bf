"""The registered queries of the operators, as their contracts word them."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, conversation_repair, embedding_dedup, jaccard_join, line_dedup, mixing, ngram_scoring, quality, ranked_search, suffix_dedup, topk_search, toxicity,
    url_filter,
)
from tidemark.llm.common import crc_mod, materialize, table


EMPTY = hashlib.sha256(b"").hexdigest()


def op1_ngram_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_mod("doc_id", 7) == 2
    scored = ngram_scoring.score(docs, ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN).drop("text")


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: its host, lines before and after, and the sha-256 of the text that is left."""
    pages = table(spark, sf_dir, "pages")
    lines = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), line_dedup.html_lines(F.col("html")).alias("text"))
    # Two passes read the lines; the expressions that find them in html run once.
    cut = line_dedup.drop_boilerplate(materialize(lines), "host", "text")
    return cut.select(
        "page_id", "host", F.col("__lines").cast("long").alias("n_lines"), F.col("__dropped").cast("long").alias("n_dropped"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = crc_mod("doc_id", 5) == 0
    scored = toxicity.score(docs.select("doc_id", "text"), labels, ~held_out)
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    key, times = mixing.mix(docs)
    sizes = docs.select("doc_id", key.alias("key"), mixing.word_count("text").alias("size"))
    rows = sizes.join(times.withColumnsRenamed({"copies": "__copies", "times": "__times"}), "key")
    return mixing.shared(rows, "key").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("__own")).alias("taken"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def damaged(talks: DataFrame) -> DataFrame:
    """Conversation rows as op11 damages them; nulls of text and role are one space, and so they stand in the hashed key."""
    spaced = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced("text"), ".!?", "")).otherwise(spaced("text"))
    role = F.when(kind == 4, "user").otherwise(spaced("role"))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return talks.where(kind != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    reports = conversation_repair.repair(damaged(talks)).reports.withColumnsRenamed({"conv_id": "id", "sha256": "repaired_sha256"})
    whole = talks.select("conv_id").distinct().join(reports, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    # A conversation that lost all its rows has no report.
    none = {x: 0 for x in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": "", "repaired_sha256": EMPTY}
    return whole.select("conv_id", *[F.coalesce(x, F.lit(v)).alias(x) for x, v in none.items()])


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (table(spark, sf_dir, t) for t in ("documents", "labels"))
    held_out = crc_mod("doc_id", 4) == 2
    # One pass over the texts: learning and scoring read the statistics.
    measured = materialize(quality.measure(docs.select("doc_id", "text")).drop("text"))
    scored = quality.apply(measured, quality.fit(measured, labels, ~held_out))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_ngram_scoring, op2_suffix_dedup, op3_embedding_dedup, op4_bpe, op5_line_dedup,
        op6_topk_search, op7_toxicity, op8_mixing, op9_jaccard_join, op10_url_filter,
        op11_conversation_repair, op12_quality, op13_ranked_search,
    )
}

_LINES = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    html, '{line_dedup._HIDDEN}', '', 'g'), '{line_dedup._BLOCK}', chr(10), 'g'), '(?s)<[^>]*>', '', 'g'),
    '[ \t\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"""
_PARTS = """SELECT *, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages"""
_HOST = """coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"""
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_EDGE = "' ' || chr(9) || chr(13)"


def _fits(rule: url_filter.HostRule) -> str:
    return f"((host = '{rule.host}' OR ends_with(host, '.{rule.host}')) AND starts_with(path, '{rule.path}'))"


def _url_sql() -> str:
    rules = sorted(url_filter.HOST_RULES, key=lambda r: (-len(r.name), r.name))
    names = " ".join(f"WHEN {_fits(r)} THEN '{r.name}'" for r in rules)
    actions = " ".join(f"WHEN {_fits(r)} THEN '{r.action}'" for r in rules)
    others = " OR ".join(f"regexp_matches(lower(url), '{p.pattern}')" for p in url_filter.PATTERNS)
    return f"""WITH p AS ({_PARTS}),
        q AS (SELECT page_id, url, {_HOST} AS host, coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path FROM p)
        SELECT page_id, host, path, CASE {names} END AS rule,
            CASE {actions} WHEN {others} THEN 'block' ELSE 'allow' END AS verdict FROM q"""


SQL = {
    "op5_line_dedup": f"""WITH p AS ({_PARTS}),
        l AS (SELECT row_number() OVER () AS r, page_id, {_HOST} AS host, string_split({_LINES}, chr(10)) AS lines FROM p),
        u AS (SELECT r, host, unnest(list_distinct(list_transform(lines, lambda x: trim(x, {_EDGE})))) AS line FROM l),
        t AS (SELECT host, count(*) AS total FROM l GROUP BY host),
        b AS (SELECT host, line FROM u JOIN t USING (host) WHERE line <> '' GROUP BY host, line, total
              HAVING count(*) >= {line_dedup.MIN_PAGES} AND count(*) > {line_dedup.RATIO} * total),
        s AS (SELECT host, list(line) AS bad FROM b GROUP BY host),
        k AS (SELECT page_id, l.host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(bad, []::VARCHAR[]), trim(x, {_EDGE}))) AS kept
              FROM l LEFT JOIN s ON l.host = s.host)
        SELECT page_id, host, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
            sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256 FROM k""",
    "op10_url_filter": _url_sql(),
    "op13_ranked_search": f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWERED}, '{ranked_search.TERM}') AS t FROM documents),
        b AS (SELECT row_number() OVER () AS q, item_id, unnest(list_distinct(regexp_extract_all({_LOWERED}, '{ranked_search.TERM}'))) AS w FROM benchmark),
        s AS (SELECT count(*) AS n_all, sum(len(t))::BIGINT AS l_all FROM d WHERE len(t) > 0),
        u AS (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS w FROM d),
        p AS (SELECT r, doc_id, n, w, count(*) AS tf FROM u WHERE w IN (SELECT w FROM b) GROUP BY ALL),
        f AS (SELECT w, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, s GROUP BY w, n_all),
        c AS (SELECT r, doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))) AS x FROM p JOIN f USING (w), s),
        z AS (SELECT q, item_id, r, doc_id, sum(x)::BIGINT AS score FROM b JOIN c USING (w) GROUP BY ALL HAVING sum(x) > 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM z)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 50""",
}
