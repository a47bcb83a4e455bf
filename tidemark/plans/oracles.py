"""The registered queries as SQL over the same tables, worked out another way where there
is one: gaps and islands for sessions, literal overlap joins for segments, and so on."""

from __future__ import annotations

from .bindings import LABEL_AXIS, SPEC

NAMESPACE_HEX = "f47ac10b58cc4372a5670e02b2c3d479"
AS_OF = "TIMESTAMP '2024-01-20 12:34:56'"
START, END = "TIMESTAMP '2024-01-05'", "TIMESTAMP '2024-01-25'"
IN_A = "timestamp BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-10'"
IN_B = "timestamp BETWEEN TIMESTAMP '2024-01-12' AND TIMESTAMP '2024-01-21'"
IN_RANGE = f"timestamp BETWEEN {START} AND {END}"

M = """m AS (
  SELECT CAST(user_id AS VARCHAR) AS article_id,
         CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'vector' ELSE 'severity' END AS category,
         event_type AS label, ts AS timestamp, least(value / 100.0, 1.0) AS score, event_id
  FROM events)"""

# Classification rows in long form: one row per event, attribute and label.
L = M + """, k AS (
  SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k FROM events), l AS (
  SELECT CAST(event_id AS VARCHAR) AS id, article_id, timestamp, category, label, score FROM m
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), ts, 'tier',
         CASE WHEN k < 34 THEN 'low' WHEN k < 67 THEN 'mid' ELSE 'high' END, k / 100.0::DOUBLE
  FROM k)"""

A = """a AS (
  SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS title, 'c://' || c_custkey AS link,
         TIMESTAMP '2024-01-01' + to_minutes(c_custkey % 43200) AS timestamp
  FROM customer)"""

ISLANDS = """b AS (
  SELECT event_type AS service, ts,
         lag(ts) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events), n AS (
  SELECT *, sum(CASE WHEN before IS NULL OR epoch_us(ts) - epoch_us(before) > 600000000 THEN 1 ELSE 0 END)
         OVER (PARTITION BY service ORDER BY ts) AS number FROM b), u AS (
  SELECT service, min(ts) AS start, max(ts) AS recent FROM n GROUP BY service, number)"""


def uuid5(expr: str) -> str:
    h = f"sha1(unhex('{NAMESPACE_HEX}') || encode({expr}))"
    return (
        f"(substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || "
        f"translate(substr({h}, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h}, 18, 3) "
        f"|| '-' || substr({h}, 21, 12))"
    )


def signal(n: str, total: str, mean: str, var: str) -> dict[str, str]:
    freq = f"({n}::DOUBLE / {total})"
    return {
        "frequency": freq,
        "mean": mean,
        "variance": var,
        "weight": f"({freq} * {mean} * (1 - {var}))",
        "entropy": f"(CASE WHEN {mean} > 0 AND {mean} < 1 THEN "
        f"-({mean} * log2({mean}) + (1 - {mean}) * log2(1 - {mean})) ELSE 0 END)",
    }


def signal_list(n="n", total="total", mean="mean", var="var") -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in signal(n, total, mean, var).items())


SQL: dict[str, str] = {}

# --- aggregates ------------------------------------------------------------

SQL["treemap"] = f"""WITH {M} SELECT label, count(*) AS count FROM m
  WHERE score >= 0 AND {IN_RANGE} GROUP BY label"""

SQL["treemap_category_cutoff"] = f"""WITH {M} SELECT label, count(*) AS count FROM m
  WHERE score >= 0.5 AND category = 'vector' GROUP BY label"""


def heatmap(where: str) -> str:
    return f"""WITH {M}, r AS (SELECT CAST(timestamp AS DATE) AS day, score FROM m WHERE {where})
      SELECT day, round(count(*)::DOUBLE / (SELECT count(*) FROM r) * avg(score), 6) AS value
      FROM r GROUP BY day"""


SQL["heatmap_all"] = heatmap("true")
SQL["heatmap_label"] = heatmap(f"label = 'click' AND {IN_RANGE}")

SQL["label_metrics"] = f"""WITH {M}, r AS (
    SELECT * FROM m WHERE label IN ('view', 'click', 'error') AND {IN_RANGE})
  SELECT label, count(score) AS n, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS var,
         (SELECT count(score) FROM r) AS total
  FROM r GROUP BY label"""

_AGG = "count(score) AS n, avg(score) AS mean, var_pop(score) AS var"

SQL["signals"] = f"""WITH {M}, g AS (SELECT label, {_AGG}, (SELECT count(score) FROM m) AS total FROM m GROUP BY label)
  SELECT label, n AS count, {signal_list()} FROM g"""

SQL["classification_count"] = f"""SELECT count(*) AS count FROM events WHERE ts BETWEEN {START} AND {END}"""

SQL["label_delta"] = f"""WITH {M} SELECT 'click' AS label, count(*)::DOUBLE AS frequency,
    round(coalesce(avg(score), 0), 6) AS mean_confidence FROM m WHERE label = 'click' AND {IN_RANGE}"""

SQL["label_delta_empty"] = f"""WITH {M} SELECT 'no such label' AS label, count(*)::DOUBLE AS frequency,
    coalesce(avg(score), 0)::DOUBLE AS mean_confidence FROM m WHERE label = 'no such label'"""


def quadrant(first: str, second: str) -> str:
    def period(where: str) -> str:
        return f"""SELECT count(*)::DOUBLE AS f, coalesce(avg(score), 0) AS s FROM m
                   WHERE label = 'purchase' AND {where}"""

    return f"""WITH {M}, x AS ({period(first)}), y AS ({period(second)})
      SELECT 'purchase' AS label, round(CASE WHEN x.f = 0 THEN 0 ELSE y.f / x.f END, 6) AS frequency,
             round(y.s - x.s, 6) AS mean_confidence FROM x, y"""


SQL["quadrant"] = quadrant(IN_A, IN_B)
SQL["quadrant_zero_base"] = quadrant("timestamp BETWEEN TIMESTAMP '2020-01-01' AND TIMESTAMP '2020-02-01'", IN_B)

SQL["profile"] = f"""WITH {M}, r AS (SELECT * FROM m WHERE {IN_A}), g AS (
    SELECT category, label, {_AGG}, (SELECT count(score) FROM r) AS total FROM r GROUP BY category, label)
  SELECT category, label, {signal_list()} FROM g"""

_DELTA_SIDES = ", ".join(
    f"""{tag} AS (SELECT category, label, {{w}} AS weight, {{e}} AS entropy FROM (
      SELECT category, label, {_AGG}, (SELECT count(score) FROM m WHERE {period}) AS total
      FROM m WHERE {period} GROUP BY category, label))""".format(
        w=signal("n", "total", "mean", "var")["weight"], e=signal("n", "total", "mean", "var")["entropy"]
    )
    for tag, period in (("pa", IN_A), ("pb", IN_B))
)
_DRIFT = "coalesce(pb.weight, 0) - coalesce(pa.weight, 0)"
SQL["profile_delta"] = f"""WITH {M}, {_DELTA_SIDES}
  SELECT category, label, round(pa.weight, 6) AS weight_a, round(pb.weight, 6) AS weight_b,
         round({_DRIFT}, 6) AS weight_drift,
         round(coalesce(pb.entropy, 0) - coalesce(pa.entropy, 0), 6) AS entropy_shift,
         CASE WHEN pa.weight IS NULL THEN 'new' WHEN pb.weight IS NULL THEN 'gone'
              WHEN {_DRIFT} > 1e-9 THEN 'up' WHEN {_DRIFT} < -1e-9 THEN 'down' ELSE 'flat' END AS status
  FROM pa FULL OUTER JOIN pb USING (category, label)"""

SQL["data_keys"] = f"WITH {L} SELECT DISTINCT 'events' AS classification, category AS key FROM l"

# --- points and search -----------------------------------------------------

_POINT = "m.article_id, a.title, a.link, m.label, m.timestamp AS x, m.score AS y"
_JOINED = f"WITH {M}, {A} SELECT {_POINT}{{more}} FROM m JOIN a ON a.id = m.article_id WHERE "
SQL["plot_points"] = _JOINED.format(more="") + """m.category = 'vector' AND m.label = 'click'
  AND a.timestamp <= TIMESTAMP '2024-01-01 01:00:00'"""
SQL["scatter_cutoff"] = _JOINED.format(more="") + "m.category = 'severity' AND m.score >= 0.75"
_Z = "CASE m.label " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LABEL_AXIS.items()) + " ELSE 0 END::DOUBLE AS z"
SQL["scatter3d"] = (
    _JOINED.format(more=f", {_Z}") + "m.label IN ('click', 'purchase', 'error') AND m.score >= 0.9"
)


def search(where: str, cutoff: float, limit: int | None) -> str:
    """Newest row per article, cut, emptied rows dropped, then the latest ``limit``."""
    top = f"ORDER BY timestamp DESC, id LIMIT {limit}" if limit else ""
    return f"""WITH {L}, {A}, e AS (
        SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS article_id, ts AS timestamp FROM events),
      c AS (
        SELECT e.*, a.title, a.link,
               row_number() OVER (PARTITION BY e.article_id ORDER BY e.timestamp DESC, e.id) AS rank
        FROM e JOIN a ON a.id = e.article_id WHERE {where}),
      s AS (SELECT * FROM l WHERE score >= {cutoff}),
      t AS (SELECT * FROM c WHERE rank = 1 AND id IN (SELECT id FROM s) {top})
      SELECT t.id, t.article_id, t.timestamp, t.title, t.link, s.category, s.label, s.score
      FROM t JOIN s ON s.id = t.id"""


SQL["search_labels_all"] = search(
    f"""e.timestamp BETWEEN {START} AND {END} AND e.article_id IN (
      SELECT article_id FROM m WHERE label IN ('click', 'purchase')
      GROUP BY article_id HAVING count(DISTINCT label) = 2)""",
    0.5,
    50,
)
SQL["search_title_cutoff"] = search("a.title ILIKE '%customer#_0000000%'", 0.3, 200)
SQL["search_title_index"] = SQL["search_title_cutoff"]
SQL["title_candidates"] = f"""WITH {A} SELECT needle, count(*) AS n
  FROM a JOIN (VALUES ('CUSTOMER#'), ('00012'), ('er#0%7_1'), ('9'), ('_'), ('100%'), ('')) v(needle)
    ON title ILIKE '%' || needle || '%' GROUP BY needle"""
SQL["search_unlimited"] = search("true", -1, None)

SQL["score_cutoff"] = f"WITH {L} SELECT id, category, label, score FROM l WHERE score >= 0.8"

# --- articles --------------------------------------------------------------


def rate(unit: str, buckets: int) -> str:
    return f"""WITH g AS (
        SELECT i AS index, date_trunc('{unit}', {AS_OF}) - to_{unit}s(CAST({buckets - 1} - i AS INTEGER)) AS bucket_start
        FROM range({buckets}) t(i))
      SELECT index, bucket_start, count(e.event_id) AS count
      FROM g LEFT JOIN events e ON e.ts >= bucket_start AND e.ts < bucket_start + INTERVAL 1 {unit}
      GROUP BY index, bucket_start"""


SQL["article_rate_day"] = rate("hour", 24)
SQL["article_rate_month"] = rate("day", 30)

SQL["recent_articles"] = """SELECT CAST(event_id AS VARCHAR) AS id, event_type AS source_id,
    'webhook' AS source_type, event_type AS title, props AS content, ts AS timestamp,
    'e://' || event_id AS link, false AS processed
  FROM events ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 10"""

SQL["unprocessed_batch"] = """SELECT CAST(event_id AS VARCHAR) AS id, props AS content, ts AS timestamp
  FROM events WHERE event_type NOT IN ('view', 'error')
  ORDER BY ts DESC, CAST(event_id AS VARCHAR) LIMIT 10"""

SQL["processed_flag"] = """SELECT event_type AS source_id, event_type IN ('view', 'error') AS processed,
    count(*) AS n FROM events GROUP BY 1, 2"""

SQL["mark_processed"] = "SELECT DISTINCT CAST(user_id AS VARCHAR) AS article_id FROM events"

# --- uptime ----------------------------------------------------------------

SQL["uptime_sessions"] = f"WITH {ISLANDS} SELECT service, start, recent FROM u"
SQL["uptime_extend"] = SQL["uptime_sessions"]
SQL["stream_uptime"] = SQL["uptime_sessions"]

SQL["uptime_total"] = f"""WITH {ISLANDS}
  SELECT round(greatest(least(coalesce(sum(
      epoch_us(least(recent, TIMESTAMP '2024-01-15')) - epoch_us(greatest(start, TIMESTAMP '2024-01-05'))), 0)
      / (10 * 86400 * 1e6), 1), 0), 6) AS uptime
  FROM u WHERE recent > TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-15'"""

SQL["uptime_total_by_service"] = f"""WITH {ISLANDS}
  SELECT service, round(greatest(least(sum(
      epoch_us(least(recent, TIMESTAMP '2024-01-15')) - epoch_us(greatest(start, TIMESTAMP '2024-01-05')))
      / (10 * 86400 * 1e6), 1), 0), 6) AS uptime
  FROM u WHERE recent > TIMESTAMP '2024-01-05' AND start < TIMESTAMP '2024-01-15' GROUP BY service"""


def edges(step_seconds: int, buckets: int) -> str:
    """Bucket edges, one more than there are buckets."""
    return f"g AS (SELECT i, {AS_OF} - to_seconds(({buckets} - i) * {step_seconds}) AS edge FROM range({buckets} + 1) t(i))"


def segments(step_seconds: int, buckets: int, by: str = "") -> str:
    """Seconds of uptime before each edge, over all time; a bucket's share is the rise from its edge to the next."""
    one, per = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    shown = "WHERE EXISTS (SELECT 1 FROM u y WHERE y.service = r.service AND y.recent > first_edge AND y.start < last_edge AND y.recent > y.start)" if by else ""
    return f"""WITH {ISLANDS}, {edges(step_seconds, buckets)}, c AS (
        SELECT {one}i, edge, sum(greatest(epoch_us(least(edge, recent)) - epoch_us(start), 0))::HUGEINT AS before
        FROM g CROSS JOIN u GROUP BY ALL), r AS (
        SELECT {one}i AS index, edge AS bucket_start, lead(before) OVER ({per} ORDER BY i) - before AS rise,
               min(edge) OVER () AS first_edge, max(edge) OVER () AS last_edge FROM c)
      SELECT {one}index, bucket_start, round(100 * rise::DOUBLE / ({step_seconds} * 1e6), 6) AS percent
      FROM (SELECT * FROM r {shown}) WHERE rise IS NOT NULL"""


SQL["uptime_segments_day"] = segments(600, 144)
SQL["uptime_segments_month"] = segments(86400, 30)
SQL["uptime_segments_by_service"] = segments(600, 144, "service")
SQL["uptime_segments_by_service_month"] = segments(86400, 30, "service")

SQL["stream_closed_intervals"] = f"""WITH {ISLANDS} SELECT service, start, recent FROM u
  WHERE recent + INTERVAL 10 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

SQL["stream_uptime_closed"] = f"""WITH {ISLANDS} SELECT service, start, recent FROM u
  WHERE recent + INTERVAL 10 MINUTE < (SELECT max(ts) FROM events) - INTERVAL 1 HOUR"""

# --- filters ---------------------------------------------------------------

_TITLE = "lang || ' ' || source"
_DOCS = f"SELECT CAST(doc_id AS VARCHAR) AS id, {_TITLE} AS title FROM documents WHERE "
_BYTES = "octet_length(encode({}))"
SQL["filter_len"] = _DOCS + f"{_BYTES.format('text')} >= 1000 AND {_BYTES.format('text')} < 3000"
SQL["filter_regex"] = (
    _DOCS + rf"regexp_matches(text, '(?i)\bTHE\b[\s\S]*\.$') AND NOT regexp_matches({_TITLE}, '^(fr|de)')"
)
SQL["filter_contains"] = _DOCS + "contains(text, '@') AND NOT contains(text, 'the')"
SQL["filter_text_order"] = _DOCS + f"{_TITLE} >= 'en src2' AND {_TITLE} < 'es' AND doc_id <> 1"
SQL["filter_wildcard_negate"] = (
    _DOCS
    + f"""NOT (contains({_TITLE}, 'src1') OR contains(text, 'src1'))
      AND NOT (contains({_TITLE}, 'password') OR contains(text, 'password'))
      AND ({_BYTES.format(_TITLE)} >= 1000 OR {_BYTES.format('text')} >= 1000)"""
)
SQL["filter_failing"] = """SELECT 0::BIGINT AS sim, 0::BIGINT AS negated, 0::BIGINT AS ordered_bool,
    0::BIGINT AS bad_int, count(*) AS unknown_field FROM documents"""
SQL["filter_per_source"] = f"""SELECT CAST(doc_id AS VARCHAR) AS id, source AS source_id FROM documents
  WHERE CASE WHEN source IN ('src0', 'src3') THEN {_BYTES.format('text')} >= 2000
             WHEN source = 'src1' THEN contains(text, 'the') AND NOT contains(text, 'http')
             WHEN source = 'src2' THEN lang = 'en' ELSE true END"""

SQL["filter_empty"] = """WITH d AS (SELECT doc_id % 3 = 0 AS untitled, coalesce(text, '') = '' AS blank, doc_id % 2 = 0 AS unlinked FROM documents)
  SELECT count(*) FILTER (untitled) AS title, count(*) FILTER (NOT untitled) AS no_title,
         count(*) FILTER (untitled OR blank OR unlinked) AS one_is, count(*) FILTER (NOT (untitled OR blank OR unlinked)) AS none_is, 0::BIGINT AS unknown FROM d"""
SQL["filter_source_table"] = f"""WITH d AS (SELECT *, doc_id % 50 AS n FROM documents)
  SELECT CAST(doc_id AS VARCHAR) AS id, 'u' || n AS url FROM d WHERE n NOT IN (SELECT s_suppkey FROM supplier) OR
    CASE n % 3 WHEN 0 THEN {_BYTES.format("coalesce(text, '')")} >= 2000
               WHEN 1 THEN contains(text, 'the') AND NOT contains(text, 'http') ELSE lang = 'en' END"""

# --- text, ids, times ------------------------------------------------------

# The entities the pages hold, as characters.
_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "\u00a9", "&middot;": "\u00b7", "&amp;": "&"}


def clean(expr: str) -> str:
    for entity, char in _ENTITIES.items():
        expr = f"replace({expr}, '{entity}', '{char}')"
    expr = f"regexp_replace(regexp_replace({expr}, '<[^>]*>', '', 'g'), '[\\t\\n\\f\\r ]{{2,}}', ' ', 'g')"
    return f"regexp_replace({expr}, '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g')"


SQL["html_clean"] = f"SELECT page_id, {clean('html')} AS content FROM pages"
SQL["uuid5_links"] = f"SELECT page_id, {uuid5('url')} AS id FROM pages"

# HMAC-SHA256 by definition, for keys no longer than one block of 64 bytes or hashed when
# longer; the masks are applied byte by byte.
_KEY = "('key-' || repeat(event_type, CAST(event_id % 20 AS INTEGER)))"
_MASKED = """(SELECT string_agg(printf('%02x', xor(CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER), {mask})), '' ORDER BY i)
  FROM range(64) t(i))"""
SQL["hmac_hex"] = f"""WITH s AS (
    SELECT event_id, props, CASE WHEN length({_KEY}) > 64 THEN sha256({_KEY}) ELSE lower(hex({_KEY})) END AS kx FROM events),
  p AS (SELECT event_id, props, rpad(kx, 128, '0') AS h FROM s),
  q AS (SELECT event_id, props, {_MASKED.format(mask=0x36)} AS inner_key, {_MASKED.format(mask=0x5C)} AS outer_key FROM p)
  SELECT event_id, sha256(unhex(outer_key) || unhex(sha256(unhex(inner_key) || encode(props)))) AS signature FROM q"""

SQL["unix_time"] = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN epoch_us(ts)
    WHEN 1 THEN epoch_us(ts) // 1000 * 1000 WHEN 2 THEN epoch_us(ts) // 1000000 * 1000000
    WHEN 3 THEN 1000000000000 * 1000000 ELSE 1000000000000000 * 1000 END AS micros
  FROM events"""

SQL["rfc3339_time"] = """SELECT event_id, CASE event_id % 4 WHEN 0 THEN date_trunc('second', ts)
    WHEN 1 THEN ts - INTERVAL 2 HOUR END AS stamp FROM events"""

SQL["feed_date"] = """SELECT event_id, CASE WHEN event_id % 9 < 8 THEN date_trunc('second', ts) END AS stamp
  FROM events"""

# --- sources ---------------------------------------------------------------

SQL["feed_articles"] = f"""WITH p AS (SELECT *, page_id % 4 AS kind, {clean('html')} AS content FROM pages)
  SELECT {uuid5('url')} AS id, 't' AS title, md5(content) AS content_md5,
         CASE WHEN kind = 1 THEN {AS_OF} ELSE TIMESTAMP '2025-01-02 03:04:05' END AS timestamp, url AS link
  FROM p WHERE kind < 3 AND content <> ''"""

_LINKED = f"SELECT *, page_id % 4 AS kind, {clean('html')} AS content FROM pages"
SQL["feed_link_target"] = f"""SELECT 'f-' || CASE page_id % 5 WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'error' END AS source_id, count(*) AS n
  FROM ({_LINKED}) WHERE kind < 3 AND page_id % 5 >= 2 AND content <> '' GROUP BY 1"""
SQL["feed_limits"] = """SELECT 'f-' || page_id % 4 AS source_id, url || '#' || seq AS link, seq::BIGINT AS seq
  FROM pages, range(3) r(seq) WHERE seq < CASE page_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"""
SQL["feed_errors"] = """SELECT 'f-' || page_id % 8 AS source_id, CASE page_id % 8
      WHEN 1 THEN 'not a feed' WHEN 3 THEN 'feed is empty' WHEN 4 THEN 'feed is not json' WHEN 5 THEN 'not a feed'
      ELSE 'feed is not xml, or is cut off' END AS error, count(*) AS n
  FROM pages WHERE page_id % 8 < 6 GROUP BY page_id % 8"""
SQL["json_feed_articles"] = f"""WITH p AS ({_LINKED}), l AS (
    SELECT *, url AS link FROM p UNION ALL SELECT *, 'i2://' || page_id FROM p)
  SELECT {uuid5('link')} AS id, 't' AS title, md5(content) AS content_md5, TIMESTAMP '2024-05-06 05:08:09' AS timestamp, link
  FROM l WHERE content <> ''"""
SQL["archive_articles"] = f"""WITH d AS (SELECT 'doc://' || doc_id AS link, source AS title, {clean('text')} AS content FROM documents)
  SELECT {uuid5('link')} AS id, CASE WHEN title < 'src2' THEN 'rss' ELSE 'jsonl' END AS source_id, title,
         {_BYTES.format('content')} AS size, link FROM d WHERE content <> ''"""

_ITEM = f"""{uuid5("('e://' || event_id)")} AS id, 's-' || event_type AS source_id,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE event_type END AS title, props AS content,
    CASE event_id % 8 WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
      WHEN 2 THEN date_trunc('millisecond', ts) WHEN 3 THEN ts
      WHEN 7 THEN date_trunc('second', ts) - INTERVAL 2 HOUR ELSE {AS_OF} END AS timestamp,
    'e://' || event_id AS link"""
SQL["json_articles"] = f"SELECT {_ITEM} FROM events WHERE event_id % 5 < 3"
SQL["json_errors"] = """SELECT 's-' || event_type AS source_id,
    CASE event_id % 5 WHEN 3 THEN 'body is not json' ELSE 'items path does not lead to an array' END AS error,
    count(*) AS n FROM events WHERE event_id % 5 >= 3 GROUP BY 1, 2"""

_STATUS = """CASE WHEN event_id % 11 = 0 OR event_type = 'signup' THEN 404
    WHEN event_type IN ('view', 'error') AND event_id % 4 = 1 THEN 401
    WHEN event_type IN ('view', 'error') AND event_id % 4 = 2 THEN 403
    WHEN event_id % 7 IN (3, 5, 6) THEN 400 ELSE 202 END"""
SQL["webhook_status"] = f"SELECT event_id, ({_STATUS})::BIGINT AS status FROM events"
SQL["webhook_articles"] = f"SELECT {_ITEM} FROM events WHERE ({_STATUS}) = 202"

SQL["articles_of_all_kinds"] = f"""SELECT source_type, source_id, count(*) AS n FROM (
    SELECT 'rss' AS source_type,
           'f-' || ['view', 'click', 'purchase', 'signup', 'error'][page_id % 5 + 1] AS source_id
    FROM pages WHERE page_id % 4 < 3 AND {clean('html')} <> ''
    UNION ALL SELECT 'http', 'h' || source_id FROM ({SQL["json_articles"]}) WHERE source_id <> 's-signup'
    UNION ALL SELECT 'webhook', source_id FROM ({SQL["webhook_articles"]})) GROUP BY 1, 2"""

SQL["upload_classifications"] = f"""WITH {L} SELECT 'events' AS classification, id, article_id,
    CASE WHEN CAST(id AS BIGINT) % 3 = 0 THEN {AS_OF} ELSE date_trunc('second', timestamp) END AS timestamp,
    category, label, score FROM l"""

SQL["scrape_split"] = f"""WITH p AS (
    SELECT url, CASE page_id % 5 WHEN 0 THEN 'error' WHEN 1 THEN 'retry' ELSE 'completed' END AS type,
           CASE WHEN page_id % 5 = 0 THEN 'boom' ELSE '' END AS reason, page_id % 3 <> 0 AS titled FROM pages)
  SELECT 'url' AS kind, url AS key, type || '/' || reason AS value FROM p
  UNION ALL
  SELECT 'article', {uuid5('url')}, 'a title/2024-05-06 07:08:09' FROM p WHERE type <> 'error' AND titled"""

SQL["sources_active"] = """SELECT DISTINCT 's-' || event_type AS id, 'webhook://' || event_type AS url,
    'low' AS trust FROM events WHERE event_type <> 'signup'"""

SQL["attach_source"] = """SELECT CASE WHEN event_type = 'signup' THEN 'unknown' ELSE 'known' END AS part,
    's-' || event_type AS source_id, count(*) AS n FROM events GROUP BY 1, 2"""

# --- writes ----------------------------------------------------------------

SQL["insert_if_absent"] = f"""WITH b AS (
    SELECT 'o://' || l_orderkey AS link, l_orderkey,
           concat_ws('/', l_partkey, l_suppkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT)) AS title,
           l_partkey * 1000000 + l_suppkey * 100 + l_linenumber AS seq FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY seq, title) AS rank FROM b)
  SELECT {uuid5('link')} AS id, link, title FROM r
  WHERE rank = 1 AND l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'O')"""

_STORED = "SELECT s_suppkey AS k, s_name, 'http://s/' || s_suppkey AS url FROM supplier"
_V2 = "CASE WHEN k % 10 = 1 THEN s_name || ' v2' ELSE s_name END"
SQL["source_sync_diff"] = f"""WITH s AS ({_STORED})
  SELECT url, CASE WHEN k % 3 = 0 THEN 'delete' WHEN k % 10 = 1 THEN 'update' ELSE 'keep' END AS action FROM s
  UNION ALL SELECT 'http://new/' || k, 'insert' FROM s WHERE k % 3 = 0"""


def source_rows(where_kept: str, touched: str, where_new: str) -> str:
    return f"""WITH s AS ({_STORED})
      SELECT 'id-' || k AS id, CASE WHEN {touched} THEN {_V2} ELSE s_name END AS name, url,
             k % 2 = 0 AS active, TIMESTAMP '2023-01-01' AS created_at,
             CASE WHEN {touched} THEN {AS_OF} END AS updated_at FROM s WHERE {where_kept}
      UNION ALL
      SELECT {uuid5("('http://new/' || k)")}, {_V2}, 'http://new/' || k, k % 2 = 0, {AS_OF}, NULL
      FROM s WHERE {where_new}"""


SQL["source_sync"] = source_rows("k % 3 <> 0", "k % 10 = 1", "k % 3 = 0")
SQL["source_upsert"] = source_rows("true", "(k % 2 = 0 AND k % 3 <> 0)", "k % 2 = 0 AND k % 3 = 0")
SQL["source_delete"] = """SELECT 'id-' || s_suppkey AS source_id, s_name AS name, count(*) AS urls
  FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE s_suppkey % 2 = 0 GROUP BY s_suppkey, s_name"""

SQL["classification_reconcile_plan"] = """WITH stored AS (
    SELECT DISTINCT event_type AS c, unnest([CASE WHEN event_type IN ('view', 'click', 'purchase')
           THEN 'vector' ELSE 'severity' END, 'tier']) AS key FROM events),
  wanted(c, key) AS (VALUES ('view', 'vector'), ('view', 'tier'), ('click', 'vector'), ('click', 'actor'),
    ('purchase', 'sector'), ('error', 'severity'), ('error', 'tier'), ('error', 'actor'), ('brand', 'only')),
  d AS (
    SELECT coalesce(s.c, w.c) AS c, s.key AS s, w.key AS w,
           coalesce(s.c, w.c) IN (SELECT c FROM stored) AS has_table,
           coalesce(s.c, w.c) IN (SELECT c FROM wanted) AS configured
    FROM stored s FULL OUTER JOIN wanted w ON s.c = w.c AND s.key = w.key)
  SELECT c AS classification,
         CASE WHEN NOT configured THEN 'drop' WHEN NOT has_table THEN 'create'
              WHEN count(*) FILTER (s IS NULL OR w IS NULL) > 0 THEN 'update' ELSE 'keep' END AS action,
         CASE WHEN configured AND has_table THEN coalesce(string_agg(w, ',' ORDER BY w) FILTER (s IS NULL), '') ELSE '' END AS added,
         CASE WHEN configured AND has_table THEN coalesce(string_agg(s, ',' ORDER BY s) FILTER (w IS NULL), '') ELSE '' END AS removed
  FROM d GROUP BY c, configured, has_table"""

SQL["key_drift"] = f"""WITH {L}
  SELECT id, category, label, score FROM l WHERE category = 'severity'
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), unnest(['vector', 'actor']), 'n/i', 0.0::DOUBLE FROM events"""

# --- classification --------------------------------------------------------

SQL["flatten_metrics"] = f"""WITH {L} SELECT 'events' AS classification, category, label,
    count(*) AS n, round(sum(score), 6) AS score FROM l GROUP BY category, label"""

SQL["topn_sentinel"] = f"""WITH {M}, t AS (
    SELECT event_id, 'a' AS label, score FROM m UNION ALL SELECT event_id, 'b', 1.0 - score FROM m
    UNION ALL SELECT event_id, 'c', (event_id % 10) / 10.0::DOUBLE FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, label) - 1 AS pos
        FROM t WHERE score >= 0.6)
  SELECT event_id, pos, label, score FROM r WHERE pos < 2
  UNION ALL
  SELECT event_id, 0, 'n/i', 0.0 FROM m WHERE event_id NOT IN (SELECT event_id FROM r)"""


def classified(where: str = "true") -> str:
    """Long classification rows of documents, per attribute: hits, scores, cut, trim, sentinel."""
    parts, docs = [], "SELECT doc_id, lower(text) AS low FROM documents WHERE " + where
    for attr in SPEC.classifications["Prose"]:
        hits = {
            x.name: " + ".join(
                f"(length(low) - length(replace(low, '{w}', ''))) / {len(w)}.0::DOUBLE" for w in x.name.split()
            )
            for x in attr.labels
        }
        union = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, {v} AS h FROM d" for k, v in hits.items())
        score = "h / (1.0 + h)" if attr.top_n > 1 else "(1.0 + h) / sum(1.0 + h) OVER (PARTITION BY doc_id)"
        parts.append(f"""SELECT * FROM (
          WITH d AS ({docs}), x AS ({union}), s AS (SELECT doc_id, label, {score} AS score FROM x),
          r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, label) AS rank
                FROM s WHERE score >= {attr.cutoff})
          SELECT doc_id, '{attr.name}' AS category, label, score FROM r WHERE rank <= {attr.top_n}
          UNION ALL
          SELECT doc_id, '{attr.name}', 'n/i', 0.0 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM r))""")
    return " UNION ALL ".join(parts)


SQL["classify_lexical"] = f"""SELECT 'prose' AS classification, CAST(doc_id AS VARCHAR) AS article_id,
    TIMESTAMP '2024-01-01' + to_minutes(doc_id) AS timestamp, category, label, round(score, 6) AS score
  FROM ({classified()})"""
SQL["classify_scorer"] = SQL["classify_lexical"]
SQL["classify_per_source"] = """SELECT 'prose' AS classification, CAST(doc_id AS VARCHAR) AS article_id
  FROM documents WHERE source NOT IN ('src0', 'src1')"""
SQL["stream_ingest"] = f"""SELECT 'prose' AS classification, category, label, count(*) AS n,
    round(sum(score), 6) AS score
  FROM ({classified(_BYTES.format('text') + ' >= 500')}) GROUP BY category, label"""

_INVALID, _NO_MAP = "invalid json", "reply holds no scores by label"
SQL["label_score_parse"] = f"""WITH {M}
  SELECT event_id, 'A' AS label, score, NULL::VARCHAR AS error FROM m WHERE event_id % 7 < 4
  UNION ALL SELECT event_id, 'B', 0.25, NULL FROM m WHERE event_id % 7 < 3
  UNION ALL SELECT event_id, NULL, NULL, CASE event_id % 7 WHEN 4 THEN '{_INVALID}' WHEN 6 THEN '{_NO_MAP}' END
  FROM m WHERE event_id % 7 >= 4"""

# "language" keeps the best at or above 0.3, "content" the best two at or above 0.5.
SQL["classify_replies"] = f"""WITH {M}, s AS (
    SELECT event_id, 'A' AS label, score FROM m WHERE event_id % 7 < 4
    UNION ALL SELECT event_id, 'B', 0.25 FROM m WHERE event_id % 7 < 3),
  q AS (SELECT * FROM (VALUES ('language', 0.3, 1), ('content', 0.5, 2)) v(category, cutoff, top_n)),
  r AS (SELECT event_id, category, label, score, top_n,
               row_number() OVER (PARTITION BY event_id, category ORDER BY score DESC, label) AS rank
        FROM s, q WHERE score >= cutoff),
  o AS (SELECT event_id, category, label, score FROM r WHERE rank <= top_n
        UNION ALL SELECT m.event_id, q.category, 'n/i', 0.0 FROM m, q
        WHERE m.event_id % 7 IN (0, 1, 2, 3, 5) AND (m.event_id, q.category) NOT IN (SELECT (event_id, category) FROM r))
  SELECT CAST(o.event_id AS VARCHAR) AS article_id, date_trunc('second', m.timestamp) AS timestamp,
         NULL::VARCHAR AS error, o.category, o.label, o.score
  FROM o JOIN m ON m.event_id = o.event_id
  UNION ALL
  SELECT CAST(event_id AS VARCHAR), date_trunc('second', timestamp),
         'content: ' || CASE event_id % 7 WHEN 4 THEN '{_INVALID}' ELSE '{_NO_MAP}' END, NULL, NULL, NULL
  FROM m WHERE event_id % 7 IN (4, 6)"""

SQL["classify_replies_again"] = f"""SELECT article_id, error, category, label, score
  FROM ({SQL["classify_replies"]}) WHERE article_id::BIGINT % 2 = 1
  UNION ALL SELECT CAST(event_id AS VARCHAR), NULL, c, 'A', 0.75 FROM events, (VALUES ('language'), ('content')) v(c) WHERE event_id % 2 = 0"""

_ALL_SCORES = f"""SELECT 'prose' AS classification, category, label, count(*) AS n, round(sum(score), 6) AS score
  FROM ({classified()}) GROUP BY category, label"""
SQL["drain_unprocessed"] = _ALL_SCORES
SQL["classify_brought"] = f"{_ALL_SCORES} UNION ALL SELECT '', 'processed', '', 0, 0"

SQL["dead_letters"] = """SELECT CAST(user_id AS VARCHAR) AS article_id, 'events' AS classification,
    count(*) AS attempts, arg_max('boom ' || (event_id % 3), event_id) AS error
  FROM events WHERE event_type = 'error' GROUP BY user_id HAVING count(*) >= 5"""

# --- views and streams -----------------------------------------------------

_ERRORS = {
    "e1": "a quadrant compares two ranges; the second is missing",
    "e2": "panels of kind ''status'' cannot be drawn",
    "e3": "panels of kind ''tree'' cannot be drawn",
    "e4": "no such panel kind: ''pie''",
    "e5": "no such list: ''user''",
    "e6": "no such number: ''articles''",
}


def last_days(days: int) -> str:
    return f"timestamp BETWEEN {AS_OF} - INTERVAL {days} DAY AND {AS_OF}"


SQL["render_view"] = f"""WITH {M}, {A}, h AS (
    SELECT CAST(timestamp AS DATE) AS day, score FROM m WHERE label = 'view' AND {last_days(14)}),
  j AS (SELECT m.*, a.title FROM m JOIN a ON a.id = m.article_id)
  SELECT 'p1' AS panel, CAST(day AS VARCHAR) AS key,
         round(count(*)::DOUBLE / (SELECT count(*) FROM h) * avg(score), 6) AS value FROM h GROUP BY day
  UNION ALL SELECT 'p2', label, count(*)::DOUBLE FROM m WHERE category = 'severity' AND score >= 0.2 GROUP BY label
  UNION ALL SELECT 'p3', article_id || '/' || label || '/' || title, round(score, 6) FROM j
    WHERE label IN ('view', 'error') AND score >= 0.95
  UNION ALL SELECT 'p4', article_id || '/' || label || '/' ||
      (CASE label WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 0 END), round(score, 6)
    FROM j WHERE category = 'vector' AND score >= 0.98
  UNION ALL SELECT 'p5', CAST(index AS VARCHAR), count::DOUBLE FROM ({SQL["article_rate_month"]})
  UNION ALL SELECT 'p6', id || '/' || title, 0 FROM ({SQL["recent_articles"]})
  UNION ALL SELECT DISTINCT 'p7', 's-' || event_type || '/webhook://' || event_type, 0::DOUBLE FROM events
  UNION ALL SELECT 'p8', 'count', count(*)::DOUBLE FROM m WHERE {last_days(3)}
  UNION ALL SELECT 'p9', 'click', round(count(*) FILTER (timestamp >= {START}) / count(*) FILTER ({last_days(7)})::DOUBLE, 6)
    FROM m WHERE label = 'click'
  """ + " ".join(f"UNION ALL SELECT '{k}', '{v}', NULL" for k, v in _ERRORS.items())

SQL["stream_dedupe"] = f"""SELECT DISTINCT {uuid5("('u://' || user_id)")} AS id, 'u://' || user_id AS link FROM events"""

SQL["stream_dedupe_all"] = SQL["stream_dedupe"]

for _kept, _plain in {"label_metrics": "label_metrics", "signals": "signals", "heatmap": "heatmap_label", "label_delta": "label_delta", "quadrant": "quadrant"}.items():
    SQL[f"rollup_{_kept}"] = SQL[_plain]

SQL["stream_rollup"] = f"""WITH s AS ({classified(_BYTES.format("text") + " >= 500")})
  SELECT label, count(*) AS n, round(avg(score), 6) AS mean, round(var_pop(score), 6) AS var, (SELECT count(*) FROM s) AS total
  FROM s GROUP BY label"""

_V = "embedding::DOUBLE[]"
_EMBEDDED = f"""e AS (SELECT vec_id AS id, vec_id AS minute, {_V} AS v FROM embeddings UNION ALL
    SELECT vec_id + 1000000, vec_id + vec_id % 7 * 20,
      list_transform(list_zip({_V}, list_reverse({_V})), lambda p: p[1] + p[2] * CASE WHEN vec_id % 6 = 0 THEN 0.2 ELSE 0.9 END::DOUBLE)
    FROM embeddings WHERE vec_id % 3 = 0),
  n AS (SELECT DISTINCT a.id FROM e a JOIN e b ON b.minute BETWEEN a.minute - 60 AND a.minute AND (b.minute < a.minute OR b.id < a.id)
    AND list_cosine_similarity(a.v, b.v) >= 0.9)"""
SQL["near_copies"] = f"WITH {_EMBEDDED} SELECT id, id NOT IN (SELECT id FROM n) AS kept FROM e"
SQL["stream_near_copies"] = f"WITH {_EMBEDDED} SELECT id FROM n"

_UNLINKED = "event_type || chr(31) || user_id || chr(31) || coalesce(props, '') || chr(31) || strftime(ts, '%Y-%m-%d %H:%M:%S')"
SQL["article_ids"] = f"""SELECT event_id, {uuid5(f"(CASE WHEN event_id % 3 = 0 THEN 'e://' || event_id ELSE {_UNLINKED} END)")} AS id FROM events"""

SQL["classification_reconcile"] = f"""WITH {L}, x AS (
    SELECT e.event_type AS classification, l.category, l.label FROM l JOIN events e ON l.id = CAST(e.event_id AS VARCHAR)
    WHERE e.event_type IN ('view', 'click', 'error')), y AS (
    SELECT * FROM x WHERE NOT (classification = 'click' AND category = 'tier')
    UNION ALL SELECT event_type, 'actor', 'n/i' FROM events WHERE event_type IN ('click', 'error')
    UNION ALL SELECT event_type, 'metrics', 'all' FROM events WHERE event_type IN ('view', 'click', 'error'))
  SELECT classification, category, label, count(*) AS n FROM y GROUP BY ALL"""
