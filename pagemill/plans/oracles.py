"""DuckDB SQL oracles for the driver queries.

Each oracle inlines the same driver view (FIXTURES.md section 3) as a CTE
and then states the operator's semantics in plain SQL, independently of the
Spark code path.  Column names and types match the Spark results.
"""

from __future__ import annotations

RAW_ITEMS_CTE = """raw_items AS (
  SELECT l_orderkey * 10 + l_linenumber AS seq,
         CASE WHEN l_orderkey % 41 = 0 THEN '  ' ELSE concat('Item ', l_partkey) END AS title,
         CASE WHEN l_partkey % 97 = 0 THEN 'POA' WHEN l_partkey % 89 = 0 THEN ''
              ELSE concat(' £', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ' ') END AS price,
         CASE WHEN l_suppkey % 53 = 0 THEN ''
              WHEN l_suppkey % 7 = 0 THEN 'Zero' WHEN l_suppkey % 7 = 1 THEN 'One'
              WHEN l_suppkey % 7 = 2 THEN 'Two' WHEN l_suppkey % 7 = 3 THEN 'Three'
              WHEN l_suppkey % 7 = 4 THEN 'Four' WHEN l_suppkey % 7 = 5 THEN 'Five'
              ELSE 'three' END AS rating,
         CASE WHEN l_returnflag = 'R' THEN '  In stock  ' ELSE 'Out of stock' END AS availability,
         concat('http://example.test/img/', l_partkey, '.jpg') AS image_url,
         concat('http://example.test/item/', l_partkey, '-', l_linenumber) AS url,
         l_shipdate AS scraped_at
  FROM lineitem)"""

# Expression snippets over raw_items columns.
REASON = """CASE WHEN trim(title) = '' THEN 'missing_title'
            WHEN trim(price) = '' THEN 'missing_price'
            WHEN trim(rating) = '' THEN 'missing_rating' END"""
NORM_PRICE = "trim(replace(trim({p}), '£', ''))"
PARSE_PRICE = "TRY_CAST(regexp_replace({p}, '[^0-9.]', '', 'g') AS DOUBLE)"
RATING_NUM = """CAST(CASE trim({r}) WHEN 'Zero' THEN 0 WHEN 'One' THEN 1 WHEN 'Two' THEN 2
            WHEN 'Three' THEN 3 WHEN 'Four' THEN 4 WHEN 'Five' THEN 5 ELSE 0 END AS INTEGER)"""
DEDUP_ORDER_SQL = "seq, title, price, rating, availability, image_url, scraped_at"

VALID_CTE = f"""valid AS (SELECT * FROM raw_items WHERE ({REASON}) IS NULL)"""
ACCEPTED_CTE = f"""accepted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY {DEDUP_ORDER_SQL}) AS rn
                 FROM valid) WHERE rn = 1)"""
PREPARED_SELECT = f"""SELECT title,
       {NORM_PRICE.format(p='price')} AS price,
       coalesce({PARSE_PRICE.format(p=NORM_PRICE.format(p='price'))}, 0.0) AS price_numeric,
       rating,
       {RATING_NUM.format(r='rating')} AS rating_numeric,
       trim(availability) AS availability,
       image_url, url, scraped_at"""
PREPARED_CTE = f"""prepared AS ({PREPARED_SELECT} FROM accepted)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


ORACLES: dict[str, str] = {}

ORACLES["prepare_items"] = _with(RAW_ITEMS_CTE, VALID_CTE, ACCEPTED_CTE) + PREPARED_SELECT + " FROM accepted"

TAGS_CTE = f"""tags AS (
  SELECT seq, title, price, rating, availability, image_url, url, scraped_at,
         CASE WHEN NOT v THEN 'invalid_record' WHEN rn = 1 THEN 'processed' ELSE 'duplicate_url' END AS outcome,
         coalesce(v AND rn = 1 AND {PARSE_PRICE.format(p=NORM_PRICE.format(p='price'))} IS NULL, false) AS price_unparseable
  FROM (SELECT *, CASE WHEN v THEN row_number() OVER (PARTITION BY url, v ORDER BY {DEDUP_ORDER_SQL}) END AS rn
        FROM (SELECT *, ({REASON}) IS NULL AS v FROM raw_items)))"""

RAW_COLS = "seq, title, price, rating, availability, image_url, url, scraped_at"

ORACLES["validate_items"] = _with(RAW_ITEMS_CTE) + f"SELECT {RAW_COLS}, {REASON} AS reason FROM raw_items"
ORACLES["normalize_price"] = _with(RAW_ITEMS_CTE) + \
    f"SELECT seq, url, price, {NORM_PRICE.format(p='price')} AS price_normalized FROM raw_items"
ORACLES["parse_price"] = _with(RAW_ITEMS_CTE) + f"""SELECT seq, url, price,
  CASE WHEN isinf({PARSE_PRICE.format(p='price')}) THEN NULL ELSE {PARSE_PRICE.format(p='price')} END AS price_value
  FROM raw_items"""
ORACLES["normalize_availability"] = _with(RAW_ITEMS_CTE) + \
    "SELECT seq, url, availability, trim(availability) AS availability_normalized FROM raw_items"
ORACLES["rating_to_numeric"] = _with(RAW_ITEMS_CTE) + \
    f"SELECT seq, url, rating, {RATING_NUM.format(r='rating')} AS rating_numeric FROM raw_items"
ORACLES["dedup_items"] = _with(RAW_ITEMS_CTE, VALID_CTE, ACCEPTED_CTE) + f"SELECT {RAW_COLS} FROM accepted"
ORACLES["tag_items"] = _with(RAW_ITEMS_CTE, TAGS_CTE) + "SELECT * FROM tags"
ORACLES["pipeline_stats"] = _with(RAW_ITEMS_CTE, TAGS_CTE) + """SELECT metric, value FROM (
  SELECT 'processed' AS metric, CAST(count(*) FILTER (WHERE outcome = 'processed') AS BIGINT) AS value FROM tags
  UNION ALL SELECT 'invalid_record', CAST(count(*) FILTER (WHERE outcome = 'invalid_record') AS BIGINT) FROM tags
  UNION ALL SELECT 'duplicate_url', CAST(count(*) FILTER (WHERE outcome = 'duplicate_url') AS BIGINT) FROM tags
  UNION ALL SELECT 'unparseable_price', CAST(count(*) FILTER (WHERE price_unparseable) AS BIGINT) FROM tags)
WHERE metric = 'processed' OR value > 0"""
ORACLES["catalog_rollup"] = _with(RAW_ITEMS_CTE, VALID_CTE, ACCEPTED_CTE, PREPARED_CTE) + """SELECT rating_numeric,
  availability, CAST(count(*) AS BIGINT) AS n_items, round(avg(price_numeric), 4) AS avg_price,
  min(price_numeric) AS min_price, max(price_numeric) AS max_price
FROM prepared GROUP BY rating_numeric, availability"""
_PV = PARSE_PRICE.format(p=NORM_PRICE.format(p='price'))
ORACLES["price_changes"] = _with(RAW_ITEMS_CTE, VALID_CTE) + f"""SELECT url, scraped_at, prev AS price_before,
  price_value AS price_after, round(price_value - prev, 2) AS delta
FROM (SELECT *, lag(price_value) OVER (PARTITION BY url ORDER BY scraped_at, seq, title, price, rating,
                                             availability, image_url) AS prev
      FROM (SELECT *, {_PV} AS price_value FROM valid WHERE {_PV} IS NOT NULL))
WHERE prev IS NOT NULL AND prev <> price_value"""
_CRAWL = """{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY """ + DEDUP_ORDER_SQL + \
    """) AS rn FROM raw_items WHERE scraped_at {op} TIMESTAMP '1998-01-01') WHERE rn = 1)"""
ORACLES["crawl_diff"] = _with(RAW_ITEMS_CTE, _CRAWL.format(name="prev", op="<"), _CRAWL.format(name="curr", op=">=")) + \
    """SELECT coalesce(p.url, c.url) AS url,
  CASE WHEN p.url IS NULL THEN 'added' WHEN c.url IS NULL THEN 'removed'
       WHEN p.title IS NOT DISTINCT FROM c.title AND p.price IS NOT DISTINCT FROM c.price
        AND p.rating IS NOT DISTINCT FROM c.rating AND p.availability IS NOT DISTINCT FROM c.availability
        AND p.image_url IS NOT DISTINCT FROM c.image_url THEN 'unchanged' ELSE 'changed' END AS change,
  p.price AS price_before, c.price AS price_after
FROM prev p FULL OUTER JOIN curr c ON p.url = c.url"""

# --- fetch_log <- events ---
FETCH_LOG_CTE = """fetch_log AS (
  SELECT event_id AS attempt_id, concat('http://example.test/u/', user_id) AS url, ts AS attempt_ts,
         CAST(CASE WHEN event_type <> 'error' THEN 200 WHEN event_id % 5 = 0 THEN 403 WHEN event_id % 5 = 1 THEN 404
                   WHEN event_id % 5 = 2 THEN 429 WHEN event_id % 5 = 3 THEN 500 ELSE 0 END AS INTEGER) AS status,
         CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 5 <> 4 THEN 'http'
              WHEN event_id % 3 = 0 THEN 'deadline' WHEN event_id % 3 = 1 THEN 'op_error' ELSE 'other' END AS error_kind,
         value / 100 AS duration_s
  FROM events)"""
IS_ERR = "(error_kind IS NOT NULL OR coalesce(status, 0) >= 400)"
ETYPE = """CASE WHEN error_kind IS NULL AND coalesce(status, 0) = 0 THEN 'unknown'
     WHEN error_kind IN ('deadline', 'net_timeout', 'op_timeout') THEN 'timeout'
     WHEN error_kind = 'op_error' THEN 'connection'
     WHEN status = 403 THEN 'forbidden' WHEN status = 404 THEN 'not_found' WHEN status = 429 THEN 'rate_limited'
     WHEN error_kind IS NULL THEN 'unknown' ELSE 'other' END"""
PER_URL_CTE = f"per_url AS (SELECT url, count(*) AS n FROM fetch_log WHERE {IS_ERR} GROUP BY url)"

ORACLES["classify_errors"] = _with(FETCH_LOG_CTE) + f"""SELECT attempt_id, url, status, error_kind,
  {IS_ERR} AS is_error, CASE WHEN {IS_ERR} THEN {ETYPE} END AS error_type FROM fetch_log"""
ORACLES["errors_by_type"] = _with(FETCH_LOG_CTE) + f"""SELECT {ETYPE} AS error_type,
  CAST(count(*) AS BIGINT) AS n_errors FROM fetch_log WHERE {IS_ERR} GROUP BY 1"""
ORACLES["requests_by_phase"] = _with(FETCH_LOG_CTE) + f"""
SELECT 'started' AS phase, CAST(count(*) AS BIGINT) AS n_requests FROM fetch_log
UNION ALL SELECT 'success', CAST(count(*) FILTER (WHERE NOT {IS_ERR}) AS BIGINT) FROM fetch_log
UNION ALL SELECT 'error', CAST(count(*) FILTER (WHERE {IS_ERR}) AS BIGINT) FROM fetch_log"""
ORACLES["latency_histogram"] = _with(FETCH_LOG_CTE, "obs AS (SELECT duration_s AS d FROM fetch_log WHERE coalesce(status, 0) > 0)",
                                     "b AS (SELECT unnest(['0.005','0.01','0.025','0.05','0.1','0.25','0.5','1','2.5','5','10','inf']::DOUBLE[]) AS le)") + \
    """SELECT b.le, CAST((SELECT count(*) FROM obs WHERE d <= b.le) AS BIGINT) AS cumulative_count,
  (SELECT coalesce(round(sum(d), 6), 0.0) FROM obs) AS sum_s, (SELECT CAST(count(*) AS BIGINT) FROM obs) AS count
FROM b"""


def _retry_plan_oracle(retries: int, base: int, cap: int) -> str:
    backoff = f"CAST(least({base} * pow(2, attempt - 1), {cap}) AS BIGINT)"
    return _with(FETCH_LOG_CTE, f"""errs AS (SELECT attempt_id, url, attempt_ts, {ETYPE} AS error_type,
  row_number() OVER (PARTITION BY url ORDER BY attempt_ts, attempt_id) AS attempt FROM fetch_log WHERE {IS_ERR})""") + \
        f"""SELECT attempt_id, url, attempt_ts, error_type, attempt, attempt <= {retries} AS scheduled,
  CASE WHEN attempt <= {retries} THEN {backoff} END AS backoff_ms,
  CASE WHEN attempt <= {retries} THEN attempt_ts + to_milliseconds({backoff}) END AS retry_at
FROM errs"""


ORACLES["retry_plan"] = _retry_plan_oracle(2, 200, 2000)
ORACLES["retry_plan_options"] = _retry_plan_oracle(3, 150, 500)
ORACLES["retry_backoff"] = _with(FETCH_LOG_CTE, f"""errs AS (SELECT attempt_id,
  row_number() OVER (PARTITION BY url ORDER BY attempt_ts, attempt_id) AS attempt FROM fetch_log WHERE {IS_ERR})""") + \
    "SELECT attempt_id, attempt, CAST(least(200 * pow(2, attempt - 1), 500) AS BIGINT) AS backoff_ms FROM errs"
ORACLES["retries_total"] = _with(FETCH_LOG_CTE, PER_URL_CTE) + \
    "SELECT CAST(coalesce(sum(least(n, 2)), 0) AS BIGINT) AS retries_total FROM per_url"
ORACLES["failed_urls"] = _with(FETCH_LOG_CTE, PER_URL_CTE) + \
    "SELECT url, CAST(n - least(n, 2) AS BIGINT) AS n_failed FROM per_url WHERE n > 2"
ORACLES["run_summary"] = _with(
    FETCH_LOG_CTE, PER_URL_CTE, RAW_ITEMS_CTE, TAGS_CTE,
    f"""base AS (SELECT CAST(count(*) AS BIGINT) AS total_requests, CAST(count(*) FILTER (WHERE {IS_ERR}) AS BIGINT) AS total_errors,
       min(attempt_ts) AS started_at, max(attempt_ts) AS finished_at FROM fetch_log)""",
    f"""emap AS (SELECT map_from_entries(list(struct_pack(k := error_type, v := n_errors) ORDER BY error_type)) AS errors_by_type
       FROM (SELECT {ETYPE} AS error_type, CAST(count(*) AS BIGINT) AS n_errors FROM fetch_log WHERE {IS_ERR} GROUP BY 1))""",
    """st AS (SELECT CAST(count(*) FILTER (WHERE outcome = 'processed') AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE outcome = 'invalid_record') AS BIGINT) AS inv,
       CAST(count(*) FILTER (WHERE outcome = 'duplicate_url') AS BIGINT) AS dup,
       CAST(count(*) FILTER (WHERE price_unparseable) AS BIGINT) AS unp FROM tags)""",
    """vmap AS (SELECT map_from_entries(list(struct_pack(k := metric, v := value) ORDER BY metric)) AS validation_errors
       FROM (SELECT 'invalid_record' AS metric, inv AS value FROM st UNION ALL SELECT 'duplicate_url', dup FROM st
             UNION ALL SELECT 'unparseable_price', unp FROM st) WHERE value > 0)""") + \
    """SELECT total_requests, total_errors,
  round(CASE WHEN total_requests = 0 THEN 0.0 ELSE (total_requests - total_errors) * 100.0 / total_requests END, 2) AS success_rate,
  (SELECT CAST(coalesce(sum(least(n, 2)), 0) AS BIGINT) FROM per_url) AS retries,
  (SELECT CAST(coalesce(sum(n - least(n, 2)), 0) AS BIGINT) FROM per_url) AS failed_entries,
  (SELECT processed FROM st) AS items_processed, errors_by_type, validation_errors, started_at, finished_at,
  coalesce((epoch_us(finished_at) - epoch_us(started_at)) / 1e6, 0.0) AS duration_s,
  round(CASE WHEN (epoch_us(finished_at) - epoch_us(started_at)) > 0
        THEN (SELECT processed FROM st) / ((epoch_us(finished_at) - epoch_us(started_at)) / 1e6) ELSE 0.0 END, 6) AS items_per_second
FROM base, emap, vmap"""

# --- pages ---
HOST_SQL = r"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^@/?#]*@)?(\[[^\]]*\]|[^:/?#]*)', 1))"
PATH_SQL = r"regexp_extract({u}, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
HOSTPORT_SQL = r"regexp_extract({u}, '^https?://([^/?#]+)', 1)"
ENTITIES_SQL = ("replace(replace(replace(replace(replace(replace(replace(replace({x}, '&pound;', '£'), '&lt;', '<'), "
                "'&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&')")
TEXT_OF = r"""trim(""" + ENTITIES_SQL.format(
    x=r"regexp_replace(array_to_string(regexp_extract_all({m}, '(?is)<{tag}(?:[\s/][^>]*)?>(.*?)</{tag}\s*>', 1), ''), '<[^>]*>', '', 'g')") + ")"
ARTICLES_CTE = r"""art AS (
  SELECT page_id, url, unnest(l) AS item_html, generate_subscripts(l, 1) - 1 AS item_pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<article(?:[\s/][^>]*)?>(.*?)</article\s*>', 1) AS l FROM pages))"""
ITEMS_CTE = f"""items AS (SELECT page_id, CAST(item_pos AS INTEGER) AS item_pos, {TEXT_OF.format(m='item_html', tag='h1')} AS title,
  '' AS price, '' AS rating, '' AS availability, '' AS image_url, url FROM art)"""
ORACLES["extract_items"] = _with(ARTICLES_CTE, ITEMS_CTE) + "SELECT * FROM items WHERE title <> '' AND url <> ''"
ORACLES["items_scraped"] = _with(ARTICLES_CTE, ITEMS_CTE) + \
    "SELECT CAST(count(*) AS BIGINT) AS items_scraped FROM items WHERE title <> '' AND url <> ''"
ORACLES["resolve_links"] = _with(r"""li AS (
  SELECT page_id, url, unnest(l) AS li_html, generate_subscripts(l, 1) AS li_pos
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<li(?:[\s/][^>]*)?>(.*?)</li\s*>', 1) AS l FROM pages))""",
    r"""a AS (SELECT page_id, url, li_pos, unnest(l) AS tag, generate_subscripts(l, 1) AS a_pos
  FROM (SELECT page_id, url, li_pos, regexp_extract_all(li_html, '(?is)(<a(?:[\s/][^>]*)?>)', 1) AS l FROM li))""",
    r"""t AS (SELECT page_id, url, tag, row_number() OVER (PARTITION BY page_id ORDER BY li_pos, a_pos) - 1 AS link_pos FROM a)""",
    ENTITIES_SQL.join([r"""h AS (SELECT page_id, url, link_pos, """, ""]).format(
        x=r"""CASE WHEN regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1) <> ''
                  THEN regexp_extract(tag, '(?is)\shref\s*=\s*"([^"]*)"', 1)
                  ELSE regexp_extract(tag, '(?is)\shref\s*=\s*''([^'']*)''', 1) END""") + " AS href FROM t)") + \
    r"""SELECT page_id, url, CAST(link_pos AS INTEGER) AS link_pos, href,
  CASE WHEN trim(href) = '' OR starts_with(trim(href), '#') THEN ''
       WHEN regexp_matches(trim(href), '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN trim(href)
       WHEN starts_with(trim(href), '//') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1) || ':' || trim(href)
       WHEN starts_with(trim(href), '/') THEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', 0) || trim(href)
       ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^?#]*/', 0) || trim(href) END AS abs_url
FROM h"""
ORACLES["next_links"] = f"""SELECT url, next_url FROM (
  SELECT url, lead(url) OVER (PARTITION BY {HOSTPORT_SQL.format(u='url')} ORDER BY page_id) AS next_url FROM pages)
WHERE next_url IS NOT NULL"""
ORACLES["dedup_pages"] = """WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000000, url FROM pages)
SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS rn FROM u) WHERE rn = 1"""
ORACLES["allowed_domains"] = f"""WITH p AS (SELECT page_id, url, {HOST_SQL.format(u='url')} AS host,
  {PATH_SQL.format(u='url')} AS path FROM pages)
SELECT page_id, url FROM p WHERE host IN (SELECT host FROM p WHERE starts_with(path, '/en/'))"""
ORACLES["robots_filter"] = f"""WITH p AS (SELECT page_id, url, {HOST_SQL.format(u='url')} AS host,
  {PATH_SQL.format(u='url')} AS path FROM pages),
r AS (SELECT h.host, x.allow, x.prefix FROM (SELECT DISTINCT host FROM p) h,
      (VALUES (false, '/fr/'), (false, '/es/'), (false, '/de/'), (true, '/fr/1')) x(allow, prefix)),
m AS (SELECT p.page_id, p.url, max(CASE WHEN r.allow THEN length(r.prefix) END) AS al,
             max(CASE WHEN NOT r.allow THEN length(r.prefix) END) AS dl
      FROM p LEFT JOIN r ON p.host = r.host AND starts_with(p.path, r.prefix) GROUP BY p.page_id, p.url)
SELECT page_id, url FROM m WHERE dl IS NULL OR (al IS NOT NULL AND al >= dl)"""
ORACLES["follow_next"] = f"""SELECT first_value(url) OVER w AS seed, CAST(row_number() OVER w AS INTEGER) AS hop, url
FROM pages WINDOW w AS (PARTITION BY {HOSTPORT_SQL.format(u='url')} ORDER BY page_id)"""

ORACLES["robots_patterns"] = f"""WITH p AS (SELECT page_id, url, {HOST_SQL.format(u='url')} AS host,
  {PATH_SQL.format(u='url')} || regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1) AS target FROM pages),
m AS (SELECT page_id, url, max(CASE WHEN allow THEN size END) AS al, max(CASE WHEN NOT allow THEN size END) AS dl
      FROM p LEFT JOIN (VALUES (false, 8, '^/.*\\.html$'), (false, 6, '^/en/.*7'), (true, 6, '^/en/1.*'), (false, 8, '^/fr/.*2.*\\?'), (false, 5, '^/de/$'))
        AS r(allow, size, pattern) ON regexp_matches(target, pattern) GROUP BY page_id, url)
SELECT page_id, url FROM m WHERE dl IS NULL OR (al IS NOT NULL AND al >= dl)"""
ORACLES["resolve_references"] = r"""WITH r AS (SELECT page_id, url, page_id % 12 AS k,
  ['a%zz/', 'http://[::1/', 'http://h.test:80x/', '', '/a%20b/', 'http://[::1]:8080/', 'http://us er@h.test/', '//cdn.test/',
   'x' || chr(7) || '/', '/p#%zq', '/ü/', 'mailto:'][page_id % 12 + 1] || page_id ||
  ['', '', '', ':x/y', '', '', '', '?q=%zz', '', '', '', '@h.test'][page_id % 12 + 1] AS ref FROM pages)
SELECT page_id, url, ref, CASE WHEN k IN (0, 1, 2, 3, 6, 8, 9) THEN '' WHEN k IN (5, 11) THEN ref
  WHEN k = 7 THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*:)', 1) || ref
  ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*') || ref END AS abs_url FROM r"""

CSV_TEXT_SELECT = """SELECT title, price, rating, CAST(rating_numeric AS VARCHAR) AS rating_numeric, availability,
  image_url, url, strftime(scraped_at, '%Y-%m-%dT%H:%M:%SZ') AS scraped_at, printf('%.2f', price_numeric) AS price_numeric"""
ORACLES["csv_roundtrip"] = _with(RAW_ITEMS_CTE, VALID_CTE, ACCEPTED_CTE, PREPARED_CTE) + CSV_TEXT_SELECT + " FROM prepared"
ORACLES["jsonl_roundtrip"] = ORACLES["prepare_items"]
ORACLES["dual_roundtrip"] = _with(RAW_ITEMS_CTE, VALID_CTE, ACCEPTED_CTE, PREPARED_CTE) + \
    CSV_TEXT_SELECT + ", 'csv' AS format FROM prepared UNION ALL " + CSV_TEXT_SELECT + ", 'json' AS format FROM prepared"
ORACLES["stream_dedup"] = _with(RAW_ITEMS_CTE, VALID_CTE) + "SELECT url, CAST(1 AS BIGINT) AS n_rows FROM valid GROUP BY url"
ORACLES["stream_drain"] = ORACLES["stream_dedup"]
ORACLES["chain_page_count"] = f"""WITH c AS (
  SELECT url, first_value(url) OVER w AS seed, row_number() OVER w AS hop, lead(url) OVER w AS nxt
  FROM pages WINDOW w AS (PARTITION BY {HOSTPORT_SQL.format(u='url')} ORDER BY page_id))
SELECT seed, CAST(count(*) FILTER (WHERE nxt IS NOT NULL) AS BIGINT) AS page_count,
       CAST(count(DISTINCT url) AS BIGINT) AS pages_visited
FROM c GROUP BY seed"""
ORACLES["stream_deterministic"] = ORACLES["prepare_items"]

ORACLES["stream_bounded"] = _with(RAW_ITEMS_CTE, VALID_CTE) + "SELECT DISTINCT url FROM valid"


def _recency_oracle(batches: int, capacity: int) -> str:
    """An LRU cache whose capacity is enforced between micro-batches, batch by batch."""
    ctes = [f"k AS (SELECT seq % {batches} AS b, url, max(seq) AS place FROM valid GROUP BY ALL)"]
    for i in range(batches):
        known = f" UNION ALL SELECT * FROM c{i - 1} WHERE url NOT IN (SELECT url FROM k WHERE b = {i})" if i else ""
        ctes.append(f"m{i} AS (SELECT url, place, {i} AS seen FROM k WHERE b = {i}{known})")
        ctes.append(f"c{i} AS (SELECT * FROM m{i} QUALIFY row_number() OVER (ORDER BY seen DESC, place DESC, url) <= {capacity})")
    written = " UNION ALL ".join(f"SELECT url FROM k WHERE b = {i}" + (f" AND url NOT IN (SELECT url FROM c{i - 1})" if i else "") for i in range(batches))
    return _with(RAW_ITEMS_CTE, VALID_CTE, *ctes) + f"SELECT url, count(*) AS n_rows FROM ({written}) GROUP BY url"


ORACLES["stream_recency"] = _recency_oracle(4, 2000)
ORACLES["stream_deterministic_batches"] = _with(RAW_ITEMS_CTE, VALID_CTE, f"""accepted AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY seq % 4, {DEDUP_ORDER_SQL}) AS rn FROM valid) WHERE rn = 1)""") \
    + PREPARED_SELECT + " FROM accepted"
ORACLES["manifest_roundtrip"] = ORACLES["dual_roundtrip"]
ORACLES["stream_csv"] = ORACLES["stream_dedup"]
ORACLES["stream_dual"] = _with(RAW_ITEMS_CTE, VALID_CTE) + """SELECT format, url, CAST(1 AS BIGINT) AS n_rows
FROM (SELECT DISTINCT url FROM valid), (VALUES ('csv'), ('json')) f(format)"""

# --- catalogue pages: expected from the columns the markup was built of ---
CATALOGUE_CTE = """catalogue AS (
  SELECT l_orderkey AS page_id, CAST(row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag) - 1 AS INTEGER) AS item_pos,
         CASE WHEN l_partkey % 31 = 0 THEN '' WHEN l_partkey % 3 = 0 THEN concat('5 > ', l_partkey, ' &lt; Café')
              WHEN l_partkey % 3 = 1 THEN concat('It''s ', l_partkey) ELSE concat('Item', l_partkey) END AS title,
         concat(CASE WHEN l_partkey % 4 = 3 THEN '€ ' ELSE '£' END, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR)) AS price,
         CASE WHEN l_partkey % 2 = 1 THEN 'star-rating'
              ELSE ['Zero', 'One', 'Two', 'Three', 'Four', 'Five', 'three'][l_suppkey % 7 + 1] END AS rating,
         CASE WHEN l_returnflag = 'R' THEN 'In stock' ELSE 'Sold out' END AS availability,
         CASE WHEN l_partkey % 2 = 0 THEN concat('http://cdn.test/', l_partkey, '.jpg')
              ELSE concat('http://shop.test/catalogue/img/', l_partkey, '.png') END AS image_url,
         CASE WHEN l_partkey % 37 = 0 THEN '' WHEN l_partkey % 2 = 0 THEN concat('http://shop.test/item/', l_orderkey, '-', l_linenumber, '.html')
              ELSE concat('http://shop.test/item/', l_orderkey, '-', l_linenumber) END AS url,
         min(l_shipdate) OVER (PARTITION BY l_orderkey) AS scraped_at
  FROM lineitem),
found AS (SELECT * FROM catalogue WHERE title <> '' AND url <> '')"""
ORACLES["extract_catalogue"] = _with(CATALOGUE_CTE) + "SELECT * FROM found"
ORACLES["catalogue_next_links"] = """SELECT l_orderkey AS page_id, concat('http://shop.test/catalogue/page-', l_orderkey, '.html') AS url,
  concat('http://shop.test/catalogue/page-', l_orderkey + 1, '.html') AS next_url
FROM (SELECT DISTINCT l_orderkey FROM lineitem) WHERE l_orderkey % 10 <> 9"""
ORACLES["stream_pages"] = _with(CATALOGUE_CTE) + """SELECT CAST(count(DISTINCT url) AS BIGINT) AS n_items,
  CAST(count(DISTINCT url) AS BIGINT) AS n_urls, CAST(count(DISTINCT url) AS BIGINT) AS processed, CAST(0 AS BIGINT) AS invalid_record,
  CAST(count(*) - count(DISTINCT url) AS BIGINT) AS duplicate_url FROM found"""
ORACLES["submit_items"] = _with(RAW_ITEMS_CTE) + f"""SELECT {RAW_COLS} FROM raw_items
UNION ALL SELECT p_partkey, p_name, NULL, NULL, NULL, NULL, concat('http://example.test/part/', p_partkey), NULL
FROM part WHERE p_partkey % 10 <> 0"""
ORACLES["crawl_run"] = _with(
    CATALOGUE_CTE,
    """ks AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)""",
    """crawled AS (SELECT * FROM found WHERE page_id IN (SELECT k FROM (
  SELECT k, count(*) OVER (PARTITION BY k // 10 ORDER BY k) AS n FROM ks) WHERE n = k % 10 + 1))""") + f"""SELECT title,
  {NORM_PRICE.format(p='price')} AS price, coalesce({PARSE_PRICE.format(p='price')}, 0.0) AS price_numeric, rating,
  {RATING_NUM.format(r='rating')} AS rating_numeric, availability, image_url, url, scraped_at
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, item_pos) AS rn FROM crawled) WHERE rn = 1"""
ORACLES["follow_next_all"] = f"""SELECT seed, CAST(hop AS INTEGER) AS hop, url FROM (
  SELECT url, first_value(url) OVER (PARTITION BY {HOSTPORT_SQL.format(u='url')} ORDER BY page_id) AS seed,
         row_number() OVER (PARTITION BY {HOSTPORT_SQL.format(u='url')} ORDER BY page_id) AS hop FROM pages)
WHERE hop <= 50"""
ORACLES["chain_page_count_all"] = f"""WITH c AS (
  SELECT url, first_value(url) OVER w AS seed, row_number() OVER w AS hop, lead(url) OVER w AS nxt
  FROM pages WINDOW w AS (PARTITION BY {HOSTPORT_SQL.format(u='url')} ORDER BY page_id))
SELECT seed, CAST(count(*) FILTER (WHERE nxt IS NOT NULL) AS BIGINT) AS page_count,
       CAST(count(DISTINCT url) AS BIGINT) AS pages_visited
FROM c WHERE hop <= 50 GROUP BY seed"""
ORACLES["crawl_run_all"] = _with(
    CATALOGUE_CTE,
    """ks AS (SELECT DISTINCT l_orderkey AS k FROM lineitem)""",
    """denied AS (SELECT DISTINCT k FROM (SELECT k, unnest(generate_series(1, length(CAST(k AS VARCHAR)))) AS n FROM ks)
  WHERE left(CAST(k AS VARCHAR), CAST(n AS BIGINT)) IN (SELECT CAST(k AS VARCHAR) FROM ks WHERE k % 97 = 14))""",
    """allowed AS (SELECT k FROM ks WHERE k NOT IN (SELECT k FROM denied))""",
    """crawled AS (SELECT * FROM found WHERE page_id IN (SELECT k FROM (
  SELECT k, count(*) OVER (PARTITION BY k // 10 ORDER BY k) AS n FROM allowed) WHERE n = k % 10 + 1))""") + f"""SELECT title,
  {NORM_PRICE.format(p='price')} AS price, coalesce({PARSE_PRICE.format(p='price')}, 0.0) AS price_numeric, rating,
  {RATING_NUM.format(r='rating')} AS rating_numeric, availability, image_url, url, scraped_at
FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id, item_pos) AS rn FROM crawled) WHERE rn = 1"""

ORACLES["output_validation"] = _with(RAW_ITEMS_CTE, VALID_CTE, "n AS (SELECT count(DISTINCT url) AS n FROM valid)") + """
SELECT format, output, n AS first_run, refused, CASE WHEN kept THEN n ELSE 0 END AS n_items, CASE WHEN kept THEN n ELSE 0 END AS n_urls
FROM n, (VALUES ('csv', 'csv', false, false), ('json', 'json', true, true), ('dual', 'csv', true, false), ('dual', 'json', true, true))
  AS v(format, output, refused, kept)"""
ORACLES["stream_resume"] = ORACLES["stream_dedup"]
ORACLES["stream_failure"] = _with(RAW_ITEMS_CTE, VALID_CTE) + """SELECT format, url, CAST(1 AS BIGINT) AS n_rows, true AS surfaced
FROM (SELECT DISTINCT url FROM valid), (VALUES ('csv'), ('json')) AS f(format)"""
ORACLES["stream_own_sink"] = _with(RAW_ITEMS_CTE, VALID_CTE) + """SELECT regexp_extract(url, '-([0-9]+)$', 1) AS line,
  count(DISTINCT url) AS n_urls FROM valid GROUP BY 1"""
