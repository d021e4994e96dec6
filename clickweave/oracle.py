"""DuckDB SQL for every query of ``clickweave.catalog``, written independently of the Spark plans."""

from __future__ import annotations

TASK, AD_THRESHOLD = "task-1", 5
START, END = "2024-01-05", "2024-01-20"
FLOW = (1, 2, 3, 4, 5, 6, 7)
SAMPLE_SEED = "42"
# Bounds of the report's buckets, both ends included, in seconds and in actions.
VISIT_BUCKETS = (
    ("visit_length_1s_3s", 1, 3), ("visit_length_4s_6s", 4, 6), ("visit_length_7s_9s", 7, 9),
    ("visit_length_10s_30s", 10, 30), ("visit_length_30s_60s", 31, 60), ("visit_length_1m_3m", 61, 180),
    ("visit_length_3m_10m", 181, 600), ("visit_length_10m_30m", 601, 1800), ("visit_length_30m", 1801, None),
)
STEP_BUCKETS = (
    ("step_length_1_3", 1, 3), ("step_length_4_6", 4, 6), ("step_length_7_9", 7, 9),
    ("step_length_10_30", 10, 30), ("step_length_30_60", 31, 60), ("step_length_60", 61, None),
)

_ACTION = """
e0 AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS INT) k,
    CASE user_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 5 ELSE 30 END sd,
    CASE user_id % 8 WHEN 0 THEN 4 WHEN 1 THEN 8 WHEN 2 THEN 12 WHEN 3 THEN 45
                     WHEN 4 THEN 90 WHEN 5 THEN 400 WHEN 6 THEN 1200 ELSE 3500 END span
  FROM events),
e1 AS (
  SELECT *, (event_id * 31) % 50 + CASE WHEN event_id % 41 = 0 THEN 1000000000 ELSE 0 END product,
    CAST(date '2024-01-01' + CAST(floor((day(ts) - 1) / sd) AS INT) * sd + CASE WHEN sd = 30 THEN 9 ELSE 0 END AS VARCHAR) bd,
    CAST((event_id * 37) % span AS INT) sec FROM e0),
all_actions AS (
  SELECT bd AS "date", user_id, concat(user_id, '_', bd) session_id, CAST(k % 10 AS BIGINT) page_id,
    concat(bd, ' ', user_id % 23, ':', lpad(CAST(CAST(floor(sec / 60) AS INT) AS VARCHAR), 2, '0'), ':',
           lpad(CAST(sec % 60 AS VARCHAR), 2, '0')) action_time,
    CASE WHEN event_type = 'view' THEN concat('kw', k % 10) END search_keyword,
    CAST(CASE WHEN event_type = 'click' THEN k ELSE -1 END AS BIGINT) click_category_id,
    CAST(CASE WHEN event_type = 'click' THEN product ELSE -1 END AS BIGINT) click_product_id,
    CASE WHEN event_type = 'signup' THEN concat(k, ',', (k * 3 + 1) % 100) END order_category_ids,
    CASE WHEN event_type = 'signup' THEN concat(product) END order_product_ids,
    CASE WHEN event_type = 'purchase' THEN concat(k, ',', (k * 7 + 2) % 100) END pay_category_ids,
    CASE WHEN event_type = 'purchase' THEN concat(product) END pay_product_ids,
    CAST(user_id * 7 % 27 AS BIGINT) city_id, event_id,
    CAST(bd AS TIMESTAMP) + to_seconds((user_id % 23) * 3600 + sec) AS ats
  FROM e1)
"""
_PERIOD = f"""
actions AS (SELECT * FROM all_actions WHERE "date" BETWEEN '{START}' AND '{END}')
"""
_TIMED = f"""
timed AS (SELECT * FROM all_actions
          WHERE ats >= TIMESTAMP '{START}' AND ats < TIMESTAMP '{END}' + INTERVAL 1 DAY)
"""
_RAW = """
raw AS (SELECT event_id, CASE WHEN event_id % 89 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END user_id,
          CASE WHEN event_id % 97 = 0 THEN substr(action_time, 12) WHEN event_id % 101 = 0 THEN "date"
               WHEN event_id % 103 = 0 THEN NULL ELSE action_time END action_time,
          CASE event_id % 4 WHEN 0 THEN concat(page_id, ', ', page_id) WHEN 1 THEN concat('0', page_id, ',', page_id)
               WHEN 2 THEN concat('x,', page_id) ELSE order_category_ids END order_category_ids,
          pay_category_ids, click_category_id, ats,
          event_id % 97 = 0 OR event_id % 101 = 0 OR event_id % 103 = 0 no_time, event_id % 89 = 0 no_user
        FROM all_actions)
"""
_RAW_TIMED = f"""
raw_timed AS (SELECT * FROM raw WHERE NOT no_time
              AND ats >= TIMESTAMP '{START}' AND ats < TIMESTAMP '{END}' + INTERVAL 1 DAY)
"""
_USERS = """
users AS (
  SELECT c_custkey + 5 user_id, CAST((c_custkey * 13) % 60 AS INT) age,
    concat('professional', c_custkey % 100) professional, concat('city', c_nationkey) user_city,
    CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END sex
  FROM customer)
"""


def _rollup(source: str) -> str:
    return f"""
rollup AS (
  SELECT session_id, min(user_id) user_id, min(ats) start_ts, max(ats) end_ts,
    CAST(epoch(max(ats)) - epoch(min(ats)) AS BIGINT) visit_length, count(*) step_length,
    list_sort(list(DISTINCT search_keyword) FILTER (WHERE search_keyword <> '')) kws,
    list_sort(list(DISTINCT click_category_id) FILTER (WHERE click_category_id <> -1)) cats
  FROM {source} GROUP BY session_id),
profile AS (SELECT * FROM rollup JOIN users USING (user_id)),
kept AS (SELECT * FROM profile WHERE age BETWEEN 20 AND 50)
"""


_SESSIONS = ",".join((_ACTION, _PERIOD, _USERS, _rollup("actions")))
_ACTION_LIST = (
    '"date", user_id, session_id, page_id, action_time, search_keyword, click_category_id, click_product_id, '
    "order_category_ids, order_product_ids, pay_category_ids, pay_product_ids, city_id, event_id"
)
_LISTS = (
    "coalesce(array_to_string(kws, ','), '') search_keywords, "
    "coalesce(array_to_string(cats, ','), '') click_category_ids"
)
_TIME = "'%Y-%m-%d %H:%M:%S'"
_PROFILE_LIST = (
    f"session_id, user_id, strftime(start_ts, {_TIME}) start_time, visit_length, step_length, {_LISTS}, "
    "age, professional, sex, user_city"
)


def _bucket_counts() -> str:
    parts = []
    for column, buckets in (("visit_length", VISIT_BUCKETS), ("step_length", STEP_BUCKETS)):
        for name, low, high in buckets:
            test = f"{column} >= {low}" + ("" if high is None else f" AND {column} <= {high}")
            parts.append(f"count(*) FILTER (WHERE {test}) {name}")
    return ", ".join(parts)


_BUCKETS = f"buckets AS (SELECT count(*) session_count, {_bucket_counts()} FROM kept)"
# round() differs between the engines on ties, so halves are rounded up in integers.
_RATIOS = ", ".join(
    f"((200 * {name} + n) // (2 * n)) / 100.0 AS {name}_ratio" for name, _, _ in VISIT_BUCKETS + STEP_BUCKETS)


def _sample(total: int) -> str:
    """Whole parts of the proportional shares first, then one more for each of the largest remainders."""
    return f"""
started AS (SELECT *, strftime(start_ts, '%Y-%m-%d') d, strftime(start_ts, '%H') h,
              md5(concat('{SAMPLE_SEED}', session_id)) pick FROM kept),
per_hour AS (SELECT d, h, count(*) hn FROM started GROUP BY d, h),
whole AS (SELECT count(*) n, least(count(*), {total}) wanted FROM kept),
share AS (SELECT d, h, (hn * wanted) // n w, (hn * wanted) % n rest, wanted FROM per_hour, whole),
quota AS (SELECT d, h, w + CASE WHEN row_number() OVER (ORDER BY rest DESC, d, h) <= wanted - sum(w) OVER () THEN 1 ELSE 0 END q
          FROM share),
sample AS (SELECT s.* FROM
             (SELECT *, row_number() OVER (PARTITION BY d, h ORDER BY pick, session_id) rn FROM started) s
           JOIN quota USING (d, h) WHERE rn <= q)
"""


def _category_events(source: str) -> str:
    return f"""
category_event AS (
  SELECT 'click' kind, click_category_id c FROM {source} WHERE click_category_id <> -1
  UNION ALL
  SELECT 'order', unnest(list_distinct(list_transform(string_split(order_category_ids, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)))) FROM {source}
  UNION ALL
  SELECT 'pay', unnest(list_distinct(list_transform(string_split(pay_category_ids, ','), lambda x: TRY_CAST(trim(x) AS BIGINT)))) FROM {source}),
category_count AS (
  SELECT c category_id, count(*) FILTER (WHERE kind = 'click') click_count,
    count(*) FILTER (WHERE kind = 'order') order_count, count(*) FILTER (WHERE kind = 'pay') pay_count
  FROM category_event WHERE c IS NOT NULL GROUP BY c),
top10 AS (SELECT * FROM category_count
          ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10)
"""


_CATEGORIES = ",".join((_ACTION, _TIMED, _category_events("timed")))

_FLOW = list(FLOW)
_STEP_ROWS = " UNION ALL ".join(
    [f"SELECT 0 step, '{_FLOW[0]}' page_split, count(*) page_count FROM linked WHERE page_id = {_FLOW[0]}"]
    + [f"SELECT {i}, '{a}_{b}', count(*) FROM linked WHERE page_id = {a} AND next_page_id = {b}"
       for i, (a, b) in enumerate(zip(_FLOW, _FLOW[1:]), 1)])
_PAGES = ",".join((_ACTION, _PERIOD, f"""
linked AS (SELECT session_id, event_id, page_id,
             lead(page_id) OVER (PARTITION BY session_id ORDER BY ats, event_id) next_page_id FROM actions),
flow AS ({_STEP_ROWS}),
rated AS (SELECT step, page_split,
            CASE WHEN before > 0 THEN CAST(page_count AS DOUBLE) / before END rate
          FROM (SELECT *, lag(page_count) OVER (ORDER BY step) before FROM flow) WHERE step > 0)
"""))

_AREAS = ",".join((_ACTION, _PERIOD, """
city AS (SELECT CAST(n_nationkey AS BIGINT) city_id, n_name city_name, r_name area
         FROM nation JOIN region ON n_regionkey = r_regionkey),
area_click AS (SELECT click_product_id, city_id FROM actions
               WHERE click_product_id <> -1 AND click_product_id IS NOT NULL),
base AS (SELECT city_id, city_name, area, click_product_id FROM area_click JOIN city USING (city_id)),
clicks AS (SELECT area, click_product_id, count(*) click_count,
             string_agg(DISTINCT concat(city_id, ':', city_name), ',' ORDER BY concat(city_id, ':', city_name))
               city_info
           FROM base GROUP BY area, click_product_id),
info AS (SELECT area, click_product_id, click_count, city_info, p_name product_name,
           CASE WHEN p_partkey % 2 = 0 THEN 'Self' ELSE 'Third Party' END product_status
         FROM clicks JOIN part ON click_product_id = p_partkey)
"""))

_ADS = f"""
ad AS (SELECT event_id, ts, strftime(ts, '%Y-%m-%d') "date", CAST(event_id % 10 // 3 AS VARCHAR) province,
         CAST(event_id % 10 AS VARCHAR) city, user_id % 50 userid,
         CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 adid FROM events),
user_day AS (SELECT "date", userid, adid, count(*) "clickCount" FROM ad GROUP BY ALL),
listed AS (SELECT DISTINCT userid FROM user_day WHERE "clickCount" >= {AD_THRESHOLD}),
running AS (SELECT *, count(*) OVER (PARTITION BY "date", userid, adid ORDER BY ts, event_id
                                     ROWS UNBOUNDED PRECEDING) n FROM ad),
listed_at AS (SELECT userid, min(ts) listed_ts FROM running WHERE n >= {AD_THRESHOLD} GROUP BY userid),
city_day AS (SELECT "date", province, city, adid, count(*) "clickCount" FROM ad GROUP BY ALL),
province_day AS (SELECT "date", province, adid, CAST(sum("clickCount") AS BIGINT) "clickCount"
                 FROM city_day GROUP BY ALL),
per_minute AS (SELECT date_trunc('minute', ts) m, adid, count(*) n FROM ad GROUP BY ALL)
"""
_AD_LIST = "event_id, province, city, userid, adid"
_PACKED = (
    "concat_ws('|', concat('sessionid=', session_id), concat('searchKeywords=', coalesce(search_keyword, '')), "
    "concat('clickCategoryIds=', click_category_id))"
)


def _pick(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


def all_oracles() -> dict[str, str]:
    named = {
        "action_scan": _pick(f"{_ACTION},{_PERIOD}", f"SELECT {_ACTION_LIST} FROM actions"),
        "action_scan_by_time": _pick(f"{_ACTION},{_TIMED}", f"SELECT {_ACTION_LIST} FROM timed"),
        "area_click_scan": _pick(_AREAS, "SELECT click_product_id, city_id FROM area_click"),
        "city_area_dim": _pick(_AREAS, "SELECT * FROM city"),
        "session_rollup": _pick(_SESSIONS, f"""
            SELECT session_id, user_id, strftime(start_ts, {_TIME}) start_time, strftime(end_ts, {_TIME}) end_time,
              visit_length, step_length, {_LISTS} FROM rollup"""),
        "session_profile": _pick(_SESSIONS, f"SELECT {_PROFILE_LIST} FROM profile"),
        "session_filter": _pick(_SESSIONS, f"SELECT {_PROFILE_LIST} FROM kept"),
        "session_filter_narrow": _pick(_SESSIONS, f"""
            SELECT {_PROFILE_LIST} FROM kept WHERE sex = 'male'
              AND list_has_any(kws, ['kw1', 'kw2']) AND list_has_any(cats, [5, 10, 15])"""),
        "session_filter_places": _pick(_SESSIONS, f"""
            SELECT {_PROFILE_LIST} FROM kept
            WHERE CAST(replace(professional, 'professional', '') AS INT) % 2 = 0
              AND CAST(replace(user_city, 'city', '') AS INT) < 13"""),
        "filtered_actions": _pick(_SESSIONS, f"""
            SELECT {_ACTION_LIST} FROM actions WHERE session_id IN (SELECT session_id FROM kept)"""),
        "session_buckets": _pick(f"{_SESSIONS},{_BUCKETS}", "SELECT * FROM buckets"),
        "session_ratio": _pick(f"{_SESSIONS},{_BUCKETS}", f"""
            SELECT '{TASK}' taskid, session_count, {_RATIOS}
            FROM (SELECT *, greatest(session_count, 1) n FROM buckets)"""),
        "session_hour_counts": _pick(_SESSIONS, """
            SELECT strftime(start_ts, '%Y-%m-%d') "date", strftime(start_ts, '%H') "hour", count(*) session_count
            FROM kept GROUP BY ALL"""),
        **{f"session_sample{suffix}": _pick(f"{_SESSIONS},{_sample(total)}", f"""
            SELECT '{TASK}' taskid, session_id sessionid, strftime(start_ts, {_TIME}) "startTime",
              array_to_string(kws, ',') "searchKeywords", array_to_string(cats, ',') "clickCategoryIds"
            FROM sample""") for suffix, total in (("", 100), ("_1000", 1000))},
        **{f"session_sample_detail{suffix}": _pick(f"{_SESSIONS},{_sample(total)}", f"""
            SELECT '{TASK}' taskid, user_id userid, session_id sessionid, page_id pageid, action_time "actionTime",
              search_keyword "searchKeyword", click_category_id "clickCategoryId",
              click_product_id "clickProductId", order_category_ids "orderCategoryIds",
              order_product_ids "orderProductIds", pay_category_ids "payCategoryIds", pay_product_ids "payProductIds"
            FROM actions WHERE session_id IN (SELECT session_id FROM sample)""")
           for suffix, total in (("", 100), ("_1000", 1000))},
        "category_universe": _pick(_CATEGORIES, "SELECT DISTINCT c category_id FROM category_event"),
        "category_counts": _pick(_CATEGORIES, "SELECT * FROM category_count"),
        "category_counts_raw": _pick(",".join((_ACTION, _RAW, _RAW_TIMED, _category_events("raw_timed"))), "SELECT * FROM category_count"),
        "action_rejects": _pick(f"{_ACTION},{_RAW}", """
            SELECT event_id, user_id, action_time,
              concat_ws(',', CASE WHEN no_time THEN 'action_time' END, CASE WHEN no_user THEN 'user_id' END) unreadable
            FROM raw WHERE no_time OR no_user"""),
        "action_list_rejects": _pick(f"{_ACTION},{_RAW}", """
            SELECT event_id, list_column, entry FROM (
              SELECT event_id, 'order_category_ids' list_column, unnest(string_split(order_category_ids, ',')) entry FROM raw
              UNION ALL SELECT event_id, 'pay_category_ids', unnest(string_split(pay_category_ids, ',')) FROM raw)
            WHERE NOT regexp_full_match(trim(entry), '[+-]?[0-9]{1,18}')"""),
        "top10_category": _pick(_CATEGORIES, f"""
            SELECT '{TASK}' taskid, category_id categoryid, click_count "clickCount", order_count "orderCount",
              pay_count "payCount" FROM top10"""),
        "top10_category_sessions": _pick(f"{_CATEGORIES},{_USERS},{_rollup('timed')}", f"""
            SELECT '{TASK}' taskid, categoryid, sessionid, "clickCount" FROM (
              SELECT *, row_number() OVER (PARTITION BY categoryid ORDER BY "clickCount" DESC, sessionid) rn FROM (
                SELECT click_category_id categoryid, session_id sessionid, count(*) "clickCount" FROM timed
                WHERE session_id IN (SELECT session_id FROM kept)
                  AND click_category_id IN (SELECT category_id FROM top10)
                GROUP BY ALL)) WHERE rn <= 10"""),
        "page_pairs": _pick(_PAGES, "SELECT * FROM linked WHERE next_page_id IS NOT NULL"),
        "page_flow_counts": _pick(_PAGES, "SELECT step, page_split, page_count FROM flow"),
        "page_flow_rate": _pick(_PAGES, "SELECT step, page_split, rate FROM rated"),
        "page_flow_rate_string": _pick(_PAGES, f"""
            SELECT '{TASK}' taskid,
              string_agg(concat(page_split, '=', CAST(rate AS VARCHAR)), '|' ORDER BY step) "convertRate"
            FROM rated"""),
        "area_click_base": _pick(_AREAS, "SELECT * FROM base"),
        "area_product_clicks": _pick(_AREAS, "SELECT * FROM clicks"),
        "area_product_info": _pick(_AREAS, "SELECT * FROM info"),
        "area_top3": _pick(_AREAS, f"""
            SELECT '{TASK}' taskid, area,
              CASE WHEN area IN ('AFRICA', 'AMERICA') THEN 'A Level' WHEN area = 'ASIA' THEN 'B Level'
                   WHEN area = 'EUROPE' THEN 'C Level' ELSE 'D Level' END "areaLevel",
              click_product_id productid, city_info "cityInfos", click_count "clickCount",
              product_name "productName", product_status "productStatus"
            FROM (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, click_product_id) rn
                  FROM info) WHERE rn <= 3"""),
        "group_concat_distinct": _pick(_AREAS, """
            SELECT area, string_agg(DISTINCT concat(city_id, ':', city_name), ','
                                    ORDER BY concat(city_id, ':', city_name)) city_info
            FROM base GROUP BY area"""),
        "ad_parse": _pick(_ADS, "SELECT epoch_us(ts) // 1000 timestamp_ms, province, city, userid, adid FROM ad"),
        "ad_user_daily": _pick(_ADS, "SELECT * FROM user_day"),
        "ad_blacklist": _pick(_ADS, "SELECT * FROM listed"),
        "ad_filter_blacklist": _pick(_ADS, f"""
            SELECT {_AD_LIST} FROM ad WHERE userid NOT IN (SELECT userid FROM listed)"""),
        "ad_accepted_clicks": _pick(_ADS, f"""
            SELECT {_AD_LIST} FROM ad LEFT JOIN listed_at USING (userid) WHERE listed_ts IS NULL OR ts <= listed_ts"""),
        "ad_city_daily": _pick(_ADS, "SELECT * FROM city_day"),
        "ad_province_daily": _pick(_ADS, "SELECT * FROM province_day"),
        "ad_province_top3": _pick(_ADS, """
            SELECT "date", province, adid, "clickCount" FROM (
              SELECT *, row_number() OVER (PARTITION BY "date", province ORDER BY "clickCount" DESC, adid) rn
              FROM province_day) WHERE rn <= 3"""),
        "ad_minute_trend": _pick(_ADS, """
            SELECT strftime(m, '%Y%m%d') "date", strftime(m, '%H') "hour", strftime(m, '%M') "minute", adid,
              n "clickCount" FROM per_minute"""),
        "ad_hour_sliding": _pick(_ADS, """
            SELECT strftime(w, '%Y%m%d%H%M') window_start, strftime(w + INTERVAL 60 MINUTE, '%Y%m%d%H%M') window_end,
              adid, CAST(sum(n) AS BIGINT) "clickCount"
            FROM (SELECT m - to_minutes(i) w, adid, n FROM per_minute, range(60) r(i)) GROUP BY ALL"""),
        "word_count": """
            SELECT word, count(*) AS "count"
            FROM (SELECT unnest(string_split(replace(text, chr(10), ' '), ' ')) word FROM documents)
            WHERE word <> '' GROUP BY word""",
        "scalar_functions": _pick(_ACTION, """
            SELECT event_id, session_id trimmed, lpad(CAST(page_id AS VARCHAR), 2, '0') padded,
              coalesce(search_keyword, '') = '' no_keyword, coalesce(search_keyword, '') <> '' keyword,
              ats < TIMESTAMP '2024-01-10 12:00:00' before_noon, ats > TIMESTAMP '2024-01-10 12:00:00' after_noon,
              strftime(ats, '%Y-%m-%d') "day", strftime(ats, '%Y-%m-%d_%H') day_hour, strftime(ats, '%Y%m%d') day_key,
              strftime(ats, '%Y-%m-%d') day_again, strftime(ats, '%Y%m%d%H%M') "minute",
              (event_id * 25 + 1) // 2 / 100.0::DOUBLE eighth, true days_pass
            FROM all_actions"""),
        "kv_field_get": _pick(_ACTION, """
            SELECT event_id, session_id sessionid, nullif(search_keyword, '') search_keywords,
              CAST(click_category_id AS VARCHAR) click_category_ids FROM all_actions"""),
        "kv_field_set": _pick(_ACTION, f"""
            SELECT event_id, regexp_replace({_PACKED}, 'clickCategoryIds=.*$', 'clickCategoryIds=0') packed
            FROM all_actions"""),
    }
    for name in ("filtered_actions", "page_pairs", "ad_accepted_clicks"):
        named[f"{name}_hot"] = named[name]
    return named
