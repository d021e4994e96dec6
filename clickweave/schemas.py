"""Fixed input and output schemas (DDL strings; Spark accepts them wherever a schema is expected)."""

USER_VISIT_ACTION = (
    "date string, user_id bigint, session_id string, page_id bigint, action_time string, "
    "search_keyword string, click_category_id bigint, click_product_id bigint, "
    "order_category_ids string, order_product_ids string, "
    "pay_category_ids string, pay_product_ids string, city_id bigint"
)
USER_INFO = (
    "user_id bigint, username string, name string, age int, professional string, city string, sex string"
)
PRODUCT_INFO = "product_id bigint, product_name string, extend_info string"
CITY_AREA = "city_id bigint, city_name string, area string"
AD_CLICK = "timestamp_ms bigint, province string, city string, userid bigint, adid bigint"

# Visit length in whole seconds, both ends inclusive; None is open. A visit of 0 seconds is in no bucket.
VISIT_BUCKETS = (
    ("visit_length_1s_3s", 1, 3),
    ("visit_length_4s_6s", 4, 6),
    ("visit_length_7s_9s", 7, 9),
    ("visit_length_10s_30s", 10, 30),
    ("visit_length_30s_60s", 31, 60),
    ("visit_length_1m_3m", 61, 180),
    ("visit_length_3m_10m", 181, 600),
    ("visit_length_10m_30m", 601, 1800),
    ("visit_length_30m", 1801, None),
)
# Number of actions in the session, both ends inclusive.
STEP_BUCKETS = (
    ("step_length_1_3", 1, 3),
    ("step_length_4_6", 4, 6),
    ("step_length_7_9", 7, 9),
    ("step_length_10_30", 10, 30),
    ("step_length_30_60", 31, 60),
    ("step_length_60", 61, None),
)

SESSION_AGGR_STAT = "taskid string, session_count bigint, " + ", ".join(
    f"{name}_ratio double" for name, _, _ in VISIT_BUCKETS + STEP_BUCKETS
)
SESSION_RANDOM_EXTRACT = (
    "taskid string, sessionid string, startTime string, searchKeywords string, clickCategoryIds string"
)
SESSION_DETAIL = (
    "taskid string, userid bigint, sessionid string, pageid bigint, actionTime string, "
    "searchKeyword string, clickCategoryId bigint, clickProductId bigint, orderCategoryIds string, "
    "orderProductIds string, payCategoryIds string, payProductIds string"
)
TOP10_CATEGORY = "taskid string, categoryid bigint, clickCount bigint, orderCount bigint, payCount bigint"
TOP10_SESSION = "taskid string, categoryid bigint, sessionid string, clickCount bigint"
PAGE_SPLIT_CONVERT_RATE = "taskid string, convertRate string"
AREA_TOP3_PRODUCT = (
    "taskid string, area string, areaLevel string, productid bigint, cityInfos string, "
    "clickCount bigint, productName string, productStatus string"
)
AD_BLACKLIST = "userid bigint"
AD_USER_CLICK_COUNT = "date string, userid bigint, adid bigint, clickCount bigint"
AD_STAT = "date string, province string, city string, adid bigint, clickCount bigint"
AD_PROVINCE_TOP3 = "date string, province string, adid bigint, clickCount bigint"
AD_CLICK_TREND = "date string, hour string, minute string, adid bigint, clickCount bigint"
AD_ROLLING_HOUR = "adid bigint, window_end_ms bigint, clickCount bigint"
STREAM_REPORT = "kind string, n bigint"
