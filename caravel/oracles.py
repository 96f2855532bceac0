"""DuckDB SQL that gives the expected result of each registered query on the supplied tables.

``FRAMES`` are the common table expressions for the RAW and STAGING frames (same value rules as
``caravel.fixtures``); each oracle names the ones it needs.  Money and percentages are rounded in
whole cents, because DuckDB divides decimals as doubles.
"""

from __future__ import annotations


def _id(prefix: str, key: str, width: int) -> str:
    digits = f"CAST({key} AS VARCHAR)"
    return f"'{prefix}' || lpad({digits}, CAST(greatest({width}, length({digits})) AS INTEGER), '0')"


def _blanks(text: str, when: str) -> str:
    return f"CASE WHEN {when} THEN ' ' || {text} || '  ' ELSE {text} END"


def _ratio(cents: str, n: str) -> str:
    """cents / n in money, rounded half up; NULL when n is 0 (cents not negative)."""
    whole = f"((2 * CAST({cents} AS HUGEINT) + ({n})) // (2 * nullif({n}, 0)))"
    return f"CAST(CAST({whole} AS DECIMAL(18,0)) * 0.01 AS DECIMAL(38,2))"


def _percent(part: str, whole: str) -> str:
    return f"CAST(CAST((20000 * CAST({part} AS HUGEINT) + ({whole})) // (2 * nullif({whole}, 0)) AS DECIMAL(18,0)) * 0.01 AS DECIMAL(18,2))"


def _cents(total: str) -> str:
    return f"CAST({total} * 100 AS HUGEINT)"


FRAMES = {
    "raw_orders": f"""
        SELECT CASE WHEN o_orderkey % 101 <> 0 THEN {_blanks(_id('O', 'o_orderkey', 7), 'o_orderkey % 4 = 0')} END AS order_id,
               {_blanks(_id('C', 'o_custkey', 6), 'o_orderkey % 6 = 0')} AS customer_id,
               o_orderdate AS order_date,
               {_blanks('o_orderstatus', 'o_orderkey % 5 = 0')} AS status,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               o_orderkey % 5 = 2 AS second_batch
        FROM orders""",
    "raw_items": f"""
        SELECT {_blanks("CASE WHEN l_orderkey % 89 = 0 THEN " + _id('Z', 'l_orderkey', 7) + " ELSE " + _id('O', 'l_orderkey', 7) + " END", 'l_orderkey % 4 = 0')} AS order_id,
               {_blanks("CASE WHEN l_partkey % 37 = 0 THEN " + _id('X', 'l_partkey', 6) + " ELSE " + _id('P', 'l_partkey', 6) + " END", 'l_linenumber % 2 = 0')} AS product_id,
               CAST(CASE WHEN l_partkey % 50 = 0 THEN 0 ELSE l_quantity END AS BIGINT) AS quantity,
               CAST(CASE WHEN l_partkey % 41 = 0 THEN -CAST(l_extendedprice AS DECIMAL(12,2))
                         ELSE CAST(l_extendedprice AS DECIMAL(12,2)) END AS DECIMAL(12,2)) AS unit_price,
               l_partkey % 4 = 1 AS second_batch
        FROM lineitem""",
    "raw_customers": f"""
        SELECT CASE WHEN c_custkey % 89 <> 0 THEN {_blanks(_id('C', 'c_custkey', 6), 'c_custkey % 4 = 0')} END AS customer_id,
               CASE WHEN c_custkey % 3 = 0 THEN {_blanks("upper(lower(c_name) || '@example.com')", 'c_custkey % 2 = 0')}
                    ELSE lower(c_name) || '@example.com' END AS email,
               c_name AS first_name,
               CASE WHEN c_custkey % 53 <> 0 THEN c_mktsegment END AS last_name,
               n_name AS city,
               CASE WHEN c_custkey % 97 <> 0 THEN CAST(DATE '1995-01-01' + CAST(c_custkey % 1500 AS INTEGER) AS DATE) END AS signup_date
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
    "raw_products": f"""
        SELECT {_id('P', 'p_partkey', 6)} AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
               CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               split_part(p_name, ' ', 1) AS color,
               CAST(12 + p_partkey % 3 * 12 AS BIGINT) AS warranty_months,
               CAST(p_size * 100 AS BIGINT) AS weight_g,
               CASE WHEN p_partkey % 11 <> 0 THEN
                    CASE WHEN p_partkey % 7 = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(p_name, ' ') END END AS tags
        FROM part""",
    "raw_events": f"""
        SELECT CASE WHEN event_id % 499 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id,
               CASE WHEN user_id % 5 <> 0 THEN {_id('C', 'user_id', 6)} END AS user_id,
               CAST(user_id AS VARCHAR) || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id,
               CASE WHEN k % 3 = 1 THEN upper(event_type) ELSE event_type END AS event_type,
               CASE WHEN k % 10 <> 0 THEN {_id('P', 'k', 6)} END AS product_id,
               ts AS event_ts,
               CASE k % 3 WHEN 0 THEN 'desktop' WHEN 1 THEN 'mobile' ELSE 'tablet' END AS device,
               CASE WHEN k % 4 <> 0 THEN 'search' END AS referrer,
               '10.0.0.' || CAST(k AS VARCHAR) AS ip,
               event_id % 5 = 3 AS second_batch
        FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)""",
    "stg_orders": """
        SELECT trim(order_id) AS order_id, trim(customer_id) AS customer_id, order_date AS order_ts,
               CAST(order_date AS DATE) AS order_date, lower(trim(status)) AS status, total_amount, second_batch
        FROM raw_orders WHERE order_id IS NOT NULL""",
    "stg_products": """
        SELECT product_id, name, category, brand, price, color, warranty_months, weight_g,
               CAST(coalesce(len(tags), 0) AS BIGINT) AS nb_tags
        FROM raw_products""",
    "stg_items": """
        SELECT trim(r.order_id) AS order_id, trim(r.product_id) AS product_id, r.quantity, r.unit_price,
               CAST(r.quantity * r.unit_price AS DECIMAL(14,2)) AS line_amount,
               p.name AS product_name, p.category, p.brand, r.second_batch
        FROM raw_items r LEFT JOIN raw_products p ON p.product_id = trim(r.product_id)
        WHERE r.quantity > 0 AND r.unit_price >= 0""",
    "stg_customers": """
        SELECT trim(customer_id) AS customer_id, lower(trim(email)) AS email, first_name, last_name, city, signup_date
        FROM raw_customers WHERE customer_id IS NOT NULL""",
    "stg_events": """
        SELECT event_id, user_id, user_id IS NULL AS is_anonymous, session_id, lower(event_type) AS event_type,
               product_id, event_ts, CAST(event_ts AS DATE) AS event_date, device,
               coalesce(referrer, 'direct') AS referrer, ip, second_batch
        FROM raw_events WHERE event_id IS NOT NULL""",
    "per_day": f"""
        SELECT order_date, CAST(count(DISTINCT order_id) AS BIGINT) AS nb_orders,
               CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue,
               {_ratio(_cents('sum(total_amount)'), 'count(DISTINCT order_id)')} AS avg_basket
        FROM stg_orders GROUP BY order_date""",
    "sold_recently": """
        SELECT product_id, product_name, category, brand, CAST(sum(quantity) AS BIGINT) AS units_sold,
               CAST(sum(line_amount) AS DECIMAL(38,2)) AS revenue
        FROM stg_items JOIN stg_orders USING (order_id)
        WHERE order_date >= (SELECT max(order_date) - 30 FROM stg_orders)
        GROUP BY ALL""",
    "best_sellers": """
        SELECT * FROM (SELECT *, CAST(rank() OVER (ORDER BY revenue DESC NULLS LAST) AS BIGINT) AS revenue_rank
                       FROM sold_recently)
        WHERE revenue_rank <= 20""",
    "signups": """
        SELECT customer_id, CAST(date_trunc('month', signup_date) AS DATE) AS cohort_month
        FROM stg_customers WHERE signup_date IS NOT NULL""",
    "retention": f"""
        SELECT cohort_month, CAST(months_since_signup AS BIGINT) AS months_since_signup,
               CAST(cohort_size AS BIGINT) AS cohort_size, CAST(active AS BIGINT) AS active_customers,
               {_percent('active', 'cohort_size')} AS retention_pct
        FROM (SELECT s.cohort_month, date_diff('month', s.cohort_month, o.order_date) AS months_since_signup,
                     count(DISTINCT o.customer_id) AS active
              FROM signups s JOIN stg_orders o ON o.customer_id = s.customer_id AND o.order_date >= s.cohort_month
              GROUP BY ALL)
        JOIN (SELECT cohort_month, count(*) AS cohort_size FROM signups GROUP BY ALL) USING (cohort_month)""",
    "first_ids": "SELECT order_id FROM raw_orders ORDER BY order_id NULLS LAST LIMIT 1000",
}

NEEDS = {
    "stg_orders": ["raw_orders"],
    "stg_products": ["raw_products"],
    "stg_items": ["raw_items", "raw_products"],
    "stg_customers": ["raw_customers"],
    "stg_events": ["raw_events"],
    "per_day": ["stg_orders"],
    "sold_recently": ["stg_items", "stg_orders"],
    "best_sellers": ["sold_recently"],
    "signups": ["stg_customers"],
    "retention": ["signups", "stg_orders"],
    "first_ids": ["raw_orders"],
}


def _with(names: list[str], body: str) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in NEEDS.get(name, []):
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    frames = ",\n".join(f"{name} AS ({FRAMES[name]})" for name in ordered)
    return f"WITH {frames}\n{body}"


ORDER_COLUMNS = "order_id, customer_id, order_ts, order_date, status, total_amount"
RAW_ORDER_COLUMNS = "order_id, customer_id, order_date, status, total_amount"
ITEM_COLUMNS = "order_id, product_id, quantity, unit_price, line_amount, product_name, category, brand"
EVENT_COLUMNS = "event_id, user_id, is_anonymous, session_id, event_type, product_id, event_ts, event_date, device, referrer, ip"
RAW_EVENT_COLUMNS = "event_id, user_id, session_id, event_type, product_id, event_ts, device, referrer, ip"

_STG_ORDERS = _with(["stg_orders"], f"SELECT {ORDER_COLUMNS} FROM stg_orders")
_STG_ITEMS = _with(["stg_items"], f"SELECT {ITEM_COLUMNS} FROM stg_items")
_STG_EVENTS = _with(["stg_events"], f"SELECT {EVENT_COLUMNS} FROM stg_events")
_RAW_ORDERS = _with(["raw_orders"], f"SELECT {RAW_ORDER_COLUMNS} FROM raw_orders")
_ATTRIBUTES = _with(
    ["raw_products"],
    "SELECT product_id, name, category, brand, price, color, warranty_months, weight_g FROM raw_products",
)
_TYPE_COUNTS = _with(
    ["raw_events"], "SELECT event_type, CAST(count(*) AS BIGINT) AS nb_events FROM raw_events GROUP BY event_type"
)

# Choices used by the filtered variants of the reports.
_CHOSEN = "order_date BETWEEN DATE '1996-03-01' AND DATE '2000-10-15' AND status IN ('f', 'o')"
_CATEGORIES = "category IN ('ECONOMY', 'LARGE')"


def _daily_report(where: str) -> str:
    return _with(
        ["stg_orders"],
        f"""SELECT order_date, CAST(count(DISTINCT order_id) AS BIGINT) AS nb_orders,
               CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue,
               {_ratio(_cents('sum(total_amount)'), 'count(DISTINCT order_id)')} AS avg_basket
            FROM stg_orders WHERE {where} GROUP BY order_date""",
    )


def _by_period(unit: str) -> str:
    return _with(
        ["stg_orders"],
        f"""SELECT CAST(date_trunc('{unit}', order_date) AS DATE) AS period,
               CAST(count(DISTINCT order_id) AS BIGINT) AS nb_orders, CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue
            FROM stg_orders WHERE order_date IS NOT NULL GROUP BY 1""",
    )


def _best_by_name(where: str, n: int) -> str:
    return _with(
        ["stg_items", "stg_orders"],
        f"""SELECT product_name, category, brand, CAST(sum(quantity) AS BIGINT) AS units_sold,
               CAST(sum(line_amount) AS DECIMAL(38,2)) AS revenue
            FROM stg_items JOIN stg_orders USING (order_id) WHERE {where}
            GROUP BY product_name, category, brand
            ORDER BY revenue DESC NULLS LAST, product_name NULLS LAST, category NULLS LAST, brand NULLS LAST LIMIT {n}""",
    )


def _category_revenue(where: str) -> str:
    return _with(
        ["stg_items", "stg_orders"],
        f"""SELECT category, CAST(sum(line_amount) AS DECIMAL(38,2)) AS revenue
            FROM stg_items JOIN stg_orders USING (order_id) WHERE {where} GROUP BY category""",
    )


def _kpis(where: str) -> str:
    return _with(
        ["stg_orders"],
        f"""SELECT order_date AS last_day, nb_orders, nb_orders_delta, avg_basket, avg_basket_delta, revenue, revenue_delta,
               total_revenue, (SELECT CAST(count(DISTINCT customer_id) AS BIGINT) FROM stg_orders WHERE {where}) AS unique_customers
            FROM (SELECT *, CAST(nb_orders - lag(nb_orders) OVER byday AS BIGINT) AS nb_orders_delta,
                         CAST(avg_basket - lag(avg_basket) OVER byday AS DECIMAL(38,2)) AS avg_basket_delta,
                         CAST(revenue - lag(revenue) OVER byday AS DECIMAL(38,2)) AS revenue_delta,
                         CAST(sum(revenue) OVER () AS DECIMAL(38,2)) AS total_revenue
                  FROM (SELECT order_date, CAST(count(DISTINCT order_id) AS BIGINT) AS nb_orders,
                               CAST(sum(total_amount) AS DECIMAL(38,2)) AS revenue,
                               {_ratio(_cents('sum(total_amount)'), 'count(DISTINCT order_id)')} AS avg_basket
                        FROM stg_orders WHERE {where} GROUP BY order_date)
                  WINDOW byday AS (ORDER BY order_date))
            ORDER BY last_day DESC LIMIT 1""",
    )


def _latest(where: str) -> str:
    return _with(
        ["stg_orders", "stg_customers"],
        f"""SELECT o.order_id, o.order_ts, o.customer_id, c.first_name || ' ' || c.last_name AS client, o.status, o.total_amount
            FROM stg_orders o LEFT JOIN stg_customers c ON c.customer_id = o.customer_id WHERE {where}
            ORDER BY o.order_ts DESC NULLS LAST, o.order_id LIMIT 50""",
    )


def _funnel(steps: tuple[str, ...], where: str) -> str:
    listed = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(steps))
    return _with(
        ["stg_events"],
        f"""SELECT CAST(step_no AS BIGINT) AS step_no, step, n, {_percent('n', 'n_first')} AS pct_of_first
            FROM (SELECT step_no, step, n, first_value(n) OVER (ORDER BY step_no) AS n_first
                  FROM (SELECT step_no, step, CAST(count(event_id) AS BIGINT) AS n
                        FROM (VALUES {listed}) AS s(step_no, step)
                        LEFT JOIN (SELECT * FROM stg_events WHERE {where}) ON event_type = step
                        GROUP BY step_no, step))""",
    )


def _devices(where: str) -> str:
    return _with(
        ["stg_events"],
        f"""SELECT device, n, {_percent('n', 'everything')} AS pct
            FROM (SELECT device, CAST(count(*) AS BIGINT) AS n, sum(count(*)) OVER () AS everything
                  FROM stg_events WHERE {where} GROUP BY device)""",
    )


def _counted(rows: list[tuple[str, str]], label: str = "table_name") -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS {label}, CAST(count(*) AS BIGINT) AS row_count FROM {source}" for name, source in rows
    )


_STAGED = [
    ("customers", "stg_customers"), ("products", "stg_products"), ("orders", "stg_orders"),
    ("order_items", "stg_items"), ("web_events", "stg_events"),
]
_STREAMED = [("orders", "stg_orders"), ("order_items", "stg_items"), ("web_events", "stg_events")]


def _phases() -> str:
    parts = []
    for phase, where in (("before", " WHERE NOT second_batch"), ("after", "")):
        for name, source in _STREAMED:
            parts.append(
                f"SELECT '{phase}' AS phase, '{name}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {source}{where}"
            )
    return _with(["stg_orders", "stg_items", "stg_events"], " UNION ALL ".join(parts))


def _run_history() -> str:
    parts = []
    for run, flag in ((1, "NOT second_batch"), (2, "second_batch")):
        parts.append(f"SELECT {run} AS run_id, 'products' AS job, 'SUCCEEDED' AS state, CAST(NULL AS BIGINT) AS row_count")
        for name, source in _STREAMED:
            parts.append(f"SELECT {run}, '{name}', 'SUCCEEDED', CAST(count(*) AS BIGINT) FROM {source} WHERE {flag}")
    parts.append("SELECT 3, 'products', 'SUCCEEDED', NULL")
    parts += [f"SELECT 3, '{name}', 'SKIPPED', NULL" for name, _ in _STREAMED]
    return _with(["stg_orders", "stg_items", "stg_events"], " UNION ALL ".join(parts))


def _audit_files() -> str:
    parts = [
        f"""SELECT '{name}' AS table_name, CASE WHEN second_batch THEN 'j2' ELSE 'j1' END || '/{name}.{kind}' AS source_file,
                   CAST(count(*) AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS without_stamp FROM {source} GROUP BY second_batch"""
        for name, source, kind in (("orders", "raw_orders", "csv"), ("order_items", "raw_items", "csv"), ("web_events", "raw_events", "json"))
    ]
    parts.append("SELECT 'customers', 'j1/customers.parquet', count(*), 0 FROM raw_customers")
    parts.append("SELECT 'products', 'j1/products.json', count(*), 0 FROM raw_products")
    return _with(["raw_orders", "raw_items", "raw_customers", "raw_products", "raw_events"], " UNION ALL ".join(parts))


def _load_history() -> str:
    raw = [("orders", "raw_orders", "csv"), ("order_items", "raw_items", "csv"), ("web_events", "raw_events", "json")]
    parts = []
    for batch, flag in (("j1", "NOT second_batch"), ("j2", "second_batch")):
        for name, source, kind in raw:
            parts.append(
                f"""SELECT '{name}' AS table_name, '{batch}/{name}.{kind}' AS file_name, 'LOADED' AS status,
                    CAST(count(*) AS BIGINT) AS row_count, CAST(count(*) AS BIGINT) AS row_parsed,
                    CAST(NULL AS VARCHAR) AS first_error_message FROM {source} WHERE {flag}"""
            )
    parts.append("SELECT 'customers', 'j1/customers.parquet', 'LOADED', count(*), count(*), NULL FROM raw_customers")
    parts.append("SELECT 'products', 'j1/products.json', 'LOADED', count(*), count(*), NULL FROM raw_products")
    return _with(["raw_orders", "raw_items", "raw_events", "raw_customers", "raw_products"], " UNION ALL ".join(parts))


def _quality() -> str:
    checks = [
        ("orders_repeated_id", "count(order_id) - count(DISTINCT order_id)", "raw_orders"),
        ("orders_without_id", "count(*) FILTER (order_id IS NULL)", "raw_orders"),
        ("orders_without_date", "count(*) FILTER (order_date IS NULL)", "raw_orders"),
        ("items_bad_quantity", "count(*) FILTER (quantity IS NULL OR quantity <= 0)", "raw_items"),
        ("items_bad_price", "count(*) FILTER (unit_price IS NULL OR unit_price < 0)", "raw_items"),
        ("items_without_order", "count(*)",
         "raw_items i WHERE NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.order_id = i.order_id)"),
        ("products_repeated_id", "count(product_id) - count(DISTINCT product_id)", "raw_products"),
        ("products_without_id", "count(*) FILTER (product_id IS NULL)", "raw_products"),
        ("events_without_id", "count(*) FILTER (event_id IS NULL)", "raw_events"),
    ]
    shares = {"orders_without_id": "0.02"}
    parts = []
    for name, expression, source in checks:
        limit = f"CAST(floor(n * {shares[name]}) AS BIGINT)" if name in shares else "CAST(0 AS BIGINT)"
        parts.append(
            f"SELECT '{name}' AS check_name, observed, {limit} AS allowed, observed <= {limit} AS passed "
            f"FROM (SELECT CAST({expression} AS BIGINT) AS observed, count(*) AS n FROM {source})"
        )
    return _with(["raw_orders", "raw_items", "raw_products", "raw_events"], " UNION ALL ".join(parts))


_HEATMAP_COLUMNS = ", ".join(
    f"max(CASE WHEN months_since_signup = {i} THEN retention_pct END) AS m{i}" for i in range(13)
)

_SURVIVORS = _with(
    ["raw_orders", "first_ids"],
    f"""SELECT {RAW_ORDER_COLUMNS} FROM raw_orders
        WHERE order_id IS NULL OR order_id NOT IN (SELECT order_id FROM first_ids WHERE order_id IS NOT NULL)""",
)

_FUNNEL = ("view", "click", "checkout", "signup", "purchase")
_EVENTS_CHOSEN = "event_date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' AND device IN ('mobile', 'tablet')"

ORACLES: dict[str, str] = {
    # files and loads
    "csv_scan": _RAW_ORDERS,
    "csv_validate": _with(
        ["raw_orders"],
        """SELECT order_id AS row_key, 'order_date' AS column_name, '2001-02-30 10:00:00' AS value, 'not a timestamp_ntz' AS error
           FROM raw_orders WHERE extract(day FROM order_date) = 13
           UNION ALL
           SELECT order_id, 'total_amount', 'n/a', 'not a decimal(12,2)'
           FROM raw_orders WHERE total_amount > 450000""",
    ),
    "csv_line_breaks": _with(
        ["raw_orders"],
        """SELECT order_id,
                  CASE WHEN digit IN ('0', '3', '6') THEN customer_id || chr(10) || '"of", the' || chr(10) || chr(10) || 'north' ELSE customer_id END AS customer_id,
                  order_date, CASE WHEN digit IN ('3', '7') THEN '"' || status || '"' || chr(10) ELSE status END AS status, total_amount
           FROM (SELECT *, coalesce(right(trim(order_id), 1), '0') AS digit FROM raw_orders)""",
    ),
    "json_scan": _with(
        ["raw_products", "raw_events"],
        """SELECT 'array' AS layout, CAST(count(*) AS BIGINT) AS documents, CAST(count(DISTINCT product_id) AS BIGINT) AS keys FROM raw_products
           UNION ALL SELECT 'lines', count(*), count(DISTINCT event_id) FROM raw_events""",
    ),
    "ingest_orders": _RAW_ORDERS,
    "ingest_order_items": _with(["raw_items"], "SELECT order_id, product_id, quantity, unit_price FROM raw_items"),
    "ingest_customers": _with(["raw_customers"], "SELECT * FROM raw_customers"),
    "ingest_products": _ATTRIBUTES,
    "ingest_idempotent": _RAW_ORDERS,
    "load_history": _load_history(),
    "load_history_merged": _load_history(),
    "landing_files": _with(
        ["raw_orders", "raw_items", "raw_customers", "raw_products", "raw_events"],
        " UNION ALL ".join(
            f"SELECT 'j1' AS delivery, '{name}' AS table_name, '{kind}' AS kind, count(*) > 0 AS has_data FROM {source}"
            for name, kind, source in (
                ("orders", "csv", "raw_orders"), ("order_items", "csv", "raw_items"), ("customers", "parquet", "raw_customers"),
                ("products", "json", "raw_products"), ("web_events", "json", "raw_events"),
            )
        ),
    ),
    "reload_after_replace": _RAW_ORDERS,
    "audit_files": _audit_files(),
    "events_in_place": _with(["raw_events"], f"SELECT {RAW_EVENT_COLUMNS} FROM raw_events"),
    "event_type_counts": _TYPE_COUNTS,
    "events_external": _TYPE_COUNTS,
    "in_place_equals_materialised": _with(
        ["raw_events"],
        """SELECT event_type, CAST(count(*) AS BIGINT) AS left_count, CAST(count(*) AS BIGINT) AS right_count, true AS agree
           FROM raw_events GROUP BY event_type""",
    ),
    # STAGING
    "stg_products": _with(["stg_products"], "SELECT * FROM stg_products"),
    "stg_customers": _with(["stg_customers"], "SELECT * FROM stg_customers"),
    "stg_orders": _STG_ORDERS,
    "stg_order_items": _STG_ITEMS,
    "stg_web_events": _STG_EVENTS,
    # documents
    "product_attributes": _ATTRIBUTES,
    "category_price_stats": _with(
        ["raw_products"],
        f"""SELECT category, CAST(count(*) AS BIGINT) AS nb_products, {_ratio(_cents('sum(price)'), 'count(price)')} AS avg_price
            FROM raw_products GROUP BY category""",
    ),
    "product_tags_outer": _with(
        ["raw_products"],
        """SELECT product_id, name, unnest(CASE WHEN tags IS NULL OR len(tags) = 0 THEN [NULL] ELSE tags END) AS tag
           FROM raw_products""",
    ),
    "tag_distribution": _with(
        ["raw_products"],
        """SELECT tag, CAST(count(*) AS BIGINT) AS nb_products
           FROM (SELECT unnest(tags) AS tag FROM raw_products) GROUP BY tag""",
    ),
    "event_null_profile": _with(
        ["raw_events"],
        """SELECT CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (user_id IS NULL) AS BIGINT) AS user_id_null,
                  CAST(count(*) FILTER (product_id IS NULL) AS BIGINT) AS product_id_null,
                  CAST(count(*) FILTER (referrer IS NULL) AS BIGINT) AS referrer_null
           FROM raw_events""",
    ),
    "event_device_counts": _with(
        ["raw_events"], "SELECT device, CAST(count(*) AS BIGINT) AS nb FROM raw_events GROUP BY device"
    ),
    "event_ts_bounds": _with(
        ["raw_events"], "SELECT min(event_ts) AS first_event, max(event_ts) AS last_event FROM raw_events"
    ),
    # checks
    "table_counts": _with(
        ["raw_orders", "raw_items", "raw_customers", "raw_products", "raw_events"],
        _counted([("orders", "raw_orders"), ("order_items", "raw_items"), ("customers", "raw_customers"),
                  ("products", "raw_products"), ("web_events", "raw_events")]),
    ),
    "order_key_uniqueness": _with(
        ["raw_orders"],
        "SELECT CAST(count(*) AS BIGINT) AS row_count, CAST(count(DISTINCT order_id) AS BIGINT) AS distinct_keys FROM raw_orders",
    ),
    "order_date_bounds": _with(
        ["stg_orders"], "SELECT min(order_date) AS first_day, max(order_date) AS last_day FROM stg_orders"
    ),
    "orders_by_status": _with(
        ["raw_orders"], "SELECT status, CAST(count(*) AS BIGINT) AS n FROM raw_orders GROUP BY status"
    ),
    "orphan_items": _with(
        ["raw_orders", "raw_items"],
        """SELECT CAST(count(*) AS BIGINT) AS orphan_items FROM raw_items i
           WHERE NOT EXISTS (SELECT 1 FROM raw_orders o WHERE o.order_id = i.order_id)""",
    ),
    "quality_report": _quality(),
    "quality_kept_up": _quality(),
    # marts
    "dt_daily_revenue": _with(["per_day"], "SELECT * FROM per_day"),
    "dt_top_products": _with(["best_sellers"], "SELECT * FROM best_sellers"),
    "dt_customer_cohorts": _with(["retention"], "SELECT * FROM retention"),
    "mart_daily_latest": _with(["per_day"], "SELECT * FROM per_day ORDER BY order_date DESC NULLS LAST LIMIT 14"),
    "mart_top_listing": _with(
        ["best_sellers"],
        """SELECT * FROM best_sellers ORDER BY revenue_rank, product_id NULLS LAST, product_name NULLS LAST,
           category NULLS LAST, brand NULLS LAST LIMIT 20""",
    ),
    "mart_cohort_head": _with(["retention"], "SELECT * FROM retention ORDER BY cohort_month, months_since_signup LIMIT 50"),
    # reports
    "filter_statuses": _with(["stg_orders"], "SELECT DISTINCT status FROM stg_orders WHERE status IS NOT NULL"),
    "filter_categories": _with(["stg_products"], "SELECT DISTINCT category FROM stg_products WHERE category IS NOT NULL"),
    "filter_devices": _with(["stg_events"], "SELECT DISTINCT device FROM stg_events WHERE device IS NOT NULL"),
    "report_daily": _daily_report("order_date IS NOT NULL"),
    "report_daily_filtered": _daily_report(_CHOSEN),
    "report_kpis": _kpis("order_date IS NOT NULL"),
    "report_kpis_filtered": _kpis(_CHOSEN),
    "unique_customers": _with(
        ["stg_orders"],
        "SELECT CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers FROM stg_orders WHERE order_date IS NOT NULL",
    ),
    "revenue_last_14_days": _with(
        ["per_day"],
        "SELECT order_date, revenue FROM per_day WHERE order_date >= (SELECT max(order_date) - 13 FROM per_day)",
    ),
    "revenue_by_day": _by_period("day"),
    "revenue_by_week": _by_period("week"),
    "revenue_by_month": _by_period("month"),
    "report_top_products": _best_by_name("order_date IS NOT NULL", 10),
    "report_top_products_filtered": _best_by_name(f"{_CHOSEN} AND {_CATEGORIES}", 20),
    "revenue_by_category": _category_revenue("order_date IS NOT NULL"),
    "revenue_by_category_filtered": _category_revenue(f"{_CHOSEN} AND {_CATEGORIES}"),
    "conversion_funnel": _funnel(_FUNNEL, "event_date IS NOT NULL"),
    "conversion_funnel_filtered": _funnel(_FUNNEL, _EVENTS_CHOSEN),
    "events_by_device": _devices("event_date IS NOT NULL"),
    "events_by_device_filtered": _devices(_EVENTS_CHOSEN),
    "cohort_heatmap": _with(
        ["retention"],
        f"""SELECT strftime(cohort_month, '%Y-%m') AS cohort, {_HEATMAP_COLUMNS}
            FROM retention WHERE months_since_signup BETWEEN 0 AND 12 GROUP BY cohort_month""",
    ),
    "latest_orders": _latest("o.order_date IS NOT NULL"),
    "latest_orders_display": f"""
        SELECT order_id AS "Commande", strftime(order_ts, '%d/%m/%Y %H:%M') AS "Date/heure", customer_id AS "ID client", client AS "Client",
               status AS "Statut", CAST(total_amount AS VARCHAR) || ' €' AS "Montant"
        FROM ({_latest("o.order_date IS NOT NULL")})""",
    # change feeds
    "inc_orders": _STG_ORDERS,
    "inc_orders_merged": _STG_ORDERS,
    "inc_order_items": _STG_ITEMS,
    "inc_late_products": _STG_ITEMS,
    "inc_web_events": _STG_EVENTS,
    "backfill_equals_incremental": _with(
        ["stg_orders"],
        f"""SELECT 'all at once' AS way, {ORDER_COLUMNS} FROM stg_orders
            UNION ALL SELECT 'in two batches', {ORDER_COLUMNS} FROM stg_orders""",
    ),
    "pending_changes": _with(
        ["raw_orders", "raw_items", "raw_events"],
        """SELECT 'orders' AS feed, CAST(count(*) AS BIGINT) AS nb_changes, count(*) > 0 AS has_data FROM raw_orders WHERE second_batch
           UNION ALL SELECT 'order_items', count(*), count(*) > 0 FROM raw_items WHERE second_batch
           UNION ALL SELECT 'web_events', count(*), count(*) > 0 FROM raw_events WHERE second_batch""",
    ),
    "changes_inserts": _RAW_ORDERS,
    "batch_before_after": _phases(),
    "run_loads": _with([source for _, source in _STAGED], _counted(_STAGED)),
    "run_history": _run_history(),
    "restore_not_reprocessed": _STG_ORDERS,
    # refresh of marts
    "refresh_daily_incremental": _with(["per_day"], "SELECT * FROM per_day"),
    "refresh_marts": _with(["best_sellers"], "SELECT * FROM best_sellers"),
    "refresh_cohorts": _with(["retention"], "SELECT * FROM retention"),
    "refresh_unique_customers": _with(
        ["stg_orders"],
        """SELECT order_date, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers FROM stg_orders
           WHERE order_date IS NOT NULL AND customer_id IS NOT NULL GROUP BY order_date""",
    ),
    "unique_customers_by_period": _with(
        ["stg_orders"],
        """SELECT strftime(order_date, '%Y-%m') AS period, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers
           FROM stg_orders WHERE order_date IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1
           UNION ALL SELECT strftime(order_date, '%Y'), count(DISTINCT customer_id)
           FROM stg_orders WHERE order_date IS NOT NULL AND customer_id IS NOT NULL GROUP BY 1
           UNION ALL SELECT 'chosen', count(DISTINCT customer_id)
           FROM stg_orders WHERE order_date BETWEEN DATE '1996-03-01' AND DATE '2000-10-15'""",
    ),
    "refresh_history": """
        WITH arrived AS (SELECT count(*) FILTER (o_orderkey % 5 <> 2) > 0 AS first, count(*) FILTER (o_orderkey % 5 = 2) > 0 AS second FROM orders)
        SELECT mart, unnest([CASE WHEN first THEN 'FULL' ELSE 'NO_DATA' END,
                             CASE WHEN NOT second THEN 'NO_DATA' WHEN first THEN 'INCREMENTAL' ELSE 'FULL' END,
                             'NO_DATA']) AS action, 'SUCCEEDED' AS state
        FROM (VALUES ('daily_revenue'), ('top_products'), ('customer_cohorts')) AS m(mart), arrived""",
    # recovery
    "delete_first_n": _SURVIVORS,
    "as_of_before_delete": _RAW_ORDERS,
    "as_of_offset": _RAW_ORDERS,
    "as_of_seconds_ago": _RAW_ORDERS,
    "reconcile_orders": _with(
        ["raw_orders", "first_ids"],
        f"""SELECT {RAW_ORDER_COLUMNS}, CAST(sum(l) AS BIGINT) AS copies_left, CAST(sum(r) AS BIGINT) AS copies_right FROM (
                SELECT {RAW_ORDER_COLUMNS}, 1 AS l,
                       CASE WHEN order_id IN (SELECT order_id FROM first_ids WHERE order_id IS NOT NULL) THEN 0 ELSE 1 END AS r FROM raw_orders
                UNION ALL SELECT {RAW_ORDER_COLUMNS}, 0, 1 FROM raw_orders WHERE second_batch)
            GROUP BY {RAW_ORDER_COLUMNS} HAVING sum(l) <> sum(r)""",
    ),
    "restore_missing": _with(
        ["raw_orders", "first_ids"],
        f"SELECT DISTINCT {RAW_ORDER_COLUMNS} FROM raw_orders WHERE order_id IN (SELECT order_id FROM first_ids)",
    ),
    "recovery_counts": _with(
        ["raw_orders", "first_ids"],
        """SELECT 'before' AS stage, CAST(count(*) AS BIGINT) AS row_count FROM raw_orders
           UNION ALL SELECT 'deleted', count(*) FROM raw_orders
                     WHERE order_id IS NULL OR order_id NOT IN (SELECT order_id FROM first_ids WHERE order_id IS NOT NULL)
           UNION ALL SELECT 'restored', count(*) FROM raw_orders""",
    ),
    "snapshot_copy": _RAW_ORDERS,
    # policies
    "customers_masked": _with(
        ["stg_customers"],
        """SELECT customer_id, substr(email, 1, 1) || '***@' || split_part(email, '@', 2) AS email,
                  first_name, last_name, city, signup_date FROM stg_customers""",
    ),
    "orders_for_region": _with(
        ["stg_orders", "stg_customers"],
        f"""SELECT {ORDER_COLUMNS} FROM stg_orders
            WHERE customer_id IN (SELECT customer_id FROM stg_customers WHERE city IN ('NATION_1', 'NATION_4', 'NATION_7'))""",
    ),
}
