"""DuckDB text of the derived tables and SQL helper snippets for the oracle queries.

The oracle computes the analyses on a second engine from rows, without the Spark side's per-key
aggregates: it joins first and counts distinct non-null ids over the joined rows, or uses windows,
``FILTER`` and ``EXISTS``. Rows, periods and measures that several analyses share are helpers here.
Only the raw tables are registered there; the derived tables are inlined as CTEs.
"""

from __future__ import annotations

VIEW_SQL: dict[str, str] = {
    "website_sessions": """
SELECT user_id*1000+dayofyear(ts) AS website_session_id, MIN(ts) AS created_at, user_id,
 CASE WHEN (user_id+dayofyear(ts))%5 IN (0,1) THEN 'gsearch' WHEN (user_id+dayofyear(ts))%5=2 THEN 'bsearch' END AS utm_source,
 CASE WHEN (user_id+dayofyear(ts))%5 > 2 THEN NULL WHEN user_id%3=0 THEN 'brand' ELSE 'nonbrand' END AS utm_campaign,
 CASE WHEN (user_id+dayofyear(ts))%5=4 THEN NULL WHEN (user_id+dayofyear(ts))%5=2 THEN 'https://www.bsearch.com' ELSE 'https://www.gsearch.com' END AS http_referer,
 CASE WHEN user_id%2=0 THEN 'desktop' ELSE 'mobile' END AS device_type
 FROM events GROUP BY user_id, dayofyear(ts)""",
    "website_pageviews": """
SELECT event_id AS website_pageview_id, ts AS created_at, user_id*1000+dayofyear(ts) AS website_session_id,
 CASE WHEN event_type='view' THEN CASE WHEN event_id%2=0 THEN '/home' ELSE '/lander-1' END
 WHEN event_type='click' THEN CASE event_id%3 WHEN 0 THEN '/products' WHEN 1 THEN '/the-original-mr-fuzzy' ELSE '/the-forever-love-bear' END
 WHEN event_type='signup' THEN CASE WHEN event_id%2=0 THEN '/cart' ELSE '/shipping' END
 WHEN event_type='error' THEN CASE WHEN event_id%2=0 THEN '/billing' ELSE '/billing-2' END
 ELSE '/thank-you-for-your-order' END AS pageview_url
 FROM events WHERE event_id%97<>0""",
    "web_orders": """
SELECT event_id AS order_id, ts AS created_at, user_id*1000+dayofyear(ts) AS website_session_id,
 1+event_id%4 AS primary_product_id, 1+event_id%3 AS items_purchased, CAST(round(value*100) AS BIGINT) AS price_cents, CAST(round(value*60) AS BIGINT) AS cogs_cents
 FROM events WHERE event_type='purchase'""",
    "order_items": """
SELECT l_orderkey*10+l_linenumber AS order_item_id, o_orderdate AS created_at, l_orderkey AS order_id, MIN(l_partkey)%4+1 AS product_id,
 CASE WHEN l_linenumber=first_line THEN 1 ELSE 0 END AS is_primary_item, CAST(round(MIN(l_extendedprice)*100) AS BIGINT) AS price_cents
 FROM lineitem JOIN orders ON o_orderkey=l_orderkey JOIN (SELECT l_orderkey AS k, MIN(l_linenumber) AS first_line FROM lineitem GROUP BY l_orderkey) f ON k=l_orderkey
 GROUP BY l_orderkey,l_linenumber,o_orderdate,first_line""",
    "order_item_refunds": """
SELECT (l_orderkey*10+l_linenumber)*10+1 AS order_item_refund_id, l_orderkey*10+l_linenumber AS order_item_id, l_orderkey AS order_id, MIN(l_shipdate) AS created_at, CAST(round(MIN(l_extendedprice)*100) AS BIGINT) AS refund_cents
 FROM lineitem GROUP BY l_orderkey,l_linenumber HAVING MIN(l_returnflag)='R'""",
    "store_orders": """
SELECT o_orderkey AS order_id, o_orderdate AS created_at, p.product_id AS primary_product_id, n.items_purchased, CAST(round(o_totalprice*100) AS BIGINT) AS price_cents, CAST(round(o_totalprice*60) AS BIGINT) AS cogs_cents
 FROM orders JOIN (SELECT order_id, product_id FROM order_items WHERE is_primary_item=1) p ON p.order_id=o_orderkey JOIN (SELECT order_id, COUNT(*) AS items_purchased FROM order_items GROUP BY order_id) n ON n.order_id=o_orderkey""",
}


def with_views(sql: str, *temp: tuple[str, str]) -> str:
    """Prefix ``sql`` with the derived tables (and optional temp tables) as CTEs."""
    ctes = [f"{name} AS ({body.strip()})" for name, body in VIEW_SQL.items()]
    ctes += [f"{name} AS ({body.strip()})" for name, body in temp]
    return "WITH " + ",\n".join(ctes) + "\n" + sql.strip()


# ---- snippets (DuckDB dialect) ------------------------------------------------------------------

SESSIONS = "count(DISTINCT website_session_id)"
ORDERS = "count(DISTINCT order_id)"
CENTS = "sum(price_cents)"

# sessions with their orders (a session without orders keeps one row with NULL order columns)
SESSION_ORDERS = ("so", """
SELECT s.*, o.order_id, o.created_at AS order_created_at, o.primary_product_id,
       o.items_purchased, o.price_cents, o.cogs_cents
FROM website_sessions s LEFT JOIN web_orders o USING (website_session_id)""")

# pageviews with the orders of their session
PAGE_ORDERS = ("page_orders", """
SELECT p.*, o.order_id, o.price_cents
FROM website_pageviews p LEFT JOIN web_orders o USING (website_session_id)""")

# items with their refunds
ITEM_REFUNDS = ("item_refunds", """
SELECT i.*, r.order_item_refund_id, r.refund_cents, r.created_at AS refund_date
FROM order_items i LEFT JOIN order_item_refunds r USING (order_item_id)""")


def ts(value: str) -> str:
    return f"TIMESTAMP '{value}'"


def during(start: str, end: str, x: str = "created_at") -> str:
    return f"{x} BETWEEN {ts(start)} AND {ts(end)}"


def period(cut: str, before: str, after: str, other: str, x: str = "created_at") -> str:
    """Label of a time: before the cut, from it on, or unknown."""
    return f"CASE WHEN {x} < {ts(cut)} THEN '{before}' WHEN {x} >= {ts(cut)} THEN '{after}' ELSE '{other}' END"


def year_month(x: str = "created_at", year: str = "yr", month: str = "month") -> str:
    return f"{big(f'year({x})')} AS {year}, {big(f'month({x})')} AS {month}"


def money(average: str | None = None) -> str:
    """Revenue and margin in dollars, and the average price under a name."""
    out = "sum(price_cents) / 100 AS revenue, sum(price_cents - cogs_cents) / 100 AS margin"
    return out + (f", avg(price_cents) / 100 AS {average}" if average else "")


def to_date(x: str) -> str:
    return f"CAST({x} AS DATE)"


def weekday0(x: str) -> str:
    return f"CAST(isodow({x})-1 AS BIGINT)"


def week0(x: str) -> str:
    return f"CAST(floor((dayofyear({x})+6-dayofweek({x}))/7) AS BIGINT)"


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


def pct2(n: str, d: str) -> str:
    """round(n/d*100, 2) half up, exact, NULL for d = 0."""
    return (f"CASE WHEN ({d})=0 THEN NULL ELSE "
            f"CAST((CAST({n} AS BIGINT)*20000+({d}))//(2*({d})) AS DOUBLE)/100 END")


def avg1(s: str, c: str) -> str:
    """round(s/c, 1) half up, exact, NULL for c = 0."""
    return (f"CASE WHEN ({c})=0 THEN NULL ELSE "
            f"CAST((CAST({s} AS BIGINT)*20+({c}))//(2*({c})) AS DOUBLE)/10 END")


def cents2(cents: str, d: str) -> str:
    """round(cents/100/d, 2) half up, exact, NULL for d = 0."""
    return (f"CASE WHEN ({d})=0 THEN NULL ELSE "
            f"CAST((CAST({cents} AS BIGINT)*2+({d}))//(2*({d})) AS DOUBLE)/100 END")


def ratio(n: str, d: str) -> str:
    """n/d as double, NULL for d = 0."""
    return f"(CAST({n} AS DOUBLE)/NULLIF({d},0))"
