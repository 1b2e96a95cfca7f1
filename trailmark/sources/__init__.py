"""Sources: typed raw-table readers and the derived commerce tables."""

from trailmark.sources.commerce_tables import (
    TABLE_SCHEMAS,
    CommerceTables,
    file_reader,
    jdbc_reader,
    register_views,
)
from trailmark.sources.tables import SCHEMAS, read_table
from trailmark.sources.views import (
    CommerceData,
    order_item_refunds,
    order_items,
    store_orders,
    web_orders,
    website_pageviews,
    website_sessions,
)

__all__ = [
    "SCHEMAS",
    "TABLE_SCHEMAS",
    "CommerceData",
    "CommerceTables",
    "file_reader",
    "jdbc_reader",
    "register_views",
    "order_item_refunds",
    "order_items",
    "read_table",
    "store_orders",
    "web_orders",
    "website_pageviews",
    "website_sessions",
]
