"""Schemas of the store's tables and messages, as DDL text that readers take directly."""

TABLES = {
    "product": (
        "product_id BIGINT, name STRING, description STRING, unit_price DECIMAL(18,2), brand STRING, "
        "barcode STRING, category_id INT, stock INT, image_url STRING, image_url_2 STRING, "
        "image_url_3 STRING, image_url_4 STRING, image_url_5 STRING"
    ),
    "category": "category_id INT, name STRING",
    "review": (
        "review_id BIGINT, product_id BIGINT, user_id BIGINT, reviewer_name STRING, rating INT, "
        "comment STRING, created_at TIMESTAMP_NTZ"
    ),
    "product_view": "view_id BIGINT, product_id BIGINT, viewed_at TIMESTAMP_NTZ",
    "orders": (
        "order_id BIGINT, user_id BIGINT, total DECIMAL(18,2), status STRING, payment_method STRING, "
        "payment_ref STRING, ship_name STRING, ship_address STRING, ship_department STRING, ship_city STRING, "
        "ship_reference STRING, ship_phone STRING, ship_email STRING, created_at TIMESTAMP_NTZ, customer_id BIGINT"
    ),
    "order_line": "order_id BIGINT, product_id BIGINT, quantity INT, unit_price DECIMAL(18,2)",
    "users": "user_id BIGINT, username STRING, email STRING, password_hash STRING, role STRING",
    "customer": "customer_id BIGINT, first_name STRING, last_name STRING, email STRING",
    "contact_message": (
        "message_id BIGINT, name STRING, email STRING, subject STRING, message STRING, "
        "created_at TIMESTAMP_NTZ, status STRING, is_starred BOOLEAN"
    ),
    "policy": "policy_id BIGINT, title STRING, body STRING, sort_order BIGINT",
    "faq": "faq_id BIGINT, question STRING, answer STRING, sort_order BIGINT",
    "site_setting": "setting_key STRING, setting_value STRING",
}

CART_ITEM = "STRUCT<product_id: BIGINT, quantity: INT, price: DECIMAL(18,2)>"

# Loosely typed cart as browsers store it.
RAW_CART = "ARRAY<STRUCT<productId: STRING, quantity: STRING, price: STRING>>"

CHECKOUT_REQUEST = (
    f"request_id BIGINT, created_at TIMESTAMP_NTZ, method STRING, cart ARRAY<{CART_ITEM}>, "
    "customer STRUCT<user_id: BIGINT, name: STRING, phone: STRING, address: STRING, department: STRING, "
    "city: STRING, complement: STRING, email: STRING>"
)

PAYMENT_ATTEMPT = (
    f"attempt_id BIGINT, reference STRING, items ARRAY<{CART_ITEM}>, total DECIMAL(18,2), user_id BIGINT, "
    "customer STRUCT<fullName: STRING, phone: STRING>, attempted_at TIMESTAMP"
)

# A payment event flattened, with the id under which it was received and the time it came.
PAYMENT_NOTICE = (
    "event_id BIGINT, checksum STRING, sent_at BIGINT, reference STRING, status STRING, amount_in_cents BIGINT, currency STRING, "
    "customer_email STRING, full_name STRING, address_line_1 STRING, address_line_2 STRING, region STRING, city STRING, "
    "phone_number STRING, event_ts TIMESTAMP_NTZ"
)

PAYMENT_WEBHOOK = (
    "signature STRUCT<checksum: STRING>, timestamp BIGINT, "
    "data STRUCT<transaction: STRUCT<reference: STRING, status: STRING, amount_in_cents: BIGINT, currency: STRING, "
    "customer_email: STRING, customer_data: STRUCT<full_name: STRING>, "
    "shipping_address: STRUCT<address_line_1: STRING, address_line_2: STRING, region: STRING, city: STRING, "
    "phone_number: STRING>>>"
)

REVIEW_REQUEST = "request_id BIGINT, product_id BIGINT, user_id BIGINT, name STRING, rating INT, comment STRING"
CONTACT_REQUEST = "request_id BIGINT, name STRING, email STRING, subject STRING, message STRING"
VIEW_REQUEST = "view_id BIGINT, product_id STRING, viewed_at TIMESTAMP_NTZ"
FX_RATE = "currency STRING, rate DECIMAL(18,6), as_of DATE"

# The wide tables the test data comes in.
TESTDATA = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": (
        "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"
    ),
    "orders": (
        "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
        "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING"
    ),
    "lineitem": (
        "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
        "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
        "l_shipdate TIMESTAMP_NTZ"
    ),
    "events": (
        "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
    ),
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}
