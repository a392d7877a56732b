"""The registered queries once more, as SQL over the test data's tables.

The views repeat the adapter in SQL; a query text names the views it needs.
"""

from __future__ import annotations

import re

from retail_spark import constants
from retail_spark.functions import semantics
from retail_spark.operators import text as text_ops
from retail_spark.operators.maintenance import COLOUR_PATTERN
from retail_spark.sources.testdata import TEST_SECRET


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def listed(values: list[str]) -> str:
    return ", ".join(quoted(v) for v in values)


def pick(values: list[str], index: str) -> str:
    return f"list_extract([{listed(values)}], cast({index} as int) + 1)"


METHODS = [constants.WOMPI, constants.CASH_ON_DELIVERY, constants.PAYPAL]
SOLD = f"({listed(constants.SOLD_STATUSES)})"
JS_FLOAT = quoted(semantics.LEADING_FLOAT)
JS_INT = quoted(semantics.LEADING_INT)


def js_float(column: str) -> str:
    return f"try_cast(nullif(regexp_extract({column}, {JS_FLOAT}, 1), '') as double)"


def js_int(column: str) -> str:
    return f"try_cast(nullif(regexp_extract({column}, {JS_INT}, 1), '') as bigint)"


def es_number(column: str) -> str:
    return (
        f"translate(regexp_replace(format('{{:,.2f}}', cast({column} as double)), '\\.?0*$', ''), ',.', '.,')"
    )


def fill(template: str, **slots: str) -> str:
    """SQL text for a template: its slots are SQL expressions."""
    parts = []
    for piece in re.split(r"(\{[a-z]+\})", template):
        if re.fullmatch(r"\{[a-z]+\}", piece):
            parts.append(slots[piece[1:-1]])
        elif piece:
            parts.append("replace(" + quoted(piece.replace("\n", "~n")) + ", '~n', chr(10))")
    return "(" + " || ".join(parts) + ")"


VIEWS = {
    "category": "select cast(row_number() over (order by p_type) as int) as category_id, p_type as name "
    "from (select distinct p_type from part)",
    "product": "select p_partkey as product_id, p_name as name, p_brand || ' ' || p_type || ' ' || p_name as description, "
    "cast(p_retailprice as decimal(18,2)) as unit_price, p_brand as brand, "
    "lpad(cast(p_partkey as varchar), 13, '0') as barcode, c.category_id, "
    "cast(case when p_partkey % 10 = 0 then 0 else p_size * 20 end as int) as stock, "
    "'https://img.example/' || p_partkey || '_1.png' as image_url, "
    + ", ".join(
        f"case when p_partkey % {n} = 0 then 'https://img.example/' || p_partkey || '_{n}.png' end as image_url_{n}"
        for n in (2, 3, 4, 5)
    )
    + " from part left join category c on c.name = p_type",
    "raw_product": "select p_partkey as product_id, case cast(p_partkey % 5 as int) when 0 then p_size || 'abc' "
    "when 1 then '' when 2 then null when 3 then '  ' || p_size || '.5 COP' else 'x1' end as unit_price, "
    "case cast(p_partkey % 4 as int) when 0 then p_size || '.9' when 1 then null when 2 then 'n/a' "
    "else '-' || p_size || ' pcs' end as stock from part",
    "orders_v": "select o_orderkey as order_id, case when o_orderkey % 4 = 0 then null else o_custkey end as user_id, "
    f"cast(o_totalprice as decimal(18,2)) as total, {pick(constants.ORDER_STATUSES, 'o_orderkey % 7')} as status, "
    f"{pick(METHODS, 'o_orderkey % 3')} as payment_method, "
    "case when o_orderkey % 3 = 0 then 'ref_' || o_orderkey end as payment_ref, 'Guest ' || o_orderkey as ship_name, "
    "'Calle ' || o_custkey as ship_address, 'guest' || o_custkey || '@example.com' as ship_email, "
    "'+57 300-' || lpad(cast(o_custkey as varchar), 7, '0') as ship_phone, o_orderdate as created_at from orders",
    "order_line": "select l_orderkey as order_id, l_partkey as product_id, cast(l_quantity as int) as quantity, "
    "cast(l_extendedprice as decimal(18,2)) as unit_price from lineitem",
    "users": "select c_custkey as user_id, c_name as username, 'user' || c_custkey || '@example.com' as email, "
    "sha256(c_name) as password_hash, case when c_custkey % 50 = 0 then 'admin' when c_custkey % 50 = 1 then '' "
    "else 'cliente' end as role from customer",
    "buyer": "select c_custkey as customer_id, c_name as first_name, '' as last_name, "
    "'guest' || c_custkey || '@example.com' as email from customer where c_acctbal >= 0",
    "buyer_created": "select (select max(customer_id) from buyer) + row_number() over (order by request_id) as customer_id, "
    "coalesce(nullif(name, ''), split_part(email, '@', 1)) as first_name, '' as last_name, email from (select * from "
    "checkout_head where coalesce(email, '') <> '' and email not in (select email from buyer) "
    "qualify row_number() over (partition by email order by request_id) = 1)",
    "ev": "select *, cast(json_extract_string(props, '$.k') as bigint) as k from events",
    "product_view": "select event_id as view_id, k as product_id, ts as viewed_at from ev where event_type = 'view'",
    "view_request": "select event_id as view_id, case when event_id % 13 = 0 then k || 'x' when event_id % 7 = 0 "
    "then cast(-k - 1 as varchar) else cast(k as varchar) end as product_id, ts as viewed_at from ev",
    "review": "select event_id as review_id, k as product_id, user_id, 'User ' || user_id as reviewer_name, "
    "cast(event_id % 5 + 1 as int) as rating, props as comment, ts as created_at from ev "
    "where event_type = 'purchase'",
    "rating": "select product_id, avg(rating) as average_rating, count(*) as review_count from review group by product_id",
    "review_request": "select event_id as request_id, k as product_id, nullif(user_id, 0) as user_id, "
    "case when event_id % 9 = 0 then '' else 'User ' || user_id end as name, cast(event_id % 8 as int) as rating, "
    "case when event_id % 11 = 0 then null else event_type end as comment, ts as created_at from ev",
    "contact_message": "select conv_id * 1000 + turn as message_id, 'Person ' || conv_id as name, "
    "'person' || conv_id || '@example.com' as email, "
    "case when conv_id % 3 = 0 then null else 'Subject ' || conv_id end as subject, text as message, "
    "timestamp '2024-01-01 00:00:00' + conv_id * interval '1' minute as created_at, "
    f"{pick(['unread', 'read', 'archived'], 'conv_id % 3')} as status, conv_id % 5 = 0 as is_starred "
    "from conversations where role = 'user'",
    "contact_request": "select conv_id * 1000 + turn as request_id, "
    "case when conv_id % 8 = 0 then '' else 'Person ' || conv_id end as name, "
    "case when turn = 3 then null else 'person' || conv_id || '@example.com' end as email, "
    "case when conv_id % 3 = 0 then '' else 'Subject ' || conv_id end as subject, text as message, "
    "timestamp '2024-02-01 00:00:00' as created_at from conversations",
    "policy": "select doc_id as policy_id, 'Policy ' || doc_id as title, text as body, "
    "case when doc_id % 4 = 0 then null else doc_id % 3 end as sort_order from documents",
    "faq": "select q.conv_id * 1000 + q.turn as faq_id, q.text as question, a.text as answer, q.turn % 3 as sort_order "
    "from conversations q join conversations a on a.conv_id = q.conv_id and a.turn = q.turn + 1 "
    "and q.role = 'user' and a.role = 'assistant'",
    "setting_change": f"select event_id as position, {pick([*constants.SETTING_KEYS, 'unknownKey'], 'event_id % 14')} "
    "as setting_key, case when event_id % 5 = 0 then '  v' || event_id || ' ' when event_id % 5 = 1 then null "
    "when event_id % 5 = 2 then '#' || lpad(cast(event_id % 1000 as varchar), 3, '0') "
    "when event_id % 5 = 3 then 'https://s.example/' || k else 'ftp:' || k end as setting_value from ev",
    "setting": f"select {pick(constants.SETTING_KEYS[:6], 'event_id % 6')} as setting_key, "
    "max_by('https://s.example/' || k, event_id) as setting_value from ev where event_type = 'view' group by 1",
    "setting_default": "select * from (values "
    + ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in constants.setting_defaults().items())
    + ") t(setting_key, setting_value)",
    "payment_attempt": "select 'ref_' || o_orderkey as reference, o_orderkey as order_id, o_custkey as user_id, "
    "cast(o_totalprice as decimal(18,2)) as total, o_orderdate as attempted_at from orders",
    "payment_event_raw": "select 'ref_' || o_orderkey as reference, "
    "cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as amount_in_cents, 'COP' as currency, "
    f"{pick(['DECLINED', 'APPROVED', 'APPROVED', 'PENDING', 'ERROR'], 'o_orderkey % 5')} as status, "
    "o_orderkey * 2 + 1 as sent_at, o_orderdate + (o_orderkey % 41) * interval '1' minute as event_ts, "
    "o_orderkey % 11 = 0 as altered from orders union all select 'ref_' || case when o_orderkey % 6 = 0 "
    "then -o_orderkey - 1 else o_orderkey end, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint), 'COP', "
    f"{pick(['APPROVED', 'VOIDED', 'APPROVED'], 'o_orderkey % 3')}, o_orderkey * 2 + 2, "
    "o_orderdate + (o_orderkey % 23 + 10) * interval '1' minute, o_orderkey % 13 = 0 from orders",
    "payment_event": "select reference, amount_in_cents, currency, status, sent_at, event_ts, case when altered then "
    f"'tampered' else sha256(reference || amount_in_cents || currency || status || sent_at || '{TEST_SECRET}') end "
    "as checksum from payment_event_raw",
    "payment_put": "select o_orderkey * 4 + again as attempt_id, 'ref_' || case when o_orderkey % 40 = 0 then 0 else o_orderkey end "
    "as reference, case when again = 1 then lines[:2] else lines end as items, cast(o_totalprice as decimal(18,2)) as total, "
    "nullif(o_custkey, 0) as user_id, case when o_orderkey % 7 = 0 then null else 'Comprador ' || o_custkey end as full_name, "
    "'310' || o_custkey as phone, o_orderdate + again * (o_orderkey % 45) * interval '1' minute as attempted_at "
    "from orders join (select l_orderkey as o_orderkey, list({'product_id': l_partkey, 'quantity': cast(l_quantity as int), "
    "'price': cast(l_extendedprice as decimal(18,2))} order by l_linenumber, l_partkey, l_quantity, l_extendedprice) as lines from "
    "lineitem group by 1) using (o_orderkey), (select unnest([0, 1]) as again) where again = 0 or o_orderkey % 3 = 1",
    "stored_put": "select * from payment_put where len(list_filter(items, lambda i: coalesce(i.product_id, 0) = 0 or coalesce(i.quantity, 0) <= 0 "
    "or i.price is null)) = 0 and len(items) > 0 and total is not null",
    "payment_notice": "select o_orderkey * 8 + place as event_id, 'ref_' || case when o_orderkey % 40 = 0 then 0 else o_orderkey end as "
    "reference, cast(cast(o_totalprice as decimal(18,2)) * 100 as bigint) as amount_in_cents, 'COP' as currency, "
    f"case place when 1 then {pick(['APPROVED', 'VOIDED', 'APPROVED'], 'o_orderkey % 3')} when 3 then "
    f"{pick(['VOIDED', 'APPROVED', 'DECLINED'], 'o_orderkey % 3')} else "
    f"{pick(['DECLINED', 'APPROVED', 'APPROVED', 'PENDING', 'ERROR'], 'o_orderkey % 5')} end as status, "
    "o_orderkey * 2 + case when place = 1 then 2 else 1 end as sent_at, o_orderdate + case when place = 1 then o_orderkey % 23 + 10 "
    "else o_orderkey % 41 end * interval '1' minute as event_ts, (o_orderkey + place) % 17 <> 0 as ok, "
    "case when o_orderkey % 29 = 0 then null else 'guest' || o_custkey || '@example.com' end as customer_email, "
    "case when o_orderkey % 6 = 0 then '' else 'Guest ' || o_custkey end as full_name, 'Calle ' || o_custkey as address_line_1, "
    "case when o_orderkey % 2 = 0 then 'Apto 1' end as address_line_2, 'Atlantico' as region, 'Barranquilla' as city, "
    "case when o_orderkey % 5 = 0 then null else '300' || o_custkey end as phone_number "
    "from orders, (select unnest([0, 1, 2, 3]) as place) where place < 2 or (place = 2 and o_orderkey % 4 < 2) "
    "or (place = 3 and o_orderkey % 9 < 3)",
    "cart_event": "select event_id, user_id, event_id % 20 as product_id, case event_type when 'purchase' then 'set' "
    "when 'error' then 'remove' when 'signup' then 'clear' else 'add' end as kind, "
    "cast(event_id % 7 as int) as quantity, ts from ev",
    "checkout_line": "select l_orderkey as request_id, case when l_orderkey % 97 = 5 and l_linenumber = 1 then -1 "
    "else l_partkey end as product_id, cast(l_quantity as int) as quantity from lineitem",
    "checkout_head": "select o_orderkey as request_id, o_orderdate as created_at, "
    f"{pick(METHODS, 'o_orderkey % 3')} as method, nullif(o_custkey, 0) as user_id, "
    "case when o_orderkey % 31 = 0 then '' else 'Guest ' || o_custkey end as name, "
    "case when o_orderkey % 37 = 0 then null else '300' || o_custkey end as phone, 'Calle ' || o_custkey as address, "
    "'Atlantico' as department, 'Barranquilla' as city, "
    "case when o_orderkey % 2 = 0 then '' else 'Porton azul' end as complement, "
    "case when o_orderkey % 41 = 0 then null else 'guest' || o_custkey || '@example.com' end as email from orders",
    "checkout_verdict": "select h.*, case when l.request_id is null then 'empty_cart' when coalesce(name, '') = '' or "
    "coalesce(phone, '') = '' or coalesce(email, '') = '' then 'missing_field' when l.bad then 'bad_quantity' end "
    "as reason from checkout_head h left join (select request_id, bool_or(quantity <= 0) as bad from checkout_line "
    "group by 1) l using (request_id)",
    "cart_total": "select l.request_id, sum(p.unit_price * l.quantity) as total, bool_and(p.product_id is not null) "
    "as known from checkout_line l left join product p using (product_id) group by 1",
    "capture": "select 'PP-' || o_orderkey as provider_order_id, "
    f"{pick(['COMPLETED', 'PENDING', 'COMPLETED', 'DECLINED'], 'o_orderkey % 4')} as status, "
    "o_orderkey as request_id from orders",
    "cart_item": "select user_id, k as product_id, case when event_id % 6 = 0 then "
    "cast(value as varchar) || ' COP' when event_id % 6 = 1 then 'gratis' "
    "else cast(cast(value as decimal(18,2)) as varchar) end as price, case when event_id % 5 = 0 then "
    "(event_id % 7) || ' und' when event_id % 5 = 1 then null else cast(event_id % 9 as varchar) end as quantity from ev",
    "user_header": "select event_id as request_id, case when event_id % 10 = 0 then 'anon' when event_id % 10 = 1 "
    "then null when event_id % 10 = 2 then user_id || ' web' when event_id % 10 = 3 then "
    "cast(user_id + 1000000 as varchar) else cast(user_id as varchar) end as user_ref from ev",
    "rate": "select 'USD' as currency, cast(cast(avg(cast(value as decimal(18,2))) as decimal(18,2)) * 100 as "
    "decimal(18,6)) as rate, cast(ts as date) as as_of from events group by 3",
    "product_request": "select p_partkey as position, case when p_partkey % 19 = 0 then '' else 'Nuevo ' || p_name end "
    "as name, '' as description, case when p_partkey % 7 = 0 then 'abc' when p_partkey % 11 = 0 then '-5' else "
    "cast(cast(p_retailprice as decimal(18,2)) as varchar) end as unit_price, p_brand as brand, "
    "case cast(p_partkey % 3 as int) when 0 then lpad(cast(p_partkey as varchar), 13, '0') "
    "when 1 then 'N' || (p_partkey // 6) else '' end as barcode, case cast(p_partkey % 5 as int) when 0 then 'x' "
    "when 1 then null else '3' end as category_id, p_size || ' und' as stock from part",
    "product_edit": "select o_orderkey as position, (o_orderkey * 7) % 3001 as product_id, "
    "case when o_orderkey % 23 = 0 then '' else 'Edit ' || o_orderkey end as name, "
    "cast(cast(o_totalprice as decimal(18,2)) as varchar) as unit_price, cast(o_orderkey % 50 as varchar) as stock, "
    "'B' as brand, case cast(o_orderkey % 5 as int) when 0 then "
    "lpad(cast((o_orderkey * 7) % 3001 as varchar), 13, '0') when 1 then "
    "lpad(cast((o_orderkey * 7) % 3001 + 1 as varchar), 13, '0') else 'E' || o_orderkey end as barcode from orders",
    # Edits replayed one by one: -1 holds the last turn served, 'p' and an id what a product bears, 'b' and a barcode who bears it,
    # 't' and a turn whether that edit stands.
    "edit_turn": "select row_number() over (order by position) as turn, e.* from product_edit e where name <> '' and product_id in "
    "(select product_id from product)",
    "edit_replay": "with recursive served(k, v) using key (k) as (select 'p' || product_id as k, barcode as v from product union all select 'b' || "
    "barcode, cast(product_id as varchar) from product union all select '-1', '0' union select k, v from (with now as (select e.turn, "
    "cast(e.product_id as varchar) as id, e.barcode, (select v from recurring.served where k = 'b' || e.barcode) as holder, (select v from "
    "recurring.served where k = 'p' || e.product_id) as old from edit_turn e where e.turn = (select cast(v as bigint) + 1 from "
    "recurring.served where k = '-1')), verdict as (select *, holder is null or holder = id as ok from now) select '-1' as k, cast(turn as varchar) "
    "as v from verdict union all select 't' || turn, cast(ok as varchar) from verdict union all select 'b' || old, null from verdict where ok and old "
    "is not null and old is distinct from barcode union all select 'b' || barcode, id from verdict where ok and barcode is not null union all "
    "select 'p' || id, barcode from verdict where ok)) select cast(k[2:] as bigint) as turn from served where k like 't%' and v = 'true'",
    "edit_standing": "select e.* from edit_turn e join edit_replay using (turn)",
    "newest_edit": "select * from edit_standing qualify row_number() over (partition by product_id order by position desc) "
    "= 1",
    "registration": "select event_id as position, case when event_id % 9 = 0 then '' else 'n' || user_id end as username, "
    "case when event_id % 4 = 0 then 'user' || user_id || '@example.com' else 'new' || (event_id % 3000) || "
    "'@example.com' end as email, cast(event_id % 12 as int) as password_length, "
    "sha256(cast(event_id as varchar)) as password_hash from events",
    "registered": "select * from registration where username <> '' and password_length >= 6 "
    "and email not in (select email from users) qualify row_number() over (partition by email order by position) = 1",
    "role_change": "select event_id as position, case when event_id % 17 = 0 then user_id + 1000000 else user_id end "
    f"as user_id, {pick(['admin', 'cliente', 'root'], 'event_id % 3')} as role from events",
    "status_change": "select o_orderkey as position, case when o_orderkey % 13 = 0 then o_orderkey + 1000000000 else "
    f"o_orderkey end as order_id, {pick([*constants.ORDER_STATUSES, 'Perdido'], '(o_orderkey * 5) % 8')} as status "
    "from orders",
    "message_change": "select turn as position, conv_id * 1000 + turn as message_id, "
    f"{pick(['read', 'unread', 'archived', 'spam'], '(conv_id + turn) % 4')} as status, turn % 4 = 0 as is_starred "
    "from conversations",
    "policy_edit": "select page_id * 3 as policy_id, page_id * 2 as position, 'Borrador' as title, url as body from pages "
    "union all select page_id * 3, page_id * 2 + 1, url, html from pages",
    "faq_edit": "select conv_id * 1000 + turn as faq_id, turn as position, 'Edit ' || conv_id as question, "
    "text as answer from conversations",
    "reply": "select conv_id * 1000 + turn as reply_id, case when conv_id % 7 = 0 then '' else "
    "'person' || conv_id || '@example.com' end as recipient, case when conv_id % 3 = 0 then null else "
    "'Subject ' || conv_id end as subject, text as body from conversations where role = 'assistant'",
    "pending_change": "select created_at as changed_at, cast(1 as bigint) as delta from orders_v union all "
    "select created_at + (order_id % 5 + 1) * interval '1' day, cast(-1 as bigint) from orders_v",
    "raw_attempt": "select 'ref_' || o_orderkey as reference, case when o_orderkey % 14 = 0 then null else "
    "cast(o_totalprice as decimal(18,2)) end as total, case when o_orderkey % 9 = 0 then [] else "
    "[{'product_id': nullif(o_custkey, 0), 'quantity': cast(o_orderkey % 5 as int)}, "
    "{'product_id': o_orderkey + 1, 'quantity': 1}] end as items from orders",
}


def with_views(body: str) -> str:
    """Put the views a query text uses in front of it."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b(from|join)\s+{name}\b", sql):
                visit(VIEWS[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    prefix = ", ".join(f"{name} as materialized ({VIEWS[name]})" for name in needed)
    return f"with {prefix} {body}"
