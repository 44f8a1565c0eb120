"""The order model in SQL: named steps that the check queries are composed from.

``STEPS`` maps a step to its text; a step may use the given tables and earlier steps. ``compose``
emits only the steps a query needs.
"""

from __future__ import annotations

import re

STEPS: dict[str, str] = {
    # ---- the given tables in the shape of the order model
    "f_orders": """
        select o_orderkey as order_id, o_custkey as customer_id,
            case when o_orderstatus = 'F' then 'delivered' when o_orderstatus = 'O' then 'shipped'
                 when o_orderkey % 4 = 0 then 'canceled' else 'processing' end as order_status,
            o_orderdate + to_minutes(cast(o_orderkey*37 % 1440 as int)) as purchased_at,
            case when o_orderkey % 97 <> 0
                 then o_orderdate + to_minutes(cast(o_orderkey*37 % 1440 + o_custkey*13 % 4000 as int)) end as approved_at,
            case when o_orderstatus <> 'P'
                 then o_orderdate + to_minutes(cast(o_orderkey*37 % 1440 + (1 + o_orderkey % 9)*1440 - o_custkey % 3000 as int))
            end as shipped_at,
            case when o_orderstatus = 'F' and o_orderkey % 50 <> 0
                 then o_orderdate + to_minutes(cast(o_orderkey*37 % 1440 + (3 + (o_orderkey*7 + o_custkey) % 30)*1440 as int))
            end as delivered_at,
            cast(o_orderdate as date) + cast(10 + o_orderkey % 21 as int) as promised_date,
            case when o_orderkey % 10 = 9 then 'simulated' else 'marketplace' end as data_source,
            o_orderkey % 10 = 9 as is_synthetic,
            case when o_orderkey % 10 = 9 then timestamp '2001-06-01 02:00:00' end as sim_as_of
        from orders""",
    "f_items": """
        select l_orderkey as order_id, l_linenumber as order_item_number, l_partkey as product_id, l_suppkey as seller_id,
            o_orderdate + to_minutes(cast((2 + l_suppkey % 6)*1440 as int)) as shipping_limit_at,
            cast(l_extendedprice as decimal(28,6)) as price_brl,
            cast(cast(l_extendedprice as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(28,6)) as freight_brl
        from lineitem join orders on l_orderkey = o_orderkey""",
    "f_payments": """
        select l_orderkey as order_id, l_linenumber as payment_sequence,
            case l_returnflag when 'R' then 'boleto' when 'A' then 'credit_card' else 'voucher' end as payment_type,
            cast(1 + l_quantity % 12 as int) as installments,
            case when l_linenumber <> 7 then cast(l_extendedprice as decimal(28,6)) end as payment_brl
        from lineitem""",
    "f_reviews": """
        select event_id as review_id, event_id - event_id % 3 as order_id, cast(1 + event_id % 5 as int) as review_score,
            "value" > 50 as has_comment, cast(ts - interval 24 year as date) as review_sent_date,
            case when event_id % 11 <> 0 then ts - interval 24 year end as review_answered_at
        from events""",
    "f_states": """
        select n_name as state_code, r_name as region from nation join region on n_regionkey = r_regionkey""",
    "f_customers": """
        select c_custkey as customer_id, c_custkey // 2 as customer_unique_id,
            lpad(cast((c_custkey % 500)*197 % 100000 as varchar), 5, '0') as customer_zip_prefix,
            c_name as customer_city, n_name as customer_state
        from customer join nation on c_nationkey = n_nationkey""",
    "f_sellers": """
        select s_suppkey as seller_id, s_name as seller_city,
            lpad(cast((s_suppkey % 500)*197 % 100000 as varchar), 5, '0') as seller_zip_prefix, n_name as seller_state
        from supplier join nation on s_nationkey = n_nationkey""",
    "f_points": """
        select *, latitude between -33.8 and 5.3 and longitude between -74.0 and -34.7 as is_inside_brazil
        from (select lpad(cast((c_custkey % 500)*197 % 100000 as varchar), 5, '0') as zip_prefix,
                     cast(-34.5 as double) + (c_custkey*41 % 400)/10.0::double as latitude,
                     cast(-74.5 as double) + (c_custkey*29 % 400)/10.0::double as longitude from customer
              union all
              select lpad(cast((s_suppkey % 500)*197 % 100000 as varchar), 5, '0'),
                     cast(-34.5 as double) + (s_suppkey*37 % 400)/10.0::double,
                     cast(-74.5 as double) + (s_suppkey*53 % 400)/10.0::double from supplier)""",
    "f_products": """
        select p_partkey as product_id, case when p_partkey % 20 <> 0 then p_type end as category_name_pt,
            cast(p_size % 6 as int) as photo_count, case when p_partkey % 33 <> 0 then p_size*250.0::double end as weight_g,
            p_size::double as length_cm, (p_partkey % 40 + 1)::double as height_cm, (p_partkey % 25 + 1)::double as width_cm
        from part""",
    "f_categories": """
        select distinct p_type as category_name_pt, lower(p_type) as category_name_en from part where p_type <> 'PROMO'""",
    "f_fx": """
        select distinct cast(o_orderdate as date) as rate_date,
            3.0::double + (isodow(cast(o_orderdate as date)) + year(o_orderdate) % 7)/10.0::double as brl_per_eur
        from orders where isodow(cast(o_orderdate as date)) <= 5""",
    "f_inflation": """
        select distinct cast(date_trunc('month', o_orderdate) as date) as month_start,
            (month(o_orderdate)*7 + year(o_orderdate)) % 9 / 10.0::double - 0.2::double as pct_change
        from orders""",
    "f_holidays": """
        select holiday_date, holiday_name, holiday_name in ('1-URGENT', '2-HIGH') as is_nationwide,
            case when holiday_name not in ('1-URGENT', '2-HIGH') then ['BR-' || a.n_name, 'BR-' || b.n_name] end as state_iso_codes,
            (length(holiday_name) + day(holiday_date)) % 3 <> 0 as is_public_holiday,
            (length(holiday_name) + day(holiday_date)) % 2 = 0 as is_bank_holiday
        from (select min(o_orderdate)::date as holiday_date, o_orderpriority as holiday_name
              from orders group by date_trunc('month', o_orderdate), o_orderpriority)
        join nation a on a.n_nationkey = dayofyear(holiday_date) % 25
        join nation b on b.n_nationkey = (dayofyear(holiday_date) + 7) % 25""",
    "f_rain": """
        select n_name as state_code, cast(o_orderdate as date) as weather_date, cast(count(*)*9 as double) as precipitation_mm
        from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by all""",
    # ---- per-order summaries
    "items_summary": """
        select i.order_id, count(*) as item_count, count(distinct i.seller_id) as seller_count,
            sum(i.price_brl) as products_brl, sum(i.freight_brl) as freight_brl,
            sum(i.price_brl) + sum(i.freight_brl) as gmv_brl, max(i.shipping_limit_at) as seller_ship_by_at,
            any_value(top.seller_id) as primary_seller_id
        from f_items i
        join (select order_id, seller_id from f_items group by order_id, seller_id
              qualify row_number() over (partition by order_id order by sum(price_brl) desc nulls last, seller_id nulls last) = 1) top
          using (order_id)
        group by i.order_id""",
    "payments_summary": """
        select order_id, first(payment_type order by payment_brl desc nulls last, payment_sequence nulls last, payment_type nulls last) as main_payment_type,
            count(*) as payment_count, sum(payment_brl) as paid_brl, max(installments) as max_installments,
            coalesce(bool_or(payment_type = 'voucher'), false) as used_voucher
        from f_payments group by order_id""",
    "reviews_latest": """
        select order_id, review_id, review_score, has_comment, review_sent_date, review_answered_at,
            count(*) over (partition by order_id) as reviews_for_order
        from f_reviews
        qualify row_number() over (partition by order_id order by review_answered_at desc nulls last, review_sent_date desc nulls last, review_id nulls last) = 1""",
    "zips": """
        select zip_prefix, avg(latitude) as latitude, avg(longitude) as longitude, count(*) as point_count
        from f_points where is_inside_brazil group by zip_prefix""",
    "fx_daily": """
        select d::date as rate_date,
            last_value(brl_per_eur ignore nulls) over (order by d rows between unbounded preceding and current row) as brl_per_eur,
            brl_per_eur is not null as is_published_rate
        from generate_series(date '1995-01-01', date '2001-12-31', interval 1 day) g(d)
        left join f_fx on rate_date = d""",
    "state_holidays": """
        select state_code, holiday_date, string_agg(holiday_name, ' / ' order by holiday_name) as holiday_names,
            bool_or(is_public_holiday) as is_public_holiday, bool_or(is_bank_holiday) as is_bank_holiday,
            isodow(holiday_date) <= 5 as is_weekday
        from f_states join f_holidays on is_nationwide or list_contains(state_iso_codes, 'BR-' || state_code)
        group by state_code, holiday_date""",
    "timeline": """
        select *,
            date_diff('day', purchase_date, promised_date) as promised_days,
            case when is_delivered then date_diff('day', purchase_date, delivered_date) end as actual_days,
            case when is_delivered then late end as is_late,
            case when late then date_diff('day', promised_date, delivered_date) else 0 end as days_late,
            date_diff('minute', purchased_at, approved_at) / 60.0::double as approval_hours,
            case when not has_timestamp_anomaly then date_diff('minute', approved_at, shipped_at) / 60.0::double / 24 end as handover_days,
            case when not has_timestamp_anomaly then date_diff('minute', shipped_at, delivered_at) / 60.0::double / 24 end as transit_days,
            case when shipped_at is not null then shipped_at > seller_ship_by_at end as seller_missed_ship_by,
            case when late then 'Late' when is_delivered then 'On time'
                 when order_status in ('canceled', 'unavailable') then 'Cancelled'
                 when order_status = 'delivered' then 'Delivered, date missing'
                 when promised_date < ifnull(sim_as_of::date, date '2001-08-01') then 'Overdue, not delivered'
                 else 'Open, not yet due' end as delivery_outcome,
            case when late is not true then null
                 when has_timestamp_anomaly or shipped_at is null or seller_ship_by_at is null then 'Unclear (timestamp issue)'
                 when shipped_at > seller_ship_by_at then 'Seller shipped late'
                 else 'After hand-over (carrier or promise)' end as late_cause
        from (select o.*, s.* exclude (order_id), purchased_at::date as purchase_date, shipped_at::date as shipped_date,
                     delivered_at::date as delivered_date, order_status = 'delivered' and delivered_at is not null as is_delivered,
                     order_status = 'delivered' and delivered_at is not null and delivered_at::date > promised_date as late,
                     ifnull(shipped_at < purchased_at or shipped_at < approved_at or delivered_at < shipped_at, false) as has_timestamp_anomaly
              from f_orders o left join items_summary s on s.order_id = o.order_id)""",
    "context": """
        select t.order_id,
            (select count(*) from state_holidays h where h.is_weekday and h.state_code = c.customer_state
                and h.holiday_date >= t.purchase_date and h.holiday_date < t.purchase_date + 10) as weekday_holidays_first_10_days,
            case when t.shipped_date is not null then ifnull((select count(*) filter (precipitation_mm >= 20) from f_rain r
                where r.state_code = c.customer_state and r.weather_date >= t.shipped_date and r.weather_date < t.shipped_date + 7), 0)
            end as heavy_rain_days_first_7_days_transit,
            case when t.shipped_date is not null then (select sum(precipitation_mm) from f_rain r
                where r.state_code = c.customer_state and r.weather_date >= t.shipped_date and r.weather_date < t.shipped_date + 7)
            end as rain_mm_first_7_days_transit
        from timeline t join f_customers c on c.customer_id = t.customer_id""",
    # ---- facts
    "fct_orders": """
        select *, case when delivery_outcome = 'Late' then gmv_eur else 0 end as late_gmv_eur,
            case when revenue_at_risk_reason is not null then gmv_eur else 0 end as revenue_at_risk_eur
        from (
            select *, gmv_brl::double / brl_per_eur as gmv_eur, freight_brl::double / brl_per_eur as freight_eur,
                case when distance_km is null then 'Unknown' when distance_km < 250 then '1: under 250 km'
                     when distance_km < 750 then '2: 250-750 km' when distance_km < 1500 then '3: 750-1,500 km'
                     else '4: over 1,500 km' end as distance_band,
                case when delivery_outcome = 'Late' and is_low_review then 'Late and rated 1-2 stars'
                     when delivery_outcome = 'Overdue, not delivered' then 'Overdue, never delivered' end as revenue_at_risk_reason
            from (
                select t.* exclude (item_count, seller_count, products_brl, freight_brl, gmv_brl),
                    c.customer_unique_id, c.customer_city, c.customer_state, cs.region as customer_region,
                    s.seller_state, ss.region as seller_region, s.seller_state || ' -> ' || c.customer_state as route,
                    2 * 6371 * asin(sqrt(pow(sin(radians(cz.latitude - sz.latitude) / 2), 2)
                        + cos(radians(sz.latitude)) * cos(radians(cz.latitude))
                        * pow(sin(radians(cz.longitude - sz.longitude) / 2), 2))) as distance_km,
                    p.main_payment_type, p.max_installments, p.used_voucher,
                    ifnull(t.item_count, 0) as item_count, ifnull(t.seller_count, 0) as seller_count,
                    ifnull(t.products_brl, 0) as products_brl, ifnull(t.freight_brl, 0) as freight_brl,
                    ifnull(t.gmv_brl, 0) as gmv_brl, fx.brl_per_eur, r.review_score, r.review_score <= 2 as is_low_review,
                    r.review_sent_date, r.review_answered_at, x.* exclude (order_id),
                    t.data_source = 'marketplace' and t.purchase_date >= date '1996-01-01'
                        and t.purchase_date < date '2001-01-01' as is_in_kpi_window
                from timeline t join f_customers c on c.customer_id = t.customer_id
                left join f_states cs on cs.state_code = c.customer_state
                left join f_sellers s on s.seller_id = t.primary_seller_id
                left join f_states ss on ss.state_code = s.seller_state
                left join zips cz on cz.zip_prefix = c.customer_zip_prefix
                left join zips sz on sz.zip_prefix = s.seller_zip_prefix
                left join payments_summary p on p.order_id = t.order_id
                left join reviews_latest r on r.order_id = t.order_id
                left join context x on x.order_id = t.order_id
                left join fx_daily fx on fx.rate_date = t.purchase_date))""",
    "kpi_orders": "select * from fct_orders where is_in_kpi_window",
    "fct_order_items": """
        select md5(i.order_id || '-' || i.order_item_number) as order_item_key, i.order_id, i.order_item_number,
            o.data_source, o.is_synthetic, i.product_id, i.seller_id, s.seller_state, o.customer_state, o.purchase_date,
            o.is_in_kpi_window, i.shipping_limit_at, o.shipped_at,
            case when o.shipped_at is not null then o.shipped_at > i.shipping_limit_at end as seller_missed_ship_by,
            o.delivery_outcome, o.is_delivered, o.is_late, o.days_late, o.review_score, o.is_low_review,
            i.price_brl, i.freight_brl, i.price_brl + i.freight_brl as item_gmv_brl, o.brl_per_eur,
            (i.price_brl + i.freight_brl)::double / o.brl_per_eur as item_gmv_eur,
            case when o.delivery_outcome = 'Late' then (i.price_brl + i.freight_brl)::double / o.brl_per_eur else 0 end as late_gmv_eur,
            case when o.revenue_at_risk_reason is not null then (i.price_brl + i.freight_brl)::double / o.brl_per_eur else 0 end as revenue_at_risk_eur
        from f_items i join fct_orders o on o.order_id = i.order_id left join f_sellers s on s.seller_id = i.seller_id""",
    # ---- result tables
    "monthly": """
        select *, late_orders / nullif(delivered_orders, 0)::double as late_rate,
            1 - late_orders / nullif(delivered_orders, 0)::double as on_time_rate,
            sum(late_orders) over w3 / nullif(sum(delivered_orders) over w3, 0)::double as late_rate_rolling_3m,
            gmv_eur - lag(gmv_eur) over (order by month_start) as gmv_eur_change_vs_prior_month,
            revenue_at_risk_eur / nullif(gmv_eur, 0) as revenue_at_risk_share,
            avg_promised_days - avg_actual_days as avg_buffer_days
        from (select date_trunc('month', purchase_date)::date as month_start, count(*) as orders,
                count(*) filter (is_delivered) as delivered_orders, count(*) filter (is_late) as late_orders,
                count(*) filter (delivery_outcome = 'Overdue, not delivered') as overdue_orders, sum(gmv_eur) as gmv_eur,
                sum(late_gmv_eur) as late_gmv_eur, sum(revenue_at_risk_eur) as revenue_at_risk_eur,
                avg(promised_days) filter (is_delivered) as avg_promised_days, avg(actual_days) as avg_actual_days,
                avg(review_score) as avg_review_score
              from kpi_orders group by 1)
        window w3 as (order by month_start rows 2 preceding)""",
    "routes": """
        select *, case when is_rankable then rank() over (partition by is_rankable order by revenue_at_risk_eur desc nulls last) end as revenue_at_risk_rank,
            case when is_rankable then rank() over (partition by is_rankable order by late_rate desc nulls last) end as late_rate_rank,
            revenue_at_risk_eur / nullif(sum(revenue_at_risk_eur) over (), 0) as share_of_revenue_at_risk,
            sum(revenue_at_risk_eur) over (order by revenue_at_risk_eur desc nulls last, route rows unbounded preceding)
                / nullif(sum(revenue_at_risk_eur) over (), 0) as cumulative_share_of_revenue_at_risk
        from (select route, seller_state, customer_state, count(*) as orders, count(*) filter (is_delivered) as delivered_orders,
                count(*) filter (is_late) as late_orders, avg(distance_km) as avg_distance_km,
                avg(promised_days) filter (is_delivered) as avg_promised_days, avg(actual_days) as avg_actual_days,
                quantile_disc(actual_days, 0.9) as p90_actual_days, sum(gmv_eur) as gmv_eur, sum(late_gmv_eur) as late_gmv_eur,
                sum(revenue_at_risk_eur) as revenue_at_risk_eur,
                count(*) filter (is_late) / nullif(count(*) filter (is_delivered), 0)::double as late_rate,
                avg(promised_days) filter (is_delivered) - avg(actual_days) as avg_buffer_days,
                count(*) filter (is_delivered) >= 10 as is_rankable
              from kpi_orders where seller_state is not null group by all)""",
    "sellers_scored": """
        select *, case when is_rankable then rank() over (partition by is_rankable order by revenue_at_risk_eur desc nulls last) end as revenue_at_risk_rank,
            case when is_rankable then percent_rank() over (partition by is_rankable order by late_rate nulls last) end as late_rate_percentile,
            is_rankable and late_rate >= 1.05::double * platform_late_rate as is_on_watchlist
        from (select *, late_orders / nullif(delivered_orders, 0)::double as late_rate,
                sum(late_orders) over () / (sum(delivered_orders) over ())::double as platform_late_rate,
                delivered_orders >= 10 as is_rankable
              from (select seller_id, seller_state, count(*) as orders, count(*) filter (is_delivered) as delivered_orders,
                        count(*) filter (is_late) as late_orders,
                        count(*) filter (missed) / nullif(count(*) filter (has_result), 0)::double as missed_ship_by_rate,
                        avg(review_score) as avg_review_score, sum(gmv_eur) as gmv_eur, sum(late_gmv_eur) as late_gmv_eur,
                        sum(revenue_at_risk_eur) as revenue_at_risk_eur
                    from (select seller_id, seller_state, order_id, bool_or(is_delivered) as is_delivered,
                              bool_or(is_late) as is_late, bool_or(seller_missed_ship_by) as missed,
                              count(seller_missed_ship_by) > 0 as has_result, max(review_score) as review_score,
                              sum(item_gmv_eur) as gmv_eur, sum(late_gmv_eur) as late_gmv_eur,
                              sum(revenue_at_risk_eur) as revenue_at_risk_eur
                          from fct_order_items where is_in_kpi_window group by all)
                    group by all))""",
    "drivers": """
        with flagged as (
            select customer_state, date_trunc('week', purchase_date)::date as pw, date_trunc('week', shipped_date)::date as sw,
                is_late::int as late, promised_days, actual_days, seller_missed_ship_by as d1, seller_state <> customer_state as d2,
                distance_km > 1000 as d3, heavy_rain_days_first_7_days_transit > 0 as d4, main_payment_type = 'boleto' as d5,
                weekday_holidays_first_10_days > 0 as d6
            from kpi_orders where is_delivered),
        long as (
            select 'Seller shipped after its deadline' as driver, pw as wk, d1 as exposed, * from flagged
            union all select 'Seller in another state', pw, d2, * from flagged
            union all select 'Distance over 1,000 km', pw, d3, * from flagged
            union all select 'Heavy rain at destination, first 7 days of transit', sw, d4, * from flagged
            union all select 'Paid by boleto (bank slip)', pw, d5, * from flagged
            union all select 'Weekday holiday in the first 10 days', pw, d6, * from flagged),
        strata as (
            select driver, count(*) filter (exposed) as n1, count(*) filter (not exposed) as n0,
                sum(late) filter (exposed) as l1, sum(late) filter (not exposed) as l0,
                avg(late) filter (exposed) - avg(late) filter (not exposed) as dl,
                avg(actual_days) filter (exposed) - avg(actual_days) filter (not exposed) as da,
                avg(promised_days) filter (exposed) - avg(promised_days) filter (not exposed) as dp
            from long where exposed is not null group by driver, customer_state, wk)
        select driver, sum(n1)::bigint as exposed_orders, sum(n1) / (sum(n1) + sum(n0))::double as share_exposed,
            sum(l1) / nullif(sum(n1), 0)::double as late_rate_exposed, sum(l0) / nullif(sum(n0), 0)::double as late_rate_not_exposed,
            sum(l1) / nullif(sum(n1), 0)::double - sum(l0) / nullif(sum(n0), 0)::double as raw_late_rate_difference,
            sum(n1*dl) filter (n1 > 0 and n0 > 0) / sum(n1) filter (n1 > 0 and n0 > 0) as adjusted_late_rate_difference,
            sum(n1*da) filter (n1 > 0 and n0 > 0) / sum(n1) filter (n1 > 0 and n0 > 0) as adjusted_actual_days_difference,
            sum(n1*dp) filter (n1 > 0 and n0 > 0) / sum(n1) filter (n1 > 0 and n0 > 0) as adjusted_promised_days_difference,
            (sum(n1) filter (n1 > 0 and n0 > 0))::bigint as exposed_orders_compared,
            (sum(n1) filter (n1 > 0 and n0 > 0)) / nullif(sum(n1), 0)::double as share_of_exposed_compared
        from strata group by driver""",
}


def compose(final: str, extra: dict[str, str] | None = None) -> str:
    """``with <needed steps> <final>``."""
    steps = {**STEPS, **(extra or {})}
    needed: list[str] = []

    def visit(text: str, above: tuple[str, ...]) -> None:
        for name in steps:
            if name not in above and name not in needed and re.search(rf"\b{name}\b", text):
                visit(steps[name], (*above, name))
                needed.append(name)

    visit(final, ())
    if not needed:
        return final.strip()
    steps_text = ",\n".join(f"{name} as ({steps[name]})" for name in needed)
    text = final.strip()
    if text.startswith("with "):
        return f"with {steps_text},\n{text.removeprefix('with ')}"
    return f"with {steps_text}\n{text}"


def rounded(names: str, source: str) -> str:
    """``select`` of a blank-separated list; ``name:2`` rounds to two digits as a double, ``:i32``/``:i64`` cast."""
    parts = []
    for name in names.split():
        column, _, digits = name.partition(":")
        if digits in ("i32", "i64"):
            parts.append(f"cast({column} as {'integer' if digits == 'i32' else 'bigint'}) as {column}")
        elif digits:
            parts.append(f"round(cast({column} as double), {digits}) as {column}")
        else:
            parts.append(column)
    return f"select {', '.join(parts)} from {source}"
