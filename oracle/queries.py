"""One SQL text per query name."""

from __future__ import annotations

from oracle.model import compose, rounded
from promiselens.plans.declarations import DECLARED, wrong_values

SQL: dict[str, str] = {}


def add(name: str, final: str, **steps: str) -> None:
    SQL[name] = compose(final, steps)


def add_table(name: str, source: str, columns: str, **steps: str) -> None:
    add(name, rounded(columns, source), **steps)


STAGES = (
    "purchase_date shipped_date delivered_date is_delivered has_timestamp_anomaly promised_days:i32 actual_days:i32 "
    "is_late days_late:i32 approval_hours:6 handover_days:6 transit_days:6 seller_missed_ship_by delivery_outcome late_cause"
)

# ---- models
add_table("order_outcomes", "timeline",
          "order_id customer_id order_status purchased_at approved_at shipped_at delivered_at promised_date data_source "
          "is_synthetic sim_as_of seller_ship_by_at " + STAGES)
add_table("order_items_summary", "items_summary",
          "order_id item_count seller_count products_brl:4 freight_brl:4 gmv_brl:4 seller_ship_by_at primary_seller_id")
add_table("payment_summary", "payments_summary",
          "order_id main_payment_type payment_count paid_brl:4 max_installments used_voucher")
add_table("latest_review", "reviews_latest",
          "order_id review_id review_score has_comment review_sent_date review_answered_at reviews_for_order")
add_table("fx_daily_fill", "fx_daily", "rate_date brl_per_eur:6 is_published_rate")
add_table("state_holidays", "state_holidays",
          "state_code holiday_date holiday_names is_public_holiday is_bank_holiday is_weekday")
add_table("zip_centroids", "zips", "zip_prefix latitude:6 longitude:6 point_count")
add("haversine_routes", """
    select route, count(distance_km) as orders_with_distance, round(min(distance_km), 6) as min_km, round(avg(distance_km), 6) as avg_km,
        round(max(distance_km), 6) as max_km, count(*) filter (distance_km >= 1500) as orders_over_1500_km
    from fct_orders where route is not null group by route""")
add_table("order_context", "context",
          "order_id weekday_holidays_first_10_days heavy_rain_days_first_7_days_transit rain_mm_first_7_days_transit:6")
add_table("fct_orders", "fct_orders",
          "order_id data_source is_synthetic sim_as_of customer_unique_id customer_city customer_state customer_region "
          "primary_seller_id seller_state seller_region route distance_km:6 order_status purchased_at approved_at shipped_at "
          "delivered_at promised_date " + STAGES +
          " main_payment_type max_installments used_voucher item_count seller_count products_brl:4 freight_brl:4 gmv_brl:4 "
          "brl_per_eur:6 gmv_eur:8 freight_eur:8 review_score is_low_review review_sent_date weekday_holidays_first_10_days "
          "heavy_rain_days_first_7_days_transit rain_mm_first_7_days_transit:6 is_in_kpi_window distance_band "
          "revenue_at_risk_reason late_gmv_eur:8 revenue_at_risk_eur:8")
add_table("fct_order_items", "fct_order_items",
          "order_item_key order_id order_item_number data_source is_synthetic product_id seller_id seller_state customer_state "
          "purchase_date is_in_kpi_window shipping_limit_at shipped_at seller_missed_ship_by delivery_outcome is_delivered "
          "is_late days_late:i32 review_score is_low_review price_brl:4 freight_brl:4 item_gmv_brl:4 brl_per_eur:6 item_gmv_eur:8 "
          "late_gmv_eur:8 revenue_at_risk_eur:8")
add("dim_date", """
    select rate_date as date_day, year(rate_date)::int as year_number, quarter(rate_date)::int as quarter_number,
        month(rate_date)::int as month_number, date_trunc('month', rate_date)::date as month_start,
        isodow(rate_date)::int as iso_day_of_week, ifnull(is_public_holiday, false) as is_public_holiday,
        ifnull(is_bank_holiday, false) as is_bank_holiday, holiday_names, round(brl_per_eur, 6) as brl_per_eur, is_published_rate,
        rate_date between date '1996-01-01' and date '2000-12-31' as is_in_kpi_window,
        strftime(rate_date, '%Y-%m') as year_month, strftime(rate_date, '%b') as month_name, strftime(rate_date, '%a') as day_name,
        isodow(rate_date) in (6, 7) as is_weekend
    from fx_daily left join (
        select holiday_date, string_agg(holiday_name, ' / ' order by holiday_name) as holiday_names,
            bool_or(is_public_holiday) as is_public_holiday, bool_or(is_bank_holiday) as is_bank_holiday
        from f_holidays where is_nationwide group by holiday_date) on holiday_date = rate_date""")
add("dim_products", """
    select product_id, ifnull(p.category_name_pt, 'unknown') as category_name_pt,
        ifnull(c.category_name_en, 'unknown') as category_name_en, photo_count, round(weight_g, 6) as weight_g,
        round(length_cm * height_cm * width_cm, 6) as volume_cm3,
        case when weight_g is null then 'Unknown' when weight_g < 500 then '1: under 0.5 kg' when weight_g < 2000 then '2: 0.5-2 kg'
             when weight_g < 10000 then '3: 2-10 kg' else '4: over 10 kg' end as weight_band
    from f_products p left join f_categories c on c.category_name_pt = p.category_name_pt""")
add("dim_sellers", """
    select seller_id, seller_city, seller_state, region as seller_region, seller_zip_prefix,
        round(latitude, 6) as latitude, round(longitude, 6) as longitude
    from f_sellers left join f_states on state_code = seller_state left join zips on zip_prefix = seller_zip_prefix""")
add("dim_states", "select state_code, region from f_states")

# ---- result tables
add_table("monthly_kpis", "monthly",
          "month_start orders delivered_orders late_orders overdue_orders late_rate:6 on_time_rate:6 late_rate_rolling_3m:6 "
          "gmv_eur:2 gmv_eur_change_vs_prior_month:2 late_gmv_eur:2 revenue_at_risk_eur:2 revenue_at_risk_share:6 "
          "avg_promised_days:6 avg_actual_days:6 avg_buffer_days:6 avg_review_score:6")
ROUTE_COLUMNS = (
    "route seller_state customer_state orders delivered_orders late_orders avg_distance_km:6 avg_promised_days:6 "
    "avg_actual_days:6 p90_actual_days:i32 gmv_eur:2 late_gmv_eur:2 revenue_at_risk_eur:2 late_rate:6 avg_buffer_days:6 is_rankable "
    "revenue_at_risk_rank:i32 late_rate_rank:i32 share_of_revenue_at_risk:6 cumulative_share_of_revenue_at_risk:6"
)
add_table("route_performance", "routes", ROUTE_COLUMNS)
add_table("seller_performance", "sellers_scored",
          "seller_id seller_state orders delivered_orders late_orders missed_ship_by_rate:6 avg_review_score:6 gmv_eur:2 "
          "late_gmv_eur:2 revenue_at_risk_eur:2 late_rate:6 platform_late_rate:6 is_rankable revenue_at_risk_rank "
          "late_rate_percentile:6 is_on_watchlist")
DRIVER_COLUMNS = (
    "driver exposed_orders share_exposed:6 late_rate_exposed:6 late_rate_not_exposed:6 raw_late_rate_difference:6 "
    "adjusted_late_rate_difference:6 adjusted_actual_days_difference:6 adjusted_promised_days_difference:6 "
    "exposed_orders_compared share_of_exposed_compared:6"
)
add_table("late_drivers", "drivers", DRIVER_COLUMNS)
add("live_daily", """
    select purchase_date, orders, delivered_orders, late_orders, open_orders, overdue_orders, cancelled_orders,
        round(gmv_eur, 2) as gmv_eur, round(revenue_at_risk_eur, 2) as revenue_at_risk_eur,
        round(avg_review_score, 6) as avg_review_score, sim_as_of,
        round(late_orders / nullif(delivered_orders, 0)::double, 6) as late_rate_so_far,
        sum(orders) over (order by purchase_date rows 6 preceding)::bigint as orders_last_7_days,
        round(sum(late_orders) over m / nullif(sum(delivered_orders) over m, 0)::double, 6) as late_rate_last_30_days
    from (select purchase_date, count(*) as orders, count(*) filter (is_delivered) as delivered_orders,
            count(*) filter (is_late) as late_orders, count(*) filter (delivery_outcome like 'Open%') as open_orders,
            count(*) filter (delivery_outcome like 'Overdue%') as overdue_orders,
            count(*) filter (delivery_outcome = 'Cancelled') as cancelled_orders, sum(gmv_eur) as gmv_eur,
            sum(revenue_at_risk_eur) as revenue_at_risk_eur, avg(review_score) as avg_review_score, max(sim_as_of) as sim_as_of
          from fct_orders where is_synthetic group by purchase_date)
    window m as (order by purchase_date rows 29 preceding)""")

# ---- findings
add("headline_kpis", """
    select count(*) as orders, count(*) filter (is_delivered) as delivered_orders, count(*) filter (is_late) as late_orders,
        round(count(*) filter (is_late) / count(*) filter (is_delivered)::double, 6) as late_rate,
        count(*) filter (delivery_outcome = 'Overdue, not delivered') as overdue_orders, round(sum(gmv_eur), 2) as gmv_eur,
        round(sum(late_gmv_eur), 2) as late_gmv_eur, round(sum(revenue_at_risk_eur), 2) as revenue_at_risk_eur,
        round(avg(promised_days) filter (is_delivered), 6) as avg_promised_days, round(avg(actual_days), 6) as avg_actual_days
    from kpi_orders""")
add("risk_by_reason", """
    select revenue_at_risk_reason as reason, count(*) as orders, round(sum(revenue_at_risk_eur), 2) as revenue_at_risk_eur
    from kpi_orders where revenue_at_risk_reason is not null group by 1""")
add("outcomes_value", """
    select delivery_outcome, count(*) as orders, round(sum(gmv_eur), 2) as gmv_eur from kpi_orders group by 1""")
add("review_by_outcome", """
    select delivery_outcome, count(*) as reviewed_orders, round(avg(review_score), 6) as avg_review,
        round(avg(is_low_review::int), 6) as share_low_review
    from kpi_orders where delivery_outcome in ('On time', 'Late', 'Overdue, not delivered') and review_score is not null group by 1""")
add("review_by_days_late", """
    select case when days_late = 0 then '0: on time' when days_late between 1 and 2 then '1: 1-2 days'
                when days_late between 3 and 7 then '2: 3-7 days' when days_late between 8 and 14 then '3: 8-14 days'
                else '4: over 14 days' end as days_late_band,
        count(*) as orders, round(avg(review_score), 6) as avg_review, round(avg(is_low_review::int), 6) as share_low_review
    from kpi_orders where is_delivered and review_score is not null group by 1""")
add("stage_medians", """
    select if(is_late, 'Late', 'On time') as outcome, round(median(approval_hours), 6) as median_approval_hours,
        round(median(handover_days), 6) as median_seller_days, round(median(transit_days), 6) as median_carrier_days,
        round(avg(promised_days), 6) as avg_promised_days
    from kpi_orders where is_delivered group by 1""")
add("approval_by_payment", """
    select main_payment_type as payment_type, count(*) as delivered_orders, round(median(approval_hours), 6) as median_approval_hours,
        round(quantile_cont(approval_hours, 0.9), 6) as p90_approval_hours, round(avg(is_late::int), 6) as late_rate
    from kpi_orders where is_delivered and main_payment_type <> 'not_defined' group by 1""")
add("late_causes", """
    select late_cause, count(*) as late_orders, round(count(*) / sum(count(*)) over ()::double, 6) as share,
        round(sum(late_gmv_eur), 2) as late_gmv_eur
    from kpi_orders where is_late group by 1""")
add("region_summary", """
    select customer_region, count(*) as delivered_orders, round(avg(is_late::int), 6) as late_rate,
        round(avg(promised_days), 6) as avg_promised_days, round(avg(actual_days), 6) as avg_actual_days,
        round(sum(revenue_at_risk_eur), 2) as revenue_at_risk_eur
    from kpi_orders where is_delivered group by 1""")
add_table("ranked_drivers", "drivers", DRIVER_COLUMNS)
add("top_routes", rounded(ROUTE_COLUMNS, "routes where is_rankable"))
add("worst_late_routes", """
    select route, delivered_orders, round(late_rate, 6) as late_rate, round(avg_promised_days, 6) as avg_promised_days,
        round(avg_actual_days, 6) as avg_actual_days, p90_actual_days::int as p90_actual_days,
        round(avg_distance_km, 6) as avg_distance_km
    from (select * from routes where is_rankable order by routes.late_rate desc, route limit 10)""")
add("route_head_share", """
    select count(*) as routes, round(sum(share_of_revenue_at_risk), 6) as share_of_revenue_at_risk
    from (select * from routes where is_rankable order by revenue_at_risk_rank, route limit 10)""")
add("seller_population", """
    select count(*) as sellers, count(*) filter (is_rankable) as sellers_with_enough_orders,
        count(*) filter (is_on_watchlist) as watchlist_sellers, round(max(platform_late_rate), 6) as platform_late_rate,
        round(coalesce(sum(gmv_eur) filter (is_on_watchlist), 0) / sum(gmv_eur), 6) as watchlist_share_of_gmv,
        round(coalesce(sum(revenue_at_risk_eur) filter (is_on_watchlist), 0) / sum(revenue_at_risk_eur), 6)
            as watchlist_share_of_revenue_at_risk
    from sellers_scored""")
SELLER_SHOWN = """left(seller_id::varchar, 8) as seller, seller_state as state, delivered_orders, round(late_rate, 6) as late_rate,
        round(missed_ship_by_rate, 6) as missed_ship_by_rate, round(avg_review_score, 6) as avg_review_score"""
add("watchlist", f"""
    select {SELLER_SHOWN}, round(gmv_eur, 2) as gmv_eur, round(revenue_at_risk_eur, 2) as revenue_at_risk_eur
    from (select * from sellers_scored where is_on_watchlist order by sellers_scored.revenue_at_risk_eur desc, seller_id limit 10)""")
add("top_risk_sellers", f"""
    select revenue_at_risk_rank as rank, {SELLER_SHOWN}, round(revenue_at_risk_eur, 2) as revenue_at_risk_eur,
        is_on_watchlist as watchlist
    from (select * from sellers_scored where is_rankable order by revenue_at_risk_rank, seller_id limit 10)""")
add("promise_backtest", """
    with usable as (select * from fct_orders where is_delivered and route is not null and data_source = 'marketplace'),
    train as (select * from usable where purchase_date between date '1996-01-01' and date '1998-12-31'),
    level as (select unnest([0.8, 0.9, 0.95, 0.97])::double as p, unnest([1, 2, 3, 4]) as i),
    by_route as (select route, quantile_cont(actual_days, [0.8, 0.9, 0.95, 0.97]) as q from train group by 1 having count(*) >= 5),
    by_state as (select customer_state, quantile_cont(actual_days, [0.8, 0.9, 0.95, 0.97]) as q from train group by 1),
    overall as (select quantile_cont(actual_days, [0.8, 0.9, 0.95, 0.97]) as q from train)
    select p as percentile, count(*) as orders, round(avg(promised_days), 6) as current_avg_promise_days,
        round(avg(is_late::int), 6) as current_late_rate,
        round(avg(ceil(round(coalesce(r.q, s.q, o.q)[i], 9))), 6) as proposed_avg_promise_days,
        round(avg((actual_days > ceil(round(coalesce(r.q, s.q, o.q)[i], 9)))::int), 6) as proposed_late_rate
    from usable t left join by_route r on r.route = t.route left join by_state s on s.customer_state = t.customer_state
    cross join overall o cross join level
    where purchase_date between date '1999-01-01' and date '2000-12-31' group by p""")

# ---- semantic measures
MEASURES = """count(*) as orders, count(*) filter (is_delivered) as delivered_orders, count(*) filter (is_late) as late_orders,
        count(*) filter (delivery_outcome = 'Overdue, not delivered') as overdue_orders,
        round(count(*) filter (is_late) / nullif(count(*) filter (is_delivered), 0)::double, 6) as late_rate,
        round(1 - count(*) filter (is_late) / nullif(count(*) filter (is_delivered), 0)::double, 6) as on_time_rate,
        round(sum(gmv_eur), 2) as gmv_eur, round(sum(late_gmv_eur), 2) as late_gmv_eur,
        round(sum(revenue_at_risk_eur), 2) as revenue_at_risk_eur,
        round(sum(revenue_at_risk_eur) / nullif(sum(gmv_eur), 0), 6) as revenue_at_risk_share,
        round(avg(promised_days) filter (is_delivered), 6) as avg_promised_days, round(avg(actual_days), 6) as avg_actual_days,
        round(avg(promised_days) filter (is_delivered) - avg(actual_days), 6) as promise_buffer_days,
        round(avg(review_score), 6) as avg_review,
        round(count(*) filter (is_low_review) / nullif(count(review_score), 0)::double, 6) as low_review_share,
        round(count(*) filter (late_cause = 'Seller shipped late') / nullif(count(*) filter (is_late), 0)::double, 6)
            as seller_caused_share_of_late"""
add("semantic_measures", " union all ".join(
    f"select '{slicer}' as slicer, {slicer} as value, {MEASURES} from kpi_orders group by {slicer}"
    for slicer in ("customer_region", "main_payment_type", "delivery_outcome", "distance_band")))
add("category_values", """
    select ifnull(category_name_en, 'unknown') as category_name_en, count(*) as items, round(sum(item_gmv_eur), 2) as item_gmv_eur,
        round(sum(late_gmv_eur), 2) as late_gmv_eur, round(sum(revenue_at_risk_eur), 2) as revenue_at_risk_eur
    from fct_order_items join f_products p using (product_id)
    left join f_categories c on c.category_name_pt = p.category_name_pt
    where is_in_kpi_window group by 1""")
add("rolling_3m_calendar", """
    select d::date as date_day, count(*) filter (is_late) as late_orders, count(*) filter (is_delivered) as delivered_orders,
        round(count(*) filter (is_late) / nullif(count(*) filter (is_delivered), 0)::double, 6) as late_rate_3m
    from generate_series(date '1996-01-01', date '2000-12-31', interval 1 day) g(d)
    join kpi_orders on purchase_date <= d::date and purchase_date > d - interval 3 month
    where d::date between (select min(purchase_date) from kpi_orders) and (select max(purchase_date) from kpi_orders)
    group by d""")
add("late_rate_vs_prior_month", """
    select month_start, round(late_rate, 6) as late_rate, round(prior, 6) as prior_late_rate, round(late_rate - prior, 6) as late_rate_change
    from monthly left join (select month_start + interval 1 month as next_month, late_rate as prior from monthly) on next_month = month_start""")
WHAT_IF = """
    select {by}e::int as extra_days, count(*) as delivered_orders,
        round(avg((actual_days > promised_days + e)::int), 6) as simulated_late_rate
    from kpi_orders cross join range(-7, 8) r(e) where is_delivered group by {by}e"""
add("whatif_promise", WHAT_IF.format(by=""))
add("whatif_promise_by_region", WHAT_IF.format(by="customer_region, "))

# ---- data checks
add("dq_not_null", "select order_id, order_status, purchased_at from f_orders where approved_at is null")
add("dq_unique", 'select order_id, count(*) as "rows" from f_items group by order_id having count(*) > 1')
add("dq_relationships", """
    select order_id, count(*) as "rows" from f_reviews where order_id not in (select order_id from f_items) group by order_id""")
add("dq_accepted_values", """
    select payment_type, count(*) as "rows" from f_payments where payment_type not in ('credit_card', 'boleto') group by 1""")
add("dq_accepted_range", "select zip_prefix, latitude from f_points where latitude not between -33.8 and 5.3")
add("dq_unique_combination", """
    select order_id, order_item_number, count(*) as "rows" from f_items group by all having count(*) > 1""")
IN_ORDER = """(approved_at is null or approved_at >= purchased_at) and (shipped_at is null or shipped_at >= approved_at)
        and (delivered_at is null or delivered_at >= shipped_at)"""
add("dq_expression", f"""
    select order_id, purchased_at, approved_at, shipped_at, delivered_at from f_orders where is_synthetic and not ({IN_ORDER})""")
add("dq_expression_strict", """
    select order_id, shipped_at from f_orders where is_synthetic and not ifnull(shipped_at <= sim_as_of, false)""")
add("dq_equal_rowcount", """
    select a as left_rows, b as right_rows from (select count(*) as a from f_items), (select count(*) as b from f_orders) where a <> b""")
add("dq_value_reconciles_to_source", """
    select s.data_source, round(s.brl::double, 4) as source_gmv_brl, round(m.brl::double, 4) as model_gmv_brl
    from (select data_source, sum(price_brl + freight_brl) as brl from f_items join f_orders using (order_id) group by 1) s
    left join (select data_source, sum(gmv_brl) as brl from fct_orders group by 1) m using (data_source)
    where m.brl is null or abs(s.brl - m.brl) > 0.01""")
add("dq_kpi_window_months", "select count(*) as months from monthly having count(*) <> 60")
add("dq_monthly_matches_orders", """
    select a as monthly_total, b as orders_total
    from (select sum(revenue_at_risk_eur) as a from monthly), (select sum(revenue_at_risk_eur) as b from kpi_orders)
    where abs(a - b) > 0.01""")
add("dq_items_reconcile_to_orders", """
    select o.order_id, round(o.gmv_eur, 2) as gmv_eur, round(i.v, 2) as item_gmv_eur
    from fct_orders o join (select order_id, sum(item_gmv_eur) as v, sum(revenue_at_risk_eur) as r from fct_order_items group by 1) i
        on i.order_id = o.order_id
    where abs(o.gmv_eur - i.v) > 0.001 or abs(o.revenue_at_risk_eur - i.r) > 0.001""")


def report(*lines: tuple[str, str]) -> str:
    return " union all ".join(f"select '{name}' as \"check\", count(*) as violations from {rows}" for name, rows in lines)


def repeated(table: str, keys: str) -> str:
    return f"(select {keys} from {table} group by {keys} having count(*) > 1)"


def orphan(child: str, key: str, parent: str, parent_key: str) -> str:
    return f"(select distinct {key} from {child} c where {key} is not null and not exists (select 1 from {parent} p where p.{parent_key} = c.{key}))"


add("dq_model_report", report(
    ("orders.order_id not null", "f_orders where order_id is null"),
    ("orders.purchased_at not null", "f_orders where purchased_at is null"),
    ("orders.promised_date not null", "f_orders where promised_date is null"),
    ("orders.order_status accepted", "f_orders where order_status not in ('delivered', 'shipped', 'canceled', 'unavailable', 'invoiced', 'processing', 'created', 'approved')"),
    ("synthetic orders are labelled", "f_orders where is_synthetic and data_source <> 'simulated'"),
    ("synthetic events in order", f"f_orders where is_synthetic and not ({IN_ORDER})"),
    ("synthetic nothing after snapshot", "f_orders where is_synthetic and greatest(purchased_at, approved_at, shipped_at, delivered_at) > sim_as_of"),
    ("items.price_brl above 0", "f_items where price_brl <= 0"),
    ("items.freight_brl at least 0", "f_items where freight_brl < 0"),
    ("payments.payment_type accepted", "f_payments where payment_type not in ('credit_card', 'boleto', 'voucher', 'debit_card', 'not_defined')"),
    ("reviews.review_score not null", "f_reviews where review_score is null"),
    ("reviews.review_score 1 to 5", "f_reviews where review_score not between 1 and 5"),
    ("customers.customer_id not null", "f_customers where customer_id is null"),
    ("sellers.seller_id not null", "f_sellers where seller_id is null"),
    ("products.product_id not null", "f_products where product_id is null"),
    ("fx.rate_date not null", "f_fx where rate_date is null"),
    ("fx.brl_per_eur 2 to 8", "f_fx where brl_per_eur not between 2 and 8"),
    ("weather.precipitation_mm not null", "f_rain where precipitation_mm is null"),
    ("weather.precipitation_mm at least 0", "f_rain where precipitation_mm < 0"),
    ("inflation.month_start not null", "f_inflation where month_start is null"),
    ("inflation.pct_change not null", "f_inflation where pct_change is null"),
    ("holidays.holiday_date not null", "f_holidays where holiday_date is null"),
    ("orders.order_id unique", repeated("f_orders", "order_id")),
    ("items (order, number) unique", repeated("f_items", "order_id, order_item_number")),
    ("payments (order, sequence) unique", repeated("f_payments", "order_id, payment_sequence")),
    ("reviews (review, order) unique", repeated("f_reviews", "review_id, order_id")),
    ("customers.customer_id unique", repeated("f_customers", "customer_id")),
    ("sellers.seller_id unique", repeated("f_sellers", "seller_id")),
    ("products.product_id unique", repeated("f_products", "product_id")),
    ("categories.category_name_pt unique", repeated("f_categories", "category_name_pt")),
    ("fx.rate_date unique", repeated("f_fx", "rate_date")),
    ("inflation.month_start unique", repeated("f_inflation", "month_start")),
    ("weather (state, day) unique", repeated("f_rain", "state_code, weather_date")),
    ("items.order_id in orders", orphan("f_items", "order_id", "f_orders", "order_id")),
    ("items.seller_id in sellers", orphan("f_items", "seller_id", "f_sellers", "seller_id")),
    ("items.product_id in products", orphan("f_items", "product_id", "f_products", "product_id")),
    ("customers.state in states", orphan("f_customers", "customer_state", "f_states", "state_code")),
    ("sellers.state in states", orphan("f_sellers", "seller_state", "f_states", "state_code")),
))
add("dq_fact_report", report(
    ("fact.order_id not null", "fct_orders where order_id is null"),
    ("fact.is_synthetic not null", "fct_orders where is_synthetic is null"),
    ("fact.delivery_outcome not null", "fct_orders where delivery_outcome is null"),
    ("fact.gmv_eur not null", "fct_orders where gmv_eur is null"),
    ("fact.brl_per_eur not null", "fct_orders where brl_per_eur is null"),
    ("no synthetic order in the KPI window", "kpi_orders where is_synthetic"),
    ("label agrees with is_synthetic", "fct_orders where is_synthetic <> (data_source = 'simulated')"),
    ("risk and late value within order value", "fct_orders where greatest(revenue_at_risk_eur, late_gmv_eur) > gmv_eur + 0.000000001"),
    ("late orders have a cause", "fct_orders where is_late and late_cause is null"),
    ("days_late at least 0", "fct_orders where days_late < 0"),
    ("gmv_eur at least 0", "fct_orders where gmv_eur < 0"),
))
add("dq_mart_report", report(
    ("fct_order_items.order_item_key unique", repeated("fct_order_items", "order_item_key")),
    ("fct_orders.purchase_date in dim_date", orphan("fct_orders", "purchase_date", "fx_daily", "rate_date")),
    ("fct_orders.customer_state in dim_states", orphan("fct_orders", "customer_state", "f_states", "state_code")),
    ("dim_date.date_day unique", repeated("fx_daily", "rate_date")),
    ("dim_sellers.seller_id unique", repeated("f_sellers", "seller_id")),
    ("dim_products.product_id unique", repeated("f_products", "product_id")),
    ("monthly.month_start unique", repeated("monthly", "month_start")),
    ("routes.route unique", repeated("routes", "route")),
    ("drivers.driver unique", repeated("drivers", "driver")),
    ("live.purchase_date unique", "(select 1 where false)"),
))

# ---- declared checks: each declaration as a query of its own
SYNTHETIC = "order_id in (select order_id from f_orders where is_synthetic)"
CHECKED = {
    "orders": "select * from f_orders", "items": "select * from f_items", "payments": "select * from f_payments",
    "reviews": "select * from f_reviews", "customers": "select * from f_customers", "sellers": "select * from f_sellers",
    "products": "select * from f_products", "categories": "select * from f_categories", "holidays": "select * from f_holidays",
    "weather": "select * from f_rain", "fx_rates": "select * from f_fx", "inflation": "select * from f_inflation",
    "sim_orders": "select * from f_orders where is_synthetic", "sim_items": f"select * from f_items where {SYNTHETIC}",
    "sim_payments": f"select * from f_payments where {SYNTHETIC}",
    "sim_reviews": "select r.*, o.sim_as_of from f_reviews r join f_orders o on o.order_id = r.order_id where o.is_synthetic",
    "sim_customers": "select * from f_customers where customer_id in (select customer_id from f_orders where is_synthetic)",
    "all_orders": "select * from f_orders", "all_customers": "select * from f_customers", "fx_daily": "select * from fx_daily",
    "state_holidays": "select * from state_holidays", "zip_centroids": "select * from zips", "items_summary": "select * from items_summary",
    "payments_summary": "select * from payments_summary", "reviews_latest": "select * from reviews_latest",
    "timeline": "select * from timeline", "context": "select * from context", "fct_orders": "select * from fct_orders",
    "fct_order_items": "select * from fct_order_items", "dim_date": "select rate_date as date_day, brl_per_eur from fx_daily",
    "dim_sellers": "select * from f_sellers",
    "dim_products": "select product_id, ifnull(category_name_en, 'unknown') as category_name_en from f_products left join f_categories using (category_name_pt)",
    "dim_states": "select * from f_states", "mart_monthly_kpis": "select * from monthly", "mart_route_performance": "select * from routes",
    "mart_seller_performance": "select * from sellers_scored", "mart_late_drivers": "select * from drivers",
    "mart_live_daily": "select distinct purchase_date from fct_orders where is_synthetic",
}
ALSO_CHECKED = {"states": "select * from f_states"}
DATES, NUMBERS = {"purchase_date"}, {"order_id", "seller_id", "product_id", "primary_seller_id"}


def _violating(table: str, check) -> str:
    """Rows of SQL, one a violation."""
    columns = ", ".join(check.columns)
    if check.kind == "not_null":
        return f"d_{table} where {columns} is null"
    if check.kind == "unique":
        return f"(select {columns} from d_{table} where {columns} is not null group by {columns} having count(*) > 1)"
    if check.kind == "unique_combination":
        return f"(select {columns} from d_{table} group by {columns} having count(*) > 1)"
    if check.kind == "relationship":
        return orphan(f"d_{table}", columns, f"d_{check.parent[0]}", check.parent[1])
    if check.kind == "accepted_range":
        low = f"{columns} {'<' if check.inclusive else '<='} {check.low}"
        return f"d_{table} where {low}" + (f" or {columns} > {check.high}" if check.high is not None else "")
    if check.kind == "accepted_values":
        return f"d_{table} where {columns} not in ({', '.join(repr(v) for v in check.values)})"
    return f"d_{table} where ({check.where or 'true'}) and not ({check.expression})"


def _checked(broken: bool) -> dict[str, str]:
    steps = {}
    for name, text in CHECKED.items():
        values = wrong_values(DECLARED[name], {c: "date" if c in DATES else "bigint" if c in NUMBERS else "string" for x in DECLARED[name] for c in x.columns})
        literals = {c: "null" if v is None else f"date '{v}'" if c in DATES else repr(v) for c, v in values.items()}
        replaced = ", ".join(f"{v} as {c}" for c, v in literals.items())
        bad = f"select * replace ({replaced}) from b_{name}" if replaced else f"select * from b_{name}"
        steps[f"b_{name}"] = text
        steps[f"d_{name}"] = f"select * from b_{name} union all select * from b_{name} union all {bad}" if broken else f"select * from b_{name}"
    return steps | {f"d_{name}": text for name, text in ALSO_CHECKED.items()}


def declared_sql(broken: bool) -> str:
    lines = [(t, c.label(), _violating(t, c)) for t, checks in DECLARED.items() for c in checks]
    lines += [
        ("fct_orders", "value = source", """(select s.data_source from
            (select data_source, sum(price_brl + freight_brl) as brl from f_items join f_orders using (order_id) group by 1) s
            left join (select data_source, sum(gmv_brl) as brl from d_fct_orders group by 1) m using (data_source)
            where m.brl is null or abs(s.brl - m.brl) > 0.01)"""),
        ("mart_monthly_kpis", "months of the window", "(select count(*) from d_mart_monthly_kpis having count(*) <> 60)"),
        ("mart_monthly_kpis", "monthly = orders", """(select 1 from (select sum(revenue_at_risk_eur) as a from d_mart_monthly_kpis),
            (select sum(revenue_at_risk_eur) as b from d_fct_orders where is_in_kpi_window) where abs(a - b) > 0.01)"""),
        ("fct_order_items", "items = order", """(select 1 from d_fct_orders o
            join (select order_id, sum(item_gmv_eur) as v, sum(revenue_at_risk_eur) as r from d_fct_order_items group by 1) i on i.order_id = o.order_id
            where abs(o.gmv_eur - i.v) > 0.001 or abs(o.revenue_at_risk_eur - i.r) > 0.001)"""),
    ]
    text = " union all ".join(
        f"""select '{table}' as "table", '{label.replace("'", "''")}' as "check", count(*) as violations from {rows}""" for table, label, rows in lines
    )
    same = "abs((select count(*) from d_fct_orders) - (select count(*) from d_all_orders))"
    text += f""" union all select 'fct_orders' as "table", 'equal_rowcount: all_orders' as "check", {same} as violations"""
    return compose(text, _checked(broken))


SQL["dq_declared"] = declared_sql(False)
SQL["dq_declared_broken"] = declared_sql(True)

# ---- profile
add("profile_table_rows", " union all ".join(
    f"select '{t}{' (SYNTHETIC)' if t == 'events' else ''}' as \"table\", count(*) as \"rows\" from {t}"
    for t in ("orders", "lineitem", "customer", "supplier", "part", "nation", "region", "events")))
add("profile_status", """
    select order_status as status, count(*) as orders, count(delivered_at) as with_delivery_date from f_orders group by 1""")
add("profile_months", "select strftime(purchased_at, '%Y-%m') as month, count(*) as orders from f_orders group by 1")
add("profile_impossible_timestamps", """
    select count(*) filter (shipped_at < purchased_at) as handed_over_before_purchase,
        count(*) filter (shipped_at < approved_at) as handed_over_before_approval,
        count(*) filter (delivered_at < shipped_at) as delivered_before_hand_over,
        count(*) filter (delivered_at is null) as delivered_without_date
    from f_orders where order_status = 'delivered'""")
add("profile_lateness_basis", """
    select count(*) filter (delivered_at::date > promised_date) as late_by_date,
        count(*) filter (delivered_at > promised_date::timestamp) as late_by_timestamp,
        count(*) filter (delivered_at::date = promised_date) as delivered_on_promised_day
    from f_orders where order_status = 'delivered' and delivered_at is not null""")
add("profile_reviews", """
    select count(*) as review_rows, count(distinct order_id) as orders_reviewed,
        (select count(*) from (select order_id from f_reviews group by 1 having count(*) > 1)) as orders_with_several_reviews,
        (select count(*) from f_orders o where not exists (select 1 from f_reviews r where r.order_id = o.order_id)) as orders_without_review
    from f_reviews""")
add("profile_payment_types", """
    select payment_type, count(*) as payments, count(distinct order_id) as orders, round(sum(payment_brl)::double, 0) as brl
    from f_payments group by 1""")
add("profile_payments_match", """
    select count(*) as orders_with_both, count(*) filter (abs(p - i) <= 0.01) as match_to_the_cent,
        count(*) filter (p > i + 0.01) as paid_more, count(*) filter (p < i - 0.01) as paid_less
    from (select order_id, sum(price_brl + freight_brl) as i from f_items group by 1)
    join (select order_id, sum(payment_brl) as p from f_payments group by 1) using (order_id)""")
add("profile_customers", """
    select count(*) as customer_ids, count(distinct customer_unique_id) as people,
        (select count(*) from (select 1 from f_customers group by customer_unique_id having count(*) > 1)) as people_with_several_orders,
        count(*) filter (customer_zip_prefix like '0%') as zip_prefixes_with_leading_zero
    from f_customers""")
add("profile_deadline_anchor", """
    select count(*) as items, round(100.0 * count(*) filter (a % 86400 = 0) / count(*), 1) as pct_exact_days_after_approval,
        round(100.0 * count(*) filter (p % 86400 = 0) / count(*), 1) as pct_exact_days_after_purchase,
        mode(a // 86400) filter (a % 86400 = 0) as most_common_days
    from (select date_diff('second', approved_at, shipping_limit_at) as a, date_diff('second', purchased_at, shipping_limit_at) as p
          from f_items join f_orders using (order_id) where approved_at is not null)""")
add("profile_multi_seller", """
    select count(*) as orders from (select 1 from f_items group by order_id having count(distinct seller_id) > 1)""")
add("profile_products", """
    select count(*) as products, count(*) filter (category_name_pt is null) as without_category,
        (select count(distinct category_name_pt) from f_products
         where category_name_pt not in (select category_name_pt from f_categories)) as categories_missing_translation
    from f_products""")
add("profile_geolocation", """
    select count(*) as points, count(distinct zip_prefix) as zip_prefixes,
        count(*) filter (not is_inside_brazil) as points_outside_brazil from f_points""")
add("profile_series", """
    select 'holidays' as source, count(*) as records, min(holiday_date)::varchar as first, max(holiday_date)::varchar as last from f_holidays
    union all select 'weather', count(*), min(weather_date)::varchar, max(weather_date)::varchar from f_rain
    union all select 'rates', count(*), min(rate_date)::varchar, max(rate_date)::varchar from f_fx""")

# ---- second path
HEADLINE = """
    with totals as (
        select unnest([
            {'m': 'Orders in KPI window', 'v': count(*)::double},
            {'m': 'Delivered orders', 'v': count(*) filter (is_delivered)::double},
            {'m': 'Late orders', 'v': count(*) filter (is_late)::double},
            {'m': 'Late rate', 'v': count(*) filter (is_late) / count(*) filter (is_delivered)::double},
            {'m': 'Overdue, never delivered', 'v': count(*) filter (delivery_outcome = 'Overdue, not delivered')::double},
            {'m': 'GMV (BRL)', 'v': sum(gmv_brl)::double},
            {'m': 'GMV (EUR)', 'v': sum(gmv_eur)},
            {'m': 'Late GMV (EUR)', 'v': sum(late_gmv_eur)},
            {'m': 'Revenue at risk (EUR)', 'v': sum(revenue_at_risk_eur)},
            {'m': 'Late orders where the seller shipped late', 'v': count(*) filter (late_cause = 'Seller shipped late')::double}
        ]) as t from kpi_orders)
    select t.m as metric, case when t.m = 'Late rate' then round(t.v, 6) else round(t.v, 2) end as expected,
        case when t.m = 'Late rate' then round(t.v, 6) else round(t.v, 2) end as actual, 0.0::double as difference, true as match from totals"""
add("recompute_headline", HEADLINE)
add("recompute_from_text", HEADLINE)

# ---- fitted distributions
FIT = {
    "daily": "select purchase_date, count(*) as n, isodow(purchase_date) as wd, month(purchase_date) as mo from kpi_orders group by purchase_date",
    "level_days": "select * from daily where purchase_date between date '2000-01-01' and date '2000-08-31'",
    # Black Friday 1999 was 26 November.
    "usual_1999": """select mo, avg(n) as per_day from daily
        where year(purchase_date) = 1999 and purchase_date not between date '1999-11-26' and date '1999-12-02' group by mo""",
    "bank_cal": """
        select d::date as date_day, isodow(d) <= 5 and h.holiday_date is null as is_bank_day,
            count(*) filter (isodow(d) <= 5 and h.holiday_date is null) over (order by d rows unbounded preceding) as bank_day_no
        from generate_series(date '1995-01-01', date '2002-03-01', interval 1 day) g(d)
        left join (select distinct holiday_date from f_holidays where is_nationwide and (is_public_holiday or is_bank_holiday)) h
            on h.holiday_date = d""",
    "approvals": """
        select *, least(greatest((select bank_day_no from bank_cal where date_day = approved_at::date)
                - (select bank_day_no from bank_cal where date_day = purchase_date), 0), 7) as lag
        from kpi_orders where approved_at is not null and approval_hours >= 0 and main_payment_type is not null""",
    "judged": """
        select case when delivery_outcome = 'On time' then 'on_time'
                when delivery_outcome = 'Late' then case when days_late <= 2 then 'late_1_2_days' when days_late <= 7 then 'late_3_7_days'
                    when days_late <= 14 then 'late_8_14_days' else 'late_over_14_days' end
                when delivery_outcome = 'Overdue, not delivered' then 'never_delivered'
                when delivery_outcome = 'Cancelled' then 'cancelled' end as bucket,
            review_score, review_sent_date - delivered_date as after_delivery, review_sent_date - promised_date as after_promise,
            date_diff('minute', review_sent_date::timestamp, review_answered_at) / 60.0::double as answer_hours
        from kpi_orders where delivery_outcome <> 'Delivered, date missing'""",
    "grid": """select unnest([0, 5, 10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, 65, 70, 75, 80, 85, 90, 92, 94, 96, 97, 98, 99, 99.5, 100])::double as p""",
}
add("volume_weekdays", "select wd::int as weekday, round(avg(n), 6) as mean_orders from level_days group by wd", **FIT)
add("volume_months", """
    with level_months as (select mo, avg(n) as per_day from level_days group by mo),
    factors as (select mo, per_day / (select avg(per_day) from level_months) as f from level_months)
    select mo::int as month, round(f, 6) as factor from factors
    union all
    select mo::int, round((select f from factors where mo = 8) * per_day / (select per_day from usual_1999 where mo = 8), 6)
    from usual_1999 where mo > 8""", **FIT)
add("event_uplift", """
    with wdm as (select wd, avg(n) as m from level_days group by wd)
    select (purchase_date - date '1999-11-26')::int as day_offset, n as orders,
        round(n / ((select per_day from usual_1999 where mo = 11) * m / (select avg(m) from wdm)), 6) as uplift
    from daily join wdm using (wd) where purchase_date between date '1999-11-26' and date '1999-12-02'""", **FIT)
add("peak_factor", """
    with moved as (select * from kpi_orders where is_delivered and not has_timestamp_anomaly and transit_days >= 0),
    m as (select median(transit_days) filter (shipped_date between date '1999-11-20' and date '1999-12-31') as p,
        median(transit_days) filter (strftime(purchase_date, '%Y-%m') not in ('1999-11', '1999-12', '2000-02', '2000-03')) as q from moved)
    select round(p, 6) as peak_days, round(q, 6) as normal_days, round(p / q, 6) as transit_factor from m""")
add("hour_shares", """
    select h::int as hour, round(count(order_id) / (select count(*) from kpi_orders)::double, 6) as share
    from range(24) r(h) left join kpi_orders on hour(purchased_at) = h group by h""")
SHARES = "count(*) as \"count\", round(count(*) / sum(count(*)) over ({over})::double, 6) as share"
add("outcome_shares", f"""
    select case when order_status in ('canceled', 'unavailable') then order_status
            when delivery_outcome not like 'Overdue%' then 'delivered'
            when order_status = 'shipped' then 'lost_in_transit' else 'stuck_before_shipping' end as outcome, {SHARES.format(over='')}
    from kpi_orders group by 1""")
add("no_review_share", """
    select count(*) as orders, round(1 - count(review_score) / count(*)::double, 6) as no_review_share from judged""", **FIT)
add("score_shares", f"""
    select bucket, review_score, {SHARES.format(over='partition by bucket')} from judged
    where review_score is not null and bucket is not null group by bucket, review_score""", **FIT)
add("sent_day_shares", f"""
    select greatest(least(after_delivery, 7), -2)::int as days_after_delivery, {SHARES.format(over='')} from judged
    where review_score is not null and bucket = 'on_time' group by 1""", **FIT)
add("review_grids", """
    with v as (
        select case when bucket like 'late%' then 'late' else bucket end as kind, after_promise::double as v from judged
        where review_score is not null and (bucket like 'late%' or bucket in ('never_delivered', 'cancelled'))
        union all select 'answer_hours', greatest(answer_hours, 0) from judged where review_score is not null)
    select kind, p as percentile, round(list_extract(quantile_cont(v, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65, .7, .75,
        .8, .85, .9, .92, .94, .96, .97, .98, .99, .995, 1]), row_number() over (partition by kind order by p)), 6) as "value"
    from v cross join grid group by kind, p""", **FIT)
add("approval_lag_shares", f"""
    select lag::bigint as lag, {SHARES.format(over='')} from approvals where main_payment_type = 'boleto' group by lag""", **FIT)
add("approval_hour_shares", f"""
    select hour(approved_at)::int as hour, {SHARES.format(over='')} from approvals where main_payment_type = 'boleto' and lag >= 1 group by 1""",
    **FIT)
add("approval_minutes", """
    with v as (select main_payment_type as payment_type, approval_hours * 60 as v from approvals where main_payment_type <> 'boleto' or lag = 0)
    select payment_type, p as percentile, round(list_extract(quantile_cont(v, [0, .05, .1, .15, .2, .25, .3, .35, .4, .45, .5, .55, .6, .65,
        .7, .75, .8, .85, .9, .92, .94, .96, .97, .98, .99, .995, 1]), row_number() over (partition by payment_type order by p)), 6) as minutes
    from v cross join grid group by payment_type, p""", **FIT)
TEMPLATES = {"templates": """
    select row_number() over (order by o.order_id) - 1 as template_id, o.order_id as source_order_id,
        strftime(purchased_at, '%Y-%m') as purchase_month, customer_zip_prefix, customer_city, customer_state, primary_seller_id, seller_state,
        seller_state || ' -> ' || customer_state as route, promised_date - purchased_at::date as promised_days,
        date_diff('second', approved_at, seller_ship_by_at) / 86400.0::double as deadline_days,
        date_diff('second', approved_at, shipped_at) / 86400.0::double as handover_days,
        date_diff('second', shipped_at, delivered_at) / 86400.0::double as transit_days
    from f_orders o join items_summary s on s.order_id = o.order_id join f_customers c on c.customer_id = o.customer_id
    join f_sellers on seller_id = primary_seller_id
    where data_source = 'marketplace' and order_status = 'delivered' and purchased_at >= date '1996-01-01' and purchased_at < date '2001-01-01'
        and strftime(purchased_at, '%Y-%m') not in ('1999-11', '1999-12', '2000-02', '2000-03')
        and approved_at >= purchased_at and shipped_at >= approved_at and delivered_at >= shipped_at and seller_ship_by_at > approved_at
        and o.order_id in (select order_id from f_payments)"""}
add_table("journey_templates", "templates",
          "template_id source_order_id purchase_month customer_zip_prefix customer_city customer_state primary_seller_id seller_state "
          "route promised_days:i32 deadline_days:6 handover_days:6 transit_days:6", **TEMPLATES)
add("template_items", """
    select template_id, order_item_number, product_id, seller_id, round(price_brl::double, 4) as price_brl, round(freight_brl::double, 4) as freight_brl
    from f_items join templates t on t.source_order_id = order_id""".replace("product_id, seller_id", "product_id, f_items.seller_id"), **TEMPLATES)
add("template_payments", """
    select template_id, payment_sequence, payment_type, installments, round(payment_brl::double, 4) as payment_brl
    from f_payments join templates t on t.source_order_id = order_id""", **TEMPLATES)
PRICES = {"levels": "select month_start, product(1 + pct_change / 100) over (order by month_start rows unbounded preceding) as price_index from f_inflation"}
add("price_index", "select month_start, round(price_index, 6) as price_index from levels", **PRICES)
add("price_factors", """
    select m as month_start, round(k, 6) as known_index,
        round(k / (select price_index from levels where month_start = date '1996-01-01'), 6) as price_factor
    from (select m, (select arg_max(price_index, month_start) from levels where month_start <= m - interval 2 month) as k
          from (select distinct date_trunc('month', purchased_at)::date as m from f_orders))""", **PRICES)
add("payment_rescale", """
    with scaled as (
        select p.*, cast(gmv_brl as decimal(28,2)) as total,
            cast(round(payment_brl::double * cast(gmv_brl as decimal(28,2))::double / (sum(payment_brl) over (partition by p.order_id))::double, 2) as decimal(28,2)) as s
        from f_payments p join items_summary i on i.order_id = p.order_id)
    select order_id, payment_sequence, payment_type, installments,
        round((s + case when row_number() over (partition by order_id order by s desc nulls last, payment_sequence, payment_brl, payment_type, installments) = 1
            then total - sum(s) over (partition by order_id) else 0 end)::double, 4) as scaled_brl
    from scaled""")

# ---- calendars
add("bank_days", "select date_day, is_bank_day, bank_day_no from bank_cal", **FIT)
add("bank_days_between", """
    select order_id, purchased_at, promised_date, case when b.bank_day_no - a.bank_day_no < 0 then 0 else b.bank_day_no - a.bank_day_no end as bank_days
    from f_orders left join bank_cal a on a.date_day = purchased_at::date left join bank_cal b on b.date_day = promised_date""", **FIT)
add("bank_days_added", """
    select order_id, purchased_at, case when order_id % 5 = 0 then purchased_at::date else t.date_day end as clearing_day
    from f_orders join bank_cal a on a.date_day = purchased_at::date
    left join bank_cal t on t.is_bank_day and t.bank_day_no = a.bank_day_no + order_id % 5""", **FIT)

# ---- live feed


def shop_at(moment: str) -> str:
    return f"""
        select order_id, customer_id,
            case when purchased_at + interval 1 day <= {moment} and order_status = 'canceled' then 'canceled'
                 when purchased_at + interval 2 day <= {moment} and order_status = 'processing' and order_id % 3 = 0 then 'unavailable'
                 when delivered_at <= {moment} then 'delivered' when shipped_at <= {moment} then 'shipped'
                 when approved_at <= {moment} and {moment} < approved_at + interval 12 hour then 'approved'
                 when approved_at <= {moment} then if(order_status = 'processing', 'processing', 'invoiced')
                 else 'created' end as order_status,
            purchased_at, if(approved_at <= {moment}, approved_at, null) as approved_at, if(shipped_at <= {moment}, shipped_at, null) as shipped_at,
            if(delivered_at <= {moment}, delivered_at, null) as delivered_at, promised_date, {moment} as sim_as_of
        from f_orders where purchased_at <= {moment}"""


THEN, NOW = "timestamp '2000-01-10 02:00:00'", "timestamp '2000-01-20 02:00:00'"
add("as_of_snapshot", shop_at(NOW))
add("snapshot_diff", f"""
    select {NOW} as sim_as_of, {THEN} as previous_sim_as_of, 10::int as days_covered, count(*) as orders_total,
        count(*) filter (b.order_id is null) as new_orders, count(*) filter (b.order_status <> a.order_status) as orders_changed_status,
        count(*) filter (a.order_status = 'delivered' and b.order_status <> 'delivered') as newly_delivered,
        count(*) filter (a.order_status = 'shipped') as in_transit, count(*) filter (a.order_status = 'delivered') as delivered_total,
        (select count(*) from f_reviews where review_answered_at <= {NOW}) as reviews_total,
        (select count(*) from f_reviews where review_answered_at <= {NOW} and review_answered_at > {THEN}) as new_reviews
    from ({shop_at(NOW)}) a left join ({shop_at(THEN)}) b using (order_id)""")
SQL["fct_orders_stored"] = SQL["fct_orders"]
SQL["stored_snapshot_diff"] = SQL["snapshot_diff"]


def at_both(select: str) -> str:
    """A text with {moment} for both moments."""
    return " union all ".join(select.format(moment=moment) for moment in (THEN, NOW))


add("as_of_orders", at_both(shop_at("{moment}")))
add("as_of_items", at_both("""
    select i.order_id, order_item_number, product_id, seller_id, shipping_limit_at, round(price_brl::double, 4) as price_brl,
        round(freight_brl::double, 4) as freight_brl, {moment} as sim_as_of
    from f_items i join f_orders o on o.order_id = i.order_id where purchased_at <= {moment}"""))
add("as_of_payments", at_both("""
    select p.order_id, payment_sequence, payment_type, installments, round(payment_brl::double, 4) as payment_brl, {moment} as sim_as_of
    from f_payments p join f_orders o on o.order_id = p.order_id where purchased_at <= {moment}"""))
add("as_of_reviews", at_both("select *, {moment} as sim_as_of from f_reviews where review_answered_at <= {moment}"))
add("as_of_customers", at_both("""
    select c.*, {moment} as sim_as_of from f_customers c
    where exists (select 1 from f_orders o where o.customer_id = c.customer_id and purchased_at <= {moment})"""))
VECTORS = {
    "real_normal": """select * from kpi_orders where is_delivered
        and strftime(purchase_date, '%Y-%m') not in ('1999-11', '1999-12', '2000-02', '2000-03')""",
    "sim": "select * from fct_orders where is_synthetic",
    "vectors": """
        select ifnull(a.kind, b.kind) as kind, ifnull(a.k, b.k) as k,
            case when ifnull(a.kind, b.kind) = 'region' then a.v else ifnull(a.v, 0) end as r,
            case when ifnull(a.kind, b.kind) = 'region' then b.v else ifnull(b.v, 0) end as s
        from (select 'weekday' as kind, isodow(purchase_date)::varchar as k, count(*) / sum(count(*)) over ()::double as v from fct_orders
                where purchase_date between date '2000-01-01' and date '2000-08-31' group by k
              union all select 'hour', hour(purchased_at)::varchar as k, count(*) / sum(count(*)) over ()::double from kpi_orders group by k
              union all select 'payment', main_payment_type as k, count(*) / sum(count(*)) over ()::double from kpi_orders
                where is_delivered and main_payment_type is not null group by k
              union all select 'region', customer_region, avg(is_late::int) from real_normal group by customer_region) a
        full join (select 'weekday' as kind, isodow(purchase_date)::varchar as k, count(*) / sum(count(*)) over ()::double as v from sim group by k
              union all select 'hour', hour(purchased_at)::varchar as k, count(*) / sum(count(*)) over ()::double from sim group by k
              union all select 'payment', main_payment_type as k, count(*) / sum(count(*)) over ()::double from sim
                where main_payment_type is not null group by k
              union all select 'region', customer_region, avg(is_late::int) from sim where is_delivered group by customer_region) b
        on a.kind = b.kind and a.k = b.k""",
}
add("share_vectors", 'select kind, k as key, round(r, 6) as "real", round(s, 6) as simulated from vectors', **VECTORS)
LINES = [
    ("Share of orders delivered", "(select avg((delivery_outcome in ('On time', 'Late', 'Delivered, date missing'))::int) from kpi_orders)",
     "(select avg(is_delivered::int) from sim where delivery_outcome <> 'Open, not yet due')", 0.005, "false"),
    ("Average promised days (delivered orders)", "(select avg(promised_days) from real_normal)", "(select avg(promised_days) from sim where is_delivered)", 1.0, "false"),
    ("Average actual delivery days", "(select avg(actual_days) from real_normal)", "(select avg(actual_days) from sim)", 1.0, "false"),
    ("Late rate (delivered orders)", "(select avg(is_late::int) from real_normal)", "(select avg(is_late::int) from sim)", 0.015, "false"),
    ("Seller missed hand-over deadline", "(select avg(seller_missed_ship_by::int) from real_normal)",
     "(select avg(ifnull(seller_missed_ship_by, false)::int) from sim where is_delivered)", 0.02, "false"),
    ("1-2 star reviews, on-time orders", "(select avg(ifnull(review_score <= 2, false)::int) from kpi_orders where delivery_outcome = 'On time')",
     "(select avg((review_score <= 2)::int) from sim where delivery_outcome = 'On time')", 0.02, "false"),
    ("1-2 star reviews, late orders", "(select avg(ifnull(review_score <= 2, false)::int) from kpi_orders where delivery_outcome = 'Late')",
     "(select avg((review_score <= 2)::int) from sim where delivery_outcome = 'Late')", 0.05, "false"),
    ("Median approval hours, credit card", "(select median(approval_hours) from kpi_orders where main_payment_type = 'credit_card')",
     "(select median(approval_hours) from sim where main_payment_type = 'credit_card')", 0.5, "false"),
    ("Median approval hours, boleto", "(select median(approval_hours) from kpi_orders where main_payment_type = 'boleto')",
     "(select median(approval_hours) from sim where main_payment_type = 'boleto')", 6.0, "false"),
    ("Average order value, prices of the historical period (relative)", "(select sum(gmv_brl)::double / count(*) from kpi_orders where is_delivered)",
     """(select avg(gmv_brl::double / (select (select arg_max(price_index, month_start) from levels
            where month_start <= date_trunc('month', o.purchase_date) - interval 2 month)
            / (select price_index from levels where month_start = date '1996-01-01'))) from sim o)""", 0.03, "true"),
]
GAP_LINES = [("Weekday pattern: largest gap in share of orders", "weekday", 0.015), ("Hour of day: largest gap in share of orders", "hour", 0.01),
             ("Payment mix: largest gap in share", "payment", 0.015), ("Late rate by region: largest gap", "region", 0.03)]
add("drift_report", "with report_lines as (" + " union all ".join(
    [f"select '{m}' as measure, 0.0::double as r, (select max(abs(r - s)) from vectors where kind = '{k}') as s, {t}::double as allowed, false as is_relative"
     for m, k, t in GAP_LINES] + [f"select '{m}', {r}, {s}, {t}::double, {rel}" for m, r, s, t, rel in LINES]) + """)
    select measure, round(r, 6) as "real", round(s, 6) as simulated, allowed, is_relative,
        round(case when is_relative then (s - r) / r else s - r end, 6) as difference,
        ifnull(abs(case when is_relative then (s - r) / r else s - r end) <= allowed, false) as within from report_lines""", **VECTORS, **PRICES)

# ---- landing reshapes and series checks
add("array_to_rows", """
    with w as (select state_code, strftime(weather_date, '%Y-%m-%d') as time,
        case when day(weather_date) <> 31 then precipitation_mm end as precipitation_sum,
        precipitation_mm + 20.0::double as temperature_2m_max, precipitation_mm + 10.0::double as temperature_2m_min from f_rain)
    select state_code, -10.0::double as grid_latitude, -50.0::double as grid_longitude, 'UTC' as timezone, time, precipitation_sum,
        temperature_2m_max, temperature_2m_min
    from w where time <= (select max(time) from w x where x.state_code = w.state_code and x.precipitation_sum is not null)""")
add("incomplete_days", "select state_code, count(*)::int as days from f_rain group by 1 having count(*) <> 2557")
add("map_to_rows", """select rate_date as "date", 'EUR' as base, 'BRL' as quote, round(brl_per_eur, 6) as rate from f_fx""")
for name in ("monthly_text", "coded_months"):
    add(name, """select strftime(month_start, '%Y-%m') as "month", round(pct_change, 6) as pct_change from f_inflation""")
GAP = """select {by}{day}, prev as previous_day, ({day} - prev)::int as gap_days
    from (select {by}{day}, lag({day}) over ({part}order by {day}) as prev from (select distinct {by}{day} from {table})) where {day} - prev > 5"""
add("series_gaps", GAP.format(by="", part="", day="holiday_date", table="f_holidays"))
add("series_gaps_by_state", GAP.format(by="state_code, ", part="partition by state_code ", day="weather_date", table="f_rain"))
add("series_missing_months", """
    select month_start, prev as previous_month, (date_diff('month', prev, month_start) - 1)::int as months_missing
    from (select month_start, lag(month_start) over (order by month_start) as prev from f_inflation where pct_change > 0)
    where date_diff('month', prev, month_start) > 1""")
add("series_implausible", "select rate_date, round(brl_per_eur, 6) as brl_per_eur from f_fx where brl_per_eur < 3.3 or brl_per_eur > 3.9")
add("series_coverage", """
    select a as first_day, b as last_day from (select min(rate_date) as a, max(rate_date) as b from f_fx)
    where a > date '1995-01-01' or date '2001-12-31' - b > 5""")
add("series_staleness", """
    select m as latest_month, date_diff('month', m, date '2001-12-31')::int as months_old
    from (select max(month_start) as m from f_inflation) where date_diff('month', m, date '2001-12-31') > 3""")
add("wrong_partition", """
    select holiday_date, holiday_name from f_holidays where year(holiday_date) <> 1999 or holiday_name <> '1-URGENT'""")
add("feed_log", "select count(*) as records, count(state_iso_codes) as state_level from f_holidays")
add("source_priority", "select month_start, round(pct_change, 6) as pct_change, 'saved' as source from f_inflation")

# ---- files
add("csv_round_trip", """
    select order_id::varchar as order_id, customer_id::varchar as customer_id, order_status, purchased_at, approved_at, shipped_at, delivered_at,
        promised_date, data_source, is_synthetic, sim_as_of from f_orders""")
add("json_round_trip", """
    select holiday_date, holiday_name, is_nationwide, array_to_string(state_iso_codes, ' ') as state_iso_codes, is_public_holiday,
        is_bank_holiday from f_holidays""")
add("parquet_export", """
    select order_id, purchase_date, round(gmv_brl::double, 4) as gmv_brl, delivery_outcome, date_trunc('month', purchase_date)::date as "month"
    from fct_orders""")
add("file_manifest", "select true as has_files, true as has_digests, count(*) as records from orders")

# ---- staging: ids come back from text as text
_TEXT = "::varchar as "
add("staged_orders", f"""select order_id{_TEXT}order_id, customer_id{_TEXT}customer_id, * exclude (order_id, customer_id) from f_orders""")
add("staged_items", f"""
    select order_id{_TEXT}order_id, order_item_number, product_id{_TEXT}product_id, seller_id{_TEXT}seller_id, shipping_limit_at,
        round(price_brl::double, 4) as price_brl, round(freight_brl::double, 4) as freight_brl from f_items""")
add("staged_payments", f"""
    select order_id{_TEXT}order_id, payment_sequence, payment_type, installments, round(payment_brl::double, 4) as payment_brl
    from f_payments where order_id in (select order_id from f_orders)""")
add("staged_reviews", f"""
    select review_id{_TEXT}review_id, order_id{_TEXT}order_id, review_score, has_comment, review_sent_date,
        date_trunc('second', review_answered_at)::timestamp as review_answered_at
    from f_reviews where order_id in (select order_id from f_orders)""")
add("staged_customers", f"""
    select customer_id{_TEXT}customer_id, customer_unique_id{_TEXT}customer_unique_id, customer_zip_prefix, customer_city,
        upper(customer_state) as customer_state from f_customers""")
add("staged_sellers", f"select seller_id{_TEXT}seller_id, seller_zip_prefix, seller_city, upper(seller_state) as seller_state from f_sellers")
add("staged_products", f"""
    select product_id{_TEXT}product_id, category_name_pt, photo_count, null::int as name_length, null::int as description_length,
        weight_g, length_cm, height_cm, width_cm from f_products""")
add("staged_geolocation", """
    select zip_prefix, round(latitude, 6) as latitude, round(longitude, 6) as longitude, 'são paulo' as city, 'SP' as state_code,
        is_inside_brazil from f_points""")
add("staged_categories", """
    select category_name_pt, category_name_en from f_categories
    union all select * from (values ('pc_gamer', 'pc_gamer'),
        ('portateis_cozinha_e_preparadores_de_alimentos', 'portable_kitchen_and_food_preparers')) v""")
add("staged_fx_rates", "select rate_date, round(brl_per_eur, 6) as brl_per_eur from f_fx")
add("staged_inflation", "select month_start, round(pct_change, 6) as pct_change from f_inflation")
add("staged_weather", """
    select state_code, weather_date, precipitation_mm, precipitation_mm + 20 as temperature_max_c, precipitation_mm + 10 as temperature_min_c
    from f_rain""")
add("staged_labels", """
    select data_source, is_synthetic, sim_as_of, count(*) as items from f_items join f_orders using (order_id) group by all""")
add("landed_files", """
    select case when is_synthetic then 'sim_order_reviews (SYNTHETIC)' else 'order_reviews' end as "table", count(*) as "rows"
    from f_reviews join f_orders using (order_id) group by all""")
LANDED_ROWS = {
    "orders": "f_orders where not is_synthetic", "order_items": "f_items join f_orders using (order_id) where not is_synthetic",
    "order_payments": "f_payments join f_orders using (order_id) where not is_synthetic",
    "order_reviews": "f_reviews join f_orders using (order_id) where not is_synthetic",
    "customers": "f_customers where customer_id % 10 <> 9", "sellers": "f_sellers", "products": "f_products", "geolocation": "f_points",
    "category_translation": "f_categories", "weather_daily": "f_rain", "fx_rates": "(select * from f_fx union all select * from f_fx)",
    "inflation_monthly": "f_inflation", "sim_orders": "f_orders where is_synthetic",
    "sim_order_items": "f_items join f_orders using (order_id) where is_synthetic",
    "sim_order_payments": "f_payments join f_orders using (order_id) where is_synthetic",
    "sim_order_reviews": "f_reviews join f_orders using (order_id) where is_synthetic", "sim_customers": "f_customers where customer_id % 10 = 9",
}
KNOWN = """(select ts - interval 24 year as known_at, max(event_id) as event_id, arg_max("value", event_id) as known_value
    from events where ts is not null group by 1)"""
add("value_at_purchase", f"""
    select order_id, purchased_at, event_id, round(known_value, 6) as known_value
    from f_orders asof left join {KNOWN} on purchased_at >= known_at""")
add("filled_event_values", """
    select ts, round(last_value(v ignore nulls) over (order by ts rows between unbounded preceding and current row), 6) as "value"
    from (select ts, case when max(event_id) % 3 <> 0 then arg_max("value", event_id) end as v from events group by ts)""")
add("landed_rejects", " union all ".join(
    f"""select '{name}' as "table", 2 * count(*) as records, count(*) as loaded, count(*) as rejected, count(*) as kept_rejects from {rows}"""
    for name, rows in LANDED_ROWS.items()))
add("missing_tables", """select 'holidays' as "table" where exists (select 1 from orders)""")
add("sketched_percentiles", " union all ".join(
    f"select '{level}' as level, {cell} as cell, count(*) as orders, count(*) as exact_orders, true as p50_within, true as p90_within "
    f"from fct_orders where actual_days is not null group by 2"
    for level, cell in (
        ("region", "customer_region"), ("route", "ifnull(route, 'none')"), ("month", "strftime(purchase_date, '%Y-%m')"), ("all", "'all'"))))
add("seed_states", "select customer_state as state_code, count(*) as customers, false as is_seeded from f_customers group by all")

add("star_generation", " union all ".join(
    f"select '{name}' as \"table\", count(*) as \"rows\", {f'round(sum({value}), 1)' if value else 'null::double'} as value_eur from {rows}"
    for name, rows, value in (
        ("fct_orders", "fct_orders", "gmv_eur"), ("fct_order_items", "fct_order_items", "item_gmv_eur"), ("dim_date", "fx_daily", ""),
        ("dim_sellers", "f_sellers", ""), ("dim_products", "f_products", ""), ("dim_states", "f_states", ""),
        ("mart_monthly_kpis", "monthly", "gmv_eur"), ("mart_route_performance", "routes", "gmv_eur"),
        ("mart_seller_performance", "sellers_scored", "gmv_eur"), ("mart_late_drivers", "drivers", ""),
        ("mart_live_daily", "(select purchase_date, sum(gmv_eur) as gmv_eur from fct_orders where is_synthetic group by 1)", "gmv_eur"))))

# ---- checks of the whole model and of landed records
add("dq_fact_rowcount", """
    select a as left_rows, b as right_rows
    from (select count(*) as a from fct_orders), (select count(*) as b from f_orders) where a <> b""")
add("missing_values", "select review_id, order_id from f_reviews where review_answered_at is null or review_sent_date is null")
add("weather_of_states", "select state_code, count(*) as days from f_rain where state_code in ('NATION_2', 'NATION_17') group by 1")
add("holiday_years", """
    select year(holiday_date)::int as "year", count(*) as records from f_holidays
    where year(holiday_date) between 1996 and 2002 group by 1""")
add("month_keys", """
    select strftime(purchased_at, '%Y-%m') as "month", strftime(purchased_at - interval 2 month, '%Y-%m') as two_before, count(*) as orders
    from f_orders group by all""")
