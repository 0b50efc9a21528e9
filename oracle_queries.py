"""Independent SQL for the named queries, over the plain parquet tables.

Written by hand in the direct form (nested windows, range joins, unions), not derived from the
DataFrame code. ``_sql`` puts the needed building blocks in front and makes types comparable.
"""

from __future__ import annotations

import re

# Building blocks --------------------------------------------------------------------------------

_PARTS = {
    "ord": """
        select o_orderkey as order_id, o_custkey as user_id,
            case o_orderstatus when 'F' then 'prior' when 'O' then 'train' when 'P' then 'test' end as eval_set,
            cast(row_number() over seq as integer) as order_number,
            cast(dayofweek(o_orderdate) as integer) as order_dow,
            cast(o_orderkey % 24 as integer) as order_hour_of_day,
            cast(floor(date_diff('day', cast(lag(o_orderdate) over seq as date), cast(o_orderdate as date)) / 10)
                as double) as days_since_prior_order,
            cast(o_orderdate as date) as order_date
        from orders window seq as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "li": """
        select l_orderkey || '-' || l_partkey as order_product_id, l_orderkey as order_id,
            l_partkey as product_id, l_linenumber as add_to_cart_order,
            case when l_returnflag = 'R' then 1 else 0 end as reordered
        from lineitem""",
    "prod": """
        select p_partkey as product_id, p_name as product_name,
            cast('0x' || substr(md5(p_type), 1, 7) as integer) as aisle_id, p_type as aisle,
            cast('0x' || substr(md5(p_brand), 1, 7) as integer) as department_id, p_brand as department
        from part""",
    "fact": """
        select ord.* exclude (order_date), coalesce(b.n, 0) as item_count,
            cast(coalesce(b.r, 0) as bigint) as reordered_item_count,
            b.lo as first_cart_position, b.hi as last_cart_position
        from ord left join (
            select order_id, count(*) as n, sum(reordered) as r, min(add_to_cart_order) as lo,
                max(add_to_cart_order) as hi
            from li group by all) b using (order_id)""",
    "dimp": """
        select prod.*, (select count(*) from li where li.product_id = prod.product_id) as order_line_count,
            cast((select coalesce(sum(reordered), 0) from li where li.product_id = prod.product_id) as bigint)
                as reordered_line_count
        from prod""",
    "cust": """
        select user_id, count(distinct order_id) as order_count, min(order_number) as first_order_number,
            max(order_number) as last_order_number, min(order_dow) as first_observed_order_dow,
            max(order_dow) as last_observed_order_dow, avg(order_dow) as avg_order_dow,
            avg(order_hour_of_day) as avg_order_hour_of_day,
            avg(days_since_prior_order) as avg_days_since_prior_order,
            count(*) filter (eval_set = 'prior') as prior_order_count,
            count(*) filter (eval_set = 'train') as train_order_count,
            count(*) filter (eval_set = 'test') as test_order_count
        from ord where user_id is not null group by all""",
    "users": """
        select user_id, count(distinct order_id) as order_count,
            count(*) filter (item_count > 0) as observed_basket_orders,
            min(order_number) as first_order_number, max(order_number) as latest_order_number,
            coalesce(avg(days_since_prior_order), 0.0::double) as avg_days_since_prior_order,
            coalesce(stddev_samp(days_since_prior_order), 0.0::double) as stddev_days_since_prior_order,
            coalesce(sum(days_since_prior_order), 0.0::double) as customer_tenure_days,
            coalesce(max(days_since_prior_order), 0.0::double) as max_days_since_prior_order,
            avg(order_dow) as avg_order_dow, avg(order_hour_of_day) as avg_order_hour_of_day,
            avg(if(order_dow in (0, 6), 1, 0)) as weekend_order_ratio,
            avg(if(order_hour_of_day >= 18 or order_hour_of_day < 6, 1, 0)) as evening_order_ratio,
            cast(sum(item_count) as bigint) as total_items_ordered,
            cast(sum(reordered_item_count) as bigint) as total_reordered_items,
            coalesce(sum(reordered_item_count) / nullif(sum(item_count), 0), 0.0::double) as reorder_item_ratio,
            coalesce(30.0::double * count(distinct order_id) / nullif(sum(days_since_prior_order), 0),
                count(distinct order_id)::double) as order_frequency_30d,
            case when count(distinct order_id) < 10 then 'low_frequency'
                when count(distinct order_id) < 25 then 'medium_frequency' else 'high_frequency' end
                as customer_frequency_segment
        from fact group by user_id""",
    "bought": """
        select fact.user_id, fact.order_id, fact.order_number, prod.product_id,
            lower(coalesce(department, 'unknown')) as department, lower(coalesce(aisle, 'unknown')) as aisle
        from li join fact using (order_id) join prod using (product_id)""",
    "breadth": """
        select user_id, count(distinct product_id) as unique_products,
            count(distinct department) as unique_departments, count(distinct aisle) as unique_aisles,
            avg(if(department = 'brand#1', 1, 0)) as produce_item_ratio,
            avg(if(department = 'brand#2', 1, 0)) as dairy_eggs_item_ratio,
            avg(if(aisle = 'economy', 1, 0)) as fresh_fruits_item_ratio,
            avg(if(aisle = 'promo', 1, 0)) as fresh_vegetables_item_ratio
        from bought group by user_id""",
    "feat": """
        select u.user_id, u.order_count as total_orders, u.observed_basket_orders,
            coalesce(x.basket, 0.0::double) as avg_basket_size,
            coalesce(x.basket_sd, 0.0::double) as stddev_basket_size,
            if(u.total_items_ordered > 0,
                (u.total_reordered_items + 0.5) / (u.total_items_ordered + 1), 0)::double as reorder_ratio,
            x.with_reorder as reorder_order_ratio,
            coalesce(breadth.unique_products, 0) as unique_products,
            coalesce(breadth.unique_departments, 0) as unique_departments,
            coalesce(breadth.unique_aisles, 0) as unique_aisles,
            coalesce(breadth.produce_item_ratio, 0.0::double) as produce_item_ratio,
            coalesce(breadth.dairy_eggs_item_ratio, 0.0::double) as dairy_eggs_item_ratio,
            coalesce(breadth.fresh_fruits_item_ratio, 0.0::double) as fresh_fruits_item_ratio,
            coalesce(breadth.fresh_vegetables_item_ratio, 0.0::double) as fresh_vegetables_item_ratio,
            u.avg_days_since_prior_order as days_between_orders,
            u.stddev_days_since_prior_order as stddev_days_between_orders, u.customer_tenure_days,
            u.max_days_since_prior_order as max_days_between_orders, u.avg_order_dow, u.avg_order_hour_of_day,
            u.weekend_order_ratio, u.evening_order_ratio, x.dows as active_order_dow_count,
            u.observed_basket_orders / u.order_count as observed_basket_coverage, u.order_frequency_30d,
            if(u.total_reordered_items > 0, 1, 0) as will_reorder
        from users u
        join (select user_id, avg(item_count) filter (item_count <> 0) as basket,
                stddev_samp(item_count) filter (item_count <> 0) as basket_sd,
                avg(if(reordered_item_count > 0, 1, 0)) as with_reorder, count(distinct order_dow) as dows
              from fact group by user_id) x using (user_id)
        left join breadth using (user_id)""",
    "churn_exact": """
        select user_id, total_orders, avg_basket_size, reorder_ratio, unique_products, days_between_orders,
            least(95, greatest(5, 50 + if(total_orders <= 2, 20, -10) + if(reorder_ratio < 0.20::double, 20, -15)
                + if(days_between_orders > 14, 20, -5) + if(unique_products <= 5, 10, -5))) as points
        from feat""",
    "churn": """
        select * exclude (points), points / 100 as churn_probability,
            case when points < 40 then 'low' when points < 70 then 'medium' else 'high' end as churn_risk_segment
        from churn_exact""",
    "clv": """
        select *, historical_value_proxy + predicted_future_value_proxy as customer_lifetime_value_proxy
        from (
            select churn.*, total_orders * avg_basket_size as historical_value_proxy,
                avg_basket_size * greatest(1, total_orders * (1 - churn_probability)) as predicted_future_value_proxy
            from churn)""",
    "clv_seg": """
        select *, case when customer_lifetime_value_proxy < 150 then 'emerging'
            when customer_lifetime_value_proxy < 500 then 'growth' else 'high_value' end as value_segment
        from clv""",
    "cohort_of": "select user_id, min(order_number) as c from fact group by user_id",
    "cohorts": """
        select c as cohort_order_number, order_number - c as cohort_period,
            (select count(*) from cohort_of k where k.c = cohort_of.c) as cohort_size,
            count(distinct user_id) as active_users, count(distinct order_id) as orders_count,
            cast(sum(item_count) as bigint) as revenue_proxy,
            count(distinct user_id) / (select count(*) from cohort_of k where k.c = cohort_of.c) as retention_rate
        from fact join cohort_of using (user_id) group by c, order_number""",
    "behave": """
        select feat.*, case
            when observed_basket_coverage < 0.05 then 'limited_basket_detail'
            when reorder_ratio >= 0.60::double and total_orders >= 25 then 'loyal_reorder'
            when days_between_orders >= 21 or reorder_ratio < 0.25::double then 'at_risk_customer'
            when unique_products >= 15 then 'product_explorer' else 'steady_customer' end as customer_segment
        from feat""",
    "sampled": """
        select * from (select *, cast(row_number() over (partition by customer_segment
            order by md5(cast(user_id as varchar)), user_id) as integer) as segment_sample_rank from behave)
        where segment_sample_rank <= 50""",
    "latest_cohorts": """
        select cohort_order_number, cohort_period, cohort_size, active_users, retention_rate, revenue_proxy
        from cohorts order by cohort_order_number desc, cohort_period limit 50""",
    "trend": """
        select order_number, count(*) as total_orders, avg(item_count) as avg_basket_size,
            avg(reordered_item_count / nullif(item_count, 0)) as reorder_ratio
        from fact group by order_number order by order_number desc limit 20""",
    "top20": """
        select product_id, product_name, department, aisle, order_line_count, reordered_line_count,
            reordered_line_count / nullif(order_line_count, 0) as reorder_ratio
        from dimp order by order_line_count desc, product_id limit 20""",
    "churn_groups": """
        select churn_risk_segment, count(*) as users, avg(churn_probability) as avg_churn_probability,
            avg(total_orders) as avg_total_orders, avg(avg_basket_size) as avg_basket_size,
            avg(reorder_ratio) as avg_reorder_ratio, avg(unique_products) as avg_unique_products,
            avg(days_between_orders) as avg_days_between_orders
        from churn group by churn_risk_segment""",
    "order_groups": """
        select case when total_orders >= {a} then 'power_customers_80_plus_orders'
                when total_orders >= {b} then 'frequent_customers_40_to_79_orders'
                when total_orders >= {c} then 'developing_customers_10_to_39_orders'
                else 'low_frequency_customers_under_10_orders' end as customer_segment,
            count(*) as users, avg(total_orders) as avg_total_orders, avg(avg_basket_size) as avg_basket_size,
            avg(reorder_ratio) as avg_reorder_ratio, avg(unique_products) as avg_unique_products,
            avg(days_between_orders) as avg_days_between_orders,
            max(days_between_orders) as max_days_between_orders
        from feat group by 1""",
    "checks": """
        select 'raw_orders' as table_name, 'order_id_not_null' as check_name,
            (select count(*) from orders where o_orderkey is null) as invalid_count
        union all select 'raw_orders', 'order_id_unique',
            (select count(*) from (select 1 from orders group by o_orderkey having count(*) > 1))
        union all select 'raw_products', 'product_id_not_null',
            (select count(*) from part where p_partkey is null)
        union all select 'raw_products', 'product_id_unique',
            (select count(*) from (select 1 from part group by p_partkey having count(*) > 1))
        union all select 'raw_order_products', 'order_id_not_null',
            (select count(*) from lineitem where l_orderkey is null)
        union all select 'raw_order_products', 'product_id_not_null',
            (select count(*) from lineitem where l_partkey is null)
        union all select 'raw_order_products', 'order_product_unique',
            (select count(*) from (select 1 from lineitem group by l_orderkey, l_partkey having count(*) > 1))
        union all select 'raw_order_products', 'product_id_valid',
            (select count(*) from lineitem where l_partkey is not null
                and not exists (select 1 from part where p_partkey = l_partkey))""",
    # Training history, in the direct form: windows for the orders, a range join for the products.
    "line_days": """
        select *, coalesce(days_since_prior_order, 0) as gap,
            sum(coalesce(days_since_prior_order, 0)) over (partition by user_id order by order_number)
                as customer_day_number,
            if(order_dow in (0, 6), 1, 0) as wk, if(order_hour_of_day >= 18 or order_hour_of_day < 6, 1, 0) as ev,
            if(reordered_item_count > 0, 1, 0) as rr
        from fact""",
    "windows": """
        select *, count(*) over past as total_orders,
            count(*) filter (item_count > 0) over past as observed_basket_orders,
            coalesce(avg(nullif(item_count, 0)) over past, 0.0::double) as avg_basket_size,
            coalesce(sum(reordered_item_count) over past / nullif(sum(item_count) over past, 0), 0.0::double)
                as reorder_ratio,
            coalesce(sum(rr) over past / nullif(count(*) over past, 0), 0.0::double) as prior_reorder_order_ratio,
            coalesce(avg(gap) over past, 0.0::double) as days_between_orders,
            coalesce(stddev_samp(gap) over past, 0.0::double) as stddev_days_between_orders,
            gap as days_since_last_order, coalesce(sum(gap) over past, 0.0::double) as customer_tenure_days,
            count(*) over (partition by user_id order by customer_day_number
                range between 30 preceding and 1 preceding) as order_frequency_30d,
            coalesce(avg(order_dow) over past, 0.0::double) as avg_order_dow,
            coalesce(avg(order_hour_of_day) over past, 0.0::double) as avg_order_hour_of_day,
            coalesce(avg(wk) over past, 0.0::double) as weekend_order_ratio,
            coalesce(avg(ev) over past, 0.0::double) as evening_order_ratio
        from line_days
        window past as (partition by user_id order by order_number rows between unbounded preceding and 1 preceding)""",
    "met": """
        select t.user_id, t.order_id, count(distinct b.product_id) as unique_products,
            count(distinct b.department) as unique_departments, count(distinct b.aisle) as unique_aisles,
            coalesce(avg(if(b.order_id is null, null, if(b.department = 'brand#1', 1, 0))), 0.0::double)
                as produce_item_ratio,
            coalesce(avg(if(b.order_id is null, null, if(b.department = 'brand#2', 1, 0))), 0.0::double)
                as dairy_eggs_item_ratio,
            coalesce(avg(if(b.order_id is null, null, if(b.aisle = 'economy', 1, 0))), 0.0::double)
                as fresh_fruits_item_ratio,
            coalesce(avg(if(b.order_id is null, null, if(b.aisle = 'promo', 1, 0))), 0.0::double)
                as fresh_vegetables_item_ratio
        from fact t left join bought b on b.user_id = t.user_id and b.order_number < t.order_number
        group by t.user_id, t.order_id""",
    "train": """
        select w.user_id, w.order_id, w.order_number, w.total_orders, w.observed_basket_orders,
            w.avg_basket_size, w.reorder_ratio, w.days_between_orders, w.stddev_days_between_orders,
            w.days_since_last_order, w.customer_tenure_days, w.order_frequency_30d, w.avg_order_dow,
            w.avg_order_hour_of_day, w.weekend_order_ratio, w.evening_order_ratio, w.prior_reorder_order_ratio,
            met.unique_products, met.unique_departments, met.unique_aisles, met.produce_item_ratio,
            met.dairy_eggs_item_ratio, met.fresh_fruits_item_ratio, met.fresh_vegetables_item_ratio,
            w.rr as will_reorder
        from windows w join met using (user_id, order_id)
        where w.eval_set = 'train' and w.item_count > 0 and w.total_orders >= 1""",
    # Metrics of scored rows (g, label, score); g is the group.
    "cuts": "select i, round(i / 20, 2) as threshold from range(1, 20) r(i)",
    "conf": """
        select g, threshold, count(*) filter (label = 1 and score >= threshold) as tp,
            count(*) filter (label = 0 and score >= threshold) as fp,
            count(*) filter (label = 1 and score < threshold) as fn,
            count(*) filter (label = 0 and score < threshold) as tn
        from scored, cuts group by g, threshold""",
    "rates": """
        select *, (tp + tn) / (tp + fp + fn + tn) as accuracy, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
            coalesce(tp / nullif(tp + fn, 0), 0) as recall,
            coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1,
            (coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0))
                / (if(tp + fn > 0, 1, 0) + if(tn + fp > 0, 1, 0)) as balanced_accuracy,
            coalesce(tn / nullif(tn + fp, 0), 0) as specificity,
            1 - coalesce(tn / nullif(tn + fp, 0), 0) as false_positive_rate,
            (tp + fp) / (tp + fp + fn + tn) as positive_prediction_rate
        from conf""",
    "best": """
        select * from rates qualify row_number() over (partition by g
            order by balanced_accuracy desc, f1 desc, abs(positive_prediction_rate - 0.5), threshold) = 1""",
    "steps": """
        select g, score, sum(label) as pos, count(*) - sum(label) as neg,
            sum(sum(label)) over (partition by g order by score desc) as tps,
            sum(count(*) - sum(label)) over (partition by g order by score desc) as fps
        from scored group by g, score""",
    "sizes": """
        select g, count(*) as n, sum(label) as p, count(*) - sum(label) as q, avg(label) as positive_rate,
            avg((score - label) * (score - label)) as brier_score
        from scored group by g""",
    "ranks": """
        select g, n, positive_rate, brier_score,
            if(p > 0 and q > 0, sum(pos * (q - fps + 0.5 * neg)) / (p::double * q), null) as roc_auc,
            if(p > 0 and q > 0, sum(pos / p * (tps / (tps + fps))), null) as average_precision
        from steps join sizes using (g) group by g, n, p, q, positive_rate, brier_score""",
    "metrics": """
        select g, threshold as recommended_threshold, accuracy, balanced_accuracy, precision, recall, f1, roc_auc,
            average_precision, brier_score, positive_rate, positive_prediction_rate, n as rows, tn, fp, fn, tp
        from best join ranks using (g)""",
    # The single score used by most metric queries.
    "scored_one": "select 0 as g, order_id, will_reorder as label, reorder_ratio as score from train",
    "scored_two": """
        select 'reorder_ratio' as g, will_reorder as label, reorder_ratio as score from train
        union all select 'prior_reorder_order_ratio', will_reorder, prior_reorder_order_ratio from train""",
    "dated": """
        select train.*, cast(date_trunc('quarter', o_orderdate) as timestamp) as run_timestamp
        from train join orders on o_orderkey = order_id""",
    "scored_runs": """
        select {'at': run_timestamp, 'model': 'reorder_ratio'} as g, will_reorder as label, reorder_ratio as score
        from dated
        union all select {'at': run_timestamp, 'model': 'prior_reorder_order_ratio'}, will_reorder,
            prior_reorder_order_ratio from dated""",
}

# The features of the models, and the tracked metrics.
_FEATURES = [
    "total_orders", "observed_basket_orders", "avg_basket_size", "reorder_ratio", "days_between_orders",
    "stddev_days_between_orders", "days_since_last_order", "customer_tenure_days", "order_frequency_30d",
    "avg_order_dow", "avg_order_hour_of_day", "weekend_order_ratio", "evening_order_ratio", "prior_reorder_order_ratio",
    "unique_products", "unique_departments", "unique_aisles", "produce_item_ratio", "dairy_eggs_item_ratio",
    "fresh_fruits_item_ratio", "fresh_vegetables_item_ratio",
]
_PARTS["long_features"] = " union all ".join(
    f"select run_timestamp, will_reorder, '{f}' as feature, {f}::double as v from dated" for f in _FEATURES
)
_PARTS["gaps"] = """
    select run_timestamp, feature, coalesce(abs(avg(v) filter (will_reorder = 1) - avg(v) filter (will_reorder = 0))
        / nullif(abs(avg(v)), 0), 0) as gap
    from long_features group by all"""
_PARTS["gap_all"] = """
    select feature, gap / nullif(sum(gap) over (), 0) as importance from (
        select feature, coalesce(abs(avg(v) filter (will_reorder = 1) - avg(v) filter (will_reorder = 0))
            / nullif(abs(avg(v)), 0), 0) as gap
        from long_features group by feature)"""
_PARTS["tops"] = """
    select run_timestamp, feature as top_feature, share as top_feature_importance
    from (select *, coalesce(gap / nullif(sum(gap) over (partition by run_timestamp), 0), 0) as share from gaps)
    qualify row_number() over (partition by run_timestamp order by share desc, feature) = 1"""
_PARTS["runs"] = """
    select run_timestamp, selected_model, cast(sum(test_rows) over () - test_rows as bigint) as train_rows, * exclude
        (run_timestamp, selected_model)
    from (
        select g.at as run_timestamp, g.model as selected_model, rows as test_rows,
            recommended_threshold as threshold, top_feature, top_feature_importance, accuracy, balanced_accuracy,
            precision, recall, f1, roc_auc, average_precision, brier_score, positive_rate
        from metrics left join tops on tops.run_timestamp = g.at
        qualify row_number() over (partition by g.at
            order by roc_auc is null, coalesce(roc_auc, 0) desc, coalesce(f1, 0) desc, g.model) = 1)"""
_TRACKED = [
    "accuracy", "balanced_accuracy", "precision", "recall", "f1", "roc_auc", "average_precision", "brier_score",
    "positive_rate",
]
_PARTS["run_values"] = " union all ".join(
    f"select run_timestamp, '{n}' as metric, {n} as v, lag({n}) over (order by run_timestamp) as u from runs"
    for n in _TRACKED
)
_PARTS["worse"] = """
    select run_timestamp, 'metric_drift' as type, metric, v - u as delta, u as previous_value, v as current_value,
        null::varchar as previous_name, null::varchar as current_name,
        if(abs(v - u) >= 0.08, 'high', 'medium') as severity,
        metric || if(v > u, ' increased', ' decreased') || ' by ' || printf('%.3f', abs(v - u))
            || ' compared with the previous run.' as description
    from run_values where u is not null and v is not null
        and if(metric = 'brier_score', v - u > 0.03, v - u < -0.03)"""
_PARTS["moved"] = """
    select run_timestamp, 'feature_drift' as type, if(now <> before, 'top_feature', 'top_feature_importance') as metric,
        delta, 'medium' as severity, if(now <> before, null, a) as previous_value, if(now <> before, null, b) as current_value,
        if(now <> before, before, null) as previous_name, if(now <> before, now, null) as current_name,
        if(now <> before, 'The most influential feature changed compared with the previous run.',
            'The leading feature importance changed materially compared with the previous run.') as description
    from (select run_timestamp, top_feature as now, lag(top_feature) over t as before,
            lag(top_feature_importance) over t as a, top_feature_importance as b,
            top_feature_importance - lag(top_feature_importance) over t as delta
          from runs window t as (order by run_timestamp))
    where now <> before or abs(delta) >= 0.10"""
_PARTS["statuses"] = """
    select run_timestamp, prev as previous_run_timestamp, selected_model,
        case when prev is null then 'baseline' when n > 0 then 'attention' else 'stable' end as status,
        case when prev is null then 'First tracked training run saved as the monitoring baseline.'
            when n > 0 then 'Model monitoring found ' || n || ' signal(s) requiring review.'
            else 'Model monitoring is stable against the previous training run.' end as summary,
        n as findings, top_feature, top_feature_importance,
        coalesce((select string_agg(metric, ',' order by metric) from (
            select run_timestamp as moment, metric from worse union all select run_timestamp, metric from moved) where moment = r.run_timestamp), '') as found,
        (select v - u from run_values x where x.run_timestamp = r.run_timestamp and metric = 'roc_auc') as roc_auc_delta,
        (select if(v is null, null, u) from run_values x where x.run_timestamp = r.run_timestamp and metric = 'brier_score') as previous_brier_score,
        (select count(*) from run_values x where x.run_timestamp = r.run_timestamp and u is not null and v is not null)::integer as tracked
    from (select run_timestamp, selected_model, top_feature, top_feature_importance, lag(run_timestamp) over (order by run_timestamp) as prev,
            (select count(*) from worse where worse.run_timestamp = runs.run_timestamp)
            + (select count(*) from moved where moved.run_timestamp = runs.run_timestamp) as n
          from runs) r"""
_PARTS["placed_models"] = """
    select g.at as run_timestamp, g.model as model, roc_auc, f1, recommended_threshold, positive_prediction_rate, tp,
        row_number() over (partition by g.at order by roc_auc is null, coalesce(roc_auc, 0) desc, coalesce(f1, 0) desc, g.model) as place
    from metrics"""
_PARTS["placed_features"] = """
    select run_timestamp, feature, share, row_number() over (partition by run_timestamp order by share desc, feature) as place
    from (select *, coalesce(gap / nullif(sum(gap) over (partition by run_timestamp), 0), 0) as share from gaps)"""
_PARTS["signals_in"] = """
    select f.user_id, f.reorder_ratio as reorder, f.days_between_orders as gap,
        f.total_orders - f.observed_basket_orders as failures, churn.churn_probability as churn,
        e.bad, r.delta
    from feat f join churn using (user_id)
    left join (select user_id, count(*) filter (event_type = 'error') * 3 >= count(*) as bad
               from events group by user_id) e using (user_id)
    left join (select user_id, (sum(item_count) filter (eval_set = 'train') - p) / p as delta
               from (select *, sum(if(eval_set = 'prior', item_count, 0)) over (partition by user_id) as p from fact)
               where p > 0 group by user_id, p) r using (user_id)"""
_PARTS["signals_in"] = _PARTS["signals_in"].replace(
    "(sum(item_count) filter (eval_set = 'train') - p) / p",
    "(coalesce(sum(item_count) filter (eval_set = 'train'), 0) - p) / p",
)
_PARTS["signals"] = """
    select user_id, 1 as k, 'reorder_rate' as metric, reorder as value, 3 as level,
        'Reorder rate is below the healthy operating threshold.' as description
    from signals_in where reorder <> 0 and reorder < 0.35::double
    union all select user_id, 2, 'churn_rate', churn, if(churn >= 0.7::double, 4, 3),
        if(churn >= 0.7::double, 'Churn risk is critically high.', 'Churn risk is elevated.')
    from signals_in where churn >= 0.5::double
    union all select user_id, 3, 'days_between_orders', gap, 3, 'Average purchase gap is unusually long.'
    from signals_in where gap >= 21
    union all select user_id, 4, 'data_quality_failures', failures, 4,
        'Data quality checks are failing before downstream decisions.' from signals_in where failures > 0
    union all select user_id, 5, 'api_health', null, 4, 'Serving API is unavailable or unhealthy.'
    from signals_in where bad"""
_PARTS["decided"] = """
    select user_id, 1 as k, 'alert' as decision_type, 4 as level, 'data_quality_failures' as metric
    from signals where metric = 'data_quality_failures'
    union all select user_id, 2, 'alert', 4, 'api_health' from signals where metric = 'api_health'
    union all select user_id, 3, 'recommendation', max(level), 'retention_risk'
    from signals where k <= 3 group by user_id
    union all select user_id, 4, 'alert', 3, 'revenue_delta' from signals_in where delta < -0.10::double"""
_PARTS["all_decided"] = """
    select * from decided
    union all select user_id, 5, 'recommendation', 1, 'overall_health' from signals_in
    where user_id not in (select user_id from decided)"""
_PARTS["levels"] = "select * from (values (1, 'low'), (2, 'medium'), (3, 'high'), (4, 'critical')) t(level, priority)"
# Wording of the decisions.
_PARTS["wording"] = """
    select * from (values
        ('data_quality_failures', 'Pause downstream analytics refresh',
         'Investigate failing data quality checks before running dbt, training, or dashboard refreshes.',
         'Data quality failures can contaminate marts, model features, and AI insights.',
         'Suspendre le rafraichissement analytique downstream'),
        ('api_health', 'Restore prediction API availability',
         'Check Render logs, health endpoint, model artifact availability, and environment variables.',
         'The decision and dashboard layers depend on the API for live predictions and copilot workflows.',
         'Restaurer la disponibilite de l''API de prediction'),
        ('retention_risk', 'Launch retention intervention',
         'Target high-risk customers with reorder reminders, high-repeat products, and time-bound offers.',
         'Churn risk, weak reorder behavior, or long purchase gaps indicate declining customer engagement.',
         'Lancer une intervention de retention'),
        ('revenue_delta', 'Review revenue proxy decline',
         'Compare order volume, basket size, and repeat purchase movement by cohort and product department.',
         'A declining revenue proxy can signal lower basket activity even without price-level data.',
         'Analyser la baisse du proxy de revenus'),
        ('overall_health', 'Continue monitoring customer health',
         'Track reorder rate, retention cohorts, churn risk, and data quality daily.',
         'No critical anomaly was detected, so the best decision is ongoing monitoring.',
         'Continuer le suivi de la sante client')) t(metric, title, action, rationale, titre)"""
_PARTS["placed"] = """
    select user_id, cast(row_number() over (partition by user_id order by level desc, k) as integer) as place,
        decision_type, priority, title, action, rationale, metric, titre
    from all_decided join levels using (level) join wording using (metric)"""
_PARTS["spend"] = """
    select c_custkey as user_id, coalesce(sum(o_totalprice), 0) as total_spend, count(o_orderkey) as order_count
    from customer left join orders on o_custkey = c_custkey group by c_custkey"""


# The fixed models of the catalogue, written as nested cases.
_FIXED = {
    "forest": """((case when reorder_ratio <= 0.45 then if(days_between_orders <= 14, 0.48, 0.21)
            else if(total_orders <= 6, 0.64, 0.83) end)::double
        + (case when unique_products <= 12 then 0.37 else if(avg_basket_size <= 4.5, 0.61, 0.74) end)::double) / 2""",
    "boosted": """1 / (1 + exp(-2 * (if(prior_reorder_order_ratio <= 0.6, -0.7, 0.9)::double
        + 0.05::double * (case when customer_tenure_days <= 90 then -1.5 else if(weekend_order_ratio <= 0.3, 1.2, 0.2) end)::double
        + 0.05::double * 0.4::double)))""",
    "linear": """1 / (1 + exp(-(0.15::double + 0.8::double * (reorder_ratio - 0.5) / 0.2::double
        - 0.3::double * (avg_basket_size - 4) / 1.5::double - 0.4::double * (days_since_last_order - 12) / 8)))""",
}
_PARTS["scored_fixed"] = " union all ".join(
    f"select '{name}' as g, user_id, order_id, will_reorder as label, round(({sql})::double, 9) as score from train" for name, sql in _FIXED.items()
)
# Gain times rows of the splits, in the forest as a share of each tree's; absolute coefficients.
_PARTS["fixed_shares"] = """
    select * from (values
        ('forest', 'reorder_ratio', 24.0 / 32.9), ('forest', 'days_between_orders', 4.5 / 32.9), ('forest', 'total_orders', 4.4 / 32.9),
        ('forest', 'unique_products', 16.0 / 20.8), ('forest', 'avg_basket_size', 4.8 / 20.8),
        ('boosted', 'prior_reorder_order_ratio', 60.0), ('boosted', 'customer_tenure_days', 40.0), ('boosted', 'weekend_order_ratio', 13.0),
        ('linear', 'reorder_ratio', 0.8), ('linear', 'avg_basket_size', 0.3), ('linear', 'avg_order_dow', 0.25), ('linear', 'days_since_last_order', 0.4)
    ) t(model_name, feature, value)"""


def _with(sql: str, **given: str) -> str:
    """Put the building blocks that ``sql`` names, and those they name, in front of it."""
    parts = {**_PARTS, **given}
    needed: list[str] = []

    def visit(text: str) -> None:
        # Column names may equal block names; an unused block does no harm.
        for word in dict.fromkeys(re.findall(r"[a-z_0-9]+", text)):
            if word in parts and word not in needed and re.search(rf"(from|join|,)\s+{word}\b", text):
                visit(parts[word])
                if word not in needed:
                    needed.append(word)

    visit(sql)
    if not needed:
        return sql
    return "with " + ", ".join(f"{n} as ({parts[n].strip()})" for n in needed) + " " + sql


def _sql(sql: str, doubles: str = "", longs: str = "", **given: str) -> str:
    """Round the named double columns to six places, cast the named counts to BIGINT."""
    swaps = [f"round({c}::double, 6) as {c}" for c in doubles.split()]
    swaps += [f"{c}::bigint as {c}" for c in longs.split()]
    body = _with(sql, **given)
    return f"select * replace ({', '.join(swaps)}) from ({body})" if swaps else body


_FEATURE_DOUBLES = (
    "avg_basket_size stddev_basket_size reorder_ratio reorder_order_ratio produce_item_ratio "
    "dairy_eggs_item_ratio fresh_fruits_item_ratio fresh_vegetables_item_ratio days_between_orders "
    "stddev_days_between_orders customer_tenure_days max_days_between_orders avg_order_dow "
    "avg_order_hour_of_day weekend_order_ratio evening_order_ratio observed_basket_coverage order_frequency_30d"
)
_SHARES = "produce_item_ratio dairy_eggs_item_ratio fresh_fruits_item_ratio fresh_vegetables_item_ratio"
_HISTORY_DOUBLES = (
    "avg_basket_size reorder_ratio prior_reorder_order_ratio days_between_orders stddev_days_between_orders "
    "customer_tenure_days avg_order_dow avg_order_hour_of_day weekend_order_ratio evening_order_ratio"
)
_RATES = "accuracy balanced_accuracy precision recall f1 roc_auc"
_ALL_RATES = _RATES + " average_precision brier_score"
_RUN_DOUBLES = "threshold top_feature_importance " + _ALL_RATES
_CLV = "avg_basket_size reorder_ratio days_between_orders churn_probability"
_VALUES = "historical_value_proxy predicted_future_value_proxy customer_lifetime_value_proxy"
_BASE_STATS = "avg_total_orders avg_reorder_ratio avg_unique_products avg_days_between_orders"
_ONE = {"scored": _PARTS["scored_one"]}
_TWO = {"scored": _PARTS["scored_two"]}
_RUNS = {"scored": _PARTS["scored_runs"]}
_MODELS_OF_TABLES = {"scored": _PARTS["scored_fixed"]}


def _groups(a: int, b: int, c: int) -> dict[str, str]:
    return {"order_groups": _PARTS["order_groups"].format(a=a, b=b, c=c)}


# Declared data tests, table -> (building block, unique column, required columns).
_MODELS = {
    "stg_orders": ("ord", "order_id", ["order_id", "user_id"]),
    "stg_order_products": ("li", "order_product_id", ["order_product_id", "order_id", "product_id"]),
    "stg_products": ("prod", "product_id", ["product_id", "product_name"]),
    "stg_customers": ("cust", "user_id", ["user_id", "order_count"]),
    "fct_orders": ("fact", "order_id", ["order_id", "user_id"]),
    "dim_products": ("dimp", "product_id", ["product_id", "product_name"]),
    "dim_users": (
        "users", "user_id", ["user_id", "order_count", "order_frequency_30d", "customer_frequency_segment"]),
    "feature_store": ("feat", "user_id", (
        "user_id total_orders observed_basket_orders avg_basket_size stddev_basket_size reorder_ratio "
        "unique_products unique_departments unique_aisles produce_item_ratio dairy_eggs_item_ratio "
        "fresh_fruits_item_ratio fresh_vegetables_item_ratio stddev_days_between_orders customer_tenure_days "
        "max_days_between_orders avg_order_dow order_frequency_30d avg_order_hour_of_day weekend_order_ratio "
        "evening_order_ratio active_order_dow_count observed_basket_coverage will_reorder").split()),
    "customer_cohort_retention": ("cohorts", None, ["cohort_order_number", "cohort_period", "retention_rate"]),
    "customer_churn_probability": (
        "churn", "user_id", ["user_id", "churn_probability", "churn_risk_segment"]),
    "customer_lifetime_value": (
        "clv_seg", "user_id", ["user_id", "customer_lifetime_value_proxy", "value_segment"]),
}

_NUMBER = """
    select o_orderkey as order_id, case
        when o_orderkey % 5 in (0, 2) then {plain} when o_orderkey % 5 = 1 then {percent} else {other} end as value
    from orders"""

ORACLE: dict[str, str] = {
    "table_scan": _sql("select * from part", "p_retailprice"),
    "param_query": _sql(
        "select department, count(*) as products, sum(order_line_count) as lines from dimp "
        "where department <> 'Brand#1' and order_line_count >= 5 group by department", "", "lines"),
    "schema_tolerant_select": _sql(
        "select * replace (null::double as reorder_order_ratio, null::bigint as active_order_dow_count) from feat",
        _FEATURE_DOUBLES),
    "stg_orders": _sql("select * exclude (order_date) from ord"),
    "stg_order_products": _sql("select * from li"),
    "flag_columns": _sql(
        "select order_id, wk as is_weekend_order, ev as is_evening_order, rr as has_reordered_items from line_days"),
    "frequency_segment": _sql(
        "select customer_frequency_segment, count(*) as users from users group by all"),
    "churn_risk_segment": _sql(
        "select churn_risk_segment, churn_probability, count(*) as users from churn group by all",
        "churn_probability"),
    "value_segment": _sql("select user_id, value_segment from clv_seg"),
    "value_segment_lower_bounds": _sql(
        "select user_id, case when customer_lifetime_value_proxy < 40 then 'emerging' "
        "when customer_lifetime_value_proxy < 60 then 'growth' else 'high_value' end as value_segment from clv"),
    "behaviour_segment": _sql("select user_id, customer_segment from behave"),
    "behaviour_segment_lower_bounds": _sql(
        "select user_id, case when observed_basket_coverage < 0.95::double then 'limited_basket_detail' "
        "when reorder_ratio >= 0.35::double and total_orders >= 8 then 'loyal_reorder' "
        "when days_between_orders >= 24 or reorder_ratio < 0.3::double then 'at_risk_customer' "
        "when unique_products >= 30 then 'product_explorer' else 'steady_customer' end as customer_segment "
        "from feat"),
    "order_count_segment": _sql(
        "select user_id, case when total_orders < 10 then 'low_frequency_customers_under_10_orders' "
        "when total_orders < 40 then 'developing_customers_10_to_39_orders' "
        "when total_orders < 80 then 'frequent_customers_40_to_79_orders' "
        "else 'power_customers_80_plus_orders' end as customer_segment from feat"),
    "spend_segment": _sql(
        "select *, total_spend / nullif(order_count, 0) as average_order_value, "
        "case when total_spend < 250 then 'emerging' when total_spend < 1000 then 'growth' "
        "else 'high_value' end as customer_segment from spend", "total_spend average_order_value"),
    "average_order_value": _sql(
        "select *, total_spend / greatest(order_count, 1) as average_order_value from spend",
        "total_spend average_order_value"),
    "numeric_coercion": (
        "select o_orderkey as order_id, if(o_orderkey % 5 = 0, o_orderkey::double, null) as value from orders"),
    "metric_parse": _sql(
        _NUMBER.format(plain="o_orderkey::double", percent="o_orderkey / 100", other="0.0::double"), "value"),
    "displayed_metric_parse": _sql(
        _NUMBER.format(plain="o_orderkey::double", percent="o_orderkey::double", other="null"), "value"),
    "drop_nulls": _sql(
        "select order_id, days_since_prior_order from ord "
        "where days_since_prior_order is not null and user_id is not null"),
    "lookup_join": _sql("select * from prod"),
    "left_join_preagg": _sql("select order_id, item_count, reordered_item_count from fact"),
    "filter_by_join": _sql(
        "select li.* from li join ord using (order_id) where ord.eval_set = 'train'"),
    "inner_self_agg": _sql(
        "select order_id, order_number - min(order_number) over (partition by user_id) as cohort_period from ord"),
    "inner_1to1": _sql(
        "select f.user_id, f.total_orders, c.churn_probability, c.churn_risk_segment "
        "from feat f join churn c on c.user_id = f.user_id", "churn_probability"),
    "three_way_inner": _sql("select * from breadth", _SHARES),
    "inner_same_rel": _sql(
        "select cohort_order_number, cohort_period, cohort_size, retention_rate from cohorts", "retention_rate"),
    "left_join_features": _sql(
        "select user_id, total_orders, unique_products, unique_departments, unique_aisles from feat"),
    "composite_key_left": _sql(
        "select ord.user_id, ord.order_id, w.total_orders from ord left join windows w "
        "on w.user_id = ord.user_id and w.order_id = ord.order_id and w.total_orders >= 1 "
        "where ord.eval_set = 'train'"),
    "anti_orphan": """
        select 'raw_order_products' as table_name, 'cheap_product' as check_name, count(*) as invalid_count
        from lineitem left join part on l_partkey = p_partkey and p_retailprice < 1000 where p_partkey is null
        union all
        select 'raw_order_products', 'product_id_valid', count(*)
        from lineitem left join part on l_partkey = p_partkey where p_partkey is null""",
    "lenient_timestamps": """
        select event_id, case when event_id % 8 < 5 then date_trunc('second', ts::timestamp)
            when event_id % 8 = 5 then date_trunc('day', ts::timestamp) end::timestamp as moment from events""",
    "semi_in": _sql(
        "select * exclude (order_date) from ord "
        "where order_id in (select order_id from fact where eval_set = 'train' and item_count > 0)"),
    "order_lines_agg": _sql(
        "select order_id, count(*) as item_count, sum(reordered) as reordered_item_count, "
        "min(add_to_cart_order) as first_cart_position, max(add_to_cart_order) as last_cart_position "
        "from li group by order_id", "", "reordered_item_count"),
    "exact_distinct": """
        select count(distinct l_orderkey) as orders, count(distinct l_partkey) as products,
            count(distinct (l_orderkey, l_partkey)) as pairs from lineitem""",
    "monthly_frequency": _sql("select user_id, order_frequency_30d from users", "order_frequency_30d"),
    "category_shares": _sql(f"select user_id, {_SHARES.replace(' ', ', ')} from feat", _SHARES),
    "smoothed_ratio": _sql(
        "select user_id, reorder_ratio, reorder_order_ratio from feat", "reorder_ratio reorder_order_ratio"),
    "having_duplicates": _sql(
        "select order_id, product_id, count(*) as n from li group by all having count(*) > 1"),
    "value_counts": _sql("select eval_set, count(*) as orders from ord group by all"),
    "histogram": _sql(
        "select floor(total_orders / w) * w as bin_start, count(*) as users from feat, "
        "(select min(m * pow(10, e)) as w from (select unnest([1, 2, 5]) as m), range(0, 13) r(e) "
        " where (select max(total_orders) - min(total_orders) from feat) / (m * pow(10, e)) <= 18) group by 1",
        "bin_start", "users"),
    "customer_day_number": _sql(
        "select user_id, order_number, order_id, customer_day_number from line_days", "customer_day_number"),
    "trailing_30d_count": _sql("select order_id, order_frequency_30d from windows"),
    "prior_window_features": _sql(
        "select order_id, total_orders, observed_basket_orders, " + _HISTORY_DOUBLES.replace(" ", ", ")
        + " from windows", _HISTORY_DOUBLES),
    "history_range_join": _sql("select * from met", _SHARES),
    "heavy_users": "select o_custkey as user_id from orders group by 1 having count(*) > 20",
    "stg_customers": _sql(
        "select * from cust", "avg_order_dow avg_order_hour_of_day avg_days_since_prior_order"),
    "fct_orders": _sql("select * from fact"),
    "fct_orders_increment": _sql(
        "select * from fact where order_id > (select floor(max(o_orderkey) / 2) from orders)"),
    "dim_products": _sql("select * from dimp"),
    "dim_users": _sql(
        "select * from users",
        "avg_days_since_prior_order stddev_days_since_prior_order customer_tenure_days max_days_since_prior_order "
        "avg_order_dow avg_order_hour_of_day weekend_order_ratio evening_order_ratio reorder_item_ratio "
        "order_frequency_30d"),
    "feature_store": _sql("select * from feat", _FEATURE_DOUBLES),
    "churn_probability": _sql("select * from churn", _CLV),
    "lifetime_value": _sql("select * from clv_seg", f"{_CLV} {_VALUES}"),
    "cohort_retention": _sql("select * from cohorts", "retention_rate"),
    "cohort_retention_train": _sql(
        "select * from cohorts", "retention_rate",
        fact_all=_PARTS["fact"], fact="select * from fact_all where eval_set = 'train'"),
    "kpis": _sql(
        "select count(distinct order_id) as total_orders, sum(item_count) as revenue_proxy, "
        "avg(reordered_item_count / nullif(item_count, 0)) as reorder_rate from fact",
        "reorder_rate", "revenue_proxy"),
    "customer_insights": _sql("select * from sampled", _FEATURE_DOUBLES),
    "profile_cards": _sql(
        "select * from sampled order by customer_segment, total_orders desc, user_id limit 12", _FEATURE_DOUBLES),
    "customer_profile_summary": _sql(
        "select count(*) as total_customers, avg(total_orders) as avg_total_orders, "
        "median(total_orders) as median_total_orders, avg(reorder_ratio) as avg_reorder_ratio, "
        "avg(observed_basket_coverage) as avg_observed_basket_coverage, "
        "avg(if(total_orders >= 100, 1, 0)) as order_cap_share, "
        "avg(days_between_orders) as avg_days_between_orders, avg(unique_products) as avg_unique_products from feat",
        _BASE_STATS + " median_total_orders avg_observed_basket_coverage order_cap_share"),
    "sample_profile_summary": _sql(
        "select count(distinct user_id) as total_customers, avg(total_orders) as avg_total_orders, "
        "median(total_orders) as median_total_orders, avg(reorder_ratio) as avg_reorder_ratio, "
        "avg(observed_basket_coverage) as avg_observed_basket_coverage, "
        "avg(if(total_orders >= 100, 1, 0)) as order_cap_share, "
        "avg(days_between_orders) as avg_days_between_orders, avg(unique_products) as avg_unique_products "
        "from sampled",
        _BASE_STATS + " median_total_orders avg_observed_basket_coverage order_cap_share"),
    "customer_segment_summary": _sql(
        "select customer_segment, count(*) as users, avg(total_orders) as avg_total_orders, "
        "avg(reorder_ratio) as avg_reorder_ratio, avg(observed_basket_coverage) as avg_observed_basket_coverage, "
        "avg(unique_products) as avg_unique_products, avg(days_between_orders) as avg_days_between_orders, "
        "avg(order_frequency_30d) as avg_order_frequency_30d from behave group by customer_segment",
        _BASE_STATS + " avg_observed_basket_coverage avg_order_frequency_30d"),
    "product_trends": _sql(
        "select product_name, department, aisle, order_line_count, reordered_line_count, "
        "reordered_line_count / nullif(order_line_count, 0) as reorder_rate from dimp "
        "order by order_line_count desc, product_id limit 25", "reorder_rate"),
    "top_products": _sql("select * from top20", "reorder_ratio"),
    "customer_behavior_summary": _sql(
        "select count(*) as total_users, avg(total_orders) as avg_total_orders, "
        "avg(feat.avg_basket_size) as avg_basket_size, avg(reorder_ratio) as avg_reorder_ratio, "
        "avg(unique_products) as avg_unique_products, avg(days_between_orders) as avg_days_between_orders from feat",
        _BASE_STATS + " avg_basket_size"),
    "customer_segments_by_orders": _sql(
        "select * from order_groups", _BASE_STATS + " avg_basket_size max_days_between_orders",
        **_groups(80, 40, 10)),
    "customer_segments_lower_bounds": _sql(
        "select * from order_groups", _BASE_STATS + " avg_basket_size max_days_between_orders",
        **_groups(16, 12, 8)),
    "longest_gap_users": _sql(
        "select user_id, total_orders, observed_basket_orders, avg_basket_size, reorder_ratio, unique_products, "
        "days_between_orders from feat order by days_between_orders desc, user_id limit 20",
        "avg_basket_size reorder_ratio days_between_orders"),
    "churn_by_segment": _sql("select * from churn_groups", _BASE_STATS + " avg_basket_size avg_churn_probability"),
    "highest_churn_users": _sql("select * from churn order by churn_probability desc, user_id limit 25", _CLV),
    "clv_by_segment": _sql(
        "select value_segment, count(*) as users, avg(customer_lifetime_value_proxy) as avg_lifetime_value_proxy, "
        "avg(historical_value_proxy) as avg_historical_value_proxy, "
        "avg(predicted_future_value_proxy) as avg_future_value_proxy, "
        "avg(churn_probability) as avg_churn_probability from clv_seg group by value_segment",
        "avg_lifetime_value_proxy avg_historical_value_proxy avg_future_value_proxy avg_churn_probability"),
    "top_clv_customers": _sql(
        "select user_id, value_segment, customer_lifetime_value_proxy, historical_value_proxy, "
        "predicted_future_value_proxy, churn_probability, churn_risk_segment from clv_seg "
        "order by customer_lifetime_value_proxy desc, user_id limit 25", f"churn_probability {_VALUES}"),
    "reorder_trend": _sql("select * from trend", "avg_basket_size reorder_ratio"),
    "cohort_latest": _sql("select * from latest_cohorts", "retention_rate"),
    "weakest_retention": _sql(
        "select cohort_order_number, cohort_period, retention_rate as lowest_rate, "
        "(select retention_rate from latest_cohorts order by cohort_order_number desc, cohort_period limit 1) "
        "as latest_rate from latest_cohorts order by retention_rate, cohort_order_number desc, cohort_period limit 1",
        "lowest_rate latest_rate"),
    "repeat_leader": _sql(
        "select a.product_name as volume_leader, a.order_line_count as volume_leader_lines, "
        "b.product_name as repeat_leader, b.product_id as repeat_leader_id, b.reorder_ratio as repeat_leader_ratio "
        "from (select * from top20 order by order_line_count desc, product_id limit 1) a, "
        "(select * from top20 order by reorder_ratio desc, order_line_count desc, product_id limit 1) b",
        "repeat_leader_ratio"),
    "trend_vs_average": _sql(
        "select *, if(latest_ratio >= average_ratio, 'above', 'below') as direction from (select "
        "(select reorder_ratio from trend order by order_number desc limit 1) as latest_ratio, "
        "(select avg(reorder_ratio) from trend) as average_ratio)", "latest_ratio average_ratio"),
    "longest_gap_segment": _sql(
        "select customer_segment, users, avg_days_between_orders, "
        "format('{:,.2f}', avg_days_between_orders) as gap_text from order_groups "
        "order by avg_days_between_orders desc, customer_segment limit 1", "avg_days_between_orders",
        **_groups(80, 40, 10)),
    "highest_risk_segment": _sql(
        "select churn_risk_segment, users, avg_churn_probability, avg_days_between_orders from churn_groups "
        "order by churn_risk_segment = 'high' desc, avg_churn_probability desc limit 1",
        "avg_churn_probability avg_days_between_orders"),
    "not_null_check": _sql(" union all ".join(
        f"select 'stg_orders' as table_name, '{c}_not_null' as check_name, "
        f"count(*) - count({c}) as invalid_count from ord"
        for c in ("order_id", "user_id", "eval_set", "order_number", "order_dow", "order_hour_of_day",
                  "days_since_prior_order"))),
    "unique_check": _sql(
        "select 'stg_order_products' as table_name, 'order_product_unique' as check_name, "
        "count(*) as invalid_count from (select 1 from li group by order_id, product_id having count(*) > 1)"),
    "reference_check": _sql(
        "select 'stg_order_products' as table_name, 'product_id_valid' as check_name, count(*) as invalid_count "
        "from li where product_id not in (select product_id from prod)"),
    "quality_report": _sql("select *, if(invalid_count = 0, 'Passed', 'Failed') as status from checks"),
    "quality_summary": _sql(
        "select f as data_quality_failures, n as total_checks, if(f = 0, 'passed', 'failed') as data_quality_status, "
        "f || ' failed checks out of ' || n as data_quality_detail "
        "from (select count(*) filter (invalid_count > 0) as f, count(*) as n from checks)"),
    "training_dataset": _sql("select * from train", _HISTORY_DOUBLES + " days_since_last_order " + _SHARES),
    "training_sort_limit": _sql(
        "select user_id, order_id, order_number, will_reorder from train "
        "order by user_id, order_number limit 250000"),
    "training_matrix": _sql(
        "select user_id, order_id, " + ", ".join(
            f"round({'0' if f == 'unique_aisles' else f}::double, 6) as {f}" for f in _FEATURES)
        + ", will_reorder as label from train"),
    "threshold_analysis": _sql(
        "select threshold, precision, recall, f1, balanced_accuracy, specificity, false_positive_rate, "
        "positive_prediction_rate from rates",
        "threshold precision recall f1 balanced_accuracy specificity false_positive_rate positive_prediction_rate",
        **_ONE),
    "recommended_threshold": _sql(
        "select threshold as recommended_threshold from best", "recommended_threshold", **_ONE),
    "roc_points": _sql(
        "select row_number() over (order by fps, tps) - 1 as point, fps / q as false_positive_rate, "
        "tps / p as true_positive_rate, score as threshold from ("
        "select *, lag(pos) over w is null as first, lead(pos) over w as np, lead(neg) over w as nn "
        "from steps window w as (order by score desc) "
        "union all select 0, null, 0, 0, 0, 0, true, null, null), sizes "
        "where first or np is null or np <> pos or nn <> neg",
        "false_positive_rate true_positive_rate threshold", "point", **_ONE),
    "pr_points": _sql(
        "select row_number() over (order by score nulls last) - 1 as point, "
        "if(score is null, 1, tps / (tps + fps)) as precision, tps / p as recall, score as threshold from ("
        "select score, tps, fps from steps union all select null, 0, 0), sizes",
        "precision recall threshold", "point", **_ONE),
    "curve_sample": _sql(
        "select point, precision, recall, threshold from ("
        "select row_number() over (order by score nulls last) - 1 as point, count(*) over () as m, "
        "if(score is null, 1, tps / (tps + fps)) as precision, tps / p as recall, score as threshold from ("
        "select score, tps, fps from steps union all select null, 0, 0), sizes) "
        "where m <= 200 or point in (select round_even(i * ((select count(*) from steps) / 199), 0) "
        "from range(0, 200) r(i))",
        "precision recall threshold", "point", **_ONE),
    "classification_metrics": _sql(
        "select * exclude (g) from metrics",
        f"recommended_threshold {_ALL_RATES} positive_rate positive_prediction_rate", "rows", **_ONE),
    "confusion_rows": _sql(
        "select 'true_negatives' as cell, tn as rows from best union all select 'false_positives', fp from best "
        "union all select 'false_negatives', fn from best union all select 'true_positives', tp from best", **_ONE),
    "classification_report": _sql(
        "select class, precision, recall, f1_score, support from ("
        "with two as (select 'No Reorder' as class, tn / nullif(tn + fn, 0) as p, tn / nullif(tn + fp, 0) as r, "
        "2 * tn / nullif(2 * tn + fn + fp, 0) as f, tn + fp as support from best "
        "union all select 'Reorder', tp / nullif(tp + fp, 0), tp / nullif(tp + fn, 0), "
        "2 * tp / nullif(2 * tp + fp + fn, 0), tp + fn from best) "
        "select class, p as precision, r as recall, f as f1_score, support from two "
        "union all select 'Macro Avg', avg(p), avg(r), avg(f), sum(support) from two "
        "union all select 'Weighted Avg', sum(p * support) / sum(support), sum(r * support) / sum(support), "
        "sum(f * support) / sum(support), sum(support) from two)",
        "precision recall f1_score", "support", **_ONE),
    "stratified_split": _sql(
        "select order_id, label, row_number() over (partition by label order by md5(order_id || '-42'), order_id) "
        "<= ceil(0.2::double * count(*) over (partition by label)) as is_test from scored", **_ONE),
    "min_max_scores": _sql(
        "select order_id, customer_tenure_days as decision, (customer_tenure_days - lo) / (hi - lo) as score "
        "from train, (select min(customer_tenure_days) as lo, max(customer_tenure_days) as hi from train)",
        "decision score"),
    "score_ranges": _sql(" union all ".join(
        f"select '{f}' as feature, count(*) filter ({f} < 0"
        + (f" or {f} > 1" if f.endswith("_ratio") else f" or {f} > 6" if f == "avg_order_dow"
           else f" or {f} > 23" if f == "avg_order_hour_of_day" else "")
        + ") as violations from train" for f in _FEATURES)),
    "model_comparison": _sql(
        "select g as model_name, accuracy, balanced_accuracy, precision, recall, f1, roc_auc, "
        "recommended_threshold, positive_prediction_rate, average_precision, brier_score from metrics",
        f"{_ALL_RATES} recommended_threshold positive_prediction_rate", **_TWO),
    "batch_score_by_table": _sql(
        "select g as model_name, user_id, order_id, label, score from scored_fixed", "score"),
    "candidate_comparison": _sql(
        "select g as model_name, accuracy, balanced_accuracy, precision, recall, f1, roc_auc, "
        "recommended_threshold, positive_prediction_rate, average_precision, brier_score from metrics",
        f"{_ALL_RATES} recommended_threshold positive_prediction_rate", **_MODELS_OF_TABLES),
    "importance_by_table": _sql(
        "select m.model_name, f.feature, coalesce(s.value, 0) / sum(coalesce(s.value, 0)) over (partition by m.model_name) as importance, "
        "f.mean from (values ('forest'), ('boosted'), ('linear')) m(model_name) "
        "join (select feature, avg(v) as mean from long_features group by feature) f on true "
        "left join fixed_shares s on s.model_name = m.model_name and s.feature = f.feature", "importance mean"),
    "metric_gap_flag": _sql(
        "select g as model_name, accuracy - balanced_accuracy as metric_gap, "
        "accuracy - balanced_accuracy >= 0.15 or positive_rate >= 0.8 as metric_gap_warning from metrics",
        "metric_gap", **_TWO),
    "class_gap_importance": _sql("select * from gap_all", "importance"),
    "model_recommendations": _sql(
        "select g as model_name, rule_no, priority, action, expected_impact from metrics, (values "
        "(1, 'high', 'Monitor class imbalance before using the model for automated targeting.', "
        "'The dataset contains many reorder-positive examples, so accuracy alone can overstate model quality. "
        "Use balanced accuracy, ROC AUC, and threshold analysis together.'), "
        "(2, 'high', 'Treat the current classifier as a ranking signal, not a final automated decision.', "
        "'Balanced accuracy is close to random because the no-reorder class is hard to detect. "
        "Use the probability score for prioritization until richer negative-class features are added.'), "
        "(3, 'medium', 'Add richer behavioral features such as recency, product affinity, and department mix.', "
        "'Improves separation between likely reorders and customers who may churn.'), "
        "(4, 'medium', 'Tune the prediction threshold based on campaign goals.', "
        "'Lower thresholds catch more potential reorderers; higher thresholds reduce false positives "
        "for expensive retention campaigns.'), "
        "(5, 'medium', 'Reduce dependence on only a few features.', "
        "'A broader feature set usually makes the model more stable and easier to explain to business users.')"
        ") t(rule_no, priority, action, expected_impact) "
        "where case rule_no when 1 then positive_rate >= 0.8 when 2 then balanced_accuracy < 0.6 "
        "when 3 then roc_auc < 0.72 when 4 then recall < precision "
        "else (select sum(importance) from (select importance from gap_all order by importance desc limit 2)) > 0.85 "
        "end", **_TWO),
    "driver_share": _sql(
        "select sum(importance) as top_share from (select * from gap_all order by importance desc, feature limit 3)",
        "top_share"),
    "evaluation_record": _sql("select * from runs", _RUN_DOUBLES + " positive_rate", "test_rows", **_RUNS),
    "run_history": _sql("select * exclude (positive_rate) from runs", _RUN_DOUBLES, "test_rows", **_RUNS),
    "drift_findings": _sql("select * from worse", "delta previous_value current_value", **_RUNS),
    "feature_drift": _sql("select * from moved", "delta previous_value current_value", **_RUNS),
    "drift_status": _sql("select * from statuses", "top_feature_importance roc_auc_delta previous_brier_score", "findings", **_RUNS),
    "metric_unpivot": _sql(
        "select run_timestamp, metric, v as value from run_values where v is not null "
        "and metric in ('roc_auc', 'f1', 'balanced_accuracy', 'precision', 'recall') and run_timestamp in "
        "(select run_timestamp from runs order by run_timestamp desc limit 12)", "value", **_RUNS),
    "run_record": _sql(
        "select md5('fct_orders|' || strftime(run_timestamp, '%Y-%m-%d %H:%M:%S')) as run_id, "
        "cast(run_timestamp as timestamptz) as run_timestamp, runs.selected_model, "
        "'roc_auc' as model_selection_metric, 'fct_orders' as source_relation, train_rows, test_rows, threshold, "
        "runs.top_feature, one.roc_auc as roc_auc_in_payload, one.f1 as f1_in_payload, "
        "one.recommended_threshold as recommended_threshold_in_payload, "
        "one.positive_prediction_rate as positive_prediction_rate_in_payload, one.tp as tp_in_payload, "
        "(select count(*) from placed_features x where x.run_timestamp = runs.run_timestamp)::integer as features, "
        "fa.feature as first_feature, fb.share as second_importance, two.model as second_model, two.roc_auc as second_roc_auc, "
        "status as status_in_report, runs.top_feature as feature_in_report, "
        "(select if(u is null, null, v) from run_values x where x.run_timestamp = runs.run_timestamp and metric = 'f1') as f1_in_report, "
        "strftime(previous_run_timestamp, '%Y-%m-%d %H:%M:%S') as previous_in_report, findings::integer as findings_in_report "
        "from runs join statuses using (run_timestamp) "
        "join placed_models one on one.run_timestamp = runs.run_timestamp and one.place = 1 "
        "join placed_models two on two.run_timestamp = runs.run_timestamp and two.place = 2 "
        "join placed_features fa on fa.run_timestamp = runs.run_timestamp and fa.place = 1 "
        "join placed_features fb on fb.run_timestamp = runs.run_timestamp and fb.place = 2",
        "threshold roc_auc_in_payload f1_in_payload recommended_threshold_in_payload positive_prediction_rate_in_payload "
        "tp_in_payload second_importance second_roc_auc f1_in_report", "test_rows", **_RUNS),
    "detect_anomalies": _sql(
        "select user_id, cast(row_number() over (partition by user_id order by k) as integer) as signal_no, metric, "
        "value, priority as severity, description, if(metric = 'api_health', 'unhealthy', null) as value_text "
        "from signals join levels using (level)", "value"),
    "build_decisions": _sql("select * exclude (titre) from placed"),
    "rank_decisions": _sql("select user_id, priority, title from placed where place = 1"),
    "normalize_priority": _sql(
        "select user_id, priority from (select s.user_id, coalesce(max(t.level), 1) as level from signals_in s "
        "left join (select *, row_number() over (partition by user_id order by k) as no from signals) t "
        "on t.user_id = s.user_id and t.no <= 3 group by s.user_id) join levels using (level)"),
    "decision_explanation": _sql(
        "select p.user_id, 'Decision engine produced ' || (select count(*) from placed x where x.user_id = p.user_id) "
        "|| ' decision(s) from ' || (select count(*) from signals y where y.user_id = p.user_id) "
        "|| ' anomaly signal(s). The highest priority is ' || p.priority || '. Recommended first action: ' "
        "|| p.title || '.' as explanation from placed p where place = 1"),
    "translate_labels": _sql("select user_id, place, titre as title from placed"),
    "decision_counts": _sql(
        "select s.user_id, (select count(*) from signals y where y.user_id = s.user_id)::integer as anomalies, "
        "(select count(*) from placed x where x.user_id = s.user_id and decision_type = 'alert')::integer as alerts, "
        "(select count(*) from placed x where x.user_id = s.user_id and decision_type = 'recommendation')::integer "
        "as recommendations from signals_in s"),
    "priority_mix": _sql(
        "select l.priority, count(d.user_id) as count from levels l left join all_decided d on d.level = l.level "
        "group by l.priority"),
    "operational_signals": _sql(
        "select customer_segment, cast(row_number() over (partition by customer_segment order by level desc, k) "
        "as integer) as place, decision_type, priority, title, metric "
        "from segment_decided join levels using (level) join wording using (metric)",
        segment_means="select customer_segment, avg(reorder_ratio) as r, avg(days_between_orders) as d "
        "from behave group by 1",
        segment_decided="select customer_segment, 1 as k, 'alert' as decision_type, 4 as level, "
        "'data_quality_failures' as metric from segment_means "
        "where exists (select 1 from checks where invalid_count > 0) "
        "union all select customer_segment, 3, 'recommendation', 3, 'retention_risk' "
        "from segment_means where (r <> 0 and r < 0.35::double) or d >= 21"),
    "model_constraints": _sql(
        "select *, if(invalid_count = 0, 'Passed', 'Failed') as status from (" + " union all ".join(
            [f"select '{t}' as table_name, '{c}_not_null' as check_name, count(*) - count({c}) as invalid_count "
             f"from {block}" for t, (block, _, required) in _MODELS.items() for c in required]
            + [f"select '{t}', '{key}_unique', count(*) from (select 1 from {block} where {key} is not null "
               f"group by {key} having count(*) > 1)" for t, (block, key, _) in _MODELS.items() if key]) + ")"),
    "row_count_inventory": _sql(" union all ".join(
        f"select '{t}' as table_name, count(*) as row_count from {block}" for t, block in {
            "raw_orders": "orders", "raw_products": "part", "raw_order_products": "lineitem",
            "raw_aisles": "(select distinct p_type from part)",
            "raw_departments": "(select distinct p_brand from part)",
            **{t: block for t, (block, _, _) in _MODELS.items() if not t.startswith("stg_")}}.items())),
    "drift_summary": _sql(
        "select count(*) over () as run_count, "
        "md5('fct_orders|' || strftime(run_timestamp, '%Y-%m-%d %H:%M:%S')) as current_run_id, "
        "cast(run_timestamp as timestamptz) as current_run_timestamp, "
        "md5('fct_orders|' || strftime(lag(run_timestamp) over t, '%Y-%m-%d %H:%M:%S')) as previous_run_id, "
        "cast(lag(run_timestamp) over t as timestamptz) as previous_run_timestamp, runs.selected_model, "
        "'roc_auc' as model_selection_metric, 'fct_orders' as source_relation, null::varchar as model_artifact_uri, "
        "status as drift_status, summary as drift_summary, "
        + "".join(
            f"{c}, lag({c}) over t as previous_{c}, {c} - lag({c}) over t as {c}_delta, "
            for c in ("roc_auc", "balanced_accuracy", "brier_score", "top_feature_importance"))
        + "precision, recall, f1, top_feature, lag(top_feature) over t as previous_top_feature, found as drift_found "
        "from runs join (select run_timestamp, status, summary, found from statuses) using (run_timestamp) window t as (order by run_timestamp) "
        "qualify row_number() over (order by run_timestamp desc) = 1",
        "precision recall f1 " + " ".join(
            f"{c} previous_{c} {c}_delta"
            for c in ("roc_auc", "balanced_accuracy", "brier_score", "top_feature_importance")), **_RUNS),
    "classify_questions": """
        select conv_id, turn, (['churn', 'retention', 'clv', 'top_products', 'reorder_trend', 'top_products',
            'customer_behavior', 'retention', 'general'])[conv_id % 9 + 1] as category
        from conversations where role = 'user'""",
    "text_footprint": _sql(
        "select conv_id, c / 1000 * 0.002 + u * 0.2 as estimated_gco2e, n as message_count, c / 1000 as text_units, "
        "u as ai_calls, 0 as decision_runs from (select conv_id, sum(length(role) + length(text)) as c, "
        "count(*) as n, count(*) filter (role = 'user') as u from conversations group by conv_id)",
        "estimated_gco2e text_units"),
    "parse_events": """
        select 'ev-' || event_id as event_id, event_type, event_id * 7 as order_id, user_id,
            event_id % 30 + 1 as order_number, event_id % 7 as order_dow, event_id % 24 as order_hour_of_day,
            if(event_id % 50 = 3, null, event_id % 20) as item_count, event_id % 5 as reordered_item_count,
            strftime(ts, '%Y-%m-%dT%H:%M:%S') as created_at
        from events where event_id % 50 not in (1, 2)""",
    "dead_letter": """
        select if(event_id % 50 = 1, 'Invalid JSON event', 'Missing required event fields: user_id') as reason,
            count(*) as messages from events where event_id % 50 in (1, 2) group by 1""",
}
