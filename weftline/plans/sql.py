"""DuckDB text of the domain tables; an oracle is this preamble and one SELECT."""

from weftline.sources.tables import ATTRIBUTES, CORE_TYPES, LEVELS, RELATIONS

_in = lambda names: ", ".join(f"'{x}'" for x in names)
_levels = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEVELS.items())
_hierarchy = " UNION ALL ".join(f"SELECT '{p}::' || {p} AS parent_attr_id, '{c}::' || {c} AS child_attr_id, '{p}' AS parent_attr_type, '{c}' AS child_attr_type, '{r}' AS relation_type FROM art" for p, c, r in RELATIONS)



def _around(side: str, target: str, other: str) -> str:
    """Edge-weighted means over parents or children in the same week."""
    means = ", ".join(f"sum({c} * edge_weight) / sum(edge_weight) AS {side}_{n}" for c, n in (("heat_t", "heat"), ("share_t", "share"), ("growth_lag_1", "growth"), ("rank_pct", "rank_pct")))
    return f"{side}m AS (SELECT week_id, {target} AS attr_id, {means} FROM kbase JOIN hier ON attr_id = {other} GROUP BY 1, 2)"


def _wide(side: str) -> str:
    return ", ".join(f"coalesce({side}_{short}, 0) AS kg_{side}_{long}_wavg" for short, long in (("heat", "heat_t"), ("share", "share_t"), ("growth", "growth_lag_1"), ("rank_pct", "rank_pct_t")))


def _gaps(side: str) -> str:
    return f"coalesce(share_t - {side}_share, 0) AS kg_self_{side}_share_gap_t, coalesce(growth_lag_1 - {side}_growth, 0) AS kg_self_{side}_growth_gap_lag_1"


TREND = f"""WITH raw AS (
  SELECT CAST(o_orderdate AS DATE) AS t_dat, lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS customer_id, lpad(CAST(l_partkey AS VARCHAR), 10, '0') AS article_id,
         l_extendedprice AS price, CAST(l_linenumber % 2 + 1 AS INTEGER) AS sales_channel_id
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
tx AS (SELECT t_dat, CAST(datediff('day', (SELECT min(t_dat) FROM raw), t_dat) // 7 AS BIGINT) AS week_id, customer_id, article_id, price, sales_channel_id FROM raw),
art AS (
  SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS article_id, p_name AS product_code, p_name AS prod_name, p_type AS product_group_name, split_part(p_name, ' ', 2) AS product_type_name,
         'size_' || CAST(p_size // 10 AS VARCHAR) AS garment_group_name, split_part(p_name, ' ', 1) AS colour_group_name, p_brand AS graphical_appearance_name, substr(p_name, 1, 1) AS perceived_colour_master_name,
         'G' || CAST(n % 3 AS VARCHAR) AS index_group_name, 'I' || CAST(n % 6 AS VARCHAR) AS index_name, 'S' || CAST(n % 12 AS VARCHAR) AS section_name, p_brand AS department_name
  FROM (SELECT *, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS n FROM part)),
rawcust AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS customer_id, CASE WHEN c_acctbal >= 0 THEN CAST(CAST(floor(c_acctbal / 125) AS BIGINT) AS VARCHAR) END AS age, c_mktsegment AS club_member_status,
         CASE c_nationkey % 3 WHEN 0 THEN 'Regularly' WHEN 1 THEN 'NONE' ELSE '  ' END AS news_frequency FROM customer),
edges AS (
  SELECT article_id, 'article_' || article_id AS article_node_id, attr_type || '::' || attr_value AS attr_id, attr_type, attr_value, 'has_' || regexp_replace(attr_type, '_name$', '') AS edge_type, CAST(1.0 AS DOUBLE) AS edge_weight
  FROM (UNPIVOT (SELECT article_id, {", ".join(ATTRIBUTES)} FROM art) ON {", ".join(ATTRIBUTES)} INTO NAME attr_type VALUE attr_value)),
nodes AS (
  SELECT attr_id, attr_type, attr_value, attr_id AS attr_node_id, count(*) AS article_count, CAST(attr_type IN ({_in(CORE_TYPES)}) AS INTEGER) AS is_core_attr, CASE attr_type {_levels} END AS level
  FROM edges GROUP BY attr_id, attr_type, attr_value),
hier AS (SELECT parent_attr_id, child_attr_id, parent_attr_type, child_attr_type, relation_type, count(*) AS edge_weight FROM ({_hierarchy}) GROUP BY ALL),
degree AS (
  SELECT attr_id, article_count, is_core_attr, coalesce(u, 0) AS parent_count, coalesce(d, 0) AS child_count, coalesce(u, 0) + coalesce(d, 0) AS degree FROM nodes
  LEFT JOIN (SELECT child_attr_id AS attr_id, count(*) AS u FROM hier GROUP BY 1) USING (attr_id) LEFT JOIN (SELECT parent_attr_id AS attr_id, count(*) AS d FROM hier GROUP BY 1) USING (attr_id)),
sales AS (SELECT week_id, article_id, count(*) AS sales_cnt, count(DISTINCT customer_id) AS sales_user_cnt, sum(price) AS sales_amount FROM tx GROUP BY 1, 2),
observed AS (SELECT week_id, attr_id, CAST(sum(sales_cnt) AS BIGINT) AS heat_cnt FROM sales JOIN edges USING (article_id) GROUP BY 1, 2),
filled AS (
  SELECT week_id, attr_id, attr_type, attr_value, coalesce(heat_cnt, 0) AS heat_cnt
  FROM (SELECT DISTINCT week_id FROM sales) CROSS JOIN nodes LEFT JOIN observed USING (week_id, attr_id)),
totalled AS (SELECT *, CAST(sum(heat_cnt) OVER (PARTITION BY week_id, attr_type) AS BIGINT) AS type_total_heat FROM filled),
heat AS MATERIALIZED (
  SELECT *, CASE WHEN type_total_heat = 0 THEN 0.0 ELSE CAST(heat_cnt AS DOUBLE) / type_total_heat END AS heat_share, ln(1 + heat_cnt) AS log_heat,
         row_number() OVER (PARTITION BY week_id, attr_type ORDER BY heat_cnt DESC, attr_id) AS rank_in_type FROM totalled),
target AS (
  SELECT a.week_id, a.attr_id, a.attr_type, a.attr_value, a.heat_cnt AS heat_t, b.heat_cnt AS heat_t1, a.heat_share AS share_t, b.heat_share AS share_t1, a.rank_in_type AS rank_in_type_t, b.log_heat AS target_log_heat_t1,
         ln((b.heat_share + 1e-6) / (a.heat_share + 1e-6)) AS target_growth, b.rank_in_type AS target_rank_in_type_t1
  FROM heat a JOIN heat b ON b.attr_id = a.attr_id AND b.week_id = a.week_id + 1),
lagged AS (
  SELECT week_id, attr_id, attr_type, attr_value, heat_cnt AS heat_t, heat_share AS share_t, log_heat AS log_heat_t, rank_in_type AS rank_in_type_t,
         {", ".join(f"lag(heat_cnt, {k}) OVER w AS heat_lag_{k}, lag(heat_share, {k}) OVER w AS share_lag_{k}" for k in (1, 2, 3, 4))},
         CASE WHEN count(*) OVER four = 4 THEN avg(heat_cnt) OVER four END AS heat_ma_4, CASE WHEN count(*) OVER four = 4 THEN avg(heat_share) OVER four END AS share_ma_4,
         CASE WHEN count(*) OVER four = 4 THEN stddev_pop(heat_share) OVER four END AS share_std_4, CASE WHEN count(*) OVER four = 4 THEN max(heat_share) OVER four END AS share_max_4,
         CASE WHEN count(*) OVER four = 4 THEN min(heat_share) OVER four END AS share_min_4,
         CAST(sum(heat_cnt) OVER past AS BIGINT) AS history_total_heat_t, CAST(sum(CAST(heat_cnt > 0 AS INTEGER)) OVER past AS BIGINT) AS history_active_weeks_t
  FROM heat WINDOW w AS (PARTITION BY attr_id ORDER BY week_id), four AS (PARTITION BY attr_id ORDER BY week_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), past AS (PARTITION BY attr_id ORDER BY week_id ROWS UNBOUNDED PRECEDING)),
feats AS (
  SELECT *, growth_lag_1 - growth_lag_2 AS acc_lag_1 FROM (
    SELECT *, ln((share_t + 1e-6) / (share_lag_1 + 1e-6)) AS growth_lag_1, ln((share_lag_1 + 1e-6) / (share_lag_2 + 1e-6)) AS growth_lag_2,
           history_total_heat_t >= 100 AND history_active_weeks_t >= 8 AS is_trend_eligible_t, week_id AS week_index, week_id % 52 AS week_mod_52 FROM lagged)),
samples AS (
  SELECT f.*, article_count, is_core_attr, parent_count, child_count, degree, target_growth, target_log_heat_t1, target_rank_in_type_t1
  FROM feats f JOIN target t ON t.week_id = f.week_id AND t.attr_id = f.attr_id JOIN degree d ON d.attr_id = f.attr_id WHERE f.week_id >= 4),
split AS (
  SELECT CASE WHEN week_id > last - 8 THEN 'test' WHEN week_id > last - 16 THEN 'valid' ELSE 'train' END AS split, s.* EXCLUDE (last) FROM (SELECT *, (SELECT max(week_id) FROM samples) AS last FROM samples) s),
rawpred AS (
  SELECT *, 'last_week' AS model_name, CAST(NULL AS DOUBLE) AS g, greatest(share_t, 0.0) AS raw_share FROM split
  UNION ALL SELECT *, 'previous_growth', growth_lag_1, greatest(exp(growth_lag_1) * (share_t + 1e-6) - 1e-6, 0.0) FROM split
  UNION ALL SELECT *, 'moving_average', (growth_lag_1 + growth_lag_2) / 2, greatest(exp((growth_lag_1 + growth_lag_2) / 2) * (share_t + 1e-6) - 1e-6, 0.0) FROM split),
pred AS (
  SELECT week_id, attr_id, attr_type, attr_value, model_name, split, share_t, p AS pred_share_t1, target_growth, coalesce(g, ln((p + 1e-6) / (share_t + 1e-6))) AS pred_target_growth, target_rank_in_type_t1
  FROM (SELECT *, CASE WHEN total = 0 THEN 0.0 ELSE raw_share / total END AS p FROM (SELECT *, sum(raw_share) OVER (PARTITION BY model_name, split, week_id, attr_type) AS total FROM rawpred))),
ranked AS (
  SELECT *, row_number() OVER (g ORDER BY round(pred_target_growth, 9) DESC, attr_id) AS pr, row_number() OVER (g ORDER BY round(target_growth, 9) DESC, attr_id) AS tr, count(*) OVER g AS n, target_growth - min(target_growth) OVER g AS gain,
         rank() OVER (g ORDER BY round(pred_target_growth, 9)) + (count(*) OVER (PARTITION BY model_name, split, week_id, attr_type, round(pred_target_growth, 9)) - 1) / 2.0 AS ra,
         rank() OVER (g ORDER BY round(target_growth, 9)) + (count(*) OVER (PARTITION BY model_name, split, week_id, attr_type, round(target_growth, 9)) - 1) / 2.0 AS rb
  FROM pred WINDOW g AS (PARTITION BY model_name, split, week_id, attr_type)),
centred AS (SELECT *, ra - avg(ra) OVER g AS ca, rb - avg(rb) OVER g AS cb FROM ranked WINDOW g AS (PARTITION BY model_name, split, week_id, attr_type)),
groups AS (
  SELECT model_name, split, week_id, attr_type, avg(abs(pred_target_growth - target_growth)) AS mae, sqrt(avg((pred_target_growth - target_growth) ** 2)) AS rmse,
         CASE WHEN sum(ca * ca) * sum(cb * cb) > 0 THEN sum(ca * cb) / sqrt(sum(ca * ca) * sum(cb * cb)) END AS spearman,
         {", ".join(f'''sum(CAST(pr <= {k} AND tr <= {k} AS INTEGER)) / CAST(least({k}, max(n)) AS DOUBLE) AS precision_at_{k}, sum(CAST(pr <= {k} AND tr <= {k} AS INTEGER)) / CAST(least({k}, max(n)) AS DOUBLE) AS recall_at_{k},
         CASE WHEN max(gain) > 0 THEN sum(CASE WHEN pr <= {k} THEN gain / log2(pr + 1) ELSE 0 END) / sum(CASE WHEN tr <= {k} THEN gain / log2(tr + 1) ELSE 0 END) END AS ndcg_at_{k}''' for k in (5, 10, 20))}
  FROM centred GROUP BY ALL),
kbase AS MATERIALIZED (SELECT week_id, attr_id, heat_t, share_t, growth_lag_1, (rank_in_type_t - 1) / CAST(greatest(count(*) OVER (PARTITION BY week_id, attr_type) - 1, 1) AS DOUBLE) AS rank_pct FROM samples),
sib AS (SELECT a.child_attr_id AS attr_id, b.child_attr_id AS sibling_id, CAST(sum(a.edge_weight * b.edge_weight) AS DOUBLE) AS weight FROM hier a JOIN hier b ON a.parent_attr_id = b.parent_attr_id AND a.child_attr_id <> b.child_attr_id GROUP BY 1, 2),
{_around("parent", "child_attr_id", "parent_attr_id")},
{_around("child", "parent_attr_id", "child_attr_id")},
sibs AS (
  SELECT b.week_id, b.attr_id, count(DISTINCT sibling_id) AS sibling_count, sum(o.share_t * weight) / sum(weight) AS sibling_share, sum(o.growth_lag_1 * weight) / sum(weight) AS sibling_growth, sum(o.rank_pct * weight) / sum(weight) AS sibling_rank_pct,
         max(o.share_t) AS sibling_max_share, first(b.share_t) - sum(o.share_t * weight) / sum(weight) AS sibling_share_gap, first(b.growth_lag_1) - sum(o.growth_lag_1 * weight) / sum(weight) AS sibling_growth_gap
  FROM kbase b JOIN sib USING (attr_id) JOIN kbase o ON o.week_id = b.week_id AND o.attr_id = sibling_id GROUP BY 1, 2),
structure AS (
  SELECT attr_id, CAST(coalesce(u, 0) AS BIGINT) AS parent_weight, CAST(coalesce(d, 0) AS BIGINT) AS child_weight FROM nodes
  LEFT JOIN (SELECT child_attr_id AS attr_id, sum(edge_weight) AS u FROM hier GROUP BY 1) USING (attr_id) LEFT JOIN (SELECT parent_attr_id AS attr_id, sum(edge_weight) AS d FROM hier GROUP BY 1) USING (attr_id)),
context AS (
  SELECT week_id, attr_id, {_wide("parent")}, {_wide("child")}, {_gaps("parent")}, {_gaps("child")},
         coalesce(sibling_count, 0) AS kg_sibling_count, coalesce(sibling_share, 0) AS kg_sibling_share_t_wavg, coalesce(sibling_max_share, 0) AS kg_sibling_share_t_max, coalesce(sibling_growth, 0) AS kg_sibling_growth_lag_1_wavg,
         coalesce(sibling_rank_pct, 0) AS kg_sibling_rank_pct_t_wavg, coalesce(sibling_share_gap, 0) AS kg_self_vs_sibling_share_gap_t, coalesce(sibling_growth_gap, 0) AS kg_self_vs_sibling_growth_gap_lag_1, CAST(sibling_count IS NOT NULL AS BIGINT) AS kg_has_sibling,
         CAST(parent_weight AS DOUBLE) AS kg_parent_edge_weight_sum, CAST(child_weight AS DOUBLE) AS kg_child_edge_weight_sum, ln(1 + parent_weight) AS kg_parent_edge_weight_log, ln(1 + child_weight) AS kg_child_edge_weight_log,
         CAST(parent_weight > 0 AS BIGINT) AS kg_has_parent, CAST(child_weight > 0 AS BIGINT) AS kg_has_child, CAST(parent_weight = 0 AS BIGINT) AS kg_is_root_attr, CAST(child_weight = 0 AS BIGINT) AS kg_is_leaf_attr
  FROM kbase LEFT JOIN parentm USING (week_id, attr_id) LEFT JOIN childm USING (week_id, attr_id) LEFT JOIN sibs USING (week_id, attr_id) LEFT JOIN structure USING (attr_id))
"""


def rounds(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round({x}, {digits}) AS {x}" for x in names)


def half_up(value: str, digits: int = 6) -> str:
    """Rounds in decimals, half away from zero, as ``functions.expr.half_up`` does: means that lie half-way in exact terms round alike."""
    return f"CAST(round(CAST({value} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"
