"""DuckDB text of the recommendation tables, after the preamble of the trend half."""

from weftline.operators.reco import FILL, METHODS, METRICS, SCORES, SOURCES, STRATEGY, TREND_WEIGHTS
from weftline.plans.sql import TREND, half_up
from weftline.sources.tables import CORE_TYPES

_core = ", ".join(f"'{x}'" for x in CORE_TYPES)
_u = "split, cutoff_week, label_week, customer_id"
_w = "split, cutoff_week, label_week"
_place = "CASE source " + " ".join(f"WHEN '{s}' THEN {k}" for k, s in enumerate(SOURCES)) + " END"
_weight = "CASE attr_type " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in TREND_WEIGHTS.items()) + " END"


def norm(rank: str, cap: int) -> str:
    return f"greatest(0.0, least(1.0, ({cap} - {rank} + 1) / CAST({cap} AS DOUBLE)))"


def minmax(x: str, group: str) -> str:
    return f"CASE WHEN max({x}) OVER ({group}) = min({x}) OVER ({group}) THEN 0.0 ELSE ({x} - min({x}) OVER ({group})) / (max({x}) OVER ({group}) - min({x}) OVER ({group})) END"


PU, PW = f"PARTITION BY {_u}", f"PARTITION BY {_w}"


def ranked(weights: dict[str, float]) -> str:
    """The first 12 of each user by the weighted sum, of the candidates kept by the source policy."""
    total = " + ".join(f"{c} * {w}" for c, w in weights.items())
    return f"SELECT * FROM (SELECT {_u}, article_id, score, row_number() OVER ({PU} ORDER BY round(score, 9) DESC, article_id) AS rank FROM (SELECT *, {total} AS score FROM feat WHERE NOT is_seen OR has_reorder_source)) WHERE rank <= 12"


RECO = TREND + f""", cust AS (
  SELECT customer_id, TRY_CAST(age AS DOUBLE) AS age, CASE WHEN TRY_CAST(age AS DOUBLE) IS NULL OR TRY_CAST(age AS DOUBLE) < 0 THEN 'unknown' WHEN TRY_CAST(age AS DOUBLE) < 20 THEN '0-19' WHEN TRY_CAST(age AS DOUBLE) < 60 THEN CAST(CAST(floor(TRY_CAST(age AS DOUBLE) / 10) * 10 AS INTEGER) AS VARCHAR) || '-' || CAST(CAST(floor(TRY_CAST(age AS DOUBLE) / 10) * 10 + 9 AS INTEGER) AS VARCHAR) ELSE '60+' END AS age_bucket,
         coalesce(nullif(trim(club_member_status), ''), 'unknown') AS club_member_status, coalesce(nullif(trim(news_frequency), ''), 'unknown') AS news_frequency FROM rawcust),
win AS (SELECT DISTINCT split, week_id AS cutoff_week, week_id + 1 AS label_week FROM split WHERE split IN ('valid', 'test')),
cw AS (SELECT customer_id, week_id, count(*) AS n FROM tx GROUP BY 1, 2),
users AS (
  SELECT * FROM (SELECT {_u}, CAST(sum(CASE WHEN week_id <= cutoff_week THEN n ELSE 0 END) AS BIGINT) AS history_purchase_count, CAST(sum(CASE WHEN week_id = label_week THEN n ELSE 0 END) AS BIGINT) AS label_purchase_count
  FROM cw JOIN win ON week_id <= label_week GROUP BY ALL) WHERE history_purchase_count > 0 AND label_purchase_count > 0),
truth AS (SELECT DISTINCT u.split, u.cutoff_week, u.label_week, u.customer_id, article_id FROM users u JOIN tx ON tx.customer_id = u.customer_id AND tx.week_id = u.label_week),
core AS (SELECT article_id, attr_id, attr_type, attr_value FROM edges WHERE attr_type IN ({_core})),
bought AS (SELECT customer_id, article_id, week_id, count(*) AS n FROM tx GROUP BY 1, 2, 3),
hist AS (
  SELECT u.split, u.cutoff_week, u.label_week, u.customer_id, article_id, max(week_id) AS last_week, CAST(sum(n) AS BIGINT) AS n FROM users u JOIN bought b ON b.customer_id = u.customer_id AND week_id <= cutoff_week GROUP BY ALL),
prefs AS (
  SELECT {_u}, attr_id, attr_type, attr_value, CAST(sum(n) AS BIGINT) AS purchase_count, max(last_week) AS last_purchase_week FROM hist JOIN core USING (article_id) GROUP BY ALL),
profile AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER ({PU} ORDER BY round(preference_score, 9) DESC, purchase_count DESC, last_purchase_week DESC, attr_id) AS rn
  FROM (SELECT *, purchase_count / CAST(sum(purchase_count) OVER ({PU}) AS DOUBLE) AS preference_score FROM prefs)) WHERE rn <= 3),
wpop AS (SELECT week_id, article_id, count(*) AS n FROM tx GROUP BY 1, 2),
pop AS (SELECT {_w}, article_id, CAST(sum(n) AS BIGINT) AS n FROM wpop JOIN win ON week_id <= cutoff_week GROUP BY ALL),
rpop AS (SELECT {_w}, article_id, CAST(sum(n) AS BIGINT) AS n FROM wpop JOIN win ON week_id <= cutoff_week AND week_id > cutoff_week - 4 GROUP BY ALL),
firstw AS (SELECT customer_id, article_id, min(week_id) AS first_week FROM tx GROUP BY 1, 2),
pool AS (SELECT {_w}, article_id FROM (SELECT article_id, min(week_id) AS w FROM tx GROUP BY 1) JOIN win ON w <= cutoff_week),
poprank AS (SELECT *, row_number() OVER ({PW} ORDER BY n DESC, article_id) AS rn FROM pop),
rpoprank AS (SELECT *, row_number() OVER ({PW} ORDER BY n DESC, article_id) AS rn FROM rpop),
s_pop AS (SELECT {_u}, article_id, 'popularity' AS source, rn AS source_rank FROM users JOIN poprank USING ({_w}) WHERE rn <= 12),
s_recent AS (SELECT {_u}, article_id, 'popularity' AS source, rn AS source_rank FROM users JOIN rpoprank USING ({_w}) WHERE rn <= 12),
few AS (SELECT * FROM (SELECT attr_id, article_id, row_number() OVER (PARTITION BY attr_id ORDER BY article_id) AS rn FROM core) WHERE rn <= 12),
s_sim AS (
  SELECT {_u}, article_id, 'similarity' AS source, rn AS source_rank FROM (SELECT *, row_number() OVER ({PU} ORDER BY round(score, 9) DESC, article_id) AS rn
  FROM (SELECT {_u}, article_id, sum(preference_score) AS score FROM profile JOIN few USING (attr_id) GROUP BY ALL)) WHERE rn <= 12),
ma AS (SELECT * FROM pred WHERE model_name = 'moving_average'),
wpred AS (SELECT w.split, w.cutoff_week, w.label_week, attr_id, attr_type, pred_target_growth FROM ma JOIN win w ON ma.split = w.split AND week_id = cutoff_week),
tscore AS (SELECT {_w}, article_id, max(pred_target_growth) AS score FROM wpred JOIN core USING (attr_id) GROUP BY ALL),
s_trend AS (SELECT {_u}, article_id, 'trend' AS source, rn AS source_rank FROM users JOIN (SELECT *, row_number() OVER ({PW} ORDER BY round(score, 9) DESC, article_id) AS rn FROM tscore) USING ({_w}) WHERE rn <= 12),
s_reorder AS (SELECT {_u}, article_id, 'reorder' AS source, rn AS source_rank FROM (SELECT *, row_number() OVER ({PU} ORDER BY last_week DESC, n DESC, article_id) AS rn FROM hist) WHERE rn <= 12),
prodmap AS (SELECT DISTINCT article_id, product_code FROM art WHERE product_code <> ''),
offered AS (SELECT {_w}, article_id, product_code, coalesce(n, 0) AS n FROM prodmap CROSS JOIN win LEFT JOIN pop USING ({_w}, article_id)),
seeds AS (SELECT {_u}, s.article_id AS seed_id, source_rank AS seed_rank, product_code FROM s_reorder s JOIN prodmap USING (article_id) WHERE source_rank <= 6),
variants AS (
  SELECT * FROM (SELECT {_u}, article_id, seed_id, seed_rank, n, row_number() OVER ({PU}, seed_id ORDER BY n DESC, article_id) AS rn
  FROM seeds JOIN offered USING ({_w}, product_code) WHERE article_id <> seed_id) WHERE rn <= 3),
s_variant AS (
  SELECT {_u}, article_id, 'product_variant' AS source, rn AS source_rank FROM (SELECT *, row_number() OVER ({PU} ORDER BY n DESC, seed_rank, article_id) AS rn
  FROM (SELECT {_u}, article_id, max(n) AS n, min(seed_rank) AS seed_rank FROM variants GROUP BY ALL)) WHERE rn <= 12),
agepool AS (
  SELECT * FROM (SELECT *, row_number() OVER ({PW}, age_bucket ORDER BY n DESC, article_id) AS rn
  FROM (SELECT {_w}, age_bucket, article_id, count(*) AS n FROM tx JOIN cust USING (customer_id) JOIN win ON week_id <= cutoff_week AND week_id > cutoff_week - 4 GROUP BY ALL)) WHERE rn <= 50),
s_age AS (SELECT {_u}, article_id, 'age_popularity' AS source, rn AS source_rank FROM users JOIN cust USING (customer_id) JOIN agepool USING ({_w}, age_bucket) WHERE rn <= 12),
attrpool AS (SELECT * FROM (SELECT {_w}, attr_id, article_id, n, row_number() OVER ({PW}, attr_id ORDER BY n DESC, article_id) AS attr_rank FROM rpop JOIN core USING (article_id)) WHERE attr_rank <= 4),
s_pref AS (
  SELECT {_u}, article_id, 'preference_popularity' AS source, rn AS source_rank FROM (SELECT *, row_number() OVER ({PU} ORDER BY round(p, 9) DESC, n DESC, article_id) AS rn
  FROM (SELECT {_u}, article_id, max(preference_score) AS p, max(n) AS n FROM profile JOIN attrpool USING ({_w}, attr_id) GROUP BY ALL)) WHERE rn <= 12),
allsources AS (SELECT *, {_place} AS place FROM (SELECT * FROM s_recent UNION ALL SELECT * FROM s_sim UNION ALL SELECT * FROM s_trend UNION ALL SELECT * FROM s_reorder UNION ALL SELECT * FROM s_variant UNION ALL SELECT * FROM s_age UNION ALL SELECT * FROM s_pref)),
cand AS (
  SELECT {_w}, 'enhanced_default' AS strategy, customer_id, article_id, string_agg(source, '|' ORDER BY place) AS candidate_sources, arg_min(source, source_rank * 10 + place) AS primary_source, min(source_rank) AS best_source_rank,
         CAST(sum(1 << place) AS INTEGER) AS mask, bool_or(source = 'reorder') AS has_reorder_source FROM allsources GROUP BY ALL),
vscore AS (
  SELECT {_u}, article_id, 0.7 * {norm("rn", 12)} + 0.3 * {norm("seed_rank", 6)} AS v FROM (SELECT *, row_number() OVER ({PU} ORDER BY n DESC, seed_rank, article_id) AS rn
  FROM (SELECT {_u}, article_id, max(n) AS n, min(seed_rank) AS seed_rank FROM (SELECT {_u}, article_id, product_code FROM cand JOIN prodmap USING (article_id) WHERE mask & 16 > 0) JOIN seeds USING ({_u}, product_code) JOIN offered USING ({_w}, product_code, article_id) WHERE article_id <> seed_id GROUP BY ALL))),
atrend AS (
  SELECT {_w}, article_id, sum(g * w) / sum(w) AS v FROM (SELECT *, {_weight} AS w, {minmax("pred_target_growth", PW + ", attr_type")} AS g FROM wpred WHERE attr_type IN ({_core})) JOIN core USING (attr_id) GROUP BY ALL),
f1 AS (
  SELECT c.*, coalesce(first_week <= c.cutoff_week, false) AS is_seen, CAST(coalesce(pop.n, 0) AS DOUBLE) AS p, CAST(coalesce(rpop.n, 0) AS DOUBLE) AS r, coalesce(s.v, 0.0) AS s, coalesce(t.v, 0.0) AS trend_score,
         CASE WHEN has_reorder_source THEN coalesce(o.v, 0.0) ELSE 0.0 END AS o, coalesce(v.v, 0.0) AS v, coalesce(a.v, 0.0) AS a, coalesce(q.v, 0.0) AS q, {norm("best_source_rank", 12)} AS k, bit_count(mask) / CAST(bit_count(bit_or(mask) OVER ({PW.replace("split, cutoff_week, label_week", "c.split, c.cutoff_week, c.label_week")})) AS DOUBLE) AS m
  FROM cand c LEFT JOIN firstw f ON f.customer_id = c.customer_id AND f.article_id = c.article_id
  LEFT JOIN pop ON pop.split = c.split AND pop.cutoff_week = c.cutoff_week AND pop.article_id = c.article_id LEFT JOIN rpop ON rpop.split = c.split AND rpop.cutoff_week = c.cutoff_week AND rpop.article_id = c.article_id
  LEFT JOIN (SELECT {_u}, article_id, sum(preference_score) AS v FROM profile JOIN core USING (attr_id) GROUP BY ALL) s ON s.split = c.split AND s.cutoff_week = c.cutoff_week AND s.customer_id = c.customer_id AND s.article_id = c.article_id
  LEFT JOIN atrend t ON t.split = c.split AND t.cutoff_week = c.cutoff_week AND t.article_id = c.article_id
  LEFT JOIN (SELECT {_u}, article_id, 0.7 * {norm("lr", 12)} + 0.3 * {norm("cr", 12)} AS v FROM (SELECT *, row_number() OVER ({PU} ORDER BY last_week DESC, n DESC, article_id) AS lr, row_number() OVER ({PU} ORDER BY n DESC, last_week DESC, article_id) AS cr FROM hist)) o ON o.split = c.split AND o.cutoff_week = c.cutoff_week AND o.customer_id = c.customer_id AND o.article_id = c.article_id
  LEFT JOIN vscore v ON v.split = c.split AND v.cutoff_week = c.cutoff_week AND v.customer_id = c.customer_id AND v.article_id = c.article_id
  LEFT JOIN cust ON cust.customer_id = c.customer_id LEFT JOIN (SELECT {_w}, age_bucket, article_id, {norm("rn", 12)} AS v FROM agepool) a ON a.split = c.split AND a.cutoff_week = c.cutoff_week AND a.age_bucket = cust.age_bucket AND a.article_id = c.article_id
  LEFT JOIN (SELECT {_u}, article_id, max(preference_score * {norm("attr_rank", 4)}) AS v FROM profile JOIN attrpool USING ({_w}, attr_id) GROUP BY ALL) q ON q.split = c.split AND q.cutoff_week = c.cutoff_week AND q.customer_id = c.customer_id AND q.article_id = c.article_id),
feat AS (
  SELECT * EXCLUDE (p, r, s, o, v, a, q, k, m), {minmax("p", PW)} AS pop_score, {minmax("r", PW)} AS recent_score, {", ".join(f"{minmax(x, PU)} AS {n}" for x, n in (("s", "sim_score"), ("o", "reorder_score"), ("v", "variant_score"), ("a", "age_pop_score"), ("q", "preference_pop_score"), ("k", "source_rank_score"), ("m", "source_count_score")))} FROM f1),
items AS ({ranked(METHODS["enhanced_pop_similarity_trend"])})
"""


def _base(name: str, union: str) -> str:
    """Candidates of a strategy and their four scores, over these candidates."""
    return f""", cand_{name} AS (
  SELECT {_u}, article_id, string_agg(source, '|' ORDER BY place) AS candidate_sources, arg_min(source, source_rank * 10 + place) AS primary_source, min(source_rank) AS best_source_rank FROM (SELECT *, {_place} AS place FROM ({union})) GROUP BY ALL),
feat_{name} AS (
  SELECT * EXCLUDE (p, r, s), {minmax("p", PW)} AS pop_score, {minmax("r", PW)} AS recent_score, {minmax("s", PU)} AS sim_score FROM (
    SELECT c.*, coalesce(first_week <= c.cutoff_week, false) AS is_seen, CAST(coalesce(pop.n, 0) AS DOUBLE) AS p, CAST(coalesce(rpop.n, 0) AS DOUBLE) AS r, coalesce(s.v, 0.0) AS s, coalesce(t.v, 0.0) AS trend_score
    FROM cand_{name} c LEFT JOIN firstw USING (customer_id, article_id) LEFT JOIN pop USING ({_w}, article_id) LEFT JOIN rpop USING ({_w}, article_id)
    LEFT JOIN (SELECT {_u}, article_id, sum(preference_score) AS v FROM profile JOIN core USING (attr_id) GROUP BY ALL) s USING ({_u}, article_id) LEFT JOIN atrend t USING ({_w}, article_id)))"""


def _fill(name: str, popular: str) -> str:
    """Popular items behind the ranked ones of users with fewer than 12."""
    return f""", fl_{name} AS (
  SELECT {_u}, article_id, have + fr AS rank, greatest(0.0, least(1.0, (max(source_rank) OVER ({PW}) + 1 - source_rank) / CAST(max(source_rank) OVER ({PW}) AS DOUBLE))) AS source_score FROM (
    SELECT {_u}, article_id, have, source_rank, row_number() OVER ({PU} ORDER BY source_rank) AS fr FROM (
      SELECT {_u}, coalesce(have, 0) AS have, p.article_id, p.rn AS source_rank FROM users LEFT JOIN (SELECT {_u}, count(*) AS have FROM rk_{name} GROUP BY ALL) USING ({_u}) JOIN {popular} p USING ({_w}) WHERE coalesce(have, 0) < 12 AND p.rn <= 50)
    LEFT JOIN firstw USING (customer_id, article_id) ANTI JOIN rk_{name} USING ({_u}, article_id) WHERE coalesce(first_week > cutoff_week, true)) WHERE have + fr <= 12)"""


_FEAT = {"all_popularity": "popg", "popularity": "popr", "similarity": "simi", "default": "dflt"}


def _method(m: str) -> str:
    total = " + ".join(f"{c} * {w}" for c, w in METHODS[m].items())
    mode, popular = FILL[m], "poprank" if FILL[m] == "pop_score" else "rpoprank"
    scores = ("pop_score", "recent_score", "sim_score", "trend_score")
    filled = ", ".join(f"{'source_score' if c == mode else '0.0'} AS {c}" for c in scores)
    fill_score = " + ".join(f"{'source_score' if c == mode else '0.0'} * {w}" for c, w in METHODS[m].items())
    return f""", rk_{m} AS (SELECT * FROM (SELECT *, row_number() OVER ({PU} ORDER BY round(score, 9) DESC, article_id) AS rank FROM (SELECT *, {total} AS score FROM feat_{_FEAT[STRATEGY[m]]} WHERE NOT is_seen)) WHERE rank <= 12){_fill(m, popular)},
it_{m} AS (SELECT {_u}, article_id, rank, score, {", ".join(scores)}, candidate_sources, false AS is_backfill FROM rk_{m} UNION ALL SELECT {_u}, article_id, rank, {fill_score}, {", ".join(x.split(" AS ")[0] for x in filled.split(", "))}, 'popularity', true FROM fl_{m})"""


BASELINES = [m for m in METHODS if m in FILL]
RECO += _base("popg", "SELECT * FROM s_pop") + _base("popr", "SELECT * FROM s_recent") + _base("simi", "SELECT * FROM s_sim") + _base("dflt", "SELECT * FROM s_recent UNION ALL SELECT * FROM s_sim UNION ALL SELECT * FROM s_trend")
RECO += "".join(_method(m) for m in BASELINES)
RECO += f", everyitem AS (SELECT 'enhanced_pop_similarity_trend' AS method, {_u}, article_id, rank FROM items" + "".join(f" UNION ALL SELECT '{m}', {_u}, article_id, rank FROM it_{m}" for m in BASELINES) + ")\n"


def user_metrics(items: str, by: str = "") -> str:
    """Metrics of every target user, for each value of ``by``."""
    key = f"{by}, " if by else ""
    cross = f" CROSS JOIN (SELECT DISTINCT {by} FROM {items})" if by else ""
    return f"""SELECT {key}{_u}, coalesce(ap, 0) / least(n, 12) AS ap, coalesce(h, 0) / CAST(n AS DOUBLE) AS recall, CAST(coalesce(h, 0) > 0 AS DOUBLE) AS hit, coalesce(dcg, 0) / ideal AS ndcg, has IS NULL AS missing
  FROM users JOIN (SELECT {_u}, count(*) AS n, list_sum(list_transform(range(1, CAST(least(count(*), 12) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1))) AS ideal FROM truth GROUP BY ALL) USING ({_u}){cross}
  LEFT JOIN (SELECT {key}{_u}, sum(hn / CAST(rank AS DOUBLE)) AS ap, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg FROM (SELECT *, row_number() OVER (PARTITION BY {key}{_u} ORDER BY rank) AS hn FROM {items} JOIN truth USING ({_u}, article_id)) GROUP BY ALL) USING ({key}{_u})
  LEFT JOIN (SELECT DISTINCT {key}{_u}, true AS has FROM {items}) USING ({key}{_u})"""


def coverage(items: str, by: str = "") -> str:
    key = f"{by}, " if by else ""
    cross = f" CROSS JOIN (SELECT DISTINCT {by} FROM {items})" if by else ""
    return f"""SELECT {key}{_w}, coalesce(shown, 0) / CAST(n AS DOUBLE) AS coverage FROM (SELECT {_w}, count(*) AS n FROM pool GROUP BY ALL){cross}
  LEFT JOIN (SELECT {key}{_w}, count(*) AS shown FROM (SELECT DISTINCT {key}{_w}, article_id FROM {items} SEMI JOIN pool USING ({_w}, article_id)) GROUP BY ALL) USING ({key}{_w})"""


def evaluation(items: str, by: str = "", digits: int = 6) -> str:
    key = f"{by}, " if by else ""
    metrics = ", ".join(f"{half_up(m, digits)} AS {m}" for m in METRICS)
    return f"""SELECT {key}split, {metrics}, user_count, missing_users
  FROM (SELECT {key}split, avg(ap) AS map_at_12, avg(recall) AS recall_at_12, avg(hit) AS hit_rate_at_12, avg(ndcg) AS ndcg_at_12, count(*) AS user_count, count(*) FILTER (missing) AS missing_users FROM ({user_metrics(items, by)}) GROUP BY ALL)
  LEFT JOIN (SELECT {key}split, avg(coverage) AS coverage FROM ({coverage(items, by)}) SEMI JOIN users USING ({_w}) GROUP BY ALL) USING ({key}split)"""


U, W = _u, _w
ALL_SCORES = ", ".join(f"round({c}, 6) AS {c}" for c in SCORES)
