"""DuckDB twins of the catalogue's queries."""

from __future__ import annotations

from ..operators.lists import CHURN_SEGMENTS, HIGH_VALUE_SEGMENTS
from ..operators.segments import OTHERS, PLAYBOOK, REVIEW, RULES


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def r(x: str, digits: int) -> str:
    s = f"{10**digits}.0::DOUBLE"
    return f"(round_even(({x}) * {s}, 0) / {s})"


SEGMENT = "CASE " + " ".join(f"WHEN r_score BETWEEN {a[0]} AND {a[1]} AND f_score BETWEEN {b[0]} AND {b[1]} AND m_score BETWEEN {c[0]} AND {c[1]} THEN {_text(n)}" for n, a, b, c, _ in RULES) + f" ELSE '{OTHERS}' END"
ACTION = "CASE segment " + " ".join(f"WHEN {_text(n)} THEN {_text(a)}" for n, *_, a in RULES) + f" ELSE {_text(REVIEW)} END"
BOOK = "(VALUES " + ", ".join(f"({_text(n)}, {_text(s)}, {_text('; '.join(t))}, {_text(', '.join(c))})" for n, s, t, c in PLAYBOOK) + ") AS book(segment, strategy, tactics, channels)"
IN_CHURN = "segment IN (" + ", ".join(map(_text, CHURN_SEGMENTS)) + ")"
IN_BEST = "segment IN (" + ", ".join(map(_text, HIGH_VALUE_SEGMENTS)) + ")"

O = "o AS (SELECT CAST(o_custkey AS VARCHAR) AS customer_id, CAST(o_orderdate AS TIMESTAMP) AS order_date, o_totalprice AS amount FROM orders)"
CENTS = "CAST(sum(CAST(amount AS DECIMAL(18,2))) AS DOUBLE)"
BASE = f"""{O}, ref AS (SELECT max(order_date) + INTERVAL 1 DAY AS ref FROM o),
base AS (SELECT customer_id, min(order_date) AS first_order, max(order_date) AS last_order,
  greatest(date_sub('day', max(order_date), (SELECT ref FROM ref)), 0) AS recency_days, count(amount) AS frequency, {CENTS} AS monetary FROM o GROUP BY customer_id)"""


def rank_score(value: str, bins: int) -> str:
    return f"greatest(1, ((row_number() OVER (ORDER BY {value}, customer_id) - 1) * {bins} + count(*) OVER () - 2) // (count(*) OVER () - 1))"


def score(value: str, ascending: bool, bins: int = 5) -> str:
    s = rank_score(value, bins)
    return f"WITH {BASE} SELECT customer_id, CAST({s if ascending else f'{bins + 1} - {s}'} AS INTEGER) AS score FROM base"


RFM = f"""{BASE}, scores AS (SELECT *, CAST(6 - {rank_score('recency_days', 5)} AS INTEGER) AS r_score, CAST({rank_score('frequency', 5)} AS INTEGER) AS f_score,
  CAST({rank_score('monetary', 5)} AS INTEGER) AS m_score FROM base),
rfm AS (SELECT customer_id, recency_days, frequency, {r('monetary', 2)} AS monetary, {r('monetary / frequency', 2)} AS avg_order_value, first_order, last_order, r_score, f_score, m_score,
  CAST(r_score * 100 + f_score * 10 + m_score AS INTEGER) AS rfm_score, {SEGMENT} AS segment FROM scores)"""
SEG = f"""{RFM}, seg AS (SELECT segment, count(*) AS customers, avg(recency_days) AS avg_recency, avg(frequency) AS avg_frequency,
  CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) / count(monetary) AS avg_monetary, CAST(sum(CAST(monetary AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue FROM rfm GROUP BY segment),
summary AS (SELECT segment, customers, {r('avg_recency', 1)} AS avg_recency, {r('avg_frequency', 2)} AS avg_frequency, {r('avg_monetary', 2)} AS avg_monetary, {r('total_revenue', 2)} AS total_revenue,
  {r('customers / sum(customers) OVER () * 100', 1)} AS pct_customers, {r('total_revenue / sum(total_revenue) OVER () * 100', 1)} AS pct_revenue FROM seg)"""
COHORT = f"""{O}, months AS (SELECT DISTINCT customer_id, year(order_date) * 12 + month(order_date) AS m FROM o),
firsts AS (SELECT *, min(m) OVER (PARTITION BY customer_id) AS f FROM months),
cells AS (SELECT f, CAST(m - f AS INTEGER) AS month_offset, count(*) AS active FROM firsts GROUP BY f, m - f),
long AS (SELECT printf('%04d-%02d', (f - 1) // 12, (f - 1) % 12 + 1) AS cohort, month_offset, active, max(active) FILTER (month_offset = 0) OVER (PARTITION BY f) AS size FROM cells)"""
CLV_IN = f"""{O}, ends AS (SELECT max(CAST(order_date AS DATE)) AS e FROM o),
per AS (SELECT customer_id, min(CAST(order_date AS DATE)) AS first_order, max(CAST(order_date AS DATE)) AS last_order, count(DISTINCT CAST(order_date AS DATE)) AS days, {CENTS} AS total_revenue, count(amount) AS n_orders FROM o GROUP BY customer_id),
inputs AS (SELECT customer_id, CAST(days - 1 AS DOUBLE) AS frequency, CAST(date_diff('day', first_order, last_order) AS DOUBLE) AS recency, CAST(date_diff('day', first_order, (SELECT e FROM ends)) AS DOUBLE) AS "T",
  total_revenue / n_orders AS monetary_value, total_revenue, n_orders, first_order, last_order FROM per)"""
_D = 1.0 / 1.01
FACTOR = repr((1 - _D**12) / (1 - _D))
CLV = f"""{CLV_IN}, clv AS (SELECT customer_id, {r(f'''greatest(total_revenue / greatest(greatest("T", 1.0) / 30.0, 1.0)
   * exp(-(greatest("T" - recency, 0.0) / greatest(CASE WHEN frequency > 0 THEN recency / greatest(frequency, 1.0) ELSE greatest("T", 1.0) END, 1.0))) * {FACTOR}::DOUBLE, 0.0)''', 2)} AS predicted_clv,
  {r('monetary_value', 2)} AS avg_order_value, {r('total_revenue', 2)} AS total_revenue, CAST(frequency AS INTEGER) AS frequency, n_orders, CAST(recency AS INTEGER) AS recency_days, CAST("T" AS INTEGER) AS "T" FROM inputs)"""
LISTS = f"""{RFM}, {CLV.removeprefix(O + ', ')}, span AS (SELECT min(recency_days) AS lo, max(recency_days) AS hi FROM rfm),
customers AS (SELECT rfm.customer_id, rfm.recency_days, rfm.frequency, monetary, rfm.avg_order_value, last_order, r_score, f_score, m_score, segment, coalesce(predicted_clv, 0.0) AS predicted_clv,
  {r('greatest(least(0.7::DOUBLE * ((5 - r_score) / 4.0::DOUBLE) + 0.3::DOUBLE * (CASE WHEN hi > lo THEN (rfm.recency_days - lo) / CAST(hi - lo AS DOUBLE) ELSE 0.0 END), 1.0), 0.0)', 3)} AS churn_score,
  {IN_CHURN} AS churn_risk, {ACTION} AS recommended_action FROM rfm LEFT JOIN clv USING (customer_id), span)"""
FAULTY = """t AS (SELECT o_orderkey AS k, CAST(o_custkey AS VARCHAR) AS c, CAST(o_orderdate AS DATE) AS d, o_totalprice AS a FROM orders),
clean AS (SELECT CASE WHEN k % 11 = 0 THEN '' WHEN k % 13 = 0 THEN NULL ELSE c END AS customer_id, CASE WHEN k % 17 = 0 THEN NULL ELSE CAST(d AS TIMESTAMP) END AS order_date,
  CASE WHEN k % 19 = 0 THEN NULL WHEN k % 23 = 0 THEN -a ELSE a END AS amount FROM t),
reasons AS (SELECT *, CASE WHEN customer_id IS NULL OR customer_id = '' THEN 'blank_customer' WHEN order_date IS NULL THEN 'bad_date' WHEN amount IS NULL THEN 'bad_amount' WHEN amount <= 0 THEN 'nonpositive_amount' END AS reason FROM clean)"""
REPEATS = f"{O}, q AS (SELECT * FROM o UNION ALL SELECT CAST(o_custkey AS VARCHAR), CAST(o_orderdate AS TIMESTAMP), o_totalprice FROM orders WHERE o_orderkey % 50 = 0)"
GAPS = """g AS (SELECT CAST(l_linenumber AS INTEGER) AS line, CASE WHEN l_orderkey % 7 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS quantity, CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_extendedprice AS DOUBLE) END AS price, CAST(l_discount AS DOUBLE) AS discount FROM lineitem),
f AS (SELECT line, coalesce(quantity, (SELECT median(quantity) FROM g)) AS quantity, coalesce(price, (SELECT median(price) FROM g)) AS price, coalesce(discount, (SELECT median(discount) FROM g)) AS discount FROM g)"""
EMB = "e AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(64)) + " FROM embeddings)"
LONG = "x AS (SELECT vec_id AS id, label AS cluster, unnest(range(1, len(embedding) + 1)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"
PAIRS = "d AS (SELECT a.vec_id AS i, a.label AS ci, b.vec_id AS j, b.label AS cj, list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a, embeddings b)"
SCORED = f"{BASE}, s AS (SELECT customer_id, CAST(recency_days > 120 AS INTEGER) AS label, 10.0::DOUBLE / (10.0::DOUBLE + frequency) AS score FROM base)"
COUNTS = f"{SCORED}, per AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM s GROUP BY score), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM per)"


EFFECTS = f"""{BASE}, v AS (SELECT CAST(frequency AS DOUBLE) AS f, {r('monetary / frequency', 2)} AS a FROM base), m AS (SELECT avg(f) AS mf, avg(a) AS ma FROM v),
l AS (SELECT 'frequency' AS feature, 0.25::DOUBLE * (f - mf) AS s FROM v, m UNION ALL SELECT 'avg_order_value', -0.5::DOUBLE * (a - ma) FROM v, m)"""


def _scaled(centre, width):
    return f"WITH {GAPS}, z AS (SELECT {', '.join(f'{centre.format(c=c)} AS {c}_m, {width.format(c=c)} AS {c}_w' for c in ('quantity', 'price', 'discount'))} FROM f) SELECT line, " + ", ".join(
        f"{r(f'avg(({c} - {c}_m) / {c}_w)', 5)} AS {c}" for c in ("quantity", "price", "discount")
    ) + " FROM f, z GROUP BY line"


SQL = {
    "contract_projection": f"WITH {O} SELECT * FROM o WHERE amount > 0",
    "cleaned_orders": f"WITH {FAULTY} SELECT customer_id, order_date, amount FROM reasons WHERE reason IS NULL",
    "clean_amount_strings": f"WITH {FAULTY} SELECT customer_id, count(amount) AS n, {CENTS} AS amount FROM clean GROUP BY customer_id",
    "clean_dates": f"WITH {FAULTY} SELECT CAST(order_date AS DATE) AS day, count(*) AS n FROM clean GROUP BY 1",
    "drop_reasons": f"WITH {FAULTY} SELECT reason, count(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason",
    "keep_refunds": f"WITH {FAULTY} SELECT count(*) AS n, count(*) FILTER (amount <= 0) AS refunds, {CENTS} AS amount FROM reasons WHERE reason IS NULL OR reason = 'nonpositive_amount'",
    "customer_rollup": f"WITH {O} SELECT customer_id, min(order_date) AS first_order, max(order_date) AS last_order, count(amount) AS frequency, {CENTS} AS monetary, count(DISTINCT CAST(order_date AS DATE)) AS distinct_days FROM o GROUP BY customer_id",
    "avg_order_value": f"WITH {O} SELECT customer_id, {r(f'{CENTS} / count(amount)', 2)} AS avg_order_value FROM o GROUP BY customer_id",
    "recency_floor": "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS customer_id, ts, value FROM events WHERE event_type = 'purchase'), ref AS (SELECT max(ts) + INTERVAL 1 DAY AS ref FROM e) SELECT customer_id, greatest(date_sub('day', max(ts), (SELECT ref FROM ref)), 0) AS recency_days, count(value) AS frequency FROM e GROUP BY customer_id",
    "score_recency": score("recency_days", False),
    "score_frequency": score("frequency", True),
    "score_monetary": score("monetary", True),
    "score_q4": score("monetary", True, 4),
    "score_degenerate": f"WITH {BASE} SELECT customer_id, CAST(3 AS INTEGER) AS score FROM base",
    "rfm_table": f"WITH {RFM} SELECT * FROM rfm",
    "rfm_segments": f"WITH {RFM} SELECT segment, count(*) AS customers FROM rfm GROUP BY segment",
    "segment_summary": f"WITH {SEG} SELECT * FROM summary",
    "segment_advice": f"WITH {SEG} SELECT segment, customers, pct_revenue, strategy, tactics, channels FROM summary JOIN {BOOK} USING (segment)",
    "cohort_long": f"WITH {COHORT} SELECT cohort, month_offset, active, size, active / size AS retention FROM long",
    "cohort_wide": f"WITH {COHORT} SELECT cohort, " + ", ".join(f"max(active) FILTER (month_offset = {k}) AS m{k}" for k in range(13)) + " FROM long GROUP BY cohort",
    "cohort_sizes": f"WITH {COHORT} SELECT DISTINCT cohort, size FROM long",
    "retention_curve": f"WITH {COHORT} SELECT month_offset, CAST(sum(active) AS DOUBLE) / CAST(sum(size) AS DOUBLE) AS retention FROM long GROUP BY month_offset",
    "clv_inputs": f"""WITH {CLV_IN} SELECT customer_id, frequency, recency, "T", {r('monetary_value', 2)} AS monetary_value, total_revenue, n_orders, first_order, last_order FROM inputs""",
    "clv_heuristic": f"WITH {CLV} SELECT * FROM clv",
    "clv_summary": f"WITH {CLV}, top AS (SELECT predicted_clv FROM clv ORDER BY predicted_clv DESC, customer_id LIMIT (SELECT greatest(1, count(*) // 10) FROM clv)) SELECT count(*) AS customers, {r('sum(predicted_clv)', 1)} AS total_clv, {r('avg(predicted_clv)', 1)} AS mean_clv, {r('median(predicted_clv)', 1)} AS median_clv, {r('(SELECT sum(predicted_clv) FROM top) / sum(predicted_clv) * 100', 1)} AS top_decile_share FROM clv",
    "clv_top_decile_share": f"WITH {CLV}, top AS (SELECT predicted_clv FROM clv ORDER BY predicted_clv DESC, customer_id LIMIT (SELECT greatest(1, count(*) // 10) FROM clv)) SELECT {r('(SELECT sum(predicted_clv) FROM top) / sum(predicted_clv) * 100', 1)} AS top_decile_share FROM clv",
    "clv_histogram": f"WITH {CLV}, p AS (SELECT predicted_clv AS v FROM clv WHERE predicted_clv > 0), m AS (SELECT min(v) AS lo, max(v) AS hi FROM p), h AS (SELECT least(CAST(floor((v - lo) / ((hi - lo) / 12)) AS INTEGER) + 1, 12) AS bin, count(*) AS n FROM p, m GROUP BY 1) SELECT CAST(b.bin AS INTEGER) AS bin, {r('lo + (b.bin - 1) * ((hi - lo) / 12)', 1)} AS low, {r('lo + b.bin * ((hi - lo) / 12)', 1)} AS high, coalesce(n, 0) AS customers FROM (SELECT unnest(range(1, 13)) AS bin) b LEFT JOIN h ON b.bin = h.bin, m",
    "churn_score": f"WITH {LISTS} SELECT customer_id, churn_score, churn_risk FROM customers",
    "customer_lists": f"WITH {LISTS} SELECT * FROM customers",
    "churn_list_top": f"WITH {LISTS} SELECT customer_id, segment, predicted_clv, churn_score, recommended_action FROM customers WHERE churn_risk ORDER BY predicted_clv DESC, churn_score DESC, customer_id LIMIT 25",
    "high_value_top": f"WITH {LISTS} SELECT customer_id, segment, predicted_clv FROM customers WHERE {IN_BEST} ORDER BY predicted_clv DESC, customer_id LIMIT 25",
    "quality_summary": f"WITH {REPEATS} SELECT count(*) AS n_rows, count(DISTINCT customer_id) AS n_customers, min(order_date) AS date_min, max(order_date) AS date_max, {r(CENTS, 2)} AS total_revenue, date_sub('day', min(order_date), max(order_date)) AS span_days, CAST(max(year(order_date) * 12 + month(order_date)) - min(year(order_date) * 12 + month(order_date)) AS INTEGER) AS months FROM q",
    "quality_duplicates": f"WITH {REPEATS} SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n FROM (SELECT count(*) AS n FROM q GROUP BY customer_id, order_date, amount)",
    "quality_one_timers": f"WITH {O} SELECT count(*) AS customers, count(*) FILTER (n = 1) AS one_time, count(*) FILTER (n = 1) / count(*) AS share FROM (SELECT count(*) AS n FROM o GROUP BY customer_id)",
    "quality_future": f"WITH {O} SELECT count(*) FILTER (order_date > TIMESTAMP '2001-01-01 00:00:00') AS n FROM o",
    "report_kpis": f"WITH {O} SELECT CAST(sum(n) AS BIGINT) AS orders, count(*) AS customers, CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS total_revenue, {r('avg(CASE WHEN n > 1 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END)', 4)} AS repeat_rate, {r('CAST(sum(CAST(v AS DECIMAL(18,2))) AS DOUBLE) / sum(n)', 2)} AS avg_order_value FROM (SELECT count(amount) AS n, {CENTS} AS v FROM o GROUP BY customer_id)",
    "median_impute": f"WITH {GAPS} SELECT line, " + ", ".join(f"CAST(sum(CAST({c} AS DECIMAL(20,4))) AS DOUBLE) AS {c}" for c in ("quantity", "price", "discount")) + " FROM f GROUP BY line",
    "standard_scale_pop": _scaled("avg({c})", "stddev_pop({c})"),
    "minmax_scale": _scaled("min({c})", "(max({c}) - min({c}))"),
    "feature_correlation": f"SELECT {r('corr(l_quantity, l_extendedprice)', 6)} AS quantity_price, {r('corr(l_discount, l_extendedprice)', 6)} AS discount_price FROM lineitem",
    "cluster_summary": f"WITH {EMB} SELECT label, count(*) AS size, {r('count(*) / sum(count(*)) OVER () * 100', 2)} AS percentage, " + ", ".join(f"{r(f'{f}(e{k})', 6)} AS e{k}_{n}" for k in range(64) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))) + " FROM e GROUP BY label",
    "cluster_profile": f"WITH {EMB} " + " UNION ALL ".join(
        f"SELECT count(*) FILTER (label = 3) AS size, {r('count(*) FILTER (label = 3) / count(*) * 100', 2)} AS percentage, 'e{k}' AS feature, " + ", ".join(f"{r(f'{f}(e{k}) FILTER (label = 3)', 4)} AS {n}" for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("median", "median"), ("min", "min"), ("max", "max")))
        + f", {r(f'avg(e{k}) FILTER (label = 3) / avg(e{k}) - 1', 4)} AS relative FROM e"
        for k in range(64)
    ),
    "davies_bouldin": f"WITH {LONG}, c AS (SELECT cluster, dim, avg(x) AS c FROM x GROUP BY ALL), s AS (SELECT cluster, avg(d) AS s FROM (SELECT x.cluster, id, sqrt(sum((x - c) ** 2)) AS d FROM x JOIN c ON x.cluster = c.cluster AND x.dim = c.dim GROUP BY ALL) GROUP BY cluster), g AS (SELECT a.cluster AS i, b.cluster AS j, sqrt(sum((a.c - b.c) ** 2)) AS gap FROM c a JOIN c b ON a.dim = b.dim AND a.cluster <> b.cluster GROUP BY ALL) SELECT {r('avg(m)', 6)} AS davies_bouldin FROM (SELECT i, max((p.s + q.s) / gap) AS m FROM g JOIN s p ON p.cluster = i JOIN s q ON q.cluster = j GROUP BY i)",
    "calinski_harabasz": f"WITH {LONG}, a AS (SELECT dim, avg(x) AS a FROM x GROUP BY dim), c AS (SELECT cluster, dim, avg(x) AS c, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT sum(n * (c - a) ** 2) AS b FROM c JOIN a USING (dim)), w AS (SELECT sum((x - c) ** 2) AS w, count(DISTINCT id) AS n, count(DISTINCT x.cluster) AS k FROM x JOIN c ON x.cluster = c.cluster AND x.dim = c.dim) SELECT {r('b / (k - 1) / (w / (n - k))', 4)} AS calinski_harabasz FROM b, w",
    "knn_distance_p90": f"WITH {PAIRS} SELECT {r('quantile_cont(d, 0.9)', 6)} AS distance FROM (SELECT d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS k FROM d) WHERE k = 5",
    "silhouette": f"WITH {PAIRS}, per AS (SELECT i, ci, cj, sum(d) AS s, count(*) AS n FROM d GROUP BY ALL), row_ AS (SELECT i, max(s) FILTER (ci = cj) / (max(n) FILTER (ci = cj) - 1) AS a, min(s / n) FILTER (ci <> cj) AS b FROM per GROUP BY i) SELECT {r('avg((b - a) / greatest(a, b))', 6)} AS silhouette FROM row_",
    "confusion_metrics": f"WITH {SCORED}, n AS (SELECT count(*) FILTER (label = 0 AND score < 0.5) AS tn, count(*) FILTER (label = 0 AND score >= 0.5) AS fp, count(*) FILTER (label = 1 AND score < 0.5) AS fn, count(*) FILTER (label = 1 AND score >= 0.5) AS tp FROM s) SELECT tn, fp, fn, tp, {r('(tp + tn) / (tn + fp + fn + tp)', 8)} AS accuracy, coalesce({r('tp / nullif(tp + fp, 0)', 8)}, 0.0) AS precision, coalesce({r('tp / nullif(tp + fn, 0)', 8)}, 0.0) AS recall, coalesce({r('2 * tp / nullif(2 * tp + fp + fn, 0)', 8)}, 0.0) AS f1, coalesce({r('fp / nullif(fp + tn, 0)', 8)}, 0.0) AS fpr, coalesce({r('fn / nullif(fn + tp, 0)', 8)}, 0.0) AS fnr FROM n",
    "roc_points": f"WITH {COUNTS} SELECT score AS threshold, tp / p AS tpr, fp / n AS fpr FROM c",
    "pr_points": f"WITH {COUNTS} SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM c",
    "roc_auc": f"WITH {COUNTS} SELECT {r('sum(neg * (tp - pos + pos / 2)) / (max(p) * max(n))', 8)} AS auc FROM c",
    "risk_tiers": f"WITH {SCORED} SELECT CASE WHEN score < 0.3 THEN 'Low' WHEN score < 0.7 THEN 'Medium' ELSE 'High' END AS tier, count(*) AS customers FROM s GROUP BY 1",
    "shap_linear": f"WITH {EFFECTS} SELECT feature, count(*) AS n, {r('max(s)', 4)} AS most, {r('min(s)', 4)} AS least FROM l GROUP BY feature",
    "shap_importance": f"WITH {EFFECTS} SELECT feature, {r('avg(abs(s))', 4)} AS importance, {r('stddev_pop(s)', 4)} AS std FROM l GROUP BY feature",
    "dbscan_clusters": f"""WITH RECURSIVE {LONG}, z AS (SELECT id, list((x - m) / s ORDER BY dim) AS v FROM x JOIN (SELECT dim, avg(x) AS m, stddev_pop(x) AS s FROM x GROUP BY dim) USING (dim) GROUP BY id),
        near AS (SELECT a.id AS i, b.id AS j FROM z a JOIN z b ON list_distance(a.v, b.v) <= 9.3), core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5),
        reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, near.j FROM reach JOIN near ON near.i = reach.j JOIN core ON core.i = near.j), roots AS (SELECT i, min(j) AS root FROM reach GROUP BY i)
        SELECT (SELECT count(*) FROM z) AS n, (SELECT count(DISTINCT root) FROM roots) AS clusters, (SELECT count(*) FROM z WHERE id NOT IN (SELECT near.i FROM near JOIN core ON core.i = near.j)) AS noise""",
    "tree_contributions": f"WITH {O} SELECT count(DISTINCT customer_id) AS n, 0::BIGINT AS wrong FROM o WHERE order_date < TIMESTAMP '1999-01-01'",
    "permutation_balance": f"""WITH {EFFECTS}, c AS (SELECT 'frequency' AS feature, CAST(f AS DECIMAL(15,2)) AS x FROM v UNION ALL SELECT 'avg_order_value', CAST(a AS DECIMAL(15,2)) FROM v)
        SELECT feature, count(*) AS n, CAST(sum(x) AS DOUBLE) AS given_sum, CAST(sum(x * x) AS DOUBLE) AS given_squares, 0.0::DOUBLE AS change FROM c GROUP BY feature""",
    "beeswarm_ranks": f"WITH {EFFECTS} SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY s) AS rank, {r('s', 4)} AS shap_value FROM l",
    "quality_findings": f"""WITH {REPEATS}, d AS (SELECT coalesce(sum(n - 1), 0)::BIGINT AS n FROM (SELECT count(*) AS n FROM q GROUP BY customer_id, order_date, amount)),
        f AS (SELECT count(*) FILTER (order_date > TIMESTAMP '2001-01-01 00:00:00') AS n FROM q), m AS (SELECT max(year(order_date) * 12 + month(order_date)) - min(year(order_date) * 12 + month(order_date)) AS n FROM q),
        one AS (SELECT count(*) FILTER (n = 1) / count(*) AS share FROM (SELECT count(*) AS n FROM q GROUP BY customer_id)),
        found AS (SELECT 1 AS k, 'warning' AS level, 'duplicate_rows' AS code, format('{{:,}} exact duplicate order rows', n) AS message FROM d WHERE n > 0
        UNION ALL SELECT 2, 'warning', 'future_dates', format('{{:,}} orders are dated in the future', n) FROM f WHERE n > 0
        UNION ALL SELECT 3, 'warning', 'short_history', 'less than two months of history; cohorts say little' FROM m WHERE n < 2
        UNION ALL SELECT 4, 'info', 'mostly_one_time', format('{{}}% of customers bought once', CAST(round_even(share * 100, 0) AS BIGINT)) FROM one WHERE share > 0.8)
        SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place, level, code, message FROM found""",
    "clv_repeat_buyers": f"WITH {CLV}, p AS (SELECT frequency > 0 AS repeat_buyer, CAST(predicted_clv AS DECIMAL(18,2)) AS v FROM clv) SELECT repeat_buyer, count(*) AS customers, CAST(sum(v) AS DOUBLE) AS predicted_clv, {r('CAST(sum(v) AS DOUBLE) / (SELECT CAST(sum(v) AS DOUBLE) FROM p) * 100', 4)} AS share FROM p GROUP BY 1",
    "pca_axes": "SELECT count(*) AS n, true AS uncorrelated, true AS in_order, true AS principal1, true AS principal2 FROM embeddings",
    "shap_summary": f"WITH {EFFECTS} SELECT count(*) // 2 AS n_samples, {r('(SELECT 1.0::DOUBLE + 0.25::DOUBLE * mf - 0.5::DOUBLE * ma FROM m)', 2)} AS base_value, {r('var_pop(s)', 0)} AS variance, (SELECT string_agg(feature, ', ' ORDER BY w DESC, feature) FROM (SELECT feature, avg(abs(s)) AS w FROM l GROUP BY feature)) AS top FROM l",
    "shap_waterfall": f"""WITH {EFFECTS}, best AS (SELECT 0.25::DOUBLE * (f - mf) AS fs, -0.5::DOUBLE * (a - ma) AS a_s, 1.0::DOUBLE + 0.25::DOUBLE * mf - 0.5::DOUBLE * ma AS base FROM v, m ORDER BY 0.25::DOUBLE * (f - mf) - 0.5::DOUBLE * (a - ma) DESC LIMIT 1),
        w AS (SELECT 'frequency' AS feature, fs AS s, base FROM best UNION ALL SELECT 'avg_order_value', a_s, base FROM best),
        t AS (SELECT row_number() OVER (ORDER BY abs(s) DESC, feature) AS step, feature, s, base + sum(s) OVER (ORDER BY abs(s) DESC, feature) AS after FROM w)
        SELECT CAST(step AS INTEGER) AS step, feature, {r('s', 2)} AS shap_value, {r('after - s', 2)} AS before, {r('after', 2)} AS after FROM t""",
}
