"""DuckDB oracle SQL, one statement per registered query (same column names)."""

ORACLE: dict[str, str] = {}

ORACLE["lag_diff"] = """
WITH p AS (
  SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS o_year,
         SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS total, COUNT(*) AS n_orders
  FROM orders GROUP BY 1, 2)
SELECT o_custkey, o_year, CAST(total AS DOUBLE) AS total, n_orders,
       CAST(COALESCE(total - LAG(total) OVER (PARTITION BY o_custkey ORDER BY o_year, total), 0) AS DOUBLE)
         AS total_diff
FROM p
"""

ORACLE["normalize_names"] = """
SELECT c_custkey AS C_CUSTKEY, c_name AS C_NAME, c_nationkey AS C_NATIONKEY,
       c_acctbal AS C_ACCTBAL, c_mktsegment AS C_MKTSEGMENT FROM customer
"""

ORACLE["leading_int"] = r"""
SELECT o_orderkey, TRY_CAST(regexp_extract(o_orderpriority, '^(\d+)', 1) AS DOUBLE) AS priority_num,
       TRY_CAST(o_orderstatus AS DOUBLE) AS status_num
FROM orders
"""

ORACLE["concat_panels"] = """
SELECT c_custkey AS key, c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal, c_mktsegment AS segment
FROM customer
UNION ALL
SELECT s_suppkey, s_name, s_nationkey, s_acctbal, NULL FROM supplier
"""

ORACLE["dedup_rows"] = "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem"

ORACLE["wide_to_long"] = r"""
WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS ANO FROM orders),
c AS (SELECT DISTINCT o_custkey FROM orders),
a AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS ANO,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS t, COUNT(*) AS n, MIN(o_orderpriority) AS pr
      FROM orders GROUP BY 1, 2)
SELECT c.o_custkey, y.ANO, CAST(a.t AS DOUBLE) AS TOTAL, CAST(COALESCE(a.n, 0) AS DOUBLE) AS CNT,
       TRY_CAST(regexp_extract(a.pr, '^(\d+)', 1) AS DOUBLE) AS FASE
FROM c CROSS JOIN y LEFT JOIN a ON a.o_custkey = c.o_custkey AND a.ANO = y.ANO
WHERE y.ANO < (SELECT max(ANO) FROM y)
"""

_LI_GAPS = """
WITH s AS (
  SELECT l_orderkey, l_linenumber,
    CASE WHEN l_quantity > 40 THEN NULL ELSE l_quantity END AS qty,
    CASE WHEN l_discount < 0.03 THEN NULL ELSE l_discount END AS disc,
    CASE WHEN l_tax > 0.05 THEN NULL ELSE l_tax END AS tax,
    CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS flag,
    CASE WHEN l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS status,
    CASE WHEN l_shipdate >= TIMESTAMP '2000-01-01' THEN NULL ELSE l_shipdate END AS shipdate
  FROM lineitem)
"""

ORACLE["sparse_rows"] = _LI_GAPS + """
SELECT * FROM s
WHERE 2 * ((l_orderkey IS NOT NULL)::INT + (l_linenumber IS NOT NULL)::INT + (qty IS NOT NULL)::INT
         + (disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT + (flag IS NOT NULL)::INT
         + (status IS NOT NULL)::INT + (shipdate IS NOT NULL)::INT) > 8
"""

ORACLE["null_profile"] = _LI_GAPS + """
SELECT count(*) - count(l_orderkey) AS n_null_l_orderkey, count(*) - count(l_linenumber) AS n_null_l_linenumber,
       count(*) - count(qty) AS n_null_qty, count(*) - count(disc) AS n_null_disc,
       count(*) - count(tax) AS n_null_tax, count(*) - count(flag) AS n_null_flag,
       count(*) - count(status) AS n_null_status, count(*) - count(shipdate) AS n_null_shipdate
FROM s
"""

ORACLE["group_median_impute"] = """
WITH p AS (
  SELECT p_partkey,
         CASE WHEN p_size <= 3 THEN NULL ELSE p_brand END AS brand,
         CASE WHEN p_brand = 'Brand#7' OR p_size BETWEEN 40 AND 45 THEN NULL ELSE p_retailprice END AS price,
         CASE WHEN p_type = 'SMALL' THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size
  FROM part),
g AS (SELECT brand, median(price) AS gp, median(size) AS gs FROM p WHERE brand IS NOT NULL GROUP BY brand),
s1 AS (SELECT p.p_partkey, p.brand, COALESCE(p.price, g.gp) AS price, COALESCE(p.size, g.gs) AS size
       FROM p LEFT JOIN g ON p.brand = g.brand),
a AS (SELECT median(price) AS ap, median(size) AS asz FROM s1)
SELECT p_partkey, brand, ROUND(COALESCE(price, a.ap), 6) AS price, ROUND(COALESCE(size, a.asz), 6) AS size
FROM s1 CROSS JOIN a
"""

ORACLE["mode_impute"] = """
WITH c AS (
  SELECT c_custkey,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE c_mktsegment END AS seg,
         CASE WHEN c_acctbal > 9000 THEN NULL ELSE c_nationkey END AS nation
  FROM customer),
ms AS (SELECT seg FROM c WHERE seg IS NOT NULL GROUP BY seg ORDER BY count(*) DESC, seg ASC LIMIT 1),
mn AS (SELECT nation FROM c WHERE nation IS NOT NULL GROUP BY nation ORDER BY count(*) DESC, nation ASC LIMIT 1)
SELECT c_custkey, COALESCE(seg, (SELECT seg FROM ms)) AS seg, COALESCE(nation, (SELECT nation FROM mn)) AS nation
FROM c
"""

_RULE = "(CASE WHEN inde < 5 OR ian < 5 THEN 1 ELSE 0 END)"

ORACLE["label_derive"] = f"""
WITH p AS (
  SELECT p_partkey,
         CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE p_size / 5.0 END AS inde,
         CASE WHEN p_type = 'SMALL' THEN NULL ELSE p_retailprice / 200.0 END AS ian
  FROM part)
SELECT p_partkey, {_RULE} AS label FROM p
"""

ORACLE["label_text"] = f"""
WITH o AS (
  SELECT o_orderkey,
         CASE o_orderstatus WHEN 'F' THEN 'Sim' WHEN 'O' THEN 'NÃO' ELSE '?' END AS label,
         o_totalprice / 50000.0 AS inde,
         CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) * 2.0 AS ian
  FROM orders)
SELECT o_orderkey,
       COALESCE(CASE lower(label) WHEN 'sim' THEN 1 WHEN 'yes' THEN 1 WHEN 'não' THEN 0 WHEN 'nao' THEN 0
                                  WHEN 'no' THEN 0 END, {_RULE}) AS label
FROM o
"""

ORACLE["label_signed"] = f"""
WITH c AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE c_acctbal END AS y,
         c_nationkey / 2.5 AS inde, c_acctbal / 1000.0 + 5.0 AS ian
  FROM customer),
b AS (SELECT COALESCE(bool_and(y IN (0, 1)), TRUE) AS is_bin FROM c WHERE y IS NOT NULL)
SELECT c_custkey,
       CASE WHEN b.is_bin THEN COALESCE(CAST(y AS INTEGER), {_RULE})
            ELSE COALESCE(CASE WHEN y < 0 THEN 1 WHEN y IS NOT NULL THEN 0 END, {_RULE}) END AS label
FROM c CROSS JOIN b
"""

ORACLE["label_binary"] = f"""
WITH l AS (
  SELECT doc_id, CASE WHEN toxic = 1 THEN NULL ELSE quality END AS y,
         quality * 4.0 + toxic AS inde, toxic * 6.0 AS ian
  FROM labels),
b AS (SELECT COALESCE(bool_and(y IN (0, 1)), TRUE) AS is_bin FROM l WHERE y IS NOT NULL)
SELECT doc_id,
       CASE WHEN b.is_bin THEN COALESCE(CAST(y AS INTEGER), {_RULE})
            ELSE COALESCE(CASE WHEN y < 0 THEN 1 WHEN y IS NOT NULL THEN 0 END, {_RULE}) END AS label
FROM l CROSS JOIN b
"""

ORACLE["label_distribution"] = "SELECT quality, count(*) AS n FROM labels GROUP BY quality"

ORACLE["class_weights"] = """
WITH d AS (SELECT quality, count(*) AS n FROM labels GROUP BY quality)
SELECT quality, n,
       ROUND((SELECT sum(n) FROM d) / ((SELECT count(*) FROM d) * n), 6) AS weight,
       ROUND((SELECT sum(n) FILTER (WHERE quality = 0) FROM d)
             / greatest((SELECT coalesce(sum(n) FILTER (WHERE quality = 1), 0) FROM d), 1), 6) AS imbalance_ratio
FROM d
"""

ORACLE["row_mean"] = _LI_GAPS + """
SELECT l_orderkey, l_linenumber,
       ROUND((0.0 + COALESCE(qty, 0.0) + COALESCE(disc, 0.0) + COALESCE(tax, 0.0))
             / NULLIF((qty IS NOT NULL)::INT + (disc IS NOT NULL)::INT + (tax IS NOT NULL)::INT, 0), 6) AS row_mean
FROM s
"""

ORACLE["gap"] = "SELECT l_orderkey, l_linenumber, ROUND(l_tax - l_discount, 6) AS gap FROM lineitem"

ORACLE["interactions"] = """
SELECT l_orderkey, l_linenumber, ROUND(l_quantity * l_discount, 6) AS qty_x_disc,
       ROUND(l_extendedprice * l_tax, 6) AS price_x_tax FROM lineitem
"""

ORACLE["all_below_median"] = _LI_GAPS + """
, m AS (SELECT median(qty) AS mq, median(disc) AS md, median(tax) AS mt FROM s)
SELECT l_orderkey, l_linenumber,
       CASE WHEN qty < mq AND disc < md AND tax < mt THEN 1 ELSE 0 END AS below
FROM s CROSS JOIN m
"""

ORACLE["panel_features"] = r"""
WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS ANO FROM orders),
c AS (SELECT DISTINCT o_custkey FROM orders),
a AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS ANO,
             SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS t, COUNT(*) AS n,
             MAX(CASE WHEN o_totalprice <= 400000 THEN o_totalprice END) AS mx,
             MIN(CASE WHEN NOT starts_with(o_orderpriority, '5') THEN o_orderpriority END) AS pr
      FROM orders GROUP BY 1, 2),
lng AS (
  SELECT c.o_custkey AS O_CUSTKEY, y.ANO, CAST(a.t AS DOUBLE) / 1000.0 AS TOTAL,
         CAST(COALESCE(a.n, 0) AS DOUBLE) AS CNT, a.mx AS MAXP,
         TRY_CAST(regexp_extract(a.pr, '^(\d+)', 1) AS DOUBLE) AS FASE
  FROM c CROSS JOIN y LEFT JOIN a ON a.o_custkey = c.o_custkey AND a.ANO = y.ANO),
kept AS (
  SELECT DISTINCT * FROM lng
  WHERE 2 * (1 + 1 + (TOTAL IS NOT NULL)::INT + (CNT IS NOT NULL)::INT + (MAXP IS NOT NULL)::INT
             + (FASE IS NOT NULL)::INT) > 6),
g AS (SELECT FASE AS gf, median(TOTAL) AS gt, median(CNT) AS gc, median(MAXP) AS gm
      FROM kept WHERE FASE IS NOT NULL GROUP BY FASE),
s1 AS (SELECT O_CUSTKEY, ANO, COALESCE(TOTAL, gt) AS TOTAL, COALESCE(CNT, gc) AS CNT,
              COALESCE(MAXP, gm) AS MAXP, FASE
       FROM kept LEFT JOIN g ON kept.FASE = g.gf),
am AS (SELECT median(TOTAL) AS a_t, median(CNT) AS a_c, median(MAXP) AS a_m FROM s1),
s2 AS (SELECT O_CUSTKEY, ANO, COALESCE(TOTAL, a_t) AS TOTAL, COALESCE(CNT, a_c) AS CNT,
              COALESCE(MAXP, a_m) AS MAXP, FASE FROM s1 CROSS JOIN am),
mf AS (SELECT FASE AS mfase FROM s2 WHERE FASE IS NOT NULL GROUP BY FASE ORDER BY count(*) DESC, FASE LIMIT 1),
s3 AS (SELECT O_CUSTKEY, ANO, TOTAL, CNT, MAXP, COALESCE(FASE, (SELECT mfase FROM mf)) AS FASE FROM s2),
lab AS (SELECT *, CASE WHEN TOTAL < 500 OR CNT < 2 THEN 1 ELSE 0 END AS DEFASAGEM FROM s3),
md AS (SELECT median(CNT) AS mc, median(MAXP) AS mm, median(TOTAL) AS mt FROM lab)
SELECT O_CUSTKEY, ANO, ROUND(TOTAL, 6) AS TOTAL, ROUND(CNT, 6) AS CNT, ROUND(MAXP, 6) AS MAXP,
       ROUND(FASE, 6) AS FASE,
       ROUND((0.0 + COALESCE(TOTAL, 0.0) + COALESCE(MAXP, 0.0))
             / NULLIF((TOTAL IS NOT NULL)::INT + (MAXP IS NOT NULL)::INT, 0), 6) AS PERF,
       ROUND(TOTAL - MAXP, 6) AS GAP,
       ROUND(COALESCE(TOTAL - LAG(TOTAL) OVER (PARTITION BY O_CUSTKEY ORDER BY ANO, TOTAL), 0.0), 6) AS EVOLUTION,
       ROUND(TOTAL * FASE, 6) AS TOTAL_x_FASE,
       DEFASAGEM,
       CASE WHEN CNT < mc AND MAXP < mm AND TOTAL < mt THEN 1 ELSE 0 END AS BELOW
FROM lab CROSS JOIN md
"""

ORACLE["stratified_split"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk,
                  count(*) OVER (PARTITION BY quality) AS n
           FROM labels)
SELECT doc_id, quality, CASE WHEN rk <= ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r
"""

ORACLE["stratified_folds"] = """
WITH r AS (SELECT doc_id, quality,
                  row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk
           FROM labels)
SELECT doc_id, quality, CAST((rk - 1) % 5 AS INTEGER) AS fold FROM r
"""

ORACLE["exact_sample"] = """
WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('99:' || CAST(c_custkey AS VARCHAR)), c_custkey) AS rk,
                  count(*) OVER () AS n FROM customer)
SELECT c_custkey FROM r WHERE rk <= round(0.3 * n)
"""

_SCORED = """
WITH s AS (
  SELECT l.doc_id, l.quality AS label, least(1.0, d.n_chars / 5000.0) AS score,
         CAST(least(1.0, d.n_chars / 5000.0) >= 0.5 AS INTEGER) AS prediction
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id),
cls AS (SELECT DISTINCT cls FROM (SELECT label AS cls FROM s UNION ALL SELECT prediction FROM s) WHERE cls IS NOT NULL),
rep AS (
  SELECT c.cls,
         COALESCE(sum(CAST(s.label = c.cls AND s.prediction = c.cls AS INTEGER)), 0) AS tp,
         COALESCE(sum(CAST(s.label = c.cls AS INTEGER)), 0) AS support,
         COALESCE(sum(CAST(s.prediction = c.cls AS INTEGER)), 0) AS n_pred
  FROM cls c CROSS JOIN s GROUP BY c.cls),
rep2 AS (
  SELECT cls, support,
         CASE WHEN n_pred = 0 THEN 0.0 ELSE tp::DOUBLE / n_pred END AS precision,
         CASE WHEN support = 0 THEN 0.0 ELSE tp::DOUBLE / support END AS recall
  FROM rep),
rep3 AS (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1
  FROM rep2),
summ AS (
  SELECT avg(f1) AS f1_macro, sum(f1 * support) / sum(support)::DOUBLE AS f1_weighted,
         avg(precision) AS precision_macro, avg(recall) AS recall_macro,
         COALESCE(max(CASE WHEN cls = 1 THEN recall END), 0.0) AS recall_positiva,
         (SELECT avg(CAST(label = prediction AS DOUBLE)) FROM s) AS accuracy
  FROM rep3),
g AS (SELECT score, sum(CAST(label = 1 AS INTEGER)) AS pos, sum(CAST(label <> 1 AS INTEGER)) AS neg FROM s GROUP BY score),
auc AS (
  SELECT sum(pos * (neg_below + 0.5 * neg)) / NULLIF(sum(pos) * sum(neg), 0) AS roc_auc
  FROM (SELECT *, COALESCE(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS neg_below FROM g))
"""

ORACLE["confusion_matrix"] = _SCORED + """
SELECT a.cls AS actual, p.cls AS predicted,
       (SELECT count(*) FROM s WHERE s.label = a.cls AND s.prediction = p.cls) AS n
FROM cls a CROSS JOIN cls p
"""

ORACLE["class_report"] = _SCORED + """
SELECT cls, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, support, ROUND(f1, 6) AS f1 FROM rep3
"""

ORACLE["macro_metrics"] = _SCORED + """
SELECT ROUND(f1_macro, 6) AS f1_macro, ROUND(f1_weighted, 6) AS f1_weighted,
       ROUND(precision_macro, 6) AS precision_macro, ROUND(recall_macro, 6) AS recall_macro,
       ROUND(recall_positiva, 6) AS recall_positiva, ROUND(accuracy, 6) AS accuracy
FROM summ
"""

ORACLE["roc_auc"] = _SCORED + "SELECT ROUND(roc_auc, 6) AS roc_auc FROM auc"

ORACLE["roc_curve"] = _SCORED + """
SELECT ROUND(score, 6) AS threshold,
       ROUND(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / (SELECT sum(neg) FROM g)::DOUBLE, 6) AS fpr,
       ROUND(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
             / (SELECT sum(pos) FROM g)::DOUBLE, 6) AS tpr
FROM g
"""

ORACLE["release_gates"] = _SCORED + """
, m AS (SELECT 'f1_macro' AS metric, f1_macro AS value FROM summ
        UNION ALL SELECT 'roc_auc', roc_auc FROM auc
        UNION ALL SELECT 'recall_positiva', recall_positiva FROM summ),
gt AS (SELECT * FROM (VALUES ('f1_macro', 0.70), ('roc_auc', 0.75), ('recall_positiva', 0.65)) t(metric, threshold)),
per AS (SELECT gt.metric, COALESCE(m.value, 0.0) AS value, gt.threshold::DOUBLE AS threshold,
               COALESCE(m.value, 0.0) >= gt.threshold AS passed
        FROM gt LEFT JOIN m ON gt.metric = m.metric)
SELECT metric, ROUND(value, 6) AS value, ROUND(threshold, 6) AS threshold, passed FROM per
UNION ALL SELECT 'all', NULL, NULL, bool_and(passed) FROM per
"""

_REQ = """
WITH r AS (
  SELECT event_id,
         CASE WHEN event_type = 'signup' THEN NULL ELSE value / 40.0 END AS inde,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) / 9.0 AS ian,
         CAST(trunc(hour(ts) / 2) AS INTEGER) AS fase,
         CAST(year(ts) + trunc(value / 100) AS INTEGER) AS ano
  FROM events),
v AS (
  SELECT event_id, concat_ws(';',
     CASE WHEN inde IS NULL THEN 'inde: required' END, CASE WHEN inde < 0 THEN 'inde: below 0' END,
     CASE WHEN inde > 10 THEN 'inde: above 10' END,
     CASE WHEN ian IS NULL THEN 'ian: required' END, CASE WHEN ian < 0 THEN 'ian: below 0' END,
     CASE WHEN ian > 10 THEN 'ian: above 10' END,
     CASE WHEN fase IS NULL THEN 'fase: required' END, CASE WHEN fase < 0 THEN 'fase: below 0' END,
     CASE WHEN fase > 8 THEN 'fase: above 8' END,
     CASE WHEN ano IS NULL THEN 'ano: required' END, CASE WHEN ano < 2020 THEN 'ano: below 2020' END,
     CASE WHEN ano > 2030 THEN 'ano: above 2030' END) AS errors
  FROM r)
"""

ORACLE["validate_input"] = _REQ + "SELECT event_id, errors = '' AS valid, errors FROM v"

ORACLE["quarantine"] = _REQ + """
SELECT event_id, CAST(len(string_split(errors, ';')) AS INTEGER) AS n_errors, errors FROM v WHERE errors <> ''
"""

ORACLE["risk_tier"] = _SCORED + """
SELECT doc_id, CASE WHEN score < 0.40 THEN 'baixo' WHEN score <= 0.70 THEN 'medio' ELSE 'alto' END AS nivel_risco,
       score >= 0.5 AS risco
FROM s
"""

ORACLE["score_record"] = _SCORED + """
SELECT CAST(doc_id AS VARCHAR) AS student_id, score >= 0.5 AS risco_defasagem, ROUND(score, 4) AS probabilidade,
       CASE WHEN score < 0.40 THEN 'baixo' WHEN score <= 0.70 THEN 'medio' ELSE 'alto' END AS nivel_risco,
       '1.0.0' AS modelo_versao
FROM s
"""

_LOG = """
WITH lg AS (
  SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, CAST(user_id AS VARCHAR) AS student_id, event_id,
         CAST(value >= 250 AS INTEGER) AS risco_defasagem, ROUND(least(1.0, value / 500.0), 4) AS probabilidade,
         CASE event_type WHEN 'error' THEN 'alto' WHEN 'purchase' THEN 'medio' WHEN 'view' THEN NULL
                         ELSE 'baixo' END AS nivel_risco
  FROM events),
su AS (
  SELECT count(*) AS total, count(*) FILTER (WHERE nivel_risco IS NOT DISTINCT FROM 'alto') AS alto,
         count(*) FILTER (WHERE nivel_risco IS DISTINCT FROM 'alto') AS baixo_medio,
         max(NULLIF(timestamp, '')) AS ultima
  FROM lg)
"""

ORACLE["log_summary"] = _LOG + "SELECT * FROM su"

ORACLE["kpis"] = _LOG + """
SELECT total AS total_predicoes, alto AS predicoes_alto_risco, ROUND(alto / NULLIF(total, 0)::DOUBLE, 6) AS taxa_risco,
       ultima AS ultima_predicao FROM su
"""

ORACLE["recent_predictions"] = _LOG + "SELECT * FROM lg ORDER BY timestamp DESC NULLS LAST, event_id DESC LIMIT 50"

_NUM_DRIFT = """
WITH src AS (
  SELECT CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'r' ELSE 'c' END AS side,
         l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem),
lng AS (UNPIVOT src ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME "column" VALUE v),
cnt AS (SELECT "column", v, count(*) FILTER (WHERE side = 'r') AS nr, count(*) FILTER (WHERE side = 'c') AS nc
        FROM lng GROUP BY 1, 2),
tot AS (SELECT "column", sum(nr) AS tr, sum(nc) AS tc FROM cnt GROUP BY 1),
sd AS (SELECT "column", stddev_pop(v) AS sd FROM lng WHERE side = 'r' GROUP BY 1),
cum AS (SELECT cnt.*, tot.tr, tot.tc,
               sum(nr) OVER w / tot.tr::DOUBLE AS fr, sum(nc) OVER w / tot.tc::DOUBLE AS fc,
               lead(v) OVER w2 AS v_next
        FROM cnt JOIN tot USING ("column")
        WINDOW w AS (PARTITION BY "column" ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
               w2 AS (PARTITION BY "column" ORDER BY v)),
per AS (SELECT "column", any_value(tr) AS n_ref, any_value(tc) AS n_cur, max(abs(fr - fc)) AS ks_stat,
               sum(abs(fr - fc) * COALESCE(v_next - v, 0)) AS w1
        FROM cum GROUP BY 1),
pv AS (SELECT per.*, sd.sd,
              (sqrt(n_ref * n_cur / (n_ref + n_cur)::DOUBLE) + 0.12
               + 0.11 / sqrt(n_ref * n_cur / (n_ref + n_cur)::DOUBLE)) * ks_stat AS lam
       FROM per LEFT JOIN sd USING ("column")),
fin AS (SELECT "column", n_ref, n_cur, ks_stat,
               CASE WHEN lam < 0.3 THEN 1.0 ELSE least(1.0, greatest(0.0,
                 (SELECT sum(2.0 * pow(-1.0, k - 1) * exp(-2.0 * k * k * lam * lam)) FROM range(1, 101) t(k))))
               END AS p_value,
               w1 / NULLIF(sd, 0.0) AS wasserstein_norm
        FROM pv),
num AS (SELECT *, COALESCE(wasserstein_norm >= 0.1, FALSE)
                  AS drifted FROM fin)
"""

_CAT_DRIFT = """
, esrc AS (SELECT CASE WHEN dayofmonth(ts) <= 15 THEN 'r' ELSE 'c' END AS side, event_type,
                  CAST(CAST(trunc(hour(ts) / 6) AS INTEGER) AS VARCHAR) AS hour_band FROM events),
elng AS (UNPIVOT esrc ON event_type, hour_band INTO NAME "column" VALUE v),
ecnt AS (SELECT "column", v, count(*) FILTER (WHERE side = 'r') AS nr, count(*) FILTER (WHERE side = 'c') AS nc
         FROM elng GROUP BY 1, 2),
etot AS (SELECT "column", sum(nr) AS tr, sum(nc) AS tc FROM ecnt GROUP BY 1),
esh AS (SELECT ecnt."column", nr / tr::DOUBLE AS p, nc / tc::DOUBLE AS q FROM ecnt JOIN etot USING ("column")),
cat AS (
  SELECT "column", count(*) AS n_categories,
         sqrt(greatest(0.5 * sum(CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END)
                     + 0.5 * sum(CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END), 0.0)) AS js_distance,
         sum((greatest(q, 0.0001) - greatest(p, 0.0001)) * ln(greatest(q, 0.0001) / greatest(p, 0.0001))) AS psi
  FROM esh GROUP BY 1),
catd AS (SELECT *, js_distance >= 0.1 AS drifted FROM cat)
"""

ORACLE["drift_numeric"] = _NUM_DRIFT + """
SELECT "column", n_ref, n_cur, ROUND(ks_stat, 6) AS ks_stat, ROUND(p_value, 6) AS p_value,
       ROUND(wasserstein_norm, 6) AS wasserstein_norm, drifted FROM num
"""

ORACLE["drift_categorical"] = _NUM_DRIFT + _CAT_DRIFT + """
SELECT "column", n_categories, ROUND(js_distance, 6) AS js_distance, ROUND(psi, 6) AS psi, drifted FROM catd
"""

ORACLE["drift_tests"] = """
WITH e AS (SELECT CASE WHEN dayofmonth(ts) <= 15 THEN 'r' ELSE 'c' END AS side, event_type,
                  CAST(CAST(trunc(hour(ts) / 6) AS INTEGER) AS VARCHAR) AS hour_band FROM events),
s AS (SELECT *, CAST(hour_band = '0' AS VARCHAR) AS night FROM e),
l AS (UNPIVOT s ON event_type, hour_band, night INTO NAME "column" VALUE v),
c AS (SELECT "column", v, CAST(count(*) FILTER (WHERE side = 'r') AS DOUBLE) AS nr,
             CAST(count(*) FILTER (WHERE side = 'c') AS DOUBLE) AS nc FROM l GROUP BY 1, 2),
t AS (SELECT "column", sum(nr) AS tr, sum(nc) AS tc FROM c GROUP BY 1),
x AS (SELECT "column", count(*) AS n_categories,
             sum(power(nr - (nr + nc) * tr / (tr + tc), 2) / ((nr + nc) * tr / (tr + tc))
               + power(nc - (nr + nc) * tc / (tr + tc), 2) / ((nr + nc) * tc / (tr + tc))) AS statistic
      FROM c JOIN t USING ("column") GROUP BY 1),
p AS (SELECT *, (n_categories - 1) / 2.0::DOUBLE AS a, statistic / 2 AS h FROM x),
q AS (SELECT *, greatest(0.0, 1 - list_sum(list_transform(range(0, 3000), lambda n: exp((a + n) * ln(h) - h - lgamma(a + n + 1))))) AS pv
      FROM p)
SELECT "column", n_categories, ROUND(statistic, 6) AS statistic, CAST(n_categories - 1 AS INTEGER) AS dof,
       ROUND(pv, 6) AS p_value, pv < 0.05 AS drifted, CASE WHEN n_categories = 2 THEN ROUND(sqrt(statistic), 6) END AS z FROM q
"""

ORACLE["drift_summary"] = _NUM_DRIFT + _CAT_DRIFT + """
, allc AS (SELECT "column", drifted FROM num UNION ALL SELECT "column", drifted FROM catd)
SELECT COALESCE(ROUND(count(*) FILTER (WHERE drifted) / NULLIF(count(*), 0)::DOUBLE, 4), 0.0) AS drift_score,
       COALESCE(string_agg("column", ',' ORDER BY "column") FILTER (WHERE drifted), '') AS drifted_features,
       count(*) AS n_columns,
       COALESCE(ROUND(count(*) FILTER (WHERE drifted) / NULLIF(count(*), 0)::DOUBLE, 4), 0.0) > 0.15
         AS drift_detected
FROM allc
"""

ORACLE["standardize"] = """
WITH s AS (SELECT avg(p_retailprice) AS m1, stddev_pop(p_retailprice) AS s1,
                  avg(CAST(p_size AS DOUBLE)) AS m2, stddev_pop(CAST(p_size AS DOUBLE)) AS s2 FROM part)
SELECT p_partkey,
       ROUND(CASE WHEN s1 = 0 THEN 0.0 ELSE (p_retailprice - m1) / s1 END, 6) AS p_retailprice_std,
       ROUND(CASE WHEN s2 = 0 THEN 0.0 ELSE (p_size - m2) / s2 END, 6) AS p_size_std
FROM part CROSS JOIN s
"""

ORACLE["one_hot"] = """
SELECT c_custkey,
       CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_AUTOMOBILE,
       CASE WHEN c_mktsegment = 'BUILDING' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_BUILDING,
       CASE WHEN c_mktsegment = 'FURNITURE' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_FURNITURE,
       CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_HOUSEHOLD,
       CASE WHEN c_mktsegment = 'MACHINERY' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_MACHINERY
FROM customer
"""

ORACLE["csv_roundtrip"] = """
SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_acctbal < 0 THEN 'Não' ELSE 'Sim' END AS em_risco FROM customer
"""

ORACLE["jsonl_lenient"] = _LOG + "SELECT * FROM lg"

ORACLE["registry_latest"] = """
WITH r AS (SELECT 'v' || CAST(year(o_orderdate) AS VARCHAR) AS version, max(o_orderdate) AS trained_at,
                  'RandomForestClassifier' AS algorithm, count(*) AS n_rows
           FROM orders GROUP BY year(o_orderdate))
SELECT * FROM r ORDER BY trained_at DESC LIMIT 1
"""

ORACLE["stream_score"] = _REQ + """
, sc AS (SELECT r.event_id, v.errors = '' AS valid, least(1.0, e.value / 500.0) AS p
         FROM r JOIN v ON r.event_id = v.event_id JOIN events e ON e.event_id = r.event_id)
SELECT event_id, valid, CASE WHEN valid THEN ROUND(p, 4) END AS probabilidade,
       CASE WHEN valid THEN CASE WHEN p < 0.40 THEN 'baixo' WHEN p <= 0.70 THEN 'medio' ELSE 'alto' END END
         AS nivel_risco
FROM sc
"""

ORACLE["stream_counters"] = _LOG + """
SELECT COALESCE(nivel_risco, '(none)') AS nivel_risco, count(*) AS n, max(NULLIF(timestamp, '')) AS ultima
FROM lg GROUP BY 1
"""

ORACLE["serving_features"] = """
WITH r AS (
  SELECT CAST(event_id AS VARCHAR) AS student_id,
         value / 50.0 AS inde, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 10.0 AS ian,
         value / 40.0 AS ida, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 12.0 AS ieg,
         value / 60.0 AS iaa, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 11.0 AS ips,
         value / 45.0 AS ipp, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 13.0 AS ipv,
         CAST(trunc(hour(ts) / 3) AS INTEGER) AS fase, CAST(year(ts) AS INTEGER) AS ano,
         event_type = 'purchase' AS ponto_de_virada
  FROM events)
SELECT student_id,
       ROUND((ips + ipp + ipv) / 3, 6) AS INDICE_BEMESTAR,
       ROUND((ida + ieg + iaa) / 3, 6) AS INDICE_PERFORMANCE,
       ROUND(iaa - ida, 6) AS GAP_AUTO_REAL,
       ROUND(inde * CAST(fase AS DOUBLE), 6) AS INDE_x_FASE,
       ROUND(((ips + ipp + ipv) / 3) * ((ida + ieg + iaa) / 3), 6) AS BEMESTAR_x_PERFORMANCE,
       0 AS ABAIXO_MEDIA_GERAL, 0.0::DOUBLE AS EVOLUCAO_INDE, CAST(fase AS DOUBLE) AS FASE, ano AS ANO,
       CASE WHEN ponto_de_virada THEN 'Sim' ELSE 'Não' END AS PONTO_DE_VIRADA
FROM r
"""

ORACLE["group_median_overwrite"] = """
WITH p AS (
  SELECT p_partkey,
         CASE WHEN p_size <= 3 THEN NULL ELSE p_brand END AS brand,
         CASE WHEN p_brand = 'Brand#7' OR p_size BETWEEN 40 AND 45 THEN NULL ELSE p_retailprice END AS price,
         CASE WHEN p_type = 'SMALL' THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size
  FROM part),
hn AS (SELECT bool_or(price IS NULL) AS hp, bool_or(size IS NULL) AS hs FROM p),
g AS (SELECT brand, median(price) AS gp, median(size) AS gs FROM p WHERE brand IS NOT NULL GROUP BY brand),
s1 AS (SELECT p.p_partkey, p.brand,
              CASE WHEN p.brand IS NULL AND hn.hp THEN NULL ELSE COALESCE(p.price, g.gp) END AS price,
              CASE WHEN p.brand IS NULL AND hn.hs THEN NULL ELSE COALESCE(p.size, g.gs) END AS size
       FROM p CROSS JOIN hn LEFT JOIN g ON p.brand = g.brand),
a AS (SELECT median(price) AS ap, median(size) AS asz FROM s1)
SELECT p_partkey, brand, ROUND(COALESCE(price, a.ap), 6) AS price, ROUND(COALESCE(size, a.asz), 6) AS size
FROM s1 CROSS JOIN a
"""


ORACLE["split_null_keys"] = """
WITH d AS (SELECT quality AS label, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1),
s AS (SELECT 'split' AS part, 'test' AS name, label, CAST(ceil(0.2 * n) AS BIGINT) AS n FROM d
      UNION ALL SELECT 'split', 'train', label, n - CAST(ceil(0.2 * n) AS BIGINT) FROM d),
f AS (SELECT 'fold' AS part, CAST(k AS VARCHAR) AS name, label, CAST((n - k + 4) // 5 AS BIGINT) AS n FROM d, range(5) t(k))
SELECT part, name, CAST(label AS VARCHAR) AS label, n FROM s WHERE n > 0
UNION ALL SELECT part, name, CAST(label AS VARCHAR), n FROM f WHERE n > 0
UNION ALL SELECT 'sample', 'all', NULL, CAST(round(0.3 * sum(n)) AS BIGINT) FROM d
"""

_ODD_DRIFT = (_NUM_DRIFT
    .replace("l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem)",
             "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS with_nan, "
             "CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN CAST(l_tax AS DOUBLE) END AS one_side, "
             "CAST(l_quantity AS DOUBLE) / 100 + 1e9 AS \"offset\" FROM lineitem)")
    .replace("UNPIVOT src ON l_quantity, l_extendedprice, l_discount, l_tax", "UNPIVOT src ON with_nan, one_side, \"offset\"")
    .replace("tot.tr::DOUBLE AS fr", "NULLIF(tot.tr, 0)::DOUBLE AS fr").replace("tot.tc::DOUBLE AS fc", "NULLIF(tot.tc, 0)::DOUBLE AS fc")
    .replace("/ (n_ref + n_cur)::DOUBLE)", "/ NULLIF(least(n_ref, n_cur) + greatest(n_ref, n_cur), 0)::DOUBLE)"))
ORACLE["drift_odd_values"] = _ODD_DRIFT + """
SELECT "column", n_ref, n_cur, ROUND(ks_stat, 6) AS ks_stat,
       CASE WHEN least(n_ref, n_cur) > 0 THEN ROUND(p_value, 6) END AS p_value,
       CASE WHEN least(n_ref, n_cur) > 0 THEN ROUND(wasserstein_norm, 6) END AS wasserstein_norm,
       CASE WHEN least(n_ref, n_cur) > 0 THEN drifted ELSE FALSE END AS drifted FROM num
"""

ORACLE["lag_odd_entities"] = """
WITH o AS (SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_totalprice AS DOUBLE) AS price,
                  CASE WHEN o_orderkey % 3 = 1 THEN -1 WHEN o_orderkey % 3 = 2 THEN o_custkey END AS entity FROM orders)
SELECT o_orderkey, year, ROUND(price, 6) AS price, entity,
       ROUND(CASE WHEN entity IS NULL THEN 0.0
                  ELSE COALESCE(price - lag(price) OVER (PARTITION BY entity ORDER BY year, o_orderkey), 0.0) END, 6) AS diff
FROM o
"""

ORACLE["csv_comma"] = """SELECT c_custkey, c_name || ' ção, "€"' AS c_name FROM customer"""

ORACLE["jsonl_append"] = _LOG + "SELECT * FROM lg"

ORACLE["evaluation_report"] = f"""
WITH g AS ({ORACLE["release_gates"]}), c AS ({ORACLE["confusion_matrix"]}), r AS ({ORACLE["class_report"]}),
a AS (SELECT 'gates' AS section, metric AS name, CAST(value AS DOUBLE) AS value,
             CASE WHEN passed THEN 'OK' ELSE 'REPROVADO' END AS detail FROM g
      UNION ALL SELECT 'confusion', actual || '->' || predicted, CAST(n AS DOUBLE), NULL FROM c
      UNION ALL SELECT 'class_precision', CAST(cls AS VARCHAR), precision, NULL FROM r
      UNION ALL SELECT 'class_recall', CAST(cls AS VARCHAR), recall, NULL FROM r
      UNION ALL SELECT 'class_f1', CAST(cls AS VARCHAR), f1, NULL FROM r
      UNION ALL SELECT 'class_support', CAST(cls AS VARCHAR), CAST(support AS DOUBLE), NULL FROM r)
SELECT section, name, ROUND(value, 6) AS value, detail, 'run1' AS run_id FROM a
"""

ORACLE["drift_report"] = f"""
WITH d AS ({ORACLE["drift_numeric"]}),
a AS (SELECT 'column_n_ref' AS section, "column" AS name, CAST(n_ref AS DOUBLE) AS value, CAST(drifted AS VARCHAR) AS detail FROM d
      UNION ALL SELECT 'column_n_cur', "column", CAST(n_cur AS DOUBLE), CAST(drifted AS VARCHAR) FROM d
      UNION ALL SELECT 'column_ks_stat', "column", ks_stat, CAST(drifted AS VARCHAR) FROM d
      UNION ALL SELECT 'column_p_value', "column", p_value, CAST(drifted AS VARCHAR) FROM d
      UNION ALL SELECT 'column_wasserstein_norm', "column", wasserstein_norm, CAST(drifted AS VARCHAR) FROM d
      UNION ALL SELECT 'summary', 'drift_score', CAST(ROUND(count(*) FILTER (WHERE drifted) / count(*)::DOUBLE, 4) AS DOUBLE),
                       COALESCE(string_agg("column", ',' ORDER BY "column") FILTER (WHERE drifted), '') FROM d)
SELECT section, name, ROUND(value, 6) AS value, detail, 'run1' AS run_id FROM a
"""

ORACLE["global_median_impute"] = """
WITH p AS (
  SELECT p_partkey,
         CASE WHEN p_brand = 'Brand#7' OR p_size BETWEEN 40 AND 45 THEN NULL ELSE p_retailprice END AS price,
         CASE WHEN p_type = 'SMALL' THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size
  FROM part),
a AS (SELECT median(price) AS ap, median(size) AS asz FROM p)
SELECT p_partkey, ROUND(COALESCE(price, ap), 6) AS price, ROUND(COALESCE(size, asz), 6) AS size FROM p CROSS JOIN a
"""

ORACLE["feature_projection"] = """
WITH p AS (
  SELECT p_partkey,
         CASE WHEN p_size <= 3 THEN NULL ELSE p_brand END AS brand,
         CASE WHEN p_brand = 'Brand#7' OR p_size BETWEEN 40 AND 45 THEN NULL ELSE p_retailprice END AS price,
         CASE WHEN p_type = 'SMALL' THEN NULL ELSE CAST(p_size AS DOUBLE) END AS size
  FROM part)
SELECT p_partkey, price, size, brand FROM p WHERE brand IS NOT NULL AND price IS NOT NULL AND size IS NOT NULL
"""

ORACLE["batch_score"] = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
r AS (SELECT CAST(event_id AS VARCHAR) AS student_id,
             [value / 50.0, k / 10.0, value / 40.0, k / 12.0, value / 60.0, k / 11.0, value / 45.0, k / 13.0] AS scores,
             trunc(hour(ts) / 3) AS fase, year(ts) AS ano FROM e),
n AS (SELECT student_id, CAST(len(list_filter(scores, lambda x: x IS NULL OR x < 0 OR x > 10))
             + CAST(fase IS NULL OR fase < 0 OR fase > 8 AS INTEGER) + CAST(ano IS NULL OR ano < 2020 OR ano > 2030 AS INTEGER)
             AS INTEGER) AS n_errors FROM r)
SELECT student_id, CASE WHEN n_errors = 0 THEN '1.0.0' END AS modelo_versao, CASE WHEN n_errors = 0 THEN TRUE END AS same, n_errors FROM n
"""
