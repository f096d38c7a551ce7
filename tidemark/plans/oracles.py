"""DuckDB SQL of the queries in catalog.py, written against the driver's tables."""

from __future__ import annotations

T = "TIMESTAMP '2000-11-01'"
TE = "TIMESTAMP '2024-01-25'"


def d(expr: str, name: str) -> str:
    """A floating result: rounded away from ties, as the query's; quotients by 1e-9 to millions."""
    x = f"CAST({expr} AS DOUBLE)"
    return f'CASE WHEN abs({x}) >= 1e11 THEN round({x} / 1e6) * 1e6 ELSE round({x} + 3.3e-8, 5) END AS "{name}"'


def i(expr: str, name: str) -> str:
    return f'CAST({expr} AS BIGINT) AS "{name}"'


def r(a: str, b: str) -> str:
    return f"({a}) / (({b}) + CAST(1e-9 AS DOUBLE))"


HOLIDAY = "CAST((md >= '12-01' OR md <= '01-15' OR md IN ('03-21','04-27','05-01','06-16','08-09','09-24','12-16','12-25','12-26')) AS INT)"
TXN = f"""txn AS (
  SELECT *, {HOLIDAY} AS hol, CAST(isodow(ts) >= 6 AS INT) AS wk, CAST(date_trunc('month', ts) AS DATE) AS ym FROM (
    SELECT o_custkey AS c, l_shipdate AS ts, strftime(l_shipdate, '%m-%d') AS md, CASE WHEN l_returnflag IN ('A', 'R') THEN 'debit' ELSE 'credit' END AS dc, abs(l_extendedprice) AS a,
      l_returnflag || '-' || l_linestatus AS channel, p_type AS category, l_extendedprice * (1 - l_discount) - 30000 AS bal
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey))"""
MON = TXN + """, mon0 AS (
  SELECT c, ym, count(*) AS n, sum(a) AS amt, avg(a) AS mean, max(a) AS mx, min(a) AS mn, stddev_samp(a) AS sd, count(*) FILTER (dc = 'debit') AS dcnt, count(*) FILTER (dc = 'credit') AS ccnt,
    sum(wk) AS wk, sum(hol) AS hol, coalesce(sum(a) FILTER (dc = 'debit'), 0) AS dsum, coalesce(sum(a) FILTER (dc = 'credit'), 0) AS csum,
    coalesce(avg(a) FILTER (dc = 'debit' AND a > 0), 0) AS dmean, coalesce(avg(a) FILTER (dc = 'credit' AND a > 0), 0) AS cmean
  FROM txn GROUP BY c, ym),
mon AS (SELECT *, CASE WHEN ccnt > 0 THEN dcnt / ccnt END AS dcr, CASE WHEN csum > 0 THEN dsum / csum END AS dcar, """ + f"{r('wk', 'n')} AS wf, {r('hol', 'n')} AS hf, {r('sd', 'mean')} AS cv, csum - dsum AS nf FROM mon0)"  # fmt: skip

ORACLES: dict[str, str] = {}


def _with(ctes: str, select: str) -> str:
    return f"WITH {ctes} {select}"


ORACLES["read_pruned"] = f"SELECT {i('l_orderkey', 'l_orderkey')}, l_shipdate, {d('l_extendedprice', 'l_extendedprice')}, l_returnflag FROM lineitem"
COHORT = "CAST('0x' || substr(md5(CAST({} AS VARCHAR)), 1, 8) AS BIGINT) % 100 < 30"
ORACLES["cohort_sample"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, {i('count(*)', 'n')}, {d('sum(a)', 'amount')} FROM txn WHERE {COHORT.format('c')} GROUP BY c")
ORACLES["clean_txn"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, ts AS txn_ts, dc AS debit_credit, {d('a', 'amount_abs')}, channel, category, {d('bal', 'balance')} FROM txn")
SNAP = """snap AS (SELECT user_id AS c, ts, event_id AS e, CASE WHEN event_type <> 'error' THEN value END AS bal, CASE WHEN event_type <> 'signup' THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events)"""
_fill = "coalesce(last_value({0} IGNORE NULLS) OVER (PARTITION BY c ORDER BY ts, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({0} IGNORE NULLS) OVER (PARTITION BY c ORDER BY ts, e ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"
ORACLES["snapshot_fill"] = _with(SNAP, f"SELECT {i('c', 'customer_id')}, {i('e', 'event_id')}, {d(_fill.format('bal'), 'bal')}, {i(_fill.format('k'), 'k')} FROM snap")
ORACLES["latest_snapshot"] = _with(SNAP, f"SELECT {i('c', 'customer_id')}, {d('arg_max(bal, (ts, e)) FILTER (bal IS NOT NULL)', 'bal')}, {i('arg_max(k, (ts, e)) FILTER (k IS NOT NULL)', 'k')} FROM snap GROUP BY c")
DEMO = """demo AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS bal, CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS seg, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
ORACLES["impute_median"] = _with(DEMO, f"SELECT {i('c', 'customer_id')}, {d('coalesce(bal, (SELECT median(bal) FROM demo))', 'c_acctbal')} FROM demo")
ORACLES["label_encode"] = _with(DEMO, f"SELECT {i('c', 'customer_id')}, {i('''dense_rank() OVER (ORDER BY coalesce(seg, 'Unknown')) - 1''', 'c_mktsegment_enc')}, {i('dense_rank() OVER (ORDER BY n_name) - 1', 'n_name_enc')} FROM demo")
ORACLES["freq_encode"] = _with(DEMO, f"SELECT {i('c', 'customer_id')}, {d('count(*) OVER (PARTITION BY c_name) / (SELECT count(c_name) FROM demo)', 'c_name_freq_enc')}, {d('CASE WHEN seg IS NULL THEN 0 ELSE count(seg) OVER (PARTITION BY seg) / (SELECT count(seg) FROM demo) END', 'c_mktsegment_freq_enc')} FROM demo")
_days = "CAST(floor(({0}) / 86400000000.0) AS BIGINT)"
ORACLES["calendar"] = _with(TXN, "SELECT DISTINCT " + ", ".join([
    "ts AS txn_ts", i("year(ts)", "txn_year"), i("month(ts)", "txn_month"), i("quarter(ts)", "txn_quarter"), i("isodow(ts) - 1", "txn_dayofweek"), i("day(ts)", "txn_day"), i("wk", "txn_is_weekend"),
    i("day(ts) = 1", "txn_is_month_start"), i("CAST(ts AS DATE) = last_day(ts)", "txn_is_month_end"), i(_days.format("epoch_us(ts) - epoch_us(TIMESTAMP '2012-12-01')"), "days_since_start"),
    "CAST(ym AS VARCHAR) AS ym", i("day(last_day(ts)) - day(ts)", "days_to_month_end")]) + " FROM txn")
ORACLES["holiday_flag"] = _with(TXN, f"SELECT md, {i('max(hol)', 'is_holiday')}, {i('count(*)', 'n')} FROM txn GROUP BY md")
_turn = "{0}(2 * pi() * {1} / {2}.0)"
ORACLES["cyclical"] = _with(TXN, "SELECT DISTINCT ts AS txn_ts, " + ", ".join(d(_turn.format(f, f"{p}(ts)", n), f"txn_{p}_{f}") for p, n in (("month", 12), ("quarter", 4)) for f in ("sin", "cos")) + " FROM txn")
ORACLES["monthly"] = _with(MON, "SELECT " + ", ".join([i("c", "customer_id"), "CAST(ym AS VARCHAR) AS ym", i("n", "monthly_txn_count")] + [d(x, k) for x, k in {
    "amt": "monthly_total_amt", "mean": "monthly_mean_amt", "mx": "monthly_max_amt", "mn": "monthly_min_amt", "sd": "monthly_std_amt", "dsum": "monthly_debit_sum", "csum": "monthly_credit_sum", "dmean": "monthly_debit_mean", "cmean": "monthly_credit_mean",
    "dcr": "debit_credit_ratio", "dcar": "debit_credit_amount_ratio", "wf": "weekend_txn_frac", "hf": "holiday_txn_frac_monthly", "cv": "amt_cv", "nf": "net_flow"}.items()]
    + [i(x, k) for x, k in {"dcnt": "monthly_debit_cnt", "ccnt": "monthly_credit_cnt", "wk": "monthly_weekend_cnt", "hol": "monthly_holiday_cnt"}.items()]) + " FROM mon")
HIST = MON + f""", hist AS (SELECT c, count(DISTINCT ym) AS months, sum(n) AS total, avg(n) AS mean_n, stddev_samp(n) AS sd_n, quantile_cont(n, 0.5) AS med, max(n) AS mx_n, min(n) AS mn_n, quantile_cont(n, 0.75) AS q75, quantile_cont(n, 0.25) AS q25,
  sum(amt) AS s_amt, avg(amt) AS m_amt, stddev_samp(amt) AS sd_amt, max(amt) AS mx_amt, avg(dcr) AS m_dcr, stddev_samp(dcr) AS sd_dcr, avg(wf) AS m_wf, avg(hf) AS m_hf, avg(cv) AS m_cv, count(*) FILTER (n = 0) AS zero,
  sum(dsum) AS s_d, sum(csum) AS s_c, avg(dsum) AS m_d, avg(csum) AS m_c, avg(nf) AS m_nf, stddev_samp(nf) AS sd_nf FROM mon GROUP BY c)"""
ORACLES["history"] = _with(HIST, "SELECT " + ", ".join([i("c", "customer_id"), i("months", "hist_months_active"), i("total", "hist_total_txn"), i("mx_n", "hist_max_monthly_txn"), i("mn_n", "hist_min_monthly_txn"), i("zero", "hist_zero_months")] + [d(x, f"hist_{k}") for k, x in {
    "mean_monthly_txn": "mean_n", "std_monthly_txn": "sd_n", "median_monthly_txn": "med", "q75_monthly_txn": "q75", "q25_monthly_txn": "q25", "total_amount": "s_amt", "mean_amount": "m_amt", "std_amount": "sd_amt", "max_amount": "mx_amt",
    "mean_debit_ratio": "m_dcr", "std_debit_ratio": "sd_dcr", "mean_weekend_frac": "m_wf", "mean_holiday_frac": "m_hf", "mean_amt_cv": "m_cv", "total_debit_sum": "s_d", "total_credit_sum": "s_c", "mean_debit_sum": "m_d", "mean_credit_sum": "m_c",
    "mean_net_flow": "m_nf", "std_net_flow": "sd_nf", "cv_txn": r("sd_n", "mean_n"), "iqr_txn": "q75 - q25", "activity_rate": r("months - zero", "months"), "amount_per_txn": r("s_amt", "total"), "debit_credit_amount_ratio": r("s_d", "s_c"), "txn_cv": r("sd_n", "mean_n")}.items()]) + " FROM hist")
_month = lambda k: f"(DATE '2000-11-01' - INTERVAL {k} MONTH)"
_rolled = {"mean_txn": "avg(n)", "std_txn": "stddev_samp(n)", "total_amt": "sum(amt)", "mean_amt": "avg(amt)", "debit_ratio": "avg(dcr)", "weekend_frac": "avg(wf)", "debit_sum": "sum(dsum)", "credit_sum": "sum(csum)", "net_flow": "sum(nf)"}
_roll = []
for _n in (1, 3, 6, 12):
    _w = f" FILTER (ym BETWEEN {_month(_n)} AND DATE '2000-11-01')"
    _roll += [i(f"{x}{_w}", f"roll{_n}m_{k}") for k, x in {"txn_count": "sum(n)", "max_txn": "max(n)", "debit_cnt": "sum(dcnt)", "credit_cnt": "sum(ccnt)"}.items()] + [d(x + _w, f"roll{_n}m_{k}") for k, x in _rolled.items()]
    _roll.append(d(r(f"sum(dsum){_w}", f"sum(csum){_w}"), f"roll{_n}m_dc_amt_ratio"))
ORACLES["rolling"] = _with(MON, f"SELECT {i('c', 'customer_id')}, " + ", ".join(_roll) + " FROM mon GROUP BY c")
_lag = lambda k, x: f"max({x}) FILTER (ym = {_month(k - 1)})"
_lags = [i(_lag(k, "n"), f"lag{k}m_txn") for k in (1, 2, 3, 6, 12)] + [d(_lag(k, x), f"lag{k}m_{name}") for k in (1, 2, 3, 6, 12) for name, x in {"amt": "amt", "debit_ratio": "dcr", "mean_amt": "mean", "debit_sum": "dsum", "credit_sum": "csum", "net_flow": "nf"}.items()]
_lags += [d(f"({_lag(1, x)} - {_lag(2, x)}) / nullif({_lag(2, x)}, 0)", f"mom_{k}_growth") for k, x in (("txn", "n"), ("amt", "amt"))] + [i(f"({_lag(1, 'n')} - {_lag(2, 'n')}) - ({_lag(2, 'n')} - {_lag(3, 'n')})", "txn_acceleration")]
ORACLES["lags"] = _with(MON, f"SELECT {i('c', 'customer_id')}, " + ", ".join(_lags) + " FROM mon GROUP BY c")
_in = lambda x, n: f"{x} FILTER (ym BETWEEN {_month(n)} AND DATE '2000-11-01')"
ORACLES["trend"] = _with(MON, f"SELECT {i('c', 'customer_id')}, {d(_in('sum(n)', 3) + ' / nullif(' + _in('sum(n)', 6) + ' / 2, 0)', 'growth_3m_vs_6m')}, {d(_in('sum(n)', 1) + ' / nullif(' + _in('avg(n)', 3) + ', 0)', 'trend_1m_vs_3m')} FROM mon GROUP BY c")
ORACLES["yearly_mean"] = _with(MON, f"SELECT {i('c', 'customer_id')}, {d('avg(s)', 'hist_mean_yearly_txn')} FROM (SELECT c, year(ym) AS y, sum(n) AS s FROM mon GROUP BY c, y) GROUP BY c")
_season = []
for _k, _name in ((11, "nov"), (12, "dec"), (1, "jan")):
    _w = f" FILTER (month(ym) = {_k})"
    _season += [d(x + _w, f"hist_{_name}_{y}") for y, x in {"mean_txn": "avg(n)", "std_txn": "stddev_samp(n)", "mean_amt": "avg(amt)", "mean_debit": "avg(dsum)", "mean_credit": "avg(csum)"}.items()] + [i("max(n)" + _w, f"hist_{_name}_max_txn")]
_dec, _nov = "avg(n) FILTER (month(ym) = 12)", "avg(n) FILTER (month(ym) = 11)"
_season += [d(r(_dec, "avg(n)"), "dec_spike_ratio"), d(r(f"{_dec} * 12", "sum(n) / count(DISTINCT year(ym))"), "dec_yearly_ratio"), d(r(_dec, _nov), "nov_dec_ratio")]
ORACLES["month_season"] = _with(MON, f"SELECT {i('c', 'customer_id')}, " + ", ".join(_season) + " FROM mon GROUP BY c")
_f, _q = " FILTER (month(ym) IN (12, 1))", " FILTER (month(ym) IN (10, 11, 12))"
ORACLES["festive_q4"] = _with(MON, f"SELECT {i('c', 'customer_id')}, {d(f'coalesce(avg(n){_f}, 0)', 'festive_mean_txn')}, {i(f'coalesce(sum(n){_f}, 0)', 'festive_total_txn')}, {d(f'coalesce(avg(amt){_f}, 0)', 'festive_mean_amt')}, {d(f'coalesce(avg(n){_q}, 0)', 'hist_q4_mean_txn')}, {i(f'coalesce(sum(n){_q}, 0)', 'hist_q4_total_txn')} FROM mon GROUP BY c")
ORACLES["streaks"] = _with(MON, f"SELECT {i('c', 'customer_id')}, {i('count(*)', 'streak_longest_active')}, {i('0', 'streak_longest_inactive')} FROM mon GROUP BY c")
_spine = MON + """, ends AS (SELECT c, min(ym) AS lo, max(ym) AS hi FROM mon GROUP BY c),
days AS (SELECT c, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS ym FROM ends),
dense AS (SELECT days.c, days.ym, coalesce(n, 0) > 0 AS on_ FROM days LEFT JOIN mon ON days.c = mon.c AND days.ym = mon.ym),
runs AS (SELECT c, on_, count(*) AS len FROM (SELECT c, on_, row_number() OVER (PARTITION BY c ORDER BY ym) - row_number() OVER (PARTITION BY c, on_ ORDER BY ym) AS g FROM dense) GROUP BY c, on_, g)"""
ORACLES["streaks_dense"] = _with(_spine, f"SELECT {i('c', 'customer_id')}, {i('coalesce(max(len) FILTER (on_), 0)', 'streak_longest_active')}, {i('coalesce(max(len) FILTER (NOT on_), 0)', 'streak_longest_inactive')} FROM runs GROUP BY c")
ORACLES["gini"] = _with(MON, f"SELECT {i('c', 'customer_id')}, {d('coalesce(sum((2 * k - m - 1) * n) / nullif(any_value(m) * sum(n), 0), 0)', 'consistency_gini')} FROM (SELECT c, n, row_number() OVER (PARTITION BY c ORDER BY n) AS k, count(*) OVER (PARTITION BY c) AS m FROM mon) GROUP BY c")
_vel = []
for _n in (7, 14, 30, 60, 90):
    _w = f" FILTER (ts > {T} - INTERVAL {_n} DAY)"
    _vel += [i("count(*)" + _w, f"vel_{_n}d_txn_count"), d(f"coalesce(sum(a){_w}, 0)", f"vel_{_n}d_total_amt"), d(f"coalesce(avg(a){_w}, 0)", f"vel_{_n}d_mean_amt")]
    _vel += [i(f"count(*) FILTER (ts > {T} - INTERVAL {_n} DAY AND dc = '{s}')", f"vel_{_n}d_{s}_count") for s in ("debit", "credit")]
_cnt = lambda n: f"count(*) FILTER (ts > {T} - INTERVAL {n} DAY)"
_vel += [d(r(_cnt(a), f"{_cnt(b)} / CAST({by} AS DOUBLE)"), f"vel_ratio_{a}_{b}") for a, b, by in ((30, 90, 3.0), (7, 30, 4.3), (14, 60, 4.3))]
ORACLES["velocity"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, " + ", ".join(_vel) + f" FROM txn WHERE ts > {T} - INTERVAL 90 DAY AND ts <= {T} GROUP BY c")


def _decay(source: str, t: str) -> str:
    w = lambda h: f"exp(-ln(2) / {h} * days)"
    out = []
    for h in (30, 90, 180):
        deb, cre = f"sum({w(h)} * deb)", f"sum({w(h)} * (1 - deb))"
        out += [d(f"sum({w(h)})", f"decay{h}d_w_count"), d(f"coalesce(sum({w(h)} * a), 0)", f"decay{h}d_w_amt"), d(deb, f"decay{h}d_w_debit"), d(cre, f"decay{h}d_w_credit"), d(r(deb, cre), f"decay{h}d_dc_ratio")]
    out += [d(r(f"sum({w(30)})", f"sum({w(h)})"), f"decay_trend_30_{h}") for h in (90, 180)]
    return f"SELECT {i('c', 'customer_id')}, " + ", ".join(out) + f" FROM (SELECT c, a, CAST(dc = 'debit' AS INT) AS deb, {_days.format(f'epoch_us({t}) - epoch_us(ts)')} AS days FROM {source} WHERE ts <= {t}) GROUP BY c"


ORACLES["decay"] = _with(TXN, _decay("txn", T))
EV = "ev AS (SELECT user_id AS c, ts, CASE WHEN value < 0 THEN 'debit' ELSE 'credit' END AS dc, abs(value) AS a FROM events)"
ORACLES["decay_events"] = _with(EV, _decay("ev", TE))
_dc = []
for _s in ("debit", "credit"):
    _w = f" FILTER (dc = '{_s}')"
    _x = {"sum": "sum(a)", "mean": "avg(a)", "std": "stddev_samp(a)", "median": "quantile_cont(a, 0.5)", "min": "min(a)", "max": "max(a)", "q25": "quantile_cont(a, 0.25)", "q75": "quantile_cont(a, 0.75)"}
    _dc += [i(f"count(a){_w}", f"dc_{_s}_count")] + [d(f"coalesce({x}{_w}, 0)", f"dc_{_s}_{k}") for k, x in _x.items()] + [d(r(f"coalesce(stddev_samp(a){_w}, 0)", f"coalesce(avg(a){_w}, 0)"), f"dc_{_s}_cv")]
_nd, _nc, _sd, _sc = "count(a) FILTER (dc = 'debit')", "count(a) FILTER (dc = 'credit')", "coalesce(sum(a) FILTER (dc = 'debit'), 0)", "coalesce(sum(a) FILTER (dc = 'credit'), 0)"
_dc += [d(r(_nd, _nc), "dc_freq_ratio"), d(r(_sd, _sc), "dc_amount_ratio"), d(f"{_sc} - {_sd}", "dc_net_flow"), d(r(_nd, f"{_nd} + {_nc}"), "dc_debit_dominance")]
ORACLES["debit_credit"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, " + ", ".join(_dc) + " FROM txn GROUP BY c")
_e = " FILTER (CAST(ts AS DATE) = last_day(ts))"
_bal = {"bal_mean": "avg(bal)", "bal_std": "stddev_samp(bal)", "bal_min": "min(bal)", "bal_max": "max(bal)", "bal_median": "median(bal)", "bal_overdraft_freq": "avg(CASE WHEN bal < 0 THEN 1.0 ELSE 0.0 END)", "bal_eom_mean": f"avg(bal){_e}", "bal_eom_std": f"stddev_samp(bal){_e}", "bal_eom_min": f"min(bal){_e}"}
ORACLES["balance"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, " + ", ".join(d(f"coalesce({x}, 0)", k) for k, x in _bal.items()) + f", {d(r('coalesce(stddev_samp(bal), 0)', 'abs(coalesce(avg(bal), 0))'), 'bal_volatility')}, {d('max(bal) - min(bal)', 'bal_range')} FROM txn GROUP BY c")
CAT = TXN + ", cat AS (SELECT c, category AS value, count(*) AS n FROM txn WHERE category IS NOT NULL GROUP BY c, category)"
ORACLES["category_counts"] = _with(CAT, f"SELECT {i('c', 'customer_id')}, value, {i('n', 'n')} FROM cat")
_tf = r("n", "sum(n) OVER (PARTITION BY c)")
ORACLES["category_frac"] = _with(CAT, f"SELECT {i('c', 'customer_id')}, value, {d(_tf, 'tf')} FROM cat")
ORACLES["tfidf"] = _with(CAT, f"SELECT {i('c', 'customer_id')}, value, {d(f'{_tf} * ln(CAST((SELECT count(DISTINCT c) FROM cat) AS DOUBLE) / (count(*) OVER (PARTITION BY value) + 1))', 'tfidf')} FROM cat")
ORACLES["diversity"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, {i('count(DISTINCT channel)', 'n_unique_channels')}, {i('count(DISTINCT category)', 'n_unique_categories')} FROM txn GROUP BY c")
_since = lambda f, t: _days.format(f"epoch_us({t}) - epoch_us({f}(ts))")
for _name, _src, _cte, _t in (("recency", "txn", TXN, T), ("recency_events", "ev", EV, TE)):
    ORACLES[_name] = _with(_cte, f"SELECT {i('c', 'customer_id')}, {i(_since('max', _t), 'days_since_last_txn')}, {i(_since('min', _t), 'customer_tenure_days')} FROM {_src} GROUP BY c")
    _gap = _days.format("epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY c ORDER BY ts))")
    ORACLES[_name.replace("recency", "txn_gap")] = _with(_cte, f"SELECT {i('c', 'customer_id')}, {d('avg(g)', 'avg_days_between_txn')} FROM (SELECT c, {_gap} AS g FROM {_src}) GROUP BY c")
_q = lambda p: f"quantile_cont(a, {p})"
_amt = {"amt_total": "coalesce(sum(a), 0)", "amt_mean": "avg(a)", "amt_median": _q(0.5), "amt_std": "stddev_samp(a)", "amt_max": "max(a)", "amt_min": "min(a)", "amt_q25": _q(0.25), "amt_q75": _q(0.75), "amt_q90": _q(0.9),
        "amt_skew": "CASE WHEN count(a) >= 3 THEN CASE WHEN min(a) = max(a) THEN 0 ELSE skewness(a) END END", "amt_iqr": f"{_q(0.75)} - {_q(0.25)}", "amt_cv": r("stddev_samp(a)", "avg(a)")}
ORACLES["amounts"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, " + ", ".join(d(x, k) for k, x in _amt.items()) + f", {i('count(a)', 'amt_count')} FROM txn GROUP BY c")
ORACLES["large_frac"] = _with(TXN, f"SELECT {i('c', 'customer_id')}, {d('avg(CASE WHEN a > q THEN 1.0 ELSE 0.0 END)', 'amt_large_frac')} FROM (SELECT c, a, quantile_cont(a, 0.9) OVER (PARTITION BY c) AS q FROM txn) GROUP BY c")
_z = [f"coalesce(abs({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0)" for x in ("total", "mean_n", "coalesce(sd_n, 0)", "s_amt", "coalesce(sd_amt, 0)")]
ORACLES["zscore"] = _with(HIST, f"SELECT {i('c', 'customer_id')}, {d('greatest(z1, z2, z3, z4, z5)', 'anomaly_zscore_max')}, {d('(z1 + z2 + z3 + z4 + z5) / 5', 'anomaly_zscore_mean')}, {i('greatest(z1, z2, z3, z4, z5) > 3', 'anomaly_zscore_flag')} FROM (SELECT c, " + ", ".join(f"{x} AS z{k + 1}" for k, x in enumerate(_z)) + " FROM hist)")
_scale = lambda x: f"({x} - (SELECT median({x}) FROM hist)) / (SELECT CASE WHEN quantile_cont({x}, 0.75) > quantile_cont({x}, 0.25) THEN quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25) ELSE 1 END FROM hist)"
ORACLES["robust_scale"] = _with(HIST, f"SELECT {i('c', 'customer_id')}, {d(_scale('total'), 'hist_total_txn')}, {d(_scale('s_amt'), 'hist_total_amount')}, {d(_scale('zero'), 'hist_zero_months')} FROM hist")
LABELS = f"""after AS (SELECT c, count(*) AS n FROM txn WHERE ts >= {T} AND ts < TIMESTAMP '2001-02-01' GROUP BY c),
lab AS (SELECT c_custkey AS c, coalesce(n, 0) AS y FROM customer LEFT JOIN after ON c_custkey = after.c WHERE c_custkey % 5 <> 0)"""
PAST = HIST.replace("FROM txn GROUP BY c, ym", f"FROM txn WHERE ts <= {T} GROUP BY c, ym")
ORACLES["label_union"] = _with(PAST + ", " + LABELS, f"""SELECT {i('u.c', 'customer_id')}, split, {i('y', 'next_3m_txn_count')}, {i('months', 'hist_months_active')}, {d('s_amt', 'hist_total_amount')}
  FROM (SELECT c, 'train' AS split, y FROM lab UNION ALL SELECT c_custkey, 'test', NULL FROM customer WHERE c_custkey % 5 = 0) u LEFT JOIN hist ON u.c = hist.c""")
TRAIN = PAST + ", " + LABELS + ", train AS (SELECT lab.c, y, coalesce(months, 0) AS months, coalesce(total, 0) AS total, coalesce(s_amt, 0) AS s_amt, coalesce(sd_n, 0) AS sd_n, coalesce(zero, 0) AS zero FROM lab LEFT JOIN hist ON lab.c = hist.c)"
_cols = {"hist_months_active": "months", "hist_total_txn": "total", "hist_total_amount": "s_amt", "hist_std_monthly_txn": "sd_n", "hist_zero_months": "zero"}
ORACLES["variance_filter"] = _with(TRAIN, " UNION ALL ".join(f"SELECT '{k}' AS feature, {d(f'var_samp({x})', 'variance')} FROM train" for k, x in _cols.items() if x != "zero"))
ORACLES["rank_target_corr"] = _with(TRAIN, "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS feature, {d(f'abs(corr({x}, ln(1 + y)))', 'corr')} FROM train" for k, x in _cols.items() if x != "zero") + ")")
_four = [(k, x) for k, x in _cols.items() if x != "zero"]
ORACLES["corr_pairs"] = _with(TRAIN, " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {d(f'corr({x}, {y})', 'corr')} FROM train" for n, (a, x) in enumerate(_four) for b, y in _four[n + 1 :]))
ORACLES["folds"] = _with(TRAIN, f"SELECT {i('c', 'customer_id')}, {i('k', 'rank')}, {i('CAST(k >= floor(m * 0.5) AS INT) + CAST(k >= floor(m * 0.6) AS INT) + CAST(k >= floor(m * 0.7) AS INT) + CAST(k >= floor(m * 0.8) AS INT) + CAST(k >= floor(m * 0.9) AS INT)', 'fold')} FROM (SELECT c, row_number() OVER (ORDER BY months, c) - 1 AS k, count(*) OVER () AS m FROM train)")
ORACLES["model_matrix"] = _with(TRAIN, f"SELECT {i('c', 'customer_id')}, {d('total', 'hist_total_txn')}, {d('s_amt', 'hist_total_amount')}, {d('sd_n', 'hist_std_monthly_txn')}, {d('y', 'y')}, {i('y > 0', 'active')} FROM train")
PRED = "pred AS (SELECT o_custkey AS c, round(sum(o_totalprice) / 10000 + 3.3e-8, 4) AS p FROM orders GROUP BY o_custkey), band AS (SELECT *, CASE WHEN p <= 50 THEN 'Dormant' WHEN p <= 145 THEN 'At Risk' ELSE 'Active' END AS flag FROM pred)"
ORACLES["submission"] = _with(PRED, f"SELECT {i('c_custkey', 'customer_id')}, {d('coalesce(ln(1 + greatest(p, 0)), 0)', 'next_3m_txn_count')} FROM (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT -c_custkey FROM customer WHERE c_custkey % 50 = 0) LEFT JOIN pred ON c_custkey = c")
ORACLES["ensemble"] = _with(PRED, f"SELECT {i('c', 'customer_id')}, {d('(0.5 * greatest((p + (p - 100)) / 2, 0) + 0.5 * greatest(p / 2, 0)) * (p / (p + 100))', 'prediction')} FROM pred")
OOF = TRAIN + f""", recent AS (SELECT c, count(*) AS n FROM txn WHERE ts < {T} AND ts >= TIMESTAMP '2000-08-01' GROUP BY c),
oof AS (SELECT t.c, y, coalesce(n, 0) AS p, CAST(k >= floor(m * 0.5) AS INT) + CAST(k >= floor(m * 0.6) AS INT) + CAST(k >= floor(m * 0.7) AS INT) + CAST(k >= floor(m * 0.8) AS INT) + CAST(k >= floor(m * 0.9) AS INT) AS fold
  FROM (SELECT c, y, row_number() OVER (ORDER BY months, c) - 1 AS k, count(*) OVER () AS m FROM train) t LEFT JOIN recent ON t.c = recent.c)"""
_err = f"{i('count(*)', 'n')}, {d('sqrt(avg(pow(ln(1 + y) - ln(1 + greatest(p, 0)), 2)))', 'rmsle')}, {d('sqrt(avg(pow(y - p, 2)))', 'rmse')}, {d('avg(abs(y - p))', 'mae')}"
ORACLES["oof_eval"] = _with(OOF, f"SELECT {i('fold', 'fold')}, {_err} FROM oof WHERE fold > 0 GROUP BY fold UNION ALL SELECT NULL, {_err} FROM oof WHERE fold > 0")
ORACLES["residual_hist"] = _with(OOF, f"SELECT {i('least(floor((CAST(y - p AS DOUBLE) - lo) / (hi - lo) * 60) + 1, 60)', 'bin')}, {i('count(*)', 'n')} FROM oof, (SELECT CAST(min(y - p) AS DOUBLE) AS lo, CAST(max(y - p) AS DOUBLE) AS hi FROM oof) GROUP BY 1")
_cell = lambda x: f"CASE WHEN {x} < 1 THEN 0 ELSE 4 * (length(bin(CAST(floor({x}) AS BIGINT))) - 1) + floor(({x} / pow(2, length(bin(CAST(floor({x}) AS BIGINT))) - 1) - 1) * 4) + 1 END"
ORACLES["actual_predicted"] = _with(OOF, f"SELECT {i(_cell('y'), 'y_cell')}, {i(_cell('p'), 'p_cell')}, {i('count(*)', 'n')}, {d('min(y)', 'least_y')}, {d('max(y)', 'largest_y')}, {d('min(p)', 'least_p')}, {d('max(p)', 'largest_p')} FROM oof WHERE fold > 0 GROUP BY 1, 2")
ORACLES["risk_bands"] = _with(PRED, f"SELECT {i('c', 'customer_id')}, {d('p', 'predicted_next_3m_txn_count_raw')}, flag AS risk_flag FROM band")
ORACLES["risk_terciles"] = _with(PRED, f"SELECT {i('c', 'customer_id')}, CASE WHEN p <= (SELECT quantile_cont(p, 0.33) FROM pred) THEN 'Dormant' WHEN p <= (SELECT quantile_cont(p, 0.66) FROM pred) THEN 'At Risk' ELSE 'Active' END AS risk_flag FROM pred")
ORACLES["portfolio"] = _with(PRED, f"SELECT flag AS risk_flag, {i('count(*)', 'customers')}, {d('count(*) / (SELECT count(*) FROM band)', 'share')} FROM band GROUP BY flag")
ORACLES["pred_histogram"] = _with(PRED + ", top AS (SELECT quantile_cont(p, 0.95) AS t FROM pred), clip AS (SELECT least(greatest(p, 0), t) AS x, t FROM pred, top)", f"SELECT {i('least(floor(x / t * 40) + 1, 40)', 'bin')}, {i('count(*)', 'n')}, {d('(SELECT avg(x) FROM clip)', 'mean')} FROM clip GROUP BY 1")
ORACLES["lookup"] = _with(PRED, f"SELECT {i('c', 'customer_id')}, {d('p', 'predicted_next_3m_txn_count_raw')} FROM pred WHERE CAST(c AS VARCHAR) = trim(' 7 ')")
ORACLES["outreach"] = _with(PRED, f"SELECT {i('c', 'customer_id')}, {d('p', 'predicted_next_3m_txn_count_raw')}, flag AS risk_flag FROM band WHERE flag IN ('Dormant', 'At Risk')")
ORACLES["feature_views"] = _with(PAST + ", " + LABELS, f"SELECT split, {i('count(*)', 'customers')}, {d('sum(s_amt)', 'hist_total_amount')} FROM (SELECT c, 'train' AS split FROM lab UNION ALL SELECT c_custkey, 'test' FROM customer WHERE c_custkey % 5 = 0) u LEFT JOIN hist ON u.c = hist.c GROUP BY split")

ORACLES["segment_dummies"] = f"SELECT {i('c_custkey', 'customer_id')}, {i('c_nationkey % 5', 'customer_segment')}, " + ", ".join(i(f"c_nationkey % 5 = {k}", f"seg_{k}") for k in range(5)) + " FROM customer"
ORACLES["segment_counts"] = f"SELECT {i('c_nationkey % 5', 'customer_segment')}, {i('count(*)', 'customers')} FROM customer GROUP BY c_nationkey % 5"
_corr = "strength AS (" + " UNION ALL ".join(f"SELECT '{k}' AS f, {n} AS j, coalesce(abs(corr({x}, ln(1 + y))), 0) AS s, var_samp({x}) AS v FROM train" for n, (k, x) in enumerate(_four)) + ")"
ORACLES["top_features"] = _with(TRAIN + ", " + _corr, f"SELECT f AS feature, {d('s', 'avg_imp')} FROM strength ORDER BY s DESC, f LIMIT 3")
ORACLES["importance_table"] = _with(TRAIN + ", " + _corr, f"SELECT f AS feature, {d('s', 'xgb_imp')}, {d('(1 - s) / 2', 'lgb_imp')}, {d('s * 0.5 + (1 - s) / 2 * 0.5', 'avg_imp')} FROM strength")
_pairs = " UNION ALL ".join(f"SELECT {j} AS j, {k} AS i, abs(corr({x}, {y})) AS r FROM train" for j, (_, x) in enumerate(_four) for k, (_, y) in enumerate(_four[:j]))
ORACLES["selected"] = "WITH RECURSIVE " + TRAIN + f""", {_corr}, pairs AS (SELECT row_number() OVER (ORDER BY p.j, p.i) AS n, p.*, a.f AS c, b.f AS partner, a.s < b.s AS weaker FROM ({_pairs}) p JOIN strength a ON a.j = p.j JOIN strength b ON b.j = p.i),
walk AS (
  SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS gone, true AS visited
  UNION ALL
  SELECT n, CASE WHEN visited AND NOT list_contains(gone, partner) AND r > 0.97 THEN list_append(gone, CASE WHEN weaker THEN c ELSE partner END) ELSE gone END, visited
  FROM (SELECT pairs.n, gone, c, partner, weaker, r, CASE WHEN i = 0 THEN NOT list_contains(gone, c) ELSE visited END AS visited FROM walk JOIN pairs ON pairs.n = walk.n + 1))
SELECT f AS feature FROM strength WHERE v > 1e-6 AND NOT list_contains((SELECT gone FROM walk ORDER BY n DESC LIMIT 1), f) ORDER BY s DESC, f LIMIT 3"""
_folded = lambda p: f"sqrt(avg(pow(ln(1 + y) - ln(1 + greatest({p}, 0)), 2))), sqrt(avg(pow(y - {p}, 2)))"
_cv = OOF + f", cv AS (SELECT fold, {_folded('p')}, {_folded('p / 2')} FROM oof WHERE fold > 0 GROUP BY fold), cvt(fold, xgb_rmsle, xgb_rmse, lgb_rmsle, lgb_rmse) AS (SELECT * FROM cv)"
_names = ("xgb_rmsle", "xgb_rmse", "lgb_rmsle", "lgb_rmse")
ORACLES["cv_table"] = _with(_cv, f"SELECT {i('fold', 'fold')}, " + ", ".join(d(c, c) for c in _names) + " FROM cvt")
ORACLES["cv_summary"] = _with(_cv, "SELECT " + ", ".join(d(f"{f}({c})", f"{n}_{c}") for c in _names for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM cvt")
ORACLES["drop_empty"] = _with(DEMO, f"SELECT {i('c', 'customer_id')}, {d('bal', 'c_acctbal')}, seg AS c_mktsegment, n_name, c_name FROM demo")
_total = lambda k, x, rows: f"SELECT '{k}' AS input, {i('count(*)', 'n')}, {d(f'sum({x})', 'total')} FROM {rows}"
ORACLES["inputs"] = _with(TXN + ", " + LABELS, " UNION ALL ".join([_total("labels", "y", "lab"), *[_total(k, "c_custkey", "customer WHERE c_custkey % 5 = 0") for k in ("test_ids", "sample")], _total("financials", "value", "events"), _total("demographics", "c_acctbal", "customer")]))
ORACLES["feature_store"] = ORACLES["feature_views"]
ORACLES["publish"] = _with(PRED, f"SELECT {i('c', 'customer_id')}, {d('ln(1 + greatest(p, 0))', 'next_3m_txn_count')} FROM pred")
ORACLES["diagnostics_csv"] = ORACLES["oof_eval"]
ORACLES["outreach_export"] = ORACLES["outreach"]
_GROUPS = ("history", "rolling", "lags", "trend", "yearly_mean", "month_season", "festive_q4", "streaks", "gini", "velocity", "decay", "debit_credit", "balance", "recency", "txn_gap", "amounts", "large_frac", "diversity", "latest_snapshot", "impute_median", "label_encode")
_as_of = lambda sql: sql.replace("ON l_partkey = p_partkey))", f"ON l_partkey = p_partkey WHERE l_shipdate <= {T}))")
_freq = _with(DEMO, f"SELECT {i('c', 'customer_id')}, {d('count(*) OVER (PARTITION BY c_name) / (SELECT count(c_name) FROM demo)', 'c_name_freq_enc')} FROM demo")
ORACLES["assemble_groups"] = _with(
    f"{TXN}, {LABELS}, ids AS (SELECT c AS customer_id, 'train' AS split, y AS next_3m_txn_count FROM lab UNION ALL SELECT c_custkey, 'test', NULL FROM customer WHERE c_custkey % 5 = 0), "
    + ", ".join(f"g_{g} AS ({_as_of(ORACLES[g])})" for g in _GROUPS) + f", g_freq AS ({_freq})",
    "SELECT * FROM ids " + " ".join(f"LEFT JOIN g_{g} USING (customer_id)" for g in (*_GROUPS, "freq")),
)
_whole = f"""m AS ({ORACLES["assemble_groups"]}), wide AS (SELECT ln(1 + next_3m_txn_count) AS y, CAST(COLUMNS(* EXCLUDE (customer_id, split, next_3m_txn_count)) AS DOUBLE) FROM m WHERE split = 'train'),
long AS (SELECT y, feature, coalesce(v, 0) AS v FROM wide UNPIVOT INCLUDE NULLS (v FOR feature IN (COLUMNS(* EXCLUDE (y)))))"""
ORACLES["variance_whole"] = _with(_whole, f"SELECT feature, {d('log10(1 + coalesce(var_samp(v), 0))', 'log_variance')} FROM long GROUP BY feature")
ORACLES["target_corr_whole"] = _with(_whole, f"SELECT feature, {d('abs(corr(v, y))', 'corr')} FROM long GROUP BY feature")
