"""DuckDB SQL that states each registered query independently of Spark."""

from __future__ import annotations

def half_even(x: str, places: int) -> str:
    """x rounded by its exact value, ties to even: the engine's own formatting does that."""
    return f"CAST(format('{{:.{places}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


EV = """ev AS (
  SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS DATE) AS date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high,
    min(value) AS low, arg_max(value, row(ts, event_id)) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

LR = """lr AS (
  SELECT l_suppkey, CAST(l_suppkey AS VARCHAR) AS ticker, CAST(l_shipdate AS DATE) AS date,
    CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS price, l_quantity, row(l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq
  FROM lineitem)"""
LI = f"""{LR},
li AS (
  SELECT ticker, date, arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, sum(l_quantity) AS volume
  FROM lr GROUP BY 1, 2)"""
IX = f"{LR},\nix AS (SELECT date, round(avg(price), 6) AS close FROM lr GROUP BY 1)"

PANELS = f"""{LI},
adj AS (
  SELECT ticker, date, open, CASE WHEN CAST(ticker AS BIGINT) % 7 = 0 AND dayofyear(date) % 10 = 0 THEN low * 0.5 ELSE high END AS high, low, close, volume
  FROM li WHERE CAST(ticker AS BIGINT) % 10 NOT IN (0, 5)),
raw AS (SELECT ticker, date FROM li WHERE CAST(ticker AS BIGINT) % 10 <> 5),
clo AS (SELECT ticker, date, close FROM li WHERE CAST(ticker AS BIGINT) % 10 = 0),
sur AS (SELECT CAST(s_suppkey AS VARCHAR) AS ticker, CASE WHEN s_acctbal > 0 THEN s_name END AS exit_type FROM supplier WHERE s_suppkey % 5 = 0),
uni AS (SELECT ticker FROM adj UNION SELECT ticker FROM clo UNION SELECT ticker FROM sur)"""

VIOLATION = """(open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND (high <= 0 OR low <= 0
  OR high < low * (1 - 1e-4) OR high < greatest(open, close) * (1 - 1e-4) OR low > least(open, close) * (1 + 1e-4)))"""

# active tickers are counted plainly: those with a bar within the last 60 observed dates
CAL = f"""{PANELS},
od AS (SELECT date, count(DISTINCT ticker) AS have, row_number() OVER (ORDER BY date) AS r FROM adj GROUP BY date),
tr AS (SELECT DISTINCT ticker, r FROM adj JOIN od USING (date)),
ac AS (SELECT o.date, o.have, count(DISTINCT t.ticker) AS active FROM od o JOIN tr t ON t.r <= o.r AND t.r > o.r - 60 GROUP BY 1, 2),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS session, have, active FROM ac WHERE active = 0 OR have >= 0.2 * active)"""

PROFILE = f"""{CAL},
ta AS (
  SELECT ticker, count(*) AS n_adj, min(date) AS f, max(date) AS l, count(*) FILTER (volume IS NULL OR volume = 0) AS zero_vol,
    count(*) FILTER (WHERE {VIOLATION}) AS ohlc_viol, count(*) FILTER (close <= 0) AS nonpos_close
  FROM adj GROUP BY 1),
tn AS (SELECT ticker, count(*) AS n_raw FROM raw GROUP BY 1),
tc AS (SELECT ticker, count(*) AS n_close, min(date) AS f, max(date) AS l FROM clo GROUP BY 1),
mis AS (
  SELECT ticker, CASE WHEN b.session > a.session THEN b.session - a.session + 1 END AS span_sessions,
    CASE WHEN b.session > a.session THEN (SELECT count(*) FROM cal c WHERE c.date BETWEEN ta.f AND ta.l AND NOT EXISTS (SELECT 1 FROM adj x WHERE x.ticker = ta.ticker AND x.date = c.date)) END AS missing_sessions
  FROM ta LEFT JOIN cal a ON a.date = ta.f LEFT JOIN cal b ON b.date = ta.l),
lc AS (SELECT ticker, arg_max(close, date) AS c FROM adj GROUP BY 1),
st AS (SELECT a.ticker, count(*) AS stale_tail FROM adj a JOIN lc USING (ticker)
  WHERE a.date > coalesce((SELECT max(x.date) FROM adj x WHERE x.ticker = a.ticker AND x.close <> lc.c), DATE '0001-01-01') GROUP BY 1),
pro AS (
  SELECT ticker, coalesce(n_adj, 0) AS n_adj, coalesce(n_raw, 0) AS n_raw, CASE WHEN n_adj > 0 THEN 0 ELSE coalesce(n_close, 0) END AS n_close_only,
    CASE WHEN n_adj > 0 THEN ta.f ELSE tc.f END AS first, CASE WHEN n_adj > 0 THEN ta.l ELSE tc.l END AS last,
    CASE WHEN n_adj > 0 THEN 'ADJUSTED' ELSE 'CLOSE_ONLY_DELISTED' END AS basis, zero_vol, ohlc_viol, nonpos_close, span_sessions, missing_sessions, stale_tail
  FROM uni LEFT JOIN ta USING (ticker) LEFT JOIN tn USING (ticker) LEFT JOIN tc USING (ticker) LEFT JOIN mis USING (ticker) LEFT JOIN st USING (ticker))"""


def _classes(share: float) -> str:
    return f"""{PROFILE},
cls AS (
  SELECT *, list_filter([
      CASE WHEN n_adj = 0 AND n_close_only = 0 THEN 'NO_PRICE_DATA' END,
      CASE WHEN n_adj > 0 AND span_sessions > 0 AND missing_sessions / span_sessions > {share} THEN 'MISSING_SESSIONS_GT20PCT' END,
      CASE WHEN n_adj > 0 AND ohlc_viol > 3 AND ohlc_viol / n_adj > 0.002 THEN 'OHLC_VIOLATION' END,
      CASE WHEN n_adj > 0 AND nonpos_close > 0 THEN 'NONPOSITIVE_CLOSE' END], lambda x: x IS NOT NULL) AS reasons FROM pro),
v2 AS (SELECT *, CASE WHEN len(reasons) > 0 THEN 'DATA_UNUSABLE' ELSE 'PROFILE_OK' END AS status FROM cls)"""


GAPS = """gaps AS (
  SELECT ticker, last, CASE WHEN last IS NULL OR last < (SELECT min(date) FROM cal) THEN NULL
    WHEN EXISTS (SELECT 1 FROM cal WHERE date = last) THEN (SELECT count(*) FROM cal WHERE date > last)
    ELSE nullif((SELECT count(*) FROM cal WHERE date > last), 0) END AS tail_gap
  FROM pro)"""

V3 = f"""{_classes(0.75)}, {GAPS},
v3 AS (
  SELECT ticker, tail_gap,
    CASE WHEN status = 'DATA_UNUSABLE' THEN status WHEN tail_gap > 1 THEN 'PROFILE_OK_STALE_TAIL' ELSE 'PROFILE_OK_FRESH' END AS status,
    CASE WHEN status = 'DATA_UNUSABLE' THEN reasons WHEN tail_gap IS NULL THEN ['TAIL_GAP_UNKNOWN']
      WHEN tail_gap > 1 THEN ['TAIL_GAP_' || CAST(tail_gap AS VARCHAR) || '_SESSIONS'] ELSE [] END AS reasons
  FROM v2 JOIN gaps USING (ticker))"""


def _pct(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} IS NULL OR {b} = 0 THEN 0.0 ELSE ({a} - {b}) / {b} * 100 END, 6)"


FEATURES = f"""{EV},
f0 AS (
  SELECT *, row_number() OVER w AS n_bars, lead(date) OVER w AS next_date, lag(close, 1) OVER w AS pc,
    lag(close, 5) OVER w AS c5, lag(close, 19) OVER w AS c19, lag(close, 20) OVER w AS c20,
    avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING) AS pv,
    avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma
  FROM ev WINDOW w AS (PARTITION BY ticker ORDER BY date)),
f1 AS (
  SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM f0),
f2 AS (
  SELECT *, avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr_all,
    {_pct("close", "c5")} AS r5, {_pct("close", "c19")} AS r20_19, {_pct("close", "c20")} AS r20_20,
    round(CASE WHEN pv IS NULL OR pv <= 0 THEN 1.0 ELSE volume / pv END, 6) AS volume_ratio, {_pct("close", "ma")} AS price_vs_ma20 FROM f1),
f3 AS (SELECT *, round(CASE WHEN n_bars > 14 AND atr_all > 0 AND close > 0 THEN atr_all END, 6) AS atr FROM f2),
f4 AS (
  SELECT *, CASE WHEN r5 > 5 THEN 20 WHEN r5 > 2 THEN 10 ELSE 0 END AS r5_pts,
    CASE WHEN volume_ratio > 2 THEN 30 WHEN volume_ratio > 1.5 THEN 20 WHEN volume_ratio > 1.2 THEN 10 ELSE 0 END AS volume_pts,
    CASE WHEN price_vs_ma20 > 5 THEN 30 WHEN price_vs_ma20 > 2 THEN 20 WHEN price_vs_ma20 > 0 THEN 10 ELSE 0 END AS ma_pts,
    CASE WHEN atr IS NOT NULL THEN round(close, 6) END AS entry, least(greatest(2 * atr, 0.05 * close), 0.08 * close) AS dist FROM f3),
ft AS (SELECT *, round(entry - 2 * dist, 6) AS sl, round(entry + 0.5 * dist, 6) AS tp1, round(entry + 2 * dist, 6) AS tp2 FROM f4)"""


def _r20_points(c: str) -> str:
    return f"CASE WHEN {c} > 10 THEN 20 WHEN {c} > 5 THEN 10 ELSE 0 END"


ASOF = f"""{FEATURES},
dd AS (SELECT DISTINCT date AS d FROM ev),
ao AS (SELECT ft.*, d FROM ft JOIN dd ON d >= date AND (next_date IS NULL OR d < next_date))"""

CANDIDATES = f"""{ASOF},
lq AS (SELECT ao.ticker, ao.d, round(coalesce(avg(coalesce(b.volume, 0) * coalesce(b.close, 0)), 0.0), 6) AS avg_value
  FROM ao LEFT JOIN ev b ON b.ticker = ao.ticker AND b.date > ao.d - 20 AND b.date <= ao.d GROUP BY 1, 2),
arms AS (SELECT ao.*, avg_value, 'B0' AS arm, r20_19 AS r20, false AS fresh FROM ao JOIN lq USING (ticker, d)
  UNION ALL SELECT ao.*, avg_value, 'B1', r20_20, true FROM ao JOIN lq USING (ticker, d)),
sc AS (SELECT *, r5_pts + {_r20_points("r20")} + volume_pts + ma_pts AS score FROM arms),
gt AS (
  SELECT *, list_filter([CASE WHEN score < 65 THEN 'BELOW_THRESHOLD' END, CASE WHEN volume_pts <= 0 THEN 'VOLUME_GATE' END, CASE WHEN r20 < 30 THEN 'R23_GATE' END], lambda x: x IS NOT NULL) AS failed FROM sc),
cd AS (
  SELECT *, CASE WHEN n_bars < 20 THEN 'INELIGIBLE' WHEN avg_value <= 70 THEN 'GATE_REJECTED' WHEN fresh AND date <> d THEN 'GATE_REJECTED'
      WHEN entry IS NULL THEN 'FEATURE_INVALID' WHEN len(failed) > 0 THEN 'GATE_REJECTED' ELSE 'QUALIFIED' END AS bucket,
    CASE WHEN n_bars < 20 THEN ['INSUFFICIENT_HISTORY'] WHEN avg_value <= 70 THEN ['LIQUIDITY_GATE'] WHEN fresh AND date <> d THEN ['STALE_DATA_AS_OF']
      WHEN entry IS NULL THEN ['FEATURE_FAIL'] ELSE failed END AS reasons FROM gt)"""

# the index of the events has far fewer closes than the regime needs, so the cap is that of an unknown regime
ASSIGNED = f"""{CANDIDATES},
rk AS (SELECT *, row_number() OVER (PARTITION BY arm, d ORDER BY score DESC, ticker) AS rank FROM cd WHERE bucket = 'QUALIFIED'),
asg AS (
  SELECT arm, ticker, d, score, rank, CASE WHEN rank <= 3 THEN 'SELECTED' ELSE 'QUALIFIED_NOT_SELECTED' END AS bucket, [CASE WHEN rank <= 3 THEN 'CAP_TOP_N' ELSE 'CAP_BLOCKED' END] AS reasons FROM rk
  UNION ALL SELECT arm, ticker, d, score, NULL, bucket, reasons FROM cd WHERE bucket <> 'QUALIFIED')"""

_BUCKETS = ("DATA_UNUSABLE", "INELIGIBLE", "FEATURE_INVALID", "MODEL_INVALID", "GATE_REJECTED", "QUALIFIED_NOT_SELECTED", "SELECTED")
DAILY = "SELECT arm, d AS date, " + ", ".join(f'count(*) FILTER (bucket = \'{b}\') AS "{b}"' for b in _BUCKETS) + " FROM asg GROUP BY 1, 2"

_REASON = """CASE WHEN {o} >= tp1 THEN 'TP_GAP' WHEN {o} <= sl THEN 'SL_GAP' WHEN {l} <= sl THEN 'STOP_LOSS' WHEN {h} >= tp1 THEN 'TAKE_PROFIT_1' WHEN {n} >= 10 THEN 'TIME_EXIT' END"""
_PRICE = """CASE WHEN {o} >= tp1 THEN {o} WHEN {o} <= sl THEN {o} WHEN {l} <= sl THEN sl WHEN {h} >= tp1 THEN tp1 WHEN {n} >= 10 THEN {c} END"""
_BAR = {"o": "b.open", "h": "b.high", "l": "b.low", "c": "b.close", "n": "no"}


def _outcomes(signals: str) -> str:
    """out: outcomes of sig (key, ticker, sd, entry, sl, tp1), bar by bar."""
    return f"""{signals},
bs AS (SELECT sig.*, b.date AS bd, b.open, b.high, b.low, b.close AS bc, row_number() OVER (PARTITION BY key ORDER BY b.date) AS no FROM sig JOIN ev b ON b.ticker = sig.ticker AND b.date > sd),
ex AS (SELECT key, bd, no, {_REASON.format(o="open", h="high", l="low", c="bc", n="no")} AS reason, {_PRICE.format(o="open", h="high", l="low", c="bc", n="no")} AS price FROM bs),
fe AS (SELECT key, arg_min(bd, no) AS bd, arg_min(price, no) AS price, arg_min(reason, no) AS reason, min(no) AS no FROM ex WHERE reason IS NOT NULL GROUP BY 1),
lastbar AS (SELECT sig.key, dd.d, max(b.date) AS lb FROM sig JOIN dd ON dd.d > sd JOIN ev b ON b.ticker = sig.ticker AND b.date <= dd.d GROUP BY 1, 2),
ha AS (SELECT key, min(d) AS halted FROM lastbar WHERE lb < d AND (SELECT count(*) FROM dd x WHERE x.d > lb) >= 10 GROUP BY 1),
pa AS (SELECT bs.key, arg_max(bc, no) AS close, max(no) AS no FROM bs JOIN ha USING (key) WHERE bd < halted GROUP BY 1),
out AS (
  SELECT sig.*, CASE WHEN halted IS NOT NULL AND (fe.bd IS NULL OR halted < fe.bd) THEN halted ELSE fe.bd END AS exit_date,
    CASE WHEN halted IS NOT NULL AND (fe.bd IS NULL OR halted < fe.bd) THEN coalesce(pa.close, entry) ELSE fe.price END AS exit,
    CASE WHEN halted IS NOT NULL AND (fe.bd IS NULL OR halted < fe.bd) THEN 'TIME_EXIT_SUSPENDED' ELSE fe.reason END AS exit_reason,
    CASE WHEN halted IS NOT NULL AND (fe.bd IS NULL OR halted < fe.bd) THEN coalesce(pa.no, 0) ELSE fe.no END AS bars_held
  FROM sig LEFT JOIN fe USING (key) LEFT JOIN ha USING (key) LEFT JOIN pa USING (key))"""


OUTCOMES = _outcomes(f"""{ASOF},
sig AS (SELECT ticker || '@' || CAST(date AS VARCHAR) AS key, ticker, date AS sd, entry, sl, tp1 FROM ft WHERE entry IS NOT NULL AND r5_pts + {_r20_points("r20_19")} + volume_pts + ma_pts >= 40)""")

CLOSED = _outcomes(f"""{CANDIDATES},
sig AS (SELECT arm || ticker || '@' || CAST(d AS VARCHAR) AS key, arm, ticker, d AS sd, entry, sl, tp1 FROM sc WHERE entry IS NOT NULL AND score >= 40 AND (NOT fresh OR date = d))""") + """,
tr8 AS (
  SELECT *, round(exit * 100 - entry * 100 - entry * 100 * 0.002 - exit * 100 * 0.002, 6) AS net,
    round(exit * 100 - entry * 100 - floor(entry * 100 * 0.00151303 + 0.5) - floor(exit * 100 * 0.00251303 + 0.5), 6) AS net_exact,
    round((exit * 100 - entry * 100 - entry * 100 * 0.002 - exit * 100 * 0.002) / (entry * 100) * 100, 6) AS ret_pct
  FROM out WHERE exit_date IS NOT NULL)"""

_LEFT = "{'ticker': %s.ticker, 'sig': %s, 'qty': %s, 'entry': %s.entry, 'exit_date': %s.exit_date, 'exit': %s.exit, 'exit_reason': %s.exit_reason, 'bars_held': %s.bars_held}"
_POSITIONS = "STRUCT(ticker VARCHAR, sig DATE, qty BIGINT, entry DOUBLE, exit_date DATE, exit DOUBLE, exit_reason VARCHAR, bars_held BIGINT)[]"


def _side(x: str, rate: str) -> str:
    return f"CASE WHEN profile = 'PROD_FLAT' THEN ({x}) * 0.002 ELSE floor(({x}) * {rate} + 0.5) END"


def _value(cash: str, positions: str) -> str:
    return f"{cash} + list_reduce([0.0::DOUBLE] || list_transform({positions}, lambda p: p.qty * m[p.ticker]), lambda a, b: a + b)"


def _pick(k: int) -> str:
    """A step of the walk: the size of the k-th pick and the cash after it."""
    e, q = f"picked[{k}].entry", f"q{k}"
    size = f"CASE WHEN {e} > 0 THEN greatest(0, floor(least(equity / 3, cash{k - 1} * 0.98) / {e} / 100)) * 100 ELSE 0 END"
    return f"SELECT *, cash{k - 1} - CASE WHEN {q} > 0 THEN {q} * {e} + {_side(f'{q} * {e}', '0.00151303')} ELSE 0 END AS cash{k} FROM (SELECT *, CAST({size} AS BIGINT) AS {q} FROM x{k - 1})"


def _picked(k: int) -> str:
    row = f"picked[{k}]"
    return f"CASE WHEN len(picked) >= {k} THEN {_LEFT % (row, 'd', f'q{k}', row, row, row, row, row)} END"


# the book day by day: cash and open positions are the state of a recursion, a day's closes and picks are kept beside it
BOOK = _outcomes(f"""{CANDIDATES},
sig AS (SELECT arm || ticker || '@' || CAST(d AS VARCHAR) AS key, arm, ticker, d AS sd, score, entry, sl, tp1 FROM cd WHERE bucket = 'QUALIFIED')""") + f""",
days AS (SELECT dd.d, row_number() OVER (ORDER BY dd.d) AS n, m FROM dd LEFT JOIN (SELECT d, map_from_entries(list((ticker, close))) AS m FROM ao GROUP BY 1) USING (d)),
cands AS (SELECT arm, sd, list({{'ticker': ticker, 'entry': entry, 'exit_date': exit_date, 'exit': exit, 'exit_reason': exit_reason, 'bars_held': bars_held}} ORDER BY score DESC, ticker) AS c FROM out GROUP BY 1, 2),
walk AS (
  SELECT arm, profile, CAST(0 AS BIGINT) AS n, CAST(NULL AS DATE) AS d, CAST(1e7 AS DOUBLE) AS cash, CAST([] AS {_POSITIONS}) AS positions, CAST([] AS {_POSITIONS}) AS closed, CAST([] AS {_POSITIONS}) AS picks, CAST(NULL AS DOUBLE) AS equity
  FROM (VALUES ('B0'), ('B1')) a(arm), (VALUES ('PROD_FLAT'), ('AJAIB_EXACT')) p(profile)
  UNION ALL
  (WITH s AS (
    SELECT w.arm, w.profile, days.n, days.d, m, coalesce(c, []) AS c, w.cash, list_filter(w.positions, lambda p: p.exit_date = days.d) AS closed, list_filter(w.positions, lambda p: p.exit_date IS NULL OR p.exit_date <> days.d) AS kept
    FROM walk w JOIN days ON days.n = w.n + 1 LEFT JOIN cands ON cands.arm = w.arm AND cands.sd = days.d),
  t AS (SELECT *, list_reduce([cash] || list_transform(closed, lambda p: p.exit * p.qty - ({_side("p.exit * p.qty", "0.00251303")})), lambda a, b: a + b) AS cash0, list_transform(kept, lambda p: p.ticker) AS owned FROM s),
  x0 AS (SELECT *, {_value("cash0", "kept")} AS equity, list_filter(c, lambda r: NOT list_contains(owned, r.ticker))[1:3] AS picked FROM t),
  x1 AS ({_pick(1)}), x2 AS ({_pick(2)}), x3 AS ({_pick(3)}),
  y AS (SELECT *, CAST(list_filter([{_picked(1)}, {_picked(2)}, {_picked(3)}], lambda r: r IS NOT NULL) AS {_POSITIONS}) AS picks FROM x3),
  z AS (SELECT *, kept || list_filter(picks, lambda r: r.qty > 0) AS positions FROM y)
  SELECT arm, profile, n, d, cash3, positions, closed, picks, {_value("cash3", "positions")} FROM z)),
moves AS (
  SELECT arm, profile, 'TRADE' AS kind, d AS date, t, CAST(NULL AS DOUBLE) AS equity, CAST(NULL AS BIGINT) AS n_open FROM (SELECT arm, profile, d, unnest(closed) AS t FROM walk)
  UNION ALL SELECT arm, profile, 'PICK', d, t, NULL, NULL FROM (SELECT arm, profile, d, unnest(picks) AS t FROM walk)
  UNION ALL SELECT arm, profile, 'OPEN', d, t, NULL, NULL FROM (SELECT arm, profile, d, unnest(positions) AS t FROM walk WHERE n = (SELECT max(n) FROM days))
  UNION ALL SELECT arm, profile, 'DAY', d, NULL, {half_even("equity", 2)}, len(positions) FROM walk WHERE n > 0),
book AS (
  SELECT arm, profile, kind, date, t.ticker AS ticker, t.sig AS sig_date, t.qty AS qty, t.entry AS entry, CASE WHEN kind = 'TRADE' THEN t.exit END AS exit, CASE WHEN kind = 'TRADE' THEN t.exit_reason END AS exit_reason,
    CASE WHEN kind = 'TRADE' THEN t.bars_held END AS bars_held,
    CASE WHEN kind = 'TRADE' THEN t.exit * t.qty - t.entry * t.qty - (({_side("t.entry * t.qty", "0.00151303")}) + ({_side("t.exit * t.qty", "0.00251303")})) END AS net, CAST(equity AS DOUBLE) AS equity, CAST(n_open AS BIGINT) AS n_open FROM moves),
booked AS (SELECT arm, profile, kind, date, ticker, sig_date, qty, entry, exit, exit_reason, bars_held, net, net / (entry * qty) * 100 AS ret_pct, equity, n_open FROM book)"""

_DATED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}
_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def _stats(table: str) -> str:
    c = _DATED.get(table)
    ends = f"strftime(min({c}), '%Y-%m-%d') AS min_date, strftime(max({c}), '%Y-%m-%d') AS max_date" if c else "CAST(NULL AS VARCHAR) AS min_date, CAST(NULL AS VARCHAR) AS max_date"
    return f"SELECT '{table}' AS name, count(*) AS row_count, {ends} FROM {table}"


STATS = " UNION ALL ".join(_stats(t) for t in _TABLES)
DELTA = """k AS (SELECT ticker, {d} AS date, bool_or(arm = 'B0') AS l, bool_or(arm = 'B1') AS r FROM {t} GROUP BY 1, 2),
dl AS (SELECT ticker, date, CASE WHEN l AND r THEN 'common' WHEN l THEN 'only_B0' ELSE 'only_B1' END AS side FROM k)"""



def _halves_up(sql: str) -> str:
    """round(x, n) spelled out as plain arithmetic, innermost first."""
    while (start := sql.rfind("round(")) >= 0:
        depth, at, comma = 1, start + 6, 0
        while depth:
            depth += {"(": 1, "[": 1, ")": -1, "]": -1}.get(sql[at], 0)
            comma = at if sql[at] == "," and depth == 1 else comma
            at += 1
        unit = repr(10.0 ** int(sql[comma + 1 : at - 1]))
        sql = f"{sql[:start]}(floor(({sql[start + 6 : comma]}) * {unit} + 0.5) / {unit}){sql[at:]}"
    return sql


SQL: dict[str, str] = {
    "bars_events": f"WITH {EV} SELECT * FROM ev",
    "bars_lineitem": f"WITH {LI} SELECT ticker, date, round(open, 4) AS open, round(high, 4) AS high, round(low, 4) AS low, round(close, 4) AS close, volume FROM li",
    "index_series": f"WITH {IX} SELECT date, round(close, 4) AS close FROM ix",
    "table_stats": STATS,
    "effective_cutoff": f"SELECT min(max_date) AS effective_cutoff FROM ({STATS}) WHERE regexp_full_match(max_date, '\\d{{4}}-\\d{{2}}-\\d{{2}}')",
    "aux_coverage": f"SELECT *, false AS missing FROM ({_stats('orders')} UNION ALL {_stats('supplier')} UNION ALL {_stats('nation')}) UNION ALL SELECT 'dividends', NULL, NULL, NULL, true",
    "universe_union": f"WITH {PANELS} SELECT ticker FROM uni",
    "universe_meta": f"WITH {PANELS} SELECT 'adjusted' AS panel, count(DISTINCT ticker) AS tickers FROM adj UNION ALL SELECT 'close_only', count(DISTINCT ticker) FROM clo UNION ALL SELECT 'survivors', count(DISTINCT ticker) FROM sur UNION ALL SELECT 'universe', count(*) FROM uni",
    "trading_calendar": f"WITH {CAL} SELECT * FROM cal",
    "profile_metrics": f"WITH {PROFILE} SELECT * FROM pro",
    "ohlc_violations": f"WITH {PANELS} SELECT ticker, date FROM adj WHERE {VIOLATION}",
    "stale_tail": f"""WITH {EV}, e AS (SELECT ticker, date, round(close, -2) AS close FROM ev), lc AS (SELECT ticker, arg_max(close, date) AS c FROM e GROUP BY 1)
      SELECT e.ticker, count(*) AS stale_tail FROM e JOIN lc USING (ticker) WHERE e.date > coalesce((SELECT max(x.date) FROM e x WHERE x.ticker = e.ticker AND x.close <> lc.c), DATE '0001-01-01') GROUP BY 1""",
    "missing_sessions": f"WITH {PROFILE} SELECT * FROM mis",
    "survivorship_left_join": f"""WITH {PANELS}, cl AS (SELECT ticker, date, round(close, -3) AS close FROM clo), lc AS (SELECT ticker, arg_max(close, date) AS c FROM cl GROUP BY 1),
      pr AS (SELECT ticker, min(date) AS last_real_print, count(*) - 1 AS flat_tail_bars FROM cl JOIN lc USING (ticker)
        WHERE date > coalesce((SELECT max(x.date) FROM cl x WHERE x.ticker = cl.ticker AND x.close <> lc.c), DATE '0001-01-01') GROUP BY 1)
      SELECT ticker, CASE WHEN sur.ticker IS NOT NULL THEN coalesce(exit_type, '') END AS exit_type, last_real_print, flat_tail_bars FROM uni LEFT JOIN sur USING (ticker) LEFT JOIN pr USING (ticker)""",
    "classify_v2": f"WITH {_classes(0.2)} SELECT ticker, status, array_to_string(reasons, '|') AS reasons FROM v2",
    "funnel_v2": f"WITH {_classes(0.2)} SELECT s AS status, count(ticker) AS tickers FROM (VALUES ('PROFILE_OK'), ('DATA_UNUSABLE')) x(s) LEFT JOIN v2 ON status = s GROUP BY 1",
    "unusable_reasons": f"WITH {_classes(0.2)} SELECT reason, count(*) AS tickers FROM (SELECT unnest(reasons) AS reason FROM v2) GROUP BY 1",
    "tail_gap": f"WITH {PROFILE}, {GAPS} SELECT ticker, last, tail_gap FROM gaps",
    "classify_v3": f"WITH {V3} SELECT ticker, status, array_to_string(reasons, '|') AS reasons FROM v3",
    "funnel_v3": f"WITH {V3} SELECT s AS status, count(ticker) AS tickers FROM (VALUES ('PROFILE_OK_FRESH'), ('PROFILE_OK_STALE_TAIL'), ('DATA_UNUSABLE')) x(s) LEFT JOIN v3 ON status = s GROUP BY 1",
    "stale_list_sorted": f"WITH {V3} SELECT ticker, tail_gap, row_number() OVER (ORDER BY coalesce(tail_gap, 0) DESC, ticker) AS place FROM v3 WHERE status = 'PROFILE_OK_STALE_TAIL'",
    "momentum_r5_r20": f"WITH {FEATURES} SELECT ticker, date, round(r5, 4) AS r5, round(r20_19, 4) AS r20_19, round(r20_20, 4) AS r20_20 FROM ft",
    "volume_ratio": f"WITH {FEATURES} SELECT ticker, date, round(volume_ratio, 4) AS volume_ratio FROM ft",
    "price_vs_ma20": f"WITH {FEATURES} SELECT ticker, date, round(price_vs_ma20, 4) AS price_vs_ma20 FROM ft",
    "score_core": f"WITH {FEATURES} SELECT ticker, date, r5_pts, {_r20_points('r20_19')} AS r20_pts, volume_pts, ma_pts, r5_pts + {_r20_points('r20_19')} + volume_pts + ma_pts AS score FROM ft WHERE n_bars >= 20",
    "atr_levels": f"WITH {FEATURES} SELECT ticker, date, round(atr, 4) AS atr, round(entry, 4) AS entry, round(sl, 4) AS sl, round(tp1, 4) AS tp1, round(tp2, 4) AS tp2 FROM ft WHERE entry IS NOT NULL",
    "avg_value_20d": f"WITH {EV} SELECT ticker, date, round(round(coalesce(avg(coalesce(volume, 0) * coalesce(close, 0)) OVER (PARTITION BY ticker ORDER BY date RANGE BETWEEN INTERVAL 19 DAYS PRECEDING AND CURRENT ROW), 0.0), 6), 4) AS avg_value FROM ev",
    "regime_ma200": f"""WITH {IX}, w AS (SELECT date, close, count(*) OVER r AS n, round(avg(close) OVER r, 6) AS m FROM ix WINDOW r AS (ORDER BY date ROWS BETWEEN 199 PRECEDING AND CURRENT ROW))
      SELECT date, round(close, 4) AS close, round(CASE WHEN n >= 200 THEN m END, 4) AS ma, CASE WHEN n >= 200 THEN close < m END AS regime_off, CASE WHEN n < 200 THEN 3 WHEN close < m THEN 1 ELSE 2 END AS cap FROM w""",
    "decision_dates": "WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem), l AS (SELECT date FROM d ORDER BY date DESC LIMIT 126) SELECT date, row_number() OVER (ORDER BY date) AS seq FROM l",
    "asof_last_bar": f"WITH {ASOF} SELECT ticker, d AS date, date AS bar_date, close, n_bars FROM ao",
    "signal_gates": f"WITH {CANDIDATES} SELECT arm, ticker, d AS date, date AS bar_date, score, round(r20, 4) AS r20, round(avg_value, 4) AS avg_value FROM cd WHERE bucket = 'QUALIFIED'",
    "bucket_daily": f"WITH {ASSIGNED} {DAILY}",
    "bucket_avg": f"WITH {ASSIGNED}, dy AS ({DAILY}) " + " UNION ALL ".join(f"SELECT '{b}' AS bucket, CAST(format('{{:.1f}}', avg(\"{b}\")) AS DOUBLE) AS avg_tickers FROM dy WHERE arm = 'B0'" for b in _BUCKETS),
    "bucket_assign_reasons": f"WITH {ASSIGNED} SELECT arm, ticker, d AS date, bucket, reasons[1] AS primary_reason, array_to_string(reasons, '|') AS reasons FROM asg",
    "bucket_invariant": f"WITH {ASSIGNED} SELECT arm, d AS date, count(*) AS tickers, true AS invariant_ok FROM asg GROUP BY 1, 2",
    "topn_by_cap": f"WITH {ASSIGNED} SELECT arm, d AS date, rank, ticker, score, 3 AS cap FROM asg WHERE bucket = 'SELECTED'",
    "b0_b1_candidate_delta": f"WITH {CANDIDATES}, q AS (SELECT * FROM cd WHERE bucket = 'QUALIFIED'), {DELTA.format(d='d', t='q')} SELECT * FROM dl",
    "exit_events": f"""WITH {EV}, b AS (SELECT *, 100.0 AS entry, 40.0 AS sl, 160.0 AS tp1, day(date) % 12 AS no FROM ev),
      x AS (SELECT ticker, date, {_REASON.format(**_BAR)} AS exit_reason, {_PRICE.format(**_BAR)} AS exit FROM b) SELECT ticker, date, exit_reason, round(exit, 4) AS exit FROM x WHERE exit_reason IS NOT NULL""",
    "trade_outcomes": f"WITH {OUTCOMES} SELECT ticker, sd AS date, round(entry, 4) AS entry, exit_date, round(exit, 4) AS exit, exit_reason, bars_held FROM out",
    "suspended_exits": f"WITH {OUTCOMES} SELECT ticker, sd AS date, exit_date, round(exit, 4) AS exit, bars_held FROM out WHERE exit_reason = 'TIME_EXIT_SUSPENDED'",
    "simulated_trades": f"""WITH {OUTCOMES},
f AS (SELECT ticker, sd AS date, exit_date, bars_held, entry * 200 AS bought, exit * 200 AS sold, floor(entry * 200 * 0.00151303 + 0.5) AS fee_buy, floor(exit * 200 * 0.00251303 + 0.5) AS fee_sell FROM out WHERE exit_date IS NOT NULL)
SELECT ticker, date, exit_date, bars_held, fee_buy, fee_sell, floor((sold - bought - fee_buy - fee_sell) * 10000.0 + 0.5) / 10000.0 AS net,
  floor((sold - bought - fee_buy - fee_sell) / bought * 100 * 10000.0 + 0.5) / 10000.0 AS ret_pct FROM f""",
    "terminal_buckets": """WITH c AS (
  SELECT o_orderkey, o_orderkey % 11 <> 0 AS data_ok, o_custkey % 40 AS n_bars, o_orderkey % 7 <> 0 AS feature_ok, o_custkey % 13 <> 0 AS scored, o_orderkey % 3 <> 0 AS gates_passed,
    concat_ws('|', CASE WHEN o_custkey % 100 < 65 THEN 'BELOW_THRESHOLD' END, CASE WHEN o_orderkey % 4 <= 0 THEN 'VOLUME_GATE' END, CASE WHEN CAST(floor(o_totalprice) AS BIGINT) % 60 < 30 THEN 'R23_GATE' END) AS failed,
    o_custkey % 5 = 0 AS overlap_open, o_orderkey % 2 = 0 AS selected FROM orders),
b AS (
  SELECT o_orderkey, CASE WHEN NOT data_ok THEN 'DATA_UNUSABLE|QA_V3_FAIL' WHEN n_bars < 20 THEN 'INELIGIBLE|INSUFFICIENT_HISTORY' WHEN NOT feature_ok THEN 'FEATURE_INVALID|FEATURE_FAIL'
    WHEN NOT scored THEN 'FEATURE_INVALID|SCORE_COMPUTE_FAIL' WHEN NOT gates_passed THEN 'GATE_REJECTED|' || CASE WHEN failed = '' THEN 'GATE_FAIL' ELSE failed END
    WHEN overlap_open THEN 'QUALIFIED_NOT_SELECTED|RISK_BLOCKED_OVERLAP' WHEN selected THEN 'SELECTED|CAP_TOP_N' ELSE 'QUALIFIED_NOT_SELECTED|CAP_BLOCKED' END AS x FROM c)
SELECT o_orderkey, split_part(x, '|', 1) AS bucket, split_part(x, '|', 2) AS primary_reason, substr(x, strpos(x, '|') + 1) AS reasons FROM b""",
    "fees_both_profiles": "SELECT o_orderkey, round(o_totalprice * 0.002, 4) AS buy_prod_flat, floor(o_totalprice * 0.00151303 + 0.5) AS buy_ajaib_exact, round(o_totalprice * 0.002, 4) AS sell_prod_flat, floor(o_totalprice * 0.00251303 + 0.5) AS sell_ajaib_exact FROM orders",
    "position_size": "SELECT o_orderkey, CAST(CASE WHEN o_custkey % 40 > 0 THEN greatest(floor(least(o_totalprice / 3, o_totalprice * 0.3 * 0.98) / (o_custkey % 40) / 100), 0) * 100 ELSE 0 END AS BIGINT) AS qty FROM orders",
    "trade_summary": f"""WITH {CLOSED} SELECT arm, count(*) AS n_closed, {half_even("count(*) FILTER (net > 0) / count(*) * 100", 2)} AS win_rate_pct, {half_even("avg(ret_pct)", 4)} AS mean_ret_pct,
      {half_even("list_sort(list(ret_pct))[count(*) // 2 + 1]", 4)} AS median_ret_pct, {half_even("sum(net)", 2)} AS total_net, {half_even("avg(bars_held)", 2)} AS mean_bars_held FROM tr8 GROUP BY 1""",
    "upper_median": "SELECT o_orderpriority, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS median_price FROM orders GROUP BY 1",
    "exit_reason_counts": f"WITH {CLOSED} SELECT arm, exit_reason, count(*) AS trades FROM tr8 GROUP BY 1, 2",
    "fee_sensitivity": f"WITH {CLOSED} SELECT arm, {half_even("sum(net)", 2)} AS total_net_flat, {half_even("sum(net_exact)", 2)} AS total_net_exact, {half_even("sum(net_exact) - sum(net)", 2)} AS fee_impact FROM tr8 GROUP BY 1",
    "trades_only_b0": f"WITH {CLOSED}, {DELTA.format(d='sd', t='tr8')} SELECT ticker || '@' || CAST(date AS VARCHAR) AS trade FROM dl WHERE side = 'only_B0'",
    "trades_common": f"WITH {CLOSED}, {DELTA.format(d='sd', t='tr8')} SELECT side, count(*) AS trades FROM dl GROUP BY 1",
    "mark_equity": f"WITH {ASOF} SELECT d AS date, round(sum(close * 100) + 1e7, 2) AS equity FROM ao GROUP BY 1",
    "canonical_sha": f"""WITH {EV} SELECT ticker, date, sha256('{{"close":' || CAST(close AS VARCHAR) || ',"date":"' || CAST(date AS VARCHAR) || '","high":' || CAST(high AS VARCHAR) || ',"low":' || CAST(low AS VARCHAR)
      || ',"open":' || CAST(open AS VARCHAR) || ',"ticker":"' || ticker || '","volume":' || CAST(volume AS VARCHAR) || '}}') AS id FROM ev""",
    "half_even_rounding": f"""SELECT l_orderkey, l_linenumber, {half_even("l_extendedprice * (1 - l_discount)", 2)} AS price, {half_even("l_extendedprice * (1 - l_discount) * (1 + l_tax)", 4)} AS charge,
      {half_even("l_quantity / 8", 2)} AS eighths, {half_even("-l_quantity / 4", 1)} AS quarters FROM lineitem""",
    "ledger_seq": "SELECT sha256(CAST(o_orderkey AS VARCHAR)) AS id, 1000 + row_number() OVER (ORDER BY o_orderkey) AS ledger_seq FROM orders",
    "ledger_unique_violations": "SELECT o_custkey AS slot, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    "ledger_dangling": "SELECT DISTINCT l_orderkey AS order_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 7 <> 0)",
    "append_outcomes": """WITH o AS (SELECT o_orderkey AS k, 'o' || o_orderkey AS id, CAST(o_totalprice AS VARCHAR) AS digest, o_custkey AS c, o_orderpriority AS p FROM orders),
held AS (SELECT * FROM o WHERE k % 3 = 0 QUALIFY row_number() OVER (PARTITION BY c, p ORDER BY k) = 1),
b AS (SELECT k AS no, * FROM o UNION ALL SELECT 1000000000000 + k, * FROM o WHERE k % 4 = 0 UNION ALL SELECT 2000000000000 + k, k, id, 'another', c, p FROM o WHERE k % 6 = 0),
d AS (SELECT b.*, c % 5 = 0 OR c NOT IN (SELECT c_custkey FROM customer) AS lost, EXISTS (SELECT 1 FROM held h WHERE h.id = b.id) AS known, EXISTS (SELECT 1 FROM held h WHERE h.c = b.c AND h.p = b.p) AS taken FROM b),
f AS (SELECT *, min(no) OVER (PARTITION BY id) AS first_no, arg_min(digest, no) OVER (PARTITION BY id) AS first_digest, arg_min(id, no) FILTER (NOT known) OVER (PARTITION BY c, p) AS winner FROM d)
SELECT no, id, CASE WHEN known THEN CASE WHEN digest = (SELECT h.digest FROM held h WHERE h.id = f.id) THEN 'IDEMPOTENT' ELSE 'CONFLICT' END WHEN lost THEN 'DANGLING' WHEN taken OR winner <> id THEN 'DUPLICATE'
  WHEN no = first_no THEN 'NEW' WHEN digest = first_digest THEN 'IDEMPOTENT' ELSE 'CONFLICT' END AS outcome FROM f""",
    "replay_book": f"WITH RECURSIVE {BOOK} SELECT * FROM booked",
    "e0_report": f"""WITH RECURSIVE {BOOK}, flat AS (SELECT * FROM booked WHERE profile = 'PROD_FLAT'),
      tr AS (SELECT arm, count(*) AS n_closed, {half_even("count(*) FILTER (net > 0) / count(*) * 100", 2)} AS win_rate_pct, {half_even("avg(ret_pct)", 4)} AS mean_ret_pct, {half_even("sum(net)", 2)} AS total_net,
        {half_even("avg(bars_held)", 2)} AS mean_bars_held, {half_even("list_sort(list(ret_pct))[count(*) // 2 + 1]", 4)} AS median_ret_pct FROM flat WHERE kind = 'TRADE' GROUP BY 1),
      op AS (SELECT arm, count(*) AS n_open FROM flat WHERE kind = 'OPEN' GROUP BY 1), eq AS (SELECT arm, arg_max(equity, date) AS final_equity FROM flat WHERE kind = 'DAY' GROUP BY 1)
      SELECT arm, coalesce(n_closed, 0) AS n_closed, win_rate_pct, mean_ret_pct, total_net, mean_bars_held, median_ret_pct, coalesce(n_open, 0) AS n_open, final_equity FROM tr FULL JOIN op USING (arm) FULL JOIN eq USING (arm)""",
    "latest_in_group": "SELECT o_custkey, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) AS o_orderkey, count(*) AS generation FROM orders GROUP BY 1",
}
SQL = {name: _halves_up(sql) for name, sql in SQL.items()}
