"""The same answers in SQL for an independent engine, written from the definitions.

Sums and folds are spelled out with plain windows and a recursive CTE; nothing here mirrors how the
Spark side computes them.
"""

from __future__ import annotations

BARS = """
ticks AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_linenumber,
         CAST(floor(l_extendedprice * 100) AS BIGINT) % 2000 + 10000 AS px,
         (l_orderkey * 8 + l_linenumber) * 2048 + CAST(floor(l_extendedprice * 100) AS BIGINT) % 2000 AS seq,
         CAST(l_quantity AS BIGINT) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS (
  SELECT symbol, date, min(seq) % 2048 + 10000 AS open, max(px) AS high, min(px) AS low,
         max(seq) % 2048 + 10000 AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM ticks GROUP BY symbol, date)"""

SPLIT_BARS = BARS + """,
split_bars AS (
  SELECT symbol, date, min(seq) % 2048 + 10000 AS open, max(px) AS high, min(px) AS low,
         max(seq) % 2048 + 10000 AS close, CAST(sum(qty) AS BIGINT) AS volume
  FROM ticks GROUP BY symbol, date, l_linenumber)"""

POSITIONS = SPLIT_BARS + """,
positions AS (
  SELECT *, row_number() OVER (PARTITION BY symbol
           ORDER BY date, open, high, low, close, volume) - 1 AS idx
  FROM split_bars)"""


def jobs_cte(params: list[dict]) -> str:
    """Jobs = distinct brands x parameter sets, numbered by symbol, windows and start."""
    rows = ", ".join(
        f"(DATE '{p['start_date']}', DATE '{p['end_date']}', {p['short_window']}, "
        f"{p['long_window']}, {p['initial_capital']})"
        for p in params
    )
    return f"""
jobs AS (
  SELECT CAST(row_number() OVER (ORDER BY symbol, short_window, long_window, start_date) AS BIGINT) AS job_id, *
  FROM (SELECT DISTINCT p_brand AS symbol FROM part)
  CROSS JOIN (VALUES {rows}) AS v(start_date, end_date, short_window, long_window, initial_capital))"""


# slice -> averages -> crossover -> fold -> equity, per job
SIGNALS = """
sliced AS (
  SELECT j.job_id, j.symbol, j.short_window AS sw, j.long_window AS lw, j.initial_capital AS capital,
         b.date, b.close, row_number() OVER (PARTITION BY j.job_id ORDER BY b.date) - 1 AS pos
  FROM jobs j JOIN bars b ON b.symbol = j.symbol AND b.date BETWEEN j.start_date AND j.end_date),
summed AS (
  SELECT *, sum(close) OVER (PARTITION BY job_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cs FROM sliced),
averaged AS (
  SELECT a.*,
         CASE WHEN a.pos >= a.sw - 1 THEN a.cs - coalesce(s.cs, 0) END AS short_sum,
         CASE WHEN a.pos >= a.lw - 1 THEN a.cs - coalesce(l.cs, 0) END AS long_sum
  FROM summed a
  LEFT JOIN summed s ON s.job_id = a.job_id AND s.pos = a.pos - a.sw
  LEFT JOIN summed l ON l.job_id = a.job_id AND l.pos = a.pos - a.lw),
compared AS (
  SELECT *, CASE WHEN pos >= lw AND short_sum > 0 AND long_sum > 0
                 THEN CASE WHEN short_sum * lw > long_sum * sw THEN 1 ELSE -1 END END AS dir
  FROM averaged),
remembered AS (
  SELECT *, coalesce(last_value(dir IGNORE NULLS) OVER (PARTITION BY job_id ORDER BY pos
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS before
  FROM compared),
signals AS (
  SELECT *, CASE WHEN dir IS NOT NULL AND pos > lw AND dir <> before THEN dir ELSE 0 END AS signal
  FROM remembered)"""

FOLD = """
acts AS (
  SELECT job_id, pos, date, close, signal, CAST(round(capital * 100) AS BIGINT) AS capital,
         row_number() OVER (PARTITION BY job_id ORDER BY pos) AS k
  FROM (SELECT *, lag(signal, 1, 0) OVER (PARTITION BY job_id ORDER BY pos) AS prev_signal FROM signals)
  WHERE signal <> 0 AND signal <> prev_signal),
fold AS (
  SELECT job_id, CAST(0 AS BIGINT) AS k, CAST(round(initial_capital * 100) AS BIGINT) AS cash,
         CAST(0 AS BIGINT) AS shares, CAST(0 AS BIGINT) AS traded FROM jobs
  UNION ALL
  SELECT f.job_id, a.k,
         CASE WHEN a.signal = 1 AND f.shares = 0 THEN f.cash - (f.cash // a.close) * a.close
              WHEN a.signal = -1 AND f.shares > 0 THEN f.cash + f.shares * a.close ELSE f.cash END,
         CASE WHEN a.signal = 1 AND f.shares = 0 THEN f.cash // a.close
              WHEN a.signal = -1 THEN 0 ELSE f.shares END,
         CASE WHEN a.signal = 1 AND f.shares = 0 THEN f.cash // a.close
              WHEN a.signal = -1 AND f.shares > 0 THEN -f.shares ELSE 0 END
  FROM fold f JOIN acts a ON a.job_id = f.job_id AND a.k = f.k + 1),
made AS (
  SELECT f.job_id, a.pos, a.date, CAST(a.signal AS INTEGER) AS signal, a.close AS price, abs(f.traded) AS shares,
         abs(f.traded) * a.close AS value, f.cash AS cash_after, f.shares AS shares_after
  FROM fold f JOIN acts a ON a.job_id = f.job_id AND a.k = f.k WHERE f.traded <> 0),
curve AS (
  SELECT s.job_id, s.symbol, s.pos, s.date, s.close,
         coalesce(last_value(m.cash_after IGNORE NULLS) OVER w, CAST(round(s.capital * 100) AS BIGINT)) AS cash,
         coalesce(last_value(m.shares_after IGNORE NULLS) OVER w, 0) AS shares
  FROM signals s LEFT JOIN made m ON m.job_id = s.job_id AND m.pos = s.pos
  WINDOW w AS (PARTITION BY s.job_id ORDER BY s.pos ROWS UNBOUNDED PRECEDING)),
equity AS (
  SELECT *, cash + shares * close AS equity,
         lag(cash + shares * close) OVER (PARTITION BY job_id ORDER BY pos) AS prev_equity FROM curve),
drawdowns AS (
  SELECT *, max(equity) OVER (PARTITION BY job_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS peak FROM equity),
trips AS (
  SELECT job_id, b AS buy_date, date AS sell_date, value - bought AS profit, value > bought AS win
  FROM (SELECT *, lag(signal) OVER w AS prev, lag(value) OVER w AS bought, lag(date) OVER w AS b
        FROM made WINDOW w AS (PARTITION BY job_id ORDER BY pos))
  WHERE signal = -1 AND prev = 1),
metrics AS (
  SELECT job_id, max_by(equity, pos) AS final, count(r) AS n, avg(r) AS mean, stddev_pop(r) AS dev,
         max((peak - equity) * 100.0 / peak) AS dd
  FROM (SELECT *, CASE WHEN prev_equity > 0 THEN (equity - prev_equity) / CAST(prev_equity AS DOUBLE) END AS r
        FROM drawdowns) GROUP BY job_id),
results AS (
  SELECT j.job_id, j.symbol,
    round((m.final - j.initial_capital * 100) / (j.initial_capital * 100) * 100.0, 6) AS total_return,
    round(CASE WHEN m.n >= 2 AND m.dev >= 1e-10 THEN m.mean / m.dev * sqrt(252.0) ELSE 0.0 END, 6) AS sharpe_ratio,
    round(m.dd, 6) AS max_drawdown, m.final / 100.0 AS final_value,
    CAST((SELECT count(*) FROM made t WHERE t.job_id = j.job_id) AS INTEGER) AS num_trades,
    CAST((SELECT count(*) FROM trips t WHERE t.job_id = j.job_id AND win) AS INTEGER) AS winning,
    CAST((SELECT count(*) FROM trips t WHERE t.job_id = j.job_id AND NOT win) AS INTEGER) AS losing,
    true AS success
  FROM jobs j JOIN metrics m ON m.job_id = j.job_id)"""


FAULTY = """
named AS (
  SELECT DISTINCT p_brand AS symbol FROM part),
listed AS (
  SELECT u || symbol AS symbol, strategy, start_date, end_date,
         short_window, long_window, initial_capital
  FROM named CROSS JOIN (VALUES {rows})
    AS v(strategy, start_date, end_date, short_window, long_window, initial_capital, u)),
all_jobs AS (
  SELECT CAST(row_number() OVER (ORDER BY symbol, strategy, short_window, start_date, initial_capital) AS BIGINT) AS job_id, *
  FROM listed),
judged AS (
  SELECT *, CASE
    WHEN strategy <> 'SMA' THEN 'Invalid job: unknown strategy ' || strategy
    WHEN short_window <= 0 THEN 'Invalid job: window must be positive'
    WHEN initial_capital <= 0 THEN 'Invalid job: capital must be positive'
    WHEN symbol LIKE 'X-%' THEN 'Exception: Failed to open file: data/' || symbol || '.csv'
    WHEN symbol LIKE 'E-%' THEN 'Exception: No valid data loaded from data/' || symbol || '.csv'
    WHEN NOT EXISTS (SELECT 1 FROM bars b WHERE b.symbol = j.symbol AND b.date BETWEEN j.start_date AND j.end_date)
      THEN 'No data in date range' END AS error_message
  FROM all_jobs j),
jobs AS (SELECT * FROM judged WHERE error_message IS NULL)"""

BEATS = """
beats AS (
  SELECT user_id AS entity, ts, CAST(event_id % 5 AS INTEGER) AS active_jobs,
         CAST(floor(value) AS INTEGER) AS completed_jobs FROM events),
dead AS (
  SELECT entity, max(ts) AS last_ts,
         CAST(floor(date_diff('microsecond', max(ts), TIMESTAMP '{as_of}') / 1000000.0) AS BIGINT) AS elapsed
  FROM beats GROUP BY entity
  HAVING floor(date_diff('microsecond', max(ts), TIMESTAMP '{as_of}') / 1000000.0) > {silence}),
ledger AS (
  SELECT o_orderkey AS job_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS entity FROM orders),
answered AS (
  SELECT o_orderkey AS job_id, o_orderpriority <> '5-LOW' AS success FROM orders WHERE o_orderstatus = 'F')"""


def faulty_sql(tail: str) -> str:
    from barloom.plans.catalog import FAULTS

    rows = ", ".join(
        f"('{p['strategy']}', DATE '{p['start_date']}', DATE '{p['end_date']}', {p['short_window']}, "
        f"{p['long_window']}, CAST({p['initial_capital']} AS DOUBLE), '{p['_prefix']}')"
        for p in FAULTS
    )
    faulty = FAULTY.format(rows=rows)
    return f"WITH RECURSIVE {BARS},{faulty},{SIGNALS},{FOLD}\n{tail}"


def state_sql(params: list[dict], ends: list[str], tail: str) -> str:
    """The curve of the whole run, read at the last bar up to each of the dates `ends`."""
    cuts = ", ".join(f"(DATE '{end}')" for end in ends)
    reached = f""",
reached AS (
  SELECT c.job_id, c.symbol, v.until, max(c.pos) + 1 AS bars_processed, max(c.date) AS last_date,
         max_by(c.cash, c.pos) AS cash, max_by(c.shares, c.pos) AS shares, max_by(c.equity, c.pos) AS saved_value
  FROM equity c JOIN (VALUES {cuts}) AS v(until) ON c.date <= v.until GROUP BY ALL)"""
    return run_sql(params, "").rstrip() + reached + "\n" + tail


def run_sql(params: list[dict], tail: str) -> str:
    return f"WITH RECURSIVE {BARS},{jobs_cte(params)},{SIGNALS},{FOLD}\n{tail}"


def momentum_sql(params: list[dict]) -> str:
    """The example strategy: the sign of the change of the close."""
    signals = SIGNALS[: SIGNALS.index("summed AS")] + """
signals AS (
  SELECT *, CAST(coalesce(sign(close - lag(close) OVER (PARTITION BY job_id ORDER BY pos)), 0) AS INTEGER) AS signal
  FROM sliced)"""
    return f"WITH RECURSIVE {BARS},{jobs_cte(params)},{signals},{FOLD}\nSELECT * FROM results"


def slope_sql(params: list[dict]) -> str:
    """The example strategy that repeats its signal."""
    signals = SIGNALS[: SIGNALS.index("summed AS")] + """
signals AS (SELECT *, CASE WHEN close > 11000 THEN 1 ELSE -1 END AS signal FROM sliced)"""
    return f"WITH RECURSIVE {BARS},{jobs_cte(params)},{signals},{FOLD}\nSELECT * FROM results"


def breakout_sql(params: list[dict]) -> str:
    """The example strategy that remembers all closes before."""
    signals = SIGNALS[: SIGNALS.index("summed AS")] + """
signals AS (
  SELECT *, CASE WHEN close > max(close) OVER w THEN 1 WHEN close < min(close) OVER w THEN -1 ELSE 0 END AS signal
  FROM sliced WINDOW w AS (PARTITION BY job_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
    return f"WITH RECURSIVE {BARS},{jobs_cte(params)},{signals},{FOLD}\nSELECT * FROM results"


def isolation_sql(params: list[dict]) -> str:
    """A strategy that works beside three that fail; jobs are numbered by symbol and strategy."""
    good = momentum_sql(params).removesuffix("SELECT * FROM results")
    return good + """
SELECT CAST(row_number() OVER (ORDER BY symbol, s) AS BIGINT) AS job_id, symbol,
  CASE WHEN m IS NULL THEN num_trades ELSE 0 END AS num_trades, CASE WHEN m IS NULL THEN final_value ELSE 0 END AS final_value,
  m IS NULL AS success, m AS error_message
FROM results CROSS JOIN (VALUES ('BUILDS', 'Signal generation failed: cannot be built'),
  ('DIVIDES', 'Signal generation failed: REMAINDER_BY_ZERO'), ('MOMENTUM', NULL),
  ('STUMBLES', 'Signal generation failed: no such bar')) AS v(s, m)"""


def fine_sql(params: list[dict]) -> str:
    """The sweep in units of a hundredth of a cent."""
    fine = BARS.replace("bars AS (", "cent_bars AS (") + """,
bars AS (
  SELECT symbol, date, close * 100 + volume % 100 AS close FROM cent_bars)"""
    fold = FOLD.replace("capital * 100", "capital * 10000").replace("m.final / 100.0", "m.final / 10000.0")
    return f"WITH RECURSIVE {fine},{jobs_cte(params)},{SIGNALS},{fold}\nSELECT * FROM results"


def huge_sql(params: list[dict]) -> str:
    """The sweep over closes of which some are beyond what sums of BIGINTs hold."""
    bars = BARS.replace("bars AS (", "cent_bars AS (") + """,
bars AS (
  SELECT symbol, date, CASE WHEN right(symbol, 1) <= '3' THEN close * 100000000000000 + volume % 7 ELSE close END AS close
  FROM cent_bars)"""
    return f"WITH RECURSIVE {bars},{jobs_cte(params)},{SIGNALS},{FOLD}\nSELECT * FROM results"


def stream_fault_sql() -> str:
    """Valid and invalid jobs over bars that share dates."""
    jobs = """
listed AS (
  SELECT CAST(row_number() OVER (ORDER BY symbol, strategy, short_window, initial_capital) AS BIGINT) AS job_id, *
  FROM (SELECT DISTINCT p_brand AS symbol FROM part)
  CROSS JOIN (VALUES ('SMA', 20, 10000.0, NULL), ('RSI', 20, 10000.0, 'Invalid job: unknown strategy RSI'),
    ('SMA', 0, 10000.0, 'Invalid job: window must be positive'), ('SMA', 20, 0.0, 'Invalid job: capital must be positive'))
    AS v(strategy, short_window, initial_capital, error_message)),
jobs AS (
  SELECT *, 50 AS long_window, DATE '1990-01-01' AS start_date, DATE '2010-12-31' AS end_date
  FROM listed WHERE error_message IS NULL)"""
    bars = SPLIT_BARS.replace("bars AS (", "day_bars AS (", 1).replace("split_bars AS (", "bars AS (")
    signals = SIGNALS.replace(
        "b.date, b.close, row_number() OVER (PARTITION BY j.job_id ORDER BY b.date)",
        "b.date, b.close, row_number() OVER (PARTITION BY j.job_id ORDER BY b.date, b.open, b.high, b.low, b.close, b.volume)",
    )
    return f"""WITH RECURSIVE {bars},{jobs},{signals},{FOLD}
SELECT l.job_id, l.symbol, coalesce((SELECT count(*) FROM sliced s WHERE s.job_id = l.job_id), 0) AS bars,
  coalesce(r.total_return, 0.0) AS total_return, coalesce(r.sharpe_ratio, 0.0) AS sharpe_ratio,
  coalesce(r.max_drawdown, 0.0) AS max_drawdown, coalesce(r.final_value, 0.0) AS final_value,
  coalesce(r.num_trades, 0) AS num_trades, coalesce(r.winning, 0) AS winning, coalesce(r.losing, 0) AS losing,
  0 AS late_bars, l.error_message IS NULL AS success, l.error_message
FROM listed l LEFT JOIN results r ON r.job_id = l.job_id"""


def tick_sql(params: list[dict]) -> str:
    """The sweep over single line items of a return flag, many to a date."""
    ticks = """
bars AS (
  SELECT l_returnflag AS symbol, CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS BIGINT) AS volume,
         CAST(floor(l_extendedprice * 100) AS BIGINT) % 2000 + 10000 AS close
  FROM lineitem)"""
    signals = SIGNALS.replace("ORDER BY b.date)", "ORDER BY b.date, b.close, b.volume)")
    jobs = jobs_cte(params).replace("p_brand AS symbol FROM part", "l_returnflag AS symbol FROM lineitem")
    return f"WITH RECURSIVE {ticks},{jobs},{signals},{FOLD}\nSELECT * FROM results"


def signal_sql(params: list[dict], tail: str) -> str:
    return f"WITH {BARS},{jobs_cte(params)},{SIGNALS}\n{tail}"


def oracle() -> dict[str, str]:
    from barloom.plans.catalog import (
        AS_OF, FULL, HUGE_SWEEP, LONG_WINDOWS, ODD_SYMBOLS, PAIR, POISON_WINDOWS, SILENCE, SWEEP, _param,
    )

    single = [_param(*PAIR, *FULL)]
    odd = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ODD_SYMBOLS.items())
    beats = BEATS.format(as_of=AS_OF, silence=SILENCE)
    day = "date_diff('day', DATE '1995-01-01', date)"
    found = {
        "bars_valid": f"""WITH {BARS}, dirty AS (
            SELECT symbol, date, open / 100.0 AS open,
              CASE WHEN {day} % 97 = 0 THEN low ELSE high END / 100.0 AS high,
              CASE WHEN {day} % 97 = 0 THEN high ELSE low END / 100.0 AS low,
              CASE WHEN {day} % 83 = 0 THEN 'nan'::DOUBLE ELSE close / 100.0 END AS close,
              CASE WHEN {day} % 89 = 0 THEN -volume ELSE volume END AS volume FROM bars)
            SELECT * FROM dirty WHERE NOT isnan(close) AND high >= greatest(low, open, close)
              AND low <= least(open, close) AND volume >= 0""",
        "bars_range": f"""WITH {BARS} SELECT * FROM bars
            WHERE date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'""",
        "bars_lookup": f"""WITH {BARS}, r AS (
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx FROM bars)
            SELECT symbol, count(*) AS size,
              coalesce(max(CASE WHEN date = DATE '1996-06-03' THEN idx END), count(*)) AS position,
              count(*) AS absent_position, max(CASE WHEN idx = 100 THEN date END) AS date_at_100
            FROM r GROUP BY symbol""",
        "bars_position": f"WITH {POSITIONS} SELECT * FROM positions",
        "bars_date_index": f"WITH {POSITIONS} SELECT symbol, date, max(idx) AS idx FROM positions GROUP BY symbol, date",
        "bars_last_per_date": f"""WITH {POSITIONS} SELECT symbol, date, open, high, low, close, volume
            FROM positions p WHERE idx = (SELECT max(idx) FROM positions q WHERE q.symbol = p.symbol AND q.date = p.date)""",
        "bar_count": f"WITH {BARS} SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol",
        "mean_close": f"WITH {BARS} SELECT symbol, round(avg(close) / 100.0, 6) AS mean_close FROM bars GROUP BY symbol",
        "volatility": f"""WITH {BARS}, r AS (
            SELECT symbol, close, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS p FROM bars)
            SELECT symbol, round(stddev_pop(CASE WHEN p > 0 THEN (close - p) / CAST(p AS DOUBLE) END), 8) AS volatility
            FROM r GROUP BY symbol""",
        "sma": signal_sql(single, """SELECT symbol, date, round(short_sum / CAST(sw AS DOUBLE) / 100.0, 6) AS short_sma,
            round(long_sum / CAST(lw AS DOUBLE) / 100.0, 6) AS long_sma FROM averaged"""),
        "crossover_signals": signal_sql(single, "SELECT symbol, date, close, signal FROM signals"),
        "signal_counts": signal_sql(single, "SELECT symbol, signal, count(*) AS bars FROM signals GROUP BY symbol, signal"),
        "trades": run_sql(single, """SELECT job_id, symbol, date, signal, price, shares, value, cash_after
            FROM made JOIN jobs USING (job_id)"""),
        "round_trips": run_sql(single, """SELECT job_id, symbol, buy_date, sell_date, profit, win
            FROM trips JOIN jobs USING (job_id)"""),
        "equity_curve": run_sql(single, "SELECT job_id, symbol, date, cash, shares, equity FROM equity"),
        "equity_returns": run_sql(single, """SELECT job_id, symbol, date,
            round(CASE WHEN prev_equity > 0 THEN (equity - prev_equity) / CAST(prev_equity AS DOUBLE) END, 9) AS ret FROM equity"""),
        "drawdown_curve": run_sql(single, """SELECT job_id, symbol, date, equity, peak,
            round((peak - equity) * 100.0 / peak, 6) AS drawdown_pct FROM drawdowns"""),
        "backtest_result": run_sql(single, "SELECT * FROM results"),
        "backtest_sweep": run_sql(SWEEP, "SELECT * FROM results"),
        "job_status": faulty_sql("""SELECT j.job_id, j.symbol, coalesce(r.num_trades, 0) AS num_trades,
            coalesce(r.final_value, 0.0) AS final_value, j.error_message IS NULL AS success, j.error_message
            FROM judged j LEFT JOIN results r ON r.job_id = j.job_id"""),
        "run_summary": faulty_sql("""SELECT count(*) AS submitted, count(*) FILTER (error_message IS NULL) AS successful,
            count(*) FILTER (error_message IS NOT NULL) AS failed FROM judged"""),
        "job_lookup": faulty_sql("""SELECT j.job_id, j.symbol, j.start_date, r.final_value
            FROM judged j JOIN results r ON r.job_id = j.job_id"""),
        "job_missing": faulty_sql("SELECT job_id, symbol, strategy FROM judged WHERE error_message IS NOT NULL"),
        "scalability_report": """WITH runs AS (
            SELECT event_type AS run, 1 << CAST(event_id % 4 AS INTEGER) AS num_workers, count(*) AS jobs_completed,
              CAST(sum(CAST(floor(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2),
            based AS (SELECT *, max(CASE WHEN num_workers = 1 THEN cents END) OVER (PARTITION BY run) AS base FROM runs),
            sped AS (SELECT *, base * 100 // cents AS speed FROM based)
            SELECT run, CAST(num_workers AS INTEGER) AS num_workers, jobs_completed, cents / 100.0 AS total_time_sec,
              jobs_completed * 1000000 // cents / 10000.0 AS throughput, cents * 100 // jobs_completed / 10000.0 AS avg_job_time,
              speed / 100.0 AS speedup, CAST(speed // num_workers AS DOUBLE) AS efficiency FROM sped""",
        "trading_calendar": """WITH ends AS (
            SELECT o_orderpriority AS symbol, min(CAST(o_orderdate AS DATE)) AS a, max(CAST(o_orderdate AS DATE)) AS b
            FROM orders GROUP BY 1),
            days AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM ends)
            SELECT symbol, date FROM days WHERE isodow(date) < 6""",
        "price_path": """SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, o_orderkey AS step,
            round(100.0 * exp(sum(ln(1 + (CAST(floor(o_totalprice * 100) AS BIGINT) % 401 - 200) / 10000.0)) OVER (
              PARTITION BY o_orderpriority ORDER BY CAST(o_orderdate AS DATE), o_orderkey ROWS UNBOUNDED PRECEDING)), 6) AS price
            FROM orders""",
        "liveness_gaps": f"""WITH {beats}, g AS (
            SELECT entity, ts, lag(ts) OVER (PARTITION BY entity ORDER BY ts) AS prev_ts FROM beats)
            SELECT entity, prev_ts, ts, date_diff('microsecond', prev_ts, ts) // 1000000 AS elapsed FROM g
            WHERE date_diff('microsecond', prev_ts, ts) // 1000000 > {SILENCE}""",
        "dead_entities": f"WITH {beats} SELECT * FROM dead",
        "latest_status": f"""WITH {beats} SELECT entity, max(ts) AS last_ts, max_by(active_jobs, ts) AS active_jobs,
            max_by(completed_jobs, ts) AS completed_jobs FROM beats GROUP BY entity""",
        "orphaned_jobs": f"""WITH {beats} SELECT * FROM ledger WHERE entity IN (SELECT entity FROM dead)
            AND job_id NOT IN (SELECT job_id FROM answered)""",
        "ledger_counts": f"""WITH {beats}, s AS (
            SELECT l.*, a.success, l.entity IN (SELECT entity FROM dead) AS is_dead
            FROM ledger l LEFT JOIN answered a USING (job_id))
            SELECT (SELECT count(DISTINCT entity) FROM beats WHERE entity NOT IN (SELECT entity FROM dead)) AS active_entities,
              count(*) FILTER (success IS NULL AND (entity IS NULL OR is_dead)) AS pending,
              count(*) FILTER (success IS NULL AND entity IS NOT NULL AND NOT is_dead) AS active,
              count(*) FILTER (success) AS completed, count(*) FILTER (NOT success) AS failed FROM s""",
        "state_snapshots": run_sql(single, """SELECT job_id, symbol, pos AS last_processed_index, date AS last_date,
            cash, shares, equity AS portfolio_value FROM equity WHERE pos > 0 AND pos % 100 = 0"""),
        "state_latest": state_sql(single, ["1999-12-31"], "SELECT * EXCLUDE (until) FROM reached"),
        "state_open_jobs": state_sql(single, ["1999-12-31"], "SELECT job_id FROM reached WHERE shares > 0"),
        "resume_equivalence": run_sql(single, "SELECT * FROM results"),
        "custom_strategy": momentum_sql(single),
        "custom_pandas_strategy": momentum_sql(single),
        "csv_scan": f"WITH {BARS} SELECT * FROM bars",
        "csv_lenient": f"WITH {BARS} SELECT * FROM bars",
        "csv_source": f"WITH {BARS} SELECT * FROM bars",
        "csv_source_pruned": f"""WITH {BARS} SELECT '50% a/b+' || symbol AS symbol, * EXCLUDE (symbol) FROM bars
            WHERE starts_with(symbol, 'Brand#2')""",
        "csv_explicit_symbol": f"WITH {BARS} SELECT 'GIVEN' AS symbol, * EXCLUDE (symbol) FROM bars",
        "csv_text_dates": f"""WITH {BARS}, t AS (
            SELECT * REPLACE (concat_ws('-', year(date), month(date), day(date)) AS date) FROM bars)
            SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS idx,
              date BETWEEN '1996-1-1' AND '1996-12-31' AS in_range FROM t""",
        "csv_load": f"WITH {BARS} SELECT CASE symbol {odd} ELSE symbol END AS symbol, * EXCLUDE (symbol) FROM bars",
        "result_sink": faulty_sql("""SELECT row_number() OVER (ORDER BY j.job_id) AS line, j.job_id, j.symbol,
            coalesce(r.total_return, 0.0) AS total_return, coalesce(r.max_drawdown, 0.0) AS max_drawdown,
            coalesce(r.final_value, 0.0) AS final_value, coalesce(r.num_trades, 0) AS num_trades,
            j.error_message IS NULL AS success, j.error_message
            FROM judged j LEFT JOIN results r ON r.job_id = j.job_id"""),
        "summary_sink": faulty_sql("""SELECT count(*) AS submitted, count(*) FILTER (error_message IS NULL) AS successful,
            count(*) FILTER (error_message IS NOT NULL) AS failed, CAST(2.5 AS DOUBLE) AS total_seconds,
            count(*) / CAST(2 AS DOUBLE) AS jobs_per_second FROM judged"""),
        "state_exists": state_sql(single, ["1997-06-30"], "SELECT job_id, symbol FROM reached WHERE job_id % 3 <> 0"),
        "resume_custom": slope_sql(single),
        "resume_pandas": slope_sql(single),
        "resume_blocks": slope_sql(single),
        "custom_block_strategy": momentum_sql(single),
        "custom_block_breakout": breakout_sql(single),
        "resume_block_breakout": breakout_sql(single),
        "strategy_isolation": isolation_sql(single),
        "strategy_failures": """WITH named AS (SELECT DISTINCT p_brand AS symbol FROM part)
            SELECT CAST(row_number() OVER (ORDER BY symbol, s) AS BIGINT) AS job_id, symbol, false AS success, m AS error_message
            FROM named CROSS JOIN (VALUES ('DOUBLED', 'Signal count mismatch with price data'),
              ('FEW', 'Signal count mismatch with price data'), ('RAISES', 'Signal generation failed: no idea')) AS v(s, m)""",
        "stream_faults": stream_fault_sql(),
        "stream_deaths": f"""WITH {beats}, g AS (
            SELECT entity, ts, lag(ts) OVER w AS before, lead(ts) OVER w AS next FROM beats WINDOW w AS (PARTITION BY entity ORDER BY ts)),
            mark AS (SELECT date_trunc('milliseconds', max(ts)) AS latest FROM beats)
            SELECT entity, 'dead' AS event, ts FROM g, mark WHERE date_diff('microsecond', ts, coalesce(next, latest)) // 1000000 > {SILENCE}
            UNION ALL
            SELECT entity, 'revived' AS event, ts FROM g WHERE date_diff('microsecond', before, ts) // 1000000 > {SILENCE}""",
        "stream_continues": run_sql(single, """, numbered AS (
            SELECT CAST(row_number() OVER (ORDER BY u || symbol) AS BIGINT) AS new_id, u || symbol AS symbol, job_id, u
            FROM jobs CROSS JOIN (VALUES (''), ('X-')) AS v(u))
            SELECT n.new_id AS job_id, n.symbol, coalesce((SELECT count(*) FROM sliced s WHERE s.job_id = r.job_id), 0) AS bars,
              coalesce(r.total_return, 0) AS total_return, coalesce(r.sharpe_ratio, 0) AS sharpe_ratio,
              coalesce(r.max_drawdown, 0) AS max_drawdown, coalesce(r.final_value, 0) AS final_value,
              coalesce(r.num_trades, 0) AS num_trades, coalesce(r.winning, 0) AS winning, coalesce(r.losing, 0) AS losing,
              r.job_id IS NOT NULL AS success, CASE WHEN r.job_id IS NULL THEN 'No data in date range' END AS error_message
            FROM numbered n LEFT JOIN results r ON r.job_id = n.job_id AND n.u = ''"""),
        "sweep_long_windows": tick_sql(LONG_WINDOWS),
        "sweep_poison_windows": tick_sql(POISON_WINDOWS),
        "sweep_huge_prices": huge_sql(HUGE_SWEEP),
        "sweep_fine_prices": fine_sql(single),
        "csv_quarantine": f"""WITH {BARS}, t AS (
            SELECT *, {day} AS day, printf('%.2f', open / 100.0) AS o, printf('%.2f', high / 100.0) AS h,
              CASE WHEN {day} % 17 = 0 THEN printf('%.2f', high / 100.0 + 1) ELSE printf('%.2f', low / 100.0) END AS l,
              CASE WHEN {day} % 13 = 0 THEN 'n/a' ELSE printf('%.2f', close / 100.0) END AS c FROM bars)
            SELECT symbol,
              CASE WHEN day % 11 = 0 THEN concat_ws(',', strftime(date, '%Y-%m-%d'), o, h)
                   ELSE concat_ws(',', strftime(date, '%Y-%m-%d'), o, h, l, c, CAST(volume AS VARCHAR), 'extra') END AS line,
              CASE WHEN day % 11 = 0 THEN 'insufficient columns' WHEN day % 13 = 0 THEN 'unparseable value'
                   ELSE 'invalid bar' END AS reason
            FROM t WHERE day % 11 = 0 OR day % 13 = 0 OR day % 17 = 0""",
        "job_list": f"""WITH {jobs_cte(SWEEP)} SELECT job_id, symbol, 'SMA' AS strategy, start_date, end_date,
            CAST(short_window AS INTEGER) AS short_window, CAST(long_window AS INTEGER) AS long_window,
            CAST(initial_capital AS DOUBLE) AS initial_capital FROM jobs""",
        "stream_backtest": run_sql(single, """SELECT r.job_id, r.symbol, r.total_return, r.sharpe_ratio, r.max_drawdown,
            r.final_value, r.num_trades, r.winning, r.losing, 0 AS late_bars,
            (SELECT count(*) FROM sliced s WHERE s.job_id = r.job_id) AS bars FROM results r"""),
        "stream_liveness": f"""WITH {beats}, m AS (
            SELECT entity, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) // 1000000 <= {SILENCE} THEN 0 ELSE 1 END AS fresh
            FROM beats WINDOW w AS (PARTITION BY entity ORDER BY ts)),
            n AS (SELECT *, sum(fresh) OVER (PARTITION BY entity ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
            SELECT entity, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS beats FROM n GROUP BY entity, k""",
    }
    found["report_sink"] = found["scalability_report"]
    return found
