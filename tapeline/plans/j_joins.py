"""Join queries."""

from pyspark.sql import functions as F

from tapeline.functions.frames import number_rows, rolled
from tapeline.operators import joins as J
from tapeline.plans.derived_sql import touch_sql
from tapeline.plans.registry import query
from tapeline.plans.w_indicators import W, keep
from tapeline.sources import derived as D
from tapeline.sources.tables import DAY, bars_b, bars_d, bars_h, epoch, table


@query("j01_asof", "", """WITH l AS (SELECT user_id AS symbol, ts, event_id AS tie, value FROM events WHERE event_type = 'click'),
  r AS (SELECT user_id AS symbol, ts, max(struct_pack(tie := event_id, v := value)).v AS rv FROM events WHERE event_type = 'purchase' GROUP BY ALL),
  m AS (SELECT l.*, r.ts AS rts, rv FROM l ASOF LEFT JOIN r ON l.symbol = r.symbol AND l.ts <= r.ts),
  c AS (SELECT symbol, tie, value, CASE WHEN rts <= ts + INTERVAL 5 DAY THEN rv END AS matched, row_number() OVER (PARTITION BY symbol ORDER BY ts, tie) - 1 AS seq FROM m)
  SELECT symbol, seq, tie, matched, avg(CAST(coalesce(value > matched, FALSE) AS INT)) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS hit_rate FROM c""", "matched hit_rate")
def j01(spark, root):
    e = table(spark, root, "events").select(F.col("user_id").alias("symbol"), "ts", F.col("event_id").alias("tie"), "event_type", "value")
    left = e.filter("event_type = 'click'").drop("event_type")
    right = e.filter("event_type = 'purchase'").select("symbol", "ts", "tie", F.col("value").alias("v"))
    day = F.floor(epoch("ts") / DAY)
    m = J.asof_forward(left, right, day, F.expr("interval 5 days"), ["v"]).withColumn("matched", F.col("match.v"))
    m = number_rows(m.drop("match"), ["ts", "tie"], day)
    hit = F.coalesce(F.col("value") > F.col("matched"), F.lit(False)).cast("int")
    return rolled(m, lambda h, w: h.select("symbol", "seq", "_c", "tie", "matched", F.avg(hit).over(w.rowsBetween(-9, 0)).alias("hit_rate")), 10)


@query("j02_forward_outcome", "patterns", """WITH n AS (SELECT symbol, max(seq) AS m FROM bars_d GROUP BY symbol)
  SELECT p.symbol, p.seq, CASE WHEN p.end_seq >= n.m THEN 0.0 ELSE (z.close - a.close) / a.close END AS outcome, (q.close - a.close) / a.close AS after_5 FROM patterns p JOIN n USING (symbol)
  JOIN bars_d a ON a.symbol = p.symbol AND a.seq = p.end_seq LEFT JOIN bars_d z ON z.symbol = p.symbol AND z.seq = least(p.end_seq + 10, n.m)
  LEFT JOIN bars_d q ON q.symbol = p.symbol AND q.seq = p.end_seq + 5""", "outcome after_5")
def j02(spark, root):
    p, b = D.patterns(spark, root).select("symbol", "seq", "end_seq"), bars_d(spark, root)
    o = J.forward_outcome(p, b, "end_seq", 10).select("symbol", "seq", "outcome")
    a = J.forward_outcome(p, b, "end_seq", 5, clip=False).select("symbol", "seq", F.col("outcome").alias("after_5"))
    return o.join(a, ["symbol", "seq"], "left")


@query("j03_first_touch", "bars_b", f"SELECT symbol, seq, exit_seq, exit_px, reason FROM ({touch_sql('bars_b', 0.5, 0.3, 10)})", "exit_px", d=8)
def j03(spark, root):
    return keep(J.first_touch(bars_b(spark, root), 0.5, 0.3, 10), "exit_seq", "exit_px", "reason")


@query("j07_regime_join", "regimes", f"""WITH j AS (SELECT symbol, regime, e AS r FROM (SELECT symbol, seq, ts, close / lag(close) OVER w - 1 AS e FROM bars_d {W}) JOIN (SELECT symbol, ts, regime FROM regimes) USING (symbol, ts) WHERE e IS NOT NULL)
  SELECT symbol, regime, count(*) AS days, count(*) / (sum(count(*)) OVER (PARTITION BY symbol)) AS share, sum(ln(1 + r)) AS log_growth, avg(r) AS avg_return,
  stddev_samp(r) * sqrt(252) AS volatility, avg(CAST(r > 0 AS DOUBLE)) AS win_rate FROM j GROUP BY symbol, regime""", "share log_growth avg_return volatility win_rate")
def j07(spark, root):
    b = rolled(bars_d(spark, root), lambda h, w: h.withColumn("r", F.try_divide("close", F.lag("close").over(w)) - 1), 1).filter("r IS NOT NULL")
    d = J.by_regime(b.select("symbol", "ts", "r"), D.regimes(spark, root))
    return d.drop("total_return")


@query("j08_semi_join", "trades regimes", """SELECT regime, count(*) AS trades, avg(net_return) AS mean_pnl FROM (SELECT DISTINCT regime FROM regimes) r,
  LATERAL (SELECT net_return FROM trades t WHERE EXISTS (SELECT 1 FROM regimes g WHERE g.symbol = t.symbol AND g.ts = t.entry_ts AND g.regime = r.regime)) GROUP BY regime""", "mean_pnl")
def j08(spark, root):
    t, r = D.trades(spark, root), D.regimes(spark, root).select("symbol", F.col("ts").alias("entry_ts"), "regime")
    names = spark.createDataFrame([(x,) for x in ("unknown", "high_volatility", "high_volume", "strong_uptrend", "strong_downtrend", "normal")], "regime string")
    hit = J.semi(t.crossJoin(F.broadcast(names)), r, ["symbol", "entry_ts", "regime"])
    return hit.groupBy("regime").agg(F.count(F.lit(1)).alias("trades"), F.avg("net_return").alias("mean_pnl"))


@query("j09_resolve_members", "patterns", """SELECT symbol, seq AS first_seq, k AS pos, m.type, m.strength FROM (SELECT symbol, seq, unnest(range(5)) AS k FROM patterns p WHERE seq + 4 < (SELECT count(*) FROM patterns q WHERE q.symbol = p.symbol)) s
  JOIN patterns m ON m.symbol = s.symbol AND m.seq = s.seq + s.k""".replace("m ON m.symbol = s.symbol AND m.seq = s.seq + s.k", "m ON m.symbol = s.symbol AND m.seq = s.seq + s.k").replace("SELECT symbol, seq AS first_seq", "SELECT s.symbol, s.seq AS first_seq"), "strength")
def j09(spark, root):
    p = D.patterns(spark, root).withColumn("id", F.struct("symbol", "seq"))
    ids = rolled(p, lambda h, w: h.withColumn("ids", F.collect_list("id").over(w.rowsBetween(0, 4))), 0, 4).filter("size(ids) = 5")
    s = J.resolve_members(ids.select(F.col("id").alias("seq_id"), "ids"), p.select("id", "type", "strength"), "ids", ["type", "strength"])
    m = s.select("seq_id", F.explode("members").alias("m"))
    return m.select("seq_id.symbol", F.col("seq_id.seq").alias("first_seq"), F.col("m.pos").cast("long").alias("pos"), "m.type", "m.strength")


@query("j10_benchmark_alignment", "returns_p", "SELECT p.symbol, p.seq, p.r - b.r AS active FROM returns_p p JOIN (SELECT seq, avg(r) AS r FROM returns_p GROUP BY seq) b USING (seq)", "active")
def j10(spark, root):
    r = D.returns_p(spark, root).select("symbol", "seq", "r")
    bench = r.groupBy("seq").agg(F.avg("r").alias("r"))
    return J.align(r, bench).select("symbol", "seq", (F.col("r") - F.col("bench")).alias("active"))


@query("j11_next_pattern", "patterns", f"SELECT symbol, seq, type, next_type, type = next_type AS same FROM (SELECT *, lead(type) OVER w AS next_type FROM patterns {W}) WHERE next_type IS NOT NULL")
def j11(spark, root):
    return keep(J.next_label(D.patterns(spark, root)), "type", "next_type", (F.col("type") == F.col("next_type")).alias("same"))


_WT = "SELECT symbol, sum(volume) / sum(sum(volume)) OVER () AS weight FROM bars_b WHERE year(ts) = {y} GROUP BY symbol"


@query("j12_turnover", "bars_b", f"""SELECT sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) / 2 AS turnover, count(*) AS names, sum(abs(coalesce(n.weight, 0) - coalesce(o.weight, 0))) > 0.05 AS rebalance
  FROM ({_WT.format(y=1996)}) o FULL JOIN ({_WT.format(y=1999)}) n USING (symbol)""", "turnover")
def j12(spark, root):
    b = bars_b(spark, root).select("symbol", "volume", F.year("ts").alias("y"))

    def weights(y):
        v = b.filter(F.col("y") == y)
        tot = v.agg(F.sum("volume").alias("t"))
        return v.groupBy("symbol").agg(F.sum("volume").alias("v")).crossJoin(F.broadcast(tot)).select("symbol", (F.col("v") / F.col("t")).alias("weight"))

    return J.turnover(weights(1996), weights(1999))


@query("j13_price_lookup", "bars_h", "SELECT event_id AS id, event_type AS symbol, e.ts, b.close AS price FROM (SELECT *, date_trunc('hour', ts) AS hr FROM events) e JOIN bars_h b ON b.symbol = e.event_type AND b.ts = e.hr", "price")
def j13(spark, root):
    e = table(spark, root, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("ts").alias("t"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
    return J.price_at(e, bars_h(spark, root)).select("id", "symbol", F.col("t").alias("ts"), "price")


@query("j14_context_slice", "patterns", """WITH g AS (SELECT symbol, quantile_cont(d, 0.5) AS med FROM (SELECT symbol, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY symbol ORDER BY seq)) AS d FROM bars_d) GROUP BY symbol),
  i AS (SELECT p.symbol, p.seq AS pid, p.ts AS a, z.ts AS b FROM patterns p JOIN bars_d z ON z.symbol = p.symbol AND z.seq = p.end_seq)
  SELECT i.symbol, i.pid, b.seq, b.close FROM i JOIN g USING (symbol) JOIN bars_d b ON b.symbol = i.symbol AND epoch(b.ts) >= epoch(i.a) - 20 * med AND epoch(b.ts) <= epoch(i.b) + 20 * med""", "close")
def j14(spark, root):
    b = bars_d(spark, root)
    ends = b.select("symbol", F.col("seq").alias("end_seq"), F.col("ts").alias("end_ts"))
    i = D.patterns(spark, root).select("symbol", F.col("seq").alias("pid"), "end_seq", F.col("ts").alias("start_ts")).join(ends, ["symbol", "end_seq"])
    return J.context_slice(i.drop("end_seq"), b).select("symbol", "pid", "seq", "close")
