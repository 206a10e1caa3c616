"""The joint feature table of the daily bars."""

import re

from pyspark.sql import functions as F

from tapeline.functions.lineage import store
from tapeline.operators import cross as CX
from tapeline.operators import indicators as ind
from tapeline.operators import projections as P
from tapeline.plans import a_transitions, p_projections, w_indicators  # noqa: F401  their statements are joined below
from tapeline.plans.registry import ORACLES, query
from tapeline.sources import derived as D
from tapeline.sources.tables import bars_d

_PLAIN = "returns_1d returns_5d returns_20d log_returns_1d log_returns_5d high_low_ratio close_open_ratio price_position_20d price_position_50d day_of_week_sin day_of_week_cos month_sin month_cos is_month_start is_month_end rsi_14".split()
COLUMNS = _PLAIN + CX.PATTERN_COLUMNS
_JOINED = " JOIN ".join(f"({re.sub('bars_[hb]', 'bars_d', ORACLES[n][1])}) {n}" + (" USING (symbol, seq)" if i else "") for i, n in enumerate(("p01_returns", "p02_price_position", "p03_calendar", "w04_rsi")))


@query("d29_feature_table", "bars_d patterns", f"""WITH base AS (SELECT symbol, seq, {', '.join(_PLAIN)} FROM {_JOINED}),
  ch AS (SELECT "from" AS type, coalesce(sum(p) FILTER ("to" = 'trend_up'), 0) AS chance_up, -sum(p * ln(p)) AS transition_entropy FROM ({ORACLES['a17_empirical_matrix'][1]}) GROUP BY "from"),
  j AS (SELECT base.*, p.type, p.strength AS pattern_strength, p.price_change AS pattern_change, CAST(base.seq - p.end_seq AS DOUBLE) AS bars_since_pattern FROM base ASOF LEFT JOIN patterns p ON base.symbol = p.symbol AND base.seq >= p.end_seq),
  f AS (SELECT symbol, seq, {', '.join(f'coalesce(CAST({c} AS DOUBLE), avg({c}) OVER (PARTITION BY symbol), 0) AS {c}' for c in COLUMNS)} FROM j LEFT JOIN ch USING (type))
  SELECT symbol, seq, {', '.join(f'({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () > 0 THEN stddev_pop({c}) OVER () ELSE 1 END AS {c}' for c in COLUMNS)} FROM f""", " ".join(COLUMNS))
def d29(spark, root):
    bars = store(bars_d(spark, root))
    patterns = store(D.patterns(spark, root))
    features = ind.rsi(P.calendar(P.price_position(P.return_columns(bars))), (14,)).select("symbol", "seq", *_PLAIN)
    chain = a_transitions.a17(spark, root).select("from", "to", "p")
    return CX.imputed_scaled(store(CX.with_patterns(features, patterns, chain)), COLUMNS)
