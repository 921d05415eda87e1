"""Common table expressions (DuckDB) that the checking queries start from."""

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000


def bars(name: str, instrument: str, ns: str, price: str, order: str, source: str, timeframe: str, seconds: int, table: str, quantity: str = "NULL") -> str:
    step = seconds * 1_000_000_000
    return f"""{name} AS (
  SELECT instrument_id, '{timeframe}' AS timeframe, slot AS open_time_ns, slot + {step} AS close_time_ns,
    arg_min(price, tick) AS open, max(price) AS high, min(price) AS low, arg_max(price, tick) AS close,
    TRUE AS is_closed, sum(quantity) AS volume, count(*) AS trade_count
  FROM (SELECT {instrument} AS instrument_id, (({ns}) // {step}) * {step} AS slot, {price} AS price, {order} AS tick, CAST({quantity} AS DOUBLE) AS quantity FROM {table})
  WHERE price IS NOT NULL AND slot IS NOT NULL GROUP BY instrument_id, slot)"""


ORDER_BARS = bars("bars", "o_orderpriority", "epoch_ns(o_orderdate)", "o_totalprice", "o_orderkey", "orders", "D1", 86_400, "orders")
EVENT_BARS = bars("bars", "event_type", "epoch_ns(ts)", "value", "event_id", "events", "H1", 3_600, "events", "1")
EVENT_M1 = bars("bars", "event_type", "epoch_ns(ts)", "value", "event_id", "events", "M1", 60, "events", "1")
EVENT_M5 = bars("bars", "event_type", "epoch_ns(ts)", "value", "event_id", "events", "M5", 300, "events", "1")
LINE_BARS = bars("bars", "p_brand", "epoch_ns(l_shipdate)", "CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END", "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)", "lineitem", "D1", 86_400, "lineitem JOIN part ON l_partkey = p_partkey", "l_quantity")

SERIES = "instrument_id, timeframe"
BY = f"PARTITION BY {SERIES} ORDER BY close_time_ns"
