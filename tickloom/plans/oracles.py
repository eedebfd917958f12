"""The named queries as plain SQL for another engine, written independently of the DataFrame code.

These use whole-table windows and self-joins where the operators do not: they state the meaning, not a
plan for large data.
"""

from __future__ import annotations

import re

# -- shared views ------------------------------------------------------------------------------

_FX = """
fx AS (
  SELECT event_id, ts, user_id, event_type, value,
    CASE WHEN event_id % 2 = 0 THEN 'binance' ELSE 'coinbase' END AS exchange,
    CASE WHEN event_type = 'signup' THEN CASE WHEN event_id % 2 = 0 THEN 'DOGEUSDT' ELSE 'DOGE-USD' END
         WHEN event_id % 2 = 0
           THEN CASE user_id % 4 WHEN 0 THEN 'BTCUSDT' WHEN 1 THEN 'ETHUSDT' WHEN 2 THEN 'SOLUSDT' ELSE 'XRPUSDT' END
         ELSE CASE user_id % 4 WHEN 0 THEN 'BTC-USDT' WHEN 1 THEN 'ETH-USD' WHEN 2 THEN 'SOL-USD' ELSE 'XRP-USD' END
    END AS crypto_pair,
    CAST(round(value * 100) AS BIGINT) AS cents,
    row_number() OVER (ORDER BY event_id + (event_id * 37) % 11, event_id) AS arrival
  FROM events
),
tk AS (
  SELECT event_id, ts, arrival, exchange, crypto_pair,
    CASE WHEN exchange = 'binance' THEN cents * 1000000 - 500000 ELSE cents - 1 END AS best_bid,
    CASE WHEN exchange = 'binance' THEN cents * 1000000 + 500001 ELSE cents + 1 END AS best_ask,
    CASE WHEN exchange = 'coinbase' THEN cents END AS price,
    CASE WHEN exchange = 'binance' THEN 8 ELSE 2 END AS price_scale,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp",
    md5(CAST(event_id AS VARCHAR)) AS message_id
  FROM fx
),
tn AS (
  SELECT event_id, arrival, ts AS time, exchange, crypto_pair, message_id,
    CAST(round(CASE WHEN exchange = 'binance'
      THEN (CAST(best_bid AS DECIMAL(20,0)) + best_ask) * CAST(0.000000005 AS DECIMAL(9,9))
      ELSE CAST(price AS DECIMAL(19,0)) * CAST(0.01 AS DECIMAL(9,9)) END, 8) AS DECIMAL(28,8)) AS price
  FROM tk
)"""

_DIM = """
dim(exchange, crypto_pair, canonical_pair) AS (VALUES
  ('binance', 'BTCUSDT', 'BTC-USDT'), ('binance', 'ETHUSDT', 'ETH-USDT'),
  ('binance', 'SOLUSDT', 'SOL-USDT'), ('binance', 'XRPUSDT', 'XRP-USDT'),
  ('coinbase', 'BTC-USDT', 'BTC-USDT'), ('coinbase', 'ETH-USD', 'ETH-USDT'),
  ('coinbase', 'SOL-USD', 'SOL-USDT'), ('coinbase', 'XRP-USD', 'XRP-USDT'))"""


def _uuid3(text: str) -> str:
    return (
        f"concat(substr(md5({text}),1,8),'-',substr(md5({text}),9,4),'-3',substr(md5({text}),14,3),'-',"
        f"translate(substr(md5({text}),17,1),'0123456789abcdef','89ab89ab89ab89ab'),"
        f"substr(md5({text}),18,3),'-',substr(md5({text}),21,12))"
    )


# -- parsing -----------------------------------------------------------------------------------

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')"
_VALUE = "CAST(CAST(value AS DECIMAL(18,9)) AS VARCHAR)"
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _scaled(text: str, places: int) -> str:
    factor = 10**places
    return (
        f"CASE WHEN regexp_matches({text}, '{_NUMBER}') THEN CAST(trunc(TRY_CAST({text} AS DECIMAL({36 - places},17))"
        f" * CAST({factor} AS DECIMAL({places + 1},0))) AS BIGINT) END"
    )


_BINANCE_RAW = f"""
braw AS (
  SELECT event_id, ts, event_type, CASE
    WHEN event_id % 97 = 0 THEN '{{bad'
    WHEN event_id % 89 = 0 THEN '{{"result":null,"id":1}}'
    WHEN event_id % 83 = 0 THEN '{{"e":"24hrTicker","E":' || event_id || ',"s":"BTCUSDT"}}'
    WHEN event_id % 79 = 0 THEN ''
    WHEN event_id % 73 = 0 THEN '{{"e":"24hrTicker","E":1,"s":"BTCUSDT","b":"x","B":"1","a":"1","A":"1","v":"1"}}'
    ELSE '{{"e":"24hrTicker","E":' || event_id || ',"s":"BTCUSDT","b":"' || {_VALUE} || '","B":"1.5","a":"'
      || {_VALUE} || '","A":"2.5","v":"' || user_id || '"}}' END AS raw
  FROM events
),
bj AS (
  SELECT *, trim(raw) = '' AS blank, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM braw
),
bf AS (
  SELECT *, j ->> '$.E' AS et, j ->> '$.s' AS pair, j ->> '$.b' AS b, j ->> '$.B' AS bq,
    j ->> '$.a' AS a, j ->> '$.A' AS aq, j ->> '$.v' AS v FROM bj
),
bn AS (
  SELECT *, {_scaled('b', 8)} AS nb, {_scaled('bq', 8)} AS nbq, {_scaled('a', 8)} AS na,
    {_scaled('aq', 8)} AS naq, {_scaled('v', 8)} AS nv FROM bf
),
bo AS (
  SELECT *, 'binance' AS exchange, CASE
    WHEN blank THEN 'no content'
    WHEN j IS NULL THEN 'malformed JSON'
    WHEN NOT json_exists(j, '$.e') THEN 'not a ticker'
    WHEN et IS NULL OR pair IS NULL OR b IS NULL OR bq IS NULL OR a IS NULL OR aq IS NULL OR v IS NULL THEN 'missing field'
    WHEN nb IS NULL OR nbq IS NULL OR na IS NULL OR naq IS NULL OR nv IS NULL THEN 'bad number' END AS reason
  FROM bn
),
bp AS (
  SELECT event_id, event_type, exchange, raw, coalesce(reason, '') AS reason,
    CASE WHEN reason IS NULL THEN 'ok' WHEN reason IN ('no content', 'not a ticker') THEN 'ignored' ELSE 'dead_letter' END AS outcome,
    CAST(et AS BIGINT) AS event_time, pair AS crypto_pair, nb AS best_bid_price, nbq AS best_bid_qty,
    na AS best_ask_price, naq AS best_ask_qty, nv AS volume, {_ISO} AS "timestamp",
    {_uuid3("et || '|' || pair || '|' || nv")} AS message_id, 8 AS price_scale
  FROM bo
)"""

_T = "$.events[0].tickers[0]"
_COINBASE_RAW = f"""
cw AS (
  SELECT *, '{{"product_id":"ETH-USD","price":"' || {_VALUE} || '","volume_24_h":' AS head,
    ',"best_bid":"' || {_VALUE} || '",' AS bid, '"best_ask":"' || {_VALUE} || '",' AS ask,
    '"best_bid_quantity":"0.5","best_ask_quantity":"0.25"}}' AS tail,
    '{{"timestamp":"T' || event_id || '",' AS stamp, '"' || user_id || '.5"' AS vol
  FROM events
),
craw AS (
  SELECT event_id, ts, event_type, CASE
    WHEN event_id % 97 = 0 THEN '{{bad'
    WHEN event_id % 89 = 0 THEN '{{"type":"subscriptions","channel":"ticker"}}'
    WHEN event_id % 83 = 0 THEN stamp || '"events":[]}}'
    WHEN event_id % 79 = 0 THEN ''
    WHEN event_id % 73 = 0 THEN stamp || '"events":[{{"type":"snapshot"}}]}}'
    WHEN event_id % 71 = 0 THEN stamp || '"events":[{{"type":"update","tickers":[]}}]}}'
    WHEN event_id % 67 = 0 THEN stamp || '"events":null}}'
    ELSE stamp || '"events":[{{"type":"update","tickers":[' || CASE
      WHEN event_id % 61 = 0 THEN head || vol || bid || '"best_ask":"x",' || tail
      WHEN event_id % 59 = 0 THEN head || '"n/a"' || bid || ask || tail
      WHEN event_id % 53 = 0 THEN head || vol || bid || ask || tail || ',{{"product_id":"LATER"}}'
      WHEN event_id % 47 = 0 THEN head || vol || bid || tail
      ELSE head || vol || bid || ask || tail END || ']}}]}}' END AS raw
  FROM cw
),
cj AS (
  SELECT *, trim(raw) = '' AS blank, CASE WHEN json_valid(raw) THEN CAST(raw AS JSON) END AS j FROM craw
),
cf AS (
  SELECT *, j ->> '$.timestamp' AS et, j ->> '{_T}.product_id' AS pair, j ->> '{_T}.best_bid' AS b,
    j ->> '{_T}.best_ask' AS a, j ->> '{_T}.price' AS p, j ->> '{_T}.best_bid_quantity' AS bq,
    j ->> '{_T}.best_ask_quantity' AS aq, j ->> '{_T}.volume_24_h' AS v FROM cj
),
cn AS (
  SELECT *, {_scaled('b', 2)} AS nb, {_scaled('a', 2)} AS na, {_scaled('p', 2)} AS np,
    {_scaled('bq', 8)} AS nbq, {_scaled('aq', 8)} AS naq, coalesce(TRY_CAST(v AS DOUBLE), 0.0) AS nv FROM cf
),
co AS (
  SELECT *, 'coinbase' AS exchange, CASE
    WHEN blank THEN 'no content'
    WHEN j IS NULL THEN 'malformed JSON'
    WHEN NOT json_exists(j, '$.events') THEN 'not a ticker'
    WHEN NOT json_exists(j, '$.events[0]') THEN 'missing field'
    WHEN NOT json_exists(j, '$.events[0].tickers') THEN 'not a ticker'
    WHEN et IS NULL OR pair IS NULL OR b IS NULL OR bq IS NULL OR a IS NULL OR aq IS NULL OR p IS NULL OR v IS NULL THEN 'missing field'
    WHEN nb IS NULL OR nbq IS NULL OR na IS NULL OR naq IS NULL OR np IS NULL THEN 'bad number' END AS reason
  FROM cn
),
cp AS (
  SELECT event_id, event_type, exchange, raw, coalesce(reason, '') AS reason,
    CASE WHEN reason IS NULL THEN 'ok' WHEN reason IN ('no content', 'not a ticker') THEN 'ignored' ELSE 'dead_letter' END AS outcome,
    pair AS crypto_pair, nb AS best_bid, na AS best_ask, np AS price, nbq AS best_bid_quantity,
    naq AS best_ask_quantity, et AS event_time, {_ISO} AS "timestamp",
    {_uuid3("et || '|' || pair || '|' || CAST(nv AS VARCHAR)")} AS message_id, 2 AS price_scale, 8 AS quantity_scale
  FROM co
)"""

_BOTH = f"WITH {_BINANCE_RAW}, {_COINBASE_RAW}"


def _union(template: str) -> str:
    return " UNION ALL ".join(template.format(p=p) for p in ("bp", "cp"))


def _second_pass(parsed: str, views: str, first: str) -> str:
    """The parsing views once more, over the corrected texts of what they could not read."""
    names = re.findall(r"^(\w+) AS \($", views, re.M)
    raw = names[names.index(first) - 1]
    chain = views[views.index(f"{first} AS ("):]
    for name in names[names.index(first) - 1:]:
        chain = re.sub(rf"\b{name}\b(?!\.|')", f"{name}_again", chain)
    return f""",
{raw}_again AS (SELECT event_id, e.ts, e.event_type, replace(raw, '"x"', '"1"') AS raw
  FROM {parsed} JOIN events e USING (event_id) WHERE outcome = 'dead_letter'),
{chain}"""


_PARSING = {
    "raw_parse_outcomes": _BOTH + _union(
        " SELECT exchange, outcome, reason, count(*) AS messages FROM {p} GROUP BY ALL"),
    "binance_parse": f"""WITH {_BINANCE_RAW}
      SELECT event_id, event_time, crypto_pair, best_bid_price, best_bid_qty, best_ask_price, best_ask_qty, volume,
        "timestamp", message_id, price_scale FROM bp WHERE outcome = 'ok'""",
    "coinbase_parse": f"""WITH {_COINBASE_RAW}
      SELECT event_id, crypto_pair, best_bid, best_ask, price, best_bid_quantity, best_ask_quantity, event_time,
        "timestamp", message_id, price_scale, quantity_scale FROM cp WHERE outcome = 'ok'""",
    "dead_letters": _BOTH + _union(
        " SELECT event_id, exchange, raw, reason FROM {p} WHERE outcome = 'dead_letter'"),
    "dead_letter_replay": _BOTH + _second_pass("bp", _BINANCE_RAW, "bj") + _second_pass("cp", _COINBASE_RAW, "cj") + _union("""
      SELECT event_id, exchange,
        CASE outcome WHEN 'ok' THEN 'republished' WHEN 'ignored' THEN 'invalid' ELSE 'failed_again' END AS status,
        CASE outcome WHEN 'ok' THEN 'INFO' ELSE 'ERROR' END AS level,
        CASE outcome WHEN 'ok' THEN '[DLT] Successfully republished message with id ' || message_id
          ELSE '[DLT] Problem with republished message: ' || raw END AS message
      FROM {p}_again"""),
    # The long texts are not read back: their values follow from the whole numbers they were made of.
    "fixed_point_scale": f"""
      WITH t AS (SELECT event_id, user_id AS u, event_id % 15 AS k, event_id % 9 AS a, lpad(CAST(user_id AS VARCHAR), 9, '0') AS z,
          CASE event_type WHEN 'view' THEN {_VALUE} WHEN 'click' THEN '-' || {_VALUE} WHEN 'purchase' THEN user_id || 'e-3'
          WHEN 'error' THEN ' ' || {_VALUE} ELSE user_id || 'x' END AS s FROM events)
      SELECT event_id, CASE k WHEN 0 THEN a || '.' || z || z || '1234567890123456789e10' WHEN 5 THEN '0.000000000000000001' || z || 'E18'
          WHEN 10 THEN '-' || u || z || '0000000000000000000000.5e-24' ELSE s END AS text,
        CASE k WHEN 0 THEN CAST(a AS BIGINT) * 1000000000000000000 + u * 1000000000 + u
          WHEN 5 THEN (1000000000 + u) // 10
          WHEN 10 THEN -(u * 1000000000 + u) * 1000000 ELSE coalesce({_scaled('s', 8)}, -1) END AS scaled_8,
        CASE k WHEN 0 THEN CAST(a AS BIGINT) * 1000000000000 + u * 1000 + u // 1000000
          WHEN 5 THEN (1000000000 + u) // 10000000
          WHEN 10 THEN -(u * 1000000000 + u) ELSE coalesce({_scaled('s', 2)}, -1) END AS scaled_2
      FROM t""",
    "message_ids": f"""WITH {_FX}
      SELECT event_id, {_uuid3("event_id || '|' || crypto_pair || '|' || best_bid")} AS binance_style,
        {_uuid3('"timestamp"' + " || '|' || crypto_pair || '|' || CAST(price_scale + 0.5 AS VARCHAR)")} AS coinbase_style,
        {_uuid3("message_id")} AS plain FROM tk""",
    "ingest_audit": _BOTH + _union("""
      SELECT message, level, "timestamp", 'ingestor' AS "serviceName", """
        + _uuid3("exchange || '|' || event_id % 3 || '|' || event_id || '|ingestor|' || level") + """ AS "messageId"
      FROM (SELECT event_id, exchange, "timestamp",
          CASE outcome WHEN 'ok' THEN 'INFO' ELSE 'ERROR' END AS level,
          upper(substr(exchange, 1, 1)) || substr(exchange, 2) ||
            CASE outcome WHEN 'ok' THEN ' Published message ' || message_id ELSE 'Error: ' || reason END AS message
        FROM {p} WHERE outcome <> 'ignored')"""),
    "relay_json": f"""{_BOTH}
      SELECT event_id, exchange, '{{"event_time":"' || event_time || '","crypto_pair":"' || crypto_pair
        || '","best_bid_price":"' || best_bid_price || '","best_bid_qty":"' || best_bid_qty
        || '","best_ask_price":"' || best_ask_price || '","best_ask_qty":"' || best_ask_qty
        || '","volume":"' || volume || '","timestamp":"' || "timestamp" || '","message_id":"' || message_id
        || '","price_scale":' || price_scale || '}}' AS value FROM bp WHERE outcome = 'ok'
      UNION ALL
      SELECT event_id, exchange, '{{"crypto_pair":"' || crypto_pair || '","best_bid":"' || best_bid
        || '","best_ask":"' || best_ask || '","price":"' || price || '","best_bid_quantity":"' || best_bid_quantity
        || '","best_ask_quantity":"' || best_ask_quantity || '","event_time":"' || event_time
        || '","timestamp":"' || "timestamp" || '","message_id":"' || message_id
        || '","price_scale":' || price_scale || ',"quantity_scale":' || quantity_scale || '}}' AS value
      FROM cp WHERE outcome = 'ok'""",
}

# -- windows -----------------------------------------------------------------------------------

# Three lanes per exchange, each in its own shuffled order.
_LANES = """
ln AS (SELECT *, event_id // 2 % 3 AS lane, event_id // 6 + (event_id * 37) % 11 AS place FROM tk)"""

_WINDOWS = f"""WITH {_FX},
cl AS (
  SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start,
    max(ts) OVER (PARTITION BY exchange ORDER BY arrival ROWS UNBOUNDED PRECEDING) AS clock FROM tk
),
lt AS (SELECT *, window_start + INTERVAL '1 hour' + INTERVAL '10 minutes' <= clock AS late FROM cl),
last AS (
  SELECT *, row_number() OVER (PARTITION BY exchange, crypto_pair, window_start ORDER BY arrival DESC) AS rn
  FROM lt WHERE NOT late
)"""
_LATEST_COLUMNS = "exchange, crypto_pair, window_start, event_id, ts, best_bid, best_ask"

_STREAMS = {
    "canonical_ticks": f"""WITH {_FX}, {_DIM}
      SELECT event_id, exchange, crypto_pair, canonical_pair FROM tk JOIN dim USING (exchange, crypto_pair)""",
    "latest_per_pair": f"""WITH {_FX}
      SELECT exchange, crypto_pair, event_id, ts, best_bid, best_ask FROM (
        SELECT *, row_number() OVER (PARTITION BY exchange, crypto_pair ORDER BY arrival DESC) AS rn FROM tk)
      WHERE rn = 1""",
    "late_ticks": f"{_WINDOWS} SELECT event_id, exchange, crypto_pair, ts FROM lt WHERE late",
    "late_ticks_lanes": f"""WITH {_FX}, {_LANES},
      cl AS (SELECT *, max(ts) OVER (PARTITION BY exchange, lane ORDER BY place, event_id ROWS UNBOUNDED PRECEDING) AS clock FROM ln)
      SELECT event_id, exchange || '/' || lane AS feed, ts FROM cl
      WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '70 minutes' <= clock""",
    "throttle_latest": f"{_WINDOWS} SELECT {_LATEST_COLUMNS} FROM last WHERE rn = 1",
    "throttle_closed": f"""{_WINDOWS}
      SELECT {_LATEST_COLUMNS} FROM last JOIN (SELECT exchange, max(ts) AS final FROM tk GROUP BY exchange) USING (exchange)
      WHERE rn = 1 AND window_start + INTERVAL '70 minutes' <= final""",
}


def _descaled(value: str, scale: str) -> str:
    return (
        f"CAST(round(CASE {scale} WHEN 8 THEN CAST({value} AS DECIMAL(19,0)) * CAST(0.00000001 AS DECIMAL(9,9))"
        f" ELSE CAST({value} AS DECIMAL(19,0)) * CAST(0.01 AS DECIMAL(9,9)) END, 8) AS DECIMAL(28,8))"
    )


_SPREAD_SELECT = f"""
  SELECT {{keep}} canonical_pair AS crypto_pair, {_uuid3("b.message_id || '|' || c.message_id")} AS message_id,
    greatest(b."timestamp", c."timestamp") AS "timestamp",
    CAST({_descaled('b.best_bid', 'b.price_scale')} AS DOUBLE) AS binance_best_bid,
    CAST({_descaled('b.best_ask', 'b.price_scale')} AS DOUBLE) AS binance_best_ask,
    CAST({_descaled('c.best_bid', 'c.price_scale')} AS DOUBLE) AS coinbase_best_bid,
    CAST({_descaled('c.best_ask', 'c.price_scale')} AS DOUBLE) AS coinbase_best_ask,
    CAST({_descaled('c.best_bid', 'c.price_scale')} - {_descaled('b.best_ask', 'b.price_scale')} AS DOUBLE) AS spread_buy_binance_sell_coinbase,
    CAST({_descaled('b.best_bid', 'b.price_scale')} - {_descaled('c.best_ask', 'c.price_scale')} AS DOUBLE) AS spread_buy_coinbase_sell_binance,
    b.event_id AS binance_event_id, c.event_id AS coinbase_event_id"""

_STREAMS["spread_snapshot"] = f"""WITH {_FX}, {_DIM},
  lp AS (SELECT * FROM (SELECT tk.*, canonical_pair,
      row_number() OVER (PARTITION BY exchange, canonical_pair ORDER BY arrival DESC) AS rn
    FROM tk JOIN dim USING (exchange, crypto_pair)) WHERE rn = 1),
  b AS (SELECT * FROM lp WHERE exchange = 'binance'), c AS (SELECT * FROM lp WHERE exchange = 'coinbase')
  {_SPREAD_SELECT.format(keep="")} FROM b JOIN c USING (canonical_pair)"""

_STREAMS["spread_changelog_lanes"] = f"""WITH {_FX}, {_DIM}, {_LANES},
  up AS (SELECT event_id, canonical_pair,
      last_value(CASE WHEN exchange = 'binance' THEN event_id END IGNORE NULLS) OVER w AS bid,
      last_value(CASE WHEN exchange = 'coinbase' THEN event_id END IGNORE NULLS) OVER w AS cid
    FROM ln JOIN dim USING (exchange, crypto_pair)
    WINDOW w AS (PARTITION BY canonical_pair ORDER BY ts, exchange, lane, place, event_id ROWS UNBOUNDED PRECEDING))
  {_SPREAD_SELECT.format(keep="up.event_id AS event_id,")}
  FROM up JOIN tk b ON b.event_id = up.bid JOIN tk c ON c.event_id = up.cid"""

_STREAMS["spread_changelog"] = f"""WITH {_FX}, {_DIM},
  up AS (SELECT event_id, canonical_pair,
      last_value(CASE WHEN exchange = 'binance' THEN event_id END IGNORE NULLS) OVER w AS bid,
      last_value(CASE WHEN exchange = 'coinbase' THEN event_id END IGNORE NULLS) OVER w AS cid
    FROM tk JOIN dim USING (exchange, crypto_pair)
    WINDOW w AS (PARTITION BY canonical_pair ORDER BY arrival ROWS UNBOUNDED PRECEDING))
  {_SPREAD_SELECT.format(keep="up.event_id AS event_id,")}
  FROM up JOIN tk b ON b.event_id = up.bid JOIN tk c ON c.event_id = up.cid"""

_STREAMS["relay_spread_json"] = f"SELECT * EXCLUDE (binance_event_id, coinbase_event_id) FROM ({_STREAMS['spread_changelog']})"

# -- ticks and roll-ups ------------------------------------------------------------------------


def _from_ticks(name: str, bucket: str, where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT time_bucket(INTERVAL '{bucket}', time) AS bucket, exchange, crypto_pair,
    arg_min(price, struct_pack(t := time, m := message_id)) AS open, max(price) AS high, min(price) AS low,
    arg_max(price, struct_pack(t := time, m := message_id)) AS close,
    CAST(sum(price) AS DOUBLE) / count(*) AS avg_price, sum(price) AS price_sum, count(*) AS tick_count
  FROM tn WHERE {where} GROUP BY ALL)"""


def _from_tier(name: str, source: str, bucket: str, origin: str = "") -> str:
    return f"""{name} AS (
  SELECT time_bucket(INTERVAL '{bucket}', bucket{origin}) AS coarse, exchange, crypto_pair,
    arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low, arg_max(close, bucket) AS close,
    CAST(sum(price_sum) AS DOUBLE) / sum(tick_count) AS avg_price, sum(price_sum) AS price_sum, sum(tick_count) AS tick_count
  FROM {source} GROUP BY coarse, exchange, crypto_pair)"""


def _points(name: str, bucket: str = "bucket", where: str = "TRUE") -> str:
    return f"""
  SELECT {bucket} AS bucket, exchange, crypto_pair, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high,
    CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, round(avg_price + 1e-9, 6) AS avg_price,
    CAST(price_sum AS VARCHAR) AS price_sum, CAST(tick_count AS BIGINT) AS tick_count FROM {name} WHERE {where}"""


_HOURLY = _from_ticks("h", "1 hour")
_MINUTE = _from_ticks("m", "1 minute")
_HALF = _from_tier("hh", "m", "30 minutes")
_DAILY = _from_tier("d", "h", "1 day")
_DAYS = "dd AS (SELECT coarse AS bucket, * EXCLUDE (coarse) FROM d)"
_WEEKLY = _from_tier("w", "dd", "7 days", ", TIMESTAMP '2024-01-01'")

_HISTORY = """crypto_pair = 'BTCUSDT' AND bucket >= TIMESTAMP '2024-01-10' AND bucket <= TIMESTAMP '2024-01-27'"""

_TICKS = {
    "ticks_normalized": f"""WITH {_FX}
      SELECT event_id, time, exchange, crypto_pair, CAST(price AS DOUBLE) AS price, message_id FROM tn""",
    "ticks_mapping_errors": f"""WITH {_FX},
      f AS (SELECT event_id, exchange, crypto_pair, message_id,
        CASE WHEN event_id % 97 = 0 THEN 'yesterday' WHEN event_id % 89 = 0 THEN rtrim("timestamp", 'Z')
          ELSE "timestamp" END AS "timestamp",
        CASE WHEN event_id % 83 = 0 THEN -1 ELSE price_scale END AS price_scale FROM tk)
      SELECT *, CASE WHEN price_scale < 0 THEN 'bad price scale' ELSE 'bad timestamp' END AS error
      FROM f WHERE price_scale < 0 OR NOT ends_with("timestamp", 'Z')""",
    "ticks_dedupe": f"""WITH {_FX}, dl AS (SELECT * FROM tn UNION ALL SELECT * FROM tn WHERE event_id % 10 = 0)
      SELECT event_id, time, exchange, crypto_pair, CAST(price AS DOUBLE) AS price, message_id FROM (
        SELECT *, row_number() OVER (PARTITION BY time, crypto_pair, message_id ORDER BY arrival) AS rn FROM dl)
      WHERE rn = 1""",
    "ticks_idempotent_append": f"""WITH {_FX}, dl AS (SELECT * FROM tn UNION ALL SELECT * FROM tn WHERE event_id % 10 = 0)
      SELECT DISTINCT event_id, time, exchange, crypto_pair, CAST(price AS DOUBLE) AS price, message_id FROM dl
      WHERE NOT EXISTS (SELECT 1 FROM tn s WHERE s.exchange = 'coinbase' AND s.time = dl.time
        AND s.crypto_pair = dl.crypto_pair AND s.message_id = dl.message_id)""",
    "retention_filter": f"""WITH {_FX}
      SELECT event_id, time, exchange, crypto_pair, CAST(price AS DOUBLE) AS price FROM tn
      WHERE date_trunc('day', time) + INTERVAL '1 day' > TIMESTAMP '2024-02-15 06:00:00' - INTERVAL '1 month'""",
    "ohlc_minute": f"WITH {_FX}, {_MINUTE} {_points('m')}",
    "ohlc_30min": f"WITH {_FX}, {_MINUTE}, {_HALF} {_points('hh', 'coarse')}",
    "ohlc_hourly": f"WITH {_FX}, {_HOURLY} {_points('h')}",
    "ohlc_daily": f"WITH {_FX}, {_HOURLY}, {_DAILY} {_points('d', 'coarse')}",
    "ohlc_weekly": f"WITH {_FX}, {_HOURLY}, {_DAILY}, {_DAYS}, {_WEEKLY} {_points('w', 'coarse')}",
    "refresh_window_minute": f"""WITH {_FX}, {_MINUTE}
      {_points('m', where="bucket >= TIMESTAMP '2024-01-15 12:04:00' AND bucket < TIMESTAMP '2024-01-15 12:33:00'")}""",
    "refresh_window_30min": f"""WITH {_FX}, {_MINUTE}, {_HALF}
      {_points('hh', 'coarse', "coarse >= TIMESTAMP '2024-01-15 10:00:00' AND coarse < TIMESTAMP '2024-01-15 12:00:00'")}""",
    "refresh_window_hourly": f"""WITH {_FX}, {_HOURLY}
      {_points('h', where="bucket >= TIMESTAMP '2024-01-15 10:00:00' AND bucket < TIMESTAMP '2024-01-15 12:00:00'")}""",
    "refresh_window_daily": f"""WITH {_FX}, {_HOURLY}, {_DAILY}
      {_points('d', 'coarse', "coarse >= TIMESTAMP '2024-01-13' AND coarse < TIMESTAMP '2024-01-15'")}""",
    "ohlc_history": f"WITH {_FX}, {_HOURLY} {_points('h', where=_HISTORY)} ORDER BY bucket, exchange",
    "ohlc_history_exchange": f"""WITH {_FX}, {_HOURLY}
      {_points('h', where=_HISTORY + " AND exchange = 'binance'")} ORDER BY bucket""",
    "ohlc_history_daily": f"""WITH {_FX}, {_HOURLY}, {_DAILY}
      {_points('d', 'coarse', "crypto_pair = 'ETH-USD' AND coarse BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-03-01'")}
      ORDER BY bucket""",
    "ohlc_history_minute": f"""WITH {_FX}, {_MINUTE}
      {_points('m', where="crypto_pair = 'BTCUSDT' AND bucket BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-10 12:00:00'")}
      ORDER BY bucket""",
    "compare_exchanges": f"""WITH {_FX}, {_DIM}, {_HOURLY},
      hc AS (SELECT h.*, canonical_pair FROM h JOIN dim USING (exchange, crypto_pair))
      SELECT canonical_pair, bucket, CAST(b.close AS DOUBLE) AS binance_close, CAST(c.close AS DOUBLE) AS coinbase_close,
        round(b.avg_price + 1e-9, 6) AS binance_avg_price, round(c.avg_price + 1e-9, 6) AS coinbase_avg_price,
        b.tick_count AS binance_tick_count, c.tick_count AS coinbase_tick_count,
        CAST(b.close - c.close AS DOUBLE) AS close_difference
      FROM (SELECT * FROM hc WHERE exchange = 'binance') b JOIN (SELECT * FROM hc WHERE exchange = 'coinbase') c
        USING (canonical_pair, bucket)""",
}

# -- monitoring --------------------------------------------------------------------------------

_MONITOR = """WITH mv AS (
  SELECT event_id, CASE WHEN event_id % 23 <> 0 THEN 'seen ' || event_type ELSE '' END AS message,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS "timestamp", md5(CAST(event_id AS VARCHAR)) AS message_id,
    CASE WHEN event_id % 29 = 0 THEN '' WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    CASE WHEN event_id % 2 = 0 THEN 'ingestor' ELSE 'aggregations' END AS service_name,
    'i-' || user_id % 8 AS instance_id, md5(CAST(user_id AS VARCHAR)) AS trace_id,
    'host-' || user_id % 4 AS host, 'prod' AS environment, '{"kind":"' || event_type || '"}' AS metadata
  FROM events)"""

_MONITORING = {
    "monitor_valid": f"""{_MONITOR} SELECT event_id, message, level, message_id AS "messageId" FROM mv
      WHERE message <> '' AND level <> ''""",
    "monitor_reshape": f"""{_MONITOR}
      SELECT event_id, message, "timestamp", message_id, level, service_name, instance_id, trace_id, host, environment,
        metadata FROM mv""",
}


def all_oracles() -> dict[str, str]:
    """SQL per query name."""
    return {**_PARSING, **_STREAMS, **_TICKS, **_MONITORING}
