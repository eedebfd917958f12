"""Raw exchange JSON to typed tickers, with ignored messages and dead letters set apart.

Well-formed tickers, nearly every row, take one ``from_json`` pass over just the needed fields. The
struct is renamed by position right away, because Binance field names differ only by case. A
message that pass cannot vouch for is looked at again as VARIANT, which tells a missing field from
a null and broken text from text that is valid but no ticker.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clock import iso_text
from ..functions.fixed_point import all_short, scale_short, scale_text
from ..functions.ids import message_id
from ..functions.jsontext import is_blank, label_text, node, node_text, real_number, whole_number
from ..functions.once import let, with_once
from .monitor import monitor_event

OK, IGNORED, DEAD = "ok", "ignored", "dead_letter"

BLANK, NOT_TICKER = "no content", "not a ticker"
MALFORMED, MISSING, BAD_NUMBER = "malformed JSON", "missing field", "bad number"

# Number of decimals kept in each exchange's fixed-point fields.
BINANCE_PRICE_SCALE = 8
COINBASE_PRICE_SCALE = 2
COINBASE_QUANTITY_SCALE = 8

# JSON field names of the two feeds.
BINANCE_FIELDS = {
    "kind": "e", "event_time": "E", "crypto_pair": "s", "best_bid_price": "b", "best_bid_qty": "B",
    "best_ask_price": "a", "best_ask_qty": "A", "volume": "v",
}
COINBASE_FIELDS = {
    "crypto_pair": "product_id", "best_bid": "best_bid", "best_ask": "best_ask", "price": "price",
    "best_bid_quantity": "best_bid_quantity", "best_ask_quantity": "best_ask_quantity",
    "volume": "volume_24_h",
}

_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
_CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class ParseResult:
    """The outputs of one parse. All read the same parsed rows: persist those to write several."""

    ok: DataFrame
    ignored: DataFrame
    dead_letters: DataFrame
    audit: DataFrame


def _all_present(record: Column, names) -> Column:
    present = F.lit(True)
    for name in names:
        present = present & record[name].isNotNull()
    return present


def _is_label(text: Column) -> Column:
    """False where the quick parse may have read a list or an object as its JSON text."""
    return ~F.substring(text, 1, 1).isin("{", "[")


def _texts(problem: Column, fields: dict[str, Column]) -> Column:
    return F.struct(problem.alias("problem"), *(c.alias(n) for n, c in fields.items()))


def _first_problem(blank: Column, parsed: Column, *checks: tuple[Column, str]) -> Column:
    """The first rule a message breaks; NULL if every field is there."""
    rule = F.when(blank, F.lit(BLANK)).when(parsed.isNull(), F.lit(MALFORMED))
    for broken, name in checks:
        rule = rule.when(broken, F.lit(name))
    return rule


def _any_missing(texts: dict[str, Column]) -> Column:
    missing = F.lit(False)
    for text in texts.values():
        missing = missing | text.isNull()
    return missing


def _typed(
    raw: DataFrame, quick: Column, whole: Column, names: dict[str, Column], careful: Callable[[Column], Column],
    labels: dict[str, Callable[[Column], Column]], numbers: dict[str, int],
) -> DataFrame:
    """The raw columns, typed fields, ``reason`` and ``outcome``.

    ``quick`` is parsed once. A message for which ``whole`` holds takes its texts from there (``names``), others from the
    ``careful`` look, which is only taken for them. If any of the ``numbers`` (name -> places) is not short all of them go
    the long way in a column of their own, so the steps every message goes through are generated code without interpreted parts.
    """
    rows = with_once(raw, "_quick", quick)
    rows = with_once(rows, "_rest", F.when(~F.coalesce(whole, F.lit(False)), let(F.try_parse_json("raw"), careful)))
    seen = F.col("_rest").isNull()
    texts = {n: F.when(seen, c).otherwise(F.col(f"_rest.{n}")) for n, c in names.items()}
    short = F.coalesce(all_short([texts[n] for n in numbers]), F.lit(False))
    rows = with_once(rows, "_slow", F.when(~short, F.struct(*(scale_text(texts[n], k).alias(n) for n, k in numbers.items()))))
    fields = {n: work(texts[n]) for n, work in labels.items()}
    fields |= {n: F.when(F.col("_slow").isNull(), scale_short(texts[n], k)).otherwise(F.col(f"_slow.{n}")) for n, k in numbers.items()}
    rows = with_once(rows, "_typed", F.struct(F.col("_rest.problem").alias("problem"), *(c.alias(n) for n, c in fields.items())))
    bad = F.lit(False)
    for name in numbers:
        bad = bad | F.col(f"_typed.{name}").isNull()
    reason = F.coalesce("_typed.problem", F.when(bad, F.lit(BAD_NUMBER)))
    return rows.select(
        *raw.columns, *(F.col(f"_typed.{n}").alias(n) for n in fields), reason.alias("reason"),
        F.when(reason.isNull(), OK).when(reason.isin(BLANK, NOT_TICKER), IGNORED).otherwise(DEAD).alias("outcome"),
    )


def _same(text: Column) -> Column:
    return text


def _binance_careful(parsed: Column) -> Column:
    texts = {n: node_text(parsed, f"$.{f}") for n, f in BINANCE_FIELDS.items() if n != "kind"}
    texts["crypto_pair"] = label_text(parsed, f"$.{BINANCE_FIELDS['crypto_pair']}")
    problem = _first_problem(
        is_blank(F.col("raw")), parsed,
        (node(parsed, "$.e").isNull(), NOT_TICKER),
        (_any_missing(texts), MISSING),
    )
    return _texts(problem, texts)


def parse_binance(raw: DataFrame) -> DataFrame:
    """Adds ``outcome``, ``reason`` and the Binance ticker fields to raw payload rows."""
    schema = ",".join(f"`{f}` string" for f in BINANCE_FIELDS.values())
    renamed = ",".join(f"{n}:string" for n in BINANCE_FIELDS)
    quick = F.from_json("raw", f"{schema},{_CORRUPT} string", _STRICT).cast(
        f"struct<{renamed},corrupt:string>"
    )
    found = F.col("_quick")
    whole = found["corrupt"].isNull() & _all_present(found, BINANCE_FIELDS) & _is_label(found["crypto_pair"])
    names = {n: found[n] for n in BINANCE_FIELDS if n != "kind"}
    numbers = ["best_bid_price", "best_bid_qty", "best_ask_price", "best_ask_qty", "volume"]
    return _typed(
        raw, quick, whole, names, _binance_careful, {"event_time": whole_number, "crypto_pair": _same},
        dict.fromkeys(numbers, BINANCE_PRICE_SCALE),
    ).withColumns({
        "timestamp": iso_text(F.col("ingest_ts")),
        "message_id": message_id(F.col("event_time"), F.col("crypto_pair"), F.col("volume")),
        "price_scale": F.lit(BINANCE_PRICE_SCALE),
    })


def _coinbase_careful(parsed: Column) -> Column:
    first = "$.events[0].tickers[0]"
    texts = {n: node_text(parsed, f"{first}.{f}") for n, f in COINBASE_FIELDS.items()}
    texts["crypto_pair"] = label_text(parsed, f"{first}.{COINBASE_FIELDS['crypto_pair']}")
    texts["event_time"] = label_text(parsed, "$.timestamp")
    problem = _first_problem(
        is_blank(F.col("raw")), parsed,
        (node(parsed, "$.events").isNull(), NOT_TICKER),
        (node(parsed, "$.events[0]").isNull(), MISSING),
        (node(parsed, "$.events[0].tickers").isNull(), NOT_TICKER),
        (_any_missing(texts), MISSING),
    )
    return _texts(problem, texts)


def parse_coinbase(raw: DataFrame) -> DataFrame:
    """Adds ``outcome``, ``reason`` and the Coinbase ticker fields to raw payload rows: the first ticker of the first
    event."""
    ticker = ",".join(f"{f}:string" for f in COINBASE_FIELDS.values())
    quick = F.from_json(
        "raw", f"timestamp string, events array<struct<tickers:array<struct<{ticker}>>>>, {_CORRUPT} string", _STRICT
    )
    found = F.col("_quick")
    first = F.get(F.get(found["events"], F.lit(0))["tickers"], F.lit(0))
    whole = (
        found[_CORRUPT].isNull() & found["timestamp"].isNotNull()
        & _all_present(first, COINBASE_FIELDS.values())
        & _is_label(first["product_id"]) & _is_label(found["timestamp"])
    )
    names = {n: first[f] for n, f in COINBASE_FIELDS.items()} | {"event_time": found["timestamp"]}
    numbers = dict.fromkeys(["best_bid", "best_ask", "price"], COINBASE_PRICE_SCALE)
    numbers |= dict.fromkeys(["best_bid_quantity", "best_ask_quantity"], COINBASE_QUANTITY_SCALE)
    return _typed(
        raw, quick, whole, names, _coinbase_careful,
        {"crypto_pair": _same, "event_time": _same, "volume": real_number}, numbers,
    ).withColumns({
        "timestamp": iso_text(F.col("ingest_ts")),
        "message_id": message_id(F.col("event_time"), F.col("crypto_pair"), F.col("volume")),
        "price_scale": F.lit(COINBASE_PRICE_SCALE),
        "quantity_scale": F.lit(COINBASE_QUANTITY_SCALE),
    })


PARSERS = {"binance": parse_binance, "coinbase": parse_coinbase}

BINANCE_TICKER_COLUMNS = [
    "event_time", "crypto_pair", "best_bid_price", "best_bid_qty", "best_ask_price",
    "best_ask_qty", "volume", "timestamp", "message_id", "price_scale",
]
COINBASE_TICKER_COLUMNS = [
    "crypto_pair", "best_bid", "best_ask", "price", "best_bid_quantity", "best_ask_quantity",
    "event_time", "timestamp", "message_id", "price_scale", "quantity_scale",
]
TICKER_COLUMNS = {"binance": BINANCE_TICKER_COLUMNS, "coinbase": COINBASE_TICKER_COLUMNS}


def parser_of(exchange: str):
    if exchange not in PARSERS:
        raise ValueError(f"Unknown exchange '{exchange}'. Valid values: {sorted(PARSERS)}")
    return PARSERS[exchange]


def tickers(parsed: DataFrame) -> DataFrame:
    """Rows that became a ticker."""
    return parsed.filter(F.col("outcome") == OK)


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Rows kept as raw text for a later replay."""
    return parsed.filter(F.col("outcome") == DEAD)


def ingest_audit(parsed: DataFrame, key: str = "arrival") -> DataFrame:
    """One monitoring event per published ticker or failure; ignored messages leave no trace.

    Ids derive from exchange, lane, position in the lane and level, so a retried task writes the same events.
    """
    name = F.initcap("exchange")
    loud = parsed.filter(F.col("outcome") != IGNORED)
    published = F.col("outcome") == OK
    # Fixed texts: what log readers look for.
    message = F.when(published, F.concat(name, F.lit(" Published message "), F.col("message_id"))).otherwise(
        F.concat(name, F.lit("Error: "), F.col("reason"))
    )
    level = F.when(published, F.lit("INFO")).otherwise(F.lit("ERROR"))
    position = (["lane"] if "lane" in parsed.columns else []) + [key]
    return monitor_event(
        loud, message, level, origin="ingestor", at=F.col("timestamp"),
        name=F.concat_ws("|", F.col("exchange"), *(F.col(c).cast("string") for c in position)),
    )


def parse_raw(raw: DataFrame, exchange: str) -> ParseResult:
    """Parse raw payload rows of one exchange into its outputs."""
    parsed = parser_of(exchange)(raw)
    return ParseResult(
        ok=tickers(parsed).select(*raw.columns, *TICKER_COLUMNS[exchange]),
        ignored=parsed.filter(F.col("outcome") == IGNORED).select(*raw.columns, "reason"),
        dead_letters=dead_letters(parsed).select(*raw.columns, "reason"),
        audit=ingest_audit(parsed),
    )


def replay_dead_letters(letters: DataFrame, exchange: str) -> DataFrame:
    """Parse dead letters again: ``status``, audit ``level`` and ``message`` next to the ticker fields.

    A letter that is no ticker is reported and dropped; one that fails again stays a dead letter.
    """
    parsed = parser_of(exchange)(letters)
    published = F.col("outcome") == OK
    return parsed.withColumns({
        "status": F.when(published, F.lit("republished"))
        .when(F.col("outcome") == IGNORED, F.lit("invalid")).otherwise(F.lit("failed_again")),
        "level": F.when(published, F.lit("INFO")).otherwise(F.lit("ERROR")),
        # Fixed texts: what log readers look for.
        "message": F.when(
            published, F.concat(F.lit("[DLT] Successfully republished message with id "), F.col("message_id"))
        ).otherwise(F.concat(F.lit("[DLT] Problem with republished message: "), F.coalesce("raw", F.lit("null")))),
    })


def as_quotes(parsed: DataFrame, exchange: str) -> DataFrame:
    """Tickers of one exchange in the layout both share, with ``ts`` for windows."""
    rows = tickers(parsed)
    if exchange == "binance":
        rows = rows.withColumns({
            "best_bid": F.col("best_bid_price"), "best_ask": F.col("best_ask_price"),
            "price": F.lit(None).cast("bigint"),
        })
    lane = F.col("lane") if "lane" in rows.columns else F.lit("0")
    return rows.select(
        "exchange", "crypto_pair", "best_bid", "best_ask", "price", "price_scale", "timestamp",
        "message_id", lane.alias("lane"), "arrival", F.col("ingest_ts").alias("ts"),
    )
