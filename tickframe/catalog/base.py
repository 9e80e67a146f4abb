"""Registration of queries with their column contract and SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    build: Build
    columns: dict[str, str]
    sql: str | None

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # trade dates are UTC dates
        return self.build(spark, sf).select(*[_spark_cast(c, k) for c, k in self.columns.items()])

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        cols = ", ".join(_sql_cast(c, k) for c, k in self.columns.items())
        return f"SELECT {cols} FROM ({self.sql}) AS q"


def _spark_cast(name: str, kind: str) -> Column:
    c = F.col(name)
    if kind.startswith("d"):
        return (F.round(c.cast("double"), int(kind[1:] or 6)) + F.lit(0.0)).alias(name)
    return c.cast({"s": "string", "l": "bigint", "b": "boolean"}[kind]).alias(name)


def _sql_cast(name: str, kind: str) -> str:
    if kind.startswith("d"):
        return f'round(CAST("{name}" AS DOUBLE), {int(kind[1:] or 6)}) + 0.0 AS "{name}"'
    return f'CAST("{name}" AS {({"s": "VARCHAR", "l": "BIGINT", "b": "BOOLEAN"})[kind]}) AS "{name}"'


class Catalog(dict):
    """key → Query; columns are written as 'name:kind …' with kinds s, l, b, d (6 decimals) or dN."""

    def add(self, key: str, columns: str, sql: str | None = None) -> Callable[[Build], Build]:
        spec = dict((c.split(":") + ["d"])[:2] for c in columns.split())

        def register(build: Build) -> Build:
            if key in self:
                raise KeyError(key)
            self[key] = Query(build, spec, sql)
            return build

        return register


# Named SQL views of the driver's tables, mirrored from sources.views.
CTES: dict[str, str] = {
    "ticks": """SELECT event_id, user_id, event_type AS ticker, strftime(ts, '%Y-%m-%d') AS trade_date,
        epoch_us(ts) // 1000 AS ts_ms, value AS price, value AS open, value AS high, value AS low, value AS close,
        CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS volume, value AS vwap,
        CAST(1 AS BIGINT) AS transactions FROM events""",
    "bars": """SELECT ticker, trade_date, ts_ms - ts_ms % 900000 AS ts_ms, arg_min(price, event_id) AS open,
        max(price) AS high, min(price) AS low, arg_max(price, event_id) AS close,
        CAST(sum(volume) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS transactions,
        sum(price * volume) / sum(volume) AS vwap FROM ticks GROUP BY ALL""",
    "und": "SELECT * EXCLUDE (ticker) FROM bars WHERE ticker = 'view'",
    "idx": "SELECT trade_date, ts_ms, open, high, low, close FROM bars WHERE ticker = 'click'",
    "news": """SELECT trade_date, ts_ms, event_id AS article_id,
        CASE WHEN price > 50 THEN 'positive' ELSE 'negative' END AS sentiment,
        'size ' || volume AS sentiment_reasoning FROM ticks WHERE ticker = 'error'""",
    "optbars": """SELECT b.*, 'O:UND' || strftime(CAST(trade_date AS DATE) + 3, '%y%m%d')
        || CASE WHEN ticker = 'purchase' THEN 'C' ELSE 'P' END || '00025000' AS symbol
        FROM bars b WHERE ticker IN ('purchase', 'signup')""",
    "contracts": """SELECT 'P' || p_partkey AS ticker, p_partkey, p_retailprice AS strike_price,
        strftime(DATE '2024-01-01' + p_size, '%Y-%m-%d') AS expiration_date,
        CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS contract_type FROM part""",
    "terms": """SELECT trade_date, ticker, round(avg(price), 0) AS strike_price,
        strftime(CAST(trade_date AS DATE) + 2, '%Y-%m-%d') AS expiration_date,
        CASE WHEN ticker = 'purchase' THEN 'call' ELSE 'put' END AS contract_type
        FROM ticks WHERE ticker IN ('purchase', 'signup') GROUP BY trade_date, ticker""",
    "scored": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount,
        l_tax, l_linestatus, strftime(l_shipdate, '%Y-%m-%d') AS date,
        epoch_ms(l_shipdate) + ((l_orderkey * 7919) % 23400) * 1000 AS timestamp,
        CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target,
        ((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000) / 1000.0::DOUBLE AS proba,
        ((l_orderkey * 13 + l_partkey * 29 + l_linenumber * 3) % 1000) / 1000.0::DOUBLE AS proba_b,
        ((l_orderkey * 7 + l_partkey * 11 + l_linenumber * 5) % 1000) / 1000.0::DOUBLE AS proba_c,
        CASE WHEN l_quantity <> 50 THEN l_discount * 400 END AS max_gain_120m,
        CASE WHEN l_quantity <> 50 THEN l_tax * -300 END AS min_loss_120m,
        CASE WHEN l_linenumber <> 7 THEN l_quantity * 2.5::DOUBLE END AS time_to_max_min,
        floor(l_extendedprice * 100 / 750) / 100 AS close, CAST(9 + l_linenumber % 7 AS BIGINT) AS hour_et,
        CAST(l_partkey % 60 AS BIGINT) AS minute_et,
        'O:UND' || strftime(l_shipdate, '%y%m%d') || CASE WHEN l_partkey % 2 = 0 THEN 'C' ELSE 'P' END
        || printf('%08d', l_partkey * 100) AS ticker FROM lineitem""",
    "scored_models": """SELECT * EXCLUDE (proba, proba_b, proba_c), 'a' AS model, proba FROM scored
        UNION ALL SELECT * EXCLUDE (proba, proba_b, proba_c), 'b', proba_b FROM scored
        UNION ALL SELECT * EXCLUDE (proba, proba_b, proba_c), 'c', proba_c FROM scored""",
}
_NEEDS = {"bars": ["ticks"], "und": ["bars"], "idx": ["bars"], "news": ["ticks"], "optbars": ["bars"],
          "terms": ["ticks"], "scored_models": ["scored"]}


def sql(body: str, *views: str, **extra: str) -> str:
    """``body`` with the named views (and further ones given by keyword) as WITH clauses.

    A keyword starting with ``chain`` is a recursive view.
    """
    order: list[str] = []

    def need(v: str) -> None:
        for d in _NEEDS.get(v, []):
            need(d)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    parts = [f"{v} AS ({CTES[v]})" for v in order] + [f"{k} AS ({v})" for k, v in extra.items()]
    word = "WITH RECURSIVE" if any(k.startswith("chain") for k in extra) else "WITH"
    return f"{word} {', '.join(parts)} {body}" if parts else body


def long_sql(name: str, columns: str, body: str, *by: str) -> str:
    """The rows of ``body`` as (output, key, measure, number, label), the SQL side of ``reports.long_form``."""
    spec = dict((c.split(":") + ["d"])[:2] for c in columns.split())
    show = lambda c: f"printf('%.2f', CAST({c} AS DOUBLE))" if spec[c][0] == "d" else f"CAST({c} AS VARCHAR)"
    key = " || '|' || ".join(f"coalesce({show(c)}, '')" for c in by) or "''"
    kind = {"s": "VARCHAR", "l": "BIGINT", "b": "BOOLEAN"}
    cells = [f"{{'measure': '{c}', 'number': {'NULL' if k == 's' else c if k[0] == 'd' else f'CAST({c} AS {kind[k]})'}::DOUBLE, "
             f"'label': {c if k == 's' else 'NULL'}::VARCHAR}}" for c, k in spec.items() if c not in by]
    return f"SELECT '{name}' AS output, {key} AS key, unnest([{', '.join(cells)}], recursive := true) FROM ({body}) AS q"


def ewm_sql(src: str, x: str, name: str, alpha: float, need: int, by: str) -> str:
    """The exponential mean by its recursion, folded over the values so far, as nested SELECTs over ``src``."""
    w = f"(PARTITION BY {by} ORDER BY ts_ms ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT * EXCLUDE (_x, _list), CASE WHEN len(_list) >= {need}
            THEN list_reduce(_list, lambda a, x: {1 - alpha!r}::DOUBLE * a + {alpha!r}::DOUBLE * x) END AS {name} FROM (
        SELECT *, list(CAST(_x AS DOUBLE)) FILTER (WHERE _x IS NOT NULL) OVER {w} AS _list FROM (SELECT *, {x} AS _x FROM {src}))"""


def rsi_sql(src: str, close: str, name: str, by: str, period: int = 14) -> str:
    w = f"(PARTITION BY {by} ORDER BY ts_ms)"
    step = f"""(SELECT *, CASE WHEN _d > 0 THEN _d ELSE 0.0 END AS _g, CASE WHEN _d < 0 THEN -_d ELSE 0.0 END AS _l
        FROM (SELECT *, {close} - lag({close}) OVER {w} AS _d FROM {src}))"""
    up = ewm_sql(step, "_g", "_up", 1 / period, period, by)
    down = ewm_sql(f"({up})", "_l", "_dn", 1 / period, period, by)
    return f"""SELECT * EXCLUDE (_d, _g, _l, _up, _dn), CASE WHEN _dn IS NULL THEN NULL WHEN _dn = 0 THEN 100.0
        ELSE 100 - 100 / (1 + _up / _dn) END AS {name} FROM ({down})"""


def macd_sql(src: str, close: str, line: str, signal: str, hist: str, by: str) -> str:
    fast = ewm_sql(src, close, "_f", 2 / 13, 12, by)
    slow = ewm_sql(f"({fast})", close, "_s", 2 / 27, 26, by)
    base = f"(SELECT * EXCLUDE (_f, _s), _f - _s AS {line} FROM ({slow}))"
    return f"SELECT *, {line} - {signal} AS {hist} FROM ({ewm_sql(base, line, signal, 2 / 10, 9, by)})"


def bollinger_sql(src: str, close: str, prefix: str, by: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY ts_ms ROWS 19 PRECEDING)"
    return f"""SELECT * EXCLUDE (_m, _sd), _m + 2 * _sd AS {prefix}_upper, _m AS {prefix}_middle,
        _m - 2 * _sd AS {prefix}_lower, 4 * _sd / nullif(_m, 0) * 100 AS {prefix}_width,
        ({close} - (_m - 2 * _sd)) / nullif((_m + 2 * _sd) - (_m - 2 * _sd), 0) AS {prefix}_pct_b FROM (
        SELECT *, CASE WHEN count({close}) OVER {w} >= 20 THEN avg({close}) OVER {w} END AS _m,
        CASE WHEN count({close}) OVER {w} >= 20 THEN stddev_pop({close}) OVER {w} END AS _sd FROM {src})"""
