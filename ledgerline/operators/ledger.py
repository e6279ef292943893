"""The position ledger: buys, sells, shorts and covers folded in order over one cash balance.

One expression does it: an ``aggregate`` over sorted trades. ``final_state`` gives its
result, ``steps`` the state after every trade as well. Portfolios are independent, so this
scales over them. A portfolio's own trades are sequential: up to ``CHUNK`` of them are one
row's work; those of a longer run go in as many rounds, all runs side by side, each with the
states that the round before has written, so no row holds a whole run. Within a row the
history is kept in blocks of ``BLOCK`` steps: every step copies its block, every block all before it.

A buy or short beyond the cash is filled in part, a sell or cover beyond the
holding is clipped; quantities are truncated; an unknown action, a price of 0
in a partial fill or a quantity of 0 or less trades nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import shared_path

CHUNK, BLOCK = 20_000, 128
#: What moves shares; every other action leaves the state as it is.
TRADES = ("buy", "sell", "short", "cover")

_EXECUTED = """case when x.q <= 0 then 0D
 when x.a = 'buy' then case when x.q * x.p <= s.cash then x.q else greatest(cast(floor(try_divide(s.cash, x.p)) as double), 0D) end
 when x.a = 'sell' then least(x.q, s.l[x.t])
 when x.a = 'short' then case when x.q * x.p * {m} <= s.cash then x.q when {m} > 0 then greatest(cast(floor(try_divide(s.cash, x.p * {m})) as double), 0D) else 0D end
 when x.a = 'cover' then least(x.q, s.s[x.t]) else 0D end"""


def _array(name: str, value: str) -> str:
    return f"transform(s.{name}, (v, i) -> case when e > 0 and i = x.t then {value} else v end)"


def _next_state(m: float) -> str:
    at = lambda n: f"s.{n}[x.t]"
    release = f"(e / {at('s')} * {at('sm')})"
    cases = lambda **k: "case x.a " + " ".join(f"when '{a}' then {v}" for a, v in k.items()) + " else v end"
    money = f"case when e > 0 then case x.a when 'buy' then s.cash - e * x.p when 'sell' then s.cash + e * x.p when 'short' then s.cash + x.p * e - x.p * e * {m} when 'cover' then s.cash + {release} - e * x.p else s.cash end else s.cash end"
    margin = f"case when e > 0 then case x.a when 'short' then s.margin + x.p * e * {m} when 'cover' then s.margin - {release} else s.margin end else s.margin end"
    fields = {
        "cash": money,
        "margin": margin,
        "l": _array("l", cases(buy="v + e", sell="v - e")),
        "s": _array("s", cases(short="v + e", cover="v - e")),
        "lc": _array("lc", cases(buy=f"(v * {at('l')} + e * x.p) / ({at('l')} + e)", sell=f"case when {at('l')} = e then 0D else v end")),
        "sc": _array("sc", cases(short=f"(v * {at('s')} + x.p * e) / ({at('s')} + e)", cover=f"case when {at('s')} = e then 0D else v end")),
        "sm": _array("sm", cases(short=f"v + x.p * e * {m}", cover=f"case when {at('s')} = e then 0D else v - {release} end")),
        "rl": _array("rl", cases(sell=f"v + (x.p - {at('lc')}) * e")),
        "rs": _array("rs", cases(cover=f"v + ({at('sc')} - x.p) * e")),
        "executed": "s.executed + e",
    }
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


_FIELDS = ("cash", "margin", "l", "s", "lc", "sc", "sm", "rl", "rs")


def _state_type(more: str = "") -> str:
    kinds = {"cash": "double", "margin": "double", **dict.fromkeys(_FIELDS[2:], "array<double>"), "executed": "double"}
    return f"struct<{', '.join(f'{k}: {v}' for k, v in kinds.items())}{more}>"


def _fold(tickers: int | str, cash: float, margin: float, history: dict[str, str] | None, kinds: dict[str, str]) -> str:
    """SQL that folds xs from the state ``carried``, or from the first one where that is null: a struct of s and, with history, its steps."""
    m = f"{float(margin)}D"
    first = {"cash": f"{float(cash)}D", "margin": "0D", **{k: f"array_repeat(0D, {tickers})" for k in _FIELDS[2:]}, "executed": "0D"}
    names = [*_FIELDS, "executed"]
    init = "named_struct(" + ", ".join(f"'{k}', coalesce(carried.{k}, {v})" for k, v in first.items()) + ")"
    bound = lambda state: f"element_at(transform(array({_EXECUTED.format(m=m)}), e -> {state}), 1)"
    if history is None:
        return f"named_struct('s', aggregate(xs, {init}, (s, x) -> {bound(_next_state(m))}))"
    # a step has x, the trade, e, the shares that it moves, n, the state after it
    hist = f"array<struct<{', '.join(f'{k}: {v}' for k, v in kinds.items())}>>"
    step = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in history.items()) + ")"
    fields = ", ".join(f"'{k}', n.{k}" for k in names)
    with_step = f"element_at(transform(array({_next_state(m)}), n -> named_struct({fields}, 'hist', array_append(s.hist, {step}))), 1)"
    of_block = "named_struct(" + ", ".join(f"'{k}', element_at(done, -1).{k}" for k in names) + f", 'hist', cast(array() as {hist}))"
    block = f"aggregate(transform(sequence(b * {BLOCK}, least((b + 1) * {BLOCK}, size(xs)) - 1), at -> xs[at]), {of_block}, (s, x) -> {bound(with_step)})"
    start = f"named_struct({', '.join(f'{chr(39)}{k}{chr(39)}, i.{k}' for k in names)}, 'hist', cast(array() as {hist}))"
    blocks = f"aggregate(sequence(0, (size(xs) - 1) div {BLOCK}), array(element_at(transform(array({init}), i -> {start}), 1)), (done, b) -> array_append(done, {block}))"
    final = "named_struct(" + ", ".join(f"'{k}', element_at(d, -1).{k}" for k in names) + ")"
    return f"element_at(transform(array({blocks}), d -> named_struct('s', {final}, 'hist', flatten(transform(d, y -> y.hist)))), 1)"


def _folded(decisions: DataFrame, tickers: int, cash: float, margin: float, carry: tuple[str, ...] = (), history: dict[str, str] | None = None, kinds: dict[str, str] | None = None) -> DataFrame:
    """run_id, chunk and f, the folded chunk, of every chunk of a run's decisions."""
    fields = [F.col("ticker").cast("int").alias("t"), F.col("action").alias("a"), F.coalesce(F.col("quantity").cast("bigint").cast("double"), F.lit(0.0)).alias("q"), F.coalesce("price", F.lit(0.0)).alias("p")]
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1
    placed = decisions.withColumn("chunk", F.floor(place / CHUNK).cast("int"))
    chunks = placed.groupBy("run_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("seq", *fields, *carry))).alias("xs"))
    expression = F.expr(_fold(tickers, cash, margin, history, kinds or {})).alias("f")
    longest = decisions.groupBy("run_id").count().agg(F.max("count")).first()[0] or 0
    none = F.lit(None).cast(_state_type()).alias("carried")
    if longest <= CHUNK:
        return chunks.select("run_id", "chunk", "xs", none).select("run_id", "chunk", expression)
    spark, base = decisions.sparkSession, shared_path(decisions.sparkSession, "ledger")
    chunks.write.partitionBy("chunk").parquet(f"{base}/chunks")
    for number in range(-(-longest // CHUNK)):
        part = spark.read.schema(chunks.schema).parquet(f"{base}/chunks").filter(F.col("chunk") == number)
        if number:
            before = spark.read.parquet(f"{base}/round={number - 1}").select("run_id", F.col("f.s").alias("carried"))
            part = part.join(before, "run_id")
        else:
            part = part.withColumn("carried", none)
        part.select("run_id", "chunk", expression).write.parquet(f"{base}/round={number}")
    return spark.read.parquet(*(f"{base}/round={number}" for number in range(-(-longest // CHUNK))))


def final_state(decisions: DataFrame, tickers: int, cash: float = 100_000.0, margin: float = 0.5) -> DataFrame:
    """One row for each run: cash, margin_used, executed shares, and arrays over tickers 0..tickers-1."""
    state = _folded(decisions, tickers, cash, margin).groupBy("run_id").agg(F.max_by("f.s", "chunk").alias("s"))
    names = {"cash": "cash", "margin": "margin_used", "executed": "executed", "l": "long", "s": "short", "lc": "long_cost_basis", "sc": "short_cost_basis", "sm": "short_margin_used", "rl": "realized_long", "rs": "realized_short"}
    return state.select("run_id", *(F.col(f"s.{k}").alias(v) for k, v in names.items()))


def steps(decisions: DataFrame, tickers: int, cash: float = 100_000.0, margin: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """The state after each decision of run_id, seq, ticker, action, quantity, price, with the carried columns; tickers are 0..tickers-1."""
    history = {"seq": "x.seq", "ticker": "x.t", "action": "x.a", "price": "x.p", "executed": "e", "cash": "n.cash", "margin_used": "n.margin", "long": "n.l[x.t]", "short": "n.s[x.t]"} | {c: f"x.{c}" for c in carry}
    kinds = {"seq": "bigint", "ticker": "int", "action": "string", "price": "double", "executed": "double", "cash": "double", "margin_used": "double", "long": "double", "short": "double"} | {c: decisions.schema[c].dataType.simpleString() for c in carry}
    return _folded(decisions, tickers, cash, margin, carry, history, kinds).select("run_id", F.inline("f.hist"))


def opening_positions(lots: DataFrame, margin: float) -> DataFrame:
    """lots(run_id, pos, ticker, quantity, trade_price) as positions: the last lot of a side wins, all short lots post margin."""
    last = lambda c, side: F.max_by(F.when(side, c), F.when(side, F.col("pos")))
    q, up, down = F.col("quantity"), F.col("quantity") > 0, F.col("quantity") < 0
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return lots.groupBy("run_id", "ticker").agg(
        zero(last(q, up)).alias("long"), zero(last(-q, down)).alias("short"), zero(last(F.col("trade_price"), up)).alias("long_cost_basis"), zero(last(F.col("trade_price"), down)).alias("short_cost_basis"), zero(last(-q * F.col("trade_price") * margin, down)).alias("short_margin_used"), zero(F.sum(F.when(down, -q * F.col("trade_price") * margin))).alias("margin_posted")
    )
