"""Column expressions that normalise exported numbers, times, sides and headers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ACCENTED, PLAIN = "áàãâéêíóôõúçº°_", "aaaaeeiooouc" + "oo "
#: Header names by field, in normalised form, the preferred first.
ALIASES = {
    "timestamp": ["timestamp", "datahora", "data hora", "datetime"],
    "date": ["data", "date", "session date", "pregao"],
    "time": ["hora", "time", "tempo", "horario"],
    "price": ["price", "preco", "valor", "preco negocio"],
    "quantity": ["quantity", "qtd", "quantidade", "qty", "volume quantidade"],
    "symbol": ["ativo", "ticker", "symbol", "instrumento", "contrato"],
    "trade_id": ["trade id", "tradeid", "numero negocio", "numero do negocio", "no negocio", "nro negocio", "negocio"],
    "buyer": ["agente comprador", "comprador", "buyer", "buyer id", "corretora compradora"],
    "seller": ["agente vendedor", "vendedor", "seller", "seller id", "corretora vendedora"],
    "aggressor": ["aggressor", "agressor", "agressao", "aggression", "tipo agressao", "tipo de agressao", "lado agressor", "lado da agressao", "agressor lado"],
    "after": ["after"],
    "open": ["open", "abertura", "preco abertura"],
    "high": ["high", "maxima", "maximo", "preco maximo"],
    "low": ["low", "minima", "minimo", "preco minimo"],
    "close": ["close", "fechamento", "preco fechamento"],
    "volume": ["volume contratos", "quantidade", "qtd", "volume"],
    "trades": ["trades", "negocios", "numero de negocios", "n negocios"],
}
NUMBER = "decimal(28,8)"
#: Day first with a year of four or two digits, or year first; hours and minutes, and seconds with a fraction.
DAY_FIRST = r"^\d{1,2}/\d{1,2}/(\d{4}|\d{2}) +\d{1,2}:\d{1,2}(:\d{1,2}([.,]\d{1,6})?)?$"
YEAR_FIRST = r"^\d{4}-\d{1,2}-\d{1,2}[T ]+\d{1,2}:\d{1,2}:\d{1,2}([.,]\d{1,6})?$"


def header(name: str) -> str:
    """A header in lower case without accents; º and ° count as o, _ as a blank."""
    return name.strip().lower().translate(str.maketrans(ACCENTED, PLAIN))


def header_column(c: Column) -> Column:
    return F.translate(F.lower(F.trim(c)), ACCENTED, PLAIN)


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _as_number(c: Column) -> Column:
    return c.try_cast(NUMBER)


def generic_number(c: Column) -> Column:
    """With both separators the later one is the decimal one; a lone comma is decimal, a lone dot too."""
    t = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    comma, dot = t.contains(","), t.contains(".")
    later = F.instr(F.reverse(t), ",") < F.instr(F.reverse(t), ".")
    european = F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    english = F.replace(t, F.lit(","), F.lit(""))
    return _as_number(F.when(comma & dot & ~later, english).when(comma, european).otherwise(t))


def profit_number(c: Column) -> Column:
    """As generic, but dots between groups of three digits separate thousands: 205.935 is 205935."""
    t = F.replace(F.trim(c), F.lit(" "), F.lit(""))
    return F.when(t.rlike(r"^[+-]?\d{1,3}(\.\d{3})+$"), _as_number(F.replace(t, F.lit("."), F.lit("")))).otherwise(generic_number(c))


def brazilian_number(c: Column) -> Column:
    return _as_number(F.replace(F.replace(F.replace(F.trim(c), F.lit(" "), F.lit("")), F.lit("."), F.lit("")), F.lit(","), F.lit(".")))


def clock_parts(value: Column) -> Column:
    return F.split(value, r"[/ :.,T-]+")


def _wall_clock(value: Column, parts: Column) -> Column:
    """The ``parts`` of a time put together; no session time zone takes part, so no hour is skipped or doubled."""
    part = lambda k: F.try_element_at(parts, F.lit(k)).try_cast("int")
    year = lambda k: F.when(F.length(F.try_element_at(parts, F.lit(k))) > 2, part(k)).otherwise(part(k) + F.when(part(k) < 69, 2000).otherwise(1900))
    fraction = F.rpad(F.coalesce(F.try_element_at(parts, F.lit(7)), F.lit("0")), 6, "0")
    seconds = (F.coalesce(part(6), F.lit(0)) + fraction.try_cast("int") / F.lit(1_000_000)).cast("decimal(16,6)")
    day_first, year_first = value.rlike(DAY_FIRST), value.rlike(YEAR_FIRST)
    make = lambda y, m, d: F.try_make_timestamp_ntz(y, m, d, part(4), part(5), seconds)
    return F.when(day_first, make(year(3), part(2), part(1))).when(year_first, make(part(1), part(2), part(3))).when(value.rlike(r"^\d{4}-\d{2}-\d{2}([T ]|$)"), value.try_cast("timestamp_ntz"))


def clock_texts(whole: Column | None, day: Column | None = None, time: Column | None = None) -> list[Column]:
    """The texts that a time is looked for in: one text, and a day and a time of day."""
    out = [F.trim(whole)] if whole is not None else []
    return out + ([F.concat(F.trim(day), F.lit(" "), F.trim(time))] if day is not None and time is not None else [])


def first_time(texts: list[tuple[Column, Column]]) -> Column:
    """Wall-clock time of the first of ``texts``, each with its ``clock_parts``, that is one."""
    return F.coalesce(*[_wall_clock(*t) for t in texts]) if texts else F.lit(None).cast("timestamp_ntz")


def timestamp(whole: Column | None, day: Column | None = None, time: Column | None = None) -> Column:
    """Wall-clock time of one text, or else of a day and a time of day; null if neither is one."""
    return first_time([(t, clock_parts(t)) for t in clock_texts(whole, day, time)])


def aggressor(c: Column) -> Column:
    """BUY is tested before SELL; RLP, undefined and unknown sides are NONE."""
    return side(side_text(c))


def side_text(c: Column) -> Column:
    return F.upper(header_column(F.coalesce(c, F.lit(""))))


def side(v: Column) -> Column:
    return F.when(v.isin("BUY", "C", "B", "BUYER") | v.contains("COMPRA"), "BUY").when(v.isin("SELL", "V", "S", "SELLER") | v.contains("VENDA") | v.contains("VENDEDOR"), "SELL").otherwise("NONE")


def to_ticks(price: Column, tick: float) -> Column:
    """Half-up number of ticks, null if the price is no multiple of the tick (within 1e-6)."""
    ratio = price / F.lit(str(tick)).cast("decimal(18,8)")
    ticks = F.round(ratio, 0)
    return F.when(F.abs(ratio - ticks) <= 1e-6, ticks.cast("long"))


def to_price(ticks: Column, tick: float) -> Column:
    """The price of a number of ticks, rounded to 10 places."""
    return F.round(ticks.cast("double") * F.lit(float(tick)), 10)


def whole_number(c: Column, number=generic_number) -> Column:
    n = number(c)
    return F.when((n >= 0) & (n == F.floor(n)), n.cast("long"))
