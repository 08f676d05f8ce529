"""Time, size, text and number functions as Column expressions."""

from pyspark.sql import functions as F
from pyspark.sql.column import Column

from revloom.functions.lookups import WEEKDAYS

DAY_MICROS = 86_400_000_000


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def age_days(start, end) -> Column:
    """Whole elapsed days, floored (elapsed time, not calendar days)."""
    micros = F.unix_micros(_col(end)) - F.unix_micros(_col(start))
    return F.floor(micros / F.lit(DAY_MICROS)).cast("long")


def format_date(value, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(_col(value), fmt)


def day_name(value) -> Column:
    return F.date_format(_col(value), "EEEE")


def weekday_number(name) -> Column:
    """Monday = 1 … Sunday = 7, from the English day name."""
    return F.array_position(F.array(*map(F.lit, WEEKDAYS)), _col(name)).cast("int")


def month_start(value) -> Column:
    return F.trunc(_col(value).cast("date"), "MM")


def human_size(size) -> Column:
    """Bytes as ``12.3KB``: base 1024, one decimal, up to TB."""
    b = _col(size).cast("double")

    def text(power, unit):
        # half to even first: the text format alone would round halves up
        return F.format_string(f"%.1f{unit}", F.bround(b / float(1024 ** power), 1))

    expr = F.when(b < 1024, text(0, "B"))
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        expr = expr.when(b < float(1024 ** (power + 1)), text(power, unit))
    return expr.otherwise(text(4, "TB"))


def content_preview(text, max_lines: int = 5, max_chars: int = 500) -> Column:
    """First lines of a text; null if empty, a note if it holds a NUL byte."""
    t = _col(text)
    lines = F.split(t, "\n")
    head = F.array_join(F.slice(lines, 1, max_lines), "\n")
    cut = F.when(F.length(head) > max_chars,
                 F.concat(F.substring(head, 1, max_chars), F.lit("..."))).otherwise(head)
    more = F.size(lines) - max_lines
    full = F.when(more > 0, F.concat(cut, F.lit("\n... ("), more.cast("string"),
                                     F.lit(" more lines)"))).otherwise(cut)
    return (F.when(t.isNull() | (t == ""), None)
            .when(F.contains(t, F.lit("\u0000")),
                  F.concat(F.lit("<binary file, "), F.length(t).cast("string"), F.lit(" bytes>")))
            .otherwise(full))


def trend_bar(value, top, width: int = 50) -> Column:
    """A bar of ``value / top * width`` blocks, rounded down."""
    share = F.try_divide(_col(value).cast("double"), _col(top)) * width
    return F.repeat(F.lit("█"), F.coalesce(F.floor(share), F.lit(0)).cast("int"))


def percent_text(value) -> Column:
    return F.format_string("%.2f%%", _col(value).cast("double"))


def ratio(a, b) -> Column:
    """``a / b`` as double, null where ``b`` is zero."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))
