"""Free-form dates to days since 1970-01-01 and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def days(text: Column) -> Column:
    """Y-M-D, Y/M/D or Y.M.D at the start, YYYYMMDD or YYYY alone, else a number taken as days; null if none of them."""
    t = F.trim(text)
    # a year, then month and day behind one kind of separator, or as four digits that end the text
    part = lambda *k: F.concat(*(F.regexp_extract(t, r"^(\d{4})(?:([-/.])(\d{1,2})\2(\d{1,2})|(\d{2})(\d{2})$)", i) for i in k)).try_cast("int")
    date = F.format_string("%04d-%02d-%02d", part(1), part(3, 5), part(4, 6)).try_cast("date")
    out = [F.when(part(1).isNotNull(), F.datediff(date, F.lit("1970-01-01").cast("date")))]
    year = F.regexp_extract(t, r"^(\d{4})$", 1).try_cast("int")
    out.append(F.when(year.isNotNull(), F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date"))))
    out.append(t.try_cast("double").try_cast("int"))
    return F.coalesce(*out)


def display(days_: Column, full: bool = False) -> Column:
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), days_), "yyyy-MM-dd" if full else "yyyy")


def first_year(text: Column) -> Column:
    """A date by the usual forms, else January of the first four digits."""
    forms = [F.try_to_timestamp(text, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "yyyy-MM", "yyyy")]
    year = F.regexp_extract(text, r"(\d{4})", 1).try_cast("int")
    return F.coalesce(*(f.cast("date") for f in forms), F.make_date(year, F.lit(1), F.lit(1)))
