"""Check digits and structural checks of identifiers, as Catalyst expressions over strings of the right shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths of the account numbers of some countries; letters of a Medicare beneficiary id.
IBAN_LENGTHS = {"TR": 26, "DE": 22, "GB": 22, "FR": 27, "NL": 18, "CH": 21}
MBI_LETTERS = "ACDEFGHJKMNPQRTUVWXY"


def _digit(c: Column, i: int) -> Column:
    return F.substring(c, i + 1, 1).cast("int")


def _sum(c: Column, places) -> Column:
    total = F.lit(0)
    for i in places:
        total = total + _digit(c, i)
    return total


def tckn(c: Column) -> Column:
    """Eleven digits, not led by 0: the tenth and the eleventh are check digits."""
    tenth = F.pmod(_sum(c, range(0, 9, 2)) * 7 - _sum(c, range(1, 8, 2)), F.lit(10))
    ok = (tenth == _digit(c, 9)) & (_sum(c, range(10)) % 10 == _digit(c, 10))
    return F.when(c.rlike(r"^[1-9][0-9]{10}$"), ok).otherwise(False)


def vkn(c: Column) -> Column:
    """Ten digits with the tax office's check digit."""
    total = F.lit(0)
    for i in range(9):
        t = (_digit(c, i) + (9 - i)) % 10
        q = t * (2 ** (9 - i)) % 9
        total = total + F.when(t == 0, 0).when(q == 0, 9).otherwise(q)
    return F.when(c.rlike(r"^[0-9]{10}$"), (10 - total % 10) % 10 == _digit(c, 9)).otherwise(False)


def iban(c: Column) -> Column:
    """Remainder 97 of the rearranged, compact account number; the length where the country is known."""
    moved = F.concat(F.substring(c, 5, 40), F.substring(c, 1, 4))
    value = lambda ch: F.when(ch.rlike("[0-9]"), ch.cast("int")).otherwise(F.ascii(ch) - 55)
    rest = F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), lambda r, ch: F.when(value(ch) > 9, r * 100 + value(ch)).otherwise(r * 10 + value(ch)) % 97)
    country = F.substring(c, 1, 2)
    length_ok = F.lit(True)
    for code, size in IBAN_LENGTHS.items():
        length_ok = F.when(country == code, F.length(c) == size).otherwise(length_ok)
    return F.when(c.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$"), length_ok & (rest == 1)).otherwise(False)


def luhn(c: Column) -> Column:
    return F.call_function("luhn_check", c)


def card_scheme(c: Column) -> Column:
    """The scheme that a card number's first digits and length stand for; null if none."""
    n = F.length(c)
    return (
        F.when(c.rlike("^4") & n.isin(13, 16, 19), "visa")
        .when(c.rlike("^(5[1-5]|22[2-9]|2[3-6][0-9]|27[01]|2720)") & (n == 16), "mastercard")
        .when(c.rlike("^3[47]") & (n == 15), "amex")
        .when(c.rlike("^9792") & n.isin(16, 19), "troy")
        .when(c.rlike("^62") & n.between(16, 19), "unionpay")
        .when(c.rlike("^(6011|65|64[4-9])") & (n == 16), "discover")
    )


def gs1(c: Column) -> Column:
    """8 to 18 digits: weights 3 and 1 from the right, check digit last."""
    body = F.transform(F.slice(F.reverse(F.filter(F.split(c, ""), lambda x: x != "")), 2, 17), lambda x, i: x.cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(body, F.lit(0), lambda a, b: a + b)
    return F.when(c.rlike(r"^[0-9]{8,18}$"), (10 - total % 10) % 10 == F.substring(c, -1, 1).cast("int")).otherwise(False)


def ssn(c: Column) -> Column:
    """Nine digits with an area, group and serial that can be issued."""
    return c.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")


def mbi(c: Column) -> Column:
    """The eleven places of a Medicare beneficiary id (without dashes)."""
    a = f"[{MBI_LETTERS}]"
    return F.upper(c).rlike(f"^[1-9]{a}[{MBI_LETTERS}0-9][0-9]{a}[{MBI_LETTERS}0-9][0-9]{a}{a}[0-9][0-9]$")


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """Whether the numbers are a day of the Gregorian calendar, from year 1 on."""
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    limit = F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    return F.coalesce((year >= 1) & month.between(1, 12) & (day >= 1) & (day <= limit), F.lit(False))
