"""Text, number and date cleaning as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Accepted boolean spellings.
TRUE_WORDS = ["1", "true", "t", "yes", "y"]
FALSE_WORDS = ["0", "false", "f", "no", "n"]

# Tokens that stand for a missing value.
PLACEHOLDERS = ["na", "n/a", "null", "none", "unknown", "-", "--", "nan", ""]


# The Unicode white-space characters.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def clean_text(c: Column) -> Column:
    """Strip every kind of Unicode white space (plain trim keeps U+00A0); empty becomes NULL; case is kept.

    A character-set trim: it looks at the ends only and compiles, where a regular expression scans every value. The trim searches its
    whole set for both ends, so it is left out where both are visible ASCII characters, as in most values.
    """
    visible = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(visible, c).otherwise(F.nullif(F.btrim(c, F.lit(WHITE_SPACE)), F.lit("")))


def local_time(c: Column, zone: str = "Asia/Kolkata") -> Column:
    """Strictly parse a naive local timestamp (unpadded fields allowed) and move it to UTC."""
    return local_time_of(clean_text(c), zone)


def local_time_of(text: Column, zone: str = "Asia/Kolkata") -> Column:
    """local_time of a cleaned text. The shape is tested first, so a cast, which takes a fraction of a formatter's time, accepts no more than a pattern."""
    parsed = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$"), text.try_cast("timestamp"))
    return F.to_utc_timestamp(parsed, zone)


def money(c: Column) -> Column:
    """Decimal with two places, half-even; text that is not a finite number becomes NULL."""
    return money_of(clean_text(c))


def money_of(text: Column) -> Column:
    return F.bround(text.try_cast("decimal(38,10)"), 2).try_cast("decimal(12,2)")


def flag(c: Column) -> Column:
    return flag_of(F.lower(clean_text(c)))


def flag_of(word: Column) -> Column:
    return F.when(word.isin(TRUE_WORDS), F.lit(True)).when(word.isin(FALSE_WORDS), F.lit(False))


def grouped_number(c: Column) -> Column:
    """A number written with Indian digit grouping or non-breaking spaces."""
    return clean_text(F.regexp_replace(c, "[,\u00a0]", "")).try_cast("double")


def short_month(c: Column) -> Column:
    """`YY-Mon` to the first day of that month in 20YY; anything else is NULL."""
    text = clean_text(c)
    return F.when(text.rlike("^[0-9]{2}-[A-Za-z]{3}$"), F.try_to_date(F.concat(F.lit("20"), F.initcap(text)), "yyyy-MMM"))


def institution(c: Column) -> Column:
    """Institution name for matching: upper case, no LTD / LIMITED, no dots or commas, single spaces."""
    name = F.regexp_replace(F.upper(c), r"\bLTD\.?\b|\bLIMITED\b", "")
    return F.trim(F.regexp_replace(F.regexp_replace(name, r"[.,]", ""), r"\s+", " "))


def is_placeholder(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(PLACEHOLDERS)
