"""Text cleaning and counting as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's ``str`` methods have it; Java's ``\s`` and Spark's ``trim`` know less.
WHITE = r"[\t-\r\x1C-\x1F\x85\p{Z}]"

# English function words that word frequencies leave out.
STOP_WORDS = tuple(
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does "
    "doing don down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its "
    "itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some "
    "such t than that the their theirs them themselves then there these they this those through to too under until up very was we were what "
    "when where which while who whom why will with you your yours yourself yourselves "
    "ain aren aren't couldn couldn't d didn didn't doesn doesn't don't hadn hadn't hasn hasn't haven haven't isn isn't it's ll m ma mightn "
    "mightn't mustn mustn't needn needn't o re s shan shan't she's should've shouldn shouldn't t that'll ve wasn wasn't weren weren't won won't "
    "wouldn wouldn't y you'd you'll you're you've".split()
)


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_column(text), rf"^{WHITE}+|{WHITE}+$", "")


def strip_right(text: Column | str) -> Column:
    return F.regexp_replace(_column(text), rf"{WHITE}+$", "")


def is_blank(text: Column | str) -> Column:
    """True for null, empty and white space only."""
    return F.length(strip(F.coalesce(_column(text), F.lit("")))) == 0


def clean_text(text: Column | str) -> Column:
    """Joins words hyphenated at a line end, drops one-digit footnote marks at a line start, makes white space single."""
    joined = F.replace(_column(text), F.lit("-\n"), F.lit(""))
    unmarked = F.regexp_replace(joined, rf"\n[1-9]{WHITE}", " ")
    return F.trim(F.regexp_replace(unmarked, rf"{WHITE}+", " "))


def clean_alpha(text: Column | str) -> Column:
    """Keeps ASCII letters and apostrophes, single spaces between them."""
    joined = F.replace(F.replace(_column(text), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    letters = F.regexp_replace(joined, rf"[^a-zA-Z'\t-\r\x1C-\x1F\x85\p{{Z}}]", " ")
    return F.trim(F.regexp_replace(letters, rf"{WHITE}+", " "))


def token_count(cleaned: Column | str) -> Column:
    """Words of a cleaned text; none in an empty one."""
    c = _column(cleaned)
    return F.when(c == "", F.lit(0)).otherwise(F.size(F.split(c, " ", -1)))


def last_segment(url: Column | str) -> Column:
    return F.substring_index(_column(url), "/", -1)


def percent_encoded(text: Column | str, keep: str = "/") -> Column:
    """As in the path of an address: a space is %20, and the characters in ``keep`` stay."""
    fixes = [("+", "%20"), ("%7E", "~"), *((f"%{ord(c):02X}", c) for c in keep)]
    return reduce(lambda x, fix: F.replace(x, F.lit(fix[0]), F.lit(fix[1])), fixes, F.replace(F.url_encode(_column(text)), F.lit("*"), F.lit("%2A")))


def preview(text: Column | str, n: int = 200) -> Column:
    return F.concat(F.substring(_column(text), 1, n), F.lit("..."))
