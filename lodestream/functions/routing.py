"""Question routing as column expressions: language, time range, places, route."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns of the rules.
HINGLISH = "kya hai hain ka ki ke mein me kitne kitna kaise kab kaun batao bataiye hota hoti tha thi aur"
CITIES = {"Delhi": "दिल्ली", "Kanpur": "कानपुर", "Lucknow": "लखनऊ", "Mumbai": "मुंबई"}
DOMAIN = r"\b(air|aqi|pollut\w*|pm ?2\.?5|pm ?10|grap|ncap|naaqs|caqm|cpcb|smog|stubble|dust|emission\w*|ozone|no2|so2|clean air|monitoring|kiln|c&d|construction|vehicle|bs-?\w+|puc\w*|swachh vayu)\b|वायु|प्रदूषण|हवा|एक्यूआई|ग्रैप"
DATA = r"\b(average|mean|median|how many days|number of days|days (?:was|were|did)|highest|lowest|maximum|minimum|worst|best|trend|compare[ds]?|ranked|rank|most polluted|was the aqi|aqi was|aqi on|aqi in|reading|recorded|kitne din|last (?:winter|month|year))\b|कितने दिन|औसत"
SHOPPING = r"\b(buy|purchase|price|cost of|brand|recommend (?:a|an|me)|which (?:mask|purifier)|best (?:mask|purifier)|recipe|movie|cricket|stock)\b"
POLICY = r"\b(rule|rules|require\w*|stage|standard|limit|act|direction|order|plan|guideline\w*|measure\w*|ban\w*|penalt\w*|fine|target|schedule|mandat\w*|permitted|allowed|restriction\w*|what does|under (?:the )?\w+|according to|section|commission)\b|नियम|लक्ष्य|मानक|चरण"
PAST = r"\b(previous(ly)?|earlier|older|old|superseded|history|historical|used to|before the (revision|amendment)|original(ly)?|first version|(19|20)\d\d)\b|पहले|पुरान"
MONTHS = "january february march april may june july august september october november december jan feb mar apr jun jul aug sep oct nov dec"
UNICODE, CASELESS = "(?U)", "(?iU)"


def language(q: Column) -> Column:
    """hi with any Devanagari letter, hinglish with two Hinglish words or more (repeats count), else en."""
    found = F.size(F.regexp_extract_all(F.lower(q), F.lit(rf"{UNICODE}\b({HINGLISH.replace(' ', '|')})\b"), F.lit(0)))
    return F.when(q.rlike("[\\u0900-\\u097F]"), "hi").when(found >= 2, "hinglish").otherwise("en")


def wants_history(q: Column) -> Column:
    return q.rlike(CASELESS + PAST)


def time_range(q: Column) -> Column:
    """'YYYY-MM-DD/YYYY-MM-DD' of a winter, a month or a year in the question, in this order; null without one."""
    s = F.lower(q)
    winter = F.regexp_extract(s, r"winter (?:of )?(\d{4})\s*[-–/]\s*(\d{2,4})", 1)
    month_at = rf"\b({MONTHS.replace(' ', '|')})\.? (\d{{4}})\b"
    month, year_of = F.regexp_extract(s, month_at, 1), F.regexp_extract(s, month_at, 2)
    year = F.regexp_extract(s, r"\b(20\d\d)\b", 1)
    first = F.try_to_date(F.concat_ws("-", year_of, F.lpad(_month_number(month).cast("string"), 2, "0"), F.lit("01")))
    winter_year = winter.try_cast("int")
    winter_end = F.last_day(F.try_to_date(F.concat((winter_year + 1).cast("string"), F.lit("-02-01"))))
    return (
        F.when(winter != "", F.concat(winter, F.lit("-11-01/"), winter_end.cast("string")))
        .when(month != "", F.concat(first.cast("string"), F.lit("/"), F.last_day(first).cast("string")))
        .when(year != "", F.concat(year, F.lit("-01-01/"), year, F.lit("-12-31")))
    )


def _month_number(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, x in reversed(list(enumerate(MONTHS.split()[:12], 1))):
        out = F.when(F.substring(name, 1, 3) == x[:3], k).otherwise(out)
    return out


def well_formed_range(c: Column) -> Column:
    """The range, or null where it isn't two ISO dates."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$"), c)


def cities(q: Column, names: dict[str, str] = CITIES) -> Column:
    """The cities a question names, in the order of the list."""
    hits = [F.when(q.rlike(rf"{CASELESS}\b{name}\b") | q.contains(hindi), F.lit(name)) for name, hindi in names.items()]
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def route(q: Column, names: dict[str, str] = CITIES) -> Column:
    """policy, data, mixed or out_of_scope; shopping comes first, then the domain, policy is the default."""
    data, policy = q.rlike(CASELESS + DATA), q.rlike(CASELESS + POLICY)
    inside = q.rlike(CASELESS + DOMAIN) | ((F.size(cities(q, names)) > 0) & (data | policy))
    return F.when(q.rlike(CASELESS + SHOPPING) | ~inside, "out_of_scope").when(data & policy, "mixed").when(data, "data").otherwise("policy")


def routed(q: Column) -> Column:
    """The router's whole result as a struct."""
    r = route(q)
    return F.struct(
        r.alias("route"), language(q).alias("language"), cities(q).alias("cities"), time_range(q).alias("time_range"),
        F.when(r.isin("policy", "mixed"), q).alias("policy_subquery"), F.when(r.isin("data", "mixed"), q).alias("data_subquery"),
    )
