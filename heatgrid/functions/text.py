"""Name keys, advisory text and alert-document columns."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from heatgrid.functions.base import col

# Label tables of the alerting standard and the digit set: fixed values.
SEVERITY = {"Watch": "Moderate", "Warning": "Severe", "Emergency": "Extreme"}
RESPONSE = {"Watch": "Prepare", "Warning": "Avoid", "Emergency": "Shelter"}
LOCAL_DIGITS = {"or": "୦୧୨୩୪୫୬୭୮୯"}
ASCII_DIGITS = "0123456789"
LANGUAGE_TAGS = {"en": "en-IN", "hi": "hi-IN", "or": "or-IN"}


def normalise_name(c) -> Column:
    """Upper-case, dashes and dots to blanks, single blanks."""
    return F.regexp_replace(F.translate(F.upper(F.trim(col(c))), "-.", "  "), r"\s+", " ")


def first_token(c) -> Column:
    """Left part of ``A_B`` or ``A/B``."""
    return normalise_name(F.element_at(F.split(col(c), "[_/]"), 1))


def name_aliases(*columns) -> Column:
    """Distinct normalised spellings, including alternates in parentheses."""
    plain = F.array(*[normalise_name(c) for c in columns])
    inner = F.flatten(
        F.array(*[F.transform(F.regexp_extract_all(col(c), F.lit(r"\(([^)]+)\)"), F.lit(1)), normalise_name) for c in columns])
    )
    return F.array_distinct(F.array_compact(F.concat(plain, inner)))


def localise_digits(c, language) -> Column:
    out = col(c)
    lang = col(language)
    for code, digits in LOCAL_DIGITS.items():
        out = F.when(lang == code, F.translate(col(c), ASCII_DIGITS, digits)).otherwise(out)
    return out


def fill_template(template, values: dict[str, Column]) -> Column:
    """Replace every ``{key}``; a missing value becomes the empty string."""
    return reduce(
        lambda acc, kv: F.replace(acc, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))),
        values.items(),
        col(template),
    )


def day_phrase(lead, date, language, today, tomorrow, on_date) -> Column:
    shown = localise_digits(F.coalesce(col(date).cast("string"), F.lit("")), language)
    return (
        F.when(col(lead) == 0, col(today))
        .when(col(lead) == 1, col(tomorrow))
        .otherwise(F.replace(col(on_date), F.lit("{date}"), shown))
    )


def fixed(c, digits: int) -> Column:
    """Number as text with a fixed count of decimals at most, NULL kept."""
    r = F.round(col(c), digits)
    return F.when(r == F.floor(r), F.format_string("%.0f", r)).otherwise(F.format_string(f"%.{digits}f", r))


def mask_address(c) -> Column:
    a = col(c)
    hidden = F.greatest(F.length(a) - 4, F.lit(0))
    return F.concat(F.repeat(F.lit("*"), hidden), F.substring(a, hidden + 1, F.lit(4)))


def xml_escape(c) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")]
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, F.coalesce(col(c).cast("string"), F.lit("")))


def alert_id(prefix: str, scope, place, since) -> Column:
    return F.concat_ws("-", F.lit(prefix), col(scope), col(place).cast("string"), col(since).cast("string"))


def _label(c, table: dict[str, str], default: str) -> Column:
    chain = F
    for k, v in table.items():
        chain = chain.when(col(c) == k, F.lit(v))
    return chain.otherwise(F.lit(default))


def severity(level) -> Column:
    return _label(level, SEVERITY, "Minor")


def response_type(level) -> Column:
    return _label(level, RESPONSE, "Monitor")


def language_tag(language) -> Column:
    return _label(language, LANGUAGE_TAGS, "en-IN")


def urgency(lead) -> Column:
    return F.when(col(lead) <= 0, "Immediate").when(col(lead) <= 2, "Expected").otherwise("Future")


def certainty(lead, probability) -> Column:
    p = F.coalesce(col(probability), F.lit(0.0))
    return F.when(col(lead) <= 0, "Observed").when(p >= 0.5, "Likely").otherwise("Possible")


def polygon_text(ring) -> Column:
    """``lat,lon`` pairs separated by blanks, closed."""
    r = col(ring)
    pair = lambda p: F.format_string("%.5f,%.5f", p[1], p[0])
    points = F.transform(r, pair)
    closed = F.when(F.element_at(points, 1) == F.element_at(points, -1), points).otherwise(
        F.concat(points, F.slice(points, 1, 1))
    )
    return F.array_join(closed, " ")


def explained_horizon(lead) -> Column:
    """Nearest explained horizon of a lead; none for the observed day."""
    k = col(lead)
    return F.when(k == 0, F.lit(None).cast("int")).when(k <= 1, 1).when(k <= 3, 3).otherwise(5)


# Sentences of the explanations: fixed values. Blanks in braces take the named figures.
SENTENCES = {
    "driver": "{label} ({sign}{points} pts)",
    "no_driver": "seasonal conditions",
    "observed": "Today's observed stress in {name} is {htsi} ({band}).",
    "forecast": "The D+{lead} forecast for {name} (HTSI {htsi}, {band}) is driven by {drivers}.",
    "heat_island": "Urban heat island adds {points} HTSI points (built-up fraction {built_up}%).",
    "risk": "Expected {expected} deaths/day at baseline x relative risk {rr} (vulnerability x{multiplier} on the log scale) = {excess} excess.",
}


def sentence(key: str, **parts: Column) -> Column:
    """A sentence with its blanks filled; NULL if one of the parts is."""
    pieces = re.split(r"\{(\w+)\}", SENTENCES[key])
    return F.concat(*[parts[x] if i % 2 else F.lit(x) for i, x in enumerate(pieces) if x])


def driver_phrases(drivers, n: int = 3) -> Column:
    """``label (+x.x pts)`` of the first drivers, comma separated."""

    def phrase(d: Column) -> Column:
        sign = F.when(d["contribution"] >= 0, F.lit("+")).otherwise(F.lit(""))
        return sentence("driver", label=d["label"], sign=sign, points=F.format_string("%.1f", d["contribution"]))

    return F.array_join(F.transform(F.slice(col(drivers), 1, n), phrase), ", ")


def forecast_sentence(name, lead, htsi, band, drivers) -> Column:
    parts = F.coalesce(F.nullif(driver_phrases(drivers), F.lit("")), F.lit(SENTENCES["no_driver"]))
    given = {"name": col(name), "htsi": fixed(htsi, 1), "band": col(band)}
    ahead = sentence("forecast", lead=col(lead).cast("string"), drivers=parts, **given)
    return F.when(col(lead) == 0, sentence("observed", **given)).otherwise(ahead)


def _places(value, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", col(value))


def heat_island_sentence(points, built_up) -> Column:
    return sentence("heat_island", points=_places(points, 2), built_up=F.format_string("%d", F.round(col(built_up) * 100).cast("int")))


def risk_sentence(expected, rr, multiplier, excess) -> Column:
    return sentence("risk", expected=_places(expected, 2), rr=_places(rr, 3), multiplier=_places(multiplier, 3), excess=_places(excess, 3))
