"""Columns out of text: missing values, numbers, odds, votes, form, dates, links, sets and labelled replies.

All are column expressions; none raises on text of another shape, which gives null or the default named.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What links name a sport by, in the order of the tests.
SPORT_PATHS = {
    "football": ("pilka-nozna", "football", "soccer"),
    "basketball": ("koszykowka", "basketball"),
    "volleyball": ("siatkowka", "volleyball"),
    "handball": ("pilka-reczna", "handball"),
    "rugby": ("rugby",),
    "hockey": ("hokej", "hockey", "ice-hockey"),
    "tennis": ("tenis", "tennis"),
}
SPORT_WORD_ORDER = ("football", "basketball", "volleyball", "tennis", "handball", "rugby", "hockey")
# Words that tell a court's surface.
SURFACE_WORDS = {
    "clay": ("clay", "ziemia", "antuka", "roland garros", "monte carlo", "rome", "madrid"),
    "grass": ("grass", "trawa", "wimbledon", "halle", "queens"),
    "hard": ("hard", "twarda", "us open", "australian open", "indian wells", "miami"),
}
# Parts of a link that are never an event's id, though of its shape.
NO_EVENT = (
    "szczegoly", "statystyki", "ogolem", "overall", "wyniki", "results", "lineup", "koszykowka", "siatkowka",
    "football", "basketball", "volleyball", "handball", "hockey", "tennis",
)
RECOMMENDATIONS = ("HIGH", "MEDIUM", "LOW", "SKIP")


def missing(c: Column) -> Column:
    """Whether text stands for nothing: null, blank, nan or none in any case."""
    return c.isNull() | (F.trim(c) == "") | F.lower(c).isin("nan", "none")


def number(c: Column, default: float = 0.0) -> Column:
    """Text as a double; the default where it is missing, no number or NaN."""
    got = F.when(~missing(c), c.try_cast("double"))
    return F.when(got.isNull() | F.isnan(got), F.lit(default)).otherwise(got)


def shown_odds(c: Column) -> Column:
    """Odds with two decimals; a dash where there are none above 0."""
    value = number(c)
    return F.when(value > 0, F.format_string("%.2f", value)).otherwise("—")


def decimal_comma(c: Column) -> Column:
    """The first number with decimals after a comma or point."""
    return F.replace(F.nullif(F.regexp_extract(c, r"(\d+[.,]\d+)", 1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def fractional(c: Column) -> Column:
    """Odds a/b as decimal ones, a/b + 1, or a plain number; above 1 only, to two decimals."""
    parts = F.split(c, "/")
    over, under = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    got = F.when(F.size(parts) == 2, over / F.nullif(under, F.lit(0.0)) + 1).when(F.size(parts) == 1, c.try_cast("double"))
    return F.when((got > 1) & ~F.isnan(got), F.round(got, 2))


def votes(c: Column) -> Column:
    """The count after 'Total votes:', with k or m for thousands or millions; null without one."""
    found = lambda i: F.regexp_extract(c, r"Total votes:\s*([\d.,]+)\s*([kKmM])?", i)
    value = F.coalesce(F.replace(F.nullif(found(1), F.lit("")), F.lit(","), F.lit(".")).try_cast("double"), F.replace(F.nullif(found(1), F.lit("")), F.lit("."), F.lit("")).try_cast("double"), F.when(found(1) != "", 0.0))
    unit = F.lower(found(2))
    return (value * F.when(unit == "k", 1000).when(unit == "m", 1_000_000).otherwise(1)).cast("long")


def shown_votes(n: Column) -> Column:
    """A count with k from a thousand and M from a million on, to one decimal."""
    return F.when(n >= 1_000_000, F.format_string("%.1fM", n / 1_000_000)).when(n >= 1000, F.format_string("%.1fk", n / 1000)).otherwise(n.cast("string"))


def form_list(c: Column) -> Column:
    """Results of text in any of five shapes: a written list, or letters parted by hyphens, commas, blanks or semicolons, or not parted.
    Missing text or another shape: an empty array."""
    text = F.trim(c)
    filled = lambda items: F.filter(F.transform(items, lambda x: F.upper(F.trim(x))), lambda x: x != "")
    out = F.when(missing(c), F.array().cast("array<string>")).when(text.startswith("[") & text.endswith("]"), filled(F.split(F.regexp_replace(text, r"[\[\]'\"]", ""), ",")))
    for mark in ("-", ",", " ", ";"):
        out = out.when(text.contains(mark), filled(F.split(text, mark)))
    return out.when(text.rlike("^[WLDwld]+$"), filled(F.split(text, ""))).otherwise(F.array().cast("array<string>"))


def form_marks(form: Column) -> Column:
    """Results with a mark behind each, parted by blanks."""
    marked = lambda r: F.concat(r, F.when(r == "W", "✅").when(r == "L", "❌").when(r == "D", "🟡").otherwise(""))
    return F.array_join(F.transform(form, marked), " ")


def form_points(form: Column) -> Column:
    """Results as numbers: 3 for a win, 1 for a draw, else 0."""
    return F.transform(form, lambda r: F.when(r == "W", 3).when(r == "D", 1).otherwise(0))


def form_score(form: Column) -> Column:
    """Points of ten, as '7.3/10'; N/A without results."""
    points = F.aggregate(form_points(form), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(form) == 0, "N/A").otherwise(F.format_string("%.1f/10", F.round(points / (F.size(form) * 3) * 10, 1)))


def padded_form(form: Column, size: int = 5) -> Column:
    """Results filled up to `size`: by wins where wins are more than losses, else by losses; none at all: WWWLL."""
    count = lambda r: F.size(F.filter(form, lambda x: x == r))
    fill = F.when(count("W") > count("L"), "W").otherwise("L")
    return F.when(F.size(form) == 0, F.array(*map(F.lit, "WWWLL"))).otherwise(F.slice(F.concat(form, F.array_repeat(fill, size)), 1, size))


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _century(year: Column, last: int) -> Column:
    """Two digits as a year: up to `last` of 2000, above it of 1900; four digits stay."""
    y = year.try_cast("int")
    return F.when(F.length(year) == 2, y + F.when(y <= last, 2000).otherwise(1900)).otherwise(y).cast("string")


def dotted_day(c: Column) -> Column:
    """The date dd.MM.yy or dd.MM.yyyy inside text; years up to 50 are of 2000."""
    part = lambda i: F.regexp_extract(c, r"(\d{2})\.(\d{2})\.(\d{4}|\d{2})", i)
    return F.when(part(1) != "", _day(_century(part(3), 50), part(2), part(1)))


def any_day(c: Column) -> Column:
    """Text that is a date d.M.yy (years up to 68 are of 2000), d.M.yyyy or yyyy-M-d and nothing else."""
    dotted, iso = r"^(\d{1,2})\.(\d{1,2})\.(\d{4}|\d{2})$", r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
    part = lambda p, i: F.regexp_extract(c, p, i)
    return F.when(c.rlike(dotted), _day(_century(part(dotted, 3), 68), part(dotted, 2), part(dotted, 1))).when(c.rlike(iso), _day(part(iso, 1), part(iso, 2), part(iso, 3)))


def clock(c: Column, default: str = "99:99") -> Column:
    """The first H:mm or HH:mm inside text."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(\d{1,2}:\d{2})", 1), F.lit("")), F.lit(default))


def friendly_day(day: Column, today: Column) -> Column:
    """Today, Tomorrow, or as 'Mon, 12 Feb 2026'."""
    return F.when(day == today, "Today").when(day == F.date_add(today, 1), "Tomorrow").otherwise(F.date_format(day, "EEE, d MMM yyyy"))


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def sport_of_path(url: Column) -> Column:
    """The sport by a whole part of a link; football where none tells."""
    low, out = F.lower(url), F.when(F.lit(False), "")
    for sport, words in SPORT_PATHS.items():
        out = out.when(any_of(low, tuple(f"/{w}/" for w in words)), sport)
    return out.otherwise("football")


def sport_of_words(url: Column) -> Column:
    """The sport by a word anywhere in a link; unknown where none tells."""
    low, out = F.lower(url), F.when(F.lit(False), "")
    for sport in SPORT_WORD_ORDER:
        out = out.when(any_of(low, SPORT_PATHS[sport]), sport)
    return out.otherwise("unknown")


def surface_of(text: Column) -> Column:
    """The court by words of text; null where none tells."""
    low, out = F.lower(text), F.when(F.lit(False), "")
    for surface, words in SURFACE_WORDS.items():
        out = out.when(any_of(low, words), surface)
    return out


def event_id(url: Column) -> Column:
    """The event's id in a link: after mid=, after #id/, or the last part of six to ten letters and digits that is no common word."""
    link = F.trim(url)
    found = lambda p: F.nullif(F.regexp_extract(link, p, 1), F.lit(""))
    parts = F.filter(F.split(link, "/"), lambda p: p.rlike("^[a-zA-Z0-9]{6,10}$") & ~F.lower(p).isin(*NO_EVENT))
    return F.coalesce(found("[?&]mid=([a-zA-Z0-9]+)"), found("#id/([a-zA-Z0-9]+)"), F.try_element_at(parts, F.lit(-1)))


def sets_won(score: Column) -> Column:
    """Sets from games, '6-4, 7-5' as '2-0'; sets stay as they are; null without either. A tied set counts for the second player."""
    games = F.regexp_extract_all(score, F.lit(r"(\d+[:\-–—]\d+)"), 1)
    side = lambda g, i: F.element_at(F.split(g, r"[:\-–—]"), i).cast("int")
    first = F.size(F.filter(games, lambda g: side(g, 1) > side(g, 2)))
    return F.when(score.rlike(r"^\d-\d$"), score).when(F.size(games) > 0, F.concat_ws("-", first.cast("string"), (F.size(games) - first).cast("string")))


def reply_fields(text: Column) -> Column:
    """(prediction, confidence, reasoning, recommendation) of a labelled reply, the last line of each label; a reply without a prediction
    is one itself, by its first 200 characters, with confidence 50 and MEDIUM. Null or empty text: no prediction, 0 and SKIP."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))

    def last(label: str, keep=None, change=None) -> Column:
        after = F.transform(F.filter(lines, lambda x: x.startswith(label)), lambda x: F.trim(F.replace(x, F.lit(label), F.lit(""))))
        after = F.transform(after, change) if change else after
        return F.try_element_at(F.filter(after, keep) if keep else after, F.lit(-1))

    prediction = F.nullif(last("PREDICTION:"), F.lit(""))
    confidence = last("CONFIDENCE:", lambda x: x != "", lambda x: F.regexp_extract(x, r"(\d+)", 1)).try_cast("int")
    recommendation = last("RECOMMENDATION:", lambda x: x.isin(*RECOMMENDATIONS), F.upper)
    labelled = F.struct(F.coalesce(prediction, F.lit("")).alias("prediction"), F.coalesce(confidence, F.lit(0)).alias("confidence"), F.coalesce(last("REASONING:"), F.lit("")).alias("reasoning"), F.coalesce(recommendation, F.lit("SKIP")).alias("recommendation"))
    whole = F.struct(F.substring(text, 1, 200).alias("prediction"), F.lit(50).alias("confidence"), text.alias("reasoning"), F.lit("MEDIUM").alias("recommendation"))
    return F.when(prediction.isNull() & (text != ""), whole).otherwise(labelled)


def shortened(text: Column, n: int = 300) -> Column:
    return F.substring(text, 1, n)


def pick_of(home: Column, draw: Column, away: Column) -> Column:
    """(pick, probability): the likeliest of 1, X and 2, the first of equal ones; without a draw 1 only if it is the likelier."""
    three = F.struct(F.when((home >= draw) & (home >= away), "1").when(draw >= away, "X").otherwise("2").alias("pick"), F.greatest(home, draw, away).cast("double").alias("probability"))
    two = F.struct(F.when(home > away, "1").otherwise("2").alias("pick"), F.greatest(home, away).cast("double").alias("probability"))
    return F.when(home.isNotNull() & draw.isNotNull() & away.isNotNull(), three).when(home.isNotNull() & away.isNotNull(), two)


def over_under(average: Column, sport: Column) -> Column:
    """Over or under 2.5 goals in football, 5.5 in hockey; null elsewhere."""
    line = F.when(sport.isin("football", "soccer"), "2.5").when(sport.isin("hockey", "ice-hockey"), "5.5")
    return F.when(average.isNotNull(), F.concat(F.when(average > line.cast("double"), "Over ").otherwise("Under "), line))


def both_score(exact: Column, sport: Column) -> Column:
    """Yes or No: whether both sides score in 'a-b'; football and hockey only."""
    parts = F.split(exact, "-")
    goals = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("int")
    known = (F.size(parts) == 2) & goals(0).isNotNull() & goals(1).isNotNull() & sport.isin("football", "soccer", "hockey", "ice-hockey")
    return F.when(known, F.when((goals(0) > 0) & (goals(1) > 0), "Yes").otherwise("No"))


def confidence_tier(c: Column) -> Column:
    return F.when(c >= 85, "Very High").when(c >= 70, "High").when(c >= 55, "Medium").otherwise("Low")


def title_teams(title: Column) -> Column:
    """(home, away) from a page's title: what stands before and behind the first dash, bar, vs or v between blanks; null without one."""
    parts = F.split(title, r"\s[-–—|]\s|\svs\s|\sv\s")
    return F.when(F.size(parts) >= 2, F.struct(F.trim(F.get(parts, 0)).alias("home"), F.trim(F.get(parts, 1)).alias("away")))


def lookup_key(home: Column, away: Column, sport: Column, day: Column | None = None) -> Column:
    """What a lookup of a match is remembered by: without a day a digest of names in lower case and sport, else sport, names and day."""
    if day is None:
        return F.md5(F.concat(F.lower(home), F.lit("|"), F.lower(away), F.lit("|"), sport))
    return F.concat(sport, F.lit("|"), F.trim(F.lower(home)), F.lit("|"), F.trim(F.lower(away)), F.lit("|"), day.cast("string"))


def initials(name: Column) -> Column:
    """Two capitals of a team's name: of its first two words, else of its one word; ?? without a name. A club's word is a word."""
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    two = F.when(F.size(words) == 1, F.substring(F.get(words, 0), 1, 2)).otherwise(F.concat(F.substring(F.get(words, 0), 1, 1), F.substring(F.get(words, 1), 1, 1)))
    return F.when(F.coalesce(name, F.lit("")) == "", "??").otherwise(F.upper(two))


def hue(name: Column) -> Column:
    """A colour between 0 and 359 that a name always has."""
    return F.pmod(F.xxhash64(name), F.lit(360)).cast("int")
