"""Column expressions for names, cells, dates, money and methods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of contractor cells.
REVOKED = r"\[REVOKED\]"
MARKERS = r"\([^)]*\)"
ID = r"\((?:\[REVOKED\]\s*)?(\d+)\)"
FORMER = r"(?i)FORMERLY:?\s*([^)]*)"

# Status groups and their names, classes of procurement and their words (the first
# that fits), date formats, legal suffixes at a name's end.
STATUS = {
    "completed": ("completed", "complete", "done"),
    "on-going": ("on-going", "ongoing", "in progress", "in-progress"),
    "not yet started": ("not yet started", "not started", "pending"),
    "terminated": ("terminated", "cancelled", "canceled"),
    "suspended": ("suspended",),
}
METHODS = {
    "public_bidding": ("public bidding", "competitive bidding", "public bid"),
    "shopping": ("shopping", "small value procurement"),
    "negotiated": ("negotiated procurement", "negotiated", "direct contracting"),
    "limited_source": ("limited source bidding",),
    "direct_retail": ("direct retail purchase",),
    "repeat_order": ("repeat order",),
    "emergency": ("emergency purchase", "emergency"),
}
DATES = ("M/d/yyyy", "yyyy-M-d", "d-MMM-yy", "d-MMM-yyyy", "MMMM d, yyyy", "d MMMM yyyy")
SUFFIXES = (r"\bINC\.?$", r"\bCORP\.?$", r"\bCORPORATION$", r"\bCO\.?$", r"\bCOMPANY$", r"\bLTD\.?$", r"\bLIMITED$", r"\bLLC$", r"\bPTE\.?$", r"\bPVT\.?$", r"\b&\s*CO\.?$", r"\bAND\s*CO\.?$")
ACCENTS, PLAIN = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ", "aaaaaaeeeeiiiiooooouuuuncyy"


def null_if_blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def norm_name(c: Column) -> Column:
    """Upper-cased letters and digits of a name without its markers."""
    plain = F.regexp_replace(F.regexp_replace(c, REVOKED, " "), MARKERS, " ")
    return F.trim(F.upper(F.regexp_replace(plain, "[^A-Za-z0-9]+", " ")))


def clean_display(c: Column) -> Column:
    """A name as shown: no markers, single spaces, no stray punctuation at the ends."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, REVOKED, " "), MARKERS, " "), r"\s+", " ")
    return F.btrim(plain, F.lit(" /.-,"))


def contractor_cell(c: Column) -> Column:
    """array<struct<position, raw, id, revoked, former, display, norm>> of a cell of several firms."""
    parts = F.filter(F.transform(F.split(c, " / "), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(
        parts,
        lambda x, i: F.struct(
            i.alias("position"),
            x.alias("raw"),
            null_if_blank(F.regexp_extract(x, ID, 1)).alias("id"),
            x.rlike("(?i)" + REVOKED).alias("revoked"),
            null_if_blank(F.trim(F.regexp_extract(x, FORMER, 1))).alias("former"),
            clean_display(x).alias("display"),
            norm_name(x).alias("norm"),
        ),
    )


def money(c: Column) -> Column:
    """A double from text with currency signs and thousands; of a range its first part."""
    first = F.split(F.regexp_replace(c, r"[₱$,\s]", ""), "-").getItem(0)
    return null_if_blank(first).try_cast("double")


def number_or_zero(c: Column) -> Column:
    """A double; zero for what is no number."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def whole_number(c: Column) -> Column:
    """An integer by way of a double, null for what is none."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x.try_cast("bigint"))


def year_between(c: Column, first: int, last: int) -> Column:
    """A year inside a range, else null."""
    y = c.try_cast("int")
    return F.when(y.between(first, last), y)


def parsed_date(c: Column) -> Column:
    """A date by the first of the known formats that fits; two-digit years from 69 on are of the last century."""
    found = F.coalesce(*(F.try_to_date(F.trim(c), f) for f in DATES))
    return F.when((F.year(found) > 2068) & F.trim(c).rlike(r"-\d\d$"), F.add_months(found, -1200)).otherwise(found)


def status_group(c: Column) -> Column:
    """One of the status groups, else the trimmed lower-cased text, `unknown` for null."""
    low = F.lower(F.trim(c))
    out = low
    for group, names in STATUS.items():
        out = F.when(low.isin(list(names)), group).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def method_class(c: Column) -> Column:
    """The first procurement class of which the text contains a name; `other`, or `unknown` for null."""
    low, out = F.lower(F.trim(c)), F.lit("other")
    for name, words in reversed(METHODS.items()):
        out = F.when(reduce(lambda x, y: x | y, (low.contains(w) for w in words)), name).otherwise(out)
    return F.when(c.isNull(), "unknown").otherwise(out)


def company_name(c: Column) -> Column:
    """A contractor name in capitals without legal suffixes at its end and without punctuation."""
    short = reduce(lambda x, p: F.regexp_replace(x, p, ""), SUFFIXES, F.trim(F.upper(c)))
    return F.coalesce(F.trim(F.regexp_replace(F.regexp_replace(short, "[.,;:]", ""), r"\s+", " ")), F.lit(""))


#: Generation suffixes of persons' names, taken out in this order, and particles that are joined (fixed values).
GENERATIONS = (", JR.", ", SR.", ", III", ", II", ", IV", " JR.", " SR.", " III", " II", " IV")
PARTICLES = ((r"\bDE\s+LA\s+", "DELA "), (r"\bDE\s+LOS\s+", "DELOS "), (r"\bDE\s+LAS\s+", "DELAS "), (r"\bDEL\s+", "DEL "))


def person_name(c: Column) -> Column:
    """A person's name in capitals without generation suffixes, particles joined, letters of any script kept; empty for null."""
    bare = reduce(lambda x, s: F.replace(x, F.lit(s), F.lit("")), GENERATIONS, F.trim(F.upper(c)))
    joined = reduce(lambda x, p: F.regexp_replace(x, *p), PARTICLES, bare)
    return F.coalesce(F.trim(F.regexp_replace(joined, r"\s+", " ")), F.lit(""))


def surname(c: Column) -> Column:
    """What stands before a comma, else the last word; upper-cased."""
    bare = F.trim(F.regexp_replace(c, r"(?i)\b(jr|sr|ii|iii)\b\.?", ""))
    return F.upper(F.when(bare.contains(","), F.trim(F.split(bare, ",").getItem(0))).otherwise(F.element_at(F.split(bare, r"\s+"), -1)))


def search_form(c: Column) -> Column:
    """Text as searched: no accents, lower case, single spaces between letters and digits."""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), ACCENTS, PLAIN), "[^a-z0-9]+", " "))


def locality(c: Column) -> Column:
    """The last three comma-separated parts of an address, normalised, joined by slashes."""
    parts = F.filter(F.transform(F.split(c, ","), norm_name), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3), " / ")


def lucene_prefix(c: Column) -> Column:
    """A term with the query syntax's special characters escaped and a trailing star."""
    return F.concat(F.regexp_replace(c, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1"), F.lit("*"))


def pesos(c: Column) -> Column:
    """An amount in T, B, M or K with two digits."""
    one = lambda by, unit: F.concat(F.format_number(c / by, 2), F.lit(unit))
    return F.when(c >= 1e12, one(1e12, "T")).when(c >= 1e9, one(1e9, "B")).when(c >= 1e6, one(1e6, "M")).when(c >= 1e3, one(1e3, "K")).otherwise(F.format_number(c, 2))


def column_variant(columns: list[str], variants: list[str]) -> str | None:
    """The first variant that a header has, whatever its case."""
    known = {c.strip().lower(): c for c in columns}
    return next((known[v.lower()] for v in variants if v.lower() in known), None)


#: Words of each intent, in order; words of each data source; action types of the first two tiers.
INTENTS = {
    "relationship_query": ("connect", "path", "link", "between", "relationship", "donate", "alliance", "ally"),
    "analytical": ("top", "most", "highest", "risk", "flag", "hhi", "concentration", "bid", "pattern", "campaign", "donation", "saln", "wealth", "blacklist", "phoenix", "subcontract", "circular", "shell"),
    "entity_lookup": ("who is", "what is", "tell me about", "show me"),
}
SOURCES = {
    "coa": ("audit", "coa"),
    "ombudsman": ("saln", "net worth", "wealth declaration"),
    "comelec": ("campaign", "donation", "soce"),
    "gppb": ("blacklist",),
    "congress": ("bill", "congress", "legislat"),
}
ALLEGED = ("charged_pending", "flagged_review", "lookout_order", "coa_fraud_audit", "amlc_freeze", "under_investigation", "capitalization_flag", "performance_flag")
ACTIONS = ("license_revoked", "blacklisted", "sec_cancelled")


def _has(c: Column, words) -> Column:
    return reduce(lambda x, y: x | y, (c.contains(w) for w in words))


def intent(c: Column) -> Column:
    """The first intent of which a question has a word, else `open_ended`."""
    low, out = F.lower(c), F.lit("open_ended")
    for name, words in reversed(INTENTS.items()):
        out = F.when(_has(low, words), name).otherwise(out)
    return out


def answer_sources(c: Column) -> Column:
    """Data sources that an answer rests on: procurement always, others by their words."""
    low = F.lower(c)
    return F.array_compact(F.array(F.lit("philgeps"), *(F.when(_has(low, words), name) for name, words in SOURCES.items())))


def tier(kind: Column, actions: Column, revoked: Column, in_news: Column) -> Column:
    """How a node is shown: entity and person by kind, firms by the gravest thing on record."""
    some = lambda names: F.coalesce(F.arrays_overlap(actions, F.array(*(F.lit(n) for n in names))), F.lit(False))
    record = F.when(some(ALLEGED), "alleged").when(some(ACTIONS) | F.coalesce(revoked, F.lit(False)), "action").when(in_news, "news").otherwise("normal")
    return F.when(kind == "ProcuringEntity", "entity").when(kind == "Person", "person").otherwise(record)


#: A description's first part and its further parts, each with the column that fills it.
DESCRIPTIONS = {
    "contractor": ("{name} is a contractor", ("classified as {classification}", "based in {address}", "with {total_contracts} contracts", "worth PHP {total_value}")),
    "agency": ("{name}", ("is a {type} agency", "under {department}", "with annual budget of PHP {annual_budget}")),
    "contract": ("Contract {name}", ("for {title}", "worth PHP {amount}", "via {procurement_method}", "awarded on {award_date}")),
    "politician": ("{name}", ("serves as {position}", "representing {province}", "of {party}", "during {term}")),
    "municipality": ("{name}", ("in {province}", ", {region}", "with population of {population}")),
    "family": ("The {name} family", ("in {province}", "has {member_count} members in public office", "with dynasty score of {dynasty_score}")),
}
_AMOUNTS = {"total_value", "annual_budget", "amount"}


def description(kind: str, columns: list[str]) -> Column:
    """A sentence for a node of a kind; parts without a value, or with zero, are left out."""
    first, others = DESCRIPTIONS[kind]

    def part(template: str, always: bool = False) -> Column:
        before, name, after = template.replace("}", "{").split("{")
        if name not in columns:
            return F.lit(None).cast("string")
        shown = F.format_number(name, 2) if name in _AMOUNTS else F.col(name).cast("string")
        whole = F.concat(F.lit(before), shown, F.lit(after))
        return whole if always else F.when(~F.coalesce(F.col(name).cast("string"), F.lit("")).isin("", "0", "0.0"), whole)

    return F.concat(F.concat_ws(" ", part(first, True), *(part(t) for t in others)), F.lit("."))
