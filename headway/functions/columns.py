"""Column expressions shared by the operators. Everything here stays inside codegen."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- numbers ------------------------------------------------------------------------------------

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_to(c: Column | str, places: int) -> Column:
    """Round a double half away from zero the way a binary engine does (scale, round, unscale)."""
    scale = float(10 ** places)
    return F.round(_col(c) * scale) / scale


def round_half_up(c: Column | str) -> Column:
    """Nearest integer, halves towards plus infinity."""
    return F.floor(_col(c) + 0.5)


def _numeric(text: Column) -> Column:
    return F.when(text.rlike(NUMERIC), text.try_cast("double"))


def to_number(c: Column | str) -> Column:
    """Lenient number: commas, dollars and blanks are dropped, anything non-numeric is NULL."""
    return _numeric(F.regexp_replace(_col(c).cast("string"), r"[,$\s]", ""))


def clean_money(c: Column | str) -> Column:
    """Dashboard money text; placeholders, ranges and negatives are NULL."""
    text = F.trim(F.regexp_replace(_col(c), r"[$,]", ""))
    unknown = F.upper(text).isin("TBD", "N/A", "") | text.contains("-")
    return F.when(~unknown, _numeric(text))


def guarded(num: Column | str, den: Column | str) -> Column:
    """num / den only where den is positive."""
    return F.when(_col(den) > 0, _col(num) / _col(den))


# ---- text ---------------------------------------------------------------------------------------

def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(_col(c)), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return F.trim(F.coalesce(_col(c), F.lit(""))) == ""


#: Characters of a slug's stem; a text format, as the id that follows keeps slugs apart.
STEM = 60


def slug(name: Column | str, ident: Column | str, stem_chars: int = STEM) -> Column:
    """Lower-case words joined by dashes (Unicode letters kept), a stem of so many characters, then the id."""
    dashed = F.regexp_replace(F.lower(F.coalesce(_col(name), F.lit(""))), r"[^\p{L}\p{N}]+", "-")
    stem = F.substring(F.regexp_replace(dashed, "^-|-$", ""), 1, stem_chars)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("agency")), F.lit("-"),
                    _col(ident).cast("string"))


def post_slug(title: Column | str, ident: Column | str, stem_chars: int = STEM) -> Column:
    """ASCII slug of a headline: dashes trimmed, then cut to a stem, then the id."""
    dashed = F.regexp_replace(F.lower(F.coalesce(F.nullif(_col(title), F.lit("")), F.lit("post"))),
                              "[^a-z0-9]+", "-")
    stem = F.substring(F.regexp_replace(dashed, "^-+|-+$", ""), 1, stem_chars)
    return F.concat(F.coalesce(F.nullif(stem, F.lit("")), F.lit("post")), F.lit("-"),
                    _col(ident).cast("string"))


def norm_name(c: Column | str) -> Column:
    """Project-name key: case, punctuation, bracketed remarks and filler words removed."""
    t = F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "&", " and ")
    t = F.regexp_replace(t, r"\([^)]*\)", " ")
    t = F.regexp_replace(t, r"\bbus rapid transit\b", "brt")
    t = F.regexp_replace(t, r"[^a-z0-9]+", " ")
    t = F.regexp_replace(t, r"\b(the|project|program)\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def words(c: Column | str) -> Column:
    """Non-empty words of a space-separated text."""
    return F.filter(F.split(_col(c), r"\s+"), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


# fixed value: what counts as a deliverable address
EMAIL = (r"^[^@\s,;<>]{1,64}@[a-z0-9]([a-z0-9-]*[a-z0-9])?"
         r"(\.[a-z0-9]([a-z0-9-]*[a-z0-9])?)+$")
EMAIL_LENGTH = 254


def normalize_email(c: Column | str) -> Column:
    """Lower-cased bare address, or NULL when it is not a plausible one."""
    raw = F.trim(F.coalesce(_col(c), F.lit("")))
    inner = F.trim(F.regexp_extract(raw, "<([^>]+)>", 1))
    text = F.when(inner != "", inner).otherwise(raw)
    text = F.lower(F.regexp_replace(text, r"""^["' ]+|["' ]+$""", ""))
    return F.when((F.length(text) <= EMAIL_LENGTH) & text.rlike(EMAIL), text)


# fixed value: words that say nothing about which story a headline tells
STOP_WORDS = ("a an the of in on at to for and or with by from as is are was were be been this that "
              "its his her their new more than after before over under into out up down not no "
              "us u.s. transit agency agencies plan plans project projects").split()


def content_words(c: Column | str) -> Column:
    """Distinct content words (ASCII alphanumeric runs over two characters, stop words removed)."""
    runs = F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))
    stops = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.array_except(F.filter(runs, lambda w: F.length(w) > 2), stops)


# ---- dates --------------------------------------------------------------------------------------

def date_from_name(c: Column | str) -> Column:
    """Snapshot date in a file name: year-month-day first, else month-day-year, as text or NULL."""
    iso = F.regexp_extract(_col(c), r"(20\d{2}-\d{2}-\d{2})", 1)
    us = r"(\d{2})-(\d{2})-(20\d{2})"
    flipped = F.concat_ws("-", F.regexp_extract(_col(c), us, 3), F.regexp_extract(_col(c), us, 1),
                          F.regexp_extract(_col(c), us, 2))
    return F.when(iso != "", iso).when(F.regexp_extract(_col(c), us, 3) != "", flipped)


def date_in_name_last(c: Column | str) -> Column:
    """The last valid month-day-year in a file name; overlapping readings are all considered."""
    pattern = r"(?<![0-9])(?=([0-9]{1,2})-([0-9]{1,2})-([0-9]{4}|[0-9]{2})(?![0-9]))"
    parts = [F.regexp_extract_all(F.coalesce(_col(c), F.lit("")), F.lit(pattern), F.lit(i)) for i in (1, 2, 3)]
    year = lambda y: F.when(y.cast("int") < 100, y.cast("int") + 2000).otherwise(y.cast("int"))
    dates = F.transform(
        F.zip_with(F.zip_with(parts[0], parts[1], lambda m, d: F.struct(m.cast("int").alias("m"), d.cast("int").alias("d"))),
                   parts[2], lambda p, y: F.struct(p["m"].alias("m"), p["d"].alias("d"), year(y).alias("y"))),
        lambda p: F.when(p["m"].between(1, 12) & p["d"].between(1, 31),
                         F.format_string("%04d-%02d-%02d", p["y"], p["m"], p["d"])))
    return F.try_element_at(F.array_compact(dates), F.lit(-1))


def eastern_minute(c: Column | str) -> Column:
    """Minute-precision text in the newsroom's zone."""
    return F.date_format(F.from_utc_timestamp(_col(c), "America/New_York"), "yyyy-MM-dd HH:mm")


# ---- addresses of pages -------------------------------------------------------------------------

def host_of(c: Column | str) -> Column:
    """Network location of a URL without ``www.``; blank when there is none."""
    loc = F.regexp_extract(F.coalesce(_col(c), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(loc, r"www\.", "")


def absolute_url(base: Column | str, link: Column | str) -> Column:
    """``link`` as seen from page ``base``."""
    base, link = _col(base), F.trim(_col(link))
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    joined = (F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
              .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
              .when(link.startswith("/"), F.concat(root, link))
              .when(link == "", base)
              .when(link.startswith("?"), F.concat(path, link))
              .when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link))
              .otherwise(F.concat(folder, link)))
    # resolve "./" and "dir/../" steps, however many
    site = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"
    steps = F.split(F.regexp_extract(joined, site, 2), "/")

    def walk(done: Column, step: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))
        return F.when(step == "..", up).when(step == ".", done).otherwise(F.concat(done, F.array(step)))

    walked = F.aggregate(F.slice(steps, 2, F.size(steps)), F.slice(steps, 1, 1), walk)
    tidy = F.concat(F.regexp_extract(joined, site, 1), F.array_join(walked, "/"), F.regexp_extract(joined, site, 3))
    return F.when(joined.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^?#]*/\.\.?/"), tidy).otherwise(joined)


def web_address(url: Column) -> Column:
    """The URL when it is a full http(s) address, else NULL."""
    return F.nullif(F.regexp_extract(url, r"^(?i)(https?://[^/?#].*)$", 1), F.lit(""))


# ---- arrays and ordered rules -------------------------------------------------------------------

def array_of(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("array()").cast("array<string>")


def all_of(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def first_rule(rules, otherwise: Column | None = None) -> Column:
    """``rules`` is an ordered list of (condition, value)."""
    out = None
    for cond, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(otherwise) if otherwise is not None else out


def lookup(mapping: dict, key: Column) -> Column:
    """Literal map lookup; NULL for unknown keys."""
    flat = [F.lit(x) for pair in mapping.items() for x in pair]
    return F.try_element_at(F.create_map(*flat), key)
