"""Rules on names and on citation texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isohyet.functions.geo import bind

#: Years that a citation can bear, designations, field labels of citations, a line that opens another field.
YEAR = r"\b(1[89]\d\d|20\d\d)\b"
DESIGNATION = r"\b(SSSI|NNR|S\.S\.S\.I\.)\b"
ORIGINAL_FIELDS = (("1949-act", r"Date\s+Notified\s*\(\s*Under\s+1949\s+Act\s*\)\s*:?"), ("first-notified", r"First\s+Notified\s*:?"))
RENOTIFIED_FIELDS = (r"Date\s+Notified\s*\(\s*Under\s+1981\s+Act\s*\)\s*:?", r"Date\s+of\s+Renotification\s*:?")
REVISION_FIELD = r"Date\s+of\s+(?:Last\s+)?Revision\s*:?"
BOUNDARY_NOTE = r"formerly\s+(?:notified|part\s+of)|\bextension\b|\bde-?notif\w*"
LABEL_LINE = r"^\s*[A-Za-z][^\n:]{0,60}:"
VALUE_LINES = 4
SITE_NAME = r"SITE\s+NAME\s*:?\s*([^\n]+)"
HEADER_LINE = r"^[^:\n]{2,40}:\s*([^\n]+)$"
#: Fixed value: sites first notified before this year are admitted.
ADMITTED_BEFORE = 1975

#: White space of any script, as texts from page layouts hold; no-break spaces and separators among it.
SPACE = r"[\s\x1c-\x1f]"


def unicode_pattern(pattern: str, ignore_case: bool = True) -> str:
    """A pattern whose classes and cases are those of Unicode and whose lines end at line feeds alone."""
    return f"({'?i' if ignore_case else '?'}Ud)" + pattern.replace(r"\s", SPACE)


def name_stem(name: Column) -> Column:
    """Tokens of a station name without its trailing number."""
    return F.split(F.regexp_replace(F.lower(name), r"(?:-no)?-[0-9]+$", ""), "-")


def is_token_prefix(a: Column, b: Column) -> Column:
    """Whether one token list begins with the other."""
    n = F.least(F.size(a), F.size(b))
    return (n > 0) & (F.slice(a, 1, n) == F.slice(b, 1, n))


def normalised_site(name: Column) -> Column:
    """Upper case, without designation and then without parentheses, other characters squeezed to single spaces."""
    upper = F.upper(name)
    bare = F.regexp_replace(F.regexp_replace(upper, unicode_pattern(DESIGNATION, ignore_case=False), " "), unicode_pattern(r"\(.*?\)"), " ")
    return F.trim(F.regexp_replace(bare, r"[^A-Z0-9]+", " "))


def names_match(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of the other; empty names match nothing."""
    return (a != "") & (b != "") & (a.startswith(b) | b.startswith(a))


def first_year(text: Column) -> Column:
    """The first year that a citation can bear; null without one, or if its digits aren't 0 to 9."""
    return F.regexp_extract(text, unicode_pattern(YEAR), 1).try_cast("int")


#: Every field and note holds one of these: a text without any is searched once, not for each.
PIECES = "notif|revision|formerly|extension|site"


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, unicode_pattern(r"^\s+|\s+\z"), "")


def field_value(text: Column, label: str, may: Column | None = None) -> Column:
    """What stands behind the first such label, VALUE_LINES lines at most, ending before a line that opens another field; null without it.

    The text is searched once, and only where it may hold the label; the rest works on what was found.
    """
    opens = LABEL_LINE.removeprefix("^").replace(r"\s", r"[\s\x1c-\x1f&&[^\n]]")
    lines = rf"([^\n]*(?:\n(?!{opens})[^\n]*){{0,{VALUE_LINES - 1}}})"
    pattern = unicode_pattern(f"(?:{label})") + lines
    value = lambda found: stripped(F.regexp_replace(F.regexp_extract(found, pattern, 1), "\n", " "))
    found = F.regexp_extract(text, pattern, 0)
    return bind(found if may is None else F.when(may, found), lambda found: F.when(found != "", value(found)))


def cited_site(text: Column, may: Column | None = None) -> Column:
    """The name behind 'SITE NAME', else what follows the colon of the first line that isn't blank, else empty."""
    pattern = unicode_pattern(SITE_NAME)
    header = stripped(F.regexp_extract(stripped(F.regexp_extract(text, unicode_pattern(r"^\s*([^\n]+)"), 1)), unicode_pattern(HEADER_LINE), 1))
    found = F.regexp_extract(text, pattern, 0)
    return bind(found if may is None else F.when(may, found), lambda found: F.when(found != "", stripped(F.regexp_extract(found, pattern, 1))).otherwise(header))


def boundary_note(text: Column, may: Column | None = None) -> Column:
    """The line that holds the first boundary note; the text is searched once, up to the note's end."""
    pattern = unicode_pattern(rf"(?s)^(.*?)(?:{BOUNDARY_NOTE})")

    def line(upto: Column) -> Column:
        before = F.regexp_extract(upto, pattern, 1)
        after = F.substring(text, F.length(upto) + 1, F.length(text))
        note = bind(before, lambda b: F.concat(F.substring_index(b, "\n", -1), F.substring(upto, F.length(b) + 1, F.length(upto)), F.substring_index(after, "\n", 1)))
        return F.when(upto != "", F.nullif(stripped(note), F.lit("")))

    found = F.regexp_extract(text, pattern, 0)
    return bind(found if may is None else F.when(may, found), line)


def citation(text: Column) -> Column:
    """What a citation says, as a struct: its site, the year of the first notification and the field that holds it, later dates, boundary notes.

    The date under the 1981 Act is a renotification, never an original date. A text that holds none of PIECES is searched once, others once for each field.
    """
    def fields(t: Column) -> Column:
        originals = lambda may: F.array(*[field_value(t, label, may) for _, label in ORIGINAL_FIELDS])
        return bind(F.regexp_like(t, F.lit(unicode_pattern(PIECES))), lambda may: bind(originals(may), lambda v: said(t, v, may)))

    def said(t: Column, values: Column, may: Column) -> Column:
        found = [first_year(values[i]) for i in range(len(ORIGINAL_FIELDS))]
        return F.struct(
            cited_site(t, may).alias("citation_site_name"),
            F.coalesce(*found).alias("first_notified_year"),
            F.coalesce(*[F.when(y.isNotNull(), name) for (name, _), y in zip(ORIGINAL_FIELDS, found, strict=True)]).alias("original_field"),
            F.exists(values, lambda v: v.isNotNull()).alias("original_field_seen"),
            F.coalesce(*[first_year(field_value(t, label, may)) for label in RENOTIFIED_FIELDS]).alias("renotified_year"),
            first_year(field_value(t, REVISION_FIELD, may)).alias("revision_year"),
            boundary_note(t, may).alias("boundary_note"),
        )

    return bind(text, fields)


def citation_fields(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with the fields of citation as columns."""
    return rows.withColumn("__said", citation(F.col(text))).select("*", "__said.*").drop("__said")


def admission(citations: DataFrame, text: str = "text", fetched: str = "fetched", has_key: str = "has_key", site: str = "site") -> DataFrame:
    """citations with what the text says (citation_fields), reason, reason_detail and admitted_pre_1975: the first rule that applies, 'ok' if none does.

    A citation of another site comes before any date of it: its date may be sound, but not for this site, and is taken back.
    """
    said = citation_fields(citations, text)
    mine = names_match(normalised_site(F.col(site)), normalised_site(F.col("citation_site_name")))
    judged = said.withColumns({
        "__blank": F.coalesce(stripped(F.col(text)), F.lit("")) == "",
        "__mine": F.coalesce(mine, F.lit(False)),
        "__revised": F.coalesce(F.col("revision_year") > F.col("first_notified_year"), F.lit(False)) | F.col("boundary_note").isNotNull(),
    })
    reason = (
        F.when(~F.col(has_key), "no-citation-key")
        .when(~F.col(fetched), "fetch-failed")
        .when(F.col("__blank"), "no-original-date")
        .when(~F.col("__mine"), "identity-unverified")
        .when(F.col("first_notified_year").isNull(), "no-original-date")
        .when(F.col("__revised"), "boundary-history-unresolved")
        .otherwise("ok")
    )
    detail = F.when(F.col("__blank"), "no-text").when(F.col("original_field_seen"), "original-field-blank").when(F.col("renotified_year").isNotNull(), "renotification-only").otherwise("original-field-absent")
    known = F.col("reason").isin("ok", "boundary-history-unresolved")
    reasoned = judged.withColumn("reason", reason).withColumns({
        "reason_detail": F.when(F.col("reason") == "no-original-date", detail),
        "admitted_pre_1975": F.when(F.col("reason") == "ok", F.col("first_notified_year") < ADMITTED_BEFORE),
    })
    own = {c: F.when(known, F.col(c)) for c in ("first_notified_year", "original_field")}
    return reasoned.withColumns(own).drop("__blank", "__mine", "__revised")
