"""Street text as column expressions: normal form, stem, parts, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.geo import col

# Words and patterns of the address format.
ROAD_WORDS = r"^(?:jalan|jln|lorong|persiaran|jln\.|jalan\.) +"
SECTION_WITH_SEPARATOR = r"([a-z]+\d+)[\s/\\-]+(\d+[a-z]?)"
SECTION = r"([a-z]\d+)/(\d+[a-z]?)"
SECTION_NAME = r"(?i)([A-Z]+\d+)[/\\](\d+)[A-Z]?"
SECTION_NAME_AT_END = r"(?i)([A-Z]+\d+)[^0-9]*$"
BLOCK = r"block\s+([a-z0-9]+)"
LONE_LETTER_INSIDE, LONE_LETTER_AT_END, LONE_LETTER_AT_START = r"\s+[a-z]\s+", r"\s+[a-z]$", r"^[a-z]\s+"
ANY_LETTER_INSIDE, ANY_LETTER_AT_END, ANY_LETTER_AT_START = r"(?i)\s+[A-Z]\s+", r"(?i)\s+[A-Z]$", r"(?i)^\s*[A-Z]\s+"
ANY_LETTER_BEFORE_SPACE = r"(?i)\s+[A-Z](?=\s|$)"
SECTION_IN_STREET = r"(?i)^(.*?)([A-Z]+\d+)/(\d+[A-Z]?)(.*)$"
LETTER_SUFFIX = r"^(.+/\d+)[a-zA-Z]$"
DISPLAY_TAIL = r"(?:\s+(?:U\d+|\d+)/\S*|\s+\d+[A-Z]?\s*|\s+/\s*\S+)$"
DEVELOPMENT_WORDS = [
    "taman", "bandar", "desa", "setia", "kota", "bukit", "puncak",
    "subang", "tropicana", "ara", "damansara", "sentosa", "utama",
]


def _text(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize_street(street) -> Column:
    """Lower case, one road word less, ``u13-12`` and ``u13 12`` as ``u13/12``, no stray single letters."""
    s = _trim(F.lower(_text(street)))
    s = _trim(F.regexp_replace(s, ROAD_WORDS, ""))
    s = F.regexp_replace(s, SECTION_WITH_SEPARATOR, "$1/$2")
    s = F.regexp_replace(s, LONE_LETTER_INSIDE, " ")
    s = F.regexp_replace(s, LONE_LETTER_AT_END, "")
    s = F.regexp_replace(s, LONE_LETTER_AT_START, "")
    return _trim(F.regexp_replace(s, r"\s+", " "))


def street_stem(street) -> Column:
    """Drop the one letter that follows ``/number`` at the end."""
    return F.regexp_replace(_text(street), LETTER_SUFFIX, "$1")


def has_suffix(normal) -> Column:
    return street_stem(normal) != col(normal)


def section_identifier(street) -> Column:
    """struct(section, subsection); the subsection is null if only a section is found."""
    s = _text(street)
    section = F.nullif(F.upper(F.regexp_extract(s, SECTION_NAME, 1)), F.lit(""))
    at_end = F.nullif(F.upper(F.regexp_extract(s, SECTION_NAME_AT_END, 1)), F.lit(""))
    subsection = F.nullif(F.regexp_extract(s, SECTION_NAME, 2), F.lit(""))
    return F.struct(F.coalesce(section, at_end).alias("section"), subsection.alias("subsection"))


def title_case(text) -> Column:
    """A capital after every non-letter, small letters elsewhere."""
    words = F.regexp_extract_all(col(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, F.initcap), "")


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def _before_section(s: Column) -> Column:
    """Text before the first section token."""
    return _trim(F.regexp_extract(s, rf"^(.*?){SECTION}", 1))


def _is_stop(word: Column) -> Column:
    return word.rlike(r"^(?:[a-z]\d|\d+$)")


def _named_by_word(words: Column) -> Column:
    """The first listed word with a name after it, and the words up to a section or number."""

    def follows_name(known: Column) -> Column:
        following = F.try_element_at(words, (F.array_position(words, known) + 1).cast("int"))
        return F.array_contains(words, known) & following.isNotNull() & ~_is_stop(following)

    def name_from(known: Column) -> Column:
        at = F.array_position(words, known).cast("int")
        tail = F.slice(words, at + 2, F.size(words))
        stop = F.array_position(F.transform(tail, _is_stop), True).cast("int")
        kept = F.when(stop > 0, F.slice(tail, 1, F.greatest(stop - 1, F.lit(0)))).otherwise(tail)
        return F.array_join(F.concat(F.slice(words, at, 2), kept), " ")

    listed = F.array(*[F.lit(w) for w in DEVELOPMENT_WORDS])
    return F.try_element_at(F.transform(F.slice(F.filter(listed, follows_name), 1, 1), name_from), F.lit(1))


def development_name(street, neighborhood) -> Column:
    """Name of the housing development in a street, else taken from the neighborhood, else null."""

    def from_street(s: Column) -> Column:
        prefix = _trim(F.regexp_replace(_before_section(s), r"^(?:jalan|jln) ", ""))
        before = _let(prefix, lambda p: F.when(F.length(p) > 1, p))
        return F.coalesce(_let(F.split(s, " "), _named_by_word), before)

    area = F.nullif(_text(neighborhood), F.lit(""))
    listed = F.array(*[F.lit(w) for w in DEVELOPMENT_WORDS])
    from_area = F.when(F.exists(listed, lambda w: F.contains(F.lower(area), w)), area)
    found = F.coalesce(_let(normalize_street(street), from_street), from_area)
    return title_case(F.when(_text(street) == "", area).otherwise(found))


def clean_street(street) -> Column:
    """Drop stray single letters but keep those of a section such as ``U13/52P``."""
    def rebuild(s: Column) -> Column:
        prefix = F.regexp_replace(_trim(F.regexp_extract(s, SECTION_IN_STREET, 1)), ANY_LETTER_BEFORE_SPACE, "")
        suffix = F.regexp_replace(_trim(F.regexp_extract(s, SECTION_IN_STREET, 4)), ANY_LETTER_AT_START, "")
        section = F.concat_ws("/", F.regexp_extract(s, SECTION_IN_STREET, 2), F.regexp_extract(s, SECTION_IN_STREET, 3))
        return F.when(s.rlike(SECTION_IN_STREET), F.concat_ws(" ", prefix, section, suffix)).otherwise(s)

    s = F.regexp_replace(_text(street), ANY_LETTER_INSIDE, " ")
    s = F.regexp_replace(s, ANY_LETTER_AT_END, "")
    s = F.regexp_replace(s, ANY_LETTER_AT_START, "")
    return _trim(F.regexp_replace(_let(s, rebuild), r"\s+", " "))


def street_parts(street) -> Column:
    """struct(development, section, subsection, block) of a street; missing parts are empty."""

    def split(s: Column) -> Column:
        section = F.upper(F.regexp_extract(s, SECTION, 1))
        prefix = F.when(section != "", _before_section(s)).otherwise(s)
        development = F.regexp_replace(_trim(F.regexp_replace(prefix, r"^jalan ", "")), r"^jalan$", "")
        return F.struct(
            development.alias("development"),
            section.alias("section"),
            F.regexp_extract(s, SECTION, 2).alias("subsection"),
            F.regexp_extract(s, BLOCK, 1).alias("block"),
        )

    return _let(normalize_street(street), split)


def street_keys(street) -> Column:
    """All keys by which two streets are compared, computed once per street."""

    def keys(normal: Column) -> Column:
        return _let(
            F.struct(normal.alias("normal"), street_stem(normal).alias("stem"), street_parts(normal).alias("p")),
            lambda k: F.struct(
                k["normal"].alias("normal"),
                k["stem"].alias("stem"),
                F.nullif(k["stem"], k["normal"]).alias("suffixed_stem"),
                F.nullif(k["p"]["development"], F.lit("")).alias("development"),
                F.nullif(k["p"]["section"], F.lit("")).alias("section"),
                F.nullif(F.regexp_extract(k["p"]["subsection"], r"^(\d+)", 1), F.lit("")).alias("number"),
            ),
        )

    return _let(normalize_street(street), keys)


def match_level(a: Column, b: Column) -> Column:
    """How two ``street_keys`` structs agree: exact, stem, development, section, or null for no match."""
    same_section = a["section"] == b["section"]
    return (
        F.when(a["normal"] == b["normal"], "exact")
        .when(a["suffixed_stem"] == b["suffixed_stem"], "stem")
        .when(a["development"] != b["development"], F.lit(None).cast("string"))
        .when((a["development"] == b["development"]) & same_section, "development")
        .when(same_section & (a["number"] == b["number"]), "section")
    )


def streets_match(street1, street2) -> Column:
    """Agreement level of two street texts; null if either is empty or they differ."""
    level = _let(F.array(street_keys(street1), street_keys(street2)), lambda k: match_level(k[0], k[1]))
    return F.when((_text(street1) != "") & (_text(street2) != ""), level)


def cluster_name(street) -> Column:
    """``[Development ]Section/number``, or the stem if the street has no section."""

    def name(n: Column) -> Column:
        def join(p: Column) -> Column:
            number = F.regexp_replace(p["subsection"], r"(\d+)[a-zA-Z]$", "$1")
            named = F.concat_ws(" ", F.nullif(p["development"], F.lit("")), F.concat_ws("/", p["section"], number))
            return F.when(p["section"] != "", named).otherwise(street_stem(n))

        return _let(street_parts(n), join)

    return title_case(_let(normalize_street(street), name))


def display_stem(street) -> Column:
    """Street without its section or number tail, in the original case; the whole street if nothing is left."""
    s = _trim(col(street))
    short = _trim(F.regexp_replace(s, DISPLAY_TAIL, ""))
    return F.when(s == "", F.lit(None)).otherwise(F.coalesce(F.nullif(short, F.lit("")), s))


def name_to_development(name) -> Column:
    """Development guessed from a cluster name: the words before the section, or the whole name."""
    words = F.filter(F.split(F.substring_index(col(name), "/", 1), r"\s+"), lambda w: w != "")
    before = F.array_join(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.when(F.contains(col(name), F.lit("/")), before).otherwise(col(name))


def address_choice(user_street, reference_street) -> Column:
    """Which address wins: the user's if it has a street, else the reference, else the user is asked."""
    user, reference = (F.nullif(_text(c), F.lit("")) for c in (user_street, reference_street))
    return F.struct(
        F.coalesce(user, reference).alias("street"),
        F.when(user.isNotNull(), "user").when(reference.isNotNull(), "reference").otherwise("suggestion").alias("source"),
        F.coalesce(user, reference).isNull().alias("needs_user_input"),
    )
