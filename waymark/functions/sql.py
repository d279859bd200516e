"""The column functions as temporary SQL functions of a session: ``spark.sql("select normalize_street(street) ...")``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from waymark.functions import geo, streets

_PAIR = "lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE"
_STREET = "street STRING"


def _raw(pattern: str) -> str:
    return f"r'{pattern}'"


def _sub(text: str, pattern: str, to: str = "") -> str:
    return f"regexp_replace({text}, {_raw(pattern)}, '{to}')"


def _trim(text: str) -> str:
    return _sub(text, r"^\s+|\s+$")


def _part(text: str, pattern: str, group: int) -> str:
    return f"regexp_extract({text}, {_raw(pattern)}, {group})"


def _list(values) -> str:
    return "array(" + ", ".join(f"'{v}'" for v in values) + ")"


def _normal() -> str:
    text = _trim("lower(coalesce(street, ''))")
    text = _trim(_sub(text, streets.ROAD_WORDS))
    text = _sub(text, streets.SECTION_WITH_SEPARATOR, "$1/$2")
    for pattern, to in ((streets.LONE_LETTER_INSIDE, " "), (streets.LONE_LETTER_AT_END, ""), (streets.LONE_LETTER_AT_START, "")):
        text = _sub(text, pattern, to)
    return _trim(_sub(text, r"\s+", " "))


def _clean() -> str:
    text = "coalesce(street, '')"
    for pattern, to in ((streets.ANY_LETTER_INSIDE, " "), (streets.ANY_LETTER_AT_END, ""), (streets.ANY_LETTER_AT_START, "")):
        text = _sub(text, pattern, to)
    return text


_STOP = r"w RLIKE r'^(?:[a-z]\d|\d+$)'"
_BEFORE = _trim(_part("s", rf"^(.*?){streets.SECTION}", 1))
_WORDS = _list(streets.DEVELOPMENT_WORDS)
_PARTS = "STRUCT<development: STRING, section: STRING, subsection: STRING, block: STRING>"

#: Name, arguments, result and body. A function may use those above it; names with ``_of`` at the end are steps of others.
FUNCTIONS: dict[str, tuple[str, str, str]] = {
    # coordinates
    "haversine_km": (
        _PAIR, "DOUBLE",
        "coalesce(12742 * asin(sqrt(if(lat1 + lon1 + lat2 + lon2 is null, null, least(1e0, power(sin(radians(lat2 - lat1) / 2), 2) "
        "+ cos(radians(lat1)) * cos(radians(lat2)) * power(sin(radians(lon2 - lon1) / 2), 2))))), 0e0)",
    ),
    "near_equal": (f"{_PAIR}, tol DOUBLE", "BOOLEAN", "abs(lat1 - lat2) < tol and abs(lon1 - lon2) < tol"),
    "in_box": ("lat DOUBLE, lon DOUBLE, center_lat DOUBLE, center_lon DOUBLE, half DOUBLE", "BOOLEAN", "lat between center_lat - half and center_lat + half and lon between center_lon - half and center_lon + half"),
    "degree_distance_sq": (_PAIR, "DOUBLE", "(lat1 - lat2) * (lat1 - lat2) + (lon1 - lon2) * (lon1 - lon2)"),
    "degree_distance": (_PAIR, "DOUBLE", "sqrt(degree_distance_sq(lat1, lon1, lat2, lon2))"),
    "metres_to_degrees": ("metres DOUBLE", "DOUBLE", f"metres / {geo.METRES_PER_DEGREE}"),
    "int_metres": ("km DOUBLE", "BIGINT", "cast(km * 1000 as bigint)"),
    "coord_key": ("lat DOUBLE, lon DOUBLE", "STRING", "format_string('%.6f,%.6f', lat, lon)"),
    "leg_key": (_PAIR, "STRING", "format_string('route:%.5f,%.5f:%.5f,%.5f', lat1, lon1, lat2, lon2)"),
    "swap_axes": ("points ARRAY<ARRAY<DOUBLE>>", "ARRAY<ARRAY<DOUBLE>>", "transform(points, p -> array(p[1], p[0]))"),
    "address_line": ("street STRING, postcode STRING, city STRING", "STRING", _sub("concat(coalesce(street, ''), ', ', coalesce(postcode, ''), ' ', coalesce(city, ''))", "^[, ]+|[, ]+$")),
    # roads
    "road_level": (
        "highway STRING", "INT",
        f"coalesce(try_element_at(map({', '.join(f'{chr(39)}{k}{chr(39)}, {v}' for k, v in geo.ROAD_LEVELS.items())}), coalesce(highway, 'unclassified')), {geo.UNKNOWN_ROAD_LEVEL})",
    ),
    "is_main_road": ("highway STRING", "BOOLEAN", "road_level(highway) <= 5"),
    "is_residential": ("highway STRING", "BOOLEAN", "coalesce(highway in ('residential', 'living_street'), false)"),
    "restricted_access": (
        "access STRING, motor_vehicle STRING, vehicle STRING", "BOOLEAN",
        f"exists(array(access, motor_vehicle, vehicle), tag -> coalesce(array_contains({_list(geo.RESTRICTED_VALUES)}, tag), false))",
    ),
    "crossing_confidence": ("crossings BIGINT, routes BIGINT", "DOUBLE", "least(0.95D, crossings / routes * 0.5D + 0.5D)"),
    # times and payloads
    "age_seconds": ("now TIMESTAMP, created_at TIMESTAMP", "BIGINT", "unix_timestamp(now) - unix_timestamp(created_at)"),
    "iso_text": (
        "ts TIMESTAMP", "STRING",
        """if(endswith(date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), '.000000'), date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))""",
    ),
    "blank_to_null": ("text STRING", "STRING", "nullif(text, '')"),
    # streets
    "normalize_street": (_STREET, "STRING", _normal()),
    "street_stem": (_STREET, "STRING", _sub("coalesce(street, '')", streets.LETTER_SUFFIX, "$1")),
    "title_case": ("text STRING", "STRING", r"array_join(transform(regexp_extract_all(text, r'(\p{L}+|[^\p{L}]+)', 1), w -> initcap(w)), '')"),
    "section_identifier": (
        _STREET, "STRUCT<section: STRING, subsection: STRING>",
        f"named_struct('section', coalesce(nullif(upper({_part('street', streets.SECTION_NAME, 1)}), ''), nullif(upper({_part('street', streets.SECTION_NAME_AT_END, 1)}), '')), "
        f"'subsection', nullif({_part('street', streets.SECTION_NAME, 2)}, ''))",
    ),
    "clean_street_of": (
        "s STRING", "STRING",
        f"if(s RLIKE {_raw(streets.SECTION_IN_STREET)}, concat_ws(' ', {_sub(_trim(_part('s', streets.SECTION_IN_STREET, 1)), streets.ANY_LETTER_BEFORE_SPACE)}, "
        f"concat_ws('/', {_part('s', streets.SECTION_IN_STREET, 2)}, {_part('s', streets.SECTION_IN_STREET, 3)}), {_sub(_trim(_part('s', streets.SECTION_IN_STREET, 4)), streets.ANY_LETTER_AT_START)}), s)",
    ),
    "clean_street": (_STREET, "STRING", _trim(_sub(f"clean_street_of({_clean()})", r"\s+", " "))),
    "street_parts_of": (
        "s STRING", _PARTS,
        f"named_struct('development', {_sub(_trim(_sub(f'if({_part(chr(115), streets.SECTION, 1)} <> {chr(39) * 2}, {_BEFORE}, s)', '^jalan ')), '^jalan$')}, 'section', upper({_part('s', streets.SECTION, 1)}), "
        f"'subsection', {_part('s', streets.SECTION, 2)}, 'block', {_part('s', streets.BLOCK, 1)})",
    ),
    "street_parts": (_STREET, _PARTS, "street_parts_of(normalize_street(street))"),
    "named_word_of": (
        "words ARRAY<STRING>", "STRING",
        f"try_element_at(filter({_WORDS}, k -> array_contains(words, k) and try_element_at(words, cast(array_position(words, k) + 1 as int)) is not null "
        f"and not (try_element_at(words, cast(array_position(words, k) + 1 as int)) RLIKE r'^(?:[a-z]\\d|\\d+$)')), 1)",
    ),
    "name_length_of": (
        "words ARRAY<STRING>, at INT", "INT",
        f"if(array_position(transform(slice(words, at + 2, size(words)), w -> {_STOP}), true) > 0, cast(array_position(transform(slice(words, at + 2, size(words)), w -> {_STOP}), true) + 1 as int), size(words))",
    ),
    "name_from_words": ("words ARRAY<STRING>, at INT", "STRING", "if(at > 0, array_join(slice(words, at, name_length_of(words, at)), ' '), null)"),
    "name_by_word": ("words ARRAY<STRING>", "STRING", "name_from_words(words, cast(array_position(words, named_word_of(words)) as int))"),
    "name_by_prefix": ("s STRING", "STRING", f"if(length({_trim(_sub(_BEFORE, '^(?:jalan|jln) '))}) > 1, {_trim(_sub(_BEFORE, '^(?:jalan|jln) '))}, null)"),
    "development_name": (
        "street STRING, neighborhood STRING", "STRING",
        f"title_case(if(coalesce(street, '') = '', nullif(neighborhood, ''), coalesce(name_by_word(split(normalize_street(street), ' ')), name_by_prefix(normalize_street(street)), "
        f"if(exists({_WORDS}, w -> contains(lower(nullif(neighborhood, '')), w)), nullif(neighborhood, ''), null))))",
    ),
    "streets_match_of": (
        f"a STRING, b STRING, p {_PARTS}, q {_PARTS}", "STRING",
        r"case when a = b then 'exact' when nullif(street_stem(a), a) = nullif(street_stem(b), b) then 'stem' when nullif(p.development, '') <> nullif(q.development, '') then null "
        r"when nullif(p.development, '') = nullif(q.development, '') and nullif(p.section, '') = nullif(q.section, '') then 'development' "
        r"when nullif(p.section, '') = nullif(q.section, '') and nullif(regexp_extract(p.subsection, r'^(\d+)', 1), '') = nullif(regexp_extract(q.subsection, r'^(\d+)', 1), '') then 'section' end",
    ),
    "streets_match": (
        "street1 STRING, street2 STRING", "STRING",
        "if(street1 <> '' and street2 <> '', streets_match_of(normalize_street(street1), normalize_street(street2), street_parts(normalize_street(street1)), street_parts(normalize_street(street2))), null)",
    ),
    "cluster_name_of": (
        f"n STRING, p {_PARTS}", "STRING",
        r"if(p.section <> '', concat_ws(' ', nullif(p.development, ''), concat_ws('/', p.section, regexp_replace(p.subsection, r'(\d+)[a-zA-Z]$', '$1'))), street_stem(n))",
    ),
    "cluster_name": (_STREET, "STRING", "title_case(cluster_name_of(normalize_street(street), street_parts(normalize_street(street))))"),
    "display_stem": (_STREET, "STRING", f"if({_trim('street')} = '', null, coalesce(nullif({_trim(_sub(_trim('street'), streets.DISPLAY_TAIL))}, ''), {_trim('street')}))"),
    "words_before_last": ("words ARRAY<STRING>", "STRING", "array_join(slice(words, 1, greatest(size(words) - 1, 0)), ' ')"),
    "name_to_development": ("name STRING", "STRING", r"if(contains(name, '/'), words_before_last(filter(split(substring_index(name, '/', 1), r'\s+'), w -> w <> '')), name)"),
    "address_choice": (
        "user_street STRING, reference_street STRING", "STRUCT<street: STRING, source: STRING, needs_user_input: BOOLEAN>",
        "named_struct('street', coalesce(nullif(user_street, ''), nullif(reference_street, '')), 'source', case when user_street <> '' then 'user' when reference_street <> '' then 'reference' else 'suggestion' end, "
        "'needs_user_input', coalesce(nullif(user_street, ''), nullif(reference_street, '')) is null)",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Make the functions callable from ``spark.sql`` in this session; returns their names."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    return list(FUNCTIONS)
