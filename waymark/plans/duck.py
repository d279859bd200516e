"""DuckDB text of the column functions, written apart from the Spark code for the SQL checks."""

from __future__ import annotations

# The words that open a development name, written out again so that the checks do not follow the engine.
DEVELOPMENT_WORDS = ["taman", "bandar", "desa", "setia", "kota", "bukit", "puncak", "subang", "tropicana", "ara", "damansara", "sentosa", "utama"]


def sub(x: str, pattern: str, to: str = "", flags: str = "g") -> str:
    return f"regexp_replace({x}, '{pattern}', '{to}', '{flags}')"


def trim(x: str) -> str:
    return sub(x, r"^\s+|\s+$")


def norm(c: str) -> str:
    s = trim(f"lower(coalesce({c}, ''))")
    s = trim(sub(s, r"^(jalan|jln|lorong|persiaran|jln\.|jalan\.) +", "", ""))
    s = sub(s, r"([a-z]+[0-9]+)[\s/\\-]+([0-9]+[a-z]?)", r"\1/\2")
    s = sub(s, r"\s+[a-z]\s+", " ")
    s = sub(s, r"\s+[a-z]$", "")
    s = sub(s, r"^[a-z]\s+", "")
    return trim(sub(s, r"\s+", " "))


def stem(x: str) -> str:
    return f"regexp_replace({x}, '^(.+/[0-9]+)[a-zA-Z]$', '\\1')"


def title(x: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({x}, '(\\p{{L}}+|[^\\p{{L}}]+)'), "
        "lambda w: upper(w[1:1]) || lower(w[2:])), '')"
    )


def hav(a: str, b: str, c: str, d: str) -> str:
    return (
        f"(12742 * asin(sqrt(least(1, pow(sin(radians({c} - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) "
        f"* pow(sin(radians({d} - ({b})) / 2), 2)))))"
    )


def parts(normal: str, source: str, keep: str = "*") -> str:
    """Subquery that adds section, subsection, block, development of the text column ``normal`` (normalised again)."""
    return f"""(select {keep}, case when section <> '' then {dev("left_part")} else {dev("again")} end as development from (
 select *, upper(regexp_extract(again, '([a-z][0-9]+)/([0-9]+[a-z]?)', 1)) as section, regexp_extract(again, '([a-z][0-9]+)/([0-9]+[a-z]?)', 2) as subsection,
  regexp_extract(again, 'block\\s+([a-z0-9]+)', 1) as block, trim(regexp_extract(again, '^(.*?)[a-z][0-9]+/[0-9]+[a-z]?', 1)) as left_part
 from (select *, {norm(normal)} as again from {source})))"""


def dev(x: str) -> str:
    cut = f"trim(regexp_replace({x}, '^jalan ', ''))"
    return f"case when {cut} = 'jalan' then '' else {cut} end"


def development_rows(source: str) -> str:
    """Rows of ``source`` (street, neighborhood) with dev_name, by ranked word tests."""
    known = "[" + ", ".join(f"'{w}'" for w in DEVELOPMENT_WORDS) + "]"
    stop = "regexp_matches({w}, '^([a-z][0-9]|[0-9]+$)')"
    return f"""(select *, case when coalesce(street, '') = '' then {title("nullif(neighborhood, '')")} else {title("coalesce(named, before, from_area)")} end as dev_name from (
 select *, case when length(prefix) > 1 then prefix end as before,
  case when list_bool_or(list_transform({known}, lambda k: contains(lower(coalesce(neighborhood, '')), k))) then neighborhood end as from_area,
  case when word is not null then array_to_string(words[p : p + coalesce(list_position(list_transform(words[p + 2:], lambda w: {stop.format(w="w")}), true), len(words)) ], ' ') end as named
 from (select *, list_position(words, word) as p from (
  select *, list_filter({known}, lambda k: coalesce(list_position(words, k), 0) > 0 and len(words) > list_position(words, k) and not {stop.format(w="words[list_position(words, k) + 1]")})[1] as word,
   trim(regexp_replace(trim(regexp_extract(again, '^(.*?)[a-z][0-9]+/[0-9]+[a-z]?', 1)), '^(jalan|jln) ', '')) as prefix
  from (select *, {norm("street")} as again, string_split({norm("street")}, ' ') as words from {source})))))"""


def street_patterns() -> str:
    """``WITH`` part of the registered stems."""
    return f"""street_patterns as (select {stem(norm("street"))} as stem_pattern, min(cluster_id) as cluster_id
 from locations join location_clusters using (location_id) where {stem(norm("street"))} <> '' group by 1)"""
