"""The registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import decontaminate, jaccard, language, licenses, lines, neighbours, ngrams, packing, repair, secrets, spelling, toxicity, warc
from waymark.llm.text import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(job: Callable[[SparkSession, str], DataFrame]):
    QUERIES[job.__name__] = job
    return job


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DUCK_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@_query
def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.match_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL["op1_benchmark_decontamination"] = f"""
with d as (select doc_id, coalesce({_DUCK_WORDS.format('text')}, []) as w from documents),
i as (select item_id, {_DUCK_WORDS.format('text')} as w from benchmark),
win as (select distinct item_id, least(len(w), 10) as k, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') as s
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p from i where len(w) > 0)),
sizes as (select distinct k from win),
places as (select doc_id, p, k, array_to_string(w[p:p + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d, sizes where len(w) >= k)),
hits as (select doc_id, p, k, item_id from places join win using (k, s)),
words_hit as (select doc_id, count(distinct q) as n_hit from (select distinct doc_id, p, k, unnest(range(p, p + k)) as q from hits) group by doc_id),
named as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits where item_id is not null) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words_hit using (doc_id) left join named using (doc_id)
"""


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = fold("doc_id", 7) == 2
    model = ngrams.fit(docs.where(~held_out))
    return ngrams.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(_table(spark, sf_dir, "documents"), words=3, percent=90)


SQL["op4_jaccard_join"] = r"""
with recursive d as (select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) as w from documents),
s as materialized (select distinct doc_id, array_to_string(w[p:p + 2], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as p from d where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
both_ as materialized (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
links as materialized (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
edges as materialized (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from d union select r.a, e.b from reach r join edges e on r.b = e.a)
select doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, component_id
from (select a as doc_id, min(b) as component_id from reach group by a) left join n using (doc_id)
"""


@_query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.tokenize(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packing.pack(pieces).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@_query
def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_rows(_table(spark, sf_dir, "embeddings"), every=20, k=20)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


_DUCK_KEY = r"translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\z', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL["op7_line_dedup"] = f"""
with l as (select doc_id, line, p, {_DUCK_KEY} as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as p from documents)),
dup as (select k, max(doc_id) as keeper from l where length(k) >= 20 group by k having count(distinct doc_id) >= 3),
marked as (select l.*, keeper is not null and doc_id <> keeper as gone from l left join dup using (k))
select doc_id, count(*) as n_lines, cast(sum(cast(gone as int)) as bigint) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


@_query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, sf_dir, "documents"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*secrets.BASE))
    return found.select("doc_id", *map(n, secrets.BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@_query
def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(_table(spark, sf_dir, "documents"))


@_query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language.predict(docs, language.fit(language.training_rows(docs)))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")



@_query
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.resolved(warc.read(warc.write(_table(spark, sf_dir, "pages"))))


SQL["op11_warc"] = """
with p as (select page_id, coalesce(html, '') as html, list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c: strpos('0123456789abcdef', c) - 1) as d from pages),
ranked as (select *, row_number() over (partition by html order by page_id desc nulls last) as k, max(page_id) over (partition by html) as winner from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(((d[5 * i // 4 + 1] * 16 + d[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31 as int), 1)), '') as payload_digest,
  case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then winner end as refers_to
from ranked
"""

_DUCK_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CTE with the 256 remainders of crc32 as a list, and the checksum of a list of bytes by it.
_DUCK_CRC_TABLE = """crc_table as materialized (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as rest)"""
_DUCK_CRC = "xor(list_reduce({}, lambda a, b: xor(a >> 8, rest[(xor(a, b) & 255) + 1]), cast(4294967295 as bigint)), 4294967295)"


@_query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), damage=spelling.DAMAGE))


SQL["op12_spelling_variants"] = f"""
with recursive {_DUCK_CRC_TABLE},
runs as (select coalesce(cast(doc_id as varchar), '') as id, r, count(*) as n
  from (select doc_id, unnest(regexp_extract_all({_DUCK_LOWER.format('text')}, '[A-Za-z\u00C0-\u00FF]+')) as r from documents) group by all),
checked as (select r, n, {_DUCK_CRC.format("flatten(list_transform(string_split(id || ':' || r, ''), lambda c: case when unicode(c) < 128 then [cast(unicode(c) as bigint)] else [cast(195 as bigint), unicode(c) - 64] end))")} as h
  from runs, crc_table),
words as materialized (select word, cast(sum(n) as bigint) as n
  from (select case when h % 31 = 0 then left(r, h % length(r)) || substr(r, h % length(r) + 2) else r end as word, n from checked)
  where length(word) >= 7 group by word having sum(n) >= 2),
skipped as materialized (select distinct word, n, left(word, i) as a, substr(word, i + 2) as b from (select word, n, unnest(range(length(word))) as i from words)),
shorter as materialized (select distinct s.word, s.n, w.word as less, w.n as less_n from skipped s join words w on w.word = s.a || s.b),
near as (select x.word, y.word as other, y.n as other_n from skipped x join skipped y on x.a = y.a and x.b = y.b and x.word <> y.word and length(x.word) = length(y.word)
  union all select word, less, less_n from shorter union all select less, word, n from shorter),
told as (select word, count(*) as n_near, first(other order by other_n desc, other) as best, max(other_n) as best_n from near group by word),
forms as materialized (select w.word, w.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * w.n then best end as form, case when best_n >= 10 * w.n then best_n end as form_n
  from words w left join told t on t.word = w.word),
walk as (select word, word as root, form as following from forms union all select w.word, f.word, f.form from walk w join forms f on f.word = w.following)
select f.word, f.form, w.root, f.n, cast(f.n_near as bigint) as n_near, f.form_n from forms f join walk w on w.word = f.word and w.following is null
"""


@_query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations")
    fixed = repair.repair(repair.damage(given)).withColumnRenamed("conv_id", "_id")
    joined = given.select("conv_id").distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


SQL["op13_conversation_repair"] = rf"""
with recursive {_DUCK_CRC_TABLE},
given as (select *, {_DUCK_CRC.format("list_transform(string_split(coalesce(cast(conv_id as varchar), '') || ':' || coalesce(cast(turn as varchar), ''), ''), lambda c: cast(unicode(c) as bigint))")} % 20 as k
  from (select coalesce(cast(conv_id as varchar), '') as conv, conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text from conversations), crc_table),
spoilt as (select conv, conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then translate(text, '.!?', '') else text end as text,
  unnest(case when k = 3 then [1, 2] else [1] end) as copy from given where k <> 0),
placed as materialized (select *, left(role, 1) as initial, regexp_extract(text, '([^ 	-
])[ 	-
]*\z', 1) as last,
  row_number() over (partition by conv order by turn nulls first, role, text, copy) as i, row_number() over (partition by conv, role, text order by turn nulls first, copy) as copies from spoilt),
checked as materialized (select *, case when last = '' then 'blank' when copies > 1 then 'duplicate' when last not in ('.', '!', '?') then 'truncated' else '' end as fault,
  lag(initial) over (partition by conv order by i) as before from placed),
inserts(s0, s1, more, letters, roles) as (values ('E', 'E', 0, '', []), ('E', 'U', 2, 'I', ['user:']), ('E', 'A', 4, 'II', ['user:', 'assistant:']), ('S', 'S', 0, '', []), ('S', 'U', 2, 'I', ['user:']),
  ('S', 'A', 4, 'II', ['user:', 'assistant:']), ('U', 'U', 0, '', []), ('U', 'A', 2, 'I', ['assistant:']), ('A', 'A', 0, '', []), ('A', 'U', 2, 'I', ['user:'])),
legal(s1, r, s2) as (values ('E', 's', 'S'), ('E', 'u', 'U'), ('S', 'u', 'U'), ('A', 'u', 'U'), ('U', 'a', 'A')),
edits as materialized (
  select conv, i, s1, s1 as s2, 3 as price, 'D' as letter, cast([] as varchar[]) as line from checked, (select distinct s1 from inserts)
  union all select conv, i, s1, s2, case when fault = 'truncated' then 1 else 0 end, 'K', [role || ':' || text] from checked join legal on r = initial where fault not in ('blank', 'duplicate')
  union all select conv, i, s1, s2, case when fault = 'truncated' then 3 else 2 end, 'R', [case r when 'u' then 'user' else 'assistant' end || ':' || text] from checked join legal on r <> 's' where fault not in ('blank', 'duplicate')),
steps as materialized (select conv, i, s0, s2, more + price as price, rpad(letters || letter, 3, ' ') as slot, list_concat(roles, line) as line from edits join inserts using (s1)),
path as (select distinct conv, cast(0 as bigint) as i, 'E' as s, {{'cost': 0, 'slots': '', 'lines': cast([] as varchar[])}} as w from checked
  union all select p.conv, p.i + 1, s2, min({{'cost': w.cost + price, 'slots': w.slots || slot, 'lines': list_concat(w.lines, line)}})
  from path p join steps t on t.conv = p.conv and t.i = p.i + 1 and t.s0 = p.s group by p.conv, p.i, s2),
ends as (select p.conv, min({{'cost': w.cost + more, 'slots': w.slots || letters, 'lines': list_concat(w.lines, roles)}}) as w
  from path p join (select conv, max(i) as i from checked group by conv) m on m.conv = p.conv and m.i = p.i join inserts on s0 = s where s1 in ('E', 'A') group by p.conv),
counts as (select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
  count(*) filter (fault = 'truncated') as truncated, count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal from checked group by conv)
select conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  cast(coalesce(w.cost, 0) as bigint) as cost, coalesce(replace(w.slots, ' ', ''), '') as audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv, conv_id from given) left join ends using (conv) left join counts using (conv)
"""
