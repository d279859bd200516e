import hashlib
import random
import re
from collections import defaultdict

from cases import awkward, documents, frame, rows

from waymark.llm import lines

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_chars, min_docs):
    key = lambda line: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(LOWER)
    holders = defaultdict(set)
    for i, t in docs:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = []
    for i, t in docs:
        all_ = (t or "").split("\n")
        kept = [x for x in all_ if len(key(x)) < min_chars or len(holders[key(x)]) < min_docs or i == max(holders[key(x)])]
        out.append((i, len(all_), len(all_) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def answer(df):
    return sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in df.collect())


def test_equals_brute_force(spark):
    r = random.Random(5)
    pool = ["a common line that is long enough", "A Common line that is long enough ", "another line of twenty", "é" * 20, "short", "", "nineteen characters", "\ttabbed line of some length\x0b"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(0, 40))) for _ in range(40)] + awkward()
    for partitions in ("4", "1"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        got = answer(lines.dedup_lines(documents(spark, texts)))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == brute(list(enumerate(texts)), 20, 3)


def test_bitmap_tells_the_lines_that_stay(spark):
    long = [f"a line number {i} of enough length" for i in range(40)]
    texts = ["\n".join(long), "\n".join(long[9:12]), "\n".join(long[10:12] + long[30:])]
    got = {r["doc_id"]: r for r in lines.dedup_lines(documents(spark, texts), min_docs=2).collect()}
    bits = "".join(f"{b:08b}" for b in got[0]["keep_bitmap"])
    kept = [line for i, line in enumerate(long) if i >= len(bits) or bits[i] == "1"]
    assert got[0]["text"] == "\n".join(kept) and len(kept) == 40 - 3 - 10
    assert got[2]["keep_bitmap"] is None and got[2]["text"] == texts[2]


def test_repeated_rows_and_null_ids(spark):
    text = "the same line in all of these rows\nown"
    docs = frame(spark, [(i, text, "en", "s", 1, "k", 1, "b", 1, 1, "f") for i in (1, 1, 2, 3, None, None)])
    got = sorted((r["doc_id"] or -1, r["n_dropped"], r["text"]) for r in lines.dedup_lines(docs).collect())
    assert got == [(-1, 1, "own"), (-1, 1, "own"), (1, 1, "own"), (1, 1, "own"), (2, 1, "own"), (3, 0, text)]


def test_empty_table_and_columns(spark):
    assert rows(lines.dedup_lines(documents(spark, []))) == []
    out = lines.dedup_lines(documents(spark, ["a"]))
    assert out.columns == [*documents(spark, []).columns, "n_lines", "n_dropped", "keep_bitmap"]


def test_names_that_clash_and_ids_as_text(spark):
    line = "the same line in all of these rows"
    names = "doc_id string, text string, _hash long, _owner string, _n int, _bitmap binary, _o long, _h long, row int, owner string, bitmap string, dropped int, hash int, body double"
    docs = spark.createDataFrame([(i, f"{line}\n{i}", 1, "o", 2, b"b", 3, 4, 5, "w", "m", 6, 7, 0.5) for i in ("a", "c", "b")] + [(None, line, 1, None, 2, b"", 3, 4, 5, "", "", 6, 7, None)], names)
    out = lines.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_dropped", "keep_bitmap"]
    got = {r["doc_id"]: (r["text"], r["n_dropped"]) for r in out.collect()}
    assert got == {"a": ("a", 1), "b": ("b", 1), "c": (f"{line}\nc", 0), None: ("", 1)}
    assert all(r["_hash"] == 1 and r["_h"] == 4 and r["row"] == 5 and r["bitmap"] in ("m", "") for r in out.collect())
