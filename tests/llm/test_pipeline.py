import random
import re
import uuid

import corpus_pipeline
import numpy as np
import public_tokenizers
import zlib
from test_decontaminate import LOWER, PATTERN
from test_jaccard import plain_groups
from tokenizers import Tokenizer

from waymark.session import scratch_dir

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def make(seed=5):
    r = random.Random(seed)
    words = {"en": ["the", "house", "water", "green", "walk", "stone", "light"], "fr": ["le", "maison", "été", "vert", "marche", "pierre", "jour"]}
    passage = " ".join(r.choice("alpha beta gamma delta".split()) for _ in range(14))
    item_two = "one two three four five six"
    docs = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        line = lambda n: " ".join(r.choice(words[lang]) + str(r.randint(0, 30)) for _ in range(n))
        lines = [line(r.randint(3, 12)) for _ in range(r.randint(2, 6))]
        if i % 5 == 0:
            lines.insert(1, "This very line is repeated in many documents")
        if i % 7 == 0:
            lines.append(f"before {passage} behind {line(20)}")
        if i % 11 == 0:
            lines = [passage]
        docs.append("\n".join(lines))
    for i in (3, 4, 9):
        changed = docs[i].split(" ")
        changed[len(changed) // 2] = "changed"
        docs += [docs[i], " ".join(changed)]
    docs += [None, "", "12 34 !!", item_two, " ".join(words["en"] * 3), "the " * 3000]
    r.shuffle(docs)
    langs = [("fr" if t and ("maison" in t or "été" in t or "pierre" in t) else "en") for t in docs]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, (t, lang) in enumerate(zip(docs, langs))], [(1, passage.title()), (2, item_two), (3, None)]


def plain_lines(docs):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x).translate(LOWER)
    holders = {}
    for i, t in docs:
        for x in t.split("\n"):
            holders.setdefault(key(x), set()).add(i)
    return [(i, "\n".join(x for x in t.split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == i)) for i, t in docs]


def plain_clean(docs, items):
    windows = {}
    for _, t in items:
        w = PATTERN.findall((t or "").translate(LOWER))
        for p in range(max(len(w) - 9, 1) if w else 0):
            windows[tuple(w[p : p + 10])] = True
    out = []
    for i, t in docs:
        spans = [m.span() for m in WORD.finditer(t)]
        w, hit = [t[a:b].translate(LOWER) for a, b in spans], set()
        for p in range(len(w)):
            for size in {len(x) for x in windows}:
                if tuple(w[p : p + size]) in windows:
                    hit |= set(range(p, p + size))
        if 2 * len(hit) > len(w):
            continue
        text, at, k = "", 0, 0
        while k < len(w):
            if k in hit:
                end = k
                while end + 1 in hit:
                    end += 1
                text, at, k = text + t[at : spans[k][0]], spans[end][1], end + 1
            else:
                k += 1
        out.append((i, text + t[at:]))
    return out


def plain_pieces(docs):
    tokenizer, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            out.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    return out


def test_rows_equal_the_stages_in_plain_python(spark):
    docs, items = make()
    folder = f"{scratch_dir(spark)}/pipe-{uuid.uuid4().hex}"
    spark.createDataFrame(docs, COLUMNS).repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    kept = [(i, t) for i, t, *_ in docs if t and any(c.isalpha() for c in t)]
    lined = plain_lines(kept)
    groups = plain_groups([t for _, t in lined], 5, 80)
    first = [lined[k] for k, _, group in groups if group == k]
    clean = plain_clean(first, items)
    assert len(docs) > len(kept) > len(first) > len(clean) and lined != kept and clean != [x for x in first if x[0] in dict(clean)]

    state, expected = spark.read.parquet(f"{folder}/documents.parquet"), [kept, lined, first, clean]
    for (_, stage), wanted in zip(corpus_pipeline.STAGES, expected):
        state = stage(spark, state, folder)
        assert state.columns == COLUMNS.replace(" long", "").replace(" string", "").split(", ")
        rows = state.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(wanted)
        assert all(r["n_chars"] == len(r["text"]) for r in rows)
    found = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == plain_pieces(clean)
    places = {}
    for r in sorted(found, key=lambda r: r["offset"]):
        assert places.get(r["sequence_id"], 0) == r["offset"]
        places[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(places.values()) <= 2048 and len(places) <= -(-sum(r["length"] for r in found) // 2048) + 1


def test_stage_list():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "packing"]


def test_empty_documents(spark):
    folder = f"{scratch_dir(spark)}/pipe-{uuid.uuid4().hex}"
    spark.createDataFrame([], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).collect() == []
