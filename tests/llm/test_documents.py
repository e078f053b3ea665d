"""Operators on documents against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetgauge.llm import bytescan, decontam, langid, linededup, neardup, pieces, quality, tokencount, toxicity
from fleetgauge.llm.common import stored

DDL = "doc_id bigint, text string, lang string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def documents(spark, texts, extra=""):
    return spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], DDL).repartition(3)


def invented(seed, n, words=60, vocabulary=400):
    draw = random.Random(seed)
    names = ["".join(draw.choices("abcdeéßü", k=draw.randint(1, 7))) for _ in range(vocabulary)]
    return [" ".join(draw.choices(names, k=draw.randint(1, words))) for _ in range(n)]


ODD = [None, "", " ", "\n\n", "x", "é", "A\tB\x0bC\x0cD\rE", "日本語 テキスト", "a" * 300_000, "word " * 30_000, "😀 😀", "\x00 zero"]


# Byte scanner ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [16, 1 << 20])
def test_words_and_hashes(monkeypatch, block):
    monkeypatch.setattr(bytescan, "BLOCK", block)
    bytescan._tables.cache_clear()
    texts = [t for t in ODD if t is None or len(t) < 1000] + invented(1, 50) + ["Ab aB AB", "tail", "head"]
    found = bytescan.words(pa.array(texts, pa.string()).slice(1), bytescan.blank_separated())
    by_hash = {}
    for i, t in enumerate(texts[1:]):
        a, b = found.first[i], found.first[i + 1]
        own = WORD.findall(lower(t))
        assert [found.text(k, k + 1).decode() for k in range(a, b)] == [w.encode().lower().decode() for w in own]
        for w, h in zip(own, found.hashes[a:b].tolist()):
            assert by_hash.setdefault(w, h) == h
    assert len(set(by_hash.values())) == len(by_hash)
    bytescan._tables.cache_clear()


# Lines ------------------------------------------------------------------------------------------------------


def brute_lines(docs, min_docs=2):
    key = lambda x: lower(x.strip(" \t\n\x0b\x0c\r"))
    held = collections.defaultdict(set)
    for i, t in docs:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10 and i is not None:
                held[key(x)].add(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(held[key(x)]) < min_docs or i == min(held[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_docs", [2, 3])
def test_repeated_lines(spark, min_docs):
    draw = random.Random(3)
    lines = invented(2, 40, 6) + ["Same LINE here", "same line HERE  ", "\tSAME line here", "ÉTÉ LONG LINE", "été long line", "short", ""]
    docs = [(i, "\n".join(draw.choices(lines, k=draw.randint(1, 12)))) for i in range(60)]
    docs += [(60, None), (61, ""), (62, "common line of all\n" * 500), (63, "common line of all"), (None, "common line of all"), (None, None)]
    docs += [(64, "twice in this row only\ntwice in this row only"), (5, "Same LINE here\nother text of the id"), (7, docs[7][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, n_lines int").repartition(4)
    found = linededup.drop_repeated_lines(df, min_docs=min_docs)
    assert rows(found.select("doc_id", "n_lines", "n_dropped", "kept_text")) == brute_lines(docs, min_docs)
    assert found.columns == ["doc_id", "text", "n_lines", "n_dropped", "kept_text"]
    assert linededup.drop_repeated_lines(df.limit(0)).count() == 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# Near copies ----------------------------------------------------------------------------------------------


def brute_near(docs, percent=85):
    sets = {}
    for i, t in docs:
        w = WORD.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return sorted((i, len(sets[i]), find(i), find(i) == i) for i in ids)


def near_texts():
    draw = random.Random(5)
    bases = invented(4, 12, 90)
    out = list(bases)
    for base in bases[:6]:  # chains of variants, each some words away from another
        line = base.split()
        for _ in range(25):
            line = list(line)
            for _ in range(draw.randint(0, 2)):
                line[draw.randrange(len(line))] = draw.choice("uvwxyz") * 3
            out.append(" ".join(line))
            if draw.random() < 0.3:
                line = base.split()
    out += [bases[0].upper(), bases[0] + " ", bases[1]] * 5 + ["one two", "ONE two", "one  two\n", "one", None, "", " ", None]
    draw.shuffle(out)
    return out


def test_near_copies(spark):
    texts = near_texts()
    df = documents(spark, texts).withColumn("component_id", F.lit("clash")).withColumn("id", F.lit(1))
    found = neardup.near_copies(df)
    want = brute_near(list(enumerate(texts)))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == want
    left = neardup.drop_near_copies(df)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [w[0] for w in want if w[3]]


def test_near_copies_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (2, "A b c d e f"), (9, "z" * 100_000), (None, None)], "doc_id bigint, text string")
    got = rows(neardup.near_copies(df))
    assert got == sorted([(None, 2, 2, True), (3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (9, 1, 9, True), (None, 0, None, True)], key=repr)
    assert neardup.near_copies(df.limit(0)).count() == 0
    few, many = neardup.BROADCAST_IDS, 0
    try:
        neardup.BROADCAST_IDS = many
        assert rows(neardup.near_copies(df)) == got
    finally:
        neardup.BROADCAST_IDS = few


def test_near_copies_of_a_divided_family(spark, monkeypatch):
    """Forms with filled slots share wide buckets; most linked pairs have no pivot among them."""
    monkeypatch.setattr(neardup, "FIRST", (12, 1))
    monkeypatch.setattr(neardup, "SECOND", (2, 1))
    draw = random.Random(11)
    form = [f"label{k} of the part {k}" for k in range(26)]
    made = [[min(int(draw.expovariate(0.4)), 9) for _ in form] for _ in range(90)]
    for own in made[:60] * 2:  # one slot filled otherwise
        k = draw.randrange(len(form))
        made.append(own[:k] + [own[k] + draw.choice([10, 20])] + own[k + 1 :])
    draw.shuffle(made)
    texts = [" ".join(f"{a} v{b}" for a, b in zip(form, own, strict=True)) for own in made]
    found = neardup.near_copies(documents(spark, texts))
    want = brute_near(list(enumerate(texts)))
    assert 60 <= sum(not w[3] for w in want) and 50 <= sum(w[3] for w in want)
    assert [tuple(r) for r in found.orderBy("doc_id").collect()] == want


def test_candidates_grow_with_the_members_of_a_family(spark, monkeypatch):
    """Texts that mostly differ by a little more than the limit: twice as many give about twice as many pairs, not four times."""
    seen = []
    keep = neardup.stored

    def counted(df, name):
        out = keep(df, name)
        seen.append(out.count() if name == "pairs" else 0)
        return out

    monkeypatch.setattr(neardup, "stored", counted)
    totals = []
    for n in (150, 300):
        draw = random.Random(21)
        base = [f"w{k}" for k in range(60)]
        texts = []
        for _ in range(n):
            own = list(base)
            own[draw.randrange(60)] = draw.choice("abcdef") * 5
            texts.append(" ".join(own))
        seen.clear()
        neardup.near_copies(documents(spark, texts)).collect()
        totals.append(sum(seen))
    assert 0 < totals[1] < 2.8 * totals[0] and totals[1] < 64 * 300


def test_rows_that_repeat_ids_are_not_multiplied(spark):
    docs = [(5, "one two three four five six seven eight nine ten")] * 30 + [(6, "one two three four five six seven eight nine ten eleven")] * 30
    got = neardup.near_copies(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["component_id"], r["n_shingles"]) for r in got.collect()) == [(5, 5, 6)] * 30 + [(6, 5, 7)] * 30
    more = neardup.near_copies(spark.createDataFrame([*docs, (6, "another text of some six words")], "doc_id bigint, text string"))
    assert sorted((r["doc_id"], r["n_shingles"]) for r in more.collect()) == [(5, 6)] * 30 + [(6, 2)] + [(6, 7)] * 30


def test_components(spark):
    draw = random.Random(8)
    links = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(draw.randrange(500, 600), draw.randrange(500, 600)) for _ in range(60)] + [(7, 7)]
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert neardup.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# SentencePiece ------------------------------------------------------------------------------------------------


def test_pieces_equal_the_library(spark, monkeypatch):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    draw = random.Random(1)
    parts = [" ", "  ", "\n", "▁", "a", "the", "é", "Ⅳ", "\t", "\x00", "</s>", "<s>", "<unk>", "<0x0A>", "𝒳", "\r\n", "　", "\xa0", "ab"]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 12))) for _ in range(1500)] + invented(6, 100) + [t for t in ODD if t is None or len(t) < 200_000]
    df = documents(spark, texts).withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 500)
    found = pieces.encode(df, pieces.model_path())
    got = {r["doc_id"]: r["ids"] for r in found.collect()}
    assert got == {i: own.encode(t or "") for i, t in enumerate(texts)}
    back = {r["doc_id"]: r["decoded"] for r in pieces.decode(found.withColumn("decoded", F.lit(0)), pieces.model_path()).collect()}
    assert back == {i: own.decode(x) if x else "" for i, x in got.items()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    trip = pieces.round_trip(df, pieces.model_path(), keep=["doc_id"])
    assert rows(trip) == sorted([(i, len(x), digest(",".join(map(str, x))), digest(back[i])) for i, x in got.items()], key=repr)
    assert pieces.encode(df.limit(0), pieces.model_path()).count() == 0


def test_pieces_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id bigint, text string")
    got = rows(pieces.encode(df, pieces.model_path()))
    assert got[0] == got[1] and (None, []) in [tuple(r) for r in got]


def test_pieces_keep_common_chunks(monkeypatch):
    """A chunk that every slice holds is segmented once, also when the table is full again and again."""
    path = pieces.model_path()
    own, asked = pieces.segmenter(path), []
    segment = own._segment
    monkeypatch.setattr(pieces, "TABLE_ENTRIES", 250)
    monkeypatch.setattr(pieces, "text_map", lambda docs, text, keep, fields, function, limit: function)
    monkeypatch.setattr(own, "table", {})
    monkeypatch.setattr(own, "_segment", lambda chunks: asked.extend(chunks) or segment(chunks))
    trip = pieces.round_trip(None, path, keep=[])
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for k in range(10):
        text = " ".join([*[f"common{i}" for i in range(100)], *[f"own{k}x{i}" for i in range(60)]])
        ids = own.model.encode(text)
        assert [c.to_pylist() for c in trip(pa.array([None, text, ""]))] == [
            [0, len(ids), 0], [digest(""), digest(",".join(map(str, ids))), digest("")], [digest(""), digest(own.model.decode(ids)), digest("")]
        ]
    assert len(asked) == 100 + 10 * 60


# Language ----------------------------------------------------------------------------------------------------


def tongue(seed, syllables, n):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choices(syllables, k=draw.randint(2, 4)))
    names = [word() for _ in range(150)]
    return [" ".join(draw.choices(names, k=draw.randint(20, 80))) + "." for _ in range(n)]


def test_language_of_long_texts():
    """The relative margin doesn't fade with the length: a text many times as long is as clear."""
    draw = random.Random(9)
    syllables = ["".join(draw.choices("abcdefghiklmnoprstuvz", k=2)) for _ in range(90)]
    own = lambda: ["".join(draw.choices(syllables, k=draw.randint(2, 4))) for _ in range(6000)]
    names = {"xx": own(), "yy": own()}
    text = lambda k, n: " ".join(draw.choices(names[k], k=n)).encode()
    model = langid.Model(("xx", "yy"), tuple(text(k, 10_000)[: langid.DICTIONARY_BYTES] for k in names))
    short, long = (langid.classify(text("yy", n), model) for n in (7_000, 600_000))
    assert short[0] == long[0] == "yy" and long[3] >= langid.MIN_MARGIN
    assert long[3] > short[3] / 2


def test_language(spark):
    one, two = tongue(1, ["ka", "ro", "mi", "tu", "sel"], 120), tongue(2, ["öst", "gen", "sch", "ein", "ver"], 120)
    data = [(i, t, "xx") for i, t in enumerate(one)] + [(200 + i, t, "yy") for i, t in enumerate(two)]
    data += [(500, None, "xx"), (501, "", "xx"), (502, "123 !!", "yy"), (503, one[0], None), (504, "q", "xx")]
    df = spark.createDataFrame(data, DDL).withColumn("score", F.lit("clash"))
    model = langid.fit(df, F.col("doc_id") % 4 != 2)
    assert model.languages == ("xx", "yy") and all(0 < len(c) <= langid.DICTIONARY_BYTES for c in model.contents)
    assert model == langid.fit(df.repartition(7), F.col("doc_id") % 4 != 2)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    held = [(i, lang) for i, _, lang in data if i < 500 and i % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    assert all(got[i]["lang_pred"] == "und" and got[i]["rejected"] and got[i]["score"] == 0 for i in (500, 501, 502))
    assert got[503]["lang_pred"] == "xx" and not got[503]["rejected"] and got[504]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and not any(got[i]["rejected"] for i, _ in held)
    none = langid.fit(df.limit(0), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"} and langid.identify(df.limit(0), model).count() == 0


# Benchmark passages ------------------------------------------------------------------------------------------


def brute_hits(docs, items, window=13):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    own = [("" if i is None else str(i), word.findall(lower(t))) for i, t in items]
    out = []
    for i, t in docs:
        w, hit, seen = word.findall(lower(t)), set(), set()
        for name, x in own:
            n = min(window, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    seen.add(name)
        out.append((i, len(w), len(hit), len(seen), sorted(seen), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 60])
def test_contamination(spark, block):
    draw = random.Random(9)
    items = [(i, t) for i, t in enumerate(invented(10, 12, 40, 60))] + [(20, "Tiny item"), (21, "x"), (22, None), (23, " !! "), (20, "tiny ITEM"), (None, "null id item words here")]
    items += [(30, items[0][1]), (31, " ".join(["same"] * 20))]
    docs = []
    for i in range(60):
        part = invented(100 + i, 1, 50, 60)[0].split()
        if i % 3 == 0:
            x = draw.choice(items[:12])[1].split()
            a = draw.randrange(len(x))
            at = draw.randrange(len(part) + 1)
            part[at:at] = x[a : a + draw.randint(1, 30)]
        docs.append((i, ("-" if i % 5 else " ").join(part)))
    docs += [(100, None), (101, ""), (102, "a TINY item, a tiny. item x"), (103, "same " * 40), (104, items[0][1].upper()), (105, "null id item words here"), (106, "日本 " * 5000), (106, "x")]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id bigint, text string, n_words int").repartition(3)
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.contamination(df, table, block_words=block)
    names = ["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"]
    assert [tuple(r) for r in rows(found.select(*names))] == brute_hits(docs, items)
    assert found.columns == ["doc_id", "text", "n_words", "n_hit", "n_items", "items", "ranges", "contaminated"]
    for r in found.collect():
        assert sum(x["b"] - x["a"] for x in r["ranges"]) >= r["n_hit"]


def test_contamination_of_nothing(spark):
    df = documents(spark, ["a b", None])
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert rows(decontam.contamination(df, empty, keep=["doc_id"]).select("doc_id", "n_words", "n_hit", "contaminated")) == [(0, 2, 0, False), (1, 0, 0, False)]
    assert decontam.contamination(df.limit(0), empty).count() == 0


# Quality ------------------------------------------------------------------------------------------------------


def brute_stats(t):
    t = t or ""
    w = WORD.findall(t)
    count, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    texts = ODD + invented(12, 40, 80, 8) + ["a b c a b c", "a b c a b", "a\na\n b\na\n\n\n", "#*$%&|<> x!?", "a a a a a"]
    found = quality.statistics(documents(spark, texts).withColumn("n_words", F.lit(9)))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in found.collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(texts)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_rules_are_learned_and_pruned(spark):
    draw = random.Random(2)
    words = invented(13, 1, 400, 300)[0].split()
    data, labels = [], []
    for i in range(600):
        own = [draw.choice(words) for _ in range(draw.randint(60, 120))]
        bad = i % 5 == 0
        if bad and i % 2:
            own = [w + "###" for w in own]
        elif bad:
            own = [w.upper() + "!!" for w in own]
        data.append((i, " ".join(own)))
        labels.append((i, int(not bad)))
    labels += [(3, None), (None, 0), (9999, 0)]
    stats = stored(quality.statistics(spark.createDataFrame(data, "doc_id bigint, text string")), "statistics")
    known = spark.createDataFrame(labels, "doc_id bigint, quality int")
    train = stored(quality.training_rows(stats, known.where("doc_id % 3 != 1")), "labelled")
    rules = quality.learn(train)
    assert rules and all(str(r).startswith("drop if ") and len(r.conditions) <= quality.MAX_CONDITIONS for r in rules)
    got = {r["doc_id"]: r["kept"] for r in quality.judge(stats, rules).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert np.mean([got[i] == (i % 5 != 0) for i in held]) > 0.97
    assert quality.learn(train.where("not bad")) == [] and quality.learn(train.limit(0)) == []
    assert quality.judge(quality.statistics(documents(spark, [None, "few words"])), rules).where("kept").count() == 0


# Toxicity -----------------------------------------------------------------------------------------------------


def distance(a, b):
    """Edits with neighbours changed, by the table."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_on_trie():
    draw = random.Random(4)
    terms = sorted({"".join(draw.choices("abc", k=draw.randint(5, 8))) for _ in range(12)})
    lexicon = toxicity.Lexicon({t: 1.0 + i / 100 for i, t in enumerate(terms)})
    for _ in range(4000):
        word = list(draw.choice(terms)) if draw.random() < 0.8 else draw.choices("abc", k=draw.randint(3, 9))
        for _ in range(draw.randint(0, 2)):
            k = draw.randrange(len(word))
            word[k : k + draw.randint(0, 2)] = draw.choices("abcd", k=draw.randint(0, 2))
            word = word or ["a"]
        word = "".join(word)
        near = [t for t in terms if distance(word, t) <= 1]
        assert lexicon._within_one(word) == (max(near, key=lambda t: (lexicon.terms[t], t)) if near else None)
    stem = toxicity.Lexicon({"vequ*": 3.0, "stupid": 2.0}, frozenset({"stupit"}))
    assert stem.match("vequaire") == ("vequ*", 0) and stem.match("stup1d") == ("stupid", 1) and stem.match("stpuid") == ("stupid", 1)
    assert stem.match("stupit") is None and stem.match("veq") is None and stem.match("stupidly") is None
    assert toxicity.Lexicon({"stupid": 2.0}, literal=frozenset({"stupid"})).match("stupit") is None


def test_toxicity(spark):
    draw = random.Random(6)
    slurs = ["gromble", "flarnik", "snuzzle"]
    data, labels = [], []
    for i, t in enumerate(invented(20, 600, 60, 500)):
        own = t.split()
        if i % 6 == 0:
            for _ in range(3):
                own.insert(draw.randrange(len(own) + 1), draw.choice(slurs))
        data.append((i, " ".join(own)))
        labels.append((i, int(i % 6 == 0)))
    data += [(1000, None), (1001, ""), (1002, "you gromblle and flarnk, go away"), (1003, 'they said "gromble" there'), (1004, data[0][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in data], "doc_id bigint, text string, score string")
    known = spark.createDataFrame(labels + [(1, None), (None, 1), (0, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, known, F.col("doc_id") % 5 != 0)
    assert set(model.lexicon.terms) == set(slurs)
    again = toxicity.fit(docs.repartition(5), known, F.col("doc_id") % 5 != 0)
    assert np.allclose(again.weights, model.weights) and again.lexicon.terms == model.lexicon.terms
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if i % 5 == 0]
    assert np.mean([got[i]["predicted"] == (i % 6 == 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[1002]["predicted"] == 1 and got[1003]["predicted"] == 0 and got[1000]["score"] == got[1001]["score"] < 0.5
    assert got[1004]["score"] == got[0]["score"]
    nothing = toxicity.fit(docs, known.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, nothing).collect()} == {0.5} and toxicity.score(docs.limit(0), model).count() == 0


# Tokens of sections --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", tokencount.RULES)
def test_attribution(spark, rule):
    from tokenizers import Tokenizer

    import public_tokenizers

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    draw = random.Random(11)
    texts = ["a\n\nb", "one\n  two", " \n \n ", "tail\n", "naïve é\n日本語テキスト\n😀😀", *invented(14, 30), None, ""]
    texts += ["\n".join(invented(15 + k, 3, 6)) for k in range(10)]
    cuts = [sorted(draw.choices(range(len(t or "") + 2), k=draw.randint(0, 4))) for t in texts]
    df = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(zip(texts, cuts))], "doc_id bigint, text string, starts array<int>")

    def brute(text, starts):
        data = (text or "").encode()
        at = [len((text or "")[: min(s, len(text or ""))].encode()) for s in starts]
        at = ([0] if not at or at[0] > 0 else []) + at + [len(data)]
        out, crossing, done = [0.0] * (len(at) - 1), 0, 0
        ids = other.encode(text or "", add_special_tokens=False).ids
        size = lambda i: len(tokencount.encoder(tokencount.vocabulary_path(), tokencount.pattern())[0].decode_single_token_bytes(i))
        for i in ids:
            share = [max(0, min(b, done + size(i)) - max(a, done)) for a, b in zip(at, at[1:])]
            own = [k for k, s in enumerate(share) if s]
            crossing += len(own) > 1
            if rule == "share":
                for k in own:
                    out[k] += share[k] / size(i)
            else:
                out[{"first": own[0], "last": own[-1], "most": max(own, key=lambda k: (share[k], -k))}[rule]] += 1
            done += size(i)
        return len(ids), out, crossing

    for starts in (None, "starts"):
        got = {r["doc_id"]: r for r in tokencount.attribute(df, starts=starts, rule=rule).collect()}
        for i, t in enumerate(texts):
            lines = [0] + [k + 1 for k, c in enumerate(t or "") if c == "\n"]
            n, sections, crossing = brute(t, lines if starts is None else cuts[i])
            assert got[i]["n_tokens"] == n and got[i]["crossing"] == crossing
            assert np.allclose(got[i]["section_tokens"], sections) and np.isclose(sum(got[i]["section_tokens"]), n)


def test_attribution_edges(spark):
    with pytest.raises(ValueError, match="rule"):
        tokencount.attribute(documents(spark, []), rule="none")
    whole, starts = tokencount.field_document(F.col("lang"), F.col("text"), F.lit(None))
    df = documents(spark, ["some text", None]).select("doc_id", whole.alias("whole"), starts.alias("starts"), F.lit(1).alias("crossing"))
    got = tokencount.attribute(df, "whole", "starts", keep=["doc_id"])
    assert all(len(r["section_tokens"]) == 3 and sum(r["section_tokens"]) == r["n_tokens"] for r in got.collect())
    long = documents(spark, [" " * 250_000 + "x" * 250_000 + " end"])
    assert tokencount.attribute(long, keep=["doc_id"]).first()["n_tokens"] > 0
    assert tokencount.attribute(df.limit(0), "whole").count() == 0


def test_long_runs_have_the_ids_of_the_whole():
    path, splits = tokencount.vocabulary_path(), tokencount.pattern()
    whole = tokencount.encoder(path, splits)[0].encode_ordinary
    draw = random.Random(8)
    size = tokencount.LONG_RUN + 1
    code = "".join(draw.choices("abcdefgh(){};=.,+01é日", k=2 * size))
    base64 = "".join(draw.choices("ABCDwxyz0189+/", k=3 * size))
    blank = "".join(draw.choices(" \t\n\r\u3000", k=size))
    runs = [code, base64, "日本語" * size, "7" * size, "x" * 2 * size, blank, " " * size, "\n" * size, "\x1c" * size]
    for run in runs:
        for text in (run, f"text of {run}", f"{run}word", f"a {run} b", f"{run}{blank}{run}!"):
            assert tokencount.encode(text, path, splits) == whole(text)
    # Ten times as long the library fails; the run is one match, and its last blank goes to the word.
    far = " " * 10 * size
    assert tokencount.encode(f"a{far}b", path, splits) == whole("a") + whole(" ") * (len(far) - 1) + whole(" b")
