"""The registered text queries against SQL or brute force on the small tables, and the pipeline's stages."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from check import kind, table
from fleetgauge.llm import langid, pieces, quality, queries, tokencount, toxicity
from fleetgauge.llm.common import crc_mod, stored
from fleetgauge.plans.views import TABLES
from test_documents import brute_hits, brute_lines, brute_near, brute_stats, distance, invented

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
NAMES = [
    "op1_warc", "op2_line_dedup", "op3_near_dedup", "op4_chat", "op5_sentencepiece", "op6_language_id", "op7_decontamination",
    "op8_quality_rules", "op9_toxicity", "op10_token_counts", "op11_vector_codes", "op12_collocations", "op13_exact_dedup",
]


def test_registered():
    assert set(NAMES) == set(queries.queries()) and {*NAMES, "pipeline"} <= set(contract.queries())
    assert set(queries.oracle_sql()) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    df = queries.queries()[name](spark, FOLDER)
    res = con.execute(queries.oracle_sql()[name])
    a, b = table(df.columns, df.collect()), table([d[0] for d in res.description], res.fetchall())
    assert a == b and [kind(v) for v in a[1][0]] == [kind(v) for v in b[1][0]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()


def result(spark, name, columns):
    return sorted(tuple(r) for r in queries.queries()[name](spark, FOLDER).select(*columns).collect())


def test_near_dedup(spark, docs):
    want = brute_near([(d["doc_id"], d["text"]) for d in docs])
    assert result(spark, "op3_near_dedup", ["doc_id", "n_shingles", "component_id", "kept"]) == want


def test_sentencepiece(spark, docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for d in docs:
        ids = own.encode(d["text"] or "")
        want.append((d["doc_id"], len(ids), digest(",".join(map(str, ids))), digest(own.decode(ids) if ids else "")))
    assert result(spark, "op5_sentencepiece", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want)


def test_language(spark, docs):
    got = {r["doc_id"]: r for r in queries.queries()["op6_language_id"](spark, FOLDER).collect()}
    held = [d for d in docs if got[d["doc_id"]]["held_out"]]
    assert len(got) == len(docs) and sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.93 * len(held)
    assert {r["lang_pred"] for r in got.values()} <= {d["lang"] for d in docs} | {"und"}


def test_language_by_plain_compression(spark, docs):
    """One call of the compressor per language and piece; the smallest sum, of equal ones the first name, and its lead."""
    import zstandard

    table_of = spark.read.parquet(f"{FOLDER}/documents.parquet")
    model = langid.fit(table_of, crc_mod(F.col("doc_id"), 4) != 2)
    got = {r["doc_id"]: r for r in queries.queries()["op6_language_id"](spark, FOLDER).collect()}
    made = []
    for content in model.contents:
        own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        own.precompute_compress(level=langid.LEVEL)
        made.append(zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    for d in docs:
        r = got[d["doc_id"]]
        if not any(c.isalpha() for c in d["text"] or ""):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        data = d["text"].lower().encode()
        n = max(1, -(-len(data) // langid.PIECE_BYTES))
        sums = {lang: sum(len(c.compress(data[i * len(data) // n : (i + 1) * len(data) // n])) for i in range(n)) for lang, c in zip(model.languages, made)}
        best = min(sums.values())
        second = min(v for lang, v in sums.items() if lang != r["lang_pred"])
        assert sums[r["lang_pred"]] == best and all(v > best for lang, v in sums.items() if lang < r["lang_pred"])
        assert r["margin"] == second - best and r["rejected"] == (r["margin"] < langid.MIN_MARGIN_BYTES or (second - best) / best < langid.MIN_MARGIN)


def test_toxicity_by_a_scan_of_all_terms(spark, docs):
    """Scores with the learned terms looked up by the table of edit distances, term after term."""
    import pyarrow as pa

    class Scan(toxicity.Lexicon):
        def match(self, word):
            if len(word) <= 2 or word in self.harmless:
                return None
            plain = word.translate(toxicity._SIGNS)
            for own, edits in ((word, 0), (plain, 1)):
                stems = [t for t in self.terms if t.endswith("*") and own.startswith(t[:-1])]
                if own in self.terms or stems:
                    return (own if own in self.terms else max(stems, key=len)), edits
            for own in dict.fromkeys((word, plain)):
                near = [t for t in self.terms if self._fuzzy(t) and abs(len(t) - len(own)) <= 1 and distance(own, t) <= 1]
                if near:
                    return max(near, key=lambda t: (self.terms[t], t)), 1
            return None

    held = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held), ~held)
    scan = Scan(model.lexicon.terms, model.lexicon.harmless, model.lexicon.literal)
    want = model.score(toxicity.features(pa.array([d["text"] for d in docs], pa.string()), scan))
    got = {r["doc_id"]: r["score"] for r in queries.queries()["op9_toxicity"](spark, FOLDER).collect()}
    assert max(abs(got[d["doc_id"]] - w) for d, w in zip(docs, want, strict=True)) < 1e-9


def test_long_and_joined_words_are_looked_up():
    import pyarrow as pa

    lexicon = toxicity.Lexicon({"gromble": 3.0})
    texts = ["gromble" + "!" * 500, "gromble,gromble", "a/gromble/b", "x" * 5000 + ",gromble", "an-gromblle", "grombles-x", "nothing,here", "x" * 5000]
    found = toxicity.features(pa.array(texts), lexicon)[:, 0] > 0
    assert found.tolist() == [True] * 6 + [False] * 2


def test_token_counts_by_another_library(spark, docs):
    """Every token of the other library's encoding belongs to the line of its first byte."""
    import public_tokenizers
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    size = tokencount.encoder(tokencount.vocabulary_path(), tokencount.pattern())[0].decode_single_token_bytes
    got = {r["doc_id"]: r for r in queries.queries()["op10_token_counts"](spark, FOLDER).collect()}
    for d in docs:
        data = (d["text"] or "").encode()
        ids = other.encode(d["text"] or "", add_special_tokens=False).ids
        line, at, counts, crossing = 0, 0, [0] * (data.count(b"\n") + 1), 0
        for i in ids:
            n = len(size(i))
            counts[line] += 1
            crossing += b"\n" in data[at : at + n - 1]
            line += data[at : at + n].count(b"\n")
            at += n
        r = got[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["section_tokens"] == ",".join(map(str, counts)) and r["crossing"] == crossing


def test_verdicts_of_quality_rules(spark, docs):
    """The learned rules, tried in order by hand on statistics counted by hand."""
    import unicodedata

    table_of = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rules = quality.learn(stored(quality.training_rows(quality.statistics(table_of, keep=["doc_id"]), spark.read.parquet(f"{FOLDER}/labels.parquet")), "labelled"))
    got = {r["doc_id"]: r for r in queries.queries()["op8_quality_rules"](spark, FOLDER).collect()}
    for d in docs:
        n, chars, symbols, dup, repeat = brute_stats(d["text"])
        upper = sum(unicodedata.category(c) == "Lu" for c in d["text"] or "")
        marks = sum(c in "!?" for c in d["text"] or "")
        part = lambda a, b: a / b if b else 0.0
        facts = {"words": float(n), "chars_a_word": part(chars, n), "symbols_a_word": part(symbols, n), "dup_lines_a_100_words": part(dup, n) * 100,
                 "repeated": part(repeat, n), "capitals": part(upper, chars), "marks_a_word": part(marks, n)}
        meets = lambda c: facts[c.name] > c.cut if c.above else facts[c.name] <= c.cut
        first = next((i for i, rule in enumerate(rules, 1) if all(meets(c) for c in rule.conditions)), None)
        failed = n < 50 or 100 * repeat > 50 * n
        assert (got[d["doc_id"]]["rule"], got[d["doc_id"]]["kept"]) == (first, first is None and not failed)


def test_quality(spark, docs):
    got = {r["doc_id"]: r for r in queries.queries()["op8_quality_rules"](spark, FOLDER).collect()}
    for d in docs:
        r, s = got[d["doc_id"]], brute_stats(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == s
        assert r["base_failed"] == (s[0] < 50 or 100 * s[4] > 50 * s[0]) and not (r["kept"] and r["base_failed"])


def test_toxicity(spark, docs):
    got = {r["doc_id"]: r for r in queries.queries()["op9_toxicity"](spark, FOLDER).collect()}
    assert set(got) == {d["doc_id"] for d in docs}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())


def test_token_counts(spark, docs):
    got = {r["doc_id"]: r for r in queries.queries()["op10_token_counts"](spark, FOLDER).collect()}
    for d in docs:
        counts = [int(x) for x in got[d["doc_id"]]["section_tokens"].split(",")]
        assert sum(counts) == got[d["doc_id"]]["n_tokens"] and len(counts) == (d["text"] or "").count("\n") + 1


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Each stage on its predecessor's rows: what stays, and how it is changed."""
    draw = random.Random(3)
    texts = invented(31, 60, 80)
    texts += [texts[0] + " more", texts[1], texts[2].upper(), None, "", "12 34", "a shared line of text\n" + texts[3], "a shared line of text\n" + texts[4]]
    items = [(i, t) for i, t in enumerate(invented(32, 5, 40))]
    texts += [items[0][1], texts[5] + " " + items[1][1]]
    draw.shuffle(texts)
    rows = [(i, t, "xx", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    stages, folder = dict(corpus_pipeline.STAGES), str(tmp_path)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    plain = lambda x: sorted((r["doc_id"], r["text"]) for r in x.collect())

    one = stages["language_id"](spark, spark.read.parquet(f"{folder}/documents.parquet"), folder)
    assert one.columns == df.columns and plain(one) == sorted((i, t) for i, t, *_ in rows if re.search(r"[^\W\d_]", t or ""))
    two = stages["line_dedup"](spark, one, folder)
    assert two.schema == df.schema and plain(two) == [(i, t) for i, _, _, t in sorted(brute_lines(plain(one)))]
    assert all(r["n_chars"] == len(r["text"]) for r in two.collect())
    three = stages["near_dedup"](spark, two, folder)
    kept = {i for i, _, _, k in brute_near(plain(two), corpus_pipeline.PERCENT) if k}
    assert three.schema == df.schema and plain(three) == [x for x in plain(two) if x[0] in kept]
    four = stages["decontamination"](spark, three, folder)
    clean = {r[0] for r in brute_hits(plain(three), items) if not r[5]}
    assert four.schema == df.schema and plain(four) == [x for x in plain(three) if x[0] in clean]
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    last = {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in stages["sentencepiece"](spark, four, folder).collect()}
    want = {i: (len(own.encode(t)), own.encode(t)) for i, t in plain(four)}
    assert last == want and 0 < len(want) < len(texts)
    assert {r["doc_id"]: (r["n_tokens"], r["ids"]) for r in corpus_pipeline.run(spark, folder).collect()} == want


def test_stages_pass_columns_of_any_name(spark, tmp_path):
    """Columns named like results, like names used inside, or with dots come out of every filtering stage as they went in."""
    odd = ["rejected", "Score", "lang_pred", "__of", "__drop", "lines", "kept_text", "N_LINES", "__id", "kept", "id", "row", "rest", "of",
           "n_words", "items", "Ranges", "contaminated", "__n", "__merged", "__ranges0", "a.b", "c 0", "c1"]
    texts = invented(33, 6, 30)
    rows = [(i, t, "xx", "s", len(t), *[f"{c}{i}" for c in odd]) for i, t in enumerate(texts)]
    ddl = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in odd)
    docs = spark.createDataFrame(rows, ddl)
    spark.createDataFrame([(1, "nothing of the kind")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        assert sorted(tuple(r) for r in got.collect()) == rows, name
    last = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert last.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and last.count() == len(rows)


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert 0 < out.count() < spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0 and out.where(crc_mod(F.col("doc_id"), 4) == 2).count() > 0
