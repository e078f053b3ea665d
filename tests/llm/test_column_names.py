"""Every operator that passes columns on does so whatever their names are."""

import pytest
from pyspark.sql import functions as F

from fleetgauge.llm import decontam, exactdup, langid, linededup, neardup, pieces, quality, tokencount, toxicity

ODD = ["__of", "__drop", "__lines", "__id", "__id_", "__n", "__merged", "__facts", "__text", "__starts", "__row", "row", "facts", "id", "of", "words",
       "repeated", "capitals", "at", "name", "a.b", "c 0", "c1", "key", "root", "Lines"]
TEXTS = ["one two three four five six", "one two three four five six", "a long shared line\nand its own", "a long shared line\nother words", None, ""]


def frame(spark):
    rows = [(i, t, "en", *[f"{c}{i}" for c in ODD]) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, " + ", ".join(f"`{c}` string" for c in ODD)), rows


def passed(spark):
    model = langid.Model(("en", "fr"), (b"one two three four", b"un deux trois quatre"))
    lexicon = toxicity.Model(toxicity.Lexicon({"three": 1.0}), toxicity.np.zeros(toxicity.FEATURES + 1))
    items = spark.createDataFrame([(1, "two three four")], "item_id bigint, text string")
    return {
        "lines": lambda df: linededup.drop_repeated_lines(df),
        "near": lambda df: neardup.drop_near_copies(df),
        "exact": lambda df: exactdup.drop_copies(df),
        "language": lambda df: langid.identify(df, model),
        "decontamination": lambda df: decontam.contamination(df, items),
        "quality": lambda df: quality.judge(quality.statistics(df), [quality.Rule((quality.Condition("capitals", True, 0.5),))]),
        "toxicity": lambda df: toxicity.score(df, lexicon),
        "tokens": lambda df: tokencount.attribute(df),
        "pieces": lambda df: pieces.decode(pieces.encode(df, pieces.model_path()), pieces.model_path()),
    }


@pytest.mark.parametrize("name", ["lines", "near", "exact", "language", "decontamination", "quality", "toxicity", "tokens", "pieces"])
def test_columns_pass(spark, name):
    df, rows = frame(spark)
    got = passed(spark)[name](df)
    assert set(df.columns) - set(got.columns) <= {"text"}
    found = got.select(*[F.col(f"`{c}`") for c in df.columns if c not in ("text", "lang")]).collect()
    want = {r[0]: (r[0], *r[3:]) for r in rows}
    assert all(tuple(r) == want[r[0]] for r in found) and len(found) >= 4


@pytest.mark.parametrize("name", ["lines", "language", "decontamination", "quality", "toxicity", "tokens"])
def test_results_replace_columns_of_their_names_in_any_case(spark, name):
    df, _ = frame(spark)
    results = passed(spark)[name](df).columns
    upper = [c for c in results if c not in df.columns]
    got = passed(spark)[name](df.withColumns({c.upper(): F.lit("own") for c in upper}))
    assert [c for c in got.columns if c.lower() in {u.lower() for u in upper}] == upper and got.count() == len(TEXTS)
