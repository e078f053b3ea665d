"""Language by compressed size.

For each language a bounded sample of labelled text serves as a raw-content
dictionary of zstandard. A text belongs to the language whose dictionary makes it
smallest; the difference to the second best is the margin. Dictionaries and texts are
lower-cased, so that the first word of a sentence is the word it is elsewhere.
"""

from __future__ import annotations

import functools
import hashlib
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetgauge.llm.common import named, others, text_map

#: Rows of each language looked at for its dictionary, chosen by a hash of their key and text.
SAMPLE_ROWS = 400
#: Bytes of each language's dictionary, made of whole lines of those rows.
DICTIONARY_BYTES = 64 << 10
#: A longer line, in characters, is cut at blanks into pieces of this length at most, so that it doesn't fill a dictionary alone.
LINE_CHARS = 500
#: Effort of the compressor. Lower levels look for matches too coarsely to tell short texts apart.
LEVEL = 6
#: Texts with a smaller difference between the best two, in bytes of compressed size, are rejected ...
MIN_MARGIN_BYTES = 2
#: ... and those where it is a smaller part of the best size.
MIN_MARGIN = 0.003
#: Longer texts are compressed in pieces of equal size, of this many bytes at most: a dictionary helps each of
#: them, while in one piece the text itself becomes the better dictionary and the margin fades.
PIECE_BYTES = 64 << 10
UNKNOWN = "und"


@dataclass(frozen=True)
class Model:
    """Dictionaries by language, in the order of the language names."""

    languages: tuple[str, ...]
    contents: tuple[bytes, ...]

    @property
    def key(self) -> str:
        return hashlib.sha1(b"\0".join([*(x.encode() for x in self.languages), *self.contents])).hexdigest()


def fit(docs: DataFrame, training: Column, text: str = "text", language: str = "lang", key: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS, dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Learn the dictionaries from rows that meet `training` and have a text and a language.

    About `sample_rows` rows of each language are drawn by a hash, so the choice doesn't
    depend on partitions; their lines fill the dictionary in the order of another hash.
    What reaches the driver is the count of each language and its dictionary.
    No labelled row: a model without languages, which calls every text `und`.
    """
    rows = docs.where(training & named(text).isNotNull() & named(language).isNotNull()).select(
        named(language).cast("string").alias("lang"), named(key).alias("key"), named(text).alias("text")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return Model((), ())
    share = F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, sample_rows / n)])[F.col("lang")]
    draw = F.pmod(F.xxhash64("key", F.lit("row")), F.lit(1 << 30)) < share * (1 << 30)
    pieces = F.regexp_extract_all("line", F.lit(rf"(?s).{{1,{LINE_CHARS}}}(?=\s|$)|.{{{LINE_CHARS}}}"), F.lit(0))
    short = F.when(F.char_length("line") > LINE_CHARS, pieces).otherwise(F.array("line"))
    lines = (
        rows.where(draw).select("lang", F.explode(F.split(F.lower("text"), "\n", -1)).alias("line"))
        .select("lang", F.explode(short).alias("line")).where(F.col("line").rlike(r"\p{L}")).distinct()
        .select("lang", "line", F.xxhash64("line").alias("at"))
    )
    # Of the bounded sample only lines that fit into the dictionary go on: their hash is under a bound
    # that would hold twice its bytes.
    total = {r["lang"]: r["n"] for r in lines.groupBy("lang").agg(F.sum(F.octet_length("line") + 1).alias("n")).collect()}
    part = F.create_map(*[F.lit(x) for k, n in sorted(total.items()) for x in (k, 2.0 * dictionary_bytes / n)])[F.col("lang")] if total else F.lit(0.0)
    chosen = lines.where(F.pmod("at", F.lit(1 << 30)) < part * (1 << 30)).orderBy("lang", F.pmod("at", F.lit(1 << 30)), "line").collect()
    contents: dict[str, list[bytes]] = {k: [] for k in sorted(sizes)}
    held = dict.fromkeys(sizes, 0)
    for r in chosen:
        line = r["line"].encode() + b"\n"
        if held[r["lang"]] + len(line) <= dictionary_bytes:
            held[r["lang"]] += len(line)
            contents[r["lang"]].append(line)
    return Model(tuple(contents), tuple(b"".join(x) for x in contents.values()))


@functools.lru_cache(maxsize=2)
def _compressors(key: str, contents: tuple[bytes, ...]):
    import zstandard

    out = []
    for c in contents:
        own = zstandard.ZstdCompressionDict(c, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(c) >= 8 else None
        if own is not None:
            own.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def classify(data: bytes, model: Model) -> tuple[str, float, int, float]:
    """Language, score, margin in bytes and margin as a part of the best size."""
    count = max(1, -(-len(data) // PIECE_BYTES))
    cuts = [i * len(data) // count for i in range(count + 1)]
    parts = [data[a:b] for a, b in zip(cuts, cuts[1:])]
    sizes = np.array([sum(len(c.compress(x)) for x in parts) for c in _compressors(model.key, model.contents)], float)
    best = int(sizes.argmin())  # of a tie the first in the order of names
    rest = np.delete(sizes, best)
    margin = float(rest.min() - sizes[best]) if len(rest) else float(sizes[best])
    # The sizes as code lengths: a byte is eight bits of evidence; shared matches make them less than independent.
    score = 1 / (1 + sum(math.exp(-min(700.0, (x - sizes[best]) / 2)) for x in rest))
    return model.languages[best], score, int(margin), margin / max(1.0, sizes[best])


def identify(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None,
             min_margin_bytes: int = MIN_MARGIN_BYTES, min_margin: float = MIN_MARGIN) -> DataFrame:
    """Columns `keep` (default: all) and lang_pred, score (0 to 1), margin (bytes) and rejected.

    The whole text is compressed, a long one in pieces (PIECE_BYTES). lang_pred is a learned language, or `und` with score 0 if the
    text is null or has no letter, or nothing was learned. rejected: `und`, or a margin between the
    best two languages under `min_margin_bytes` bytes or under `min_margin` of the best size. Equal
    texts get equal results, since nothing but the text goes in. A tie goes to the first name.
    """
    taken = {"lang_pred", "score", "margin", "rejected"}
    keep = others(docs.columns, taken) if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def function(texts: pa.Array) -> list[pa.Array]:
        own = sent.value
        langs, scores, margins, rejects = [], [], [], []
        for t in texts.to_pylist():
            if t is None or not own.languages or not any(map(str.isalpha, t)):
                found = (UNKNOWN, 0.0, 0, 0.0)
            else:
                found = classify(t.lower().encode(), own)
            langs.append(found[0])
            scores.append(found[1])
            margins.append(found[2])
            rejects.append(found[0] == UNKNOWN or found[2] < min_margin_bytes or found[3] < min_margin)
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.int64()), pa.array(rejects, pa.bool_())]

    return text_map(docs, text, keep, "lang_pred string, score double, margin bigint, rejected boolean", function)
