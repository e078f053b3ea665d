"""Files read in byte ranges: JSON arrays and block digests give the same whatever the ranges."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetgauge.sources import blockdigest, jsonarray, tables

ELEMENTS = [
    {"a": 1, "b": "plain"}, {"a": 2, "b": "br[ack]ets, {in} strings"}, {"a": 3, "b": 'quote " and \\ and \\" end\\'}, {"b": "é日本😀", "a": None},
    {"a": 4, "n": [[1, [2]], {"x": "]"}], "b": ","}, {"a": 5, "b": "\\" * 9}, {"a": 6, "b": ""}, {}, {"a": 7, "b": "\n\t"},
]


def spelled(draw, elements):
    blank = lambda: draw.choice(["", "", " ", "\n  ", "\t"])
    return blank() + "[" + ",".join(blank() + json.dumps(e, ensure_ascii=draw.random() < 0.5) + blank() for e in elements) + "]" + blank()


@pytest.mark.parametrize("piece", [3, 1 << 20])
def test_states_of_every_cut(monkeypatch, piece):
    """The state at each byte, reached through any cut, is that of a walk byte by byte."""
    monkeypatch.setattr(jsonarray, "READ", piece)
    text = spelled(random.Random(1), ELEMENTS).encode()
    data = np.frombuffer(text, np.uint8)
    walked = [jsonarray.State()]
    for byte in text:
        s = walked[-1]
        if s.inside:
            nxt = jsonarray.State(s.escaped or byte != 0x22, not s.escaped and byte == 0x5C, s.depth)
        else:
            nxt = jsonarray.State(byte == 0x22, False, s.depth + (byte in b"[{") - (byte in b"]}"))
        walked.append(nxt)
    assert walked[-1] == jsonarray.State()
    for a in range(0, len(text), 7):
        for b in range(a, len(text) + 1, 11):
            assert jsonarray.scan(data[a:b], walked[a])[0] == walked[b], (a, b)


@pytest.mark.parametrize("range_bytes", [1, 7, 64, 1 << 20])
def test_array_in_ranges_equals_the_whole_file_reader(spark, tmp_path, range_bytes, monkeypatch):
    draw = random.Random(range_bytes)
    n = 2 if range_bytes == 1 else 30
    for i in range(2):
        (tmp_path / f"f{i}.json").write_text(spelled(draw, draw.choices(ELEMENTS, k=n)), encoding="utf-8")
    (tmp_path / "one.json").write_text(' {"a": 9, "b": "no array, [x]"} ')
    for i, empty in enumerate(["[]", " [ \n ] ", "", "  "]):
        (tmp_path / f"empty{i}.json").write_text(empty)
    schema = "a int, b string"
    got = tables.read_json(spark, str(tmp_path), schema, orient="array", range_bytes=range_bytes)
    want = spark.read.schema(schema).json([str(tmp_path / f) for f in ("f0.json", "f1.json", "one.json")], multiLine=True)
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert key(got) == key(want) and len(key(got)) == 2 * n + 1


def test_elements_are_owned_once(spark, tmp_path):
    text = "[" + ",".join(json.dumps({"i": i, "s": "x" * (i % 50)}) for i in range(3000)) + "]"
    (tmp_path / "a.json").write_text(text)
    found = jsonarray.array_elements(spark, str(tmp_path / "a.json"), 4096)
    rows = found.orderBy("at").collect()
    assert [json.loads(r["element"])["i"] for r in rows] == list(range(3000))
    assert all(text[r["at"] : r["at"] + len(r["element"])] == r["element"] for r in rows)
    assert found.rdd.getNumPartitions() == -(-len(text) // 4096)


@pytest.mark.parametrize(("text", "says"), [('[{"a": 1}', "brackets are open"), ('[{"a": "x]', "a string is open"), ('[1,,2]', "empty element"), ("[1, ]", "empty element"), ('[1]]', "brackets are open")])
def test_damaged_arrays_are_named(spark, tmp_path, text, says):
    (tmp_path / "bad.json").write_text(text)
    with pytest.raises(Exception, match="bad.json.*" + says):
        jsonarray.array_elements(spark, str(tmp_path / "bad.json"), 3).collect()


def test_array_without_a_schema_is_still_inferred(spark, tmp_path):
    (tmp_path / "r.json").write_text('[{"a": 1}, {"a": 2}]')
    assert sorted(r["a"] for r in tables.read_json(spark, str(tmp_path / "r.json"), orient="array").collect()) == [1, 2]


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
@pytest.mark.parametrize("range_bytes", [1, 300, 5000, 1 << 30])
def test_block_digests_do_not_depend_on_ranges(spark, tmp_path, range_bytes, algorithm):
    draw = random.Random(2)
    sizes = [0, 1, 99, 100, 101, 300, 301, 2701, 5000]
    contents = {f"w{i}.bin": draw.randbytes(s) for i, s in enumerate(sizes)}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = blockdigest.file_checksums(spark, str(tmp_path), algorithm, block_bytes=100, range_bytes=range_bytes, fan=3)
    split = lambda d: [d[i : i + 100] for i in range(0, len(d), 100)]
    want = {n: (len(d), max(1, len(split(d))), blockdigest.tree_digest(split(d), algorithm, 3)) for n, d in contents.items()}
    assert {r["path"].rsplit("/", 1)[1]: (r["size"], r["blocks"], r["checksum"]) for r in got.collect()} == want
    assert len({w[2] for w in want.values()}) == len(want)


def test_tree_rule_by_hand():
    h = lambda b: hashlib.sha256(b).digest()
    assert blockdigest.tree_digest([], fan=2) == h(h(b"")).hex() and blockdigest.tree_digest([b"x"], fan=2) == h(h(b"x")).hex()
    a, b, c = h(b"a"), h(b"b"), h(b"c")
    assert blockdigest.tree_digest([b"a", b"b", b"c"], fan=2) == h(h(a + b) + h(c)).hex()


def test_block_digest_errors(spark, tmp_path):
    with pytest.raises(Exception, match="unsupported checksum"):
        blockdigest.file_checksums(spark, __file__, "crc").collect()
    with pytest.raises(FileNotFoundError):
        blockdigest.file_checksums(spark, str(tmp_path / "none"))
    twice = blockdigest.file_checksums(spark, __file__).select(F.col("checksum")).first()[0]
    assert len(twice) == 64
