"""Archives and chat templates: exact round trips."""

import base64
import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from fleetgauge.llm import chat, warc

PAGES = "page_id bigint, url string, html string"


def pages(spark):
    big = "<p>" + "x" * 2000
    data = [(i, f"http://h/{i}", f"<html>{i}</html>" * (i % 7)) for i in range(40)]
    data += [(100, "u", big), (101, None, big), (102, "a b\r\nWARC-Type: x", big), (103, "u", "é" * 600), (104, "u", "é" * 600)]
    data += [(105, "u", None), (106, "u", ""), (107, "u", "y" * 999), (108, "u", "y" * 999), (109, "u", "z" * 1000), (110, "u", "z" * 1000)]
    data += [(200, "u", "long " * 400_000), (None, "u", big), (110, "u", "z" * 1000), (111, "u", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 100)]
    return spark.createDataFrame(data, PAGES).repartition(5), data


def brute(data):
    best = {}
    for i, _, t in data:
        t = (t or "").encode()
        if len(t) >= 1000 and i is not None:
            best[t] = max(i, best.get(t, i))
    out = []
    for i, _, t in data:
        t = (t or "").encode()
        to = best.get(t) if i is not None else None
        refers = to if to is not None and to != i else None
        out.append((i, len(t), hashlib.sha1(t).hexdigest(), "response" if refers is None else "revisit", refers, None if refers is not None else t))
    return sorted(out, key=repr)


@pytest.mark.parametrize("range_bytes", [700, 5000, warc.RANGE_BYTES])
def test_round_trip_in_ranges(spark, tmp_path, range_bytes):
    df, data = pages(spark)
    path = str(tmp_path / "archive")
    warc.write_records(warc.page_records(df.withColumn("payload", F.lit(1))), path)
    found = warc.read_records(spark, path, range_bytes)
    number = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    got = rows(found.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), F.col("payload").cast("binary")))
    assert [(*r[:5], None if r[5] is None else bytes(r[5])) for r in got] == brute(data)
    uris = {r["record_id"]: r["target_uri"] for r in found.collect()}
    assert uris["urn:page:102"] == "a%20b%0D%0AWARC-Type:%20x" and uris["urn:page:101"] is None


def test_other_archives(spark, tmp_path):
    """Files of another writer: fields of other names and cases, folded lines, other records, no digest."""
    def member(kind, block, extra=""):
        head = f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\nCONTENT-LENGTH: {len(block)}\r\n{extra}\r\n"
        return gzip.compress(head.encode() + block + b"\r\n\r\n")

    digest = base64.b32encode(hashlib.sha1(b"body").digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody"
    file = tmp_path / "crawl.warc.gz"
    file.write_bytes(
        member("warcinfo", b"software: x", "Content-Type: application/warc-fields\r\n") + member("response", http, f"Content-Type:\r\n application/http\r\nWARC-Payload-Digest: sha1:{digest}\r\n")
        + member("resource", b""))
    got = rows(warc.read_records(spark, str(file), 50).select("record_type", "payload_bytes", F.col("payload").cast("string")))
    assert got == [("resource", 0, ""), ("response", 4, "body"), ("warcinfo", 11, "software: x")]


def test_archive_within_an_archive(spark, tmp_path):
    """The magic, and whole members, inside a stored payload don't start records."""
    inner = b"".join(warc.encode_record(f"urn:in:{i}", "response", None, b"i" * 30, 30, hashlib.sha1(b"i" * 30).hexdigest(), None) for i in range(3))
    outer = []
    for i in range(6):
        payload = np.random.default_rng(i).bytes(3000) + inner + b"\x1f\x8b\x08" * 5
        record = warc.encode_record(f"urn:out:{i}", "response", None, payload, len(payload), hashlib.sha1(payload).hexdigest(), None)
        outer.append(gzip.compress(gzip.decompress(record), 0))
    (tmp_path / "x.warc.gz").write_bytes(b"".join(outer))
    got = rows(warc.read_records(spark, str(tmp_path), 4001).select("record_id"))
    assert got == [(f"urn:out:{i}",) for i in range(6)]


def test_damage_is_an_error(spark, tmp_path):
    df, _ = pages(spark)
    path = tmp_path / "archive"
    warc.write_records(warc.page_records(df.where("page_id < 40")).coalesce(1), str(path))
    file = next(path.glob("*.warc.gz"))
    data = file.read_bytes()
    for bad in (data[:-9], data[: len(data) // 2] + b"0000" + data[len(data) // 2 + 4 :]):
        file.write_bytes(bad)
        with pytest.raises(Exception, match="member|record|digest"):
            warc.read_records(spark, str(path), 10**9).collect()


def test_no_pages_and_lost_attempts(spark, tmp_path):
    df, _ = pages(spark)
    warc.write_records(warc.page_records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_records(spark, str(tmp_path / "none")).count() == 0
    warc.write_records(warc.page_records(df.where("page_id < 5")), str(tmp_path / "some"))
    (tmp_path / "some" / "part-lost.warc.gz").write_bytes(b"left by a task that died")
    assert warc.read_records(spark, str(tmp_path / "some")).count() == 5


# Chat -----------------------------------------------------------------------------------------------------------

TURNS = "conv_id bigint, turn bigint, role string, text string"
CONTROLS = [*chat.RESERVED, *chat.FOREIGN, "\\", "\\\\", "<", "|>", "[INST[INST]", "</s", "é", "\n", " ", "", "日本", "😀"]


def test_escaping_is_reversible():
    draw = random.Random(1)
    for _ in range(3000):
        text = "".join(draw.choices(CONTROLS, k=draw.randint(0, 6)))
        safe = chat.escape(text)
        assert chat.unescape(safe) == text and not any(c in safe for c in (*chat.RESERVED, *chat.FOREIGN))


def test_conversations_read_back(spark):
    draw = random.Random(2)
    data = []
    for c in [*range(25), None]:
        for t in range(draw.randint(1, 6)):
            data.append((c, t, draw.choice(["user", "assistant", "system", None, "<|end|>"]), draw.choice([None, "".join(draw.choices(CONTROLS, k=5))])))
    data += [(50, 0, "assistant", "a"), (50, 0, "assistant", "a"), (51, None, "user", "first"), (51, 0, "assistant", "x" * 100_000)]
    df = spark.createDataFrame(data, TURNS).withColumn("ids", F.lit("clash")).repartition(4)
    formatted = chat.format_conversations(df)
    assert formatted.columns == ["conv_id", "ids", "loss_mask", "formatted_chars"]
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    assert set(got) == {d[0] for d in data}
    for c, r in got.items():
        own = [(t, role or "", text or "") for k, t, role, text in data if k == c]
        own.sort(key=lambda x: (x[0] is not None, x[0] or 0))
        turns = [(x["role"], x["text"]) for x in r["turns"]]
        assert [x[0] for x in turns if True] and sorted(turns) == sorted(x[1:] for x in own)
        if len({x[0] for x in own}) == len(own):
            assert turns == [x[1:] for x in own]
        assert r["loss_texts"] == [text for role, text in turns if role == "assistant"]
        shown = chat.BEGIN + "".join(f"{chat.TURN}{chat.escape(a)}{chat.TEXT}{chat.escape(b)}{chat.END}" for a, b in turns)
        assert r["formatted_chars"] == len(shown) and len(r["ids"]) == len(r["loss_mask"])
        ids, mask = np.array(r["ids"]), np.array(r["loss_mask"])
        assert not mask[np.isin(ids, [chat.RESERVED[k] for k in (chat.BEGIN, chat.TURN, chat.TEXT)])].any()
        assert (ids == chat.RESERVED[chat.TURN]).sum() == len(own)
    assert chat.format_conversations(df.limit(0)).count() == 0
