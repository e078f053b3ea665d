"""Registered queries of the text operators, and the SQL that checks them where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm import chat, collocations, decontam, exactdup, langid, linededup, neardup, pieces, quality, tokencount, toxicity, vectorcodes, warc
from fleetgauge.llm.common import crc_mod, shared_folder, stored, table

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[fn.__name__] = fn
        if sql is not None:
            _SQL[fn.__name__] = sql.strip()
        return fn

    return add


@_query("""
WITH p AS (SELECT page_id, cast(strlen(coalesce(html, '')) AS bigint) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT n, d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY n, d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN g.top > p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN g.top > p.page_id THEN g.top END AS refers_to
FROM p LEFT JOIN g ON p.n = g.n AND p.d = g.d
""")
def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = shared_folder(spark, "warc")
    warc.write_records(warc.page_records(table(spark, folder, "pages")), path)
    page = lambda c: F.nullif(F.substring_index(c, ":", -1), F.lit("")).cast("bigint")
    return warc.read_records(spark, path).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )


@_query("""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
shared AS (SELECT k, min(doc_id) AS keeper FROM lines WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT doc_id, i, line, coalesce(doc_id <> keeper, false) AS dropped FROM lines LEFT JOIN shared ON lines.k = shared.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = linededup.drop_repeated_lines(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@_query()
def op3_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_copies(table(spark, folder, "documents"))


def _controls() -> str:
    """The SQL text whose length is that of the escaped {}."""
    out = "replace({}, chr(92), chr(92) || chr(92))"
    for c in (*chat.RESERVED, *chat.FOREIGN):
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


@_query(f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length({_controls().format('role')}) + length({_controls().format('text')}) + {len(chat.TURN + chat.TEXT + chat.END)}) + {len(chat.BEGIN)} AS bigint) AS formatted_chars
FROM t GROUP BY conv_id
""")
def op4_chat(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    probes = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    back = chat.read_back(chat.format_conversations(rows.unionAll(probes)))
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(F.array_join(F.transform("turns", turn), ""), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars",
    )


@_query()
def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), pieces.model_path(), keep=["doc_id"])


@_query()
def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = langid.fit(docs, crc_mod(F.col("doc_id"), 4) != 2)
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected"
    )


@_query("""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x{0}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS ws FROM documents),
b AS (
  SELECT cast(item_id AS varchar) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x{0}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+') AS ws FROM benchmark),
items AS (
  SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
  FROM b, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS t(i) WHERE len(ws) > 0),
lengths AS (SELECT DISTINCT n FROM items),
found AS (
  SELECT d.doc_id, d.i, d.n, items.item_id FROM (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS win
    FROM w, lengths, unnest(range(1, len(ws) - n + 2)) AS t(i)) d JOIN items ON d.win = items.win AND d.n = items.n),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, unnest(range(i, i + n)) AS t(p) GROUP BY doc_id),
per AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT w.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits ON w.doc_id = hits.doc_id LEFT JOIN per ON w.doc_id = per.doc_id
""")
def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


@_query()
def op8_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    stats = stored(quality.statistics(table(spark, folder, "documents"), keep=["doc_id"]), "statistics")
    rows = stored(quality.training_rows(stats, table(spark, folder, "labels")), "labelled")
    found = quality.judge(stats, quality.learn(rows))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


@_query()
def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out), ~held_out)
    return toxicity.score(docs, model, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@_query()
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document; a token across lines belongs to the line of its first byte."""
    found = tokencount.attribute(table(spark, folder, "documents"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_tokens", F.size("section_tokens").cast("bigint").alias("n_sections"), "crossing",
        F.array_max("section_tokens").alias("max_section_tokens"), F.array_join("section_tokens", ",").alias("section_tokens"),
    )


def _code_rounds() -> str:
    """SQL of two rounds of codebooks b0 to b2: assign every part to the nearest entry, then the floor of the mean."""
    out = []
    for i in range(vectorcodes.ROUNDS + 1):
        out.append(f"""a{i} AS (SELECT vec_id, p, min(struct_pack(d := d, e := e)) AS best FROM (
  SELECT x.vec_id, x.p, b.e, list_sum(list_transform(range(1, 1 + len(x.c)), lambda j: (x.c[j] - b.c[j]) * (x.c[j] - b.c[j])))::bigint AS d
  FROM x JOIN b{i} b ON x.p = b.p) GROUP BY vec_id, p)""")
        if i < vectorcodes.ROUNDS:
            out.append(f"""b{i + 1} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM b{i} b LEFT JOIN (
  SELECT p, e, list(v ORDER BY j) AS c FROM (
    SELECT x.p, a.best.e AS e, j, (sum(x.c[j]) - (sum(x.c[j]) % count(*) + count(*)) % count(*)) // count(*) AS v
    FROM x JOIN a{i} a ON x.vec_id = a.vec_id AND x.p = a.p, unnest(range(1, 1 + len(x.c))) AS t(j) GROUP BY x.p, a.best.e, j)
  GROUP BY p, e) m ON b.p = m.p AND b.e = m.e)""")
    return ",\n".join(out)


@_query(f"""
WITH v AS (
  SELECT vec_id, label, list_transform(embedding, lambda y: floor({vectorcodes.SCALE} * y::double)::bigint) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS (SELECT vec_id, p, c[1 + p * (len(c) // {vectorcodes.PARTS}):(p + 1) * (len(c) // {vectorcodes.PARTS})] AS c FROM v, unnest(range({vectorcodes.PARTS})) AS t(p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM v QUALIFY e < {vectorcodes.ENTRIES}),
b0 AS (SELECT p, e, c FROM x JOIN s ON x.vec_id = s.vec_id),
{_code_rounds()},
last AS (SELECT vec_id, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, sum(best.d)::bigint AS error FROM a{vectorcodes.ROUNDS} GROUP BY vec_id),
d AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{vectorcodes.ROUNDS})
SELECT v.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::bigint AS label_error, codebooks_sha256
FROM v JOIN last ON v.vec_id = last.vec_id, d
""")
def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "label", "embedding")
    books = vectorcodes.fit(vectors)
    if books is None:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    coded = stored(vectorcodes.encode(vectors, books), "codes")
    return vectorcodes.with_group_error(coded).select(
        "vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256")
    )


@_query(f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM pieces),
g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::hugeint AS f
  FROM w, unnest(range(1, {collocations.MAX_WORDS + 1})) AS s(k), unnest(range(1, len(ws) - k + 2)) AS t(i) GROUP BY ALL),
n AS (SELECT lang, sum(f)::bigint AS n FROM g WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM g WHERE k >= 2 AND f >= {collocations.LEAST}),
inner_parts AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS over
  FROM c, unnest(range(2, k)) AS s(m), unnest(range(1, k - m + 2)) AS t(i) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, a, l.f AS l, r.f AS r, 1000000 * a * a // (l.f * r.f) AS score, j
  FROM c, unnest(range(1, k)) AS s(j)
  JOIN g l ON l.lang = c.lang AND l.phrase = array_to_string(ws[1:j], ' ')
  JOIN g r ON r.lang = c.lang AND r.phrase = array_to_string(ws[j + 1:], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, a DESC, encode(best.phrase)) AS rank, best.phrase,
  a::bigint AS a, l::bigint AS l, r::bigint AS r, n, score::bigint AS score
FROM best JOIN n ON best.lang = n.lang LEFT JOIN inner_parts ON inner_parts.lang = best.lang AND inner_parts.phrase = best.phrase
WHERE coalesce(100 * over < {collocations.INSIDE_PERCENT} * a, true) QUALIFY rank <= {collocations.TOP}
""")
def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


@_query("""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""")
def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exactdup.exact_copies(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
