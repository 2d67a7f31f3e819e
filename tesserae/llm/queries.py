"""The operators bound to the benchmark tables, with SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import (
    byte_bpe, chat_format, collocations, cotraining, fill_middle, jaccard_join, language_id, stratified_shards, string_tiling, suffix_array,
    token_packing, toxicity, weak_supervision,
)
from tesserae.llm.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op9_jaccard_join", r"""
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.doc_id, y FROM reach JOIN both_ways ON other = x)
SELECT r.doc_id, CAST(coalesce(any_value(n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id
""")
def op9_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard_join.jaccard_components(table(spark, folder, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


@query("op7_suffix_array_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM d)),
least AS (SELECT s, min(doc_id) AS m FROM w GROUP BY s),
cut AS (SELECT w.doc_id, p FROM w JOIN least USING (s) WHERE w.doc_id > m),
marked AS (SELECT doc_id, p, coalesce(p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) > 50, true) AS fresh FROM cut),
numbered AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
runs AS (SELECT doc_id, run, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY ALL),
gaps AS (
  SELECT runs.doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0) + 1,
    2 * (a - coalesce(lag(b) OVER (PARTITION BY runs.doc_id ORDER BY a), 0))) AS piece
  FROM runs JOIN d USING (doc_id)),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS e, string_agg(piece, '' ORDER BY a) AS head FROM gaps GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(e, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
""")
def op7_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_array.deduplicated(table(spark, folder, "documents")).drop("kept")


def remainder(divisor: int):
    """crc32 of the id as text, modulo `divisor`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scorer = toxicity.fit(docs, table(spark, folder, "labels").where(remainder(3) != 1))
    scores = toxicity.scored(docs, scorer)
    return scores.select(
        "doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


@query("op1_token_packing")
def op1_token_packing(spark: SparkSession, folder: str) -> DataFrame:
    return token_packing.packed_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op5_byte_bpe")
def op5_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    found = byte_bpe.encoded(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.drop("ids")


@query("op8_string_tiling")
def op8_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = string_tiling.contaminated(docs, table(spark, folder, "benchmark"))
    rows = docs.select("doc_id").join(found, "doc_id", "left")
    nothing = {"n_tiled": F.coalesce("n_tiled", F.lit(0)), "coverage": F.coalesce("coverage", F.lit(0.0))}
    return rows.withColumns(nothing | {"contaminated": F.coalesce("contaminated", F.lit(False))})


@query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language_id.fit(docs.where(remainder(5) != 0))
    found = language_id.predicted(docs, model)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "doubtful")


@query("op4_cotraining")
def op4_cotraining(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    pair = cotraining.fit(docs, table(spark, folder, "labels").where(remainder(3) != 1))
    held_out = F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out")
    return cotraining.scored(docs, pair).select("doc_id", held_out, "score", "kept")


def weak_supervision_sql() -> str:
    """Measures in SQL, and expectation-maximisation as a recursive query over the vote patterns."""
    rules = weak_supervision.RULES
    names = list(rules)
    start, low, high = weak_supervision.START, weak_supervision.LOW, weak_supervision.HIGH
    space = weak_supervision.SPACE
    odds = weak_supervision.log_odds({n: (f"g_{n}", f"b_{n}") for n in names}, "prior")
    votes = ", ".join(f"{weak_supervision.vote(*rules[n])} AS v_{n}" for n in names)
    columns = ", ".join(f"v_{n}" for n in names)
    steps = []
    for n in names:
        for column, vote, p in ((f"g_{n}", 1, "p"), (f"b_{n}", 0, "(1 - p)")):
            part = f"sum(CASE WHEN v_{n} = {vote} THEN n * {p} ELSE 0 END)"
            whole = f"sum(CASE WHEN v_{n} IS NOT NULL THEN n * {p} ELSE 0 END)"
            steps.append(f"least({high}, greatest({low}, ({part} + 1) / ({whole} + 2))) AS {column}")
    first = ", ".join(f"{start}::DOUBLE AS g_{n}, {start}::DOUBLE AS b_{n}" for n in names)
    return rf"""
WITH RECURSIVE split AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[{space}]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{space}]')) AS l
  FROM documents),
windows AS (SELECT doc_id, i, w[i:i + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
measures AS (
  SELECT s.doc_id, len(w) AS n_words, length(regexp_replace(text, '[{space}]', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines,
    coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^.!?]', '', 'g')) AS n_stops, length(regexp_replace(text, '[^|]', '', 'g')) AS n_bars
  FROM split s LEFT JOIN covered c ON c.doc_id = s.doc_id),
votes AS (SELECT *, {votes} FROM measures),
patterns AS (SELECT {columns}, count(*) AS n FROM votes GROUP BY ALL),
em AS (
  SELECT 0 AS turn, {weak_supervision.PRIOR}::DOUBLE AS prior, {first}
  UNION ALL
  SELECT turn + 1, least({high}, greatest(1 - {high}, (sum(n * p) + 1) / (sum(n) + 2))), {", ".join(steps)}
  FROM (SELECT *, 1 / (1 + exp(-({odds}))) AS p FROM em, patterns WHERE turn < {weak_supervision.ITERATIONS}) GROUP BY turn)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 1 / (1 + exp(-({odds}))) >= {weak_supervision.KEEP} AS kept
FROM votes, em WHERE turn = {weak_supervision.ITERATIONS}
"""


@query("op6_weak_supervision", weak_supervision_sql())
def op6_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    found = weak_supervision.judged(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op10_stratified_shards", """
WITH RECURSIVE table_rows(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM table_rows WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM table_rows WHERE k = 8),
rows_ AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size,
    xor(list_reduce(list_concat([4294967295], list_transform(range(octet_length(encode(coalesce(text, '')))),
      lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * i + 1, 2))::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, crc_table),
hashed AS (SELECT *, md5('1:' || coalesce(doc_id::VARCHAR, '') || ':' || text_crc32) AS h, coalesce('s' || source, 'n') AS stratum FROM rows_),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id NULLS FIRST, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY stratum) AS rank
  FROM hashed),
placed AS (SELECT *, row_number() OVER (ORDER BY rank, stratum) - 1 AS place, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (place * 16 // n)::INT AS shard,
  place - ((place * 16 // n) * n + 15) // 16 AS slot, NULL::INT AS grown_shard
FROM placed
""")
def op10_stratified_shards(spark: SparkSession, folder: str) -> DataFrame:
    found = stratified_shards.interleaved(table(spark, folder, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CONTROL_TURN = "</s>[INST] ok [/INST]"


def chat_format_sql() -> str:
    escape = chat_format.ESCAPE
    marks = " ".join(f"WHEN '{role}' THEN {sum(map(len, [*opens, close]))}" for role, (opens, close) in chat_format.FRAMES.items())
    others = sum(map(len, (chat_format.OPEN, chat_format.BETWEEN, chat_format.CLOSE)))
    longer = rf"length(regexp_replace({{}}, '{escape}', '\1\\\2\3', 'g'))"
    order = "ORDER BY turn NULLS FIRST, role, md5(text)"
    return rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM (SELECT conv_id, turn, role, text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '{CONTROL_TURN}'), (-7, 1, 'assistant', '{CONTROL_TURN}')) t(conv_id, turn, role, text)),
joined AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' {order}) AS everything,
    coalesce(string_agg(text, '' {order}) FILTER (role = '{chat_format.LEARNED}'), '') AS loss,
    sum({longer.format("text")} + CASE role {marks} ELSE {others} + {longer.format("role")} END) AS formatted_chars
  FROM turns GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(everything) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined
"""


@query("op11_chat_format", chat_format_sql())
def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    columns = "conv_id long, turn long, role string, text string"
    added = spark.createDataFrame([(-7, 0, "user", CONTROL_TURN), (-7, 1, "assistant", CONTROL_TURN)], columns)
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return chat_format.digests(stored(chat_format.formatted(turns, *vocabulary), "chats"), *vocabulary)


@query("op12_fill_middle", r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
    list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), i, 8))::BIGINT) AS h
  FROM documents),
placed AS (
  SELECT *, len(w) AS n, least(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS a, greatest(h[1] % (len(w) + 1), h[2] % (len(w) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
      WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT *, coalesce(array_to_string(w[1:a], ''), '') AS p, coalesce(array_to_string(w[a + 1:b], ''), '') AS m,
    coalesce(array_to_string(w[b + 1:], ''), '') AS s
  FROM placed)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END)
    AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
""")
def op12_fill_middle(spark: SparkSession, folder: str) -> DataFrame:
    found = fill_middle.fill_middle(table(spark, folder, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(fill_middle.restored_text(), 256).alias("restored_sha256"),
    )


@query("op13_collocations", r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
runs AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY ALL HAVING count(*) >= 30),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, j, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * c.a // (x.a + y.a) AS BIGINT) AS score
  FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS j FROM f WHERE k > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:j], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[j + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, j) = 1),
inner_ AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT lang, k, a, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2))),
covers AS (SELECT lang, phrase, max(a) AS most FROM inner_ GROUP BY ALL),
kept AS (
  SELECT cuts.*, row_number() OVER (PARTITION BY cuts.lang ORDER BY score DESC, a DESC, cuts.phrase) AS rank
  FROM cuts LEFT JOIN covers ON covers.lang = cuts.lang AND covers.phrase = cuts.phrase
  WHERE most IS NULL OR 100 * most < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN totals USING (lang) WHERE rank <= 2000
""")
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
