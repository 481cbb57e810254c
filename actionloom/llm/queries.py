"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionloom.llm import (
    byte_shards, collocations, conversation_repair, cross_polytope, exact_dedup, interpolated_lm, language, packing,
    simhash, token_files, toxicity, transcripts, trie_bpe,
)
from actionloom.llm.common import held_out, read_table
from actionloom.session import shared_dir, tune

#: Fixed value: the end-of-text id of the byte-level vocabulary.
END_OF_TEXT = 50256
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_TWINS: dict[str, str] = {}


def query(twin: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        _QUERIES[run.__name__] = lambda spark, sf_dir: run(tune(spark), sf_dir)
        if twin:
            _TWINS[run.__name__] = twin
        return run
    return register


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_TWINS)


@query(r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)
""")
def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("text_sha256", exact_dedup.digest())
    return exact_dedup.duplicate_groups(docs, carry=["text_sha256"]).drop("_row")


@query()
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex().alias("fingerprint"), "component_id")


@query()
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


@query()
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 0))
    model = language.fit(docs.filter(~F.col("held_out")))
    return language.predict(docs, model, carry=("held_out",))


@query()
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 5, 0))
    model = toxicity.fit(docs.filter(~F.col("held_out")), read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, carry=("held_out",))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query()
def op8_trie_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = trie_bpe.encode(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query()
def op9_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", held_out("doc_id", 7, 2))
    return interpolated_lm.score(docs)


@query()
def op7_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return cross_polytope.neighbours(vectors, F.col("vec_id") % 50 == 0)


@query()
def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents, read back from flat files of their ids."""
    folder = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = token_files.write_token_files(
        read_table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"), END_OF_TEXT)
    files = token_files.listed(spark, folder).join(manifest.select("file").distinct(), "file", "left_semi")
    found = token_files.scan_token_files(files, folder, END_OF_TEXT)
    return found.join(manifest, ["file", "nth"]).select("doc_id", "file", "nth", "start", "n_tokens")


def transcript_lines(conversations: DataFrame) -> DataFrame:
    """Raw lines of all conversations, with the speaker marked as loosely as in the wild.

    The style of a conversation follows from its id. About a sixth of all turns have no
    marker. ``role`` and ``begins`` are the truth that a parser has to recover.
    """
    styles = {"user": ("User", "Human", "Q", "### Customer"), "assistant": ("Assistant", "AI", "A", "### Agent"),
              "system": ("System", "Instruction", "Context", "### System")}
    style = F.pmod(F.xxhash64("conv_id"), F.lit(4)).cast("int")
    name = F.create_map(*[x for r, names in styles.items() for x in (F.lit(r), F.array(*map(F.lit, names)))])
    speaker = F.coalesce(F.element_at(name[F.col("role")], style + 1), F.col("role"))
    marked = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(6)) > 0
    lines = conversations.select(
        "conv_id", "turn", "role", marked.alias("_marked"), speaker.alias("_speaker"),
        F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "_raw"))
    first = F.col("line") == 0
    return lines.select(
        "conv_id", "turn", "line", "role", first.alias("begins"),
        F.when(first & F.col("_marked") & F.col("_speaker").isNotNull(), F.concat("_speaker", F.lit(": "), "_raw"))
        .otherwise(F.col("_raw")).alias("text"))


@query()
def op2_transcript_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transcript_lines(read_table(spark, sf_dir, "conversations"))
    model = transcripts.fit(lines.filter(~held_out("conv_id", 5, 0)))
    parsed = transcripts.parse(lines, model)
    return parsed.withColumn("held_out", held_out("conv_id", 5, 0))


#: The table of the CRC-32 polynomial, one entry per byte, made from its rule.
_CRC_TABLE = """
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS v
    FROM range(256) r(i))"""


def _crc_sql(bytes_sql: str) -> str:
    return f"xor(list_reduce({bytes_sql}, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)"


@query(f"""
WITH crc AS MATERIALIZED ({_CRC_TABLE}),
bytes AS MATERIALIZED (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS b
  FROM documents),
sized AS (SELECT doc_id, size, {_crc_sql('b')} AS text_crc32 FROM bytes, crc),
placed AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         sum(size) OVER () AS total
  FROM sized),
dealt AS (
  SELECT *, least(39, ((2 * before + size) * 40) // (2 * total))::INT AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY before, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       cast(NULL AS INT) AS grown_shard
FROM dealt
""")
def op12_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_shards.shard_documents(read_table(spark, sf_dir, "documents")).withColumn(
        "grown_shard", F.lit(None).cast("int"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with the faults that their ids ask for; ``times`` is 0 for a row that is lost, 2 for a repeat."""
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(written("text"), ".!?", "")).otherwise(written("text"))
    return conversations.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(written("role")).alias("role"), text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


@query(f"""
WITH RECURSIVE crc AS MATERIALIZED ({_CRC_TABLE}),
base AS MATERIALIZED (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc_sql("list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)")} % 20 AS k
  FROM conversations, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base, range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) copies),
seen AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM damaged),
rows AS MATERIALIZED (
  SELECT *, left(role, 1) AS c,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
              WHEN nth > 1 THEN 'duplicate'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS i
  FROM seen),
faults AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, max(i) AS n,
         count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(c) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM rows) GROUP BY conv_id),
keeps(q, c, to_q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
adds(q, to_q) AS (VALUES (0, 2), (1, 2), (2, 3), (3, 2)),
inserted(q, m, letters, lines) AS (
  SELECT q, q, '', []::VARCHAR[] FROM adds
  UNION ALL SELECT q, to_q, 'I', [CASE to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END] FROM adds
  UNION ALL SELECT a.q, b.to_q, 'II', [CASE a.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END,
                                       CASE b.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END]
  FROM adds a JOIN adds b ON b.q = a.to_q),
moves AS MATERIALIZED (
  SELECT conv_id, i, m.q AS m, m.q AS to_q, 3 AS cost, 'D' AS letter, []::VARCHAR[] AS line FROM rows, adds m
  UNION ALL
  SELECT conv_id, i, k.q, k.to_q, (fault = 'truncated')::INT, 'K', [role || ':' || text]
  FROM rows JOIN keeps k ON k.c = rows.c WHERE fault IN ('', 'truncated')
  UNION ALL
  SELECT conv_id, i, a.q, a.to_q, 2 + (fault = 'truncated')::INT, 'R',
         [CASE a.to_q WHEN 2 THEN 'user:' ELSE 'assistant:' END || text]
  FROM rows, adds a WHERE fault IN ('', 'truncated')),
best AS (
  SELECT conv_id, n + 1 AS i, q, {{'cost': cost, 'audit': audit, 'lines': lines}} AS way
  FROM faults, (VALUES (0, 0, '', []::VARCHAR[]), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']),
                       (3, 0, '', []::VARCHAR[])) ends(q, cost, audit, lines)
  UNION ALL
  SELECT v.conv_id, v.i, ins.q,
         min({{'cost': 2 * length(ins.letters) + v.cost + b.way.cost, 'audit': ins.letters || v.letter || b.way.audit,
              'lines': ins.lines || v.line || b.way.lines}})
  FROM best b JOIN moves v ON v.conv_id IS NOT DISTINCT FROM b.conv_id AND v.i = b.i - 1 AND v.to_q = b.q
  JOIN inserted ins ON ins.m = v.m
  GROUP BY v.conv_id, v.i, ins.q)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(way.cost, 0)::BIGINT AS cost,
       coalesce(way.audit, '') AS audit, sha256(coalesce(array_to_string(way.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c
LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id AND b.i = 1 AND b.q = 0
""")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(conversation_repair.repair(rows, times_col="times")).withColumnRenamed("conv", "conv_id")


@query(r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS MATERIALIZED (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts)),
counts AS MATERIALIZED (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
  FROM pieces, range(1, 5) ks(k), range(1, len(w) - k + 2) starts(i) GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM counts WHERE k > 1 AND f >= 30),
cuts AS (
  SELECT c.*, l.f AS l, r.f AS r, c.cut,
         (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.k = c.cut AND l.phrase = array_to_string(w[1:c.cut], ' ')
  JOIN counts r ON r.lang = c.lang AND r.k = c.k - c.cut AND r.phrase = array_to_string(w[c.cut + 1:c.k], ' ')),
weakest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, k, phrase ORDER BY score, cut) = 1),
inside AS (
  SELECT lang, m AS k, array_to_string(w[s:s + m - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates c, range(2, c.k) ms(m), range(1, c.k - m + 2) ss(s) GROUP BY ALL),
kept AS (
  SELECT x.* FROM weakest x LEFT JOIN inside i ON i.lang = x.lang AND i.k = x.k AND i.phrase = x.phrase
  WHERE i.longer IS NULL OR 100::HUGEINT * i.longer < 80::HUGEINT * x.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
""")
def op13_tiled_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents")).withColumn("rank", F.col("rank").cast("long"))
