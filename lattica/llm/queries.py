"""Queries of the thirteen operators, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, decontamination, language_model, license_scan, merkle, near_dedup, packing, quality_model, quality_rules, sharding, toxicity, url_filter, warc
from .common import shared_path, table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path)
    damaged = F.raise_error(F.concat(F.lit("an archive just written has a gap: "), F.col("gap").cast("string")))
    records = warc.read(spark, path).where(F.when(F.col("gap").isNotNull(), damaged.cast("boolean")).otherwise(F.lit(True)))
    return records.select(
        warc.page_number(F.col("record_id")).alias("page_id"),
        "payload_bytes",
        "payload_digest",
        F.col("type").alias("record_type"),
        warc.page_number(F.col("refers_to")).alias("refers_to"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.classify(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    talks = table(spark, sf_dir, "conversations")
    return conversations.of_every(talks, conversations.reports(conversations.damaged(talks)))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The check finds half of the texts without their line ends."""
    half = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), altered=F.when(half, F.translate("text", "\n", "")))


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return language_model.score(docs, language_model.fit(docs, ~F.coalesce(held_out, F.lit(False))), held_out)


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_packing, op3_toxicity, op4_quality_rules, op5_license_scan, op6_minhash, op7_warc, op8_url_filter, op9_sharding, op10_quality_classifier, op11_conversations, op12_merkle, op13_language_model)}
#: DuckDB has no CRC-32: `crc` is a list of the 256 values of a byte, by which it is folded over a string's bytes.
_CRC_TABLE = """
        crc AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, [0::UBIGINT FOR x IN range(8)]),
                    lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
                FROM (SELECT unnest(range(256))::UBIGINT AS b)))"""


def _crc32(text: str) -> str:
    """The CRC-32 of a string of ASCII characters, where the column `crc` is at hand."""
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::UBIGINT)),
                    lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"""


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _edits() -> str:
    """The options of a row from each state, and inserts, as (cost, audit, repaired text) that extend the best rest of each state."""
    due = {0: 2, 1: 2, 2: 3, 3: 2}
    name = {2: "user", 3: "assistant"}
    line = lambda role, text, rest: f"CASE WHEN {rest}.t IS NULL THEN {role} || ':' || {text} ELSE {role} || ':' || {text} || chr(10) || {rest}.t END"

    def of(state: int) -> str:
        rest = lambda q: f"b[{q + 1}]"
        d = due[state]
        keep = {0: "CASE WHEN initial = 's' THEN 1 WHEN initial = 'u' THEN 2 END", 1: "CASE WHEN initial = 'u' THEN 2 END", 2: "CASE WHEN initial = 'a' THEN 3 END", 3: "CASE WHEN initial = 'u' THEN 2 END"}[state]
        kept = f"b[({keep}) + 1]"
        drop = f"{{'c': {rest(state)}.c + 3, 'a': 'D' || {rest(state)}.a, 't': {rest(state)}.t}}"
        rerole = f"{{'c': {rest(d)}.c + 2 + cut, 'a': 'R' || {rest(d)}.a, 't': {line(repr(name[d]), 'text', rest(d))}}}"
        same = f"{{'c': {kept}.c + cut, 'a': 'K' || {kept}.a, 't': {line('role', 'text', kept)}}}"
        return f"list_sort(list_filter([{drop}, CASE WHEN gone THEN NULL ELSE {rerole} END, CASE WHEN gone OR ({keep}) IS NULL THEN NULL ELSE {same} END], lambda x: x IS NOT NULL))[1]"

    def insert(state: int) -> str:
        rest = f"n[{due[state] + 1}]"
        return f"list_sort([n[{state + 1}], {{'c': {rest}.c + 2, 'a': 'I' || {rest}.a, 't': {line(repr(name[due[state]]), repr(''), rest)}}}])[1]"

    rows = f"SELECT conv_id, k - 1 AS k, [{', '.join(map(of, range(4)))}] AS n FROM talk JOIN best USING (conv_id, k)"
    for _ in range(2):
        rows = f"SELECT conv_id, k, [{', '.join(map(insert, range(4)))}] AS n FROM ({rows})"
    return f"SELECT conv_id, k, n AS b FROM ({rows})"


ORACLE_SQL: dict[str, str] = {
    "op11_conversations": rf"""
        WITH RECURSIVE {_CRC_TABLE},
        r AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
              FROM conversations, crc),
        damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
                           CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                           unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
                    FROM r),
        placed AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS initial, lag(left(role, 1)) OVER w AS before,
                          row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
                   FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
        talk AS (SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::BIGINT AS cut FROM (
                 SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again THEN 'duplicate'
                                WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault FROM placed)),
        best AS (SELECT conv_id, max(k) AS k, [{{'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR}}, {{'c': 4, 'a': 'II', 't': 'user:' || chr(10) || 'assistant:'}}, {{'c': 2, 'a': 'I', 't': 'assistant:'}}, {{'c': 0, 'a': '', 't': NULL}}] AS b
                 FROM talk GROUP BY conv_id UNION ALL {_edits()}),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                          count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                          count(*) FILTER (k > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
                   FROM talk GROUP BY conv_id)
        SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(b[1].c, 0) AS cost, coalesce(b[1].a, '') AS audit, sha256(coalesce(b[1].t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id
        LEFT JOIN best e ON e.conv_id IS NOT DISTINCT FROM i.conv_id AND e.k = 0""",
    "op12_merkle": f"""
        WITH RECURSIVE {_CRC_TABLE},
        leaves AS (SELECT source, doc_id, leaf, found, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
                   FROM (SELECT doc_id, source, {_leaf("text")} AS leaf, CASE WHEN {_crc32("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf("replace(text, chr(10), '')")} ELSE {_leaf("text")} END AS found FROM documents, crc)),
        tree AS (SELECT source, 0 AS level, i, n, leaf AS h FROM leaves
                 UNION ALL SELECT source, level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY source, level, i // 3, n),
        subroots AS (SELECT source, h AS subroot, level AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
        top AS (SELECT 0 AS level, i, n, subroot AS h FROM subroots
                UNION ALL SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1 GROUP BY level, i // 3, n),
        below AS (SELECT l.source, l.doc_id, l.leaf, l.i AS id, t.level, t.i < own AS left_side, t.h, t.i FROM (SELECT *, unnest(range(40)) AS level FROM leaves) l,
                  LATERAL (SELECT l.i // (3 ** l.level)::BIGINT AS own), tree t
                  WHERE t.source IS NOT DISTINCT FROM l.source AND t.level = l.level AND t.n > 1 AND t.i // 3 = own // 3 AND t.i <> own),
        above AS (SELECT s.source, s.depth + t.level AS level, t.i < own AS left_side, t.h, t.i FROM (SELECT *, unnest(range(40)) AS level FROM subroots) s,
                  LATERAL (SELECT s.i // (3 ** s.level)::BIGINT AS own), top t WHERE t.level = s.level AND t.n > 1 AND t.i // 3 = own // 3 AND t.i <> own),
        siblings AS (SELECT source, id, level, left_side, h, i FROM below
                     UNION ALL SELECT l.source, l.i, a.level, a.left_side, a.h, a.i FROM leaves l JOIN above a ON a.source IS NOT DISTINCT FROM l.source),
        sides AS (SELECT source, id, level, coalesce(string_agg(h, '' ORDER BY i) FILTER (left_side), '') AS befores, coalesce(string_agg(h, '' ORDER BY i) FILTER (NOT left_side), '') AS afters
                  FROM siblings GROUP BY source, id, level),
        steps AS (SELECT l.source, l.i AS id, l.found, s.depth + (SELECT max(level) FROM top) AS levels FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source),
        fold AS (SELECT source, id, 0 AS level, levels, found AS h FROM steps
                 UNION ALL SELECT f.source, f.id, f.level + 1, f.levels, sha256(coalesce(s.befores, '') || f.h || coalesce(s.afters, ''))
                 FROM fold f LEFT JOIN sides s ON s.source IS NOT DISTINCT FROM f.source AND s.id = f.id AND s.level = f.level WHERE f.level < f.levels),
        proofs AS (SELECT source, id, string_agg(befores || afters, '' ORDER BY level) AS proof FROM sides GROUP BY source, id)
        SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.h AS folded_root, f.h = r.h AS verified
        FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source JOIN (SELECT h FROM top WHERE n = 1) r ON true
        JOIN fold f ON f.source IS NOT DISTINCT FROM l.source AND f.id = l.i AND f.level = f.levels
        LEFT JOIN proofs p ON p.source IS NOT DISTINCT FROM l.source AND p.id = l.i""",
    "op6_minhash": """
        WITH RECURSIVE w AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words
            FROM documents),
        s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
                ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles
            FROM w),
        n AS (SELECT doc_id, len(shingles) AS n_shingles FROM s),
        e AS (SELECT doc_id, unnest(shingles) AS shingle FROM s),
        i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b USING (shingle) WHERE a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
              WHERE 100 * shared >= 85 * (x.n_shingles + y.n_shingles - shared)),
        g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, reached) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, g.b FROM r JOIN g ON g.a = r.reached)
        SELECT n.doc_id, n.n_shingles, min(reached) AS component_id, n.doc_id = min(reached) AS kept
        FROM n JOIN r USING (doc_id) GROUP BY n.doc_id, n.n_shingles""",
    "op7_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        d AS (SELECT page_id, strlen(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
        FROM f""",
}
