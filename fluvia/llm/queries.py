"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm import cascade, exact_dedup, line_dedup, mixing, periodic_runs, sentencepiece_viterbi, setsketch, simhash, suffix_repetition, token_orc, toxicity, warc_index, wordpiece_counts
from fluvia.llm.common import in_arrow, raw, slices, stored, table


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file is; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_index.archive_index(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_repetition.repetition(table(spark, sf_dir, "documents"))


def op3_wordpiece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op4_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.write_token_orc(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return token_orc.ids_crc32(token_orc.read_token_orc(spark, path), ["doc_id", "start", "n_tokens"])


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = line_dedup.with_bitmaps(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def run(batches):
        for part in slices(batches, "text"):
            got = [line_dedup.apply_bitmap(t, b) for t, b in zip(raw(part.column("text")), part.column("fl_bitmap").to_pylist(), strict=True)]
            columns = [pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return marked.transform(in_arrow, run, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each row's digest is asked for here, so those of texts known to be alone are computed as well.
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), digest_all=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).cast("bigint")
    taken = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).withColumn("size", size)
    return taken.select("doc_id", "size", F.col("fl_source_size").alias("source_size"), F.col("fl_target").alias("target"), (F.col("size") * F.col("fl_copies")).alias("taken"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sentencepiece_viterbi.coded(documents, tokenizer_file("piece_bpe_32k.model"), ("n_tokens", "round_trip", "ids_crc32"))


def with_planted_runs(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text): of one text in ten, by its id's CRC, the words from a place on are put in a loop. A row
    without an id keeps its text."""

    def run(batches):
        for part in slices(batches, "text"):
            out = []
            for i, text in zip(part.column("doc_id").to_pylist(), raw(part.column("text")), strict=True):
                h = 1 if i is None else zlib.crc32(str(i).encode())
                if h % 10 == 0 and (words := text.split()):
                    n, g = len(words), h // 10
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    loop = words[a : a + p]
                    text = b" ".join(words[:a] + (loop * ((n - a) // p + 1))[: n - a])
                out.append(text.decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = documents.select("doc_id", "text")
    return rows.transform(in_arrow, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.with_runs(with_planted_runs(table(spark, sf_dir, "documents"))).drop("text")
    # Two ratios of numbers below 2^26 are equal as doubles only if they are equal.
    ranked = F.transform("fl_runs", lambda r: F.struct((-r["length"] / r["period"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))
    lines = F.transform("fl_runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    top = found.withColumn("top", F.array_min(ranked))
    return top.select("doc_id", F.size("fl_runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").cast("bigint").alias("exponent_milli"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("fl_collapsed", 256).alias("collapsed_sha256"))


def op12_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = setsketch.near_groups(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


#: The conversation of turns without one.
NO_CONVERSATION = -(1 << 63)


def op13_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.coalesce("conv_id", F.lit(NO_CONVERSATION)).alias("conv"), "conv_id", "turn", F.crc32(F.coalesce("text", F.lit(""))).alias("weight"))
    turns = cascade.positions(rows, ["turn", "weight"])

    def h(k):
        return F.crc32(F.concat(F.lit(f"{k}:"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(""))))

    distance, arrival = h(0) % 5, 7 * F.col("p")
    fails = sum((F.when(h(a + 2) % 3 == 0, 1 << (a - 1)).otherwise(0) for a in range(1, cascade.ATTEMPTS + 1)), F.lit(0))
    turns = turns.withColumns({"parent": F.when(distance > 0, F.col("p") - distance), "arrival": arrival, "repair": F.when(h(1) % 101 < 50, arrival + h(2) % 101), "fails": fails.cast("int")})
    return cascade.released(stored(turns, "turns")).select("conv_id", "turn", "status", "attempts", "first_at", "last_at", "release_no", "state")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = (op1_warc_index_merge, op2_suffix_repetition, op3_wordpiece_counts, op4_token_orc, op5_line_dedup, op6_exact_dedup, op7_toxicity, op8_simhash, op9_mix_sources, op10_sentencepiece, op11_periodic_runs, op12_setsketch, op13_cascade, pipeline)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op1_warc_index_merge": """
        WITH p AS (SELECT page_id, coalesce(url, 'urn:fluvia:none') AS url, coalesce(html, '') AS body FROM pages),
        h AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
        FROM f""",
    "op5_line_dedup": f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        exploded AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
        keyed AS (SELECT *, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM exploded),
        shared AS (SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
        marked AS (SELECT k.doc_id, k.line, k.pos, s.key IS NOT NULL AND k.doc_id <> s.top AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op6_exact_dedup": f"""
        WITH t AS (SELECT doc_id, sha256({_LOWER}) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)""",
    "op9_mix_sources": f"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
        s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
        w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s),
        o AS (SELECT *, row_number() OVER r AS place,
                     (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                     / (sum(weight) OVER () - coalesce(sum(weight) OVER (r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
              FROM w WINDOW r AS (ORDER BY source_size::DOUBLE / weight, source IS NULL, source)),
        f AS (SELECT min(place) AS place FROM o WHERE NOT 3 * source_size <= level * weight),
        t AS (SELECT o.source, o.source_size,
                     CASE WHEN f.place IS NULL OR o.place < f.place THEN (3 * o.source_size)::DOUBLE ELSE o.weight * (SELECT level FROM o JOIN f USING (place)) END AS target
              FROM o CROSS JOIN f),
        r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
        SELECT d.doc_id, d.size, r.source_size, r.target,
               d.size * (floor(r.rate)::BIGINT + CASE WHEN ('0x' || substr(md5('{mixing.SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 12))::UBIGINT::DOUBLE / 281474976710656.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS taken
        FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source""",
}

ORACLE_SQL["op12_setsketch"] = f"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    s AS MATERIALIZED (SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) <= 4 THEN [array_to_string(w, ' ')]
                  ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS grams FROM d),
    n AS MATERIALIZED (SELECT list_sort(grams) AS grams, min(doc_id) AS node, len(grams) AS size FROM s WHERE len(grams) > 0 GROUP BY ALL),
    g AS MATERIALIZED (SELECT node, size, unnest(grams) AS gram FROM n),
    c AS (SELECT x.node AS u, y.node AS v, count(*) AS common, any_value(x.size) AS a, any_value(y.size) AS b FROM g x JOIN g y ON x.gram = y.gram AND x.node <> y.node
          AND 100 * least(x.size, y.size) >= 80 * greatest(x.size, y.size) GROUP BY ALL),
    l AS MATERIALIZED (SELECT u, v FROM c WHERE 100 * common >= 80 * (a + b - common)),
    reach AS (SELECT node, node AS other FROM n UNION SELECT reach.node, l.v FROM reach JOIN l ON reach.other = l.u),
    part AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node)
    SELECT s.doc_id, len(s.grams) AS n_shingles, coalesce(p.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(p.component_id, s.doc_id) AS kept
    FROM s LEFT JOIN n ON list_sort(s.grams) = n.grams LEFT JOIN part p ON p.node = n.node"""

#: CRC-32 of the bytes of a blob, by a table of 256 steps made here.
_CRC = """
    CREATE_TABLE AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
        lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || hex(encode({text}))[2 * i + 1:2 * i + 2])::BIGINT)),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"""


_TRIES = " ".join(f"WHEN begun + {wait} >= repair AND NOT f{k + 1} THEN {k + 1}" for k, wait in enumerate((0, 10, 30, 70, 150, 310)))
_WAITS = "[0, 10, 30, 70, 150, 310]"
_HASHES = ", ".join(f"{_crc(f"'{k}:' || conv_id || ':' || turn")} AS h{k}" for k in range(9))
ORACLE_SQL["op13_cascade"] = f"""
    WITH RECURSIVE {_CRC.replace("CREATE_TABLE", "crc_table")},
    t AS MATERIALIZED (SELECT conv_id, turn, {_crc("coalesce(text, '')")} AS weight, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p, {_HASHES} FROM conversations CROSS JOIN crc_table),
    f AS MATERIALIZED (SELECT conv_id, turn, p, weight, 7 * p AS arrival, CASE WHEN h0 % 5 > 0 AND h0 % 5 <= p THEN p - h0 % 5 END AS parent,
               h1 % 101 < 50 AS faulty, 7 * p + h2 % 101 AS repair, {", ".join(f"h{a + 2} % 3 = 0 AS f{a}" for a in range(1, 7))} FROM t),
    went AS (
        SELECT conv_id, p, CASE WHEN tries > 6 THEN 'dead' ELSE 'delivered' END AS status, least(tries, 6)::INT AS attempts, begun AS first_at, begun + {_WAITS}[least(tries, 6)] AS last_at
        FROM (SELECT *, CASE WHEN NOT faulty THEN 1 {_TRIES} ELSE 7 END AS tries FROM (SELECT *, arrival AS begun FROM f WHERE parent IS NULL))
        UNION ALL
        SELECT conv_id, p, CASE WHEN tries IS NULL THEN 'blocked' WHEN tries > 6 THEN 'dead' ELSE 'delivered' END, CASE WHEN tries IS NULL THEN 0 ELSE least(tries, 6) END::INT, CASE WHEN tries IS NOT NULL THEN begun END, CASE WHEN tries IS NOT NULL THEN begun + {_WAITS}[least(tries, 6)] END
        FROM (SELECT *, CASE WHEN begun IS NULL THEN NULL WHEN NOT faulty THEN 1 {_TRIES} ELSE 7 END AS tries
              FROM (SELECT f.*, CASE WHEN went.status = 'delivered' THEN greatest(arrival, went.last_at) END AS begun FROM f JOIN went ON f.conv_id = went.conv_id AND f.parent = went.p))),
    n AS (SELECT conv_id, p, row_number() OVER (PARTITION BY conv_id ORDER BY last_at, p) AS release_no FROM went WHERE status = 'delivered')
    SELECT f.conv_id, f.turn, w.status, w.attempts, w.first_at, w.last_at, n.release_no,
           CASE WHEN n.release_no IS NOT NULL THEN (sum(n.release_no * f.weight) OVER (PARTITION BY f.conv_id ORDER BY n.release_no NULLS LAST))::BIGINT END AS state
    FROM f JOIN went w USING (conv_id, p) LEFT JOIN n USING (conv_id, p)"""


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in ORACLE_SQL.items() if v}
