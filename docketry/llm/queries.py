"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, op01_pii, op02_mixing, op03_langid, op04_lines, op05_exact, op06_minhash, op07_html, op08_embeddings, op09_chat, op10_packing, op11_repair, op12_collocations, op13_media


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: For the given tables, whose personal data are invented; a session that sets a key of its own uses that.
QUERY_KEY = "only for invented data"


def op1_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op01_pii.pseudonymise(_table(spark, sf_dir, "documents"), spark.conf.get(op01_pii.KEY_SETTING, QUERY_KEY))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = op03_langid.train(docs.filter(~op03_langid.held_out()))
    return op03_langid.predict(docs, model).select("doc_id", op03_langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_lines.drop_spread_lines(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op05_exact.exact_groups(_table(spark, sf_dir, "documents")).drop("n_chunks")


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op06_minhash.near_groups(_table(spark, sf_dir, "documents"))


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_html.main_text(_table(spark, sf_dir, "pages"))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op08_embeddings.near_vectors(_table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(r"\### Assistant: </turn> ok").alias("text"),
    )
    made = op09_chat.format_conversations(turns.unionByName(trap))
    keep = ("formatted", "segments", "valid", "off_at")
    back = op09_chat.read_back(made.select("conv_id", *keep), keep=keep)
    loss = op09_chat.loss_text("segments")
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", "off_at",
    )


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_packing.pack(_table(spark, sf_dir, "documents"))


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op11_repair.repair(op11_repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_collocations_mined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the shards are what the rows point at, so they stay as long as the rows
    made = op13_media.media_columns(_table(spark, sf_dir, "documents"), common.new_path(spark, "shards"))
    return made.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "bits", "shard", "offset",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_feistel_pii, op2_mix_sources, op3_language_id, op4_line_spread, op5_exact_dedup,
        op6_minhash_dedup, op7_main_text, op8_embedding_dedup, op9_chat_format, op10_pack,
        op11_repair_conversations, op12_collocations_mined, op13_media_columns,
    )
}

_REACH = """
both_ways AS (SELECT x AS a, y AS b FROM links UNION ALL SELECT y, x FROM links),
reach(id, root) AS (SELECT id, id FROM ids UNION SELECT b, root FROM reach JOIN both_ways ON a = id),
part AS (SELECT id, min(root) AS component_id FROM reach GROUP BY id)
"""

#: CRC-32 of the bytes (a list of integers) that {0} makes.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, {0}), lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
        lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""

#: The least of options (cost, letters) of which some are null, and an option behind an inserted turn.
_LEAST = "list_sort(list_filter([{0}], lambda o: o IS NOT NULL))[1]"
_ADD = "{{'c': {0}.c + {1}, 's': '{2}' || {0}.s}}"
_NEVER = "{'c': 1000000000, 's': ''}"


def _row_options(q: int, moves: dict[str, int]) -> str:
    """The cheapest way on from state q through a row, behind which the states' ways are y0 to y3."""
    ways = [_ADD.format(f"y{q}", 4, "D")]
    free = "fault NOT IN ('blank', 'duplicate')"
    late = "(CASE fault WHEN 'truncated' THEN 3 ELSE 0 END)"
    ways += [f"CASE WHEN {free} AND left(role, 1) = '{x}' THEN {_ADD.format(f'y{t}', late, 'K')} END" for x, t in moves.items()]
    ways += [f"CASE WHEN {free} THEN {_ADD.format(f'y{t}', f'3 + {late}', 'R')} END" for x, t in moves.items() if x in "ua"]
    return f"{_LEAST.format(', '.join(ways))} AS x{q}"


#: Ways on from each state, at most two turns inserted first.
_WITH_INSERTS = ", ".join(
    f"{_LEAST.format(', '.join([f'x{q}', *ways]))} AS y{q}"
    for q, ways in enumerate((
        [_ADD.format("x2", 3, "I"), _ADD.format("x3", 6, "II")], [_ADD.format("x2", 3, "I"), _ADD.format("x3", 6, "II")],
        [_ADD.format("x3", 3, "I")], [_ADD.format("x2", 3, "I")],
    ))
)

ORACLE_SQL = {
    "op11_repair_conversations": rf"""
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
d AS (SELECT *, {_CRC.format("list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)")} % 20 AS d FROM src),
m AS (
    SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy,
        CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM d WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM m),
f AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
        WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault,
        lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) NOT IN ('su', 'ua', 'au') AS off,
        count(*) OVER (PARTITION BY conv_id) AS n FROM o),
ways AS (
    SELECT DISTINCT conv_id, n + 1 AS i, {{'c': 0, 's': ''}} AS y0, {{'c': 6, 's': 'II'}} AS y1, {{'c': 3, 's': 'I'}} AS y2, {{'c': 0, 's': ''}} AS y3 FROM f
    UNION ALL
    SELECT conv_id, i, {_WITH_INSERTS} FROM (
        SELECT f.conv_id, f.i, {", ".join(_row_options(q, m) for q, m in enumerate(({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})))}
        FROM ways JOIN f ON f.conv_id IS NOT DISTINCT FROM ways.conv_id AND f.i = ways.i - 1)),
best AS (SELECT conv_id, y0.c::BIGINT AS cost, y0.s AS audit FROM ways WHERE i = 1),
step AS (SELECT conv_id, audit, unnest(range(1, len(audit) + 1)) AS p FROM best),
spot AS (
    SELECT conv_id, audit[p] AS e, len(replace(audit[1:p], 'I', '')) AS i, len(replace(audit[1:p], 'D', '')) - 1 AS place,
        len(replace(audit, 'D', '')) % 2 AS odd FROM step),
fixed AS (
    SELECT spot.conv_id, sha256(string_agg(CASE e WHEN 'K' THEN role ELSE CASE (place - odd) % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END
        || ':' || CASE e WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS sha
    FROM spot LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM spot.conv_id AND o.i = spot.i WHERE e <> 'D' GROUP BY 1),
told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (WHERE fault = 'blank'))::BIGINT AS blank,
        (count(*) FILTER (WHERE fault = 'duplicate'))::BIGINT AS duplicate, (count(*) FILTER (WHERE fault = 'truncated'))::BIGINT AS truncated,
        (count(*) FILTER (WHERE off))::BIGINT AS illegal FROM f GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN fixed ON fixed.conv_id IS NOT DISTINCT FROM c.conv_id
""",
    "op12_collocations_mined": r"""
WITH p AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM w, range(1, 6) t(k)),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 100),
inside AS (
    SELECT lang, a, array_to_string(ws[i:i + size - 1], ' ') AS phrase FROM (
        SELECT *, unnest(range(1, k - size + 2)) AS i FROM c, range(2, 5) t(size) WHERE size < k)),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM inside x WHERE x.lang = c.lang AND x.phrase = c.phrase AND 100 * x.a >= 100 * c.a)),
cuts AS (SELECT *, array_to_string(ws[1:cut], ' ') AS lp, array_to_string(ws[cut + 1:k], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS cut FROM kept)),
s AS (
    SELECT cuts.lang, cuts.phrase, a, cut, x.f AS l, y.f AS r, n, (1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS score FROM cuts
    JOIN f x ON x.lang = cuts.lang AND x.phrase = lp JOIN f y ON y.lang = cuts.lang AND y.phrase = rp JOIN n ON n.lang = cuts.lang),
best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
""",
    "op4_line_spread": r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT rid, doc_id, source, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
b AS (SELECT trim(line, ' ' || chr(9)) AS k FROM l WHERE trim(line, ' ' || chr(9)) <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(b.k)::BIGINT AS n_dropped,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.k IS NULL), '') AS text
FROM l LEFT JOIN b ON trim(line, ' ' || chr(9)) = b.k GROUP BY rid
""",
    "op5_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
""",
    "op6_minhash_dedup": rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(ws) >= 5 THEN [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)]
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
ids AS (SELECT id, len(sh)::BIGINT AS n FROM s),
u AS (SELECT id, unnest(sh) AS h FROM s),
p AS (SELECT a.id AS x, b.id AS y, count(*) AS c FROM u a JOIN u b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM p JOIN ids a ON a.id = x JOIN ids b ON b.id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
{_REACH}
SELECT id AS doc_id, n AS n_shingles, component_id, id = component_id AS kept FROM ids JOIN part USING (id)
""",
    "op8_embedding_dedup": rf"""
WITH RECURSIVE e AS (
    SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
fit AS (SELECT * FROM e WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0
    AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
ids AS (SELECT id FROM e),
links AS (SELECT a.id AS x, b.id AS y FROM fit a JOIN fit b ON a.label = b.label AND len(a.v) = len(b.v) AND a.id < b.id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
{_REACH},
deg AS (SELECT a AS id, count(*)::BIGINT AS n FROM both_ways GROUP BY 1)
SELECT id AS vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, id = component_id AS kept FROM part LEFT JOIN deg USING (id)
""",
    "op9_chat_format": r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
n AS (SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(role) OVER w, '^') || '>' || role NOT IN ('^>system', '^>user', 'system>user', 'user>assistant', 'assistant>user') AS off,
    lead(role) OVER w IS NULL AND role = 'assistant' AS ends FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum(15 + length(role) + length(text) + length(role || text) - length(replace(replace(role || text, '\', ''), '<', ''))
        + length(role) - length(replace(role, '>', '')))::BIGINT AS formatted_chars,
    bool_or(ends) AND NOT bool_or(off) AS valid, coalesce(min(pos) FILTER (WHERE off), -1)::BIGINT AS off_at
FROM n GROUP BY conv_id
""",
}
