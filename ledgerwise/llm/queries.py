"""The operators of this subpackage applied to the whole test tables, with SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwise.llm import (
    binary_codes,
    bpe,
    chat,
    class_lm,
    collocations,
    cotraining,
    exact_dups,
    filter_audit,
    language,
    lines,
    media,
    mixing,
    near_dups,
)
from ledgerwise.llm.common import crc_remainder, table

Run = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Run] = {}
QUERY_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Run) -> Run:
        QUERIES[name] = run
        if sql is not None:
            QUERY_SQL[name] = sql
        return run

    return add


# ASCII letters only, as the contracts lower-case them.
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]+"

OP1_SQL = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER}, '{SPACE}'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE
    list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s
  FROM w
), items AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS item FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM items x JOIN items y
    ON x.item = y.item AND x.doc_id <> y.doc_id
    AND 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n)
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.other = links.a
), least_id AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, component_id = doc_id AS kept
FROM sets JOIN least_id USING (doc_id)
"""


@query("op1_minhash_near_dedup", OP1_SQL)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_dups.near_duplicates(table(spark, folder, "documents"), words=2)


OP4_SQL = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS nr FROM split
), keyed AS (
  SELECT doc_id, nr, line, translate(
    trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key, true AS gone FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (gone IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent USING (key) GROUP BY doc_id
"""


@query("op3_media_signatures")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return media.texts_as_media(table(spark, folder, "documents"))


@query("op4_line_dedup", OP4_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    done = lines.drop_frequent_lines(table(spark, folder, "documents"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256)
    return done.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


OP6_SQL = f"""
WITH rows AS (
  SELECT doc_id, coalesce('s' || source, 'null') AS name, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ' 0') AS mark
  FROM documents
), sources AS (
  SELECT name, source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS docs FROM rows GROUP BY ALL
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources
), filled AS (
  -- Sources in the order in which they reach twice their size; the rate if all before them are full.
  SELECT *, 2.0 * source_size / weight AS full_at, (SELECT sum(source_size) FROM sources) * 150 / 100.0 AS total,
    coalesce(sum(2 * source_size) OVER earlier, 0) AS full_before,
    sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weight_left
  FROM weighed
  WINDOW earlier AS (ORDER BY 2.0 * source_size / weight, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rate AS (
  SELECT CAST(total - full_before AS DOUBLE) / CAST(weight_left AS DOUBLE) AS rate FROM filled
  WHERE CAST(total - full_before AS DOUBLE) / weight_left < full_at ORDER BY full_at, name LIMIT 1
), targets AS (
  SELECT name, source_size, least(2.0::DOUBLE * source_size, weight * rate) AS target,
    least(CAST(ceil(docs / 128.0) AS BIGINT), 4096) AS shards
  FROM weighed, rate
), seats AS (
  SELECT CAST(floor(sum(target) / 16 + 0.5) AS BIGINT) AS all_blocks FROM targets
), source_quotients AS (
  SELECT name, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, name) AS place
  FROM (SELECT name, target, unnest(range(CAST(target / 8 AS BIGINT) + 2)) AS k FROM targets)
), dealt AS (
  SELECT t.*, count(place) AS blocks FROM targets t
  LEFT JOIN (SELECT name, place FROM source_quotients, seats WHERE place <= all_blocks) q USING (name)
  GROUP BY ALL
), placed AS (
  SELECT r.*, d.source_size, d.target, d.blocks, CAST('0x' || substr(mark, 1, 8) AS BIGINT) % shards AS shard
  FROM rows r JOIN dealt d USING (name)
), streams AS (
  SELECT name, shard, blocks, CAST(sum(size) AS BIGINT) AS stream,
    target * sum(size)::BIGINT / greatest(source_size, 1) AS share
  FROM placed GROUP BY name, shard, blocks, target, source_size
), shard_quotients AS (
  SELECT name, shard, blocks, row_number() OVER (PARTITION BY name ORDER BY share / (2 * k + 1) DESC, shard) AS place
  FROM (SELECT name, shard, blocks, share, unnest(range(CAST(share / 8 AS BIGINT) + 2)) AS k FROM streams)
), quotas AS (
  SELECT s.name, s.shard, s.stream, least(count(place) * 16, 2 * s.stream) AS run,
    (CAST('0x' || substr(md5(s.shard || ' ' || s.name || ' 0'), 1, 8) AS BIGINT) * 16) % greatest(s.stream, 1) AS start
  FROM streams s LEFT JOIN (SELECT name, shard, place FROM shard_quotients WHERE place <= blocks) q USING (name, shard)
  GROUP BY s.name, s.shard, s.stream
), ordered AS (
  SELECT p.*, q.stream, q.run, q.start, CASE WHEN q.stream > 0 THEN q.run // q.stream ELSE 0 END AS turns,
    coalesce(sum(size) OVER (PARTITION BY name, shard ORDER BY mark ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM placed p JOIN quotas q USING (name, shard)
), ended AS (
  SELECT *, start + run - turns * stream AS finish FROM ordered
)
SELECT doc_id, size, source_size, target, CAST(turns * size
  + greatest(least(begins + size, finish, stream) - greatest(begins, start), 0)
  + greatest(least(begins + size, finish - stream) - begins, 0) AS BIGINT) AS taken
FROM ended
"""


@query("op6_source_mixing", OP6_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    mix = mixing.mixed(table(spark, folder, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


# The template's control strings, in the order in which texts are escaped.
_ESCAPED = r"replace(coalesce(text, ''), '\', '\\')"
for _control in chat.TEMPLATE.controls:
    _ESCAPED = f"replace({_ESCAPED}, '{_control}', '{_control[0]}\\{_control[1:]}')"
_MARKS = " ".join(
    f"WHEN '{role}' THEN {len(part.before) + len(part.after)}" for role, part in chat.TEMPLATE.roles.items()
)
OP8_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text,
    length({_ESCAPED}) + CASE role {_MARKS} END AS chars,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
  FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN previous IS NULL
    WHEN 'user' THEN previous IS NULL OR previous IN ('system', 'assistant')
    ELSE coalesce(previous = 'user', false) END) AS in_order
FROM sized GROUP BY conv_id
"""


@query("op8_chat_formatting", OP8_SQL)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").union(own)
    return chat.read_back(chat.format_chats(turns))


@query("op9_bpe_tokens")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encoded(table(spark, folder, "documents"), ids=False, digests=True)


@query("op10_language_id")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", crc_remainder(F.col("doc_id"), 4) == 2)
    model = language.learn_languages(docs.where("not held_out").select("doc_id", "text", "lang"))
    held = docs.select(F.struct("doc_id", "held_out").alias("row"), "text")
    found = language.identified(held, model, "row")
    return found.select("doc_id.doc_id", "doc_id.held_out", "lang_pred", "score")


@query("op5_quality_cotraining")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = cotraining.learn_quality(docs, table(spark, folder, "labels"))
    return cotraining.scored(docs, model).withColumn("accepted", F.col("score") >= cotraining.THRESHOLD)


OP7_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y
    ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
  WHERE list_cosine_similarity(x.v, y.v) >= 0.93
), reach AS (
  SELECT vec_id, vec_id AS other FROM embeddings
  UNION
  SELECT reach.vec_id, links.b FROM reach JOIN links ON reach.other = links.a
), least_id AS (
  SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), degrees AS (
  SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, component_id = vec_id AS kept
FROM least_id LEFT JOIN degrees USING (vec_id)
"""


@query("op7_embedding_near_dedup", OP7_SQL)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return binary_codes.near_vectors(table(spark, folder, "embeddings"))


@query("op2_brown_class_scores")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return class_lm.class_scores(docs.withColumn("held_out", crc_remainder(F.col("doc_id"), 7) == 2))


OP11_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


@query("op11_exact_dedup", OP11_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dups.exact_duplicates(table(spark, folder, "documents"), largest=True)


OP12_SQL = f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
    list_filter(string_split_regex(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w FROM documents
), marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), fails AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
    (CASE WHEN len(w) < 100 THEN 'A' ELSE '' END)
    || (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 'B' ELSE '' END)
    || (CASE WHEN 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END)
    || (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END)
    || (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS failed
  FROM texts LEFT JOIN marks USING (doc_id)
), sets AS (
  SELECT part, failed, good, toxic, count(*) AS n FROM fails GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, substr(filter_order, 1, step - 1) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), judged AS (
  SELECT part, filter_order, step, own, n, good, toxic, contains(failed, own) AS fails, failed = own AS only_this,
    failed <> '' AND before <> '' AND len(list_intersect(string_split(failed, ''), string_split(before, ''))) > 0 AS gone
  FROM sets, steps
), totals AS (
  SELECT part, filter_order, CAST(step AS INTEGER) AS step, own,
    CAST(coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone AND fails), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (only_this), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (NOT gone AND fails AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM judged GROUP BY ALL
)
SELECT * EXCLUDE (own), CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM totals
"""


@query("op12_filter_audit", OP12_SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


OP13_SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), split AS (
  SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces
), runs AS (
  SELECT lang, 1 AS k, unnest(w) AS phrase FROM split
  UNION ALL
  SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM split
  UNION ALL
  SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  FROM split
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM runs GROUP BY ALL
), cuts AS (
  SELECT c.lang, c.k AS size, c.phrase, c.f AS a, cut, array_to_string(string_split(c.phrase, ' ')[1:cut], ' ') AS head,
    array_to_string(string_split(c.phrase, ' ')[cut + 1:], ' ') AS tail
  FROM f c, (SELECT unnest([1, 2]) AS cut) WHERE c.k > 1 AND cut < c.k AND c.f >= 10
), scores AS (
  SELECT cuts.*, x.f AS l, y.f AS r,
    CAST((1000000::HUGEINT * a * a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.k = cut AND x.phrase = head
    JOIN f y ON y.lang = cuts.lang AND y.k = size - cut AND y.phrase = tail
), worst AS (
  SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), longer AS (
  SELECT lang, part, max(f) AS f FROM (
    SELECT lang, f, array_to_string(string_split(phrase, ' ')[s:s + 1], ' ') AS part
    FROM f, (SELECT unnest([1, 2]) AS s) WHERE k = 3 AND f >= 10) GROUP BY ALL
), sizes AS (
  SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang
), best AS (
  SELECT worst.*, row_number() OVER (PARTITION BY worst.lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM worst LEFT JOIN longer ON longer.lang = worst.lang AND part = phrase
  WHERE size = 3 OR longer.f IS NULL OR 100 * longer.f < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM best JOIN sizes USING (lang) WHERE rank <= 2000
"""


@query("op13_collocations", OP13_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))
