"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modlytics.llm import ann, bagminhash, bpe, chat, divergence, interaction, langid, lm, mixing, pii, secrets, toxicity
from modlytics.llm.common import remainder, table
from modlytics.llm.repetition import repetition

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


@query
def op6_repetition(spark: SparkSession, folder: str) -> DataFrame:
    """Repetition counts and the verdict for every document."""
    return repetition(table(spark, folder, "documents"))


ORACLES["op6_repetition"] = r"""WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM texts),
runs AS (
  SELECT doc_id, 3 AS n, i, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS size FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) UNION ALL
  SELECT doc_id, 5 AS n, i, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS size FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) UNION ALL
  SELECT doc_id, 8 AS n, i, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS size FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) UNION ALL
  SELECT doc_id, 10 AS n, i, string_agg(word, ' ') OVER w AS gram, count(*) OVER w AS size FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
grams AS (SELECT doc_id, n, i, count(*) OVER (PARTITION BY doc_id, n, gram) AS times FROM runs WHERE size = n),
inside AS (SELECT DISTINCT doc_id, n, unnest(range(i, i + n)) AS i FROM grams WHERE times > 1),
covered AS (SELECT doc_id, n, count(*) AS words, sum(length(word)) AS chars FROM inside JOIN placed USING (doc_id, i) GROUP BY ALL),
lines AS (
  SELECT doc_id, line, count(*) - 1 AS again FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM texts)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
copied AS (
  SELECT doc_id, CAST(sum(again) AS BIGINT) AS n, sum(again * length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g'))) AS chars
  FROM lines GROUP BY doc_id),
counts AS (
  SELECT t.doc_id, len(t.words) AS n_words, CAST(list_sum(list_transform(t.words, lambda w: length(w))) AS BIGINT) AS word_chars,
    length(t.text) - length(regexp_replace(t.text, '[#*$%&|<>]', '', 'g')) AS n_symbols FROM texts t),
shares AS (
  SELECT c.doc_id, c.n_words, coalesce(c.word_chars, 0) AS word_chars, c.n_symbols, coalesce(l.n, 0) AS n_dup_lines,
    coalesce(max(g.words) FILTER (g.n = 8), 0) AS n_repeat_words,
    coalesce(max(CAST(g.chars AS DOUBLE) / c.word_chars), CAST(0 AS DOUBLE)) AS gram_share,
    coalesce(CAST(max(l.chars) AS DOUBLE) / c.word_chars, CAST(0 AS DOUBLE)) AS line_share,
    coalesce(bool_or(CAST(g.chars AS DOUBLE) / c.word_chars > CASE g.n WHEN 3 THEN CAST(0.4 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END), false) AS failed
  FROM counts c LEFT JOIN covered g ON g.doc_id = c.doc_id LEFT JOIN copied l ON l.doc_id = c.doc_id
  GROUP BY c.doc_id, c.n_words, c.word_chars, c.n_symbols, l.n)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, gram_share, line_share,
  n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR failed OR line_share > CAST(0.3 AS DOUBLE)
    OR n_symbols > CAST(0.1 AS DOUBLE) * n_words) AS kept
FROM shares"""


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every document's token ids and of the bytes that they decode to."""
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(table(spark, folder, "documents"), tokens, public_tokenizers.PATTERN)


@query
def op5_secrets(spark: SparkSession, folder: str) -> DataFrame:
    """Secret spans of every document, with the ownership of each key counted over all of them."""
    return secrets.digests(secrets.find_secrets(table(spark, folder, "documents"), carry=["doc_id"]))


@query
def op10_bagminhash(spark: SparkSession, folder: str) -> DataFrame:
    """The near-duplicate class of every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bagminhash.classes(docs).select("doc_id", "class_id", "class_size", "first_of_class")


@query
def op4_langid(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every document, learnt from three quarters of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.train(docs, ~held_out)
    return langid.identify(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


@query
def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """The toxicity of every document, learnt from the labels of two thirds of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.train(docs, table(spark, folder, "labels"), ~held_out)
    return toxicity.score_texts(docs.withColumn("held_out", held_out), model, ["doc_id", "held_out"])


@query
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of every conversation, formatted and read back, and of one that holds control strings."""
    spiked = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(spiked)
    return chat.digests(chat.format_chats(turns))


ORACLES["op8_chat"] = r"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(text, '<(\\*)(/s>|s>)', '<\\\1\2', 'g'),
      '\[(\\*)(/?SYS\]|/?INST\]|ASST\]|ROLE\]|/?TEXT\])', '[\\\1\2', 'g') AS safe,
    regexp_replace(regexp_replace(role, '<(\\*)(/s>|s>)', '<\\\1\2', 'g'),
      '\[(\\*)(/?SYS\]|/?INST\]|ASST\]|ROLE\]|/?TEXT\])', '[\\\1\2', 'g') AS safe_role FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE role WHEN 'system' THEN length('[SYS][/SYS]') WHEN 'user' THEN length('[INST][/INST]')
    WHEN 'assistant' THEN length('[ASST]</s>') ELSE length('[ROLE][TEXT][/TEXT]') + length(safe_role) END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role, ' ' ORDER BY turn NULLS FIRST, role, text), '(system )?user assistant( user assistant)*') AS valid
FROM escaped GROUP BY conv_id"""


@query
def op7_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """How many words the mix takes of every document."""
    return mixing.mix_sizes(table(spark, folder, "documents"))


@query
def op1_ann(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 nearest neighbours found for every twentieth vector."""
    return ann.neighbours(table(spark, folder, "embeddings"), k=20, every=20)


@query
def op3_lm(spark: SparkSession, folder: str) -> DataFrame:
    """The log probability of every document, learnt from six sevenths of them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 7) == 2
    return lm.score_texts(docs.withColumn("held_out", held_out), ~held_out, ["doc_id", "held_out"])


@query
def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """How far each source's terms are from those of the other sources and of its language."""
    return divergence.divergence(table(spark, folder, "documents"))


ORACLES["op11_divergence"] = r"""WITH texts AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    list_transform(regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'),
      lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS terms FROM documents),
used AS (SELECT r, lang, source, unnest(terms) AS term FROM texts),
kept AS (SELECT lang, term, count(*) AS n FROM used GROUP BY ALL HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM texts),
counts AS (SELECT u.lang, u.source, u.term, count(*) AS n FROM used u JOIN kept k ON u.lang = k.lang AND u.term = k.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL),
shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 1)) // (coalesce(t.total, 0) + l.v) AS p,
    1 + (CAST(1000000000 AS HUGEINT) * (k.n + 1)) // (l.total + l.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang
  LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, CAST(((p - q) * (p - q)) // q AS BIGINT) AS value FROM shares WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u) r WHERE part = 'pair' OR rank <= 200"""


@query
def op12_interaction(spark: SparkSession, folder: str) -> DataFrame:
    """What five filters remove from every source at each place of each of their orders."""
    return interaction.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))


ORACLES["op12_interaction"] = r"""WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
marked AS (
  SELECT doc_id, part, CAST(len(words) < 200 AS INTEGER) * 16 + CAST(100 * len(list_distinct(words)) < 50 * len(words) AS INTEGER) * 8
    + CAST(100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text) AS INTEGER) * 4
    + CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) * 2
    + CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS code FROM texts),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, code, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM marked m LEFT JOIN known k ON m.doc_id = k.doc_id GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([16, 8, 4, 2, 1]) AS bit),
orders AS (
  SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
steps AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0) AS earlier
  FROM orders, (SELECT unnest(range(1, 6)) AS step) s),
counted AS (
  SELECT part, filter_order, step, bit,
    coalesce(sum(n) FILTER (code & (earlier + bit) = 0), 0) AS kept,
    coalesce(sum(n) FILTER (code & earlier = 0 AND code & bit > 0), 0) AS removed,
    coalesce(sum(n) FILTER (code & earlier > 0 AND code & bit > 0), 0) AS redundant,
    coalesce(sum(n) FILTER (code = bit), 0) AS unique_fails,
    coalesce(sum(good) FILTER (code & earlier = 0 AND code & bit > 0), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (code & earlier = 0 AND code & bit > 0), 0) AS toxic_lost
  FROM cells, (SELECT filter_order, step, CAST(bit AS BIGINT) AS bit, CAST(earlier AS BIGINT) AS earlier FROM steps) s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted"""


@query
def op13_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal data in every document, with their scores."""
    return pii.digests(pii.find_pii(table(spark, folder, "documents"), carry=["doc_id"]))


def listed_sql(values: dict[str, object], kind: str) -> str:
    """CASE over the kinds of a dictionary."""
    return f"CASE {kind} " + " ".join(f"WHEN '{name}' THEN '{value}'" for name, value in values.items()) + " END"


#: The same patterns for an engine that needs neither possessive runs nor look-behind.
PII_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]", "iban": r"[A-Z]{2}[0-9]{2}( ?[A-Z0-9]){11,30}",
    "insee": r"[12]( ?[0-9]){14}", "dni": r"[0-9]{8}-?[A-Z]", "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}

# The text between matches gives their places; the checks are sums and remainders over lists of digits.
ORACLES["op13_pii"] = rf"""WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
kinds AS (SELECT unnest({list(PII_PATTERNS)}) AS kind, unnest(range({len(PII_PATTERNS)})) AS rank, unnest([{", ".join(f"'{pattern}'" for pattern in PII_PATTERNS.values())}]) AS pattern),
matched AS (SELECT r, kind, rank, text, regexp_extract_all(text, pattern) AS found, string_split_regex(text, pattern) AS gaps FROM texts, kinds),
placed AS (
  SELECT r, kind, rank, text, found[i] AS m, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS a
  FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM matched) u),
sized AS (
  SELECT * REPLACE (CASE WHEN kind = 'iban' THEN substr(m, 1, coalesce(list_min(list_filter(range(1, length(m) + 1),
    lambda i: length(replace(substr(m, 1, i), ' ', '')) = size)), 0)) ELSE m END AS m)
  FROM (SELECT *, CAST(coalesce({listed_sql(pii.IBAN_LENGTHS, "substr(m, 1, 2)")}, '0') AS INTEGER) AS size FROM placed) p),
read AS (
  SELECT r, kind, rank, text, m, a, a + length(m) AS b, regexp_replace(m, '[^0-9]', '', 'g') AS digits, replace(m, ' ', '') AS plain,
    concat(CASE WHEN a > 0 THEN substr(text, a, 1) ELSE '' END, substr(text, a + length(m) + 1, 1)) AS edges,
    translate(concat(substr(text, greatest(a - {pii.BEFORE}, 0) + 1, least(a, {pii.BEFORE})), chr(10), substr(text, a + length(m) + 1, {pii.AFTER})),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS near FROM sized WHERE m <> ''),
checked AS (
  SELECT * FROM read WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || substr(ltrim(x, '0'), 1, 3) AS INTEGER) <= 255))
    WHEN 'card' THEN length(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(digits), i, 1) AS INTEGER)
        ELSE 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) // 10 + 2 * CAST(substr(reverse(digits), i, 1) AS INTEGER) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(digits) BETWEEN 9 AND 15
    WHEN 'iban' THEN list_reduce(list_transform(string_split(array_to_string(list_transform(string_split(substr(plain, 5) || substr(plain, 1, 4), ''),
      lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE CAST(ord(x) - 55 AS VARCHAR) END), ''), ''), lambda x: CAST(x AS INTEGER)), lambda x, y: (x * 10 + y) % 97) = 1
    WHEN 'insee' THEN substr(digits, 4, 2) BETWEEN '01' AND '12' AND 97 - CAST(substr(digits, 1, 13) AS BIGINT) % 97 = CAST(substr(digits, 14, 2) AS BIGINT)
    WHEN 'dni' THEN substr('{pii.DNI_LETTERS}', CAST(substr(digits, 1, 8) AS INTEGER) % 23 + 1, 1) = right(m, 1)
    WHEN 'ssn' THEN substr(m, 1, 3) NOT IN ('000', '666') AND substr(m, 1, 3) < '900' AND substr(m, 5, 2) <> '00' AND substr(m, 8, 4) <> '0000'
    ELSE true END
  AND CASE WHEN kind = 'insee' THEN NOT regexp_matches(edges, '[0-9]') WHEN kind IN {pii.MORE} THEN NOT regexp_matches(edges, '[0-9A-Za-z]') ELSE true END),
scored AS (
  SELECT r, kind, rank, a, b, least(100, greatest(0, CAST({listed_sql(pii.START, "kind")} AS INTEGER)
    + CASE WHEN regexp_matches(near, {listed_sql(pii.FOR, "kind")}) THEN {pii.RAISE} ELSE 0 END
    - CASE WHEN regexp_matches(near, '{pii.AGAINST}') THEN {pii.LOWER} ELSE 0 END)) AS score FROM checked),
stay AS (
  SELECT * FROM scored s WHERE rank < 4 OR (score >= {pii.ENOUGH}
    AND NOT EXISTS (SELECT 1 FROM scored o WHERE o.r = s.r AND o.rank < 4 AND o.a < s.b AND s.a < o.b))),
joined AS (
  SELECT r, {", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind in pii.KINDS)},
    string_agg(concat_ws(':', kind, a, b), ',' ORDER BY rank, a) FILTER (rank < 4) AS base,
    string_agg(concat_ws(':', kind, a, b), ',' ORDER BY rank, a) AS spans, string_agg(concat_ws(':', kind, a, score), ',' ORDER BY rank, a) AS scores
  FROM stay GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind in pii.KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM texts LEFT JOIN joined USING (r)"""
