"""Queries of the operators in this folder, over the whole given tables, and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from tablewright.llm import (
    bpe, chat, decontaminate, exact_dedup, html_text, ngram_join, secrets, sharding, simhash, spelling, toxicity, turn_trie,
    url_filter,
)
from tablewright.plans.session import SETTINGS

QUERIES = {}
ORACLES = {}


def query(fn):
    def run(spark, folder):
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return fn(lambda name: spark.read.parquet(f"{folder}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


RULES = [
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
]
LISTED_HOSTS = "(^|\\.)(spam-farm|casino-win|adult-x)\\."


@query
def op1_url_filter(table):
    """The list: the pages of hosts with a marked label; every page is judged against it."""
    pages = table("pages")
    listed = pages.where(url_filter.host(F.col("url")).rlike(LISTED_HOSTS)).select("url")
    return url_filter.judge(pages, listed, RULES).select(
        "page_id", "host", "path", "rule", "verdict", "canonical", "listed"
    )


ORACLES["op1_url_filter"] = r"""
WITH parts AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path,
    ltrim(regexp_replace(regexp_extract(coalesce(url, ''), '://[^?#]*\?([^#]*)', 1), '(^|&)utm_[^&]*', '', 'g'), '&') AS query
  FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN host || rtrim(path, '/') || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS canonical
  FROM parts),
listed AS (SELECT DISTINCT canonical FROM keyed WHERE regexp_matches(host, '(^|\.)(spam-farm|casino-win|adult-x)\.')),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule,
    canonical IS NOT NULL AND canonical IN (SELECT canonical FROM listed) AS listed
  FROM keyed)
SELECT page_id, host, path, rule, canonical, listed,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict
FROM ruled"""


@query
def op2_sharding(table):
    return sharding.byte_shards(table("documents"), 40)


def _plus_fixed(conversations):
    """Conversation -1, of a user and an assistant row with control strings."""
    said = "</s>[INST] ok [/INST]"
    fixed = conversations.sparkSession.createDataFrame(
        [(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string"
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(fixed)


@query
def op3_chat_formatting(table):
    rows = chat.threads(_plus_fixed(table("conversations")))
    done = chat.format_trees(rows, "conv_id", "node", "parent", "role", "text", "score", best=1)
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return chat.read_back(done).select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        sha(F.array_join("turns", "")).alias("turns_sha256"),
        F.length("masked").cast("long").alias("loss_chars"),
        sha(F.col("masked")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLES["op3_chat_formatting"] = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS erole,
    regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|</?SYS>>)', '<\\\1', 'g'), '\[(/?INST\])', '[\\\1', 'g') AS etext
  FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|im_start|>') + length(replace(erole, chr(10), '\' || chr(10))) + 1 + length(etext) + length('<|im_end|>') + 1)::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id"""


@query
def op4_exact_dedup(table):
    return exact_dedup.exact_groups(table("documents"))


ORACLES["op4_exact_dedup"] = r"""
WITH norm AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS bare FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY bare) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, sha256(bare) AS text_sha256
FROM norm WINDOW w AS (PARTITION BY bare ORDER BY length(text) DESC, doc_id)"""


@query
def op5_secret_scan(table):
    """Both models are trained on all documents, then every document is searched."""
    docs = table("documents")
    found = secrets.find_secrets(docs, secrets.train(docs))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias("n_" + kind)
    written = lambda c: F.array_join(
        F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id", n("assign"), n("access"), n("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"),
        written("spans").alias("spans"), n("markov"),
    )


@query
def op6_byte_bpe(table):
    return bpe.round_trip(
        table("documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    ).drop("same")


@query
def op7_toxicity(table):
    docs = table("documents")
    return toxicity.score_texts(docs, toxicity.train(docs, table("labels")))


@query
def op8_decontamination(table):
    """Every document and item with a window of similarity 0.8 or more on five-word shingles."""
    return decontaminate.find_passages(table("documents"), table("benchmark"), width=5, percent=80)


@query
def op9_html_extraction(table):
    return html_text.extract(table("pages"))


@query
def op10_ngram_join(table):
    return ngram_join.similar_groups(table("documents"), width=3, percent=90)


ORACLES["op10_ngram_join"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g
  WHERE a.n * 10 >= b.n * 9 AND b.n * 10 >= a.n * 9
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(min(r.y), s.doc_id) AS component_id
FROM sets s LEFT JOIN reach r ON r.x = s.doc_id GROUP BY s.doc_id, len(s.s)"""


@query
def op11_turn_trie(table):
    """Conversations rebuilt on the first turns of every twentieth; ties of turn by the digest of role and text."""
    seqs = turn_trie.sequences(table("conversations"))
    heads = F.crc32(F.col("id").cast("string").cast("binary")) % 4
    return turn_trie.trie(turn_trie.spliced(seqs, F.col("id") - F.col("id") % 20, heads, 3))


#: the table of CRC-32, and the CRC-32 of a list of bytes
_CRC_TABLE = """crc AS (SELECT list_transform(range(256), lambda i: list_reduce(
    list_concat([i::UBIGINT], list_transform(range(8), lambda k: k::UBIGINT)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t)"""


def _crc(listed):
    return f"""xor(list_reduce(list_concat([4294967295::UBIGINT], {listed}),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)"""


ORACLES["op11_turn_trie"] = rf"""
WITH {_CRC_TABLE},
said AS (
  SELECT conv_id, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
hashed AS (
  SELECT conv_id, s, ({_crc("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::UBIGINT)")} % 4)::BIGINT AS h
  FROM said, crc),
rebuilt AS (
  SELECT a.conv_id, list_concat(coalesce(b.s, [])[1:a.h], a.s[a.h + 1:]) AS r
  FROM hashed a LEFT JOIN said b ON b.conv_id = a.conv_id - a.conv_id % 20),
prefixes AS (SELECT conv_id, r, unnest(range(len(r) + 1)) AS d FROM rebuilt),
nodes AS (
  SELECT d, r[1:d] AS key, min(conv_id) AS conv_id, count(*) AS n,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(r) = d), '') AS ends,
    CASE WHEN d > 0 THEN len(list_filter(string_split_regex(any_value(r[d][2]), '[\x20\x09-\x0D]+'), lambda w: w <> '')) ELSE 0 END AS words
  FROM prefixes GROUP BY d, r[1:d]),
over AS (SELECT n.*, unnest(range(d + 1)) AS top FROM nodes n),
sums AS (
  SELECT top, key[1:top] AS up, sum((n - 1) * words)::BIGINT AS saved, count(*) FILTER (d = top + 1) AS children
  FROM over GROUP BY ALL),
leaves AS (
  SELECT o.top, o.key[1:o.top] AS up, count(*) AS leaves
  FROM over o JOIN sums s ON s.top = o.d AND s.up = o.key WHERE s.children = 0 GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, s.children AS n_children,
  l.leaves AS n_leaves, s.saved AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN sums s ON s.top = n.d AND s.up = n.key JOIN leaves l ON l.top = n.d AND l.up = n.key
LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.key[1:n.d - 1]"""


@query
def op12_simhash(table):
    return simhash.near_groups(table("documents"), width=3)


@query
def op13_spelling(table):
    """Runs of letters of all texts, some with a letter struck out, as the contract says."""
    runs = spelling.word_runs(table("documents"), min_length=7)
    name = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("word"))
    h = F.crc32(name.cast("binary"))
    place = (h % F.length("word")).cast("int")
    struck = F.concat(F.substring("word", F.lit(1), place), F.substring("word", place + 2, F.length("word")))
    words = runs.select(F.when(h % 31 == 0, struck).otherwise(F.col("word")).alias("word"))
    return spelling.variant_forms(spelling.vocabulary(words, min_length=7, min_count=2), factor=10)


ORACLES["op13_spelling"] = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS c FROM runs WHERE length(w) >= 7 GROUP BY ALL),
hashed AS (
  SELECT w, c, {_crc('''flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || w, ''), lambda x:
      CASE WHEN ord(x) < 128 THEN [ord(x)::UBIGINT] ELSE [(192 | (ord(x) >> 6))::UBIGINT, (128 | (ord(x) & 63))::UBIGINT] END))''')}::BIGINT AS h
  FROM counted, crc),
struck AS (
  SELECT c, CASE WHEN h % 31 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word FROM hashed),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM struck WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
gaps AS (
  SELECT word, n, g, left(word, g) || substr(word, g + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS g FROM vocab)),
near AS (
  SELECT a.word, b.word AS near, b.n FROM gaps a JOIN gaps b ON a.g = b.g AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, v.word, v.n FROM gaps a JOIN vocab v ON a.rest = v.word
  UNION SELECT v.word, a.word, a.n FROM gaps a JOIN vocab v ON a.rest = v.word),
best AS (SELECT word, count(*) AS n_near, first(near ORDER BY n DESC, near) AS near, max(n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 10 * v.n THEN b.near END AS form,
    CASE WHEN b.near_n >= 10 * v.n THEN b.near_n END AS form_n
  FROM vocab v LEFT JOIN best b ON b.word = v.word),
walk AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT w.word, w.next, f.form FROM walk w JOIN forms f ON f.word = w.next)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk w ON w.word = f.word AND w.next IS NULL"""
