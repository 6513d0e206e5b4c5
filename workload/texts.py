"""Text expressions, similarity joins, pages, record pairs."""

from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators import entity as en, pages as pg, simjoin as sj, table as tb
from tablewright.plans.lineage import cut
from workload.registry import query, r, rounded, tok

SETS = f"""SELECT list_sort(list_distinct({{tok}})) AS l, min({{id}}) AS rep, count(*) AS copies FROM {{table}}
  GROUP BY 1 HAVING len(l) > 0"""


def sets_sql(table, key, text):
    return SETS.format(tok=tok(text), id=key, table=table)


# -- expressions ------------------------------------------------------------


@query(
    r"""SELECT p_partkey, upper(regexp_replace(trim(regexp_replace('  ' || p_name || '  x ', '\s+', ' ', 'g')), ' ', '_', 'g')) AS label,
    upper(p_name[1]) || lower(p_name[2:strpos(p_name, ' ') - 1]) || '''' || upper(p_name[strpos(p_name, ' ') + 1])
      || lower(p_name[strpos(p_name, ' ') + 2:]) || '-#' || regexp_extract(p_brand, '\d+') AS title,
    p_name || ' ' || p_brand AS joined, 2043 - p_size AS age,
    CASE WHEN p_size > 25 THEN 'http://www.example.org/a/' || p_name ELSE 'http://www.example.org/b' END AS link,
    CASE WHEN p_size > 25 THEN p_name ELSE 'b' END AS file FROM part"""
)
def text_expressions(t):
    spaced = F.concat(F.lit("  "), "p_name", F.lit("  x "))
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("'")), F.lit("-#"), F.regexp_extract("p_brand", r"\d+", 0))
    link = F.when(F.col("p_size") > 25, F.concat(F.lit("http://www.example.org/a/"), "p_name")).otherwise(F.lit("/b"))
    full = tx.absolute_link(link, "http://www.example.org")
    return t.part.select(
        "p_partkey",
        tx.link_label(spaced).alias("label"),
        tx.title_case(raw).alias("title"),
        tx.joined_text("p_name", "p_brand", F.lit(None)).alias("joined"),
        tx.age_in(2020, "p_size").alias("age"),
        full.alias("link"),
        tx.page_file(F.concat(full, F.lit("?q=1"))).alias("file"),
    )


@query(
    f"""WITH w AS (SELECT doc_id, {tok('text')} AS w FROM documents)
    SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words, md5(array_to_string(w, ' ')) AS digest FROM w"""
)
def document_tokens(t):
    w = t.documents.select("doc_id", tx.tokens("text").alias("w"), tx.words("text").alias("v"))
    return w.select(
        "doc_id", F.size("v").alias("words"), F.size(F.array_distinct("w")).alias("distinct_words"),
        F.md5(F.array_join("w", " ")).alias("digest"),
    )


@query(
    f"""WITH e AS (SELECT unnest(list_distinct({tok('text')})) AS token FROM documents)
    SELECT token, count(*) AS df, round(ln((SELECT count(*) FROM documents) / count(*)::DOUBLE), 6) AS idf FROM e GROUP BY 1"""
)
def token_idf(t):
    return rounded(sj.idf(t.documents.select("doc_id", tx.tokens("text").alias("w")), "w"), "idf")


@query(
    f"""WITH a AS (SELECT unnest(list_distinct({tok('text')})) AS token FROM benchmark),
    rare AS (SELECT token FROM a GROUP BY 1 HAVING count(*) = 1),
    d AS (SELECT doc_id, unnest({tok('text')}) AS token FROM documents)
    SELECT DISTINCT doc_id AS id FROM d JOIN rare USING (token)"""
)
def posting_union(t):
    asked = sj.document_frequency(t.benchmark.select(tx.tokens("text").alias("w")), "w").where("df = 1")
    return sj.posting_union(sj.postings(t.documents.select("doc_id", tx.tokens("text").alias("w")), "doc_id", "w"), asked)


# -- similarity joins -------------------------------------------------------


@query(
    f"""WITH r AS ({sets_sql('benchmark', 'item_id', 'text')}), s AS ({sets_sql('documents', 'doc_id', 'text')}),
    a AS (SELECT rep, copies, len(l) AS n, unnest(l) AS token FROM r), b AS (SELECT rep, copies, len(l) AS n, unnest(l) AS token FROM s),
    j AS (SELECT a.rep AS rep1, b.rep AS rep2, any_value(a.copies) AS copies1, any_value(b.copies) AS copies2,
      count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM a JOIN b USING (token) GROUP BY 1, 2)
    SELECT rep1, rep2, copies1, copies2, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.15"""
)
def simjoin_rs(t):
    left = sj.token_list(t.benchmark, ["text"], "item_id")
    right = sj.token_list(t.documents, ["text"], "doc_id")
    return rounded(sj.similar_sets_between(left, right, "item_id", "tokens", "doc_id", "tokens", 0.15), "jaccard")


def doc_tokens(t):
    return sj.token_list(t.documents, ["text"], "doc_id")


@query(
    f"""WITH s AS ({sets_sql('documents', 'doc_id', 'text')}), e AS (SELECT rep, copies, len(l) AS n, unnest(l) AS token FROM s),
    j AS (SELECT a.rep AS rep1, b.rep AS rep2, any_value(a.copies) AS copies1, any_value(b.copies) AS copies2,
      count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
      FROM e a JOIN e b ON a.token = b.token AND (a.rep < b.rep OR (a.rep = b.rep AND a.copies > 1)) GROUP BY 1, 2)
    SELECT rep1, rep2, copies1, copies2, round(jaccard, 6) AS jaccard FROM j WHERE jaccard >= 0.5"""
)
def simjoin_self_set(t):
    return rounded(sj.similar_sets(doc_tokens(t), "doc_id", "tokens", 0.5), "jaccard")


LISTS = f"""SELECT list_sort({tok('text')}) AS l, min(doc_id) AS rep, count(*) AS copies FROM documents GROUP BY 1 HAVING len(l) > 0"""


@query(
    f"""WITH s AS ({LISTS}), e AS (SELECT rep, copies, len(l) AS n, unnest(list_distinct(l)) AS token FROM s),
    j AS (SELECT a.rep AS rep1, b.rep AS rep2, any_value(a.copies) AS copies1, any_value(b.copies) AS copies2,
      count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
      FROM e a JOIN e b ON a.token = b.token AND (a.rep < b.rep OR (a.rep = b.rep AND a.copies > 1)) GROUP BY 1, 2)
    SELECT rep1, rep2, copies1, copies2, round(jaccard, 6) AS jaccard FROM j WHERE jaccard + 1e-6 >= 0.4"""
)
def simjoin_self_list(t):
    return rounded(sj.similar_sets(doc_tokens(t), "doc_id", "tokens", 0.4, "list"), "jaccard")


@query(
    f"""WITH s AS ({LISTS}), k AS (SELECT rep, copies, unnest(l) AS token FROM s),
    e AS (SELECT rep, copies, token, count(*) AS times FROM k GROUP BY ALL),
    i AS (SELECT token, ln((SELECT count(*) FROM documents) / sum(copies)::DOUBLE) AS w FROM e GROUP BY 1),
    x AS (SELECT e.*, w, sum(times * w) OVER (PARTITION BY rep) AS total FROM e JOIN i USING (token)),
    j AS (SELECT a.rep AS rep1, b.rep AS rep2, any_value(a.copies) AS copies1, any_value(b.copies) AS copies2,
      sum(a.w) / (any_value(a.total) + any_value(b.total) - sum(a.w)) AS jaccard
      FROM x a JOIN x b ON a.token = b.token AND (a.rep < b.rep OR (a.rep = b.rep AND a.copies > 1)) GROUP BY 1, 2)
    SELECT rep1, rep2, copies1, copies2, round(jaccard, 6) AS jaccard FROM j WHERE jaccard + 1e-6 >= 0.3"""
)
def simjoin_self_idf(t):
    return rounded(sj.similar_sets(doc_tokens(t), "doc_id", "tokens", 0.3, "weighted"), "jaccard")


def promo_sides(t):
    named = t.part.select("p_partkey", "p_type", tx.tokens("p_name").alias("w"))
    return named.where("p_type = 'PROMO'"), named.where("p_type <> 'PROMO'")


CANDIDATES = f"""r AS ({sets_sql("part WHERE p_type = 'PROMO'", 'p_partkey', 'p_name')}),
  s AS ({sets_sql("part WHERE p_type <> 'PROMO'", 'p_partkey', 'p_name')}),
  a AS (SELECT rep, copies, unnest(l) AS token FROM r), b AS (SELECT rep, copies, unnest(l) AS token FROM s),
  c AS (SELECT DISTINCT a.rep AS rep1, b.rep AS rep2, a.copies AS copies1, b.copies AS copies2 FROM a JOIN b USING (token))"""


@query(f"WITH {CANDIDATES} SELECT * FROM c")
def token_candidates(t):
    one, two = promo_sides(t)
    return sj.candidate_sets(one, two, "p_partkey", "w", "p_partkey", "w")


def grams(c, q=3):
    pad = f"repeat('^', {q - 1}) || {c} || repeat('$', {q - 1})"
    return f"list_transform(range(1, length({c}) + {q}), lambda i: substr({pad}, i, {q}))"


def list_jaccard(a, b):
    i = f"len(list_intersect(list_distinct({a}), list_distinct({b})))"
    return f"coalesce({i}::DOUBLE / nullif(len({a}) + len({b}) - {i}, 0), 0)"


@query(
    f"""WITH {CANDIDATES}, n AS (SELECT c.*, x.p_name AS a, y.p_name AS b, {grams('x.p_name')} AS ga, {grams('y.p_name')} AS gb,
      {tok('x.p_name')} AS wa, {tok('y.p_name')} AS wb FROM c JOIN part x ON x.p_partkey = rep1 JOIN part y ON y.p_partkey = rep2)
    SELECT rep1, rep2, round(1 - levenshtein(a, b)::DOUBLE / greatest(length(a), length(b)), 6) AS edit,
    round({list_jaccard('wa', 'wb')}, 6) AS words, round({list_jaccard('ga', 'gb')}, 6) AS grams FROM n"""
)
def name_similarity(t):
    one, two = promo_sides(t)
    c = sj.candidate_sets(one, two, "p_partkey", "w", "p_partkey", "w")
    side = lambda n: t.part.select(F.col("p_partkey").alias(f"rep{n}"), F.col("p_name").alias(f"n{n}"))
    named = c.join(side(1), "rep1").join(side(2), "rep2")
    return named.select(
        "rep1",
        "rep2",
        r(tx.edit_similarity("n1", "n2")).alias("edit"),
        r(tx.word_jaccard("n1", "n2")).alias("words"),
        r(tx.qgram_jaccard("n1", "n2", 3)).alias("grams"),
    )


# -- pages ------------------------------------------------------------------


def inner(c):
    c = rf"regexp_replace(regexp_replace({c}, '(?s)<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g')"
    for entity, char in [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")]:
        c = f"replace({c}, '{entity}', '{char}')"
    return c


def first_tag(c, tag):
    return rf"regexp_extract_all({c}, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}\s*>', 1)[1]"


PAGE = f"""SELECT page_id, url, {inner(first_tag('html', 'title'))} AS title, {inner(first_tag('html', 'h1'))} AS h1,
  regexp_extract(html, 'lang="(\\w+)"', 1) AS lang FROM pages"""


def page_table(t):
    return t.pages.select(
        "page_id", "url", pg.first_element("html", "title").alias("title"), pg.first_element("html", "h1").alias("h1"),
        F.regexp_extract("html", r'lang="(\w+)"', 1).alias("lang"),
    )


@query(PAGE)
def page_headings(t):
    return page_table(t)


LINKS = r"""WITH a AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a\s*>')) AS a,
    generate_subscripts(regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a\s*>'), 1) - 1 AS link_no FROM pages)
  SELECT page_id, link_no, regexp_extract(a, '(?i)\shref\s*=\s*"([^"]*)"', 1) AS href, """ + inner("a") + r""" AS text
  FROM a WHERE regexp_matches(regexp_extract(a, '(?is)^<a\s[^>]*>'), '(?i)\shref\s*=\s*"')
  AND regexp_extract(regexp_extract(a, '(?is)^<a\s[^>]*>'), '(?i)\sclass\s*=\s*"([^"]*)"', 1) = ''"""


@query(LINKS)
def page_links(t):
    return pg.links(t.pages, ["page_id"])


@query(
    f"""WITH l AS ({LINKS}),
    k AS (SELECT page_id, arg_max(href, link_no) FILTER (upper(trim(text)) = 'THE') AS profile,
      arg_max(href, link_no) FILTER (upper(trim(text)) = 'DE') AS homepage FROM l GROUP BY 1),
    h AS (SELECT page_id, string_split(replace({inner(first_tag('html', 'h1'))}, chr(10), ','), ',') AS p,
      {inner(first_tag('html', 'p'))} AS a FROM pages)
    SELECT page_id, 1 AS section_no, replace(lower(p[1]), 'ß', 'ss') AS name,
    replace(lower(trim(p[2])), 'ß', 'ss') AS rank, replace(lower(replace(trim(a), ';', ',')), 'ß', 'ss') AS areas,
    'https://www.example.org' || profile AS profile, homepage FROM h LEFT JOIN k USING (page_id)"""
)
def page_records(t):
    parts = pg.sections(t.pages, r"<body>")
    rec = pg.page_records(
        parts, "https://www.example.org", heading="h1", profile_label="THE", home_label="DE"
    )
    # title case of the sharp s differs between engines; compare lower case
    folded = lambda c: F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))
    return rec.withColumns({c: folded(c) for c in ("name", "rank", "areas")})


@query(
    r"""WITH b AS (SELECT page_id, string_split(html, '<article>')[2] AS part FROM pages),
    p AS (SELECT page_id, unnest(string_split(replace(lower("""
    + inner(first_tag("part", "p"))
    + r"""), '.', ''), chr(10))) AS line FROM b),
    y AS (SELECT page_id, try_cast(nullif(regexp_extract(trim(string_split(line, ',')[-1]), '(\d{4})$', 1), '') AS INTEGER) AS year FROM p)
    SELECT pages.page_id, min(year) AS year FROM pages LEFT JOIN y USING (page_id) GROUP BY 1"""
)
def page_min_year(t):
    parts = pg.sections(t.pages, "<article>")
    years = parts.groupBy("page_id").agg(F.min(pg.year_of_section("section")).alias("year"))
    return t.pages.select("page_id").join(years, "page_id", "left")


@query(
    r"""SELECT page_id, 1 AS section_no, length(string_split(string_split(html, '<div class="ad">')[2], '</div>')[1])
    + length('<div class="ad">') AS n FROM pages WHERE contains(html, '<div class="ad">')"""
)
def nested_sections(t):
    return pg.nested_sections(t.pages, "div", "ad").select("page_id", "section_no", F.length("section").alias("n"))


# -- record pairs -----------------------------------------------------------


def page_pairs(t):
    pages = cut(page_table(t))  # read three times and more
    listed = pages.select("page_id", tx.words(tx.joined_text("title", "url")).alias("tokens"))
    sets = sj.similar_sets(listed, "page_id", "tokens", 0.4, "list").where("rep1 <> rep2")
    return pages, sets.select(F.col("rep2").alias("id1"), F.col("rep1").alias("id2"), "jaccard")


def record_pairs(pages, pairs):
    ready = cut(en.cleaned(pages, ["title", "url", "h1", "lang"], ["title", "url"]))
    return en.record_pairs(pairs, ready, "page_id", ["title", "url", "h1", "lang", "title_words", "url_words"])


# DuckDB's levenshtein counts bytes, so accents are folded on both sides.
ACCENTED, PLAIN = "éèêëàâäáîïíôöóùûüúçñß", "eeeeaaaaiiiooouuuucnb"


def clean(c):
    return f"trim(regexp_replace(translate(lower({c}), '{ACCENTED}', '{PLAIN}'), '[^\\pL\\pN_]+', ' ', 'g'))"


PAGE_PAIRS = f"""p AS ({PAGE}), w AS (SELECT page_id, {tok("title || ' ' || url")} AS l FROM p),
  s AS (SELECT list_sort(l) AS l, min(page_id) AS rep FROM w GROUP BY 1 HAVING len(l) > 0),
  e AS (SELECT rep, len(l) AS n, unnest(list_distinct(l)) AS token FROM s),
  j AS (SELECT a.rep AS id1, b.rep AS id2, count(*)::DOUBLE / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard
    FROM e a JOIN e b ON a.token = b.token AND a.rep > b.rep GROUP BY 1, 2 HAVING jaccard + 1e-6 >= 0.4)"""


@query(
    f"""WITH {PAGE_PAIRS}, c AS (SELECT page_id, {clean('title')} AS t, {clean('url')} AS u, {clean('h1')} AS h, {clean('lang')} AS g FROM p),
    b AS (SELECT id1, id2, jaccard, x.t AS t1, y.t AS t2, x.u AS u1, y.u AS u2, x.h AS h1, y.h AS h2, x.g AS g1, y.g AS g2
      FROM j JOIN c x ON x.page_id = id1 JOIN c y ON y.page_id = id2)
    SELECT id1, id2, round(jaccard, 6) AS jaccard,
    round(1 - levenshtein(t1, t2)::DOUBLE / greatest(length(t1), length(t2)), 6) AS f1,
    round({list_jaccard(tok('t1'), tok('t2'))}, 6) AS f2,
    round(1 - levenshtein(u1, u2)::DOUBLE / greatest(length(u1), length(u2)), 6) AS f3,
    round({list_jaccard(tok('u1'), tok('u2'))}, 6) AS f4,
    round(1 - levenshtein(h1, h2)::DOUBLE / greatest(length(h1), length(h2)), 6) AS f5,
    round(1 - levenshtein(g1, g2)::DOUBLE / greatest(length(g1), length(g2)), 6) AS f6 FROM b"""
)
def pair_features(t):
    pages, pairs = page_pairs(t)
    pages = pages.withColumns({c: F.translate(F.lower(c), ACCENTED, PLAIN) for c in ("title", "url", "h1", "lang")})
    both = record_pairs(pages, pairs)
    f = en.pair_features(both, "title", "url", "h1", "lang", clean=True)
    return rounded(f.select("id1", "id2", "jaccard", *en.FEATURES), "jaccard", *en.FEATURES)


def title_truth(pages):
    """Each page with the first page of its title: a star, not all pairs."""
    first = pages.groupBy("title").agg(F.min("page_id").alias("id2"))
    return pages.join(first, "title").where("page_id <> id2").select("id2", F.col("page_id").alias("id1"))


TRUTH = "g AS (SELECT x.page_id AS id1, m AS id2 FROM p x JOIN (SELECT title, min(page_id) AS m FROM p GROUP BY 1) USING (title) WHERE page_id <> m)"


@query(
    f"""WITH {PAGE_PAIRS}, {TRUTH}, n AS (SELECT (SELECT count(*) FROM j) AS found, (SELECT count(*) FROM g) AS "true",
      (SELECT count(*) FROM j JOIN g ON least(j.id1, j.id2) = least(g.id1, g.id2) AND greatest(j.id1, j.id2) = greatest(g.id1, g.id2)) AS "right")
    SELECT found, "right", "true", round("right" / found::DOUBLE, 6) AS precision, round("right" / "true"::DOUBLE, 6) AS recall,
    round(2.0 * "right" / (found + "true"), 6) AS fscore FROM n"""
)
def pair_quality(t):
    pages, pairs = page_pairs(t)
    return rounded(en.pair_quality(pairs, title_truth(pages)), "precision", "recall", "fscore")


@query(
    f"""WITH {PAGE_PAIRS}, {TRUTH} SELECT id1, id2, round(jaccard, 6) AS jaccard FROM j ANTI JOIN g USING (id1, id2)"""
)
def unlabelled_pairs(t):
    pages, pairs = page_pairs(t)
    return rounded(en.without(pairs, en.in_truth(pairs, title_truth(pages))), "jaccard").select("id1", "id2", "jaccard")


@query()
def active_learning(t):
    pages, pairs = page_pairs(t)
    both = record_pairs(pages, pairs)
    f = en.pair_features(both, "title", "url", "h1", "lang", clean=True).select("id1", "id2", "jaccard", *en.FEATURES)
    scored, _ = en.active_learning(f, title_truth(pages))
    return scored
