"""DuckDB SQL that gives the same rows as the queries, written against the same tables."""

from __future__ import annotations

from newslake.functions.html import BOILERPLATE_TAGS, ENTITIES, MARKDOWN_LADDER
from newslake.functions.tags import TAG_KEYWORDS
from newslake.sources.catalogue import FEEDS, GITHUB_REPOS, TOPICS
from newslake.workload.views import PROSE_KEYWORDS


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WHITE = "' '||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"


def strip(e: str) -> str:
    return f"trim({e}, {WHITE})"


def stamp(e: str) -> str:
    return f"strftime({e}, '%Y-%m-%d %H:%M:%S')"


def replace_all(e: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({e}, {text(pattern)}, {text(replacement.replace('$', chr(92)))}, 'g')"


def cut_pairs(e: str) -> str:
    e = replace_all(e, r"(?s)<!--.*?-->", "")
    first = ("script", "style", "noscript")
    for tag in (*first, *(t for t in BOILERPLATE_TAGS if t not in first)):
        e = replace_all(e, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}\s*>", "")
    return e


def decoded(e: str) -> str:
    """References decoded; the old names also count without their semicolon."""
    for name, char in ENTITIES.items():
        e = f"regexp_replace({e}, {text(name if name == '&apos;' else name + '?')}, {text(char)}, 'g')"
    return e


def markdown(e: str) -> str:
    mark, back = text(r"([*_])"), text("\\\\\\1")
    e = (
        f"array_to_string(list_transform(string_split({cut_pairs(e)}, '<'), lambda s, i: CASE WHEN i = 1 THEN "
        f"regexp_replace(s, {mark}, {back}, 'g') ELSE regexp_extract(s, '^[^>]*>') || "
        f"regexp_replace(substr(s, length(regexp_extract(s, '^[^>]*>')) + 1), {mark}, {back}, 'g') END), '<')"
    )
    e = replace_all(e, r"(?is)<!doctype[^>]*>", "")
    for pattern, replacement in MARKDOWN_LADDER:
        e = replace_all(e, pattern, replacement)
    return strip(replace_all(decoded(e), r"\n{3,}", "\n\n"))


def tag_list(e: str, keywords: dict[str, list[str]]) -> str:
    """Csv of the tags whose keywords occur in a lower-case text."""
    cases = [
        "CASE WHEN " + " OR ".join(f"contains({e}, {text(w)})" for w in keywords[t]) + f" THEN {text(t)} END"
        for t in sorted(keywords)
    ]
    return f"concat_ws(',', {', '.join(cases)})"


DOCS = """docs AS (
  SELECT doc_id, lang, source, text AS content, substr(text, 1, 40) AS title,
    'https://' || source || '.example.org/' || doc_id AS url,
    md5('https://' || source || '.example.org/' || doc_id) AS article_id,
    TIMESTAMP '2024-01-01' + to_hours(doc_id) AS date,
    CASE doc_id % 3 WHEN 0 THEN 'batch' WHEN 1 THEN 'online' ELSE 'chat' END AS type
  FROM documents)"""

PROSE = tag_list("lower(content || ' ' || title)", PROSE_KEYWORDS)

RAW = DOCS + """, marked AS (
  SELECT *, CASE WHEN doc_id % 4 = 0 THEN '<p>' || content || '</p>' ELSE content END AS body FROM docs),
raw AS (
  SELECT doc_id, source AS topic, doc_id // 400 + 1 AS page, CAST(substr(source, 4) AS INT) AS number, date,
    CASE WHEN doc_id % 13 <> 0 THEN source END AS source_name,
    CASE WHEN doc_id % 19 <> 0 THEN title END AS title,
    coalesce(nullif(CASE WHEN doc_id % 5 = 4 THEN '' WHEN doc_id % 5 <> 0 THEN body END, ''),
             CASE WHEN doc_id % 7 <> 0 THEN body END, '') AS content,
    CASE WHEN doc_id % 17 <> 0 THEN url ELSE '' END AS url,
    CASE WHEN doc_id % 11 = 0 THEN 'yesterday' ELSE strftime(date, '%Y-%m-%dT%H:%M:%SZ') END AS published,
    CASE WHEN doc_id % 11 <> 0 THEN date END AS parsed,
    row_number() OVER (PARTITION BY source, doc_id // 400 ORDER BY doc_id) - 1 AS pos
  FROM marked),
pages_ok AS (
  SELECT topic, page, (any_value(number) + page) % 5 = 0 AS bad, count(*) AS n_articles FROM raw GROUP BY topic, page),
accepted AS (
  SELECT p.* FROM pages_ok p WHERE NOT bad AND NOT EXISTS (
    SELECT 1 FROM pages_ok b WHERE b.topic = p.topic AND b.bad AND b.page <= p.page))"""

TOP = RAW + """, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY parsed DESC, md5(url)) AS topic_rank FROM raw
  WHERE number % 5 <> 4 AND CAST(parsed AS DATE) >= CAST((SELECT max(date) FROM docs) - INTERVAL 7 DAY AS DATE)),
top AS (SELECT * FROM ranked WHERE topic_rank <= 5)"""

GITHUB = """github AS (
  SELECT doc_id, min(doc_id) OVER w AS seq, 0 AS kind,
    'https://api.github.com/repos/' || source || '/' || lang || '/releases?page=' || doc_id // 100 AS endpoint,
    row_number() OVER (PARTITION BY source, lang, doc_id // 100 ORDER BY doc_id) - 1 AS pos,
    doc_id % 9 = 0 AS draft,
    """ + strip("""source || '/' || lang || ' ' || coalesce(
      CASE WHEN doc_id % 4 NOT IN (0, 1) THEN title END,
      CASE WHEN doc_id % 8 <> 0 THEN 'v' || doc_id END, 'release')""") + """ AS title,
    CASE WHEN doc_id % 10 <> 0 THEN url END AS html_url,
    CASE WHEN doc_id % 7 <> 0 THEN content ELSE '' END AS content,
    CASE WHEN doc_id % 6 <> 0 THEN date ELSE date + INTERVAL 1 DAY END AS date
  FROM docs WINDOW w AS (PARTITION BY source, lang, doc_id // 100))"""

FEED_HTML = "CASE WHEN doc_id % 3 = 0 THEN '<h2>' || lang || '</h2><p>' || content || '</p>' ELSE content END"
FEED = f"""feed AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY source, doc_id // 100) AS seq, 1 AS kind,
    'https://www.' || source || '.example.org/feed/' || doc_id // 100 AS endpoint,
    row_number() OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id) - 1 AS pos,
    {strip('title')} AS title, url, {markdown(FEED_HTML)} AS content, source || '.example.org' AS source, date
  FROM docs)"""

H1 = text(r"(?is)<h1(?:\s[^>]*)?>(.*?)</h1\s*>")
HOST = r"regexp_replace(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1), '^www\.', '')"
PAGES = f"""page_rows AS (
  SELECT page_id, url, {strip(decoded(replace_all(f"regexp_extract(html, {H1}, 1)", r"\s*<[^>]*>\s*", "")))} AS title,
    {markdown('html')} AS content, {HOST} AS source FROM pages)"""

DENSE = """vectors AS (
  SELECT vec_id, 'q' || vec_id AS question_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
chunks AS (
  SELECT d.*, v, 'a' || doc_id // 4 AS art, CAST(doc_id % 4 AS INT) AS idx, 'a' || doc_id // 4 || '-' || doc_id % 4 AS chunk_id
  FROM docs d JOIN vectors ON vec_id = doc_id)"""


def nearest(k: int, where: str = "TRUE", name: str = "hits", questions: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT * FROM (
    SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank, chunk_id, distance
    FROM (SELECT q.question_id, c.chunk_id, round(1 - list_cosine_similarity(q.v, c.v), 6) + 0.0 AS distance
          FROM vectors q, chunks c WHERE {where} AND {questions}))
  WHERE rank <= {k})"""


WANTED = """wanted AS (
  SELECT question_id, art, j, min(rank * 2 + side) AS pos FROM (
    SELECT question_id, rank, regexp_extract(chunk_id, '^(.*)-([0-9]+)$', 1) AS art,
      CAST(regexp_extract(chunk_id, '^(.*)-([0-9]+)$', 2) AS INT) + 2 * side - 1 AS j, side
    FROM hits, (SELECT unnest([0, 1]) AS side) WHERE rank <= 3)
  WHERE j >= 0 GROUP BY question_id, art, j),
neighbours AS (
  SELECT question_id, pos, art || '-' || j AS chunk_id, art AS article_id, j AS chunk_index FROM wanted w
  WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.question_id = w.question_id AND h.chunk_id = w.art || '-' || w.j))"""

ISO = "strftime(date, '%Y-%m-%dT%H:%M:%S+00:00')"

ITEMS = DOCS + f""", items AS (
  SELECT source || ':' || doc_id // 60 AS question_id,
    CAST(CASE type WHEN 'chat' THEN 0 WHEN 'batch' THEN 1 ELSE 2 END AS INT) AS group_no, CAST(doc_id % 60 AS INT) AS pos,
    CASE WHEN doc_id % 19 <> 0 THEN title END AS title, CASE WHEN doc_id % 13 <> 0 THEN source END AS source,
    {ISO} AS date, content, url, {PROSE} AS tags FROM docs)"""

CARDS = """cards AS (
  SELECT question_id, group_no, pos, coalesce(title, 'Sans titre') AS title,
    coalesce(source, CASE WHEN group_no <= 1 THEN 'interne' ELSE 'newsapi' END) AS source,
    date, substr(content, 1, 280) AS snippet, url, tags FROM items)"""

TRENDS = """tag_counts AS (
  SELECT question_id, tag, count(*) AS n FROM (SELECT question_id, unnest(string_split(tags, ',')) AS tag FROM cards)
  WHERE tag <> '' GROUP BY question_id, tag),
trends AS (SELECT question_id, string_agg(tag, ',' ORDER BY tag) AS trending FROM tag_counts WHERE n >= 3 GROUP BY question_id)"""

CONTEXTS = """lines AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, group_no <= 1 ORDER BY group_no, pos) AS i FROM items),
contexts AS (
  SELECT question_id, concat_ws(chr(10) || chr(10),
    CASE WHEN bool_or(group_no <= 1) THEN '## Index interne' END,
    string_agg('[' || i || '] ' || coalesce(title, '') || ' — ' || coalesce(source, '') || ' (' || date || ')' || chr(10)
      || substr(content, 1, 600), chr(10) || chr(10) ORDER BY i) FILTER (WHERE group_no <= 1),
    CASE WHEN bool_or(group_no > 1) THEN '## Actualité fraîche' END,
    string_agg('[F' || i || '] ' || coalesce(title, '') || ' — ' || coalesce(source, '') || ' (' || date || ')' || chr(10)
      || substr(content, 1, 600) || chr(10) || url, chr(10) || chr(10) ORDER BY i) FILTER (WHERE group_no > 1)) AS context
  FROM lines GROUP BY question_id)"""

EMPTY = ("Aucun article ne couvre encore ce sujet dans l'index ou dans l'actualité collectée. "
         "Lance une ingestion pour alimenter la veille.")
STATUS = "CASE WHEN n = 0 THEN 'empty' WHEN NOT llm THEN 'degraded' ELSE 'ok' END"
ANSWER = f"""CASE WHEN n = 0 THEN {text(EMPTY)}
    WHEN NOT llm THEN n || ' article(s) trouvé(s) pour : ' || question || '. LLM non configuré — voici les sources brutes.'
    WHEN reply IS NULL THEN 'Synthèse indisponible (erreur LLM). ' || n || ' article(s) référencé(s).' ELSE reply END"""

STORIES = """listed AS (
  SELECT *, CAST(ts AS DATE) AS day, date_trunc('second', ts) AS second,
    row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY event_id DESC) AS feed_rank FROM events),
stories AS (
  SELECT day, feed_rank, 'hn-' || event_id AS article_id, event_type AS title, 'HackerNews' AS source, second AS date,
    event_type || ' (Score: ' || CAST(floor(value) AS INT) || ' points, '
      || CASE WHEN event_id % 4 <> 0 THEN event_id % 50 ELSE 0 END || ' comments)' AS content,
    'https://hn.example.org/' || event_id AS url,
    CASE WHEN event_id % 5 <> 0 THEN 'u' || user_id ELSE 'anonymous' END AS author, 'online' AS type
  FROM listed WHERE feed_rank <= 30 AND event_type <> 'error' AND event_id % 10 <> 0
    AND second >= CAST(day AS TIMESTAMP) + INTERVAL 1 HOUR)"""

GATE = DOCS + """, raw AS (
  SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN '' WHEN doc_id % 23 <> 0 THEN url END AS url,
    CASE WHEN doc_id % 10 <> 0 THEN content END AS content, CASE WHEN doc_id % 19 <> 0 THEN title END AS title,
    source, CASE WHEN doc_id % 29 <> 0 THEN date END AS date FROM docs),
judged AS (
  SELECT *, CASE WHEN coalesce(url, '') = '' THEN 'no_url' WHEN coalesce(content, '') = '' THEN 'no_content'
    WHEN title IS NULL THEN 'no_title' WHEN date IS NULL THEN 'bad_date' END AS reason FROM raw)"""


def walk(rows: str, scope: str = "") -> str:
    """The sequential scan itself, as a recursion over ``rows(n, url, k)`` (per ``scope`` if given)."""
    by = f"{scope}, " if scope else ""
    same = f"o.{scope} = w.{scope} AND " if scope else ""
    start = f"SELECT DISTINCT {scope}, CAST(0 AS BIGINT), FALSE, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM {rows}" \
        if scope else "SELECT CAST(0 AS BIGINT), FALSE, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[])"
    return f"""walk({by}n, keep, urls, keys) AS (
  {start}
  UNION ALL
  SELECT {'o.' + by if scope else ''}o.n, NOT (list_contains(w.urls, o.url) OR list_contains(w.keys, o.k)),
    CASE WHEN list_contains(w.urls, o.url) OR list_contains(w.keys, o.k) THEN w.urls ELSE list_append(w.urls, o.url) END,
    CASE WHEN list_contains(w.urls, o.url) OR list_contains(w.keys, o.k) THEN w.keys ELSE list_append(w.keys, o.k) END
  FROM walk w JOIN {rows} o ON {same}o.n = w.n + 1)"""


TERMS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
DIM = "CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % 384"


def counts(name: str, table: str, key: str, column: str) -> str:
    return f"""{name} AS (
  SELECT {key}, CAST({DIM} AS INT) AS dim, count(*) AS tf
  FROM (SELECT {key}, unnest({TERMS.format(column)}) AS t FROM {table}) GROUP BY ALL)"""


def idf(tf: str, table: str, key: str) -> str:
    return f"""idf AS (
  SELECT d.dim, ln((1 + (SELECT count(*) FROM {table})) / (1.0 + count(DISTINCT {key}))) + 1 AS idf
  FROM (SELECT CAST(unnest(range(384)) AS INT) AS dim) d LEFT JOIN {tf} USING (dim) GROUP BY d.dim)"""


def weights(name: str, tf: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, dim, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS weight
  FROM (SELECT {key}, dim, tf * idf AS w FROM {tf} JOIN idf USING (dim)))"""


WINDOWS = """windows AS (
  SELECT doc_id, i AS chunk_index, substr(text, i * 1080 + 1, 1200) AS content, doc_id || '-' || i AS chunk_id
  FROM (SELECT doc_id, text, CAST(unnest(range(CAST(ceil(greatest(length(text) - 1200, 0) / 1080.0) AS BIGINT) + 1)) AS INT) AS i
        FROM documents WHERE length(text) > 0))"""

def recursive_chunks(source: str, key: str) -> str:
    """``pieces(key, chunk_index, content)``: the recursive chunker over ``source(key, body)``.

    ``split`` cuts a piece of 1200 characters or more at the first separator it holds; ``run`` numbers the
    stretches of small pieces between large ones; ``pack`` walks each stretch with a window ``lo .. pos - 1``.
    """
    separators = "[chr(10)||chr(10), chr(10), '. ', '! ', '? ', ' ', '']"
    return f"""texts AS (SELECT {key}, {strip('body')} AS body FROM {source}),
split({key}, path, run, piece, lvl) AS (
  SELECT {key}, CAST([] AS INT[]), CAST([] AS INT[]), body, 1 FROM texts WHERE length(body) > 1200
  UNION ALL
  SELECT {key}, list_append(path, CAST(i AS INT)),
    list_append(path, CAST(len(list_filter(parts[1:i - 1], lambda q: length(q) >= 1200)) AS INT)), parts[i], lvl + 1
  FROM (SELECT {key}, path, parts, lvl, unnest(range(1, len(parts) + 1)) AS i FROM (
    SELECT {key}, path, lvl, list_filter(CASE WHEN sep = '' THEN string_split(piece, '') ELSE
        list_transform(string_split(piece, sep), lambda q, n: CASE WHEN n < len(string_split(piece, sep)) THEN q || sep ELSE q END) END,
        lambda q: q <> '') AS parts
    FROM (SELECT {key}, path, piece, lvl, ({separators})[lvl] AS sep FROM (
      SELECT {key}, path, piece, list_filter(range(lvl, 8), lambda n: contains(piece, ({separators})[n]))[1] AS lvl
      FROM split WHERE length(piece) >= 1200))))),
runs AS (
  SELECT *, row_number() OVER () AS no, list_transform(range(1, len(parts) + 2), lambda n: coalesce(CAST(list_sum(sizes[1:n - 1]) AS BIGINT), 0)) AS ends
  FROM (SELECT {key}, run, min(path) AS place, list(piece ORDER BY path) AS parts, list(length(piece) ORDER BY path) AS sizes
        FROM split WHERE length(piece) < 1200 GROUP BY {key}, run)),
pack(no, pos, lo, chunk) AS (
  SELECT no, CAST(2 AS BIGINT), CAST(1 AS BIGINT), CAST(NULL AS VARCHAR) FROM runs
  UNION ALL
  SELECT no, pos + 1,
    CASE WHEN ends[pos + 1] - ends[lo] > 1200 THEN list_filter(range(lo, pos + 1), lambda n: ends[pos] - ends[n] <= 120
      AND (n = pos OR ends[pos + 1] - ends[n] <= 1200))[1] ELSE lo END,
    CASE WHEN ends[pos + 1] - ends[lo] > 1200 THEN array_to_string(parts[lo:pos - 1], '') END
  FROM pack JOIN runs USING (no) WHERE pos <= len(parts)),
pieces AS (
  SELECT {key}, CAST(row_number() OVER (PARTITION BY {key} ORDER BY place, pos) - 1 AS INT) AS chunk_index, content FROM (
    SELECT {key}, place, pos, {strip('chunk')} AS content FROM pack JOIN runs USING (no) WHERE chunk IS NOT NULL
    UNION ALL SELECT {key}, place, pos + 1, {strip("array_to_string(parts[lo:], '')")} FROM pack JOIN runs USING (no) WHERE pos = len(parts) + 1)
  WHERE content <> ''
  UNION ALL SELECT {key}, 0, body FROM texts WHERE length(body) BETWEEN 1 AND 1200)"""


BROKEN = DOCS + ", " + GITHUB + """, every AS (
  SELECT endpoint AS url, 'github' AS route, min(seq) AS seq FROM github GROUP BY endpoint
  UNION ALL SELECT 'https://www.' || source || '.example.org/feed/' || doc_id // 100, 'feed', min(doc_id) FROM docs
    GROUP BY source, doc_id // 100
  UNION ALL SELECT url, CASE WHEN ltrim(lower(substr(html, 1, 200))) LIKE '<?xml%' OR contains(lower(substr(html, 1, 200)), '<rss')
    OR contains(lower(substr(html, 1, 200)), '<feed') THEN 'feed' ELSE 'html' END, page_id FROM pages)"""

# Every user turn with the index as it was: chunks of documents, and of the turns that were answered before.
LOOP = f"""turns AS (
  SELECT u.conv_id || ':' || u.turn AS question_id, u.text AS question, u.conv_id, u.turn,
    TIMESTAMP '2024-02-01' + to_hours(u.conv_id) + to_minutes(u.turn) AS asked_at,
    CASE WHEN u.conv_id % 3 <> 0 THEN ['src' || u.conv_id % 20, 'src' || u.turn % 20] ELSE [] END AS topics,
    CAST(DATE '2024-01-01' + CAST(u.conv_id % 30 AS INT) AS DATE) AS day, TRUE AS llm,
    CASE WHEN (a.conv_id + a.turn) % 3 = 0 THEN a.text WHEN (a.conv_id + a.turn) % 7 = 0 THEN CAST(json_array(a.text) AS VARCHAR)
      ELSE {strip('a.text')} END AS reply
  FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'),
held AS (
  SELECT article_id AS art, title, source, url, date, content, type, CAST(NULL AS TIMESTAMP) AS stored_at FROM docs
  UNION ALL SELECT md5(question || question_id), 'Q: ' || substr(question, 1, 100), 'ChatHistory', '', asked_at + INTERVAL 1 MINUTE,
    'Q: ' || question || chr(10) || 'A: ' || substr(reply, 1, 500), 'chat', asked_at + INTERVAL 1 MINUTE
  FROM turns WHERE reply IS NOT NULL),
source AS (SELECT art, content AS body FROM held),
{recursive_chunks('source', 'art')},
chunks AS (SELECT p.art || '-' || p.chunk_index AS chunk_id, p.art, p.content, h.* EXCLUDE (art, content), {tag_list("lower(h.content || ' ' || h.title)", PROSE_KEYWORDS)} AS tags
  FROM pieces p JOIN held h USING (art)),
doc_chunks AS (SELECT chunk_id, content FROM chunks WHERE stored_at IS NULL),
{counts('dtf', 'doc_chunks', 'chunk_id', 'content')}, {idf('dtf', 'doc_chunks', 'chunk_id')},
{counts('ctf', 'chunks', 'chunk_id', 'content')}, {weights('cw', 'ctf', 'chunk_id')},
cws AS MATERIALIZED (SELECT cw.*, stored_at FROM cw JOIN chunks USING (chunk_id)),
expanded AS (SELECT question_id, asked_at, question || CASE WHEN len(topics) > 0 THEN ' | ' || array_to_string(topics, ', ') ELSE '' END AS text FROM turns),
{counts('etf', 'expanded', 'question_id', 'text')}, {weights('ew', 'etf', 'question_id')},
{counts('qtf', 'turns', 'question_id', 'question')}, {weights('qw', 'qtf', 'question_id')},
found AS (
  SELECT question_id, chunk_id, round(1 - sum(ew.weight * cws.weight), 6) + 0.0 AS distance
  FROM ew JOIN turns USING (question_id) JOIN cws USING (dim) WHERE stored_at IS NULL OR stored_at < asked_at GROUP BY ALL),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM found) WHERE rank <= 8),
recalled AS (
  SELECT question_id, chunk_id, round(1 - sum(qw.weight * cws.weight), 6) + 0.0 AS distance
  FROM qw JOIN turns USING (question_id) JOIN cws USING (dim) WHERE stored_at < asked_at GROUP BY ALL),
past AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM recalled) WHERE rank <= 2)"""

ORACLES = {
    "newsapi_normalize": f"""WITH {RAW} SELECT topic, CAST(page AS INT) AS page, CAST(pos AS INT) AS pos, md5(url) AS article_id,
  title, 'NewsAPI' AS source, published AS date, content, url, CAST(NULL AS VARCHAR) AS author
  FROM raw JOIN accepted USING (topic, page) WHERE content <> ''""",
    "newsapi_first_pages": f"""WITH {RAW} SELECT topic, CAST(page AS INT) AS page, CAST(pos AS INT) AS pos, md5(url) AS article_id,
  title, 'NewsAPI' AS source, published AS date, content, url, CAST(NULL AS VARCHAR) AS author
  FROM raw JOIN accepted USING (topic, page) WHERE content <> '' AND page <= 2""",
    "accept_page_prefix": f"WITH {RAW} SELECT topic, CAST(page AS INT) AS page, CAST(n_articles AS INT) AS n_articles FROM accepted",
    "newsapi_format": f"""WITH {RAW} SELECT md5(url) AS article_id, coalesce(title, '') AS title,
  coalesce(source_name, 'NewsAPI') AS source, {stamp('parsed')} AS date, content, url
  FROM raw JOIN pages_ok USING (topic, page) WHERE NOT bad""",
    "fresh_top_per_topic": f"WITH {TOP} SELECT topic, CAST(topic_rank AS INT) AS topic_rank, url, published AS publishedAt FROM top",
    "fresh_normalize": f"""WITH {RAW}, filled AS (
  SELECT *, coalesce(title, '') AS t, coalesce(source_name, 'NewsAPI') AS s FROM raw WHERE url <> '' AND content <> ''),
firsts AS (SELECT * FROM filled QUALIFY row_number() OVER (PARTITION BY s, t ORDER BY doc_id) = 1)
SELECT md5(url) AS article_id, t AS title, s AS source, {stamp('parsed')} AS date,
  CASE WHEN contains(content, '<') THEN {markdown('content')} ELSE content END AS content, url, topic AS tags, 'online' AS type
FROM firsts""",
    "github_releases": f"""WITH {DOCS}, {GITHUB} SELECT endpoint, CAST(pos AS INT) AS pos, title,
  coalesce(html_url, endpoint) AS url, content, 'GitHub' AS source, {stamp('date')} AS date FROM github WHERE NOT draft""",
    "feed_items": f"""WITH {DOCS}, {FEED} SELECT endpoint, CAST(pos AS INT) AS pos, title, url, content, source, {stamp('date')} AS date FROM feed""",
    "page_articles": f"WITH {PAGES} SELECT url, title, content, source FROM page_rows",
    "route_payloads": f"WITH {BROKEN} SELECT url, route FROM every",
    "rejects": f"""WITH {BROKEN} SELECT url, route, CASE WHEN seq % 5 = 2 THEN 'failed' WHEN route = 'github' THEN 'bad_json' ELSE 'bad_xml' END AS reason
  FROM every WHERE seq % 5 = 2 OR (seq % 5 = 1 AND route IN ('github', 'feed'))""",
    "hn_stories": f"""WITH {STORIES} SELECT CAST(day AS VARCHAR) AS snapshot, CAST(feed_rank AS INT) AS feed_rank, article_id, title, source,
  {stamp('date')} AS date, content, url, author, type FROM stories""",
    "source_catalogue": "SELECT unnest([" + ", ".join(
        text(u) for u in [*FEEDS, *(f"https://api.github.com/repos/{r}/releases" for r in GITHUB_REPOS)]
    ) + "]) AS url UNION ALL SELECT DISTINCT 'https://api.github.com/repos/' || source || '/' || lang || '/releases' FROM documents",
    "ingest_gate": f"""WITH {GATE} SELECT doc_id, md5(url) AS article_id, title, source, {stamp('date')} AS date, content, url, 'batch' AS type
  FROM judged WHERE reason IS NULL""",
    "gate_rejects": f"WITH {GATE} SELECT doc_id, reason FROM judged WHERE reason IS NOT NULL",
    "article_ids": "SELECT page_id, md5(url) AS article_id FROM pages",
    "default_fields": """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'NewsAPI' END AS name FROM documents""",
    "strip_boilerplate": f"SELECT page_id, {cut_pairs('html')} AS html FROM pages",
    # Elements are matched by counting the tags of their own name; no list of the library is used here.
    "strip_marked": r"""WITH parts AS (
  SELECT page_id, html,
    '<div class="big cookie-banner">Accept <div>our <div id="x' || page_id || '">many</div></div> cookies<br></div>' AS banner,
    '<section data-n=''1'' id=''top-advert-' || page_id || '''><h2>Buy</h2><section><p>now</p><img src="a.png"></section></section>' AS promo,
    '<nav><ul><li>a</li></ul><nav class="sub">b<aside>c</aside></nav>d</nav>' AS menu,
    '<div class="Cookies are fine"><section>kept</section></div>' AS kept FROM pages),
landed AS (
  SELECT page_id, regexp_replace(regexp_replace(replace(html, '<article>', CASE page_id % 3 WHEN 0 THEN banner || kept WHEN 1 THEN promo || menu
    ELSE '<div>' || menu || banner || '</div>' || kept || promo END || '<article>'), '<!--.*?-->', '', 'gs'), '<script>.*?</script>', '', 'gs') AS html
  FROM parts),
pieces AS (SELECT page_id, unnest(string_split(html, '<')) AS piece, generate_subscripts(string_split(html, '<'), 1) AS i FROM landed),
named AS (
  SELECT *, lower(regexp_extract(piece, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS name, i > 1 AND piece LIKE '/%' AS closes FROM pieces),
counted AS (
  SELECT *, sum(CASE WHEN i = 1 THEN 0 WHEN closes THEN -1 ELSE 1 END) OVER (PARTITION BY page_id, name ORDER BY i) AS deep FROM named),
starts AS (
  SELECT * FROM counted WHERE i > 1 AND NOT closes AND (
    name IN ('nav', 'header', 'footer', 'aside', 'form', 'script', 'style', 'noscript', 'head')
    OR regexp_matches(piece, '^[^>]*\s(class|id)=["''][^"'']*(cookie|advert)'))),
spans AS (
  SELECT s.page_id, s.i AS a, min(e.i) AS b FROM starts s JOIN counted e
    ON e.page_id = s.page_id AND e.name = s.name AND e.i > s.i AND e.deep = s.deep - 1 GROUP BY s.page_id, s.i),
shown AS (
  SELECT c.page_id, c.i, CASE WHEN EXISTS (SELECT 1 FROM spans s WHERE s.page_id = c.page_id AND s.a <= c.i AND c.i < s.b) THEN ''
    WHEN EXISTS (SELECT 1 FROM spans s WHERE s.page_id = c.page_id AND s.b = c.i) THEN substr(piece, strpos(piece, '>') + 1)
    WHEN c.i = 1 THEN piece ELSE '<' || piece END AS part FROM counted c)
SELECT page_id, string_agg(part, '' ORDER BY i) AS html FROM shown GROUP BY page_id""",
    "nested_markdown": r"""SELECT doc_id, '## ' || source || e'\n\nSome **bold *' || lang || '* and `' || doc_id || '`** text, *see [this](https://e.org/?a=1&b=2)*'
  || e'\n\n3. one\n4. two\n   * ' || source || e'\n   * b\n5. last\n\n| a | b\\|c |\n| --- | --- |\n| ' || lang || ' | **' || doc_id || e'** |\n\n```\n'
  || regexp_replace(coalesce(text, ''), '^\n', '') || e'\n```\n\nend' AS markdown FROM documents""",
    "pages_to_markdown": f"SELECT page_id, {markdown('html')} AS markdown FROM pages",
    "normalize_dates": f"""WITH {DOCS} SELECT doc_id, {stamp('''CASE doc_id % 6 WHEN 0 THEN date WHEN 1 THEN date
  WHEN 2 THEN date - INTERVAL 2 HOUR WHEN 3 THEN date + INTERVAL 330 MINUTE WHEN 4 THEN date_trunc('day', date) END''')} AS date FROM docs""",
    "url_source": f"SELECT page_id, {HOST} AS source FROM pages",
    "repo_name": f"""WITH {BROKEN} SELECT url, CASE WHEN route = 'github' THEN split_part(url, '/', 5) || '/' || split_part(url, '/', 6)
  ELSE '' END AS repo FROM every""",
    "detect_tags": f"""WITH {DOCS} SELECT doc_id, {tag_list("lower(content || ' ' || title)", TAG_KEYWORDS)} AS tags, {PROSE} AS prose_tags FROM docs""",
    "tag_union": f"""WITH {DOCS}, t AS (SELECT doc_id, unnest(string_split(source || ',French,' || lang || ',' || {PROSE}, ',')) AS tag FROM docs)
SELECT doc_id, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags FROM t WHERE tag <> '' GROUP BY doc_id""",
    "split_tags": f"""WITH t AS (SELECT doc_id, list_filter(list_transform(string_split(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 5 = 1 THEN ' , '
    ELSE ' ' || source || ' ,, ' || lang || ', ' || substr(text, 1, 20) END, ','), lambda p: {strip('p')}), lambda p: p <> '') AS parts FROM documents)
SELECT doc_id, CAST(len(parts) AS INT) AS n, array_to_string(parts, '|') AS tags FROM t""",
    "card_snippets": f"""WITH {ITEMS}, {CARDS}, {TRENDS} SELECT question_id, CAST(count(*) AS INT) AS n_cards,
  string_agg(title || '|' || snippet, chr(10) ORDER BY group_no, pos) AS snippets, coalesce(any_value(trending), '') AS trending
  FROM cards LEFT JOIN trends USING (question_id) GROUP BY question_id""",
    "expand_query": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || ' | python, ' || role ELSE text END AS query FROM conversations",
    "parse_chunk_ids": r"""WITH c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'hn-' || event_id || '-' || event_id % 9
    WHEN 1 THEN event_type || '-' || event_id WHEN 2 THEN event_id || '-' || event_type ELSE CAST(event_id AS VARCHAR) END AS id FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'hn-' || event_id WHEN event_id % 4 = 1 THEN regexp_extract(id, '^(.*)-', 1) END AS article_id,
  CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 9 WHEN event_id % 4 = 1 THEN event_id END AS VARCHAR) AS chunk_index FROM c""",
    "chat_records": """SELECT md5(u.text || u.conv_id || ':' || u.turn) AS article_id, 'Q: ' || substr(u.text, 1, 100) AS title,
  'ChatHistory' AS source, '2024-06-01 00:00:00' AS date, 'Q: ' || u.text || chr(10) || 'A: ' || substr(a.text, 1, 500) AS content,
  '' AS url, 'user' AS author, 'chat' AS type
FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""",
    "extract_answers": f"""SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN text WHEN (conv_id + turn) % 7 = 0
  THEN CAST(json_array(text) AS VARCHAR) ELSE {strip('text')} END AS answer FROM conversations WHERE role = 'assistant'""",
    "response_status": f"""WITH {ITEMS}, {CARDS}, {TRENDS}, sizes AS (SELECT question_id AS topic, count(*) AS size FROM items GROUP BY ALL), asked AS (
  SELECT CAST(doc_id AS VARCHAR) AS question_id, title AS question, doc_id % 7 <> 0 AS llm,
    CASE WHEN doc_id % 5 <> 0 THEN {strip('title')} END AS reply,
    CASE WHEN doc_id % 2 = 0 THEN coalesce(size, 0) ELSE 0 END AS n, CASE WHEN doc_id % 2 = 0 THEN t.trending END AS trending
  FROM docs LEFT JOIN sizes ON topic = source || ':' || doc_id // 60 LEFT JOIN trends t ON t.question_id = source || ':' || doc_id // 60)
SELECT question_id, {STATUS} AS status, {ANSWER} AS answer, CAST(n AS INT) AS n_cards, coalesce(trending, '') AS trending FROM asked""",
    "recent_articles": f"""WITH {DOCS} SELECT doc_id, title, {stamp('date')} AS date FROM docs
  WHERE date > (SELECT max(date) FROM docs) - INTERVAL 8 DAY""",
    "export_documents": f"""WITH {DOCS} SELECT content AS page_content, title, source, CASE WHEN doc_id % 3 <> 0 THEN {ISO} ELSE '' END AS date,
  url, source || ',' || lang AS tags, 'online' AS type FROM docs""",
    "import_documents": f"""WITH {DOCS} SELECT article_id, title, source, CASE WHEN doc_id % 3 <> 0 THEN {stamp('date')} END AS date, content,
  url, 2 AS n_tags, source || '|' || lang AS tags, 'online' AS type FROM docs""",
    "topic_labels": "WITH t(no, slug, label) AS (VALUES " + ", ".join(
        f"({i}, {text(slug)}, {text(label)})" for i, (slug, label) in enumerate([*TOPICS, ("other", "other")])
    ) + ") SELECT slug, label, count(*) AS n FROM documents JOIN t ON doc_id % 6 = no GROUP BY slug, label",
    "split_text_udtf": f"""WITH RECURSIVE source AS (SELECT doc_id, text AS body FROM documents), {recursive_chunks('source', 'doc_id')}
SELECT doc_id, chunk_index, content FROM pieces""",
    "full_ingest": f"""WITH RECURSIVE {RAW},
good AS (SELECT *, md5(url) AS article_id FROM raw WHERE content <> '' AND url <> '' AND title IS NOT NULL AND parsed IS NOT NULL),
later AS (SELECT good.* FROM good JOIN accepted USING (topic, page)),
landed AS (SELECT article_id, content AS body, '2024-06-02 00:00:00' AS fetched_at FROM later
  UNION ALL SELECT article_id, content, '2024-06-01 00:00:00' FROM good
  WHERE number % 5 <> 4 AND article_id NOT IN (SELECT article_id FROM later)),
{recursive_chunks('landed', 'article_id')},
chunked AS (SELECT article_id || '-' || chunk_index AS chunk_id, article_id, chunk_index, content FROM pieces),
{counts('ctf', 'chunked', 'chunk_id', 'content')}
SELECT chunk_id, article_id, CAST(chunk_index AS INT) AS chunk_index, content, fetched_at,
  CAST((SELECT count(*) FROM ctf WHERE ctf.chunk_id = chunked.chunk_id) AS INT) AS n_dims FROM chunked JOIN landed USING (article_id)""",
    "chunk_documents": f"""WITH RECURSIVE source AS (SELECT doc_id, text AS body FROM documents), {recursive_chunks('source', 'doc_id')}
SELECT doc_id, chunk_index, content FROM pieces""",
    "page_answers": f"""WITH RECURSIVE {PAGES}, source AS (SELECT page_id, content AS body FROM page_rows WHERE url <> ''),
{recursive_chunks('source', 'page_id')},
records AS (SELECT md5(url) || '-' || chunk_index AS chunk_id, p.content, title, source, url,
    {tag_list("lower(r.content || ' ' || title)", TAG_KEYWORDS)} AS tags FROM pieces p JOIN page_rows r USING (page_id)),
{counts('ctf', 'records', 'chunk_id', 'content')}, {idf('ctf', 'records', 'chunk_id')}, {weights('cw', 'ctf', 'chunk_id')},
asked AS (SELECT 'b' || item_id AS question_id, text FROM benchmark),
{counts('qtf', 'asked', 'question_id', 'text')}, {weights('qw', 'qtf', 'question_id')},
scored AS (SELECT question_id, chunk_id, round(1 - sum(qw.weight * cw.weight), 6) + 0.0 AS distance FROM qw JOIN cw USING (dim) GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM scored)
SELECT question_id, 0 AS group_no, CAST(rank AS INT) AS pos, title, source, '' AS date, substr(content, 1, 280) AS snippet, url, tags
FROM hits JOIN records USING (chunk_id) WHERE rank <= 8""",
    "chunk_coverage": """SELECT doc_id, length(text) <= 1200 AS short, CASE WHEN length(text) <= 1200 THEN 1 ELSE 0 END AS pieces_if_short,
  TRUE AS all_fit, TRUE AS all_from_text, TRUE AS starts, TRUE AS ends, TRUE AS covers FROM documents""",
    "chunk_fixed": f"WITH {WINDOWS} SELECT doc_id, chunk_index, content FROM windows",
    "chunk_records": f"""WITH {DOCS} SELECT article_id, article_id || '-0' AS first_id, TRUE AS dense, {PROSE} AS tags,
  '2024-06-01 00:00:00' AS fetched_at, type FROM docs WHERE {strip('content')} <> ''""",
    "stored_articles": f"SELECT count(*) AS stored FROM documents WHERE doc_id % 6 <> 0 AND {strip('text')} <> ''",
    "topk_cosine": f"WITH {DOCS}, {DENSE}, {nearest(8)} SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, distance FROM hits",
    "topk_cells": f"WITH {DOCS}, {DENSE}, {nearest(8)} SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, distance FROM hits",
    "ivf_recall": f"WITH {DOCS}, {DENSE}, {nearest(8)} SELECT count(*) AS n_wanted, TRUE AS reached FROM hits",
    "topk_online": f"""WITH {DOCS}, {DENSE}, {nearest(4, "type = 'online'")} SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, distance FROM hits""",
    "chat_context": f"""WITH {DOCS}, {DENSE}, {nearest(3, "type = 'chat'")} SELECT question_id, CAST(rank AS INT) AS rank, content, title,
  {stamp('date')} AS date FROM hits JOIN chunks USING (chunk_id)""",
    "neighbor_ids": f"""WITH {DOCS}, {DENSE}, {nearest(8)}, {WANTED} SELECT question_id, CAST(pos AS INT) AS pos, chunk_id, article_id, chunk_index FROM neighbours""",
    "neighbor_chunks": f"""WITH {DOCS}, {DENSE}, {nearest(8)}, {WANTED} SELECT question_id, CAST(pos AS INT) AS pos, chunk_id, content, title,
  CAST(NULL AS DOUBLE) AS distance FROM neighbours n JOIN chunks USING (chunk_id)""",
    "tag_join": "WITH k AS (" + " UNION ALL ".join(
        f"SELECT {text(t)} AS tag, {text(w)} AS keyword" for t, ws in {**TAG_KEYWORDS, **PROSE_KEYWORDS}.items() for w in ws
    ) + ") SELECT DISTINCT doc_id, tag FROM documents JOIN k ON contains(lower(text), keyword)",
    "tag_join_words": """WITH seen AS MATERIALIZED (SELECT doc_id, lower(text) || ' ' AS t FROM documents),
k AS (SELECT DISTINCT 'length ' || length(keyword) AS tag, keyword
  FROM (SELECT unnest(string_split(lower(text), ' ')[1:3]) AS keyword FROM documents) WHERE length(keyword) > 0)
SELECT DISTINCT doc_id, tag FROM seen JOIN k ON contains(t, keyword)""",
    "topk_sparse": f"""WITH {WINDOWS}, {counts('ctf', 'windows', 'chunk_id', 'content')}, {idf('ctf', 'windows', 'chunk_id')},
{weights('cw', 'ctf', 'chunk_id')},
asked AS (SELECT conv_id || ':' || turn AS question_id, text FROM conversations WHERE role = 'user'),
{counts('qtf', 'asked', 'question_id', 'text')}, {weights('qw', 'qtf', 'question_id')},
scored AS (SELECT question_id, chunk_id, round(1 - sum(qw.weight * cw.weight), 6) + 0.0 AS distance FROM qw JOIN cw USING (dim) GROUP BY ALL)
SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM scored) WHERE rank <= 8""",
    "topk_lsh": f"""WITH {DOCS}, {DENSE},
planes AS (SELECT t, b, j, CASE WHEN substr(md5(t || ':' || b || ':' || j), 1, 1) < '8' THEN 1.0 ELSE -1.0 END AS s
  FROM (SELECT unnest(range(8)) AS t), (SELECT unnest(range(6)) AS b), (SELECT unnest(range(64)) AS j)),
parts AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS j, unnest(v) AS x FROM vectors),
buckets AS (SELECT vec_id, t, sum(bit) AS bucket FROM (
  SELECT vec_id, t, b, CASE WHEN sum(s * x) >= 0 THEN 1 << CAST(b AS INT) ELSE 0 END AS bit FROM parts JOIN planes USING (j) GROUP BY vec_id, t, b)
  GROUP BY vec_id, t),
met AS (SELECT DISTINCT 'q' || a.vec_id AS question_id, c.chunk_id, round(1 - list_cosine_similarity(q.v, c.v), 6) + 0.0 AS distance
  FROM buckets a JOIN buckets b USING (t, bucket) JOIN chunks c ON c.doc_id = b.vec_id JOIN vectors q ON q.vec_id = a.vec_id)
SELECT question_id, CAST(rank AS INT) AS rank, chunk_id, distance FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, chunk_id) AS rank FROM met) WHERE rank <= 8""",
    "dedupe_articles": f"""WITH RECURSIVE o AS (
  SELECT row_number() OVER (ORDER BY doc_id) AS n, doc_id AS seq, 'u' || substr(md5(doc_id || 'u'), 1, 2) AS url,
    't' || substr(md5(doc_id || 't'), 1, 2) AS k FROM documents), {walk('o')}
SELECT seq, url, 's' AS source, k AS title FROM o JOIN walk USING (n) WHERE keep""",
    "upsert_chunks": f"""WITH {DOCS} SELECT article_id || '-0' AS chunk_id, article_id,
    CASE WHEN doc_id % 2 = 1 THEN '2' || content ELSE content END AS content,
    CASE WHEN doc_id % 2 = 1 THEN '2024-06-02 00:00:00' ELSE '2024-06-01 00:00:00' END AS fetched_at,
    CAST(CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 0 END AS INT) AS seq FROM docs
  UNION ALL SELECT article_id || '-1', article_id, '2' || content, '2024-06-02 00:00:00', 2 FROM docs WHERE doc_id % 2 = 1""",
    "upsert_table": f"""WITH {DOCS} SELECT article_id || '-0' AS chunk_id, article_id,
    CASE WHEN doc_id % 2 = 1 THEN '2' || content ELSE content END AS content,
    CASE WHEN doc_id % 2 = 1 THEN '2024-06-02 00:00:00' ELSE '2024-06-01 00:00:00' END AS fetched_at,
    CAST(CASE WHEN doc_id % 2 = 1 THEN 2 ELSE 0 END AS INT) AS seq FROM docs
  UNION ALL SELECT article_id || '-1', article_id, '2' || content, '2024-06-02 00:00:00', 2 FROM docs WHERE doc_id % 2 = 1""",
    "combine_context": f"WITH {ITEMS} SELECT * FROM items",
    "build_cards": f"WITH {ITEMS}, {CARDS} SELECT * FROM cards",
    "trending_tags": f"WITH {ITEMS}, {CARDS}, {TRENDS} SELECT * FROM trends",
    "prompt_context": f"WITH {ITEMS}, {CONTEXTS} SELECT question_id, context FROM contexts",
    "articles_by_tag": f"""WITH {DOCS} SELECT tag, count(*) AS n_articles FROM (SELECT unnest(string_split({PROSE}, ',')) AS tag FROM docs)
  WHERE tag <> '' GROUP BY tag""",
    "articles_by_tag_listing": f"WITH {DOCS} SELECT unnest([source, lang]) AS tag, article_id, title FROM docs",
    "ingest_summary": f"""WITH {GATE}, kept AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS n FROM judged WHERE reason IS NULL)
SELECT 'fetched' AS item, 0 AS pos, CAST(count(*) AS VARCHAR) AS value FROM raw
UNION ALL SELECT 'indexed', 0, CAST(count(*) AS VARCHAR) FROM kept WHERE {strip('content')} <> ''
UNION ALL SELECT 'title', CAST(n AS INT), substr(title, 1, 60) FROM kept WHERE n <= 5""",
    "newest_articles": f"WITH {DOCS} SELECT article_id, title, {stamp('date')} AS date FROM docs ORDER BY docs.date DESC, article_id LIMIT 30",
    "answer_questions": f"""WITH RECURSIVE {TOP}, {DENSE},
asked AS (SELECT 'q' || doc_id AS question_id, title AS question, [source, 'src' || doc_id % 20] AS topics,
  CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS day, doc_id % 7 <> 0 AS llm,
  CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN title ELSE {strip('title')} END AS reply FROM chunks),
{nearest(8, questions="q.question_id IN (SELECT question_id FROM asked)")},
{nearest(2, "type = 'chat'", "past", "q.question_id IN (SELECT question_id FROM asked)")}, {WANTED}, {STORIES},
news AS (SELECT topic, topic_rank, coalesce(title, '') AS title, coalesce(source_name, 'NewsAPI') AS source, date,
  CASE WHEN contains(content, '<') THEN {markdown('content')} ELSE content END AS content, url
  FROM top WHERE url <> '' AND content <> ''),
met AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY no, topic_rank) AS n, news.*, source || chr(31) || title AS k
  FROM (SELECT question_id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS no FROM asked) JOIN news USING (topic)),
{walk('met', 'question_id')},
fresh AS (SELECT met.*, row_number() OVER (PARTITION BY question_id ORDER BY n) - 1 AS pos FROM met JOIN walk USING (question_id, n) WHERE keep),
tagged AS (SELECT *, {PROSE} AS tags FROM chunks),
items AS (
  SELECT question_id, 0 AS group_no, rank AS pos, title, source, {ISO} AS date, content, url, tags FROM hits JOIN tagged USING (chunk_id)
  UNION ALL SELECT question_id, 1, pos, title, source, {ISO}, content, url, tags FROM neighbours JOIN tagged USING (chunk_id)
  UNION ALL SELECT question_id, 2, pos, title, source, {ISO}, content, url, topic FROM fresh
  UNION ALL SELECT question_id, 3, feed_rank, title, source, {ISO}, content, url, '' FROM asked JOIN stories USING (day)
  UNION ALL SELECT question_id, 4, rank, title, 'ChatHistory', {ISO}, content, '', '' FROM past JOIN chunks USING (chunk_id)),
{CARDS}, {TRENDS}, {CONTEXTS},
lists AS (SELECT question_id, count(*) AS n, string_agg(title || '|' || source || '|' || date || '|' || snippet || '|' || url || '|' || tags,
  chr(10) ORDER BY group_no, pos) AS cards FROM cards GROUP BY question_id)
SELECT question_id, {STATUS} AS status, {ANSWER} AS answer, CAST(n AS INT) AS n_cards, coalesce(trending, '') AS trending, cards, context
FROM asked JOIN lists USING (question_id) JOIN contexts USING (question_id) LEFT JOIN trends USING (question_id)""",
    "chat_history": f"""WITH RECURSIVE {DOCS}, {LOOP}
SELECT question_id, CAST(rank AS INT) AS rank, art AS article_id, content, {stamp('stored_at')} AS stored_at, distance
FROM past JOIN chunks USING (chunk_id)""",
    "chat_turns": f"""WITH RECURSIVE {TOP}, {LOOP}, {WANTED}, {STORIES},
asked AS (SELECT * FROM turns),
news AS (SELECT topic, topic_rank, coalesce(title, '') AS title, coalesce(source_name, 'NewsAPI') AS source, date,
  CASE WHEN contains(content, '<') THEN {markdown('content')} ELSE content END AS content, url
  FROM top WHERE url <> '' AND content <> ''),
met AS (SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY no, topic_rank) AS n, news.*, source || chr(31) || title AS k
  FROM (SELECT question_id, unnest(topics) AS topic, generate_subscripts(topics, 1) AS no FROM asked) JOIN news USING (topic)),
{walk('met', 'question_id')},
fresh AS (SELECT met.*, row_number() OVER (PARTITION BY question_id ORDER BY n) - 1 AS pos FROM met JOIN walk USING (question_id, n) WHERE keep),
items AS (
  SELECT question_id, 0 AS group_no, rank AS pos, title, source, {ISO} AS date, content, url, tags FROM hits JOIN chunks USING (chunk_id)
  UNION ALL SELECT question_id, 1, pos, title, source, {ISO}, content, url, tags FROM neighbours JOIN chunks USING (chunk_id)
  UNION ALL SELECT question_id, 2, pos, title, source, {ISO}, content, url, topic FROM fresh
  UNION ALL SELECT question_id, 3, feed_rank, title, source, {ISO}, content, url, '' FROM asked JOIN stories USING (day)
  UNION ALL SELECT question_id, 4, rank, title, 'ChatHistory', {ISO}, content, '', '' FROM past JOIN chunks USING (chunk_id)),
{CARDS}, {TRENDS}, {CONTEXTS},
lists AS (SELECT question_id, count(*) AS n, string_agg(title || '|' || source || '|' || date || '|' || snippet || '|' || url || '|' || tags,
  chr(10) ORDER BY group_no, pos) AS cards FROM cards GROUP BY question_id)
SELECT question_id, {STATUS} AS status, {ANSWER} AS answer, CAST(n AS INT) AS n_cards, coalesce(trending, '') AS trending, cards, context
FROM asked JOIN lists USING (question_id) JOIN contexts USING (question_id) LEFT JOIN trends USING (question_id)""",
    "normalize_vectors": """SELECT vec_id, CAST(generate_subscripts(v, 1) - 1 AS INT) AS dim,
  round(unnest(list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y))))), 6) + 0.0 AS value
FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (label + 2)) AS v FROM embeddings)""",
    "hash_vectors": f"""WITH {counts('tf', 'documents', 'doc_id', 'text')}, {idf('tf', 'documents', 'doc_id')}, {weights('w', 'tf', 'doc_id')}
SELECT doc_id, dim, round(weight, 6) AS weight FROM w""",
    "pairwise_similarity": """SELECT a.vec_id AS left_id, b.vec_id AS right_id,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) + 0.0 AS similarity
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "stream_fresh": f"""WITH RECURSIVE arrivals AS (
  SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 4 + CASE WHEN event_id % 10 = 3 THEN 3 ELSE 0 END AS INT) AS file,
    md5('https://events.example.org/' || user_id || '/' || event_type) AS article_id, user_id, event_type, min(ts) AS date
  FROM events GROUP BY ALL),
batches AS (SELECT file, row_number() OVER (ORDER BY file) AS n, max(max(date)) OVER (ORDER BY file) - INTERVAL 7 DAY AS reached
  FROM arrivals GROUP BY file),
-- A batch knows the watermark that the one before it reached; rows are late by the watermark before that.
marks AS (SELECT file, n, lag(reached) OVER (ORDER BY n) AS mark, lag(reached, 2) OVER (ORDER BY n) AS late FROM batches),
timely AS (
  SELECT a.*, m.n, row_number() OVER (PARTITION BY article_id ORDER BY m.n) AS i, coalesce(p.mark, TIMESTAMP '1970-01-01') AS passed
  FROM arrivals a JOIN marks m USING (file) LEFT JOIN marks p ON p.n = m.n - 1
  WHERE m.late IS NULL OR date > m.late),
replay AS (
  SELECT article_id, i, TRUE AS kept, date + INTERVAL 7 DAY AS expires FROM timely WHERE i = 1
  UNION ALL
  SELECT t.article_id, t.i, r.expires <= t.passed, CASE WHEN r.expires <= t.passed THEN t.date + INTERVAL 7 DAY ELSE r.expires END
  FROM replay r JOIN timely t ON t.article_id = r.article_id AND t.i = r.i + 1)
SELECT file, article_id, user_id, event_type, {stamp('date')} AS date FROM timely JOIN replay USING (article_id, i) WHERE kept""",
    "stream_upsert": f"""WITH RECURSIVE {DOCS}, landed AS (
  SELECT doc_id % 2 AS part, doc_id, article_id, title, source, content FROM docs
  UNION ALL SELECT 2, doc_id, article_id, substr(content || ' Updated later.', 1, 40), source, content || ' Updated later.' FROM docs WHERE doc_id % 10 = 0),
unique_rows AS (
  SELECT *, part || article_id AS row_id FROM landed QUALIFY row_number() OVER (PARTITION BY part, source, title ORDER BY doc_id) = 1),
rows_in AS (SELECT row_id, content AS body FROM unique_rows), {recursive_chunks('rows_in', 'row_id')}
SELECT article_id || '-' || chunk_index AS chunk_id, article_id, CAST(chunk_index AS INT) AS chunk_index, title, source,
  {tag_list("lower(u.content || ' ' || title)", TAG_KEYWORDS)} AS tags, p.content
FROM pieces p JOIN unique_rows u USING (row_id)
QUALIFY row_number() OVER (PARTITION BY article_id, chunk_index ORDER BY part DESC) = 1""",
    "stream_trending": f"""WITH w AS (SELECT date_trunc('day', ts) - to_days(CAST(i AS INT)) AS start, event_type AS tag
  FROM events, (SELECT unnest(range(7)) AS i))
SELECT {stamp('start')} AS window_start, {stamp('start + INTERVAL 7 DAY')} AS window_end, tag, count(*) AS n FROM w
WHERE start + INTERVAL 7 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY start, tag HAVING count(*) >= 3""",
    "scrape_batch": f"""WITH RECURSIVE {DOCS}, {GITHUB}, {FEED}, {PAGES}, every AS (
  SELECT seq, kind, endpoint, pos, title, coalesce(html_url, endpoint) AS url, content, 'GitHub' AS source FROM github WHERE NOT draft
  UNION ALL SELECT seq, kind, endpoint, pos, title, url, content, source FROM feed
  UNION ALL SELECT page_id, 2, url, 0, title, url, content, source FROM page_rows),
o AS MATERIALIZED (SELECT *, source || chr(31) || title AS k, row_number() OVER (ORDER BY seq, kind, endpoint, pos) AS n FROM every), {walk('o')}
SELECT source, count(*) AS n, count(DISTINCT md5(url)) AS n_ids, CAST(sum(length(content)) AS BIGINT) AS chars
FROM o JOIN walk USING (n) WHERE keep AND url <> '' AND content <> '' GROUP BY source""",
    "news_batch": f"""WITH {RAW} SELECT md5(url) AS article_id, title, 'NewsAPI' AS source, {stamp('parsed')} AS date, 'batch' AS type
  FROM raw JOIN accepted USING (topic, page) WHERE content <> '' AND url <> '' AND title IS NOT NULL AND parsed IS NOT NULL""",
}
