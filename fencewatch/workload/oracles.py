"""The right answers of the registered queries, as SQL over the same test tables."""

from __future__ import annotations

# White-space class understood by both regex engines.
_WS = (
    r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}]"
)
_ASTRAL = r"[\x{10000}-\x{10FFFF}]"


def _phone(text: str, first: str, second: str) -> str:
    return rf"""regexp_replace(substr(regexp_replace(
        CASE WHEN instr({text}, '{first}') > 1 THEN substr({text}, instr({text}, '{first}'), 12)
             WHEN instr({text}, '{second}') > 1 THEN substr({text}, instr({text}, '{second}'), 12)
             ELSE '12345678' END, '{_ASTRAL}', '--', 'g'), 1, 12), '\P{{Nd}}', '', 'g')"""


def _listing(block: int) -> str:
    """Orders as listings: what a result row shows, its place on the page, rows on the page."""
    return f"""listing AS (
  SELECT o_orderkey AS k, o_orderkey // {block} AS block, o_orderstatus AS st,
    'http://town' || (o_orderkey // 144) || '.en.example.org/bik/' || o_orderkey || '.html' AS link_url,
    CASE WHEN o_orderkey % 19 = 0 THEN ' Foo 99' ELSE strftime(o_orderdate, ' %b %d') END AS date_text,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL
         ELSE make_date(2000, month(o_orderdate), day(o_orderdate)) END AS posted,
    CASE WHEN o_orderkey % 19 = 0 THEN NULL
         ELSE strftime(make_date(2000, month(o_orderdate), day(o_orderdate)), '%d %b %Y 00:00:00')
    END AS date_posted_parsed,
    CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE '$' || CAST(floor(o_totalprice) AS BIGINT) END AS price,
    CASE WHEN o_orderkey % 17 <> 0 THEN ' (' || o_orderpriority || ')' END AS sale_area,
    'order ' || o_orderkey || ' for ' || o_custkey AS short_title,
    o_orderpriority AS category,
    CAST(row_number() OVER (PARTITION BY o_orderkey // {block}, o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS pos,
    CAST(count(*) OVER (PARTITION BY o_orderkey // {block}, o_orderstatus) AS INTEGER) AS n
  FROM orders)"""


_HTML_URL = "'http://town' || block || '.en.example.org/search/sss?query=' || st || '&srchType=A&s=0'"
_RSS_URL = (
    "'http://town' || block || '.en.example.org/search/sss?query=' || st || '&srchType=A&format=rss&s=0'"
)


def _asked(block: int, limit: int, empty_description: str) -> str:
    """Requests with the outcome of each."""
    return f"""blocks AS (SELECT DISTINCT o_orderkey // {block} AS block FROM orders),
asked AS (
  SELECT block || '-' || st AS request_id, block, st,
    CASE WHEN block % 50 = 7 THEN 'bad' WHEN block % 50 = 9 THEN 'other' ELSE 'first' END AS page
  FROM blocks CROSS JOIN (SELECT unnest(['F', 'O', 'P', 'X']) AS st)),
sizes AS (
  SELECT o_orderkey // {block} AS block, o_orderstatus AS st, CAST(count(*) AS INTEGER) AS n
  FROM orders GROUP BY 1, 2
  UNION ALL SELECT block, 'X', 0 FROM blocks),
outcome AS (
  SELECT request_id, a.block, a.st, CASE WHEN page = 'first' THEN n END AS n_rows,
    CASE WHEN page = 'bad' THEN 'bad_request' WHEN page = 'other' OR n IS NULL THEN 'page_missing'
         WHEN n = 0 THEN 'empty' WHEN n >= {limit} THEN 'too_many' ELSE 'ok' END AS status
  FROM asked a LEFT JOIN sizes s ON a.block = s.block AND a.st = s.st),
answered AS (
  SELECT *, CASE status WHEN 'too_many' THEN 'More than {limit} results returned, please be more selective'
                        WHEN 'empty' THEN 'No results returned, alter your search terms' END AS status_title,
    CASE status WHEN 'too_many' THEN 'Error' WHEN 'empty' THEN '{empty_description}' END AS status_description
  FROM outcome)"""


_DETAIL = f"""body AS (
  SELECT o_orderkey AS k,
    'http://town' || (o_orderkey // 144) || '.en.example.org/bik/' || o_orderkey || '.html' AS link_url,
    CASE WHEN o_orderkey % 89 <> 3 THEN 'Order ' || o_orderkey || ' snapshot 2' END AS title,
    CASE WHEN o_orderkey % 7 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS date_posted,
    CASE WHEN o_orderkey % 12 = 11 OR o_orderkey % 83 = 4 THEN NULL
         WHEN o_orderkey % 12 = 0 THEN ['']
         ELSE list_transform(range(1, o_orderkey % 12 + 1),
                lambda i: 'http://img.example.org/' || o_orderkey || '_' || i || '.jpg') END AS images,
    CASE WHEN o_orderkey % 83 <> 4 THEN
      E'\\nFor sale\\t' || CASE WHEN o_orderkey % 8 = 3 THEN 'more ' ELSE '' END || repeat('word ', o_orderkey % 200) ||
      CASE o_orderkey % 3 WHEN 0 THEN ' call 604-555-' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') || ' '
                          WHEN 1 THEN ' ring 708 555 0' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ' '
                          ELSE '' END ||
      CASE WHEN o_orderkey % 12 = 11 THEN ''
           WHEN o_orderkey % 12 = 0 THEN 'var imgList = [];'
           ELSE 'var imgList = ["' || array_to_string(list_transform(range(1, o_orderkey % 12 + 1),
                lambda i: 'http://img.example.org/' || o_orderkey || '_' || i || '.jpg'), '","') || '"];' END
    END AS body
  FROM orders),
measured AS (
  SELECT *, CAST(length(body) - length(translate(body, E'\\t\\n ', '')) AS INTEGER) AS ws,
    CASE WHEN images IS NULL THEN 500 ELSE 500 - 50 * CAST(len(images) AS INTEGER) END AS image_points
  FROM body),
detail AS (
  SELECT k, link_url, title, date_posted, translate(body, E'\\t\\n', '') AS description, images,
    CASE WHEN body IS NOT NULL THEN {_phone('body', '604', '708')} END AS phone_number,
    CAST(image_points + 500 - ws AS INTEGER) AS dodgy_score,
    CASE WHEN images IS NULL THEN 'No images at all mean a score of 500'
         ELSE len(images) || ' images mean a score of ' || image_points END
      || E'\\nDescription is ' || ws || ' words long so score of ' || (500 - ws) AS dodgy_description,
    CASE WHEN body IS NULL THEN 'no_body' WHEN title IS NULL THEN 'no_title' ELSE 'ok' END AS parse_status
  FROM measured)"""

# Some detail pages were never landed.
_LANDED = "landed AS (SELECT * FROM detail WHERE k % 97 <> 5)"

_HTML_FOUND = f"""WITH {_listing(144)}, {_asked(144, 50, '')}, {_DETAIL}, {_LANDED},
found AS (
  SELECT a.request_id, a.status, l.pos, l.link_url, d.date_posted, d.images, d.phone_number,
    CASE WHEN a.status = 'ok' THEN d.title ELSE a.status_title END AS title,
    CASE WHEN a.status = 'ok' THEN d.description ELSE a.status_description END AS description,
    CASE WHEN a.status = 'ok' THEN d.dodgy_score ELSE 0 END AS dodgy_score,
    d.dodgy_description, l.price, l.sale_area, l.short_title, l.category, l.date_posted_parsed, l.posted,
    CASE WHEN l.link_url IS NOT NULL THEN coalesce(d.parse_status, 'detail_missing') END AS parse_status
  FROM answered a
  LEFT JOIN listing l ON a.status = 'ok' AND a.block = l.block AND a.st = l.st
  LEFT JOIN landed d ON l.link_url = d.link_url)"""

_WIRE = """struct_pack(linkURL := link_url, decriptionHTML := description, datePosted := date_posted,
  images := images, title := title, dodgyScore := dodgy_score, datePostedReal := '/Date(' || epoch_ms(CAST(posted AS TIMESTAMP)) || ')/',
  phoneNumber := phone_number, price := price, saleArea := sale_area, shortTitle := short_title,
  category := category, datePostedParsed := date_posted_parsed, dodgyDescription := dodgy_description)"""

_RSS_FOUND = f"""WITH {_listing(72)}, {_asked(72, 25, 'Error')}, {_DETAIL}, {_LANDED},
linked AS (
  SELECT block, st, pos, link_url || CASE WHEN k % 5 = 0 THEN '?k=1&v=2' ELSE '' END AS link_url FROM listing),
found AS (
  SELECT a.request_id, a.status, l.pos, l.link_url, d.date_posted, d.images, d.phone_number,
    CASE WHEN a.status = 'ok' THEN d.title ELSE a.status_title END AS title,
    CASE WHEN a.status = 'ok' THEN d.description ELSE a.status_description END AS description,
    CASE WHEN a.status = 'ok' THEN d.dodgy_score ELSE 0 END AS dodgy_score,
    CASE WHEN l.link_url IS NOT NULL THEN coalesce(d.parse_status, 'detail_missing') END AS parse_status
  FROM answered a
  LEFT JOIN linked l ON a.status = 'ok' AND a.block = l.block AND a.st = l.st
  LEFT JOIN landed d ON l.link_url = d.link_url)"""

_ARTICLE = r"""article AS (
  SELECT page_id, url,
    regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1\s*>', 1), '<[^>]*>', '', 'g') AS title,
    regexp_replace(regexp_extract(html, '(?is)<article\b[^>]*>(.*?)</article\s*>', 1), '<[^>]*>', '', 'g') AS body
  FROM pages)"""

_FORM = r"""form AS (
  SELECT c_custkey, 'http://localhost/find.htm?itemDescription=' || replace(lower(c_mktsegment), 'h', '%68')
    || '+' || c_nationkey
    || CASE WHEN c_custkey % 2 = 0 THEN '&cityName=city' || c_nationkey ELSE '' END
    || CASE WHEN c_custkey % 3 <> 0 THEN '&pageNumber=' || (c_custkey % 5) ELSE '' END
    || CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE '' END
    || CASE WHEN c_custkey % 5 <> 0 THEN '&stolenDate=2012/' || (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1) ELSE '' END
    || '#top' AS url
  FROM customer),
asked AS (
  SELECT c_custkey,
    coalesce(nullif(url_decode(replace(regexp_extract(url, '[?&]cityName=([^&#]*)', 1), '+', ' ')), ''), 'vancouver') AS city,
    coalesce(nullif(url_decode(replace(regexp_extract(url, '[?&]pageNumber=([^&#]*)', 1), '+', ' ')), ''), '0') AS page,
    url_decode(replace(regexp_extract(url, '[?&]itemDescription=([^&#]*)', 1), '+', ' ')) AS terms,
    CASE WHEN c_custkey % 5 = 0 THEN '2013/1/5'
         ELSE '2012/' || (c_custkey % 12 + 1) || '/' || (c_custkey % 28 + 1) END AS date_shown
  FROM form)"""

_MAKER = "['velodor', 'quickwheel', 'mountaria', 'pedalio', 'rovano', 'zirk'][p_partkey % 6 + 1]"
_PART_ADVERT = f"""advert AS (
  SELECT p_partkey, string_split('selling my '
    || CASE WHEN p_partkey % 3 = 0 THEN substr({_MAKER}, 1, 1) || substr({_MAKER}, 3) ELSE {_MAKER} END
    || ' co ' || p_name || ' sn' || (p_partkey // 4) || ' '
    || ['black', 'blue', 'brown and black', 'silver red', 'xyz'][p_partkey % 5 + 1], ' ') AS tokens
  FROM part)"""
_LOCATED = """located AS (
  SELECT l_orderkey AS listing_id, 'http://parts.example.org/' || l_partkey || '.jpg' AS original_url FROM lineitem
  UNION ALL
  SELECT l_orderkey, 'http://orders.example.org/' || l_orderkey || '.jpg' FROM lineitem),
shared AS (
  SELECT original_url, count(DISTINCT listing_id) AS n_listings FROM located GROUP BY original_url)"""
_COUNTED = """counts AS (
  SELECT l_partkey, l_linenumber,
    CAST(count(*) * CASE WHEN l_partkey % 3 = 0 THEN 1234 ELSE 1 END AS INTEGER) AS n FROM lineitem
  WHERE l_partkey % 11 <> 0 GROUP BY 1, 2),
images AS (
  SELECT p_partkey AS listing_id, CAST(line - 1 AS INTEGER) AS pos,
    'http://images.craigslist.org/' || CASE WHEN p_partkey % 23 = 0 AND line = 3 THEN ''
      ELSE 'p' || p_partkey || '-' || line || '.jpg' END AS image_uri,
    CASE WHEN p_partkey % 23 = 0 AND line = 3 THEN 0 ELSE line END AS line
  FROM part CROSS JOIN (SELECT unnest(range(1, 8)) AS line)),
counted AS (
  SELECT listing_id, pos, image_uri, coalesce(n, 0) AS match_count
  FROM images LEFT JOIN counts ON listing_id = l_partkey AND line = l_linenumber)"""
_COLOUR_LIST = (
    "[['black'], ['blue'], ['brown', 'black'], ['silver', 'red'], ['xyz']][p_partkey % 5 + 1]"
)

_REGISTER_PAIRS = f"""WITH {_PART_ADVERT},
item AS (
  SELECT p_partkey, {_MAKER} AS make,
    list_concat(CASE WHEN p_partkey % 9 <> 0 THEN string_split(p_name, ' ') ELSE [] END,
      CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 5 <> 4 THEN {_COLOUR_LIST} ELSE [] END) AS terms
  FROM part)
SELECT CAST(i.p_partkey AS VARCHAR) AS item_id, a.p_partkey AS listing_id
FROM item i JOIN advert a ON i.p_partkey // 4 = a.p_partkey // 4
WHERE list_has_all(a.tokens, i.terms)
  AND len(list_filter(a.tokens, lambda t: t = i.make OR (length(t) >= 4 AND levenshtein(t, i.make) <= 1))) > 0"""

_DOCUMENT_PHONE = f"numbered AS (SELECT doc_id, {_phone('text', '743', '771')} AS phone_number FROM documents)"

_WEIGHTS = r"""worded AS (
  SELECT doc_id, list_distinct(list_filter(
    regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{Nd}]+'), lambda w: w <> '')) AS words FROM documents),
labelled AS (
  SELECT words, toxic AS bad FROM worded JOIN labels USING (doc_id) WHERE toxic IS NOT NULL),
totals AS (SELECT coalesce(sum(bad), 0) AS bad, coalesce(sum(1 - bad), 0) AS good FROM labelled),
per_word AS (
  SELECT word, CAST(sum(bad) AS BIGINT) AS n_bad, CAST(sum(1 - bad) AS BIGINT) AS n_good
  FROM (SELECT unnest(words) AS word, bad FROM labelled) GROUP BY word),
weights AS (
  SELECT word, n_bad, n_good, CAST(round(ln((n_bad + 1) / (totals.bad + 2)) - ln((n_good + 1) / (totals.good + 2)), 6)
    AS DECIMAL(12, 6)) AS weight FROM per_word CROSS JOIN totals)"""

_SETS = f"""WITH advert AS (
  SELECT p_partkey, list_distinct(string_split('selling my '
    || CASE WHEN p_partkey % 3 = 0 THEN substr({_MAKER}, 1, 1) || substr({_MAKER}, 3) ELSE {_MAKER} END
    || ' co ' || p_name || ' ' || ['black', 'blue', 'brown and black', 'silver red', 'xyz'][p_partkey % 5 + 1], ' ')) AS tokens
  FROM part),
item AS (
  SELECT {_MAKER} AS make, list_sort(list_distinct(list_concat([{_MAKER}],
    CASE WHEN p_partkey % 9 <> 0 THEN string_split(p_name, ' ') ELSE [] END,
    CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 5 <> 4 THEN {_COLOUR_LIST} ELSE [] END))) AS terms FROM part),
sets AS (SELECT make, terms, count(*) AS n_items FROM item GROUP BY ALL)
SELECT array_to_string(terms, ' ') AS terms, n_items, a.p_partkey AS listing_id
FROM sets s JOIN advert a ON list_has_all(a.tokens, list_filter(s.terms, lambda t: t <> s.make))
  AND len(list_filter(a.tokens, lambda t: t = s.make OR (length(t) >= 4 AND length(s.make) >= 4 AND levenshtein(t, s.make) <= 1))) > 0"""

_RANKED = f"""WITH advert AS (
  SELECT p_partkey, list_distinct(string_split('selling my '
    || CASE WHEN p_partkey % 3 = 0 THEN substr({_MAKER}, 1, 1) || substr({_MAKER}, 3) ELSE {_MAKER} END
    || ' co ' || p_name || ' ' || ['black', 'blue', 'brown and black', 'silver red', 'xyz'][p_partkey % 5 + 1], ' ')) AS tokens
  FROM part),
held AS (SELECT p_partkey AS listing_id, unnest(tokens) AS term FROM advert),
weights AS (
  SELECT term, CAST(floor(1000 * ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1))) AS BIGINT) + 1 AS weight
  FROM held GROUP BY term),
makes AS (SELECT DISTINCT {_MAKER} AS make FROM part),
near AS (
  SELECT DISTINCT make, listing_id FROM makes JOIN held
    ON term = make OR (length(term) >= 4 AND length(make) >= 4 AND levenshtein(term, make) <= 1)),
item AS (
  SELECT p_partkey AS item_id, {_MAKER} AS make, unnest(list_distinct(list_concat(
    CASE WHEN p_partkey % 9 <> 0 THEN string_split(p_name, ' ') ELSE [] END,
    CASE WHEN p_partkey % 8 <> 0 AND p_partkey % 5 <> 4 THEN {_COLOUR_LIST} ELSE [] END))) AS term
  FROM part),
scored AS (
  SELECT item_id, n.listing_id, CAST(sum(weight) AS BIGINT) AS score
  FROM item i JOIN near n USING (make) JOIN held h ON h.listing_id = n.listing_id AND h.term = i.term
    JOIN weights w ON w.term = i.term
  GROUP BY ALL),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, listing_id) AS INTEGER) AS rank FROM scored)
SELECT CAST(item_id AS VARCHAR) AS item_id, rank, listing_id, score FROM ranked WHERE rank <= 3"""


def _newton(labelled: str, signals: tuple[str, ...], steps: int, ridge: float) -> str:
    """CTEs up to ``learnt(b0, ...)``: Newton steps of a logistic regression, each solved by elimination."""
    size = len(signals) + 1
    index = range(size)
    ctes = [f"labelled AS ({labelled})"]
    moments = ", ".join(f"avg({s}) AS m{i}, stddev_pop({s}) AS s{i}" for i, s in enumerate(signals, 1))
    ctes.append(f"moments AS (SELECT {moments} FROM labelled)")
    scaled = ", ".join(f"CASE WHEN s{i} > 0 THEN ({s} - m{i}) / s{i} ELSE 0.0 END AS z{i}" for i, s in enumerate(signals, 1))
    ctes.append(f"scaled AS (SELECT y, 1.0::DOUBLE AS z0, {scaled} FROM labelled CROSS JOIN moments)")
    ctes.append("w0 AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in index) + ")")
    margin = " + ".join(f"b{i} * z{i}" for i in index)
    for k in range(steps):
        weights = ", ".join(f"b{i}" for i in index)
        ctes.append(f"p{k} AS (SELECT *, 1.0 / (1.0 + exp(-({margin}))) AS p FROM scaled CROSS JOIN w{k})")
        sums = [f"sum((y - p) * z{i}) - {ridge if i else 0.0} * b{i} AS g{i}" for i in index]
        sums += [
            f"sum(p * (1 - p) * z{i} * z{j}) + {(ridge if i else 0.0) + 1e-9 if i == j else 0.0} AS h{i}_{j}"
            for i in index for j in index
        ]
        ctes.append(f"e{k}_0 AS (SELECT {weights}, {', '.join(sums)} FROM p{k} GROUP BY {weights})")
        for n in range(size - 1):
            cells = [f"g{i}" if i <= n else f"g{i} - h{i}_{n} / h{n}_{n} * g{n} AS g{i}" for i in index]
            cells += [
                f"h{i}_{j}" if i <= n else f"h{i}_{j} - h{i}_{n} / h{n}_{n} * h{n}_{j} AS h{i}_{j}" for i in index for j in index
            ]
            ctes.append(f"e{k}_{n + 1} AS (SELECT {weights}, {', '.join(cells)} FROM e{k}_{n})")
        steps_back = []
        for i in reversed(index):
            rest = "".join(f" - h{i}_{j} * d{j}" for j in range(i + 1, size))
            steps_back.append(f"(g{i}{rest}) / h{i}_{i} AS d{i}")
        ctes.append(f"d{k} AS (SELECT {weights}, {', '.join(steps_back)} FROM e{k}_{size - 1})")
        ctes.append(f"w{k + 1} AS (SELECT " + ", ".join(f"b{i} + d{i} AS b{i}" for i in index) + f" FROM d{k})")
    plain = [f"CASE WHEN s{i} > 0 THEN b{i} / s{i} ELSE 0.0 END AS c{i}" for i in range(1, size)]
    constant = "b0" + "".join(f" - c{i} * m{i}" for i in range(1, size)) + " AS c0"
    ctes.append(f"learnt AS (SELECT *, {', '.join(plain)}, {constant} FROM w{steps} CROSS JOIN moments)")
    return ",\n".join(ctes)


_SIGNALS = ("text_points", "phone_adverts", "phone_missing", "word_score")
_LEARNT = f"""WITH {_DOCUMENT_PHONE}, {_WEIGHTS.replace("labelled", "worded_labelled")},
known AS (
  SELECT doc_id, nullif(phone_number, '12345678') AS phone FROM numbered),
counted_phones AS (SELECT phone, count(*) AS n FROM known WHERE phone IS NOT NULL GROUP BY phone),
said AS (
  SELECT d.doc_id, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS word_score
  FROM documents d LEFT JOIN (SELECT doc_id, unnest(words) AS word FROM worded) w ON d.doc_id = w.doc_id
    LEFT JOIN weights USING (word) GROUP BY d.doc_id),
signals AS (
  SELECT doc_id, CAST(500 - len(regexp_extract_all(coalesce(text, ''), '{_WS}')) AS DOUBLE) AS text_points,
    CAST(coalesce(n, 0) AS DOUBLE) AS phone_adverts, CAST((phone IS NULL)::INTEGER AS DOUBLE) AS phone_missing, word_score
  FROM documents JOIN known USING (doc_id) LEFT JOIN counted_phones USING (phone) JOIN said USING (doc_id)),
{_newton("SELECT CAST((quality = 0)::INTEGER AS DOUBLE) AS y, s.* FROM signals s JOIN labels USING (doc_id) WHERE quality IS NOT NULL", _SIGNALS, 8, 1.0)}"""

_ENCODED = r"""WITH kinded AS (
  SELECT page_id, html || '<!-- “5 €” – š -->' AS html,
    CASE WHEN regexp_matches(html, '[^\x{00}-\x{FF}“€”–š]') THEN page_id % 4 ELSE page_id % 6 END AS kind FROM pages),
declared AS (
  SELECT page_id, kind, CASE kind WHEN 4 THEN replace(html, 'charset="utf-8"', 'charset="Windows-1252"')
    WHEN 5 THEN replace(html, 'charset="utf-8"', 'name="x"') ELSE html END AS html FROM kinded)
SELECT page_id, ['UTF-8', 'UTF-8', 'UTF-16LE', 'UTF-16BE', 'windows-1252', 'windows-1252'][kind + 1] AS charset,
  CAST(length(html) AS INTEGER) AS n_chars, md5(html) AS html_md5 FROM declared"""

_FIRST_ADVERT = """delays AS (
  SELECT p_partkey AS part_key, DATE '1992-06-01' + CAST(p_partkey * 37 % 2600 AS INTEGER) AS stolen_on, p.posted, p.listing_id
  FROM part LEFT JOIN LATERAL (
    SELECT CAST(l_shipdate AS DATE) AS posted, l_orderkey AS listing_id FROM lineitem
    WHERE l_partkey = p_partkey AND CAST(l_shipdate AS DATE) >= DATE '1992-06-01' + CAST(p_partkey * 37 % 2600 AS INTEGER)
    ORDER BY 1, 2 LIMIT 1) p ON true),
first_advert AS (SELECT *, CAST(date_diff('day', stolen_on, posted) AS INTEGER) AS delay_days FROM delays)"""

ORACLES: dict[str, str] = {
    "page_score": rf"""WITH {_ARTICLE},
measured AS (SELECT *, CAST(len(regexp_extract_all(body, '{_WS}')) AS INTEGER) AS ws FROM article)
SELECT page_id, url AS link_url, title, translate(body, E'\t\n', '') AS description,
  {_phone('body', '743', '771')} AS phone_number, CAST(1000 - ws AS INTEGER) AS dodgy_score,
  'No images at all mean a score of 500' || E'\nDescription is ' || ws || ' words long so score of '
    || (500 - ws) AS dodgy_description, 'ok' AS parse_status
FROM measured""",
    "page_links": r"""WITH links AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<a\s[^>]*>.*?</a\s*>') AS found FROM pages),
placed AS (SELECT page_id, CAST(unnest(range(len(found))) AS INTEGER) AS pos, unnest(found) AS link FROM links)
SELECT page_id, pos, regexp_extract(link, 'href="([^"]*)"', 1) AS link_url,
  regexp_replace(link, '<[^>]*>', '', 'g') AS short_title FROM placed""",
    "phone": f"WITH {_DOCUMENT_PHONE} SELECT doc_id, phone_number FROM numbered",
    "text_score": rf"""SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WS}')) AS INTEGER) AS whitespace,
  CAST(length(translate(text, E'\t\n', '')) AS INTEGER) AS description_length,
  CAST(500 - len(regexp_extract_all(text, '{_WS}')) AS INTEGER) AS text_points FROM documents""",
    "url_param": r"""SELECT page_id, url_decode(replace(regexp_extract(url, '[?&]page=([^&#]*)', 1), '+', ' ')) AS page,
  url_decode(replace(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '+', ' ')) AS ref,
  url_decode(replace(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '+', ' ')) AS utm_source FROM pages""",
    "request_defaults": f"""WITH {_FORM}
SELECT c_custkey, city, page, terms, date_shown, replace(date_shown, '/', '') AS date_argument,
  'http://' || city || '.en.example.org/search/sss?query=' || terms || '&srchType=A&s='
    || (TRY_CAST(page AS INTEGER) * 100) AS url FROM asked""",
    "week_number": """SELECT event_id, CAST(ceil((floor((epoch_us(ts) - epoch_us(date_trunc('year', ts))) / 1000.0) / 86400000.0
  + dayofweek(date_trunc('year', ts)) + 1) / 7.0) AS INTEGER) AS week FROM events""",
    "row_flag": """SELECT event_id, event_type,
  CASE WHEN event_type = 'error' AND value > 10.0 THEN 'warning' END AS flag FROM events""",
    "link_column": """SELECT o_orderkey, o_custkey,
  './userLookup.htm?deviceProxyId=' || o_custkey AS user_lookup FROM orders""",
    "keyword_search": rf"""WITH {_ARTICLE},
searched AS (SELECT page_id, url, lower(title || ' ' || translate(body, E'\t\n', '')) AS txt FROM article)
SELECT page_id, url AS link_url FROM searched WHERE contains(txt, 'the') AND contains(txt, 'of')""",
    "city_filter": r"""SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#.:]+)', 1) AS city FROM pages
WHERE regexp_extract(url, '^https?://([^/?#:]+)', 1) LIKE 'blog.%'""",
    "posted_after": f"""WITH {_listing(144)}
SELECT link_url, category, date_posted_parsed FROM listing
WHERE posted >= make_date(2000, CAST(substr(category, 1, 1) AS INTEGER) * 2, 15)""",
    "summary_rows": f"""WITH {_listing(144)}
SELECT {_HTML_URL} AS url, pos, link_url, short_title, date_text, date_posted_parsed, price, sale_area, category
FROM listing""",
    "result_guard": f"""WITH {_asked(144, 50, '')}
SELECT request_id, n_rows, status, status_title, status_description FROM answered""",
    "rss_guard": f"""WITH {_asked(72, 25, 'Error')}
SELECT request_id, n_rows, status, status_title, status_description FROM answered""",
    "rss_links": f"""WITH {_listing(72)}
SELECT {_RSS_URL} AS url, pos, link_url || CASE WHEN k % 5 = 0 THEN '?k=1&v=2' ELSE '' END AS link_url
FROM listing""",
    "detail_join": f"""WITH {_listing(144)}, {_DETAIL}, {_LANDED}
SELECT {_HTML_URL} AS url, l.pos, l.link_url, d.title, d.date_posted, d.description,
  array_to_string(d.images, '|') AS images, CAST(len(d.images) AS INTEGER) AS n_images, d.phone_number,
  d.dodgy_score, d.dodgy_description, coalesce(d.parse_status, 'detail_missing') AS parse_status
FROM listing l LEFT JOIN landed d ON l.link_url = d.link_url""",
    "html_search": f"""{_HTML_FOUND}
SELECT request_id, status, pos, link_url, title, description, date_posted, array_to_string(images, '|') AS images,
  phone_number, dodgy_score, dodgy_description, price, sale_area, short_title, category, date_posted_parsed,
  parse_status FROM found""",
    "html_search_after": f"""{_HTML_FOUND},
since AS (SELECT *, status = 'ok' AND coalesce(posted >= DATE '2000-11-15', false) AS good FROM found)
SELECT request_id, status, pos, link_url, title, description, dodgy_score, date_posted_parsed
FROM since WHERE status <> 'ok' OR good
UNION ALL
SELECT request_id, 'empty', CAST(NULL AS INTEGER), NULL, 'No results returned, alter your search terms', '', 0, NULL
FROM since WHERE status = 'ok' GROUP BY request_id HAVING NOT bool_or(good)""",
    "rss_search": f"""{_RSS_FOUND}
SELECT request_id, status, pos, link_url, title, description, date_posted, array_to_string(images, '|') AS images,
  phone_number, dodgy_score, CAST(NULL AS VARCHAR) AS price, CAST(NULL AS VARCHAR) AS category, parse_status
FROM found""",
    "listing_json": f"""{_HTML_FOUND}
SELECT request_id, pos, CAST(to_json({_WIRE}) AS VARCHAR) AS json FROM found""",
    "response_array": f"""{_HTML_FOUND}
SELECT request_id, CAST(to_json(list({_WIRE} ORDER BY pos)) AS VARCHAR) AS json FROM found GROUP BY request_id""",
    "image_rows": f"WITH {_COUNTED} SELECT listing_id, pos, image_uri FROM images",
    "image_counts": f"WITH {_COUNTED} SELECT listing_id, pos, image_uri, match_count FROM counted",
    "image_lookup": f"""WITH {_COUNTED}
SELECT listing_id, CAST(to_json([struct_pack(
  craigslistInfoId := CAST(listing_id AS VARCHAR),
  tinEyeImageInfos := list(struct_pack(imageURI := image_uri, tinEyeImageCount := match_count) ORDER BY pos))])
  AS VARCHAR) AS json FROM counted GROUP BY listing_id""",
    "image_reuse": f"WITH {_LOCATED} SELECT original_url, n_listings FROM shared",
    "shared_images": f"""WITH {_LOCATED}
SELECT listing_id, max(n_listings) AS shared_by FROM located JOIN shared USING (original_url) GROUP BY listing_id""",
    "stock_images": f"""WITH {_COUNTED}
SELECT listing_id AS p_partkey, count(*) FILTER (WHERE match_count > 0) AS stock_images
FROM counted GROUP BY listing_id""",
    "register_filter": f"""SELECT CAST(p_partkey AS VARCHAR) AS occurence_number, upper({_MAKER} || ' co') AS make,
  upper(CASE WHEN p_partkey % 9 <> 0 THEN p_name ELSE '' END || ' sn' || (p_partkey // 4)) AS model,
  CASE WHEN p_partkey % 8 <> 0 THEN ['BLK', 'BLU', 'BRNBLK', 'SILRED', 'XYZ'][p_partkey % 5 + 1] END AS color
FROM part WHERE p_partkey % 2 = 1""",
    "register_recent": """SELECT CAST(2012 + p_partkey % 2 AS VARCHAR) AS report_year, count(*) AS n FROM part
WHERE 2012 + p_partkey % 2 BETWEEN 2013 AND 2014 GROUP BY 1""",
    "colours": f"""SELECT CAST(p_partkey AS VARCHAR) AS occurence_number,
  CASE WHEN p_partkey % 8 <> 0 THEN array_to_string({_COLOUR_LIST}, ' and ') END AS colours FROM part""",
    "make_spelling": f"""WITH {_PART_ADVERT},
vocabulary AS (SELECT DISTINCT unnest(tokens) AS token FROM advert),
makes AS (SELECT DISTINCT {_MAKER} AS term FROM part UNION SELECT 'co'),
near AS (
  SELECT token, term, (token <> term) AS changed FROM vocabulary CROSS JOIN makes
  WHERE token = term OR (length(token) >= 4 AND length(term) >= 4 AND levenshtein(token, term) <= 1)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY changed, term) AS r FROM near)
SELECT token, term FROM ranked WHERE r = 1""",
    "register_match": f"{_REGISTER_PAIRS}",
    "register_job": f"{_REGISTER_PAIRS} AND i.p_partkey % 2 = 1",
    "register_rank": _RANKED,
    "register_sets": _SETS,
    "page_encodings": _ENCODED,
    "signal_weights": _LEARNT + "".join(
        ("\nSELECT '(constant)' AS signal, round(c0, 6) AS weight FROM learnt",
         *(f"\nUNION ALL SELECT '{s}', round(c{i}, 8) FROM learnt" for i, s in enumerate(_SIGNALS, 1)))
    ),
    "signal_learnt": _LEARNT + "\nSELECT doc_id, round(1.0 / (1.0 + exp(-(c0"
    + "".join(f" + c{i} * {s}" for i, s in enumerate(_SIGNALS, 1)) + "))), 6) AS learnt_score, "
    + ", ".join(f"round(c{i} * ({s} - m{i}), 6) AS {s}_points" for i, s in enumerate(_SIGNALS, 1))
    + " FROM signals CROSS JOIN learnt",
    "request_search": rf"""WITH {_ARTICLE},
searched AS (
  SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#.:]+)', 1) AS city,
    lower(title || ' ' || translate(body, E'\t\n', '')) AS txt, string_split(title, ' ') AS words FROM article),
asked AS (
  SELECT CAST(page_id AS VARCHAR) AS request_id, city, list_filter(regexp_split_to_array(lower(concat_ws(' ',
    CASE WHEN page_id % 2 = 0 THEN upper(substr(words[1], 1, 5)) ELSE substr(words[1], 2, 3) END,
    CASE WHEN page_id % 3 = 0 THEN substr(words[2], 1, 4) END, CASE WHEN page_id % 5 = 0 THEN 'e' END,
    CASE WHEN page_id % 7 = 0 THEN 'th' END, CASE WHEN page_id % 41 = 0 THEN 'no such words' END)), '\s+'), lambda t: t <> '') AS terms
  FROM searched)
SELECT request_id, page_id FROM asked a JOIN searched s USING (city)
WHERE len(terms) > 0 AND len(list_filter(terms, lambda t: contains(txt, t))) = len(terms)""",
    "image_places": """WITH numbered AS (
  SELECT l_partkey, 'http://lines.example.org/' || l_orderkey || '/' || (l_linenumber % 3) || '.jpg' AS place,
    (row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1) // 10 AS page FROM lineitem)
SELECT 'http://images.example.org/' || l_partkey || '.jpg' AS image_uri, count(DISTINCT place) AS places
FROM numbered WHERE l_partkey % 13 <> 5 OR page = 0 GROUP BY l_partkey""",
    "json_array": """WITH shown AS (
  SELECT o_orderkey, CAST(o_orderkey % 4 AS INTEGER) AS n, o_orderkey % 2 = 1 AS odd,
    CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) AS total, o_orderstatus AS status FROM orders),
named AS (
  SELECT *, unnest(CASE WHEN odd THEN ['total', 'status', 'more'] ELSE ['more', 'status', 'total'] END) AS name,
    unnest(range(3)) AS place FROM shown),
placed AS (SELECT *, unnest(range(n)) AS pos FROM named)
SELECT o_orderkey, CAST(pos AS INTEGER) AS pos, CAST(place AS INTEGER) AS place, name,
  CASE pos WHEN 0 THEN CASE name WHEN 'total' THEN total WHEN 'status' THEN status ELSE '{"x":[1,2]}' END
           WHEN 1 THEN CASE name WHEN 'status' THEN status END
           ELSE CASE name WHEN 'total' THEN 'a, b' END END AS value FROM placed""",
    "price_level": f"""WITH {_listing(144)},
priced AS (SELECT {_HTML_URL} AS url, link_url, TRY_CAST(replace(price, '$', '') AS DOUBLE) AS amount FROM listing),
levels AS (
  SELECT url, quantile_disc(amount, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS eighths FROM priced GROUP BY url)
SELECT url, link_url, amount, round(amount / nullif(eighths[4], 0), 6) AS median_ratio,
  CASE WHEN amount IS NOT NULL THEN CAST(len(list_filter(eighths, lambda e: e < amount)) AS INTEGER) END AS price_eighth
FROM priced JOIN levels USING (url)""",
    "first_advert": f"""WITH {_FIRST_ADVERT} SELECT part_key, CAST(stolen_on AS VARCHAR) AS stolen_on,
  CAST(posted AS VARCHAR) AS posted, listing_id, delay_days FROM first_advert""",
    "delay_learnt": f"""WITH {_listing(144)}, {_FIRST_ADVERT},
past AS (SELECT avg(delay_days) AS mean, stddev_pop(delay_days) AS deviation FROM first_advert WHERE delay_days IS NOT NULL),
delayed AS (
  SELECT link_url, CAST(date_diff('day', make_date(2000, CAST(substr(category, 1, 1) AS INTEGER) * 2, 15), posted)
    AS INTEGER) AS delay_days FROM listing)
SELECT link_url, delay_days, round(abs(delay_days - mean), 6) AS delay_gap,
  round(abs(delay_days - mean) / deviation, 6) AS delay_score FROM delayed CROSS JOIN past""",
    "typed_sort_date": """SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' ELSE ' ' END || CAST(floor(o_totalprice) AS BIGINT) || ' dollars' AS price,
  o_orderpriority, strftime(o_orderdate, '%Y%m%d') AS sort_key,
  CAST(row_number() OVER (ORDER BY sort_key, o_orderkey) AS INTEGER) AS row_no FROM orders""",
    "typed_sort_numeric": """SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' ELSE ' ' END || CAST(floor(o_totalprice) AS BIGINT) || ' dollars' AS price,
  o_orderpriority, CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE floor(o_totalprice) END AS sort_key,
  CAST(row_number() OVER (ORDER BY sort_key DESC, o_orderkey DESC) AS INTEGER) AS row_no FROM orders""",
    "typed_sort_text": """SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' ELSE ' ' END || CAST(floor(o_totalprice) AS BIGINT) || ' dollars' AS price,
  o_orderpriority, lower(o_orderpriority) AS sort_key,
  CAST(row_number() OVER (ORDER BY sort_key, o_orderkey) AS INTEGER) AS row_no FROM orders""",
    "typed_sort_sniffed": """SELECT o_orderkey, strftime(o_orderdate, '%d-%m-%Y') AS day,
  CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' ELSE ' ' END || CAST(floor(o_totalprice) AS BIGINT) || ' dollars' AS price,
  o_orderpriority, lower(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a ' ELSE ' ' END
    || CAST(floor(o_totalprice) AS BIGINT) || ' dollars') AS sort_key,
  CAST(row_number() OVER (ORDER BY sort_key, o_orderkey) AS INTEGER) AS row_no FROM orders""",
    "deep_page": """WITH ranked AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(row_number() OVER (
    PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS row_no FROM orders)
SELECT * FROM ranked WHERE row_no > 2000 AND row_no <= 2100""",
    "page_offset": """WITH ranked AS (
  SELECT o_orderkey, o_orderstatus, o_totalprice, CAST(row_number() OVER (
    PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS row_no FROM orders)
SELECT * FROM ranked WHERE row_no > 200 AND row_no <= 300""",
    "json_rows": """SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name,
  CAST(c_nationkey AS VARCHAR) AS c_nationkey FROM customer""",
    "json_fields": """SELECT event_id, unnest(json_keys(props)) AS field,
  json_extract_string(props, unnest(json_keys(props))) AS value FROM events""",
    "phone_reuse": f"""WITH {_DOCUMENT_PHONE},
known AS (SELECT *, nullif(phone_number, '12345678') AS known_phone FROM numbered)
SELECT doc_id, phone_number, CASE WHEN known_phone IS NOT NULL
  THEN count(*) OVER (PARTITION BY known_phone) END AS phone_adverts FROM known""",
    "price_outlier": f"""WITH {_listing(144)},
priced AS (SELECT {_HTML_URL} AS url, link_url, TRY_CAST(replace(price, '$', '') AS DOUBLE) AS amount FROM listing)
SELECT url, link_url, amount, amount / (sum(amount) OVER w / count(amount) OVER w) AS price_ratio
FROM priced WINDOW w AS (PARTITION BY url)""",
    "price_known": f"""WITH {_listing(144)},
known AS (SELECT o_orderpriority AS category, max(o_totalprice) AS average_price FROM orders GROUP BY 1)
SELECT link_url, category, TRY_CAST(replace(price, '$', '') AS DOUBLE) / average_price AS known_price_ratio
FROM listing JOIN known USING (category)""",
    "missing_fields": f"""WITH {_DETAIL}
SELECT link_url, CAST((title IS NULL)::INTEGER + (date_posted IS NULL)::INTEGER + (description IS NULL)::INTEGER
  + (images IS NULL)::INTEGER + (phone_number IS NULL OR phone_number = '12345678')::INTEGER AS INTEGER)
  AS missing_fields FROM detail""",
    "word_weights": f"""WITH {_WEIGHTS}
SELECT word, n_bad, n_good, CAST(weight AS DOUBLE) AS weight FROM weights""",
    "word_score": f"""WITH {_WEIGHTS}
SELECT d.doc_id, CAST(coalesce(sum(weight), 0) AS DOUBLE) AS word_score
FROM documents d LEFT JOIN (SELECT doc_id, unnest(words) AS word FROM worded) w ON d.doc_id = w.doc_id
  LEFT JOIN weights USING (word) GROUP BY d.doc_id""",
    "signal_score": f"""WITH {_listing(144)}, {_DETAIL}, {_LOCATED}, {_COUNTED},
sharing AS (
  SELECT listing_id, max(n_listings) AS shared_by FROM located JOIN shared USING (original_url) GROUP BY listing_id),
stock AS (
  SELECT listing_id, count(*) FILTER (WHERE match_count > 0) AS stock_images FROM counted GROUP BY listing_id),
past AS (SELECT avg(l_quantity) AS mean, stddev_pop(l_quantity) AS deviation FROM lineitem),
phones AS (SELECT DISTINCT '604555' || lpad(CAST(c_custkey * 3 % 10000 AS VARCHAR), 4, '0') AS phone FROM customer),
basic AS (
  SELECT l.k, l.block, l.st, l.link_url, l.sale_area, d.title, d.date_posted, d.phone_number, d.dodgy_score,
    nullif(d.phone_number, '12345678') AS known_phone,
    TRY_CAST(replace(l.price, '$', '') AS DOUBLE) AS amount,
    date_diff('day', make_date(2000, CAST(substr(l.category, 1, 1) AS INTEGER) * 2, 15), l.posted) AS delay_days
  FROM listing l JOIN detail d ON l.link_url = d.link_url),
pointed AS (
  SELECT link_url, dodgy_score,
    CAST(20 * ((title IS NULL)::INTEGER + (date_posted IS NULL)::INTEGER
      + (phone_number IS NULL OR phone_number = '12345678')::INTEGER) AS INTEGER) AS missing_points,
    CASE WHEN known_phone IS NOT NULL AND count(*) OVER (PARTITION BY known_phone) > 1 THEN 100 ELSE 0 END AS phone_points,
    CASE WHEN amount / (sum(amount) OVER w / count(amount) OVER w) < 0.5 THEN 80 ELSE 0 END AS price_points,
    CASE WHEN abs(delay_days - mean) / deviation > 1 THEN 50 ELSE 0 END AS delay_points,
    CASE WHEN sale_area IS NOT NULL THEN 10 ELSE 0 END AS area_points,
    CASE WHEN phone IS NOT NULL THEN 200 ELSE 0 END AS watched_points,
    CASE WHEN shared_by > 1 THEN 60 ELSE 0 END AS shared_points,
    CAST(15 * coalesce(stock_images, 0) AS INTEGER) AS stock_points
  FROM basic CROSS JOIN past LEFT JOIN phones ON phone_number = phone
    LEFT JOIN sharing s ON s.listing_id = k LEFT JOIN stock t ON t.listing_id = k
  WINDOW w AS (PARTITION BY block, st))
SELECT *, CAST(dodgy_score + missing_points + phone_points + price_points + delay_points + area_points
  + watched_points + shared_points + stock_points AS INTEGER) AS total_score FROM pointed""",
    "delay_gap": f"""WITH {_listing(144)},
past AS (SELECT avg(l_quantity) AS mean, stddev_pop(l_quantity) AS deviation FROM lineitem),
delayed AS (
  SELECT link_url, CAST(date_diff('day', make_date(2000, CAST(substr(category, 1, 1) AS INTEGER) * 2, 15), posted)
    AS INTEGER) AS delay_days FROM listing)
SELECT link_url, delay_days, abs(delay_days - mean) AS delay_gap,
  round(abs(delay_days - mean) / deviation, 6) AS delay_score FROM delayed CROSS JOIN past""",
    "area_weight": f"""WITH {_listing(144)},
weights AS (SELECT o_orderpriority, count(*) AS weight FROM orders GROUP BY 1)
SELECT link_url, sale_area, weight AS area_weight
FROM listing LEFT JOIN weights ON sale_area = ' (' || o_orderpriority || ')'""",
    "watch_list": f"""WITH {_DETAIL},
phones AS (SELECT DISTINCT '604555' || lpad(CAST(c_custkey * 3 % 10000 AS VARCHAR), 4, '0') AS phone
  FROM customer)
SELECT link_url, phone_number, phone IS NOT NULL AS watched
FROM detail LEFT JOIN phones ON phone_number = phone""",
}
