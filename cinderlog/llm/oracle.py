"""Expected results of the operators' queries in SQL, where SQL can express them.

The texts of the others (hash placement, trained models, binomial bounds, byte windows, XXH64,
entropy windows) have no practical SQL form; tests hold them against brute force.
"""

from __future__ import annotations

from cinderlog.llm import urls

_PREFERENCES = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL
), last AS (
  SELECT conv_id, max(turn) AS turn, max({'turn': turn, 'text': text}).text AS text
  FROM turns WHERE role = 'assistant' GROUP BY conv_id
), said AS (
  SELECT conv_id AS pair_id, 'chosen' AS side, turn, role, text FROM turns
  UNION ALL
  SELECT t.conv_id, 'rejected', t.turn, t.role, t.text
  FROM turns t LEFT JOIN last l USING (conv_id) WHERE l.turn IS NULL OR t.turn < l.turn
  UNION ALL
  SELECT l.conv_id, 'rejected', l.turn, 'assistant', o.text
  FROM last l JOIN last o ON o.conv_id = xor(l.conv_id, 1)
), sides AS (
  SELECT pair_id, turn,
    min({'role': role, 'text': text}) FILTER (side = 'chosen') AS chosen,
    min({'role': role, 'text': text}) FILTER (side = 'rejected') AS rejected
  FROM said GROUP BY ALL
), split AS (
  SELECT pair_id, min(turn) FILTER (chosen IS DISTINCT FROM rejected) AS cut FROM sides GROUP BY ALL
), segments AS (
  SELECT pair_id, turn, unnest(CASE WHEN cut IS NULL OR turn < cut
    THEN [{'segment': 'prompt', 'said': chosen}]
    ELSE [{'segment': 'chosen', 'said': chosen}, {'segment': 'rejected', 'said': rejected}] END) AS s
  FROM sides JOIN split USING (pair_id)
), rendered AS (
  SELECT pair_id, CAST(floor(turn / 32) AS BIGINT) AS part, turn, s.segment AS segment,
    s.said.role AS role, '<|' || s.said.role || '|>' || chr(10) AS opening,
    s.said.text || '<|end|>' || chr(10) AS body
  FROM segments WHERE s.said IS NOT NULL
), placed AS (
  SELECT *, coalesce(sum(length(opening) + length(body)) OVER (
    PARTITION BY pair_id, part, segment ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING
  ), 0) + length(opening) AS start
  FROM rendered
), shown AS (
  SELECT pair_id, part, segment, count(*) AS n,
    string_agg(opening || body, '' ORDER BY turn) AS text,
    string_agg(start || ':' || (start + length(body)), ',' ORDER BY turn) FILTER (role = 'assistant') AS spans
  FROM placed GROUP BY ALL
), parts AS (
  SELECT DISTINCT pair_id, CAST(floor(turn / 32) AS BIGINT) AS part FROM sides
)
SELECT p.pair_id, p.part,
  coalesce(any_value(text) FILTER (segment = 'prompt'), '') AS prompt,
  coalesce(any_value(text) FILTER (segment = 'chosen'), '') AS chosen,
  coalesce(any_value(text) FILTER (segment = 'rejected'), '') AS rejected,
  coalesce(any_value(spans) FILTER (segment = 'chosen'), '') AS chosen_spans,
  coalesce(any_value(spans) FILTER (segment = 'rejected'), '') AS rejected_spans,
  coalesce(any_value(n) FILTER (segment = 'prompt'), 0) AS n_prompt_turns,
  coalesce(any_value(n) FILTER (segment = 'chosen'), 0) AS n_chosen_turns,
  coalesce(any_value(n) FILTER (segment = 'rejected'), 0) AS n_rejected_turns
FROM parts p LEFT JOIN shown USING (pair_id, part) GROUP BY ALL
"""

_CONTAMINATION = r"""
WITH listed AS (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark
), windows AS (
  SELECT item, size, array_to_string(words[pos : pos + size - 1], ' ') AS words
  FROM (SELECT item, words, least(10, len(words)) AS size,
               unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos
        FROM items WHERE len(words) > 0)
), sizes AS (
  SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc, size, words, unnest(range(1, len(words) - size + 2)) AS pos
  FROM listed, sizes WHERE len(words) >= size
), hits AS (
  SELECT p.doc, p.size, p.pos, w.item
  FROM (SELECT doc, size, pos, array_to_string(words[pos : pos + size - 1], ' ') AS words FROM places) p
  JOIN windows w USING (size, words)
), hit_words AS (
  SELECT doc, count(DISTINCT word) AS n_hit
  FROM (SELECT doc, unnest(range(pos, pos + size)) AS word FROM hits) GROUP BY doc
), hit_items AS (
  SELECT doc, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc, item FROM hits) GROUP BY doc
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM listed LEFT JOIN hit_words USING (doc) LEFT JOIN hit_items USING (doc)
"""


def _url_filters() -> str:
    listed = lambda terms: "[" + ", ".join(f"'{term}'" for term in sorted(terms)) + "]"
    rules = ", ".join(
        f"{{'host': '{host}', 'path': '{path}', 'verdict': '{verdict}'}}" for verdict, host, path in urls.RULES
    )
    hits = (
        "list_filter({terms}, lambda term: regexp_matches(low, "
        "'(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))"
    )
    return f"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id, low,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM parts
), ruled AS (
  SELECT page_id, low, host, path, list_filter([{rules}],
    lambda r: (host = r.host OR ends_with(host, '.' || r.host)) AND starts_with(path, r.path)) AS fitting
  FROM split
), judged AS (
  SELECT *, list_reduce(fitting, lambda a, b:
      CASE WHEN length(b.host || b.path) > length(a.host || a.path) THEN b ELSE a END) AS best
  FROM ruled WHERE len(fitting) > 0
  UNION ALL
  SELECT *, NULL FROM ruled WHERE len(fitting) = 0
), counted AS (
  SELECT *, {hits.format(terms=listed(urls.STRICT))} AS strict, {hits.format(terms=listed(urls.SOFT))} AS soft
  FROM judged
)
SELECT page_id, host, path, best.host || best.path AS rule,
  coalesce(best.verdict, CASE WHEN len(strict) >= 1 OR len(soft) >= {urls.SOFT_LIMIT} THEN 'block' ELSE 'allow' END)
    AS verdict,
  coalesce(array_to_string(strict, ','), '') AS strict_terms,
  coalesce(array_to_string(soft, ','), '') AS soft_terms
FROM counted
"""


# CRC-32 by half bytes; each entry is the remainder of its number.
_CRC_TABLE = [
    0x00000000, 0x1DB71064, 0x3B6E20C8, 0x26D930AC, 0x76DC4190, 0x6B6B51F4, 0x4DB26158, 0x5005713C,
    0xEDB88320, 0xF00F9344, 0xD6D6A3E8, 0xCB61B38C, 0x9B64C2B0, 0x86D3D2D4, 0xA00AE278, 0xBDBDF21C,
]

_SPELLING = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\u00c0-\u00ff]{{7,}}')) AS run
  FROM documents
), encoded AS (
  SELECT run, hex(encode(doc_id || ':' || run)) AS bytes FROM runs
), hashed AS (
  SELECT run, xor(list_reduce(
    list_prepend(4294967295, list_transform(range(len(bytes) // 2),
      lambda i: CAST('0x' || substr(bytes, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
    lambda c, b: xor(xor(xor(c, b) >> 4, {_CRC_TABLE}[(xor(c, b) & 15) + 1]) >> 4,
      {_CRC_TABLE}[(xor(xor(c, b) >> 4, {_CRC_TABLE}[(xor(c, b) & 15) + 1]) & 15) + 1])
  ), 4294967295) AS h
  FROM encoded
), words AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM hashed
), counts AS (
  SELECT word, count(*) AS n FROM words WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2
), holes AS (
  SELECT word, place, substr(word, 1, place) || substr(word, place + 2) AS less
  FROM (SELECT word, unnest(range(length(word))) AS place FROM counts)
), links AS (
  SELECT a.word, b.word AS other FROM holes a JOIN holes b ON a.place = b.place AND a.less = b.less AND a.word <> b.word
  UNION
  SELECT h.word, c.word FROM holes h JOIN counts c ON h.less = c.word
  UNION
  SELECT c.word, h.word FROM holes h JOIN counts c ON h.less = c.word
), near AS (
  SELECT l.word, count(*) AS n_near, arg_min(l.other, {{'n': -c.n, 'word': l.other}}) AS other, max(c.n) AS other_n
  FROM links l JOIN counts c ON c.word = l.other GROUP BY l.word
), formed AS (
  SELECT c.word, CASE WHEN other_n >= 10 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM counts c LEFT JOIN near USING (word)
), ways AS (
  SELECT word, form AS root, 1 AS steps FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT w.word, f.form, steps + 1 FROM ways w JOIN formed f ON f.word = w.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, steps) AS root FROM ways GROUP BY word
)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)
"""

_HARD_NEGATIVES = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, o.vec_id AS id, a.label = o.label AS same,
    CAST(list_inner_product(a.v, o.v) AS BIGINT) AS score
  FROM sound a JOIN sound o ON a.vec_id <> o.vec_id WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
), ranked AS (
  SELECT p.*, n.id AS negative_id, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n USING (anchor_id)
  WHERE NOT n.same AND 30 * positive_score <= 100 * n.score AND 100 * n.score <= 90 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""


ORACLES: dict[str, str] = {
    "op1_preference_formatting": _PREFERENCES,
    "op4_decontamination": _CONTAMINATION,
    "op8_url_filters": _url_filters(),
    "op11_spelling_variants": _SPELLING,
    "op12_hard_negatives": _HARD_NEGATIVES,
}
