"""SQL twins (DuckDB) of the corpus queries that SQL can express."""

#: CRC-32 of the UTF-8 bytes of ``word``: a table of 256 values, then a fold over the bytes.
CRC = """
    crc_table AS (
      SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) AS t
      FROM range(256) r(i)),
    crc AS (
      SELECT word, xor(4294967295, list_reduce(
        list_transform(range(0, length(h), 2), lambda i: ('0x' || substr(h, (i + 1)::INT, 2))::BIGINT),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1]), 4294967295)) AS crc
      FROM (SELECT word, hex(encode(word)) AS h FROM distinct_words), crc_table)"""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP11 = f"""
  WITH corpus AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word
    FROM documents),
  target AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')) AS word
    FROM benchmark),
  distinct_words AS (SELECT word FROM corpus UNION SELECT word FROM target),
  {CRC},
  buckets AS (SELECT word, crc % 10000 AS bucket FROM crc),
  s AS (SELECT bucket, count(*) AS s FROM corpus JOIN buckets USING (word) GROUP BY bucket),
  t AS (SELECT bucket, count(*) AS t FROM target JOIN buckets USING (word) GROUP BY bucket),
  gains AS (
    SELECT b.i AS bucket, floor(1000 * ln(
      ((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM corpus) + 10000)) /
      ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM target) + 10000))))::BIGINT AS gain
    FROM range(10000) b(i) LEFT JOIN s ON s.bucket = b.i LEFT JOIN t ON t.bucket = b.i),
  weights AS (
    SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
    FROM corpus JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
  scores AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
      coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM documents d LEFT JOIN weights USING (doc_id)),
  places AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scores WHERE n_features >= 20)
  SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
  FROM scores LEFT JOIN places USING (doc_id)"""

OP13 = f"""
  WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents),
  lists AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
  totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM lists GROUP BY lang),
  grams AS (
    SELECT lang, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase, k
    FROM lists, range(1, 5) r(k) WHERE len(w) >= k),
  f AS MATERIALIZED (SELECT lang, phrase, k, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
  words AS (SELECT *, string_split(phrase, ' ') AS w FROM f),
  parts AS MATERIALIZED (
    SELECT lang, phrase, a, c.k AS cut, array_to_string(w[1:c.k], ' ') AS first, array_to_string(w[c.k + 1:], ' ') AS rest
    FROM words p JOIN range(1, 4) c(k) ON c.k < p.k),
  cuts AS (
    SELECT p.lang, p.phrase, p.a, cut, x.a AS l, y.a AS r, (2000000::HUGEINT * p.a) // (x.a::HUGEINT + y.a) AS score
    FROM parts p JOIN f x ON x.lang = p.lang AND x.phrase = p.first JOIN f y ON y.lang = p.lang AND y.phrase = p.rest),
  scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
  inner_parts AS MATERIALIZED (
    SELECT q.lang, array_to_string(q.w[i:i + m - 1], ' ') AS phrase, q.a AS b
    FROM words q, range(2, 4) s(m), range(1, 4) t(i) WHERE m < q.k AND i + m - 1 <= q.k),
  dropped AS (
    SELECT DISTINCT p.lang, p.phrase FROM f p JOIN inner_parts i ON i.lang = p.lang AND i.phrase = p.phrase WHERE 100 * b::HUGEINT >= 80 * p.a::HUGEINT),
  ranks AS (
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score
    FROM scored ANTI JOIN dropped USING (lang, phrase))
  SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranks JOIN totals USING (lang) WHERE rank <= 2000"""

OP6 = f"""
  WITH RECURSIVE words AS MATERIALIZED (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
  shingles AS MATERIALIZED (
    SELECT DISTINCT doc_id, hash(g) AS s FROM (
      SELECT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS g
      FROM words WHERE len(w) > 0)),
  sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
  shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
  links AS MATERIALIZED (
    SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * i >= 90 * (a.n + b.n - i)),
  reached AS (SELECT doc_id, doc_id AS c FROM sizes UNION SELECT r.doc_id, l.y FROM reached r JOIN links l ON l.x = r.c)
  SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, d.doc_id) AS component_id
  FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM reached GROUP BY doc_id) USING (doc_id)"""

SQL: dict[str, str] = {"op6_token_group_join": OP6, "op11_importance_radix": OP11, "op13_phrase_growth": OP13}
