"""SQL forms of the training-data queries that SQL can express."""

from __future__ import annotations

from rareflow.llm.common import LOWER, UPPER
from rareflow.llm.licences import PHRASES, TEMPLATES, LicenceScan
from rareflow.llm.mixing import Mix

LICENCE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
BLANK_WORDS = f"regexp_extract_all({LOWERED}, '[^\\x20\\x09-\\x0D]+')"

NEAR_DUPLICATES = f"""WITH RECURSIVE words AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ')
    ELSE array_to_string(w[i:i + 4], ' ') END AS s
  FROM words, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i)
  WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes m ON a = m.doc_id JOIN sizes n ON b = n.doc_id
  WHERE 100 * common >= 75 * (m.n + n.n - common)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reach.doc_id, ways.b FROM reach JOIN ways ON reach.other = ways.a),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least ON d.doc_id = least.doc_id LEFT JOIN sizes ON d.doc_id = sizes.doc_id"""


def license_scan() -> str:
    """Alignment of templates by grouping postings that agree on a start."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    posts = []
    for t, (_, text, phrase) in enumerate(TEMPLATES):
        words, key = text.split(), phrase.split()
        first = next(i for i in range(len(words)) if words[i:i + len(key)] == key)
        posts += [f"({t}, {i}, {quote(w)}, {first <= i < first + len(key)})"
                  for i, w in enumerate(words)]
    names = ", ".join(f"({t}, {quote(label)})" for t, (label, _, _) in enumerate(TEMPLATES))
    scan = LicenceScan()
    known = ", ".join(quote(w) for w in scan.vocabulary)
    bases = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        joins = " ".join(f"JOIN words w{k} ON w{k}.doc_id = w0.doc_id AND w{k}.i = w0.i + {k} "
                         f"AND w{k}.w = {quote(word)}"
                         for k, word in enumerate(words) if k)
        bases.append(f"SELECT w0.doc_id, w0.i, {quote(label)} AS label FROM words w0 {joins} "
                     f"WHERE w0.w = {quote(words[0])}")
    return f"""WITH listed AS (SELECT doc_id, regexp_extract_all({LOWERED}, '{LICENCE_WORD}') AS l
  FROM documents),
words AS (SELECT doc_id, CAST(i - 1 AS INTEGER) AS i, l[i] AS w FROM listed,
  LATERAL (SELECT unnest(generate_series(1, len(l))) AS i)),
base AS ({" UNION ALL ".join(bases)}),
based AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word
  FROM base GROUP BY doc_id),
posts(t, p, w, needed) AS (VALUES {", ".join(posts)}), names(t, label) AS (VALUES {names}),
sizes AS (SELECT t, count(*) AS n, count(*) FILTER (WHERE needed) AS key FROM posts GROUP BY t),
hits AS (SELECT * FROM words WHERE w IN ({known})),
ranks AS (SELECT w, row_number() OVER (ORDER BY count(DISTINCT doc_id), w) AS r
  FROM hits GROUP BY w),
indexed AS (SELECT posts.* FROM (SELECT t, p, row_number() OVER (PARTITION BY t ORDER BY coalesce(r, 0),
    w, p) AS k FROM posts LEFT JOIN ranks USING (w)) JOIN posts USING (t, p) JOIN sizes USING (t)
  WHERE k <= sizes.n - ceil(CAST('{scan.share}' AS DOUBLE) * sizes.n - 1e-9) + 1),
starts AS (SELECT DISTINCT doc_id, t, i - p AS start FROM hits JOIN indexed USING (w)),
aligned AS (SELECT doc_id, t, start, count(*) AS same, count(*) FILTER (WHERE needed) AS key
  FROM starts JOIN posts USING (t) JOIN hits USING (doc_id, w)
  WHERE hits.i = start + p GROUP BY doc_id, t, start),
scored AS (SELECT doc_id, t, CAST(same AS DOUBLE) / n AS share, aligned.key = sizes.key AS whole
  FROM aligned JOIN sizes USING (t)),
best AS (SELECT doc_id, round(max(share), 6) AS score FROM scored GROUP BY doc_id),
labels AS (SELECT DISTINCT doc_id, label FROM base UNION SELECT doc_id, label FROM scored
  JOIN names USING (t) WHERE whole AND share >= CAST('{scan.share}' AS DOUBLE)),
joined AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS labels FROM labels
  GROUP BY doc_id),
joined_base AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS base_labels
  FROM (SELECT DISTINCT doc_id, label FROM base) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
  CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, CAST(0 AS DOUBLE)) AS score
FROM listed LEFT JOIN based USING (doc_id) LEFT JOIN joined USING (doc_id)
  LEFT JOIN joined_base USING (doc_id) LEFT JOIN best USING (doc_id)"""


def source_mix() -> str:
    mix = Mix()
    weights = ", ".join(f"{w}::DOUBLE" for w in mix.weights)
    return f"""WITH sized AS (SELECT doc_id, source,
    CAST(len({BLANK_WORDS}) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, [{weights}][((row_number() OVER (ORDER BY source NULLS LAST) - 1)
  % {len(mix.weights)}) + 1] AS weight, source_size * {mix.most}::DOUBLE AS cap FROM totals),
levels AS (SELECT *, cap / weight AS fill, (CAST(sum(source_size) OVER () AS DOUBLE)
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (SELECT source, source_size, least(cap, weight * coalesce((SELECT level FROM levels
    WHERE fill >= level ORDER BY fill, source NULLS LAST LIMIT 1), 0)) AS target FROM levels),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN size < 16 THEN size
    ELSE length(bin(size)) * 16 + CAST(floor(size / pow(2, length(bin(size)) - 4)) AS BIGINT) END,
    md5('{mix.seed}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))) AS k,
  CAST(('0x' || substr(md5('{mix.seed}:offset:' || coalesce(source, '')), 1, 8)) AS BIGINT)
    / CAST(4294967296 AS DOUBLE) AS u FROM sized),
shared AS (SELECT r.*, source_size, target, CASE WHEN source_size > 0
  THEN least(target / source_size, {mix.most}::DOUBLE) ELSE 0 END AS share
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, size * least(CAST(floor(u + share * k)
  - floor(u + share * (k - 1)) AS BIGINT), {mix.most}) AS taken FROM shared"""


REPEATED_PASSAGES = f"""WITH words AS (SELECT doc_id, {BLANK_WORDS} AS w FROM documents
  WHERE text IS NOT NULL),
runs AS (SELECT doc_id, i AS pos, md5(array_to_string(w[i + 1:i + 50], ' ')) AS key
  FROM words, LATERAL (SELECT unnest(generate_series(0, len(w) - 50)) AS i) WHERE len(w) >= 50),
twice AS (SELECT key, min(doc_id) AS least FROM runs GROUP BY key HAVING count(*) > 1),
found AS (SELECT doc_id, pos, least FROM runs JOIN twice USING (key)),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50
  THEN 0 ELSE 1 END AS opens FROM found),
numbered AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM marked)
SELECT doc_id, CAST(min(pos) AS INTEGER) AS start_word, CAST(max(pos) + 50 AS INTEGER) AS end_word,
  min(least) AS copy_of FROM numbered GROUP BY doc_id, span"""

URL_FILTER = f"""WITH rules(host, path, verdict) AS (VALUES ('com', '/', 'allow'),
  ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'),
  ('net', '/fr/', 'block')),
parsed AS (SELECT page_id, translate(coalesce(regexp_extract(url,
    '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
judged AS (SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
  row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST,
    length(r.host) DESC) AS k
  FROM parsed p LEFT JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host))
    AND starts_with(p.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM judged WHERE k = 1"""

# crc32 of the decimal id, bit by bit; runs as stretches of equal grams one period apart
PERIODIC_RUNS = """WITH split AS (SELECT doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
      lambda acc, x: xor(xor(acc, x) >> 1, CASE WHEN xor(acc, x) % 2 = 1 THEN 3988292384 ELSE 0 END)),
      4294967295::BIGINT) AS h FROM documents),
looped AS (SELECT doc_id, w, len(w) AS n, h // 10 AS g, coalesce(h % 10 = 0, false) AND len(w) > 0 AS loops
  FROM split),
placed AS (SELECT *, g % n AS a, 1 + (n - g % n) // (3 + g % 8) AS p FROM looped),
texts AS (SELECT row_number() OVER () AS own, doc_id, n, CASE WHEN loops THEN list_transform(
    generate_series(1, n), lambda i: w[CASE WHEN i <= a THEN i ELSE a + 1 + (i - 1 - a) % p END])
  ELSE w END AS w FROM placed),
grams AS (SELECT own, i - 1 AS i, md5(array_to_string(w[i:i + 15], ' ')) AS gram FROM texts,
  LATERAL (SELECT unnest(generate_series(1, n - 15)) AS i) WHERE n >= 24),
equal AS (SELECT x.own, x.i, y.i - x.i AS q FROM grams x JOIN grams y
  ON x.own = y.own AND x.gram = y.gram AND x.i < y.i),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY own, q ORDER BY i) AS stretch FROM equal),
stretches AS (SELECT own, q, min(i) AS start, count(*) + 15 + q AS length FROM marked
  GROUP BY own, q, stretch),
runs AS (SELECT own, start, length, min(q) AS period FROM stretches
  WHERE length >= greatest(24, 3 * q) GROUP BY own, start, length),
told AS (SELECT own, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10),
    '' ORDER BY start, period) AS told FROM runs GROUP BY own),
best AS (SELECT own, start, length, period FROM (SELECT *, row_number() OVER (PARTITION BY own
  ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs) WHERE k = 1),
gone AS (SELECT DISTINCT own, unnest(generate_series(start + period, start + length - 1)) AS i
  FROM runs),
placed_words AS (SELECT own, i - 1 AS i, w[i] AS word FROM texts,
  LATERAL (SELECT unnest(generate_series(1, n)) AS i) WHERE own IN (SELECT own FROM runs)),
shorter AS (SELECT own, string_agg(word, ' ' ORDER BY i) AS kept
  FROM placed_words ANTI JOIN gone USING (own, i) GROUP BY own),
kept AS (SELECT own, coalesce(kept, array_to_string(w, ' ')) AS kept
  FROM texts LEFT JOIN shorter USING (own))
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, CAST(start AS BIGINT) AS start,
  CAST(length AS BIGINT) AS length, CAST(period AS BIGINT) AS period,
  CAST(1000 * length // period AS BIGINT) AS exponent_milli,
  sha256(coalesce(told, '')) AS runs_sha256, sha256(kept) AS collapsed_sha256
FROM texts LEFT JOIN told USING (own) LEFT JOIN best USING (own) JOIN kept USING (own)"""


COLLOCATIONS = f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    {LOWERED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
sizes AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM listed GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM listed,
  (SELECT unnest(generate_series(1, 5)) AS k), LATERAL (SELECT unnest(generate_series(1, len(w) - k + 1)) AS i)),
counts AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE k > 1),
inside AS (SELECT lang, array_to_string(w[i:i + s - 1], ' ') AS phrase, a FROM candidates,
  LATERAL (SELECT unnest(generate_series(2, k - 1)) AS s),
  LATERAL (SELECT unnest(generate_series(1, k - s + 1)) AS i)),
covered AS (SELECT lang, phrase, max(a) AS longer FROM inside GROUP BY lang, phrase),
kept AS (SELECT c.* FROM candidates c LEFT JOIN covered USING (lang, phrase)
  WHERE longer IS NULL OR 100 * longer < 100 * a),
cuts AS (SELECT kept.*, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
  FROM kept, LATERAL (SELECT unnest(generate_series(1, k - 1)) AS cut)),
scored AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, n,
    CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, cut
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = first
    JOIN counts y ON y.lang = c.lang AND y.phrase = rest JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS low FROM scored)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
  phrase, a, l, r, n, score FROM lowest WHERE low = 1) WHERE rank <= 2000"""
