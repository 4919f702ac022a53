"""DuckDB SQL for those training-data queries that SQL can express, by plain definitions rather than the methods."""

from __future__ import annotations

from . import license_scans, mixing, sharding, url_filters


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


def license_sql() -> str:
    """Votes and verification over the same notices, as joins of words and postings."""
    notices = ",\n  ".join(f"({no}, '{label}', {_list(notice)}, {_list(phrase)})" for no, (label, notice, phrase) in enumerate(license_scans.NOTICES))
    phrases = ", ".join(f"('{label}', {_list(phrase)})" for phrase, label in license_scans.BASE.items())
    hinted = " OR ".join(f"contains(low, '{h}')" for h in license_scans.HINTS)
    return rf"""
WITH notices(no, label, words, phrase) AS (VALUES
  {notices}),
spots AS (SELECT no, unnest(words) AS word, unnest(range(len(words))) AS pos FROM notices),
df AS (SELECT word, count(DISTINCT no) AS df FROM spots GROUP BY 1),
postings AS (SELECT no, word, pos FROM (SELECT *, row_number() OVER (PARTITION BY no ORDER BY df, pos) AS r FROM spots JOIN df USING (word)
  WHERE df < {len(license_scans.NOTICES)} AND regexp_matches(word, '[a-z]{{2}}')) WHERE r <= {license_scans.POSTINGS}),
sizes AS (SELECT no, count(*) AS size FROM postings GROUP BY 1),
places AS (SELECT no, label, phrase, list_min(list_filter(range(len(words)), lambda i: words[i + 1 : i + len(phrase)] = phrase)) AS rel FROM notices),
low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents),
d AS (SELECT doc_id, {hinted} AS hinted, regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM low),
w AS (SELECT doc_id, ws, unnest(range(len(ws))) AS i, unnest(ws) AS word FROM d WHERE hinted),
base(label, phrase) AS (VALUES {phrases}),
hits AS (SELECT doc_id, label, i FROM w JOIN base ON word = phrase[1] AND ws[i + 1 : i + len(phrase)] = phrase),
h AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM hits GROUP BY 1),
votes AS (SELECT doc_id, no, i - pos AS start, count(*) AS n FROM w JOIN postings USING (word) GROUP BY ALL),
ok AS (SELECT doc_id, label, n / size AS share FROM votes JOIN sizes USING (no) JOIN places USING (no) JOIN d USING (doc_id)
  WHERE n >= ceil({license_scans.MIN_VOTES}::DOUBLE * size) AND start + rel >= 0 AND ws[start + rel + 1 : start + rel + len(phrase)] = phrase),
named AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM hits UNION ALL SELECT doc_id, label FROM ok) GROUP BY 1),
best AS (SELECT doc_id, max(share) AS share FROM ok GROUP BY 1)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  (CASE WHEN n_base > 0 THEN 1.0 ELSE least(1.0, coalesce(share, 0)) END)::DOUBLE AS score
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN best USING (doc_id)
"""


#: All pairs of valid vectors by cosine; components by reachability.
EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
fine AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
roots AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM roots LEFT JOIN n USING (vec_id)
"""

#: Every 50-byte string as hex digits; texts are cut into overlapping chunks first, so that no substring is far from its chunk's start.
SUFFIX_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
chunks AS (SELECT doc_id, c * 500 AS base, substr(h, c * 1000 + 1, 1098) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 1000 + 1)) AS c FROM d)),
grams AS (SELECT doc_id, base + i AS pos, substr(s, 2 * i + 1, 100) AS g FROM (SELECT doc_id, base, s, unnest(range(greatest(len(s) // 2 - 49, 0))) AS i FROM chunks)),
firsts AS (SELECT g, min(doc_id) AS first FROM grams GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
starts AS (SELECT doc_id, pos FROM grams JOIN firsts USING (g) WHERE first < doc_id),
marked AS (SELECT *, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50 THEN 0 ELSE 1 END AS fresh FROM starts),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM marked),
spans AS (SELECT doc_id, run, min(pos) AS lo, max(pos) + 50 AS hi FROM numbered GROUP BY 1, 2),
gaps AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM spans),
kept AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS k
  FROM gaps JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(k, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

#: The whole ledger and verdict of quality rules (doc_id is unique in documents).
QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, range(0, 3) r(k) WHERE c > 1 GROUP BY 1),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
  coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
  length(regexp_replace(t, '[\x00-\x40\x5B-\x60\x7B-\x7F]', '', 'g')) AS n_letters
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN n_symbols > 0.25 * n_words THEN 4 ELSE 0 END + CASE WHEN n_lines >= 4 AND n_dup_lines > 0.5 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN n_words > 0 AND word_chars < 1.5 * n_words THEN 16 ELSE 0 END + CASE WHEN n_words > 0 AND word_chars > 25 * n_words THEN 32 ELSE 0 END
  + CASE WHEN word_chars > 0 AND n_letters < 0.4 * word_chars THEN 64 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits FROM b
"""

#: Every window by its lines themselves, joined with its first position (doc_id is unique in documents).
LINE_SQL = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL)),
e AS (SELECT doc_id, i, line, n, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS c
  FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM l) WHERE n > 0),
w AS (SELECT a.doc_id, a.k AS lo, min(b.k) AS hi FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k AND a.k + 49 WHERE b.c - a.c + a.n >= 50 GROUP BY 1, 2
  UNION SELECT a.doc_id, max(b.k) AS lo, a.k AS hi FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.k BETWEEN a.k - 49 AND a.k WHERE a.c - b.c + b.n >= 50 GROUP BY 1, 3),
docs AS (SELECT doc_id, list(line ORDER BY k) AS es FROM e GROUP BY 1),
keyed AS (SELECT doc_id, lo, hi, es[lo:hi] AS run FROM w JOIN docs USING (doc_id)),
firsts AS (SELECT run, min({'id': doc_id, 'lo': lo}) AS f FROM keyed GROUP BY 1 HAVING count(*) > 1),
later AS (SELECT doc_id, CASE WHEN doc_id = f.id THEN greatest(f.lo + hi - lo + 1, lo) ELSE lo END AS lo, hi FROM keyed JOIN firsts USING (run) WHERE doc_id <> f.id OR lo <> f.lo),
gone AS (SELECT DISTINCT e.doc_id, e.i FROM e JOIN later ON e.doc_id = later.doc_id AND e.k BETWEEN later.lo AND later.hi),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (doc_id, i) GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def sharding_sql(shards: int = 40) -> str:
    """Rendezvous over the same constants; CRC-32 byte by byte (parts of a shard: one below sharding.PART_ROWS rows each)."""
    rows = ", ".join(f"({s}, {x}::BIGINT, {y}::BIGINT)" for s, (x, y) in enumerate(sharding.constants(shards + 1)))
    p = sharding.PRIME
    return f"""
WITH RECURSIVE shards(no, x, y) AS (VALUES {rows}),
d AS (SELECT doc_id, coalesce(text, '') AS t, md5('{sharding.SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS h FROM documents),
k AS (SELECT doc_id, ('0x' || h[1:7])::BIGINT AS a, ('0x' || h[8:14])::BIGINT AS b FROM d),
u AS (SELECT doc_id, no, (((a + x) % {p}) * ((a + x) % {p}) % {p}) * ((b + y) % {p}) % {p} AS u FROM k, shards),
s AS (SELECT doc_id, no, -1.0::DOUBLE / ln((u + 0.5::DOUBLE) / {p}) AS score FROM u),
won AS (SELECT doc_id, arg_max(no, (score, -no)) FILTER (no < {shards}) AS shard, arg_max(no, (score, -no)) AS grown_shard FROM s GROUP BY 1),
bits AS (SELECT n, list_reduce(list_prepend(n::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(n)),
crc(doc_id, left_, c) AS (SELECT doc_id, hex(encode(t)), 4294967295::BIGINT FROM d
  UNION ALL SELECT doc_id, left_[129:], {_crc_steps()} FROM crc, (SELECT list(v ORDER BY n) AS bt FROM bits) WHERE left_ <> ''),
done AS (SELECT doc_id, xor(c, 4294967295) AS text_crc32 FROM crc WHERE left_ = '')
SELECT doc_id, (strlen(t) + 16)::BIGINT AS size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, grown_shard::INT AS grown_shard
FROM d JOIN won USING (doc_id) JOIN done USING (doc_id)
"""


def _crc_steps() -> str:
    """The next 64 bytes of the hex digits left_ into c."""
    return "list_reduce(list_prepend(c, list_transform(regexp_extract_all(left_[1:128], '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c >> 8, bt[(xor(c, x) & 255) + 1]))"


#: Weights, caps, quotients, blocks and the rotation by plain definitions (shards: one for each source below mixing.SHARD_ROWS rows).
MIXING_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null'))[9:23])::BIGINT AS ord FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS n, row_number() OVER (ORDER BY source NULLS LAST) AS no FROM d GROUP BY 1),
w AS (SELECT *, ([5, 2, 1])[(no - 1) % 3 + 1]::DOUBLE AS w FROM per),
-- a round fixes the sources above their cap; it ends when none is
rounds(rnd, fixed, again) AS (SELECT 0, []::BIGINT[], true
  UNION ALL SELECT rnd + 1, list_concat(fixed, over_), len(over_) > 0 FROM (
    SELECT rnd, fixed, (SELECT coalesce(list(no), []) FROM w WHERE NOT list_contains(fixed, no) AND
      ((SELECT sum(n) FROM w) - coalesce((SELECT sum({mixing.CAP} * n) FROM w WHERE list_contains(fixed, no)), 0))::DOUBLE * w / (SELECT sum(w) FROM w WHERE NOT list_contains(fixed, no)) > {mixing.CAP} * n) AS over_
    FROM rounds WHERE again)),
held AS (SELECT fixed FROM rounds ORDER BY rnd DESC LIMIT 1),
goal AS (SELECT w.*, CASE WHEN list_contains(fixed, no) THEN ({mixing.CAP} * n)::DOUBLE ELSE
  ((SELECT sum(n) FROM w) - coalesce((SELECT sum({mixing.CAP} * n) FROM w, held WHERE list_contains(fixed, no)), 0))::DOUBLE * w / (SELECT sum(w) FROM w, held WHERE NOT list_contains(fixed, no)) END AS target FROM w, held),
seats AS (SELECT no, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, no) AS place FROM (SELECT no, target, unnest(range({mixing.CAP} * n // {mixing.BLOCK} + 1)) AS s FROM goal) WHERE target > 0),
dealt AS (SELECT no, count(*) AS q FROM seats WHERE place <= floor((SELECT sum(n) FROM w) / {mixing.BLOCK}::DOUBLE + 0.5) GROUP BY 1),
take AS (SELECT goal.*, CASE WHEN abs(target - {mixing.CAP} * n) < {mixing.BLOCK} THEN {mixing.CAP} * n ELSE least(coalesce(q, 0) * {mixing.BLOCK}, {mixing.CAP} * n) END AS take FROM goal LEFT JOIN dealt USING (no)),
share AS (SELECT *, CASE WHEN n > 0 THEN take // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN (take % n) / n::DOUBLE ELSE 0 END AS rest, CASE WHEN n > 0 THEN greatest(floor(n / {mixing.BLOCK}::DOUBLE + 0.5), 1) ELSE 0 END::BIGINT AS blocks FROM take),
quota AS (SELECT *, floor(blocks * rest + 0.5)::BIGINT AS quota FROM share),
b AS (SELECT no, floor(blk * n / blocks::DOUBLE)::BIGINT AS lo, floor((blk + 1) * n / blocks::DOUBLE)::BIGINT AS hi FROM (SELECT *, unnest(range(blocks)) AS blk FROM quota)
  WHERE (blk * CASE WHEN blocks % {mixing.STRIDE} = 0 THEN 1 ELSE {mixing.STRIDE} END) % blocks < quota),
spot AS (SELECT doc_id, no, size, (sum(size) OVER (PARTITION BY no ORDER BY ord, doc_id) - size)::BIGINT AS lo FROM d JOIN quota ON d.source IS NOT DISTINCT FROM quota.source),
part AS (SELECT doc_id, sum(least(b.hi, spot.lo + size) - greatest(b.lo, spot.lo)) AS words FROM spot JOIN b ON spot.no = b.no AND b.lo < spot.lo + size AND b.hi > spot.lo GROUP BY 1)
SELECT doc_id, size, n AS source_size, target, (size * passes + coalesce(words, 0))::BIGINT AS taken FROM spot JOIN quota USING (no) LEFT JOIN part USING (doc_id)
"""


def url_sql() -> str:
    """Rules by length and the model's sum over all n-grams, with the same weights."""
    u = url_filters
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in u.RULES)
    number = lambda n: " + ".join(f"unicode(s[i + {k}])::BIGINT * {u.BASE**k}" for k in range(n))
    part = " UNION ALL ".join(f"SELECT page_id, ({number(n)} + {n}) % {u.PRIME} % {u.BUCKETS} AS g FROM (SELECT page_id, s, unnest(range(1, length(s) - {n - 2})) AS i FROM marked)" for n in u.GRAM_LENGTHS)
    return rf"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, host, path) AS (VALUES {rules}),
fits AS (SELECT page_id, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS said
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1),
marked AS (SELECT page_id, '^' || host || '$' AS s FROM p UNION ALL SELECT page_id, '|' || path FROM p),
g AS ({part}),
w AS (SELECT unnest(range({u.BUCKETS})) AS g, unnest({list(u.weights()[:-1])}::DOUBLE[]) AS w),
z AS (SELECT page_id, sum(w) / sqrt(count(*)) AS z FROM g JOIN w USING (g) GROUP BY 1),
m AS (SELECT page_id, host, path, rule, said, round(1 / (1 + exp(-(({u.weights()[-1]})::DOUBLE + coalesce(z, 0)))), 6) AS probability FROM p LEFT JOIN z USING (page_id) LEFT JOIN fits USING (page_id))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN probability >= {u.THRESHOLD} THEN 'block' ELSE 'allow' END) AS verdict, probability FROM m
"""
