"""SQL twins of the operators' queries, where SQL can express them.

They are written from the contracts and the docstrings, and share only the fixed word lists with the operators. Trained
models (op3, op5, op7), token counts of a public tokenizer (op6) and the pipeline have none; tests hold those to brute
force, to the tokenizer's own library and to held-out accuracy.
"""

from __future__ import annotations

from labelweave.llm.line_quality import BOILERPLATE, NAVIGATION

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(coalesce({text}, ''), '{WORD}')"


def _lower(text: str) -> str:
    return f"translate({text}, '{UPPER}', '{LOWER}')"


def _base32() -> str:
    """Five hex digits are twenty bits, or four letters."""
    return " || ".join(
        f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (CAST('0x' || substr(hex, {at}, 5) AS BIGINT) >> {shift}) % 32, 1)"
        for at in range(1, 41, 5)
        for shift in (15, 10, 5, 0)
    )


OP1 = f"""
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), heads AS (
  SELECT page_id, payload_bytes, {_base32()} AS payload_digest FROM hashed
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS original FROM heads
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id > original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > original THEN original END AS refers_to
FROM firsts
"""


def _op2() -> str:
    entry = "(?:" + "|".join(NAVIGATION) + ")"
    gap = r"[ \t\n\x0B\f\r|>»•·/-]"
    phrases = " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE)
    closing = "\"'')]}»”’ "
    return f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_words('text')} AS words FROM documents
), tokens AS (
  SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS p FROM docs
), windows AS (
  SELECT rid, p, w, lead(w, 1) OVER by_place AS w1, lead(w, 2) OVER by_place AS w2 FROM tokens
  WINDOW by_place AS (PARTITION BY rid ORDER BY p)
), counted AS (
  SELECT rid, p, count(*) OVER (PARTITION BY rid, w, w1, w2) AS n FROM windows WHERE w2 IS NOT NULL
), covered AS (
  SELECT rid, count(DISTINCT p + d) AS n FROM counted, range(3) AS step(d) WHERE counted.n > 1 GROUP BY rid
), lines AS (
  SELECT rid, i, line, lower(line) AS low,
    rtrim(line, '{closing}' || chr(9) || chr(11) || chr(12) || chr(13)) AS bare,
    length(line) - length(regexp_replace(line, '[#*$%&|<>!]', '', 'g')) AS marks,
    length(line) - length(replace(line, ' ', '')) AS spaces
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM docs)
), ruled AS (
  SELECT rid, line, regexp_matches(line, '{WORD}') AS worded,
    ((bare <> '' AND contains('.!?:;…。！？', right(bare, 1))) OR len({_words('line')}) >= 3)
      AND 10 * (marks - 1) <= 3 * (spaces + 1)
      AND NOT regexp_matches(low, '^{gap}*{entry}(?:{gap}+{entry})*{gap}*$')
      AND NOT ({phrases}) AND line <> '' AS passed
  FROM lines
), judged AS (
  SELECT rid, count(*) FILTER (worded) AS n_lines, count(*) FILTER (passed) AS n_lines_kept,
    count(*) FILTER (worded) - count(DISTINCT line) FILTER (worded) AS n_dup_lines,
    coalesce(sum(length(line)) FILTER (worded), 0)::BIGINT AS line_chars,
    coalesce(sum(length(line)) FILTER (passed), 0)::BIGINT AS kept_chars
  FROM ruled GROUP BY rid
), measured AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words, n_lines, n_lines_kept, line_chars, kept_chars
  FROM docs JOIN judged USING (rid) LEFT JOIN covered USING (rid)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * line_chars AS kept
FROM measured
"""


def _strength(groups: str) -> str:
    """Rate and prior strength of groups, by moments."""
    return f"""
  SELECT CASE WHEN total IS NULL THEN 0.5 ELSE rate END AS rate,
    CASE WHEN total IS NULL THEN 1.0 ELSE 1 / least(greatest(CASE WHEN spread > 0
      THEN (kk - bad * bad / total - rate * (1 - rate) * (m - 1)) / spread ELSE 0.0 END, 0.001), 0.5) - 1 END AS strength
  FROM (SELECT *, rate * (1 - rate) * (total - nn / total - (m - 1)) AS spread
    FROM (SELECT *, bad / total AS rate
      FROM (SELECT count(*) AS m, sum(n)::DOUBLE AS total, sum(bad)::DOUBLE AS bad, sum(n * n)::DOUBLE AS nn,
          sum(bad * bad / n::DOUBLE) AS kk FROM {groups} WHERE n > 0)))"""


OP4 = rf"""
WITH parts AS (
  SELECT page_id, {_lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages
), outcome AS (
  SELECT doc_id AS page_id, bool_or(coalesce(quality = 0, false) OR coalesce(toxic = 1, false)) AS bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad::INT), 0)::BIGINT AS bad,
    regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM parts LEFT JOIN outcome USING (page_id) GROUP BY host
), cut AS (
  SELECT *, CASE WHEN regexp_matches(l[-1], '^[0-9]*$') THEN ''
    WHEN length(l[-1]) = 2 AND len(l) > 1 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org')
    THEN l[-2] || '.' || l[-1] ELSE l[-1] END AS suffix
  FROM (SELECT *, string_split(name, '.') AS l FROM hosts)
), tree AS (
  SELECT host, n, bad, suffix, CASE WHEN suffix = '' OR more = '' THEN name ELSE more || '.' || suffix END AS domain
  FROM (SELECT *, regexp_extract(left(name, greatest(length(name) - length(suffix) - 1, 0)), '([^.]+)$', 1) AS more FROM cut)
), domains AS (SELECT suffix, domain, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM tree GROUP BY suffix, domain),
suffixes AS (SELECT suffix, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad FROM domains GROUP BY suffix),
of_suffix AS ({_strength("suffixes")}), of_domain AS ({_strength("domains")}), of_host AS ({_strength("tree")}),
suffix_mean AS (SELECT suffix, (bad + rate * strength) / (n + strength) AS mean FROM suffixes, of_suffix),
domain_mean AS (
  SELECT d.suffix, domain, (bad + mean * strength) / (n + strength) AS mean
  FROM domains d JOIN suffix_mean USING (suffix), of_domain
), posterior AS (
  SELECT host, n, mean * strength + bad AS a, (1 - mean) * strength + n - bad AS b
  FROM tree JOIN domain_mean USING (suffix, domain), of_host
), bounds AS (
  SELECT host, n AS n_labelled, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM posterior
), rules(verdict, rule, name, start) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
    ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
), fits AS (
  SELECT host, path, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS said
  FROM (SELECT DISTINCT host, path FROM parts), rules
  WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, start) GROUP BY host, path
)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN bound > 0.3 THEN 'block' ELSE 'allow' END) AS verdict,
  n_labelled, round(bound, 9) AS bad_bound
FROM parts LEFT JOIN bounds USING (host) LEFT JOIN fits USING (host, path)
"""

OP8 = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(coalesce({_lower("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), items AS (
  SELECT item_id, regexp_extract_all(coalesce({_lower("text")}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS width, array_to_string(words[i:i + 9], ' ') AS run
  FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 8, 2))) AS i FROM items WHERE len(words) > 0)
), tokens AS (
  SELECT rid, unnest(words) AS w, unnest(range(len(words))) AS p FROM docs
), ahead AS (
  SELECT rid, p, list(w) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS run FROM tokens
), places AS (
  SELECT rid, p, width, array_to_string(run[1:width], ' ') AS run
  FROM ahead, (SELECT DISTINCT width FROM windows) WHERE len(run) >= width
), found AS (
  SELECT rid, p, width, item_id FROM places JOIN windows USING (width, run)
), hit AS (
  SELECT rid, count(DISTINCT place) AS n FROM (SELECT rid, unnest(range(p, p + width)) AS place FROM found) GROUP BY rid
), named AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS listed
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM found) GROUP BY rid
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
  sha256(coalesce(listed, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)
"""

OP9 = f"""
WITH RECURSIVE docs AS (
  SELECT doc_id, {_words(_lower("text"))} AS words FROM documents
), tokens AS (
  SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS p, len(words) AS n FROM docs
), ahead AS (
  SELECT doc_id, n, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS run FROM tokens
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(run, ' ') AS shingle FROM ahead WHERE len(run) = least(n, 5)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * shared.n >= 80 * (x.n + y.n - shared.n)
), both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM docs UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.other
)
SELECT doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id
FROM docs LEFT JOIN sizes USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

OP10 = f"""
WITH RECURSIVE topic_of AS (
  SELECT vec_id AS doc_id, min(label::VARCHAR) AS topic FROM embeddings WHERE vec_id IS NOT NULL GROUP BY vec_id
), counted AS (
  SELECT doc_id, coalesce(source, 'none') AS source, coalesce(lang, 'none') AS lang, coalesce(topic, 'none') AS topic,
    len({_words("text")})::BIGINT AS n_tokens
  FROM documents LEFT JOIN topic_of USING (doc_id)
), cells AS (
  SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens, sum(sum(n_tokens)) OVER ()::DOUBLE AS total
  FROM counted GROUP BY source, lang, topic
), lifted AS (
  SELECT *, pow(sum(tokens) OVER (PARTITION BY source), 0.7) AS s, pow(sum(tokens) OVER (PARTITION BY lang), 0.7) AS l,
    pow(sum(tokens) OVER (PARTITION BY topic), 0.7) AS t FROM cells
), wanted AS (
  SELECT source, lang, topic, tokens, total * s / (SELECT sum(s) FROM (SELECT DISTINCT source, s FROM lifted)) AS s,
    total * l / (SELECT sum(l) FROM (SELECT DISTINCT lang, l FROM lifted)) AS l,
    total * t / (SELECT sum(t) FROM (SELECT DISTINCT topic, t FROM lifted)) AS t FROM lifted
), raked AS (
  SELECT 0 AS step, *, 1.0::DOUBLE AS weight FROM wanted
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens, s, l, t, weight * CASE WHEN mass > 0 THEN aim / mass ELSE 0 END
  FROM (
    SELECT *, CASE step % 3 WHEN 0 THEN s WHEN 1 THEN l ELSE t END AS aim,
      CASE step % 3 WHEN 0 THEN sum(tokens * weight) OVER (PARTITION BY source)
        WHEN 1 THEN sum(tokens * weight) OVER (PARTITION BY lang)
        ELSE sum(tokens * weight) OVER (PARTITION BY topic) END AS mass
    FROM raked WHERE step < 36)
), vals AS (
  SELECT 'source' AS m, source AS v, sum(tokens) AS tokens FROM cells GROUP BY source
  UNION ALL SELECT 'lang', lang, sum(tokens) FROM cells GROUP BY lang
  UNION ALL SELECT 'topic', topic, sum(tokens) FROM cells GROUP BY topic
), shares AS (
  SELECT m, v, tokens, pow(tokens, 0.7) / sum(pow(tokens, 0.7)) OVER (PARTITION BY m) AS share FROM vals
), fill(m, it, scale, n_full, done) AS (
  SELECT DISTINCT m, 0, (SELECT 0.5 * sum(tokens) FROM cells), -1::BIGINT, false FROM shares
  UNION ALL
  SELECT f.m, f.it + 1,
    CASE WHEN count(*) FILTER (s.share * f.scale >= s.tokens) <= f.n_full
      OR coalesce(sum(s.share) FILTER (NOT s.share * f.scale >= s.tokens), 0) = 0 THEN f.scale
    ELSE ((SELECT 0.5 * sum(tokens) FROM cells) - coalesce(sum(s.tokens) FILTER (s.share * f.scale >= s.tokens), 0))
      / sum(s.share) FILTER (NOT s.share * f.scale >= s.tokens) END,
    count(*) FILTER (s.share * f.scale >= s.tokens),
    count(*) FILTER (s.share * f.scale >= s.tokens) <= f.n_full
      OR coalesce(sum(s.share) FILTER (NOT s.share * f.scale >= s.tokens), 0) = 0
  FROM fill f JOIN shares s ON s.m = f.m WHERE NOT f.done GROUP BY f.m, f.it, f.scale, f.n_full
), reach AS (
  SELECT s.m, s.v, least(s.tokens, s.share * f.scale) AS aim FROM shares s JOIN fill f ON f.m = s.m AND f.done
), aims AS (
  SELECT c.source, c.lang, c.topic, c.tokens, rs.aim AS aim_s, rl.aim AS aim_l, rt.aim AS aim_t FROM cells c
  JOIN reach rs ON rs.m = 'source' AND rs.v = c.source JOIN reach rl ON rl.m = 'lang' AND rl.v = c.lang
  JOIN reach rt ON rt.m = 'topic' AND rt.v = c.topic
), bound AS (
  SELECT 0 AS step, *, 1.0::DOUBLE AS p, false AS fixed, false AS stop FROM aims
  UNION ALL
  SELECT step + 1, source, lang, topic, tokens, aim_s, aim_l, aim_t,
    CASE WHEN phase = 36 THEN CASE WHEN fixed OR above THEN 1.0 ELSE p END
      WHEN fixed THEN 1.0 ELSE p * CASE WHEN mass > 0 THEN greatest(aim - held, 0) / mass ELSE 0 END END,
    CASE WHEN phase = 36 THEN fixed OR above ELSE fixed END,
    phase = 36 AND NOT any_above
  FROM (
    SELECT *, step % 37 AS phase, NOT fixed AND p > 1 + 1e-9 AS above,
      bool_or(NOT fixed AND p > 1 + 1e-9) OVER () AS any_above,
      CASE step % 37 % 3 WHEN 0 THEN aim_s WHEN 1 THEN aim_l ELSE aim_t END AS aim,
      CASE step % 37 % 3 WHEN 0 THEN sum(CASE WHEN fixed THEN 0 ELSE tokens * p END) OVER (PARTITION BY source)
        WHEN 1 THEN sum(CASE WHEN fixed THEN 0 ELSE tokens * p END) OVER (PARTITION BY lang)
        ELSE sum(CASE WHEN fixed THEN 0 ELSE tokens * p END) OVER (PARTITION BY topic) END AS mass,
      CASE step % 37 % 3 WHEN 0 THEN sum(CASE WHEN fixed THEN tokens ELSE 0 END) OVER (PARTITION BY source)
        WHEN 1 THEN sum(CASE WHEN fixed THEN tokens ELSE 0 END) OVER (PARTITION BY lang)
        ELSE sum(CASE WHEN fixed THEN tokens ELSE 0 END) OVER (PARTITION BY topic) END AS held
    FROM bound WHERE NOT stop)
), weighed AS (
  SELECT doc_id, source, lang, topic, n_tokens, round(r.weight, 9) AS weight, round(least(1.0, b.p), 9) AS probability
  FROM counted JOIN (SELECT * FROM raked WHERE step = 36) r USING (source, lang, topic)
  JOIN (SELECT * FROM bound WHERE stop) b USING (source, lang, topic)
)
SELECT doc_id, source, lang, topic, n_tokens, weight, probability,
  coalesce(CAST('0x' || substr(md5('mix:' || doc_id::VARCHAR), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE
    < probability, false) AS sampled
FROM weighed
"""

OP13 = """
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), lines AS (
  SELECT rid, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM docs
), keyed AS (
  SELECT rid, pos, line,
    translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10
), judged AS (
  SELECT rid, pos, line, key IN (SELECT key FROM frequent) AS gone FROM keyed
)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines,
  CAST((SELECT count(*) FROM judged j WHERE j.rid = docs.rid AND gone) AS BIGINT) AS n_dropped,
  sha256(coalesce((SELECT string_agg(line, chr(10) ORDER BY pos) FROM judged j WHERE j.rid = docs.rid AND NOT gone), ''))
    AS kept_sha256
FROM docs
"""


ORACLES: dict[str, str] = {
    "op1_warc_revisits": OP1,
    "op2_line_quality": _op2(),
    "op4_url_reputation": OP4,
    "op8_contamination": OP8,
    "op9_order_join": OP9,
    "op10_raked_mixture": OP10,
    "op13_line_dedup": OP13,
}
