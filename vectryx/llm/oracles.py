"""DuckDB SQL for those queries that SQL can express."""

OP1 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5('7:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS h FROM documents),
bucketed AS (SELECT *, substr(h, 1, 3) AS b FROM sized),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM totals),
leveled AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / weight, source ASC NULLS LAST)),
targets AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, (max(level) OVER ()) * weight) AS target FROM leveled),
plan AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets),
placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM bucketed s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN start + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM placed
"""

OP10 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>') AS escaped,
    replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:') AS escaped_role FROM turns),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    lead(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS after FROM marked)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### : </turn>') + 1 + CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role) ELSE 1 + length(escaped_role) END + length(escaped)) AS BIGINT) AS formatted_chars,
  bool_and(CASE role WHEN 'system' THEN place = 1 WHEN 'user' THEN place = 1 OR before IN ('system', 'assistant')
    WHEN 'assistant' THEN coalesce(before = 'user', false) ELSE false END)
    AND bool_or(after IS NULL AND role = 'assistant') AS valid
FROM ranked GROUP BY conv_id
"""

OP7 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
twoway AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS t FROM documents UNION SELECT r.id, b.b FROM reach r JOIN twoway b ON r.t = b.a),
found AS (SELECT id, min(t) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, f.component_id, s.doc_id = f.component_id AS kept
FROM sets s JOIN found f ON s.doc_id = f.id
"""

SQL = {"op1_mix_sources": OP1, "op7_near_duplicates": OP7, "op10_chat": OP10}


def _licenses() -> str:
    from .licenses import CLUES, RULES, SENTENCES

    clue = "|".join(sorted(c.strip() for c in CLUES))
    known = ", ".join(f"('{s}', '{i}')" for s, i in SENTENCES.items())
    norm = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    steps, last = [], "s0"
    for n, (name, ids) in enumerate(RULES, 1):
        own = "".join(f"<{i}>" for i in ids)
        steps.append(f"s{n} AS (SELECT doc_id, row, ids, replace(rest, '{own}', '|') AS rest, CASE WHEN contains(rest, '{own}') AND NOT list_contains(names, '{name}') THEN list_append(names, '{name}') ELSE names END AS names FROM {last})")
        last = f"s{n}"
    return rf"""
WITH known(s, i) AS (VALUES {known}),
numbered AS (SELECT doc_id, row_number() OVER () AS row, coalesce(text, '') AS text FROM documents),
cut AS (SELECT doc_id, row, regexp_split_to_array(text, '[.!?:;]+[\x20\x09-\x0D]+|[.!?:;]+\z|\n[\x20\x09-\x0D]*\n') AS parts FROM numbered),
sentences AS (SELECT doc_id, row, generate_subscripts(parts, 1) AS place, unnest(parts) AS s FROM cut),
clues AS (SELECT * FROM sentences WHERE regexp_matches(lower(s), '{clue}')),
whole AS (SELECT c.*, k.i FROM clues c LEFT JOIN known k ON k.s = {norm.format("c.s")}),
lines AS (SELECT row, place, generate_subscripts(string_split(s, chr(10)), 1) AS line, unnest(string_split(s, chr(10))) AS l FROM whole WHERE i IS NULL),
found AS (
  SELECT row, place, 0 AS line, i FROM whole WHERE i IS NOT NULL
  UNION ALL SELECT l.row, l.place, l.line, k.i FROM lines l JOIN known k ON k.s = {norm.format("l.l")}),
ids AS (SELECT row, count(*) AS n, string_agg('<' || i || '>', '' ORDER BY place, line) AS ids FROM found GROUP BY row),
s0 AS (SELECT n.doc_id, n.row, coalesce(i.ids, '') AS ids, coalesce(i.ids, '') AS rest, CAST([] AS VARCHAR[]) AS names FROM numbered n LEFT JOIN ids i ON n.row = i.row),
{", ".join(steps)}
SELECT doc_id, CAST(len(regexp_extract_all(ids, '<')) AS BIGINT) AS n_sentences, ids AS sentence_ids, array_to_string(names, ',') AS licenses,
  CAST(len(regexp_extract_all(rest, '<')) AS BIGINT) AS unmatched
FROM {last}
"""


SQL["op3_licenses"] = _licenses()


def _quality() -> str:
    from .quality import CONTROL, DIGIT, LOWER, PUNCT, STOP, SYMBOL, UPPER, WIDE, Rules

    r = Rules()
    sets = {LOWER: "a-z", UPPER: "A-Z", DIGIT: "0-9", STOP: ".,;:", PUNCT: r"""!\x22\x27()+\-/=?@\[\\\]^_`{}~""", SYMBOL: "#*$%&|<>", WIDE: r"\x{80}-\x{10FFFF}", CONTROL: r"\x00-\x08\x0E-\x1F\x7F"}
    classes = " UNION ALL ".join(f"SELECT row, lang, {k} AS k, length(regexp_replace(text, '[^{s}]', '', 'g')) AS n FROM docs" for k, s in sets.items())
    part = "CASE WHEN {0} > 0 THEN {0} * log2({0} / (({0} + {1}) / 2)) ELSE 0 END"
    jsd = f"sqrt(greatest(0, sum({part.format('p', 'q')} + {part.format('q', 'p')}) / 2))"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, lang, text IS NULL AS void, coalesce(text, '') AS text FROM documents),
w AS (SELECT row, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
lines AS (SELECT row, count(*) - count(DISTINCT l) AS n FROM (SELECT row, unnest(string_split(text, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY row),
windows AS (SELECT row, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda j: w[j] || ' ' || w[j + 1] || ' ' || w[j + 2])) AS t FROM w WHERE len(w) > 3),
twice AS (SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY row, t) > 1),
covered AS (SELECT row, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) s(o) GROUP BY row),
base AS (
  SELECT d.row, doc_id, lang, text, len(w.w) AS n_words, list_sum(list_transform(w.w, lambda x: length(x))) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs d JOIN w ON d.row = w.row LEFT JOIN lines l ON d.row = l.row LEFT JOIN covered c ON d.row = c.row),
tokens AS (SELECT row, lang, void, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS t FROM docs),
counted AS (SELECT lang, t, count(*) AS n FROM tokens WHERE lang IS NOT NULL GROUP BY lang, t),
refs AS (SELECT lang, sum(n)::DOUBLE AS total FROM counted GROUP BY lang HAVING sum(n) >= {r.reference_words}),
common AS (SELECT lang, t, n / total AS q FROM counted JOIN refs USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, t) <= {r.common}),
pairs AS (SELECT d.row, r.lang AS ref FROM docs d JOIN refs r ON r.lang = d.lang OR d.lang IS NULL OR d.lang NOT IN (SELECT lang FROM refs)),
cls AS ({classes}),
own AS (SELECT row, k, n::DOUBLE AS n, sum(n) OVER (PARTITION BY row)::DOUBLE AS total FROM cls),
ref_cls AS (SELECT lang, k, sum(n) / sum(sum(n)) OVER (PARTITION BY lang) AS q FROM cls WHERE lang IS NOT NULL GROUP BY lang, k),
class_each AS (SELECT row, ref, {jsd} AS d FROM (SELECT p.row, p.ref, n / total AS p, q FROM pairs p JOIN own o ON p.row = o.row JOIN ref_cls c ON c.lang = p.ref AND c.k = o.k WHERE total >= {r.guard_chars}) GROUP BY row, ref),
sizes AS (SELECT row, count(*)::DOUBLE AS size FROM tokens GROUP BY row HAVING count(*) >= {r.guard_words}),
here AS (SELECT row, t, count(*) AS n FROM tokens GROUP BY row, t),
word_rows AS (SELECT p.row, p.ref, coalesce(h.n, 0) / s.size AS p, c.q FROM pairs p JOIN sizes s ON p.row = s.row JOIN common c ON c.lang = p.ref LEFT JOIN here h ON h.row = p.row AND h.t = c.t),
word_all AS (SELECT row, ref, p, q FROM word_rows UNION ALL SELECT row, ref, greatest(0, 1 - sum(p)), 1 - sum(q) FROM word_rows GROUP BY row, ref),
word_each AS (SELECT row, ref, {jsd} AS d FROM word_all GROUP BY row, ref),
found AS (
  SELECT b.*, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed,
    coalesce((SELECT min(d) FROM class_each c WHERE c.row = b.row), 0) AS cd, coalesce((SELECT min(d) FROM word_each c WHERE c.row = b.row), 0) AS wd FROM base b)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND cd <= {r.class_distance} AND wd <= {r.word_distance} AS kept, round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM found
"""


SQL["op2_quality_rules"] = _quality()
