"""DuckDB SQL for those operators that SQL can express."""

from __future__ import annotations

from tideglass.llm.licenses import LEAST_SHARE, PHRASES, RARE, SPAN, TEMPLATES

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP5 = f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
item AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL),
sized AS (SELECT item_id, words, least(13, len(words)) AS k FROM item WHERE len(words) > 0),
win AS (
  SELECT DISTINCT item_id, k, list_slice(words, i, i + k - 1) AS win
  FROM (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM sized)
),
place AS (
  SELECT doc_id, k, i, list_slice(words, i, i + k - 1) AS win
  FROM (
    SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS i
    FROM doc, (SELECT DISTINCT k FROM sized) WHERE len(words) >= k
  )
),
found AS (SELECT doc_id, k, i, item_id FROM place JOIN win USING (k, win)),
hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(s.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s.items, '')) AS items_sha256,
  coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.words) AS contaminated
FROM doc d LEFT JOIN hit h USING (doc_id) LEFT JOIN ids s USING (doc_id)
"""

_BITS = "CAST(CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS VARCHAR)"

OP9 = f"""
WITH page AS (
  SELECT page_id, coalesce(html, '') AS html, {_BITS} AS bits,
    max(page_id) OVER (PARTITION BY coalesce(html, '')) AS holder
  FROM pages
)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  list_aggregate(
    list_transform(
      range(0, 32),
      lambda i: substr(
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(1 + list_sum(list_transform(range(1, 6), lambda j: CAST(substr(bits, 5 * i + j, 1) AS INTEGER) * (32 >> j))) AS BIGINT),
        1
      )
    ),
    'string_agg', ''
  ) AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to,
  TRUE AS intact
FROM page
"""


OP6 = rf"""
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents
),
gram AS (
  SELECT DISTINCT doc_id, g FROM (
    SELECT doc_id, unnest(
      CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END
    ) AS g FROM doc
  )
),
size AS (SELECT doc_id, count(*) AS n FROM gram GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
  FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
),
link AS (
  SELECT x, y FROM pair JOIN size sx ON sx.doc_id = x JOIN size sy ON sy.doc_id = y
  WHERE 100 * c >= 80 * (sx.n + sy.n - c)
),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM doc
  UNION
  SELECT r.doc_id, e.y FROM reach r JOIN edge e ON e.x = r.other
)
SELECT r.doc_id, CAST(coalesce(max(s.n), 0) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN size s USING (doc_id) GROUP BY r.doc_id
"""


def _op8() -> str:
    templates = ", ".join(f"('{t}', string_split('{text}', ' '))" for t, (text, _) in TEMPLATES.items())
    keys = ", ".join(f"('{t}', ' {key} ')" for t, (_, keys) in TEMPLATES.items() for key in keys)
    phrases = ", ".join(f"('{label}', string_split('{phrase}', ' '))" for phrase, label in PHRASES)
    return f"""
WITH doc AS (SELECT doc_id, {_WORDS} AS words FROM documents),
tmpl AS (
  SELECT template, unnest(w) AS word, unnest(range(0, len(w))) AS place FROM (VALUES {templates}) t(template, w)
),
df AS (
  SELECT word, count(*) AS df FROM (SELECT unnest(list_distinct(words)) AS word FROM doc)
  WHERE word IN (SELECT word FROM tmpl) GROUP BY word
),
pos AS (SELECT doc_id, unnest(words) AS word, unnest(range(0, len(words))) AS i FROM doc),
own AS (
  SELECT doc_id, template, word, coalesce(df, 0) AS df
  FROM (SELECT DISTINCT doc_id, word FROM pos) JOIN (SELECT DISTINCT template, word FROM tmpl) USING (word)
    LEFT JOIN df USING (word)
),
sizes AS (SELECT template, count(DISTINCT word) AS size FROM tmpl GROUP BY template),
enough AS (
  SELECT doc_id, template FROM (SELECT doc_id, template, count(*) AS n FROM own GROUP BY ALL) JOIN sizes USING (template)
  WHERE n >= ceil({LEAST_SHARE} * size)
),
rare AS (
  SELECT doc_id, template, word FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, template ORDER BY df, word) AS r
    FROM own JOIN enough USING (doc_id, template)
  ) WHERE r <= {RARE}
),
voted AS (
  SELECT doc_id, template, word, CAST(floor((i - place) / {float(SPAN)}) AS BIGINT) AS win
  FROM rare JOIN pos USING (doc_id, word) JOIN tmpl USING (template, word)
),
vote AS (
  SELECT doc_id, template, win, count(DISTINCT word) AS c
  FROM (SELECT * FROM voted UNION ALL SELECT doc_id, template, word, win - 1 FROM voted) GROUP BY ALL
),
share AS (SELECT doc_id, template, CAST(max(c) AS DOUBLE) / {float(RARE)}::DOUBLE AS s FROM vote GROUP BY ALL),
missed AS (
  SELECT doc_id, template FROM doc, (VALUES {keys}) k(template, key)
  WHERE doc_id IN (SELECT doc_id FROM share) AND NOT contains(' ' || array_to_string(words, ' ') || ' ', key)
),
taken AS (
  SELECT doc_id, template, s FROM share s WHERE s.s >= {LEAST_SHARE}
  AND NOT EXISTS (SELECT 1 FROM missed m WHERE m.doc_id = s.doc_id AND m.template = s.template)
),
based AS (
  SELECT doc_id, label, i FROM pos JOIN (VALUES {phrases}) p(label, parts) ON word = parts[1] JOIN doc USING (doc_id)
  WHERE list_slice(words, i + 1, i + len(parts)) = parts
),
base AS (
  SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last,
    array_to_string(list_sort(list_distinct(list(label))), ',') AS labels FROM based GROUP BY doc_id
),
each_doc AS (
  SELECT doc_id, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels
  FROM (SELECT doc_id, label FROM based UNION ALL SELECT doc_id, template FROM taken) GROUP BY doc_id
),
top AS (SELECT doc_id, max(s) AS s FROM share GROUP BY doc_id),
sure AS (SELECT doc_id, max(s) AS s FROM taken GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.first AS BIGINT) AS first_word, CAST(b.last AS BIGINT) AS last_word,
  coalesce(b.labels, '') AS base_labels, coalesce(e.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1::DOUBLE WHEN sure.s > 0 THEN sure.s ELSE coalesce(top.s, 0) / 2 END AS score
FROM doc d LEFT JOIN base b USING (doc_id) LEFT JOIN each_doc e USING (doc_id)
  LEFT JOIN top USING (doc_id) LEFT JOIN sure USING (doc_id)
"""


def _draw(i: int) -> str:
    return f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS BIGINT)"


OP12 = f"""
WITH doc AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents
),
drawn AS (
  SELECT *, {_draw(0)} % (len(unit) + 1) AS a, {_draw(1)} % (len(unit) + 1) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR {_draw(2)} % 100 >= 90 THEN 'plain' WHEN {_draw(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM doc
),
cut AS (
  SELECT doc_id, len(unit) AS n, text, form,
    array_to_string(list_slice(unit, 1, least(a, b)), '') AS prefix,
    array_to_string(list_slice(unit, least(a, b) + 1, greatest(a, b)), '') AS middle,
    array_to_string(list_slice(unit, greatest(a, b) + 1, len(unit)), '') AS suffix
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": OP5,
        "op6_jaccard_join": OP6,
        "op8_license_scan": _op8(),
        "op9_warc": OP9,
        "op12_fill_in_middle": OP12,
    }
