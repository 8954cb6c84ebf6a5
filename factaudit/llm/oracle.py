"""SQL for queries of this subpackage that DuckDB can run, by brute force where the operator does not."""

from __future__ import annotations

_START = r"^(rel|has|is|its|the|with|a|relation)\s+"
_END = r"\s+(of subject|of|relation|rel|v ?\d+|\d+|as stated|per source|see question)$"
_EMPTY = r"^(relation|relations|new|custom|to|be|named|x|y|unknown|none|null|na|n|a|tbd|todo|other|misc|rel|id|field|property|attribute|value|undefined|unspecified|unnamed|temp|see|notes|has|is|of|the|\d|\s)*$"


def _spaced(c: str) -> str:
    camel = rf"regexp_replace({c}, '([a-z0-9])([A-Z])', '\1 \2', 'g')"
    return rf"trim(regexp_replace(regexp_replace(lower({camel}), '[^a-z0-9,一-鿿]+', ' ', 'g'), '\s*,\s*', ', ', 'g'), ' ')"


def _compact(c: str) -> str:
    return f"regexp_replace({c}, '[^a-z0-9一-鿿]', '', 'g')"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '{_START}', ''), '{_END}', '')"


#: Every value is compared with every reference string: right, but quadratic, unlike the operator.
P6_FOUND = rf"""
WITH rows AS (
  SELECT 'raw_candidates' AS table_name, line_number, source_snapshot.relation_raw AS v FROM raw_candidates WHERE source_snapshot.relation_raw IS NOT NULL
  UNION ALL
  SELECT 'normalized_candidates', line_number, CASE WHEN regexp_matches(trim(regexp_replace(lower(coalesce(relation_id, '')), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), '{_EMPTY}') THEN coalesce(relation_definition, '') ELSE relation_id END
  FROM normalized_candidates WHERE decision = 'ready'),
refs AS (
  SELECT DISTINCT relation_id, r, length(r) AS l, CASE WHEN regexp_matches(r, '[一-鿿]') THEN CASE WHEN length(r) >= 5 THEN 1 ELSE 0 END WHEN length(r) >= 16 THEN 6 WHEN length(r) >= 12 THEN 4 WHEN length(r) >= 9 THEN 3 WHEN length(r) >= 6 THEN 2 WHEN length(r) >= 4 THEN 1 ELSE 0 END AS k
  FROM (SELECT relation_id, {_compact(_spaced('x'))} AS r FROM (SELECT relation_id, unnest(list_concat([relation_id, label_zh, relation_definition], coalesce(examples, []))) AS x FROM relation_catalog) WHERE x IS NOT NULL) WHERE r <> ''),
pieces AS (
  SELECT v, unnest(list_distinct([v, string_split(v, ' - ')[1], string_split(v, '_-_')[1], regexp_replace(v, '[(（][^)）]*[)）]?\s*[a-zA-Z]?\s*$', ''), regexp_extract(v, '^(?:Gives|gives) the (.+) of an? ', 1),
    regexp_extract(v, '^(?:States|states), for an? [^,]+, the (.+?)\.?$', 1), regexp_extract(v, '^[^:]+: *(.+)$', 1), regexp_replace(v, '(?i)\s+of\s+the\s+[a-z]+\W*$', ''), regexp_replace(v, '[^一-鿿]+', '', 'g')])) AS piece FROM (SELECT DISTINCT v FROM rows)),
spaced AS (SELECT v, {_spaced('piece')} AS w0 FROM pieces WHERE trim(piece, ' ') <> ''),
stripped AS (SELECT v, w0, {_strip(_strip('w0'))} AS w FROM spaced),
turned AS (
  SELECT v, unnest(list_distinct([w0, w, regexp_replace(w, '^的', ''), CASE WHEN regexp_matches(w, '[a-z]s$') THEN regexp_replace(w, 's$', '') END, CASE WHEN contains(w, ',') THEN regexp_replace(w, ',.*$', '') END,
    CASE WHEN contains(w, ' of ') THEN regexp_replace(w, '^(.*) of .*$', '\1') END, CASE WHEN regexp_matches(w, '^[^,]+, [^,]+$') THEN regexp_replace(w, '^([^,]+), ([^,]+)$', '\2 \1') END,
    CASE WHEN regexp_matches(w, '^[a-z0-9 ]+? of [a-z0-9 ]+$') THEN regexp_replace(w, '^([a-z0-9 ]+?) of ([a-z0-9 ]+)$', '\2 \1') END])) AS t FROM stripped),
probes AS (SELECT DISTINCT v, {_compact('t')} AS s FROM turned WHERE t IS NOT NULL AND {_compact('t')} <> ''),
best AS (
  SELECT v, arg_min(relation_id, (edits, -l, relation_id)) AS relation_id FROM (SELECT p.v, g.relation_id, g.l, g.k, levenshtein(p.s, g.r) AS edits FROM probes p JOIN refs g ON abs(length(p.s) - g.l) <= g.k) WHERE edits <= k GROUP BY v)
SELECT table_name, line_number, coalesce(b.relation_id, 'unmatched') AS relation_id FROM rows LEFT JOIN best b ON rows.v = b.v
"""

_NAME = r"(?:the )*(?:(?:town|river|museum|company|film|mineral|species) )?(\w+ \w+)"
_TAIL = r"(?: (?:in|according to|per|as per) (?:the )*(?:\d{4}|vvalue) \w+)?"
_SHAPES = (
    rf"(?:^| )for {_NAME} (?:the )*[a-z0-9 ]+? (?:is )+\w+ as ",
    rf"(?:^| ){_NAME} has .* as its ",
    rf"^.* (?:is )+(?:the )*[a-z0-9 ]+ (?:of )+{_NAME}{_TAIL}$",
    rf"^[a-z0-9 ]+ (?:of )+{_NAME} (?:is )+",
)
_SUBJECT = "coalesce(" + ", ".join(f"nullif(regexp_extract(bare, '{x}', 1), '')" for x in _SHAPES) + ")"


def _words(c: str) -> str:
    return rf"trim(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' ')"


#: Components by recursive union: each key with every key it reaches.
P3_FOUND = f"""
WITH RECURSIVE w AS (SELECT audit_record_id, split_assignment, split_group_id, source_id, {_words('canonical_fact')} AS words, coalesce({_words('answer')}, '') AS val FROM audit_records WHERE split_assignment IS NOT NULL),
b AS (SELECT *, CASE WHEN val = '' THEN words ELSE trim(replace(' ' || words || ' ', ' ' || val || ' ', ' vvalue '), ' ') END AS bare FROM w),
k AS (SELECT *, list_filter(['0:' || split_group_id, '1:' || source_id, '2:' || {_SUBJECT}], lambda x: x IS NOT NULL) AS keys FROM b),
e AS (SELECT DISTINCT keys[1] AS src, unnest(keys) AS dst FROM k), u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e),
r(node, other) AS (SELECT src, src FROM u UNION SELECT r.node, u.dst FROM r JOIN u ON r.other = u.src),
c AS (SELECT node, min(other) AS component FROM r GROUP BY node),
p AS (SELECT k.audit_record_id, k.split_assignment, c.component FROM k JOIN c ON c.node = k.keys[1])
SELECT audit_record_id FROM p WHERE component IN (SELECT component FROM p GROUP BY component HAVING count(DISTINCT split_assignment) > 1)
"""

ORACLE = {"p3_found": P3_FOUND, "p6_found": P6_FOUND}
