"""Mapping of free-entered values to a reference list by a partition-based pigeonhole join.

A reference string of length L that may differ from a value by at most k edits is cut into k + 1
segments.  By the pigeonhole principle one of them survives unchanged in the value, near its own
position, so an equality join on (L, segment number, text) finds every candidate; the built-in
``levenshtein`` verifies it, and an anti-join reports what stays unmatched.  Everything is Spark SQL.

Only distinct values are compared.  The reference list is the small side of each join (a catalog of
relations); Spark broadcasts it only while its measured size is under the session's threshold.

Defined results: a null value gives no row of its own (``map_values``); a blank value, or one made
only of words that say nothing, is ``unmatched``; of several entries at equal distance the one whose
reference string is longest wins, then the smaller id; repeated rows are mapped alike; an empty
table gives an empty result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from factaudit.session import cut

UNMATCHED = "unmatched"

#: Edits allowed for a reference string of length L, as SQL over the column L.  Typing slips come
#: singly or in pairs and a swap of neighbours counts two edits; short strings tolerate fewer.
EDITS_SQL = "CASE WHEN L >= 16 THEN 6 WHEN L >= 12 THEN 4 WHEN L >= 9 THEN 3 WHEN L >= 6 THEN 2 WHEN L >= 4 THEN 1 ELSE 0 END"
MOST_EDITS = 6

# Words that carry no meaning in a relation name.
FILLER_START = r"^(rel|has|is|its|the|with|a|relation)\s+"
FILLER_END = r"\s+(of subject|of|relation|rel|v ?\d+|\d+|as stated|per source|see question)$"
EMPTY_WORDS = r"^(relation|relations|new|custom|to|be|named|x|y|unknown|none|null|na|n|a|tbd|todo|other|misc|rel|id|field|property|attribute|value|undefined|unspecified|unnamed|temp|see|notes|has|is|of|the|\d|\s)*$"

_CJK = r"\\u4e00-\\u9fff"


def _spaced(column: str) -> str:
    """SQL: camel case and separators become single spaces, lower case; commas stay."""
    camel = rf"regexp_replace({column}, '([a-z0-9])([A-Z])', '$1 $2')"
    return rf"trim(regexp_replace(regexp_replace(lower({camel}), '[^a-z0-9,{_CJK}]+', ' '), '\\s*,\\s*', ', '))"


def _compact(column: str) -> str:
    return rf"regexp_replace({column}, '[^a-z0-9{_CJK}]', '')"


class _Steps:
    """Runs SQL over temporary views whose names are unique to the call."""

    def __init__(self, spark: SparkSession):
        self.spark, self.tag, self.steps = spark, uuid4().hex[:10], set()

    def name(self, step: str) -> str:
        return f"vm_{step}_{self.tag}"

    def view(self, step: str, sql: str) -> DataFrame:
        df = self.spark.sql(sql)
        self.put(step, df)
        return df

    def put(self, step: str, df: DataFrame) -> None:
        df.createOrReplaceTempView(self.name(step))
        self.steps.add(step)

    def drop(self) -> None:
        """Forget the views; results are resolved and need them no more."""
        for step in self.steps:
            self.spark.catalog.dropTempView(self.name(step))


def variants_sql(source: str, column: str) -> str:
    """SQL giving (v, s): the compact spellings under which a distinct value may be listed.

    Asides are cut off, filler words at both ends stripped (twice), and turned wordings
    ("site of discovery", "navigation, year of first") put back in order.
    """
    rs = rf"""
      SELECT DISTINCT {column} AS v FROM {source} WHERE {column} IS NOT NULL"""
    pieces = rf"""
      SELECT v, explode(array_distinct(array(
        v,
        split(v, ' - ')[0],
        split(v, '_-_')[0],
        regexp_replace(v, '[(\\uff08][^)\\uff09]*[)\\uff09]?\\s*[a-zA-Z]?\\s*$', ''),
        regexp_extract(v, '^(?:Gives|gives) the (.+) of an? ', 1),
        regexp_extract(v, '^(?:States|states), for an? [^,]+, the (.+?)\\.?$', 1),
        regexp_extract(v, '^[^:]+: *(.+)$', 1),
        regexp_replace(v, '(?i)\\s+of\\s+the\\s+[a-z]+\\W*$', ''),
        regexp_replace(v, '[^{_CJK}]+', '')
      ))) AS piece FROM ({rs})"""
    spaced = f"SELECT v, {_spaced('piece')} AS w FROM ({pieces}) WHERE trim(piece) <> ''"
    strip = rf"regexp_replace(regexp_replace(w, '{FILLER_START}', ''), '{FILLER_END}', '')".replace("\\", "\\\\")
    once = f"SELECT v, {strip} AS w, w AS w0 FROM ({spaced})"
    twice = f"SELECT v, {strip} AS w, w0 FROM ({once})"
    turned = r"""
      SELECT v, explode(array_distinct(array(
        w0, w,
        regexp_replace(w, '^\\u7684', ''),
        CASE WHEN w RLIKE '[a-z]s$' THEN regexp_replace(w, 's$', '') END,
        CASE WHEN w RLIKE ',' THEN regexp_replace(w, ',.*$', '') END,
        CASE WHEN w RLIKE ' of ' THEN regexp_replace(w, ' of (?!.* of ).*$', '') END,
        CASE WHEN w RLIKE '^[^,]+, [^,]+$' THEN regexp_replace(w, '^([^,]+), ([^,]+)$', '$2 $1') END,
        CASE WHEN w RLIKE '^[a-z0-9 ]+? of [a-z0-9 ]+$' THEN regexp_replace(w, '^([a-z0-9 ]+?) of ([a-z0-9 ]+)$', '$2 $1') END
      ))) AS t FROM (""" + twice + ")"
    return f"SELECT DISTINCT v, {_compact('t')} AS s FROM ({turned}) WHERE t IS NOT NULL AND {_compact('t')} <> ''"


def closest_entries(values: DataFrame, column: str, references: DataFrame) -> DataFrame:
    """(v, entry, edits): the closest reference entry of each distinct value, where there is one.

    ``references`` has (entry, reference): an entry may be listed under several strings.
    """
    spark = values.sparkSession
    q = _Steps(spark)
    q.put("values", values)
    q.put("refs_in", references)
    q.view("refs", f"""
      SELECT DISTINCT entry, r, L, k FROM (
        SELECT entry, r, length(r) AS L FROM (
          SELECT entry, {_compact(_spaced('reference'))} AS r FROM {q.name('refs_in')} WHERE reference IS NOT NULL)
        WHERE r <> '')
      LATERAL VIEW explode(array(CASE WHEN r RLIKE '[{_CJK}]' THEN CASE WHEN L >= 5 THEN 1 ELSE 0 END ELSE {EDITS_SQL} END)) e AS k""")
    q.view("probes", variants_sql(q.name("values"), column))
    # Segment i of k + 1 starts after i * L div (k + 1) characters.
    q.view("segments", f"""
      SELECT entry, r, L, k, i, (i * L) DIV (k + 1) AS at, ((i + 1) * L) DIV (k + 1) - (i * L) DIV (k + 1) AS w,
             substring(r, CAST((i * L) DIV (k + 1) + 1 AS INT), CAST(((i + 1) * L) DIV (k + 1) - (i * L) DIV (k + 1) AS INT)) AS seg
      FROM {q.name('refs')} LATERAL VIEW explode(sequence(0, k)) e AS i""")
    # The layout of segments depends on L and k alone, so values are cut without looking at a text.
    q.view("layout", f"SELECT DISTINCT L, k, i, at, w FROM {q.name('segments')}")
    q.view("cuts", f"""
      SELECT v, s, L, k, i, substring(s, CAST(at + shift + 1 AS INT), CAST(w AS INT)) AS seg FROM (
        SELECT p.v, p.s, y.L, y.k, y.i, y.at, y.w, length(p.s) - y.L AS d
        FROM (SELECT v, s, explode(sequence(length(s) - {MOST_EDITS}, length(s) + {MOST_EDITS})) AS L FROM {q.name('probes')}) p
        JOIN {q.name('layout')} y ON p.L = y.L
        WHERE abs(length(p.s) - y.L) <= y.k)
      LATERAL VIEW explode(sequence(greatest(-i, d - (k - i), -at), least(i, d + (k - i)))) e AS shift
      WHERE greatest(-i, d - (k - i), -at) <= least(i, d + (k - i))""")
    best = q.view("best", f"""
      SELECT v, b.entry AS entry, b.edits AS edits FROM (
        SELECT v, min(struct(edits, -L AS longest, entry)) AS b FROM (
          SELECT c.v, g.entry, g.L, levenshtein(c.s, g.r, CAST(g.k AS INT)) AS edits
          FROM {q.name('cuts')} c JOIN {q.name('segments')} g
            ON c.L = g.L AND c.k = g.k AND c.i = g.i AND c.seg = g.seg)
        WHERE edits >= 0 GROUP BY v)""")
    q.drop()
    return best


def map_values(rows: DataFrame, column: str, references: DataFrame, fallback: str | None = None) -> DataFrame:
    """``rows`` with ``mapped_entry``: the entry its value names, or ``unmatched``.

    A row without a value is dropped unless ``fallback`` names a second column; that column decides
    where the value says nothing (null, blank or made of empty words only).
    """
    spark = rows.sparkSession
    q = _Steps(spark)
    if fallback is None:
        q.put("rows", rows.where(f"`{column}` IS NOT NULL").withColumn("vm_key", rows[column]))
    else:
        says_nothing = f"trim(regexp_replace(lower(coalesce(`{column}`, '')), '[^a-z0-9\\\\u4e00-\\\\u9fff]+', ' ')) RLIKE '{EMPTY_WORDS.replace(chr(92), chr(92) * 2)}'"
        q.put("raw", rows)
        q.view("rows", f"SELECT *, CASE WHEN {says_nothing} THEN coalesce(`{fallback}`, '') ELSE `{column}` END AS vm_key FROM {q.name('raw')}")
    # One row per distinct value: its entry, or the anti-join's report that it has none.
    q.put("found", closest_entries(spark.table(q.name("rows")), "vm_key", references))
    q.put("mapping", cut(q.view("mapping", f"""
      SELECT v, entry AS mapped_entry FROM {q.name('found')}
      UNION ALL
      SELECT k.v, '{UNMATCHED}' AS mapped_entry FROM (SELECT DISTINCT vm_key AS v FROM {q.name('rows')}) k LEFT ANTI JOIN {q.name('found')} f ON k.v = f.v""")))
    # A value that holds more than a thousandth of the rows stays where it is: at most a thousand do, and
    # their entries are broadcast; all others are joined by shuffle.
    q.put("hot", cut(q.view("hot", f"""
      SELECT vm_key AS h FROM (SELECT vm_key, count(*) AS n FROM {q.name('rows')} GROUP BY vm_key)
      WHERE n > greatest(1000, (SELECT count(*) FROM {q.name('rows')}) / 1000)""")))
    kept = ", ".join(f"r.`{c}`" for c in rows.columns)
    out = q.view("mapped", f"""
      SELECT /*+ BROADCAST(m) */ {kept}, m.mapped_entry FROM {q.name('rows')} r JOIN (
        SELECT /*+ BROADCAST(h) */ v, mapped_entry FROM {q.name('mapping')} JOIN {q.name('hot')} h ON v = h) m ON r.vm_key = m.v
      UNION ALL
      SELECT {kept}, m.mapped_entry FROM (
        SELECT /*+ BROADCAST(h) */ r.* FROM {q.name('rows')} r LEFT ANTI JOIN {q.name('hot')} h ON r.vm_key = h.h) r
      JOIN {q.name('mapping')} m ON r.vm_key = m.v""")
    q.drop()
    return out


def relation_references(catalog: DataFrame) -> DataFrame:
    """(entry, reference) of the relation catalog: id, wordings, Chinese label and definition."""
    return catalog.selectExpr(
        "relation_id AS entry",
        "explode(concat(array(relation_id, label_zh, relation_definition), coalesce(examples, array()))) AS reference",
    )
