"""License scans by ordered signature rules.

Texts that hold no license keyword at all leave at a cheap gate. The others are
turned into lower-case words; of the rules, those whose own keyword occurs are
tried, and their places become word intervals. A detection inside another one of
higher priority (or of the same priority and greater length) is suppressed. Four
base phrases are reported wherever their words stand consecutively. Main path:
DataFrame and SQL functions only; no shuffle.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_columns, table
from .signatures import Rule, rules

#: Lower-cased, a word is a run of digits, letters a to z and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE: dict[str, str] = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
RULES = rules()
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


#: Every rule's matches and every base phrase hold one of these, or one of GATE_PHRASES.
GATE = (
    "licen", "gpl", "apache", "cc0", "commons", "domain", "reserved", "rail", "0bsd", "attribution", "copyright", "llama", "gemma", "fuck",
    "perl", "mozilla", "merchantab", "commercial", "research", "secret", "wtfpl", "tivoization", "government", "confidential", "procurement", "negligence", "copyleft",
    "invariant", "exception", "redistribut", "eclipse", "notices", "scripts", "endorse", "software", "definitions", "derivative", "odc",
    "additional", "unauthorized", "reproduced", "material", "consortium",
)
#: A substring that common words hold by chance, and the phrase, with any gaps, that must follow it up.
GATE_PHRASES = {"cc": "cc by", "mpl": "the mpl was not", "beer": "me a beer"}


def gate(text: Column) -> Column:
    """Whether a raw text can hold a base phrase or a rule's match: plain substring searches, and phrases with any gaps behind such searches.

    Lower-casing beyond ASCII can only add candidates.
    """
    low = F.lower(text)
    plain = [F.contains(low, F.lit(w)) for w in GATE]
    phrases = [F.contains(low, F.lit(w)) & text.rlike("(?i)" + p.replace(" ", _GAP)) for w, p in GATE_PHRASES.items()]
    return reduce(lambda x, y: x | y, plain + phrases)


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The columns ``keep``, then n_words long, base array<struct<label, at>>, found array<struct<start, end, priority, label, rule>>.

    Places count words from 0; end is exclusive. found holds what suppression
    leaves, in order of place. Null counts as empty: no words, nothing found. Rows
    that repeat are scanned each; an empty table gives an empty result; of ``keep``,
    columns named like a result are left out.
    """
    keep = kept_columns(keep or ["doc_id"], ["n_words", "base", "found"])
    own = [F.col(f"`{c}`") for c in keep]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    gated = docs.select(
        *own,
        F.size(F.array_remove(F.split(text, _GAP), "")).cast("long").alias("_quillon_n"),
        F.when(gate(text), F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))).alias("_quillon_w"),
    )
    words, line = F.col("_quillon_w"), F.col("_quillon_s")
    joined = gated.select(*own, "_quillon_n", words, F.when(words.isNotNull(), F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).alias("_quillon_s"))

    def places(phrase: str, label: str) -> Column:
        parts = phrase.split()
        same = lambda i: reduce(lambda x, y: x & y, [F.get(words, i + k) == p for k, p in enumerate(parts)])
        starts = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), same)
        return F.when(F.size(words) >= len(parts), F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.cast("long").alias("at")))).otherwise(F.array().cast(_BASE))

    base = F.when(words.isNotNull(), F.flatten(F.array(*(places(p, b) for p, b in BASE.items()))))
    levels = sorted({r.priority for r in rules})
    listed = [{"rule": i, "label": r.label, "level": levels.index(r.priority), "keyword": r.keyword, "pattern": r.pattern} for i, r in enumerate(rules)]
    table_of_rules = F.from_json(F.lit(json.dumps(listed)), "array<struct<rule:int,label:string,level:int,keyword:string,pattern:string>>")  # folded to a constant
    tried = joined.select(*own, "_quillon_n", base.alias("_quillon_b"), line, F.when(line.isNotNull(), F.filter(table_of_rules, lambda r: F.contains(line, r["keyword"]))).alias("_quillon_r"))
    count = lambda s: F.size(F.array_remove(F.split(s, " "), "")).cast("long")

    def intervals(r: Column) -> Column:
        """Word intervals of a rule's matches: the words of what lies before each, added up."""
        found = F.regexp_extract_all(line, r["pattern"], F.lit(0))
        sized = F.zip_with(F.slice(F.split(line, r["pattern"], -1), 1, F.size(found)), found, lambda p, m: F.struct(count(p).alias("before"), count(m).alias("size")))
        end = lambda at, x: at + x["before"] + x["size"]
        spans = _scan(sized, F.lit(0).cast("long"), end, lambda at, x: F.struct((at + x["before"]).alias("start"), end(at, x).alias("end")), "struct<start:bigint,end:bigint>")
        return F.when(F.size(found) > 0, F.transform(spans, lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("less"), (-r["level"]).alias("below"), r["rule"].alias("rule")))).otherwise(F.array().cast(_ORDERED))

    # of two detections the one that can hold the other comes first: smaller start, larger end, higher level, earlier rule
    ordered = tried.select(*own, "_quillon_n", "_quillon_b", F.array_sort(F.coalesce(F.flatten(F.transform("_quillon_r", intervals)).cast(_ORDERED), F.array().cast(_ORDERED))).alias("_quillon_d"))

    # one sweep: of each level, how far detections of it or a higher one have reached
    reached = F.array_repeat(F.lit(-1).cast("long"), len(levels))
    reach = lambda far, d: F.transform(far, lambda e, k: F.when(k <= -d["below"], F.greatest(e, -d["less"])).otherwise(e))
    left = _scan(F.col("_quillon_d"), reached, reach, lambda far, d: F.when(F.get(far, -d["below"]) < -d["less"], d), _ORDERED[6:-1])
    by_rule = F.from_json(F.lit(json.dumps([{"priority": r.priority, "label": r.label} for r in rules])), "array<struct<priority:int,label:string>>")
    shown = F.transform(
        F.filter(left, lambda d: d.isNotNull()),
        lambda d: F.struct(d["start"].alias("start"), (-d["less"]).alias("end"), F.get(by_rule, d["rule"])["priority"].alias("priority"), F.get(by_rule, d["rule"])["label"].alias("label"), d["rule"].alias("rule")),
    )
    return ordered.select(*own, F.col("_quillon_n").alias("n_words"), F.coalesce("_quillon_b", F.array().cast(_BASE)).alias("base"), F.array_sort(shown).alias("found"))


_BASE = "array<struct<label:string,at:bigint>>"
_ORDERED = "array<struct<start:bigint,less:bigint,below:int,rule:int>>"
#: Results gathered before they are put away, so that a long fold doesn't copy all of them at each step.
_CHUNK = 64


def _scan(items: Column, start: Column, step: Callable[[Column, Column], Column], result: Callable[[Column, Column], Column], kind: str) -> Column:
    """Of each item, in order, the result by the state before it; ``step`` leads from state to state. In linear time."""
    some = lambda k: F.array().cast(k)
    first = F.struct(start.alias("at"), some(f"array<{kind}>").alias("now"), some(f"array<array<{kind}>>").alias("put"))

    def fold(acc: Column, x: Column) -> Column:
        full = F.size(acc["now"]) >= _CHUNK
        now = F.when(full, some(f"array<{kind}>")).otherwise(acc["now"])
        return F.struct(
            step(acc["at"], x).alias("at"),
            F.array_append(now, result(acc["at"], x).cast(kind)).cast(f"array<{kind}>").alias("now"),
            F.when(full, F.array_append(acc["put"], acc["now"])).otherwise(acc["put"]).cast(f"array<array<{kind}>>").alias("put"),
        )

    return F.aggregate(items, first, fold, lambda acc: F.concat(F.flatten(acc["put"]), acc["now"]))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of every document: doc_id, n_words, n_base, first_word, last_word long, base_labels, labels string, score double.

    Null and empty texts have no words, labels or places and score 0; repeated rows are
    scanned each; an empty table gives an empty result; other columns are not read.
    """
    scanned = scan(table(spark, sf_dir, "documents"))
    at = F.transform("base", lambda b: b["at"])
    names = lambda column: F.transform(column, lambda x: x["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(names("base")).alias("base_labels"),
        joined(F.concat(names("base"), names("found"))).alias("labels"),
        F.greatest(F.when(F.size("base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("found", lambda x: x["priority"])) / 100.0, F.lit(0.0))).alias("score"),
    )


def _op2_sql() -> str:
    """The same by joins: every rule against every text, word places by running sums, suppression by NOT EXISTS.

    Words stand between two spaces here, so that matches side by side don't share one.
    """
    quote = lambda t: "'" + t.replace("'", "''") + "'"
    spaced = lambda p: " " + p.removeprefix("(?<= )").removesuffix("(?= )").replace(" ?", "(?:@)?").replace(" ", "  ").replace("@", "  ") + " "
    listed = ", ".join(f"({n}, {quote(r.label)}, {r.priority}, {quote(r.keyword)}, {quote(spaced(r.pattern))})" for n, r in enumerate(RULES))
    bases = " UNION ALL ".join(
        f"SELECT rid, {quote(label)} AS label, unnest(list_filter(range(0, len(ws) - {len(p.split()) - 1}), lambda i: "
        + " AND ".join(f"ws[i + {k + 1}] = {quote(w)}" for k, w in enumerate(p.split()))
        + ")) AS place FROM w"
        for p, label in BASE.items()
    )
    count = "len(list_filter(string_split({0}, ' '), lambda v: v <> ''))"
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
), w AS (
  SELECT rid, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM d
), s AS (
  SELECT rid, ' ' || array_to_string(ws, ' ') || ' ' AS line, ' ' || array_to_string(ws, '  ') || ' ' AS wide FROM w
), base AS ({bases}), rules AS (
  SELECT * FROM (VALUES {listed}) AS r(rule, label, priority, keyword, pattern)
), tried AS (
  SELECT rid, rule, label, priority, wide, pattern FROM s JOIN rules ON contains(line, keyword)
), hit AS (
  SELECT rid, rule, label, priority, regexp_extract_all(wide, pattern) AS m, regexp_split_to_array(wide, pattern) AS pieces FROM tried WHERE regexp_matches(wide, pattern)
), one AS (
  SELECT rid, rule, label, priority, unnest(m) AS x, unnest(pieces[1:len(m)]) AS before, unnest(range(1, len(m) + 1)) AS k FROM hit
), placed AS (
  SELECT rid, rule, label, priority, {count.format("x")} AS size, sum({count.format("before")} + {count.format("x")}) OVER (PARTITION BY rid, rule ORDER BY k) AS e FROM one
), spans AS (
  SELECT rid, rule, label, priority, e - size AS s, e FROM placed
), found AS (
  SELECT * FROM spans AS d WHERE NOT EXISTS (
    SELECT 1 FROM spans AS o WHERE o.rid = d.rid AND o.s <= d.s AND o.e >= d.e
    AND (o.priority > d.priority OR (o.priority = d.priority AND (o.e - o.s > d.e - d.s OR (o.e - o.s = d.e - d.s AND o.rule < d.rule)))))
), by_base AS (
  SELECT rid, count(*) AS n, min(place) AS low, max(place) AS high, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM base GROUP BY rid
), every AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM base UNION ALL SELECT rid, label FROM found) GROUP BY rid
), top AS (
  SELECT rid, max(priority) AS priority FROM found GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base, CAST(b.low AS BIGINT) AS first_word, CAST(b.high AS BIGINT) AS last_word,
       coalesce(b.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
       greatest(CASE WHEN b.n > 0 THEN 0.5 ELSE 0.0 END, coalesce(t.priority, 0) / 100.0)::DOUBLE AS score
FROM w LEFT JOIN by_base AS b USING (rid) LEFT JOIN every AS a USING (rid) LEFT JOIN top AS t USING (rid)"""


OP2_SQL = _op2_sql()
