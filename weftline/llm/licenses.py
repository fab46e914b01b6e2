"""License scans by ordered signature rules, in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.arrays import let, maxima, sums
from weftline.llm.cluster import ascii_lower
from weftline.llm.license_rules import BASE, RULES

#: What stands between words of a text in lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Every rule's words hold one of these, so that a text without any is passed over at once.
GATE = ("licen", "gpl", "spdx", "copyright", "reserved", "domain", "permission", "redistribut", "bsd", "mozilla", "apache", "creative", "cc0", "wtfpl", "eclipse", "cecill", "openssl", "perl", "proprietary", "unauthorized", "commercial", "llama", "rail", "misrepresented", "evil", "beer", "advertising", "attribution", "endorse", "gcc", "classpath", "latex", "boost", "gnu")
#: Last, what takes more than one word to tell.
CC = r"cc[\x00-\x2F\x3A-\x60\x7B-\x7F]+by[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def rules() -> list[dict]:
    """All rules in order, the base phrases last; spaces are doubled, so that neighbours share none of them."""
    found = []
    for rank, line in enumerate(RULES):
        label, weight, keyword, pattern = (x.strip() for x in line.split(";", 3))
        found.append({"rank": rank, "label": label, "weight": float(weight), "keyword": keyword, "pattern": " (?:" + pattern.replace(" ?", "(?: )?").replace(" ", "  ") + ") ", "base": False})
    for label, phrase in BASE:
        found.append({"rank": len(found), "label": label, "weight": 0.9, "keyword": phrase.split()[0] if phrase.split()[0] != "under" else "license", "pattern": " " + phrase.replace(" ", "  ") + " ", "base": True})
    return found


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


EMPTY = "cast(array() as array<struct<first:int,minus_last:int,rank:int,label:string,weight:double,base:boolean>>)"


def _matched(norm: str) -> Column:
    """Each rule whose keyword and pattern occur in the column norm, with its matches and the text between them.

    As one text of SQL, since a call for each part of each rule takes its time on the driver.
    """
    quoted = lambda text: "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
    spaces = "x -> length(x) - length(replace(x, ' ', ''))"
    parts = []
    for r in rules():
        pattern = quoted(r["pattern"])
        told = f"'rank', {r['rank']}, 'label', {quoted(r['label'])}, 'weight', {r['weight']}D, 'base', {str(r['base']).lower()}"
        found = f"'hits', transform(regexp_extract_all(`{norm}`, {pattern}, 0), {spaces}), 'rest', transform(split(`{norm}`, {pattern}, -1), {spaces})"
        parts.append(f"case when contains(`{norm}`, {quoted(r['keyword'])}) and rlike(`{norm}`, {pattern}) then named_struct({told}, {found}) end")
    return F.expr(f"array_compact(array({', '.join(parts)}))")


def _places(rule: Column) -> Column:
    """A rule's matches, as structs with their first and last word."""
    steps = F.zip_with(rule["hits"], F.slice(rule["rest"], 1, F.size(rule["hits"])), lambda h, r: (h + r).cast("long"))

    def place(hit: Column, upto: Column) -> Column:
        first = F.floor((upto - hit - 1) / 2).cast("int")
        words = F.floor(hit / 2).cast("int")
        return F.struct(first.alias("first"), (-(first + words - 1)).alias("minus_last"), *(rule[k].alias(k) for k in ("rank", "label", "weight", "base")))

    return let(sums(steps), lambda upto: F.zip_with(rule["hits"], upto, place))


def _kept(places: Column) -> Column:
    """Sorted places without those inside an earlier one: that begins no later and ends no earlier, or has the same words and a rule before."""
    last = lambda p: -p["minus_last"]
    furthest = maxima(F.transform(places, lambda p: last(p).cast("long")))
    return let(furthest, lambda f: F.filter(places, lambda p, i: (i == 0) | (last(p) > F.get(f, i - 1))))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with license_words (of the whole text), license_places and license_found.

    Places are all matches of all rules, license_found those that stay: a place inside another goes, and of
    places with the same words the rule of higher priority stays. Both are sorted arrays of (first, minus_last,
    rank, label, weight, base), words counted from 0. Null texts are empty and have neither words nor places;
    all rows and columns stay, and columns of these three names are replaced.

    Plan: no exchange. A text without any of GATE's strings costs a count of its words; of the others, each rule
    whose keyword occurs is matched. The work is linear in a text's matches, but for what `running` says.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    low = F.lower(text)
    gate = F.lit(False)
    for stem in GATE:
        gate = gate | F.contains(low, F.lit(stem))
    gate = gate | (F.contains(low, F.lit("cc")) & F.rlike(low, F.lit(CC)))
    doubled = F.replace(F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(text), BETWEEN, " ")), F.lit(" ")), F.lit(" "), F.lit("  "))
    norm = "license_norm"
    while norm in docs.columns:
        norm += "_"
    rows = docs.withColumns({"license_words": F.regexp_count(text, F.lit(WORD)).cast("long"), norm: F.when(gate, doubled)})
    places = F.array_sort(F.flatten(F.transform(_matched(norm), _places)))
    rows = rows.withColumn("license_places", F.when(F.col(norm).isNotNull(), places).otherwise(F.expr(EMPTY))).drop(norm)
    return rows.withColumn("license_found", _kept(F.col("license_places")))


def joined_labels(places: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")


def digest(scanned_docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of scanned(): counts, base places and labels, and the score of the surest place."""
    base = F.filter("license_places", lambda p: p["base"])
    both = F.concat(base, F.col("license_found"))
    return scanned_docs.withColumn("base", base).select(
        id_col,
        F.col("license_words").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("base", lambda p: p["first"])).cast("long").alias("last_word"),
        joined_labels(F.col("base")).alias("base_labels"),
        joined_labels(both).alias("labels"),
        F.coalesce(F.array_max(F.transform(both, lambda p: p["weight"])), F.lit(0.0)).alias("score"),
    )


def sql() -> str:
    """The same over a table documents, for DuckDB."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    values = ",\n".join(f"({r['rank']}, {quoted(r['label'])}, {r['weight']}, {quoted(r['keyword'])}, {quoted(r['pattern'])}, {r['base']})" for r in rules())
    return rf"""
with rules(rank, label, weight, keyword, pattern, base) as (values {values}),
d as (select row_number() over () as row_id, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low from documents),
n as (select row_id, doc_id, len(regexp_extract_all(low, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as n_words,
  replace(' ' || trim(regexp_replace(low, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') || ' ', ' ', '  ') as norm from d),
m as (select row_id, rank, label, weight, base, regexp_extract_all(norm, pattern) as hits, string_split_regex(norm, pattern) as rest from n join rules on contains(norm, keyword)),
s as (select *, [length(x) - length(replace(x, ' ', '')) for x in hits] as hit_spaces, [length(x) - length(replace(x, ' ', '')) for x in rest] as rest_spaces from m where len(hits) > 0),
p as (select row_id, rank, label, weight, base, unnest(range(1, len(hits) + 1)) as i, hit_spaces, rest_spaces from s),
q as (select row_id, rank, label, weight, base, (list_sum(rest_spaces[:i]) + coalesce(list_sum(hit_spaces[:i - 1]), 0) - 1) // 2 as first, hit_spaces[i] // 2 as words from p),
k as (select *, coalesce(max(first + words) over (partition by row_id order by first, first + words desc, rank rows between unbounded preceding and 1 preceding), 0) as before from q),
g as (select row_id, count(*) filter (where base) as n_base, min(first) filter (where base) as first_word, max(first) filter (where base) as last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (where base), '') as base_labels,
  coalesce(string_agg(distinct label, ',' order by label) filter (where base or first + words > before), '') as labels,
  max(weight) filter (where base or first + words > before) as score from k group by row_id)
select doc_id, cast(n_words as bigint) as n_words, cast(coalesce(n_base, 0) as bigint) as n_base, cast(first_word as bigint) as first_word, cast(last_word as bigint) as last_word,
  coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(score, 0) as double) as score from n left join g using (row_id)
"""
