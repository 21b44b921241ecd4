"""Repeated line runs, grouped by the hashes of their shortest blocks; later copies are deleted. DataFrame functions only.

A document is the sequence of its lines that hold a word. No suffix of the corpus is ranked: within each row the names of
blocks of 1, 2, 4, ... lines are hashed from the names of their halves, and two overlapping names give that of a block of
any length. Names depend on content alone, so no shuffle is needed to make them.

A run counts from `min_words` words on. For each line there is one shortest such block that starts there and one that
ends there; every maximal repeated run with enough words is the union of those of them that lie in it. So it is enough
to group these two blocks per line by name: all but the first occurrence (by doc_id, then text, then line) are later
copies. Their lines are deleted, with blank lines between them. A block never has more than `min_words` lines, as each
holds a word, which bounds the doubling. With `min_words` 1 every repeated line with a word is found.

Null text stays null and rows with a null doc_id are returned as they are. Rows that repeat a doc_id with other texts are
documents of their own; exact repetitions of a row count as one document and are no later copies. An empty table gives
an empty table. The work on a document grows with its lines. `remove_repeats` keeps all further columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from featmatrix.llm.common import durable

WORD = r"[^\x20\x09-\x0D]+"


def _key() -> Column:
    """Tells texts of one doc_id apart."""
    return F.unhex(F.md5("text"))


def _blocks(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, key, name, first, last): shortest blocks with enough words, by the original line numbers."""
    levels = max(1, min_words).bit_length()
    rows = docs.where("doc_id is not null and text is not null")
    rows = rows.select("doc_id", _key().alias("key"), F.split("text", "\n").alias("lines"))
    rows = rows.select(
        "doc_id",
        "key",
        F.filter(
            F.transform("lines", lambda x, i: F.struct(i.alias("at"), F.regexp_count(x, F.lit(WORD)).alias("w"), F.unhex(F.md5(x)).alias("id"))),
            lambda x: x["w"] > 0,
        ).alias("l"),
    ).where(F.size("l") > 0)
    rows = rows.select(
        "doc_id",
        "key",
        F.transform("l", lambda x: x["at"]).alias("at"),
        F.transform("l", lambda x: x["id"]).alias("n0"),
        F.transform("l", lambda x: F.least(x["w"], F.lit(min_words))).alias("f0"),
        F.reverse(F.transform("l", lambda x: F.least(x["w"], F.lit(min_words)))).alias("b0"),
    )
    for j in range(1, levels):
        half = 1 << (j - 1)
        rows = rows.withColumns(
            {
                f"n{j}": F.transform(f"n{j - 1}", lambda x, i: F.unhex(F.md5(F.concat(x, F.get(F.col(f"n{j - 1}"), i + half))))),
                f"f{j}": F.transform(f"f{j - 1}", lambda x, i: x + F.coalesce(F.get(F.col(f"f{j - 1}"), i + half), F.lit(0))),
                f"b{j}": F.transform(f"b{j - 1}", lambda x, i: x + F.coalesce(F.get(F.col(f"b{j - 1}"), i + half), F.lit(0))),
            }
        )

    def grown(state: str, words: str, j: int) -> Column:
        """Extend each block by 2^j lines if it still lacks words then."""

        def step(x: Column, i: Column) -> Column:
            total = x["s"] + F.coalesce(F.get(F.col(f"{words}{j}"), i + x["h"]), F.lit(0))
            return F.when(total < min_words, F.struct((x["h"] + (1 << j)).alias("h"), total.alias("s"))).otherwise(x)

        return F.transform(state, step)

    zero = F.struct(F.lit(0).alias("h"), F.lit(0).alias("s"))
    rows = rows.withColumns({"fs": F.transform("at", lambda _: zero), "bs": F.transform("at", lambda _: zero)})
    for j in reversed(range(levels)):
        rows = rows.withColumns({"fs": grown("fs", "f", j), "bs": grown("bs", "b", j)})

    size = F.size("at")
    names = F.array(*[F.col(f"n{j}") for j in range(levels)])

    def block(start: Column, length: Column) -> Column:
        level = F.floor(F.log2(length.cast("double") + 0.5)).cast("int")
        own = F.get(names, level)
        other = start + length - F.pow(F.lit(2.0), level).cast("int")
        inside = (start >= 0) & (start + length <= size)
        return F.when(
            inside,
            F.struct(
                F.unhex(F.md5(F.concat(F.get(own, start), F.get(own, other), length.cast("string").cast("binary")))).alias("name"),
                F.get(F.col("at"), start).alias("first"),
                F.get(F.col("at"), start + length - 1).alias("last"),
            ),
        )

    forward = F.transform("fs", lambda x, i: block(i, x["h"] + 1))
    backward = F.transform("bs", lambda x, i: block(size - 1 - i - x["h"], x["h"] + 1))
    found = F.array_distinct(F.filter(F.concat(forward, backward), lambda x: x.isNotNull()))
    return rows.select("doc_id", "key", F.explode(found).alias("b")).select("doc_id", "key", "b.name", "b.first", "b.last")


def later_copies(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, key, runs): the line ranges of each document that repeat an earlier run, as maximal ranges in order."""
    blocks = durable(_blocks(docs, min_words))  # used twice; far smaller than the texts
    here = F.struct("doc_id", "key", "first")
    firsts = blocks.groupBy("name").agg(F.min(here).alias("origin"), F.count("*").alias("n")).where("n > 1").drop("n")
    hits = blocks.join(firsts, "name").where(here > F.col("origin")).select("doc_id", "key", "first", "last").distinct()
    # join overlapping and touching ranges; a document's ranges are at most two per line
    own = Window.partitionBy("doc_id", "key").orderBy("first", "last")
    before = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    hits = hits.withColumn("_new", F.when(F.col("first") <= before + 1, 0).otherwise(1))
    hits = hits.withColumn("_run", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = hits.groupBy("doc_id", "key", "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("doc_id", "key").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _marked(docs: DataFrame, min_words: int) -> DataFrame:
    """The documents with `_kept`, `_lost` and `_runs`."""
    runs = later_copies(docs.select("doc_id", "text"), min_words).withColumnsRenamed({"doc_id": "_id", "key": "_key", "runs": "_runs"})
    lines = F.split("text", "\n")

    def between(i: Column) -> Column:
        """The lines after the run before and before run `i`."""
        start = F.coalesce(F.get(F.col("_runs"), i - 1)["last"] + 1, F.lit(0))
        end = F.coalesce(F.get(F.col("_runs"), i)["first"], F.size("_lines"))
        return F.slice("_lines", start + 1, end - start)

    same = (F.col("doc_id") == F.col("_id")) & (_key() == F.col("_key"))
    joined = docs.join(runs, same, "left").drop("_id", "_key").withColumn("_lines", F.when(F.col("_runs").isNotNull(), lines))
    left = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_runs")), between))
    kept = F.when(F.col("_runs").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    lost = F.coalesce(F.aggregate("_runs", F.lit(0), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0))
    return joined.withColumns({"_kept": kept, "_lost": lost}).drop("_lines")


def remove_repeats(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """The documents without later copies; a document of which nothing with a word is left goes. Columns stay."""
    left = F.col("_lost") == 0
    return (
        _marked(docs, min_words)
        .where(left | F.col("_kept").rlike(WORD))
        .select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    )


def line_report(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, kept_sha256) of every document; null text has no lines."""
    marked = _marked(docs.select("doc_id", "text"), min_words)
    return marked.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
        F.col("_lost").cast("long").alias("n_removed"),
        F.when(F.col("_runs").isNull(), 0).otherwise(F.size("_runs")).cast("long").alias("n_runs"),
        F.sha2(F.coalesce("_kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


#: The report in DuckDB SQL: blocks as texts, shortest first, with plain joins.
ORACLE = r"""
with pieces as (
  select doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos, unnest(string_split(text, chr(10))) as line
  from documents where doc_id is not null and text is not null),
l as (
  select doc_id, pos, line, least(50, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as w,
    row_number() over (partition by doc_id order by pos) as i
  from pieces where regexp_matches(line, '[^\x20\x09-\x0D]')),
c as (select *, sum(w) over (partition by doc_id order by i) as upto from l),
spans as (
  select a.doc_id, a.i as s, min(b.i) as e from c a join c b on a.doc_id = b.doc_id and b.i between a.i and a.i + 50
  where b.upto - a.upto + a.w >= 50 group by all
  union
  select b.doc_id, max(a.i) as s, b.i as e from c a join c b on a.doc_id = b.doc_id and b.i between a.i and a.i + 50
  where b.upto - a.upto + a.w >= 50 group by b.doc_id, b.i),
blocks as (
  select p.doc_id, p.s, p.e, min(c.pos) as first, max(c.pos) as last, string_agg(c.line, chr(10) order by c.i) as body
  from spans p join c on c.doc_id = p.doc_id and c.i between p.s and p.e group by all),
ranked as (select *, min((doc_id, first)) over (partition by body) as origin from blocks),
hits as (select distinct doc_id, first, last from ranked where (doc_id, first) > origin),
gone as (select distinct doc_id, unnest(range(first, last + 1)) as pos from hits),
runs as (
  select doc_id, count(*) as n_removed, sum(case when before is null or before < pos - 1 then 1 else 0 end) as n_runs
  from (select *, lag(pos) over (partition by doc_id order by pos) as before from gone) group by doc_id),
left_over as (
  select p.doc_id, count(*) as n_lines, coalesce(string_agg(p.line, chr(10) order by p.pos) filter (where g.pos is null), '') as kept
  from pieces p left join gone g on g.doc_id = p.doc_id and g.pos = p.pos group by p.doc_id)
select d.doc_id, coalesce(o.n_lines, 0)::bigint as n_lines, coalesce(r.n_removed, 0)::bigint as n_removed,
  coalesce(r.n_runs, 0)::bigint as n_runs, sha256(coalesce(o.kept, '')) as kept_sha256
from documents d left join left_over o using (doc_id) left join runs r using (doc_id)
"""
