"""Operator 4, quality rules: per-document rules and the frequency of lines across documents.

Everything here is DataFrame functions; nothing runs in Python on an executor.

The cross-document rule: each line with a word is normalised (A-Z lower-cased, runs of white space
one space) and hashed; for each host the *distinct documents* that hold the line are counted. A
document is known by the hash of all its normalised lines in order, so that copies count once and a
document isn't rejected for having been copied; near copies are documents of their own.
Lines of more than ``max_docs`` distinct documents of a host count as removed, and
``quality_clean`` takes them out of the texts; a document that loses more than ``max_removed`` per
cent of its words is depleted and rejected.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own;
repeated rows are rows of their own with the same results; other columns don't matter, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import LOWER, UPPER, WHITE, ascii_lower, table, unused, written

#: Production parameters.
MAX_DOCS, MAX_REMOVED, MIN_WORDS, MAX_REPEAT = 30, 70, 10, 20
SYMBOLS = "#*$%&|<>"


def _once(value: Column, f) -> Column:
    """f of the value, which is computed once however often f uses it."""
    return F.transform(F.array(value), f)[0]


def _repeat_words(words: Column, n: Column, size: int = 5) -> Column:
    """Words in windows of `size` words that occur twice or more. Windows are hashed once; only a text
    that has an equal pair of them has its windows sorted."""

    def covered(hashes: Column) -> Column:
        again = lambda s, x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))
        starts = _once(F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: F.array_sort(F.transform(F.filter(s, lambda x, i: again(s, x, i)), lambda x: x["i"])))
        return _once(starts, lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1) - x, F.lit(size)))), F.lit(0).cast("bigint"), lambda a, x: a + x))

    none = F.lit(0).cast("bigint")
    hashes = F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.xxhash64(F.slice(words, i + 1, size)))
    return F.when(n < size, none).otherwise(_once(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(covered(h))))


def _normal(line: Column) -> Column:
    """The line as it is compared: trimmed, A-Z lower-cased, runs of white space one space."""
    return F.regexp_replace(ascii_lower(F.btrim(line, F.lit(WHITE))), r"[\x20\x09-\x0D]+", " ")


def _hash(normal: Column) -> Column:
    return F.substring(F.md5(normal), 1, 16)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per document: _id, _host, the base counts, and _lines: hash and words of each line."""
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{host_col}`").cast("string").alias("_host"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"))
    d = d.select(
        "_id", "_host", "_t",
        F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_l"),
    )
    lines = F.transform("_l", _normal)
    return d.select(
        "_id", "_host", F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", WHITE, "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_w"), F.size("_w")).alias("n_repeat_words"),
        F.transform(lines, lambda x: F.struct(_hash(x).alias("h"), F.size(F.split(x, " ")).alias("w"))).alias("_lines"),
    )


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = MAX_DOCS, max_removed: int = MAX_REMOVED, gone: bool = False) -> DataFrame:
    """One row per row of docs: the id, _host, the counts, removed_words, base_failed, kept, and where
    `gone` says so _gone, the hashes of the lines to remove (null: none).

    The text is read once, into a written table of counts and line hashes; the counts by host and
    line are aggregated before they are shuffled, so that a line of a third of all documents and a
    host of a third of all rows are as cheap as any other."""
    m = written(measured(docs, id_col, text_col, host_col).withColumn("_row", F.monotonically_increasing_id()), "quality")
    whole = _hash(F.concat_ws(",", F.transform("_lines", lambda x: x["h"])))
    lines = m.select("_row", "_host", whole.alias("_as"), F.explode("_lines").alias("_x")).select("_row", "_host", F.col("_x.h").alias("_h"), F.col("_x.w").alias("_n"), "_as")
    often = lines.select("_host", "_h", "_as").distinct().groupBy("_host", "_h").count().where(F.col("count") > max_docs).select(F.col("_host").alias("_oh"), F.col("_h").alias("_ol"))
    lost = lines.join(often, F.col("_host").eqNullSafe(F.col("_oh")) & (F.col("_h") == F.col("_ol")), "left_semi").groupBy("_row").agg(F.sum("_n").cast("bigint").alias("removed_words"), *([F.collect_set("_h").alias("_gone")] if gone else []))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    out = m.join(lost, "_row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("bigint"))).withColumn("base_failed", failed)
    return out.select(F.col("_id").alias(id_col), "_host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (100 * F.col("removed_words") <= max_removed * F.col("n_words"))).alias("kept"), "removed_words", *(["_gone"] if gone else []))


def _judged(docs: DataFrame, id_col: str, text_col: str, host_col: str, **limits) -> tuple[Column, DataFrame]:
    """The key of a row of docs (rows with one id but different texts are judged each for itself), and
    the rules' results by that key."""
    key = F.struct(F.col(id_col).alias("a"), F.col(host_col).cast("string").alias("b"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    keyed = docs.select(F.col(text_col).alias("_text"), key.alias("_key"), F.col(host_col).alias("_src"))
    return key, quality_rules(keyed, id_col="_key", text_col="_text", host_col="_src", **limits)


def quality_filter(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """docs without the rows that the rules reject, all columns as they are."""
    key, judged = _judged(docs, id_col, text_col, host_col, **limits)
    name = unused(docs, "_rejected")
    out = judged.where(~F.col("kept")).select(F.col("_key").alias(name)).distinct()
    return docs.join(out, key.eqNullSafe(F.col(name)), "left_anti")


def quality_clean(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits) -> DataFrame:
    """docs without the rows that the rules reject and, in the texts that stay, without the lines of more
    than max_docs distinct documents of the host; other lines, blank ones too, and columns stay as they are."""
    key, judged = _judged(docs, id_col, text_col, host_col, gone=True, **limits)
    out = judged.where(~F.col("kept") | F.col("_gone").isNotNull()).groupBy(F.col("_key").alias("_judged")).agg(F.first("kept").alias("_kept"), F.first("_gone").alias("_gone"))
    both = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), key.alias("_key")).join(out, F.col("_key").eqNullSafe(F.col("_judged")), "left").where(F.coalesce("_kept", F.lit(True)))
    text = F.col(f"_doc.`{text_col}`")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("_gone", _hash(_normal(x)))), "\n")
    return both.select(*[(F.when(F.col("_gone").isNull(), text).otherwise(left) if c == text_col else F.col(f"_doc.`{c}`")).alias(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("_host")


SQL = rf"""
with d as (select row_number() over () as r, doc_id, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
g as (select r, i, ws[i:i + 4] as k from w, unnest(range(1, len(ws) - 3)) as u(i)),
g2 as (select r, i from (select r, i, count(*) over (partition by r, k) as c from g) where c > 1),
rep as (select r, sum(least(5, coalesce(nx - i, 5))) as n from (select r, i, lead(i) over (partition by r order by i) as nx from g2) group by r),
l as (select r, source, k, translate(regexp_replace(trim(ls[k], concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '[\x20\x09-\x0D]+', ' ', 'g'), '{UPPER}', '{LOWER}') as x from w, unnest(range(1, len(ls) + 1)) as u(k)),
whole as (select r, string_agg(x, chr(10) order by k) as whole from l group by r),
often as (select source, x from l join whole using (r) group by 1, 2 having count(distinct whole) > {MAX_DOCS}),
lost as (select l.r, sum(len(string_split(l.x, ' '))) as n from l join often o on l.x = o.x and l.source is not distinct from o.source group by 1),
b as (select w.r, doc_id, len(ws) as n_words, length(translate(t, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13)), '')) as word_chars,
  length(t) - length(translate(t, '{SYMBOLS}', '')) as n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(lost.n, 0) as removed_words
  from w left join rep using (r) left join lost using (r))
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words as base_failed,
  not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT} * n_words) and 100 * removed_words <= {MAX_REMOVED} * n_words as kept, cast(removed_words as bigint) as removed_words
from b
"""
