"""Operator 13, source divergence audit by iceberg prefix refinement.

Each language keeps the terms of at least ``min_docs`` of its documents. They are found level by level:
a level counts, for each language and byte prefix, the distinct documents with a term that starts so,
and drops prefixes below the threshold; only terms below a prefix that is left are extended to the next
level's length, which is twice as long. Each term ends in an end mark, so a prefix that holds it is a
complete term, which leaves the loop with its exact count. Levels grow with the logarithm of the longest
kept term. A document's terms lie in one row, so its prefixes are told apart there, and tasks
shuffle nothing but counts that they have summed. What is left of a level is known to the tasks of the
next by one bit for each prefix's hash, in a set of ``BITS`` bits, whatever the input: two prefixes
with one bit cost a count that the threshold drops, never a term.

Sources of a language are then compared over the kept terms with exact whole numbers. All pairs of
sources are asked for; they are summed in cells of two blocks of sources and one block of terms, so a
task holds two small matrices, and a term that neither source has needs no row.

Defined cases: null text, lang and source are empty strings; a row without terms makes a group without
terms; each row is a document, repeated rows too; a language without kept terms gives its pairs the
value 0; an empty table gives an empty result; further columns don't matter, whatever their names; texts
and terms are read whole, however long; a text is held by its task, one at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import LOWER, UPPER, bit_set, lean, lean_group, mix, table, text_pieces, written

#: Production parameters: documents of a kept term, smoothing, units, ranks of the terms' part.
MIN_DOCS, SMOOTH, UNITS, TOP = 30, 5, 1_000_000_000, 50
#: Bytes of the first level's prefixes; bits of the set of a level's prefixes; bytes of terms looked at together;
#: words of eight bytes of a term that are hashed for all terms at once.
FIRST, BITS, PIECE, WORDS = 3, 1 << 26, 4 << 20, 16
#: Terms and sources of a block.
TERMS, SOURCES = 1024, 64
#: Stands after each term and in no term.
END = b"\0"
#: A byte of a term as it is compared; all others are spaces.
_AS = np.array([ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if chr(b) in LOWER or b >= 128 else 32 for b in range(256)], np.uint8)


def documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, terms (the distinct ones in order, each with its end mark, a space between) and counts
    of each row."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("terms", pa.large_binary()), ("counts", pa.list_(pa.int64()))])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_pieces(batch, "text", PIECE - 1):
                low = _AS[data]
                word = low != 32
                first = word.copy()
                first[1:] &= ~word[:-1]
                heads = offsets[:-1][offsets[:-1] < len(data)]
                first[heads] = word[heads]
                row = np.searchsorted(offsets, np.flatnonzero(first), "right") - 1
                letters = low[word]
                places = np.append(np.flatnonzero(first[word]), len(letters)).astype(np.int32)
                terms = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(places), pa.py_buffer(letters)]).dictionary_encode()
                order = pc.array_sort_indices(terms.dictionary).to_numpy()
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                own, n = np.unique(row * max(1, len(order)) + rank[terms.indices.to_numpy()], return_counts=True)
                marked = pc.binary_join_element_wise(terms.dictionary.take(pa.array(order)), pa.scalar(END), pa.scalar(b"")).cast(pa.large_binary())
                ends = pa.array(np.searchsorted(own // max(1, len(order)), np.arange(b - a + 1)).astype(np.int32))
                joined = pc.binary_join(pa.ListArray.from_arrays(ends, marked.take(pa.array(own % max(1, len(order))))), pa.scalar(b" ", pa.large_binary()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), joined, pa.ListArray.from_arrays(ends, pa.array(n))], schema=schema)

    empty = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    return docs.select(empty(lang_col, "lang"), empty(source_col, "source"), empty(text_col, "text")).mapInArrow(lean(stream), "lang string, source string, terms binary, counts array<bigint>")


def _places(seed: np.ndarray | int, values: pa.Array, bits: int, width: int | None = None) -> np.ndarray:
    """The bit of each value (binary; its first `width` bytes alone), whose language has that seed. Values are read
    in words of eight bytes, all at once; what is left of those over WORDS words is hashed one by one."""
    large = pa.types.is_large_binary(values.type)
    _, offsets, data = values.buffers()
    offsets = np.frombuffer(offsets, np.int64 if large else np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    word_at = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    at, size = offsets[:-1] - offsets[0], np.diff(offsets)
    if width is not None:
        size = np.minimum(size, width)
    out = mix(size.astype(np.uint64) + np.asarray(seed, np.uint64))
    live = np.flatnonzero(size > 0)
    for k in range(WORDS):
        if not len(live):
            break
        rest = np.minimum(size[live] - 8 * k, 8).astype(np.uint64)
        word = word_at[at[live] + 8 * k] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * rest))
        out[live] = mix(out[live] ^ word)
        live = live[size[live] > 8 * (k + 1)]
    for i in live.tolist():
        out[i] ^= np.uint64(zlib.crc32(raw[at[i] + 8 * WORDS : at[i] + size[i]]))
    return (mix(out) % np.uint64(bits)).astype(np.int64)


def _seed(lang: str) -> int:
    return zlib.crc32(lang.encode()) << 16


def _set(df: DataFrame) -> Callable[[str, pa.Array, int | None], np.ndarray]:
    """For tasks: of a language and values (their first `width` bytes alone), whether each may be one of df (lang,
    prefix)."""

    size = BITS

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            seeds = np.array([_seed(x) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
            yield pa.RecordBatch.from_arrays([pa.array(_places(seeds, batch.column(1), size))], names=["cell"])

    bits = df.sparkSession.sparkContext.broadcast(bit_set(df.select("lang", "prefix").mapInArrow(places, "cell long"), size).tobytes())

    def may(lang: str, values: pa.Array, width: int | None = None) -> np.ndarray:
        at = _places(_seed(lang), values, size, width)
        return (np.frombuffer(bits.value, np.uint8)[at >> 3] >> (7 - at % 8).astype(np.uint8) & 1).astype(bool)

    return may


def _exploded(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.RecordBatch, pa.Array, np.ndarray]]:
    """Of each language of a run of rows with some PIECE bytes of terms: its rows, their terms, and the row of each."""
    ends = np.cumsum(pc.binary_length(batch.column("terms")).to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        some = batch.slice(at, end - at)
        names = some.column("lang").dictionary_encode()
        for k, lang in enumerate(names.dictionary.to_pylist()):
            own = some.filter(pc.equal(names.indices, k))
            parts = pc.split_pattern(own.column("terms"), pattern=b" ")
            yield lang, own, parts.flatten(), np.repeat(np.arange(own.num_rows), np.diff(parts.offsets.to_numpy()))
        at = end


def _level(docs: DataFrame, before: int, level: int, left: Callable | None) -> DataFrame:
    """lang, prefix, n: documents with a longer term that starts with the prefix of `level` bytes, as summed
    by tasks."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, _, terms, row in _exploded(batch):
                keep = pc.binary_length(terms).to_numpy() > before
                terms, row = terms.filter(pa.array(keep)), row[keep]
                if left is not None:
                    keep = left(lang, terms, before)
                    terms, row = terms.filter(pa.array(keep)), row[keep]
                # A row's terms are in order, so those with one prefix stand together.
                prefix = pc.binary_slice(terms, 0, level).dictionary_encode()
                code = prefix.indices.to_numpy()
                new = np.ones(len(code), bool)
                new[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
                n = np.bincount(code[new], minlength=len(prefix.dictionary))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), prefix.dictionary.cast(pa.binary()), pa.array(n, pa.int64())], names=["lang", "prefix", "n"])

    return docs.select("lang", "terms").mapInArrow(lean(stream), "lang string, prefix binary, n long")


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS, first: int = FIRST) -> DataFrame:
    """lang, term and n_docs of the terms in at least min_docs documents of their language."""
    level, before, done, left = first, 0, [], None
    while True:
        found = written(_level(docs, before, level, left).groupBy("lang", "prefix").agg(F.sum("n").alias("n_docs")).where(F.col("n_docs") >= min_docs), "level")
        whole = F.col("prefix").endswith(F.lit(END))
        done.append(found.where(whole).select("lang", F.expr("cast(substring(prefix, 1, octet_length(prefix) - 1) as string)").alias("term"), "n_docs"))
        if found.where(~whole).isEmpty():
            break
        left = _set(found.where(~whole))
        before, level = level, 2 * level
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out


def counts_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, term, n: how often each kept term occurs in each group."""
    left = _set(kept.select("lang", F.concat(F.encode("term", "UTF-8"), F.lit(END)).alias("prefix")))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, own, terms, row in _exploded(batch):
                names, sources = terms.dictionary_encode(), own.column("source").dictionary_encode()
                there = pc.binary_length(terms).to_numpy() > 0
                keep = left(lang, names.dictionary)[names.indices.to_numpy()] & there
                counts = np.zeros(len(keep), np.int64)
                counts[there] = own.column("counts").flatten().to_numpy()
                place = sources.indices.to_numpy()[row[keep]].astype(np.int64) * len(names.dictionary) + names.indices.to_numpy()[keep]
                sums = pa.table([pa.array(place), pa.array(counts[keep])], names=["k", "n"]).group_by("k").aggregate([("n", "sum")]).combine_chunks()
                k = sums["k"].to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), sources.dictionary.take(pa.array(k // max(1, len(names.dictionary)))), names.dictionary.take(pa.array(k % max(1, len(names.dictionary)))).cast(pa.binary()), pa.array(sums["n_sum"].to_numpy())], names=["lang", "source", "prefix", "n"])

    sums = docs.mapInArrow(lean(stream), "lang string, source string, prefix binary, n long").groupBy("lang", "source", "prefix").agg(F.sum("n").alias("n"))
    term = F.expr("cast(substring(prefix, 1, octet_length(prefix) - 1) as string)")
    return sums.select("lang", "source", term.alias("term"), "n").join(kept, ["lang", "term"], "left_semi")


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNITS * (count + SMOOTH) / (total + SMOOTH * terms)), exactly; 0 where there are no terms."""
    top = F.lit(UNITS).cast("decimal(12,0)") * (count + SMOOTH).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", top, (total + SMOOTH * terms).cast("decimal(20,0)")) + 1).otherwise(F.lit(0)).cast("long")


_PARTIAL = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("value", pa.int64())])


def _cell(data: pa.Table) -> pa.Table:
    """Of the sources of two blocks, the sums over one block of terms by which each pair's difference is
    more than if both had none of them. side: 0 or 1 for the block; a row without a term gives a source's
    share of an absent term."""
    side, share = data["side"].to_numpy(), data["share"].to_numpy()
    term, source = data["term"].combine_chunks().dictionary_encode(), data["source"].combine_chunks().dictionary_encode()
    at, names = source.indices.to_numpy(zero_copy_only=False), source.dictionary
    base = np.asarray(data["term"].is_null())
    none = np.zeros(len(names), np.int64)
    none[at[base]] = share[base]
    m = np.repeat(none[:, None], max(1, len(term.dictionary)), 1)
    m[at[~base], term.indices.to_numpy(zero_copy_only=False)[~base].astype(np.int64)] = share[~base]
    sides = np.zeros(len(names), np.int64)
    sides[at] = side
    same = data["a"][0].as_py() == data["b"][0].as_py()
    order = np.array(sorted(range(len(names)), key=lambda i: names[i].as_py().encode()), np.int64)
    a, b = order[sides[order] == 0], order if same else order[sides[order] == 1]
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k, i in enumerate(a.tolist()):
        others = b[k + 1 :] if same else b
        value = (np.abs(m[others] - m[i]) - np.abs(none[others] - none[i])[:, None]).sum(1)
        rows.append((np.full(len(others), i), others, value))
    i, j, value = (np.concatenate([r[x] for r in rows]) if rows else np.empty(0, np.int64) for x in range(3))
    lang = pa.array([data["lang"][0].as_py()] * len(i), pa.string())
    return pa.table([lang, names.take(pa.array(i, pa.int64())).cast(pa.string()), names.take(pa.array(j, pa.int64())).cast(pa.string()), pa.array(value, pa.int64())], schema=_PARTIAL)


def divergence(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` compares a source with each other one of its
    language over all kept terms, part `term` gives the terms that it has more than its language has."""
    d = written(documents(docs, text_col, lang_col, source_col), "terms")
    kept = written(kept_terms(d, min_docs), "kept")
    counts = written(counts_of(d, kept), "counts")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = d.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("n_all", F.lit(0)).alias("n_all"), F.coalesce("v", F.lit(0)).alias("v"))
    by_lang = groups.groupBy("lang").agg(F.sum("n_all").alias("n_lang"), F.count("*").alias("n_sources"))
    none = _share(F.lit(0), F.col("n_all"), F.col("v"))
    groups = written(groups.join(by_lang, "lang").withColumn("none", none), "groups")

    blocks = F.greatest(F.lit(1), F.ceil(F.col("v") / TERMS)).cast("long")
    houses = F.ceil(F.col("n_sources") / SOURCES).cast("long")
    house = F.pmod(F.xxhash64("source"), houses)
    g = groups.withColumn("blocks", blocks).withColumn("houses", houses).withColumn("house", house)
    shares = counts.join(g, ["lang", "source"]).select("lang", "source", "house", "houses", "term", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), _share(F.col("n"), F.col("n_all"), F.col("v")).alias("share"))
    absent = g.select("lang", "source", "house", "houses", F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("none").alias("share"))
    cells = shares.union(absent).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("houses") - 1)))
    cells = cells.select("lang", "block", F.least("house", "with").alias("a"), F.greatest("house", "with").alias("b"), (F.col("house") > F.col("with")).cast("int").alias("side"), "source", "term", "share")
    half = cells.groupBy("lang", "block", "a", "b").applyInArrow(lean_group(_cell), "lang string, source string, other string, value long").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    both = written(half, "pairs")
    both = both.union(both.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    own = groups.select("lang", "source", "v", "none")
    others = groups.select("lang", F.col("source").alias("other"), F.col("none").alias("other_none"))
    pair = both.join(own, ["lang", "source"]).join(others, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.col("value") + F.col("v") * F.abs(F.col("none") - F.col("other_none"))).alias("value"))
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    pair = pair.withColumn("rank", F.row_number().over(by))

    langs = counts.groupBy("lang", "term").agg(F.sum("n").alias("n_term"))
    more = counts.join(groups, ["lang", "source"]).join(langs, ["lang", "term"])
    p, q = _share(F.col("n"), F.col("n_all"), F.col("v")), _share(F.col("n_term"), F.col("n_lang"), F.col("v"))
    term = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where(F.col("value") > 0)
    term = term.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return pair.union(term).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
t as (select r, lang, source, unnest(ts) as term from d),
kept as (select lang, term from t group by 1, 2 having count(distinct r) >= {MIN_DOCS}),
c as (select lang, source, term, count(*) as n from t semi join kept using (lang, term) group by 1, 2, 3),
v as (select lang, count(*) as v from kept group by 1),
g as (select lang, source, coalesce(v, 0) as v, cast(coalesce((select sum(n) from c where c.lang = x.lang and c.source = x.source), 0) as hugeint) as total
  from (select distinct lang, source from d) x left join v using (lang)),
p as (select g.lang, g.source, kept.term, coalesce(n, 0) as n, 1 + (cast({UNITS} as hugeint) * (coalesce(n, 0) + {SMOOTH})) // (total + {SMOOTH} * v) as p
  from g join kept using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
l as (select lang, sum(total) as total from g group by 1),
q as (select lang, term, 1 + (cast({UNITS} as hugeint) * (x.n + {SMOOTH})) // (l.total + {SMOOTH} * v.v) as q from (select lang, term, sum(n) as n from c group by 1, 2) x join l using (lang) join v using (lang)),
f as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {TOP}
"""
