r"""Operator 9, personal data: base patterns, and candidates judged by boosted trees.

DataFrame functions only on the executors. Base spans of each kind are the leftmost non-overlapping
matches of its pattern that pass its check; they always stay. Generators with high recall propose
further, overlapping candidates: written-out addresses, four numbers, and of each run of digits every
window of its groups with as many digits as the kind has. In canonical form (``[at]`` as @, other separators of four
numbers as dots, digits alone) a candidate is fit for its kind or not; only fit ones can be added, and those that neither are fit
nor touch a base span of their kind go no further.

Gradient boosted trees over features of format and context judge them. Labels don't come from the
spans that the trees have to find: a candidate counts as positive if it is a base span, or if it is
fit and a word that announces its kind (mail, call, card, host ...) stands shortly before it. The
trees see neither those words nor what sets base spans apart from the others (the plus, the @, the
separators of four numbers), so they learn what announced and rule-conforming data look like, and
find the same forms where nothing announces them.

Two thirds of the candidates (by a hash of their place) are for fitting: of these a sample of at most
about ``SAMPLE`` for each kind and label, weighted by what it stands for, goes to the driver, where
the trees are grown. With all fit candidates of the last third the threshold of each kind is set: the least
margin from which on ``PRECISION`` of them are positive, and no less than even odds. Candidates that reach it are added where no base
span lies, by kind in order, the best first where they overlap each other (in runs of ``CHUNK`` candidates, from
left to right).

Patterns are written with possessive repeats, which match the same spans without backtracking, so
very long texts don't overflow the matcher's stack. Work grows in proportion to a text's length and matches: places
come from sums by levels, neighbours from searches in sorted spans, contexts from short lines of the text.

Defined cases: a null text is empty; with no candidates the model adds nothing; repeated rows are
rows of their own with equal results; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import ascii_lower, table, written

KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9])[0-9]++[.:_][0-9]++[.:_][0-9]++[.:_][0-9]++",
    "digits": r"[+(]?+[0-9](?:[\x20()./-]{0,2}+[0-9])++",
}
FEATURES = ("chars", "digits", "letters", "dots", "spaces", "dashes", "groups", "first", "last", "word_before", "word_after")
#: Words that announce a kind, within the CONTEXT characters before.
CUES = {"email": r"(?:mail|contact|write|reach)", "ip": r"(?:server|host|addr|\bip\b|node|gateway)", "card": r"(?:card|visa|payment|paid)", "phone": r"(?:tel|phone|call|fax|mobile|dial)"}
CONTEXT = 24
#: Least and most digits of a window of groups that is a candidate.
DIGITS = {"card": (16, 19), "phone": (8, 15)}
SAMPLE, ROUNDS, RATE, PRECISION = 2_500, 24, 0.3, 0.9
#: Candidates among which the best go first, and characters of a line.
CHUNK, LINE = 128, 64
#: Margins are told apart by this many steps of 1.
STEPS = 32


def _once(value: Column, f) -> Column:
    """f of the value, which is computed once however often f uses it, inside of other functions too."""
    return F.transform(F.array(value), f)[0]


def _before(a: Column, add=lambda x, y: x + y) -> Column:
    """For each number of an array the sum (or what `add` makes) of all before it; a number takes some 100 steps
    at most in arrays of up to a million."""
    total = lambda some: F.aggregate(some, F.lit(0), add)
    sums = lambda some: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(some), 5)), lambda j: total(F.slice(some, j * 32 + 1, F.lit(32))))

    def of(a: Column, by_32: Column, by_1024: Column) -> Column:
        low, mid, high = lambda i: i.bitwiseAND(F.lit(31)), lambda i: F.shiftright(i, 5), lambda i: F.shiftright(i, 10)
        return F.transform(a, lambda _, i: add(add(total(F.slice(by_1024, F.lit(1), high(i))), total(F.slice(by_32, high(i) * 32 + 1, low(mid(i))))), total(F.slice(a, mid(i) * 32 + 1, low(i)))))

    return _once(a, lambda a: _once(sums(a), lambda by_32: _once(sums(by_32), lambda by_1024: of(a, by_32, by_1024))))


def _matches(t: Column, pattern: str, needs: Column) -> Column:
    """array<struct<s,m>> of the leftmost non-overlapping matches; s in code points."""
    found = F.when(needs, F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))

    def placed(found: Column, gaps: Column) -> Column:
        steps = F.transform(found, lambda m, i: F.get(gaps, i) + F.length(m))
        return _once(_before(steps), lambda before: F.transform(found, lambda m, i: F.struct((F.get(before, i) + F.get(gaps, i)).alias("s"), m.alias("m"))))

    none = F.array().cast("array<struct<s:int,m:string>>")
    return _once(found, lambda found: F.when(F.size(found) > 0, _once(F.transform(F.split(t, pattern, -1), F.length), lambda gaps: placed(found, gaps))).otherwise(none))


def _lines(t: Column) -> Column:
    """The text by LINE characters: what is looked up there costs as much at the end of a text as at its start."""
    return F.regexp_extract_all(t, F.lit(f"(?s).{{1,{LINE}}}"), F.lit(0))


def _part(lines: Column, start: Column, end: Column) -> Column:
    """The characters from start to before end."""
    q = F.shiftright(start, 6)
    joined = F.array_join(F.slice(lines, q + 1, F.greatest(F.shiftright(F.greatest(end, start + 1) - 1, 6) - q + 1, F.lit(0))), "")
    return F.substring(joined, start - q * LINE + 1, F.greatest(end - start, F.lit(0)))


def _up_to(spans: Column, place: Column) -> Column:
    """How many of the spans, which are in order and apart, start before the place."""
    def step(a: Column, _: Column) -> Column:
        mid = F.shiftright(a["lo"] + a["hi"], 1)
        less = F.coalesce(F.get(spans, mid)["s"] < place, F.lit(False))
        return F.when(a["lo"] >= a["hi"], a).when(less, F.struct((mid + 1).alias("lo"), a["hi"].alias("hi"))).otherwise(F.struct(a["lo"].alias("lo"), mid.alias("hi")))

    n = F.size(spans)
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), F.struct(F.lit(0).alias("lo"), n.alias("hi")), step, lambda a: a["lo"])


def _over(spans: Column, s: Column, e: Column) -> Column:
    """Whether any of the spans, which are in order and apart, has a character from s to before e."""
    few = F.exists(spans, lambda b: (b["s"] < e) & (s < b["e"]))
    return F.when(F.size(spans) <= 16, few).otherwise(F.coalesce(F.get(spans, _up_to(spans, e) - 1)["e"] > s, F.lit(False)))


def _among(spans: Column, s: Column, e: Column) -> Column:
    """Whether the span is one of those."""
    few = F.exists(spans, lambda b: (b["s"] == s) & (b["e"] == e))
    return F.when(F.size(spans) <= 16, few).otherwise(_once(F.get(spans, _up_to(spans, s + 1) - 1), lambda b: F.coalesce((b["s"] == s) & (b["e"] == e), F.lit(False))))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _windows(x: Column, kind: str, prefix: bool) -> Column:
    """array<struct<s,m>> of the windows of neighbouring digit groups of a run that have as many digits as
    the kind; with `prefix` a plus or bracket right before the first group belongs to it."""
    # A lambda's argument is computed once, an expression that is used in a lambda once a turn.
    once = lambda value, f: F.flatten(F.transform(F.array(value), f))

    def grouped(chars: Column) -> Column:
        """Where each group starts and ends in the run."""
        digit = lambda p: F.coalesce(F.get(chars, p).between("0", "9"), F.lit(False))
        at = F.sequence(F.lit(0), F.size(chars) - 1)
        starts, ends = F.filter(at, lambda p: digit(p) & ~digit(p - 1)), F.filter(at, lambda p: digit(p) & ~digit(p + 1))
        pairs = F.arrays_zip(starts.alias("a"), ends.alias("b"))
        return _once(pairs, lambda pairs: _once(_before(F.transform(pairs, lambda g: g["b"] + 1 - g["a"])), lambda d: F.transform(pairs, lambda g, i: F.struct(i.alias("i"), g["a"].alias("a"), (g["b"] + 1).alias("b"), F.get(d, i).alias("d")))))

    def windows(chars: Column, lines: Column, groups: Column, g: Column) -> Column:
        def of(some: Column) -> Column:
            fit = F.filter(some, lambda y: (y["d"] + y["b"] - y["a"] - g["d"]).between(*DIGITS[kind]))
            is_at = lambda p, c: F.coalesce(F.get(chars, p) == c, F.lit(False))
            bracket = is_at(g["a"] - 1, "(")
            back = F.when(bracket & is_at(g["a"] - 2, "+"), 2).when(bracket | is_at(g["a"] - 1, "+"), 1).otherwise(0) if prefix else F.lit(0)
            return once(back, lambda back: F.transform(fit, lambda y: F.struct((x["s"] + g["a"] - back).alias("s"), _part(lines, g["a"] - back, y["b"]).alias("m"))))

        last = F.least(g["i"] + DIGITS[kind][1], F.size(groups)) - 1
        return once(F.transform(F.sequence(g["i"], last), lambda k: F.get(groups, k)), of)

    return once(F.split(x["m"], ""), lambda chars: once(_lines(x["m"]), lambda lines: once(grouped(chars), lambda groups: F.flatten(F.transform(groups, lambda g: windows(chars, lines, groups, g))))))


def _luhn(digits: Column) -> Column:
    """Whether 1 to 40 digits pass the Luhn check."""
    n = F.length(digits)
    value = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i)))
    return F.when((n > 0) & (n <= 40), F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0).otherwise(F.lit(False))


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.substring(x, -3, 3).cast("int") <= 255))
    if kind == "card":
        d = _digits(m)
        return F.length(d).between(16, 19) & F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(m)).between(8, 15)
    return F.lit(True)


def _count(m: Column, chars: str) -> Column:
    return F.length(m) - F.length(F.translate(m, chars, ""))


def _canonical(kind: str, m: Column) -> Column:
    if kind == "email":
        at = F.regexp_replace(m, r"\x20?[\[(](?:at|AT)[\])]\x20?", "@")
        return F.regexp_replace(at, r"\x20?[\[(](?:dot|DOT)[\])]\x20?", ".")
    return F.regexp_replace(m, "[:_]", ".") if kind == "ip" else m


def _fit(kind: str, canonical: Column) -> Column:
    if kind == "email":
        return canonical.rlike("^" + BASE["email"].rpartition("]))")[2] + "$") & F.substring_index(canonical, ".", -1).rlike("^[A-Za-z]{2,}+$")
    return _passes(kind, canonical)


def _features(x: Column, m: Column, context: Column, after: Column) -> Column:
    """Features of the canonical form m of the candidate x, with the characters before and after it."""
    yes = lambda c: c.cast("int")
    groups = F.regexp_extract_all(m, F.lit("[A-Za-z0-9]+"), F.lit(0))
    all_of = {
        "chars": F.length(F.ltrim(m, F.lit("+("))), "digits": F.length(_digits(m)), "letters": F.length(F.regexp_replace(m, "[^A-Za-z]", "")), "dots": _count(m, "."), "spaces": _count(m, " "), "dashes": _count(m, "-"),
        "groups": F.size(groups), "first": F.length(F.get(groups, F.lit(0))), "last": F.length(F.element_at(groups, -1)),
        "word_before": yes(context.rlike("[A-Za-z0-9]$")), "word_after": yes(after.rlike("[A-Za-z0-9]")),
    }
    return F.array(*[F.coalesce(all_of[f], F.lit(0)).cast("double") for f in FEATURES])


SPAN = "array<struct<k:int,s:int,e:int>>"
MORE = "array<struct<k:int,s:int,e:int,y:boolean,good:boolean,o:boolean,f:array<double>>>"


def found(docs: DataFrame, id_col: str, text_col: str, keep: bool = False) -> DataFrame:
    """Per row: _id, _base (spans in order) and _more (candidates with their label y, whether they may be
    added, whether they lie over a base span of their kind, and features), and _t and _row (whether the
    text is null, and all other columns) where keep says so. The text is read once."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col] or [F.lit(0)]
    d = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("_t"), *([F.struct(F.col(f"`{text_col}`").isNull().alias("null"), F.struct(*others).alias("all")).alias("_row")] if keep else []))
    t = F.col("_t")
    needs = {"email": t.contains("@"), "ip": t.rlike(r"[0-9]\.[0-9]"), "card": t.rlike("[0-9]"), "phone": t.contains("+")}
    d = d.select("*", *[_matches(t, BASE[k], needs[k]).alias(f"_{k}") for k in KINDS])

    def passing(i: int, kind: str) -> Column:
        good = F.filter(f"_{kind}", lambda x: _passes(kind, x["m"]))
        return F.transform(good, lambda x: F.struct(F.lit(i).alias("k"), x["s"].alias("s"), (x["s"] + F.length(x["m"])).alias("e")))

    d = d.withColumn("_base", F.concat(*[passing(i, k) for i, k in enumerate(KINDS)]).cast(SPAN)).drop(*[f"_{k}" for k in KINDS])
    wide = {"email": t.contains("@") | t.rlike(r"[\[(](?:at|AT)[\])]"), "ip": t.rlike("[0-9]"), "digits": t.rlike("[0-9]")}
    d = d.select("*", *[_matches(t, WIDE[k], wide[k]).alias(f"_{k}") for k in WIDE])
    d = d.withColumn("_groups", F.flatten(F.transform("_digits", lambda x: _windows(x, "card", False)))).withColumn("_signed", F.flatten(F.transform("_digits", lambda x: _windows(x, "phone", True))))

    def candidates(k: int, column: str) -> Column:
        kind = KINDS[k]

        def one(x: Column, m: Column, lines: Column, base: Column, own: Column) -> Column:
            s, e = x["s"], x["s"] + F.length(x["m"])
            good = _fit(kind, m) & ~_over(base, s, e)
            mine = _among(own, s, e) if k > 1 else _over(own, s, e)
            context = _part(lines, F.greatest(s - CONTEXT, F.lit(0)), s)

            def judged(c: Column) -> Column:
                y = c["mine"] | c["good"] & ascii_lower(c["context"]).rlike(CUES[kind])
                return F.struct(F.lit(k).alias("k"), s.alias("s"), e.alias("e"), y.alias("y"), c["good"].alias("good"), _over(own, s, e).alias("o"), _features(x, m, c["context"], _part(lines, e, e + 1)).alias("f"))

            told = _once(F.struct(good.alias("good"), mine.alias("mine")), lambda c: F.when(c["good"] | c["mine"], F.struct(c["good"].alias("good"), c["mine"].alias("mine"), context.alias("context"))))
            return _once(told, lambda c: F.when(c.isNotNull(), judged(c)))

        # Of all base spans in order, each to the furthest end so far: the same characters, found by search.
        whole = F.array_sort(F.transform("_base", lambda b: F.struct(b["s"].alias("s"), b["e"].alias("e"))))
        ends = lambda spans: _once(_before(F.transform(spans, lambda b: b["e"]), lambda x, y: F.greatest(x, y)), lambda far: F.transform(spans, lambda b, i: F.struct(b["s"].alias("s"), F.greatest(b["e"], F.get(far, i)).alias("e"))))
        own = F.filter("_base", lambda b: b["k"] == k)
        every = lambda lines, base, own: F.transform(column, lambda x: _once(_canonical(kind, x["m"]), lambda m: one(x, m, lines, base, own)))
        each = _once(_lines(t), lambda lines: _once(_once(whole, ends), lambda base: _once(own, lambda own: every(lines, base, own))))
        return F.when(F.size(column) > 0, F.filter(each, lambda c: c.isNotNull())).otherwise(F.array().cast(MORE))

    more = F.concat(candidates(0, "_email"), candidates(1, "_ip"), candidates(2, "_groups"), candidates(3, "_signed"))
    return d.select("_id", "_base", more.alias("_more"), *(["_t", "_row"] if keep else []))


def boost(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, depth: int = 3) -> list:
    """Logistic gradient boosting of rows of weights w with Newton leaves and exact splits; nested
    (feature, cut, low, high)."""
    f, trees = np.zeros(len(y)), []
    w = w / w.mean()

    def grow(at: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        best, split = g[at].sum() ** 2 / (h[at].sum() + 1.0) + 1e-6, None
        for j in range(x.shape[1] if left else 0):
            order = at[np.argsort(x[at, j], kind="stable")]
            v, cg, ch = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
            cut = np.flatnonzero(v[1:] > v[:-1])
            if len(cut):
                gain = cg[cut] ** 2 / (ch[cut] + 1.0) + (cg[-1] - cg[cut]) ** 2 / (ch[-1] - ch[cut] + 1.0)
                if gain.max() > best:
                    best, i = gain.max(), cut[int(gain.argmax())]
                    split = (j, float((v[i] + v[i + 1]) / 2))
        if split is None:
            leaf = round(rate * float(g[at].sum() / (h[at].sum() + 1.0)), 6)
            f[at] += leaf
            return leaf
        low = x[at, split[0]] <= split[1]
        return (*split, grow(at[low], g, h, left - 1), grow(at[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        trees.append(grow(np.arange(len(y)), w * (y - p), w * p * (1 - p), depth))
    return trees


def score_tree(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def tree_column(tree, f: Column) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    return F.when(f[tree[0]] <= tree[1], tree_column(tree[2], f)).otherwise(tree_column(tree[3], f))


def margin(trees: list, f: Column) -> Column:
    return sum((tree_column(t, f) for t in trees), F.lit(0.0))


def fit(made: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[list, float]]:
    """Trees and the calibrated threshold (of the margin) for each kind."""
    place = F.xxhash64("_id", "c.k", "c.s", "c.e")
    rows = made.select("_id", F.explode("_more").alias("c")).select(place.alias("h"), "c.k", "c.y", "c.good", "c.o", "c.f")
    # A candidate that only touches a base span of its kind is neither.
    rows = rows.where(F.col("y") | ~F.col("o")).withColumn("held", F.pmod("h", F.lit(3)) == 0)
    counts = {(r["k"], r["y"]): r["count"] for r in rows.where("not held").groupBy("k", "y").count().collect()}
    kinds = [k for k in range(len(KINDS)) if counts.get((k, True))]
    if not kinds:
        return {}
    part = 1 << 40
    share = {key: min(1.0, sample / n) for key, n in counts.items()}
    drawn = F.lit(False)
    for (k, y), p in share.items():
        if k in kinds:
            drawn = drawn | (F.col("k") == k) & (F.col("y") == y) & (F.pmod(F.xxhash64("h"), F.lit(part)) < int(p * part))
    some = rows.where(~F.col("held") & drawn).select("k", "y", "f").collect()
    trees = {}
    for k in kinds:
        own = [r for r in some if r["k"] == k]
        y = np.array([r["y"] for r in own], float)
        if y.all():
            trees[k] = []  # nothing speaks against any form
        elif y.any():
            trees[k] = boost(np.array([r["f"] for r in own], float), y, np.array([1 / share[k, r["y"]] for r in own]))
    if not trees:
        return {}
    each = F.lit(0.0)
    for k, t in trees.items():
        each = F.when(F.col("k") == k, margin(t, F.col("f"))).otherwise(each)
    # Margins are told apart by 1 / STEPS and bounded by the number and rate of the trees: few rows.
    bins = rows.where(F.col("held") & F.col("k").isin(*trees) & (F.col("good") | F.col("y"))).groupBy("k", F.floor(each * STEPS).alias("bin")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("int")).alias("p")).collect()
    models = {}
    for k, t in trees.items():
        n = p = 0
        for r in sorted((r for r in bins if r["k"] == k), key=lambda r: -r["bin"]):
            n, p = n + r["n"], p + r["p"]
            if p >= PRECISION * n:
                models[k] = (t, max(r["bin"] / STEPS, 0.0))
    return models


def spans(made: DataFrame, models: dict[int, tuple[list, float]]) -> DataFrame:
    """made plus _spans: base spans and the added ones, by kind and start."""
    def chosen(k: int, trees: list, least: float, taken: list[Column]) -> Column:
        free = lambda x: F.lit(True) if not taken else ~F.exists(F.array(*[_over(t, x["s"], x["e"]) for t in taken]), lambda y: y)
        own = F.filter("_more", lambda x: (x["k"] == k) & x["good"])
        scored = F.transform(own, lambda x: F.struct((-margin(trees, x["f"])).alias("m"), (x["s"] - x["e"]).alias("n"), x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e")))
        some = F.filter(scored, lambda x: (x["m"] <= -least) & free(x))
        span = lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))
        overlap = lambda a, x: F.exists(a, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        # Of candidates that overlap the one with the highest margin stays, then the longest, then the first.
        best = lambda chunk: F.aggregate(F.array_sort(chunk), F.array().cast(SPAN), lambda a, x: F.when(overlap(a, x), a).otherwise(F.concat(a, F.array(span(x)))))
        chunks = lambda some: F.transform(F.sequence(F.lit(0), F.shiftright(F.greatest(F.size(some) - 1, F.lit(0)), 7)), lambda j: best(F.slice(some, j * CHUNK + 1, F.lit(CHUNK))))
        # A chunk's candidates start at its predecessors' last ones or after them, and windows of 19 groups end within 16 chunks.
        ends = lambda chunks: F.transform(chunks, lambda c: F.coalesce(F.array_max(F.transform(c, lambda x: x["e"])), F.lit(0)))
        reach = lambda ends, j: F.coalesce(F.array_max(F.slice(ends, F.greatest(j - 15, F.lit(1)), F.least(j, F.lit(16)))), F.lit(0))
        apart = lambda chunks, ends: F.flatten(F.transform(chunks, lambda c, j: _once(reach(ends, j), lambda r: F.filter(c, lambda x: x["s"] >= r))))
        found = _once(some, lambda some: _once(chunks(some), lambda chunks: _once(ends(chunks), lambda ends: apart(chunks, ends))))
        return F.array_sort(found)

    added: list[Column] = []
    for k, model in sorted(models.items()):
        made = made.withColumn(f"_added{k}", chosen(k, *model, added))
        added.append(F.col(f"_added{k}"))
    return made.withColumn("_spans", F.array_sort(F.concat("_base", *added)))


def _said(column: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def detect(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    made = written(found(docs, id_col, text_col), "pii")
    out = spans(made, fit(made))

    def count(i: int) -> Column:
        return F.size(F.filter("_base", lambda x: x["k"] == i)).cast("bigint")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select(F.col("_id").alias(id_col), *counts, F.sha2(_said("_base"), 256).alias("base_sha256"), _said("_spans").alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span of its texts replaced by its kind in angle brackets; a null text stays null."""
    made = written(found(docs, id_col, text_col, keep=True), "pii")
    out = spans(made, fit(made))
    t, names = F.col("_t"), F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    by_start = F.array_sort(F.transform("_spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    since = lambda spans: _before(F.transform(spans, lambda x: x["e"]), lambda x, y: F.greatest(x, y))

    def cut(spans: Column, since: Column, lines: Column) -> Column:
        each = F.transform(spans, lambda x, i: F.when(x["s"] >= F.get(since, i), F.concat(_part(lines, F.get(since, i), x["s"]), names[x["k"]])).otherwise(F.lit("")))
        rest = F.greatest(F.get(since, F.size(spans) - 1), F.get(spans, F.size(spans) - 1)["e"])
        return F.concat(F.array_join(each, ""), _part(lines, rest, F.length(t)))

    done = _once(by_start, lambda spans: _once(since(spans), lambda since: _once(_lines(t), lambda lines: cut(spans, since, lines))))
    text = F.when(F.col("_row.null"), F.lit(None)).when(F.size("_spans") == 0, t).otherwise(done)
    return out.select(*[text.alias(c) if c == text_col else F.col(f"_row.all.`{c}`").alias(c) for c in docs.columns])


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
