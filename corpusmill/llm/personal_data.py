"""Personal data by fixed patterns and bootstrapped contextual extraction, with built-in functions only.

Base entities (email, ip, card, phone) are leftmost, non-overlapping matches that pass a check.
They are the seeds of the second part: the words around an entity are lexical patterns, and a
token with digits or an at sign, or a run of digits with inner spaces, in the same surroundings
is a candidate. Patterns and instances form a graph that is scored in turns: a pattern is as
good as the belief in its instances against those that contradict the kind (entities of
another kind, candidates that do not look like it; those that look like it and are not yet
reached do not count), an instance is believed as far as good patterns hold it. Instances
reached in one turn support patterns in the next, also patterns without an entity. Only
instances of well-supported, nearly pure patterns that also look like the kind are added.

Positions come without a search function: the texts between matches and the matches alternate,
so a running sum of their lengths gives each start, in code points.

Defined results: a null or empty text has no spans; a text is searched whole, at a cost in
proportion to its length; repeated rows are rows of their own; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checked_broadcast, with_row_id
from corpusmill.session import materialize

KINDS = ("email", "ip", "card", "phone")
# The kinds' expressions with possessive loops, which neither recurse nor go back, and with a
# look behind that starts only where a run starts, so a long run is scanned once.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What may be an identifier: 7 to 19 digits with spaces and marks between them up to the end of a
# token, or a token of six characters or more, with an at sign or four digits.
CANDIDATE = (
    r"(?<!\S)(?:[+(]{0,2}[0-9](?:[\x20().-]{0,3}[0-9]){6,18}+(?=[.,;:!?)]{0,3}(?:\s|\z))"
    r"|(?=\S{6})(?=\S*@|(?:[^\s0-9]*+[0-9]){4})\S++)"
)
# What a found token of each kind must look like, so that a kind's patterns add its like only.
LIKE = {
    "email": r"^[^\s@]+@[^\s@]+$",
    "ip": r"^[0-9]{1,3}([.,:_-][0-9]{1,3}){3}[.,;:]?$",
    "card": r"^[0-9]([\x20-]?[0-9]){11,18}[.,;:]?$",
    "phone": r"^[+(]{0,2}[0-9]([-.()\x20]*[0-9]){6,14}[.,;:]?$",
}
TURNS = 3
# Distinct believed instances a pattern needs, and how pure it must be.
SUPPORT = 5
PURITY = 0.9
BELIEVED = 0.9
BLOCK = 256


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    digits = _digits(value)

    def weight(i: Column) -> Column:
        digit = digits.substr(i, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(digits)))
    return F.aggregate(F.transform(places, weight), F.lit(0), lambda total, x: total + x) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda span: _valid(kind, span["value"])


def _with_kind(kind: Column) -> Callable[[Column], Column]:
    names = ("start", "end", "value", "before", "after")
    return lambda span: F.struct(kind.alias("kind"), *[span[n].alias(n) for n in names])


def _place(span: Column) -> Column:
    return F.struct(span["start"].alias("start"), span["end"].alias("end"))


def _is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda span: span["kind"] == kind


def running_sums(lengths: Column) -> Column:
    """Sums in front of each element, in blocks, so that no long array is copied per element."""
    empty = F.array().cast("array<bigint>")

    def sums(values: Column, first: Column) -> Column:
        step = F.aggregate(
            values, F.struct(first.alias("next"), empty.alias("all")),
            lambda a, x: F.struct((a["next"] + x).alias("next"), F.concat(a["all"], F.array(a["next"])).alias("all")),
        )
        return step["all"]

    count = F.ceil(F.size(lengths) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                         lambda b: F.slice(lengths, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0).cast("bigint")
    totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda total, x: total + x))
    return F.flatten(F.zip_with(blocks, sums(totals, zero), sums))


def most_before(ends: Column) -> Column:
    """The largest of the elements in front of each element, 0 for the first, in blocks as in :func:`running_sums`."""
    empty = F.array().cast("array<bigint>")

    def most(values: Column, first: Column) -> Column:
        step = F.aggregate(
            values, F.struct(first.alias("next"), empty.alias("all")),
            lambda a, x: F.struct(F.greatest(a["next"], x).alias("next"), F.concat(a["all"], F.array(a["next"])).alias("all")),
        )
        return step["all"]

    count = F.ceil(F.size(ends) / F.lit(BLOCK)).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                         lambda b: F.slice(ends, b * BLOCK + 1, F.lit(BLOCK)))
    zero = F.lit(0).cast("bigint")
    return F.flatten(F.zip_with(blocks, most(F.transform(blocks, F.array_max), zero), most))


def matched(df: DataFrame, pattern: str, out: str, text: str = "text") -> DataFrame:
    """Adds ``out``: array of ``(start, end, value, before, after)`` for all matches of a pattern.

    ``before`` and ``after`` are the ends of the texts between matches, up to 60 characters.
    """
    found, gaps, starts = f"_{out}_found", f"_{out}_gaps", f"_{out}_starts"
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(found) > 0
    df = df.withColumn(gaps, F.when(some, F.split(text, pattern, -1)))
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), found, lambda gap, m: (F.length(gap) + F.length(m)).cast("bigint"))
    df = df.withColumn(starts, F.when(some, running_sums(steps)))

    def span(value: Column, i: Column) -> Column:
        gap = F.get(F.col(gaps), i)
        start = F.get(F.col(starts), i) + F.length(gap)
        return F.struct(
            start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"),
            F.right(gap, F.lit(60)).alias("before"), F.left(F.get(F.col(gaps), i + 1), F.lit(60)).alias("after"),
        )

    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>")
    return df.withColumn(out, F.when(some, F.transform(found, span)).otherwise(none)).drop(found, gaps, starts)


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with one array column of valid spans per kind and ``candidate``, for its column ``text``."""
    for kind in KINDS:
        docs = matched(docs, PATTERNS[kind], kind)
        docs = docs.withColumn(kind, F.filter(kind, _passes(kind)))
    return matched(docs, CANDIDATE, "candidate")


def _mentions(rows: DataFrame) -> DataFrame:
    """``(row_id, kind, start, end, value, pattern)``: entities and candidates with each lexical pattern around them.

    Seeds carry their kind; candidates that touch no seed have a null kind.
    """
    seeds = F.concat(*[F.transform(k, _with_kind(F.lit(k))) for k in KINDS])
    loose = F.transform("candidate", _with_kind(F.lit(None).cast("string")))
    some = rows.where(F.size("candidate") + sum(F.size(k) for k in KINDS) > 0).withColumn("_seeds", seeds)
    free = F.filter(loose, lambda c: ~F.exists("_seeds", lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    each = some.select("row_id", F.explode(F.concat("_seeds", free)).alias("m")).select("row_id", "m.*")
    left = F.lower(F.regexp_extract("before", r"([^\s0-9]+\s+[^\s0-9]+)\s+$", 1))
    near = F.lower(F.regexp_extract("before", r"([^\s0-9]+)\s+$", 1))
    right = F.lower(F.regexp_extract("after", r"^\S?\s+([^\s0-9]+)", 1))
    patterns = F.array(
        F.when(left != "", F.concat(F.lit("L "), F.regexp_replace(left, r"\s+", " "))),
        F.when((near != "") & (right != ""), F.concat(F.lit("B "), near, F.lit(" _ "), right)),
    )
    return each.withColumn("pattern", F.explode(F.filter(patterns, lambda p: p.isNotNull()))).drop("before", "after")


def _discovered(rows: DataFrame) -> DataFrame:
    """``(row_id, kind, start, end, value)`` of candidates that patterns learned from the seeds reveal, written."""
    mentions = materialize(_mentions(rows), "mentions")
    edges = mentions.groupBy("pattern", "value").agg(F.max("kind").alias("seed"))
    # How many instances contradict each kind, and how many may ever support a pattern: seeds, and what looks like a kind.
    like = {k: F.col("seed").isNull() & F.col("value").rlike(LIKE[k]) for k in KINDS}
    agrees = {k: F.coalesce(F.col("seed") == k, F.lit(False)) | like[k] for k in KINDS}
    able = F.col("seed").isNotNull()
    for kind in KINDS:
        able = able | like[kind]
    sizes = edges.groupBy("pattern").agg(F.count(F.when(able, 1)).alias("_able"),
                                         *[F.count(F.when(~agrees[k], 1)).alias(f"_not_{k}") for k in KINDS])
    # With fewer such instances than the support asks for, no turn can make a pattern good.
    sizes = materialize(sizes.where(F.col("_able") >= SUPPORT), "patterns")
    edges = materialize(edges.where(able).join(sizes.select("pattern"), "pattern"), "edges")
    seeds = edges.where("seed is not null").select("value", F.col("seed").alias("kind")).distinct().withColumn("belief", F.lit(1.0))
    against = F.coalesce(*[F.when(F.col("kind") == k, F.col(f"_not_{k}")) for k in KINDS])
    looks = F.lit(False)
    for kind in KINDS:
        looks = looks | ((F.col("kind") == kind) & F.col("value").rlike(LIKE[kind]))
    believed, good = seeds, None
    for _ in range(TURNS):
        believed = materialize(believed, "beliefs")
        held = edges.join(believed, "value").where(F.col("seed").isNull() | (F.col("seed") == F.col("kind"))).groupBy("pattern", "kind").agg(
            F.sum("belief").alias("_belief"), F.count(F.lit(1)).alias("_n"),
            F.count(F.when(F.col("belief") >= BELIEVED, 1)).alias("_support"))
        scored = held.join(sizes, "pattern").withColumn("purity", F.col("_belief") / (F.col("_n") + against))
        good = materialize(scored.where((F.col("_support") >= SUPPORT) & (F.col("purity") >= PURITY))
                           .select("pattern", "kind", "purity"), "patterns")
        doubt = F.sum(F.log1p(-F.least(F.col("purity"), F.lit(0.999))))
        reached = edges.where("seed is null").join(good, "pattern").where(looks)
        unseen = reached.groupBy("value", "kind").agg((F.lit(1.0) - F.exp(doubt)).alias("belief"))
        believed = seeds.unionByName(unseen.join(seeds.select("value", "kind"), ["value", "kind"], "left_anti"))
    sure = materialize(believed, "beliefs").where(F.col("belief") >= BELIEVED).select("value", F.col("kind").alias("_kind"))
    # Only where a good pattern stands is the instance taken for personal data.
    places = mentions.where("kind is null").join(good.withColumnRenamed("kind", "_kind"), "pattern")
    found = places.join(sure, ["value", "_kind"]).select("row_id", F.col("_kind").alias("kind"), "start", "end", "value")
    first = found.groupBy("row_id", "start", "end", "value").agg(F.min("kind").alias("kind"))
    return materialize(first, "discovered")


def find(docs: DataFrame, keep_row: bool = False) -> DataFrame:
    """``(row_id, doc_id, email, ip, card, phone, added)``, one row per row of ``docs``.

    The kinds hold base spans ``(start, end, value, ...)``; ``added`` holds the spans the
    method adds, ``(kind, start, end, value)``. With ``keep_row`` the whole row is in ``kept``.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    kept = [F.struct("*").alias("kept")] if keep_row else []
    read = base_spans(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text, *kept)).drop("text")
    rows = materialize(with_row_id(read), "base-spans")
    found = _discovered(rows)
    span = F.struct("kind", "start", "end", "value")
    added = materialize(found.groupBy("row_id").agg(F.array_sort(F.collect_list(span)).alias("added")), "added")
    joined = rows.drop("candidate").join(checked_broadcast(added), "row_id", "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,value:string>>")
    return joined.select("row_id", "doc_id", *KINDS, F.coalesce("added", none).alias("added"), *["kept"][: len(kept)])


def digest(found: DataFrame) -> DataFrame:
    """Counts and positions of what :func:`find` found; counts and ``base_sha256`` are of base spans."""
    def lines(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    base = F.concat(*[lines(k, F.col(k)) for k in KINDS])
    # Base and added spans of one kind, by start.
    both = [F.array_sort(F.concat(F.transform(k, _place), F.transform(F.filter("added", _is_kind(k)), _place))) for k in KINDS]
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*[lines(k, s) for k, s in zip(KINDS, both)]), ",").alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
    )


def _marked(kind: str) -> Callable[[Column], Column]:
    return lambda value: F.when(_valid(kind, value), F.lit(f"[{kind}]")).otherwise(value)


def _span_of(kind: str) -> Callable[[Column], Column]:
    return lambda span: F.struct(span["start"].alias("start"), (-span["end"]).alias("to"), F.lit(kind).alias("kind"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets, other columns unchanged.

    Base and added spans are replaced where they stand in the original text; spans that overlap
    are replaced together, by the kind of the first of them, the longest if several start there.
    What becomes a match only when its surroundings are gone (a card in front of an ip) is
    replaced afterwards, kind by kind.
    """
    added = F.transform("added", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(*[F.transform(k, _span_of(k)) for k in KINDS], added))
    out = find(docs, keep_row=True).select("kept", F.col("kept")["text"].cast("string").alias("text"), spans.alias("spans"))
    out = out.withColumn("front", F.when(F.size("spans") > 0, most_before(F.transform("spans", lambda s: -s["to"]))))
    both = F.zip_with("spans", "front", lambda s, f: F.struct(f.alias("front"), s["start"].alias("start"), s["kind"].alias("kind")))
    # Where a span starts behind the ends of all spans in front of it, the text between stays.
    out = out.withColumn("heads", F.filter(both, lambda h: h["start"] >= h["front"]))

    def block(b: Column) -> Column:
        heads = F.slice("heads", b * BLOCK + 1, F.lit(BLOCK))
        first = F.get("heads", b * BLOCK)["front"]
        last = F.get("heads", F.least((b + 1) * BLOCK, F.size("heads")) - 1)["start"]
        return F.struct(heads.alias("heads"), first.alias("first"),
                        F.col("text").substr((first + 1).cast("int"), (last - first).cast("int")).alias("text"))

    def written(block: Column) -> Column:
        return F.array_join(F.transform(block["heads"], lambda h: F.concat(
            block["text"].substr((h["front"] - block["first"] + 1).cast("int"), (h["start"] - h["front"]).cast("int")),
            F.lit("["), h["kind"], F.lit("]"))), "")

    # Positions are searched inside blocks of the text, so that a long text is not walked through once a span.
    count = F.ceil(F.size("heads") / F.lit(BLOCK)).cast("int")
    out = out.withColumn("blocks", F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), block))
    end = F.array_max(F.transform("spans", lambda s: -s["to"]))
    rest = F.col("text").substr((end + 1).cast("int"), F.length("text"))
    text = F.when(F.size("spans") > 0, F.concat(F.array_join(F.transform("blocks", written), ""), rest)).otherwise(F.col("text"))
    out = out.select("kept", text.alias("text"))
    for kind in KINDS:
        out = out.withColumn("found", F.regexp_extract_all("text", F.lit(PATTERNS[kind]), F.lit(0)))
        out = out.withColumn("gaps", F.when(F.size("found") > 0, F.split("text", PATTERNS[kind], -1)))
        marks = F.transform("found", _marked(kind))
        joined = F.array_join(F.zip_with("gaps", marks, lambda gap, m: F.concat(gap, F.coalesce(m, F.lit("")))), "")
        out = out.select("kept", F.when(F.size("found") > 0, joined).otherwise(F.col("text")).alias("text"))
    return out.select(*[F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns])
