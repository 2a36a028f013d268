r"""Personal data: exact base patterns, and contextual extraction bootstrapped from what they find.

Base kinds are found by pattern and check, with code point positions. They are the seeds. The
words around a mention make its lexical patterns; mentions of other tokens with a digit or an
at sign are candidates, and so are runs of them that can be one number written with spaces.
Of candidates that lie in each other the longest counts for its patterns; all can be found. Patterns and instances form a graph that Spark scores in rounds: a
pattern's confidence for a kind is the mean score of its instances, a candidate's score is
one minus the product of its patterns' doubts. A candidate becomes a span where a pattern of
high confidence stands around it, its score is high and its form suits the kind.

The base patterns below match what the plain ones match. A run of characters is entered at
its start only (``\G`` lets one begin where the last match ended) and never given back, so
that long runs take linear time and no stack.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigspark.llm.common import discard, materialize, running_sums, skew_join

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "token": r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]", "token": r"[0-9@]"}
#: Identifiers written with spaces: a token that such a number can begin with, go on with and end with, and what may stand between two of its tokens.
HEAD, BODY, LAST, GAP = r"^[^\s0-9@]*[0-9][0-9().-]*$", r"^[(.-]*[0-9][0-9().-]*$", r"^[(.-]*[0-9](?:[().-]*[0-9])*", r"^[\x20().-]+$"
#: Digits of a candidate of several tokens: the least and most that a form allows.
LEAST, MOST = 7, 19
#: Forms of a candidate by kind.
FORMS = {
    "email": r"^[^@\s]+@[^@\s]+$",
    "ip": r"^[^0-9]?[0-9]{1,3}(?:[.:,-][0-9]{1,3}){3}[^0-9]?$",
    "card": r"^(?:[^0-9]*[0-9]){12,19}[^0-9]*$",
    "phone": r"^(?:[^0-9]*[0-9]){7,15}[^0-9]*$",
}
#: Rounds; distinct instances that a pattern needs; confidence that passes a score on; confidence and score of a new span.
ROUNDS, SUPPORT, PASSES, SURE, SCORE = 3, 5, 0.5, 0.9, 0.95
_NEAR = 64


def _valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(16, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _around(chunks: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """The ``_NEAR`` characters of a text before ``start`` and from ``end`` on, from its chunks of that length."""
    chunk = lambda i: F.coalesce(F.get(chunks, i.cast("int")), F.lit(""))
    at = lambda x: (F.floor(x / _NEAR), (x % _NEAR).cast("int"))
    (a, before), (b, after) = at(start), at(end)
    left = F.concat(F.when(a > 0, chunk(a - 1)).otherwise(""), F.substring(chunk(a), F.lit(1), before))
    right = F.concat(F.substring(chunk(b), after + 1, F.lit(_NEAR)), chunk(b + 1))
    return F.right(left, F.lit(_NEAR)), F.substring(right, 1, _NEAR)


def _span(start: Column, value: Column, chunks: Column) -> Column:
    end = start + F.length(value)
    left, right = _around(chunks, start, end)
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"), left.alias("left"), right.alias("right"))


def _placed(values: Column, parts: Column, sums: Column, chunks: Column) -> Column:
    """(start, end, value, left, right) of each match, from the matches, the text between them, the sums of both and the text's chunks."""
    return F.transform(values, lambda value, i: _span(F.get(sums, i) + F.length(F.get(parts, i)), value, chunks))


def _digits(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def _runs(tokens: Column, parts: Column, sums: Column, chunks: Column) -> Column:
    """Spans like ``_placed``'s of two and more neighbouring tokens that can be one number written with spaces, as long as ``MOST`` digits allow."""
    joins = lambda i: F.get(parts, i).rlike(GAP) & F.get(tokens, i).rlike(LAST)
    none = F.array().cast("array<string>")
    state = lambda so_far, open_, out: F.struct(so_far.alias("so_far"), open_.alias("open"), out.alias("out"))

    def on(s: Column, j: Column) -> Column:
        ahead = F.concat(s["so_far"], F.get(parts, j))
        value = F.concat(ahead, F.regexp_extract(F.get(tokens, j), LAST, 0))
        goes = s["open"] & joins(j)
        more = F.when(goes & _digits(value).between(LEAST, MOST), F.array_append(s["out"], value)).otherwise(s["out"])
        return F.when(goes, state(F.concat(ahead, F.get(tokens, j)), F.get(tokens, j).rlike(BODY) & (_digits(value) < MOST), more)).otherwise(state(s["so_far"], F.lit(False), s["out"]))

    def of(token: Column, i: Column) -> Column:
        last = F.least(i + MOST, F.size(tokens) - 1)
        found = F.aggregate(F.sequence(i + 1, last), state(token, F.lit(True), none), on, lambda s: s["out"])
        values = F.when((i + 1 < F.size(tokens)) & token.rlike(HEAD) & joins(i + 1), found).otherwise(none)
        return F.transform(values, lambda v: _span(F.get(sums, i) + F.length(F.get(parts, i)), v, chunks))

    return F.flatten(F.transform(tokens, of))


def _checked(kind: str, spans: Column) -> Column:
    return F.filter(spans, lambda s: _valid(kind, s["value"]))


def _tagged(kind: str) -> Column:
    name = F.lit(kind if kind in KINDS else None).cast("string").alias("kind")
    return F.transform(F.col(kind), lambda s: F.struct(name, s.alias("s")))


def _mentions(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text, and for each kind and for tokens an array of (start, end, value, left, right)."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    df = df.withColumn("h", F.xxhash64("text"))
    none = F.array().cast("array<string>")
    for kind, pattern in PATTERNS.items():
        try_ = F.col("text").rlike(HINTS[kind])
        df = df.withColumn(f"m_{kind}", F.when(try_, F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).otherwise(none))
        df = df.withColumn(f"p_{kind}", F.when(F.size(f"m_{kind}") > 0, F.split("text", pattern, -1)).otherwise(none))
    some = F.greatest(*[F.size(f"m_{kind}") for kind in PATTERNS]) > 0
    df = df.withColumn("chunks", F.when(some, F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{_NEAR}}}"), F.lit(0))).otherwise(none)).drop("text")
    for kind in PATTERNS:
        m, p = F.col(f"m_{kind}"), F.col(f"p_{kind}")
        df = df.withColumn(f"s_{kind}", running_sums(F.zip_with(m, F.slice(p, 1, F.size(m)), lambda a, b: (F.length(a) + F.length(b)).cast("long"))))
        args = m, p, F.col(f"s_{kind}"), F.col("chunks")
        spans = _placed(*args)
        df = df.withColumn(kind, _checked(kind, spans) if kind in KINDS else F.concat(spans, _runs(*args)))
    return df.select("doc_id", "h", *PATTERNS)


def _occurrences(mentions: DataFrame) -> DataFrame:
    """Rows (doc_id, h, kind, start, end, inst, patterns, whole): base spans, and candidates that touch none, whose kind is null."""
    tagged = F.concat(*map(_tagged, PATTERNS))
    rows = mentions.select("doc_id", "h", F.explode(tagged).alias("x")).select("doc_id", "h", "x.kind", "x.s.*").distinct()
    inside = Window.partitionBy("doc_id", "h").orderBy("start", F.col("kind").asc_nulls_last(), "end")
    reach = F.max(F.when(F.col("kind").isNotNull(), F.col("end"))).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    ahead = F.min(F.when(F.col("kind").isNotNull(), F.col("start"))).over(inside.rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("reach", reach).withColumn("ahead", ahead)
    touches = (F.coalesce("reach", F.lit(-1)) > F.col("start")) | (F.coalesce("ahead", F.lit(1 << 60)) < F.col("end"))
    rows = rows.where(F.col("kind").isNotNull() | ~touches)
    # Parts of a longer candidate are no mentions of their own.
    longer = Window.partitionBy("doc_id", "h", F.col("kind").isNull()).orderBy("start", F.desc("end"))
    covered = F.coalesce(F.max("end").over(longer.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)) >= F.col("end")
    rows = rows.withColumn("whole", F.col("kind").isNotNull() | ~covered)
    word = lambda c, i: F.lower(F.coalesce(F.try_element_at(F.filter(F.split(c, r"\s+"), lambda w: w != ""), F.lit(i)), F.lit("^")))
    before, two, after = word(F.col("left"), -1), word(F.col("left"), -2), word(F.col("right"), 1)
    patterns = F.array(F.concat_ws(" ", two, before, F.lit("_")), F.concat_ws(" ", before, F.lit("_"), after))
    inst = F.lower(F.regexp_replace("value", r"[.,;:!?]+$", ""))
    end = F.col("start") + F.length(F.regexp_replace("value", r"[.,;:!?]+$", ""))
    end = F.when(F.col("kind").isNull(), end).otherwise(F.col("end"))
    return rows.select("doc_id", "h", "kind", "start", end.alias("end"), inst.alias("inst"), patterns.alias("patterns"), "whole").where("end > start")


def discover(occurrences: DataFrame) -> DataFrame:
    """(doc_id, h, kind, start, end) of the spans that the pattern graph adds, from occurrences in shared storage.

    With E the distinct edges (pattern, instance) of whole mentions, s the scores, 1 for base
    instances and 0 for others at first: a pattern's confidence for a kind is the sum of s
    over its instances, over their number (SUPPORT at least, or the pattern says nothing); a
    candidate's s is 1 less the product of 1 - confidence (0.999 at most) over its patterns
    with a confidence of PASSES. No occurrence gives no span; rows that repeat count once.
    """
    all_edges = occurrences.select(F.explode("patterns").alias("pattern"), "inst", "kind", "whole")
    all_edges = materialize(all_edges.groupBy("pattern", "inst", "kind").agg(F.max("whole").alias("whole")), "edges")
    edges = all_edges.where("whole")
    wide = edges.groupBy("pattern").agg(F.countDistinct("inst").alias("n")).where(F.col("n") >= SUPPORT)
    seeds = edges.where("kind IS NOT NULL").select("inst", "kind", F.lit(1.0).alias("score")).distinct()
    pairs = edges.select("pattern", "inst").distinct()
    pairs, wide, seeds = (materialize(t, name) for t, name in ((pairs, "pairs"), (wide, "wide"), (seeds, "seeds")))
    open_ = all_edges.where("kind IS NULL").select("pattern", "inst")
    scores = seeds
    # A pattern or an instance may be in a large part of all edges; there are at most four kinds of each.
    for i in range(ROUNDS):
        sums = skew_join(pairs, scores, ["inst"]).groupBy("pattern", "kind").agg(F.sum("score").alias("s"))
        sure = sums.join(wide, "pattern").select("pattern", "kind", (F.col("s") / F.col("n")).alias("confidence")).where(F.col("confidence") >= PASSES)
        sure = materialize(sure, "patterns")
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.999))))
        new = skew_join(open_, sure, ["pattern"]).groupBy("inst", "kind").agg((1 - F.exp(doubt)).alias("score"))
        old, scores = scores, materialize(seeds.unionByName(new).groupBy("inst", "kind").agg(F.max("score").alias("score")), "scores")
        if i:
            discard(old)
        if i + 1 < ROUNDS:
            discard(sure)
    fits = F.coalesce(*[F.when(F.col("kind") == k, F.col("inst").rlike(form)) for k, form in FORMS.items()], F.lit(False))
    good = scores.where((F.col("score") >= SCORE) & fits).select("inst", "kind")
    known = sure.where(F.col("confidence") >= SURE).select("pattern", "kind")
    open_rows = occurrences.where("kind IS NULL").select("doc_id", "h", "start", "end", "inst", F.explode("patterns").alias("pattern"))
    spans = skew_join(materialize(skew_join(open_rows, known, ["pattern"]).drop("pattern").distinct(), "known"), good, ["inst", "kind"])
    spans = spans.select("doc_id", "h", "kind", "start", "end", F.col("inst").rlike(r"\s").alias("spaced")).distinct()
    # Of spaced spans of a kind that lie in each other only the longest stays.
    longer = Window.partitionBy("doc_id", "h", "kind").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(longer), F.lit(-1)))
    return spans.where(~F.col("spaced") | (F.col("reach") < F.col("end"))).select("doc_id", "h", "kind", "start", "end")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row a document: (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans).

    Counts and ``base_sha256`` cover base spans; ``spans`` has all. Spans are written
    kind:start:end, by kind as in ``KINDS``, then start, joined by commas; positions are code
    points, ends exclusive. Null text is empty; an empty text has no span. Rows that repeat
    each get a row with the same spans. An empty table gives no rows; other columns are
    ignored. A candidate that could be of two kinds is a span of each.
    """
    mentions = materialize(_mentions(docs), "mentions")
    added = discover(materialize(_occurrences(mentions), "occurrences"))
    tag = lambda k, a: F.transform(a, lambda s: F.struct(F.lit(KINDS.index(k)).alias("at"), s["start"].alias("start"), s["end"].alias("end")))
    base = F.concat(*[tag(k, F.col(k)) for k in KINDS])
    order = F.coalesce(*[F.when(F.col("kind") == k, i) for i, k in enumerate(KINDS)])
    added = added.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_list(F.struct(order.alias("at"), "start", "end")).alias("more"))
    names = F.array(*map(F.lit, KINDS))
    text = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.get(names, s["at"]), s["start"], s["end"])), ",")
    rows = mentions.select("doc_id", "h", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], base.alias("base"))
    rows = rows.join(added, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    return rows.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2(text(F.col("base")), 256).alias("base_sha256"), text(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))
