"""Personal data by candidate gradient boosting, all in DataFrame expressions.

High-recall patterns propose overlapping spans of four kinds.  Boosted trees
(Spark's GBTClassifier) score every candidate by its format and context; a
threshold for each kind, calibrated on held-out candidates, selects further
spans beside those of the base rules, which always stay.  The trees become one
SQL expression, so that scoring is a map over rows without any shuffle.

Labels are evidence on each candidate's own text (checksum, digit counts,
octet limits, whole shape), so spans that the base rules miss can be true; copies
of the texts with '+' and '@' rewritten add such cases.  A candidate that meets
a base span is true only if it is one.  Thresholds count only candidates that
meet no base span.  Patterns use possessive quantifiers, which match alike and need no
recursion on long runs.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import stored, unwrapped

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
#: base rules: a text may hold a match of the kind if the first pattern occurs; then the pattern itself
BASE = {
    "email": ("@", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][ -]?[0-9]", r"[0-9](?:[ -]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]"),
}
#: generators: wider patterns of the same kinds
WIDE = {
    "email": (r"(?i)@|[(\[{]at[)\]}]", rf"(?i)(?<!{LOCAL}){LOCAL}++ ?(?:@|[(\[{{]at[)\]}}]) ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[{{]dot[)\]}}]) ?[A-Za-z0-9-]++)*+"),
    "plain": ("@", rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{{2,}}+"),
    "ip": (r"[0-9A-Fa-f][.:][0-9A-Fa-f:]", r"(?<![0-9A-Fa-f.:])(?:[0-9]{1,3}+(?:\.[0-9]{1,3}+){3}+(?::[0-9]++)?+|[0-9A-Fa-f]{1,4}+(?:::?[0-9A-Fa-f]{1,4}+){4,7}+)(?![0-9A-Fa-f.:])"),
}
#: the kinds of these generators; cards, phones and further addresses begin and end at any digit groups of a run
WIDE_KINDS = {"email": 0, "plain": 0, "ip": 1}
RUN = ("[0-9][ ()./+-]{0,3}[0-9]", r"(?:\+\(?|\()?[0-9]++(?:[ ()./+-]{1,3}[0-9]++)*+")
#: digits of a card's and a phone's candidates: some more and fewer than can be valid, as counterexamples
CARD_DIGITS, PHONE_DIGITS = (10, 21), (7, 17)
CUES = {"email": "mail|contact|write|reply", "ip": "ip|host|server|addr", "card": "card|visa|credit|pay", "phone": "tel|phone|call|fax|mobile|mob"}
SPAN = "array<struct<start:int,kind:int,end:int,hit:string>>"
FEATURES = ("kind", "size", "digits", "seps", "letters", "groups", "first_group", "last_group", "plus", "parens", "before", "after", "cue", "near_digits", "checks")
#: items of a list that a fold makes at once
BLOCK = 128
#: different candidates that a task learns from, and the least held-out precision of a kind's further spans
LEARN_ROWS = 100_000
PRECISION = 0.95


def literal(pattern: str) -> str:
    return "r'" + pattern + "'"


def luhn(digits: str) -> str:
    """SQL: whether a string of digits passes the Luhn check."""
    one = f"cast(substring({digits}, -i, 1) as int)"
    twice = f"CASE WHEN i % 2 = 1 THEN {one} WHEN {one} > 4 THEN 2 * {one} - 9 ELSE 2 * {one} END"
    return f"aggregate(sequence(1, char_length({digits})), 0, (a, i) -> a + {twice}) % 10 = 0"


def valid(kind: str, hit: str) -> str:
    """SQL: whether a base match holds."""
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    if kind == "ip":
        return f"forall(split({hit}, '[.]'), p -> char_length(ltrim('0', p)) <= 3 AND cast(concat('0', ltrim('0', p)) as int) <= 255)"
    if kind == "card":
        return f"CASE WHEN char_length({digits}) BETWEEN 12 AND 19 THEN {luhn(digits)} ELSE false END"
    if kind == "phone":
        return f"char_length({digits}) BETWEEN 9 AND 15"
    return "true"


def with_matches(df: DataFrame, name: str, kind: int, may: str, pattern: str) -> DataFrame:
    """Adds ``name``: the leftmost non-overlapping matches of a pattern in ``body``, as spans in code points.

    The matches and the texts between them tell where each begins.
    """
    found, between, steps = f"{name}_found", f"{name}_between", f"{name}_steps"
    # both lists are arguments: Spark would evaluate a list that only a lambda names once for each item
    step = f"zip_with({found}, slice({between}, 1, size({found})), (f, b) -> named_struct('skip', char_length(b), 'size', char_length(f), 'hit', f))"
    spans = in_blocks(steps, "x -> x.skip + x.size", "0", SPAN,
                      f"named_struct('start', a.at + x.skip, 'kind', {kind}, 'end', a.at + x.skip + x.size, 'hit', x.hit)")
    return (df.withColumn(found, F.expr(f"CASE WHEN body RLIKE {literal(may)} THEN regexp_extract_all(body, {literal(pattern)}, 0) ELSE cast(array() as array<string>) END"))
            .withColumn(between, F.expr(f"CASE WHEN size({found}) > 0 THEN split(body, {literal(pattern)}, -1) END"))
            .withColumn(steps, F.expr(f"CASE WHEN size({found}) > 0 THEN {step} END"))
            .withColumn(name, F.expr(f"CASE WHEN size({found}) > 0 THEN {spans} ELSE cast(array() as {SPAN}) END")).drop(found, between, steps))


def in_blocks(steps: str, moves: str, start: str, kind: str, item: str) -> str:
    """SQL: ``item`` for each ``x`` of the array ``steps``, where ``a.at`` is ``start`` plus what the steps before it move.

    A list that grows by one in a fold is copied for each item, so a fold makes
    only the lists of BLOCK items; sums of the blocks before it tell where each
    begins.  The work goes as the number of items times BLOCK, not as its square.
    """
    blocks = f"sequence(0, CAST((size({steps}) - 1) DIV {BLOCK} AS INT))"
    sums = f"transform({blocks}, b -> aggregate(transform(slice({steps}, b * {BLOCK} + 1, {BLOCK}), {moves}), 0, (t, y) -> t + y))"
    begins = f"aggregate({sums}, named_struct('at', {start}, 'out', cast(array() as array<int>)), (a, t) -> named_struct('at', a.at + t, 'out', concat(a.out, array(a.at))), a -> a.out)"
    move = moves.split("->")[1]
    one = f"""aggregate(slice({steps}, b * {BLOCK} + 1, {BLOCK}), named_struct('at', at, 'out', cast(array() as {kind})),
        (a, x) -> named_struct('at', a.at + {move}, 'out', concat(a.out, array({item}))), a -> a.out)"""
    return f"flatten(transform({begins}, (at, b) -> {one}))"


def with_base(df: DataFrame) -> DataFrame:
    """Adds ``base``: the valid base spans of ``body``, by start, then kind."""
    for k, kind in enumerate(KINDS):
        df = with_matches(df, f"base_{kind}", k, *BASE[kind])
    kept = ", ".join(f"filter(base_{kind}, s -> {valid(kind, 's.hit')})" for kind in KINDS)
    return df.withColumn("base", F.expr(f"array_sort(concat({kept}))")).drop(*[f"base_{kind}" for kind in KINDS])


def with_runs(df: DataFrame) -> DataFrame:
    """Adds ``runs``: spans of cards, phones and dotted quads, from each digit group of a run of groups to each later one."""
    df = with_matches(df, "whole", -1, *RUN)
    df = df.withColumn("split", F.expr("transform(whole, r -> named_struct('start', r.start, 'found', regexp_extract_all(r.hit, '[0-9]+', 0), 'between', split(r.hit, '[0-9]+', -1)))")).drop("whole")
    group = "struct<head:int,at:int,end:int,before:int,upto:int,dots:int>"
    # a group's place (with a sign before it: head), the digits up to it and the single dots
    one = """named_struct('head', a.at + char_length(r.between[i - 1]) - char_length(regexp_extract(r.between[i - 1], '([+]?[(]?)$', 1)), 'at', a.at + char_length(r.between[i - 1]),
        'end', a.at + char_length(r.between[i - 1]) + char_length(r.found[i - 1]), 'before', a.n, 'upto', a.n + char_length(r.found[i - 1]), 'dots', a.dots + int(r.between[i - 1] = '.'))"""
    groups = f"""aggregate(sequence(1, size(r.found)), named_struct('at', r.start, 'n', 0, 'dots', 0, 'out', cast(array() as array<{group}>)),
        (a, i) -> named_struct('at', a.at + char_length(r.between[i - 1]) + char_length(r.found[i - 1]), 'n', a.n + char_length(r.found[i - 1]), 'dots', a.dots + int(r.between[i - 1] = '.'),
            'out', concat(a.out, array({one}))), a -> a.out)"""
    df = df.withColumn("groups", F.expr(f"transform(split, r -> {groups})")).drop("split")
    made = lambda test, start, kind: f"CASE WHEN {test} THEN named_struct('start', {start}, 'kind', {kind}, 'end', e.end) END"
    digits = "e.upto - b.before BETWEEN {} AND {}"
    kinds = ", ".join([made("j = 3 AND e.dots - b.dots = 3", "b.at", 1), made(digits.format(*CARD_DIGITS), "b.at", 2), made(digits.format(*PHONE_DIGITS), "b.head", 3)])
    most = max(*CARD_DIGITS, *PHONE_DIGITS)
    spans = f"flatten(transform(groups, g -> flatten(transform(g, (b, i) -> flatten(transform(slice(g, i + 1, {most}), (e, j) -> filter(array({kinds}), s -> s IS NOT NULL)))))))"
    hit = "named_struct('start', s.start, 'kind', s.kind, 'end', s.end, 'hit', substring(body, s.start + 1, s.end - s.start))"
    return df.withColumn("places", F.expr(spans)).drop("groups").withColumn("runs", F.expr(f"transform(places, s -> {hit})")).drop("places")


def quad_of(hit: str) -> str:
    """SQL: a dotted quad without its port."""
    return f"substring_index({hit}, ':', 1)"


def evidence(hit: str, before: str, after: str) -> str:
    """SQL: whether a candidate holds by itself, whatever the base rules find."""
    digits = f"regexp_replace({hit}, '[^0-9]', '')"
    quad = rf"{hit} RLIKE r'^[0-9.]+(:[0-9]+)?$' AND {valid('ip', quad_of(hit))} AND NOT {before} RLIKE '[0-9.]' AND NOT {after} RLIKE '[0-9]'"
    six = f"{hit} RLIKE '[:].*[:]' AND (size(split({hit}, ':')) = 8 OR contains({hit}, '::'))"
    mail = rf"regexp_replace(regexp_replace({hit}, r'(?i) ?[(\[{{]at[)\]}}] ?', '@'), r'(?i) ?[(\[{{]dot[)\]}}] ?', '.') RLIKE r'^{LOCAL}+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)*\.[A-Za-z]{{2,}}$'"
    card = f"{hit} RLIKE r'^[0-9]([ ./-]?[0-9])+$' AND NOT {before} RLIKE '[A-Za-z0-9]' AND NOT {after} RLIKE '[A-Za-z0-9]' AND {valid('card', hit)}"
    shape = f"(startswith({hit}, '+') OR {hit} RLIKE r'[0-9]+[^0-9]+[0-9]+[^0-9]+[0-9]{{3,5}}$') AND char_length(replace({hit}, '(', '')) = char_length(replace({hit}, ')', ''))"
    phone = f"{valid('phone', hit)} AND {shape} AND NOT {before} RLIKE '[A-Za-z0-9+(]' AND NOT {after} RLIKE '[A-Za-z0-9]'"
    return f"CASE c.s.kind WHEN 0 THEN {mail} WHEN 1 THEN (CASE WHEN contains({hit}, '.') THEN {quad} ELSE {six} END) WHEN 2 THEN {card} ELSE {phone} END"


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds ``candidates``: the generators' spans, which overlap, with their features, ``free``, whether one meets no base span, and ``label``, whether it holds."""
    for name, kind in WIDE_KINDS.items():
        df = with_matches(df, f"wide_{name}", kind, *WIDE[name])
    df = with_runs(df)
    # each span once: plain dotted quads are in runs already
    once = "concat(runs, wide_email, array_except(wide_plain, wide_email), filter(wide_ip, s -> contains(s.hit, ':')))"
    df = df.withColumn("wide", F.expr(once)).drop("runs", *[f"wide_{name}" for name in WIDE_KINDS])
    sides = "named_struct('s', s, 'left', substring(body, greatest(s.start - 24, 0) + 1, least(24, s.start)), 'right', substring(body, s.end + 1, 8), 'runs', filter(split(s.hit, '[^0-9]+'), g -> g <> ''))"
    df = df.withColumn("seen", F.expr(f"transform(wide, s -> {sides})")).drop("wide")
    char = lambda c: f"CASE WHEN {c} = '' THEN 0D WHEN {c} RLIKE '[0-9]' THEN 1D WHEN {c} RLIKE '[A-Za-z]' THEN 2D WHEN {c} RLIKE '[ \\t\\r\\n]' THEN 3D ELSE 4D END"
    number = lambda x: f"cast({x} as double)"
    values = {
        "kind": number("c.s.kind"), "size": number("char_length(c.s.hit)"), "digits": number("char_length(regexp_replace(c.s.hit, '[^0-9]', ''))"),
        "seps": number("char_length(regexp_replace(c.s.hit, '[^ ./()-]', ''))"), "letters": number("char_length(regexp_replace(c.s.hit, '[^A-Za-z]', ''))"),
        "groups": number("size(c.runs)"), "first_group": number("coalesce(char_length(get(c.runs, 0)), 0)"), "last_group": number("coalesce(char_length(get(c.runs, size(c.runs) - 1)), 0)"),
        "plus": number("CASE WHEN startswith(c.s.hit, '+') OR endswith(c.left, '+') THEN 1 ELSE 0 END"), "parens": number("CASE WHEN contains(c.s.hit, '(') THEN 1 ELSE 0 END"),
        "before": char("right(c.left, 1)"), "after": char("left(c.right, 1)"),
        "cue": "CASE c.s.kind " + " ".join(f"WHEN {k} THEN CASE WHEN c.left RLIKE r'(?i){CUES[kind]}' THEN 1D ELSE 0D END" for k, kind in enumerate(KINDS)) + " END",
        "checks": f"CASE c.s.kind WHEN 1 THEN CASE WHEN contains(c.s.hit, '.') THEN CASE WHEN {valid('ip', quad_of('c.s.hit'))} THEN 1D ELSE 0D END WHEN size(split(c.s.hit, ':')) = 8 OR contains(c.s.hit, '::') THEN 1D ELSE 0D END WHEN 2 THEN CASE WHEN {valid('card', 'c.s.hit')} THEN 1D ELSE 0D END ELSE 1D END",
        "near_digits": number("char_length(regexp_replace(concat(c.left, c.right), '[^0-9]', ''))"),
    }
    made = ", ".join(f"'{n}', {values[n]}" for n in FEATURES)
    free = "NOT exists(base, b -> b.start < c.s.end AND c.s.start < b.end)"
    label = f"CASE WHEN {free} THEN {evidence('c.s.hit', 'right(c.left, 1)', 'left(c.right, 1)')} ELSE exists(base, b -> b.kind = c.s.kind AND b.start = c.s.start AND b.end = c.s.end) END"
    return df.withColumn("candidates", F.expr(f"transform(seen, c -> named_struct('start', c.s.start, 'kind', c.s.kind, 'end', c.s.end, 'free', {free}, 'label', {label}, 'x', named_struct({made})))")).drop("seen")


@dataclass(frozen=True)
class Model:
    """``margin``: SQL for a candidate's score from its features ``c.x`` (none learnt: null); ``least``: the threshold of each kind."""

    margin: str | None
    least: tuple[float, ...]

    def probability(self) -> str:
        return f"1D / (1D + exp(-2D * ({self.margin})))"


def tree_sql(debug: str) -> str:
    """A tree's description by Spark as a nested CASE over ``c.x``."""
    lines = [line.strip() for line in debug.splitlines() if re.match(r"\s*(If|Else|Predict)", line)]
    at = 0

    def node() -> str:
        nonlocal at
        line = lines[at]
        at += 1
        if line.startswith("Predict"):
            return f"{float(line.split(':')[1])!r}D"
        feature, cut = re.match(r"If \(feature (\d+) <= ([-0-9.E]+)\)", line).groups()
        low = node()
        at += 1  # Else
        return f"CASE WHEN c.x.{FEATURES[int(feature)]} <= {float(cut)!r}D THEN {low} ELSE {node()} END"

    return node()


def fit(docs: DataFrame, text_col: str = "text", precision: float = PRECISION) -> Model:
    """Train on the candidates of all documents; four fifths fit the trees, the rest the thresholds (a hash of a candidate chooses).

    Copies of the texts without '+' and with '[at]' for '@' teach too.  A
    kind's threshold is the lowest at which held-out candidates that score
    higher, and meet no base span, are valid at the wanted rate; a kind without one selects nothing, and
    neither does any if there are no candidates of both labels.  Candidates
    alike in features and label are one row with their number as its weight;
    equal documents count as often as they occur.
    """
    rows = docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    contrast = F.regexp_replace(F.regexp_replace("body", r"\+(?=[0-9])", ""), "@", "[at]")
    rows = rows.unionByName(rows.select(contrast.alias("other"), "body").where("other <> body").select(F.col("other").alias("body")))
    # written first: a filter that Spark infers for explode() would repeat all patterns for every candidate
    spans = stored(with_candidates(with_base(rows)).select("candidates"), "spans").select(F.explode("candidates").alias("c"))
    kept = ("x", "free", "label", "held")
    rows = stored(spans.select("c.x", "c.free", F.col("c.label").cast("double").alias("label"), (F.pmod(F.xxhash64("c"), F.lit(5)) == 0).alias("held"))
                  .groupBy(*kept).agg(F.count(F.lit(1)).alias("n")), "candidates")
    learn = rows.where("NOT held").groupBy("x", "label").agg(F.sum("n").cast("double").alias("n"))
    size = {r["label"]: r["rows"] for r in learn.groupBy("label").agg(F.count(F.lit(1)).alias("rows")).collect()}
    if len(size) < 2:
        return Model(None, (2.0,) * len(KINDS))
    # one layout and one order of the rows, by their values, and a fixed seed: a rerun learns the same trees
    flat = [f"x.{f}" for f in FEATURES]
    learn = learn.repartition(math.ceil(sum(size.values()) / LEARN_ROWS), "x", "label").sortWithinPartitions(*flat, "label")
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(learn.select("label", "n", "x.*"))
    trees = GBTClassifier(maxIter=8, maxDepth=3, maxBins=24, seed=42, cacheNodeIds=False, weightCol="n").fit(vectors.select("label", "n", "features"))
    margin = " + ".join(f"{float(w)!r}D * ({tree_sql(t.toDebugString)})" for w, t in zip(trees.treeWeights, trees.trees))
    p = Model(margin, ()).probability().replace("c.x.", "x.")
    bins = rows.where("held AND free").select(F.col("x.kind").cast("int").alias("kind"), F.expr(f"floor(100 * ({p}))").alias("bin"), "label", "n").groupBy("kind", "bin").agg(F.sum("n").alias("n"), F.sum(F.col("label") * F.col("n")).alias("good")).collect()
    least = []
    for kind in range(len(KINDS)):
        n = good = 0.0
        at = 2.0
        for b in sorted((b for b in bins if b["kind"] == kind), key=lambda b: -b["bin"]):
            n, good = n + b["n"], good + b["good"]
            if good >= precision * n:
                at = b["bin"] / 100
        least.append(max(at, 0.5))
    return Model(margin, tuple(least))


def find(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of (start, kind, end, hit) by start, then kind.

    ``spans`` holds the base spans and the selected candidates: those at or
    above their kind's threshold that meet no base span and no selected
    candidate of a higher score (ties: the earlier, then the kind listed first,
    then the shorter).  Whole texts count; null and empty texts have no spans;
    equal texts have equal spans; the other columns stay, but for ones of these
    names; an empty table stays empty.  No shuffle and no group.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("body"))
    rows = with_base(rows)
    if model.margin is None:
        return unwrapped(rows.withColumn("spans", F.col("base")), "base", "spans")
    rows = with_candidates(rows)
    least = "array(" + ", ".join(f"{x!r}D" for x in model.least) + ")"
    scored = rows.withColumn("scored", F.expr(f"""array_sort(filter(transform(filter(candidates, c -> c.free),
        c -> named_struct('worse', -{model.probability()}, 'start', c.start, 'kind', c.kind, 'end', c.end)), c -> -c.worse >= {least}[c.kind]))""")).drop("candidates")
    span = "struct<start:int,kind:int,end:int,hit:string>"
    more = f"""aggregate(scored, cast(array() as array<{span}>), (a, c) -> CASE WHEN exists(a, o -> o.start < c.end AND c.start < o.end) THEN a
        ELSE concat(a, array(named_struct('start', c.start, 'kind', c.kind, 'end', c.end, 'hit', substring(body, c.start + 1, c.end - c.start)))) END)"""
    return unwrapped(scored.withColumn("spans", F.expr(f"array_sort(concat(base, {more}))")), "base", "spans")


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def listed(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with each found span replaced by its kind in brackets, like ``[EMAIL]``.

    Spans that overlap become one mark, of the first.  Null texts stay null;
    all columns and rows stay.
    """
    found = find(docs.withColumn("_keep", F.struct(*[F.col(f"`{c}`") for c in docs.columns])).select("_keep", F.col(f"`{text_col}`").alias("_text")), model, "_text")
    cut = f"""aggregate(spans, named_struct('at', 0, 'out', cast(array() as array<string>)),
        (a, s) -> CASE WHEN s.start >= a.at THEN named_struct('at', s.end, 'out', concat(a.out, array(substring(_text, a.at + 1, s.start - a.at), concat('[', upper(element_at(array({', '.join(repr(k) for k in KINDS)}), s.kind + 1)), ']'))))
                       ELSE named_struct('at', greatest(a.at, s.end), 'out', a.out) END,
        a -> concat(array_join(a.out, ''), substring(_text, a.at + 1)))"""
    clean = F.when(F.size("spans") == 0, F.col("_text")).otherwise(F.expr(cut))
    return found.withColumn("_clean", clean).select(*[(F.col("_clean") if c == text_col else F.col("_keep")[c]).alias(c) for c in docs.columns])
