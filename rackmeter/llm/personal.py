"""Personal data in texts: fixed base rules, and spans chosen by boosted trees. Built from SQL functions alone.

Two sorts of patterns run over each text. Base patterns with their checks give spans that always count. Generators of
high recall propose further, overlapping spans: addresses written out, numbers with other separators or without
their signs. A candidate is described by its format, once such disguises are taken off, and by what stands
around it. Trees are boosted by logistic loss to tell, from that description, candidates that the base rules accept
from all others. The signs that the base rules ask for are no features, so a candidate that looks like accepted
ones but lacks such a sign scores high as well. Per kind, a threshold on the score is calibrated on documents that
the trees did not see: the lowest one at which ``PRECISION`` of the candidates above it are accepted ones.

Training works on the counts of equal descriptions over all documents; each level of a tree is one aggregation for
all kinds, of which the driver gets a row per kind and node. Positions come from the lengths of matches and of what
stands between them, as splitting by a pattern and extracting it cut a text at the same places.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rackmeter.llm.common import stored

KINDS = ["email", "ip", "card", "phone"]

# Fixed values of the base rules. Possessive quantifiers and the places where a match may start keep them linear.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
CARD_DIGITS, PHONE_DIGITS, MAX_OCTET = (13, 19), (9, 15), 255

_AT, _DOT = r" ?[\[({]at[\])}] ?| at ", r" ?[\[({]dot[\])}] ?| dot "
GENERATORS = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++(?:@|" + _AT + r")[a-z0-9-]++(?:(?:\.|" + _DOT + r")[a-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(\.\)) ?[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ ./_-]{0,2}[0-9]){11,22}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+|00)?\(?[0-9](?:[ ()./-]{0,3}[0-9]){6,15}(?![0-9])",
}
HINTS = r"(?i)(mail|contact|tel|phone|call|fax|mobile|card|visa|host|server|address)[^a-z]{0,4}$"
FEATURES = [
    "digits", "others", "groups", "longest", "first", "last", "letters", "labels", "ending", "before", "after", "hint", "brackets",
]
AROUND = 24
CLIP = 24

ROUNDS, DEPTH, RATE, RIDGE, LEAST = 12, 2, 0.5, 1.0, 10
PRECISION, CALIBRATED = 0.9, 20
HELD_OUT = 5
PREFIX = 64


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _running(values: Column) -> Column:
    """Running totals of an array of ints, in two levels so that long arrays stay cheap."""
    block = lambda b: F.slice(values, b * PREFIX + 1, F.lit(PREFIX))
    blocks = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / PREFIX).cast("int"))

    def of_blocks(sums: Column) -> Column:
        before = F.transform(sums, lambda x, b: _total(F.slice(sums, F.lit(1), b)))
        inside = lambda part, start: F.transform(part, lambda x, i: start + _total(F.slice(part, F.lit(1), i + 1)))
        return F.flatten(F.transform(before, lambda start, b: _let(block(b), lambda part: inside(part, start))))

    return _let(F.transform(blocks, lambda b: _total(block(b))), of_blocks)


def matches(text: Column, pattern: str) -> Column:
    """All matches: array of (start, end, match, left, right) in code points, with the text on both sides."""
    kind = "array<struct<start:int,end:int,match:string,left:string,right:string>>"

    def placed(hits: Column, gaps: Column) -> Column:
        step = F.transform(hits, lambda h, i: F.char_length(F.get(gaps, i)) + F.coalesce(F.char_length(F.get(hits, i - 1)), F.lit(0)))
        starts = _let(step, _running)
        return _let(starts, lambda at: F.transform(hits, lambda h, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.char_length(h)).alias("end"), h.alias("match"),
            F.right(F.get(gaps, i), F.lit(AROUND)).alias("left"), F.left(F.get(gaps, i + 1), F.lit(1)).alias("right"),
        )))

    def found(hits: Column) -> Column:
        gaps = F.split(text, pattern, -1)
        return F.when(F.size(hits) > 0, _let(gaps, lambda g: placed(hits, g))).otherwise(F.array().cast(kind))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a card number fits."""
    backwards = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(backwards, i + 1, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), add) % 10 == 0


def _octet(part: Column) -> Column:
    small = F.char_length(F.ltrim(part, F.lit("0"))) <= 3
    return small & (F.right(F.concat(F.lit("00"), part), F.lit(3)).cast("int") <= MAX_OCTET)


#: What a match must pass.
CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "[.]"), _octet),
    "card": lambda m: _let(_digits(m), lambda d: F.char_length(d).between(*CARD_DIGITS) & _luhn(d)),
    "phone": lambda m: F.char_length(_digits(m)).between(*PHONE_DIGITS),
}
#: A character without which a text has no match, and patterns that take a disguise off.
NEEDED = {"email": "@", "ip": ".", "phone": "+"}
PLAIN = {
    "email": [(f"(?i){_AT}", "@"), (f"(?i){_DOT}", ".")], "ip": [(r" ?(?:\[\.\]|\(\.\)|\.) ?", ".")], "card": [],
    "phone": [(r"^(?:\+|00)", "")],
}


def accepted_inside(kind: str, candidate: Column) -> Column:
    """Whether a candidate holds a match that the base rules accept."""
    hits = F.regexp_extract_all(candidate, F.lit(BASE[kind]), F.lit(0))
    return F.exists(hits, CHECKS[kind])


def _description(kind: str, c: Column) -> list[Column]:
    """The features of a candidate, small whole numbers."""
    plain = reduce(lambda m, p: F.regexp_replace(m, *p), PLAIN[kind], c["match"])

    def side(character: Column) -> Column:
        return (
            F.when(character == "", 0).when(character.rlike(r"^\s$"), 1).when(character.rlike(r"^\p{L}$"), 2)
            .when(character.rlike("^[0-9]$"), 3).otherwise(4)
        )

    count = lambda pattern: F.size(F.regexp_extract_all(plain, F.lit(pattern), F.lit(0)))
    first = lambda pattern: F.char_length(F.regexp_extract(plain, pattern, 1))
    groups = F.regexp_extract_all(plain, F.lit("[0-9]+"), F.lit(0))
    digits = F.char_length(_digits(plain))
    values = {
        "digits": digits, "others": F.char_length(plain) - digits, "groups": F.size(groups),
        "longest": F.coalesce(F.array_max(F.transform(groups, F.char_length)), F.lit(0)),
        "first": first("([0-9]+)"), "last": first("([0-9]+)[^0-9]*$"), "letters": count("[A-Za-z]"),
        "labels": count("[A-Za-z]+"), "ending": first("([A-Za-z]+)$"), "before": side(F.right(c["left"], F.lit(1))),
        "after": side(c["right"]), "hint": c["left"].rlike(HINTS).cast("int"), "brackets": plain.contains("(").cast("int"),
    }
    return [F.least(values[f], F.lit(CLIP)).cast("int").alias(f) for f in FEATURES]


def with_candidates(docs: DataFrame, text: str = "text", base: str = "pd_base", candidates: str = "pd_candidates") -> DataFrame:
    """``docs`` with arrays of base spans (kind, start, end) and of described candidates, kinds by number.

    Null texts are empty. The two names must not be taken.
    """
    whole = F.coalesce(F.col(text), F.lit(""))

    def base_spans(number: int, kind: str) -> Column:
        hits = matches(whole, BASE[kind])
        if kind in NEEDED:
            hits = F.when(whole.contains(NEEDED[kind]), hits).otherwise(matches(F.lit(""), BASE[kind]))
        passed = F.filter(hits, lambda m: CHECKS[kind](m["match"]))
        return F.transform(passed, lambda m: F.struct(F.lit(number).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    def proposed(number: int, kind: str) -> Column:
        return F.transform(matches(whole, GENERATORS[kind]), lambda c: F.struct(
            F.lit(number).alias("kind"), c["start"].alias("start"), c["end"].alias("end"),
            accepted_inside(kind, c["match"]).alias("accepted"), *_description(kind, c),
        ))

    spans, others = ([f(n, k) for n, k in enumerate(KINDS)] for f in (base_spans, proposed))
    return docs.withColumns({base: F.concat(*spans), candidates: F.concat(*others)})


@dataclass
class Trees:
    """Boosted trees of each kind: prior, (splits, leaves) per tree, and the calibrated threshold (None: no extra spans)."""

    prior: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[tuple[dict[int, tuple[int, int]], dict[int, float]]]] = field(default_factory=dict)
    threshold: dict[int, float | None] = field(default_factory=dict)

    def score(self, kind: Column, feature: Callable[[str], Column]) -> Column:
        """Probability that a candidate is one that the rules would accept."""

        def value(splits: dict, leaves: dict, node: int) -> Column:
            if node not in splits:
                return F.lit(leaves.get(node, 0.0))
            number, most = splits[node]
            low, high = value(splits, leaves, 2 * node), value(splits, leaves, 2 * node + 1)
            return F.when(feature(FEATURES[number]) <= most, low).otherwise(high)

        out = F.lit(0.0)
        for k, prior in self.prior.items():
            margin = reduce(lambda a, t: a + value(*t, 1), self.trees[k], F.lit(prior))
            out = F.when(kind == k, 1 / (1 + F.exp(-margin))).otherwise(out)
        return out

    def chosen(self, kind: Column, feature: Callable[[str], Column]) -> Column:
        limits = {k: t for k, t in self.threshold.items() if t is not None}
        if not limits:
            return F.lit(False)
        limit = reduce(lambda out, k: F.when(kind == k, F.lit(limits[k])).otherwise(out), limits, F.lit(2.0))
        return self.score(kind, feature) >= limit


def _grow(rows: DataFrame, depth: int, rate: float, ridge: float, least: int) -> dict[int, tuple[dict, dict]]:
    """One tree for each kind on rows (kind, features, n, g, h): a job per level, a row back per kind and node."""
    grown: dict[int, tuple[dict, dict]] = {}
    node = F.lit(1)
    for level in range(depth):
        parts = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f).alias("v")) for i, f in enumerate(FEATURES)]))
        sums = rows.select("kind", node.alias("node"), "n", "g", "h", parts.alias("p")).groupBy("kind", "node", "p.f", "p.v").agg(
            F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h")
        )
        whole = Window.partitionBy("kind", "node", "f")
        upto = whole.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        both = sums.select("kind", "node", "f", "v", *[F.sum(c).over(w).alias(c + s) for c in "ngh" for w, s in ((upto, "l"), (whole, ""))])
        rest = lambda c: F.col(c) - F.col(c + "l")
        gain = (
            F.col("gl") ** 2 / (F.col("hl") + ridge) + rest("g") ** 2 / (rest("h") + ridge) - F.col("g") ** 2 / (F.col("h") + ridge)
        )
        fits = (F.col("nl") >= least) & (rest("n") >= least) & (gain > 1e-6)
        best = F.max(F.when(fits, F.struct(
            F.round(gain, 6).alias("gain"), (-F.col("f")).alias("f"), (-F.col("v")).alias("v"), "gl", "hl", rest("g").alias("gr"), rest("h").alias("hr"),
        )))
        for row in both.groupBy("kind", "node").agg(best.alias("b"), F.max("g").alias("g"), F.max("h").alias("h")).collect():
            splits, leaves = grown.setdefault(row.kind, ({}, {}))
            if row.b is None:
                leaves[row.node] = rate * row.g / (row.h + ridge)
                continue
            splits[row.node] = (-row.b.f, -row.b.v)
            leaves[2 * row.node] = rate * row.b.gl / (row.b.hl + ridge)
            leaves[2 * row.node + 1] = rate * row.b.gr / (row.b.hr + ridge)
        for kind, (splits, _) in grown.items():
            for at, (f, most) in splits.items():
                if at >= 1 << level:
                    here = (F.col("kind") == kind) & (node == at)
                    node = F.when(here, 2 * at + (F.col(FEATURES[f]) > most).cast("int")).otherwise(node)
        done = [(k, at) for k, (splits, leaves) in grown.items() for at in leaves if at < 2 << level]
        if done:
            rows = rows.where(~reduce(lambda a, d: a | (F.col("kind") == d[0]) & (node == d[1]), done, F.lit(False)))
    return grown


def train(
    found: DataFrame, key: str = "doc_id", candidates: str = "pd_candidates", rounds: int = ROUNDS, depth: int = DEPTH,
    rate: float = RATE, ridge: float = RIDGE, least: int = LEAST, precision: float = PRECISION, calibrated: int = CALIBRATED,
) -> Trees:
    """Trees and thresholds from the candidates of all rows of ``with_candidates``.

    Documents whose crc32(key) is divisible by ``HELD_OUT`` set the thresholds, the others grow the trees; a null key
    counts as an empty one. A kind without accepted and without other candidates on both sides gets no further spans.
    """
    held = F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0
    one = found.select(held.alias("held"), F.explode(candidates).alias("c")).select("held", "c.kind", "c.accepted", *[f"c.{f}" for f in FEATURES])
    counts = one.groupBy("held", "kind", *FEATURES).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("accepted").cast("int")).alias("pos"))
    counts = stored(counts.coalesce(1), "descriptions")
    seen = counts.where("not held")
    model = Trees()
    for row in seen.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), F.log((F.sum("pos") + 1) / (F.sum("n") - F.sum("pos") + 1)).alias("prior")).collect():
        if row.pos:
            model.prior[row.kind], model.trees[row.kind] = row.prior, []
    for _ in range(rounds if model.prior else 0):
        p = model.score(F.col("kind"), F.col)
        rows = seen.where(F.col("kind").isin(list(model.prior))).select(
            "kind", *FEATURES, "n", (F.col("pos") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h")
        )
        for kind, tree in _grow(rows, depth, rate, ridge, least).items():
            model.trees[kind].append(tree)
    # scores in thousandths: at most that many rows a kind are ranked
    level = F.floor(model.score(F.col("kind"), F.col) * 1000)
    levels = counts.where("held").groupBy("kind", level.alias("level")).agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    down = Window.partitionBy("kind").orderBy(F.desc("level"))
    above = levels.select("kind", "level", F.sum("n").over(down).alias("n"), F.sum("pos").over(down).alias("pos"))
    enough = above.where((F.col("pos") >= calibrated) & (F.col("pos") >= precision * F.col("n")))
    model.threshold = {r.kind: r.level / 1000 for r in enough.groupBy("kind").agg(F.min("level").alias("level")).collect()}
    return model


def _named(spans: Column) -> Column:
    """kind:start:end, comma-joined, by kind and start."""
    name = lambda s: F.get(F.array(*map(F.lit, KINDS)), s["kind"])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def all_spans(model: Trees, base: str = "pd_base", candidates: str = "pd_candidates") -> Column:
    """Base spans and those candidates that the trees choose and no base rule accepts."""
    extra = F.filter(F.col(candidates), lambda c: ~c["accepted"] & model.chosen(c["kind"], lambda f: c[f]))
    plain = F.transform(extra, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.array_distinct(F.concat(F.col(base), plain))


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Spans of personal data, a row per document.

    Columns: key, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all spans as text). Null and empty
    texts have none; repeated rows count as often as they occur and give repeated rows; an empty table gives no rows;
    other columns are not read. Texts are read once: the trees learn and choose from the table of candidates.
    """
    found = with_candidates(docs.select(F.col(key).alias("key"), F.col(text).alias("text"))).drop("text")
    found = stored(found, "candidates")
    model = train(found, "key")

    def count(number: int) -> Column:
        return F.size(F.filter("pd_base", lambda s: s["kind"] == number)).cast("long")

    return found.select(
        F.col("key").alias(key), *[count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)],
        F.sha2(_named(F.col("pd_base")), 256).alias("base_sha256"), _named(all_spans(model)).alias("spans"),
    )


def redacted(docs: DataFrame, model: Trees, text: str = "text") -> DataFrame:
    """``docs`` with ``[kind]`` in place of each span in its text; overlapping spans share the mark of the first.

    Null texts stay null. The time for a text grows with its length times its number of spans.
    """
    found = with_candidates(docs, text)

    def put(state: Column, s: Column) -> Column:
        mark = F.concat(F.lit("["), F.get(F.array(*map(F.lit, KINDS)), s["kind"]), F.lit("]"))
        between = F.substring(F.col(text), state["at"] + 1, s["start"] - state["at"])
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], F.concat(state["out"], F.array(between, mark))).otherwise(state["out"]).alias("out"),
        )

    by_start = F.array_sort(F.transform(all_spans(model), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    rest = lambda state: F.substring(F.col(text), state["at"] + 1, F.char_length(text))
    clean = F.aggregate(by_start, start, put, lambda state: F.concat(F.array_join(state["out"], ""), rest(state)))
    return found.withColumn(text, clean).select(docs.columns)
