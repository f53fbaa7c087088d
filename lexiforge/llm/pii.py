"""Personal data by candidate gradient boosting, by DataFrame functions only.

High-recall generators propose spans of four kinds, which may overlap: the exact base
patterns with their checks, and looser forms (spelled-out mail addresses, numbers with other
separators or without a plus sign, addresses with bracketed or spaced dots). Boosted trees over
format and context features score the loose candidates; a calibrated threshold for each kind selects
those that join the base spans, which always stay.

Training is self-supervised over all documents by evidence that no feature shows: a phone
number's plus sign, a card number's check digit, the values of an address' numbers, a mail
address' top-level name. A candidate that the evidence confirms is positive, one that it
refutes (or, for phone numbers, that another kind's base span or an identifier holds) is negative, one without
evidence isn't trained on. Features are small integers, so the corpus is pre-aggregated to one
row per feature vector (at most the product of the feature levels), and the trees are grown on that
table. A fifth of the texts (by their hash, so copies stay together) is kept from the trees and
sets the thresholds: the least margin from which on THRESHOLD of a kind's withheld candidates
are confirmed. A kind without enough of them keeps its base spans only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiforge.llm.common import documents, materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 24
RATE = 0.3
#: Share of confirmed ones among a kind's withheld candidates from its threshold on.
THRESHOLD = 0.9
#: One text in so many sets the thresholds.
HELD = 5
#: Candidates that back a leaf at least; fewer leave it at the prior.
LEAF_MIN = 5
CONTEXT = 24

# Possessive quantifiers and look-behinds keep matching linear; they match what the plain forms do.
_MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Loose forms: (kind, quick test, pattern). A quick test is a pattern, or literals of which one must occur;
#: whatever the pattern matches passes it.
LOOSE = (
    ("email", ("@", "(at)", "[at]", " dot "), r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:@|\(at\)|\[at\]| at(?= [A-Za-z0-9-]++ dot )) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?| dot |\.| \. )[A-Za-z0-9-]++)++"),
    ("ip", r"[0-9] ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?[0-9]", r"(?<![0-9])[0-9]{1,3}+(?: ?(?:\.|\[\.\]|\(\.\)|\[dot\]) ?[0-9]{1,3}+){3}(?![0-9])"),
    ("card", r"[0-9]{4}", r"(?<![0-9])[0-9]{4}+(?:[\x20./_-]{1,3}[0-9]{2,6}+){2,4}(?![0-9])"),
    ("phone", r"[0-9]{3}[\x20./)-]{1,2}[0-9]", r"(?<![0-9+(])\(?[0-9]{2,4}+\)?[\x20./-]{1,2}[0-9]{3,4}+(?:[\x20./-][0-9]{2,4}+){1,3}(?![0-9])"),
)
_HINTS = r"(?i)mail|e-mail|contact|address|tel|phone|call|fax|mobile|card|visa|account|pay|\bip\b|host|server"


def running(values: Column, op, block: int = 512) -> Column:
    """Running ``op`` (an associative one) over an array, the element included. Blocks are run by
    themselves and then carried on, so the cost is linear but for the number of blocks."""
    grow = lambda done, x: F.concat(done, F.array(op(F.coalesce(F.get(done, F.size(done) - 1), x * 0), x)))
    empty = F.array().cast("array<int>")
    own = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / block).cast("int")), lambda b: F.slice(values, b * block + 1, block))
    own = F.transform(own, lambda part: F.aggregate(part, empty, grow))
    carried = lambda parts: F.aggregate(F.transform(parts, lambda p: F.get(p, F.size(p) - 1)), empty, grow)
    shared = F.transform(F.array(own), lambda parts: F.struct(parts.alias("parts"), carried(parts).alias("carry")))
    moved = F.transform(shared, lambda s: F.flatten(F.transform(s["parts"], lambda p, i: F.transform(p, lambda x: op(F.coalesce(F.get(s["carry"], i - 1), x * 0), x)))))
    return F.when(F.size(values) > 0, F.get(moved, 0)).otherwise(empty)


def spans_of(text: Column, pattern: str) -> Column:
    """array<struct<start, end, hit>> of the leftmost non-overlapping matches, in code points:
    lengths of the pieces between the matches and of the matches themselves add up."""
    found = F.transform(
        F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))),
        lambda x: F.struct(x["hits"].alias("hits"), running(F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda h, g: F.length(g) + F.length(h)), lambda a, b: a + b).alias("ends")),
    )
    spans = F.transform(found, lambda x: F.zip_with(x["hits"], x["ends"], lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit"))))
    return F.get(spans, 0)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]+", "")


def luhn(number: Column) -> Column:
    """Luhn check of a string of digits."""
    values = F.split(F.reverse(number), "")
    total = F.aggregate(
        F.transform(F.filter(values, lambda x: x != ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))),
        F.lit(0),
        lambda a, x: a + x,
    )
    return total % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(p) <= 3) & (F.when(F.length(p) <= 3, F.when(p == "", 0).otherwise(p.cast("int"))) <= 255)
        return F.forall(F.transform(F.split(hit, r"\."), lambda p: F.regexp_replace(p, "^0+", "")), small)
    if kind == "card":
        n = F.length(digits(hit))
        return n.between(13, 19) & F.when(n.between(13, 19), luhn(digits(hit))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(hit)).between(9, 15)
    return F.lit(True)


def _bytes(hit: Column) -> Column:
    """Whether each number of a loose address is a byte."""
    return F.forall(F.filter(F.split(hit, "[^0-9]+"), lambda p: p != ""), lambda p: p.cast("int") <= 255)


def _checked(kind: str):
    return lambda span: _valid(kind, span["hit"])


def _named(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))


def _tagged(kind: str):
    return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(f"[{kind.upper()}]").alias("tag"))


_NONE = "array<struct<start:int,end:int,hit:string>>"


def _base(text: Column, digit: Column) -> dict[str, Column]:
    """Base spans by kind. Quick tests spare most texts the full patterns."""
    forms = {"email": (F.contains(text, F.lit("@")), _MAIL), "ip": (digit & F.contains(text, F.lit(".")), _IP), "card": (digit, _CARD), "phone": (digit & F.contains(text, F.lit("+")), _PHONE)}
    return {k: F.when(test, F.filter(spans_of(text, p), _checked(k))).otherwise(F.array().cast(_NONE)) for k, (test, p) in forms.items()}


def _may_hold(text: Column, digit: Column, test: str | tuple[str, ...]) -> Column:
    if isinstance(test, str):
        return digit & text.rlike(test)
    out = F.lit(False)
    for literal in test:
        out = out | F.contains(text, F.lit(literal))
    return out


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with base_<kind> span arrays, and loose_<kind> arrays whose spans carry their
    features (f) and whether they are part of an identifier (glued); held marks the texts that
    set the thresholds. A null text counts as empty."""
    rows = docs.withColumn("__t", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("__d", F.col("__t").rlike("[0-9]"))
    text, digit = F.col("__t"), F.col("__d")
    spans = _base(text, digit)
    columns = {f"base_{k}": c for k, c in spans.items()}
    for k, test, p in LOOSE:
        found = F.transform(spans_of(text, p), lambda s: F.struct(s["start"], s["end"], s["hit"], F.struct(*(c.alias(n) for n, c in features(F.col("__t"), s).items())).alias("f"), glued(F.col("__t"), s).alias("glued")))
        columns[f"loose_{k}"] = F.when(_may_hold(text, digit, test), found)
    columns["held"] = (F.pmod(F.xxhash64(text), F.lit(HELD)) == 0).cast("int")
    return rows.withColumns(columns).drop("__t", "__d")


#: Feature names and their number of levels.
FEATURES = {"digits": 6, "groups": 5, "last": 6, "spaced": 2, "bracket": 2, "dotted": 2, "dashed": 2, "hint": 2}


def features(text: Column, span: Column) -> dict[str, Column]:
    """Format and context of a candidate, as small integers."""
    hit = span["hit"]
    n = F.length(digits(hit))
    before = F.substring(text, F.greatest(F.lit(1), span["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), span["start"]))
    level = F.when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 13, 3).when(n <= 19, 4).otherwise(5)
    groups = F.least(F.size(F.filter(F.split(hit, "[^0-9]+"), lambda x: x != "")), F.lit(4))
    flag = lambda c: c.cast("int")
    return {
        "digits": level,
        "groups": groups,
        "last": F.least(F.length(F.regexp_extract(hit, r"([0-9]*)\z", 1)), F.lit(5)),
        "spaced": flag(hit.contains(" ")),
        "bracket": flag(hit.rlike(r"[\[(]")),
        "dotted": flag(hit.contains(".")),
        "dashed": flag(hit.contains("-")),
        "hint": flag(before.rlike(_HINTS)),
    }


def glued(text: Column, span: Column) -> Column:
    """Whether letters, digits or a sign of identifiers touch the candidate."""
    before, after = F.substring(text, span["start"], F.when(span["start"] > 0, 1).otherwise(0)), F.substring(text, span["end"] + 1, F.lit(1))
    return before.rlike(r"[\p{L}0-9_=/#@]") | after.rlike(r"[\p{L}0-9_=/#@]")


def _meets(kind: str, span: Column) -> Column:
    return F.exists(F.col(f"base_{kind}"), lambda b: (b["start"] < span["end"]) & (span["start"] < b["end"]))


def evidence(span: Column, kind: str) -> Column:
    """Whether the kind's own evidence, which no feature shows, confirms or refutes a candidate; null
    if there is none."""
    hit, other = span["hit"], F.lit(False)
    for k in KINDS:
        if k != kind:
            other = other | _meets(k, span)
    if kind == "phone":
        return F.when(_meets(kind, span), True).when(other | span["glued"], False)
    sound = {"card": _valid("card", hit), "ip": _bytes(hit), "email": hit.rlike(r"[A-Za-z].*[^A-Za-z0-9-][A-Za-z]{2,24}\z")}[kind]
    return sound & ~other


def _labeller(kind: str):
    return lambda span: F.struct(F.lit(kind).alias("kind"), *(span["f"][n].alias(n) for n in FEATURES), evidence(span, kind).cast("int").alias("y"))


def training_table(rows: DataFrame) -> list[tuple]:
    """(held, kind, features..., positives, candidates), one row per feature vector that occurs."""
    parts = [F.coalesce(F.transform(F.col(f"loose_{k}"), _labeller(k)), F.array()) for k in KINDS]
    cells = rows.select("held", F.explode(F.concat(*parts)).alias("x")).select("held", "x.*").where("y is not null")
    table = cells.groupBy("held", "kind", *FEATURES).agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    return [tuple(r) for r in table.collect()]  # at most 8 * the product of the levels


def boost(table: list[tuple], rounds: int = ROUNDS, rate: float = RATE, leaf_min: int = LEAF_MIN) -> list[tuple]:
    """Depth-two trees on the logistic loss, by Newton leaves. The inputs are the kind's number
    and the features; a tree is (feature, cut, (feature, cut, low, high), (...)): value < cut goes low.
    The prior is the first entry, a float."""
    order = sorted(table, key=str)
    rows = [((KINDS.index(r[0]), *r[1:-2]), r[-2], r[-1]) for r in order]
    pos, total = sum(r[1] for r in rows), sum(r[2] for r in rows)
    prior = math.log((pos + 1) / (total - pos + 1))
    score = [prior] * len(rows)
    levels = (len(KINDS), *FEATURES.values())
    cuts = [(f, c) for f, n in enumerate(levels) for c in range(1, n)]
    trees: list = [prior]

    def leaf(part: list[int], g: list[float], h: list[float], backing: list[int]) -> tuple[float, float]:
        gs, hs, n = sum(g[i] for i in part), sum(h[i] for i in part), sum(backing[i] for i in part)
        return (gs / (hs + 1), gs * gs / (hs + 1)) if n >= leaf_min else (0.0, 0.0)

    for _ in range(rounds if rows else 0):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [y - n * q for (_, y, n), q in zip(rows, p)]
        h = [n * q * (1 - q) for (_, _, n), q in zip(rows, p)]
        backing = [n for _, _, n in rows]

        def best(part: list[int]) -> tuple:
            found = (-1.0, 0, 1, 0.0, 0.0)
            for f, c in cuts:
                low, high = [i for i in part if rows[i][0][f] < c], [i for i in part if rows[i][0][f] >= c]
                if low and high:
                    (a, x), (b, y) = leaf(low, g, h, backing), leaf(high, g, h, backing)
                    if x + y > found[0] + 1e-12:
                        found = (x + y, f, c, a, b)
            if found[0] < 0:
                a, x = leaf(part, g, h, backing)
                return (x, 0, 1, a, a)
            return found

        gain, f, c, *_ = best(list(range(len(rows))))
        sides = []
        for keep_low in (True, False):
            part = [i for i in range(len(rows)) if (rows[i][0][f] < c) == keep_low]
            _, f2, c2, a, b = best(part) if part else (0, 0, 1, 0.0, 0.0)
            sides.append((f2, c2, rate * a, rate * b))
        trees.append((f, c, *sides))
        for i, (x, _, _) in enumerate(rows):
            f2, c2, a, b = sides[0] if x[f] < c else sides[1]
            score[i] += a if x[f2] < c2 else b
    return trees


def calibrated(trees: list, table: list[tuple]) -> dict[str, float]:
    """For each kind, the least margin from which on THRESHOLD of the table's candidates of that
    kind are confirmed; infinite if there is none, or fewer than LEAF_MIN."""
    out = dict.fromkeys(KINDS, math.inf)
    for kind in KINDS:
        scored = sorted(((predict(trees, (KINDS.index(kind), *r[1:-2])), r[-2], r[-1]) for r in table if r[0] == kind), reverse=True)
        pos = n = 0
        for i, (s, y, k) in enumerate(scored):
            pos, n = pos + y, n + k
            if (i + 1 == len(scored) or scored[i + 1][0] < s) and n >= LEAF_MIN and pos >= THRESHOLD * n:
                out[kind] = s - 1e-9  # sums in another order may differ in their last place
    return out


def predict(trees: list, x: tuple) -> float:
    total = trees[0]
    for f, c, low, high in trees[1:]:
        f2, c2, a, b = low if x[f] < c else high
        total += a if x[f2] < c2 else b
    return total


def _score(trees: list, values: list[Column]) -> Column:
    total = F.lit(float(trees[0]))
    for f, c, *sides in trees[1:]:
        low, high = (F.when(values[f2] < c2, a).otherwise(b) for f2, c2, a, b in sides)
        total = total + F.when(values[f] < c, low).otherwise(high)
    return total


def _packed(docs: DataFrame) -> DataFrame:
    """row, a struct of all columns, and text: no column's name can meet one of this module's."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), "text")


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with base_<kind> and all_<kind>: arrays of spans by start, then end. Columns of ``docs``
    with one of these eight names are replaced, any others are kept.

    Null and empty texts have no spans. Every row is handled by itself; the only shuffle is that
    of the feature table."""
    spans = [f"{prefix}_{k}" for prefix in ("base", "all") for k in KINDS]
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in spans]
    return select_spans(candidates(_packed(docs))).select(*own, *spans)


def select_spans(rows: DataFrame) -> DataFrame:
    """Trains on the candidates and adds the chosen ones; ``rows`` are read twice. A candidate that
    meets a base span adds nothing, and one that its own evidence refutes is never chosen."""
    table = training_table(rows)
    trees = boost([r[1:] for r in table if not r[0]])
    margins = calibrated(trees, [r[1:] for r in table if r[0]])

    def chosen(kind: str) -> Column:
        def keep(span: Column) -> Column:
            values = [F.lit(KINDS.index(kind)), *(span["f"][n] for n in FEATURES)]
            return F.coalesce(evidence(span, kind), F.lit(True)) & ~_meets(kind, span) & (_score(trees, values) >= margins[kind])

        base, loose = F.col(f"base_{kind}"), F.col(f"loose_{kind}")
        if not math.isfinite(margins[kind]):
            return base
        plain = F.transform(F.filter(loose, keep), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit")))
        return F.when(loose.isNull(), base).otherwise(F.array_sort(F.concat(base, plain)))

    return rows.withColumns({f"all_{k}": chosen(k) for k in KINDS}).drop(*(f"loose_{k}" for k in KINDS), "held")


def listed(prefix: str) -> Column:
    """kind:start:end by kind, then start, then end, comma-joined; spans of different kinds may overlap."""
    return F.array_join(F.concat(*(F.transform(F.col(f"{prefix}_{k}"), _named(k)) for k in KINDS)), ",")


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; where spans
    overlap the earlier (then longer) one is replaced and the rest of the other goes too. Columns of any
    name are kept as they are; a null text stays null."""
    found = select_spans(candidates(_packed(docs)))
    text = F.col("text")
    spans = F.array_sort(F.concat(*(F.transform(F.col(f"all_{k}"), _tagged(k)) for k in KINDS)))
    # what is covered up to each span; a span that starts inside leaves no tag
    upto = F.transform(F.array(spans), lambda s: F.struct(s.alias("s"), running(F.transform(s, lambda x: -x["end"]), F.greatest).alias("to")))
    piece = lambda x, at: F.when(x["start"] < at, F.lit("")).otherwise(F.concat(F.substring(text, at + 1, x["start"] - at), x["tag"]))
    parts = F.transform(upto, lambda u: F.concat(F.transform(u["s"], lambda x, i: piece(x, F.coalesce(F.get(u["to"], i - 1), F.lit(0)))), F.array(F.substring(text, F.get(u["to"], F.size(u["to"]) - 1) + 1, F.length(text)))))
    none = F.lit(True)
    for k in KINDS:
        none = none & (F.size(f"all_{k}") == 0)
    clean = F.when(none, text).otherwise(F.array_join(F.get(parts, 0), ""))
    return found.select(*(clean.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    """The candidates are written once, without texts, for training and selection alike."""
    found = candidates(documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    got = select_spans(materialize(found, "pii-candidates"))
    counts = [F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    return got.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("all").alias("spans"), sum((F.size(f"all_{k}") for k in KINDS[1:]), F.size(f"all_{KINDS[0]}")).cast("long").alias("n_spans"))
