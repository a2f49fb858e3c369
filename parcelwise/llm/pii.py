"""Operator 11: personal data. Generators propose spans, boosted trees on their form and surroundings choose. Columns only."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelwise.llm.shared import fold, settled

#: Kinds in the order in which spans with one start are told.
KINDS = ("email", "ip", "card", "phone")

# The base patterns, matched from the left without overlap; matches that fail their kind's check are dropped. Runs are
# possessive, and a long run is tried from its start only (or where the last match ended), so that the time is in proportion to the text.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_AT, _DOT = r"\x20?[\[({<]\x20?(?i:at|@)\x20?[\])}>]\x20?", r"\x20?[\[({<]\x20?(?i:dot|\.)\x20?[\])}>]\x20?"
_LABEL = r"[A-Za-z0-9-]++"
_COUNTRY = r"\+[0-9]{1,3}[\x20.-]?"
_AREA = r"(?:\([0-9]{1,4}\)[\x20.-]?)?"
#: Generators beside the base patterns. Those of a kind may overlap one another and the base spans: a card or number within a
#: longer run of digits, phone numbers of one to three groups, spellings that keep an address from being found.
PROPOSED = (
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+(?:@{_LABEL}(?:\.{_LABEL})++|(?:{_AT}){_LABEL}(?:(?:\.|{_DOT}){_LABEL})++"
              rf"|\x20(?i:at)\x20{_LABEL}(?:\x20(?i:dot)\x20{_LABEL})++)"),
    ("ip", rf"(?<![0-9]){_OCTET}(?:(?:\.|\[\.\]|\(\.\)){_OCTET}){{3}}(?![0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{12,19}|[0-9]{4}([\x20.-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|[0-9]{4}([\x20.-])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    ("phone", rf"{_COUNTRY}{_AREA}[0-9]{{2,4}}(?:[\x20.-][0-9]{{2,4}}){{1}}(?![0-9])"),
    ("phone", rf"{_COUNTRY}{_AREA}[0-9]{{2,4}}(?:[\x20.-][0-9]{{2,4}}){{2}}(?![0-9])"),
    ("phone", rf"{_COUNTRY}{_AREA}[0-9]{{2,4}}(?:[\x20.-][0-9]{{2,4}}){{3}}(?![0-9])"),
    ("phone", r"(?<![0-9+(.-])(?:\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}([.-])[0-9]{3}\1[0-9]{4})(?![0-9])"),
)
GENERATORS = tuple((kind, BASE[kind]) for kind in KINDS) + PROPOSED
#: Without this in a text, no generator of the kind can match.
NEEDS = {"email": r"@|(?i:at\x20?[\])}>])|(?i:\x20dot\x20)", "ip": "[0-9]", "card": "[0-9]", "phone": r"\+[0-9]|[0-9]{3}[).-]"}
#: Words before a span that speak for its kind.
HINTS = {"email": "mail|contact|write|address", "ip": r"\bip\b|host|server|addr|login", "card": "card|visa|master|amex|credit|carte|karte|tarjeta",
         "phone": "tel|phone|call|mobil|fax|ruf|whatsapp"}
#: Characters kept of what stands before and after a span.
BEFORE, AFTER = 32, 2

#: Features and how many values each has, so that there are so many different vectors at most, however many spans.
FEATURES = {"size": 21, "groups": 8, "check": 2, "prev": 6, "next": 6, "hint": 2, "flat": 2}


@dataclass(frozen=True)
class Setup:
    rounds: int = 12  # trees per kind
    depth: int = 3
    rate: float = 0.5
    smoothing: float = 1.0  # added to the second derivatives of a leaf
    precision: float = 0.9  # of the spans chosen, among documents held out
    least: int = 10  # spans of a kind that trees and threshold need; with fewer, base spans stand alone


@dataclass(frozen=True)
class Leaf:
    value: float


@dataclass(frozen=True)
class Split:
    feature: str
    most: int  # left: up to this value
    left: Leaf | Split
    right: Leaf | Split


@dataclass(frozen=True)
class Model:
    """Trees and the least score that is chosen, by kind."""

    trees: dict[str, list] = field(default_factory=dict)
    threshold: dict[str, float] = field(default_factory=dict)

    def score(self, kind: Column) -> Column:
        """The probability of the feature columns' span, null for a kind that was not learnt."""
        def of(tree) -> Column:
            return F.lit(tree.value) if isinstance(tree, Leaf) else F.when(F.col(tree.feature) <= tree.most, of(tree.left)).otherwise(of(tree.right))

        score = F.lit(None).cast("double")
        for name, trees in self.trees.items():
            whole = F.lit(0.0)
            for tree in trees:
                whole = whole + of(tree)
            score = F.when(kind == name, 1 / (1 + F.exp(-whole))).otherwise(score)
        return score

    def chosen(self, kind: Column, score: Column) -> Column:
        passed = F.lit(False)
        for name, least in self.threshold.items():
            passed = F.when(kind == name, score >= least).otherwise(passed)
        return passed


# --- candidates ----------------------------------------------------------------------------------

def _hits(docs: DataFrame, text_col: str) -> DataFrame:
    """Every row of `docs` with `_row` and `_hits`: generator, number, what it matched, the gap before it, and what is around it."""
    rows = docs.withColumn("_row", F.monotonically_increasing_id())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = rows.withColumns({f"_{kind}": F.when(text.rlike(needs), text) for kind, needs in NEEDS.items()})
    rows = rows.withColumns({f"_{what}{g}": cut for g, (kind, pattern) in enumerate(GENERATORS) for what, cut in (
        ("found", F.regexp_extract_all(f"_{kind}", F.lit(pattern), F.lit(0))), ("gaps", F.split(f"_{kind}", pattern, -1)))})

    def told(g: int) -> Column:
        gaps = F.col(f"_gaps{g}")
        return F.coalesce(F.transform(f"_found{g}", lambda m, i: F.struct(
            F.lit(g).alias("g"), i.alias("i"), m.alias("match"), F.length(F.get(gaps, i)).alias("gap"),
            F.right(F.get(gaps, i), F.lit(BEFORE)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(AFTER)).alias("after"))), F.array())

    return rows.select("_row", *docs.columns, F.concat(*map(told, range(len(GENERATORS)))).alias("_hits"))


def _luhn(digits: Column) -> Column:
    """Whether up to 20 digits pass Luhn's check."""
    whole, total = F.lpad(digits, 20, "0"), F.lit(0)
    for place in range(1, 21):
        digit = F.ascii(F.substring(whole, place, 1)) - 48
        total = total + (digit if place % 2 == 0 else 2 * digit - F.when(digit > 4, 9).otherwise(0))
    return total % 10 == 0


def _class(char: Column, second: Column | None = None) -> Column:
    """Of a neighbouring character: 0 none or white space, 1 letter, 2 digit, 3 punctuation, 4 other, 5 a point with a digit beyond."""
    found = F.when(char.rlike(r"^\s*$"), 0).when(char.rlike(r"^\p{L}"), 1).when(char.rlike("^[0-9]"), 2).when(char.rlike("^[.,:;/_-]"), 3).otherwise(4)
    return F.when((char == ".") & second.rlike("^[0-9]"), 5).otherwise(found)


def _spans(hits: DataFrame) -> DataFrame:
    """One row per document, kind, start and end: whether it is a base span, what its features are, and what covers it."""
    flat = hits.select("_row", "_held", F.explode("_hits").alias("h")).select("_row", "_held", "h.*")
    so_far = Window.partitionBy("_row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("match")).over(so_far).cast("int")
    kinds = F.array(*[F.lit(kind) for kind, _ in GENERATORS])
    flat = flat.select("_row", "_held", F.get(kinds, F.col("g")).alias("kind"), (F.col("g") < len(KINDS)).alias("is_base"), "match", "before", "after",
                       (end - F.length("match")).alias("start"), end.alias("end"))
    by_kind = lambda **cases: _by_kind(F.col("kind"), cases)
    digits = F.regexp_replace("match", "[^0-9]", "")
    n = F.length(digits)
    octets = F.transform(F.split("match", r"[^0-9]+"), lambda x: F.ltrim(x, F.lit("0")))
    small = F.forall(octets, lambda x: F.when(F.length(x) > 3, False).otherwise(F.coalesce(x.try_cast("int"), F.lit(0)) <= 255))
    luhn = F.when(n.between(12, 19), _luhn(digits)).otherwise(False)
    valid = by_kind(email=F.lit(True), ip=small, card=luhn, phone=n.between(9, 15))
    # Spellings are made plain first, and a country's number is taken off, so that they can be held against the base spans.
    mail = F.regexp_replace(F.regexp_replace("match", rf"{_AT}|\x20(?i:at)\x20", "@"), rf"{_DOT}|\x20(?i:dot)\x20", ".")
    number = F.regexp_replace("match", rf"^{_COUNTRY}", "")
    domain = F.substring_index(mail, "@", -1)
    size = by_kind(email=F.length(F.regexp_replace(domain, "[^.]", "")), ip=n, card=n, phone=F.length(F.regexp_replace(number, "[^0-9]", "")))
    parts = lambda text: F.size(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)))
    groups = by_kind(email=F.substring_index(mail, "@", 1).rlike("[0-9]").cast("int") + 2 * F.substring_index(mail, "@", 1).rlike("[._-]").cast("int"),
                     ip=parts(F.col("match")), card=parts(F.col("match")), phone=parts(number) + 4 * F.startswith(number, F.lit("(")).cast("int"))
    check = by_kind(email=F.substring_index(domain, ".", -1).rlike("^[A-Za-z]{2,24}$"), ip=~F.exists(F.split("match", r"[^0-9]+"), lambda x: x.rlike("^0[0-9]")),
                    card=luhn, phone=n.between(9, 15))
    prev, next_ = F.right("before", F.lit(1)), F.left("after", F.lit(1))
    features = {
        "size": F.least(size, F.lit(FEATURES["size"] - 1)), "groups": F.least(groups, F.lit(FEATURES["groups"] - 1)), "check": check.cast("int"),
        "prev": _class(prev, F.substring("before", -2, 1)), "next": _class(next_, F.substring("after", 2, 1)),
        "hint": by_kind(**{kind: F.lower("before").rlike(words) for kind, words in HINTS.items()}).cast("int"),
        "flat": ((n > 1) & digits.rlike(r"^([0-9])\1*$")).cast("int"),
    }
    # Found by their mark, or else by a spelling that the base pattern does not know.
    marked = by_kind(email=F.contains("match", F.lit("@")), ip=~F.col("match").rlike(r"[\[(]"), card=F.lit(True), phone=F.startswith("match", F.lit("+")))
    told = F.struct(*[column.cast("int").alias(name) for name, column in features.items()], marked.alias("marked"))
    spans = flat.groupBy("_row", "kind", "start", "end").agg(
        F.first("_held").alias("_held"), F.max("is_base").alias("is_base"), F.min(valid).alias("valid"), F.max_by(told, ~F.col("is_base")).alias("f"))
    spans = spans.withColumn("base", F.col("is_base") & F.col("valid"))
    every = Window.partitionBy("_row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    own = Window.partitionBy("_row", "kind").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    return spans.select("_row", "_held", "kind", "start", "end", "is_base", "base", "f.*",
                        F.coalesce(F.max(F.when(F.col("base"), F.col("end"))).over(every) >= F.col("end"), F.lit(False)).alias("covered"),
                        F.coalesce(F.max(F.when(F.col("is_base") & ~F.col("base"), F.col("end"))).over(own) >= F.col("end"), F.lit(False)).alias("swallowed"))


def _by_kind(kind: Column, cases: dict[str, Column]) -> Column:
    out = None
    for name, column in cases.items():
        out = F.when(kind == name, column) if out is None else out.when(kind == name, column)
    return out


# --- learning ------------------------------------------------------------------------------------

def _grown(cells: list, slopes: list[tuple[float, float]], depth: int, setup: Setup) -> Leaf | Split:
    """A regression tree on cells (features, ...) with first and second derivatives, by exact search over all splits."""
    g, h = sum(s[0] for s in slopes), sum(s[1] for s in slopes)
    best = None
    for feature in FEATURES if depth else ():
        by_value: dict[int, list[float]] = {}
        for cell, (a, b) in zip(cells, slopes):
            known = by_value.setdefault(cell[feature], [0.0, 0.0])
            known[0] += a
            known[1] += b
        left_g = left_h = 0.0
        for value in sorted(by_value)[:-1]:
            left_g, left_h = left_g + by_value[value][0], left_h + by_value[value][1]
            gain = (left_g ** 2 / (left_h + setup.smoothing) + (g - left_g) ** 2 / (h - left_h + setup.smoothing) - g ** 2 / (h + setup.smoothing))
            if gain > 1e-6 and (best is None or gain > best[0]):
                best = gain, feature, value
    if best is None:
        return Leaf(setup.rate * g / (h + setup.smoothing))
    _, feature, most = best
    sides = [[i for i, cell in enumerate(cells) if (cell[feature] <= most) == side] for side in (True, False)]
    return Split(feature, most, *[_grown([cells[i] for i in side], [slopes[i] for i in side], depth - 1, setup) for side in sides])


def _value(tree, cell) -> float:
    while isinstance(tree, Split):
        tree = tree.left if cell[tree.feature] <= tree.most else tree.right
    return tree.value


def boosted(cells: list, setup: Setup) -> list:
    """Trees for cells (features, yes, no), fitted one after the other to the logistic loss; the first is the log odds of all."""
    yes, no = sum(c["yes"] for c in cells), sum(c["no"] for c in cells)
    trees: list = [Leaf(math.log((yes + 0.5) / (no + 0.5)))]
    margins = [trees[0].value] * len(cells)
    for _ in range(setup.rounds):
        slopes = []
        for cell, margin in zip(cells, margins):
            p, n = 1 / (1 + math.exp(-margin)), cell["yes"] + cell["no"]
            slopes.append((cell["yes"] - n * p, n * p * (1 - p)))
        trees.append(_grown(cells, slopes, setup.depth, setup))
        margins = [m + _value(trees[-1], cell) for m, cell in zip(margins, cells)]
    return trees


def calibrated(scored: list[tuple[float, int, int]], setup: Setup) -> float | None:
    """From (score, yes, no) of documents held out: the least score at which the isotonic share of yes reaches the precision."""
    blocks: list[list[float]] = []  # least score, yes, no; shares ascending
    for score, yes, no in sorted(scored):
        blocks.append([score, yes, no])
        while len(blocks) > 1 and blocks[-2][1] * (blocks[-1][1] + blocks[-1][2]) >= blocks[-1][1] * (blocks[-2][1] + blocks[-2][2]):
            _, more_yes, more_no = blocks.pop()
            blocks[-1][1] += more_yes
            blocks[-1][2] += more_no
    return next((score for score, yes, no in blocks if yes >= setup.precision * (yes + no) and yes), None)


def _learnt(spans: DataFrame, setup: Setup) -> Model:
    """Trees from all spans outside the held-out documents. Yes: a base span. No: what a generator proposed and the base pattern
    refused or never saw. A span within a longer base match that failed, or in another spelling, says nothing and is left out."""
    known = spans.filter(F.col("base") | (F.col("marked") & (F.col("is_base") | ~F.col("swallowed"))))
    count = lambda when: F.sum(when.cast("long"))
    cells = known.groupBy("kind", *FEATURES).agg(
        count(F.col("base") & ~F.col("_held")).alias("yes"), count(~F.col("base") & ~F.col("_held")).alias("no"),
        count(F.col("base") & F.col("_held")).alias("held_yes"), count(~F.col("base") & F.col("_held")).alias("held_no"))
    rows = cells.orderBy("kind", *FEATURES).collect()  # as many as there are vectors of features, at most
    model = Model()
    for kind in KINDS:
        own = [r.asDict() for r in rows if r["kind"] == kind]
        if sum(c["yes"] for c in own) < setup.least or sum(c["held_yes"] for c in own) < 1:
            continue
        trees = boosted([c for c in own if c["yes"] + c["no"]], setup)
        odds = lambda c: sum(_value(t, c) for t in trees)  # noqa: B023, E731
        least = calibrated([(1 / (1 + math.exp(-odds(c))), c["held_yes"], c["held_no"]) for c in own if c["held_yes"] + c["held_no"]], setup)
        if least is not None:
            model.trees[kind], model.threshold[kind] = trees, least - 1e-9
    return model


# --- the operator --------------------------------------------------------------------------------

SPANS = "array<struct<start:int,kind:string,end:int,base:boolean,score:double>>"


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", setup: Setup = Setup()) -> DataFrame:
    """`id_col` and `pii` of every row of `docs`: spans (start, kind, end, base, score) in code points, end exclusive, by start and kind.

    Base spans (see BASE: addresses of mail, IP addresses with parts of at most 255, cards of 12 to 19 digits that pass Luhn's check,
    phone numbers of 9 to 15 digits after a plus) always stand. Further spans are proposed by the generators in PROPOSED, and chosen
    by boosted trees: what the base patterns find and refuse in all documents teaches them which forms and surroundings go with a
    kind, and the threshold is the least score at which the share of base spans among documents held out (a fifth, by the id's
    crc32) reaches `setup.precision`. A kind with fewer than `setup.least` base spans adds none. A chosen span that a base span covers
    is left out, and of chosen spans of one kind that overlap the one with the best score stays (of equal scores the first, then longest).

    Texts are read once; what is shuffled is a row per match. The trees are fitted to counts per vector of features, of which there
    is a fixed number. Null and empty texts have no spans; repeated rows and rows with one id are rows of their own; an empty table
    gives an empty table; further columns are ignored."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    hits = settled(_hits(rows, "_text").select("_row", "_id", (fold(F.col("_id")) == 0).alias("_held"), "_hits"))
    spans = settled(_spans(hits))
    model = _learnt(spans, setup)
    more = spans.filter(~F.col("base") & ~F.col("covered")).withColumn("score", model.score(F.col("kind"))).filter(model.chosen(F.col("kind"), F.col("score")))
    in_order = Window.partitionBy("_row", "kind").orderBy("start", "end")
    reached = F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    more = more.withColumn("opens", F.coalesce((F.col("start") >= reached).cast("int"), F.lit(1)))
    more = more.withColumn("group", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    best = F.max_by(F.struct("start", "end", "score"), F.struct("score", -F.col("start"), "end"))
    more = more.groupBy("_row", "kind", "group").agg(best.alias("s")).select("_row", "kind", "s.*", F.lit(False).alias("base"))
    both = spans.filter("base").select("_row", "kind", "start", "end", F.lit(1.0).alias("score"), "base").unionByName(more)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    told = both.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", place.alias("place"), "end", "kind", "base", "score"))).alias("pii"))
    told = told.select("_row", F.transform("pii", lambda s: F.struct(s["start"], s["kind"], s["end"], s["base"], s["score"])).cast(SPANS).alias("pii"))
    return hits.select("_row", "_id").join(told, "_row", "left").select(
        F.col("_id").alias(id_col), F.coalesce("pii", F.array().cast(SPANS)).alias("pii"))


def redacted(text: Column, spans: Column, mask: str = "[PII]") -> Column:
    """`text` with every span replaced; overlapping spans are replaced as one. Null stays null. For spans in order of start."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    merged = F.aggregate(spans, zero, lambda acc, s: F.struct(
        F.greatest(acc["at"], s["end"]).alias("at"),
        F.when(s["start"] >= acc["at"], F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mask)))
        .otherwise(acc["out"]).alias("out")), lambda acc: F.concat(acc["out"], text.substr(acc["at"] + 1, F.length(text))))
    return F.when(text.isNotNull(), merged)
