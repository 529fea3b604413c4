"""Personal data: base patterns, and boosted trees over candidates of high-recall generators.

DataFrame functions only. The trees learn from the documents' own matches of the base patterns,
those that pass their test and those that fail it, and from made rows of the other writings, which
no table labels. All of them count, as weighted groups of equal features. Spark ML trains them;
then they become an SQL expression.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .spans import digits, in_stretches, let, listed, luhn, overlaps, spans

# The kinds in their order, and the base patterns. Quantifiers that can't give
# characters back are possessive, and a match that could only fail further right in its own run
# of characters starts at the run's begin (or where the last match ended): the same matches in
# linear time.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single blanks or hyphens, if it has 13 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:[\[({]\x20?at\x20?[\])}]|(?<=\x20)at(?=\x20))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]\x20?dot\x20?[\])}]|(?<=\x20)dot(?=\x20))\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:\x20?[\[(]\.[\])]\x20?[0-9]{1,3}){3}(?![0-9])|(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,2}[0-9]{4}){2,3}(?:[\x20._/-]{1,2}[0-9]{1,3})?(?![0-9])",
    "phone": r"(?<![0-9+.(-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3,4}(?![0-9])",
}
#: Every match of the e-mail generator holds this: a bracketed at, or " at " with a host and the begin of a dot next.
GUARD_EMAIL = r"[\[({]\x20?at\x20?[\])}]|\x20at\x20[A-Za-z0-9-]++\x20?(?:\.|[\[({]\x20?dot|(?<=\x20)dot(?=\x20))"
#: Characters around a candidate that the features see, and digits of the longest card number.
CONTEXT, DIGITS = 32, 19
# Words that speak for or against a kind.
CUES = {
    "email": r"(?i)\b(e-?mail|mail|contact|write|reach)\b",
    "ip": r"(?i)\b(ip|host|server|address|addr|ping|login)\b",
    "card": r"(?i)\b(card|visa|mastercard|amex|credit|debit|pay|payment|cc)\b",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|cell|text|dial|whatsapp)\b",
    "against": r"(?i)\b(order|invoice|isbn|issn|serial|version|ver|ref|batch|id|page|pages|no|build|part|date|sku)\b",
}
FEATURES = ("length", "digits", "groups", "brackets", "letters", "cue", "against", "luhn", "parts", "last", "known_end", "plus", "marked", *(f"is_{k}" for k in KINDS))
#: Rows made for training, the weight of all rows of a kind and label from the documents at most (a
#: made row weighs 1), and the precision that a kind's threshold has to reach on rows held out.
ROWS, NATURAL, PRECISION = 6_000, 1_000, 0.98
#: Weights are whole multiples of 1 / UNIT. Bins of a feature with more values than that.
UNIT, BINS = 10**12, 32


def _features(kind: Column, hit: Column, before: Column, after: Column) -> Column:
    number = digits(hit)
    around = F.concat_ws(" ", before, after)
    cue = F.lit(False)
    for k in KINDS:
        cue = cue | ((kind == k) & F.rlike(around, F.lit(CUES[k])))
    groups = F.filter(F.split(hit, "[^0-9]+"), lambda g: g != "")
    small = F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(F.try_to_number(g, F.lit("999")), F.lit(999)) <= 255))
    known_end = F.rlike(hit, F.lit(r"(?i)(com|org|net|edu|gov|io|de|fr|es|uk|info)$"))
    plus = F.startswith(hit, F.lit("+"))
    marked = F.rlike(hit, F.lit(r"^[A-Za-z0-9%+-]*[0-9._%+-]"))
    values = [F.length(hit), F.length(number), F.size(groups), F.rlike(hit, F.lit(r"[\[({]")), F.length(F.regexp_replace(hit, "[^A-Za-z]", "")), cue, F.rlike(before, F.lit(CUES["against"])), (F.length(number) <= DIGITS) & luhn(F.substring(number, 1, DIGITS)), small, F.length(F.element_at(F.concat(F.array(F.lit("")), groups), -1)), known_end, plus, marked]
    values += [kind == k for k in KINDS]
    return F.array(*[F.coalesce(v.cast("int").cast("double") if n not in ("length",) else v.cast("double"), F.lit(0.0)) for n, v in zip(FEATURES, values, strict=True)])


def _pick(values: list[str], salt: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(values))) + 1).cast("int"))


def _number(width: int, salt: str, low: int = 0) -> Column:
    return F.lpad((F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(10**width - low)) + low).cast("string"), width, "0")


def _with_check(body: Column) -> Column:
    """A number with the digit that makes it valid."""
    options = F.array(*[F.concat(body, F.lit(str(d))) for d in range(10)])
    return F.element_at(F.filter(options, luhn), 1)


def training_rows(spark: SparkSession, rows: int = ROWS) -> DataFrame:
    """(kind, hit, before, after, label): made candidates, from hashes of the row number."""
    base = spark.range(0, rows, 1, 2).withColumn("kind", _pick(list(KINDS), "kind")).withColumn("good", F.pmod(F.xxhash64("id", F.lit("good")), F.lit(2)) == 1)
    neutral = ["the", "and", "house", "green", "they", "river", "often", "under", "see", "ring", "is", "with", "my"]
    word = _pick(neutral, "word")
    name, host = _pick(["ann.lee", "jo_k", "m.ruiz", "info2", "sam99"], "name"), _pick(["mail", "post7", "firm", "lab-x"], "host")
    at, dot = _pick(["[at]", " [at] ", "(at)", " (at) ", " at "], "at"), _pick(["[dot]", " [dot] ", "(dot)", " dot ", "."], "dot")
    tld = _pick(["com", "org", "net", "de"], "tld")
    email = F.concat(name, at, host, dot, tld)
    # Plain words around a spelled-out at and dot, whatever the end.
    no_email = F.concat(_pick(["meet", "look", "we", "stay", "them"], "w"), F.lit(" at "), _pick(["the", "that", "noon", "home"], "x"), _pick([" dot ", "."], "z"), F.when(F.pmod(F.xxhash64("id", F.lit("end")), F.lit(2)) == 0, tld).otherwise(_pick(["matrix", "line", "product", "here"], "y")))
    part = lambda i, n: (F.pmod(F.xxhash64("id", F.lit(f"p{i}")), F.lit(n))).cast("string")
    fang = _pick(["[.]", "(.)", " [.] "], "fang")
    ip = F.concat(part(0, 256), fang, part(1, 256), fang, part(2, 256), fang, part(3, 256))
    no_ip = F.concat((F.pmod(F.xxhash64("id", F.lit("q")), F.lit(700)) + 300).cast("string"), fang, part(1, 999), fang, part(2, 999), fang, part(3, 999))
    gap = _pick([". ", "/", "_", " - ", ".", "--"], "gap")
    number = _with_check(F.concat(F.lit("4"), _number(7, "a"), _number(7, "b")))
    wrong = F.concat(F.substring(number, 1, 15), ((F.substring(number, 16, 1).cast("int") + 1 + F.pmod(F.xxhash64("id"), F.lit(8)).cast("int")) % 10).cast("string"))
    grouped = lambda n: F.concat_ws("", F.substring(n, 1, 4), gap, F.substring(n, 5, 4), gap, F.substring(n, 9, 4), gap, F.substring(n, 13, 4))
    sep = _pick(["-", ".", " "], "sep")
    phone = F.when(F.pmod(F.xxhash64("id", F.lit("paren")), F.lit(2)) == 0, F.concat(F.lit("("), _number(3, "c", 200), F.lit(") "), _number(3, "d", 200), sep, _number(4, "e"))).otherwise(F.concat(_number(3, "c", 200), sep, _number(3, "d", 200), sep, _number(4, "e")))
    no_phone = F.concat(_number(4, "f", 1000), sep, _number(4, "g"), sep, _number(4, "h"))
    hit, miss = F.lit(""), F.lit("")
    for k, y, n in (("email", email, no_email), ("ip", ip, no_ip), ("card", grouped(number), grouped(wrong)), ("phone", phone, F.when(F.pmod(F.xxhash64("id", F.lit("np")), F.lit(3)) > 0, phone).otherwise(no_phone))):
        hit, miss = F.when(F.col("kind") == k, y).otherwise(hit), F.when(F.col("kind") == k, n).otherwise(miss)
    cues = {"email": ["email: ", "contact ", "write to "], "ip": ["host ", "server ip ", "address "], "card": ["card ", "visa ", "payment "], "phone": ["call ", "tel. ", "phone: ", "fax "]}
    cue = F.lit("")
    for k, some in cues.items():
        cue = F.when(F.col("kind") == k, _pick(some, f"cue {k}")).otherwise(cue)
    # Half of the true ones have a cue; a phone number's writing is only made false by a word against it.
    shown = F.pmod(F.xxhash64("id", F.lit("show")), F.lit(2)) == 0
    against = _pick(["order ", "invoice no ", "ref ", "version ", "batch ", "page "], "against")
    before = F.when(F.col("good") & shown, cue).when(F.col("good"), F.concat(word, F.lit(" "))).when((F.col("kind") == "phone") | shown, against).otherwise(F.concat(word, F.lit(" ")))
    return base.select("id", "kind", F.when(F.col("good"), hit).otherwise(miss).alias("hit"), before.alias("before"), F.concat(F.lit(" "), word).alias("after"), F.col("good").cast("double").alias("label"))


def natural_rows(texts: DataFrame) -> DataFrame:
    """(id, kind, hit, before, after, label): every match of the base patterns in ``_t``; label 1 if it passes its test."""
    found = _raw(F.col("_t"), CONTEXT)
    row = lambda k: lambda s: F.struct(F.lit(k).alias("kind"), *[s[c].alias(c) for c in ("hit", "before", "after")], _passes(k)(s).cast("double").alias("label"))
    each = [F.transform(v, row(k)) for k, v in found.items()]
    rows = texts.select(F.explode(F.concat(*each)).alias("r")).select("r.*")
    return rows.withColumn("id", F.xxhash64("kind", "hit", "before", "after"))


def examples(scratch: Scratch, texts: DataFrame, rows: int = ROWS) -> DataFrame:
    """(kind, label, made, fold, f, n, units): all made rows and all matches in ``_t``, counted by their features.

    ``units``: their weight, in whole UNITs so that sums are the same in any order. A made row weighs
    1; the matches of a kind and label weigh the same each, NATURAL together, and 1 each at most.
    """
    seen = training_rows(scratch.spark, rows).withColumn("made", F.lit(True)).unionByName(natural_rows(texts).withColumn("made", F.lit(False)))
    fold = F.pmod(F.xxhash64("id", F.lit("held")), F.lit(2)).cast("int").alias("fold")
    key = ["kind", "label", "made", "fold", "f"]
    every = scratch.write(seen.select("kind", "label", "made", fold, _features(*[F.col(c) for c in ("kind", "hit", "before", "after")]).alias("f")).groupBy(*key).agg(F.count("*").alias("n")))
    unit = F.lit(UNIT)
    for r in every.where(~F.col("made")).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect():
        unit = F.when(~F.col("made") & (F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), F.lit(max(1, round(UNIT * min(1.0, NATURAL / r["n"]))))).otherwise(unit)
    return every.withColumn("units", F.col("n") * unit.cast("long"))


def _cuts(every: DataFrame) -> list[list[float]]:
    """For each feature, the places between its values (all, or BINS of equal weight if there are more)."""
    one = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.get("f", F.lit(i)).alias("v")) for i in range(len(FEATURES))])).alias("x")
    values = every.select("units", one).groupBy("x.i", "x.v").agg(F.sum("units").alias("units"))
    whole = Window.partitionBy("i")
    run = whole.orderBy("v")
    values = values.select("i", "v", "units", F.lead("v").over(run).alias("next"), F.sum("units").over(run).alias("upto"), F.sum("units").over(whole).alias("total"), F.count("*").over(whole).alias("distinct_values"))
    kept = (F.col("distinct_values") <= BINS) | F.expr(f"upto * {BINS} div total > (upto - units) * {BINS} div total")
    cuts: list[list[float]] = [[] for _ in FEATURES]
    for r in values.where(F.col("next").isNotNull() & kept).orderBy("i", "v").collect():
        cuts[r["i"]].append((r["v"] + r["next"]) / 2)
    return cuts


def train(spark: SparkSession, texts: DataFrame, rows: int = ROWS) -> tuple[str, dict[str, float]]:
    """SQL of the probability, over features ``c.f``, and the threshold of each kind.

    All rows count in both: the trees learn from all of them, and the thresholds hold each row's
    score by trees of the other fold. Spark ML gets each cut of a feature as a feature of two
    values, for it draws rows to place the cuts of continuous ones.
    """
    scratch = Scratch(spark, "trees")
    every = examples(scratch, texts, rows)
    cuts = _cuts(every)
    columns = [(i, k) for i, places in enumerate(cuts) for k in range(len(places))]
    beyond = lambda i: F.size(F.filter(F.array(*[F.lit(c) for c in cuts[i]]).cast("array<double>"), lambda c: c < F.get("f", F.lit(i))))
    binned = every.select("kind", "label", "fold", "units", F.array(*[beyond(i) for i in range(len(FEATURES))]).alias("bins"))
    binned = binned.groupBy("kind", "label", "fold", "bins").agg(F.sum("units").alias("units"))
    # Dealt and ordered by their values, so the trees' sums don't depend on the shuffles.
    binned = scratch.write(binned.repartition(2, "bins").sortWithinPartitions("kind", "label", "fold", "bins"))
    # Three fits of many small jobs each, side by side.
    fit = inheritable_thread_target(spark)(lambda rows: _fit(rows, columns))
    with ThreadPoolExecutor(3) as pool:
        model, without_0, without_1 = pool.map(fit, (binned, binned.where("fold <> 0"), binned.where("fold <> 1")))
    within = lambda j: f"c.f[{columns[j][0]}] <= {columns[j][1]}"
    p = F.when(F.col("fold") == 0, F.expr(_probability(without_0, within))).otherwise(F.expr(_probability(without_1, within))).alias("p")
    held = binned.withColumn("c", F.struct(F.col("bins").alias("f"))).select("kind", "label", "units", p)
    # From the top score down: the lowest score at which the share of true rows is still high enough.
    good = F.sum(F.when(F.col("label") == 1, F.col("units")).otherwise(0)).alias("good")
    by_score = held.groupBy("kind", F.round("p", 2).alias("p")).agg(good, F.sum("units").alias("n")).orderBy("kind", F.desc("p")).collect()
    limits: dict[str, float] = dict.fromkeys(KINDS, 1.1)
    sums: dict[str, list[int]] = {k: [0, 0] for k in KINDS}
    for r in by_score:
        s = sums[r["kind"]]
        s[0], s[1] = s[0] + r["good"], s[1] + r["n"]
        if s[0] >= PRECISION * s[1]:
            limits[r["kind"]] = r["p"] - 0.005
    probability = _probability(model, lambda j: f"c.f[{columns[j][0]}] <= {cuts[columns[j][0]][columns[j][1]]!r}D")
    return probability, {k: max(v, 0.5) for k, v in limits.items()}


def _fit(binned: DataFrame, columns: list[tuple[int, int]]):
    """Boosted trees over "feature i lies beyond its cut k", for each of ``columns``."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    binary = {"ml_attr": {"attrs": {"binary": [{"idx": j, "name": f"{FEATURES[i]}_{k}"} for j, (i, k) in enumerate(columns)]}, "num_attrs": len(columns)}}
    values = F.array(*[(F.get("bins", F.lit(i)) > k).cast("double") for i, k in columns])
    rows = binned.select("label", (F.col("units") / F.lit(UNIT)).alias("weight"), array_to_vector(values).alias("v", metadata=binary))
    return GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=12, maxDepth=4, stepSize=0.3, seed=7).fit(rows)


def _probability(model, within: Callable[[int], str]) -> str:
    terms = [f"{w!r}D * ({_tree_sql(t._java_obj.rootNode(), within)})" for w, t in zip(model.treeWeights, model.trees, strict=True)]
    return f"1D / (1D + exp(-2D * ({' + '.join(terms)})))"


def _tree_sql(node, within: Callable[[int], str]) -> str:
    """A tree in SQL; ``within``: the condition under which a column has its first value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return f"{node.prediction()!r}D"
    split = node.split()
    left, right = (_tree_sql(n, within) for n in (node.leftChild(), node.rightChild()))
    if 0.0 not in list(split.leftCategories()):
        left, right = right, left
    return f"CASE WHEN {within(split.featureIndex())} THEN {left} ELSE {right} END"


def _raw(text: Column, context: int = 0) -> dict[str, Column]:
    """Matches of the base patterns by kind, before their tests."""
    return {
        "email": spans(text, BASE["email"], F.contains(text, F.lit("@")), context),
        "ip": spans(text, BASE["ip"], F.rlike(text, F.lit(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")), context),
        "card": spans(text, BASE["card"], F.rlike(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){12}+")), context),
        "phone": spans(text, BASE["phone"], F.rlike(text, F.lit(r"\+[0-9]")), context),
    }


def _passes(kind: str) -> Callable[[Column], Column]:
    """The test of a base match."""
    short = lambda p: F.regexp_replace(p, "^0+", "")
    small = lambda p: (F.length(short(p)) <= 3) & (F.substring(F.lpad(short(p), 3, "0"), 1, 3).cast("int") <= 255)
    return {
        "email": lambda s: s["hit"].isNotNull(),
        "ip": lambda s: F.forall(F.split(s["hit"], r"\."), small),
        "card": lambda s: luhn(digits(s["hit"])),
        "phone": lambda s: F.length(digits(s["hit"])).between(9, 15),
    }[kind]


def personal_data(spark: SparkSession, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (kind, start, end, hit), by kind, then start.

    ``base``: the leftmost non-overlapping matches of each kind that pass its test. ``added``: spans
    of wider generators (other writings of the four kinds) that overlap no base span and whose
    boosted-tree score reaches the kind's threshold; where such spans of two kinds overlap, both are
    listed, so nothing that reaches its threshold is lost. Code points, end exclusive. Null texts
    count as empty; repeated rows stay; an empty table gives no rows; other columns are not read.
    Equal scores can't conflict. One pass to learn from, one pass to find; no text is shuffled.
    """
    t = F.col("_t")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t"))
    probability, limits = train(spark, rows)
    found = {k: F.filter(v, _passes(k)) for k, v in _raw(t).items()}
    rows = rows.select("doc_id", "_t", *[v.alias(f"b_{k}") for k, v in found.items()])
    named = lambda k, prefix, *more: F.transform(f"{prefix}_{k}", lambda s: F.struct(F.lit(k).alias("kind"), *[s[c].alias(c) for c in ("start", "end", "hit", *more)]))
    guards = {
        "email": F.rlike(t, F.lit(GUARD_EMAIL)),
        "ip": F.rlike(t, F.lit(r"[\[(]\.[\])]|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:")),
        "card": F.rlike(t, F.lit(r"[0-9]{4}[\x20._/-]{1,2}[0-9]{4}")),
        "phone": F.rlike(t, F.lit(r"[0-9]{2}\)?[\x20.-][0-9]{3,4}[\x20.-][0-9]{3}")),
    }
    rows = rows.select("doc_id", *[f"b_{k}" for k in KINDS], *[spans(t, GENERATORS[k], guards[k], CONTEXT).alias(f"g_{k}") for k in KINDS])
    rows = rows.select("doc_id", *[f"b_{k}" for k in KINDS], F.concat(*[named(k, "b") for k in KINDS]).alias("base"), F.concat(*[named(k, "g", "before", "after") for k in KINDS]).alias("wide"))
    for k in KINDS:
        apart = let(in_stretches(F.col(f"b_{k}")), lambda s: F.filter("wide", lambda c: ~overlaps(c, s)))
        rows = rows.withColumn("wide", F.when(F.size("wide") > 0, apart).otherwise(F.col("wide")))
    scored = F.transform("wide", lambda c: F.struct(*[c[x].alias(x) for x in ("kind", "start", "end", "hit")], _features(c["kind"], c["hit"], c["before"], c["after"]).alias("f")))
    rows = rows.select("doc_id", "base", scored.alias("wide"))
    rows = rows.select("doc_id", "base", F.expr(f"transform(wide, c -> struct(c.kind, c.start, c.end, c.hit, {probability} AS p))").alias("wide"))
    limit = lambda c: F.when(c["kind"] == "email", limits["email"]).when(c["kind"] == "ip", limits["ip"]).when(c["kind"] == "card", limits["card"]).otherwise(limits["phone"])
    chosen = F.filter("wide", lambda c: c["p"] >= limit(c))
    return rows.select("doc_id", "base", F.transform(chosen, lambda c: F.struct(*[c[x].alias(x) for x in ("kind", "start", "end", "hit")])).alias("added"))


def all_spans(base: str = "base", added: str = "added") -> Column:
    """Base and added spans by kind as listed, then start."""
    rank = lambda s: F.when(s["kind"] == "email", 0).when(s["kind"] == "ip", 1).when(s["kind"] == "card", 2).otherwise(3)
    both = F.transform(F.concat(base, added), lambda s: F.struct(rank(s).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_sort(both)


__all__ = ["KINDS", "all_spans", "examples", "listed", "natural_rows", "personal_data", "train", "training_rows"]
