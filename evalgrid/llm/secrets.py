"""Secret scan: a trigram inverted index chooses the texts that a rule's regular expression has to see.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .rows import with_row_key
from .scratch import Scratch
from .spans import EMPTY, spans

#: Alternatives that a stretch of a regular expression may expand to before it counts as unknown.
EXPANSIONS = 48


@dataclass(frozen=True)
class Rule:
    """``least``: characters that the group (0: the whole match) must have."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = True


# The base rules in their order, then public formats of keys.
RULES = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # A whole run of hexadecimal digits, if it is long enough; no trigram is mandatory.
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", base=False),
    Rule("jwt", r"\beyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", base=False),
    Rule("github", r"\bgh[pousr]_[A-Za-z0-9]{36,}+", base=False),
    Rule("slack", r"\bxox[abprs]-[A-Za-z0-9-]{10,}+", base=False),
)

Query = tuple | str | None  # ("and" | "or", [queries]), one trigram, or None: any text may match


def _all_of(queries: list[Query]) -> Query:
    found = list(dict.fromkeys(q for q in queries if q is not None))
    return None if not found else found[0] if len(found) == 1 else ("and", tuple(found))


def _any_of(queries: list[Query]) -> Query:
    found = list(dict.fromkeys(queries))
    return None if not found or None in found else found[0] if len(found) == 1 else ("or", tuple(found))


def _of_string(s: str) -> Query:
    return _all_of([s[i : i + 3] for i in range(len(s) - 2)])


def trigram_query(pattern: str) -> Query:
    """What each text that the pattern matches has, as trigrams of lower-cased text joined by and / or.

    The pattern is read as a sequence of parts. Neighbouring parts with few possible strings are
    multiplied out, and each stretch demands the trigrams of one of its strings; groups and
    alternatives are taken apart in the same way; anything else ends a stretch.
    """
    exact, query = _sequence(_parser.parse(pattern))
    return _any_of([_of_string(s) for s in sorted(exact)]) if exact is not None else query


def _sequence(parts) -> tuple[set[str] | None, Query]:
    """The strings that the parts can be, if few, and else their query."""
    demands: list[Query] = []
    stretch, whole = {""}, True

    def end() -> None:
        nonlocal stretch
        if all(len(s) >= 3 for s in stretch):
            demands.append(_any_of([_of_string(s) for s in sorted(stretch)]))
        stretch = {""}

    for op, value in parts:
        strings, query = _part(op, value)
        if strings is None and query == "nothing":  # an assertion takes no characters
            continue
        if strings is None or len(strings) * len(stretch) > EXPANSIONS:
            end()
            whole = False
            demands.append(query)
            if strings is not None:
                stretch = strings
        else:
            stretch = {a + b for a in stretch for b in strings}
    if whole:
        return stretch, None
    end()
    return None, _all_of(demands)


def _part(op, value) -> tuple[set[str] | None, Query]:
    if op is C.LITERAL:
        return {chr(value).lower()}, None
    if op is C.IN and value[0][0] is not C.NEGATE:
        found: set[str] = set()
        for kind, v in value:
            if kind is C.LITERAL:
                found.add(chr(v).lower())
            elif kind is C.RANGE and v[1] - v[0] < 8:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, None
        return (found, None) if len(found) <= 8 else (None, None)
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        inner = [_sequence(x) for x in value[1]]
        if all(e is not None for e, _ in inner):
            return set().union(*(e for e, _ in inner)), None
        return None, _any_of([_any_of([_of_string(s) for s in sorted(e)]) if e is not None else q for e, q in inner])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = value
        exact, query = _sequence(inner)
        if exact is not None and (low, high) == (0, 1):
            return exact | {""}, None
        if exact is not None and low == high and len(exact) ** low <= EXPANSIONS:
            out = {""}
            for _ in range(low):
                out = {a + b for a in out for b in exact}
            return out, None
        if low:
            return None, _any_of([_of_string(s) for s in sorted(exact)]) if exact is not None else query
        return None, None
    if op in (C.ASSERT, C.ASSERT_NOT, C.AT):
        return None, "nothing"
    return None, None


def trigrams_of(query: Query) -> set[str]:
    return set() if query is None else {query} if isinstance(query, str) else set().union(*(trigrams_of(q) for q in query[1]))


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, row_key): the inverted index of the lower-cased texts, for the trigrams asked for; one pass over a text."""
    return rows.select("row_key", F.explode(present_trigrams(F.lower("text"), trigrams)).alias("trigram"))


def present_trigrams(low: Column, trigrams: list[str]) -> Column:
    """Those of the trigrams that a text holds: looked for at every place, by their first character."""
    by_first: dict[str, list[str]] = {}
    for t in trigrams:
        by_first.setdefault(t[0], []).append(t[1:])
    branch = "|".join(_literal(c) + "(?:" + "|".join(map(_literal, sorted(ends))) + ")" for c, ends in sorted(by_first.items()))
    first = "".join("\\" + c if c in "[]^-\\&" else c for c in sorted(by_first))
    return F.array_distinct(F.regexp_extract_all(low, F.lit(f"(?=[{first}])(?=({branch}))"), F.lit(1)))


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(row_key, kinds): rows whose posting lists satisfy a query, with the kinds that they satisfy.

    A row's postings come from one task, so they are combined before the shuffle; each row has at
    most as many as the queries have trigrams.
    """
    has = index.groupBy("row_key").agg(F.collect_set("trigram").alias("_has"))

    def holds(query: Query) -> Column:
        if isinstance(query, str):
            return F.array_contains("_has", query)
        out = holds(query[1][0])
        for q in query[1][1:]:
            out = out & holds(q) if query[0] == "and" else out | holds(q)
        return out

    kinds = F.filter(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]), lambda k: k.isNotNull())
    return has.select("row_key", kinds.alias("kinds")).where(F.size("kinds") > 0)


def _long_enough(rule: Rule) -> Callable[[Column], Column]:
    return lambda s: F.length(F.regexp_extract(s["hit"], rule.pattern, rule.group) if rule.group else s["hit"]) >= rule.least


def _named(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["hit"].alias("hit"))


def secrets(spark: SparkSession, docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, base, added) for every row: arrays of (kind, start, end, hit), by start, then kind as listed.

    ``base``: the leftmost non-overlapping matches of each base rule that are long enough;
    ``added``: those of the other rules. Code points, end exclusive. Null texts count as empty;
    repeated rows stay; an empty table gives no rows; other columns are not read.

    Rules with mandatory trigrams see only the texts that their Boolean query lets through the
    postings; rules without scan every text.
    """
    scratch = Scratch(spark, "secrets")
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) is not None}
    rows = with_row_key(docs, text, doc_id).withColumn("text", F.coalesce("text", F.lit("")))
    wanted = sorted(set().union(*(trigrams_of(q) for q in queries.values()))) if queries else []
    if wanted:
        chosen = scratch.write(candidates(postings(rows, wanted), queries))
        rows = rows.join(chosen, "row_key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    found = {}
    for rank, rule in enumerate(rules):
        guard = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) if rule.kind in queries else None
        hits = spans(F.col("text"), rule.pattern, guard)
        if rule.least:
            hits = F.filter(hits, _long_enough(rule))
        found[f"r{rank}"] = hits
    rows = rows.select("doc_id", *[v.alias(k) for k, v in found.items()])

    def gathered(base: bool) -> Column:
        named = [F.transform(f"r{i}", _named(i, r.kind)) for i, r in enumerate(rules) if r.base == base]
        both = F.array_sort(F.concat(*named)) if named else F.array().cast(EMPTY)
        return F.transform(both, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"))) if named else both

    return rows.select("doc_id", gathered(True).alias("base"), gathered(False).alias("added"))
