"""Scalar functions as Column expressions, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Col = Column | str
AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"


def col(c: Col) -> Column:
    return F.col(c) if isinstance(c, str) else c


def named(name: str) -> Column:
    """A column by its whole name, dots and blanks included."""
    return F.col(f"`{name.replace('`', '``')}`")


# Strings and paths


def path_stem(path: Col) -> Column:
    """The file name without its last suffix."""
    return F.regexp_extract(col(path), r"([^/]+?)(\.[^./]*)?$", 1)


def dataset_label(path: Col) -> Column:
    """The file name without its last suffix and without ``.splits``."""
    return F.replace(path_stem(path), F.lit(".splits"), F.lit(""))


def path_segment(path: Col, place: int) -> Column:
    """A segment of a path, from 1."""
    return F.try_element_at(F.split(col(path), "/"), F.lit(place))


def metric_name(function: Col) -> Column:
    return F.regexp_replace(col(function), "^metric_", "")


def contains_text(value: Col, query: str) -> Column:
    """Whether the value, as text, holds the query anywhere, in any case; an empty query always does."""
    return F.lit(True) if not query else F.instr(F.lower(col(value).cast("string")), query.lower()) > 0


def title(name: Col) -> Column:
    return F.replace(col(name), F.lit("_"), F.lit(" "))


def overview(markdown: Col) -> Column:
    """The first paragraph that is no heading, quote or blank line."""
    return F.trim(F.regexp_extract(col(markdown), r"(?m)^(?!\s*(?:#|>|$))(.+(?:\n(?!\s*(?:#|>|\n|$)).+)*)", 1))


# Numbers


def parse_float(value: Col) -> Column:
    """The number that a string begins with, else NaN."""
    head = F.regexp_extract(col(value), r"^\s*([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?))", 1)
    return F.coalesce(head.try_cast("double"), F.lit(float("nan")))


def fixed(value: Col, digits: int = 4) -> Column:
    """A number with so many decimals; text that is no number stays as it is."""
    number = parse_float(value)
    return F.when(col(value).isNull() | F.isnan(number), col(value)).otherwise(F.format_string(f"%.{digits}f", number))


def int_of(value: Col) -> Column:
    """An integer from a number or its text, cut towards zero; null if it is neither."""
    return col(value).try_cast("double").try_cast("int")


def top_k_of(metadata: Col) -> Column:
    """``top_k`` of a map of strings, as int, or null."""
    return int_of(F.try_element_at(col(metadata), F.lit("top_k")))


def json_top_k(text: Col, key: str = "top_k") -> Column:
    return int_of(F.get_json_object(col(text), f"$.{key}"))


def page_count(rows: Col, size: int) -> Column:
    return F.ceil(col(rows) / F.lit(float(size))).cast("long")


def ratio(a: Col, b: Col) -> Column:
    """a / b in double precision, null if b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


# Sequences


def residues(sequence: Col) -> Column:
    return F.filter(F.split(col(sequence), ""), lambda c: c != "")


def one_hot(sequence: Col, alphabet: str = AMINO_ACIDS, length: int | None = None, unknown: str = "error") -> Column:
    """Flattened indicators of each residue, padded with zeros to ``length`` residues.

    A residue outside the alphabet is an error, or zeros with ``unknown='zero'``.
    """
    letters = F.array(*[F.lit(a) for a in alphabet])
    width = len(alphabet)

    def encode(c: Column) -> Column:
        hot = F.transform(letters, lambda a: F.when(a == c, 1.0).otherwise(0.0))
        if unknown == "zero":
            return hot
        return F.when(F.array_contains(letters, c), hot).otherwise(F.raise_error(F.concat(F.lit("not in the alphabet: "), c)).cast("array<double>"))

    flat = F.flatten(F.transform(residues(sequence), encode))
    if length is None:
        return flat
    return F.concat(flat, F.array_repeat(F.lit(0.0), F.greatest(F.lit(length * width) - F.size(flat), F.lit(0))))


def differing_positions(a: Col, b: Col) -> Column:
    """1-based places at which two strings of one length differ; other lengths are an error."""
    pairs = F.zip_with(residues(a), residues(b), lambda x, y: x != y)
    found = F.filter(F.transform(pairs, lambda d, i: F.when(d, i + 1)), lambda p: p.isNotNull())
    return F.when(F.length(col(a)) == F.length(col(b)), found).otherwise(F.raise_error(F.lit("sequences differ in length")).cast("array<int>"))


def hamming(a: Col, b: Col) -> Column:
    return F.size(differing_positions(a, b))


def bool_mask(length: Col, inside: Col) -> Column:
    """A mask of ``length`` flags, true at the 0-based places of the array ``inside``."""
    return F.transform(F.sequence(F.lit(0), col(length) - 1), lambda i: F.array_contains(col(inside), i))


# Arrays and maps


def log_softmax(values: Col) -> Column:
    top = F.array_max(col(values))
    total = F.aggregate(col(values), F.lit(0.0), lambda s, v: s + F.exp(v - top))
    return F.transform(col(values), lambda v: v - top - F.log(total))


def array_sum(values: Col) -> Column:
    return F.aggregate(col(values), F.lit(0.0), lambda s, v: s + v)


def array_mean(values: Col) -> Column:
    return F.try_divide(array_sum(values), F.size(col(values)).cast("double"))


def dot(a: Col, b: Col) -> Column:
    return array_sum(F.zip_with(col(a), col(b), lambda x, y: x * y))


def without_keys(m: Col, *keys: str) -> Column:
    return F.map_filter(col(m), lambda k, _: ~k.isin(*keys))


def map_get(m: Col, key: str, default: Col) -> Column:
    """The value of a key, or the default where the map or the key is missing."""
    return F.coalesce(F.try_element_at(col(m), F.lit(key)), col(default))


def key_set(m: Col) -> Column:
    """The distinct keys of a map, in order."""
    return F.array_sort(F.array_distinct(F.map_keys(col(m))))


def names_of(items: Col) -> Column:
    """The ``name`` of each struct of an array, in place."""
    return F.transform(col(items), lambda v: v["name"])


def page_slice(items: Col, number: int, size: int) -> Column:
    """A page of an array, from 1."""
    return F.slice(col(items), (max(number, 1) - 1) * size + 1, size)


def label(template: str, *values: Col) -> Column:
    """A text from a printf template."""
    return F.format_string(template, *[col(v) for v in values])


def filled_or(c: Col, default: str = "unknown") -> Column:
    return F.coalesce(col(c), F.lit(default))


def map_text(m: Col) -> Column:
    """``key value`` pairs of a map joined by blanks."""
    return F.array_join(F.transform(F.map_entries(col(m)), lambda e: F.concat_ws(" ", e["key"], e["value"])), " ")
