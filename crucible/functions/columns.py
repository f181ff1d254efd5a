"""Column expressions: identifiers, canonical JSON, stoichiometry, labels and vectors. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Direction names in their order, and the codes that data sources use for them.
DIRECTIONS = ("left_to_right", "right_to_left", "reversible", "undefined")
DIRECTION_CODES = {"LR": "left_to_right", "RL": "right_to_left", "BI": "reversible", "UN": "undefined"}
#: What a direction says about net flux.
SEMANTICS = {"left_to_right": "net_flux_left_to_right", "right_to_left": "net_flux_right_to_left", "reversible": "equilibrium_bidirectional"}


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# identifiers


def prefixed(prefix: str, number: Column | str) -> Column:
    """prefix:number."""
    return F.concat(F.lit(prefix + ":"), col(number).cast("string"))


def numeric_suffix(identifier: Column | str) -> Column:
    """The number after the colon; an error where there is none."""
    return F.split_part(col(identifier), F.lit(":"), F.lit(2)).cast("bigint")


def first_group(text: Column | str, pattern: str) -> Column:
    """The first group of a pattern's first match; null without a match."""
    return F.nullif(F.regexp_extract(col(text), pattern, 1), F.lit(""))


def recode(code: Column | str, codes: dict[str, str]) -> Column:
    """The name of a code; null for codes that are not listed."""
    out = F.lit(None).cast("string")
    for k, v in codes.items():
        out = F.when(col(code) == k, v).otherwise(out)
    return out


def split_sides(smiles: Column | str) -> tuple[Column, Column]:
    """The components on either side of the first `>>`; empty lists for null, for no `>>` and for an empty side."""
    s = col(smiles)
    parts = F.split(s, ">>", 2)
    side = lambda i: F.when(s.contains(">>") & (parts[i] != ""), F.split(parts[i], "[.]")).otherwise(F.array().cast("array<string>"))
    return side(0), side(1)


# canonical JSON and hashes


def json_text(x: Column | str) -> Column:
    """A string as a JSON value; null as `null`."""
    one = F.to_json(F.array(col(x)), {"ignoreNullFields": "false"})
    return F.when(col(x).isNull(), F.lit("null")).otherwise(F.substring(one, F.lit(2), F.length(one) - 2))


def json_number(x: Column | str) -> Column:
    return F.coalesce(col(x).cast("string"), F.lit("null"))


def json_list(items: Column) -> Column:
    """A JSON list of an array of JSON texts."""
    return F.concat(F.lit("["), F.array_join(items, ","), F.lit("]"))


def stable_hash(json: Column) -> Column:
    """SHA-256 in hex of a canonical JSON text."""
    return F.sha2(json, 256)


def sorted_map_json(entries: Column) -> Column:
    """A map as JSON with keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


# stoichiometry


def gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm in as many steps as the smaller number can need."""
    steps = (4.8 * F.log10(F.least(a, b).cast("double") + 2)).cast("int") + 3
    start = F.struct(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    step = lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.greatest(s["b"], F.lit(1).cast("long"))).alias("b")))
    return F.aggregate(F.sequence(F.lit(1), steps), start, step)["a"]


def common_divisor(values: Column) -> Column:
    """The greatest common divisor of an array of longs that are not negative, at least 1; 1 for none. With a 1 among them nothing is divided."""
    one = F.lit(1).cast("long")
    return F.when(F.array_contains(values, one), one).otherwise(F.greatest(F.aggregate(values, F.lit(0).cast("long"), gcd), one))


def reduced_coefficients(participants: Column) -> Column:
    """Sorted (compound_id, coefficient, compartment): whole parts of the coefficients over their greatest common divisor."""
    whole = lambda p: p["coefficient"].cast("long")
    divisor = common_divisor(F.transform(participants, lambda p: F.abs(whole(p))))
    divided = lambda d: lambda p: F.struct(p["compound_id"].alias("compound_id"), F.floor(whole(p) / d).cast("long").alias("coefficient"), p["compartment"].alias("compartment"))
    # The outer list has one element, the divisor: it is computed once, not for each participant.
    return F.transform(F.array(divisor), lambda d: F.array_sort(F.transform(participants, divided(d))))[0]


def strict_key(participants: Column, direction: Column) -> Column:
    items = F.transform(reduced_coefficients(participants), lambda p: json_list(F.array(json_text(p["compound_id"]), json_number(p["coefficient"]), json_text(p["compartment"]))))
    return stable_hash(F.concat(F.lit('{"direction":'), json_text(direction), F.lit(',"participants":'), json_list(items), F.lit("}")))


def loose_key(participants: Column, ignored: list[str]) -> Column:
    """As strict_key without ignored compounds, compartments and direction; the rest is reduced by itself."""
    rest = F.filter(participants, lambda p: ~p["compound_id"].isin(ignored)) if ignored else participants
    items = F.transform(reduced_coefficients(rest), lambda p: json_list(F.array(json_text(p["compound_id"]), json_number(p["coefficient"]))))
    return stable_hash(F.concat(F.lit('{"participants":'), json_list(items), F.lit("}")))


# directions and labels


def direction_policy(supported: Column) -> Column:
    """The model's direction from the supported ones."""
    have = lambda d: F.array_contains(supported, d)
    left, right, both = (F.coalesce(have(d), F.lit(False)) for d in DIRECTIONS[:3])
    only = F.size(F.array_distinct(supported)) == 1
    return F.when(both | (left & right), "reversible").when(left & only, "left_to_right").when(right & only, "right_to_left").otherwise("undefined")


def label_tokens(labels: Column, level: str) -> Column:
    """The distinct prefixes of dotted labels with so many parts (labels with fewer have none); "exact": the labels; null: none."""
    labels = F.coalesce(labels, F.array().cast("array<string>"))
    if level == "exact":
        return F.array_distinct(labels)
    n = int(level)
    parts = lambda e: F.split(e, "[.]")
    return F.array_distinct(F.transform(F.filter(labels, lambda e: F.size(parts(e)) >= n), lambda e: F.array_join(F.slice(parts(e), 1, n), ".")))


def one_hot(value: Column, choices: list) -> Column:
    """0/1 by choice, with a last place for any other value."""
    hits = [F.when(value == F.lit(c), 1.0).otherwise(0.0) for c in choices]
    other = F.when(value.isin(choices), 0.0).otherwise(1.0)
    return F.array(*hits, other)


# vectors


def as_doubles(vector: Column | str) -> Column:
    return col(vector).cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def all_finite(a: Column) -> Column:
    return ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))


def wide(vector: Column | str, size: int, prefix: str = "embedding_") -> list[Column]:
    """One column for each component."""
    return [col(vector)[i].alias(f"{prefix}{i}") for i in range(size)]
