"""What the confidence model sees of a reading, and its alternatives, from token probabilities kept as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The model's inputs in order, and the value types of each group.
FEATURES = ["lp_mean", "lp_min", "n_tokens", "second_agree", "second_missing", "parse_ok", "lexicon_score", "n_flags", "out_of_range", "ink_cols", "reg_similarity", "sharpness", "is_arabic", "vt_date", "vt_bp", "vt_number", "vt_choice", "vt_text"]
TYPE_GROUPS = {"vt_date": ["date"], "vt_bp": ["bp"], "vt_number": ["int", "float", "gest_age"], "vt_choice": ["bool", "enum"], "vt_text": ["text", "code"]}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def token_statistics(logprobs: Column) -> dict[str, Column]:
    """mean, least and summed probability of the tokens; 0, 0 and 1 without tokens."""
    some = F.size(F.coalesce(logprobs, F.array().cast("array<double>"))) > 0
    return {
        "mean_logprob": F.when(some, _sum(logprobs) / F.size(logprobs)).otherwise(0.0),
        "min_logprob": F.when(some, F.array_min(logprobs)).otherwise(0.0),
        "seq_prob": F.when(some, F.exp(_sum(logprobs))).otherwise(1.0),
    }


def counted_flags(flags: Column) -> Column:
    """How many flags are faults: those of fields that don't apply are none."""
    return F.size(F.filter(flags, lambda f: ~f.startswith("not_applicable")))


def second_reading(status: Column, value: Column, other_status: Column, other_value: Column) -> Column:
    """1 if a second reading has the same status and the same canonical value, else 0 (also without one)."""
    return F.coalesce(((status == other_status) & value.eqNullSafe(other_value)).cast("double"), F.lit(0.0))


def text_features(logprobs: Column, value_type: Column, ink_cols: Column, similarity: Column, sharpness: Column, parsed: dict[str, Column]) -> Column:
    """A map of all features; `parsed` has those that come from parsing. Values are rounded to 4 places."""
    stats = token_statistics(logprobs)
    known = {
        "lp_mean": stats["mean_logprob"], "lp_min": F.greatest(stats["min_logprob"], F.lit(-10.0)), "n_tokens": F.coalesce(F.size(logprobs), F.lit(0)).cast("double"), "n_flags": F.lit(0.0),
        "ink_cols": F.least(F.coalesce(ink_cols, F.lit(0.0)), F.lit(200.0)) / 100.0, "reg_similarity": similarity, "sharpness": F.least(F.coalesce(sharpness, F.lit(0.0)), F.lit(1000.0)) / 1000.0,
        **{name: value_type.isin(types).cast("double") for name, types in TYPE_GROUPS.items()}, **parsed,
    }
    return F.create_map(*(x for name in FEATURES if name in known for x in (F.lit(name), F.round(known[name].cast("double"), 4))))


def feature_vector(features: Column) -> Column:
    """The features in the model's order; a missing one is 0."""
    return F.transform(F.array(*(F.lit(n) for n in FEATURES)), lambda n: F.coalesce(F.try_element_at(features, n), F.lit(0.0)))


def only(features: Column, names: list[str]) -> Column:
    return F.map_filter(features, lambda k, _: k.isin(names))


def without(values: Column, name: str) -> Column:
    return F.map_filter(values, lambda k, _: k != name)


def with_second(primary: Column, second: Column, alternatives: Column, most: int = 3) -> Column:
    """Alternatives without control tokens; a second reading that differs comes first."""
    kept = F.filter(alternatives, lambda a: ~a.startswith("<|"))
    first = F.when((second != "") & (second != primary), F.array(second)).otherwise(F.array().cast("array<string>"))
    return F.slice(F.concat(F.coalesce(first, F.array().cast("array<string>")), kept), 1, most)


def offered(alternatives: Column, value: Column, most: int = 2) -> Column:
    """The distinct alternatives that aren't the value itself, first ones first."""
    return F.slice(F.array_distinct(F.filter(alternatives, lambda a: a.isNotNull() & (a != value))), 1, most)


def token_swaps(tokens: Column, most: int = 3) -> Column:
    """Readings with one token replaced by a runner-up, the smallest loss of probability first.

    tokens: an array of structs (token, logprob, others: array of structs (token, logprob)), others without the best.
    """
    place = F.sequence(F.lit(1), F.size(tokens))
    swaps = F.flatten(F.transform(F.arrays_zip(place.alias("i"), tokens.alias("t")), lambda x: F.transform(F.filter(x["t"]["others"], lambda o: (F.trim(o["token"]) != "") & (o["token"] != x["t"]["token"])), lambda o: F.struct((x["t"]["logprob"] - o["logprob"]).alias("gap"), x["i"].alias("i"), o["token"].alias("token")))))
    plain = F.array_join(F.transform(tokens, lambda t: t["token"]), "")
    read = F.transform(F.array_sort(swaps), lambda s: F.trim(F.array_join(F.transform(tokens, lambda t, k: F.when(k + 1 == s["i"], s["token"]).otherwise(t["token"])), "")))
    return F.when(F.size(tokens) > 0, F.slice(F.array_distinct(F.filter(read, lambda r: (r != "") & (r != F.trim(plain)))), 1, most)).otherwise(F.array().cast("array<string>"))
