"""Log-domain and vector functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

ZERO = float("-inf")


def safe_log(x: Column) -> Column:
    """Natural logarithm with log 0 = -infinity."""
    return F.when(x <= 0, F.lit(ZERO)).otherwise(F.ln(x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double"))


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return F.when(top == ZERO, F.lit(ZERO)).otherwise(top + F.ln(F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x - top))))


def log_add(x: Column, y: Column) -> Column:
    return log_sum_exp(F.array(x, y))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def hellinger(a: Column, b: Column) -> Column:
    """Similarity 1 - |sqrt a - sqrt b| / sqrt 2; 0 where it is not a number."""
    d = total(F.zip_with(a, b, lambda x, y: F.pow(F.sqrt(x.cast("double")) - F.sqrt(y.cast("double")), F.lit(2.0))))
    s = 1 - F.sqrt(d) / F.sqrt(F.lit(2.0))
    return F.when(F.isnan(s) | s.isNull(), 0.0).otherwise(s)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0)))))


def argmax(a: Column) -> Column:
    """0-based position of the greatest element; the lowest wins ties."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def one_hot(i: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.when(k == i, 1).otherwise(0))


def step_size(t: Column, a: float, alpha: float) -> Column:
    return F.pow(t + F.lit(a), F.lit(-alpha))


def usable(v: Column, dim: int) -> Column:
    """A vector of ``dim`` numbers, not all zero."""
    return (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0)


def kbest(v: Column, k: int) -> Column:
    """Projection on the k greatest log scores: the others become -infinity, the mass stays. k = 0 keeps all."""
    if k == 0:
        return v
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  one evaluation, not one per element
    mass = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + F.exp(x))

    def shifted(s: Column) -> Column:
        kept = F.transform(s["w"], lambda x: F.when(x >= s["floor"], x).otherwise(F.lit(ZERO)))
        by = F.ln(mass(s["w"])) - F.ln(mass(kept))
        return let(F.struct(kept.alias("k"), by.alias("by")), lambda t: F.transform(t["k"], lambda x: x + t["by"]))

    # scores relative to the greatest, so that their exponentials do not vanish
    relative = let(F.array_max(v), lambda m: F.struct(F.transform(v, lambda x: x - m).alias("w"), m.alias("m")))
    return let(
        let(relative, lambda r: F.struct(r["w"].alias("w"), r["m"].alias("m"), F.element_at(F.sort_array(r["w"], asc=False), k).alias("floor"))),
        lambda s: F.transform(shifted(s), lambda x: x + s["m"]),
    )
