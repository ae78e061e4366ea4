"""Column-expression helpers (all JVM-side, inside whole-stage codegen)."""

from panelspark.functions.exprs import (  # noqa: F401
    clip, days_between, keyed_uniform, normal_draw, softplus, round6,
)
