from claimlens.functions.exprs import (
    blank_to_null,
    code_type,
    display_name,
    efficiency_tier,
    full_name,
    outlier_flag,
    pg_concat,
    ratio,
    round_stat,
)

__all__ = [
    "blank_to_null", "code_type", "display_name", "efficiency_tier", "full_name",
    "outlier_flag", "pg_concat", "ratio", "round_stat",
]
