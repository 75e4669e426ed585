from claimweave.functions.canonical import canonical_hash, multiset_fingerprint, short_id
from claimweave.functions.codes import apply_change, group_and_price
from claimweave.functions.conditions import compile_condition, row_filter
from claimweave.functions.transforms import compile_expr

__all__ = [
    "apply_change",
    "canonical_hash",
    "compile_condition",
    "compile_expr",
    "group_and_price",
    "multiset_fingerprint",
    "row_filter",
    "short_id",
]
