"""Column-level building blocks (pure ``Column -> Column`` helpers)."""

from casetally.functions.arith import (count_missing, count_true, prop_missing,
                                       prop_true, rate_per, safe_ratio, strict_sum)
from casetally.functions.draws import scaled, uniform_u32
from casetally.functions.recode import (any_above, any_equals, any_in, any_of,
                                        binary_label, code_labels, equals_flag,
                                        fill_missing, ladder, ladder_strict,
                                        level_ordinal, not_in_keep_null, null_if,
                                        null_if_above, paste_key, priority_group,
                                        replace_value, tri_flag)

__all__ = [
    "any_above", "any_equals", "any_in", "any_of", "binary_label", "code_labels",
    "count_missing", "count_true", "equals_flag", "fill_missing", "ladder",
    "ladder_strict", "level_ordinal", "not_in_keep_null", "null_if", "null_if_above",
    "paste_key", "priority_group", "prop_missing", "prop_true", "rate_per",
    "replace_value", "safe_ratio", "scaled", "strict_sum", "tri_flag",
    "uniform_u32",
]
