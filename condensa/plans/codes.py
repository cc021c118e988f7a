"""The codes a failure can have and what a command ends with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values ----------------------------------------------------------------------------------------------
EXIT_CODES = {
    "invalid_request": 2,
    "schema_unsupported": 2,
    "source_unsupported": 2,
    "token_profile_unsupported": 2,
    "budget_unsatisfiable": 3,
    "input_too_large": 2,
    "resource_exhausted": 2,
    "unsafe_root": 2,
    "permission_denied": 5,
    "acquisition_failed": 6,
    "store_full": 5,
    "store_busy": 5,
    "commit_failed": 5,
    "artifact_unknown": 4,
    "artifact_expired": 4,
    "artifact_corrupt": 4,
    "artifact_schema_unsupported": 4,
    "invariant_breach": 70,
}
# ----------------------------------------------------------------------------------------------------------------


def exit_code(error: Column) -> Column:
    """0 without an error; null for a code that isn't one."""
    table = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return F.when(error.isNull(), 0).otherwise(F.try_element_at(table, error))


def keeps_artifact(error: Column) -> Column:
    """Whether a failed projection still names the artifact it was of: only where another budget would do."""
    return F.coalesce(error == "budget_unsatisfiable", F.lit(False))
