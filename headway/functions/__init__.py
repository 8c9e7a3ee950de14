"""Column expressions; all JVM-side."""

from headway.functions.columns import *  # noqa: F401,F403
from headway.functions.ordered import exact_median, previous_row, running_total, standings  # noqa: F401
