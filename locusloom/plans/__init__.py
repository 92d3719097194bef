"""Named queries over the test tables and the SQL that states the same results."""

from .problems import PROBLEM_SQL, PROBLEMS
from . import breakends, files, judged, reference_more  # noqa: F401  (register their queries)
from .reference import Q, S

CORE_QUERIES = {**PROBLEMS, **Q}
CORE_SQL = {**PROBLEM_SQL, **S}
