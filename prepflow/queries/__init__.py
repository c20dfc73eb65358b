from prepflow.queries import describe, explore, learn, prepare  # noqa: F401
from prepflow.queries.registry import ORACLE, QUERIES  # noqa: F401
