"""riskfold: code-risk analytics as Spark DataFrame operators.

Source files become a syntax-node relation in one distributed pass; every
metric, label, profile, model metric, score and explanation after that is a
Spark SQL / DataFrame plan.
"""

from riskfold.schema import FEATURE_NAMES  # noqa: F401

__all__ = ["FEATURE_NAMES"]
