"""tabrisk: tabular risk scoring on Spark.

Validation, provenance audit, stratified splitting, training-only
preprocessing, three model families, evaluation reports and batch scoring,
each written as DataFrame plans that Catalyst and AQE can distribute.
"""

__version__ = "0.1.0"
