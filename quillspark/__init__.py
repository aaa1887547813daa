"""quillspark: a Spark-native filings-corpus engine.

Reference tables (companies, filings, index documents, concept facts) and a
submission -> sections -> clean text -> report pipeline, written as DataFrame
jobs that Catalyst plans.  Every public operator takes and returns a DataFrame.
"""

__version__ = "0.1.0"
