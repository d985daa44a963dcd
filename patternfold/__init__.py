"""patternfold: explainable pattern analytics over ordered series, written for Spark's DataFrame engine."""

__version__ = "0.1.0"
