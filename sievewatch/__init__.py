"""Security-alert triage and threat-intelligence jobs on Spark DataFrames."""

__version__ = "0.1.0"
