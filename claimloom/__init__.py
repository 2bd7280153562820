"""claimloom: fact-check pages and claims to an interlinked graph, on Spark DataFrames."""

__version__ = "0.1.0"
