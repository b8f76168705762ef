"""Record linkage and entity resolution as lazy DataFrame operators on Spark."""

__version__ = "0.1.0"
