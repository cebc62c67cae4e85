"""Multi-regional input-output and supply-chain impact analysis as plain Spark DataFrame jobs."""

__version__ = "0.1.0"
