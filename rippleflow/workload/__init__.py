"""Driver-facing queries: the economy derived from the driver tables and one entry per operator."""
