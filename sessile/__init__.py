"""sessile: measurement analytics and curation on Spark."""
