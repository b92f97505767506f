"""curata: governed dataset curation and evaluation on Spark."""
