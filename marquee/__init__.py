"""Event-catalogue curation, scoring and recommendation as Spark DataFrame plans."""
