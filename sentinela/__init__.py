"""Case surveillance, text grounding and reporting as Spark DataFrame jobs."""
