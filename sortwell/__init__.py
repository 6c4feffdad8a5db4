"""sortwell: curation of labelled collections as Spark DataFrame jobs."""
