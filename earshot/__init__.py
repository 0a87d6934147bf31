"""earshot: curation and evaluation of labelled media-segment corpora as Spark DataFrame jobs."""
