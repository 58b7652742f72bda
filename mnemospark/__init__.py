"""mnemospark: evidence-memory retrieval and data-processing operators as Spark DataFrames."""
