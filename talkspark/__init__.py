"""talkspark: spoken-dialogue corpora on Spark, from transcripts to training pairs and their measures."""
