"""Mining of repeated work in session transcripts, on Spark."""
