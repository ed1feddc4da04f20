"""Timeline analytics as Spark jobs: interval algebra, transcripts, audio and pixel tables."""
