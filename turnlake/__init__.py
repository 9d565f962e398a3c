"""Spark jobs over AI-chat transcripts, app actions and weekly usage facts."""
