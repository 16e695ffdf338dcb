"""Analytics on timed, speaker-tagged transcripts as PySpark DataFrame transformations."""
