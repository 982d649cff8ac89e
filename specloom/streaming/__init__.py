"""Drop-folder ingest as a structured stream."""
