"""Session-risk scoring and detector evaluation as PySpark DataFrame and streaming jobs."""
