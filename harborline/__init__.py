"""Fleet-operations analytics for managed databases, as PySpark jobs."""
