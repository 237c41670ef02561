"""The binary log format, a Spark data source for it, and store directories."""
