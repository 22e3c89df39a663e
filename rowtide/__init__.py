"""rowtide: binary change logs as Spark data frames."""
