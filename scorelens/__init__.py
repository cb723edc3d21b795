"""Comment-score analytics written as Spark DataFrame and Spark ML jobs."""
