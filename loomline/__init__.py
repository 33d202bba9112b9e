"""Web-record analytics written as Spark jobs."""
