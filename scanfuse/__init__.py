"""Point-cloud analytics and change detection as Spark jobs."""
