"""Field-visit planning and corpus preparation as Spark jobs."""
