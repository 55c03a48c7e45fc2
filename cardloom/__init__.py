"""cardloom: record-digitization analytics and corpus preparation as Spark jobs."""
