"""draftlens: revision analytics and corpus operators on PySpark."""
