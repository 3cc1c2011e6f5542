"""heronlake: document retrieval and corpus analytics as PySpark DataFrame operators."""
