"""Training-data operators: token counts, near and exact duplicates, mixing,
quality, secrets and archives, each as Spark jobs over whole tables."""
