"""Sales-report cleaning, product matching, warehousing and reporting on Spark."""
