"""hireplane: job ranking and visa-sponsorship analytics as Spark DataFrame jobs."""
