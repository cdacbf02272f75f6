"""Condition-monitoring analytics for fleets of moving sensor units, as Spark jobs."""
