"""Set-at-a-time question answering and corpus preparation on Spark."""
