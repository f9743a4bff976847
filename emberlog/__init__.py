"""Log analytics for incident response as DataFrame functions on Spark."""
