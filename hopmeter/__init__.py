"""hopmeter: stage latency of messages on their way through several topics, as Spark jobs."""
