"""A governed analytics engine on Spark: SQL and graph answers behind one policy boundary."""
