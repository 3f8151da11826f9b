"""Personal-data discovery and compliance over document collections, in Spark."""
