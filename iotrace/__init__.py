"""iotrace: storage-I/O trace analytics on Spark DataFrames."""
