"""mediacat: catalog analytics for photo and video libraries on Apache Spark."""
