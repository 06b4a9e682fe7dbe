"""Runnable jobs over the library; each module has run(spark, ...) and a command line."""
