"""murkwatch: fraud and abuse signals as Spark DataFrame operators.

``functions``  column builders (Column -> Column), JVM expressions only
``operators``  DataFrame -> DataFrame jobs (joins, aggregates, windows, ML)
``sources``    readers, dataset adapters and sinks
``streaming``  Structured Streaming forms of the feed and drift jobs
``plans``      the registered queries and their SQL twins
"""
