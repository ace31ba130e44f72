"""logweir: a Spark-native engine for structured log events.

Events are validated, written as Parquet by service and hour, tracked in a
transactional catalog and queried with Spark SQL over one relation, ``logs``,
that shows every (kafka_partition, kafka_offset) once.
"""
