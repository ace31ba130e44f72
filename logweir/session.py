"""Session builder with the settings that the engine's semantics rely on."""

from pyspark.sql import SparkSession

#: Settings that results depend on; everything else is left to the cluster.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master=None, app="logweir", **conf):
    """A session; keyword names have dots written as double underscores."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTIC_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def query_session(spark):
    """An isolated session for user SQL: own temp views, "x" is an identifier."""
    session = spark.newSession()
    session.conf.set("spark.sql.session.timeZone", "UTC")
    session.conf.set("spark.sql.ansi.doubleQuotedIdentifiers", "true")
    return session
